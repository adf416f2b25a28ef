"""Word-wise encoding with the ``tokenizers`` library: each distinct word is encoded once, texts are joined from words.

A word here is a span at whose ends the pre-tokenizer always cuts, so encoding it alone gives the ids that it has
within its text. Texts that hold a special token's string go to the library whole, as that string is cut out first.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACES, Memo, in_groups, unit_pattern

_CACHE: dict = {}

#: Letters whose lower case is one letter, and that compose with nothing before them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The same beyond ASCII as UTF-8 bytes, here as characters of those numbers.
_LATIN_BYTES = "\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: Marks that a run at the end of a word is made of.
END_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space other than the space and the line break.
OTHER_SPACES = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_names() -> list[tuple[str, str]]:
    """The byte-level alphabet beyond ASCII: printable bytes are their own characters, the others follow 255 in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [(chr(b), chr(256 + k)) for k, b in enumerate(hidden) if b > 127]


def _id_code(tokenizer) -> str:
    return "H" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"


def id_width(path: str) -> int:
    """Bytes of an id that a ``WordEncoder`` of this vocabulary file writes."""
    from tokenizers import Tokenizer

    return array(_id_code(Tokenizer.from_file(path))).itemsize


class WordEncoder:
    """ids of whole texts as little-endian bytes, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, memo_limit: int = 96 << 20, group: int = 1 << 23):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t["content"].lower() for t in spec["added_tokens"]]
        kinds = {(spec.get("normalizer") or {}).get("type")} | {x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])}
        pre = spec["pre_tokenizer"]
        steps = pre.get("pretokenizers", [pre])
        self.drops_spaces = any(s["type"] == "Split" and s["behavior"] == "Removed" for s in steps)
        self.lowers = "Lowercase" in kinds
        level = next((s for s in steps if s["type"] == "ByteLevel"), None)
        # Only the two layouts whose cuts are proven above are encoded by words.
        self.by_words = level is not None and not level["add_prefix_space"] and (self.drops_spaces and kinds <= {None, "Sequence", "NFC", "Replace", "Lowercase"} or level["use_regex"] and kinds == {None})
        self.code = _id_code(self.tokenizer)
        self.width = array(self.code).itemsize
        if self.drops_spaces:
            self.latin = re.compile(f"(?:[a-zA-Z]|{_LATIN_BYTES})+".encode("latin-1"))
            self.end_marks, self.ends_in_letter = END_MARKS.encode(), re.compile(f"(?s:.*)(?:[a-zA-Z]|{_LATIN_BYTES})".encode("latin-1")).fullmatch
        else:
            self.latin = re.compile(f"\n?[{LETTERS}]+")
            self.end_marks, self.ends_in_letter = END_MARKS, re.compile(f"(?s:.*)[{LETTERS}]").fullmatch
        self.units = unit_pattern(SPACES)
        self.memo, self.group = Memo(self._fill, memo_limit), group
        if not self.by_words:
            return
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or else that begin one
        for token, i in vocabulary.items():
            self.marks[i] = token.endswith("</w>") if self.drops_spaces else token.startswith("Ġ") or token == "Ċ"
        self.break_ids = 0 if self.drops_spaces else len(self._encode(["\n"])[0]) // self.width
        self.merges = Tokenizer.from_file(path)  # the same merges, on words that are cut and named by bytes already
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.byte_names = byte_names()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, keys: list) -> list[bytes]:
        """A letter and the marks that end the word are always cut apart, which makes most new words old ones."""
        known, marks, letter = self.memo.young, self.end_marks, self.ends_in_letter
        heads = [h if len(h) < len(k) and letter(h) else k for k in keys for h in (k.rstrip(marks),)]
        alone = list(set(heads).difference(known))
        ids = dict(zip(alone, self._encode_keys(alone), strict=True))
        ends = list({k[len(h) :] for k, h in zip(keys, heads, strict=True) if k is not h})
        after = dict(zip(ends, self._encode([m.decode() for m in ends] if self.drops_spaces else ends), strict=True))
        values = [ids[h] if h in ids else known[h] for h in heads]
        return [v if k is h else v + after[k[len(h) :]] for k, h, v in zip(keys, heads, values, strict=True)]

    def _encode_keys(self, keys: list) -> list[bytes]:
        """Words of Latin letters only go to the merges as one text, which is cut by the ids at which words end or begin."""
        latin = self.latin.fullmatch
        plain, rest = [], []
        for k in keys:
            (plain if latin(k) else rest).append(k)
        if self.drops_spaces:
            text = b" ".join(plain).decode().lower()
            out = dict(zip(rest, self._encode([k.decode() for k in rest]), strict=True))
        else:
            text = " ".join(plain)
            out = dict(zip(rest, self._encode([k if k[:1] == "\n" else " " + k for k in rest]), strict=True))
        if plain:
            text = text.encode().decode("latin-1")
            for a, b in self.byte_names:
                text = text.replace(a, b)
            if not self.drops_spaces:  # a line break is a word of its own, then the word without a space before it
                text = ("Ġ" + text.replace(" ", " Ġ")).replace("Ġ\n", "Ċ ")
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            at = np.flatnonzero(self.marks[ids])
            at = [0, *(at + 1).tolist()] if self.drops_spaces else [*at.tolist(), len(ids)]
            if len(at) != len(plain) + 1:
                raise ValueError("the vocabulary's ids don't show where words end")
            raw, n = ids.astype(f"<u{self.width}").tobytes(), self.width
            out.update((k, raw[i * n : j * n]) for k, i, j in zip(plain, at, at[1:], strict=False))
        return [out[k] for k in keys]

    def _whole(self, text: str) -> bool:
        """Whether a text can't be cut into words by their separators alone.

        Where words are kept with the space before them, a key is the word without that space, and a word at the start
        of a line has the line break before it. That needs single spaces and line breaks; other texts are cut by pattern.
        """
        if not self.by_words or "<" in text and any(x in text.lower() for x in self.specials):
            return True
        if self.drops_spaces:
            return False
        return not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in OTHER_SPACES)

    def _by_pattern(self, text: str) -> bytes:
        """A text with unusual white space, by spans that each go to the library."""
        return b"".join(self._encode(self.units.findall(text))) if self.by_words and not any(x in text.lower() for x in self.specials) else self._encode([text])[0]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Texts by their words: distinct words are found in Arrow, looked up once, and their ids gathered into place."""
        if self.drops_spaces:  # only A-Z are lowered, only ASCII white space splits
            column = pa.array(texts, pa.string())
            words = pc.ascii_split_whitespace(pc.ascii_lower(column) if self.lowers else column)
            drop = 0
        else:
            words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
            drop = self.break_ids  # of the line break put before each text
        coded = words.flatten().dictionary_encode()
        keys, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        if self.drops_spaces:
            keys = [k.encode() for k in keys]
        else:  # the first word of a text has a line break before it
            first = offsets[:-1]
            heads = ["\n" + keys[i] for i in index[first]]
            index = index.copy()
            index[first] = np.arange(len(keys), len(keys) + len(heads))
            keys += heads
        values = self.memo.rows([keys])[0]
        # a group has less than 2 ** 31 ids, as a text of Arrow's has less than 2 ** 31 bytes
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // self.width
        ids = np.frombuffer(b"".join(values), f"<u{self.width}")
        size = sizes[index]
        ends = np.zeros(len(size) + 1, np.int32)
        size.cumsum(out=ends[1:])
        at = np.repeat((sizes.cumsum(dtype=np.int32) - sizes)[index] - ends[:-1], size)
        at += np.arange(ends[-1], dtype=np.int32)
        ids, spots = ids[at], ends[offsets]
        return [ids[i + drop : j].tobytes() for i, j in zip(spots, spots[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        for part in in_groups(texts, self.group):
            plain = []
            for i in part:
                if self._whole(texts[i]):
                    out[i] = self._by_pattern(texts[i])
                else:
                    plain.append(i)
            if plain:
                for i, ids in zip(plain, self._by_words([texts[i] for i in plain]), strict=True):
                    out[i] = ids
        return out


def encoder(path: str, memo_limit: int = 96 << 20, group: int = 1 << 23) -> WordEncoder:
    """This worker's encoder of a vocabulary file; it outlives the task, and its memo of twice these bytes with it.

    At a time it works on ``group`` characters of texts, or on one longer text.
    """
    if path not in _CACHE:
        _CACHE[path] = WordEncoder(path, memo_limit, group)
    return _CACHE[path]


def piece_processor(path: str):
    """This worker's SentencePiece processor of a model file."""
    if path not in _CACHE:
        import sentencepiece

        _CACHE[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _CACHE[path]
