"""SentencePiece encoding and decoding by a prefix table (operator 7).

The merge process gives a text one sequence of pieces, and of any of its prefixes again one sequence. So each prefix has
one last token: among the pieces that end there (found by an automaton over all pieces), it is the one that can stand
beside the last token of the prefix before it. Two pieces can stand side by side if merging their joined text gives the
two again. The table is filled left to right, and the ids are read from it backwards.

Units are spans between which no piece of the vocabulary reaches (no piece has those two characters side by side), so
each distinct unit is encoded once, in a bounded memo, and texts are joined from units.

Defined results: a null text is empty, and an empty text is its end id alone; characters that no piece holds become
their UTF-8 bytes; repeated rows and null ids come out as they went in; an empty table gives an empty result; columns
other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Memo, in_groups, lean, strings

MARK = "▁"
NEVER = float("-inf")
_CACHE: dict = {}


class PieceCodec:
    def __init__(self, path: str, memo_limit: int = 100 << 20, pair_limit: int = 1_000_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n, t = model.normalizer_spec, model.trainer_spec
        if t.model_type != t.BPE or n.name != "identity" or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or not t.byte_fallback or t.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with byte fallback and without normalization are encoded here")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces aren't encoded here")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN}
        self.unk_surface = t.unk_surface
        # None: what a single id doesn't tell, that is unknown ids, bytes of longer characters, and the space's byte, which stays at a text's start
        self.surface: list[str | None] = [p.replace(MARK, " ") for p in self.pieces]
        for i in range(len(self.pieces)):
            b = self.byte_of.get(i)
            if i in self.special:
                self.surface[i] = ""
            elif i in self.unknown or b is not None:
                self.surface[i] = chr(b) if b is not None and b < 128 and b != 32 else None
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == t.eos_piece)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.side_by_side = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on after a space")
        own_line = not any("\n" in p for p in self.ids)
        self.units = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if own_line else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known = {p for p in self.ids if len(p) == 1}
        self.strange = re.compile(f"([^{re.escape(''.join(sorted(self.known)))}])")
        if {c for p in self.ids for c in p} - self.known:
            raise ValueError("a piece holds a character that is no piece")
        self.pairs: dict[int, bool] = {}
        self.paths: dict[int, tuple | None] = {}  # at most one entry for each piece of the vocabulary
        self.pair_limit = pair_limit
        self.memo = Memo(self._fill, memo_limit, lambda v: 8 * len(v))

    def merges(self, text: str):
        """The merge process itself, on a short text, the best-scored neighbours first, the leftmost of equals: (score of the next merge, parts before it); at the end, minus infinity and what is left."""
        parts, scores = list(text), self.scores
        while True:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            yield best, parts
            if at < 0:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def path(self, token: int) -> tuple | None:
        """How a piece comes of its own text: (scores of the merges, first parts, last parts) step by step; None if it doesn't."""
        got = self.paths.get(token, self)
        if got is self:
            steps = [(s, parts[0], parts[-1]) for s, parts in self.merges(self.pieces[token])]
            got = self.paths[token] = tuple(zip(*steps, strict=True)) if steps[-1][1] == self.pieces[token] else None
        return got

    def fits(self, key: int) -> bool:
        """Whether two pieces (key: the ids, the first shifted by 20 bits) stay two when their joined text is merged.

        The merges of either side are known, so the process on the joined text is the two interleaved by score, unless at
        some step the parts that touch make a piece with a better score than what comes next on both sides.
        """
        if len(self.pairs) >= self.pair_limit:
            self.pairs.clear()
        self.pairs[key] = known = self._stay_two(key >> 20, key & 0xFFFFF)
        return known

    def _stay_two(self, x: int, y: int) -> bool:
        left, right = self.path(x), self.path(y)
        if left is None or right is None:
            return False
        if self.pieces[x][-1] + self.pieces[y][0] not in self.side_by_side:
            return True
        scores = self.scores
        before, _, lasts = left
        after, firsts, _ = right
        i = j = 0
        while True:
            s = scores.get(lasts[i] + firsts[j])
            if s is not None and s > before[i] and s >= after[j]:
                return False
            if before[i] < after[j]:
                j += 1
            elif before[i] == NEVER:
                return True
            else:
                i += 1

    def stable(self, token: int) -> bool:
        """Whether merging a piece's own text gives the piece."""
        return self.path(token) is not None

    def encode_unit(self, text: str) -> list[int]:
        """ids of a text that holds the mark in place of spaces; -1 - code point for a character that no piece holds."""
        if not self.known.issuperset(text):
            return [i for part in self.strange.split(text) if part for i in ([-1 - ord(part)] if part not in self.known and len(part) == 1 else self.encode_unit(part))]
        n = len(text)
        last = [-1] * (n + 1)
        width = [0] * (n + 1)
        known = self.pairs.get
        end = 0  # of the prefix whose last token was found last
        for at, (size, token) in self.automaton.iter(text):
            if at < end:
                continue
            at += 1
            if size < at:
                key = last[at - size] << 20 | token
                fits = known(key)
                if not (self.fits(key) if fits is None else fits):
                    continue
            elif size > 1 and not self.stable(token):
                continue
            last[at], width[at], end = token, size, at
        out = []
        while n:
            out.append(last[n])
            n -= width[n]
        out.reverse()
        return out

    def with_bytes(self, ids: list[int]) -> list[int]:
        if ids and min(ids) < 0:
            return [x for i in ids for x in ((i,) if i >= 0 else (self.bytes[b] for b in chr(-1 - i).encode()))]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the library's decode() gives it: control ids have none, bytes that aren't UTF-8 are replaced."""
        try:
            text = "".join(map(self.surface.__getitem__, ids))
        except TypeError:  # bytes that have to be read together, or unknown ids
            return self._decode_bytes(ids)
        return text[1:] if text[:1] == " " else text

    def _decode_bytes(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        first = True
        for i in [*ids, None]:
            if i is not None and i in self.byte_of:
                run.append(self.byte_of[i])
                first = False
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
            if i is None or i in self.special:
                continue
            x = self.unk_surface if i in self.unknown else self.surface[i]
            out.append(x[1:] if first and x[:1] == " " and i not in self.unknown else x)
            first = False
        return "".join(out)

    def _fill(self, units: list[str]) -> list[tuple[int, ...]]:
        """ids of units; a closing mark that no piece joins to the letter before it is cut off."""
        young = self.memo.young
        out = []
        own: dict = {}

        def one(u: str):
            got = young.get(u) or own.get(u)
            if got is None:
                got = own[u] = tuple(self.with_bytes(self.encode_unit(u)))
            return got

        for u in units:
            if len(u) > 2 and u[-1] in ".,;:!?" and u[-2:] not in self.side_by_side:
                out.append(one(u[:-1]) + one(u[-1]))
            else:
                out.append(one(u))
        return out

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))[:-1]

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of whole texts, each with the end id."""
        for part in in_groups(texts, 1 << 22):
            cut = [self.units.findall(MARK + texts[i].replace(" ", MARK)) if texts[i] else [] for i in part]
            for got in self.memo.rows(cut):
                ids = list(chain.from_iterable(got))
                ids.append(self.end_id)
                yield ids

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(ids with the end id, their sha256, the sha256 of the text decoded from them) of whole texts."""
        written = self.decimal.__getitem__
        return [(len(ids), hashlib.sha256(" ".join(map(written, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()) for ids in self.encode_all(texts)]


def utf8(raw: bytes) -> str:
    """Bytes as text; each byte that is no part of a character becomes one replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


def codec(path: str) -> PieceCodec:
    if path not in _CACHE:
        _CACHE[path] = PieceCodec(path)
    return _CACHE[path]


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text decoded from them) of every row, with the end id."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            ids = list(c.encode_all(strings(batch, "_text")))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(run), f"`{id_col}` {kind}, ids array<int>, decoded string")


def piece_digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the digests of ``encode_pieces``, made without shipping ids to Spark."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            n, a, b = zip(*c.digests(strings(batch, "_text")), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
