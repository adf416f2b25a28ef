"""Token counts, packing, the piece codec and sorted shards against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tidemark.llm import common, packing, piece_codec, sstable, token_counts  # noqa: E402
from tidemark.llm.vocabularies import WordEncoder  # noqa: E402

MODEL, WORDS, BYTES = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ALPHABET = [*"ab'sdtA.,!  \n\n\t\r19é\u0301\xa0 \x85\x1c日本İΣς<|>▁\x00😀", "<|endoftext|>", "<|ENDOFTEXT|>", " <|startoftext|>", "'re", "'LL", "  ", "<s>", "</s>", "<0x0A>", "the", "ing", "▁▁", " " * 17, "ть"]


def fuzz(n, size=30, seed=1):
    rng = random.Random(seed)
    return ["", *("".join(rng.choices(ALPHABET, k=rng.randint(0, size))) for _ in range(n))]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, part string")


def sample(spark, sf):
    """Whole documents, and null, empty, repeated and very long texts, with columns that clash with the operators' own."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(100_000, None), (100_001, ""), (100_002, " "), (100_003, "word " * 60_000), (100_004, "x" * 100_000), (None, "no id"), (5, rows[5][1])]
    return [(i, t, "a", "b") for i, t in rows]


@pytest.fixture(scope="module")
def rows(spark, sf):
    return sample(spark, sf)


def sentencepiece():
    import sentencepiece as s

    return s.SentencePieceProcessor(model_file=MODEL)


def library(path, texts):
    """ids of whole texts by the library itself."""
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_words_encode_as_whole_texts(path):
    e, texts = WordEncoder(path, memo_limit=50_000), fuzz(4000)
    want = [np.array(x.ids, "<u2").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want
    assert e.encode(texts) == want


def test_piece_codec_is_the_library():
    c, sp = piece_codec.PieceCodec(MODEL, memo_limit=50_000), sentencepiece()
    texts = fuzz(4000)
    for t, (n, a, b) in zip(texts, c.digests(texts), strict=True):
        ids = sp.encode(t, add_eos=True)
        assert (n, a, b) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()), repr(t)
        assert [*c.encode(t), 2] == ids


def test_pieces_side_by_side_are_those_that_merging_leaves():
    c, rng = piece_codec.PieceCodec(MODEL, pair_limit=500), random.Random(5)

    def merged(text):
        parts = list(text)
        while True:
            found = [(-c.scores[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in c.scores]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    ids = sorted(c.ids.values())
    near = [i for i in ids if c.pieces[i].isalpha() and len(c.pieces[i]) <= 3][:300]
    seen = set()
    for _ in range(4000):
        x, y = (rng.choice(near), rng.choice(near)) if rng.random() < 0.7 else (rng.choice(ids), rng.choice(ids))
        want = merged(c.pieces[x] + c.pieces[y]) == [c.pieces[x], c.pieces[y]]
        assert c.fits(x << 20 | y) == want, (c.pieces[x], c.pieces[y])
        seen.add(want)
    assert seen == {True, False} and len(c.pairs) <= 500


def test_decoding_any_ids_is_the_library():
    c, sp, rng = piece_codec.PieceCodec(MODEL), sentencepiece(), random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(400) if rng.random() < 0.5 else rng.randrange(32_000) for _ in range(rng.randint(0, 12))]
        assert c.decode(ids) == sp.decode(ids)
    for ids in ([], [2], [35], [35, 2], [259], [259, 259], [0], [1, 259], [3 + 32, 259]):  # ids of the space's byte, of marks and of special pieces come first
        assert c.decode(ids) == sp.decode(ids)


def test_split_texts_count_as_whole_ones():
    sp = sentencepiece()
    for t in fuzz(100, size=3000):
        assert sum(len(sp.encode(p)) for p in token_counts.safe_pieces(t, 50)) == len(sp.encode(t))


def test_token_counts(spark, rows):
    got = token_counts.count_tokens(table(spark, rows), MODEL, limit=4096).collect()
    sp = sentencepiece()
    want = sorted((i is not None, i or 0, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_piece_digests(spark, rows):
    got = piece_codec.piece_digests(table(spark, rows), MODEL).collect()
    sp, sha = sentencepiece(), lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i or -1, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))) for i, t, *_ in rows for ids in (sp.encode(t or "", add_eos=True),))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_encoded_pieces_decode(spark, rows):
    got = piece_codec.encode_pieces(table(spark, rows[:50]), MODEL).collect()
    sp = sentencepiece()
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in got} == {i: (x := sp.encode(t, add_eos=True), sp.decode(x)) for i, t, *_ in rows[:50]}


def test_packing_covers_every_id_once(spark, rows):
    d = table(spark, rows).repartition(3)
    got = packing.pack(d, WORDS, end_id=1, window=2048, with_ids=True).collect()
    want = sorted((x + [1] for x in library(WORDS, [t or "" for _, t, *_ in rows])), key=lambda x: (len(x), x))
    by_doc = {}
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc.setdefault((r["sequence_id"] * 2048 + r["offset"]) - r["start"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
    docs = [[x for _, ids, _ in sorted(p) for x in ids] for p in by_doc.values()]
    assert sorted(docs, key=lambda x: (len(x), x)) == want
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for s, o, n in spots:
        assert s * 2048 + o == at and o + n <= 2048
        at += n
    assert at == sum(map(len, want))


def test_shards_round_trip(spark, rows):
    d = table(spark, rows).repartition(3)
    shards = sstable.write_shards(d, BYTES, end_id=2)
    got = shards.read().collect()
    ids = [(i, np.array([*x, 2], "<u4")) for (i, *_), x in zip(rows, library(BYTES, [t or "" for _, t, *_ in rows]), strict=True)]
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -1, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: (r["start"])):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    for i, x in ids[:20]:
        found = shards.lookup(i)
        assert any(np.array_equal(f, x) for f in found) and len(found) == (2 if i == 5 else 1)
    assert len(shards.lookup(None)) == 1 and shards.lookup(77_777_777) == []


def test_memos_stay_within_their_bytes_and_hold_no_long_keys(monkeypatch):
    made = []
    m = common.Memo(lambda keys: made.extend(keys) or [k.encode() for k in keys], limit=5_000)
    rng = random.Random(2)
    for _ in range(300):
        group = [str(rng.randrange(400)) for _ in range(rng.randrange(60))] + ["x" * 300]
        assert m.rows([group, group[:3]]) == [[k.encode() for k in group], [k.encode() for k in group[:3]]]
        assert len(m.young) * m.ENTRY <= 5_000 and len(m.old) * m.ENTRY <= 5_000 and "x" * 300 not in m.young
    e = WordEncoder(BYTES, memo_limit=20_000)
    texts = [*fuzz(300, seed=9), "y" * 50_000, " ".join("z" * 400 for _ in range(30))]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == library(BYTES, texts)


def test_batches_are_of_bounded_bytes(monkeypatch):
    seen = []

    class Counting:
        def encode(self, pieces, **_):
            seen.append(sum(len(p.encode()) for p in pieces))
            return sp.encode(pieces)

    sp = sentencepiece()
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 5_000)
    monkeypatch.setattr(token_counts, "SPLIT_BYTES", 1_000)
    monkeypatch.setattr(token_counts, "piece_processor", lambda path: Counting())
    token_counts._SAFE["fake"] = True
    texts = ["日本語 テキスト " * 400, "plain words " * 900, "", "é" * 3_000, *fuzz(200, seed=4)]
    assert token_counts._piece_counts("fake", texts) == [len(sp.encode(t)) for t in texts]
    assert max(seen) < 9_100 and sum(n > 5_000 for n in seen) <= 1 and len(seen) > 5  # the text without spaces stays whole


def test_shards_by_bytes(spark, monkeypatch):
    d = table(spark, [(i, "some words " * 40, "a", "b") for i in range(300)])
    monkeypatch.setattr(sstable, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(sstable, "LEAST_BYTES", 15_000)
    assert sstable.shard_count(d, "text") == 7 and len(sstable.write_shards(d, BYTES, 2).rows) == 7
    assert sstable.shard_count(table(spark, []), "text") == 1


def test_a_repeated_row_fills_several_shards(spark, monkeypatch):
    rows = [(i, f"words of {i} " * 40, "a", "b") for i in range(100)]
    hot = [(50, "the same words " * 30, "a", "b")] * 400 + [(None, None, "a", "b")] * 300
    d = table(spark, rows + hot).repartition(3)
    monkeypatch.setattr(sstable, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(sstable, "SAMPLES", 1_000)
    shards = sstable.write_shards(d, BYTES, end_id=2)
    five = sstable.key_of(50)
    assert sum(r["low"] <= five <= r["high"] for r in shards.rows) >= 5
    want = [(i, len(x) + 1) for (i, *_), x in zip(rows + hot, library(BYTES, [t or "" for _, t, *_ in rows + hot]), strict=True)]
    got = shards.read().orderBy("start").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i is not None, i or 0, n) for i, n in want)
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order) and [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    assert len(shards.lookup(50)) == 401 and len(shards.lookup(None)) == 300 and len(shards.lookup(7)) == 1


def test_shard_lookup_in_many_blocks(tmp_path):
    w = sstable.ShardWriter(out := open(tmp_path / "x", "wb"), 2)
    for i in range(3000):
        w.add(sstable.key_of(i * 3), np.full(50, i % 60_000, "<u2").tobytes())
    w.close()
    out.close()
    shard = sstable.Shard(f"{tmp_path}/x")
    assert len(shard.blocks) > 3
    for i in range(0, 9000, 7):
        got = shard.get(i)
        assert [g.tolist() for g in got] == ([[i // 3] * 50] if i % 3 == 0 else [])


@pytest.mark.parametrize("make", [lambda d: token_counts.count_tokens(d, MODEL), lambda d: packing.pack(d, WORDS, 1), lambda d: piece_codec.piece_digests(d, MODEL), lambda d: sstable.write_shards(d, BYTES, 2).read()])
def test_empty_tables(spark, make):
    assert make(table(spark, [])).collect() == []
