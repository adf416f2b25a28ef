"""Token counts of whole texts (operator 1): batches balanced by bytes, lengths only.

Defined results: a null text counts as empty; an empty text has no tokens; repeated rows and null ids come out as
they went in; an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, strings
from .vocabularies import encoder, piece_processor

#: Bytes of text in UTF-8 handed to the library at once, and the size from which a text is split.
BATCH_BYTES = 1 << 19
SPLIT_BYTES = 1 << 16


def safe_pieces(text: str, limit: int) -> Iterator[str]:
    """Pieces of a text, of ``limit`` characters or a little more, whose SentencePiece token counts add up to the text's.

    A cut takes the place of one space that follows a character other than white space or the space mark: no piece
    of the vocabulary (checked on loading) has the mark after another character, so no token spans the cut, and the
    mark put before every text stands for the space taken out. A text without such a space stays whole.
    """
    start, n = 0, len(text)
    while n - start > limit:
        cut = text.find(" ", start + limit)
        while cut != -1 and (text[cut - 1] in " ▁" or cut + 1 >= n):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:] if start else text


def splits_at_spaces(sp) -> bool:
    """Whether the vocabulary lets a text be cut before a space: no piece holds the mark after another character."""
    return not any("▁" in p.lstrip("▁") for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)))


_SAFE: dict[str, bool] = {}


def _piece_counts(path: str, texts: list[str]) -> list[int]:
    sp = piece_processor(path)
    if path not in _SAFE:
        _SAFE[path] = splits_at_spaces(sp)
    counts = [0] * len(texts)
    pieces: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for i, ids in zip(owners, sp.encode(pieces, num_threads=1), strict=True):
            counts[i] += len(ids)
        pieces.clear()
        owners.clear()

    for i, t in enumerate(texts):
        size = len(t) if t.isascii() else len(t.encode())
        # as many characters as SPLIT_BYTES are by the text's own mean
        parts = safe_pieces(t, SPLIT_BYTES * len(t) // size) if _SAFE[path] and size > SPLIT_BYTES else (t,)
        for p in parts:
            n = len(p) if p.isascii() else len(p.encode())
            if pieces and held + n > BATCH_BYTES:
                flush()
                held = 0
            pieces.append(p)
            owners.append(i)
            held += n
    if pieces:
        flush()
    return counts


def counts_of(path: str, texts: list[str]) -> list[int]:
    """Token counts by the library that the file's suffix names."""
    if path.endswith(".model"):
        return _piece_counts(path, texts)
    e = encoder(path)
    return [len(x) // e.width for x in e.encode(texts)]


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""

    def run(batches):
        for batch in batches:
            texts = strings(batch, "_text")
            counts = counts_of(vocabulary, texts)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_bytes"), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"))
    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
