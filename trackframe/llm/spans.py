"""Joining per-document decisions back to whole texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Key columns of a document: its id and the hash of its text.  Rows that agree in both share their result.
KEY = ("__id", "__text_hash")


#: All columns of a document in one, so that none clashes with columns of an operator.
WHOLE = "__whole"


def packed(docs: DataFrame, *without: str) -> DataFrame:
    """Key, the whole text as bytes (``__text``) and all columns but ``without`` as one struct."""
    columns = [F.col(quoted(c)) for c in docs.columns if c.lower() not in without]
    return docs.select(F.col("doc_id").cast("long").alias(KEY[0]), F.xxhash64("text").alias(KEY[1]), F.col("text").cast("binary").alias("__text"), F.struct(*columns).alias(WHOLE))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns of the documents that :func:`packed` made ``rows`` of."""
    return rows.select(f"{WHOLE}.*")


def join_key(left: DataFrame, right: DataFrame) -> Column:
    return left[KEY[0]].eqNullSafe(right[KEY[0]]) & (left[KEY[1]] == right[KEY[1]])


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of non-empty spans; touching spans make one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return start[at], end[np.concatenate([at[1:] - 1, [len(end) - 1]])]


def cut_out(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    """``text`` without the given disjoint ascending spans."""
    if not len(start):
        return text
    parts, at = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        parts.append(text[at:s])
        at = e
    return b"".join([*parts, text[at:]])


#: What :func:`rewrite` reports of each document.
REWRITTEN = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def rewrite(docs: DataFrame, notes: DataFrame, note_type: str, spans_of: Callable[[bytes, object], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Remove from each text the byte spans that ``spans_of(text, note)`` gives.

    ``notes`` has the key and a column ``note`` of ``note_type``, at most one row
    for a key; a document without one keeps its text.  Returns the columns of
    ``docs`` (text rewritten; null stays null) and n_bytes, n_removed, n_spans,
    kept_sha256, which take the place of columns of ``docs`` so named.
    """
    left, right = packed(docs, "text", *REWRITTEN), notes.select(*KEY, "note")
    joined = left.join(right, join_key(left, right), "left").select(WHOLE, "__text", "note")

    def run(batches):
        import hashlib

        for batch in batches:
            texts, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out, size, gone, spans, digest = [], [], [], [], []
            for text, note in zip(texts, found, strict=True):
                s, e = spans_of(text, note) if text and note else (np.zeros(0, int), np.zeros(0, int))
                kept = cut_out(text or b"", s, e)
                out.append(None if text is None else kept)
                size.append(len(text or b""))
                gone.append(int((e - s).sum()))
                spans.append(len(s))
                digest.append(hashlib.sha256(kept).hexdigest())
            made = [pa.array(out, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[WHOLE, "__text", *REWRITTEN])

    whole = next(f for f in joined.schema.fields if f.name == WHOLE)
    types = ("binary", "long", "long", "long", "string")
    schema = StructType([whole, *(StructField(c, StructType.fromDDL(f"x {t}")["x"].dataType) for c, t in zip(("__text", *REWRITTEN), types, strict=True))])
    rows = joined.mapInArrow(run, schema)
    kept = [F.col("__text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col(WHOLE).getField(c).alias(c) for c in docs.columns if c.lower() not in REWRITTEN]
    return rows.select(*kept, *REWRITTEN)
