"""Removing passages that an earlier document holds, by content-defined chunks.

A gear hash rolls over the last 16 bytes of a text.  A chunk ends after a white
space where the hash is in its lowest third, or after any
other character where it is far lower, if the previous such place is at
least ``MIN_CHUNK`` bytes back.  Stretches over ``MAX_CHUNK`` bytes, as in text
without spaces, are also cut where the hash is least among the places up to
``REACH`` bytes around.  So ends depend on nearby bytes only, and an insertion
moves no chunk border beyond its own surroundings.  The exception is what has no
such place in ``MAX_CHUNK`` bytes (a few characters over and over): it is cut
every ``MAX_CHUNK`` bytes.

Chunks are compared by digest over all documents.  The first occurrence (least
document id, then text hash, then place) stays; a run of repeated chunks is
removed when it has at least ``min_run`` bytes, so chance repetitions of a few
words stay.  Chunks hold whole characters, and almost always whole words.  A digest
has 96 bits, of two independent hashes: among the 2.5e12 chunks of 100 TB the
chance of any clash is below 1 in 10,000.

Null text stays null and empty text empty.  Rows with the same id and text get
the same result.  Null ids are ordered first.  Columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import SALT, copied, dealt, hot_keys
from .spans import KEY, merge_spans, packed, rewrite
from .storage import drop_tables, materialize
from .textops import SPACE, Texts, other_hash, prefix_hash, slices, span_hash

DIGEST = ("digest", "more")
MIN_CHUNK, MAX_CHUNK, WINDOW, REACH = 16, 256, 16, 32
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(buf: np.ndarray) -> np.ndarray:
    """At each byte, the sum of table values of the last 16 bytes, each shifted once for every byte since."""
    h = _GEAR[buf]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def lowest_places(value: np.ndarray) -> np.ndarray:
    """Places whose value is below all of the REACH before and above none of the REACH after."""
    least = value.copy()  # of the REACH places from each on
    step = 1
    while step < REACH:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    none = np.iinfo(value.dtype).max
    before = np.concatenate([[none], np.minimum.accumulate(value[: REACH - 1]), least[:-REACH]])[: len(value)]
    return np.flatnonzero((value < before) & (value <= np.append(least[1:], none)))


def chunk_ends(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks in the batch's bytes, and the number of chunks of each text."""
    buf, offs = texts.buf, texts.offs
    if not len(buf):
        return np.zeros(0, int), np.zeros(texts.n, int)
    whole = gear_hash(buf)
    h = whole >> np.uint32(16)
    inside = np.ones(len(buf) + 1, bool)
    inside[:-1] = (buf & 0xC0) != 0x80  # an end lies before the first byte of a character
    end = np.flatnonzero(np.where(SPACE[buf], h < 65536 // 3, h < 65536 // 2048) & inside[1:]) + 1
    start_of = offs[np.searchsorted(offs, end, "right") - 1]
    end = end[(end - start_of >= WINDOW)]
    end = end[np.diff(end, prepend=-MIN_CHUNK) >= MIN_CHUNK]
    end = np.unique(np.concatenate([end, offs[1:][np.diff(offs) > 0]]))
    start = np.concatenate([[0], end[:-1]])
    long = np.flatnonzero(end - start > MAX_CHUNK)
    if len(long):
        more = []
        for k in long:
            # A text's first hashes reach into the text before it.
            low = max(start[k] + MIN_CHUNK, offs[np.searchsorted(offs, start[k], "right") - 1] + WINDOW)
            place = np.arange(low, end[k] - MIN_CHUNK + 1)
            value = np.where(inside[place], whole[place - 1].astype(np.int64), np.iinfo(np.int64).max)
            border = np.concatenate([[start[k]], place[lowest_places(value)], [end[k]]])
            more.append(border[1:-1])
            for at in np.flatnonzero(np.diff(border) > MAX_CHUNK):
                cut = np.arange(border[at] + MAX_CHUNK, border[at + 1], MAX_CHUNK)
                for _ in range(3):
                    cut = cut + ~inside[cut]
                more.append(cut)
        end = np.unique(np.concatenate([end, *more]))
    return end, np.diff(np.searchsorted(end, offs, "right"))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in slices(batch.column(2)):
            end, n = chunk_ends(texts)
            start = np.concatenate([[0], end[:-1]])[: len(end)]
            digest = span_hash(prefix_hash(texts.buf), start, end).view(np.int64)
            more = (other_hash(texts.buf, start, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            row = pa.array(np.repeat(np.arange(a, b), n))
            place = np.arange(len(end)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(more), batch.column(0).take(row), batch.column(1).take(row), pa.array(place.astype(np.int32))], names=[*DIGEST, *KEY, "place"])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Key and ``note``: the places of a document's chunks that occurred before."""
    chunks = materialize(packed(docs).select(*KEY, "__text").mapInArrow(_chunks, f"digest long, more int, {KEY[0]} long, {KEY[1]} long, place int"), "chunks")
    # Digests alone are counted first, so that places travel once and the rest works on repeated chunks only.
    keys = list(DIGEST)
    twice = materialize(chunks.groupBy(*keys).count().where("count > 1"), "chunk-counts")
    hot = hot_keys(twice, keys, chunks.count())
    salted = [*keys, SALT]
    repeated = dealt(chunks, hot, keys, [*KEY, "place"]).join(copied(twice.select(*keys), hot, keys), salted, "left_semi")
    repeated = materialize(repeated, "chunks-repeated")
    first = repeated.groupBy(*keys).agg(F.min(F.struct(*KEY, "place")).alias("first"))
    again = repeated.join(copied(first, hot, keys), salted).where(~F.struct(*KEY, "place").eqNullSafe(F.col("first")))
    notes = materialize(again.groupBy(*KEY).agg(F.collect_set("place").alias("note")), "chunk-notes")
    drop_tables(chunks, twice, repeated)
    return notes


def drop_repeated_passages(docs: DataFrame, min_run: int = 80) -> DataFrame:
    """``docs`` without repeated passages, and n_bytes, n_removed, n_spans, kept_sha256."""

    def spans_of(text: bytes, note: list[int]) -> tuple[np.ndarray, np.ndarray]:
        end, _ = chunk_ends(Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
        start = np.concatenate([[0], end[:-1]])
        s, e = merge_spans(start[np.array(note)], end[np.array(note)])
        return s[e - s >= min_run], e[e - s >= min_run]

    return rewrite(docs, repeated_chunks(docs), "array<int>", spans_of)
