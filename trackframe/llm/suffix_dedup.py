"""Removing every byte that a string of ``WIDTH`` bytes covers which also starts elsewhere.

A sparse suffix array finds the repeated strings.  In each string of 400 bytes
the 100-byte block with the least hash (leftmost on ties) is its anchor, so
equal strings have their anchors at the same place, and a text has one anchor
for about 150 of its strings.  Only suffixes at anchors are sorted:

1. Suffixes are range-partitioned by sampled splitters on their leading tokens
   (hash of the anchor block, then hash of all that strings with this anchor can
   hold).  Equal suffixes may lie in several buckets.
2. Each bucket sorts locally by multikey quicksort.  Suffixes whose leading block
   has no equal neighbour are done: all their strings are unique.  The first and
   last runs of a bucket may go on across its boundary, so they always stay.
   A suffix with an equal one as to both tokens is repeated as a whole.
3. For the rest, one suffix for each distinct context fetches its bytes and its
   strings are compared with those of all suffixes that share the block: a string
   is repeated if two suffixes have it at the same place.  Blocks with very many
   distinct contexts are compared by a shuffle of their single strings, packed.

The strings that hold one anchor overlap, so what they remove of a document is
one span.  Null text counts as empty; texts under 400 bytes lose nothing.
Repeated rows are repeated documents: they remove each other's strings.
Strings are compared by 64-bit hashes among those with the same 64-bit hash of
the anchor block, so a clash takes equality in both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import KEY, join_key, merge_spans, packed, rewrite
from .storage import drop_tables, materialize
from .textops import mix, prefix_hash, slices, span_hash

WIDTH, BLOCK = 400, 100
REACH = WIDTH - BLOCK
_INDEX_BITS = 23
#: Bytes of a text that are searched at once.
SEGMENT = 4 << 20
#: Distinct contexts of one anchor block that a task compares by itself.
HOT_CONTEXTS = 2_000
#: Contexts that a task holds at a time.
HELD_CONTEXTS = 4_000
#: Contexts of hot blocks whose strings a task packs at a time, and strings for each bucket of them.
HELD_STRINGS, BUCKET_STRINGS = 2_000, 500_000
#: Contexts of hot blocks whose findings a task merges at a time.
TARGET_CONTEXTS = 10_000


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys, from running minima forward and backward within blocks."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, 1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, prefix: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in the bytes of some texts, and their block hashes."""
    if len(buf) < WIDTH:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    block_start = np.arange(len(buf) - BLOCK + 1)
    block = span_hash(prefix, block_start, block_start + BLOCK)
    found = []
    for at in range(0, len(buf) - WIDTH + 1, SEGMENT):
        part = block[at : at + SEGMENT + REACH]
        key = (part >> np.uint64(_INDEX_BITS) << np.uint64(_INDEX_BITS)) | np.arange(len(part), dtype=np.uint64)
        least = sliding_least(key, REACH + 1) if len(part) > REACH else np.zeros(0, np.uint64)
        place = (least & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64) + at
        string = np.arange(at, at + len(place))
        inside = string + WIDTH <= offs[np.searchsorted(offs, string, "right").clip(max=len(offs) - 1)]
        found.append(place[inside])
    place = np.unique(np.concatenate(found))
    return place, block[place]


def _suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, texts in slices(batch.column(2)):
            prefix = prefix_hash(texts.buf)
            place, block = anchors(texts.buf, prefix, texts.offs)
            doc = np.searchsorted(texts.offs, place, "right") - 1
            left = np.minimum(place - texts.offs[doc], REACH)
            right = np.minimum(texts.offs[doc + 1] - place, WIDTH)
            context = mix(span_hash(prefix, place - left, place + right) + (left * 1024 + right).astype(np.uint64))
            row = pa.array(doc + a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(place - texts.offs[doc])],
                names=["block", "context", *KEY, "place"],
            )


def multikey_quicksort(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of suffixes by their tokens: quicksort by the first; runs of equals are sorted by the next, and so on."""
    order = np.argsort(tokens[0], kind="quicksort")
    same = np.zeros(len(order), bool)
    for depth in range(1, len(tokens)):
        before = tokens[depth - 1][order]
        tie = before[1:] == before[:-1] if depth == 1 else (before[1:] == before[:-1]) & same[1:]
        same = np.concatenate([[False], tie])
        member = same | np.concatenate([tie, [False]])
        at = np.flatnonzero(member)
        run = np.cumsum(~same)[at]
        inner = np.lexsort((tokens[depth][order[at]], run))
        order[at] = order[at[inner]]
    return order


#: What becomes of a suffix: all its strings are repeated; its context must be compared; it stands in for equal ones.
WHOLE, OPEN, STANDS_IN = 1, 2, 4


def _sort_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    block, context = (rows.column(k).to_numpy() for k in (0, 1))
    order = multikey_quicksort([block, context])
    block, context = block[order], context[order]
    new_block = np.concatenate([[True], block[1:] != block[:-1]])
    new_context = new_block | np.concatenate([[True], context[1:] != context[:-1]])
    run, kind = np.cumsum(new_block) - 1, np.cumsum(new_context) - 1
    copies, members, kinds = np.bincount(kind)[kind], np.bincount(run)[run], np.bincount(run, new_context)[run]
    edge = (run == 0) | (run == run[-1])
    fate = np.where(copies > 1, WHOLE, np.where((members > 1) | edge, OPEN, 0)) | np.where((copies > 1) & new_context & ((kinds > 1) | edge), STANDS_IN, 0)
    keep = np.flatnonzero(fate)
    out = rows.take(pa.array(order[keep])).append_column("fate", pa.array(fate[keep].astype(np.int8)))
    yield from out.to_batches(max_chunksize=50_000)


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around each wanted suffix of a text."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for doc, text_hash, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            for w in wanted:
                left = min(w["place"], REACH)
                values = (w["block"], doc, text_hash, w["place"], w["fate"], text[w["place"] - left : w["place"] + WIDTH])
                for column, v in zip(out, values, strict=True):
                    column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["block", *KEY, "place", "fate", "bytes"])


def _strings(block: np.ndarray, place: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of some contexts: row, bytes before the anchor, and hash over block, place and bytes."""
    rows, backs, hashes = [], [], []
    for a, b, texts in slices(column, 1 << 20):
        prefix = prefix_hash(texts.buf)
        left = np.minimum(place[a:b], REACH)
        n = np.maximum(np.minimum(np.diff(texts.offs) - WIDTH, left) + 1, 0)
        row = np.repeat(np.arange(b - a), n)
        first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = texts.offs[row] + first
        back = left[row] - first
        rows.append(row + a)
        backs.append(back)
        hashes.append(mix(span_hash(prefix, at, at + WIDTH) + mix(block[a:b][row].view(np.uint64) + back.astype(np.uint64))))
    return np.concatenate(rows), np.concatenate(backs), np.concatenate(hashes)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a group of blocks is compared when enough rows are held."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        block, place, fate = (rows.column(k).to_numpy() for k in (0, 3, 4))
        row, back, key = _strings(block, place, rows.column(5).chunk(0))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(key), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hit &= (fate[row] & OPEN) > 0
        far, near = np.full(len(block), -1), np.full(len(block), WIDTH)
        np.maximum.at(far, row[hit], back[hit])
        np.minimum.at(near, row[hit], back[hit])
        at = np.flatnonzero(far >= 0)
        take = pa.array(at)
        return pa.RecordBatch.from_arrays([*(rows.column(k).take(take).combine_chunks() for k in (1, 2)), pa.array(place[at] - far[at]), pa.array(place[at] - near[at] + WIDTH)], names=[*KEY, "from", "to"])

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= HELD_CONTEXTS:
            rows = pa.Table.from_batches(held)
            block = rows.column(0).to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                yield flush(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), len(rows) - cut
    if n:
        yield flush(pa.Table.from_batches(held))


def _extent(ctx: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, and the farthest and nearest start of their repeated strings."""
    order = np.lexsort((back, ctx))
    ctx, back = ctx[order], back[order]
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, int)
    return ctx[first], back[np.append(first[1:], len(ctx))[: len(first)] - 1], back[first]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and for each place in it the number of its equals."""
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    return order, np.bincount(run)[run] if len(key) else run


def _packed_strings(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Strings of contexts of hot blocks by bucket of their hash: keys, contexts (-1: known to be repeated, or not asked) and starts.

    What repeats among the contexts at hand travels once, so a string sends a
    bounded number of entries for each task however many contexts hold it.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, HELD_STRINGS):
            part = batch.slice(at, HELD_STRINGS)
            block, place, fate, ctx = (part.column(k).to_numpy() for k in (0, 3, 4, 6))
            row, back, key = _strings(block, place, part.column(5))
            order, equals = _runs(key)
            asked = (fate[row[order]] & OPEN) > 0
            row, back, key = row[order], back[order], key[order]
            hit = asked & (equals > 1)
            known = _extent(ctx[row[hit]], back[hit])
            once = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            who = np.where(asked & (equals == 1), ctx[row], -1)[once]
            key, back = key[once], back[once]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            packs = [pa.array([x[order][cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()) for x in (key, who, back.astype(np.int16))]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *packs], names=["bucket", "keys", "who", "backs"])
            if len(known[0]):
                packs = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(known, (np.int64, np.int16, np.int16), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(known[0][0]) % buckets], pa.int32()), *packs], names=["bucket", "keys", "who", "backs"])


def _compare_strings(batches: Iterable[pa.RecordBatch], targets: int) -> Iterator[pa.RecordBatch]:
    """Contexts with a repeated string, and its farthest and nearest start, packed by target; rows come sorted by bucket, negative ones with what was known before."""

    def flush(rows: list[list[bytes]]) -> pa.RecordBatch:
        key, who, back = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate((np.uint64, np.int64, np.int16)))
        order, equals = _runs(key)
        hit = order[(equals > 1) & (who[order] >= 0)]
        return found(*_extent(who[hit], back[hit]))

    def found(ctx: np.ndarray, far: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        target = (mix(ctx.view(np.uint64)) % np.uint64(targets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        cuts = np.searchsorted(target[order], np.arange(targets + 1))
        full = np.flatnonzero(np.diff(cuts))
        packs = [pa.array([x[order][cuts[k] : cuts[k + 1]].astype(t).tobytes() for k in full], pa.binary()) for x, t in ((ctx, np.int64), (far, np.int16), (near, np.int16))]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *packs], names=["target", "ctx", "far", "near"])

    now, held = None, []
    for batch in batches:
        for k, bucket in enumerate(batch.column(0).to_pylist()):
            parts = [batch.column(c)[k].as_py() for c in (1, 2, 3)]
            if bucket < 0:
                yield found(*(np.frombuffer(p, t) for p, t in zip(parts, (np.int64, np.int16, np.int16), strict=True)))
                continue
            if held and bucket != now:
                yield flush(held)
                held = []
            now = bucket
            held.append(parts)
    if held:
        yield flush(held)


def _merge_extents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ctx, far and near of each context with a repeated string; rows come sorted by target, and one target is held at a time."""

    def flush(rows: list[list[bytes]]) -> pa.RecordBatch:
        ctx, far, near = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate((np.int64, np.int16, np.int16)))
        who, most, _ = _extent(ctx, far)
        least = _extent(ctx, near)[2]
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32))], names=["ctx", "far", "near"])

    now, held = None, []
    for batch in batches:
        for k, target in enumerate(batch.column(0).to_pylist()):
            if held and target != now:
                yield flush(held)
                held = []
            now = target
            held.append([batch.column(c)[k].as_py() for c in (1, 2, 3)])
    if held:
        yield flush(held)


def repeated_strings(docs: DataFrame) -> DataFrame:
    """Key and ``note``: pairs (from, to) of bytes that repeated strings cover, as far as each anchor shows."""
    spark = docs.sparkSession
    texts = packed(docs).select(*KEY, "__text")
    schema = f"block long, context long, {KEY[0]} long, {KEY[1]} long, place long"
    suffixes = materialize(texts.mapInArrow(_suffixes, schema), "suffixes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), suffixes.count() // 500_000)
    ranged = suffixes.repartitionByRange(buckets, "block", "context", KEY[0], "place")
    fates = materialize(ranged.mapInArrow(_sort_bucket, schema + ", fate tinyint"), "suffix-fates")
    drop_tables(suffixes)

    # ``docs`` may have several rows for a key; their suffixes are alike, so one row of bytes for each is fetched as often as it was found.
    wanted = fates.where(F.col("fate").bitwiseAND(OPEN | STANDS_IN) > 0).groupBy(*KEY).agg(F.collect_set(F.struct("place", "block", "fate")).alias("wanted"))
    found = texts.join(wanted, join_key(texts, wanted)).select(texts[KEY[0]], texts[KEY[1]], "__text", "wanted")
    contexts = found.mapInArrow(_contexts, f"block long, {KEY[0]} long, {KEY[1]} long, place long, fate tinyint, bytes binary")
    contexts = materialize(contexts.withColumn("ctx", F.monotonically_increasing_id()), "suffix-contexts")

    hot = materialize(contexts.groupBy("block").count().where(F.col("count") > HOT_CONTEXTS), "suffix-hot")
    many = hot.agg(F.sum("count")).first()[0]
    cold = contexts.join(hot, "block", "left_anti") if many else contexts
    spans = cold.drop("ctx").repartition("block").sortWithinPartitions("block").mapInArrow(_compare, f"{KEY[0]} long, {KEY[1]} long, `from` long, `to` long")
    if many:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), many * REACH // BUCKET_STRINGS)
        strings = contexts.join(hot.select("block"), "block", "left_semi").mapInArrow(lambda it: _packed_strings(it, buckets), "bucket int, keys binary, who binary, backs binary")
        targets = max(1, many // TARGET_CONTEXTS)
        found = strings.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _compare_strings(it, targets), "target int, ctx binary, far binary, near binary")
        hit = found.repartition(targets, "target").sortWithinPartitions("target").mapInArrow(_merge_extents, "ctx long, far int, near int")
        hit = hit.join(contexts.select("ctx", *KEY, "place"), "ctx")
        spans = spans.unionByName(hit.select(*KEY, (F.col("place") - F.col("far")).alias("from"), (F.col("place") - F.col("near") + WIDTH).alias("to")))
    whole = fates.where(F.col("fate").bitwiseAND(WHOLE) > 0).select(*KEY, F.greatest(F.col("place") - REACH, F.lit(0)).alias("from"), (F.col("place") + WIDTH).alias("to"))
    notes = spans.unionByName(whole).groupBy(*KEY).agg(F.collect_list(F.struct("from", "to")).alias("note"))
    notes = materialize(notes, "suffix-notes")
    drop_tables(fates, contexts, hot)
    return notes


def drop_repeated_strings(docs: DataFrame) -> DataFrame:
    """``docs`` without the bytes of repeated strings, and n_bytes, n_removed, n_spans, kept_sha256.

    Remaining bytes need not be whole characters: broken ones are replaced in
    the text column, while the checksum is of the bytes themselves.
    """

    def spans_of(text: bytes, note: list) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array([(s["from"], min(s["to"], len(text))) for s in note], np.int64)
        return merge_spans(pairs[:, 0], pairs[:, 1])

    return rewrite(docs, repeated_strings(docs), "array<struct<from:long,to:long>>", spans_of)
