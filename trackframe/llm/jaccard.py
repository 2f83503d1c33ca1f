"""Exact Jaccard self-join of word-shingle sets, by universe-partition pigeonhole.

Two sets of similarity t or more differ in at most d tokens.  Sizes are cut into
bands so that partners lie in one band or two neighbouring ones; for each two
neighbouring bands the universe of shingles is hashed into segments, and a set's
part in a segment (a segment subset) is hashed to a signature.  A segment that
may hide ``tau`` differences takes ``tau + 1`` of the budget; if the segments
take more than d together, one of them differs in at most ``tau`` tokens.  A
segment of tau 0 indexes its subset; one of tau 1 also all subsets with one
token deleted.  How many segments there are of each kind is chosen by cost.

Empty segments prove little and are not indexed; a set with so many of them
that its budget fails (a thin set) indexes them too.  A pair can be missed only
if both sets are thin, and then both have indexed them.

Sets are collapsed by equality first.  Signatures travel packed by bucket; a task
holds one bucket at a time and finds the groups that share a signature; a bucket
that a very common signature fills is counted by Spark instead.  Pairs of a group are first held
against an exact lower bound (parity sketches differ by no more than the sets
do), then verified exactly on whole sets.  Groups are not expanded into pairs:
each set first proposes its least-bound partners and the group's first member;
components form; only pairs of different components are looked at again, first
each set's nearest in every group, then all.

Null or wordless texts have no set.  Repeated rows are one node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .skew import SALT, copied, dealt, hot_keys
from .spans import KEY, WHOLE, join_key, packed, unpacked
from .storage import drop_tables, materialize
from .textops import Texts, mix, prefix_hash, shingle_hashes, slices, span_hash

#: Cells of a parity sketch for each segment.
SKETCH = 16
#: Members of a group that a task compares at once; larger groups are cut into blocks and pairs of blocks.
GROUP_BLOCK = 1500
#: Partners that a set proposes in the first round (the last looks at all that may still matter).
PROPOSALS = 2
#: Signatures that a task packs at a time.
PACKED = 1_000_000
#: Words of sets for each bucket of signatures.
BUCKET_WORDS = 500_000
#: Signatures of one bucket that a task compares in memory; a fuller bucket (some signature is very common) is counted by Spark.
HELD_SIGNATURES = 4_000_000


def most_different(total: int, percent: int) -> int:
    """Largest symmetric difference of two sets with ``total`` tokens together and similarity ``percent`` or more."""
    return total - 2 * (-(-percent * total // (100 + percent)))


@dataclass(frozen=True)
class Scheme:
    """Segments of two neighbouring size bands: the first ``ones`` of ``segments`` have tau 1."""

    number: int
    low: int
    top: int
    segments: int
    ones: int


def allocate(low: int, top: int, percent: int) -> tuple[int, int]:
    """Segments and how many of them have tau 1, by least cost.

    Cost is the number of signatures plus a charge for segments that are likely
    to hold at most one token, as these collide with unrelated sets.
    """
    need = max(most_different(s, percent) for s in range(max(2, 2 * top - 6), 2 * top + 1)) + 1
    if need <= 1:
        return 0, 0  # only equal sets qualify
    best = None
    for ones in {0, need // 4, need // 2}:
        segments = ones + max(0, ceil(1.15 * (need - 2 * ones))) + (2 if ones < need // 2 else 1)
        load = low / segments
        cost = segments + ones * load + 8 * segments * exp(-load) * (1 + load)
        if best is None or cost < best[0]:
            best = (cost, segments, ones)
    return best[1], best[2]


@lru_cache(maxsize=8)
def bands(percent: int, most: int = 1 << 34) -> tuple[np.ndarray, tuple[Scheme, ...]]:
    """Lower ends of the size bands, and the scheme of each band with its next."""
    ends = [1]
    while ends[-1] < most:
        ends.append(ends[-1] * 100 // percent + 1)
    ends += [ends[-1] * 100 // percent + 1]
    schemes = tuple(Scheme(k, ends[k], ends[k + 2] - 1, *allocate(ends[k], ends[k + 2] - 1, percent)) for k in range(len(ends) - 2))
    return np.array(ends), schemes


class Sets:
    """Shingle sets of some texts: ``token`` values by text in ascending order, ``first`` index of each text."""

    def __init__(self, texts: Texts, width: int):
        texts = texts.lowered()
        start, end, first = texts.words()
        word = span_hash(prefix_hash(texts.buf), start, end)
        n = np.diff(first)
        grams = shingle_hashes(word, width)
        doc = np.repeat(np.arange(texts.n), n)
        inside = np.flatnonzero(doc[: len(grams)] == doc[len(doc) - len(grams) :]) if len(grams) else np.zeros(0, int)
        token, owner = [grams[inside]], [doc[inside]]
        for length in range(1, width):
            short = np.flatnonzero(n == length)
            if len(short):
                value = np.zeros(len(short), np.uint64)
                for k in range(length):
                    value = mix(value + word[first[short] + k] + np.uint64(length))
                token.append(value)
                owner.append(short)
        token, owner = np.concatenate(token), np.concatenate(owner)
        order = np.lexsort((token, owner))
        token, owner = token[order], owner[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        self.token, self.owner = token[keep], owner[keep]
        self.size = np.bincount(self.owner, minlength=texts.n)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = np.zeros(len(self.token) + 1, np.uint64)
        np.cumsum(mix(self.token + np.uint64(1)), out=total[1:])
        self.node = mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64))


def signatures(sets: Sets, docs: np.ndarray, scheme: Scheme, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of some sets under a scheme, and the text that each belongs to."""
    m, ones = scheme.segments, scheme.ones
    n = sets.size[docs]
    row = np.repeat(np.arange(len(docs)), n)
    at = np.repeat(sets.first[docs] - (np.cumsum(n) - n), n) + np.arange(len(row))
    token = sets.token[at]
    segment = ((token >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    cell = row * m + segment
    weight = mix(token * np.uint64(3) + np.uint64(scheme.number))
    order = np.argsort(cell, kind="stable")
    cell, weight = cell[order], weight[order]
    sizes = np.bincount(cell, minlength=len(docs) * m)
    filled = np.flatnonzero(sizes)
    total = np.zeros(len(docs) * m, np.uint64)
    if len(cell):
        total[filled] = np.add.reduceat(weight, np.searchsorted(cell, filled))
    tag = mix(np.arange(m, dtype=np.uint64) + np.uint64(scheme.number * 1_000_003 + 1))

    def sign(cells: np.ndarray, sums: np.ndarray, count: np.ndarray) -> np.ndarray:
        return mix(sums + tag[cells % m] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    grid = sizes.reshape(len(docs), m)
    budget = (grid > 0).sum(1) + (grid[:, :ones] > 1).sum(1)
    partner = np.minimum(n * 100 // percent, scheme.top)
    allowed = np.max([(n + partner - k) - 2 * (-(-percent * (n + partner - k) // (100 + percent))) for k in range(4)], axis=0)
    thin = budget <= allowed
    out, owner = [sign(filled, total[filled], sizes[filled])], [filled // m]
    if ones:
        single = np.flatnonzero((cell % m < ones) & ((sizes[cell] > 1) | thin[cell // m]))
        out.append(sign(cell[single], total[cell[single]] - weight[single], sizes[cell[single]] - 1))
        owner.append(cell[single] // m)
    empty = np.flatnonzero((grid == 0).ravel() & np.repeat(thin, m))
    out.append(sign(empty, np.zeros(len(empty), np.uint64), np.zeros(len(empty), int)))
    owner.append(empty // m)
    return np.concatenate(out), docs[np.concatenate(owner)]


def sketches(sets: Sets, docs: np.ndarray, scheme: Scheme) -> np.ndarray:
    """For each set the parity of its tokens in ``SKETCH`` cells a segment, as packed bits.

    A token in one set only flips one bit, so two sketches differ in at most as
    many bits as the sets differ in tokens.
    """
    cells = SKETCH * scheme.segments
    out = np.empty((len(docs), cells // 8), np.uint8)
    for k, d in enumerate(docs.tolist()):
        token = sets.token[sets.first[d] : sets.first[d + 1]]
        cell = ((token & np.uint64(0xFFFFFFFF)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
        out[k] = np.packbits((np.bincount(cell, minlength=cells) & 1).astype(bool))
    return out


def _by_scheme(sets: Sets, docs: np.ndarray, percent: int) -> Iterator[tuple[Scheme, np.ndarray]]:
    """Each scheme that has something to find, with those of ``docs`` that it concerns."""
    ends, schemes = bands(percent)
    band = np.searchsorted(ends, sets.size[docs], "right") - 1
    for k in np.unique(band).tolist():
        for number in (k - 1, k):
            if number >= 0 and schemes[number].segments:
                yield schemes[number], docs[band == k]


def _nodes(batches: Iterable[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Key, set size, node and, for its lower and upper scheme, the number and the parity sketch."""
    for batch in batches:
        for a, b, texts in slices(batch.column(2)):
            sets = Sets(texts, width)
            low: list = [None] * texts.n
            high: list = [None] * texts.n
            for scheme, docs in _by_scheme(sets, np.flatnonzero(sets.size), percent):
                upper = bands(percent)[0][scheme.number + 1] > sets.size[docs]
                for d, up, bits in zip(docs.tolist(), upper.tolist(), sketches(sets, docs, scheme), strict=True):
                    (high if up else low)[d] = (scheme.number, bits.tobytes())
            take = lambda x, k: [None if v is None else v[k] for v in x]
            some = pa.array(sets.size == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sets.size.astype(np.int64)), pa.compute.if_else(some, pa.scalar(None, pa.int64()), pa.array(sets.node.view(np.int64)))]
                + [pa.array(take(x, k), t) for x in (low, high) for k, t in ((0, pa.int32()), (1, pa.binary()))],
                names=[*KEY, "n", "node", "low", "low_bits", "high", "high_bits"],
            )


def _packed_signatures(batches: Iterable[pa.RecordBatch], width: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Signatures with their scheme and node, packed by bucket; a task packs many texts at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        value, node, scheme = (np.concatenate([h[k] for h in held]) for k in range(3))
        bucket = (value >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cuts))
        columns = []
        for x in (value, node, scheme):
            x = x[order]
            columns.append(pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *columns], names=["bucket", "signatures", "nodes", "schemes"])

    size = 0
    for batch in batches:
        for _, _, texts in slices(batch.column(2)):
            sets = Sets(texts, width)
            docs = np.flatnonzero(sets.size)
            docs = docs[np.unique(sets.node[docs], return_index=True)[1]]
            for scheme, some in _by_scheme(sets, docs, percent):
                value, owner = signatures(sets, some, scheme, percent)
                held.append((value, sets.node[owner], np.full(len(value), scheme.number, np.uint16)))
                size += len(value)
            if size > PACKED:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _distinct(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, node and scheme of packed rows, sorted and without repetitions."""
    value, node, scheme = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate((np.uint64, np.uint64, np.uint16)))
    order = np.lexsort((node, value))
    value, node, scheme = value[order], node[order], scheme[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (node[1:] != node[:-1])])
    return value[new], node[new], scheme[new]


def _group_batch(group: np.ndarray, scheme: np.ndarray, node: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(scheme.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(members)], names=["group", "scheme", "node", "members"])


def _bucket_groups(rows: list[list[bytes]]) -> pa.RecordBatch | None:
    """Distinct groups of one whole bucket: nodes that share a signature; the name of a group is a hash of its nodes."""
    value, node, scheme = _distinct(rows)
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.append(start, len(value)))
    name = mix(np.add.reduceat(mix(node), start) + size.astype(np.uint64) + scheme[start].astype(np.uint64))
    many = np.flatnonzero(size > 1)
    many = many[np.unique(name[many], return_index=True)[1]]
    if not len(many):
        return None
    at = np.repeat(start[many] - (np.cumsum(size[many]) - size[many]), size[many]) + np.arange(size[many].sum())
    return _group_batch(np.repeat(name[many], size[many]), scheme[at], node[at], np.repeat(size[many], size[many]))


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, scheme, node, members) of each bucket; rows come sorted by bucket and one bucket is held at a time.

    A bucket of more than ``HELD_SIGNATURES`` comes out as it is, in distinct
    rows (signature, scheme, node, 0).
    """
    at, held, size, over = None, [], 0, False

    def flush() -> Iterator[pa.RecordBatch]:
        if over:
            value, node, scheme = _distinct(held)
            yield _group_batch(value, scheme, node, np.zeros(len(value), np.int64))
        else:
            found = _bucket_groups(held)
            if found is not None:
                yield found

    for batch in batches:
        for k, bucket in enumerate(batch.column(0).to_pylist()):
            if held and bucket != at:
                yield from flush()
                held, size = [], 0
            if bucket != at:
                at, over = bucket, False
            held.append([batch.column(c)[k].as_py() for c in (1, 2, 3)])
            size += len(held[-1][2]) // 2
            if size > HELD_SIGNATURES:
                over = True
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _pairs(batches: Iterable[pa.RecordBatch], percent: int, proposals: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of each block (rows sorted by it) whose bound allows a link and whose components differ.

    With ``proposals``, only the least-bound partners of each member and the first member.
    """

    def block_pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, n, part, half = (rows.column(k).to_numpy() for k in (1, 2, 3, 5))
        sizes = rows.column(4).to_pylist()
        order = np.argsort(node)
        node, n, part, half = node[order], n[order], part[order], half[order]
        bits = np.frombuffer(b"".join([sizes[k] for k in order]), np.uint8).reshape(len(order), -1)
        words = np.zeros((len(order), -(-bits.shape[1] // 8) * 8), np.uint8)
        words[:, : bits.shape[1]] = bits
        words = words.view(np.uint64)
        a, b = [], []
        for i in range(len(node) - 1):
            rest = slice(i + 1, len(node))
            both = n[i] + n[rest]
            ok = (part[rest] != part[i]) & (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest]))
            if half.any():
                ok &= half[rest] != half[i]
            if not ok.any():
                continue
            bound = np.bitwise_count(words[rest] ^ words[i]).sum(1, dtype=np.int64)
            ok &= bound <= both - 2 * (-(-percent * both // (100 + percent)))
            hit = np.flatnonzero(ok)
            if proposals is not None and i and len(hit) > proposals:
                hit = hit[np.argsort(bound[hit], kind="stable")[:proposals]]
            a.append(np.full(len(hit), node[i]))
            b.append(node[hit + i + 1])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        block = rows.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        found = [block_pairs(rows.slice(s, e - s)) for s, e in zip(cuts, cuts[1:], strict=False)]
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    held, rows_held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows_held += batch.num_rows
        if rows_held >= 20_000:
            rows = pa.Table.from_batches(held)
            block = rows.column(0).to_numpy()
            cut = int(np.flatnonzero(block != block[-1])[-1] + 1) if (block != block[-1]).any() else 0
            if cut:
                yield from flush(rows.slice(0, cut))
                held, rows_held = rows.slice(cut).to_batches(), len(rows) - cut
    if rows_held:
        yield from flush(pa.Table.from_batches(held))


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in slices(batch.column(1)):
            sets = Sets(texts, width)
            values = pa.ListArray.from_arrays(pa.array(sets.first.astype(np.int32)), pa.array(sets.token.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), values], names=["node", "tokens"])


class JaccardJoin:
    """The join of one table of documents; ``links`` holds verified pairs that connect all components."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.texts = packed(docs).select(*KEY, "__text")
        schema = f"{KEY[0]} long, {KEY[1]} long, n long, node long, low int, low_bits binary, high int, high_bits binary"
        self.nodes = materialize(self.texts.mapInArrow(lambda it: _nodes(it, width, percent), schema), "jaccard-nodes")

    def groups(self) -> DataFrame:
        words = self.nodes.agg(F.sum("n")).first()[0] or 0
        buckets = 4 * max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), words // (4 * BUCKET_WORDS))
        width, percent = self.width, self.percent
        signed = self.texts.mapInArrow(lambda it: _packed_signatures(it, width, percent, buckets), "bucket int, signatures binary, nodes binary, schemes binary")
        ordered = signed.repartition(buckets // 4, "bucket").sortWithinPartitions("bucket")
        found = materialize(ordered.mapInArrow(_groups, "`group` long, scheme int, node long, members long"), "jaccard-buckets")
        named = found.where("members > 0")
        raw = found.where("members = 0").select(F.col("group").alias("signature"), "scheme", "node").dropDuplicates(["signature", "node"])
        if not raw.isEmpty():
            per = raw.groupBy("signature", "scheme").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("nodes")).where("members > 1")
            per = per.select("signature", F.xxhash64("nodes", "members", "scheme").alias("group"), "members")
            named = named.unionByName(raw.join(per, "signature").select("group", "scheme", "node", "members"))
        groups = materialize(named.dropDuplicates(["group", "node"]), "jaccard-groups")
        drop_tables(found)
        return groups

    def candidates(self, groups: DataFrame, proposals: int | None) -> DataFrame:
        """Pairs (a, b) worth verifying; ``groups`` has ``part``: pairs of one part are known to be connected."""
        once = self.nodes.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.first("low_bits").alias("low_bits"), F.first("high_bits").alias("high_bits"))
        rows = groups.join(once, "node").withColumn("sizes", F.when(F.col("scheme") == F.col("low"), F.col("low_bits")).otherwise(F.col("high_bits")))
        blocks = F.ceil(F.col("members") / GROUP_BLOCK)
        mine = F.pmod(F.xxhash64("node"), blocks)
        if proposals is None:
            # Every two blocks of a large group meet in one task; a block by itself in the task of (block, block).
            rows = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            block = F.xxhash64("group", F.least("_mine", "_other"), F.greatest("_mine", "_other"))
            half = F.when(F.col("_mine") == F.col("_other"), 0).otherwise(F.when(F.col("_mine") < F.col("_other"), 1).otherwise(2))
        else:
            block, half = F.xxhash64("group", mine), F.lit(0)
        rows = rows.select(block.alias("block"), "node", "n", "part", "sizes", half.cast("int").alias("half"))
        percent = self.percent
        return rows.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _pairs(it, percent, proposals), "a long, b long").distinct()

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose whole sets are similar enough, as a written table."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        one = self.nodes.where("node is not null").groupBy("node").agg(F.min(F.struct(*KEY)).alias("k")).join(ends, "node")
        one = one.select("node", *(F.col(f"k.{c}").alias(c) for c in KEY))
        width = self.width
        text = self.texts.join(one, join_key(self.texts, one)).select("node", "__text")
        sets = materialize(text.mapInArrow(lambda it: _sets(it, width), "node long, tokens array<long>").dropDuplicates(["node"]), "jaccard-sets")
        left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("both"))
        links = materialize(joined.where(100 * F.col("common") >= self.percent * (F.col("both") - F.col("common"))).select("a", "b"), "jaccard-links")
        drop_tables(sets)
        return links

    def node_components(self) -> DataFrame:
        """``node, component`` of the nodes that have a link."""
        groups = self.groups()
        pairs = links = parts = None
        # First a few groups of each node, only to connect most of what belongs together; at last all pairs
        # across components in all groups that still span several.
        for proposals, few in ((PROPOSALS, 1), (1, 2), (1, 6), (None, None)):
            if parts is None:
                marked = groups.withColumn("part", F.col("node"))
            else:
                marked = groups.join(parts, "node", "left").select("group", "scheme", "node", "members", F.coalesce("component", "node").alias("part"))
                mixed = marked.groupBy("group").agg((F.min("part") != F.max("part")).alias("open")).where("open").select("group")
                marked = marked.join(mixed, "group", "left_semi")
            if few:
                order = Window.partitionBy("node").orderBy(F.desc("members"), "group")
                marked = marked.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= few).drop("_k")
            rest = self.candidates(marked, proposals)
            rest = materialize(rest if pairs is None else rest.join(pairs, ["a", "b"], "left_anti"), "jaccard-pairs")
            pairs = rest if pairs is None else pairs.unionByName(rest)
            if parts is None or not rest.isEmpty():
                more = self.verify(rest)
                if links is None or not more.isEmpty():
                    links = more if links is None else links.unionByName(more)
                    if parts is not None:
                        drop_tables(parts)
                    parts = components(links)
        drop_tables(groups, pairs, links)
        return parts


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (least id that links reach, its own included) of every document.

    Rows without an id get the null component unless they link to one with an id.
    """
    join = JaccardJoin(docs, width, percent)
    parts = join.node_components()
    # Documents to sets, sets to components and back; one set or one component may hold much of the table.
    per = join.nodes.where("node is not null").groupBy("node").agg(F.min(KEY[0]).alias("least"), F.count("*").alias("count"))
    per = materialize(per.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "jaccard-sets-of")
    of_part = materialize(per.groupBy("part").agg(F.min("least").alias("least"), F.count("*").alias("count")), "jaccard-parts")
    hot = hot_keys(of_part, ["part"], per.count())
    of_node = dealt(per.select("node", "part"), hot, ["part"], ["node"]).join(copied(of_part.select("part", "least"), hot, ["part"]), ["part", SALT]).select("node", "least")
    hot = hot_keys(per, ["node"], join.nodes.count())
    with_set = dealt(join.nodes.where("node is not null").select(*KEY, "n", "node"), hot, ["node"], list(KEY)).join(copied(of_node, hot, ["node"]), ["node", SALT])
    out = with_set.select(*KEY, "n", "least").unionByName(join.nodes.where("node is null").select(*KEY, "n", F.lit(None).cast("long").alias("least")))
    out = materialize(out.select(F.col(KEY[0]).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", KEY[0]).alias("component_id")), "jaccard-components")
    drop_tables(join.nodes, parts, per, of_part)
    return out


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near-duplicates: of each component the document with the least id stays (null ids last).

    Of several rows with that id one stays: the first by text hash.  Documents without a set all stay.
    Repeated rows count once.
    """
    join = JaccardJoin(docs, width, percent)
    parts = join.node_components()
    labelled = join.nodes.where("node is not null").join(parts, "node", "left").select(*KEY, F.coalesce("component", "node").alias("part"))
    first = labelled.groupBy("part").agg(F.min(F.struct(F.col(KEY[0]).isNull(), KEY[0], KEY[1])).alias("k"))
    first = first.select(*(F.col(f"k.{c}").alias(c) for c in KEY)).union(join.nodes.where("node is null").select(*KEY).distinct())
    first = materialize(first, "jaccard-first")
    drop_tables(join.nodes, parts)
    left = packed(docs).select(*KEY, WHOLE)
    kept = left.join(first, join_key(left, first), "left_semi")
    return unpacked(kept.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))).where("__n = 1"))
