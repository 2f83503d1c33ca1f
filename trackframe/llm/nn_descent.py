"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

The graph holds for each distinct vector its ``K`` nearest found so far.  It
starts from blocks of vectors that random hyperplanes put together, compared
within each block.  Then each iteration joins neighbours of neighbours: a
vector's sampled neighbours and those that have it as neighbour meet and are
compared with each other, and whoever gets closer enters the lists.  Pairs of
old neighbours are not compared again.  It ends when few lists change.

A query is a row of the table, so its own list is where its search starts.  In
each round its nearest unexpanded vectors are expanded along the graph in both
directions; the distances of what they lead to are computed where the vectors
are, and the nearest ``BEAM`` are kept.  It ends when all of every beam is
expanded, however many rounds that takes.

Vectors live in buckets (by hash, about ``BUCKET`` vectors); all that vectors
tell each other is packed by bucket and moved by Spark shuffles, so no task
holds more than a few buckets and nothing passes the driver.  Equal vectors are
one node; a node lists the ids that answers may need (the least ``top + 1``).

Vectors that are null, all zero, of another length than most, or hold null or
non-finite components take no part; nor do rows without an id.  Navigation is in
single precision; answers are ranked by exact double-precision distances.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_tables, materialize
from .textops import mix

K, SAMPLE, TREES, LEAF = 32, 12, 6, 128
#: Descent ends when less than this share of the list entries changed (lists only get better, so it ends).
ENOUGH = 0.002
EXPAND = 48
#: Least width of a beam, and what it gains with each doubling of the table beyond ``WIDE`` vectors.
BEAM, WIDER, WIDE = 200, 100, 20_000
#: Vectors of a block, where all are compared.
BLOCK = 4096
BUCKET = 2048
BLOB = "bucket int, kind string, data binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(ids.view(np.uint64) + np.uint64(99)) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def packed(kind: str, bucket: np.ndarray, **columns: np.ndarray) -> list[tuple]:
    """Rows for a shuffle: the columns' entries by bucket."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[order[s]]), kind, pickle.dumps({k: v[order[s:e]] for k, v in columns.items()}, 5)) for s, e in zip(cuts, [*cuts[1:], len(order)], strict=True)]


def to_arrow(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def unpacked(table: pa.Table) -> dict[str, dict[str, np.ndarray]]:
    """Columns by kind."""
    parts: dict[str, list] = {}
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        parts.setdefault(kind, []).append(pickle.loads(data))
    return {kind: {k: np.concatenate([p[k] for p in rows]) for k in rows[0]} for kind, rows in parts.items()}


def by_bucket(rows: DataFrame, work: Callable[[dict], list[tuple]]) -> DataFrame:
    return rows.groupBy("bucket").applyInArrow(lambda t: to_arrow(work(unpacked(t))), BLOB)


def each_row(rows: DataFrame, work: Callable[[dict], list[tuple]]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from to_arrow(work(unpacked(pa.Table.from_batches([batch.slice(k, 1)])))).to_batches()

    return rows.mapInArrow(run, BLOB)


def within(owner: np.ndarray) -> np.ndarray:
    """Place of each entry in its run of equal owners (sorted)."""
    return np.arange(len(owner)) - np.searchsorted(owner, owner)


def best_lists(n: int, width: int, owner: np.ndarray, other: np.ndarray, dist: np.ndarray, fresh: np.ndarray, came: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``width`` nearest distinct others of each owner and their marks; of repeated entries the one that did not just come counts."""
    order = np.lexsort((fresh if came is None else came, other, owner))
    owner, other, dist, fresh = owner[order], other[order], dist[order], fresh[order]
    once = np.ones(len(owner), bool)
    once[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, dist, fresh = owner[once], other[once], dist[once], fresh[once]
    order = np.lexsort((other, dist, owner))
    owner, other, dist, fresh = owner[order], other[order], dist[order], fresh[order]
    rank = within(owner)
    keep = rank < width
    ids, ds, new = np.full((n, width), -1, np.int64), np.full((n, width), np.inf, np.float32), np.zeros((n, width), bool)
    at = owner[keep], rank[keep]
    ids[at], ds[at], new[at] = other[keep], dist[keep], fresh[keep]
    return ids, ds, new


def sampled(state: dict, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the new and old list entries that take part in an iteration; the same wherever it is asked."""
    chance = mix(state["nb"].view(np.uint64) * np.uint64(31) + mix(state["id"].view(np.uint64) + np.uint64(turn * 7919))[:, None])
    out = []
    for mask in (state["new"] & (state["nb"] >= 0), ~state["new"] & (state["nb"] >= 0)):
        score = np.where(mask, chance >> np.uint64(1), np.uint64(1 << 63))
        place = np.argsort(np.argsort(score, 1, kind="stable"), 1)
        out.append(mask & (place < SAMPLE))
    return out[0], out[1]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2))
    return np.maximum(d, 0, out=d)


class Graph:
    """``state``: a row for each bucket with ids, vectors, lists, distances and marks of new entries."""

    def __init__(self, nodes: DataFrame, dim: int, count: int):
        self.spark, self.buckets, self.dim = nodes.sparkSession, max(1, -(-count // BUCKET)), dim
        buckets = self.buckets

        def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                vec = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                yield from to_arrow(packed("node", bucket_of(ids, buckets), id=ids, vec=vec)).to_batches()

        vectors = nodes.select("node", "vector").mapInArrow(start, BLOB)
        bits = max(0, int(np.ceil(np.log2(max(1, count / LEAF)))))
        planes = np.random.default_rng(42).standard_normal((TREES, bits + 1, dim)).astype(np.float32)

        def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vec = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                for tree in range(TREES):
                    side = vec @ planes[tree].T
                    code = ((side[:, :bits] > 0) * (1 << np.arange(bits))).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(code + (tree << 40)), pa.array(side[:, bits].astype(float)), batch.column(0), batch.column(1)], names=["code", "along", "node", "vector"])

        def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, LEAF):
                    part = batch.slice(at, LEAF)
                    ids = part.column(2).to_numpy()
                    vec = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                    if len(ids) < 2:
                        continue
                    d = _distances(vec, vec)
                    np.fill_diagonal(d, np.inf)
                    k = min(K, len(ids) - 1)
                    near = np.argpartition(d, k - 1, 1)[:, :k]
                    to = np.repeat(ids, k)
                    yield from to_arrow(packed("offer", bucket_of(to, buckets), to=to, other=ids[near].ravel(), dist=np.take_along_axis(d, near, 1).ravel())).to_batches()

        coded = nodes.select("node", "vector").mapInArrow(codes, "code long, along double, node long, vector array<float>")
        offers = coded.repartitionByRange("code", "along", "node").sortWithinPartitions("code", "along", "node").mapInArrow(leaves, BLOB)
        self.state = materialize(by_bucket(vectors.unionByName(offers), self._merge(None)), "nn-graph")

    def _merge(self, turn: int | None) -> Callable[[dict], list[tuple]]:
        """New lists from old ones and offers; ``changed`` counts entries that came in."""

        def work(kinds: dict) -> list[tuple]:
            if "node" not in kinds:
                return []
            s = kinds["node"]
            order = np.argsort(s["id"])
            s = {k: v[order] for k, v in s.items()}
            n = len(s["id"])
            owner = other = np.zeros(0, np.int64)
            dist, fresh = np.zeros(0, np.float32), np.zeros(0, bool)
            if "nb" in s:
                if turn is not None:
                    s["new"] = s["new"] & ~sampled(s, turn)[0]
                row, col = np.nonzero(s["nb"] >= 0)
                owner, other, dist, fresh = row, s["nb"][row, col], s["nd"][row, col], s["new"][row, col]
            if "offer" in kinds:
                o = kinds["offer"]
                owner = np.concatenate([owner, np.searchsorted(s["id"], o["to"])])
                other, dist = np.concatenate([other, o["other"]]), np.concatenate([dist, o["dist"]])
                came = np.concatenate([np.zeros(len(fresh), bool), np.ones(len(o["to"]), bool)])
                fresh = np.concatenate([fresh, np.ones(len(o["to"]), bool)])
            else:
                came = np.zeros(len(fresh), bool)
            ids, ds, new = best_lists(n, K, owner, other, dist, fresh, came)
            before = s.get("nb")
            changed = n * K if "nb" not in s else int((~(ids[:, :, None] == before[:, None, :]).any(2) & (ids >= 0)).sum())
            bucket = int(bucket_of(s["id"][:1], self_buckets)[0])
            return [(bucket, "node", pickle.dumps({"id": s["id"], "vec": s["vec"], "nb": ids, "nd": ds, "new": new, "changed": np.array([changed])}, 5))]

        self_buckets = self.buckets
        return work

    def iterate(self, turn: int) -> float:
        """One round of joins; returns the share of list entries that changed."""
        buckets = self.buckets

        def strip(kinds: dict) -> dict:
            return {k: v for k, v in kinds["node"].items() if k != "changed"}

        def tell(kinds: dict) -> list[tuple]:
            s = strip(kinds)
            new, old = sampled(s, turn)
            row, col = np.nonzero(new | old)
            to = s["nb"][row, col]
            return packed("has", bucket_of(to, buckets), to=to, holder=s["id"][row], fresh=new[row, col])

        def send(kinds: dict) -> list[tuple]:
            """Each vector goes to those that list it and, as a reverse neighbour, to those that it lists."""
            if "node" not in kinds:
                return []
            s = strip(kinds)
            new, old = sampled(s, turn)
            row, col = np.nonzero(new | old)
            target, member, fresh = [s["nb"][row, col]], [row], [new[row, col]]
            back = [np.ones(len(row), bool)]
            if "has" in kinds:
                h = kinds["has"]
                target.append(h["holder"])
                member.append(np.searchsorted(s["id"], h["to"]))
                fresh.append(h["fresh"])
                back.append(np.zeros(len(h["to"]), bool))
            target, member, fresh, back = (np.concatenate(x) for x in (target, member, fresh, back))
            bucket, out = bucket_of(target, buckets), []
            for b in np.unique(bucket).tolist():
                at = bucket == b
                used, index = np.unique(member[at], return_inverse=True)
                out.append((b, "meet", pickle.dumps({"pack": np.array([0]), "target": target[at], "index": index, "fresh": fresh[at], "back": back[at], "id": s["id"][used], "vec": s["vec"][used], "far": s["nd"][used, -1]}, 5)))
            return out

        def join(table: pa.Table) -> pa.Table:
            """All that met at a vector are compared; pairs that are close enough for one of the two are offered to it."""
            parts = [pickle.loads(d) for d in table.column("data").to_pylist()]
            shift = np.cumsum([0, *(len(p["id"]) for p in parts)])
            target = np.concatenate([p["target"] for p in parts])
            index = np.concatenate([p["index"] + k for p, k in zip(parts, shift, strict=False)])
            fresh, back = (np.concatenate([p[k] for p in parts]) for k in ("fresh", "back"))
            ids, vec, far = (np.concatenate([p[k] for p in parts]) for k in ("id", "vec", "far"))
            chance = mix(ids[index].view(np.uint64) ^ target.view(np.uint64))
            group = (fresh.astype(np.int64) << 1) | back
            order = np.lexsort((chance, group, target))
            target, index, group = target[order], index[order], group[order]
            key = np.searchsorted(np.unique(target), target)
            place = within(key * 4 + group)
            keep = place < SAMPLE
            n = int(key[-1]) + 1
            grid = np.full((n, 4 * SAMPLE), -1)
            grid[key[keep], (3 - group[keep]) * SAMPLE + place[keep]] = index[keep]  # fresh ones first
            to, other, dist = [], [], []
            for at in range(0, n, 256):
                every = grid[at : at + 256]
                some = every[:, : 2 * SAMPLE]
                d = _distances(vec[some], vec[every])
                a, b = some[:, :, None], every[:, None, :]
                ok = (a >= 0) & (b >= 0) & (ids[a] != ids[b]) & (d < np.maximum(far[a], far[b]))
                i, j, k = np.nonzero(ok)
                x, y, z = some[i, j], every[i, k], d[i, j, k]
                for p, q in ((x, y), (y, x)):
                    good = z < far[p]
                    to.append(ids[p[good]])
                    other.append(ids[q[good]])
                    dist.append(z[good])
            to, other, dist = (np.concatenate(v) for v in (to, other, dist))
            pair = np.lexsort((other, to))
            to, other, dist = to[pair], other[pair], dist[pair]
            once = np.ones(len(to), bool)
            once[1:] = (to[1:] != to[:-1]) | (other[1:] != other[:-1])
            return to_arrow(packed("offer", bucket_of(to[once], buckets), to=to[once], other=other[once], dist=dist[once]))

        told = each_row(self.state, tell)
        meets = by_bucket_raw(by_bucket(self.state.unionByName(told), send), join)
        plain = each_row(self.state, lambda kinds: [(int(bucket_of(kinds["node"]["id"][:1], buckets)[0]), "node", pickle.dumps(strip(kinds), 5))])
        after = materialize(by_bucket(plain.unionByName(meets), self._merge(turn)), "nn-graph")
        drop_tables(self.state)
        self.state = after
        return self.changed()

    def changed(self) -> float:
        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [pickle.loads(d) for d in batch.column("data").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([int(g["changed"][0]) for g in got], pa.int64()), pa.array([g["nb"].size for g in got], pa.int64())], names=["c", "n"])

        c, n = self.state.mapInArrow(count, "c long, n long").agg(F.sum("c"), F.sum("n")).first()
        return (c or 0) / max(1, n or 0)

    def descend(self) -> "Graph":
        for turn in count():
            if self.iterate(turn) < ENOUGH:
                return self


def by_bucket_raw(rows: DataFrame, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return rows.groupBy("bucket").applyInArrow(work, BLOB)


def beam_width(count: int) -> int:
    return BEAM + round(WIDER * max(0.0, float(np.log2(max(1, count) / WIDE))))


def search(graph: Graph, queries: DataFrame, keep: int, beam_size: int = BEAM) -> DataFrame:
    """(query node, node) of the ``keep`` nearest nodes that greedy search finds for each query node, itself left out."""
    buckets = graph.buckets

    def both_ways(kinds: dict) -> list[tuple]:
        s = kinds["node"]
        row, col = np.nonzero(s["nb"] >= 0)
        to = s["nb"][row, col]
        return packed("from", bucket_of(to, buckets), to=to, other=s["id"][row], dist=s["nd"][row, col])

    def adjacency(kinds: dict) -> list[tuple]:
        if "node" not in kinds:
            return []
        s = {k: v for k, v in kinds["node"].items() if k in ("id", "vec", "nb", "nd")}
        s["rev"] = np.full_like(s["nb"], -1)
        if "from" in kinds:
            f = kinds["from"]
            s["rev"], _, _ = best_lists(len(s["id"]), K, np.searchsorted(s["id"], f["to"]), f["other"], f["dist"], np.zeros(len(f["to"]), bool))
        return [(int(bucket_of(s["id"][:1], buckets)[0]), "node", pickle.dumps(s, 5))]

    linked = materialize(by_bucket(graph.state.unionByName(each_row(graph.state, both_ways)), adjacency), "nn-linked")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield from to_arrow(packed("query", bucket_of(ids, buckets), q=ids)).to_batches()

    def begin(kinds: dict) -> list[tuple]:
        """A query's beam is its own list."""
        if "query" not in kinds:
            return []
        s, q = kinds["node"], np.unique(kinds["query"]["q"])
        at = np.searchsorted(s["id"], q)
        pad = ((0, 0), (0, beam_size - K))
        beam = {"q": q, "vec": s["vec"][at], "ids": np.pad(s["nb"][at], pad, constant_values=-1), "dist": np.pad(s["nd"][at], pad, constant_values=np.inf), "done": np.zeros((len(q), beam_size), bool)}
        return [(int(bucket_of(q[:1], buckets)[0]), "beam", pickle.dumps(beam, 5))]

    beams = materialize(by_bucket(linked.unionByName(queries.mapInArrow(ask, BLOB)), begin), "nn-beams")

    def chosen(beam: dict) -> np.ndarray:
        open_ = ~beam["done"] & (beam["ids"] >= 0)
        return open_ & (np.cumsum(open_, 1) <= EXPAND)

    def with_vectors(kind: str, target: np.ndarray, which: np.ndarray, q: np.ndarray, vec: np.ndarray, far: np.ndarray) -> list[tuple]:
        bucket, out = bucket_of(target, buckets), []
        for b in np.unique(bucket).tolist():
            at = bucket == b
            used, index = np.unique(which[at], return_inverse=True)
            out.append((b, kind, pickle.dumps({"target": target[at], "index": index, "q": q[used], "vec": vec[used], "far": far[used]}, 5)))
        return out

    def expand(kinds: dict) -> list[tuple]:
        beam = kinds["beam"]
        row, col = np.nonzero(chosen(beam))
        return with_vectors("visit", beam["ids"][row, col], row, beam["q"], beam["vec"], beam["dist"][:, -1])

    def gather(table: pa.Table, kind: str) -> tuple[dict | None, dict | None]:
        state, parts = None, []
        for k, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if k == kind:
                parts.append(pickle.loads(data))
            else:
                state = pickle.loads(data)
        if not parts or state is None:
            return state, None
        shift = np.cumsum([0, *(len(p["q"]) for p in parts)])
        out = {k: np.concatenate([p[k] for p in parts]) for k in ("target", "q", "vec", "far")}
        out["index"] = np.concatenate([p["index"] + s for p, s in zip(parts, shift, strict=False)])
        return state, out

    def lead(table: pa.Table) -> pa.Table:
        s, visit = gather(table, "visit")
        if visit is None:
            return to_arrow([])
        at = np.searchsorted(s["id"], visit["target"])
        near = np.concatenate([s["nb"][at], s["rev"][at]], 1)
        row, col = np.nonzero(near >= 0)
        return to_arrow(with_vectors("measure", near[row, col], visit["index"][row], visit["q"], visit["vec"], visit["far"]))

    def measure(table: pa.Table) -> pa.Table:
        s, m = gather(table, "measure")
        if m is None:
            return to_arrow([])
        q, target = m["q"][m["index"]], m["target"]
        order = np.lexsort((target, q))
        once = np.ones(len(order), bool)
        once[1:] = (q[order][1:] != q[order][:-1]) | (target[order][1:] != target[order][:-1])
        pick = order[once]
        pick = pick[q[pick] != target[pick]]
        at, index = np.searchsorted(s["id"], target[pick]), m["index"][pick]
        dist = np.concatenate([((s["vec"][at[k : k + 20_000]] - m["vec"][index[k : k + 20_000]]) ** 2).sum(1) for k in range(0, len(at), 20_000)] or [np.zeros(0, np.float32)])
        good = dist < m["far"][index]
        to = q[pick][good]
        return to_arrow(packed("found", bucket_of(to, buckets), to=to, other=target[pick][good], dist=dist[good]))

    def settle(kinds: dict) -> list[tuple]:
        if "beam" not in kinds:
            return []
        beam = kinds["beam"]
        done = beam["done"] | chosen(beam)
        row, col = np.nonzero(beam["ids"] >= 0)
        owner, other, dist, fresh = row, beam["ids"][row, col], beam["dist"][row, col], ~done[row, col]
        if "found" in kinds:
            f = kinds["found"]
            owner, other = np.concatenate([owner, np.searchsorted(beam["q"], f["to"])]), np.concatenate([other, f["other"]])
            dist, fresh = np.concatenate([dist, f["dist"]]), np.concatenate([fresh, np.ones(len(f["to"]), bool)])
        ids, ds, new = best_lists(len(beam["q"]), beam_size, owner, other, dist, fresh)
        return [(int(bucket_of(beam["q"][:1], buckets)[0]), "beam", pickle.dumps({"q": beam["q"], "vec": beam["vec"], "ids": ids, "dist": ds, "done": ~new}, 5))]

    def unexpanded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(int(((beam["ids"] >= 0) & ~beam["done"]).sum()) for beam in map(pickle.loads, batch.column("data").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    # What has left a beam is too far to come back, so this ends.
    while (beams.mapInArrow(unexpanded, "n long").agg(F.sum("n")).first()[0] or 0) > 0:
        visits = each_row(beams, expand)
        measures = by_bucket_raw(linked.unionByName(visits), lead)
        found = by_bucket_raw(linked.unionByName(measures), measure)
        after = materialize(by_bucket(beams.unionByName(found), settle), "nn-beams")
        drop_tables(beams)
        beams = after

    def answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                beam = pickle.loads(data)
                row, col = np.nonzero(beam["ids"][:, :keep] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(beam["q"][row]), pa.array(beam["ids"][row, col])], names=["query_node", "node"])

    return beams.mapInArrow(answers, "query_node long, node long")


def compared(nodes: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """The same pairs without a graph: blocks of query vectors meet blocks of all vectors, and each keeps its ``keep`` nearest.

    Exact up to single precision; the work is queries times vectors, so it is
    the way for tables where no recall may be lost.
    """
    rows = nodes.select("node", "vector", F.pmod(F.xxhash64("node"), F.lit(max(1, -(-nodes.count() // BLOCK)))).cast("int").alias("block"))
    wanted = rows.join(queries, "node", "left_semi")

    def pack(table: pa.Table) -> pa.Table:
        vectors = np.stack([np.asarray(v, np.float32) for v in table.column("vector").to_pylist()])
        data = pickle.dumps({"id": table.column("node").to_numpy(), "vec": vectors}, 5)
        return pa.table({"data": pa.array([data], pa.binary())})

    few = max(1, -(-wanted.count() // BLOCK))
    blocks = rows.groupBy("block").applyInArrow(pack, "data binary")
    asked = wanted.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(few)).cast("int")).groupBy("block").applyInArrow(pack, "data binary").withColumnRenamed("data", "asked")
    met = blocks.crossJoin(asked)  # a stated query set against all rows, block by block

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, query in zip(batch.column("data").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                s, q = pickle.loads(data), pickle.loads(query)
                dist = (q["vec"] ** 2).sum(1)[:, None] - 2 * (q["vec"] @ s["vec"].T) + (s["vec"] ** 2).sum(1)
                dist[q["id"][:, None] == s["id"]] = np.inf
                best = np.argpartition(dist, min(keep, dist.shape[1]) - 1, 1)[:, :keep]
                far = np.take_along_axis(dist, best, 1)
                row, col = np.nonzero(np.isfinite(far))
                yield pa.RecordBatch.from_arrays([pa.array(q["id"][row]), pa.array(s["id"][best[row, col]]), pa.array(far[row, col].astype(np.float64))], names=["query_node", "node", "dist"])

    from pyspark.sql import Window

    found = met.mapInArrow(near, "query_node long, node long, dist double")
    rank = F.row_number().over(Window.partitionBy("query_node").orderBy("dist", "node"))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep).select("query_node", "node")


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part; see the module's text."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vector") == length[0].d) if length else rows


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, top: int = 10, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found for each row whose id is divisible by ``every``; with ``exact`` all rows are compared."""
    rows = materialize(usable(table, id_col, vector_col), "nn-rows")
    dim = rows.select(F.size("vector").alias("d")).first()
    members = F.slice(F.array_sort(F.collect_set("id")), 1, top + 1)
    # collect_set of ids of equal vectors is trimmed by blocks first, so that no list grows beyond (top + 1) times the blocks.
    first = rows.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(members.alias("ids"))
    nodes = first.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top + 1).alias("ids"))
    nodes = materialize(nodes.select(F.element_at("ids", 1).alias("first"), "ids", "vector"), "nn-nodes")
    nodes = nodes.withColumn("node", F.abs(F.xxhash64("vector") % F.lit(1 << 62)))
    schema = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return rows.sparkSession.createDataFrame([], schema)
    single = nodes.select("node", F.col("vector").cast("array<float>").alias("vector"))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.abs(F.xxhash64("vector") % F.lit(1 << 62)).alias("query_node")).distinct()
    asked, size = queries.select(F.col("query_node").alias("node")).distinct(), nodes.count()
    found = compared(single, asked, 4 * top) if exact else search(Graph(single, dim.d, size).descend(), asked, 4 * top, beam_width(size))
    pairs = found.union(queries.select("query_node", F.col("query_node").alias("node"))).distinct()
    near = queries.join(pairs, "query_node").join(nodes.select("node", "vector", "ids"), "node")
    gap = F.zip_with("query", "vector", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    scored = near.select("query_id", F.explode("ids").alias("vec_id"), F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)).alias("score")).where("vec_id != query_id")
    from pyspark.sql import Window

    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
