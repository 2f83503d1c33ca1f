"""Mixing sources to target weights by balanced sampling.

Every document of a source gets the same expected multiplicity target / size of
source (at most the ceiling).  Its whole part is taken outright; its fractional
part p is an inclusion probability that the cube method turns into 0 or 1 while
the balancing totals hold: number of documents and their sizes.

The flight phase takes three undecided documents at a time and moves their
probabilities along the null space of the two balancing rows until one of them
reaches 0 or 1; both directions have the chance that keeps expectations.  Blocks
of bounded size are flown by separate tasks; at most two documents of a block
and a few reserved ones stay undecided and meet in the next round's blocks,
until one block of the source is left.  Large documents fly first, so that those
left are small.  In a source's own last block, the last two and a few reserved
documents are landed: of all their 0/1 choices the one whose sizes miss the
least is taken.  How many rounds one source needs changes nothing for another.

Randomness is a hash of the document id, so reruns agree.  Null text has size 0;
null source is a source of its own and sorts last.  Rows with the same id are
separate documents.  A source without words has target 0 and takes nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import WHOLE, quoted, unpacked
from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one task flies.
BLOCK = 2_000
#: Documents of a block that take no part in its flight, so that the next round and landing have choices.
RESERVE = 16
#: Blocks that meet in one block of the next round, with two undecided and the reserved documents each.
MERGED = BLOCK // (2 + RESERVE)


def targets(sizes: dict, weights: dict, ceiling: float = 3.0) -> dict:
    """Words that each source gives: the total shared by weight, none above ``ceiling`` times its size."""
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        weight = sum(weights[s] for s in free)
        left = total - sum(fixed.values())
        over = [s for s in free if left * weights[s] / weight > ceiling * sizes[s]] if weight else []
        if not over:
            return fixed | {s: left * weights[s] / weight for s in free}
        fixed |= {s: ceiling * sizes[s] for s in over}


def fly(p: np.ndarray, size: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Probabilities after the flight phase: all 0 or 1 but two at most.

    Balancing rows are (1, size); the null vector of three documents i, j, k is
    (size_j - size_k, size_k - size_i, size_i - size_j).  Equal sizes leave a
    larger null space, of which (1, -1, 0) is used.
    """
    p = p.astype(float).copy()
    hold: list[int] = []
    values, sizes, draws = p.tolist(), size.tolist(), noise.tolist()
    for new in range(len(values)):
        hold.append(new)
        while len(hold) == 3 or (len(hold) == 2 and sizes[hold[0]] == sizes[hold[1]]):
            if len(hold) == 2:
                ids, u = hold, (1.0, -1.0)
            else:
                i, j, k = hold
                a, b, c = sizes[i], sizes[j], sizes[k]
                ids, u = (hold, (b - c, c - a, a - b)) if not a == b == c else (hold[:2], (1.0, -1.0))
            up = min(((1 - values[x]) if v > 0 else values[x]) / abs(v) for x, v in zip(ids, u) if v)
            down = min((values[x] if v > 0 else 1 - values[x]) / abs(v) for x, v in zip(ids, u) if v)
            step = up if draws[new] * (up + down) < down else -down
            for x, v in zip(ids, u):
                values[x] += step * v
                if values[x] < 1e-9:
                    values[x] = 0.0
                elif values[x] > 1 - 1e-9:
                    values[x] = 1.0
            hold = [x for x in hold if 0 < values[x] < 1]
    return np.array(values)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """0/1 choice for the few undecided whose sizes come closest to their expectation; ties take fewer documents.

    The flight keeps expected totals exactly, so this is all the imbalance that a source gets.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    choices = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    miss = np.abs(choices @ size[open_] - float(p[open_] @ size[open_]))
    out = p.copy()
    out[open_] = choices[np.lexsort((choices.sum(1), miss.round(6)))[0]]
    return out


def fly_reserved(p: np.ndarray, size: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """A block, sizes descending: RESERVE documents stay out of the flight.

    They are of about half, a quarter, ... of the largest size, as the largest
    is often undecided to the end and landing has to make up for it; if there
    are fewer such, smaller ones at even distances are added.
    """
    halves = size[0] / 2.0 ** np.arange(1, RESERVE + 1)
    kept = np.unique(np.minimum(np.searchsorted(-size, -halves), len(p) - 1))
    low = np.setdiff1d(np.arange(len(p) // 3, len(p)), kept)
    kept = np.union1d(kept, low[np.unique(np.linspace(0, len(low) - 1, min(RESERVE - len(kept), len(low))).astype(int))])
    flown = np.delete(np.arange(len(p)), kept)
    out = p.astype(float).copy()
    out[flown] = fly(p[flown], size[flown], noise[flown])
    return out


def fly_and_land(p: np.ndarray, size: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The last block of a source: the reserved documents land with the last two."""
    return land(fly_reserved(p, size, noise), size)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), ceiling: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the ``keep`` columns of each document.

    Sources in code point order get ``weights`` in turn.  Collected is one row
    for each source; a flight task holds one block of ids and sizes.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "source", *keep, F.xxhash64("doc_id", "source", "text").alias("_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "mix-base")
    rows = base.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()  # one for each source
    order = sorted((r.source for r in rows), key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    size = {r.source: r.s for r in rows}
    goal = targets(size, weight, ceiling)
    if not rows:
        return base.select("doc_id", "source", *keep, "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("copies"), F.col("size").alias("taken"))
    facts = [(s, size[s], goal[s], int(np.floor(goal[s] / size[s] + 1e-12)) if size[s] else 0, goal[s] / size[s] if size[s] else 0.0) for s in order]
    facts = [(s, a, t, w, max(0.0, r - w), max(1, -(-n // BLOCK))) for (s, a, t, w, r), n in zip(facts, [{r.source: r.n for r in rows}[s] for s in order])]
    plan = spark.createDataFrame(facts, "source string, source_size long, target double, whole long, part double, blocks long")
    base = base.join(F.broadcast(plan), base.source.eqNullSafe(plan.source)).drop(plan.source)

    undecided = base.where("part > 0 and size > 0").select("_row", "_hash", "source", "size", "blocks", F.col("part").alias("p"))
    settled, most = [], max(f[5] for f in facts)
    schema = "_row long, _hash long, source string, size long, blocks long, p double"

    def flight(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "_hash", "_row"], ascending=[False, True, True])
        sizes, draws = pdf["size"].to_numpy(float), (pdf["_hash"] // 4096 % 1_000_003).to_numpy() / 1_000_003
        last = pdf["blocks"].iloc[0] == 1  # of this source; it leaves the loop
        after = (fly_and_land if last else fly_reserved)(pdf["p"].to_numpy(float), sizes, draws)
        return pdf.drop(columns="_block").assign(p=after, blocks=-(-pdf["blocks"] // MERGED))

    while True:
        keyed = undecided.withColumn("_block", F.pmod("_hash", "blocks"))
        flown = materialize(keyed.groupBy("source", "_block").applyInPandas(flight, schema), "mix-flight")
        settled.append(flown.where("p = 1").select("_row"))
        if most <= 1:
            break
        undecided, most = flown.where("p > 0 and p < 1"), -(-most // MERGED)
    chosen = settled[0]
    for more in settled[1:]:
        chosen = chosen.unionByName(more)
    chosen = chosen.withColumn("_more", F.lit(1))
    copies = (F.col("whole") + F.coalesce("_more", F.lit(0))).cast("long")
    return base.join(chosen, "_row", "left").select("doc_id", "source", *keep, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_repeated(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), ceiling: float = 3.0) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``; a document taken k times appears k times."""
    packed = docs.select("doc_id", "source", "text", F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(WHOLE))
    mixed = mix_sources(packed, weights, ceiling, keep=(WHOLE,)).where("copies > 0")
    return unpacked(mixed.select(WHOLE, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
