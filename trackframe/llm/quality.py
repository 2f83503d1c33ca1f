"""Quality rules with risk-controlled cutoffs.

Base counts are exact per text.  On top of a fixed base rule the method picks
one of several levels from labelled documents.  A level sets a cutoff for each
of several signals, and levels run from lenient to strict, so what one rejects
the next rejects as well.  In each stratum (language) the levels are tried in
this order: a level passes when an exact binomial (Clopper-Pearson) upper bound
on the share of good documents that it rejects stays below the allowed risk.
Trying stops at the first level that fails (fixed-sequence testing), so a
stratum spends its error once; Bonferroni over strata bounds the chance that any
chosen level breaks its promise.  With a risk of 0.05 and four strata at 0.05
together, 86 good labelled documents are enough if none of them is rejected.
Strata with fewer get no cutoff.

The grids are fixed before any label is seen, so all labelled documents serve as
holdout.  Of the levels that pass, the one is taken whose share of rejected bad
documents exceeds that of good ones the most (the most lenient on ties); if none
rejects a larger share of bad ones, the stratum gets no cutoff.

Null text: all counts 0 and ``base_failed``.  Null language is a stratum of its
own.  Labels with null id or quality are left out; repeated labels of a
document count once (good only if all say so).  Repeated rows of a labelled
document are one trial in a stratum, rejected when any of them is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from math import exp, lgamma, log, log1p
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textops import SPACE, Texts, mix, prefix_hash, shingle_hashes, slices, span_hash

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Signal:
    """A ratio of base counts; a document is rejected when it is above the cutoff of the level."""

    name: str
    formula: str
    grid: tuple[float, ...]


def _grid(low: float, high: float, steps: int = 16) -> tuple[float, ...]:
    return tuple(round(float(x), 6) for x in np.geomspace(high, low, steps))


#: Cutoffs run from lenient to strict, one for each level.  The strictest ones still leave ordinary prose alone.
SIGNALS = (
    Signal("symbol_share", "n_symbols / greatest(word_chars, 1)", _grid(0.02, 0.5)),
    Signal("dup_line_share", "n_dup_lines / greatest(n_dup_lines + 1, n_words / 8)", _grid(0.1, 0.9)),
    Signal("repeat_word_share", "n_repeat_words / greatest(n_words, 1)", _grid(0.05, 0.2)),
    Signal("long_word", "word_chars / greatest(n_words, 1)", _grid(12.0, 60.0)),
    Signal("short_word", "1 / greatest(word_chars / greatest(n_words, 1), 0.1)", _grid(0.4, 1.0)),
)


def text_counts(texts: Texts) -> dict[str, np.ndarray]:
    """Base counts of each text; see :func:`base_counts`."""
    buf, offs = texts.buf, texts.offs
    start, end, first = texts.words()
    n = np.diff(first)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    prefix = prefix_hash(buf)
    doc = np.repeat(np.arange(texts.n), n)
    out = {"n_words": n, "word_chars": total(~SPACE[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": total(SYMBOL[buf])}

    cut = np.flatnonzero(buf == 10)
    begins = np.unique(np.concatenate([offs[:-1], cut + 1]))
    begins = begins[begins < len(buf)]
    owner = np.searchsorted(offs, begins, "right") - 1
    ends = np.minimum(np.concatenate([begins[1:], [len(buf)]]), offs[owner + 1])
    ends = ends - ((ends > begins) & (buf[np.maximum(ends - 1, 0)] == 10))
    with_word = np.searchsorted(start, ends) > np.searchsorted(start, begins)
    owner, line = owner[with_word], span_hash(prefix, begins[with_word], ends[with_word])
    order = np.lexsort((line, owner))
    again = (owner[order][1:] == owner[order][:-1]) & (line[order][1:] == line[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][1:][again], minlength=texts.n)

    window = shingle_hashes(span_hash(prefix, start, end), 5)
    inside = np.zeros(0, bool) if not len(window) else doc[: len(window)] == doc[4:]
    at = np.flatnonzero(inside)
    key = mix(window[at] + mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    found = np.zeros(len(at), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    cover = np.zeros(len(start) + 6, np.int64)
    hit = at[found]
    cover[hit] += 1
    cover -= np.bincount(hit + 5, minlength=len(cover))[: len(cover)]
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[: len(start)] > 0], minlength=texts.n)
    return out


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.select([k for k in range(batch.num_columns - 1)])
        for a, b, texts in slices(batch.column(batch.num_columns - 1)):
            found = text_counts(texts)
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(k).slice(a, b - a) for k in range(kept.num_columns)), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)],
                names=[*kept.schema.names, *COUNTS],
            )


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``keep`` columns and the base counts of whole texts.

    n_words: words ``[^\\x20\\x09-\\x0D]+``; word_chars: code points in them;
    n_symbols: characters of ``#*$%&|<>``; n_dup_lines: newline-split lines with
    a word that equal an earlier line; n_repeat_words: words inside five-word
    windows found at least twice in the text.
    """
    rows = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_count_batches, ", ".join([*kinds, *(f"{c} long" for c in COUNTS)]))


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials of probability p, summed exactly term by term."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def rejecting_level():
    """The most lenient level at which some signal is above its cutoff; null where none is."""
    above = lambda k: reduce(or_, (F.expr(s.formula) > s.grid[k] for s in SIGNALS))
    return F.coalesce(*(F.when(above(k), k) for k in range(len(SIGNALS[0].grid))))


def choose_level(wrong: list[int], right: list[int], good: int, bad: int, risk: float, level: float) -> int | None:
    """The chosen level of a stratum, or None.

    ``wrong`` and ``right`` say for each level how many of the ``good`` and the
    ``bad`` labelled documents it rejects.  A level passes when, if its risk were
    at the limit, as few of the good rejected as seen had at most the probability ``level``.
    """
    passed = 0
    while passed < len(wrong) and binomial_at_most(wrong[passed], good, risk) <= level:
        passed += 1
    worth = [r / max(1, bad) - w / max(1, good) for w, r in zip(wrong[:passed], right, strict=False)]
    best = worth.index(max(worth)) if worth else None
    return best if best is not None and right[best] and worth[best] > 0 else None


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, label_id: str = "doc_id") -> DataFrame:
    """doc_id, lang, base counts, base_failed, kept.

    ``risk``: allowed share of good documents that the cutoffs of a stratum
    reject; ``error``: chance that this share is above it in any stratum.
    ``label_id`` names the column that labels go by.  ``kept`` is false where
    the base rule or a cutoff rejects.  What is collected is one row of counts
    for each stratum, label and level.
    """
    counts = materialize(base_counts(docs), "quality-counts").withColumns({"base_failed": base_failed(), "_level": rejecting_level()})
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") >= 1).alias("_good")).withColumnRenamed("doc_id", "_labelled")
    seen = counts.where(~F.col("base_failed")).join(truth, F.col(label_id) == F.col("_labelled"))
    trials = seen.groupBy("lang", "_good", "_labelled").agg(F.min("_level").alias("_level"))
    tally: dict = {}
    for r in trials.groupBy("lang", "_good", "_level").count().collect():
        tally.setdefault(r.lang, {True: Counter(), False: Counter()})[r._good][r._level] = r["count"]
    levels = range(len(SIGNALS[0].grid))
    cut_off = F.lit(False)
    for lang, of in sorted(tally.items(), key=str):
        rejected = {good: list(accumulate(of[good][k] for k in levels)) for good in (True, False)}
        chosen = choose_level(rejected[True], rejected[False], of[True].total(), of[False].total(), risk, error / len(tally))
        if chosen is not None:
            cut_off = cut_off | (F.col("lang").eqNullSafe(F.lit(lang)) & F.coalesce(F.col("_level") <= chosen, F.lit(False)))
    return counts.withColumn("kept", ~(F.col("base_failed") | cut_off)).select("doc_id", "lang", *COUNTS, "base_failed", "kept")
