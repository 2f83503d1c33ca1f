"""Scoring documents with a gated recurrent language model.

Tokens are lower-cased words and one end per text.  All counts cover all
training documents: a Spark aggregation counts every distinct token, and what
the model cannot keep in memory (the tail of the vocabulary) is joined, not
dropped.

The output is factored by class.  The most frequent words (at most ``WORDS``)
form classes of equal width, within which a softmax over the state picks the
word.  All other words fall into classes by their last two bytes; within such a
class the probability does not depend on the state: (c - D) / N_class for a
counted word, D * types / N_class for all unseen ones, which counts unseen words
of a class as one word, as the base score does.  So the probabilities of all
words sum to one.

Training is truncated backpropagation through time over windows of streams of
texts, the state carried from window to window and set back where a text begins.
It runs as local SGD over all training documents, each of them once: a round
takes its part of them, each task trains a copy on a bounded number of tokens and
the copies are averaged by Spark, 64 at a time.  The tasks grow with the input.
Round and task of a document go by a hash of its id and text, and of its number
among equal rows, so copies of a text spread.

Texts are read once for the counts and once to be turned into symbols, which
training and scoring share.  Scoring takes every whole text: texts of an Arrow
batch advance together, one token a step, and the state is carried to the end of
each.

Null or empty text: one token, the end.  Null ids are hashed as the empty text
for the held-out rule (crc32 of nothing is 0).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .storage import drop_tables, materialize
from .textops import Texts, prefix_hash, slices, span_hash

F32 = np.float32
END = np.uint64(0x5EED0E9D)
#: Words with a state-dependent probability, and words whose counts every task holds.
WORDS, HELD_WORDS = 2048, 262_144
CLASS_WIDTH, SUFFIX_CLASSES = 64, 48
STATE, EMBED, WINDOW = 16, 16, 32
#: Streams side by side in training: as many as give each the tokens named, within these bounds.
STREAM_TOKENS, FEW_ROWS, MOST_ROWS = 18_000, 16, 256
DISCOUNT = 0.75
#: Tokens that advance together in scoring.
SLICE = 1_500_000
#: Copies of the weights that one group averages.
AVERAGED = 64


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, its last two bytes as a number, and first token of each text (one more at the end)."""
    low = texts.lowered()
    start, end, first = low.words()
    word = span_hash(prefix_hash(low.buf), start, end)
    last = low.buf[end - 1].astype(np.int32) if len(end) else np.zeros(0, np.int32)
    suffix = last + np.where(end - start > 1, low.buf[np.maximum(end - 2, 0)].astype(np.int32) << 8, 0) if len(end) else last
    at = first[1:]
    return np.insert(word, at, END), np.insert(suffix, at, 0), first + np.arange(len(first))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, suffix, n) of a partition; merged whenever much is held."""
    held: list[tuple] = []

    def merge() -> tuple:
        token, suffix, n = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.argsort(token)
        token, suffix, n = token[order], suffix[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        return token[at], suffix[at], np.add.reduceat(n, at)

    rows = 0
    for batch in batches:
        for _, _, texts in slices(batch.column(0)):
            token, suffix, _ = tokens(texts)
            held.append((token, suffix, np.ones(len(token), np.int64)))
            rows += len(token)
            if rows > 1_500_000:
                held = [merge()]
                rows = len(held[0][0])
    if held:
        token, suffix, n = merge()
        for at in range(0, len(token), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(token[part].view(np.int64)), pa.array(suffix[part]), pa.array(n[part])], names=["token", "suffix", "n"])


def vocabulary(texts: DataFrame) -> DataFrame:
    """``token, suffix, n`` of all tokens in the binary column ``text``."""
    found = texts.select("text").mapInArrow(_count, "token long, suffix int, n long")
    return found.groupBy("token").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def _at_least(vocab: DataFrame, most: int) -> int:
    """Least count such that at most ``most`` words have it; words that tie with others are in or out together."""
    spread = vocab.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect()
    total, least = 0, None
    for row in spread:
        total += row["count"]
        if total > most:
            break
        least = row.n
    return least if least is not None else (spread[0].n + 1 if spread else 1)


@dataclass
class Lexicon:
    """What every task holds of the vocabulary: bounded by ``HELD_WORDS`` words and 65,536 suffixes."""

    held: np.ndarray  # token hashes, ascending
    count: np.ndarray
    symbol: np.ndarray  # of held words: word number below ``words``, or -1
    words: int
    suffix_class: np.ndarray
    class_total: np.ndarray
    class_types: np.ndarray
    total: int
    distinct: int
    classes: int = field(init=False)

    def __post_init__(self):
        self.classes = -(-self.words // CLASS_WIDTH) + SUFFIX_CLASSES

    def place(self, token: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word number (-1: none), suffix class, place among held words, and whether held."""
        kind = self.suffix_class[suffix]
        if not len(self.held):
            return np.full(len(token), -1), kind, np.zeros(len(token), int), np.zeros(len(token), bool)
        at = np.minimum(np.searchsorted(self.held, token), len(self.held) - 1)
        known = self.held[at] == token
        return np.where(known, self.symbol[at], -1), kind, at, known

    def symbols(self, token: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Words by number, others by suffix class."""
        symbol, kind, _, _ = self.place(token, suffix)
        return np.where(symbol < 0, self.words + kind, symbol)


def lexicon(vocab: DataFrame) -> Lexicon:
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    word_least, held_least = _at_least(vocab, WORDS), _at_least(vocab, HELD_WORDS)
    held = vocab.where(F.col("n") >= held_least).toPandas()
    held = held.assign(token=held["token"].to_numpy().view(np.uint64)).sort_values(["n", "token"], ascending=[False, True])
    words = int((held["n"] >= word_least).sum())
    held["symbol"] = np.where(np.arange(len(held)) < words, np.arange(len(held)), -1)
    held = held.sort_values("token")
    by_suffix = vocab.where(F.col("n") < word_least).groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    by_suffix = by_suffix.sort_values(["n", "suffix"], ascending=[False, True])
    of = np.full(65_536, SUFFIX_CLASSES - 1)
    of[by_suffix["suffix"].to_numpy()[: SUFFIX_CLASSES - 1]] = np.arange(min(SUFFIX_CLASSES - 1, len(by_suffix)))
    sums = lambda c: np.bincount(of[by_suffix["suffix"]], by_suffix[c], SUFFIX_CLASSES)
    return Lexicon(held["token"].to_numpy(), held["n"].to_numpy(), held["symbol"].to_numpy(), words, of, sums("n"), sums("types"), int(total), int(distinct))


def new_weights(lex: Lexicon, seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(F32)
    words = max(1, -(-lex.words // CLASS_WIDTH)) * CLASS_WIDTH
    # Biases (the last rows) start at log frequencies, so training begins near the unigram model.
    mass = np.full(lex.classes, 1e-6)
    bias = np.full(words, -60.0)
    seen = lex.symbol >= 0
    if seen.any():
        bias[lex.symbol[seen]] = np.log(lex.count[seen] / lex.count[seen].max())
        np.add.at(mass, lex.symbol[seen] // CLASS_WIDTH, lex.count[seen])
    mass[lex.classes - SUFFIX_CLASSES :] += lex.class_total + 0.5
    return {
        "embed": (r.standard_normal((lex.words + SUFFIX_CLASSES, EMBED)) * 0.3).astype(F32),
        "w": draw(EMBED, 3 * STATE),
        "u": draw(STATE, 3 * STATE),
        "b": np.zeros(3 * STATE, F32),
        "start": np.zeros((1, STATE), F32),
        "class_w": np.concatenate([draw(STATE, lex.classes) * F32(0.1), np.log(mass / mass.sum())[None]]).astype(F32),
        "word_w": np.concatenate([draw(STATE, words) * F32(0.1), bias[None]]).astype(F32),
    }


def token_log_probs(weights: dict, words: int, state: np.ndarray, symbol: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Natural log probability of each symbol given the state before it; for a suffix class the class's only.

    With ``grads``, the loss's gradients are added to them and the states' are
    returned in place of the probabilities.  Logits are small (biases are log
    shares, states lie within -1 and 1), so exponentials need no shift.
    """
    state = np.concatenate([state, np.ones((len(state), 1), F32)], 1)
    word = symbol < words
    kind = np.where(word, symbol // CLASS_WIDTH, symbol - words + -(-words // CLASS_WIDTH))

    def factor(state: np.ndarray, name: str, cols: slice, pick: np.ndarray) -> np.ndarray:
        w = weights[name][:, cols]
        x = state @ w
        each = np.arange(len(pick))
        found = x[each, pick] if grads is None else None
        np.exp(x, out=x)
        total = x @ np.ones(x.shape[1], F32)
        if grads is None:
            return found - np.log(total)
        x *= (1 / total)[:, None]
        x[each, pick] -= 1
        grads[name][:, cols] += state.T @ x
        return x @ w[:STATE].T

    out = factor(state, "class_w", slice(None), kind)
    at = np.flatnonzero(word)
    at = at[np.argsort(kind[at].astype(np.int16), kind="stable")]
    if len(at):
        by_class, pick = state[at], symbol[at] % CLASS_WIDTH
        cuts = np.searchsorted(kind[at], np.arange(-(-words // CLASS_WIDTH) + 1)).tolist()
        inner = [factor(by_class[p:q], "word_w", slice(k * CLASS_WIDTH, (k + 1) * CLASS_WIDTH), pick[p:q]) for k, (p, q) in enumerate(zip(cuts, cuts[1:])) if q > p]
        out[at] += np.concatenate(inner)
    return (out, None) if grads is None else (None, out)


def streams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``texts`` dealt to streams of about equal length: symbols (step, row), which of them begin a text, and lengths, descending."""
    most = min(MOST_ROWS, max(FEW_ROWS, sum(map(len, texts)) // STREAM_TOKENS))
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    heap: list[tuple[int, int]] = [(0, r) for r in range(min(most, len(texts)))]
    mine: list[list[int]] = [[] for _ in heap]
    for k in order:
        size, r = heap[0]
        mine[r].append(k)
        heapq.heapreplace(heap, (size + len(texts[k]), r))
    rows = sorted((sorted(m) for m in mine), key=lambda m: -sum(len(texts[k]) for k in m))
    length = np.array([sum(len(texts[k]) for k in m) for m in rows])
    symbol, begin = np.zeros((length[0], len(rows)), np.int32), np.zeros((length[0], len(rows)), bool)
    for r, m in enumerate(rows):
        symbol[: length[r], r] = np.concatenate([texts[k] for k in m])
        begin[np.cumsum([0, *(len(texts[k]) for k in m[:-1])]), r] = True
    return symbol, begin, length


def train(weights: dict, words: int, texts: list[np.ndarray], rate: float = 4e-3) -> tuple[dict, int]:
    """Truncated backpropagation over texts of symbols (none empty), which follow each other in streams side by side."""
    weights = {k: v.copy() for k, v in weights.items()}
    adam, seen = gru.Adam(weights, rate), 0
    all_symbols, begins, length = streams(texts)
    h = np.repeat(weights["start"], len(length), 0)
    for at in range(0, len(all_symbols), WINDOW):
        live = int(np.searchsorted(-length, -at, "left"))
        symbol = all_symbols[at : at + WINDOW, :live]
        real = np.arange(at, at + len(symbol))[:, None] < length[:live]
        begin = begins[at : at + WINDOW, :live]
        resets = [np.flatnonzero(b) for b in begin]
        grads = {k: np.zeros_like(v) for k, v in weights.items()}
        x = weights["embed"][symbol]
        states, kept = gru.forward(x @ weights["w"], h[:live], weights["u"], weights["b"], resets, weights["start"])
        before = kept[0][:-1]
        d_before = np.zeros_like(before)
        d_before[real] = token_log_probs(weights, words, before[real], symbol[real], grads)[1]
        grads["start"] += d_before[begin].sum(0)
        d_before[begin] = 0
        d_states = np.concatenate([d_before[1:], np.zeros_like(d_before[:1])])
        dx, grads["u"], grads["b"], _ = gru.backward(d_states, kept, weights["u"], resets, grads["start"][0])
        flat = dx.reshape(-1, 3 * STATE)
        grads["w"] += x.reshape(-1, EMBED).T @ flat
        grads["embed"] += gru.scatter_rows(len(weights["embed"]), symbol.ravel(), flat @ weights["w"].T)
        now = int(real.sum())
        adam.update(weights, {k: g * F32(1 / now) for k, g in grads.items()})
        seen += now
        h = states[-1]
    return weights, seen


def _pack(weights: dict) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def _unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(F32)
        at += like[k].size
    return out


def deal(texts: DataFrame, held) -> DataFrame:
    """All that training and scoring need of every text (columns ``doc_id``, ``text``, and ``held_out`` if there).

    h differs among copies, equal rows included.  ``held``: the broadcast lexicon.
    """

    def symbols(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        unit = np.log10(lex.total + 0.5 * (lex.distinct + 1))
        count_log = np.log10(np.maximum(lex.count, 0) + 0.5)
        inner_log = np.log10(np.maximum(lex.count - DISCOUNT, 1e-9))
        class_log = np.log10(np.maximum(lex.class_total, 1))
        met: dict[int, int] = {}  # of one partition of the input
        for batch in batches:
            for a, b, some in slices(batch.column(3)):
                token, suffix, first = tokens(some)
                n, doc = np.diff(first), np.repeat(np.arange(some.n), np.diff(first))
                symbol, kind, at, known = lex.place(token, suffix)
                static = known & (symbol < 0)
                n_rare = np.bincount(doc[~known], minlength=some.n)
                base = np.bincount(doc[known], count_log[at[known]], some.n) - n * unit
                inner = np.bincount(doc[static], inner_log[at[static]] - class_log[kind[static]], some.n)
                symbol = np.where(symbol < 0, lex.words + kind, symbol).astype(np.int16)
                rare = pa.StructArray.from_arrays([pa.array(token[~known].view(np.int64)), pa.array(kind[~known].astype(np.int32))], names=["token", "kind"])
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32)), v) for k, v in ((n_rare, rare), (n, pa.array(symbol)))]
                again = []
                for key in batch.column(0).slice(a, b - a).to_pylist():
                    again.append(met.get(key, 0))
                    met[key] = again[-1] + 1
                same = [batch.column(k).slice(a, b - a) for k in range(3)]
                made = [pa.array(x) for x in (np.array(again, np.int64), n, n - n_rare, base, inner.astype(float))]  # of nothing, bincount makes integers
                yield pa.RecordBatch.from_arrays([*same, *made, *lists], names=["h", "doc_id", "held_out", "again", "n_tokens", "n_held", "base", "inner", "rare", "symbols"])

    held_out = F.col("held_out") if "held_out" in texts.columns else F.lit(False)
    rows = texts.select(F.xxhash64("doc_id", "text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(
        symbols, "h long, doc_id long, held_out boolean, again long, n_tokens long, n_held long, base double, inner double, rare array<struct<token:long,kind:int>>, symbols array<short>"
    )
    salted = F.when(F.col("again") > 0, F.xxhash64("h", "again", F.spark_partition_id())).otherwise(F.col("h"))
    return rows.withColumn("h", salted).drop("again")


def average(copies: DataFrame, tasks: int) -> DataFrame:
    """``part, weights``: mean of the copies of each part, weighted by ``seen``, in groups of ``AVERAGED``."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, total = pdf["seen"].sum(), 0.0
        for w, n in zip(pdf["weights"], pdf["seen"], strict=True):
            total = total + np.frombuffer(w, F32).astype(np.float64) * (n / seen)
        return pdf[["task", "part"]].iloc[:1].assign(seen=seen, weights=[total.astype(F32).tobytes()])

    while True:
        tasks = -(-tasks // AVERAGED)
        copies = copies.withColumn("task", F.floor(F.col("task") / AVERAGED).cast("int"))
        copies = copies.groupBy("task", "part").applyInPandas(add, "task int, part int, seen long, weights binary")
        if tasks <= 1:
            return copies.select("part", "weights")


def fit(texts: DataFrame, lex: Lexicon) -> dict:
    """Weights trained on every text (columns ``doc_id``, ``text``) once."""
    dealt = materialize(deal(texts, texts.sparkSession.sparkContext.broadcast(lex)), "lm-training")
    weights = fit_symbols(dealt, lex)
    drop_tables(dealt)
    return weights


def fit_symbols(dealt: DataFrame, lex: Lexicon, rounds: int = 4, tokens_a_task: int = 4_800_000) -> dict:
    """Weights trained by averaged local SGD on every text (columns ``h``, ``symbols``) once."""
    spark = dealt.sparkSession
    size = dealt.agg(F.sum(F.size("symbols"))).first()[0] or 0
    weights = new_weights(lex)
    if not size:
        return weights
    tasks, words = max(1, round(size / rounds / tokens_a_task)), lex.words
    chunk = 32_768
    for turn in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def one(batches: Iterable[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            mine = [(k, np.array(t)) for batch in batches for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True)]
            if mine:
                mine.sort(key=lambda x: x[0])
                trained, seen = train(now.value, words, [t for _, t in mine], rate=1e-2 / (1 + turn))
                flat = _pack(trained)
                parts = range(0, len(flat), chunk)
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(parts), t) for x, t in ((task, pa.int32()),)] + [pa.array([p // chunk for p in parts], pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array([flat[p : p + chunk].astype(F32).tobytes() for p in parts], pa.binary())], names=["task", "part", "seen", "weights"])

        share_of_turn = dealt.where(F.pmod(F.shiftright("h", 20), F.lit(rounds)) == turn).select("h", "symbols")
        copies = share_of_turn.repartition(tasks, F.shiftright("h", 30)).mapInArrow(one, "task int, part int, seen long, weights binary")
        got = average(copies, tasks).collect()  # one model
        if got:
            flat = np.concatenate([np.frombuffer(r.weights, F32) for r in sorted(got, key=lambda r: r.part)])
            weights = _unpack(flat, weights)
    return weights


def score_texts(weights: dict, lex: Lexicon, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log probability that the model gives each text's symbols, the state carried to its end."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    table = weights["embed"] @ weights["w"]
    total = np.zeros(len(order))
    h = np.repeat(weights["start"], len(order), 0)
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(steps), "left")
    held_states, held_symbols, held_rows, held = [], [], [], 0

    def flush() -> None:
        logp, _ = token_log_probs(weights, lex.words, np.concatenate(held_states), np.concatenate(held_symbols))
        total[:] += np.bincount(np.concatenate(held_rows), logp, len(total))

    rows = np.arange(len(order))
    for t in range(steps):
        n = int(live[t])
        now = symbol[start[:n] + t]
        held_states.append(h[:n])
        held_symbols.append(now)
        held_rows.append(rows[:n])
        held += n
        if held > 40_000:
            flush()
            held_states, held_symbols, held_rows, held = [], [], [], 0
        h = gru.step(table[now], h[:n], weights["u"], weights["b"])
    if held:
        flush()
    out = np.empty(len(order))
    out[order] = total
    return out


def score_documents(docs: DataFrame, held_out_fold: int = 1, folds: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every whole text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == held_out_fold).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    vocab = materialize(vocabulary(rows.where(~F.col("held_out"))), "lm-vocabulary")
    lex = lexicon(vocab)
    held_lex = spark.sparkContext.broadcast(lex)
    dealt = materialize(deal(rows, held_lex).withColumn("row", F.monotonically_increasing_id()), "lm-symbols")
    held = spark.sparkContext.broadcast(fit_symbols(dealt.where(~F.col("held_out")), lex))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            first = lists.offsets.to_numpy().astype(np.int64)
            symbol = lists.values.to_numpy()
            at = 0
            while at < len(lists):
                to = max(at + 1, int(np.searchsorted(first, first[at] + SLICE, "right")) - 1)
                model = score_texts(held.value, held_lex.value, symbol[first[at] : first[to]].astype(np.int32), first[at : to + 1] - first[at]) / np.log(10)
                same = [batch.column(k).slice(at, to - at) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(model)], names=[*batch.schema.names[:-1], "model"])
                at = to

    parts = dealt.select("row", "doc_id", "held_out", "n_tokens", "n_held", "base", "inner", "symbols").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_held long, base double, inner double, model double")
    rare = dealt.select("row", F.explode("rare").alias("r")).groupBy("row", "r.token", "r.kind").agg(F.count("*").alias("k"))
    per_class = spark.createDataFrame([(k, float(t), float(v)) for k, (t, v) in enumerate(zip(lex.class_total, lex.class_types, strict=True))], "kind int, class_total double, class_types double")
    found = rare.join(vocab.select("token", "n"), "token", "left").join(F.broadcast(per_class), "kind")
    seen = F.col("n").isNotNull()
    mass = F.when(seen, F.col("n") - DISCOUNT).when(F.col("class_types") > 0, DISCOUNT * F.col("class_types")).otherwise(F.lit(1.0))
    tail = found.groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("base_tail"),
        F.sum(F.col("k") * (F.log10(mass) - F.log10(F.greatest("class_total", F.lit(1.0))))).alias("model_tail"),
        F.sum(F.when(seen, F.col("k")).otherwise(0)).alias("known_tail"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_held") + zero("known_tail")).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_tail")).alias("base_score"), (F.col("model") + F.col("inner") + zero("model_tail")).alias("score"),
    )
