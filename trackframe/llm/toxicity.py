"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a word vector (hashed table) and a character vector
(mean over the vectors of its character n-grams, marked at both ends), so both
the word and its spelling speak.  Two recurrent layers read a window of words
forward and backward; attention weighs the words' states; a linear layer gives
the window's logit.  A text's score is the sigmoid of its highest window logit
over *all* overlapping windows (``WINDOW`` words, each ``STRIDE`` words on, the
last one ending with the text).

Labels are of texts, not windows, so training follows the window that scores
highest at the moment (multiple-instance learning).  It runs in numpy on at most
``sample`` labelled texts (as many toxic as there are up to half, the rest
clean; smallest hash of the id first) and at most ``sample_words`` words in all.
Only training is bounded; scoring covers every window of every text.

Null, empty and wordless texts score the network's answer to a window of no
words.  With no labels of one class the score is the share of toxic labels (0
without labels).  Null ids count as the empty text in the held-out rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .language_model import fold
from .textops import Texts, mix, prefix_hash, slices, span_hash

F32 = np.float32
WINDOW, STRIDE = 24, 12
STATE, EMBED = 8, 16
WORD_ROWS, GRAM_ROWS, GRAM = 1 << 14, 1 << 14, 4
#: Windows that are run side by side.
BATCH = 8_192


def word_grams(texts: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-gram table for words, and how many each word has: its first and last bytes and all inner n-grams."""
    length = end - start
    count = np.maximum(length - GRAM + 1, 0) + 2
    word = np.repeat(np.arange(len(start)), count)
    k = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    n = length[word]
    a = np.where(k == 0, start[word], np.where(k == 1, np.maximum(end[word] - 3, start[word]), start[word] + k - 2))
    b = np.where(k == 0, np.minimum(start[word] + 3, end[word]), np.where(k == 1, end[word], np.minimum(start[word] + k - 2 + GRAM, end[word])))
    del n
    value = span_hash(prefix_hash(texts.buf), a, b)
    return (mix(value + np.minimum(k, 2).astype(np.uint64)) % np.uint64(GRAM_ROWS)).astype(np.int64), count


class Words:
    """Distinct words of some texts, with the texts as numbers of words."""

    def __init__(self, texts: Texts):
        low = texts.lowered()
        start, end, self.first = low.words()
        # Surrounding punctuation is no part of the spelling.
        letter = ((low.buf >= 97) & (low.buf <= 122)) | (low.buf >= 128)
        at = np.arange(len(low.buf))
        ahead = np.minimum.accumulate(np.where(letter, at, len(low.buf))[::-1])[::-1]
        back = np.maximum.accumulate(np.where(letter, at, -1)) + 1
        if len(start):
            s, e = ahead[start], back[end - 1]
            ok = s < e
            start, end = np.where(ok & (s < end), s, start), np.where(ok & (e > start), e, end)
        value = span_hash(prefix_hash(low.buf), start, end)
        self.hash, index, self.word = np.unique(value, return_index=True, return_inverse=True)
        self.grams, self.counts = word_grams(low, start[index], end[index])
        self.row = (self.hash % np.uint64(WORD_ROWS)).astype(np.int64)

    def vectors(self, weights: dict) -> np.ndarray:
        """Input vector of each distinct word, and a zero vector for no word at the end."""
        out = np.zeros((len(self.hash) + 1, EMBED), F32)
        if len(self.hash):
            sums = np.add.reduceat(weights["gram"][self.grams], np.cumsum(self.counts) - self.counts)
            out[:-1] = weights["word"][self.row] + sums / self.counts[:, None].astype(F32)
        return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window and the text it belongs to; a text of at most ``WINDOW`` words has one."""
    n = np.diff(first)
    count = np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return first[doc] + np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0)), doc


def window_words(word: np.ndarray, first: np.ndarray, start: np.ndarray, doc: np.ndarray, none: int) -> np.ndarray:
    """(step, window) numbers of words; ``none`` beyond a text's end."""
    at = start[None, :] + np.arange(WINDOW)[:, None]
    inside = at < first[doc + 1][None, :]
    return np.where(inside, np.append(word, none)[np.where(inside, at, len(word))], none)


def new_weights(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape, s=1.0: (r.standard_normal(shape) * s / np.sqrt(shape[0])).astype(F32)
    out = {"word": (r.standard_normal((WORD_ROWS, EMBED)) * 0.05).astype(F32), "gram": (r.standard_normal((GRAM_ROWS, EMBED)) * 0.3).astype(F32)}
    for side in ("f", "b"):
        out |= {f"w{side}": draw(EMBED, 3 * STATE), f"u{side}": draw(STATE, 3 * STATE), f"c{side}": np.zeros(3 * STATE, F32)}
    return out | {"attend": draw(2 * STATE, 1), "out": draw(2 * STATE, 1), "bias": np.zeros(1, F32)}


def run_windows(weights: dict, projected: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> np.ndarray:
    """Logits of windows, without keeping anything for training."""
    h0 = np.zeros((words.shape[1], STATE), F32)
    states = np.empty((WINDOW, words.shape[1], 2 * STATE), F32)
    h = h0
    for t in range(WINDOW):
        h = states[t, :, :STATE] = gru.step(projected[0][words[t]], h, weights["uf"], weights["cf"])
    h = h0
    for t in range(WINDOW - 1, -1, -1):
        h = states[t, :, STATE:] = gru.step(projected[1][words[t]], h, weights["ub"], weights["cb"])
    both = states @ np.concatenate([weights["attend"], weights["out"]], 1)
    share = np.exp(both[:, :, 0] - both[:, :, 0].max(0))
    return (share * both[:, :, 1]).sum(0) / share.sum(0) + weights["bias"][0]


def text_logits(weights: dict, texts: Texts) -> np.ndarray:
    """Highest window logit of each text."""
    words = Words(texts)
    vectors = words.vectors(weights)
    projected = (vectors @ weights["wf"], vectors @ weights["wb"])
    start, doc = windows(words.first)
    logit = np.empty(len(start), F32)
    for at in range(0, len(start), BATCH):
        part = slice(at, at + BATCH)
        logit[part] = run_windows(weights, projected, window_words(words.word, words.first, start[part], doc[part], len(words.hash)))
    out = np.full(texts.n, -np.inf, F32)
    np.maximum.at(out, doc, logit)
    return out


def _learn_windows(weights: dict, words: Words, grid: np.ndarray, label: np.ndarray) -> dict:
    """Gradients of the mean log loss of some windows."""
    used, index = np.unique(grid, return_inverse=True)
    index = index.reshape(grid.shape)
    vectors = words.vectors(weights)[used]
    x = vectors[index]
    n = grid.shape[1]
    h0 = np.zeros((n, STATE), F32)
    fwd, kept_f = gru.forward(x @ weights["wf"], h0, weights["uf"], weights["cf"])
    bwd, kept_b = gru.forward((x @ weights["wb"])[::-1], h0, weights["ub"], weights["cb"])
    states = np.concatenate([fwd, bwd[::-1]], 2)
    score = (states @ weights["attend"])[:, :, 0]
    share = np.exp(score - score.max(0))
    share /= share.sum(0)
    value = (states @ weights["out"])[:, :, 0]
    logit = (share * value).sum(0) + weights["bias"][0]
    d = ((gru.sigmoid(logit) - label) / n).astype(F32)
    d_value = share * d
    d_score = share * (value - (share * value).sum(0)) * d
    d_states = d_value[:, :, None] * weights["out"][:, 0] + d_score[:, :, None] * weights["attend"][:, 0]
    flat = states.reshape(-1, 2 * STATE)
    grads = {"out": flat.T @ d_value.reshape(-1, 1), "attend": flat.T @ d_score.reshape(-1, 1), "bias": d.sum(keepdims=True)}
    dx_f, grads["uf"], grads["cf"], _ = gru.backward(np.ascontiguousarray(d_states[:, :, :STATE]), kept_f, weights["uf"])
    dx_b, grads["ub"], grads["cb"], _ = gru.backward(np.ascontiguousarray(d_states[::-1, :, STATE:]), kept_b, weights["ub"])
    dx_b = dx_b[::-1]
    inputs = x.reshape(-1, EMBED)
    grads["wf"], grads["wb"] = inputs.T @ dx_f.reshape(-1, 3 * STATE), inputs.T @ dx_b.reshape(-1, 3 * STATE)
    d_input = dx_f.reshape(-1, 3 * STATE) @ weights["wf"].T + dx_b.reshape(-1, 3 * STATE) @ weights["wb"].T
    d_word = gru.scatter_rows(len(used), index.ravel(), d_input)
    real = used < len(words.hash)
    used, d_word = used[real], d_word[real]
    grads["word"] = gru.scatter_rows(WORD_ROWS, words.row[used], d_word)
    starts = np.cumsum(words.counts) - words.counts
    count = words.counts[used]
    at = np.repeat(starts[used] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    grads["gram"] = gru.scatter_rows(GRAM_ROWS, words.grams[at], np.repeat(d_word / count[:, None].astype(F32), count, 0))
    return grads


def telling_words(words: Words, label: np.ndarray) -> np.ndarray:
    """For each distinct word, how much more often texts with its most telling feature are toxic (log odds).

    Features are the word and its n-grams; a feature counts once for a text.
    It only picks the windows that the first epoch learns from.
    """
    doc = np.repeat(np.arange(len(label)), np.diff(words.first))
    pair = np.unique(doc.astype(np.int64) * len(words.hash) + words.word) if len(doc) else np.zeros(0, np.int64)
    doc, word = pair // max(1, len(words.hash)), pair % max(1, len(words.hash))
    starts = np.cumsum(words.counts) - words.counts
    feature, of = np.concatenate([words.grams, words.row + GRAM_ROWS]), np.concatenate([np.repeat(np.arange(len(words.hash)), words.counts), np.arange(len(words.hash))])
    count = words.counts[word]
    at = np.repeat(starts[word] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = GRAM_ROWS + WORD_ROWS
    seen = np.unique(np.concatenate([np.repeat(doc, count) * size + words.grams[at], doc * size + words.row[word] + GRAM_ROWS]))
    toxic = label[seen // size] == 1
    n1, n0 = (np.bincount(seen[m] % size, minlength=size) for m in (toxic, ~toxic))
    odds = np.log((n1 + 0.5) / (n0 + 2.0)) - np.log(max(1, label.sum()) / max(1, (1 - label).sum()))
    out = np.full(len(words.hash), -10.0)
    np.maximum.at(out, of, np.where(n1[feature] >= 3, odds[feature], -10.0))
    return out


def train(texts: Texts, label: np.ndarray, epochs: int = 9, rate: float = 8e-3, rows: int = 192, drop: float = 0.15, decay: float = 2e-3, seed: int = 3) -> dict:
    """Weights for texts and their labels.

    An epoch scores all windows (the first by telling words); each toxic text then
    teaches its highest one, each clean text its three highest.  Words are left out
    at random and the tables shrink a little, lest single texts be learned by heart.
    """
    weights, r = new_weights(), np.random.default_rng(seed)
    words = Words(texts)
    start, doc = windows(words.first)
    grid = window_words(words.word, words.first, start, doc, len(words.hash))
    adam = gru.Adam(weights, rate)
    for epoch in range(epochs):
        vectors = words.vectors(weights)
        projected = (vectors @ weights["wf"], vectors @ weights["wb"])
        logit = np.concatenate([run_windows(weights, projected, grid[:, at : at + BATCH]) for at in range(0, len(start), BATCH)])
        if epoch == 0:
            telling = np.append(telling_words(words, label), -10.0)
            logit = np.sort(telling[grid], 0)[-3:].sum(0).astype(F32)
        order = np.lexsort((-logit, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        take = np.where(label[doc[order]] == 1, rank < 1, rank < 3)
        chosen = r.permutation(order[take])
        adam.rate = rate * (1.0 if epoch < epochs - 3 else 0.3)
        for at in range(0, len(chosen), rows):
            some = chosen[at : at + rows]
            part = np.where(r.random((WINDOW, len(some))) < drop, len(words.hash), grid[:, some])
            adam.update(weights, _learn_windows(weights, words, part, label[doc[some]].astype(F32)))
            for table in ("word", "gram"):
                weights[table] *= F32(1 - decay)
    return weights


def training_texts(labelled: DataFrame, sample: int, sample_words: int, truth: DataFrame | None = None) -> tuple[list[bytes], np.ndarray]:
    """At most ``sample`` labelled texts of at most ``sample_words`` words together; labels come from ``truth``, if given.

    Sizes are looked at first, by hash of the id (several rows of an id by hash of
    the text); a text that does not fit into what is left is passed over.  Texts
    are not shuffled: sizes meet the labels, and the chosen ids are broadcast.
    """
    key = F.xxhash64("text")
    sizes = labelled.select("doc_id", key.alias("h"), (F.coalesce(F.length("text"), F.lit(0)) / 6 + 1).alias("size"), *(["toxic"] if truth is None else []))
    sizes = (sizes if truth is None else sizes.join(truth, "doc_id")).dropDuplicates(["doc_id", "h"])
    ranked = [sizes.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample // 2).collect() for toxic in (1, 0)]
    chosen: dict[tuple, int] = {}
    words = 0.0
    for k in range(max(map(len, ranked))):
        for rows in ranked:
            if k < len(rows) and words + rows[k]["size"] <= sample_words:
                words += rows[k]["size"]
                chosen[rows[k].doc_id, rows[k].h] = rows[k].toxic
    wanted = F.broadcast(labelled.sparkSession.createDataFrame(list(chosen), "doc_id long, h long"))  # at most ``sample`` rows
    found = labelled.select("doc_id", key.alias("h"), F.col("text").cast("binary").alias("text")).join(wanted, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    texts = {(r.doc_id, r.h): bytes(r.text or b"") for r in found.collect()}
    return [texts[k] for k in chosen], np.array(list(chosen.values()))


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, sample: int = 3_000, sample_words: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; labels of the held-out fold are not learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == held_out_fold).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    truth = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    texts, label = training_texts(rows.where(~F.col("held_out")).select("doc_id", "text"), sample, sample_words, truth)
    if len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 0.0
        return rows.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    weights = spark.sparkContext.broadcast(train(Texts(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])])), label))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in slices(batch.column(2)):
                score = 1 / (1 + np.exp(-text_logits(weights.value, some).astype(float)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
