"""Tokens of two tokenizers on the same text: which of them cover the same bytes.

A (tokenizers library, byte-level) reads a space and the text, B (sentencepiece) the
text, before which it puts a space itself.  Both libraries tell the characters of
each token: ends of characters are coarse cuts.  Tokens that share a character
(pieces of a multibyte character in A, byte fallback in B) are refined by their
decoded bytes.  Places where tokens of both end cut the bytes into groups; every
A token is linked with every B token of its group.

A space or line feed between two other characters that are no white space always
begins a token in both, so texts are cut there into units; a worker aligns each
distinct unit once (``CACHE_UNITS`` are kept; then those met in one run only are forgotten).  A full stop or comma after a letter is
joined to nothing by either, so such a unit is made of the one without it.  Other
vocabularies, where this does not hold, take whole texts as units.

The link counts of an id pair are numbers of documents (rows) that hold it.  Texts that
are null, empty, or whose tokens don't spell the space and the text byte for byte
have no tokens: zeros and ''.  Copies count as often as they occur.

(The library has dropped the name ``immutable_proto``; its ``offset_mapping`` gives the
same spans, in characters.)
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew
from .caches import release
from .storage import drop_tables, materialize
from .token_store import _byte_spelling

MARK = "▁"
CACHE_UNITS = 700_000
#: Units that go through a library at once.
CHUNK = 4096
#: Characters of texts that are worked on at once.
RUN_CHARS = 1_000_000
#: Pair counts are broadcast up to this many pairs (17 bytes each), joined by a shuffle beyond.
BROADCAST_PAIRS = 2_000_000
#: Where texts with other white space are cut (the vowel separator was white space once).
_CUT = re.compile("(?<=[^\\s\u180e])(?=[ \n][^\\s\u180e])")


def _decoded(tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    return np.array([len(t) for t in tokens], np.int64), tokens


class Aligner:
    """Groups of units and whole texts, for one pair of tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {s: k for k, s in _byte_spelling().items()}
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        spelled: list[bytes] = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            spelled[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.a_size, self.a_bytes = _decoded(spelled)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_is_byte = np.array([b.is_byte(i) for i in range(len(pieces))])
        self.b_size, self.b_bytes = _decoded([bytes([int(p[3:5], 16)]) if by else p.replace(MARK, " ").encode() for p, by in zip(pieces, self.b_is_byte, strict=True)])
        self.n_b = len(pieces)
        setup = json.loads(self.a.to_str())
        before = setup["pre_tokenizer"] or {}
        plain = [p for p, by in zip(pieces, self.b_is_byte, strict=True) if not by]
        self.separable = setup["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not any("\n" in p or MARK in p.lstrip(MARK) for p in plain)
        joined = {p[k : k + 2] for p in plain for k in range(len(p) - 1)}
        #: Last characters that a unit may lose, with A's and B's id.
        self.tails = {c: (self.a.token_to_id(c), b.piece_to_id(c)) for c in ".," if self.a.token_to_id(c) is not None and not b.is_unknown(b.piece_to_id(c)) and not any(x[1] == c and x[0].isalpha() for x in joined)}
        self._reset()

    def _reset(self) -> None:
        self.index: dict = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links; -1: not the text's bytes
        self.first, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)  # unit k's links: links[first[k] : first[k + 1]]
        self.used = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep only the units that were met in more than one run, or none if those are too many."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > CACHE_UNITS // 2:
            self._reset()
            return
        place = np.full(len(self.groups), -1)
        place[keep] = np.arange(len(keep))
        to = place.tolist()
        self.index = {k: to[i] for k, i in self.index.items() if to[i] >= 0}
        self.groups = [self.groups[i] for i in keep.tolist()]
        n = np.diff(self.first)[keep]
        self.links = self.links[np.repeat(self.first[keep] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        self.counts, self.first, self.used = self.counts[keep], np.concatenate([[0], np.cumsum(n)]), np.ones(len(keep), np.int64)

    def units(self, text: str) -> list:
        """Keys of a text's units: what follows the space of " word", all of "\\nword", a tuple of any other."""
        if not self.separable:
            return [(" " + text,)]
        if self._even(text):
            return text.replace("\n", " \n").split(" ")
        return [(u,) if not self._even(u[1:]) else u[1:] if u[0] == " " and u[1] != "\n" else u if u[0] == "\n" else (u,) for u in _CUT.split(" " + text)]

    @staticmethod
    def _even(text: str) -> bool:
        """Whether all white space is single spaces and line feeds between other characters."""
        return "\u180e" not in text and text.replace("\n", " ").split(" ") == text.split()

    def _ends(self, ids: np.ndarray, spans: np.ndarray, chars: np.ndarray, size: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Byte places of token ends: of the characters' ends, or, for tokens that are not ``whole`` characters, of decoded bytes."""
        ends = chars[spans]
        return ends if whole.all() else np.where(whole, ends, np.cumsum(size[ids]))

    def _align(self, texts: list[str], a_ids: np.ndarray, a_spans: np.ndarray, b_ids: np.ndarray, b_first: np.ndarray, b_spans: np.ndarray) -> None:
        """Add units.  A's spans are places in all texts joined, B's likewise."""
        joined = "".join(texts)
        raw = joined.encode()
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        chars = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=chars[1:])
        stops = chars[np.cumsum([len(t) for t in texts])]
        shared = np.zeros(len(a_ids), bool)  # tokens of characters that an earlier or later token has, too
        if len(a_ids) > 1:
            over = a_spans[1:, 0] < a_spans[:-1, 1]
            shared[1:] |= over
            shared[:-1] |= over
        a_ends = self._ends(a_ids, a_spans[:, 1], chars, self.a_size, ~shared)
        b_ends = self._ends(b_ids, b_spans, chars, self.b_size, ~self.b_is_byte[b_ids])
        a_unit, b_unit = np.searchsorted(stops, a_ends), np.repeat(np.arange(len(texts)), np.diff(b_first))
        a_first = np.searchsorted(a_unit, np.arange(len(texts) + 1))
        a_list, b_list, at = a_ids.tolist(), b_ids.tolist(), np.concatenate([[0], stops]).tolist()
        a_text, b_text = b"".join([self.a_bytes[i] for i in a_list]), b"".join([self.b_bytes[i] for i in b_list])
        same = np.ones(len(texts), bool)
        if a_text != raw or b_text != raw:
            for k in range(len(texts)):
                own = raw[at[k] : at[k + 1]]
                same[k] = b"".join(self.a_bytes[i] for i in a_list[a_first[k] : a_first[k + 1]]) == own == b"".join(self.b_bytes[i] for i in b_list[b_first[k] : b_first[k + 1]])
        if not same.all():  # one by one, as places don't fit any more
            for k in range(len(texts)):
                if len(texts) == 1:
                    self._put([""], np.array([[-1, 0, 0, 0]]), np.zeros(2, np.int64), np.zeros(0, np.int64))
                else:
                    self._learn_one(texts[k])
            return
        ending = np.zeros((2, len(raw) + 1), bool)
        ending[0, a_ends], ending[1, b_ends] = True, True
        both = ending[0] & ending[1]
        cuts, before = np.flatnonzero(both), np.cumsum(both)
        a_group, b_group = before[a_ends - 1], before[b_ends - 1]
        n = len(cuts)
        na, nb = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        unit_of = np.searchsorted(stops, cuts)
        groups_first = np.searchsorted(unit_of, np.arange(len(texts) + 1))
        # All pairs of a group: each A token as often as the group has B tokens, and those in turn.
        times = nb[a_group]
        place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        b_at = np.repeat((np.cumsum(nb) - nb)[a_group], times) + place
        links = np.repeat(a_ids, times) * self.n_b + b_ids[b_at]
        per_group = np.concatenate([[0], np.cumsum(na * nb)])
        a_words, b_words = [str(i) for i in a_list], [str(i) for i in b_list]
        a_cut, b_cut = np.cumsum(na).tolist(), np.cumsum(nb).tolist()
        shown, x, y = [], 0, 0
        for i, j in zip(a_cut, b_cut, strict=True):
            shown.append((a_words[x] if i == x + 1 else ",".join(a_words[x:i])) + "|" + (b_words[y] if j == y + 1 else ",".join(b_words[y:j])))
            x, y = i, j
        g = groups_first.tolist()
        counts = np.stack([np.diff(a_first), np.diff(b_first), np.diff(groups_first), np.diff(per_group[groups_first])], 1)
        self._put([";".join(shown[g[k] : g[k + 1]]) for k in range(len(texts))], counts, per_group[groups_first], links)

    def _put(self, groups: list[str], counts: np.ndarray, first: np.ndarray, links: np.ndarray) -> None:
        self.groups += groups
        self._new_counts.append(counts)
        self._new_first.append(np.diff(first))
        self._new_links.append(links)

    def _learn_one(self, text: str) -> None:
        """A unit by itself; ``text`` begins with a space unless it begins with a line feed that a cut is before."""
        got = self.a.encode(text, add_special_tokens=False)
        self._from_b([text], np.array(got.ids, np.int64), np.array(got.offsets, np.int64).reshape(-1, 2))

    def _from_b(self, texts: list[str], a_ids: np.ndarray, a_spans: np.ndarray) -> None:
        found = self.b.encode([t[1:] if t[0] == " " else t for t in texts], return_type="offset_mapping", num_threads=1)
        n = np.array([len(x["ids"]) for x in found])
        ids = np.fromiter(chain.from_iterable([x["ids"] for x in found]), np.int64, int(n.sum()))
        spans = np.fromiter(chain.from_iterable(chain.from_iterable([x["offsets"] for x in found])), np.int64, 2 * len(ids))
        length, own = np.array([len(t) for t in texts]), np.array([t[0] == " " for t in texts])
        ends = spans[1::2] + np.repeat(np.cumsum(length) - length + own, n)
        if not own.all():  # without the space that B puts before a text that has none
            kept = np.ones(len(ids), bool)
            kept[(np.cumsum(n) - n)[~own]] = False
            ids, ends, n = ids[kept], ends[kept], n - ~own
        self._align(texts, a_ids, a_spans, ids, np.concatenate([[0], np.cumsum(n)]), ends)

    def learn(self, keys: list) -> None:
        """Align new units, those of one chunk as one text for A."""
        if len(self.index) + len(keys) > CACHE_UNITS:
            raise OverflowError
        self._new_counts, self._new_first, self._new_links = [], [], []
        have = len(self.groups)
        tailed = [k for k in keys if type(k) is str and k[-1:] in self.tails and k[-2:-1].isalpha()]
        bases = {k[:-1] for k in tailed} - self.index.keys()
        plain = [k for k in {*bases, *keys} - set(tailed) if type(k) is str]
        for at in range(0, len(plain), CHUNK):
            chunk = plain[at : at + CHUNK]
            texts = [k if k[:1] == "\n" else " " + k for k in chunk]
            got = self.a.encode("".join(texts), add_special_tokens=False)
            self._from_b(texts, np.array(got.ids, np.int64), np.array(got.offsets, np.int64).reshape(-1, 2))
        self.index.update(zip(plain, range(have, len(self.groups)), strict=True))
        odd = [k for k in keys if type(k) is tuple]
        for k in odd:
            self.index[k] = len(self.groups)
            self._learn_one(k[0])
        self._flush()
        # Chains of such characters ("a.,") end in one that follows no letter, so a base is never made of another here.
        if tailed:
            base = np.array([self.index[k[:-1]] for k in tailed])
            ids = [self.tails[k[-1]] for k in tailed]
            self.index.update(zip(tailed, range(len(self.groups), len(self.groups) + len(tailed)), strict=True))
            self.groups += [f"{self.groups[b]};{i}|{j}" for b, (i, j) in zip(base.tolist(), ids, strict=True)]
            counts = np.where(self.counts[base, :1] < 0, self.counts[base], self.counts[base] + 1)
            lengths = np.diff(self.first)[base]
            links = np.empty(int(lengths.sum()) + len(tailed), np.int64)
            ends = np.cumsum(lengths + 1)
            last = np.zeros(len(links), bool)
            last[ends - 1] = True
            links[last] = [i * self.n_b + j for i, j in ids]
            links[~last] = self.links[np.repeat(self.first[base] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]
            self._new_counts, self._new_first, self._new_links = [counts], [lengths + 1], [links]
            self._flush()

    def _flush(self) -> None:
        self.counts = np.concatenate([self.counts, *self._new_counts])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *self._new_first]))])
        self.links = np.concatenate([self.links, *self._new_links])

    def run(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text counts (as above) and groups; its distinct links, how often each, and where each text's begin."""
        split = [self.units(t) if t else [] for t in texts]
        new = set().union(*split) - self.index.keys()
        if len(self.index) + 2 * len(new) > CACHE_UNITS:
            self._forget()
            new = set().union(*split) - self.index.keys()
            if len(self.index) + 2 * len(new) > CACHE_UNITS:
                self._reset()
                new = set().union(*split)
        self.learn(list(new)) if len(new) * 2 <= CACHE_UNITS else self._learn_all(new)
        get = self.index.__getitem__
        rows = [list(map(get, keys)) for keys in split]
        lengths = np.array([len(r) for r in rows], np.int64)
        flat, doc = np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum())), np.repeat(np.arange(len(rows)), lengths)
        met = np.zeros(len(self.groups), np.int64)
        met[flat] = 1
        self.used = np.concatenate([self.used, np.zeros(len(met) - len(self.used), np.int64)]) + met
        own = self.counts[flat]
        bad = np.bincount(doc[own[:, 0] < 0], minlength=len(rows)) > 0
        counts = np.stack([np.bincount(doc, own[:, c], len(rows)).astype(np.int64) for c in range(4)], 1)
        counts[bad] = 0
        groups = self.groups
        shown = ["" if gone or not r else ";".join([groups[k] for k in r]) for r, gone in zip(rows, bad.tolist(), strict=True)]
        keep = ~bad[doc]
        units, often = np.unique(doc[keep] * np.int64(len(groups) + 1) + flat[keep], return_counts=True)
        d, u = np.divmod(units, np.int64(len(groups) + 1))
        n = self.first[u + 1] - self.first[u]
        link = self.links[np.repeat(self.first[u] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        d, often = np.repeat(d, n), np.repeat(often, n)
        order = np.lexsort((link, d))
        d, link, often = d[order], link[order], often[order]
        start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (link[1:] != link[:-1])])) if len(d) else np.zeros(0, np.int64)
        times = np.add.reduceat(often, start) if len(start) else np.zeros(0, np.int64)
        return counts, shown, link[start], times, np.searchsorted(d[start], np.arange(len(rows) + 1))

    def _learn_all(self, keys: Iterable) -> None:
        """One text's distinct units, if they alone are more than the cache should hold."""
        global CACHE_UNITS
        limit, CACHE_UNITS = CACHE_UNITS, 1 << 60
        try:
            self.learn(list(keys))
        finally:
            CACHE_UNITS = limit


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for all tasks of a worker, so that its units last."""
    return Aligner(a_path, b_path)


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > RUN_CHARS or k + 1 == len(texts):
            yield at, k + 1
            at, size = k + 1, 0


ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


def _aligned(batches: Iterable[pa.RecordBatch], a_path: str, b_path: str, full: bool) -> Iterator[pa.RecordBatch]:
    release()
    with_bytes = aligner(a_path, b_path)
    gc.disable()  # millions of cached strings and no cycles: collections would only walk over them
    try:
        for batch in batches:
            yield from _aligned_batch(with_bytes, batch, full)
    finally:
        gc.enable()


def _aligned_batch(with_bytes: Aligner, batch: pa.RecordBatch, full: bool) -> Iterator[pa.RecordBatch]:
    ids, texts = batch.column(0), batch.column(1).to_pylist()
    for a, b in _runs(texts):
        counts, groups, links, times, first = with_bytes.run(texts[a:b])
        out = [ids.slice(a, b - a), *(pa.array(counts[:, c], pa.int64()) for c in range(4))]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        if full:
            yield pa.RecordBatch.from_arrays([*out, pa.array(groups)], names=[*names, "groups"])
        else:
            at = pa.array(first, pa.int32())
            some = [pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]), pa.ListArray.from_arrays(at, pa.array(links, pa.int64())), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*out, *some], names=[*names, "groups_sha256", "links", "times"])


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links and ``groups`` (``a1,a2|b1;a3|b2``) of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _aligned(it, a_path, b_path, True), ROW + ", groups string")


def _scored(batches: Iterable[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    pairs, counts, best = table.value
    for batch in batches:
        links, times = batch.column(batch.schema.get_field_index("links")), batch.column(batch.schema.get_field_index("times"))
        n = np.diff(np.asarray(links.offsets))
        doc, often = np.repeat(np.arange(len(n)), n), np.asarray(times.flatten()).astype(np.int64)
        at = np.searchsorted(pairs, np.asarray(links.flatten()))
        sums = []
        for value in (best[at] * often, counts[at] * often):
            total = np.concatenate([[0], np.cumsum(value)])
            ends = np.cumsum(n)
            sums.append(pa.array(total[ends] - total[ends - n], pa.int64()))
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        del doc
        yield pa.RecordBatch.from_arrays([*kept, *sums, batch.column(batch.schema.get_field_index("groups_sha256"))], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """``pair, count, best`` (1 if no pair of its A id has more)."""
    counts = materialize(rows.select(F.explode("links").alias("pair")).groupBy("pair").count(), "pair-counts")
    top = F.broadcast(counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("count").alias("most")))  # a row for each id of A's vocabulary
    return counts.join(top, F.expr(f"pair div {n_b}") == top["a"]).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def alignment_report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: counts, n_best, count_sum and the hash of its groups."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(rows.mapInArrow(lambda it: _aligned(it, a_path, b_path, False), ROW + ", groups_sha256 string, links array<long>, times array<int>"), "alignments")
    counts = materialize(_pair_counts(rows, n_b), "pair-table")
    if counts.count() <= BROADCAST_PAIRS:
        found = counts.orderBy("pair").toArrow()
        table = docs.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("pair", "count", "best")))
        return rows.mapInArrow(lambda it: _scored(it, table), ROW + ", n_best long, count_sum long, groups_sha256 string")
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # a stored table: the same in every run
    links = rows.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("pair"), F.col("x.times").alias("times"))
    hot = skew.hot_keys(counts.select("pair", "count"), ["pair"], counts.agg(F.sum("count")).first()[0])
    met = skew.dealt(links, hot, ["pair"], ["row"]).join(skew.copied(counts, hot, ["pair"]), ["pair", skew.SALT])
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
