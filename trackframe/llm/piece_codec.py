"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is a row of symbols: its characters, with ``▁`` for a space and one
``▁`` put in front.  An agenda holds adjacent pairs whose concatenation is a
piece; the pair of the best score (leftmost on ties) is merged and its new
neighbours enter the agenda, until none is left.  Symbols that are no piece
become their UTF-8 bytes.

If no piece holds ``▁`` after another character, no merge crosses the border
before a run of ``▁``, so a text is cut there into units, each distinct unit is
encoded once for an Arrow batch and kept in a bounded cache of two generations.
Units of an Arrow batch are checked against the sentencepiece library; a
difference raises.

Null text counts as empty: no ids, empty decoded text.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import TwoGenerations

MARK = "▁"
#: Units of a generation of a worker's cache.
CACHE_UNITS = 500_000
#: Longer units go through the heap one by one, shorter ones through the array agenda together.
ARRAY_CHARS = 24
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")
_NONE = np.int64(1) << 40
#: Numbers of symbols: below PART ids of pieces; from PART parts that only merging makes; from UNKNOWN code points that are no piece.
PART, UNKNOWN = 1 << 20, 1 << 30


class MergeTable:
    """Pieces of a vocabulary: ids of single characters and of mergeable pairs with their rank (0: best score)."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in normal}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.separable = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.rank = {sp.id_to_piece(i): r for r, i in enumerate(order)}
        #: Each way of splitting a piece into two symbols.  Characters that are no piece get ids from ``size`` on, as they come.
        self.symbol = dict(self.id_of)
        pairs = {}
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                pairs[self._symbol(piece[:k]), self._symbol(piece[k:])] = (self.rank[piece], i)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.pair_keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.char_symbol = np.array([self.symbol.get(chr(c), UNKNOWN + c) for c in range(0x2600)], np.int64)
        self.name = {i: s for s, i in self.symbol.items()}
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)[by]
        self.pair_rank, self.pair_id = np.append(values[:, 0], _NONE), np.append(values[:, 1], -1)

    def _symbol(self, s: str) -> int:
        return self.symbol.setdefault(s, PART + len(self.symbol))

    def ids_of(self, symbol: int) -> list[int]:
        return [symbol] if symbol < PART else self.emit(chr(symbol - UNKNOWN) if symbol >= UNKNOWN else self.name[symbol])

    def emit(self, symbol: str) -> list[int]:
        """Ids of a symbol that merges no further."""
        found = self.id_of.get(symbol)
        return [found] if found is not None else [self.byte_id[b] for b in symbol.encode()]


def encode_with_agenda(table: MergeTable, text: str) -> list[int]:
    """Ids of a text that has its marks already; a heap of pairs and a linked list of symbols."""
    symbols = list(text)
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda: list[tuple[int, int, str]] = []

    def offer(left: int) -> None:
        if left >= 0 and after[left] >= 0:
            both = symbols[left] + symbols[after[left]]
            rank = table.rank.get(both)
            if rank is not None:
                heapq.heappush(agenda, (rank, left, both))

    for k in range(n - 1):
        offer(k)
    while agenda:
        _, left, both = heapq.heappop(agenda)
        right = after[left]
        if right < 0 or not symbols[left] or symbols[left] + symbols[right] != both:
            continue
        symbols[left], symbols[right] = both, ""
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        offer(before[left])
        offer(left)
    return [i for s in symbols if s for i in table.emit(s)]


def encode_units(table: MergeTable, units: list[str]) -> list[list[int]]:
    """The same for many short units at once: every round merges the best pair of each unit."""
    out: list[list[int]] = [[]] * len(units)
    lengths = np.array([len(u) for u in units])
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):  # units of about one length together
        to = at + max(1, int(np.searchsorted(lengths[order[at:]], lengths[order[at]] * 1.3, "right")))
        _encode_grid(table, units, order[at:to], out)
        at = to
    return out


def _encode_grid(table: MergeTable, units: list[str], rows: np.ndarray, out: list[list[int]]) -> None:
    width = max(len(units[k]) for k in rows) + 1
    codes = np.frombuffer("".join([units[k].ljust(width, "\ue000") for k in rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), width)
    known = table.char_symbol
    grid = np.where(codes < len(known), known[np.minimum(codes, len(known) - 1)], -2)
    for r, c in zip(*np.nonzero(grid == -2), strict=True):
        grid[r, c] = table.symbol.get(chr(codes[r, c]), UNKNOWN + int(codes[r, c]))
    grid[np.arange(width) >= np.array([len(units[k]) for k in rows])[:, None]] = -1
    last = len(table.pair_rank) - 1

    def look(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left >= 0) & (right >= 0), (left << 32) | right, -1)
        at = np.searchsorted(table.pair_keys, key)
        return np.where(table.pair_keys[at] == key, at, last)

    pair = look(grid[:, :-1], grid[:, 1:])
    rank = table.pair_rank[pair]
    columns = np.arange(width)
    while len(rows):
        best = np.argmin(rank, 1)
        each = np.arange(len(rows))
        go = rank[each, best] < _NONE
        if not go.all():
            done = grid[~go]
            for r, ids, n, plain in zip(rows[~go].tolist(), done.tolist(), (done >= 0).sum(1).tolist(), (done < PART).all(1).tolist(), strict=True):
                out[r] = ids[:n] if plain else [i for s in ids[:n] for i in table.ids_of(s)]
            rows, grid, pair, rank, best = rows[go], grid[go], pair[go], rank[go], best[go]
            each = np.arange(len(rows))
            if not len(rows):
                return
        made = table.pair_id[pair[each, best]]
        width = grid.shape[1] - 1
        moved = columns[:width] + (columns[:width] > best[:, None])
        grid = np.concatenate([np.take_along_axis(grid, moved, 1), np.full((len(rows), 1), -1)], 1)
        grid[each, best] = made
        moved = moved[:, : width - 1] if width > 1 else moved
        keep = np.take_along_axis(pair, np.minimum(moved, width - 1), 1)
        pair = np.concatenate([keep, np.full((len(rows), 1), last)], 1)
        for near in (best - 1, best):
            ok = near >= 0
            pair[each[ok], near[ok]] = look(grid[each[ok], near[ok]], grid[each[ok], near[ok] + 1])
        rank = table.pair_rank[pair]


class PieceCodec:
    """Encodes and decodes whole texts; keeps for each unit its ids as text and its decoded text."""

    def __init__(self, model_path: str):
        self.table = MergeTable(model_path)
        self.cache = TwoGenerations(CACHE_UNITS)  # of (bytes, str)

    def _learn(self, keys: list[str]) -> None:
        table = self.table
        units = [MARK + k for k in keys]
        short = [u for u in units if len(u) <= ARRAY_CHARS]
        ids = dict(zip(short, encode_units(table, short), strict=True))
        ids |= {u: encode_with_agenda(table, u) for u in units if len(u) > ARRAY_CHARS}
        own = [ids[u] for u in units]
        plain = [k.replace(MARK, " ") for k in keys]
        checked = [i if k else [] for k, i in zip(keys, own, strict=True)]  # a mark alone is an empty text for the library
        if checked != table.library.encode(plain, num_threads=1):
            raise ValueError("ids differ from the sentencepiece library's")
        decoded = table.library.decode(own, num_threads=1) if own else []
        # Most units decode to themselves, so one string serves as key and value.
        self.cache.add((k, (",".join(map(str, i)).encode(), k if d == k else d)) for k, i, d in zip(keys, own, decoded, strict=True))

    def _units(self, text: str) -> list[str]:
        """Keys of a text's units: each without its first mark."""
        if not text:
            return []
        if not self.table.separable:
            return [text.replace(" ", MARK)]
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [u[1:] for u in _UNIT.findall(MARK + text.replace(" ", MARK))]

    def run(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text: its ids as decimal numbers joined by commas, and its decoded text."""
        split = [self._units(t or "") for t in texts]
        new = self.cache.missing(set().union(*split))
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        get = self.cache.young.__getitem__
        for units in split:
            found = list(map(get, units))
            yield b",".join([x[0] for x in found]), " ".join([x[1] for x in found]).encode()


@lru_cache(maxsize=2)
def piece_codec(model_path: str) -> PieceCodec:
    """One codec for all tasks of a worker, so that its cache lasts."""
    return PieceCodec(model_path)


def _batches(batches: Iterable[pa.RecordBatch], model_path: str, full: bool) -> Iterator[pa.RecordBatch]:
    codec = piece_codec(model_path)
    gc.disable()  # millions of cached strings and no cycles: collections would only walk over them
    try:
        for batch in batches:
            yield from _encoded(codec, batch, full)
    finally:
        gc.enable()


def _encoded(codec: PieceCodec, batch: pa.RecordBatch, full: bool) -> Iterator[pa.RecordBatch]:
    key, texts = batch.column(0), batch.column(1).to_pylist()
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size < 1_500_000 and k + 1 < len(texts):
            continue
        done = list(codec.run(texts[at : k + 1]))
        out = [key.slice(at, k + 1 - at), pa.array([i.count(b",") + 1 if i else 0 for i, _ in done], pa.int64())]
        if full:
            out.append(pa.array([np.array(i.split(b","), np.int64) if i else [] for i, _ in done], pa.list_(pa.int64())))
            out.append(pa.array([d.decode() for _, d in done], pa.string()))
        else:
            out.append(pa.array([hashlib.sha256(i).hexdigest() for i, _ in done]))
            out.append(pa.array([hashlib.sha256(d).hexdigest() for _, d in done]))
        yield pa.RecordBatch.from_arrays(out, names=batch.schema.names[:1] + (["n_tokens", "ids", "decoded"] if full else ["n_tokens", "ids_sha256", "decoded_sha256"]))
        at, size = k + 1, 0


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids and decoded text of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _batches(it, model_path, True), f"{id_col} long, n_tokens long, ids array<long>, decoded string")


def piece_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """The same as checksums, which spares large columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _batches(it, model_path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
