"""Token ids in a binary store that gives access to single documents.

A store is a folder of two Parquet tables.  ``dictionary`` has one row: the
zstandard dictionary and its SHA-256.  ``blocks`` has a row for each run of
consecutive documents (ascending id, about ``block_bytes`` of payload):

``shard, block``  place in document order
``first_doc, last_doc``  smallest and largest id, so a reader skips blocks by Parquet statistics
``dictionary_sha256``  hash of the dictionary that the payload needs
``n_docs, n_tokens``  totals of the block
``index``  little-endian arrays one after another: int64 document ids, uint8 flags (1: id is null),
           uint64 payload offsets (n_docs + 1), uint32 token counts
``payload``  one zstandard frame per document: its ids as little-endian unsigned 32-bit integers

Null text counts as empty (only the end id is stored).  Null ids sort first.
Documents that share an id are all stored; their order follows their checksum.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import drop_tables, fresh_path, materialize

#: Cached words of a worker; when full the cache starts anew.
CACHE_WORDS = 400_000
#: Tokens for each range of ids in which blocks are written.
RANGE_TOKENS = 24_000_000


#: Words of these characters are lower-cased, cut and spelled in bytes here, which equals the tokenizer's own
#: normaliser and pre-tokenizer on them; its model then gives the ids.  Other words go through all of the library.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_spelling() -> dict[int, str]:
    """For ``str.translate``: each byte, read as Latin-1, as the printable character that byte-level vocabularies use."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """Ids of a text as bytes, from the tokenizers library's ids of its words.

    The tokenizer's pre-tokens never hold white space and its normaliser joins
    nothing across it, so ids of a text are the ids of its words in order;
    each distinct word is encoded by the library once.
    """

    def __init__(self, tokenizer_path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        setup = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in setup["normalizer"]["normalizers"]] if (setup["normalizer"] or {}).get("type") == "Sequence" else []
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(setup["pre_tokenizer"]).replace("\\\\", "\\")
        self.special = [t["content"] for t in setup["added_tokens"]]
        self.spelling = _byte_spelling()
        self.end = np.array([end_id], "<u4").tobytes()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelled = piece.encode().decode("latin-1").translate(self.spelling)
            found = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelled))
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces = {}
            self.pieces[piece] = found
        return found

    def _learn(self, words: Iterable[bytes]) -> None:
        rest = []
        for word in words:
            text = word.decode()
            if self.plain and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                self.words[word] = b"".join([self._piece(p) for p in _PIECES.findall(text.lower())])
            else:
                rest.append((word, text))
        for word, text in rest:
            self.words[word] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        split = [t.split() if t else [] for t in texts]
        new = set().union(*split) - self.words.keys()
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words = {}
            new = set().union(*split)
        self._learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) + self.end for words in split]


@lru_cache(maxsize=2)
def word_encoder(tokenizer_path: str, end_id: int) -> WordEncoder:
    """One encoder for all tasks of a worker, so that its caches last."""
    return WordEncoder(tokenizer_path, end_id)


def _runs(texts: list, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size > limit:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, sample_docs: int = 400, max_chars: int = 20_000, size: int = 65_536) -> bytes:
    """A zstandard dictionary from at most ``sample_docs`` documents of at most ``max_chars`` characters.

    The sample is those with the smallest hash of their id.  It only shapes
    compression.  With too few samples for training, their plain bytes serve
    as the dictionary (none: an empty one).
    """
    ids = [r[0] for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    sample = docs.where(F.col("doc_id").isin([i for i in ids if i is not None]) & (F.length("text") <= max_chars))
    texts = [r[0] for r in sample.orderBy("doc_id").limit(sample_docs).select(F.col("text").cast("binary")).collect()]
    samples = word_encoder(tokenizer_path, end_id).encode([bytes(t) for t in texts])
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _encode(batches: Iterable[pa.RecordBatch], tokenizer_path: str, end_id: int, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(tokenizer_path, end_id)
    pack = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=1)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in _runs(texts):
            raw = encoder.encode(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([pack.compress(x) for x in raw], pa.binary())],
                names=["doc_id", "n_tokens", "order_key", "frame"],
            )


def _blocks(batches: Iterable[pa.RecordBatch], digest: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    block, docs, frames, counts = 0, [], [], []
    shard = None

    def flush() -> pa.RecordBatch:
        known = [d for d in docs if d is not None]
        index = b"".join(
            (
                np.array([d or 0 for d in docs], "<i8").tobytes(),
                np.array([d is None for d in docs], "u1").tobytes(),
                np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes(),
                np.array(counts, "<u4").tobytes(),
            )
        )
        row = {"shard": shard, "block": block, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "dictionary_sha256": digest, "n_docs": len(docs), "n_tokens": sum(counts), "index": index, "payload": b"".join(frames)}
        return pa.RecordBatch.from_pylist([row], schema=BLOCK_ARROW)

    size = 0
    for batch in batches:
        for doc, n, frame, part in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_tokens", "frame", "shard")), strict=True):
            shard = part
            docs.append(doc)
            counts.append(n)
            frames.append(frame)
            size += len(frame)
            if size >= block_bytes:
                yield flush()
                block, size, docs, frames, counts = block + 1, 0, [], [], []
    if docs:
        yield flush()


BLOCK_SCHEMA = "shard int, block int, first_doc long, last_doc long, dictionary_sha256 string, n_docs long, n_tokens long, index binary, payload binary"
BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dictionary_sha256", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("index", pa.binary()), ("payload", pa.binary())])


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_bytes: int = 1 << 20) -> None:
    """Encode whole texts and write a store at ``path`` (any file system that Spark writes).

    Only compressed frames are sorted, not texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    frames = materialize(
        docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(lambda it: _encode(it, tokenizer_path, end_id, dictionary), "doc_id long, n_tokens long, order_key long, frame binary"),
        "frames",
    )
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (frames.agg(F.sum("n_tokens")).first()[0] or 0) // RANGE_TOKENS)
    (
        frames.repartitionByRange(ranges, "doc_id", "order_key")
        .sortWithinPartitions("doc_id", "order_key", "n_tokens", "frame")
        .withColumn("shard", F.spark_partition_id())
        .mapInArrow(lambda it: _blocks(it, digest, block_bytes), BLOCK_SCHEMA)
        .write.parquet(f"{path}/blocks")
    )
    drop_tables(frames)


def _read(batches: Iterable[pa.RecordBatch], dictionary: bytes, wanted: set | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    digest = hashlib.sha256(dictionary).hexdigest()
    for batch in batches:
        for row in batch.to_pylist():
            if row["dictionary_sha256"] != digest:
                raise ValueError("block needs another dictionary")
            n, index, payload = row["n_docs"], row["index"], row["payload"]
            docs, null = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n).astype(bool)
            at = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64)
            counts = np.frombuffer(index, "<u4", n, 9 * n + 8 * (n + 1)).astype(np.int64)
            starts = row["base"] + np.cumsum(counts) - counts
            take = [k for k in range(n) if wanted is None or (not null[k] and int(docs[k]) in wanted)]
            raw = [unpack.decompress(payload[at[k] : at[k + 1]]) for k in take]
            out = [pa.array([None if null[k] else int(docs[k]) for k in take], pa.int64()), pa.array(starts[take], pa.int64()), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in raw], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    With ``doc_ids`` (a short list), only blocks whose id range holds one are
    read and only those documents are decompressed.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").select("dictionary").first()[0])
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    shards = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("shard_base"))  # a row for each shard
    within = blocks.select("shard", "block", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("block_base"))
    base = within.join(shards, "shard").select("shard", "block", (F.col("shard_base") + F.col("block_base")).alias("base"))
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        hit = F.lit(False)
        for d in wanted:
            hit = hit | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
        blocks = blocks.where(hit)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.join(base, ["shard", "block"]).mapInArrow(lambda it: _read(it, dictionary, wanted, with_ids), schema)


def token_store_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write a store of ``docs`` to the shared folder, read it back and return doc_id, start, n_tokens, ids_crc32."""
    path = fresh_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer_path, end_id)
    return read_store(docs.sparkSession, path, with_ids=False)
