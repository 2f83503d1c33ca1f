"""Operators and pipeline stages against plain Python on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from trackframe.llm import chunk_dedup, jaccard, language_model, mixing, piece_codec, quality, skew, suffix_dedup, token_store, toxicity  # noqa: E402
from trackframe.llm.caches import TwoGenerations  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES, BYTES = "piece_bpe_32k.model", "word_bpe_49k.json"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def prose(r, n, known=[]):  # noqa: B006
    if not known:
        known += ["".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(2, 9)))) for _ in range(3000)]
    return " ".join(known[int(k)] for k in r.integers(0, 3000, n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with exact and near copies, shared passages, repeated rows, nulls and empty texts."""
    r = np.random.default_rng(33)
    texts = [prose(r, int(r.integers(5, 250))) for _ in range(120)]
    shared = prose(r, 90)
    for k in range(0, 60, 6):
        texts[k] = prose(r, 40) + " " + shared + " " + prose(r, 30)
    near = texts[70].split(" ") + prose(r, 120).split(" ")
    texts += [" ".join(near), " ".join([*near[:50], "other", *near[51:]]), texts[3], texts[3], None, "", " \t\n", "Tail " + texts[4]]
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None) for k, t in enumerate(texts)]
    rows += [rows[3], rows[7], (None, texts[9], None, "s1"), (7, texts[8], "de", "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_of_any_name(spark, corpus):
    odd = corpus.selectExpr("doc_id", "text", "lang", "source", "doc_id AS note", "'i' AS __id", "'t' AS __text", "1 AS __text_hash", "2 AS __n", "'w' AS __whole", "3L AS N_BYTES", "4 AS `a.b`", "5 AS `back``tick`", "6 AS part", "7 AS copies", "8 AS __salt")
    for drop in (suffix_dedup.drop_repeated_strings, chunk_dedup.drop_repeated_passages):
        plain, got = drop(corpus), drop(odd)
        assert got.columns == [c for c in odd.columns if c != "N_BYTES"] + ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        some = ("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert Counter(map(tuple, got.select(*some).collect())) == Counter(map(tuple, plain.select(*some).collect()))
        assert {r["a.b"] for r in got.collect()} == {4}
    for keep in (jaccard.keep_one_of_each, mixing.mix_repeated):
        plain, got = keep(corpus), keep(odd)
        assert got.columns == odd.columns
        assert Counter(rows_of(got)) == Counter(rows_of(plain)) and {r["a.b"] for r in got.collect()} == {4}


def brute_chunks(data: bytes) -> list[bytes]:
    """Chunks by the module's rule, one byte at a time (texts with spaces often enough that no stretch exceeds the longest chunk)."""
    gear, h, ends = chunk_dedup._GEAR.tolist(), 0, []
    recent: list[int] = []
    for k, b in enumerate(data):
        recent = [b, *recent][:16]
        h = sum(gear[x] << j for j, x in enumerate(recent)) & 0xFFFFFFFF
        inside = k + 1 == len(data) or data[k + 1] & 0xC0 != 0x80
        if k + 1 >= 16 and inside and (h >> 16) < (65536 // 3 if b in b" \t\n\x0b\x0c\r" else 65536 // 2048):
            ends.append(k + 1)
    ends = [e for j, e in enumerate(ends) if e - (ends[j - 1] if j else -16) >= 16]
    ends = sorted({*ends, len(data)})
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def brute_passages(rows, hashes, least=80):
    """Remaining bytes of each row: a run of chunks goes that an earlier document (id, text hash, place) holds."""
    first: dict = {}
    pieces = [brute_chunks((t or "").encode()) if t else [] for _, t in rows]
    for (i, _), h, chunks in zip(rows, hashes, pieces, strict=True):
        for place, c in enumerate(chunks):
            at = (i is not None, i or 0, h, place)
            first[c] = min(first.get(c, at), at)
    out = []
    for (i, _), h, chunks in zip(rows, hashes, pieces, strict=True):
        gone, kept, run = [first[c] != (i is not None, i or 0, h, place) for place, c in enumerate(chunks)], b"", b""
        for c, g in zip([*chunks, b""], [*gone, False], strict=True):
            if g:
                run += c
            else:
                kept += (run if len(run) < least else b"") + c
                run = b""
        out.append(kept)
    return out


def test_chunk_dedup(corpus):
    got = chunk_dedup.drop_repeated_passages(corpus.withColumn("h", F.xxhash64("text"))).collect()
    rows = corpus.withColumn("h", F.xxhash64("text")).collect()
    want = brute_passages([(r.doc_id, r.text) for r in rows], [r.h for r in rows])
    as_row = lambda i, t, kept: (i, len((t or "").encode()), len((t or "").encode()) - len(kept), hashlib.sha256(kept).hexdigest(), None if t is None else kept.decode())
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256, r.text) for r in got) == Counter(as_row(r.doc_id, r.text, k) for r, k in zip(rows, want, strict=True))
    assert sum(r.n_removed > 0 for r in got) > 8


def test_hot_chunks_are_salted_alike(corpus, monkeypatch):
    plain = Counter(map(tuple, chunk_dedup.drop_repeated_passages(corpus).collect()))
    monkeypatch.setattr(skew, "KEYS_A_TASK", 100_000)
    assert Counter(map(tuple, chunk_dedup.drop_repeated_passages(corpus).collect())) == plain
    sets = Counter(map(tuple, jaccard.jaccard_components(corpus).collect()))
    monkeypatch.undo()
    assert Counter(map(tuple, jaccard.jaccard_components(corpus).collect())) == sets


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and part[a] != part[b]:
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    return sets, part


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_jaccard(corpus, percent):
    rows = rows_of(corpus)
    sets, part = brute_components(rows, 4, percent)
    least = {p: min((rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None), default=None) for p in part}
    want = Counter((rows[k][0], len(sets[k]), least[part[k]] if sets[k] else rows[k][0]) for k in range(len(rows)))
    assert Counter(tuple(r) for r in jaccard.jaccard_components(corpus, 4, percent).collect()) == want


def test_full_buckets_come_out_in_rows(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(2)
    value, node, scheme = r.integers(0, 40, 600).astype(np.uint64), r.integers(0, 90, 600).astype(np.uint64), np.ones(600, np.uint16)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), *(pa.array([x[a:b].tobytes()], pa.binary()) for x in (value, node, scheme))], names=["bucket", "signatures", "nodes", "schemes"])
    batches = [batch(0, 250), batch(250, 500), batch(500, 600)]
    whole = [b for b in jaccard._groups(batches)]
    monkeypatch.setattr(jaccard, "HELD_SIGNATURES", 200)
    parts = [b for b in jaccard._groups(batches)]
    pairs = {(v, n) for b in parts for v, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)}
    assert pairs == set(zip(value.tolist(), node.tolist(), strict=True)) and all(m == 0 for b in parts for m in b.column(3).to_pylist())
    groups: dict = {}
    for b in whole:
        for g, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            groups.setdefault(g, set()).add(n)
    by_value = {frozenset(node[value == v].tolist()) for v in set(value.tolist())}
    assert {frozenset(g) for g in groups.values()} == {s for s in by_value if len(s) > 1}


def test_language_model_counts(corpus):
    rows = rows_of(corpus)
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    tokens = [[*WORD.findall(lower(t or "")), None] for _, t in rows]
    count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total, distinct = sum(count.values()), len(count)
    want = Counter(
        (i, h, len(t), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t), 4)) for (i, _), h, t in zip(rows, held, tokens, strict=True)
    )
    got = language_model.score_documents(corpus).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_streams_hold_every_text_whole():
    r = np.random.default_rng(4)
    texts = [r.integers(0, 99, int(n)) for n in (1, 700, *r.integers(1, 60, 90))]
    symbol, begin, length = language_model.streams(texts)
    found = []
    for k in range(symbol.shape[1]):
        cuts = [*np.flatnonzero(begin[: length[k], k]), length[k]]
        found += [tuple(symbol[a:b, k]) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert Counter(found) == Counter(tuple(t) for t in texts) and list(length) == sorted(length, reverse=True)


def test_copies_are_averaged_in_levels(spark):
    r = np.random.default_rng(6)
    values, seen = r.standard_normal((150, 5)).astype(np.float32), r.integers(1, 9, 150)
    df = spark.createDataFrame([(k, 0, int(seen[k]), bytearray(values[k].tobytes())) for k in range(150)], "task int, part int, seen long, weights binary")
    (row,) = language_model.average(df, 150).collect()
    assert np.allclose(np.frombuffer(row.weights, np.float32), (values * seen[:, None]).sum(0) / seen.sum(), atol=1e-6)


def brute_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(size.values())
    goal, free = {}, list(order)
    while True:
        left, w = total - sum(goal.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * size[s]]
        if not over:
            return goal | {s: left * weight[s] / w for s in free}
        for s in over:
            goal[s] = 3.0 * size[s]
            free.remove(s)


def test_mixing(spark, corpus, monkeypatch):
    r = np.random.default_rng(8)
    sizes = np.minimum(np.exp(r.normal(4.0, 1.3, 3000)).astype(int), 20_000)
    sizes[:3] = 20_000, 9_000, 1
    long = spark.createDataFrame([(k, f"t{k % 5}" if k % 11 else None, int(n)) for k, n in enumerate(sizes)], "doc_id long, source string, n int").select("doc_id", F.expr("repeat('w\\n', n)").alias("text"), "source")
    for df, within, block in ((corpus, 0.2, 2000), (long, 0.005, 2000), (long, 0.005, 300)):
        monkeypatch.setattr(mixing, "BLOCK", block)
        monkeypatch.setattr(mixing, "MERGED", max(2, block // (2 + mixing.RESERVE)))
        rows = [(x.doc_id, x.source, len(WORD.findall(x.text or ""))) for x in df.collect()]
        size = Counter()
        for _, s, n in rows:
            size[s] += n
        goal = brute_targets(dict(size))
        got = mixing.mix_sources(df).collect()
        assert Counter((x.doc_id, x.source, x.size, x.source_size, round(x.target, 6)) for x in got) == Counter((i, s, n, size[s], round(goal[s], 6)) for i, s, n in rows)
        assert all(0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size for x in got)
        for s in size:
            taken = sum(x.taken for x in got if x.source == s)
            assert abs(taken - goal[s]) <= within * goal[s] + 30, (s, taken, goal[s])
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sources(df.repartition(7)).collect()))


def test_two_generations_forget_only_what_is_rare():
    cache, asked = TwoGenerations(10), Counter()
    r = np.random.default_rng(9)
    for turn in range(200):
        keys = {"always", *(f"rare{turn}_{k}" for k in range(int(r.integers(0, 5))))}
        for k in cache.missing(keys):
            asked[k] += 1
            cache.add([(k, k.upper())])
        assert all(cache.young[k] == k.upper() for k in keys) and len(cache.young) <= 10
    assert asked["always"] == 1


def test_held_out_and_predicted(corpus, spark):
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(corpus, labels).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0) for i, _ in rows_of(corpus))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_very_long_texts(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    r = np.random.default_rng(10)
    long = prose(r, 1_000_000)
    assert len(long) > 5_000_000
    rows = [(1, long), (2, long[:3_000_000] + " end"), (3, prose(r, 60)), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    text = dict(rows)
    counts = {x.doc_id: x for x in quality.base_counts(df).collect()}
    assert all(counts[i].n_words == len(WORD.findall(t or "")) for i, t in rows)
    sets, part = brute_components(rows, 4, 85)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df).collect()} == {rows[k][0]: (len(sets[k]), rows[part[k]][0]) for k in range(4)}
    one = {x.doc_id: x for x in suffix_dedup.drop_repeated_strings(df).select("doc_id", "n_removed", "n_spans").collect()}
    assert (one[2].n_removed, one[2].n_spans, one[3].n_removed) == (3_000_000, 1, 0) and one[1].n_removed == 3_000_000
    two = {x.doc_id: x.n_removed for x in chunk_dedup.drop_repeated_passages(df).select("doc_id", "n_removed").collect()}
    assert two[1] < 1000 and 2_999_000 < two[2] <= 3_000_004
    model = {x.doc_id: x for x in language_model.score_documents(df).collect()}
    assert all(model[i].n_tokens == len(WORD.findall(t or "")) + 1 for i, t in rows)
    path = public_tokenizers.path(PIECES)
    ids = sentencepiece.SentencePieceProcessor(model_file=path).encode(long)
    assert {x.doc_id: x.ids_sha256 for x in piece_codec.piece_digest(df, path).collect()}[1] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    path = public_tokenizers.path(BYTES)
    ids = Tokenizer.from_file(path).encode(text[2], add_special_tokens=False).ids + [1]
    stored = {x.doc_id: x for x in token_store.token_store_digest(df, path).collect()}
    assert stored[2].n_tokens == len(ids) and stored[2].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(df, labels).count() == 4 and mixing.mix_sources(df).count() == 4


def test_empty_tables(spark, corpus):
    import corpus_pipeline

    none = corpus.limit(0)
    assert token_store.token_store_digest(none, public_tokenizers.path(BYTES)).count() == 0
    assert piece_codec.piece_digest(none, public_tokenizers.path(PIECES)).count() == 0
    assert jaccard.jaccard_components(none).count() == 0 and mixing.mix_repeated(none).count() == 0
    docs = none.withColumn("n_chars", F.length("text"))
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, "").count() == 0


def test_pipeline_stages(spark, corpus, tmp_path):
    """Each stage on what its predecessor kept."""
    import sentencepiece

    import corpus_pipeline

    docs = corpus.withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(k, 1, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    path = lambda name: f"file://{tmp_path}/{name}"

    def through(name, docs):
        out = stages[name](spark, docs, f"file://{tmp_path}")
        assert name == "encode" or out.columns == docs.columns
        out.write.parquet(path(name))
        return spark.read.parquet(path(name))

    kept = through("quality_rules", docs)  # labels call all good, so only the base rule rejects
    failed = {(x.doc_id, x.lang) for x in quality.base_counts(docs).collect() if x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words}
    assert Counter(rows_of(kept)) == Counter((x.doc_id, x.text) for x in docs.collect() if (x.doc_id, x.lang) not in failed)
    rows = rows_of(kept)
    _, part = brute_components(rows, 5, 80)
    best: dict = {}
    for (i, t), p in zip(rows, part, strict=True):
        best.setdefault(p, []).append((i is None, i, t))
    near = through("near_duplicates", kept)
    assert Counter(i for i, _ in rows_of(near)) == Counter(min(b, key=lambda x: (x[0], x[1] or 0))[1] for b in best.values())
    hashed = near.withColumn("h", F.xxhash64("text")).collect()
    want = brute_passages([(x.doc_id, x.text) for x in hashed], [x.h for x in hashed])
    fresh = through("repeated_passages", near)
    assert Counter((x.doc_id, x.text, x.n_chars) for x in fresh.collect()) == Counter((x.doc_id, k.decode(), len(k.decode())) for x, k in zip(hashed, want, strict=True))
    mixed = through("source_mix", fresh)
    times = Counter({(x.doc_id, x.source): x.copies for x in mixing.mix_sources(fresh).collect() if x.copies})
    assert Counter((x.doc_id, x.source) for x in mixed.collect()) == times and sum(times.values()) > 0
    model = public_tokenizers.path(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, library.encode(t)) for i, t in rows_of(mixed)]
    assert Counter(map(tuple, through("encode", mixed).collect())) == Counter((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in ids)
