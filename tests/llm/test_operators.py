"""Each corpus operator against a brute-force version on hand-made rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from trackframe.llm import chunk_dedup, components, gru, jaccard, language_model, mixing, nn_descent, piece_codec, quality, suffix_dedup, token_store, toxicity  # noqa: E402
from trackframe.llm.textops import Texts  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(values):
    raw = [v.encode() for v in values]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(int))


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def empty_like(df):
    return df.limit(0)


def test_counts(documents):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.base_counts(documents).collect()}
    want = set()
    for i, s in rows_of(documents):
        w = WORD.findall(s)
        seen, dup = set(), 0
        for line in s.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        want.add((i, len(w), sum(map(len, w)), sum(s.count(x) for x in "#*$%&|<>"), dup, len(cover)))
    assert got == want


def test_binomial_bound_is_exact():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 50, 0.04), (7, 20, 0.5)):
        assert abs(quality.binomial_at_most(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12


def test_levels_stop_at_the_first_failure():
    assert quality.choose_level([0, 0, 400, 0], [5, 9, 90, 99], 4000, 100, 0.05, 0.01) == 1
    assert quality.choose_level([0, 0, 1, 2], [9, 9, 9, 9], 4000, 100, 0.05, 0.01) == 0  # the most lenient that does as well
    assert quality.choose_level([0, 0, 90], [80, 99, 100], 4000, 100, 0.05, 0.01) == 1  # one bad document more, 90 good ones lost
    assert quality.choose_level([0, 0], [0, 0], 4000, 100, 0.05, 0.01) is None and quality.choose_level([0], [9], 10, 9, 0.05, 0.01) is None


def test_verdicts_equal_brute_force(spark):
    from math import comb

    r = np.random.default_rng(21)
    known = ["".join(chr(97 + c) for c in r.integers(0, 26, 5)) for _ in range(4000)]
    docs, labels = [], []
    for i in range(1500):
        lang, bad = [None, "a", "b"][i % 3], i % 10 == 0
        words = [known[int(k)] for k in r.integers(0, 4000, int(r.integers(20, 60)))]
        docs.append((i, " ".join(w + "$$$" * (bad and k % 2) for k, w in enumerate(words)) if i % 50 else None, lang))
        if i % 3 != 2 or i < 90:  # too few of stratum b
            labels.append((i, int(not bad)))
    docs += docs[:200] * 3  # copies are no further trials
    got = quality.quality_verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth, rejected_at = dict(labels), {}
    for x in got:
        values = {"n_words": x.n_words, "word_chars": x.word_chars, "n_symbols": x.n_symbols, "n_dup_lines": x.n_dup_lines, "n_repeat_words": x.n_repeat_words, "greatest": max}
        above = [[eval(s.formula, values) > c for c in s.grid] for s in quality.SIGNALS]
        rejected_at[x.doc_id] = [any(a[k] for a in above) for k in range(16)]
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
    seen = {(x.lang, x.doc_id) for x in got if not x.base_failed and x.doc_id in truth}
    assert len({lang for lang, _ in seen}) == 3
    level = {}
    for lang in (None, "a", "b"):
        most = 0.0
        good = [i for s, i in seen if s == lang and truth[i]]
        bad = [i for s, i in seen if s == lang and not truth[i]]
        for k in range(16):
            wrong = sum(rejected_at[i][k] for i in good)
            if sum(comb(len(good), j) * 0.05**j * 0.95 ** (len(good) - j) for j in range(wrong + 1)) > 0.05 / 3:
                break
            worth = sum(rejected_at[i][k] for i in bad) / len(bad) - wrong / len(good)
            if worth > most:
                level[lang], most = k, worth
    assert set(level) == {None, "a"}
    for x in got:
        assert x.kept == (not x.base_failed and not (x.lang in level and rejected_at[x.doc_id][level[x.lang]]))
    assert all(not x.kept for x in got if x.doc_id % 10 == 0 and x.doc_id % 3 != 2) and sum(x.kept for x in got) > 1500


def test_quality_on_empty_and_odd_labels(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_verdicts(documents, labels).count() == 12
    assert quality.quality_verdicts(empty_like(documents), labels.limit(0)).count() == 0


def test_token_store_round_trip(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_store.write_store(documents, f"file://{tmp_path}/s", path, block_bytes=200)
    got = token_store.read_store(spark, f"file://{tmp_path}/s").collect()
    want = Counter((i, tuple(library.encode(s, add_special_tokens=False).ids + [1])) for i, s in rows_of(documents))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    one = token_store.read_store(spark, f"file://{tmp_path}/s", doc_ids=[5]).collect()
    assert [r.doc_id for r in one] == [5] and one[0].start == next(r.start for r in got if r.doc_id == 5)


def test_pieces_equal_the_library(documents):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in piece_codec.encode_pieces(documents, path).collect())
    assert got == Counter((i, tuple(library.encode(s)), library.decode(library.encode(s))) for i, s in rows_of(documents))
    for s in ("  a  b ", "\t\n", "a▁b", "x" * 300, "ＡΣ\x00é"):
        ids = library.encode(s)
        (text, decoded), = piece_codec.piece_codec(path).run([s])
        assert text == ",".join(map(str, ids)).encode() and decoded.decode() == library.decode(ids)


def test_jaccard_components(spark):
    r = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(60):
        w = list(base) if k < 40 else [f"u{k}_{i}" for i in range(40)] + base[:60]
        for _ in range(int(r.integers(0, 5))):
            w[int(r.integers(len(w)))] = f"e{r.integers(1000)}"
        rows.append((k, " ".join(w)))
    rows += [(100, "a b"), (101, "A b"), (102, "a c"), (103, ""), (104, None), (105, "x y z w"), (106, "x y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, s in rows:
        w = WORD.findall((s or "").lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                p, q = sorted((find(x), find(y)))
                parent[q] = p
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {(i, len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_keep_one(documents):
    kept = [r.doc_id for r in jaccard.keep_one_of_each(documents).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 4, 5, 7, 8, 10] and None in kept  # 8 and 9 share most shingles
    assert jaccard.keep_one_of_each(empty_like(documents)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(edges).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_repeated_strings(documents):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.drop_repeated_strings(documents).collect())
    raw = [(i, s.encode()) for i, s in rows_of(documents)]
    count = Counter(s[k : k + 400] for _, s in raw for k in range(len(s) - 399))
    want = Counter()
    for i, s in raw:
        cover = np.zeros(len(s) + 1, bool)
        for k in range(len(s) - 399):
            if count[s[k : k + 400]] > 1:
                cover[k : k + 400] = True
        kept = bytes(np.frombuffer(s, np.uint8)[~cover[:-1]])
        want[i, len(s), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want
    assert suffix_dedup.drop_repeated_strings(empty_like(documents)).count() == 0


def test_hot_blocks_are_compared_alike(documents, monkeypatch):
    plain = {tuple(r) for r in suffix_dedup.drop_repeated_strings(documents).select("doc_id", "n_removed", "n_spans").collect()}
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 0)
    assert {tuple(r) for r in suffix_dedup.drop_repeated_strings(documents).select("doc_id", "n_removed", "n_spans").collect()} == plain


def test_multikey_quicksort():
    r = np.random.default_rng(1)
    keys = [r.integers(0, 5, 500) for _ in range(3)]
    assert np.array_equal(np.stack(keys, 1)[suffix_dedup.multikey_quicksort(keys)], np.stack(keys, 1)[np.lexsort(keys[::-1])])


def test_chunks_resist_insertions():
    r = np.random.default_rng(2)
    body = " ".join("".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(800))
    cut = lambda s: {s.encode()[a:b] for e in [chunk_dedup.chunk_ends(texts([s]))[0]] for a, b in zip(np.concatenate([[0], e[:-1]]), e, strict=True)}
    one, two = cut(body), cut("something new in front " + body)
    assert len(one & two) >= len(one) - 3


def test_passages_without_spaces_are_found_at_any_offset(spark):
    r = np.random.default_rng(12)
    cjk = lambda n: "".join(chr(c) for c in r.integers(0x4E00, 0x9FA5, n))
    for n, least in ((150, 0.5), (600, 0.8), (1500, 0.9)):  # characters of three bytes
        share = []
        for _ in range(10):
            passage = cjk(n)
            both = [cjk(300) + passage + cjk(200), cjk(int(r.integers(301, 390))) + passage + cjk(100)]
            ends, counts = chunk_dedup.chunk_ends(texts(both))
            pieces = []
            for s, e in zip(both, np.split(ends, np.cumsum(counts)[:-1]), strict=True):
                alone = chunk_dedup.chunk_ends(texts([s]))[0]
                assert np.array_equal(alone, e - (e[-1] - alone[-1]))
                pieces.append({s.encode()[a:b].decode() for a, b in zip(np.concatenate([[0], alone[:-1]]), alone, strict=True)})
            share.append(sum(map(len, pieces[0] & pieces[1])) / n)
        assert np.mean(share) >= least, (n, np.mean(share))
    passage = cjk(600)
    df = spark.createDataFrame([(1, cjk(300) + passage), (2, cjk(345) + passage + cjk(50)), (3, "一" * 1000), (4, "x" * 1000)], "doc_id long, text string")
    got = {r.doc_id: r for r in chunk_dedup.drop_repeated_passages(df).collect()}
    assert got[1].n_removed == 0 and 1300 <= got[2].n_removed <= 1800 and passage[200:400] not in got[2].text


def test_passages_are_dropped_once(documents):
    got = {r.doc_id: (r.text, r.n_removed) for r in chunk_dedup.drop_repeated_passages(documents).collect()}
    assert got[8][1] == 0 and got[9][1] > 500 and "passage30word" not in got[9][0] and got[9][0].startswith("second thing") and got[9][0].endswith("another end")
    assert got[4][0] is None and got[3][0] == "" and got[1][1] == 0
    assert chunk_dedup.drop_repeated_passages(empty_like(documents)).count() == 0


def test_targets_and_mix(spark, documents):
    assert mixing.targets({"a": 10, "b": 100, "c": 1000}, {"a": 1.0, "b": 2.0, "c": 3.0}) == {"a": 30.0, "b": 300.0, "c": 780.0}
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(df).collect()
    for s in ("s0", "s1", "s2"):
        part = [r for r in mixed if r.source == s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 60 and all(0 <= r.taken <= 3 * r.size for r in part)
    assert {tuple(r) for r in mixed} == {tuple(r) for r in mixing.mix_sources(df.repartition(5)).collect()}
    odd = mixing.mix_sources(documents).collect()
    assert len(odd) == 12 and all(r.taken % max(r.size, 1) == 0 for r in odd)
    assert mixing.mix_sources(empty_like(documents)).count() == 0
    assert mixing.mix_repeated(documents).columns == documents.columns


def test_small_sources_beside_a_large_one(spark):
    r = np.random.default_rng(9)
    counts = {f"s{n}_{k}": n for k in range(6) for n in (50, 200, 500)} | {"large": 10_000}
    rows = [(s, int(x)) for s, n in counts.items() for x in np.minimum(np.exp(r.normal(4.5, 1.2, n)).astype(int) + 1, 20_000)]
    df = spark.createDataFrame([(k, s, x) for k, (s, x) in enumerate(rows)], "doc_id long, source string, n int").select("doc_id", "source", F.expr("repeat('w ', n)").alias("text"))
    words = Counter()
    for s, x in rows:
        words[s] += x
    weights = tuple(words[s] * r.uniform(0.3, 0.9) for s in sorted(counts))  # no source at the ceiling, where any choice fits
    got = mixing.mix_sources(df, weights).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    miss = {r.source: abs(r.taken - r.target) / r.target for r in got}
    of = {n: [v for s, v in miss.items() if s.startswith(f"s{n}_")] for n in (50, 200, 500)}
    assert all(np.mean(m) < 0.02 for m in of.values()) and miss["large"] < 0.02, {n: (float(np.mean(m)), max(m)) for n, m in of.items()}


def test_flight_keeps_totals():
    r = np.random.default_rng(3)
    p, size = r.uniform(0.1, 0.9, 200), r.integers(1, 90, 200).astype(float)
    out = mixing.fly(p, size, r.random(200))
    assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-5 and ((out > 0) & (out < 1)).sum() <= 2


def test_language_model_sums_to_one():
    lex = language_model.Lexicon(np.arange(1, 131, dtype=np.uint64), np.arange(130, 0, -1), np.arange(130), 130, np.zeros(65536, int), np.zeros(48), np.zeros(48), 8515, 130)
    w = language_model.new_weights(lex)
    state = np.random.default_rng(1).standard_normal((1, language_model.STATE)).astype(np.float32)
    symbols = np.arange(130 + 48)
    logp, _ = language_model.token_log_probs(w, 130, np.repeat(state, len(symbols), 0), symbols)
    assert abs(np.exp(logp).sum() - 1) < 1e-3


def test_recurrent_gradients():
    r = np.random.default_rng(0)
    x, h = r.standard_normal((4, 3, 15)).astype(np.float32), r.standard_normal((3, 5)).astype(np.float32)
    u, b = r.standard_normal((5, 15)).astype(np.float32) * 0.3, np.zeros(15, np.float32)
    loss = lambda x, u: float(gru.forward(x, h, u, b)[0].sum())
    states, kept = gru.forward(x, h, u, b)
    dx, du, _, _ = gru.backward(np.ones_like(states), kept, u)
    for array, grad, at in ((x, dx, (1, 2, 7)), (u, du, (2, 11)), (x, dx, (0, 0, 1))):
        up, down = array.copy(), array.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        slope = (loss(up, u) - loss(down, u) if array is x else loss(x, up) - loss(x, down)) / 2e-2
        assert abs(slope - grad[at]) < 2e-2


def test_scores_of_odd_documents(documents):
    got = language_model.score_documents(documents).collect()
    assert len(got) == 12 and all(r.score < 0 for r in got)
    held = {r.doc_id: r for r in got}
    assert held[3].n_tokens == 1 and held[4].n_tokens == 1 and held[1].n_tokens == 14
    assert language_model.score_documents(empty_like(documents)).count() == 0


def test_language_model_learns_from_every_text(spark):
    for k in range(3):
        one = spark.createDataFrame([(1, f"just one text number {k} with words of its own")], "doc_id long, text string")
        lex = language_model.lexicon(language_model.vocabulary(one.select(F.col("text").cast("binary").alias("text"))))
        before, after = language_model.new_weights(lex), language_model.fit(one.select("doc_id", F.col("text").cast("binary").alias("text")), lex)
        assert not np.array_equal(before["embed"], after["embed"])


def test_copies_of_a_text_spread_over_training(spark):
    rows = [(k, "the same text") for k in range(400)] + [(None, "the same text")] * 400 + [(1000 + k, f"text {k}") for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).select("doc_id", F.col("text").cast("binary").alias("text"))
    lex = language_model.lexicon(language_model.vocabulary(df))
    got = language_model.deal(df, spark.sparkContext.broadcast(lex)).withColumn("turn", F.expr("pmod(shiftright(h, 20), 4)")).withColumn("task", F.expr("pmod(hash(shiftright(h, 30)), 8)")).collect()
    copies = [r for r in got if len(r.symbols) == 4]
    assert len(got) == 1600 and len(copies) == 800
    assert all(60 <= sum((r.turn, r.task // 4) == (t, g) for r in copies) <= 150 for t in range(4) for g in range(2))
    assert all(len(t) == 3 for t in (r.symbols for r in got if len(r.symbols) != 4))


def test_training_takes_every_token():
    lex = language_model.Lexicon(np.arange(1, 131, dtype=np.uint64), np.arange(130, 0, -1), np.arange(130), 130, np.zeros(65536, int), np.zeros(48), np.zeros(48), 8515, 130)
    r = np.random.default_rng(8)
    some = [r.integers(0, 178, n) for n in (1, 31, 32, 33, 5000, *r.integers(1, 90, 200))]
    start = language_model.new_weights(lex)
    weights, seen = language_model.train(start, 130, some)
    assert seen == sum(map(len, some))
    flat, first = np.concatenate(some), np.concatenate([[0], np.cumsum([len(t) for t in some])])
    assert language_model.score_texts(weights, lex, flat, first).sum() > language_model.score_texts(start, lex, flat, first).sum()


def test_toxic_words_are_learned(spark):
    r = np.random.default_rng(4)
    known = ["".join(chr(97 + c) for c in r.integers(0, 26, 5)) for _ in range(300)]
    word = lambda: known[int(r.integers(300))]
    rows = []
    for i in range(800):
        w = [word() for _ in range(int(r.integers(20, 120)))]
        if i % 4 == 0:
            w[int(r.integers(len(w)))] = "vilegrub" + word()[:2]
            w[int(r.integers(len(w)))] = "nastiness"
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df.select("doc_id", "text").union(odd), df.select("doc_id", "toxic")).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.9 * len(held) and 0 <= got[1001].score <= 1 and 0 <= got[1000].score <= 1
    assert toxicity.score_toxicity(df.limit(0).select("doc_id", "text"), df.limit(0).select("doc_id", "toxic")).count() == 0


def test_nearest_neighbours(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((600, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(600)] + [(700 + k, [float(v) for v in x[100]], 0) for k in range(15)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] * 8, 0), (None, [1.0] * 16, 0), (904, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = nn_descent.nearest(df, every=100).collect()
    ids, every = np.array(list(range(600)) + list(range(700, 715))), np.concatenate([x, np.repeat(x[100:101], 15, 0)]).astype(float)
    hits = total = 0
    for q in (0, 100, 200, 300, 400, 500, 700):
        d = np.sqrt(((every - every[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        order = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        hits, total = hits + len(set(order) & set(mine)), total + 10
        if q in (100, 700):
            assert mine == order
    assert hits >= 0.9 * total
    assert nn_descent.nearest(df.limit(0)).count() == 0


def test_pipeline_on_odd_documents(spark, documents, tmp_path):
    import corpus_pipeline

    docs = documents.withColumn("n_chars", F.length("text").cast("long")).drop("__text_extra")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert len(corpus_pipeline.STAGES) == 5
