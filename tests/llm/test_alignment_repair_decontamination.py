"""Decontamination, token alignment and conversation repair against plain Python."""

import bisect
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from trackframe.llm import conversation_repair as repair  # noqa: E402
from trackframe.llm import decontamination as clean  # noqa: E402
from trackframe.llm import token_alignment as align  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- benchmark passages -------------------------------------------------------------------------------------------


def brute_report(docs, items, window):
    found = {(str(i) if i is not None else "", tuple(WORD.findall(lower(t or "")))) for i, t in items}
    words = [WORD.findall(lower(t or "")) for _, t in docs]
    seen = Counter(w for ws in words for w in ws)
    out = []
    for (i, _), ws in zip(docs, words, strict=True):
        hit, ids, near = set(), set(), set()
        for name, item in found:
            k = min(window, len(item))
            windows = {item[s : s + k] for s in range(len(item) - k + 1)} if item else set()
            for s in range(len(ws) - k + 1):
                if tuple(ws[s : s + k]) in windows:
                    hit.update(range(s, s + k))
                    ids.add(name)
            if item and min(seen[w] for w in item):
                rare = min(set(item), key=lambda w: (seen[w], w))
                n = len(item)
                if any(w == rare and set(item) <= set(ws[max(0, p - n) : p + n + 1]) for p, w in enumerate(ws)):
                    near.add(name)
        out.append((i, len(ws), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit), len(near)))
    return Counter(out)


@pytest.fixture(scope="module")
def leaks(spark):
    r = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(1, 5)))) for _ in range(150)] + ["É", "9", "ß"]
    prose = lambda n: [words[int(k)] for k in r.zipf(1.3, n) % len(words)]
    items = [(k, prose(int(r.integers(1, 40)))) for k in range(25)]
    items += [(90, ["a"]), (91, []), (None, items[3][1]), (92, items[4][1]), (92, items[5][1]), (93, items[6][1]), (94, ["never", "there"]), (95, ["x"] * 12)]
    docs = []
    for k in range(80):
        body = prose(int(r.integers(0, 120)))
        if k % 3 == 0:
            own = items[int(r.integers(0, len(items)))][1]
            cut = int(r.integers(0, max(1, len(own) - 5)))
            body[len(body) // 2 : len(body) // 2] = own[cut:] if k % 2 else list(r.permutation(own))
        docs.append((k, " ".join(w.upper() if r.random() < 0.3 and w.isascii() else w for w in body) + "." * (k % 2)))
    docs += [(1, docs[3][1]), docs[6], docs[6], (None, docs[9][1]), (200, None), (201, ""), (202, " .\x00, "), (203, "x " * 40), (204, "-".join(items[7][1])), (205, "é É a")]
    texts = [(i, " ".join(w)) for i, w in items] + [(96, None)]
    return docs, texts, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS place", "2 AS term", "3 AS item"), spark.createDataFrame(texts, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS at")


@pytest.mark.parametrize("window", [10, 3, 1])
def test_report_against_brute_force(leaks, window, monkeypatch):
    docs, items, d, b = leaks
    want = brute_report(docs, items, window)
    assert Counter(map(tuple, clean.decontamination_report(d, b, window).collect())) == want
    if window == 3:  # every broadcast as a shuffle
        monkeypatch.setattr(clean, "BROADCAST_ROWS", 0)
        assert Counter(map(tuple, clean.decontamination_report(d, b, window).collect())) == want


def test_empty_tables(spark, leaks):
    docs, _, d, b = leaks
    assert clean.decontamination_report(d.limit(0), b).count() == 0
    got = clean.decontamination_report(d, b.limit(0)).collect()
    assert len(got) == len(docs) and not any(r.contaminated or r.n_near for r in got)
    long = spark.createDataFrame([(1, "w " * 300_000 + "one two three four"), (2, "three four")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in clean.decontamination_report(long, spark.createDataFrame([(1, "Two. Three, FOUR")], "item_id long, text string")).collect()}
    assert got == {1: (300_004, 3), 2: (2, 0)}


# --- token alignment ----------------------------------------------------------------------------------------------


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(A_PATH)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    back = {s: k for k, s in align._byte_spelling().items()}
    found, df = [], Counter()
    for i, t in rows:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        ab = [bytes(back[c] for c in a_tok.id_to_token(x)) for x in a]
        bb = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or not b"".join(ab) == (" " + t).encode() == b"".join(bb):
            found.append((i, [], [], []))
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in (ab, bb)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        sides = [[[] for _ in cuts] for _ in ends]
        for side, ids, own in zip(sides, (a, b), ends, strict=True):
            for x, e in zip(ids, own, strict=True):
                side[bisect.bisect_left(cuts, e)].append(x)
        groups = list(zip(*sides, strict=True))
        df.update({(x, y) for ga, gb in groups for x in ga for y in gb})
        found.append((i, a, b, groups))
    best = defaultdict(int)
    for (x, _), n in df.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, groups in found:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(df[x] == best[x[0]] for x in links), sum(df[x] for x in links), sha(shown) if shown else ""))
    return Counter(out)


ODD = ["", "  two  spaces ", "\n\nlead", "tab\there x", "a ▁ b", "日本 𝔘𝔘x. é. nb  z", "<|endoftext|> x", ".,., a., b.,c", "end \n next\nline. \n", "e.᠎ x", "'s it's we'll\n's", "\x00 a\x00.", "word.\nNext, one.", None, "x", " ", "\n", "5. 6, 7.", "😀😀 naïve über.", "word. word. Word, word", "áb ﬁ ½"]


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(8)
    alphabet = list("abcdeE.,' \n") + ["é", "日", "😀", "\t", "'s", " the", " ing"]
    made = ["".join(alphabet[int(k)] for k in r.integers(0, len(alphabet), int(r.integers(1, 80)))) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate([*ODD, *made])]
    return [*rows, rows[7], (None, rows[30][1]), (5, rows[31][1])]


@pytest.mark.parametrize("pairs, units", [(2_000_000, 300_000), (0, 300_000), (2_000_000, 40)])
def test_alignment_against_whole_texts(spark, texts, monkeypatch, pairs, units):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", pairs)
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS links", "2 AS n_a", "'x' AS row")
    if units < 1000:  # tasks are forked with their own module, so the small cache is tried here
        monkeypatch.setattr(align, "CACHE_UNITS", units)
        own = align.Aligner(A_PATH, B_PATH)
        got = []
        for at in range(0, len(texts), 3):
            counts, groups, *_ = own.run([t for _, t in texts[at : at + 3]])
            got += [(i, *map(int, c), sha(g) if g else "") for (i, _), c, g in zip(texts[at : at + 3], counts, groups, strict=True)]
        assert Counter(got) == Counter(x[:5] + x[7:] for x in brute_alignment(texts).elements())
        return
    assert Counter(map(tuple, align.alignment_report(docs, A_PATH, B_PATH).collect())) == brute_alignment(texts)


def test_alignment_of_little_and_much(spark, texts):
    schema = "doc_id long, text string"
    assert align.alignment_report(spark.createDataFrame([], schema), A_PATH, B_PATH).count() == 0
    only = [tuple(r) for r in align.alignment_report(spark.createDataFrame([(1, None), (2, "")], schema), A_PATH, B_PATH).collect()]
    assert sorted(only) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    long = [(1, "one more word. " * 60_000 + "x"), (2, "ab" * 20_000)]
    assert Counter(map(tuple, align.alignment_report(spark.createDataFrame(long, schema), A_PATH, B_PATH).collect())) == brute_alignment(long)
    full = align.align_tokens(spark.createDataFrame(texts[:30], schema), A_PATH, B_PATH).collect()
    assert {(r.doc_id, sha(r.groups) if r.groups else "") for r in full} == {(x[0], x[7]) for x in brute_alignment(texts[:30])}


# --- conversation repair ------------------------------------------------------------------------------------------


def spoiled(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def brute_repair(rows):
    """Every state's least (cost, audit), and what it makes, row by row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "" if tail[-1] in ".!?" else "truncated")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    new = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", ())}

    def inserted():
        for _ in range(4):
            for state, (cost, audit, made) in list(best.items()):
                to = new[state][0]
                best[to] = min(best.get(to, (1 << 60,)), (cost + 3, audit + "I", (*made, new[state] + ":")))

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        inserted()
        step = defaultdict(lambda: (1 << 60,))
        for state, (cost, audit, made) in best.items():
            step[state] = min(step[state], (cost + 4, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (to := after.get((state, role[:1]))) is not None:
                    step[to] = min(step[to], (cost + more, audit + "K", (*made, f"{role}:{text}")))
                to = new[state][0]
                step[to] = min(step[to], (cost + 3 + more, audit + "R", (*made, f"{new[state]}:{text}")))
        best = dict(step)
    inserted()
    cost, audit, made = min(best[s] for s in ("", "a") if s in best)
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(made)))


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


@pytest.fixture(scope="module")
def talks():
    r = np.random.default_rng(4)
    roles = ["user", "assistant", "system", "tool", "uncle", "", None]
    texts = ["Yes.", "No!", "why", "", " \n", "Why? ", None, "It is so.\x0b", "é"]
    rows = []
    for conv in range(150):
        for k in range(int(r.integers(1, 14))):
            p = r.random()
            role = ("user", "assistant")[k % 2] if p < 0.6 else roles[int(r.integers(0, len(roles)))]
            text = f"Turn {int(r.integers(0, 30))}{'.' * int(r.random() < 0.8)}" if r.random() < 0.7 else texts[int(r.integers(0, len(texts)))]
            rows.append((conv, k + int(r.integers(0, 2)) if r.random() < 0.9 else None, role, text))
    rows += [(None, k, ("user", "assistant")[k % 2], f"Of none {k}.") for k in range(5)]
    rows += [(500, k // 2 if k < 1000 else k, "user" if k < 900 else ("assistant", "user")[k % 2], f"Long {k % 700}{'.' * (k % 3 > 0)}") for k in range(3000)]
    return [*rows, *rows[:40]]


def test_runs_against_rows(talks):
    """Binary powers and unrolled choices equal the row-by-row search, for all short sequences and long runs."""
    for symbols in itertools.chain(itertools.product(range(12), repeat=2), itertools.product((0, 3, 4, 6, 8, 9), repeat=4), [(0,) * 3 + (3,) * 37 + (6,) * 21 + (5,) * 70 + (3, 6) * 20, (3,) * 5000]):
        rows = [(1, k, ("system", "user", "assistant", "tool")[s // 3], {0: f"{k}.", 1: f"{k}", 2: ""}[s % 3]) for k, s in enumerate(symbols)]
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        if len(symbols) < 1000:
            assert repair.cheapest(runs) == brute_repair(rows)[5:7]
        else:
            cost, audit = repair.cheapest(runs)
            assert cost == 3 * 2500 and len(audit) == 5000 and set(audit[::2]) == {"K"} and set(audit[1::2]) == {"R"}


def test_repair_against_brute_force(spark, talks):
    schema = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame(talks, schema).selectExpr("*", "1 AS n", "2 AS part", "'x' AS audit")
    hurt = by_conversation(spoiled(talks))
    want = {c: brute_repair(hurt.get(c, [])) for c in {r[0] for r in talks}}
    got = repair.repair_report(repair.damaged(table), table.select("conv_id")).collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    rows = repair.repaired_rows(table)
    whole = by_conversation([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in talks])
    made = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (str(r.conv_id), r.place)):
        made[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(made.get(c, []))) for c in whole} == {c: brute_repair(x)[-1] for c, x in whole.items()}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(repair.damaged(empty), empty.select("conv_id")).count() == 0
    ids = spark.createDataFrame([(1,), (None,)], "conv_id long")
    assert {tuple(r) for r in repair.repair_report(empty, ids).collect()} == {(i, 0, 0, 0, 0, 0, 0, "", sha("")) for i in (1, None)}
    long = spark.createDataFrame([(1, 1, "user", "w " * 400_000 + "."), (1, 1, "user", "w " * 400_000 + "."), (1, 2, "assistant", "Yes.")], empty.schema)
    assert [tuple(r)[1:8] for r in repair.repair_report(long, ids.limit(1)).collect()] == [(0, 0, 1, 0, 1, 4, "KDK")]


# --- nearest neighbours beyond one bucket -------------------------------------------------------------------------


def test_neighbours_over_buckets(spark):
    """More vectors than a bucket holds, in clusters, with columns of clashing names: searched and compared, against all distances."""
    from trackframe.llm import nn_descent

    r = np.random.default_rng(12)
    centres = r.standard_normal((40, 16)) * 4
    x = (centres[r.integers(0, 40, 2600)] + r.standard_normal((2600, 16))).astype(np.float32)
    x[5] = x[4]
    table = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "2 AS id", "'q' AS query", "3 AS rank")
    far = np.sqrt(((x[::100, None].astype(np.float64) - x[None].astype(np.float64)) ** 2).sum(-1))
    far[np.arange(26), np.arange(26) * 100] = np.inf
    want = {(100 * q, int(k)) for q in range(26) for k in np.lexsort((np.arange(2600), far[q]))[:10]}
    exact = {(q.query_id, q.vec_id) for q in nn_descent.nearest(table, exact=True).collect()}
    assert exact == want
    found = nn_descent.nearest(table).collect()
    assert len(found) == 260 and len({(q.query_id, q.vec_id) for q in found} & want) >= 0.98 * 260
    assert all(abs(q.score - far[q.query_id // 100, q.vec_id]) < 1e-9 for q in found)
    assert nn_descent.beam_width(20_000) == nn_descent.BEAM < nn_descent.beam_width(100_000)
