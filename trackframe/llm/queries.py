"""The operators with production parameters on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary files lie; the package's own ``path`` finds them.
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out_fold=0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_store_digest

    return token_store_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"), held_out_fold=1)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import drop_repeated_strings

    return drop_repeated_strings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_dedup import drop_repeated_passages

    return drop_repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), ceiling=3.0)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import piece_digest

    return piece_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=100, top=10)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontamination_report

    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import alignment_report

    return alignment_report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repair_report

    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations.select("conv_id"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_token_store": op3_token_store,
    "op4_jaccard": op4_jaccard,
    "op5_language_model": op5_language_model,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chunk_dedup": op7_chunk_dedup,
    "op8_mixing": op8_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_nn_descent": op10_nn_descent,
    "op11_decontamination": op11_decontamination,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}

_SPACED = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACED}')"

#: Windows by equality of whole word lists; near matches by lists of places.
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () r, doc_id, {_WORDS} w FROM documents),
i AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') item_id, {_WORDS} w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) size, w[s:s + least(len(w), 10) - 1] win FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) u(s) WHERE len(w) > 0),
dw AS (SELECT r, s, size, w[s:s + size - 1] win FROM d, (SELECT DISTINCT size FROM iw) z, unnest(range(1, len(w) - size + 2)) u(s)),
m AS (SELECT DISTINCT r, s, size, item_id FROM dw JOIN iw USING (size, win)),
h AS (SELECT r, count(DISTINCT p) n_hit FROM m, unnest(range(s, s + size)) u(p) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) items_sha256 FROM m GROUP BY r),
p AS (SELECT r, p, w[p] word FROM d, unnest(range(1, len(w) + 1)) u(p)),
c AS (SELECT word, count(*) n FROM p GROUP BY word),
it AS (SELECT i.item_id, i.w, len(i.w) n, x.word, coalesce(c.n, 0) seen FROM i, unnest(list_distinct(i.w)) x(word) LEFT JOIN c ON c.word = x.word),
rare AS (SELECT item_id, w, n, arg_min(word, (seen, word)) word, count(*) words FROM it GROUP BY item_id, w, n HAVING min(seen) > 0),
ce AS (SELECT r, p, item_id, w, n, words FROM p JOIN rare USING (word)),
nr AS (SELECT DISTINCT ce.r, ce.item_id FROM ce JOIN d ON d.r = ce.r WHERE len(list_distinct(list_filter(d.w[greatest(1, ce.p - ce.n):ce.p + ce.n], lambda x: list_contains(ce.w, x)))) = ce.words),
q AS (SELECT r, count(*) n_near FROM nr GROUP BY r)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(n_near, 0) n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN q USING (r)"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Row by row: of each state the least (cost, audit); a step is up to three insertions and an edit of the row.
OP13_SQL = f"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) t),
o AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT) b FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 k FROM o, t),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy FROM k, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) u(copy) WHERE k <> 0),
n AS (SELECT *, row_number() OVER c p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) again, rtrim(text, {_BLANKS}) tail, left(role, 1) i, lag(left(role, 1)) OVER c j FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
f AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END f FROM n),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (f = 'blank') blank, count(*) FILTER (f = 'duplicate') duplicate, count(*) FILTER (f = 'truncated') truncated,
  count(*) FILTER (j || i NOT IN ('su', 'ua', 'au')) illegal, max(p) rows_ FROM f GROUP BY conv_id),
ins(s, m, z) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (0, 3, 2), (1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2), (2, 0, 2), (2, 1, 3), (2, 2, 2), (2, 3, 3), (3, 0, 3), (3, 1, 2), (3, 2, 3), (3, 3, 2)),
keep(s, i, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
own AS (SELECT conv_id, p, f, i, s, 'D' AS e, 4 AS c, s AS z, NULL AS to_role FROM f, (SELECT DISTINCT s FROM ins)
  UNION ALL SELECT conv_id, p, f, f.i, s, 'K', CASE WHEN f = 'truncated' THEN 3 ELSE 0 END, z, role FROM f JOIN keep USING (i) WHERE f NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, p, f, i, s, 'R', CASE WHEN f = 'truncated' THEN 6 ELSE 3 END, z, CASE z WHEN 2 THEN 'user' ELSE 'assistant' END FROM f, ins WHERE m = 1 AND f NOT IN ('blank', 'duplicate')),
step AS (SELECT conv_id, p, ins.s, repeat('I', ins.m) || e AS e, 3 * ins.m + c AS c, own.z, list_transform(range(ins.m), lambda x: CASE (z0.z + x) % 2 WHEN 0 THEN 'user:' ELSE 'assistant:' END) AS made, to_role FROM own JOIN ins ON own.s = ins.z JOIN ins z0 ON z0.s = ins.s AND z0.m = 1),
r AS (SELECT conv_id, 0::BIGINT p, 0 s, 0 c, '' e, []::VARCHAR[] done FROM a
  UNION ALL SELECT r.conv_id, r.p + 1, x.z, min(r.c + x.c), arg_min(r.e || x.e, (r.c + x.c, r.e || x.e)), arg_min(list_concat(r.done, list_concat(x.made, CASE WHEN x.to_role IS NULL THEN [] ELSE [x.to_role || ':' || f.text] END)), (r.c + x.c, r.e || x.e))
  FROM r JOIN step x ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.p = r.p + 1 AND x.s = r.s JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.p = r.p + 1 GROUP BY r.conv_id, r.p, x.z),
e AS (SELECT a.conv_id, min(r.c + 3 * m) AS cost, arg_min(r.e || repeat('I', m), (r.c + 3 * m, r.e || repeat('I', m))) AS audit,
  arg_min(list_concat(r.done, list_transform(range(m), lambda x: CASE (z0.z + x) % 2 WHEN 0 THEN 'user:' ELSE 'assistant:' END)), (r.c + 3 * m, r.e || repeat('I', m))) AS done
  FROM a JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.p = a.rows_ JOIN (SELECT s, m, z FROM ins) q ON q.s = r.s JOIN (SELECT s, z FROM ins WHERE m = 1) z0 ON z0.s = r.s WHERE q.z IN (0, 3) GROUP BY a.conv_id)
SELECT u.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate, coalesce(truncated, 0)::BIGINT truncated, coalesce(illegal, 0)::BIGINT illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(done, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) u LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM u.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM u.conv_id"""

ORACLE_SQL: dict[str, str] = {"op11_decontamination": OP11_SQL, "op13_conversation_repair": OP13_SQL}
