"""Documents to a token-ready mix: filter, near-duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents; n_chars follows a
text that a stage rewrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.llm.chunk_dedup import drop_repeated_passages
from trackframe.llm.jaccard import keep_one_of_each
from trackframe.llm.mixing import mix_repeated
from trackframe.llm.piece_codec import piece_digest
from trackframe.llm.quality import quality_verdicts
from trackframe.llm.queries import table, tokenizer_path
from trackframe.llm.spans import KEY, WHOLE, join_key, packed, unpacked
from trackframe.llm.storage import drop_tables, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoffs keep."""
    rows = packed(docs)
    texts = rows.select(F.struct(*KEY).alias("doc_id"), F.col(WHOLE).getField("lang").alias("lang"), F.col("__text").alias("text"))
    verdicts = quality_verdicts(texts, table(spark, sf_dir, "labels"), label_id=f"doc_id.{KEY[0]}")
    kept = verdicts.where("kept").select(*(F.col(f"doc_id.{c}").alias(c) for c in KEY)).distinct()
    return unpacked(rows.join(kept, join_key(rows, kept), "left_semi"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_one_of_each(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds."""
    kept = drop_repeated_passages(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_repeated(docs, weights=(1, 2, 3), ceiling=3.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix."""
    return piece_digest(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("encode", encode),
]
#: Thresholds by exact bounds, components, rolling hashes and balanced sampling are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), name)
        if made is not None:  # the table of the stage before, never the input
            drop_tables(made)
        docs = made = after
    return STAGES[-1][1](spark, docs, sf_dir)
