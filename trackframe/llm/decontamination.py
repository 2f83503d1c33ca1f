"""Benchmark passages in training texts, by a distributed positional inverted index.

The index is a Parquet table of postings (document, place, term), one for each
word of a document that is a test term, and one end mark for each document (no
term, its place is one past the last word).  Searches read postings only:

1. Counts of all test terms come from the postings.  Of each window of a test
   item the two rarest words are its anchors; neighbouring windows share them.
2. Lists of anchors are shifted by the anchors' places in the item and
   intersected: an alignment (document, item, shift) goes on if two anchors of
   the item meet in it (one, if windows have one word).
3. All other words of such an item are looked up at their places in the same
   documents.  Runs of at least a window's words are exact matches.

A proximity match is an occurrence of the item's rarest word that has every
other distinct word of the item within as many words, before or after, as the
item is long.

Only DataFrame functions are used.  Terms, alignments and results are broadcast
while their counts are within ``BROADCAST_ROWS``, and shuffled beyond.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Null and empty
texts have no words and match nothing.  Documents that agree in id and text share
their result, rows are kept.  Items that share an id count once; an item without
id counts as one of the empty id; an item without words has no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import skew
from .storage import drop_tables, materialize

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Sides of more rows than this are shuffled, never broadcast (rows have a few numbers each, so this is some tens of MB).
BROADCAST_ROWS = 400_000
DOC = ("doc_id", "text_hash")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lowered(text: Column) -> Column:
    """A-Z in lower case; texts of one-byte characters take the faster function that does the same on them."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _if_small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _same_doc(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def test_items(bench: DataFrame) -> DataFrame:
    """``item`` (a number), ``item_id`` (as string), ``words`` of each distinct item that has words."""
    words = F.array_remove(F.split(_lowered(F.col("text")), GAP), "")
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where("size(words) > 0")
    return rows.distinct().withColumn("item", F.xxhash64("item_id", "words"))


def build_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Postings ``doc_id, text_hash, place, term`` of all test terms in all documents, places from 1; end marks have no term.

    The table lies in the shared folder; drop it with ``storage.drop_tables``.
    """
    terms = items.select(F.explode("words").alias("word")).distinct().select("word", F.xxhash64("word").alias("term"))
    marks = docs.sparkSession.sql("SELECT '' AS word, CAST(NULL AS BIGINT) AS term")
    terms = materialize(terms.unionByName(marks), "test-terms")
    # A space on either side: the first part is always empty, the last one is the end mark.
    padded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.concat(F.lit(" "), F.coalesce(_lowered(F.col("text")), F.lit("")), F.lit(" ")).alias("text"))
    tokens = padded.select(*DOC, F.posexplode(F.split("text", GAP)).alias("place", "word")).where("place > 0")
    index = materialize(tokens.join(_if_small(terms, terms.count()), "word").select(*DOC, "place", "term"), "postings")
    drop_tables(terms)
    return index


def _anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """``term, item, at, need``: the two rarest words of each window whose words all occur somewhere."""
    size = F.least(F.lit(window), F.size("words"))
    places = items.select("item", size.alias("size"), F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    known = places.withColumn("term", F.xxhash64("word")).join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    first = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1), F.least(F.col("at"), F.col("n") - F.col("size"))))
    whole = Window.partitionBy("item", "start")
    ranked = known.withColumn("start", first).withColumns({"rank": F.row_number().over(whole.orderBy("count", "at")), "least": F.min("count").over(whole)})
    return ranked.where("rank <= 2 AND least > 0").select("term", "item", "at", F.least("size", F.lit(2)).alias("need")).distinct()


def _placed(index: DataFrame) -> DataFrame:
    return index.where("term IS NOT NULL")


def phrase_spans(index: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Exact matches ``doc_id, text_hash, item, start, stop`` (places of the first and last word): maximal runs of an
    item's words, as many as a window has or more, at one shift of the item."""
    counts = materialize(_placed(index).groupBy("term").count(), "term-counts")
    anchors = materialize(_anchors(items, counts, window), "anchors")
    lists = _placed(index).join(_if_small(anchors, anchors.count()), "term")
    aligned = lists.groupBy(*DOC, "item", (F.col("place") - F.col("at")).alias("shift")).agg(F.min("at").alias("low"), F.max("at").alias("high"), F.max("need").alias("need"))
    found = materialize(aligned.where("need = 1 OR low < high").select(*DOC, "item", "shift"), "alignments")
    some = found.select(*DOC).distinct()
    some = _if_small(some, found.count())
    near = _placed(index).join(some, _same_doc(index, some), "left_semi").distinct()
    wanted = items.select("item", F.least(F.lit(window), F.size("words")).alias("size"), F.posexplode("words").alias("at", "word"))
    wanted = wanted.select("item", "size", "at", F.xxhash64("word").alias("term"))
    wanted = found.join(_if_small(wanted, wanted.count()), "item").withColumn("place", F.col("shift") + F.col("at"))
    met = near.join(wanted, _same_doc(near, wanted) & (near["place"] == wanted["place"]) & (near["term"] == wanted["term"]))
    met = met.select(near["doc_id"], near["text_hash"], "item", "shift", "at", "size")
    run = F.col("at") - F.row_number().over(Window.partitionBy(*DOC, "item", "shift").orderBy("at"))
    runs = met.withColumn("run", run).groupBy(*DOC, "item", "shift", "run").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.first("size").alias("size"))
    spans = runs.where("b - a + 1 >= size").select(*DOC, "item", (F.col("shift") + F.col("a")).alias("start"), (F.col("shift") + F.col("b")).alias("stop"))
    spans = materialize(spans, "phrase-spans")
    drop_tables(counts, anchors, found)
    return spans


def near_places(index: DataFrame, items: DataFrame) -> DataFrame:
    """Proximity matches ``doc_id, text_hash, item, place``: places of the item's rarest word with all its other words near."""
    counts = _placed(index).groupBy("term").count()
    n = F.size("words").alias("n")
    terms = items.select("item", n, F.explode(F.array_distinct("words")).alias("word")).withColumn("term", F.xxhash64("word")).join(counts, "term", "left")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("count", F.lit(0)), "word"))
    ranked = materialize(terms.withColumns({"rank": rank, "distinct": F.count("*").over(Window.partitionBy("item")), "known": F.count("count").over(Window.partitionBy("item"))}).where("known = distinct").select("item", "n", "term", "rank", "distinct"), "item-terms")
    rare = ranked.where("rank = 1").select("term", "item", "n", "distinct")
    centres = materialize(_placed(index).join(_if_small(rare, rare.count()), "term").select(*DOC, "item", "n", "distinct", F.col("place").alias("centre")).distinct(), "centres")
    some = centres.select(*DOC).distinct()
    some = _if_small(some, centres.count())
    near = _placed(index).join(some, _same_doc(index, some), "left_semi").distinct()
    # A block is as wide as the reach, so what is near a centre lies in its block or in one beside it.
    others = ranked.where("rank > 1").select("item", "n", "term")
    near = near.join(_if_small(others, others.count()), "term").select(*DOC, "item", "term", "place", F.floor(F.col("place") / F.col("n")).alias("block"))
    around = centres.withColumn("block", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("centre") / F.col("n")) + d)))
    pairs = around.join(near, _same_doc(around, near) & (around["item"] == near["item"]) & (around["block"] == near["block"]) & (F.abs(around["centre"] - near["place"]) <= around["n"]))
    pairs = pairs.select(around["doc_id"], around["text_hash"], around["item"], "centre", "distinct", "term").distinct()
    full = pairs.groupBy(*DOC, "item", "centre").agg(F.count("*").alias("met"), F.first("distinct").alias("distinct")).where("met = distinct - 1").drop("met", "distinct")
    alone = centres.where("distinct = 1").select(*DOC, "item", "centre")
    out = materialize(full.unionByName(alone).withColumnRenamed("centre", "place"), "near-places")
    drop_tables(ranked, centres)
    return out


def decontamination_report(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a proximity match)."""
    items = materialize(test_items(bench), "test-items")
    index = build_index(docs, items)
    spans, near = phrase_spans(index, items, window), near_places(index, items)
    names = items.select("item", "item_id")
    few = names.count()
    hits = spans.join(_if_small(names, few), "item").withColumn("place", F.explode(F.sequence("start", "stop")))
    hits = hits.groupBy(*DOC).agg(F.count_distinct("place").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    close = near.join(_if_small(names, few), "item").groupBy(*DOC).agg(F.count_distinct("item_id").alias("n_near"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    both = hits.select(*DOC, "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), F.lit(0).cast("long").alias("n_near"))
    both = both.unionByName(close.select(*DOC, F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"), "n_near"))
    found = materialize(both.groupBy(*DOC).agg(*(F.sum(c).alias(c) for c in ("n_hit", "n_items", "n_near")), F.max("items_sha256").alias("items_sha256")), "contaminated")
    rows = index.where("term IS NULL").select(*DOC, (F.col("place") - 1).cast("long").alias("n_words"))
    n = found.count()
    if n > BROADCAST_ROWS:  # rows that are repeated often may meet in one key
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        keyed = rows.select(F.struct(*DOC).alias("key"), "n_words", "_row")
        per_key = keyed.groupBy("key").count()
        hot = skew.hot_keys(per_key, ["key"], rows.count())
        right = skew.copied(found.select(F.struct(*DOC).alias("key"), "n_hit", "n_items", "n_near", "items_sha256"), hot, ["key"])
        joined = skew.dealt(keyed, hot, ["key"], ["_row"]).join(right, ["key", skew.SALT], "left").withColumn("doc_id", F.col("key.doc_id"))
    else:
        small = F.broadcast(found)
        joined = rows.join(small, _same_doc(rows, small), "left").drop(small["doc_id"], small["text_hash"])
    empty = F.sha2(F.lit(""), 256)
    out = joined.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", empty).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near"))
    drop_tables(spans, near)
    return out
