"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions alone.

1. A window can only be similar to an item if it shares a shingle with it, so every shingle of every
   document is looked up among the items' shingles; each hit places a window as long as the item on
   the document, aligned at the shingle. This is lossless and keeps fingerprints off clean text.
2. Windows and items get 64-bit SimHash fingerprints of their shingles, weighted by occurrences.
3. Multi-index Hamming search: the 64 bits are cut into radius + 1 blocks, so two fingerprints within
   the radius agree on a block at least; windows and items of one length meet on (length, block, value).
4. Pairs within the radius are verified: the weighted Jaccard similarity of their shingles (sums of
   the smaller and larger occurrence counts) has to reach the threshold.

At similarity 0.8 the expected distance of fingerprints is 9.7 bits, deviation 2.9; the default radius
of 19 lies over three deviations above, and verbatim passages have distance 0.

Defined results: null and blank texts and items match nothing; items of fewer words than a shingle
have one shingle of all their words; rows with a null or repeated doc_id are handled one by one
and reported once per (doc_id, item, start), the most similar of them; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.llm import common

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
#: Rows of the items' tables up to which they are broadcast; beyond it these joins shuffle.
BROADCAST_ROWS = 500_000


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks over 64 bits."""
    n, out, at = radius + 1, [], 0
    for i in range(n):
        size = 64 // n + (i < 64 % n)
        out.append((at, size))
        at += size
    return out


def _shingles(words: str, n: int) -> F.Column:
    """All n-word shingles of an array as strings; one of all words where there are fewer."""
    return F.expr(f"CASE WHEN size({words}) = 0 THEN array() ELSE transform(sequence(1, greatest(size({words}) - {n - 1}, 1)), i -> array_join(slice({words}, i, {n}), ' ')) END")


def simhash(shingles: str) -> F.Column:
    """64-bit SimHash of an array of strings; an occurrence weighs 1."""
    hashes = f"transform({shingles}, s -> xxhash64(s))"
    votes = f"transform(sequence(0, 63), b -> aggregate(hs, 0, (n, h) -> n + 2 * CAST(shiftright(h, b) & 1L AS INT) - 1))"
    bits = f"aggregate(transform(array({hashes}), hs -> {votes})[0], named_struct('b', 0, 'x', 0L), (a, v) -> named_struct('b', a.b + 1, 'x', a.x | IF(v > 0, shiftleft(1L, a.b), 0L)), a -> a.x)"
    return F.expr(bits)


def _keyed(df: DataFrame, n: int, *keep: str) -> DataFrame:
    """A row (keep, pos, key) for every shingle of n words of the array column words."""
    m = F.greatest(F.size("words") - (n - 1), F.lit(0))
    zipped = F.arrays_zip(*(F.slice("words", i + 1, m).alias(f"w{i}") for i in range(n)))
    rows = df.where(F.size("words") >= n).select(*keep, F.posexplode(zipped).alias("pos", "s"))
    return rows.select(*keep, "pos", F.xxhash64(*(F.col(f"s.w{i}") for i in range(n))).alias("key"))


def leaks(docs: DataFrame, items: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, item_id, start, n_words, distance, similarity) of document windows that match an item.

    start counts words from 0. docs has doc_id and text, items has item_id and text.
    """
    items = common.cut(items.select("item_id", common.words(F.lower("text")).alias("words")).where(F.size("words") > 0).distinct())
    # a text of its own for each mark: rows that repeat a doc_id don't mix
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), common.words(F.lower("text")).alias("words"))
    # at most n values: the shingle sizes that items ask for
    sizes = [r[0] for r in items.select(F.least(F.size("words"), F.lit(n))).distinct().collect()]
    small = items.select(F.sum(F.size("words"))).first()[0] or 0
    sent = F.broadcast if small * (radius + 1) <= BROADCAST_ROWS else (lambda df: df)
    hits = None
    for k in sizes:
        mine = items.where(F.least(F.size("words"), F.lit(n)) == k).withColumn("len", F.size("words"))
        keys = _keyed(mine, k, "item_id", "len").groupBy("key", "item_id", "len").agg(F.min("pos").alias("at")).select("key", "len", "at").distinct()
        part = _keyed(docs, k, "doc_id", "mark").join(sent(keys), "key").select("doc_id", "mark", "len", F.greatest(F.col("pos") - F.col("at"), F.lit(0)).alias("start"))
        hits = part if hits is None else hits.union(part)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, n_words int, distance int, similarity double")
    # a document's windows: bounded by its own words and the items' lengths
    places = hits.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set(F.struct("start", "len")).alias("places"))
    cutouts = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["len"].alias("len"), F.slice("words", p["start"] + 1, p["len"]).alias("words")))
    windows = docs.join(places, docs["doc_id"].eqNullSafe(places["_id"]) & (docs["mark"] == places["_mark"])).select("doc_id", "mark", F.explode(cutouts).alias("w")).select("doc_id", "mark", "w.start", "w.len", F.col("w.words"))
    windows = common.cut(windows.select("doc_id", "mark", "start", "len", _shingles("words", n).alias("shingles")).distinct().withColumn("print", simhash("shingles")))
    prints = items.select("item_id", F.size("words").alias("len"), _shingles("words", n).alias("shingles")).withColumn("print", simhash("shingles"))
    cells = F.array(*(F.struct(F.lit(i).alias("block"), F.expr(f"shiftright(print, {at}) & {(1 << size) - 1}L").alias("cell")) for i, (at, size) in enumerate(_blocks(radius))))
    left = windows.select("doc_id", "mark", "start", "len", "print", F.explode(cells).alias("c"))
    right = prints.select("item_id", "len", F.col("print").alias("other"), F.explode(cells).alias("c"))
    near = left.join(sent(right), ["len", "c"]).withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("other"))))
    near = near.where(F.col("distance") <= radius).select("doc_id", "mark", "start", "len", "item_id", "distance").distinct()
    named = [F.col(c) for c in ("doc_id", "mark", "start", "len", "item_id", "distance")]
    same = near["doc_id"].eqNullSafe(windows["doc_id"]) & (near["mark"] == windows["mark"]) & (near["start"] == windows["start"]) & (near["len"] == windows["len"])
    mine = near.join(windows.select("doc_id", "mark", "start", "len", "shingles"), same).select(*(near[c] for c in near.columns), F.explode("shingles").alias("s"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    theirs = near.join(sent(prints.select("item_id", "shingles")), "item_id").select(*named, F.explode("shingles").alias("s"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = mine.union(theirs).groupBy(*named, "s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratio = (F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity")
    found = each.groupBy(*named).agg(ratio).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "item_id", "start", F.col("len").alias("n_words")).agg(F.max(F.struct("similarity", -F.col("distance"))).alias("b"))
    return best.select("doc_id", "item_id", "start", "n_words", (-F.col("b.col2")).alias("distance"), "b.similarity")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of documents that repeats a benchmark item; documents without one have no row."""
    return leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
