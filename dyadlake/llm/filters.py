"""An audit of how document filters interact: what each removes alone, in each order, and at what price.

The filters: A under 200 words, B few distinct words, C many capitals, D a symbol, E a text that a
smaller doc_id holds too, anywhere in the table. A-D follow from the text; E is found by radix tries.
Every task first inserts its own texts into a trie; rows that its own least id already decides
go on without their text, and each distinct text is sent once, with its least id, to the range of
texts that it falls in. Ranges end at adaptive prefixes of texts: just long enough to tell neighbours
apart, and placed by sums over distinct texts so that no range exceeds its share of bytes;
where one long prefix is too heavy, it is looked at four times as far. Each range's texts meet in one
trie, whose terminals hold the least id; a row is a duplicate if that id is smaller than its own.
What is left of a row are its key, lang and five bits. Labels are joined to those, they are counted by mask,
and all orders of the filters are worked out from the counts.

Defined results: a null text is empty, and has no words; a null lang and an empty one are one
part; a row with a null doc_id repeats nothing and is repeated by nothing; rows that repeat a doc_id with the same
text don't repeat each other; a document that labels names more than once is good or toxic if any row says so;
without labels nothing is lost; an empty table gives no rows; other columns are not read. Texts are processed whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadlake.llm import common
from dyadlake.llm.tries import RadixTrie, common_prefix

FILTERS = "ABCDE"
FIRST = 4096  # code points of a task's first prefix that may be a start as a whole
REACH = 64  # code points of a text that the first look at prefixes takes
RANGE_BYTES = 64 << 20  # of distinct texts in one range at most, but for a single text
_CAPITALS, _FOLLOWING = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_MARK = re.compile(rb"[#$%&*|]")
_ROW = "bucket int, doc_id long, lang string, mask int, n long, text binary"
_ROW_TYPES = {"bucket": pa.int32(), "doc_id": pa.int64(), "lang": pa.string(), "mask": pa.int32(), "n": pa.int64(), "text": pa.binary()}
_MASKED = ["doc_id", "lang", "mask", "n"]


def text_mask(text: bytes) -> int:
    """The failed filters of A-D as bits 0-3."""
    words = text.split()  # bytes split at space and 0x09 to 0x0D
    points = len(text.translate(None, _FOLLOWING))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    few, alike = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    return few | alike << 1 | (100 * capitals > 3 * points) << 2 | bool(_MARK.search(text)) << 3


# ---------------------------------------------------------------- ranges


def prefixes(docs: DataFrame, reach: int, heavy: DataFrame | None = None) -> DataFrame:
    """(prefix, bytes) over distinct texts; with heavy (short), only of texts that begin with one of those."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(text.alias("text"))
    if heavy is not None:
        # at most one heavy prefix for each share of all bytes
        rows = rows.join(F.broadcast(heavy), F.substring("text", 1, reach // 4) == F.col("short"), "left_semi")
    narrow = rows.select(F.substring("text", 1, reach).alias("prefix"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("b"))
    # copies of a text count once, as each task sends it once
    return narrow.groupBy("prefix", "h").agg(F.max("b").alias("b")).groupBy("prefix").agg(F.sum("b").alias("bytes"))


def cuts(rows: DataFrame, share: int) -> list[bytes]:
    """Where ranges of up to `share` bytes begin, from (prefix, bytes): at most two for each share and one for each task.

    Prefixes are dealt to tasks by range and in order; each task cuts its own part of the order. Its first
    prefix begins a range too, unless it is very long: then two shares may meet there.
    """

    def run(batches):
        total, before, out = 0, None, []
        for batch in batches:
            for now, size in zip(batch.column("prefix").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if before is None and len(now) <= 4 * FIRST:
                    out.append(now)
                elif before is not None and total and total + size > share:
                    out.append(now[: common_prefix(before, 0, now, 0, min(len(before), len(now))) + 1])
                    total = 0
                before, total = now, total + size
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["cut"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col("prefix").cast("binary"), "bytes").repartitionByRange(n, "prefix").sortWithinPartitions("prefix")
    return sorted(r.cut for r in dealt.mapInArrow(run, "cut binary").collect())


def range_starts(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> list[bytes]:
    """The first bytes of every range but the first, in order.

    A range holds at most range_bytes of distinct texts and a quarter of an even share of a task, so
    that there are at most that many starts; a single longer text has a range of its own.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach, heavy, found, share = REACH, None, set(), 0
    while True:
        rows = common.cut(prefixes(docs, reach, heavy))
        about = rows.agg(F.sum("bytes").alias("all"), F.max(F.octet_length("prefix")).alias("longest")).first()
        if about["all"] is None:
            break
        share = share or max(1, min(range_bytes, about["all"] // (4 * n)))
        found |= set(cuts(rows, share))
        # a prefix that is heavier than a range and shorter than its texts is looked at further
        heavy = rows.where((F.col("bytes") > share) & (F.char_length("prefix") == reach)).select(F.col("prefix").alias("short"))
        if not heavy.limit(1).count():
            break
        reach *= 4
    return sorted(found)


# ---------------------------------------------------------------- tries


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ROW_TYPES[c]) for i, c in enumerate(names)], names=names)


def own_tries(starts: list[bytes], held: int = 64 << 20):
    """mapInArrow: rows of documents to (bucket, doc_id, lang, mask, n, text); text is null where this task knows the verdict.

    A trie that holds more than `held` bytes is sent on and another begun.
    """
    ranges, names = len(starts) + 1, list(_ROW_TYPES)

    def send(trie: RadixTrie, texts: dict[int, bytes], masks: dict[int, int], rows: dict[tuple, int]):
        out, size = [], 0
        for i, ((node, key, lang), n) in enumerate(rows.items()):
            if key is None or key > trie.least[node]:  # decided, so it may go anywhere
                out.append((ranges + i % ranges, key, lang, masks[node] | (0 if key is None else 16), n, None))
            else:
                text = texts[node]
                out.append((bisect_right(starts, text), key, lang, masks[node], n, text))
                size += len(text)
            if len(out) >= 5000 or size > 8 << 20:
                yield _batch(out, names)
                out, size = [], 0
        yield _batch(out, names)

    def run(batches):
        trie, texts, masks, rows, size = RadixTrie(), {}, {}, {}, 0
        for batch in batches:
            for key, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                node = trie.insert(text, key)
                if node not in texts:
                    texts[node], masks[node] = text, text_mask(text)
                    size += len(text)
                at = (node, key, lang)
                rows[at] = rows.get(at, 0) + 1
                if size > held or len(rows) > 200_000:
                    yield from send(trie, texts, masks, rows)
                    trie, texts, masks, rows, size = RadixTrie(), {}, {}, {}, 0
        yield from send(trie, texts, masks, rows)

    return run


def range_tries(batches):
    """mapInArrow over rows sorted by range: (doc_id, lang, mask, n), with bit 4 for a text whose terminal holds a smaller id."""

    def send(trie: RadixTrie, rows: list[tuple]) -> pa.RecordBatch:
        return _batch([(key, lang, mask | (16 if trie.least[node] < key else 0), n) for node, key, lang, mask, n in rows], _MASKED)

    bucket, trie, rows = None, RadixTrie(), []
    for batch in batches:
        yield batch.filter(batch.column("text").is_null()).select(_MASKED)
        rest = batch.filter(batch.column("text").is_valid())
        for at, key, lang, mask, n, text in zip(*(rest.column(c).to_pylist() for c in _ROW_TYPES), strict=True):
            if at != bucket:
                yield send(trie, rows)
                bucket, trie, rows = at, RadixTrie(), []
            rows.append((trie.insert(text, key), key, lang, mask, n))
    yield send(trie, rows)


def masked(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, lang, mask, n): the failed filters of every document as bits; rows of one doc_id, lang and text may come as one."""
    starts = range_starts(docs, range_bytes)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce("lang", F.lit("")).alias("lang")
    )
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (len(starts) + 1) // 4)
    sent = rows.mapInArrow(own_tries(starts), _ROW).repartition(n, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(range_tries, "doc_id long, lang string, mask int, n long")


# ---------------------------------------------------------------- counts


def audit(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from (doc_id, lang, mask, n) and (doc_id, quality, toxic)."""
    marks = [F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(*marks)
    rows = masks.join(flags, "doc_id", "left")
    sums = [F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]
    # at most 32 rows for each part
    by_mask = common.cut(rows.groupBy(F.col("lang").alias("part"), "mask").agg(F.sum("n").alias("n"), *sums))
    steps = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            before = sum(1 << j for j in order[: step - 1])
            steps.append(F.struct(F.lit(name).alias("filter_order"), F.lit(step).alias("step"), F.lit(1 << i).alias("bit"), F.lit(before).alias("before")))
    rows = by_mask.select("*", F.explode(F.array(*steps)).alias("s")).select("*", "s.*")
    gone, fails = F.expr("mask & before") != 0, F.expr("mask & bit") != 0
    here = ~gone & fails
    count = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")
    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        count(~gone & ~fails).alias("kept"),
        count(here).alias("removed"),
        count(gone & fails).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(here, "good").alias("good_lost"),
        count(here, "toxic").alias("toxic_lost"),
    )
    # 120 rows share a part and a filter
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit")).cast("long")).drop("bit")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the five filters remove from documents in every order, for each part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audit(masked(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t
), f AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(least < doc_id, false)] AS f FROM w
), l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, f
), k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (
  SELECT list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, k AS step, o[k] AS i, o[1 : k - 1] AS before FROM o, k
), r AS (
  SELECT *, len(list_filter(before, lambda x: f[x])) > 0 AS gone, f[i] AS fails, len(list_filter(f, lambda x: x)) AS failed FROM m, s
), g AS (
  SELECT part, filter_order, step, i, sum(n * CAST(NOT gone AND NOT fails AS INT)) AS kept, sum(n * CAST(NOT gone AND fails AS INT)) AS removed,
    sum(n * CAST(gone AND fails AS INT)) AS redundant, sum(n * CAST(fails AND failed = 1 AS INT)) AS unique_fails,
    sum(good * CAST(NOT gone AND fails AS INT)) AS good_lost, sum(toxic * CAST(NOT gone AND fails AS INT)) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, i
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM g
"""
