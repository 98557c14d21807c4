"""Near-duplicate documents by b-bit MinHash.

Each document's distinct n-word shingles give HASHES minima. Runs of ROWS minima are band keys; documents
that share a band are candidates. The low 8 bits of every minimum are packed into a signature; the
number of equal bytes of two signatures, corrected for chance collisions (2^-8), estimates their
similarity and drops candidates far under the threshold; the rest are confirmed on their full sets.

At Jaccard 0.85, 20 bands of 4 rows miss a pair with probability (1 - 0.85^4)^20 = 4e-7, and the
estimate (deviation 0.04) is cut at 5 deviations under the threshold.

Rows with equal sets form a class, so copies never meet in pairs. The classes of a bucket are compared with
two hubs: the one that shares most buckets with others (a family's original, as a rule) and one by hash.
What is then still apart is closed by an exact bound before any pair is made: shingles that no other open class
holds limit the overlap, and with it the size of a partner. Only classes with a possible partner go
on; those outside a bucket's largest component are compared with the bucket in blocks inside tasks, which give
back links alone, one for each class and component that it meets. No link between different components is lost, and
no table holds a row for every pair of a group.

Defined results: texts that are null or without words have no shingle and no link; a text with fewer than n
words has one shingle, its whole word sequence; rows with a null doc_id keep their set size, are
linked with nothing, have a null component and are kept; every row is a node of its own, so rows that repeat a doc_id
with other texts may lie in other components; component_id is the smallest doc_id of a component; empty tables
give no rows; other columns are not read. Texts are processed whole.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadlake.llm import common
from dyadlake.llm.hashing import mix, shingle_sets

HASHES, ROWS = 80, 4
BITS = 8
BLOCK = 512  # classes of one side of a comparison inside a task
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_SALT = np.arange(1, HASHES // ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a non-empty set."""
    best = None
    for at in range(0, len(shingles), 4096):
        low = ((shingles[at : at + 4096, None] * _A + _B) >> np.uint64(32)).min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return mix(best * _A + _B)


def _slices(batch: pa.RecordBatch, rows: int = 2000, size: int = 8 << 20):
    """Parts of a batch with few rows and little text, so that no task holds the words of a whole batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held >= size or i + 1 - lo == rows:
            yield batch.slice(lo, i + 1 - lo)
            lo, held = i + 1, 0
    if lo < len(lengths):
        yield batch.slice(lo)


def _lowered(part: pa.RecordBatch) -> list[bytes]:
    return [(t or b"").lower() for t in part.column("text").to_pylist()]


def sketches(n: int):
    """mapInArrow: (doc_id, mark, text) to the size, two hashes of the set, band keys and the packed signature."""

    def row(s: np.ndarray) -> tuple:
        if not len(s):
            return 0, None, None, None, None
        low = minima(s)
        keys = np.zeros(HASHES // ROWS, np.uint64)
        for part in low.reshape(-1, ROWS).T:
            keys = keys * np.uint64(0xD6E8FEB86659FD93) + part
        a, b = np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
        return len(s), int(a.astype(np.int64)), int(b.astype(np.int64)), mix(keys + _SALT).astype(np.int64), low.astype(np.uint8).tobytes()

    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                rows = [row(s) for s in shingle_sets(_lowered(part), n)]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
                keys = [part.column("doc_id").cast(pa.int64()), part.column("mark")]
                yield pa.RecordBatch.from_arrays([*keys, *made], names=["doc_id", "mark", "n_shingles", "set_a", "set_b", "bands", "packed"])

    return run


def full_sets(n: int):
    """mapInArrow: (rep, text) to the sorted shingles of the text, packed."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                sets = [s.tobytes() for s in shingle_sets(_lowered(part), n)]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def _unpacked(batches):
    """(rep, shingles) to a row for each shingle."""
    for pdf in batches:
        for lo in range(0, len(pdf), 500):
            sets = [np.frombuffer(x, np.int64) for x in pdf["shingles"].iloc[lo : lo + 500]]
            yield pd.DataFrame({"shingle": np.concatenate(sets), "rep": np.repeat(pdf["rep"].to_numpy()[lo : lo + 500], [len(x) for x in sets])})


@F.pandas_udf(T.DoubleType())
def estimated(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity from equal bytes of two signatures, corrected for chance collisions."""
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, HASHES) for s in (a, b))
    chance = 2.0**-BITS
    return pd.Series(((x == y).mean(axis=1) - chance) / (1 - chance))


@F.pandas_udf(T.LongType())
def shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """The number of shingles in both sets."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |intersection| >= num * |union| on full sets."""
    one, two = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").withColumn("c", shared("sa", "sb"))
    size = F.octet_length("sa") / 8 + F.octet_length("sb") / 8
    return both.where(den * F.col("c") >= num * (size - F.col("c"))).select("a", "b")


def floor_of(similarity: float) -> float:
    """The least estimate that a pair of this similarity has but for 5 deviations."""
    return similarity - 5 * (similarity * (1 - similarity) / HASHES) ** 0.5


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): every class of a bucket with the bucket's two hubs."""
    liked = buckets.groupBy("rep").agg(F.sum("n").alias("liked"))
    ranked = buckets.join(liked, "rep")
    order = F.struct("liked", "rep"), F.struct(F.xxhash64("rep"), "rep")
    hubs = ranked.groupBy("band", "key").agg(*(F.max(o).alias(f"h{i}") for i, o in enumerate(order)))
    hubs = hubs.select("band", "key", F.explode(F.array("h0.rep", "h1.rep")).alias("b")).distinct()
    return buckets.join(hubs, ["band", "key"]).where("rep <> b").select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()


def reaching(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """rows (band, key, rep, comp, n_shingles) that may have a link in their bucket, with reach.

    Shingles that no other class of rows holds are in no overlap, so a partner's size is at most reach.
    """
    held = sets.join(rows.select("rep").distinct(), "rep", "left_semi").mapInPandas(_unpacked, "shingle long, rep long")
    alone = held.groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other").groupBy("rep").agg(F.count("*").alias("alone"))
    overlap = F.col("n_shingles") - F.coalesce("alone", F.lit(0))
    reach = F.floor(((num + den) * overlap - num * F.col("n_shingles")) / num)
    rows = common.cut(rows.join(alone, "rep", "left").withColumn("reach", reach).drop("alone"))
    ends = rows.groupBy("band", "key").agg(F.min("n_shingles").alias("least"), F.max("reach").alias("most"))
    return rows.join(ends, ["band", "key"]).where("reach >= least and n_shingles <= most").drop("least", "most")


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """rows dealt to blocks (band, key, qb, mb) with the sides asks and answers.

    In each bucket the classes outside its largest component ask, all answer, and each asking block
    meets each answering block once.
    """
    comps = rows.groupBy("band", "key", "comp").agg(F.count("*").alias("n"))
    of = comps.groupBy("band", "key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("big")).where("big.n < all")
    of = of.select("band", "key", F.col("big.comp").alias("big"), F.ceil(F.col("all") / size).cast("int").alias("mbs"), F.ceil((F.col("all") - F.col("big.n")) / size).cast("int").alias("qbs"))
    rows = rows.join(of, ["band", "key"])
    qb, mb = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("qbs")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(2)), F.col("mbs")).cast("int")
    asks = F.col("comp") != F.col("big")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.where(asks).select("*", qb.alias("qb"), every("mbs").alias("mb"), F.lit(0).alias("side"))
    two = rows.select("*", every("qbs").alias("qb"), mb.alias("mb"), F.when(asks, 2).otherwise(1).alias("side"))
    return one.unionByName(two).drop("mbs", "qbs", "big")


def _groups(batches, by: list[str]):
    """Runs of equal keys in sorted batches, each as one frame."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[by]
        new = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
        if held and (held[-1][by].iloc[-1] == keys.iloc[0]).all():
            new = new[1:]
        for lo, hi in zip(np.append(0, new), np.append(new, len(pdf)), strict=True):
            if lo in new and held:
                yield pd.concat(held)
                held = []
            if hi > lo:
                held.append(pdf.iloc[lo:hi])
    if held:
        yield pd.concat(held)


def compared(num: int, den: int):
    """mapInPandas over sorted blocks: links (a, b), at most one for each asking class and component of a block."""
    least = floor_of(num / den)

    def run(batches):
        for group in _groups(batches, ["band", "key", "qb", "mb"]):
            ask, all_ = group[group["side"] == 0], group[group["side"] > 0]
            if not len(ask) or not len(all_):
                continue
            rep, comp, size, reach, side = (all_[c].to_numpy() for c in ("rep", "comp", "n_shingles", "reach", "side"))
            band, bands, packed = int(group["band"].iloc[0]), np.stack(all_["bands"].to_numpy()), np.stack([np.frombuffer(x, np.uint8) for x in all_["packed"]])
            sets = [np.frombuffer(x, np.uint64) for x in all_["shingles"]]
            out = []
            for x in ask.itertuples():
                may = (comp != x.comp) & (size <= x.reach) & (x.n_shingles <= reach) & ((side == 1) | (rep < x.rep))
                may &= ~(bands[:, :band] == np.asarray(x.bands)[:band]).any(axis=1)  # met in a band before
                at = np.flatnonzero(may)
                same = (packed[at] == np.frombuffer(x.packed, np.uint8)).mean(axis=1)
                at = at[(same - 2.0**-BITS) / (1 - 2.0**-BITS) >= least]
                if not len(at):
                    continue
                own, theirs = np.frombuffer(x.shingles, np.uint64), np.concatenate([sets[i] for i in at])
                hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[at]) - size[at])
                at = at[den * both >= num * (len(own) + size[at] - both)]
                for i in at[np.unique(comp[at], return_index=True)[1]]:
                    out.append((x.rep, rep[i]))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def rest_links(buckets: DataFrame, comp: DataFrame, reps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """Links between components that share a bucket; None if there are no such buckets."""
    open_ = buckets.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    mixed = open_.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "key")
    open_ = common.cut(open_.join(mixed, ["band", "key"]).select("band", "key", "rep", "comp", "n_shingles"))
    if not open_.limit(1).count():
        return None
    dealt = common.cut(blocks(reaching(open_, sets, num, den)))
    by = ["band", "key", "qb", "mb"]
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.join(reps.select("rep", "bands", "packed"), "rep").join(sets, "rep").repartition(n, *by).sortWithinPartitions(*by)
    return common.cut(rows.mapInPandas(compared(num, den), "a long, b long"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows for the jobs that run meanwhile: ten thousand texts or sets at once are too much for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def near_duplicates(docs: DataFrame, n: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, group) of every row; docs are linked at a Jaccard of num/den or more.

    mark is a hash of the text, group tells components apart; both are null where component_id is, but for mark.
    """
    with small_batches(docs.sparkSession):  # all jobs with Python workers run here; what is returned joins written tables
        return _near_duplicates(docs, n, num, den)


def _near_duplicates(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, mark long, n_shingles long, set_a long, set_b long, bands array<long>, packed binary"
    every = common.cut(docs.mapInArrow(sketches(n), schema))
    # rows with equal sets are one class; its number is fixed once it is written
    key = ["n_shingles", "set_a", "set_b"]
    linkable = every.where("doc_id is not null and n_shingles > 0")
    reps = linkable.groupBy(*key).agg(F.min(F.struct("doc_id", "mark", "bands", "packed")).alias("r"))
    reps = common.cut(reps.select(F.monotonically_increasing_id().alias("rep"), *key, "r.*"))
    buckets = reps.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    crowded = buckets.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = common.cut(buckets.join(crowded, ["band", "key"]))
    groups = None
    if buckets.limit(1).count():
        wanted = reps.join(buckets.select("rep").distinct(), "rep", "left_semi").select("doc_id", "mark", "rep")
        sets = common.cut(docs.join(wanted, ["doc_id", "mark"]).select("rep", "text").mapInArrow(full_sets(n), "rep long, shingles binary"))
        sketch = reps.select("rep", "n_shingles", "packed")
        one, two = (sketch.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("packed").alias(f"p{x}")) for x in ("a", "b"))
        near = hub_pairs(buckets).join(one, "a").join(two, "b").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
        near = near.where(estimated("pa", "pb") >= floor_of(num / den))
        links = common.cut(confirmed(near, sets, num, den).distinct())
        comp = common.components(links)
        more = rest_links(buckets, comp, reps, sets, num, den)
        if more is not None and more.limit(1).count():
            comp = common.components(links.union(more))
        low = comp.withColumnRenamed("node", "rep").join(reps.select("rep", "doc_id"), "rep")
        groups = low.join(low.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("rep", "component", "least")
    of = reps.select("rep", *key, "doc_id")
    of = of.join(groups, "rep", "left") if groups is not None else of.withColumns({"component": F.lit(None).cast("long"), "least": F.lit(None).cast("long")})
    of = of.select(*(F.col(c).alias(f"_{c}") for c in key), F.coalesce("component", "rep").alias("group"), F.coalesce("least", "doc_id").alias("least"))
    same = [every["doc_id"].isNotNull(), *(every[c] == of[f"_{c}"] for c in key)]
    out = every.join(of, same, "left")
    return out.select("doc_id", "mark", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "group")


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document at 3-word shingles and a Jaccard of 0.85."""
    found = near_duplicates(common.documents(spark, sf_dir)).drop("mark", "group")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.reach
), c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""
