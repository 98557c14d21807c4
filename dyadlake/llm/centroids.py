"""Centroid clustering of vectors in exact integers, by a vantage-point tree over the centroids.

Every round builds the tree of the at most CENTROIDS centroids on the driver and sends it with the
tasks. A vector walks it best first: the open subtree with the least bound is entered next, the
distance to its vantage point is computed in integers, and subtrees whose bound is above the best
distance so far are never entered. The radius is inclusive, so that an equally distant centroid with
a smaller number is still met. Vectors of a batch take their steps together in numpy, each on its
own frontier. Tasks return one partial sum for each centroid and component, never vectors.

Defined results: vectors that are null, don't have DIMENSIONS components, or hold a null or a
non-finite one are left out; every row is a vector of its own, also where vec_id repeats; a null
vec_id is assigned but never a first centroid; with fewer vectors than CENTROIDS there are fewer
centroids; equal first centroids leave the later one empty, and empty ones stay; ties go to the smaller
number; an empty table gives no rows; other columns are not read. Components too large for 64-bit
sums are carried as Python integers; a distance or sum beyond a long is null.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.llm import common

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Up to this size squared distances of DIMENSIONS components stay under 2**63.
SAFE = 1 << 27
LIMB = 40
LONG = (1 << 63) - 1


class Tree:
    """A vantage-point tree: one centroid a node, with the range of distances of each child's centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.safe = all(abs(v) <= SAFE for c in centroids for v in c)
        self.points = np.array(centroids, np.int64 if self.safe else object).reshape(len(centroids), -1)
        n = len(centroids)
        self.number, self.child = np.zeros(n, int), np.full((n, 2), -1)
        self.low, self.high = np.zeros((n, 2)), np.zeros((n, 2))
        self._used = 0
        if n and self.safe:
            self._grow(list(range(n)))

    def _grow(self, members: list[int]) -> int:
        at, self._used = self._used, self._used + 1
        self.number[at], rest = members[0], members[1:]
        point = self.points[members[0]]
        far = {m: int(((self.points[m] - point) ** 2).sum()) for m in rest}
        rest.sort(key=lambda m: (far[m], m))
        half = (len(rest) + 1) // 2
        for side, part in enumerate((rest[:half], rest[half:])):
            if part:
                self.low[at, side], self.high[at, side] = math.sqrt(far[part[0]]), math.sqrt(far[part[-1]])
                self.child[at, side] = self._grow(sorted(part))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of every row of integers."""
        if not self.safe or x.dtype == object:
            far = np.array([[int(d) for d in ((x.astype(object) - c) ** 2).sum(axis=1)] for c in self.points], object)
            best = [min(range(len(far)), key=lambda c: (far[c, i], c)) for i in range(len(x))]
            return np.array(best, int), np.array([far[c, i] for i, c in enumerate(best)], object)
        frontier = np.full((len(x), len(self.number)), np.inf)
        frontier[:, 0] = 0
        best, number = np.full(len(x), LONG), np.full(len(x), len(self.number))
        live = np.arange(len(x))
        while len(live):
            node = frontier[live].argmin(axis=1)
            bound = frontier[live, node]
            go = bound <= np.sqrt(best[live].astype(float)) * (1 + 1e-12)  # inclusive: ties are met
            live, node, bound = live[go], node[go], bound[go]
            frontier[live, node] = np.inf
            mine = self.number[node]
            square = ((x[live] - self.points[mine]) ** 2).sum(axis=1)
            better = (square < best[live]) | ((square == best[live]) & (mine < number[live]))
            best[live[better]], number[live[better]] = square[better], mine[better]
            distance = np.sqrt(square.astype(float))
            for side in (0, 1):
                has = self.child[node, side] >= 0
                low, high, d = self.low[node, side][has], self.high[node, side][has], distance[has]
                least = np.maximum(low - d, d - high) - 1e-12 * (d + high)  # under the true bound, whatever is rounded
                frontier[live[has], self.child[node, side][has]] = np.maximum(least, bound[has])
        return number, best


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, e) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", e.alias("e")).where((F.size("e") == DIMENSIONS) & fine)


def _integers(batch: pa.RecordBatch) -> np.ndarray:
    """floor(SCALE * x) of a batch's vectors; Python integers where one is too large."""
    x = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    if not len(x) or np.abs(x).max() < SAFE / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[math.floor(Fraction(v) * SCALE) for v in row] for row in x.tolist()], object)


def _limbs(value: int):
    """(place, digit) of a signed integer in base 2**LIMB, so that digits add up in a long."""
    sign, value, place = (1, value, 0) if value >= 0 else (-1, -value, 0)
    while value:
        yield place, sign * (value & ((1 << LIMB) - 1))
        value, place = value >> LIMB, place + 1


def partial_sums(tree: Tree):
    """mapInArrow: one row for each centroid, component and digit of a task's sums; component -1 counts."""

    def run(batches):
        k = len(tree.exact)
        total, count = np.zeros((k, DIMENSIONS), object), np.zeros(k, np.int64)
        for batch in batches:
            x = _integers(batch)
            number, _ = tree.nearest(x)
            count += np.bincount(number, minlength=k)
            for c in np.unique(number):
                total[c] += x[number == c].sum(axis=0).astype(object)
        rows = [(c, -1, 0, int(count[c])) for c in range(k)]
        rows += [(c, i, place, digit) for c in range(k) for i in range(DIMENSIONS) for place, digit in _limbs(int(total[c, i]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SUM_TYPES, strict=True)], names=_SUM_NAMES)

    return run


_SUM_NAMES, _SUM_TYPES = ["cluster", "i", "place", "digit"], [pa.int32(), pa.int32(), pa.int32(), pa.int64()]


def assignments(tree: Tree):
    """mapInArrow: (vec_id, cluster, distance) of every vector."""

    def run(batches):
        for batch in batches:
            number, square = tree.nearest(_integers(batch))
            square = [int(d) if d <= LONG else None for d in square.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(number, pa.int32()), pa.array(square, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the least hash of their key; each task sends its own k at most."""
    ranked = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    return [[math.floor(Fraction(v) * SCALE) for v in r.e] for r in ranked.orderBy("h", "e").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round of assignment."""
    sums = vectors.mapInArrow(partial_sums(Tree(centroids)), "cluster int, i int, place int, digit long")
    # one row for each centroid, component and digit: at most a few thousand
    rows = sums.groupBy("cluster", "i", "place").agg(F.sum("digit").alias("digit")).collect()
    total: dict[tuple[int, int], int] = {}
    for r in rows:
        total[r.cluster, r.i] = total.get((r.cluster, r.i), 0) + (r.digit << (LIMB * r.place))
    return [
        [total.get((c, i), 0) // total[c, -1] for i in range(DIMENSIONS)] if total.get((c, -1)) else old
        for c, old in enumerate(centroids)
    ]


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every usable vector, the final centroids)."""
    rows = usable(vectors)
    centroids = first_centroids(rows, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)
    if not centroids:
        return rows.select(F.col("vec_id").cast("long"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    return rows.mapInArrow(assignments(Tree(centroids)), "vec_id long, cluster int, distance long"), centroids


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, squared distance and inertia of every usable vector of embeddings."""
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = common.cut(found)
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(whole.alias("s")).collect()}
    inertia = sum(sums.values()) if None not in sums.values() else None
    fit = lambda x: int(x) if x is not None and x <= LONG else None
    rows = [(c, fit(s), fit(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(of: str, after: str, last: bool = False) -> str:
    """SQL of an assignment to the centroids `of`, and of the centroids that follow."""
    near = f"""a{after} AS MATERIALIZED (
  SELECT vec_id, CAST(m % 16 AS INT) AS c, m // 16 AS d FROM (
    SELECT vec_id, min(d * 16 + c) AS m FROM (
      SELECT vec_id, c, sum((x.v - k.v) * (x.v - k.v)) AS d FROM x JOIN {of} k USING (i) GROUP BY vec_id, c) GROUP BY vec_id)
)"""
    if last:
        return near
    return f"""{near}, s{after} AS (SELECT c, i, sum(v) AS s, count(*) AS n FROM a{after} JOIN x USING (vec_id) GROUP BY c, i),
c{after} AS MATERIALIZED (
  SELECT k.c, k.i, CASE WHEN n IS NULL THEN k.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM {of} k LEFT JOIN s{after} USING (c, i)
)"""


ORACLE = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, unnest(e) AS v FROM e),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM e QUALIFY c < 16),
c0 AS MATERIALIZED (SELECT c, i, CAST(v AS HUGEINT) AS v FROM f JOIN x USING (vec_id)),
{_round("c0", "1")},
{_round("c1", "2")},
{_round("c2", "3")},
{_round("c3", "4", last=True)},
t AS (SELECT c, sum(d) AS ci FROM a4 GROUP BY c),
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS sha FROM c3 GROUP BY c)
SELECT vec_id, c AS "cluster", CAST(d AS BIGINT) AS distance, CAST(ci AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(d) FROM a4) AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a4 JOIN t USING (c) JOIN h USING (c)
"""
