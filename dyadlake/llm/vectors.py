"""Near-duplicate vectors by small-world graphs, one for each shard of a label.

Rows with the same label and the same vector are one class, counted before anything is shuffled. The
classes of a label are dealt to shards of about SHARD by hash, each with a graph of its own. Every
shard's vectors are asked of every shard of their label, in tasks of two shards, both ways; what
either way finds counts. A task's audit compares the answers to a sample of its queries with all their
similarities and widens the beam until no link is missing and nine in ten nearest vectors were seen. When all
were asked, links found one way only tell how many both ways miss; from half a link on the
widest beam asks again. Beyond WIDE the beam is the whole shard, so the audit always ends. Each link is confirmed by the cosine in double precision. Tasks return
a row for each class that has links (how many, and one vector that it is connected with), not pairs; those rows are united
to components. Work grows with the shards' pairs within a label, as asking every shard does.

Defined results: rows with a null label or vec_id and vectors that are null, empty, zero or hold a null or
non-finite component have no links; vectors of different lengths neither; every row counts as a
vector of its own, also where vec_id repeats; a null vec_id has a null component and is kept;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.llm import common
from dyadlake.llm.worlds import World

COSINE = 0.93
SHARD = 4096  # classes of a shard, about
BEAM, WIDE = 32, 128  # a beam beyond WIDE costs more than all similarities of a shard
SAMPLE = 64  # audited queries of a task, each way
ASKED = 1024  # queries that take their steps together


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component goes first, so that squares stay finite."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Shard:
    """A graph with the numbers and row counts of its classes."""

    def __init__(self, reps: np.ndarray, rows: np.ndarray, vectors: np.ndarray, world: World | None = None):
        self.reps, self.rows, self.vectors = reps, rows, vectors
        self.world = world or World(unit(vectors))

    def packed(self) -> bytes:
        single = self.vectors.astype(np.float32)
        held = single if (single == self.vectors).all() else self.vectors
        out = io.BytesIO()
        np.savez(out, reps=self.reps, rows=self.rows, vectors=held, order=self.world.order, **{f"links{i}": x for i, x in enumerate(self.world.links)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, blob: bytes) -> Shard:
        with np.load(io.BytesIO(blob)) as z:
            world = World.__new__(World)
            world.x, world.order = unit(z["vectors"]), z["order"]
            world.links = [z[f"links{i}"] for i in range(sum(name.startswith("links") for name in z.files))]
            world.top = len(world.links) - 1
            return cls(z["reps"], z["rows"], z["vectors"], world)


def asked(queries: World, of: World, least: float, width: int) -> np.ndarray:
    """Whether each query (row) found each node (column) near."""
    parts = [of.within(queries.x[lo : lo + ASKED], least, width)[0] for lo in range(0, len(queries.x), ASKED)]
    return np.concatenate(parts) if parts else np.zeros((0, len(of.x)), bool)


def linked(a: World, b: World | None, least: float, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """(links between a and b as a matrix, the beam that passed the audit); b is None for the links within a.

    The sample alone is asked with wider and wider beams until it passes; then all are asked, both ways, and if what
    the two ways tell of each other is too little, once more with the widest.
    """
    alone, b = b is None, b or a
    whole = max(len(a.x), len(b.x))
    ways = [(a, b)] if alone else [(a, b), (b, a)]
    missed, width = True, beam
    while missed and width < whole:
        missed = False
        for q, of in ways:
            sample = np.random.default_rng(len(q.x)).permutation(len(q.x))[:SAMPLE]
            sims = q.x[sample] @ of.x.T
            near, seen = of.within(q.x[sample], least, width)
            if alone:
                sims[np.arange(len(sample)), sample] = -np.inf
            met = seen[np.arange(len(sample)), sims.argmax(axis=1)].mean()
            missed |= bool(((sims >= least) & ~near).any()) or met < 0.9
        if missed:
            width = 2 * width if width < WIDE else whole
    while True:
        one = asked(a, b, least, width)
        two = one.T if alone else asked(b, a, least, width).T
        both, twice, once = one | two, int((one & two).sum()), int((one & ~two).sum()) * int((two & ~one).sum())
        if width >= whole or once < 0.5 * max(1, twice):
            break
        width = whole
    if alone:
        np.fill_diagonal(both, False)
    return both, width


def roots(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number that each row and each column reaches over links; its own where it has none."""
    left, right = links.any(axis=1), links.any(axis=0)
    to_a, to_b = a.copy(), b.copy()
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        front, in_a, in_b = np.array([i]), [], []
        while len(front):
            left[front] = False
            in_a.append(front)
            other = np.flatnonzero(links[front].any(axis=0) & right)
            right[other] = False
            in_b.append(other)
            front = np.flatnonzero(links[:, other].any(axis=1) & left) if len(other) else other
        in_a, in_b = np.concatenate(in_a), np.concatenate(in_b)
        low = min(a[in_a].min(), b[in_b].min())
        to_a[in_a], to_b[in_b] = low, low
    return to_a, to_b


def graphs(pdf: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard."""
    pdf = pdf.sort_values("rep")
    shard = Shard(pdf["rep"].to_numpy(), pdf["rows"].to_numpy(), np.stack(pdf["e"].to_numpy()))
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "shards": pdf["shards"].iloc[:1], "graph": [shard.packed()]})


def compared(least: float):
    """applyInPandas over one or two shards: (rep, other, links) of every class with a link between them."""

    def counts(links: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([links[lo : lo + 512].astype(np.int64) @ rows for lo in range(0, len(links), 512)] or [np.zeros(0, np.int64)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shards = [Shard.unpacked(blob) for blob in pdf.sort_values("shard")["graph"]]
        a, b = shards[0], shards[-1]
        links, _ = linked(a.world, b.world if len(shards) > 1 else None, least)
        to_a, to_b = roots(links, a.reps, b.reps)
        sides = [(a, to_a, counts(links, b.rows))] + ([(b, to_b, counts(links.T, a.rows))] if len(shards) > 1 else [])
        out = [pd.DataFrame({"rep": s.reps, "other": to, "links": n})[n > 0] for s, to, n in sides]
        if len(shards) == 1:  # a node is a row and a column; both ends count
            out.append(pd.DataFrame({"rep": a.reps, "other": to_b, "links": 0})[to_b != to_a])
        return pd.concat(out)

    return run


def classes(vectors: DataFrame) -> DataFrame:
    """(rep, label, dim, e, rows, least): one row for each label and vector, with its count and least vec_id."""
    same = vectors.where("usable").groupBy("label", "e").agg(F.count("*").alias("rows"), F.min("vec_id").alias("least"))
    return common.cut(same.select(F.monotonically_increasing_id().alias("rep"), "label", F.size("e").alias("dim"), "e", "rows", "least"))


def near_duplicates(vectors: DataFrame, least: float = COSINE, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of vectors (vec_id, embedding, label)."""
    fine = F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("usable", F.coalesce(fine & F.expr("label is not null and vec_id is not null"), F.lit(False)))
    same = classes(rows)
    # one row for each label and length; large only if labels are
    sizes = same.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = same.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    schema = "label string, dim int, shard int, shards int, graph binary"
    built = common.cut(dealt.groupBy("label", "dim", "shard").applyInPandas(graphs, schema))
    # a shard's graph goes to each task that it shares with another shard: one or two graphs a task
    pairs = built.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    pairs = pairs.withColumns({"low": F.least("shard", "with"), "high": F.greatest("shard", "with")})
    found = common.cut(pairs.groupBy("label", "dim", "low", "high").applyInPandas(compared(least), "rep long, other long, links long"))
    comp = common.components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")).where("a <> b"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of = same.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    of = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    of = of.select(F.col("label").alias("_label"), F.col("e").alias("_e"), (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component_id")
    out = rows.join(of, rows["usable"] & (rows["label"] == of["_label"]) & (rows["e"] == of["_e"]), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op11_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every row of embeddings at a cosine of 0.93 within a label."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), r(vec_id, reach) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.reach
), c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
