"""Feature preparation: vocabularies, encodings, imputation, weights and splits."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadlake.functions.scalar import strip
from dyadlake.sources.shared import cut, few

PAD, UNKNOWN = 0, 1


def field_tokens(rows: DataFrame, single: list[str], multi: list[str], order: list[Column]) -> DataFrame:
    """(field, token, first): every token with the place where it first appears (row order, then array place)."""
    one = [F.array(F.struct(F.lit(f).alias("field"), strip(F.col(f)).alias("token"), F.lit(0).alias("at"))) for f in single]
    many = [F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), _token_of(f)) for f in multi]
    each = rows.select(F.struct(*order).alias("row"), F.explode(F.concat(*one, *many)).alias("t")).where("t.token IS NOT NULL AND t.token <> ''")
    return each.groupBy("t.field", "t.token").agg(F.min(F.struct("row", "t.at")).alias("first"))


def _token_of(field: str):
    return lambda x, i: F.struct(F.lit(field).alias("field"), strip(x).alias("token"), i.alias("at"))


def build_vocab(rows: DataFrame, single: list[str], multi: list[str], order: list[Column], existing: DataFrame | None = None) -> DataFrame:
    """(field, token, id): ids 0 and 1 are padding and unknown, known ids never move, new tokens follow."""
    seen = field_tokens(rows, single, multi, order)
    if existing is None:
        base = seen.select("field").distinct().select("field", F.lit(UNKNOWN).alias("last"))
    else:
        seen = seen.join(existing.select("field", "token"), ["field", "token"], "left_anti")
        base = seen.select("field").distinct().join(existing.groupBy("field").agg(F.max("id").alias("last")), "field", "left").select("field", F.coalesce("last", F.lit(UNKNOWN)).alias("last"))
    n = F.row_number().over(W.partitionBy("field").orderBy("first", "token"))
    new = seen.join(base, "field").select("field", "token", (F.col("last") + n).cast("int").alias("id"))
    return new if existing is None else existing.select("field", "token", "id").unionByName(new)


def encode_single(rows: DataFrame, field: str, vocab: DataFrame) -> DataFrame:
    """rows with id_<field>: 0 for blank, 1 for unknown."""
    mine = vocab.where(F.col("field") == field).select(F.col("token").alias("_t"), F.col("id").alias("_i"))
    t = strip(F.col(field))
    out = rows.join(mine, t == F.col("_t"), "left")
    return out.withColumn(f"id_{field}", F.when(F.coalesce(t, F.lit("")) == "", PAD).otherwise(F.coalesce("_i", F.lit(UNKNOWN)))).drop("_t", "_i")


def encode_multi(field: str, vocab_map: Column) -> Column:
    """Sorted distinct ids of an array; blanks are skipped, unknown tokens are 1. vocab_map maps tokens to ids."""
    kept = F.filter(F.transform(F.coalesce(F.col(field), F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.coalesce(F.try_element_at(vocab_map, x), F.lit(UNKNOWN)))))


def encoded_arrays(rows: DataFrame, fields: list[str], vocab: DataFrame) -> DataFrame:
    """rows with ids_<field>: sorted distinct ids of arrays, as encode_multi makes them, by a join instead of a map.

    A vocabulary of any size is a table here: tokens are exploded, joined by field and token and gathered by row.
    """
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    kept = lambda f: F.filter(F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))
    each = F.flatten(F.array(*(F.transform(F.array_distinct(kept(f)), _struct_of(f)) for f in fields)))
    met = rows.select("_row", F.explode(each).alias("t")).select("_row", "t.*").join(vocab.select("field", "token", "id"), ["field", "token"], "left")
    ids = met.groupBy("_row").pivot("field", fields).agg(F.array_sort(F.collect_set(F.coalesce("id", F.lit(UNKNOWN)))))
    out = rows.join(ids.withColumnsRenamed({f: f"ids_{f}" for f in fields}), "_row", "left").drop("_row")
    return out.withColumns({f"ids_{f}": F.coalesce(f"ids_{f}", F.array().cast("array<int>")) for f in fields})


def _struct_of(field: str):
    return lambda x: F.struct(F.lit(field).alias("field"), x.alias("token"))


def missing_flags(fields: list[str]) -> list[Column]:
    value = lambda f: F.col(f).try_cast("double")
    return [(value(f).isNull() | F.isnan(value(f))).cast("double").alias(f"{f}_missing") for f in fields]


def _long(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields))).alias("v")).select("v.*")


def feature_presence(rows: DataFrame, fields: list[str]) -> DataFrame:
    return _long(rows, fields).groupBy("field").agg(F.count("value").alias("present"), F.count("*").alias("n_rows"))


def feature_profile(rows: DataFrame, fields: list[str]) -> DataFrame:
    return _long(rows, fields).groupBy("field").agg(F.count("value").alias("present"), F.count_if(F.col("value") != 0).alias("non_zero"), F.min("value").alias("least"), F.avg("value").alias("mean"), F.max("value").alias("most"))


def target_summary(rows: DataFrame, targets: list[str]) -> DataFrame:
    each = _long(rows.select(*(F.col(f"outcome_{t}").cast("double").alias(t) for t in targets)), targets)
    return each.groupBy(F.col("field").alias("target")).agg(F.sum("value").cast("long").alias("positives"), F.count("*").alias("n_rows"), F.avg("value").alias("rate"))


def class_weights(rows: DataFrame, targets: list[str], cap: float = 25.0) -> DataFrame:
    s = target_summary(rows, targets)
    neg = F.col("n_rows") - F.col("positives")
    w = F.when((F.col("positives") > 0) & (neg > 0), F.least(F.lit(cap), F.greatest(F.lit(1.0), neg / F.col("positives")))).otherwise(1.0)
    return s.select("target", w.alias("pos_weight"))


def _ordered(value: Column) -> Column:
    """A double as a long with the same order, from its bits."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + 0.0).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _value(ordered: int) -> float:
    """The double that _ordered made a long of."""
    bits = ordered if ordered >= 0 else ordered ^ ((1 << 63) - 1)
    return struct.unpack(">d", struct.pack(">q", bits))[0]


def medians(values: DataFrame, bits: int = 16) -> DataFrame:
    """(field, median) of (field, value), exactly: the mean of the two middle values; null without one.

    Both middles are found by histograms over the ordered bits of a double, `bits` at a time: each round counts the rows that
    share the bits found so far by their next ones. A round holds at most 2**bits counts for each field and middle,
    however many distinct values there are.
    """
    spark = values.sparkSession
    rows = cut(values.where("value IS NOT NULL").select("field", _ordered(F.col("value")).alias("o")))
    counts = rows.groupBy("field").agg(F.count("*").alias("n")).collect()  # a row for each field
    state = [(r.field, w, None, (r.n - 1 + w) // 2) for r in counts for w in (0, 1)]
    schema = "field string, which int, prefix long, k long"
    for shift in range(64 - bits, -1, -bits):
        asked = spark.createDataFrame(state, schema)
        near = rows.join(F.broadcast(asked), "field")  # two rows for each field
        if shift + bits < 64:
            near = near.where(F.shiftright("o", shift + bits) == F.col("prefix"))
        held = near.groupBy("field", "which", "k", F.shiftright("o", shift).alias("bin")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy("field", "which").orderBy("bin"))
        found = held.withColumn("upto", upto).where("k < upto").groupBy("field", "which", "k").agg(F.min(F.struct("bin", "upto", "n")).alias("m"))
        state = [(r.field, r.which, r.m.bin, r.k - (r.m.upto - r.m.n)) for r in found.collect()]  # two rows for each field
    ends = {}
    for field, _, ordered, _ in state:
        ends.setdefault(field, []).append(_value(ordered))
    return spark.createDataFrame([(f, sum(x) / 2) for f, x in ends.items()], "field string, median double")


def impute_stats(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, fill, mean, std): exact median, then mean and population deviation after filling."""
    base = cut(rows.select(*(F.col(f).cast("double").alias(f) for f in fields)))
    v = _long(base, fields).withColumn("value", F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value")))
    names = rows.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    fill = names.join(medians(v), "field", "left").select("field", F.coalesce("median", F.lit(0.0)).alias("fill"))
    filled = v.join(F.broadcast(fill), "field").withColumn("x", F.coalesce("value", "fill"))  # a row for each field
    std = F.stddev_pop("x")
    return filled.groupBy("field", "fill").agg(F.avg("x").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))


def normalize_numeric(rows: DataFrame, fields: list[str], stats: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Fields to (fill(x) - mean) / std, with their missing flags; stats has (fill, mean, std) of each field."""
    flags = missing_flags(fields)
    scaled = {f: (F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(stats[f][0])) - stats[f][1]) / stats[f][2] for f in fields}
    return rows.select(*(c for c in rows.columns if c not in fields), *(v.alias(k) for k, v in scaled.items()), *flags)


def chronological_split(rows: DataFrame, validation: float = 0.2, test: float = 0.1) -> DataFrame:
    """(cutoff_at, n, split): whole cutoffs, newest first, go to test until it has its share, then to validation, which leaves one to train.

    If test takes all of them, nothing is left to train: an error.
    """
    # one row for each cutoff
    per = rows.where("cutoff_at IS NOT NULL").groupBy("cutoff_at").agg(F.count("*").alias("n"))
    newest = W.orderBy(F.desc("cutoff_at"))
    before = lambda c: F.coalesce(F.sum(c).over(newest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = W.partitionBy()
    d = per.withColumn("total", F.sum("n").over(whole)).withColumn("k", F.row_number().over(newest)).withColumn("cuts", F.count("*").over(whole))
    d = d.withColumn("is_test", before("n") < F.col("total") * test)
    d = d.withColumn("m", F.when(F.col("is_test"), 0).otherwise(F.col("n")))
    d = d.withColumn("is_val", ~F.col("is_test") & (before("m") < F.col("total") * validation) & (F.col("k") <= F.col("cuts") - 1))
    d = d.withColumn("left", F.count_if(~F.col("is_test")).over(whole))
    split = F.when(F.col("left") == 0, F.raise_error("no cutoff is left to train on")).when(F.col("is_test"), "test").when(F.col("is_val"), "validation").otherwise("train")
    return d.select("cutoff_at", "n", split.alias("split"))


def split_rows(rows: DataFrame, key: list[str], seed: str, validation: float = 0.2, test: float = 0.1) -> tuple[DataFrame, str]:
    """(rows with split, how): chronological with at least three cutoffs, all of them timestamps; random otherwise."""
    at = F.col("cutoff_at").try_cast("timestamp_ntz")
    # two numbers
    n, unknown = rows.agg(F.count_distinct(at), F.count_if(at.isNull())).first()
    if n < 3 or unknown:
        return random_split(rows, key, seed, validation, test), "random"
    of = chronological_split(rows.select(at.alias("cutoff_at")), validation, test).select(F.col("cutoff_at").alias("_at"), "split")
    return rows.join(F.broadcast(of), at == F.col("_at")).drop("_at"), "chronological"  # a row for each cutoff


def random_split(rows: DataFrame, key: list[str], seed: str, validation: float = 0.2, test: float = 0.1) -> DataFrame:
    """rows with a split column in the order of a seeded hash; sizes round half to even, each at least one; under three rows all train."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in key)), 256)
    n = rows.count()
    v, t = (0, 0) if n < 3 else (max(1, round(n * validation)), max(1, round(n * test)))
    while v + t >= n and n >= 3:
        v, t = (v - 1, t) if v >= t else (v, t - 1)
    if n < 3:
        return rows.withColumn("split", F.lit("train"))
    return rows.withColumn("split", F.when(h <= _kth(rows, h, t), "test").when(h <= _kth(rows, h, v + t), "validation").otherwise("train"))


def _kth(rows: DataFrame, h: Column, k: int) -> str:
    """The k-th smallest of hex hashes: counts of 4,096 prefixes name the one that holds it, and only its rows are sorted."""
    start, before = F.substring(h, 1, 3), 0
    for prefix, n in rows.groupBy(start.alias("p")).count().orderBy("p").collect():
        if before + n >= k:
            return rows.where(start == prefix).select(h.alias("h")).orderBy("h").offset(k - before - 1).first()[0]
        before += n
    raise ValueError("k is larger than the number of rows")


SECTIONS = ["metadata", "categorical", "multi_categorical", "numeric", "numeric_missing", "compatibility", "compatibility_missing", "viewer_affinities", "candidate_affinities", "graph", "control", "targets", "target_counts"]


def prepare_rows(rows: DataFrame, sections: dict[str, list[str]], vocab: DataFrame) -> DataFrame:
    """rows as 13 nested sections of the named columns: tokens as ids, numbers with flags of what is missing; an unnamed section is null.

    Ids come from joins with the vocabulary's rows of a field, so it may have any size.
    """
    single, multi = sections.get("categorical", []), sections.get("multi_categorical", [])
    vocab = few(vocab)  # it is read for every field
    rows = rows.select(*dict.fromkeys(c for names in sections.values() for c in names))  # only these are written and shuffled
    each = encoded_arrays(rows, multi, vocab) if multi else rows
    for f in single:
        each = encode_single(each, f, vocab)
    built = {
        "categorical": [F.col(f"id_{f}").alias(f) for f in single],
        "multi_categorical": [F.col(f"ids_{f}").alias(f) for f in multi],
        "numeric_missing": [x for f in sections.get("numeric", []) for x in missing_flags([f])],
        "compatibility_missing": [x for f in sections.get("compatibility", []) for x in missing_flags([f])],
    }
    section = lambda name: F.struct(*built.get(name, [F.col(f) for f in sections.get(name, [])])).alias(name)
    named = lambda name: bool(built.get(name) or sections.get(name))
    return each.select(*(section(n) if named(n) else F.lit(None).cast("string").alias(n) for n in SECTIONS))


def row_contract(rows: DataFrame, required: list[str], finite: list[str], unit: tuple[str, ...] = (), flag: str | None = None) -> DataFrame:
    """(rule, violations) over prepared rows: required and finite fields, affinities between 0 and 1, an exclusion flag."""
    rules = [(f"required:{f}", F.col(f).isNull()) for f in required]
    rules += [(f"finite:{f}", F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf"))) for f in finite]
    rules += [(f"unit:{f}", F.col(f).isNull() | F.isnan(f) | ~F.col(f).between(0, 1)) for f in unit]
    rules += [(f"flag:{flag}", F.col(flag).isNull())] if flag else []
    totals = rows.agg(*(F.count_if(c).alias(f"r{i}") for i, (_, c) in enumerate(rules)))
    return totals.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (n, _) in enumerate(rules)))).alias("r")).select("r.*")
