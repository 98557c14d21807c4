"""Secret scans over a trigram inverted index, in DataFrame functions alone.

Each rule's regular expression gives a Boolean query over trigrams: a disjunction of conjunctions of
trigrams that every match must contain. The index holds postings (trigram, document) for the
trigrams that some query names; conjunctions are intersected per document by OR-ing bit masks (an
algebraic aggregate: no posting list is ever collected), and only rules whose query holds are
verified on the text. Rules with no mandatory trigram (such as runs of hex digits) scan every text.

Defined results: a null text is empty and has no spans; repeated keys and null keys are scanned row by
row (candidates of equal keys are united, verification is per row); empty tables give empty tables;
further columns of the input are kept as they are, whatever their names, but for one with the name that the caller
chooses for the spans, which is replaced. Very long texts are scanned whole; one task holds one text.
"""

from __future__ import annotations

import re
from re import _parser as rx
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.llm import common


class Rule(NamedTuple):
    """A kind of secret: a match counts if its group has at least least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed values of the contract.
BASE = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)
#: What the scan adds: public formats of well-known credentials.
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("mapkey", "AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + ADDED
_MOST = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """A disjunction of trigram sets, in lower case, one of which every match holds whole.

    An empty list means that no trigram is mandatory. Lower case only widens a query.
    """

    def flush(alts):
        return [(got | {tail[i : i + 3] for i in range(len(tail) - 2)}, "") for got, tail in alts]

    def walk(tree, alts):
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                alts = [(got, tail + chr(arg).lower()) for got, tail in alts]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) * len(alts) <= _MOST:
                alts = [(got, tail + chr(c).lower()) for got, tail in alts for _, c in arg]
            elif name == "SUBPATTERN":
                alts = walk(arg[-1], alts)
            elif name == "BRANCH":
                alts = [x for branch in arg[1] for x in walk(branch, alts)]
            elif name == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1 and 2 * len(alts) <= _MOST:
                alts = alts + walk(arg[2], alts)
            elif name == "MAX_REPEAT" and arg[0] > 0:
                for _ in range(min(arg[0], 3)):
                    alts = walk(arg[2], alts)
                alts = alts if arg[0] == arg[1] <= 3 else flush(alts)
            elif name != "AT":
                alts = flush(alts)
        return alts

    found = [frozenset(got) for got, _ in flush(walk(rx.parse(pattern), [(frozenset(), "")]))]
    if not all(found):
        return []
    return [x for x in dict.fromkeys(found) if not any(y < x for y in found)]


def _queries(spark: SparkSession, rules) -> tuple[DataFrame | None, list[str]]:
    """Rows (trigram, rule, alt, bit, full) of all Boolean queries, and their trigrams."""
    rows = []
    for rule in rules:
        for alt, grams in enumerate(trigram_query(rule.pattern)):
            # more than 62 trigrams: any part of a conjunction is a wider query
            grams = sorted(grams)[:62]
            rows += [F.struct(F.lit(g).alias("trigram"), F.lit(rule.kind).alias("rule"), F.lit(alt).alias("alt"), F.lit(1 << i).cast("long").alias("bit"), F.lit((1 << len(grams)) - 1).cast("long").alias("full")) for i, g in enumerate(grams)]
    if not rows:
        return None, []
    grams = sorted({g for rule in rules for alt in trigram_query(rule.pattern) for g in sorted(alt)[:62]})
    return spark.range(1).select(F.inline(F.array(*rows))), grams


def postings(docs: DataFrame, grams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index (trigram, key) of the given trigrams over lower-cased texts."""
    low = docs.select(F.col(key), F.lower(F.col(text)).alias("_low"))
    held = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select(F.col(key), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """(key, rules): the rules whose trigram query holds for a document; None if no rule has one."""
    table, grams = _queries(docs.sparkSession, rules)
    if table is None:
        return None
    # the query table is a constant of the rules (a few hundred rows), so it may be broadcast
    hits = postings(docs, grams, key, text).join(F.broadcast(table), "trigram")
    met = hits.groupBy(key, "rule", "alt").agg(F.bit_or("bit").alias("got"), F.first("full").alias("full")).where("got = full")
    return met.groupBy(key).agg(F.collect_set("rule").alias("rules")).select(F.col(key).alias("key"), "rules")


def _spans(text: Column, order: int, rule: Rule) -> Column:
    """All leftmost non-overlapping matches of a rule that are long enough, as (start, ord, end)."""
    whole, part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    rows = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(part, F.length).alias("part"))
    kind = "array<struct<start:int,ord:int,end:int>>"

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        ok = x["size"].isNotNull() & (x["part"] >= rule.least)
        new = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with a column of spans array<struct<start, ord, end>>, by start and then by rule.

    Starts and ends count code points, ends are exclusive; ord is the rule's place in rules.
    """
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    # all columns travel as one, so that no name of the input meets ours
    kept = docs.select(F.struct(*(c for c in docs.columns if c != out)).alias("row"), F.col(key).alias("id"), F.col(text).alias("body"))
    found = candidates(docs.select(F.col(key).alias("id"), F.col(text).alias("body")), rules, "id", "body")
    if found is None:
        both = kept.withColumn("rules", F.array().cast("array<string>"))
    else:
        both = kept.join(found, kept["id"].eqNullSafe(found["key"]), "left")
    body = F.coalesce(F.col("body"), F.lit(""))
    each = []
    for i, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            test = F.array_contains("rules", rule.kind)
        else:  # scanned in full
            test = F.rlike(body, F.lit(_at_least(rule)))
        each.append(F.when(test, _spans(body, i, rule)).otherwise(none))
    return both.select("row.*", F.array_sort(F.concat(*each)).alias(out))


def _at_least(rule: Rule) -> str:
    """A cheaper test that holds wherever a match of a rule of one repeated class is long enough."""
    m = re.fullmatch(r"(\[[^\]]*\])\+", rule.pattern)
    return f"{m[1]}{{{rule.least}}}" if m and rule.least and not rule.group else rule.pattern


def listed(spans: Column, rules=RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["ord"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every maximal run of covered characters replaced by one mark; null texts stay null."""

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of all spans of every document."""
    found = scan(common.documents(spark, sf_dir))
    base = F.filter("secrets", lambda s: s["ord"] < len(BASE))
    count = [F.size(F.expr(f"filter(secrets, s -> s.ord = {i})")).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
