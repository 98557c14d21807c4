"""Quality rules: surface statistics and an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model of five code points in a row, case, script and marks kept, for each
language itself. A sequence's count is the number of other documents that hold it (documents that hold it, less one),
so that no document vouches for itself, however often it repeats a phrase. Spark counts sequences, and
computes every order by aggregates and joins; the tables grow with the corpus. Every sequence
of every document has a row with its finished log probability. Tasks look them up by 64-bit hashes of
language and sequence, in sorted arrays sent PIECE keys at a time: a larger model takes more passes over the documents,
not more memory, and a document's sums over the passes are added up. The first pass also measures the rules.

A document is compared with its language twice, by its mean log probability of a character and of a word
(all characters of the text over its words): symbols strung to words are cheap for each character but not for each
word, broken sentences and shuffled words the other way round. Each band lies FENCE interquartile ranges
around the quartiles of the documents of that language that pass the base rules, and is widened for short texts by SLACK
over the root of the length, which is about what their length alone makes the mean vary. kept asks for both; the
perplexity columns are those of a character.

Defined results: null and blank texts have no words and fail the base rules; a null language is a language
of its own; rows with a null or repeated doc_id are judged row by row; empty tables give no rows; other columns are
not read. Texts are counted and scored whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.llm import common
from dyadlake.llm.hashing import mix, pieces, utf8, word_hashes

ORDER, PIECE = 5, 2_000_000
FENCE, SLACK = 1.5, {"logp": (1.0, "n_chars"), "word_logp": (8.0, "n_words")}
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


def key_of(lang: F.Column) -> F.Column:
    """A text for each language, null included."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def grams(texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of language and sequence, its code points' end in the last array, that array) for every character in order."""
    size = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(" " * (ORDER - 1) + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(max(0, len(c) - ORDER + 1), np.uint64)
    for i in range(ORDER):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mix(c[i : i + len(h)].astype(np.uint64) + np.uint64(1))
    seeds = {x: np.uint64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big")) for x in set(langs)}
    begin = np.cumsum(size + ORDER - 1) - size - ORDER + 1
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return mix(h[at] + np.repeat(np.array([seeds[x] for x in langs], np.uint64), size)), at + ORDER, c


def _merged(parts: list[tuple]) -> tuple:
    """(hash, language's number, sequence, documents) with one row a hash."""
    h, lang, gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, first, back = np.unique(h, return_index=True, return_inverse=True)
    return key, lang[first], gram[first], np.bincount(back, weights=n, minlength=len(key)).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(h, lang, gram, n): the documents that hold each sequence, summed in tasks before they are shuffled."""

    def rows(total, names):
        h, lang, gram, n = total
        for lo in range(0, len(h), 200_000):
            at = slice(lo, lo + 200_000)
            text = np.ascontiguousarray(gram[at]).view(f"<U{ORDER}").reshape(-1)
            # numpy drops trailing U+0000, which a sequence may end with
            yield pd.DataFrame({"h": h[at].view(np.int64), "lang": [names[i] for i in lang[at]], "gram": [g.ljust(ORDER, "\0") for g in text.tolist()], "n": n[at]})

    def run(batches):
        names: dict[str, int] = {}
        parts, size = [], 0
        for pdf in batches:
            texts, langs = [t or "" for t in pdf["text"]], list(pdf["lang"])
            for lo, hi in pieces(texts):
                h, end, c = grams(texts[lo:hi], langs[lo:hi])
                bound = np.cumsum([0, *map(len, texts[lo:hi])])
                once = []
                for k in range(hi - lo):
                    x = np.sort(h[bound[k] : bound[k + 1]])
                    once.append(x[np.diff(x, prepend=x[:1] + np.uint64(1)) != 0])
                key, n = np.unique(np.concatenate(once), return_counts=True)
                order = np.argsort(h)
                first = order[np.searchsorted(h[order], key)]
                number = np.array([names.setdefault(x, len(names)) for x in langs[lo:hi]], np.int32)
                lang = number[np.searchsorted(bound, first, "right") - 1]
                gram = c[end[first][:, None] - np.arange(ORDER, 0, -1)]
                parts.append((key, lang, gram, n))
                size += len(key)
                if size > 2_000_000:
                    parts = [_merged(parts)]
                    if len(parts[0][0]) > 1_500_000:
                        yield from rows(parts.pop(), list(names))
                    size = sum(len(p[0]) for p in parts)
        if parts:
            yield from rows(_merged(parts), list(names))

    found = docs.select(key_of(F.col("lang")).alias("lang"), "text").mapInPandas(run, "h long, lang string, gram string, n long")
    return found.groupBy("h").agg(F.first("lang").alias("lang"), F.first("gram").alias("gram"), F.sum("n").alias("n"))


def smoothed(found: DataFrame) -> DataFrame:
    """(h, logp): modified Kneser-Ney over all orders, for every sequence that a document holds."""
    top = found.select("h", "lang", "gram", (F.col("n") - 1).alias("c"))
    levels = [top]
    for _ in range(ORDER - 1):
        up = levels[-1]
        levels.append(up.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c")))
        if len(levels) == 2:
            levels[-1] = common.cut(levels[-1])
    below = None
    for k, rows in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        of = [F.greatest(F.sum((F.col("c") == i).cast("long")), F.lit(1)).alias(f"n{i}") for i in range(1, 5)]
        of.append((1 / (1 + F.count("*"))).alias("low"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cuts = [F.greatest(F.least(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(i - 0.1)), F.lit(0.1)).alias(f"d{i}") for i in (1, 2, 3)]
        x = rows.join(rows.groupBy("lang").agg(*of).select("lang", *cuts, *(["low"] if k == 1 else [])), "lang")
        x = x.withColumn("d", F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        x = x.withColumn("start", F.expr(f"substring(gram, 1, {k - 1})"))
        # sums are made in tasks first; a frequent start is one row
        x = x.join(x.groupBy("lang", "start").agg(F.sum("c").alias("total"), F.sum("d").alias("taken")), ["lang", "start"])
        if below is not None:
            x = x.withColumn("end", F.expr("substring(gram, 2)")).join(below.select("lang", F.col("gram").alias("end"), F.col("p").alias("low")).hint("merge"), ["lang", "end"])
        p = F.when(F.col("total") > 0, (F.col("c") - F.col("d") + F.col("taken") * F.col("low")) / F.col("total")).otherwise(F.col("low"))
        below = x.select(*(["h"] if k == ORDER else []), "lang", "gram", p.alias("p"))
        if k < ORDER:
            below = common.cut(below)  # one plan for all orders takes the driver's memory
    return below.select("h", F.log("p").cast("float").alias("logp"))


def repeated_words(blobs: list[bytes], width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in width-word windows that occur twice or more) of each text."""
    h, doc = word_hashes(blobs)
    bound = np.searchsorted(doc, np.arange(len(blobs) + 1))
    m = max(0, len(h) - width + 1)
    w = np.zeros(m, np.uint64)
    for i in range(width):
        w = w * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m]
    out = np.zeros(len(blobs), np.int64)
    for k, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)):
        if b - a > width:
            _, back, n = np.unique(w[a : b - width + 1], return_inverse=True, return_counts=True)
            twice = np.flatnonzero(n[back] > 1)
            if len(twice):
                edge = np.zeros(b - a + 1, np.int64)
                np.add.at(edge, twice, 1)
                np.add.at(edge, twice + width, -1)
                out[k] = (np.cumsum(edge)[:-1] > 0).sum()
    return np.diff(bound), out


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(_BLANKS):
            seen.add(line)
    return n


_ROWS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in ("a", "b", "n_words", "n_repeat_words", "word_chars", "n_symbols", "n_dup_lines", "n_chars")), ("total", pa.float64())])
_TYPES = {"int64": "long", "string": "string", "double": "double"}


def totals(texts: list[str], langs: list[str], keys: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """The sum of each text's sequences' log probabilities, as far as the sorted keys have them."""
    if not len(keys):
        return np.zeros(len(texts))
    h = grams(texts, langs)[0].view(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    order = np.argsort(h)
    at = np.minimum(np.searchsorted(keys, h[order]), len(keys) - 1)
    return np.bincount(owner[order], weights=np.where(keys[at] == h[order], logp[at], 0.0), minlength=len(texts))


def measured(batch: pa.RecordBatch, texts: list[str], langs: list[str], total: np.ndarray) -> pa.RecordBatch:
    """A row of statistics for each document."""
    words, repeats = repeated_words([utf8(t) for t in texts])
    columns = {
        **{c: batch.column(c) for c in ("doc_id", "lang", "a", "b")}, "n_words": words, "n_repeat_words": repeats,
        "word_chars": [len(t) - sum(map(t.count, _BLANKS)) for t in texts], "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts], "n_dup_lines": [repeated_lines(t) for t in texts],
        "n_chars": [len(t) for t in texts], "total": total,
    }
    return pa.RecordBatch.from_pydict(columns, schema=_ROWS)


def scored(docs: DataFrame, model: DataFrame, piece: int = PIECE) -> DataFrame:
    """Statistics of each row of docs (doc_id, lang, text, a, b), total being its log probability; a and b are hashes of language and text."""
    spark = docs.sparkSession
    passes = max(1, -(-model.count() // piece))
    edges = [-(2**63) + (2**64 * i) // passes for i in range(passes + 1)]
    rows, more = None, None
    for i in range(passes):
        parts = []
        for lo in range(edges[i], edges[i + 1], step := -(-(edges[i + 1] - edges[i]) // 8)):
            got = model.where((F.col("h") >= lo) & (F.col("h") <= min(lo + step, edges[i + 1]) - 1)).toArrow()  # about piece / 8 rows
            h, logp = got["h"].to_numpy(), got["logp"].to_numpy()
            order = np.argsort(h)
            parts.append((h[order], logp[order]))
        del got, h, logp, order
        sent = spark.sparkContext.broadcast(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
        del parts

        def run(batches, sent=sent, whole=i == 0):
            for batch in batches:
                texts, langs = [t or "" for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist()
                for lo, hi in pieces(texts):
                    total = totals(texts[lo:hi], langs[lo:hi], *sent.value)
                    part = batch.slice(lo, hi - lo)
                    yield measured(part, texts[lo:hi], langs[lo:hi], total) if whole else pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "total": total})

        if rows is None:
            rows = common.cut(docs.select("doc_id", "lang", "text", "a", "b").mapInArrow(run, ", ".join(f"{f.name} {_TYPES[str(f.type)]}" for f in _ROWS)))
        else:
            now = common.cut(docs.select("lang", "text", "a", "b").mapInArrow(run, "a long, b long, total double").groupBy("a", "b").agg(F.max("total").alias("more")))
            more = now if more is None else more.unionByName(now)
        sent.destroy()
    if more is None:
        return rows
    return rows.join(more.groupBy("a", "b").agg(F.sum("more").alias("more")), ["a", "b"], "left").withColumn("total", F.col("total") + F.col("more"))


def judged(docs: DataFrame, fence: float = FENCE, piece: int = PIECE) -> DataFrame:
    """Statistics and verdicts of docs (doc_id, text, lang), with each one's perplexity and band."""
    lang = key_of(F.col("lang"))
    hashes = F.xxhash64(lang, "text").alias("a"), F.xxhash64(F.lit("b"), "text", lang).alias("b")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text", *hashes)
    rows = scored(keyed, common.cut(smoothed(common.cut(counted(docs)))), piece)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    means = {"base_failed": base, "logp": F.when(F.col("n_chars") > 0, F.col("total") / F.col("n_chars")), "word_logp": F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words"))}
    rows = common.cut(rows.withColumns(means))
    of = [F.percentile_approx(c, [0.25, 0.75], 10000).alias(c) for c in SLACK]
    q = rows.where("not base_failed").groupBy("lang").agg(*of)
    wide = {c: fence * (F.col(c)[1] - F.col(c)[0]) for c in SLACK}
    band = q.select("lang", *((F.col(c)[0] - wide[c]).alias(f"{c}_low") for c in SLACK), *((F.col(c)[1] + wide[c]).alias(f"{c}_high") for c in SLACK))
    out = rows.join(band, "lang", "left").withColumns({"low": F.col("logp_low"), "high": F.col("logp_high")})
    inside = F.lit(True)
    for c, (scale, size) in SLACK.items():
        slack = scale / F.sqrt(F.greatest(size, F.lit(1)))
        inside = inside & F.coalesce(F.col(c).between(F.col(f"{c}_low") - slack, F.col(f"{c}_high") + slack), F.lit(True))
    perplexity = F.exp(-F.col("logp"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), perplexity.alias("perplexity"), F.exp(-F.col("high")).alias("perplexity_low"), F.exp(-F.col("low")).alias("perplexity_high"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
