"""Quotation linking for chat formatting, in DataFrame functions alone.

Lines that begin with ">" are quotes, nested once for each mark. Runs of quoted lines of one level are
passages. Passages (whole, and line by line where only part of a message is quoted) are normalised,
hashed and joined to the first message of the conversation that says them itself; that message is what
the quoting one replies to. Conversations are then ordered so that a thread's replies follow its root,
and every message is formatted without its quotes.

Defined results: a null or blank text is a message without body or quotes; a null role is "unknown";
repeated messages each keep their row; rows with a null conversation form one conversation; a passage
that no earlier message says links nothing; ties go to the lowest level, whole passages first, then
the first passage. Only the scope, turn, role and text columns are read, others are kept, whatever their names, unless
they clash with a result column, in which case the result column wins. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadlake.llm import common

_MARKS = "^[ \\t]*(>[> \\t]*)"
RESULT = ["thread", "parent", "depth", "n_quotes", "body", "chat"]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def level(line: Column) -> Column:
    """Nesting of a line: its leading marks."""
    marks = F.regexp_extract(line, _MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def unquoted(text: Column) -> Column:
    """The text without its quoted lines, trimmed."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: ~F.rlike(x, F.lit(_MARKS)))
    return F.regexp_replace(F.array_join(own, "\n"), "^\\s+|\\s+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, mark, run, level, said): the quoted passages of distinct messages; run numbers them."""
    own = W.partitionBy("conv", "turn", "mark").orderBy("pos")
    lines = messages.where(F.rlike("text", F.lit("(?m)" + _MARKS))).select("conv", "turn", "mark", "text").distinct()
    lines = lines.select("conv", "turn", "mark", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("level", level(F.col("line"))).withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(own), F.lit(0))).cast("int"))
    lines = lines.withColumn("run", F.sum("new").over(own)).where("level > 0")
    return lines.select("conv", "turn", "mark", "run", "level", "pos", normalised(F.regexp_replace("line", _MARKS, "")).alias("said")).where("said <> ''")


def link(messages: DataFrame, scope: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """messages with thread and parent (turns), depth, n_quotes, body and chat."""
    kept = [c for c in messages.columns if c not in RESULT]
    # kept columns travel as one, so that no name of the input meets ours
    mark = F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")
    m = messages.select(F.struct(*kept).alias("row"), F.col(scope).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), mark)
    m = m.withColumn("body", unquoted(F.col("text")))
    base = m.select("conv", "turn", "mark", "text", "body")
    lines = passages(base)
    whole = lines.groupBy("conv", "turn", "mark", "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " ").alias("said"))
    asks = whole.select("*", F.lit(0).alias("part")).unionByName(lines.drop("pos").withColumn("part", F.lit(1)))
    # the first message that says a passage: a minimum per passage, so frequent lines stay one row
    says = base.where("body <> ''").select("conv", "turn", F.explode(F.array_append(F.split("body", "\n"), F.col("body"))).alias("s"))
    first = says.select("conv", "turn", normalised(F.col("s")).alias("s")).where("s <> ''").groupBy(F.col("conv").alias("_conv"), F.sha2("s", 256).alias("_hash")).agg(F.min("turn").alias("origin"))
    asks = asks.withColumn("hash", F.sha2("said", 256))
    found = asks.join(first, asks["conv"].eqNullSafe(first["_conv"]) & (asks["hash"] == first["_hash"])).where("origin < turn")
    best = found.groupBy("conv", "turn", "mark").agg(F.min(F.struct("level", "part", "run", "origin")).alias("b"))
    count = lines.groupBy("conv", "turn", "mark").agg(F.count_distinct("run").alias("n"))
    links = count.join(best.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("mark").alias("k"), F.col("b.origin").alias("parent")), F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("mark") == F.col("k")), "left").select("conv", "turn", "mark", "n", "parent")
    links = common.cut(links)
    roots = _roots(links.where("parent is not null").groupBy("conv", "turn").agg(F.min("parent").alias("up")))
    links = links.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("mark").alias("_m"), "n", "parent")
    out = m.join(links, m["conv"].eqNullSafe(links["_c"]) & m["turn"].eqNullSafe(links["_t"]) & (m["mark"] == links["_m"]), "left")
    out = out.join(roots, out["conv"].eqNullSafe(roots["_rc"]) & out["turn"].eqNullSafe(roots["_rt"]), "left")
    chat = F.concat(F.lit("<|"), F.coalesce(F.col("role"), F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>"))
    return out.select("row.*", F.coalesce("root", "turn").alias("thread"), "parent", F.coalesce("hops", F.lit(0)).alias("depth"), F.coalesce("n", F.lit(0)).cast("long").alias("n_quotes"), "body", chat.alias("chat"))


def _roots(up: DataFrame) -> DataFrame:
    """(_rc, _rt, root, hops) of linked messages by pointer doubling: as many rounds as the depth has bits."""
    at = common.cut(up.select(F.col("conv").alias("_rc"), F.col("turn").alias("_rt"), F.col("up").alias("root"), F.lit(1).alias("hops")))
    while True:
        far = at.select(F.col("_rc").alias("c"), F.col("_rt").alias("t"), F.col("root").alias("r"), F.col("hops").alias("h"))
        step = at.join(far, at["_rc"].eqNullSafe(far["c"]) & (at["root"] == far["t"]), "left")
        if not step.where("r is not null").limit(1).count():
            return at
        at = common.cut(step.select("_rc", "_rt", F.coalesce("r", "root").alias("root"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops")))


def op10_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of conversations in its thread, without quotes; (conv_id, thread, turn) is reply order."""
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "thread", "turn", "role", "parent", "depth", "n_quotes", F.sha2("body", 256).alias("body_sha256"), F.length("body").alias("n_chars"), F.sha2("chat", 256).alias("chat_sha256"))
