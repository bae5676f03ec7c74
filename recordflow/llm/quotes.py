"""Quotation linking: conversations in reply order, without quotes. Native columns only.

Quoted passages are told by their levels of quote marks, normalised and hashed, and joined to the
message in which the passage first stood unquoted. A message replies to the one it quotes at the
first level, or else goes on from the message before it. The replies of a conversation form a tree,
which is walked through in depth by ranking its tour, not by recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.functions.text import bind
from recordflow.llm.common import is_empty, stored, whole
from recordflow.operators.number import numbered, running_sum

# The marks before a quoted line, and the line that announces a quotation.
MARKS = r"^[ \t]*>[ \t>]*"
ANNOUNCED = r"(?i)\b(wrote|writes|schrieb|écrit|escribió)\s*:\s*$"

_LINES = "array<struct<level:int,content:string>>"


def _lines(text: Column) -> Column:
    """Lines as (level, content): the number of quote marks and what follows them."""
    def parsed(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
                        F.substring(x, F.length(marks) + 1, F.length(x)).alias("content"))

    lines = F.transform(F.split(F.regexp_replace(text, "\r", ""), "\n", -1), parsed)

    def announced(all_: Column) -> Column:
        # A line that announces a quotation belongs to it: level -1.
        return F.transform(all_, lambda x, i: F.struct(
            F.when((x["level"] == 0) & x["content"].rlike(ANNOUNCED)
                   & (F.get(all_, i + 1)["level"] > 0), F.lit(-1)).otherwise(x["level"])
            .alias("level"), x["content"].alias("content")))

    return bind(lines, announced).cast(_LINES)


def _normal(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _passages(lines: Column) -> Column:
    """Runs of lines of one level without a blank line, as (level, text, n_lines), normalised."""
    def starts(all_: Column) -> Column:
        def begins(i: Column) -> Column:
            a, b = F.get(all_, i), F.get(all_, i - 1)
            blank = F.btrim(a["content"]) == ""
            return (i == 0) | (a["level"] != b["level"]) | (blank != (F.btrim(b["content"]) == ""))

        return F.filter(F.sequence(F.lit(0), F.size(all_) - 1), begins)

    def runs(all_: Column, first: Column) -> Column:
        def run(s: Column, k: Column) -> Column:
            n = F.coalesce(F.get(first, k + 1), F.size(all_)) - s
            text = F.array_join(F.transform(F.slice(all_, s + 1, n), lambda x: x["content"]), " ")
            return F.struct(F.get(all_, s)["level"].alias("level"), _normal(text).alias("text"),
                            n.alias("n_lines"))

        return F.filter(F.transform(first, run), lambda p: p["text"] != "")

    return bind(lines, lambda all_: bind(starts(all_), lambda first: runs(all_, first)))


def _hashed(items: Column) -> Column:
    """(level, hash), each once. They are told apart as strings, which are hashed, not compared two
    by two."""
    named = F.array_distinct(F.transform(items, lambda p: F.concat(
        F.md5(p["text"]), p["level"].cast("string"))))
    return F.transform(named, lambda s: F.struct(
        F.substring(s, 33, 10).cast("int").alias("level"), F.substring(s, 1, 32).alias("hash")))


def parse(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``body``, the text without quotes and the lines announcing them,
    ``n_quotes``, its quoted passages, and ``quoted`` and ``said``, hashes of the passages quoted
    and said: (level, hash). Passages are also listed by their lines and by their sentences, so parts
    of them and passages with other line breaks are found. NULL texts are empty."""
    def single(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda x: F.struct(
            x["level"].alias("level"), _normal(x["content"]).alias("text"),
            F.lit(1).alias("n_lines"))), lambda p: p["text"] != "")

    def sentences(runs: Column) -> Column:
        return F.flatten(F.transform(runs, lambda p: F.transform(
            F.split(p["text"], "(?<=[.!?]) "), lambda x: F.struct(
                p["level"].alias("level"), x.alias("text"), F.lit(1).alias("n_lines")))))

    def parts(lines: Column) -> Column:
        own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["content"])
        return bind(_passages(lines), lambda runs: F.struct(
            F.btrim(F.array_join(own, "\n"), F.lit(" \t\n")).alias("body"),
            F.size(F.filter(runs, lambda p: p["level"] > 0)).cast("bigint").alias("n_quotes"),
            _hashed(F.concat(runs, single(lines), sentences(runs))).alias("hashes")))

    out = messages.withColumn("_parts", bind(_lines(whole(text)), parts))
    return (out.withColumn("body", F.col("_parts.body"))
            .withColumn("n_quotes", F.col("_parts.n_quotes"))
            .withColumn("quoted", F.filter("_parts.hashes", lambda h: h["level"] > 0))
            .withColumn("said", F.filter("_parts.hashes", lambda h: h["level"] == 0))
            .drop("_parts"))


def _ranked(tour: DataFrame) -> DataFrame:
    """(conv, x, w) with w the sum of the weights from x to the end of its conversation's tour,
    from (conv, x, next, w), by doubling the steps until all have arrived."""
    while True:
        tour = stored(tour, "quote-tour")
        if is_empty(tour.where("next is not null")):
            return tour.select("conv", "x", "w")
        ahead = tour.toDF("conv", "next", "_next", "_w")
        tour = (tour.join(ahead, ["conv", "next"], "left")
                .select("conv", "x", F.col("_next").alias("next"),
                        (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")))


def _reply_order(nodes: DataFrame) -> DataFrame:
    """(conv, pos, position) for nodes (conv, pos, parent): places in depth-first order.

    Messages that go on from the one before them make a stretch. A stretch comes whole, then the
    stretches that hang on it, those on its last message first, in the order of their first
    messages; so each message is followed by all replies to it.
    """
    branching = nodes.where("parent < pos - 1").select("conv").distinct()
    some = stored(nodes.join(branching, "conv", "left_semi"), "quote-nodes")
    if is_empty(some):
        return nodes.select("conv", "pos", F.col("pos").alias("position"))
    head = (F.col("pos") == 1) | (F.col("parent") < F.col("pos") - 1)
    some = stored(running_sum(some, ["conv"], "pos", head.cast("bigint"), "seg"), "quote-stretches")
    segs = some.groupBy("conv", "seg").agg(
        F.min("pos").alias("head"), F.count("*").alias("n"),
        F.min_by("parent", "pos").alias("at"))
    owner = some.select("conv", F.col("pos").alias("at"), F.col("seg").alias("up"))
    segs = segs.join(owner, ["conv", "at"], "left").withColumn("up", F.coalesce("up", F.lit(0)))
    place = F.coalesce(-F.col("at"), F.lit(0)) * (1 << 31) + F.col("head")
    segs = stored(numbered(segs.withColumn("_place", place), ["conv", "up"], "_place", "nth"),
                  "quote-segments")
    children = segs.select("conv", F.col("up").alias("seg"), "nth", F.col("seg").alias("_to"))
    enter = (segs.join(children.where("nth = 1").drop("nth"), ["conv", "seg"], "left")
             .select("conv", (F.col("seg") * 2).alias("x"),
                     F.coalesce(F.col("_to") * 2, F.col("seg") * 2 + 1).alias("next"),
                     F.col("n").alias("w")))
    beside = children.select("conv", F.col("seg").alias("up"), (F.col("nth") - 1).alias("nth"), "_to")
    leave = (segs.join(beside, ["conv", "up", "nth"], "left")
             .select("conv", (F.col("seg") * 2 + 1).alias("x"),
                     F.coalesce(F.col("_to") * 2, F.when(F.col("up") > 0, F.col("up") * 2 + 1))
                     .alias("next"), F.lit(0).cast("bigint").alias("w")))
    left = _ranked(enter.unionAll(leave)).where("x % 2 = 0").select(
        "conv", (F.col("x") / 2).cast("bigint").alias("seg"), F.col("w").alias("left"))
    total = some.groupBy("conv").agg(F.count("*").alias("total"))
    offset = (segs.select("conv", "seg", "head").join(left, ["conv", "seg"]).join(total, "conv")
              .select("conv", "seg", (F.col("total") - F.col("left") - F.col("head") + 1)
                      .alias("offset")))
    moved = some.join(offset, ["conv", "seg"]).select(
        "conv", "pos", (F.col("pos") + F.col("offset")).alias("position"))
    return (nodes.join(branching, "conv", "left_anti")
            .select("conv", "pos", F.col("pos").alias("position")).unionByName(moved))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn",
         text: str = "text") -> DataFrame:
    """``messages`` with body, n_quotes, links, parent_turn and position.

    links are the (level, turn) of the messages in which quoted passages first stood, earlier ones
    of the same conversation, by level and turn. parent_turn is the latest first-level link, or the
    turn before this one, NULL for the first. position numbers the turns of a conversation in reply
    order, from 1: a depth-first walk of the replies.

    Rows of one conversation and turn are one message told several times: they share links, parent
    and position. Rows with a NULL conversation or turn have no links, parent or position. NULL texts
    are empty. Columns with the names of the result are replaced.
    """
    base = messages.drop("body", "n_quotes", "links", "parent_turn", "position", "quoted", "said")
    rows = stored(parse(base.withColumns({"_conv": F.col(conv).cast("string"),
                                          "_turn": F.col(turn).cast("bigint")}), text), "quotes")
    known = rows.where("_conv is not null and _turn is not null")
    said = (known.select("_conv", "_turn", F.explode("said.hash").alias("hash"))
            .groupBy("_conv", "hash").agg(F.min("_turn").alias("first")))
    quoted = known.select("_conv", "_turn", F.inline("quoted")).distinct()
    links = stored(quoted.join(said, ["_conv", "hash"]).where("first < _turn")
                   .groupBy("_conv", "_turn")
                   .agg(F.sort_array(F.collect_set(F.struct("level", F.col("first").alias("turn"))))
                        .alias("links"),
                        F.max(F.when(F.col("level") == 1, F.col("first"))).alias("to")),
                   "quote-links")
    nodes = numbered(known.select("_conv", "_turn").distinct(), ["_conv"], "_turn", "pos")
    nodes = stored(nodes.join(links.select("_conv", "_turn", "to"), ["_conv", "_turn"], "left"),
                   "quote-turns")
    at = nodes.select("_conv", F.col("_turn").alias("to"), F.col("pos").alias("_to_pos"))
    before = nodes.select("_conv", (F.col("pos") + 1).alias("pos"), F.col("_turn").alias("_before"))
    nodes = stored(nodes.join(at, ["_conv", "to"], "left").join(before, ["_conv", "pos"], "left")
                   .select("_conv", "_turn", "pos",
                           F.coalesce("to", "_before").alias("parent_turn"),
                           F.coalesce("_to_pos", F.when(F.col("pos") > 1, F.col("pos") - 1))
                           .alias("parent")), "quote-parents")
    order = _reply_order(nodes.select(F.col("_conv").alias("conv"), "pos", "parent"))
    told = (nodes.join(order.withColumnRenamed("conv", "_conv"), ["_conv", "pos"])
            .join(links.select("_conv", "_turn", "links"), ["_conv", "_turn"], "left")
            .select("_conv", "_turn", "parent_turn", "position", "links"))
    out = rows.drop("quoted", "said").join(told, ["_conv", "_turn"], "left")
    return (out.withColumn("links", F.coalesce("links", F.array().cast(
        "array<struct<level:int,turn:bigint>>"))).drop("_conv", "_turn"))
