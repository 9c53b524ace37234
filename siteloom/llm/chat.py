"""Chat formatting by quotation linking, in DataFrame functions only.

A message's lines are parted by the depth of their quote marks. Runs of lines of one depth are
passages; a quoted passage, its paragraphs and its lines are normalised and hashed, and so are
those of each message's own words, in conversations that quote at all. A quoted hash leads to the
message that said it first, before the quoting one and in the same conversation; the message with most
matched characters of the least depth is the one replied to. Replies make trees; a walk through each
tree, as a list whose places are found by doubling pointers, gives the order of the messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siteloom.session import broadcast_if_small, checkpointed, table

#: Shorter paragraphs and lines that are only a part of what was said lead to a message if no other one before the quotation said them.
SHORT_CHARS = 12
MARKS = r"^(?:[ \t]*>)+ ?"
#: A line that only announces a quotation.
LEAD_IN = r"(?i)^.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s*:\s*$"
#: Turns of one bin, within which replies to one message are put in order.
BIN = 1 << 16


def _units(body: str) -> str:
    """SQL: hash, length and weakness of a passage, its paragraphs and its lines, normalised, each once."""
    norm = "trim(lower(regexp_replace({}, '\\\\s+', ' ')))"
    parts = f"concat(split({body}, '\\\\n[ \\\\t]*\\\\n'), split({body}, '\\\\n'))"
    whole = norm.format(body)
    said = f"array_distinct(filter(concat(array({whole}), transform({parts}, u -> {norm.format('u')})), u -> u <> ''))"
    return f"transform({said}, (u, i) -> struct(md5(u) as h, length(u) as n, i > 0 and length(u) < {SHORT_CHARS} as weak))"


def parsed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with content (own words; lead-in lines of quotations gone), n_quotes (quoted passages with words) and quotes (array of struct(depth, h, n, weak))."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x00\\x01]", " "), "\r\n?", "\n")
    df = df.withColumn("__text", text).withColumn("__quoted", F.col("__text").rlike(r"(?m)^[ \t]*>"))
    df = df.withColumn("__line", F.when(F.col("__quoted"), F.split("__text", "\n", -1)))
    df = df.withColumn("__line", F.transform("__line", lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("depth"), F.regexp_replace(x, MARKS, "").alias("body"))))
    # depth and passage are told apart by characters that no text holds any more
    df = df.withColumn("__run", F.expr("array_join(transform(__line, (x, i) -> concat(CASE WHEN i > 0 AND x.depth = __line[i - 1].depth THEN '\\n' ELSE concat(char(0), x.depth, char(1)) END, x.body)), '')"))
    df = df.withColumn("__part", F.expr("transform(filter(split(__run, char(0)), p -> p <> ''), p -> struct(cast(substring_index(p, char(1), 1) as int) as depth, substring_index(p, char(1), -1) as body))"))
    own = "array_join(transform(filter(__part, p -> p.depth = 0), p -> p.body), '\\n')"
    df = df.withColumn("content", F.expr(f"trim(BOTH ' \\n\\t' FROM CASE WHEN __quoted THEN array_join(filter(split({own}, '\\n', -1), l -> NOT l RLIKE r'{LEAD_IN}'), '\\n') ELSE __text END)"))
    df = df.withColumn("__told", F.expr("filter(__part, p -> p.depth > 0 AND p.body RLIKE '[^\\\\s]')"))
    df = df.withColumn("n_quotes", F.coalesce(F.when(F.col("__quoted"), F.size("__told")), F.lit(0)))
    df = df.withColumn("quotes", F.expr(f"flatten(transform(__told, p -> transform({_units('p.body')}, u -> struct(p.depth as depth, u.h as h, u.n as n, u.weak as weak))))"))
    return df.drop("__text", "__line", "__run", "__part", "__quoted", "__told")


def _following(df: DataFrame, keys: list[str]) -> DataFrame:
    """df (keys, turn) with next, the next larger turn of equal keys. Windows hold a bin of turns; one row for each bin carries the first turn across."""
    at = df.withColumn("__bin", F.floor(F.col("turn") / BIN))
    first = at.groupBy(*keys, "__bin").agg(F.min("turn").alias("__first"))
    first = first.withColumn("__over", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__bin"))).drop("__first")
    at = at.withColumn("__next", F.lead("turn").over(Window.partitionBy(*keys, "__bin").orderBy("turn")))
    return at.join(first, [*keys, "__bin"]).select(*keys, "turn", F.coalesce("__next", "__over").alias("next"))


def walked(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth, position) of every message that stands in links (conv_id, turn, reply_to < turn).

    Each tree is walked from its root, children by turn: a list that enters and leaves every message. Each
    element points to the next one; pointers are doubled until all reach the end, with the sums of what they
    pass. Entering counts for the position, entering less leaving for the depth. No two elements
    point to one element but the end, so no key is hot, and rounds grow with the logarithm of a tree's size.
    """
    links = links.select("conv_id", "turn", F.col("reply_to").alias("up"))
    nodes = links.select("conv_id", "turn").union(links.select("conv_id", "up")).distinct()
    children = links.groupBy("conv_id", F.col("up").alias("turn")).agg(F.min("turn").alias("child"))
    at = nodes.join(_following(links, ["conv_id", "up"]), ["conv_id", "turn"], "left").join(children, ["conv_id", "turn"], "left")

    def element(side: int, to: Column, to_side: Column, level: int):
        return F.struct(F.lit(side).alias("side"), to.alias("to"), to_side.alias("to_side"), F.lit(1 - side).cast("long").alias("enters"), F.lit(level).cast("long").alias("level"))

    enter = element(0, F.coalesce("child", "turn"), F.when(F.col("child").isNull(), 1).otherwise(0), 1)
    leave = element(1, F.coalesce("next", "up"), F.when(F.col("next").isNotNull(), 0).when(F.col("up").isNotNull(), 1), -1)
    now = at.select("conv_id", "turn", F.explode(F.array(enter, leave)).alias("e")).select("conv_id", "turn", "e.*").withColumn("root", F.when(F.col("to").isNull(), F.col("turn")))
    now = checkpointed(now)
    while now.where("to is not null").limit(1).count():
        ahead = now.select("conv_id", F.col("turn").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("next"), F.col("to_side").alias("next_side"), F.col("enters").alias("more"), F.col("level").alias("up"), F.col("root").alias("end"))
        going = now.where("to is not null").drop("root").join(ahead, ["conv_id", "to", "to_side"])
        going = going.select("conv_id", "turn", "side", F.col("next").alias("to"), F.col("next_side").alias("to_side"), (F.col("enters") + F.col("more")).alias("enters"), (F.col("level") + F.col("up")).alias("level"), F.col("end").alias("root"))
        now = checkpointed(now.where("to is null").unionByName(going))
    entered = now.where("side = 0")
    whole = entered.groupBy("conv_id", "root").agg(F.max("enters").alias("all"))
    return entered.join(whole, ["conv_id", "root"]).select("conv_id", "turn", F.col("root").alias("thread"), (-F.col("level")).alias("depth"), (F.col("all") - F.col("enters")).alias("position"))


def reply_links(base: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of the messages that quote an earlier one, from parsed messages."""
    base = base.where("conv_id is not null and turn is not null")
    told = base.where("size(quotes) > 0").select("conv_id", "turn", F.explode("quotes").alias("q")).groupBy("conv_id", "turn", "q.depth", "q.h", "q.n").agg(F.bool_and("q.weak").alias("weak"))
    told = checkpointed(told)
    quoting = broadcast_if_small(told.select("conv_id").distinct())  # only these conversations are hashed
    said = base.join(quoting, "conv_id", "left_semi").select("conv_id", "turn", F.explode(F.expr(_units("content"))).alias("o")).select("conv_id", "turn", "o.h", "o.weak")
    said = said.join(told.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").groupBy("conv_id", "h", "turn").agg(F.bool_and("weak").alias("weak"))
    said = checkpointed(said)
    first = said.groupBy("conv_id", "h").agg(F.min("turn").alias("first"), F.min(F.when(~F.col("weak"), F.col("turn"))).alias("strong"))
    second = said.join(first.select("conv_id", "h", "first"), ["conv_id", "h"]).where("turn > first").groupBy("conv_id", "h").agg(F.min("turn").alias("second"))
    found = told.join(first.join(second, ["conv_id", "h"], "left"), ["conv_id", "h"])
    only = (F.col("first") < F.col("turn")) & F.coalesce(F.col("second") >= F.col("turn"), F.lit(True))
    found = found.withColumn("said", F.when(~F.col("weak") & (F.col("strong") < F.col("turn")), F.col("strong")).when(only, F.col("first"))).where("said is not null")
    scored = found.groupBy("conv_id", "turn", "said", "depth").agg(F.sum("n").alias("n"))
    return checkpointed(scored.groupBy("conv_id", "turn").agg(F.max_by("said", F.struct((-F.col("depth")).alias("d"), "n", "said")).alias("reply_to")))


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """conv_id, turn, role, content, n_quotes, reply_to, thread, depth, position, formatted of every message.

    reply_to: the turn of the message that this one quotes (null: none); thread: the turn of the
    first message of its chain of replies, itself if it replies to none; depth: its place in the
    chain; position: its place in the thread if each reply, by turn, is followed by the replies to it.
    Ordered by conversation, thread and position the messages are conversations without quotes. Null texts
    are empty; messages without conversation or turn, and with words that nobody said before, reply to
    none. A short line or paragraph out of a longer text leads to a message only if no other one before
    said it. Of equally good messages the latest is replied to. Rows that share conversation and turn count as one message in several
    rows: all get the reply that their quotes together tell. An empty table gives an empty result; other columns are left out.
    """
    base = parsed(messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    links = reply_links(base)
    places = walked(links).join(links, ["conv_id", "turn"], "left")
    out = base.join(broadcast_if_small(places), ["conv_id", "turn"], "left")  # of messages that reply only: else no text moves
    return out.select(
        "conv_id", "turn", "role", "content", "n_quotes", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0)).alias("position"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "content", F.lit("\n")).alias("formatted"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of `conversations` in reply order, as reply_order states (nulls, empty texts, ties, repeated rows: see there)."""
    return reply_order(table(spark, sf_dir, "conversations"))
