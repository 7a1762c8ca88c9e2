"""Chat formatting by quotation linking: quotes are linked to the messages they come from and then left out.

A line's quote level is the number of ``>`` before it. Consecutive lines of one level are a passage. A passage, and each of
its lines, is normalised (lower case, white space folded) and hashed; so are the unquoted passages and lines of every
message, and the whole of its unquoted text. The original of a passage, as of a line, is the latest earlier message of the
conversation that has its hash. A passage that has none as a whole has that of its lines, if lines with half of its letters or
more have one original: the one with the most letters, the latest of several. A message answers the original of its least nested linked passage.
Messages that answer one another are a thread; a conversation is its threads by their first message, each in order of turns, so
that every answer stands behind what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut, running, whole

QUOTE = r"^[ \t]*(?:>[ \t]*)+"
#: Turns that one task holds of a conversation, of a thread, and of a hash in it.
RANGE = 256
#: The turn of rows that have none, before all others.
NO_TURN = -(1 << 62)
#: What tells messages apart: conversation, turn, and a digest of role and text.
MESSAGE = ("_conv", "_turn", "_id")


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def safe(text: str) -> Column:
    """A text in which nothing reads as a mark: each ``<|``, also one with backslashes between, gets one backslash more."""
    return F.regexp_replace(F.col(text), r"<(\\*)\|", r"<$1\\|")


def passages(messages: DataFrame) -> DataFrame:
    """(_conv, _turn, _id, at, level, lines): each message's passages in order; blank lines are unquoted and part passages."""
    line = F.transform(F.split("_text", r"\r\n|\r|\n", -1), lambda x: F.struct(level_of(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body")))
    empty = F.array().cast("array<struct<level:int,lines:array<string>>>")
    begin = F.struct(F.lit(-1).alias("level"), F.array().cast("array<string>").alias("lines"), empty.alias("done"))

    def close(acc):
        return F.when(F.size(acc["lines"]) > 0, F.concat(acc["done"], F.array(F.struct(acc["level"].alias("level"), acc["lines"].alias("lines"))))).otherwise(acc["done"])

    def step(acc, x):
        blank = (x["level"] == 0) & (F.trim(x["body"]) == "")
        fresh = F.when(blank, F.array().cast("array<string>")).otherwise(F.array(x["body"]))
        return (
            F.when(~blank & (x["level"] == acc["level"]), F.struct(acc["level"].alias("level"), F.concat(acc["lines"], F.array(x["body"])).alias("lines"), acc["done"].alias("done")))
            .otherwise(F.struct(F.when(blank, -1).otherwise(x["level"]).alias("level"), fresh.alias("lines"), close(acc).alias("done")))
        )

    found = F.aggregate(line, begin, step, close)
    return messages.select(*MESSAGE, F.posexplode(found).alias("at", "passage")).select(*MESSAGE, "at", "passage.level", "passage.lines")


def _keys(parts: DataFrame) -> DataFrame:
    """Hashes of a passage as a whole (line -1) and of its lines, with their letters and those of all its lines; texts that normalise to nothing have none."""
    whole_text = F.struct(F.lit(-1).alias("line"), normal(F.array_join("lines", " ")).alias("t"))
    each = F.concat(F.array(whole_text), F.transform("lines", lambda x, i: F.struct(i.alias("line"), normal(x).alias("t"))))
    keyed = parts.withColumn("total", F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(normal(x)))).withColumn("k", F.explode(each)).where("k.t <> ''")
    return keyed.select(*MESSAGE, "level", "at", "total", F.col("k.line").alias("line"), F.length("k.t").alias("letters"), F.struct(F.xxhash64(F.lit(1), "k.t").alias("a"), F.xxhash64(F.lit(2), "k.t").alias("b")).alias("key"))


def links(parts: DataFrame) -> DataFrame:
    """(_conv, _turn, _id, level, at, origin, matched): the quoted passages that have an original, with its turn and the numbers of the lines that are from it, null if all are."""
    own = parts.where("level = 0")
    whole_own = own.groupBy(*MESSAGE).agg(F.sort_array(F.collect_list(F.struct("at", "lines"))).alias("p"))  # a message's own lines
    whole_own = whole_own.select(*MESSAGE, F.lit(0).alias("level"), F.lit(0).alias("at"), F.flatten(F.transform("p", lambda x: x["lines"])).alias("lines"))
    originals = _keys(own.unionByName(whole_own)).select("_conv", "_turn", "key").distinct().withColumn("from", F.col("_turn"))
    quotes = _keys(parts.where("level > 0"))
    # The latest original before each quote: one pass over both along the turns, never pairs of them.
    nothing = {"_id": "struct<a:bigint,b:bigint>", "level": "int", "at": "int", "total": "int", "line": "int", "letters": "int"}
    both = originals.select("_conv", "key", "_turn", "from", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    both = both.unionByName(quotes.select("_conv", "key", "_turn", F.lit(None).cast("long").alias("from"), *nothing))
    # At one turn quotes come before originals: a message does not quote itself.
    found = running(both, ["_conv", "key"], ["_turn", F.col("from").isNotNull()], F.floor(F.col("_turn") / RANGE), F.col("from"), "origin", F.max).where("level is not null and origin is not null and origin < _turn")
    by_origin = found.groupBy(*MESSAGE, "level", "at", "total", "origin").agg(F.min("line").alias("first"), F.sum("letters").alias("letters"), F.collect_list("line").alias("matched"))
    entire = F.col("first") == -1
    enough = by_origin.where(entire | (2 * F.col("letters") >= F.col("total")))
    best = enough.groupBy(*MESSAGE, "level", "at").agg(F.max(F.struct(entire.alias("entire"), "letters", "origin", "matched")).alias("o"))
    return best.select(*MESSAGE, "level", "at", "o.origin", F.when(~F.col("o.entire"), F.col("o.matched")).alias("matched"))


def placed(messages: DataFrame) -> DataFrame:
    """``messages`` with ``position``: threads by their first turn, in each its messages by turn; no task holds a conversation or a thread."""
    ranged = messages.withColumn("_part", F.floor(F.col("_turn") / RANGE))
    sizes = cut(ranged.groupBy("_conv", "thread_turn", "_part").agg(F.count("*").alias("_n")))
    threads = sizes.groupBy("_conv", "thread_turn").agg(F.sum("_n").alias("_n"))
    ahead = running(threads, ["_conv"], ["thread_turn"], F.floor(F.col("thread_turn") / RANGE), F.col("_n"), "_ahead").select("_conv", "thread_turn", F.coalesce("_ahead", F.lit(0)).alias("_ahead"))
    before = Window.partitionBy("_conv", "thread_turn").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(ahead, ["_conv", "thread_turn"])
    inside = Window.partitionBy("_conv", "thread_turn", "_part").orderBy("_turn", "_id")
    place = F.col("_ahead") + F.col("_before") + F.row_number().over(inside) - 1
    return ranged.join(sizes, ["_conv", "thread_turn", "_part"]).withColumn("position", place.cast("long"))


def conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each row of ``messages``: conv_id, turn, role, text (without quotes), n_quotes, n_linked, reply_to,
    thread_turn, position, unlinked, formatted.

    ``n_quotes`` and ``n_linked`` are the row's own quoted passages and those of them that have an original. ``reply_to`` is
    the turn of the message that is answered (null: none is quoted), ``thread_turn`` the first turn of the thread and
    ``position`` the place in the conversation from 0 on; ``unlinked`` holds the quoted lines that were left out of the text
    and are not from the original of their passage (null: none), such as the prompts of a program; ``formatted`` is the
    message with its role's mark, in which a ``<|`` of role or text has a backslash more, so that texts cannot forge marks. Conversations may have ids of any type, turns are whole numbers. Null texts count as empty, null roles as
    user. Rows with a null conversation are one conversation; rows with a turn that is null or no number come first in
    theirs, answer nothing and are answered by nothing. Ids and turns are given back as they are. Rows that repeat a turn
    are messages of their own, in the order of their digests; rows alike in all come next to each other with the same
    links. Empty tables give no rows; other columns are left alone.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))
    base = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), named.alias("_conv"), F.coalesce(F.col(turn).try_cast("long"), F.lit(NO_TURN)).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("user")).alias("role"), whole(text).alias("_text"))
    base = base.withColumn("_id", F.struct(F.xxhash64(F.lit(1), "role", "_text").alias("a"), F.xxhash64(F.lit(2), "role", "_text").alias("b")))
    quoting = base.where(F.col("_text").rlike(r"(?m)^[ \t]*>") & (F.col("_turn") > NO_TURN))
    # Rows alike in all are one message here, and each of them has its links.
    able = base.where(F.col("_turn") > NO_TURN).join(quoting.select("_conv").distinct(), "_conv", "left_semi").dropDuplicates(list(MESSAGE))
    parts = cut(passages(able))
    linked = cut(links(parts))
    answers = cut(linked.groupBy(*MESSAGE).agg(F.min(F.struct("level", "at", "origin")).alias("o"), F.count("*").alias("n_linked")).select(*MESSAGE, F.col("o.origin").alias("reply_to"), "n_linked"))
    node = lambda t: F.struct(F.col("_conv").alias("c"), F.col(t).alias("t"))
    threads = components(answers.select(node("_turn").alias("a"), node("reply_to").alias("b"))).select(F.col("node.c").alias("_conv"), F.col("node.t").alias("_turn"), F.col("root.t").alias("thread_turn"))
    lines = F.split("_text", r"\r\n|\r|\n", -1)
    unquoted = F.trim(F.regexp_replace(F.array_join(F.filter(lines, lambda x: level_of(x) == 0), "\n"), r"^\s+|\s+$", ""))
    quoted = F.exists(lines, lambda x: level_of(x) > 0)
    quotes = parts.where("level > 0")
    # Lines that are not from their passage's original.
    rest = F.filter("lines", lambda x, i: (normal(x) != "") & ~F.array_contains("matched", i))
    lost = quotes.join(linked.select(*MESSAGE, "at", F.lit(True).alias("_linked"), "matched"), [*MESSAGE, "at"], "left")
    lost = lost.withColumn("lines", F.when(F.col("_linked").isNull(), F.col("lines")).when(F.col("matched").isNotNull(), rest)).where(F.size("lines") > 0).groupBy(*MESSAGE).agg(F.sort_array(F.collect_list(F.struct("at", "level", "lines"))).alias("p"))
    marked = F.flatten(F.transform("p", lambda x: F.transform(x["lines"], lambda y: F.concat(F.repeat(F.lit(">"), x["level"]), F.lit(" "), y))))
    out = base.select("conv_id", "turn", *MESSAGE, "role", F.when(quoted, unquoted).otherwise(F.col("_text")).alias("text"))
    for extra in (quotes.groupBy(*MESSAGE).agg(F.count("*").alias("n_quotes")), answers, lost.select(*MESSAGE, F.array_join(marked, "\n").alias("unlinked"))):
        out = out.join(extra, list(MESSAGE), "left")
    out = out.join(threads, ["_conv", "_turn"], "left").withColumn("thread_turn", F.coalesce("thread_turn", "_turn"))
    given = F.when(F.col("thread_turn") > NO_TURN, F.col("thread_turn"))
    return placed(out).select(
        "conv_id", "turn", "role", "text", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", given.alias("thread_turn"),
        "position", "unlinked", F.concat(F.lit("<|"), safe("role"), F.lit("|>\n"), safe("text"), F.lit("\n<|end|>")).alias("formatted"),
    )
