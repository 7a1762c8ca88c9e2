"""Line dedup by site-relative frequency: lines on too large a share of their host's pages are boilerplate and go.

Pages that contain a line are counted by host and line, in partial sums before the shuffle; a line travels as a digest of
128 bits. What goes is one list of digests for each host: a host with L distinct lines a page on average has at most
L / ratio of them. The texts themselves are never shuffled when the hosts with such a list are few enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Share of the host's pages beyond which a line is boilerplate.
RATIO = 0.1
#: Pages of its host that a line must be on at least: what is on one or two pages is no evidence, whatever their share.
LEAST_WITH = 3
#: Hosts with boilerplate that are broadcast, and lines in all; beyond it they are joined by host.
BROADCAST_HOSTS = 10_000
BROADCAST_LINES = 200_000
#: Parts into which the pages of a host go where they are joined, so that a large host is no single task.
SALTS = 64


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """Digest of a line without the spaces around it; null for a blank one, which is never boilerplate."""
    bare = F.trim(line)
    return F.when(bare != "", F.struct(F.xxhash64(F.lit(1), bare).alias("a"), F.xxhash64(F.lit(2), bare).alias("b")))


def boilerplate(pages: DataFrame, text: str, host: Column, ratio: float = RATIO, least_with: int = LEAST_WITH) -> DataFrame:
    """(host, keys): for each host that has some, the digests of its boilerplate lines. A null host is one host."""
    own = pages.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    totals = own.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.filter(F.transform(split_lines(F.col("text")), line_key), lambda k: k.isNotNull()))
    counts = own.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("with_line"))
    # Most lines are on one page: they go before the join.
    frequent = counts.where(F.col("with_line") >= least_with).join(totals, "host").where(F.col("with_line") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(pages: DataFrame, text: str = "text", host: Column | None = None, ratio: float = RATIO, least_with: int = LEAST_WITH, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``pages`` with ``text`` less its boilerplate lines, and ``n_lines`` and ``n_dropped``, in the page's line order.

    Every row is a page, and hosts of any size are judged alike: a line goes if it is on more than ``ratio`` of its host's
    pages and on ``least_with`` or more. A line counts once for a page, without the spaces around it. Blank lines stay. A
    null text stays null with no lines; null hosts are one host; a text of boilerplate alone becomes empty; its row stays. Repeated rows are pages of their own.
    Columns named n_lines or n_dropped are replaced, others stay as they are.
    """
    host = F.col("source") if host is None else host
    lists = cut(boilerplate(pages, text, host, ratio, least_with))
    hosts, lines = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    lists = lists.select(F.col("host").alias("_host"), F.col("keys").alias("_keys"))
    own = pages.withColumn("_own", F.coalesce(host.cast("string"), F.lit("")))
    if hosts <= broadcast_hosts and lines <= BROADCAST_LINES:
        joined = own.join(F.broadcast(lists), F.col("_own") == F.col("_host"), "left")
    else:
        salted = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("_salt", F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, (F.col("_own") == F.col("_host")) & (F.col("_salt") == F.col("_part")), "left").drop("_salt", "_part")
    parts = split_lines(F.col(text))
    kept = F.filter(parts, lambda line: F.coalesce(~F.array_contains("_keys", line_key(line)), F.lit(True)))
    lean = F.when(F.col("_keys").isNull(), parts).otherwise(kept)
    out = joined.withColumn("_lean", lean).withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)))
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines"))).withColumn("n_dropped", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines") - F.size("_lean")))
    out = out.withColumn(text, F.when(F.col("n_dropped") == 0, F.col(text)).otherwise(F.array_join("_lean", "\n")))
    return out.drop("_lean", "_own", "_host", "_keys")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, texts without their source's boilerplate lines; n_chars follows where it is a column.

    Nulls, empty texts and repeated rows are as in ``drop_boilerplate``; every row stays.
    """
    out = drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_lines, n_dropped and text of every row, as ``drop_boilerplate`` leaves them; null ids stay null."""
    return drop_boilerplate(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), "text")


SQL = f"""
with lines as (
  select doc_id, coalesce(source, '') as host, trim(unnest(string_split(text, chr(10)))) as line from documents where text is not null
), totals as (
  select coalesce(source, '') as host, count(*) as pages from documents group by 1
), counted as (
  select l.host, l.line, count(*) as with_line, any_value(t.pages) as pages
  from (select distinct doc_id, host, line from lines where line <> '') l join totals t on t.host = l.host group by 1, 2
), boiler as (
  select host, list(line) as boiler from counted where with_line >= {LEAST_WITH} and with_line > {RATIO} * pages group by host
), split as (
  select doc_id, source, text, string_split(text, chr(10)) as ls, coalesce(b.boiler, []) as boiler
  from documents d left join boiler b on b.host = coalesce(d.source, '')
), kept as (
  select *, list_filter(ls, lambda l: not list_contains(boiler, trim(l))) as lean from split
)
select doc_id, source, cast(case when text is null then 0 else len(ls) end as bigint) as n_lines,
  cast(case when text is null then 0 else len(ls) - len(lean) end as bigint) as n_dropped,
  case when text is null then null else array_to_string(lean, chr(10)) end as text
from kept
"""
