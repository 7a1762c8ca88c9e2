"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of domains, languages and sources. A node's budget is shared among its children by weight; a child
that has fewer tokens than its share gives all it has, and what it lacks is shared among its siblings again by weight, so
a shortage reaches the node's own siblings only when all of its children are used up. Shares are rounded down; what that
leaves over, less than a token for each child, goes to nobody. A leaf's budget is whole epochs over
its documents and a prefix, by tokens, of one more epoch, whose order is a seeded hash. Budgets are integers.

Sums by leaf and the tree are small tables; the prefix of a leaf is found from sums over 4,096 ranges of the order, then in
ranges, so that a leaf with a third of all documents is no single task. A document is then picked by comparing its place
in the order with its leaf's last one: texts are never shuffled when there are few enough leaves to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, running, small

LEVELS = ("domain", "lang", "source")
#: Parents that are broadcast to their children.
MANY = 10_000
NONE = "(none)"


@dataclass(frozen=True)
class Weights:
    """Whole-number weights by name for each level; a name that is not there weighs 1, and without any names a level is
    weighed by the tokens that are there."""

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    """``share``: the budget as hundredths of all tokens; ``epochs``: how often a document may be used at most."""

    weights: Weights = field(default_factory=lambda: Weights(domain={"reference": 3, "web": 2}, lang={"en": 6, "fr": 2, "de": 2, "es": 1}))
    share: int = 100
    epochs: int = 2
    seed: int = 42


PLAN = Plan()
#: The production table of domains: which sources are reference works; all others are web.
REFERENCE = "^src1?[0-4]$"


def domain_of(source: Column) -> Column:
    return F.when(source.rlike(REFERENCE), "reference").otherwise("web")


def tokens_of(text: Column) -> Column:
    """Words: runs of characters that are not white space. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(level: str, weights: Weights) -> Column:
    given = getattr(weights, level)
    if not given:
        return F.col("tokens")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in given.items() for x in pair]), F.col(level)), F.lit(1)).cast("long")


def _even(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``given`` for siblings that are weighed by their tokens: all of them or none fall short, so they need no order."""
    sums = nodes.groupBy(*parent).agg(*[F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).alias(n) for c, n in (("weight", "shares"), ("supply", "all"))])
    both = nodes.join(small(sums, MANY), parent) if parent else nodes.withColumns({n: F.lit(v) for n, v in sums.first().asDict().items()})
    part = F.floor(F.col("weight").cast("double") * F.col("total").cast("double") / F.col("shares").cast("double")).cast("long")
    return both.withColumn("given", F.when((F.col("weight") == 0) | (F.col("all") <= F.col("total")), F.col("supply")).otherwise(F.greatest(F.lit(0), F.least(F.col("supply"), part))))


def _shared(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """``given`` for siblings with named weights: those with least supply for a unit of weight fall short first."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    ratio = F.when(F.col("weight") > 0, F.col("supply").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(float("inf")))
    siblings = Window.partitionBy(*(parent or [F.lit(0)])).orderBy("ratio", level)
    nodes = nodes.withColumn("ratio", ratio)
    nodes = nodes.withColumn("used", F.coalesce(F.sum(big("supply")).over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)"))
    nodes = nodes.withColumn("rest", F.sum(big("weight")).over(siblings.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(38,0)"))
    short = F.col("supply").cast("double") * F.col("rest").cast("double") <= F.col("weight").cast("double") * (F.col("total") - F.col("used")).cast("double")
    nodes = nodes.withColumn("short", short)
    everyone = Window.partitionBy(*(parent or [F.lit(0)]))
    spent = F.coalesce(F.sum(F.when(F.col("short"), big("supply"))).over(everyone), F.lit(0)).cast("decimal(38,0)")
    shares = F.coalesce(F.sum(F.when(~F.col("short"), big("weight"))).over(everyone), F.lit(0)).cast("decimal(38,0)")
    nodes = nodes.withColumn("spent", spent).withColumn("shares", shares)
    given = F.floor(F.col("weight").cast("double") * (F.col("total") - F.col("spent")).cast("double") / F.col("shares").cast("double"))
    return nodes.withColumn("given", F.when(F.col("short"), F.col("supply")).when(F.col("shares") > 0, F.greatest(F.lit(0), F.least(F.col("supply"), given.cast("long")))).otherwise(F.lit(0)))


def budgets(leaves: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens), the tokens of each leaf for one epoch."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    out = leaves
    parent, budget = [], F.lit(min(total * plan.share // 100, total * plan.epochs)).cast("decimal(38,0)")
    above = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(level, plan.weights)).withColumn("supply", F.col("tokens") * plan.epochs)
        nodes = nodes.withColumn("total", budget) if above is None else nodes.join(small(above, MANY), parent)
        nodes = _shared(nodes, parent, level) if getattr(plan.weights, level) else _even(nodes, parent)
        nodes = nodes.withColumn("given", F.col("given").cast("long"))
        if depth == len(LEVELS) - 1:
            out = nodes.select(*path, "tokens", F.col("given").alias("budget"))
        above = cut(nodes.select(*path, big("given").alias("total")))
        parent = path
    return out


def _leafed(docs: DataFrame, text: str, doc_id: str, domain: Column | None) -> DataFrame:
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    domain = domain_of(named(F.col("source"))) if domain is None else domain
    return docs.withColumns({"_domain": named(domain), "_lang": named(F.col("lang")), "_source": named(F.col("source")), "_id": F.col(doc_id), "_tokens": tokens_of(F.col(text))})


def picks(docs: DataFrame, plan: Plan = PLAN, text: str = "text", doc_id: str = "doc_id", domain: Column | None = None, broadcast_leaves: int = 20_000) -> DataFrame:
    """A row of ``docs`` for each time that it is used, with ``_domain``, ``_lang``, ``_source``, ``_tokens`` and ``_epoch``.

    ``docs`` needs the columns lang and source; null ones count as "(none)". A leaf takes whole epochs while its budget
    lasts, then documents by their place until their tokens reach what is left: the last one may go beyond it. Documents
    without tokens go with the place they have, and leaves without tokens give nothing. Rows that repeat a doc_id share
    its place. Columns of ``docs`` stay as they are; empty tables give no rows.
    """
    leaf = ["_domain", "_lang", "_source"]
    own = _leafed(docs, text, doc_id, domain)
    narrow = cut(own.select(*leaf, "_id", "_tokens"))
    leaves = cut(narrow.groupBy(*[F.col(f"_{c}").alias(c) for c in LEVELS]).agg(F.sum("_tokens").alias("tokens")))
    plans = cut(budgets(leaves, plan).where("tokens > 0 and budget > 0").select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.expr("cast(budget div tokens as int)").alias("_whole"), F.expr("budget % tokens").alias("_left")))
    few = plans.count() <= broadcast_leaves
    near = F.broadcast(plans) if few else plans
    placed = narrow.join(near.where("_left > 0"), leaf).withColumn("_place", place(plan.seed, F.col("_whole"), F.col("_id")))
    summed = running(placed, leaf, ["_place", "_tokens"], F.substring("_place", 1, 3), F.col("_tokens"), "_before")
    ends = summed.where(F.coalesce("_before", F.lit(0)) < F.col("_left")).groupBy(*leaf).agg(F.max("_place").alias("_end"))
    plans = cut(plans.join(ends, leaf, "left").select(*leaf, "_whole", "_end"))
    uses = own.join(F.broadcast(plans) if few else plans, leaf)
    more = F.when(place(plan.seed, F.col("_whole"), F.col("_id")) <= F.col("_end"), 1).otherwise(0)
    uses = uses.withColumn("_times", F.col("_whole") + more).where("_times > 0")
    return uses.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_times", "_whole", "_end", "_id")


def mixed_documents(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """The columns of ``docs``, a row for each use of a document: ``picks``, with its handling of nulls, ties and repeated rows."""
    return picks(docs, plan).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epoch of each use of a document, nulls as in ``picks`` (a null id stays null)."""
    found = picks(docs.select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").cast("long").alias("epoch"))


def _sql() -> str:
    def case(level):
        given = getattr(PLAN.weights, level)
        return "tokens" if not given else f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in given.items()) + " else 1 end"

    steps, parent = [], []
    for depth, level in enumerate(LEVELS):
        path, above = ", ".join(LEVELS[: depth + 1]), ", ".join(parent)
        by = f"partition by {above}" if parent else ""
        total = f"(select least(sum(tokens) * {PLAN.share} // 100, sum(tokens) * {PLAN.epochs}) from leaves) as total from n" if not parent else f"p.given as total from n join given_{parent[-1]} p using ({above})"
        steps.append(f"""
given_{level} as (
  with n as (select *, {case(level)} as weight, tokens * {PLAN.epochs} as supply from (select {path}, sum(tokens) as tokens from leaves group by {path})),
  t as (select n.*, {total}),
  o as (select *, case when weight > 0 then supply::double / weight::double else 'inf'::double end as ratio from t),
  u as (select *, coalesce(sum(supply) over ({by} order by ratio, {level} rows between unbounded preceding and 1 preceding), 0) as used,
    sum(weight) over ({by} order by ratio, {level} rows between current row and unbounded following) as rest from o),
  s as (select *, supply::double * rest::double <= weight::double * (total - used)::double as short from u),
  w as (select *, coalesce(sum(supply) filter (short) over ({by}), 0) as spent, coalesce(sum(weight) filter (not short) over ({by}), 0) as shares from s)
  select {path}, tokens, case when short then supply when shares > 0 then greatest(0, least(supply, floor(weight::double * (total - spent)::double / shares::double)::bigint)) else 0 end as given from w
)""")
        parent = [*LEVELS[: depth + 1]]
    return f"""
with docs as (
  select doc_id, coalesce(lang, '{NONE}') as lang, coalesce(source, '{NONE}') as source,
    case when regexp_matches(coalesce(source, '{NONE}'), '{REFERENCE}') then 'reference' else 'web' end as domain,
    coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::bigint as n_tokens from documents
), leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from docs group by all), {",".join(steps)},
plans as (select domain, lang, source, (given // tokens)::bigint as whole, (given % tokens)::bigint as remain from given_source where tokens > 0 and given > 0),
placed as (select *, md5(concat_ws(':', '{PLAN.seed}', whole::varchar, coalesce(doc_id::varchar, ''))) as place from docs join plans using (domain, lang, source)),
summed as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by place, n_tokens rows between unbounded preceding and 1 preceding), 0) as before from placed),
uses as (select *, whole + case when remain > 0 and before < remain then 1 else 0 end as times from summed)
select doc_id, domain, lang, source, n_tokens, unnest(range(0, times))::bigint as epoch from uses where times > 0
"""


SQL = _sql()
