"""E-mail addresses in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import EMAIL, full


def candidates(text: Column) -> Column:
    """What looks like an address, token by token, without the marks around it."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: (F.length(t) >= 5) & (F.length(t) <= 320) & F.contains(t, F.lit("@")))
    found = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(f"({EMAIL})"), F.lit(1))))
    return F.transform(found, lambda e: F.regexp_replace(e, r"\A[.,\-_]+|[.,\-_]+\z", ""))


def valid(email: Column) -> Column:
    local, domain = F.substring_index(email, "@", 1), F.regexp_replace(email, r"\A[^@]*@", "")
    labels = F.forall(F.split(domain, r"\.", -1), lambda p: (p != "") & (F.length(p) <= 63) & ~p.startswith("-") & ~p.endswith("-"))
    good_local = (F.length(local) <= 64) & ~local.startswith(".") & ~local.endswith(".") & ~F.contains(local, F.lit(".."))
    return full(email, EMAIL) & (F.length(email) <= 254) & good_local & labels


def extract(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """For each row: ``emails`` (valid, lower case, distinct, sorted), ``rejected`` and ``duplicates_removed``."""
    found = texts.select(*keep, candidates(F.coalesce(F.col(text), F.lit(""))).alias("c"))
    good = F.filter("c", valid)
    emails = F.array_sort(F.array_distinct(F.transform(good, F.lower)))
    return found.select(*keep, emails.alias("emails"), F.array_distinct(F.filter("c", lambda e: ~valid(e))).alias("rejected"), (F.size(good) - F.size(emails)).alias("duplicates_removed"))


def list_quality(emails: DataFrame, email: str = "email") -> DataFrame:
    """0 to 100 for a list of addresses: well-formed ones and distinct ones."""
    good = F.count(F.when(full(email, EMAIL), 1))
    score = good / F.count("*") * 70 + F.count_distinct(email) / F.count("*") * 30
    return emails.agg(F.when(F.count("*") == 0, 0).otherwise(F.floor(score)).cast("int").alias("score"))
