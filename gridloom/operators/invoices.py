"""Invoice arithmetic: gaps filled from what is there, and checks of items and totals, as expressions.

An invoice is a row with subtotal, tax and total as texts and items as an array of structs of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import blank, format_number, nearly, parse_number

ITEM = "struct<description:string,quantity:string,unit_price:string,amount:string>"


def fill_items(items: Column) -> Column:
    """The one that is blank of quantity, price and amount from the two others; never by a division by zero."""

    names = (("q", "quantity"), ("p", "unit_price"), ("a", "amount"))
    gone = lambda x, n: ~F.coalesce(x[n], F.lit("")).rlike(r"\S")
    numbers = lambda x: F.struct(x.alias("x"), *[parse_number(x[n]).alias(k) for k, n in names], *[gone(x, n).alias(f"no_{k}") for k, n in names])

    def fill(r):
        x, q, p, a = r["x"], r["q"], r["p"], r["a"]
        ratio = lambda n, d: F.when(d != 0, format_number(F.try_divide(n, d)))
        amount = F.when(r["no_a"], format_number(q * p))
        price = F.when(r["no_p"] & ~r["no_a"], ratio(a, q))
        quantity = F.when(r["no_q"] & ~r["no_p"] & ~r["no_a"], ratio(a, p))
        return F.struct(x["description"].alias("description"), F.coalesce(quantity, x["quantity"]).alias("quantity"), F.coalesce(price, x["unit_price"]).alias("unit_price"), F.coalesce(amount, x["amount"]).alias("amount"))

    # Numbers are read once, in a first pass over the items.
    return F.transform(F.transform(items, numbers), fill)


def items_sum(items: Column) -> Column:
    """Sum of the amounts that are numbers; null if none is."""
    numbers = F.filter(F.transform(items, lambda x: parse_number(x["amount"])), lambda v: v.isNotNull())
    total = lambda found: F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, v: a + v))
    return F.get(F.transform(F.array(numbers), total), F.lit(0))  # read once


def _with_numbers(invoices: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``invoices`` with columns, to be dropped, for what is read once and used often: subtotal, tax and total as numbers."""
    names = {f"__{c}": parse_number(c) for c in ("subtotal", "tax", "total")}
    return invoices.withColumns(names), [F.col(c) for c in names]


def fill_gaps(invoices: DataFrame) -> DataFrame:
    """Items first, then the subtotal from them, then the one of subtotal, tax and total that is blank."""
    out = invoices.withColumn("items", fill_items(F.col("items"))).withColumn("__sum", items_sum(F.col("items")))
    out = out.withColumn("subtotal", F.when(blank("subtotal"), F.coalesce(format_number(F.col("__sum")), F.col("subtotal"))).otherwise(F.col("subtotal"))).drop("__sum")
    out, (s, t, total) = _with_numbers(out)
    gone = {c: blank(c) for c in ("subtotal", "tax", "total")}
    return out.withColumns(
        {
            "total": F.when(gone["total"] & s.isNotNull() & t.isNotNull(), format_number(s + t)).otherwise(F.col("total")),
            "tax": F.when(gone["tax"] & s.isNotNull() & total.isNotNull(), format_number(total - s)).otherwise(F.col("tax")),
            "subtotal": F.when(gone["subtotal"] & t.isNotNull() & total.isNotNull(), format_number(total - t)).otherwise(F.col("subtotal")),
        }
    ).drop("__subtotal", "__tax", "__total")


def checked(invoices: DataFrame) -> DataFrame:
    """``items_review``: items do not add up to subtotal, total minus tax, or total; ``totals_review``: nor does the total."""
    out, (s, t, total) = _with_numbers(invoices)
    out = out.withColumns({"__target": F.coalesce(s, total - t, total), "__items": items_sum(F.col("items"))})
    flags = {"items_review": F.coalesce(~nearly(F.col("__items"), F.col("__target")), F.lit(False)), "totals_review": F.coalesce(~nearly(s + t, total), F.lit(False))}
    return out.withColumns(flags).drop("__subtotal", "__tax", "__total", "__target", "__items")


def export_rows(invoices: DataFrame, *fields: str) -> DataFrame:
    """A row for each item with the invoice's fields; an invoice without items is one row."""
    return invoices.select(*fields, F.explode_outer("items").alias("i")).select(*fields, *[F.coalesce(F.col(f"i.{c}"), F.lit("")).alias(c) for c in ("description", "quantity", "unit_price", "amount")])


def quality(invoices: DataFrame, fields: tuple[str, ...] = ("company", "number", "date", "customer", "total")) -> DataFrame:
    """``invoices`` with ``quality``: how many of a hundred of the key fields were found."""
    found = sum((F.when(blank(c), 0).otherwise(1) for c in fields), F.lit(0))
    return invoices.withColumn("quality", F.floor(found * 100 / len(fields)).cast("int"))
