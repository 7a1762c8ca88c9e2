"""Web addresses as expressions: lists of them in texts, and whether one points to the public network."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import blank, col, ws_trim

#: URLs of one run.
MOST_URLS = 30


def url_list(text: Column | str, most: int = MOST_URLS) -> Column:
    """The addresses in a text, one to a line or parted by commas, each once in order, with https where no scheme is given."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), "[\\n,]", -1), ws_trim), lambda x: ~blank(x))
    return F.slice(F.array_distinct(F.transform(parts, lambda x: F.when(x.rlike("(?i)\\Ahttps?://"), x).otherwise(F.concat(F.lit("https://"), x)))), 1, most)


def _named(value: Column, made) -> Column:
    """``made`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _v4(host: Column) -> Column:
    """An address of numbers as one number: a part before the last is a byte, the last one fills the rest; null for other hosts."""

    def made(numbers: Column) -> Column:
        n, last = F.size(numbers), F.element_at(numbers, -1)
        before = F.slice(numbers, 1, n - 1)
        first = F.aggregate(before, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
        room = F.pow(F.lit(256.0), (5 - n).cast("double")).cast("bigint")
        return F.when(F.forall(before, lambda x: x < 256) & (last < room), first * room + last)

    numbers = F.transform(F.split(host, r"\.", -1), lambda x: x.try_cast("bigint"))
    return F.when(host.rlike(r"\A\d{1,10}(\.\d{1,10}){0,3}\z"), _named(numbers, made))


def _public_v4(ip: Column) -> Column:
    within = lambda a, b, c, d, bits: F.floor(ip / float(1 << (32 - bits))) == ((a << 24 | b << 16 | c << 8 | d) >> (32 - bits))
    closed = [(0, 0, 0, 0, 8), (10, 0, 0, 0, 8), (100, 64, 0, 0, 10), (127, 0, 0, 0, 8), (169, 254, 0, 0, 16), (172, 16, 0, 0, 12), (192, 0, 0, 0, 24), (192, 168, 0, 0, 16), (198, 18, 0, 0, 15), (224, 0, 0, 0, 4), (240, 0, 0, 0, 4)]
    out = F.lit(True)
    for block in closed:
        out = out & ~within(*block)
    return out


def _public_v6(address: Column) -> Column:
    """Of an address in brackets; a first group of zeros or none is the address itself or the one of this machine."""
    mapped = F.regexp_extract(address, r"\A(?:0*:)*:?(?:ffff:)(\d+\.\d+\.\d+\.\d+)\z", 1)
    group = F.conv(F.regexp_extract(address, r"\A([0-9a-f]{1,4}):", 1), 16, 10).cast("int")
    own = _named(group, lambda g: (g > 0) & ((g < 0xFC00) | ((g >= 0xFE00) & (g < 0xFE80))))
    return _named(mapped, lambda m: F.when(m != "", _named(_v4(m), _public_v4)).otherwise(~address.startswith("::") & own))


def _public_host(host: Column) -> Column:
    named = host.rlike(r"\A[\p{L}\d_-]+(\.[\p{L}\d_-]+)*\.?\z") & ~host.rlike(r"\A(?:.*\.)?localhost\.?\z")
    six = F.regexp_extract(host, r"\A\[([0-9a-f:.]+)\]\z", 1)
    return F.when(host.startswith("["), _named(six, _public_v6)).when(host.rlike(r"\A[\d.]+\z"), _named(_v4(host), _public_v4)).otherwise(named)


def public_url(url: Column | str) -> Column:
    """Whether an address may be fetched: http or https, no user in it, and a host that is not in a private or reserved range.

    Names are not looked up, so of those only ``localhost`` is known to be local. Null and blank are not public.
    """
    authority = F.regexp_extract(ws_trim(F.coalesce(col(url), F.lit(""))), r"(?i)\Ahttps?://([^/?#\\]*)", 1)
    judged = lambda a: (a != "") & ~F.contains(a, F.lit("@")) & F.coalesce(_named(F.lower(F.regexp_replace(a, r":\d*\z", "")), _public_host), F.lit(False))
    return _named(authority, judged)
