"""Array, bit-mask, number and JSON helpers: Column to Column, all native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ngrams(tokens: Column, most: int = 5) -> Column:
    """All runs of 1 to most tokens, as array<struct<phrase, at, n>>."""
    def runs(n: int) -> Column:
        last = F.size(tokens) - n
        made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.array_join(F.slice(tokens, i + 1, n), " ").alias("phrase"), i.alias("at"), F.lit(n).alias("n")))
        return F.when(last >= 0, made).otherwise(F.array().cast("array<struct<phrase:string,at:int,n:int>>"))

    return F.flatten(F.array(*[runs(n) for n in range(1, most + 1)]))


def contains_run(tokens: Column, run: Column) -> Column:
    """Whether the tokens of run stand next to each other in tokens."""
    pad = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(run) > 0) & pad(tokens).contains(pad(run))


def mask_positions(mask: Column, width: int = 63) -> Column:
    """The positions of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0))))


def log_loss(p: Column, y: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def smoothed_share(hits: Column, n: Column, prior: Column, weight: float = 4.0) -> Column:
    return (hits + weight * prior) / (n + weight)


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, null where b is zero."""
    x = F.try_divide(a, b)
    return x if digits is None else F.bround(x, digits)


def unit_score(x: Column, digits: int = 5) -> Column:
    return F.when(x.between(0, 1), F.bround(x, digits))


def text_or_list(json: Column) -> Column:
    """A JSON value that is one text or a list of texts, as a list of tidy texts."""
    many = F.from_json(json, "array<string>")
    one = F.array(F.regexp_replace(F.trim(json), '^"|"$', ""))
    clean = F.filter(F.transform(F.when(F.trim(json).startswith("["), many).otherwise(one), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.when(json.isNotNull(), F.array_distinct(clean))


def cell_list(cell: Column, separator: str = ",", placeholders: tuple[str, ...] = ()) -> Column:
    """The distinct, trimmed parts of a multi-valued cell, placeholders left out."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), separator), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & ~F.lower(x).isin(*(placeholders or ("",)))))
