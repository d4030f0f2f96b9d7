"""Search over an index of rows: filters, facets, order, paging, look-ups."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import search_key


@dataclass(frozen=True)
class Filters:
    """Conditions on rows (start, end, organisation, actors, sources, cves, techniques, kev, haystack); None asks nothing."""

    words: str | None = None
    since: str | None = None
    until: str | None = None
    actor: str | None = None
    source: str | None = None
    organisation: str | None = None
    cve: str | None = None
    technique: str | None = None
    kev: bool = False
    undated: bool = False

    @classmethod
    def parse(cls, query: str) -> Filters:
        """From a query string; malformed dates and unknown names are dropped."""
        given = {k: v[0] for k, v in parse_qs(query).items() if k in {f.name for f in fields(cls)}}
        for k in ("since", "until"):
            try:
                date.fromisoformat(given.get(k, ""))
            except ValueError:
                given.pop(k, None)
        flags = {k: given.pop(k) in ("1", "true") for k in ("kev", "undated") if k in given}
        return cls(**given, **flags)

    def query(self) -> str:
        return urlencode({f.name: "1" if v is True else v for f in fields(self) if (v := getattr(self, f.name))})


def haystack(*parts: Column) -> Column:
    return search_key(F.concat_ws(" ", *parts))


def overlaps(start: Column, end: Column, since: Column | None, until: Column | None, open_ended: bool = True) -> Column:
    """Whether [start, end] meets [since, until]; a missing end is open, or the start where rows are points."""
    last = end if open_ended else F.coalesce(end, start)
    out = F.lit(True)
    if since is not None:
        out = out & (last.isNull() | (last >= since))
    if until is not None:
        out = out & (start <= until)
    return out


def any_prefix(values: Column, prefix: str) -> Column:
    return F.exists(values, lambda x: x.startswith(prefix))


def all_words(hay: Column, words: str) -> Column:
    """Whether every word begins some word of the haystack."""
    asked = F.filter(F.split(search_key(F.lit(words)), " "), lambda x: x != "")
    return F.forall(asked, lambda w: hay.contains(F.concat(F.lit(" "), w)))


def explore(df: DataFrame, f: Filters) -> DataFrame:
    """The rows that meet every condition; without a date only where undated rows are asked for."""
    ok = F.lit(True) if f.undated else F.col("start").isNotNull()
    dated = lambda x: F.lit(x).cast("date") if x else None
    if f.since or f.until:
        ok = ok & (F.col("start").isNull() | overlaps(F.col("start"), F.col("end"), dated(f.since), dated(f.until)))
    if f.actor:
        ok = ok & F.array_contains("actors", f.actor)
    if f.source:
        ok = ok & F.array_contains("sources", f.source)
    if f.organisation:
        ok = ok & (F.col("organisation") == f.organisation)
    if f.kev:
        ok = ok & F.col("kev")
    if f.cve:
        ok = ok & any_prefix(F.col("cves"), f.cve.upper())
    if f.technique:
        ok = ok & any_prefix(F.col("techniques"), f.technique.upper())
    if f.words:
        ok = ok & all_words(F.col("haystack"), f.words)
    return df.where(ok)


def newest_first(df: DataFrame, day: str, title: str, id_col: str) -> DataFrame:
    return df.orderBy(F.col(day).desc_nulls_last(), F.lower(title), id_col)


def facet(df: DataFrame, col: str, is_array: bool = False) -> DataFrame:
    values = df.select(F.explode(col).alias("value")) if is_array else df.select(F.col(col).alias("value"))
    return values.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def counts_for(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Rows of each of the keys, zero for those without."""
    wanted = df.sparkSession.createDataFrame([(k,) for k in keys], f"{col} string")
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, col, "left").select(col, F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Page:
    number: int
    size: int
    total: int

    @property
    def pages(self) -> int:
        return max(1, -(-self.total // self.size))

    @property
    def current(self) -> int:
        return min(max(1, self.number), self.pages)

    def around(self, reach: int = 2) -> list[int]:
        return list(range(max(1, self.current - reach), min(self.pages, self.current + reach) + 1))


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    """One page of an ordered DataFrame; out-of-range numbers are moved to the nearest page."""
    p = Page(number, size, ordered.count())
    return ordered.offset((p.current - 1) * size).limit(size)


def by_prefix(df: DataFrame, id_col: str, prefix: str, aliases: DataFrame | None = None) -> DataFrame:
    """The row whose id, or former id in aliases (alias, id), begins with the prefix, if there is just one."""
    names = df.select(F.col(id_col).alias("__id"), F.col(id_col).alias("__name"))
    if aliases is not None:
        names = names.unionByName(aliases.select(F.col("id").alias("__id"), F.col("alias").alias("__name")))
    hit = names.where(F.col("__name").startswith(prefix)).agg(F.min("__id").alias("lo"), F.max("__id").alias("hi")).where("lo = hi")
    return df.join(hit, df[id_col] == hit["lo"], "left_semi")


def pick(df: DataFrame, id_col: str, ids: list) -> tuple[DataFrame, DataFrame]:
    """Rows in the order of the ids, and the ids without a row."""
    wanted = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{id_col} {df.schema[id_col].dataType.simpleString()}, __at int")
    return df.join(F.broadcast(wanted), id_col).orderBy("__at").drop("__at"), wanted.join(df, id_col, "left_anti").select(id_col)


def search_names(df: DataFrame, name: str, aliases: str, words: str) -> DataFrame:
    """Entities whose name or alias holds the words, with the first alias that does where the name does not."""
    key = lambda c: F.trim(search_key(c))
    asked = key(F.lit(words))
    via = F.get(F.filter(aliases, lambda a: key(a).contains(asked)), F.lit(0))
    own = key(F.col(name)).contains(asked)
    return df.withColumn("matched_alias", F.when(~own, via)).where(own | via.isNotNull())


ENTITY_ORDERS = {
    "recent": lambda: [F.col("last_day").desc_nulls_last(), F.lower("name")],
    "reports": lambda: [F.desc("n_reports"), F.lower("name")],
    "name": lambda: [F.lower("name"), F.col("name")],
}


def union_rows(reports: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One list of both kinds, told apart by `kind`."""
    return reports.withColumn("kind", F.lit("report")).unionByName(campaigns.withColumn("kind", F.lit("campaign")), allowMissingColumns=True)
