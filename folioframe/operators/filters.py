"""Faceted filters and projections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(column: str, text: str) -> Column:
    """Case-insensitive containment of a literal text; null holds nothing."""
    return F.lower(F.col(column)).contains(text.lower())


def facets(df: DataFrame, *, equal: Mapping[str, object] | None = None, text: Mapping[str, str] | None = None, low: Mapping[str, object] | None = None, high: Mapping[str, object] | None = None) -> DataFrame:
    """Conjunction of facets; a facet whose value is None is not asked for. Bounds are inclusive.

    A text facet's key may name several columns joined by '|': one of them must contain the text.
    """
    for column, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    for names, value in (text or {}).items():
        if value:
            hit = F.lit(False)
            for name in names.split("|"):
                hit = hit | F.coalesce(contains(name, value), F.lit(False))
            df = df.where(hit)
    for bounds, above in ((low, True), (high, False)):
        for column, value in (bounds or {}).items():
            if value is not None:
                df = df.where(F.col(column) >= F.lit(value) if above else F.col(column) <= F.lit(value))
    return df


def having(df: DataFrame, links: DataFrame, dimension: DataFrame, condition: Column, *, on: str, link: str) -> DataFrame:
    """Rows of df that are linked to a row of dimension that meets condition: each once, however many links it has."""
    wanted = links.join(dimension.where(condition).select(link), link, "left_semi").select(on)
    return df.join(wanted, on, "left_semi")


def all_tokens(column: Column, query: str) -> Column:
    """Every token of the query is a token of the text."""
    tokens = F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    wanted = F.filter(F.split(F.lower(F.lit(query)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.size(F.array_except(wanted, tokens)) == 0


def any_token(columns: list[str], query: str, *, most: int = 8, least: int = 3) -> Column:
    """One of the first `most` query tokens of `least` letters and more stands in one of the columns."""
    tokens = [t for t in query.lower().split() if len(t) >= least][:most]
    hit = F.lit(False)
    for t in tokens:
        for c in columns:
            hit = hit | F.coalesce(contains(c, t), F.lit(False))
    return hit


def page_interval(df: DataFrame, page: int) -> DataFrame:
    """Chunks whose pages hold `page`; without an end they have one page."""
    return df.where((F.col("page_start") <= page) & (F.coalesce("page_end", "page_start") >= page))


#: Texts that give instructions to a reader that is a program.
MARKERS = ("ignore previous", "system prompt", "developer message", "reveal instructions", "disregard all")


def has_marker(column: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    low = F.lower(F.coalesce(column, F.lit("")))
    hit = F.lit(False)
    for m in markers:
        hit = hit | low.contains(m)
    return hit


def public_url(column: Column) -> Column:
    """The value if it is an http or https address with a host, else null."""
    return F.when(column.rlike(r"(?i)^https?://[^/\s?#]+"), column)


def window_of(df: DataFrame, column: str, since: str | None = None, until: str | None = None, *, keep_undated: bool = False) -> DataFrame:
    """Rows dated from since to until, both days included; undated rows go unless kept."""
    day = F.to_date(column)
    ok = F.lit(True)
    if since:
        ok = ok & (day >= F.lit(since).cast("date"))
    if until:
        ok = ok & (day <= F.lit(until).cast("date"))
    return df.where(F.coalesce(ok, F.lit(keep_undated)))


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in a total order; the limit is kept within 1 to 500, the offset at 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def ordered(df: DataFrame, column: str, descending: bool, allowed: tuple[str, ...], default: str, key: str) -> list[Column]:
    c = F.col(column if column in allowed else default)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key)]
