"""Rendering: values, periods, citations, labels, table rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def value_format(raw: Column, unit: Column) -> Column:
    """Numbers by unit: dollars with billions or millions spelled, shares, whole and other numbers; others as they are."""
    text = strip(F.coalesce(raw, F.lit("")))
    x = text.try_cast("double")
    kind = F.lower(F.coalesce(unit, F.lit("")))
    whole = F.format_number(x, 0)
    dollars = (
        F.when(F.abs(x) >= 1e9, F.concat(F.lit("USD "), whole, F.lit(" ("), F.format_number(x / 1e9, 2), F.lit(" billion)")))
        .when(F.abs(x) >= 1e6, F.concat(F.lit("USD "), whole, F.lit(" ("), F.format_number(x / 1e6, 1), F.lit(" million)")))
        .otherwise(F.concat(F.lit("USD "), F.format_number(x, 2)))
    )
    return (
        F.when(x.isNull(), text)
        .when(F.contains(kind, F.lit("usd")), dollars)
        .when(F.contains(kind, F.lit("shares")), F.concat(whole, F.lit(" shares")))
        .when(x == F.floor(x), whole)
        .otherwise(F.format_number(x, 2))
    )


def period_label(instant: Column, start: Column, end: Column, verbose: bool = False) -> Column:
    """``as of D``, ``FYyyyy`` for whole calendar years, ``S to E``, or that none is stated."""
    span = F.concat(start, F.lit(" to "), end)
    year = F.endswith(start, F.lit("-01-01")) & F.endswith(end, F.lit("-12-31")) & (F.left(start, F.lit(4)) == F.left(end, F.lit(4)))
    both = start.isNotNull() & end.isNotNull()
    named = F.concat(F.lit("for the period "), span) if verbose else F.when(year, F.concat(F.lit("FY"), F.left(start, F.lit(4)))).otherwise(span)
    return F.when(instant.isNotNull(), F.concat(F.lit("as of "), instant)).when(both, named).otherwise(F.lit("period not stated"))


def member_label(members: Column) -> Column:
    """Dimension members in a row, without the mark that they are members."""
    return F.array_join(F.transform(members, lambda m: F.regexp_replace(m, r"\s*\[Member\]$", "")), ", ")


def citation(title: Column, locator: Column, label: Column) -> Column:
    page = F.regexp_like(locator, F.lit(r"^p\d+$"))
    return F.when(page, F.concat(title, F.lit(", page "), F.substring(locator, 2, 20))).otherwise(F.concat(title, F.lit(", "), F.coalesce(label, locator)))


def config_label(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)


def table_row(*cells: Column) -> Column:
    """A Markdown row; null is empty and fractions have four places."""
    return F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(c, F.lit("")) for c in cells]), " | "), F.lit(" |"))


def slug(c: Column) -> Column:
    return F.replace(c, F.lit(":"), F.lit("_"))
