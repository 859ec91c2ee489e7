"""Choosing between the clean table and the raw table.

Two endpoints of the original answer from the raw table when the clean one
is missing: the flows without dates, mode or per-video de-duplication, and
the counts without a day filter. Here the choice is made up front from the
catalog and the schema, not by catching a failed query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendlens.operators import filters as flt
from trendlens.operators.counts import country_counts
from trendlens.operators.flows import country_flows, country_flows_raw


def usable(spark: SparkSession, table: str) -> DataFrame | None:
    """The clean table, if the catalog has it and it has a day: the one rule of when the raw table answers."""
    if not spark.catalog.tableExists(table):
        return None
    df = spark.table(table)
    return df if flt.DAY in df.columns else None


def check_unfiltered(unfiltered: bool, on_date, start, end, mode, sources) -> None:
    """The raw table has no day and no per-video rows: a filter it cannot serve is refused unless asked for."""
    flt.day_filter(on_date, start, end)  # the days are checked either way
    flt.flow_mode(mode)
    asked = [name for name, value in (("on_date", on_date), ("start", start), ("end", end),
                                      ("mode", (mode or "").strip().lower() not in ("", flt.ALL)),
                                      ("sources", flt.sources_in(sources) is not None)) if value]
    if asked and not unfiltered:
        raise ValueError(f"the clean table is missing and the raw table cannot serve {', '.join(asked)}; "
                         "unfiltered=True asks for the unfiltered answer")


def flows_or_raw(spark: SparkSession, clean: str = "trending_clean", raw: str = "trending_raw", on_date=None,
                 start=None, end=None, mode: str | None = "", sources=None, unfiltered: bool = False) -> DataFrame:
    """``country_flows`` on the clean table, else ``country_flows_raw`` on the raw one.

    Days are always checked. On the raw table a day, mode or source filter is
    an error unless ``unfiltered`` allows the answer without it.
    """
    df = usable(spark, clean)
    if df is not None:
        return country_flows(df, on_date, start, end, mode, sources)
    check_unfiltered(unfiltered, on_date, start, end, mode, sources)
    return country_flows_raw(spark.table(raw))


def counts_or_raw(spark: SparkSession, clean: str = "trending_clean", raw: str = "trending_raw", on_date=None,
                  start=None, end=None, unfiltered: bool = False) -> DataFrame:
    """``country_counts`` on the clean table, else on the raw one, where a day filter is refused likewise."""
    df = usable(spark, clean)
    if df is not None:
        return country_counts(df, on_date, start, end)
    check_unfiltered(unfiltered, on_date, start, end, "", None)
    return country_counts(spark.table(raw))
