"""Text reports of counts and metrics: lines made in the plan, a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The headings of the reports and their rules.
RULE = "=" * 54
KPI_HEADING, CATEGORY_HEADING, METRIC_HEADING = "Intelligence KPIs", "Category distribution", "Classification metrics"


def _lines(df: DataFrame, heading: str, lines: list[Column]) -> DataFrame:
    """``line, text``: a heading between rules and the lines of one row."""
    text = F.array(F.lit(RULE), F.lit(heading), F.lit(RULE), *lines, F.lit(RULE))
    return df.select(F.posexplode(text).alias("line", "text"))


def kpi_report(kpis: DataFrame) -> DataFrame:
    """The dashboard counts, a line each."""
    return _lines(kpis, KPI_HEADING, [F.format_string(f"%-20s %8d", F.lit(c), F.col(c)) for c in kpis.columns])


def category_report(counts: DataFrame) -> DataFrame:
    """Counts by label in their order (``position, label, n``), with shares."""
    rows = F.array_sort(F.collect_list(F.struct("position", "label", "n")))
    total = F.greatest(F.sum("n"), F.lit(1))
    one = counts.agg(rows.alias("r"), total.alias("t"))
    told = F.transform("r", lambda x: F.format_string("%-28s %8d %6.1f%%", x["label"], x["n"], F.round(x["n"] * 100 / F.col("t"), 1)))
    text = F.concat(F.array(F.lit(RULE), F.lit(CATEGORY_HEADING), F.lit(RULE)), told, F.array(F.lit(RULE)))
    return one.select(F.posexplode(text).alias("line", "text"))


def metric_report(totals: DataFrame) -> DataFrame:
    """Metrics over all labels, a line each."""
    numbers = [c for c in totals.columns if c != "sample_size"]
    return _lines(totals, METRIC_HEADING, [F.format_string("%-20s %8d", F.lit("sample_size"), "sample_size"), *[F.format_string("%-20s %8.4f", F.lit(c), F.col(c)) for c in numbers]])
