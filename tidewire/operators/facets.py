"""Filters, predicates and orders of the article queries."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.numbering import numbered_within

# The rank maps differ from query to query.
LISTING_RANK = {"CRITICAL": 1, "HIGH": 2, "MODERATE": 3}
QUEUE_RANK = {"CRITICAL": 1, "HIGH": 2, "MODERATE": 3, "LOW": 4}
IMPORTANCE_RANK = {"HIGH": 1, "MEDIUM": 2, "LOW": 3}


def rank_of(column: str, ranks: dict[str, int]) -> Column:
    """The rank of a label; labels without one come last."""
    out = F.lit(max(ranks.values()) + 1)
    for label, rank in ranks.items():
        out = F.when(F.col(column) == label, rank).otherwise(out)
    return out


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive substring test; ``%``, ``_`` and the escape are literal."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{escaped}%")


def any_contains(column: str, text: str) -> Column:
    return F.exists(column, lambda x: contains_text(x, text))


def facet_filter(df: DataFrame, *, level: str | None = None, monitoring: str | None = None, review: bool | None = None, category: str | None = None, source: str | None = None, state: str | None = None, city: str | None = None, country: str | None = None, sentiment: str | None = None, since: str | None = None, before: str | None = None) -> DataFrame:
    """AND of the facets that are given; plain columns reach the scan."""
    tests = []
    if level:
        tests.append(F.col("threat_level") == level.upper())
    if monitoring:
        tests.append(F.col("army_monitoring_needed") == monitoring)
    if review:
        tests.append(F.col("requires_human_review") == 1)
    if category:
        tests.append(contains_text(F.col("article_type"), category) | any_contains("categories", category))
    if source:
        tests.append(contains_text(F.col("source"), source))
    tests += [any_contains(c, v) for c, v in (("states", state), ("cities", city), ("countries", country)) if v]
    if sentiment:
        tests.append(F.col("sentiment") == sentiment)
    if since:
        tests.append(F.col("published_at") >= since)
    if before:
        tests.append(F.col("published_at") <= before)
    return df.where(reduce(and_, tests)) if tests else df


def by_severity(df: DataFrame, ranks: dict[str, int] = LISTING_RANK, importance: bool = False) -> list[Column]:
    """Severity first, then importance if asked for, then newest, then id."""
    order = [rank_of("threat_level", ranks).asc()]
    if importance:
        order.append(rank_of("importance", IMPORTANCE_RANK).asc())
    return [*order, F.col("published_at").desc_nulls_last(), F.col("article_id").asc()]


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of the listing."""
    return df.orderBy(*by_severity(df)).offset(offset).limit(limit)


def monitoring_queue(df: DataFrame, limit: int = 100) -> DataFrame:
    return df.where("army_monitoring_needed = 'YES'").orderBy(*by_severity(df, QUEUE_RANK, True)).limit(limit)


def review_queue(df: DataFrame, limit: int = 100) -> DataFrame:
    return df.where("requires_human_review = 1").orderBy(*by_severity(df)).limit(limit)


def newest_of_level(df: DataFrame, level: str, limit: int = 50) -> DataFrame:
    return df.where(F.col("threat_level") == level.upper()).orderBy(F.col("published_at").desc_nulls_last(), "article_id").limit(limit)


def unprocessed(df: DataFrame, flag: str, text: str = "article_text") -> DataFrame:
    """Rows with a text that a step (its 0/1 flag) has not seen."""
    return df.where((F.coalesce(F.col(flag), F.lit(0)) == 0) & F.col(text).isNotNull() & (F.col(text) != ""))


def like_search(df: DataFrame, tokens: list[str], columns: list[str]) -> DataFrame:
    """Every token (five at most) must be in one of the columns."""
    tests = [reduce(or_, [contains_text(F.col(c), t) for c in columns]) for t in tokens[:5]]
    return df.where(reduce(and_, tests)) if tests else df.limit(0)


def term_in_arrays(df: DataFrame, term: str, arrays: list[str], texts: list[str] | None = None) -> DataFrame:
    """The term is in an element of an array column or in a text column."""
    return df.where(reduce(or_, [any_contains(c, term) for c in arrays] + [contains_text(F.col(c), term) for c in texts or []]))


def located_rows(df: DataFrame, processed: str = "nlp_processed", states: str = "states") -> DataFrame:
    """Rows of geographic activity: processed ones, and those with a list of states."""
    return df.where((F.col(processed) == 1) | F.col(states).isNotNull())


def representatives(df: DataFrame, flag: str = "is_cluster_representative") -> DataFrame:
    """Representatives of their clusters; a missing flag counts as one."""
    return df.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(True)))


def pins(df: DataFrame, level: str, column: str = "max_level") -> DataFrame:
    """Map pins of a level; ``HIGH`` includes ``CRITICAL``, ``ALL`` is no filter."""
    if level.upper() == "ALL":
        return df
    return df.where(F.col(column).isin(["HIGH", "CRITICAL"] if level.upper() == "HIGH" else [level.upper()]))


def newest_dead_letters(df: DataFrame, limit: int, source_type: str | None = None) -> DataFrame:
    """Dead letters of a source type, the newest first."""
    rows = df.where(F.col("source_type") == source_type) if source_type else df
    return rows.orderBy(F.desc_nulls_last("timestamp"), "error_message").limit(limit)


def bucketed(df: DataFrame, column: str, order: list, name: str = "Unclassified") -> DataFrame:
    """``df`` with its bucket (``category``) and its place in it (from 0)."""
    labelled = df.withColumn("category", F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(name)))
    return numbered_within(labelled, "category", order, "position")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows: the first by a hash of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def at_position(df: DataFrame, position: int, *order: Column) -> DataFrame:
    """The row at a 1-based position."""
    return df.orderBy(*order).offset(position - 1).limit(1)


def exclude_titles(df: DataFrame, words: list[str], least: int = 5) -> DataFrame:
    """Rows whose title has none of the words; the first rows if all have one."""
    bad = reduce(or_, [F.lower("title").contains(w.lower()) for w in words])
    flagged = df.withColumn("_bad", bad)
    good = flagged.where("NOT _bad")
    # Which branch applies is known from one row; at most ``least`` rows of the other are kept.
    none_good = F.broadcast(good.limit(1).agg(F.count("*").alias("_n")).where("_n = 0"))
    rest = flagged.orderBy("article_id").limit(least).join(none_good, how="left_semi")
    return good.unionByName(rest).drop("_bad")


def first_of_each(df: DataFrame, key: list[Column], *order: Column) -> DataFrame:
    """The first row of each key."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def top_of_each(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with their number in ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def prefix_within(df: DataFrame, size: Column, budget: int, *order: Column, group: list[str] | None = None) -> DataFrame:
    """The longest prefix of each group whose sizes sum up to the budget."""
    window = Window.partitionBy(*(group or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(window)).where(F.col("used") <= budget)
