"""Reference tables that a database source may hold: their columns, and a loader.

The rows are the user's: every table is given as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the reference tables.
SCHEMAS = {
    "countries_of_interest": "id string, country_name string, iso3_code string, region string, threat_level string, alliance_status string, border_length_km int, shares_border int, nuclear_power int, un_security_council int, active_disputes string, mil_personnel_est int, notes string",
    "threat_categories": "id int, category string, subcategory string, description string, primary_actors string, threat_domains string, priority string",
    "border_regions": "id int, region_name string, border_type string, adjacent_country string, length_km int, status string, key_flashpoints string, terrain string, strategic_importance string, last_major_incident string",
    "defence_assets": "id int, asset_name string, category string, service string, origin string, status string, quantity string, capability string, strategic_role string",
    "strategic_events_ref": "id int, event_date string, event_name string, category string, countries string, location string, outcome string, strategic_lesson string",
}


def conformed(df: DataFrame, name: str) -> DataFrame:
    """Rows with the columns of a reference table, in its types; columns that are
    not given are null, others are left out, of rows with one id the first by
    their text stays, and rows without an id go."""
    fields = [c.split() for c in SCHEMAS[name].split(", ")]
    rows = df.select(*[(F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in fields]).where("id IS NOT NULL")
    least = F.min(F.struct(F.to_json(F.struct(*rows.columns)).alias("text"), F.struct(*rows.columns).alias("row"))).alias("least")
    return rows.groupBy("id").agg(least).select("least.row.*")


def seed(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> list[str]:
    """The given tables as Parquet below a folder; their paths, in the order of
    ``SCHEMAS``. An unknown name is a ``ValueError``."""
    if unknown := set(tables) - set(SCHEMAS):
        raise ValueError(f"unknown reference tables: {', '.join(sorted(unknown))}")
    paths = []
    for name in SCHEMAS:
        if name in tables:
            paths.append(f"{folder.rstrip('/')}/{name}")
            conformed(tables[name], name).write.mode("overwrite").parquet(paths[-1])
    return paths


def reference_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables below a folder."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}")
