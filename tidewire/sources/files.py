"""Rows of CSV, JSON, JDBC and text sources, each as a map column ``payload``.

What a source cannot parse comes back with an ``error``; both go on to
``operators.ingest`` (records and dead letters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

# Delimiters that are tried, and the characters looked at.
DELIMITERS, SNIFF_CHARS, FETCH_ROWS = [",", "\t", "|", ";"], 4096, 500
DEAD_SCHEMA = "source_type string, source_name string, raw_record string, error_type string, error_message string, attempts int"


def sniff(sample: str) -> str:
    """The delimiter that most lines of the sample have equally often, and of
    several the one they have more of; a comma if no line has any."""
    lines = [x for x in sample[:SNIFF_CHARS].split("\n") if x.strip()]
    if len(lines) > 1 and len(sample) > SNIFF_CHARS:
        lines.pop()  # cut off

    def fit(sep: str) -> tuple[int, int]:
        first = lines[0].count(sep) if lines else 0
        return (sum(x.count(sep) == first for x in lines) if first else 0, first)

    return max(DELIMITERS, key=fit)


def _first_lines(spark: SparkSession, path: str, most: int = 40) -> list[str]:
    """The first filled lines of the first file."""
    rows = spark.read.text(path).where(F.length("value") > 0).limit(most).collect()
    return [r[0].lstrip("\ufeff") if i == 0 else r[0] for i, r in enumerate(rows)]


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).where(F.length("value") > 0).first()
    return row[0].lstrip("﻿") if row else ""


def csv_rows(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "utf-8", multi_line: bool = False) -> DataFrame:
    """``payload, error`` of each row of CSV files with a header; values trimmed.

    A row with a surplus value is an error; missing and empty values are left
    out of the payload. An empty file gives no rows.
    """
    lines = _first_lines(spark, path)
    sep = delimiter or sniff("\n".join(lines))
    read = spark.read.option("sep", sep).option("encoding", encoding).option("escape", '"').option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_raw").option("columnPruning", False)
    names, width = _header(spark, lines[0] if lines else "", sep)
    schema = StructType()
    for i in range(width + 1):
        schema = schema.add(f"c{i}", "string")
    # The schema has one value more than the header: a row that fits it is too
    # long, and of one that does not (its text is kept) the separators are counted.
    rows = read.option("header", True).option("enforceSchema", True).schema(schema.add("_raw", "string")).csv(path)
    bare = F.regexp_replace("_raw", '"[^"]*"', "")
    long = F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) >= width, F.lit(True))
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.trim(f"c{i}").alias("value")) for i, n in enumerate(names)]) if names else F.expr("array()").cast("array<struct<key:string,value:string>>")
    payload = F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))
    return rows.select(payload.alias("payload"), F.when(long, "row is longer than the header").alias("error"))


def _header(spark: SparkSession, line: str, sep: str) -> tuple[list[str], int]:
    """The distinct column names of a header line and its columns; a repeated name
    gets its place, unnamed columns at the end have no name."""
    if not line:
        return [], 0
    row = spark.createDataFrame([(line,)], "v string").select(F.from_csv("v", ", ".join(f"c{i} string" for i in range(line.count(sep) + 1)), {"sep": sep, "escape": '"'}).alias("r")).first().r
    names = [(n or "").strip() for n in row]
    width = len(names)
    while names and not names[-1]:
        names.pop()
    return [n if n and n not in names[:i] else f"{n}_{i}" for i, n in enumerate(names)], width


def flatten_fields(schema: StructType, depth: int = 1, prefix: str = "", path: Column | None = None) -> list[tuple[str, Column]]:
    """Dotted names and text values of nested fields down to ``depth``; what lies
    deeper, and lists, as JSON."""
    out = []
    for f in schema.fields:
        value = F.col(f"`{f.name}`") if path is None else path.getField(f.name)
        if isinstance(f.dataType, StructType) and depth > 0:
            out += flatten_fields(f.dataType, depth - 1, f"{prefix}{f.name}.", value)
        else:
            nested = isinstance(f.dataType, StructType | ArrayType | MapType)
            out.append((f"{prefix}{f.name}", F.to_json(value) if nested else value.cast("string")))
    return out


def as_payload(fields: list[tuple[str, Column]]) -> Column:
    """Filled values as a map, in the order of the fields."""
    if not fields:
        return F.expr("map()").cast("map<string,string>")
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in fields]), F.array(*[c for _, c in fields])), lambda k, v: v.isNotNull())


def json_rows(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """``payload, error`` of a JSON list or of JSON lines; the first character
    tells which. An item that is no object is an error."""
    is_list = _first_line(spark, path).lstrip()[:1] == "["
    found = spark.read.option("primitivesAsString", True).option("multiLine", is_list).option("columnNameOfCorruptRecord", "_corrupt").json(path).schema
    kept = StructType([f for f in found.fields if f.name != "_corrupt"])
    text = spark.read.text(path, wholetext=is_list)
    items = text.select(F.explode(F.from_json("value", "array<string>")).alias("value")) if is_list else text.where(F.trim("value") != "")
    row = F.from_json("value", kept.add("_corrupt", "string"), {"columnNameOfCorruptRecord": "_corrupt"})
    rows = items.select(row.alias("r"))
    fields = flatten_fields(StructType(kept.fields[:-1]), depth, path=F.col("r"))
    return rows.select(as_payload(fields).alias("payload"), F.when(F.col("r._corrupt").isNotNull(), "item is no JSON object").alias("error"))


def table_rows(df: DataFrame) -> DataFrame:
    """``payload, error`` of the rows of any table."""
    return df.select(as_payload([(f.name, F.col(f"`{f.name}`").cast("string")) for f in df.schema.fields]).alias("payload"), F.lit(None).cast("string").alias("error"))


def parquet_rows(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """``payload, error`` of a Parquet table; the filter reaches the scan."""
    df = spark.read.parquet(path)
    return table_rows(df.where(where) if where else df)


def articles_of_json(spark: SparkSession, path: str, schema: str, whole: bool = True) -> DataFrame:
    """Articles of JSON files that hold a list, or an object whose ``articles``
    are one; an object without them gives none. ``whole``: each file is one text,
    else each line."""
    text = spark.read.text(path, wholetext=whole)
    low = F.ltrim(F.regexp_replace("value", "^\ufeff", ""))
    wrapped = F.from_json("value", f"articles array<struct<{schema}>>")["articles"]
    items = F.when(low.startswith("["), F.from_json("value", f"array<struct<{schema}>>")).otherwise(wrapped)
    return text.select(F.explode(items).alias("a")).where("a IS NOT NULL").select("a.*")


def jdbc_rows(spark: SparkSession, url: str, name: str, where: str | None = None, **options) -> DataFrame:
    """``payload, error`` of a database table. The filter runs in the database.
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    among the options make the scan parallel. A table that is not there is a
    ``ValueError``."""
    try:
        df = _jdbc(spark, url, name, options)
    except Exception as e:
        if any(m in str(e).lower() for m in ("no such table", "does not exist", "doesn't exist", "not found", "unknown table")):
            raise ValueError(f"there is no table {name}") from e
        raise
    return table_rows(df.where(where) if where else df)


def _jdbc(spark: SparkSession, url: str, name: str, options: dict) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).option("fetchsize", FETCH_ROWS).options(**options).load()


def dead_of(rows: DataFrame, source_type: str, source_name: str) -> DataFrame:
    """Dead letters of the rows with an error."""
    return rows.where("error IS NOT NULL").select(F.lit(source_type).alias("source_type"), F.lit(source_name).alias("source_name"), F.to_json("payload").alias("raw_record"), F.lit("structural").alias("error_type"), F.col("error").alias("error_message"), F.lit(1).alias("attempts"))


def append_dead(dead: DataFrame, path: str) -> None:
    dead.write.mode("append").json(path)


def read_dead(spark: SparkSession, path: str, source_type: str | None = None) -> DataFrame:
    """Dead letters as JSON lines; lines that do not parse are left out."""
    rows = spark.read.schema(DEAD_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("source_type") == source_type) if source_type else rows


def clear_dead(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], DEAD_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, source_type: str | None = None, entity_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Canonical records of a Parquet store; the filters reach the scan, and
    payloads of JSON text are parsed."""
    rows = spark.read.parquet(path)
    for name, value in (("source_type", source_type), ("entity_type", entity_type)):
        rows = rows.where(F.col(name) == value) if value else rows
    if "payload" in rows.columns and rows.schema["payload"].dataType.simpleString() == "string":
        rows = rows.withColumn("payload", F.from_json("payload", "map<string,string>"))
    return rows.limit(limit) if limit else rows


def gold_rows(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """Rows of a labelling file whose gold and predicted labels are both known."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    known = lambda c: F.trim(c).isin(labels)
    return rows.withColumns({c: F.trim(c) for c in ("gold_category", "predicted_category")}).where(known("gold_category") & known("predicted_category"))


def enabled(config: dict[str, dict], environ: dict[str, str], only: list[str] | None = None) -> dict[str, dict]:
    """Sources that are switched on (the default), each with its options;
    ``NAME_ENABLED`` and ``NAME_OPTION`` of the environment come first."""
    out = {}
    for name, options in config.items():
        given = {k: environ.get(f"{name}_{k}".upper(), v) for k, v in ({"enabled": True} | options).items()}
        if str(given.pop("enabled")).lower() in ("true", "1", "yes") and (only is None or name in only):
            out[name] = given
    return out
