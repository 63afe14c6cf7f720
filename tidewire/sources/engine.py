"""The ingestion engine: readers by type, built from a configuration, and a run
of all of them into the record store.

A reader is a function ``(spark, options) -> DataFrame`` of ``payload, error``
(a map of texts, and what could not be parsed). The failure of one source does
not stop the others: its class (transient, structural or fatal) and message are in
the statistics.

What a source adds (records, dead letters, its line of the run log) becomes valid at
once, by a version of the store's manifest: a run that is killed in between leaves
folders that nobody reads, and can be run again. Counts come from the writes.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import ingest, merge
from tidewire.sources import files, web
from tidewire.storage import Manifest, RacingWriters, new_path, stored

Reader = Callable[[SparkSession, dict], DataFrame]
STATS = "source_type string, source_name string, status string, extracted long, validated long, failed long, inserted long, skipped long, seconds double, error_type string, message string"
#: How often a source is added again where another run came in between.
TRIES = 5
# Other fields that may hold a record's id, by the kind of reader.
ID_FIELDS = {"rss": ["id", "link", "title"], "events": ["url", "title"], "indicators": ["id", "country_code"], "sql": ["id", "name"]}


class Registry:
    """Readers by the name of their type; names do not depend on case."""

    def __init__(self):
        self._readers: dict[str, tuple[str, Reader]] = {}

    def register(self, name: str, source_type: str, reader: Reader) -> None:
        self._readers[name.strip().lower()] = (source_type, reader)

    def types(self) -> list[str]:
        return sorted(self._readers)

    def get(self, name: str) -> tuple[str, Reader]:
        """(type of source, reader); an unknown name is a ``ValueError``."""
        key = name.strip().lower()
        if key not in self._readers:
            raise ValueError(f"unknown source type {name!r}; registered: {', '.join(self.types())}")
        return self._readers[key]


def _rss(spark: SparkSession, o: dict) -> DataFrame:
    feeds = {f["name"]: f["url"] for f in o.get("feeds", [])}
    rows = web.feed_entries(web.bodies(spark, feeds, timeout=o.get("timeout", 15)), int(o.get("max_items_per_feed", 50)), o.get("now", ""))
    return files.table_rows(rows.withColumn("tags", F.to_json("tags")))


def _events(spark: SparkSession, o: dict) -> DataFrame:
    return files.table_rows(web.search_events(spark, o["url"], o["query_topics"], o.get("language", "english"), o.get("cache_path")))


REGISTRY = Registry()
REGISTRY.register("csv", "CSV", lambda spark, o: files.csv_rows(spark, o["file_path"], o.get("delimiter")))
REGISTRY.register("json", "JSON", lambda spark, o: files.json_rows(spark, o["file_path"], int(o.get("max_depth", 1))))
REGISTRY.register("sql", "SQL", lambda spark, o: files.jdbc_rows(spark, o["db_uri"], o["table"], o.get("where")) if "db_uri" in o else files.parquet_rows(spark, o["path"], o.get("where")))
REGISTRY.register("rest", "REST", lambda spark, o: web.payload_of(web.scan(spark, web.RestSource, **{k: v for k, v in o.items() if k in ("url", "headers", "params", "data_key", "next_page_key", "timeout")})))
REGISTRY.register("rss", "JSON", _rss)
REGISTRY.register("events", "CSV", _events)


@dataclass
class Source:
    """A configured source."""

    name: str
    type: str
    entity_type: str = "record"
    id_field: str | None = "id"
    options: dict = field(default_factory=dict)


def sources_of(config: dict, environ: dict[str, str] | None = None, only: str | None = None, skip: tuple[str, ...] = ()) -> list[Source]:
    """The sources of a configuration that are switched on; ``only`` keeps those
    of one name or type, ``skip`` leaves types out."""
    found = []
    for name, o in files.enabled(config.get("sources", {}), environ or {}).items():
        kind = str(o.get("source_type", name)).lower()
        if (only and only.lower() not in (name.lower(), kind)) or kind in skip:
            continue
        rest = {k: v for k, v in o.items() if k not in ("source_type", "entity_type", "entity_id_field", "description")}
        found.append(Source(name, kind, o.get("entity_type", "record"), o.get("entity_id_field", "id"), rest))
    return found


def load_config(path: str) -> dict:
    """A configuration file, JSON or YAML (where a YAML parser is installed)."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yml", ".yaml")):
            import yaml

            return yaml.safe_load(f) or {}
        return json.load(f)


def describe(spark: SparkSession, config: dict, registry: Registry = REGISTRY) -> DataFrame:
    """The configuration as rows ``name, source_type, enabled, registered, options``."""
    rows = []
    for name, o in config.get("sources", {}).items():
        kind = str(o.get("source_type", name)).lower()
        rows.append((name, kind, bool(o.get("enabled", True)), kind in registry.types(), json.dumps({k: v for k, v in o.items() if k not in ("enabled", "source_type")}, sort_keys=True)))
    return spark.createDataFrame(rows, "name string, source_type string, enabled boolean, registered boolean, options string")


#: What tells the class of an error that has passed through Spark: the exceptions of
#: the web sources by name, and what Spark, drivers and networks say.
_MARKS = [
    (ingest.FATAL, ["web.Fatal"]), (ingest.STRUCTURAL, ["web.Structural"]), (ingest.TRANSIENT, ["web.Transient"]),
    (ingest.TRANSIENT, ["SQLTransient", "SocketTimeout", "timed out", "ConnectException", "Connection reset", "Connection refused"]),
    (ingest.STRUCTURAL, ["MALFORMED", "CANNOT_PARSE", "PARSE_SYNTAX_ERROR", "JSONDecodeError", "FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA"]),
]


def error_type(error: BaseException) -> str:
    """The class of a source's failure: transient (may pass), structural (what was
    read has not the expected form), or fatal (all else: missing files and tables,
    refused access, wrong settings)."""
    own = {web.Fatal: ingest.FATAL, web.Structural: ingest.STRUCTURAL, web.Transient: ingest.TRANSIENT, json.JSONDecodeError: ingest.STRUCTURAL, UnicodeDecodeError: ingest.STRUCTURAL, TimeoutError: ingest.TRANSIENT, ConnectionError: ingest.TRANSIENT}
    for kind, name in own.items():
        if isinstance(error, kind):
            return name
    text = f"{type(error).__name__}: {error}"
    return next((name for name, marks in _MARKS if any(m in text for m in marks)), ingest.FATAL)


class Engine:
    """Reads sources into the record store below ``store`` and the dead letters
    below ``dead`` (Parquet and JSON folders of a shared file system, one for each
    source of a run; ``runs`` names those that are valid)."""

    def __init__(self, spark: SparkSession, store: str, dead: str, registry: Registry = REGISTRY):
        self.spark, self.store, self.dead, self.registry = spark, store.rstrip("/"), dead.rstrip("/"), registry
        self.runs = Manifest(spark, f"{self.store}/_runs")
        self.sources: list[Source] = []
        self.stats: list[tuple] = []

    @classmethod
    def from_config(cls, spark: SparkSession, config: dict | str, only: str | None = None, skip: tuple[str, ...] = (), **more) -> Engine:
        config = load_config(config) if isinstance(config, str) else config
        place = {"store": new_path(spark, "records"), "dead": new_path(spark, "dead")} | {k: v for k, v in config.get("storage", {}).items() if k in ("store", "dead")}
        engine = cls(spark, **(place | more))
        engine.sources = sources_of(config, dict(os.environ), only, skip)
        return engine

    def register(self, source: Source) -> None:
        self.registry.get(source.type)
        self.sources.append(source)

    def _parts(self, what: str) -> list[str]:
        return [r[what] for r in self.runs.latest()[1] or [] if r.get(what)]

    def records(self) -> DataFrame | None:
        """What the store holds; None before the first record."""
        parts = self._parts("records")
        return self.spark.read.parquet(*parts) if parts else None

    def dead_letters(self, source_type: str | None = None) -> DataFrame:
        """The dead letters of all runs."""
        parts = self._parts("dead")
        rows = self.spark.read.schema(files.DEAD_SCHEMA).json(parts) if parts else self.spark.createDataFrame([], files.DEAD_SCHEMA)
        return rows.where(F.col("source_type") == source_type) if source_type else rows

    def log(self) -> DataFrame:
        """The statistics of every source of every run that ended well."""
        return self.spark.createDataFrame([tuple(r["log"]) for r in self.runs.latest()[1] or []], STATS)

    def _run_one(self, source: Source, began: float) -> tuple:
        source_type, reader = self.registry.get(source.type)
        read = reader(self.spark, source.options)
        parsed = ingest.to_records(read, source_type, source.name, source.entity_type, source.id_field, ID_FIELDS.get(source.type, []), ("error",))
        parsed = parsed.withColumn("errors", ingest.errors_of(parsed))
        good = F.col("error").isNull() & (F.size("errors") == 0)
        seen = Observation()
        marked = stored(parsed.withColumn("good", good).observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good")), "marked")
        n, n_valid = seen.get["n"], seen.get["good"]
        valid = marked.where("good").drop("good", "error", "errors")
        bad = ingest.split_valid(marked.where("error IS NULL AND NOT good").drop("good", "error", "errors"))[1]
        bad = bad.unionByName(files.dead_of(marked, source_type, source.name))
        dead = None
        if n > n_valid:
            dead = f"{self.dead}/run={uuid.uuid4().hex}"
            files.append_dead(bad, dead)
        for _ in range(TRIES):
            version, have = self.runs.latest()
            have, records = have or [], f"{self.store}/run={uuid.uuid4().hex}"
            parts = [r["records"] for r in have if r.get("records")]
            known = self.spark.read.parquet(*parts) if parts else valid.limit(0)
            new, written = merge.insert_or_ignore(valid, known.select("entity_id", "checksum"), ["entity_id", "checksum"], "record_id"), Observation()
            new.withColumn("ingested_at", F.current_timestamp()).observe(written, F.count("*").alias("n")).write.parquet(records)
            n_new = written.get["n"]
            line = (source_type, source.name, "success", n, n_valid, n - n_valid, n_new, n_valid - n_new, time.perf_counter() - began, None, None)
            try:
                self.runs.commit(version + 1, [*have, {"records": records if n_new else None, "dead": dead, "log": line}])
                return line
            except RacingWriters:  # what the other run added is known now
                continue
        raise RacingWriters(f"{TRIES} times at {self.store}")

    def run(self) -> DataFrame:
        """Reads every source, one after another; the statistics, a row a source."""
        self.stats = []
        for source in self.sources:
            began = time.perf_counter()
            kind = self.registry.get(source.type)[0]
            try:
                self.stats.append(self._run_one(source, began))
            except Exception as e:  # noqa: BLE001 - one source must not stop the others
                self.stats.append((kind, source.name, "aborted", 0, 0, 0, 0, 0, time.perf_counter() - began, error_type(e), f"{type(e).__name__}: {str(e)[:300]}"))
        return self.spark.createDataFrame(self.stats, STATS)

    def totals(self) -> dict[str, int]:
        """What this run attempted, inserted, skipped and put among the dead."""
        add = lambda i: sum(s[i] for s in self.stats)
        return {"attempted": add(4), "inserted": add(6), "skipped": add(7), "failed": add(5)}
