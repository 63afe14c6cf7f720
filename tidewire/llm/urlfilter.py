"""URL filter: a blocked Bloom filter before an exact hash join.

Two lists are sought at once. Rules ``host + path prefix`` have a verdict and
fit their host with all subdomains; of those that fit a url the longest wins.
Listed canonical urls (``canonical``: host + path) are blocked where no rule
fits. So each url has few possible entries: its canonical form, and every suffix
of its host's labels with every prefix of its path whose length occurs in the
rules. Those keys are tested against a blocked Bloom filter of all entries; what
passes goes to an exact join with the entries, which removes the false
positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize

#: 64-bit words of a Bloom block (512 bits) and the bits that a key sets in it.
BLOCK_WORDS, BITS_PER_KEY, KEY_BITS = 8, 16, 6
#: The filter and the entries are broadcast up to these many bytes each; beyond,
#: both joins shuffle.
BROADCAST_BYTES = 64 << 20
#: What an entry marks in the filter beside its text.
RULE, EXACT = "r", "u"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (entry, verdict): the production rules.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host: after the first ``://`` up to ``/ ? #``; else ''."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(rest, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """The path after the host up to ``?`` or ``#``; '' without ``://``."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(url: Column) -> Column:
    """Host and path, the path at least ``/``: what listed urls are known by.
    Scheme, query and fragment do not count, neither do a host's trailing dot and
    the ports 80 and 443. Null and urls without ``://`` have none."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"\.$", "")
    path = path_of(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path)))


def bloom_address(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block number of a key and its mask in it, an array of ``BLOCK_WORDS`` longs."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    seed = F.xxhash64(key, F.lit("bits"))
    spots = [F.pmod(F.shiftrightunsigned(seed, 9 * i), F.lit(64 * BLOCK_WORDS)).cast("int") for i in range(KEY_BITS)]
    words = []
    for w in range(BLOCK_WORDS):
        word = F.lit(0).cast("long")
        for s in spots:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)).cast("int"))
            word = word.bitwiseOR(F.when(F.floor(s / 64) == w, one).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return block, F.array(*words)


def blocked_bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``(block, words)``: the filter as a table of one row a used block."""
    block, mask = bloom_address(F.col(key), blocks)
    masks = keys.select(block.alias("block"), mask.alias("mask"))
    return masks.groupBy("block").agg(F.array(*[F.bit_or(F.col("mask")[w]) for w in range(BLOCK_WORDS)]).alias("words"))


def _bytes(df: DataFrame, column: str) -> int:
    """Bytes of a column's texts with some room a row."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column) + 64), F.lit(0))).first()[0]


def entries_of(rules: DataFrame, listed: DataFrame | None) -> DataFrame:
    """``kind, entry, verdict``, one row an entry; null entries are left out and
    of equal rules the smallest verdict counts."""
    known = rules.where(F.col("rule").contains("/")).groupBy(F.lit(RULE).alias("kind"), F.col("rule").alias("entry")).agg(F.min("verdict").alias("verdict"))
    if listed is None:
        return known
    urls = listed.select(canonical(F.col("url")).alias("entry")).where("entry IS NOT NULL").distinct()
    # Read several times below, so computed once.
    return materialize(known.unionByName(urls.select(F.lit(EXACT).alias("kind"), "entry", F.lit("block").alias("verdict"))), "entries")


def possible_entries(places: DataFrame, entries: DataFrame, cuts: list[int], labels_most: int | None = None) -> tuple[DataFrame, bool]:
    """``host, path, kind, entry`` of the keys that pass the filter, and whether
    the entries are small enough to be broadcast. No rule has a host of more than
    ``labels_most`` labels, so a host of thousands of them has few keys."""
    count, size = entries.count(), _bytes(entries, "entry")
    blocks = max(1, -(-count * BITS_PER_KEY // (64 * BLOCK_WORDS)))
    bloom = blocked_bloom(entries.select(F.concat("kind", "entry").alias("k")), "k", blocks)
    small = blocks * (BLOCK_WORDS * 8 + 64) <= BROADCAST_BYTES and size <= BROADCAST_BYTES
    labels = F.split("host", r"\.")
    first = F.lit(1) if labels_most is None else F.greatest(F.lit(1), F.size(labels) - (labels_most - 1))
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1)))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in cuts]).cast("array<int>"), lambda n: F.substring(F.col("path"), F.lit(1), n)), lambda p: F.length(p) > 0)
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(F.lit(RULE), h, p))))
    keys = F.array_distinct(F.concat(F.array(F.concat(F.lit(EXACT), "form")), keys))
    each = places.select("host", "path", F.explode(keys).alias("k"))
    block, mask = bloom_address(F.col("k"), blocks)
    probed = each.select("*", block.alias("block"), mask.alias("mask")).join(F.broadcast(bloom) if small else bloom, "block")
    passes = F.lit(True)
    for w in range(BLOCK_WORDS):
        passes = passes & (F.col("words")[w].bitwiseAND(F.col("mask")[w]) == F.col("mask")[w])
    return probed.where(passes).select("host", "path", F.substring("k", 1, 1).alias("kind"), F.expr("substring(k, 2)").alias("entry")), small


def judge_urls(pages: DataFrame, key: str, url: str, rules: DataFrame, listed: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``(key, host, path, rule, verdict)``, one row for each row of ``pages``.

    ``rules``: ``(rule, verdict)``, rule being host + path prefix with the
    path's first ``/`` after the host. ``listed``: a table with a column ``url``
    of urls that are blocked (of any size, such as a Parquet table), or None. A
    url's verdict is that of the longest rule that fits; else ``block`` if its
    canonical form is listed; else ``default``, among them null and empty urls.
    Repeated rows of ``pages`` give repeated rows; other columns are not read.
    """
    entries = entries_of(rules, listed)
    # One number a distinct prefix length, at most the longest path of a rule.
    labels = F.size(F.split(F.substring_index("entry", "/", 1), r"\."))
    lengths = entries.where(F.col("kind") == RULE).select((F.length("entry") - F.instr("entry", "/") + 1).alias("n"), labels.alias("labels"))
    lengths = lengths.groupBy("n").agg(F.max("labels").alias("labels")).collect()
    cuts, labels_most = sorted(r.n for r in lengths), max((r.labels for r in lengths), default=1)
    base = pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("form"))
    base = base.select(key, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "form")
    if not cuts and listed is None:
        return base.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # The entry is sought once for each distinct (host, path), so that repeated
    # urls cost one search and the result joins back on what was searched.
    places = base.select("host", "path", "form").where("host <> ''").distinct()
    possible, small = possible_entries(places, entries, cuts, labels_most)
    exact = possible.join(F.broadcast(entries) if small else entries, ["kind", "entry"])
    rank = F.struct((F.col("kind") == RULE).alias("rule"), F.length("entry").alias("n"), "entry", "verdict")
    best = exact.groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = best.select("host", "path", F.when(F.col("best.rule"), F.col("best.entry")).alias("rule"), "best.verdict")
    # Urls without a host have no entry: they are spread instead of meeting in one task.
    spread = F.when(F.col("host") == "", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int")).otherwise(-1)
    sought = base.withColumn("spread_", spread).join(best.withColumn("spread_", F.lit(-1)), ["host", "path", "spread_"], "left")
    return sought.select(key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op6_urls(spark, root: str) -> DataFrame:
    """Verdict of every page's url by ``RULES``; what no rule fits is allowed."""
    pages = spark.read.parquet(f"{root}/pages.parquet")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return judge_urls(pages, "page_id", "url", rules)


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, instr(url, '://') AS pos FROM pages),
h AS (
  SELECT page_id,
         CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM p),
r(rule, host, path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (
  SELECT h.*, r.rule, r.verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS n
  FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
