"""URL filter lists by a sort-merge range join over reversed-host keys, in DataFrame operations alone.

``www.example.com`` has the key ``com.example.www.``; all hosts under
``example.com`` are the keys that begin with ``com.example.``, an interval of
the sorted keys. Intervals of rules nest, so one sweep over keys and interval
starts in order keeps a stack of active rules: its level ``d`` is the last start
seen with ``d`` labels, active while the key still begins with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, materialize, skewed_join

#: Ranges of sorted keys that are swept apart: as many as there are hosts by ``RANGE_HOSTS``, within these bounds.
RANGE_HOSTS, LEAST_RANGES, MOST_RANGES = 100_000, 64, 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Host (A-Z lowered) and path of a URL column; both empty for a null or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host):
    """Labels in reverse order, each followed by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")))


def _bounds(hosts: DataFrame, ranges: int | None) -> list[str]:
    """Keys that part a bounded sample (by hash) of the distinct hosts evenly."""
    n = hosts.count()
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, -(-n // RANGE_HOSTS)))
    rate = min(1.0, 200 * ranges / max(1, n))
    sample = hosts.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(rate * 1_000_000)).select("key")
    keys = sorted(r["key"] for r in sample.limit(1000 * ranges).collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    ranges: int | None = None,
) -> DataFrame:
    """The verdict of the longest fitting rule for every URL.

    ``rules`` has rows ``host, path, verdict``; a rule fits its host and all
    subdomains if the URL's path begins with the rule's. Returns one row per
    input row: id, ``host``, ``path``, ``rule`` (host and path of the longest rule
    that fits, deeper hosts first among equals; null if none) and ``verdict``
    (``default`` if none). Null URLs and those without ``://`` have an empty host
    and path and no rule; a URL without a path fits no rule whose path is ``/``.
    Rules with a null or empty host or verdict are ignored, a null path is empty;
    of repeated rules with several verdicts the least applies. Hosts are swept
    once each; the pages of a hot one, which may have a third of them, are dealt
    to many parts when the swept rules are joined. Repeated rows are judged
    alike; an empty table gives an empty one; further columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("spread"))
    hosts = parsed.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    hosts = materialize(hosts.select("host", host_key(F.col("host")).alias("key"), "n"), "url-hosts")

    clean = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where("host <> '' and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    entry = F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("deep"), "path",
        F.concat("host", "path").alias("rule"), "verdict",
    )
    starts = clean.groupBy("host").agg(F.array_sort(F.collect_set(entry)).alias("entries"))
    starts = starts.select(host_key(F.col("host")).alias("key"), F.size(F.split("host", "\\.")).alias("level"), "entries")
    starts = materialize(starts, "url-rules")
    levels = [r["level"] for r in starts.select("level").distinct().orderBy("level").collect()]  # few: labels of a host

    cuts = F.array(*[F.lit(k) for k in _bounds(hosts, ranges)]).cast("array<string>")

    def range_of(key):
        return F.size(F.filter(cuts, lambda k: k <= key))

    last = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))  # '/' follows '.'
    spread = starts.withColumn("range", F.explode(F.sequence(range_of(F.col("key")), range_of(last))))
    events = spread.select("range", "key", F.lit(0).alias("kind"), "level", "entries", F.lit(None).cast("string").alias("host"))
    points = hosts.select(
        range_of(F.col("key")).alias("range"), "key", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast(starts.schema["entries"].dataType).alias("entries"), "host",
    )
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.unionByName(points)
    stack = {
        f"level_{d}": F.last(F.when(F.col("level") == d, F.struct("key", "entries")), ignorenulls=True).over(sweep) for d in levels
    }
    swept = swept.withColumns(stack).where("kind = 1")
    empty = F.array().cast(starts.schema["entries"].dataType)
    active = [
        F.when(F.col("key").startswith(F.col(f"level_{d}.key")), F.col(f"level_{d}.entries")).otherwise(empty) for d in levels
    ]
    stacks = swept.select("host", (F.concat(*active) if active else empty).alias("active")).where("size(active) > 0")

    fits = F.filter("active", lambda r: F.substring(F.col("path"), F.lit(1), F.length(r["path"])) == r["path"])
    best = F.array_max(F.coalesce(fits, empty))
    joined = skewed_join(parsed, stacks, ["host"], hot_keys(hosts, ["host"]), "spread", "left").withColumn("best", best)
    return joined.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the registered query: host, path, verdict.
EXAMPLE_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
