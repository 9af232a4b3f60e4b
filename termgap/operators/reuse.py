"""Keyed reuse of earlier search results and page texts: a store of commits that are never rewritten.

A store is a folder. A save writes ``entries/version=…/cache_type=…``, an invalidation ``tombstones/version=…``, and either
becomes visible by an empty file ``manifest/<version>.<action>``, created last and only if it is new. Clearing is such a
file alone. A reader lists the manifest once and so sees one state, whatever is written meanwhile; earlier states stay
readable by their version.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termgap.functions.naming import content_key
from termgap.params import DEFAULT, Params
from termgap.schema import CACHE
from termgap.session import lookup_side
from termgap.sources.search import has_extraction_shape, has_search_shape

# Cache namespaces.
SEARCH_KIND = "serp_v2"
TEXT_KIND = "text_v2"
SAVE, INVALIDATE, CLEAR = "save", "invalidate", "clear"


def search_key(query: Column, num_results: Column, language: Column) -> Column:
    return content_key(F.lit(SEARCH_KIND), query, num_results, language)


def text_key(url: Column) -> Column:
    return content_key(F.lit(TEXT_KIND), url)


def stored_outcomes(looked: DataFrame) -> DataFrame:
    """``(url, text, error_code, error_detail)`` of page outcomes that a lookup found."""
    text, reason = stored_text(F.col("payload"))
    detail = F.when(F.contains(reason, F.lit(": ")), F.substring(reason, F.instr(reason, ": ") + 2, F.length(reason)))
    return looked.where(F.col("payload").isNotNull()).select(
        "url", text.alias("text"), F.substring_index(reason, ": ", 1).alias("error_code"), detail.alias("error_detail")
    )


def is_fresh(now: Column, params: Params = DEFAULT) -> Column:
    """Whether an entry is strictly younger than the time to live; a plain bound on the column, which scans can use."""
    return F.col("cached_at") > now - F.make_interval(secs=F.lit(params.cache_ttl_seconds))


def is_well_formed() -> Column:
    shape = F.when(F.col("cache_type") == SEARCH_KIND, has_search_shape(F.col("payload"))).when(
        F.col("cache_type") == TEXT_KIND, has_extraction_shape(F.col("payload"))
    )
    return F.coalesce(shape, F.lit(False))


@dataclass
class View:
    """One state of a store: the commits it consists of."""

    spark: SparkSession
    path: str
    saves: list[int]
    tombs: list[int]

    def _read(self, folder: str, versions: list[int], schema: str) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{folder}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/version={v}" for v in versions])

    def entries(self) -> DataFrame:
        """All entries of the state, newer and older ones of a key, with the version of their commit."""
        return self._read("entries", self.saves, f"{CACHE}, version BIGINT")

    def _newest(self, entries: DataFrame) -> DataFrame:
        """``(cache_type, cache_key, version)`` of each key's newest entry, unless it was invalidated since. Reads no payload."""
        newest = entries.groupBy("cache_type", "cache_key").agg(F.max("version").alias("version"))
        if not self.tombs:
            return newest
        dead = self._read("tombstones", self.tombs, "cache_key STRING, version BIGINT")
        dead = dead.groupBy("cache_key").agg(F.max("version").alias("dead"))
        alive = newest.join(lookup_side(dead), "cache_key", "left").where(F.col("dead").isNull() | (F.col("version") > F.col("dead")))
        return alive.select("cache_type", "cache_key", "version")

    def latest(self) -> DataFrame:
        """The newest entry of every key."""
        entries = self.entries()
        return entries.join(self._newest(entries), ["cache_type", "cache_key", "version"])

    def lookup(self, wanted: DataFrame, kind: str, now: Column, params: Params = DEFAULT, use_cache: bool = True) -> DataFrame:
        """``wanted(cache_key, …)`` with ``payload``: that of a fresh, well-formed entry, else null.

        Keys come first: fresh keys of one kind are narrowed to the wanted ones and to their newest version, and only
        these entries' payloads are read. An expired newest entry has no fresh older one, as commits follow in time.
        """
        if not use_cache:
            return wanted.withColumn("payload", F.lit(None).cast("string"))
        entries = self.entries().where((F.col("cache_type") == kind) & is_fresh(now, params))
        asked = wanted.select("cache_key").distinct()
        newest = self._newest(entries.join(lookup_side(asked), "cache_key", "left_semi"))
        found = entries.join(lookup_side(newest), ["cache_type", "cache_key", "version"])
        # a column, not a filter: a filter would be pushed to the scan and parse every payload
        return wanted.join(found.select("cache_key", F.when(is_well_formed(), F.col("payload")).alias("payload")), "cache_key", "left")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str = ""):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def commits(self) -> list[tuple[int, str]]:
        """(version, action) of every commit, in order."""
        fs, where = self._fs("manifest")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted((int(v), action) for v, _, action in (n.partition(".") for n in names if n[0].isdigit()))

    def _new_version(self) -> int:
        """Microseconds of the clock, later than every commit."""
        return max([time.time_ns() // 1000, *(v + 1 for v, _ in self.commits())])

    def _commit(self, version: int, action: str) -> int:
        fs, where = self._fs(f"manifest/{version}.{action}")
        fs.create(where, False).close()  # fails if another writer took the version
        return version

    def save(self, entries: DataFrame) -> int:
        """Add entries, of each key the newest, in key order, so that a lookup of few keys skips most of a file."""
        version = self._new_version()
        newest = F.row_number().over(Window.partitionBy("cache_type", "cache_key").orderBy(F.desc("cached_at"), "payload"))
        once = entries.withColumn("_nth", newest).where("_nth = 1").drop("_nth")
        once.write.partitionBy("cache_type").mode("errorifexists").parquet(f"{self.path}/entries/version={version}")
        return self._commit(version, SAVE)

    def invalidate(self, queries: DataFrame) -> int:
        """Hide the search entries of ``queries(query, num_results, language)`` saved so far; page texts stay."""
        version = self._new_version()
        keys = queries.select(search_key(F.col("query"), F.col("num_results"), F.col("language")).alias("cache_key")).distinct()
        keys.write.mode("errorifexists").parquet(f"{self.path}/tombstones/version={version}")
        return self._commit(version, INVALIDATE)

    def clear(self) -> int:
        """Hide everything saved so far."""
        return self._commit(self._new_version(), CLEAR)

    def view(self, version: int | None = None) -> View:
        """The state now, or as of a version."""
        done = [(v, action) for v, action in self.commits() if version is None or v <= version]
        start = max((v for v, action in done if action == CLEAR), default=0)
        of = {action: [v for v, a in done if a == action and v > start] for action in (SAVE, INVALIDATE)}
        return View(self.spark, self.path, of[SAVE], of[INVALIDATE])


def search_entries(searches: DataFrame, now: Column) -> DataFrame:
    """Entries for searches ``(query, num_results, language, payload, error)``; failed searches are not stored."""
    return searches.where(F.col("error").isNull()).select(
        F.lit(SEARCH_KIND).alias("cache_type"),
        search_key(F.col("query"), F.col("num_results"), F.col("language")).alias("cache_key"),
        "payload",
        now.alias("cached_at"),
    )


def text_entries(classified: DataFrame, now: Column) -> DataFrame:
    """Entries for page outcomes. Failures are stored too, so a bad page is not fetched again until it expires."""
    reason = F.concat_ws(": ", "error_code", "error_detail")
    pair = F.array(F.col("text"), F.when(F.col("error_code").isNotNull(), reason))
    return classified.select(
        F.lit(TEXT_KIND).alias("cache_type"),
        text_key(F.col("url")).alias("cache_key"),
        F.to_json(pair, {"ignoreNullFields": "false"}).alias("payload"),
        now.alias("cached_at"),
    )


def stored_text(payload: Column) -> tuple[Column, Column]:
    """Text and error of a stored page outcome."""
    pair = F.from_json(payload, "array<string>")
    return F.get(pair, 0), F.get(pair, 1)
