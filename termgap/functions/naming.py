"""Keys, file names, number rules and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name rules.
EMPTY_NAME = "leerer_dateiname"
MAX_NAME_CHARS = 100
SEPARATOR_RUN = r'[\s\\/:*?"<>|\x0B\x1C-\x1F\x85\p{Z}]+'
NOT_ALLOWED = r"[^\p{L}\p{N}_.\-]"
LONG_NAME_CUT = r"^(.{61,99})[_.]"


def cluster_count(pages: Column, most: int) -> Column:
    return F.when(pages > 3, F.least(F.lit(most), F.greatest(F.lit(2), F.floor(pages / 2)))).otherwise(
        F.greatest(F.lit(1), pages)
    ).cast("int")


def content_key(*parts: Column) -> Column:
    """md5 of the lower-cased parts joined by underscores; a missing part counts as an empty one."""
    return F.md5(F.lower(F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def cache_file(cache_type: Column, key: Column, extension: str = "json") -> Column:
    return F.concat(cache_type, F.lit("_"), key, F.lit("." + extension))


def safe_name(name: Column) -> Column:
    joined = F.regexp_replace(F.coalesce(name, F.lit("")), SEPARATOR_RUN, "_")
    tidy = F.btrim(F.regexp_replace(F.regexp_replace(joined, NOT_ALLOWED, ""), "_+", "_"), F.lit("._"))
    head = F.left(tidy, F.lit(MAX_NAME_CHARS))
    cut = F.regexp_extract(head, LONG_NAME_CUT, 1)
    short = F.btrim(F.when(cut != "", cut).otherwise(head), F.lit("._"))
    result = F.when(F.length(tidy) > MAX_NAME_CHARS, short).otherwise(tidy)
    return F.when(result == "", F.lit(EMPTY_NAME)).otherwise(result)


def output_base(prefix: Column, query: Column, run_at: Column) -> Column:
    chosen = F.coalesce(F.when(prefix != "", prefix), query)
    return F.concat_ws("_", safe_name(chosen), F.date_format(run_at, "yyyyMMdd-HHmmss"))


def short_url(url: Column, chars: int) -> Column:
    return F.when(F.length(url) > chars, F.concat(F.left(url, F.lit(chars)), F.lit("..."))).otherwise(url)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)

