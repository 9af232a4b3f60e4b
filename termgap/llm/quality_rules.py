"""Quality rules with cross-document line frequency: lines that many documents of a host share are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgap.llm.common import is_blank, keep, let, shown_id, texts, words

MIN_WORDS = 50
#: Documents of one host that may hold a line before it counts as boilerplate.
MAX_DOCS_PER_HOST = 20
#: A document is depleted when less than this share of its words is left, or fewer than MIN_WORDS.
MIN_KEPT_SHARE = 0.3


def _line_key(host: Column, line_words: Column) -> Column:
    """Hash of host and normalised line: lower case, blanks folded. 64 bits: a line meets another one by chance in 1 of 10^7 at 10^12 lines."""
    return F.xxhash64(host, F.lower(F.array_join(line_words, " ")))


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words inside three-word windows that occur at least twice; `windows` are the windows' hashes in text order."""
    at = F.sequence(F.lit(0), F.size(windows) - 1)
    # (hash, place) in order: a window is repeated if a neighbour in that order has its hash
    order = F.sort_array(F.arrays_zip(windows.alias("h"), at.alias("i")))
    n = F.size(windows)
    trio = F.arrays_zip(
        order.alias("x"),
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(order, 1, n - 1)).alias("before"),
        F.slice(order, 2, n).alias("after"),
    )
    met = F.filter(trio, lambda t: F.coalesce(t["x"]["h"] == t["before"]["h"], F.lit(False)) | F.coalesce(t["x"]["h"] == t["after"]["h"], F.lit(False)))
    places = F.sort_array(F.transform(met, lambda t: t["x"]["i"]))
    nexts = F.slice(places, 2, n)
    covered = F.zip_with(places, nexts, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)


def base_rules(docs: DataFrame) -> DataFrame:
    """One row per document with the counts of the base rules, `base_failed`, and the hash of the text as row key."""
    rows = let(texts(docs), w=words(F.col("text")))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    n = F.size("w")
    rows = let(
        rows,
        lines=F.filter(F.split("text", "\n"), lambda x: ~is_blank(x)),
        windows=F.when(n >= 3, F.transform(F.slice("w", 1, n - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))),
    )
    none_twice = F.col("windows").isNull() | (F.size(F.array_distinct("windows")) == F.size("windows"))
    rows = rows.select(
        "doc_id",
        F.xxhash64("text").alias("row_key"),
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(none_twice, F.lit(0).cast("long")).otherwise(_repeat_words(F.col("w"), F.col("windows"))).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def shared_lines(docs: DataFrame, max_docs: int) -> DataFrame:
    """Per document, the words in lines that more than `max_docs` documents of its host hold.

    Each document offers a line once; counts are partially aggregated, so neither a line in every document nor a host
    with a third of all rows meets in one task.
    """
    rows = texts(docs, F.coalesce(F.col("source"), F.lit("")).alias("host")).select("doc_id", F.xxhash64("text").alias("row_key"), "host", F.explode(F.split("text", "\n")).alias("line"))
    rows = let(rows.filter(~is_blank(F.col("line"))), w=words(F.col("line"))).select(
        "doc_id", "row_key", _line_key(F.col("host"), F.col("w")).alias("line_key"), F.size("w").cast("long").alias("words")
    )
    per_doc = keep(rows.groupBy("line_key", "doc_id", "row_key").agg(F.sum("words").alias("words")), "lines")
    common = per_doc.groupBy("line_key").agg(F.count_distinct("doc_id").alias("n_docs")).filter(F.col("n_docs") > max_docs)
    return per_doc.join(common, "line_key", "left_semi").groupBy("doc_id", "row_key").agg(F.sum("words").alias("n_shared_words"))


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """Base counts, base_failed, n_shared_words and kept of every row of `docs` (doc_id, text, source).

    A document is kept if it passes the base rules and is not depleted once the lines above the limit are removed.
    Null ids stay null (and share one document); null and empty texts have no words and fail; a null source is a host
    of its own; repeated rows count once for a line and are each returned; an empty table gives no rows; other columns
    are ignored.
    """
    shared = shared_lines(docs, max_docs)
    rows = base_rules(docs).join(shared, ["doc_id", "row_key"], "left")
    left = F.col("n_words") - F.coalesce("n_shared_words", F.lit(0).cast("long"))
    depleted = (left < MIN_WORDS) | (left < min_kept_share * F.col("n_words"))
    return rows.select(
        shown_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("n_shared_words", F.lit(0).cast("long")).alias("n_shared_words"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )
