"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termgap.session import Staging

#: Stands for a null doc_id inside the operators, so that joins and sorts treat it as an ordinary, smallest id.
NO_ID = -(2**63)
#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that parts words.
BLANKS = " \t\n\x0b\x0c\r"

_staging: dict[str, Staging] = {}


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text without nulls (null id: NO_ID, null text: empty), and nothing else of the table but `more`."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keyed_texts(docs: DataFrame, *more: Column) -> DataFrame:
    """As `texts`, with a hash h of the text: rows are one document only if id and text are the same."""
    return texts(docs, text_hash().alias("h"), *more)


def _several_texts(docs: DataFrame) -> bool:
    """Whether an id, null included, has different texts."""
    of = keyed_texts(docs).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    return of.filter("lo <> hi").limit(1).count() > 0


def numbered(docs: DataFrame) -> DataFrame:
    """shown (the id, NO_ID for null), text, and doc_id: the id itself, or numbers in order of id and text hash if an id has different texts."""
    if not _several_texts(docs):
        return texts(docs).withColumn("shown", F.col("doc_id"))
    key = ["doc_id", "h"]
    ids = keyed_texts(docs).select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key)
    ids = keep(ids.withColumn("number", F.monotonically_increasing_id()), "numbers")
    return keyed_texts(docs).join(ids, key).select(F.col("number").alias("doc_id"), "text", F.col("doc_id").alias("shown"))


def identified(docs: DataFrame, *more: Column) -> DataFrame:
    """As `keyed_texts`, but h is 0 everywhere if no id, null included, has different texts; then it takes next to no space."""
    if _several_texts(docs):
        return keyed_texts(docs, *more)
    return texts(docs, F.lit(0).cast("long").alias("h"), *more)


def first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of the rows of `docs` one for each group c: that with the smallest id, then text hash. grouped: doc_id, h, c of every row."""
    cols = docs.columns
    n = grouped.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.min("c").alias("c"))
    first = keep(n.groupBy("c").agg(F.min(F.struct("doc_id", "h", "n")).alias("at")).select("at.*"), "first")
    rows = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_h", text_hash())
    first = first.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), F.col("n").alias("_n"))
    rows = rows.join(first, ["_doc", "_h"])
    again = rows.filter("_n > 1").groupBy("_doc", "_h").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("_row"))
    return rows.filter("_n = 1").select(*[F.col(f"`{c}`") for c in cols]).union(again.select(*[F.col(f"_row.`{c}`") for c in cols]))


def words(text: Column) -> Column:
    """The words of a text, as WORD defines them. Splitting at one plain character needs no regular expression."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def is_blank(line: Column) -> Column:
    """Whether a line has no word; reads no further than its first word."""
    return F.ltrim(line, F.lit(BLANKS)) == ""


def shown_id(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def staging(spark: SparkSession) -> Staging:
    """The session's own folder below spark.checkpoint.dir; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _staging:
        _staging[app] = Staging(spark)
        atexit.register(_close, app)
    return _staging[app]


def _close(app: str) -> None:
    try:
        _staging.pop(app).close()
    except Exception:  # noqa: BLE001  the session, and with it the file system client, may be gone already
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{staging(spark).root}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    The driver's garbage is collected then, since Spark removes the shuffle files of finished plans only with it.
    """
    kept = staging(df.sparkSession).keep(df, f"{name}-{uuid.uuid4().hex}")
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return kept


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def let(df: DataFrame, **cols: Column) -> DataFrame:
    """Add computed columns as the output of a generator, so that later lambdas read them instead of computing them anew."""
    fields = F.struct(*[c.alias(k) for k, c in cols.items()])
    return df.select("*", F.explode(F.array(fields)).alias("_let")).select(*df.columns, *[F.col(f"_let.{k}").alias(k) for k in cols])
