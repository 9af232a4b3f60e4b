"""Outputs of an analysis: term table, summary, report rows, context texts, failures, run table."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termgap.functions.naming import output_base
from termgap.operators.report import records

BOM = "\ufeff"
FORMATS = ("csv", "json", "html", "all")


def _by_keyword(df: DataFrame, folders: bool):
    """One folder per keyword only on request: with millions of keywords it would make millions of tiny files."""
    return df.write.partitionBy("query_id") if folders else df.write


def write_term_csv(scores: DataFrame, path: str, bom: bool = True, folders: bool = False) -> None:
    """``query_id, url, term, score`` rows as CSV with a header; the byte-order mark leads the first header name."""
    out = scores.select("query_id", "url", "term", "score")
    if bom and not folders:
        out = out.withColumnRenamed("query_id", BOM + "query_id")
    elif bom:
        out = out.withColumnRenamed("url", BOM + "url")
    _by_keyword(out, folders).option("header", True).mode("errorifexists").csv(path)


def _quoted(value: Column) -> Column:
    """A CSV field: quoted if it has to be."""
    return F.when(value.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def write_term_tables(tables: DataFrame, path: str, key: str = "page", rows_per_file: int = 100_000) -> None:
    """A wide CSV table for each keyword: the page, then a column for each of its kept terms, in order.

    Tables with different columns can't share a schema, so they are written as lines. All rows of a file meet in one
    task, the header first; a keyword with many pages has a file, with a header of its own, for each range of doc_ord.
    """
    part = F.floor(F.col("doc_ord") / rows_per_file)
    values = F.concat(F.array(_quoted(F.col("page"))), F.transform("weights", lambda w: w.cast("string")))
    lines = tables.select("query_id", part.alias("part"), F.lit(1).alias("_body"), "doc_ord", F.array_join(values, ",").alias("value"))
    names = F.concat(F.array(F.lit(BOM + key)), F.transform("names", _quoted))
    heads = tables.groupBy("query_id", part.alias("part")).agg(F.first("names").alias("names"))
    heads = heads.select("query_id", "part", F.lit(0).alias("_body"), F.lit(None).cast("bigint").alias("doc_ord"), F.array_join(names, ",").alias("value"))
    dealt = lines.unionByName(heads).repartition("query_id", "part").sortWithinPartitions("query_id", "part", "_body", "doc_ord")
    dealt.select("query_id", "part", "value").write.partitionBy("query_id", "part").mode("errorifexists").text(path)


def read_term_tables(spark: SparkSession, path: str, key: str = "page") -> DataFrame:
    """``(query_id, page, term, score)`` of every cell of tables that ``write_term_tables`` wrote."""
    field = r'^("(?:[^"]|"")*"|[^,]*)(?:,(.*))?$'
    plain = lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    lines = spark.read.schema("value STRING, query_id STRING, part BIGINT").text(path)
    is_head = F.col("value").rlike(f"^{BOM}?{key}(,|$)")  # the reader drops the mark of a file's start; no URL reads like that
    heads = lines.where(is_head).select("query_id", "part", F.slice(F.split("value", ","), 2, 2**31 - 1).alias("names"))
    first = F.regexp_extract("value", field, 1)
    rows = lines.where(~is_head).select("query_id", "part", plain(first).alias("page"), F.split(F.regexp_extract("value", field, 2), ",").alias("weights"))
    cells = F.arrays_zip(F.col("names").alias("term"), F.col("weights").alias("score"))
    return rows.join(heads, ["query_id", "part"]).select("query_id", "page", F.inline(cells)).select("query_id", "page", "term", F.col("score").cast("double").alias("score"))


def write_summary(summary: DataFrame, page_parts: DataFrame, path: str, folders: bool = False) -> None:
    """One JSON line per keyword, and one per page-level part."""
    _by_keyword(summary, folders).mode("errorifexists").json(f"{path}/keywords")
    _by_keyword(page_parts, folders).mode("errorifexists").json(f"{path}/pages")


def write_report(report: DataFrame, path: str) -> None:
    report.write.partitionBy("section").mode("errorifexists").parquet(path)


def context_text(context: DataFrame, run_at) -> DataFrame:
    """The context of a keyword under a header of keyword, time and rule line."""
    parts = [c for c in context.columns if c not in ("query_id", "query")]
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(c)) for c in parts])
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Empfehlungen für: "), "query"),
        F.date_format(run_at, "yyyyMMdd-HHmmss"),
        F.repeat(F.lit("="), F.lit(30)),
        F.lit(""),
    )
    return context.select("query_id", F.concat_ws("\n", head, body).alias("value"))


def write_context(context: DataFrame, path: str, run_at, folders: bool = False) -> None:
    """Plain text per keyword with ``folders``, else (query_id, value) as JSON lines."""
    text = context_text(context, run_at)
    if folders:
        text.write.partitionBy("query_id").mode("errorifexists").text(path)
    else:
        text.write.mode("errorifexists").json(path)


def write_failed(failed: DataFrame, path: str) -> None:
    failed.write.mode("errorifexists").parquet(path)


def write_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("errorifexists").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    records(df).write.mode("errorifexists").text(path)


def write_outputs(out: dict[str, DataFrame], path: str, run_at, output_format: str = "all") -> list[str]:
    """Write what the format asks for. The summary is always written. Returns the folders written."""
    if output_format not in FORMATS:
        raise ValueError(f"output_format must be one of {FORMATS}")
    done = []

    def put(name, write, *args):
        write(*args)
        done.append(f"{path}/{name}")

    if output_format in ("csv", "all"):
        put("tfidf", write_term_csv, out["tfidf"], f"{path}/tfidf")
        put("term_table", write_term_tables, out["term_table"], f"{path}/term_table")
    put("summary", write_summary, out["summary"], out["page_summary"], f"{path}/summary")
    put("context", write_context, out["context"], f"{path}/context", run_at)
    if output_format in ("html", "all"):
        put("report", write_report, out["report"], f"{path}/report")
    put("failed", write_failed, out["failed"], f"{path}/failed")
    if "runs" in out:
        put("runs", write_runs, out["runs"], f"{path}/runs")
    return done


def write_run(out: dict[str, DataFrame], root: str, run_at, prefix: str = "", output_format: str = "all", started: float | None = None) -> str:
    """Write a run to a folder of its own below ``root`` and return the folder.

    The folder is named by the prefix and the time of the run. The run table comes after the other outputs and names
    them, with the seconds since ``started`` (or the start of writing); the manifest comes last, so a folder without one
    is a run that did not end, and is not read.
    """
    started = time.time() if started is None else started
    spark = out["runs"].sparkSession
    name = spark.range(1).select(output_base(F.lit(prefix), F.lit("analysis"), run_at)).first()[0]
    folder = f"{root.rstrip('/')}/{name}"
    done = write_outputs({k: v for k, v in out.items() if k != "runs"}, folder, run_at, output_format)
    files, seconds = F.array(*[F.lit(f.rsplit("/", 1)[1]) for f in done]), F.lit(round(time.time() - started, 3))
    write_runs(out["runs"].withColumn("output_files", files).withColumn("duration_seconds", seconds), f"{folder}/runs")
    manifest = spark.range(1).select(F.lit(name).alias("name"), F.lit(output_format).alias("format"), F.concat(files, F.array(F.lit("runs"))).alias("outputs"))
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return folder


def complete_runs(spark: SparkSession, root: str) -> list[str]:
    """Folders below ``root`` whose run was written to the end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/manifest/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(f.getPath().getParent().getParent().toString() for f in found)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("name STRING, format STRING, outputs ARRAY<STRING>").json(f"{folder}/manifest")
