"""WARC archives: writing with identical-payload revisits, and reading in splits with boundary-chain verification.

A record is written as one string that ends with the writer's line separator, so Spark's text sink commits whole archives
and no task touches a file by itself. The reader cuts the files at the magic `WARC/1.`, which also occurs inside payloads:

1. `scan`: the tasks take each place after a magic as a candidate record and emit its offset and its successor's (where the
   next record has to start), both counted from the split's first magic. Each task follows the successors inside its
   split, so a candidate also knows where its chain leaves the split, and the last record before that.
2. `chains`: sums of the splits' sizes turn these into offsets of the file, and pointer jumping from the file's start
   over the splits finds the candidate that each split is really entered at. Magic inside a payload is on no such chain.
3. `read_warc`: the tasks read their splits again, start at their entry and return the records of the chain. A record
   whose payload runs on into later splits, as only payloads with magic inside do, is put together from its pieces.

The driver sees counts. Payloads are not shuffled, but for the pieces of step 3.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termgap.llm.common import keep
from termgap.session import lookup_side

MAGIC = b"WARC/1."
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-page:{}>"
#: Splits whose entries are broadcast (32 bytes each); for more, the rows are dealt out by split instead.
MAX_BROADCAST_SPLITS = 1_000_000
BATCH_BYTES = 1 << 22
PIECE = "file string, offset long, part long, whole boolean, headers map<string,string>, http string, payload binary"

_LENGTH = re.compile(rb"\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r?(?=\n|$)", re.I)


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a string's or binary's bytes in upper-case base32: 5 hexadecimal digits make 4 of base32."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    """A header line; none for null. Line ends inside a value are escaped, as they would begin another field."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    before, after = RECORD_ID.split("{}")
    return F.concat(F.lit(before), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(after))


def page_of(urn: Column) -> Column:
    """The page_id that a record id of `write_warc` stands for."""
    return F.regexp_extract(urn, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def _record(date: str) -> Column:
    """The bytes of a record up to its closing line ends, from id, url, html, digest, first (null for a response) and again."""
    revisit = F.col("again")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.col("id"))),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Profile", F.when(revisit, PROFILE)),
        _field("WARC-Refers-To", F.when(revisit & F.col("first").isNotNull(), _urn(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    return F.concat(head, F.octet_length(block).cast("string"), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, date: str, min_bytes: int = 0) -> None:
    """Write a record for each row of `pages` (page_id, url, html), payload html in UTF-8, as archives below `path`.

    Of rows with equal payloads (by SHA-1) of at least `min_bytes` bytes, that with the smallest page_id, then url, is a
    response; the others are revisits that refer to it and hold no payload. Payloads stay where they are: only digests are
    shuffled, and rows that share none are not looked up unless the shared digests are too many to broadcast.

    Null html is an empty payload; a null url has no target; rows without id come after all others, and a revisit of one
    of them refers to nothing. Of rows equal in page_id, url and html one is a response. An empty table gives an empty
    archive; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html")))
    long_enough = F.octet_length("html") >= min_bytes
    equal = rows.filter(long_enough).groupBy("digest", "id", "url").agg(F.count("*").alias("m"))
    first = equal.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "url", "m")).alias("at"), F.sum("m").alias("n")).filter("n > 1")
    first = keep(first.select("digest", F.col("at.id").alias("first"), F.col("at.url").alias("first_url"), F.col("at.m").alias("m"), F.lit(True).alias("shared")), "payload-firsts")
    dealt = rows.join(lookup_side(first), "digest", "left").withColumn("shared", F.coalesce("shared", F.lit(False)) & long_enough)
    is_first = F.col("id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    tied = F.col("shared") & is_first & (F.col("m") > 1)
    out = dealt.filter(~tied).withColumn("again", F.col("shared") & ~is_first)
    if first.filter("m > 1").limit(1).count():  # equal rows: one of them is the response
        same = dealt.filter(tied).groupBy("digest", "id", "url", "first").agg(F.first("html").alias("html"), F.count("*").cast("int").alias("m"))
        same = same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m")))).withColumn("again", F.col("copy") > 1)
        out = out.select("id", "url", "html", "digest", "first", "again").unionByName(same.select("id", "url", "html", "digest", "first", "again"))
    out.select(_record(date).alias("value")).write.option("lineSep", END).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the split) and value (what stands between two magics) of every chunk, in order within a split."""
    rows = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches, *cols):
    """Consecutive runs of rows of one split: (file, block, iterator over the rows' `cols`)."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), *(batch.column(c).to_pylist() for c in cols))

    for (file, block), run in groupby(rows(), key=lambda r: r[:2]):
        yield file, block, (r[2:] for r in run)


def _span(head: bytes | None) -> int | None:
    """Bytes of a record from its magic to its successor, from its head without magic; None if that is no record's head."""
    if not head or head[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    length = _LENGTH.search(head)
    return length and len(MAGIC) + len(head) + 4 + int(length[1]) + 4


def scan(chunks: DataFrame) -> DataFrame:
    """file, block, total, at, succ, exit, last: a row for each candidate, and one for each split with its total and at null.

    Offsets count from the split's first magic. exit: the first offset on the candidate's chain past the split, null if
    the chain breaks inside; last: the chain's last record before that.
    """
    head = F.when(F.contains("value", F.lit(END)), F.substring_index("value", END, 1)).cast("binary").alias("head")

    def read(batches):
        for file, block, rows in _by_split(batches, "size", "head"):
            at, found = (0, {}) if block else (-len(MAGIC), {})
            for size, top in rows:
                span = _span(top) if at >= 0 else None
                if span is not None:
                    found[at] = at + span
                at += len(MAGIC) + size
            leave: dict[int, tuple] = {}
            for k in reversed(found):
                leave[k] = (found[k], k) if found[k] >= at else leave.get(found[k], (None, None))
            table = {"at": [*found, None], "succ": [*found.values(), None], "exit": [leave[k][0] for k in found] + [None], "last": [leave[k][1] for k in found] + [None]}
            n = len(found) + 1
            cols = [pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array([at] * n, pa.int64()), *(pa.array(table[c], pa.int64()) for c in table)]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "block", "total", *table])

    heads = chunks.select("file", "block", F.octet_length("value").alias("size"), head)
    return heads.mapInArrow(read, "file string, block long, total long, at long, succ long, exit long, last long")


def chains(found: DataFrame) -> DataFrame:
    """file, block, base (offset of the split's first magic), entry (first real record in it) and owner (real record before that).

    found: as from `scan`. Reached nodes and jumps are written tables; after k rounds the nodes less than 2^k splits from the
    file's start are known, and jumps that leave the file are gone.
    """
    order = Window.partitionBy("file").orderBy("block")
    splits = found.filter("at IS NULL").select("file", "block", "total")
    splits = keep(splits.withColumn("base", F.sum("total").over(order) - F.col("total")), "splits")
    of = found.filter("at IS NOT NULL").join(splits.select("file", "block", "base"), ["file", "block"])
    of = of.select("file", "block", *[(F.col("base") + F.col(c)).alias(c) for c in ("at", "exit", "last")])
    nodes = of.select("file", F.col("exit").alias("at")).distinct()
    entries = keep(of.filter("at = 0").unionByName(of.filter("at > 0").join(nodes, ["file", "at"], "left_semi")), "entries")
    reached = entries.filter("at = 0").select("file", "at")
    jump = entries.join(entries.select("file", F.col("at").alias("exit")), ["file", "exit"], "left_semi").select("file", "at", F.col("exit").alias("to"))
    jump = keep(jump, "jump")
    while jump.limit(1).count():
        reached = keep(reached.union(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "reached")
        jump = keep(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("next")), ["file", "to"]).select("file", "at", F.col("next").alias("to")), "jump")
    real = entries.join(reached, ["file", "at"])
    known = splits.join(real.select("file", "block", F.col("at").alias("entry"), "last"), ["file", "block"], "left")
    ends = F.when(F.col("entry").isNotNull(), F.coalesce("last", F.lit(-1)))  # -1: the chain breaks in this split
    owner = F.last(ends, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return keep(known.select("file", "block", "base", "entry", F.nullif(owner, F.lit(-1)).alias("owner")), "chains")


def _fields(raw: bytes) -> list[tuple[str, str]]:
    """Header fields, names in lower case; of repeated ones the last."""
    lines = (line.partition(b":") for line in raw.split(b"\r\n")[1:])
    return list({k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, sep, v in lines if sep}.items())


def _parted(raw: bytes) -> tuple | None:
    """(headers, http, payload) of a record's bytes after its magic; None if they end too early."""
    span = _span(head := raw.partition(b"\r\n\r\n")[0])
    if span is None or len(raw) < span - len(MAGIC) - 4:
        return None
    headers, block = _fields(head), raw[len(head) + 4 : span - len(MAGIC) - 4]
    if not dict(headers).get("content-type", "").startswith("application/http"):
        return headers, None, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http.decode("utf-8", "replace"), payload


_TYPES = {"file": pa.string(), "offset": pa.int64(), "part": pa.int64(), "whole": pa.bool_(), "headers": pa.map_(pa.string(), pa.string()), "http": pa.string(), "payload": pa.binary()}


def _batches(rows, *names):
    """Arrow batches of a stream of tuples, the payload last, about BATCH_BYTES or one row each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 256
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for n, c in zip(names, zip(*held))], names=list(names))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for n, c in zip(names, zip(*held))], names=list(names))


def _records(file, record, start, held, whole):
    """The row of a record that lies whole in a split, or of the piece of one that does not."""
    if record is not None and held:
        raw = b"".join(held)
        parts = _parted(raw[len(MAGIC) :]) if whole else (None, None, raw)
        if parts:
            yield file, record, start, whole, *parts


def _walked(batches):
    for file, block, run in _by_split(batches, "value", "base", "entry", "owner"):
        at = None
        for value, base, entry, owner in run:
            if at is None:
                next_ = float("inf") if entry is None else entry
                record, start, held = (owner if block else None), base, []  # what comes before the entry belongs to the owner
                at = base if block else -len(MAGIC)
            if at >= next_:
                yield from _records(file, record, start, held, start == record)
                span = _span(value.partition(b"\r\n\r\n")[0]) if at == next_ else None
                record, start, held = (None if span is None else at), at, []
                next_ = float("inf") if span is None else at + span
            if record is not None and at >= 0:
                held.append(MAGIC + value)
            at += len(MAGIC) + len(value)
        yield from _records(file, record, start, held, start == record and at >= next_ - 4)


def _walk(batches):
    """Rows of PIECE: the records of each split's chain, and unparsed pieces of records that pass a split's end."""
    yield from _batches(_walked(batches), *_TYPES)


def _stitch(batches):
    def rows():
        for batch in batches:
            for file, offset, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "raw"))):
                if parts := _parted(raw[len(MAGIC) :]):
                    yield file, offset, *parts

    yield from _batches(rows(), "file", "offset", "headers", "http", "payload")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, headers (names in lower case), http (head of an HTTP block) and payload of every record below `path`.

    Only records on the chain from a file's start count, so magic inside payloads makes none. A file that does not begin
    with a record gives none; a chain that breaks ends there, and a record that the file's end cuts off is not returned.
    Records of no HTTP type have their whole block as payload. Files may be of any size and bytes, but not compressed.
    """
    chunks = _chunks(spark, path)
    where = chains(keep(scan(chunks), "candidates"))
    key = F.xxhash64("file", "block").alias("split")
    small = where.select(key, "base", "entry", "owner")
    rows = chunks.withColumn("split", key).withColumn("value", F.col("value").cast("binary"))
    if where.count() <= MAX_BROADCAST_SPLITS:
        rows = rows.join(F.broadcast(small), "split")
    else:
        rows = rows.withColumn("nth", F.monotonically_increasing_id()).join(small.hint("shuffle_hash"), "split").repartition("split").sortWithinPartitions("split", "nth")
    pieces = rows.select("file", "block", "value", "base", "entry", "owner").mapInArrow(_walk, PIECE)
    found = pieces.filter("whole").select("file", "offset", "headers", "http", "payload")
    passing = where.filter("owner IS NOT NULL AND (entry IS NULL OR entry > base)")
    if passing.limit(1).count():
        open_ = pieces.filter("NOT whole").groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("part", "payload"))).alias("p"))
        open_ = open_.filter(F.col("p")[0]["part"] == F.col("offset"))
        raw = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["payload"])).alias("raw")
        found = found.union(open_.select("file", "offset", raw).mapInArrow(_stitch, "file string, offset long, headers map<string,string>, http string, payload binary"))
    return found
