"""Token-id files: documents compressed one by one with a shared dictionary, in blocks that hold their own offset index.

A folder holds three tables. `dictionary`: sha256 and bytes of the zstandard dictionary. `blocks`: rows of
(shard, block, local_start, first_doc_id, last_doc_id, doc_ids, offsets, counts, dictionary, payload), where payload
holds the documents' zstandard frames end to end, offsets, counts (ids) and doc_ids index them, and local_start is the
number of ids in the shard's earlier blocks. `shards`: the number of ids before each shard. The index columns are read
without the payload, and a range of doc_id prunes row groups, so a short document costs one block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termgap.llm.bpe import encoder, slices
from termgap.llm.common import shown_id, texts

BLOCKS = (
    "shard int, block int, local_start long, first_doc_id long, last_doc_id long, doc_ids array<long>, offsets array<long>, "
    "counts array<long>, dictionary string, payload binary"
)
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
SAMPLE_CHUNK = 1024


def train_dictionary(docs: DataFrame, tokenizer_path: str, sample_docs: int, dict_bytes: int) -> bytes:
    """A dictionary from serialized id arrays of at most `sample_docs` documents, chosen by hash, 1,024 ids of each at most.

    Only compression depends on it: any dictionary, the empty one too, gives the same ids back.
    """
    import zstandard

    def encode(batches):
        bpe = encoder(tokenizer_path)
        for batch in batches:
            for _, part in slices(batch.column("text"), 64):
                ids = bpe.encode(part)
                yield pa.RecordBatch.from_arrays([pa.array([x[: SAMPLE_CHUNK * 4] for x in ids], pa.binary())], names=["ids"])

    chosen = texts(docs).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs).select("text")
    samples = [bytes(r.ids) for r in chosen.mapInArrow(encode, "ids binary").collect() if r.ids]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, level: int = 1, sample_docs: int = 512, dict_bytes: int = 65_536
) -> None:
    """Encode every whole text, append `end_id`, and write the files in ascending doc_id order (nulls first, ties by text).

    A shard is a range of doc_id and is one task: texts are range-partitioned once, encoded, compressed and written
    there, block by block, so a task holds one block. Lost tasks are written again by the commit protocol.
    Null and empty texts hold the end id alone; repeated rows are written each; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer_path, sample_docs, dict_bytes)
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, bytearray(raw))], "dictionary string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    end = np.array([end_id], dtype="<u4").tobytes()

    def blocks(batches):
        import zstandard

        bpe, press = encoder(tokenizer_path), zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw))
        shard, block, done = TaskContext.get().partitionId(), 0, 0
        ids, offsets, counts, frames, size = [], [], [], [], 0

        def row():
            cells = [[shard], [block], [done], [ids[0]], [ids[-1]], [ids], [offsets], [counts], [name], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.string(), pa.binary()]
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, part in slices(batch.column("text")):
                for k, got in enumerate(bpe.encode(part), at):
                    frame = press.compress(got + end)
                    ids.append(doc_ids[k])
                    offsets.append(size)
                    counts.append(len(got) // 4 + 1)
                    frames.append(frame)
                    size += len(frame)
                    if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        yield row()
                        block, done = block + 1, done + sum(counts)
                        ids, offsets, counts, frames, size = [], [], [], [], 0
        if ids:
            yield row()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_ids")
    )
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("shard", "n_ids", F.coalesce(before, F.lit(0).cast("long")).alias("start")).write.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (little-endian unsigned 32-bit) of all or some documents."""
    table = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if doc_ids is not None:
        wanted = F.lit(False)
        for d in doc_ids:
            wanted = wanted | ((F.col("first_doc_id") <= d) & (F.col("last_doc_id") >= d))
        table = table.filter(wanted)
    held = spark.read.parquet(f"{path}/dictionary").collect()[0]
    raw, name = bytes(held.bytes), held.dictionary
    # one row for each task that wrote, so its size has a bound far below a broadcast's
    starts = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("shard_start"))
    pick = None if doc_ids is None else set(doc_ids)

    def decode(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for r in batch.to_pylist():
                if r["dictionary"] != name:
                    raise ValueError("block was written with another dictionary")
                start, payload = r["start"], r["payload"]
                rows: list[tuple] = []
                for d, at, end, n in zip(r["doc_ids"], r["offsets"], [*r["offsets"][1:], len(payload)], r["counts"]):
                    if pick is None or d in pick:
                        rows.append((d, start, n, unpack.decompress(payload[at:end], max_output_size=4 * n)))
                    start += n
                if rows:
                    cols = list(zip(*rows))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "n_tokens", "ids"])

    out = table.join(F.broadcast(starts), "shard").select(
        "doc_ids", "offsets", "counts", "dictionary", "payload", (F.col("shard_start") + F.col("local_start")).alias("start")
    )
    return out.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary").select(shown_id(), "start", "n_tokens", "ids")
