"""SimHash near-duplicates: fingerprints, pigeonhole blocks, and groups linked by a small Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgap.llm.common import first_rows, keep, keyed_texts, shown_id
from termgap.llm.components import components

BITS, BLOCKS, MAX_DISTANCE = 64, 5, 2
#: Fingerprints that may meet in a block bucket as pairs; larger buckets are resolved by one-bit variants.
PAIRED = 48
SHINGLE = 3
CHUNK = 1 << 16


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash over the XXH64 (seed 42) of word shingles, A-Z lower-cased; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: only A-Z changes, only ASCII blanks part
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxh64_intdigest(joined, 42)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        places = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in places], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    def make(batches):
        for batch in batches:
            fp = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fp, pa.int64())], names=["doc_id", "h", "fp"])

    return keyed_texts(docs).mapInArrow(make, "doc_id long, h long, fp long")


def _masks() -> list[int]:
    """A mask for each choice of blocks in which close fingerprints agree: with `MAX_DISTANCE` differing bits, all blocks but so many."""
    cuts = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    own = [sum(1 << b for b in range(a, e)) for a, e in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(own, BLOCKS - MAX_DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_DISTANCE


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` at most two bits apart; every pair within two bits is connected by them.

    A fingerprint goes to a bucket for each choice of three of the five blocks; two bits spoil two blocks, so a close pair
    meets in a bucket. Small buckets compare all their pairs. A larger one holds fingerprints that agree in
    the chosen blocks, so a close pair differs in the free bits alone: each fingerprint is filed under itself and under itself with
    one free bit turned, and two of them share a file exactly if they are within two bits. At most 1 + free bits
    fingerprints share one, and each is linked to its smallest.
    """
    masks = _masks()
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)])
    filed = prints.select("fp", F.explode(table).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    big = filed.groupBy("t", "key").count().filter(F.col("count") > PAIRED).select("t", "key")
    big = keep(big, "big-buckets")
    small = filed.join(big, ["t", "key"], "left_anti").groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    pairs = small.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.filter(F.slice("fps", F.col("i") + 2, PAIRED), lambda b: _close(F.col("a"), b))).alias("b"))
    free = [F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS) if not m >> b & 1]) for m in masks]
    turned = filed.join(big, ["t", "key"], "left_semi").select("fp", "t", F.explode(F.element_at(F.array(*free), F.col("t") + 1)).alias("bit")).select("fp", "t", F.col("fp").bitwiseXOR(F.col("bit")).alias("variant"))
    stars = turned.groupBy("t", "variant").agg(F.sort_array(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)
    starred = stars.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, BITS + 1)).alias("b")).filter(_close(F.col("a"), F.col("b")))
    return pairs.union(starred).distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, h, fp, component (its smallest fingerprint) and n_links of every row."""
    rows = keep(fingerprints(docs), "fingerprints")
    prints = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = keep(links(prints), "close")
    # fingerprints are the nodes: ids would tie together all rows without one
    grouped = components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("fp"), "component")
    degree = found.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    of = prints.join(grouped, "fp", "left").join(degree, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    of = keep(of, "print-components")
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = keep(of.join(least, "component").select("fp", "component", "component_id", "n_links"), "component-ids")
    return rows.join(of, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed), component_id (smallest doc_id reachable over close fingerprints) and n_links of every row.

    Exact copies fall together before anything is paired: one row per fingerprint and map task is shuffled. n_links is the
    number of links found for the document's fingerprint. Null ids stay null and are smaller than any other, but do not
    tie rows together; null, empty and blank texts have fingerprint 0 and are linked like any other; repeated rows are
    returned each; an empty table gives no rows; other columns are ignored.
    """
    return _grouped(docs).select(shown_id(), "fp", shown_id("component_id"), "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with the smallest doc_id (then text hash) of their component; among repeated rows one stays."""
    return first_rows(docs, keep(_grouped(docs).select("doc_id", "h", F.col("component").alias("c")), "grouped"))
