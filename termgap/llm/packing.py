"""Best-fit packing of documents into fixed-size sequences under source and duplicate-cluster conflicts."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgap.llm.common import BLANKS, NO_ID, WORD, texts

CAPACITY = 2048
#: Documents of one source that a bin takes.
SOURCE_LIMIT = 2
#: Documents that one task packs; the number of shards follows the input.
SHARD_DOCS = 20_000

OUT = "doc_id long, piece int, start long, n_words long, bin_id long, bin_offset long"


class Bins:
    """Open bins ordered by residual space, each with bitmaps of the sources and duplicate clusters that it can't take again.

    Bins of one residual are kept by source bitmap, so a conflict with a full source is seen once for all of them.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_residual: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.occupied = 0  # bit r is set if a bin has r left
        self.residual: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[dict[int, int]] = []

    def _add(self, b: int, full: int) -> None:
        r = self.residual[b]
        if r:
            self.by_residual[r].setdefault(full, []).append(b)
            self.occupied |= 1 << r

    def place(self, size: int, source: int, cluster: int, limit: int) -> tuple[int, int]:
        """The tightest compatible bin, or a new one, and the offset in it. source: a number; cluster: a bit or 0."""
        bit = 1 << source
        rest = self.occupied >> size << size
        while rest:
            r = (rest & -rest).bit_length() - 1
            held = self.by_residual[r]
            for full, bins in held.items():
                if full & bit:
                    continue
                for k, b in enumerate(bins):
                    if self.clusters[b] & cluster:
                        continue
                    del bins[k]
                    if not bins:
                        del held[full]
                        if not held:
                            self.occupied ^= 1 << r
                    return self._put(b, size, source, cluster, limit, full), self.capacity - r
            rest ^= 1 << r  # the successor: the next larger residual
        self.residual.append(self.capacity)
        self.clusters.append(0)
        self.sources.append({})
        return self._put(len(self.residual) - 1, size, source, cluster, limit, 0), 0

    def _put(self, b: int, size: int, source: int, cluster: int, limit: int, full: int) -> int:
        self.residual[b] -= size
        self.clusters[b] |= cluster
        n = self.sources[b][source] = self.sources[b].get(source, 0) + 1
        self._add(b, full | (1 << source if n >= limit else 0))
        return b


def pack_shard(rows: list[tuple], capacity: int, limit: int) -> list[tuple]:
    """rows: (doc_id, n_words, source, cluster). Longest first, ties by doc_id; whole capacities of a long document are bins of their own."""
    numbers: dict = {}
    copies = Counter(r[3] for r in rows)
    bits: dict = {}
    out, bins, whole = [], Bins(capacity), []
    tails = []
    for doc, n, source, cluster in rows:
        full, tail = divmod(n, capacity)
        whole += [(doc, i, i * capacity, capacity) for i in range(full)]
        if tail:
            tails.append((tail, doc, source, cluster, full))
    for tail, doc, source, cluster, full in sorted(tails, key=lambda x: (-x[0], x[1])):
        bit = 1 << bits.setdefault(cluster, len(bits)) if copies[cluster] > 1 else 0
        b, at = bins.place(tail, numbers.setdefault(source, len(numbers)), bit, limit)
        out.append((doc, full, full * capacity, tail, b, at))
    return out + [(*x, len(bins.residual) + i, 0) for i, x in enumerate(whole)]


def best_fit(docs: DataFrame, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pieces (doc_id, piece, start, n_words, bin_id, bin_offset) of every document of `docs` (doc_id, text, source).

    A bin holds at most `capacity` words, one document of a duplicate cluster (same words but for case and spacing) and
    `source_limit` documents of a source. A document longer than a bin fills whole bins and its rest is packed with others.
    Documents are dealt to shards by hash, about `shard_docs` each and as many shards as the input needs, so a source or
    cluster with a third of all rows is spread over all shards. Only lengths and hashes are shuffled.

    Null ids stay null; null, empty and blank texts have nothing to pack and get one row with a null bin; a null source is
    a source of its own; repeated rows are one cluster, so they lie in different bins; an empty table gives no rows; other
    columns are ignored.
    """
    n_shards = max(1, -(-docs.count() // shard_docs))
    folded = F.xxhash64(F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " ")))
    rows = texts(docs, F.coalesce("source", F.lit("")).alias("source")).select(
        "doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.xxhash64("source").alias("source"), folded.alias("cluster"),
        F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_shards)).alias("shard"),
    )

    def pack(key, pdf):
        order = pdf.sort_values(["doc_id", "cluster", "n_words"], kind="stable")
        got = pack_shard(list(zip(*(order[c].tolist() for c in ("doc_id", "n_words", "source", "cluster")))), capacity, source_limit)
        frame = pd.DataFrame(got, columns=["doc_id", "piece", "start", "n_words", "bin_id", "bin_offset"])
        frame["bin_id"] += int(key[0]) << 32
        return frame

    packed = rows.filter("n_words > 0").groupBy("shard").applyInPandas(pack, OUT)
    none = F.lit(None).cast("long")
    empty = texts(docs).filter(F.length(F.translate("text", BLANKS, "")) == 0).select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long"), F.lit(0).cast("long"), none, none)
    return packed.union(empty).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
