"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage of every training document is a query. An item longer than a passage is indexed as overlapping segments, each
so short that a copy of it lies whole in some passage; an item's score is that of its best segment. A score is given as the share of the score that
the segment's own text reaches, so one threshold serves short and long items. The index keeps, for each term, its largest impact on any item and its largest impact in each
block of items. A passage is dropped as soon as the sum of its terms' largest impacts stays under the threshold
(the WAND bound); its pivot then says which terms may open blocks, and the blocks' own largest impacts which of these are read; only
items of blocks that could reach the threshold are scored. No bound is below a score, so every item above the threshold is retrieved.
The passages of a slice of texts are searched together. Retrieved items count if their question and their answer, whole, are found near
the passage in word shingles.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgap.llm import wordhash
from termgap.llm.common import NO_ID, keep, keyed_texts, shown_id, text_hash

K1, B = 1.2, 0.75
PASSAGE, STRIDE = 64, 32
#: Words of a segment of a longer item, and from one segment to the next; any run of so many words lies whole in a passage.
SEGMENT, SEGMENT_STRIDE = PASSAGE - STRIDE, STRIDE // 2
THRESHOLD = 0.5
SHINGLE, OVERLAP = 5, 0.8
ITEM_BLOCK = 16
#: Passages searched together, and cells (passage, block of segments) of them at most: they bound a task's memory only.
STEP_PASSAGES, STEP_CELLS = 4096, 1 << 21
#: Room for rounding in sums of bounds.
SLACK = 1e-7
#: Items of one index at most; a larger benchmark is searched index by index, each small enough to send to every task.
INDEX_ITEMS, INDEX_WORDS = 4096, 1_000_000

FOUND = "doc_id long, h long, item_id long, score double, question_overlap double, answer_overlap double"


def normal_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return wordhash.words(data, np.array([0, len(data)], np.int64), wordhash.MARKS)


def question_and_answer(text: str) -> tuple[str, str]:
    """The part up to the last question mark, answer label or line break that leaves an answer; else all but the last sentence.

    An item that is one sentence is its own question and answer.
    """
    bare = text.strip()
    for pattern in (r"\n\s*(?:answer|a)\s*:", r"\?", r"\n", r"[.!]\s"):
        cuts = [m.end() for m in re.finditer(pattern, bare, re.IGNORECASE)]
        for cut in reversed(cuts):
            if len(normal_words(bare[:cut])[0]) and len(normal_words(bare[cut:])[0]):
                return bare[:cut], bare[cut:]
    return bare, bare


def shingles(hashes: np.ndarray) -> np.ndarray:
    return np.unique(wordhash.runs(hashes, min(SHINGLE, max(1, len(hashes)))))


def segments(words: np.ndarray) -> list[np.ndarray]:
    """The item itself if it fits a passage, else its overlapping segments; the last one ends with the item."""
    if len(words) <= PASSAGE:
        return [words]
    starts = [*range(0, len(words) - SEGMENT, SEGMENT_STRIDE), len(words) - SEGMENT]
    return [words[a : a + SEGMENT] for a in starts]


class Index:
    """Impacts of terms on segments of items, as shares of each segment's own score, by blocks of segments."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[int, int], n_items: int, mean_words: float):
        self.items = items
        self.words = [normal_words(t)[0] for _, t in items]
        self.parts = [tuple(shingles(normal_words(p)[0]) for p in question_and_answer(t)) for _, t in items]
        self.sizes = [min(SHINGLE, max(1, len(normal_words(p)[0]))) for _, t in items for p in question_and_answer(t)]
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        parted = [(i, s) for i, words in enumerate(self.words) for s in segments(words)]
        self.owner = np.array([i for i, _ in parted], np.int64)  # number of each segment's item
        for i, (_, words) in enumerate(parted):
            terms, tf = np.unique(words, return_counts=True)
            idf = np.log1p([(n_items - df[int(t)] + 0.5) / (df[int(t)] + 0.5) for t in terms])
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / max(mean_words, 1.0)))
            for t, x in zip(terms.tolist(), (impact / max(impact.sum(), 1e-12)).tolist()):
                postings[t].append((i, x))
        self.terms = np.array(sorted(postings), np.uint64)
        self.n_blocks = -(-len(parted) // ITEM_BLOCK)
        # postings of a term lie in order of segments, hence of blocks
        lists = [postings[int(t)] for t in self.terms]
        self.starts = np.cumsum([0, *map(len, lists)])
        self.item = np.array([i for p in lists for i, _ in p], np.int32)
        self.impact = np.array([x for p in lists for _, x in p], np.float64)
        self.largest = np.array([max(x for _, x in p) for p in lists], np.float64)
        block = self.item // ITEM_BLOCK
        head = np.flatnonzero(np.diff(block, prepend=-1) | np.isin(np.arange(len(block)), self.starts[:-1]))
        self.block_of, self.block_max = block[head], np.maximum.reduceat(self.impact, head) if len(head) else self.impact
        self.block_starts = np.searchsorted(head, self.starts)
        self.heads = np.append(head, len(block))

    def term_ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    @staticmethod
    def _rows(starts: np.ndarray, lists: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the lists, and what `of` says of each entry's list."""
        a, n = starts[lists], starts[lists + 1] - starts[lists]
        return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(of, n)

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All (item number, score of its best segment) with a score of the threshold or more for a passage's distinct terms."""
        best: dict[int, float] = {}
        for segment, score in zip(*self.search_passages(np.zeros(len(terms), np.int64), terms, 1, threshold)[1:]):
            best[int(self.owner[segment])] = max(best.get(int(self.owner[segment]), 0.0), float(score))
        return list(best.items())

    def search_passages(self, passage: np.ndarray, terms: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, segment, score) of every score of the threshold or more, for `n` passages given as distinct (passage, term) pairs in order.

        The terms of a passage, in order of their largest impacts, have a pivot: those before it stay under the threshold together, so a
        segment needs one from the pivot on. Blocks are opened by these alone, the others counted at their largest; lists of the terms before the
        pivot, which are the long ones, are read only for passages with an open block.
        """
        enough = threshold - SLACK
        order = np.lexsort((self.largest[terms], passage))
        sums = np.concatenate(([0.0], np.cumsum(self.largest[terms[order]])))
        heads = np.searchsorted(passage, np.arange(n + 1))
        leads = np.zeros(len(terms), bool)
        leads[order] = sums[1:] - sums[heads[passage]] >= enough
        spare = np.bincount(passage[~leads], self.largest[terms[~leads]], n)  # of the terms before the pivot
        at, of = self._rows(self.block_starts, terms[leads], passage[leads])
        bounds = np.bincount(of * self.n_blocks + self.block_of[at], self.block_max[at], n * self.n_blocks).reshape(n, -1)
        left = ((bounds > 0) & (bounds + spare[:, None] >= enough)).any(axis=1)[passage]
        passage, terms = passage[left], terms[left]
        at, of = self._rows(self.block_starts, terms, passage)
        cells = of * self.n_blocks + self.block_of[at]
        open_ = np.bincount(cells, self.block_max[at], n * self.n_blocks)[cells] >= enough
        at, of = self._rows(self.heads, at[open_], of[open_])
        keys, inverse = np.unique(of * len(self.owner) + self.item[at], return_inverse=True)
        scores = np.bincount(inverse, self.impact[at], len(keys))
        good = scores >= threshold - 1e-9
        return keys[good] // len(self.owner), keys[good] % len(self.owner), scores[good]


def _passages(index: Index, ids: np.ndarray, cuts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of the passages of all rows whose known words could reach the threshold; row k has the words from cuts[k] to cuts[k + 1].

    A repeated word counts again in this bound, so it is no smaller than the bound over distinct words.
    """
    size = np.diff(cuts)
    n = np.where(size > 0, -(-np.maximum(1, size - PASSAGE + STRIDE) // STRIDE), 0)
    row = np.repeat(np.arange(len(size)), n)
    starts = cuts[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    ends = np.minimum(starts + PASSAGE, cuts[row + 1])
    bound = np.concatenate(([0.0], np.cumsum(np.where(ids >= 0, index.largest[ids], 0.0))))
    open_ = bound[ends] - bound[starts] >= threshold - SLACK
    return row[open_], starts[open_], ends[open_]


def _terms(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (number of the passage, known term), in order."""
    size = ends - starts
    passage = np.repeat(np.arange(len(starts)), size)
    found = ids[np.arange(len(passage)) + np.repeat(starts - np.cumsum(size) + size, size)]
    keys = np.sort((passage * n_terms + found)[found >= 0])
    keys = keys[np.diff(keys, prepend=-1) > 0]
    return keys // n_terms, keys % n_terms


def search_rows(index: Index, hashes: np.ndarray, ids: np.ndarray, cuts: np.ndarray, threshold: float, overlap: float) -> list[tuple]:
    """(row, item_id, score, question overlap, answer overlap) of the items verified in each row of a slice, all passages of it at once."""
    row, starts, ends = _passages(index, ids, cuts, threshold)
    step = max(1, min(STEP_PASSAGES, STEP_CELLS // max(1, index.n_blocks)))
    best: dict[tuple[int, int], tuple] = {}
    for at in range(0, len(row), step):
        a, e = starts[at : at + step], ends[at : at + step]
        passage, segment, scores = index.search_passages(*_terms(ids, a, e, len(index.terms)), len(a), threshold)
        retrieved: dict[tuple[int, int], float] = {}
        for p, i, score in zip(passage.tolist(), index.owner[segment].tolist(), scores.tolist()):
            retrieved[p, i] = max(retrieved.get((p, i), 0.0), score)
        for (p, i), score in retrieved.items():
            k = int(row[at + p])
            reach = len(index.words[i])
            around = hashes[max(cuts[k], a[p] - reach) : min(cuts[k + 1], e[p] + reach)]
            shares = []
            for part, size in zip(index.parts[i], index.sizes[2 * i : 2 * i + 2]):
                shares.append(float(np.isin(part, wordhash.runs(around, size)).mean()) if len(part) else 0.0)
            if min(shares) >= overlap:
                found = (score, *shares)
                best[k, i] = max(best.get((k, i), found), found)
    return [(k, index.items[i][0], *x) for (k, i), x in sorted(best.items())]


def search_document(index: Index, hashes: np.ndarray, ids: np.ndarray, threshold: float, overlap: float) -> list[tuple]:
    """(item_id, score, question overlap, answer overlap) of the items verified in one document."""
    return [x[1:] for x in search_rows(index, hashes, ids, np.array([0, len(ids)]), threshold, overlap)]


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, text and a key of both, once each: texts without id, or several under one id, are items of their own. Null texts are left out."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return items.withColumn("key", F.xxhash64("item_id", "text"))


def _statistics(items: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of items, mean words, and for each term the number of items that hold it, over the whole benchmark."""

    def count(batches):
        for batch in batches:
            ids, terms, sizes = [], [], []
            for i, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                words = normal_words(t)[0]
                distinct = np.unique(words).view(np.int64).tolist()
                ids += [i] * (len(distinct) + 1)
                terms += [None, *distinct]
                sizes += [len(words)] + [0] * len(distinct)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "term", "n"])

    rows = keep(items.mapInArrow(count, "key long, term long, n long"), "item-terms")
    n, mean = rows.filter("term IS NULL").agg(F.count("*"), F.avg("n")).first()
    return n, float(mean or 0.0), rows


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score (best passage), question_overlap, answer_overlap.

    The benchmark is indexed in parts of at most 4,096 items and about a million words, each sent to the tasks as a whole;
    documents are never shuffled. Null ids of documents and items stay null; null, empty and blank texts hold nothing; repeated documents
    are reported each; of items repeated with id and text one counts, different texts under one id are found each; empty tables give no
    rows; other columns are ignored.
    """
    return _found(docs, benchmark, threshold, overlap).drop("h")


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """As `contaminated`, with the hash h of the document's text."""
    spark = docs.sparkSession
    items = keep(item_table(benchmark), "items")
    n_items, mean_words, item_terms = _statistics(items)
    parts = max(1, -(-n_items // INDEX_ITEMS), int(-(-n_items * mean_words // INDEX_WORDS)))
    df_all = item_terms.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    df_all = keep(df_all, "item-df")
    out = None
    for part in range(parts):
        mine = F.pmod(F.xxhash64("key"), F.lit(parts)) == part
        held = sorted(((r.item_id, r.text) for r in items.filter(mine).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        counts = item_terms.filter("term IS NOT NULL").filter(mine).select("term").distinct().join(df_all, "term").collect()
        df = {r.term & 0xFFFFFFFFFFFFFFFF: r.df for r in counts}
        held = [(i, t) for i, t in held if len(normal_words(t)[0])]
        if not held:
            continue
        index = spark.sparkContext.broadcast(Index(held, df, n_items, mean_words))
        rows = keyed_texts(docs).select("doc_id", "h", F.lower("text").alias("text")).mapInArrow(_searcher(index, threshold, overlap), FOUND)
        out = rows if out is None else out.union(rows)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    return out.select(shown_id(), "h", "item_id", "score", "question_overlap", "answer_overlap")


def _searcher(index, threshold: float, overlap: float):
    def search(batches):
        held = index.value
        for batch in batches:
            ids = list(zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()))
            out: list[tuple] = []
            for first, n, data, offsets in wordhash.slices(batch.column("text")):
                hashes, row = wordhash.words(data, offsets, wordhash.MARKS)
                terms = held.term_ids(hashes)
                cuts = np.searchsorted(row, np.arange(n + 1))
                out += [(*ids[first + k], *x) for k, *x in search_rows(held, hashes, terms, cuts, threshold, overlap)]
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    return search


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in whose own text no test item was found, with their own columns."""
    found = _found(docs, benchmark).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_found"), F.col("h").alias("_h")).distinct()
    mine = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.join(keep(found, "contaminated"), (mine == F.col("_found")) & (text_hash() == F.col("_h")), "left_anti")
