"""Substring dedup by Relative Lempel-Ziv parsing against every earlier text of the corpus.

The corpus is its own reference. It is cut into reference blocks by content: each window of words belongs to the block of
its anchor, the smallest hash of the shorter word runs inside it. A block's index holds all windows of its anchors with their
places, so a document is factored against every block in which a factor long enough can lie, wherever that text stands. The windows
of a document that an earlier place holds are joined greedily into factors that follow one place; a factor starts or
ends inside a window of another, so boundaries are checked window by window and no repeat that straddles them is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgap.llm import wordhash
from termgap.llm.common import keep, numbered, shown_id, texts

WINDOW, ANCHOR = 20, 8
#: Anchors with more places than this, and than 1/100,000 of all, are hot: their windows are dealt out one by one.
HOT_PLACES, HOT_SHARE = 1000, 100_000
HASH_BYTES = 5

WINDOWS = "key long, doc_id long, at int, n int, hashes binary, ref_doc long, ref_at int"
PIECES = "doc_id long, start int, n_words int, ref_doc_id long, ref_start int"


def _windows(column):
    """For each slice: rows, places in the row and windows' hashes, and for each window the index and hash of its anchor."""
    for first, _, data, offsets in wordhash.slices(column):
        hashes, row = wordhash.words(data, offsets)
        n = len(hashes) - WINDOW + 1
        if n <= 0:
            continue
        own = row[WINDOW - 1 :] == row[:n]
        if not own.any():
            continue
        short = wordhash.runs(hashes, ANCHOR)
        near = np.lib.stride_tricks.sliding_window_view(short, WINDOW - ANCHOR + 1)
        anchor = np.arange(n) + near.argmin(axis=1)
        begin = np.searchsorted(row, np.arange(row[-1] + 1))
        at = np.flatnonzero(own)
        yield first + row[at], at - begin[row[at]], wordhash.runs(hashes, WINDOW)[at], anchor[at], short[anchor[at]].view(np.int64)


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Hashes of the anchors with so many places that a task should not get them all; 100,000 at most.

    Only decides to which task windows go, never which windows are found.
    """

    def count(batches):
        seen, total = [], 0
        for batch in batches:
            for _, _, _, anchor, seed in _windows(batch.column("text")):
                mine = seed[np.flatnonzero(np.diff(anchor, prepend=-1))]
                seen.append(mine)
                total += len(mine)
        seeds, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        often = n > 1  # a hot anchor is met often in a task
        yield pa.RecordBatch.from_arrays([pa.array([None, *seeds[often]], pa.int64()), pa.array([total, *n[often]], pa.int64())], names=["seed", "n"])

    counts = keep(texts(docs).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")), "anchors")
    total = counts.filter("seed IS NULL").agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("seed").isNotNull() & (F.col("n") > max(HOT_PLACES, total // HOT_SHARE)))
    return np.array(sorted(r.seed for r in hot.select("seed").collect()), np.int64)


def _five(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _is_in(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def _indexed(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Index entries: the windows of one anchor in a row, or a hot anchor's windows one by one.

    A hot window that this task has seen at an earlier place is resolved here, so a task sends each of them about once.
    """
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32()]

    def entries(batches):
        least: dict[int, tuple[int, int]] = {}
        for batch in batches:
            batch = pa.Table.from_batches([batch]).sort_by("doc_id").combine_chunks().to_batches()[0] if batch.num_rows else batch
            ids = batch.column("doc_id").to_numpy()
            for row, at, hashes, anchor, seed in _windows(batch.column("text")):
                doc, busy = ids[row], _is_in(seed, hot)
                starts = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 1))
                lengths = np.diff(np.append(starts, len(row)))
                cold = ~busy[starts]
                raw, cuts = _five(hashes), (starts * HASH_BYTES).tolist()
                parts = [raw[a : a + n * HASH_BYTES] for a, n, c in zip(cuts, lengths.tolist(), cold) if c]
                s = starts[cold]
                columns = [[seed[s]], [doc[s]], [at[s]], [lengths[cold]], parts, [np.zeros(len(s), np.int64)], [np.zeros(len(s), np.int64)]]
                for i in np.flatnonzero(busy).tolist():
                    key, place = int(hashes[i].view(np.int64)), (int(doc[i]), int(at[i]))
                    held = least.get(key)
                    one = raw[i * HASH_BYTES : (i + 1) * HASH_BYTES]
                    if held is None or place < held:
                        least[key] = held = place
                    elif place > held:
                        one = None  # resolved: an earlier place is known
                    ref = held if one is None else (0, 0)
                    to = key if one is not None else hash(place)  # a resolved window meets no other: any task will do
                    for c, v in zip(columns, (to, place[0], place[1], 1, one, *ref)):
                        c.append(v)
                arrays = []
                for k, (c, kind) in enumerate(zip(columns, kinds)):
                    if k == 4:
                        arrays.append(pa.array(c, kind))
                    else:
                        arrays.append(pa.array(np.concatenate([c[0], np.array(c[1:], np.int64)]).astype(np.int64)).cast(kind))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return texts(docs).mapInArrow(entries, WINDOWS)


def _joined(doc, at, ref_doc, ref_at) -> pa.RecordBatch:
    """Repeated windows in order of place, joined while they follow each other and their source."""
    new = (np.diff(doc, prepend=doc[:1] - 1) != 0) | (np.diff(at, prepend=-9) != 1) | (np.diff(ref_doc, prepend=ref_doc[:1] - 1) != 0) | (np.diff(ref_at, prepend=-9) != 1)
    s = np.flatnonzero(new)
    n = np.diff(np.append(s, len(doc))) + WINDOW - 1
    cells = (doc[s], at[s], n, ref_doc[s], ref_at[s])
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(k) for c, k in zip(cells, kinds)], names=[c.split()[0] for c in PIECES.split(", ")])


def pieces(docs: DataFrame) -> DataFrame:
    """Runs of repeated windows (doc_id, start, n_words, ref_doc_id, ref_start): the same words start earlier at the reference."""

    def resolve(batches):
        held = []
        for batch in batches:
            done = batch.column("hashes").is_null().to_numpy(zero_copy_only=False)
            part = {c: batch.column(c).to_numpy() for c in ("key", "doc_id", "at", "n", "ref_doc", "ref_at")}
            if done.any():
                yield _joined(*(part[c][done].astype(np.int64) for c in ("doc_id", "at", "ref_doc", "ref_at")))
            if not done.all():
                hashes = b"".join(batch.column("hashes").drop_null().to_pylist())
                held.append([*(part[c][~done].astype(np.int64) for c in ("key", "doc_id", "at", "n")), hashes])
        if not held:
            return
        key, doc, at, n = (np.concatenate([h[i] for h in held]) for i in range(4))
        raw = np.frombuffer(b"".join(h[4] for h in held), np.uint8).reshape(-1, HASH_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :HASH_BYTES] = raw
        entry = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        h = wordhash.mixed(key.view(np.uint64)[entry] ^ wordhash.mixed(wide.view("<u8").ravel()))
        doc, at = doc[entry], at[entry] + step
        order = np.lexsort((at, doc, h))
        lead = np.diff(h[order], prepend=~h[order[:1]]) != 0
        source = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        first = np.empty(len(order), np.int64)
        first[order] = source
        again = np.flatnonzero((doc != doc[first]) | (at != at[first]))
        if len(again):
            yield _joined(doc[again], at[again], doc[first[again]], at[first[again]])

    return _indexed(docs, hot_anchors(docs)).repartition("key").mapInArrow(resolve, PIECES)


def parse(found: list[dict]) -> list[list[int]]:
    """Greedy factors [start, end, ref_doc_id, ref_start] from a document's pieces: the longest at each place, continued while the source goes on."""
    factors: list[list[int]] = []
    for p in sorted(found, key=lambda p: (p["start"], -p["n_words"])):
        start, end, ref, ref_start = p["start"], p["start"] + p["n_words"], p["ref_doc_id"], p["ref_start"]
        last = factors[-1] if factors else None
        if last and start <= last[1] and ref == last[2] and ref_start - start == last[3] - last[0]:
            last[1] = max(last[1], end)
        elif not last or end > last[1]:
            factors.append([start, end, ref, ref_start])
    return factors


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, the text that is left and its factors, for every row of `docs`.

    A word is removed if a window of 20 words around it starts earlier too, in a smaller doc_id or further left in the same
    document. Words left are joined by one space. Windows are told apart by 104 bits of hash.

    Null ids stay null and come before all others; null, empty and blank texts have no words; repeated rows have the same
    places, so neither is earlier and both get the same result; different texts without id, or under one id, are documents
    of their own, in order of a hash; an empty table gives no rows; other columns are ignored.
    """
    docs = numbered(docs)
    spans = pieces(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_words", "ref_doc_id", "ref_start")).alias("pieces"))

    def cut(batches):
        for batch in batches:
            out = [[], [], [], []]
            for k, text in enumerate(batch.column("text")):
                held = text.as_py().encode().split()
                factors = parse(batch.column("pieces")[k].as_py() or [])
                gone = np.zeros(len(held) + 1, np.int64)
                for start, end, _, _ in factors:
                    gone[min(start, len(held))] += 1
                    gone[min(end, len(held))] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                left = [w for w, g in zip(held, gone.tolist()) if not g] if factors else held
                for c, v in zip(out, (len(held), len(held) - len(left), b" ".join(left).decode(), len(factors))):
                    c.append(v)
            arrays = [batch.column("shown"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "text", "n_factors"])

    rows = docs.join(spans, "doc_id", "left")
    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string, n_factors long").select(shown_id(), "n_words", "n_removed", "text", "n_factors")
