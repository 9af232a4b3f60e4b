"""Masked pseudo-likelihood of documents under a bidirectional window network, trained in numpy inside Spark tasks.

The network predicts a word from the two words before and the two after it: their embeddings, side by side, go through a tanh
layer, then a softmax over classes and one inside the word's class. The score of a document sums the log-probability of
every word given both sides. Words are hash cells; frequent cells are symbols of their own, others share symbols and are
told apart by their share of the symbol's count, so probabilities add up to one over all cells.

Training visits every document: round by round a disjoint part of the corpus is learned by local steps in each task, and
weights are averaged by the words seen. Counts and averages are summed by Spark; the driver holds one model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgap.llm import wordhash
from termgap.llm.common import keep, shown_id, texts

CELLS = 1 << 18
CLASSES = 64
SYMBOLS = CLASSES * CLASSES
#: Symbols with one cell; the others take the remaining cells by hash.
OWN = 3 * SYMBOLS // 4
SIDE, WIDTH, HIDDEN = 2, 16, 32
#: One in so many words of a document is masked and predicted in training; scoring predicts all.
MASKED = 7
ROUNDS, BATCH, RATE, SEED = 4, 4096, 0.01, 7
EDGE = SYMBOLS  # stands before and after a document
BLOCK = 1 << 14


@dataclass(frozen=True)
class Vocabulary:
    symbol: np.ndarray  # of each cell
    log_share: np.ndarray  # log of the cell's part of its symbol's count


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def cell_counts(docs: DataFrame) -> np.ndarray:
    """Words of all documents by cell: CELLS numbers, whatever the input."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, data, offsets in wordhash.slices(batch.column("text")):
                total += np.bincount(_cells(wordhash.words(data, offsets)[0]), minlength=CELLS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["cell", "n"])

    rows = texts(docs).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """Symbols by rank of count; neighbours in rank share a class. Cells never seen count as one half."""
    order = np.argsort(-counts, kind="stable")
    symbol = OWN + (np.arange(CELLS) * 2654435761 >> 7) % (SYMBOLS - OWN)
    symbol[order[:OWN]] = np.arange(OWN)
    mass = counts + 0.5
    return Vocabulary(symbol.astype(np.int32), np.log(mass / np.bincount(symbol, mass, SYMBOLS)[symbol]))


def initial(counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    vocab = vocabulary(counts)
    prior = np.log(np.bincount(vocab.symbol, counts + 0.5, SYMBOLS)).reshape(CLASSES, CLASSES)
    return {k: v.astype(np.float32) for k, v in {
        "embed": rng.normal(0, 0.1, (SYMBOLS + 1, WIDTH)),
        "mix": rng.normal(0, (2 * SIDE * WIDTH) ** -0.5, (2 * SIDE * WIDTH, HIDDEN)),
        "bias": np.zeros(HIDDEN),
        "classes": np.zeros((HIDDEN, CLASSES)),
        "class_bias": np.log(np.exp(prior).sum(axis=1)),
        "inside": np.zeros((CLASSES, HIDDEN, CLASSES)),
        "inside_bias": prior,
    }.items()}


def contexts(symbols: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The SIDE symbols before and after each word of its own document, EDGE beyond its ends."""
    n = len(symbols)
    out = np.full((n, 2 * SIDE), EDGE, np.int32)
    for k in range(1, SIDE + 1):
        same = row[k:] == row[:-k] if n > k else np.zeros(0, bool)
        if n > k:
            out[k:, SIDE - k] = np.where(same, symbols[:-k], EDGE)
            out[:-k, SIDE + k - 1] = np.where(same, symbols[k:], EDGE)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _forward(w: dict, around: np.ndarray, target: np.ndarray):
    """Rows sorted by the target's class: order, inputs, hidden layer, class probabilities, and probabilities inside the class."""
    group = target // CLASSES
    order = np.argsort(group, kind="stable")
    group, member = group[order], (target % CLASSES)[order]
    x = w["embed"][around[order]].reshape(len(target), -1)
    h = np.tanh(x @ w["mix"] + w["bias"])
    outer = _softmax(h @ w["classes"] + w["class_bias"])
    inner = np.empty((len(target), CLASSES), np.float32)
    cuts = np.searchsorted(group, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        a, e = cuts[c], cuts[c + 1]
        if a < e:
            inner[a:e] = h[a:e] @ w["inside"][c] + w["inside_bias"][c]
    return order, x, h, outer, _softmax(inner), group, member, cuts


def log_probabilities(w: dict, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    out = np.empty(len(target))
    for at in range(0, len(target), BATCH):
        order, _, _, outer, inner, group, member, _ = _forward(w, around[at : at + BATCH], target[at : at + BATCH])
        k = np.arange(len(order))
        out[at + order] = np.log(np.maximum(outer[k, group], 1e-30)) + np.log(np.maximum(inner[k, member], 1e-30))
    return out


class Trainer:
    """Adagrad steps on a copy of the shared weights."""

    def __init__(self, shared: dict):
        self.w = {k: v.copy() for k, v in shared.items()}
        self.sq = {k: np.full(v.shape if k != "embed" else (len(v), 1), 1e-4, np.float32) for k, v in shared.items()}

    def _step(self, k: str, g: np.ndarray) -> None:
        self.sq[k] += g * g
        self.w[k] -= RATE * g / np.sqrt(self.sq[k])

    def learn(self, around: np.ndarray, target: np.ndarray) -> None:
        w, n = self.w, len(target)
        order, x, h, outer, inner, group, member, cuts = _forward(w, around, target)
        k = np.arange(n)
        outer[k, group] -= 1
        inner[k, member] -= 1
        dh = outer @ w["classes"].T
        g_inside = np.zeros_like(w["inside"])
        for c in range(CLASSES):
            a, e = cuts[c], cuts[c + 1]
            if a < e:
                g_inside[c] = h[a:e].T @ inner[a:e]
                dh[a:e] += inner[a:e] @ w["inside"][c].T
        g_inside_bias = np.zeros_like(w["inside_bias"])
        full = np.flatnonzero(np.diff(cuts))
        g_inside_bias[full] = np.add.reduceat(inner, cuts[full], axis=0)
        dz = dh * (1 - h * h)
        dx = (dz @ w["mix"].T).reshape(-1, WIDTH)
        ids = around[order].ravel()
        by = np.argsort(ids, kind="stable")
        met, heads = np.unique(ids[by], return_index=True)
        g_embed = np.add.reduceat(dx[by], heads, axis=0) / n
        self.sq["embed"][met] += (g_embed * g_embed).mean(axis=1, keepdims=True)
        w["embed"][met] -= RATE * g_embed / np.sqrt(self.sq["embed"][met])
        for name, g in (("classes", h.T @ outer), ("class_bias", outer.sum(axis=0)), ("inside", g_inside), ("inside_bias", g_inside_bias), ("mix", x.T @ dz), ("bias", dz.sum(axis=0))):
            self._step(name, g / n)


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _round(docs: DataFrame, shared: dict, vocab: Vocabulary, number: int) -> dict:
    """One round: tasks learn from its part of the documents, Spark averages their weights block by block."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((shared, vocab.symbol))

    def learn(batches):
        start, symbol = held.value
        trainer, seen, pending = Trainer(start), 0, []
        for batch in batches:
            for _, _, data, offsets in wordhash.slices(batch.column("text")):
                hashes, row = wordhash.words(data, offsets)
                ids = symbol[_cells(hashes)]
                masked = np.flatnonzero(wordhash.mixed(hashes + np.arange(len(ids)).astype(np.uint64)) % np.uint64(MASKED) == 0)
                if len(masked):
                    pending.append((contexts(ids, row)[masked], ids[masked]))
                if sum(len(t) for _, t in pending) >= BATCH:
                    around, target = (np.concatenate(p) for p in zip(*pending))
                    for at in range(0, len(target) - BATCH + 1, BATCH):
                        trainer.learn(around[at : at + BATCH], target[at : at + BATCH])
                    seen += len(target) - len(target) % BATCH
                    pending = [(around[len(target) - len(target) % BATCH :], target[len(target) - len(target) % BATCH :])]
        rest = [p for p in pending if len(p[1])]
        if rest:
            around, target = (np.concatenate(p) for p in zip(*rest))
            trainer.learn(around, target)
            seen += len(target)
        if seen:
            flat = _flat(trainer.w).astype(np.float64) * seen
            blocks = [flat[at : at + BLOCK].tobytes() for at in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([seen] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["block", "n", "sums"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for block, n, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "sums"))):
                got = sums.setdefault(block, [0, 0.0])
                got[0] += n
                got[1] = got[1] + np.frombuffer(raw, np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums, pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())],
            names=["block", "n", "sums"],
        )

    kind = "block int, n long, sums binary"
    part = texts(docs).filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(ROUNDS)) == number)
    rows = part.mapInArrow(learn, kind).repartition("block").mapInArrow(add, kind).collect()
    if not rows:
        return shared
    rows = sorted(rows, key=lambda r: r.block)
    return _shaped(np.concatenate([np.frombuffer(r.sums, np.float64) / r.n for r in rows]), shared)


def train(docs: DataFrame) -> tuple[Vocabulary, dict]:
    counts = cell_counts(docs)
    vocab, weights = vocabulary(counts), initial(counts)
    for number in range(ROUNDS):
        weights = _round(docs, weights, vocab, number)
    return vocab, weights


def scores(docs: DataFrame, vocab: Vocabulary, weights: dict) -> DataFrame:
    """doc_id, n_words, log_likelihood (natural logarithm, summed over all words) and its mean per word, for every row of `docs`.

    Null ids stay null; null, empty and blank texts have no words, log_likelihood 0 and a null mean; repeated rows get the
    same score; an empty table gives no rows (and an untrained model); other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast((vocab, weights))

    def score(batches):
        known, w = held.value
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, rows, data, offsets in wordhash.slices(batch.column("text")):
                hashes, row = wordhash.words(data, offsets)
                cells = _cells(hashes)
                ids = known.symbol[cells]
                logs = log_probabilities(w, contexts(ids, row), ids) + known.log_share[cells]
                n[first : first + rows] = np.bincount(row, minlength=rows)
                total[first : first + rows] = np.bincount(row, logs, rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total)], names=["doc_id", "n_words", "log_likelihood"])

    rows = texts(docs).mapInArrow(score, "doc_id long, n_words long, log_likelihood double")
    return rows.select(shown_id(), "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"))
