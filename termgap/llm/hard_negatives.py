"""Hard negatives by exact inner-product search in cover trees.

Rows are dealt out in ranges of (label, vec_id). A task gives each candidate x of a range the extra component
sqrt(M^2 - |x|^2), with M the largest norm of all, so that all lie on one sphere and the angle to an anchor alone decides
the inner product, and builds cover trees over them: a node's points are covered by its children's balls, whose centres
lie apart from each other by their radius at least, and a node keeps the angle within which all its points lie. For an anchor q at angle t to a node's centre, all inner
products below the node lie between |q| M cos(t + r) and |q| M cos(t - r).

A search takes nodes from a heap, the highest bound first, skips those that lie outside the anchor's windows or under the
hits it already has, and computes exact integer products in the leaves.

Searches run in cells of a grid: a slot of candidates (about SLOT_ROWS rows, in trees of at most TREE_ROWS) times a chunk of
anchors (about CHUNK_ROWS). Both have bounded size, so a cell fits a task whatever the tables' sizes; copies of one
vector only make leaves of one tree larger. A cell returns each anchor's best few, and a window function merges the cells.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgap.llm.common import keep

TREE_ROWS, SLOT_ROWS, CHUNK_ROWS, LEAF_ROWS, FAN_OUT = 8192, 65_536, 16_384, 128, 16
#: Components beyond this are treated like infinite ones, as scores would not fit a long.
MAX_COMPONENT = 2**27
#: Added to each angle; far more than what rounding can change, far less than what pruning needs.
SLACK = 1e-6

_TREE = {
    "slot": pa.int32(), "label": pa.int32(), "rows": pa.int32(), "ids": pa.binary(), "vectors": pa.binary(), "centre": pa.binary(), "radius": pa.binary(),
    "first": pa.binary(), "last": pa.binary(), "parent": pa.binary(),
}
TREES = "slot int, label int, rows int, ids binary, vectors binary, centre binary, radius binary, first binary, last binary, parent binary"


def usable(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label and v (components floored after scaling) of the rows that take part."""
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("int").alias("label"), F.transform(F.col(vector), lambda x: x.cast("double") * scale).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < MAX_COMPONENT))  # NaN is larger than any number
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine).withColumn("v", F.transform("v", lambda x: F.floor(x).cast("int")))


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Vectors of an Arrow list column as rows; shorter ones end in zeros."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = flat[offsets[0] : offsets[-1]]
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def cover_tree(x: np.ndarray, top: float) -> dict[str, np.ndarray]:
    """order of the rows, and of each node its centre (a row), angular radius, span in the order, and parent.

    x: integer rows; top: the largest norm of all rows. A ball that holds more than LEAF_ROWS rows and more than one point
    is covered by balls of half its radius, or by FAN_OUT balls if more were needed, each centred at the row farthest
    from all centres so far; small balls that lie side by side in the order are leaves together, with a radius that covers them.
    """
    top = top or 1.0
    unit = np.concatenate([x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))[:, None]], axis=1) / top
    order, nodes, work = np.arange(len(x)), [], [(-1, 0, len(x), 0)]
    while work:
        parent, a, b, c = work.pop()
        rows = order[a:b]
        mine = unit[rows]
        apart = np.sqrt(np.maximum(2 - 2 * (mine @ unit[c]), 0))  # distances on a sphere of radius 1
        reach, node = float(apart.max()), len(nodes)
        nodes.append((c, 2 * np.arcsin(min(1.0, reach / 2)) + SLACK, a, b, parent))
        if b - a <= LEAF_ROWS or reach < SLACK:
            continue
        own, near, centres = np.zeros(b - a, np.int64), apart, [c]
        while near.max() > reach / 2 and len(centres) < FAN_OUT:
            far = rows[int(near.argmax())]
            d = np.sqrt(np.maximum(2 - 2 * (mine @ unit[far]), 0))
            own[d < near] = len(centres)
            near = np.minimum(near, d)
            centres.append(far)
        if not own.any():
            continue
        by = np.argsort(own, kind="stable")
        order[a:b] = rows[by]
        cuts = (a + np.searchsorted(own[by], np.arange(len(centres) + 1))).tolist()
        lo = a
        for k, at in enumerate(centres):
            hi, after = cuts[k + 1], cuts[min(k + 2, len(centres))]
            if hi - lo and (k + 1 == len(centres) or after - lo > LEAF_ROWS):
                work.append((node, lo, hi, at))
                lo = hi
    centre, radius, first, last, parent = zip(*nodes)
    return {"order": order, "centre": np.array(centre, "<i4"), "radius": np.array(radius, "<f8"), "first": np.array(first, "<i4"), "last": np.array(last, "<i4"), "parent": np.array(parent, "<i4")}


def trees(rows: DataFrame, slots: int, top: float) -> DataFrame:
    """A row for each cover tree over at most TREE_ROWS rows of one label; slots are the ranges that tasks get."""

    def build(batches):
        slot, held, size = TaskContext.get().partitionId(), [], 0

        def out():
            width = max(x.shape[1] for _, _, x in held)
            ids, x = np.concatenate([i for _, i, _ in held]), np.concatenate([_wide(x, width) for _, _, x in held])
            tree = cover_tree(x, top)
            order, place = tree.pop("order"), np.empty(len(ids), "<i4")
            place[order] = np.arange(len(ids))
            row = {"slot": slot, "label": held[0][0], "rows": len(ids), "ids": ids[order].astype("<i8").tobytes(), "vectors": x[order].astype("<i4").tobytes()}
            row |= {n: (place[v] if n == "centre" else v).tobytes() for n, v in tree.items()}
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in _TREE.items()], names=list(_TREE))

        for batch in batches:
            labels, ids, x = batch.column("label").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))
            cuts = np.flatnonzero(np.diff(labels)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(labels)]):
                while a < b:
                    if held and (held[0][0] != labels[a] or size >= TREE_ROWS):
                        yield out()
                        held, size = [], 0
                    n = min(b - a, TREE_ROWS - size)
                    held.append((int(labels[a]), ids[a : a + n], x[a : a + n]))
                    a, size = a + n, size + n
        if held:
            yield out()

    by = ("label", "vec_id", F.xxhash64("v"))
    dealt = rows.repartitionByRange(slots, *by).sortWithinPartitions(*by)
    return keep(dealt.select("label", "vec_id", "v").mapInArrow(build, TREES), "cover-trees")


class Forest:
    """The trees of a slot, with all rows in one matrix and all nodes in one numbering."""

    def __init__(self, table: pa.Table, width: int, top: float):
        of = {n: [] for n in ("ids", "vectors", "centre", "radius", "first", "last", "parent")}
        self.top, roots, labels, at, nodes = top, [], [], 0, 0
        for r in table.to_pylist():
            for n, parts in of.items():
                parts.append(np.frombuffer(r[n], {"ids": "<i8", "radius": "<f8"}.get(n, "<i4")))
            of["vectors"][-1] = _wide(of["vectors"][-1].reshape(r["rows"], -1).astype(float), width)
            for n in ("centre", "first", "last"):
                of[n][-1] = of[n][-1].astype(np.int64) + at
            of["parent"][-1] = np.where(of["parent"][-1] < 0, -1, of["parent"][-1] + np.int64(nodes))
            roots.append(nodes), labels.append(r["label"])
            at, nodes = at + r["rows"], nodes + len(of["radius"][-1])
        self.ids, self.x, self.centre, self.radius, self.first, self.last, parent = (np.concatenate(p) for p in of.values())
        self.roots, self.labels = np.array(roots), np.array(labels)
        self.below = np.argsort(parent, kind="stable")  # children of a node lie together
        self.cuts = np.searchsorted(parent[self.below], np.arange(nodes + 1))

    def bounds(self, q: np.ndarray, norm: float, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the inner products with rows below each node lie between."""
        most = norm * self.top
        if not most:
            return np.zeros(len(nodes)), np.zeros(len(nodes))
        angle, r = np.arccos(np.clip(self.x[self.centre[nodes]] @ q / most, -1, 1)), self.radius[nodes]
        pad = 1 + most * 1e-12
        return most * np.cos(np.minimum(angle + r, np.pi)) - pad, most * np.cos(np.maximum(angle - r, 0)) + pad

    def scores(self, q: np.ndarray, norm: float, span: slice) -> np.ndarray:
        if norm * self.top < 2**52:  # integers that doubles hold exactly
            return self.x[span] @ q
        return self.x[span].astype(np.int64) @ q.astype(np.int64)

    def search(self, q: np.ndarray, roots: np.ndarray, own: int | None, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (lowest, highest score) the first k rows below `roots` in it, as (-score, vec_id); id `own` is left out."""
        norm = float(np.sqrt(q @ q))
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        low = np.array([a for a, _ in windows], np.int64)  # what a row must reach: the window's low end, later the k-th hit
        high = np.array([b for _, b in windows], np.int64)
        end, heap = float(high.max()), []

        def push(nodes):
            a, b = self.bounds(q, norm, nodes)
            near = np.flatnonzero(((b[:, None] >= low) & (a[:, None] <= high)).any(axis=1))
            for n, lo, hi in zip(nodes[near].tolist(), a[near].tolist(), b[near].tolist()):
                heapq.heappush(heap, (-min(hi, end), n, lo, hi))

        push(roots)
        while heap and -heap[0][0] >= low.min():
            _, node, a, b = heapq.heappop(heap)
            if not ((b >= low) & (a <= high)).any():
                continue
            if self.cuts[node] < self.cuts[node + 1]:
                push(self.below[self.cuts[node] : self.cuts[node + 1]])
                continue
            span = slice(self.first[node], self.last[node])
            scores = self.scores(q, norm, span)
            if scores.max() < low.min():
                continue
            for w in range(len(windows)):
                hit = np.flatnonzero((scores >= low[w]) & (scores <= high[w]))
                if own is not None:
                    hit = hit[self.ids[span][hit] != own]
                if len(hit):
                    best[w] = heapq.nsmallest(k, best[w] + list(zip((-scores[hit]).astype(np.int64).tolist(), self.ids[span][hit].tolist())))
                    if len(best[w]) == k:
                        low[w] = max(int(low[w]), -best[w][-1][0])
        return best


def _grid(forest: DataFrame, queries: DataFrame, make, columns: str, top: float) -> DataFrame:
    """Run make(forest, row, vector), which gives tuples, for every row of every cell. forest: trees; queries: rows with slot, chunk and v."""
    out = pa.schema([(c, pa.int64()) for c in columns.split()])

    def cell(key, table, rows):
        if not table.num_rows or not rows.num_rows:
            return pa.Table.from_pylist([], schema=out)
        v = rows.column("v").combine_chunks()
        stored = max(len(x) // (4 * n) for x, n in zip(table.column("vectors").to_pylist(), table.column("rows").to_pylist()))
        asked = _matrix(v, stored)
        trees_ = Forest(table, asked.shape[1], top)
        found = [t for r, q in zip(rows.drop_columns(["v"]).to_pylist(), asked) for t in make(trees_, r, q)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * len(out), schema=out)

    cells = queries.select(F.col("slot").alias("of_slot"), F.col("chunk").alias("of_chunk")).distinct()
    cells = forest.join(cells, F.col("slot") == F.col("of_slot"))
    return cells.groupBy("of_slot", "of_chunk").cogroup(queries.groupBy("slot", "chunk")).applyInArrow(cell, ", ".join(f"{c} long" for c in columns.split()))


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row for which `anchor` (over vec_id) holds.

    A score is the inner product of the vectors, each component floored after multiplying by `scale`. An anchor's
    positives are its first `positives` other rows of its label, its negatives for each the first `negatives` rows of
    other labels whose score is at least `share` percent of the positive's and at most the positive's; higher scores come
    first, ties by smaller vec_id.

    Rows with a null id, label (after `label`, by default the column), vector or component, or a component that is not
    finite or too large to add up in a long, take no part. Shorter vectors count as ending in zeros; an empty one scores 0 with any.
    Rows that repeat an id are candidates and anchors each, but no positive has its anchor's id; equal result rows stay. An
    empty table gives no rows; other columns are ignored.
    """
    rows = keep(usable(rows, vec_id, vector, F.col("label") if label is None else label, scale), "vectors")
    n, square = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    top = float(np.sqrt(square or 0.0))
    cores = 2 * rows.sparkSession.sparkContext.defaultParallelism
    forest = trees(rows, max(1, min(-(-n // LEAF_ROWS), max(cores, -(-n // SLOT_ROWS)))), top)
    held = keep(forest.select("slot", "label").distinct(), "slot-labels")
    anchors = keep(rows.filter(anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    chunks = max(1, -(-anchors.count() // CHUNK_ROWS))
    anchors = anchors.withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.lit(chunks)))

    def near(trees_, r, q):
        for score, other in trees_.search(q, trees_.roots[trees_.labels == r["label"]], r["vec_id"], [(-(2**62), 2**62)], positives)[0]:
            yield r["anchor"], other, -score

    def hard(trees_, r, q):
        roots, asked = trees_.roots[trees_.labels != r["label"]], [s for s in sorted(set(r["scores"])) if s >= 0]  # no window below 0
        if len(roots) and asked:
            for score, hits in zip(asked, trees_.search(q, roots, None, [(-(-share * s // 100), s) for s in asked], negatives)):
                yield from ((r["anchor"], score, other, -s) for s, other in hits)

    def first(of: DataFrame, k: int, by: list[str], score: str, other: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), other))
        return of.withColumn("rank", rank).filter(F.col("rank") <= k)

    found = _grid(forest, anchors.join(held, "label").select("slot", "chunk", "anchor", "vec_id", "label", "v"), near, "anchor positive_id positive_score", top)
    chosen = keep(first(found, positives, ["anchor"], "positive_score", "positive_id").drop("rank"), "positives")
    scores = chosen.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))  # at most `positives`
    last = held.agg(F.max("slot")).first()[0]
    asked = anchors.join(scores, "anchor").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    found = _grid(forest, asked.select("slot", "chunk", "anchor", "label", "v", "scores"), hard, "anchor positive_score negative_id negative_score", top)
    found = first(found, negatives, ["anchor", "positive_score"], "negative_score", "negative_id")
    out = chosen.join(found, ["anchor", "positive_score"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
