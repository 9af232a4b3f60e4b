"""Quality classifier: a sparse ensemble of rules from tree paths, compiled into Spark column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgap.llm.common import BLANKS, WORD, keep, let, shown_id, texts

#: Labelled rows that the rules are learned from at most, the first by hash of doc_id.
FIT_ROWS = 20_000
TREES, DEPTH, SHRINK, CUTS, LEAST = 40, 3, 0.2, 32, 20
LASSO, STEPS = 2e-4, 400

STATISTICS = (
    "n_words", "word_chars", "distinct_share", "top_word_share", "upper_share", "symbol_share", "digit_share", "mark_share",
    "stop_share", "comma_share", "pipe_share", "long_word_share", "one_char_share", "line_words", "dup_line_share", "other_share",
)


def statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, `more` and the statistics of every text as doubles; no label, language, source or id goes into them."""
    rows = let(texts(docs, *more), w=F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lines=F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0))
    rows = let(rows, low=F.sort_array(F.transform("w", lambda x: F.xxhash64(F.lower(x)))), distinct=F.array_distinct("w"))
    n = F.greatest(F.size("w"), F.lit(1)).cast("double")
    bare = F.translate("text", BLANKS, "")
    chars = F.greatest(F.length(bare), F.lit(1)).cast("double")

    def share(of: str) -> Column:
        return (F.length("text") - F.length(F.translate("text", of, ""))) / chars

    # sorted hashes: a word seen more than once equals its neighbour
    same = F.size(F.filter(F.arrays_zip(F.col("low").alias("a"), F.slice("low", 2, 1 << 30).alias("b")), lambda t: t["a"] == t["b"]))
    upper = F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))
    cols = {
        "n_words": F.size("w"),
        "word_chars": F.length(bare) / n,
        "distinct_share": F.size("distinct") / n,
        "top_word_share": same / n,
        "upper_share": upper / chars,
        "symbol_share": share("#*$%&|<>"),
        "digit_share": share("0123456789"),
        "mark_share": share("!?"),
        "stop_share": share("."),
        "comma_share": share(",;:"),
        "pipe_share": share("|"),
        "long_word_share": F.size(F.filter("w", lambda x: F.length(x) > 12)) / n,
        "one_char_share": F.size(F.filter("w", lambda x: F.length(x) == 1)) / n,
        "line_words": n / F.greatest(F.size("lines"), F.lit(1)),
        "dup_line_share": (F.size("lines") - F.size(F.array_distinct("lines"))) / F.greatest(F.size("lines"), F.lit(1)),
        "other_share": share("@/\\=_{}[]()\"'~^+"),
    }
    own = [c for c in rows.columns if c not in ("text", "w", "lines", "low", "distinct")]
    return rows.select(*own, *[cols[c].cast("double").alias(c) for c in STATISTICS])


@dataclass(frozen=True)
class Rule:
    #: (statistic, is_upper_bound, cut): value <= cut, or value > cut.
    terms: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Probability of label 1 as one column expression over the statistics."""
        total = " + ".join(
            [f"{self.bias!r}D"] + ["IF(" + " AND ".join(f"{s} {'<=' if up else '>'} {cut!r}D" for s, up, cut in r.terms) + f", {r.weight!r}D, 0D)" for r in self.rules]
        )
        return 1.0 / (1.0 + F.exp(-F.expr(total)))


def _tree_paths(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list, pred: np.ndarray) -> None:
    """Grow one tree on binned statistics by second-order gain; every node but the root adds its path to `out`."""
    g, h = grad[rows].sum(), hess[rows].sum()
    pred[rows] = g / (h + 1.0)
    if path:
        out.append(path)
    if not depth or len(rows) < 2 * LEAST:
        return
    best = (1e-6, -1, -1)
    for f in range(bins.shape[1]):
        b = bins[rows, f]
        gs, hs, ns = (np.cumsum(np.bincount(b, w, CUTS + 1))[:-1] for w in (grad[rows], hess[rows], None))
        gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
        gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] < 0:
        return
    _, f, k = best
    low = bins[rows, f] <= k
    _tree_paths(bins, grad, hess, rows[low], (*path, (f, True, k)), depth - 1, out, pred)
    _tree_paths(bins, grad, hess, rows[~low], (*path, (f, False, k)), depth - 1, out, pred)


def _simplified(path: tuple) -> tuple:
    """One bound per statistic and side."""
    tight: dict[tuple[int, bool], int] = {}
    for f, up, k in path:
        held = tight.get((f, up))
        tight[f, up] = k if held is None else min(held, k) if up else max(held, k)
    return tuple(sorted((f, up, k) for (f, up), k in tight.items()))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules from boosted trees over the statistics `x`, weighted by lasso logistic regression (proximal gradient with momentum)."""
    n = len(y)
    prior = (y.sum() + 1.0) / (n + 2.0)
    start = float(np.log(prior / (1 - prior)))
    if n < 2 * LEAST or len(set(y.tolist())) < 2:
        return Ensemble(start, ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin, paths = np.full(n, start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        pred = np.zeros(n)
        _tree_paths(bins, y - p, p * (1 - p), np.arange(n), (), DEPTH, paths, pred)
        margin += SHRINK * pred
    rules = list(dict.fromkeys(filter(None, map(_simplified, paths))))
    z = np.stack([np.logical_and.reduce([(bins[:, f] <= k) if up else (bins[:, f] > k) for f, up, k in r]) for r in rules], axis=1).astype(np.float32)
    mean = z.mean(axis=0)
    centred = z - mean
    step = 4.0 * n / max(float(np.linalg.norm(centred, 2)) ** 2, 1e-9)
    w, b, v, vb, t = np.zeros(len(rules)), start, np.zeros(len(rules)), start, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(centred @ v.astype(np.float32) + vb)))
        moved = v - step * (centred.T @ (p - y).astype(np.float32)) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
        new_b = vb - min(step, 4.0) * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    kept = [i for i in range(len(rules)) if abs(w[i]) > 1e-6 and all(k < len(cuts[f]) for f, _, k in rules[i])]
    made = tuple(Rule(tuple((STATISTICS[f], up, float(cuts[f][k])) for f, up, k in rules[i]), float(w[i])) for i in kept)
    return Ensemble(float(b - mean[kept] @ w[kept]), made)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ensemble:
    """Learn from the labelled documents that are not held out, at most `fit_rows` of them, chosen by a hash of doc_id.

    The driver gets that many rows of statistics at most. Labels other than 0 and 1, null ids and documents without a text
    row are left out; of several labels for one document the smallest counts.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).filter(~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = keep(chosen, "fit-labels")
    rows = texts(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    got = statistics(rows).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *STATISTICS).limit(fit_rows).toPandas()
    return fit(got[list(STATISTICS)].to_numpy(float), got["quality"].to_numpy(float))


def scores(docs: DataFrame, model: Ensemble, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= `cut`) of every row of `docs`.

    Null ids stay null and count as held out; null and empty texts are scored by their statistics, all zero; repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    rows = statistics(docs).select(shown_id(), model.score().alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Ensemble, cut: float = 0.3) -> DataFrame:
    """The rows of `docs` whose text scores at least `cut`, with their own columns."""
    return statistics(docs, F.struct("*").alias("_row")).filter(model.score() >= cut).select("_row.*")
