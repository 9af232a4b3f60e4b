"""Theme clusters of the pages of each keyword.

All keywords are clustered at once. A page is a sparse vector over its keyword's vocabulary (at most 200 entries), the
centres of a keyword are one row (at most five vectors), so assigning pages is a row-local distance after one lookup by
``query_id``. A keyword of a request has at most a hundred pages, and is fitted by one task. A keyword with very many
pages spreads over all tasks: new centres are sums that fold per task before they are shuffled, and each round is written
to the staging area, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgap.functions.naming import cluster_count
from termgap.params import DEFAULT, Params
from termgap.session import Staging, lookup_side

#: Squared way below which a centre has not moved.
SETTLED = 1e-9
CENTRES_DDL = "query_id string, cluster int, vec array<double>, rounds int, moving boolean"
CENTRES = pa.schema([("query_id", pa.string()), ("cluster", pa.int32()), ("vec", pa.list_(pa.float64())), ("rounds", pa.int32()), ("moving", pa.bool_())])
MEMBER = -1  # index under which a page counts itself when sums are gathered


def indexed_vocabulary(vocab: DataFrame) -> DataFrame:
    """``(query_id, ix, term)`` in term order. The vocabulary is capped per keyword, so the window is small."""
    by_term = Window.partitionBy("query_id").orderBy("term")
    return vocab.select("query_id", "term", (F.row_number().over(by_term) - 1).alias("ix"))


def page_vectors(scored: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``(query_id, doc_ord, cells, sq)`` for every usable page; a page without kept terms is a zero vector."""
    cells = F.transform("scores", lambda s: F.struct(s["ix"].alias("ix"), s["score"].alias("score")))
    usable = scored.where(F.col("n_tokens") >= params.min_page_tokens)
    return usable.select("query_id", "doc_ord", cells.alias("cells"), F.when(F.size("scores") == 0, 0.0).otherwise(1.0).alias("sq"))


def dense(centres: DataFrame, indexed: DataFrame) -> DataFrame:
    """``(query_id, cluster, cells)`` to ``(query_id, cluster, vec)``, zero-filled over the keyword's vocabulary."""
    own = centres.select("query_id", "cluster", F.inline_outer("cells")).where(F.col("ix").isNotNull())
    zeros = indexed.join(centres.select("query_id", "cluster"), "query_id").select(
        "query_id", "cluster", "ix", F.lit(0.0).alias("score")
    )
    filled = own.unionByName(zeros).groupBy("query_id", "cluster", "ix").agg(F.sum("score").alias("score"))
    in_order = F.array_sort(F.collect_list(F.struct("ix", "score")))
    return filled.groupBy("query_id", "cluster").agg(F.transform(in_order, lambda c: c["score"]).alias("vec"))


def _distance(cells: Column, sq: Column, centre: Column) -> Column:
    dot = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c["score"] * F.get(centre["vec"], c["ix"]))
    return F.round(sq + centre["sq"] - 2 * dot, 9)


def centre_rows(centres: DataFrame) -> DataFrame:
    """One row per keyword with all its centres."""
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    return centres.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("cluster", "vec", square.alias("sq")))).alias("centres")
    )


def assign(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest centre of every page: adds ``cluster`` and ``d2`` (ties: lowest cluster number)."""
    nearest = F.array_min(
        F.transform("centres", lambda c: F.struct(_distance(F.col("cells"), F.col("sq"), c).alias("d2"), c["cluster"].alias("cluster")))
    )
    return (
        vectors.join(lookup_side(centre_rows(centres)), "query_id")
        .withColumn("_near", nearest)
        .select("query_id", "doc_ord", "cells", "sq", "_near.cluster", "_near.d2")
    )


def new_centres(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """Mean vector of the members: sums divided by the member count, zero entries included.

    The old centres join the same aggregation as zero sums, which fills the vectors and keeps a centre that lost all its
    members where it was. ``shift`` is the squared way a centre moved.
    """
    itself = F.array(F.struct(F.lit(MEMBER).alias("ix"), F.lit(1.0).alias("score")))
    added = assigned.select("query_id", "cluster", F.inline_outer(F.concat(itself, "cells"))).select(
        "query_id", "cluster", "ix", "score", F.lit(None).cast("double").alias("old")
    )
    before = centres.select("query_id", "cluster", F.posexplode("vec").alias("ix", "old")).select(
        "query_id", "cluster", "ix", F.lit(0.0).alias("score"), "old"
    )
    sums = (
        added.unionByName(before)
        .groupBy("query_id", "cluster", "ix")
        .agg(F.sum("score").alias("total"), F.max("old").alias("old"))
    )
    gathered = sums.groupBy("query_id", "cluster").agg(
        F.max(F.when(F.col("ix") == MEMBER, F.col("total"))).alias("_members"),
        F.array_sort(F.collect_list(F.when(F.col("ix") != MEMBER, F.struct("ix", "total", "old")))).alias("_cells"),
    )

    def mean(cell: Column) -> Column:
        return F.when(F.col("_members").isNull(), cell["old"]).otherwise(cell["total"] / F.col("_members"))

    return gathered.select(
        "query_id",
        "cluster",
        F.transform("_cells", mean).alias("vec"),
        F.coalesce(F.col("_members").cast("bigint"), F.lit(0).cast("bigint")).alias("members"),
        F.aggregate(
            "_cells", F.lit(0.0), lambda acc, c: acc + (mean(c) - c["old"]) * (mean(c) - c["old"])
        ).alias("shift"),
    )


def cluster_sizes(vectors: DataFrame, indexed: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``(query_id, k, pages)``: how many clusters. Keywords without terms drop out."""
    pages = vectors.groupBy("query_id").agg(F.count("*").alias("pages"))
    k = F.least(cluster_count(F.col("pages"), params.max_clusters), F.col("pages")).cast("int")
    return pages.join(indexed.select("query_id").distinct(), "query_id").select("query_id", k.alias("k"), "pages")


def first_centres(vectors: DataFrame, sizes: DataFrame, indexed: DataFrame) -> DataFrame:
    """Centre 0: the first page that is not a zero vector."""
    order = F.struct((-F.col("sq")).alias("a"), F.col("doc_ord").alias("b"))
    chosen = vectors.groupBy("query_id").agg(F.min_by("cells", order).alias("cells")).join(sizes, "query_id")
    return dense(chosen.select("query_id", F.lit(0).alias("cluster"), "cells"), indexed)


def next_centres(
    vectors: DataFrame, sizes: DataFrame, indexed: DataFrame, centres: DataFrame, number: int
) -> DataFrame:
    """One more centre per keyword that still needs it: the page farthest from all centres so far."""
    order = F.struct("d2", (-F.col("doc_ord")).alias("b"))
    chosen = (
        assign(vectors, centres)
        .groupBy("query_id")
        .agg(F.max_by("cells", order).alias("cells"))
        .join(sizes.where(F.col("k") > number), "query_id")
    )
    return dense(chosen.select("query_id", F.lit(number).alias("cluster"), "cells"), indexed)


def _local_fit(rounds: int):
    """The whole fit of one keyword in numpy, by the same rules as the distributed rounds."""

    def fit_keyword(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["doc_ord"])
        x = np.zeros((len(rows), rows[0]["width"]))
        for n, r in enumerate(rows):
            for cell in r["cells"]:
                x[n, cell["ix"]] = cell["score"]
        sq = np.array([r["sq"] for r in rows])
        distance = lambda c: np.round(sq[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 9)
        centres = x[[int(np.argmax(sq))]]  # argmax and argmin take the first of equals: the smaller doc_ord, the lower cluster
        while len(centres) < rows[0]["k"]:
            centres = np.vstack([centres, x[int(np.argmax(distance(centres).min(axis=1)))]])
        turn, moving = 0, True
        while moving and turn < rounds:
            near, old, turn = distance(centres).argmin(axis=1), centres, turn + 1
            centres = np.array([x[near == c].mean(axis=0) if (near == c).any() else old[c] for c in range(len(old))])
            moving = bool(((centres - old) ** 2).sum(axis=1).max() > SETTLED)
        return pa.Table.from_pylist(
            [{"query_id": rows[0]["query_id"], "cluster": c, "vec": v.tolist(), "rounds": turn, "moving": moving} for c, v in enumerate(centres)], schema=CENTRES
        )

    return fit_keyword


def _distributed_fit(vectors: DataFrame, sizes: DataFrame, indexed: DataFrame, staging: Staging, params: Params) -> DataFrame:
    """Rounds over all tasks, for keywords too large for one. The state is one table a round, settled keywords included;
    pages of settled keywords are not read again.
    """
    centres = staging.keep(first_centres(vectors, sizes, indexed), "centres_start_0")
    for number in range(1, params.max_clusters):
        grown = centres.unionByName(next_centres(vectors, sizes, indexed, centres, number))
        centres = staging.keep(grown, f"centres_start_{number}")
    state = centres.select("query_id", "cluster", "vec", F.lit(0).alias("rounds"), F.lit(True).alias("moving"))
    keyword = Window.partitionBy("query_id")
    for turn in range(params.cluster_rounds):
        still = state.where("moving")
        if still.isEmpty():
            break
        moved = new_centres(assign(vectors, still), still).withColumn("moving", F.max("shift").over(keyword) > SETTLED)
        moved = moved.select("query_id", "cluster", "vec", F.lit(turn + 1).alias("rounds"), "moving")
        state = staging.keep(state.where("NOT moving").unionByName(moved), f"centres_{turn}")
    return state


def fit(
    vectors: DataFrame, indexed: DataFrame, staging: Staging, params: Params = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Deterministic k-means: farthest-first start, then rounds until no centre moves or the round limit is reached.

    A keyword of up to ``local_pages`` pages, as every request asks for, is fitted in one task after one shuffle; larger
    ones take distributed rounds. ``vectors`` should be a staged table. Returns ``(assigned, centres)``; centres has the
    rounds of its keyword and whether it ``converged``.
    """
    sizes = staging.keep(cluster_sizes(vectors, indexed, params), "cluster_sizes")
    width = indexed.groupBy("query_id").agg(F.count("*").cast("int").alias("width"))
    small = lookup_side(sizes.where(F.col("pages") <= params.local_pages).join(width, "query_id").select("query_id", "k", "width"))
    local = vectors.join(small, "query_id").groupBy("query_id").applyInArrow(_local_fit(params.cluster_rounds), CENTRES_DDL)
    large = sizes.where(F.col("pages") > params.local_pages)
    if not large.isEmpty():
        big = vectors.join(lookup_side(large.select("query_id")), "query_id", "left_semi")
        local = local.unionByName(_distributed_fit(big, large.select("query_id", "k"), indexed, staging, params))
    done = F.when(~F.col("moving"), True).otherwise(False)
    centres = staging.keep(local.withColumn("converged", done).drop("moving"), "centres_final")
    return assign(vectors, centres), centres


def cluster_terms(centres: DataFrame, indexed: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Heaviest terms of each centre; zero weights may appear when the vocabulary is short."""
    weights = centres.select("query_id", "cluster", F.posexplode("vec").alias("ix", "weight"))
    by_weight = Window.partitionBy("query_id", "cluster").orderBy(F.desc(F.round("weight", 9)), "term")
    return (
        weights.join(indexed, ["query_id", "ix"])
        .withColumn("rank", F.row_number().over(by_weight))
        .where(F.col("rank") <= params.terms_per_cluster)
        .select("query_id", "cluster", "rank", "term", "weight")
    )
