"""Entities, sentiment and theme clusters over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from termgap.operators import clusters as cl
from termgap.operators import entities, sentiment, tfidf
from termgap.params import DEFAULT
from termgap.queries import tables as t
from termgap.queries import terms
from termgap.queries.fixtures import GAZETTEER_SQL, MODIFIERS, POLARITY_SQL
from termgap.queries.registry import query
from termgap.queries.sql import with_
from termgap.session import Staging


def matches(spark, sf):
    return entities.entity_matches(t.docs(spark, sf), spark.sql(GAZETTEER_SQL))


def per_page(spark, sf):
    return entities.page_entities(matches(spark, sf))


def tone(spark, sf):
    return sentiment.page_sentiment(t.docs(spark, sf), spark.sql(POLARITY_SQL))


@query("j6_entity_matches", with_("""
    SELECT query_id, doc_ord, CAST(pos AS INTEGER) AS pos, surface, label FROM matches"""))
def j6(spark, sf):
    return matches(spark, sf).select("query_id", "doc_ord", "pos", "surface", "label")


@query("j7_merged_labels", with_("""
    SELECT label, CASE WHEN label IN ('GPE', 'LOC') THEN 'GPE/LOC' ELSE label END AS merged, count(*) AS n FROM matches GROUP BY ALL"""))
def j7(spark, sf):
    return matches(spark, sf).groupBy("label", entities.merged_label(F.col("label")).alias("merged")).agg(F.count("*").alias("n"))


@query("a7_page_entities", with_("SELECT query_id, doc_ord, surface, label, n FROM page_entities"))
def a7(spark, sf):
    return per_page(spark, sf).select("query_id", "doc_ord", "surface", "label", "n")


@query("t7_page_entity_order", with_("""
    SELECT query_id, doc_ord, surface, CAST(row_number() OVER (PARTITION BY query_id, doc_ord ORDER BY n DESC, first_pos) AS INTEGER) AS rank
    FROM page_entities"""))
def t7(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("query_id", "doc_ord").orderBy(F.desc("n"), "first_pos")
    return per_page(spark, sf).select("query_id", "doc_ord", "surface", F.row_number().over(order).alias("rank"))


@query("a8_entity_totals", with_("SELECT query_id, folded, label, n FROM entity_totals"))
def a8(spark, sf):
    return entities.entity_totals(entities.seen_entities(per_page(spark, sf)))


@query("j8_first_spelling", with_("SELECT query_id, folded, surface FROM spellings"))
def j8(spark, sf):
    return entities.first_spellings(entities.seen_entities(per_page(spark, sf)))


@query("a9_named_totals", with_("SELECT query_id, label, surface, n FROM named_totals"))
def a9(spark, sf):
    return entities.named_totals(entities.seen_entities(per_page(spark, sf)))


@query("t5_top_entities", with_("SELECT * FROM entities"))
def t5(spark, sf):
    return m4(spark, sf)


@query("m4_entities", with_("SELECT query_id, label, rank, surface, n FROM entities"))
def m4(spark, sf):
    return entities.overall_entities(per_page(spark, sf)).select("query_id", "label", "rank", "surface", "n")


@query("j10_word_polarity", with_("""
    SELECT w.query_id, w.word, p.polarity, count(*) AS n FROM words w JOIN polarity p ON p.lang = w.lang AND p.word = w.word GROUP BY ALL"""))
def j10(spark, sf):
    from termgap.operators.tokens import word_rows

    rows = word_rows(t.docs(spark, sf)).join(spark.sql(POLARITY_SQL), ["lang", "word"])
    return rows.groupBy("query_id", "word", "polarity").agg(F.count("*").alias("n"))


@query("a10_page_sentiment", with_("SELECT query_id, doc_ord, counted, round(sentiment, 6) AS sentiment FROM tone"))
def a10(spark, sf):
    return tone(spark, sf).select("query_id", "doc_ord", "counted", terms.six("sentiment"))


@query("a10_modified_sentiment", with_("SELECT query_id, doc_ord, counted, round(sentiment, 6) AS sentiment FROM turned_tone"))
def a10_modified(spark, sf):
    pages = sentiment.page_sentiment(t.docs(spark, sf), spark.sql(POLARITY_SQL), modifiers=MODIFIERS)
    return pages.select("query_id", "doc_ord", "counted", terms.six("sentiment"))


@query("a11_mean_sentiment", with_("SELECT query_id, round(sentiment, 6) AS sentiment FROM overall_tone"))
def a11(spark, sf):
    return sentiment.overall_sentiment(tone(spark, sf)).select("query_id", terms.six("sentiment"))


@query("a12_sentiment_by_url", with_("SELECT query_id, url, round(sentiment, 6) AS sentiment FROM tone"))
def a12(spark, sf):
    return tone(spark, sf).select("query_id", "url", terms.six("sentiment"))


@query("m5_sentiment", with_("""
    SELECT t.query_id, t.url, round(t.sentiment, 6) AS sentiment, round(o.sentiment, 6) AS overall FROM tone t
    JOIN overall_tone o ON o.query_id = t.query_id"""))
def m5(spark, sf):
    pages = tone(spark, sf)
    overall = sentiment.overall_sentiment(pages).select("query_id", F.round("sentiment", 6).alias("overall"))
    return pages.select("query_id", "url", terms.six("sentiment")).join(overall, "query_id")


def vectors(spark, sf, given=None):
    """Page vectors in a staged table. The staging folder outlives the call, as the caller runs the query.

    ``given``: scored pages, vocabulary and staging area of a caller that has them.
    """
    scored, vocab, staging = given or (*terms.scored(spark, sf), Staging(spark))
    indexed = staging.keep(cl.indexed_vocabulary(vocab), "indexed")
    return staging.keep(cl.page_vectors(scored), "vectors"), indexed, staging


FIRST_STEP = """
    WITH_PLACEHOLDER sizes AS MATERIALIZED (
        SELECT query_id, CAST(count(*) AS INTEGER) AS width FROM vocab GROUP BY 1),
    seeds AS MATERIALIZED (
        SELECT query_id, doc_ord, row_number() OVER (PARTITION BY query_id ORDER BY doc_ord) - 1 AS cluster FROM page_sizes WHERE n_tokens >= 2
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_ord) <= 5),
    dots AS MATERIALIZED (
        SELECT p.query_id, p.doc_ord, c.cluster, sum(a.score * b.score) AS dot FROM scores a
        JOIN seeds c ON c.query_id = a.query_id
        JOIN scores b ON b.query_id = c.query_id AND b.doc_ord = c.doc_ord AND b.term = a.term
        JOIN page_sizes p ON p.query_id = a.query_id AND p.doc_ord = a.doc_ord GROUP BY ALL),
    squares AS MATERIALIZED (SELECT query_id, doc_ord, sum(score * score) AS sq FROM scores GROUP BY ALL),
    distances AS MATERIALIZED (
        SELECT p.query_id, p.doc_ord, c.cluster,
               round((CASE WHEN s.sq IS NULL THEN 0 ELSE 1 END) + coalesce(q.sq, 0) - 2 * coalesce(d.dot, 0), 9) AS d2
        FROM page_sizes p JOIN seeds c ON c.query_id = p.query_id
        LEFT JOIN squares s ON s.query_id = p.query_id AND s.doc_ord = p.doc_ord
        LEFT JOIN squares q ON q.query_id = c.query_id AND q.doc_ord = c.doc_ord
        LEFT JOIN dots d ON d.query_id = p.query_id AND d.doc_ord = p.doc_ord AND d.cluster = c.cluster WHERE p.n_tokens >= 2),
    nearest AS MATERIALIZED (
        SELECT query_id, doc_ord, cluster, d2 FROM distances
        QUALIFY row_number() OVER (PARTITION BY query_id, doc_ord ORDER BY d2, cluster) = 1)
"""


def step_sql(body: str) -> str:
    """A statement over the first step's relations and any of the shared ones that it names."""
    base = with_(f"SELECT * FROM scores JOIN page_sizes USING (query_id) JOIN vocab USING (query_id) -- {' '.join(body.split())}")
    head = base[: base.rindex(" SELECT * FROM scores JOIN page_sizes")]
    return head + "," + FIRST_STEP.replace("WITH_PLACEHOLDER", "") + body


def first_step(spark, sf, given=None):
    """One assignment round from a plain start: the first five pages of each keyword are the centres."""
    from pyspark.sql import Window

    found, indexed, staging = vectors(spark, sf, given)
    first = Window.partitionBy("query_id").orderBy("doc_ord")
    seeds = found.withColumn("cluster", F.row_number().over(first)).where(F.col("cluster") <= DEFAULT.max_clusters)
    seeds = seeds.withColumn("cluster", F.col("cluster") - 1)
    centres = staging.keep(cl.dense(seeds.select("query_id", "cluster", "cells"), indexed), "seeds")
    return cl.assign(found, centres), centres, indexed


@query("m3_cluster_step", step_sql("SELECT query_id, doc_ord, CAST(cluster AS INTEGER) AS cluster, round(d2, 6) AS d2 FROM nearest"))
def m3_step(spark, sf):
    assigned, _, _ = first_step(spark, sf)
    return assigned.select("query_id", "doc_ord", "cluster", six_d2())


def six_d2():
    return F.round("d2", 6).alias("d2")


CENTROIDS = """
    SELECT n.query_id, CAST(n.cluster AS INTEGER) AS cluster, s.term, round(sum(s.score) / m.members, 6) AS weight
    FROM nearest n JOIN scores s ON s.query_id = n.query_id AND s.doc_ord = n.doc_ord
    JOIN (SELECT query_id, cluster, count(*) AS members FROM nearest GROUP BY ALL) m ON m.query_id = n.query_id AND m.cluster = n.cluster
    GROUP BY n.query_id, n.cluster, s.term, m.members"""


def centroids(spark, sf, given=None):
    assigned, centres, indexed = first_step(spark, sf, given)
    return cl.new_centres(assigned, centres).where(F.col("members") > 0), indexed


@query("a17_centroids", step_sql(CENTROIDS))
def a17(spark, sf):
    return j9(spark, sf)


@query("j9_centroid_terms", step_sql(CENTROIDS))
def j9(spark, sf):
    centres, indexed = centroids(spark, sf)
    parts = centres.select("query_id", "cluster", F.posexplode("vec").alias("ix", "weight")).where(F.col("weight") > 0)
    return parts.join(indexed, ["query_id", "ix"]).select("query_id", "cluster", "term", terms.six("weight"))


CLUSTER_TERMS = f"""
    SELECT query_id, cluster, CAST(rank AS INTEGER) AS rank, term FROM (
        SELECT c.query_id, c.cluster, v.term, row_number() OVER (
            PARTITION BY c.query_id, c.cluster ORDER BY round(coalesce(w.weight, 0), 9) DESC, v.term) AS rank
        FROM (SELECT DISTINCT query_id, CAST(cluster AS INTEGER) AS cluster FROM nearest) c JOIN vocab v ON v.query_id = c.query_id
        LEFT JOIN ({CENTROIDS.replace('6) AS weight', '12) AS weight')}) w
        ON w.query_id = c.query_id AND w.cluster = c.cluster AND w.term = v.term) WHERE rank <= 10"""


@query("t6_cluster_terms", step_sql(CLUSTER_TERMS))
def t6(spark, sf):
    centres, indexed = centroids(spark, sf)
    return cl.cluster_terms(centres, indexed).select("query_id", "cluster", "rank", "term")


@query("m3_cluster_fit")
def m3_fit(spark, sf):
    found, indexed, staging = vectors(spark, sf)
    assigned, _ = cl.fit(found, indexed, staging)
    return assigned.select("query_id", "doc_ord", "cluster", six_d2())


@query("m3_fit_checks", with_("""
    SELECT p.query_id, CASE WHEN p.n > 3 THEN least(5, greatest(2, p.n // 2)) ELSE greatest(1, p.n) END AS clusters,
           CAST(0 AS BIGINT) AS pages_elsewhere, CAST(0 AS BIGINT) AS centres_off_mean, true AS converged
    FROM (SELECT query_id, count(*) AS n FROM page_sizes WHERE n_tokens >= 2 GROUP BY 1) p JOIN (SELECT DISTINCT query_id FROM vocab) v ON v.query_id = p.query_id"""))
def m3_checks(spark, sf):
    """The fit's own rules, recomputed with dense vectors: pages nearer to another centre than to their own, centres that
    are no mean of their pages, the number of clusters, and whether the rounds ended by themselves.
    """
    found, indexed, staging = vectors(spark, sf)
    assigned, centres = cl.fit(found, indexed, staging)
    width = indexed.groupBy("query_id").agg(F.count("*").cast("int").alias("width"))
    own = staging.keep(assigned.select("query_id", "doc_ord", "cluster", "cells"), "assigned")
    ix = F.transform("cells", lambda c: c["ix"])
    dense = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get("cells", F.array_position(ix, i).cast("int") - 1)["score"], F.lit(0.0)))
    pages = staging.keep(own.join(width, "query_id").select("query_id", "doc_ord", "cluster", dense.alias("x")), "dense_pages")
    apart = F.aggregate(F.zip_with("x", "vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, y: total + y)
    measured = pages.join(centres.select("query_id", F.col("cluster").alias("c"), "vec"), "query_id").select("query_id", "doc_ord", (F.col("c") == F.col("cluster")).alias("mine"), apart.alias("d"))
    away = measured.groupBy("query_id", "doc_ord").agg(F.max(F.when(F.col("mine"), F.col("d"))).alias("own"), F.min("d").alias("least"))
    away = away.groupBy("query_id").agg(F.count_if(F.col("own") > F.col("least") + 1e-6).alias("pages_elsewhere"))
    sums = pages.select("query_id", "cluster", F.posexplode("x").alias("ix", "w")).groupBy("query_id", "cluster", "ix").agg(F.avg("w").alias("mean"))
    cells = centres.select("query_id", "cluster", F.posexplode("vec").alias("ix", "w")).join(sums, ["query_id", "cluster", "ix"])
    off = cells.groupBy("query_id", "cluster").agg(F.max(F.abs(F.col("w") - F.col("mean"))).alias("off")).groupBy("query_id").agg(F.count_if(F.col("off") > 1e-4).alias("centres_off_mean"))
    counted = centres.groupBy("query_id").agg(F.count("*").alias("clusters"), F.bool_and("converged").alias("converged"))
    return counted.join(away, "query_id").join(off, "query_id").select("query_id", "clusters", "pages_elsewhere", "centres_off_mean", "converged")
