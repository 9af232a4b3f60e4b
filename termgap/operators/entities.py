"""Entity counts from a gazetteer of surfaces of any number of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgap.functions.lookup import ENTRY, MAX_LITERAL_BYTES, SLOT, VALUE, HashTable, bind
from termgap.functions.text import SPACES, WORD, cased_words
from termgap.params import DEFAULT, Params
from termgap.session import lookup_side
from termgap.sources.requests import resource_language
from termgap.sources.resources import ENTITY_LABELS

#: Stands between the parts of a key or value; marks a node from which longer surfaces go on.
IN_KEY, MORE = "\x04", "+"


def clean_surface(surface: Column) -> Column:
    return F.btrim(F.regexp_replace(surface, SPACES, " "), F.lit(" "))


def keep_surface(surface: Column, params: Params = DEFAULT) -> Column:
    return (F.length(surface) >= params.min_entity_chars) & ~surface.rlike(r"^\p{Nd}+$")


def page_label(label: Column) -> Column:
    return F.when(label == "PER", "PERSON").otherwise(label)


def merged_label(label: Column) -> Column:
    return F.when(label.isin("GPE", "LOC"), "GPE/LOC").otherwise(label)


def core_parts(surface: Column) -> Column:
    """The words of a surface with what stands before each of them: ``(before, word)`` in order."""
    return F.filter(
        F.zip_with(F.split(surface, WORD, -1), cased_words(surface), lambda b, w: F.struct(b.alias("before"), w.alias("word"))),
        lambda p: p["word"].isNotNull(),
    )


def usable_gazetteer(gazetteer: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Gazetteer rows with their words: allowed labels, cleaned surfaces of any number of words.

    ``parts`` run from the surface's first word to its last; punctuation at either end is not compared.
    """
    surface = clean_surface(F.col("surface"))
    return (
        gazetteer.select("lang", surface.alias("surface"), page_label(F.col("label")).alias("label"))
        .where(F.col("label").isin(*ENTITY_LABELS) & keep_surface(F.col("surface"), params))
        .groupBy("lang", "surface")
        .agg(F.min("label").alias("label"))
        .withColumn("parts", core_parts(F.col("surface")))
        .where(F.size("parts") > 0)
    )


def _key(lang: Column, text: Column) -> Column:
    return F.concat(lang, F.lit(IN_KEY), text)


class Trie:
    """Surfaces in two hash tables of the plan, so that a text pays for what it shares with them.

    ``nodes`` has the prefixes of 1, 2, 4, … words of every surface. A node names the numbers of words of the surfaces
    that have less than twice its words, and says whether longer ones go on from it. ``surfaces`` has the whole ones.
    """

    def __init__(self, rows: list):
        lengths: dict[str, set[int]] = {}
        further: set[str] = set()
        best: dict[str, tuple[str, str]] = {}
        for r in rows:
            words = [p.word if i == 0 else p.before + p.word for i, p in enumerate(r.parts)]
            n, size = len(words), 1
            while 2 * size <= n:
                further.add(f"{r.lang}{IN_KEY}{''.join(words[:size])}")
                size *= 2
            lengths.setdefault(f"{r.lang}{IN_KEY}{''.join(words[:size])}", set()).add(n)
            whole = f"{r.lang}{IN_KEY}{''.join(words)}"
            best[whole] = max(best.get(whole, ("", "")), (r.surface, r.label))
        self.longest = max((len(r.parts) for r in rows), default=1)
        nodes = {k: ",".join(map(str, sorted(lengths.get(k, ())))) + (MORE if k in further else "") for k in {*lengths, *further}}
        self.nodes = HashTable(nodes)
        self.surfaces = HashTable({k: surface + IN_KEY + label for k, (surface, label) in best.items()})

    @staticmethod
    def fits(rows: list) -> bool:
        """Whether the tables may travel in the plan: bounded, and without the characters that part their entries."""
        size = sum(2 * (len(r.surface.encode()) + 16) * len(r.parts).bit_length() for r in rows)
        return size <= MAX_LITERAL_BYTES // 2 and not any(c in r.lang + r.surface for r in rows for c in (SLOT, ENTRY, VALUE, IN_KEY))

    def lengths(self, span, at: Column, words: Column, lang: Column, size: int = 1) -> Column:
        """Numbers of words that surfaces may have which start at a word, by the nodes of ``size`` words and more."""
        nothing = F.array().cast("array<int>")

        def listed(node: Column) -> Column:
            own = F.rtrim(node, F.lit(MORE))
            found = F.when(F.coalesce(own, F.lit("")) == "", nothing).otherwise(F.transform(F.split(own, ","), lambda x: x.cast("int")))
            if 2 * size > self.longest:
                return found
            return F.concat(found, F.when(F.endswith(node, F.lit(MORE)), self.lengths(span, at, words, lang, 2 * size)).otherwise(nothing))

        return bind(F.when(at + size <= F.size(words), self.nodes.get(_key(lang, span(at, F.lit(size))))), listed)


def _span(words: Column, gaps: Column):
    """Text of some words from a place on, white space between them as one blank."""

    def text(at: Column, n: Column) -> Column:
        later = F.transform(F.sequence(at + 1, at + n - 1), lambda j: F.concat(F.regexp_replace(F.get(gaps, j), SPACES, " "), F.get(words, j)))
        return F.when(n == 1, F.get(words, at)).otherwise(F.concat(F.get(words, at), F.array_join(later, "")))

    return text


def _found(text: Column, words: Column, places: Column, at, fitting, entry) -> Column:
    """An entry for each place and each number of words that fits there; what parts the words is cut only if there is a place."""

    def spans(gaps: Column) -> Column:
        span = _span(words, gaps)
        return F.flatten(F.transform(places, lambda p: F.transform(F.filter(fitting(span, p), lambda n: at(p) + n <= F.size(words)), lambda n: entry(span, at(p), n))))

    return F.when(F.size(places) > 0, bind(F.split(text, WORD, -1), spans))


def _listed_hits(docs: DataFrame, trie: Trie) -> DataFrame:
    """Matches of all lengths at every word, found inside the row; no word is exploded."""
    lang = F.col("lang")

    def of(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: trie.nodes.has(_key(lang, F.get(words, i))))
        entry = lambda span, i, n: F.struct(i.alias("pos"), n.alias("words"), trie.surfaces.get(_key(lang, span(i, n))).alias("named"))
        fitting = lambda span, i: trie.lengths(span, i, words, lang)
        hits = bind(F.when(F.size(words) > 0, starts), lambda places: _found(F.col("text"), words, places, lambda i: i, fitting, entry))
        return F.filter(hits, lambda h: h["named"].isNotNull())

    named = F.split("named", IN_KEY)
    rows = docs.select("query_id", "doc_ord", F.inline(bind(cased_words(F.col("text")), of)))
    return rows.select("query_id", "doc_ord", "pos", "words", named[0].alias("surface"), named[1].alias("label"))


def _joined_hits(docs: DataFrame, entry: DataFrame) -> DataFrame:
    """The same for a gazetteer too large for the plan: words are joined with first words, and the spans that some
    surface's length asks for, in the pages that have any, with whole surfaces.
    """
    entry = entry.withColumn("n", F.size("parts")).withColumn("first", F.get("parts", F.lit(0))["word"])
    core = F.concat(F.col("first"), F.array_join(F.transform(F.slice("parts", F.lit(2), F.col("n") - 1), lambda p: F.concat(p["before"], p["word"])), ""))
    whole = entry.groupBy("lang", core.alias("core")).agg(F.max(F.struct("surface", "label")).alias("_m"))
    starts = entry.groupBy("lang", F.col("first").alias("word")).agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    words = docs.select("query_id", "doc_ord", "lang", F.posexplode_outer(cased_words(F.col("text"))).alias("pos", "word"))
    places = words.join(lookup_side(starts), ["lang", "word"]).groupBy("query_id", "doc_ord").agg(F.collect_list(F.struct("pos", "lengths")).alias("_at"))
    asked = lambda words: _found(
        F.col("text"), words, F.col("_at"), lambda p: p["pos"], lambda span, p: p["lengths"],
        lambda span, i, n: F.struct(i.alias("pos"), n.alias("words"), span(i, n).alias("core")),
    )
    spans = docs.join(places, ["query_id", "doc_ord"]).select("query_id", "doc_ord", "lang", F.inline(bind(cased_words(F.col("text")), asked)))
    return spans.join(lookup_side(whole), ["lang", "core"]).select("query_id", "doc_ord", "pos", "words", "_m.*")


def _overlap(a: Column, b: Column) -> Column:
    return (a["pos"] < b["pos"] + b["words"]) & (b["pos"] < a["pos"] + a["words"])


def entity_matches(docs: DataFrame, gazetteer: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``(query_id, doc_ord, pos, words, surface, label)`` for every matched span.

    Words and what stands between them must equal the surface. Of overlapping matches the longest stays, then the
    earliest; one that gave way displaces no other. Runs of overlapping matches meet in one row: a few as a rule, at most
    the matches of one page, never a keyword. Only matches are shuffled; up to ``max_listed_surfaces`` the gazetteer
    travels in the plan, beyond that it is joined.
    """
    entry = usable_gazetteer(gazetteer, params)
    pages = docs.select("query_id", "doc_ord", resource_language(F.col("lang"), params).alias("lang"), "text")
    listed = entry.limit(params.max_listed_surfaces + 1).collect()
    fits = len(listed) <= params.max_listed_surfaces and Trie.fits(listed)
    hits = _listed_hits(pages, Trie(listed)) if fits else _joined_hits(pages, entry)
    page = Window.partitionBy("query_id", "doc_ord").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("words")).over(page.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("_new", F.when(F.col("pos") < reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(page))
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("rank"), "pos", "words", "surface", "label")))
    grouped = runs.groupBy("query_id", "doc_ord", "_run").agg(best_first.alias("_hits"))
    kept = F.aggregate(
        "_hits", F.slice("_hits", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: _overlap(k, x)), acc).otherwise(F.array_append(acc, x))
    )
    return grouped.select("query_id", "doc_ord", F.inline(kept)).drop("rank")


def page_entities(matches: DataFrame) -> DataFrame:
    """Counts per page and surface, case kept; the label of the first occurrence takes them all."""
    return matches.groupBy("query_id", "doc_ord", "surface").agg(
        F.count("*").alias("n"), F.min_by("label", "pos").alias("label"), F.min("pos").alias("first_pos")
    )


def seen_entities(per_page: DataFrame) -> DataFrame:
    """``(query_id, folded, label, n, seen)``: counts per keyword, case folded, under the merged label, and the first
    spelling with its place: by page, then by count, then by position.
    """
    seen = F.struct("doc_ord", (-F.col("n")).alias("_n"), "first_pos", "surface")
    folded = per_page.groupBy("query_id", F.lower("surface").alias("folded"), merged_label(F.col("label")).alias("label"))
    return folded.agg(F.sum("n").alias("n"), F.min(seen).alias("seen"))


def entity_totals(seen: DataFrame) -> DataFrame:
    return seen.select("query_id", "folded", "label", "n")


def first_spellings(seen: DataFrame) -> DataFrame:
    """Folded surface to the spelling seen first, over all labels."""
    return seen.groupBy("query_id", "folded").agg(F.min("seen").alias("seen")).select("query_id", "folded", "seen.surface")


def named_totals(seen: DataFrame) -> DataFrame:
    """Totals under the first spelling. One pass: the spelling is the least of a folded surface's few labels."""
    least = F.min("seen").over(Window.partitionBy("query_id", "folded"))
    named = seen.select("query_id", "label", "n", least.alias("_first"))
    return named.groupBy("query_id", "label", F.col("_first.surface").alias("surface")).agg(F.sum("n").alias("n"))


def top_entities(totals: DataFrame, params: Params = DEFAULT) -> DataFrame:
    by_count = Window.partitionBy("query_id", "label").orderBy(F.desc("n"), "surface")
    return totals.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= params.entities_per_label)


def overall_entities(per_page: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return top_entities(named_totals(seen_entities(per_page)), params)
