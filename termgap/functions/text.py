"""Text expressions: cleaning, tokens, one- and two-word terms, term counts within a page.

All of them are row-local column expressions, so a page is tokenised and counted in the scan stage, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgap.functions.lookup import HashTable

# Patterns that read the same in Java regex and RE2.
SPACE_CHARS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
URL = rf"https?://[^{SPACE_CHARS}]+"
DIGITS = r"\p{Nd}+"
SPACES = rf"[{SPACE_CHARS}]+"
WORD = r"[\p{L}\p{N}_]+"
WORD_WITHOUT_DIGITS = r"[\p{L}\p{Nl}\p{No}_]+"
FAST_WORD = "[a-z" + WORD_WITHOUT_DIGITS[1:]  # the same words; plain letters are told by the first test
QUOTES_AND_DASH = "\"'-"
#: Words in a list of the plan, which becomes a hashed set; longer lexicons are looked up in a hash table instead.
MAX_SET_WORDS = 5000


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, DIGITS, " ")


def strip_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES_AND_DASH, " " * len(QUOTES_AND_DASH))


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, SPACES, " "), F.lit(" "))


def normalise(text: Column) -> Column:
    """The readable cleaned text: no URLs, digits, quotes or dashes, single spaces."""
    return squeeze(strip_quotes(strip_digits(strip_urls(text))))


def words(text: Column) -> Column:
    """Lower-cased word runs of the cleaned text.

    Digits, quotes and dashes separate words either way, so one URL pass and one extraction give the words of
    ``normalise`` without building the intermediate strings.
    """
    return F.regexp_extract_all(F.lower(strip_urls(text)), F.lit(FAST_WORD), F.lit(0))


def cased_words(text: Column) -> Column:
    """Word runs with case and digits kept, for entity spans."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _quoted(listed: list[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in listed)


def keep_words(column: str, stop_words: list[str], min_chars: int) -> Column:
    """Drop short words and stop words from an array column. A list of more than ten literals is a hashed set in Catalyst."""
    listed = f" AND w NOT IN ({_quoted(stop_words)})" if stop_words else ""
    return F.expr(f"filter({column}, w -> length(w) >= {min_chars}{listed})")


def keep_lemmas(column: str, stop_words: list[str], lemmas: dict[str, str | None], min_chars: int) -> Column:
    """Drop stop words, forms without a kept lemma and short unknown words; replace the listed forms.

    ``lemmas`` maps a form to its lemma, or to None where it is dropped. They and the stop words are one hash table of
    the plan, so a word costs one lookup whatever the lexicon's size. While they are few, a hashed set tells the words
    that need no lookup at all.
    """
    entries = {form: lemma or "" for form, lemma in lemmas.items()} | {word: "" for word in stop_words}
    table = HashTable(entries)
    if len(entries) > MAX_SET_WORDS:
        wanted = F.filter(column, lambda w: F.when(table.has(w), True).otherwise(F.length(w) >= min_chars))
        return F.filter(F.transform(wanted, lambda w: F.when(table.has(w), table.get(w)).otherwise(w)), lambda w: w != "")
    replaced = [form for form, lemma in entries.items() if lemma]
    short = [form for form in replaced if len(form) < min_chars]
    long_enough = f"(length(w) >= {min_chars}{f' OR w IN ({_quoted(short)})' if short else ''})"
    dropped = [form for form, lemma in entries.items() if not lemma]
    kept = F.expr(f"filter({column}, w -> {long_enough}{f' AND w NOT IN ({_quoted(dropped)})' if dropped else ''})")
    return F.transform(kept, lambda w: F.when(w.isin(replaced), table.get(w)).otherwise(w)) if replaced else kept


def by_language(language: Column, per_language: dict[str, Column], other: Column) -> Column:
    branches = F
    for lang, value in sorted(per_language.items()):
        branches = branches.when(language == lang, value)
    return branches.otherwise(other) if per_language else other


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs of an array of at least two tokens."""
    left = F.slice(tokens, F.lit(1), F.size(tokens) - 1)
    right = F.slice(tokens, F.lit(2), F.size(tokens) - 1)
    return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))


def with_term_counts(df: DataFrame, min_tokens: int) -> DataFrame:
    """Turn ``tokens`` into ``terms``, an array of (term, tf), counting run lengths of the sorted terms.

    Pages under ``min_tokens`` get no terms. That is a value, not a filter: a filter would be pushed below the
    projections and tokenise every page a second time.
    """
    return _with_runs(df.withColumn("_sorted", _sorted_terms(min_tokens))).drop("tokens")


def with_previous_terms(df: DataFrame, min_tokens: int) -> DataFrame:
    """``(query_id, term, previous)``: a row for each term of a page in sorted order, with the term before it."""
    found = df.select("query_id", _sorted_terms(min_tokens).alias("term"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("term", F.lit(1), F.greatest(F.size("term") - 1, F.lit(0))))
    rows = found.select("query_id", F.inline_outer(F.arrays_zip("term", before.alias("previous"))))
    return rows.where(F.col("term").isNotNull())


def _sorted_terms(min_tokens: int) -> Column:
    return F.sort_array(F.when(F.size("tokens") >= min_tokens, F.concat("tokens", bigrams(F.col("tokens")))))


def with_listed_counts(df: DataFrame, known, min_tokens: int) -> DataFrame:
    """The same for terms of which ``known`` holds for every token, told by a column function.

    A page of enough tokens has an array, if an empty one.
    """
    at = lambda i: F.get("tokens", i)
    places = F.when(F.size("tokens") >= min_tokens, F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: known(at(i))))
    pairs = F.filter("_places", lambda i, j: F.coalesce(F.get("_places", j + 1) == i + 1, F.lit(False)))
    terms = F.concat(F.transform("_places", at), F.transform(pairs, lambda i: F.concat(at(i), F.lit(" "), at(i + 1))))
    counted = _with_runs(df.withColumn("_places", places).withColumn("_sorted", F.sort_array(terms)))
    none = F.when(F.col("_places").isNotNull(), F.array().cast("array<struct<term:string,tf:bigint>>"))
    return counted.withColumn("terms", F.coalesce("terms", none)).drop("tokens", "_places")


def _with_runs(df: DataFrame) -> DataFrame:
    """Turn ``_sorted``, an array of terms, into ``terms``."""
    return (
        df.withColumn(
            "_starts",
            F.when(
                F.size("_sorted") > 0,
                F.filter(
                    F.sequence(F.lit(0), F.size("_sorted") - 1),
                    lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)),
                ),
            ),
        )
        .withColumn(
            "terms",
            F.transform(
                "_starts",
                lambda start, j: F.struct(
                    F.get("_sorted", start).alias("term"),
                    (F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - start).cast("bigint").alias("tf"),
                ),
            ),
        )
        .drop("_sorted", "_starts")
    )
