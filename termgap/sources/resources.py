"""Language resources as lookup tables: stop words, lexicon, gazetteer, polarity, modifiers.

They stand in for statistical language models, so results differ from those of a tagger or a sentiment model. Stop words
and modifiers have defaults; lexicon, gazetteer and polarity are tables of yours, e.g. read from a folder by
``read_resources``. Joined tables are broadcast while their size is under ``spark.sql.autoBroadcastJoinThreshold``
(``session.lookup_side``) and shuffled beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from termgap.session import estimated_bytes

# Default resources.
STOP_WORDS = {
    "de": "aber als am an auf aus bei bin bis da das dass dem den der des die dies diese ein eine einem einen einer "
    "er es für hat ich im in ist man mit nach nicht noch nur oder sich sie sind und von war was wie wir zu zum "
    "zur über".split(),
    "en": "a about an and are as at be been but by can for from had has have he her his in is it its not of on or "
    "she that the their they this to was we were which will with you".split(),
    "es": "al como con de del desde el en es esta este la las le lo los más muy no o para pero por que se ser sin "
    "sobre su sus un una y ya".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et eux il je la le les leur mais ne nous on ou par pas pour "
    "que qui sa se son sur un une vous".split(),
}
KEPT_POS = ("NOUN", "VERB", "ADJ", "PROPN")
SCHEMAS = {
    "stop_words": "lang STRING, word STRING",
    "lexicon": "lang STRING, form STRING, lemma STRING, pos STRING",
    "gazetteer": "lang STRING, surface STRING, label STRING",
    "polarity": "lang STRING, word STRING, polarity DOUBLE",
    "modifiers": "lang STRING, word STRING, factor DOUBLE",
}
#: Size estimate up to which a resource is read as a list; as hash tables of the plan lists stay under their 32 MB.
LISTED_BYTES = 8 << 20
ENTITY_LABELS = ("PERSON", "ORG", "GPE", "LOC")
# Default factors of words before a polar word. Below zero they turn its polarity, above one they raise it.
MODIFIERS = [
    *(("de", word, -1.0) for word in "nicht kein keine keinen keiner keinem nie niemals ohne weder".split()),
    *(("de", word, 1.5) for word in "sehr besonders extrem äußerst wirklich überaus".split()),
    *(("de", word, 0.5) for word in "etwas kaum wenig ziemlich eher".split()),
    *(("en", word, -1.0) for word in "not no never without neither nor".split()),
    *(("en", word, 1.5) for word in "very extremely really highly especially".split()),
    *(("en", word, 0.5) for word in "slightly somewhat hardly barely rather".split()),
    *(("es", word, -1.0) for word in "no nunca jamás sin tampoco".split()),
    *(("es", word, 1.5) for word in "muy sumamente realmente especialmente".split()),
    *(("es", word, 0.5) for word in "poco algo apenas".split()),
    *(("fr", word, -1.0) for word in "pas jamais sans aucun aucune".split()),
    *(("fr", word, 1.5) for word in "très extrêmement vraiment particulièrement".split()),
    *(("fr", word, 0.5) for word in "peu assez guère".split()),
]
STOP_WORD_ROWS = [(lang, word) for lang, listed in STOP_WORDS.items() for word in listed]


def values_sql(rows: list[tuple], names: tuple[str, ...]) -> str:
    """Rows as a SQL ``VALUES`` relation. Spark knows the exact size of such a relation."""

    def literal(value):
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"CAST({value} AS DOUBLE)"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


STOP_WORDS_SQL = values_sql(STOP_WORD_ROWS, ("lang", "word"))

@dataclass
class Resources:
    """Lookup tables by language.

    ``lexicon`` is a list of (lang, form, lemma, pos), which travels in the plan with the stop words as a hash table (up
    to 32 MB a language), or a table of any size, joined. ``modifiers`` is a list of (lang, word, factor) and travels in
    the plan as well; an empty one leaves polarities as listed. The other tables are joined.
    """

    stop_words: dict[str, list[str]] = field(default_factory=lambda: STOP_WORDS)
    lexicon: list[tuple[str, str, str, str]] | DataFrame = field(default_factory=list)
    gazetteer: DataFrame | None = None
    polarity: DataFrame | None = None
    modifiers: list[tuple[str, str, float]] = field(default_factory=list)

    def lemmas(self, lang: str, min_chars: int) -> dict[str, str | None]:
        """Form to lemma for one language; None where the part of speech or the length is not kept.

        A form listed more than once counts once, as in the table form of the lookup.
        """
        ranked = sorted(((pos not in KEPT_POS, lemma, pos, form) for code, form, lemma, pos in self.lexicon if code == lang), reverse=True)
        return {
            form: lemma.lower() if pos in KEPT_POS and len(lemma) >= min_chars else None
            for _, lemma, pos, form in ranked
        }


def default_resources(spark: SparkSession) -> Resources:
    """Stop words and modifiers; every word is its own lemma, and no entity or polarity is known."""
    return Resources(
        STOP_WORDS, [], spark.createDataFrame([], SCHEMAS["gazetteer"]), spark.createDataFrame([], SCHEMAS["polarity"]), MODIFIERS
    )


def read_resources(spark: SparkSession, folder: str) -> Resources:
    """Resources of a folder: ``<kind>.csv`` (header, UTF-8) or ``<kind>.parquet`` for any kind of ``SCHEMAS``; the rest as by default.

    Rows with a null field are left out, and rows repeated count once; of a modifier listed twice the smaller factor counts. Stop words,
    modifiers and a lexicon of at most ``LISTED_BYTES`` are read as lists; a larger lexicon stays a table and is joined.
    """
    out = default_resources(spark)
    given = {kind: _read(spark, folder, kind) for kind in SCHEMAS}
    if given["stop_words"] is not None:
        words: dict[str, list[str]] = {}
        for row in _listed(given["stop_words"], "stop_words"):
            words.setdefault(row.lang, []).append(row.word)
        out.stop_words = words
    if given["modifiers"] is not None:
        listed = sorted(map(tuple, _listed(given["modifiers"], "modifiers")), reverse=True)
        out.modifiers = [(lang, word, factor) for (lang, word), factor in {(lang, word): factor for lang, word, factor in listed}.items()]
    if given["lexicon"] is not None:
        small = estimated_bytes(given["lexicon"]) <= LISTED_BYTES
        out.lexicon = [tuple(row) for row in given["lexicon"].collect()] if small else given["lexicon"]
    out.gazetteer = out.gazetteer if given["gazetteer"] is None else given["gazetteer"]
    out.polarity = out.polarity if given["polarity"] is None else given["polarity"]
    return out


def _read(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    for form in ("csv", "parquet"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}.{form}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = spark.read.schema(SCHEMAS[kind]).options(**({"header": True} if form == "csv" else {})).format(form).load(f"{folder}/{kind}.{form}")
            return rows.dropna().distinct()
    return None


def _listed(rows: DataFrame, kind: str) -> list:
    if estimated_bytes(rows) > LISTED_BYTES:
        raise ValueError(f"{kind} travel in the plan and may take {LISTED_BYTES} bytes at most")
    return rows.collect()


def shipped_stop_words(languages: dict[str, str]) -> dict[str, list[str]]:
    """The longer stop-word lists Spark ships, e.g. ``{"de": "german", "en": "english"}``."""
    from pyspark.ml.feature import StopWordsRemover

    return {code: StopWordsRemover.loadDefaultStopWords(name) for code, name in languages.items()}
