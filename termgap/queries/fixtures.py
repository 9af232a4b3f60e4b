"""Language resources for the test tables, whose words are invented: examples for the registered queries and their oracle."""

from __future__ import annotations

from pyspark.sql import SparkSession

from termgap.sources.resources import STOP_WORDS, Resources, values_sql

LEXICON = [
    ("de", "ersch", "ersch", "ADV"),
    ("de", "enung", "enun", "NOUN"),
    ("de", "erung", "erun", "NOUN"),
    ("de", "lich", "lich", "ADV"),
    ("de", "erheit", "heit", "NOUN"),
    ("de", "ietzte", "ietzen", "VERB"),
    ("en", "orantion", "orant", "NOUN"),
    ("en", "inoran", "orant", "NOUN"),
    ("en", "hehely", "hehely", "ADV"),
    ("en", "thing", "thin", "VERB"),
    ("en", "ered", "ere", "VERB"),
    ("en", "than", "than", "ADP"),
    ("en", "thes", "th", "NOUN"),
    ("es", "mente", "mente", "ADV"),
    ("es", "ciónas", "ción", "NOUN"),
    ("es", "ciónos", "ción", "NOUN"),
    ("es", "ñado", "ñar", "VERB"),
    ("fr", "ment", "ment", "ADV"),
    ("fr", "èaux", "èal", "ADJ"),
    ("fr", "éeaux", "éeau", "NOUN"),
    ("fr", "elle", "elle", "PRON"),
]
GAZETTEER = [
    ("de", "Erachtz", "PER"),
    ("de", "Ietzte Stteen", "ORG"),
    ("de", "Erachtz Ietzte Stteen", "ORG"),
    ("de", "Enststung", "LOC"),
    ("de", "Enunger", "GPE"),
    ("de", "Heit", "MISC"),
    ("de", "Nicht aulich für sch", "ORG"),
    ("de", "erüver enau sch der", "LOC"),
    ("de", "sch der", "ORG"),
    ("de", "die, dieerzuer", "GPE"),
    ("de", "heit. Enunger", "ORG"),
    ("en", "Orre", "ORG"),
    ("en", "Orre Orre Orre", "GPE"),
    ("en", "Eriner thanea", "PERSON"),
    ("en", "Eriner", "PERSON"),
    ("en", "Thon", "LOC"),
    ("en", "Ther", "GPE"),
    ("en", "ther", "LOC"),
    ("en", "Tion", "ORG"),
    ("es", "Asción", "ORG"),
    ("es", "CIÓN", "ORG"),
    ("es", "Ción", "LOC"),
    ("es", "Ascirr para", "PERSON"),
    ("es", "Ciónue que", "GPE"),
    ("fr", "Reoié", "PERSON"),
    ("fr", "Réleou eauoué", "ORG"),
    ("fr", "Enmentai Réleou eauoué", "ORG"),
    ("fr", "Aich", "LOC"),
    ("fr", "aich", "LOC"),
    ("fr", "Éeuxier", "GPE"),
]
POLARITY = [
    ("de", "achte", 0.5),
    ("de", "heit", 0.25),
    ("de", "keit", 0.75),
    ("de", "ench", -0.5),
    ("de", "erte", -0.25),
    ("de", "enen", -1.0),
    ("en", "thing", 0.5),
    ("en", "thin", 1.0),
    ("en", "thou", 0.25),
    ("en", "rewh", -0.75),
    ("en", "orre", -0.5),
    ("en", "thble", 0.125),
    ("en", "eron", -0.25),
    ("es", "ción", 0.5),
    ("es", "mente", -0.5),
    ("es", "osue", 0.75),
    ("es", "ciónas", -0.25),
    ("fr", "ment", 0.5),
    ("fr", "elle", 0.25),
    ("fr", "tion", -0.5),
    ("fr", "éque", -0.25),
    ("fr", "aich", 1.0),
]
MODIFIERS = [
    ("de", "nicht", -1.0),
    ("de", "sch", 1.5),
    ("de", "und", 0.5),
    ("en", "er", -1.0),
    ("en", "of", 1.5),
    ("en", "and", 0.5),
    ("es", "no", -1.0),
    ("es", "con", 0.5),
    ("fr", "pas", -1.0),
    ("fr", "les", 1.5),
]

LEXICON_SQL = values_sql(LEXICON, ("lang", "form", "lemma", "pos"))
GAZETTEER_SQL = values_sql(GAZETTEER, ("lang", "surface", "label"))
POLARITY_SQL = values_sql(POLARITY, ("lang", "word", "polarity"))
MODIFIERS_SQL = values_sql(MODIFIERS, ("lang", "word", "factor"))


def resources(spark: SparkSession) -> Resources:
    """The example tables with the default stop words; polarities as listed, without modifiers."""
    return Resources(STOP_WORDS, LEXICON, spark.sql(GAZETTEER_SQL), spark.sql(POLARITY_SQL))
