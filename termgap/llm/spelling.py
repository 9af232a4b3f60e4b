"""Spelling variants: groups of words that lead to one form by single edits, each to a much commoner word.

Words at one edit are found by bit-sliced position indexes. An index holds, for each (position, letter), the words with that
letter there as a bitset. A query reads its letters once and keeps three sets of words, 64 of them to a machine word: without
error so far, with one replaced letter (same position), and with one letter of the query skipped (positions shifted by one).

The vocabulary is dealt out so that each index is small. Let m be the length of the longer word of a pair and [a, b) a
range of its positions. If the edit lies in [a, b), both words agree in their first a and last m - b letters. So a word of
length m is filed, under what lies outside, for both halves of its positions, and for those of the length m + 1 that it may
be shortened from. A file of over FILE_WORDS words is replaced by those for the halves of its range, and these at last by
single positions, whose files hold a word for each letter at most. Nothing is cut off, and no file grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgap.llm.common import keep
from termgap.session import lookup_side

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILE_WORDS, BUCKET_WORDS = 512, 4096


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """word and n of the words of at least `min_length` letters that occur `min_count` times or more.

    A run of letters, A-Z lower-cased, whose crc32 together with the document's id is divisible by `every` loses the
    letter at that crc32 modulo its length. Shorter runs can't become words, so they are dropped at once.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(RUN.replace("+", f"{{{min_length},}}")), F.lit(0))
    of = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    of = of.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    of = of.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.length("run")))
    words = of.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _filed(words: DataFrame, ranges: Column) -> DataFrame:
    """word, m, a, b and key of each of the word's files; ranges: array of (m, a, b)."""
    of = words.select("word", F.explode(ranges).alias("r")).select("word", "r.m", "r.a", "r.b")
    rest = F.xxhash64("m", "a", "b", F.substring(F.col("word"), F.lit(1), F.col("a")), F.when(F.col("m") == F.col("b"), "").otherwise(F.substring(F.col("word"), F.col("b") - F.col("m"), F.col("m") - F.col("b"))))
    return of.withColumn("key", rest)


def _range(m: Column, a: Column, b: Column) -> Column:
    return F.struct(m.alias("m"), a.alias("a"), b.alias("b"))


def _halves(m: Column, a: Column, b: Column) -> list[Column]:
    middle = F.floor((a + b) / 2).cast("int")
    return [_range(m, a, middle), _range(m, middle, b)]


def files(words: DataFrame) -> DataFrame:
    """key, m and word of files that together hold each pair of words at one edit; none has many words."""
    n = F.length("word")
    both = F.concat(*[F.array(*_halves(m, F.lit(0), m)) for m in (n, n + 1)])
    level = _filed(words, both)
    done = []
    single = F.transform(F.sequence(F.col("a"), F.col("b") - 1), lambda i: _range(F.col("m"), i, i + 1))
    for finer in (F.array(*_halves(F.col("m"), F.col("a"), F.col("b"))), single):
        level = keep(level, "files")
        large = keep(level.groupBy("key").count().filter(F.col("count") > FILE_WORDS).select("key"), "large-files")
        if not large.limit(1).count():
            break
        done.append(level.join(lookup_side(large), "key", "left_anti"))
        level = _filed(level.join(lookup_side(large), "key", "left_semi").select("word", "m", "a", "b"), finer)
    for part in done:
        level = level.unionByName(part)
    return level.select("key", "m", "word")


def one_edit(words: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of words: i has m letters, and one replaced or skipped letter makes it j, of m or m - 1 letters."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.zeros((len(words), m), np.uint32)
    for k, word in enumerate(words):
        letters[k, : len(word)] = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    lanes = -(-len(words) // 64)

    def bits(rows: np.ndarray) -> np.ndarray:
        padded = np.zeros((*rows.shape[:-1], lanes * 64), bool)
        padded[..., : len(words)] = rows
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    asking = np.flatnonzero(size == m)
    whole, short = bits(size == m), bits(size == m - 1)
    exact = np.broadcast_to(whole | short, (len(asking), lanes)).copy()
    replaced, skipped = np.zeros_like(exact), np.zeros_like(exact)
    none, index, before = np.zeros(lanes, np.uint64), None, None
    for j in range(m):
        alphabet, own = np.unique(letters[asking, j], return_inverse=True)
        before, index = (bits(letters[:, j - 1] == alphabet[:, None]) if j else np.broadcast_to(none, (len(alphabet), lanes))), bits(letters[:, j] == alphabet[:, None])
        here, shifted = index[own], before[own]
        skipped = skipped & shifted | exact
        replaced = replaced & here | exact & ~here
        exact &= here
    found = np.unpackbits((replaced & whole | skipped & short).view(np.uint8), axis=1, bitorder="little")[:, : len(words)]
    i, j = np.nonzero(found)
    return asking[i], j


def near_pairs(words: DataFrame) -> DataFrame:
    """word and other, each pair at one edit in both orders. words: distinct column word."""
    filed = files(words)
    n = filed.count()
    filed = filed.withColumn("bucket", F.pmod("key", F.lit(max(1, -(-n // BUCKET_WORDS)))))
    schema = pa.schema([("word", pa.string()), ("other", pa.string())])

    def search(table: pa.Table) -> pa.Table:
        pairs = set()
        by: dict[int, list] = {}
        for m, word in zip(table.column("m").to_pylist(), table.column("word").to_pylist()):
            by.setdefault(m, []).append(word)
        for m, held in by.items():
            held = list(dict.fromkeys(held))
            for i, j in zip(*(x.tolist() for x in one_edit(held, m))):
                pairs |= {(held[i], held[j]), (held[j], held[i])}
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], schema=schema)

    return filed.groupBy("bucket").applyInArrow(search, "word string, other string").distinct()


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (see `vocabulary`) of the whole texts.

    n_near counts the words at one inserted, deleted or replaced letter. form is the commonest of them (ties: the smallest
    by code points) if it occurs at least `ratio` times as often, else null; root is where the forms lead to from the word.

    Null texts have no words, a null id counts as empty, repeated rows count each time, an empty table gives no rows, and
    other columns are ignored. Runs and words may be of any length.
    """
    words = keep(vocabulary(docs, min_length, min_count, every), "vocabulary")
    near = near_pairs(words.select("word")).join(words.select(F.col("word").alias("other"), "n"), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    of = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    of = of.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    of = keep(of, "forms")
    # each jump doubles the steps; n grows tenfold by a step, so a few jumps reach every root
    root = keep(of.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = root.join(on, "root", "left")
        if not further.filter("next IS NOT NULL").limit(1).count():
            break
        root = keep(further.select("word", F.coalesce("next", "root").alias("root")), "roots")
    return of.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
