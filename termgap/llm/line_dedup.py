"""Line dedup by an exact set-similarity join: lines whose token sets are alike to an earlier line's are removed."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgap.llm.common import BLANKS, identified, is_blank, keep, let, shown_id, texts, words

#: Jaccard 4/5, as integers: sizes differ by at most 5:4, and an overlap of 4/9 of both sizes is needed.
NUM, DEN = 4, 5
#: Token counts are kept in so many hashed cells; they only order tokens, so cells that words share cost speed, not lines.
CELLS = 1 << 20
#: Steps of a token's level by doubling of its cell's count. A level has seven bits, so counts up to 2^41 are told apart.
STEPS = 3
#: The bits of a token's hash that are kept.
HASH = (1 << 56) - 1
#: Earlier lines of a token's group that the window looks at: the first of all and so many before the line.
BEFORE = 3
#: The set size above which a line has the second bitmap: up to it the first one tells random sets apart.
SECOND = 60
#: Longs of the wide bitmaps, and the set size above which a line has each: near the size at which random sets would pass the narrower.
WIDE = ((4, 160), (16, 400))
#: What a line is known by: h tells apart the texts of one id.
LINE = ["doc_id", "h", "line_no"]
#: Line numbers (and eight more for each document) that may be sent to every task: 16 MB. Beyond, texts are shuffled.
SENT_NUMBERS = 4_000_000


def _spaced(text: Column) -> Column:
    """Every blank but the line feed as a space. Most texts have no other blank, and telling so costs less than replacing."""
    others = [F.lit(b) for b in BLANKS if b not in " \n"]
    return F.when(reduce(or_, [F.contains(text, b) for b in others]), reduce(lambda t, b: F.replace(t, b, F.lit(" ")), others, text)).otherwise(text)


def rarity(docs: DataFrame) -> bytes:
    """For each cell the level of the number of its tokens in all documents: CELLS bytes, whatever the input."""
    low = let(texts(docs), low=F.lower("text"))
    token = F.explode(F.split(F.replace(_spaced(F.col("low")), F.lit("\n"), F.lit(" ")), " "))
    cells = low.select(token.alias("t")).filter("t <> ''").groupBy(F.xxhash64("t").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")).count()
    level = F.least(F.lit(126), F.floor(F.log2("count") * STEPS) + 1).cast("int")
    table = cells.select("cell", level.alias("level")).toArrow()
    out = bytearray(b"\x01" * CELLS)
    for cell, n in zip(table["cell"].to_pylist(), table["level"].to_pylist(), strict=True):
        out[cell] = n
    return bytes(out)


def _hashes(words_: Column) -> Column:
    """Distinct tokens as 56 bits of their hashes."""
    return F.array_distinct(F.transform(words_, lambda t: F.xxhash64(t).bitwiseAND(F.lit(HASH))))


def _tokens(words_: Column, levels: bytes) -> Column:
    """Distinct tokens as longs that sort by rarity: the level of the token's cell, then its hash."""
    cells = F.lit(levels)

    def keyed(h: Column) -> Column:
        level = F.ascii(F.substring(cells, h.bitwiseAND(F.lit(CELLS - 1)).cast("int") + 1, F.lit(1)).cast("string"))
        # never null: longs that can be null are sorted as objects
        return F.coalesce(F.shiftleft(level.cast("long"), 56).bitwiseOR(h), F.lit(0).cast("long"))

    return F.sort_array(F.transform(_hashes(words_), keyed))


def line_sets(rows: DataFrame, levels: bytes) -> DataFrame:
    """doc_id, h, line_no (from 0) and token set of every line that has tokens."""
    low = let(rows.select("doc_id", "h", "text"), low=F.lower("text"))
    lines = low.select("doc_id", "h", F.posexplode(F.split(_spaced(F.col("low")), "\n")).alias("line_no", "line"))
    sets = lines.filter(~is_blank(F.col("line"))).select(*LINE, _tokens(F.array_remove(F.split("line", " "), ""), levels).alias("tokens"))
    return let(sets.withColumnRenamed("tokens", "t"), tokens=F.col("t")).select(*LINE, "tokens")  # a generator would sort them uncompiled


def first_lines(sets: DataFrame) -> DataFrame:
    """The first line of each token set with its size, prefix and bitmaps; all others have the same set as an earlier one.

    Two sets within the threshold share a token among the rarest n - ceil(4n/5) + 1 of either: the prefix. A bit of a
    bitmap is the parity of the tokens that hash to it, so shared tokens cancel out and two bitmaps differ in no more bits
    than the sets in tokens, however large the sets are. bits0 holds all tokens and bits1 every other, so that the two and
    their difference are bitmaps of 64 and 128 bits.
    """
    n = F.size("tokens")
    prefix = F.transform(F.slice("tokens", 1, n - F.ceil(n * NUM / DEN).cast("int") + 1), lambda t: F.hash(t))

    def bitmap(word: Column | int, longs: int) -> Column:
        mine = F.filter("tokens", lambda t: t.bitwiseAND(F.lit(64 * (longs - 1))) == 64 * word) if longs > 1 else F.col("tokens")
        bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(bit(t)))

    def wide(longs: int, least: int) -> Column:
        return F.when(n > least, F.transform(F.sequence(F.lit(0), F.lit(longs - 1)), lambda word: bitmap(word, longs)))

    wider = F.when(n > WIDE[0][1], F.concat(wide(*WIDE[0]), F.coalesce(wide(*WIDE[1]), F.array().cast("array<bigint>"))))
    rows = sets.select(
        F.xxhash64("tokens").alias("k1"), F.hash("tokens").alias("k2"), n.alias("n"),
        F.struct(*LINE, prefix.alias("prefix"), bitmap(0, 1).alias("bits0"), F.when(n > SECOND, bitmap(1, 2)).alias("bits1"), wider.alias("wide")).alias("line"),
    )
    return rows.groupBy("k1", "k2", "n").agg(F.min("line").alias("line")).select("line.*", "n")


def _may_match(a: Column | dict[str, Column], b: Column | dict[str, Column], levels: int = len(WIDE)) -> Column:
    """Length, positional and bitmap filters; none of them drops a pair within the threshold at its first shared token."""
    both = a["n"] + b["n"]
    length = F.least(a["n"], b["n"]) * DEN >= F.greatest(a["n"], b["n"]) * NUM
    overlap = 1 + F.least(a["n"] - a["pos"], b["n"] - b["pos"])
    differ0, differ1 = a["bits0"].bitwiseXOR(b["bits0"]), a["bits1"].bitwiseXOR(b["bits1"])
    most = lambda d: d * (NUM + DEN) <= both * (DEN - NUM)
    passed = most(F.bit_count(differ0)) & length & (overlap * (NUM + DEN) >= both * NUM)  # the first test fails nearly all pairs
    passed = passed & F.coalesce(most(F.bit_count(differ1) + F.bit_count(differ0.bitwiseXOR(differ1))), F.lit(True))
    return reduce(and_, [_wide_may_match(a, b, k) for k in range(levels)], passed)


def _wide_may_match(a: Column | dict[str, Column], b: Column | dict[str, Column], k: int) -> Column:
    """The filter of the k-th wide bitmap; passed where either line has none."""
    at = sum(x for x, _ in WIDE[:k])
    bits = [F.bit_count(F.get(a["wide"], F.lit(i)).bitwiseXOR(F.get(b["wide"], F.lit(i)))) for i in range(at, at + WIDE[k][0])]
    return F.coalesce(reduce(add, bits) * (NUM + DEN) <= (a["n"] + b["n"]) * (DEN - NUM), F.lit(True))


ENTRY = (*LINE, "n", "pos", "bits0", "bits1", "wide")


def _filed(first: DataFrame) -> DataFrame:
    """A row (token, ENTRY) for every prefix token of every line.

    The filters drop nothing; a join would add them to one side, and the two sides would no longer share one shuffle.
    """
    rows = first.filter("n IS NOT NULL AND bits0 IS NOT NULL")
    rows = rows.select(*LINE, "n", "bits0", "bits1", "wide", F.posexplode("prefix").alias("pos", "token"))
    return rows.filter("token IS NOT NULL").select("token", *LINE, "n", (F.col("pos") + 1).alias("pos"), "bits0", "bits1", "wide")


def _before(a: Column, b: Column) -> Column:
    same = b["doc_id"] == a["doc_id"]
    return (b["doc_id"] < a["doc_id"]) | (same & ((b["h"] < a["h"]) | ((b["h"] == a["h"]) & (b["line_no"] < a["line_no"]))))


def _meeting(filed: DataFrame) -> DataFrame:
    """The rows of `filed` under whose token there is another line that passes the filters: all that pairs are made of.

    Each row is looked for once, up to the first such line, so a group of near copies makes no pairs here. The widest
    bitmaps are left to later steps: with them the compiled join is too long to run fast.
    """
    filed = filed.repartition("token")  # renamed behind the one shuffle that both sides read
    other = filed.select(F.col("token").alias("t"), *[F.col(c).alias(f"o_{c}") for c in ENTRY])
    e, o = {c: F.col(c) for c in ENTRY}, {c: F.col(f"o_{c}") for c in ENTRY}
    mine = filed.withColumn("part", F.spark_partition_id())  # else the semi join is moved below that shuffle, and each side has one
    another = (e["line_no"] != o["line_no"]) | (e["doc_id"] != o["doc_id"]) | (e["h"] != o["h"])
    return mine.join(other, (F.col("token") == F.col("t")) & _may_match(e, o, levels=1) & another, "left_semi")


def _candidates(filed: DataFrame) -> DataFrame:
    """An earlier line (c) that passes the filters for every line that has one in a group of its tokens: the earliest found.

    The window compares a line with the group's first and the lines before it. A line that finds none there is joined
    with its whole group, so that a group of near copies, in which nearly every line finds one, makes no pairs.
    """
    filed = filed.repartition("token")  # structs are made behind the one shuffle that both sides read
    entries = filed.select("token", F.struct(*ENTRY).alias("e"))
    group = Window.partitionBy("token").orderBy(*[f"e.{x}" for x in LINE])
    seen = F.array(F.first("e").over(group), *[F.lag("e", i).over(group) for i in range(1, BEFORE + 1)])
    a = entries.select("token", "e", F.row_number().over(group).alias("nth"), seen.alias("seen"))
    near = F.filter("seen", lambda c: c.isNotNull() & _before(F.col("e"), c) & _may_match(F.col("e"), c))
    a = a.select("token", "e", (F.col("nth") > BEFORE + 1).alias("more"), F.array_min(F.transform(near, lambda c: F.struct(*[c[x].alias(x) for x in LINE]))).alias("near"))
    b = filed.select(F.col("token").alias("t"), F.struct(*ENTRY).alias("o"))
    # with the widest bitmaps too the compiled join would be over 8,000 bytes, which the JVM leaves to its interpreter; a lambda is not part of it
    e, o = F.col("e"), F.col("o")
    all_earlier = (F.col("token") == F.col("t")) & F.col("more") & F.col("near").isNull() & _may_match(e, o, levels=1) & _before(e, o)
    joined = F.filter(F.array("o"), lambda c: c.isNotNull() & _wide_may_match(e, c, 1))
    joined = F.get(F.transform(joined, lambda c: F.struct(*[c[x].alias(x) for x in LINE])), F.lit(0))
    found = a.join(b, all_earlier, "left").withColumn("c", F.coalesce("near", joined))
    return found.filter("c IS NOT NULL").groupBy(*[f"e.{x}" for x in LINE]).agg(F.min("c").alias("c"))


def _all_candidates(probes: DataFrame, filed: DataFrame) -> DataFrame:
    """Every earlier line that passes the filters for the lines of `probes`, as pairs."""
    a = filed.join(probes, LINE, "left_semi").select("token", F.struct(*ENTRY).alias("e"))
    b = filed.select(F.col("token").alias("t"), F.struct(*ENTRY).alias("o"))
    e, o = F.col("e"), F.col("o")
    pairs = b.join(a, (F.col("token") == F.col("t")) & _may_match(e, o, levels=1) & _before(e, o))
    return pairs.select(*[f"e.{x}" for x in LINE], F.struct(*[f"o.{x}" for x in LINE]).alias("c")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The probe lines of `pairs` (doc_id, h, line_no, c) that have a candidate with Jaccard of the threshold at least."""
    ends = pairs.select(*LINE).union(pairs.select(*[f"c.{x}" for x in LINE]))
    wanted = keep(ends.groupBy("doc_id", "h").agg(F.collect_set("line_no").alias("wanted")), "wanted")  # at most a document's own lines
    size = wanted.agg(F.sum(F.size("wanted") + F.lit(8))).first()[0] or 0
    rows = docs.join(F.broadcast(wanted) if size <= SENT_NUMBERS else wanted, ["doc_id", "h"])
    rows = let(rows, lines=F.split("text", "\n")).select("doc_id", "h", F.explode("wanted").alias("line_no"), "lines")
    sets = rows.select(*LINE, F.get("lines", F.col("line_no")).alias("line")).filter("line IS NOT NULL")
    sets = sets.select(*LINE, _hashes(words(F.lower("line"))).alias("tokens"))
    sets = keep(sets.groupBy(*LINE).agg(F.max("tokens").alias("tokens")), "line-sets")
    other = sets.select(F.struct(*LINE).alias("c"), F.col("tokens").alias("other"))
    both = pairs.join(other, "c").join(sets, LINE)
    shared = F.size(F.array_intersect("tokens", "other"))
    alike = shared * DEN >= (F.size("tokens") + F.size("other") - shared) * NUM
    return both.filter(alike).select(*LINE).distinct()


def kept_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h and `kept` of rows (doc_id, h, text), the sorted numbers of lines that have tokens and no earlier line alike.

    A line needs one earlier match, not all of them. Equal sets are reduced to their first line by partial aggregation.
    The rest meet in the groups of their prefix tokens. Rows without a partner there are dropped, and the earliest candidate
    found for each line is verified on the whole token sets. Lines whose candidate fails are compared with all their others.
    """
    levels = rarity(docs)
    first = keep(first_lines(line_sets(docs, levels)), "first-lines")
    met = keep(_meeting(_filed(first)), "met")
    tried = keep(_candidates(met), "tried")
    gone = keep(_verified(tried, docs), "alike")
    failed = keep(tried.join(gone, LINE, "left_anti"), "failed")
    if failed.limit(1).count():
        others = keep(_all_candidates(failed.select(*LINE), met).join(failed, [*LINE, "c"], "left_anti"), "others")
        gone = gone.union(_verified(others, docs))
    return first.join(gone, LINE, "left_anti").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line_no")).alias("kept"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with tokens), n_removed and the text that is left, for every row of `docs`.

    Tokens are lower-cased words; a line is removed if its set has Jaccard 0.8 or more with that of an earlier line (smaller doc_id, or
    same document and earlier line), whether or not that one is removed too. Lines without tokens stay.

    Null ids stay null and come first; null and empty texts give an empty text; repeated rows keep the same lines each;
    different texts without id, or under one id, are documents of their own, in order of a hash; an empty table gives no rows; other columns are
    ignored. Tokens are compared by 56-bit hashes and whole sets by 96 bits.
    """
    rows = identified(docs)
    return _without(rows, kept_lines(rows)).select(shown_id(), "n_lines", "n_removed", "text")


def _without(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (doc_id, text, …) with only the kept lines and those without tokens."""
    more = [c for c in rows.columns if c not in ("doc_id", "h", "text")]
    rows = let(rows.join(kept, ["doc_id", "h"], "left"), lines=F.split("text", "\n"))
    n = F.size("lines")
    rows = let(rows, blank=F.filter(F.sequence(F.lit(0), n - 1), lambda i: is_blank(F.get("lines", i))))
    stay = F.filter(F.coalesce("kept", F.array().cast("array<int>")), lambda i: i < n)
    rows = let(rows, stay=F.sort_array(F.array_distinct(F.concat("blank", stay))))
    text = F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    return rows.select(
        "doc_id", *more, text.alias("text"), (n - F.size("blank")).cast("long").alias("n_lines"), (n - F.size("stay")).cast("long").alias("n_removed")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with the remaining lines as text; documents that had lines and lost all of them go, others keep every column."""
    rows = identified(docs, F.struct("*").alias("_row"))
    left = _without(rows, kept_lines(rows.drop("_row"))).filter((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("_row.text"))
    return left.select(*[changed.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


