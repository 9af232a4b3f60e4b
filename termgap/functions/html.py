"""Main text of a page, as row-local column expressions.

A page is cut at its structural tags, and a fold over these keeps the stack of open elements: what stands inside a
dropped element, at any depth, goes, and an element that is never closed ends with the element around it. The remaining
tags and character references are resolved afterwards.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from termgap.functions.lookup import HashTable, bind

# Elements without text of the page. The content of the first group is not markup and ends at its first closing tag.
RAW_ELEMENTS = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")
DROPPED_BLOCKS = ("head", "nav", "header", "footer", "aside", "form", "noscript", "table")
DROPPED_INLINE = ("select", "datalist", "option", "button", "svg")
STRUCTURE = ("html", "body", "main", "article", "section", "div")
# Words of a class that mark an element as no part of the main text.
DROPPED_CLASSES = ("ad", "ads", "comments")

NO_MARKUP = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(rf"{e}(?:[\s/][^>]*)?>.*?(?:</{e}\s*>|\z)" for e in RAW_ELEMENTS) + ")"
STRUCTURAL_TAG = rf"(?i)</?(?:{'|'.join(STRUCTURE + DROPPED_BLOCKS + DROPPED_INLINE)})(?:[\s/][^>]*)?>"
TAG_NAME = "^</?([a-z0-9]+)"
DROPPED_CLASS = rf"""\sclass\s*=\s*("[^"]*\b({'|'.join(DROPPED_CLASSES)})\b|'[^']*\b({'|'.join(DROPPED_CLASSES)})\b|({'|'.join(DROPPED_CLASSES)})[\s>])"""
BREAKING_TAG = r"(?i)</?(p|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|blockquote|pre|figure|figcaption)(?:[\s/][^>]*)?>"
ANY_TAG = r"<[a-zA-Z/!?][^>]*>"
BLANKS = r"[ \t\r\x{00A0}]+"
LINE_ENDS = r" ?\n[ \n]*"

REFERENCE = r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]{1,31})(;?)"
NAMED = HashTable(html5)
#: What the code points 128 to 159 stand for in references and in pages that call themselves Latin-1.
WINDOWS_1252 = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))
UNKNOWN = "�"

STATE = "struct<open:array<string>,level:int,begin:int,inline:boolean,cuts:array<struct<a:int,b:int,inline:boolean>>>"


def _tag(raw: Column) -> Column:
    """What the fold needs of a structural tag."""
    low = F.lower(raw)
    name = F.regexp_extract(low, TAG_NAME, 1)
    shut = F.startswith(low, F.lit("</"))
    inline = name.isin(*DROPPED_INLINE)
    return F.struct(
        name.alias("name"), shut.alias("shut"), (~shut & ~F.endswith(low, F.lit("/>"))).alias("opens"), inline.alias("inline"),
        (name.isin(*DROPPED_BLOCKS) | inline | low.rlike(DROPPED_CLASS)).alias("drops"),
    )


def _step(state: Column, tag: Column) -> Column:
    """The state after tag ``tag.x`` with number ``tag.i``.

    open: names of the open elements, innermost first. level: how many are open, with it, around the outermost dropped
    one, 0 outside of any. cuts: tag numbers (a, b) between which the text is dropped. A closing tag closes the innermost
    element of its name and all inside it, but none around an open table, unless it closes the table itself or the page.
    """
    x, i = tag["x"], tag["i"]
    at, table = F.array_position(state["open"], x["name"]), F.array_position(state["open"], "table")
    within = (table == 0) | (at <= table) | x["name"].isin("table", "body", "html")
    closed = F.when(x["shut"] & within, at).otherwise(F.lit(0)).cast("int")
    nothing = F.array().cast("array<string>")
    rest = F.when(x["opens"] & (x["name"] == "body"), nothing).otherwise(F.slice(state["open"], closed + 1, F.size(state["open"])))

    def after(rest: Column) -> Column:
        ended = (state["level"] > 0) & (F.size(rest) < state["level"])
        level = F.when(ended, F.lit(0)).otherwise(state["level"])
        begins = (level == 0) & x["opens"] & x["drops"]
        cut = F.array(F.struct(state["begin"].alias("a"), i.alias("b"), state["inline"].alias("inline")))
        return F.struct(
            F.when(x["opens"], F.concat(F.array(x["name"]), rest)).otherwise(rest).alias("open"),
            F.when(begins, F.size(rest) + 1).otherwise(level).alias("level"),
            F.when(begins, i).otherwise(state["begin"]).alias("begin"),
            F.when(begins, x["inline"]).otherwise(state["inline"]).alias("inline"),
            F.when(ended, F.concat(state["cuts"], cut)).otherwise(state["cuts"]).alias("cuts"),
        ).cast(STATE)

    return bind(rest, after)


def _kept(parts: Column, cuts: Column) -> Column:
    """The parts outside the cuts: lines of their own, but an inline element leaves a blank. cuts: (from, to, inline) of kept parts."""
    piece = lambda c: F.concat(
        F.when(c["inline"], F.lit(" ")).otherwise(F.lit("\n")), F.array_join(F.slice(parts, c["a"] + 1, F.greatest(F.lit(0), c["b"] - c["a"] + 1)), "\n")
    )
    return F.array_join(F.transform(cuts, piece), "")


def body_text(html: Column) -> Column:
    """The page without what its dropped elements hold and without structural tags."""

    def folded(page: Column) -> Column:
        tags = F.transform(F.transform(page["tags"], _tag), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        start = F.struct(
            F.array().cast("array<string>").alias("open"), F.lit(0).alias("level"), F.lit(0).alias("begin"), F.lit(False).alias("inline"),
            F.array().cast("array<struct<a:int,b:int,inline:boolean>>").alias("cuts"),
        ).cast(STATE)
        return bind(F.aggregate(tags, start, _step), lambda state: _kept(page["parts"], runs(page, state)))

    def runs(page: Column, state: Column) -> Column:
        """(from, to, inline) of the kept parts; inline tells how the run is parted from what stands before it."""
        n = F.size(page["tags"])
        last = F.when(state["level"] > 0, F.array(F.struct(state["begin"].alias("a"), n.alias("b"), state["inline"].alias("inline")))).otherwise(F.array().cast("array<struct<a:int,b:int,inline:boolean>>"))

        def between(cuts: Column) -> Column:
            first = F.coalesce(F.get(cuts, F.lit(0))["a"], n)
            others = F.transform(cuts, lambda c, k: F.struct((c["b"] + 1).alias("a"), F.coalesce(F.get(cuts, k + 1)["a"], n).alias("b"), c["inline"].alias("inline")))
            return F.concat(F.array(F.struct(F.lit(0).alias("a"), first.alias("b"), F.lit(False).alias("inline"))), others)

        return bind(F.concat(state["cuts"], last), between)

    def cut(clean: Column) -> Column:
        return bind(F.struct(F.split(clean, STRUCTURAL_TAG).alias("parts"), F.regexp_extract_all(clean, F.lit(STRUCTURAL_TAG), F.lit(0)).alias("tags")), folded)

    return F.when(html.isNotNull(), bind(F.regexp_replace(html, NO_MARKUP, " "), cut))


def character(code: Column) -> Column:
    """The character of a code point, as pages mean it."""
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    windows = F.substring(F.lit(WINDOWS_1252), code.cast("int") - 127, F.lit(1))
    wrong = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(wrong, F.lit(UNKNOWN)).when(code.between(128, 159), windows).otherwise(plain)


def _reference(token: Column) -> Column:
    """What follows an ampersand, with the reference at its start resolved; as it was, with the ampersand, if it has none."""

    def resolved(r: Column) -> Column:
        name = r["name"]
        code = F.when(r["hex"], F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 9))
        value = F.when(F.startswith(name, F.lit("#")), character(code.try_cast("bigint"))).otherwise(NAMED.get(F.concat(name, r["end"])))
        rest = F.substring(token, F.length(name) + F.length(r["end"]) + 1, F.length(token))
        return F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), token))

    name = F.regexp_extract(token, REFERENCE, 1)
    of = F.struct(name.alias("name"), F.regexp_extract(token, REFERENCE, 2).alias("end"), F.lower(F.left(name, F.lit(2))).eqNullSafe("#x").alias("hex"))
    return bind(of, resolved)


def decode_references(text: Column) -> Column:
    """Named, decimal and hexadecimal character references resolved in one pass, so that none is resolved twice."""
    parts = F.transform(F.split(text, "&"), lambda token, i: F.when(i == 0, token).otherwise(_reference(token)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def main_text(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(body_text(html), BREAKING_TAG, "\n"), ANY_TAG, "")
    text = bind(text, decode_references)
    text = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), LINE_ENDS, "\n")
    return F.btrim(text, F.lit(" \n"))
