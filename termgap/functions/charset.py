"""Page bytes to text: the charset is what the response header says, else a meta tag, else what the bytes allow."""

from __future__ import annotations

from encodings.aliases import aliases

from pyspark.sql import Column
from pyspark.sql import functions as F

from termgap.functions.html import WINDOWS_1252
from termgap.functions.lookup import HashTable, bind

# Charsets with one byte for a character; where the name of a narrower set is used, pages mean the wider one.
ONE_BYTE = (
    "cp866", "cp874", "cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258",
    "iso8859_2", "iso8859_3", "iso8859_4", "iso8859_5", "iso8859_6", "iso8859_7", "iso8859_8", "iso8859_10", "iso8859_13",
    "iso8859_14", "iso8859_15", "iso8859_16", "koi8_r", "koi8_u", "mac_roman", "mac_cyrillic",
)
WIDER = {"ascii": "cp1252", "latin_1": "cp1252", "iso8859_9": "cp1254", "iso8859_11": "cp874", "tis_620": "cp874"}

IN_HEADER = r"""charset\s*=\s*["']?\s*([a-z0-9_:.\-]+)"""
IN_META = r"""<meta\s[^>]*charset\s*=\s*["']?\s*([a-z0-9_:.\-]+)"""
META_BYTES = 1024
BOM = b"\xef\xbb\xbf"
UPPER_HALF = "".join(map(chr, range(128, 256)))
MARKS = "-_.:"


def _plain(label: str) -> str:
    return label.translate(str.maketrans("", "", MARKS))


def _upper_half(codec: str) -> str:
    """What the bytes from 128 on stand for; those that a charset leaves open are read as controls."""
    return "".join(bytes([n]).decode(codec, "ignore") or chr(n) for n in range(128, 256))


def _labels() -> dict[str, str]:
    """Names of charsets, without the marks inside them, and their upper halves."""
    named = {name: name for name in (*ONE_BYTE, *WIDER)} | {alias: codec for alias, codec in aliases.items() if codec in ONE_BYTE or codec in WIDER}
    named |= {f"iso_{codec[3:]}": codec for codec in (*ONE_BYTE, *WIDER) if codec.startswith("iso")}
    named |= {f"windows_{codec[2:]}": codec for codec in ONE_BYTE if codec.startswith("cp1") or codec == "cp874"}
    return {_plain(name): _upper_half(WIDER.get(codec, codec)) for name, codec in named.items()}


CHARSETS = HashTable(_labels())


def declared_charset(content: Column, content_type: Column) -> Column:
    """The label in the header, else in a meta tag of the first 1,024 bytes; null if there is none."""
    start = F.lower(F.decode(F.substring(content, 1, META_BYTES), "ISO-8859-1"))
    label = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(label(F.lower(content_type), IN_HEADER), label(start, IN_META))


def decode_body(content: Column, content_type: Column) -> Column:
    """A page's text. No byte sequence fails: what UTF-8 can't read is replaced where UTF-8 is declared, and read as
    Windows-1252 where nothing or an unknown charset is.
    """
    utf8 = F.when(F.startswith(content, F.lit(BOM)), F.substring(content, F.lit(4), F.length(content))).otherwise(content).cast("string")

    def read(x: Column) -> Column:
        one_byte = F.call_function("translate", F.decode(content, "ISO-8859-1"), F.lit(UPPER_HALF), x["upper"])
        as_utf8 = F.startswith(content, F.lit(BOM)) | x["label"].isin("utf8", "unicode11utf8") | (x["upper"].isNull() & F.is_valid_utf8(utf8))
        other = F.translate(F.decode(content, "ISO-8859-1"), UPPER_HALF[:32], WINDOWS_1252)
        return F.when(as_utf8, F.make_valid_utf8(utf8)).when(x["upper"].isNotNull(), one_byte).otherwise(other)

    label = F.coalesce(F.translate(declared_charset(content, content_type), MARKS, ""), F.lit(""))
    return F.when(content.isNotNull(), bind(label, lambda of: bind(F.struct(of.alias("label"), CHARSETS.get(of).alias("upper")), read)))
