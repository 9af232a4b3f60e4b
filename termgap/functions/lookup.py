"""Fixed tables looked up inside the row: a hash table as a literal of the plan, without a join."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT, ENTRY, VALUE = "\x01", "\x02", "\x03"
#: A literal travels with every task, so tables beyond this are meant to be joined.
MAX_LITERAL_BYTES = 32 << 20


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


class HashTable:
    """String to string. A lookup reads one slot, which holds about one entry whatever the table's size.

    The slots are one split string literal, which the optimizer turns into an array once per plan.
    """

    def __init__(self, entries: dict[str, str]):
        self.slots = 1
        while self.slots < len(entries):
            self.slots *= 2
        slots: list[list[str]] = [[] for _ in range(self.slots)]
        for key, value in sorted(entries.items()):
            if any(c in key + value for c in (SLOT, ENTRY, VALUE)):
                raise ValueError(f"{key!r} holds a separator")
            slots[crc32(key.encode()) % self.slots].append(f"{ENTRY}{key}{VALUE}{value}{ENTRY}")
        self.text = SLOT.join("".join(slot) for slot in slots)
        if len(self.text.encode()) > MAX_LITERAL_BYTES:
            raise ValueError(f"a table in the plan holds at most {MAX_LITERAL_BYTES} bytes; join it instead")

    def _slot(self, key: Column) -> Column:
        return F.get(F.split(F.lit(self.text), SLOT), F.pmod(F.crc32(key), F.lit(self.slots)).cast("int"))

    def has(self, key: Column) -> Column:
        return F.contains(self._slot(key), F.concat(F.lit(ENTRY), key, F.lit(VALUE)))

    def get(self, key: Column) -> Column:
        """The key's value, null if the table does not have it."""
        found = bind(F.struct(self._slot(key).alias("slot"), F.concat(F.lit(ENTRY), key, F.lit(VALUE)).alias("key")), _entry)
        return found if self.text else F.lit(None).cast("string")


def _entry(x: Column) -> Column:
    after = F.substring_index(F.call_function("substring_index", x["slot"], x["key"], F.lit(-1)), ENTRY, 1)
    return F.when(F.contains(x["slot"], x["key"]), after)
