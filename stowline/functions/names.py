"""File names and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERED = r"(?s) \([1-9][0-9]*\)(\.[^.]+)?\z"
_NUMBERED_AT_END = r"(?s) \([1-9][0-9]*\)\z"
COUNTERS = r" \([0-9]+\)"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.left(path, F.length(path) - F.length(base_name(path)) - 1)


def _after_dot(name: Column) -> Column:
    """Text after the last dot, empty if that dot starts or ends the name."""
    return F.when(F.substring(name, 2, 1 << 30).contains("."),
                  F.substring_index(name, ".", -1)).otherwise("")


def suffix(name: Column) -> Column:
    text = _after_dot(name)
    return F.when(text == "", "").otherwise(F.concat(F.lit("."), text))


def extension(name: Column) -> Column:
    return F.lower(_after_dot(name))


def scan_key(rel_path: Column) -> Column:
    """Sorts like the list of path components.

    No name holds a NUL and no byte is below it, so a folder's files sort
    directly after the folder name and before any longer sibling name. A plain
    string sorts and range-partitions faster than an array.
    """
    return F.replace(rel_path, F.lit("/"), F.lit("\u0000"))


def components(path: Column) -> Column:
    return F.split(path, "/")


def numbered(name: Column, slot: Column) -> Column:
    """Slot 0 is the name itself, slot k is ``stem (k)suffix``."""
    end = suffix(name)
    stem = F.left(name, F.length(name) - F.length(end))
    return F.when(slot == 0, name).otherwise(
        F.concat(stem, F.lit(" ("), slot.cast("string"), F.lit(")"), end))


def slots_of(name: Column) -> Column:
    """Every (base, slot) for which ``numbered(base, slot)`` is this name.

    Slot 0 of itself, and slot k of the name without its counter. A name such
    as ``y (2). (1)`` has two such bases, hence an array; a counter beyond a
    long is never reached and yields no slot.
    """
    own = F.struct(name.alias("base"), F.lit(0).cast("bigint").alias("slot"))

    def cut(tail: Column) -> Column:
        """``tail`` ends the name: a counter and perhaps a suffix."""
        digits = F.substring_index(F.substring(tail, 3, 1 << 30), ")", 1)
        end = F.substring(tail, F.length(digits) + F.lit(4), F.length(tail))
        stem = F.left(name, F.length(name) - F.length(tail))
        fits = (tail != "") & (stem != "") & ((end != "") | (suffix(stem) == ""))
        return F.struct(F.concat(stem, end).alias("base"),
                        F.when(fits, digits.try_cast("bigint")).alias("slot"))

    # The first tail is the longest; a shorter one differs only after a dot.
    tails = F.array_distinct(F.array(F.regexp_extract(name, _NUMBERED, 0),
                                     F.regexp_extract(name, _NUMBERED_AT_END, 0)))
    bases = F.filter(F.transform(tails, cut), lambda s: s["slot"].isNotNull())
    return F.when(name.contains(" ("), F.concat(F.array(own), bases)).otherwise(F.array(own))


def family(name: Column) -> Column:
    """The name without counters; a base and all its numbered names share it."""
    return F.regexp_replace(name, COUNTERS, "")
