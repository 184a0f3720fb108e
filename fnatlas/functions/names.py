"""Names and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that compilers add, names and prefixes of runtime functions.
COMPILER_SUFFIXES = r"(\.constprop\.[0-9]+|\.isra\.[0-9]+|\.part\.[0-9]+|\.cold(\.[0-9]+)?|\.localalias(\.[0-9]+)?)+$"
RUNTIME_NAMES = ("_start", "init", "fini", "_init", "_fini")
RUNTIME_PREFIXES = r"^(\.|\$|__|_ITM_|_Unwind_|_GLOBAL_|deregister_tm_clones|register_tm_clones|frame_dummy|call_weak_fn)"
NO_SECTION = ("UND", "ABS", "COM")


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.trim(name), "@", 1), COMPILER_SUFFIXES, "")


def is_analysis_function(name: Column, size: Column, section: Column) -> Column:
    return (name != "") & (size > 0) & ~section.isin(*NO_SECTION) & ~name.isin(*RUNTIME_NAMES) & ~name.rlike(RUNTIME_PREFIXES)


def version_key(version: Column) -> Column:
    """Numbers of the dotted parts, after the last '-'; a part that isn't a number is 0."""
    parts = F.split(F.substring_index(version, "-", -1), r"\.")
    return F.transform(parts, lambda p: F.coalesce(F.when(p.rlike("^[0-9]+$"), p.cast("int")), F.lit(0)))


def version_key3(version: Column) -> Column:
    return F.slice(F.concat(version_key(version), F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 3)


def _v(*parts: int) -> Column:
    return F.array(*map(F.lit, parts))


def range_label(version: Column) -> Column:
    """1 from 1.16.0 to 1.33.1, 0 from 1.34.0, else null."""
    k = version_key3(version)
    return F.when((k >= _v(1, 16, 0)) & (k <= _v(1, 33, 1)), 1).when(k >= _v(1, 34, 0), 0)


def split_name(version: Column) -> Column:
    """train up to 1.30.1, validation from 1.31.0 to 1.33.2, test from 1.34.0; gaps are null."""
    k = version_key3(version)
    return F.when(k <= _v(1, 30, 1), "train").when((k >= _v(1, 31, 0)) & (k <= _v(1, 33, 2)), "validation").when(k >= _v(1, 34, 0), "test")
