"""Classification of analyzer rules by ordered tables; the first entry that applies decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order: prefix of a ruff code, category, severity, confidence.
RUFF_PREFIXES = (
    ("E9", "correctness", "high", "high"),
    ("E722", "correctness", "medium", "high"),
    ("F821", "correctness", "high", "high"),
    ("F", "correctness", "medium", "high"),
    ("BLE", "correctness", "low", "medium"),
    ("B", "correctness", "medium", "medium"),
    ("ASYNC", "concurrency", "medium", "medium"),
    ("SIM", "maintainability", "low", "medium"),
    ("S", "security", "high", "medium"),
    ("PERF", "performance", "low", "medium"),
    ("C90", "maintainability", "low", "medium"),
    ("C4", "maintainability", "low", "high"),
    ("UP", "maintainability", "low", "high"),
    ("PTH", "maintainability", "low", "high"),
    ("RUF", "maintainability", "low", "medium"),
    ("A", "maintainability", "low", "high"),
    ("N", "style", "info", "high"),
    ("D", "style", "info", "high"),
    ("I", "style", "info", "high"),
    ("W", "style", "info", "high"),
    ("E", "style", "info", "high"),
)
RUFF_DEFAULT = ("unknown", "medium", "medium")
#: Fixed values, in order: part of a cppcheck id in lower case, category.
CPPCHECK_PARTS = (
    ("null", "memory_safety"), ("uninit", "memory_safety"), ("memleak", "resource_management"), ("leak", "resource_management"),
    ("bufferaccessoutofbounds", "memory_safety"), ("outofbounds", "memory_safety"), ("overflow", "memory_safety"), ("doublefree", "memory_safety"),
    ("dealloc", "memory_safety"), ("useafterfree", "memory_safety"), ("race", "concurrency"), ("deadlock", "concurrency"),
    ("undefined", "undefined_behavior"), ("shift", "undefined_behavior"), ("signconversion", "correctness"), ("unused", "style"),
    ("style", "style"), ("performance", "performance"), ("portability", "portability"),
)
CPPCHECK_SEVERITIES = {"error": "high", "warning": "medium", "performance": "low", "portability": "low", "style": "info", "information": "info"}
#: Fixed values, in order: prefix of a clang-tidy check in lower case, category.
CLANG_PREFIXES = (
    ("clang-analyzer-core.uninitialized", "memory_safety"), ("clang-analyzer-core.null", "memory_safety"),
    ("clang-analyzer-cplusplus.newdelete", "memory_safety"), ("clang-analyzer-unix.malloc", "memory_safety"),
    ("clang-analyzer-security", "security"), ("clang-analyzer", "undefined_behavior"), ("bugprone-use-after-move", "memory_safety"),
    ("bugprone-dangling", "memory_safety"), ("bugprone-", "correctness"), ("cert-", "security"), ("security-", "security"),
    ("concurrency-", "concurrency"), ("performance-", "performance"), ("portability-", "portability"), ("readability-", "maintainability"),
    ("modernize-", "maintainability"), ("misc-", "maintainability"), ("cppcoreguidelines-", "maintainability"),
)
CLANG_SEVERITIES = {"error": "high", "warning": "medium"}


def first_match(table: tuple, applies: Callable[[str], Column], default) -> Column:
    """The second and further fields of the first entry that applies, as a value or a struct."""
    value = lambda fields: F.lit(fields[0]) if len(fields) == 1 else F.struct(*[F.lit(f).alias(n) for f, n in zip(fields, ("category", "severity", "confidence"), strict=False)])
    chain = F
    for key, *fields in table:
        chain = chain.when(applies(key), value(fields))
    return chain.otherwise(value(default if isinstance(default, tuple) else (default,)))


def ruff_rule(code: Column) -> Column:
    return first_match(RUFF_PREFIXES, lambda p: code.startswith(p), RUFF_DEFAULT)


def cppcheck_category(error_id: Column) -> Column:
    low = F.lower(error_id)
    return first_match(CPPCHECK_PARTS, lambda p: low.contains(p), "unknown")


def clang_category(check: Column) -> Column:
    low = F.lower(check)
    return first_match(CLANG_PREFIXES, lambda p: low.startswith(p), "unknown")
