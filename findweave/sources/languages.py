"""Parsers by language: a parser takes files and returns entries; a new language is one more item."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.sources.clike import parse_clike
from findweave.sources.repository import parse_python

Parser = Callable[[DataFrame], DataFrame]

PARSERS: Mapping[str, Parser] = {"python": parse_python, "c": parse_clike, "cpp": parse_clike}


def parsed(files: DataFrame, parsers: Mapping[str, Parser] = PARSERS) -> DataFrame:
    """Entries of files (relative_path, language, content) of every language that has a parser.

    A parser runs once over the files of all its languages. Columns that it doesn't give are null;
    files of other languages give nothing (see ``unsupported``).
    """
    if not parsers:
        raise ValueError("no parsers given")
    languages: dict[Parser, list[str]] = {}
    for language, parse in parsers.items():
        languages.setdefault(parse, []).append(language)
    parts = [parse(files.where(F.col("language").isin(*names))) for parse, names in languages.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def unsupported(files: DataFrame, parsers: Mapping[str, Parser] = PARSERS) -> DataFrame:
    """(relative_path, language) of files that no parser takes."""
    return files.where(F.col("language").isNull() | ~F.col("language").isin(*parsers)).select("relative_path", "language")
