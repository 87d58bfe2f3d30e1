"""Evidence snippets in and out of JSON, tolerant of rows that older or broken writers left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("file_path", "start_line", "end_line", "quoted_text")


def _whole(entry: Column, field: str) -> Column:
    """An integer, given as a number (cut to its whole part), a truth value or digits; else null."""
    value, text = F.try_variant_get(entry, f"$.{field}", "variant"), F.try_variant_get(entry, f"$.{field}", "string")
    kind = F.schema_of_variant(value)
    digits = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("long"))
    return F.when(kind.rlike("DOUBLE|FLOAT|DECIMAL"), F.try_variant_get(entry, f"$.{field}", "double").try_cast("long")).when(kind == "BOOLEAN", (text == "true").cast("long")).otherwise(digits)


def parsed_evidence(raw: Column) -> Column:
    """The snippets of a JSON array; an entry that lacks a field or has a line that is no number is dropped alone.

    Texts that are no JSON array, and null, give an empty array, so that what rests on them is
    checked again. Further fields are ignored; a null field counts as missing.
    """
    entries = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    text = lambda e, f: F.try_variant_get(e, f"$.{f}", "string")
    value = lambda e, f: _whole(e, f) if f.endswith("_line") else text(e, f)
    snippet = lambda e: F.named_struct(*[x for f in FIELDS for x in (F.lit(f), value(e, f))])
    whole = lambda s: s["file_path"].isNotNull() & s["start_line"].isNotNull() & s["end_line"].isNotNull() & s["quoted_text"].isNotNull()
    kept = F.filter(F.transform(F.filter(entries, lambda e: F.schema_of_variant(e).startswith("OBJECT")), snippet), whole)
    return F.coalesce(kept, F.array().cast("array<struct<file_path:string,start_line:bigint,end_line:bigint,quoted_text:string>>"))


def evidence_json(snippets: Column) -> Column:
    """The JSON array that ``parsed_evidence`` reads back as the same snippets."""
    return F.coalesce(F.to_json(snippets), F.lit("[]"))
