"""Ordered vocabularies and the columns built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
STRENGTHS = ("weak", "medium", "strong")
#: Relationships of context to its target: base score, in order of precedence on equal scores (fixed values).
RELATIONSHIPS = {
    "target_symbol": 1.00,
    "tests_target_file": 0.55,
    "direct_caller": 0.50,
    "direct_callee": 0.50,
    "parent_symbol": 0.45,
    "import_dependency": 0.30,
    "include_dependency": 0.30,
    "sibling_symbol": 0.20,
    "transitive_caller": 0.25,
    "transitive_callee": 0.25,
}
#: Relationships that a finding's category favours (fixed values).
FAVOURED = {
    "memory_safety": ("direct_caller", "direct_callee"),
    "resource_management": ("direct_caller", "direct_callee"),
    "concurrency": ("direct_caller", "direct_callee"),
    "api_misuse": ("direct_callee", "import_dependency", "include_dependency"),
    "correctness": ("tests_target_file",),
}
SAME_FILE, CHANGED_LINE, PER_HOP, FAVOUR = 0.10, 0.15, 0.05, 0.08
#: Reaction content -> hint.
REACTION_HINTS = {
    "+1": "positive_hint", "heart": "positive_hint", "hooray": "positive_hint", "-1": "negative_hint", "confused": "negative_hint",
    "eyes": "neutral_attention", "laugh": "uninterpreted", "rocket": "uninterpreted",
}


def rank(value: Column, scale: tuple[str, ...]) -> Column:
    """Position in the scale from 0; null for other values."""
    return F.nullif(F.array_position(F.array(*map(F.lit, scale)), value).cast("int") - 1, F.lit(-1))


def at_rank(number: Column, scale: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, scale)), number)


def at_least(value: Column, minimum: str, scale: tuple[str, ...]) -> Column:
    return rank(value, scale) >= scale.index(minimum)


def looked_up(value: Column, table: dict, default=None) -> Column:
    """A literal map's entry for the value."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(default))


def severity_as_expected(found: Column, exact: Column, low: Column, high: Column) -> Column:
    """Equal to the exact expectation, else within its bounds; missing bounds don't bind."""
    r = lambda c: rank(c, SEVERITIES)
    return F.when(exact.isNotNull(), found == exact).otherwise(F.coalesce(r(found) >= r(low), F.lit(True)) & F.coalesce(r(found) <= r(high), F.lit(True)))


def settled_confidence(reviewer: Column, decision: Column, lowered: Column, corroborated: Column) -> Column:
    """Confidence after the critic and static corroboration: one step up, never past the critic's own."""
    ceiling = F.when(decision == "downgrade", rank(lowered, CONFIDENCES))
    now = F.coalesce(ceiling, rank(reviewer, CONFIDENCES))
    raised = F.least(now + 1, F.lit(len(CONFIDENCES) - 1))
    return at_rank(F.when(corroborated & (ceiling.isNull() | (raised <= ceiling)), raised).otherwise(now), CONFIDENCES)


def relationship_score(relationship: Column, same_file: Column, changed: Column, distance: Column, category: Column) -> Column:
    """Score with its labelled components: struct(score, breakdown)."""
    favoured = F.lit(False)
    for name, wanted in FAVOURED.items():
        favoured = favoured | ((category == name) & relationship.isin(*wanted))
    part = lambda label, value, holds: F.when(holds, F.struct(F.lit(label).alias("label"), value.cast("double").alias("value")))
    parts = F.array_compact(
        F.array(
            part("relationship", looked_up(relationship, RELATIONSHIPS, 0.0), F.lit(True)),
            part("same_file", F.lit(SAME_FILE), same_file),
            part("changed_line", F.lit(CHANGED_LINE), changed),
            part("distance", -PER_HOP * (distance - 1), distance > 1),
            part("category", F.lit(FAVOUR), favoured),
        )
    )
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["value"])
    return F.struct(F.greatest(F.lit(0.0), F.round(total, 6)).alias("score"), parts.alias("breakdown"))


def rate(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, or ``empty`` where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(float(empty)))


def f1(p: Column, r: Column) -> Column:
    return rate(2 * p * r, p + r, 0.0)
