"""Quality rules: a rule bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per
failed rule. Versioned policies are bit masks over that ledger, and ablations are bitwise
aggregates of it, so neither reads a text again. DataFrame functions only.

Defined results: a null text is the text without words; an empty text fails ``few_words``;
repeated rows are judged alike, each on its own; an empty table gives an empty ledger; other
columns of the input never take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule of each bit, from bit 0.
RULES = ("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "word_length", "upper_case")
#: Policy versions: the rules whose failure rejects a document.
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": ("few_words", "repeated_windows", "symbol_heavy"), "v2": ("few_words", "repeated_windows", "symbol_heavy", "word_length", "upper_case"), "v3": RULES}
CURRENT_POLICY = "v2"

SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Above so many comparisons (windows x repeated windows) positions are found by sorting.
_SCAN_LIMIT = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a variable, so that lambdas in it don't evaluate it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _removed(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are in ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found at least twice in the text.

    Windows are compared by 64-bit hashes. The positions of repeated windows are looked up in
    the list of repeated hashes, or, where that would be long work, read off a sort.
    """

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")), lambda a: a["n"])

    def by_sort(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda p: F.filter(p, lambda x, k: F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"]))
        return let(pairs, lambda p: covered(F.sort_array(F.transform(twice(p), lambda x: x["i"]))))

    def body(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        repeated = lambda h: let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
        by_scan = lambda h, d: covered(F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(d, F.get(h, i))))
        return let(
            hashes,
            lambda h: let(
                repeated(h),
                lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long")).when(F.size(d).cast("long") * F.size(h) <= _SCAN_LIMIT, by_scan(h, d)).otherwise(by_sort(h)),
            ),
        )

    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(words, body))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and failure bits of each document: one row per input row.

    ``keep`` names input columns to carry along beside ``doc_id``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), *[F.col(k) for k in keep if k != id_col], text.alias("__text"))
    blank = F.lit(_BLANKS)
    trimmed = F.btrim(F.col("__text"), blank)
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: F.length(F.btrim(x, blank)) > 0)
    measured = base.select(
        "*",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words"))).alias("__w"),
        (F.length("__text") - _removed(F.col("__text"), _BLANKS)).cast("long").alias("word_chars"),
        _removed(F.col("__text"), _SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("__l"),
        _removed(F.col("__text"), _UPPER).cast("long").alias("n_upper"),
    )
    flat = measured.select(
        "doc_id", *[k for k in keep if k != id_col], F.col("__w.n_words").alias("n_words"), "word_chars", "n_symbols",
        F.col("__l.n_dup_lines").alias("n_dup_lines"), F.col("__w.n_repeat_words").alias("n_repeat_words"), F.col("__l.n_lines").alias("n_lines"), "n_upper",
    )
    c = F.col
    failed = {
        "few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbol_heavy": 100 * c("n_symbols") > 10 * c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "word_length": (c("n_words") > 0) & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        "upper_case": 2 * c("n_upper") > c("word_chars"),
    }
    mask = F.lit(0)
    for bit, rule in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(failed[rule], F.lit(1 << bit)).otherwise(F.lit(0)))
    return flat.withColumn("failed_mask", mask)


def policy_mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy, given by version or as rule names."""
    return sum(1 << RULES.index(rule) for rule in (POLICIES[policy] if isinstance(policy, str) else policy))


def fails(policy: str | tuple[str, ...], mask: str = "failed_mask") -> Column:
    return F.col(mask).bitwiseAND(F.lit(policy_mask(policy))) != 0


def apply_policy(ledger_df: DataFrame, policy: str = CURRENT_POLICY) -> DataFrame:
    """The ledger with ``base_failed`` (policy "base") and ``kept`` (``policy`` on top of it)."""
    base = fails("base")
    return ledger_df.withColumn("base_failed", base).withColumn("kept", ~(base | fails(policy)))


def ablations(ledger_df: DataFrame, policy: str = CURRENT_POLICY) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept when it is dropped.

    One aggregation over the stored bits; no text is read.
    """
    bits, mask = F.col("failed_mask"), policy_mask(policy)
    rows = []
    for rule in POLICIES[policy]:
        bit = 1 << RULES.index(rule)
        rows.append(
            F.struct(
                F.lit(rule).alias("rule"),
                F.count_if(bits.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
                F.count_if(bits.bitwiseAND(F.lit(mask)) == bit).alias("n_failed_alone"),
                F.count_if(bits.bitwiseAND(F.lit(mask & ~bit)) == 0).alias("n_kept_without"),
            )
        )
    return ledger_df.agg(F.array(*rows).alias("r"), F.count("*").alias("n_docs"), F.bit_or("failed_mask").alias("seen_mask")).select(F.explode("r").alias("r"), "n_docs", "seen_mask").select("r.*", "n_docs", "seen_mask")


def reject(docs: DataFrame, policy: str = CURRENT_POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text_in"))
    kept = apply_policy(ledger(packed, "__id", "__text_in", keep=("__row",)), policy).where("kept")
    return kept.select("__row.*")


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_mask")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_policy(ledger(docs)).select(*COLUMNS)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) AS n_upper
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT + 8 * (100 * n_dup_lines > 30 * n_lines)::INT
    + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::INT + 32 * (2 * n_upper > word_chars)::INT)::INT AS failed_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_mask & 3) <> 0 AS base_failed, (failed_mask & 55) = 0 AS kept, failed_mask FROM b
"""
