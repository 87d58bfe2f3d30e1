"""Text and hashing columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case, white space (Unicode's) collapsed to single spaces, ends trimmed."""
    return F.lower(squeezed(text))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def estimated_tokens(chars: Column) -> Column:
    """A quarter of the characters, rounded up; nothing for nothing."""
    return F.when(chars <= 0, F.lit(0)).otherwise(F.floor((chars + 3) / 4)).cast("long")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; a null part counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def explicit_command(body: Column, prefix: str, tokens: tuple[str, ...] = ("useful", "false-positive", "fixed", "ignore")) -> Column:
    """The command token, if the trimmed body is exactly ``prefix`` and one of ``tokens``."""
    said = F.btrim(body, F.lit(" \t\r\n"))
    return F.when(said.startswith(prefix) & F.substring(said, len(prefix) + 1, 1 << 20).isin(*tokens), F.substring(said, len(prefix) + 1, 1 << 20))


#: Secret shapes, in the order in which they are replaced; group 1 is the value, if any.
SECRET_SHAPES = (
    ("pem_private_key", r"(?s)-----BEGIN (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----", False),
    ("github_token", r"\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}\b", False),
    ("aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", False),
    ("aws_secret_access_key", r"(?i)(\b(?:aws_secret_access_key|aws-secret-access-key)\s*[:=]\s*['\"]?)([A-Za-z0-9/+=]{40})(['\"]?)", True),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", False),
    ("labeled_secret_assignment", r"(?i)(\b[A-Z0-9_]*(?:SECRET|API_KEY|APIKEY|PASSWORD|PRIVATE_KEY|ACCESS_TOKEN|AUTH_TOKEN)[A-Z0-9_]*\s*[:=]\s*['\"])([A-Za-z0-9/+._=-]{16,})(['\"])", True),
)
REDACTED = "[REDACTED]"


def redacted(text: Column, shapes=SECRET_SHAPES) -> Column:
    """The text with secrets masked; of labelled ones, the value alone."""
    for _, pattern, labelled in shapes:
        text = F.regexp_replace(text, pattern, f"$1{REDACTED}$3" if labelled else REDACTED)
    return text


def secret_counts(text: Column, shapes=SECRET_SHAPES) -> dict[str, Column]:
    """Matches per shape, each counted in the text that the shapes before it have left."""
    out = {}
    for name, pattern, labelled in shapes:
        out[name] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, f"$1{REDACTED}$3" if labelled else REDACTED)
    return out


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def safe_relative_path(path: Column) -> Column:
    """Not empty, not absolute, no backslash or drive, and no "..", "." or empty segment."""
    parts = F.split(path, "/")
    return F.coalesce((F.length(path) > 0) & ~path.startswith("/") & ~path.contains("\\") & ~path.rlike("^[A-Za-z]:") & ~F.exists(parts, lambda p: p.isin("..", ".", "")), F.lit(False))


def module_of(path: Column) -> Column:
    """Dotted module of a Python path; a package's __init__ is the package."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def qualified(*names: Column, separator: str = ".") -> Column:
    return F.concat_ws(separator, *names)


def masked_url(text: Column) -> Column:
    """URLs without the credentials between scheme and host."""
    return F.regexp_replace(text, r"(https?://)[^/@\s]+@", "$1***@")


#: Fixed value: what ends a line of source text.
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def split_lines(content: Column) -> Column:
    """The lines of a text; a final line break ends the last line, and an empty text has none."""
    parts = F.split(content, LINE_BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def range_lines(lines: Column, start: Column, end: Column) -> Column:
    """The lines of a range, cut at the end of the file; null if the range doesn't begin in the file."""
    inside = (start >= 1) & (start <= F.size(lines)) & (end >= start)
    return F.when(inside, F.slice(lines, start, F.least(end, F.size(lines)) - start + 1))


def window_lines(content: Column, start: Column, end: Column, max_lines: int, anchor: Column | None = None) -> Column:
    """(start, end, text, truncated) of a line range cut to ``max_lines`` around the anchor.

    Null if the range doesn't begin in the text.
    """
    lines = split_lines(content)
    hi = F.least(end, F.size(lines))
    at = F.coalesce(anchor, start) if anchor is not None else start
    first = F.greatest(start, F.least(F.greatest(start, at - F.lit(max_lines // 2)), hi - F.lit(max_lines - 1)))
    long = hi - start + 1 > max_lines
    a, b = F.when(long, first).otherwise(start), F.when(long, first + F.lit(max_lines - 1)).otherwise(hi)
    return F.when((start >= 1) & (a <= b), F.struct(a.alias("start"), b.alias("end"), F.array_join(F.slice(lines, a, b - a + 1), "\n").alias("text"), long.alias("truncated")))
