"""All queries by name, and their SQL."""

from __future__ import annotations

from findweave.plans import code, context, detail, evaluation, feedback, history, lifecycle, parsing, quality, reads, records, review, spans, storage, streams, truth

_MODULES = (feedback, evaluation, spans, lifecycle, review, code, truth, records, context, streams, history, storage, parsing, quality, reads, detail)
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
