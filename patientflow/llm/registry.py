"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import abuse, contamination, grouped_splits, ngrams, overlaps, packing, quantiles, tokenizer

_MODULES = (ngrams, quantiles, overlaps, grouped_splits, packing, tokenizer, contamination, abuse)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
