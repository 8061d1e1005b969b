"""Operators the source expresses with windows and joins, re-expressed to
scale out: dense surrogate keys, keep-latest, dimension lookups, ranking."""

from strata.operators.joins import lookup, orphans, sized_broadcast
from strata.operators.keys import dense_key, keep_latest
from strata.operators.topk import rank_filter, top_k

__all__ = ["dense_key", "keep_latest", "lookup", "orphans", "sized_broadcast", "rank_filter", "top_k"]
