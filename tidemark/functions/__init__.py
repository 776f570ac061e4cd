"""Column expressions; everything here stays inside the JVM."""

from tidemark.functions.columns import (
    gas_regime,
    guarded_ratio,
    one_sided,
    pct_move,
    round_half_even,
    round_half_up,
    vector_part,
    weighted_mean,
)
from tidemark.functions.text import contains_flag, exact_token_flag, keyed_values, slug

__all__ = [
    "contains_flag",
    "exact_token_flag",
    "gas_regime",
    "guarded_ratio",
    "keyed_values",
    "one_sided",
    "pct_move",
    "round_half_even",
    "round_half_up",
    "slug",
    "vector_part",
    "weighted_mean",
]
