from panelwright.functions.entities import compose, normalize_name, split_child, split_parent
from panelwright.functions.numeric import (
    clip_zero,
    finite_or_null,
    nan_to_null,
    over_nonzero,
    parity_round,
    ratio,
    scaled,
)
from panelwright.functions.periods import period_key, period_label, period_ord, with_periods
from panelwright.functions.quantiles import exact_quantiles

__all__ = [
    "clip_zero", "compose", "exact_quantiles", "finite_or_null", "nan_to_null",
    "normalize_name", "over_nonzero", "parity_round", "period_key", "period_label",
    "period_ord", "ratio", "scaled", "split_child", "split_parent", "with_periods",
]
