"""Vector functions: Spark column expressions and the NumPy kernels behind the Arrow paths."""

from .distance import (  # noqa: F401
    cosine,
    cosine_normalized,
    distance,
    inner_product,
    l2,
    normalize,
    quantize_int8,
    squared_norm,
    subify,
    sum_of_squares,
)
from .metrics import MAX_FLOAT32, NO_ID, Metric, check_metric  # noqa: F401
