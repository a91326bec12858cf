"""Transforms that are fitted on training rows and applied, unchanged, to any rows."""

from tunekit.operators.prep.base import Fitted, Prep
from tunekit.operators.prep.buckets import QuantileBuckets
from tunekit.operators.prep.clip import CLIP_METHODS, Clip, clip_method_index
from tunekit.operators.prep.fill import Fill
from tunekit.operators.prep.power import Power
from tunekit.operators.prep.rbf import RadialBasis
from tunekit.operators.prep.scale import MinMax, Standardize

__all__ = [
    "CLIP_METHODS",
    "Clip",
    "Fill",
    "Fitted",
    "MinMax",
    "Power",
    "Prep",
    "QuantileBuckets",
    "RadialBasis",
    "Standardize",
    "clip_method_index",
]
