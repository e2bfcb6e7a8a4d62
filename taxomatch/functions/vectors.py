"""Dense vector expressions over ``array<double>`` columns (JVM-side).

Spark has no built-in vector cosine; these are higher-order array functions.
A zero vector has cosine 0 with anything, never NaN (NaN would sort first in a
descending order and win every top-k).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxomatch.functions.text import col_

# Field order of the knowledge-base vectors and the names used in weight files.
FIELDS = ("task", "desc", "skill", "ofc_title", "alt_title", "tool")
WEIGHT_NAMES = ("Tasks", "Description", "Skills", "Ofc_Title", "Alt_Titles", "Tools")
# Tuned weights shipped with the reference (weights file) and
# the two sets of in-code defaults.
TUNED_WEIGHTS = {"Tasks": 0.2016842548871232, "Description": 0.10210320642916487,
                 "Skills": 0.006271551372931259, "Ofc_Title": 0.3940857582990539,
                 "Alt_Titles": 0.28978310958980824, "Tools": 0.006072119421918543}
ENGINE_WEIGHTS = {"Tasks": 0.2017, "Description": 0.1021, "Skills": 0.0063,
                  "Ofc_Title": 0.3941, "Alt_Titles": 0.2898, "Tools": 0.0061}
APP_WEIGHTS = {"Tasks": 0.0051, "Description": 0.0700, "Skills": 0.0405,
               "Ofc_Title": 0.3212, "Alt_Titles": 0.5055, "Tools": 0.0578}
SEARCH_BASELINE = (0.25, 0.20, 0.15, 0.25, 0.10, 0.05)


def as_double_array(c) -> Column:
    return col_(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col_(a), F.lit(0.0), lambda s, x: s + x * x))


def normalize(a) -> Column:
    """Unit vector; a zero vector stays zero. The norm is computed once per
    row (``array_repeat``) and zipped in: an outer expression used inside a
    lambda would be re-evaluated for every element (O(dim^2))."""
    v = col_(a)
    return F.zip_with(v, F.array_repeat(norm(v), F.size(v)),
                      lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either side has zero norm."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def scale(a, w) -> Column:
    w = w if isinstance(w, Column) else F.lit(float(w))
    return F.transform(col_(a), lambda x: x * w)


def add(a, b) -> Column:
    return F.zip_with(col_(a), col_(b), lambda x, y: x + y)


def mask_positions(a, keep_mod: int, modulus: int) -> Column:
    """Zero every position whose 0-based index mod ``modulus`` differs from
    ``keep_mod``."""
    return F.transform(col_(a), lambda x, i: F.when(i % modulus == keep_mod, x).otherwise(F.lit(0.0)))


def normalized_weights(weights: dict[str, float] | tuple) -> tuple[float, ...]:
    """``abs(w) / sum(abs(w))`` in field order; all zero stays all zero."""
    if isinstance(weights, dict):
        ws = [abs(float(weights.get(n, 0.0))) for n in WEIGHT_NAMES]
    else:
        ws = [abs(float(x)) for x in weights]
    total = sum(ws)
    return tuple(x / total for x in ws) if total > 0 else tuple(0.0 for _ in ws)
