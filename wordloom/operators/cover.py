"""Greedy non-overlapping span selection (the one per-text step with a sequential rule).

Used by n-gram segmentation (SEG-1) and phrase substitution (JOIN-2): spans
arrive already sorted by priority; a span is taken when none of its word
positions is covered by a span taken before it.  The rule is inherently
sequential, so it runs as an Arrow-batched pandas UDF over the span arrays
of each text (numpy inside the task, O(total span length) per text); all
candidate generation, joining and reassembly stay in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy_mask(starts, lens) -> list[bool]:
    """Plain-Python reference of the rule (also used by tests)."""
    if starts is None or len(starts) == 0:
        return []
    s = np.asarray(starts, dtype=np.int64)
    ln = np.asarray(lens, dtype=np.int64)
    covered = np.zeros(int((s + ln).max()) + 1, dtype=bool)
    out = []
    for a, b in zip(s, s + ln):
        if covered[a:b].any():
            out.append(False)
        else:
            covered[a:b] = True
            out.append(True)
    return out


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _greedy_udf(starts: pd.Series, lens: pd.Series) -> pd.Series:
    return pd.Series([greedy_mask(s, ln) for s, ln in zip(starts, lens)])


def greedy_cover(spans: Column, start_field: str = "start", len_field: str = "n") -> Column:
    """Boolean mask over an (already priority-sorted) ``array<struct>`` of spans."""
    return _greedy_udf(F.transform(spans, lambda x: x[start_field]),
                       F.transform(spans, lambda x: x[len_field]))
