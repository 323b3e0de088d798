"""Counts taken in the pass that makes them.

An ``Observation`` rides on the rows as they stream by: the first action
that runs the frame fills it, and no job is run for the counts alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, counts: Observation, conditions: Mapping[str, Column]) -> DataFrame:
    """``df``, whose rows and rows for which each condition holds (null: doesn't) are counted into ``counts``."""
    return df.observe(counts, F.count(F.lit(1)).alias("n_rows"),
                      *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def taken(counts: Observation) -> dict[str, int]:
    """The counts, once the frame has run; waits for a run that is under way."""
    return {k: int(v) for k, v in counts.get.items()}
