"""Running totals over an ordering that is too long for one task.

A window partitioned by year alone puts a whole year into one task. Here the ordered value
is cut into steps of fixed width. One window runs over the totals of the non-empty steps,
another over the distinct values within each step, and the two are added.

Both stay small whatever the distribution. Rows with equal values are merged first
(map-side), so a step has at most as many rows as there are distinct values in its width.
Amounts that add up to T fill at most ``2 * sqrt(T / width)`` steps, because a step far from
zero takes a large amount to fill. The steps depend on the value alone, not on a sample, so
a task that is run again puts every row where it was before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABOVE_ALL = 1 << 62
BELOW_ALL = -(1 << 62)
STEP, POINT = "_step", "_point"


def with_steps(df: DataFrame, value: str, width: float, null_step: int) -> DataFrame:
    """Add the non-null columns ``_step`` and ``_point`` that locate ``value``.

    ``null_step`` places NULL values before (``ABOVE_ALL``, descending) or after the others.
    The same ``_point`` may stand for NULL and for 0; their steps differ.
    """
    # Non-null in the plan as well: otherwise joins on the steps add null checks that reach
    # into one copy of a shared subplan, and it is computed once per copy.
    step = F.floor(F.col(value).cast("double") / F.lit(float(width)))
    step = F.coalesce(step, F.lit(null_step).cast("long"))
    point = F.coalesce(F.col(value), F.lit(0).cast(df.schema[value].dataType))
    return df.withColumns({STEP: step, POINT: point})


def cell_offsets(
    cells: DataFrame,
    part: Sequence[str],
    levels: Sequence[dict[str, str]],
    measures: Sequence[str],
) -> DataFrame:
    """For each cell, the sums of ``measures`` over the cells before it, and over all.

    ``levels`` lists the ordering from coarse to fine as ``{column: "asc" | "desc"}``; the
    columns are non-null. Adds ``<m>_before`` and ``<m>_all`` for each measure ``m``.
    """
    *outer, last = levels
    keys = [*part, *(name for level in outer for name in level)]
    order = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in last.items()]
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def within(m: str) -> Column:
        return F.coalesce(F.sum(m).over(earlier), F.lit(0))

    if not outer:
        whole = Window.partitionBy(*part)
        return cells.select(
            "*",
            *(within(m).alias(f"{m}_before") for m in measures),
            *(F.sum(m).over(whole).alias(f"{m}_all") for m in measures),
        )
    parents = cell_offsets(
        cells.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in measures)), part, outer, measures
    ).drop(*measures)
    local = cells.select("*", *(within(m).alias(f"_{m}_local") for m in measures))
    return local.join(parents, keys).select(
        *cells.columns,
        *((F.col(f"{m}_before") + F.col(f"_{m}_local")).alias(f"{m}_before") for m in measures),
        *(f"{m}_all" for m in measures),
    )


def running_totals(
    peers: DataFrame, part: Sequence[str], measures: Sequence[str], direction: str = "asc"
) -> DataFrame:
    """Running and total sums of ``measures`` by ``_point`` within ``part``.

    ``peers`` comes from ``with_steps`` followed by a ``groupBy`` on ``part``, the step and the
    point. Adds ``<m>_run`` and ``<m>_all``.
    """
    keys = [*part, STEP]
    steps = peers.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in measures))
    offsets = cell_offsets(steps, part, [{STEP: direction}], measures).drop(*measures)
    point = F.col(POINT).desc() if direction == "desc" else F.col(POINT).asc()
    up_to = (
        Window.partitionBy(*keys)
        .orderBy(point)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = peers.select("*", *(F.sum(m).over(up_to).alias(f"_{m}_local") for m in measures))
    return local.join(offsets, keys).select(
        *peers.columns,
        *((F.col(f"{m}_before") + F.col(f"_{m}_local")).alias(f"{m}_run") for m in measures),
        *(f"{m}_all" for m in measures),
    )
