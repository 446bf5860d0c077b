"""Grade mix and VIP share after a policy case is added."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercurve.operators.grades import (
    VIP,
    grade_label,
    grade_mix_percent,
    grade_mix_ratio,
    vip_share_average,
    vip_share_by_month,
)

OLD_BASE = "base before the change"


@dataclass(frozen=True)
class WhatIf:
    """Results under the old and new policy cases, over the base of the old ones."""

    labels: DataFrame
    mix: DataFrame
    mix_percent: DataFrame
    vip_share: DataFrame
    vip_average: DataFrame


def grade_policy_whatif(
    his: DataFrame,
    policy: DataFrame,
    new_case: DataFrame,
    cases: Mapping[str, str],
    base_gb: str = "case1",
    grd_cd: int = VIP,
) -> WhatIf:
    """Relabel ``his`` with the rows of ``new_case`` added to ``policy``.

    The denominator stays the graded customers of ``base_gb`` under the old policy: its old rows
    are one more case, labelled in the same pass and left out of the results. All results are
    lazy; persist ``his`` if several of them are wanted.
    """
    old = policy.where(policy["gb"] == base_gb).withColumn("gb", F.lit(OLD_BASE))
    labels = grade_label(his, policy.unionByName(new_case).unionByName(old))
    base = {"base_gb": OLD_BASE, "hidden_base": True}
    share = vip_share_by_month(labels, grd_cd, **base)
    return WhatIf(
        labels=labels.where(F.col("gb") != OLD_BASE),
        mix=grade_mix_ratio(labels, cases, **base),
        mix_percent=grade_mix_percent(labels, cases, **base),
        vip_share=share,
        vip_average=vip_share_average(share),
    )
