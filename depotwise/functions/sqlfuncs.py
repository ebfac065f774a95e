"""The age rules as SQL scalar functions for ``spark.sql`` text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from depotwise.policy import AgePolicy


def register_age_functions(spark: SparkSession, policy: AgePolicy = AgePolicy()) -> None:
    """``storage_age_multiplier(days)`` and ``storage_age_band(days)`` as SQL scalar functions.
    They inline into the calling plan; no Python runs."""

    def cases(pick) -> str:
        return " ".join(f"WHEN days > {tier[0]} THEN {pick(tier)}" for tier in policy.tiers)

    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION storage_age_multiplier(days INT) RETURNS DECIMAL(2,1) "
        f"RETURN CASE {cases(lambda t: t[1])} ELSE {policy.fresh[0]} END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION storage_age_band(days INT) RETURNS STRING "
        f"RETURN CASE {cases(lambda t: repr(t[2]))} ELSE '{policy.fresh[1]}' END"
    )
