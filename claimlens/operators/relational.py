"""Relational operators: stacking, roll-up and the equi-joins of the claims model.

All operators are lazy ``DataFrame -> DataFrame`` functions; no action inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.exact import MONEY_SUM

AMT = "InscClaimAmtReimbursed"
DED = "DeductibleAmtPaid"


# J1
def union_claims(*parts: DataFrame) -> DataFrame:
    """Stack claim tables by column name; columns missing on one side become NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_non_null(col: str, order_cols: tuple[str, ...]) -> Column:
    """First non-NULL value of ``col`` in the order given by ``order_cols``.

    The order key is completed with the value itself so that ties resolve to the
    same row on every engine and on every task retry.
    """
    key = F.struct(*[F.col(o) for o in order_cols], F.col(col).alias("v"))
    return F.min(F.when(F.col(col).isNotNull(), key))["v"]


# A1
def claim_rollup(lines: DataFrame, order_cols: tuple[str, ...] = ("ClaimSource", "LineNo")) -> DataFrame:
    """One row per ClaimID: summed money, first provider/member, date envelope."""
    cols = set(lines.columns)
    aggs = [
        F.coalesce(F.sum(AMT), F.lit(0)).cast(MONEY_SUM).alias(AMT),
        F.coalesce(F.sum(DED), F.lit(0)).cast("decimal(22,4)").alias(DED),
        first_non_null("Provider", order_cols).alias("Provider"),
        first_non_null("BeneID", order_cols).alias("BeneID"),
    ]
    for name, fn in (("AdmissionDt", F.min), ("DischargeDt", F.max), ("ClaimStartDt", F.min), ("ClaimEndDt", F.max)):
        if name in cols:
            aggs.append(fn(name).alias(name))
    return lines.groupBy("ClaimID").agg(*aggs)


# J2
def label_left_claims(labels: DataFrame, claims: DataFrame, key: str = "Provider") -> DataFrame:
    """Label table LEFT JOIN claims: every labelled provider kept, labels fan out.

    As an outer join that preserves the small label table a hot provider's claims would
    stay in one task. Claims are inner-joined instead (the planner broadcasts a label
    table that it has measured to be small; otherwise skewed partitions of claims can be
    split), and labelled providers without claims are added with an anti-join.
    """
    matched = claims.join(labels, key, "inner")
    providers = claims.select(key).where(F.col(key).isNotNull()).distinct()
    unmatched = labels.join(providers, key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True).select(
        key, *[c for c in labels.columns if c != key], *[c for c in claims.columns if c != key])


# J3
def claims_left_beneficiary(claims: DataFrame, beneficiary: DataFrame, key: str = "BeneID") -> DataFrame:
    return claims.join(beneficiary, key, "left")


# J4
def claims_enriched(claims: DataFrame, beneficiary: DataFrame, labels: DataFrame) -> DataFrame:
    return claims.join(beneficiary, "BeneID", "left").join(labels, "Provider", "left")


# J5
def stats_join_back(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Attach per-group statistics to every row (AQE picks broadcast or sort-merge)."""
    return df.join(stats, key, "left")


# J9
def membership_filter(df: DataFrame, col: str, values) -> DataFrame:
    """Keep rows whose ``col`` is in ``values`` (a list, or a one-column DataFrame)."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(keys, col, "left_semi")
    return df.where(F.col(col).isin(list(values)))


# J10
def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose foreign key has no parent (NULL keys are not orphans)."""
    parent_key = parent_key or child_key
    keys = parent.select(F.col(parent_key).alias("__pk")).distinct()
    return (child.where(F.col(child_key).isNotNull())
            .join(keys, F.col(child_key) == F.col("__pk"), "left_anti"))


# J11
def union_results(*frames: DataFrame) -> DataFrame:
    return union_claims(*frames)


# J12
def provider_profile_lookup(df: DataFrame, profiles: DataFrame, key: Column, profile_key: str = "provider_id") -> DataFrame:
    """Attach the (fixed, eight-row) provider profile table; broadcast is size-safe."""
    return df.join(F.broadcast(profiles), key == F.col(profile_key), "left")
