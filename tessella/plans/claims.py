"""Workshop claims: cleaning, one row per claim, outliers and their explanation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import clean, profile, rollup
from tessella.operators.isolation import isolation_forest
from tessella.operators.reshape import one_hot
from tessella.operators.vectors import Components, fit_components
from tessella.session import stored

# The claims that are analysed.
REGION = "Europe"
AFTER = "2019-01-01"
CLAIM_TYPES = ("ZW01", "ZW02", "ZW06")
PART_NAMES = ("-ECONOMY", "-ECONOMY50", "-E1", "-E2", "-E3")
CATEGORIES = ("claim_status", "claim_type", "product_division", "business_unit_des", "part_number_des", "cd_decision", "item_type")
KEYS = ("id_claim_hash", "cd_dealer_hash", "failure_date", "vin_hash")
NUMBERS = ("work_hours", "amount")

CLAIM_SCHEMA = (
    "id_claim_hash string, claim_type string, claim_status string, claim_status_des string, work_hours double, "
    "failure_date date, vin_hash string, product_division string, business_unit_des string, region string, country string, "
    "id_failure string, component string, component_des string, item_type string, id_causal_part_hash string, "
    "id_part_number_hash string, part_number_des string, cd_decision string, decision_des string, amount double, cd_dealer_hash string"
)


def selected_claims(
    claims: DataFrame,
    region: str = REGION,
    after: str = AFTER,
    claim_types: Sequence[str] = CLAIM_TYPES,
    part_names: Sequence[str] = PART_NAMES,
) -> DataFrame:
    """Claims of one region, after a day, of some types and parts, without duplicate rows."""
    df = clean.ensure_date(claims, "failure_date")
    df = clean.keep_after(clean.keep_equal(df, "region", region), "failure_date", after)
    df = clean.keep_in(clean.keep_in(df, "claim_type", claim_types), "part_number_des", part_names)
    return clean.distinct_rows(df)


def claim_features(
    claims: DataFrame,
    categories: Sequence[str] = CATEGORIES,
    keys: Sequence[str] = KEYS,
    numbers: Sequence[str] = NUMBERS,
    values: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """One row per claim: 0/1 per category value, totals and means. Rows with nulls are dropped first."""
    full = clean.drop_any_null(claims)
    encoded = one_hot(full.select(*keys, *categories, *numbers), categories, values)
    flags = [c for c in encoded.columns if c not in (*keys, *numbers)]
    return rollup.multi_rollup(encoded, keys, flags, numbers)


@dataclass
class ClaimOutliers:
    rows: DataFrame
    components: Components
    dropped: list[str]


def claim_outliers(
    features: DataFrame, keys: Sequence[str] = KEYS, k: int = 25, limit: float = 0.8, contamination: float = 0.01, trees: int = 100, seed: int = 42
) -> ClaimOutliers:
    """Drop columns that repeat others, project on components, mark outliers.

    The components travel beside the row they were computed from and so does the mark: nothing is joined back, and a
    claim with several rows does not fan out. Components are computed where they are needed and never stored.
    """
    features = stored(features, keys[0])  # read by every step below
    numbers = [c for c in clean.numeric_columns(features) if c not in keys]
    dropped = [r["column"] for r in profile.high_correlation(features, numbers, limit).collect()]
    kept = [c for c in numbers if c not in dropped]
    lean = features.drop(*dropped)
    fitted = fit_components(lean, kept, min(k, len(kept)))
    columns = [*keys, *[c for c in lean.columns if c not in keys]]
    point = "_" * max(map(len, columns)) + "_point"
    points = fitted.transform(lean).select(*[F.col(f"`{c}`") for c in columns], vector_to_array(F.col(fitted.output)).alias(point))
    return ClaimOutliers(isolation_forest(points, point, list(keys), contamination, trees, seed=seed, keep=columns), fitted, dropped)


def outlier_patterns(rows: DataFrame, flags: Sequence[str], value: str = "total_work_hours") -> DataFrame:
    """Combinations of flags and size class among the outliers; quantiles come from all rows."""
    outliers = profile.quantile_buckets(rows.where(F.col("anomaly") == -1), value, source=rows)
    return profile.pattern_count(outliers, [*flags, "bucket"])
