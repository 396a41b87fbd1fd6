"""Weekly device measurements to three-hour series per province, and their forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import clean, matches, rollup, series
from tessella.operators.forecast import one_step_forecast
from tessella.operators.joins import left_enrich
from tessella.operators.reshape import wide_days_to_long
from tessella.sources import literals

ID_PARTS = ("APPARATO", "CATEGORIA", "ID_MISURE_ATTESTAZIONE")
LINES = ("LINEE RES", "LINEE BUS", "LINEE WHO")
LIMITS = ("CAPACITA", "SOGLIA GIALLA", "SOGLIA ROSSA")
DOWN = {"MAX_DS": "MAX DS", "INTERVALLO_MAX_DS": "INTERVALLO MAX DS", "TIPO_GIORNO_DS": "TIPO GIORNO DS"}
UP = {"MAX_US": "MAX US", "INTERVALLO_MAX_US": "INTERVALLO MAX US", "TIPO_GIORNO_US": "TIPO GIORNO US"}
FLAGS = {"SOPRA_SOGLIA_GIALLA": "SOGLIA GIALLA", "SOPRA_SOGLIA_ROSSA": "SOGLIA ROSSA", "SOPRA_CAPACITA": "CAPACITA"}
DAY_TYPES = {"FER": 0, "FES": 1}


def device_weeks(raw: DataFrame, least: float = 0.75, period: Sequence[str] = ()) -> DataFrame:
    """Valid, mostly residential devices that are present in every week, with their key ``ID``.

    ``period`` names further key columns, such as ``month`` when several months are read at once.
    """
    df = clean.drop_equal(raw, "FLAG MISURA MANCANTE", "Y")
    df = df.withColumns({c: C.to_number(f"`{c}`") for c in LINES})
    df = clean.drop_null_in(df, [*LINES, "PROVINCIA"])
    df = clean.keep_major_share(df, "LINEE RES", LINES, least).drop(*LINES)
    df = clean.with_composite_id(df, ID_PARTS)
    if not period:
        return rollup.present_in_all_periods(df, "ID", ["ID", "PROVINCIA"])
    counts = df.groupBy(*period, "ID", "PROVINCIA").agg(F.count("*").alias("_n"))
    most = counts.groupBy(*period).agg(F.max("_n").alias("_n"))
    return df.join(counts.join(most, [*period, "_n"]).select(*period, "ID").distinct(), [*period, "ID"], "left_semi")


def device_days(weeks: DataFrame, measures: Mapping[str, str] = DOWN, keep: Sequence[str] = ()) -> DataFrame:
    """One row per device and day with numbers and the 0/1 marks of the limits."""
    value, clock, _ = measures
    long = wide_days_to_long(weeks, [*keep, "ID", "PROVINCIA", *LIMITS], measures)
    long = clean.drop_zero_text(long, value)
    long = long.withColumns({c: C.decimal_comma(f"`{c}`") for c in (value, *LIMITS)})
    long = clean.with_threshold_flags(long, value, FLAGS).drop(*LIMITS)
    return long.withColumn("DATA", series.build_timestamp("DATA", clock))


def province_buckets(days: DataFrame, provinces: DataFrame, kpi: DataFrame, value: str = "MAX_DS", day_type: str = "TIPO_GIORNO_DS") -> DataFrame:
    """Three-hour sums per province and day type with region and match indicator, the training table."""
    buckets = series.tumble(days, "DATA", ["PROVINCIA", day_type], [value, *FLAGS])
    codes = F.create_map(*[F.lit(x) for pair in DAY_TYPES.items() for x in pair])
    buckets = buckets.withColumn(day_type, F.try_element_at(codes, F.col(day_type)))
    joined = left_enrich(left_enrich(buckets, provinces, ["PROVINCIA"]), kpi, ["REGIONE", "DATA"])
    return clean.fill_constant(joined, 0)


def calendar_kpi(calendar: DataFrame, fans: DataFrame, order: Sequence[str], penalty: float = matches.OTHER_TEAM_WEIGHT) -> DataFrame:
    """``REGIONE, DATA, KPI`` from the match calendar; province code NP is read as NA."""
    codes = {c: C.recode(c, {"NP": "NA"}) for c in ("casa_prov", "trasferta_prov") if c in calendar.columns}
    fixed = calendar.withColumns(codes) if codes else calendar
    return matches.regional_kpi(fixed, fans, literals.TEAMS, literals.TEAM_SHARES, order, penalty=penalty)


def traffic_features(raw: DataFrame, provinces: DataFrame, kpi: DataFrame, period: Sequence[str] = ()) -> DataFrame:
    """From raw device-weeks to the training table."""
    return province_buckets(device_days(device_weeks(raw, period=period)), provinces, kpi)


def traffic_forecast(features: DataFrame, **options) -> DataFrame:
    """Scaled series of every province and the predicted next bucket of the test part."""
    return one_step_forecast(series.series_for_key(features), **options)
