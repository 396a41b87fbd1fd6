"""Match calendar to event indicator: flags per team, fan shares, KPI per region."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.joins import pair_with_all
from tessella.operators.series import event_kpi_shift

# Weight of a match on satellite TV, weight of any other match,
# share of the interest left when only another tracked team plays.
SKY_WEIGHT = 0.25
FULL_WEIGHT = 1.0
OTHER_TEAM_WEIGHT = 0.05
# Weight of a match by the hour it begins, and of a match at any other hour.
HOUR_WEIGHTS = {21: 2.0, 18: 0.5}
OTHER_HOUR_WEIGHT = 0.6


def game_flag(home: str, away: str, channel: str, team: str) -> Column:
    """Weight of a match for a team: 0 unless it plays."""
    plays = (F.col(home) == team) | (F.col(away) == team)
    return F.when(plays & (F.col(channel) == "SKY"), SKY_WEIGHT).when(plays, FULL_WEIGHT).otherwise(0.0)


def first_nonzero(value: Column, order: Column) -> Column:
    """Aggregate: the first non-zero value in the given order, else 0."""
    return F.coalesce(F.min_by(value, F.when(value != 0, order)), F.lit(0.0))


def match_flags(
    calendar: DataFrame,
    teams: Mapping[str, str],
    order: Sequence[str],
    ts: str = "data",
    home: str = "casa",
    away: str = "trasferta",
    channel: str = "diretta",
) -> DataFrame:
    """One row per match time with a flag per team, ``{column: team}``.

    Of several matches at the same time the first with the team in calendar order counts.
    """
    place = F.struct(*order)
    flags = [first_nonzero(game_flag(home, away, channel, team), place).alias(name) for name, team in teams.items()]
    return calendar.where(F.col(ts).isNotNull()).groupBy(ts).agg(*flags)


def _any(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [f != 0 for f in flags], F.lit(False))


def match_kpi(flags: Mapping[str, str], penalty: float = OTHER_TEAM_WEIGHT) -> Column:
    """Interest of a region in the matches of one time, ``{flag column: share column}``.

    Share times flag for a team that plays, share times ``penalty`` for a team that does not while
    another one does.
    """
    parts = []
    for flag, share in flags.items():
        others = _any([F.col(f) for f in flags if f != flag])
        parts.append(
            F.when(F.col(flag) != 0, F.col(share) * F.col(flag)).when(others, F.col(share) * penalty).otherwise(0.0)
        )
    return reduce(lambda a, b: a + b, parts)


def match_kpi_with_rank(flags: Mapping[str, str], weights: Mapping[str, str]) -> Column:
    """Share times flag times rank weight, added over the teams, ``{flag: share}`` and ``{flag: weight}``."""
    return reduce(lambda a, b: a + b, [F.col(s) * F.col(f) * F.col(weights[f]) for f, s in flags.items()])


def match_hour_weight(ts: str | Column) -> Column:
    """Weight of a match by the hour it begins."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    weights = F.create_map(*[F.lit(x) for pair in HOUR_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, F.hour(ts)), F.lit(OTHER_HOUR_WEIGHT))


def regional_kpi(
    calendar: DataFrame,
    fans: DataFrame,
    teams: Mapping[str, str],
    shares: Mapping[str, str],
    order: Sequence[str],
    region: str = "REGIONE",
    ts: str = "DATA",
    penalty: float = OTHER_TEAM_WEIGHT,
    **calendar_columns: str,
) -> DataFrame:
    """``region, ts, KPI``: indicator in the bucket before each match time.

    ``fans`` has one row per region and one share column per team.
    """
    source_ts = calendar_columns.pop("ts_column", "data")
    flags = match_flags(calendar, teams, order, ts=source_ts, **calendar_columns)
    pairs = pair_with_all(flags, fans).select(region, F.col(source_ts).alias(ts), match_kpi(shares, penalty).alias("KPI"))
    return event_kpi_shift(pairs, ts, [region], "KPI")
