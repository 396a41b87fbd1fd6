"""Traffic: events stand in for device measurements, event types for provinces.

A device is a user, its line counts are its small, middle and large events, a purchase is a match.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalog.base import Tables, query, rounded
from tessella.functions import columns as C
from tessella.operators import clean, joins, matches, reshape, rollup, scan, series, streams
from tessella.plans import traffic as plan
from tessella.sources import literals

DAY_TYPE = "CASE WHEN isodow(%s) >= 6 THEN 'FES' ELSE 'FER' END"


def day_type(ts: str):
    return F.when(F.weekday(ts) >= 5, "FES").otherwise("FER")


# one row per device, province and day: the largest value, its time and the type of the day
LONG = f"""
    SELECT user_id, event_type, CAST(ts AS DATE) AS day, value, strftime(ts, '%H:%M') AS clock, {DAY_TYPE % 'ts'} AS day_type
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY value DESC, ts, event_id) = 1"""


def daily_peaks(t: Tables) -> DataFrame:
    best = F.min_by(F.struct("value", F.date_format("ts", "HH:mm").alias("clock")), F.struct(-F.col("value"), F.col("ts"), F.col("event_id")))
    daily = t.events.groupBy("user_id", "event_type", F.col("ts").cast("date").alias("day")).agg(best.alias("b"))
    return daily.select("user_id", "event_type", "day", "b.value", "b.clock", day_type("day").alias("day_type"))


def event_days(t: Tables) -> list[date]:
    first, last = t.events.agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def device_weeks_raw(t: Tables) -> DataFrame:
    """The raw table: one row per device, province and week, three text columns per day, decimal commas."""
    peaks = daily_peaks(t).select(
        F.col("user_id").cast("string").alias("APPARATO"), F.col("event_type").alias("PROVINCIA"),
        F.trunc("day", "week").alias("WEEK"), "day",
        F.regexp_replace(F.col("value").cast("string"), r"\.", ",").alias("MAX_DS"), F.col("clock").alias("INTERVALLO_MAX_DS"),
        F.col("day_type").alias("TIPO_GIORNO_DS"),
    )
    wide = reshape.long_to_wide_days(peaks, ["APPARATO", "PROVINCIA", "WEEK"], "day", plan.DOWN, event_days(t))
    v = F.col("value")
    lines = t.events.groupBy(F.col("user_id").cast("string").alias("APPARATO")).agg(
        F.count_if(v < 80).cast("string").alias("LINEE RES"), F.count_if((v >= 80) & (v < 200)).cast("string").alias("LINEE BUS"),
        F.count_if(v >= 200).cast("string").alias("LINEE WHO"), F.when(F.max("value") > 350, "Y").alias("FLAG MISURA MANCANTE"),
    )
    fixed = {
        "CATEGORIA": F.lit("-A-"), "ID_MISURE_ATTESTAZIONE": F.lit("1"),
        "CAPACITA": F.lit("150,0"), "SOGLIA GIALLA": F.lit("50,0"), "SOGLIA ROSSA": F.lit("100,5"),
    }
    return wide.join(lines, "APPARATO").withColumns(fixed).withColumn("WEEK", F.col("WEEK").cast("string"))


DEVICES = """
    SELECT user_id FROM (
        SELECT user_id, count(*) FILTER (value < 80) AS res, count(*) AS n, max(value) AS top FROM events GROUP BY 1)
    WHERE top <= 350 AND res / n >= 0.75"""
DAYS = f"""
    WITH long AS ({LONG}), kept AS (SELECT * FROM long WHERE user_id IN ({DEVICES})),
    weeks AS (SELECT user_id, event_type, count(DISTINCT date_trunc('week', day)) AS n FROM kept GROUP BY 1, 2),
    full_ids AS (SELECT user_id FROM weeks WHERE n = (SELECT max(n) FROM weeks))
    SELECT user_id || '-A-1' AS "ID", event_type AS "PROVINCIA", value AS "MAX_DS", clock AS "INTERVALLO_MAX_DS", day_type AS "TIPO_GIORNO_DS",
           CAST(day || ' ' || clock AS TIMESTAMP) AS "DATA", CASE WHEN 50 < value THEN 1 ELSE 0 END AS "SOPRA_SOGLIA_GIALLA",
           CASE WHEN 100.5 < value THEN 1 ELSE 0 END AS "SOPRA_SOGLIA_ROSSA", CASE WHEN 150 < value THEN 1 ELSE 0 END AS "SOPRA_CAPACITA"
    FROM kept WHERE user_id IN (SELECT user_id FROM full_ids)"""
TEAM_NAMES = ("Juventus", "Inter", "Milan", "Roma", "Napoli")
CALENDAR = """
    SELECT event_id, date_trunc('hour', ts) AS data, CAST(floor(k / 20) AS INTEGER) AS home, CAST(floor((99 - k) / 20) AS INTEGER) AS away,
           CASE WHEN value < 20 THEN 0.25 ELSE 1.0 END AS weight
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'purchase')"""
FLAGS = f"""
    SELECT data, {", ".join(
        f"coalesce(CAST(arg_min(weight, event_id) FILTER (home = {i} OR away = {i}) AS DOUBLE), 0) AS {c}"
        for i, c in enumerate(literals.TEAMS))}
    FROM ({CALENDAR}) GROUP BY data"""
SEGMENTS = dict(zip(literals.FAN_COLUMNS, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
FANS = f"""
    SELECT r_name AS "REGIONE", {", ".join(f"CAST(count(*) FILTER (c_mktsegment = '{s}') AS DOUBLE) / count(*) AS {c}" for c, s in SEGMENTS.items())}
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""


def _kpi_sql(penalty: float) -> str:
    parts = []
    for flag, share in literals.TEAM_SHARES.items():
        others = " OR ".join(f"{f} <> 0" for f in literals.TEAM_SHARES if f != flag)
        parts.append(f"CASE WHEN {flag} <> 0 THEN {share} * {flag} WHEN {others} THEN {share} * {penalty}::DOUBLE ELSE 0.0 END")
    return " + ".join(parts)


PAIRS = f"""SELECT "REGIONE", data AS "DATA", {_kpi_sql(0.05)} AS "KPI" FROM ({FLAGS}) CROSS JOIN ({FANS})"""
KPI = f"""
    SELECT DISTINCT "REGIONE", time_bucket(INTERVAL '3 hours', "DATA" + INTERVAL 1 HOUR) - INTERVAL 3 HOUR AS "DATA", round("KPI", 8) AS "KPI"
    FROM ({PAIRS})"""


def calendar(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*[F.lit(n) for n in TEAM_NAMES])
    team = lambda i: names[F.floor(i / 20).cast("int")]
    return t.events.where("event_type = 'purchase'").select(
        "event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("data"), team(k).alias("casa"), team(99 - k).alias("trasferta"),
        F.when(F.col("value") < 20, "SKY").otherwise("DAZN").alias("diretta"),
    )


def fans(t: Tables) -> DataFrame:
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return homes.groupBy(F.col("r_name").alias("REGIONE")).agg(
        *[(F.count_if(F.col("c_mktsegment") == s).cast("double") / F.count("*")).alias(c) for c, s in SEGMENTS.items()]
    )


def kpi(t: Tables) -> DataFrame:
    found = plan.calendar_kpi(calendar(t), fans(t), ["event_id"])
    return rounded(found, ["KPI"], 8).distinct()


# fixed values: the region of each stand-in province; sign-ups have none
PROVINCE_KEYS = {"click": 0, "error": 1, "purchase": 2, "view": 3}


def provinces(t: Tables) -> DataFrame:
    codes = C.recode("r_regionkey", {v: k for k, v in PROVINCE_KEYS.items()}, keep=False)
    return t.region.select(F.col("r_name").alias("REGIONE"), codes.alias("PROVINCIA")).where(F.col("PROVINCIA").isNotNull())


FEATURES = f"""
    WITH days AS ({DAYS}), b AS (
        SELECT time_bucket(INTERVAL '3 hours', "DATA") AS "DATA", "PROVINCIA", CASE "TIPO_GIORNO_DS" WHEN 'FER' THEN 0 ELSE 1 END AS "TIPO_GIORNO_DS",
               sum("MAX_DS") AS "MAX_DS", CAST(sum("SOPRA_SOGLIA_GIALLA") AS BIGINT) AS "SOPRA_SOGLIA_GIALLA",
               CAST(sum("SOPRA_SOGLIA_ROSSA") AS BIGINT) AS "SOPRA_SOGLIA_ROSSA", CAST(sum("SOPRA_CAPACITA") AS BIGINT) AS "SOPRA_CAPACITA",
               count(*) AS "N_APPARATI" FROM days GROUP BY 1, 2, 3)
    SELECT b.*, coalesce(p."REGIONE", '0') AS "REGIONE", coalesce(k."KPI", 0) AS "KPI" FROM b
    LEFT JOIN (SELECT r_name AS "REGIONE", CASE r_regionkey WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'view' END AS "PROVINCIA"
               FROM region) p ON p."PROVINCIA" = b."PROVINCIA"
    LEFT JOIN ({KPI}) k ON k."REGIONE" = p."REGIONE" AND k."DATA" = b."DATA\""""


def features(t: Tables) -> DataFrame:
    return plan.traffic_features(device_weeks_raw(t), provinces(t), kpi(t))


@query(FEATURES.replace("SELECT b.*,", 'SELECT b.* REPLACE (round("MAX_DS", 4) AS "MAX_DS"),'))
def traffic_features(t: Tables) -> DataFrame:
    return rounded(features(t), ["MAX_DS"])


@query(DAYS)
def device_days(t: Tables) -> DataFrame:
    """Raw weeks through the filters for validity, line share and presence, then one row per day."""
    return plan.device_days(plan.device_weeks(device_weeks_raw(t)))


@query(f"""SELECT user_id || '' AS "APPARATO", event_type AS "PROVINCIA", day AS "DATA", CAST(value AS VARCHAR) AS "MAX_DS",
           clock AS "INTERVALLO_MAX_DS", day_type AS "TIPO_GIORNO_DS" FROM ({LONG})""")
def wide_to_long(t: Tables) -> DataFrame:
    """Long rows spread to day columns and gathered again."""
    long = reshape.wide_days_to_long(device_weeks_raw(t), ["APPARATO", "PROVINCIA"], plan.DOWN)
    return long.withColumn("MAX_DS", C.decimal_comma("MAX_DS").cast("string"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5 AS value FROM events WHERE json_extract_string(props, '$.k') <> '0'")
def decimal_comma(t: Tables) -> DataFrame:
    """Text ``'0'`` is dropped before text with a decimal comma is read as number."""
    text = clean.drop_zero_text(t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")), "k")
    return text.select("event_id", C.decimal_comma(F.concat("k", F.lit(",5"))).alias("value"))


WEEK_ROWS = "SELECT DISTINCT user_id, event_type, CAST(date_trunc('week', ts) AS DATE) AS week FROM events"


@query(f"""
    WITH w AS ({WEEK_ROWS}), c AS (SELECT user_id, event_type, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT * FROM w WHERE user_id IN (SELECT user_id FROM c WHERE n = (SELECT max(n) FROM c))""")
def present_in_all_periods(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", F.trunc("ts", "week").alias("week")).distinct()
    return rollup.present_in_all_periods(rows, "user_id", ["user_id", "event_type"])


@query(f"""
    SELECT time_bucket(INTERVAL '3 hours', ts) AS ts, event_type, {DAY_TYPE % 'ts'} AS day_type, round(sum(value), 4) AS value,
           CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS over, count(*) AS n
    FROM events GROUP BY ALL""")
def tumble_3h(t: Tables) -> DataFrame:
    rows = t.events.select("ts", "event_type", day_type("ts").alias("day_type"), "value", C.over_threshold(F.lit(100), "value").alias("over"))
    return rounded(series.tumble(rows, "ts", ["event_type", "day_type"], ["value", "over"], count="n"), ["value"])


@query(f"""
    SELECT time_bucket(INTERVAL '3 hours', ts) AS ts, event_type, {DAY_TYPE % 'ts'} AS day_type, round(sum(value), 4) AS value, count(*) AS n
    FROM events GROUP BY ALL""")
def tumble_3h_stream(t: Tables) -> DataFrame:
    """The events as a stream of files through three-hour windows, until all are closed."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    rows = stream.select("ts", "event_type", day_type("ts").alias("day_type"), "value")
    closed, _ = streams.tumbled(rows, "ts", ["event_type", "day_type"], ["value"], t.new_folder("stream"), count="n")
    return rounded(closed, ["value"])


GRID = """
    WITH m AS (SELECT user_id, time_bucket(INTERVAL '3 hours', ts) AS ts, round(sum(value), 4) AS value, avg(value) AS mean, max(event_type) AS kind FROM events GROUP BY 1, 2),
    g AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL '3 hours')) AS ts FROM m GROUP BY 1)"""


@query(f"{GRID} SELECT user_id, ts, round(coalesce(value, 0), 4) AS value FROM g LEFT JOIN m USING (user_id, ts)")
def resample_sum(t: Tables) -> DataFrame:
    return rounded(series.resample(t.events, "ts", ["user_id"], "value"), ["value"])


@query(f"{GRID} SELECT user_id, ts, round(mean, 6) AS value FROM g LEFT JOIN m USING (user_id, ts)")
def resample_mean(t: Tables) -> DataFrame:
    return rounded(series.resample(t.events, "ts", ["user_id"], "value", how="mean"), ["value"], 6)


@query(f"{GRID} SELECT user_id, ts FROM g")
def regular_grid(t: Tables) -> DataFrame:
    buckets = t.events.select("user_id", C.bucket_start("ts").alias("ts"))
    return series.regular_grid(buckets, "ts", ["user_id"])


def user_series(t: Tables) -> DataFrame:
    merged = t.events.groupBy("user_id", C.bucket_start("ts").alias("ts")).agg(F.round(F.sum("value"), 4).alias("value"), F.max("event_type").alias("kind"))
    return series.on_grid(merged, "ts", ["user_id"])


@query(f"""{GRID} SELECT user_id, ts, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS kind
       FROM g LEFT JOIN m USING (user_id, ts)""")
def forward_fill(t: Tables) -> DataFrame:
    return series.forward_fill(user_series(t), ["kind"], ["user_id"], "ts").select("user_id", "ts", "kind")


@query(f"""{GRID} SELECT user_id, ts, round(coalesce(value, 0), 4) AS value,
           round(coalesce(lead(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY ts), 0), 4) AS pred FROM g LEFT JOIN m USING (user_id, ts)""")
def lead_target(t: Tables) -> DataFrame:
    rows = user_series(t).select("user_id", "ts", F.coalesce("value", F.lit(0.0)).alias("value"))
    return rounded(series.lead_target(rows, "value", ["user_id"], "ts", "pred"), ["value", "pred"])


@query(f"""{GRID} SELECT user_id, ts, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 9) AS value FROM (
           SELECT user_id, ts, coalesce(value, 0) AS v, min(coalesce(value, 0)) OVER (PARTITION BY user_id) AS lo,
                  max(coalesce(value, 0)) OVER (PARTITION BY user_id) AS hi FROM g LEFT JOIN m USING (user_id, ts))""")
def min_max_scale(t: Tables) -> DataFrame:
    rows = user_series(t).select("user_id", "ts", F.coalesce("value", F.lit(0.0)).alias("value"))
    return rounded(series.min_max_scale(rows, ["value"], ["user_id"]), ["value"], 9)


MEASURES = ("MAX_DS", "SOPRA_SOGLIA_GIALLA", "SOPRA_SOGLIA_ROSSA", "SOPRA_CAPACITA", "N_APPARATI")


def _series_sql() -> str:
    scaled = ", ".join(
        f'round(CASE WHEN max("{c}") OVER w > min("{c}") OVER w THEN ("{c}" - min("{c}") OVER w) / (max("{c}") OVER w - min("{c}") OVER w) ELSE 0 END, 6) AS "{c}"'
        for c in (*MEASURES, "TIPO_GIORNO_DS", "KPI", "PRED")
    )
    return f"""
    WITH f AS ({FEATURES}),
    m AS (SELECT "PROVINCIA", "DATA", {", ".join(f'CAST(sum("{c}") AS DOUBLE) AS "{c}"' for c in MEASURES)}, max("TIPO_GIORNO_DS") AS "TIPO_GIORNO_DS",
                 max("KPI") AS "KPI" FROM f GROUP BY 1, 2),
    g AS (SELECT "PROVINCIA", unnest(generate_series(min("DATA"), max("DATA"), INTERVAL '3 hours')) AS "DATA" FROM m GROUP BY 1),
    j AS (SELECT g."PROVINCIA", g."DATA", {", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in (*MEASURES, "KPI"))},
                 last_value("TIPO_GIORNO_DS" IGNORE NULLS) OVER (PARTITION BY g."PROVINCIA" ORDER BY g."DATA") AS "TIPO_GIORNO_DS"
          FROM g LEFT JOIN m USING ("PROVINCIA", "DATA")),
    p AS (SELECT *, coalesce(lead("MAX_DS") OVER (PARTITION BY "PROVINCIA" ORDER BY "DATA"), 0) AS "PRED" FROM j)
    SELECT "PROVINCIA", "DATA", {scaled} FROM p WINDOW w AS (PARTITION BY "PROVINCIA")"""


@query(_series_sql())
def series_for_key(t: Tables) -> DataFrame:
    """Training series of all provinces at once."""
    found = series.series_for_key(features(t))
    return rounded(found, [*MEASURES, "TIPO_GIORNO_DS", "KPI", "PRED"], 6)


@query(f"""{GRID} SELECT user_id, ts, CASE WHEN pos < floor(floor(days * 8 * 0.85) * 0.9) THEN 'train' WHEN pos < floor(days * 8 * 0.85) THEN 'val' ELSE 'test' END AS split
       FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos,
                    datediff('day', CAST(min(ts) OVER (PARTITION BY user_id) AS DATE), CAST(max(ts) OVER (PARTITION BY user_id) AS DATE)) AS days FROM g)""")
def chronological_split(t: Tables) -> DataFrame:
    return series.chronological_split(regular_grid(t), "ts", "user_id")


# a third of the users are one series, which no task may hold as a whole
SKEWED = "SELECT CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS series, event_id, ts, value, CASE WHEN value > 100 THEN event_type END AS kind FROM events"


@query(f"""
    SELECT series, event_id, last_value(kind IGNORE NULLS) OVER o AS kind, coalesce(lead(value) OVER o, 0) AS pred, row_number() OVER o - 1 AS position,
           coalesce(lag(value, 1) OVER o, 0) AS lag_1, coalesce(lag(value, 2) OVER o, 0) AS lag_2
    FROM (SELECT * FROM ({SKEWED})) WINDOW o AS (PARTITION BY series ORDER BY ts, event_id)""")
def skewed_series(t: Tables) -> DataFrame:
    """Last known kind, next value, place and lags of every event in its series, one of which has a third of all events."""
    key = F.when(F.col("user_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id"))
    rows = t.events.select(key.alias("series"), "event_id", "ts", "value", F.when(F.col("value") > 100, F.col("event_type")).alias("kind"))
    found = scan.carried(rows, ["series"], ["ts", "event_id"], scan.last_known(["kind"]), scan.next_row(["value"]), scan.position())
    found = found.select("*", F.coalesce(F.col("next.value"), F.lit(0.0)).alias("pred"))
    return scan.lags(found, "value", ["series"], ["ts", "event_id"], 2, 0.0).select("series", "event_id", "kind", "pred", "position", "lag_1", "lag_2")


SPANS = """SELECT user_id % 40 AS device, event_id AS span_id, ts AS since, ts + to_seconds((event_id % 3000) * (event_id % 3000)) AS until
           FROM events WHERE event_type = 'view'"""


@query(f"""
    WITH s AS ({SPANS})
    SELECT e.event_id, arg_min(s.span_id, (s.since, s.until, s.span_id)) AS span_id
    FROM events e LEFT JOIN s ON s.device = e.user_id % 40 AND e.ts BETWEEN s.since AND s.until GROUP BY e.event_id""")
def interval_at_time(t: Tables) -> DataFrame:
    """Every event with the earliest open view of its device; views stay open for seconds to a hundred days."""
    number = F.col("event_id") % 3000
    views = t.events.where("event_type = 'view'").select(
        (F.col("user_id") % 40).alias("device"), F.col("event_id").alias("span_id"), F.col("ts").alias("since"),
        (F.col("ts") + F.make_dt_interval(secs=(number * number).cast("decimal(18,6)"))).alias("until"),
    )
    moments = t.events.select("event_id", (F.col("user_id") % 40).alias("device"), "ts")
    return joins.interval_at(moments, "ts", views, "since", "until", ["device"], ["span_id"]).select("event_id", "span_id")


@query("SELECT user_id, event_id, ts + INTERVAL 3 HOUR AS ts FROM events")
def prediction_time_shift(t: Tables) -> DataFrame:
    return series.shift_time(t.events.select("user_id", "event_id", "ts"), "ts")


@query("""
    SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, datediff('day', CAST(date_trunc('week', ts) AS DATE), CAST(ts AS DATE)) * 24 + hour(ts) AS offset_hours,
           round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def weekly_overlay(t: Tables) -> DataFrame:
    return rounded(series.weekly_overlay(t.events, "ts", ["event_type"], "value"), ["value"])


@query("""
    SELECT slice, event_type, round(sum(value), 4) AS value FROM (
        SELECT CAST(DATE '2023-12-27' + CAST(floor(datediff('day', DATE '2023-12-27', CAST(ts AS DATE)) / 7) AS INTEGER) * 7 AS DATE) AS slice, event_type, value
        FROM events WHERE ts >= TIMESTAMP '2023-12-27') GROUP BY 1, 2""")
def weekly_slices(t: Tables) -> DataFrame:
    return rounded(rollup.sum_by(series.time_slices(t.events, "ts", "2023-12-27"), ["slice", "event_type"], ["value"]), ["value"])


@query("""
    SELECT * FROM (SELECT strftime(ts, '%H:%M') AS slot, count(*) AS devices, count(*) FILTER (value > 50) AS over_yellow,
                          count(*) FILTER (value > 100) AS over_red, round(sum(value), 4) AS sum_value, max(value) AS max_value
                   FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 1 DESC LIMIT 20)""")
def event_slot_report(t: Tables) -> DataFrame:
    rows = clean.keep_equal(t.events, "event_type", "view").select(
        F.date_format("ts", "HH:mm").alias("slot"), "value", F.lit(50.0).alias("yellow"), F.lit(100.0).alias("red")
    )
    report = rollup.slot_report(rows, "slot", "value", {"over_yellow": "yellow", "over_red": "red"}, "devices")
    return rounded(report, ["sum_value"])


@query("SELECT event_type, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def mean_by_time(t: Tables) -> DataFrame:
    rows = t.events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rounded(rollup.mean_by(rows, ["event_type", "hour"], ["value"]), ["value"], 6)


@query("""
    SELECT user_id, coalesce(arg_min(flag, event_id) FILTER (flag <> 0), 0) AS flag FROM (
        SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN 0.0 WHEN value < 20 THEN 0.25 ELSE 1.0 END::DOUBLE AS flag FROM events)
    GROUP BY 1""")
def first_nonzero_per_group(t: Tables) -> DataFrame:
    flag = F.when(F.col("event_type") != "error", 0.0).when(F.col("value") < 20, 0.25).otherwise(1.0)
    return t.events.groupBy("user_id").agg(matches.first_nonzero(flag, F.col("event_id")).alias("flag"))


@query(FLAGS)
def match_flags(t: Tables) -> DataFrame:
    return matches.match_flags(calendar(t), literals.TEAMS, ["event_id"])


@query(KPI)
def match_kpi(t: Tables) -> DataFrame:
    """Flags paired with the regions, indicator per pair, moved to the bucket before the match."""
    return kpi(t)


@query(f"""
    SELECT "REGIONE", data AS "DATA", round(({" + ".join(f"{s} * {f} * ((21.0 - {i + 1}) / 20.0)" for i, (f, s) in enumerate(literals.TEAM_SHARES.items()))})
           * CASE hour(data) WHEN 21 THEN 2 WHEN 18 THEN 0.5 ELSE 0.6 END, 8) AS "KPI" FROM ({FLAGS}) CROSS JOIN ({FANS})""")
def match_kpi_with_rank(t: Tables) -> DataFrame:
    """The variant with rank and hour weights, teams ranked in list order."""
    from tessella.operators.joins import pair_with_all, rank_weight

    flags = matches.match_flags(calendar(t), literals.TEAMS, ["event_id"])
    weights = {f: f"W_{f}" for f in literals.TEAMS}
    flags = flags.withColumns({w: rank_weight(F.lit(i + 1)) for i, w in enumerate(weights.values())})
    value = matches.match_kpi_with_rank(literals.TEAM_SHARES, weights) * matches.match_hour_weight("data")
    return rounded(pair_with_all(flags, fans(t)).select("REGIONE", F.col("data").alias("DATA"), value.alias("KPI")), ["KPI"], 8)
