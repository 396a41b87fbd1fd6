"""Tables that the analyses state as literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Percentage of fans by region.
FAN_COLUMNS = ("JUVENTUS", "INTER", "MILAN", "ROMA", "NAPOLI")
FAN_PERCENT = (
    ("Piemonte", 34.1, 11.2, 26.1, 1.5, 3.3),
    ("Lombardia", 22.5, 26.9, 10.9, None, 4.6),
    ("Valle d'Aosta/Vallée d'Aoste", 34.1, 11.2, 26.1, 1.5, 3.3),
    ("Trentino-Alto Adige/Südtirol", 33.4, 17.1, 24.3, 3.9, 4.5),
    ("Veneto", 28.1, 16.9, 22.5, None, 3.6),
    ("Friuli-Venezia Giulia", 24.9, 12.8, 23.5, None, 2.8),
    ("Liguria", 20.4, 9.2, 10.5, 1.7, 3.4),
    ("Emilia-Romagna", 24.2, 15.0, 18.7, None, 3.3),
    ("Toscana", 23.2, 12.4, 16.5, 2.5, 4.5),
    ("Umbria", 23.0, 16.1, 18.0, 4.4, None),
    ("Marche", 34.0, 17.9, 18.4, 3.3, None),
    ("Lazio", 16.3, 6.0, 6.5, 35.1, 4.0),
    ("Abruzzo", 33.5, 19.8, 19.2, 5.8, 3.2),
    ("Molise", 32.9, 19.0, 22.2, 4.2, 7.9),
    ("Campania", 17.1, 10.0, 9.4, 2.9, 46.7),
    ("Puglia", 28.8, 14.4, 19.9, 4.4, 4.7),
    ("Basilicata", 31.3, 26.0, 15.1, 3.8, 8.6),
    ("Calabria", 29.6, 16.4, 14.1, 4.4, 4.5),
    ("Sicilia", 33.8, 17.2, 19.1, 3.8, 3.2),
    ("Sardegna", 23.4, 13.2, 12.6, 3.5, 2.7),
)

# Provinces missing from the list of communes.
EXTRA_PROVINCES = (("Sardegna", "OT"), ("Sardegna", "OG"), ("Sardegna", "CI"), ("Emilia-Romagna", "SM"), ("Sardegna", "VS"))

# Flag column, tracked team and fan column.
TEAMS = {"GAME_J": "Juventus", "GAME_I": "Inter", "GAME_M": "Milan", "GAME_R": "Roma", "GAME_N": "Napoli"}
TEAM_SHARES = {"GAME_J": "JUVENTUS", "GAME_I": "INTER", "GAME_M": "MILAN", "GAME_R": "ROMA", "GAME_N": "NAPOLI"}


def fan_shares(spark: SparkSession) -> DataFrame:
    """``REGIONE`` and the share of fans per team, 0 where unknown."""
    df = spark.createDataFrame(list(FAN_PERCENT), "REGIONE string, " + ", ".join(f"{c} double" for c in FAN_COLUMNS))
    return df.na.fill(0.0).withColumns({c: F.col(c) / 100 for c in FAN_COLUMNS})


def provinces(communes: DataFrame) -> DataFrame:
    """``REGIONE, PROVINCIA`` from the list of communes and the extra rows."""
    listed = communes.select(
        F.col("`Denominazione regione`").alias("REGIONE"), F.col("`Sigla automobilistica`").alias("PROVINCIA")
    ).distinct()
    return listed.unionByName(communes.sparkSession.createDataFrame(list(EXTRA_PROVINCES), "REGIONE string, PROVINCIA string"))
