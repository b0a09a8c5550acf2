"""Q01-Q06: raw tables to cleaned tables.

Each ``clean_*`` is a row-wise ``DataFrame -> DataFrame`` step: it needs no shuffle, and works on a
stream as well as on a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routestats.functions.scalars import zfill
from routestats.operators.clean import cast_int_strict, coerce_numeric, parse_timestamp
from routestats.operators.filters import filter_any_in, filter_between, filter_eq, filter_in
from routestats.plans import schemas as S
from routestats.sources.tables import ensure_tables, read_family, read_table, write_table

TABLES = ["competition", "db1b", "delays", "fuel", "t100"]


@dataclass(frozen=True)
class Period:
    """The quarter that is analysed. The day bounds are timestamps at midnight, both included."""

    year: int = 2025
    quarter: int = 1

    @property
    def months(self) -> list[int]:
        return [3 * self.quarter - 2, 3 * self.quarter - 1, 3 * self.quarter]

    @property
    def first_day(self) -> str:
        return f"{self.year}-{self.months[0]:02d}-01"

    @property
    def last_day(self) -> str:
        return f"{self.year}-{self.months[2]:02d}-{31 if self.quarter in (1, 4) else 30}"


def clean_flights(raw: DataFrame, period: Period = Period()) -> DataFrame:
    """Q01: flights of the period that touch a target airport."""
    df = parse_timestamp(raw, "Date")
    df = filter_between(df, "Date", period.first_day, period.last_day)
    df = filter_any_in(df, ["Origin", "Dest"], S.TARGET_AIRPORTS)
    df = df.withColumns({c: zfill(c, 4) for c in ("Dep_Time", "Actual_Dep")})
    return cast_int_strict(coerce_numeric(df, ["Delay"]), "Cancelled")


def clean_fares(raw: DataFrame, period: Period = Period()) -> DataFrame:
    """Q02: ticket market rows of the period."""
    df = filter_eq(raw, {"YEAR": period.year, "QUARTER": period.quarter})
    return coerce_numeric(df, ["PASSENGERS", "MARKET_FARE", "MARKET_DISTANCE"])


def clean_delays(raw: DataFrame, period: Period = Period()) -> DataFrame:
    """Q03: delay causes of the period at the target airports."""
    df = filter_in(filter_eq(raw, {"year": period.year}), "month", period.months)
    return coerce_numeric(filter_in(df, "airport", S.TARGET_AIRPORTS), S.DELAY_MEASURES)


def clean_fuel(raw: DataFrame, period: Period = Period()) -> DataFrame:
    """Q04: daily fuel prices of the period; a missing price stays as a row."""
    df = parse_timestamp(raw, "observation_date")
    df = filter_between(df, "observation_date", period.first_day, period.last_day)
    return coerce_numeric(df, ["DJFUELUSGULF"]).withColumn("observation_date", F.col("observation_date").cast("date"))


def clean_capacity(raw: DataFrame, period: Period = Period()) -> DataFrame:
    """Q05: segment capacity of the period."""
    df = filter_eq(raw, {"YEAR": period.year, "QUARTER": period.quarter})
    return coerce_numeric(df, ["DEPARTURES_PERFORMED", "SEATS", "PASSENGERS"])


def read_raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One raw table from the folder of source files; fares and capacity come as one file per state."""
    path = f"{folder}/{S.RAW_FILES[name]}"
    if name in ("db1b", "t100"):
        return read_family(spark, path, S.STATES, S.FARES if name == "db1b" else S.CAPACITY)
    return read_table(spark, path, {"competition": S.FLIGHTS, "delays": S.DELAYS, "fuel": S.FUEL}[name])


CLEANERS = {
    "competition": clean_flights,
    "db1b": clean_fares,
    "delays": clean_delays,
    "fuel": clean_fuel,
    "t100": clean_capacity,
}


def clean_all(raw: dict[str, DataFrame], period: Period = Period()) -> dict[str, DataFrame]:
    """The cleaned tables as lazy plans."""
    return {name: CLEANERS[name](df, period) for name, df in raw.items()}


def preprocess(spark: SparkSession, raw_folder: str, out: str, period: Period = Period()) -> dict[str, DataFrame]:
    """Q06: clean all five sources, store them, and return the stored tables."""
    for name in TABLES:
        write_table(CLEANERS[name](read_raw(spark, raw_folder, name), period), f"{out}/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in TABLES}


def ensure_cleaned(spark: SparkSession, raw_folder: str, out: str, period: Period = Period()) -> dict[str, DataFrame]:
    """SRC06: the cleaned tables, building only those that are missing."""
    return ensure_tables(spark, out, lambda name: CLEANERS[name](read_raw(spark, raw_folder, name), period), TABLES)
