"""The registry of collectors: places, distances, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Collectors that a registry may have; pairs of them are joined as a broadcast table.
MAX_COLLECTORS = 1000


def registry(spark: SparkSession) -> DataFrame:
    """(collector, city, country, lat, lon, ixp, region) of the known collectors."""
    return spark.createDataFrame(list(S.COLLECTORS), "collector string, city string, country string, lat double, lon double, ixp string, region string")


def checked(collectors: DataFrame) -> DataFrame:
    """The registry, which is refused above MAX_COLLECTORS rows."""
    if collectors.limit(MAX_COLLECTORS + 1).count() > MAX_COLLECTORS:
        raise ValueError(f"a registry of more than {MAX_COLLECTORS} collectors")
    return collectors


def located(df: DataFrame, collectors: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """``df`` with lat and lon of the collector in ``column``, null if it isn't known."""
    places = checked(collectors).select(F.col("collector").alias("_c"), F.col("lat").alias(f"{prefix}lat"), F.col("lon").alias(f"{prefix}lon"))
    return df.join(F.broadcast(places), F.col(column) == F.col("_c"), "left").drop("_c")  # bounded by MAX_COLLECTORS


def with_distance(df: DataFrame, collectors: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` and ``km`` between the collectors in two columns; null if one isn't known."""
    both = located(located(df, collectors, a, "_a_"), collectors, b, "_b_")
    return both.withColumn("km", S.haversine_km(F.col("_a_lat"), F.col("_a_lon"), F.col("_b_lat"), F.col("_b_lon"))).drop("_a_lat", "_a_lon", "_b_lat", "_b_lon")


def pair_distances(collectors: DataFrame) -> DataFrame:
    """(a, b, km) between any two collectors of a registry of at most MAX_COLLECTORS rows."""
    c = checked(collectors).select("collector", "lat", "lon")
    every = F.array(*[F.struct(F.lit(r["collector"]).alias("b"), F.lit(r["lat"]).alias("lat2"), F.lit(r["lon"]).alias("lon2")) for r in c.collect()])  # bounded
    pairs = c.select(F.col("collector").alias("a"), "lat", "lon", F.inline(every))
    return pairs.select("a", "b", S.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km"))


def lookup(df: DataFrame, collectors: DataFrame, column: str = "collector") -> DataFrame:
    """``df`` with city, country and region of its collector, and whether it is known."""
    known = checked(collectors).select(F.col("collector").alias(column), "city", "country", "region", F.lit(True).alias("is_known"))
    return df.join(F.broadcast(known), column, "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def hop_distances(observations: DataFrame, collectors: DataFrame, event: str = "event_id") -> DataFrame:
    """(event_id, a, b, km) between the collectors of consecutive arrivals of an event."""
    w = Window.partitionBy(event).orderBy("arrival_ms", "collector")
    hops = observations.select(event, F.lag("collector").over(w).alias("a"), F.col("collector").alias("b")).where("a is not null")
    return with_distance(hops, collectors, "a", "b")
