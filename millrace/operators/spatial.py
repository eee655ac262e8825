"""Places near places, and places by their beginnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import haversine_km
from ..functions.text import fold


def nearby(centres: DataFrame, places: DataFrame, radius_km: float) -> DataFrame:
    """``centre, id, km``: places within ``radius_km`` of each centre (id, lat, lon), the limit included.

    Latitudes are cut into bands as high as the radius; a centre meets its own band and the two beside it, so the join is by
    band and a residual, not a product.  Rows without coordinates are left out.
    """
    band = radius_km / 111.0
    c = centres.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias("centre"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.floor(F.col("lat") / band).alias("b"))
    c = c.select("centre", "c_lat", "c_lon", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("band"))
    p = places.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("band", F.floor(F.col("lat") / band))
    km = haversine_km(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))
    return c.join(p, "band").withColumn("km", F.round(km, 3)).where(F.col("km") <= radius_km).select("centre", "id", "km")


def suggest(prefixes: DataFrame, places: DataFrame, limit: int = 10) -> DataFrame:
    """``prefix, id, pos``: for each prefix the most populous places whose folded name or alternate begins with it.

    Prefixes meet names by their first two letters, then by the whole prefix; shorter ones find nothing.
    """
    names = places.select("id", "population", F.explode(F.array_union(F.array("name"), F.coalesce("alternates", F.array().cast("array<string>")))).alias("n")).select("id", "population", fold("n").alias("n"))
    p = prefixes.select("prefix", fold("prefix").alias("f")).where(F.length("f") >= 2).distinct().withColumn("two", F.substring("f", 1, 2))
    hit = p.join(names.withColumn("two", F.substring("n", 1, 2)), "two").where(F.col("n").startswith(F.col("f"))).select("prefix", "id", "population").distinct()
    w = Window.partitionBy("prefix").orderBy(F.desc_nulls_last("population"), "id")
    return hit.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select("prefix", "id", "pos")


def dominant(places: DataFrame, times: float = 10.0) -> DataFrame:
    """``name, id``: the place a bare name means: the only one of that folded name, or one ``times`` as populous as the next."""
    w = Window.partitionBy("name").orderBy(F.desc_nulls_last("population"), "id")
    n = places.select(fold("name").alias("name"), "id", F.coalesce("population", F.lit(0)).alias("population"))
    n = n.select("name", "id", "population", F.row_number().over(w).alias("r"), F.lead("population").over(w).alias("next"))
    return n.where((F.col("r") == 1) & (F.col("next").isNull() | (F.col("population") >= times * F.col("next")))).select("name", "id")
