"""What a place text says about countries, and which postings an area admits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..io import bounded
from .spatial import nearby

#: Most areas that are sent to all tasks at once.
MOST_AREAS = 4096

# Folded names of countries, ISO 3166 codes and the names of regions of several.
COUNTRIES = {
    "DE": ("deutschland", "germany", "allemagne", "alemania", "germania", "duitsland"), "AT": ("osterreich", "oesterreich", "austria", "autriche", "oostenrijk"),
    "CH": ("schweiz", "switzerland", "suisse", "svizzera", "suiza", "zwitserland"), "FR": ("frankreich", "france", "francia", "frankrijk"), "NL": ("niederlande", "netherlands", "nederland", "holland", "pays-bas"),
    "BE": ("belgien", "belgium", "belgique", "belgie"), "ES": ("spanien", "spain", "espana", "espagne", "spanje"), "IT": ("italien", "italy", "italia", "italie"), "GB": ("grossbritannien", "united kingdom", "great britain", "england", "uk", "vereinigtes konigreich"),
    "PL": ("polen", "poland", "polska"), "SE": ("schweden", "sweden", "sverige"), "US": ("usa", "united states", "vereinigte staaten"),
}
REGIONS = {"dach": ("AT", "CH", "DE"), "benelux": ("BE", "NL"), "iberia": ("ES",), "scandinavia": ("SE",)}
REMOTE = ("remote", "homeoffice", "home office", "worldwide", "weltweit", "anywhere", "teletravail")


def _codes() -> dict[str, list[str]]:
    named = {w: [c] for c, words in COUNTRIES.items() for w in (*words, c.lower())}
    return named | {w: sorted(cs) for w, cs in REGIONS.items()}


def parts_of(text: Column | str) -> Column:
    """The parts of a place text: cut at commas, semicolons, bars, slashes, brackets and spaced dashes; folded, blank ones left out."""
    cut = F.split(F.coalesce(fold(text), F.lit("")), r"[,;|/()\[\]]|\s[-–—]\s")
    return F.array_distinct(F.filter(F.transform(cut, lambda p: F.trim(F.regexp_replace(p, r"[\s\u00a0]+", " "))), lambda p: p != ""))


def countries_of(text: Column | str) -> Column:
    """Codes of the countries, and of all countries of the regions, that are parts of a place text; sorted, once each."""
    codes = F.from_json(F.lit(str(_codes()).replace("'", '"')), "map<string,array<string>>")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(parts_of(text), lambda p: F.array_contains(F.map_keys(codes), p)), lambda p: F.element_at(codes, p)))))


def towns_of(text: Column | str) -> Column:
    """The parts of a place text that name neither a country nor a region nor remote work."""
    return F.filter(parts_of(text), lambda p: ~p.isin(*_codes(), *REMOTE))


def names_remote(text: Column | str) -> Column:
    """Whether a part of a place text is a word for work from anywhere."""
    return F.exists(parts_of(text), lambda p: p.isin(*REMOTE))


def countries_in_title(title: Column | str) -> Column:
    """Codes of countries whose full names stand in a title as words; codes and regions do not count."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.coalesce(fold(title), F.lit("")), r"[^a-z0-9]+", " "), F.lit(" "))
    hit = lambda words: F.exists(F.array(*[F.lit(f" {w} ") for w in words]), lambda w: F.contains(t, w))
    found = [F.when(hit([w.replace("-", " ") for w in words if len(w) > 3]), F.lit(c)) for c, words in sorted(COUNTRIES.items())]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def areas(readers: DataFrame, places: DataFrame) -> DataFrame:
    """``area, countries, area_ids, area_countries, remote, anywhere`` of readers (area, countries, city_ids, radius_km, remote).

    An area's ids are the places within its radius of any of its towns, the towns included; towns alone do not mean
    anywhere.  Readers are few; each one's ids are one row.
    """
    towns = readers.select("area", "radius_km", F.explode("city_ids").alias("id")).join(places.select("id", "lat", "lon"), "id")
    widest = readers.agg(F.max("radius_km")).first()[0] or 0
    near = nearby(towns.select("id", "lat", "lon").dropDuplicates(["id"]), places, float(widest)) if widest else towns.select(F.col("id").alias("centre"), "id", F.lit(0.0).alias("km"))
    inside = towns.select("area", "radius_km", F.col("id").alias("centre")).join(near, "centre").where(F.col("km") <= F.col("radius_km")).join(places.select("id", F.col("country").alias("c")), "id")
    ids = inside.groupBy("area").agg(F.array_sort(F.collect_set("id")).alias("area_ids"), F.array_sort(F.collect_set("c")).alias("area_countries"))
    none = lambda t: F.array().cast(f"array<{t}>")
    return readers.join(ids, "area", "left").select("area", "countries", F.coalesce("area_ids", none("int")).alias("area_ids"), F.coalesce("area_countries", none("string")).alias("area_countries"), "remote", ((F.size("countries") == 0) & (F.size("city_ids") == 0)).alias("anywhere"))


def admitted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``area, id, kept, closed_at_origin``: what each of a few areas admits of all postings.

    ``rows``: id, blank (no place text), dedup_group, closed_at, first_seen_at, countries, place_ids, unplaced_countries,
    work_mode; ``wanted`` as of :func:`areas`, a stated list sent to all tasks.  A posting that states nothing is kept.  A blank
    copy is judged by its open placed twins (of the same group); without one it counts as closed at its origin if a placed
    twin closed after the copy was first seen.  Null arrays count as empty, a null group has no twins.
    """
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    r = rows.select("id", "blank", "dedup_group", "closed_at", "first_seen_at", none("countries", "string").alias("p_countries"), none("place_ids", "int").alias("p_ids"), none("unplaced_countries", "string").alias("p_unplaced"), F.coalesce(F.col("work_mode") == "remote", F.lit(False)).alias("p_remote"))
    a, fits = bounded(wanted, MOST_AREAS)
    if not fits:
        raise ValueError(f"more than {MOST_AREAS} areas: ask for them in blocks")
    over = F.arrays_overlap
    admits = over("p_countries", "countries") | over("p_ids", "area_ids") | over("p_unplaced", "area_countries") | F.col("p_remote")
    j = r.crossJoin(a).withColumn("admits", admits).withColumn("stated", (F.size("p_countries") > 0) | (F.size("p_unplaced") > 0) | (F.size("p_ids") > 0))
    # one row a group and area: twins are never listed in pairs; a blank copy is no twin of another
    placed = j.where(~F.col("blank") & F.col("stated") & F.col("dedup_group").isNotNull())
    twins = placed.groupBy("dedup_group", "area").agg(F.bool_or(F.col("closed_at").isNull()).alias("open_any"), F.bool_or(F.col("closed_at").isNull() & F.col("admits")).alias("open_admits"), F.max("closed_at").alias("last_closed"))
    k = j.join(twins, ["dedup_group", "area"], "left")
    open_any, gone = F.coalesce("open_any", F.lit(False)), F.coalesce(F.col("last_closed") >= F.col("first_seen_at"), F.lit(False))
    by_place = F.when(F.col("blank") & open_any, F.col("open_admits")).otherwise(F.col("admits") | ~F.col("stated"))
    kept = (F.col("remote") | ~F.col("p_remote")) & (F.col("anywhere") | by_place)
    return k.select("area", "id", kept.alias("kept"), (F.col("blank") & ~open_any & gone).alias("closed_at_origin"))
