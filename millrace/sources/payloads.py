"""Payloads of all sources read into one shape of posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

# Where each field stands in the payloads, for the three families of sources; null where a family has none.
FIELDS = ("key", "title", "company", "place", "country", "department", "language", "posted_at", "updated_at", "closes_at", "salary_from", "salary_to", "pay_period", "full_time", "description", "agency")
BOARD = {
    "key": "$.id", "title": "$.title", "company": "$.company_name", "place": "$.location.name", "department": "$.departments[0].name", "language": "$.language", "posted_at": "$.first_published",
    "updated_at": "$.updated_at", "closes_at": "$.application_deadline", "salary_from": "$.salary_from", "salary_to": "$.salary_to", "full_time": "$.full_time", "description": "$.content",
}
STAFF = {
    "key": "$.id", "title": "$.name", "company": "$.subcompany", "place": "$.office", "department": "$.department", "posted_at": "$.createdAt", "salary_from": "$.salary", "full_time": "$.schedule", "description": "$.jobDescriptions",
}
AGENCY = {
    "key": "$.referenznummer", "title": "$.stellenangebotsTitel", "company": "$.firma", "place": "$.stellenlokationen[0].adresse.ort", "country": "$.stellenlokationen[0].adresse.land", "posted_at": "$.datumErsteVeroeffentlichung",
    "updated_at": "$.aenderungsdatum", "salary_from": "$.gehaltsspanneVon", "salary_to": "$.gehaltsspanneBis", "pay_period": "$.verguetungsangabe", "full_time": "$.arbeitszeitVollzeit", "description": "$.stellenangebotsBeschreibung", "agency": "$.istArbeitnehmerUeberlassung",
}
# What the agency calls periods of pay.
PAY_PERIODS = {"JAHRESGEHALT": "YEAR", "MONATSGEHALT": "MONTH", "STUNDENLOHN": "HOUR"}
SOURCES = {
    **dict.fromkeys(("greenhouse", "lever", "ashby", "breezy", "arbeitnow", "himalayas", "jobicy", "workable"), BOARD),
    **dict.fromkeys(("personio", "rippling", "workday"), STAFF),
    "arbeitsagentur": AGENCY,
}
#: Sources whose postings are all for work from anywhere.
REMOTE_ONLY = ("himalayas", "jobicy")


def _field(payload: Column, source: Column, name: str) -> Column:
    out = F.lit(None).cast("string")
    for layout in (BOARD, STAFF, AGENCY):
        if layout.get(name):
            out = F.when(source.isin([s for s, x in SOURCES.items() if x is layout]), F.get_json_object(payload, layout[name])).otherwise(out)
    return out


def read_listings(documents: DataFrame) -> DataFrame:
    """Listing payloads as postings: ``id, source, external_id, title, company, place, department, language, posted_at,
    salary_from, full_time``.  Unreadable payloads, members that are missing, and unknown sources give nulls."""
    d = documents.where(F.col("kind") == "listing")
    f = lambda n: _field(F.col("payload"), F.col("source"), n)
    return d.select(
        "id", "source", F.lower(F.trim("external_id")).alias("external_id"), collapse(f("title")).alias("title"), collapse(f("company")).alias("company"), collapse(f("place")).alias("place"),
        collapse(f("department")).alias("department"), f("language").alias("language"), f("posted_at").alias("posted_at"), f("salary_from").try_cast("double").alias("salary_from"),
        F.lower(f("full_time")).isin("true", "full-time").alias("full_time"),
    )


def merge_details(listings: DataFrame, documents: DataFrame) -> DataFrame:
    """Postings with the description of the latest detail payload fetched for them; null if there is none."""
    d = documents.where((F.col("kind") == "detail") & F.col("external_id").isNotNull())
    d = d.select("source", F.lower(F.trim("external_id")).alias("external_id"), "fetched_at", "id", F.get_json_object("payload", "$.description").alias("description"))
    latest = d.groupBy("source", "external_id").agg(F.max_by("description", F.struct("fetched_at", "id")).alias("description"))
    return listings.join(latest, ["source", "external_id"], "left")


def canonical_postings(documents: DataFrame) -> DataFrame:
    """One row for each posting of a source: the latest listing, with what the latest detail adds where the listing is silent.

    ``source, external_id, listing_id, detail_id``, all of ``FIELDS`` (texts collapsed, amounts as double, flags as boolean) and
    ``locations`` (the place cut at bars, semicolons and "or"), ``remote``.  Listings that are no JSON object give nulls; rows
    without an external id are left out; of rows fetched at the same time the larger id counts.
    """
    d = documents.where("external_id IS NOT NULL").withColumn("external_id", F.lower(F.trim(F.regexp_replace("external_id", r"[\t\u00a0]", " "))))
    newest = lambda kind: d.where(F.col("kind") == kind).groupBy("source", "external_id").agg(F.max_by(F.struct("id", "payload"), F.struct("fetched_at", "id")).alias(kind))
    j = newest("listing").join(newest("detail"), ["source", "external_id"], "left")

    def both(name: str) -> Column:
        listing = _field(F.col("listing.payload"), F.col("source"), name)
        detail = F.coalesce(_field(F.col("detail.payload"), F.col("source"), name), F.get_json_object("detail.payload", "$.description") if name == "description" else F.lit(None).cast("string"))
        return F.coalesce(collapse(detail), collapse(listing)) if name in ("description", "agency") else F.coalesce(collapse(listing), collapse(detail))

    j = j.select("source", "external_id", F.col("listing.id").alias("listing_id"), F.col("detail.id").alias("detail_id"), *[both(n).alias(n) for n in FIELDS])
    flag = lambda c, yes: F.when(F.col(c).isNotNull(), F.lower(c).isin(*yes))
    places = F.filter(F.transform(F.split(F.coalesce("place", F.lit("")), r"(?i)[;|]|\s+(?:or|oder)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    period = F.try_element_at(F.create_map(*[F.lit(x) for kv in PAY_PERIODS.items() for x in kv]), F.col("pay_period"))
    return j.withColumns({
        "salary_from": F.col("salary_from").try_cast("double"), "salary_to": F.col("salary_to").try_cast("double"), "pay_period": period,
        "full_time": flag("full_time", ("true", "full-time")), "agency": flag("agency", ("true",)), "locations": places,
        "remote": F.col("source").isin(*REMOTE_ONLY) | F.exists(places, lambda p: F.lower(p).isin("remote", "homeoffice", "worldwide")),
    })
