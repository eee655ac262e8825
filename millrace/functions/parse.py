"""Small parsers as column expressions: instants, slugs, scores, spellings of links, local days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, fold, host

# Query parameters that only track, and hosts under which every customer has a site of its own.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "source")
SHARED_HOSTS = ("github.io", "blogspot.example", "pages.example", "co.uk", "com.au")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(c: Column | str) -> Column:
    """Microseconds since 1970 of an ISO 8601 text, naive ones as UTC, or of seconds or milliseconds in figures (by magnitude, from
    10^12 on milliseconds); null for anything else."""
    t = F.trim(_col(c))
    n = F.when(t.rlike(r"^-?\d{1,15}$"), t.try_cast("bigint"))
    figures = F.when(F.abs(n) >= 1_000_000_000_000, n * 1000).otherwise(n * 1_000_000)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"), F.unix_micros(t.try_cast("timestamp")))
    return F.coalesce(figures, iso)


def before_comma(c: Column | str) -> Column:
    """The text before the first comma, trimmed; null if nothing is there."""
    return collapse(F.regexp_extract(_col(c), r"^([^,]*)", 1))


def looks_like_code(c: Column | str) -> Column:
    """Whether a text is a short code: at most four characters, all capitals."""
    t = F.trim(_col(c))
    return F.length(t).between(1, 4) & t.rlike(r"^\p{Lu}+$")


def is_slug(c: Column | str, longest: int = 80) -> Column:
    """Whether a text may name a board: letters, digits, dots, dashes and underscores, beginning with a letter or digit."""
    return F.coalesce(_col(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & (F.length(_col(c)) <= longest), F.lit(False))


def registrable(url: Column | str) -> Column:
    """The last two labels of a URL's host, three under hosts whose customers have sites of their own."""
    h = host(url)
    shared = F.lit(False)
    for s in SHARED_HOSTS:
        shared = shared | h.endswith("." + s)
    return F.when(shared, F.regexp_extract(h, r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(F.regexp_extract(h, r"([^.]+\.[^.]+|[^.]+)$", 1))


def without_tracking(url: Column | str) -> Column:
    """A URL without its fragment and without parameters that only track; the others stay as they are written, not decoded."""
    u = F.regexp_replace(_col(url), r"#.*$", "")
    asked = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, r"^([^=]*)", 1)).isin(*TRACKING))
    bare = F.regexp_replace(u, r"\?.*$", "")
    return F.when(F.size(kept) > 0, F.concat(bare, F.lit("?"), F.array_join(kept, "&"))).otherwise(bare)


def local_day(at: Column | str, zone: str) -> Column:
    """The day an instant falls on in a time zone."""
    return F.to_date(F.from_utc_timestamp(_col(at), zone))


def minutes_of_day(at: Column | str, zone: str) -> Column:
    """Minutes from local midnight."""
    t = F.from_utc_timestamp(_col(at), zone)
    return F.hour(t) * 60 + F.minute(t)


def is_due(now: Column, last: Column, hour: int, minute: int, zone: str) -> Column:
    """Whether today's wall-clock slot in ``zone`` has passed and nothing happened since; a null ``last`` means never."""
    midnight = F.date_trunc("day", F.from_utc_timestamp(now, zone))
    slot = F.to_utc_timestamp(midnight + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute)), zone)
    return (slot <= now) & F.coalesce(last < slot, F.lit(True))


def pause_days(failures: Column, most: int = 7) -> Column:
    """Days of pause after so many blocked sweeps in a row: one, doubled each time, at most ``most``; none after none."""
    return F.when(failures <= 0, 0).otherwise(F.least(F.pow(F.lit(2), F.least(failures, F.lit(30)) - 1).cast("int"), F.lit(most)))


def vector_text(vec: Column | str) -> Column:
    """A vector as text, six decimals a number: ``[0.100000,-2.000000]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(_col(vec), lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def score_in(text: Column | str) -> Column:
    """The member ``score`` of the JSON object between the first and last brace of a text, if it is a whole number from 0 to 100."""
    blob = F.regexp_extract(_col(text), r"(?s)(\{.*\})", 1)
    n = F.get_json_object(blob, "$.score")
    v = F.when(n.rlike(r"^\d{1,9}$"), n.try_cast("int"))
    return F.when(v.between(0, 100), v)


def merged_words(own: Column, more: Column, most: int = 8) -> Column:
    """Both arrays in order, own words first, each once whatever its case, blank ones left out; the first ``most``."""
    both = F.filter(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>"))), lambda w: w.isNotNull() & (F.trim(w) != ""))
    low = F.transform(both, lambda w: F.lower(F.trim(w)))
    first = F.filter(F.transform(F.arrays_zip(both.alias("w"), low.alias("l"), F.sequence(F.lit(1), F.greatest(F.size(both), F.lit(1))).alias("n")), lambda r: F.struct(r["w"].alias("w"), (F.array_position(low, r["l"]) == r["n"]).alias("keep"))), lambda r: r["keep"])
    return F.slice(F.transform(first, lambda r: r["w"]), 1, most)


def first_reason(stages: list[tuple[str, Column]], passed: str) -> Column:
    """The name of the first stage whose condition does not hold, unknown ones included; ``passed`` if all hold."""
    out = F.lit(passed)
    for name, holds in reversed(stages):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def place_spellings(city: Column | str) -> Column:
    """Ways a town may stand in a list, best first: as it is; without post code, brackets and district number; hyphenated; the
    part before a dash or slash.  Folded, each once, blank ones left out."""
    f = F.trim(F.regexp_replace(fold(city), r"[\s\u00a0]+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(f, r"\(.*?\)|\[.*?\]", " "), r"^\d{4,5}\s+|\s+\d{1,2}$", ""), r"\s+", " "))
    return F.array_distinct(F.filter(F.array(f, bare, F.replace(bare, F.lit(" "), F.lit("-")), F.trim(F.regexp_extract(bare, r"^([^/–-]*)", 1))), lambda x: x != ""))
