"""Text expressions: folding, hashing keys, URLs.  All run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to a base letter and marks, and those base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    found = [(a, "".join(x for x in d if not unicodedata.combining(x))) for a, d in pairs]
    found = [(a, d) for a, d in found if a != d and len(d) == 1]
    return "".join(a for a, _ in found), "".join(d for _, d in found)


_FROM, _TO = _accents()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case, ß as ss, accents gone.  Null stays null."""
    low = F.regexp_replace(F.lower(_col(c)), "ß", "ss")
    return F.regexp_replace(F.translate(low, _FROM, _TO), r"\p{M}", "")


def normalise(c: Column | str) -> Column:
    """Folded, signs to blanks, runs of blanks to one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_]", " "), r"\s+", " "))


def collapse(c: Column | str) -> Column:
    """Runs of white space, hard blanks included, to one blank; null if nothing remains."""
    out = F.trim(F.regexp_replace(_col(c), r"[\s\u00a0]+", " "))
    return F.when(out != "", out)


def alphanumeric(c: Column | str) -> Column:
    """The folded letters and digits alone."""
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]", "")


def tokens(c: Column | str) -> Column:
    """Folded words; an empty array for null and wordless texts."""
    return F.filter(F.split(F.coalesce(normalise(c), F.lit("")), " "), lambda w: w != "")


def digest(*parts: Column) -> Column:
    """SHA-256, in hexadecimal, of the parts joined by a bar; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def content_digest(version: int, title: Column | str, company: Column | str, places: Column | str, description: Column | str) -> Column:
    """Identity of a posting's content, whatever its source."""
    return digest(F.lit(str(version)), *[normalise(x) for x in (title, company, places, description)])


def pairing_key(title: Column | str, company: Column | str, board: Column | str) -> Column:
    """Key under which copies of a posting meet: normalised title and the letters and digits of the board, else the company."""
    return digest(normalise(title), alphanumeric(F.coalesce(_col(board), _col(company))))


def host(url: Column | str) -> Column:
    """Lower-case host without port; null if the text is no absolute URL."""
    out = F.regexp_extract(F.lower(_col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(out != "", out)


def site(url: Column | str) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+|[^.]+)$", 1)


def path_segments(url: Column | str) -> Column:
    """Non-empty parts of a URL's path."""
    path = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def urls_in(c: Column | str, longest: int = 500) -> Column:
    """Absolute URLs of a text in order, once each, without trailing punctuation; overlong ones are left out."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(https?://[^\s\"'<>\[\](){}]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")), lambda u: F.length(u) <= longest))


def url_variants(c: Column | str) -> Column:
    """Spellings under which a URL may be stored: either scheme, with and without www, with and without a final slash."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(c), r"^https?://", ""), r"^www\.", ""), r"/+$", "")
    return F.flatten(F.transform(F.array(F.lit("http://"), F.lit("http://www."), F.lit("https://"), F.lit("https://www.")), lambda p: F.array(F.concat(p, bare), F.concat(p, bare, F.lit("/")))))


# Legal forms of companies, and marks of titles that tell no role, folded.
LEGAL_FORMS = "gmbh|mbh|ag|se|kg|ohg|kgaa|co|ltd|llc|inc|plc|bv|nv|sa|sarl|sas|srl|spa|gruppe|group|holding|e v"
GENDER_MARKS = r"\((?:[a-z]\s?[/|*]\s?)+[a-z]\)|\b[mwdfxhv](?:\s?[/|]\s?[mwdfxhv]){1,3}\b|\(all genders\)|[*:]in(?:nen)?\b"


def employer_key(c: Column | str) -> Column:
    """A company's name for linking records: folded, without legal forms at its end; a name of nothing else stays."""
    n = normalise(c)
    bare = F.trim(F.regexp_replace(n, rf"(?:\s(?:{LEGAL_FORMS}))+$", ""))
    return F.when(bare != "", bare).otherwise(n)


def role_key(c: Column | str) -> Column:
    """A title for linking records: folded, without gender marks and signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(c), GENDER_MARKS, " "), r"[^\p{L}\p{N}]", " "), r"\s+", " "))
