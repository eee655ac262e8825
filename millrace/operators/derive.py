"""Facts read from postings' texts: terms, places named together, plain text, reproducible vectors."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

# Words that tell seniority, workplace and contract, in order of precedence.
SENIORITY = (
    ("apprenticeship", ("ausbildung", "azubi", "auszubildende", "apprentice", "apprenti ", "leerling", "lehrling", "lehrstelle")),
    ("intern", ("praktik", "intern ", "internship", "werkstudent", "working student", "stagiaire", "stage ", "becario", "tirocin")),
    ("executive", ("chief ", "geschaftsfuhr", "geschaeftsfuehr", "vorstand", "vice president", "managing director", "directeur general", "cto ", "ceo ", "cfo ")),
    ("lead", ("lead", "head of", "leiter", "leitung", "principal", "team manager", "responsable", "hoofd ")),
    ("senior", ("senior", "sr. ", "experte", "erfahren", "confirme", "ervaren")),
    ("junior", ("junior", "jr. ", "trainee", "berufseinsteiger", "einsteiger", "entry level", "graduate", "debutant", "absolvent")),
)
WORKPLACE = (
    ("hybrid", ("hybrid", "teilweise homeoffice", "mobiles arbeiten")),
    ("remote", ("remote", "homeoffice", "home office", "home-office", "teletravail", "thuiswerk", "teletrabajo", "work from home", "wfh ")),
    ("onsite", ("vor ort", "on-site", "onsite", "on site", "sur site", "op locatie", "presencial", "werk ")),
)
CONTRACT = (
    ("apprenticeship", ("ausbildung", "apprentic", "alternance")),
    ("internship", ("praktik", "intern", "stage", "tirocin")),
    ("temporary", ("befristet", "temporar", "temporary", "zeitarbeit", "leiharbeit", "interim", "cdd ", "contract", "freelance", "freiberuf", "saison")),
    ("part_time", ("teilzeit", "part-time", "part time", "part_time", "parttime", "mi-temps", "temps partiel", "deeltijd", "minijob", "geringfugig", "media jornada")),
    ("full_time", ("vollzeit", "full-time", "full time", "full_time", "fulltime", "temps plein", "voltijd", "permanent", "festanstellung", "unbefristet", "cdi ", "jornada completa")),
)


def first_term(text: Column | str, terms: tuple) -> Column:
    """The first label one of whose terms stands in the folded text; ``unknown`` otherwise."""

    def label(t: Column) -> Column:
        out = F.lit("unknown")
        for name, words in reversed(terms):
            out = F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)), name).otherwise(out)
        return out

    # the folded text is bound by a one-element array, so that it is worked out once and not once a word
    return F.get(F.transform(F.array(F.concat(F.coalesce(fold(text), F.lit("")), F.lit(" "))), label), F.lit(0))


def places_named(text: Column | str) -> Column:
    """The places a free text names, split at semicolons, bars and "or"; blanks trimmed, empty ones left out."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(t, F.lit("")), r"(?i)[;|]|\s+(?:or|oder)\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"[\s ]+", " "))), lambda p: p != "")


class _Text(HTMLParser):
    """Text of a page without scripts and styles; block elements break lines."""

    BLOCK = frozenset("address article br dd div dl dt h1 h2 h3 h4 h5 h6 hr li ol p pre section table td th tr ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def html_text(content: str | None) -> str | None:
    """Plain text of HTML, also of HTML escaped as text; runs of white space become one blank; null if nothing remains."""
    if content is None:
        return None
    if "<" not in content and "&lt;" in content:
        content = html.unescape(content)
    p = _Text()
    p.feed(content)
    p.close()
    return re.sub(r"\s+", " ", "".join(p.out)).strip() or None


def html_to_text(col: Column) -> Column:
    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(html_text).astype(object)

    return plain(col)


def hashed_vector(text: Column | str, dim: int = 64) -> Column:
    """A vector of length one drawn from the MD5 digest of the whole text: the same everywhere, close to no other.

    Number i is read from the digest of the text's digest and i, scaled to -1..1.  Null texts count as empty.  Runs in the JVM.
    """
    t = F.col(text) if isinstance(text, str) else text
    key = F.md5(F.coalesce(t, F.lit("")))
    number = lambda i: F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), i.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**31 - 1
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), number)
    # numbers and length are bound by one-element arrays, so that each is worked out once
    with_length = F.transform(F.array(raw), lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)).alias("n")))
    return F.get(F.transform(with_length, lambda r: F.transform(r["v"], lambda x: x / r["n"])), F.lit(0))


def embed(rows: DataFrame, dim: int = 64) -> DataFrame:
    """``id, vec`` of rows (id, text) by :func:`hashed_vector`; null texts count as empty."""
    return rows.select(F.col("id").cast("bigint").alias("id"), hashed_vector("text", dim).cast("array<float>").alias("vec"))
