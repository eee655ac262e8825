"""Free-entered place names mapped to a list of places."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names of countries as written beside towns, folded.
COUNTRY_WORDS = {
    "DE": "deutschland germany brd de allemagne alemania duitsland", "AT": "oesterreich osterreich austria at autriche oostenrijk",
    "CH": "schweiz suisse switzerland ch svizzera suiza zwitserland", "FR": "frankreich france fr francia frankrijk",
    "NL": "niederlande nederland netherlands nl holland", "ES": "spanien espana spain es espagne spanje",
    "GB": "grossbritannien uk gb england great_britain united_kingdom vereinigtes_koenigreich",
}
# Words that name no town.
NOWHERE = frozenset("remote homeoffice home_office hybrid worldwide weltweit emea europe europa eu dach bundesweit deutschlandweit global anywhere teletravail apac".split())
FRAME = re.compile(r"^(?:(?:raum|grossraum|bei|nahe|greater|near|region|area|hybrid|\d{4,5}) )+")
TAIL = re.compile(r"(?: (?:mitte|nord|sued|sud|ost|west|altstadt|hafen|zentrum|city|area|werk(?: \d+)?|[a-z]{1,2}\d{1,2}[a-z]? \d[a-z]{2}))+$")
ASIDE = re.compile(r"^(?:altstadt|hafen|mitte|nord|sued|sud|ost|west|zentrum|werk(?: \d+)?|\d+|[a-z]{1,2}\d{1,2}[a-z]? \d[a-z]{2})$")
SPLIT = r"[;|]|\s(?:oder|or|ou|of|o)\s"

#: Distances allowed by length of the shorter writing: none below 4 letters, one from there, two from 24.
LIMITS = ((4, 1), (24, 2))


def limit_for(length: int) -> int:
    return max([d for n, d in LIMITS if length >= n], default=0)


def fold(text: str, umlauts: bool) -> str:
    """Lower case, accents gone, other signs to blanks; umlauts as two letters or as one."""
    text = text.lower().replace("ß", "ss")
    if umlauts:
        text = unicodedata.normalize("NFC", text).replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", text))


def _writings(name: str) -> set[str]:
    """The ways a reference name may be written, folded."""
    out = set()
    for u in (True, False):
        f = fold(name, u)
        for g in (f, re.sub(r"^sankt ", "st ", f)):
            out |= {g, re.sub(r" an der ", " a d ", g), re.sub(r" (?:an der|am|ob der|bei) ", " ", g)}
    return {x for x in out if x}


class Trie:
    """Reference writings, searched by a bit-parallel Levenshtein automaton with neighbouring letters swapped as one edit."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, entry: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(entry)

    def search(self, query: str) -> list[tuple[int, int, int]]:
        """(distance, length of the writing, entry) of every writing within its allowed distance of ``query``."""
        n, most = len(query), limit_for(len(query) + 1)
        at: dict[str, int] = defaultdict(int)
        for i, c in enumerate(query):
            at[c] |= 1 << i
        full, done = (1 << (n + 1)) - 1, 1 << n
        # states[k]: bit i is set if i letters of the query are read with k edits
        start = tuple((1 << (k + 1)) - 1 & full for k in range(most + 1))
        found = []
        stack = [(self.root, start, None, "", 0)]
        while stack:
            node, states, before, last, depth = stack.pop()
            for c, child in node.items():
                if c == "":
                    k = next((k for k, s in enumerate(states) if s & done), None)
                    if k is not None and k <= limit_for(min(n, depth)):
                        found.extend((k, depth, e) for e in child)
                    continue
                m = at.get(c, 0)
                new = [(states[0] & m) << 1]
                for k in range(1, most + 1):
                    s = (states[k] & m) << 1 | states[k - 1] | states[k - 1] << 1 | new[k - 1] << 1
                    if before is not None and last:
                        s |= (((before[k - 1] & m) << 1) & at.get(last, 0)) << 1
                    new.append(s & full)
                if any(new):
                    stack.append((child, tuple(new), states, c, depth + 1))
        return found


class Gazetteer:
    """Places by writing, with what is needed to read a mention."""

    def __init__(self, places: list[tuple]):
        self.trie, self.info, self.regions = Trie(), [], {}
        for pid, name, country, region, population, alternates in places:
            self.info.append((pid, country, fold(region or "", True), population or 0))
            for w in {w for n in [name, *(alternates or [])] if n for w in _writings(n)}:
                self.trie.add(w, len(self.info) - 1)
            for u in (True, False):
                if region:
                    self.regions[fold(region, u)] = fold(region, True)
        self.countries = {w.replace("_", " "): c for c, words in COUNTRY_WORDS.items() for w in words.split()}
        self.nowhere = {w.replace("_", " ") for w in NOWHERE}

    def _near(self, forms: set[str]) -> dict[int, int]:
        best: dict[int, int] = {}
        for f in forms:
            for k, _, e in self.trie.search(f):
                best[e] = min(k, best.get(e, 9))
        return best

    def _parts(self, mention: str) -> tuple[list[set[str]], set[str], set[str]]:
        """The forms of each part that may be a town, and the countries and regions that stand beside."""
        forms = [{fold(p, True), fold(p, False)} for p in re.split(r"[,/()|:\[\]]|\s[-–—]\s", mention)]
        countries, regions, towns = set(), set(), []
        for fs in forms:
            fs = {f for f in fs if f}
            if not fs:
                continue
            if hit := {self.countries[f] for f in fs if f in self.countries}:
                countries |= hit
            elif hit := {self.regions[f] for f in fs if f in self.regions}:
                regions |= hit
            elif not any(f in self.nowhere or ASIDE.match(f) for f in fs):
                towns.append(fs)
        return towns, countries, regions

    def _tries(self, towns: list[set[str]]) -> Iterator[dict[int, int] | None]:
        """The entries, with distances, each reading of the parts comes near: a town and its river, then the first part; None where
        the part is no town after all."""
        tries = [towns[0]]
        if len(towns) > 1:
            tries.insert(0, {f"{a} {b}" for a in towns[0] for b in towns[1]})
        for fs in tries:
            bare = {TAIL.sub("", FRAME.sub("", f)) for f in fs}
            if any(f in self.nowhere or f in self.countries or f in self.regions for f in bare):
                yield None
                return
            yield self._near({f for f in fs | bare if f})

    def entries(self, mention: str) -> list[tuple[int, int]]:
        """(place id, distance) of every place one of whose writings lies within the distance its length allows."""
        towns, _, _ = self._parts(mention)
        best: dict[int, int] = {}
        for near in self._tries(towns) if towns else ():
            for e, k in (near or {}).items():
                best[self.info[e][0]] = min(k, best.get(self.info[e][0], 9))
        return sorted(best.items(), key=lambda x: (x[1], x[0]))

    def read(self, mention: str) -> list[tuple[int, int]] | None:
        """(place id, distance) of the place a mention names; (-1, 0) for a town not in the list; None if it names no town."""
        towns, countries, regions = self._parts(mention)
        if not towns:
            return None
        for near in self._tries(towns):
            if near is None:
                return None
            picked = self._settle(near, countries, regions) if near else []
            if picked:
                return picked
        return [(-1, 0)]

    def _settle(self, near: dict[int, int], countries: set[str], regions: set[str]) -> list[tuple[int, int]]:
        fits = lambda e: (not countries or self.info[e][1] in countries) and (not regions or self.info[e][2] in regions)
        least = min(near.values())
        close = [e for e, k in near.items() if k == least]
        agreeing = [e for e in close if fits(e)] or [e for e in near if fits(e)]
        if not agreeing:
            # an exact name stands against what is beside it, a misspelled one does not
            if least > 0:
                return []
            agreeing = close
        best = max(agreeing, key=lambda e: (-near[e], self.info[e][3], -self.info[e][0]))
        return [(self.info[best][0], near[best])]


def _read_once(single: DataFrame, places: DataFrame, max_places: int, method: str) -> DataFrame:
    """``mention, place_id, distance`` of each distinct mention, by a method of the :class:`Gazetteer`."""
    rows = [tuple(r) for r in places.select("id", "name", "country", "region", "population", "alternates").limit(max_places + 1).collect()]
    if len(rows) > max_places:
        raise ValueError(f"the reference list has more than {max_places} rows")
    held = single.sparkSession.sparkContext.broadcast(rows)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Gazetteer(held.value)
        for b in batches:
            out = [(m, p, k) for m in b.mention for p, k in getattr(g, method)(m) or []]
            yield pd.DataFrame(out, columns=["mention", "place_id", "distance"])

    # few bytes but much work: spread over all tasks, whatever their size (by a hash, as a plain repartition by the
    # key would fall away after the distinct)
    parts = int(single.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return single.select("mention").distinct().repartition(parts, F.xxhash64("mention")).mapInPandas(read, "mention string, place_id bigint, distance int")


def _mentions(mentions: DataFrame) -> DataFrame:
    return mentions.where("mention IS NOT NULL").select("key", F.explode(F.split("mention", SPLIT)).alias("mention")).where(F.trim("mention") != "").distinct()


def entries_within(mentions: DataFrame, places: DataFrame, max_places: int = 100_000) -> DataFrame:
    """``mention, place_id, distance``: for each distinct mention all places that have a writing within the distance its length
    allows, the automaton's whole answer.  Mentions without a town, or with none near, give no row."""
    return _read_once(_mentions(mentions), places, max_places, "entries")


def map_to_places(mentions: DataFrame, places: DataFrame, max_places: int = 100_000, salts: int = 8) -> DataFrame:
    """``key, mention, place_id, distance``: the place each mention names, -1 if it names a town that is not in the list.

    ``mentions``: key, mention (free text that may hold several towns); ``places``: id, name, country, region, population,
    alternates.  Each distinct mention is read once: a trie of all writings of all places is walked by a Levenshtein
    automaton whose distance depends on the length and which gives all entries within it (:func:`entries_within`).  Of these
    the nearest is taken, and of several the one whose country or region stands beside the name; failing that the most
    populous.  Words around a name (post codes, districts, "near") are set aside.  Mentions without a town give no row; null
    and blank ones neither.

    The list is read into each task and may have at most ``max_places`` rows.
    """
    single = _mentions(mentions)
    found = _read_once(single, places, max_places, "read")
    # a mention may stand in a third of all rows: its rows are spread over salts
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return single.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(spread, ["mention", "salt"]).drop("salt")


def current_facets(facets: DataFrame) -> DataFrame:
    """The row of the highest ``derive_version`` (then latest ``derived_at``) of each posting."""
    w = Window.partitionBy("job_id").orderBy(F.desc_nulls_last("derive_version"), F.desc_nulls_last("derived_at"))
    return facets.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def posting_mentions(jobs: DataFrame, facets: DataFrame) -> DataFrame:
    """What postings say about their places: ``location_text`` and the current ``cities``."""
    text = jobs.select(F.col("id").alias("key"), F.col("location_text").alias("mention"))
    return text.unionByName(current_facets(facets).select(F.col("job_id").alias("key"), F.explode("cities").alias("mention")))
