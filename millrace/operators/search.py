"""Word search: stemmed words with weighted fields, or a substring of the short fields; newest first among equals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, tokens
from ..io import bounded, cut

# Words too common to search for, folded.
STOP = tuple("a als am an and are at auf aus bei das de dem den der des die du ein eine einen einer en es et fur gender het i im in is ist la le les m mit nach of on oder of pour que se sie sind the to und van vom von w we wir with x y zu zum zur".split())
#: Endings taken off a word, the longest first; what is left keeps at least four letters.
ENDINGS = r"^(.{4,}?)(?:innen|ungen|ing|ern|ung|em|er|en|es|in|e|n|s)$"
#: Weights of the fields of a posting.
WEIGHTS = {"title": 10, "company": 4, "location": 2, "description": 1}
#: Queries whose texts travel to the tasks in one pass.
PASS = 4096


def stem(word: Column) -> Column:
    """A folded word without its ending."""
    return F.regexp_replace(word, ENDINGS, "$1")


def stems(text: Column | str) -> Column:
    """The stems of a text's words without stop words, in order, repeats kept; empty for null and wordless texts."""
    return F.transform(F.filter(tokens(text), lambda w: ~w.isin(*STOP)), stem)


def parse(queries: DataFrame) -> DataFrame:
    """``q, wanted, unwanted, folded`` of queries (q, text): the stems that must occur, those after a minus that must not, and the
    folded text without the latter, for the substring arm.  Queries without any word are left out."""
    q = queries.where("text IS NOT NULL").withColumn("plus", F.regexp_replace("text", r"(^|\s)-\S+", " "))
    minus = F.array_join(F.regexp_extract_all("text", F.lit(r"(?:^|\s)-(\S+)"), F.lit(1)), " ")
    q = q.select("q", F.array_distinct(stems("plus")).alias("wanted"), F.array_distinct(stems(minus)).alias("unwanted"), F.trim(F.regexp_replace(fold("plus"), r"\s+", " ")).alias("folded"))
    return q.where("folded <> ''")


def _postings(docs: DataFrame, asked: DataFrame, weights: dict[str, int]) -> DataFrame:
    """``id, term, weight`` of the asked terms alone: only they are grouped and shuffled."""
    parts = None
    for field, weight in weights.items():
        p = docs.select("id", F.explode(stems(field)).alias("term"), F.lit(weight).alias("w"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.join(bounded(asked, 200_000)[0], "term", "left_semi").groupBy("id", "term").agg(F.sum("w").alias("weight"))


def _substrings(queries: DataFrame, docs: DataFrame, short: list[str]) -> DataFrame:
    """``q, id``: documents whose short fields, folded and joined, contain a query's folded text.

    The corpus is read once for every ``PASS`` queries; an automaton of all their texts reads each document once.
    """
    n = max(1, -(-queries.count() // PASS))
    text = docs.select("id", F.regexp_replace(fold(F.concat_ws(" ", *short)), r"\s+", " ").alias("t"))
    out = None
    for s in range(n):
        rows = (queries.where(F.pmod(F.xxhash64("q"), F.lit(n)) == s) if n > 1 else queries).select("q", "folded").collect()
        held = docs.sparkSession.sparkContext.broadcast([(r.q, r.folded) for r in rows])

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            import ahocorasick

            by: dict[str, list] = {}
            for q, t in held.value:
                by.setdefault(t, []).append(q)
            machine = ahocorasick.Automaton()
            for t in by:
                machine.add_word(t, t)
            machine.make_automaton()
            for b in batches:
                hits = [(q, i) for i, t in zip(b.id, b.t) if by for found in {w for _, w in machine.iter(t)} for q in by[found]]
                yield pd.DataFrame(hits, columns=["q", "id"])

        hits = text.mapInPandas(scan, "q bigint, id bigint")
        if n > 1:
            hits = cut(hits)
            held.unpersist()
        out = hits if out is None else out.unionByName(hits)
    return out


def word_matches(queries: DataFrame, docs: DataFrame, weights: dict[str, int] | None = None, short: tuple[str, ...] = ("title", "company", "location")) -> DataFrame:
    """``q, id, rank``: documents that hold all stems of a query and none it excludes, or whose short fields contain its text.

    ``queries``: q, text; ``docs``: id and the fields of ``weights``.  ``rank`` sums the weights of the fields the query's stems
    stand in, once for each time; what only the substring finds has 0.  A query is driven by its rarest stem, so a word in a
    third of all documents is never joined with all queries.  Null fields count as empty.
    """
    weights = weights or WEIGHTS
    q = cut(parse(queries))
    terms = q.select("q", F.explode("wanted").alias("term"))
    out_terms = q.select("q", F.explode("unwanted").alias("term"))
    index = cut(_postings(docs, terms.unionByName(out_terms).select("term").distinct(), weights))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    each = terms.join(df, "term", "left")
    rare = each.groupBy("q").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    pairs = rare.join(index.select("term", "id"), "term").join(q.select("q", "wanted"), "q").select("q", "id", F.size("wanted").alias("n"), F.explode("wanted").alias("term"))
    whole = pairs.join(index, ["id", "term"]).groupBy("q", "id").agg(F.sum("weight").alias("rank"), F.count("*").alias("have"), F.first("n").alias("n")).where("have = n").select("q", "id", "rank")
    part = _substrings(q, docs, list(short)).select("q", "id", F.lit(0).cast("bigint").alias("rank"))
    both = whole.unionByName(part).groupBy("q", "id").agg(F.max("rank").alias("rank"))
    banned = both.join(out_terms, "q").join(index.select("id", "term"), ["id", "term"]).select("q", "id")
    return both.join(banned, ["q", "id"], "left_anti")


def newest_first(matches: DataFrame, docs: DataFrame, posted: str = "posted", k: int | None = None) -> DataFrame:
    """``q, id, rank, pos``: matches by rank, then newer first, undated last, then smaller id; the first ``k`` of each query."""
    w = Window.partitionBy("q").orderBy(F.desc("rank"), F.desc_nulls_last(posted), "id")
    out = matches.join(docs.select("id", posted), "id").withColumn("pos", F.row_number().over(w))
    return (out.where(F.col("pos") <= k) if k else out).select("q", "id", "rank", "pos")


def lexical_place(pool: DataFrame, probes: DataFrame, posted: str = "posted") -> DataFrame:
    """``q, id, before``: how many of a pool stand before a probe that is not in it: those of greater rank, and of equal rank the
    newer ones; undated rows come last, and one undated row counts as before another.

    ``pool``: q, id, rank, posted; ``probes`` the same.  The probe's own row in the pool does not count.
    """
    p = probes.select("q", F.col("id").alias("probe"), F.col("rank").alias("r"), F.col(posted).alias("at"))
    newer = F.when(F.col("at").isNull(), True).when(F.col(posted).isNull(), False).otherwise(F.col(posted) > F.col("at"))
    ahead = (F.col("rank") > F.col("r")) | ((F.col("rank") == F.col("r")) & newer)
    j = p.join(pool.select("q", "id", "rank", posted), "q", "left")
    return j.groupBy("q", "probe").agg(F.count_if((F.col("id") != F.col("probe")) & ahead).alias("before")).select("q", F.col("probe").alias("id"), "before")


def insert_at(lists: DataFrame, probes: DataFrame, depth: int) -> DataFrame:
    """``q, probe, id, pos``: each query's list (q, id, pos) as it would be with a probe (q, id, before) put in after ``before`` rows:
    its own row goes, later ones move on, and the list ends at ``depth``.  A probe placed beyond the depth is not put in."""
    p = probes.select("q", F.col("id").alias("probe"), "before")
    rest = lists.select("q", "id", "pos").join(p, "q").where(F.col("id") != F.col("probe"))
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("q", "probe").orderBy("pos", "id")))
    moved = F.when(F.col("before").isNotNull() & (F.col("n") > F.col("before")), F.col("n") + 1).otherwise(F.col("n"))
    own = p.where(F.col("before") < depth).select("q", "probe", F.col("probe").alias("id"), (F.col("before") + 1).alias("pos"))
    # a probe whose place lies beyond the list's end stands right after it
    length = rest.groupBy("q", "probe").agg(F.max("n").alias("length"))
    own = own.join(length, ["q", "probe"], "left").select("q", "probe", "id", F.least("pos", F.coalesce("length", F.lit(0)) + 1).alias("pos"))
    return rest.select("q", "probe", "id", moved.alias("pos")).unionByName(own).where(F.col("pos") <= depth)
