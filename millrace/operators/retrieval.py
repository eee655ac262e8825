"""Ranked retrieval: exact vector search, weighted word search, fusion of ranked lists, counterfactual positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import reciprocal
from ..functions.text import tokens

#: Queries that travel to the tasks in one pass.
PASS = 4096


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, digits: int = 6, with_sim: bool = False) -> DataFrame:
    """``q, id, pos`` (and ``sim``, if asked for): the ``k`` nearest rows of ``corpus`` (id, vec) by cosine for each of ``queries`` (q, vec), exactly.

    Similarities are rounded to ``digits``; ties go to the smaller id, a query never finds its own id.  Each pass sends about
    ``PASS`` queries and reads the corpus once: tasks keep the best of each batch, so only k rows a query and batch are
    shuffled.  With several passes each is finished and its hits written before the next one's queries are fetched, so the
    driver never holds more than one.  Null, empty, zero and not finite vectors are left out, and those whose length differs from the query's.
    """
    from ..io import cut

    spark = corpus.sparkSession
    good = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    asked = queries.where(good).select("q", "vec")
    n = max(1, -(-asked.count() // PASS))
    out = None
    for s in range(n):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == s).collect() if n > 1 else asked.collect()
        held = spark.sparkContext.broadcast([(r.q, r.vec) for r in rows])

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            by: dict[int, tuple] = {}
            for dim in {len(v) for _, v in held.value}:
                ids = np.array([q for q, v in held.value if len(v) == dim], np.int64)
                m = np.array([v for _, v in held.value if len(v) == dim], float)
                by[dim] = ids, m / np.linalg.norm(m, axis=1, keepdims=True)
            for b in batches:
                size = b.vec.map(len)
                for dim, (qs, m) in by.items():
                    part = b[size == dim]
                    if not len(part):
                        continue
                    v = np.stack(part.vec.to_list()).astype(float)
                    sim = np.round(m @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, digits)
                    ids = part.id.to_numpy()
                    sim[qs[:, None] == ids[None, :]] = -9
                    take = min(k, len(ids))
                    least = -np.partition(-sim, take - 1, axis=1)[:, take - 1]
                    r, c = np.nonzero((sim >= least[:, None]) & (sim > -9))
                    f = pd.DataFrame({"q": qs[r], "id": ids[c], "sim": sim[r, c]}).sort_values(["q", "sim", "id"], ascending=[True, False, True])
                    yield f.groupby("q").head(k)

        hits = corpus.where(good).select(F.col("id").cast("bigint").alias("id"), "vec").mapInPandas(scan, "q bigint, id bigint, sim double")
        if n > 1:
            hits = cut(hits)
            held.unpersist()
        out = hits if out is None else out.unionByName(hits)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return out.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("q", "id", "pos", *(["sim"] if with_sim else []))


def word_index(docs: DataFrame, fields: dict[str, int], asked: DataFrame | None = None) -> DataFrame:
    """``id, term, weight``: each word of a document with the summed weights of the fields it stands in, once for each time.

    With ``asked`` (term) only those words are kept, before anything is grouped or shuffled.
    """
    from ..io import bounded

    parts = None
    for field, weight in fields.items():
        p = docs.select("id", F.explode(tokens(field)).alias("term"), F.lit(weight).alias("w"))
        parts = p if parts is None else parts.unionByName(p)
    if asked is not None:
        parts = parts.join(bounded(asked, 200_000)[0], "term", "left_semi")
    return parts.groupBy("id", "term").agg(F.sum("w").alias("weight"))


def lexical_topk(queries: DataFrame, docs: DataFrame, fields: dict[str, int], k: int = 10) -> DataFrame:
    """``q, id, score, pos``: documents that hold all words of a query, best first (sum of the words' weights, then smaller id).

    The words asked for are indexed once.  A query is driven by its rarest word: only that word's documents are looked up, the
    other words are checked on them.  So a word that stands in a third of all documents is never joined with all queries.
    Queries without words find nothing.
    """
    from ..io import cut

    q = queries.select("q", F.array_distinct(tokens("text")).alias("terms")).where(F.size("terms") > 0)
    each = q.select("q", F.explode("terms").alias("term"))
    index = cut(word_index(docs, fields, each.select("term").distinct()))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    rare = each.join(df, "term", "left").groupBy("q").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    pairs = rare.join(index.select("term", "id"), "term").join(q, "q").select("q", "id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    hits = pairs.join(index, ["id", "term"]).groupBy("q", "id").agg(F.sum("weight").alias("score"), F.count("*").alias("have"), F.first("n").alias("n")).where("have = n")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("q", "id", "score", "pos")


def fuse(lists: DataFrame, rule: str = "rrf", k: int = 60, depth: int | None = None) -> DataFrame:
    """``q, id, score, pos`` from ranked lists (q, arm, id, pos, and ``weight`` for the weighted rules).

    ``rrf`` sums 1/(k+pos) over all lists; ``weighted`` multiplies by the list's weight; ``arm_max`` first reduces each arm to
    an id's best place, re-ranked within the arm, and ``arm_max_weighted`` does both.  Scores are rounded to nine decimals,
    ties go to the smaller id.  With ``depth`` a query's list ends there.
    """
    if rule not in ("rrf", "weighted", "arm_max", "arm_max_weighted"):
        raise ValueError(f"no such rule: {rule}")
    weighted = rule in ("weighted", "arm_max_weighted")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    if rule.startswith("arm_max"):
        best = lists.groupBy("q", "arm", "id").agg(F.min("pos").alias("pos"), *([F.max("weight").alias("weight")] if weighted else []))
        lists = best.withColumn("pos", F.row_number().over(Window.partitionBy("q", "arm").orderBy("pos", "id")))
    gain = reciprocal(F.col("pos"), k) * (F.col("weight") if weighted else F.lit(1.0))
    out = lists.groupBy("q", "id").agg(F.round(F.sum(gain), 9).alias("score")).withColumn("pos", F.row_number().over(w))
    return out.where(F.col("pos") <= depth) if depth else out


def best_ranks(lists: DataFrame) -> DataFrame:
    """``q, id, pos``: an id's best place in any of a query's lists."""
    return lists.groupBy("q", "id").agg(F.min("pos").alias("pos"))


def counterfactual(pool: DataFrame, probes: DataFrame, depth: int) -> DataFrame:
    """``q, id, place``: where a probe would stand in its query's pool if it were added: after all strictly nearer rows.

    ``pool``: q, id, dist; ``probes``: q, id, dist.  The probe's own row does not count; beyond ``depth`` the place is null.
    """
    p = probes.select("q", F.col("id").alias("probe"), F.col("dist").alias("at"))
    n = p.join(pool, "q", "left").groupBy("q", "probe").agg(F.count_if((F.col("id") != F.col("probe")) & (F.col("dist") < F.col("at"))).alias("n"))
    return n.select("q", F.col("probe").alias("id"), F.when(F.col("n") < depth, F.col("n") + 1).alias("place"))
