"""Mixing sources to target weights."""

from __future__ import annotations

import base64
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind split text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Writings of languages.
LANGUAGES = {
    "de": ("de", "deu", "ger", "german", "deutsch"), "en": ("en", "eng", "english", "englisch"), "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"), "es": ("es", "spa", "spanish", "español", "espanol"), "it": ("it", "ita", "italian", "italiano"),
}

def language_code(col: Column) -> Column:
    """The code of a language written as code, name or locale; null for anything else."""
    base = F.regexp_replace(F.lower(F.trim(col)), r"[-_].*$", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for code, ways in LANGUAGES.items() for w in ways for x in (w, code)]), base)


def source_name(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")


def token_counts(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a public byte-level BPE; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        if path not in _encoders:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _encoders[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        encode = _encoders[path].encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


_encoders: dict = {}


def _fill(leaves: list[dict], amount: float) -> float:
    """Give ``amount`` to leaves with room, in proportion to their weights; what finds no room comes back."""
    while amount > 1e-6:
        room = [x for x in leaves if x["cap"] - x["budget"] > 1e-9 and x["weight"] > 0]
        if not room:
            break
        total = sum(x["weight"] for x in room)
        # up to the point where the first leaf is full, all grow in proportion
        step = min(amount, min((x["cap"] - x["budget"]) * total / x["weight"] for x in room))
        for x in room:
            x["budget"] = min(x["cap"], x["budget"] + step * x["weight"] / total)
        amount -= step
    return amount


def budget_tree(leaves: list[dict], size: float) -> list[dict]:
    """Budgets of leaves (domain, language, source, weight, cap) that sum to ``size`` as far as the caps allow.

    Each leaf begins with its weight's share.  What a leaf cannot hold goes to its siblings under the same language, then
    to the domain's other languages, then to the whole tree.
    """
    total = sum(x["weight"] for x in leaves)
    short: dict = defaultdict(float)
    for x in leaves:
        want = size * x["weight"] / total if total > 0 else 0.0
        x["budget"] = min(x["cap"], want)
        short[(x["domain"], x["language"])] += want - x["budget"]
    for level in (("domain", "language"), ("domain",), ()):
        groups = defaultdict(list)
        for x in leaves:
            groups[tuple(x[c] for c in level)].append(x)
        due: dict = defaultdict(float)
        for key, amount in short.items():
            due[key[: len(level)]] += amount
        short = {key: _fill(groups[key], amount) for key, amount in due.items()}
    return leaves


def _plan_leaves(leaves: pd.DataFrame) -> pd.DataFrame:
    """What one plan takes of each of its leaves: whole epochs, and tokens of one more."""
    rows = [{"domain": x.domain, "language": x.language, "source": x.source, "weight": x.weight, "cap": float(x.held) * x.max_repeats, "held": int(x.held), "most": int(x.max_repeats)} for x in leaves.itertuples()]
    out = []
    for x in budget_tree(rows, float(leaves["size"].iloc[0])) if rows else []:
        if x["held"]:
            whole = min(int(x["budget"] // x["held"]), x["most"])
            rest = int(x["budget"] - whole * x["held"] + 0.5) if whole < x["most"] else 0
            if whole or rest:
                out.append((leaves.plan.iloc[0], x["domain"], x["language"], x["source"], whole, rest))
    return pd.DataFrame(out, columns=["plan", "domain", "language", "source", "whole", "rest"])


def mix(documents: DataFrame, targets: DataFrame, seed: int = 1, bucket_rows: int = 50_000, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The selection and the report of each plan.

    ``documents``: doc_id, text, source, lang, kind; ``targets``: plan, source, target_share, max_repeats, corpus_fraction.
    Selection: ``plan, doc_id, source, copies, tokens`` (``copies`` ≥ 1).  Report: ``plan, source, target_share, actual_share,
    tokens, available_tokens, max_copies, shortage``; the actual shares are of all tokens the plan reached and sum to one.

    The tree is domain (kind), language, source; a source's weight divides over its leaves by their tokens.  A plan's tree, one
    row a leaf, is worked out in one task.  A leaf is taken in whole epochs, then as a prefix of one more seeded order while
    tokens last; the prefix sums run over hash ranges of about ``bucket_rows`` documents, so no source is sorted in one task.
    A source without documents leaves its share to others; documents whose source is in no plan, and null or empty texts, are
    not taken.  A null ``max_repeats`` counts as 1.
    """
    from ..io import bounded, cut

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.coalesce("source", F.lit(""))).alias("source"), F.coalesce(language_code(F.col("lang")), F.lit("und")).alias("language"), F.coalesce("kind", F.lit("")).alias("domain"), token_counts(F.col("text"), tokenizer).alias("tokens"))
    docs = cut(docs.where("tokens > 0"))
    buckets = max(64, -(-docs.count() // bucket_rows))
    held = cut(docs.groupBy("domain", "language", "source").agg(F.sum("tokens").alias("held")))
    of_source = held.groupBy("source").agg(F.sum("held").alias("available_tokens"))
    everything = held.agg(F.sum("held").alias("everything"))
    plans = targets.select("plan", source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), "corpus_fraction")
    # one row beside each row
    goal = plans.crossJoin(everything).join(of_source, "source", "left").select("plan", "source", F.col("target_share").cast("double").alias("target_share"), F.coalesce("available_tokens", F.lit(0)).cast("bigint").alias("available_tokens"), F.col("max_repeats").cast("int").alias("max_repeats"), (F.col("corpus_fraction").cast("double") * F.coalesce("everything", F.lit(0))).alias("size"))
    weight = F.when(F.col("available_tokens") > 0, F.col("target_share") * F.col("held") / F.col("available_tokens")).otherwise(F.col("target_share"))
    leaves = goal.join(held, "source", "left").select("plan", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("language", F.lit("")).alias("language"), "source", weight.alias("weight"), F.coalesce("held", F.lit(0)).alias("held"), "max_repeats", "size")
    leaf = cut(leaves.groupBy("plan").applyInPandas(_plan_leaves, "plan string, domain string, language string, source string, whole int, rest bigint"))
    d = docs.join(bounded(leaf, 200_000)[0], ["domain", "language", "source"])
    # the order of the epoch after the whole ones; another seed for each plan and epoch
    d = d.withColumn("o", F.xxhash64(F.lit(seed), "plan", "whole", "doc_id"))
    d = d.withColumn("bucket", F.floor(F.col("o").cast("double") / 2.0**64 * buckets + buckets / 2).cast("int"))
    key = ["plan", "domain", "language", "source"]
    sums = d.where("rest > 0").groupBy(*key, "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = sums.select(*key, "bucket", (F.sum("in_bucket").over(Window.partitionBy(*key).orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    run = F.sum("tokens").over(Window.partitionBy(*key, "bucket").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    part = d.where("rest > 0").join(before, [*key, "bucket"]).withColumn("upto", F.col("before") + run).where(F.col("upto") <= F.col("rest"))
    taken = d.where("whole > 0").select("plan", "doc_id", "source", F.col("whole").alias("copies"), "tokens").unionByName(part.select("plan", "doc_id", "source", F.lit(1).alias("copies"), "tokens"))
    selection = cut(taken.groupBy("plan", "doc_id", "source").agg(F.sum("copies").cast("int").alias("copies"), F.max("tokens").alias("tokens")))
    got = selection.groupBy("plan", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("max_copies"))
    reached = got.withColumn("reached", F.sum("tokens").over(Window.partitionBy("plan")))
    tokens = F.coalesce("tokens", F.lit(0))
    report = goal.join(reached, ["plan", "source"], "left").select("plan", "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("reached"), F.lit(0.0)), 6).alias("actual_share"), tokens.alias("tokens"), "available_tokens", F.coalesce("max_copies", F.lit(0)).alias("max_copies"), (F.col("available_tokens") * F.col("max_repeats") < F.col("target_share") * F.col("size")).alias("shortage"))
    return selection, report
