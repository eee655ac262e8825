"""New batches deduplicated against all accepted history, by graph index shards."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import bounded, delete, tidy
from .leaks import symbols, words_of

# Words of company names that tell legal form or group, and words of titles that tell no role.
LEGAL = frozenset("gmbh ag se ltd bv sarl kg co ohg group gruppe groupe holding e v ev inc llc sa nv plc srl spa".split())
NO_ROLE = frozenset("m w d f x h e u gn div divers all genders remote".split())

DIM, LINKS, SHARD, QUERY_BLOCK = 256, 12, 1024, 2048
#: Rows about shards that are sent to all tasks.
NAMES = 200_000
EMPTY = "b bigint, a bigint, sim double"


def employer(name: str | None) -> str:
    """A company's name without legal form, folded; names of nothing else stay whole."""
    w = words_of(name)
    return " ".join([x for x in w if x not in LEGAL] or w)


def role(title: str | None) -> str:
    """A title without gender marks, workloads and "remote", folded."""
    return " ".join(x for x in words_of(title) if x not in NO_ROLE and not x.isdigit())


def grams(text: str | None) -> np.ndarray:
    """The bigrams of a text as sorted 32-bit numbers; the n-th copy of a bigram has a number of its own, so that the
    overlap of two such sets is that of the multisets.  A single word stands for itself."""
    return _grams(symbols(words_of(text)))


def _grams(s: np.ndarray) -> np.ndarray:
    g = (s[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ s[1:]) if len(s) > 1 else s
    g = np.sort(g)
    if not len(g):
        return g.astype(np.uint32)
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    nth = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    g = (g + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((g >> np.uint64(32)).astype(np.uint32))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two gram sets."""
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n / max(1, len(a) + len(b) - n)


def shared(a: list[np.ndarray], b: list[np.ndarray], width: int = 16384) -> np.ndarray:
    """(len(a), len(b)) numbers of grams that two gram sets have in common, ``width`` different grams at a time."""
    ga, gb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    held = np.unique(ga)
    at = np.minimum(np.searchsorted(held, gb), len(held) - 1)
    hit = held[at] == gb
    ca, cb, rb = np.searchsorted(held, ga), at[hit], rb[hit]
    out = np.zeros((len(a), len(b)), np.float32)
    for s in range(0, len(held), width):
        w = min(width, len(held) - s)
        x, y = np.zeros((len(a), w), np.float32), np.zeros((len(b), w), np.float32)
        i, j = (ca >= s) & (ca < s + w), (cb >= s) & (cb < s + w)
        x[ra[i], ca[i] - s] = 1
        y[rb[j], cb[j] - s] = 1
        out += x @ y.T
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Count sketches of gram sets, of length one."""
    v = np.zeros((len(sets), DIM), np.float32)
    if sets:
        g = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        sign = np.where(g >> np.uint32(31), 1.0, -1.0)
        v = np.bincount(row * DIM + (g % np.uint32(DIM)).astype(np.int64), sign, len(sets) * DIM).reshape(-1, DIM).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


class Graph:
    """A navigable small-world graph: points enter in random order and link both ways to the nearest before them."""

    def __init__(self, vectors: np.ndarray, indptr: np.ndarray, indices: np.ndarray, beam: int):
        self.vectors, self.indptr, self.indices, self.beam = vectors, indptr, indices, beam

    @classmethod
    def build(cls, vectors: np.ndarray, target: float = 0.98, probes: int = 48) -> Graph:
        n = len(vectors)
        order = np.random.default_rng(1).permutation(n)
        v = vectors[order]
        a, b = [], []
        for s in range(0, n, 512):
            e = min(n, s + 512)
            near = v[s:e] @ v[:e].T
            near[np.arange(e)[None, :] >= np.arange(s, e)[:, None]] = -9
            k = min(LINKS, e)
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            i, j = np.repeat(np.arange(s, e), k), top.ravel()
            ok = near[i - s, j] > -9
            a.append(i[ok]), b.append(j[ok])
        a, b = (np.concatenate(x) if x else np.empty(0, int) for x in (a, b))
        frm, to = order[np.r_[a, b]], order[np.r_[b, a]]
        by = np.lexsort((to, frm))
        g = cls(vectors, np.r_[0, np.cumsum(np.bincount(frm, minlength=n))], to[by].astype(np.int32), 32)
        # the beam is widened until it finds what exhaustive search finds
        if n > g.beam:
            rows = np.unique(np.linspace(0, n - 1, probes).astype(int))
            k = min(10, n)
            exact = np.argsort(-(vectors[rows] @ vectors.T), axis=1, kind="stable")[:, :k]
            while g.beam < n:
                q, node, _ = g.search(vectors[rows])
                got = set((q * n + node).tolist())
                if np.mean([r * n + x in got for r, xs in enumerate(exact) for x in xs]) >= target:
                    break
                g.beam *= 2
        return g

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, similarity) of each query's beam."""
        q, n = len(queries), len(self.vectors)
        if self.beam >= n:
            s = queries @ self.vectors.T
            return np.repeat(np.arange(q), n), np.tile(np.arange(n), q), s.ravel()
        visited = np.zeros((q, n), bool)
        entry = np.unique(np.linspace(0, n - 1, 8).astype(int))
        qs, ns = np.repeat(np.arange(q), len(entry)), np.tile(entry, q)
        visited[qs, ns] = True
        ss = np.einsum("ij,ij->i", queries[qs], self.vectors[ns])
        open_ = np.ones(len(qs), bool)
        while True:
            by = np.lexsort((-ss, qs))
            qs, ns, ss, open_ = qs[by], ns[by], ss[by], open_[by]
            first = np.searchsorted(qs, np.arange(q))
            keep = np.arange(len(qs)) - first[qs] < self.beam
            qs, ns, ss, open_ = qs[keep], ns[keep], ss[keep], open_[keep]
            seen = np.cumsum(open_)
            start = np.searchsorted(qs, np.arange(q))
            base = np.where(start > 0, seen[np.maximum(start - 1, 0)], 0)
            pick = np.flatnonzero(open_ & (seen - base[qs] <= 4))
            if not len(pick):
                return qs, ns, ss
            open_[pick] = False
            lo, deg = self.indptr[ns[pick]], self.indptr[ns[pick] + 1] - self.indptr[ns[pick]]
            at = np.repeat(lo - np.r_[0, np.cumsum(deg)[:-1]], deg) + np.arange(deg.sum())
            cell = np.unique(np.repeat(qs[pick], deg) * n + self.indices[at])
            cell = cell[~visited.ravel()[cell]]
            nq, nn = cell // n, cell % n
            visited[nq, nn] = True
            s = np.einsum("ij,ij->i", queries[nq], self.vectors[nn])
            qs, ns, ss, open_ = np.r_[qs, nq], np.r_[ns, nn], np.r_[ss, s], np.r_[open_, np.ones(len(nq), bool)]


def _pack(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    sets = [np.frombuffer(g, np.uint32) for g in pdf.grams]
    g = Graph.build(sketch(sets))
    # vectors are made from the grams again when they are needed
    blob = _pack(ids=pdf.id.to_numpy(), same=pdf.same.to_numpy(), indptr=g.indptr.astype(np.int32), indices=g.indices, beam=np.array([g.beam]), cut=np.cumsum([0, *map(len, sets)]), grams=np.concatenate(sets) if sets else np.empty(0, np.uint32))
    return pdf[["seg", "chunks", "chunk", "piece"]].head(1).assign(blob=[blob])


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The postings of shards."""
    for b in batches:
        for seg, blob in zip(b.seg.tolist(), b.blob):
            with np.load(io.BytesIO(blob)) as z:
                ids, same, cut, grams = z["ids"], z["same"], z["cut"], z["grams"]
            yield pd.DataFrame({"id": ids, "same": same, "grams": [grams[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], "seg": seg})


def _whole_groups(ids, same, sets, held, held_same, held_sets, least: float) -> Iterator[tuple[int, int, float]]:
    """``b, a, sim`` of queries and all held postings of their role and employer, compared exactly in bounded blocks."""
    order = np.argsort(held_same, kind="stable")
    by = held_same[order]
    mine = np.argsort(same, kind="stable")
    for group in np.split(mine, np.flatnonzero(np.diff(same[mine])) + 1) if len(mine) else []:
        lo, hi = np.searchsorted(by, same[group[0]], "left"), np.searchsorted(by, same[group[0]], "right")
        for s in range(0, len(group), 64):
            q = group[s : s + 64]
            for t in range(lo, hi, 512):
                m = order[t : min(t + 512, hi)]
                n = shared([sets[i] for i in q], [held_sets(k) for k in m])
                sizes = np.array([len(sets[i]) for i in q])[:, None] + np.array([len(held_sets(k)) for k in m])[None, :]
                sim = n.astype(float) / np.maximum(1, sizes - n.astype(np.int64))
                for i, k in zip(*np.nonzero((sim >= least) & (held[m][None, :] < ids[q][:, None]))):
                    yield int(ids[q[i]]), int(held[m[k]]), float(sim[i, k])


def _search_shard(least: float):
    def run(shards: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        sets = [np.frombuffer(g, np.uint32) for g in queries.grams]
        ids, same = queries.id.to_numpy(), queries.same.to_numpy()
        for blob in shards.blob if len(ids) else []:
            with np.load(io.BytesIO(blob)) as z:
                held, held_same, cut, every = z["ids"], z["same"], z["cut"], z["grams"]
                links, beam = (z["indptr"], z["indices"]), int(z["beam"][0])
            # how many of the shard's postings each query may repeat
            order = np.lexsort((held, held_same))
            groups, first = np.unique(held_same[order], return_index=True)
            by = dict(zip(groups.tolist(), np.split(held[order], first[1:])))
            may = np.array([np.searchsorted(by[w], i) if w in by else 0 for w, i in zip(same.tolist(), ids.tolist())], int)
            # a beam cannot hold all of more postings than it is wide, and where there are none there is nothing to find
            live, rest = np.flatnonzero((may > 0) & (may <= beam)), [np.flatnonzero(may > beam)]
            graph = Graph(sketch([every[i:j] for i, j in zip(cut[:-1], cut[1:])]), *links, beam) if len(live) else None
            for s in range(0, len(live), 512):
                here = live[s : s + 512]
                q, node, _ = graph.search(sketch([sets[i] for i in here]))
                q = here[q]
                # the same role at the same employer, accepted before
                ok = (held_same[node] == same[q]) & (held[node] < ids[q])
                # a beam that does not hold all of them is no answer: near copies may fill it
                missed = np.zeros(len(ids), bool)
                missed[here] = np.bincount(q[ok], minlength=len(ids))[here] < may[here]
                rest.append(np.flatnonzero(missed))
                ok &= ~missed[q]
                for i, k in zip(q[ok].tolist(), node[ok].tolist()):
                    sim = overlap(sets[i], every[cut[k] : cut[k + 1]])
                    if sim >= least:
                        out.append((int(ids[i]), int(held[k]), sim))
            r = np.concatenate(rest)
            out += _whole_groups(ids[r], same[r], [sets[i] for i in r], held, held_same, lambda k: every[cut[k] : cut[k + 1]], least)
        return pd.DataFrame(out, columns=["b", "a", "sim"])

    return run


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by its keys over all tasks: groups of few bytes that are much work must not end up in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class RepeatIndex:
    """Stored shards of graphs over accepted postings, in one folder.

    Postings are divided by employer into ``segments``, a number fixed when the index is created; a segment of a layer is divided
    by role and employer into chunks of about ``SHARD`` postings, one that grew beyond twice that into several shards, so none is
    unbounded.  A query is searched in its chunk of each layer alone, so the work of a query does not grow with the index.  Each
    batch adds a layer of shards; when there are more than ``layers`` beside the first, they are compacted into one.  A batch reads
    the shards of the segments it has postings in, and of its own postings alone; earlier ones are not described again.  Where a beam does
    not hold all of a shard's postings of the query's role and employer, it is compared with all of those exactly.

    A layer counts once the manifest names it: a run that ends half-way leaves the index as it was.
    """

    MANIFEST = "version int, segments int, most int, least double, layers array<string>"

    def __init__(self, spark: SparkSession, path: str, version: int, segments: int, most: int, least: float, layers: list[str]):
        self.spark, self.path, self.version = spark, path, version
        self.segments, self.most, self.least, self.layers = segments, most, least, layers

    @classmethod
    def create(cls, spark: SparkSession, path: str, segments: int = 16, layers: int = 4, least: float = 0.5) -> RepeatIndex:
        index = cls(spark, path, 0, segments, layers, least, [])
        index._commit([])
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RepeatIndex:
        r = spark.read.schema(cls.MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        return cls(spark, path, r.version, r.segments, r.most, r.least, list(r.layers))

    def _commit(self, layers: list[str]) -> None:
        row = (self.version + 1, self.segments, self.most, self.least, layers)
        self.spark.createDataFrame([row], self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.version, self.layers = self.version + 1, layers

    def _read(self, layer: str) -> DataFrame:
        return self.spark.read.schema("chunks int, chunk int, piece int, blob binary, seg int").parquet(f"{self.path}/{layer}/shards")

    def describe(self, postings: DataFrame) -> DataFrame:
        return describe(postings).withColumn("seg", F.pmod("who", F.lit(self.segments)).cast("int"))

    def _held(self, postings: DataFrame) -> DataFrame:
        """Described postings; equal ones are held once, under the smallest id."""
        return postings.groupBy("seg", "same", "grams").agg(F.min("id").alias("id"))

    def shards(self, held: DataFrame) -> DataFrame:
        """Shards of postings from :meth:`_held`, which are read twice: their numbers first."""
        # a row a segment, and a row a chunk that has several shards
        sizes = held.groupBy("seg").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("chunks"))
        p = held.join(F.broadcast(sizes), "seg").withColumn("chunk", F.pmod(F.xxhash64("same"), F.col("chunks")).cast("int"))
        large, _ = bounded(p.groupBy("seg", "chunk").agg(F.ceil(F.count("*") / (2 * SHARD)).cast("int").alias("pieces")).where("pieces > 1"), NAMES)
        p = p.join(large, ["seg", "chunk"], "left").withColumn("piece", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # a task has chunks of few segments, so that it writes few files
        p = p.withColumn("lane", F.pmod("chunk", F.lit(-(-4 * parts // self.segments))))
        return p.select("seg", "lane", "chunks", "chunk", "piece", "id", "same", "grams").repartition(parts, "seg", "lane").groupBy("seg", "lane", "chunk", "piece").applyInPandas(_build_shard, "seg int, chunks int, chunk int, piece int, blob binary")

    def _write(self, postings: DataFrame, layer: str) -> None:
        at = f"{self.path}/{layer}"
        with tidy(self.spark):
            self._held(postings).write.mode("overwrite").parquet(f"{at}/postings")
            held = self.spark.read.schema("seg int, same bigint, grams binary, id bigint").parquet(f"{at}/postings")
            self.shards(held).write.mode("overwrite").partitionBy("seg").parquet(f"{at}/shards")
        # the shards hold them too
        delete(self.spark, f"{at}/postings")

    def accept(self, described: DataFrame) -> None:
        """Add described postings as a layer; compact when there are too many."""
        name = f"layer-{self.version + 1}"
        self._write(described, name)
        layers = [*self.layers, name]
        if len(layers) > self.most:
            merged = self._read(layers[1])
            for layer in layers[2:]:
                merged = merged.unionByName(self._read(layer))
            self._write(merged.select("seg", "blob").mapInPandas(_unpack, "id bigint, same bigint, grams binary, seg int"), f"{name}-compact")
            layers = [layers[0], f"{name}-compact"]
        self._commit(layers)

    def search(self, queries: DataFrame, extra: DataFrame | None = None) -> DataFrame:
        """``b, a, sim`` of described queries and the held postings they repeat, in all layers and in ``extra`` shards."""
        # at most as many as the index has segments: only their folders are read
        mine = [r[0] for r in queries.select("seg").distinct().collect()]
        every = [self._read(layer).where(F.col("seg").isin(mine)) for layer in self.layers] + ([extra] if extra is not None else [])
        held = None
        for n, s in enumerate(every):
            s = s.select("seg", "chunks", "chunk", "piece", "blob", F.lit(n).alias("layer"))
            held = s if held is None else held.unionByName(s)
        if held is None:
            return self.spark.createDataFrame([], EMPTY)
        # a row a segment and layer: into how many chunks it is divided
        divided = F.broadcast(held.select(*[F.col(c).alias(c) for c in ("seg", "layer", "chunks")]).distinct())
        asked = queries.select("seg", "id", "same", "grams").join(divided, "seg").withColumn("chunk", F.pmod(F.xxhash64("same"), F.col("chunks")).cast("int"))
        at = ["seg", "layer", "chunk"]
        names, _ = bounded(held.select(*[F.col(c).alias(c) for c in (*at, "piece")]), NAMES)
        blocks, _ = bounded(asked.groupBy(*at).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")), NAMES)
        left = held.drop("chunks").join(blocks, at).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = asked.drop("chunks").join(names, at).join(blocks, at).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        key = [*at, "piece", "block"]
        return _spread(left, *key).groupBy(*key).cogroup(_spread(right, *key).groupBy(*key)).applyInPandas(_search_shard(self.least), EMPTY)

    def add_batch(self, postings: DataFrame) -> DataFrame:
        """``b, a``: the postings of a new batch that repeat an accepted one, or an earlier one of the batch, and which; the others
        are accepted.  Ids are larger than those accepted before."""
        from ..io import cut

        batch = cut(self.describe(postings))
        own = cut(self.shards(cut(self._held(batch))))
        inner = batch.select(F.col("id").alias("a"), F.lit(True).alias("inner"))
        hits = self.search(batch, own).join(inner, "a", "left").select("b", "a", "sim", F.coalesce("inner", F.lit(False)).alias("inner"))
        repeats = cut(_resolve(hits))
        self.accept(batch.join(repeats.select(F.col("b").alias("id")), "id", "left_anti"))
        return repeats


def describe(postings: DataFrame) -> DataFrame:
    """``id, who, same, grams`` of postings (id, title, company, description) that have a description."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            who = [employer(c) for c in b.company]
            same = [f"{w}\n{role(t)}" for w, t in zip(who, b.title)]
            # all words of a batch are hashed at once
            words = [words_of(t) for t in b.description]
            every, ends = symbols([w for ws in words for w in ws]), np.cumsum([0, *map(len, words)])
            sets = [_grams(every[i:j]).tobytes() for i, j in zip(ends[:-1], ends[1:])]
            yield pd.DataFrame({"id": b.id, "who": symbols(who).astype(np.int64), "same": symbols(same).astype(np.int64), "grams": pd.Series(sets, dtype=object)})

    p = postings.where("description IS NOT NULL AND id IS NOT NULL").select("id", "title", "company", "description")
    return p.mapInPandas(run, "id bigint, who bigint, same bigint, grams binary").where(F.length("grams") > 0)


def _resolve(edges: DataFrame) -> DataFrame:
    """``b, a``: repeats and the accepted posting of each, from the candidate ``edges`` of one batch.

    A posting that repeats an accepted one is not accepted itself.  Rounds over the edges inside the batch: who has no edge
    left to an undecided posting is accepted, who has one to an accepted posting is a repeat.
    """
    from ..io import cut

    best = lambda e: e.groupBy("b").agg(F.max_by("a", F.struct("sim", -F.col("a"))).alias("a"))
    edges = cut(edges)
    inner = edges.where("inner")
    done = best(edges.where("NOT inner"))
    open_ = inner.join(done.select("b"), "b", "left_anti").join(done.select(F.col("b").alias("a")), "a", "left_anti")
    while True:
        open_ = cut(open_)
        if not open_.take(1):
            return done
        undecided = open_.select("b").distinct()
        firm = open_.join(undecided.select(F.col("b").alias("a")), "a", "left_anti")
        new = cut(best(firm))
        done = done.unionByName(new)
        # edges of and to new repeats fall away; a posting left without edges is accepted
        open_ = open_.join(new.select("b"), "b", "left_anti").join(new.select(F.col("b").alias("a")), "a", "left_anti")


def find_repeats(postings: DataFrame, least: float = 0.5, layers: int = 4, segments: int = 16, path: str | None = None) -> DataFrame:
    """``b, a``: postings of batches 1 and later and the accepted posting each repeats (smaller id, earlier or same batch).

    A repeat has the same role and employer (titles and names folded) and a description whose bigrams overlap by ``least``
    (Jaccard of multisets, so order of sentences hardly counts).  Batches go one after the other into a :class:`RepeatIndex`, kept
    at ``path`` or, without one, for this run: a batch is searched in the index and in shards of its own, its accepted
    postings become a new layer.  Null, empty and wordless descriptions are no cases; postings alike in everything repeat the
    one with the smallest id.
    """
    from ..io import scratch

    spark = postings.sparkSession
    batch_no = F.coalesce("batch_no", F.lit(0))
    # one number a delivery
    batches = sorted(r[0] for r in postings.select(batch_no.alias("b")).where("b > 0").distinct().collect())
    index = RepeatIndex.create(spark, path or scratch(spark, "repeats"), segments, layers, least)
    index.accept(index.describe(postings.where(batch_no <= 0)))
    out = None
    for k in batches:
        repeats = index.add_batch(postings.where(batch_no == k))
        out = repeats if out is None else out.unionByName(repeats)
    return out if out is not None else spark.createDataFrame([], "b bigint, a bigint")
