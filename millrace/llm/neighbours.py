"""The most similar vectors for every vector, by multiprobe p-stable hashing."""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the sketch that sifts bucket mates, bits within which a mate counts as near, and bits kept beyond the k-th best.
BITS, NEAR, MARGIN = 256, 72, 16
#: Entries of a stored part of a table, vectors of a group of members, queries of a block, queries worked on at once.
PART, GROUP, BLOCK, ASKED = 250_000, 4096, 8192, 1024
#: Candidates a query carries along singly; a query with more is compared with whole groups instead.
CROWD = 512
#: What a part of a table holds beside its sorted keys.
ENTRY = np.dtype([("at", "<i8"), ("sketch", "<u8", BITS // 64)])


class Tables:
    """Hash tables of p-stable projections for ``n`` unit vectors of ``dim`` numbers.

    Each table has K hashes floor((a·v + b) / w).  K grows with log n, so that buckets grow far slower than n; the number of
    perturbed buckets a query visits beside its own grows as n to the power 0.18.  They are visited in the order of their
    estimated chance: the sets of perturbations are ranked once by expected distances, and each query maps the ranks to its
    own nearest boundaries.
    """

    def __init__(self, dim: int, n: int, tables: int = 8, seed: int = 11):
        scale = max(n, 2) / 1000
        self.k = max(2, round(7 + 0.7 * math.log2(scale)))
        self.w, self.probes, self.tables = 1.6, min(3**self.k - 1, max(2, round(30 * scale**0.18))), tables
        #: leading bits of a key that tell the part of the table
        self.bits = max(0, math.ceil(math.log2(max(n, 1) / PART)))
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((dim, tables * self.k)).astype(np.float32)
        self.b = rng.uniform(0, self.w, tables * self.k).astype(np.float32)
        self.mult = rng.integers(1, 2**63, (tables, self.k), dtype=np.uint64) | np.uint64(1)
        self.planes = rng.standard_normal((dim, BITS)).astype(np.float32)
        self.sets = self._ranked()

    def _ranked(self) -> list[tuple[int, ...]]:
        k = self.k
        z = [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, 2 * k + 1)]
        heap, out = [(z[0], (0,))], []
        while heap and len(out) < self.probes:
            s, a = heapq.heappop(heap)
            if len({min(j, 2 * k - 1 - j) for j in a}) == len(a):
                out.append(a)
            e = a[-1]
            if e + 1 < 2 * k:
                heapq.heappush(heap, (s - z[e] + z[e + 1], a[:-1] + (e + 1,)))
                heapq.heappush(heap, (s + z[e + 1], a + (e + 1,)))
        return out

    def keys(self, unit: np.ndarray, own: bool = False) -> np.ndarray:
        """(tables, vectors, 1 + probes) bucket keys of 32 bits, the own bucket first (or alone); keys that meet by chance cost a comparison."""
        n, k = len(unit), self.k
        sets = [] if own else self.sets
        f = (unit @ self.a + self.b) / self.w
        base = np.floor(f)
        part = (f - base).reshape(n, self.tables, k)
        cell = base.astype(np.int64).astype(np.uint64).reshape(n, self.tables, k)
        out = np.empty((self.tables, n, 1 + len(sets)), np.uint64)
        for t in range(self.tables):
            home = (cell[:, t] * self.mult[t]).sum(1, dtype=np.uint64)
            order = np.argsort(np.concatenate([part[:, t], 1 - part[:, t]], axis=1), axis=1)
            step = np.concatenate([-self.mult[t].astype(np.int64), self.mult[t].astype(np.int64)]).astype(np.uint64)[order]
            out[t, :, 0] = home
            for p, ranks in enumerate(sets):
                out[t, :, 1 + p] = home + step[:, list(ranks)].sum(1, dtype=np.uint64)
            out[t] = (out[t] ^ (out[t] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (out >> np.uint64(32)).astype(np.uint32)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.planes > 0, axis=1)


def _local(uri: str) -> str:
    """The path of a shared folder; tasks read from the middle of files there, so it must be mounted wherever they run."""
    m = re.match(r"(?:file:)?/+(.*)$", uri)
    if not m:
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder here, not {uri}")
    return f"/{m[1]}"


class Store:
    """Vectors in files of a shared folder, written once and read by place: the task that wrote, the row in its file, and
    whether the file has 32 bits a number (else 16, where that loses nothing)."""

    def __init__(self, path: str, dim: int):
        self.path, self.dim, self.maps = path, dim, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    def writer(self, files: ExitStack) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function that writes rows of 32-bit numbers with their keys in this task and gives their places."""
        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get().taskAttemptId()
        out = [[files.enter_context(open(f"{self.path}/{task}-{wide}{what}", "wb")) for what in ("", ".key")] for wide in (0, 1)]
        rows = [0, 0]

        def put(raw: np.ndarray, keys: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                half = raw.astype(np.float16)
            wide = (half.astype(np.float32) != raw).any(1)
            at = np.empty(len(raw), np.int64)
            for w, mine in ((0, ~wide), (1, wide)):
                out[w][0].write((raw if w else half)[mine].tobytes())
                out[w][1].write(keys[mine].tobytes())
                at[mine] = task << 32 | (np.arange(mine.sum()) + rows[w]) << 1 | w
                rows[w] += int(mine.sum())
            return at

        return put

    def _read(self, at: np.ndarray, what: str, out: np.ndarray) -> np.ndarray:
        file, row = at >> 32 << 1 | at & 1, (at & 0xFFFFFFFF) >> 1
        by = np.lexsort((row, file))
        for mine in np.split(by, np.flatnonzero(np.diff(file[by])) + 1) if len(at) else []:
            f = int(file[mine[0]])
            if (f, what) not in self.maps:
                kind = np.int64 if what else np.float32 if f & 1 else np.float16
                self.maps[f, what] = np.memmap(f"{self.path}/{f >> 1}-{f & 1}{what}", kind, "r").reshape(-1, *out.shape[1:])
            out[mine] = self.maps[f, what][row[mine]]
        return out

    def __call__(self, at: np.ndarray) -> np.ndarray:
        """The vectors at these places."""
        return self._read(at, "", np.empty((len(at), self.dim), np.float32))

    def keys(self, at: np.ndarray) -> np.ndarray:
        return self._read(at, ".key", np.empty(len(at), np.int64))


def _vectors(col: pd.Series, dim: int) -> np.ndarray:
    """Rows of numbers from their bytes."""
    out = np.empty((len(col), dim), np.float32)
    for i, b in enumerate(col):
        out[i] = np.frombuffer(b, np.float16 if len(b) == 2 * dim else np.float32)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    d = v.astype(np.float64)
    # scaled first, so that the length of huge or tiny vectors neither overflows nor vanishes
    d /= np.abs(d).max(1, keepdims=True)
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def usable_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """``key, space, vec``: the latest row of each key, if its vector has ``dim`` finite numbers, not all zero.

    Of rows of equal time the one with the larger vector (as an array, nulls least) counts, so the choice is stable.
    """
    rows = rows.where("key IS NOT NULL")
    latest = rows.groupBy("key").agg(F.max_by(F.struct("space", "vec"), F.struct("stamp", "vec")).alias("r")).select("key", "r.*")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return latest.where(F.col("space").isNotNull() & (F.size("vec") == dim)).where(F.forall("vec", good) & F.exists("vec", lambda x: x != 0))


def _nearest(q: np.ndarray, c: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates in the order of queries, of each query the ``CROWD`` nearest; and whether the query had more."""
    by = np.lexsort((c, h, q))
    q, c, h = q[by], c[by], h[by]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    size = np.diff(np.r_[start, len(q)])
    keep = np.arange(len(q)) - np.repeat(start, size) < CROWD
    return q[keep], c[keep], h[keep], np.repeat(size > CROWD, size)[keep]


def _lists(q: np.ndarray, c: np.ndarray, h: np.ndarray, more: np.ndarray) -> pd.DataFrame:
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    end = np.r_[start[1:], len(q)]
    return pd.DataFrame({"q": q[start], "cs": pd.Series([c[i:j].tobytes() for i, j in zip(start, end)], dtype=object), "hs": pd.Series([h[i:j].tobytes() for i, j in zip(start, end)], dtype=object), "more": more[start]})


_NONE = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int16), np.empty(0, bool))


def _sift(q_of: np.ndarray, lo: np.ndarray, n: np.ndarray, cid: np.ndarray, sk: np.ndarray, home_id: np.ndarray, home_sk: np.ndarray, bits_more: int, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of queries from their mates: query number ``q_of``, in order, meets the ``n`` homes from ``lo`` on."""
    asks = len(cid)
    counts, mates = np.bincount(q_of, minlength=asks), np.bincount(q_of, n, asks).astype(np.int64)
    out = []
    # as many queries at once as have about a million mates
    edges = np.searchsorted(np.cumsum(mates), np.arange(0, mates.sum() + 1_000_000, 1_000_000), "left")
    edges = np.unique(np.r_[edges + 1, np.arange(0, asks, 4096), asks].clip(0, asks))
    edges = np.unique(np.r_[0, edges])
    first = np.r_[0, np.cumsum(counts)]
    for a, b in zip(edges[:-1], edges[1:]):
        s = slice(first[a], first[b])
        m = n[s]
        if not m.sum():
            continue
        c = np.repeat(lo[s] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
        q = np.repeat(q_of[s], m)
        h = np.bitwise_count(sk[q] ^ home_sk[c]).sum(1, dtype=np.int16)
        h[cid[q] == home_id[c]] = BITS + 1
        # the best-th smallest of each query from counts by bits: no sorting of all mates
        near = np.bincount((q - a) * (BITS + 2) + h, minlength=(b - a) * (BITS + 2)).reshape(b - a, BITS + 2)[:, : BITS + 1].cumsum(1)
        enough = np.minimum(near[:, -1], best)
        bound = (near >= np.maximum(enough, 1)[:, None]).argmax(1) + bits_more
        keep = np.flatnonzero((h <= bound[q - a]) & (h <= BITS))
        out.append(_nearest(cid[q[keep]], home_id[c[keep]], h[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else _NONE


def _cell_pairs(bits_more: int, best: int):
    """Candidates of the queries in one cell of a table: those within ``bits_more`` bits of the query's ``best``-th nearest.

    The ``best``-th nearest of a cell is no nearer than that of the whole table, so a table's cells together keep at least what
    the table would.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_home = pdf.home.to_numpy()
        homes, asks = pdf[is_home], pdf[~is_home]
        if not len(homes) or not len(asks):
            return _lists(*_NONE)
        sketch = lambda f: np.frombuffer(b"".join(f.sketch), np.uint64).reshape(len(f), -1)
        own = np.frombuffer(b"".join(homes["keys"]), np.uint32)
        by = np.argsort(own, kind="stable")
        own, home_id, home_sk = own[by], homes.cid.to_numpy()[by], sketch(homes)[by]
        cid, sk = asks.cid.to_numpy(), sketch(asks)
        counts = asks["keys"].map(len).to_numpy() // 4
        probe = np.frombuffer(b"".join(asks["keys"]), np.uint32)
        lo, n = np.searchsorted(own, probe, "left"), np.searchsorted(own, probe, "right")
        return _lists(*_sift(np.repeat(np.arange(len(asks)), counts), lo, n - lo, cid, sk, home_id, home_sk, bits_more, best))

    return run


def _union(q: np.ndarray, c: np.ndarray, h: np.ndarray, more: np.ndarray, bits_more: int, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of all tables in one: the same rule over all of them."""
    if not len(q):
        return _NONE
    by = np.lexsort((c, h, q))
    q, c, h, more = q[by], c[by], h[by], more[by]
    more = np.maximum.reduceat(more, np.flatnonzero(np.r_[True, q[1:] != q[:-1]]))
    once = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])]
    q, c, h = q[once], c[once], h[once]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    size = np.diff(np.r_[start, len(q)])
    keep = h <= np.repeat(h[start + np.minimum(best, size) - 1] + bits_more, size)
    q, c, h, cut = _nearest(q[keep], c[keep], h[keep])
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    return q, c, h, np.repeat(more | cut[start], np.diff(np.r_[start, len(q)]))


def _merge(bits_more: int, best: int):
    """As :func:`_union`, of lists of candidates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf.cs.map(len).to_numpy() // 8
        q, more = np.repeat(pdf.q.to_numpy(), size), np.repeat(pdf.more.to_numpy(), size)
        q, c, h, more = _union(q, np.frombuffer(b"".join(pdf.cs), np.int64), np.frombuffer(b"".join(pdf.hs), np.int16), more, bits_more, best)
        return pd.DataFrame({"q": q, "c": c, "h": h.astype(np.int32), "more": more})

    return run


def _exact(k: int, dim: int, read: Store | None = None):
    """The best candidates of each query of a block among a group's members: similarities in 64 bits, rounded to six decimals.

    A query whose candidates are not listed is compared with all members of the group.  Vectors come along as bytes, or are
    read from a store.
    """
    want = k + 1
    vectors = lambda f: _vectors(f.vec, dim) if read is None else read(f["at"].to_numpy())

    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(queries):
            members = members.sort_values("cid", ignore_index=True)
            m, mc, ids = _unit(vectors(members)), members.cid.to_numpy(), members.ids.tolist()
            u, qc = _unit(vectors(queries)), queries.cid.to_numpy()
            listed = queries.cands.notna().to_numpy()
            lists = [np.asarray(x, np.int64) for x in queries.cands[listed]]
            rows = np.repeat(np.flatnonzero(listed), [len(x) for x in lists])
            cols = np.searchsorted(mc, np.concatenate(lists)) if lists else np.empty(0, np.int64)
            pairs = [(rows[s : s + 20_000], cols[s : s + 20_000]) for s in range(0, len(rows), 20_000)]
            rest = np.flatnonzero(~listed)
            for s in range(0, len(rest), 512):
                r = rest[s : s + 512]
                near = u[r].astype(np.float32) @ m.T.astype(np.float32)
                near[qc[r][:, None] == mc[None, :]] = -9
                take = min(want, near.shape[1])
                least = -np.partition(-near, take - 1, axis=1)[:, take - 1]
                x, y = np.nonzero((near >= least[:, None] - 2e-5) & (near > -9))
                pairs.append((r[x], y))
            found: dict[int, list] = {}
            for r, c in pairs:
                sims = np.round(np.einsum("ij,ij->i", u[r], m[c]), 6)
                for i, j, x in zip(r.tolist(), c.tolist(), sims.tolist()):
                    found.setdefault(i, []).append((-x, j))
            for r, xs in found.items():
                best = sorted((x, i) for x, j in xs for i in ids[j])[:want]
                out.extend((int(qc[r]), int(i), -x) for x, i in best)
        return pd.DataFrame(out, columns=["cid", "key", "sim"])

    return run


def _asking(spaces: dict[str, tuple[Tables, dict]], read: Store, k: int, dim: int):
    """``at, c, sim, lead`` of classes: keys of a query's best merged candidates, compared exactly, and the place of its first near one.

    A query whose candidates are no answer has no ``sim``: one with too many gives the places of the nearest, one with too few no ``c``.
    """
    maps: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    compare = _exact(k, dim, read)

    def opened(name: str) -> tuple[np.ndarray, np.ndarray]:
        if name not in maps:
            maps[name] = np.memmap(f"{read.path}/{name}.tags", np.uint32, "r"), np.memmap(f"{read.path}/{name}.rows", ENTRY, "r")
        return maps[name]

    def candidates(t: Tables, parts: dict, at: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, ...]:
        sk, keys = t.sketch(unit).view(np.uint64), t.keys(unit)
        found = []
        for n in range(t.tables):
            probe, q_of = keys[n].ravel(), np.repeat(np.arange(len(at)), keys.shape[2])
            by = np.argsort(probe)
            probe, q_of = probe[by], q_of[by]
            ends = np.searchsorted(probe.astype(np.int64), np.arange(2**t.bits + 1) << (32 - t.bits))
            for part in range(2**t.bits):
                p, q = probe[ends[part] : ends[part + 1]], q_of[ends[part] : ends[part + 1]]
                for name in parts.get((n, part), []):
                    own, rows = opened(name)
                    lo = np.searchsorted(own, p, "left")
                    size = np.searchsorted(own, p, "right") - lo
                    hit = np.flatnonzero(size)
                    hit = hit[np.argsort(q[hit], kind="stable")]
                    found.append(_sift(q[hit], lo[hit], size[hit], at, sk, rows["at"], rows["sketch"], MARGIN, k))
        return _union(*[np.concatenate(x) for x in zip(*found)], MARGIN, k) if found else _NONE

    def settled(at: np.ndarray, q: np.ndarray, c: np.ndarray, h: np.ndarray, more: np.ndarray) -> Iterator[pd.DataFrame]:
        own = pd.Series(at)
        lead = own.map(pd.Series(c[h <= NEAR]).groupby(q[h <= NEAR]).min()).astype("Int64")
        lead.index = own
        few = own[own.map(pd.Series(q).value_counts()).fillna(0) < k].to_numpy()
        yield pd.DataFrame({"at": few, "c": None, "sim": None, "lead": lead[few].array})
        more = more & ~np.isin(q, few)
        yield pd.DataFrame({"at": q[more], "c": c[more], "sim": None, "lead": lead[q[more]].array})
        listed = ~more & ~np.isin(q, few)
        q, c = q[listed], c[listed]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
        # few queries at once, so that their candidates in 64 bits are some tens of megabytes
        for s in range(0, len(start), 128):
            first = start[s : s + 128]
            end = start[s + 128] if s + 128 < len(start) else len(q)
            met = np.unique(c[first[0] : end])
            members = pd.DataFrame({"cid": met, "at": met, "ids": [[x] for x in read.keys(met).tolist()]})
            queries = pd.DataFrame({"cid": q[first], "at": q[first], "cands": np.split(c[first[0] : end], first[1:] - first[0])})
            best = compare(members, queries)
            yield pd.DataFrame({"at": best.cid, "c": best["key"], "sim": best.sim, "lead": lead[best.cid].array})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for space, part in b.groupby("space", sort=False):
                t, parts = spaces[space]
                for s in range(0, len(part), ASKED):
                    at = part["at"].to_numpy()[s : s + ASKED]
                    yield from settled(at, *candidates(t, parts, at, _unit(read(at)).astype(np.float32)))

    return run


def nearest_neighbours(rows: DataFrame, k: int = 5, dim: int = 768, tables: int = 8) -> DataFrame:
    """``key, other, sim, rank``: for each usable vector the ``k`` most similar of its space by cosine, near-exact.

    ``rows``: key, space, vec (array of float), stamp.  Equal vectors are one class, searched once; a class answers with its
    smallest keys.  Similarities are rounded to six decimals, ties go to the smaller key.

    1. Vectors are written once to files in the shared folder (:class:`Store`); from then on their places travel, never they.
    2. Every vector enters ``tables`` hash tables, stored as sorted keys with places and 256-bit sketches, in parts of bounded
       size; a crowded bucket is spread over several.
    3. Each query probes perturbed buckets in the stored parts, sifts its mates by sketches to those within a margin of the
       k-th best, merges the tables' candidates and is compared exactly with them, read from their places.

    Where candidates are no answer there is an exact way: a query with more than ``CROWD`` of them within the margin (in a crowd
    of nearly equal vectors) is compared with all members of the groups that hold its nearest ones (vectors that share their
    first near candidate form groups), and one with fewer than ``k`` candidates with its whole space.

    Null, short, zero and not finite vectors are left out; a space with fewer than k + 1 vectors gives what there is.
    """
    from ..io import cut, scratch

    spark = rows.sparkSession
    good = usable_vectors(rows, dim)
    read = Store(_local(scratch(spark, "vectors")), dim)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ExitStack() as files:
            put = read.writer(files)
            for b in batches:
                for s in range(0, len(b), 2000):
                    p = b.iloc[s : s + 2000]
                    raw = np.stack(p.vec.to_list()).astype(np.float32)
                    unit = _unit(raw).astype(np.float32)
                    yield pd.DataFrame({"key": p.key, "space": p.space, "at": put(raw, p.key.to_numpy(np.int64)), "same": [hashlib.md5(x.tobytes()).digest() for x in unit]})

    enc = cut(good.mapInPandas(encode, "key bigint, space string, at bigint, same binary"))
    small = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, k + 1)
    firsts = enc.withColumn("r", F.row_number().over(Window.partitionBy("space", "same").orderBy("key"))).where(F.col("r") <= k + 1)
    classes = cut(firsts.groupBy("space", "same").agg(F.min("key").alias("cid"), F.min_by("at", "key").alias("at"), small("key").alias("ids")))
    v = classes.select("cid", "space", "at", "ids")
    # one row a space, and a space is one embedding model
    sizes = {r[0]: r[1] for r in v.groupBy("space").count().collect()}
    spaces: dict[str, tuple[Tables, dict]] = {s: (Tables(dim, n, tables), {}) for s, n in sizes.items()}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of few bytes are much work here, so they are spread by number of tasks, not by size
    spread = v.select("space", "at").repartition(parts, "at")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for space, part in b.groupby("space", sort=False):
                t = spaces[space][0]
                for s in range(0, len(part), 2000):
                    at = part["at"].to_numpy()[s : s + 2000]
                    unit = _unit(read(at)).astype(np.float32)
                    keys = t.keys(unit, own=True)[:, :, 0]
                    entries = np.empty(len(at), ENTRY)
                    entries["at"], entries["sketch"] = at, t.sketch(unit).view(np.uint64)
                    for n in range(tables):
                        by = np.argsort(keys[n])
                        own = keys[n, by]
                        ends = np.searchsorted(own.astype(np.int64), np.arange(2**t.bits + 1) << (32 - t.bits))
                        for x in np.flatnonzero(np.diff(ends)):
                            i = slice(ends[x], ends[x + 1])
                            yield pd.DataFrame({"space": [space], "tab": n, "part": int(x), "first": int(at[0]), "n": ends[x + 1] - ends[x], "tags": [own[i].tobytes()], "rows": [entries[by[i]].tobytes()]})

    hashes = cut(spread.mapInPandas(hashed, "space string, tab int, part int, first bigint, n bigint, tags binary, rows binary"))
    load = hashes.groupBy("space", "tab", "part").agg(F.ceil(F.sum("n") / (2 * PART)).cast("int").alias("pieces"))

    def stored(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(b"".join(pdf["tags"]), np.uint32)
        by = np.argsort(own, kind="stable")
        name = uuid.uuid4().hex
        own[by].tofile(f"{read.path}/{name}.tags")
        np.frombuffer(b"".join(pdf["rows"]), ENTRY)[by].tofile(f"{read.path}/{name}.rows")
        return pdf[["space", "tab", "part"]].head(1).assign(name=name)

    piece = hashes.join(load, ["space", "tab", "part"]).withColumn("piece", F.pmod(F.xxhash64("first"), F.col("pieces")))
    where = ["space", "tab", "part", "piece"]
    # a name for each PART entries of a table
    names = piece.repartition(parts, *where).groupBy(*where).applyInPandas(stored, "space string, tab int, part int, name string").collect()
    for r in names:
        spaces[r.space][1].setdefault((r.tab, r.part), []).append(r.name)
    found = cut(spread.mapInPandas(_asking(spaces, read, k, dim), "at bigint, c bigint, sim double, lead bigint"))

    near = found.where("sim IS NOT NULL").select("at", F.col("c").alias("cid"), "sim")
    hard = found.where("sim IS NULL")
    if hard.take(1):
        leader = v.select("at", "space").join(found.groupBy("at").agg(F.min("lead").alias("c")), "at", "left").select("at", "space", F.least("at", "c").alias("lead"))
        crowd = leader.groupBy("lead").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
        groups = spark.createDataFrame([(s, max(1, -(-n // GROUP))) for s, n in sizes.items()], "space string, groups int")
        group = F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("at"), F.col("parts"))), F.col("groups")).cast("int")
        home = cut(leader.join(crowd, "lead").join(groups, "space").select("at", "space", group.alias("grp")))
        visits = hard.where("c IS NOT NULL").select(F.col("at").alias("q"), F.col("c").alias("at")).join(home, "at").select(F.col("q").alias("at"), "space", "grp").distinct()
        few = home.join(hard.where("c IS NULL").select("at"), "at", "left_semi").join(groups, "space").select("at", "space", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"))
        visits = cut(visits.unionByName(few))
        load = visits.groupBy("space", "grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        key = ["space", "grp", "block"]
        members = v.select("at", F.array("cid").alias("ids")).join(home, "at").join(load, ["space", "grp"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, F.col("at").alias("cid"), "at", "ids")
        asked = visits.join(load, ["space", "grp"]).withColumn("block", F.pmod(F.xxhash64("at"), F.col("blocks")).cast("int")).select(*key, F.col("at").alias("cid"), "at", F.lit(None).cast("array<bigint>").alias("cands"))
        # columns of their own on either side: both descend from the same tables
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
        whole = members.repartition(parts, *key).groupBy(*key).cogroup(asked.repartition(parts, *key).groupBy(*key)).applyInPandas(_exact(k, dim, read), "cid bigint, key bigint, sim double")
        near = near.unionByName(cut(whole).select(F.col("cid").alias("at"), F.col("key").alias("cid"), "sim"))
    own = v.select("at", F.explode("ids").alias("key"), F.lit(1.0).alias("sim"))
    every = near.join(v.select("cid", "ids"), "cid").select("at", F.explode("ids").alias("key"), "sim").unionByName(own)
    every = every.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("sim"), "key"))).where(F.col("r") <= k + 1)
    answer = every.groupBy("at").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("neg"), F.col("key").alias("other")))).alias("list"))
    answer = answer.join(classes.select("at", "space", "same"), "at")
    mine = enc.select("key", "space", "same").join(answer, ["space", "same"])
    return mine.select("key", F.posexplode(F.slice(F.filter("list", lambda x: x["other"] != F.col("key")), 1, k)).alias("rank", "n")).select("key", F.col("n.other").alias("other"), (-F.col("n.neg")).alias("sim"), (F.col("rank") + 1).alias("rank"))


def embedding_rows(embeddings: DataFrame) -> DataFrame:
    """Posting vectors as ``rows`` for :func:`nearest_neighbours`."""
    return embeddings.select(F.col("job_id").alias("key"), F.col("embedding_version").alias("space"), F.col("embedding_768").alias("vec"), F.col("embedded_at").alias("stamp"))


def recall_against_exact(rows: DataFrame, found: DataFrame, k: int = 5, dim: int = 768, every: int = 50) -> DataFrame:
    """``space, asked, wanted, hit, recall`` of ``found`` (key, other): the stated queries, keys divisible by ``every``, are
    compared exactly with all rows of their space in blocks; ties count as :func:`nearest_neighbours` settles them."""
    from ..operators.retrieval import dense_topk

    good = usable_vectors(rows, dim)
    spaces = [r[0] for r in good.select("space").distinct().collect()]
    out = None
    for s in spaces:
        here = good.where(F.col("space") == s)
        exact = dense_topk(here.where(F.col("key") % every == 0).select(F.col("key").alias("q"), "vec"), here.select(F.col("key").alias("id"), "vec"), k)
        part = exact.select(F.lit(s).alias("space"), F.col("q").alias("key"), F.col("id").alias("other"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "space string, asked bigint, wanted bigint, hit bigint, recall double")
    both = out.join(found.select("key", "other", F.lit(1).alias("hit")), ["key", "other"], "left")
    return both.groupBy("space").agg(F.count_distinct("key").alias("asked"), F.count("*").alias("wanted"), F.count("hit").alias("hit"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
