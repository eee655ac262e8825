"""Long exact spans shared between documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15 | 1), _U(0xD6E8FEB86659FD93 | 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of every k consecutive code points."""
    base = _BASES[salt]
    n = len(points)
    if n < k:
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n, base, _U))
        run = np.concatenate([[_U(0)], np.cumsum(_mix(points.astype(_U) + _U(1 + salt)) * power)])
        inverse = _inverse_powers(base, n - k + 1)
        return _mix((run[k:] - run[:-k]) * inverse)


_inverses: dict[int, np.ndarray] = {}


def _inverse_powers(base, n: int) -> np.ndarray:
    have = _inverses.get(int(base))
    if have is None or len(have) < n:
        inv = pow(int(base), -1, 2**64)
        with np.errstate(over="ignore"):
            have = _inverses[int(base)] = np.cumprod(np.concatenate([[_U(1)], np.full(max(n, 4096) * 2, inv, _U)]))
    return have[:n]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values."""
    if w == 1:
        return x
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, _U)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def super_kmers(text: str, k: int, m: int) -> list[tuple[int, int, int]]:
    """``(minimiser, start, end)`` of the runs of consecutive k-windows that share their minimiser, the least hash of m code
    points inside; a run covers ``text[start:end]``.  Runs are cut at ``k - m + 1`` windows, so their length is bounded."""
    p = _points(text)
    if len(p) < k:
        return []
    w = k - m + 1
    least = _sliding_min(_hashes(p, m), w)
    edge = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    out = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(least)]):
        for c in range(a, b, w):
            out.append((int(least[a].astype(np.int64)), c, min(c + w, b) - 1 + k))
    return out


def _packed(frame: pd.DataFrame, k: int, m: int, keep=None) -> pd.DataFrame:
    doc, mini, start, chars = [], [], [], []
    for d, t in zip(frame.doc_id, frame.text):
        for h, a, b in super_kmers(t, k, m):
            if keep is None or keep(h):
                doc.append(d), mini.append(h), start.append(a), chars.append(t[a:b])
    return pd.DataFrame({"mini": np.array(mini, np.int64), "doc_id": np.array(doc, np.int64), "start": np.array(start, np.int32), "chars": pd.Series(chars, dtype=object)})


def _sorted_windows(frame: pd.DataFrame, k: int):
    """Every window of the packed strings, sorted by content hash: string number, offset, the two hashes, run starts."""
    h1, h2, owner, off = [], [], [], []
    for i, c in enumerate(frame.chars):
        p = _points(c)
        a = _hashes(p, k)
        h1.append(a), h2.append(_hashes(p, k, 1)), owner.append(np.full(len(a), i, np.int64)), off.append(np.arange(len(a), dtype=np.int64))
    h1, h2, owner, off = (np.concatenate(x) for x in (h1, h2, owner, off))
    order = np.lexsort((off, owner, h2, h1))
    h1, h2, owner, off = h1[order], h2[order], owner[order], off[order]
    first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    return h1, h2, owner, off, first


def _shared_windows(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """Stretches of the packed strings whose windows stand in more than one document of ``frame``: doc_id, a, b."""
    h1, h2, owner, off, first = _sorted_windows(frame, k)
    doc = frame.doc_id.to_numpy()[owner]
    size = np.diff(np.r_[first, len(h1)])
    many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    lead = np.repeat(first, size)
    at = np.flatnonzero(np.repeat(many, size))
    chars = frame.chars.tolist()
    # equal hashes count only if the windows are equal
    same = np.fromiter((chars[owner[x]][off[x] : off[x] + k] == chars[owner[y]][off[y] : off[y] + k] for x, y in zip(at.tolist(), lead[at].tolist())), bool, len(at))
    at = at[same]
    order = np.lexsort((off[at], owner[at]))
    o, f = owner[at][order], off[at][order]
    if not len(o):
        return pd.DataFrame({"doc_id": np.empty(0, np.int64), "a": np.empty(0, np.int32), "b": np.empty(0, np.int32)})
    edge = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (f[1:] != f[:-1] + 1)])
    last = np.r_[edge[1:], len(o)] - 1
    begin = frame.start.to_numpy()[o[edge]]
    return pd.DataFrame({"doc_id": frame.doc_id.to_numpy()[o[edge]], "a": (begin + f[edge]).astype(np.int32), "b": (begin + f[last] + k).astype(np.int32)})


def _by_bucket(batches: Iterator[pd.DataFrame], chars_at_once: int) -> Iterator[pd.DataFrame]:
    """The sorted rows in frames of about ``chars_at_once`` characters; a chunk of a bucket is never cut."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        size += int(b.chars.str.len().sum())
        if size < chars_at_once:
            continue
        f = pd.concat(held, ignore_index=True)
        edge = int(np.flatnonzero(((f.mini != f.mini.iloc[-1]) | (f.chunk != f.chunk.iloc[-1])).to_numpy()).max(initial=-1)) + 1
        if edge:
            yield f.iloc[:edge].reset_index(drop=True)
        rest = f.iloc[edge:].reset_index(drop=True)
        held, size = [rest], int(rest.chars.str.len().sum())
    if held:
        yield pd.concat(held, ignore_index=True)


#: Most bits of the map that drops buckets of one document at the source.
MOST_BITS = 1 << 29


def _bit_map(shared: DataFrame, bits: int) -> np.ndarray:
    """A map of ``bits`` bits in which those of all minimisers in ``shared`` are set, packed by the tasks in blocks."""
    block = min(bits, 1 << 15)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(block, np.uint8)
        on[(frame.bit % block).to_numpy()] = 1
        return pd.DataFrame({"at": [int(frame.bit.iloc[0]) // block], "packed": [np.packbits(on, bitorder="little").tobytes()]})

    at = shared.select(F.pmod(F.col("mini"), F.lit(bits)).alias("bit")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in at.groupBy(F.floor(F.col("bit") / block)).applyInPandas(pack, "at bigint, packed binary").collect():
        out[r["at"] * block // 8 : (r["at"] + 1) * block // 8] = np.frombuffer(r.packed, np.uint8)
    return out


def _digests(frame: pd.DataFrame, owner: np.ndarray, off: np.ndarray, k: int) -> list[bytes]:
    chars = frame.chars.tolist()
    return [hashlib.blake2b(chars[i][o : o + k].encode("utf-8", "surrogatepass"), digest_size=32).digest() for i, o in zip(owner.tolist(), off.tolist())]


def shared_spans(documents: DataFrame, k: int = 600, m: int = 300, chunk: int = 2000) -> DataFrame:
    """``doc_id, a, b``: stretches of at least ``k`` code points that stand, exactly, in another document too; may overlap.

    Equal texts form one class, of which one member goes on; members of larger classes are shared from end to end.
    Consecutive windows with the same minimiser travel as one string to its bucket, where sorting the windows counts them
    exactly.  Minimisers of half a window's length are shared only by texts that have that much in common.  Buckets of one
    class never leave their task: a bit map drops them at the source (a false bit costs traffic, not correctness); it has
    sixteen bits a bucket, as far as ``MOST_BITS`` allow.

    Every bucket is counted in chunks of about ``chunk`` strings, so none is gathered in one task.  Where a bucket has several
    chunks, the 256-bit digests of its different windows are counted across them with map-side combine.

    Null texts and texts shorter than ``k`` have no stretch.
    """
    from ..io import bounded, cut

    docs = documents.where(F.length("text") >= k).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.length("text").alias("n"))
    keyed = cut(docs.select("doc_id", "n", F.sha2("text", 256).alias("h")))
    many = keyed.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")).where("members > 1")
    copies = cut(keyed.join(many.select("h", "rep"), "h").select("doc_id", "n", "rep"))
    # only the further members of a class are taken out, so no text is shuffled where copies are few
    reps = docs.join(copies.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti").select("doc_id", "text")

    def minis(batches):
        for b in batches:
            yield _packed(b, k, m)[["mini", "doc_id"]]

    counts = reps.mapInPandas(minis, "mini bigint, doc_id bigint").groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("strings"))
    shared = cut(counts.where("lo <> hi").select("mini", "strings"))
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * shared.count()).bit_length()))
    held = documents.sparkSession.sparkContext.broadcast(_bit_map(shared, bits))

    def packed(batches):
        t = held.value
        keep = lambda h: bool(t[(h % bits) >> 3] >> (h % bits & 7) & 1)
        for b in batches:
            yield _packed(b, k, m, keep)

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded, _ = bounded(shared.where(F.col("strings") > chunk).select("mini", F.ceil(F.col("strings") / chunk).cast("int").alias("chunks")), 1_000_000)
    strings = reps.mapInPandas(packed, "mini bigint, doc_id bigint, start int, chars string")
    strings = strings.join(crowded, "mini", "left").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start"), F.coalesce("chunks", F.lit(1))).cast("int"))

    def count(batches):
        for f in _by_bucket(batches, 2_000_000):
            yield _shared_windows(f, k)

    def ends(batches):
        for f in _by_bucket(batches, 2_000_000):
            _, _, owner, off, first = _sorted_windows(f, k)
            doc = f.doc_id.to_numpy()[owner]
            yield pd.DataFrame({"digest": _digests(f, owner[first], off[first], k), "lo": np.minimum.reduceat(doc, first), "hi": np.maximum.reduceat(doc, first)})

    def places(batches):
        for f in _by_bucket(batches, 2_000_000):
            _, _, owner, off, first = _sorted_windows(f, k)
            once = _digests(f, owner[first], off[first], k)
            digest = np.repeat(np.array(once, dtype=object), np.diff(np.r_[first, len(owner)]))
            yield pd.DataFrame({"digest": digest, "doc_id": f.doc_id.to_numpy()[owner], "a": (f.start.to_numpy()[owner] + off).astype(np.int32)})

    by_chunk = lambda s: s.repartition(parts, "mini", "chunk").sortWithinPartitions("mini", "chunk").select("mini", "chunk", "doc_id", "start", "chars")
    out = copies.select("doc_id", F.lit(0).alias("a"), F.col("n").alias("b")).unionByName(by_chunk(strings).mapInPandas(count, "doc_id bigint, a int, b int"))
    if crowded.take(1):  # else there is nothing to count across
        several = by_chunk(cut(strings.where("chunks IS NOT NULL")))
        two = several.mapInPandas(ends, "digest binary, lo bigint, hi bigint").groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("digest")
        hit = several.mapInPandas(places, "digest binary, doc_id bigint, a int").join(two, "digest", "left_semi")
        out = out.unionByName(hit.select("doc_id", "a", (F.col("a") + k).alias("b")))
    return out


def shared_share(spans: DataFrame) -> DataFrame:
    """``doc_id, shared_chars``: code points of a document that lie in at least one stretch."""
    runs = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("s"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return runs.select("doc_id", F.aggregate("s", zero, step, lambda acc: acc["n"].cast("bigint")).alias("shared_chars"))
