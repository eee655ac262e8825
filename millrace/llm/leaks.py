"""Evaluation texts leaking into a corpus."""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>|<!--.*?-->|<![^<>]*>", re.S)
# Elements that stand inside a word or line, so their tags separate no words.
_INLINE = frozenset("a abbr b big code em font i mark s small span strong sub sup u wbr".split())
_WORD = re.compile(r"[^\W_]+")
# Letters that do not decompose, and what they are compared as.
_LETTERS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("ł", "l"), ("ı", "i"))


def _class(*categories: str) -> str:
    """The characters of some categories as a character class; a pattern passes over all others far faster than a translation."""
    points = [c for c in (*range(0x10000), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(c)) in categories]
    edges = [i for i, c in enumerate(points) if i == 0 or points[i - 1] != c - 1]
    runs = zip(edges, [*edges[1:], len(points)])
    return "[" + "".join(re.escape(chr(points[i])) + "-" + re.escape(chr(points[j - 1])) for i, j in runs) + "]+"


_MARKS, _INVISIBLE = re.compile(_class("Mn", "Me", "Cf")), re.compile(_class("Cf"))
#: Stands after the vowel of an umlaut until it is known how the umlaut is written; no text has it.
_UMLAUT = "\ue000"
_DIGRAPH = re.compile("([aou])e+")


def _bare(text: str | None) -> str:
    """A text with entities decoded and markup gone."""
    if not text:
        return ""
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if (m[1] or "").lower() in _INLINE else " ", text)
    return text


def _folded(text: str) -> str:
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.casefold()
    if not text.isascii():
        for letter, plain in _LETTERS:
            text = text.replace(letter, plain)
    return text


def word_forms(text: str | None) -> list[list[str]]:
    """The words of a text as they are compared, in each way its umlauts may be written: entities decoded, markup and invisible
    characters gone, case and accents folded, ß as ss; ä as a and, in a second list if that differs, as ae.  Two texts agree
    where one of the lists of either does.  Null and empty texts have none."""
    text = _bare(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text).replace(_UMLAUT, " "))
        for umlaut, vowel in zip("äöüÄÖÜ", "aouaou"):
            text = text.replace(umlaut, vowel + _UMLAUT)
    text = _folded(text)
    forms = [_WORD.findall(text.replace(_UMLAUT, ""))]
    if _UMLAUT in text:
        forms.append(_WORD.findall(text.replace(_UMLAUT, "e")))
    return [f for f in forms if f]


def words_of(text: str | None) -> list[str]:
    """The words of a text as keys: folded as in :func:`word_forms`, with ä, ae and a all one."""
    return _WORD.findall(_DIGRAPH.sub(r"\1", _folded(_bare(text))))


def symbols(words: list[str]) -> np.ndarray:
    """A 64-bit number for each word."""
    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=True) if words else np.empty(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WalkEmbedding:
    """Random-walk embeddings of word windows into strings of up to three times their length, and a bit sample of each.

    At step j a walk emits the symbol it stands on and moves on by a random bit of (j, symbol); windows within edit distance e
    come within Hamming distance O(e²).  Each repetition has a walk of its own, so that a pair whose walks part in one may stay
    together in another, and samples ``sample`` of its steps.
    """

    def __init__(self, window: int, repeats: int, sample: int, seed: int = 7):
        self.window = window
        rng = np.random.default_rng(seed)
        self.salts = [rng.integers(1, 2**63, 3 * window, dtype=np.uint64) for _ in range(repeats)]
        # early steps carry the window's symbols, the last third mostly padding
        self.picks = [np.sort(rng.choice(2 * window, sample, replace=False)) for _ in range(repeats)]
        self.weights = [rng.integers(1, 2**63, sample, dtype=np.uint64) | np.uint64(1) for _ in range(repeats)]

    def keys(self, syms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(repeats, len(starts)) bucket keys of the windows that begin at ``starts``."""
        out = np.zeros((len(self.picks), len(starts)), np.uint64)
        pad = np.uint64(0x9E3779B97F4A7C15)
        for r, (salt, picks, weights) in enumerate(zip(self.salts, self.picks, self.weights)):
            at = np.zeros(len(starts), np.int64)
            k = 0
            for j in range(int(picks[-1]) + 1):
                s = np.where(at < self.window, syms[np.minimum(starts + at, len(syms) - 1)], pad)
                if picks[k] == j:
                    out[r] += _mix(s + np.uint64(j)) * weights[k]
                    k += 1
                at = at + (_mix(s ^ salt[j]) & np.uint64(1)).astype(np.int64)
            out[r] = _mix(out[r] + np.uint64(r))
        return out


@functools.cache
def repetitions(window: int, max_edits: int, sample: int, target: float, pairs: int = 300, walks: int = 256) -> int:
    """Repetitions after which a window and the same with ``max_edits`` edits have shared a sample with probability ``target``.

    Worked out on ``pairs`` random windows, half with substitutions, half with words dropped and inserted, by ``walks`` walks:
    pairs differ in how often their walks stay together, so the mean over pairs of what is missed is what counts.
    """
    if not max_edits:
        return 1
    rng = np.random.default_rng(13)
    left, right = [], []
    for n in range(pairs):
        a = rng.integers(1, 2**63, window + max_edits, dtype=np.uint64)
        b = a.copy()
        if n % 2:
            for p in rng.choice(window, max_edits, replace=False):
                b[p] = rng.integers(1, 2**63, dtype=np.uint64)
        else:
            for e in range(max_edits):
                p = int(rng.integers(window))
                b = np.delete(b, p) if e % 2 == 0 else np.insert(b, p, rng.integers(1, 2**63, dtype=np.uint64))
        left.append(a[:window]), right.append(np.resize(b, window))
    walk = WalkEmbedding(window, walks, sample, seed=17)
    at = np.arange(pairs) * window
    p = (walk.keys(np.concatenate(left), at) == walk.keys(np.concatenate(right), at)).mean(0)
    for r in range(1, 4 * walks):
        if 1 - ((1 - p) ** r).mean() >= target:
            return r
    raise ValueError("no number of repetitions reaches the target; take fewer samples or the exact way (target_recall=1)")


def _edits(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edit distance of each row of ``a`` to the same row of ``b``, of equal length; right where it is at most ``most``,
    else above it: so few edits never leave the diagonal by more than half of them."""
    n, band = a.shape[1], most // 2
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    far = np.full(a.shape[1], most + 1, np.int16)
    prev = [far if o < band else np.full(a.shape[1], o - band, np.int16) for o in range(2 * band + 1)]
    for i in range(1, n + 1):
        cur: list[np.ndarray] = []
        for o in range(2 * band + 1):
            j = i + o - band
            if j < 0 or j > n:
                cur.append(far)
                continue
            best = prev[o] + (a[i - 1] != b[j - 1]) if j else np.full(a.shape[1], i, np.int16)
            if o and j:
                best = np.minimum(best, cur[o - 1] + 1)
            if o < 2 * band:
                best = np.minimum(best, prev[o + 1] + 1)
            cur.append(np.minimum(best, far))
        prev = cur
    return prev[band]


def _windows(lengths: np.ndarray, window: int) -> np.ndarray:
    """Starts, in the concatenation, of all windows that lie inside one text."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    room = np.repeat(ends, lengths) - np.arange(total)
    return np.flatnonzero(room >= window)


def _seeds(syms: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of all runs of ``size`` words inside one text."""
    starts = _windows(lengths, size)
    keys = np.zeros(len(starts), np.uint64)
    for j in range(size):
        keys = _mix(keys + syms[starts + j] + np.uint64(j + 1))
    return starts, keys


def _forms(texts: list[str | None]) -> tuple[np.ndarray, list[list[str]]]:
    """The word lists of some texts, and which text each belongs to."""
    pairs = [(i, f) for i, t in enumerate(texts) for f in word_forms(t)]
    return np.array([i for i, _ in pairs], np.int64), [f for _, f in pairs]


class _Index:
    """The items' windows by key, in every repetition; with edits, the items' runs of words that edits must leave whole."""

    def __init__(self, ids: list[str], texts: list[str], walk: WalkEmbedding, max_edits: int = 0, seeds: bool = False):
        owners, lists = _forms(texts)
        self.ids, self.words = ids, [w for l in lists for w in l]
        self.syms = symbols(self.words)
        lengths = np.array([len(l) for l in lists], np.int64)
        self.owner = np.repeat(owners, lengths)
        self.starts = _windows(lengths, walk.window)
        self.tables = []
        if seeds:
            # the words that stay are in at most one more run than there are edits, so one run has this length
            self.size = max(1, -(-(walk.window - max_edits) // (max_edits + 1)))
            starts, keys = _seeds(self.syms, lengths, self.size)
            order = np.argsort(keys, kind="stable")
            self.runs = keys[order], starts[order]
            self.whole = np.zeros(len(self.syms), bool)
            self.whole[self.starts] = True
            return
        keys = walk.keys(self.syms, self.starts) if len(self.starts) else np.zeros((len(walk.picks), 0), np.uint64)
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.starts))))) + 5)
        for k in keys:
            order = np.argsort(k, kind="stable")
            seen = np.zeros(1 << self.bits, bool)
            seen[(k & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True
            self.tables.append((k[order], self.starts[order], seen))


def _same_key(sorted_keys: np.ndarray, held: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a start and a held start with the same key."""
    lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    n = hi - lo
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(starts, n), held[at]


def _sampled(index: _Index, walk: WalkEmbedding, syms: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of pairs of windows that share a sample."""
    found = []
    for k, (sorted_keys, item_starts, seen) in zip(walk.keys(syms, starts), index.tables):
        near = np.flatnonzero(seen[(k & np.uint64(len(seen) - 1)).astype(np.int64)])
        found.append(np.stack(_same_key(sorted_keys, item_starts, k[near], starts[near])))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    for a in range(0, pairs.shape[1], 200_000):
        yield pairs[:, a : a + 200_000]


def _seeded(index: _Index, window: int, syms: np.ndarray, lengths: np.ndarray, whole: np.ndarray, max_edits: int) -> Iterator[np.ndarray]:
    """Blocks of pairs of windows that have a run of words in common where ``max_edits`` edits can have left it: all pairs
    within that distance are among them."""
    starts, keys = _seeds(syms, lengths, index.size)
    p, q = _same_key(*index.runs, keys, starts)
    # neighbours on a diagonal come together, so that few windows are in two blocks
    by = np.lexsort((q, p - q))
    p, q = p[by], q[by]
    back = np.arange(window - index.size + 1)
    shift = max_edits // 2
    for a in range(0, len(p), 4096):
        x, y = p[a : a + 4096, None, None], q[a : a + 4096, None, None]
        i = np.broadcast_to(y - back[None, :, None], (len(x), len(back), 2 * shift + 1))
        d = x - back[None, :, None] + np.arange(-shift, shift + 1)[None, None, :]
        d, i = d.ravel(), i.ravel()
        ok = (d >= 0) & (i >= 0)
        d, i = d[ok], i[ok]
        ok = whole[np.minimum(d, len(whole) - 1)] & (d < len(whole)) & index.whole[i]
        cell = np.unique(d[ok] * len(index.whole) + i[ok])
        yield np.stack([cell // len(index.whole), cell % len(index.whole)])


def _match(index: _Index, walk: WalkEmbedding, doc_ids: np.ndarray, texts: list[str | None], max_edits: int, seeds: bool) -> pd.DataFrame:
    owners, lists = _forms(texts)
    lengths = np.array([len(l) for l in lists], np.int64)
    words = [w for l in lists for w in l]
    starts = _windows(lengths, walk.window)
    syms = symbols(words)
    blocks: Iterator[np.ndarray] = iter(())
    if len(starts) and len(index.starts):
        if seeds:
            whole = np.zeros(len(syms), bool)
            whole[starts] = True
            blocks = _seeded(index, walk.window, syms, lengths, whole, max_edits)
        else:
            blocks = _sampled(index, walk, syms, starts)
    owner = np.repeat(owners, lengths)
    span = np.arange(walk.window)
    rows = []
    for d, i in blocks:
        x, y = syms[d[:, None] + span], index.syms[i[:, None] + span]
        e = (x != y).any(1).astype(int) if max_edits == 0 else _edits(x, y, max_edits)
        ok = e <= max_edits
        d, i, e = d[ok], i[ok], e[ok]
        # equal symbols stand for equal words only if the words agree
        same = np.fromiter((ee > 0 or words[p : p + walk.window] == index.words[q : q + walk.window] for p, q, ee in zip(d, i, e)), bool, len(d))
        rows.append(pd.DataFrame({"doc": owner[d[same]], "item": index.owner[i[same]], "edits": e[same]}).groupby(["doc", "item"], as_index=False).edits.min())
    if not rows:
        return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "item_id": pd.Series(dtype=object), "edits": pd.Series(dtype="int32")})
    best = pd.concat(rows).groupby(["doc", "item"], as_index=False).edits.min()
    return pd.DataFrame({"doc_id": doc_ids[best.doc.to_numpy()], "item_id": pd.Series([index.ids[k] for k in best["item"]], dtype=object), "edits": best.edits.astype("int32")})


def find_leaks(documents: DataFrame, items: DataFrame, window: int = 12, max_edits: int = 0, target_recall: float = 0.98, sample: int = 6, batch_items: int = 4000) -> DataFrame:
    """``doc_id, item_id, edits``: documents with a passage of ``window`` words of an item, with at most ``max_edits`` words edited.

    ``documents``: doc_id, text; ``items``: item_id, text.  Every window of every text is embedded by a random walk and sampled,
    in as many repetitions, each with a walk of its own, as ``target_recall`` takes (:func:`repetitions`); windows that share a
    sample with an item's window are verified exactly.  Equal windows always meet, so without edits one repetition loses
    nothing.  With ``target_recall`` 1 and edits all windows that share a run of words so long that the edits cannot break
    every one are verified instead, so nothing is lost either.  Edits are counted between windows of equal length.

    The corpus is read in one pass without a shuffle.  Items travel to the tasks ``batch_items`` at a time, which bounds what
    is sent and held; more items mean more passes, each finished and written before the next one's items are fetched.  Null
    and empty texts match nothing, texts shorter than a window neither; repeated texts each count under their own id; extra
    columns are ignored.
    """
    from ..io import cut

    spark = documents.sparkSession
    seeds = bool(max_edits) and target_recall >= 1
    repeats = 0 if seeds else repetitions(window, max_edits, sample, target_recall)
    items = items.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").dropDuplicates(["item_id"])
    docs = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = items.count()
    # parts by hash, with room for their differing sizes
    parts = 1 if n <= batch_items else -(-2 * n // batch_items)
    out = None
    for k in range(parts):
        rows = (items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else items).collect()
        held = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            walk = WalkEmbedding(window, repeats, sample)
            index = _Index(*held.value, walk, max_edits, seeds)
            for b in batches:
                for a in range(0, len(b), 500):
                    part = b.iloc[a : a + 500]
                    yield _match(index, walk, part.doc_id.to_numpy(), part.text.tolist(), max_edits, seeds)

        hits = docs.mapInPandas(scan, "doc_id bigint, item_id string, edits int")
        if parts > 1:
            hits = cut(hits)
            held.unpersist()
        out = hits if out is None else out.unionByName(hits)
    return out


def needle_texts(needles: DataFrame) -> DataFrame:
    """The evaluation text of each needle; needles without one give none."""
    return needles.select(F.col("id").alias("item_id"), F.get_json_object("detail", "$.stellenangebotsBeschreibung").alias("text")).where("text IS NOT NULL")
