"""Languages of documents and of their passages, by a recurrent network over bytes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import language_code
from .places import current_facets

CODES = ("de", "en", "fr", "nl", "es", "it")
HIDDEN, CORE, CONTEXT = 24, 448, 32
#: Bytes, padding included, that are labelled at once.
CELLS = 131_072
#: Pieces of fewer characters (a cut at an abbreviation, a rule) join their neighbour.
LEAST = 30

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_END = re.compile(r"[.!?…]+[\"'”»)]*\s+|\s*\n\s*|\s+-{2,}\s+")


def plain(text: str | None) -> str:
    """Entities decoded, tags turned into line breaks."""
    if not text:
        return ""
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    return _TAG.sub("\n", text) if "<" in text else text


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a plain text; short pieces belong to the next one, at the end to the last."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    out: list[tuple[int, int]] = []
    begin = 0
    for e in cuts[1:]:
        if len(text[begin:e].strip()) >= LEAST:
            out.append((begin, e))
            begin = e
    if begin < len(text) and text[begin:].strip():
        if out:
            out[-1] = (out[-1][0], len(text))
        else:
            out.append((begin, len(text)))
    return out


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Gated recurrent units read the bytes from either side; a softmax labels every position.

    ``wx`` (2, 256, 3H) holds what a byte adds to the update and reset gates and the candidate, ``u`` (2, H, 3H) what the
    state adds, ``wo`` (2H, L) and ``bo`` the output.
    """

    wx: np.ndarray
    u: np.ndarray
    wo: np.ndarray
    bo: np.ndarray

    @classmethod
    def fresh(cls, hidden: int = HIDDEN, labels: int = len(CODES), seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32), r.normal(0, 1 / hidden**0.5, (2, hidden, 3 * hidden)).astype(np.float32), r.normal(0, 0.1, (2 * hidden, labels)).astype(np.float32), np.zeros(labels, np.float32))

    def save(self, path: str) -> None:
        """Store the weights, so that later runs need not train."""
        np.savez(path, wx=self.wx, u=self.u, wo=self.wo, bo=self.bo)

    @classmethod
    def load(cls, path: str) -> Network:
        with np.load(path) as z:
            return cls(z["wx"], z["u"], z["wo"], z["bo"])

    def forward(self, x: np.ndarray, keep: bool = False):
        """Log probabilities (batch, time, labels) of byte windows (batch, time); with ``keep`` also what training needs."""
        n, t = x.shape
        h = self.u.shape[1]
        both = np.stack([x, x[:, ::-1]]).transpose(2, 0, 1)  # time, side, batch
        states = np.zeros((t + 1, 2, n, h), np.float32)
        kept = []
        side = np.arange(2)[:, None]
        for i in range(t):
            a = self.wx[side, both[i]]
            s = states[i]
            b = s @ self.u
            g = _sigmoid(a[..., : 2 * h] + b[..., : 2 * h])
            z, r = g[..., :h], g[..., h:]
            c = np.tanh(a[..., 2 * h :] + r * b[..., 2 * h :])
            states[i + 1] = c + z * (s - c)
            if keep:
                kept.append((z, r, c, b[..., 2 * h :]))
        feats = np.concatenate([states[1:, 0], states[:0:-1, 1]], axis=-1)  # time, batch, 2H
        o = feats @ self.wo + self.bo
        o -= o.max(-1, keepdims=True)
        logp = (o - np.log(np.exp(o).sum(-1, keepdims=True))).transpose(1, 0, 2)
        return (logp, (both, states, kept, feats)) if keep else logp

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions and its gradients, by backpropagation through time."""
        logp, (both, states, kept, feats) = self.forward(x, keep=True)
        n, t = x.shape
        h = self.u.shape[1]
        loss = -float(np.take_along_axis(logp, y[..., None], 2).mean())
        d = np.exp(logp)
        np.put_along_axis(d, y[..., None], np.take_along_axis(d, y[..., None], 2) - 1, 2)
        d = (d / (n * t)).transpose(1, 0, 2).astype(np.float32)
        gwo = np.tensordot(feats, d, ([0, 1], [0, 1]))
        df = d @ self.wo.T
        out = np.stack([df[..., :h], df[::-1, :, h:]], axis=1)  # time in each side's own order
        gu, da_all = np.zeros_like(self.u), np.zeros((t, 2, n, 3 * h), np.float32)
        dh = np.zeros((2, n, h), np.float32)
        ut = self.u.transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            z, r, c, bn = kept[i]
            dh = dh + out[i]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (states[i] - c) * z * (1 - z)
            dr = dc * bn * r * (1 - r)
            da_all[i] = np.concatenate([dz, dr, dc], axis=-1)
            db = np.concatenate([dz, dr, dc * r], axis=-1)
            gu += states[i].transpose(0, 2, 1) @ db
            dh = dh * z + db @ ut
        gwx = np.zeros_like(self.wx)
        for s in range(2):
            b, g = both[:, s].ravel(), da_all[:, s].reshape(-1, 3 * h)
            order = np.argsort(b, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0])
            gwx[s, b[order][first]] = np.add.reduceat(g[order], first, axis=0)
        return loss, [gwx, gu, gwo.astype(np.float32), d.sum((0, 1))]

    def label(self, texts: list[str]) -> list[np.ndarray]:
        """Log probabilities of every byte of each text, whole texts whatever their length."""
        data = [_bytes(t) for t in texts]
        wins, where = [], []
        for i, b in enumerate(data):
            for s in range(0, len(b), CORE):
                lo = max(0, min(s - CONTEXT, len(b) - CORE - 2 * CONTEXT))
                wins.append(b[lo : lo + CORE + 2 * CONTEXT])
                where.append((i, s, lo))
        out = [np.zeros((len(b), self.bo.size), np.float32) for b in data]
        order = sorted(range(len(wins)), key=lambda k: len(wins[k]))
        while order:
            # the longest windows last, so that a batch's own lengths differ little
            n = max(1, CELLS // max(1, len(wins[order[-1]])))
            part, order = order[-n:], order[:-n]
            x = np.full((len(part), len(wins[part[-1]])), 32, np.uint8)
            for j, k in enumerate(part):
                x[j, : len(wins[k])] = wins[k]
            logp = self.forward(x)
            for j, k in enumerate(part):
                i, s, lo = where[k]
                e = min(s + CORE, len(data[i]))
                out[i][s:e] = logp[j, s - lo : e - lo]
        return out


def _bare(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss")) if not unicodedata.combining(c))


def train(samples: list[tuple[str, str]], steps: int = 320, width: int = 64, batch: int = 160, rate: float = 6e-3, seed: int = 5) -> Network:
    """A network trained on (text, code) pairs, some of which may be wrongly labelled.

    Windows are cut at random; a fifth has its accents taken off, three tenths are two halves of different languages, with the
    label changing at the seam.  Half-way, texts whose own label the network doubts are dropped.
    """
    rng = np.random.default_rng(seed)
    data = [(_bytes(plain(t)), _bytes(_bare(plain(t))), CODES.index(c)) for t, c in samples if c in CODES and len(plain(t)) >= width]
    net = Network.fresh()
    if not data:
        return net
    params = [net.wx, net.u, net.wo, net.bo]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def window(by, y: int, n: int) -> np.ndarray:
        d = by[y][rng.integers(len(by[y]))]
        b = d[1] if rng.random() < 0.2 and len(d[1]) >= n else d[0]
        if len(b) < n:
            return np.resize(b, n)
        s = rng.integers(len(b) - n + 1)
        return b[s : s + n]

    def grouped(rows):
        by = [[] for _ in CODES]
        for d in rows:
            by[d[2]].append(d)
        return by, [y for y, b in enumerate(by) if b]

    by, known = grouped(data)
    for step in range(steps):
        if step == steps // 2:
            sure = [d for d, lp in zip(data, _pooled(net, [bytes(d[0]).decode("utf-8", "replace") for d in data])) if lp.argmax() == d[2]]
            by, known = grouped(sure or data)
        x, y = np.empty((batch, width), np.uint8), np.empty((batch, width), np.int64)
        for i in range(batch):
            a = known[rng.integers(len(known))]
            x[i], y[i] = window(by, a, width), a
            if rng.random() < 0.3:
                c, seam = known[rng.integers(len(known))], int(rng.integers(16, width - 16))
                x[i, seam:], y[i, seam:] = window(by, c, width - seam), c
        _, grads = net.gradients(x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1.0, (step + 1) / 20) * (0.1 + 0.9 * (1 - step / steps))
        for p, g, a, b in zip(params, grads, m1, m2):
            g = g / max(1.0, norm)
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= lr * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(b / (1 - 0.99 ** (step + 1))) + 1e-6)
    return net


def _pooled(net: Network, texts: list[str]) -> np.ndarray:
    return np.stack([lp.mean(0) if len(lp) else np.full(len(CODES), -np.log(len(CODES)), np.float32) for lp in net.label(texts)])


def passages(net: Network, texts: list[str | None], surer: float = 0.5) -> list[tuple[list[tuple[int, int, str, float]], str, float]]:
    """For each text its passages ``(start, end, code, confidence)``, runs of sentences of one language, and the whole text's
    language and confidence.

    A sentence's evidence is the mean log probability of its positions.  It differs from the text's main language, that of most
    positions in sentences, only if that is better by ``surer`` a position; the confidence is the mean probability of the
    passage's language.  The whole text's language is that of the greatest mean log probability over all its positions, its
    confidence the mean probability of that language over all of them.
    """
    clean = [plain(t) for t in texts]
    out = []
    for text, lp in zip(clean, net.label(clean)):
        spans = sentences(text)
        if not spans or not len(lp):
            out.append(([], "", 0.0))
            continue
        at = np.r_[0, np.cumsum([len(c.lower().encode("utf-8", "replace")) for c in text])]
        pieces = [lp[at[s] : at[e]] for s, e in spans]
        score = np.stack([p.mean(0) if len(p) else np.zeros(lp.shape[1]) for p in pieces])
        weight = np.array([len(p) for p in pieces], float)
        votes = np.bincount(score.argmax(1), weight, lp.shape[1])
        main = int(votes.argmax())
        best = np.where(score.max(1) - score[:, main] > surer, score.argmax(1), main)
        runs: list[list] = []
        for (s, e), y, p in zip(spans, best.tolist(), pieces):
            if runs and runs[-1][2] == y:
                runs[-1][1] = e
                runs[-1][3].append(p)
            else:
                runs.append([s, e, y, [p]])
        whole = int(lp.mean(0).argmax())
        found = [(s, e, CODES[y], float(np.exp(np.concatenate(ps)[:, y]).mean())) for s, e, y, ps in runs]
        out.append((found, CODES[whole], float(np.exp(lp[:, whole]).mean())))
    return out


def labelled_sample(docs: DataFrame, per_language: int = 250) -> list[tuple[str, str]]:
    """At most ``per_language`` texts of each labelled language, chosen by hash, whole.

    ``docs``: text, label.  The bound is on training only; every text is labelled afterwards.
    """
    w = Window.partitionBy("code").orderBy("h")
    rows = docs.where("text IS NOT NULL").withColumn("code", language_code(F.col("label"))).where(F.col("code").isin(*CODES) & (F.length("text") >= 100))
    # each language's rows are thinned out in their tasks first, so that no language is sorted in one
    spread = rows.select("text", "code", F.xxhash64("text").alias("h")).withColumn("s", F.pmod("h", F.lit(64)))
    few = spread.withColumn("r", F.row_number().over(Window.partitionBy("code", "s").orderBy("h"))).where(F.col("r") <= per_language).drop("r")
    picked = few.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language)
    return sorted((r.text, r.code) for r in picked.select("text", "code").collect())


def detect_languages(docs: DataFrame, net: Network) -> DataFrame:
    """``key, start, end, language, confidence, doc_language, doc_confidence``: one row per passage of each text.

    ``docs``: key, text.  Offsets are into the text with entities decoded and tags turned into line breaks.  The document's
    language and confidence pool the probabilities of all its positions.  Null, empty and blank texts give no row; repeated
    texts each count under their own key.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.iloc[s : s + 256]
                rows = [(key, *p, whole, sure) for key, (found, whole, sure) in zip(part.key, passages(held.value, part.text.tolist())) for p in found]
                yield pd.DataFrame(rows, columns=["key", "start", "end", "language", "confidence", "doc_language", "doc_confidence"])

    docs = docs.where("text IS NOT NULL").select("key", "text")
    return docs.mapInPandas(run, "key bigint, start int, end int, language string, confidence double, doc_language string, doc_confidence double")


def posting_languages(jobs: DataFrame, facets: DataFrame, net: Network | None = None) -> tuple[DataFrame, DataFrame]:
    """Passages of all descriptions, and the current label of each posting (null if it has no facet row).

    Without ``net`` one is trained on the labelled descriptions; a stored one (:meth:`Network.load`) is used as it is.
    """
    current = current_facets(facets.select("job_id", "derive_version", "derived_at", "language"))
    both = jobs.where("description IS NOT NULL").select(F.col("id").alias("key"), F.col("description").alias("text"))
    labels = current.select(F.col("job_id").alias("key"), F.col("language").alias("label"))
    net = net or train(labelled_sample(both.join(labels, "key").select("text", "label")))
    # evenly over the tasks, as labelling is what costs
    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return detect_languages(both.repartition(parts, "key"), net), labels


def mislabelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, language``: each language of the texts whose label is missing or names another language, or that have several."""
    langs = found.groupBy("key").agg(F.collect_set("language").alias("ls"))
    langs = langs.join(labels.withColumn("code", language_code(F.col("label"))), "key", "left")
    wrong = F.col("code").isNull() | (F.size("ls") > 1) | ~F.array_contains("ls", F.coalesce("code", F.lit("")))
    return langs.where(wrong).select("key", F.explode("ls").alias("language"))
