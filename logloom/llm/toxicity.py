"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: its own (words that are frequent in the sample;
all others share one) and the mean over its character trigrams. Both, times the
input weights of the six gates, depend on the word alone, so they are computed
once for each distinct word. Two recurrences run over a window of WINDOW words,
attention pools their states, and a logistic unit scores the window. Windows
overlap by half and cover the whole text; a text's score is that of its highest
window.

Training: a text's label says that some window is toxic, not which. After a
first pass over many windows the network is trained on the window that it scores
highest in each text. The sample is the SAMPLE labelled rows (at most) with the
least hash of their id, from the training folds only; its bound makes the
driver's part constant.

Defined results: null and empty texts are one window without words; conflicting
labels of one doc_id are both used; without any labels every score is 0; repeated rows each get a row.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.textvec import chunks, utf8
from logloom.tables import ship, tidy

WINDOW, STRIDE = 16, 8
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
TRIGRAMS = 4096
VOCABULARY = 20_000
SAMPLE = 4000
FOLDS = 5
#: Rounds over the sample at least, and updates at least: a small sample is gone over more often.
EPOCHS, UPDATES = 5, 240
BATCH = 128
RATE = 0.02
#: Distinct words whose gate inputs a worker remembers.
REMEMBERED = 150_000


def fold(key: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % FOLDS, F.lit(0))


def split(text: str | bytes | None) -> list[bytes]:
    body = text.encode() if isinstance(text, str) else text or b""
    return [w.strip(b".,;:!?\"'()#$%&*|") or w for w in body.lower().split()]


def trigrams(word: bytes) -> list[int]:
    padded = b"<" + word + b">"
    return [xxhash.xxh32_intdigest(padded[i : i + 3]) % TRIGRAMS for i in range(len(padded) - 2)]


def _trigrams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of words one after another, and each word's number of them (one at least)."""
    flat, n = array("i"), array("i")
    for w in words:
        g = trigrams(w)
        flat.extend(g)
        n.append(len(g))
    return np.array(flat, np.int32), np.array(n, np.int64)


def windows(n: int) -> range:
    """Where a text of n words has windows: every STRIDE words, the last one reaching its end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def add_rows(shape: tuple[int, int], at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Zeros of a shape with rows added where `at` says, repeats included."""
    out = np.zeros(shape, np.float32)
    order = np.argsort(at, kind="stable")
    x = at[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    out[x[first]] = np.add.reduceat(rows[order], first)
    return out


class Network:
    """Parameters as float32 arrays by name; `words` numbers the vocabulary from 1."""

    def __init__(self, words: dict[bytes, int], seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        mat = lambda *s: (r.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
        self.words = words
        self.p = {
            "word": (r.standard_normal((len(words) + 1, WORD_DIM)) * 0.3).astype(np.float32),
            "char": (r.standard_normal((TRIGRAMS, CHAR_DIM)) * 0.3).astype(np.float32),
            "wx": mat(d, 6 * h),
            "bx": np.zeros(6 * h, np.float32),
            "uf": mat(h, 3 * h),
            "ub": mat(h, 3 * h),
            "att": (r.standard_normal(2 * h) * 0.3).astype(np.float32),
            "out": (r.standard_normal(2 * h) * 0.3).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """[words, 6 * HIDDEN] what each word adds to the gates."""
        flat, n = _trigrams_of(words)
        chars = np.add.reduceat(self.p["char"][flat], np.cumsum(n) - n) / n[:, None].astype(np.float32)
        ids = np.array([self.words.get(w, 0) for w in words])
        return np.concatenate([self.p["word"][ids], chars], 1) @ self.p["wx"] + self.p["bx"]

    @staticmethod
    def _recur(g: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
        """g: [T, B, 3H] gate inputs in reading order -> states [T, B, H]."""
        h = np.zeros((g.shape[1], HIDDEN), np.float32)
        out = np.empty((*g.shape[:2], HIDDEN), np.float32)
        for t in range(len(g)):
            v = h @ u
            zr = sigmoid(g[t, :, : 2 * HIDDEN] + v[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[t, :, 2 * HIDDEN :] + r * v[:, 2 * HIDDEN :])
            z = z * mask[t][:, None]
            if keep is not None:
                keep.append((h, v, z, r, n))
            h = h + z * (n - h)
            out[t] = h
        return out

    def logits(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """ids: [B, T] rows of table, mask: [B, T] -> the windows' logits."""
        return self._forward(table, ids, mask)[0]

    def _forward(self, table, ids, mask, train=False):
        m = np.ascontiguousarray(mask.T)
        g = table[ids.T]
        kf, kb = ([], []) if train else (None, None)
        f = self._recur(g[:, :, : 3 * HIDDEN], m, self.p["uf"], kf)
        b = self._recur(g[::-1, :, 3 * HIDDEN :], m[::-1], self.p["ub"], kb)[::-1]
        s = np.concatenate([f, b], 2)
        a = s @ self.p["att"]
        a = np.where(m > 0, a, -1e9)
        a = np.exp(a - a.max(0)) * m
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * s).sum(0)
        return pooled @ self.p["out"] + self.p["bias"][0], (m, g, kf, kb, s, a, pooled)

    def gradients(self, table, ids, mask, y):
        """Of the mean logistic loss: those of the parameters below the table, and of the table's rows."""
        logit, (m, g, kf, kb, s, a, pooled) = self._forward(table, ids, mask, True)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        grad = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["out"]
        da = (s * dp[None]).sum(2)
        da = a * (da - (a * da).sum(0))
        ds = a[:, :, None] * dp[None] + da[:, :, None] * self.p["att"]
        grad["att"] = (s * da[:, :, None]).sum((0, 1))
        dg = np.zeros_like(g)
        for u, kept, half, order in (("uf", kf, 0, range(len(m))), ("ub", kb, 1, range(len(m) - 1, -1, -1))):
            state, cols = slice(half * HIDDEN, (half + 1) * HIDDEN), slice(half * 3 * HIDDEN, (half + 1) * 3 * HIDDEN)
            w = self.p[u]
            du, dh = np.zeros_like(w), np.zeros_like(kept[0][0])
            for t, (h, v, z, r, n) in zip(reversed(list(order)), reversed(kept), strict=True):
                dh = dh + ds[t, :, state]
                dn = dh * z * (1 - n * n)
                mask_t = m[t][:, None]
                zz = np.where(mask_t > 0, z, 0)
                dz = dh * (n - h) * zz * (1 - zz)
                dv_n = dn * r
                dr = dn * v[:, 2 * HIDDEN :] * r * (1 - r)
                pre = np.concatenate([dz, dr, dn], 1)
                dg[t, :, cols] = pre
                dv = np.concatenate([dz, dr, dv_n], 1)
                du += h.T @ dv
                dh = dh * (1 - z) + dv @ w.T
            grad[u] = du
        return grad, add_rows(table.shape, ids.T.ravel(), dg.reshape(-1, dg.shape[2]))


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)).astype(np.float32)


def _numbered(texts: Iterable[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    ids: dict[bytes, int] = {}
    rows = [np.array([ids.setdefault(w, len(ids)) for w in t], np.int32) for t in texts]
    return list(ids), rows


def _cut(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts: ids [n, WINDOW], mask, and each one's text."""
    n = np.array([len(r) for r in rows])
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(rows)), count)
    start = STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    flat = np.concatenate([*rows, np.zeros(1, np.int32)]).astype(np.int32)
    first, end = (np.cumsum(n) - n)[doc] + start, np.cumsum(n)[doc]
    ids, mask = np.empty((len(doc), WINDOW), np.int32), np.empty((len(doc), WINDOW), np.float32)
    for j in range(WINDOW):
        mask[:, j] = first + j < end
        ids[:, j] = flat[np.minimum(first + j, len(flat) - 1)]
    ids[mask == 0] = flat[-1]
    return ids, mask, doc


def train(texts: list[str], labels: list[int], *, epochs: int = EPOCHS, updates: int = UPDATES, seed: int = 7) -> Network:
    """A network for the labels; deterministic."""
    distinct, rows = _numbered(map(split, texts))
    seen = Counter()
    for r in rows:
        seen.update(distinct[i] for i in np.unique(r).tolist())
    frequent = sorted((w for w, c in seen.items() if c >= 3), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net = Network({w: i + 1 for i, w in enumerate(frequent)}, seed)
    if not texts:  # nothing is known to be toxic
        net.p["out"][:], net.p["bias"][:] = 0, -100
        return net
    r = np.random.default_rng(seed)
    flat, n = _trigrams_of(distinct or [b"-"])
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    word = np.array([net.words.get(w, 0) for w in distinct] or [0])
    ids, mask, doc = _cut(rows)
    y = np.array(labels, np.float32)
    adam = Adam(net.p, RATE)
    net.p["bias"][:] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))

    def layer() -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate([net.p["word"][word], np.add.reduceat(net.p["char"][flat], first) / n[:, None].astype(np.float32)], 1)
        return x, x @ net.p["wx"] + net.p["bx"]

    epoch = 0
    while epoch < epochs or adam.t < updates:
        adam.rate = RATE * max(0.1, 1 - 0.9 * min(adam.t / updates, 1))
        x, table = layer()
        if epoch == 0:
            pick = r.permutation(len(doc))
            pick = pick[np.concatenate([np.unique(doc[pick], return_index=True)[1], np.flatnonzero(r.random(len(doc)) < np.where(y[doc[pick]] > 0, 0.4, 0.05))])]
        else:
            score = np.concatenate([net.logits(table, ids[i : i + 4096], mask[i : i + 4096]) for i in range(0, len(ids), 4096)])
            order = np.lexsort((-score, doc))
            top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
            pick = np.concatenate([top, r.integers(0, len(doc), len(top) // 2)])
            pick = pick[(y[doc[pick]] == 0) | np.isin(pick, top)]
        for batch in np.array_split(r.permutation(pick), max(1, len(pick) // BATCH)):
            used, local = np.unique(ids[batch], return_inverse=True)
            ends = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in used])
            nn = n[used]
            xs = np.concatenate([net.p["word"][word[used]], np.add.reduceat(net.p["char"][flat[ends]], np.cumsum(nn) - nn) / nn[:, None].astype(np.float32)], 1)
            grad, dt = net.gradients(xs @ net.p["wx"] + net.p["bx"], local.reshape(len(batch), WINDOW), mask[batch], y[doc[batch]])
            grad["wx"], grad["bx"] = xs.T @ dt, dt.sum(0)
            dx = dt @ net.p["wx"].T
            grad["word"] = add_rows(net.p["word"].shape, word[used], dx[:, :WORD_DIM])
            grad["char"] = add_rows(net.p["char"].shape, flat[ends], np.repeat(dx[:, WORD_DIM:] / nn[:, None].astype(np.float32), nn, 0))
            adam.step(grad)
        epoch += 1
    return net


class Scorer:
    """Scores of whole texts; remembers the gate inputs of words."""

    def __init__(self, net: Network, remembered: int = REMEMBERED):
        self.net, self.bound = net, remembered
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((self.bound, 6 * HIDDEN), np.float32)  # takes memory as rows are written

    def _ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.bound:
            self._clear()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            at = len(known)
            if at + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:at], np.zeros((len(new), 6 * HIDDEN), np.float32)])
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                self.table[at + i : at + i + len(part)] = self.net.inputs(part)
            known.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        parts = [split(t) for t in texts]
        flat = self._ids([w for p in parts for w in p])
        ends = np.cumsum([len(p) for p in parts])
        rows = [flat[e - len(p) : e] for e, p in zip(ends, parts, strict=True)]
        ids, mask, doc = _cut(rows)
        logit = np.concatenate([self.net.logits(self.table, ids[i : i + 2048], mask[i : i + 2048]) for i in range(0, len(ids), 2048)])
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        return sigmoid(np.maximum.reduceat(logit, first).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Network:
    """Train on at most `sample` labelled rows whose fold isn't 0.

    The labelled rows are chosen first and broadcast (their number is bounded),
    so the texts are read once, and only those of chosen rows are shuffled. Where
    documents share an id, a label stands for the least of their texts.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(F.col(key)) != 0)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_k"), "_k", "_y").limit(sample).groupBy("_k").agg(F.sort_array(F.collect_list("_y")).alias("_y"))
    rows = docs.select(F.col(key).alias("_d"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("_d") == F.col("_k"))
    rows = rows.groupBy("_k").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))
    rows = sorted((r._k, y, r._text) for r in rows.collect() for y in r._y)  # one text for each chosen id
    return train([t for _, _, t in rows], [y for _, y, _ in rows])


def _score(model, text: str, out_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            offsets, data = utf8(batch.column(text))
            out = []
            for i, j, o, d in chunks(offsets, data):
                body = d.tobytes()
                out.append(scorer.scores([body[o[r] : o[r + 1]] for r in range(j - i)]))
            score = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, out_name])

    return run


def score_toxicity(docs: DataFrame, net: Network, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the column `score` (0 to 1, replaced if there is one); one pass, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(score)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(_score(spark.sparkContext.broadcast(net), text, score)), f"{names}, `{score}` double")
