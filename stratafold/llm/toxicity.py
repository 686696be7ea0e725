"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs.  A word's vector is the sum of two embeddings: one of the word itself (hashed) and the scaled sum over its characters' n-grams of 3 to 5
(hashed, with marks for both ends), so that unseen forms of a known stem are understood.  Both are trained.

Network.  A text is cut into overlapping windows of WINDOW words, one each STRIDE words; every word stands in two windows but
for the ends.  Each window goes through a GRU in both directions; attention weights over the positions pool the states, and a
logistic unit scores the window.  A text's score is that of its highest window.

Training is by multiple instances: in every second pass the windows of a batch of texts are scored, and the gradient of that pass and the next goes
through each text's highest window, as the label says that some place is toxic, not which.  Adam, weighted classes, a fixed seed.
It uses a bounded sample of labelled rows (`positives` and `negatives` texts, none longer than `longest` bytes, chosen by a hash of
id and text).  Scoring reads whole texts, in one pass without a shuffle; distinct words of a batch are embedded once and their
input products are kept, so that a step of the recurrence is one small matrix product.

Edge cases: a null or empty text is one window without words, and gets the bias's score, which training keeps low; rows with null
labels or ids don't train; without training rows of both classes every score is the share of toxic labels (0 without labels);
repeated rows get a row each; several labels of an id count as toxic if any is; columns besides those named are passed by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bound_batches, fold, kept, sliced, texts_of, unnamed, with_fields
from ._text import ALNUM, Words, groups

WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 14
EMBED, HIDDEN = 12, 8
WINDOW, STRIDE = 32, 16
#: Training texts of each class, and the bytes of the longest.
POSITIVES, NEGATIVES, LONGEST = 1200, 1800, 4_000
EPOCHS, BATCH, RATE = 6, 64, 0.02
#: Most windows scored at once.
CHUNK = 2048
#: Most words whose input products are kept, 200 bytes each, and new words that are embedded at once.
KEPT, AT_ONCE = 80_000, 4096


class Inputs:
    """Table rows of some words: one in the table of words, and those of their n-grams of 3 to 5 characters."""

    def __init__(self, hashes: np.ndarray, words: list[bytes]) -> None:
        self.word = (hashes % np.uint64(WORD_ROWS)).astype(np.int64)
        # "<" and ">" never stand in a word, so they mark its ends in one string of all words.
        codes = np.frombuffer((b"<" + b"><".join(words) + b">").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        owner = np.cumsum(codes == ord("<")) - 1
        rows, owners = [], []
        for n in (3, 4, 5):
            m = max(0, len(codes) - n + 1)
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x9E3779B1) + codes[k : k + m]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            inside = owner[:m] == owner[n - 1 : n - 1 + m]
            rows.append(((h >> np.uint32(12)) % np.uint32(GRAM_ROWS))[inside])
            owners.append(owner[:m][inside])
        owners = np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        self.grams = np.concatenate(rows)[order].astype(np.int64)
        self.at = np.searchsorted(owners[order], np.arange(len(words) + 1))

    def take(self, which: np.ndarray) -> "Inputs":
        """Those of some of the words."""
        out = object.__new__(Inputs)
        out.word = self.word[which]
        sizes = np.diff(self.at)[which]
        out.at = np.concatenate([[0], np.cumsum(sizes)])
        out.grams = self.grams[np.repeat(self.at[which] - out.at[:-1], sizes) + np.arange(out.at[-1])]
        return out


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the windows over texts of so many words: each STRIDE words, the last one reaching the end; one for a short text."""
    each = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, 1)
    owner = np.repeat(np.arange(len(counts)), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = np.minimum(nth * STRIDE, np.maximum(counts[owner] - WINDOW, 0))
    return owner, start, start + np.minimum(counts[owner], WINDOW)


def _summed(where: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, ascending, and the sums of their rows."""
    order = np.argsort(where, kind="stable")
    places = where[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(places) else np.empty(0, np.int64)
    return places[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, x / (1 + |x|): in place of tanh, as it needs no exponential. Its slope is (1 - |y|)**2."""
    return x / (np.abs(x) + np.float32(1))


def _gate(x: np.ndarray) -> np.ndarray:
    """A gate between 0 and 1 from the same function; its slope is 2 * min(y, 1 - y)**2."""
    return _squash(x) * np.float32(0.5) + np.float32(0.5)


def _gate_slope(y: np.ndarray) -> np.ndarray:
    return 2 * np.minimum(y, 1 - y) ** 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """Parameters, and passes through them. Arrays are float32."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {"word": normal(WORD_ROWS, e, scale=0.1), "gram": normal(GRAM_ROWS, e, scale=0.3)}
        for d in "fb":
            self.p |= {f"w{d}": normal(e, 3 * h, scale=e**-0.5), f"u{d}": normal(h, 3 * h, scale=h**-0.5), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": normal(2 * h, h, scale=h**-0.5), "v": normal(h, scale=1.0), "o": normal(2 * h, scale=0.5), "z": np.full(1, -1.0, np.float32)}

    def embed(self, words: Inputs) -> np.ndarray:
        sizes = np.diff(words.at)
        sums = np.add.reduceat(self.p["gram"][words.grams], words.at[:-1], axis=0)
        return self.p["word"][words.word] + sums / np.sqrt(sizes)[:, None].astype(np.float32)

    def products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input products of word vectors, for both directions."""
        return tuple(x @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb")

    def forward(self, index: np.ndarray, xf: np.ndarray, xb: np.ndarray, keep: bool = False):
        """Window scores (logits). index: rows of xf and xb by window and position; the first row of those, of zeros, pads the end."""
        n, t = index.shape
        h = HIDDEN
        real = index != 0
        length = real.sum(axis=1)
        states = np.zeros((2, t, n, h), np.float32)
        columns, full = np.ascontiguousarray(index.T), bool(real.all())
        tape = {}
        for d, x, order, out in (("f", xf, range(t), states[0]), ("b", xb, range(t - 1, -1, -1), states[1])):
            u = np.ascontiguousarray(self.p[f"u{d}"][:, : 2 * h])
            uc = np.ascontiguousarray(self.p[f"u{d}"][:, 2 * h :])
            s = np.zeros((n, h), np.float32)
            for i in order:
                g = x.take(columns[i], axis=0)
                zr = _gate(g[:, : 2 * h] + s @ u)
                z, r = zr[:, :h], zr[:, h:]
                c = _squash(g[:, 2 * h :] + (r * s) @ uc)
                new = s + z * (c - s)
                if not full:
                    new *= real[:, i, None]
                if keep:
                    tape[d, i] = s, z, r, c
                s = out[i] = new
        q = _squash(states[0].reshape(t * n, h) @ self.p["a"][:h] + states[1].reshape(t * n, h) @ self.p["a"][h:])
        e = (q @ self.p["v"]).reshape(t, n)
        e = np.where(real.T, e, np.float32(-30))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.concatenate([(w[:, :, None] * half).sum(axis=0) for half in states], axis=1)
        pooled[length == 0] = 0
        logit = pooled @ self.p["o"] + self.p["z"]
        return (logit, (index, xf, xb, real, states, tape, q.reshape(t, n, h), w, pooled, length)) if keep else logit

    def backward(self, dlogit: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the parameters but the embeddings, and of the input products."""
        index, xf, xb, real, states, tape, q, w, pooled, length = kept
        h = HIDDEN
        states = np.concatenate(list(states), axis=2)
        t, n, _ = states.shape
        g = {"o": pooled.T @ dlogit, "z": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * self.p["o"]
        dpool[length == 0] = 0
        dstates = w[:, :, None] * dpool
        dw = np.einsum("tnh,nh->tn", states, dpool)
        de = w * (dw - (w * dw).sum(axis=0))
        dq = de[:, :, None] * self.p["v"] * (1 - np.abs(q)) ** 2
        g["v"] = np.einsum("tn,tnh->h", de, q)
        g["a"] = states.reshape(t * n, -1).T @ dq.reshape(t * n, -1)
        dstates += dq @ self.p["a"].T
        dx = {}
        for d, order, half in (("f", range(t - 1, -1, -1), slice(0, h)), ("b", range(t), slice(h, 2 * h))):
            u = self.p[f"u{d}"]
            du, carry = np.zeros_like(u), np.zeros((n, h), np.float32)
            gates = np.empty((n, t, 3 * h), xf.dtype)
            for i in order:
                s, z, r, c = tape[d, i]
                dn = (dstates[i, :, half] + carry) * real[:, i, None]
                dc = dn * z * (1 - np.abs(c)) ** 2
                dz = dn * (c - s) * _gate_slope(z)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * s * _gate_slope(r)
                dzr = np.concatenate([dz, dr], axis=1)
                carry = dn * (1 - z) + drs * r + dzr @ u[:, : 2 * h].T
                du[:, : 2 * h] += s.T @ dzr
                du[:, 2 * h :] += (r * s).T @ dc
                gates[:, i, : 2 * h], gates[:, i, 2 * h :] = dzr, dc
            dx[d] = np.zeros_like(xf)
            places, sums = _summed(index.ravel(), gates.reshape(n * t, -1))
            dx[d][places] = sums
            g[f"u{d}"], g[f"c{d}"] = du, dx[d][1:].sum(axis=0)
        return g, dx["f"][1:], dx["b"][1:]


def _index(start: np.ndarray, end: np.ndarray, ids: np.ndarray, pad: int) -> np.ndarray:
    """Word rows by window and position, padded at the end."""
    at = start[:, None] + np.arange(max(1, int((end - start).max(initial=0))))
    return np.where(at < end[:, None], ids[np.minimum(at, len(ids) - 1)] if len(ids) else pad, pad)


class Scorer:
    """Scores texts with a trained network; keeps the products of words it has seen."""

    def __init__(self, net: Network | None, prior: float = 0.0) -> None:
        self.net, self.prior = net, prior
        self._forget()

    def _forget(self) -> None:
        # Hashes of known words, ascending, and the rows of their products; row 0 is the padding's.
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.xf = self.xb = np.zeros((1, 3 * HIDDEN), np.float32)

    def __getstate__(self):
        return {"net": self.net, "prior": self.prior}

    def __setstate__(self, state) -> None:
        self.net, self.prior = state["net"], state["prior"]
        self._forget()

    def _ids(self, words: Words) -> np.ndarray:
        """Rows of the words' products, computing those of new words."""
        if len(self.keys) > KEPT:
            self._forget()
        unique, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == unique if len(self.keys) else np.zeros(len(unique), bool)
        rows = np.empty(len(unique), np.int64)
        rows[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            fs, bs = [self.xf], [self.xb]
            for k in range(0, len(new), AT_ONCE):  # a word's n-grams take far more room than its products
                part = new[k : k + AT_ONCE]
                f, b = self.net.products(self.net.embed(Inputs(unique[part], [words.strings(i, i + 1)[0] for i in first[part].tolist()])))
                fs.append(f)
                bs.append(b)
            rows[new] = np.arange(len(self.xf), len(self.xf) + len(new))
            self.xf, self.xb = np.concatenate(fs), np.concatenate(bs)
            self.keys, self.rows = np.insert(self.keys, at[new], unique[new]), np.insert(self.rows, at[new], rows[new])
        return rows[inverse]

    def score(self, texts: list[bytes | None]) -> list[float]:
        if self.net is None:
            return [self.prior] * len(texts)
        words = Words(texts, ALNUM)
        ids = self._ids(words) if len(words.hashes) else np.empty(0, np.int64)
        owner, start, end = windows_of(words.counts)
        start, end = words.at[owner] + start, words.at[owner] + end
        logit = np.empty(len(owner), np.float32)
        order = np.argsort(end - start, kind="stable")  # windows of a length together
        for k in range(0, len(order), CHUNK):
            part = order[k : k + CHUNK]
            logit[part] = self.net.forward(_index(start[part], end[part], ids, 0), self.xf, self.xb)
        best = np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(len(texts)))) if len(texts) else logit
        return (1 / (1 + np.exp(-best.astype(float)))).tolist()


def train(rows: list[tuple[int, bytes]], epochs: int = EPOCHS, seed: int = 11) -> Scorer:
    """A scorer from (label, text) pairs."""
    labels = np.array([y for y, _ in rows], np.float32)
    if not len(rows) or not 0 < labels.mean() < 1:
        return Scorer(None, float(labels.mean()) if len(rows) else 0.0)
    net, rng = Network(), np.random.default_rng(seed)
    words = Words([t for _, t in rows], ALNUM)
    unique, once, ids = np.unique(words.hashes, return_index=True, return_inverse=True)
    inputs = Inputs(unique, [words.strings(i, i + 1)[0] for i in once.tolist()]) if len(unique) else None
    pad = np.zeros((1, 3 * HIDDEN), np.float32)
    owner, start, end = windows_of(words.counts)
    start, end = words.at[owner] + start, words.at[owner] + end
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    chosen = first[:-1].copy()
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            again = epoch % 2 == 1  # with the windows that the pass before has chosen
            flat = chosen[batch] if again else np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
            index = _index(start[flat], end[flat], ids, -1)
            used, local = np.unique(index[index >= 0], return_inverse=True)
            index[index >= 0] = local + 1
            index[index < 0] = 0
            part = inputs.take(used) if len(used) else None
            x = net.embed(part) if part else np.zeros((0, EMBED), np.float32)
            xf, xb = (np.concatenate([pad, p]) for p in net.products(x))
            top = np.arange(len(batch))
            if not again:
                logit = net.forward(index, xf, xb)
                cuts = np.cumsum([0, *(first[batch + 1] - first[batch])])
                top = np.array([a + logit[a:b].argmax() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                chosen[batch] = flat[top]
            logit, kept = net.forward(index[top], xf, xb, keep=True)
            y = labels[batch]
            grads, df, db = net.backward(((_sigmoid(logit) - y) * weight[batch] / len(batch)).astype(np.float32), kept)
            grads["wf"], grads["wb"] = x.T @ df, x.T @ db
            step += 1
            near = np.unique(index[top])
            near = near[near > 0] - 1  # of all words in the batch, only those of the highest windows learn
            if len(near):
                part, dx = part.take(near), df[near] @ net.p["wf"].T + db[near] @ net.p["wb"].T
            _adam(net.p, grads, m, v, rate, step)
            if len(near):
                _adam_rows(net.p, "word", part.word, dx, m, v, rate, step)
                sizes = np.diff(part.at)
                _adam_rows(net.p, "gram", part.grams, np.repeat(dx / np.sqrt(sizes)[:, None], sizes, axis=0), m, v, rate, step)
    return Scorer(net, float(labels.mean()))


def _adam(p, grads, m, v, rate: float, step: int) -> None:
    for k, g in grads.items():
        m[k] += 0.1 * (g - m[k])
        v[k] += 0.01 * (g * g - v[k])
        p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)


def _adam_rows(p, key: str, rows: np.ndarray, dx: np.ndarray, m, v, rate: float, step: int) -> None:
    """The same for the rows of a table that took part."""
    used, g = _summed(rows, dx)
    a = m[key][used] + 0.1 * (g - m[key][used])
    b = v[key][used] + 0.01 * (g * g - v[key][used])
    m[key][used], v[key][used] = a, b
    p[key][used] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_id: str, positives: int, negatives: int, longest: int) -> list[tuple[int, bytes]]:
    """About as many rows of each class, the same ones however the tables are laid out."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col(label_id).isNotNull() & (fold(F.col(label_id)) != 0))
    marks = marks.groupBy(F.col(label_id).alias("_id")).agg(F.max("toxic").cast("int").alias("y"))
    marks = marks.withColumn("h", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)))
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1 << 30, -(-(1 << 30) * positives // max(1, counts.get(1, 0)))))).otherwise(F.lit(min(1 << 30, -(-(1 << 30) * negatives // max(1, counts.get(0, 0))))))
    picked = marks.filter(F.col("h") < share)
    texts = docs.filter(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= longest)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # The picked labels are few by the bounds above, so they are the side to broadcast.
    got = texts.join(F.broadcast(picked), "_id").select("y", "h", "text").toLocalIterator()
    return [(y, t) for _, y, t in sorted((r.h, r.y, r.text.encode()) for r in got)]


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", positives: int = POSITIVES, negatives: int = NEGATIVES, longest: int = LONGEST) -> DataFrame:
    """The documents with all their columns and `toxicity`, in place of a column of that name."""
    docs = docs.drop("toxicity")
    bound_batches(docs.sparkSession)
    inner = unnamed(docs)
    key, text = (f"_in{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = training_rows(inner, labels, id_col=key, text_col=text, label_id=label_id, positives=positives, negatives=negatives, longest=longest)
    scorer = docs.sparkSession.sparkContext.broadcast(train(rows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = texts_of(batch.column(text))
            scores: list[float] = []
            for a, b in groups(texts, 1 << 20):
                scores += scorer.value.score(texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "toxicity"])

    return inner.mapInArrow(scan, with_fields(inner.schema, "toxicity double")).toDF(*docs.columns, "toxicity")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_toxicity(docs, labels)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that don't score as toxic, with their columns."""
    return kept(docs, lambda d, **columns: score_toxicity(d, labels, **columns), F.col("toxicity") < 0.5, id_col=id_col, text_col=text_col)
