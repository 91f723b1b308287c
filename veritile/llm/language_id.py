"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text in windows of ``WINDOW`` bytes, forward and backward, from a zero state each; every byte lies in
one window and gets a label distribution from both directions.  A document's distribution is the mean over its bytes.
Windows of many documents run together, so the recurrence is one matrix product for each byte of a window.  Training is
backpropagation through time on the whole texts of a sample of labelled rows whose bound is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritile.llm.common import discard, inward, materialize, outward, place, table

#: Bytes of a window, units of the network, windows and rows of a step.
WINDOW, HIDDEN, BLOCK, ROWS = 128, 8, 1024, 1000
#: Rows of the training sample, steps of training and windows of a step.
SAMPLE_ROWS, STEPS, BATCH = 1600, 260, 192
UNKNOWN, MIN_SCORE = "und", 0.4
PAD = 256


@dataclass
class Network:
    """``e``: inputs of the gates for each byte, ``u``: their recurrence, ``w``: label weights, each by direction."""

    labels: list[str]
    e: list[np.ndarray]
    u: list[np.ndarray]
    w: list[np.ndarray]
    b: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.e, *self.u, *self.w, self.b]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _reversed(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n[k] rows of each column k in reverse; the rest stays."""
    at = np.arange(len(x))[:, None]
    return np.take_along_axis(x, np.where(at < n, n - 1 - at, at), 0)


def _states(e: np.ndarray, u: np.ndarray, x: np.ndarray, kept: list | None = None) -> Iterator[np.ndarray]:
    """The state after each row of the bytes ``x`` (time, windows)."""
    n = u.shape[1]
    h = np.zeros((n, x.shape[1]), np.float32)
    for row in x:
        g = np.take(e, row, axis=1)
        a = u @ h
        g[: 2 * n] += a[: 2 * n]
        gates = _sigmoid(g[: 2 * n])
        c = gates[:n] * a[2 * n :]
        c += g[2 * n :]
        np.tanh(c, out=c)
        if kept is not None:
            kept.append((h, gates, c, a[2 * n :]))
        h = h - c
        h *= gates[n:]
        h += c
        yield h


def _scores(net: Network, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Label distributions (time, labels, windows) of windows whose first ``n`` rows are bytes."""
    out = np.empty((2, len(x), len(net.labels), x.shape[1]), np.float32)
    for d, seen in enumerate((x, _reversed(x, n))):
        for t, h in enumerate(_states(net.e[d], net.u[d], seen)):
            np.matmul(net.w[d], h, out=out[d, t])
    at = np.arange(len(x))[:, None]
    if (n == len(x)).all():
        p = out[0] + out[1, ::-1]
    else:
        back = np.where(at < n, n - 1 - at, at)
        p = out[0] + np.take_along_axis(out[1], back[:, None, :], 0)
    p += net.b[:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


class Windows:
    """Whole texts cut into windows: ``n`` bytes each, and the number of its text, ``owner``; bytes are picked for a few at a time."""

    def __init__(self, texts: list[bytes], size: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        per = -(-lengths // size)
        self.size, self.owner = size, np.repeat(np.arange(len(texts)), per)
        within = (np.arange(len(self.owner)) - np.repeat(np.cumsum(per) - per, per)) * size
        self.starts = np.repeat(np.cumsum(lengths) - lengths, per) + within
        self.n = np.minimum(size, lengths[self.owner] - within)
        self.data = np.frombuffer(b"".join(texts) + bytes(size), np.uint8)

    def __len__(self) -> int:
        return len(self.owner)

    def pick(self, which: np.ndarray | slice) -> np.ndarray:
        """Bytes (time, windows), padded with PAD."""
        at = np.arange(self.size)[:, None]
        x = self.data[self.starts[which] + at].astype(np.int16)
        x[at >= self.n[which]] = PAD
        return x


def as_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def label_positions(net: Network, text: str | None) -> np.ndarray:
    """The label distribution (bytes, labels) of every byte of the lower-cased text."""
    w = Windows([as_bytes(text)], WINDOW)
    parts = [np.zeros((0, len(net.labels)), np.float32)]
    for k in range(0, len(w), BLOCK):
        n = w.n[k : k + BLOCK]
        p = _scores(net, w.pick(slice(k, k + BLOCK)), n)
        parts += [p[:m, :, j] for j, m in enumerate(n)]
    return np.concatenate(parts)


def document_scores(net: Network, texts: list[str | None]) -> np.ndarray:
    """(documents, labels): the mean distribution over the bytes of each text; zeros for an empty one."""
    data = [as_bytes(t) for t in texts]
    sums = np.zeros((len(texts), len(net.labels)))
    w = Windows(data, WINDOW)
    for k in range(0, len(w), BLOCK):
        part, m = w.pick(slice(k, k + BLOCK)), w.n[k : k + BLOCK]
        p = _scores(net, part, m)
        if (m < len(part)).any():
            p *= (np.arange(len(part))[:, None] < m)[:, None, :]
        for j, s in enumerate(p.sum(axis=0)):
            sums[:, j] += np.bincount(w.owner[k : k + BLOCK], s, len(texts))
    return sums / np.maximum(1, [[len(t)] for t in data])


def train(texts: list[str], langs: list[str], steps: int = STEPS, batch: int = BATCH, hidden: int = HIDDEN, seed: int = 5) -> Network:
    """Backpropagation through time on windows drawn from all of the texts, every label with equal weight."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    of = np.array([labels.index(g) for g in langs])
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Network(labels, [draw(3 * hidden, PAD + 1) for _ in (0, 1)], [draw(3 * hidden, hidden) for _ in (0, 1)], [draw(len(labels), hidden) for _ in (0, 1)], np.zeros(len(labels), np.float32))
    for e in net.e:
        e[hidden : 2 * hidden] += 1  # remember at first
    w = Windows([as_bytes(t) for t in texts], WINDOW)
    y = of[w.owner]
    by_label = [np.nonzero(y == k)[0] for k in range(len(labels))]
    by_label = [k for k in by_label if len(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1 if by_label else 1):
        pick = np.concatenate([rng.choice(k, -(-batch // len(by_label))) for k in by_label])
        for p, g, (m, v) in zip(net.parameters(), _gradients(net, w.pick(pick), w.n[pick], y[pick]), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy over all bytes, in the order of ``parameters``."""
    size, hidden = len(x), net.u[0].shape[1]
    at = np.arange(size)[:, None]
    runs = []
    for d, seen in enumerate((x, _reversed(x, n))):
        kept: list = []
        runs.append((seen, kept, np.array(list(_states(net.e[d], net.u[d], seen, kept)))))
    back = np.where(at < n, n - 1 - at, at)[:, None, :]
    ahead, behind = runs[0][2], np.take_along_axis(runs[1][2], back, 0)
    p = net.w[0] @ ahead + net.w[1] @ behind + net.b[:, None]
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[:, y, np.arange(len(y))] -= 1
    p *= (at < n)[:, None, :] / max(1, n.sum())
    p = p.astype(np.float32)
    ge, gu, gw = [], [], []
    for d, (seen, kept, states) in enumerate(runs):
        own = p if d == 0 else np.take_along_axis(p, back, 0)
        gw.append(np.einsum("tlb,thb->lh", own, states))
        given = net.w[d].T @ own
        inputs = np.empty((size, 3 * hidden, x.shape[1]), np.float32)
        u, g = net.u[d], np.zeros_like(net.u[d])
        dh = np.zeros((hidden, x.shape[1]), np.float32)
        for t in range(size - 1, -1, -1):
            h, gates, c, a = kept[t]
            r, z = gates[:hidden], gates[hidden:]
            dh = dh + given[t]
            pre = dh * (1 - z) * (1 - c * c)
            rest = np.concatenate([pre * a * r * (1 - r), dh * (h - c) * z * (1 - z), pre * r])
            inputs[t, : 2 * hidden], inputs[t, 2 * hidden :] = rest[: 2 * hidden], pre
            g += rest @ h.T
            dh = dh * z + u.T @ rest
        flat = seen.reshape(-1)
        order = np.argsort(flat, kind="stable")
        rows = inputs.transpose(0, 2, 1).reshape(-1, 3 * hidden)[order]
        cuts = np.nonzero(np.diff(flat[order], prepend=-1))[0]
        e = np.zeros_like(net.e[d])
        e[:, flat[order][cuts]] = np.add.reduceat(rows, cuts).T
        ge.append(e)
        gu.append(g)
    return [*ge, *gu, *gw, p.sum(axis=(0, 2))]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the checksum of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """At most ``rows`` labelled rows, whole, about the same number for each label where there are as many, by hash of id and text.

    The counts of labels cover all rows and stay on the cluster.  A row's place is its hash times the count of its label,
    so about as many rows of each label have a place below any bound; the bound comes from a histogram of the places.
    Rows that repeat id and text count once.  There is no bound on labels but that of the sample.
    """
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)), 11).cast("double") / float(2**53)
    marked = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), chance.alias("chance"))
    # Written, so that its size is known and the join below does not move the texts, unless there are very many labels.
    counts = materialize(marked.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "labels")
    labels = counts.count()
    if not labels:
        return [], []
    step = rows / labels / 16
    ranked = marked.join(counts, "lang").withColumn("at", F.col("chance") * F.col("rows")).where(F.col("at") < 1024 * step)
    bins = ranked.select("at").distinct().groupBy(F.floor(F.col("at") / step).alias("bin")).count().collect()
    total, end = 0, 0
    for r in sorted(bins):
        total += r["count"]
        if total > rows:
            break
        end = r["bin"] + 1
    picked = ranked.where(F.col("at") < end * step).groupBy("at").agg(F.min(F.struct("lang", "text")).alias("row"))
    got = sorted((r["at"], r["row"]["lang"], r["row"]["text"]) for r in picked.toLocalIterator())
    discard(counts)
    return [t for _, _, t in got], [g for _, g, _ in got]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Network:
    """A network trained on the labelled rows of ``docs`` that are not held out."""
    return train(*sample(docs.where(~held_out(id_col)), id_col, text_col, lang_col), **options)


def predict(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added, which replace columns of those names.

    The network reads the whole text, of any length, and no other column.  A null text and one without a letter are
    ``und`` with score 0, and so is every text if nothing could be learned.  Repeated rows get equal labels (scores may
    differ in the last digits); an empty table gives no rows; other columns pass through, whatever their names.
    """
    inner = inward(docs)
    schema = T.StructType([*inner.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = inner.columns.index(place(docs, text_col))

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(at).to_pylist()
        known = np.array([bool(net.labels) and any(map(str.isalpha, t or "")) for t in texts], bool)
        p = document_scores(net, texts) if net.labels else np.zeros((len(texts), 1))
        best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
        langs = [net.labels[j] if ok else UNKNOWN for j, ok in zip(best, known)]
        score = np.where(known, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield from (step(whole.slice(k, ROWS)) for k in range(0, whole.num_rows, ROWS))

    return outward(inner.mapInArrow(run, schema), docs, ("lang_pred", "score"))


def language_stage(docs: DataFrame) -> DataFrame:
    """Pipeline form: documents without a letter, or whose pooled probability of any language is low, go.

    Where no row has a label nothing can be learned, so no document is rejected.  The columns stay as they are.
    """
    net = fit(docs)
    if not net.labels:
        return docs
    out = predict(inward(docs), net, place(docs, "text"))
    return outward(out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)), docs)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
