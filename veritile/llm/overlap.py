"""Near copies by exact Jaccard similarity of their sets of word shingles.

A set of n shingles and another of at least similarity s share one of the first n - ceil(s n) + 1 of either, in whatever
order all sets are put.  Each distinct text is dealt to a bucket for each of these, so every pair of similarity s meets
in one.  A pair is dropped before its sets are looked at only if their sizes, or the places of the common shingle in
the two, leave too few shingles to share; what is left is decided by the sets themselves.  The order begins with the
rare shingles; it is estimated from a share of the texts, and only the cost depends on it.

Pairs are made in rounds, and each round passes over what earlier ones joined.  Texts whose fingerprints are close come
first (see ``simhash``).  Then neighbours in each bucket only, which joins most of a large group of copies that differ
more; then all pairs of the buckets whose texts are not joined yet.  Every pair is verified by the sets of its two texts.
Sets are larger than texts and are never stored; they are made again from the texts of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritile.llm.common import discard, heaviest, materialize
from veritile.llm.components import connected

SEED, MULTIPLIER = 42, 0x9E3779B97F4A7C15
#: One text of so many is looked at for the order; shingles held as frequent at most, and the least count of them.
SHARE, FREQUENT, OFTEN = 16, 65_536, 3
#: Texts of a step inside a task; pairs of a step.
STEP, PAIRS = 256, 1 << 18
#: Sets that a task of the verification keeps; rows with texts that go to a worker at once.
HELD, ROWS = 256, 2000
#: The shingle of a text without a word, which is a copy of any other such text.
NOTHING = 0
#: Added where a float is compared with a bound that it may equal.
EPS = 1e-9


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of the runs of ``words`` words, ascending; the whole text if it has fewer words."""
    # bytes.lower() and bytes.split() touch A-Z and \x20\x09-\x0D only.
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.array([NOTHING], np.int64)
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([digest(b" ".join(w), SEED)], np.uint64).view(np.int64)
    each = np.fromiter((digest(x, SEED) for x in w), np.uint64, len(w))
    n = len(w) - words + 1
    h = each[:n].copy()
    for k in range(1, words):
        h *= np.uint64(MULTIPLIER)
        h ^= h >> np.uint64(29)
        h += each[k : k + n]
    h *= np.uint64(MULTIPLIER)
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def node_of(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, sizes, shingles side by side) of a few texts at a time, from (node, text); a text once for each task at most."""
    seen: set[int] = set()
    for b in batches:
        nodes, sets = [], []
        for k, node in enumerate(b.column(0).to_pylist()):
            if node not in seen:
                seen.add(node)
                nodes.append(node)
                sets.append(shingles(b.column(1)[k].as_py(), words))
            if len(nodes) == STEP or nodes and k + 1 == b.num_rows:
                yield np.array(nodes, np.int64), np.array([*map(len, sets)], np.int64), np.concatenate(sets)
                nodes, sets = [], []


def frequent(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Shingles by rising frequency in a share of the texts, without the rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, t in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array(t)], names=["t"])

    some = docs.select(node_of(text_col).alias("node"), text_col).where(F.pmod(F.xxhash64("node"), F.lit(SHARE)) == 0)
    counts = materialize(some.mapInArrow(run, "t long").groupBy("t").count().where(F.col("count") >= OFTEN), "counts", ROWS)
    top = sorted((r["count"], r["t"]) for r in heaviest(counts, "count", FREQUENT).collect())
    discard(counts)
    return np.array([t for _, t in top], np.int64)


def first_shingles(docs: DataFrame, text_col: str, words: int, often: np.ndarray, similarity: float) -> DataFrame:
    """(t, node, n, at): the first shingles of each text, rare ones before frequent ones, with their places in its order."""
    order = np.argsort(often)
    known = often[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, n, t in _sets(batches, words):
            doc = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(t), np.int64)
            if len(known):
                found = np.minimum(np.searchsorted(known, t), len(known) - 1)
                rank = np.where(known[found] == t, order[found] + 1, 0)
            t = t[np.argsort(doc * (len(known) + 1) + rank, kind="stable")]
            place = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
            first = place < np.repeat(n - np.ceil(similarity * n - EPS).astype(np.int64) + 1, n)
            d = doc[first]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t[first], node[d], n[d].astype(np.int32), place[first].astype(np.int32))], names=["t", "node", "n", "at"])

    return docs.select(node_of(text_col).alias("node"), text_col).mapInArrow(run, "t long, node long, n int, at int")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first, never a part of a bucket."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if cols[0][0] == cols[0][-1] and held and held[-1][0][-1] == cols[0][0]:
            held.append(cols)  # all of it goes on with the bucket that is held
            continue
        # The last bucket may go on in the next batch.
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in cols])]
        held = [[c[last:] for c in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _enough(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two texts whose first common shingle is at these places can share enough."""
    most = np.minimum(n[i] - at[i], n[j] - at[j])
    return most >= similarity / (1 + similarity) * (n[i] + n[j]) - EPS


def shared(first: DataFrame) -> DataFrame:
    """The rows of ``first`` whose shingle is among the first ones of another text too; a text counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, node, n, at in _whole_buckets(batches):
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (node[1:] != node[:-1])
            t, node, n, at = (c[new] for c in (t, node, n, at))
            same = t[1:] == t[:-1]
            many = np.zeros(len(t), bool)
            many[1:] |= same
            many[:-1] |= same
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (t, node, n, at)], names=["t", "node", "n", "at"])

    return first.repartition("t").sortWithinPartitions("t", "node").mapInArrow(run, "t long, node long, n int, at int")


def _named(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(t, n, at, node, rep) in buckets, by size."""
    named = met.join(labels, "node", "left").select("t", "n", "at", "node", F.coalesce("rep", "node").alias("rep"))
    return named.repartition("t").sortWithinPartitions("t", "n", F.xxhash64("t", "node"))


def neighbours(met: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs that follow each other by size in a bucket and that ``labels`` does not join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, n, at, node, rep in _whole_buckets(batches):
            i = np.arange(len(t) - 1) if len(t) else np.zeros(0, np.int64)
            i = i[(t[i] == t[i + 1]) & (rep[i] != rep[i + 1])]
            i = i[_enough(n, at, i, i + 1, similarity)]
            u, v = np.minimum(node[i], node[i + 1]), np.maximum(node[i], node[i + 1])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return _named(met, labels).mapInArrow(run, "u long, v long").distinct()


def all_pairs(met: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(u, v): all pairs of the buckets that can share enough and that ``labels`` does not join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, n, at, node, rep in _whole_buckets(batches):
            if not len(t):
                continue
            start = np.nonzero(np.concatenate([[True], t[1:] != t[:-1]]))[0]
            size = np.diff(start, append=len(t))
            mixed = np.minimum.reduceat(rep, start) != np.maximum.reduceat(rep, start)
            keep = np.repeat(mixed, size)
            t, n, at, node, rep = (c[keep] for c in (t, n, at, node, rep))
            end = np.repeat(np.cumsum(size[mixed]), size[mixed])
            # Rows are sorted by n: partners of a row are those after it up to a size.
            to = end
            if len(t):
                group = np.repeat(np.arange(int(mixed.sum())), size[mixed])
                wide = int(n.max()) + 2
                reach = np.minimum(np.floor(n / similarity + EPS).astype(np.int64), wide - 1)
                to = np.searchsorted(group * wide + n, group * wide + reach, "right")
            count = to - np.arange(len(t)) - 1
            a = 0
            total = np.cumsum(count)
            while a < len(t):
                z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
                i = np.repeat(np.arange(a, z), count[a:z])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count[a:z]) - count[a:z], count[a:z])
                ok = (rep[i] != rep[j]) & _enough(n, at, i, j, similarity)
                i, j = i[ok], j[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["u", "v"])
                a = z

    return _named(met, labels).mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """The rows of ``pairs`` whose sets have at least the similarity, written; only the texts of pairs are moved."""
    pairs = materialize(pairs, "pairs")
    need = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = docs.select(node_of(text_col).alias("node"), F.coalesce(text_col, F.lit("")).alias("text")).join(need, "node", "left_semi")
    own = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    both = pairs.join(own.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # the sets of the last texts; a text has its pairs side by side

        def of(node: int, text: pa.StringScalar) -> np.ndarray:
            if node not in held:
                if len(held) >= HELD:
                    held.pop(next(iter(held)))
                held[node] = shingles(text.as_py(), words)
            return held[node]

        for b in batches:
            ok = []
            for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                p, q = of(u, x), of(v, y)
                least = similarity * max(len(p), len(q)) - EPS
                same = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= least else 0
                ok.append(same >= similarity * (len(p) + len(q) - same) - EPS)
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    found = materialize(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "links", ROWS)
    discard(pairs, own)
    return found


def near_classes(docs: DataFrame, text_col: str, words: int, similarity: float, close: DataFrame | None = None) -> DataFrame:
    """(node, rep) for the distinct texts, by ``node_of``, that have another of at least the similarity; equal ``rep``: linked, over others too.

    ``close``: pairs (u, v) that are looked at first; they need not be all, and need not be similar.
    """
    met = materialize(shared(first_shingles(docs, text_col, words, frequent(docs, text_col, words), similarity)), "shared", ROWS)
    none = met.select(F.col("node").alias("u"), F.col("node").alias("v")).where(F.lit(False))
    found = verified(close, docs, text_col, words, similarity) if close is not None else none
    for more in (neighbours, all_pairs):
        labels = connected(found)
        found = found.unionByName(verified(more(met, labels, similarity), docs, text_col, words, similarity))
        discard(labels)
    discard(met)
    return connected(found)
