"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are made in one pass.  Equal ones collapse first, so copies cost nothing further.  Two fingerprints within
``radius`` bits agree on at least two of ``radius + 2`` bit blocks, so each distinct fingerprint is dealt to one bucket
for each pair of blocks; a bucket's key has 32 of the 64 bits at radius 2.  Inside the buckets the comparison is exact:
rows are sorted by population count and cut into tiles, tiles are compared whole with exclusive-or and bit counts, and
a pair of tiles whose population counts differ beyond the radius is skipped.  A bucket with very many fingerprints is
itself cut into tiles by population count and hash, and its tile pairs become tasks of their own.  Links leave a
bucket as a spanning forest, never as all pairs.

``near_dedup_stage`` finds near copies on word shingles by similarity.  Close fingerprints propose pairs by the same tiled
comparison; every pair is verified by the exact Jaccard similarity of its shingle sets, and texts whose fingerprints are
not close meet by ``overlap``, which loses no pair of the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritile.llm import overlap
from veritile.llm.common import inward, materialize, outward, place, table
from veritile.llm.components import connected

SHINGLE, RADIUS, SEED = 3, 2, 42
#: For near copies by similarity: words of a shingle, least similarity.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
#: Rows of a tile inside a task; fingerprints of a bucket above which its tiles become tasks.
TILE, HOT = 256, 4096


def _majority(h: np.ndarray) -> int:
    counts = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """An unsigned 64-bit word, zero without words: a bit is set if over half the hashes of the shingles, repeats included, have it set."""
    # bytes.lower() and bytes.split() touch A-Z and \x20\x09-\x0D only.
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = zip(*(w[i:] for i in range(shingle))) if len(w) > shingle else [w]
    digest = xxhash.xxh64_intdigest
    return _majority(np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): one row for each row of ``docs``; a long holds the bits."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _buckets(fps: DataFrame, radius: int) -> DataFrame:
    """(key, pc, fp, node) for each pair of blocks."""
    n = radius + 2
    at = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned("fp", at[i]).bitwiseAND(F.lit((1 << (at[i + 1] - at[i])) - 1)) for i in range(n)]
    keys = [F.xxhash64(F.lit(k), block[i], block[j]) for k, (i, j) in enumerate(combinations(range(n), 2))]
    return fps.select("fp", "node", F.bit_count("fp").alias("pc"), F.explode(F.array(*keys)).alias("key"))


def _cells(rows: DataFrame, radius: int, hot: int) -> DataFrame:
    """Adds ``lo`` and ``hi``: -1 for common buckets, the two tiles of a task for a bucket of over ``hot`` rows."""
    counts = rows.groupBy("key", "pc").agg(F.count(F.lit(1)).alias("n"))
    tiles = (
        counts.groupBy("key")
        .agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("pc", F.ceil(F.col("n") / hot).cast("int").alias("k")))).alias("tiles"))
        .where(F.col("all") > hot)
        .select("key", "tiles")
    )
    own = "cast(pmod(xxhash64(fp), tiles[pc]) as int)"
    # Tiles are numbered 2**20 * popcount + part.  A row meets the tiles whose popcount is within the radius.
    meets = f"flatten(transform(filter(map_keys(tiles), p -> abs(p - pc) <= {radius}), p -> transform(sequence(0, tiles[p] - 1), s -> p * 1048576 + s)))"
    dealt = rows.join(tiles, "key", "left").select(
        "key", "pc", "fp", "node", F.expr(f"case when tiles is null then -1 else pc * 1048576 + {own} end").alias("t"), F.expr(f"case when tiles is null then array(-1) else {meets} end").alias("with")
    )
    return dealt.select("key", "pc", "fp", "node", "t", F.explode("with").alias("o")).select(
        "key", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "pc", "fp", "node"
    )


def link_forest(group: np.ndarray, pc: np.ndarray, fp: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): a spanning forest of the links between rows of equal ``group``; rows are sorted by (group, pc)."""
    n = len(fp)
    root = np.arange(n)
    for a in range(0, n, tile):
        a2 = min(n, a + tile)
        for b in range(a, n, tile):
            if group[b] > group[a2 - 1]:
                break
            b2 = min(n, b + tile)
            if group[a] == group[b2 - 1] and pc[b] - pc[a2 - 1] > radius:
                continue  # one bucket, and the population counts are too far apart
            near = np.bitwise_count(fp[a:a2, None] ^ fp[None, b:b2]) <= radius
            near &= group[a:a2, None] == group[None, b:b2]
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            if len(i):
                _unite(root, i + a, j + b)
    moved = np.nonzero(root != np.arange(n))[0]
    return moved, root[moved]


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while True:
        x, y = root[i], root[j]
        open_ = x != y
        if not open_.any():
            return
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(u, v): a spanning forest, bucket by bucket, of the links between rows (fp, node) of distinct ``fp``."""

    def forest(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, lo, hi, pc, fp, node = part
        if len(fp) < 2:
            return
        new = np.ones(len(fp), bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.cumsum(new)
        full = np.bincount(group)[group] > 1  # a bucket of one row has no pair
        i, j = link_forest(group[full], pc[full].astype(np.int64), fp[full].view(np.uint64), radius)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(node[full][i]), pa.array(node[full][j])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            cols = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            # The last bucket may go on in the next batch.
            last = np.nonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1]))[0][0]
            yield from forest([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held:
            yield from forest(held)

    cells = _cells(_buckets(fps, radius), radius, hot)
    return cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "pc").mapInArrow(run, "u long, v long").distinct()


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    hot: int = HOT,
) -> DataFrame:
    """(id, fp, component_id): one row for each row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row itself included.  Null and empty texts and those
    without a word have fingerprint zero, which is linked like any other.  Repeated rows share a component; a null id
    never names one, unless no row of the component has another.  Texts are taken whole; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("_least")), "distinct")
    labels = connected(links(fps.select("fp", F.col("fp").alias("node")), radius, hot))
    named = labels.join(fps.select(F.col("fp").alias("node"), "_least"), "node")
    best = named.groupBy("rep").agg(F.min("_least").alias("_best"))
    of = materialize(labels.join(best, "rep").select(F.col("node").alias("fp"), "_best"), "classes")
    full = fps.join(of, "fp", "left").select("fp", F.coalesce("_best", "_least").alias("component_id"))
    return marked.join(full, "fp").select(id_col, "fp", "component_id")


def close_texts(docs: DataFrame, text_col: str = "text", shingle: int = NEAR_SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(u, v): a spanning forest of the texts, by ``overlap.node_of``, whose fingerprints differ in at most ``radius`` bits."""
    texts = docs.select(overlap.node_of(text_col).alias("node"), F.col(text_col).alias("text"))
    marked = materialize(fingerprints(texts, "node", "text", shingle).distinct(), "fingerprints", overlap.ROWS)
    fps = materialize(marked.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    equal = marked.join(fps, "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    return equal.unionByName(links(fps.select("fp", F.col("least").alias("node")), radius))


def near_dedup_stage(docs: DataFrame) -> DataFrame:
    """Pipeline form: of each class of near copies (five words, exact similarity 0.8) one row stays, that of the least id.

    A null id comes last, and texts that share an id are told apart.  Rows that repeat id and text are put in order of
    their other columns and the first stays.  Texts without a word are copies of each other.
    """
    inner = inward(docs)
    row, text = place(docs, "doc_id"), place(docs, "text")
    of = overlap.near_classes(inner, text, NEAR_SHINGLE, NEAR_SIMILARITY, close_texts(inner, text))
    name = [F.xxhash64(F.lit(s), F.col(row), F.coalesce(F.col(text), F.lit(""))).alias(f"k{s}") for s in (1, 2)]
    rows = inner.select(*name, F.struct(F.col(row).isNull().alias("none"), F.col(row).alias("id")).alias("first"), overlap.node_of(text).alias("node"))
    rows = materialize(rows.groupBy("k1", "k2", "node").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")).join(of, "node", "left").withColumn("rep", F.coalesce("rep", "node")), "rows")
    best = rows.groupBy("rep").agg(F.min(F.struct("first", "k1", "k2")).alias("best")).select("rep", F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2"))
    gone = rows.join(best, "rep").where("k1 <> b1 or k2 <> b2").select("k1", "k2")
    kept = inner.select("*", *name).join(gone, ["k1", "k2"], "left_anti")
    twice = rows.where("n > 1").select("k1", "k2")
    if not twice.isEmpty():
        one = kept.join(twice, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min(F.struct(*inner.columns)).alias("row")).select("row.*")
        kept = kept.join(twice, ["k1", "k2"], "left_anti").select(inner.columns).unionByName(one.select(inner.columns))
    return outward(kept, docs)


def hex_of(c: str):
    return F.lower(F.lpad(F.hex(F.col(c)), 16, "0"))


def query(spark, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
