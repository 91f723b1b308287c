"""Best-two-fit packing of token sequences, planned on the histogram of lengths.

A piece is at most ``capacity`` tokens long, so a corpus has at most ``capacity`` different lengths.  The plan is made on
that histogram: bins of equal content are filled at once, so its cost is bounded by the capacity and not by the corpus.
Pieces are range-partitioned by length; a piece's rank among those of its length needs only the row counts of the
partitions.  Rank and length then name its bin and place, without any further shuffle, so the packing is the one a
single machine would find.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritile.llm.common import materialize, table

CAPACITY, END_ID, VOCABULARY = 2048, 0, "byte_bpe_50k.tiktoken"
#: The one special string of the vocabulary, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str, end_id: int = END_ID) -> np.ndarray:
    """The ids of a whole text, then ``end_id``, as little-endian unsigned 32-bit numbers."""
    ordinary = _encoding(path).encode_ordinary
    ids: list[int] = []
    for k, part in enumerate((text or "").split(SPECIAL)):
        if k:
            ids.append(SPECIAL_ID)
        ids += ordinary(part)
    ids.append(end_id)
    return np.array(ids, "<u4")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, and the ids' bytes ``with_ids``.

    A document of more than ``capacity`` tokens is cut into pieces of ``capacity``, of which the first may be shorter.
    """
    path = path or vocabulary_path()
    schema = T.StructType([
        docs.schema[id_col],
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for r, text in enumerate(b.column(1)):
                ids = encode(text.as_py(), path)
                first = len(ids) % capacity or capacity
                for k, (lo, hi) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
                    data = ids[lo:hi].tobytes()
                    row.append(r)
                    out.append((k, lo, hi - lo, zlib.crc32(data), data))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 if with_ids else 4]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Counter]]:
    """[(bins, content)]: so many bins, each with so many pieces of each length.

    A bin takes the longest piece left and then, again and again, the longest that fits.  Then its shortest piece makes
    room for two unpacked pieces that together fill the larger gap more tightly, as long as there are such.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    there = sum(1 << n for n in left)
    done: list[tuple[int, Counter]] = []

    def longest(room: int, mask: int) -> int:
        return (mask & ((2 << room) - 1)).bit_length() - 1 if room > 0 else -1

    while there:
        content: Counter = Counter()
        mask, room = there, capacity

        def take(n: int) -> None:
            nonlocal mask, room
            content[n] += 1
            room -= n
            if content[n] == left[n]:
                mask &= ~(1 << n)

        while (n := longest(room, mask)) > 0:
            take(n)
        while room and sum(content.values()) > 1:
            least = min(content)
            gap, best = room + least, (least, 0, 0)
            a = longest(gap - 1, mask)
            while a > 0 and 2 * a > best[0]:
                partner = mask if left[a] - content[a] > 1 else mask & ~(1 << a)
                b = longest(min(gap - a, a), partner)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                a = longest(a - 1, mask)
            if not best[1]:
                break
            content[least] -= 1
            room += least
            mask |= 1 << least
            if not content[least]:
                del content[least]
            take(best[1])
            take(best[2])
        bins = min(left[n] // k for n, k in content.items())
        for n, k in content.items():
            left[n] -= bins * k
            if not left[n]:
                there &= ~(1 << n)
        done.append((bins, content))
    return done


def _places(done: list[tuple[int, Counter]], width: int) -> tuple[np.ndarray, ...]:
    """For searches by length * width + rank: the first such number of each run, and its k, bin and offset."""
    used: Counter = Counter()
    rows, bin_ = [], 0
    for bins, content in done:
        offset = 0
        for n in sorted(content, reverse=True):
            rows.append((n * width + used[n], content[n], bin_, offset))
            used[n] += bins * content[n]
            offset += n * content[n]
        bin_ += bins
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 4


def pack(parts: DataFrame, capacity: int = CAPACITY, tie: tuple[str, ...] = ()) -> DataFrame:
    """``parts`` (with a long ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset`` added.

    The columns ``tie`` fix the order of pieces of one length, so that a task run again gives the same ranks.
    """
    order = ["length", *tie]
    sorted_ = materialize(parts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    # At most a row for each partition and each length, as a partition holds a range of lengths.
    runs = sorted_.groupBy(F.shiftright("_at", 33).alias("p"), "length").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    totals, offsets = Counter(), {}
    for r in sorted(runs, key=lambda r: r["first"]):
        offsets[r["first"]] = (r["length"], totals[r["length"]])
        totals[r["length"]] += r["n"]
    width = max(totals.values(), default=0) + 1
    firsts = np.array(sorted(offsets), np.int64)
    before = np.array([offsets[f][1] for f in firsts.tolist()], np.int64)
    starts, each, bin_, base = _places(plan(dict(totals), capacity), width)
    columns = parts.columns
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_at", "length"))
            if not len(at):
                continue
            k = np.searchsorted(firsts, at, "right") - 1
            number = n * width + at - firsts[k] + before[k]
            j = np.searchsorted(starts, number, "right") - 1
            r = number - starts[j]
            kept = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bin_[j] + r // each[j]), pa.array(base[j] + r % each[j] * n)], names=schema.names)

    return sorted_.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with its sequence and its place there.

    A null or empty text is the end id alone.  Repeated rows are packed as often as they occur, a null id is kept, and
    other columns are ignored, whatever their names.  An empty table gives no rows.  Long texts are cut, never dropped.
    """
    parts = materialize(pieces(docs, id_col, text_col, capacity, path, with_ids), "pieces")
    return pack(parts, capacity, (id_col, "piece", "ids_crc32"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids of each sequence, from rows made ``with_ids``; at most ``capacity`` in each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.expr("aggregate(_parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def pack_stage(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
