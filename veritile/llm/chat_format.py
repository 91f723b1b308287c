"""Chat formatting after the collapse of cumulative snapshots.

Loggers write a conversation again whenever it grows.  A conversation that another one begins with is a snapshot and
goes; the longest ones stay and are rendered.

Each turn gets a rolling hash of all turns up to it.  The hash is a polynomial, so a conversation that spans tasks is
hashed in parts and the parts are joined: rows are range-partitioned by conversation and turn, a task hashes what it
holds, the driver gets one row for each partition, and the rows of a conversation that goes on from the partition before
are joined to it by expressions, whose input is one such row for each partition.  A snapshot's last hash is one of the hashes
before the last of a longer conversation, which an anti-join finds; both of its sides are made distinct beforehand, so
that a first turn that a third of the conversations share is one row.  Text is rendered in parts of at most
``PART_TURNS`` turns, so no row grows without bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritile.llm.common import materialize, table

PART_TURNS = 512
PRIME, BASES = (1 << 61) - 1, (1_000_003_579, 982_451_653_001)
_HASHED = [("idx", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("p1", T.LongType()), ("p2", T.LongType()), ("head", T.BooleanType()), ("more", T.BooleanType()), ("part", T.LongType()), ("repeat", T.BooleanType()), ("edge", T.BooleanType())]


def rolled(h: int, x: int, base: int) -> int:
    return (h * base + x % PRIME) % PRIME


def joined(left: int, right: int, n: int, base: int) -> int:
    """The hash of a part followed by one of ``n`` turns."""
    return (left * pow(base, n, PRIME) + right) % PRIME


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) in order with idx, h1, h2 of the turns so far, and whether a later one follows."""
    spark = turns.sparkSession
    turn_hash = [F.xxhash64(F.lit(s), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))) for s in (1, 2)]
    marked = turns.select("conv_id", "turn", "role", "text", turn_hash[0].alias("x1"), turn_hash[1].alias("x2"))
    order = ["conv_id", "turn", "x1", "x2"]
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*marked.schema.fields, *(T.StructField(*f) for f in _HASHED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rolling hashes within the partition; the last row of each batch waits for what follows it."""
        part = TaskContext.get().partitionId()
        last, n, h, power, head = None, 0, (0, 0), (1, 1), True
        waiting: pa.RecordBatch | None = None

        def out(b: pa.RecordBatch, after: object, end: bool) -> pa.RecordBatch:
            nonlocal last, n, h, power, head
            keys = list(zip(*(b.column(c).to_pylist() for c in (0, 1, 4, 5))))
            rows = []
            for k, key in enumerate(keys):
                repeat = key == last
                if last is not None and key[0] != last[0]:
                    n, h, head = 0, (0, 0), False
                if not repeat:
                    n, h = n + 1, tuple(rolled(g, x, base) for g, x, base in zip(h, key[2:], BASES))
                    if head:  # what a part before this one is multiplied by
                        power = tuple(p * base % PRIME for p, base in zip(power, BASES))
                follows = keys[k + 1] if k + 1 < len(keys) else after
                more = follows is not None and follows[0] == key[0] and follows != key
                rows.append((n, *h, *power, head, more, part, repeat, end and k + 1 == len(keys)))
                last = key
            cols = [pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.bool_()] * 2)]
            return pa.RecordBatch.from_arrays([*b.columns, *cols], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            if waiting is not None:
                yield out(waiting, tuple(b.column(c)[0].as_py() for c in (0, 1, 4, 5)), False)
            waiting = b
        if waiting is not None:
            yield out(waiting, None, True)

    # Rows that repeat another whole are dropped here; a partition's last row stays, as the marks of the edge are there.
    local = materialize(ordered.mapInArrow(run, schema).where("not repeat or edge"), "turns")
    edges = sorted(local.where("edge").select("part", "conv_id", "idx", "h1", "h2", "head").collect())
    firsts = {r["part"]: r["conv_id"] for r in local.where("head and idx = 1").select("part", "conv_id").distinct().collect()}
    carry, before = {}, None
    follow = {}
    for r in edges:
        part = r["part"]
        if before is not None:
            carry[part] = before
            if firsts.get(part) == before[0]:
                follow[before[4]] = True
        idx, h1, h2 = r["idx"], r["h1"], r["h2"]
        if before is not None and r["head"] and r["conv_id"] == before[0]:
            idx, h1, h2 = idx + before[1], joined(before[2], h1, idx, BASES[0]), joined(before[3], h2, idx, BASES[1])
        before = (r["conv_id"], idx, h1, h2, part)
    if not any(p in firsts and firsts[p] == c[0] for p, c in carry.items()):
        return local.drop("p1", "p2")
    # One row for each partition at most.
    kind = local.schema["conv_id"].dataType.simpleString()
    rows = [(p, *carry.get(p, (None, 0, 0, 0))[:4], p in carry, p in follow) for p in sorted({*carry, *follow})]
    from_before = spark.createDataFrame(rows, f"part long, b_conv {kind}, b_idx long, b_h1 long, b_h2 long, b_any boolean, follows boolean")
    both = local.join(F.broadcast(from_before), "part", "left")
    mine = F.col("head") & F.coalesce("b_any", F.lit(False)) & F.equal_null("conv_id", "b_conv")
    # Products of two numbers below 2**61 have 37 digits at most.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    whole = lambda k: F.pmod(wide(f"b_h{k}") * wide(f"p{k}") + wide(f"h{k}"), F.lit(PRIME).cast("decimal(19,0)")).cast("long")
    return both.withColumns({
        "idx": F.when(mine, F.col("idx") + F.col("b_idx")).otherwise(F.col("idx")),
        "h1": F.when(mine, whole(1)).otherwise(F.col("h1")),
        "h2": F.when(mine, whole(2)).otherwise(F.col("h2")),
        "more": F.col("more") | (F.col("edge") & F.coalesce("follows", F.lit(False))),
    }).select([c for c in local.columns if c not in ("p1", "p2")])


def maximal(hashed: DataFrame) -> DataFrame:
    """The ids of the conversations that no longer one begins with; of equal ones the least id stays."""
    whole = hashed.groupBy("conv_id").agg(F.max("idx").alias("idx")).select("conv_id", "idx")
    last = hashed.where(~F.col("more") & ~F.col("repeat")).join(whole, [F.equal_null(hashed["conv_id"], whole["conv_id"]), hashed["idx"] == whole["idx"]], "left_semi")
    key = ["idx", "h1", "h2"]
    kept = last.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    longer = hashed.where("more and not repeat").select(*key).distinct()
    return kept.join(longer, key, "left_anti").select("conv_id", F.col("idx").alias("n_turns"))


def render(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations in parts of at most ``part_turns`` turns.

    Turns are put in order of ``turn``, null first; equal turn numbers in an order fixed by role and text.  Rows that
    repeat another are one turn.  A null role is ``unknown``, a null text is empty; rows without a conversation id make
    up one conversation.  Other columns are ignored, whatever their names.  An empty table gives no rows.
    """
    hashed = prefix_hashes(conversations.select("conv_id", "turn", "role", "text"))
    keep = maximal(hashed).withColumnRenamed("conv_id", "_keep")
    turn = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = hashed.where("not repeat").join(keep, F.equal_null(F.col("conv_id"), F.col("_keep")))
    return (
        rows.select("conv_id", "n_turns", F.expr(f"(idx - 1) div {part_turns}").alias("part"), "idx", turn.alias("line"))
        .groupBy("conv_id", "n_turns", "part")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("lines"))
        .select("conv_id", "part", "n_turns", F.expr("array_join(transform(lines, x -> x.line), '')").alias("text"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, role, text FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
line AS (SELECT *, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line,
         sha256(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1))) AS x FROM t),
p AS (SELECT *, string_agg(x, ',') OVER (PARTITION BY conv_id ORDER BY idx) AS prefix, max(idx) OVER (PARTITION BY conv_id) AS n_turns FROM line),
whole AS (SELECT min(conv_id) AS conv_id, prefix FROM p WHERE idx = n_turns GROUP BY prefix),
kept AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE idx < n_turns))
SELECT conv_id, (idx - 1) // {PART_TURNS} AS part, n_turns, string_agg(line, '' ORDER BY idx) AS text
FROM p WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id, (idx - 1) // {PART_TURNS}, n_turns
"""
