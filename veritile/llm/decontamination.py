"""Benchmark decontamination by pigeonhole edit matching.

A test item of m letters may differ from a passage in k edits, a tenth of m.  It is split into k + 1 pieces; wherever
the item occurs with at most k edits, one piece at least occurs unchanged.  An automaton finds all exact piece hits in
one pass over a whole document.  Hits on neighbouring diagonals make one window.  An edit spoils at most one of the
item's five-letter strings that follow each other, so a window without more of them than the budget cannot hold the item;
the others are verified by Myers' bit-parallel edit distance.

The items are the stated query set.  They are compiled in blocks of a fixed size, so what is shipped at once and what a
task holds are bounded, and every block runs over all documents.  Documents are not shuffled; where there are several
blocks they are written between them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritile.llm.common import discard, inward, materialize, outward, place, table

#: Letters of an item for each edit that it may have; letters of the items of a block.
LETTERS_AN_EDIT, BLOCK_LETTERS = 10, 4_000_000
GRAM = 5
HITS = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("allowed", T.IntegerType()), T.StructField("end", T.LongType())]))


def normalized(text: str | None) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any stretch of ``text``, and the end of the first such stretch."""
    m = len(pattern)
    if not m:
        return 0, 0
    at: dict[str, int] = defaultdict(int)
    for k, ch in enumerate(pattern):
        at[ch] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for k, ch in enumerate(text, 1):
        eq = at.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, k
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
    return best, end


class Item(NamedTuple):
    id: int
    text: str
    allowed: int
    grams: list[str]


def budget(text: str) -> int:
    """Edits that an item may have: one for each ten letters, whatever its length."""
    return len(text) // LETTERS_AN_EDIT


class Block:
    """Items and the automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [Item(i, t, budget(t), [t[k : k + GRAM] for k in range(0, len(t) - GRAM + 1, GRAM)]) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, item in enumerate(self.items):
            k = item.allowed + 1
            cuts = [len(item.text) * j // k for j in range(k + 1)]
            for lo, hi in zip(cuts, cuts[1:]):
                where[item.text[lo:hi]].append((n, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, allowed, end) of the best passage of each item within its budget."""
        t = normalized(text)
        diagonals: dict[int, set[int]] = defaultdict(set)
        if len(self.automaton):
            for end, (size, places) in self.automaton.iter(t):
                for n, lo in places:
                    diagonals[n].add(end + 1 - size - lo)
        out = []
        for n, found in diagonals.items():
            item = self.items[n]
            best: tuple[int, int] | None = None
            for lo, hi in _windows(sorted(found), len(item.text), item.allowed, len(t)):
                window = t[lo:hi]
                at = window.find(item.text)
                if at >= 0:
                    best = (0, lo + at + len(item.text))
                    break
                if not item.allowed:
                    continue
                if _spoiled(item.grams, window, item.allowed):
                    continue
                distance, end = myers(item.text, window)
                if distance <= item.allowed and (best is None or distance < best[0]):
                    best = (distance, lo + end)
            if best:
                out.append((item.id, best[0], item.allowed, best[1]))
        return sorted(out)


def _spoiled(grams: list[str], window: str, allowed: int) -> bool:
    """Whether more strings than ``allowed`` are missing."""
    missing = 0
    for g in grams:
        if g not in window:
            missing += 1
            if missing > allowed:
                return True
    return False


def _windows(diagonals: list[int], m: int, k: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches that hold every passage of an item on one of the diagonals; overlapping ones are joined."""
    lo = hi = None
    for d in diagonals:
        a, b = max(0, d - k), min(size, d + m + k)
        if hi is not None and a <= hi - m:
            hi = b
        else:
            if hi is not None:
                yield lo, hi
            lo, hi = a, b
    if hi is not None:
        yield lo, hi


def item_blocks(items: DataFrame, id_col: str, text_col: str, letters: int = BLOCK_LETTERS) -> Iterator[list[tuple[int, str]]]:
    """Normalized items in blocks of about ``letters`` letters; null and blank items are left out, equal rows are one."""
    block, size = [], 0
    for i, text in items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).distinct().orderBy(id_col, text_col).toLocalIterator():
        t = normalized(text)
        if t:
            block.append((i, t))
            size += len(t)
        if size >= letters:
            yield block
            block, size = [], 0
    if block:
        yield block


_compiled: dict[int, tuple[list, Block]] = {}


def _block(items: list[tuple[int, str]]) -> Block:
    """The compiled block, kept by a worker as long as the same one is asked for."""
    key = hash(tuple(items))
    if key not in _compiled or _compiled[key][0] != items:
        _compiled.clear()
        _compiled[key] = items, Block(items)
    return _compiled[key][1]


def annotate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", hits_col: str = "hits", letters: int = BLOCK_LETTERS) -> DataFrame:
    """``docs`` with an array of (item, distance, allowed, end) added; ``end`` counts letters of the normalized text.

    Null and empty texts have no hit, and neither have blank items; repeated rows get equal hits; whole texts are
    searched, of any length.  Items of under ten letters must occur unchanged.  An empty table gives no rows; without
    items no row has a hit.  Other columns pass through, whatever their names; a column named like ``hits_col`` is
    replaced.
    """
    out = inward(docs).withColumn(hits_col, F.array().cast(HITS))
    schema, at, to = out.schema, out.columns.index(place(docs, text_col)), len(out.columns) - 1
    before: DataFrame | None = None
    for number, block in enumerate(item_blocks(items, item_id, item_text, letters)):
        if number:
            # Written between blocks, so that a task holds one block's automaton at a time.
            written = materialize(out, "hits")
            if before is not None:
                discard(before)
            out = before = written

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            found = _block(block)
            for b in batches:
                hits = [
                    [*had, *({"item": i, "distance": d, "allowed": k, "end": e} for i, d, k, e in found.hits(t))]
                    for t, had in zip(b.column(at).to_pylist(), b.column(to).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[:to], pa.array(hits, b.schema.field(to).type)], names=b.schema.names)

        out = out.mapInArrow(run, schema)
    return outward(out, docs, (hits_col,))


def clean_stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline form: documents that hold a passage of an item go; the columns stay as they are."""
    out = annotate(inward(docs), items, place(docs, "text"))
    return outward(out.where(F.size("hits") == 0), docs)


def query(spark, sf_dir: str) -> DataFrame:
    hits = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", F.col("h.item").alias("item_id"), "h.distance", "h.allowed", F.col("h.end").alias("passage_end"))
