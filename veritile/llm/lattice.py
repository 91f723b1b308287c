"""Subword lattice likelihood: log probabilities of whole texts under a unigram model of pieces.

The pieces are those of an existing public vocabulary, and each word of the training rows is one more.  A word, with the
mark of its start, is a lattice of all its segmentations: one arc for the word itself if training rows have it, and the
segmentations into subword pieces.  Its probability is the sum over all of them, by a forward recursion in log space
over the whole word, however long.  No piece crosses a word, so a text's probability is the product over its words, then
one end.

The vocabulary orders its pieces by rank; by Zipf's law these ranks are scores to begin with.  They are fitted to the
corpus by expectation maximization: expected counts over all segmentations of all distinct training words, in each
round.  Pieces with the start mark sum to one, and so do the other pieces together with the stop that ends a word.  A
whole word's arc has its count less a discount; what the discounts free goes to the subword lattice.

Counting and scoring work on distinct words.  A text's sums are made where the text is: the scores of the most frequent
words, a bounded number, go to every task; the rarer words are shuffled by their hash, where none has more than a small
share of the rows, as it is not among the frequent ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritile.llm.common import discard, heaviest, materialize, table

VOCABULARY, START = "piece_bpe_32k.model", "▁"
#: Rounds of expectation maximization over all words; added to each piece's expected count; words at most whose scores go to every task.
ROUNDS, PRIOR, FREQUENT = 3, 0.01, 131_072
#: Ranks are shifted by so much before they become weights; a letter that no piece has is one of so many.
SHIFT, LETTERS = 2.7, 1_114_112
#: Words of more letters are swept one by one, in blocks of so many letters; letters of the words of one lattice.
LONG, LONG_BLOCK, LATTICE = 512, 65_536, 1 << 18
#: Words of more bytes are named by their hash among the frequent ones.
LONGEST_KEY = 64
#: Distinct words that a task counts before it passes them on; tokens of a step of scoring.
HELD, STEP = 1 << 18, 1 << 17
_OUTSIDE = 0x110000  # no letter


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Trie:
    """The pieces as states and transitions; transitions are looked up for many places at once, by open addressing."""

    def __init__(self, pieces: list[str]):
        edges: dict[int, int] = {}
        ends = [-1]
        for k, p in enumerate(pieces):
            state = 0
            for ch in p:
                to = edges.setdefault(state << 21 | ord(ch), len(ends))
                if to == len(ends):
                    ends.append(-1)
                state = to
            ends[state] = k
        self.ends = np.array(ends, np.int32)
        bits = len(edges).bit_length() + 2
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.to = np.full(1 << bits, -1, np.int32)
        keys, to = np.fromiter(edges, np.uint64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges))
        for key, slot, state in zip(keys, self._slots(keys).tolist(), to):
            while self.to[slot] >= 0:
                slot = (slot + 1) & int(self.mask)
            self.keys[slot], self.to[slot] = key, state

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        key = state.astype(np.uint64) << np.uint64(21) | letter
        slot = self._slots(key)
        out = self.to[slot]
        there = self.keys[slot]
        todo = np.nonzero(there != key)[0]
        while len(todo):
            out[todo] = -1
            todo = todo[self.to[slot[todo]] >= 0]  # an empty place ends the search
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            hit = self.keys[slot[todo]] == key[todo]
            out[todo[hit]] = self.to[slot[todo[hit]]]
            todo = todo[~hit]
        return out


class Vocabulary(NamedTuple):
    pieces: list[str]
    #: Ranks of the pieces, and their lengths with that of an unknown letter.
    ranks: np.ndarray
    lengths: np.ndarray
    trie: Trie


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """The pieces without control and byte pieces and without those that span words."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)) and START not in sp.id_to_piece(k)[1:]]
    pieces = [sp.id_to_piece(k) for k in plain]
    return Vocabulary(pieces, np.array([-sp.get_score(k) for k in plain]), np.array([*map(len, pieces), 1]), Trie(pieces))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _arcs(voc: Vocabulary, letter: np.ndarray, begin: np.ndarray, after) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of all arcs from the places ``begin``; ``after(k, n)``: the place n letters after ``begin[k]``.

    A letter that is no piece is an arc of the unknown piece, whose number is the size of the vocabulary.
    """
    alive, state, at, n = np.arange(len(begin)), np.zeros(len(begin), np.int32), begin, 0
    single = np.zeros(len(begin), bool)
    found = []
    while len(alive):
        state = voc.trie.step(state, letter[at])
        go = state >= 0
        alive, state, n = alive[go], state[go], n + 1
        at = after(alive, n)
        piece = voc.trie.ends[state]
        is_piece = piece >= 0
        found.append((begin[alive[is_piece]], at[is_piece], piece[is_piece]))
        if n == 1:
            single[alive[is_piece]] = True
    lone = np.nonzero(~single)[0]
    found.append((begin[lone], after(lone, 1), np.full(len(lone), len(voc.pieces), np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found))


class Lattice:
    """The arcs of the lattices of many words, level by level.

    A word of n letters, its start mark among them, has n + 1 places.  Words are put in falling order of length and
    places in order of the letters before them, so the places of a level are one stretch.
    """

    def __init__(self, words: list[str], path: str):
        voc = vocabulary(path)
        marked = [START + w for w in words]
        lengths = np.array([len(w) for w in marked], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        flat, first = _letters("".join(marked)), (np.cumsum(lengths) - lengths)[self.order]
        lengths = lengths[self.order]
        self.levels = int(lengths[0]) if len(words) else 0
        count = np.searchsorted(-lengths, -np.arange(self.levels + 1), "right")
        self.base = np.concatenate([[0], np.cumsum(count)])
        level = np.repeat(np.arange(self.levels + 1), count)
        word = np.arange(self.base[-1]) - self.base[level]
        inner = level < lengths[word]
        letter = np.full(len(level), _OUTSIDE, np.uint64)
        letter[inner] = flat[first[word[inner]] + level[inner]]
        begin = np.nonzero(inner)[0]
        ahead, own = level[begin], word[begin]
        self.start, self.end, self.piece = _arcs(voc, letter, begin, lambda k, n: self.base[ahead[k] + n] + own[k])
        self.last = self.base[lengths] + np.arange(len(words))
        self.word = word
        #: By end: all places but the first; by start: all but the last ones.
        self.by_end = self._sweep(self.end)
        self.by_start = self._sweep(self.start)

    def _sweep(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs in order of ``at``; the places; where the arcs of each begin; where the places of each level begin."""
        order = np.argsort(at)
        cuts = np.nonzero(np.diff(at[order], prepend=-1))[0]
        places = at[order][cuts]
        return order, places, np.append(cuts, len(at)), np.searchsorted(places, self.base)

    def _sums(self, begin: np.ndarray, sweep: tuple, other: np.ndarray, score: np.ndarray, levels: range) -> np.ndarray:
        order, places, cuts, starts = sweep
        a = np.zeros(self.base[-1])
        other, each = other[order], score[self.piece[order]]
        for k in levels:
            lo, hi = starts[k], starts[k + 1]
            if lo == hi:
                continue
            part = slice(cuts[lo], cuts[hi])
            at = cuts[lo:hi] - cuts[lo]
            x = a[other[part]] + each[part]
            top = np.maximum.reduceat(x, at)
            x -= np.repeat(top, np.diff(cuts[lo : hi + 1]))
            a[places[lo:hi]] = top + np.log(np.add.reduceat(np.exp(x, out=x), at))
        return a

    def forward(self, score: np.ndarray) -> np.ndarray:
        """The log of the summed probability of all segmentations up to each place."""
        return self._sums(self.base[:1], self.by_end, self.start, score, range(1, self.levels + 1))

    def likelihood(self, score: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order))
        out[self.order] = self.forward(score)[self.last] + score[-1]
        return out

    def expected(self, score: np.ndarray) -> np.ndarray:
        """The expected number of uses of each piece and of the stop, over all words."""
        ahead = self.forward(score)
        behind = self._sums(self.last, self.by_start, self.end, score, range(self.levels - 1, -1, -1))
        use = np.exp(ahead[self.start] + score[self.piece] + behind[self.end] - ahead[self.last][self.word[self.start]])
        uses = np.bincount(self.piece, use, len(score))
        uses[-1] = len(self.order)
        return uses


class LongWord:
    """The same sums for one long word, in blocks, so that only the sums at its places are held whole."""

    def __init__(self, word: str, path: str):
        self.voc = vocabulary(path)
        self.letter = np.append(_letters(START + word), np.uint64(_OUTSIDE))
        self.n, self.reach = len(self.letter) - 1, int(self.voc.lengths.max())

    def _block(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs that begin from ``lo`` to before ``hi``."""
        end = min(self.n, hi + self.reach)
        start, to, piece = _arcs(self.voc, np.append(self.letter[lo:end], np.uint64(_OUTSIDE)), np.arange(hi - lo), lambda k, n: k + n)
        return start + lo, to + lo, piece

    def forward(self, score: np.ndarray) -> np.ndarray:
        a = np.full(self.n + 1, -np.inf)
        a[0] = 0.0
        for lo in range(0, self.n, LONG_BLOCK):
            hi = min(self.n, lo + LONG_BLOCK)
            start, end, piece = self._block(max(0, lo - self.reach), hi)
            mine = (end > lo) & (end <= hi)
            self._fill(a, start[mine], end[mine], score[piece[mine]], range(lo + 1, hi + 1))
        return a

    def _behind(self, score: np.ndarray) -> np.ndarray:
        b = np.full(self.n + 1, -np.inf)
        b[self.n] = 0.0
        for lo in range((self.n - 1) // LONG_BLOCK * LONG_BLOCK, -1, -LONG_BLOCK):
            hi = min(self.n, lo + LONG_BLOCK)
            start, end, piece = self._block(lo, hi)
            self._fill(b, end, start, score[piece], range(hi - 1, lo - 1, -1))
        return b

    @staticmethod
    def _fill(a: np.ndarray, other: np.ndarray, at: np.ndarray, score: np.ndarray, places: range) -> None:
        """Sums at ``places``, one after the other, from arcs between ``other`` and ``at``."""
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(min(places), max(places) + 2)).tolist()
        base = min(places)
        least = min(int(other.min()), base)
        held = a[least : max(int(other.max()), max(places)) + 1].tolist()
        others, scores = (other[order] - least).tolist(), score[order].tolist()
        exp, log = math.exp, math.log
        for p in places:
            x = [held[others[j]] + scores[j] for j in range(first[p - base], first[p - base + 1])]
            top = max(x)
            held[p - least] = top if len(x) == 1 else top + log(sum(exp(v - top) for v in x))
        lo, hi = min(places), max(places) + 1
        a[lo:hi] = held[lo - least : hi - least]

    def likelihood(self, score: np.ndarray) -> float:
        return float(self.forward(score)[self.n] + score[-1])

    def expected(self, score: np.ndarray) -> np.ndarray:
        ahead, behind = self.forward(score), self._behind(score)
        uses = np.zeros(len(score))
        for lo in range(0, self.n, LONG_BLOCK):
            start, end, piece = self._block(lo, min(self.n, lo + LONG_BLOCK))
            uses += np.bincount(piece, np.exp(ahead[start] + score[piece] + behind[end] - ahead[self.n]), len(score))
        uses[-1] += 1
        return uses


def _dealt(words: list[str]) -> Iterator[np.ndarray]:
    """Numbers of the words that are swept together: long ones alone, the others by length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for k in np.nonzero(lengths > LONG)[0]:
        yield np.array([k])
    short = np.nonzero(lengths <= LONG)[0]
    short = short[np.argsort(lengths[short], kind="stable")]
    block = (np.cumsum(lengths[short] + 2) - 1) // LATTICE
    yield from np.split(short, np.nonzero(np.diff(block))[0] + 1) if len(short) else ()


def likelihoods(words: list[str], score: np.ndarray, path: str) -> np.ndarray:
    """The natural log of the summed probability of each word."""
    out = np.empty(len(words))
    for k in _dealt(words):
        part = [words[j] for j in k]
        out[k] = LongWord(part[0], path).likelihood(score) if len(part[0]) > LONG else Lattice(part, path).likelihood(score)
    return out


def expected_uses(words: list[str], score: np.ndarray, path: str) -> np.ndarray:
    out = np.zeros(len(score))
    for k in _dealt(words):
        part = [words[j] for j in k]
        out += (LongWord(part[0], path) if len(part[0]) > LONG else Lattice(part, path)).expected(score)
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the checksum of the id as text leaves 1 when divided by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def _raw(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogateescape")


def word_counts(docs: DataFrame, text_col: str, held: Column) -> DataFrame:
    """(word, c, n): each distinct word, as bytes, with its count in training rows and in all rows.

    A task counts what it reads and passes its counts on whenever it holds ``HELD`` words, so its memory is bounded.
    """

    def rows(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for own, is_held in zip(counts, (False, True)):
            if own:
                n = pa.array(np.fromiter(own.values(), np.int64, len(own)))
                c = pa.array(np.zeros(len(own), np.int64)) if is_held else n
                whole = pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), c, n], names=["word", "c", "n"])
                yield from (whole.slice(k, 65_536) for k in range(0, len(own), 65_536))
                own.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for b in batches:
            for is_held, text in zip(b.column(0).to_pylist(), b.column(1)):
                # bytes.lower() and bytes.split() touch A-Z and \x20\x09-\x0D only.
                counts[is_held].update(text.as_py().lower().split())
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield from rows(counts)
        yield from rows(counts)

    part = docs.select(held.alias("held"), _raw(text_col).alias("raw")).mapInArrow(run, "word binary, c long, n long")
    return part.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def expected_counts(counted: DataFrame, score: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of the pieces over all distinct training words; a task gives a row for each piece at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(score))
        for b in batches:
            total += expected_uses([_text(w) for w in b.column(0).to_pylist()], score, path)
        k = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["piece", "uses"])

    words = counted.where("c > 0").select(F.col("word").cast("binary"))
    got = words.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
    out = np.zeros(len(score))
    for r in got:
        out[r["piece"]] = r["uses"]
    return out


def _normalized(uses: np.ndarray, path: str) -> np.ndarray:
    """Natural-log scores from expected uses."""
    pieces = vocabulary(path).pieces
    opens = np.zeros(len(uses), bool)
    opens[: len(pieces)] = [p.startswith(START) for p in pieces]
    p = uses + PRIOR
    p[opens] /= p[opens].sum()
    p[~opens] /= p[~opens].sum()
    p[-2] /= LETTERS
    return np.log(p)


def vocabulary_scores(path: str) -> np.ndarray:
    """Natural-log scores from the vocabulary alone: a piece weighs one by its rank; the unknown letter and the stop weigh little."""
    weights = 1 / (vocabulary(path).ranks + SHIFT)
    return _normalized(np.concatenate([weights, [weights.min(), weights.max()]]) * len(weights), path)


def fit(counted: DataFrame, rounds: int = ROUNDS, path: str | None = None) -> np.ndarray:
    """Natural-log scores of the pieces, of an unknown letter and of the stop; every round is over all training words."""
    path = path or vocabulary_path()
    score = vocabulary_scores(path)
    for _ in range(rounds):
        score = _normalized(expected_counts(counted, score, path), path)
    return score


def _digests(words: list[bytes]) -> np.ndarray:
    """128 bits of hash of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2)


def _keys(words: list[bytes]) -> list[bytes]:
    return [w if len(w) <= LONGEST_KEY else xxhash.xxh3_128_digest(w) for w in words]


def word_scores(counted: DataFrame, score: np.ndarray, tokens: int, types: int, discount: float, freed: float, path: str | None = None) -> DataFrame:
    """(key, h, g, n, k, base, lp): a word's name, its hash and count, whether it is known, its base score, and the log10
    of its probability, summed over all its segmentations.

    The arc of a whole word weighs (c - discount) / tokens, the subword lattice weighs ``freed``.
    """
    path = path or vocabulary_path()
    floor = math.log10(tokens + 0.5 * (types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            if not words:
                continue
            sub = likelihoods([_text(w) for w in words], score, path)
            whole = np.maximum(c - discount, 0) / max(1, tokens)
            with np.errstate(divide="ignore"):
                lp = np.logaddexp(np.log(whole), sub + math.log(freed)) / math.log(10)
            d = _digests(words)
            cols = [pa.array(_keys(words), pa.binary()), *(pa.array(x) for x in (d[:, 0].copy(), d[:, 1].astype(np.int32))), b.column(2), *(pa.array(x) for x in ((c > 0).astype(np.int64), np.log10(c + 0.5) - floor, lp))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "h", "g", "n", "k", "base", "lp"])

    return counted.select("word", "c", "n").mapInArrow(run, "key binary, h long, g int, n long, k long, base double, lp double")


def near_sums(docs: DataFrame, id_col: str, text_col: str, held: Column, top: list) -> DataFrame:
    """A row for each row of ``docs``: id, held_out, n (tokens), k, base and lp summed over frequent words, and the hashes of the other words."""
    number = {bytes(r["key"]): j for j, r in enumerate(top)}
    sums = np.array([[r["k"], r["base"], r["lp"]] for r in top] + [[0.0, 0.0, 0.0]]).T.copy()
    name = docs.schema[id_col].name
    rare_type = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.IntegerType())]))
    fields = [("held_out", T.BooleanType()), ("n", T.LongType()), ("k", T.LongType()), ("base", T.DoubleType()), ("lp", T.DoubleType()), ("rare", rare_type)]
    schema = T.StructType([T.StructField("id", docs.schema[name].dataType), *(T.StructField(*f) for f in fields)])

    def step(ids: pa.Array, is_held: pa.Array, words: list[bytes], n: list[int]) -> pa.RecordBatch:
        lengths = np.array(n, np.int64)
        doc = np.repeat(np.arange(len(n)), lengths)
        j = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
        k, base, lp = (np.bincount(doc, s[j], len(n)) for s in sums)
        far = np.nonzero(j < 0)[0]
        d = _digests([words[x] for x in far])
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc[far], minlength=len(n)))]).astype(np.int32)
        rare = pa.StructArray.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].astype(np.int32))], names=["h", "g"])
        cols = [ids, is_held, pa.array(lengths), pa.array(k.astype(np.int64)), pa.array(base), pa.array(lp), pa.ListArray.from_arrays(pa.array(ends), rare)]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, words, n = 0, [], []
            for at, text in enumerate(b.column(2), 1):
                own = text.as_py().lower().split()
                words += own
                n.append(len(own))
                if len(words) > STEP or at == b.num_rows:
                    yield step(b.column(0).slice(lo, at - lo), b.column(1).slice(lo, at - lo), words, n)
                    lo, words, n = at, [], []

    return docs.select(F.col(name).alias("id"), held.alias("held_out"), _raw(text_col).alias("raw")).mapInArrow(run, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, frequent: int = FREQUENT, path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z lower-cased, then one end.  A null or empty text is the end alone.  Rows with a null id
    are for training.  Repeated rows are counted and scored as often as they occur.  Words of any length are one
    lattice each.  Without training rows every word's base count is zero, and an empty table gives no rows.  Other
    columns are ignored, whatever their names.
    """
    held = held_out(id_col)
    counted = materialize(word_counts(docs, text_col, held), "words")
    totals = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    ends = docs.agg(F.count_if(~held).alias("e")).first()["e"]
    n, v = (totals["n"] or 0) + ends, totals["v"] + (1 if ends else 0)
    score = fit(counted, rounds, path)
    # The usual estimate of an absolute discount, from the words that occur once and twice.
    discount = min(0.95, max(0.1, totals["once"] / max(1, totals["once"] + 2 * totals["twice"])))
    freed = discount * v / n if n else 1.0
    scored = materialize(word_scores(counted, score, n, v, discount, freed, path), "scores")
    # At most ``frequent`` short rows.
    top = heaviest(scored, "n", frequent).select("key", "k", "base", "lp").collect()
    # The numbers of the rows are written with them, so a task that runs again meets the same ones.
    marked = materialize(near_sums(docs, id_col, text_col, held, top).withColumn("row", F.monotonically_increasing_id()), "near")
    discard(counted)
    rare = marked.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.g")
    sums = ("k", "base", "lp")
    far = rare.join(scored.select("h", "g", *sums), ["h", "g"]).groupBy("row").agg(*[F.sum(c).alias(f"far_{c}") for c in sums])
    both = {c: F.col(c) + F.coalesce(f"far_{c}", F.lit(0)) for c in sums}
    end_base = math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
    end_lp = math.log10((ends - discount) / n if ends else 0.5 / (n + 1))
    return marked.drop("rare").join(far, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        (F.col("n") + 1).alias("n_tokens"),
        (both["k"] + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (both["base"] + F.lit(end_base)).alias("base_score"),
        (both["lp"] + F.lit(end_lp)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
