"""Token counts by a deterministic transducer compiled from a byte-pair vocabulary with word ends.

The machine reads one character at a time, and each transition says by how much the count of emitted tokens changes.

*Split states* follow the splitting pattern: letters run together, a number is a word of its own, other marks run
together, and an apostrophe where a word starts may open a contraction, which two or three states look ahead for.

*Merge states* count the tokens of a word.  For each prefix of a word, its last token is the only one that is compatible
with the last token of what stands before it; two tokens are compatible if merging their joined letters gives them
back.  So a state needs, for each earlier position from which the rest can still begin a token, the last token there
and its count relative to the count here.  Words with the same such rows share a state, so the machine is the minimal
one that the rows allow; it is determinized as texts reach new states, and every state's transitions are kept.  A white
space, or whatever else ends a word, emits the difference to the count of the finished word.

*Words.*  A white space leads every state to the start state, so a word between white space is a path from the start state
to itself with a fixed count.  The machine keeps these paths as transitions too, so a common word costs one step.

*Chunks.*  A text is read in chunks, and a chunk gives a map: for each state that its left border can be in, the state at
its right border and the count.  After a white space the state at the right border is the same whatever the left one
is, so the left border of most chunks can be in one state only.  Maps compose associatively, by look-up and without a
character of the text, in a parallel prefix scan of log2(n) rounds; the last prefix, at the start state, is the count.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritile.llm.common import inward, outward, place, table

VOCABULARY, LIMIT, CHUNK = "word_bpe_49k.json", 2048, 16384
#: States, and words with their counts, beyond which a worker drops its tables and compiles anew; they bound memory, never results.
MOST_STATES, MOST_WORDS = 250_000, 400_000
#: Letters of a word that is kept, and letters between two looks at the number of states.
KEPT_LETTERS, BLOCK = 32, 4096
#: Python alone counts these four separators as white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile(r"[^\S\x1c-\x1f]")
_LETTER, _NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
#: Fixed values of the splitting pattern: what may follow an apostrophe at the start of a word, in one or two letters.
CONTRACTED, CONTRACTED_TWO = "stmd", {"r": "e", "v": "e", "l": "l"}


class State(dict):
    """A state: characters to (state, change of the count).  Missing transitions are compiled when first taken."""

    __slots__ = ("kind", "machine", "rows")

    def __init__(self, machine: Machine, kind: str, rows: tuple):
        self.machine, self.kind, self.rows = machine, kind, rows

    def __missing__(self, ch: str):
        self[ch] = to = self.machine.step(self, ch)
        return to

    @property
    def key(self) -> tuple:
        return self.kind, self.rows


class Words(dict):
    """Words to the counts of their paths from the start state to the start state."""

    __slots__ = ("machine",)

    def __init__(self, machine: Machine):
        self.machine = machine

    def __missing__(self, word: str) -> int:
        m = self.machine
        s, n = m.run(m.start, word)
        n += m.close(s)
        if len(word) <= KEPT_LETTERS:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = n
        return n


class Machine:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        model = model["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.end = model["end_of_word_suffix"]
        self.letter = _byte_letters()
        self.tokens = set(model["vocab"])
        # What can begin a token, with and without the word end.
        self.begins = {t[:k] for t in (t.removesuffix(self.end) for t in self.tokens) for k in range(1, len(t) + 1)}
        self.words = Words(self)
        self.clear()

    def clear(self) -> None:
        self.joined: dict[tuple[str, str], bool] = {}
        self.shared: dict[tuple, tuple] = {}  # rows that states have in common are stored once
        self.states: dict[tuple, State] = {}
        self.start = self.state("start", ())

    def state(self, kind: str, rows: tuple) -> State:
        found = self.states.get((kind, rows))
        if found is None:
            found = self.states[kind, rows] = State(self, kind, rows)
        return found

    # Merging -------------------------------------------------------------------------------------------------------

    def merged(self, parts: list[str]) -> list[str]:
        """Byte-pair merging as the vocabulary defines it: the best rank first, from the left."""
        rank, none = self.rank, len(self.rank)
        while len(parts) > 1:
            best = min((rank.get(p, none) for p in zip(parts, parts[1:])), default=none)
            if best == none:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and rank.get((parts[k], parts[k + 1])) == best:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _letters(self, token: str) -> list[str]:
        if token.endswith(self.end):
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def compatible(self, a: str, b: str) -> bool:
        known = self.joined.get((a, b))
        if known is None:
            known = self.merged(self._letters(a) + self._letters(b)) == [a, b] if a else self.merged(self._letters(b)) == [b]
            self.joined[a, b] = known
        return known

    def last(self, rows: tuple, end: str = "") -> tuple[str, int]:
        """The last token, and the count, of the word that ``rows`` lead to."""
        for rest, token, count in rows:
            t = rest + end
            if t in self.tokens and self.compatible(token, t):
                return t, count + 1
        raise ValueError("no segmentation")

    def read(self, rows: tuple, ch: str) -> tuple[tuple, int]:
        """The rows (rest, last token before it, count before it) after one more character, and the change of the count.

        Counts are relative to the count of the word so far.
        """
        change = 0
        for byte in ch.encode("utf-8", "surrogatepass"):
            letter = self.letter[byte]
            rows = tuple((rest + letter, token, count) for rest, token, count in rows if rest + letter in self.begins)
            token, count = self.last(rows)
            change += count
            rows = (*((r, t, c - count) for r, t, c in rows), ("", token, 0))
        shared = self.shared
        return tuple(shared.setdefault(r, r) for r in rows), change

    def finish(self, rows: tuple) -> int:
        return self.last(tuple(r for r in rows if r[0]), self.end)[1]

    def word(self, text: str) -> int:
        """Tokens of a whole word."""
        rows, n = self.read((("", "", 0),), text)
        return n + self.finish(rows)

    # Splitting -----------------------------------------------------------------------------------------------------

    def step(self, s: State, ch: str) -> tuple[State, int]:
        kind, rows = s.kind, s.rows
        is_ = _class(ch)
        if kind in ("letters", "marks"):
            if is_ == kind:
                rows, change = self.read(rows, ch)
                return self.state(kind, rows), change
            to, change = self.begin(is_, ch)
            return to, change + self.finish(rows)
        if kind == "start":
            return self.begin(is_, ch)
        if kind == "'":
            if ch in CONTRACTED:
                return self.start, self.word("'" + ch)
            if ch in CONTRACTED_TWO:
                return self.state("'" + ch, ()), 0
            if is_ == "marks":  # the apostrophe was the first of a run of marks
                rows, n = self.read((("", "", 0),), "'")
                rows, more = self.read(rows, ch)
                return self.state("marks", rows), n + more
            to, change = self.begin(is_, ch)
            return to, change + self.word("'")
        # An apostrophe and the first of two letters.
        if CONTRACTED_TWO[kind[1]] == ch:
            return self.start, self.word(kind + ch)
        first, n = self.begin("letters", kind[1])
        to, change = first[ch]
        return to, self.word("'") + n + change

    def begin(self, is_: str, ch: str) -> tuple[State, int]:
        if is_ == "space":
            return self.start, 0
        if is_ == "number":
            return self.start, self.word(ch)
        if ch == "'":
            return self.state("'", ()), 0
        rows, change = self.read((("", "", 0),), ch)
        return self.state(is_, rows), change

    def close(self, s: State) -> int:
        """What the end of the text emits."""
        return s[" "][1]

    def run(self, s: State, text: str) -> tuple[State, int]:
        n = 0
        for k in range(0, len(text), BLOCK):
            for ch in text[k : k + BLOCK]:
                s, c = s[ch]
                n += c
            if len(self.states) > MOST_STATES:
                self.clear()
                s = self.state(*s.key)
        return s, n


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stands for itself, the rest starts at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=65536)
def _class(ch: str) -> str:
    if ch.isspace() and ch not in SEPARATORS:
        return "space"
    return "letters" if _LETTER.match(ch) else "number" if _NUMBER.match(ch) else "marks"


#: A state's key to that of the state a chunk leads to, and the count.
ChunkMap = dict[tuple, tuple[tuple, int]]


def _split(text: str) -> list[str]:
    return text.split() if not any(c in text for c in SEPARATORS) else [w for w in _SPACE.split(text) if w]


def chunk_map(m: Machine, text: str, borders: set[tuple]) -> ChunkMap:
    """The map of a chunk on the states that its left border can be in."""
    space = _SPACE.search(text)
    if not space:
        runs = {key: m.run(m.state(*key), text) for key in borders}
        return {key: (to.key, n) for key, (to, n) in runs.items()}
    head, words = text[: space.end()], _split(text[space.end() :])
    tail = words.pop() if words and not _SPACE.match(text[-1]) else ""
    rest = sum(map(m.words.__getitem__, words))
    to, n = m.run(m.start, tail)
    end = to.key
    return {key: (end, m.run(m.state(*key), head)[1] + rest + n) for key in borders}


def chunk_maps(m: Machine, text: str, chunk: int) -> list[ChunkMap]:
    maps, borders = [], {m.start.key}
    for k in range(0, len(text), chunk):
        maps.append(chunk_map(m, text[k : k + chunk], borders))
        borders = {to for to, _ in maps[-1].values()}
    return maps


def compose(a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """First ``a``, then ``b``; associative."""
    return {s: (b[t][0], n + b[t][1]) for s, (t, n) in a.items()}


def prefix_scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """All prefix compositions, in log2(n) rounds whose compositions do not depend on each other."""
    step = 1
    while step < len(maps):
        maps = [compose(maps[k - step], x) if k >= step else x for k, x in enumerate(maps)]
        step *= 2
    return maps


def normalized(text: str) -> str:
    """Composed and lower-cased; lower-casing looks at no neighbours, so a final sigma stays a plain one."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def count_tokens(m: Machine, text: str | None, chunk: int = CHUNK) -> int:
    parts, n = [text or ""], 0
    for special in m.special:  # special strings are found in the raw text, and each is one token
        if special in (text or ""):
            n += sum(p.count(special) for p in parts)
            parts = [x for p in parts for x in p.split(special)]
    for part in map(normalized, parts):
        if len(part) <= chunk:
            n += sum(map(m.words.__getitem__, _split(part)))
        else:
            to, k = prefix_scan(chunk_maps(m, part, chunk))[-1][m.start.key]
            n += k + m.close(m.state(*to))
    return n


@lru_cache(maxsize=1)
def machine(path: str) -> Machine:
    return Machine(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` added, which replaces a column of that name.

    Whole texts are counted, of any length, with and without white space; a null or empty text has no token.  Repeated
    rows get equal counts; an empty table gives no rows; other columns pass through, whatever their names.
    """
    path = path or vocabulary_path()
    inner = inward(docs)
    schema = T.StructType([*inner.schema.fields, T.StructField("n_tokens", T.LongType())])
    at = inner.columns.index(place(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in batches:
            n = np.fromiter((count_tokens(m, t) for t in b.column(at).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], names=schema.names)

    return outward(inner.mapInArrow(run, schema), docs, ("n_tokens",))


def query(spark, sf_dir: str) -> DataFrame:
    out = counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
