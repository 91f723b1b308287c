"""Line-first cleaning with built-in expressions only; no shuffle.

Rules look at one line at a time: terminal punctuation, navigation, boilerplate, shouting and symbols.  Lines that fail
go, and a document that loses too much of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritile.llm.common import SPACE, SPACE_RUN, inward, outward, place, table

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 50
SYMBOLS = "#*$%&|<>"

# Phrases of site furniture, lower case.
BOILERPLATE = (
    "all rights reserved",
    "copyright ©",
    "cookie policy",
    "uses cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "enable javascript",
    "sign up for our newsletter",
    "subscribe to our",
    "click here to",
    "share on facebook",
    "share on twitter",
    "licensed under",
    "lorem ipsum",
)

#: A line ends a sentence if its last character is one of these.
TERMINAL = ".!?…\"'”’»)]:;。！？"


_CAPITAL, _SMALL = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"


def line_verdict(line: str, n_words: str, flags: tuple[str, str, str] = ("true", "true", "true")) -> str:
    """SQL for whether a trimmed line with a word, and so many words, stays.

    A line fails if it has four or more words and does not end like a sentence, if it has three bars or other menu
    separators or more, if it holds a boilerplate phrase, if more than three words in ten end in a run of symbols, if
    it repeats !!, or if nearly all its letters are capitals.

    ``flags`` are columns of the document that say whether some line can have marks, phrases or capitals at all; they
    save the search in each line and change no verdict.
    """
    marks, phrases, capitals = flags
    count = lambda pattern: f"regexp_count({line}, '{pattern}')"
    quoted = TERMINAL.replace("\\", "\\\\").replace("'", "\\'")
    return f"""(
        (instr('{quoted}', right({line}, 1)) > 0 or {n_words} < 4)
        and not ({marks} and ({count("[|»›•·]")} >= 3 or 10 * {count("[#*$%&]{2,}")} > 3 * {n_words} or 10 * {count("!!")} > 3 * {n_words}))
        and not ({phrases} and lower({line}) rlike '{"|".join(BOILERPLATE)}')
        and not ({capitals} and {n_words} >= 4 and 10 * {count(f"[{_CAPITAL}]")} > 6 * greatest({count(f"[{_CAPITAL}{_SMALL}]")}, 1))
    )"""


def _flags() -> tuple:
    """Whether a text has marks of the line rules, a boilerplate phrase, a capital."""
    low = F.lower("_text")
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(p))
    return F.col("_text").rlike("[|»›•·]|!!|[#*$%&]{2}"), phrase, F.col("_text").rlike(f"[{_CAPITAL}]")


def evaluate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    r"""``docs`` with the base counts, ``base_failed``, ``kept`` and ``clean_text`` added.

    A null text has no words and fails; an empty one too.  Any length is taken whole: the search for repeated windows
    sorts 64-bit hashes of a document's windows, so its cost is n log n.  Repeated rows get equal verdicts; an empty
    table gives no rows.  Other columns pass through, whatever their names; those named like an added one are replaced.
    """
    text = F.coalesce(F.col(place(docs, text_col)), F.lit(""))
    marks = inward(docs).withColumns({"_text": text, "_w": F.array_remove(F.split(text, SPACE_RUN), ""), "_lines": F.split(text, "\n")})
    marks = marks.withColumns({
        "_grams": F.expr("case when size(_w) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) end"),
        "_full": F.expr(f"filter(_lines, x -> btrim(x, '{_SPACE_SQL}') <> '')"),
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long"),
        **dict(zip(("_marks", "_phrases", "_capitals"), _flags())),
    })
    # Windows found twice stand side by side once sorted; the gaps between their places give the words they cover.
    marks = marks.withColumn(
        "_sorted", F.expr("case when size(array_distinct(_grams)) < size(_grams) then array_sort(transform(_grams, (g, i) -> struct(g as g, i as i))) else null end")
    )
    twice = "filter(_sorted, (x, k) -> get(_sorted, k - 1).g <=> x.g or get(_sorted, k + 1).g <=> x.g)"
    marks = marks.withColumn("_places", F.expr(f"case when _sorted is null then null else array_sort(transform({twice}, x -> x.i)) end"))
    covered = "aggregate(transform(_places, (p, k) -> least(3, coalesce(get(_places, k + 1) - p, 3))), 0, (a, x) -> a + x)"
    marks = marks.withColumns({
        "n_repeat_words": F.expr(f"cast(coalesce({covered}, 0) as bigint)"),
        "n_dup_lines": F.expr("cast(size(_full) - size(array_distinct(_full)) as bigint)"),
        # A line's words are counted once.
        "_counted": F.expr(f"transform(transform(_full, x -> btrim(x, '{_SPACE_SQL}')), x -> struct(x as line, size(split(x, '[\\\\x20\\\\x09-\\\\x0D]+')) as n))"),
    })
    marks = marks.withColumn("_judged", F.expr(f"transform(_counted, x -> struct({line_verdict('x.line', 'x.n', ('_marks', '_phrases', '_capitals'))} as ok, x.line as line))"))
    marks = marks.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "clean_text": F.expr("array_join(transform(filter(_judged, x -> x.ok), x -> x.line), '\n')"),
        "_gone": F.expr("array_join(transform(filter(_judged, x -> not x.ok), x -> x.line), '\n')"),
    })
    lost = 100 * F.char_length(F.translate("_gone", SPACE, ""))
    marks = marks.withColumn("kept", ~F.col("base_failed") & (lost <= MAX_LOST_PERCENT * F.col("word_chars")))
    return outward(marks, docs, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"))


_SPACE_SQL = " \\t\\n\\u000b\\u000c\\r"


def query(spark, sf_dir: str) -> DataFrame:
    out = evaluate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql() -> str:
    ws = "[\\x20\\x09-\\x0D]+"
    strip = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    count = lambda pattern: f"len(regexp_extract_all(x, '{pattern}'))"
    n = f"len(string_split_regex(x, '{ws}'))"
    terminal = TERMINAL.replace("'", "''")
    verdict = f"""(({n} < 4 OR instr('{terminal}', right(x, 1)) > 0) AND {count("[|»›•·]")} < 3
        AND NOT regexp_matches(lower(x), '{"|".join(BOILERPLATE)}')
        AND 10 * {count("[#*$%&]{2,}")} <= 3 * {n} AND 10 * {count("!!")} <= 3 * {n}
        AND ({n} < 4 OR 10 * {count("[A-ZÀ-ÖØ-Þ]")} <= 6 * greatest({count("[A-Za-zÀ-ÖØ-öø-ÿ]")}, 1)))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{ws}'), lambda x: x <> '') AS ws,
       list_filter(string_split(t, chr(10)), lambda x: trim(x, {strip}) <> '') AS lines FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i) u),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + k AS p FROM twice, (VALUES (0), (1), (2)) v(k)) GROUP BY rid),
b AS (SELECT w.*, len(ws) AS n_words, len(regexp_replace(t, '{ws}', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
       len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
       list_filter(list_transform(lines, lambda x: trim(x, {strip})), lambda x: {verdict}) AS stay
       FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * (word_chars - len(regexp_replace(coalesce(array_to_string(stay, chr(10)), ''), '{ws}', '', 'g'))) <= 50 * word_chars AS kept
FROM f
"""
