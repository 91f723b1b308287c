"""Line dedup without Python: range-partitioned line hashes, secondary sort, per-document keep bitmaps.

Each line becomes 128 bits of hash, its document and its position; no text is shuffled for the search.  The rows are
written once, then range-partitioned and sorted by (hash, document, position).  As the range bounds span the document
too, a line that fills a third of the corpus is spread over many tasks.  Streaming over the sorted rows marks the first
occurrence in each document; the marks are summed for each hash with a map-side partial sum.  The verdict for a document
comes back as a bitmap of its dropped lines, of which only the 64-line words that drop anything are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritile.llm.common import SPACE, inward, lower_ascii, materialize, outward, place

MIN_DOCS, MIN_CHARS = 10, 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``inward`` columns, the text without null, and 128 bits that name the document (its id and text)."""
    row, own = F.col(place(docs, id_col)), F.coalesce(F.col(place(docs, text_col)), F.lit(""))
    return inward(docs).select("*", row.alias("id"), own.alias("whole"), F.xxhash64(row, own).alias("k1"), F.xxhash64(F.lit(1), own, row).alias("k2"))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, id, k1, k2, pos): one row for each line whose key is long enough."""
    lines = _keyed(docs, id_col, text_col).select("id", "k1", "k2", F.posexplode(F.split(lower_ascii(F.col("whole")), "\n")).alias("pos", "line"))
    return (
        lines.withColumn("key", F.btrim("line", F.lit(SPACE)))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "k1", "k2", "pos")
    )


def drop_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    keep_first: bool = False,
) -> DataFrame:
    """(k1, k2, n_dropped, bitmap) for each document that loses a line.

    ``bitmap`` is an array of (word, bits) in order: bit b of word w is set if line 64 * w + b goes; words without a
    set bit are left out.  With ``keep_first`` the first occurrence, by document id and position, stays.
    """
    # Written, so that the texts are split and hashed once: the range bounds, the sort and the join all read the hashes.
    hashes = materialize(line_hashes(docs, id_col, text_col, min_chars), "lines")
    ordered = hashes.repartitionByRange("h1", "h2", "id", "k1")
    in_doc = Window.partitionBy("h1", "h2", "id", "k1", "k2").orderBy("pos")
    marked = ordered.withColumn("first", (F.row_number().over(in_doc) == 1).cast("long"))
    sums = [F.sum("first").alias("docs")]
    if keep_first:
        sums.append(F.min(F.struct("id", "k1", "k2", "pos")).alias("keep"))
    # Written, so that it is made once, and so that the join below is broadcast if it is small and split by AQE if not.
    frequent = materialize(marked.groupBy("h1", "h2").agg(*sums).where(F.col("docs") >= min_docs).drop("docs"), "frequent")
    gone = hashes.join(frequent, ["h1", "h2"], "inner" if keep_first else "left_semi")
    if keep_first:
        gone = gone.where(~F.struct("id", "k1", "k2", "pos").eqNullSafe(F.col("keep")))
    # Both sums are partial before they are shuffled, so a document that is repeated many times is a row for each task.
    return (
        gone.select("k1", "k2", F.expr("cast(pos div 64 as int)").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
        .groupBy("k1", "k2", "word")
        .agg(F.bit_or("bit").alias("bits"))
        .groupBy("k1", "k2")
        .agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))
    )


def drop_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    keep_first: bool = False,
) -> DataFrame:
    r"""``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` added.

    A text is split at \n; a line's key is the line without the white space at its ends and with A-Z lower-cased.
    Keys of ``min_chars`` code points or more that ``min_docs`` documents hold lose all their lines in every document
    (all but the first occurrence with ``keep_first``); other lines stay as they are, joined by \n.

    Defined cases: a null or empty text is one empty line, which stays.  A document is a distinct pair of id and text,
    so a repeated row counts once and both rows get the same verdict; a null id is an id like any other.  Texts and
    lines may be of any length.  An empty table gives no rows.  Other columns pass through, whatever their names, but
    for the three added ones, which replace columns of those names.
    """
    # The sparse words are laid out densely below the join, so that a line finds its bit in constant time.
    dense = F.expr(
        "flatten(transform(bitmap, (x, k) -> concat(array_repeat(0L, x.word - coalesce(get(bitmap, k - 1).word, -1) - 1), array(x.bits))))"
    )
    bits = drop_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep_first).select("k1", "k2", F.col("n_dropped").alias("n"), dense.alias("bits"))
    stays = "coalesce(shiftright(get(bits, cast(i div 64 as int)), i % 64) & 1L, 0L) = 0L"
    joined = _keyed(docs, id_col, text_col).join(bits, ["k1", "k2"], "left").withColumns({
        "n_lines": F.size(F.split("whole", "\n")).cast("long"),
        "n_dropped": F.coalesce("n", F.lit(0)).cast("long"),
        "kept_text": F.when(F.col("n").isNull(), F.col("whole")).otherwise(F.expr(f"array_join(filter(split(whole, '\n'), (x, i) -> {stays}), '\n')")),
    })
    return outward(joined, docs, ("n_lines", "n_dropped", "kept_text"))


def dedup_stage(docs: DataFrame) -> DataFrame:
    """Pipeline form: repeated lines go but for their first occurrence; a document of which nothing is left goes.

    The columns stay as they are, but for ``text`` and, if there is one, ``n_chars`` of a document that loses a line.
    """
    text = place(docs, "text")
    out = drop_lines(inward(docs), place(docs, "doc_id"), text, keep_first=True)
    kept = out.where((F.col("n_dropped") == 0) | (F.btrim("kept_text", F.lit(SPACE)) != ""))
    new = {text: F.col("kept_text")}
    if "n_chars" in map(str.lower, docs.columns):
        new[place(docs, "n_chars")] = F.char_length("kept_text")
    kinds = dict(out.dtypes)
    changed = {c: F.when(F.col("n_dropped") > 0, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in new.items()}
    return outward(kept.withColumns(changed), docs)


def query(spark, sf_dir: str) -> DataFrame:
    from veritile.llm.common import table

    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, name, i, string_split(t, chr(10))[i] AS line
  FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, md5(coalesce(doc_id::VARCHAR, 'null') || ' ' || coalesce(text, '')) AS name FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i) u
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT name) >= 10
), flagged AS (
  SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id, rid
"""
