"""Folders of image files as a DataFrame (image_id, path, format, content)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritile.functions.scalar import extension
from veritile.sources.sniff import format_of

EXTENSIONS = ("bmp", "ppm", "pgm", "jpg", "jpeg", "png", "heic", "heif", "webp")


def _roots(spark: SparkSession, paths: list[str], recursive: bool) -> list[str]:
    """The files and folders that ``paths`` name, without those that another one already covers.

    Only the paths themselves are looked at, so this costs as much as there are arguments.  Raises ValueError for a
    path that leads nowhere.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, bool] = {}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        matches = path.getFileSystem(conf).globStatus(path)
        if not matches:
            raise ValueError(f"{p} does not exist")
        found |= {m.getPath().toString(): m.isDirectory() for m in matches}
    folders = {p for p, is_folder in found.items() if is_folder}

    def covered(p: str) -> bool:
        parent = p.rpartition("/")[0]
        if not recursive:
            return not found[p] and parent in folders
        while parent:
            if parent in folders:
                return True
            parent = parent.rpartition("/")[0]
        return False

    return [p for p in found if not covered(p)]


def files(spark: SparkSession, paths: list[str] | str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = False) -> DataFrame:
    """Each file once, whatever paths lead to it, in one scan.  The extension is looked at without regard to case.

    Repeats are found among the paths that are asked for, so neither paths nor bytes are shuffled.
    """
    roots = _roots(spark, [paths] if isinstance(paths, str) else list(paths), recursive)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(roots).where(extension(F.col("path")).isin(*extensions))
    return found.select(F.col("path").alias("image_id"), "path", "length", format_of(F.col("content")).alias("format"), "content")


def labeled_folders(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``root/authentic`` and ``root/tampered`` with a ``label``.  Raises ValueError if one is missing or has no image."""
    both = []
    for n in ("authentic", "tampered"):
        found = files(spark, f"{root}/{n}", extensions, recursive=True)
        if found.select("path").isEmpty():
            raise ValueError(f"{root}/{n} has no image")
        both.append(found.withColumn("label", F.lit(n)))
    return reduce(DataFrame.unionByName, both)


def labeled_list(spark: SparkSession, path: str) -> DataFrame:
    """The files of a list (see ``manifest``) with their ``label``; relative paths are looked for beside the list.

    One scan reads the folders that the list names, and its rows are joined to the list; a file that is not there has
    no content and is skipped later, with the reason.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).getParent().toString()
    scheme = base.partition("/")[0]
    raw = F.col("path")
    whole = F.when(raw.rlike("^[a-z][a-z0-9+.-]*:"), raw).when(raw.startswith("/"), F.concat(F.lit(scheme), raw)).otherwise(F.concat(F.lit(base + "/"), raw))
    listed = manifest(spark, path).select(whole.alias("path"), "label")
    folders = [r[0] for r in listed.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]
    there = []
    for f in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            there.append(f)
    if not there:
        raise ValueError("none of the listed files is there")
    known = spark.read.format("binaryFile").load(there).select("path", "length", format_of(F.col("content")).alias("format"), "content")
    return listed.join(known, "path", "left").select(F.col("path").alias("image_id"), "path", "length", "format", "content", "label")


def manifest(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """(path, label) of a list of ``path,label`` lines; blank lines, comments and a header are left out.

    Raises ValueError for a line that can not be read, an unknown label, a path with two labels, or an empty list.
    """
    from veritile.functions.scalar import label_of

    raw = spark.createDataFrame([(text,)], "value string") if text is not None else spark.read.text(path, wholetext=True)
    lines = raw.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("k", "line")).select((F.col("k") + 1).alias("n"), F.trim(F.regexp_replace("line", "\t", " ")).alias("line"))
    lines = lines.where("line <> '' and not line like '#%'")
    quotes = F.char_length("line") - F.char_length(F.replace("line", F.lit('"'), F.lit("")))
    fields = F.from_csv("line", "a string, b string, c string", {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = lines.withColumns({"f": fields, "ok": quotes % 2 == 0}).select("n", "line", "ok", F.trim("f.a").alias("path"), F.trim("f.b").alias("raw"), F.col("f.c").isNull().alias("two"))
    first = F.expr("n = min(n) over ()") & (F.lower("path") == "path") & (F.lower("raw") == "label")
    rows = rows.withColumn("_head", first).where("not _head").withColumn("label", label_of(F.col("raw")))
    # One row at most comes back from each check.
    bad = rows.where("not ok or not two or path is null or path = '' or raw is null").orderBy("n").first()
    if bad:
        raise ValueError(f"line {bad['n']} can not be read: {bad['line']}")
    bad = rows.where("label is null").orderBy("n").first()
    if bad:
        raise ValueError(f"line {bad['n']} has the unknown label {bad['raw']}")
    out = rows.groupBy("path").agg(F.min("label").alias("label"), F.countDistinct("label").alias("_l"))
    bad = out.where("_l > 1").first()
    if bad:
        raise ValueError(f"{bad['path']} has two labels")
    if out.isEmpty():
        raise ValueError("the list is empty")
    return out.select("path", "label")
