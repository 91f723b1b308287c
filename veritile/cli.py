"""Commands: report, batch, evaluate, formats, and one for each check."""

from __future__ import annotations

import argparse
import os
import sys

from veritile import config as settings

COMMANDS = ("report", "batch", "evaluate", "formats")
#: A score from which on an image counts as tampered, where none is given.
THRESHOLD = 45.0


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("veritile").getOrCreate()


def _score(text: str) -> float:
    """A number from 0 to 100."""
    value = float(text)
    if not 0 <= value <= 100:
        raise argparse.ArgumentTypeError(f"{text} is not from 0 to 100")
    return value


def _extensions(text: str) -> tuple[str, ...]:
    found = tuple(x.strip().lower() for x in text.split(",") if x.strip())
    if not found:
        raise argparse.ArgumentTypeError("at least one extension is needed")
    return found


def _parser() -> argparse.ArgumentParser:
    from veritile.plans.analyzers import ANALYZERS

    p = argparse.ArgumentParser(prog="veritile")
    sub = p.add_subparsers(dest="command", required=True)
    for name in (*COMMANDS, *ANALYZERS):
        c = sub.add_parser(name)
        if name == "formats":
            continue
        c.add_argument("paths", nargs="+")
        c.add_argument("--config", default="veritile.yaml")
        c.add_argument("--only")
        c.add_argument("--format", choices=("text", "json", "csv"), default="text")
        c.add_argument("--output")
        c.add_argument("--html")
        c.add_argument("--reference")
        c.add_argument("--tile-size", type=int)
        c.add_argument("--no-tiling", action="store_true")
        c.add_argument("--no-feature-matching", action="store_true")
        c.add_argument("--recursive", action="store_true")
        c.add_argument("--fail-threshold", type=_score)
        c.add_argument("--html-threshold", type=_score, default=0.0)
        c.add_argument("--threshold", type=_score)
        c.add_argument("--sweep", nargs="?", const="0:100:5", help="least:most:step")
        c.add_argument("--csv", help="with --sweep: also a row for each threshold to this file")
        c.add_argument("--extensions", type=_extensions, help="of the files to look for, with commas")
    return p


def _emit(text: str, path: str | None) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)


def formats() -> str:
    from veritile.sources.decode import DECODERS, optional_codec

    rows = [(n, "pixels and metadata" if n in DECODERS else "metadata and thumbnail") for n in ("bmp", "ppm", "pgm", "jpeg")]
    return "\n".join(f"{n:<8}{s}" for n, s in [*rows, *((n, optional_codec(n)[1]) for n in ("heif", "webp"))])


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 for what can not be done, 2 if a score reaches the fail threshold."""
    from veritile.operators import batch, evaluation
    from veritile.plans import engine, progress, render
    from veritile.sources import scan

    a = _parser().parse_args(argv)
    if a.command == "formats":
        print(formats())
        return 0
    try:
        cfg = settings.load(a.config)
        if a.no_feature_matching:
            cfg["cloneDetection"]["featureMatchingEnabled"] = False
        if a.reference:
            cfg["prnu"]["referenceFolder"] = a.reference
        if a.sweep and a.threshold is not None:
            raise ValueError("--threshold and --sweep exclude each other")
        if a.csv and not a.sweep:
            raise ValueError("--csv needs --sweep")
        at = evaluation.thresholds(*map(float, a.sweep.split(":"))) if a.sweep else [THRESHOLD if a.threshold is None else a.threshold]
        spark = _session()
        only = a.only.split(",") if a.only else None if a.command in COMMANDS else [a.command]
        extensions = a.extensions or scan.EXTENSIONS
        reference = None
        if cfg["prnu"]["referenceFolder"] and cfg["prnu"]["enabled"] and (only is None or "prnu" in only):
            reference = engine.camera_reference(scan.files(spark, cfg["prnu"]["referenceFolder"]), cfg)
        if a.command == "evaluate":
            files = scan.labeled_folders(spark, a.paths[0], extensions) if os.path.isdir(a.paths[0]) else scan.labeled_list(spark, a.paths[0])
        else:
            files = scan.files(spark, a.paths, extensions, recursive=a.recursive)
        with progress.shown(spark):
            found = engine.reports(engine.findings(files, cfg, only, reference, a.tile_size, a.no_tiling)).cache()
            found.count()
        for r in found.where("reason is not null").select("path", "reason").toLocalIterator():
            print(f"warning: skipping {r['path']}: {r['reason']}", file=sys.stderr)
        if a.command == "evaluate":
            evaluate(found.join(files.select("path", "label"), "path"), a, at)
            return 0
        if a.command == "batch":
            where = ", ".join(a.paths)
            made = {"text": lambda e: render.batch_text(e, where), "json": lambda e: render.batch_json(e, where), "csv": render.batch_csv}[a.format](found)
            head = ["file_path,status,score,verdict,top_contributors,skip_reason"] if a.format == "csv" else []
            _emit("\n".join([*head, *(r[0] for r in made.toLocalIterator())]), a.output)
        else:
            make = render.as_json if a.format == "json" else render.text
            _emit("\n\n".join(make(r) for r in batch.ranked(found).toLocalIterator()), a.output)
        if a.html:
            write_html(found, files, a.html, a.html_threshold)
        limit = a.fail_threshold
        return 2 if limit is not None and not batch.at_least(found, limit).isEmpty() else 0
    except ValueError as why:
        print(f"error: {why}", file=sys.stderr)
        return 1


def evaluate(results, a: argparse.Namespace, at: list[float]) -> None:
    """Prints the report of (path, label, score, reason) at the thresholds, and writes the files that are asked for."""
    from pyspark.sql import functions as F

    from veritile.operators import evaluation
    from veritile.plans import render

    by = {r["label"]: r for r in evaluation.dataset_counts(results).collect()}
    counts = {n: by[n]["analyzed"] if n in by else 0 for n in ("authentic", "tampered")} | {"skipped": sum(r["skipped"] for r in by.values())}
    if not counts["authentic"] + counts["tampered"]:
        raise ValueError(f"no image could be analyzed ({counts['skipped']} skipped)")
    done = results.where("score is not null").select("score", (F.col("label") == "tampered").alias("tampered"))
    swept = evaluation.sweep(done, at)
    points = [r.asDict() for r in swept.orderBy("threshold").collect()]
    best = evaluation.best(swept).first().asDict() if a.sweep else None
    lines = lambda: render.evaluation_json(a.paths[0], counts, points, best, results.select("path", "label", "score", "reason"))
    if a.format == "json":
        print("\n".join(lines()))
    else:
        print(render.sweep_csv(points) if a.format == "csv" else render.evaluation_text(a.paths[0], counts, points, best))
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.writelines(line + "\n" for line in lines())
    if a.csv:
        _emit(render.sweep_csv(points), a.csv)


def write_html(found, files, folder: str, threshold: float) -> None:
    """A page for each image over the threshold and an index, through Spark's file systems: ``folder`` may be a local path or any address.

    A page is written where its image is, as one file of a folder that all executors reach; a local folder is for a
    session whose executors are on this machine.
    """
    from pyspark.sql import functions as F

    from veritile.operators import batch
    from veritile.plans import render

    spark = found.sparkSession
    if "://" not in folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"executors on other machines do not see {folder}; name a shared address")
    chosen = found.where(F.col("score") > threshold)
    named = chosen.join(batch.report_names(chosen), "path").join(files.select("path", "content", "format"), "path")

    def pages(batches):
        import pyarrow as pa

        from veritile.plans.analyzers import NotPossible
        from veritile.plans.engine import UNREADABLE, load

        for b in batches:
            for r in b.to_pylist():
                try:
                    h, w = load(r["content"], r["format"]).need().shape[:2]
                except (*UNREADABLE, NotPossible):  # a page without its picture
                    h = w = 0
                text = render.html(r, r["content"], r["format"], (w, h) if w else None)
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "score": [r["score"]], "verdict": [r["verdict"]], "reason": [r["reason"]], "name": [r["name"]], "page": [text]})

    made = named.mapInArrow(pages, "path string, score double, verdict string, reason string, name string, page string")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(conf)
    fs.setWriteChecksum(False)
    fs.mkdirs(top)

    def put(name: str, text: str) -> None:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(top, name), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    rows = []
    for r in made.toLocalIterator():  # one page at a time
        put(r["name"], r["page"])
        rows.append({k: r[k] for k in ("path", "score", "verdict", "reason", "name")})
    put("index.html", render.html_index(rows, {r["path"]: r["name"] for r in rows}))


if __name__ == "__main__":
    sys.exit(main())
