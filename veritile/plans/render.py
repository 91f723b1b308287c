"""Reports as text, JSON, CSV and HTML."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritile.operators import batch

_PAGE = "<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title><style>{style}</style></head><body>{body}</body></html>"
# The color of each check with regions, and the names that reports show.
COLORS = {
    "ela": "#f76707", "clone": "#1c7ed6", "doublecompression": "#ae3ec9", "prnu": "#2f9e44", "cfa": "#e64980",
    "jpegghost": "#1098ad", "thumbnail": "#5c7cfa", "aigenerated": "#f59f00", "noiselevel": "#0ca678",
}
OTHER_COLOR = "#868e96"
NAMES = {
    "ela": "Error Level Analysis", "metadata": "EXIF / Metadata Analysis", "clone": "Copy-Move (Clone) Detection", "doublecompression": "Double JPEG Compression Detection",
    "prnu": "Sensor Noise (PRNU)", "cfa": "Color Filter Array", "jpegghost": "JPEG Ghosts", "thumbnail": "Thumbnail Consistency", "aigenerated": "Signs of Synthesis", "noiselevel": "Noise Level",
}
#: Regions that are written out under an indicator; all are drawn.
LISTED = 12
_STYLE = ".stage{position:relative;display:inline-block}.stage svg{position:absolute;inset:0;width:100%;height:100%}rect{fill-opacity:.2;stroke-width:1}.swatch{display:inline-block;width:1em;height:1em}.high{color:#c92a2a}.elevated{color:#e8590c}.low{color:#f08c00}.minimal{color:#2b8a3e}"
#: Shows or hides the layer of a check when its box changes.
_SCRIPT = "for(const b of document.querySelectorAll('input[data-layer]'))b.onchange=()=>{for(const g of document.querySelectorAll('g.layer'))if(g.dataset.layer===b.dataset.layer)g.style.display=b.checked?'':'none'}"


def _round(x: float) -> int:
    return int(x + 0.5)


def _plain(row) -> dict:
    return row.asDict(recursive=True) if hasattr(row, "asDict") else row


def text(row) -> str:
    r = _plain(row)
    if r["reason"]:
        return f"{r['path']}: skipped ({r['reason']})"
    lines = [r["path"], f"Overall suspicion score: {_round(r['score'])}/100 ({r['verdict']})", ""]
    for f in r["findings"]:
        lines.append(f"[{f['analyzer_id']}] score {_round(f['score'])}/100 -- {f['summary']}")
        lines += [f"  - {i['message']}" for i in f["indicators"]]
    return "\n".join(lines)


def as_json(row) -> str:
    """Keys in order; an indicator without regions has no such key."""
    r = _plain(row)
    found = [
        {"analyzerID": f["analyzer_id"], "score": f["score"], "summary": f["summary"], "indicators": [{k: v for k, v in i.items() if k != "regions" or v} for i in f["indicators"]]}
        for f in r["findings"] or []
    ]
    return json.dumps({"overallScore": r["score"], "verdict": r["verdict"], "findings": found}, indent=2, sort_keys=True, ensure_ascii=False)


def batch_text(entries: DataFrame, directory: str = "") -> DataFrame:
    """(line): a heading with the totals; then, ranked, score and path of each file, and contributors or verdict or the reason below."""
    c = batch.counts(entries).first()
    title = f"Batch Report -- {directory}"
    head = [title, "=" * len(title), f"{c['total']} file(s) found -- {c['analyzed']} analyzed, {c['skipped']} skipped", ""]
    head.append(f"{'SCORE':<8}  FILE" if c["total"] else "No files to report.")
    shown = F.when(F.size("contributors") > 0, F.array_join("contributors", ", ")).otherwise(F.col("verdict"))
    score = F.rpad(F.coalesce(F.concat(F.round("score").cast("int").cast("string"), F.lit("/100")), F.lit("SKIPPED")), 8, " ")
    lines = F.concat(score, F.lit("  "), "path", F.lit("\n" + " " * 10), F.coalesce("reason", shown))
    body = batch.with_rank(entries).select("rank", lines.alias("line"))
    frame = entries.sparkSession.createDataFrame([(k - len(head) + 1, line) for k, line in enumerate(head)], "rank long, line string")
    return body.unionByName(frame).orderBy("rank").select("line")


def batch_json(entries: DataFrame, directory: str = "") -> DataFrame:
    """(line): the lines of one JSON object with the directory, the totals and the ranked entries.

    An entry is a line of its own, so neither a task nor the driver holds all of them.
    """
    c = batch.counts(entries).first()
    spark = entries.sparkSession
    head = [f'  "analyzedCount": {c["analyzed"]},', f'  "directory": {json.dumps(directory, ensure_ascii=False)},', '  "entries": [']
    tail = ["  ],", f'  "skippedCount": {c["skipped"]},', f'  "totalFiles": {c["total"]}', "}"]
    said = F.struct(F.col("path").alias("filePath"), "score", F.col("reason").alias("skipReason"), "status", F.coalesce("contributors", F.array().cast("array<string>")).alias("topContributors"), "verdict")
    ranked = batch.with_rank(entries.withColumn("_line", F.to_json(said)))
    body = ranked.select((F.col("rank") + len(head)).alias("k"), F.concat(F.lit("    "), "_line", F.when(F.col("rank") < c["total"], ",").otherwise("")).alias("line"))
    frame = [(k, line) for k, line in enumerate(["{", *head])] + [(c["total"] + len(head) + 1 + k, line) for k, line in enumerate(tail)]
    return body.unionByName(spark.createDataFrame(frame, "k long, line string")).orderBy("k").select("line")


def batch_csv(entries: DataFrame) -> DataFrame:
    return batch.csv_lines(batch.ranked(entries)).select("line")


def escape(s: str) -> str:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = s.replace(mark, entity)
    return s


def _layers(found: list[dict]) -> list[tuple[str, str, str, list[tuple]]]:
    """(id, name, color, regions) of the checks that draw on the image: each region once, in the order it is first named."""
    out = []
    for f in found:
        i = f["analyzer_id"]
        regions = list(dict.fromkeys((g["x"], g["y"], g["width"], g["height"]) for x in f["indicators"] for g in x["regions"] or []))
        if regions or i in COLORS:
            out.append((i, NAMES.get(i, i), COLORS.get(i, OTHER_COLOR), regions))
    return out


def _place(x: int, y: int, w: int, h: int) -> str:
    return f"x {x}, y {y}, {w}\u00d7{h} px"


def _stage(uri: str | None, size: tuple[int, int] | None, layers: list) -> str:
    """The image with the regions of each layer over it, in the image's own pixels."""
    if not uri:
        return "<p class='image-missing'>No preview: a browser can not show this format, and there are no decoded pixels.</p>"
    if not size:
        return f'<figure class="stage"><img src="{uri}" alt="Analyzed image"></figure>'
    groups = []
    for i, name, color, regions in layers:
        boxes = "".join(f'<rect class="overlay" data-analyzer="{i}" x="{x}" y="{y}" width="{w}" height="{h}"><title>{escape(name)}: {_place(x, y, w, h)}</title></rect>' for x, y, w, h in regions)
        groups.append(f'<g class="layer" data-layer="{i}" fill="{color}" stroke="{color}">{boxes}</g>')
    return f'<figure class="stage"><img src="{uri}" alt="Analyzed image" width="{size[0]}" height="{size[1]}"><svg viewBox="0 0 {size[0]} {size[1]}" preserveAspectRatio="none">{"".join(groups)}</svg></figure>'


def _section(f: dict) -> str:
    items = []
    for i in f["indicators"]:
        regions = [tuple(g[k] for k in ("x", "y", "width", "height")) for g in i["regions"] or []]
        listed = "".join(f'<li class="region">{_place(*g)}</li>' for g in regions[:LISTED])
        rest = f'<li class="region">and {len(regions) - LISTED} more</li>' if len(regions) > LISTED else ""
        items.append(f"<li>{escape(i['message'])}{f'<ul>{listed}{rest}</ul>' if listed else ''}</li>")
    i, shown = f["analyzer_id"], _round(f["score"])
    return (
        f'<section class="card finding" data-analyzer="{i}"><h3><span class="{_severity(f["score"])}">{shown}/100</span> {escape(NAMES.get(i, i))} [{i}]</h3>'
        f"<p>{escape(f['summary'])}</p>{f'<ul>{chr(10).join(items)}</ul>' if items else ''}</section>"
    )


def _severity(score: float) -> str:
    return "high" if score >= 70 else "elevated" if score >= 45 else "low" if score >= 20 else "minimal"


def html(row, content: bytes | None = None, fmt: str | None = None, size: tuple[int, int] | None = None) -> str:
    """A page: score and verdict, the image with its flagged regions in layers that can be switched, a legend, and the findings."""
    from veritile.plans.engine import load
    from veritile.sources.decode import DecodeError, encode_bmp

    r = _plain(row)
    title = escape(r["path"])
    page = lambda body: _PAGE.format(title=title, style=_STYLE, body=body)
    if r["reason"]:
        return page(f"<h1>{title}</h1><p>Skipped: {escape(r['reason'])}</p>")
    uri = None
    if content and fmt:
        kind, data = fmt, content
        if fmt in ("ppm", "pgm", "heif"):
            try:
                kind, data = "bmp", encode_bmp(load(content, fmt).need())
            except DecodeError:
                data = None
        if data:
            uri = f"data:image/{kind};base64,{base64.b64encode(data).decode()}"
    found, shown, level = r["findings"], _round(r["score"]), _severity(r["score"])
    layers = _layers(found)
    body = [f'<header><h1>{title}</h1><div class="{level}" id="overall-score" data-score="{shown}"><span class="score-value">{shown}</span>/100</div><p class="{level}">{escape(r["verdict"])}</p></header>']
    if not any(f["score"] > 0 for f in found):
        body.append('<p class="no-anomalies">No anomalies detected.</p>')
    swatch = lambda color: f'<span class="swatch" style="background:{color}"></span>'
    if layers:
        boxes = "".join(f'<label class="toggle"><input type="checkbox" checked data-layer="{i}"> {swatch(color)}{escape(name)}</label>' for i, name, color, _ in layers)
        body.append(f'<div class="toggles" role="group" aria-label="Overlay layers">{boxes}</div>')
    body.append(_stage(uri, size, layers))
    if layers:
        entries = "".join(f'<li class="legend-entry" data-analyzer="{i}">{swatch(color)}{escape(name)} ({len(g)} region{"" if len(g) == 1 else "s"})</li>' for i, name, color, g in layers)
        body.append(f'<ul class="legend">{entries}</ul>')
    body.append("<h2>Findings</h2>" + "".join(map(_section, found)))
    if layers:
        body.append(f"<script>{_SCRIPT}</script>")
    return page("\n".join(body))


def html_index(rows: list, names: dict[str, str]) -> str:
    """Entries by falling score, then path."""
    order = sorted(map(_plain, rows), key=lambda r: (r["score"] is None, -(r["score"] or 0), r["path"]))
    lines = "".join(f"<tr><td><a href='{escape(names[r['path']])}'>{escape(r['path'])}</a></td><td>{'' if r['score'] is None else _round(r['score'])}</td><td>{escape(r['verdict'] or r['reason'])}</td></tr>" for r in order)
    return _PAGE.format(title="Reports", style=_STYLE, body=f"<table>{lines}</table>")


# Evaluation ------------------------------------------------------------------------------------------------------------


def _number(x: float) -> str:
    """Without .0 for a whole number."""
    return str(int(x)) if x == int(x) else str(x)


def _matrix(m: dict) -> list[str]:
    rows = [("", "Predicted tampered", "Predicted clean"), ("  Actual tampered", f"TP {m['tp']}", f"FN {m['fn']}"), ("  Actual authentic", f"FP {m['fp']}", f"TN {m['tn']}")]
    return [f"{'Confusion matrix' if not a else a:<22}{b:<21}{c}" for a, b, c in rows]


def evaluation_text(dataset: str, counts: dict, points: list[dict], best: dict | None = None) -> str:
    """The report of one threshold, or of a sweep with its ``best`` one."""
    a, t, s = (counts[k] for k in ("authentic", "tampered", "skipped"))
    lines = ["Evaluation", "==========", f"Dataset: {dataset}", f"Analyzed: {a + t} images ({a} authentic, {t} tampered), {s} skipped", ""]
    shares = lambda m: [f"{m[k]:.1%}" for k in ("precision", "recall", "f1", "accuracy")]
    if best is None:
        m = points[0]
        lines += [f"Threshold: flagged when suspicion score >= {_number(m['threshold'])}", "", *_matrix(m), ""]
        lines += [f"{n:<11}{v}" for n, v in zip(("Precision:", "Recall:", "F1 score:", "Accuracy:"), shares(m))]
        return "\n".join(lines)
    row = lambda cells: " ".join(f"{c:<10}" for c in cells).rstrip()
    lines += [row(("Threshold", "Precision", "Recall", "F1", "Accuracy", "TP", "FP", "TN", "FN")), row(["---------"] * 9)]
    lines += [row([_number(m["threshold"]), *shares(m), *(str(m[k]) for k in ("tp", "fp", "tn", "fn"))]) for m in points]
    p, r, f, acc = shares(best)
    return "\n".join([*lines, "", f"Best threshold by F1: {_number(best['threshold'])} (F1 {f}, precision {p}, recall {r}, accuracy {acc})", "", *_matrix(best)])


def _point(m: dict) -> dict:
    cells = {"truePositives": m["tp"], "falsePositives": m["fp"], "trueNegatives": m["tn"], "falseNegatives": m["fn"]}
    return {"threshold": m["threshold"], "confusionMatrix": cells, **{k: m[k] for k in ("precision", "recall", "f1", "accuracy")}}


def evaluation_json(dataset: str, counts: dict, points: list[dict], best: dict | None, samples: DataFrame) -> Iterator[str]:
    """The lines of one JSON object; ``samples`` (path, label, score, reason) come by path, one a line, and are never held whole."""
    yield "{"
    if best is not None:
        yield f'  "best": {json.dumps(_point(best), sort_keys=True)},'
    yield f'  "counts": {json.dumps(counts, sort_keys=True)},'
    yield f'  "dataset": {json.dumps(dataset, ensure_ascii=False)},'
    if best is not None:
        yield f'  "points": {json.dumps(list(map(_point, points)), sort_keys=True)},'
    else:
        yield f'  "result": {json.dumps(_point(points[0]), sort_keys=True)},'
    analyzed, skipped = F.col("score").isNotNull(), F.col("score").isNull()
    for name, rows, end in (("samples", samples.where(analyzed).select("path", "label", "score"), ","), ("skipped", samples.where(skipped).select("path", "label", "reason"), "")):
        yield f'  "{name}": ['
        before = None
        for r in rows.orderBy("path").toLocalIterator():
            if before:
                yield before + ","
            before = "    " + json.dumps(r.asDict(), sort_keys=True, ensure_ascii=False)
        if before:
            yield before
        yield f"  ]{end}"
    yield "}"


def sweep_csv(points: list[dict]) -> str:
    """A row for each threshold."""
    lines = ["threshold,precision,recall,f1,accuracy,true_positives,false_positives,true_negatives,false_negatives"]
    lines += [",".join([_number(m["threshold"]), *(f"{m[k]:.4f}" for k in ("precision", "recall", "f1", "accuracy")), *(str(m[k]) for k in ("tp", "fp", "tn", "fn"))]) for m in points]
    return "\n".join(lines)
