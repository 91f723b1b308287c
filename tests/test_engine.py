"""Files to reports, commands, labels, settings, streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import images
from veritile import cli, config
from veritile.operators import evaluation
from veritile.plans import engine, render
from veritile.sources import decode, exif, scan
from veritile.sources.sniff import format_of, is_animated


def test_bitmaps_and_pixmaps():
    for px in (images.noise(7), images.noise(8)[:, :5]):
        assert (decode.decode_bmp(decode.encode_bmp(px)) == px).all() and (decode.decode_pnm(decode.encode_pnm(px)) == px).all()
    gray = images.noise(6, 1)
    assert (decode.decode_pnm(decode.encode_pnm(gray)) == gray).all()
    assert decode.decode_pnm(b"P5 # c\n2 # d\n1\n7\n\x05\x07").ravel().tolist() == [5, 7]
    for bad in (b"", b"P6 2 2 255 abc", b"P6 0 2 255 " + b"a" * 9, b"P5 2 2 65535 aaaa", b"P5 x"):
        with pytest.raises(decode.DecodeError):
            decode.decode_pnm(bad)
    data = decode.encode_bmp(images.noise(9))
    for bad in (data[:60], b"BM" + b"\0" * 60):
        with pytest.raises(decode.DecodeError):
            decode.decode_bmp(bad)


@pytest.mark.parametrize("channels,restart", [(1, 0), (3, 0), (1, 5)])
def test_jpeg_round_trip(channels, restart):
    px = images.smooth(61, 3, channels)
    data = images.jpeg(px, 95, restart=restart)
    got = decode.decode_jpeg(data)
    assert got.shape == px.shape and np.abs(got.astype(int) - px).mean() < 3
    small = decode.decode_jpeg(data, eighth=True, gray=True)
    assert small.shape == (8, 8, 1) and abs(float(small.mean()) - px.mean()) < 6
    assert decode.jpeg_size(data) == (61, 61)
    for bad in (data[:200], b"\xff\xd8\xff\xd9", data.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(decode.DecodeError):
            decode.decode_jpeg(bad)


def test_dates_roll_over():
    assert str(exif.date("2020:13:32 25:00:00")) == "2021-02-02 01:00:00" and exif.date("2020:01:01") is None and exif.date(None) is None


def test_formats(spark):
    heads = {b"BM": "bmp", b"P6": "ppm", b"P5": "pgm", b"\xff\xd8\xff": "jpeg", images.webp(b""): "webp", images.heif(b"x"): "heif", b"\x89PNG": None, b"": None}
    df = spark.createDataFrame([(bytearray(k), v) for k, v in heads.items()], "c binary, want string")
    assert df.where(~format_of(F.col("c")).eqNullSafe(F.col("want"))).count() == 0
    still = images.webp(b"")
    moving = still[:20] + bytes([still[20] | 2]) + still[21:]
    df = spark.createDataFrame([(bytearray(still), False), (bytearray(moving), True)], "c binary, want boolean")
    assert df.where(is_animated(F.col("c")) != F.col("want")).count() == 0


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("set")
    for name in ("authentic", "tampered"):
        (top / name).mkdir()
    for k in range(3):
        (top / "authentic" / f"a{k}.ppm").write_bytes(decode.encode_pnm(images.scene(256, 4.0, k)))
        px = images.scene(256, 4.0, 10 + k)
        px[64:128, 128:192] = images.scene(256, 0.5, 30 + k)[64:128, 128:192]
        (top / "tampered" / f"t{k}.BMP").write_bytes(decode.encode_bmp(px))
    (top / "authentic" / "x.png").write_bytes(b"\x89PNG\r\n")
    (top / "authentic" / "cut.bmp").write_bytes(b"BM123")
    (top / "authentic" / "notes.txt").write_bytes(b"no")
    return top


def test_reports(spark, folder):
    files = scan.files(spark, [str(folder / "authentic"), str(folder / "tampered"), str(folder / "tampered" / "t0.BMP")])
    assert files.count() == 8
    found = engine.reports(engine.findings(files, only=["noiselevel", "metadata", "ela"])).collect()
    by = {r["path"].rsplit("/", 1)[1]: r for r in found}
    assert {n: r["status"] for n, r in by.items() if n in ("x.png", "cut.bmp")} == {"x.png": "skipped", "cut.bmp": "skipped"}
    assert min(by[f"t{k}.BMP"]["score"] for k in range(3)) > max(by[f"a{k}.ppm"]["score"] for k in range(3))
    assert [f["analyzer_id"] for f in by["t0.BMP"]["findings"]] == ["ela", "metadata", "noiselevel"]
    assert by["t0.BMP"]["contributors"][0].startswith("noiselevel (")
    assert json.loads(render.as_json(by["t0.BMP"]))["verdict"] == by["t0.BMP"]["verdict"] and "noiselevel" in render.text(by["t0.BMP"])
    with pytest.raises(ValueError):
        engine.findings(files, only=["nothing"])


def test_reference_sums_over_tasks(spark, tmp_path):
    from veritile.plans import analyzers as A

    shots = [images.scene(96, 3.0, k) for k in range(3)]
    for k, px in enumerate(shots):
        (tmp_path / f"{k}.ppm").write_bytes(decode.encode_pnm(px))
    got = engine.camera_reference(scan.files(spark, str(tmp_path)))
    want = A.reference_pattern(shots)
    assert got["count"] == 3 and np.allclose(got["pattern"], want["pattern"])
    (tmp_path / "9.ppm").write_bytes(decode.encode_pnm(images.noise(32)))
    with pytest.raises(A.ReferenceError_):
        engine.camera_reference(scan.files(spark, str(tmp_path)))


def test_commands(spark, folder, tmp_path, capsys):
    every = ["--recursive", "--only", "noiselevel"]
    assert cli.main(["batch", str(folder), *every, "--format", "csv", "--output", str(tmp_path / "o.csv")]) == 0
    lines = (tmp_path / "o.csv").read_text().split("\n")
    assert lines[0] == "file_path,status,score,verdict,top_contributors,skip_reason" and ".BMP,analyzed," in lines[1] and sum(",skipped," in x for x in lines) == 2
    assert cli.main(["batch", str(folder), *every, "--fail-threshold", "10", "--html", str(tmp_path / "h")]) == 2
    assert "t0.BMP" in (tmp_path / "h" / "index.html").read_text() and len(list((tmp_path / "h").iterdir())) == 4
    capsys.readouterr()
    assert cli.main(["noiselevel", str(folder / "tampered" / "t1.BMP"), "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["findings"][0]["analyzerID"] == "noiselevel"
    assert cli.main(["evaluate", str(folder), "--only", "noiselevel", "--sweep", "0:50:10"]) == 0
    out = capsys.readouterr().out
    assert "Best threshold by F1: 10 (F1 100.0%" in out and "Confusion matrix" in out and out.count("\n10 ") == 1
    (tmp_path / "list.csv").write_text(f"path,label\n# c\n{folder}/authentic/a0.ppm,au\n\"{folder}/tampered/t0.BMP\",fake\n")
    assert cli.main(["evaluate", str(tmp_path / "list.csv"), "--only", "noiselevel", "--threshold", "5", "--format", "csv"]) == 0
    assert capsys.readouterr().out.strip().split("\n")[1] == "5,1.0000,1.0000,1.0000,1.0000,1,0,1,0"
    assert cli.main(["batch", "/nowhere"]) == 1 and cli.main(["formats"]) == 0


def test_evaluation_outputs(spark, folder, tmp_path, capsys):
    kept, rows = tmp_path / "r.json", tmp_path / "s.csv"
    every = ["evaluate", str(folder), "--only", "noiselevel"]
    assert cli.main([*every, "--sweep", "0:100:10", "--output", str(kept), "--csv", str(rows)]) == 0
    lines = rows.read_text().strip().split("\n")
    assert lines[0] == "threshold,precision,recall,f1,accuracy,true_positives,false_positives,true_negatives,false_negatives" and len(lines) == 12 and lines[1].startswith("0,")
    got = json.loads(kept.read_text())
    assert set(got) == {"best", "counts", "dataset", "points", "samples", "skipped"} and len(got["points"]) == 11 and got["best"]["f1"] == 1
    assert [s["path"] for s in got["samples"]] == sorted(s["path"] for s in got["samples"]) and all(s["reason"] for s in got["skipped"])
    assert len(got["samples"]) == got["counts"]["authentic"] + got["counts"]["tampered"] and len(got["skipped"]) == got["counts"]["skipped"]
    capsys.readouterr()
    assert cli.main([*every, "--threshold", "10"]) == 0
    out = capsys.readouterr().out
    assert "Threshold: flagged when suspicion score >= 10" in out and "Precision:" in out and "TP " in out
    assert cli.main([*every, "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["result"]["threshold"] == 45
    assert cli.main([*every, "--threshold", "5", "--sweep"]) == 1 and cli.main([*every, "--csv", "x"]) == 1 and cli.main([*every, "--sweep", "0:200:5"]) == 1
    for bad in (["--threshold", "101"], ["--extensions", " ,"]):
        with pytest.raises(SystemExit):
            cli.main([*every, *bad])
    assert cli.main([*every, "--extensions", "nothing"]) == 1
    (tmp_path / "list.csv").write_text(f"{folder}/authentic/a0.ppm,au\n{folder}/nowhere.ppm,tp\n")
    assert cli.main(["evaluate", str(tmp_path / "list.csv"), "--only", "noiselevel", "--format", "json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert [s["path"].rpartition("/")[2] for s in got["skipped"]] == ["nowhere.ppm"] and len(got["samples"]) == 1


def test_batch_text(spark, folder, capsys):
    assert cli.main(["batch", str(folder), "--recursive", "--only", "noiselevel"]) == 0
    lines = capsys.readouterr().out.strip().split("\n")
    assert lines[0] == f"Batch Report -- {folder}" and " analyzed, 2 skipped" in lines[2] and lines[4] == "SCORE     FILE"
    assert lines[5].split()[0].endswith("/100") and lines[-2].startswith("SKIPPED") and lines[-1].startswith(" " * 10)


def test_batch_json(spark, folder, capsys):
    assert cli.main(["batch", str(folder), "--recursive", "--only", "noiselevel", "--format", "json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["totalFiles"] == len(got["entries"]) == got["analyzedCount"] + got["skippedCount"] and got["directory"] == str(folder)
    scores = [e.get("score") for e in got["entries"]]
    assert scores == sorted(scores, key=lambda x: (x is None, -(x or 0))) and {e["status"] for e in got["entries"]} == {"analyzed", "skipped"}


def test_scan_finds_each_file_once_in_one_scan(spark, folder):
    paths = [str(folder), f"{folder}/authentic", f"{folder}/authentic/a0.ppm", str(folder)]
    every = scan.files(spark, paths, recursive=True)
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") + plan.count("Scan binaryFile") >= 1
    found = [r[0] for r in every.select("path").collect()]
    assert len(found) == len(set(found)) == scan.files(spark, str(folder), recursive=True).count()
    flat = [r[0] for r in scan.files(spark, [f"{folder}/authentic", f"{folder}/authentic/a0.ppm"]).select("path").collect()]
    assert len(flat) == len(set(flat)) > 0
    with pytest.raises(ValueError):
        scan.files(spark, [str(folder), "/nowhere"])


def test_progress(spark):
    import io

    from veritile.plans import progress

    said = io.StringIO()
    with progress.shown(spark, 0.05, said):
        spark.range(0, 60_000_000, 1, 64).selectExpr("max(xxhash64(id))").collect()
    assert "tasks done" in said.getvalue() and said.getvalue().endswith("\n")


def test_page_has_layers_toggles_and_legend():
    region = {"x": 16, "y": 32, "width": 16, "height": 16}
    many = [{"x": k, "y": 0, "width": 8, "height": 8} for k in range(14)]
    row = {
        "path": "a<b>.ppm", "reason": None, "score": 72.6, "verdict": "likely manipulated",
        "findings": [
            {"analyzer_id": "ela", "score": 60.0, "summary": "s & t", "indicators": [{"message": "m", "weight": 1.0, "regions": [region]}, {"message": "again", "weight": 1.0, "regions": [region]}]},
            {"analyzer_id": "clone", "score": 0.0, "summary": "none", "indicators": [{"message": "many", "weight": 1.0, "regions": many}]},
            {"analyzer_id": "metadata", "score": 5.0, "summary": "no camera", "indicators": [{"message": "x", "weight": 1.0, "regions": []}]},
        ],
    }
    page = render.html(row, decode.encode_pnm(images.noise(64)), "ppm", (64, 64))
    assert page.count('class="overlay"') == 15 and '<rect class="overlay" data-analyzer="ela" x="16" y="32" width="16" height="16">' in page and 'viewBox="0 0 64 64"' in page
    for i in ("ela", "clone"):
        assert f'<li class="legend-entry" data-analyzer="{i}">' in page and f'<input type="checkbox" checked data-layer="{i}">' in page and f'<g class="layer" data-layer="{i}"' in page
    assert 'data-layer="metadata"' not in page and '<section class="card finding" data-analyzer="metadata">' in page
    assert 'data-score="73"' in page and "x 16, y 32, 16\u00d716 px" in page and "and 2 more" in page and "a&lt;b&gt;.ppm" in page and "<script>" in page
    assert "No preview" in render.html(row) and "<svg" not in render.html(row)


def test_copies_across_tiles():
    """A copy whose source is tiles away is found, as without tiles."""
    px = images.noise(256, 42)
    px[200:224, 200:224] = px[8:32, 8:32]
    cfg = config.default()
    image = engine.A.Image(b"", "ppm", px)
    tiled, whole = (engine.analyze(image, cfg, {"clone"}, forced_tile=64, no_tiling=off)[0][1] for off in (False, True))
    assert tiled.score > 0 and whole.score > 0
    luma, s = engine.A.kernels.rounded_luma(px), cfg["cloneDetection"]
    for stride in (8, 6, 5):
        own = s | {"blockStride": stride}
        assert engine.A.block_matches(luma, own, engine.tiles(256, 256, 64, 64)) == engine.A.block_matches(luma, own)
    corner = engine.analyze(engine.A.Image(b"", "ppm", px[:80, :80].copy()), cfg, {"clone"})[0][1]
    assert corner.score == 0


def test_an_optional_decoder_that_fails_skips_the_file(spark, monkeypatch):
    def broken(content):
        raise OSError("image file is truncated")

    monkeypatch.setattr(decode, "optional_codec", lambda fmt: (broken, "there"))
    try:
        engine.load(b"RIFF0000WEBPVP8 ", "webp")
    except engine.UNREADABLE as why:
        assert "truncated" in str(why)


def test_manifest(spark):
    good = scan.manifest(spark, "m", 'Path,Label\n\n# x\na.bmp, AU\n"b,c.bmp",1\na.bmp,real\n')
    assert sorted(map(tuple, good.collect())) == [("a.bmp", "authentic"), ("b,c.bmp", "tampered")]
    for bad in ("a.bmp", "a.bmp,au,x", "a.bmp,what", "a,au\na,tp", '"a,au', "path,label\n"):
        with pytest.raises(ValueError):
            scan.manifest(spark, "m", bad)


def test_settings(tmp_path):
    text = "ela:\n  qualityLevel: 75 # one\n  errorThreshold: 12.5\nmetadata:\n  flagMissingExif: yes\n  suspiciousSoftwareKeywords: [\"a b\", c]\nprnu:\n  referenceFolder: ~\n"
    got = config.parse(text)
    assert got["ela"]["elaQualityLevels"] == [75] and got["ela"]["errorThreshold"] == 12.5 and got["metadata"]["suspiciousSoftwareKeywords"] == ["a b", "c"]
    assert config.load(str(tmp_path / "none")) == config.default()
    for bad in ("ela", "  a: 1", "ela:\n  nothing: 1", "ela:\n  enabled: maybe", "x:\n  y: 1", "cfa:\n  blockSize: a"):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_evaluation_numbers(spark):
    rows = [(90.0, True)] * 8 + [(10.0, True)] * 5 + [(90.0, False)] * 2 + [(10.0, False)] * 85
    df = spark.createDataFrame(rows, "score double, tampered boolean")
    r = evaluation.with_metrics(evaluation.confusion(df, 50)).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.8, pytest.approx(8 / 13), pytest.approx(16 / 23), 0.93)
    assert evaluation.thresholds(0, 0.3, 0.1) == [0, 0.1, 0.2, 0.3] and evaluation.thresholds(40, 50, 3) == [40, 43, 46, 49]
    for at in ([0.0, 10.0, 50.0, 90.0, 95.0], [k * 0.5 for k in range(300)], [k * k * 0.1 for k in range(90)] + [10.0, 50.0, 95.0]):
        swept = {r["threshold"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in evaluation.sweep(df, at).collect()}
        assert swept[10.0] == (13, 87, 0, 0) and swept[50.0] == (8, 2, 85, 5) and swept[95.0] == (0, 0, 87, 13) and len(swept) == len(set(at))
    assert evaluation.best(evaluation.sweep(df, [20.0, 50.0])).first()["threshold"] == 20.0


def test_stream(spark, tmp_path):
    from veritile.streaming import watch

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.ppm").write_bytes(decode.encode_pnm(images.scene(256, 4.0, k)))
    q = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), only=["noiselevel"])
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_timings_table(spark, tmp_path):
    from veritile.plans import timings

    (tmp_path / "t.json").write_text(json.dumps({"generatedAt": "x", "results": [{"analyzer": "ela", "size": "64x64", "pixels": 4096, "milliseconds": 3.1}, {"analyzer": "clone", "size": "64x64", "pixels": 4096, "milliseconds": 0.456}]}))
    table = timings.markdown(timings.read(spark, str(tmp_path / "t.json")))
    assert table.split("\n")[2:] == ["| clone | 64x64 | 0.46 |", "| ela | 64x64 | 3.10 |"]
    done = timings.spliced(f"a\n{timings.START}\nold\n{timings.END}\nb", table)
    assert "old" not in done and done.startswith("a\n") and done.endswith("\nb") and timings.spliced(done, table) == done
    for bad in ("none", f"{timings.END}{timings.START}", timings.START * 2 + timings.END):
        with pytest.raises(ValueError):
            timings.spliced(bad, table)


def test_tall_and_odd_inputs_are_skipped_or_clean(spark):
    rows = [("a", "ppm", bytearray(b"P6 1 1 255 abc")), ("b", None, bytearray(b"")), ("c", "bmp", None), ("d", "jpeg", bytearray(b"\xff\xd8\xff")), ("e", "webp", bytearray(images.webp(b""))), ("f", "pgm", bytearray(b"P5 9 1 255 " + b"x" * 9))]
    out = {r["path"]: r for r in engine.reports(engine.findings(spark.createDataFrame(rows, "image_id string, format string, content binary"))).collect()}
    assert {k for k, r in out.items() if r["status"] == "skipped"} == {"b", "c", "e"}
    assert out["a"]["score"] == 0 and out["f"]["score"] == 0 and len(out["d"]["findings"]) == 10


def test_report_names_are_unique(spark):
    from veritile.operators.batch import report_names

    paths = ["a.bmp", "A.bmp", "d/a.bmp", "d a.bmp", "a.bmp-2", "index", "INDEX", "/x/index"]
    got = {r["path"]: r["name"] for r in report_names(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert len({n.lower() for n in got.values()}) == len(paths) and "index.html" not in {n.lower() for n in got.values()}
    assert got["A.bmp"] == "A.bmp.html" and got["d a.bmp"] == "d_a.bmp.html" and got["d/a.bmp"] == "d_a.bmp-2.html" and got["INDEX"] == "INDEX-2.html"


def test_broken_files_raise_nothing_else():
    small = images.jpeg(images.smooth(16, 1), 90)
    whole = images.jpeg(images.smooth(32, 2), 90, images.tiff(make="M", model="X", original="2020:01:01 10:00:00", gps="2020:01:01 10:00:00", altitude=2.0, ref=0, thumbnail=small))
    block = images.tiff(make="M", gps="2020:01:01 10:00:00")
    r = np.random.default_rng(0)
    cfg = config.default()
    for data, fmt in ((whole, "jpeg"), (decode.encode_bmp(images.noise(9)), "bmp"), (decode.encode_pnm(images.noise(9)), "ppm"), (images.webp(block), "webp"), (images.heif(block), "heif")):
        for _ in range(150):
            b = bytearray(data)
            for at in r.integers(0, len(b), r.integers(1, 6)):
                b[at] = r.integers(0, 256)
            cut = bytes(b[: r.integers(1, len(b) + 1)]) if r.random() < 0.5 else bytes(b)
            try:
                image = engine.load(cut, fmt) if fmt in ("bmp", "ppm") else engine.A.Image(cut, fmt)
                engine.analyze(image, cfg, {"metadata", "thumbnail", "noiselevel"})
            except engine.UNREADABLE:
                pass
