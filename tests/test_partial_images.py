"""Tables whose last image is cut off inside a row of blocks."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritile.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """cut(n): a folder with the first n embeddings: whole images of 250, then what is left of n."""

    def make(n):
        d = str(tmp_path_factory.mktemp("cut"))
        spark.read.parquet(f"{FOLDER}/embeddings.parquet").where(f"vec_id < {n}").write.parquet(f"{d}/embeddings.parquet")
        return d

    return make


def equals_sql(spark, d, name, table="embeddings"):
    """The query's rows, which equal those of its SQL."""
    db = duckdb.connect()
    db.sql(f"create view {table} as select * from '{d}/{table}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, d).toPandas(), db.sql(ORACLE_SQL[name]).df()[list(QUERIES[name](spark, d).columns)]
    order = sorted(got.columns, key=lambda c: (got[c].dtype.kind == "f", c))
    assert len(got) == len(want) > 0
    a, b = (df.sort_values(order).to_numpy(float) for df in (got, want))
    assert np.allclose(a, b, rtol=0, atol=1e-9, equal_nan=True)
    return got


def test_keypoints_of_a_small_image(spark, cut):
    got = {r["image_id"] for r in QUERIES["feature_keypoints"](spark, cut(330)).collect()}
    assert got == {"0"}


def test_peaks_of_a_small_image(spark, cut):
    """An image too small for a spectrum has no row; the whole one has as many as by itself."""
    got = [tuple(r) for r in QUERIES["spectral_peaks"](spark, cut(330)).collect()]
    assert {r[0] for r in got} == {"0"} and sorted(got) == sorted(tuple(r) for r in QUERIES["spectral_peaks"](spark, cut(250)).collect())


@pytest.mark.parametrize("name", ["spectral_peaks", "feature_keypoints", "prnu_signatures"])
def test_blocks_without_an_id(spark, tmp_path, name):
    """They belong to no image: nothing fails, and the other rows are those without them."""
    e, got = spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id < 250"), {}
    for d, table in (("all", e.unionByName(e.where("vec_id < 3").withColumn("vec_id", F.lit(None).cast("long")))), ("known", e)):
        table.write.parquet(f"{tmp_path}/{d}/embeddings.parquet")
        got[d] = sorted(tuple(r) for r in QUERIES[name](spark, f"{tmp_path}/{d}").collect())
    assert got["all"] == got["known"] and {r[0] for r in got["all"]} == {"0"}


def test_crop_of_a_small_image(spark, cut):
    """What the last image has inside the region comes, and nothing fails."""
    got = equals_sql(spark, cut(280), "plane_crop")
    assert (got["image_id"] == 1).sum() == 3 * 64 and (got["image_id"] == 0).sum() == 24 * 64


def test_crop_by_known_size(spark):
    from veritile.operators import planes

    px = spark.createDataFrame([(1, 0, 0, 5), (1, 3, 3, 6)], "image_id long, y int, x int, v int")
    assert [tuple(r) for r in planes.crop(px, 2, 2, 3, 3, (5, 5)).collect()] == [(1, 1, 1, 6)]
    with pytest.raises(ValueError, match="leaves the image"):
        planes.crop(px, 2, 2, 4, 3, (5, 5))


def test_box_mean_of_a_small_image(spark, cut):
    """Above the end of a row that is cut off, pixels of that row count though none lies in the same column."""
    equals_sql(spark, cut(330), "box_mean_2d")


def test_box_mean_with_holes(spark):
    from veritile.operators import planes

    r = np.random.default_rng(5)
    at = {(int(y), int(x)): int(v) for y, x, v in r.integers(0, (12, 17, 256), (90, 3))}
    px = spark.createDataFrame([(7, *p, v) for p, v in at.items()], "image_id long, y int, x int, v int")
    got = {(q["y"], q["x"]): q["m"] for q in planes.box_mean(px, 5).collect()}
    want = {(y, x): np.mean([v for (b, a), v in at.items() if abs(b - y) <= 2 and abs(a - x) <= 2]) for y, x in at}
    assert got.keys() == want.keys() and np.allclose([got[p] for p in want], list(want.values()))


def test_high_pass_with_holes(spark, tmp_path):
    """Pixels on either side of a missing block are no neighbours."""
    d = str(tmp_path)
    spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id not in (28, 77, 78)").write.parquet(f"{d}/embeddings.parquet")
    equals_sql(spark, d, "noise_highpass")


def test_block_copies_of_a_small_image(spark, cut):
    """Blocks that lack pixels are no blocks, and the covered share is of the size that all images have."""
    assert (equals_sql(spark, cut(340), "engine_block_copies")["score"] > 0).all()


def test_error_levels_of_a_small_image(spark, cut):
    equals_sql(spark, cut(340), "engine_error_levels")


@pytest.mark.parametrize("n", [256, 282, 340])
def test_color_filter_of_a_small_image(spark, cut, n):
    """No whole block: no row.  Three: assessed, as in the SQL."""
    equals_sql(spark, cut(n), "engine_color_filter")


@pytest.mark.parametrize("n", [256, 282, 340])
def test_noise_levels_of_a_small_image(spark, cut, n):
    equals_sql(spark, cut(n), "engine_noise_level")


@pytest.mark.parametrize("tiled", [False, True])
def test_missing_pixels_are_not_black(tiled):
    """What lies in the missing part changes nothing, in one piece or in tiles; without a mask it does."""
    from tests import images
    from veritile import config
    from veritile.plans import engine

    a, b = images.noise(256, 42), images.noise(256, 42)
    there = np.ones((256, 256), bool)
    there[128:, 96:] = False
    b[~there] = 0
    cfg = config.default()
    for name in ("cfa", "noiseLevel"):
        cfg[name] = cfg[name] | {"blockSize": 16}
    only = {"ela", "clone", "cfa", "noiselevel"}
    run = lambda px, mask: engine.analyze(engine.A.Image(b"", "ppm", px, mask), cfg, only, forced_tile=128 if tiled else None, no_tiling=not tiled)
    cfg["cloneDetection"] = cfg["cloneDetection"] | {"featureMatchingEnabled": False}
    assert run(b, there) == run(b.copy(), there.copy()) and run(b, None) != run(b, there)
    assert run(a, there) == run(b, there)
