"""The registered keypoints are those of the reference's own limit."""

from collections import Counter

from veritile.functions import features
from veritile.plans import queries
from veritile.plans.registry import QUERIES
from veritile.sources.decode import decode_pnm

FOLDER = "/root/testdata/sf0.001"


def test_keypoints_are_not_cut(spark):
    got = Counter(r["image_id"] for r in QUERIES["feature_keypoints"](spark, FOLDER).select("image_id").collect())
    images = {r["image_id"]: decode_pnm(r["content"])[..., 0].astype(float) for r in queries.image_files(spark, FOLDER).collect()}
    assert got == Counter({i: len(features.keypoints(p)[0]) for i, p in images.items()})
    assert sum(got.values()) > sum(len(features.keypoints(p, 200)[0]) for p in images.values())
