"""Near copies of the pipeline against all pairs."""

import random

from tests.llm.test_operators import plain_components
from veritile.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def plain_near(texts):
    sets = [plain_set(t) for t in texts]
    return [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]


def edited(w, n, r):
    w = list(w)
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{r.randrange(10**9)}"
    return " ".join(w)


def test_near_copies_are_those_of_all_pairs(spark):
    r = random.Random(11)
    texts = [None, "", " \t", "one two", "One  two", "three"]
    common = [f"common{k}" for k in range(40)]
    for k in range(60):
        w = [f"w{k}x{r.randrange(10**6)}" for _ in range(r.choice((6, 40, 120, 300)))] + (common if k % 3 == 0 else [])
        texts += [" ".join(w), *(edited(w, n, r) for n in range(max(1, len(w) // 60), len(w) // 40 + 3))]
    ids = list(range(len(texts)))
    want = plain_components(ids, plain_near(texts))
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS)
    assert sorted(x["doc_id"] for x in simhash.near_dedup_stage(docs).collect()) == sorted(set(want.values()))
    assert 100 < len(set(want.values())) < len(texts) - 60
