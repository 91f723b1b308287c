"""The fit of the scores looks at all training words in every round."""

import numpy as np

from veritile.llm import lattice


def test_fit_is_that_of_all_words(spark):
    path = lattice.vocabulary_path()
    often = [f"a{k}" for k in range(20_000)]
    rare = [f"thing{k}ing" for k in range(500)]
    counted = spark.createDataFrame([(w.encode(), 2, 2) for w in often] + [(w.encode(), 1, 1) for w in rare] + [(b"unseen", 0, 1)], "word binary, c long, n long")
    score = lattice.vocabulary_scores(path)
    every = lattice.Lattice(often + rare, path)
    for _ in range(lattice.ROUNDS):
        score = lattice._normalized(every.expected(score), path)
    assert np.allclose(lattice.fit(counted, path=path), score, atol=1e-6)
