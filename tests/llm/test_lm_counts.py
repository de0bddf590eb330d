"""Scores with counts over all rows, against plain counting."""

import math
from collections import Counter

import pytest

from cubeloom.llm import lm_scoring, storage

TEXTS = ["a b c d", "a b c d", "A b  c e a b c", "z", None, "", "q q q q q", "x y x y x", "a b"] + [f"w{i % 7} w{i % 3} a b w{i}" for i in range(40)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_counts_of_all_rows(spark, order):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.stupid_backoff(docs, order=order, block_bytes=200, bucket_bytes=300, leave_one_out=False).collect()}
    words = [(t or "").lower().split() for t in TEXTS]
    count = Counter(tuple(w[j : j + n]) for w in words for n in range(1, order + 1) for j in range(len(w) - n + 1))
    size = sum(map(len, words))
    for i, w in enumerate(words):
        score = 0.0
        for j in range(len(w)):
            n = min(j + 1, order)
            gram = tuple(w[j - n + 1 : j + 1])
            score += math.log(count[gram] / (count[gram[:-1]] if n > 1 else size))
        assert math.isclose(got[i]["log_score"], score, rel_tol=1e-9, abs_tol=1e-9)
        assert got[i]["n_backed_off"] == 0 and got[i]["n_words"] == len(w) and (got[i]["score"] is None) == (not w)


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        def __init__(self, conf):
            self.conf = conf

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session({"spark.master": "yarn"}))
    assert storage.shared_dir(Session({"spark.master": "yarn", "spark.checkpoint.dir": "/shared/x/"})) == "/shared/x"
