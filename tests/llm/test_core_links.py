"""Links of cores against all pairs."""

import random

import pytest

from tessera.llm import subjects as S


def weight(fs):
    return sum(0.1 + f % 3 for f in fs)


@pytest.mark.parametrize("block", [7, 4096])
def test_every_pair_that_meets_the_threshold_is_linked_once(spark, block):
    rng = random.Random(3)
    cores = {n - 60: sorted(rng.sample(range(30), rng.randint(1, 5))) for n in range(120)}
    rows = [(n, fs, [0.1 + f % 3 for f in fs], rng.randint(1, 50)) for n, fs in cores.items()] + [(900, [], [], 1)]
    want = {}
    for a in cores:
        for b in cores:
            x, y = set(cores[a]), set(cores[b])
            if a < b and weight(x & y) / weight(x | y) >= S.SIMILARITY - 1e-12:
                want[a, b] = weight(x & y) / weight(x | y)
    df = spark.createDataFrame(rows, "c long, fs array<long>, ws array<double>, n long")
    found = S.core_links(df, block).collect()
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])): r["similarity"] for r in found}
    assert len(found) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_subjects_spread_over_all_links(spark, monkeypatch):
    """Texts are labelled over the links between any two cores, not over those to frequent ones alone."""
    met = []
    links = S.core_links
    monkeypatch.setattr(S, "core_links", lambda cores: met.append(cores.count()) or links(cores))
    text = "The court and the statute were noted. The appeal was lost in the court."
    documents = spark.createDataFrame([(i, text) for i in range(6)] + [(9, "The board met again.")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, "law"), (9, None)], "doc_id long, subject string")
    S.propagate(spark, documents, labels, ["law"])
    assert met
