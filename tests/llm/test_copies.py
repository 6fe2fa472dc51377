"""Large groups of near copies in the Jaccard join: the pairs met, and results against plain Python."""

import random

from brute import brute_components

from lectern.llm import jaccard


def edited_copies(n, seed=11):
    """(doc_id, text) of copies of one text, each with edits of its own, so that many link with few others only."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(90)]
    rows = [(n // 2, " ".join(base))]
    for i in (i for i in range(n) if i != n // 2):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            w[rng.randrange(len(w))] = f"own{i}"
        rows.append((i, " ".join(w)))
    return rows


def test_pairs_met_grow_with_the_copies(spark, monkeypatch):
    met = []
    whole = jaccard._nearly_link

    def counted(pairs, *rest):
        met.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(jaccard, "_nearly_link", counted)
    totals = []
    for n in (200, 800):
        met.clear()
        rows = edited_copies(n)
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert sorted(map(tuple, got.collect())) == brute_components(rows)
        totals.append(sum(met))
    assert totals[1] <= 6 * totals[0]


def test_lists_of_the_same_sets_go_once(spark):
    rows = [(s, i, 0, 0, True) for s, ids in {1: (4, 5), 2: (5, 4), 3: (4, 5, 6), 4: (7, 8), 5: (6, 4, 5)}.items() for i in ids] + [(1, 4, 0, 0, False)]
    got = jaccard._unlike(spark.createDataFrame(rows, jaccard.LISTS)).collect()
    assert sorted(map(tuple, got)) == [(1, 4), (1, 5), (3, 4), (3, 5), (3, 6), (4, 7), (4, 8)]
