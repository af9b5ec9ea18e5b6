"""Pairs of similar sets against all pairs; few others are compared."""

import random

import pytest

from docloom.operators import dedup


def made() -> dict[int, set[str]]:
    rnd = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    sets = {i: {*rnd.sample(common, 40), *(f"r{i}_{j}" for j in range(rnd.randint(0, 25)))} for i in range(300)}
    for i in range(300, 340):  # near copies of sets of all sizes, some of over a thousand tokens
        whole = [f"w{i}_{j}" for j in range(rnd.choice([1, 3, 20, 300, 1500]))]
        sets[2 * i], sets[2 * i + 1] = set(whole), set(rnd.sample(whole, max(1, int(len(whole) * rnd.uniform(0.5, 1))))) | {f"x{i}"}
    return {i: s for i, s in sets.items() if list(sets.values()).count(s) == 1}


@pytest.mark.parametrize("threshold,pairs", [(0.6, 2_000_000), (0.8, 50), (1 / 3, 2_000_000)])
def test_pairs_are_those_of_all_pairs(spark, monkeypatch, threshold, pairs):
    monkeypatch.setattr(dedup, "PAIRS", pairs)
    sent, plain = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: sent.append(plain(df)) or sent[-1])
    sets = made()
    got = dedup.similar_pairs(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, ts array<string>").repartition(3), threshold).collect()
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) >= 10
    compared = [x.count() for x in sent if x.columns == ["a", "b"]]
    assert len(compared) == 1 and len(want) <= compared[0] < len(want) + 200 + len(want) // 2


def test_minhash_compares_hardly_any_but_similar_sets(spark, monkeypatch):
    sent, plain = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: sent.append(plain(df)) or sent[-1])
    sets = made()
    got = dedup.minhash_pairs(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, ts array<string>").repartition(3), 0.8).collect()
    want = {(a, b): 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    assert {(r.a, r.b): pytest.approx(r.distance) for r in got} == want
    compared = [x.count() for x in sent if x.columns == ["a", "b"]]
    assert len(compared) == 1 and compared[0] < 2000  # of 70000 pairs
