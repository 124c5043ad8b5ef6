"""What the set join writes and moves per text, as the corpus grows."""

from __future__ import annotations

import numpy as np
import pytest

from gaugeloom.llm import setjoin

from tests.llm.test_operators import brute


def _passages(n: int, links: int = 3):
    """Texts that share a passage of one of two kinds, and differ elsewhere; the first few have near copies."""
    rng = np.random.default_rng(n)
    texts = []
    for i in range(n):
        words = [*(f"p{i % 2}.{x}" for x in range(60)), *(f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(18, 40))))]
        texts.append(" ".join(words))
        if i < links:
            texts += [" ".join([*words, "more"]), " ".join(["first", *words])]
    return list(enumerate(texts))


def test_pairs_of_a_bucket_are_those_that_sketches_leave_open():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 90).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[int(rng.integers(0, 40)) :], rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64)])) for _ in range(70)]
    sketches = [np.frombuffer(setjoin._sketch(s), np.uint64) for s in sets]
    size, ent = np.array([len(s) for s in sets]), rng.permutation(70).astype(np.int64)
    probe, root = rng.integers(0, 3, 70) == 0, np.where(rng.integers(0, 4, 70) == 0, 7, ent)
    assert len({len(x) for x in sketches}) > 1
    a, b = setjoin._left_open(ent, probe, root, size, sketches, 80)
    maybe = setjoin._maybe_similar(80)
    expected = {(max(ent[i], ent[j]), min(ent[i], ent[j])) for i in range(70) for j in range(i) if root[i] != root[j] and not (probe[i] and probe[j]) and maybe((size[i], sketches[i]), (size[j], sketches[j]))}
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(expected) and 20 < len(expected) < 2000


@pytest.mark.parametrize("middle", [1024, 8])
def test_buckets_are_settled_with_and_without_the_second_index(spark, monkeypatch, middle):
    rows, plain, indexed = _passages(90), setjoin.written, []
    expected = brute(rows, 5, 80)

    def seen(df, name):
        out = plain(df, name)
        if name == "index":
            indexed.append(out.count())
        return out

    monkeypatch.setattr(setjoin, "written", seen)
    monkeypatch.setattr(setjoin, "MIDDLE", middle)
    monkeypatch.setattr(setjoin, "common_shingles", lambda *a, **k: np.zeros(0, np.uint64))  # a sample that doesn't know the passages
    got = setjoin.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert len({c for _, c in expected.values()}) == 90
    assert (indexed == [0]) == (middle == 1024)


def test_turns_give_each_shared_signature_once(spark):
    rows = _passages(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = setjoin.shingles([t for _, t in rows], 5)
    name, scheme, plain = (lambda found: setjoin._digest(found)[0]), setjoin.Scheme(80), {}
    for found in sets:
        band = scheme.band(len(found))
        for b, probe in ((band, False), (band - 1, True)):
            for sig in setjoin.signatures(found, b, scheme, not probe).tolist():
                plain.setdefault(sig, set()).add((name(found), probe))
    expected = sorted(sorted(x) for x in plain.values() if len({ent for ent, _ in x}) > 1)
    none, turns = spark.sparkContext.broadcast(np.zeros(0, np.uint64)), []
    for turn in range(setjoin.TURNS):
        met = {}
        for r in setjoin._buckets(docs, 5, 80, name, none, turn).distinct().collect():
            met.setdefault(r.sig, set()).add((r.ent, r.probe))
        turns.append(met)
    assert not set(turns[0]) & set(turns[1]) and min(map(len, turns)) > 50
    assert sorted(sorted(x) for met in turns for x in met.values()) == expected
