"""What the set join moves: sets of candidates that may be similar, and rows that may go."""

from __future__ import annotations

import random

import numpy as np

from gaugeloom.llm import setjoin, shared


def _texts(n: int, shared_words: int = 8, words: int = 60):
    """Texts of words of their own with one passage that all have, and a near copy of the first."""
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(shared_words))
    texts = [" ".join([*(f"w{draw.randrange(10**9)}" for _ in range(words - shared_words)), passage]) for _ in range(n)]
    return [*texts, texts[0] + " more", texts[0] + " more"]


def test_sets_of_candidates_that_are_not_similar_are_not_written(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(_texts(300))), "doc_id long, text string")
    rows, plain = {}, setjoin.written

    def counted(df, name):
        out = plain(df, name)
        rows.setdefault(name, out.count())  # the first time: sets of large open groups are written later
        return out

    monkeypatch.setattr(setjoin, "written", counted)
    monkeypatch.setattr(setjoin, "common_shingles", lambda *a, **k: np.zeros(0, np.uint64))  # a sample that doesn't know the passage
    got = {r.doc_id: r.component_id for r in setjoin.join_components(docs, 5, 80).collect()}
    assert got == {i: 0 if i >= 300 else i for i in range(302)}
    assert rows["sketches"] > 40 and rows["hashes"] <= 4


def test_sketches_reject_no_similar_sets():
    draw = np.random.default_rng(7)
    rejected = 0
    for size in (1, 2, 5, 63, 64, 65, 130, 700, 3000):
        base = draw.integers(0, 2**63, size).astype(np.uint64)
        for changed in sorted({0, 1, size // 9, size // 5, size // 3, size}):
            for more in (0, size // 8):
                x = np.unique(base)
                y = np.unique(np.concatenate([base[changed:], draw.integers(0, 2**63, changed + more).astype(np.uint64)]))
                if not len(y):
                    continue
                maybe = setjoin._maybe_similar(80)(*((len(s), np.frombuffer(setjoin._sketch(s), np.uint64)) for s in (x, y)))
                assert maybe or not setjoin._similar_sets(80)((x,), (y,))
                rejected += not maybe
    assert rejected > 20


def test_sieve_passes_every_key_and_few_others(spark):
    keys = spark.range(0, 100_000, 2).selectExpr("id * 1000003 - 7 as key").unionByName(spark.sql("select cast(null as long) as key"))
    table = spark.range(100_000).selectExpr("id", "id * 1000003 - 7 as key").withColumn("passes", shared.sieve(keys, 50_000)("key"))
    n = {r.odd: r.n for r in table.filter("passes").groupBy((table["id"] % 2).alias("odd")).count().withColumnRenamed("count", "n").collect()}
    assert n[0] == 50_000 and n.get(1, 0) < 2_500
    narrow = spark.range(100).selectExpr("id as key").withColumn("passes", shared.sieve(spark.range(100).selectExpr("id as key"), 100, 64)("key"))
    assert narrow.filter("passes").count() == 100


def test_rows_part_the_same_way_without_broadcasts(spark, monkeypatch):
    texts = [*_texts(30), None, "", "a b"]
    docs = spark.createDataFrame([(i % 25, t, "x") for i, t in enumerate(texts + texts[:5])], "doc_id long, text string, lang string")
    listed = lambda: sorted(map(str, setjoin.representatives(docs).collect()))
    expected = listed()
    assert 30 <= len(expected) < docs.count()
    monkeypatch.setattr(setjoin, "BROADCAST_IDS", 0)
    assert listed() == expected
