"""Importance resampling, whitening and byte-level BPE against plain Python, numpy and the tokenizer library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from gaugeloom.llm import bpe, resampling, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RNG = random.Random(7)
_VOCABULARY = ["alpha", "Beta", "g4mma", "délta", "中文", "x" * 70, "ε" * 40, "a", "zeta9"]
TEXTS = [" ".join(_RNG.choice(_VOCABULARY) for _ in range(_RNG.randrange(120))) for _ in range(150)] + [None, "", "!!", "A-b_C", "y" * 5000, "one,two;three " * 3000, "same words here " * 10, "same words here " * 10]
TARGET = ["alpha beta délta", "zeta9 zeta9 a", None, "", "中文 alpha"]


def plain_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, percent, least=20):
    """Sorted (id, n_features, weight, score, rank)."""
    counts = []
    for texts in ([t for _, t in rows], target):
        c = [0] * 10_000
        for t in texts:
            for f in plain_features(t)[1]:
                c[f % 10_000] += 1
        counts.append(c)
    (s, t), (all_s, all_t) = counts, map(sum, counts)
    gain = [math.floor(1000 * math.log((b + 1.0) * (all_s + 10_000.0) / ((a + 1.0) * (all_t + 10_000.0)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        n, found = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f % 10_000] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((r[:5] for r in out), key=str)


@pytest.mark.parametrize("percent,accuracy", [(5, 1000), (37, 1000), (50, 3), (100, 1000), (0, 1000)])
def test_resampling_equals_plain_python(spark, percent, accuracy):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (3, TEXTS[3]), (3, TEXTS[3]), (4, TEXTS[9])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, weight int, rank string").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.resample(docs, target, percent, accuracy=accuracy)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(([*r] for r in got.collect()), key=str) == plain_resample(rows, TARGET, percent)


def test_cutoff_outside_of_the_first_bracket_is_found(spark):
    scored = spark.createDataFrame([(x,) for x in [5] * 400 + [9] * 3 + list(range(100, 700))], "score long")
    values = sorted((r.score for r in scored.collect()), reverse=True)
    for accuracy in (2, 10, 1000):
        for k in (1, 300, 601, 602, 603, 604, 1003):
            low, high, above = resampling.bracket(scored, k, 1003, accuracy)
            assert low <= values[k - 1] <= high and above == sum(v > high for v in values)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    assert [r["rank"] for r in resampling.resample(some, none, 100).orderBy("doc_id").collect()] == [1, None]


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    centred = x - x.sum(axis=0) / len(x)
    values, found = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1], found[:, ::-1]


def test_whitening_equals_the_eigen_decomposition(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) / 4).astype(np.float32)
    rows = [(i, v.tolist(), "k") for i, v in enumerate(good)] + [(900, None, "k"), (901, [float("nan")] * 40, "k"), (902, [None] + [0.5] * 39, "k"), (903, [float("inf")] + [0.5] * 39, "k"), (7, good[7].tolist(), "again")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string").repartition(3)
    got = whitening.whiten(table).toPandas()
    kept = np.concatenate([good, good[7:8]])
    x, centred, values, found = plain_whitening(kept)
    assert len(got) == 301 * 32 and set(got.vec_id) == set(range(300)) and (got.n == 301).all()
    w = got.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    ref = centred[:300] @ found[:, :32] / np.sqrt(values[:32])
    assert np.abs(w - ref * np.sign((ref * w).sum(axis=0))).max() < 1e-8
    deviation = ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert (got.drop_duplicates("vec_id").set_index("vec_id").deviation.sort_index().to_numpy() == deviation[:300]).all()
    assert np.allclose(got.groupby("component").explained.first(), values[:32] / values.sum(), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_whitening_of_odd_tables(spark):
    def of(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))

    assert of([]).count() == of([(1, None)]).count() == of([(1, [0.5, 1.0])]).count() == of([(1, [0.5]), (2, [0.5])]).count() == of([(1, []), (2, [])]).count() == 0
    line = of([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (None, [3.0, 6.0])]).collect()  # rank one
    assert len(line) == 3 and {r.component for r in line} == {1} and sorted(round(r.whitened, 6) for r in line) == [-1.224745, 0.0, 1.224745]
    short = of([(1, [1.0]), (2, [1.0, 1.0]), (3, [2.0, 0.0])]).collect()  # what the first lacks counts as 0
    assert len(short) == 6
    with pytest.raises(Exception, match="too large"):
        of([(1, [1e300]), (2, [0.0])]).collect()


def test_small_eigenvalues_keep_their_precision():
    basis, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))
    values, vectors = whitening.components(np.diag([1e6, 1.0, 1e-4, 3.0, 3.0, 0.0]))
    assert np.allclose(values, [1e6, 3, 3, 1, 1e-4], rtol=1e-12) and vectors.shape == (6, 5)
    v = (basis * [5.0, 4.0, 3.0, 2.0, 1.0, 0.5]) @ basis.T
    values, vectors = whitening.components(v)
    assert np.allclose(values, [5, 4, 3, 2, 1, 0.5], rtol=1e-13) and np.allclose(np.abs(vectors.T @ basis), np.eye(6), atol=1e-12)
    factor = whitening.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v) and (np.sort((factor == 0).sum(axis=1)) == np.arange(6)).all()


RANK_FILE = pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(RANK_FILE))


@pytest.fixture(scope="module")
def library(vocabulary):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def _odd_texts():
    rng = random.Random(5)
    alphabet = "aab's'td  \n\t 　 1²é中文’\x1c'll've'REÉ\U0001f600xyz<|endoftext|>"
    return ["", "'", "''s", "don't it's'store", "  'x", " 't", "a\n\nb", "x  ", "  ", "we'll'd've", "'lls 's't"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)]


def test_bpe_equals_the_library(vocabulary, library):
    texts = _odd_texts()
    assert [x.tolist() for x in vocabulary.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_of_every_character(vocabulary, library):
    text = "".join(f"a{chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    parts = [text[i : i + 60_000] for i in range(0, len(text), 60_000)]
    assert all(x.tolist() == library.encode_ordinary(t) for x, t in zip(vocabulary.encode(parts), parts))


def test_bpe_of_long_texts_in_pieces(vocabulary, library, monkeypatch):
    texts = [" ".join(_odd_texts()), "a" * 5000, " " * 5000 + "x", "word  " * 2000, "\n \n" * 3000]
    whole = [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "PIECE_CHARS", 700)
    cut = [list(bpe.pieces(t, 700)) for t in texts]
    assert ["".join(p) for p in cut] == texts and len(cut[0]) > 50
    monkeypatch.setattr(bpe.Vocabulary, "encode", bpe.Vocabulary.encode)
    monkeypatch.setattr(bpe, "pieces", lambda t, most=700, f=bpe.pieces: f(t, most))
    assert [x.tolist() for x in vocabulary.encode(texts)] == whole


def test_perfect_hash_is_minimal_and_refuses_others(vocabulary):
    slots = vocabulary.hash(bpe.span_hashes(vocabulary.blob, vocabulary.start, vocabulary.start + vocabulary.length))
    assert (slots == np.arange(len(vocabulary.ranks))).all()
    with pytest.raises(ValueError, match="one hash"):
        bpe.PerfectHash(np.array([3, 3], np.uint64))


def test_bpe_of_a_table(spark, vocabulary, library):
    texts = [None, "", "Hello, world", "Hello, world", "\u0000x" * 10, "l" * 9000]
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)] + [(None, "no id", "x"), (2, "again", "x")], "doc_id long, text string, ids string").repartition(3)
    encoded = bpe.encode(docs, vocabulary.ranks)
    assert encoded.columns == ["doc_id", "ids"]
    got = bpe.decode(encoded, vocabulary.ranks).collect()
    rows = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got)
    source = [(str(i), t or "") for i, t in enumerate(texts)] + [("None", "no id"), ("2", "again")]
    assert rows == sorted((i, library.encode_ordinary(t), t.encode()) for i, t in source)
    assert bpe.encode(docs.limit(0), vocabulary.ranks).count() == 0
    with pytest.raises(Exception, match="no id 99999999"):
        bpe.decode(spark.createDataFrame([(1, bytearray(np.array([99999999], "<u4").tobytes()))], "doc_id long, ids binary"), vocabulary.ranks).collect()


def test_new_queries_cover_their_tables(spark):
    from gaugeloom.llm import queries

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.op11_importance_resampling(spark, sf).count() == n == queries.op13_byte_bpe(spark, sf).count()
