"""Operators and pipeline stages against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gaugeloom.llm import digest, quality, setjoin, shared, templates, toxicity, urlfilter
from tests.llm.test_operators import brute, mixed_by_hand

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    """The digest of a text, triplet by triplet."""
    data, counts = text.encode(), [0] * 256
    for at in range(len(data) - 4):
        for number, (j, k) in enumerate([(j, k) for j in range(1, 5) for k in range(j + 1, 5)]):
            t = [int(x) for x in digest._TABLE]
            counts[t[t[t[data[at] ^ (37 * number + 11)] ^ data[at + j]] ^ data[at + k]]] += 1
    ordered = sorted(counts)
    codes = [sum(c > ordered[q] for q in (63, 127, 191)) for c in counts]
    length = min(255, round(8 * math.log2(1 + len(data))))
    return bytes([length]).hex() + bytes(codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, 256, 4)).hex(), codes, length


def plain_likeness(a, b):
    (_, ca, la), (_, cb, lb) = a, b
    return 1 - min(512, sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(ca, cb)) + min(32, abs(la - lb))) / 512


def test_fingerprints_equal_plain_ones(spark):
    texts = {7: "one two three four", 9: "", 11: "É" * 40 + " tail", 20: "word " * 300, 21: None, 30: "one two three four!"}
    rows = [(i, t, "x") for i, t in texts.items()]
    got = {r.doc_id: r for r in digest.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string, at string"), partitions=3).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        own, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        a, b, c = (plain_fingerprint(t) for t in (own, edited, following))
        assert (got[i].n_chars, got[i].fingerprint, got[i].edited_fingerprint, got[i].edited_sha256) == (len(own), a[0], b[0], hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == pytest.approx(plain_likeness(a, b)) and got[i].near_next == pytest.approx(plain_likeness(a, c))


def test_fingerprints_of_long_texts_and_repeated_ids(spark):
    long = "".join(chr(97 + (i * i) % 26) for i in range(600_000))
    rows = [(1, long), (2, "a"), (2, "b"), (2, "a"), (None, "first"), (3, long)]
    got = digest.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), partitions=4).collect()
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((i, len(t)) for i, t in rows)
    assert len({r.fingerprint for r in got if r.n_chars == 600_000}) == 1


def test_url_scores_equal_plain_ones(spark):
    weights, bias = urlfilter.trained()
    urls = ["http://casino-WIN.example.org/en/1?q", "https://tree.example.org/", "ftp://é.org/ü#x", None, "no scheme", "http://x"]

    def plain(host, path):
        z, n = 0.0, 0
        for kind, text in ((1, "^" + re.sub("[.-]", "^", host) + "^"), (2, "^" + path.lower().strip("/").replace("/", "^") + "^")):
            data = text.encode()
            for size in (3, 4, 5):
                for at in range(len(data) - size + 1):
                    h = kind * 131 + size
                    for x in data[at : at + size]:
                        h = (h ^ x) * 0x100000001B3 % 2**64
                    z, n = z + weights[(h ^ h >> 29) % urlfilter.DIMENSIONS], n + 1
        return 1 / (1 + math.exp(-(z / math.sqrt(max(1, n)) + bias)))

    for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect():
        m = re.match(r".*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "", re.S)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        assert (r.host, r.path) == (host, path) and r.score == pytest.approx(plain(host, path) if host or path else 0.0)
        assert r.verdict == ("block" if r.score >= 0.5 else "allow") or r.rule
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, host string, score int")).count() == 0
    assert urlfilter.judge(spark.createDataFrame([(1, "http://a.net", "clash", 1)] * 3, "page_id long, url string, host string, score int")).count() == 3


def test_word_scores_equal_plain_ones():
    rng = np.random.default_rng(2)
    table = rng.normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
    model = toxicity.Model(table, -0.5)

    def buckets(word):
        """Of the word itself and of its marked 3- to 5-grams."""
        from gaugeloom.llm.bytehash import buffer_of, span_hashes, spans

        buf, _ = buffer_of([word])
        a, b = spans(toxicity._SEPARATOR[buf])
        out = [int(span_hashes(buf, a, b)[0]) >> (64 - toxicity.BUCKET_BITS)]
        data = b"\0" + word.encode() + b"\0"
        for n in (3, 4, 5):
            for at in range(len(data) - n + 1):
                h = 0
                for j in range(n):
                    h ^= int(toxicity._GRAM[j][data[at + j]])
                mixed = (h ^ h >> 15) * (0x9E3779B1 + 2 * n) % 2**32
                out.append(mixed >> (32 - toxicity.BUCKET_BITS))
        return out

    texts = ["Hello, WORLD it is", "a", "", "é-ü stop", "x" * 40]
    for text, got in zip(texts, model.scores(texts)):
        words = [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower()) if w]
        logits = [np.mean([float(table[b]) for b in buckets(w)]) - 0.5 for w in words] or [-0.5]
        assert got == pytest.approx(1 / (1 + math.exp(-max(logits))), rel=1e-4)
    assert np.allclose(model.scores(["The end. " * 60_000, "The end."]), model.scores(["The end."])[0])


def test_quality_model_equals_plain_equations(spark):
    """Features, normal equations, fold scores and pooled frequencies written out, on rows that Spark deals to several tasks."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    ids = sorted(y)
    x = quality.statistics([text[i] for i in ids])
    t = np.array([y[i] for i in ids], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum(x.var(0), 1e-8)), atol=1e-6)
    z = np.array([[1.0, *np.clip((row - model.mean) / model.scale, -6, 6), *(np.cos(np.clip((row - model.mean) / model.scale, -6, 6) @ model.waves + model.phase) * math.sqrt(2 / quality.FEATURES))] for row in x])
    weight = np.where(t > 0, 0.5 * len(t) / t.sum(), 0.5 * len(t) / (len(t) - t.sum()))
    a = sum(w * np.outer(row, row) for w, row in zip(weight, z)) + np.diag([0.0] + [0.3] * (z.shape[1] - 1)) + 1e-9 * np.eye(z.shape[1])
    expected = np.linalg.solve(a, sum(w * v * row for w, v, row in zip(weight, t, z)))
    assert np.allclose(model.weights, expected, atol=1e-6) and (np.diff(model.values) >= 0).all()
    assert np.allclose(model.scores(x), np.interp(z @ expected, model.steps, model.values), atol=1e-5)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(2, "b")] * 50 + [(2, "a"), (5, "x" * 300), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (5, 0), (8, 0), (None, 1)], "doc_id long, toxic int")
    assert [(r.doc_id, r.text, r.y) for r in shared.training_rows(docs, labels, "toxic", 10, longest=200).orderBy("doc_id").collect()] == [(i, t, y) for i, t, y in ((2, "a", 1), (8, "", 0)) if zlib.crc32(str(i).encode()) % 3 != 1]


def test_same_id_with_two_texts_is_not_added_up(spark):
    words = "while walking along a quiet river bank every morning some people count small grey birds that rest under old willow trees near water".split()
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    halves = spark.createDataFrame([(1, " ".join(words[:11])), (1, " ".join(words[11:])), (2, " ".join(words)), (2, " ".join(words))], "doc_id long, text string").repartition(4)
    assert [(r.doc_id, r.item_id) for r in templates.contaminated(halves, bench).collect()] == [(2, 0)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder of tables with near copies, insults, junk and benchmark items."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeiourstln"), rng.integers(2, 9))) for _ in range(700)]
    sentence = lambda n: (" ".join(rng.choice(words, n)).capitalize() + ".")
    prose = lambda n: " ".join(sentence(int(rng.integers(6, 14))) for _ in range(n))
    items = [" ".join(rng.choice(words, 20)) for _ in range(4)]
    rows, labels = [], []
    for i in range(240):
        kind = i % 8
        if kind == 5:
            text, q, t = "|| @@ ## " * int(rng.integers(10, 60)) + "$$%% !! " * 20, 0, 0
        elif kind == 6:
            text, q, t = prose(4) + f" zorgbl{['ing', 'ed', 'er', 'ish'][i % 4]} " + prose(2), 1, 1
        elif kind == 7:
            text, q, t = prose(3) + " " + items[i % 4] + " " + prose(2), 1, 0
        elif kind == 4 and i > 8:
            base = rows[i - 4][1].split(" ")
            base[int(rng.integers(0, len(base)))] = "changed"
            text, q, t = " ".join(base), 1, 0
        else:
            text, q, t = prose(int(rng.integers(4, 12))), 1, 0
        rows.append((i, text, "en", "abc"[i % 3], len(text)))
        labels.append((i, q, t))
    rows += [(240, None, None, None, 0), (241, "", "en", "a", 0), (None, prose(5), "en", "b", 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_each_stage_equals_its_plain_version(spark, corpus):
    folder, rows, items = corpus
    kept = rows
    read = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = kept, read
        out = shared.written(stage(spark, docs, folder), f"test-{name}")
        if name == "mixing":
            expected, target = mixed_by_hand([(i, t, s) for i, t, _, s, _ in before])
            found = collections.defaultdict(list)
            for r in out.collect():
                found[r.doc_id, r.size].append(r.copies)
            assert {k: sorted(v) for k, v in found.items()} == expected
            break
        assert out.columns == read.columns
        if name in ("toxicity", "quality"):
            kind = toxicity if name == "toxicity" else quality
            model = kind.fit(docs, labels)
            texts = [r[1] or "" for r in before]
            scores = model.scores(texts) if name == "toxicity" else model.scores(quality.statistics(texts))
            limit = toxicity.THRESHOLD if name == "toxicity" else quality.THRESHOLD
            good = [s < limit if name == "toxicity" else s >= limit for s in scores]
            kept = [r for r, g in zip(before, good) if g]
            gone = {r[0] for r, g in zip(before, good) if not g}
            assert gone >= {i for i in range(240) if i % 8 == (6 if name == "toxicity" else 5)} and len(gone) < 45
        elif name == "near_copies":
            groups = brute([(i, t) for i, t, *_ in before if i is not None], 5, 80)
            kept = [r for r in before if r[0] is None or not groups[r[0]][0] or groups[r[0]][1] == r[0]]
            assert len(before) - len(kept) >= 20
        else:
            bare = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()))
            kept = [r for r in before if not any(bare(item) in bare(r[1]) for item in items)]
            assert len(before) - len(kept) >= 20
        assert sorted(out.collect(), key=str) == sorted(map(tuple, kept), key=str)
        read = out


def test_run_applies_all_stages(spark, corpus):
    folder, rows, _ = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert not any(i % 8 in (5, 6, 7) for i in ids if i is not None and i < 240) and len(ids) > 90
    assert sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), rel=0.1) and all(0 <= r.copies <= 3 for r in got)


def test_archives_take_odd_tables(spark):
    from gaugeloom.llm import warc

    def through(rows, **parameters):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, sha int")
        return sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_back(warc.build_index(warc.write_archives(pages, **parameters))).collect()), key=str)

    assert through([]) == []
    same = [(4, "http://a/", "body", "k", 1), (4, "http://b/", "body", "k", 1), (9, None, "body", None, None)]
    kinds = collections.Counter(through(same))
    assert sum(kinds.values()) == 3 and kinds[9, "revisit", 4] == 1 and sum(n for (i, kind, _), n in kinds.items() if i == 4 and kind == "response") >= 1
    assert through([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0)], min_bytes=3) == [(1, "response", None), (2, "response", None)]
    assert through([(1, "http://x/", "é" * 300_000, "", 0)]) == [(1, "response", None)]


def test_set_join_in_a_hot_bucket_of_passages(spark):
    """Many texts that share a long passage, and differ elsewhere: none are linked."""
    rng = np.random.default_rng(9)
    passage = [f"p{x}" for x in range(60)]
    texts = [" ".join([*passage, *(f"w{x}" for x in rng.integers(0, 10**6, 20))]) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:3])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == brute(rows, 5, 80)
