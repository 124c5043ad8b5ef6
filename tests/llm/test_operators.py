"""The training-data operators against brute force, SQL, round trips and held-out labels, on small tables with odd rows."""

import collections
import gzip
import hashlib
import re
import time

import duckdb
import numpy as np
import pytest

from gaugeloom.llm import bytehash, components, digest, html_blocks, licences, mixing, quality, queries, setjoin, templates, toxicity, urlfilter, warc

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "x", None, "a", 1), (3, "x", None, "a", 1), (4, "word " * 3000, "en", "b", 15000), (5, "É à 東京 \x00 end", "fr", "", 12), (None, "no id here at all", "en", "a", 17)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ODD], DOCS + ", score string, size int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = queries.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))


def test_html():
    page = """<html><head><title>t</title></head><body><header>Site</header><ul class="menu"><li><a href=x>One</a></ul><div><h2>Title here</h2><p>A long first paragraph with <b>bold</b> text &amp; signs that goes on for a while.</p>
    <div class=ad>BUY</div><p>Short.</p><p>Another long paragraph, which follows the advert and ends the article for good.</p></div><div id="comments"><p>I like this a lot, thank you!</p></div><script>var a = "</p>";</script></body>"""
    assert html_blocks.main_text(page) == "Title here A long first paragraph with bold text & signs that goes on for a while. Short. Another long paragraph, which follows the advert and ends the article for good."
    assert [html_blocks.main_text(x) for x in (None, "", "<p>x", "<script>never closed", "a < b")] == ["", "", "x", "", "a < b"]


def test_html_article_elements_are_weighed():
    story = "This is the story of the page, told in some words that go on for a while. " * 5
    card = "<article><h3>Another story</h3></article>"
    assert html_blocks.main_text(f"<body><div><p>{story}</p><p>{story}</p></div>{card}</body>").split() == (story * 2).split()
    assert html_blocks.main_text(f"<body><article><p>{story}</p></article><div>A line without.</div></body>").split() == story.split()


def test_html_keeps_all_text_of_a_container():
    long, end = "Many words of a long paragraph. " * 60, "The last words of it. " * 9
    advert = "<div class=ad><p>Buy</p><p>it</p><p>now</p><p>here</p></div>"
    assert html_blocks.main_text(f"<body><div><p>{long}</p>{advert}<p>{end}</p>{advert}<p>Short end.</p></div></body>").split() == (long + end + "Short end.").split()
    assert html_blocks.main_text(f'<body><div class="layout has-sidebar"><p>{long}</p>{advert}</div></body>').split() == long.split()
    assert html_blocks.main_text("<body><div class=menu><p>Menu</p></div><p>Text.</p></body>") == "Text."


def test_html_line_blocks_decide():
    """Without tags that mark an article, the blocks between surges and dives are the text; weights move them, tags alone don't."""
    para = "<p>Some words of a paragraph that is part of the text and long enough to count.</p>"
    card = "<div><p>A teaser of another story</p></div>"
    gap = "".join(f'<div><a href="/{i}">Another page {i}</a></div>' for i in range(4))
    page = f"<body>{card}{gap}<div>{para * 6}</div>{gap}{card}</body>"
    text = re.sub("<[^>]*>", " ", para * 6).split()
    assert html_blocks.main_text(page).split() == text
    assert html_blocks.main_text(page, html_blocks.Params(surge=10**6, share=0)).split() != [] and html_blocks.blocks_of([0, 0, 5, 90, 0, 0, 0, 80, 1], [0] * 9) == [(1, 4, 95), (5, 9, 81)]
    assert html_blocks.blocks_of([90, 90, 90], [0, 1, 1]) == [(0, 1, 90), (1, 3, 180)]
    story = f"<article>{para * 3}</article>"
    assert html_blocks.main_text(f"<body>{story}<div>{para * 30}</div></body>").split() == re.sub("<[^>]*>", " ", para * 33).split()
    assert html_blocks.main_text(f"<body><article><p>Short card here.</p></article>{gap}<div>{para * 12}</div></body>").split() == text * 2


@pytest.mark.parametrize("unit, end", [("<p class='", ""), ('<x ">" ', "'"), ("<div>x", ""), ("<", ""), ("<!--", ""), ("&", ""), ("<script></script ", ""), ("<p></p><center>", ""), ("<div class=ad><article>", "")])
def test_html_takes_linear_time(unit, end):
    times = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_blocks.main_text(unit * n + end)
        times.append(time.process_time() - began)
    assert times[1] < 5 and times[1] < 10 * times[0] + 0.2


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x", 3), (1, "u", None, "x", 3), (2, None, "<p>a  b\xa0&amp; c<p>d", "x", 3), (None, "v", "", None, 3), (4, "w", "<article>" + "<p>word word</p>" * 40_000, None, 0)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text[:20], r.n_chars) for r in html_blocks.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "a b & c d", 9), (None, "v", "", 0), (4, "w", ("word " * 80_000)[:20], 5 * 80_000 - 1)], key=str)
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_archives_round_trip_and_lookup(spark):
    pages = spark.createDataFrame([(3, "http://B.org/x", "same"), (1, "https://a.b.org/y?q=1", "same"), (2, "http://B.org/x", None), (7, None, ""), (9, "http://c.org/é ü", "ä" * 5000)], "page_id long, url string, html string")
    directory = warc.build_index(warc.write_archives(pages), block_lines=2)
    got = {r.page_id: r for r in warc.read_back(directory, payloads=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 7: ("revisit", 2), 9: ("response", None)}
    assert bytes(got[9].payload) == ("ä" * 5000).encode() and got[3].payload_bytes == 4 and got[9].url == "http://c.org/é ü"
    index = warc.sorted_directory(directory)
    assert sorted(r["page_id"] for r in warc.lookup(index, "http://b.org/x")) == [2, 3]
    assert warc.lookup(index, "http://nowhere.org/") == [] and len(index) == 3
    assert warc.parse(gzip.decompress(gzip.compress(warc.record(0, "u", b"p", warc.digest_of(b"p"), None))))["page_id"] == 0


def test_fingerprints(spark, odd, empty):
    texts = [t or "" for _, t, *_ in ODD[:-1]]
    got = digest.compare_with_edits(odd, partitions=3).collect()
    rows = sorted(((r[0] if r[0] is not None else -(1 << 63)), r[1] or "", r[0]) for r in ODD)
    expected = collections.Counter((i, hashlib.sha256(digest.edited_text(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (_, t, i) in enumerate(rows))
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == expected
    assert digest.compare_with_edits(empty).count() == 0
    a = digest.fingerprints(texts)
    assert a[2] == a[3] and digest.likeness(a, a).min() == 1
    long = digest.fingerprints(["abc def ghi " * 50, "abc def ghi " * 50 + "tail", "zq xv kj wy " * 50])
    assert digest.likeness(long[:1], long[1:2])[0] > digest.likeness(long[:1], long[2:])[0]


def test_urls(spark):
    urls = ["http://A.net/x", "https://Sub.Example.NET/en/1", "http://example.com/de/9", "http://m.q.org/fr/1?a", "http://good.net", "no scheme", None, "http://x.casino-win.example.org/en/1", "http://tree.example.org/en/1"]
    got = [tuple(r)[1:5] for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got[:4] == [("a.net", "/x", "net/", "block"), ("sub.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/9", "example.com/de/", "block"), ("m.q.org", "/fr/1", "org/fr/", "allow")]
    assert got[4][:3] == ("good.net", "", None) and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][3] == "block" and got[8][3] == "allow"


def test_toxicity_generalises_to_unseen_forms():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioustrnl"), 5)) for _ in range(400)]
    make = lambda *extra: " ".join([*rng.choice(words, 60), *extra])
    bad = [make(f"zorgbl{x}") for x in ("ing", "ed", "er", "es")] * 15
    model = toxicity.train(bad + [make() for _ in range(60)], np.array([1] * 60 + [0] * 60), steps=60)
    scores = model.scores([make("zorgblich"), make(), "", "..."])
    assert scores[0] > 0.7 and scores[1:].max() < 0.5


def test_classifiers_take_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for kind in (quality, toxicity):
        assert kind.classify(odd, labels).count() == len(ODD) and kind.classify(empty, labels).count() == 0
        assert all(0 <= r.score <= 1 for r in kind.classify(odd, labels.limit(0)).collect())


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


def test_templates(spark, odd, empty):
    item = "A train leaves the old station with 30 passengers and 12 kg of mail while Bob waits for 30 minutes."
    other = item.replace("30", "45").replace("12 kg", "7 lb").replace("Bob", "Alice")
    broken = item.replace("30 passengers", "45 passengers").replace("30 minutes", "50 minutes")
    docs = spark.createDataFrame([(1, "Intro text. " + item), (2, "Before it, " + other + " After."), (3, broken), (4, "Nothing of the kind is written here at all, not once."), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, ""), (2, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in templates.contaminated(docs, bench).collect()) == [(1, 0), (2, 0)]
    assert templates.contaminated(odd, bench).count() == 0 == templates.contaminated(empty, bench).count() == templates.contaminated(docs, bench.limit(0)).count()


def found_by(spark, item, *texts):
    """Which of the texts hold the item."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return sorted(r.doc_id for r in templates.contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect())


def test_templates_split_passages_and_conflicts(spark):
    words = "while walking along a quiet river bank every morning some people count small grey birds that rest under old willow trees near water before going back home again for tea".split()
    item = " ".join(words)
    put = " ".join([*words[:15], "quite", *words[15:]])
    short = words[:20]
    changed = " ".join([*short[:10], "odd", *short[11:]])
    assert found_by(spark, item, put, " ".join([*words[:15], *words[16:]]), " ".join(words[:12])) == [0, 1]
    assert found_by(spark, " ".join(short), changed, " ".join(short[:9])) == [0]
    item = "a farmer sells 3 apples and keeps another 5 pears in some wooden box behind an old barn until market day comes around"
    assert found_by(spark, item, item.replace("3", "4").replace("5", "4"), "nothing of that kind here") == [0]
    item = "a clerk counts 30 letters in one grey box and then walks along a very long road until evening comes so that people may read them at home with 30 friends who wait"
    assert found_by(spark, item, item.replace("30 friends", "31 friends")) == [0]


@pytest.mark.parametrize("item", ["What is 12 plus 7?", "Compute 12 + 7 * 3.", "Who wrote War and Peace?", "The Old Man And His Very Long Journey To London", "WHO WAS THE FIRST KING OF ALL ENGLAND", "What"])
def test_templates_find_any_item_in_its_own_words(spark, item):
    assert found_by(spark, item, f"Some text - {item} More text.", "some text " + item.lower(), "What else is 12 for", "no such thing") == ([0, 1, 2] if item == "What" else [0, 1])


def test_templates_take_names_that_begin_sentences(spark):
    item = "Tom has 3 apples and buys 5 more. Tom gives 2 apples to Anna. How many apples has Tom now?"
    other = item.replace("Tom", "Peter").replace("Anna", "Maria").replace("3", "7")
    question = "What is the sum of all even numbers under 50?"
    assert found_by(spark, item, other, "Tom has a house and Anna has none. How many people live there now?") == [0]
    assert found_by(spark, question, "Question - " + question.replace("50", "90")) == [0]


def test_licences(spark, odd):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2019 Jane Doe\n\n" + licences.KNOWN["MIT"].upper().replace("LICENSE", "LICENCE").replace('"', "“")
    docs = spark.createDataFrame([(1, mit), (2, mit + " and more"), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.scan(docs).collect()} == {1: "MIT", 2: None, 3: None}
    assert licences.scan(odd).count() == len(ODD)


def test_licence_notices_within_texts(spark, tmp_path, empty):
    assert all(any(m in t.lower() for m in licences.MARKS) for t in licences.KNOWN.values())
    apache, gpl = (licences.KNOWN[x] for x in ("Apache-2.0 notice", "GPL-3.0 notice"))
    mit = licences.KNOWN["MIT"].replace("\n\n", "\n")
    texts = [f"A text.\n{apache}\nMore of it.\n  {gpl.upper()}  ", f"Head\n\n{mit}\n \nTail", f"It says: {apache}", None, licences.KNOWN["Unlicense"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan(docs).collect()}
    assert got == {0: (None, "Apache-2.0 notice,GPL-3.0 notice"), 1: (None, "MIT"), 2: (None, ""), 3: (None, ""), 4: ("Unlicense", "")}
    (tmp_path / "Odd-1.0.txt").write_text("Do as you like.")
    own = licences.read_known(spark, str(tmp_path))
    assert [(r.licence, r.notices) for r in licences.scan(spark.createDataFrame([(1, "do as you LIKE"), (2, "x\nDo as you like!")], "doc_id long, text string"), own).orderBy("doc_id").collect()] == [("Odd-1.0", "Odd-1.0"), (None, "Odd-1.0")]
    assert licences.scan(empty).count() == 0


def test_licences_wrapped_before_copyright(spark):
    isc = licences.KNOWN["ISC"].replace("above copyright", "above\n * copyright")
    bsd = licences.KNOWN["BSD-3-Clause"].replace("above copyright", "above\n   copyright").replace("the copyright holder", "the\n copyright holder").replace("THE COPYRIGHT", "THE\n# COPYRIGHT")
    mit = licences.KNOWN["MIT"].replace("sublicense", "sub-license")
    notices = ["Copyright (c) 2019 Jane Doe", "Copyright 2001-2004, The Authors", "* Copyright: Jane Doe", "Copyright Jane Doe <j@example.org>", "(c) Jane Doe", "Portions copyright Jane Doe"]
    texts = [isc, bsd, mit, isc.replace("above\n * copyright notice", "above\n * copyright\n * notice"), *(n + "\n" + isc for n in notices)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licence for r in licences.scan(docs).orderBy("doc_id").collect()] == ["ISC", "BSD-3-Clause", "MIT"] + ["ISC"] * 7


def brute(rows, k, percent):
    word, sets = re.compile(r"[^\x20\x09-\x0D]+"), {}
    for i, t in rows:
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) > 0 and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_set_join_equals_brute_force(spark, k, percent):
    rng = np.random.default_rng(k)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(4, 150))]
        for _ in range(rng.integers(1, 7)):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 4)):
                copy[at] = f"e{rng.integers(0, 9999)}"
            texts.append(" ".join(copy))
    texts += ["", None, "one", "One", "one two", texts[0]]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_set_join_of_a_large_group_of_near_copies(spark, k, percent):
    """A hot group whose members are close to the threshold, long texts, and names of classes that are not unique."""
    rng = np.random.default_rng(percent)
    base = [f"w{x}" for x in rng.integers(0, 900, 160)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in rng.integers(0, len(copy), rng.integers(0, 7)):
            copy[at] = f"e{rng.integers(0, 6)}"
        texts.append(" ".join(copy))
    long = [f"w{x}" for x in rng.integers(0, 900, 6000)]
    texts += [" ".join(long), " ".join([*long[:3000], *long[3250:]]), " ".join(long[:5000]), *[" ".join(base)] * 20]
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute(rows, k, percent)
    for bits in (63, 4):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join_components(table, k, percent, bits).collect()} == expected


def test_set_join_on_odd_and_empty_tables(spark, odd, empty):
    assert setjoin.join_components(empty, 3, 90).count() == 0
    got = setjoin.join_components(odd, 3, 90).collect()
    assert len(got) == len(ODD) and [r.component_id for r in got if r.doc_id is None] == [None]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 40), (None, 1)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), local_edges=2).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30}


def test_mix(spark, odd, empty):
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == len(ODD)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    taken = got.groupby(got.doc_id % 3).agg({"taken": "sum", "target": "first"})
    assert (abs(taken.taken - taken.target) <= 5).all() and (got.taken <= 3 * got["size"]).all()


def test_words_hash_alike_in_any_batch():
    one, at = bytehash.words(["The  cat\tsat", "", "cat"])
    assert list(at) == [0, 3, 3, 4] and one[1] == one[3] == bytehash.words(["CAT"])[0][0]


def mixed_by_hand(rows, unit=1_000_000, phases=50):
    """{(doc_id, source, size): sorted copies} of rows (doc_id, text, source), by the definition: halving for lambda, one ordering of each source."""
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in docs if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(size.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    out = collections.defaultdict(list)
    for s in names:
        own = sorted(((n, hashlib.md5(str(i if i is not None else "").encode()).hexdigest(), i) for i, x, n in docs if x == s), key=lambda d: (d[0], d[1]))
        sizes = np.array([d[0] for d in own], float)
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (sizes * np.minimum(3, np.exp(np.minimum(mid * sizes, 700)))).sum() < target[s] else (lo, mid)
        rates = np.full(len(own), 3 * unit) if size[s] and target[s] >= 3 * size[s] * (1 - 1e-12) else np.round(np.minimum(3, np.exp(np.minimum(lo * sizes, 700))) * unit).astype(int) * (target[s] > 0)
        upto = np.cumsum(rates)
        tried = []
        for f in [(2 * k + 1) * unit // (2 * phases) for k in range(phases)]:
            copies = (upto + f) // unit - (upto - rates + f) // unit
            tried.append((abs((copies * sizes).sum() - target[s]), f, (copies * sizes).sum() - target[s], copies))
        _, _, excess, copies = min(tried, key=lambda t: t[:2])
        can = [(abs(abs(excess) - d[0]), d[0], k) for k, d in enumerate(own) if (copies[k] > 0 if excess > 0 else copies[k] < 3) and abs(abs(excess) - d[0]) < abs(excess)]
        if can:
            copies[min(can)[2]] -= int(np.sign(excess))
        for d, c in zip(own, copies):
            out[d[2], d[0]].append(int(c))
    return {k: sorted(v) for k, v in out.items()}, target


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_the_definition(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, 60)) if rng.random() > 0.05 else None, " ".join(["w"] * int(rng.integers(0, 40) ** (1 + (rng.random() < 0.1)))), [None, "", "a", "b", "é"][min(4, int(rng.exponential(1.2)))]) for _ in range(250)]
    rows += [(7, "same words here", "a")] * 40 + [(8, None, "b"), (9, "", "z")]
    got = mixing.mix(spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], "doc_id long, text string, source string, rate string, place int")).collect()
    found = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        found[r.doc_id, r.size].append(r.copies)
    expected, target = mixed_by_hand(rows)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def test_mix_tilts_rates_by_size(spark):
    rows = [(i, "w " * (1 + i % 50), "abc"[i % 3]) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "size", "rate").collect()
    for s in (0, 2):  # b keeps its size
        lams = [np.log(r.rate) / r.size for r in got if r.doc_id % 3 == s and 0 < r.rate < 3 and r["size"] > 10]
        assert np.ptp(lams) < 1e-5 and len({r.rate for r in got if r.doc_id % 3 == s}) > 10
