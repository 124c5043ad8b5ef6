"""Captures found by binary search in the directory and the block, against a plain scan."""

import collections

import pytest

from gaugeloom.llm import queries, warc

PAGES = "page_id long, url string, html string"


def test_keys_find_their_records(spark):
    # one url holds a third of the captures and fills blocks of several index files; others lie at the edges of blocks
    rows = [(i, "http://hot.org/x" if i % 3 == 0 else f"http://h{i % 40}.net/p{i % 7}", f"body {i % 50}") for i in range(600)] + [(900, None, None), (901, "", "e"), (902, "no scheme", "n"), (903, "http://ä.org/é", "u")]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    captures = warc.write_archives(pages)
    directory = warc.build_index(captures, block_lines=7)
    assert directory.count() > 80
    sought = ["http://hot.org/x", "http://h3.net/p1", "http://h0.net/p0", "http://nowhere.org/", "http://zzz.zz/", "", "no scheme", "http://ä.org/é", "http://HOT.org:80/x"]
    keys = spark.createDataFrame([(warc.url_key(u), 1) for u in sought + sought[:2]] + [(None, 2)], "key string, offset int")
    got = sorted((r.page_id, r.url) for r in warc.find(keys, directory).collect())
    wanted = {warc.url_key(u) for u in sought} | {""}
    assert got == sorted((i, u or "") for i, u, _ in rows if warc.url_key(u) in wanted)
    index = warc.sorted_directory(directory)
    for url in sought:
        assert sorted(r["page_id"] for r in warc.lookup(index, url)) == sorted(i for i, u, _ in rows if warc.url_key(u) == warc.url_key(url))

    # all keys give what a scan of all blocks gives
    every = collections.Counter(map(tuple, warc.find(captures, directory, payloads=True).collect()))
    assert every == collections.Counter(map(tuple, warc.read_back(directory, payloads=True).collect())) and len(every) == len(rows)

    # only blocks that may hold a key are read
    one = warc.locate(keys.filter("key like 'net,h3)%'"), directory)
    assert 1 <= one.count() <= 3


def test_nothing_is_found_in_nothing(spark):
    pages = spark.createDataFrame([], PAGES)
    captures = warc.write_archives(pages)
    directory = warc.build_index(captures)
    keys = spark.createDataFrame([("org,a)/",)], "key string")
    assert warc.find(captures, directory).count() == 0 == warc.find(keys, directory).count()
    some = warc.build_index(warc.write_archives(spark.createDataFrame([(1, "http://a.org/", "x")], PAGES)))
    assert warc.find(keys.limit(0), some).count() == 0 and warc.find(keys, some).count() == 1


@pytest.mark.parametrize("firsts, key, expected", [([], "a", []), (["b"], "a", []), (["b"], "b", [0]), (["a", "c"], "b", [0]), (["a", "c", "c", "d"], "c", [0, 1, 2]), (["a", "c"], "z", [1])])
def test_ranges_that_may_hold_a_key(firsts, key, expected):
    assert list(warc._holding(firsts, key)) == expected


def test_query_has_a_row_for_every_page(spark):
    pages = queries.table(spark, "/root/testdata/sf0.001", "pages")
    got = queries.op2_warc_index(spark, "/root/testdata/sf0.001")
    assert collections.Counter(r.page_id for r in got.collect()) == collections.Counter(r.page_id for r in pages.select("page_id").collect())
