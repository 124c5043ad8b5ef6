"""Replies, transcripts and shuffled labels on small cases."""

from pyspark.sql import functions as F

from gaugeloom.functions import answers
from gaugeloom.functions.answers import tag_near
from gaugeloom.operators import shuffled, transcripts


def column(spark, make, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_numbered_answers(spark):
    assert column(spark, answers.numbered_answers, "ANSWER 1: 5\n> answer #2 = **7**\nANSWER 1: 6", "no answer", None) == [{1: "6", 2: "**7**"}, {}, {}]
    gold = F.create_map(F.lit(1).cast("bigint"), F.lit("6"), F.lit(3).cast("bigint"), F.lit("x"))
    assert column(spark, lambda t: answers.hits(answers.numbered_answers(t), gold), "answer 1: 6", "") == [0.5, 0.0]


def test_chapter(spark):
    twice = "pre\n```mdx\nabc <X>\nlonger\n```\nmid\n```\nabc\n```"
    assert column(spark, lambda t: answers.chapter(t, "abc"), twice, "```\nonly\nthis\n```\n", "none", None) == ["abc <X>\nlonger", "only\nthis", "none", None]
    assert column(spark, answers.fenced_blocks, twice, "```\nopen", None) == [["abc <X>\nlonger", "abc"], [], []]


def test_tags_that_render(spark):
    text = "the thm-clt is <XRef id=\"a\" to='b' id={\"c\"}/> and <XRef/> <!-- <XRef id='q'/> -->\n```\n<XRef>\n```\n"
    assert column(spark, lambda t: answers.tags(answers.rendered_only(t), "XRef"), text) == [[{"to": "b", "id": "c"}, {}]]
    assert column(spark, lambda t: answers.tag_near(t, "THE thm-clt", "XRef", 60), text, "elsewhere", text + text) == [{"to": "b", "id": "c"}, None, None]


def test_streams(spark):
    call = '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Read"},{"type":"text"},7,{"type":"tool_use","name":5}]}}'
    lines = [("a", 1, call), ("a", 2, "not json {"), ("a", 3, '{"type":"result","n":1}'), ("a", 4, '{"type":"result","n":2}'), ("a", 5, call.replace("Read", "Bash")), ("b", 1, "[1]"), ("b", 2, None), ("b", 3, '{"type":"assistant","message":"x"}')]
    got = transcripts.parse_streams(spark.createDataFrame(lines, "k string, n int, line string"), "k", "n", "line").collect()
    assert {r.k: (r.payload, r.tools) for r in got} == {"a": ('{"type":"result","n":2}', ["Read", "Bash"]), "b": (None, [])}


def test_shuffled_labels_are_near_one_half(spark):
    rows = [("g", i, i % 2, i % 2 if i % 5 else None) for i in range(40)] + [("one class", 1, 1, 1)]
    got = {r.grp: (r.n, r.shuffled_auroc) for r in shuffled.shuffled_auroc(spark.createDataFrame(rows, "grp string, id int, gold int, p int"), "grp", "gold", "p").collect()}
    assert got["g"][0] == 40 and abs(got["g"][1] - 0.5) < 0.05 and got["one class"] == (1, None)


def test_tags_are_found_by_where_they_begin(spark):
    def near(text, anchor="x", window=5):
        return spark.range(1).select(tag_near(F.lit(text), anchor, "Cite", window).alias("t")).first().t

    assert near('x <Cite key="abc"/>') == {"key": "abc"}  # begins within, ends behind
    assert near('x12345<Cite key="a"/>') == {"key": "a"} and near('x123456<Cite key="a"/>') is None
    assert near('<Cite key="before"/> x <Cite key="a"/><Cite key="b"/>') == {"key": "a"}
    assert near('aaa <Cite key="a"/>', "aa") is None and near('AA <Cite key="a"/>', "aa") == {"key": "a"}
    assert near("x none") is None and near('y <Cite key="a"/>') is None and near(None) is None
    assert near('x <Citess key="a"/><Cite >') == {} or near('x <Citess/>') is None
