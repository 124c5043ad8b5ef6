"""JSON amid other text, against the decoder of the standard library at every bracket."""

import json
import random
import time

from pyspark.sql import functions as F

from gaugeloom.functions import json_text as JT


def every_value(text):
    """What can be read from each bracket on."""
    out, decoder = [], json.JSONDecoder()
    for i, c in enumerate(text):
        if c in "[{":
            try:
                out.append((i, decoder.raw_decode(text, i)))
            except ValueError:
                pass
    return out


def outermost(text):
    out, behind = [], 0
    for start, (_, end) in every_value(text):
        if start >= behind:
            out.append((start, end))
            behind = end
    return out


def test_spans_equal_the_decoder():
    rng = random.Random(3)
    pieces = ["[", "]", "{", "}", '"', '"a"', ":", ",", "1", "-0.5e3", "true", "null", " ", "\n", "x", "\\", '"[', ']"', '{"a":', "NaN", "01", '"\\u00e9"', '"\\x"', "[1,2]", '{"k": [1]}', "\t"]
    for _ in range(30_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(18)))
        assert JT.json_spans(text) == outermost(text), text


def test_time_is_linear_in_the_text():
    for unit in ("[", '{"a":', "[1,", '["', "[{", "]["):
        text = unit * (1_000_000 // len(unit))
        began = time.time()
        JT.json_spans(text)
        assert time.time() - began < 8, unit


def test_last_object_with_an_answer_wins(spark):
    texts = ['{"answer": 1} then {"x": {"result": "in"}} [', '[{"answer": 3}, {"final": null}]', '{"answer": {"answer": "deep"}}', "no {", '"scalar"', "7", None, "  "]
    got = [r.a for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", JT.answer_of(F.col("t")).alias("a")).orderBy("i").collect()]
    assert got == ["in", "3", "deep", "no {", "scalar", "7", None, None]


def test_payload_needs_no_python(spark):
    texts = ['log\n{"a": 1}\nrest {', '{"a": 1} {"b": 2}', 'x {"a": {"b": 2}} y', "[1]", "{}", "} {", None, "", '{"a": 1}\r\n{"b": 2}\x0bz', " {\"c\": 3} "]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", JT.payload_object(F.col("t")).alias("p")).orderBy("i")
    assert [r.p if r.p is None else json.loads(r.p) for r in frame.collect()] == [{"a": 1}, None, {"a": {"b": 2}}, None, {}, None, None, None, {"b": 2}, {"c": 3}]
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
