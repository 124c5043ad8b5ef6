"""Cases that once went wrong: texts without words to learn from, tags that a slash doesn't close, rows with repeated and missing ids."""

import pytest

import corpus_pipeline
from gaugeloom.llm import html_blocks, setjoin, templates, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(60))
NEAR = LONG.replace("w30 ", "other ")


def test_toxicity_learnt_from_texts_without_words_is_the_prior(spark):
    ids = [i for i in range(60)]
    docs = spark.createDataFrame([(i, "" if i % 2 else "!!") for i in ids] + [(99, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in ids], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 61 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}


def test_a_slash_closes_no_script():
    assert html_blocks.main_text("<body><p>Text.</p><script src=x/>var a=1;</script><p>More.</p></body>") == "Text. More."
    assert html_blocks.main_text('<body><style media="a"/>p {x: y}</style><p>Text.</p></body>') == "Text."
    assert html_blocks.main_text("<body><p>Be<svg/>fore.</p></body>") == "Before."


def test_formulas_are_text():
    assert html_blocks.main_text("<article><p>where <math><mi>x</mi> = 1<annotation encoding='tex'>x=1</annotation></math> holds</p></article>") == "where x = 1 holds"


def test_doubtful_words_yield_to_the_weight_of_the_text():
    art, short = "Words of an article about the law of copying and more. " * 20, "<p>short</p>"
    assert html_blocks.main_text(f'<body><div class="copyright-law"><p>{art}</p></div>{short}</body>').startswith("Words of an article")
    assert "All rights" not in html_blocks.main_text(f'<body><div><p>{art}</p></div><div class="copyright">All rights reserved.</div></body>')
    assert "nice" not in html_blocks.main_text(f'<body><div><p>{art}</p></div><div class="comments"><p>{"nice " * 600}</p></div></body>')


@pytest.mark.parametrize("order", [1, -1])
def test_rows_are_judged_not_ids(spark, order):
    rows = [(1, LONG), (2, NEAR), (2, "a text of its own under a repeated id, which nothing else is like"), (3, "equal rows of one id stay once"), (3, "equal rows of one id stay once"),
            (None, LONG), (None, "no id and no copy of it at all, so it stays"), (4, ""), (4, ""), (None, None)][::order]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in setjoin.representatives(docs).collect()), key=str)
    expected = [(1, LONG), (2, rows[2 if order > 0 else 7][1]), (3, "equal rows of one id stay once"), (None, "no id and no copy of it at all, so it stays"), (4, ""), (4, ""), (None, None)]
    assert got == sorted(expected, key=str)
    assert setjoin.representatives(docs.limit(0)).count() == 0 and setjoin.representatives(docs).columns == docs.columns


def test_texts_are_decontaminated_whatever_their_id(spark):
    item = "the quick brown fox jumps over a lazy dog while seven wizards box and daft jack sings loudly today again"
    rows = [(1, f"before {item} after"), (1, "a clean text of the same id"), (None, f"x {item} y"), (None, "a clean one without id"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in templates.clean(docs, bench).collect()), key=str)
    assert kept == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    found = templates.contaminated(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == [(1, 7), (None, 7)]


def test_pipeline_stages_judge_rows(spark):
    docs = spark.createDataFrame([(1, LONG, "en", "s", 0), (2, NEAR, "en", "s", 0), (2, "unique words stand here alone and nowhere else", "en", "s", 0)], DOCS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 2] and {r.text for r in kept} == {LONG, "unique words stand here alone and nowhere else"}
