"""All queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import answers as AN
from .functions import json_text as JT
from .functions import records as RE
from .functions import text as TX
from .functions.stats import hash_uniform, sign_flip_p
from .operators import advise as AD
from .operators import cells as CE
from .operators import chapters as CH
from .operators import frontier as FR
from .operators import graders as GA
from .operators import grading as GR
from .operators import grid as GD
from .operators import paired as PA
from .operators import runs as RU
from .operators import sanitize as SA
from .operators import shuffled as SH
from .operators import transcripts as TR
from .operators.dedupe import duplicates, latest_grade, latest_ok
from .operators.intervals import list_interval
from .oracles import SQL, intervals_sql
from .plans.adapters import EVENT_SQL, LEDGER_SQL, MEASURED_SQL, TIES, event_ledger, orders_ledger
from .schema import CELL, LEDGER
from .sources.datasource import register
from .sources.ledger import append_ledger, append_new, encoded, read_ledger, read_ledger_checked, read_sequenced, scratch_folder, write_sanitized
from .sources.outputs import captured
from .streaming.ledger import compact, latest_state, stream_latest

#: The efforts of the ledger view, and what stands for the reflex configuration and the variants.
EFFORTS, REFLEX, A, B = ("F", "O"), "R/F", "F", "O"
_ROUND = 4


def _round(c):
    """Rounded a hair upwards, since engines differ on exact halves."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, _ROUND)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_round(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _cells(spark: SparkSession, sf_dir: str, axis: str = "latency") -> DataFrame:
    """Cells of the orders' ledger; for the throughput axis that with all tokens measured, else no cell has a place on it."""
    return CE.aggregate(latest_grade(orders_ledger(spark, sf_dir, axis == "throughput"), TIES))


def cell_report(spark, sf_dir):
    return _rounded(CE.report(orders_ledger(spark, sf_dir), TIES))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_report(spark, sf_dir)


def dropped_runs(spark, sf_dir):
    return CE.dropped_runs(orders_ledger(spark, sf_dir))


def fully_dropped_cells(spark, sf_dir):
    rows = orders_ledger(spark, sf_dir).withColumn("variant", F.concat_ws("-", "variant", "grader_version", "run_id"))
    return CE.fully_dropped(rows, latest_grade(rows, TIES))


def ledger_latest_grade(spark, sf_dir):
    return latest_grade(event_ledger(spark, sf_dir), ("event_id",)).select("run_id", "event_id", "ts", "grade_status", "value")


def last_ok_by_key(spark, sf_dir):
    return latest_ok(event_ledger(spark, sf_dir), ("run_id",), "event_id").select("run_id", "event_id", "k")


def _as_ledger(events: DataFrame) -> DataFrame:
    """Events as rows of the ledger's columns: the id is the epoch, the key in ``props`` the turns."""
    known = {"epoch": F.col("event_id"), "num_turns": F.col("k"), "task_id": F.col("event_type")}
    return events.select(*((known.get(f.name, F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType)).alias(f.name) for f in LEDGER))


def last_in_file_order(spark, sf_dir):
    """The ledger is written as JSON in parts and read again; the last successful row of a run in the order of the files counts."""
    path = scratch_folder(spark, "ledger")
    append_ledger(_as_ledger(event_ledger(spark, sf_dir)).repartitionByRange("epoch").sortWithinPartitions("epoch"), path)
    return latest_ok(read_sequenced(spark, path), ("run_id",)).select("run_id", F.col("epoch").alias("event_id"), F.col("num_turns").alias("k"))


def streamed_grades(spark, sf_dir):
    """The ledger is written as three files, streamed a file a batch, and folded after it; the definitive grades are as if all was read at once."""
    source, table, check = (scratch_folder(spark, name) for name in ("stream", "newest", "check"))
    append_ledger(_as_ledger(event_ledger(spark, sf_dir)).repartition(3, "epoch"), source)
    stream = stream_latest(spark, source, table, check, ("epoch",), files_per_batch=1).trigger(availableNow=True).start()
    stream.awaitTermination()
    compact(spark, table, ("epoch",))
    return latest_state(spark, table, ("epoch",)).select("run_id", F.col("epoch").alias("event_id"), "ts", "grade_status", "value")


def ledger_source(spark, sf_dir):
    """The ledger is written as JSON and read by its own data source in ranges of 1 MB, which tests the statuses and tasks."""
    path = scratch_folder(spark, "source")
    append_ledger(_as_ledger(event_ledger(spark, sf_dir)).withColumn("run_id", F.concat_ws(":", "run_id", "epoch")), path)
    rows = spark.read.format(register(spark)).option("splitBytes", 1 << 20).load(path)
    kept = rows.filter((F.col("run_status") == "ok") & F.col("task_id").isin("click", "purchase") & (F.col("num_turns") >= 10))
    return kept.groupBy("task_id", "grade_status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("n_runs"), F.sum("num_turns").alias("turns"), F.max("ts").alias("last"))


def _as_shown(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a table that is shown, written in their order and read again, with their ``position``."""
    path = scratch_folder(rows.sparkSession, name)
    append_ledger(rows, path)
    back = read_sequenced(rows.sparkSession, path, rows.schema)
    return back.withColumn("position", F.row_number().over(Window.orderBy("seq")).cast("long")).drop("seq")


def report_order(spark, sf_dir):
    """The report's rows in the order in which they are shown."""
    return _as_shown(CE.ordered(_rounded(_cells(spark, sf_dir))).select(*CELL, "mean_value"), "report")


def advice_order(spark, sf_dir):
    """Advice on tokens in the order in which it is shown, unmeasured savings last."""
    return _as_shown(AD.ordered(_rounded(AD.advise(_cells(spark, sf_dir, "tokens"), REFLEX, 0.2, "tokens", EFFORTS))).select("task_id", "variant", "lead_saving"), "advice")


def compare_order(spark, sf_dir):
    """Compared tasks in the order in which they are shown."""
    return _as_shown(PA.ordered(PA.compare(orders_ledger(spark, sf_dir), A, B, TIES)).select("task_id", "n_pairs"), "compared")


def duplicate_keys(spark, sf_dir):
    return duplicates(event_ledger(spark, sf_dir), ("user_id", "event_type"))


def sanitized_ledger(spark, sf_dir):
    """What a published ledger holds: allowed columns only, written after the check for leaks and read again."""
    path = scratch_folder(spark, "published")
    write_sanitized(_as_ledger(event_ledger(spark, sf_dir)), path, ("task_id", "run_status", "num_turns"), ("/home/", "@"))
    return read_ledger(spark, path).groupBy("task_id", "run_status").agg(F.count(F.lit(1)).alias("n"), F.sum("num_turns").alias("turns"), F.count("run_id").alias("n_ids"), F.count("ts").alias("n_times"))


def captured_artifacts(spark, sf_dir):
    """Events as files that runs left, and the one that counts for each run: at its very place if it is new enough, else the newest of its name."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type"), F.lit(".md"))
    files = e.select(F.concat(F.lit("/w/"), (F.col("event_id") % 3).cast("string"), F.lit("/"), name).alias("path"), name.alias("name"), F.col("ts").alias("modified"), F.col("props").alias("content"))
    wanted = e.groupBy(F.concat_ws(":", "user_id", "event_type").alias("run_id"), F.concat(F.lit("1/"), name).alias("artifact")).agg(F.min(F.when(F.col("event_id") % 2 == 0, F.col("ts"))).alias("since"))
    return captured(wanted, files)


def repeated_appends(spark, sf_dir):
    """A sweep that is appended, broken off and done again, and once more with new grades: counts of what the ledger holds, read with checks."""
    path = scratch_folder(spark, "sweep")
    rows = _as_ledger(event_ledger(spark, sf_dir)).withColumn("run_id", F.col("epoch").cast("string")).withColumn("details", F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.col("task_id")))
    rows = encoded(rows)
    append_new(rows.filter("epoch % 3 = 0"), path)
    append_new(rows, path)
    append_new(rows, path)
    append_new(rows.filter("epoch % 5 = 0").withColumn("grader_version", F.lit("v2")), path)
    return read_ledger_checked(spark, path).groupBy("task_id", "grader_version", "details").agg(F.count(F.lit(1)).alias("n"), F.sum("num_turns").alias("turns"))


def _pareto(axis):
    def query(spark, sf_dir):
        marked = FR.mark_frontier(_cells(spark, sf_dir, axis), axis).withColumn("x", FR.axis_value(axis)).filter("pareto")
        return FR.staircase(marked).select(*CELL, _round("x").alias("x"), _round("mean_value").alias("mean_value"), F.col("step").cast("long").alias("step"))

    return query


def cell_intervals(spark, sf_dir):
    """Intervals of cells by month, most of them small."""
    rows = orders_ledger(spark, sf_dir).withColumn("variant", F.substring("ts", 1, 7)).withColumn("cost_usd", F.lit(None).cast("double"))
    found = CE.intervals(latest_grade(rows, TIES))
    return _rounded(found.select(*CELL, "value_low", "value_high", "latency_low", "latency_high", "cost_low", "total_tokens_high"))


def ab_compare(spark, sf_dir):
    return _rounded(PA.compare(orders_ledger(spark, sf_dir), A, B, TIES).drop("diffs"))


def _advice(axis, margin=0.2):
    def query(spark, sf_dir):
        return _rounded(AD.advise(_cells(spark, sf_dir, axis), REFLEX, margin, axis, EFFORTS))

    return query


def sign_flip_exact(spark, sf_dir):
    """Sign-flip tests of up to 40 differences: balances of suppliers in groups, scaled so that some are near no effect."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey is not null")
    diff = F.round((F.col("s_acctbal") - 3000 - 400 * (F.col("s_suppkey") % 5)) / 1000, 3)
    groups = s.groupBy((F.col("s_suppkey") % 5).alias("team"), F.floor(F.col("s_suppkey") / 100).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", diff.alias("d")))), lambda x: x["d"]).alias("d"))
    return groups.select("team", "block", F.size("d").cast("long").alias("n"), F.round(sign_flip_p("d") + 1e-9, 6).alias("p_value"))


def advise_total(spark, sf_dir):
    return _rounded(AD.total(AD.advise(_cells(spark, sf_dir), REFLEX, 0.2, "latency", EFFORTS)))


def epoch_interval(spark, sf_dir):
    """Intervals of users by all resamples of up to five grades, else 2,000 hashed ones; a user has one grade an event type."""
    grades = latest_grade(event_ledger(spark, sf_dir), ("event_id",)).groupBy("user_id").agg(F.array_sort(F.collect_list(F.round("value", 6))).alias("v"))
    return grades.withColumn("i", list_interval("v")).select("user_id", _round("i.low").alias("low"), _round("i.high").alias("high"))


def infra_breaker(spark, sf_dir):
    return RU.breaker(event_ledger(spark, sf_dir), ("user_id",), ("event_id",))


def tool_histogram(spark, sf_dir):
    runs = event_ledger(spark, sf_dir).withColumn("tools", F.array("event_type"))
    return RU.tool_histogram(runs, "user_id", "tools")


def status_tallies(spark, sf_dir):
    return RU.tallies(event_ledger(spark, sf_dir))


def balanced_subsample(spark, sf_dir):
    return GR.balanced_subsample(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic", 20)


def clf_confusion(spark, sf_dir):
    return _rounded(GR.confusion(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "toxic"))


def _axes(spark, sf_dir):
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    tasks = nation.select(F.col("n_name").alias("task_id"), F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit("r"), (F.col("n_nationkey") % 3).cast("string"))).alias("repo"), F.col("n_nationkey").cast("int").alias("task_pos"))
    models = region.select(F.lower("r_name").alias("model"), F.col("r_regionkey").cast("int").alias("model_pos"))
    efforts = spark.createDataFrame([(e, i) for i, e in enumerate(("low", "medium", "high"))], "effort string, effort_pos int")
    variants = spark.createDataFrame([(v, i) for i, v in enumerate(("none", "r0@main", "r1@main", "r1@dev@x", "r2@", "bad"))], "variant string, variant_pos int")
    support = region.filter("r_regionkey < 2").select(F.lower("r_name").alias("model"), F.lit("high").alias("effort"))
    return tasks, models, efforts, variants, support


def grid_expand(spark, sf_dir):
    tasks, models, efforts, variants, support = _axes(spark, sf_dir)
    return GD.expand(tasks, models, efforts, variants, 2, support, ("asia",)).select("task_id", "model", "effort", "variant", "epoch")


def grid_sizes(spark, sf_dir):
    return GD.plan_sizes(grid_expand(spark, sf_dir))


def resume_plan(spark, sf_dir):
    ledger = orders_ledger(spark, sf_dir).withColumn("epoch", F.col("tie_part") % 4).withColumn("seq", F.struct("ts", "run_id", *TIES))
    cells = ledger.select(*CELL, "epoch").distinct().withColumn("grader_version", F.lit("v1")).withColumn("spec_sha", F.lit("s1"))
    return GD.resume(cells, ledger).select(*CELL, "epoch", "action")


def verdict_parse(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    worded = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("Injection: ", " safe ", "is it an INJECTION? ", "looks safe ", "injection or safe ", ""))), (F.col("turn") % 6 + 1).cast("int")), F.col("role"))
    return c.select("conv_id", "turn", TX.verdict(worded).cast("int").alias("verdict"))


def answer_forms(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = F.concat(F.lit("$`"), F.format_number(F.col("p_partkey") * 997, 0), F.lit("`$ "))
    return p.select("p_partkey", TX.bare_integer(raw).alias("bare"), TX.squashed(F.concat(F.lit(" '"), F.col("p_name"), F.lit("..' # note"))).alias("squashed"), TX.first_number(F.concat(F.lit("about "), F.format_number(F.col("p_partkey") * 1000, 0), F.lit(" items"))).alias("number"))


def spec_fingerprint(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    gold = F.concat(F.lit('{"b": '), F.col("p_size").cast("string"), F.lit(', "a": "'), F.col("p_name"), F.lit('"}'))
    spec = TX.spec_fingerprint(F.col("p_brand"), F.lit(None).cast("string"), gold, F.array(F.lit("Read"), F.lit("Edit")))
    return p.select("p_partkey", TX.fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("fingerprint"), spec.alias("spec"))


def sanitize_violations(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from .operators.sanitize import leaks

    return d.filter(leaks(F.col("text"), ("@", "License"), 5000)).select("doc_id", F.length("text").cast("long").alias("n"))


def ledger_leaks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select("event_type", "props", F.array("event_type").alias("tags"), F.struct(F.struct(F.col("event_type").alias("t")).alias("in")).alias("nested"), F.create_map("event_type", "props").alias("by_type"), "event_id")
    return SA.violations(rows, ("click", "k"), 60).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def hashed_draws(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.round(hash_uniform(F.lit("42"), F.col("s_suppkey").cast("string")), 6).alias("u"))


def shuffled_auroc(spark, sf_dir):
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return _rounded(SH.shuffled_auroc(labels.join(docs.select("doc_id", "lang"), "doc_id"), "lang", "quality", "toxic"))


def auroc_intervals(spark, sf_dir):
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    rows = labels.join(docs.select("doc_id", "source"), "doc_id")
    counts = rows.groupBy("source").agg(*GR.confusion_of(F.col("quality"), 1 - F.col("toxic"))).select("source", "tp", "fp", "tn", "fn")
    return _rounded(GR.auroc_interval(counts, "source"))


def _replies(spark, sf_dir):
    """Conversations' turns and documents as replies of many shapes (kind 0 to 11), with what they say."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    word = F.regexp_extract("text", r"([A-Za-z]+)", 1)
    return c.select("conv_id", "turn", "role", "text", word.alias("word"), (F.col("conv_id") * 7 + F.col("turn")).alias("k")).withColumn("kind", (F.col("k") % 12).cast("int"))


def exact_match(spark, sf_dir):
    r, k, word = _replies(spark, sf_dir), F.col("k").cast("string"), F.col("word")
    reply = F.element_at(F.array(
        F.concat(F.lit("Well.\nANSWER: no\n> answer = "), word, F.lit("  # it is\n")), F.concat(F.lit('I think {"result": "x"} or rather {"answer": "'), word, F.lit('"} ok')), F.concat(F.lit("Code:\n```py\n"), word, F.lit("\n```\nDone")),
        F.concat(F.lit("  `"), word, F.lit(".` ")), F.concat(F.lit("`'"), word, F.lit("'` # "), word), F.lit(" \n "), F.concat(F.lit("about "), k, F.lit(".0 of them")), F.concat(F.lit("ANSWER: 1,"), F.lpad(k, 3, "0"), F.lit(" apples")), k,
        F.concat(F.lit('"'), word, F.lit('"')), F.concat(F.lit("[1, 2] then {\"line\": "), k, F.lit("}")), F.col("text"),
    ), F.col("kind") + 1)
    numeric = F.col("kind").isin(6, 7, 8, 10)
    gold = F.when(F.col("turn") % 5 == 4, F.array().cast("array<string>")).when(numeric, F.array(k, F.lit("-1"))).otherwise(F.array(F.lit("nothing"), word))
    read = r.select("conv_id", "turn", reply.alias("reply"), JT.answer_of(reply).alias("answer"), gold.alias("gold"), numeric.alias("numeric"))
    s = GA.exact_match(F.col("reply"), F.col("answer"), F.col("gold"), F.col("numeric"))
    return read.select("conv_id", "turn", "answer", s["value"].alias("value"), s["status"].alias("status"))


def answer_set(spark, sf_dir):
    r, k, word = _replies(spark, sf_dir), F.col("k").cast("string"), F.col("word")
    lines = F.concat(F.lit("Well.\nANSWER 1: x\n> answer #2 = "), word, F.lit(" \nANSWER 1: **"), F.format_number(F.col("k") * 1000, 0), F.lit("**"))
    reply = F.when(F.col("kind") % 4 == 0, lines).when(F.col("kind") % 4 == 1, F.concat(F.lit('So {"answers": {"1": "no"}} no, {"answers": {"1": '), F.col("k") * 1000, F.lit(', "2": "'), word, F.lit('", "x": 1}}')))
    reply = reply.when(F.col("kind") % 4 == 2, F.concat(F.lit("ANSWER 1: $"), F.col("k") * 1000, F.lit("$\nanswer 2: +7\nANSWER 9: z"))).otherwise(F.col("text"))
    gold = F.array((F.col("k") * 1000).cast("string"), F.when(F.col("kind") % 4 == 2, "7").otherwise(word), F.lit("third"))
    gold = F.when(F.col("turn") % 3 == 0, F.slice(gold, 1, 1)).when(F.col("kind") % 4 == 2, F.slice(gold, 1, 2)).otherwise(gold)
    read = r.select("conv_id", "turn", reply.alias("reply"), JT.answers_of(reply).alias("got"), gold.alias("gold"))
    s = GA.exact_match_set(F.col("reply"), F.col("got"), F.col("gold"), F.col("turn") % 3 == 0)
    return read.select("conv_id", "turn", _round(s["value"]).alias("value"), s["status"].alias("status"), s["subscores"]["found"].alias("found"))


def verbatim_anchor(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace("text", r'["\\\x00-\x1f]', " ").alias("text"))
    d = d.withColumn("a", F.substring("text", 1, 30)).withColumn("b", F.substring("text", 8, 40))
    quote = lambda q: F.concat(F.lit('{"claim": "c", "quote": "'), q, F.lit('"}'))
    listed = F.concat(F.lit('Here: {"claims": ['), F.concat_ws(", ", quote(F.col("a")), quote(F.col("b")), quote(F.concat(F.lit("  "), F.col("a"))), quote(F.lit("not said there at all")), quote(F.lit("of")), F.lit('"loose"')), F.lit("]} and more }"))
    reply = F.when(F.col("doc_id") % 4 == 0, "no claims at all {").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("["), quote(F.col("b")), F.lit("]"))).otherwise(listed)
    source = F.when(F.col("doc_id") % 10 == 9, "").otherwise(F.col("text"))
    read = d.select("doc_id", reply.alias("reply"), JT.claims(reply).alias("quotes"), source.alias("source"))
    loose, strict = (GA.anchor(F.col("reply"), F.col("quotes"), F.col("source"), expected, strict) for expected, strict in ((None, False), (F.lit(2), True)))
    return read.select("doc_id", _round(loose["value"]).alias("value"), loose["status"].alias("status"), loose["subscores"]["n_verbatim"].alias("n_verbatim"), _round(strict["value"]).alias("strict"))


def _verdicts(spark, sf_dir):
    """Replies by conversation with a verdict for most turns, and the gold labels of turns."""
    r = _replies(spark, sf_dir)
    label = F.element_at(F.array(*(F.lit(x) for x in ('"injection"', '"safe"', "1", "0", "true", "0.4", '"unclear"', '"an INJECTION, no doubt"'))), (F.col("k") % 8 + 1).cast("int"))
    item = F.concat(F.lit('{"idx": '), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise(F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('"'))), F.when(F.col("k") % 3 == 0, ', "verdict": ').otherwise(', "label": '), label, F.lit("}"))
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") % 5 != 4, F.struct("turn", item.alias("i"))))), lambda x: x["i"])
    lists = F.concat(F.lit('Sure! {"verdicts": ['), F.array_join(items, ", "), F.lit(', {"idx": 999, "label": 1}]} done'))
    replies = r.groupBy("conv_id").agg(lists.alias("output")).withColumn("output", F.when(F.col("conv_id") % 9 == 8, "I can't say.").when(F.col("conv_id") % 9 == 7, "[]").otherwise(F.col("output")))
    gold = r.filter("conv_id % 11 <> 10").select("conv_id", F.col("turn").alias("idx"), (F.col("k") % 3 % 2).cast("int").alias("label"))
    return replies, gold


def grade_classification(spark, sf_dir):
    graded = GA.classification(*_verdicts(spark, sf_dir), "conv_id")
    return _rounded(graded.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("missing_idx", "extra_idx")}))


def validator_grade(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    n, size = (F.col("p_partkey") % 8).cast("string"), F.col("p_size").cast("string")
    stderr = F.when(F.col("p_partkey") % 5 == 0, "Traceback: boom").otherwise(F.concat(F.lit("checking\nVALIDATION FAILED: "), n, F.lit(" error(s)\n  - first of "), F.col("p_name"), F.lit("\n - second")))
    v = GA.validator((F.col("p_partkey") % 3).cast("int"), stderr)
    stdout = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("item ok\nCHECK PASSED: "), size, F.lit("/50 points\n\n"))).when(F.col("p_partkey") % 4 == 3, "").otherwise(F.concat(F.lit("CHECK FAILED: "), F.col("p_size").cast("string"), F.lit(".5/50 points, "), n, F.lit(" items below full")))
    c = GA.checker_summary(F.when(F.col("p_partkey") % 4 == 0, F.lit(0)).otherwise((F.col("p_partkey") % 8).cast("int") - (F.col("p_partkey") % 7 == 0).cast("int")), stdout)
    return p.select("p_partkey", _round(v["value"]).alias("value"), v["status"].alias("status"), F.from_json(v["details"]["errors"], "array<string>")[0].alias("first_error"), _round(c["value"]).alias("checked"), c["status"].alias("check_status"), c["subscores"]["below"].alias("below"))


def grader_dispatch(spark, sf_dir):
    runs = event_ledger(spark, sf_dir)
    output = F.col("k").cast("string")
    named = {"purchase": GA.score(F.col("value")), "click": GA.exact_match(output, output, F.array(F.lit("7"), F.lit("8")), F.lit(False))}
    s = GA.dispatch(F.col("run_status"), F.col("event_type"), named)
    return runs.select("event_id", _round(s["value"]).alias("value"), s["status"].alias("status"), s["details"]["reason"].alias("reason"))


#: A rubric over chapters made of parts.
RUBRIC = (
    {"kind": "xref", "anchor": "see the part", "expected_id": "p1", "family": ["p2", "p9"]}, {"kind": "cite", "anchor": "as told by", "expected_key": "Brand#12"}, {"kind": "coderef", "anchor": "in file", "expected_path": "a.py"},
    {"kind": "booklink", "anchor": "elsewhere"}, {"kind": "census", "tag": "cite", "min": 1, "max": 1}, {"kind": "cite", "anchor": "twice", "expected_key": "Brand#12"},
    {"kind": "booklink", "anchor": "zz"},
)


def _chapters(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey") % 4
    gap = F.repeat(F.lit("."), 198 + F.col("p_partkey") % 5)  # the window is 200 characters wide
    xref = F.concat(F.lit("See the part"), gap, F.lit('<XRef id="p'), key.cast("string"), F.lit('" />. '))
    cite = F.concat(F.lit("As told by <Cite key={'"), F.col("p_brand"), F.lit("'}/>. twice twice "))
    code = F.concat(F.lit('In file <CodeRef path="'), F.when(F.col("p_size") % 3 == 0, "b.py").otherwise("a.py"), F.lit('" line="'), F.col("p_size").cast("string"), F.lit('" lineEnd="'), F.when(F.col("p_size") % 7 == 0, "x").otherwise("30"), F.lit('"/>. '))
    book = F.concat(F.lit('Elsewhere <BookLink book="b" to="'), F.when(F.col("p_size") % 2 == 0, "").otherwise("t"), F.lit('">more</BookLink>. <!-- <Cite key="Brand#12"/> -->\n```\n<Cite key="Brand#12"/>\n```\nzzz <BookLink book="b" to="t"/>'))
    return p.select("p_partkey", F.concat(xref, cite, code, book).alias("text"))


_LABELS, _REFERENCES, _FILES = ("p1", "p2"), ("Brand#12", "Brand#13", "Brand#21"), (("a.py", 30), ("b.py", 10))


def chapter_items(spark, sf_dir):
    c = _chapters(spark, sf_dir)
    arrays = [F.array(*(F.lit(x) for x in names)) for names in (_LABELS, _REFERENCES)]
    files = F.create_map(*(F.lit(x) for pair in _FILES for x in pair))
    each = c.select("p_partkey", CH.rubric_points(F.col("text"), list(RUBRIC), *arrays, files).alias("each"))
    points = [F.col("each")[i].alias(f"p{i}") for i in range(len(RUBRIC))]
    whole = CH.score_of(F.col("each"), len(RUBRIC))
    return each.select("p_partkey", *points, _round(whole["value"]).alias("value"), whole["below"].cast("long").alias("below"))


def chapter_violations(spark, sf_dir):
    one = lambda names, column: spark.createDataFrame([(x,) for x in names], f"{column} string")
    return CH.violations(_chapters(spark, sf_dir), "p_partkey", "text", one(_LABELS, "id"), one(_REFERENCES, "key"), spark.createDataFrame(list(_FILES), "path string, n_lines int"))


def run_records(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k = F.col("k").cast("string")
    usage = F.element_at(F.array(
        F.concat(F.lit('{"input_tokens": '), k, F.lit(', "output_tokens": 0, "cache_read_input_tokens": 2.5, "cache_creation_input_tokens": "7"}')), F.concat(F.lit('{"input_tokens": -1, "output_tokens": true, "cache_read_input_tokens": '), k, F.lit(".0}")),
        F.lit('{"tokens_in": 5}'), F.lit("{}"), F.lit("null"),
    ), (F.col("k") % 5 + 1).cast("int"))
    payload = F.concat(
        F.lit('{"type": "result", "is_error": '), F.when(F.col("k") % 7 == 0, "true").otherwise("false"), F.lit(', "api_error_status": '), F.when(F.col("k") % 2 == 0, "429").otherwise("500"), F.lit(', "result": "'),
        F.when(F.col("k") % 3 == 0, "Usage LIMIT reached").otherwise("fine"), F.lit('", "num_turns": '), k, F.lit('.7, "total_cost_usd": '), F.when(F.col("k") % 11 == 0, '"NaN"').otherwise(F.concat(k, F.lit("e-2"))), F.lit(', "modelUsage": {"m-'), k, F.lit('": 1, "other": 2}, "usage": '), usage, F.lit("}"),
    )
    payload = F.when(F.col("k") == 99, "cut short {").otherwise(payload)
    out = RU.run_rows(e.select("event_id", payload.alias("payload"), (F.col("event_id") % 13 == 0).cast("int").alias("returncode")))
    return out.select("event_id", "run_status", _round("cost_usd").alias("cost_usd"), "num_turns", "model_resolved", "usage_drifted", *RE.USAGE.values(), RE.is_hard_limit(F.get_json_object("payload", "$.result")).alias("hard_limit"))


def sweep_summary(spark, sf_dir):
    runs = event_ledger(spark, sf_dir)
    action = F.when(F.col("k") % 4 == 0, "skip").when(F.col("k") % 4 == 1, "regrade").otherwise("run")
    return RU.sweep_summary(runs.select(action.alias("action"), "run_status", "grade_status"))


def tool_counts(spark, sf_dir):
    runs = event_ledger(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list("event_type")).alias("tools"))
    tools = F.when(F.col("user_id") % 5 == 0, F.lit(None)).when(F.col("user_id") % 5 == 1, F.array().cast("array<string>")).otherwise(F.col("tools"))
    counts = RU.tool_counts(tools)
    text = F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return runs.select("user_id", text.alias("counts"), F.array_join(F.array_sort(SA.disallowed_tools(tools, ("click", "view", "zoom"))), ",").alias("disallowed"), F.size(SA.unknown_tools(tools, ("click", "view"))).cast("long").alias("n_unknown"))


def spend_projection(spark, sf_dir):
    tasks, models, efforts, variants, support = _axes(spark, sf_dir)
    cells = GD.expand(tasks, models, efforts, variants, 2, support, ("asia",))
    first = RU.calibration_cell(cells).select("task_id", "model", "effort", F.array_join(F.transform("pos", lambda x: x.cast("string")), ".").alias("pos"))
    projected = RU.projection(cells, 0.25, 1.5, None)
    return projected.select("*", first.select(F.concat_ws("|", *first.columns)).scalar().alias("first"))


def regrade_selection(spark, sf_dir):
    ledger = orders_ledger(spark, sf_dir).withColumn("epoch", F.col("tie_part") % 4).withColumn("seq", F.struct("ts", "run_id", *TIES))
    tasks = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("9-NONE",)], "task_id string")
    chosen = RU.regrade_selection(ledger.select(*CELL, "epoch", "run_status", "seq", "run_id", "grader_version", "grade_status"), tasks)
    score = GA.score(F.lit(1.0), details={"by": F.lit("test")})
    rows = RU.regraded(chosen.withColumn("score", score), "score", "v9", "2030-01-01")
    return rows.select(*CELL, "epoch", "run_id", "value", "grade_status", "grader_version", F.get_json_object("details", "$.regrade_of").alias("regrade_of"))


def task_filter(spark, sf_dir):
    report = CE.report(SA.require_tasks(orders_ledger(spark, sf_dir), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")), TIES)
    marked = SA.only_tasks(report.select(*CELL, "pareto", "mean_latency", "latency_low", "latency_high", "n_dropped"), ("1-URGENT",))
    drawn = FR.drawing(marked.withColumn("x", F.col("mean_latency")), "latency_low", "latency_high")
    return _rounded(drawn.select(*CELL, "pareto", "log_x", F.coalesce(F.col("bar_low") >= 0, F.lit(True)).alias("bars_fit"), F.col("n_dropped")))


def label_prompt(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    gold = GA.gold_labels(c.withColumn("label", (F.col("role") == "user").cast("int")), "conv_id", "turn", "label")
    listed = gold.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"].cast("string")), "").alias("gold"))
    prompts = GA.label_prompt(c, "conv_id", "turn", "text").select("conv_id", F.md5("prompt").alias("prompt"))
    return prompts.join(listed, "conv_id")


def small_functions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.concat(F.when(F.col("p_partkey") % 3 == 0, "a:b").when(F.col("p_partkey") % 3 == 1, "with space").otherwise("srv"), F.lit(": http://"), F.col("p_brand"))
    levels = FR.effort_order(F.when(F.col("p_size") < 20, "high").when(F.col("p_size") < 40, "zeal").otherwise("low"), ("low", "high"))
    return p.select(
        "p_partkey", RE.server_name(line).alias("server"), RE.pause((F.col("p_partkey") % 9).cast("int"), 2.0).alias("pause"), RE.slug(F.concat(F.lit(" "), F.col("p_name"), F.lit("/"), F.col("p_brand"))).alias("slug"),
        RE.cell_label(F.col("p_name"), F.col("p_brand"), F.lit("low"), F.lit("none"), F.col("p_size").cast("bigint")).alias("label"), RE.digest_of(F.array("p_name", F.lit(None).cast("string"), "p_type")).alias("digest"),
        levels["level"].cast("long").alias("level"), levels["name"].alias("level_name"), TX.is_close(F.col("p_retailprice"), F.col("p_retailprice") * 1.0001, 1e-3).alias("near"), TX.rendered(F.lit("{a}-{b}"), {"a": F.col("p_brand"), "b": F.lit("{a}")}).alias("rendered"),
        RE.finite_count(F.concat(F.col("p_retailprice").cast("string"), F.when(F.col("p_size") == 1, "x").otherwise(""))).alias("whole"), F.md5(TX.normalized(F.concat(F.lit("\u00a0 "), F.col("p_name"), F.lit("\t\n x ")))).alias("normal"),
    )


def json_payloads(spark, sf_dir):
    r = _replies(spark, sf_dir)
    obj = F.concat(F.lit('{"a":'), F.col("k").cast("string"), F.lit("}"))
    text = F.element_at(F.array(obj, F.concat(F.lit("log line\n"), obj, F.lit("\nnot {json")), F.concat(F.lit("pre "), obj, F.lit(" post")), F.concat(F.lit("x ["), F.col("k").cast("string"), F.lit("] "), obj), F.lit("none [here"), F.lit("")), (F.col("k") % 6 + 1).cast("int"))
    return r.select("conv_id", "turn", F.get_json_object(JT.payload_object(text), "$.a").alias("payload"), F.regexp_replace(JT.lenient_json(text), " ", "").alias("lenient"))


def chapter_fence(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/part.parquet")
    reply = F.concat(F.lit("Here:\n```\nshort\n```\n```mdx\n# "), F.col("p_name"), F.lit("\n"), F.col("p_brand"), F.lit("\n```\ndone"))
    return d.select("p_partkey", AN.chapter(reply, "#").alias("chapter"), F.size(AN.fenced_blocks(reply)).cast("long").alias("n_blocks"))


def tag_census(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", AN.rendered_only(F.col("html")).alias("html"))
    tags = {k: AN.tags(F.col("html"), k) for k in ("a", "p", "div")}
    return p.select("page_id", *(F.size(t).cast("long").alias(f"n_{k}") for k, t in tags.items()), F.size(F.filter(tags["a"], lambda m: F.map_contains_key(m, "href"))).cast("long").alias("n_href"))


def stream_json_parse(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    call = F.concat(F.lit('{"type":"assistant","message":{"content":[{"type":"text","text":"x"},7,{"type":"tool_use","name":"'), F.col("role"), F.lit('"}]}}'))
    result = F.concat(F.lit('{"type":"result","n":'), F.col("turn").cast("string"), F.lit("}"))
    lines = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, call).when(F.col("turn") % 3 == 1, result).otherwise(F.lit("not json {")).alias("line"))
    return TR.parse_streams(lines, "conv_id", "turn", "line").select("conv_id", "payload", F.array_join("tools", ",").alias("tools"))


def queries() -> dict:
    plain = (
        cell_report, dropped_runs, fully_dropped_cells, ledger_latest_grade, last_ok_by_key, ab_compare, advise_total, epoch_interval, infra_breaker, tool_histogram, status_tallies,
        balanced_subsample, clf_confusion, grid_expand, grid_sizes, resume_plan, verdict_parse, answer_forms, spec_fingerprint, sanitize_violations, hashed_draws, ledger_leaks,
        shuffled_auroc, answer_set, chapter_fence, tag_census, stream_json_parse, cell_intervals, exact_match, verbatim_anchor, grade_classification, validator_grade, grader_dispatch,
        chapter_items, chapter_violations, run_records, sweep_summary, tool_counts, spend_projection, regrade_selection, task_filter, label_prompt, small_functions, json_payloads,
        last_in_file_order, repeated_appends, sign_flip_exact, streamed_grades, ledger_source,
        report_order, advice_order, compare_order, duplicate_keys, sanitized_ledger, captured_artifacts, auroc_intervals,
    )
    return {f.__name__: f for f in plain} | {f"pareto_{a}": _pareto(a) for a in FR.AXES} | {f"advise_{a}": _advice(a) for a in FR.AXES}


_X = {"cost": "mean_cost", "latency": "mean_latency", "tokens": "CASE WHEN n_token_epochs >= n_epochs THEN mean_output_tokens END", "throughput": "CASE WHEN n_total_token_epochs >= n_epochs THEN mean_total_tokens END"}
_LEAD = {"cost": "save_cost", "latency": "save_latency", "tokens": "save_tokens", "throughput": "save_tokens"}


def _pareto_sql(axis: str) -> str:
    return (MEASURED_SQL if axis == "throughput" else LEDGER_SQL) + f""", xs AS (SELECT *, {_X[axis]} AS x FROM cells), front AS (
  SELECT * FROM xs c WHERE x IS NOT NULL AND NOT EXISTS (SELECT 1 FROM xs o WHERE o.task_id = c.task_id AND o.mean_value >= c.mean_value AND o.x <= c.x AND (o.mean_value > c.mean_value OR o.x < c.x)))
SELECT task_id, model, effort, variant, round(x + 1e-9, 4) AS x, round(mean_value + 1e-9, 4) AS mean_value, row_number() OVER (PARTITION BY task_id ORDER BY x, model, effort, variant)::BIGINT AS step FROM front"""


def _advice_sql(axis: str, tail: str) -> str:
    return (MEASURED_SQL if axis == "throughput" else LEDGER_SQL) + f""", marked AS (
  SELECT *, coalesce({_X[axis]}, 'Infinity'::DOUBLE) AS axis_key, {_X["throughput"]} AS tokens, max(mean_value) OVER (PARTITION BY task_id, variant) AS best, count(*) OVER (PARTITION BY task_id, variant) AS n_cells,
    leakage OR n_spec > 1 OR n_grader_versions > 1 OR n_unparseable > 0 AS suspect,
    CASE WHEN model = 'R' AND effort = 'F' THEN 0 WHEN model = 'R' THEN 1 ELSE 2 END AS tier, CASE effort WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS level FROM cells
), reflex AS (
  SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY task_id, variant ORDER BY tier, CASE WHEN tier = 1 THEN -level ELSE 0 END, mean_cost DESC, model, effort) = 1
), choice AS (
  SELECT *, count(*) OVER (PARTITION BY task_id, variant) AS n_candidates FROM marked WHERE mean_value >= best - 0.2
  QUALIFY row_number() OVER (PARTITION BY task_id, variant ORDER BY axis_key, mean_latency, mean_cost, model, effort) = 1
), advice AS (
  SELECT r.task_id, r.variant, r.best AS best_value, r.n_cells, c.n_candidates, c.mean_value - r.mean_value AS quality_delta, r.model AS reflex_model, r.effort AS reflex_effort, r.tier > 0 AS fallback, c.model AS rec_model, c.effort AS rec_effort,
    c.mean_value AS rec_value, r.mean_cost - c.mean_cost AS save_cost, r.mean_latency - c.mean_latency AS save_latency, r.tokens - c.tokens AS save_tokens,
    CASE WHEN c.mean_cost > 0 THEN r.mean_cost / c.mean_cost END AS cost_multiple, r.best <= 0.2 AS vacuous, r.suspect OR c.suspect AS suspect
  FROM reflex r JOIN choice c ON r.task_id = c.task_id AND r.variant = c.variant
), led AS (SELECT *, {_LEAD[axis]} AS lead_saving FROM advice) {tail}"""


_ADVICE_TAIL = """SELECT task_id, variant, round(best_value + 1e-9, 4) AS best_value, n_cells, n_candidates, round(quality_delta + 1e-9, 4) AS quality_delta, reflex_model, reflex_effort, fallback, rec_model, rec_effort, round(rec_value + 1e-9, 4) AS rec_value, round(save_cost + 1e-9, 4) AS save_cost,
  round(save_latency + 1e-9, 4) AS save_latency, round(save_tokens + 1e-9, 4) AS save_tokens, round(cost_multiple + 1e-9, 4) AS cost_multiple, vacuous, suspect, round(lead_saving + 1e-9, 4) AS lead_saving,
  CASE WHEN vacuous THEN 'n/a: best config scores ≤ margin' WHEN rec_model = reflex_model AND rec_effort = reflex_effort THEN CASE WHEN n_cells > 1 THEN 'reflex is already the {best}' ELSE 'only one config ran' END
    ELSE CASE WHEN quality_delta > 0 THEN '+' || printf('%.3f', quality_delta) || ' quality vs reflex' WHEN quality_delta < 0 THEN printf('%.3f', -quality_delta) || ' quality drop (≤ margin 0.2)' ELSE 'same quality as reflex' END || ', ' ||
      CASE WHEN lead_saving IS NULL THEN '{axis} unmeasured (incomplete token coverage)' WHEN lead_saving > 0 THEN '{better}' WHEN lead_saving = 0 THEN '{equal}' ELSE '{worse}' END END || CASE WHEN suspect THEN ' ⚠suspect' ELSE '' END AS note FROM led"""
_CELL = "task_id, model, effort, variant"
_MEASURED = {"value": "value", "cost": "cost_usd", "latency": "latency_s", "output_tokens": "output_tokens", "total_tokens": "input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens"}
_GRID = """
WITH tasks AS (SELECT n_name AS task_id, CASE WHEN n_nationkey % 2 = 1 THEN 'r' || (n_nationkey % 3) END AS repo FROM nation),
pairs AS (
  SELECT lower(r_name) AS model, effort, pos FROM region, (VALUES ('low', 0), ('medium', 1), ('high', 2)) e(effort, pos) WHERE r_regionkey >= 2 OR effort = 'high'
), kept AS (SELECT * FROM pairs p WHERE NOT regexp_matches(model, '(?i)\\basia\\b') OR pos = (SELECT min(pos) FROM pairs q WHERE q.model = p.model)),
grid AS (
  SELECT task_id, model, effort, variant, epoch FROM tasks, kept, (VALUES ('none', NULL), ('r0@main', 'r0'), ('r1@main', 'r1'), ('r1@dev@x', 'r1')) v(variant, vrepo), (SELECT range::BIGINT AS epoch FROM range(2)) n
  WHERE CASE WHEN repo IS NULL THEN variant = 'none' ELSE vrepo IS NOT NULL AND vrepo = repo END
) """


def oracle_sql() -> dict[str, str]:
    out = {
        "cell_report": LEDGER_SQL + intervals_sql("grades", _CELL, _MEASURED) + f"""SELECT {_CELL}, n_epochs, round(mean_value + 1e-9, 4) AS mean_value, round(std_value + 1e-9, 4) AS std_value, round(mean_cost + 1e-9, 4) AS mean_cost, round(mean_latency + 1e-9, 4) AS mean_latency, n_spec,
  n_grader_versions, n_unparseable, round(mean_output_tokens + 1e-9, 4) AS mean_output_tokens, n_token_epochs, round(mean_total_tokens + 1e-9, 4) AS mean_total_tokens, n_total_token_epochs,
  round(mean_shuffled_auroc + 1e-9, 4) AS mean_shuffled_auroc, leakage, coalesce(n_dropped, 0) AS n_dropped, {", ".join(f"round({m}_{end} + 1e-9, 4) AS {m}_{end}" for m in CE.MEASURES for end in ("low", "high"))},
  NOT EXISTS (SELECT 1 FROM cells o WHERE o.task_id = c.task_id AND o.mean_value >= c.mean_value AND o.mean_latency <= c.mean_latency AND (o.mean_value > c.mean_value OR o.mean_latency < c.mean_latency)) AS pareto
FROM cells c JOIN intervals USING ({_CELL}) LEFT JOIN dropped USING ({_CELL})""",
        "dropped_runs": LEDGER_SQL + "SELECT * FROM dropped",
        "fully_dropped_cells": LEDGER_SQL + """, wide AS (SELECT *, concat_ws('-', variant, grader_version, run_id) AS v FROM ledger), best AS (SELECT DISTINCT task_id, model, effort, concat_ws('-', variant, grader_version, run_id) AS v FROM grades)
SELECT task_id, model, effort, v AS variant, count(DISTINCT run_id) AS n_dropped FROM wide w WHERE run_status <> 'ok'
  AND NOT EXISTS (SELECT 1 FROM best b WHERE b.task_id = w.task_id AND b.model = w.model AND b.effort = w.effort AND b.v = w.v) GROUP BY ALL""",
        "ledger_latest_grade": EVENT_SQL + """SELECT run_id, event_id, ts, grade_status, value FROM (SELECT * FROM runs WHERE run_status = 'ok' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1) WHERE grade_status <> 'grader_error'""",
        "streamed_grades": EVENT_SQL + """SELECT run_id, event_id, ts, grade_status, value FROM (SELECT * FROM runs WHERE run_status = 'ok' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1) WHERE grade_status <> 'grader_error'""",
        "last_ok_by_key": EVENT_SQL + "SELECT run_id, max(event_id) AS event_id, arg_max(k, event_id) AS k FROM runs WHERE run_status = 'ok' GROUP BY run_id",
        "last_in_file_order": EVENT_SQL + "SELECT run_id, max(event_id) AS event_id, arg_max(k, event_id) AS k FROM runs WHERE run_status = 'ok' GROUP BY run_id",
        "repeated_appends": EVENT_SQL + """SELECT event_type AS task_id, v AS grader_version, '{"a":"' || event_type || '","z":"1"}' AS details, count(*) AS n, sum(k)::BIGINT AS turns FROM runs, (VALUES ('v1'), ('v2')) t(v) WHERE v = 'v1' OR event_id % 5 = 0 GROUP BY ALL""",
        "ledger_source": EVENT_SQL + """SELECT event_type AS task_id, grade_status, count(*) AS n, count(DISTINCT run_id || ':' || event_id) AS n_runs, sum(k)::BIGINT AS turns, max(ts) AS last FROM runs
WHERE run_status = 'ok' AND event_type IN ('click', 'purchase') AND k >= 10 GROUP BY ALL""",
        "report_order": LEDGER_SQL + f"""SELECT {_CELL}, round(mean_value + 1e-9, 4) AS mean_value, row_number() OVER (ORDER BY task_id, round(mean_value + 1e-9, 4) DESC NULLS LAST, model, effort, variant) AS position FROM cells""",
        "advice_order": _advice_sql("tokens", "SELECT task_id, variant, round(lead_saving + 1e-9, 4) AS lead_saving, row_number() OVER (ORDER BY round(lead_saving + 1e-9, 4) DESC NULLS LAST, task_id, variant) AS position FROM led"),
        "compare_order": LEDGER_SQL + f""", pairs AS (SELECT task_id, model, effort FROM grades WHERE variant IN ('{A}', '{B}') GROUP BY ALL HAVING avg(value) FILTER (variant = '{A}') IS NOT NULL AND avg(value) FILTER (variant = '{B}') IS NOT NULL)
SELECT task_id, count(*) AS n_pairs, row_number() OVER (ORDER BY task_id) AS position FROM pairs GROUP BY task_id""",
        "duplicate_keys": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
        "sanitized_ledger": EVENT_SQL + "SELECT event_type AS task_id, run_status, count(*) AS n, sum(k)::BIGINT AS turns, 0::BIGINT AS n_ids, 0::BIGINT AS n_times FROM runs GROUP BY ALL",
        "captured_artifacts": """WITH f AS (SELECT user_id || '-' || event_type || '.md' AS name, (event_id % 3) || '/' || user_id || '-' || event_type || '.md' AS path, ts AS modified, props AS content FROM events),
w AS (SELECT user_id || ':' || event_type AS run_id, user_id || '-' || event_type || '.md' AS name, '1/' || user_id || '-' || event_type || '.md' AS artifact, min(ts) FILTER (event_id % 2 = 0) AS since FROM events GROUP BY user_id, event_type)
SELECT run_id, artifact, coalesce(content, '') AS content, content IS NULL AS missing FROM w LEFT JOIN f ON f.name = w.name AND modified >= since
QUALIFY row_number() OVER (PARTITION BY run_id, artifact ORDER BY (path = artifact) DESC, modified DESC, path DESC) = 1""",
        "sign_flip_exact": """WITH s AS (SELECT s_suppkey % 5 AS team, s_suppkey // 100 AS block, s_suppkey, round((s_acctbal - 3000 - 400 * (s_suppkey % 5)) / 1000, 3) AS d FROM supplier WHERE s_suppkey IS NOT NULL),
g AS (SELECT team, block, count(*) AS n, list(d ORDER BY s_suppkey) FILTER (d <> 0) AS d FROM s GROUP BY ALL), h AS (SELECT *, d[1:len(d) // 2] AS l, d[len(d) // 2 + 1:] AS r FROM g),
a AS (SELECT team, block, list_sum(list_append(list_transform(l, lambda x, i: CASE WHEN (m >> (i - 1)) % 2 = 1 THEN x ELSE -x END), 0)) AS s FROM (SELECT *, unnest(range((1 << len(l))::BIGINT)) AS m FROM h)),
b AS (SELECT team, block, list_sum(list_transform(r, lambda x, i: CASE WHEN (m >> (i - 1)) % 2 = 1 THEN x ELSE -x END)) AS s FROM (SELECT *, unnest(range((1 << len(r))::BIGINT)) AS m FROM h)),
p AS (SELECT team, block, avg((abs(a.s + b.s) >= abs(list_sum(d)) - len(d) * 1e-12)::INT) AS p FROM a JOIN b USING (team, block) JOIN h USING (team, block) GROUP BY team, block)
SELECT team, block, n, round(p + 1e-9, 6) AS p_value FROM g LEFT JOIN p USING (team, block)""",
        "advise_total": _advice_sql("latency", "SELECT round(sum(greatest(0, lead_saving)) FILTER (NOT vacuous) + 1e-9, 4) AS total_saving, bool_or(fallback) AS any_fallback, bool_or(suspect) AS any_suspect, bool_or(vacuous) AS any_vacuous FROM led"),
        "infra_breaker": EVENT_SQL + """, i AS (SELECT *, sum((run_status = 'ok')::INT) OVER w AS island, row_number() OVER w AS pos FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, sum((run_status IN ('infra_error', 'timeout'))::INT) OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM i)
SELECT user_id, count(*) AS n_runs, max(streak)::BIGINT AS longest, min(pos) FILTER (streak >= 5)::BIGINT AS halt_at FROM s GROUP BY user_id""",
        "tool_histogram": "SELECT user_id, event_type AS tool, count(*) AS n FROM events GROUP BY ALL",
        "status_tallies": EVENT_SQL + "SELECT run_status, grade_status, count(*) AS n FROM runs GROUP BY ALL",
        "balanced_subsample": """WITH p AS (SELECT doc_id, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) <= 10)
SELECT row_number() OVER (ORDER BY md5('42o:' || doc_id), doc_id) - 1 AS idx, doc_id, toxic FROM p""",
        "clf_confusion": """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn) + 1e-9, 4) AS accuracy, round(tp / (tp + fp) + 1e-9, 4) AS precision, round(tp / (tp + fn) + 1e-9, 4) AS recall, round(2 * tp / (2 * tp + fp + fn) + 1e-9, 4) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2 + 1e-9, 4) AS auroc FROM c""",
        "grid_expand": _GRID + "SELECT * FROM grid",
        "spend_projection": _GRID + """SELECT count(*) AS n_cells, count(*) * 0.25::DOUBLE AS cost_usd, count(*) * 1.5::DOUBLE AS latency_s, NULL::BIGINT AS tokens,
  (SELECT concat_ws('|', g.task_id, g.model, g.effort, n_nationkey || '.' || list_position(['none', 'r0@main', 'r1@main', 'r1@dev@x'], variant) - 1 || '.' || r_regionkey || '.' || list_position(['low', 'medium', 'high'], g.effort) - 1 || '.' || epoch)
   FROM grid g JOIN nation ON n_name = g.task_id JOIN region ON lower(r_name) = g.model ORDER BY n_nationkey, list_position(['none', 'r0@main', 'r1@main', 'r1@dev@x'], variant), r_regionkey, list_position(['low', 'medium', 'high'], g.effort), epoch LIMIT 1) AS first FROM grid""",
        "grid_sizes": _GRID + f"SELECT {_CELL}, count(*) AS n_cells FROM grid GROUP BY ALL",
        "resume_plan": LEDGER_SQL + f""", l AS (SELECT *, tie_part % 4 AS epoch FROM ledger), ok AS (SELECT * FROM l WHERE run_status = 'ok'),
g AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY {_CELL}, epoch, grader_version ORDER BY ts DESC, run_id DESC, tie_part DESC, tie_supplier DESC, tie_price DESC) = 1),
r AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY {_CELL}, epoch ORDER BY ts DESC, run_id DESC, tie_part DESC, tie_supplier DESC, tie_price DESC) = 1)
SELECT c.task_id, c.model, c.effort, c.variant, c.epoch, CASE WHEN g.spec_sha = 's1' AND g.grade_status <> 'grader_error' THEN 'skip' WHEN r.spec_sha = 's1' THEN 'regrade' ELSE 'run' END AS action
FROM (SELECT DISTINCT {_CELL}, epoch FROM l) c
LEFT JOIN g ON g.task_id = c.task_id AND g.model = c.model AND g.effort = c.effort AND g.variant = c.variant AND g.epoch = c.epoch AND g.grader_version = 'v1'
LEFT JOIN r ON r.task_id = c.task_id AND r.model = c.model AND r.effort = c.effort AND r.variant = c.variant AND r.epoch = c.epoch""",
        "verdict_parse": """WITH t AS (SELECT conv_id, turn, lower(trim(['Injection: ', ' safe ', 'is it an INJECTION? ', 'looks safe ', 'injection or safe ', ''][turn % 6 + 1] || role)) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN starts_with(t, 'injection') THEN 1 WHEN starts_with(t, 'safe') THEN 0 WHEN contains(t, 'injection') AND NOT contains(t, 'safe') THEN 1 WHEN contains(t, 'safe') AND NOT contains(t, 'injection') THEN 0 END AS verdict FROM t""",
        "answer_forms": "SELECT p_partkey, (p_partkey * 997)::VARCHAR AS bare, regexp_replace(p_name, '\\s+', '', 'g') AS squashed, (p_partkey * 1000)::DOUBLE AS number FROM part",
        "spec_fingerprint": "SELECT p_partkey, substr(sha256(concat_ws(chr(31), p_name, p_brand, p_type)), 1, 16) AS fingerprint, substr(sha256('{\"gold\":{\"a\":\"' || p_name || '\",\"b\":' || p_size || '},\"prompt\":\"' || p_brand || '\",\"schema\":null,\"tools\":[\"Edit\",\"Read\"]}'), 1, 16) AS spec FROM part",
        "sanitize_violations": "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE contains(text, '@') OR contains(text, 'License') OR length(text) > 5000",
        "hashed_draws": "SELECT s_suppkey, round(('0x' || substr(md5('42:' || s_suppkey), 1, 8))::BIGINT / 4294967296, 6) AS u FROM supplier",
        "chapter_fence": "SELECT p_partkey, '# ' || p_name || chr(10) || p_brand AS chapter, 2::BIGINT AS n_blocks FROM part",
        "tag_census": r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?sm)^[ \t]*```.*?^[ \t]*```', '', 'g') AS h FROM pages)
SELECT page_id, len(regexp_extract_all(h, '<a\b([^>]*?)/?>'))::BIGINT AS n_a, len(regexp_extract_all(h, '<p\b([^>]*?)/?>'))::BIGINT AS n_p, len(regexp_extract_all(h, '<div\b([^>]*?)/?>'))::BIGINT AS n_div,
  len(list_filter(regexp_extract_all(h, '<a\b([^>]*?)/?>'), lambda x: regexp_matches(x, '\bhref\s*=\s*("[^"]*"|''[^'']*''|\{[^}]*\})')))::BIGINT AS n_href FROM h""",
        "stream_json_parse": """SELECT conv_id, '{"type":"result","n":' || max(turn) FILTER (turn % 3 = 1) || '}' AS payload, coalesce(string_agg(role, ',' ORDER BY turn, role) FILTER (turn % 3 = 0), '') AS tools FROM conversations GROUP BY conv_id""",
    }
    return out | SQL | {f"pareto_{a}": _pareto_sql(a) for a in FR.AXES} | {f"advise_{a}": _advice_sql(a, _ADVICE_TAIL.format(axis=a, **dict(zip(("better", "worse", "equal", "best"), AD.WORDS[a])))) for a in FR.AXES}
