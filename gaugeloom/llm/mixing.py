r"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets: sources in order of code points (null last) weigh 1, 2, 3, repeating, and share all words by
weight; a target stops at ``ceiling`` times its source's size, and the excess is reshared by weight. The
level at which that ends is read off running sums over sources ordered by ceiling / weight.

Rates: of all rates between 0 and the ceiling for which each source's words meet its target, those with the
least relative entropy to one copy of each document are exponentially tilted by the size,
min(ceiling, exp(lambda * size)). The lambda of each source is where the convex dual is flat: the words at lambda,
w(lambda), equal the target t. Each Newton step sums w and its slope over the (source, size) histogram, for all
sources at once, and moves lambda by (log t - log w) w / w'; a step that leaves the bracket of what is known is halved
instead. Sums are decimal, so they don't depend on the order of tasks. States are written between steps.

Copies: rates are whole numbers of 1 / UNIT. Documents of a source are ordered by size and, within a size, by the md5
of their id; with C the sum of rates up to a document and f a phase, it gets the number of whole numbers that
C + f passes at it. So copies follow the rates at every size, and none is below 0 or above the ceiling. Of PHASES phases,
a source takes the one whose words come nearest to its target; then one copy of one document more or less, if that
comes nearer. All of this is read off the histogram; only the place among documents of one size and source is ranked,
within 4,096 parts of its own, so no task orders a whole source.

Defined cases: a null text has size 0; a source of size 0 has target 0; sizes of 0 take 0 words;
a null doc_id orders like an empty one; repeated rows are documents of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dropped, written

CEILING = 3
#: Rates are rounded to this part of a copy.
UNIT = 1_000_000
#: Phases of the rounding that are tried, (2 k + 1) / (2 PHASES) copies.
PHASES = 50
#: Tasks that write the state of a step, which has one row a source.
STATE_TASKS = 8
#: Newton's steps end with this relative distance to the target; one more step follows.
_NEAR = 1e-9
#: Halving alone would take about so many steps.
_MOST_STEPS = 200


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(totals: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """The columns of ``totals`` (source, source_size, ...) with weight and target; one row a source, so its windows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = totals.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", F.lit(ceiling) * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("place", F.row_number().over(by_ratio))
    )
    # with all sources before this one at their ceilings, the level of the others; the first that lies below its own ceiling holds
    level = (F.col("total") - F.col("capped")).cast("double") / F.col("left_weight")
    rows = rows.withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("place", level.alias("level")))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return rows.select(*totals.columns, "weight", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _beside(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Inner join in which null keys are equal; the keys of ``right`` are left out."""
    renamed = right.select(*(F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(renamed, on).drop(*(f"_{k}" for k in keys))


def tilts(histogram: DataFrame, sources: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """source, source_size, target, full (all at the ceiling), lam from ``histogram`` (source, size, n) and ``sources`` (source, source_size, squares, least_size, target); written."""
    share = F.try_divide("target", F.col("source_size").cast("double"))
    some = (F.col("source_size") > 0) & (F.col("target") > 0)
    bound = F.log(F.when(share > 1, F.lit(float(ceiling))).otherwise(share)) / F.col("least_size")  # even the smallest document has passed the target's share there
    state = sources.select(
        "source", "source_size", "target", (some & (share >= ceiling * (1 - 1e-12))).alias("full"), (~some | (share >= ceiling * (1 - 1e-12))).alias("done"),
        F.when(some, F.log(share) * F.col("source_size") / F.col("squares")).otherwise(0.0).alias("lam"),
        F.when(some & (share < 1), bound).otherwise(0.0).alias("lo"), F.when(some & (share > 1), bound).otherwise(0.0).alias("hi"),
    )
    state = written(state, "tilts")
    tilt = F.col("lam") * F.col("size")
    words = F.col("n") * F.col("size") * F.least(F.lit(float(ceiling)), F.exp(tilt))
    slope = F.when(tilt < math.log(ceiling), F.col("n") * F.col("size") * F.col("size") * F.exp(tilt)).otherwise(0.0)
    for _ in range(_MOST_STEPS):
        if state.filter("not done").isEmpty():
            return state
        summed = _beside(histogram, state, ("source",)).groupBy("source").agg(
            *(F.first(c).alias(c) for c in state.columns if c != "source"), F.sum(words.cast("decimal(38,12)")).cast("double").alias("w"), F.sum(slope.cast("decimal(38,12)")).cast("double").alias("s")
        )
        lo, hi = F.when(F.col("w") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("w") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + F.log(F.col("target") / F.col("w")) * F.col("w") / F.nullif(F.col("s"), F.lit(0.0))
        moved = F.when((newton >= lo) & (newton <= hi), newton).otherwise((lo + hi) / 2)
        near = (F.abs(F.col("w") - F.col("target")) <= _NEAR * F.col("target")) | (hi - lo <= 1e-15 * F.greatest(F.abs(lo), F.abs(hi)))
        summed = summed.coalesce(STATE_TASKS)
        before, state = state, written(summed.select("source", "source_size", "target", "full", (F.col("done") | near).alias("done"), F.when(F.col("done"), F.col("lam")).otherwise(moved).alias("lam"), lo.alias("lo"), hi.alias("hi")), "tilts")
        dropped(before)
    raise RuntimeError("Newton's steps did not end")


def _copies(base: Column, rate: Column, count: Column, phase: Column) -> Column:
    """Whole numbers passed from ``base`` on by ``count`` documents of one ``rate``."""
    floor = lambda x: F.floor((x - F.pmod(x, F.lit(UNIT))) / UNIT).cast("long")
    return floor(base + rate * count + phase) - floor(base + phase)


def plan(histogram: DataFrame, tilted: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """For each (source, size): source_size, target, rate and base in 1 / UNIT, phase, and the place ``mend_at`` (or null) of the document that gets ``mend`` copies more."""
    rate = F.when(F.col("full"), F.lit(ceiling * UNIT)).when(F.col("target") > 0, F.round(F.least(F.lit(float(ceiling)), F.exp(F.col("lam") * F.col("size"))) * UNIT)).otherwise(0).cast("long")
    rows = _beside(histogram, tilted.select("source", "source_size", "target", "full", "lam"), ("source",)).withColumn("rate", rate).drop("full", "lam")
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rows = written(rows.withColumn("base", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(smaller), F.lit(0).cast("long"))), "rates")
    phases = [(2 * k + 1) * UNIT // (2 * PHASES) for k in range(PHASES)]
    words = lambda f: _copies(F.col("base"), F.col("rate"), F.col("n"), F.lit(f).cast("long")) * F.col("size")
    tried = rows.groupBy("source").agg(F.max("target").alias("t"), *(F.sum(words(f)).alias(f"w{f}") for f in phases))
    tries = F.array(*(F.struct(F.abs(F.col(f"w{f}") - F.col("t")).alias("off"), F.lit(f).cast("long").alias("phase"), (F.col(f"w{f}") - F.col("t")).alias("excess")) for f in phases))
    nearest = tried.select("source", F.array_min(tries).alias("best")).select("source", "best.phase", "best.excess")
    rows = _beside(rows, written(nearest, "phases"), ("source",))
    copies, start = _copies(F.col("base"), F.col("rate"), F.col("n"), F.col("phase")), F.pmod(F.col("base") + F.col("phase"), F.lit(UNIT))
    # the first document of the size that has a copy to lose, or room for one more
    loses = F.ceil((UNIT - start) / F.nullif(F.col("rate"), F.lit(0))).cast("long")
    gains = (F.floor(start / F.nullif(ceiling * UNIT - F.col("rate"), F.lit(0))) + 1).cast("long")
    place = F.when((F.col("excess") > 0) & (copies > 0), loses).when((F.col("excess") < 0) & (copies < ceiling * F.col("n")), gains)
    left = F.abs(F.abs(F.col("excess")) - F.col("size"))
    rows = rows.withColumn("place", F.when(left < F.abs("excess"), place)).withColumn("left", left)
    best = rows.filter("place is not null").groupBy("source").agg(F.min(F.struct("left", "size")).alias("m")).select("source", F.col("m.size").alias("mend_size"))
    best = written(best, "mends").select(F.col("source").alias("ms"), "mend_size")
    rows = rows.join(best, F.col("source").eqNullSafe(F.col("ms")) & (F.col("size") == F.col("mend_size")), "left")
    mended = F.col("mend_size").isNotNull()
    return rows.select("source", "size", "source_size", "target", "rate", "base", "phase", F.when(mended, F.col("place")).alias("mend_at"), F.when(mended, -F.signum("excess")).otherwise(0).cast("long").alias("mend"))


def mix(documents: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken for every document."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("h"))
    docs = written(docs.withColumn("part", F.substring("h", 1, 3)), "mixing")
    parts = written(docs.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), "parts")
    histogram = written(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    totals = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum((F.col("size") * F.col("size")).cast("decimal(38,0)") * F.col("n")).cast("double").alias("squares"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size")
    )
    planned = written(plan(histogram, tilts(histogram, targets(totals, ceiling), ceiling), ceiling), "plan")
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    offsets = _beside(offsets, planned, ("source", "size"))
    rows = _beside(docs, offsets, ("source", "size", "part"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    rows = rows.withColumn("place", place.cast("long"))
    copies = _copies(F.col("base") + F.col("rate") * (F.col("place") - 1), F.col("rate"), F.lit(1), F.col("phase"))
    copies = copies + F.when(F.col("place") == F.col("mend_at"), F.col("mend")).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB's SQL, over the view ``documents``: lambdas by halving, ranks by one ordering of each source and running sums of rates.
ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size, MIN(size) FILTER (size > 0) AS least_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sources
), levels AS (  -- with all sources of a smaller ceiling / weight at their ceilings, what is left for a weight of one
  SELECT a.source, 3 * a.source_size / a.weight::DOUBLE AS own,
         ((SELECT SUM(source_size) FROM sources) - COALESCE((SELECT SUM(3 * b.source_size) FROM weighed b WHERE b.source_size * a.weight < a.source_size * b.weight), 0))::DOUBLE
         / (SELECT SUM(b.weight) FROM weighed b WHERE b.source_size * a.weight >= a.source_size * b.weight)::DOUBLE AS level
  FROM weighed a
), targets AS (
  SELECT source, source_size, least_size,
         COALESCE(LEAST(3 * source_size::DOUBLE, weight * (SELECT level FROM levels WHERE level <= own ORDER BY own LIMIT 1)), 3 * source_size::DOUBLE) AS target
  FROM weighed
), histogram AS (
  SELECT source, size, COUNT(*) AS n FROM docs WHERE size > 0 GROUP BY source, size
), halved AS (
  SELECT source, target, 0 AS step, CASE WHEN target < source_size THEN ln(target / source_size) / least_size ELSE 0 END AS lo,
         CASE WHEN target > source_size THEN ln(3) / least_size ELSE 0 END AS hi
  FROM targets WHERE target > 0 AND target < 3 * source_size::DOUBLE * (1 - 1e-12)
  UNION ALL
  SELECT s.source, s.target, s.step + 1, CASE WHEN SUM(n * size * LEAST(3, exp(mid * size))) < s.target THEN mid ELSE lo END,
         CASE WHEN SUM(n * size * LEAST(3, exp(mid * size))) < s.target THEN hi ELSE mid END
  FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved WHERE step < 90) s JOIN histogram g ON g.source IS NOT DISTINCT FROM s.source
  GROUP BY s.source, s.target, s.step, s.lo, s.hi, s.mid
), rated AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.target = 0 THEN 0 WHEN l.source_found IS NULL THEN 3000000 ELSE round(LEAST(3, exp(l.lam * d.size)) * 1000000) END::BIGINT AS rate
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
  LEFT JOIN (SELECT source, (lo + hi) / 2 AS lam, TRUE AS source_found FROM halved WHERE step = 90) l ON d.source IS NOT DISTINCT FROM l.source
), placed AS (
  SELECT *, SUM(rate) OVER (PARTITION BY source ORDER BY size, h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
         row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) AS place
  FROM rated
), tried AS (
  SELECT source, phase, SUM(((upto + phase) // 1000000 - (upto - rate + phase) // 1000000) * size) - max(target) AS excess
  FROM placed, (SELECT ((2 * k + 1) * 10000)::BIGINT AS phase FROM range(50) t(k)) f GROUP BY source, phase
), chosen AS (
  SELECT source, phase, excess FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(excess), phase) = 1
), rounded AS (
  SELECT p.*, f.excess, ((upto + phase) // 1000000 - (upto - rate + phase) // 1000000)::BIGINT AS c
  FROM placed p JOIN chosen f ON p.source IS NOT DISTINCT FROM f.source
), mended AS (
  SELECT source, place FROM rounded
  WHERE ((excess > 0 AND c > 0) OR (excess < 0 AND c < 3)) AND abs(abs(excess) - size) < abs(excess)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(abs(excess) - size), size, place) = 1
)
SELECT r.doc_id, r.size, r.source_size, r.target, rate / 1000000.0::DOUBLE AS rate,
       (c - CASE WHEN m.place IS NOT NULL THEN sign(excess) ELSE 0 END)::BIGINT AS copies, ((c - CASE WHEN m.place IS NOT NULL THEN sign(excess) ELSE 0 END) * r.size)::BIGINT AS taken
FROM rounded r LEFT JOIN mended m ON r.source IS NOT DISTINCT FROM m.source AND r.place = m.place
"""
