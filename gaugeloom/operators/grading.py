"""Classification grades: confusion counts, AUROC of hard labels and its interval, balanced samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import hash_uniform, let, normal_quantile, normal_share

#: Least items of an interval, its resamples and seed.
LEAST_ITEMS, RESAMPLES, SEED = 10, 1000, 42


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion_of(gold: Column, predicted: Column, counts: Column | None = None) -> list[Column]:
    """Aggregates n, tp, fp, tn, fn, accuracy, precision, recall, f1 (0/0 is 0) and auroc (null with one class); a missing prediction is the wrong label. ``counts``: which rows do."""
    counts = F.lit(True) if counts is None else counts
    p = F.coalesce(predicted, 1 - gold)
    count = lambda g, v: F.count_if(counts & (gold == g) & (p == v))
    tp, fp, tn, fn = count(1, 1), count(0, 1), count(0, 0), count(1, 0)
    return [
        F.count_if(counts).alias("n"), tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.when((tp + fn > 0) & (fp + tn > 0), (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("auroc"),
    ]


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts and ratios of all rows; see ``confusion_of``."""
    return rows.agg(*confusion_of(F.col(gold), F.col(predicted))).drop("n")


COUNTS = ("tp", "fp", "tn", "fn")


def _auroc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """AUROC of hard labels; null without both classes."""
    return (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2


def _drawn_counts(counts: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(_key, b, and the four counts as resample b draws them): a count of c items is the sum of c Poisson weights of mean 1, which is a Poisson number of mean c.

    It is drawn by inversion with one hashed uniform. Distribution functions reach ten standard deviations to both sides, and draws meet
    them in one sorted sequence, so the work grows with the root of a count.
    """
    each = counts.select("_key", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).cast("long").alias("c")) for name in COUNTS))).alias("e")).select("_key", "e.*")
    reach = F.ceil(10 * F.sqrt("c")) + 20
    steps = each.withColumn("k", F.explode(F.when(F.col("c") > 0, F.sequence(F.greatest(F.lit(0).cast("long"), F.col("c") - reach), F.col("c") + reach)).otherwise(F.array(F.lit(0).cast("long")))))
    here, by_k = Window.partitionBy("_key", "name"), Window.partitionBy("_key", "name").orderBy("k")
    steps = steps.withColumn("log_p", F.sum(F.when(F.lag("k").over(by_k).isNull(), 0.0).otherwise(F.log(F.col("c") / F.col("k").cast("double")))).over(by_k))
    steps = steps.withColumn("p", F.exp(F.col("log_p") - F.max("log_p").over(here)))
    steps = steps.select("_key", "name", (F.sum("p").over(by_k) / F.sum("p").over(here)).alias("u"), "k", F.lit(None).cast("int").alias("b"))
    draws = each.select("_key", "name", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    uniform = hash_uniform(F.lit(str(seed)), F.col("b").cast("string"), F.col("name"), F.coalesce(F.col("_key").cast("string"), F.lit("")))
    both = steps.unionByName(draws.select("_key", "name", uniform.alias("u"), F.lit(None).cast("long").alias("k"), "b"))
    # from above, so that each draw meets the least step that reaches it, and a running frame does
    above = Window.partitionBy("_key", "name").orderBy(F.col("u").desc(), F.col("b").isNull().desc(), F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("k", F.last("k", ignorenulls=True).over(above)).filter("b is not null")
    return found.groupBy("_key", "b").agg(*(F.max(F.when(F.col("name") == name, F.col("k"))).alias(name) for name in COUNTS))


def auroc_interval(counts: DataFrame, key: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(key, auroc, low, high, note): bias-corrected and accelerated 95 % intervals of the AUROC of hard labels, from the columns tp, fp, tn, fn alone.

    ``key`` tells the rows apart. Items of one of the four kinds are alike, so a resample is four numbers; those without both classes don't count.
    Under LEAST_ITEMS items or with one class there is no interval; where resamples don't vary, it is degenerate.
    """
    counts = counts.select(F.col(key).alias("_key"), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS))
    point = _auroc(*(F.col(c) for c in COUNTS))
    fit = (sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0])) >= LEAST_ITEMS) & (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    drawn = _drawn_counts(counts.filter(fit), resamples, seed).select(F.col("_key").alias("_of"), _auroc(*(F.col(c) for c in COUNTS)).alias("x"))
    drawn = drawn.groupBy("_of").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows = counts.withColumn("auroc", point).join(drawn, F.col("_key").eqNullSafe(F.col("_of")), "left")
    # what is left when one item of a kind is taken away, and how far that is from the mean of all such
    left = [F.when(F.col(c) > 0, _auroc(*(F.col(d) - (1 if c == d else 0) for d in COUNTS))) for c in COUNTS]
    rows = rows.withColumns({f"left_{c}": x for c, x in zip(COUNTS, left)})
    weight = lambda c: F.when(F.col(f"left_{c}").isNotNull(), F.col(c)).otherwise(0)
    total = lambda of: sum((of(c) for c in COUNTS[1:]), of(COUNTS[0]))
    rows = rows.withColumn("mean_left", F.try_divide(total(lambda c: weight(c) * F.coalesce(F.col(f"left_{c}"), F.lit(0.0))), total(weight)))
    power = lambda n: total(lambda c: weight(c) * F.coalesce(F.pow(F.col("mean_left") - F.col(f"left_{c}"), F.lit(n)), F.lit(0.0)))
    same = lambda x: F.abs(x - F.col("auroc")) <= 1e-12
    share = (F.size(F.filter("xs", lambda x: x < F.col("auroc") - 1e-12)) + 0.5 * F.size(F.filter("xs", same))) / F.size("xs")
    rows = rows.withColumns({"square": power(2.0), "cube": power(3.0), "share": share})
    vary = F.coalesce((F.col("xs")[0] < F.element_at("xs", -1)) & (F.col("square") > 0) & (F.col("share") > 0) & (F.col("share") < 1), F.lit(False))
    rows = rows.withColumns({"vary": vary, "z": normal_quantile(F.col("share")), "a": F.try_divide(F.col("cube"), 6 * F.pow("square", F.lit(1.5)))})

    def bound(q: float) -> Column:
        lean = F.col("z") + F.lit(q)
        place = normal_share(F.col("z") + lean / (1 - F.col("a") * lean)) * (F.size("xs") - 1)
        between = lambda h: F.element_at("xs", F.floor(h).cast("int") + 1) * (1 - h + F.floor(h)) + F.element_at("xs", F.ceil(h).cast("int") + 1) * (h - F.floor(h))
        return F.when(F.col("vary"), let(place, between))

    z = 1.959963984540054
    return rows.select(F.col("_key").alias(key), "auroc", bound(-z).alias("low"), bound(z).alias("high"), F.when(F.col("xs").isNotNull() & ~F.col("vary"), "degenerate").alias("note"))


def balanced_subsample(rows: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """(idx, key, label): n/2 rows of each of the labels 0 and 1, chosen and ordered by hashes of the seed and the key; a class that has fewer is an error."""
    if n <= 0 or n % 2:
        raise ValueError("n must be even and positive")
    h = lambda salt: F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), F.col(key).cast("string")))
    picked = rows.filter(F.col(label).isin(0, 1)).withColumn("rn", F.row_number().over(Window.partitionBy(label).orderBy(h(""), key))).filter(F.col("rn") <= n // 2)
    short = F.assert_true(F.count(F.lit(1)).over(Window.partitionBy()) == n, F.lit(f"a class has fewer than {n // 2} rows"))
    picked = picked.withColumn("short", short).filter("short is null")
    return picked.select((F.row_number().over(Window.orderBy(h("o"), key)) - 1).cast("long").alias("idx"), key, label)
