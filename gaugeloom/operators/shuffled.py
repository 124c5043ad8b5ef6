"""AUROC of hard labels after the gold labels were shuffled: about one half unless the labels leak."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import hash_uniform

SHUFFLES, SEED = 200, 12345


def shuffled_auroc(rows: DataFrame, group: str, gold: str, predicted: str, shuffles: int = SHUFFLES, seed: int = SEED) -> DataFrame:
    """(group, n, shuffled_auroc): the mean over ``shuffles`` permutations of each group's labels; null with one class.

    Of a permutation only the number of true positives counts, and that is hypergeometric. So a group is
    aggregated to three counts, and each permutation draws that number by inversion with one hashed uniform: rows are
    neither repeated nor ordered. A missing prediction is the wrong label.
    """
    p = F.coalesce(F.col(predicted), 1 - F.col(gold))
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(gold) == 1).alias("ones"), F.count_if(p == 1).alias("said"))
    low, high = F.greatest(F.lit(0).cast("long"), F.col("ones") + F.col("said") - F.col("n")), F.least("ones", "said")
    each = counts.select(group, "n", "ones", "said", F.explode(F.sequence(low, high)).alias("k"))
    # log of the odds of k against k - 1 true positives
    step = F.log((F.col("ones") - F.col("k") + 1) * (F.col("said") - F.col("k") + 1) / (F.col("k") * (F.col("n") - F.col("ones") - F.col("said") + F.col("k")).cast("double")))
    by_k = Window.partitionBy(group).orderBy("k")
    each = each.withColumn("log_p", F.coalesce(F.sum(F.when(F.lag("k").over(by_k).isNotNull(), step)).over(by_k), F.lit(0.0)))
    each = each.withColumn("p", F.exp(F.col("log_p") - F.max("log_p").over(Window.partitionBy(group))))
    each = each.withColumn("upto", F.sum("p").over(by_k) / F.sum("p").over(Window.partitionBy(group)))
    tables = each.groupBy(group, "n", "ones", "said").agg(F.min("k").alias("low"), F.array_sort(F.collect_list("upto")).alias("upto"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(shuffles - 1)), lambda b: hash_uniform(F.lit(str(seed)), b.cast("string"), F.coalesce(F.col(group).cast("string"), F.lit(""))))
    hits = F.transform(drawn, lambda u: F.col("low") + F.size(F.filter("upto", lambda x: x < u)))
    zeros = F.col("n") - F.col("ones")
    auroc = F.transform(hits, lambda tp: (F.try_divide(tp, F.col("ones")) + F.try_divide(zeros - F.col("said") + tp, zeros)) / 2)
    return tables.select(group, "n", (F.aggregate(auroc, F.lit(0.0), lambda s, x: s + x) / shuffles).alias("shuffled_auroc"))
