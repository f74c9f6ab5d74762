"""Metrics of labels against predictions, clusters and scores, each from one small table of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: accuracy, balanced accuracy, precision, recall and F1 (macro, micro, weighted; 0 where undefined), Matthews correlation, quadratic kappa.

    Everything follows from the confusion counts, whose rows are as many as pairs of classes. Classes are integers.
    """
    conf = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))
    by = lambda c, out: conf.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(out))
    hit = conf.where("y = p").select(F.col("y").alias("k"), F.col("n").alias("tp"))
    per = by("y", "truth").join(by("p", "found"), "k", "full").join(hit, "k", "left").na.fill(0.0)
    prec, rec = _ratio(F.col("tp"), F.col("found")), _ratio(F.col("tp"), F.col("truth"))
    per = per.select("k", "truth", "found", "tp", prec.alias("prec"), rec.alias("rec"), _ratio(2 * prec * rec, prec + rec).alias("f1"))
    weigh = lambda c: _ratio(F.sum(F.col(c) * F.col("truth")), F.sum("truth"))
    n, c = F.sum("truth"), F.sum("tp")
    cross, pp, tt = F.sum(F.col("truth") * F.col("found")), F.sum(F.col("found") ** 2), F.sum(F.col("truth") ** 2)
    one = per.agg(
        _ratio(c, n).alias("accuracy"),
        F.avg(F.when(F.col("truth") > 0, F.col("rec"))).alias("balanced_accuracy"),
        *(F.avg(x).alias(f"{name}_macro") for x, name in (("prec", "precision"), ("rec", "recall"), ("f1", "f1"))),
        *(_ratio(c, n).alias(f"{name}_micro") for name in ("precision", "recall", "f1")),
        *(weigh(x).alias(f"{name}_weighted") for x, name in (("prec", "precision"), ("rec", "recall"), ("f1", "f1"))),
        _ratio(c * n - cross, F.sqrt((n * n - pp) * (n * n - tt))).alias("mcc"),
    )
    expected = per.select(F.col("k").alias("y"), "truth").crossJoin(per.select(F.col("k").alias("p"), "found"))  # classes by classes
    weight = (F.col("y") - F.col("p")) ** 2
    off = expected.agg(F.sum(weight * F.col("truth") * F.col("found")).alias("e"), F.max("truth")).select("e")
    seen = conf.agg(F.sum(weight * F.col("n")).alias("o"), F.sum("n").alias("total"))
    kappa = seen.crossJoin(off).select((1 - _ratio(F.col("o") * F.col("total"), F.col("e"))).alias("kappa_quadratic"))
    return one.crossJoin(kappa)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve of 0/1 labels, ties counted half; null without both classes. Rows are first summed by score."""
    t = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1.0).otherwise(0.0)).alias("n"))
    below = F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    t = t.withColumn("u", F.col("p") * (below + F.col("n") / 2))
    return t.agg((F.sum("u") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def roc_auc_classes(df: DataFrame, label: str, cls: str, score: str) -> DataFrame:
    """One row: area under the ROC curve over several classes, one against one and one against the rest, both macro means; null with fewer than two classes.

    df has a row per item and class: the item's label, the class, the score of the item for it. Rows are first summed by class, label and score; an ordering then
    goes over the distinct scores of one pair of classes.
    """
    n = df.groupBy(F.col(cls).alias("k"), F.col(label).alias("y"), F.col(score).alias("s")).agg(F.count("*").cast("double").alias("n"))
    classes = n.select("y").distinct()
    own = n.where("y = k").join(classes.withColumnRenamed("y", "j")).where("j <> k").select("k", "j", "s", F.col("n").alias("p"), F.lit(0.0).alias("q"))
    other = n.where("y <> k").join(classes.withColumnRenamed("y", "k"), "k", "left_semi").select("k", F.col("y").alias("j"), "s", F.lit(0.0).alias("p"), F.col("n").alias("q"))
    t = own.unionByName(other)

    def area(t: DataFrame, by: list[str]) -> DataFrame:
        t = t.groupBy(*by, "s").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        below = F.sum("q").over(Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("q")
        return t.withColumn("u", F.col("p") * (below + F.col("q") / 2)).groupBy(*by).agg((F.sum("u") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("auc"))

    rest = n.join(classes.withColumnRenamed("y", "k"), "k", "left_semi").select("k", "s", F.when(F.col("y") == F.col("k"), F.col("n")).otherwise(0.0).alias("p"), F.when(F.col("y") != F.col("k"), F.col("n")).otherwise(0.0).alias("q"))
    return area(t, ["k", "j"]).agg(F.avg("auc").alias("ovo")).crossJoin(area(rest, ["k"]).agg(F.avg("auc").alias("ovr")))


def cluster_agreement(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Normalised mutual information, adjusted Rand index and purity from the contingency table."""
    t = df.groupBy(F.col(label).alias("y"), F.col(cluster).alias("c")).agg(F.count("*").cast("double").alias("n"))
    w = lambda *c: Window.partitionBy(*c)
    pairs = lambda x: x * (x - 1) / 2
    t = t.withColumns({"a": F.sum("n").over(w("y")), "b": F.sum("n").over(w("c")), "top": F.max("n").over(w("c")), "ry": F.row_number().over(w("y").orderBy("c")), "rc": F.row_number().over(w("c").orderBy("y"))})
    total = t.agg(F.sum("n").alias("total"))
    t = t.crossJoin(total)
    N, first_y, first_c = F.col("total"), F.col("ry") == 1, F.col("rc") == 1
    mi = F.sum(F.col("n") / N * F.log(F.col("n") * N / (F.col("a") * F.col("b"))))
    hy, hc = F.sum(F.when(first_y, -F.col("a") / N * F.log(F.col("a") / N))), F.sum(F.when(first_c, -F.col("b") / N * F.log(F.col("b") / N)))
    both, pa, pb, all_ = F.sum(pairs(F.col("n"))), F.sum(F.when(first_y, pairs(F.col("a")))), F.sum(F.when(first_c, pairs(F.col("b")))), F.max(pairs(N))
    chance = pa * pb / all_
    return t.agg(_ratio(2 * mi, hy + hc).alias("nmi"), ((both - chance) / ((pa + pb) / 2 - chance)).alias("ari"), (F.sum(F.when(first_c, F.col("top"))) / F.max(N)).alias("purity"))
