"""Classification, clustering and embedding metrics; scores by bin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators import metrics as M
from tesserae.operators import neighbours as N
from tesserae.plans.registry import query, table

#: A prediction to judge: a customer's segment as a number, and a noisy guess of it.
_PRED = "pred AS (SELECT c_custkey, c_nationkey % 5 AS y, CASE WHEN c_custkey % 4 = 0 THEN (c_nationkey + c_custkey) % 5 ELSE c_nationkey % 5 END AS p, round(c_acctbal / 10000, 2) AS s FROM customer)"


def _pred(spark, sf):
    c = table(spark, sf, "customer")
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    return c.select(k, (n % 5).alias("y"), F.when(k % 4 == 0, (n + k) % 5).otherwise(n % 5).alias("p"), F.round(F.col("c_acctbal") / 10000, 2).alias("s"))


def _rounded(df, places=6):
    return df.select(*(F.round(c, places).alias(c) for c in df.columns))


@query(
    "classification_metrics",
    f"""
WITH {_PRED}, conf AS (SELECT y, p, CAST(count(*) AS DOUBLE) AS n FROM pred GROUP BY 1, 2),
t AS (SELECT y AS k, sum(n) AS truth FROM conf GROUP BY 1), f AS (SELECT p AS k, sum(n) AS found FROM conf GROUP BY 1),
per AS (SELECT k, coalesce(truth, 0) AS truth, coalesce(found, 0) AS found, coalesce((SELECT n FROM conf WHERE y = k AND p = k), 0) AS tp FROM t FULL JOIN f USING (k)),
m AS (SELECT *, CASE WHEN found > 0 THEN tp / found ELSE 0 END AS prec, CASE WHEN truth > 0 THEN tp / truth ELSE 0 END AS rec FROM per),
g AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM m),
k AS (SELECT sum(power(y - p, 2) * n) * sum(n) / (SELECT sum(power(a.k - b.k, 2) * a.truth * b.found) FROM per a, per b) AS q FROM conf)
SELECT round(sum(tp) / sum(truth), 6) AS accuracy, round(avg(rec) FILTER (WHERE truth > 0), 6) AS balanced_accuracy,
  round(avg(prec), 6) AS precision_macro, round(avg(rec), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
  round(sum(tp) / sum(truth), 6) AS precision_micro, round(sum(tp) / sum(truth), 6) AS recall_micro, round(sum(tp) / sum(truth), 6) AS f1_micro,
  round(sum(prec * truth) / sum(truth), 6) AS precision_weighted, round(sum(rec * truth) / sum(truth), 6) AS recall_weighted, round(sum(f1 * truth) / sum(truth), 6) AS f1_weighted,
  round((sum(tp) * sum(truth) - sum(truth * found)) / sqrt((power(sum(truth), 2) - sum(found * found)) * (power(sum(truth), 2) - sum(truth * truth))), 6) AS mcc,
  round(1 - (SELECT q FROM k), 6) AS kappa_quadratic FROM g
""",
)
def classification_metrics(spark, sf):
    return _rounded(M.classification(_pred(spark, sf), "y", "p"))


@query(
    "roc_auc_binary",
    f"WITH {_PRED}, r AS (SELECT CASE WHEN y < 2 THEN 1 ELSE 0 END AS t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM pred) SELECT round((sum(r) FILTER (WHERE t = 1) - count(*) FILTER (WHERE t = 1) * (count(*) FILTER (WHERE t = 1) + 1) / 2.0) / (count(*) FILTER (WHERE t = 1) * count(*) FILTER (WHERE t = 0)), 6) AS auc FROM r",
)
def roc_auc_binary(spark, sf):
    return _rounded(M.roc_auc(_pred(spark, sf).withColumn("t", (F.col("y") < 2).cast("int")), "t", "s"))


@query(
    "cluster_agreement",
    f"""
WITH {_PRED}, t AS (SELECT y, p AS c, CAST(count(*) AS DOUBLE) AS n FROM pred GROUP BY 1, 2), a AS (SELECT y, sum(n) AS a FROM t GROUP BY 1), b AS (SELECT c, sum(n) AS b, max(n) AS top FROM t GROUP BY 1),
s AS (SELECT sum(n) AS nn, sum(n * (n - 1) / 2) AS pairs FROM t),
h AS (SELECT (SELECT sum(n / nn * ln(n * nn / (a.a * b.b))) FROM t JOIN a USING (y) JOIN b USING (c), s) AS mi, (SELECT -sum(a / nn * ln(a / nn)) FROM a, s) AS hy, (SELECT -sum(b / nn * ln(b / nn)) FROM b, s) AS hc,
  (SELECT sum(a * (a - 1) / 2) FROM a) AS pa, (SELECT sum(b * (b - 1) / 2) FROM b) AS pb, (SELECT sum(top) FROM b) AS top, nn, pairs, nn * (nn - 1) / 2 AS alls FROM s)
SELECT round(2 * mi / (hy + hc), 6) AS nmi, round((pairs - pa * pb / alls) / ((pa + pb) / 2 - pa * pb / alls), 6) AS ari, round(top / nn, 6) AS purity FROM h
""",
)
def cluster_agreement(spark, sf):
    return _rounded(M.cluster_agreement(_pred(spark, sf), "y", "p"))


_UNIT = """
u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))) AS v FROM embeddings),
d AS (SELECT a.vec_id AS q_id, a.label AS q_label, b.vec_id AS i_id, b.label AS i_label, round(list_inner_product(a.v, b.v), 9) AS dot FROM u a, u b),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dot DESC, i_id) AS k FROM d WHERE q_id <> i_id)
"""


def _near(spark, sf, k, own=False):
    return N.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", k, own)


@query("nearest_neighbours", f"WITH {_UNIT} SELECT q_id, i_id, k FROM r WHERE k <= 3")
def nearest_neighbours(spark, sf):
    return _near(spark, sf, 3).select("q_id", "i_id", F.col("k").cast("long").alias("k"))


@query("recall_at_k", f"WITH {_UNIT}, h AS (SELECT q_id, min(k) FILTER (WHERE q_label = i_label) AS best FROM r WHERE k <= 10 GROUP BY 1) SELECT round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0 END), 6) AS r10 FROM h")
def recall_at_k(spark, sf):
    h = _near(spark, sf, 10).groupBy("q_id").agg(F.min(F.when(F.col("q_label") == F.col("i_label"), F.col("k"))).alias("best"))
    return h.agg(*(F.round(F.avg(F.when(F.col("best") <= n, 1.0).otherwise(0.0)), 6).alias(f"r{n}") for n in (1, 5, 10)))


@query(
    "knn_accuracy",
    f"WITH {_UNIT}, o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dot DESC, i_id) AS j FROM d), v AS (SELECT q_id, q_label, n, i_label, count(*) AS votes FROM o, (VALUES (1), (5), (20)) AS t(n) WHERE j <= n GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY q_id, n ORDER BY votes DESC, i_label) AS w FROM v) SELECT CAST(n AS BIGINT) AS n, round(avg(CASE WHEN q_label = i_label THEN 1.0 ELSE 0 END), 6) AS accuracy FROM b WHERE w = 1 GROUP BY 1",
)
def knn_accuracy(spark, sf):
    """Of 1, 5 and 20 neighbours, each row among its own; ties go to the smallest label."""
    near = _near(spark, sf, 20, own=True).withColumn("n", F.explode(F.array(F.lit(1), F.lit(5), F.lit(20)))).where("k <= n")
    votes = near.groupBy("q_id", "q_label", "n", "i_label").agg(F.count("*").alias("votes"))
    best = votes.withColumn("w", F.row_number().over(Window.partitionBy("q_id", "n").orderBy(F.desc("votes"), "i_label"))).where("w = 1")
    return best.groupBy(F.col("n").cast("long").alias("n")).agg(F.round(F.avg(F.when(F.col("q_label") == F.col("i_label"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query(
    "map_at_r",
    f"WITH {_UNIT}, c AS (SELECT label, count(*) - 1 AS big FROM u GROUP BY 1), h AS (SELECT q_id, big, k, CASE WHEN q_label = i_label THEN 1.0 ELSE 0 END AS hit FROM r JOIN c ON c.label = q_label WHERE k <= big AND big > 0), s AS (SELECT *, sum(hit) OVER (PARTITION BY q_id ORDER BY k ROWS UNBOUNDED PRECEDING) / k AS prec FROM h), q AS (SELECT q_id, sum(prec * hit) / max(big) AS ap FROM s GROUP BY 1) SELECT round(avg(ap), 6) AS map_r FROM q",
)
def map_at_r(spark, sf):
    q = N.precision_at_r(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return q.agg(F.round(F.avg("ap"), 6).alias("map_r"))


@query(
    "silhouette",
    f"WITH {_UNIT}, e AS (SELECT q_id, q_label, i_label, avg(sqrt(greatest(2 - 2 * dot, 0))) AS m FROM r GROUP BY 1, 2, 3), s AS (SELECT q_id, max(m) FILTER (WHERE q_label = i_label) AS a, min(m) FILTER (WHERE q_label <> i_label) AS b FROM e GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s",
)
def silhouette(spark, sf):
    e = N.mean_distances(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    same = F.col("q_label") == F.col("i_label")
    s = e.groupBy("q_id").agg(F.max(F.when(same, F.col("m"))).alias("a"), F.min(F.when(~same, F.col("m"))).alias("b"))
    return s.agg(F.round(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))), 6).alias("silhouette"))


@query("softmax_argmax", "WITH x AS (SELECT vec_id, list_transform(embedding[1:5], lambda z: CAST(z AS DOUBLE) * 10) AS l FROM embeddings), e AS (SELECT vec_id, list_transform(l, lambda z: exp(z - list_max(l))) AS e FROM x) SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS prediction, round(e[1] / list_sum(e), 6) AS proba_0, round(e[5] / list_sum(e), 6) AS proba_4 FROM e")
def softmax_argmax(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda z: z.cast("double") * 10).alias("l")).withColumn("top", F.array_max("l"))
    e = x.select("vec_id", F.transform("l", lambda z: F.exp(z - F.col("top"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, z: a + z)
    return e.select("vec_id", (F.array_position("e", F.array_max("e")) - 1).alias("prediction"), F.round(F.get("e", F.lit(0)) / total, 6).alias("proba_0"), F.round(F.get("e", F.lit(4)) / total, 6).alias("proba_4"))


@query("embeddings_with_labels", "SELECT vec_id, e.label, toxic FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id")
def embeddings_with_labels(spark, sf):
    return table(spark, sf, "embeddings").join(table(spark, sf, "labels"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "label", "toxic")


# Scores by bin.
_BIN = "b AS (SELECT p_partkey, p_size / 50.0 AS area, p_retailprice AS score, least(CAST(floor(p_size / 50.0 * 10) AS BIGINT), 9) AS bin, greatest(CAST(ceil(p_size / 50.0 * 10) AS BIGINT) - 1, 0) AS online FROM part)"


def _bins(spark, sf):
    area = F.col("p_size") / 50.0
    return table(spark, sf, "part").select("p_partkey", area.alias("area"), F.col("p_retailprice").alias("score"), F.least(F.floor(area * 10), F.lit(9)).alias("bin"), F.greatest(F.ceil(area * 10) - 1, F.lit(0)).alias("online"))


@query("scores_by_bin", f"WITH {_BIN} SELECT bin, count(*) AS n, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std FROM b GROUP BY GROUPING SETS ((bin), ())")
def scores_by_bin(spark, sf):
    d = _bins(spark, sf)
    return d.groupingSets([["bin"], []], "bin").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.stddev_pop("score"), 4).alias("std"))


@query("online_bins", f"WITH {_BIN} SELECT online, count(*) AS n FROM b GROUP BY 1")
def online_bins(spark, sf):
    return _bins(spark, sf).groupBy("online").agg(F.count("*").alias("n"))


@query("dataset_stats", f"WITH {_BIN} SELECT bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share, min(score) AS low, max(score) AS high FROM b GROUP BY 1")
def dataset_stats(spark, sf):
    d = _bins(spark, sf).groupBy("bin").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    return d.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))  # a window over bins


@query("sample_per_bin", f"WITH {_BIN}, r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(concat('2:', CAST(p_partkey AS VARCHAR))), p_partkey) AS k FROM b) SELECT bin, p_partkey FROM r WHERE k <= 5")
def sample_per_bin(spark, sf):
    from tesserae.functions.keys import order_key

    return _bins(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("bin").orderBy(order_key(2, "p_partkey"), "p_partkey"))).where("k <= 5").select("bin", "p_partkey")


@query("group_stats_joined", "SELECT l_orderkey, l_partkey, l_quantity, round(avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS mean, round(stddev_samp(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS std FROM lineitem")
def group_stats_joined(spark, sf):
    w = Window.partitionBy("l_orderkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.round(F.avg("l_quantity").over(w), 6).alias("mean"), F.round(F.stddev_samp("l_quantity").over(w), 6).alias("std"))


@query("best_and_worst", "SELECT p_brand, min_by(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS worst, max_by(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS best FROM part GROUP BY 1")
def best_and_worst(spark, sf):
    key = F.struct("p_retailprice", "p_partkey")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_partkey", key).alias("worst"), F.max_by("p_partkey", key).alias("best"))


@query("top_and_bottom", "(SELECT 'top' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20)")
def top_and_bottom(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    side = lambda name, key: o.orderBy(key, "o_orderkey").limit(20).withColumn("side", F.lit(name))
    return side("top", F.desc("o_totalprice")).unionByName(side("bottom", F.asc("o_totalprice")))


@query("left_join_stats", "SELECT o_orderkey, count(l_orderkey) AS lines, round(coalesce(sum(l_quantity), 0), 4) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def left_join_stats(spark, sf):
    per = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    return table(spark, sf, "orders").select("o_orderkey").join(per, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.round(F.coalesce("quantity", F.lit(0.0)), 4).alias("quantity"))


@query("class_marginals", "WITH a AS (SELECT l_returnflag AS k, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_returnflag AS k, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT k, round(a.s, 6) AS truth, round(b.s, 6) AS found, round((b.s - a.s) / a.s, 6) AS difference FROM a JOIN b USING (k)")
def class_marginals(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).pivot("l_linestatus", ["F", "O"]).count()
    share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy(F.lit(0)))  # noqa: E731  a window over classes
    d = d.select("k", share("F").alias("t"), share("O").alias("f"))
    return d.select("k", F.round("t", 6).alias("truth"), F.round("f", 6).alias("found"), F.round((F.col("f") - F.col("t")) / F.col("t"), 6).alias("difference"))


@query("frequency_weighted_score", "SELECT p_type, round(sum(p_size * p_retailprice) / (sum(p_size) + 1e-3), 4) AS score FROM part GROUP BY 1 HAVING sum(p_size) > 0")
def frequency_weighted_score(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.sum("p_size").alias("f"), F.sum(F.col("p_size") * F.col("p_retailprice")).alias("v")).where("f > 0").select("p_type", F.round(F.col("v") / (F.col("f") + 1e-3), 4).alias("score"))


@query("metric_pivot", "SELECT p_brand, CAST(count(*) FILTER (WHERE p_type = 'ECONOMY') AS BIGINT) AS economy, CAST(count(*) FILTER (WHERE p_type = 'PROMO') AS BIGINT) AS promo FROM part GROUP BY 1")
def metric_pivot(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").pivot("p_type", ["ECONOMY", "PROMO"]).count().na.fill(0)
    return p.select("p_brand", F.col("ECONOMY").alias("economy"), F.col("PROMO").alias("promo"))


@query("best_checkpoint", "SELECT user_id, event_id AS step, value AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def best_checkpoint(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct(F.col("event_id").alias("step"), F.col("value").alias("f1")), F.struct("value", -F.col("event_id"))).alias("b"))
    return e.select("user_id", "b.step", "b.f1")


@query("integral_score", f"WITH {_BIN} SELECT bin, round(2 * avg(area) * (1 - avg(score) / 3000) / (avg(area) + 1 - avg(score) / 3000 + 1e-3), 6) AS score FROM b GROUP BY 1")
def integral_score(spark, sf):
    a, b = F.avg("area"), 1 - F.avg("score") / 3000
    return _bins(spark, sf).groupBy("bin").agg(F.round(2 * a * b / (a + b + 1e-3), 6).alias("score"))
