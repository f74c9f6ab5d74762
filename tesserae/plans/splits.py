"""Splits over ``documents`` as a labelled image table: image is doc_id, label is source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import split as S
from tesserae.plans.registry import query, table

_RATIO = """
WITH counts AS (SELECT source AS label, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
running AS (SELECT label, n, sum(n) OVER (ORDER BY md5(concat('7:', label)), label ROWS UNBOUNDED PRECEDING) - n AS before FROM counts),
away AS (SELECT label FROM running WHERE before < (SELECT floor(sum(n) * 0.15) FROM counts)),
ranked AS (
  SELECT d.doc_id, d.source AS label, a.label IS NOT NULL AS is_unknown,
    row_number() OVER (PARTITION BY d.source ORDER BY md5(concat('7:', CAST(d.doc_id AS VARCHAR))), d.doc_id) AS rn,
    count(*) OVER (PARTITION BY d.source) AS n
  FROM documents d LEFT JOIN away a ON a.label = d.source WHERE d.source IS NOT NULL),
quota AS (SELECT *, round_even(n * 0.2, 0) AS n_test FROM ranked),
quota2 AS (SELECT *, round_even((n - n_test) * 0.1, 0) AS n_val FROM quota),
labelled AS (SELECT doc_id, label, CASE WHEN is_unknown THEN 'test.unknown' WHEN rn <= n_test THEN 'test.known' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM quota2)
"""


def _split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    return S.ratio_split(docs, "doc_id", "label", unknown=0.15, test=0.2, val=0.1, seed=7)


@query("split_ratio_counts", _RATIO + "SELECT split, label, count(*) AS n FROM labelled GROUP BY 1, 2")
def split_ratio_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n"))


@query("split_ratio_rows", _RATIO + "SELECT doc_id, label, split FROM labelled")
def split_ratio_rows(spark, sf_dir):
    return _split(spark, sf_dir)
