"""Splits, names and duplicates. ``documents`` stands for labelled images (label: source), ``pages.url`` for file names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions.keys import order_key
from tesserae.operators import dedup as D
from tesserae.operators import naming as N
from tesserae.operators import split as S
from tesserae.operators.numbering import numbered_rows
from tesserae.plans.registry import query, table


@query("class_counts", "SELECT source AS label, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def class_counts(spark, sf):
    return S.class_counts(table(spark, sf, "documents").withColumn("label", F.col("source")))


@query("problem_type", "SELECT count(DISTINCT label) AS classes, CASE WHEN count(DISTINCT label) = 2 THEN 'binary' WHEN count(DISTINCT label) < 2 THEN 'error' ELSE 'multiclass' END AS kind FROM embeddings")
def problem_type(spark, sf):
    n = F.count_distinct("label")
    return table(spark, sf, "embeddings").agg(n.alias("classes"), F.when(n == 2, "binary").when(n < 2, "error").otherwise("multiclass").alias("kind"))


@query(
    "split_count_rows",
    """
WITH counts AS (SELECT source AS label, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
running AS (SELECT label, sum(n) OVER (ORDER BY md5(concat('3:', label)), label ROWS UNBOUNDED PRECEDING) - n AS before FROM counts),
away AS (SELECT label FROM running WHERE before < 100),
known AS (SELECT doc_id, source AS label, row_number() OVER (ORDER BY source, md5(concat('3:', CAST(doc_id AS VARCHAR))), doc_id) AS rn FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT label FROM away)),
left1 AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY rn) AS k FROM known WHERE rn > 80),
left2 AS (SELECT *, row_number() OVER (ORDER BY rn) AS v FROM left1 WHERE n >= 10 AND k <= 40)
SELECT doc_id, source AS label, 'test.unknown' AS split FROM documents WHERE source IN (SELECT label FROM away)
UNION ALL SELECT doc_id, label, 'test.known' FROM known WHERE rn <= 80
UNION ALL SELECT doc_id, label, CASE WHEN v <= 60 THEN 'val' ELSE 'train' END FROM left2
""",
)
def split_count_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("label"))
    return S.count_split(docs, "doc_id", "label", unknown=100, test=80, least=10, most=40, val=60, seed=3)


@query("known_label_rows", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 40)")
def known_label_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return d.join(d.groupBy("source").agg(F.count("*").alias("n")).where("n >= 40"), "source", "left_semi").select("doc_id", "source")


@query("unlabelled_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("class_cap", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('5:', CAST(doc_id AS VARCHAR))), doc_id) AS rn FROM documents) WHERE rn <= 12")
def class_cap(spark, sf):
    w = Window.partitionBy("source").orderBy(order_key(5, "doc_id"), "doc_id")
    return table(spark, sf, "documents").select("doc_id", "source").withColumn("rn", F.row_number().over(w)).where("rn <= 12").drop("rn")


@query("shuffled_head", "SELECT doc_id, lang FROM documents ORDER BY md5(concat('11:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 50")
def shuffled_head(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").orderBy(order_key(11, "doc_id"), "doc_id").limit(50)


@query("label_index", "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS label_index FROM documents")
def label_index(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    classes = d.select("source").distinct().withColumn("label_index", (F.row_number().over(Window.orderBy("source")) - 1).cast("long"))  # a window over classes, not rows
    return d.join(classes, "source").select("doc_id", "label_index")


@query("image_path", "SELECT doc_id, concat('images/', source, '/', CAST(doc_id AS VARCHAR), '.png') AS path FROM documents")
def image_path(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("/", F.lit("images"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".png"))).alias("path"))


_CLEAN = "coalesce(nullif(regexp_replace(regexp_replace(nfc_normalize({0}), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'untitled')"


@query("clean_filename", f"SELECT page_id, {_CLEAN.format('url')} AS name FROM pages")
def clean_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.clean_filename(F.col("url")).alias("name"))


#: Names of parts; of some the name has a number at its end already, which repeats of the plain name would take.
_NAMES = f"""n AS (SELECT p_partkey, {_CLEAN.format("p_name")} || CASE WHEN p_partkey % 11 = 0 THEN '_' || CAST(1 + p_partkey % 7 AS VARCHAR) WHEN p_partkey % 97 = 0 THEN '_2_1' ELSE '' END AS name FROM part),
s AS (SELECT *, regexp_replace(lower(name), '(_[0-9]+)+$', '') AS stem FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS k FROM s)"""


@query(
    "unique_names",
    f"""WITH RECURSIVE {_NAMES},
f AS (SELECT stem, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS p_partkey, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS unique_name FROM o GROUP BY 1
  UNION ALL SELECT f.stem, o.k, list_append(used, lower(t)), o.p_partkey, o.name, t FROM f JOIN o ON o.stem = f.stem AND o.k = f.k + 1,
    LATERAL (SELECT list_filter(list_concat([o.name], list_transform(range(1, len(f.used) + 2), lambda i: o.name || '_' || CAST(i AS VARCHAR))), lambda x: NOT list_contains(f.used, lower(x)))[1] AS t))
SELECT p_partkey, name, unique_name FROM f WHERE k > 0""",
)
def unique_names(spark, sf):
    number = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("_"), (1 + F.col("p_partkey") % 7).cast("string"))).when(F.col("p_partkey") % 97 == 0, "_2_1").otherwise("")
    return N.unique_names(table(spark, sf, "part").select("p_partkey", F.concat(N.clean_filename(F.col("p_name")), number).alias("name")), "name", ["p_partkey"])


@query(
    "numbered_outputs",
    "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) "
    "SELECT event_id, CASE WHEN n = 1 THEN concat('video', user_id) ELSE concat('video', user_id, '_', CASE WHEN k < 10 THEN concat('0', k) ELSE CAST(k AS VARCHAR) END) END AS name FROM r",
)
def numbered_outputs(spark, sf):
    w = Window.partitionBy("user_id")
    d = table(spark, sf, "events").withColumn("k", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(w))
    return d.select("event_id", N.numbered(F.concat(F.lit("video"), F.col("user_id").cast("string")), F.col("k"), F.col("n") == 1).alias("name"))


@query("augment_plan", "SELECT p_partkey, k AS copy, 42 + (row_number() OVER (ORDER BY p_partkey, k) - 1) AS seed, concat(p_name, '_aug', CASE WHEN k < 10 THEN concat('0', k) ELSE CAST(k AS VARCHAR) END) AS name FROM part, unnest(generate_series(1, 12)) AS t(k)")
def augment_plan(spark, sf):
    ranked = numbered_rows(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"], "i").withColumn("i", F.col("i") - 1)
    copies = ranked.select("p_partkey", "p_name", "i", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("copy"))
    return copies.select("p_partkey", F.col("copy").cast("long").alias("copy"), (42 + F.col("i") * 12 + F.col("copy") - 1).cast("long").alias("seed"), F.concat(F.col("p_name"), F.lit("_aug"), N.padded(F.col("copy"), 2)).alias("name"))


@query("ansi_strip", "SELECT event_id, concat('[', event_type, '] ', props) AS line FROM events")
def ansi_strip(spark, sf):
    coloured = F.concat(F.lit("\x1b[1;31m["), "event_type", F.lit("]\x1b[0m "), "props")
    return table(spark, sf, "events").select("event_id", N.without_ansi(coloured).alias("line"))


@query("exact_dedup", "SELECT doc_id, h FROM (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup(spark, sf):
    return D.first_of(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h")), ["h"], ["doc_id"])


@query("dedup_against_existing", "WITH old AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 10 = 0) SELECT doc_id FROM (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 10 <> 0) WHERE rn = 1 AND h NOT IN (SELECT h FROM old)")
def dedup_against_existing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return D.first_of(d.where("doc_id % 10 <> 0").join(d.where("doc_id % 10 = 0"), "h", "left_anti"), ["h"], ["doc_id"]).select("doc_id")


@query("drop_duplicate_keys", "SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def drop_duplicate_keys(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("p_partkey"))


@query("merged_shards", "SELECT doc_id, min(shard) AS shard FROM (SELECT doc_id, 0 AS shard FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 3 > 0) GROUP BY 1")
def merged_shards(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    both = d.where("doc_id % 3 < 2").withColumn("shard", F.lit(0)).unionByName(d.where("doc_id % 3 > 0").withColumn("shard", F.lit(1)))
    return both.groupBy("doc_id").agg(F.min("shard").alias("shard"))


@query("dedup_groups_across_shards", "WITH s AS (SELECT l_orderkey, l_returnflag, l_partkey, l_suppkey % 4 AS shard FROM lineitem), m AS (SELECT l_orderkey, l_returnflag, min(shard) AS shard FROM s GROUP BY 1, 2) SELECT l_orderkey, l_returnflag, m.shard, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM s JOIN m USING (l_orderkey, l_returnflag, shard) GROUP BY 1, 2, 3")
def dedup_groups_across_shards(spark, sf):
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey", (F.col("l_suppkey") % 4).alias("shard"))
    first = s.withColumn("least", F.min("shard").over(Window.partitionBy("l_orderkey", "l_returnflag"))).where("shard = least")
    return first.groupBy("l_orderkey", "l_returnflag", "shard").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def _hashes(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode_outer(F.filter(F.array_distinct(F.split(F.lower("text"), " ")), lambda w: w != "")).alias("w"))
    return D.bit_votes(words, "doc_id", "w")


_HASHES = """
words AS (SELECT DISTINCT doc_id, w FROM documents, unnest(string_split(lower(text), ' ')) AS t(w) WHERE w <> ''),
hashed AS (SELECT doc_id, CAST(concat('0x', substr(md5(w), 1, 15)) AS BIGINT) AS h FROM words),
votes AS (SELECT doc_id, k, sum(((h >> k) & 1) * 2 - 1) AS v FROM hashed, unnest(generate_series(0, 59)) AS t(k) GROUP BY 1, 2),
prints AS (SELECT doc_id, CAST(coalesce(sum(CASE WHEN v > 0 THEN CAST(1 AS BIGINT) << k ELSE 0 END), 0) AS BIGINT) AS hash FROM documents LEFT JOIN votes USING (doc_id) GROUP BY 1)
"""


@query("perceptual_hash", f"WITH {_HASHES} SELECT doc_id, hash FROM prints")
def perceptual_hash(spark, sf):
    return _hashes(spark, sf)


@query("hamming_pairs", f"WITH {_HASHES} SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM prints a JOIN prints b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.hash, b.hash)) <= 5")
def hamming_pairs(spark, sf):
    return D.hamming_pairs(_hashes(spark, sf), "doc_id", "hash", 5, bits=60)
