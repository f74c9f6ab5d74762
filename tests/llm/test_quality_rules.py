import re

from pyspark.sql import functions as F

from tests.llm import cases
from tesserae.llm.quality_rules import RULES, apply_rules, base_figures, order_rules


def figures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_figures_match_brute_force(spark):
    texts = [*cases.texts(), "a b c a b c a b", "x\nx\n y\nx\n\n\n", "#* <b> | |", "GOOD words " * 60, "- one\n- two\n" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in apply_rules(docs, ["doc_id"]).collect()}
    assert got == {k: figures(t) for k, t in enumerate(texts)}


def test_verdicts(spark):
    good = cases.words(90, 3, 4000)
    texts = [good, good.upper(), good.replace(" ", "** "), good.replace(" ", "!! "), "\n".join([good[:200]] * 3 + [good]), None, "short", " ".join(str(k) for k in range(100, 200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.base_failed, r.kept) for r in apply_rules(docs, ["doc_id"]).collect()}
    assert got[0] == (False, True)
    assert not any(got[k][1] for k in range(1, 8))
    assert got[1] == got[2] == got[3] == (False, False) and got[5] == got[6] == (True, False)


def test_the_order_of_rules_changes_nothing(spark):
    docs = cases.documents(spark)
    a = sorted(map(tuple, apply_rules(docs, ["doc_id"]).collect()))
    assert a == sorted(map(tuple, apply_rules(docs.repartition(5), ["doc_id"], rules=RULES[::-1], sample_rows=3).collect()))


def test_rules_are_ordered_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(k, "A B!! " * 60) for k in range(50)], "doc_id long, text string")
    found = order_rules(base_figures(docs, F.col("text"), ["doc_id"]))
    scores = [share / cost for _, share, cost in found]
    assert scores == sorted(scores, reverse=True) and len(found) == len(RULES)
    assert [r.name for r, share, _ in found if share] == ["word_length", "exclamations", "shouting"]


def test_the_order_is_the_same_in_every_run(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    figures = base_figures(docs, F.col("text"), ["doc_id"])
    assert len({tuple(r.name for r, _, _ in order_rules(figures)) for _ in range(5)}) == 1


def test_kept_columns_of_clashing_names(spark):
    got = apply_rules(cases.documents(spark).withColumn("kept", F.lit("x")), ["doc_id", "n_words", "kept", "row"])
    assert got.columns[:4] == ["doc_id", "doc_n_words", "doc_kept", "row"] and {r.doc_kept for r in got.collect()} == {"x"}


def test_empty(spark):
    assert apply_rules(cases.empty(spark), ["doc_id", "lang"]).count() == 0


def test_no_python_on_executors(spark):
    plan = apply_rules(cases.documents(spark), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
