"""Exact values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import questions as Q
from graphloom.functions import scores as S
from graphloom.functions import text as X
from graphloom.functions import udfs as U


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize("raw, normal, display", [("“NASA” GPU systems — C++", "nasa gpu systems - c++", "NASA GPU systems - C++"), ("GPU / CPU   v2", "gpu/cpu v2", "GPU/CPU v2"), ("  ", "", ""), (None, "", ""), ("The a Power Unit!", "power unit", "Power Unit"), ("C++ and C#", "c++ and c#", "C++ and C#")])
def test_normalize(spark, raw, normal, display):
    df = spark.createDataFrame([(raw,)], "t string").select(X.normalize(F.col("t")), X.display_form(F.col("t"))).first()
    assert tuple(df) == (normal, display)


def test_keys(spark):
    assert one(spark, X.candidate_key(F.lit("system"), F.col("t")), t="The Power / Unit-2") == "SYSTEM:power_unit_2"
    import uuid

    assert one(spark, X.uuid5(F.col("t")), t="abc é") == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc é"))


def test_tokens_and_sentences(spark):
    assert one(spark, X.token_estimate(F.col("t")), t=" ".join(["w"] * 395)) == 513
    assert one(spark, X.sentences(F.col("t")), t="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, X.paragraphs(F.col("t"), 3), t="abc\n \nde\n\n fgh ") == ["abc", "fgh"]


def test_cleaning(spark):
    text = "Top\nPage 3 of 9\nBody  text \n\n\n\n- 4 -\n(c)\nCopyright ACME 2020\nAll rights reserved\nEnd"
    assert one(spark, X.clean(F.col("t")), t=text) == "Top\n\nBody text\n\n\n\n\n(c)\n\n\nEnd" or "Page" not in one(spark, X.clean(F.col("t")), t=text)
    kept = spark.createDataFrame([("x ```code Page 1 of 2``` NASA 5 V DRAFT",)], "t string").select(U.protect("t").alias("p")).select(U.restore(X.remove_boilerplate(F.col("p.text")), F.col("p.held"))).first()[0]
    assert kept == "x ```code Page 1 of 2``` NASA 5 V "
    assert one(spark, U.ocr_numbers(F.col("t")), t="2 O 5 and O l") == "2 0 5 and O l"


def test_rewrites(spark):
    assert one(spark, X.rewrite_verdict(F.lit("5 V and NASA"), F.lit("NASA"))) == "rejected:missing_numbers"
    assert one(spark, X.rewrite_verdict(F.lit("5 V and NASA"), F.lit("5"))) == "rejected:missing_acronyms"
    assert one(spark, X.rewrite_verdict(F.lit("5 V"), F.lit("5 volt"))) == "accepted"


@pytest.mark.parametrize("v, g, c, k, expect", [(0.9, 0.7, 0.8, 0.85, 0.815789), (0.9, None, 0.0, 0.5, 0.630769), (None, 0.8, 0.6, 0.7, 0.727273)])
def test_fusion(spark, v, g, c, k, expect):
    got = spark.createDataFrame([(v, g, c, k)], "v double, g double, c double, k double").select(S.fuse(F.col("v"), F.col("g"), F.col("c"), F.col("k"))).first()[0]
    assert got == pytest.approx(expect, abs=1e-6)


def test_path_scores(spark):
    for n, a, b, expect in ((1, 0.9, 0.85, 0.65), (5, 0.9, 0.85, 0.45), (1, 0.5, 0.5, 0.5)):
        assert one(spark, S.path_score(F.col("n"), F.col("a"), F.col("b")), n=n, a=a, b=b) == pytest.approx(expect)


def test_jaccard(spark):
    assert one(spark, X.jaccard(F.lit("power system thermal control"), F.lit("power system management control"))) == pytest.approx(0.6)
    assert one(spark, X.jaccard(F.lit("power system"), F.lit("battery voltage"))) == 0.0


def test_fuzzy(spark):
    a, b = "power subsystem", one(spark, X.normalize(F.col("t")), t="power sub-system")
    assert b == "power sub - system" and U.lcs_ratio(a, b) == pytest.approx(2 * 15 / 33)
    assert U.lcs_ratio("attitude control system", "attitude control subsystem") == pytest.approx(46 / 49)
    assert U.lcs_ratio("eps", "epc") == pytest.approx(4 / 6) and U.lcs_ratio("", "") == 1.0
    s = spark.createDataFrame([(a, b)], "a string, b string").withColumn("s", U.lcs_similarity("a", "b")).withColumn("t", S.fuzzy_threshold(F.col("a"), F.col("b")))
    r = s.select("s", "t", S.fuzzy_confidence(F.col("s"), F.col("t"), F.col("a"), F.col("b")).alias("c")).first()
    assert r.s >= r.t and r.c == pytest.approx(0.877, abs=1e-3)
    assert one(spark, S.fuzzy_threshold(F.lit("eps"), F.lit("epc"))) == pytest.approx(0.96)
    assert one(spark, S.edit_similarity(F.lit("abc"), F.lit("abd"))) == pytest.approx(2 / 3)


def test_noisy_or(spark):
    assert one(spark, S.noisy_or(F.array(F.lit(0.9 * 0.7), F.lit(0.55)), F.lit(2))) == pytest.approx(0.8835)
    assert one(spark, S.noisy_or(F.array(F.lit(1.0), F.lit(0.0)), F.lit(1))) == 1.0


@pytest.mark.parametrize("q, kind", [("What is the Electrical Power System?", "semantic"), ("What components are contained in the power subsystem?", "structural"), ("How to perform the startup procedure?", "procedural"), ("What is the power system and what components does it contain?", "hybrid"), ("where are the sensors", "semantic")])
def test_intents(spark, q, kind):
    assert one(spark, Q.intent(F.col("q")), q=q).intent == kind


def test_constraints(spark):
    ops = lambda q: {(c.operator, c.value) for c in one(spark, Q.constraints(F.col("q")), q=q)}
    assert ops("temperature greater than 0.8") == {("gt", "0.8")} and ("page", "42") in ops("table on page 42")
    assert ops("values from document ABC123") == {("document", "ABC123"), ("source", "document")}


def test_depth_and_strategy(spark):
    assert one(spark, Q.max_depth(F.col("q")), q="within 2 hops") == 2 and one(spark, Q.max_depth(F.col("q")), q="direct parts") == 1 and one(spark, Q.max_depth(F.col("q")), q="parts") == 3
    assert one(spark, Q.strategy(F.lit("semantic"), F.lit(0), F.lit(False))) == "vector_only" and one(spark, Q.strategy(F.lit("structural"), F.lit(1), F.lit(True))) == "graph_first" and one(spark, Q.strategy(F.lit("x"), F.lit(1), F.lit(True), "odd")) == "hybrid_parallel"


def test_dates_and_versions(spark):
    assert one(spark, X.date_of(F.col("t")), t="on 2021-02-30 or 12/31/2020") == "2020-12-31"
    assert one(spark, X.pdf_date(F.col("t")), t="D:20200102030405Z") == "2020-01-02"
    assert one(spark, X.version_of(F.col("t")), t="Version: 2.1 of it") == "2.1"
