import pytest
from pyspark.sql import functions as F

from costdocs.operators import classify, decide

# Questions with the intent they should get.
GOLDEN = [
    ("이번달 SageMaker 비용", "sql"),
    ("Notebook 시간 합계", "sql"),
    ("월별 사용량 통계", "sql"),
    ("소비 추이 그래프", "sql"),
    ("Feature Store 비용 분석", "sql"),
    ("SageMaker Studio 설정 방법", "docs"),
    ("Serverless Inference 작동 방식", "docs"),
    ("Feature Store의 offline store 개념 설명", "docs"),
    ("API 레퍼런스 보여줘", "docs"),
    ("튜토리얼 가이드", "docs"),
    ("안녕하세요", "general"),
    ("도움말", "general"),
]
EDGE = [
    ("", "general"),
    ("   ", "general"),
    ("SageMaker 비용이 어떻게 계산되나요?", "docs"),
    ("Studio에서 비용을 어떻게 확인하나요?", "docs"),
    ("비용 데이터를 CSV로 내보내는 방법", "docs"),
]


def test_keyword_intents_meet_the_golden_set(spark):
    gold = spark.createDataFrame(GOLDEN + EDGE, "question string, label string")
    predicted = gold.select("question", classify.keyword_intent(F.col("question")).alias("label"))
    row = decide.accuracy(predicted, gold, "question").first()
    assert (row["total"], row["passed"]) == (17, True) and row["accuracy"] == 1.0


@pytest.mark.parametrize("right, passed", [(4, True), (3, False)])
def test_accuracy_floor(spark, right, passed):
    gold = spark.createDataFrame([(i, "a") for i in range(5)], "k int, label string")
    predicted = spark.createDataFrame([(i, "a" if i < right else "b") for i in range(4)] + [(4, None)], "k int, label string")
    row = decide.accuracy(predicted, gold, "k").first()
    assert (row["correct"], row["total"], row["passed"]) == (right, 5, passed)


@pytest.mark.parametrize(
    "question, label, confidence, intent, value",
    [
        ("q", "sql", "0.9", "sql", 0.9),
        ("q", "docs", None, "docs", 0.0),
        ("q", "docs", "high", "general", 0.3),
        ("q", "chat", "0.9", "general", 0.3),
        ("q", None, None, "general", 0.3),
        ("q", None, "0.7", "general", 0.7),
        (" \n", "sql", "0.9", "general", 0.5),
        (None, "sql", "0.9", "general", 0.5),
    ],
)
def test_intent_normalise(spark, question, label, confidence, intent, value):
    df = spark.createDataFrame([(question, label, confidence)], "question string, label string, confidence string")
    row = decide.normalise_intents(df).first()
    assert (row["intent"], row["intent_confidence"]) == (intent, value)
    assert row["intent_reason"] is not None


def test_routes(spark, tmp_path):
    df = spark.createDataFrame([(1, "sql"), (2, "sql"), (3, "docs")], "i int, intent string")
    decide.write_routes(df, str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r").glob("intent=*")} == {"intent=sql", "intent=docs"}
    assert {r["intent"]: r["n"] for r in decide.route_counts(df).collect()} == {"sql": 2, "docs": 1}


@pytest.mark.parametrize(
    "scores, answer, needed",
    [
        ((6.0, 4.0, 4.0, 4.0, 4.0), "long enough", False),
        ((5.9, 9.0, 9.0, 9.0, 9.0), "long enough", True),
        ((9.0, 9.0, 3.9, 9.0, 9.0), "long enough", True),
        ((9.0, 9.0, 9.0, 9.0, 9.0), "short", True),
        ((9.0, 9.0, None, 9.0, 9.0), "long enough", True),
        ((None,) * 5, "long enough", True),
    ],
)
def test_quality_gate(spark, scores, answer, needed):
    names = ", ".join(f"{s} double" for s in ("overall_score", *decide.SCORE_PARTS))
    df = spark.createDataFrame([(*scores, answer)], f"{names}, answer string")
    assert df.select(decide.needs_second_answer(8)).first()[0] is needed


def test_second_answer_must_be_strictly_better(spark):
    first = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "a", None), (4, "a", None)], "k int, answer string, score double")
    second = spark.createDataFrame([(1, "b", 5.0), (2, "b", 6.0), (3, "b", 1.0)], "k int, answer string, score double")
    out = {r["k"]: (r["answer"], r["chosen"]) for r in decide.best_of_two(first, second, "k").collect()}
    assert out == {1: ("a", "first"), 2: ("b", "second"), 3: ("b", "second"), 4: ("a", "first")}


def test_answers_are_cut_with_a_notice(spark):
    df = spark.createDataFrame([("x" * 2001,), ("x" * 2000,)], "a string")
    long, short = [r[0] for r in df.select(decide.cut_answer(F.col("a"))).collect()]
    assert long.startswith("x" * 2000 + "...\n\n(") and short == "x" * 2000
    assert df.select(decide.cut_reply(F.col("a"))).first()[0] == "x" * 1000 + " …"
