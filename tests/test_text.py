from pyspark.sql import functions as F

from stridemill.functions import text as tx
from stridemill.operators import prompts
from stridemill.operators.embedding import hashing_embedder


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_action_template(spark):
    cases = {
        "search[red shoe]": "search_query", "click[B0ABCDEF12]": "click_product", "click[Features]": "inspect_product",
        "click[Buy Now": "purchase", "click[< Prev]": "navigate_page", "click[xx-large]": "select_option",
        "click[]": "click_option", "go to shelf": "navigate", "  TAKE cup ": "take", "": "unknown_action",
        " \t\n": "unknown_action", "dance wildly": "dance",
    }
    assert column(spark, cases, tx.action_template) == list(cases.values())


def test_event_label_is_case_sensitive(spark):
    cases = {"search[x]": "QueryFormulation", "Search[x]": "Search", "click[buy now]": "PurchaseDecision", "cool pan": "TransformObject",
             "open door [now]": "open door ", "": ""}
    assert column(spark, cases, tx.event_label) == list(cases.values())


def test_tokens_and_float_text(spark):
    assert column(spark, ["Go-To b0X 12!"], tx.tokenize) == [["go", "to", "b0x", "12"]]
    values = ["0.0", "0.00012", "0.0001", "0.00001", "0.25", "1.0"]
    assert column(spark, values, lambda c: tx.float_text(c.cast("double"))) == ["0.0", "0.00012", "0.0001", "1e-05", "0.25", "1.0"]


def test_answers(spark):
    acts = F.array(F.lit("look"), F.lit("go"))
    answers = ['{"action": "look"}', '```json\n{"action": "go"}\n```', "look", '{"action": "fly"}', "{}"]
    assert column(spark, answers, lambda c: prompts.chosen_action(c, acts)) == ["look", "go", None, None, None]


def test_goal(spark):
    seen = column(spark, ["x Instruction: [SEP] buy a cup [SEP] y"], lambda c: tx.goal_from_observation(F.lit("webshop"), c))
    assert seen == ["buy a cup"]
    assert column(spark, ["Instruction:"], lambda c: tx.goal_from_observation(F.lit("webshop"), c)) == [""]
    assert column(spark, [" room \nmore"], lambda c: tx.goal_from_observation(F.lit("alfworld"), c)) == ["room"]


def test_hashed_vectors_count_tokens(spark):
    rows = hashing_embedder(spark.createDataFrame([("a b a",), ("",)], "text string"), 16).collect()
    assert {r["text"]: (sum(r["vector"]), r["tokens"]) for r in rows} == {"a b a": (3.0, 3), "": (0.0, 0)}
