"""Text of agent calls as batch columns: skill budget, prompt, answer check, action lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemill.functions.text import strip

FENCE = "```"


def packed_skills(hits: DataFrame, keys: list[str], max_chars: int = 2400, order: str = "rank") -> DataFrame:
    """Retrieved skills as one text per key within a character budget.

    The last block is cut; separators do not count. A key has at most its
    retrieval's few rows, so the running sum is short.
    """
    body = F.coalesce(F.nullif("content", F.lit("")), F.col("embedding_text"), F.lit(""))
    block = F.concat_ws("\n", F.concat(F.lit("Skill: "), "name"), F.concat(F.lit("Granularity: "), "granularity"), body)
    window = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.sum(F.length("_b")).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.row_number().over(window) == 1
    fitted = (
        hits.withColumn("_b", block).withColumn("_left", F.lit(max_chars) - before).withColumn("_first", first)
        .filter((F.col("_left") > 0) | F.col("_first"))
        .withColumn("_b", F.substring("_b", F.lit(1), F.greatest(F.col("_left"), F.lit(0)).cast("int")))
    )
    return fitted.groupBy(*keys).agg(
        F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct(order, "_b"))), lambda x: x["_b"])).alias("skills_text")
    )


def user_prompt(goal: Column, observation: Column, skills_text: Column, actions: Column) -> Column:
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Goal:\n"), goal),
        F.concat(F.lit("Observation:\n"), F.substring(observation, 1, 4000)),
        F.concat(F.lit("Relevant skills:\n"), F.coalesce(skills_text, F.lit("None."))),
        F.concat(F.lit("Admissible actions:\n"), F.concat_ws("\n", F.transform(actions, lambda a: F.concat(F.lit("- "), a)))),
    )


def chosen_action(answer: Column, actions: Column) -> Column:
    """The ``action`` of a JSON answer (code fence allowed) if admissible, else null."""
    text = strip(answer)
    bare = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    cleaned = F.when(text.startswith(FENCE), bare).otherwise(text)
    valid = F.try_parse_json(cleaned).isNotNull()
    action = F.when(valid, F.coalesce(F.get_json_object(cleaned, "$.action"), F.lit(""))).otherwise("")
    return F.when(F.array_contains(actions, action), action)


def search_query(instruction: Column) -> Column:
    text = F.replace(F.lower(instruction), F.lit("[sep]"), F.lit(" "))
    return strip(F.replace(text, F.lit("find me"), F.lit("")))


def admissible_actions(has_search: Column, instruction: Column, clickables: Column) -> Column:
    search = F.when(has_search, F.array(F.concat(F.lit("search["), search_query(instruction), F.lit("]"))))
    clicks = F.transform(clickables, lambda c: F.concat(F.lit("click["), c, F.lit("]")))
    return F.concat(F.coalesce(search, F.array().cast("array<string>")), clicks)
