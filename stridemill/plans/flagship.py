"""The smallest full slice: steps, segments, low-level patterns, utility, top three per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridemill.operators import scoring, tower, traces
from stridemill.plans import fixtures as fx
from stridemill.plans.registry import query, r6, rounded
from stridemill.plans.oracle import pue_sql


@query("B4 B5 C4 E6 E1 E2 I7 F2", f"""SELECT task_id, rank, skill_id, {r6('score')} FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, pos) AS rank
 FROM (SELECT *, {pue_sql('0')} AS score FROM lib WHERE granularity = 'low')), tasks WHERE rank <= 3""")
def best_patterns(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.segments(spark, sf)
    skills, _ = tower.low_skills(segs)
    found = scoring.retrieve(traces.online_task_texts(segs), skills, "pue_no_similarity")
    return rounded(found.select("task_id", "rank", "skill_id", "score"))
