"""Queries on steps, segments and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.functions import numeric as nm
from stridemill.functions import text as tx
from stridemill.operators import embedding, evaluate, external, prompts, scoring, traces
from stridemill.plans import fixtures as fx
from stridemill.plans.oracle import LABEL, TOKENS, template_sql
from stridemill.plans.registry import query, r6, rounded

COUNTER = "string_agg(value || ' (' || c || ')', ', ' ORDER BY rn)"


@query("B2 B8", f"SELECT task_id, env, goal, {r6('final_reward')}, success, n_steps FROM tasks")
def task_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    heads = traces.trajectories(fx.steps(spark, sf))
    return rounded(heads.select("task_id", "env", "goal", "final_reward", "success", "n_steps"))


@query("B3", """
WITH stops AS (SELECT task_id, min(t) AS stop FROM steps WHERE event_type = 'purchase' AND t <= 3 GROUP BY task_id)
SELECT s.task_id, s.t, s.action FROM steps s LEFT JOIN stops USING (task_id) WHERE s.t <= 3 AND (stop IS NULL OR s.t <= stop)""")
def episode_cut(spark: SparkSession, sf: str) -> DataFrame:
    marked = fx.steps(spark, sf).withColumn("done", F.col("action") == "click[buy now]")
    return traces.cut_episodes(marked, 3).select("task_id", "t", "action")


@query("B4 B5 B6 B7 C4 C5", f"""SELECT segment_id, trajectory_id, step_index, label, template, action, text, success, {r6('final_reward')},
  {r6('step_reward')} FROM segs""")
def segments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fx.segments(spark, sf).select(
        "segment_id", "trajectory_id", "step_index", "label", "template", "action", "text", "success", "final_reward",
        "step_reward"))


# fixed values: one action per rule and edge case
RULE_ACTIONS = [
    "take apple 1 from table", "put apple 1 in fridge", "go to shelf 2", "heat egg 1 with stove", "cool pan 1 with fridge",
    "clean cup 1 with sink", "  Open drawer 3", "CLOSE door", "examine mug", "look", "", "   ", "click[", "click[Buy Now]",
    "click[back to search]", "click[ B0ABCDEFGH ]", "search[", "Search[x]", "click[xx-large", "go",
]


def _rule_action(k, suffix):
    return F.concat(F.element_at(F.array(*map(F.lit, RULE_ACTIONS)), k % len(RULE_ACTIONS) + 1), suffix)


@query("B5 C4 C5", "WITH a AS (SELECT pos, [" + ", ".join("'" + a + "'" for a in RULE_ACTIONS) + f"""][(pos % {len(RULE_ACTIONS)} + 1)::INT] || CASE WHEN k % 10 = 0 THEN ' ' || k ELSE '' END AS action FROM raw)
SELECT pos, {LABEL} AS label, {template_sql()} AS template FROM a""")
def action_rules(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.logged_steps(spark, sf)
    suffix = F.when(F.col("k") % 10 == 0, F.concat(F.lit(" "), F.col("k").cast("string"))).otherwise("")
    a = e.select("pos", _rule_action(F.col("pos").cast("int"), suffix).alias("action"))
    return a.select("pos", tx.event_label(F.col("action")).alias("label"), tx.action_template(F.col("action")).alias("template"))


@query("B9 D2", "SELECT segment_id AS source, next_segment_id AS target, 'next' AS relation, 1.0::DOUBLE AS weight FROM pairs")
def sequence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return traces.sequence_edges(fx.segments(spark, sf))


@query("B10", "SELECT task_id, t, env, goal, observation, coalesce(array_to_string(recent, '|'), '') AS recent FROM states")
def recent_context(spark: SparkSession, sf: str) -> DataFrame:
    states = traces.task_states(fx.steps(spark, sf))
    return states.select("task_id", "t", "env", "goal", "observation", F.concat_ws("|", "recent_actions").alias("recent"))


@query("B11", "SELECT task_id, t, text FROM statetext")
def state_texts(spark: SparkSession, sf: str) -> DataFrame:
    states = traces.task_states(fx.steps(spark, sf))
    return states.select("task_id", "t", traces.state_text(states).alias("text"))


@query("B11 B12", "SELECT task_id, a.text || chr(10) AS online_text, b.text AS offline_text FROM text5 a JOIN text8 b USING (task_id)")
def task_texts(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.segments(spark, sf)
    online = traces.online_task_texts(segs).withColumnRenamed("text", "online_text")
    return online.join(traces.task_texts(segs, 8).withColumnRenamed("text", "offline_text"), "task_id")


@query("B13", """SELECT skill_id, name || chr(10) || granularity || chr(10) || content AS text FROM heads WHERE granularity = 'low'""")
def skill_texts(spark: SparkSession, sf: str) -> DataFrame:
    from stridemill.operators import tower
    from stridemill.operators.skills import skill_text

    return tower.low_heads(fx.segments(spark, sf)).select("skill_id", skill_text().alias("text"))


@query("B14", """SELECT segment_id, 'Label: ' || label || chr(10) || 'Action template: ' || template || chr(10) || 'Action: ' || action || chr(10)
 || 'Goal: ' || goal || chr(10) || 'Env: ' || env || chr(10) || 'Observation: ' || text AS graph_signature,
 'Label: ' || label || chr(10) || 'Action: ' || action || chr(10) || 'Goal: ' || goal || chr(10) || 'Environment: ' || env || chr(10)
 || 'Observation and local outcome: ' || text AS embedding_signature FROM segs""")
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return fx.segments(spark, sf).select(
        "segment_id", traces.graph_signature().alias("graph_signature"), traces.embedding_signature().alias("embedding_signature"))


@query("B15", """SELECT trajectory_id, 0 AS message, 'user' AS role, goal AS content, NULL::VARCHAR AS tool, NULL::VARCHAR AS label FROM segs WHERE step_index = 1
UNION ALL SELECT trajectory_id, step_index * 2 - 1, 'assistant', action, 'trace.' || template, label FROM segs
UNION ALL SELECT trajectory_id, step_index * 2, 'tool', text, 'trace.' || template, NULL FROM segs""")
def tool_call_export(spark: SparkSession, sf: str) -> DataFrame:
    return external.tool_call_messages(fx.segments(spark, sf)).select("trajectory_id", "message", "role", "content", "tool", "label")


@query("B16", f"""SELECT s.trajectory_id, s.step_index AS position, 'agent' AS role, 'Action: ' || action AS content, text AS observation, {r6('step_reward', 'reward')},
  CASE WHEN success THEN 'resolved' ELSE 'unresolved' END AS outcome FROM segs s
UNION ALL SELECT trajectory_id, 0, 'user', goal, NULL, NULL, CASE WHEN success THEN 'resolved' ELSE 'unresolved' END FROM segs WHERE step_index = 1""")
def observation_export(spark: SparkSession, sf: str) -> DataFrame:
    from stridemill.scale import lookup_join

    segs = fx.segments(spark, sf)
    steps = external.observation_steps(segs).select("trajectory_id", "position", "role", "content", "observation", "reward")
    heads = external.conversation_heads(segs).select("trajectory_id", "outcome")
    return rounded(lookup_join(steps, heads, ["trajectory_id"]))


OPENING = """CASE conv_id % 3 WHEN 0 THEN 'WebShop [SEP] Instruction: [SEP] ' || text || ' [SEP] Search' WHEN 1 THEN '  ' || text || chr(10) || 'You see a table.' ELSE text || ' ' || text END"""


@query("B1", f"""WITH o AS (SELECT conv_id, ['webshop', 'alfworld', 'other'][(conv_id % 3 + 1)::INT] AS env, {OPENING} AS obs FROM conversations WHERE turn = 0)
SELECT conv_id, env, CASE env WHEN 'webshop' THEN coalesce(list_filter(list_transform(string_split(substr(obs, strpos(obs, 'Instruction:') + 12), '[SEP]'),
   lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND lower(x) <> 'instruction:')[1], '')
 WHEN 'alfworld' THEN regexp_replace(split_part(obs, chr(10), 1), '^\\s+|\\s+$', '', 'g') ELSE left(obs, 200) END AS goal FROM o""")
def opening_goals(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations").filter("turn = 0")
    kind = (F.col("conv_id") % 3).cast("int")
    env = F.element_at(F.array(F.lit("webshop"), F.lit("alfworld"), F.lit("other")), kind + 1)
    obs = (
        F.when(kind == 0, F.concat(F.lit("WebShop [SEP] Instruction: [SEP] "), "text", F.lit(" [SEP] Search")))
        .when(kind == 1, F.concat(F.lit("  "), "text", F.lit("\nYou see a table.")))
        .otherwise(F.concat_ws(" ", "text", "text"))
    )
    return c.select("conv_id", env.alias("env"), tx.goal_from_observation(env, obs).alias("goal"))


@query("B19", """WITH a AS (SELECT conv_id, turn, ['stop', regexp_extract(text, '^\\S+')] AS actions, CASE turn % 4
  WHEN 0 THEN '```json' || chr(10) || '{"action": ' || to_json(regexp_extract(text, '^\\S+')) || '}' || chr(10) || '```' WHEN 1 THEN '{"action": "stop"}' WHEN 2 THEN text ELSE '{"action": "fly"}' END AS kind_answer, text FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN actions[2] WHEN 1 THEN 'stop' ELSE NULL END AS chosen FROM a""")
def answer_check(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations")
    word = F.regexp_extract("text", r"^\S+", 0)
    kind = (F.col("turn") % 4).cast("int")
    quoted = F.to_json(F.struct(word.alias("action")))
    answer = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), quoted, F.lit("\n```")))
        .when(kind == 1, '{"action": "stop"}').when(kind == 2, F.col("text")).otherwise('{"action": "fly"}')
    )
    return c.select("conv_id", "turn", prompts.chosen_action(answer, F.array(F.lit("stop"), word)).alias("chosen"))


@query("B20 B18", """WITH u AS (SELECT conv_id, turn, text, turn % 2 = 0 AS bar, regexp_replace(replace(replace(lower('Find me [SEP] ' || text), '[sep]', ' '), 'find me', ''), '^\\s+|\\s+$', '', 'g') AS q FROM conversations),
a AS (SELECT *, list_concat(CASE WHEN bar THEN ['search[' || q || ']'] ELSE [] END, ['click[role]', 'click[' || left(text, 10) || ']']) AS acts FROM u)
SELECT conv_id, turn, array_to_string(acts, '|') AS actions, 'Goal:' || chr(10) || left(text, 30) || chr(10) || chr(10) || 'Observation:' || chr(10) || left(text, 4000)
 || chr(10) || chr(10) || 'Relevant skills:' || chr(10) || 'None.' || chr(10) || chr(10) || 'Admissible actions:' || chr(10) || array_to_string(list_transform(acts, lambda x: '- ' || x), chr(10)) AS prompt FROM a""")
def action_lists_and_prompts(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations")
    clicks = F.array(F.lit("role"), F.substring("text", 1, 10))
    actions = prompts.admissible_actions(F.col("turn") % 2 == 0, F.concat(F.lit("Find me [SEP] "), "text"), clicks)
    prompt = prompts.user_prompt(F.substring("text", 1, 30), F.col("text"), F.lit(None).cast("string"), actions)
    return c.select("conv_id", "turn", F.concat_ws("|", actions).alias("actions"), prompt.alias("prompt"))


@query("B17", """WITH h AS (SELECT doc_id % 200 AS bucket, doc_id, source AS name, lang AS granularity, text AS content,
   'Skill: ' || source || chr(10) || 'Granularity: ' || lang || chr(10) || text AS b FROM documents),
r AS (SELECT *, coalesce(sum(length(b)) OVER (PARTITION BY bucket ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS rn FROM h)
SELECT bucket, string_agg(substr(b, 1, greatest(2400 - before, 0)::BIGINT), chr(10) || chr(10) ORDER BY doc_id) AS skills_text FROM r WHERE before < 2400 OR rn = 1 GROUP BY bucket""")
def packed_skills(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select(
        (F.col("doc_id") % 200).alias("bucket"), "doc_id", F.col("source").alias("name"), F.col("lang").alias("granularity"),
        F.col("text").alias("content"), F.lit("").alias("embedding_text"))
    return prompts.packed_skills(d, ["bucket"], 2400, "doc_id")


@query("C1 C2", f"SELECT doc_id, {TOKENS.format('text')} AS tokens, coalesce(list_unique(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) AS distinct_tokens FROM documents")
def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = tx.tokenize(F.col("text"))
    return fx.table(spark, sf, "documents").select(
        "doc_id", tx.token_count(F.col("text")).alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("distinct_tokens"))


@query("C3", """WITH p AS (SELECT a.conv_id, a.turn, a.text AS l, b.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
tl AS (SELECT conv_id, turn, tok, count(*)::DOUBLE AS c FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(l), '[a-z0-9]+')) AS tok FROM p) GROUP BY ALL),
tr AS (SELECT conv_id, turn, tok, count(*)::DOUBLE AS c FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(r), '[a-z0-9]+')) AS tok FROM p) GROUP BY ALL),
nl AS (SELECT conv_id, turn, sqrt(sum(c * c)) AS n FROM tl GROUP BY ALL), nr AS (SELECT conv_id, turn, sqrt(sum(c * c)) AS n FROM tr GROUP BY ALL),
d AS (SELECT conv_id, turn, sum(tl.c * tr.c) AS dot FROM tl JOIN tr USING (conv_id, turn, tok) GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(dot / (nl.n * nr.n), 0), 6) + 0.0 AS cosine FROM p LEFT JOIN nl USING (conv_id, turn) LEFT JOIN nr USING (conv_id, turn) LEFT JOIN d USING (conv_id, turn)""")
def reply_cosine(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations")
    reply = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("l")).join(reply, ["conv_id", "turn"])
    return rounded(scoring.pair_cosine(pairs, ["conv_id", "turn"], "l", "r"))


@query("C6 C7 E3", f"""WITH c AS (SELECT goal AS key, action AS value, count(*) AS c, min(pos) AS f FROM segs GROUP BY ALL)
SELECT key, {COUNTER} AS counter FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, f) AS rn FROM c) WHERE rn <= 5 GROUP BY key""")
def goal_action_counters(spark: SparkSession, sf: str) -> DataFrame:
    from stridemill.operators.skills import top_counts

    keyed = fx.segments(spark, sf).withColumn("key", F.col("goal"))
    return top_counts(keyed, "action").select("key", tx.counter_text(F.col("action")).alias("counter"))


@query("C8 C9", f"""SELECT pos, {r6('sqrt(list_dot_product(v, v))', 'length')}, {r6('list_sum(list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)))', 'unit_sum')},
 {r6("list_dot_product(v, q) / greatest(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)), 1e-12)", 'cosine')} FROM gseg, (SELECT v AS q FROM gseg WHERE pos = 0)""")
def vector_rules(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.graph_segments(spark, sf)
    probe = segs.filter("pos = 0").select("vector").scalar()
    v = F.col("vector")
    return rounded(segs.withColumn("q", probe).select(
        "pos", nm.norm(v).alias("length"), F.aggregate(nm.unit(v), F.lit(0.0), lambda a, x: a + x).alias("unit_sum"),
        nm.cosine(v, F.col("q")).alias("cosine")))


@query("C10 C11 C12 C13 C14", """SELECT user_id, round(coalesce(avg(value), 0), 6) + 0.0 AS mean, round(coalesce(var_pop(value), 0), 6) + 0.0 AS variance,
 round(sum(value / (value + 100.0)), 6) + 0.0 AS cost, coalesce(avg(CASE WHEN event_type = 'none' THEN value END), 0) AS empty_mean,
 round(CASE WHEN sum(CASE WHEN event_type = 'view' THEN value END) > 0 THEN 1000.0 * 0.5 / sum(CASE WHEN event_type = 'view' THEN value END)
   WHEN sum(value) > 0 THEN 1000.0 * 0.5 / sum(value) ELSE 0 END, 6) + 0.0 AS per_1k FROM events GROUP BY user_id""")
def numeric_rules(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    e = fx.table(spark, sf, "events").groupBy("user_id").agg(
        nm.safe_mean(v).alias("mean"), nm.population_variance(v).alias("variance"),
        F.sum(nm.saturating_cost(v)).alias("cost"),
        nm.safe_mean(F.when(F.col("event_type") == "none", v)).alias("empty_mean"),
        nm.success_per_1k_tokens(F.lit(0.5), F.sum(F.when(F.col("event_type") == "view", v)), F.sum(v)).alias("per_1k"))
    return rounded(e)


@query("C15 C16 B22", """WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'run ' || page_id || '=' || url WHEN page_id % 3 = 1 THEN url ELSE 'm.' || page_id || '.json' END AS spec FROM pages)
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '[^a-zA-Z0-9_.-]+', '_', 'g'), ''), 'run') AS slug,
 CASE page_id % 3 WHEN 0 THEN split_part(spec, '=', 1) WHEN 1 THEN CASE WHEN contains(url, '=') THEN split_part(url, '=', 1) ELSE
   coalesce(nullif(string_split(url, '/')[-2], ''), regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1')) END ELSE 'm.' || page_id END AS label,
 CASE WHEN page_id % 2 = 0 THEN 'No Skill' ELSE 'Method ' || page_id END AS method FROM p""")
def run_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "pages").withColumn("id", F.col("page_id").cast("string"))
    kind = F.col("page_id") % 3
    spec = F.when(kind == 0, F.concat(F.lit("run "), "id", F.lit("="), "url")).when(kind == 1, F.col("url")).otherwise(
        F.concat(F.lit("m."), "id", F.lit(".json")))
    method = F.when(F.col("page_id") % 2 == 0, "no_skill").otherwise(F.concat(F.lit("method_"), "id"))
    return p.select("page_id", tx.run_slug(F.col("url")).alias("slug"), tx.model_label(spec).alias("label"), tx.method_label(method).alias("method"))


@query("J1 E27", f"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(tok), 1, 8))::BIGINT) % 64 AS dim, count(*) AS n FROM x GROUP BY ALL)
SELECT doc_id, dim, n::DOUBLE AS value FROM b""")
def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    d = embedding.embed(fx.table(spark, sf, "documents").select("doc_id", "text"), "text")
    long = d.select("doc_id", F.posexplode("vector").alias("dim", "value")).filter("value > 0")
    return long.select("doc_id", F.col("dim").cast("long").alias("dim"), "value")


@query("E27", f"SELECT count(*) AS texts, ceil(count(*) / 8)::BIGINT AS batches, sum({TOKENS.format('text')})::BIGINT AS total_tokens FROM documents")
def embedding_usage(spark: SparkSession, sf: str) -> DataFrame:
    d = embedding.embed(fx.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return embedding.embedding_usage(d).select("texts", "batches", "total_tokens")


@query("D13", """SELECT doc_id % 2 = 0 OR length(text) % 3 > 0 AS reused, count(*) AS n FROM documents GROUP BY ALL""")
def refreshed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("skill_id"), "doc_id", "text")
    stored = embedding.hashing_embedder(d.select("skill_id", "text"))
    changed = (F.col("doc_id") % 2 == 1) & (F.length("text") % 3 == 0)
    wanted = d.select("skill_id", F.when(changed, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")).alias("text"))
    return embedding.refresh_embeddings(stored, wanted).groupBy("reused").agg(F.count(F.lit(1)).alias("n"))


SUMMARY = f"""
WITH f AS (SELECT *, CASE WHEN pos % 7 < 3 THEN pos % 7 > 0 ELSE contains(lower(observation), 'invalid') END AS bad,
   coalesce(action = lag(action) OVER (PARTITION BY task_id ORDER BY t), false) AS lp,
   CASE pos % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 5 ELSE k END AS tok, CASE WHEN pos % 7 < 3 THEN 0 ELSE k % 9 END AS rtok FROM steps)
SELECT {{keys}}round(count(CASE WHEN t = 1 AND final_reward > 0 THEN 1 END) / count(DISTINCT task_id), 6) + 0.0 AS success_rate, count(DISTINCT task_id) AS episodes,
 round(count(*) / count(DISTINCT task_id), 6) + 0.0 AS avg_steps, round(sum(CASE WHEN t = 1 THEN final_reward END) / count(DISTINCT task_id), 6) + 0.0 AS avg_reward,
 round(count(CASE WHEN bad THEN 1 END) / count(*), 6) + 0.0 AS invalid_action_rate, round(count(CASE WHEN lp THEN 1 END) / count(*), 6) + 0.0 AS loop_rate,
 round(sum(tok) / count(DISTINCT task_id), 6) + 0.0 AS avg_token_cost, round(sum(rtok) / count(DISTINCT task_id), 6) + 0.0 AS avg_retrieval_embedding_token_cost,
 round(sum(tok + rtok) / count(DISTINCT task_id), 6) + 0.0 AS avg_total_token_cost FROM f{{group}}"""


def flagged_steps(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("pos") % 7
    info = (
        F.when(at == 0, '{"valid_action": true}').when(at == 1, '{"valid_action": null}')
        .when(at == 2, '{"valid_action": false, "agent": {"total_tokens": 5}}')
        .otherwise(F.concat(F.lit('{"agent": {"total_tokens": '), F.col("k").cast("string"),
                            F.lit('}, "retrieval": {"embedding_total_tokens": '), (F.col("k") % 9).cast("string"), F.lit("}}")))
    )
    return traces.number_steps(fx.logged_steps(spark, sf).withColumn("info", info), ["ts", "pos"])


@query("E15 E16 E17 E18 B24", SUMMARY.format(keys="", group=""))
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.run_summary(flagged_steps(spark, sf)))


@query("M6 E15 E16 E17 E18", SUMMARY.format(keys="run_id, ", group=" GROUP BY run_id"))
def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.run_summary(flagged_steps(spark, sf), ["run_id"]))


@query("A1 A4 B7", f"SELECT segment_id, trajectory_id, step_index, label, template, action, success, {r6('final_reward')} FROM segs")
def segments_from_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON-lines records and read back."""
    import uuid

    from stridemill.scale import checkpoint_dir
    from stridemill.sources import records

    folder = f"{checkpoint_dir(spark)}/segments-{uuid.uuid4().hex}"
    records.write_segments(fx.segments(spark, sf), folder)
    back = records.read_segments(spark, folder)
    return rounded(back.select("segment_id", "trajectory_id", "step_index", "label", "template", "action", "success", "final_reward"))


@query("A1 A3", f"""SELECT task_id, min(env) AS env, min(goal) AS goal, min(final_reward) > 0 AS success, {r6('min(final_reward)', 'final_reward')}, count(*) AS n_steps,
 string_agg(segment_id, ',' ORDER BY step_index) AS segment_ids FROM (SELECT *, trajectory_id AS task_id FROM segs) GROUP BY task_id""")
def run_records(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks with their steps and segments as nested JSON-lines records, read back as tables."""
    import uuid

    from stridemill.scale import checkpoint_dir
    from stridemill.sources import records

    folder = f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    steps = fx.steps(spark, sf)
    records.write_jsonl(traces.nested_records(steps, traces.segments(steps)), folder)
    tasks, segs = records.read_records(spark, folder)
    listed = segs.groupBy(F.col("trajectory_id").alias("task_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_index", "segment_id"))), lambda s: s["segment_id"]), ",").alias("segment_ids"))
    return rounded(tasks.join(listed, "task_id").select("task_id", "env", "goal", "success", "final_reward", "n_steps", "segment_ids"))


@query("A10", """SELECT 'all' AS run_id, task_id, t, action, reward FROM steps UNION ALL SELECT 'opening', task_id, t, action, reward FROM steps WHERE t = 1""")
def run_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs written into one table, the second beside the first, both read back."""
    import uuid

    from stridemill.scale import checkpoint_dir
    from stridemill.sources import records

    root = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    steps = fx.steps(spark, sf).select("task_id", "t", "action", "reward")
    records.write_run(spark, root, "all", {"steps": steps})
    records.write_run(spark, root, "opening", {"steps": records.read_run(spark, root, "steps", "all").drop("run_id").filter("t = 1")})
    back = records.read_run(spark, root, "steps")
    return rounded(back.select(F.col("run_id").cast("string").alias("run_id"), "task_id", "t", "action", "reward"))


@query("Z2 B10", "SELECT task_id, t, env, goal, observation, coalesce(array_to_string(recent, '|'), '') AS recent FROM states")
def streamed_context(spark: SparkSession, sf: str) -> DataFrame:
    """The step table replayed as a stream, state kept per task."""
    import uuid

    from stridemill.scale import checkpoint_dir
    from stridemill.streaming.context import stream_states

    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    steps = fx.steps(spark, sf).select("task_id", "t", "env", "goal", "action", "observation")
    steps.write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(steps.schema).parquet(f"{folder}/in")
    stream = stream_states(arriving, idle_ms=None).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    stream.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select("task_id", "t", "env", "goal", "observation", F.concat_ws("|", "recent_actions").alias("recent"))


