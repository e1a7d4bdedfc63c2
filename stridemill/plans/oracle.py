"""Shared common-table expressions of the check queries, for DuckDB on the given tables."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["raw"] = """
SELECT event_id AS pos, ts, 'run_' || (user_id % 4) AS run_id,
  'u' || user_id || '_' || strftime(ts, '%Y-%m-%d') AS task_id, 'webshop' AS env, 'goal ' || (user_id % 20) AS goal,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, value FROM events"""

CTES["logged"] = """
SELECT *, CASE event_type WHEN 'signup' THEN 'search[plan ' || k || ']'
   WHEN 'view' THEN 'click[b0' || lpad(CAST(pos AS VARCHAR), 8, '0') || ']'
   WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'click[description]' WHEN 1 THEN 'click[large]' WHEN 2 THEN 'click[next >]' ELSE 'click[red]' END
   WHEN 'purchase' THEN 'click[buy now]' ELSE 'open page ' || (k % 5) END AS action,
  CASE WHEN event_type = 'error' THEN 'Invalid action' ELSE event_type END AS observation,
  CASE WHEN event_type = 'purchase' THEN least(1.0::DOUBLE, value / 500) ELSE 0.0::DOUBLE END AS reward FROM raw"""

CTES["steps"] = """
SELECT *, row_number() OVER w AS t, count(*) OVER (PARTITION BY task_id) AS n_steps,
  last_value(reward) OVER (PARTITION BY task_id ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_reward
FROM logged WINDOW w AS (PARTITION BY task_id ORDER BY ts, pos)"""

LABEL = """CASE WHEN starts_with(action, 'search[') THEN 'QueryFormulation' WHEN starts_with(action, 'click[buy') THEN 'PurchaseDecision'
 WHEN starts_with(action, 'click[') THEN 'CandidateInteraction' WHEN starts_with(action, 'take ') THEN 'AcquireObject'
 WHEN starts_with(action, 'put ') THEN 'PlaceObject' WHEN starts_with(action, 'go to ') THEN 'NavigateToTarget'
 WHEN starts_with(action, 'heat ') OR starts_with(action, 'cool ') OR starts_with(action, 'clean ') THEN 'TransformObject'
 ELSE split_part(action, '[', 1) END"""


def template_sql(action: str = "action") -> str:
    text = f"lower(regexp_replace({action}, '^\\s+|\\s+$', '', 'g'))"
    target = f"regexp_replace(regexp_replace(substr({text}, 7), '\\]$', ''), '^\\s+|\\s+$', '', 'g')"
    first = f"regexp_split_to_array({text}, '\\s+')[1]"
    options = ("'black','white','gray','grey','green','blue','red','orange','yellow','pink','purple','brown','small',"
               "'medium','large','x-large','xx-large','3x-large'")
    return f"""CASE WHEN starts_with({text}, 'search[') THEN 'search_query' WHEN starts_with({text}, 'click[') THEN
 CASE WHEN regexp_matches({target}, '^b0[a-z0-9]{{8}}$') THEN 'click_product' WHEN {target} IN ('description','features','reviews') THEN 'inspect_product'
 WHEN {target} IN ('buy now','buy') THEN 'purchase' WHEN {target} IN ('back to search','< prev','prev','next >','next','search') THEN 'navigate_page'
 WHEN {target} IN ({options}) THEN 'select_option' ELSE 'click_option' END
 WHEN {text} = '' THEN 'unknown_action' WHEN {first} = 'go' THEN 'navigate' ELSE {first} END"""


CTES["segs"] = f"""
SELECT task_id || '_seg_' || t AS segment_id, task_id AS trajectory_id, env, goal, t AS step_index, {LABEL} AS label,
  {template_sql()} AS template, action,
  'Env: ' || env || chr(10) || 'Goal: ' || goal || chr(10) || 'Action: ' || action || chr(10) || 'Observation: ' || left(observation, 500)
   || chr(10) || 'Outcome: success=' || CASE WHEN final_reward > 0 THEN 'True' ELSE 'False' END || ', reward=' || CAST(final_reward AS VARCHAR) AS text,
  final_reward > 0 AS success, final_reward, reward AS step_reward, pos, run_id FROM steps"""

CTES["tasks"] = """
SELECT task_id, min(env) AS env, min(goal) AS goal, min(final_reward) AS final_reward, min(final_reward) > 0 AS success,
  count(*) AS n_steps, min(ts) AS first_ts, min(pos) AS first_pos FROM steps GROUP BY task_id"""

CTES["clustered"] = """
SELECT *, CASE label WHEN 'QueryFormulation' THEN 0 WHEN 'CandidateInteraction' THEN 1 WHEN 'PurchaseDecision' THEN 2 ELSE 3 END AS cluster FROM segs"""

CTES["pairs"] = """
SELECT * FROM (SELECT *, lead(segment_id) OVER w AS next_segment_id, lead(label) OVER w AS next_label, lead(pos) OVER w AS next_pos,
  lead(cluster) OVER w AS next_cluster FROM clustered WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index)) WHERE next_segment_id IS NOT NULL"""

# library of the checks: low by template, mid by label cluster, high by pairs of clusters
CTES["lowids"] = "SELECT template, row_number() OVER (ORDER BY template) - 1 AS i FROM (SELECT DISTINCT template FROM segs)"
CTES["lowacts"] = """
SELECT template, string_agg('- ' || action, chr(10) ORDER BY rn) AS acts FROM (
  SELECT template, action, row_number() OVER (PARTITION BY template ORDER BY c DESC, f) AS rn FROM (
    SELECT template, action, count(*) AS c, min(pos) AS f FROM segs GROUP BY ALL)) WHERE rn <= 8 GROUP BY template"""
CTES["heads"] = """
SELECT printf('tower_low_%03d', i) AS skill_id, i AS pos, 'Low ' || template AS name, 'low' AS granularity,
  'Low-level action template: ' || template || chr(10) || 'Representative actions:' || chr(10) || acts AS content FROM lowids JOIN lowacts USING (template)
UNION ALL SELECT printf('tower_mid_%03d', c), (SELECT count(*) FROM lowids) + c, 'Mid Pattern ' || c, 'mid', 'Mid-level behavior pattern ' || c
  FROM (SELECT DISTINCT cluster AS c FROM clustered)
UNION ALL SELECT printf('tower_high_%03d', h), (SELECT count(*) FROM lowids) + (SELECT count(DISTINCT cluster) FROM clustered) + h,
  'High Skill Routine ' || h, 'high', 'High-level skill community ' || h FROM (SELECT DISTINCT cluster // 2 AS h FROM clustered)"""
CTES["members"] = """
SELECT printf('tower_low_%03d', i) AS skill_id, s.* FROM segs s JOIN lowids USING (template)
UNION ALL SELECT printf('tower_mid_%03d', cluster), * EXCLUDE (cluster) FROM clustered
UNION ALL SELECT printf('tower_high_%03d', cluster // 2), * EXCLUDE (cluster) FROM clustered"""


def stats_sql(members: str, key: str = "skill_id", total: str = "(SELECT count(*) FROM segs)") -> str:
    return f"""
SELECT {key}, count(*) AS support, count(*)::DOUBLE / {total} AS coverage, avg(success::INT) AS success_rate,
  1 - avg(success::INT) AS failure_rate, avg(final_reward) AS avg_reward, avg(step_reward) AS avg_step_reward,
  count(DISTINCT trajectory_id) AS trajectory_count, avg(CASE WHEN rn <= 10 THEN success::INT END) AS recent_success_rate,
  avg(CASE WHEN rn <= 10 THEN final_reward END) - avg(final_reward) AS recent_reward_lift
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pos DESC) AS rn FROM {members}) GROUP BY {key}"""


TOKENS = "len(regexp_extract_all(lower({}), '[a-z0-9]+'))"

CTES["lib"] = f"""
SELECT h.*, st.* EXCLUDE (skill_id), {TOKENS.format('h.content')} AS token_cost FROM heads h JOIN ({stats_sql('members')}) st USING (skill_id)"""

CTES["skilltok"] = """
SELECT pos, token, count(*)::DOUBLE AS c FROM (
  SELECT pos, unnest(regexp_extract_all(lower(name || chr(10) || granularity || chr(10) || content), '[a-z0-9]+')) AS token FROM lib) GROUP BY ALL"""
CTES["skillnorm"] = "SELECT pos, sqrt(sum(c * c)) AS n FROM skilltok GROUP BY pos"

COST = "token_cost / (token_cost + 100.0)"


def pue_sql(sim: str = "sim", cost: bool = True, recent: bool = True) -> str:
    return (
        f"1.2 * {'recent_success_rate' if recent else '0'} + 0.9 * avg_reward + 0.6 * coverage"
        f" + 0.4 * {'recent_reward_lift' if recent else '0'} + 0.3 * least(1.0, support / 20.0) + 0.5 * {sim}"
        f" - 0.8 * failure_rate - 0.5 * {COST if cost else '0'}"
    )


def task_text_sql(first: int) -> str:
    return f"""
SELECT trajectory_id AS task_id, min(goal) || chr(10) || min(env) || chr(10) || string_agg(label || chr(10) || text, chr(10) ORDER BY step_index) AS text
FROM segs WHERE step_index <= {first} GROUP BY trajectory_id"""


CTES["text5"] = task_text_sql(5)
CTES["text8"] = task_text_sql(8)


def sims_sql(texts: str, keys: str = "task_id") -> str:
    on = " AND ".join(f"d.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {sel}, l.*, coalesce(d.dot / (l.n * t.n), 0) AS sim
FROM (SELECT {keys}, sqrt(sum(c * c)) AS n FROM tok_{texts} GROUP BY {keys}) t
CROSS JOIN (SELECT lib.*, n FROM lib JOIN skillnorm USING (pos)) l
LEFT JOIN (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, b.pos, sum(a.c * b.c) AS dot FROM tok_{texts} a JOIN skilltok b USING (token) GROUP BY ALL) d
  ON {on} AND d.pos = l.pos"""


def tok_sql(texts: str, keys: str = "task_id") -> str:
    return f"""
SELECT {keys}, token, count(*)::DOUBLE AS c FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM {texts}) GROUP BY ALL"""


CTES["tok_text5"] = tok_sql("text5")
CTES["tok_text8"] = tok_sql("text8")
CTES["sims5"] = sims_sql("text5")
CTES["states"] = """
SELECT task_id, t, env, goal, coalesce(lag(observation) OVER w, '') AS observation,
  list(action) OVER (PARTITION BY task_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent FROM steps WINDOW w AS (PARTITION BY task_id ORDER BY t)"""
CTES["statetext"] = """
SELECT task_id, t, goal || chr(10) || env || chr(10) || observation || CASE WHEN len(coalesce(recent, [])) > 0 THEN chr(10) || array_to_string(recent, chr(10)) ELSE '' END AS text FROM states"""
CTES["tok_statetext"] = tok_sql("statetext", "task_id, t")
CTES["simstate"] = sims_sql("statetext", "task_id, t")

# graph on the embeddings
CTES["gseg"] = """
SELECT vec_id AS pos, CAST(vec_id AS VARCHAR) AS segment_id, vec_id // 5 AS trajectory_id, vec_id % 5 AS step_index, 'L' || label AS label,
  CASE WHEN label % 2 = 0 THEN 'inspect_product' ELSE 'search_query' END AS template, (vec_id // 5) % 2 = 0 AS success, label AS grp,
  list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"""
CTES["gu"] = "SELECT *, sqrt(list_dot_product(v, v)) AS nv FROM gseg"
CTES["gsim"] = """
SELECT a.pos AS src, b.pos AS dst, greatest(0, round(list_dot_product(a.v, b.v) / (a.nv * b.nv), 12)) AS sim FROM gu a JOIN gu b ON a.pos <> b.pos"""
CTES["gtop"] = "SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM gsim) WHERE r <= 8"
CTES["gnext"] = "SELECT a.pos AS src, b.pos AS dst FROM gseg a JOIN gseg b ON a.trajectory_id = b.trajectory_id AND b.step_index = a.step_index + 1"
CTES["gtend"] = "SELECT label, template, avg(success::INT) AS tendency FROM gseg GROUP BY ALL"
CTES["gmask"] = """
SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM (SELECT src, dst FROM gtop UNION ALL SELECT src, dst FROM gnext)"""
CTES["gedges"] = """
SELECT m.src, m.dst, s.sim AS semantic, CASE WHEN n.src IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS transition, a.success AS src_success, b.success AS dst_success,
  1 - abs(ta.tendency - tb.tendency) AS outcome,
  0.45 * s.sim + 0.35 * CASE WHEN n.src IS NULL THEN 0.0 ELSE 1.0 END + 0.2 * (1 - abs(ta.tendency - tb.tendency)) AS weight
FROM gmask m JOIN gsim s USING (src, dst) LEFT JOIN gnext n ON n.src = m.src AND n.dst = m.dst
JOIN gseg a ON a.pos = m.src JOIN gseg b ON b.pos = m.dst JOIN gtend ta ON ta.label = a.label AND ta.template = a.template JOIN gtend tb ON tb.label = b.label AND tb.template = b.template"""
CTES["gcon"] = """
SELECT *, CASE WHEN src_success AND dst_success THEN weight WHEN NOT src_success AND NOT dst_success THEN -0.65 * weight ELSE 0 END AS contrastive FROM gedges"""


#: expressions that several others read
STORED = {"gseg", "gu", "gsim", "gtop", "gnext", "gtend", "gmask", "gedges"}


def sql(body: str) -> str:
    """``body`` with the common-table expressions it names, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    listed = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({CTES[n].strip()})" for n in ordered)
    head = body.strip()
    if head.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {listed},\n{head[15:]}"
    if head.upper().startswith("WITH "):
        return f"WITH {listed},\n{head[5:]}"
    return f"WITH {listed}\n{head}"
