"""What an operator stores or sends must not grow faster than its input."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemill.operators import components, external, neighbours, scoring, selectors, spectral, traces
from stridemill.operators.components import connected_components
from stridemill.scale import checkpoint
from stridemill.streaming.context import stream_states


def frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")


def shuffle_files(spark):
    """Sizes of the shuffle files on this session's disk by name."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    every = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in every if f.getName().startswith("shuffle_")}


def test_neighbours_without_clusters_are_scanned_not_copied_to_cells(spark):
    vectors = np.random.default_rng(5).normal(size=(1500, 24))
    report = {}
    got = {(r["src"], r["dst"]) for r in neighbours.nearest(frame(spark, vectors), 4, 64, report=report).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.maximum(np.round(unit @ unit.T, 12), 0)
    np.fill_diagonal(sims, -1)
    assert got == {(i, int(j)) for i in range(1500) for j in np.lexsort((np.arange(1500), -sims[i]))[:4]}
    assert report["cells"] == 38 and report["copies_per_row"] < 2 * neighbours.SCAN_BLOCKS


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_meet_once_in_turns_whose_files_are_removed(spark, monkeypatch, kind):
    vectors = np.random.default_rng(9).normal(size=(1200, 24)).astype(np.float32)
    vectors[7::40] = vectors[7]
    vectors[11] = 0
    monkeypatch.setattr(neighbours, "SCAN_BYTES", 24 * 4 * 200)
    monkeypatch.setattr(neighbours, "TURN_BLOCKS", 3)
    asked, crossed = [], neighbours.PivotIndex._crossed
    monkeypatch.setattr(neighbours.PivotIndex, "_crossed", lambda *a: (asked.append(a[6:]), crossed(*a))[1])
    rows = checkpoint(frame(spark, vectors).withColumn("vector", F.col("vector").cast(f"array<{kind}>")))
    before = shuffle_files(spark)
    found = neighbours.nearest(rows, 4, 64)
    left = sum(size for name, size in shuffle_files(spark).items() if name not in before)
    assert asked[1:] == ([(True, range(0, 2)), (True, range(2, 4))] if kind == "float" else [(True, range(0, 2)), (True, range(2, 4)), (True, range(4, 7))])
    assert left < 3 * vectors.nbytes
    unit = vectors.astype(float) / np.maximum(np.linalg.norm(vectors.astype(float), axis=1, keepdims=True), 1e-12)
    sims = np.maximum(np.round(unit @ unit.T, 12), 0)
    np.fill_diagonal(sims, -1)
    assert {(r["src"], r["dst"]) for r in found.collect()} == {(i, int(j)) for i in range(1200) for j in np.lexsort((np.arange(1200), -sims[i]))[:4]}


def test_links_without_clusters_are_scanned_not_copied_to_cells(spark, monkeypatch):
    vectors = np.random.default_rng(6).normal(size=(900, 16))
    monkeypatch.setattr(neighbours.PivotIndex, "other_cells", lambda *a: 1 / 0)
    rows = frame(spark, vectors).selectExpr("id", "vector", "id % 2 AS level")
    links = checkpoint(neighbours.similar_links(rows, 0.75, "level", 64).filter("a <> b"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    parity = np.arange(900) % 2
    near = (unit @ unit.T >= 0.75) & (parity[:, None] == parity[None, :])
    label = np.arange(900)
    for _ in range(900):
        label, before = np.where(near, label[None, :], 999).min(axis=1), label
        if (label == before).all():
            break
    got = {r["id"]: r["component"] for r in connected_components(links).collect()}
    assert len(got) > 20 and all(got.get(i, i) == label[i] for i in range(900))


def test_strips_keep_the_best_of_negative_and_zero_rows():
    import pyarrow as pa

    rows = np.array([[1.0, 0], [-1, 0], [0, 0], [0.6, 0.8]])
    ids = pa.chunked_array([pa.array(np.arange(4))])
    found = neighbours._best(3, pa.int64())(None, ids, rows, ids, rows).to_pylist()
    assert [(r["rep"], r["other"], r["sim"]) for r in found] == [(0, 0, 1.0), (0, 3, 0.6), (1, 1, 1.0), (3, 3, 1.0), (3, 0, 0.6)]


def test_model_of_any_size_round_trips_in_parts(spark, tmp_path):
    from stridemill.plans import fixtures as fx
    from stridemill.plans import library
    from stridemill.sources import models

    model = library.build(fx.segments(spark, "/root/testdata/sf0.001")).stored()
    models.write_model_parts(model, str(tmp_path / "parts"), part_rows=70)
    longest = max(len(r["value"]) for r in spark.read.text(str(tmp_path / "parts")).collect())
    back, segs = models.read_model_document(spark, str(tmp_path / "parts"), parts=True)
    rows = lambda df: sorted(map(repr, df.collect()))
    pick = ["skill_id", "pos", "support", "success_rate", "granularity", "content"]
    assert rows(back.skills.select(*pick)) == rows(model.skills.select(*pick))
    order = lambda df: {r["skill_id"]: [i[1] for i in sorted(r["l"])] for r in df.groupBy("skill_id").agg(
        F.collect_list(F.struct("pos", "segment_id")).alias("l")).collect()}
    assert order(back.members) == order(model.members)
    assert rows(back.nodes.select("node_id", "text")) == rows(model.nodes.select("node_id", "text"))
    assert rows(back.edges.select("source", "target")) == rows(model.edges.select("source", "target"))
    assert segs.select("pos").distinct().count() == segs.count() == 1000 and longest < 60_000


def test_selector_metrics_store_cells_once_not_per_selector(spark, monkeypatch):
    from stridemill.operators import selectors

    rng = np.random.default_rng(8)
    scores = []
    utility = {(t, p): round(float(rng.normal()), 1) for t in range(60) for p in range(5)}
    rank = {key: i for i, (_, key) in enumerate(sorted((u, (p, t)) for (t, p), u in utility.items()))}
    for name in ("a", "flat", "b"):
        scores += [(name, f"t{t}", t, p, "s", u, 1.0, 2.0 if name == "flat" else round(float(rng.normal()) + u, 1), rank[p, t])
                   for (t, p), u in utility.items()]
    rows = spark.createDataFrame(
        scores, "selector string, task_id string, task_pos long, pos long, skill_id string, utility double, token_cost double, score double, utility_rank long")
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    plain = rounded(selectors.selector_metrics(rows.drop("utility_rank")))
    monkeypatch.setattr(selectors, "with_ranks", lambda *a: 1 / 0)
    assert rounded(selectors.selector_metrics(rows)) == plain and len(plain) == 3


def test_stream_state_groups_are_bounded_and_carried_over_triggers(spark, tmp_path):
    logged = spark.range(600).selectExpr(
        "concat('u', id % 90) AS task_id", "id div 90 + 1 AS t", "'e' AS env", "'g' AS goal", "concat('a', id) AS action", "concat('o', id) AS observation")
    for low, high in ((1, 2), (3, 3), (4, 7)):
        logged.filter(f"t BETWEEN {low} AND {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(logged.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_states(arriving, 3, None, buckets=8).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    want = traces.task_states(logged, 3)
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_state_of_an_idle_task_is_dropped(spark, tmp_path):
    fields = "task_id string, t long, env string, goal string, action string, observation string"
    (tmp_path / "in").mkdir()
    arriving = spark.readStream.schema(fields).parquet(str(tmp_path / "in"))
    query = stream_states(arriving, 3, 1, buckets=1).writeStream.format("memory").queryName("idle_states").option(
        "checkpointLocation", str(tmp_path / "c")).start()
    rows = 0
    try:
        for t, tasks in ((1, "ab"), (2, "b"), (3, "a")):
            spark.createDataFrame([(x, t, "e", "g", f"{x}{t}", f"o{t}") for x in tasks], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            rows += len(tasks)
            until = time.time() + 60  # pending timeouts keep the query going, so it is polled
            while spark.table("idle_states").count() < rows and time.time() < until:
                time.sleep(0.2)
            time.sleep(2)
        got = {(r["task_id"], r["t"]): r["recent_actions"] for r in spark.table("idle_states").collect()}
    finally:
        query.stop()
    assert got == {("a", 1): [], ("b", 1): [], ("b", 2): [], ("a", 3): []}


def test_terms_are_counted_in_their_row(spark):
    texts = [(0, "a b B", "b c"), (1, "", "x"), (2, None, None), (3, "z z", "z"), (3, "q", "z q")]
    pairs = checkpoint(spark.createDataFrame(texts, "id long, l string, r string"))
    cosine = scoring.pair_cosine(pairs, ["id"], "l", "r")
    terms = scoring.text_terms(pairs.filter("id < 3"), "id", F.col("l"))
    assert all("Exchange" not in df._jdf.queryExecution().toString() for df in (cosine, terms))
    assert sorted((r["id"], round(r["cosine"], 6)) for r in cosine.collect()) == [(0, 0.632456), (1, 0.0), (2, 0.0), (3, 0.707107), (3, 1.0)]
    assert sorted((r["id"], r["token"], round(r["w"], 6)) for r in terms.collect()) == [(0, "a", 0.447214), (0, "b", 0.894427)]


def test_feature_space_counts_nothing(spark):
    segs = spark.createDataFrame([("a", "A", "x", "one two"), ("a", "", "y", "two"), ("b", "C", "z", "three")], "trajectory_id string, label string, template string, text string")
    segs = segs.selectExpr("*", "'g' AS goal", "'e' AS env", "1L AS step_index")
    none = "array<struct<value:string,count:bigint>>"
    skills = spark.createDataFrame([(0, "n", "low", "two")], "pos long, name string, granularity string, content string").withColumns(
        {c: F.array().cast(none) for c in ("labels", "action_templates")})
    found = selectors.feature_space(skills, spark.createDataFrame([("a",)], "task_id string"), segs)
    assert sorted(map(tuple, found.collect())) == sorted(
        [("label", "A"), ("template", "x"), ("template", "y"), *[("text", w) for w in ("g", "e", "a", "one", "two", "n", "low")]])


def test_import_joins_narrow_rows_to_few_sources(spark):
    fields = "segment_id string, trajectory_id string, goal string, label string, template string, success boolean, final_reward double, step_reward double, text string, pos long"
    segs = spark.createDataFrame([(f"s{i}", t, g, "l", "t", True, 1.0, 0.0, "long text", i) for i, (t, g) in enumerate((("a", "g"), ("b", "a"), ("", None)))], fields)
    sources = spark.createDataFrame([("k", 0, "g"), ("k", 1, "a"), ("m", 0, "a"), ("m", 1, "")], "key string, spot int, source string")
    found = external.segments_for_sources(sources, segs)
    assert "text#" not in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1].split("LogicalRDD")[0]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["key"], r["segment_id"], tuple(r["pos"])) for r in found.collect())
    assert got == [("k", "s0", (0, 1, 0)), ("k", "s1", (1, 1, 1)), ("m", "s0", (0, 0, 0)), ("m", "s1", (0, 1, 1))]


def test_import_groups_only_segments_that_may_meet_a_key_twice(spark, monkeypatch):
    fields = "segment_id string, trajectory_id string, label string, template string, success boolean, final_reward double, step_reward double, pos long, goal string"
    rows = [(f"s{i}", t, "l", f"t{i % 2}", True, 1.0, 0.0, i if i else None, g) for i, (t, g) in enumerate([("x", "g")] * 5 + [("a", "b"), ("a", "g"), ("b", None), (None, "a")])]
    sources = spark.createDataFrame([("k", 0, "g"), ("k", 1, "a"), ("k", 2, "g"), ("m", 0, "b"), ("m", 1, "a"), ("n", 0, "")], "key string, spot int, source string")
    grouped, unique = [], external.unique_members
    monkeypatch.setattr(external, "unique_members", lambda members, *a: grouped.append(members.count()) or unique(members, *a))
    for segs in (rows, rows + [(*rows[1][:7], 70, "a")]):
        placed = {}
        for segment, trajectory, *_, pos, goal in segs:
            for key, spot, source in sources.collect():
                for branch, value in enumerate((trajectory, goal)):
                    if value and value == source:
                        placed.setdefault((key, segment), []).append((spot, branch, pos))
        found = external.segments_for_sources(sources, spark.createDataFrame(segs, fields))
        order = lambda p: (p[0], p[1], -1 if p[2] is None else p[2])
        got = found.withColumn("number", external._place_number()).collect()
        assert {(r["key"], r["segment_id"]): tuple(r["pos"]) for r in got} == {k: min(v, key=order) for k, v in placed.items()}
        assert len(got) == len(placed) and grouped.pop() == (6 if segs is rows else sum(map(len, placed.values())))
        assert [tuple(r["pos"]) for r in sorted(got, key=lambda r: r["number"])] == sorted((tuple(r["pos"]) for r in got), key=order)


def test_chains_are_contracted_where_they_are_and_only_links_between_parts_take_rounds(spark, monkeypatch):
    rounds, kept, stars, linked = [], [], components._stars, components._linked
    monkeypatch.setattr(components, "_stars", lambda edges: (rounds.append(1), stars(edges))[1])
    monkeypatch.setattr(components, "_linked", lambda edges: (kept.append(edges.count()), linked(edges))[1])
    links = spark.range(45000).selectExpr("id AS a", "if(id % 1100 < 7, id, id + 7) AS b")
    got = {r["id"]: r["component"] for r in connected_components(links).collect()}
    root = {}
    for i in range(45007):
        before = i - 7
        root[i] = root[before] if before >= 0 and before % 1100 >= 7 else i
    assert got == root and not rounds
    # parts end with an Arrow batch, and seven chains cross each end
    assert {r["id"]: r["component"] for r in connected_components(links, 1).collect()} == root
    assert 0 < kept[0] <= 7 * 5 and len(rounds) <= 4


def test_smallest_reachable_ids_of_a_part():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    label = np.arange(400)
    for _ in range(400):
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
    ids, root = components._smallest(a, b)
    assert set(ids) == set(a) | set(b) and (root == label[ids]).all()


def test_members_that_carry_their_segment_are_not_joined_to_it(spark):
    from stridemill.operators import refine
    from stridemill.operators import skills as sk
    from stridemill.plans import fixtures as fx
    from stridemill.plans import library

    segs = checkpoint(fx.segments(spark, "/root/testdata/sf0.001"))
    wide, narrow = library.build(segs, wide=True), library.build(segs)
    names = {r.skill_id for r in wide.skills.collect() if r.granularity == "mid"}
    scored = checkpoint(wide.skills.withColumn("refinement_action", F.when(F.col("skill_id").isin(*names), "split_candidate").otherwise("stable")))
    assert sk.member_segments(wide.members, segs.limit(0)).count() == 3 * segs.count()
    results = []
    for model in (wide, narrow):
        children, members, edges = refine.split_skills(scored, model.members, segs)
        rows = children.orderBy("skill_id").select("skill_id", "support", "trajectory_count", "recent_reward_lift", "labels").collect()
        results.append((rows, members.count(), sorted(edges.collect())))
        assert sorted(refine.split_edges(scored, model.members, segs).collect()) == results[-1][2]
    assert results[0] == results[1] and len(results[0][0]) == 2 * len(names)


def test_skill_statistics_rank_only_the_last_places(spark):
    from stridemill.operators import skills as sk

    rows = spark.range(4000).selectExpr(
        "if(id < 3970, 'many', 'few') AS key", "concat('t', id % 90) AS trajectory_id", "concat('l', id % 7) AS label", "'x' AS template",
        "if(id % 11 = 0, null, id % 3 = 0) AS success", "id * 0.5 AS final_reward", "1.0 AS step_reward", "if(id > 3990, null, id * 7 % 4000) AS pos")
    cells = sk.skill_cells(rows)
    got = {r.key: r for r in sk.skill_statistics(rows, cells).join(sk.recent_statistics(rows, cells), "key").collect()}
    held = rows.collect()
    for key in ("many", "few"):
        mine = [r for r in held if r.key == key]
        last = sorted((r for r in mine if r.pos is not None), key=lambda r: -r.pos)[:10]
        known = [r.success for r in mine if r.success is not None]
        assert got[key].support == len(mine) and got[key].trajectory_count == len({r.trajectory_id for r in mine})
        assert abs(got[key].success_rate - sum(known) / len(known)) < 1e-12
        assert abs(got[key]._recent_reward - sum(float(r.final_reward) for r in last) / 10) < 1e-9
    assert cells.count() <= 2 * 7 * sk.STRIPES


def test_cells_of_a_partition_are_bounded(spark):
    from stridemill.plans import fixtures as fx
    from stridemill.plans import library

    steps = fx.steps(spark, "/root/testdata/sf0.001")
    segs = checkpoint(traces.segments(steps))
    tasks = checkpoint(selectors.split_tasks(traces.trajectories(steps), 0.4, ["first_pos", "task_id"]).filter("future"))
    skills = library.build(segs).skills
    whole = tasks.count() * skills.count()
    cells = selectors.match_grid(tasks, skills, segs, part_cells=whole // 20)
    sizes = [r["count"] for r in cells.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == whole and max(sizes) < whole // 5
    columns = ["task_id", "pos", F.round("text_match", 12), F.round("label_match", 12)]
    assert sorted(cells.select(columns).collect()) == sorted(selectors.match_grid(tasks, skills, segs).select(columns).collect())


def test_hits_read_back_know_their_place_inside_their_granularity(spark, tmp_path):
    from stridemill.sources import records

    skill = "named_struct('skill_id', {0}, 'granularity', {1}, 'metadata', named_struct('retrieval_score', 0.5D, 'retrieval_strategy', 'pue'))"
    listed = ", ".join(skill.format(f"'s{i}'", g) for i, g in enumerate(["'mid'", "'low'", "'mid'", "CAST(null AS STRING)", "'low'", "'mid'"]))
    log = spark.range(1).selectExpr("'a' AS task_id", "1L AS step", f"array({listed}) AS retrieved_skills")
    records.write_jsonl(log, str(tmp_path / "log"))
    got = [(r["rank"], r["level_rank"], r.skill_id) for r in records.read_hits(spark, str(tmp_path / "log")).orderBy("rank").collect()]
    assert got == [(1, 1, "s0"), (2, 1, "s1"), (3, 2, "s2"), (4, 1, "s3"), (5, 2, "s4"), (6, 3, "s5")]
    empty = records.read_jsonl_or_empty(spark, str(tmp_path / "none"), "task_id string, step long")
    assert empty.columns == ["task_id", "step"] and empty.count() == 0


@pytest.mark.parametrize("job_bytes", [spectral.JOB_BYTES, 1])
def test_solver_rounds_leave_no_files_behind(spark, monkeypatch, tmp_path, job_bytes):
    rng = np.random.default_rng(8)
    ends = [(int(min(a, b)), int(max(a, b)), float(w)) for a, b, w in zip(*rng.integers(0, 80, (2, 400)), rng.random(400), strict=True) if a % 2 == b % 2 and a != b]
    segs = spark.range(80).selectExpr("id AS pos", "id % 2 = 0 AS success")
    edges = checkpoint(spark.createDataFrame(ends, "src long, dst long, weight double").groupBy("src", "dst").agg(F.first("weight").alias("weight")).withColumn(
        "contrastive", F.when(F.col("src") % 2 == 0, F.col("weight")).otherwise(-0.65 * F.col("weight"))))
    dense = np.zeros((80, 80))
    for r in edges.collect():
        dense[r["src"], r["dst"]] = dense[r["dst"], r["src"]] = r["contrastive"]
    scale = 1 / np.sqrt(np.maximum(np.abs(dense).sum(1), 1e-12))
    held, grams, old = [], spectral._grams, spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/kept")

    def count(*a):
        out = grams(*a)
        held.append((len(list(tmp_path.rglob("rdd-*"))), len(shuffle_files(spark))))
        return out

    monkeypatch.setattr(spectral, "_grams", count)
    try:
        with pytest.warns(UserWarning, match="not converged"):
            found = spectral.bottom_spectrum(segs, edges, 5, tolerance=0.0, max_rounds=4, job_bytes=job_bytes)
    finally:
        spark.sparkContext.setCheckpointDir(old)
    assert np.abs(found.values - np.linalg.eigvalsh(np.eye(80) - dense * scale[:, None] * scale[None, :])[:5]).max() < 1e-3
    # a round's tables and shuffle files go; what its sums on the driver shuffled may stay
    assert held[3][0] <= held[1][0] and held[3][1] <= held[1][1] + 2 * 4 * 4
    assert found.vectors.count() == 80
