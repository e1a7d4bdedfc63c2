import pytest
from pyspark.sql import functions as F

from stridemill.operators import external, refine, scoring, selectors, traces
from stridemill.plans import evaluation, fixtures as fx, library
from stridemill.scale import checkpoint
from stridemill.sources import models, records, runs
from stridemill.streaming.context import stream_retrieval

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    segs = checkpoint(fx.segments(spark, SF))
    return segs, library.build(segs).stored()


def rows(df):
    return sorted(map(str, df.collect()))


def test_skill_blocks_do_not_change_retrieval(spark, base):
    segs, model = base
    asked = traces.online_task_texts(segs)
    whole = scoring.retrieve(asked, model.skills, "pue", k=4)
    blocked = scoring.retrieve(asked, model.skills, "pue", k=4, block=5)
    drop = ["similarity", "score"]
    assert rows(whole.drop(*drop)) == rows(blocked.drop(*drop))


def test_unknown_names(spark, base):
    segs, model = base
    with pytest.raises(ValueError):
        scoring.retrieve(traces.online_task_texts(segs), model.skills, "luck")
    with pytest.raises(ValueError):
        selectors.selector_scores(model.skills, ["luck"])
    with pytest.raises(ValueError):
        selectors.split_tasks(model.skills, 1.0, ["pos"])


def test_constant_scores_have_no_correlation(spark):
    cells = spark.range(20).select(F.lit("flat").alias("selector"), F.col("id").alias("task_pos"), F.lit(0).cast("long").alias("pos"),
                                   F.lit("s").alias("skill_id"), F.lit(1.0).alias("score"), F.lit(1.0).alias("utility"), F.lit(5.0).alias("token_cost"))
    got = selectors.selector_metrics(cells).first()
    assert got["future_utility_pearson"] == 0.0 and got["positive_utility_auc"] == 0.0 and got["regret"] == 0.0


def test_no_skills_gives_empty_evaluation(spark, base):
    from stridemill.plans.mining import mine_nothing

    segs, _ = base
    heads = segs.groupBy(F.col("trajectory_id").alias("task_id")).agg(
        F.min("final_reward").alias("final_reward"), F.min("success").alias("success"), F.count(F.lit(1)).alias("n_steps"))
    result = evaluation.evaluate_selectors(selectors.split_tasks(heads, 0.4, ["task_id"]), segs, mine_nothing)
    assert result.metrics is None and result.split["skill_count"] == 0


def test_refinement_merges_equal_skills(spark, base):
    segs, model = base
    copies = model.skills.filter("granularity = 'mid'").withColumn("content", F.lit("same")).withColumn("name", F.lit("same"))
    copies = copies.withColumn("embedding_text", F.lit("same"))
    changed = type(model)(model.skills.filter("granularity <> 'mid'").unionByName(copies), model.members, model.nodes, model.edges)
    tasks = traces.trajectories(fx.steps(spark, SF))
    hits = spark.createDataFrame([], "task_id string, t long, skill_id string, granularity string")
    refined = refine.refine_library(changed, segs, tasks, hits, ["task_id", "t"])
    assert refined.meta["structural_updates"]["merged_skill_count"] == 1
    merged = refined.skills.filter("refinement_action = 'merged'").first()
    assert merged["support"] == segs.count() and merged["granularity"] == "mid"
    assert refined.meta["action_counts"] == {"unobserved": model.skills.count()}


def test_unmapped_import_fails(spark, base):
    segs, _ = base
    items = spark.createDataFrame(
        [(0, "lost", "d", "b", None, None, ["nowhere"])],
        "index long, name string, description string, body string, "
        "references array<struct<name:string,path:string,title:string,content:string,body:string>>, "
        "scripts array<struct<name:string,path:string,title:string,content:string,body:string>>, source_trajectories array<string>")
    with pytest.raises(external.UnmappedSkillError):
        external.import_flat_library(items, segs)


def test_segment_records(spark, tmp_path):
    lines = [
        '{"segment_id":"a","label":"L","step_index":1,"text":"t","metadata":{"trajectory_id":"x","final_reward":1.0,"action":"look"}}',
        "", "   ",
        '{"segment_id":"b","step_index":2,"metadata":{"trajectory_id":"x","trajectory_success":null,"final_reward":1.0}}',
        '{"segment_id":"c","metadata":{"trajectory_success":true}}',
    ]
    path = tmp_path / "segments.jsonl"
    path.write_text("\n".join(lines))
    got = {r["segment_id"]: r for r in records.read_segments(spark, str(path)).collect()}
    assert [got[k]["success"] for k in "abc"] == [True, False, True]
    assert [got[k]["pos"] for k in "abc"] == [0, 1, 2]
    assert got["c"]["trajectory_id"] == "unknown" and got["c"]["label"] == "Unknown" and got["b"]["template"] == "unknown_action"
    assert records.read_jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0


def test_model_round_trips(spark, base, tmp_path):
    _, model = base
    models.write_model(model, str(tmp_path / "m"))
    back = models.read_model(spark, str(tmp_path / "m"))
    assert rows(back.skills) == rows(model.skills) and back.method == model.method
    models.write_model_document(model, str(tmp_path / "doc"))
    imported, segs = models.read_model_document(spark, str(tmp_path / "doc"))
    pick = ["skill_id", "pos", "support", "success_rate", "granularity"]
    assert rows(imported.skills.select(*pick)) == rows(model.skills.select(*pick))
    assert imported.members.count() == model.members.count() and segs.count() > 0
    with pytest.raises(ValueError):
        models.write_model_document(model, str(tmp_path / "doc2"), limit=10)


def test_discovery(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "summary.json").write_text('{"success_rate": 0.5, "episodes": 2, "components": {"agent": "x"}}')
    (tmp_path / "deployment_summary.json").write_text('{"runs": [{"experiment_dir": "/elsewhere/r9"}]}')
    (tmp_path / "config.json").write_text('{"runtime": {"output_dir": "/out/r5"}}')
    found = [(r["kind"], r["location"]) for r in runs.discover(spark, [str(tmp_path), str(tmp_path / "config.json")]).collect()]
    assert found == [("run", "/elsewhere/r9"), ("run", "/out/r5"), ("run", str(tmp_path / "r1"))]
    got = runs.read_summaries(spark, [str(tmp_path / "r1")]).first()
    assert got["success_rate"] == 0.5 and got["experiment_dir"] == str(tmp_path / "r1")


def test_stream_retrieval_equals_batch(spark, base, tmp_path):
    segs, model = base
    states = traces.task_states(fx.steps(spark, SF))
    states.write.parquet(str(tmp_path / "in"))
    levels = {"high": 1, "mid": 2, "low": 3}

    def sink(df, batch_id):
        df.write.mode("append").parquet(str(tmp_path / "out"))

    arriving = spark.readStream.schema(states.schema).parquet(str(tmp_path / "in"))
    stream_retrieval(arriving, model.skills, "pue", sink, str(tmp_path / "c"), level_top_k=levels).awaitTermination()
    batch = scoring.retrieve(states.select("task_id", "t", traces.state_text(states).alias("text")), model.skills, "pue",
                             ["task_id", "t"], level_top_k=levels)
    keep = ["task_id", "t", "rank", "skill_id"]
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(*keep)) == rows(batch.select(*keep))
