"""List order on gapped, tied, zero-based and null step numbers; sets too large to list; components."""

import collections
import itertools
import random

import pytest

from stridemill.operators import frequent, refine, traces
from stridemill.operators.components import connected_components


def rows(spark, indices):
    made = [(f"s{i:02d}", "t", k, i, f"l{i}", f"x{i}", "g", "e") for i, k in enumerate(indices)]
    return spark.createDataFrame(made, "segment_id string, trajectory_id string, step_index long, pos long, label string, text string, goal string, env string")


@pytest.mark.parametrize("indices", [list(range(8)), [3000 * i for i in range(8)], [5] * 8, [None, None, 1, 2, 9, 9, 10, 400]])
def test_neighbours_and_texts_follow_list_order(spark, indices):
    segs = rows(spark, indices)
    edges = sorted((r.source, r.target) for r in traces.sequence_edges(segs).collect())
    assert edges == [(f"s{i:02d}", f"s{i + 1:02d}") for i in range(7)]
    text = traces.task_texts(segs, 3).collect()
    assert len(text) == 1 and text[0].text.split("\n")[2:] == ["l0", "x0", "l1", "x1", "l2", "x2"]


def test_large_sets_are_refused_and_small_ones_counted(spark):
    few = spark.createDataFrame([("r", f"m{i}", "mid") for i in range(5)], "task_id string, skill_id string, granularity string")
    assert refine.mid_co_usage(few, ["task_id"]).count() == 2**5 - 6
    for size in (31, 63, 64, 80):
        many = spark.createDataFrame([("r", f"m{i}", "mid") for i in range(size)], few.schema)
        with pytest.raises(Exception, match="co-usage set"):
            refine.mid_co_usage(many, ["task_id"]).collect()


def test_components_of_chains_hubs_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7), (200, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 151)}, 200: 200}




def plain_sets(records, least):
    """All sets used together, sorted, and those used often with their place."""
    counted = collections.Counter(c for r in records for k in range(2, len(r) + 1) for c in itertools.combinations(sorted(r), k))
    place = {s: i for i, s in enumerate(sorted(counted))}
    return {s: (n, place[s]) for s, n in counted.items() if n >= least}


@pytest.mark.parametrize("list_set", [0, 3, 20])
def test_frequent_sets_and_their_places_equal_the_listing(spark, list_set):
    rnd = random.Random(list_set)
    records = [tuple(sorted(rnd.sample("abcdefghi", rnd.randint(1, 5)))) for _ in range(12)] + [tuple("abcdefg")] * 2
    rows = [(i, s, "mid") for i, r in enumerate(records) for s in [*r, r[0]]] + [(0, "z", "low"), (1, "", "mid")]
    hits = spark.createDataFrame(rows, "task_id int, skill_id string, granularity string")
    sets = frequent.record_sets(hits, ["task_id"])
    for least in (1, 2, 4):
        used = frequent.frequent_sets(sets, least)
        got = {tuple(r.mids): (r["count"], int(r.set_index)) for r in frequent.numbered_sets(sets, used, list_set).collect()}
        assert got == plain_sets(records, least)


def test_a_record_of_eighty_skills_is_mined_and_numbered(spark):
    wide = [f"m{i:02d}" for i in range(80)]
    records = [wide, ["m03", "m05", "m79"], ["m03", "m05", "zz"]]
    rows = [(i, s, "mid") for i, r in enumerate(records) for s in r]
    hits = spark.createDataFrame(rows, "task_id int, skill_id string, granularity string")
    sets = frequent.record_sets(hits, ["task_id"])
    got = {tuple(r.mids): (r["count"], int(r.set_index)) for r in frequent.numbered_sets(sets, frequent.frequent_sets(sets, 2)).collect()}
    assert {s: n for s, (n, _) in got.items()} == {("m03", "m05"): 3, ("m03", "m05", "m79"): 2, ("m03", "m79"): 2, ("m05", "m79"): 2}
    # sets that begin below m03, then those that begin m03, m04
    before = sum(2 ** (79 - i) - 1 for i in range(3)) + 2 ** (79 - 4)
    assert got["m03", "m05"][1] == before
    # all subsets of m06..m78 behind m03, m05 come first
    assert got["m03", "m05", "m79"][1] == before + 2**74 - 1
    none = frequent.frequent_sets(frequent.record_sets(hits.limit(0), ["task_id"]), 2)
    assert none.count() == 0
    twice = spark.createDataFrame([(i, s, "mid") for i in range(2) for s in wide], hits.schema)
    with pytest.raises(Exception, match="co-usage set"):
        frequent.frequent_sets(frequent.record_sets(twice, ["task_id"]), 2).collect()
