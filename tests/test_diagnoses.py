"""Classes of failed episodes against plain lists."""

import random

from tessera.operators import diagnoses

KIND = "success boolean, official_osr boolean, observed_reach boolean, reached_then_collided boolean, final_within boolean, collision boolean, termination string, minimum_distance double, steps int, longest_turn_run int, turn_fraction double, net_displacement double, final_action string, collision_object string, final_distance double"


def test_counts_equal_plain_lists(spark):
    r = random.Random(12)
    flag = lambda: r.choice([True, False, None])
    rows = [(flag(), flag(), flag(), flag(), flag(), flag(), r.choice(["stop", "collision", "step_limit", None]), r.choice([None, 5.0, 20.0, 24.9, 25.0, 35.0, 40.0, 900.0]), r.choice([1, 3, 5, 20, 60]), r.randrange(20), r.random(), r.uniform(0, 12), r.choice([None, "a", "b"]), r.choice([None, "w"]), r.uniform(0, 50)) for _ in range(500)]
    names = [f.split()[0] for f in KIND.split(", ")]
    plain = [dict(zip(names, x, strict=True)) for x in rows]
    df = spark.createDataFrame(rows, KIND)
    got = {(x.measure, x.bucket): x.n for x in diagnoses.counts(df).collect()}
    false_stop = [e for e in plain if e["termination"] == "stop" and not e["success"]]
    lost = [e for e in plain if not e["observed_reach"]]
    reached = [e for e in plain if e["observed_reach"] and not e["success"]]
    want = {
        ("success", None): sum(bool(e["success"]) for e in plain),
        ("official_osr_only", None): sum(bool(e["official_osr"]) and not e["success"] for e in plain),
        ("no_official_osr", None): sum(not e["official_osr"] and not e["success"] for e in plain),
        ("stop_terminations", None): sum(e["termination"] == "stop" for e in plain),
        ("false_stops", None): len(false_stop),
        ("false_stops_without_observed_reach", None): sum(not e["observed_reach"] for e in false_stop),
        ("false_stops_at_step_0", None): sum(e["steps"] == 1 for e in false_stop),
        ("false_stops_within_first_5_actions", None): sum(e["steps"] <= 5 for e in false_stop),
        ("observed_reach_failures", None): len(reached),
        ("reached_then_collided", None): sum(bool(e["reached_then_collided"]) for e in plain),
        ("reached_but_never_stopped", None): sum(e["termination"] != "stop" for e in reached),
        ("ended_inside_without_stop", None): len(inside := [e for e in plain if e["final_within"] and not e["success"] and e["termination"] != "stop"]),
        ("never_observed_within", None): len(lost),
        ("near_miss", None): sum(e["minimum_distance"] is not None and e["minimum_distance"] < 25 for e in lost),
        ("collision_before_reach", None): sum(bool(e["collision"]) for e in lost),
        ("step_limit_before_reach", None): sum(e["termination"] == "step_limit" for e in lost),
        ("turn_loop_candidates", None): sum(e["steps"] >= 20 and (e["longest_turn_run"] >= 12 or e["turn_fraction"] >= 0.85) for e in lost),
        ("low_net_displacement_candidates", None): sum(e["steps"] >= 50 and e["net_displacement"] < 6 for e in lost),
        ("collisions", None): sum(bool(e["collision"]) for e in plain),
    }
    add = lambda key: want.__setitem__(key, want.get(key, 0) + 1)
    for e in reached:
        add(("reach_failure_terminations", e["termination"] or "none"))
    for e in inside:
        add(("inside_without_stop_terminations", e["termination"] or "none"))
    for e in lost:
        for low, high, name in diagnoses.BINS:
            if e["minimum_distance"] is not None and low <= e["minimum_distance"] < high:
                add(("minimum_distance_bins", name))
    for e in plain:
        if e["collision"]:
            add(("collision_final_actions", e["final_action"] or "none"))
            add(("collision_objects", e["collision_object"] or "none"))
    assert got == want
    assert diagnoses.stop_precision(diagnoses.counts(df)).first()[0] == want["success", None] / want["stop_terminations", None]
    assert diagnoses.described(df, "false_stops", "final_distance").first()["count"] == len(false_stop)
    nothing = df.limit(0)
    assert diagnoses.counts(nothing).count() == 0 == diagnoses.described(nothing, "success", "steps").count() and diagnoses.stop_precision(diagnoses.counts(nothing)).first()[0] == 0.0
