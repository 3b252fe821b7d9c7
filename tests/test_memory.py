"""Memory states against a plain walk over the steps."""

import math
import random

from tessera.functions.actions import TRANSLATIONS, TURNS
from tessera.operators.memory import states

LEFT, RIGHT = TURNS
FORWARD = TRANSLATIONS[0]


def _wrap(a):
    return (a + 180) % 360 - 180


def plain(poses, actions, n=5):
    """motion and turn state after all of the actions, restated from their definitions."""
    gap = lambda p, q: math.dist(p[:3], q[:3])
    k = len(actions)
    recent = actions[-n:]
    net = gap(poses[-1], poses[-(min(n, k) + 1)])
    heading = [abs(_wrap(b[3] - a[3])) for a, b in zip(poses, poses[1:], strict=False)]
    revisiting = k > n and any(any(a in TRANSLATIONS for a in actions[i:]) and gap(poses[-1], poses[i]) < 1.0 for i in range(k + 1 - n))
    loop = k >= 10 and any(
        all(a in TURNS for a in actions[i:]) and sum(heading[i:]) >= 300 and gap(poses[-1], poses[i]) < 1.0 and abs(_wrap(poses[-1][3] - poses[i][3])) < 15
        for i in range(k + 1 - 10)
    )
    motion = "not_started" if not k else "revisiting" if revisiting else ("stagnant" if net < 1.0 else "progressing") if any(a in TRANSLATIONS for a in recent) else "stationary_scanning"
    four = recent[-4:]
    if loop:
        turn = "full_rotation_loop"
    elif len(recent) >= 4 and all(a in TURNS for a in four) and all(a != b for a, b in zip(four, four[1:], strict=False)) and net < 1.0:
        turn = "oscillating"
    elif not k or actions[-1] not in TURNS:
        turn = "none"
    else:
        run = next((i for i, a in enumerate(reversed(actions)) if a != actions[-1]), k)
        turn = f"scan_{'left' if actions[-1] == LEFT else 'right'}_x{run}"
    return motion, turn


def walk(actions, blocked=()):
    x = y = z = yaw = 0.0
    poses = [(x, y, z, yaw)]
    for i, a in enumerate(actions):
        if a == FORWARD and i not in blocked:
            x, y = x + 3 * math.cos(math.radians(yaw)), y + 3 * math.sin(math.radians(yaw))
        elif a == LEFT:
            yaw = _wrap(yaw + 30)
        elif a == RIGHT:
            yaw = _wrap(yaw - 30)
        poses.append((x, y, z, yaw))
    return poses


def test_states(spark):
    rnd = random.Random(7)
    episodes = [[RIGHT] * 3, [LEFT, RIGHT, LEFT, RIGHT], [RIGHT] * 12, [FORWARD] * 3 + [LEFT] * 6 + [FORWARD] * 3, [FORWARD] * 2]
    episodes += [[rnd.choice([LEFT, RIGHT, FORWARD, RIGHT]) for _ in range(rnd.randrange(1, 25))] for _ in range(25)]
    rows, expected = [], {}
    for e, actions in enumerate(episodes):
        poses = walk(actions, {0, 1} if e == 4 else ())
        for s, p in enumerate(poses):
            rows.append((e, s, actions[s - 1] if s else None, *p))
            expected[e, s] = plain(poses[: s + 1], actions[:s])
    df = spark.createDataFrame(rows, "episode long, step long, action string, x double, y double, z double, yaw double")
    got = {(r["episode"], r["step"]): (r["motion_state"], r["turn_state"]) for r in states(df, ["episode"], "step").collect()}
    assert got == expected
    assert got[2, 12][1] == "full_rotation_loop" and got[1, 4][1] == "oscillating" and got[4, 2][0] == "stagnant"


def test_states_of_long_episodes(spark, tmp_path):
    """The registered query has every event, also of users with over 100, and the states of a plain walk."""
    from tessera.plans.registry import QUERIES

    rnd = random.Random(11)
    acts = {"view": LEFT, "click": RIGHT, "purchase": FORWARD, "signup": "ascend 3m", "error": "stop"}
    kinds = {1: [rnd.choice(["view", "click", "view", "purchase"]) for _ in range(260)], 2: ["view"] * 150, None: [rnd.choice(list(acts)) for _ in range(130)]}
    rows = [(u, i, i, k) for u, ks in kinds.items() for i, k in enumerate(ks)]
    spark.createDataFrame(rows, "user_id long, event_id long, t long, event_type string").selectExpr("user_id", "event_id", "timestamp_seconds(t) AS ts", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["user_id"], r["step"]): (r["motion_state"], r["turn_state"]) for r in QUERIES["memory_states"](spark, str(tmp_path)).collect()}
    expected = {}
    for u, ks in kinds.items():
        x = yaw = 0.0
        poses = []
        for k in ks:
            x, yaw = x + 3.0 * (k == "purchase"), yaw + 30.0 * ((k == "view") - (k == "click"))
            poses.append((x, 0.0, 0.0, _wrap(yaw)))
        actions = [acts[k] for k in ks[1:]]
        for s in range(len(ks)):
            expected[u, s] = plain(poses[: s + 1], actions[:s])
    assert got == expected and ("full_rotation_loop" in {v[1] for v in got.values()})


def test_revisits_in_long_walks(spark):
    rnd = random.Random(4)
    actions = [rnd.choice([LEFT, RIGHT, FORWARD, LEFT]) for _ in range(250)]
    poses = walk(actions)
    rows = [(s, actions[s - 1] if s else None, *p) for s, p in enumerate(poses)]
    df = spark.createDataFrame(rows, "step long, action string, x double, y double, z double, yaw double").selectExpr("1 AS e", "*")
    got = {r["step"]: (r["motion_state"], r["turn_state"]) for r in states(df, ["e"], "step").collect()}
    assert got == {s: plain(poses[: s + 1], actions[:s]) for s in range(len(poses))} and any(v[0] == "revisiting" for v in got.values())
