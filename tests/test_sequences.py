"""Order-dependent operators against plain row-by-row models."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recordflow.operators import agg, number, slugs
from recordflow.streaming.entitlements import CODE, GRANTED, REVOKED, entitlement_ledger

START = datetime(2024, 1, 1)


def test_numbered_and_running_sum_across_blocks(spark):
    rng = random.Random(1)
    data = [(rng.choice("aab"), i, rng.randint(0, 3)) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    got = number.running_sum(number.numbered(df, ["k"], "i", "n", block=16), ["k"], "i",
                             F.col("v"), "s", block=16)
    for r in got.collect():
        upto = [v for k, i, v in data if k == r["k"] and i <= r["i"]]
        assert (r["n"], r["s"]) == (len(upto), sum(upto))
    everyone = number.numbered(df, [], "i", "n", block=16).orderBy("i").collect()
    assert [r["n"] for r in everyone] == list(range(1, 201))


@pytest.mark.parametrize("moments", [200, 1])
def test_next_match_across_parts(spark, monkeypatch, moments):
    rng = random.Random(2)
    data = [(rng.choice("aaab"), i % moments, i, rng.random() < 0.2) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t long, i long, hit boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = number.placed_by_range(df, ["k"], F.struct("t", "i"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # A key whose events all have one time is spread as well.
    assert placed.where("k = 'a'").select("_part").distinct().count() > 1
    for r in number.next_match(placed, ["k"], F.col("hit"), "nxt").collect():
        later = [(t, i) for k, t, i, hit in data if k == r["k"] and hit and (t, i) > (r["t"], r["i"])]
        assert (r["nxt"] and tuple(r["nxt"])) == (min(later) if later else None)


def greedy(names, taken):
    held, out = set(taken), []
    for name in names:
        given, i = name, 2
        while given in held:
            given, i = f"{name}-{i}", i + 1
        held.add(given)
        out.append(given)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_slugs_equal_greedy(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "a-2", "a-3", "a-5", "a-2-2", "a-2-3", "a-1", "a-02", "b", "b-2", "a-4"]
    names = [rng.choice(pool[: 4 + seed] + ["a"] * seed) for _ in range(60)]
    taken = rng.sample(pool + ["a-7", "b-3", "zz"], rng.randint(0, 5))
    df = spark.createDataFrame(list(enumerate(names)), "i long, slug string")
    existing = spark.createDataFrame([(s,) for s in taken], "slug string") if taken else None
    got = slugs.dedupe_slugs(df, "slug", "i", existing, block=8).orderBy("i").collect()
    assert [r["unique_slug"] for r in got] == greedy(names, taken)


@pytest.mark.parametrize("fold", [3, 4096])
def test_many_interleaved_rivals_equal_greedy(spark, fold):
    """Owners of a-2 to a-400 and rows of a in random order; every walk crosses many cuts."""
    rng = random.Random(fold)
    names = ["a"] * 300 + [f"a-{k}" for k in range(2, 400)] + ["a-7-2", "a-7-3", "a-7"] * 5
    rng.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "i long, slug string")
    got = slugs.dedupe_slugs(df, "slug", "i", spark.createDataFrame([("a-9",)], "slug string"),
                             block=64, fold=fold).orderBy("i").collect()
    assert [r["unique_slug"] for r in got] == greedy(names, ["a-9"])


def test_composed_steps_equal_single_ones():
    rng = random.Random(8)
    for _ in range(200):
        limits = [rng.randint(-3, 25) for _ in range(rng.randint(0, 20))]
        one = slugs.composed(limits)
        assert one == sorted(one)
        for start in range(-2, 30):
            h = start
            for t in limits:
                h += h < t
            assert h == start + sum(v > start for v in one)


def random_events(seed, n=300, users=4):
    rng = random.Random(seed)
    at = START
    for i in range(n):
        at += timedelta(minutes=rng.choice([0, 0, 5, 50, 200]))
        yield i, at, rng.randrange(users), rng.choice(["x", "captured", "captured", "refunded"])


def test_transitions_equal_a_walk(spark):
    events = list(random_events(4))
    df = spark.createDataFrame(events, "id long, ts timestamp_ntz, k long, state string")
    before = F.when(F.col("k") == 1, "captured").otherwise("created")
    got = {r["k"]: (r["last_state"], r["at"]) for r in agg.transitions(
        df, "k", "ts", "id", "state", "captured", carry={"n": F.col("id")}).withColumn(
        "at", agg.entered_since(before, "captured")).collect()}
    for k in range(4):
        state, entered = ("captured" if k == 1 else "created"), None
        for _, ts, key, new in sorted(events, key=lambda e: (e[1], e[0])):
            if key == k:
                if new == "captured" and state != "captured":
                    entered = ts
                state = new
        assert got[k] == (state, entered)


def walk_ledger(events):
    out = []
    active = {}
    for i, ts, user, kind, pay in sorted(events, key=lambda e: (e[1], e[0])):
        if kind == "grant" and user not in active:
            active[user] = len(out)
            out.append([user, pay, i, ts, None, "active", CODE, GRANTED])
        elif kind == "revoke" and user in active and out[active[user]][1] == pay:
            row = out[active.pop(user)]
            row[4], row[5], row[7] = ts, "revoked", REVOKED
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("times", [1, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_equals_a_walk(spark, rows, seed, times):
    rng = random.Random(seed)
    kinds = {"x": "noise", "captured": "grant", "refunded": "revoke"}
    events = [(i, ts, min(u, rng.randrange(4)), kinds[s], rng.randrange(3))
              for i, ts, u, s in random_events(seed)]
    df = spark.createDataFrame(
        events * times,
        "event_id long, ts timestamp_ntz, user_id long, kind string, payment_id long")
    assert rows(entitlement_ledger(df)) == walk_ledger(events)


def test_carried_columns_of_transitions(spark):
    events = list(random_events(6))
    df = spark.createDataFrame(events, "id long, ts timestamp_ntz, k long, state string")
    got = {r["k"]: r for r in agg.transitions(df, "k", "ts", "id", "state", "captured",
                                              carry={"n": F.col("id")}).collect()}
    for k in range(4):
        mine = [(i, s) for i, _, key, s in sorted(events, key=lambda e: (e[1], e[0])) if key == k]
        entered = [i for (_, was), (i, s) in zip(mine, mine[1:]) if s == "captured" != was]
        assert got[k]["first"]["n"] == mine[0][0] and got[k]["last"]["n"] == mine[-1][0]
        assert got[k]["entered"]["n"] == entered[-1]


def test_ledger_counts_events_without_an_id(spark, rows):
    """Two users with one grant each, both without an event id, and one delivered twice."""
    data = [(None, START, 1, "grant", 5), (None, START, 2, "grant", 6), (None, START, 2, "grant", 6),
            (None, None, 3, "grant", 7), (None, START, None, "grant", 7)]
    df = spark.createDataFrame(
        data, "event_id long, ts timestamp_ntz, user_id long, kind string, payment_id long")
    assert rows(entitlement_ledger(df), "user_id", "payment_id", "status") == [
        (1, 5, "active"), (2, 6, "active")]


def test_positions_of_sparse_ids(spark, rows):
    ids = [-(1 << 62), -5, 0, 3, 1 << 21, *[i << 40 for i in range(1, 40)], (1 << 62) + 1]
    df = spark.createDataFrame([(k, i) for k in ("a", "b") for i in ids], "k string, i long")
    got = number.numbered(df, ["k"], "i")
    assert rows(got, "k", "i", "position") == sorted(
        ((k, i, n + 1) for k in ("a", "b") for n, i in enumerate(sorted(ids))), key=repr)
    total = number.running_sum(df, ["k"], "i", F.lit(2), "s")
    assert rows(total, "k", "i", "s") == sorted(
        ((k, i, 2 * n + 2) for k in ("a", "b") for n, i in enumerate(sorted(ids))), key=repr)


def test_ledger_goes_on_from_held_grants(spark, rows):
    events = [(i, ts, u, {"x": "noise", "captured": "grant", "refunded": "revoke"}[s], i % 3)
              for i, ts, u, s in random_events(9)]
    schema = "event_id long, ts timestamp_ntz, user_id long, kind string, payment_id long"
    first = entitlement_ledger(spark.createDataFrame(events[:150], schema))
    second = entitlement_ledger(spark.createDataFrame(events[150:], schema), held=first)
    merged = {r[2]: r for r in rows(first)}
    merged.update({r[2]: r for r in rows(second)})
    assert sorted(merged.values(), key=repr) == walk_ledger(events)


def test_streak(spark):
    days = {1: [1, 2, 3, 7, 8], 2: [4], 3: [1, 2, 3, 4, 5, 9]}
    data = [(u, START + timedelta(days=d, hours=h)) for u, ds in days.items() for d in ds
            for h in (1, 5)]
    df = spark.createDataFrame(data, "u long, ts timestamp_ntz")
    got = {r["u"]: r["current_streak"] for r in agg.streak(df, "u", "ts").collect()}
    assert got == {1: 2, 2: 1, 3: 1}
