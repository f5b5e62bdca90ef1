import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from prumo.operators import pacing as E
from prumo.operators.grouping import number_rows, previous_rows, running_max
from prumo.operators.intake import replay_questions

SECOND = 1_000_000


def window(rows, most, w):
    held, out = defaultdict(deque), {}
    for t, i, k in sorted(rows):
        d = held[k]
        while d and t - d[0] > w:
            d.popleft()
        out[i] = len(d) < most
        if out[i]:
            d.append(t)
    return out


def test_admission_across_pieces_and_runs(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4000) * SECOND, i, rng.choice("aaaab")) for i in range(1500)]
    rows += [(t * SECOND, 10_000 + t, "exact") for t in (0, 1, 600, 601, 602, 1201)]
    df = spark.createDataFrame(rows, "t long, id int, k string")
    got = {r.id: r.admitted for r in E.admit(df, "k", "t", "id", 3, 600, piece=16, run=8).collect()}
    assert got == window(rows, 3, 600 * SECOND)


def test_even_pacing_has_no_debt_after_idling(spark):
    at = [0, 0, 0, 0, 60, 61, 300]
    df = spark.createDataFrame([(a * SECOND, i, "k") for i, a in enumerate(at)], "t long, id int, k string")
    got = [r.start_us // SECOND for r in E.pace(df, "k", "t", "id", 3 * SECOND).orderBy("id").collect()]
    assert got == [0, 3, 6, 9, 60, 63, 300]


def brute_replay(rows, cap, most, w):
    held, stored, per_day, out = defaultdict(list), set(), defaultdict(int), {}
    for i, t, client, tender, text, history, fails in sorted(rows, key=lambda r: (r[1], r[0])):
        day = t // E.SECOND // 86400
        if not history and (tender, text) in stored:
            out[i] = "cached"
            continue
        if per_day[day] >= cap:
            out[i] = "daily cap"
            continue
        held[client] = [h for h in held[client] if t - h <= w]
        if len(held[client]) >= most:
            out[i] = "client window"
            continue
        held[client].append(t)
        if fails:
            out[i] = "failed"
            continue
        out[i] = "answered"
        per_day[day] += 1
        if not history:
            stored.add((tender, text))
    return out


def test_question_log_replay(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        day = rng.randrange(3)
        second = rng.choice((rng.randrange(86400), 86400 - rng.randrange(900), rng.randrange(900)))
        client = "hot" if rng.random() < 0.35 else f"c{rng.randrange(6)}"
        rows.append((i, (day * 86400 + second) * SECOND + i, client, rng.randrange(4), f"q{rng.randrange(60)}",
                     rng.random() < 0.3, rng.random() < 0.2))
    df = spark.createDataFrame(rows, "id int, at_us long, client string, tender_id int, normalized string, with_history boolean, fails boolean")
    for cap, most, head, days in ((12, 2, 1000, 9), (12, 2, 7, 9), (30, 2, 60, 1), (5000, 3, 20, 2), (5000, 3, 1000, 9), (0, 1, 7, 9)):
        want = brute_replay(rows, cap, most, 1200 * SECOND)
        got = {r.id: r.outcome for r in replay_questions(df, cap, most, 1200, head, days).collect()}
        assert got == want, (cap, most, head, days)
        assert len(set(want.values())) >= (4 if cap else 1)


def test_question_log_edges(spark):
    schema = "id int, at_us long, client string, tender_id int, normalized string, with_history boolean, fails boolean, day string, outcome_ int"
    assert replay_questions(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 10, None, 1, "q", False, False), (2, 11, None, 1, "q", None, None), (3, 12, "a", None, "q", False, False),
            (4, 13, "b", None, "q", False, None), (5, 14, "b", 2, None, False, False), (6, 400 * 86400 * SECOND, None, 1, "q", False, False),
            (7, 400 * 86400 * SECOND, None, 1, "q", True, False)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    for head in (1, 100):
        out = replay_questions(df, 40, 1, 600, head, 30)
        assert out.columns == [*df.columns, "outcome"]
        got = {r.id: r.outcome for r in out.collect()}
        assert got == {1: "answered", 2: "cached", 3: "answered", 4: "answered", 5: "client window", 6: "cached", 7: "answered"}


def test_replay_work_grows_with_the_log(spark, monkeypatch):
    """Ten times the days take as many folds, and each row of the log enters one fold at most."""
    from prumo.operators import intake

    seen, heads = [], intake._heads
    monkeypatch.setattr(intake, "_heads", lambda log, decided, *rest: (seen.append(rest), heads(log, decided, *rest))[1])
    for days in (30, 300):
        rows = [(d * 40 + k, d * intake.DAY_US + k * SECOND, k % 5, k % 3, f"q{d} {k % 11}", False, False) for d in range(days) for k in range(40)]
        df = spark.createDataFrame(rows, "id int, at_us long, client int, tender_id int, normalized string, with_history boolean, fails boolean")
        seen.clear()
        got = {r.id: r.outcome for r in replay_questions(df, 8, 3, 3600).collect()}
        assert got == brute_replay(rows, 8, 3, 3600 * SECOND) and len(seen) == 1


def test_blocks_do_not_change_windows(spark):
    df = spark.createDataFrame([(k, i * 3, (i * 37) % 101) for k in "ab" for i in range(200)], "k string, t int, v int")
    numbered = number_rows(df, ["k"], [F.col("t").asc()], "n")
    assert sorted(r.n for r in numbered.where("k = 'a'").collect()) == list(range(1, 201))
    last = previous_rows(numbered, ["k"], "n", F.col("v"), 6, "h", block=16)
    best = running_max(numbered, ["k"], "n", F.col("v"), "m", block=16)
    values = [(i * 37) % 101 for i in range(200)]
    for r in last.collect():
        assert r.h == values[max(0, r.n - 7) : r.n - 1]
    for r in best.collect():
        assert r.m == max(values[: r.n])


def test_numbering_splits_a_hot_key_and_keeps_null_keys(spark):
    rows = [(None, i, 7) for i in range(30)] + [("hot", i, 7) for i in range(3000)] + [("b", i, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, id int, score int").repartition(4)
    out = number_rows(df, ["k"], [F.col("score").desc(), F.col("id").asc()], "n").collect()
    assert len(out) == len(rows)
    assert all(r.n == r.id + 1 for r in out if r.k != "b")
    assert sorted(r.n for r in out if r.k == "b") == list(range(1, 21))
    assert [r.id for r in sorted((r for r in out if r.k == "b"), key=lambda r: r.n)][:3] == [1, 3, 5]


def test_daily_cap_and_sweep_plan(spark):
    df = spark.createDataFrame([(i, f"2026-10-0{1 + i // 5} 0{i % 5}:00:00") for i in range(10)], "id int, t string").withColumn("t", F.col("t").cast("timestamp"))
    df = df.unionByName(spark.createDataFrame([(99, None)], "id int, t timestamp"))
    for cap, admitted in ((2, {0, 1, 5, 6}), (0, set()), (5000, set(range(10)))):
        rows = E.daily_cap(df, "t", "id", cap).collect()
        assert len(rows) == 11 and {r.id for r in rows if r.admitted} == admitted
    sweeps = spark.createDataFrame([("2026-10-01", 6, 3, True), ("2026-10-02", 6, 2, False), ("2026-10-04", 6, 9, False)],
                                   "day string, modality_id int, last_page int, closed boolean").withColumn("day", F.to_date("day"))
    plan = E.sweep_plan(sweeps, F.to_date(F.lit("2026-10-05")), 5, spark.createDataFrame([(6,)], "modality_id int"))
    assert {(str(r.day), r.next_page) for r in plan.collect()} == {("2026-10-02", 3), ("2026-10-03", 1), ("2026-10-04", 1), ("2026-10-05", 1)}


def test_no_client_is_a_client(spark):
    rows = [(i, None if i % 3 else f"c{i % 2}", i * 40 * SECOND) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, client string, at_us long")
    out = E.admit(df, "client", "at_us", "id", 3, 600, piece=8, run=2)
    held, want = {}, {}
    for i, client, at in rows:
        mine = [h for h in held.get(client, []) if at - h <= 600 * SECOND]
        want[i] = len(mine) < 3
        held[client] = [*mine, at] if want[i] else mine
    assert set(out.columns) == {"id", "client", "at_us", "admitted"}
    assert {r.id: r.admitted for r in out.collect()} == want
