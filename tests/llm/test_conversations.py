import datetime
import random

from pyspark.sql import functions as F

from tesselog.llm import conversations as C

SCHEMA = "message_id bigint, session_id string, role string, content string, ts string, received_at timestamp, conv string, speaker string, sid int"
T0 = datetime.datetime(2025, 1, 1)


def frame(spark, rows):
    """rows: (message_id, session_id, role, content, ts[, seconds after which it was received])."""
    return spark.createDataFrame([(*r[:5], T0 + datetime.timedelta(seconds=r[5] if len(r) > 5 else 0), "x", "y", 0) for r in rows], SCHEMA)


def kept(df, **k):
    return sorted((r.session_id, r.turn_no, r.message_id) for r in C.conversations(df, **k).collect())


def talk(sid, first, *turns):
    return [(first + i, sid, role, text, str(1_000_000 + i)) for i, (role, text) in enumerate(turns)]


GOOD = [("user", "q"), ("assistant", "a")]


CASES = [
    (GOOD, True),
    ([("system", "s"), *GOOD], True),
    ([("user", ""), ("assistant", "a"), ("user", "q"), ("bot", "b")], True),
    ([("user", "​"), ("assistant", "a")], False),
    ([("user", None), ("assistant", "a")], False),
    ([("assistant", "a"), *GOOD], False),
    ([("tool", "a"), *GOOD], False),
    ([("user", "q")], False),
    ([("user", "q"), ("user", "q2"), ("assistant", "a")], False),
    ([("user", "q"), ("assistant", " 　 ")], False),
    ([("user", "q"), ("assistant", ""), ("tool", "x"), ("assistant", "a")], True),
    ([("user", "q"), ("??", "x"), ("assistant", "a")], False),
    ([("user", "q"), (None, "x"), ("assistant", "a")], False),
    ([("system", "s")], False),
    ([*GOOD, ("user", "q")], False),
]


def test_which_are_kept(spark):
    rows = [r for n, (turns, _) in enumerate(CASES) for r in talk(f"s{n}", 100 * n + 1, *turns)]
    got = kept(frame(spark, rows))
    assert got == sorted((f"s{n}", i + 1, 100 * n + 1 + i) for n, (turns, ok) in enumerate(CASES) if ok for i in range(len(turns)))


def test_spellings_times_and_versions(spark):
    rows = [
        (1, " {ABC}\n", " Human\t", "q", "2025-01-01T01:00:00+01:00", 5),
        (2, "abc", "AI", "a", "2025-01-01 00:00:00.000", 5),
        (3, "AbC", "USER", "q", "1735689600001", 5),
        (4, "abc", "Model ", "a", "2025-01-01T00:00:00.002Z", 5),
        (4, "abc", "user", "older", "2025-01-01T00:00:00Z", 1),
        (4, "abc", "Model ", "a", "2025-01-01T00:00:00.002Z", 5),
        (5, None, "user", "lost", "1", 0),
        (6, " {} ", "user", "lost", "1", 0),
        (None, "abc", "user", "lost", "1", 0),
        (7, "bad", "user", "q", "0000-00-00T00:00:00Z", 0),
        (8, "bad", "assistant", "a", "1", 0),
    ]
    assert kept(frame(spark, rows)) == [("abc", 1, 1), ("abc", 2, 2), ("abc", 3, 3), ("abc", 4, 4)]


def test_empty(spark):
    assert kept(frame(spark, [])) == []


def by_hand(rows):
    best, conv, out = {}, {}, []
    for r in rows:
        best[r[0]] = r
    for r in best.values():
        conv.setdefault(r[1], []).append(r)
    for sid, rs in conv.items():
        rs.sort(key=lambda r: (int(r[4]), r[0]))
        first = [r for r in rs if r[2] != "system"]
        waiting = bad = False
        for r in rs:
            if r[2] == "user":
                bad, waiting = bad or waiting, True
            elif r[2] == "assistant" and r[3]:
                waiting = False
        if first and first[0][2] == "user" and any(r[2] == "user" and r[3] for r in rs) and not bad and not waiting:
            out += [(sid, i + 1, r[0]) for i, r in enumerate(rs)]
    return sorted(out)


def test_buckets_of_hot_conversations(spark):
    rng, rows, n = random.Random(1), [], 0
    for s in range(12):
        for _ in range(rng.randint(5, 60)):
            n += 2
            t = rng.randint(0, 30)
            rows += [(n, f"s{s}", "user", "q", str(2 * t)), (n + 1, f"s{s}", rng.choice(["assistant"] * 30 + ["tool"]), "a", str(2 * t))]
    # pairs at one time are told apart by their ids, so each user row is answered unless the answer became a tool row
    want = by_hand(rows)
    assert want
    assert kept(frame(spark, rows), bucket_rows=7) == kept(frame(spark, rows)) == want


def union(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5300)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame([*edges, *edges[:5], (7, 7), (None, 3)], "a bigint, b bigint")
    assert {r.node: r.root for r in C.components(df).collect()} == union(edges)
    assert C.components(df.limit(0)).count() == 0


def test_links_stand_in_for_identifiers(spark):
    rows = frame(spark, [(1, "s", "user", "q", "1"), (2, None, "assistant", "a", "2"), (3, None, "user", "q", "3"), (4, None, "assistant", "a", "4"), (10, None, "user", "q", "1"), (11, None, "assistant", "a", "2"), (20, None, "user", "q", "1")])
    linked = rows.withColumn("reply_to", F.expr("CASE message_id WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 11 THEN '10' WHEN 20 THEN 'none' END")).withColumn("quote_of", F.expr("CASE message_id WHEN 4 THEN 3 WHEN 3 THEN 777 END"))
    assert kept(linked) == [("s", 1, 1), ("s", 2, 2), ("s", 3, 3), ("s", 4, 4), ("thread-10", 1, 10), ("thread-10", 2, 11)]
