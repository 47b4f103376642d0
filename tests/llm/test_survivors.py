"""Survivors against a plain model."""

import math
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

from quillon.llm import survivors

DDL = "member_id long, fingerprint string, severity string, confidence double, remediation string, observed_at timestamp"
DAY0 = datetime(2030, 1, 1)


def rank(s):
    return {n: 5 - i for i, n in enumerate(survivors.SEVERITIES)}.get((s or "").lower(), 0)


def unit(c):
    return -1.0 if c is None or math.isnan(c) or not 0 <= c <= 100 else c / 100 if c > 1 else c


def advice(r):
    plain = re.sub(r"[^a-z0-9]", "", (r or "").lower())
    return r if plain and plain not in survivors.NO_ADVICE else None


def rows(n, seed, hot=0.3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        fp = "hot" if rng.random() < hot else f"g{rng.randrange(n // 4)}"
        out.append((i, fp, rng.choice(["High", "low", "CRITICAL", "?", None, "medium"]), rng.choice([None, float("nan"), 0.5, 50.0, 0.91, 7.0, 1.0, -1.0]), rng.choice(["Fix it", "n/a", None, " ", "T.B.D.", "Use TLS"]), DAY0 + timedelta(hours=rng.randrange(200)) if rng.random() < 0.95 else None))
    return out + out[: n // 10]


def best(data):
    groups = defaultdict(dict)
    for r in data:
        groups[r[1]][r[0]] = r
    want = set()
    for fp, members in groups.items():
        m = list(members.values())
        if fp is None or len(m) < 2:
            continue
        late, early = datetime(9999, 1, 1), datetime(1, 1, 1)
        want.add((fp, "primary", min(m, key=lambda r: (-rank(r[2]), -unit(r[3]), r[5] or late, advice(r[4]) is None, r[0]))[0]))
        told = [r for r in m if advice(r[4])]
        if told:
            top = max(r[5] or early for r in told)
            want.add((fp, "remediation", min((-rank(r[2]), -unit(r[3]), r[0]) for r in told if (r[5] or early) == top)[2]))
    return want


def test_best_fields(spark):
    data = [*rows(400, 1), (9_000, None, "high", 0.5, "x", DAY0), (9_001, None, "high", 0.5, "x", DAY0), (9_002, "alone", "high", 0.5, "Fix", DAY0), (9_003, "long", "high", 0.5, "y" * 200_000, DAY0), (9_004, "long", "high", 0.5, "y" * 200_000, DAY0)]
    got = {tuple(r) for r in survivors.best_fields(spark.createDataFrame(data, DDL)).collect()}
    assert got == best(data)


def layered(data):
    groups = defaultdict(dict)
    for r in data:
        if r[1] is not None:
            groups[r[1]][r[0]] = r
    out = {}
    for fp, members in groups.items():
        left = []
        for r in members.values():
            s, c, a = rank(r[2]), unit(r[3]), advice(r[4])
            day = (r[5] - datetime(1970, 1, 1)).days if r[5] else -1_000_000
            left.append((((s, c), (s > 0) + (c >= 0) + (a is not None), day), r[0], r[2].lower() if s else None, c if c >= 0 else None, a))
        order = []
        layer = 1
        while left:
            top = [x for x in left if not any(all(p >= q for p, q in zip(y[0], x[0])) and y[0] != x[0] for y in left)]
            order += sorted(top, key=lambda x: (*(-v for v in (*x[0][0], *x[0][1:])), x[1]))
            left = [x for x in left if x not in top]
            layer += 1
        first = lambda i: next((x[i] for x in order if x[i] is not None), None)  # noqa: E731, B023
        out[fp] = (order[0][1], first(2) or "unknown", first(3), first(4))
    return out


def test_survivors(spark):
    data = rows(300, 2)
    want = layered(data)
    for depth in (4, 1):
        got = {r.fingerprint: tuple(r)[1:] for r in survivors.survivors(spark.createDataFrame(data, DDL), depth).collect()}
        assert got == want


def test_advice_in_a_deep_layer(spark):
    data = [(i, "f", "high", 0.9 - i / 100, "n/a", DAY0 + timedelta(days=50 - i)) for i in range(40)] + [(99, "f", "low", 0.1, "Fix it", DAY0)]
    (r,) = survivors.survivors(spark.createDataFrame(data, DDL)).collect()
    assert (r.member_id, r.severity, r.remediation) == (0, "high", "Fix it")


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], DDL)
    assert survivors.best_fields(empty).count() == 0
    assert survivors.survivors(empty).count() == 0
    clash = spark.createDataFrame([(1, "f", "high", 0.5, "Fix", DAY0, 1, "x"), (2, "f", "low", 0.5, "-", DAY0, 1, "x")], DDL + ", d0 int, layer string")
    assert {(r.field, r.member_id) for r in survivors.best_fields(clash).collect()} == {("primary", 1), ("remediation", 1)}
