import random

import pytest
from pyspark.sql import functions as F

from faultweave.functions.enums import CATEGORIES, SEVERITIES
from faultweave.operators import chains as C
from faultweave.operators.match import match_lines
from faultweave.operators.twolevel import BUCKET, in_ranges, with_last

SAMPLE = """2024-01-15T10:30:01Z INFO Starting application
2024-01-15T10:30:02Z INFO Connected to database
2024-01-15T10:30:03Z WARN High memory usage detected
2024-01-15T10:30:04Z ERROR Out of memory: Killed process 4567 (app-worker)
2024-01-15T10:30:04Z ERROR Cannot allocate memory
2024-01-15T10:30:05Z ERROR connection refused to cache:6379
2024-01-15T10:30:06Z ERROR context deadline exceeded
2024-01-15T10:30:10Z INFO Application recovered
2024-01-15T10:30:15Z ERROR deadlock detected in transaction 12345
2024-01-15T10:30:15Z ERROR Lock wait timeout exceeded; try restarting transaction
2024-01-15T10:30:20Z INFO Shutting down gracefully
2024-01-15T10:30:21Z WARN signal: terminated""".split("\n")


def matches(spark, rows):
    """Rows (source, line_num, sec, nano, category, severity)."""
    full = [(s, n, f"{c} {n}", c.lower(), c, list(CATEGORIES).index(c), v, SEVERITIES.index(v), CATEGORIES[c], t, None if t is None else k) for s, n, t, k, c, v in rows]
    return spark.createDataFrame(full, "source string, line_num long, line string, pattern string, category string, category_rank int, severity string, severity_rank int, causal_weight int, ts_sec long, ts_nano int")


def run(spark, rows, window=5.0, bucket=1_000_000):
    assigned = C.assign_chains(matches(spark, rows), window, bucket)
    ranked = C.rank_chains(C.chain_summary(assigned), bucket)
    members = C.chain_members(assigned, ranked, window, bucket)
    chains = {r.id: (r.category, r.severity, r.size, r.time_span_ms, r.root_line_num) for r in ranked.collect()}
    return chains, {(r.source, r.line_num): (r.id, r.role, r.cascade_pos) for r in members.collect()}


def plain(rows, window=5.0):
    """The same by loops over one sorted list."""
    key = lambda r: (r[2] is None, r[2] or 0, r[3] or 0, r[0], r[1])
    rows = sorted(rows, key=key)
    ns = lambda r: r[2] * 10**9 + r[3]

    def gap(a, b):
        if a[2] is None or b[2] is None:
            return 0 if a[0] == b[0] and b[1] - a[1] < 50 else 5 * 10**9 + 1
        return ns(b) - ns(a)

    groups = []
    for r in rows:
        if groups and gap(groups[-1][-1], r) <= window * 1e9:
            groups[-1].append(r)
        else:
            groups.append([r])
    merged = []
    for g in groups:
        last = merged[-1] if merged else None
        if last and last[0][4] == g[0][4] and last[-1][2] is not None and g[0][2] is not None and ns(g[0]) - ns(last[-1]) <= 5 * 10**9:
            last.extend(g)
        else:
            merged.append(g)
    out = []
    for g in merged:
        weights = [CATEGORIES[r[4]] for r in g]
        at = weights.index(max(weights))
        root, rest = g[at], [r for i, r in enumerate(g) if i != at]
        if at:
            rest = g[1:at] + [g[0]] + g[at + 1 :]
            rest.sort(key=lambda r: (r[2] is None, r[2] or 0, r[3] or 0, r[1] if r[2] is None else 0))
        severity = max((r[5] for r in g), key=SEVERITIES.index)
        span = 0
        if rest and root[2] is not None and rest[-1][2] is not None:
            d = ns(rest[-1]) - ns(root)
            span = abs(d) // 10**6 * (1 if d >= 0 else -1)
        out.append((severity, root, rest, span, len(g)))
    order = sorted(range(len(out)), key=lambda i: (-SEVERITIES.index(out[i][0]), -62135596800 if out[i][1][2] is None else out[i][1][2], out[i][1][3] or 0, i))
    chains, members = {}, {}
    for n, i in enumerate(order, 1):
        severity, root, rest, span, size = out[i]
        chains[n] = (root[4], severity, size, span, root[1])
        members[root[:2]] = (n, "root", None)
        members |= {r[:2]: (n, "cascade", k) for k, r in enumerate(rest, 1)}
    return chains, members


def test_sample(spark):
    df = spark.createDataFrame([("sample.log", i, t) for i, t in enumerate(SAMPLE, 1)], "source string, line_num long, line string")
    found = match_lines(df)
    rows = C.assign_chains(found)
    ranked = C.rank_chains(C.chain_summary(rows))
    assert [(r.id, r.category, r.severity, r.root_line_num, r.root_pattern, r.cascade_size, r.time_span_ms) for r in ranked.orderBy("id").collect()] == [
        (1, "OOM Kill", "FATAL", 4, "oom_kill", 3, 2000),
        (2, "DB Lock", "CRITICAL", 9, "deadlock", 1, 0),
        (3, "Signal", "CRITICAL", 12, "sigterm", 0, 0),
    ]


N, O, W = "Network", "OOM Kill", "ERROR"
CASES = {
    "gap of 5 s stays, 1 ns more splits": ([("a", 1, 0, 0, N, W), ("a", 2, 5, 0, N, W), ("a", 3, 10, 1, N, W)], 5.0),
    "negative span": ([("a", 1, 1, 0, N, W), ("a", 2, 4, 0, O, W)], 5.0),
    "weight tie": ([("a", 1, 1, 0, O, W), ("a", 2, 4, 0, O, "FATAL")], 5.0),
    "equal times, root later": ([("a", 1, 1, 0, N, W), ("a", 2, 1, 0, N, W), ("a", 3, 1, 0, O, W), ("a", 4, 1, 0, N, W)], 5.0),
    "equal times, then root": ([("a", 1, 1, 0, N, W), ("a", 2, 1, 0, N, W), ("a", 3, 2, 0, N, W), ("a", 4, 2, 0, O, W)], 5.0),
    "untimed near and far": ([("a", 1, None, None, N, W), ("a", 50, None, None, O, W), ("a", 100, None, None, N, W), ("b", 1, None, None, N, W)], 5.0),
    "timed to untimed": ([("a", 90, 7, 0, N, W), ("a", 3, None, None, O, W)], 5.0),
    "merged and not": ([("a", 1, 0, 0, N, W), ("a", 2, 3, 0, N, W), ("a", 3, 6, 0, O, W)], 1.0),
    "long window": ([("a", 1, None, None, N, W), ("b", 9, None, None, O, W), ("c", 5, None, None, N, W)], 10.0),
    "rank of untimed and year 0": ([("a", 1, None, None, N, W), ("b", 1, -62165971799, 0, N, W), ("c", 1, 100, 0, N, W), ("d", 1, 200, 0, N, "FATAL")], 5.0),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows, window = CASES[name]
    assert run(spark, rows, window) == plain(rows, window)


@pytest.mark.parametrize("window", [1.0, 5.0])
def test_random_and_bucket_sizes(spark, window):
    dice = random.Random(5)
    rows = []
    for i in range(500):
        timed = dice.random() < 0.7
        rows.append((dice.choice("abc"), i, dice.randrange(1500) if timed else None, dice.choice([0, 0, 1, 999]) if timed else None, dice.choice(list(CATEGORIES)), dice.choice(SEVERITIES)))
    want = plain(rows, window)
    for bucket in (7, 1_000_000):
        assert run(spark, rows, window, bucket) == want


@pytest.mark.parametrize("window", [1.0, 10.0])
def test_all_matches_in_one_second(spark, window):
    """Ranges cut what shares a time, and what has none."""
    dice = random.Random(6)
    rows = [(dice.choice("abc"), i, 77 if i % 3 else None, 5 if i % 3 else None, dice.choice(list(CATEGORIES)), dice.choice(SEVERITIES)) for i in range(300)]
    ranges = in_ranges(matches(spark, rows), [F.col("ts_sec"), F.col("line_num")], 20)
    assert max(r["count"] for r in ranges.groupBy(BUCKET).count().collect()) <= 60
    assert run(spark, rows, window, 20) == plain(rows, window)


def test_window_must_be_positive(spark):
    with pytest.raises(ValueError):
        C.assign_chains(matches(spark, CASES["negative span"][0]), 0)


def test_no_matches(spark):
    empty = matches(spark, CASES["negative span"][0]).limit(0)
    assert C.ranked_chains(empty).count() == 0


def test_one_chain_of_nearly_all_matches(spark):
    """No join is made by chain, so a chain that holds nearly all is not gathered."""
    dice = random.Random(8)
    rows = [(dice.choice("abc"), i, 10**6 if i == 0 else i // 3, dice.choice([0, 5]), dice.choice(list(CATEGORIES)), dice.choice(SEVERITIES)) for i in range(900)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for window in (5.0, 10.0):
            assigned = C.assign_chains(matches(spark, rows), window, 50)
            ranked = C.rank_chains(C.chain_summary(assigned), 50)
            members = C.chain_members(assigned, ranked, window, 50)
            plan = members._jdf.queryExecution().executedPlan().toString()
            joins = [x for x in plan.split("\n") if "Join" in x]
            assert joins and not any("chain_seq" in x for x in joins)
            assert run(spark, rows, window, 50) == plain(rows, window)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_last_value_in_the_order_of_all(spark):
    dice = random.Random(9)
    values = [dice.choice([None, None, None, i]) for i in range(200)]
    df = spark.createDataFrame([(i, i // 9, v) for i, v in enumerate(values)], "i int, b int, v int")
    got = [r.x for r in with_last(df, ["b"], [F.col("i")], F.col("v"), "x").orderBy("i").collect()]
    want, last = [], None
    for v in values:
        last = last if v is None else v
        want.append(last)
    assert got == want


def test_pages_sort_only_their_ranges(spark):
    dice = random.Random(12)
    rows = [("a", i * 100, dice.randrange(10**6), 0, dice.choice(list(CATEGORIES)), dice.choice(SEVERITIES)) for i in range(300)]
    chains = C.chain_summary(C.assign_chains(matches(spark, rows)))
    ranked = {r.id: r.chain_seq for r in C.rank_chains(chains).collect()}
    for offset, limit, bucket in ((0, 20, 30), (95, 40, 30), (len(ranked) - 5, 20, 7), (len(ranked), 10, 30), (0, 10**6, 50), (10, 5, 10**6)):
        page = {r.id: r.chain_seq for r in C.ranked_page(chains, offset, limit, bucket).collect()}
        assert page == {i: c for i, c in ranked.items() if offset < i <= offset + limit}
