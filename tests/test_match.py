import re

import pytest

from faultweave.functions.patterns import DEFAULT_PATTERNS, Pattern, java_form, n_groups, required_literals
from faultweave.operators.match import filter_failures, match_lines, match_lines_table, patterns_table, with_pattern
from faultweave.plans.fixture import ODD_RULES

TRUTH = [
    ("Out of memory: Killed process 42 (java)", "oom_kill"), ("memory cgroup out of memory: Kill process 42", "oom_kill"), ("memory cgroup out of memory", "oom_cgroup"),
    ("out of memory kill 5", None), ("OOMKilled container a in pod b", "oom_killed"), ("oom_kill", "oom_killed"), ("oom kill", None),
    ("java.lang.OutOfMemoryError: Java heap space", "oom_java_heap"), ("java.lang.outofmemoryerror", None),
    ("connection timed out to a:1", "conn_timeout"), ("CONNECTION TIMEDOUT", "conn_timeout"), ("connection timeout", None), ("connection time out", None),
    ("request timed out", "req_timeout"), ("request timeout", None), ("read tcp a->b: i/o timeout", "io_timeout"), ("read tcp a->b: timeout", "read_timeout"),
    ("context canceled i/o timeout", "io_timeout"), ("HTTP timeout", None), ('could not obtain lock on row in relation "x"', "obtain_lock"), ("lock on row (id=1)", "row_lock"),
    ("fatal error: x", "go_fatal"), ("nonfatal error: x", None), ("\tat a.b.C(D.java:12)", "java_stacktrace"), ("2024-01-15T10:30:01Z ERROR \tat a.b.C(D.java:12)", None),
    ("KeyError: x", "python_error"), ("2024-01-15T10:30:01Z ERROR KeyError: x", None), ('  File "/app/main.py", line 42, in <module>', None),
    ("unhandledPromiseRejection", "node_unhandled"), ("unhandled rejection", None), ("signal: aborted", "sigabrt"), ("Signal: Aborted", None),
    ("SIGTERM: shutting down", "sigterm"), ("x EIO y", "eio"), ("EIOx", None), ("éEIOé", "eio"), ("DNS lookup failed: NXDOMAIN for a", "dns_nxdomain"), ("dns \r nxdomain", "dns_nxdomain"),
    ("panic: x", "go_panic"), ("a\x0bpanic: x", None), ("", None), (None, None),
]


def lines(spark, texts):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts, 1)], "source string, line_num long, line string")


def test_truth_table(spark):
    got = {r.line_num: r.pattern for r in with_pattern(lines(spark, [t for t, _ in TRUTH])).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(TRUTH, 1)] == TRUTH


def test_without_prefilter(spark):
    texts = ["out of memory kill 5", "connection timeout", "connection time out", "request timeout"]
    rows = with_pattern(lines(spark, texts), literal_prefilter=False).orderBy("line_num").collect()
    assert [r.pattern for r in rows] == ["oom_kill", "conn_timeout", "conn_timeout", "req_timeout"]


def test_literals():
    assert len(DEFAULT_PATTERNS) == 43
    assert required_literals("(abc|def)xyz") == ("def",)
    assert required_literals("ab|longer") == ("longer",)
    assert required_literals(r"(?i)^Start\.end$") == ("start.end",)
    assert required_literals(r"\d+") == ()
    assert required_literals(r"[abc]def(ghijkl)mn") == ("def",)
    assert java_form(r"[\s]\s$") == r"(?d)[\t\n\f\r ][\t\n\f\r ]\z"


def test_invalid_pattern():
    with pytest.raises(ValueError):
        Pattern("x", "Panic", "FATAL", "(")
    with pytest.raises(ValueError):
        Pattern("x", "Nothing", "FATAL", "x")


def test_captures_and_table(spark):
    own = [Pattern("a", "Panic", "FATAL", r"code (\d+)( fatal)?"), Pattern("b", "Network", "WARN", "code")]
    df = lines(spark, ["code 12", "code 7 fatal", "code x", "none"])
    rows = {r.line_num: r for r in match_lines(df, own).collect()}
    assert rows[1].submatch == ["12", ""] and rows[2].submatch == ["7", " fatal"] and rows[3].submatch is None and 4 not in rows
    table = match_lines_table(df, patterns_table(spark, own)).collect()
    assert sorted((r.line_num, r.pattern) for r in table) == [(1, "a"), (2, "a"), (3, "b")]
    assert filter_failures(df, own).columns == df.columns


def test_groups_of_like_regexes():
    """Read by their shape, regexes have the groups and errors that they have by themselves."""
    odd = (r"[z-a]", r"[a\]z-b]", r"[]z-b]", r"a{2}{3}", r"a{2,1}", r"\x41(b)", r"(a)\1", "a)b", "(a", "a**", "(?P<x1>a)", "(?i)(a(b))c", "a{3", "[^]a]", r"\q", r"a\.b(c)[(](d)")
    for regex in (*odd, *[p.regex for p in DEFAULT_PATTERNS], *ODD_RULES):
        try:
            want = re.compile(regex.replace("(?:^|\\s)", "").removeprefix("(?i)")).groups
        except re.error:
            with pytest.raises(re.error):
                n_groups(regex)
        else:
            assert n_groups(regex) == want
