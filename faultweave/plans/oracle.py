"""The driver's queries in SQL: RE2 patterns as they are, plain global windows."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.enums import CATEGORIES, SEVERITIES
from ..functions.patterns import DEFAULT_PATTERNS, Pattern
from .fixture import log_lines_sql


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_q(k) if isinstance(k, str) else k} THEN {_q(v) if isinstance(v, str) else v}" for k, v in values.items()) + " END"


def classified(patterns: Sequence[Pattern] = DEFAULT_PATTERNS, prefilter: bool = True) -> str:
    tests = []
    for i, p in enumerate(patterns):
        hit = f"regexp_matches(line, {_q(p.regex)})"
        if prefilter and p.literals:
            hit = "(" + " OR ".join(f"contains(lower(line), {_q(x)})" for x in p.literals) + ") AND " + hit
        tests.append(f"WHEN {hit} THEN {i}")
    ranks = {c: i for i, c in enumerate(CATEGORIES)}
    return f"""log_lines AS ({log_lines_sql()}),
    numbered AS (SELECT *, CASE {" ".join(tests)} END AS priority FROM log_lines),
    named AS (SELECT *, {_case("priority", {i: p.name for i, p in enumerate(patterns)})} AS pattern,
        {_case("priority", {i: p.category for i, p in enumerate(patterns)})} AS category,
        {_case("priority", {i: p.severity for i, p in enumerate(patterns)})} AS severity FROM numbered),
    classified AS (SELECT *, {_case("category", ranks)} AS category_rank, {_case("severity", {s: i for i, s in enumerate(SEVERITIES)})} AS severity_rank,
        {_case("category", dict(CATEGORIES))} AS causal_weight FROM named)"""


def timed(source: str, name: str) -> str:
    """Adds ts_sec and ts_nano to a CTE. Year 0 by way of the leap year 2000."""
    return f"""{name}_t AS (SELECT *,
        try_strptime(regexp_extract(line, '^(\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d)(Z|[+-]\\d\\d:\\d\\d)? ', 1), '%Y-%m-%dT%H:%M:%S') AS t1,
        regexp_extract(line, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d([+-])\\d\\d:\\d\\d ', 1) AS sg,
        try_cast(regexp_extract(line, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d[+-](\\d\\d):\\d\\d ', 1) AS BIGINT) AS oh,
        try_cast(regexp_extract(line, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d[+-]\\d\\d:(\\d\\d) ', 1) AS BIGINT) AS om,
        try_strptime(regexp_extract(line, '^(\\d{{4}}/\\d\\d/\\d\\d \\d\\d:\\d\\d:\\d\\d) ', 1), '%Y/%m/%d %H:%M:%S') AS t2,
        try_strptime(regexp_extract(line, '^(\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d)(,\\d+)? ', 1), '%Y-%m-%d %H:%M:%S') AS t3,
        regexp_extract(line, '^\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d,(\\d+) ', 1) AS fr,
        try_strptime('2000 ' || nullif(regexp_extract(line, '^([A-Z][a-z]{{2}} \\d\\d \\d\\d:\\d\\d:\\d\\d)', 1), ''), '%Y %b %d %H:%M:%S') AS t4,
        try_strptime(regexp_extract(line, '^(\\d\\d/[A-Z][a-z]{{2}}/\\d{{4}}:\\d\\d:\\d\\d:\\d\\d)', 1), '%d/%b/%Y:%H:%M:%S') AS t5 FROM {source}),
    {name} AS (SELECT * EXCLUDE (t1, sg, oh, om, t2, t3, fr, t4, t5),
        coalesce(epoch(t1)::BIGINT - CASE WHEN sg = '' THEN 0 WHEN sg = '-' THEN -(oh * 3600 + om * 60) ELSE oh * 3600 + om * 60 END,
                 epoch(t2)::BIGINT, epoch(t3)::BIGINT, epoch(t4)::BIGINT - 63113904000, epoch(t5)::BIGINT) AS ts_sec,
        CASE WHEN coalesce(t1, t2, t3, t4, t5) IS NOT NULL THEN CASE WHEN fr <> '' THEN rpad(substr(fr, 1, 9), 9, '0')::INT ELSE 0 END END AS ts_nano FROM {name}_t)"""


def matches(patterns: Sequence[Pattern] = DEFAULT_PATTERNS, prefilter: bool = True) -> str:
    return f"{classified(patterns, prefilter)}, hits AS (SELECT * FROM classified WHERE priority IS NOT NULL), {timed('hits', 'matches')}"


_ORDER = "ts_sec IS NULL, ts_sec, ts_nano, source, line_num"


def ordered() -> str:
    lags = ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ("source", "line_num", "ts_sec", "ts_nano"))
    return f"""{matches()}, ordered AS (SELECT *, row_number() OVER w - 1 AS pos, {lags} FROM matches WINDOW w AS (ORDER BY {_ORDER})),
    gaps AS (SELECT *, CASE WHEN p_source IS NULL THEN NULL
        WHEN ts_sec IS NULL OR p_ts_sec IS NULL THEN CASE WHEN source = p_source AND line_num - p_line_num < 50 THEN 0 ELSE 5000000001 END
        WHEN ts_sec - p_ts_sec < 9000000000 THEN (ts_sec - p_ts_sec) * 1000000000 + ts_nano - p_ts_nano END AS gap_ns FROM ordered)"""


def assigned(window_s: float = 5.0) -> str:
    """CTEs up to ``assigned``: matches with ``chain_seq``."""
    cut = f"{ordered()}, cut AS (SELECT *, sum(CASE WHEN gap_ns IS NULL OR gap_ns > {int(window_s * 1e9)} THEN 1 ELSE 0 END) OVER (ORDER BY pos)::BIGINT AS chain_seq FROM gaps)"
    if window_s >= 5.0:
        return f"{cut}, assigned AS (SELECT * FROM cut)"
    return f"""{cut}, heads AS (SELECT chain_seq, arg_min(category, pos) AS category, arg_min({{'s': ts_sec, 'n': ts_nano}}, pos) AS a, arg_max({{'s': ts_sec, 'n': ts_nano}}, pos) AS z FROM cut GROUP BY 1),
    joins AS (SELECT chain_seq, CASE WHEN category = lag(category) OVER w AND (a.s - (lag(z) OVER w).s) < 9000000000
        AND (a.s - (lag(z) OVER w).s) * 1000000000 + a.n - (lag(z) OVER w).n <= 5000000000 THEN 0 ELSE 1 END AS fresh FROM heads WINDOW w AS (ORDER BY chain_seq)),
    merged AS (SELECT chain_seq, sum(fresh) OVER (ORDER BY chain_seq)::BIGINT AS merged_seq FROM joins),
    assigned AS (SELECT cut.* EXCLUDE (chain_seq), merged_seq AS chain_seq FROM cut JOIN merged USING (chain_seq))"""


def ranked(window_s: float = 5.0) -> str:
    """CTEs up to ``ranked``: chains with ids, by plain windows inside each chain."""
    severity = _case("max(severity_rank)", dict(enumerate(SEVERITIES)))
    return f"""{assigned(window_s)},
    rooted AS (SELECT *, row_number() OVER (PARTITION BY chain_seq ORDER BY causal_weight DESC, pos) = 1 AS is_root FROM assigned),
    sums AS (SELECT chain_seq, {severity} AS severity, max(severity_rank) AS severity_rank, count(*) AS size, min(pos) AS first_pos FROM rooted GROUP BY 1),
    roots AS (SELECT chain_seq, category, pos AS root_pos, source AS root_source, line_num AS root_line_num, line AS root_line, pattern AS root_pattern, ts_sec AS root_ts_sec, ts_nano AS root_ts_nano FROM rooted WHERE is_root),
    cascades AS (SELECT r.*, row_number() OVER (PARTITION BY r.chain_seq ORDER BY
        CASE WHEN root_pos = first_pos THEN r.pos END, r.ts_sec IS NULL, r.ts_sec, r.ts_nano, CASE WHEN r.ts_sec IS NULL THEN r.line_num END, CASE WHEN r.pos = first_pos THEN root_pos ELSE r.pos END) AS cascade_pos
        FROM rooted r JOIN sums USING (chain_seq) JOIN roots USING (chain_seq) WHERE NOT is_root),
    lasts AS (SELECT chain_seq, arg_max(ts_sec, cascade_pos) FILTER (ts_sec IS NOT NULL) AS s, arg_max(ts_nano, cascade_pos) FILTER (ts_sec IS NOT NULL) AS n, bool_or(ts_sec IS NULL) AS open FROM cascades GROUP BY 1),
    chains AS (SELECT s.*, r.* EXCLUDE (chain_seq), size - 1 AS cascade_size,
        CASE WHEN l.chain_seq IS NULL OR l.open OR root_ts_sec IS NULL THEN 0 ELSE trunc(((l.s - root_ts_sec) * 1000000000 + l.n - root_ts_nano) / 1000000.0)::BIGINT END AS time_span_ms
        FROM sums s JOIN roots r USING (chain_seq) LEFT JOIN lasts l USING (chain_seq)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY severity_rank DESC, coalesce(root_ts_sec, -62135596800), coalesce(root_ts_nano, 0), chain_seq) AS id FROM chains),
    members AS (SELECT k.id, a.* EXCLUDE (is_root), CASE WHEN a.is_root THEN 'root' ELSE 'cascade' END AS role, c.cascade_pos FROM rooted a JOIN ranked k USING (chain_seq) LEFT JOIN cascades c USING (pos))"""


def short_count(n: str) -> str:
    def part(unit: int, mark: str) -> str:
        return f"(({n} + {unit // 20}) // {unit // 10} // 10) || '.' || (({n} + {unit // 20}) // {unit // 10} % 10) || '{mark}'"

    return f"CASE WHEN {n} < 1000 THEN {n}::VARCHAR WHEN {n} < 1000000 THEN {part(1000, 'K')} WHEN {n} < 1000000000 THEN {part(1000000, 'M')} ELSE {part(1000000000, 'B')} END"


def cut_line(column: str, n: int) -> str:
    return f"CASE WHEN length({column}) <= {n} THEN {column} ELSE substr({column}, 1, {n - 3}) || '...' END"


def clip(column: str, n: int) -> str:
    return f"CASE WHEN length({column}) <= {n} THEN {column} ELSE substr({column}, 1, {n}) || '...' END"
