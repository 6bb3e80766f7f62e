"""Failure patterns: the default list, what a line must contain, and Java spellings."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from .enums import CATEGORIES, SEVERITIES


@dataclass(frozen=True)
class Pattern:
    """A rule: lines that ``regex`` (RE2 syntax) finds have the category and severity.
    ``literals``: a line must contain one of them, letter case aside, to be tried."""

    name: str
    category: str
    severity: str
    regex: str
    literals: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.category not in CATEGORIES or self.severity not in SEVERITIES:
            raise ValueError(f"{self.name}: unknown category or severity")
        try:
            n_groups(self.regex)
        except re.error as e:
            raise ValueError(f"{self.name}: {e}") from e
        if not self.literals:
            object.__setattr__(self, "literals", required_literals(self.regex))


#: One piece of a regex: an escape, a character class, or one character.
_PIECE = re.compile(r"\\(?P<escape>.)|(?P<set>\[[^\]]*\]?)|(?P<char>.)", re.DOTALL)


def _longest_run(part: str) -> str:
    """The longest stretch of plain characters outside groups; the first of equals."""
    runs, depth = [""], 0
    for piece in _PIECE.finditer(part):
        kind, value = piece.lastgroup, piece[piece.lastgroup]
        # Inside a group every character counts for its nesting, escaped or not.
        if depth:
            for c in piece[0]:
                depth += (c == "(") - (c == ")") if depth else 0
        elif kind == "escape" and value not in "sdwbSDWB":
            runs[-1] += value
        elif kind == "char" and value not in "()*+?{}.^$":
            runs[-1] += value
        else:
            runs.append("")
            depth = int(kind == "char" and value == "(")
    return max(runs, key=len)


def required_literals(regex: str) -> tuple[str, ...]:
    """Lower-case pieces of a regex of which a line must contain one. Alternatives are
    split at every bar, in groups too; those without a piece of 3 bytes ask for nothing.
    """
    for head in ("(?i)", r"(?:^|\s)", "^"):
        regex = regex.removeprefix(head)
    runs = [_longest_run(part) for part in regex.removesuffix("$").split("|")]
    return tuple(r.lower() for r in runs if len(r.encode()) >= 3)


#: RE2 spellings that mean something else in Java, and their Java form.
_JAVA = {r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]", r"\b": r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))", "$": r"\z"}


def java_form(regex: str) -> str:
    """The same regex for Java: ASCII white space and word edges, a dot that stops at a
    newline only, an end that is the end."""
    folded = regex.startswith("(?i)")
    out, inside = [], False
    for piece in re.finditer(r"\\.|.", regex.removeprefix("(?i)"), re.DOTALL):
        x = piece[0]
        if inside:
            inside = x != "]"
            out.append(r"\t\n\f\r " if x == r"\s" else x)
        else:
            inside = x == "["
            out.append(_JAVA.get(x, x))
    return ("(?iud)" if folded else "(?d)") + "".join(out)


#: Plain characters, of which only their being there counts; what is kept; and what may
#: give those behind it another meaning, so that the whole regex is read.
_SHAPE = re.compile(r"[0-9A-Za-z #_]+|(?P<kept>\\[sdwbSDWB\W]|\[\^?[^]\\^][^]\\]*\]|\{[^}]*\}|\(\?:)|(?P<odd>\\|\[|\(\?|\0)")


def _python_groups(regex: str) -> int:
    return re.compile(java_form(regex).replace("(?iud)", "(?i)").replace("(?d)", "").replace(r"\z", r"\Z")).groups


_groups_of_shape = functools.lru_cache(4096)(_python_groups)


def n_groups(regex: str) -> int:
    """The number of groups; an error if the regex is not valid. Long tables have many
    regexes that differ in plain characters only: these are read once."""
    body = regex.removeprefix("(?i)")
    shape = _SHAPE.sub(lambda m: m["kept"] or ("\0" if m["odd"] else "x"), body)
    if "\0" in shape:
        return _python_groups(regex)
    try:
        return _groups_of_shape(shape if body is regex else "(?i)" + shape)
    except re.error:
        return _python_groups(regex)  # with its own message


def _patterns(rows: Sequence[tuple[str, str, str, str]]) -> tuple[Pattern, ...]:
    return tuple(Pattern(*row) for row in rows)


#: Name, category, severity and regex, first match first.
DEFAULT_PATTERNS: tuple[Pattern, ...] = _patterns(
    [
        ("oom_kill", "OOM Kill", "FATAL", r"(?i)out of memory:?\s*kill"),
        ("oom_killed", "OOM Kill", "FATAL", r"(?i)oom[-_]?kill"),
        ("oom_alloc", "OOM Kill", "CRITICAL", r"(?i)cannot allocate memory"),
        ("oom_cgroup", "OOM Kill", "FATAL", r"(?i)memory cgroup out of memory"),
        ("oom_java_heap", "OOM Kill", "FATAL", r"java\.lang\.OutOfMemoryError"),
        ("ctx_deadline", "Timeout", "ERROR", r"context deadline exceeded"),
        ("io_timeout", "Timeout", "ERROR", r"i/o timeout"),
        ("conn_timeout", "Timeout", "ERROR", r"(?i)connection timed? ?out"),
        ("req_timeout", "Timeout", "ERROR", r"(?i)request timed? ?out"),
        ("read_timeout", "Timeout", "ERROR", r"read tcp.*timeout"),
        ("ctx_canceled", "Timeout", "WARN", r"context canceled"),
        ("deadlock", "DB Lock", "CRITICAL", r"(?i)deadlock detected"),
        ("lock_wait", "DB Lock", "CRITICAL", r"(?i)lock wait timeout exceeded"),
        ("obtain_lock", "DB Lock", "ERROR", r"(?i)could not obtain lock"),
        ("db_locked", "DB Lock", "ERROR", r"(?i)database is locked"),
        ("row_lock", "DB Lock", "ERROR", r"(?i)lock on.*row"),
        ("go_panic", "Panic", "FATAL", r"(?:^|\s)panic:"),
        ("go_goroutine", "Panic", "CRITICAL", r"(?:^|\s)goroutine \d+ \["),
        ("go_fatal", "Panic", "FATAL", r"(?:^|\s)fatal error:"),
        ("java_exception", "Panic", "ERROR", r"(?i)exception in thread"),
        ("java_stacktrace", "Panic", "ERROR", r"^\s+at [a-zA-Z0-9_.]+\(.*:\d+\)"),
        ("python_traceback", "Panic", "ERROR", r"Traceback \(most recent call last\)"),
        ("python_error", "Panic", "ERROR", r"^\w+Error:"),
        ("node_unhandled", "Panic", "FATAL", r"(?i)unhandled(?:Promise)?Rejection"),
        ("rust_panic", "Panic", "FATAL", r"thread '.*' panicked at"),
        ("sigkill", "Signal", "FATAL", r"(?i)signal:\s*killed|SIGKILL"),
        ("sigterm", "Signal", "CRITICAL", r"(?i)signal:\s*terminated|SIGTERM"),
        ("sigsegv", "Signal", "FATAL", r"(?i)signal:\s*segmentation fault|SIGSEGV"),
        ("core_dump", "Signal", "FATAL", r"(?i)core dumped"),
        ("sigabrt", "Signal", "FATAL", r"SIGABRT|signal:\s*aborted"),
        ("no_space", "Disk I/O", "CRITICAL", r"(?i)no space left on device"),
        ("io_error", "Disk I/O", "CRITICAL", r"(?i)input/output error"),
        ("readonly_fs", "Disk I/O", "CRITICAL", r"(?i)read-only file system"),
        ("disk_quota", "Disk I/O", "ERROR", r"(?i)disk quota exceeded"),
        ("eio", "Disk I/O", "CRITICAL", r"\bEIO\b"),
        ("too_many_files", "Disk I/O", "ERROR", r"(?i)too many open files"),
        ("conn_refused", "Network", "ERROR", r"(?i)connection refused"),
        ("no_host", "Network", "ERROR", r"(?i)no such host"),
        ("dns_nxdomain", "Network", "ERROR", r"(?i)dns.*nxdomain"),
        ("conn_reset", "Network", "ERROR", r"(?i)connection reset by peer"),
        ("broken_pipe", "Network", "ERROR", r"(?i)broken pipe"),
        ("net_unreachable", "Network", "ERROR", r"(?i)network is unreachable"),
        ("host_unreachable", "Network", "ERROR", r"(?i)no route to host"),
    ]
)
