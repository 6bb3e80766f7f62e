import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from faultweave.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
@pytest.mark.parametrize("name", ["classify_first_match", "ranked_chains", "merge_chains", "chain_members", "report_json_chains", "split_document_lines", "member_page", "chain_members_long_window", "session_window_chains", "report_json_whole", "report_text_whole", "source_list", "stream_match_rows", "read_log_files", "read_log_files_limited", "dropped_long_lines", "live_matches", "live_counts", "live_chains", "live_line_numbers", "pattern_table_large", "parse_odd_timestamps", "summary_report", "chain_detail"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "orders", "customer", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_library_does_not_import_llm():
    code = "import sys, faultweave.plans.queries, faultweave.streaming.live; assert not any('llm' in m for m in sys.modules if m.startswith('faultweave'))"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__), env=os.environ)
