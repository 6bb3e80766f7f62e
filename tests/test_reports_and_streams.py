import json

from pyspark.sql import functions as F

from faultweave.functions.text import clip_line, format_count, truncate_line
from faultweave.operators import chains as C
from faultweave.operators.counts import counted_matches, result_summary, summary_rows
from faultweave.operators.match import match_lines, with_pattern
from faultweave.plans.report import category_breakdown, json_pieces, read_pieces, report_json, report_text, severity_breakdown, summary_report, text_pieces, write_pieces
from faultweave.sources.files import stream_logs
from faultweave.streaming.live import stream_chains, stream_counts, stream_matches

from test_chains import SAMPLE


def sample(spark):
    return spark.createDataFrame([("sample.log", i, t) for i, t in enumerate(SAMPLE, 1)], "source string, line_num long, line string")


def test_text_functions(spark):
    df = spark.createDataFrame([("x" * 12, 999), ("x" * 9, 1000), ("", 1999949), ("y", 2000000000)], "s string, n long")
    rows = df.select(truncate_line(F.col("s"), 10).alias("t"), clip_line(F.col("s"), 10).alias("c"), format_count(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("x" * 7 + "...", "x" * 10 + "...", "999"), ("x" * 9, "x" * 9, "1.0K"), ("", "", "2.0M"), ("y", "y", "2.0B")]


def test_reports(spark):
    lines = sample(spark)
    classified = with_pattern(lines)
    rows = C.assign_chains(match_lines(lines))
    ranked = C.rank_chains(C.chain_summary(rows))
    members = C.chain_members(rows, ranked)
    assert {r.name: r.n for r in category_breakdown(classified).collect()} == {"OOM Kill": 2, "Timeout": 1, "DB Lock": 2, "Signal": 1, "Network": 1}
    assert [(r.name, r.n) for r in severity_breakdown(classified).collect()] == [("FATAL", 1), ("CRITICAL", 4), ("ERROR", 2)]
    assert tuple(summary_report(classified, ranked, ["sample.log"]).first()) == ("12", "7", "3", ["sample.log"])
    doc = json.loads(report_json(classified, members, ranked, ["sample.log"]).first().json)
    assert (doc["total_lines"], doc["total_matches"], doc["by_severity"]) == (12, 7, {"CRITICAL": 4, "ERROR": 2, "FATAL": 1})
    assert [c["id"] for c in doc["chains"]] == [1, 2, 3] and [len(c.get("cascade", ())) for c in doc["chains"]] == [3, 1, 0]
    assert doc["chains"][0]["root_cause"]["timestamp"] == "2024-01-15T10:30:04Z" and "cascade" not in doc["chains"][2]
    text = {r.id: r.text for r in report_text(classified, ranked).collect()}
    assert text[1].split("\n")[0] == "Chain #1 [OOM Kill] FATAL" and text[1].endswith("Cascade: 3 errors") and "Matches found: 7" in text[0]


def test_empty_reports(spark):
    lines = sample(spark).where("line_num < 3")
    rows = C.assign_chains(match_lines(lines))
    ranked = C.rank_chains(C.chain_summary(rows))
    assert [r.text for r in report_text(with_pattern(lines), ranked).collect()] == ["No failures detected."]
    doc = json.loads(report_json(with_pattern(lines), C.chain_members(rows, ranked), ranked, []).first().json)
    assert doc["chains"] is None and doc["by_category"] == {} and doc["total_lines"] == 2


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.log").write_text("\n".join(SAMPLE[:7]) + "\n")
    (folder / "2.log").write_text("\n".join([*SAMPLE[7:], "no time: broken pipe", "2024-01-16T00:00:00Z ERROR broken pipe"]) + "\n")

    def drain(df, name):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    found = stream_matches(stream_logs(spark, str(folder)))
    assert len(drain(found.select("pattern"), "m")) == 9
    counts = drain(stream_counts(found, "1 minute", "0 seconds"), "c")
    assert sum(r.n for r in counts) == 7
    chains = sorted((r.size, r.category, r.severity) for r in drain(stream_chains(found, 5.0, "0 seconds"), "s"))
    assert chains == [(1, "Signal", "CRITICAL"), (2, "DB Lock", "CRITICAL"), (4, "OOM Kill", "FATAL")]


def test_counts_taken_while_matches_are_written(spark):
    """The same counts and reports as from a second look at the lines."""
    lines = sample(spark).repartition(3)
    found, counts = counted_matches(lines)
    assert sorted(map(tuple, summary_rows(spark, counts).collect())) == sorted(map(tuple, result_summary(with_pattern(lines)).collect()))
    assert sorted(r.line_num for r in found.collect()) == sorted(r.line_num for r in match_lines(lines).collect())
    rows = C.assign_chains(found)
    ranked = C.rank_chains(C.chain_summary(rows))
    members = C.chain_members(rows, ranked)
    assert report_json(counts, members, ranked, ["x"]).collect() == report_json(with_pattern(lines), members, ranked, ["x"]).collect()
    assert sorted(report_text(counts, ranked).collect()) == sorted(report_text(with_pattern(lines), ranked).collect())
    assert summary_report(counts, ranked, []).collect() == summary_report(with_pattern(lines), ranked, []).collect()
    empty, none = counted_matches(lines.limit(0))
    assert empty.count() == 0 and set(none.values()) == {0} and [r.n for r in summary_rows(spark, none).collect()] == [0, 0]


def test_report_as_ordered_files(spark, tmp_path):
    """All files together are the document, in any number; a chain may span files."""
    lines = sample(spark)
    found, counts = counted_matches(lines)
    rows = C.assign_chains(found)
    ranked = C.rank_chains(C.chain_summary(rows))
    members = C.chain_members(rows, ranked)
    want = json.loads(report_json(counts, members, ranked, ["sample.log"]).first().json)
    for files in (1, 7):
        path = tmp_path / f"json-{files}"
        write_pieces(json_pieces(counts, members, ranked, ["sample.log"]), str(path), files)
        assert json.loads("".join(p.read_text() for p in sorted(path.glob("part-*")))) == want
        assert len(list(path.glob("part-*.txt"))) >= min(files, 5)
        assert json.loads("".join(r.text for r in read_pieces(spark, str(path)).orderBy("line_num").collect())) == want
    write_pieces(text_pieces(counts, ranked), str(tmp_path / "text"), 3)
    assert "\n".join(r.text for r in read_pieces(spark, str(tmp_path / "text")).orderBy("line_num").collect()) == "\n".join(r.text for r in report_text(counts, ranked).orderBy("id").collect())
    none, no_counts = counted_matches(lines.where("line_num < 3"))
    rows = C.assign_chains(none)
    ranked = C.rank_chains(C.chain_summary(rows))
    write_pieces(json_pieces(no_counts, C.chain_members(rows, ranked), ranked, []), str(tmp_path / "none"), 2)
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == json.loads(report_json(no_counts, C.chain_members(rows, ranked), ranked, []).first().json)
