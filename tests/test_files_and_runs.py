import json
import statistics as st
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.functions import runs as fn
from graphloom.operators import runs
from graphloom.sources import edge_files, run_files


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "pos long, value string")


def test_mtx_reading(spark):
    graph = edge_files.graph_from_mtx(lines(spark, "%%MatrixMarket\n% note\n\n3 4 2\n1 2\n4, 3 , 2.5"))
    assert graph.vertices.count() == 4
    assert {tuple(r) for r in graph.edges.collect()} == {(0, 1), (3, 2)}
    assert {tuple(r) for r in edge_files.graph_from_mtx(lines(spark, "3 3 1\n1 2"), base=0).edges.collect()} == {(1, 2)}
    for bad in ("3 3 2\n0 1", "2 2 1\n0 5", "% nothing"):
        with pytest.raises(ValueError):
            edge_files.graph_from_mtx(lines(spark, bad))


def test_mtx_round_trip(spark, tmp_path):
    graph = edge_files.graph_from_mtx(lines(spark, "3 3 2\n0 1\n2 0"))
    text = edge_files.mtx_lines(graph).orderBy("pos").select("value")
    text.coalesce(1).write.text(f"file://{tmp_path}/g")
    again = edge_files.graph_from_mtx(edge_files.read_lines(spark, f"file://{tmp_path}/g"), base=0)
    assert {tuple(r) for r in again.edges.collect()} == {(0, 1), (2, 0)}


def test_edge_list_and_compaction(spark):
    got = edge_files.edge_list_parse(lines(spark, "# c\n% c\n// c\n\n9 5 x\na 5, 9\n7\n5 5\n-1 5\n3\t9"))
    assert [(r["src"], r["dst"]) for r in got.orderBy("pos").collect()] == [(9, 5), (5, 9), (5, 5), (-1, 5), (3, 9)]
    assert {tuple(r) for r in edge_files.compact_ids(got).collect()} == {(9, 0), (5, 1), (3, 2)}
    assert sorted(map(tuple, edge_files.compact_edges(got).collect())) == [(0, 1), (1, 0), (2, 0)]


def test_result_file(spark, tmp_path):
    edge_files.write_values(spark.createDataFrame([(1, 0.5), (0, 0.25)], "id long, value double"), f"file://{tmp_path}/r", decimals=6)
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/r").collect()] == ["0.250000", "0.500000"]


def test_parse_pairs(spark):
    rows = spark.createDataFrame([("T a=1 b=2.5",), ("T a=1 a=2",), ("T a=x",), ("T a=inf",), ("T a",)], "v string").select(fn.parse_pairs(F.col("v")).alias("m")).collect()
    assert [r["m"] for r in rows] == [{"a": 1.0, "b": 2.5}, None, None, None, None]


def test_stats_of_few_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 4.0), ("b", 9.0), ("c", None)], "k string, x double").groupBy("k").agg(*fn.stats(F.col("x"), "x")).collect()
    got = {r["k"]: r.asDict() for r in rows}
    assert got["a"]["x_std"] == 0.0 and got["c"]["x_n"] == 0 and got["c"]["x_std"] is None
    assert got["b"]["x_std"] == pytest.approx(st.stdev([1, 4, 9])) and got["b"]["x_p25"] == 2.5


@pytest.mark.parametrize("seconds,text", [(5, "00:00:05"), (3600, "01:00:00"), (87000, "1-00:10:00")])
def test_duration(spark, seconds, text):
    assert spark.range(1).select(fn.duration(F.lit(seconds))).first()[0] == text


def test_pairs(spark):
    items = runs.work_items(spark, ["bfs"], ["d"], 3, 0)
    base = {"algorithm": "bfs", "dataset": "d", "phase": "measure", "gpu_mode": "1gpu", "status": "success", "iterations": 5, "rank_mean_ms": 8.0, "hostname": "h", "mpi_ranks": 1} | {name: "" for name in runs.ENVIRONMENT if name not in ("hostname", "mpi_ranks")}
    rows = [
        base | {"repeat": 1, "method": "basic", "rank_max_ms": 10.0}, base | {"repeat": 1, "method": "tolerance_queue", "rank_max_ms": 12.0, "hostname": " h"},
        base | {"repeat": 2, "method": "basic", "rank_max_ms": 10.0}, base | {"repeat": 2, "method": "tolerance_queue", "rank_max_ms": 12.0, "iterations": 6},
        base | {"repeat": 3, "method": "basic", "rank_max_ms": 10.0, "status": "timeout"},
    ]
    obs = spark.createDataFrame([r | {"record_id": "x"} for r in rows])
    got = {r["pair_id"]: r for r in runs.pair_samples(runs.expected_pairs(items, 3), obs).collect()}
    assert got["bfs|d|r001|1gpu"]["pair_status"] == "eligible" and got["bfs|d|r001|1gpu"]["total_overhead_pct"] == pytest.approx(20)
    assert got["bfs|d|r002|1gpu"]["pair_status"] == "iteration_mismatch"
    assert got["bfs|d|r003|1gpu"]["exclusion_reason"] == "baseline_timeout;missing"
    assert got["bfs|d|r001|multigpu"]["exclusion_reason"] == "missing;missing"


def test_scale_groups(spark):
    rows = [("a", f"d{i}", s) for i, s in enumerate([1.0, 2.0, 7.9, 8.1, 70.0, None])] + [("b", f"e{i}", 1.0) for i in range(9)]
    got = {r["dataset"]: r["group_no"] for r in runs.scale_groups(spark.createDataFrame(rows, "algorithm string, dataset string, scale double")).collect()}
    assert [got[f"d{i}"] for i in range(6)] == [0, 0, 0, 1, 2, 2]
    assert sorted(got[f"e{i}"] for i in range(9)) == [0] * 8 + [1]


def test_entry_imports_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['graphloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bfs_levels' in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_scale_groups_skip_what_has_no_scale(spark):
    summary = spark.createDataFrame([("a", "d", "multigpu", 3.0), ("a", "d", "basic", 0.0), ("a", "d", "multigpu_basic", 2.0), ("a", "e", "basic", None)], "algorithm string, dataset string, method string, total_ms_median double")
    assert {(r["dataset"], r["scale"]) for r in runs.runtime_scales(summary).collect()} == {("d", 2.0), ("e", None)}


def test_attempt_files(spark, tmp_path):
    items = runs.work_items(spark, ["bfs"], ["d"], 1, 0)
    expected = runs.expected_identities(items, 1, 0)
    good = {
        "schema_version": "6", "record_type": "benchmark_attempt", "attempt_id": "1", "record_id": "bfs.d.measure.r001.basic", "work_id": "bfs.d", "phase": "measure", "status": "success",
        "identity": {"algorithm": "bfs", "dataset": "d", "method": "basic", "repeat": 1, "gpu_mode": "1gpu", "mpi_ranks": 1}, "process": {"process_returncode": 0}, "emitted": {"iterations": 3},
        "timing": {"rank_max_ms": {"main_loop_ms": 1.0}, "rank_mean_ms": {"main_loop_ms": 1.0}}, "provenance": {"execution_input_guard": {"before": {"status": "match"}, "after": {"status": "match"}}},
    }
    (tmp_path / "deep").mkdir()
    for name, text in (("good", json.dumps(good, indent=1)), ("deep/late", json.dumps(good | {"phase": "warmup"})), ("broken", json.dumps(good)[:50]), ("list", "[1]"), ("empty", "")):
        (tmp_path / f"{name}.json").write_text(text)
    valid, invalid = run_files.collect_attempts(spark, str(tmp_path), expected)
    assert [r["record_id"] for r in valid.collect()] == ["bfs.d.measure.r001.basic"]
    assert {(r["record_path"].rsplit("/", 1)[1], r["phase"], r["reason"]) for r in invalid.collect()} == {("late.json", "measure", "phase differs"), ("broken.json", "", "not a JSON object"), ("list.json", "", "not a JSON object")} | (
        {("empty.json", "", "not a JSON object")} if run_files.scan_attempts(spark, str(tmp_path)).count() == 5 else set()
    )


def test_metadata_and_fingerprints(spark, tmp_path):
    import hashlib

    head = "dataset,nodes,edges,file_size_bytes,bfs_source\n"
    path = tmp_path / "m.csv"
    path.write_text(head + " a ,1,2,3,0\nb,1,2,3,0\n")
    assert {r["dataset"] for r in run_files.read_metadata(spark, str(path)).collect()} == {"a", "b"}
    for text in ("dataset,nodes\na,1\n", head + "a,1,2,3,0\na ,1,2,3,0\n", head + " ,1,2,3,0\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            run_files.read_metadata(spark, str(path))
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.mtx").write_text("1 1 0")
    (tmp_path / "g" / "y.txt").write_text("long enough")
    got = {r["path"].rsplit("/", 1)[1]: (r["size_bytes"], r["digest"]) for r in run_files.fingerprints(spark, str(tmp_path / "g")).collect()}
    assert got == {"x.mtx": (5, hashlib.sha256(b"1 1 0").hexdigest()), "y.txt": (11, hashlib.sha256(b"long enough").hexdigest())}
    assert [r["dataset"] for r in run_files.discover_datasets(spark, str(tmp_path / "g")).collect()] == ["x"]
    assert run_files.best_candidate(run_files.list_files(spark, str(tmp_path / "g"))).first()["kind"] == "mtx"
    run_files.write_table(spark.range(3), str(tmp_path / "t"), "\t")
    assert spark.read.csv(str(tmp_path / "t"), header=True, sep="\t").count() == 3
    assert run_files.markdown_rows(spark.createDataFrame([("a|b", None)], "x string, y string")).first()[0] == "| a\\|b |  |"
    assert run_files.environment(spark).first()["spark"] == spark.version


def test_config():
    good = {"datasets": ["d"], "algorithms": ["bfs"], "methods": ["basic", "tolerance_queue"], "repeat": 1, "warmup": 0, "timeout_s": 1, "mpi_ranks": 2, "parameters": {"k": 5, "alpha": 0.5, "beta": 0.5, "threshold": 0.3}, "launcher": {"command": "mpirun", "ranks_flag": "-np"}}
    assert run_files.check_config(good) == []
    assert run_files.check_config(good | {"methods": ["basic"]}) == ["methods: basic and tolerance_queue go together"]
    assert len(run_files.check_config({})) == 13


@pytest.mark.parametrize(
    "href,url",
    [
        ("b", "http://h.x/a/b"), ("/b?q#f", "http://h.x/b?q#f"), ("../b", "http://h.x/b"), ("./b/../c", "http://h.x/a/c"), ("../../../b", "http://h.x/b"), ("//o.y/z", "http://o.y/z"), ("https://o.y/z", "https://o.y/z"),
        ("#f", "http://h.x/a/p?x=1#f"), ("?y", "http://h.x/a/p?y"), ("mailto:a@b", "mailto:a@b"),
    ],
)
def test_joined_urls(spark, href, url):
    assert spark.range(1).select(fn.joined_url(F.lit("http://h.x/a/p?x=1#top"), F.lit(href))).first()[0] == url


def test_anchors(spark):
    html = """<link href="/no"><a class='x>y' href='/one'>1</a><A HREF=two>2</A><a href="/one">again</a><abbr href="/no">n</abbr><a data-href="/no">n</a>"""
    got = edge_files.page_links(spark.createDataFrame([(1, "http://h.x/d/p", html), (2, "http://h.x/", None)], "page_id long, url string, html string")).collect()
    assert {(r["url"], r["place"], r["n"]) for r in got} == {("http://h.x/one", 0, 2), ("http://h.x/d/two", 1, 1)}
