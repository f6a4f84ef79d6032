import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from graphloom.operators import checked, compare, detection, partitioning, statistics, traversal
from graphloom.plans import Adjacency, Graph, Layers, adjacency, fixpoint


def make(spark, n, edges):
    return Graph(spark.range(n), spark.createDataFrame(edges, "src long, dst long"))


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def random_edges(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def test_bfs_directed_with_unreachable_and_isolated(spark):
    graph = make(spark, 6, [(0, 1), (1, 2), (0, 2), (3, 0), (2, 2)])
    found, history = traversal.bfs(graph, 0)
    assert values(found) == {0: 0, 1: 1, 2: 1, 3: 100_000, 4: 100_000, 5: 100_000}
    assert [h["new"] for h in history] == [2, 0]
    assert values(traversal.bfs(graph, 5, unreachable=None)[0])[0] is None
    with pytest.raises(ValueError):
        traversal.bfs(graph, 6)


def test_bfs_round_limit(spark):
    graph = make(spark, 5, [(i, i + 1) for i in range(4)])
    assert values(traversal.bfs(graph, 0, max_rounds=2)[0]) == {0: 0, 1: 1, 2: 2, 3: 100_000, 4: 100_000}


def test_labels_do_not_flow_backwards(spark):
    graph = make(spark, 6, [(0, 1), (1, 2), (5, 4), (3, 3)])
    assert values(traversal.max_labels(graph)[0]) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 5, 5: 5}
    assert values(traversal.max_labels(graph.symmetrize())[0]) == {0: 2, 1: 2, 2: 2, 3: 3, 4: 5, 5: 5}


def test_empty_edges(spark):
    graph = make(spark, 3, [])
    assert values(traversal.bfs(graph, 1)[0])[1] == 0
    assert values(traversal.max_labels(graph)[0]) == {0: 0, 1: 1, 2: 2}
    assert not any(values(traversal.kcore(graph, 1)[0]).values())
    assert all(values(traversal.kcore(graph, 0)[0]).values())
    assert values(traversal.core_numbers(graph)[0]) == {0: 0, 1: 0, 2: 0}
    assert statistics.clique_lower_bound(graph).first()[0] == 1


@pytest.mark.parametrize("k", [2, 3])
def test_kcore_counts_parallel_edges(spark, k):
    edges = random_edges(k, 30, 90) + [(0, 1)] * 3
    alive = set(range(30))
    while True:
        support = Counter(d for s, d in edges if s in alive and d in alive)
        dead = {v for v in alive if support[v] < k}
        if not dead:
            break
        alive -= dead
    got = traversal.kcore(make(spark, 30, edges), k)[0].collect()
    assert {r["id"] for r in got if r["alive"]} == alive
    assert all(r["support"] == (support[r["id"]] if r["alive"] else None) for r in got)


def plain_pagerank(n, edges, alpha=0.85, tol=1e-3):
    out, into = Counter(s for s, _ in edges), defaultdict(list)
    for s, d in edges:
        into[d].append(s)
    rank, active, rounds = [1 / n] * n, set(range(n)), 0
    while active:
        rounds += 1
        new = [(1 - alpha) + alpha * sum(rank[u] / out[u] for u in into[v]) if v in active else rank[v] for v in range(n)]
        changed = {v for v in active if abs(new[v] - rank[v]) >= tol}
        active = {d for s, d in edges if s in changed}
        rank = new
    return rank, rounds


def test_pagerank_active_set(spark):
    edges = random_edges(4, 20, 60) + [(1, 2), (1, 2), (3, 3)]
    rank, rounds = plain_pagerank(20, edges)
    got, history = traversal.pagerank(make(spark, 20, edges))
    assert values(got) == pytest.approx(dict(enumerate(rank)))
    assert len(history) == rounds


def test_core_numbers_and_structure(spark):
    edges = random_edges(5, 25, 90)
    adj = defaultdict(set)
    for s, d in edges:
        if s != d:
            adj[s].add(d)
            adj[d].add(s)
    core, left, k = {}, {v: set(adj[v]) for v in range(25)}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for u in left.pop(v):
            left[u].discard(v)
    graph = make(spark, 25, edges)
    assert values(traversal.core_numbers(graph)[0]) == core
    tri = {tuple(sorted((a, b, c))) for a in adj for b in adj[a] for c in adj[a] & adj[b]}
    assert {tuple(sorted(r)) for r in statistics.triangles(graph).collect()} == tri
    assert statistics.triangle_count(graph).first()[0] == len(tri)
    degree = {v: len(adj[v]) for v in range(25)}
    local = sum(2 * sum(v in t for t in tri) / (d * (d - 1)) for v, d in degree.items() if d > 1) / 25
    assert statistics.clustering_local(graph).first()[0] == pytest.approx(local)
    assert statistics.graph_summary_simple(graph).first()["e"] == sum(degree.values()) // 2


def test_complete_graph(spark):
    edges = [(i, j) for i in range(5) for j in range(5) if i != j]
    graph = make(spark, 6, edges)
    assert {i for i, a in values(traversal.kcore(graph, 4)[0]).items() if a} == set(range(5))
    assert not any(values(traversal.kcore(graph, 5)[0]).values())
    assert statistics.clique_lower_bound(graph).first()[0] == 5
    assert statistics.clustering_global(graph).first()[0] == 1.0
    assert statistics.assortativity_directed(graph).first()[0] is None


def test_criticality_and_coverage(spark):
    graph = make(spark, 3, [(0, 1), (0, 2)])
    vals = spark.createDataFrame([(0, 0), (1, 3), (2, 100)], "id long, value long")
    got = {r["id"]: (r["score"], r["critical"]) for r in detection.criticality(graph, vals).collect()}
    assert got[0] == (1.0, True) and got[1] == (0.125, False)
    assert detection.max_outdegree(make(spark, 2, [])).first()[0] == 1
    lanes = spark.createDataFrame([(i, i != 7, True) for i in range(8)], "id long, active boolean, critical boolean")
    covered = values(detection.dmr_coverage(lanes, 8, block=4))
    assert covered == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False, 6: False}
    assert values(detection.dmr_coverage(lanes.where("id < 6"), 6, block=4)) == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True}


def test_compare_detects_faults(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "id long, value double")
    b = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 3.5)], "id long, value double")
    assert values(detection.dmr_compare(a, b, 0.1)) == {0: False, 1: True, 2: True}
    assert compare.close_diff(a, a).first()["mismatches"] == 0
    assert [r["id"] for r in compare.result_diff(a, b).collect()] == [1, 2]


def test_trend_and_merge(spark):
    rows = [(1, True, 10, 2), (2, True, 0, 0), (3, True, 12, 2), (3, False, 1, 1)]
    checks = spark.createDataFrame([(i, d, False, i == 3, s, c) for i, d, s, c in rows], "iter int, done boolean, dmr_error boolean, monotonic_error boolean, sum_abs_delta long, count_update long")
    merged = detection.merge_checks(checks)
    assert detection.trend_check(merged).first()[0] is None
    report = detection.check_report(merged).first()
    assert (report["checked"], report["skipped"], report["first_monotonic_iter"]) == (2, 1, None)


@pytest.mark.parametrize("n,ranks", [(10, 3), (3, 5), (8, 1)])
def test_owner_inverts_ranges(spark, n, ranks):
    ranges = partitioning.partition_ranges(spark, n, ranks).collect()
    assert sum(r["size"] for r in ranges) == n
    owner = {r["id"]: r["o"] for r in spark.range(n).select("id", partitioning.owner_of(__import__("pyspark").sql.functions.col("id"), n, ranks).alias("o")).collect()}
    assert all(owner[v] == r["rank"] for r in ranges for v in range(r["start"], r["start"] + r["size"]))


def test_ghosts_of_an_empty_cut(spark):
    graph = make(spark, 4, [(0, 1), (2, 3)])
    assert partitioning.ghost_vertices(graph, 4, 2).count() == 0
    crossing = make(spark, 4, [(0, 2), (0, 2), (3, 1)])
    assert {tuple(r) for r in partitioning.ghost_vertices(crossing, 4, 2).collect()} == {(0, 2), (0, 3), (1, 0), (1, 1)}
    assert {tuple(r) for r in partitioning.activation_plan(crossing, 4, 2).collect()} == {(0, 1, 2), (1, 0, 1)}


def test_hubs_are_cut_into_blocks(spark, monkeypatch):
    edges = spark.createDataFrame([(0, i) for i in range(40)] + [(1, 2), (1, 2), (3, 4)], "src long, dst long")
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "src long, tag string")
    want = Counter([(0, i, "a") for i in range(40)] + [(1, 2, "b")] * 2)
    for most, sent in ((3, 100), (3, 0), (1000, 100)):
        monkeypatch.setattr(adjacency, "MOST_SENT", sent)
        with Adjacency(edges, most) as kept:
            got = kept.of(rows)
            assert Counter((r["src"], r["dst"], r["tag"]) for r in got.collect()) == want
            assert kept.n_heavy == (1 if most == 3 else 0)


def test_layers_hold_the_newest_of_each(spark):
    layers, want = Layers("test", lambda: [F.max("value").alias("value")]), {}
    r = random.Random(3)
    for n in range(12):
        rows = {r.randrange(50): n * 100 + r.randrange(9) for _ in range(r.randrange(1, 12))}
        want |= rows
        layers.add(spark.createDataFrame(list(rows.items()), "id long, value long"), len(rows))
        assert len(layers.tables) <= 7
    assert values(layers.settled()) == want
    some = spark.createDataFrame([(i,) for i in list(want)[:5]], "id long")
    assert values(layers.settled(some)) == {i: want[i] for i in list(want)[:5]}


def test_a_whole_layer_replaces_the_others(spark):
    layers = Layers("whole", lambda: [F.max_by("v", "at").alias("v"), F.max("at").alias("at")])
    for at, ids in ((0, range(6)), (1, range(2))):
        table, found = fixpoint.scratch(spark.createDataFrame([(i, 10 * at, at) for i in ids], "id long, v int, at int"), "whole", n=F.count("*"))
        layers.add(table, found["n"])
    assert len(layers.tables) == 2
    newest, _ = fixpoint.scratch(spark.createDataFrame([(i, 70 + i, 2) for i in range(6)], "id long, v int, at int"), "whole")
    layers.add(newest, 6, whole=True)
    assert len(layers.tables) == 1
    assert {(r.id, r.v) for r in layers.settled().collect()} == {(i, 70 + i) for i in range(6)}


def test_a_folder_is_asked_for_where_executors_are_apart(spark, monkeypatch):
    class Apart:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "local-cluster[2,1,1024]"})

    with pytest.raises(RuntimeError):
        fixpoint.shared_dir(Apart())


@pytest.mark.parametrize("name", ["bfs", "cc", "kcore", "pagerank"])
def test_checked_runs_find_what_they_are_told(spark, name):
    graph = make(spark, 300, random_edges(4, 280, 900))
    program = {"bfs": lambda: checked.bfs_program(0), "cc": checked.cc_program, "kcore": lambda: checked.kcore_program(3), "pagerank": checked.pagerank_program}[name]()
    close = 1e-9 if name == "pagerank" else None
    found, clean = checked.run_checked(graph, program, absolute=close)
    plain = {"bfs": lambda: traversal.bfs(graph, 0)[0], "cc": lambda: traversal.max_labels(graph)[0], "kcore": lambda: traversal.kcore(graph, 3)[0].select("id", "support"), "pagerank": lambda: traversal.pagerank(graph)[0]}[name]()
    own = values(found.select("id", F.when(F.col("alive"), F.col("value")).alias("value")))
    assert own == (pytest.approx(values(plain)) if name == "pagerank" else values(plain))
    assert all(h["dmr_errors"] == 0 and h["monotonic_errors"] == 0 and h["covered"] <= h["critical"] <= h["active"] for h in clean)
    wrong = checked.run_checked(graph, program, absolute=close, fault=lambda i, v, n: v + (1 if n == 2 else 0))[1]
    assert [h["dmr_errors"] for h in wrong] == [h["covered"] if h["iter"] == 2 else 0 for h in wrong]
    assert sum(h["covered"] for h in clean) > 0
