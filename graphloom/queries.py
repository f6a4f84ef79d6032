"""The graph queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checked, compare, detection, partitioning, statistics, traversal
from .plans import Graph
from .plans.derived import ORDER_CHAIN_SQL, PART_NEXT_SQL, RAW_PAIRS_SQL, USER_NEXT_SQL, USERS_SQL, order_chain, part_graph, raw_pairs, table, user_graph
from .functions import text
from .sources import edge_files, run_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The core's k, the number of ranks, and where the redundant lanes of checked runs are made to err.
K, RANKS, FAULT = 15, 4, 13
INF = traversal.UNREACHABLE


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order; six decimals do not."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def best_source(graph: Graph) -> int:
    return statistics.top_sources(graph, 1).first()["vertex"]


# --- SQL pieces -------------------------------------------------------------------------------------------------------

PARTS = "SELECT CAST(p_partkey AS BIGINT) AS id FROM part"
ORDERS = "SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders"
DEGREES = """SELECT v.id, coalesce(o.n, 0)::BIGINT AS outdegree, coalesce(i.n, 0)::BIGINT AS indegree, (coalesce(o.n, 0) + coalesce(i.n, 0))::BIGINT AS total_degree
    FROM v LEFT JOIN (SELECT src AS id, count(*) AS n FROM e GROUP BY 1) o USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1) i USING (id)"""
SIMPLE = "SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src <> dst"


def graph_sql(vertices: str = PARTS, edges: str = PART_NEXT_SQL) -> str:
    return f"WITH v AS MATERIALIZED ({vertices}), e AS MATERIALIZED ({edges}), deg AS MATERIALIZED ({DEGREES}), s AS MATERIALIZED ({SIMPLE}), src0 AS MATERIALIZED (SELECT id FROM deg ORDER BY outdegree DESC, total_degree DESC, id LIMIT 1)"


def unrolled(start: str, step: str, rounds: int) -> str:
    """CTEs r0 ... r``rounds``; ``step`` reads its predecessor as PREV. Rounds past convergence change nothing."""
    out = [f"r0 AS MATERIALIZED ({start})"]
    out += [f"r{i} AS MATERIALIZED ({step.replace('PREV', f'r{i - 1}').replace('ROUND', str(i))})" for i in range(1, rounds + 1)]
    return ", ".join(out)


BFS_ROUNDS, LABEL_ROUNDS, CORE_ROUNDS, RANK_ROUNDS = 25, 40, 40, 60
BFS_CTE = unrolled(
    f"SELECT v.id, (CASE WHEN v.id = src0.id THEN 0 ELSE {INF} END)::INTEGER AS distance FROM v CROSS JOIN src0",
    "SELECT p.id, least(p.distance, coalesce(m.d, p.distance))::INTEGER AS distance FROM PREV p LEFT JOIN (SELECT e.dst AS id, min(q.distance) + 1 AS d FROM e JOIN PREV q ON q.id = e.src GROUP BY 1) m USING (id)",
    BFS_ROUNDS,
)
LABEL_CTE = unrolled(
    "SELECT id, id AS label, 0::BIGINT AS delta FROM v",
    "SELECT p.id, greatest(p.label, coalesce(m.l, p.label)) AS label, greatest(coalesce(m.l, p.label) - p.label, 0) AS delta FROM PREV p LEFT JOIN (SELECT e.dst AS id, max(q.label) AS l FROM e JOIN PREV q ON q.id = e.src GROUP BY 1) m USING (id)",
    LABEL_ROUNDS,
)
KCORE_CTE = unrolled(
    "SELECT id, indegree AS support, true AS alive, false AS died, 0::BIGINT AS delta FROM deg",
    f"""SELECT p.id, (p.support - coalesce(m.n, 0))::BIGINT AS support, p.alive AND p.support - coalesce(m.n, 0) >= {K} AS alive, p.alive AND p.support - coalesce(m.n, 0) < {K} AS died,
        (CASE WHEN p.alive THEN coalesce(m.n, 0) ELSE 0 END)::BIGINT AS delta
        FROM PREV p LEFT JOIN (SELECT e.dst AS id, count(*) AS n FROM e JOIN PREV q ON q.id = e.src AND q.died GROUP BY 1) m USING (id)""",
    CORE_ROUNDS,
)
RANK_CTE = unrolled(
    "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank, false AS changed, true AS active, 0.0::DOUBLE AS delta FROM v",
    """SELECT id, new AS rank, active AND abs(new - rank) >= 1e-3 AS changed, active, abs(new - rank) AS delta FROM (
        SELECT p.id, p.rank, (ROUND = 1 OR coalesce(m.called, false)) AS active,
            CASE WHEN ROUND = 1 OR coalesce(m.called, false) THEN 0.15::DOUBLE + 0.85::DOUBLE * coalesce(m.s, 0.0::DOUBLE) ELSE p.rank END AS new
        FROM PREV p LEFT JOIN (SELECT e.dst AS id, sum(q.rank / d.outdegree) AS s, bool_or(q.changed) AS called FROM e JOIN PREV q ON q.id = e.src JOIN deg d ON d.id = e.src GROUP BY 1) m USING (id))""",
    RANK_ROUNDS,
)
INDEX_CTE = unrolled(
    "SELECT v.id, coalesce(d.n, 0)::BIGINT AS core FROM v LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT u AS id FROM s UNION ALL SELECT v AS id FROM s) GROUP BY 1) d USING (id)",
    """SELECT p.id, coalesce(m.h, 0)::BIGINT AS core FROM PREV p LEFT JOIN (SELECT id, max(least(core, rn)) AS h FROM (
        SELECT b.id, q.core, row_number() OVER (PARTITION BY b.id ORDER BY q.core DESC) AS rn FROM (SELECT u AS id, v AS o FROM s UNION ALL SELECT v AS id, u AS o FROM s) b JOIN PREV q ON q.id = b.o) GROUP BY 1) m USING (id)""",
    CORE_ROUNDS,
)


def each_round(select: str, rounds: int) -> str:
    return " UNION ALL ".join(select.replace("ROUND", f"{i}").replace("PREV", f"r{i}") for i in range(1, rounds + 1))


# --- traversal --------------------------------------------------------------------------------------------------------


@query(f"{graph_sql()}, {BFS_CTE} SELECT id, distance FROM r{BFS_ROUNDS}")
def bfs_levels(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return traversal.bfs(graph, best_source(graph))[0]


@query(f"{graph_sql()}, {BFS_CTE} SELECT id, distance FROM r{BFS_ROUNDS}")
def bfs_seeded(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return traversal.bfs(graph, best_source(graph))[0]


@query(f"{graph_sql()}, {BFS_CTE} SELECT distance AS iter, count(*) AS new FROM r{BFS_ROUNDS} WHERE distance BETWEEN 1 AND {INF - 1} GROUP BY 1")
def bfs_frontier_sizes(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    history = [h for h in traversal.bfs(graph, best_source(graph))[1] if h["new"]]
    return traversal.history_frame(spark, history, "iter int, new long")


@query(f"{graph_sql()}, {BFS_CTE} SELECT distance, count(*) AS vertices FROM r{BFS_ROUNDS} GROUP BY 1")
def bfs_level_histogram(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return traversal.bfs(graph, best_source(graph))[0].groupBy("distance").agg(F.count("*").alias("vertices"))


@query(f"{graph_sql()}, {LABEL_CTE} SELECT id, label FROM r{LABEL_ROUNDS}")
def cc_max_label(spark, sf_dir):
    return traversal.max_labels(part_graph(spark, sf_dir))[0]


@query(f"{graph_sql()}, {LABEL_CTE} SELECT label, count(*) AS vertices FROM r{LABEL_ROUNDS} GROUP BY 1")
def cc_sizes(spark, sf_dir):
    return traversal.max_labels(part_graph(spark, sf_dir))[0].groupBy("label").agg(F.count("*").alias("vertices"))


@query(f"{graph_sql(edges=f'SELECT src, dst FROM ({PART_NEXT_SQL}) UNION ALL SELECT dst AS src, src AS dst FROM ({PART_NEXT_SQL})')}, {LABEL_CTE} SELECT id, label FROM r{LABEL_ROUNDS}")
def cc_symmetric(spark, sf_dir):
    return traversal.max_labels(part_graph(spark, sf_dir).symmetrize())[0]


@query(f"{graph_sql(vertices=ORDERS, edges=ORDER_CHAIN_SQL)}, {LABEL_CTE} SELECT id, label FROM r{LABEL_ROUNDS}")
def cc_order_chain(spark, sf_dir):
    return traversal.max_labels(order_chain(spark, sf_dir))[0]


@query(f"{graph_sql()}, {KCORE_CTE} SELECT id, alive FROM r{CORE_ROUNDS}")
def kcore_members(spark, sf_dir):
    return traversal.kcore(part_graph(spark, sf_dir), K)[0].select("id", "alive")


@query(f"{graph_sql()}, {KCORE_CTE} SELECT id, support FROM r{CORE_ROUNDS} WHERE alive")
def kcore_support(spark, sf_dir):
    return traversal.kcore(part_graph(spark, sf_dir), K)[0].where("alive").select("id", "support")


@query(f"{graph_sql()}, {KCORE_CTE}, t AS ({each_round('SELECT ROUND AS i, count(*) FILTER (died) AS n FROM PREV', CORE_ROUNDS)}) SELECT count(*) AS rounds FROM t WHERE n > 0")
def kcore_rounds(spark, sf_dir):
    rounds = sum(h["count_update"] > 0 for h in traversal.kcore(part_graph(spark, sf_dir), K)[1])
    return spark.createDataFrame([(rounds,)], "rounds long")


@query(f"{graph_sql()}, {INDEX_CTE} SELECT id, core FROM r{CORE_ROUNDS}")
def core_numbers(spark, sf_dir):
    return traversal.core_numbers(part_graph(spark, sf_dir))[0]


@query(f"{graph_sql()}, {INDEX_CTE} SELECT max(core) AS max_core FROM r{CORE_ROUNDS}")
def max_core(spark, sf_dir):
    return traversal.core_numbers(part_graph(spark, sf_dir))[0].agg(F.max("core").alias("max_core"))


@query(f"{graph_sql()}, {RANK_CTE} SELECT id, round(rank, 6) AS rank FROM r{RANK_ROUNDS}")
def pagerank_active(spark, sf_dir):
    return rounded(traversal.pagerank(part_graph(spark, sf_dir))[0], "rank")


@query(f"{graph_sql()}, {RANK_CTE} SELECT id, round(rank, 6) AS rank FROM r{RANK_ROUNDS} ORDER BY round(rank, 6) DESC, id LIMIT 20")
def pagerank_topk(spark, sf_dir):
    ranks = rounded(traversal.pagerank(part_graph(spark, sf_dir))[0], "rank")
    return ranks.orderBy(F.desc("rank"), "id").limit(20)


@query(f"{graph_sql()}, {RANK_CTE}, t AS ({each_round('SELECT count(*) FILTER (active) AS n FROM PREV', RANK_ROUNDS)}) SELECT count(*) AS rounds FROM t WHERE n > 0")
def pagerank_rounds(spark, sf_dir):
    return spark.createDataFrame([(len(traversal.pagerank(part_graph(spark, sf_dir))[1]),)], "rounds long")


# The graph of events has few vertices and very many parallel edges; that of orders has many parts and long chains.
USER_GRAPH = graph_sql(USERS_SQL, USER_NEXT_SQL)


@query(f"{USER_GRAPH}, {BFS_CTE} SELECT id, distance FROM r{BFS_ROUNDS}")
def bfs_users(spark, sf_dir):
    graph = user_graph(spark, sf_dir)
    return traversal.bfs(graph, best_source(graph))[0]


@query(f"{USER_GRAPH}, {LABEL_CTE} SELECT id, label FROM r{LABEL_ROUNDS}")
def cc_users(spark, sf_dir):
    return traversal.max_labels(user_graph(spark, sf_dir))[0]


@query(f"{USER_GRAPH}, {KCORE_CTE} SELECT id, alive, CASE WHEN alive THEN support END AS support FROM r{CORE_ROUNDS}")
def kcore_users(spark, sf_dir):
    return traversal.kcore(user_graph(spark, sf_dir), K)[0]


@query(f"{USER_GRAPH}, {RANK_CTE} SELECT id, round(rank, 6) AS rank FROM r{RANK_ROUNDS}")
def pagerank_users(spark, sf_dir):
    return rounded(traversal.pagerank(user_graph(spark, sf_dir))[0], "rank")


@query(f"{USER_GRAPH} SELECT id, outdegree, indegree, total_degree FROM deg")
def degrees_users(spark, sf_dir):
    return user_graph(spark, sf_dir).degrees()


@query(f"{graph_sql(ORDERS, ORDER_CHAIN_SQL)}, {BFS_CTE} SELECT id, distance FROM r{BFS_ROUNDS}")
def bfs_order_chain(spark, sf_dir):
    graph = order_chain(spark, sf_dir)
    return traversal.bfs(graph, best_source(graph))[0]


# --- detection --------------------------------------------------------------------------------------------------------


def checked_sql(start: str, pull: str, update: str, calls: str, counts: str, term: str, wrong: str, living: str = "true", rounds: int = BFS_ROUNDS) -> str:
    """Rounds of a checked program and their evidence: over old and value of the rows, theirs and outdegree of in-edges."""
    lanes = f"""SELECT l.*, 0.5::DOUBLE * outdegree / (SELECT greatest(max(outdegree), 1) FROM deg) + 0.5::DOUBLE * {term} >= 0.3::DOUBLE AND active AS critical, l.id // 256 AS block
        FROM (SELECT p.id, p.value AS old, p.alive, p.alive AND (ROUND = 1 OR p.id IN (SELECT e.dst FROM e JOIN PREV q ON q.id = e.src WHERE q.calls)) AS active FROM PREV p) l JOIN deg USING (id)"""
    idle = "count(*) FILTER (NOT active) OVER (PARTITION BY block) + (CASE WHEN block = ((SELECT count(*) FROM v) - 1) // 256 THEN (256 - (SELECT count(*) FROM v) % 256) % 256 ELSE 0 END)"
    step = f"""SELECT id, value, old, lived AND {living} AS alive, active AND {calls} AS calls, active, critical, covered, active AND {counts} AS moved, covered AND id % {FAULT} = 0 AS bad, active AND {wrong} AS against
        FROM (SELECT k.id, k.old, k.alive AS lived, k.active, k.critical, k.critical AND rn <= idle AS covered, CASE WHEN k.active THEN {update} ELSE k.old END AS value
            FROM (SELECT c.*, row_number() OVER (PARTITION BY block, critical ORDER BY id) AS rn, {idle} AS idle FROM ({lanes}) c) k
            LEFT JOIN (SELECT e.dst AS id, {pull} AS got FROM e JOIN (SELECT q.id, q.value AS theirs, deg.outdegree FROM PREV q JOIN deg USING (id) WHERE q.alive) q ON q.id = e.src GROUP BY 1) m USING (id))"""
    first = f"SELECT id, value, value AS old, true AS alive, true AS calls, true AS active, false AS critical, false AS covered, false AS moved, false AS bad, false AS against FROM ({start})"
    each = each_round(
        """SELECT ROUND::INTEGER AS iter, count(*) FILTER (active) AS active, count(*) FILTER (critical) AS critical, count(*) FILTER (covered) AS covered, count(*) FILTER (bad) AS dmr_errors, count(*) FILTER (against) AS monotonic_errors,
        count(*) FILTER (moved) AS count_update, round(coalesce(sum(abs(value - old)) FILTER (moved), 0)::DOUBLE, 6) AS sum_abs_delta FROM PREV""",
        rounds,
    )
    return f"{graph_sql()}, {unrolled(first, step, rounds)}, t AS ({each}) SELECT * FROM t WHERE active > 0"


def _checks(spark, sf_dir, program, **more) -> DataFrame:
    """A run whose redundant lanes err on every ``FAULT``-th id: each covered one must be reported, and nothing else."""
    graph = part_graph(spark, sf_dir)
    history = checked.run_checked(graph, program(graph), fault=lambda i, value, n: value + F.when(i % FAULT == 0, 1).otherwise(0), **more)[1]
    return rounded(traversal.history_frame(spark, history, checked.EVIDENCE), "sum_abs_delta")


@query(checked_sql(f"SELECT v.id, (CASE WHEN v.id = src0.id THEN 0 ELSE {INF} END)::INTEGER AS value FROM v CROSS JOIN src0", "min(theirs) + 1", "least(old, coalesce(got, old))", "value < old", "value < old", "(1.0::DOUBLE / (1 + l.old))", "value > old"))
def bfs_checks(spark, sf_dir):
    return _checks(spark, sf_dir, lambda graph: checked.bfs_program(best_source(graph)))


@query(checked_sql("SELECT id, id AS value FROM v", "max(theirs)", "greatest(old, coalesce(got, old))", "value > old", "value > old", "(1.0::DOUBLE / (1 + abs(l.old)))", "value < old"))
def cc_checks(spark, sf_dir):
    return _checks(spark, sf_dir, lambda graph: checked.cc_program())


KCORE_CHECK = ("SELECT id, indegree AS value FROM deg", "count(*)", "coalesce(got, 0)", f"value < {K} AND lived")


@query(checked_sql(*KCORE_CHECK, "value <> old", "(1.0::DOUBLE / (1 + abs(l.old)))", "value > old", f"value >= {K}"))
def kcore_checks(spark, sf_dir):
    return _checks(spark, sf_dir, lambda graph: checked.kcore_program(K))


@query(checked_sql(*KCORE_CHECK, f"value < {K} AND lived", "(1.0::DOUBLE / (1 + abs(l.old)))", "value > old", f"value >= {K}"))
def kcore_death_checks(spark, sf_dir):
    return _checks(spark, sf_dir, lambda graph: checked.kcore_program(K, only_deaths=True))


@query(checked_sql("SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS value FROM v", "sum(theirs / outdegree)", "0.15::DOUBLE + 0.85::DOUBLE * coalesce(got, 0.0::DOUBLE)", "abs(value - old) >= 1e-3", "value <> old", "abs(l.old)", "false", rounds=RANK_ROUNDS))
def pagerank_checks(spark, sf_dir):
    return _checks(spark, sf_dir, lambda graph: checked.pagerank_program(), absolute=1e-9)


@query(f"{graph_sql()}, {BFS_CTE} SELECT id, distance AS value FROM r{BFS_ROUNDS}")
def bfs_checked_levels(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return checked.run_checked(graph, checked.bfs_program(best_source(graph)))[0].select("id", "value")


def score_sql(term: str, source: str) -> str:
    return f"SELECT x.id, round(0.5::DOUBLE * outdegree / (SELECT greatest(max(outdegree), 1) FROM deg) + 0.5::DOUBLE * {term}, 6) AS score, 0.5::DOUBLE * outdegree / (SELECT greatest(max(outdegree), 1) FROM deg) + 0.5::DOUBLE * {term} >= 0.3::DOUBLE AS critical FROM {source} x JOIN deg USING (id)"


@query(f"{graph_sql()}, {BFS_CTE} {score_sql('(1.0::DOUBLE / (1 + distance))', f'r{BFS_ROUNDS}')}")
def score_bfs(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    values = traversal.bfs(graph, best_source(graph))[0].select("id", F.col("distance").alias("value"))
    return rounded(detection.criticality(graph, values, "distance"), "score")


@query(f"{graph_sql()}, {LABEL_CTE} {score_sql('(1.0::DOUBLE / (1 + abs(label)))', f'r{LABEL_ROUNDS}')}")
def score_cc(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return rounded(detection.criticality(graph, traversal.max_labels(graph)[0].select("id", F.col("label").alias("value"))), "score")


INDEGREE_SCORE = score_sql("(1.0::DOUBLE / (1 + x.indegree))", "deg").replace("outdegree /", "deg.outdegree /")


@query(f"{graph_sql()} {INDEGREE_SCORE}")
def score_kcore(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return rounded(detection.criticality(graph, graph.degrees().select("id", F.col("indegree").alias("value"))), "score")


@query(f"{graph_sql()}, {RANK_CTE} {score_sql('abs(rank)', f'r{RANK_ROUNDS}')}")
def score_pagerank(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return rounded(detection.criticality(graph, traversal.pagerank(graph)[0].select("id", F.col("rank").alias("value")), "rank"), "score")


@query(f"{graph_sql()} SELECT greatest(max(outdegree), 1) AS max_outdegree FROM deg")
def max_outdegree(spark, sf_dir):
    return detection.max_outdegree(part_graph(spark, sf_dir))


def _lanes(graph: Graph) -> DataFrame:
    """Vertices with fewer in-edges than the core needs are active; the scores of the in-degrees decide what is critical."""
    degrees = graph.degrees()
    critical = detection.criticality(graph, degrees.select("id", F.col("indegree").alias("value"))).select("id", "critical")
    return degrees.select("id", (F.col("indegree") < 25).alias("active")).join(critical, "id")


LANES_SQL = f"c AS MATERIALIZED ({INDEGREE_SCORE}), lanes AS MATERIALIZED (SELECT deg.id, indegree < 25 AS active, critical, deg.id // 256 AS block FROM deg JOIN c ON c.id = deg.id)"


@query(f"""{graph_sql()}, {LANES_SQL}, n AS (SELECT count(*) AS size FROM v),
    idle AS (SELECT block, count(*) FILTER (NOT active) + (CASE WHEN block = (max(size) - 1) // 256 THEN ((max(size) - 1) // 256 + 1) * 256 - max(size) ELSE 0 END) AS idle FROM lanes CROSS JOIN n GROUP BY block)
    SELECT id, rn <= idle AS covered FROM (SELECT id, block, row_number() OVER (PARTITION BY block ORDER BY id) AS rn FROM lanes WHERE active AND critical) JOIN idle USING (block)""")
def dmr_coverage(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return detection.dmr_coverage(_lanes(graph), graph.vertices.count())


@query(f"{graph_sql()}, {LANES_SQL} SELECT id, id % 97 = 0 AS mismatch FROM lanes WHERE critical")
def dmr_check(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    counted = graph.degrees().select("id", F.col("indegree").alias("value"))
    critical = _lanes(graph).where("critical").select("id")
    again = graph.edges.join(critical.withColumnRenamed("id", "dst"), "dst", "right").groupBy(F.col("dst").alias("id")).agg(F.count("src").alias("value"))
    faulty = again.withColumn("value", F.col("value") + F.when(F.col("id") % 97 == 0, 1).otherwise(0))
    return detection.dmr_compare(counted, faulty)


@query(f"{graph_sql()}, {RANK_CTE}, c AS ({score_sql('abs(rank)', f'r{RANK_ROUNDS}')}) SELECT id, id % 89 = 0 AS mismatch FROM c WHERE critical")
def dmr_check_pr(spark, sf_dir):
    """One more round from the ranks of a run: all vertices from merged shares, the critical ones again from the raw edges."""
    graph = part_graph(spark, sf_dir)
    ranks = traversal.pagerank(graph)[0]
    critical = detection.criticality(graph, ranks.select("id", F.col("rank").alias("value")), "rank").where("critical").select("id")
    pull = lambda got: F.lit(1 - traversal.ALPHA) + F.lit(traversal.ALPHA) * F.coalesce(got, F.lit(0.0))
    sent = ranks.select(F.col("id").alias("src"), "rank")
    shares = traversal.out_shares(graph).join(sent, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
    primary = graph.vertices.join(shares, "id", "left").select("id", pull(F.col("got")).alias("value"))
    each = sent.join(graph.degrees().select(F.col("id").alias("src"), "outdegree"), "src").select("src", (F.col("rank") / F.col("outdegree")).alias("part"))
    raw = graph.edges.join(each, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
    again = critical.join(raw, "id", "left").select("id", pull(F.col("got")).alias("value"))
    faulty = again.select("id", F.when(F.col("id") % 89 == 0, F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("value") + 0.1)).otherwise(F.col("value")).alias("value"))
    return detection.dmr_compare(primary, faulty, absolute=1e-9)


@query(f"""{graph_sql()}, {BFS_CTE} SELECT 'onward' AS direction, count(*) FILTER (b.distance > a.distance) AS violations, bool_or(b.distance > a.distance) AS monotonic_error FROM r1 a JOIN r2 b USING (id)
    UNION ALL SELECT 'back', count(*) FILTER (a.distance > b.distance), bool_or(a.distance > b.distance) FROM r1 a JOIN r2 b USING (id)""")
def monotonic_check(spark, sf_dir):
    """Two rounds of a run, in their order and set back to the earlier one."""
    graph = part_graph(spark, sf_dir)
    one, two = (traversal.bfs(graph, best_source(graph), max_rounds=n)[0].select("id", F.col("distance").alias("value")) for n in (1, 2))
    found = [detection.monotonic_violations(before, after, rising=False).select(F.lit(name).alias("direction"), "*") for name, before, after in (("onward", one, two), ("back", two, one))]
    return found[0].unionByName(found[1])


RANK_CHECKS = """SELECT CAST(event_id % 40 AS INTEGER) AS iter, event_id % 307 <> 0 AS done, event_id % 211 = 0 AS dmr_error, event_id % 223 = 0 AS monotonic_error,
    CAST(event_id % 1013 AS BIGINT) AS sum_abs_delta, CAST(event_id % 7 AS BIGINT) AS count_update FROM events"""


def _rank_checks(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (i % 40).cast("int").alias("iter"), (i % 307 != 0).alias("done"), (i % 211 == 0).alias("dmr_error"), (i % 223 == 0).alias("monotonic_error"),
        (i % 1013).cast("long").alias("sum_abs_delta"), (i % 7).cast("long").alias("count_update"),
    )


MERGED_SQL = f"SELECT iter, bool_and(done) AS checked, bool_or(dmr_error) AS dmr_error, bool_or(monotonic_error) AS monotonic_error, sum(sum_abs_delta)::BIGINT AS sum_abs_delta, sum(count_update)::BIGINT AS count_update FROM ({RANK_CHECKS}) GROUP BY iter"
TREND_SQL = "SELECT min(iter) FILTER (a > b) AS first_trend_iter FROM (SELECT iter, a, lag(a) OVER (ORDER BY iter) AS b FROM (SELECT iter, sum_abs_delta / count_update AS a FROM SOURCE WHERE count_update > 0))"


@query(f"WITH m AS ({MERGED_SQL}) {TREND_SQL.replace('SOURCE', 'm')}")
def trend_check(spark, sf_dir):
    return detection.trend_check(detection.merge_checks(_rank_checks(spark, sf_dir)))


@query(MERGED_SQL)
def check_merge(spark, sf_dir):
    return detection.merge_checks(_rank_checks(spark, sf_dir))


@query(f"""WITH m AS ({MERGED_SQL}), t AS ({TREND_SQL.replace('SOURCE', '(SELECT * FROM m WHERE checked)')})
    SELECT count(*) FILTER (checked) AS checked, count(*) FILTER (NOT checked) AS skipped, min(iter) FILTER (checked AND dmr_error) AS first_dmr_iter,
    min(iter) FILTER (checked AND monotonic_error) AS first_monotonic_iter, any_value(first_trend_iter) AS first_trend_iter FROM m CROSS JOIN t""")
def check_report(spark, sf_dir):
    return detection.check_report(detection.merge_checks(_rank_checks(spark, sf_dir)))


# --- partitions -------------------------------------------------------------------------------------------------------

RANGES_SQL = f"n AS (SELECT count(*) AS n FROM v), ranges AS (SELECT r::INTEGER AS rank, (r * (n // {RANKS}) + least(r, n % {RANKS}))::BIGINT AS start, (n // {RANKS} + (CASE WHEN r < n % {RANKS} THEN 1 ELSE 0 END))::BIGINT AS size FROM n CROSS JOIN range({RANKS}) t(r))"
OWNED_SQL = f"{RANGES_SQL}, own AS MATERIALIZED (SELECT v.id, rank FROM v JOIN ranges ON v.id >= start AND v.id < start + size), cut AS MATERIALIZED (SELECT e.src, e.dst, a.rank AS sr, b.rank AS dr FROM e JOIN own a ON a.id = e.src JOIN own b ON b.id = e.dst), gh AS MATERIALIZED (SELECT sr AS rank, dst AS vertex FROM cut WHERE sr <> dr UNION SELECT dr AS rank, src AS vertex FROM cut WHERE sr <> dr)"


@query(f"{graph_sql()}, {RANGES_SQL} SELECT rank, start, size FROM ranges")
def partition_ranges(spark, sf_dir):
    return partitioning.partition_ranges(spark, table(spark, sf_dir, "part").count(), RANKS)


@query(f"{graph_sql()}, {OWNED_SQL} SELECT id, rank FROM own")
def partition_owner(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").cast("long").alias("id")).withColumn("rank", partitioning.owner_of(F.col("id"), parts.count(), RANKS))


@query(f"{graph_sql()}, {OWNED_SQL} SELECT rank, size AS owned, (SELECT count(*) FROM gh WHERE gh.rank = r.rank) AS ghosts, (SELECT count(*) FROM cut WHERE sr = r.rank) AS out_edges, (SELECT count(*) FROM cut WHERE dr = r.rank) AS in_edges FROM ranges r")
def partition_sizes(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return partitioning.partition_sizes(graph, graph.vertices.count(), RANKS)


@query(f"{graph_sql()}, {OWNED_SQL} SELECT rank, vertex FROM gh")
def ghost_vertices(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return partitioning.ghost_vertices(graph, graph.vertices.count(), RANKS)


@query(f"{graph_sql()}, {OWNED_SQL} SELECT DISTINCT sr AS sender, dr AS owner, dst AS vertex FROM cut WHERE sr <> dr")
def activation_plan(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return partitioning.activation_plan(graph, graph.vertices.count(), RANKS)


@query(f"{graph_sql()}, {OWNED_SQL} SELECT own.rank AS owner, gh.rank AS receiver, vertex FROM gh JOIN own ON own.id = vertex")
def value_plan(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return partitioning.value_plan(graph, graph.vertices.count(), RANKS)


@query(f"""{graph_sql()}, {OWNED_SQL}, a AS (SELECT sr AS sender, dr AS receiver, count(DISTINCT dst) AS activations FROM cut WHERE sr <> dr GROUP BY 1, 2),
    b AS (SELECT own.rank AS sender, gh.rank AS receiver, count(*) AS vertex_values FROM gh JOIN own ON own.id = vertex GROUP BY 1, 2),
    c AS (SELECT sender, receiver, coalesce(activations, 0) AS activations, coalesce(vertex_values, 0) AS vertex_values FROM a FULL JOIN b USING (sender, receiver))
    SELECT *, coalesce(sum(vertex_values) OVER (PARTITION BY sender ORDER BY receiver ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS displacement FROM c""")
def exchange_volume(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return partitioning.exchange_volume(graph, graph.vertices.count(), RANKS)


# --- files and edges --------------------------------------------------------------------------------------------------

MTX_SQL = """SELECT 0::BIGINT AS pos, '%%MatrixMarket matrix coordinate real general' AS value UNION ALL SELECT 1, '% made from events' UNION ALL
    SELECT 2, concat((SELECT max(user_id) + 1 FROM events), ' ', 100, ' ', (SELECT count(*) FROM events)) UNION ALL
    SELECT 10 + event_id, CASE event_id % 3 WHEN 0 THEN concat(user_id, ' ', event_id % 100) WHEN 1 THEN concat(user_id, ', ', event_id % 100, ' , 2.5') ELSE concat('  ', user_id, chr(9), event_id % 100, ' 4') END FROM events"""
LIST_SQL = """SELECT event_id AS pos, CASE WHEN event_id % 17 = 0 THEN concat('# ', user_id, ' ', event_id) WHEN event_id % 19 = 0 THEN '' WHEN event_id % 5 = 0 THEN concat('x ', user_id, ',', (event_id * 7) % 211 , ' 9')
    ELSE concat(user_id, ' ', (event_id * 7) % 211) END AS value FROM events"""


def _mtx_lines(spark, sf_dir) -> DataFrame:
    events, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    head = events.agg(F.concat_ws(" ", F.max("user_id") + 1, F.lit(100), F.count("*")).alias("value")).select(F.lit(2).cast("long").alias("pos"), "value")
    notes = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, "% made from events")], "pos long, value string")
    body = F.when(i % 3 == 0, F.concat_ws(" ", u, i % 100)).when(i % 3 == 1, F.concat(u, F.lit(", "), i % 100, F.lit(" , 2.5"))).otherwise(F.concat(F.lit("  "), u, F.lit("\t"), i % 100, F.lit(" 4")))
    return notes.unionByName(head).unionByName(events.select((i + 10).alias("pos"), body.alias("value")))


def _list_lines(spark, sf_dir) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    other = (i * 7) % 211
    value = F.when(i % 17 == 0, F.concat(F.lit("# "), u, F.lit(" "), i)).when(i % 19 == 0, F.lit("")).when(i % 5 == 0, F.concat(F.lit("x "), u, F.lit(","), other, F.lit(" 9"))).otherwise(F.concat(u, F.lit(" "), other))
    return table(spark, sf_dir, "events").select(i.alias("pos"), value.alias("value"))


PARSED_LIST_SQL = "SELECT event_id AS pos, user_id AS src, (event_id * 7) % 211 AS dst FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0"


@query("SELECT user_id AS src, event_id % 100 AS dst, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.5 ELSE 4.0 END::DOUBLE AS weight FROM events")
def mtx_parse(spark, sf_dir):
    return edge_files.mtx_parse(_mtx_lines(spark, sf_dir))


@query("SELECT (max(user_id) + 1)::BIGINT AS n_rows, 100::BIGINT AS n_cols, count(*) AS nnz, greatest(max(user_id) + 1, 100)::BIGINT AS n_vertices FROM events")
def mtx_header(spark, sf_dir):
    return edge_files.mtx_header(_mtx_lines(spark, sf_dir))


@query(f"{graph_sql()} SELECT 0::BIGINT AS pos, '%%MatrixMarket matrix coordinate pattern general' AS value UNION ALL SELECT 1, concat(n, ' ', n, ' ', (SELECT count(*) FROM e)) FROM (SELECT count(*) AS n FROM v) UNION ALL SELECT 2, concat(src, ' ', dst) FROM e")
def mtx_write(spark, sf_dir):
    return edge_files.mtx_lines(part_graph(spark, sf_dir))


@query(PARSED_LIST_SQL)
def edgelist_parse(spark, sf_dir):
    return edge_files.edge_list_parse(_list_lines(spark, sf_dir))


@query(f"SELECT src, dst FROM ({RAW_PAIRS_SQL}) WHERE src <> dst AND src >= 0 AND dst >= 0 AND src < 1000 AND dst < 1000")
def clean_edges(spark, sf_dir):
    return edge_files.clean_edges(raw_pairs(spark, sf_dir), 1000)


@query(f"SELECT DISTINCT src, dst FROM ({RAW_PAIRS_SQL})")
def dedupe_edges(spark, sf_dir):
    return edge_files.dedupe_edges(raw_pairs(spark, sf_dir))


@query(f"SELECT src - 1 AS src, dst - 1 AS dst FROM (SELECT src + 1 AS src, dst + 1 AS dst FROM ({PART_NEXT_SQL})) WHERE (SELECT count(*) FROM part) > 0")
def rebase_ids(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    moved = graph.edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"))
    return edge_files.rebase_ids(moved, "auto", graph.vertices.count())


COMPACT_SQL = f"""p AS MATERIALIZED (SELECT * FROM ({PARSED_LIST_SQL}) WHERE src <> dst AND src >= 0 AND dst >= 0),
    ids AS MATERIALIZED (SELECT id AS original_id, row_number() OVER (ORDER BY seen) - 1 AS compact_id FROM (SELECT id, min(place) AS seen FROM (SELECT src AS id, pos * 2 AS place FROM p UNION ALL SELECT dst AS id, pos * 2 + 1 AS place FROM p) GROUP BY id))"""


@query(f"WITH {COMPACT_SQL} SELECT original_id, compact_id FROM ids")
def compact_ids(spark, sf_dir):
    return edge_files.compact_ids(edge_files.edge_list_parse(_list_lines(spark, sf_dir)))


@query(f"WITH {COMPACT_SQL} SELECT a.compact_id AS src, b.compact_id AS dst FROM p JOIN ids a ON a.original_id = src JOIN ids b ON b.original_id = dst")
def compact_edges(spark, sf_dir):
    return edge_files.compact_edges(edge_files.edge_list_parse(_list_lines(spark, sf_dir)))


@query(f"SELECT src, dst FROM ({PART_NEXT_SQL}) UNION ALL SELECT dst AS src, src AS dst FROM ({PART_NEXT_SQL})")
def symmetrize(spark, sf_dir):
    return part_graph(spark, sf_dir).symmetrize().edges


def offsets_sql(degree: str) -> str:
    return f"{graph_sql()} SELECT id, (sum({degree}) OVER (ORDER BY id) - {degree})::BIGINT AS start_at, (sum({degree}) OVER (ORDER BY id))::BIGINT AS end_at FROM deg"


@query(offsets_sql("outdegree"))
def csr_offsets(spark, sf_dir):
    return edge_files.offsets(part_graph(spark, sf_dir), "src")


@query(offsets_sql("indegree"))
def csc_offsets(spark, sf_dir):
    return edge_files.offsets(part_graph(spark, sf_dir), "dst")


@query("""SELECT page_id, page_url, url, (min(i) - 1)::INTEGER AS place, count(*) AS n FROM (SELECT page_id, url AS page_url, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS url, i FROM (
        SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i FROM pages) WHERE href LIKE '/%') GROUP BY 1, 2, 3""")
def page_links(spark, sf_dir):
    return edge_files.page_links(table(spark, sf_dir, "pages"))


WEIGHTED = "SELECT user_id AS u, event_id % 97 AS v, CASE WHEN event_id % 3 = 0 THEN '1' ELSE CAST(event_id % 5 AS VARCHAR) END AS w FROM events WHERE event_id % 11 <> 0"


@query(f"""SELECT 0::BIGINT AS pos, '%%MatrixMarket matrix coordinate real general' AS value UNION ALL SELECT 1, (SELECT concat(max(greatest(u, v)), ' ', max(greatest(u, v)), ' ', count(*)) FROM ({WEIGHTED}))
    UNION ALL SELECT 2, concat(u, ' ', v, ' ', w) FROM ({WEIGHTED})""")
def mtx_write_weighted(spark, sf_dir):
    i = F.col("event_id")
    pair = F.concat_ws(" ", "user_id", i % 97)
    value = F.when(i % 11 == 0, F.concat(F.lit("/ "), pair)).when(i % 3 == 0, pair).otherwise(F.concat_ws("\t", pair, i % 5))
    return edge_files.weighted_mtx_lines(table(spark, sf_dir, "events").select(i.alias("pos"), value.alias("value")))


@query(f"{graph_sql()} SELECT 0::BIGINT AS pos, '%%MatrixMarket matrix coordinate pattern general' AS value UNION ALL SELECT 1, concat(n, ' ', n, ' ', (SELECT count(*) FROM e)) FROM (SELECT count(*) AS n FROM v) UNION ALL SELECT 2, concat(src + 1, ' ', dst + 1) FROM e")
def mtx_write_one_based(spark, sf_dir):
    return edge_files.mtx_lines(part_graph(spark, sf_dir), first_id=1)


KINDS = "['.mtx', '.edges', '.TXT', '.csv', '.tsv', '.out', '.dat', '.zip']"


@query(f"""SELECT path, size_bytes, lower(k[2:]) AS kind, [0, 1, 2, 3, 3, 4, 5][i]::INTEGER AS preference FROM (SELECT CASE WHEN p_partkey % 10 = 3 THEN 'a/README' WHEN p_partkey % 10 = 4 THEN 'a/.x' ELSE 'a/g' END || p_partkey || ({KINDS})[p_partkey % 8 + 1] AS path,
    CAST(p_size AS BIGINT) AS size_bytes, ({KINDS})[p_partkey % 8 + 1] AS k, p_partkey % 8 + 1 AS i, p_partkey % 10 AS o FROM part) WHERE i < 8 AND o NOT IN (3, 4)""")
def candidate_files(spark, sf_dir):
    key = F.col("p_partkey")
    kinds = F.array(*[F.lit(k) for k in (".mtx", ".edges", ".TXT", ".csv", ".tsv", ".out", ".dat", ".zip")])
    name = F.concat(F.when(key % 10 == 3, "a/README").when(key % 10 == 4, "a/.x").otherwise("a/g"), key.cast("string"), F.get(kinds, (key % 8).cast("int")))
    return run_files.candidate_files(table(spark, sf_dir, "part").select(name.alias("path"), F.col("p_size").cast("long").alias("size_bytes")))


@query(f"""WITH c AS (SELECT unnest({run_files.SNAP!r}) AS dataset, 'snap' AS o UNION ALL SELECT unnest({run_files.NETWORK_REPOSITORY!r}), 'other'),
    l AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, p_partkey) AS rn FROM (
        SELECT c.dataset, p_partkey, p_partkey % 3 AS kind, 'https://' || CASE p_partkey % 3 WHEN 2 THEN 'nrvis.com' ELSE 'example.org' END || '/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.gz' ELSE '.zip' END AS url
        FROM c JOIN part ON p_partkey < 40 AND p_partkey % 14 = length(c.dataset) % 14 AND o = 'other'))
    SELECT c.dataset, CASE WHEN o = 'snap' THEN 'https://snap.stanford.edu/data/' || c.dataset || '.txt.gz' ELSE coalesce(url, 'https://nrvis.com/download/data/' || c.dataset[1:3] || '/' || c.dataset || '.zip') END AS url
    FROM c LEFT JOIN l ON l.dataset = c.dataset AND rn = 1""")
def archive_choice(spark, sf_dir):
    """Links made up from the first parts: a third of them archives of the best kind."""
    known, key = run_files.catalog(spark), F.col("p_partkey")
    url = F.concat(F.lit("https://"), F.when(key % 3 == 2, "nrvis.com").otherwise("example.org"), F.lit("/"), key.cast("string"), F.when(key % 3 == 0, ".gz").otherwise(".zip"))
    part = table(spark, sf_dir, "part").where(key < 40)
    links = known.join(part, key % 14 == F.length("dataset") % 14).select("page_url", url.alias("url"), key.alias("place"))
    return run_files.archive_choice(known, links)


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nan' ELSE printf('%.6f', value) END AS fixed, concat('a\\|b', event_id, ' c') AS cell, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS moment,
    concat('{"k":', event_id % 10, '}') AS json FROM events""")
def text_cells(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i, text.fixed_decimals(F.when(i % 7 != 0, F.col("value"))).alias("fixed"), text.markdown_cell(F.concat(F.lit("a|b"), i, F.lit("\nc"))).alias("cell"),
        text.utc_text(F.col("ts").cast("timestamp_ntz")).alias("moment"), F.to_json(F.struct((i % 10).alias("k"))).alias("json"),
    )


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS rows, count(DISTINCT {key}) AS keys, min({key})::BIGINT AS first_key, max({key})::BIGINT AS last_key FROM {name}" for name, key in zip(TABLES, "r_regionkey n_nationkey c_custkey s_suppkey p_partkey o_orderkey l_orderkey event_id doc_id vec_id page_id item_id doc_id conv_id".split())))
def scan_tables(spark, sf_dir):
    """What each table holds, from its key column alone."""
    found = None
    for name in TABLES:
        rows = table(spark, sf_dir, name)
        key = F.col(rows.columns[0])
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.min(key).cast("long").alias("first_key"), F.max(key).cast("long").alias("last_key"))
        found = one if found is None else found.unionByName(one)
    return found


# --- statistics -------------------------------------------------------------------------------------------------------

SIMPLE_DEGREES = "sd AS MATERIALIZED (SELECT v.id, coalesce(n, 0)::BIGINT AS degree FROM v LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT u AS id FROM s UNION ALL SELECT v AS id FROM s) GROUP BY 1) USING (id))"
TRIANGLES = "tri AS MATERIALIZED (SELECT x.u AS a, x.v AS b, y.v AS c FROM s x JOIN s y ON y.u = x.v JOIN s z ON z.u = x.u AND z.v = y.v)"


@query(f"{graph_sql()} SELECT id, outdegree, indegree, total_degree FROM deg")
def degrees(spark, sf_dir):
    return part_graph(spark, sf_dir).degrees()


@query(f"{graph_sql()} SELECT count(*) AS v, sum(outdegree)::BIGINT AS e, max(total_degree) AS dmax, round(2.0::DOUBLE * sum(outdegree) / count(*), 6) AS davg FROM deg")
def graph_summary(spark, sf_dir):
    return rounded(statistics.graph_summary(part_graph(spark, sf_dir)), "davg")


@query(f"{graph_sql()}, {SIMPLE_DEGREES} SELECT count(*) AS v, (sum(degree) // 2)::BIGINT AS e, max(degree) AS dmax, round(sum(degree)::DOUBLE / count(*), 6) AS davg FROM sd")
def graph_summary_simple(spark, sf_dir):
    return rounded(statistics.graph_summary_simple(part_graph(spark, sf_dir)), "davg")


def assort_sql(pairs: str) -> str:
    return f"SELECT round((p - m * m) / (q - m * m), 6) AS r FROM (SELECT avg(j * k) AS p, avg((j + k) / 2) AS m, avg((j * j + k * k) / 2) AS q FROM ({pairs}))"


@query(f"{graph_sql()} {assort_sql('SELECT a.total_degree::DOUBLE AS j, b.total_degree::DOUBLE AS k FROM e JOIN deg a ON a.id = src JOIN deg b ON b.id = dst')}")
def assortativity_directed(spark, sf_dir):
    return rounded(statistics.assortativity_directed(part_graph(spark, sf_dir)), "r")


@query(f"{graph_sql()}, {SIMPLE_DEGREES} {assort_sql('SELECT a.degree::DOUBLE AS j, b.degree::DOUBLE AS k FROM s JOIN sd a ON a.id = u JOIN sd b ON b.id = v')}")
def assortativity_simple(spark, sf_dir):
    return rounded(statistics.assortativity_simple(part_graph(spark, sf_dir)), "r")


@query(f"{graph_sql()}, {TRIANGLES} SELECT count(*) AS triangles FROM tri")
def triangle_count(spark, sf_dir):
    return statistics.triangle_count(part_graph(spark, sf_dir))


@query(f"{graph_sql()}, {TRIANGLES} SELECT v.id, coalesce(n, 0)::BIGINT AS triangles FROM v LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY 1) USING (id)")
def triangles_per_vertex(spark, sf_dir):
    return statistics.triangles_per_vertex(part_graph(spark, sf_dir))


@query(f"{graph_sql()}, {TRIANGLES}, n AS (SELECT u, v, count(*) AS n FROM (SELECT a AS u, b AS v FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri) GROUP BY 1, 2) SELECT round(coalesce(sum(n), 0)::DOUBLE / count(*), 6) AS t_avg, coalesce(max(n), 0)::BIGINT AS t_max FROM s LEFT JOIN n USING (u, v)")
def edge_triangles(spark, sf_dir):
    return rounded(statistics.edge_triangles(part_graph(spark, sf_dir)), "t_avg")


CORNERS = "cor AS (SELECT v.id, coalesce(n, 0) AS t FROM v LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY 1) USING (id))"


@query(f"{graph_sql()}, {SIMPLE_DEGREES}, {TRIANGLES}, {CORNERS} SELECT round(avg(CASE WHEN degree >= 2 THEN 2.0::DOUBLE * t / (degree * (degree - 1)) ELSE 0.0::DOUBLE END), 6) AS kappa_avg FROM sd JOIN cor USING (id)")
def clustering_local(spark, sf_dir):
    return rounded(statistics.clustering_local(part_graph(spark, sf_dir)), "kappa_avg")


@query(f"{graph_sql()}, {SIMPLE_DEGREES}, {TRIANGLES} SELECT round(3.0::DOUBLE * (SELECT count(*) FROM tri) / (SELECT sum(degree * (degree - 1) // 2) FROM sd), 6) AS kappa")
def clustering_global(spark, sf_dir):
    return rounded(statistics.clustering_global(part_graph(spark, sf_dir)), "kappa")


@query(f"""{graph_sql()}, {SIMPLE_DEGREES}, {TRIANGLES}, {CORNERS}, {INDEX_CTE}, n AS (SELECT u, v, count(*) AS n FROM (SELECT a AS u, b AS v FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri) GROUP BY 1, 2)
    SELECT 'parts' AS dataset, (SELECT count(*) FROM sd) AS v, (SELECT (sum(degree) // 2)::BIGINT FROM sd) AS e, (SELECT max(degree) FROM sd) AS dmax, (SELECT round(sum(degree)::DOUBLE / count(*), 6) FROM sd) AS davg,
    (SELECT r FROM ({assort_sql('SELECT a.degree::DOUBLE AS j, b.degree::DOUBLE AS k FROM s JOIN sd a ON a.id = u JOIN sd b ON b.id = v')})) AS r, (SELECT count(*) FROM tri) AS triangles,
    (SELECT round(coalesce(sum(n), 0)::DOUBLE / count(*), 6) FROM s LEFT JOIN n USING (u, v)) AS t_avg, (SELECT coalesce(max(n), 0)::BIGINT FROM n) AS t_max,
    (SELECT round(avg(CASE WHEN degree >= 2 THEN 2.0::DOUBLE * t / (degree * (degree - 1)) ELSE 0.0::DOUBLE END), 6) FROM sd JOIN cor USING (id)) AS kappa_avg,
    (SELECT round(3.0::DOUBLE * (SELECT count(*) FROM tri) / sum(degree * (degree - 1) // 2), 6) FROM sd) AS kappa, (SELECT max(core) FROM r{CORE_ROUNDS}) AS k_max""")
def graph_statistics(spark, sf_dir):
    return rounded(statistics.describe({"parts": part_graph(spark, sf_dir)}).drop("omega_lb"), "davg", "r", "t_avg", "kappa_avg", "kappa")


def clique_sql(rounds: int = 15) -> str:
    parts = [f"{graph_sql()}, {SIMPLE_DEGREES}, nb AS MATERIALIZED (SELECT u AS x, v AS y FROM s UNION ALL SELECT v, u FROM s)"]
    for name, order in (("a", "id"), ("b", "id DESC")):
        parts.append(f"{name}0 AS MATERIALIZED (SELECT id, degree FROM sd)")
        for i in range(1, rounds + 1):
            parts.append(f"{name}f{i} AS MATERIALIZED (SELECT id FROM {name}{i - 1} ORDER BY degree DESC, {order} LIMIT 1), {name}{i} AS MATERIALIZED (SELECT c.id, c.degree FROM {name}{i - 1} c JOIN nb ON nb.y = c.id JOIN {name}f{i} f ON f.id = nb.x)")
    sizes = ["(" + " + ".join(f"(SELECT count(*) FROM {n}f{i})" for i in range(1, rounds + 1)) + ")" for n in "ab"]
    return ", ".join(parts) + f" SELECT greatest({sizes[0]}, {sizes[1]})::BIGINT AS omega_lb"


@query(clique_sql())
def clique_lower_bound(spark, sf_dir):
    return statistics.clique_lower_bound(part_graph(spark, sf_dir))


@query(f"{graph_sql()} SELECT row_number() OVER (ORDER BY outdegree DESC, total_degree DESC, id)::INTEGER AS rank, id AS vertex, outdegree, indegree, total_degree FROM deg ORDER BY outdegree DESC, total_degree DESC, id LIMIT 10")
def top_sources(spark, sf_dir):
    return statistics.top_sources(part_graph(spark, sf_dir), 10)


@query(f"""{graph_sql()} SELECT 'part_next' AS dataset, t.nodes, t.valid_edges AS edges, t.valid_edges, d.id AS bfs_source, d.outdegree AS bfs_source_outdegree, d.indegree AS bfs_source_indegree, d.total_degree AS bfs_source_total_degree,
    round(2.0::DOUBLE * t.valid_edges / t.nodes, 6) AS avg_degree, round(t.valid_edges::DOUBLE / t.nodes, 6) AS avg_outdegree FROM (SELECT count(*) AS nodes, sum(outdegree)::BIGINT AS valid_edges FROM deg) t CROSS JOIN (SELECT deg.* FROM deg JOIN src0 USING (id)) d""")
def source_metadata(spark, sf_dir):
    return rounded(statistics.source_metadata(part_graph(spark, sf_dir), "part_next"), "avg_degree", "avg_outdegree")


# --- comparison -------------------------------------------------------------------------------------------------------


@query(f"{graph_sql()} SELECT id, indegree AS expected, indegree + (CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END) AS got FROM deg WHERE id % 50 = 0 ORDER BY id LIMIT 20")
def result_diff(spark, sf_dir):
    values = part_graph(spark, sf_dir).degrees().select("id", F.col("indegree").alias("value"))
    return compare.result_diff(values, values.select("id", (F.col("value") + F.when(F.col("id") % 50 == 0, 1).otherwise(0)).alias("value")))


@query(f"{graph_sql()} SELECT count(*) FILTER (NOT (indegree = outdegree OR (indegree < {K} AND outdegree < {K}))) AS mismatches, count(*) AS compared FROM deg")
def kcore_compare(spark, sf_dir):
    d = part_graph(spark, sf_dir).degrees()
    return compare.core_diff(d.select("id", F.col("indegree").alias("value")), d.select("id", F.col("outdegree").alias("value")), K)


@query(f"{graph_sql()}, {RANK_CTE}, c AS (SELECT rank AS a, rank * (1 + (id % 7) * 0.01::DOUBLE) AS b FROM r{RANK_ROUNDS}) SELECT count(*) FILTER (abs(a - b) > 1e-2::DOUBLE + 1e-4::DOUBLE * abs(a)) AS mismatches, round(max(abs(a - b)), 6) AS max_abs_error, round(max(abs(a - b) / abs(a)), 6) AS max_rel_error FROM c")
def pr_compare(spark, sf_dir):
    ranks = traversal.pagerank(part_graph(spark, sf_dir))[0].select("id", F.col("rank").alias("value"))
    moved = ranks.select("id", (F.col("value") * (1 + (F.col("id") % 7) * 0.01)).alias("value"))
    return rounded(compare.close_diff(ranks, moved), "max_abs_error", "max_rel_error")
