"""The benchmark-run queries over attempts derived from ``events``, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.runs import duration, gpu_mode, record_id, stats
from .operators import runs
from .plans.derived import table
from .queries import query, rounded

DATASETS = tuple(f"ds{i}" for i in range(6))
REPEAT, WARMUP = 5, 1
#: How often a setting differs; else it is blank or absent, which counts the same.
ODD_SETTINGS = dict(zip([name for name in runs.ENVIRONMENT if name not in ("hostname", "mpi_ranks")], (31, 71, 73, 79, 83, 89, 97, 101)))


def _pick(items, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (i % len(items) + 1).cast("int"))


def attempts(spark, sf_dir) -> DataFrame:
    """Attempts by integer arithmetic on event ids: retries where ids collide, gaps where they do not reach."""
    i = F.col("event_id")
    method = _pick(runs.METHODS, F.floor(i / 4))
    rows = table(spark, sf_dir, "events").select(
        i.alias("attempt_id"), _pick(runs.ALGORITHMS, i).alias("algorithm"), _pick(DATASETS, F.floor(i / 16)).alias("dataset"), F.when(i % 11 == 0, "warmup").otherwise("measure").alias("phase"),
        (F.floor(i / 96) % 7 + 1).cast("int").alias("repeat"), method.alias("method"), F.when(i % 401 == 0, F.lit("other")).otherwise(gpu_mode(method)).alias("gpu_mode"),
        F.when(F.col("event_type") == "error", "process_error").when(F.col("event_type") == "signup", "timeout").otherwise("success").alias("status"), F.col("ts").alias("finished_at"), F.col("value"),
    )
    good = F.col("status") == "success"
    return rows.select(
        "*", record_id(F.col("algorithm"), F.col("dataset"), F.col("phase"), F.col("repeat"), F.col("method")).alias("record_id"),
        F.when(good, F.col("value")).alias("total_ms"), F.when(good, F.when(F.col("attempt_id") % 13 == 0, 11).otherwise(10)).alias("iterations"),
        F.when(good, F.col("value")).alias("rank_max_ms"), F.when(good, F.col("value") * 0.8).alias("rank_mean_ms"),
        F.when(F.col("gpu_mode") == "multigpu", 2).otherwise(1).alias("mpi_ranks"), F.when(F.col("attempt_id") % 29 == 0, F.lit("node1 ")).otherwise(F.lit("node0")).alias("hostname"),
        *[F.when(F.col("attempt_id") % often == 0, F.lit("1")).otherwise(F.when(F.col("attempt_id") % 2 == 0, F.lit(" "))).alias(name) for name, often in ODD_SETTINGS.items()],
    ).drop("value")


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _padded(c: str) -> str:
    return f"concat('r', lpad(CAST({c} AS VARCHAR), 3, '0'))"


MODE_SQL = "CASE WHEN method IN ('basic', 'tolerance_queue') THEN '1gpu' ELSE 'multigpu' END"
ATTEMPTS_SQL = f"""a0 AS (SELECT event_id AS attempt_id, ({_list(runs.ALGORITHMS)})[event_id % 4 + 1] AS algorithm, ({_list(DATASETS)})[(event_id // 16) % 6 + 1] AS dataset,
    CASE WHEN event_id % 11 = 0 THEN 'warmup' ELSE 'measure' END AS phase, CAST((event_id // 96) % 7 + 1 AS INTEGER) AS repeat, ({_list(runs.METHODS)})[(event_id // 4) % 4 + 1] AS method,
    CASE event_type WHEN 'error' THEN 'process_error' WHEN 'signup' THEN 'timeout' ELSE 'success' END AS status, ts AS finished_at, value FROM events),
  a AS MATERIALIZED (SELECT attempt_id, algorithm, dataset, phase, repeat, method, CASE WHEN attempt_id % 401 = 0 THEN 'other' ELSE {MODE_SQL} END AS gpu_mode, status, finished_at,
    concat_ws('.', algorithm, dataset, phase, {_padded('repeat')}, method) AS record_id, CASE WHEN status = 'success' THEN value END AS total_ms,
    CASE WHEN status = 'success' THEN CASE WHEN attempt_id % 13 = 0 THEN 11 ELSE 10 END END::INTEGER AS iterations, CASE WHEN status = 'success' THEN value END AS rank_max_ms,
    CASE WHEN status = 'success' THEN value * 0.8::DOUBLE END AS rank_mean_ms, CASE WHEN attempt_id % 29 = 0 THEN 'node1 ' ELSE 'node0' END AS hostname,
    CASE WHEN attempt_id % 401 <> 0 AND method IN ('multigpu_basic', 'multigpu') THEN 2 ELSE 1 END AS mpi_ranks, {', '.join(f"CASE WHEN attempt_id % {often} = 0 THEN '1' WHEN attempt_id % 2 = 0 THEN ' ' END AS {name}" for name, often in ODD_SETTINGS.items())} FROM a0)"""
ITEMS_SQL = f"items AS (SELECT algorithm, dataset, concat_ws('.', algorithm, dataset) AS work_id FROM (SELECT unnest({_list(runs.ALGORITHMS)}) AS algorithm) CROSS JOIN (SELECT unnest({_list(DATASETS)}) AS dataset))"
EXPECTED_SQL = f"""{ITEMS_SQL}, expected AS MATERIALIZED (SELECT work_id, algorithm, dataset, phase, repeat, method, concat_ws('.', algorithm, dataset, phase, {_padded('repeat')}, method) AS record_id
    FROM items CROSS JOIN (SELECT 'warmup' AS phase, 1::INTEGER AS repeat UNION ALL SELECT 'measure', r::INTEGER FROM range(1, {REPEAT + 1}) t(r)) CROSS JOIN (SELECT unnest({_list(runs.METHODS)}) AS method))"""
LATEST_SQL = """latest AS MATERIALIZED (SELECT * EXCLUDE (rn), CASE WHEN good > 1 THEN concat(good, ' successes, latest taken') WHEN attempt_count > 1 THEN concat(attempt_count, ' attempts, latest success taken if any') WHEN good = 1 THEN 'only success' ELSE 'only failure' END AS note FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY (status = 'success') DESC, finished_at DESC, attempt_id DESC) AS rn, count(*) OVER (PARTITION BY record_id) AS attempt_count, count(*) FILTER (status = 'success') OVER (PARTITION BY record_id) AS good FROM a) WHERE rn = 1)"""


def _items(spark) -> DataFrame:
    return runs.work_items(spark, runs.ALGORITHMS, DATASETS, REPEAT, WARMUP)


def _expected(spark) -> DataFrame:
    return runs.expected_identities(_items(spark), REPEAT, WARMUP)


def _latest(spark, sf_dir) -> DataFrame:
    return runs.latest_success(attempts(spark, sf_dir))


def _pairs(spark, sf_dir) -> DataFrame:
    """Pairs of the latest attempts; every seventh is entered twice, so that duplicates show."""
    latest = _latest(spark, sf_dir)
    return runs.pair_samples(runs.expected_pairs(_items(spark), REPEAT), latest.unionByName(latest.where("attempt_id % 47 = 0")))


PAIRS_SQL = f"""{ITEMS_SQL}, ep AS (SELECT algorithm, dataset, r::INTEGER AS repeat, gpu_mode, concat_ws('|', algorithm, dataset, {_padded('r')}, gpu_mode) AS pair_id FROM items CROSS JOIN range(1, {REPEAT + 1}) t(r) CROSS JOIN (SELECT unnest(['1gpu', 'multigpu']) AS gpu_mode)),
  obs AS (SELECT * FROM latest UNION ALL SELECT * FROM latest WHERE attempt_id % 47 = 0),
  m AS (SELECT algorithm, dataset, repeat, gpu_mode, method, count(*) AS n, any_value(status) AS status, any_value(iterations) AS iterations, any_value(rank_max_ms) AS mx, any_value(rank_mean_ms) AS mn, {', '.join(f"any_value({name}) AS {name}" for name in runs.ENVIRONMENT)} FROM obs WHERE phase = 'measure' GROUP BY ALL),
  j AS (SELECT ep.*, b.n AS bn, b.status AS bs, b.iterations AS bi, b.mx AS bx, b.mn AS bm, c.n AS cn, c.status AS cs, c.iterations AS ci, c.mx AS cx, c.mn AS cm,
      CASE {' '.join(f"WHEN trim(coalesce(CAST(b.{name} AS VARCHAR), '')) <> trim(coalesce(CAST(c.{name} AS VARCHAR), '')) THEN '{name}'" for name in runs.ENVIRONMENT)} END AS differs
    FROM ep LEFT JOIN m b ON b.algorithm = ep.algorithm AND b.dataset = ep.dataset AND b.repeat = ep.repeat AND b.gpu_mode = ep.gpu_mode AND b.method = CASE ep.gpu_mode WHEN '1gpu' THEN 'basic' ELSE 'multigpu_basic' END
    LEFT JOIN m c ON c.algorithm = ep.algorithm AND c.dataset = ep.dataset AND c.repeat = ep.repeat AND c.gpu_mode = ep.gpu_mode AND c.method = CASE ep.gpu_mode WHEN '1gpu' THEN 'tolerance_queue' ELSE 'multigpu' END),
  f AS (SELECT *, concat_ws(';', CASE WHEN bn IS NULL THEN 'missing' WHEN bn > 1 THEN concat('duplicates=', bn) WHEN bs <> 'success' THEN concat('baseline_', bs) END,
      CASE WHEN cn IS NULL THEN 'missing' WHEN cn > 1 THEN concat('duplicates=', cn) WHEN cs <> 'success' THEN concat('checked_', cs) END) AS fault FROM j),
  pairs AS MATERIALIZED (SELECT *, CASE WHEN fault <> '' THEN 'missing_or_invalid' WHEN differs IS NOT NULL THEN 'environment_mismatch' WHEN bi IS DISTINCT FROM ci THEN 'iteration_mismatch' ELSE 'eligible' END AS pair_status,
      CASE WHEN fault <> '' THEN fault WHEN differs IS NOT NULL THEN concat('environment:', differs) WHEN bi IS DISTINCT FROM ci THEN 'iterations differ' ELSE '' END AS exclusion_reason FROM f),
  p AS MATERIALIZED (SELECT *, CASE WHEN pair_status = 'eligible' AND bx > 0 THEN (cx / bx - 1) * 100 END AS ov, CASE WHEN pair_status = 'eligible' AND bm > 0 THEN (cm / bm - 1) * 100 END AS mov,
      CASE WHEN gpu_mode = 'multigpu' AND bm > 0 THEN (bx / bm - 1) * 100 END AS ib, CASE WHEN gpu_mode = 'multigpu' AND cm > 0 THEN (cx / cm - 1) * 100 END AS ic FROM pairs)"""
PAIR_QUERY = f"WITH {ATTEMPTS_SQL}, {LATEST_SQL}, {PAIRS_SQL}"


def stats_sql(value: str, prefix: str) -> str:
    found = {
        "n": f"count({value})", "mean": f"round(avg({value}), 6)", "median": f"round(quantile_cont({value}, 0.5), 6)", "std": f"round(CASE WHEN count({value}) > 1 THEN stddev_samp({value}) WHEN count({value}) = 1 THEN 0.0::DOUBLE END, 6)",
        "p25": f"round(quantile_cont({value}, 0.25), 6)", "p75": f"round(quantile_cont({value}, 0.75), 6)", "min": f"round(min({value}), 6)", "max": f"round(max({value}), 6)",
    }
    return ", ".join(f"{sql} AS {prefix}_{k}" for k, sql in found.items())


def _stats_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, *[c for c, t in df.dtypes if t == "double"])


@query(f"WITH {ITEMS_SQL} SELECT (row_number() OVER (ORDER BY list_position({_list(runs.ALGORITHMS)}, algorithm), dataset))::INTEGER AS index, work_id, algorithm, dataset, {REPEAT * 4}::INTEGER AS measurement_invocations, {WARMUP * 4}::INTEGER AS warmup_invocations FROM items")
def work_items(spark, sf_dir):
    return _items(spark)


@query(f"WITH {EXPECTED_SQL} SELECT * FROM expected")
def expected_identities(spark, sf_dir):
    return _expected(spark)


@query(f"WITH {ITEMS_SQL} SELECT algorithm, dataset, r::INTEGER AS repeat, gpu_mode, concat_ws('|', algorithm, dataset, {_padded('r')}, gpu_mode) AS pair_id FROM items CROSS JOIN range(1, {REPEAT + 1}) t(r) CROSS JOIN (SELECT unnest(['1gpu', 'multigpu']) AS gpu_mode)")
def expected_pairs(spark, sf_dir):
    return runs.expected_pairs(_items(spark), REPEAT)


@query(f"WITH {ATTEMPTS_SQL} SELECT attempt_id, record_id FROM a")
def record_ids(spark, sf_dir):
    return attempts(spark, sf_dir).select("attempt_id", "record_id")


@query(f"SELECT r::INTEGER AS repeat, (CASE WHEN r % 2 = 1 THEN i ELSE 5 - i END)::INTEGER AS position, ({_list(runs.METHODS)})[i] AS method FROM range(1, {REPEAT + 1}) t(r) CROSS JOIN range(1, 5) u(i)")
def method_order(spark, sf_dir):
    return runs.method_order(spark, REPEAT)


def _outputs(spark, sf_dir) -> DataFrame:
    """Output lines of each attempt: a timing line, an iterations line, noise, and now and then a fault."""
    i, value = F.col("event_id"), F.col("event_id") % 1000
    good = F.concat(F.lit("BENCHMARK_TIMING gpu_main_ms="), value.cast("string"), F.lit(".5 cpu_check_tail_ms=0.25 graph_kernel_ms="), value.cast("string"))
    timing = F.when(i % 41 == 0, F.concat(good, F.lit(" gpu_main_ms=1"))).when(i % 43 == 0, F.concat(good, F.lit(" mpi_sync_ms=fast"))).otherwise(good)
    iterations = F.when(i % 37 == 0, F.lit("BENCHMARK_ITERATIONS iterations=0")).otherwise(F.concat(F.lit("BENCHMARK_ITERATIONS iterations="), (i % 9 + 1).cast("string")))
    lines = F.concat(F.array(F.lit("start"), timing, iterations), F.when(i % 47 == 0, F.array(timing)).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "events").select(i.alias("attempt_id"), F.explode(lines).alias("line"))


ERROR_SQL = "CASE WHEN event_id % 47 = 0 THEN 'timing lines' WHEN event_id % 41 = 0 OR event_id % 43 = 0 THEN 'timing values' WHEN event_id % 37 = 0 THEN 'iterations' END"


@query(f"SELECT event_id AS attempt_id, {ERROR_SQL} AS error, CASE WHEN event_id % 41 <> 0 AND event_id % 43 <> 0 THEN event_id % 1000 + 0.5::DOUBLE END AS main_ms, (CASE WHEN event_id % 37 = 0 THEN 0 ELSE event_id % 9 + 1 END)::INTEGER AS iterations FROM events")
def timing_parse(spark, sf_dir):
    return runs.parse_records(_outputs(spark, sf_dir)).select("attempt_id", "error", F.col("timing")["gpu_main_ms"].alias("main_ms"), "iterations")


SINGLE_LACKS = "CASE WHEN event_id % 53 = 0 THEN 'mpi_sync_ms' WHEN event_id % 59 = 0 THEN 'communication_ms' END"
SINGLE_SQL = {"main_loop": "m", "gpu_compute": "m", "graph_kernel": "m - 0.25", "cpu_check_drain": "0.25", "nccl_exchange": "1.5", "mpi_sync": "2.5", "postcheck_total": "0", "postcheck_mpi": "0", "communication": "4", "algorithm_total": "m + 0.25"}


@query(f"SELECT attempt_id, lacks, {', '.join(f'CASE WHEN lacks IS NULL THEN ({sql})::DOUBLE END AS {name}_ms' for name, sql in SINGLE_SQL.items())} FROM (SELECT event_id AS attempt_id, event_id % 1000 + 0.5::DOUBLE AS m, {SINGLE_LACKS} AS lacks FROM events)")
def timing_normalize(spark, sf_dir):
    i = F.col("event_id")
    main = (i % 1000).cast("string")
    sync = F.when(i % 53 == 0, F.lit("")).otherwise(F.lit(" mpi_sync_ms=2.5"))
    line = F.concat(F.lit("BENCHMARK_TIMING gpu_main_ms="), main, F.lit(".5 graph_kernel_ms="), main, F.lit(".25 cpu_check_tail_ms=0.25 nccl_exchange_ms=1.5"), sync, F.lit(" communication_ms="), F.when(i % 59 == 0, "-4").otherwise("4"))
    lines = table(spark, sf_dir, "events").select(i.alias("attempt_id"), F.explode(F.array(line, F.lit("BENCHMARK_ITERATIONS iterations=3"))).alias("line"))
    found = runs.normalize_single(runs.parse_records(lines))
    return found.select("attempt_id", "lacks", *[F.col("rank_max_ms")[f"{name}_ms"].alias(f"{name}_ms") for name in runs.METRICS])


#: Timings of several ranks: the largest and the mean, as multiples of the run's size; and what each fault adds to one of them, tenfold.
LARGEST = {"gpu_main": 10, "main_loop": 10, "gpu_compute": 8, "graph_kernel": 7, "cpu_check_tail": 2, "cpu_check_drain": 2, "nccl_exchange": 3, "mpi_sync": 1, "postcheck_total": 2, "postcheck_mpi": 1, "communication": 5}
MEANS = {"gpu_main": 8, "main_loop": 8, "gpu_compute": 6, "graph_kernel": 5, "cpu_check_tail": 1, "cpu_check_drain": 1, "nccl_exchange": 2, "mpi_sync": 1, "postcheck_total": 2, "postcheck_mpi": 1, "communication": 4, "algorithm_total": 11}
TIMED = {**{f"{k}_ms": v for k, v in LARGEST.items()}, **{f"rank_{k}_avg_ms": v for k, v in MEANS.items()}, "rank_algorithm_total_max_ms": 14}
FAULTS = {
    "gpu_main_ms": (1, "alias_main"), "cpu_check_tail_ms": (1, "alias_drain"), "rank_gpu_main_avg_ms": (1, "alias_mean_main"), "rank_cpu_check_tail_avg_ms": (1, "alias_mean_drain"),
    "gpu_compute_ms": (9, "max_gpu_compute"), "graph_kernel_ms": (9, "max_graph_kernel"), "postcheck_mpi_ms": (9, "max_postcheck_mpi"), "rank_gpu_compute_avg_ms": (9, "mean_gpu_compute"),
    "rank_graph_kernel_avg_ms": (9, "mean_graph_kernel"), "rank_postcheck_mpi_avg_ms": (9, "mean_communication,mean_postcheck_mpi"), "rank_algorithm_total_avg_ms": (0.1, "mean_total"),
    "rank_algorithm_total_max_ms": (-0.4, "max_over_mean"), "rank_communication_avg_ms": (1, "mean_communication"), "rank_postcheck_total_avg_ms": (9, "mean_total"), "main_loop_ms": (-99, None), "mpi_sync_ms": (None, None),
}
MULTI_CASES = " ".join(f"WHEN f = {n} THEN '{broken}'" for n, (_, broken) in enumerate(FAULTS.values(), 1) if broken)
MULTI_METRICS = {f"rank_max_{m}_ms": TIMED["rank_algorithm_total_max_ms" if m == "algorithm_total" else f"{m}_ms"] for m in runs.METRICS} | {f"rank_mean_{m}_ms": TIMED[f"rank_{m}_avg_ms"] for m in runs.METRICS}


@query(f"""WITH t AS (SELECT event_id AS attempt_id, event_id % 23 AS f, 1 + event_id % 7 AS s FROM events), c AS (SELECT *, CASE f WHEN 15 THEN 'main_loop_ms' WHEN 16 THEN 'mpi_sync_ms' END AS lacks, CASE {MULTI_CASES} WHEN f NOT IN (15, 16) THEN '' END AS violations FROM t)
    SELECT attempt_id, lacks, violations, {', '.join(f"CASE WHEN violations = '' THEN ({times} * s)::DOUBLE END AS {name}" for name, times in MULTI_METRICS.items())} FROM c""")
def timing_invariants(spark, sf_dir):
    """Every relation is broken by one of the faults, which come round with the event's number."""
    i = F.col("event_id")
    fault = {name: n for n, name in enumerate(FAULTS, 1)}
    values = []
    for name, times in TIMED.items():
        value = (F.lit(times) * (1 + i % 7)).cast("double")
        more = FAULTS.get(name, (0, None))[0]
        values += [F.lit(name), value if name not in fault else F.when(i % 23 == fault[name], F.lit(None) if more is None else value * 1.0 + (1 + i % 7) * (10.0 * more)).otherwise(value)]
    found = runs.normalize_multi(table(spark, sf_dir, "events").select(i.alias("attempt_id"), F.create_map(*values).alias("timing"), F.lit(None).cast("string").alias("error")))
    names = [(aggregate, name) for aggregate in ("rank_max", "rank_mean") for name in runs.METRICS]
    return found.select("attempt_id", "lacks", "violations", *[F.col(f"{a}_ms")[f"{m}_ms"].alias(f"{a}_{m}_ms") for a, m in names])


@query(f"WITH {ATTEMPTS_SQL} SELECT attempt_id, record_id, status, phase, algorithm, dataset, method, repeat, finished_at::VARCHAR AS finished_at, iterations, rank_max_ms AS rank_max_algorithm_total_ms, round(rank_mean_ms, 6) AS rank_mean_algorithm_total_ms FROM a")
def attempt_flatten(spark, sf_dir):
    nested = attempts(spark, sf_dir).select(
        "attempt_id", "record_id", "status", "phase", F.struct("algorithm", "dataset", "method", "repeat").alias("identity"), F.struct(F.col("finished_at").cast("string").alias("finished_at")).alias("process"), F.struct("iterations").alias("emitted"),
        F.struct(F.create_map(F.lit("algorithm_total_ms"), F.col("rank_max_ms")).alias("rank_max_ms"), F.create_map(F.lit("algorithm_total_ms"), F.col("rank_mean_ms")).alias("rank_mean_ms")).alias("timing"),
    )
    return rounded(runs.flatten_attempts(nested), "rank_mean_algorithm_total_ms")


def _nested(spark, sf_dir) -> DataFrame:
    """The attempts as nested records; each kind of fault comes round with the attempt's number."""
    fault, good = F.col("attempt_id") % 61, F.col("status") == "success"
    odd = lambda n, wrong, right: F.when(fault == n, wrong).otherwise(right)
    text = lambda n, column: odd(n, F.lit("odd"), F.col(column))
    identity = F.struct(text(7, "algorithm").alias("algorithm"), text(8, "dataset").alias("dataset"), text(9, "method").alias("method"), odd(10, F.lit(0), F.col("repeat")).alias("repeat"), F.col("gpu_mode"), odd(11, F.lit(9), F.col("mpi_ranks")).alias("mpi_ranks"))
    times = lambda n, column: F.when(fault != n, F.create_map(F.lit("algorithm_total_ms"), F.col(column)))
    timing = F.struct(times(18, "rank_max_ms").alias("rank_max_ms"), times(19, "rank_mean_ms").alias("rank_mean_ms"))
    guard = F.struct(*[F.struct(odd(n, F.lit("changed"), F.lit("match")).alias("status")).alias(point) for n, point in ((22, "before"), (23, "after"))])
    return attempts(spark, sf_dir).select(
        F.col("attempt_id"), odd(1, F.lit("5"), F.lit("6")).alias("schema_version"), odd(2, F.lit("other"), F.lit("benchmark_attempt")).alias("record_type"), odd(3, F.lit(""), F.col("record_id")).alias("record_id"),
        odd(4, F.lit("odd"), F.concat_ws(".", "algorithm", "dataset")).alias("work_id"), text(5, "phase").alias("phase"), F.when(fault != 6, identity).alias("identity"), text(12, "status").alias("status"),
        F.when(fault != 13, F.struct(F.when(good & (fault != 14), 0).otherwise(1).alias("process_returncode"), F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss").alias("finished_at_utc"))).alias("process"),
        F.when(fault != 15, F.struct(odd(16, F.lit(0), F.col("iterations")).alias("iterations"))).alias("emitted"), F.when(F.when(good, fault != 17).otherwise(fault == 20), timing).alias("timing"),
        F.struct(F.when(fault != 21, guard).alias("execution_input_guard")).alias("provenance"),
    )


def _reason_sql(planned: str) -> str:
    """The first broken rule; ``planned``: whether the record is planned."""
    said = {4: "work_id differs", 5: "phase differs", 6: "identity is missing", 7: "identity.algorithm differs", 8: "identity.dataset differs", 9: "identity.method differs", 10: "identity.repeat differs"}
    cases = ["f = 1 THEN 'schema_version differs'", "f = 2 THEN 'record_type differs'", "f = 3 THEN 'record_id is missing'", f"NOT ({planned}) THEN 'record_id is not planned'", *[f"f = {n} THEN '{text}'" for n, text in said.items()]]
    cases += ["gpu_mode = 'other' THEN 'gpu_mode differs'", "f = 11 THEN 'mpi_ranks differ'", "f = 12 THEN 'unknown status'", "f IN (13, 15) THEN 'process or emitted is missing'"]
    good = {14: "return code is not zero", 16: "no iterations", 17: "no timing", 18: "no rank timings", 19: "no rank timings", 21: "no input guard", 22: "input guard before does not match", 23: "input guard after does not match"}
    cases += [f"status = 'success' AND f = {n} THEN '{text}'" for n, text in good.items()] + ["status <> 'success' AND f = 20 THEN 'failed with timing'"]
    return "CASE " + " ".join(f"WHEN {c}" for c in cases) + " END"


@query(f"""WITH {ATTEMPTS_SQL}, {EXPECTED_SQL} SELECT attempt_id, {_reason_sql('known')} AS reason FROM (SELECT a.*, attempt_id % 61 AS f, x.record_id IS NOT NULL AS known FROM a LEFT JOIN expected x ON x.record_id = a.record_id)""")
def attempt_validate(spark, sf_dir):
    return runs.validate_attempts(_nested(spark, sf_dir), _expected(spark))


def _files(spark, sf_dir) -> DataFrame:
    """The nested records as files; some are cut short, some hold no object, some nothing."""
    i = F.col("attempt_id")
    rows = _nested(spark, sf_dir)
    whole = F.to_json(F.struct(*rows.drop("attempt_id").columns))
    value = F.when(i % 103 == 0, F.substr(whole, F.lit(1), F.lit(40))).when(i % 107 == 0, F.concat(F.lit("["), whole, F.lit("]"))).when(i % 109 == 0, F.lit("")).otherwise(whole)
    return rows.select(F.concat(F.lit("raw/"), i.cast("string"), F.lit(".json")).alias("record_path"), value.alias("value"))


@query(f"""WITH {ATTEMPTS_SQL}, {EXPECTED_SQL}, r AS (SELECT *, {_reason_sql('known')} AS reason FROM (SELECT a.*, attempt_id % 61 AS f, x.record_id IS NOT NULL AS known, attempt_id % 103 = 0 OR attempt_id % 107 = 0 OR attempt_id % 109 = 0 AS bad, x.phase AS planned FROM a LEFT JOIN expected x ON x.record_id = a.record_id))
    SELECT concat('raw/', attempt_id, '.json') AS record_path, CASE WHEN bad OR f = 3 THEN '' ELSE record_id END AS record_id, CASE WHEN bad THEN '' WHEN f = 3 THEN phase ELSE coalesce(planned, CASE WHEN f = 5 THEN 'odd' ELSE phase END) END AS phase,
    CASE WHEN bad THEN 'not a JSON object' ELSE reason END AS reason FROM r WHERE bad OR reason IS NOT NULL""")
def invalid_attempts(spark, sf_dir):
    return runs.invalid_attempts(runs.parse_attempts(_files(spark, sf_dir)), _expected(spark))


@query(f"WITH {ATTEMPTS_SQL}, {LATEST_SQL} SELECT record_id, attempt_id, status, attempt_count, note FROM latest")
def latest_success(spark, sf_dir):
    return _latest(spark, sf_dir).select("record_id", "attempt_id", "status", "attempt_count", "note")


@query(f"WITH {ATTEMPTS_SQL}, {EXPECTED_SQL} SELECT record_id FROM expected WHERE record_id NOT IN (SELECT record_id FROM a WHERE status = 'success')")
def missing_identities(spark, sf_dir):
    """Records without a successful attempt."""
    return runs.missing_identities(_expected(spark), attempts(spark, sf_dir).where("status = 'success'")).select("record_id")


@query(f"WITH {ATTEMPTS_SQL}, {EXPECTED_SQL}, g AS (SELECT record_id, bool_or(status = 'success') AS good FROM a GROUP BY 1) SELECT record_id, coalesce(good, false) AS skip FROM expected LEFT JOIN g USING (record_id)")
def resume_policy(spark, sf_dir):
    return runs.resume_policy(_expected(spark), attempts(spark, sf_dir), retry_failed=True)


@query("""WITH x AS (SELECT p_name || '#' || p_partkey AS name, p_partkey AS k, sha256(p_type) AS d, sha256(CASE WHEN p_partkey % 9 = 0 THEN p_brand ELSE p_type END) AS d2 FROM part)
    SELECT name, CASE WHEN k % 10 = 0 THEN 'added' WHEN k % 10 = 1 THEN 'removed' WHEN d <> d2 THEN 'changed' ELSE 'match' END AS state FROM x""")
def input_drift(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")))
    key = F.col("p_partkey")
    before = part.where(key % 10 != 0).select("name", F.sha2("p_type", 256).alias("digest"))
    after = part.where(key % 10 != 1).select("name", F.sha2(F.when(key % 9 == 0, F.col("p_brand")).otherwise(F.col("p_type")), 256).alias("digest"))
    return runs.input_drift(before, after)


@query(f"{PAIR_QUERY} SELECT pair_id, pair_status, exclusion_reason, round(ov, 6) AS total_overhead_pct, round(ib, 6) AS imbalance_baseline_pct, round(ic, 6) AS imbalance_checked_pct FROM p")
def pair_samples(spark, sf_dir):
    names = ["total_overhead_pct", "imbalance_baseline_pct", "imbalance_checked_pct"]
    return rounded(_pairs(spark, sf_dir).select("pair_id", "pair_status", "exclusion_reason", *names), *names)


@query(f"{PAIR_QUERY} SELECT pair_id, exclusion_reason FROM p WHERE pair_status = 'environment_mismatch'")
def pair_environment(spark, sf_dir):
    return _pairs(spark, sf_dir).where("pair_status = 'environment_mismatch'").select("pair_id", "exclusion_reason")


@query(f"{PAIR_QUERY} SELECT pair_id, pair_status FROM p")
def pair_status(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", "pair_status")


@query(f"{PAIR_QUERY} SELECT pair_id, round(ov, 6) AS total_overhead_pct, round(mov, 6) AS mean_overhead_pct FROM p WHERE pair_status = 'eligible'")
def pair_overhead(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir).where("pair_status = 'eligible'").select("pair_id", "total_overhead_pct", "mean_overhead_pct"), "total_overhead_pct", "mean_overhead_pct")


@query(f"{PAIR_QUERY} SELECT pair_id, exclusion_reason FROM p WHERE pair_status <> 'eligible'")
def excluded_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).where("pair_status <> 'eligible'").select("pair_id", "exclusion_reason")


RANK_SQL = {"main_loop": "value", "gpu_compute": "value / 2", "graph_kernel": "value / 4", "cpu_check_drain": "event_id % 3", "nccl_exchange": "event_id % 5", "mpi_sync": "event_id % 7", "postcheck_total": "event_id % 11", "postcheck_mpi": "event_id % 2"}
RANK_SUMS = RANK_SQL | {"communication": "event_id % 5 + event_id % 7 + event_id % 2", "algorithm_total": "value + event_id % 3 + event_id % 11"}


@query(f"SELECT event_id // 4 AS run_id, {', '.join(f'round({f}(({sql})::DOUBLE), 6) AS rank_{name}_{metric}_ms' for metric, sql in RANK_SUMS.items() for name, f in (('max', 'max'), ('mean', 'avg')))} FROM events GROUP BY 1")
def rank_timing(spark, sf_dir):
    ranks = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("run_id"), *[F.expr(sql).cast("double").alias(f"{name}_ms") for name, sql in RANK_SQL.items()])
    return _stats_rounded(runs.rank_timing(ranks))


@query("SELECT run_id, round(CASE WHEN b > 0 THEN (m / b - 1) * 100 END, 6) AS imbalance_pct FROM (SELECT event_id // 4 AS run_id, max(value) AS m, avg(value) AS b FROM events GROUP BY 1)")
def rank_imbalance(spark, sf_dir):
    from .functions.runs import imbalance_pct

    by = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 4).alias("run_id")).agg(F.max("value").alias("m"), F.avg("value").alias("b"))
    return rounded(by.select("run_id", imbalance_pct(F.col("m"), F.col("b")).alias("imbalance_pct")), "imbalance_pct")


@query(f"SELECT user_id, {stats_sql('value', 'value')} FROM events GROUP BY user_id")
def sample_stats(spark, sf_dir):
    return _stats_rounded(table(spark, sf_dir, "events").groupBy("user_id").agg(*stats(F.col("value"), "value")))


IMBALANCE = "(CASE WHEN rank_mean_ms > 0 THEN (rank_max_ms / rank_mean_ms - 1) * 100 END)"


@query(f"WITH {ATTEMPTS_SQL}, {LATEST_SQL} SELECT algorithm, dataset, method, gpu_mode, count(*) AS samples, {stats_sql('rank_max_ms', 'total_ms')}, {stats_sql('iterations::DOUBLE', 'iterations')}, {stats_sql(IMBALANCE, 'imbalance_pct')} FROM latest WHERE phase = 'measure' AND status = 'success' GROUP BY 1, 2, 3, 4")
def method_summary(spark, sf_dir):
    return _stats_rounded(runs.method_summary(_latest(spark, sf_dir)))


@query(f"""{PAIR_QUERY} SELECT algorithm, dataset, gpu_mode, count(*) FILTER (pair_status <> 'missing_or_invalid') AS complete_pairs, count(*) FILTER (pair_status = 'eligible') AS eligible_pairs, count(*) FILTER (pair_status <> 'eligible') AS excluded_pairs,
    count(*) FILTER (pair_status = 'iteration_mismatch') AS iteration_mismatch_pairs, count(*) FILTER (pair_status = 'environment_mismatch') AS environment_mismatch_pairs, {stats_sql('ov', 'overhead_pct')} FROM p GROUP BY 1, 2, 3""")
def pair_summary(spark, sf_dir):
    return _stats_rounded(runs.pair_summary(_pairs(spark, sf_dir)))


@query(f"WITH {ATTEMPTS_SQL} SELECT status, count(*) AS attempts FROM a GROUP BY 1")
def status_counts(spark, sf_dir):
    return attempts(spark, sf_dir).groupBy("status").agg(F.count("*").alias("attempts"))


@query(f"{PAIR_QUERY} SELECT algorithm, dataset, count(*) AS mismatches FROM p WHERE pair_status = 'iteration_mismatch' GROUP BY 1, 2")
def mismatch_datasets(spark, sf_dir):
    return runs.mismatch_datasets(_pairs(spark, sf_dir))


@query(f"{PAIR_QUERY} SELECT algorithm, gpu_mode, {stats_sql('ov', 'overhead_pct')} FROM p GROUP BY 1, 2")
def plot_stats(spark, sf_dir):
    return _stats_rounded(_pairs(spark, sf_dir).groupBy("algorithm", "gpu_mode").agg(*stats(F.col("total_overhead_pct"), "overhead_pct")))


@query(f"""WITH RECURSIVE {ATTEMPTS_SQL}, {LATEST_SQL}, med AS (SELECT algorithm, dataset, method, quantile_cont(rank_max_ms, 0.5) AS med FROM latest WHERE phase = 'measure' AND status = 'success' GROUP BY 1, 2, 3),
    sc AS (SELECT algorithm, dataset, arg_min(med, list_position(['basic', 'multigpu_basic', 'tolerance_queue', 'multigpu'], method)) FILTER (med > 0) AS scale FROM med GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY scale NULLS LAST, dataset) AS rn FROM sc),
    f AS (SELECT algorithm, dataset, rn, scale AS low, 1 AS size, 0 AS no FROM o WHERE rn = 1 UNION ALL
        SELECT algorithm, dataset, rn, CASE WHEN ends THEN scale ELSE coalesce(low, scale) END, CASE WHEN ends THEN 1 ELSE size + 1 END, no + CASE WHEN ends THEN 1 ELSE 0 END
        FROM (SELECT o.*, f.low, f.size, f.no, f.size >= 8 OR coalesce(o.scale > f.low * 8, false) AS ends FROM f JOIN o ON o.algorithm = f.algorithm AND o.rn = f.rn + 1))
    SELECT algorithm, dataset, no AS group_no FROM f""")
def scale_groups(spark, sf_dir):
    return runs.scale_groups(runs.runtime_scales(runs.method_summary(_latest(spark, sf_dir))))


@query("""WITH m AS (SELECT c_custkey AS k, 'c' || c_custkey AS dataset, CASE WHEN c_custkey % 12 = 0 THEN '0' WHEN c_custkey % 25 = 0 THEN 'x' ELSE '100' END AS nodes, CASE WHEN c_custkey % 14 = 0 THEN '' ELSE '7' END AS edges, CASE WHEN c_custkey % 15 = 0 THEN 100 ELSE c_custkey % 100 END AS s FROM customer),
    t AS (SELECT *, TRY_CAST(nodes AS BIGINT) AS nn, TRY_CAST(edges AS BIGINT) AS ne, k % 10 <> 0 AS known FROM m)
    SELECT dataset, nullif(concat_ws(';', CASE WHEN k % 21 = 0 THEN 'missing graph' END, CASE WHEN NOT known THEN 'missing metadata' END, CASE WHEN known AND k % 10 = 7 THEN 'duplicate metadata' END, CASE WHEN known AND nn IS NULL THEN 'invalid nodes' END,
        CASE WHEN known AND ne IS NULL THEN 'invalid edges' END, CASE WHEN known AND (nn <= 0 OR ne <= 0) THEN 'nodes or edges not positive' END, CASE WHEN known AND NOT s BETWEEN 0 AND nn - 1 THEN 'source out of range' END), '') AS errors FROM t""")
def metadata_validate(spark, sf_dir):
    key = F.col("c_custkey")
    names = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), key.cast("string")).alias("dataset"))
    source = F.when(key % 15 == 0, F.lit(100)).otherwise(key % 100).cast("string")
    known = names.where(key % 10 != 0).select("dataset", F.when(key % 12 == 0, "0").when(key % 25 == 0, "x").otherwise("100").alias("nodes"), F.when(key % 14 == 0, "").otherwise(" 7").alias("edges"), source.alias("bfs_source"))
    return runs.validate_inputs(names.select("dataset"), names.where(key % 21 != 0).select("dataset"), known.unionByName(known.where(F.endswith("dataset", F.lit("7")))))


@query(f"WITH {ATTEMPTS_SQL}, {EXPECTED_SQL} SELECT DISTINCT record_id FROM a WHERE record_id NOT IN (SELECT record_id FROM expected)")
def ensure_subset(spark, sf_dir):
    return runs.outside(attempts(spark, sf_dir), _expected(spark).select("record_id"), "record_id")


@query("""SELECT o_orderkey, CASE WHEN s >= 86400 THEN concat(s // 86400, '-') ELSE '' END || concat_ws(':', lpad(CAST((s // 3600) % 24 AS VARCHAR), 2, '0'), lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0'), lpad(CAST(s % 60 AS VARCHAR), 2, '0')) AS budget
    FROM (SELECT o_orderkey, (o_orderkey % 50) * 4 * 1800 + 600 + o_orderkey % 60 AS s FROM orders)""")
def time_budget(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", duration((key % 50) * 4 * 1800 + 600 + key % 60).alias("budget"))


@query(f"""WITH {ATTEMPTS_SQL}, {EXPECTED_SQL}, g AS (SELECT record_id, count(*) AS n, bool_or(status = 'success') AS good FROM a GROUP BY 1), b AS (SELECT x.record_id AS x, g.* FROM expected x FULL JOIN g ON g.record_id = x.record_id)
    SELECT count(x) AS expected, count(*) FILTER (x IS NOT NULL AND n IS NOT NULL) AS observed, count(*) FILTER (x IS NOT NULL AND n IS NULL) AS missing, count(*) FILTER (x IS NULL) AS unplanned, coalesce(sum(n), 0)::BIGINT AS attempts, count(*) FILTER (x IS NOT NULL AND good) AS successes FROM b""")
def collection_report(spark, sf_dir):
    return runs.collection_report(_expected(spark), attempts(spark, sf_dir))


@query(f"{PAIR_QUERY} SELECT count(*) AS pairs, count(*) FILTER (pair_status = 'eligible') AS eligible, count(*) FILTER (pair_status <> 'eligible') AS excluded, round(quantile_cont(ov, 0.5), 6) AS median_overhead_pct FROM p")
def analysis_report(spark, sf_dir):
    return rounded(runs.analysis_report(_pairs(spark, sf_dir)), "median_overhead_pct")
