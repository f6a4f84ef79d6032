from collections import Counter
from datetime import datetime, timedelta

from graphloom.streaming import check_stream, degree_stream


def drain(spark, df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_degrees_of_a_stream(spark, tmp_path):
    for edges in [[(0, 1), (0, 1)], [(1, 0), (2, 2)]]:
        spark.createDataFrame(edges, "src long, dst long").write.mode("append").parquet(f"file://{tmp_path}/edges")
    stream = spark.readStream.schema("src long, dst long").parquet(f"file://{tmp_path}/edges")
    got = {r["id"]: (r["outdegree"], r["indegree"]) for r in drain(spark, degree_stream(stream), "degrees_now", "complete", tmp_path)}
    assert got == {0: (2, 1), 1: (1, 2), 2: (1, 1)}


def test_checks_of_a_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=20 * i), i, i == 4, False, i, 1) for i in range(9)]
    schema = "ts timestamp, iter int, dmr_error boolean, monotonic_error boolean, sum_abs_delta long, count_update long"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/checks")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/checks")
    got = drain(spark, check_stream(stream), "checks_now", "complete", tmp_path)
    assert Counter((r["last_iter"], r["dmr_error"], r["sum_abs_delta"], r["count_update"]) for r in got) == Counter([(2, False, 3, 3), (5, True, 12, 3), (8, False, 21, 3)])
