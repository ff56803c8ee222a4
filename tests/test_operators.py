import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dagql import catalog
from dagql.functions.counters import Counter, MeanCounter, observed
from dagql.operators import index
from dagql.operators import relational as R
from dagql.plans.jobspec import Job, JobSpec, Status
from dagql.streaming import windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_prefix_bounds_agree_with_tuples(spark, seed):
    r = random.Random(seed)
    data = [(r.randrange(5), r.randrange(5), r.randrange(5)) for _ in range(200)]
    d = spark.createDataFrame(data, "a int, b int, c int")
    low, high = tuple(r.randrange(5) for _ in range(r.randrange(1, 4))), tuple(r.randrange(5) for _ in range(r.randrange(1, 4)))
    want = sorted((x for x in data if x[: len(low)] >= low and x[: len(high)] <= high), key=repr)
    assert rows(index.range_search(d, ["a", "b", "c"], low, high)) == want


@pytest.mark.parametrize("seed", range(3))
def test_box_search_is_a_bag(spark, seed):
    r = random.Random(seed)
    boxes = [(x, y, x + r.random() * 3, y + r.random() * 3) for x, y in ((r.randrange(10) * 1.0, r.randrange(10) * 1.0) for _ in range(100))] * 2
    d = spark.createDataFrame(boxes, "x1 double, y1 double, x2 double, y2 double")
    want = sorted((b for b in boxes if b[0] <= 6 and b[2] >= 4 and b[1] <= 6 and b[3] >= 4), key=repr)
    assert rows(index.box_search(d, ["x1", "y1"], ["x2", "y2"], [4, 4], [6, 6])) == want


def test_sorted_load_is_found_again(spark, tmp_path):
    index.sorted_load(spark.range(1000).withColumn("v", F.col("id") * 2), str(tmp_path / "x"), ["id"], 4)
    assert rows(index.range_search(spark.read.parquet(str(tmp_path / "x")), ["id"], [10], [12])) == [(10, 20), (11, 22), (12, 24)]
    index.spatial_load(spark.createDataFrame([(0.1, 0.9), (0.5, 0.5)], "x double, y double"), str(tmp_path / "z"), ["x", "y"], [0, 0], [1, 1])
    assert spark.read.parquet(str(tmp_path / "z")).count() == 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.frozensets(st.sampled_from("abcdefgh"), min_size=1), min_size=1, max_size=12))
def test_jaccard_join_finds_every_pair(spark, sets):
    d = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "key int, tokens array<string>")
    want = sorted((i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(a & b) / len(a | b) >= 0.5)
    assert sorted((x.left_key, x.right_key) for x in index.jaccard_join(d, d, 0.5).collect()) == want


def test_numbers_follow_the_total_order(spark):
    d = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(7)
    assert all(r.v + 1 == r.rn for r in R.numbered(d, "v").collect())


def test_split_sends_each_row_once_and_nulls_to_the_rest(spark):
    d = spark.createDataFrame([(1,), (5,), (None,)], "a int")
    ports = R.split(d, small=F.col("a") < 3, low=F.col("a") < 9)
    assert {k: rows(v) for k, v in ports.items()} == {"small": [(1,)], "low": [(5,)], "rest": [(None,)]}


def test_integer_mean(spark):
    assert spark.createDataFrame([(7,), (8,), (None,)], "a int").agg(R.integer_mean("a")).first()[0] == 7
    assert spark.createDataFrame([], "a int").agg(R.integer_mean("a")).first()[0] == 0


def test_counters(spark):
    c, m = Counter(spark, "rows"), MeanCounter()
    spark.range(5).foreach(lambda _: c.add(1))
    assert (c.get(), c.update(2), c.set(3), c.get()) == (5, 7, 7, 3)
    assert [m.get(), m.set(4), m.set(7), m.get()] == [0, 0, 4, 5]
    d, seen = observed(spark.range(9), "seen", n=F.count(F.lit(1)))
    d.collect()
    assert seen.get["n"] == 9


def test_joins_pad_with_nulls_and_never_match_them(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "x int"), spark.createDataFrame([(1, "p"), (None, "q")], "y int, z string")
    assert rows(R.hash_join(a, b, [("x", "y")])) == [(1, 1, "p")]
    assert rows(R.hash_join(a, b, [("x", "y")], "left")) == [(1, 1, "p"), (None, None, None)]
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan(R.hash_join(a, spark.range(100).withColumnRenamed("id", "y"), [("x", "y")]))
    assert "ShuffledHashJoin" not in plan(R.hash_join(a, b, [("x", "y")]))  # of unknown size: a hash table can't spill
    big = spark.range(1 << 40).select(F.col("id").alias("y"))
    assert "Broadcast" not in R.replicate_join(a, big, [("x", "y")])._jdf.queryExecution().sparkPlan().toString()


def test_pipe_reports_a_failing_command(spark):
    assert rows(R.script_pipe(spark.range(3), "tac")) and rows(R.script_pipe(spark.range(3).coalesce(1), "cat")) == [("0",), ("1",), ("2",)]
    with pytest.raises(Exception, match="ended with"):
        R.script_pipe(spark.range(3), "false").collect()


def test_job_runs_ports_in_order_and_rejects_bad_graphs(spark):
    job = JobSpec()
    src = job.operator("source", source=spark.range(10))
    cut = job.operator("split", lambda d: R.split(d, low=F.col("id") < 3), outputs=2)
    both = job.operator("minus", lambda a, b: R.union_all(a, b.select(-F.col("id"))))
    job.connect("one_to_one", src, 0, cut, 0)
    job.connect("hashed", cut, 1, both, 1, keys=["id"])
    job.connect("spread", cut, 0, both, 0, n=2)
    job.root(both)
    job.constrain(both, 2, ["n1"])
    out = job.run()[both]
    assert rows(out) == sorted([(0,), (1,), (2,), *((-i,) for i in range(3, 10))], key=repr) and out.rdd.getNumPartitions() == 2
    assert '"in-operator-port": 1' in job.to_json() and "<- spread from 1.0" in job.explain()
    seen = []
    job.visit(lambda o: seen.append(o.name), lambda c: seen.append(c.kind))
    assert sorted(seen) == sorted(["source", "split", "minus", "one_to_one", "hashed", "spread"])
    with pytest.raises(ValueError):
        job.connect("hashed", src, 0, cut, 0, keys=["id"])
    with pytest.raises(ValueError):
        job.connect("teleport", src, 0, cut, 1)
    job.connect("one_to_one", both, 0, src, 0)
    with pytest.raises(ValueError):
        job.order()


def test_job_status_and_listeners(spark):
    seen = []
    j = Job(lambda: spark.range(3).count(), lambda: seen.append("start"), seen.append)
    assert j.status is Status.INITIALIZED
    assert j.start().wait() == 3 and seen == ["start", Status.TERMINATED]
    bad = Job(lambda: 1 / 0).start()
    with pytest.raises(ZeroDivisionError):
        bad.wait()
    assert bad.status is Status.FAILURE


def test_windows_over_a_stream(spark, tmp_path):
    data = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id % 2 AS k FROM range(240)")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "ts", "1 hour", ["k"], late="1 hour", n=F.count(F.lit(1))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert {(r.k, r.n) for r in spark.table("w").collect()} == {(0, 30), (1, 30)}
    finally:
        q.stop()


def test_components_merge_by_latest_row(spark, tmp_path):
    t = index.Components(spark, str(tmp_path / "t"), ["k"])
    t.append(spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", None)], "k int, v string, deleted boolean"), 0)
    t.append(spark.createDataFrame([(2, "B", None), (3, None, True)], "k int, v string, deleted boolean"), 1)
    assert rows(t.read()) == [(1, "a"), (2, "B")]
    m = t.merge(str(tmp_path / "m"))
    m.append(spark.createDataFrame([(4, "d")], "k int, v string"), 1)
    assert rows(m.read()) == [(1, "a"), (2, "B"), (4, "d")]
    index.sorted_load(spark.range(9), str(tmp_path / "b"), ["id"], 2, bloom=["id"])
    assert spark.read.parquet(str(tmp_path / "b")).where("id = 3").count() == 1


def test_deployed_code_and_shared_values_reach_tasks(spark, tmp_path):
    from dagql.plans.deploy import deploy, shared

    (tmp_path / "deployed_module.py").write_text("def f(x):\n    return x + 1\n")
    assert deploy(spark, [str(tmp_path / "deployed_module.py")]) == ["deployed_module.py"]
    with pytest.raises(FileNotFoundError):
        deploy(spark, [str(tmp_path / "none.py")])
    b = shared(spark, {"add": 10})

    def run(frames):
        import deployed_module

        for f in frames:
            yield f.assign(id=deployed_module.f(f.id) + b.value["add"])

    assert [r.id for r in spark.range(1).mapInPandas(run, "id long").collect()] == [11]


def test_numbers_follow_the_order_with_one_sort_and_nothing_cached(spark):
    d = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k", "id")
    n = R.numbered(d, "k")
    assert [(r.k, r.rn) for r in n.orderBy("rn").collect()] == [(i, i + 1) for i in range(5000)]
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "InMemoryTableScan" not in plan and "Sort" not in plan
    a, b = R.replicate(d, 2)
    assert "InMemoryTableScan" not in a.union(b)._jdf.queryExecution().executedPlan().toString() and a.count() == b.count() == 5000
    assert R.numbered(d.limit(0), "k").count() == 0


def test_asof_takes_the_greatest_of_equal_times(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 4, 2), ("b", 9, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, 10), ("a", 5, 30), ("a", 5, 20), ("b", 10, 1)], "k string, t int, v int")
    for r in (right, right.orderBy("v"), right.orderBy(F.desc("v"))):
        assert sorted((x.id, x.v) for x in R.asof_join(left, r, ["k"], "t", ["v"]).collect()) == [(1, 30), (2, None), (3, None)]


def test_grouping_sets_and_distinct_union(spark):
    d = spark.createDataFrame([("x", 1), ("x", 2), (None, 1)], "a string, b int")
    got = R.grouping_sets(d, [["a"], ["b"]], ["a", "b"], n=F.count(F.lit(1))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("x", None, 2), (None, None, 1), (None, 1, 2), (None, 2, 1)], key=repr)
    assert R.union_distinct(d, d).count() == 3


def test_partial_sums_come_before_shuffles_and_filters_before_explode(spark):
    plan = lambda name: catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for name in ("group_hash", "group_external_many_keys", "wordcount", "partial_final_agg"):
        p = plan(name)
        assert p.index("Exchange") < p.index("partial_"), name  # the tree's lower nodes come later in the text
    assert "Generate" not in plan("keyword_search")
