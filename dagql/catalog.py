"""The queries over the operators of this library, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagql.functions.counters import observed
from dagql.operators import connectors, index
from dagql.operators import relational as R
from dagql.plans import script
from dagql.plans import properties
from dagql.plans.jobspec import JobSpec
from dagql.sources import files, pull, sinks
from dagql.streaming import windows
from dagql.tables import new_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows():
    return F.count(F.lit(1))

# Scans, sinks and print formats.


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_nation(spark, d):
    return files.load(spark, f"{d}/nation.parquet", script.types.schema([("n_nationkey", "int"), ("n_name", "chararray"), ("n_regionkey", "int")]))


@query("SELECT n_regionkey AS c0, n_name AS c1 FROM nation")
def project_positions(spark, d):
    x = t(spark, d, "nation")
    return x.select(*[F.col(x.columns[i]).alias(f"c{k}") for k, i in enumerate([2, 1])])


@query("""SELECT n_nationkey || '; "' || n_name || '"; ' || n_regionkey AS line FROM nation""")
def print_format(spark, d):
    return sinks.print_tuples(t(spark, d, "nation"))


@query("SELECT concat_ws('|', n_name, n_nationkey, n_name) AS line FROM nation")
def delimited_line(spark, d):
    return sinks.delimited_line(t(spark, d, "nation"), [1, 0, 1], "|")


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""")
def result_json(spark, d):
    return sinks.serialize(t(spark, d, "region"))


@query("SELECT 1 + 1 AS x")
def constant_row(spark, d):
    return files.single_row(spark).select((F.lit(1) + 1).alias("x"))


class Squares(pull.RecordReader):
    def open(self, split):
        self.rows = iter((split, i, i * i) for i in range(5))

    def read(self):
        return next(self.rows, None)


@query("SELECT s AS split, i, i * i AS square FROM range(4) a(s), range(5) b(i)")
def pull_reader(spark, d):
    return pull.read_with(spark, Squares, "split long, i long, square long", range(4))


ORDER_FIELDS = script.types.schema([("o_orderkey", "long"), ("o_custkey", "long"), ("o_orderstatus", "chararray"), ("o_totalprice", "double")])


def _orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")


ORDERS_SQL = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders"


@query(ORDERS_SQL)
def delimited_load(spark, d):
    """Lines with a delimiter at their end, in two parts; empty text fields stay empty."""
    one, two = new_path(spark, "tbl"), new_path(spark, "tbl")
    for path, rest in ((one, 0), (two, 1)):
        sinks.write_delimited(_orders(spark, d).where(F.col("o_orderkey") % 2 == rest).withColumn("end", F.lit("")), path, sep="|")
    return files.read_delimited(spark, [one, two], ORDER_FIELDS)


@query("SELECT s_suppkey, s_name FROM supplier")
def fixed_width_load(spark, d):
    """A parser of another kind."""
    path = new_path(spark, "txt")
    t(spark, d, "supplier").select(F.concat(F.rpad(F.col("s_suppkey").cast("string"), 12, " "), F.col("s_name"))).write.text(path)
    return files.load(spark, path, script.types.schema([("s_suppkey", "long"), ("s_name", "chararray")]), parser=files.FixedWidth((12, 40)))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000")
def delimited_write(spark, d):
    """Chosen fields in another order, written and read back."""
    path = new_path(spark, "csv")
    sinks.write_delimited(t(spark, d, "orders").where("o_totalprice > 200000"), path, [1, 0], ";")
    return files.read_delimited(spark, [path], script.types.schema([("o_custkey", "long"), ("o_orderkey", "long")]), ";")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def script_dump(spark, d):
    """A script's dump to two splits, read back by another script."""
    out = f"{new_path(spark, 'out')},{new_path(spark, 'out')}"
    script.run(spark, f'N = load "{d}/nation.parquet" as (n_nationkey: int, n_name: chararray, n_regionkey: int); S = filter N by n_regionkey == 1; dump S into "{out}";').write()
    return script.run(spark, f'R = load "{out}" as (n_nationkey: int, n_name: chararray, n_regionkey: int);').relations["R"].drop("n_regionkey")


class LineWriter(sinks.TupleWriter):
    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file:")

    def open(self, partition):
        import os

        os.makedirs(self.folder, exist_ok=True)
        self.file = open(f"{self.folder}/part-{partition}.txt", "w")  # noqa: SIM115

    def write(self, row):
        self.file.write(f"{row[0]}:{row[1]}\n")

    def close(self):
        self.file.close()


@query("SELECT r_regionkey, r_name FROM region")
def user_writer(spark, d):
    """A writer of the user's for each partition; here to files of the shared folder."""
    path = new_path(spark, "lines")
    sinks.write_with(t(spark, d, "region").select("r_regionkey", "r_name"), lambda: LineWriter(path))
    return files.read_delimited(spark, [path], script.types.schema([("r_regionkey", "int"), ("r_name", "chararray")]), ":")


@query("SELECT '<' || n_nationkey || '>' || chr(9) || upper(n_name) AS line FROM nation")
def print_per_field(spark, d):
    """A printer of its own for each field."""
    return sinks.print_with(t(spark, d, "nation").select("n_nationkey", "n_name"), [lambda c: F.concat(F.lit("<"), c.cast("string"), F.lit(">")), F.upper], "\t")


@query("SELECT r_regionkey || '=' || r_name AS value FROM region")
def result_own_serializer(spark, d):
    return sinks.serialize(t(spark, d, "region"), serializer=lambda row: F.concat_ws("=", *row))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '[\\r\\n]', ' ', 'g'), ' ')) AS word FROM benchmark) WHERE word <> '' GROUP BY word")
def properties_job(spark, d):
    """A job named by its properties, from text lines to delimited lines."""
    lines, out = new_path(spark, "txt"), new_path(spark, "out")
    t(spark, d, "benchmark").select(F.regexp_replace("text", "[\r\n]", " ")).write.text(lines)
    properties.run(spark, f"job = word_count\ninput.paths = {lines}\noutput.path = {out}\nfield.separator = |\n")
    return files.read_delimited(spark, [out], script.types.schema([("word", "chararray"), ("n", "long")]))


# Scripts.


def _script(spark, d, text):
    return script.run(spark, text.replace("@", d)).dumps[-1][1]


ORDERS = 'R = load "@/orders.parquet" as (o_orderkey: long, o_custkey: long, o_totalprice: double);'


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def script_load(spark, d):
    return _script(spark, d, ORDERS + ' dump R into "out";')


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 37")
def script_filter_eq(spark, d):
    return _script(spark, d, ORDERS + ' S = filter R by o_custkey == 37; dump S into "out";')


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size < 10 AND p_retailprice >= 950 OR p_size = 49")
def script_filter_bool(spark, d):
    return _script(spark, d, 'P = load "@/part.parquet" as (p_partkey: long, p_size: int, p_retailprice: double); Q = filter P by p_size < 10 and p_retailprice >= 950.0 or P.p_size == 49; dump Q into "out";')


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber * 2 + 1 > 5 AND l_orderkey % 7 = 3")
def script_filter_arith(spark, d):
    return _script(spark, d, 'L = load "@/lineitem.parquet" as (l_orderkey: long, l_linenumber: int, l_quantity: double); M = FILTER L BY l_linenumber * 2 + 1 > 5 AND l_orderkey % 7 == 3; dump M into "out";')


@query("SELECT p_partkey, p_size FROM part WHERE p_size // 7 - 2 >= 3 AND p_size / 4.0 <> 10.0 AND 100 // nullif(p_size % 3, 0) >= 50")
def script_filter_divide(spark, d):
    return _script(spark, d, 'P = load "@/part.parquet" as (p_partkey: long, p_size: int); Q = filter P by p_size / 7 - 2 >= 3 and p_size / 4.0 != 10.0 and 100 / (p_size % 3) >= 50; dump Q into "out";')


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <= 'BUILDING' OR c_mktsegment = 'MACHINERY'")
def script_filter_string(spark, d):
    return _script(spark, d, """C = load "@/customer.parquet" as (c_custkey: long, c_mktsegment: chararray); S = filter C by c_mktsegment <= "BUILDING" or c_mktsegment == 'MACHINERY'; dump S into "out";""")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT (s_acctbal < 0 OR s_nationkey IS NULL) AND -s_acctbal < -100.0")
def script_extended(spark, d):
    return _script(spark, d, 'S = load "@/supplier.parquet" as (s_suppkey: long, s_nationkey: int, s_acctbal: double); /* kept */ T = filter S by not (s_acctbal < 0 or s_nationkey is null) and -s_acctbal < -100.0; dump T into "out";').select("s_suppkey", "s_acctbal")


# Sorts.


@query("SELECT n_name, row_number() OVER (ORDER BY n_name) AS rn FROM nation")
def micro_sort_rank(spark, d):
    x = R.micro_sort(connectors.gathered(t(spark, d, "nation").select("n_name")), "n_name")
    return R.numbered(x, "n_name")


@query("SELECT c_name AS value, row_number() OVER (ORDER BY c_name COLLATE \"C\") AS rn FROM customer")
def line_sort(spark, d):
    return R.numbered(t(spark, d, "customer").select(F.col("c_name").alias("value")), "value")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_orders(spark, d):
    return R.top_k(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def limit_sorted(spark, d):
    return R.top_k(t(spark, d, "orders").select("o_orderkey", "o_custkey"), 100, "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def topk_per_key(spark, d):
    return R.top_k_by(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 3, ["o_custkey"], F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders")
def ordered_result(spark, d):
    return R.numbered(R.sort(t(spark, d, "orders").select("o_orderkey"), "o_orderkey"), "o_orderkey")


# Connectors.


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def hash_partition_counts(spark, d):
    return R.group(connectors.hashed(t(spark, d, "orders").select("o_custkey"), ["o_custkey"]), ["o_custkey"], n=rows())


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def hash_merge(spark, d):
    return connectors.hashed_merged(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders")
def range_partition_sorted(spark, d):
    return R.numbered(connectors.ranged(t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]), "o_orderkey")


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
def spread_and_gather(spark, d):
    return R.group(connectors.gathered(connectors.one_to_one(connectors.spread(t(spark, d, "orders").select("o_orderkey"), 4))), [], n=rows(), s=F.sum("o_orderkey"))


# Joins.


@query("SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def replicate_join(spark, d):
    o, c, x = t(spark, d, "orders").select("o_custkey"), t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "nation").select("n_nationkey", "n_name")
    return R.group(R.replicate_join(R.replicate_join(o, c, [("o_custkey", "c_custkey")]), x, [("c_nationkey", "n_nationkey")]), ["n_name"], n=rows())


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def hash_join_inner(spark, d):
    o, l = t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), t(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    return R.group(R.hash_join(l, o, [("l_orderkey", "o_orderkey")]), ["o_orderpriority"], n=rows(), quantity=R.exact_sum("l_quantity"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def hash_join_left_outer(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey", "o_orderkey")
    return R.hash_join(t(spark, d, "customer").select("c_custkey"), o, [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")


NULLED = "(SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier)"


@query(f"SELECT a.k, count(*) AS n FROM {NULLED} a JOIN (SELECT nullif(n_nationkey, 3) AS k FROM nation) b ON a.k = b.k GROUP BY a.k")
def null_key_join(spark, d):
    s = t(spark, d, "supplier").select(F.nullif("s_nationkey", F.lit(3)).alias("k"))
    x = t(spark, d, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("j"))
    return R.group(R.equi_join(s, x, [("k", "j")]), ["k"], n=rows())


@query(f"SELECT a.k, count(*) AS n FROM {NULLED} a JOIN (SELECT nullif(n_nationkey, 3) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.k")
def null_safe_join(spark, d):
    s = t(spark, d, "supplier").select(F.nullif("s_nationkey", F.lit(3)).alias("k"))
    x = t(spark, d, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("j"))
    return R.group(R.equi_join(s, x, [("k", "j")], null_safe=True), ["k"], n=rows())


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey < r_regionkey")
def nested_loop_theta(spark, d):
    a, b = t(spark, d, "nation"), t(spark, d, "region")
    return R.theta_join(a, b, a.n_nationkey < b.r_regionkey).select("n_nationkey", "r_regionkey")


@query("SELECT r_regionkey, n_nationkey FROM region LEFT JOIN nation ON n_nationkey < r_regionkey")
def nested_loop_left(spark, d):
    a, b = t(spark, d, "region"), t(spark, d, "nation")
    return R.theta_join(a, b, b.n_nationkey < a.r_regionkey, "left").select("r_regionkey", "n_nationkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def subplan_exists(spark, d):
    return R.exists(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").where("o_totalprice > 400000"), [("c_custkey", "o_custkey")])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, d):
    return R.exists(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").where("o_totalprice > 400000"), [("c_custkey", "o_custkey")], negated=True)


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 25")
def interval_join(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return R.interval_join(t(spark, d, "part").select("p_partkey", "p_retailprice"), s, "p_retailprice", "low", "high", 50).select("p_partkey", "s_suppkey")


@query("SELECT a.event_id, b.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_join(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return R.asof_join(e.where("event_type <> 'purchase'"), buys, ["user_id"], "ts", ["last_purchase"]).select("event_id", "last_purchase")


# Groups.


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_hash(spark, d):
    return R.group(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=rows(), s=R.exact_sum("l_quantity"), lo=F.min("l_quantity"), hi=F.max("l_quantity"), mean=R.exact_sum("l_quantity") / rows())


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY l_orderkey")
def group_preclustered(spark, d):
    return R.group_clustered(t(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), ["l_orderkey"], n=rows(), s=R.exact_sum("l_extendedprice"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n, max(l_tax) AS tax FROM lineitem GROUP BY l_partkey, l_suppkey")
def group_external_many_keys(spark, d):
    return R.group(t(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], n=rows(), tax=F.max("l_tax"))


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
def partial_final_agg(spark, d):
    return R.map_combine_reduce(t(spark, d, "orders"), lambda x: x.select("o_orderstatus", "o_custkey"), ["o_orderstatus"], n=rows(), s=F.sum("o_custkey"))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def scalar_agg(spark, d):
    return R.group(t(spark, d, "lineitem"), [], n=rows(), s=F.sum("l_linenumber"), lo=F.min("l_shipdate"), hi=F.max("l_shipdate"))


@query("SELECT p_brand, CAST(sum(p_size) // count(p_size) AS BIGINT) AS mean FROM part GROUP BY p_brand")
def int_mean_counter(spark, d):
    return R.group(t(spark, d, "part"), ["p_brand"], mean=R.integer_mean("p_size"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def wordcount(spark, d):
    return R.word_count(t(spark, d, "documents"))


@query("SELECT n_regionkey, len(list(n_nationkey)) AS size, list_sort(list(n_nationkey))[1] AS least FROM nation GROUP BY n_regionkey")
def nested_bag(spark, d):
    return R.group_bag(t(spark, d, "nation"), ["n_regionkey"], ["n_nationkey", "n_name"]).select("n_regionkey", F.size("bag").cast("long").alias("size"), F.col("bag")[0]["n_nationkey"].alias("least"))


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS so_far FROM orders")
def running_agg(spark, d):
    x = R.running(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], so_far=F.sum(F.col("o_totalprice").cast("decimal(18,2)")))
    return x.select("o_orderkey", F.col("so_far").cast("double").alias("so_far"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(rows().alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(rows().alias("n"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets(spark, d):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return R.grouping_sets(t(spark, d, "lineitem").select(*keys), [keys[:2], keys[2:], []], keys, n=rows())


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def distinct_agg(spark, d):
    return R.group(t(spark, d, "lineitem"), ["l_returnflag"], parts=F.count_distinct("l_partkey"))


# Several inputs and outputs.


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT p_partkey FROM part")
def union_all(spark, d):
    return R.union_all(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "supplier").select("s_suppkey"), t(spark, d, "part").select("p_partkey"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'rest' END AS port FROM orders")
def split_outputs(spark, d):
    ports = R.split(t(spark, d, "orders"), high=F.col("o_totalprice") > 300000, done=F.col("o_orderstatus") == "F")
    return R.union_all(*[x.select("o_orderkey", F.lit(k).alias("port")) for k, x in ports.items()])


@query("WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT x.n, count(*) AS pairs FROM a x JOIN a y ON x.n = y.n GROUP BY x.n")
def materialize_reuse(spark, d):
    a = R.group(t(spark, d, "orders"), ["o_custkey"], n=rows())
    x, y = R.replicate(R.group(a, ["n"], same=rows()), 2)  # pairs are counted by products, not made
    return R.equi_join(x, y.select(F.col("n").alias("m"), F.col("same").alias("as_many")), [("n", "m")]).select("n", (F.col("same") * F.col("as_many")).alias("pairs"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct(spark, d):
    return t(spark, d, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return R.union_distinct(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def except_(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT page_id, i - 1 AS pos, part FROM (SELECT page_id, unnest(string_split(url, '/')) AS part, generate_subscripts(string_split(url, '/'), 1) AS i FROM pages)")
def unnest_tokens(spark, d):
    x = R.unnest(t(spark, d, "pages").select("page_id", F.split("url", "/").alias("parts")), "parts", "part", position="pos")
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), "part")


# Searches.


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 37")
def btree_point(spark, d):
    return index.range_search(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], [37], [37])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey > 100 OR l_orderkey = 100 AND l_linenumber >= 3) AND l_orderkey <= 120")
def btree_prefix_range(spark, d):
    return index.range_search(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], [100, 3], [120])


BOXES = "SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount AS y1, l_quantity + 2 AS x2, l_discount + 0.01 AS y2 FROM lineitem"


def _boxes(spark, d):
    q, r = F.col("l_quantity"), F.col("l_discount")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("x1"), r.alias("y1"), (q + 2).alias("x2"), (r + 0.01).alias("y2"))


@query(f"SELECT l_orderkey, l_linenumber FROM ({BOXES}) WHERE x1 <= 12 AND x2 >= 10 AND y1 <= 0.055 AND y2 >= 0.045")
def rtree_intersect(spark, d):
    return index.box_search(_boxes(spark, d), ["x1", "y1"], ["x2", "y2"], [10, 0.045], [12, 0.055]).select("l_orderkey", "l_linenumber")


SITES = "SELECT s_suppkey AS {0}key, s_acctbal / 100 AS {0}x1, CAST(s_nationkey AS DOUBLE) AS {0}y1, s_acctbal / 100 + 3 AS {0}x2, s_nationkey + 1.5 AS {0}y2 FROM supplier"


@query(f"SELECT akey, bkey FROM ({SITES.format('a')}) JOIN ({SITES.format('b')}) ON ax1 <= bx2 AND ax2 >= bx1 AND ay1 <= by2 AND ay2 >= by1")
def spatial_join(spark, d):
    s = t(spark, d, "supplier")

    def side(p):
        x, y = F.col("s_acctbal") / 100, F.col("s_nationkey").cast("double")
        return s.select(F.col("s_suppkey").alias(f"{p}key"), x.alias(f"{p}x1"), y.alias(f"{p}y1"), (x + 3).alias(f"{p}x2"), (y + 1.5).alias(f"{p}y2"))

    names = ("x1", "y1", "x2", "y2")
    return index.box_join(side("a"), side("b"), [f"a{c}" for c in names], [f"b{c}" for c in names], 4.0).select("akey", "bkey")


@query("SELECT c_custkey, CAST(list_sum([(((floor((c_acctbal + 1000) / 11000 * 256)::BIGINT >> i) & 1) << (2 * i)) + (((floor(c_nationkey / 25.0 * 256)::BIGINT >> i) & 1) << (2 * i + 1)) FOR i IN range(8)]) AS BIGINT) AS z FROM customer")
def curve_order(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", index.z_order(["c_acctbal", "c_nationkey"], [-1000, 0], [10000, 25], 8).alias("z"))


@query("SELECT doc_id AS key FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'and', 'license'])")
def keyword_search(spark, d):
    return index.keyed_search(t(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("license"))), "doc_id", index.word_tokens(F.col("text")), ["the", "and", "license"])


@query("SELECT doc_id AS key FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'license'])")
def keyword_index_search(spark, d):
    """The inverted index as a table dealt and sorted by token, and a search that reads its tokens' files."""
    path = new_path(spark)
    index.sorted_load(index.token_table(t(spark, d, "documents"), "doc_id", index.word_tokens(F.col("text"))), path, ["token", "key"])
    return index.search_all(spark.read.parquet(path), ["the", "license"])


@query("SELECT p_partkey AS key FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'ing')")
def ngram_search(spark, d):
    x = index.token_table(t(spark, d, "part"), "p_partkey", index.gram_tokens(F.col("p_name")))
    return index.search_all(x, ["red", "ing"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 200 AND 260")
def btree_bulk_load(spark, d):
    path = new_path(spark)
    index.sorted_load(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), path, ["l_orderkey", "l_linenumber"], 4)
    return index.range_search(spark.read.parquet(path), ["l_orderkey"], [200], [260])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 41")
def bloom_point(spark, d):
    path = new_path(spark)
    index.sorted_load(t(spark, d, "orders").select("o_orderkey", "o_custkey"), path, ["o_orderkey"], 4, bloom=["o_custkey"])
    return index.range_search(spark.read.parquet(path), ["o_custkey"], [41], [41])


@query(f"SELECT l_orderkey, l_linenumber FROM ({BOXES}) WHERE x1 <= 22 AND x2 >= 20 AND y1 <= 0.035 AND y2 >= 0.025")
def rtree_bulk_load(spark, d):
    path = new_path(spark)
    index.spatial_load(_boxes(spark, d), path, ["x1", "y1"], [0, 0], [50, 0.1])
    return index.box_search(spark.read.parquet(path), ["x1", "y1"], ["x2", "y2"], [20, 0.025], [22, 0.035]).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 6 <> 0")
def lsm_components(spark, d):
    """A component, one of new values, one of deletions, merged."""
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit(False).alias("deleted"))
    tree = index.Components(spark, new_path(spark, "lsm"), ["c_custkey"])
    tree.append(c, 0)
    tree.append(c.where("c_custkey % 4 = 0").withColumn("c_nationkey", F.lit(-1)), 1)
    tree.append(c.where("c_custkey % 6 = 0").withColumn("deleted", F.lit(True)), 2)
    return tree.merge(new_path(spark, "lsm")).read()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.07)")
def index_probe(spark, d):
    path = new_path(spark)
    index.sorted_load(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), path, ["o_orderkey"], 4)
    keys = t(spark, d, "lineitem").where("l_quantity = 50 AND l_discount = 0.07").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return index.probe(keys, spark.read.parquet(path), "o_orderkey").select("o_orderkey", "o_totalprice")


WORDS = "SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark"


@query(f"SELECT left_key, right_key, jaccard FROM (SELECT a.item_id AS left_key, b.item_id AS right_key, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS jaccard FROM ({WORDS}) a, ({WORDS}) b WHERE a.item_id < b.item_id) WHERE jaccard >= 0.15")
def jaccard_join(spark, d):
    x = t(spark, d, "benchmark").select(F.col("item_id").alias("key"), index.word_tokens(F.col("text")).alias("tokens"))
    return index.jaccard_join(x, x, 0.15).where("left_key < right_key")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 3 = 0")
def insert_new(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return index.insert_new(s.where("s_suppkey % 2 = 0"), s.where("s_suppkey % 3 = 0").union(s.where("s_suppkey % 6 = 0")), ["s_suppkey"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0")
def delete_upsert(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return index.delete(index.upsert(s, s.where("s_suppkey % 3 = 0").withColumn("s_nationkey", F.lit(-1)), ["s_suppkey"]), s.where("s_suppkey % 5 = 0"), ["s_suppkey"])


# User operators and jobs.


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem")
def map_in_pandas(spark, d):
    def make(_):
        def run(frames):
            for f in frames:
                yield f.assign(twice=f.l_quantity * 2)[["l_orderkey", "l_linenumber", "twice"]]

        return run

    return R.per_partition(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), make, "l_orderkey long, l_linenumber int, twice double")


@query("SELECT concat_ws(chr(9), n_nationkey, n_name) AS line FROM nation")
def script_pipe_identity(spark, d):
    return R.script_pipe(t(spark, d, "nation").select("n_nationkey", "n_name"), "cat")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def job_dag(spark, d):
    job = JobSpec()
    scan = job.operator("scan", source=t(spark, d, "orders").select("o_orderstatus", "o_totalprice"))
    some = job.operator("filter", lambda x: x.where("o_totalprice > 100000"))
    count = job.operator("count", lambda x: R.group(x, ["o_orderstatus"], n=rows()))
    job.connect("one_to_one", scan, 0, some, 0)
    job.connect("hashed", some, 0, count, 0, keys=["o_orderstatus"])
    job.root(count)
    return job.run()[count]


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def observed_rows(spark, d):
    x, _ = observed(t(spark, d, "orders"), "orders", rows=rows())
    return R.group(x, ["o_orderstatus"], n=rows())


# Extensions: windows of time.


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    return windows.tumbling(t(spark, d, "events"), "ts", "1 hour", ["event_type"], n=rows()).drop("end")


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s")
def session_windows(spark, d):
    return windows.sessions(t(spark, d, "events"), "ts", "2 hours", ["user_id"], n=rows()).drop("end")


@query("SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL")
def sliding_windows(spark, d):
    return windows.tumbling(t(spark, d, "events"), "ts", "1 hour", ["event_type"], slide="30 minutes", n=rows()).drop("end")


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_within(spark, d):
    """Over a stream that reads the table once; no two rows of a key are further apart than the delay."""
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(f"{d}/[e]vents.parquet")
    out = windows.distinct_within(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type")
    path = new_path(spark)
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(path)


# Decision-support mixes.


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def tpch_q1(spark, d):
    x = t(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return R.group(x, ["l_returnflag", "l_linestatus"], qty=R.exact_sum("l_quantity"), revenue=R.exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), n=rows())


@query("SELECT o_orderkey, o_orderdate, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10")
def tpch_q3(spark, d):
    c = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t(spark, d, "orders").where("o_orderdate < timestamp_ntz'1995-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    l = t(spark, d, "lineitem").where("l_shipdate > timestamp_ntz'1995-03-15'").select("l_orderkey", "l_extendedprice", "l_discount")
    x = R.equi_join(R.equi_join(o, c, [("o_custkey", "c_custkey")]), l, [("o_orderkey", "l_orderkey")])
    x = R.group(x, ["o_orderkey", "o_orderdate"], revenue=R.exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4))
    return R.top_k(x, 10, F.desc("revenue"), "o_orderkey")


@query("SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2 GROUP BY n_name")
def tpch_q5(spark, d):
    region = R.replicate_join(t(spark, d, "nation"), t(spark, d, "region").where("r_regionkey = 2"), [("n_regionkey", "r_regionkey")]).select("n_nationkey", "n_name")
    s = R.replicate_join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), region, [("s_nationkey", "n_nationkey")])
    c = R.replicate_join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), region.select("n_nationkey"), [("c_nationkey", "n_nationkey")])
    o = R.replicate_join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), c.select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")])
    x = R.replicate_join(t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), s.select("s_suppkey", "s_nationkey", "n_name"), [("l_suppkey", "s_suppkey")])
    x = R.equi_join(x, o, [("l_orderkey", "o_orderkey"), ("s_nationkey", "c_nationkey")])
    return R.group(x, ["n_name"], revenue=R.exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4))


@query("SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6(spark, d):
    x = t(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1994-01-01' AND l_shipdate < timestamp_ntz'1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
    return R.group(x, [], revenue=R.exact_sum(F.col("l_extendedprice") * F.col("l_discount"), 4))


@query("SELECT c_mktsegment, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def market_segments(spark, d):
    x = R.equi_join(t(spark, d, "orders").select("o_custkey"), t(spark, d, "customer").select("c_custkey", "c_mktsegment"), [("o_custkey", "c_custkey")])
    return R.group(x, ["c_mktsegment"], n_orders=rows())


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
