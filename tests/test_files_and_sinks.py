import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagql import types
from dagql.functions.counters import MeanCounter
from dagql.plans import properties, script
from dagql.sources import files, sinks
from dagql.sources.files import FileSplit

SCHEMA = types.schema([("k", "int"), ("name", "chararray"), ("r", "int"), ("comment", "chararray")])


@pytest.fixture
def nations(tmp_path):
    rows = [(i, f"NAME {(i * 7) % 25:02d}", i % 5, f"comment {i}, \"quoted\"") for i in range(25)]
    (tmp_path / "nation.tbl").write_text("".join("|".join(map(str, r)) + "|\n" for r in rows))
    return rows, str(tmp_path / "nation.tbl")


def test_trailing_delimiter_adds_no_field(spark, nations):
    rows, path = nations
    d = files.read_delimited(spark, [path], SCHEMA)
    assert sorted(map(tuple, d.collect())) == rows


def test_scan_micro_sort_write_prints_the_expected_lines(spark, nations):
    rows, path = nations
    d = files.read_delimited(spark, [path], SCHEMA).coalesce(1).sortWithinPartitions("name")
    got = [r.line for r in sinks.print_tuples(d).collect()]
    assert got == [f'{k}; "{n}"; {r}; "{c}"' for k, n, r, c in sorted(rows, key=lambda x: x[1])]


def test_lines_sort_by_bytes(spark, tmp_path):
    lines = [f"{i}|x" for i in range(1, 151)] + ["é", "z", "Z"]
    random.Random(1).shuffle(lines)
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    got = [r.value for r in files.read_lines(spark, str(tmp_path / "in.txt")).orderBy("value").collect()]
    assert got == sorted(lines, key=lambda s: s.encode())


def test_splits_and_properties():
    assert FileSplit.parse("n1:/a/b.tbl, n2:/c") == [FileSplit("n1", "/a/b.tbl"), FileSplit("n2", "/c")]
    assert FileSplit.parse("hdfs://host:1/x") == [FileSplit("", "hdfs://host:1/x")]
    with pytest.raises(ValueError):
        FileSplit.parse(" ")
    assert files.read_properties(" a = b=c \nnone\nx=") == {"a": "b=c", "x": ""}


def test_type_names():
    assert [f.name for f in types.schema(["int", "bag"])] == ["f0", "f1"]
    assert types.spark_type("CHARARRAY").simpleString() == "string"
    with pytest.raises(ValueError):
        types.spark_type("date")


def test_delimited_writer_repeats_and_quotes_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a,"b"', None)], "a int, b string, c string")
    assert sinks.delimited_line(d).first().line == '1,a,"b",'
    assert sinks.delimited_line(d, [1, 0, 0], ";").first().line == 'a,"b";1;1'


class Collect(sinks.TupleWriter):
    def __init__(self, path):
        self.path = path

    def open(self, partition):
        self.file = open(f"{self.path}/{partition}.txt", "w")  # noqa: SIM115

    def write(self, row):
        if row.id == 99:
            raise ValueError("bad row")
        self.file.write(f"{row.id}\n")

    def fail(self):
        self.file.write("failed\n")

    def close(self):
        self.file.close()


def test_user_writers_run_for_each_partition(spark, tmp_path):
    path = str(tmp_path)
    sinks.write_with(spark.range(10).repartition(3), lambda: Collect(path))
    assert sorted(int(x) for p in tmp_path.iterdir() for x in p.read_text().split()) == list(range(10))
    with pytest.raises(Exception, match="bad row"):
        sinks.write_with(spark.range(98, 100).coalesce(1), lambda: Collect(path))
    assert "failed" in (tmp_path / "0.txt").read_text()


def test_results_are_read_in_order(spark):
    r = sinks.ResultReader(spark.range(100).orderBy(F.desc("id")))
    assert [x.id for x in r.read(3)] == [99, 98, 97]
    assert len(r.read(1000)) == 97 and r.read() is None
    sinks.discard(spark.range(3))
    assert [x.value for x in sinks.serialize(spark.range(1)).collect()] == ['{"id":0}']


def test_empty_fields_and_other_parsers(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1||2.5|\n|x|zz|\n3\n\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])
    got = [tuple(r) for r in files.read_delimited(spark, [f"{tmp_path}/e.txt"], schema).collect()]
    assert sorted(got, key=repr) == sorted([(1, "", 2.5), (None, "x", None), (3, None, None), (None, None, None)], key=repr)
    (tmp_path / "w.txt").write_text("7  ab \n12 c\n")
    fixed = files.load(spark, f"{tmp_path}/w.txt", T.StructType(schema.fields[:2]), parser=files.FixedWidth((3, 5)))
    assert sorted(map(tuple, fixed.collect())) == [(7, "ab"), (12, "c")]


def test_a_dump_deals_its_rows_over_all_splits(spark, tmp_path):
    d = spark.range(100).selectExpr("id", "cast(id AS string) AS s")
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    script.run(spark, f'R = load "t" as (id: long, s: chararray); dump R into "n1:{a},n2:{b}";', tables={"t": d}).write()
    parts = [sorted(int(r.value.split("|")[0]) for r in spark.read.text(p).collect()) for p in (a, b)]
    assert all(len(p) > 20 for p in parts) and sorted(parts[0] + parts[1]) == list(range(100))


def test_jobs_by_properties(spark, tmp_path):
    (tmp_path / "in.txt").write_text("b a\na\n")
    properties.run(spark, f"job=word_count\ninput.paths={tmp_path}/in.txt\noutput.path={tmp_path}/o")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/o").collect()) == ["a\t2", "b\t1"]
    for bad in ("job=word_count", f"job=none\ninput.paths={tmp_path}/in.txt\noutput.path={tmp_path}/p"):
        with pytest.raises(ValueError, match="job"):
            properties.run(spark, bad)


def test_mean_counter_is_exact_beyond_floats():
    m = MeanCounter()
    m.set(2**60 + 2)
    m.set(2**60)
    assert m.get() == 2**60 + 1
    n = MeanCounter()
    n.set(-3)
    n.set(0)
    assert n.get() == -1
