"""CSV files read in many splits give the rows of the file, whatever stands in quotes."""

import csv
import io
import random

import pytest

from docquarry.sources import tabular


def rows(spark, path):
    return [tuple(r) for r in tabular.read_csv(spark, path).orderBy("_row_idx").collect()]


@pytest.fixture()
def small_splits(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for c, v in before.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_random_quoted_files(small_splits, tmp_path, seed, end):
    spark, rnd = small_splits, random.Random(seed)
    text = lambda: "".join(rnd.choice(['a', 'b c', '"', ',', '\n', '\n\n', '","', '"\n"', 'é', '5" pipe', 'x']) for _ in range(rnd.randint(1, 6))).strip(" ")
    want = [(text(), text(), text()) for _ in range(150)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows([("Tên", "b", "b")] + want)
    (tmp_path / "x.csv").write_bytes(("\ufeff" if seed == 1 else "").encode() + out.getvalue().encode())
    frame = tabular.read_csv(spark, f"{tmp_path}/x.csv")
    assert frame.columns == ["Ten", "b", "b_1", "_row_idx"]
    got = rows(spark, f"{tmp_path}/x.csv")
    assert [r[3] for r in got] == list(range(150))
    assert [r[:3] for r in got] == want


def test_stray_quotes_empty_lines_and_several_files(small_splits, tmp_path):
    spark = small_splits
    (tmp_path / "a.csv").write_text('a,b\n5" pipe,x\n\n"two\nlines",y\n,\n' + "k,v\n" * 200)
    (tmp_path / "b.csv").write_text('a,b\n"q ""r""",""\nlast,"open, and\nnever closed')
    got = rows(spark, str(tmp_path))
    assert got[:3] == [('5" pipe', "x", 0), ("two\nlines", "y", 1), (None, None, 2)] and got[3:203] == [("k", "v", 3 + i) for i in range(200)]
    assert got[203][0] == 'q "r"' and got[204][0] == "last" and [r[2] for r in got] == list(range(205))


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "large.csv", "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(["id", "text"])
        out.writerows((i, f"row {i}\nsecond line" if i % 1000 == 7 else f"row, {i}") for i in range(300_000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        frame = tabular.read_csv(spark, f"{tmp_path}/large.csv")
        got = frame.selectExpr("count(*) n", "count_if(_row_idx = id) same", "count_if(text LIKE '%second line') two", "count(DISTINCT _row_idx) d").first()
        assert tuple(got) == (300_000, 300_000, 300, 300_000)
        assert spark.read.option("lineSep", "\n").text(f"{tmp_path}/large.csv").rdd.getNumPartitions() >= 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b\n")
    assert rows(spark, f"{tmp_path}/empty.csv") == [] and rows(spark, f"{tmp_path}/head.csv") == []
    assert tabular.read_csv(spark, f"{tmp_path}/head.csv").columns == ["a", "b", "_row_idx"]
