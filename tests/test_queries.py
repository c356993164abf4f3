import duckdb
import pytest

from tidewright.operators.graph import reachable
from tidewright.plans import catalog
from tidewright.plans.dialect import TABLES, spelled
from tidewright.plans.savings import merge_identical
from tidewright.streaming import progress
from tidewright.streaming.progress import emitted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame):
    f = frame[sorted(frame.columns)].copy()
    for c in f.columns:
        if f[c].dtype.kind in "iuf":
            f[c] = f[c].astype(float)
    return sorted(map(tuple, f.astype(str).replace({"None": "nan", "<NA>": "nan"}).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_macros_nest():
    assert spelled("IDIV(IDIV(a, 2) + 1, b)", True) == "((((a) div (2)) + 1) div (b))"


def test_cycles_end(spark):
    spark.sparkContext.setCheckpointDir("/tmp/tidewright-tests")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert sorted(r[0] for r in reachable(spark.createDataFrame([(1,)], "id long"), edges).collect()) == [1, 2, 3]


def test_throttle_counts_from_the_last_sent():
    import pandas as pd

    f = pd.DataFrame({"stage": ["a"] * 5, "done": [1, 2, 3, 4, 9], "total": [9] * 5, "ts_ms": [0, 60, 120, 180, 190]})
    assert emitted(f, None)[0] == [0, 2, 4]


def test_files_without_content_keep_themselves(spark):
    files = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "doc_id long, text string")
    assert {r.doc_id: r.keeper for r in merge_identical(files).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_throttled_stream_is_the_batch(spark, tmp_path):
    rows = [(j, "images" if k < 20 else "saving", k % 7, 6, 40 * k + j) for j in range(3) for k in range(30)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if part * 10 <= (r[4] - r[0]) // 40 < part * 10 + 10], progress.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    source = spark.readStream.schema(progress.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    running = progress.throttle_stream(source).writeStream.format("memory").queryName("sent").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination(240)
    got = sorted(map(tuple, spark.table("sent").collect()))
    want = sorted(map(tuple, progress.throttle(spark.createDataFrame(rows, progress.SCHEMA)).collect()))
    assert got == want and len(want) < len(rows)
