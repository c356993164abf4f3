"""Rows at the edges of number formats, on tables of their own, against the SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.test_queries import rows
from tidewright.plans import catalog


def agrees(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, data in tables.items():
        pq.write_table(data, f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    assert rows(catalog.QUERIES[name](spark, str(folder)).toPandas()) == rows(con.sql(catalog.ORACLE_SQL[name]).df())


def edge_vectors(n=40):
    """Vectors some of whose entries reach another thousandth as floats than as doubles."""
    near = np.array([np.nextafter(np.float32(k / 1000), np.float32(to)) for k in range(-500, 501) for to in (k / 1000, 9, -9)], np.float32)
    assert (np.floor(near * np.float32(1000)) != np.floor(near.astype(np.float64) * 1000)).sum() > 100
    cells = np.random.default_rng(1).choice(near, (n, 64))
    return pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(cells.tolist(), pa.list_(pa.float32())), "label": pa.array([k % 3 for k in range(n)], pa.int32())})


@pytest.mark.parametrize("name", ["alpha_gates", "box_mean", "composited", "integral_image", "oriented", "pixel_digest", "pixel_metrics", "png_pixels", "run_symbols", "tensor_values", "tile_pairs"])
def test_thousandths_are_those_of_floats(spark, tmp_path, name):
    agrees(spark, tmp_path, name, embeddings=edge_vectors())


def test_candidate_sizes_are_those_of_doubles(spark, tmp_path):
    ids = [6 + 17 * k for k in range(300)]
    texts = ["x" * (50 * (k + 1)) for k in range(300)]
    agrees(spark, tmp_path, "candidate_choice", documents=pa.table({"doc_id": pa.array([*ids, 6], pa.int64()), "text": [*texts, "x" * 2150], "source": ["s"] * 301, "lang": ["en"] * 301}))


def keys(customers, orders):
    return {"customer": pa.table({"c_custkey": pa.array(customers, pa.int64())}), "orders": pa.table({"o_custkey": pa.array(orders, pa.int64())})}


@pytest.mark.parametrize("tables", [keys([1, 2, 2, 3, None], [2, 2, 7, None]), keys([], [1]), keys([1], [])])
def test_objects_without_a_key_are_removed(spark, tmp_path, tables):
    agrees(spark, tmp_path, "pruned_objects", **tables)


def test_objects_meet_references_by_key(spark, tmp_path):
    for table, data in keys([1, 2], [2]).items():
        pq.write_table(data, f"{tmp_path}/{table}.parquet")
    plan = catalog.QUERIES["pruned_objects"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def vectors(n, spread=0.13, seed=3):
    return np.random.default_rng(seed + n).normal(0, spread, n).astype(np.float32).tolist()


def holed(vector, *at):
    return [None if k in at else x for k, x in enumerate(vector)]


#: (ids, vectors): repeated rows, rows without an id, ids below 0, vectors of other sizes, entries that are null.
FULL = [vectors(64, seed=k) for k in range(24)]
ODD = {
    "repeated": ([0, 1, 2, 3, 3, 4, 4], [*FULL[:4], FULL[3], FULL[5], FULL[6]]),
    "same": ([0, 1, 2, 2, 2, 3], [*FULL[:3], FULL[2], FULL[2], FULL[3]]),
    "no id": ([0, 1, None, 2, 3, None], FULL[:6]),
    "one without id": ([0, 1, None, 3], FULL[:4]),
    "below 0": (list(range(-12, 12)), FULL),
    "sizes": (list(range(9)), [FULL[0], vectors(10), FULL[2], vectors(63), vectors(80), FULL[5], [], None, vectors(300)]),
    "tile of other sizes": (list(range(4)), [FULL[0], vectors(48), vectors(80), FULL[3]]),
    "null entries": (list(range(8)), [FULL[0], holed(FULL[1], 3, 6), FULL[2], holed(FULL[3], 40), holed(FULL[4], 0, 1, 63), *FULL[5:8]]),
}
ODD_CASES = [
    ("box_mean", "repeated"),
    ("box_mean", "same"),
    ("box_mean", "no id"),
    ("box_mean", "sizes"),
    ("box_mean", "null entries"),
    ("integral_image", "repeated"),
    ("integral_image", "same"),
    ("integral_image", "no id"),
    ("integral_image", "sizes"),
    ("integral_image", "null entries"),
    ("oriented", "no id"),
    ("oriented", "below 0"),
    ("oriented", "repeated"),
    ("oriented", "sizes"),
    ("pixel_digest", "same"),
    ("pixel_digest", "one without id"),
    ("pixel_digest", "sizes"),
    ("pixel_digest", "null entries"),
    ("pixel_metrics", "repeated"),
    ("pixel_metrics", "same"),
    ("pixel_metrics", "no id"),
    ("pixel_metrics", "sizes"),
    ("pixel_metrics", "null entries"),
    ("run_symbols", "repeated"),
    ("run_symbols", "same"),
    ("run_symbols", "no id"),
    ("run_symbols", "sizes"),
    ("run_symbols", "null entries"),
    ("tile_pairs", "below 0"),
    ("tile_pairs", "tile of other sizes"),
    ("tile_pairs", "null entries"),
    ("tile_pairs", "repeated"),
    # cases of odd vectors end here
]


@pytest.mark.parametrize(("name", "kind"), ODD_CASES)
def test_odd_vectors(spark, tmp_path, name, kind):
    ids, cells = ODD[kind]
    agrees(spark, tmp_path, name, embeddings=pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(cells, pa.list_(pa.float32())), "label": pa.array([k % 3 for k in range(len(ids))], pa.int32())}))
