"""Pixel queries against their SQL where single and double precision give unlike pixels."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillon.plans import registry

QUERIES = [
    "f13_palette_lut", "f16_delta_e", "f18_composite", "f9_f19_luma_background", "j11_nearest_colour", "l10_audit_flags", "l4_region_ids", "l7_settled_palette",
    "r11_median_colour", "r12_colour_histogram", "w_capture_posterize", "w_halftone", "w_illumination", "w_ink_bleed",
]


@pytest.fixture(scope="module")
def levels(tmp_path_factory):
    """Levels of which half are just below a whole number, nearer to it than single precision tells."""
    rng = np.random.default_rng(3)
    k = np.where(rng.random((8, 64)) < 0.5, rng.integers(1, 8, (8, 64)) * 32, rng.integers(1, 256, (8, 64)))
    v = ((k - 128) / 128).astype(np.float32)
    v = np.where(rng.random((8, 64)) < 0.5, np.where(v == 0, np.float32(-1e-9), np.nextafter(v, np.float32(-2))), v)
    assert (np.floor(v.astype(float) * 128 + 128) != np.floor(v * np.float32(128) + np.float32(128))).any()
    d = tmp_path_factory.mktemp("levels")
    pq.write_table(pa.table({"vec_id": list(range(8)), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 8, pa.int32())}), f"{d}/embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_levels_beside_whole_numbers(spark, levels, name):
    df = registry.queries()[name](spark, levels)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{levels}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """Embeddings of all lengths around 64, none and null among them, and elements that are null, NaN or infinite."""
    rng = np.random.default_rng(5)
    rows = [rng.normal(0, 0.3, n).astype(np.float32).tolist() for n in (64, 63, 33, 32, 31, 1, 0, 70, 64, 64)]
    rows[8][3:40:9] = [None, float("nan"), float("inf"), float("-inf"), None]
    rows[9] = None
    d = tmp_path_factory.mktemp("uneven")
    pq.write_table(pa.table({"vec_id": list(range(10)), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * 10, pa.int32())}), f"{d}/embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_uneven_embeddings(spark, uneven, name):
    test_levels_beside_whole_numbers(spark, uneven, name)
