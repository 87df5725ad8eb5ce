"""Masks that spread alike both ways: their main axis hangs on the last bit of two variances."""

import duckdb
import pytest

from gradewell.operators import raster
from gradewell.plans import registry

from .oracle import rows_of

# Bits of 8 x 8 masks of equal variances and no covariance.
MASKS = [
    0x303, 0x3030000, 0x110000A210002, 0x10080240010420, 0x40801002108040, 0x1020010801201000, 0x2280008080008002, 0xC1000A01204, 0x280004020164, 0x20C0000430900,
    0x40040A0204408, 0x20000A0B000420, 0x20040148020810, 0x1000702081000020, 0x1020000042440280, 0x1454100410000000, 0x4000606200108000, 0x8003000D00002004,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ties"))
    rows = [(i, [0.5 if m >> (63 - k) & 1 else 0.0 for k in range(64)], 0) for i, m in enumerate(MASKS)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["axis_profile", "width_profile", "zone_assign"])
def test_ties_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")  # with more, it may add up a mask in two parts
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, folder)
    cur = con.execute(registry.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_ties_however_rows_are_dealt(spark, folder):
    on = registry.raster_queries.lit(spark, folder)
    want = sorted(raster.axes(on).collect())
    for n in (3, 7):
        assert sorted(raster.axes(on.repartition(n, "x", "y")).collect()) == want
