"""Queries with an SQL counterpart, in both engines."""

import base64
import random

import duckdb
import pytest

from gridlens.llm import oracle, queries
from gridlens.llm import secret_scan as ss
from tests.compare import connect, duck_rows, spark_rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_matches_sql(spark, sf, name):
    sf_dir = f"/root/testdata/{sf}"
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duck_rows(connect(sf_dir), queries.oracle_sql()[name])


def test_random_strings_match_sql(spark, tmp_path):
    rng = random.Random(5)
    words = ["configuration", "international", "Responsibility", "environment", "2024", "x-ray", "A_B"]
    texts = [None, "", "é" * 30]
    for i in range(300):
        parts = ["_".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(6)]
        if i % 9 == 0:
            parts.insert(2, base64.b64encode(rng.randbytes(rng.randint(15, 90))).decode())
        if i % 11 == 0:
            parts.insert(1, "é token = '" + rng.randbytes(20).hex() + "'")
        texts.append(" ".join(parts) + "=" * (i % 3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got, wanted = spark_rows(ss.op10_secret_scan(df)), duck_rows(con, oracle.op10_secret_scan())
    assert got == wanted and sum("random" in str(r) for r in got[1]) > 20
