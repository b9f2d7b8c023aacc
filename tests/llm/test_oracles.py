"""The SQL of corpus queries against the queries, on small tables made for the edges."""

import numpy as np
import pytest

from sparkgauge.llm.entries import ORACLE_SQL, QUERIES


def tables():
    r = np.random.default_rng(9)
    short = ["x", "yy zz", "a b c d", "tail of ten", "{", "}"]
    pool = short + [f"a longer line, number {i}, which is a window" for i in range(6)] + ["", "  ", " indented and long enough to be a window "]
    lines = [(i, "\n".join(r.choice(pool, int(r.integers(1, 25))))) for i in range(80)]
    key = lambda n: "".join(r.choice(list("ABCDEFGHJKabcdefghjk0123456789+/"), n))
    secrets = [(100 + i, f"é {key(n)} and password: {key(14)} {'0f' * n} x=AKIA{'Q7' * 9} {key(40)}\ntoken=\"{key(11)}\"") for i, n in enumerate(range(15, 45))]
    return lines + secrets + [(200, None), (201, ""), (202, " \n "), (203, lines[3][1]), (204, "AB-cd-EF 550e8400-e29b-41d4-a716-446655440000")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tmp_path, name):
    import duckdb

    rows = [(d, t, ["en", "de", None][d % 3]) for d, t in tables()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in tables()[::9]], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    c.sql(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    expected = c.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    mine, other = (sorted(map(tuple, x), key=repr) for x in (got.select(*columns).collect(), expected.select(*columns).fetchall()))
    assert mine == other
    if name.startswith("op9"):
        assert sum(r.n_entropy for r in got.collect()) > 10
