"""Views over links: the rows of their statements, from one reading of the line items."""

import datetime
from collections import Counter

import pytest

from linktide.plans import derived


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("views"))
    lines, lost = [], (None, 3, 5, 1)
    for i in range(60):
        order, part, supplier, number = (i % 9, i % 5, i % 3, 1 + i % 4) if i % 13 else lost
        year = None if i % 17 == 5 else 1999 + i % 4
        when = year and datetime.datetime(year, 2, 1 + i % 20)
        price = None if i == 7 else 10.5 * i
        lines.append((order, part if i % 11 else None, supplier, number, price, (i % 3) / 10, "AR"[i % 2], "FO"[i % 2 == i % 3], when))
    spark.createDataFrame(
        lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double,"
        "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    orders = [(i, 100 + i) for i in range(8)] + [(3, 200), (None, 1)]  # order 3 twice, order 8 missing
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize("name", ["links", "phi", "phi_before", "history", "adjacency", "edges"])
def test_same_rows_as_the_statement(spark, folder, name):
    for table in ("lineitem", "orders"):
        spark.read.parquet(f"{folder}/{table}.parquet").createOrReplaceTempView(table)
    want = spark.sql(f"WITH {derived.with_views(name)} SELECT * FROM {name}")
    got = derived.view(spark, folder, name)
    assert got.dtypes == want.dtypes
    near = lambda df: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert near(got) == near(want) and want.count() > 5


@pytest.mark.parametrize("name", ["phi", "phi_before", "history", "adjacency", "edges"])
def test_line_items_are_read_once(spark, folder, name):
    plan = derived.view(spark, folder, name)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2  # line items and orders, or the sums made of them


def test_relations_read_the_links_once(spark, folder):
    from checks.registry import Data
    from checks.scores import labelled

    plan = labelled(Data(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2  # line items and orders


def test_bilinear_products_against_numpy(spark, monkeypatch):
    import numpy as np
    from linktide.operators import projections

    monkeypatch.setattr(projections, "HELD", 500)
    monkeypatch.setattr(projections, "FRAME", 64)
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=3).tolist() for i in range(12)}
    right = [(h if h < 7 else None, i, rng.normal(size=2).tolist()) for h in range(8) for i in range(0, 12, 1 + h % 3)]
    got = projections.bilinear(
        spark.createDataFrame(list(vectors.items()), "id bigint, e array<double>"),
        spark.createDataFrame(right, "head int, id bigint, e array<double>"))
    want = {h: sum(np.outer(vectors[i], e) for k, i, e in right if k == h) for h in range(7)}
    rows = {(r["head"], r["i"]): r["values"] for r in got.collect()}
    assert rows.keys() == {(h, i) for h in range(7) for i in range(3)}
    assert all(np.allclose(rows[h, i], want[h][i]) for h, i in rows)
