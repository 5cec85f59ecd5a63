"""Queries against their SQL on small tables made for one case each."""

from __future__ import annotations

import duckdb

from peakloom import registry


def tables(spark, folder, orders, lines) -> str:
    """A folder with orders (key, customer) and line items (order, supplier, line number, quantity)."""
    spark.createDataFrame([(*o, 1000.0 + o[0], "1-URGENT") for o in orders], "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def by_sql(folder, name) -> list[tuple]:
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(registry.SQL[name]).fetchall())


def test_means_on_a_half_are_rounded_as_in_sql(spark, tmp_path):
    # the mean m/z is 128.0017578125, which times 10**9 is just below a half
    folder = tables(spark, tmp_path, [(0, 5), (1, 5)], [(0, 14, 1, 31.0), (1, 14, 2, 9.0)])
    found = sorted(tuple(r) for r in registry.QUERIES["avg_weighted"](spark, folder).collect())
    assert found == by_sql(folder, "avg_weighted") == [(5, 128.001757812, 20.0)]


def test_blocks_of_a_file_are_placed_by_their_parts(spark, tmp_path):
    blocks = [f"Name: {i}\n{'x' * (1 + i % 90)}" for i in range(500)]
    (tmp_path / "all.msp").write_text("\n\n".join(blocks) + "\n")
    bounds = {"spark.sql.files.maxPartitionBytes": "173", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, v)
        found = registry._blocks_in_order(spark, f"file://{tmp_path}/all.msp")
        assert found.rdd.getNumPartitions() > 10
        rows = found.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.block.rstrip("\n") for r in sorted(rows, key=lambda r: r.place)] == blocks
    assert sorted(r.place for r in rows) == list(range(500))
