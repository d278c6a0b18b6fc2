"""Chains and paths deeper than the test tables'."""

from tidewater.operators import graph as G


def test_depth_is_not_capped(spark):
    # 100 in a line under a parent that isn't there, and a cycle of two with a node below it
    rows = [(i, i - 1, f"n{i}", True) for i in range(1, 101)] + [(201, 202, "x", True), (202, 201, "y", True), (203, 202, "z", False)]
    nodes = spark.createDataFrame(rows, "ref long, parent long, name string, is_dir boolean")
    got = {tuple(r) for r in G.chain_roots(nodes.selectExpr("ref AS id", "parent")).collect()}
    assert got == {(i, 1, i, True) for i in range(1, 101)}
    paths = G.full_paths(nodes).collect()
    assert {(r.ref, r.path, r.depth) for r in paths} == {(i, "/".join(f"n{k}" for k in range(1, i + 1)), i) for i in range(1, 101)}
    asked = spark.createDataFrame([("N1/N2/N3/N4/N5",)], "asked string")
    assert [r.ref for r in G.walk(nodes, asked).collect()] == [5]
