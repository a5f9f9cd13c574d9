"""Edges of parts that one order holds: lines that repeat a part or stand alone in their brand meet nothing."""

from facetry.plans import registry  # noqa: F401
from facetry.plans import bonds


def test_only_lines_with_another_part_of_their_brand_are_joined(spark, tmp_path, monkeypatch):
    names = {}

    def kept(df, name, before=bonds.written):
        names[name] = before(df, name)
        return names[name]

    monkeypatch.setattr(bonds, "written", kept)
    spark.createDataFrame([(i, f"b{i % 2}") for i in range(1, 9)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 1), (1, 1), (1, 3), (1, 5), (1, 2), (2, 4), (2, 4), (3, 6), (3, 8), (3, 8), (4, 7), (5, None), (5, 2), (None, 2), (None, 4), (6, 99), (6, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in bonds.edges(spark, str(tmp_path)).select("material", "u", "v").collect())
    assert got == [("b0", 6, 8), ("b1", 1, 3), ("b1", 1, 5), ("b1", 3, 5)]
    assert sorted(tuple(r) for r in names["held"].select("l_orderkey", "l_partkey").collect()) == [(1, 1), (1, 3), (1, 5), (2, 4), (3, 6), (3, 8)]
