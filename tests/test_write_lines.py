"""Files of many lines are written in batches, in order, with their own headers."""

from pyspark.sql import functions as F

from facetry.plans.registry import QUERIES
from facetry.sources import io


def test_files_hold_their_lines_in_order_over_many_batches(spark, tmp_path):
    n = 30_000
    rows = spark.range(0, n, 1, 3).select(F.concat(F.lit("sub/f"), (F.col("id") % 3).cast("string")).alias("name"), F.concat(F.lit("h"), (F.col("id") % 3).cast("string")).alias("header"), (-F.col("id")).alias("o"), F.concat(F.col("id").cast("string"), F.lit(",é")).alias("line"))
    assert io.write_lines(rows, str(tmp_path)) == 3
    for k in range(3):
        text = (tmp_path / "sub" / f"f{k}").read_text(encoding="utf-8")
        assert text == f"h{k}\n" + "".join(f"{i},é\n" for i in range(n - 1, -1, -1) if i % 3 == k)
    assert len([p for p in (tmp_path / "sub").iterdir() if not p.name.startswith(".")]) == 3
    assert io.write_lines(rows.limit(0), str(tmp_path)) == 0


def test_bonds_are_not_collected_into_one_value_a_file(spark, monkeypatch):
    made = []
    monkeypatch.setattr(io, "csv_content", lambda *a: made.append(a))
    assert QUERIES["s1_bonds_by_header"](spark, "/root/testdata/sf0.001").count() == 25 and not made
