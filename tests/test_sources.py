import math

from pyspark.sql import functions as F

from facetry.sources import io

CIF = """data_x
_cell_length_a   4.0
_cell_length_b   5.0
_cell_length_c   6.0
_cell_angle_alpha   90.0
_cell_angle_beta   90.0
_cell_angle_gamma   90.0
_symmetry_space_group_name_H-M   'P 1'

loop_
  _atom_site_type_symbol
  _atom_site_label
  _atom_site_fract_x
  _atom_site_fract_y
  _atom_site_fract_z
  _atom_site_occupancy
  Pb  Pb1  0.5  0.5  0.25  1.0
  Br  Br1  0.0  0.5  0.5  1.0
"""


def test_structures_and_materials(spark, tmp_path):
    (tmp_path / "AB3-gpaw-optimized.cif").write_text(CIF)
    cells, sites = io.scan_structures(spark, f"{tmp_path}/*.cif")
    assert math.isclose(cells.first()["volume"], 120.0)
    rows = sites.orderBy("site_index").collect()
    assert [r["element"] for r in rows] == ["Pb", "Br"] and rows[0]["cart"] == [2.0, 2.5, 1.5]
    assert [r["material"] for r in io.list_materials(spark, str(tmp_path)).collect()] == ["AB3"]


def test_atom_rows_keep_their_order(spark, tmp_path):
    (tmp_path / "X-gpaw-0-Simplex-Features.csv").write_text("elf,atomic_number\n0.5,82\n,35\nnan,17\n")
    rows = io.scan_atoms(spark, str(tmp_path)).orderBy("site_index").collect()
    assert [(r["site_index"], r["atomic_number"], r["elf"]) for r in rows] == [(0, 82, 0.5), (1, 35, None), (2, 17, None)]
    assert rows[0]["material"] == "X" and rows[0]["ionic_radius"] is None


def test_reports_configs_and_absent_tensors(spark, tmp_path):
    (tmp_path / "ACF.dat").write_text(" # X Y Z CHARGE\n -----\n 1 0 0 0 4.5 1\n 2 0 0 0 7.25 1\n -----\n TOTAL 11\n")
    assert [(r["atom"], r["electrons"]) for r in io.scan_charge_report(spark, f"{tmp_path}/ACF.dat").orderBy("atom").collect()] == [(1, 4.5), (2, 7.25)]
    for run, text in (("a", '{"layers": 3}'), ("b", '{"layers": 4, "gamma": 2.0}')):
        (tmp_path / run).mkdir()
        (tmp_path / run / "args.json").write_text(text)
    got = io.scan_run_config(spark, f"{tmp_path}/*/args.json").select("run", "layers", io.with_default("gamma", 1.5).alias("gamma")).orderBy("run").collect()
    assert [tuple(r) for r in got] == [("a", 3, 1.5), ("b", 4, 2.0)]
    assert io.scan_tensors(spark, f"{tmp_path}/none.csv").count() == 0


def test_reports_and_column_rules(spark):
    files = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 2)], "material string, k int")
    got = {r["material"]: (r["loaded"], r["missing"]) for r in io.load_report(files).collect()}
    assert got == {"a": (True, ""), "b": (False, "0-Simplex-Features")}
    df = spark.range(1).select(F.lit(1.0).alias("area"), F.lit(1).alias("atom_index_i"), F.lit("x").alias("symbol"), F.lit(2).alias("site_j"), F.lit(2).alias("site_k"))
    assert io.numeric_columns(df) == ["area"] and io.triangle_keys(df) == ["atom_index_i", "site_j", "site_k"] and io.triangle_keys(df.select("area")) is None
    labels = io.labels_relation(spark, {"m1": {"gap": 1.5, "energy": -2}, "m2": {"gap": 0.5}})
    assert labels.count() == 3 and labels.where("material = 'm2'").first()["position"] == 1
    assert io.unprocessed(files, files.where("k = 2"), "material").select("material").distinct().count() == 1
    assert len(io.ATOM_COLUMNS) == 40 and sum(map(len, io.GROUPS.values())) == 40 and set(io.CORE_COLUMNS) <= set(io.ATOM_COLUMNS)
