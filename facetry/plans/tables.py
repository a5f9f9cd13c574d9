"""Queries for sources, sinks, column rules, set operations, strings and reshaping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facetry.functions import rules
from facetry.operators import evaluation, scaling, sites
from facetry.plans.registry import query
from facetry.plans.sites import neighbours, r
from facetry.session import shared_dir, table
from facetry.sources import io


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_s11_atoms_round_trip", "SELECT p_brand AS material, count(*) AS n, round(sum(p_size), 4) AS z, round(sum(p_retailprice), 3) AS chi, CAST(count(*) * 0 AS BIGINT) AS radii FROM part GROUP BY p_brand")
def s1(spark, sf_dir):
    """Atoms of each brand written as one file a material, in the fixed column order, and scanned."""
    df = table(spark, sf_dir, "part").select(F.col("p_brand").alias("material"), F.col("p_partkey").alias("site_index"), F.col("p_size").alias("atomic_number"), F.col("p_retailprice").alias("electronegativity"))
    path = folder(spark, "atoms")
    files = io.ordered_atoms(df).groupBy("material").agg(io.csv_content("site_index", io.ATOM_COLUMNS).alias("content"))
    io.write_named(files.select(F.concat("material", F.lit("-gpaw-0-Simplex-Features.csv")).alias("name"), "content"), path)
    back = io.scan_atoms(spark, path)
    return back.groupBy("material").agg(F.count(F.lit(1)).alias("n"), r(F.sum("atomic_number"), "z", 4), r(F.sum("electronegativity"), "chi", 3), F.count("ionic_radius").alias("radii"))


@query("s1_bonds_by_header", """SELECT p_brand AS material, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS first_sites, CAST(sum(l_linenumber) AS BIGINT) AS second_sites, max(l_returnflag) AS element, round(sum(l_quantity), 3) AS distance,
        round(sum(CASE WHEN p_brand LIKE '%1' THEN l_tax END), 4) + 0.0 AS alignment, round(sum(CASE WHEN p_brand NOT LIKE '%1' THEN l_discount END), 4) + 0.0 AS coupling FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def s1_bonds(spark, sf_dir):
    """Bonds of each brand in a file of its own; the files differ in the order of their columns and in one column."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("material")), "l_partkey").select(
        "material", F.col("l_orderkey").alias("site1_index"), F.col("l_linenumber").alias("site2_index"), F.col("l_returnflag").alias("site1_element"), F.col("l_quantity").alias("bond_distance"), F.col("l_tax").alias("tensor_alignment"), F.col("l_discount").alias("symplectic_coupling"))
    path, last = folder(spark, "bonds"), F.substring("material", -1, 1).cast("int") % 3
    orders = (["bond_distance", "site1_element", "site2_index", "symplectic_coupling", "site1_index"], ["site1_index", "site2_index", "site1_element", "bond_distance", "tensor_alignment"], ["site1_element", "symplectic_coupling", "bond_distance", "site1_index", "site2_index"])
    kind = F.when(F.col("material").endswith("1"), 1).otherwise(F.when(last == 1, 0).otherwise(last))
    of = lambda each: F.coalesce(*[F.when(kind == k, each(columns)) for k, columns in enumerate(orders)])
    io.write_lines(rows.select(
        F.concat("material", F.lit(io.BOND_SUFFIX)).alias("name"), of(lambda c: F.lit(",".join(c))).alias("header"), F.struct("site1_index", "site2_index").alias("o"), of(io.csv_line).alias("line")).where("line IS NOT NULL AND name IS NOT NULL"), path)
    return io.scan_bonds(spark, path).groupBy("material").agg(
        F.count(F.lit(1)).alias("n"), F.sum("site1_index").alias("first_sites"), F.sum("site2_index").alias("second_sites"), F.max("site1_element").alias("element"),
        r(F.sum("bond_distance"), "distance", 3), r(F.sum("tensor_alignment"), "alignment", 4), r(F.sum("symplectic_coupling"), "coupling", 4))


@query("s17_incremental_results", """SELECT 'm' || (o_custkey % 40) AS material, o_custkey, count(*) AS n, round(sum(o_totalprice) * CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END, 2) AS total
    FROM orders WHERE o_custkey % 40 NOT IN (4, 14, 24, 34) GROUP BY o_custkey""")
def s17_results(spark, sf_dir):
    """Totals of the customers in half the groups, then in all (finished ones are skipped), then in the even groups made anew
    with doubled totals, where groups ending in 4 have no rows any more."""
    m = F.col("o_custkey") % 40
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), m.cast("string")).alias("material"), "o_custkey", "o_totalprice", m.alias("m"))
    path = folder(spark, "results")
    total = lambda times: lambda rows: rows.groupBy("material", "o_custkey", "m").agg(F.count(F.lit(1)).alias("n"), (F.sum("o_totalprice") * times).alias("total"))
    io.write_results(orders.where("m % 4 < 2"), total(1), path, "material")
    io.write_results(orders, total(1), path, "material")
    io.write_results(orders, lambda rows: total(2)(rows).where("m % 10 <> 4"), path, "material", orders.where("m % 2 = 0").select("material").distinct())
    return io.read_results(spark, path, "material").select("material", "o_custkey", "n", F.round("total", 2).alias("total"))


@query("s2_s12_tensor_round_trip", "SELECT CAST(l_orderkey AS INTEGER) AS site_index, round(sum(l_quantity * l_quantity), 4) AS trace FROM lineitem GROUP BY l_orderkey")
def s2(spark, sf_dir):
    q = F.sum(F.col("l_quantity") * F.col("l_quantity"))
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("int").alias("site_index")).agg(q.alias("t")).select("site_index", F.array("t", *[F.lit(0.0)] * 8).alias("tensor"))
    path = folder(spark, "tensors")
    io.write_csv(io.tensor_rows(df), path)
    return io.scan_tensors(spark, path).select("site_index", r(F.col("tensor")[0] + F.col("tensor")[4] + F.col("tensor")[8], "trace", 4))


@query("s7_s14_embedding_round_trip", "SELECT CAST(label AS VARCHAR) AS model, count(*) AS n, round(sum(embedding[1]), 3) AS first, round(sum(list_sum(list_transform(range(1, 65), lambda i: i * round(embedding[i]::DOUBLE, 6)))), 2) AS weighed FROM embeddings GROUP BY label")
def s7(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("model"), F.col("vec_id").cast("string").alias("material"), F.lit(0.0).alias("computation_time"), F.col("embedding").cast("array<double>").alias("emb"))
    path = folder(spark, "emb")
    io.write_csv(io.embedding_rows(e, 64), path, ["model"])
    back = io.scan_embeddings(spark, path, 64)
    return back.groupBy(F.col("model").cast("string").alias("model")).agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("emb")[0]), "first", 3), r(F.sum(F.aggregate(F.transform("emb", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, v: s + v)), "weighed", 2))


@query("s10_grid_scan", "SELECT l_returnflag AS field, count(*) AS n, round(sum(l_tax), 4) AS value FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_returnflag")
def s10(spark, sf_dir):
    path = folder(spark, "grid")
    io.write_grid(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("i"), F.col("l_tax").alias("value")), path)
    return io.scan_grid(spark, path, "A").groupBy("field").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), "value", 4))


@query("s13_ids_first", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def s13(spark, sf_dir):
    return io.ids_first(table(spark, sf_dir, "lineitem").select("l_quantity", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("s16_validation_json", "SELECT l_returnflag, count(*) AS total FROM lineitem GROUP BY l_returnflag")
def s16(spark, sf_dir):
    path = folder(spark, "validation")
    table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("total")).write.json(path)
    return spark.read.schema("l_returnflag string, total long").json(path)


@query("s6_y4_config_defaults", "SELECT json_extract_string(props, '$.k')::INTEGER % 10 AS k, CAST(0.5 AS DOUBLE) AS gamma, count(*) AS n FROM events GROUP BY ALL")
def s6(spark, sf_dir):
    """JSON fields with defaults for keys that are not there."""
    p = F.from_json("props", "k int, gamma double")
    return table(spark, sf_dir, "events").select((p["k"] % 10).alias("k"), p["gamma"].alias("gamma")).select("k", io.with_default("gamma", 0.5).alias("gamma")).groupBy("k", "gamma").agg(F.count(F.lit(1)).alias("n"))


@query("s6_run_config", "SELECT n_name AS run, n_nationkey % 4 AS layers, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 0.5 ELSE 1.5 END AS gamma FROM nation")
def s6_files(spark, sf_dir):
    """A configuration file a nation; odd ones lack the key gamma."""
    key = F.col("n_nationkey")
    values = F.struct((key % 4).cast("int").alias("layers"), F.when(key % 2 == 0, key * 0.5).alias("gamma"))
    path = folder(spark, "runs")
    io.write_named(table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("/args.json")).alias("name"), F.to_json(values).alias("content")), path)
    return io.scan_run_config(spark, f"{path}/*/args.json").select("run", F.col("layers").cast("int").alias("layers"), io.with_default("gamma", 1.5).alias("gamma"))


def structure_files(spark, sf_dir):
    """A structure file a nation: its suppliers are sites of a box of sides 4, 5, 6 plus the nation's key."""
    site = F.concat_ws(" ", F.lit(""), F.lit("Pb Pb1"), *[(F.col("s_suppkey") % m / m).cast("string") for m in (4, 5, 8)], F.lit("1.0"))
    sites = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", site.alias("r")))).alias("a"))
    key = F.col("n_nationkey").cast("string")
    cell = [F.concat(F.lit(f"_cell_length_{k} "), (F.col("n_nationkey") + x).cast("string")) for k, x in zip("abc", (4, 5, 6))]
    loop = F.lit("loop_\n _atom_site_type_symbol\n _atom_site_label\n _atom_site_fract_x\n _atom_site_fract_y\n _atom_site_fract_z\n _atom_site_occupancy")
    content = F.concat_ws("\n", F.concat(F.lit("data_"), key), *cell, *[F.lit(f"_cell_angle_{k} 90") for k in ("alpha", "beta", "gamma")], loop, F.array_join(F.transform("a", lambda x: x["r"]), "\n"))
    return table(spark, sf_dir, "nation").join(sites, "n_nationkey").select(F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("-gpaw-optimized.cif")).alias("name"), content.alias("content"))


@query("s3_list_materials", "SELECT DISTINCT replace(n_name, ' ', '_') AS material FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def s3(spark, sf_dir):
    path = folder(spark, "structures")
    io.write_named(structure_files(spark, sf_dir), path)
    return io.list_materials(spark, path)


@query("s4_structures", """SELECT replace(n_name, ' ', '_') AS material, CAST((n_nationkey + 4.0) * (n_nationkey + 5.0) * (n_nationkey + 6.0) AS DOUBLE) AS volume, count(*) AS sites, CAST(max(row_) AS INTEGER) AS last_site,
        round(sum(s_suppkey % 4 / 4 * (n_nationkey + 4)), 6) AS x, round(sum(s_suppkey % 5 / 5 * (n_nationkey + 5)), 6) AS y, round(sum(s_suppkey % 8 / 8 * (n_nationkey + 6)), 6) AS z
    FROM nation JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS row_ FROM supplier) ON n_nationkey = s_nationkey GROUP BY n_name, n_nationkey""")
def s4(spark, sf_dir):
    path = folder(spark, "structures")
    io.write_named(structure_files(spark, sf_dir), path)
    cells, sites = io.scan_structures(spark, f"{path}/*-optimized.cif")
    box = cells.select("material", r(F.col("volume"), "volume", 6))
    return sites.groupBy("material").agg(F.count(F.lit(1)).alias("sites"), F.max("site_index").alias("last_site"), *[r(F.sum(F.col("cart")[i]), c, 6) for i, c in enumerate("xyz")]).join(box, "material")


@query("s5_charge_report", "SELECT 'r' || c_nationkey || '.dat' AS name, count(*) AS atoms, round(sum(c_acctbal), 2) AS electrons FROM customer GROUP BY c_nationkey")
def s5(spark, sf_dir):
    """A report a nation: two header lines, a line an atom, a rule and a total."""
    line = F.concat_ws(" ", F.lit(" "), F.col("c_custkey").cast("string"), F.lit("0.0 0.0 0.0"), F.format_string("%.2f", "c_acctbal"), F.lit("1.0 2.0"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("r")))), lambda x: x["r"]), "\n")
    files = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(F.lit(" # X Y Z CHARGE MIN DIST\n -----\n"), lines, F.lit("\n -----\n NUMBER OF ELECTRONS: 11.0\n")).alias("content"))
    path = folder(spark, "charges")
    io.write_named(files.select(F.concat(F.lit("r"), F.col("c_nationkey").cast("string"), F.lit(".dat")).alias("name"), "content"), path)
    return io.scan_charge_report(spark, f"{path}/*.dat").groupBy("name").agg(F.count(F.lit(1)).alias("atoms"), r(F.sum("electrons"), "electrons", 2))


@query("s8_labels_relation", "SELECT n_name, property, value, position FROM nation JOIN region ON r_regionkey = n_regionkey JOIN (VALUES ('AFRICA', 'gap', 1.5, 0), ('AFRICA', 'mass', -2.0, 0), ('ASIA', 'gap', 0.25, 1)) l(r, property, value, position) ON r = r_name")
def s8(spark, sf_dir):
    labels = io.labels_relation(spark, {"AFRICA": {"gap": 1.5, "mass": -2}, "ASIA": {"gap": 0.25}})
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("material")).join(labels, "material")
    return table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "property", "value", "position")


@query("s9_global_features", "SELECT r_name AS material, CAST(count(*) AS INTEGER) AS members, round(CAST(sum(n_nationkey) AS DOUBLE) / 4, 4) AS quarter, 'h' || r_regionkey AS structure_hash FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey")
def s9(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("members"), (F.sum("n_nationkey") / 4).alias("quarter"))
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("structure_hash", F.concat(F.lit("h"), F.col("r_regionkey").cast("string")))
    files = rows.groupBy("r_name").agg(io.csv_content("r_regionkey", ["members", "quarter", "structure_hash"]).alias("content"))
    path = folder(spark, "globals")
    io.write_named(files.select(F.concat("r_name", F.lit("/"), "r_name", F.lit("-Global-Features.csv")).alias("name"), "content"), path)
    return io.scan_global_features(spark, f"{path}/*/*-Global-Features.csv", {"members": "int"}).select("material", "members", r(F.col("quarter"), "quarter", 4), "structure_hash")


@query("s17_unprocessed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def s17(spark, sf_dir):
    return io.unprocessed(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("s18_load_report", "WITH h AS (SELECT l_orderkey, bool_or(l_linenumber % 3 = 0) AS a, bool_or(l_linenumber % 3 = 1) AS b, bool_or(l_linenumber % 3 = 2) AS c FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey AS material, a AND b AS loaded, c AS has_2 FROM h")
def s18(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("material"), (F.col("l_linenumber") % 3).alias("k"))
    return io.load_report(files).select("material", "loaded", "has_2")


@query("p1_p3_p6_columns", "SELECT p_partkey, p_retailprice FROM part")
def p1(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumnRenamed("p_size", "site_size").withColumnRenamed("p_name", "element_name")
    return df.select("p_partkey", *[c for c in io.numeric_columns(df) if c not in ("p_partkey",)])


@query("p2_include_list", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#7') GROUP BY p_brand")
def p2(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#1", "Brand#7")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("p4_p5_keys", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem")
def p4(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.lit("a").alias("site1_element"), F.col("l_orderkey").alias("site_i"), F.col("l_partkey").alias("site_j"), F.col("l_suppkey").alias("site_k"), "l_quantity")
    keys = io.triangle_keys(df)
    return io.edge_features(df).select(*[F.col(k).alias(n) for k, n in zip(keys, ("l_orderkey", "l_partkey", "l_suppkey"))], "l_quantity")


UNIT = "('0x' || substr(md5('{seed}|' || {id}), 1, 13))::BIGINT / 4503599627370496.0"


@query("p14_l7_mask", f"WITH u AS (SELECT p_partkey, p_size, {UNIT.format(seed=11, id='p_partkey')} AS u FROM part) SELECT p_partkey, u < 0.3 AS masked, CASE WHEN u < 0.3 THEN -1.0 ELSE p_size END::DOUBLE AS x FROM u")
def p14(spark, sf_dir):
    m = scaling.masked(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x")), "x", F.lit(-1.0), 0.3, 11, "p_partkey")
    return m.select("p_partkey", F.col("_masked").alias("masked"), "x")


@query("l6_jitter_noise", f"""WITH u AS (SELECT p_partkey, {UNIT.format(seed=3, id='p_partkey')} AS u, {UNIT.format(seed=4, id='p_partkey')} AS v FROM part)
    SELECT p_partkey, round(0.05 * sqrt(-2 * ln(greatest(u, 1e-300))) * cos(2 * 3.141592653589793 * v), 9) + 0.0 AS noise FROM u""")
def l6_noise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r(scaling.jitter(3, 0.05, "p_partkey"), "noise", 9))


@query("j16_all_pairs", "SELECT a.r_regionkey, a.n_nationkey AS i, b.n_nationkey AS j FROM (SELECT *, n_regionkey AS r_regionkey FROM nation) a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j16(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("i"))
    return n.join(n.withColumnRenamed("i", "j"), "r_regionkey").where("i < j")


@query("j12_j15_remap", "SELECT c_nationkey AS material, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS site, coalesce(round(o, 2), 0) AS value FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS o FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def j12(spark, sf_dir):
    """Values carried to the other ordering, in which every third customer is matched to another index."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("material"), F.col("c_custkey").alias("site"))
    mapping = c.select("material", F.col("site").alias("right_site"), (F.col("site") + 1_000_000).alias("left_site"), F.when(F.col("site") % 3 == 0, "matched").otherwise("right_only").alias("status"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("site")).agg(F.max("o_totalprice").alias("o"))
    values = c.join(o.select("site", F.round("o", 2).alias("value")), "site", "left")
    return sites.remapped(values, mapping, ["material"], F.lit(0.0)).select("material", "site", "value")


@query("j18_j19_residual_join", "SELECT c_custkey, round(c_acctbal - m, 4) AS residual, n_name FROM customer JOIN (SELECT c_nationkey AS k, avg(c_acctbal) AS m FROM customer GROUP BY c_nationkey) ON k = c_nationkey JOIN nation ON n_nationkey = c_nationkey")
def j18(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    mean = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return c.join(mean, "c_nationkey").join(n, "c_nationkey").select("c_custkey", r(F.col("c_acctbal") - F.col("m"), "residual", 4), "n_name")


@query("j19_aligned_labels", "WITH a AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) AS position FROM customer) SELECT c_custkey, position, round(c_acctbal, 2) AS value, n FROM a JOIN (SELECT c_custkey AS k, length(c_mktsegment) AS n FROM customer) ON k = c_custkey")
def j19(spark, sf_dir):
    """Two tables that must hold the same keys in the same order."""
    c = table(spark, sf_dir, "customer")
    left = evaluation.positions(c.select("c_custkey", F.round("c_acctbal", 2).alias("value")), ["c_custkey"])
    right = evaluation.positions(c.select("c_custkey", F.length("c_mktsegment").cast("long").alias("n")), ["c_custkey"])
    return evaluation.aligned(left, right, "c_custkey", "position").select("c_custkey", "position", "value", "n")


@query("u1_distinct_pairs", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def u1(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("u5_u6_union_missing", "SELECT n_name AS name, n_regionkey AS region, NULL::VARCHAR AS comment FROM nation UNION ALL SELECT r_name, NULL, 'METRICS' FROM region")
def u5(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("METRICS").alias("comment")), allowMissingColumns=True)


@query("u7_unmatched_ids", "(SELECT 'left' AS side, c_custkey AS id FROM customer EXCEPT SELECT 'left', o_custkey FROM orders) UNION ALL (SELECT 'right', o_custkey FROM orders EXCEPT SELECT 'right', c_custkey FROM customer)")
def u7(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return c.subtract(o).select(F.lit("left").alias("side"), "id").unionAll(o.subtract(c).select(F.lit("right").alias("side"), "id"))


@query("t1_canonical_order", "SELECT l_orderkey AS center, string_agg(l_returnflag, '' ORDER BY l_returnflag) AS kinds FROM lineitem GROUP BY l_orderkey")
def t1(spark, sf_dir):
    return neighbours(spark, sf_dir).groupBy("center").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", "d"))), lambda x: x["element"]), "").alias("kinds"))


@query("t4_head", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5")
def t4(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(5)


@query("r3_r4_names", "SELECT p_partkey, replace(p_name, ' ', '-') AS name, concat(p_brand, '_', p_size) AS descriptor FROM part")
def r3(spark, sf_dir):
    name = rules.base_name(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 2 == 0, "-gpaw-optimized.cif").otherwise("-optimized")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("descriptor"))


@query("y1_y5_vectors", "SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS e0, round(embedding[64]::DOUBLE, 5) AS e63, len(embedding) + 1 AS n FROM embeddings")
def y1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0))))
    return e.select("vec_id", r(F.col("v")[0], "e0", 5), r(F.col("v")[63], "e63", 5), F.size("v").cast("long").alias("n"))


@query("y2_wide_to_long", "SELECT property, count(*) AS n, round(sum(value), 3) AS total FROM (UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) ON size, price INTO NAME property VALUE value) GROUP BY property")
def y2(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "property", "value").groupBy("property").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), "total", 3))


@query("y3_metrics_map", "SELECT p_brand, round(max(p_size), 4) AS high, round(avg(p_size), 4) AS mean FROM part GROUP BY p_brand")
def y3(spark, sf_dir):
    m = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.map_from_arrays(F.array(F.lit("high"), F.lit("mean")), F.array(F.max("p_size").cast("double"), F.avg("p_size"))).alias("m"))
    return m.select("p_brand", r(F.col("m")["high"], "high", 4), r(F.col("m")["mean"], "mean", 4))


@query("a16_a27_dataset_stats", "SELECT count(DISTINCT l_orderkey) AS materials, count(*) AS bonds, round(count(*) / count(DISTINCT l_orderkey), 6) AS mean_bonds, count(DISTINCT l_returnflag) AS models FROM lineitem")
def a16(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey").alias("materials"), F.count(F.lit(1)).alias("bonds"), r(F.count(F.lit(1)) / F.countDistinct("l_orderkey"), "mean_bonds"), F.countDistinct("l_returnflag").alias("models"))
