"""Readers and writers of structure, feature, tensor, grid, embedding and report files.

Files of one row order (atoms) are read whole, one row a file, and split with their position, so the
position becomes ``site_index``; other tables are CSV scans whose columns go by each file's own header, or JSON scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions.geometry import frac_to_cart, lattice
from facetry.functions.rules import base_name
from facetry.session import cut

# The columns of an atom table in order.
ATOM_COLUMNS = [
    "atomic_number", "electronegativity", "ionization_energy", "electron_affinity", "valence_electrons", "ionic_radius", "covalent_radius", "coordination_number", "avg_site_valence", "bond_valence_sum",
    "bader_charge", "electrostatic_potential", "electron_density", "elf", "local_magnetic_moment", "local_dos_fermi", "s_electron_count", "p_electron_count", "d_electron_count",
    "bond_length_distortion", "vectorial_asymmetry_norm_sq", "mean_squared_neighbor_distance", "local_environment_anisotropy", "symmetry_breaking_quotient", "site_symmetry_order",
    "H0_persistence_max_death", "H0_persistence_death_std", "local_env_entropy", "local_variational_free_energy",
    "tensor_trace", "tensor_determinant", "tensor_eigenvalue_1", "tensor_eigenvalue_2", "tensor_eigenvalue_3", "tensor_variance",
    "structure_chemistry_incompatibility", "charge_weighted_local_size", "elf_weighted_local_anisotropy", "lie_algebra_norm", "lie_algebra_principal_angle",
]
GROUPS = {"A": ATOM_COLUMNS[:10], "B": ATOM_COLUMNS[10:19], "C": ATOM_COLUMNS[19:35], "D": ATOM_COLUMNS[35:]}
# The atom columns from which bond columns are derived.
CORE_COLUMNS = [
    "electronegativity", "bader_charge", "electron_density", "elf", "local_dos_fermi", "local_environment_anisotropy", "symmetry_breaking_quotient",
    "structure_chemistry_incompatibility", "lie_algebra_norm", "lie_algebra_principal_angle", "local_variational_free_energy",
]
TENSOR_COLUMNS = [f"T_struct_{i}{j}" for i in range(3) for j in range(3)]
BOND_SUFFIX, TRIANGLE_SUFFIX = "-gpaw-1-Simplex-Features.csv", "-gpaw-2-Simplex-Features.csv"
# The columns of bond and triangle tables that are not doubles.
ID_TYPES = {
    "site1_index": "int", "site2_index": "int", "site1_element": "string", "site2_element": "string", "image_x": "int", "image_y": "int", "image_z": "int",
    "atom_index_i": "int", "atom_index_j": "int", "atom_index_k": "int", "atom_symbol_i": "string", "atom_symbol_j": "string", "atom_symbol_k": "string",
}
KINDS = ("0-Simplex-Features", "1-Simplex-Features", "2-Simplex-Features")


def file_name(path: Column) -> Column:
    """The last part of a file's URI, with escaped characters as they are."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """name, line_no, line of every file: a file is one row until it is split, so the order is the file's."""
    files = spark.read.text(path, wholetext=True).select(file_name(F.col("_metadata.file_path")).alias("name"), "value")
    return files.select("name", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")


def scan_atoms(spark: SparkSession, directory: str, suffix: str = "-gpaw-0-Simplex-Features.csv") -> DataFrame:
    """material, site_index and the header's columns as doubles; header-less columns are NULL."""
    lines = whole_lines(spark, f"{directory}/*{suffix}")
    header = F.max(F.when(F.col("line_no") == 0, F.split("line", ","))).alias("header")
    names = lines.groupBy("name").agg(header)
    rows = lines.where("line_no > 0").join(names, "name").withColumn("cells", F.split("line", ","))
    value = lambda c: F.try_element_at("cells", F.nullif(F.array_position("header", c), F.lit(0)).cast("int"))
    return rows.select(
        F.replace("name", F.lit(suffix), F.lit("")).alias("material"), (F.col("line_no") - 1).cast("int").alias("site_index"),
        *[no_nan(value(F.lit(c)).try_cast("double")).alias(c) for c in ATOM_COLUMNS])


def no_nan(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def file_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, header (array<string>) of each CSV file: its first line, from the file's first split alone. Empty files are absent."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), "value", F.monotonically_increasing_id().alias("_n"))
    first = lines.where("_at = 0").groupBy("path").agg(F.min_by("value", "_n").alias("line"))
    names = F.transform(F.split(F.regexp_replace("line", "^\ufeff|\r$", ""), ","), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    # Read again, a path is a pattern: what patterns give a meaning is escaped.
    return first.select(F.regexp_replace(plain, r"([\\{}\[\]*?])", r"\\$1").alias("path"), names.alias("header"))


def scan_named(spark: SparkSession, path: str | list[str], types: dict[str, str] | None = None, default: str = "double", base: str | None = None, most: int = 1000) -> DataFrame:
    """The rows of CSV files with the columns of all their headers, each by its name, and ``_path``.

    Files may hold other columns, or the same in another order: the headers are a manifest with one row a file, files of
    one header are read together with the schema that it gives, and the parts are united by name; what a file lacks is
    NULL. Folders ``name=value`` under ``base`` are columns too. ``types`` has the types of columns that are not of type ``default``; nothing is inferred. More than ``most``
    different headers raise an error.
    """
    types = types or {}
    grouped = file_headers(spark, path).groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy(F.to_json("header")).limit(most + 1).collect()
    if len(grouped) > most:
        raise ValueError(f"more than {most} different headers")
    out = None
    for r in grouped:
        if len(set(r["header"])) < len(r["header"]):
            raise ValueError(f"a header names a column twice: {r['header']}")
        schema = ", ".join(f"`{c}` {types.get(c, default)}" for c in r["header"])
        reader = spark.read.schema(schema).option("header", True).option("nanValue", "nan")
        part = (reader.option("basePath", base) if base else reader).csv(r["paths"]).withColumn("_path", F.col("_metadata.file_path"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], ", ".join([*[f"`{c}` {t}" for c, t in types.items()], "_path string"]))
    numbers = {c for c, t in out.dtypes if t in ("double", "float")}
    return out.select(*[no_nan(F.col(c)).alias(c) if c in numbers else F.col(c) for c in out.columns])


def scan_table(spark: SparkSession, path: str | list[str], suffix: str, types: dict[str, str] | None = None) -> DataFrame:
    """A CSV table of pairs or triples with ``material`` from the file name, columns by name (:func:`scan_named`)."""
    df = scan_named(spark, path, ID_TYPES | (types or {}))
    return df.withColumn("material", F.replace(file_name(F.col("_path")), F.lit(suffix), F.lit(""))).drop("_path")


def scan_bonds(spark: SparkSession, directory: str) -> DataFrame:
    return scan_table(spark, f"{directory}/*{BOND_SUFFIX}", BOND_SUFFIX)


def scan_triangles(spark: SparkSession, directory: str) -> DataFrame:
    return scan_table(spark, f"{directory}/*{TRIANGLE_SUFFIX}", TRIANGLE_SUFFIX)


def scan_tensors(spark: SparkSession, path: str) -> DataFrame:
    """site_index, tensor array<double>; an absent file gives an empty relation."""
    schema = "site_index INT, " + ", ".join(f"{c} DOUBLE" for c in TENSOR_COLUMNS)
    try:
        df = spark.read.schema(schema).option("header", True).csv(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], schema)
    return df.select("site_index", F.array(*TENSOR_COLUMNS).alias("tensor"))


def list_materials(spark: SparkSession, directory: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-optimized.cif").load(directory)
    return files.select(base_name(file_name(F.col("path"))).alias("material"))


def scan_structures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lattices, sites) of flat P1 files: cell keys by name, sites from the _atom_site_ loop in file order."""
    files = spark.read.text(path, wholetext=True).select(base_name(file_name(F.col("_metadata.file_path"))).alias("material"), F.col("value").alias("t"))
    number = lambda key: F.regexp_extract("t", rf"(?m)^{key}\s+([-+0-9.eE]+)", 1).try_cast("double")
    abc = [number(f"_cell_length_{k}") for k in "abc"] + [number(f"_cell_angle_{k}") for k in ("alpha", "beta", "gamma")]
    cells = files.select("material", "t", *[x.alias(n) for x, n in zip(abc, ("a", "b", "c", "alpha", "beta", "gamma"))])
    cells = cells.withColumn("cell", lattice(*[F.col(n) for n in ("a", "b", "c", "alpha", "beta", "gamma")]))
    volume = F.col("cell")[0] * F.col("cell")[4] * F.col("cell")[8]
    loop = F.regexp_extract("t", r"(?s)loop_\s*((?:\s*_atom_site_\S+\s*\n)+)", 1)
    body = F.regexp_extract("t", r"(?s)loop_\s*(?:\s*_atom_site_\S+\s*\n)+(.*?)(?:\n\s*(?:loop_|_)|\z)", 1)
    rows = cells.select("material", "cell", F.regexp_extract_all(loop, F.lit(r"_atom_site_(\S+)"), 1).alias("keys"), F.posexplode(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")).alias("site_index", "line"))
    rows = rows.withColumn("w", F.split(F.trim("line"), r"\s+"))
    field = lambda k: F.try_element_at("w", F.nullif(F.array_position("keys", F.lit(k)), F.lit(0)).cast("int"))
    fraction = F.array(*[F.regexp_replace(field(f"fract_{k}"), r"\(.*\)", "").try_cast("double") for k in "xyz"])
    element = F.regexp_extract(F.coalesce(field("type_symbol"), field("label")), r"^([A-Z][a-z]?)", 1)
    sites = rows.select("material", "site_index", element.alias("element"), fraction.alias("frac"), "cell").withColumn("cart", frac_to_cart(F.col("cell"), F.col("frac"))).drop("cell")
    return cells.drop("t").withColumn("volume", volume), sites


def scan_charge_report(spark: SparkSession, path: str) -> DataFrame:
    """name, atom (from 1), electrons: lines after two headers with five tokens and a numeric first one; token 5 (index 4)."""
    rows = whole_lines(spark, path).where("line_no >= 2").withColumn("w", F.split(F.trim("line"), r"\s+"))
    return rows.where((F.size("w") >= 5) & F.col("w")[0].rlike("^[0-9]+$")).select("name", F.col("w")[0].cast("int").alias("atom"), F.col("w")[4].cast("double").alias("electrons"))


def scan_run_config(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON file; keys that a file lacks are NULL."""
    return spark.read.option("multiLine", True).json(path).withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))


def with_default(column: str, default) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def scan_embeddings(spark: SparkSession, path: str | list[str], size: int = 128) -> DataFrame:
    """model, material, computation_time, emb array<double>, columns by name; the columns of partition folders count too."""
    df = scan_named(spark, path, {"model": "string", "material": "string"}, base=path if isinstance(path, str) and "*" not in path else None)
    return df.select("model", "material", "computation_time", F.array(*[F.col(f"emb_{i}") for i in range(size)]).alias("emb"))


def labels_relation(spark: SparkSession, labels: dict[str, dict[str, float]]) -> DataFrame:
    """material, property, value, position of a literal mapping, in its order."""
    rows = [(m, p, float(v), i) for i, (m, ps) in enumerate(labels.items()) for p, v in ps.items()]
    return spark.createDataFrame(rows, "material string, property string, value double, position int")


def scan_global_features(spark: SparkSession, path: str | list[str], types: dict[str, str] | None = None) -> DataFrame:
    """A row a material from files of possibly different headers; columns are doubles but the hash and those in ``types``."""
    df = scan_named(spark, path, {"structure_hash": "string"} | (types or {}))
    return df.withColumn("material", F.regexp_replace(file_name(F.col("_path")), r"-Global-Features\.csv$", "")).drop("_path")


def write_grid(grid: DataFrame, path: str) -> None:
    """Partitioned by field, so a scan of one field reads only its files."""
    grid.write.mode("overwrite").partitionBy("field").parquet(path)


def scan_grid(spark: SparkSession, path: str, field: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("field") == field)


def ordered_atoms(df: DataFrame, keys: tuple[str, ...] = ("material", "site_index")) -> DataFrame:
    """Keys and the 40 columns in order; missing ones are NULL."""
    return df.select(*keys, *[(F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in ATOM_COLUMNS])


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def file_system(uri: str):
    """(file system, path) of a Hadoop-style URI, for tasks that write files of their own."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_named(files: DataFrame, folder: str) -> int:
    """One file a row (name, content) in ``folder``, for formats with a file a structure; the number of files.

    A file is written under a temporary name and moved, so a repeated task replaces equal bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, root = file_system(folder)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = f"{root}/{name}"
                place.create_dir(path.rpartition("/")[0], recursive=True)
                with place.open_output_stream(f"{path}.{TaskContext.get().taskAttemptId()}._COPYING_") as f:
                    f.write((content or "").encode())
                place.move(f"{path}.{TaskContext.get().taskAttemptId()}._COPYING_", path)
            yield pa.RecordBatch.from_pydict({"n": [len(b)]})

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_lines(lines: DataFrame, folder: str) -> int:
    """One file a name in ``folder``, of its header and its lines; the number of files.

    lines: name, header (one a name), o (any order), line. A task sorts the lines of its names and passes them on in batches,
    so no file is held whole. Files are moved into place as in :func:`write_named`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, root = file_system(folder)
        mark = f".{TaskContext.get().taskAttemptId()}._COPYING_"
        name, f, n = None, None, 0
        try:
            for b in batches:
                names, headers = b.column(0).to_pylist(), b.column(1)
                cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
                for start, end in zip(cuts, cuts[1:]):
                    if start == end:
                        continue
                    if names[start] != name:
                        if f is not None:
                            f.close()
                            place.move(f"{root}/{name}{mark}", f"{root}/{name}")
                        name, n = names[start], n + 1
                        place.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                        f = place.open_output_stream(f"{root}/{name}{mark}")
                        f.write((headers[start].as_py() + "\n").encode())
                    f.write(("\n".join(b.column(2).slice(start, end - start).to_pylist()) + "\n").encode())
            if f is not None:
                f.close()
                place.move(f"{root}/{name}{mark}", f"{root}/{name}")
                f = None
        finally:
            if f is not None:
                f.close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    ranged = lines.repartition("name").sortWithinPartitions("name", "o", "line").select("name", "header", "line")
    return ranged.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def csv_content(order: str, columns: list[str]) -> Column:
    """Aggregate: header and rows of a CSV file, in the order of a column."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), csv_line(columns).alias("r")))), lambda x: x["r"])
    return F.concat(F.lit(",".join(columns) + "\n"), F.array_join(lines, "\n"), F.lit("\n"))


def tensor_rows(df: DataFrame) -> DataFrame:
    return df.select("site_index", *[F.col("tensor")[i].alias(c) for i, c in enumerate(TENSOR_COLUMNS)])


def ids_first(df: DataFrame, ids: list[str]) -> DataFrame:
    """Id columns first, the rest in their order; an empty relation keeps the schema."""
    return df.select(*ids, *[c for c in df.columns if c not in ids])


def embedding_rows(df: DataFrame, size: int, digits: int = 6) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "emb"], *[F.round(F.col("emb")[i], digits).alias(f"emb_{i}") for i in range(size)])


def unprocessed(inputs: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Inputs whose output is not there yet; all of them on ``overwrite``."""
    return inputs if overwrite else inputs.join(done.select(key).distinct(), key, "left_anti")


def finished(spark: SparkSession, path: str, key: str, kind: str = "string") -> DataFrame:
    """key, run: the keys whose results stand in ``path``, each with the run that wrote them last; empty before the first run."""
    schema = f"`{key}` {kind}, run long"
    try:
        manifest = spark.read.schema(schema).parquet(f"{path}/manifest")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return manifest.groupBy(key).agg(F.max("run").alias("run"))


def write_results(inputs: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, key: str, overwrite: DataFrame | bool = False) -> int:
    """Make and write the results of the inputs that have none yet, or that ``overwrite`` (True, or a relation of keys) names; the run's number.

    Results are partitioned by ``key``, and a run replaces exactly the partitions of its own keys. The manifest of
    finished keys is appended last, so a run that dies leaves its keys unfinished and the next one writes them again. A row carries its
    run; rows of an older run than its key's last one are not read, so a key whose new result is empty has no rows.
    """
    spark, kind = inputs.sparkSession, dict(inputs.dtypes)[key]
    done = cut(finished(spark, path, key, kind))
    run = (done.agg(F.max("run")).first()[0] or 0) + 1
    todo = unprocessed(inputs, done, key, overwrite is True)
    if isinstance(overwrite, DataFrame):
        todo = unprocessed(inputs, done.join(overwrite.select(key), key, "left_anti"), key)
    keys = cut(todo.select(key).distinct().withColumn("run", F.lit(run).cast("long")))
    rows = make(todo).withColumn("_run", F.lit(run).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path}/rows")
    keys.write.mode("append").parquet(f"{path}/manifest")
    return run


def read_results(spark: SparkSession, path: str, key: str, kind: str = "string") -> DataFrame:
    """The finished results of all keys."""
    done = finished(spark, path, key, kind)
    rows = spark.read.parquet(f"{path}/rows").withColumn(key, F.col(key).cast(kind))
    return rows.join(done.withColumnRenamed("run", "_run"), [key, "_run"]).drop("_run")


def load_report(files: DataFrame, required: tuple[int, ...] = (0, 1)) -> DataFrame:
    """files (material, k) -> material, has_0, has_1, has_2, loaded, missing."""
    has = files.groupBy("material").agg(*[F.max((F.col("k") == k).cast("int")).cast("boolean").alias(f"has_{k}") for k in range(3)])
    missing = F.filter(F.array(*[F.when(~F.col(f"has_{k}"), F.lit(KINDS[k])) for k in required]), lambda x: x.isNotNull())
    return has.withColumn("missing", F.array_join(missing, ",")).withColumn("loaded", F.col("missing") == "")


def numeric_columns(df: DataFrame, excluded: tuple[str, ...] = ("index", "site", "vertex", "element", "symbol")) -> list[str]:
    """Names of castable columns that contain none of the excluded words."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, kind in df.dtypes if kind in numbers and not any(w in c.lower() for w in excluded)]


def edge_features(df: DataFrame) -> DataFrame:
    return df.drop("site1_index", "site2_index", "site1_element", "site2_element")


def triangle_keys(df: DataFrame) -> list[str] | None:
    """Names of the three vertex columns: vertex_0.., site_i.., else the first three with index or site; else None."""
    for names in (["vertex_0", "vertex_1", "vertex_2"], ["site_i", "site_j", "site_k"]):
        if set(names) <= set(df.columns):
            return names
    found = [c for c in df.columns if "index" in c.lower() or "site" in c.lower()][:3]
    return found if len(found) == 3 else None
