"""Merkle fixity audit of archive replicas, on the bytes of their files.

A replica is a folder of WARC files and an index: file, position, record id, copy, offset, length. An audit reads the
files again, range by range of the index, and hashes what it finds; a range beyond a file's end has the bytes that are
there. Files may be packed, each record a gzip member as in .warc.gz: offset and length are then those of the unpacked
file, ``at`` and ``stored`` the member's place; members are made before the records are shuffled, so shuffle and files
both hold packed records only. A member that does not unpack has the digest of its bytes as they are. Records in order of offset make trees: a record whose key (id and copy) hashes to a multiple of ``fanout`` begins
a new node, one that hashes to a multiple of its square begins a node of the next level too, and so on up to the file's
root; files in order make nodes up to one root a replica. A node's hash covers the number of bytes in its range and its
children's hashes in order. Because ranges begin at keys, a lost or added record changes the nodes above it and, if it
began one, the node before, but moves no other range.

An audit compares the roots and goes down only into branches that differ; at the bottom it compares single records.

Edge cases: null urls and pages are empty; null ids are records of id null; equal records are told apart by a copy number
and spread over files; empty replicas have no nodes and equal roots. A very long page is one record, held whole by the
task that writes or reads it. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.session import cut, remove_folder, shared_dir, small, written
from facetry.sources.io import file_system

INDEX = "file long, seq long, record_id long, copy long, offset long, length long, at long, stored long"
GZIP = 31  # zlib's window bits for a gzip member; its header has no time, so equal records make equal members


def record_text(url: Column, payload: Column, stored: Column | None = None) -> Column:
    """A WARC 1.0 resource record; ``stored``: the payload's bytes as a damaged copy holds them."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/html\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body if stored is None else stored, F.lit("\r\n\r\n"))


def key_name(record_id: str = "record_id", copy: str = "copy") -> Column:
    return F.concat(F.coalesce(F.col(record_id).cast("string"), F.lit("null")), F.lit("#"), F.col(copy).cast("string"))


def file_path(folder: str, file: int) -> str:
    return f"{folder}/part-{file:08d}.warc"


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``record``, the last column, as a gzip member."""
    for b in batches:
        packed = pa.array([zlib.compress(x.as_py(), 6, GZIP) for x in b.column("record")], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names=b.schema.names)


def unpacked(stored: bytes) -> bytes:
    try:
        return zlib.decompress(stored, GZIP)
    except zlib.error:
        return stored


def write_archive(records: DataFrame, files: int, folder: str, packed: bool = False) -> DataFrame:
    """Write records (record_id, record) to ``files`` WARC files, ``packed`` or not; the index (INDEX), cut from its lineage.

    A file's records are in order of id, digest and copy. A file is written under a temporary name and moved, so a
    repeated task leaves equal bytes.
    """
    known = records.select(F.col("record_id").cast("long").alias("record_id"), F.encode("record", "UTF-8").alias("record")).withColumn("digest", F.sha2("record", 256))
    # Records that have equals are one row until they have their copy numbers; the others, most of all, go to their file at once.
    alike = cut(known.groupBy("record_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    n = alike.count()
    copies = known.withColumn("copy", F.lit(1).cast("long"))
    if n:
        marked = alike.select(F.col("record_id").alias("_i"), F.col("digest").alias("_d"))
        same = F.col("record_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d"))
        each = known.join(small(marked, n), same, "left_semi").groupBy("record_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("record").alias("record"))
        each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
        copies = copies.join(small(marked, n), same, "left_anti").unionByName(each)
    placed = copies.withColumn("file", F.conv(F.substring(F.md5(F.encode(key_name(), "UTF-8")), 1, 8), 16, 10).cast("long") % files)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, root = file_system(folder)
        place.create_dir(root, recursive=True)
        attempt, now, out = TaskContext.get().taskAttemptId(), None, None

        def close() -> None:
            if out is not None:
                out.close()
                place.move(f"{file_path(root, now)}.{attempt}", file_path(root, now))

        for b in batches:
            rows = []
            for i in range(len(b)):
                file, record_id, copy, length, record = (b.column(c)[i].as_py() for c in range(5))
                if file != now:
                    close()
                    now, seq, offset, at = file, 0, 0, 0
                    out = place.open_output_stream(f"{file_path(root, file)}.{attempt}")
                out.write(record)
                rows.append((file, seq, record_id, copy, offset, length, at, len(record)))
                seq, offset, at = seq + 1, offset + length, at + len(record)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=INDEX.replace(",", "").split()[::2])
        close()

    placed = placed.select("file", "record_id", "copy", F.octet_length("record").cast("long").alias("length"), "digest", "record")
    if packed:
        placed = placed.mapInArrow(members, placed.schema)
    ordered = placed.repartition("file").sortWithinPartitions("file", "record_id", "digest", "copy")
    return written(ordered.drop("digest").mapInArrow(save, INDEX), "warc-index")


def read_archive(index: DataFrame, folder: str, packed: bool = False) -> DataFrame:
    """The index with ``digest``: SHA-256 of the bytes that each range of the files holds now, unpacked if they are
    ``packed``. A file that is gone holds none."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = file_system(folder)
        now, f = None, None
        for b in batches:
            digests = []
            for file, at, stored in zip(b.column("file").to_pylist(), b.column("at").to_pylist(), b.column("stored").to_pylist()):
                if file != now:
                    if f is not None:
                        f.close()
                    now = file
                    f = place.open_input_file(file_path(root, file)) if place.get_file_info(file_path(root, file)).is_file else None
                    size = f.size() if f is not None else 0
                held = f.read_at(stored, at) if at < size else b""
                digests.append(hashlib.sha256(unpacked(held) if packed else held).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests)], names=[*b.schema.names, "digest"])
        if f is not None:
            f.close()

    columns = INDEX.replace(",", "").split()[::2]
    return index.select(*columns).repartition("file").sortWithinPartitions("file", "at").mapInArrow(look, f"{INDEX}, digest string")


def replica(records: DataFrame, files: int, folder: str | None = None) -> DataFrame:
    """Records (record_id, record) written to WARC files in ``folder`` and read again: INDEX and digest."""
    folder = folder or f"{shared_dir(records.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archive(write_archive(records, files, folder), folder)


def ranged(records: DataFrame, levels: int, fanout: int) -> DataFrame:
    """Records with the names g1 .. of the nodes that hold them: the last key at or before the record that begins a node of that level."""
    order = W.partitionBy("file").orderBy("record_id", "copy")
    h = F.pmod(F.xxhash64(key_name()), F.lit(fanout**levels))
    named = records.withColumn("_h", h).withColumn("_name", key_name())
    last = lambda level: F.coalesce(F.last(F.when(F.col("_h") % fanout**level == 0, F.col("_name")), ignorenulls=True).over(order), F.lit(""))
    return named.withColumns({f"g{level}": last(level) for level in range(1, levels + 1)}).drop("_h", "_name")


def tree(records: DataFrame, levels: int, upper: int, fanout: int) -> list[DataFrame]:
    """Nodes (file, node, up, bytes, hash) of each level above the records: ``levels`` by keys inside files, one root a file, ``upper`` above them."""
    out = []
    below = records.select("file", F.struct("record_id", "copy").alias("at"), *[f"g{i}" for i in range(1, levels + 1)], F.col("length").alias("bytes"), F.sha2(F.concat_ws("|", F.col("record_id").cast("string"), F.col("length").cast("string"), "digest"), 256).alias("hash"))

    def united(rows: DataFrame, by: list[Column], rest: list[str]) -> DataFrame:
        of = rows.groupBy(*by).agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in rest], F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("c"))
        return of.withColumn("hash", F.sha2(F.concat_ws("|", F.col("bytes").cast("string"), F.array_join(F.transform("c", lambda x: x["hash"]), "|")), 256)).drop("c")

    for level in range(1, levels + 1):
        below = written(united(below, ["file", f"g{level}"], [f"g{i}" for i in range(level + 1, levels + 1)]).withColumnRenamed(f"g{level}", "node"), "merkle")
        out.append(below.withColumn("up", F.col(f"g{level + 1}") if level < levels else F.lit("")))
    roots = written(united(out[-1].drop("node", "up"), ["file"], []), "merkle")
    for level in range(upper + 1):
        out.append(roots.select("file", F.lit("").alias("node"), F.lit("").alias("up"), "bytes", "hash"))
        if level < upper:
            roots = written(united(roots.select(F.floor(F.col("file") / fanout).alias("_up"), F.struct(F.col("file").alias("record_id"), F.lit(0).cast("long").alias("copy")).alias("at"), "bytes", "hash"), ["_up"], []).withColumnRenamed("_up", "file"), "merkle")
    return out


def audit(left: DataFrame, right: DataFrame, fanout: int = 16, visited: list[int] | None = None) -> DataFrame:
    """record_id, kind (changed, missing, extra), file, record_offset, record_length, digest_left, digest_right of
    every record in which ``right`` differs from ``left`` (both: INDEX and digest). Loops over levels; one count a level is
    read, and appended to ``visited``: nodes that differ, from the roots down."""
    both = [written(x, "replica") for x in (left, right)]
    most = both[0].unionAll(both[1]).agg(F.max("seq"), F.max("file")).first()
    depth = lambda n: next(i for i in range(64) if fanout**i > n)
    levels, upper = max(1, depth(most[0] or 0)), depth(most[1] or 0)
    both = [written(ranged(x, levels, fanout), "ranges") for x in both]
    trees = [tree(x, levels, upper, fanout) for x in both]
    suspects = None
    for level in range(len(trees[0]) - 1, -1, -1):
        a, b = (t[level].select("file", "node", "up", F.col("hash").alias(h)) for t, h in zip(trees, ("a", "b")))
        if suspects is not None:
            file = F.floor(F.col("file") / fanout) if level >= levels else F.col("file")
            a, b = (x.withColumn("_f", file).withColumn("_n", F.col("up")).join(suspects, ["_f", "_n"], "left_semi").drop("_f", "_n") for x in (a, b))
        suspects = cut(a.drop("up").join(b.drop("up"), ["file", "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("file").alias("_f"), F.col("node").alias("_n")))
        n = suspects.count()
        if visited is not None:
            visited.append(n)
        if not n:
            break
    sides = []
    for x, name in zip(both, ("left", "right")):
        here = x.withColumn("_f", F.col("file")).withColumn("_n", F.col("g1")).join(suspects, ["_f", "_n"], "left_semi")
        sides.append(here.select(
            F.coalesce(F.col("record_id").cast("string"), F.lit("null")).alias("_id"), F.col("file").alias("_file"), F.col("record_id").alias(f"id_{name}"), F.row_number().over(W.partitionBy("file", "record_id").orderBy("copy", "digest")).alias("_k"),
            F.col("offset").alias(f"offset_{name}"), F.col("length").alias(f"length_{name}"), F.col("digest").alias(f"digest_{name}")))
    kind = F.when(F.col("digest_right").isNull(), "missing").when(F.col("digest_left").isNull(), "extra").otherwise("changed")
    return sides[0].join(sides[1], ["_file", "_id", "_k"], "full_outer").where(~F.col("digest_left").eqNullSafe(F.col("digest_right"))).select(
        F.coalesce("id_left", "id_right").alias("record_id"), kind.alias("kind"), F.col("_file").alias("file"), F.col("offset_left").alias("record_offset"), F.col("length_left").alias("record_length"), "digest_left", "digest_right")


def page_audit(pages: DataFrame, file_records: int = 1024, folder: str | None = None) -> DataFrame:
    """The pages' archive against a replica of it, both written as packed WARC files and read again. In the replica, by the md5 of
    their url, some pages have one letter changed (first byte 00), some lost their last byte (01) and some are gone (02).
    The files stay if a ``folder`` is given; else they are removed once their digests are known."""
    kept, folder = folder is not None, folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    files = max(1, -(-pages.count() // file_records))
    mark = F.substring(F.md5(F.encode(F.coalesce(F.col("url"), F.lit("")), "UTF-8")), 1, 2)
    body = F.coalesce(F.col("html"), F.lit(""))
    damaged = F.when(mark == "00", F.concat(F.lit("~"), F.substring(body, 2, 1 << 30))).when(mark == "01", F.substring(body, F.lit(1), F.greatest(F.length(body) - 1, F.lit(0)))).otherwise(body)
    whole = pages.select(F.col("page_id").alias("record_id"), record_text(F.col("url"), F.col("html")).alias("record"))
    other = pages.where(mark != "02").select(F.col("page_id").alias("record_id"), record_text(F.col("url"), F.col("html"), damaged).alias("record"))
    sides = []
    for rows, name in ((whole, "first"), (other, "second")):
        index = write_archive(rows, files, f"{folder}/{name}", packed=True)
        sides.append(written(read_archive(index, f"{folder}/{name}", packed=True), "replica"))
        if not kept:
            remove_folder(pages.sparkSession, f"{folder}/{name}")
    return audit(*sides)
