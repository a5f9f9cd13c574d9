"""First-fit decreasing packing with a tournament tree, in randomised groups of documents.

Documents become ids, whole sequences are cut off, and the rests (shorter than a sequence) are dealt
at random to groups of bounded size. In a group the rests go by falling length into the first bin
with room; a tournament tree over the bins' free space finds that bin in log(bins) steps. A group
leaves one badly filled bin or so, which is little beside its hundreds of full ones.

Edge cases: null and empty texts are the end id alone; repeated rows are documents of their own; an
empty table gives no rows; a text of any length is encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.tokens import encoder, slices
from facetry.session import written

LONE = 1 << 62


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, most: int = 4096, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, nth (, ids: little-endian unsigned 32-bit) of every piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long" + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for b in batches:
            for x, y in slices(b.column(1)):
                ids, tokens = encoder(vocabulary, False, end_id).encode(b.column(1).slice(x, y - x))
                wide = ids.astype("<u4")
                cuts = -(-tokens // most)
                doc = np.repeat(np.arange(len(tokens)), cuts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * most
                length = np.minimum(most, tokens[doc] - start)
                at = (np.cumsum(tokens) - tokens)[doc] + start
                parts = [wide[a:z] for a, z in zip(at, at + length)]
                crcs = np.fromiter(map(zlib.crc32, parts), np.int64, len(parts))
                columns = [b.column(0).take(pa.array(doc + x)).cast(pa.int64()), *map(pa.array, (start, length, crcs, tokens[doc], np.arange(nth, nth + len(doc))))]
                nth += len(doc)
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([p.tobytes() for p in parts], pa.binary())] if keep_ids else []), names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, in the given order, each into the first bin with room.

    ``free[leaves + i]`` is bin i's free space; every inner node holds the larger of its children.
    """
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    free = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out.append(node - leaves)
        free[node] -= size
        while node > 1:
            node //= 2
            a, b = free[2 * node], free[2 * node + 1]
            best = a if a > b else b
            if free[node] == best:
                break
            free[node] = best
    return out


def packed(parts: DataFrame, most: int = 4096, group_rows: int = 8192, seed: int = 29) -> DataFrame:
    """``parts`` (doc_id, start, length, nth, ...) with sequence_id and offset added, nth dropped."""
    kept = written(parts, "pieces")
    rests = kept.where(F.col("length") < most)
    groups = max(1, -(-rests.count() // group_rows))
    rest_of = [c for c in kept.columns if c != "nth"]

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "_h", "nth"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins = np.array(first_fit(g["length"].tolist(), most))
        before = g["length"].groupby(bins).cumsum() - g["length"]
        return g[rest_of].assign(sequence_id=g["_g"].to_numpy() * (1 << 24) + bins, offset=before)

    fields = kept.select(*rest_of).schema.add("sequence_id", "long").add("offset", "long")
    dealt = rests.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "nth")).withColumn("_g", F.pmod("_h", F.lit(groups)))
    full = kept.where(F.col("length") >= most).select(*rest_of, (F.monotonically_increasing_id() + LONE).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("_g").applyInPandas(pack, fields).unionAll(full)


def pack_documents(docs: DataFrame, vocabulary: str, most: int = 4096, **kw) -> DataFrame:
    return packed(pieces(docs, vocabulary, most=most), most, **kw)


def sequences(docs: DataFrame, vocabulary: str, most: int = 4096) -> DataFrame:
    """sequence_id, ids array<long>: the packed sequences themselves, padded by nothing."""
    rows = packed(pieces(docs, vocabulary, most=most, keep_ids=True), most)
    together = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int64) for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], names=["sequence_id", "ids"])

    return together.mapInArrow(widen, "sequence_id long, ids array<long>")
