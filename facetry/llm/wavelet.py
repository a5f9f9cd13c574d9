"""Token shards as wavelet matrices: one compressed file a shard, with access, rank, select and count.

Plane l holds bit l (from the top) of every token, after the tokens were stably parted by the bits
above. Planes are stored in compressed blocks with the number of ones before each block, so a lookup
reads one block a plane. The file also lists document ids and lengths.

Layout: b"FWM1", header length (uint32), JSON header, then the sections it lists (offset, size): the
directory and, plane by plane, the blocks. A task holds a range of doc_id in ascending order and closes
a shard whenever its texts reach ``shard_bytes``, so memory is bounded by that and one text, however
sizes are spread. Files are written to the shared folder under a temporary name and moved, so a repeated
task replaces equal bytes.

Edge cases: null and empty texts are the end id alone; null ids come first; rows of equal ids stand by
their text; an empty table has no files and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.llm.tokens import encoder, slices
from facetry.session import cut, shared_dir

MAGIC, BLOCK = b"FWM1", 1 << 16  # bytes of a plane's block before compression
STEP = 1 << 17  # tokens that are parted at once, so that their positions stay in the processor's cache


def parted(now: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed bits of ``level``, tokens with the bit clear and then those with it set, in their order)."""
    out, ones = np.empty_like(now), np.empty_like(now)
    bits, bit = np.empty(-(-len(now) // 8), np.uint8), now.dtype.type(1 << level)
    z = o = 0
    for a in range(0, len(now), STEP):
        x = now[a : a + STEP]
        is_one = (x & bit) != 0
        bits[a // 8 : -(-(a + len(x)) // 8)] = np.packbits(is_one, bitorder="little")
        i = np.flatnonzero(is_one)
        np.take(x, i, out=ones[o : o + len(i)], mode="clip")
        o += len(i)
        i = np.flatnonzero(~is_one)
        np.take(x, i, out=out[z : z + len(i)], mode="clip")
        z += len(i)
    out[z:] = ones[:o]
    return bits, out


def build(tokens: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file's bytes for a shard's tokens (unsigned integers) and its documents in order."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    levels = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    directory = pack(json.dumps(doc_ids).encode() + b"\n" + lengths.astype("<i8").tobytes())
    sections, planes, now = [directory], [], tokens
    for level in range(levels - 1, -1, -1):
        bits, now = parted(now, level)
        before, ends = [0], []
        for a in range(0, len(bits), BLOCK):
            ends.append(len(sections))
            before.append(before[-1] + int(np.bitwise_count(bits[a : a + BLOCK]).sum()))
            sections.append(pack(bits[a : a + BLOCK].tobytes()))
        planes.append({"blocks": ends, "ones": before})
    at = np.cumsum([0, *map(len, sections)]).tolist()
    header = json.dumps({"n": len(tokens), "levels": levels, "at": at, "planes": planes}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(sections)


class WaveletFile:
    """Reads a shard; ``source`` is bytes or a seekable binary file. Blocks are decompressed on use."""

    def __init__(self, source):
        import io

        import zstandard

        self.file = io.BytesIO(source) if isinstance(source, (bytes, memoryview)) else source
        self.unpack = zstandard.ZstdDecompressor().decompress
        start = self.file.read(8)
        if start[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack("<I", start[4:])[0]
        head = json.loads(self.file.read(size))
        self.n, self.levels, self.at, self.planes, self.base = head["n"], head["levels"], head["at"], head["planes"], 8 + size
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def _section(self, i: int) -> bytes:
        self.file.seek(self.base + self.at[i])
        return self.unpack(self.file.read(self.at[i + 1] - self.at[i]))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids, _, lengths = self._section(0).partition(b"\n")
        return json.loads(ids), np.frombuffer(lengths, "<i8")

    def _bits(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self.held:
            if len(self.held) > 256:
                self.held.clear()
            self.held[plane, block] = np.unpackbits(np.frombuffer(self._section(self.planes[plane]["blocks"][block]), np.uint8), bitorder="little")
        return self.held[plane, block]

    def _rank1(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK * 8)
        ones = self.planes[plane]["ones"][block]
        return ones + (int(self._bits(plane, block)[:rest].sum()) if rest else 0)

    def _zeros(self, plane: int) -> int:
        return self.n - self.planes[plane]["ones"][-1]

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.levels):
            bit = int(self._bits(p, i // (BLOCK * 8))[i % (BLOCK * 8)])
            ones = self._rank1(p, i)
            value = value * 2 + bit
            i = self._zeros(p) + ones if bit else i - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before ``end`` lie in the order below the last plane."""
        a, b = 0, end
        for p in range(self.levels):
            x, y = self._rank1(p, a), self._rank1(p, b)
            a, b = (self._zeros(p) + x, self._zeros(p) + y) if token >> (self.levels - 1 - p) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before position ``end``."""
        if token >> self.levels:
            return 0
        a, b = self._range(token, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence (from 0), found upwards through the planes."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for p in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - p) & 1
            want, ones = i - (self._zeros(p) if one else 0), self.planes[p]["ones"]
            before = ones if one else [min(b * BLOCK * 8, self.n) - o for b, o in enumerate(ones)]
            block = int(np.searchsorted(before, want, "right")) - 1
            bits = self._bits(p, block)[: self.n - block * BLOCK * 8]
            i = block * BLOCK * 8 + int(np.flatnonzero(bits == one)[want - before[block]])
        return i

    def decode(self) -> np.ndarray:
        """All tokens: the planes undone from the last to the first."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        up = np.empty_like(now)
        for p in range(self.levels - 1, -1, -1):
            bits = np.frombuffer(b"".join(self._section(i) for i in self.planes[p]["blocks"]), np.uint8)
            z, o, bit = 0, self._zeros(p), now.dtype.type(1 << (self.levels - 1 - p))
            for a in range(0, self.n, STEP):
                y = up[a : a + STEP]
                is_one = np.unpackbits(bits[a // 8 : (a + STEP) // 8], count=len(y), bitorder="little").view(bool)
                i = np.flatnonzero(is_one)
                y[i] = now[o : o + len(i)] | bit
                o += len(i)
                i = np.flatnonzero(~is_one)
                y[i] = now[z : z + len(i)]
                z += len(i)
            now, up = up, now
        return now


def _place(uri: str):
    """(file system, path) of a Hadoop-style URI."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_shards(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0, shard_bytes: int = 24 << 20) -> DataFrame:
    """Write the shards; part, nth, path, docs, tokens of each (a small table, cut from its lineage).

    (part, nth) order the shards by doc_id.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total * 4 // (3 * shard_bytes)))  # ranges vary in bytes; most should fit one shard

    def save(part: int, nth: int, attempt: int, ids: list[int | None], tokens: list[np.ndarray], lengths: list[np.ndarray]) -> pa.RecordBatch:
        name = f"{folder}/shard-{part:06d}-{nth:04d}.fwm"
        files, path = _place(name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{path}.{attempt}") as f:
            f.write(build(np.concatenate(tokens), ids, np.concatenate(lengths)))
        files.move(f"{path}.{attempt}", path)
        return pa.RecordBatch.from_pydict({"part": [part], "nth": [nth], "path": [name], "docs": [len(ids)], "tokens": [sum(map(len, tokens))]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        nth, held, ids, tokens, lengths = 0, 0, [], [], []
        for b in batches:
            for x, y in slices(b.column(1), min(6_000_000, shard_bytes)):
                texts = b.column(1).slice(x, y - x)
                got = encoder(vocabulary, True, end_id).encode(texts)
                ids += b.column(0).slice(x, y - x).to_pylist()
                tokens.append(got[0])
                lengths.append(got[1])
                held += pc.sum(pc.binary_length(texts)).as_py() or 0
                if held >= shard_bytes:
                    yield save(part, nth, attempt, ids, tokens, lengths)
                    nth, held, ids, tokens, lengths = nth + 1, 0, [], [], []
        if ids:
            yield save(part, nth, attempt, ids, tokens, lengths)

    ranged = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ranged.mapInArrow(run, "part long, nth long, path string, docs long, tokens long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    based = manifest.select("path", (F.sum("tokens").over(W.orderBy("part", "nth")) - F.col("tokens")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                files, name = _place(path)
                with files.open_input_file(name) as f:
                    wavelet = WaveletFile(f)
                    ids, lengths = wavelet.documents()
                    tokens = wavelet.decode().astype("<u4")
                at = np.concatenate(([0], np.cumsum(lengths)))
                crcs = np.fromiter((zlib.crc32(tokens[x:y]) for x, y in zip(at, at[1:])), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base + at[:-1]), pa.array(lengths), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(max(1, manifest.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
