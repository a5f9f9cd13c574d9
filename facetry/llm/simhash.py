"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into three segments. When two fingerprints differ in at most 4 bits, one of
their segments differs in at most one bit (4 < 2 * 3), so some variant of it with one bit masked is
equal in both. Every distinct fingerprint is indexed under all one-wildcard variants of each segment
(64 keys), equal keys meet by hash partitioning, and pairs are verified by the Hamming distance of
the whole. Inside a key only a spanning set of links is kept, never all pairs of a group. Keys are
counted first: one with more than ``block`` fingerprints is dealt out in blocks by hash, and every pair
of its blocks is a group of its own, so no task holds or compares more than two blocks at a time.

Exact copies share one fingerprint, so they never multiply candidates. Edge cases: null, empty and
wordless texts have the fingerprint 0 and link like any other; repeated rows and ids keep a row
each; null ids take part but are only a component's id if it has no other (then null).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.components import components, with_least
from facetry.session import cut, removed, small, spread_join, written

SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


MIXERS = [0, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03]


def _bank(hashes: np.ndarray, bank: int) -> np.ndarray:
    """Bank 0 votes with the hashes themselves, each further bank with another mix of them."""
    if bank == 0:
        return hashes
    x = hashes + np.uint64(MIXERS[bank])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles, repeats too; a text of fewer words is one shingle, a wordless one has none."""
    import xxhash

    words = text.translate(LOWER).translate(BLANK).split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray, banks: int) -> list[int]:
    """Majority votes of the hashes, bit by bit; works in slices of bounded size."""
    votes = np.zeros((banks, 64), np.int64)
    for i in range(0, len(hashes), 1 << 16):
        for k in range(banks):
            votes[k] += np.unpackbits(_bank(hashes[i : i + (1 << 16)], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [int(np.packbits(v * 2 > len(hashes), bitorder="little").view("<u8")[0]) for v in votes]


def fingerprint(text: bytes, shingle: int = 4, banks: int = 1) -> list[int]:
    """Majority votes of the shingles' hashes."""
    return majority(shingle_hashes(text, shingle), banks)


def fingerprints(docs: DataFrame, shingle: int = 4, banks: int = 1, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, *extra, f0 .. f{banks-1} (signed longs of 64 bits)."""
    keep = docs.select("doc_id", *extra, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary())
            fps = np.array([fingerprint(x.as_py() or b"", shingle, banks) for x in texts], np.uint64).reshape(-1, banks).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(fps[:, k]) for k in range(banks)]], names=[*b.schema.names[:-1], *[f"f{k}" for k in range(banks)]])

    return keep.mapInArrow(run, keep.drop("text").select("*", *[F.lit(0).cast("long").alias(f"f{k}") for k in range(banks)]).schema)


def variants(fp: Column, segments: int, bank: int = 0, bits: int = 64) -> Column:
    """Array of 64 keys: bank and segment, masked bit, and the segment without that bit."""
    at = [round(bits * s / segments) for s in range(segments + 1)]
    keys = []
    for s, (a, b) in enumerate(zip(at, at[1:])):
        for i in range(a, b):
            mask = (((1 << b) - 1) ^ ((1 << a) - 1)) & ~(1 << i)
            part = F.shiftrightunsigned(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), a)
            keys.append(F.shiftleft(F.lit((bank * segments + s) * 64 + i - a).cast("long"), 40).bitwiseOR(part))
    return F.array(*keys)


def large_keys(distinct: DataFrame, segments: int, banks: int, block: int) -> DataFrame:
    """k, parts of the keys of :func:`variants` that may hold more than ``block`` fingerprints (parts: blocks to deal them to).

    A key unites two values of a segment, so one of them holds more than half a block: whole segments are
    counted (one row a segment, not one a variant), and only the variants of the large ones are looked at.
    """
    at = [round(64 * s / segments) for s in range(segments + 1)]
    values = []
    for bank in range(banks):
        for s, (a, b) in enumerate(zip(at, at[1:])):
            mask = ((1 << b) - 1) ^ ((1 << a) - 1)
            part = F.shiftrightunsigned(F.col(f"f{bank}").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), a)
            values.append(F.shiftleft(F.lit(bank * segments + s).cast("long"), 40).bitwiseOR(part))
    large = distinct.select(F.explode(F.array(*values)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block // 2)
    segment, value = F.shiftright("x", 40), F.col("x").bitwiseAND(F.lit((1 << 40) - 1))
    width = F.get(F.array(*[F.lit(b - a) for a, b in zip(at, at[1:])]), (segment % segments).cast("int"))
    bits = large.select("n", segment.alias("s"), value.alias("v"), F.explode(F.sequence(F.lit(0), width - 1)).alias("i"))
    key = F.shiftleft(F.col("s") * 64 + F.col("i"), 40).bitwiseOR(F.col("v").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i")))))
    return bits.groupBy(key.alias("k")).agg(F.sum("n").alias("n")).select("k", F.ceil((F.col("n") + block // 2) / block).cast("int").alias("parts"))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _spanning(fps: np.ndarray, other: np.ndarray | None, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever the pairs within ``most`` bits connect, inside fps or from fps to other.

    Breadth first: each reached fingerprint takes all near ones that no other has reached yet, so a group
    of g near copies gives g - 1 links, and a tight one is done after a few steps.
    """
    rest = [fps] if other is None else [fps, other]
    out = []
    while len(rest[0]):
        reached = deque([(0, rest[0][:1])])
        rest[0] = rest[0][1:]
        while reached:
            side, x = reached.popleft()
            far = len(rest) - 1 - side
            near = _apart(rest[far], x) <= most
            if near.any():
                hits, rest[far] = rest[far][near], rest[far][~near]
                out.append((hits, np.repeat(x, len(hits), 0)))
                reached.extend((far, hits[i : i + 1]) for i in range(len(hits)))
    return out


def links(distinct: DataFrame, most: int = 4, segments: int = 3, banks: int = 1, block: int = 1 << 15, short: int = 32) -> DataFrame:
    """Spanning links (u, v: structs of f0 ..) of distinct fingerprints with at most ``most`` bits apart over all banks."""
    cols = [f"f{k}" for k in range(banks)]
    keyed = distinct.select(*cols, F.explode(F.concat(*[variants(F.col(c), segments, k) for k, c in enumerate(cols)])).alias("k"))

    def pairs(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[starts, len(k)])
        got = []
        few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= short), sizes))
        least = np.arange(len(k))
        met = []
        for step in range(1, short):
            few = few[few + step < len(k)]
            few = few[k[few + step] == k[few]]
            if not len(few):
                break
            near = few[_apart(f[few], f[few + step]) <= most]
            least[near + step] = near
            met.append((near + step, near))
        for a, b in met:
            # b near least[a], which is near a: that pair links them, so this one adds nothing.
            adds = (b == least[a]) | (_apart(f[b], f[least[a]]) > most)
            got.append((f[a[adds]], f[b[adds]]))
        for s, n in zip(starts[sizes > short], sizes[sizes > short]):
            got += _spanning(f[s : s + n], None, most)
        return ends(got)

    def ends(got: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([g[i] for g in got]) if got else np.empty((0, banks), np.uint64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i]).view(np.int64)) for x in (a, b) for i in range(banks)], names=[f"{x}{i}" for x in "uv" for i in range(banks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and fingerprint, all rows of a key in one task; the last key of a batch waits for the next batch."""
        hold_k, hold_f = np.empty(0, np.int64), np.empty((0, banks), np.uint64)
        for batch in batches:
            k = np.concatenate((hold_k, batch.column(0).to_numpy()))
            f = np.concatenate((hold_f, np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], 1)))
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if last:
                yield pairs(k[:last], f[:last])
            hold_k, hold_f = k[last:], f[last:]
        if len(hold_k):
            yield pairs(hold_k, hold_f)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, blocks i <= j and side (1 is block j of two); each (key, i, j) is one comparison."""
        key, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            x, y = (np.concatenate(s) if s else np.empty((0, banks), np.uint64) for s in sides)
            return ends(_spanning(x, None if key[1] == key[2] else y, most))

        for b in batches:
            k, f = np.stack([c.to_numpy().astype(np.int64) for c in b.columns[:4]], 1), np.stack([c.to_numpy().view(np.uint64) for c in b.columns[4:]], 1)
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)]) if len(k) else []
            for s, e in zip(starts, np.r_[starts[1:], len(k)]):
                if tuple(k[s, :3]) != key:
                    if key is not None:
                        yield done()
                    key, sides = tuple(k[s, :3]), ([], [])
                sides[k[s, 3]].append(f[s:e])
        if key is not None:
            yield done()

    schema = ", ".join(f"{x}{i} long" for x in "uv" for i in range(banks))
    keyed = keyed.select("k", *cols)
    large = cut(large_keys(distinct, segments, banks, block))
    many = large.count()
    usual = keyed.join(small(large.select("k"), many), "k", "left_anti") if many else keyed
    # In the same order under every key, a group's fingerprints mostly link to the same few: distinct() leaves a few links each.
    found = usual.repartition("k").sortWithinPartitions("k", *cols).mapInArrow(run, schema)
    if many:
        dealt = keyed.join(small(large, many), "k").withColumn("_b", F.pmod(F.xxhash64(*cols), F.col("parts")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("k", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), (F.col("_b") > F.col("_o")).cast("int").alias("side"), *cols)
        found = found.unionAll(dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "side", *cols).mapInArrow(meet, schema))
    a, b = (F.struct(*[F.col(f"{x}{i}").alias(f"f{i}") for i in range(banks)]) for x in "uv")
    return found.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def gathered(found: DataFrame) -> DataFrame:
    """Links with the same components as ``found`` (u > v), where each u's other ends point at its least one.

    Inside a key most links run from a greater fingerprint to the key's least; links of a hot group that came
    from different keys fall together before the components' joins.
    """
    found = cut(found)
    least = found.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    met = with_least(found, least, [], found.count(), "u")
    return met.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).distinct()


def classes(docs: DataFrame, shingle: int, most: int, segments: int, banks: int, extra: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, *extra, f: struct of fingerprints, for every row; f, rows, root: fingerprint that stands for its component, component_id)."""
    cols = [f"f{k}" for k in range(banks)]
    fps = written(fingerprints(docs, shingle, banks, extra).select("doc_id", *extra, F.struct(*cols).alias("f")), "simhash")
    distinct = written(fps.groupBy("f").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "fingerprints")
    linked = components(gathered(gathered(links(distinct.select("f.*"), most, segments, banks)))).withColumnRenamed("node", "f")
    linked = linked.join(distinct.select("f", "least"), "f")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    ids = spread_join(linked.select("f", "component"), ids, ["component"], "size").select("f", "component", "component_id")
    known = distinct.join(ids, "f", "left").select("f", "rows", F.coalesce("component", "f").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return fps, known


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row."""
    if most > 5:
        raise ValueError("three segments with one wildcard find at most 5 differing bits")
    fps, known = classes(docs, shingle, most, 3, 1, ())
    return spread_join(fps, known, ["f"], "rows").select("doc_id", F.lower(F.lpad(F.hex("f.f0"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, shingle: int, banks: int, whole: bool) -> DataFrame:
    """The columns of ``docs`` (text last) but text, then set_id (128 bits of the shingle set), n, and f0 .. of the set (each shingle votes once) or, if ``whole``, its bytes."""
    added = [("set_id", "binary"), ("n", "long"), *([("shingles", "binary")] if whole else [(f"f{k}", "long") for k in range(banks)])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = [x.as_py() or b"" for x in b.column(b.num_columns - 1).cast(pa.binary())]
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            out = [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())]
            if whole:
                out.append(pa.array([x.tobytes() for x in sets], pa.binary()))
            else:
                fps = np.array([majority(x, banks) for x in sets], np.uint64).reshape(-1, banks).view(np.int64)
                out += [pa.array(fps[:, k]) for k in range(banks)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*b.schema.names[:-1], *[n for n, _ in added]])

    return docs.mapInArrow(run, docs.drop("text").select("*", *[F.lit(None).cast(t).alias(n) for n, t in added]).schema)


def similar(x: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of ``others`` have a Jaccard similarity with x of at least ``least`` (sorted sets without repeats)."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    yes = np.zeros(len(others), bool)
    fit = np.flatnonzero((sizes > 0) & (np.minimum(sizes, len(x)) >= least * np.maximum(sizes, len(x)) - 1e-9))
    for i in range(0, len(fit), 1024):
        part = fit[i : i + 1024]
        values = np.concatenate([others[j] for j in part])
        hit = x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values
        both = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes[part])[:-1]], dtype=np.int64)
        yes[part] = both >= least * (len(x) + sizes[part] - both) - 1e-9
    return yes


def _similar_links(fps: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, most: int, least: float) -> list[tuple[int, int]]:
    """Spanning links (positions) of the pairs within ``most`` bits whose sets are similar; pairs of side 0 and 1 only, unless all are of side 0.

    Breadth first as in :func:`_spanning`, but a row is reached only by a pair that was compared exactly.
    """
    one = not sides.any()
    rest = [np.flatnonzero(sides == 0), np.flatnonzero(sides == (0 if one else 1))]
    out = []
    while len(rest[0]):
        reached = deque([(0, rest[0][0])])
        rest[0] = rest[0][1:]
        while reached:
            side, x = reached.popleft()
            far = 0 if one else 1 - side
            near = np.flatnonzero(_apart(fps[rest[far]], fps[x]) <= most)
            near = near[similar(sets[x], [sets[i] for i in rest[far][near]], least)] if len(near) else near
            if len(near):
                hits, rest[far] = rest[far][near], np.delete(rest[far], near)
                out += [(int(y), int(x)) for y in hits]
                reached.extend((far, y) for y in hits)
    return out


def verified_links(nodes: DataFrame, most: int, banks: int, least: float) -> DataFrame:
    """Links (u, v: set_id) between similar rows of each (group, i, j); nodes: group, i, j, side, set_id, shingles, f0 ..

    All pairs of a group within ``most`` bits are compared by their sets; only a spanning set of the similar
    ones is returned. A task holds one (group, i, j) at a time.
    """
    cols = [f"f{k}" for k in range(banks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, sides, fps = None, [], [], [], []

        def done() -> pa.RecordBatch:
            got = _similar_links(np.array(fps, np.int64).reshape(-1, banks).view(np.uint64), sets, np.array(sides), most, least)
            return pa.RecordBatch.from_arrays([pa.array([ids[pair[k]] for pair in got], pa.binary()) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            for g, i, j, side, set_id, shingles, *f in zip(*[c.to_pylist() for c in b.columns]):
                if (g, i, j) != key:
                    if len(ids) > 1:
                        yield done()
                    key, ids, sets, sides, fps = (g, i, j), [], [], [], []
                elif set_id == ids[-1] and side == sides[-1]:
                    continue  # an equal row
                ids.append(set_id)
                sets.append(np.frombuffer(shingles, np.uint64))
                sides.append(side)
                fps.append(f)
        if len(ids) > 1:
            yield done()

    dealt = nodes.select("group", "i", "j", "side", "set_id", "shingles", *cols).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "set_id")
    found = dealt.mapInArrow(run, "u binary, v binary")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def deduplicated(docs: DataFrame, shingle: int = 5, banks: int = 4, most: int = 60, segments: int = 4, least: float = 0.8, block: int = 1 << 21) -> DataFrame:
    """Rows of ``docs`` with one row left of each near-duplicate group, that of the smallest doc_id (nulls last; of
    equal ids the row of the smallest hash). Extra columns may have any name.

    Two texts are linked when the Jaccard similarity of their sets of ``shingle``-word shingles is at least
    ``least``; texts without words are alike. ``banks`` fingerprints of 64 bits only find candidates: those of
    sets of similarity 0.8 differ in 15 % of the bits on average (39 of 256), so ``most`` = 60, and a pair
    must share a one-wildcard segment of any bank. The components of candidates part the texts into groups;
    in a group all pairs within ``most`` bits are compared by their exact sets, and the similar pairs are
    linked. Groups with more than ``block`` shingles are dealt out in blocks. Each block is compared in itself and
    with one text of its group, so a group of near copies is mostly linked at once; then the texts that are
    not linked with that one, if any, meet every block. So a set is sent out again only for those.
    """
    cols = [f"f{k}" for k in range(banks)]
    names, whole = docs.columns, F.struct(*docs.columns)
    marked = docs.select("doc_id", "text", whole.alias("_whole"), F.concat(F.hex(F.xxhash64(whole)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), whole))).alias("_row"))
    rows = written(shingle_sets(marked.select("doc_id", "_row", "text"), shingle, banks, False), "shingle-sets")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row", "m")
    # Texts of one set share set_id: one row of each goes on, so that copies never meet in one task.
    # Equal rows are counted (m), so that only rows that have equals must be made single in the end.
    each = rows.groupBy("set_id", "doc_id", "_row").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in cols])
    texts = written(each.groupBy("set_id").agg(F.min(order).alias("k"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in cols]), "texts")
    removed(rows)
    loose = components(gathered(gathered(links(texts.where("n > 0").select(*cols).distinct(), most, segments, banks))))
    same = texts.where("n > 0").groupBy(*cols).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.struct(*cols).alias("node"))
    parts = written(loose.unionAll(same.select("node", F.col("node").alias("component")).join(loose, "node", "left_anti")), "loose")
    grouped = written(
        texts.join(parts.select("node.*", F.xxhash64("component").alias("group")), cols).select("set_id", "group", "n", "k", *cols), "groups"
    )
    removed(parts)
    sizes = cut(grouped.groupBy("group").agg(F.sum("n").alias("_n"), F.min("set_id").alias("_hub")).select("group", "_hub", F.ceil(F.col("_n") / block).cast("int").alias("parts")))
    placed = grouped.join(small(sizes, sizes.count()), "group").withColumn("_b", F.pmod(F.xxhash64(F.lit(7), "set_id"), F.col("parts")).cast("int"))
    chosen = placed.select("set_id", "group", "parts", "_b", "_hub", *cols, F.col("k.doc_id").alias("_id"), F.col("k._row").alias("_k"))
    met = marked.select("doc_id", "_row", "text").join(chosen, (F.col("_row") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = shingle_sets(met.select(*[F.col(c) for c in ("group", "parts", "_b", "_hub", *cols)], "text"), shingle, banks, True)
    sets = written(sets, "sets")
    removed(grouped)
    is_hub, every = F.col("set_id") == F.col("_hub"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = sets.withColumn("i", F.explode(F.when(is_hub, every("parts")).otherwise(F.array("_b")))).withColumn("j", F.col("i")).withColumn("side", F.lit(0))
    found = written(verified_links(own, most, banks, least), "similar")
    linked, done = components(gathered(gathered(found))), [texts, sets, found]
    dealt = sets.where("parts > 1")
    if not dealt.isEmpty():
        labelled = dealt.select("group", "set_id", "n", is_hub.alias("hub")).join(linked.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("component", "set_id"))
        hubs = labelled.where("hub").select("group", F.col("label").alias("main")).distinct()
        apart = written(labelled.join(hubs, "group").where("label <> main").select("group", "set_id", "n").distinct(), "apart")
        done.append(apart)
        counts = apart.groupBy("group").agg(F.ceil(F.sum("n") / block).cast("int").alias("some"))
        met = dealt.join(counts, "group")
        asking = met.join(apart.select("set_id"), "set_id", "left_semi").withColumn("i", F.pmod(F.xxhash64(F.lit(9), "set_id"), F.col("some")).cast("int")).withColumn("j", F.explode(every("parts"))).withColumn("side", F.lit(0))
        asked = met.withColumn("i", F.explode(every("some"))).withColumn("j", F.col("_b")).withColumn("side", F.lit(1))
        found = found.unionAll(verified_links(asking.unionByName(asked), most, banks, least)).distinct()
        linked = components(gathered(gathered(found)))
    linked = linked.withColumnRenamed("node", "set_id")
    keep = texts.join(linked, "set_id", "left").groupBy(F.coalesce("component", "set_id").alias("root")).agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k._row").alias("_k"), F.col("k.m").alias("m"))
    keep = written(keep, "keep")
    removed(*done)

    def chosen_rows(some: DataFrame) -> DataFrame:
        return marked.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_k"))).select("doc_id", "_row", "_whole")

    kept = chosen_rows(keep.where("m = 1"))
    if not keep.where("m > 1").isEmpty():
        kept = kept.unionAll(chosen_rows(keep.where("m > 1")).dropDuplicates(["doc_id", "_row"]))
    return kept.select(*[F.col("_whole")[c].alias(c) for c in names])
