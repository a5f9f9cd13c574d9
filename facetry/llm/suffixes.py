"""Removal of repeated byte strings by deep-shallow suffix sorting.

A string of ``length`` bytes is repeated if it starts anywhere else. Sorting every suffix of a corpus
is not needed to find these: each window of ``length`` bytes picks the positions of the smallest hash
among its ``gram``-byte substrings, so equal windows pick equal places. Only the suffixes at picked
places whose substring occurs twice are sorted. A group of equal substrings is one shallow bucket:
its suffixes, and the reversed prefixes before them, are ordered by multikey quicksort to a shallow
depth and beyond it by blind tries, which give the order and all common prefix lengths. From these
follow, for each place, how far to the left and right it agrees with some other place over at least
``length`` bytes.

Exact copies of texts are found first and are removed whole; one of them stands for all in the
search. A task sorts at most ``most`` contexts of a group: a larger group is first parted by what stands
around the gram (:func:`parted_groups`), so no group has to fit one task, and its parts are sorted the
same way. Texts are known by two 64-bit hashes.

Edge cases: null texts are empty; texts under ``length`` bytes keep every byte; periodic texts pick many
equal places, of which one row a document and context is sent on; repeated rows are copies of each
other; only doc_id and text are read, so further columns do not clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.session import cut, small, written

BASE = 0x9E3779B97F4A7C15 | 1
SLICE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    if not _powers or next(iter(_powers)) < n:
        _powers.clear()
        size = max(n, SLICE + 4096)
        _powers[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))))
    return next(iter(_powers.values()))


def _sliding(x: np.ndarray, w: int, low: bool) -> np.ndarray:
    """Minimum (or maximum) of every w neighbours, by running extremes of blocks."""
    f, fill = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if low else (np.maximum, np.uint64(0))
    padded = np.concatenate((x, np.full(-len(x) % w, fill)))
    blocks = padded.reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: len(x) - w + 1], ahead[w - 1 : len(x)])


def places(data: bytes, length: int = 400, gram: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Picked positions and the hashes of their grams; empty for data under ``length`` bytes."""
    w = length - gram + 1
    at, hashes = [], []
    for s in range(0, max(0, len(data) - length + 1), SLICE):
        part = np.frombuffer(data, np.uint8, min(len(data) - s, SLICE + length - 1), s)
        up, down = _power(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])))
        h = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        least = _sliding(h, w, True)
        edge = np.zeros(w - 1, np.uint64)
        got = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), w, False) == h)
        at.append(got + s)
        hashes.append(h[got])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(hashes)[first].view(np.int64)


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie(strings: list[bytes], group: list[int], start: int) -> list[tuple[int, int]]:
    """(index, common prefix with the one before) of distinct strings in order.

    An inner node keeps only the length at which its strings part and a branch for each next byte; a
    new string walks down blindly, is compared once with the leaf it meets, and branches off there.
    """
    byte = lambda s, i: s[i] if i < len(s) else -1
    root: list | int = group[0]
    for x in group[1:]:
        s, node = strings[x], root
        while isinstance(node, list):
            node = node[1].get(byte(s, node[0])) if byte(s, node[0]) in node[1] else next(iter(node[1].values()))
        met = strings[node]
        l = common(s, met, start)  # noqa: E741
        above, node = None, root
        while isinstance(node, list) and node[0] < l:
            above, node = node, node[1][byte(s, node[0])]
        if isinstance(node, list) and node[0] == l:
            node[1][byte(s, l)] = x
        else:
            new = [l, {byte(met, l): node, byte(s, l): x}]
            if above is None:
                root = new
            else:
                above[1][byte(s, above[0])] = new
    out: list[tuple[int, int]] = []
    stack: list[tuple[list | int, int]] = [(root, start)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, list):
            children = [node[1][b] for b in sorted(node[1])]
            stack += [(c, node[0]) for c in reversed(children[1:])]
            stack.append((children[0], before))
        else:
            out.append((node, before))
    return out


def deep_shallow(strings: list[bytes], depth: int = 256, char: int = 32) -> tuple[list[int], list[int]]:
    """Order of distinct strings and each one's common prefix with the one before (first: 0).

    Multikey quicksort takes ``char`` bytes at a time as one character; groups that still agree at
    ``depth`` go to :func:`blind_trie`.
    """
    out: list[tuple[int, int]] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, at = stack.pop()
        if len(group) == 1:
            out.append((group[0], -1))
        elif at >= depth or len(group) <= 8:
            out += [(i, -1 if not k else l) for k, (i, l) in enumerate(blind_trie(strings, group, at))]
        else:
            keys = [strings[i][at : at + char] for i in group]
            pivot = keys[len(keys) // 2]
            for want in (1, 0, -1):
                part = [i for i, k in zip(group, keys) if (k > pivot) - (k < pivot) == want]
                if part:
                    stack.append((part, at + (char if want == 0 else 0)))
    order = [i for i, _ in out]
    return order, [0 if not k else l if l >= 0 else common(strings[order[k - 1]], strings[i]) for k, (i, l) in enumerate(out)]


def extents(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int]]:
    """(L, R) of each place: the largest left and right agreement with other places that agree over
    ``length`` bytes or more in all; (0, 0) if none does. ``lefts`` are reversed."""
    which: dict[tuple[bytes, bytes], int] = {}
    ids = [which.setdefault(c, len(which)) for c in zip(lefts, rights)]
    own = np.bincount(ids)
    kinds = list(which)
    got = np.zeros((len(kinds), 2), np.int64)
    d = len(kinds)
    if d == 2:
        l, r = common(kinds[0][0], kinds[1][0]), common(kinds[0][1], kinds[1][1])  # noqa: E741
        if l + r >= length:
            got[:] = l, r
    elif d > 2:
        rank, lcp = [], []
        for side in (0, 1):
            texts = [k[side] for k in kinds]
            unique = list(dict.fromkeys(texts))
            order, common_ = deep_shallow(unique)
            place = dict(zip((unique[i] for i in order), range(len(order))))
            rank.append(np.array([place[t] for t in texts]))
            lcp.append((np.array(common_), np.array([len(unique[i]) for i in order])))
        if d <= 256:
            sides = []
            for side in (0, 1):
                between, lengths = lcp[side]
                m = np.diag(lengths)
                for x in range(len(lengths) - 1):
                    m[x, x + 1 :] = m[x + 1 :, x] = np.minimum.accumulate(between[x + 1 :])
                sides.append(m[np.ix_(rank[side], rank[side])])
            ok = sides[0] + sides[1] >= length
            np.fill_diagonal(ok, False)
            got[:, 0], got[:, 1] = (np.where(ok, s, 0).max(1) for s in sides)
        else:
            most, least = np.full(d, -1), np.full(d, length + 1)
            for o in range(0, max(map(len, lefts)) + 1):
                classes = [np.cumsum(lcp[side][0] < depth)[rank[side]] for side, depth in ((0, o), (1, length - o))]
                long = (lcp[0][1][rank[0]] >= o) & (lcp[1][1][rank[1]] >= length - o)
                _, back, n = np.unique(classes[0] * (d + 1) + classes[1], return_inverse=True, return_counts=True)
                twice = (n[back] > 1) & long
                most[twice], least[twice] = o, np.minimum(least[twice], o)
            got[most >= 0] = np.stack((most, length - least), 1)[most >= 0]
    for i, k in enumerate(kinds):
        if own[i] > 1 and len(k[0]) + len(k[1]) >= length:
            got[i] = len(k[0]), len(k[1])
    return [tuple(got[i].tolist()) for i in ids]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


CONTEXT = "g1 long, g2 long, k1 long, k2 long, at array<long>, left binary, right binary"
PLACES = 64
SPAN = "k1 long, k2 long, start long, end long"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def compared(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the contexts (columns of CONTEXT) of each group (g1, g2) that agree with others: each of ``at`` less L and plus R."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group is finished when the next one begins."""
        held: list[tuple] = []

        def finish() -> list[tuple[int, int, int, int]]:
            lefts = [x for r in held for x in [r[5]] * min(2, len(r[4]))]
            rights = [x for r in held for x in [r[6]] * min(2, len(r[4]))]
            got, i, out = extents(lefts, rights, length) if len(lefts) > 1 else [(0, 0)], 0, []
            for _, _, k1, k2, at, _, _ in held:
                l, r = got[i]  # noqa: E741
                i += min(2, len(at))
                if l + r:
                    out += [(k1, k2, a - l, a + r) for a in at]
            return out

        for b in batches:
            rows: list[tuple[int, int, int, int]] = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][:2] != r[:2]:
                    rows += finish()
                    held = []
                held.append(r)
            if rows:
                yield _table(rows, SPAN)
        if held and (rows := finish()):
            yield _table(rows, SPAN)

    return contexts.select("g1", "g2", "k1", "k2", "at", "left", "right").repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(run, SPAN)


def parted_groups(contexts: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """k1, k2, spans (array of start, end): what :func:`compared` gives, for groups of any size, a row a context; no task holds more than ``most`` contexts.

    A window that starts o bytes before the gram holds ``o`` bytes to its left and ``length - o`` from it on.
    For a range s <= o <= e, contexts that share such a window agree on the inner part (s to the left,
    length - e from the gram on), and contexts that agree on the outer part (e, length - s) share them all.
    So a group is parted by inner parts; where a part is still too large, contexts equal in their outer part
    are settled, one of them stands for all, and the two halves of the range follow. Every step is a count
    by hash, and equal contexts never come together in a task.
    """
    two = lambda *c: [F.xxhash64(F.lit(i), *c) for i in (1, 2)]
    n_left, n_right = F.octet_length("left"), F.octet_length("right")
    ids = dict(zip(("c1", "c2"), two("g1", "g2", "left", "right")))
    placed = written(contexts.select("*", *[v.alias(k) for k, v in ids.items()]), "contexts")
    distinct = placed.groupBy("c1", "c2").agg(F.sum(F.size("at")).alias("n"), *[F.first(c).alias(c) for c in ("g1", "g2", "left", "right")])
    distinct = written(distinct, "distinct-contexts")
    found = [distinct.where((F.col("n") > 1) & (n_left + n_right >= length)).select("c1", "c2", (-n_left).alias("start"), n_right.alias("end"))]
    lone = F.array(F.lit(0).cast("long"))
    rows, bounded = distinct.select("g1", "g2", "c1", "c2", "left", "right", F.lit(0).alias("s"), F.lit(length - gram).alias("e")), []
    while True:
        part = lambda l, r: [F.substr("left", F.lit(1), F.col(l)), F.substr("right", F.lit(1), length - F.col(r))]
        inner, outer = two("g1", "g2", "s", "e", *part("s", "e")), two("g1", "g2", "s", "e", *part("e", "s"))
        keyed = rows.where((n_left >= F.col("s")) & (n_right >= length - F.col("e")))
        keyed = written(keyed.select("*", *[c.alias(n) for n, c in zip(("p1", "p2", "f1", "f2"), inner + outer)]), "keyed-contexts")
        alike = keyed.groupBy("p1", "p2", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("c1", "c2", "g1", "g2", "left", "right", "s", "e")).alias("x"))
        alike = written(alike, "alike-contexts")
        sizes = alike.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("n") == 1).cast("int")).alias("open"))
        from_, to = F.greatest(F.col("s"), length - n_right), F.least(F.col("e"), n_left)
        spread = keyed.select("p1", "p2", "f1", "f2", "c1", "c2", from_.alias("from"), to.alias("to")).where("from <= to")
        settled = spread.join(alike.where("n > 1").select("p1", "p2", "f1", "f2"), ["p1", "p2", "f1", "f2"], "left_semi")
        found.append(settled.select("c1", "c2", (-F.col("to")).alias("start"), (length - F.col("from")).alias("end")))
        # Parts beyond ``most`` are few and told apart first, so that the join of the others has bounded keys.
        large = cut(sizes.where(F.col("m") > most).select("p1", "p2", F.col("open").alias("large")))
        marked = alike.join(small(large, large.count()), ["p1", "p2"], "left")
        bounded_ = marked.where("large is null").join(sizes.where("open > 0 and m > 1"), ["p1", "p2"])
        bounded.append(bounded_.select(F.col("p1").alias("g1"), F.col("p2").alias("g2"), F.col("x.c1").alias("k1"), F.col("x.c2").alias("k2"), lone.alias("at"), "x.left", "x.right"))
        mid = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
        halves = F.array(F.struct(F.col("s"), mid.alias("e")), F.struct((mid + 1).alias("s"), F.col("e")))
        rows = marked.where((F.col("large") > 0) & (F.col("x.s") < F.col("x.e"))).select("x.*")
        rows = rows.withColumn("h", F.explode(halves)).select("g1", "g2", "c1", "c2", "left", "right", "h.s", "h.e")
        if rows.isEmpty():
            break
    for part_ in bounded:
        found.append(compared(part_, length).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "start", "end"))
    spans = found[0]
    for f in found[1:]:
        spans = spans.unionAll(f)
    widest = spans.groupBy("c1", "c2").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # A context's places stay one row: a text of many repeats has as many places as repeats.
    each = F.transform("at", lambda a: F.struct((a + F.col("start")).alias("start"), (a + F.col("end")).alias("end")))
    return placed.join(widest, ["c1", "c2"]).select("k1", "k2", each.alias("spans"))


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 100, most: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(marked, copied, spans, searched). marked: doc_id, text, k1, k2, n_bytes of every row; copied: k1, k2, copies of texts
    that stand in several rows (``length`` bytes or more); spans: k1, k2, spans array<struct<start,end>> of other
    texts; searched: k1, k2, text, copies of the texts that were compared."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(length), text).alias("k2"), F.octet_length(text).cast("long").alias("n_bytes"))
    long_texts = marked.where(F.col("n_bytes") >= length).withColumn("row", F.xxhash64("doc_id", "k1"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k1, k2, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                at, hashes = places(x.as_py(), length, gram)
                order = np.argsort(hashes, kind="stable")
                ends = np.flatnonzero(np.r_[np.diff(hashes[order]) != 0, True]) + 1 if len(at) else []
                rows += [(k1, k2, int(hashes[order[e - 1]]), at[order[s:e]].tolist()) for s, e in zip([0, *ends[:-1]], ends)]
            if rows:
                yield _table(rows, "k1 long, k2 long, h long, at array<long>")

    texts = written(long_texts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row")), "texts")
    picked = written(long_texts.select("k1", "k2", "text").mapInArrow(pick, "k1 long, k2 long, h long, at array<long>").dropDuplicates(["k1", "k2", "h"]), "places")
    # n bounds the contexts of a group but for documents with more than PLACES of its places: periodic texts hold many
    # places, of which few differ, so those are counted below.
    shared = picked.groupBy("h").agg(F.sum(F.size("at")).alias("c"), F.sum(F.least(F.size("at"), F.lit(PLACES))).cast("long").alias("n")).where("c > 1").drop("c")
    chosen = picked.join(shared, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "h", "n")).alias("at")).join(texts, ["k1", "k2"])
    # One row of each text goes on: copies have other values of ``row`` and meet nobody.
    searched = written(long_texts.select("k1", "k2", "row", "text").join(chosen, ["k1", "k2", "row"]).dropDuplicates(["k1", "k2"]).drop("row"), "searched")

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a distinct (gram, left, right) of a document, with all its places; ``left`` is reversed."""
        for b in batches:
            for x in range(0, len(b), 64):
                rows = []
                for k1, k2, data, at in zip(*(b.column(i).to_pylist()[x : x + 64] for i in (0, 1)), b.column(2).slice(x, 64).cast(pa.binary()), b.column(3).slice(x, 64).to_pylist()):
                    data, alike = data.as_py(), defaultdict(list)
                    for p in at:
                        for a in p["at"]:
                            alike[p["h"], p["n"], data[max(0, a - length + gram) : a][::-1], data[a : a + length]].append(a)
                    rows += [(h, n, k1, k2, where, left, right) for (h, n, left, right), where in alike.items()]
                if rows:
                    yield _table(rows, CONTEXT)

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct contexts beyond ``PLACES`` of each gram that a document holds at more places than that."""
        for b in batches:
            rows = []
            for data, at in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist()):
                data = data.as_py()
                for p in at:
                    if len(p["at"]) > PLACES:
                        rows.append((p["h"], len({(data[max(0, a - length + gram) : a], data[a : a + length]) for a in p["at"]}) - PLACES))
            if rows:
                yield _table(rows, "h long, more long")

    many = searched.where(F.exists("at", lambda p: F.size(p["at"]) > PLACES)).select("text", "at")
    more = cut(many.mapInArrow(beyond, "h long, more long").groupBy("h").agg(F.sum("more").alias("more")).where("more <> 0"))
    around = searched.select("k1", "k2", "text", "at").mapInArrow(surround, CONTEXT)
    counted = F.col("n") + F.coalesce("more", F.lit(0))
    if n_more := more.count():
        # Now n is the number of contexts that stand in the group's documents, no estimate.
        around = around.join(small(more.withColumnRenamed("h", "g1"), n_more), "g1", "left").withColumn("g2", F.col("g2") + F.coalesce("more", F.lit(0))).drop("more")
    found = compared(around.where(F.col("g2") <= most), length)
    hot, parted = around.where(F.col("g2") > most), None
    if not shared.join(more, "h", "left").where(counted > most).isEmpty():
        parted = parted_groups(hot, length, gram, most)
    found = found.distinct().select("k1", "k2", F.array(F.struct("start", "end")).alias("spans"))
    spans = (found if parted is None else found.unionByName(parted)).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return marked, texts.where("copies > 1").select("k1", "k2", "copies"), spans, searched


def without_repeats(docs: DataFrame, length: int = 400, hot: int = 4096, **kw) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) and text (those as text) of every row.

    A cut can part the bytes of a character; ``text`` leaves the rest of such a character out.
    """
    marked, copied, spans, searched = repeated_spans(docs, length, **kw)
    result = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string"

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k1, k2, data, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(3).to_pylist()):
                data, runs = data.as_py(), _merged([(s["start"], s["end"]) for s in found])
                at = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(at[::2], at[1::2]))
                rows.append((k1, k2, len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore")))
            if rows:
                yield _table(rows, result)

    lone = searched.where("copies = 1").select("k1", "k2", "text").join(spans, ["k1", "k2"]).mapInArrow(cut_out, result)
    whole = [F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(b"").alias("kept"), F.lit("").alias("text")]
    cleaned = lone.unionAll(copied.where(F.col("copies") <= hot).select("k1", "k2", *whole)).withColumnRenamed("text", "_text").withColumn("_cut", F.lit(True))
    # Texts with very many copies are few; they are told apart before the join, so that it has no hot key.
    common = copied.where(F.col("copies") > hot).select("k1", "k2", F.lit(True).alias("_common"))
    rows = marked.join(small(common, common.count()), ["k1", "k2"], "left")
    gone = rows.where("_common").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), *whole[1:])
    met = rows.where("_common is null").join(cleaned, ["k1", "k2"], "left")
    pick = lambda cut, uncut: F.when(F.col("_cut"), cut).otherwise(uncut)
    return gone.unionByName(met.select(
        "doc_id", "n_bytes", pick(F.coalesce("n_removed", "n_bytes"), F.lit(0)).cast("long").alias("n_removed"), pick(F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.col("kept_sha256"), F.sha2(F.encode("text", "UTF-8"), 256)).alias("kept_sha256"), pick(F.col("kept"), F.encode("text", "UTF-8")).alias("kept"), pick(F.col("_text"), F.col("text")).alias("text"),
    ))
