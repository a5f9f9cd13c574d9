"""Fill-in-middle transformation; cuts are found in an indexable skip list over a text's units.

A unit is a code point, or what a pattern matches (with what stands before it unmatched; a rest is a unit of its own).
Lane 0 of the skip list has every unit; a node of lane k stands on lane k + 1 too with a chance of 1 in 16. A node carries
how many units and how many code points lie between it and the next node of its lane. A rank is reached from the top
lane: go on while the units passed stay within the rank, else go down; the code points passed are the place of the cut.

The cuts and the form of a document come from a SHA-256 of seed and doc_id, so reruns agree in any partitioning.

Edge rows: a null text is empty; empty texts, and texts that hold a marker, stay plain. A null doc_id is hashed as
nothing. Repeated rows give repeated rows. A very long text is held by its task with one list of widths (a few times its
size); batches are cut by bytes before texts become Python strings. Extra columns of ``docs`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.tokens import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPREAD = 16
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """Lanes over unit widths (code points of each unit, in order)."""

    def __init__(self, widths: np.ndarray, seed: int = 0):
        self.n, rng = len(widths), np.random.default_rng(seed)
        self.lanes = [(np.broadcast_to(np.int64(1), self.n), widths, None)]
        while len(self.lanes[-1][0]) > SPREAD:
            units, points, _ = self.lanes[-1]
            up = rng.random(len(units), np.float32) * SPREAD < 1
            up[0] = True
            stands = np.flatnonzero(up)  # in the lane below
            self.lanes.append((np.add.reduceat(units, stands), np.add.reduceat(points, stands), stands))

    def place(self, rank: int) -> int:
        """Code points before the unit of this rank (all, if rank is the number of units)."""
        at = passed = points_passed = 0
        for units, points, down in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed, points_passed, at = passed + int(units[at]), points_passed + int(points[at]), at + 1
            if at == len(units):
                return points_passed
            at = at if down is None else int(down[at])
        return points_passed


def unit_widths(text: str, unit: re.Pattern | None) -> np.ndarray:
    if unit is None:
        return np.broadcast_to(np.int64(1), len(text))
    ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    if not ends or ends[-1] < len(text):
        ends += [len(text)] if text else []
    return np.diff(np.array(ends, np.int64), prepend=0)


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]


def transformed(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, unit: str | None = None) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    ``unit`` is a pattern of the units, code points if None. Of 100 parts, those from ``plain_from`` stay plain; of the
    rest those below ``spm_below`` put the suffix first.
    """
    pattern = re.compile(unit) if unit else None

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        widths = unit_widths(text, pattern)
        n = len(widths)
        if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= plain_from:
            return n, "plain", None, None, text
        lanes = SkipList(widths, h1 ^ h2)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = lanes.place(a), lanes.place(b)
        if h4 % 100 < spm_below:
            return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
        return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in slices(batch.column("text")):
                part = batch.slice(x, y - x)
                numbers = zip(*[part.column(f"_h{i}").to_pylist() for i in (1, 2, 3, 4)])
                made = [one(t, *h) for t, h in zip(part.column("text").to_pylist(), numbers)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draws("doc_id", seed))
    return asked.mapInArrow(run, SCHEMA)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text an output was made of. Parts hold no marker, so the first one of each kind is the marker."""
    body = F.substr(F.col(output), F.lit(len(PREFIX) + 1))
    first = F.when(F.col(form) == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    a, b = F.position(first, body), F.position(F.lit(MIDDLE), body)
    left, right = F.substr(body, F.lit(1), a - 1), F.substr(body, a + 3, b - a - 3)
    middle = F.substr(body, b + 3)
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))


def digests(made: DataFrame) -> DataFrame:
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
