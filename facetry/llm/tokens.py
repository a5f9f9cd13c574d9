"""Token ids by the tokenizers library, with a bounded cache of space-delimited chunks.

Both vocabularies cut a text at a space between two non-space characters whatever stands around it,
so a text's ids are those of its chunks in order. Arrow splits the texts and numbers the distinct
chunks; the library encodes each distinct chunk once while it is cached; the ids are then gathered
chunk by chunk. Full stops, commas and the like after a letter or digit are cut off before encoding,
which both vocabularies do too, so a word is learned once for all its endings. Where spaces belong
to tokens, texts in which white space touches white space (other than runs of line feeds between
words) are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

EMPTY, WHOLE, END = 0, 1, 2  # slots of the store: no ids, "encode the whole text", the end id
STOPS = ".,;:!?"


def gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ids[start : start + length], one after another."""
    before = np.cumsum(lengths) - lengths
    return ids[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class ChunkEncoder:
    """encode(texts) -> (ids of all texts, uint16; length of each text), every text closed by ``end_id``."""

    def __init__(self, path: str, spaces_matter: bool, end_id: int, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.spaces_matter, self.end_id, self.most = spaces_matter, end_id, most
        self.joint = "\n" if spaces_matter else " \x01 "
        self.joint_id = self.library.encode(self.joint.strip(" "), add_special_tokens=False).ids[0]
        # Added tokens cut a text before anything else does, so texts that hold one are encoded whole.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.cache: dict[str, int] = {}
        self.ids, self.ends = np.array([self.end_id], np.uint16), np.array([0, 0, 1])

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """New slots that hold the runs."""
        first = len(self.ends)
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))
        self.ids = np.concatenate((self.ids, ids))
        return np.arange(first, len(self.ends))

    def _runs(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.where(slots > 0, self.ends[slots - 1], 0)
        lengths = self.ends[slots] - starts
        return gathered(self.ids, starts, lengths), lengths

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint16, int(lengths.sum())), lengths

    def _library(self, said: list[str], step: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, many a call: the id of ``joint``, which no chunk holds, stands between them."""
        joined = [self.joint.join(said[x : x + step]) + self.joint for x in range(0, len(said), step)]
        ids = self._whole(joined)[0] if said else np.empty(0, np.uint16)
        ends = np.flatnonzero(ids == self.joint_id)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _split(self, texts: pa.Array) -> pa.Array:
        # With spaces in the tokens, \\x01 marks a chunk that has no space before it; the rest have one.
        # One that stands in the text is doubled, so that it is told apart.
        if self.spaces_matter:
            texts = pc.replace_substring(texts, "\x01", "\x01\x01")
            mark, nothing = (pa.scalar(x, pa.large_string()) for x in ("\x01", ""))
            texts = pc.binary_join_element_wise(mark, pc.replace_substring_regex(texts, "(\n+)", " \\1 \x01"), nothing)
        else:
            texts = pc.replace_substring(texts, "\n", " ")
        return pc.split_pattern(texts, " ")

    def _stem(self, chunk: str) -> str:
        """The chunk without final stops, if both vocabularies cut there for certain."""
        stem = chunk.rstrip(STOPS)
        return stem if stem and stem[-1].isalnum() and stem[-1] < "Ԁ" else chunk

    def _said(self, chunk: str) -> str | None:
        """What the library is given for a chunk; None: its text must be encoded whole."""
        if any(t in chunk for t in self.added):
            return None
        if not self.spaces_matter:
            return None if "\x01" in chunk else chunk
        word = chunk[1:] if chunk[:1] == "\x01" else chunk
        if not word or word != word.strip() or "\x01" in word:
            return None
        return word if chunk[:1] == "\x01" else " " + chunk

    def _learn(self, chunks: list[str]) -> None:
        mark = "\x01" if self.spaces_matter else ""
        if self.spaces_matter:
            for c in [c for c in chunks if c and not c.strip("\n")]:
                # A run of line feeds before a word: the library sees a word, whose ids are taken off.
                ids = self.library.encode(c + "x", add_special_tokens=False).ids[:-1]
                self.cache[c] = int(self._add(np.array(ids, np.uint16), np.array([len(ids)]))[0])
        stems = {c: s for c in chunks if c[-1:] in STOPS and (s := self._stem(c)) != c}
        plain = {c for c in chunks if c not in stems}.union(stems.values(), [mark + c[len(s) :] for c, s in stems.items()])
        plain = [c for c in plain if c not in self.cache]
        said = list(map(self._said, plain))
        good = [c for c, s in zip(plain, said) if s is not None]
        self.cache.update((c, WHOLE) for c, s in zip(plain, said) if s is None)
        self.cache.update(zip(good, self._add(*self._library([s for s in said if s is not None])).tolist()))
        if stems:
            pairs = np.array([(self.cache[s], self.cache[mark + c[len(s) :]]) for c, s in stems.items()])
            ids, lengths = self._runs(pairs.ravel())
            slots = self._add(ids, lengths.reshape(-1, 2).sum(1))
            slots[(pairs == WHOLE).any(1)] = WHOLE
            self.cache.update(zip(stems, slots.tolist()))

    def _slots(self, chunks: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.cache.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if len(missing) and self.cache and len(self.cache) + len(missing) > self.most:
            # Keep what these texts use, which holds every frequent chunk; forget the rest.
            kept = np.flatnonzero(found >= 0)
            runs = self._runs(found[kept])
            self._reset()
            slots = np.where(found[kept] == WHOLE, WHOLE, self._add(*runs))
            self.cache.update(zip([chunks[i] for i in kept], slots.tolist()))
            found[kept] = slots
        if len(missing):
            new = [chunks[i] for i in missing]
            self._learn(new)
            found[missing] = [self.cache[c] for c in new]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = self._split(texts.cast(pa.large_string()).fill_null(""))
        numbered = split.flatten().dictionary_encode()
        slots = self._slots(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())[numbered.indices.to_numpy()]
        cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
        bad = np.unique(np.searchsorted(cuts, np.flatnonzero(slots == WHOLE), "right") - 1)
        held = len(self.ends), len(self.ids)
        if len(bad):
            whole = self._add(*self._whole([texts[int(i)].as_py() or "" for i in bad]))
            for i, s in zip(bad, whole):
                slots[cuts[i] : cuts[i + 1]] = EMPTY
                slots[cuts[i]] = s
        ids, lengths = self._runs(np.insert(slots, cuts[1:], END))
        self.ends, self.ids = self.ends[: held[0]], self.ids[: held[1]]
        ends = np.concatenate(([0], np.cumsum(lengths)))[cuts[1:] + np.arange(1, len(cuts))]
        return ids, np.diff(ends, prepend=0)


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, spaces_matter: bool, end_id: int) -> ChunkEncoder:
    """One encoder a Python worker, vocabulary and end id."""
    if (path, spaces_matter, end_id) not in _encoders:
        _encoders[path, spaces_matter, end_id] = ChunkEncoder(path, spaces_matter, end_id)
    return _encoders[path, spaces_matter, end_id]


def slices(texts: pa.Array, most: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """Runs (a, b) of the texts with at most ``most`` bytes each, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b
