"""Whole texts as sequences of short chunks, so that an encoder sees every distinct chunk once.

A chunk starts at a space that a character other than white space follows.  The split pattern of the
byte-level vocabularies always starts a match there: one of its three alternatives with an optional
leading space fits, and the white-space alternatives stop one character before what follows.  So the
ids of a text are the ids of its chunks one after another, for every text.

A run of letters ends at a mark such as a full stop, whatever follows, so there a match ends too.  Chunks
not seen before are cut at these places, as most of their parts have been seen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that white space or the end of the text follows: there, not every space starts a chunk.
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD_SPACE = f" (?:[{_SPACES}]|\\z)"
_BOUNDARY = re.compile(r" (?=\S)")

#: What ends a run of letters; an apostrophe does not in every pattern.
_MARKS = "\t\n\r!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Chunks that a worker keeps from one task to the next.
BETWEEN_TASKS = 50_000

#: (chunks that stand alone, chunks that start with a space) -> (ids one after another, ids per chunk)
EncodeNew = Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray]]


def split(texts: pa.Array) -> pa.ListArray:
    """The parts of each text between chunk boundaries; all but a text's first lost their leading space."""
    parts = pc.split_pattern(texts, " ")
    odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False))
    if not len(odd):
        return parts
    own = pa.array([_BOUNDARY.split(t) for t in texts.take(pa.array(odd)).to_pylist()], parts.type)
    place = np.arange(len(texts))
    place[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([parts, own]).take(pa.array(place))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of code points below 2**16: 1 for letters in an old Unicode version that still are letters, so that a
    library's tables say the same of them, 2 for marks, else 0."""
    old = unicodedata.ucd_3_2_0.category
    kinds = np.array([old(chr(c))[0] == "L" == unicodedata.category(chr(c))[0] for c in range(1 << 16)], np.uint8)
    kinds[[ord(c) for c in _MARKS]] = 2
    return kinds


def cut(chunks: list[str]) -> tuple[list[str], np.ndarray]:
    """The parts of all chunks one after another, and how many each chunk has."""
    text = "".join(chunks)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.where(points < 1 << 16, _kinds()[points & 0xFFFF], 0)
    ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
    begins = np.zeros(len(points) + 1, bool)
    begins[1:-1] = (kinds[:-1] == 1) & (kinds[1:] == 2)
    begins[ends] = False
    cuts = np.flatnonzero(begins)
    bounds = np.sort(np.concatenate((cuts, ends))).tolist()
    return [text[a:b] for a, b in zip([0, *bounds], bounds)], 1 + np.diff(np.searchsorted(cuts, ends), prepend=0)


class ChunkEncoder:
    """Encode texts through a table of chunks already seen; when it has grown to its bounds, the half of it that
    was met most often stays."""

    def __init__(self, encode_new: EncodeNew, most_chunks: int = 300_000, most_chars: int = 8 << 20,
                 marks: Sequence[str] = (), encode_whole: Callable[[str], np.ndarray] | None = None):
        """`marks` are strings that a tokenizer looks for before it splits: texts that hold one are encoded
        whole, by `encode_whole`."""
        self.encode_new, self.most_chunks, self.most_chars = encode_new, most_chunks, most_chars
        self.marks, self.encode_whole = tuple(marks), encode_whole
        self._clear()

    def _clear(self) -> None:
        self.first: dict[str, int] = {}  # chunks that open a text, and parts behind letters
        self.rest: dict[str, int] = {}  # chunks behind a space, without it
        self.flat = np.empty(1 << 16, np.int32)
        self.used = self.chars = self.number = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int32)
        self.uses = np.zeros(1 << 16, np.int64)

    def shrink(self, most: int) -> None:
        """Keep the `most` chunks that were met most often, and none that was met once."""
        if not self.number:
            return
        often = np.argsort(-self.uses[: self.number], kind="stable")[: max(1, most)]
        keep = np.zeros(self.number, bool)
        keep[often] = self.uses[often] > 1
        old = self.first, self.rest, self.flat, self.starts, self.counts, self.uses
        counts = old[4][: self.number][keep]
        starts, uses = old[3][: self.number][keep], old[5][: self.number][keep]
        self._clear()
        self.first, self.rest = (_renamed(numbers, keep) for numbers in old[:2])
        self.number, self.used = len(counts), int(counts.sum())
        ends = np.cumsum(counts, dtype=np.int64)
        ids = old[2][np.repeat(starts - ends + counts, counts) + np.arange(self.used)]
        self.flat, self.starts, self.counts, self.uses = ids, ends - counts, counts, uses
        self.chars = sum(map(len, self.first)) + sum(map(len, self.rest))
        if self.chars > self.most_chars // 2:
            self._clear()

    def _add(self, firsts: list[str], rests: list[str]) -> None:
        """Add chunks that the table lacks; those behind a space by way of their parts."""
        parts, sizes = cut(rests)
        opens = np.zeros(len(parts), bool)
        opens[np.cumsum(sizes) - sizes] = True
        tails = list(compress(parts, (~opens).tolist()))
        several = sizes > 1
        of_several = np.repeat(several, sizes)
        heads = list(compress(parts, (opens & of_several).tolist()))
        lacking = list(compress(rests, (~several).tolist()))
        lacking = list(dict.fromkeys([*lacking, *[x for x in heads if x not in self.rest]]))
        alone = list(dict.fromkeys([*firsts, *[x for x in tails if x not in self.first]]))
        self._store(alone, lacking, *self.encode_new(alone, [" " + x for x in lacking]))
        if not tails:
            return
        opens = opens[of_several]
        which = np.empty(len(opens), np.int32)
        which[opens] = np.fromiter(map(self.rest.__getitem__, heads), np.int32, len(heads))
        which[~opens] = np.fromiter(map(self.first.__getitem__, tails), np.int32, len(tails))
        self.uses[: self.number] += np.bincount(which, minlength=self.number)
        ids, ends = self._ids(which)
        self._store([], list(compress(rests, several.tolist())), ids, np.diff(ends[np.cumsum(sizes[several])], prepend=0))

    def _ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks numbered `which` one after another, and 0 and where each chunk's ids end."""
        # The ids of a chunk are one binary value, so that Arrow copies them chunk by chunk.
        places = np.append(self.starts[: self.number], self.used) * self.flat.itemsize
        table = pa.Array.from_buffers(pa.large_binary(), self.number, [None, pa.py_buffer(places), pa.py_buffer(self.flat)])
        taken = table.take(pa.array(which))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(which) + 1) // self.flat.itemsize
        return np.frombuffer(taken.buffers()[2] or b"", np.int32)[ends[0] : ends[-1]], ends

    def _store(self, firsts: list[str], rests: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        end = self.number + len(counts)
        self.starts, self.counts, self.uses = _room(self.starts, end), _room(self.counts, end), _room(self.uses, end)
        self.uses[self.number : end] = 0
        self.starts[self.number : end] = self.used + np.cumsum(counts) - counts
        self.counts[self.number : end] = counts
        self.first.update(zip(firsts, range(self.number, end)))
        self.rest.update(zip(rests, range(self.number + len(firsts), end)))
        self.used += len(ids)
        self.number = end
        self.chars += sum(map(len, firsts)) + sum(map(len, rests))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (a null is empty) one after another, and how many each text has."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        marked = np.zeros(len(texts), bool)
        for mark in self.marks:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._encode(texts)
        ids, counts = self._encode(texts.filter(pa.array(~marked)))
        ends = np.cumsum(counts)
        plain = iter([ids[e - n : e] for e, n in zip(ends, counts)])
        rows = [self.encode_whole(texts[i].as_py()) if marked[i] else next(plain) for i in range(len(texts))]
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if self.number > self.most_chunks or self.chars > self.most_chars:
            self.shrink(self.most_chunks // 2)
        parts = split(texts)
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        chunks = parts.flatten()
        opens = np.zeros(len(chunks), bool)
        opens[offsets[:-1]] = True  # a text has one part at least
        firsts = _strings(chunks.filter(pa.array(opens)))
        behind = chunks.filter(pa.array(~opens)).dictionary_encode()
        rests = _strings(behind.dictionary)  # Python sees every different chunk once
        numbers = np.fromiter(map(self.rest.get, rests, repeat(-1)), np.int32, len(rests))
        unseen = list(compress(rests, (numbers < 0).tolist()))
        self._add(list(set(firsts) - self.first.keys()), unseen)
        numbers[numbers < 0] = np.fromiter(map(self.rest.__getitem__, unseen), np.int32, len(unseen))
        which = np.empty(len(chunks), np.int32)
        which[opens] = np.fromiter(map(self.first.__getitem__, firsts), np.int32, len(firsts))
        which[~opens] = numbers[behind.indices.to_numpy()]
        self.uses[: self.number] += np.bincount(which, minlength=self.number)
        ids, ends = self._ids(which)
        return ids, np.diff(ends[offsets])


def _strings(array: pa.Array) -> list[str]:
    """The strings of an array without nulls; by way of NumPy, as `to_pylist` makes a scalar of each."""
    return array.to_numpy(zero_copy_only=False).tolist()


def _renamed(numbers: dict[str, int], keep: np.ndarray) -> dict[str, int]:
    """The chunks that are kept, numbered without those that are not."""
    kept = keep[np.fromiter(numbers.values(), np.int64, len(numbers))].tolist()
    renamed = np.cumsum(keep) - 1
    now = renamed[np.fromiter(compress(numbers.values(), kept), np.int64)].tolist()
    return dict(zip(compress(numbers, kept), now))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.empty(max(size, 2 * len(array), 1 << 10), array.dtype)
    grown[: len(array)] = array
    return grown
