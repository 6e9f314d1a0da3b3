"""Byte-level BPE encoding and decoding over padded numpy matrices.

The pieces of the split pattern become rows of byte ids, gathered by length into padded matrices.  Each
round, every row merges its leftmost pair of minimum rank; pair ranks come from a hashed table, only the
two pairs around a merge are looked up again, and rows without a mergeable pair leave the matrix.  Very
long pieces (a text without a space) are rows of their own, in which one round merges all places of the
minimum rank at once wherever that equals merging them one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from risewatch.llm.chunks import BETWEEN_TASKS, ChunkEncoder
from risewatch.llm.common import give_back, slices

NONE = np.int32(1 << 30)
#: Pieces above this many bytes are rows of their own.
LONG = 256
#: Cells of one matrix.
CELLS = 1 << 20


class Ranks:
    """A rank file: token bytes, and a hashed table from pairs of ids to the id of their union."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, i in self.ids.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, i in self.ids.items():
            for k in range(1, len(token)):
                left, right = self.ids.get(token[:k]), self.ids.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        # A union may have a lower rank than its parts; after such a part has appeared, what lies to its
        # right may no longer be next in turn.
        self.early = np.zeros(size, bool)
        for pair, i in pairs.items():
            for part in (pair >> 32, pair & 0xFFFFFFFF):
                self.early[part] |= part > i
        self._fill(np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slots, self.probes = self._slots(keys), 0
        while len(keys):
            self.probes += 1
            free = self.values[slots] == NONE
            taken, first = np.unique(slots[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[taken], self.values[taken] = keys[chosen], values[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge; negative ids are padding."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slots = self._slots(keys)
        found = np.where(self.keys[slots] == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.values[slots] != NONE))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            here = slots[open_]
            hit = self.keys[here] == keys[open_]
            found[open_[hit]] = self.values[here[hit]]
            open_ = open_[~hit & (self.values[here] != NONE)]
        found[(left < 0) | (right < 0)] = NONE
        return found

    # Encoding

    def merge_rows(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge the rows of a matrix padded with -1 to the end.  Returns (row numbers, final rows) groups."""
        rows, done = np.arange(len(ids)), []
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            ended = best == NONE
            if ended.any():
                done.append((rows[ended], ids[ended]))
                rows, ids, ranks, at, best = (x[~ended] for x in (rows, ids, ranks, at, best))
                if not len(rows):
                    break
            n = np.arange(len(rows))
            ids[n, at] = best
            keep = np.ones(ids.shape, bool)
            keep[n, at + 1] = False
            width = ids.shape[1] - 1
            ids, ranks = ids[keep].reshape(-1, width), ranks[keep].reshape(-1, width)
            ranks[n, at] = NONE
            has = np.flatnonzero(at + 1 < width)
            ranks[has, at[has]] = self.rank(ids[has, at[has]], ids[has, at[has] + 1])
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.rank(ids[has, at[has] - 1], ids[has, at[has]])
        return done

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long row.  All places of the minimum rank go at once, from the left and without
        overlap, if no pair with the new token can have a lower rank; else the leftmost only."""
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks):
            best = ranks.min()
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            if self.early[best]:
                at = at[:1]
            else:  # of touching places every second one, from the first of the run
                run = np.concatenate(([True], np.diff(at) != 1))
                at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # where the merged tokens are now
            ids = ids[keep]
            ranks = ranks[keep[1:]]
            for touched in (new[new > 0] - 1, new[new < len(ids) - 1]):
                ranks[touched] = self.rank(ids[touched], ids[touched + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the number of each piece's ids."""
        whole = [self.ids.get(p, -1) for p in pieces]
        out: list[np.ndarray | None] = [None] * len(pieces)
        todo = [i for i, w in enumerate(whole) if w < 0]
        sizes = np.fromiter((len(pieces[i]) for i in todo), np.int64, len(todo))
        counts = np.ones(len(pieces), np.int64)
        index = np.array(todo, np.int64)
        for i in index[sizes > LONG]:
            out[i] = self.merge_long(self.of_byte[np.frombuffer(pieces[i], np.uint8)])
        groups = []
        width, least = 4, 1
        while least <= LONG:
            bucket = index[(sizes >= least) & (sizes <= width)]
            least, step = width + 1, max(1, CELLS // width)
            for start in range(0, len(bucket), step):
                part = bucket[start : start + step]
                texts = [pieces[i] for i in part]
                lens = np.fromiter(map(len, texts), np.int64, len(texts))
                matrix = np.full((len(part), width), -1, np.int32)
                matrix[np.arange(width) < lens[:, None]] = self.of_byte[np.frombuffer(b"".join(texts), np.uint8)]
                for rows, ids in self.merge_rows(matrix):
                    counts[part[rows]] = (ids >= 0).sum(axis=1)
                    groups.append((part[rows], ids))
            width *= 2
        for i in index[sizes > LONG]:
            counts[i] = len(out[i])
        for i in index[sizes == 0]:
            counts[i] = 0
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        known = np.array(whole, np.int32)
        flat[starts[known >= 0]] = known[known >= 0]
        for part, ids in groups:
            used = ids >= 0
            row, column = np.nonzero(used)
            flat[starts[part[row]] + column] = ids[used]
        for i in index[sizes > LONG]:
            flat[starts[i] : starts[i] + counts[i]] = out[i]
        return flat, counts

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        take = np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ids) else 0)
        return self.bytes[take].tobytes()


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ChunkEncoder:
    """Encoder of a rank file, with the chunks this worker has seen; the pattern's pieces are merged once."""
    import regex

    table, find = ranks(path), regex.compile(pattern).findall

    def encode_new(firsts: list[str], rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Chunks behind a space follow each other in one text; a text's first chunk stands alone.
        found = [find(x) for x in firsts] + [find("".join(rests))]
        seen: dict[str, int] = {}
        which = np.fromiter((seen.setdefault(p, len(seen)) for f in found for p in f), np.int64)
        flat, counts = table.encode_pieces([p.encode() for p in seen])
        starts = np.cumsum(counts) - counts
        each = counts[which]
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts[which] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        # Pieces never cross chunks, so characters tell how many ids each chunk has.
        chars = np.cumsum(np.fromiter((len(p) for f in found for p in f), np.int64))
        sizes = np.cumsum(np.fromiter(map(len, [*firsts, *rests]), np.int64))
        last = np.searchsorted(chars, sizes, "right")
        upto = np.concatenate(([0], ends))[last]
        return ids, np.diff(upto, prepend=0)

    return ChunkEncoder(encode_new)


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids, and return per row: doc_id, n_tokens, the SHA-256 of the
    ids as little-endian 32-bit integers and of the decoded bytes; with `ids`, the ids as well.

    One row out per row in, repeated rows and a null doc_id included; a null or empty text has no ids.
    Columns other than doc_id and text are left out.  No shuffle; a task holds some MB of texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = encoder(path, pattern), ranks(path)
        for batch in slices(batches, "text"):
            flat, counts = encode.encode(batch.column("text"))
            ends = np.cumsum(counts)
            parts = [flat[e - n : e] for e, n in zip(ends, counts)]
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts], pa.string()),
                pa.array([hashlib.sha256(table.decode(p)).hexdigest() for p in parts], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        encode.shrink(BETWEEN_TASKS)
        give_back()

    schema = SCHEMA + (", ids array<int>" if ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
