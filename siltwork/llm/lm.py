"""N-gram language model in Elias-Fano tries, and scores of texts under it."""

from __future__ import annotations

import os
import pickle
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch
from siltwork.llm.words import mix, text_runs, word_hashes

#: Tokens of a block of texts; words of a vocabulary range and pairs of a bigram range while there are fewer ranges than RANGES.
#: With that many, ranges grow instead, so that the rows exchanged, one for each block and range, grow as the corpus does.
BLOCK, WORDS, PAIRS, RANGES = 1 << 21, 1 << 19, 1 << 21, 1024
#: Keys that a task holds at a time; a range beyond that is sorted in runs on disk.
RUN = 1 << 22
#: Weight of the unigram distribution, in occurrences of the context.
PRIOR = 300.0
#: The end's hash; quantised log10 = code / SCALE - RANGE, code 0 stands for none.
END, SCALE, RANGE = np.uint64(0x51D7_E0F7_E2D0_0001), 4000, 16
#: Parts among which one context's successors are dealt, as a frequent word may precede any other.
SPREAD = 16


def squeeze(a: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    return zstandard.compress(struct.pack("<q", len(a)) + a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def expand(b: bytes, kind: str) -> np.ndarray:
    raw = zstandard.decompress(b)
    (n,) = struct.unpack("<q", raw[:8])
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8).reshape(np.dtype(kind).itemsize, n).T).view(kind).reshape(n)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary; 2 + log2(universe / n) bits a value."""

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.low_bits, self.n, self.low, self.high, self.ones = low_bits, n, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        lows = values & np.uint64((1 << low_bits) - 1)
        bits = np.concatenate([((lows[i : i + 65536, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1) for i in range(0, n, 65536)] or [np.zeros(0, np.uint8)])
        low = np.concatenate([np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8)])
        highs = (values >> np.uint64(low_bits)).astype(np.int64)
        size = (int(highs[-1]) if n else 0) + n + 2
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[highs + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(unary.reshape(-1, 64).sum(1, dtype=np.int64))]).astype(np.int64)
        return cls(low_bits, n, low, high, ones)

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        words = np.ndarray((len(self.low) - 7,), "<u8", np.ascontiguousarray(self.low), strides=(1,))
        return (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Places of the k-th bits of either kind."""
        before = self.ones if bit else np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        for i in range(0, len(k), 1 << 17):
            w = word[i : i + (1 << 17)]
            bits = np.unpackbits(self.high.reshape(-1, 8)[w], axis=1, bitorder="little") == bit
            seen = np.cumsum(bits, axis=1, dtype=np.uint8)
            out[i : i + len(w)] = w * 64 + np.argmax(seen == (k[i : i + len(w)] - before[w] + 1)[:, None], axis=1)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, 1) - at).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self.lows(at)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the place of the first value that is not less, and whether it is x."""
        high, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        zeros = len(self.ones) * 64 - 64 - int(self.ones[-1])
        inside = high < zeros
        h = np.minimum(high, zeros - 1)
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), 0) + 1 - h, 0)
        last = self._select(h, 0) - h
        a, b = np.where(inside, first, self.n), np.where(inside, last, self.n)
        end = b.copy()
        while len(live := np.flatnonzero(a < b)):
            middle = (a[live] + b[live]) // 2
            less = self.lows(middle) < low[live]
            a[live] = np.where(less, middle + 1, a[live])
            b[live] = np.where(less, b[live], middle)
        found = a < end
        found[found] = self.lows(a[found]) == low[found]
        return a, found

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.low_bits, self.n], np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in a file that is mapped and goes with the process."""
    f, path = tempfile.mkstemp(prefix="trie-")
    try:
        with os.fdopen(f, "wb") as out:
            places = []
            for a in arrays:
                out.write(b"\0" * (-out.tell() % 8))
                places.append(out.tell())
                out.write(a.tobytes())
        return [np.asarray(np.memmap(path, a.dtype, "r", at, a.shape)) if len(a) else a for a, at in zip(arrays, places, strict=True)]
    finally:
        os.unlink(path)


def quantised(log10: np.ndarray) -> np.ndarray:
    """Codes from 1 of log10 probabilities from -RANGE to 0."""
    return np.clip(np.rint((log10 + RANGE) * SCALE) + 1, 1, 65535).astype(np.uint16)


def log10_of(codes: np.ndarray) -> np.ndarray:
    return (codes - 1.0) / SCALE - RANGE


class Trie:
    """Two levels: contexts with pointers to their successors, and successors with quantised smoothed probabilities.

    A successor is stored relative to its context, as context number * span + successor, so that the level is
    monotone; it is found by a successor search between the context's pointers.
    """

    def __init__(self, span: int, arrays: list[np.ndarray]) -> None:
        arrays = mapped(arrays)
        self.span, self.arrays = span, arrays
        self.contexts, self.pointers, self.successors = (EliasFano.of(arrays[i : i + 4]) for i in (0, 4, 8))
        self.codes = arrays[12]

    @classmethod
    def build(cls, contexts: np.ndarray, successors: np.ndarray, codes: np.ndarray) -> Trie:
        """Of sorted distinct (context, successor) pairs, and each pair's code."""
        own, first = np.unique(contexts, return_index=True)
        span = int(successors.max(initial=0)) + 1
        place = np.repeat(np.arange(len(own), dtype=np.uint64), np.diff([*first, len(contexts)]))
        parts = [EliasFano.build(own), EliasFano.build(np.append(first, len(contexts))), EliasFano.build(place * np.uint64(span) + successors)]
        return cls(span, [*(a for p in parts for a in p.arrays()), codes.astype(np.uint16)])

    def dump(self) -> bytes:
        """The levels as one file: what load() maps again."""
        return pickle.dumps((self.span, [(a.dtype.str, a.tobytes()) for a in self.arrays]), 5)

    @classmethod
    def load(cls, content: bytes) -> Trie:
        span, arrays = pickle.loads(content)
        return cls(span, [np.frombuffer(raw, kind) for kind, raw in arrays])

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The code of each pair, 0 if it is not in the trie."""
        out = np.zeros(len(contexts), np.uint16)
        if not self.contexts.n:
            return out
        own, back = np.unique(contexts, return_inverse=True)
        at, known = self.contexts.successor(own.astype(np.uint64))
        at = np.minimum(at, self.contexts.n - 1)
        begin, end = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        live = np.flatnonzero(known[back] & (successors < self.span))
        k = back[live]
        place, same = self.successors.successor(at[k].astype(np.uint64) * np.uint64(self.span) + successors[live].astype(np.uint64))
        same &= (place >= begin[k]) & (place < end[k])
        out[live[same]] = self.codes[place[same]]
        return out


class Spool:
    """Keys of a range and what came along with them, read again in order of the keys, about RUN at a time.

    Beyond RUN keys there are sorted runs in a file of the task's own that no one else sees and that is gone with it.
    """

    def __init__(self, kinds: dict[str, str], answers: dict[str, str], limit: int) -> None:
        self.kinds, self.limit = {"key": "<u8", **kinds}, limit
        self.held: list[dict[str, np.ndarray]] = []
        self.size, self.total = 0, 0
        self.runs: list[dict[str, np.ndarray]] = []
        self.answers, self.results = answers, {}

    def add(self, **columns: np.ndarray) -> None:
        n = len(columns["key"])
        self.held.append({**columns, "origin": np.arange(self.total, self.total + n)})
        self.size += n
        self.total += n
        if self.size >= self.limit:
            self.runs.append(dict(zip([*self.kinds, "origin"], mapped(self._sorted()), strict=True)))

    def _sorted(self) -> list[np.ndarray]:
        whole = {c: np.concatenate([h[c] for h in self.held]).astype(kind) for c, kind in [*self.kinds.items(), ("origin", "<i8")]}
        order = np.argsort(whole["key"], kind="stable")
        self.held, self.size = [], 0
        return [whole[c][order] for c in [*self.kinds, "origin"]]

    def passes(self) -> Iterator[dict[str, np.ndarray]]:
        """All entries, in order of their keys; a key's entries are in one pass."""
        if self.held:
            last = dict(zip([*self.kinds, "origin"], self._sorted(), strict=True))
            self.runs.append(last)
        make = (lambda k: np.zeros(self.total, k)) if len(self.runs) < 2 else (lambda k: blank(self.total, k))
        self.results = {c: make(k) for c, k in self.answers.items()}
        if len(self.runs) < 2:
            yield from self.runs
            return
        some = np.sort(np.concatenate([r["key"][:: max(1, len(r["key"]) // 4096)] for r in self.runs]))
        cuts = np.unique(some[np.linspace(0, len(some) - 1, -(-self.total // self.limit) + 1).astype(np.int64)[1:-1]])
        ends = [[0, *np.searchsorted(r["key"], cuts, "left").tolist(), len(r["key"])] for r in self.runs]
        for k in range(len(cuts) + 1):
            part = {c: np.concatenate([r[c][e[k] : e[k + 1]] for r, e in zip(self.runs, ends, strict=True)]) for c in [*self.kinds, "origin"]}
            order = np.argsort(part["key"], kind="stable")
            if len(order):
                yield {c: v[order] for c, v in part.items()}

    def answer(self, part: dict[str, np.ndarray], **columns: np.ndarray) -> None:
        for c, v in columns.items():
            self.results[c][part["origin"]] = v


def blank(n: int, kind: str) -> np.ndarray:
    """Zeros in a file of the task's own."""
    f, path = tempfile.mkstemp(prefix="answers-")
    try:
        os.truncate(f, max(1, n) * np.dtype(kind).itemsize)
        return np.memmap(path, kind, "r+", 0, (n,))
    finally:
        os.close(f)
        os.unlink(path)


def _blocks(names: list[str]):
    """Texts as blocks: the kept columns, marks and numbers of tokens by text, sorted word hashes, tokens as word ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        kept, marks, sizes, tokens, total = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            words, place, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            by = np.argsort(-count, kind="stable")  # small numbers for frequent words take less room
            rank = np.empty(len(by), np.uint32)
            rank[by] = np.arange(len(by))
            rows = pa.concat_arrays(kept)
            packed = [squeeze(np.concatenate(marks)), squeeze(np.concatenate(sizes).astype(np.uint32)), squeeze(words), squeeze(by.astype(np.uint32)), squeeze(rank[place])]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), pa.array([total]), pa.array([len(words)]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), *[pa.array([p], pa.binary()) for p in packed]], ["block", "n_tokens", "n_words", "docs", "marks", "sizes", "words", "by", "tokens"])

        for batch in batches:
            structs = pa.StructArray.from_arrays([batch[n] for n in names], names)
            for first, texts in text_runs(batch["text"], 1 << 21):
                hashes, n = word_hashes(texts)
                if total and total + len(hashes) > BLOCK:
                    yield row()
                    number, kept, marks, sizes, tokens, total = number + 1, [], [], [], [], 0
                kept.append(structs.slice(first, len(texts)))
                marks.append(np.asarray(batch["train"].slice(first, len(texts)).fill_null(False), dtype=np.uint8))
                sizes.append(n + 1)
                tokens.append(np.insert(hashes, np.cumsum(n), END))
                total += len(tokens[-1])
        if total:
            yield row()

    return run


class _Block:
    def __init__(self, row: dict) -> None:
        self.marks, self.sizes = expand(row["marks"], "u1") > 0, expand(row["sizes"], "<u4").astype(np.int64)
        self.words = expand(row["words"], "<u8")
        self.tokens = expand(row["by"], "<u4")[expand(row["tokens"], "<u4")].astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = self.marks[self.doc]
        self.first = np.cumsum(self.sizes) - self.sizes

    def cuts(self, shards: int) -> np.ndarray:
        """Where each shard's words begin among the sorted ones."""
        return np.searchsorted(self.words, np.array([(k << 64) // shards for k in range(shards)], np.uint64)).tolist() + [len(self.words)]

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context id << 32 | id) of known tokens, training counts, and where each token's pair is (-1: none)."""
        own = ids[self.tokens]
        context = np.concatenate([[0], own[:-1]])
        context[self.first] = 0
        after = np.concatenate([[True], own[:-1] > 0])
        after[self.first] = True
        known = (own > 0) & after
        keys, back = np.unique(context[known].astype(np.uint64) << np.uint64(32) | own[known].astype(np.uint64), return_inverse=True)
        place = np.full(len(own), -1, np.int64)
        place[known] = back
        return keys, np.bincount(back, self.train[known], len(keys)).astype(np.uint32), place


def _words_out(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                count = np.bincount(b.tokens, b.train, len(b.words)).astype(np.uint32)
                cut = b.cuts(shards)
                some = [k for k in range(shards) if cut[k] < cut[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([row["block"]] * len(some)), pa.array([squeeze(b.words[cut[k] : cut[k + 1]]) for k in some], pa.binary()), pa.array([squeeze(count[cut[k] : cut[k + 1]]) for k in some], pa.binary())], ["shard", "block", "keys", "counts"])

    return run


#: kind 0: ids and counts of a block's words; 1: codes of its pairs; 2: a level kept as a file, a under b, block its number.
_ANSWER = "kind int, shard bigint, block bigint, a binary, b binary, n bigint, v bigint"


def _answer(kind: int, shard: int, block: int, a: bytes, b: bytes = b"", n: int = 0, v: int = 0) -> pa.RecordBatch:
    columns = [pa.array([x], t) for x, t in zip((kind, shard, block, a, b, n, v), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["kind", "shard", "block", "a", "b", "n", "v"])


def _by_range(take, finish):
    """Rows in order of range: take(row, state) adds each to the range's state, finish(shard, state) gives its answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in batch.schema.names}
                if row["shard"] != shard:
                    if state is not None:
                        yield from finish(shard, state)
                    shard, state = row["shard"], None
                state = take(row, state)
        if state is not None:
            yield from finish(shard, state)

    return run


def _vocabulary(shards: int, limit: int, keep: bool):
    """A range's words get their counts in training, and ids from 1 in order of their hashes, dealt over ranges.

    The words with counts are an Elias-Fano level in which each block's words are looked up by successor search. A kept level
    (a row with block -1) takes the place of counting.
    """

    def take(row: dict, state):
        spool, blocks, stored = state or (Spool({"count": "<i8"}, {"id": "<u4", "total": "<i8"}, limit), [], [])
        if row["block"] < 0:
            stored.append((expand(row["keys"], "<u8"), expand(row["counts"], "<u8").astype(np.int64)))
        else:
            keys = expand(row["keys"], "<u8")
            spool.add(key=keys, count=expand(row["counts"], "<u4"))
            blocks.append((row["block"], len(keys)))
        return spool, blocks, stored

    def finish(shard: int, state) -> Iterator[pa.RecordBatch]:
        spool, blocks, stored = state
        n, v = 0, 0
        levels = []
        for part in spool.passes():
            if stored:
                words, total = (np.concatenate([x[k] for x in stored]) for k in (0, 1))
                first = 0
            else:
                words, first = np.unique(part["key"], return_index=True)
                total = np.add.reduceat(part["count"], first)
                words, total = words[total > 0], total[total > 0]
                first = v
            level = EliasFano.build(words)
            at, found = level.successor(part["key"])
            place = np.where(found, at, 0)
            ids = np.where(found, (first + place) * shards + shard + 1, 0)
            if ids.max(initial=0) >= 2**32:
                raise ValueError("more words than 32-bit ids")
            spool.answer(part, id=ids, total=np.where(found, np.append(total, 0)[place], 0))
            if not stored:
                n, v = n + int(total.sum()), v + len(words)
                levels.append((words, total))
        if keep and levels:
            words, total = (np.concatenate([x[k] for x in levels]) for k in (0, 1))
            yield _answer(2, shard, -1, squeeze(words), squeeze(total.astype(np.uint64)))
        begin = 0
        for k, (block, size) in enumerate(blocks):
            ids, total = (spool.results[c][begin : begin + size] for c in ("id", "total"))
            begin += size
            yield _answer(0, shard, block, squeeze(np.ascontiguousarray(ids)), squeeze(np.ascontiguousarray(total).astype(np.uint64)), n * (k == 0), v * (k == 0))

    return _by_range(take, finish)


def _known(block: _Block, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """ids and training counts of the block's words."""
    rows = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["shard"])
    return np.concatenate([expand(r["a"], "<u4") for r in rows]), np.concatenate([expand(r["b"], "<u8") for r in rows]).astype(np.int64)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix((keys >> np.uint64(32)) * np.uint64(SPREAD) + keys % np.uint64(SPREAD)) % np.uint64(shards)).astype(np.int64)


def _pairs_out(shards: int, n: int, v: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in left.to_pylist():
            b = _Block(row)
            ids, total = _known(b, right.to_pylist())
            keys, counts, _ = b.pairs(ids)
            order = np.argsort(ids, kind="stable")
            ordered = ids[order]
            of = lambda x: order[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)]  # noqa: E731, B023
            contexts, successors = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            seen = np.where(contexts > 0, total[of(contexts)], total[np.searchsorted(b.words, END)])
            single = quantised(np.log10((total + 0.5) / (n + 0.5 * (v + 1))))[of(successors)]
            part = _shard_of(keys, shards)
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                own = by[cut[k] : cut[k + 1]]
                c, first = np.unique(contexts[own], return_index=True)
                out.append((k, row["block"], squeeze(c.astype(np.uint32)), squeeze(np.diff([*first, len(own)]).astype(np.uint32)), squeeze(seen[own[first]].astype(np.uint64)), squeeze(successors[own].astype(np.uint32)), squeeze(counts[own]), squeeze(single[own])))
        return pa.Table.from_arrays([pa.array([o[i] for o in out], pa.int64() if i < 2 else pa.binary()) for i in range(8)], _ASKED)

    return run


_ASKED = ["shard", "block", "contexts", "sizes", "seen", "successors", "counts", "single"]


def _tries(prior: float, limit: int, keep: bool):
    """A range's bigrams become tries, which answer what the blocks ask. Kept tries (rows with block -1) answer instead."""

    def take(row: dict, state):
        spool, blocks, stored = state or (Spool({"seen": "<i8", "count": "<u4", "single": "<u2"}, {"code": "<u2"}, limit), [], [])
        if row["block"] < 0:
            stored.append(Trie.load(row["contexts"]))
        else:
            size = expand(row["sizes"], "<u4").astype(np.int64)
            keys = np.repeat(expand(row["contexts"], "<u4").astype(np.uint64), size) << np.uint64(32) | expand(row["successors"], "<u4").astype(np.uint64)
            spool.add(key=keys, seen=np.repeat(expand(row["seen"], "<u8"), size), count=expand(row["counts"], "<u4"), single=expand(row["single"], "<u2"))
            blocks.append((row["block"], len(keys)))
        return spool, blocks, stored

    def finish(shard: int, state) -> Iterator[pa.RecordBatch]:
        spool, blocks, stored = state
        for number, part in enumerate(spool.passes()):
            if stored:
                tries = stored
            else:
                keys, first = np.unique(part["key"], return_index=True)
                total = np.add.reduceat(part["count"], first, dtype=np.int64)
                held = total > 0
                keys, first, total = keys[held], first[held], total[held]
                p = (total + prior * 10 ** log10_of(part["single"][first])) / (part["seen"][first] + prior)
                tries = [Trie.build(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), quantised(np.log10(p)))]
                if keep:
                    yield _answer(2, shard, number, tries[0].dump())
            contexts, successors = part["key"] >> np.uint64(32), part["key"] & np.uint64(0xFFFFFFFF)
            # A pair is in one trie at most.
            spool.answer(part, code=np.max([t.find(contexts, successors) for t in tries], axis=0))
        begin = 0
        for block, size in blocks:
            yield _answer(1, shard, block, squeeze(np.ascontiguousarray(spool.results["code"][begin : begin + size])))
            begin += size

    return _by_range(take, finish)


def _scores(n: int, v: int, shards: int, prior: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"docs": pa.array([], left.schema.field("docs").type.value_type), "tokens": pa.array([], pa.int64()), "known": pa.array([], pa.int64()), "base": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        row, rows = left.to_pylist()[0], right.to_pylist()
        b = _Block(row)
        ids, total = _known(b, rows)
        keys, _, place = b.pairs(ids)
        codes = np.zeros(len(keys) + 1, np.uint16)
        part = _shard_of(keys, shards)
        by = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[by], np.arange(shards + 1))
        for r in rows:
            if r["kind"] == 1:
                codes[by[cut[r["shard"]] : cut[r["shard"] + 1]]] = expand(r["a"], "<u2")
        uni = (total + 0.5) / (n + 0.5 * (v + 1))
        before = np.concatenate([[0], total[b.tokens][:-1]])
        before[b.first] = total[np.searchsorted(b.words, END)]
        code = codes[place]  # no pair: the last code, 0
        single = np.log10(uni)[b.tokens]
        # A pair's probability is in its trie; without one the context's back-off weight stands before the word's own.
        log_p = np.where(code > 0, log10_of(code), np.log10(prior / (before + prior)) + single)
        sums = [np.bincount(b.doc, x, len(b.sizes)) for x in (total[b.tokens] > 0, single, log_p)]
        docs = left.column("docs").combine_chunks()
        return pa.table({"docs": docs.flatten() if isinstance(docs, pa.ListArray) else docs.chunk(0).flatten(), "tokens": pa.array(b.sizes), "known": pa.array(sums[0].astype(np.int64)), "base": pa.array(sums[1]), "score": pa.array(sums[2])})

    return run


def score(docs: DataFrame, train: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prior: float = PRIOR, save: str | None = None, model: str | None = None) -> DataFrame:
    """One row per input row: the keep columns, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end. base_score is the unigram score with
    0.5 added to each count. score is the log10 probability under a bigram model of all rows where train holds:
    p(w | h) = (count(h w) + prior * p(w)) / (count(h) + prior), with the unigram p(w); a text's first token has the start
    as its context. Each context's probabilities add up to 1, one unknown word included.

    Texts become blocks of about BLOCK tokens. A block asks vocabulary ranges for its distinct words' counts and ids, then
    bigram ranges for its distinct pairs. The words of a vocabulary range are an Elias-Fano level, the pairs of a bigram range
    a trie with p(w | h), quantised to steps of 1 / SCALE in log10, both in mapped files and built from what all blocks
    counted. A pair that the trie lacks gets its context's back-off weight, prior / (count(h) + prior), times p(w).
    Ranges are as many as the corpus needs, up to RANGES; from there on they are sorted in runs on disk and become several
    tries each, so memory stays bounded, and rows exchanged (one for each block and range) grow with the corpus.
    A frequent context's successors are dealt over SPREAD ranges.

    With save, the levels are written to that folder too, as Parquet; with model, those in that folder score docs, and nothing
    is learned (train still marks held_out).

    Words are told apart by 64-bit hashes; at most 2**32 distinct training words get ids. A null text is empty and has one
    token, the end; a null train mark counts as held out. Without training rows every probability is that of an unknown
    word. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    names = [f"kept_{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    types = dict(rows.dtypes)
    kept = "struct<" + ", ".join(f"{n}: {types[n]}" for n in [*names, "train"]) + ">"
    blocks = rows.mapInArrow(_blocks([*names, "train"]), f"block bigint, n_tokens bigint, n_words bigint, docs array<{kept}>, marks binary, sizes binary, words binary, by binary, tokens binary")
    blocks = scratch.put(blocks, "blocks")
    if model is None:
        size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
        word_ranges, pair_ranges = (min(RANGES, -(-size[c] // most) or 1) for c, most in (("words", WORDS), ("tokens", PAIRS)))
    else:
        known = spark.read.parquet(f"{model}/totals").first()
        word_ranges, pair_ranges, prior = known["word_ranges"], known["pair_ranges"], known["prior"]

    def in_order(asked: DataFrame) -> DataFrame:
        return asked.repartition("shard").sortWithinPartitions("shard", "block")

    asked = blocks.drop("docs").mapInArrow(_words_out(word_ranges), "shard bigint, block bigint, keys binary, counts binary")
    if model is not None:
        asked = asked.unionByName(spark.read.parquet(f"{model}/words").select("shard", F.lit(-1).cast("long").alias("block"), F.col("a").alias("keys"), F.col("b").alias("counts")))
    words = scratch.put(in_order(asked).mapInArrow(_vocabulary(word_ranges, RUN, save is not None), _ANSWER), "vocabulary")
    if model is None:
        total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    else:
        total = {"n": known["n"], "v": known["v"]}

    answers = words.where("kind = 0")
    pairs = blocks.drop("docs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_pairs_out(pair_ranges, total["n"], total["v"]), ", ".join(f"{c} {'bigint' if c in ('shard', 'block') else 'binary'}" for c in _ASKED))
    if model is not None:
        empty = [F.lit(None).cast("binary").alias(c) for c in _ASKED[3:]]
        pairs = pairs.unionByName(spark.read.parquet(f"{model}/tries").select("shard", F.lit(-1).cast("long").alias("block"), F.col("a").alias("contexts"), *empty))
    codes = scratch.put(in_order(pairs).mapInArrow(_tries(prior, RUN, save is not None), _ANSWER), "codes")
    if save is not None:
        words.where("kind = 2").select("shard", "a", "b").write.parquet(f"{save}/words")
        codes.where("kind = 2").select("shard", "block", "a").write.parquet(f"{save}/tries")
        spark.createDataFrame([(word_ranges, pair_ranges, float(prior), total["n"], total["v"])], "word_ranges int, pair_ranges int, prior double, n long, v long").coalesce(1).write.parquet(f"{save}/totals")

    told = answers.unionByName(codes.where("kind = 1"))
    found = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scores(total["n"], total["v"], pair_ranges, prior), f"docs {kept}, tokens bigint, known bigint, base double, score double")
    return found.select(
        *[F.col("docs")[n].alias(c) for c, n in zip(keep, names, strict=True)], (~F.col("docs.train")).alias("held_out"), F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
