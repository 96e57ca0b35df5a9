"""BPE encoding and decoding with a minimal acyclic transducer for frequent words."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch
from siltwork.llm.words import text_runs

#: The lexicon holds so many words at most, the most frequent of all documents.
LEXICON = 200_000
#: Characters of text whose pieces are looked up together.
CHUNK = 1 << 22
#: The piece pattern of word_bpe_49k.json, with its letters, numbers and white space spelt out.
LETTER, NUMBER, SPACE = r"\p{L}", r"\p{N}", r"\t-\r\x85\p{Z}"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
PIECE = regex.compile(f"{ENDINGS}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
#: The same for texts of the first 256 characters alone, on which all versions of Unicode agree.
_FIRST = {name: "".join(re.escape(chr(c)) for c in range(256) if regex.match(f"[{own}]", chr(c))) for name, own in (("L", LETTER), ("N", NUMBER), ("S", SPACE))}
LATIN = re.compile(f"{ENDINGS}|[{_FIRST['L']}]+|[{_FIRST['N']}]|[^{''.join(_FIRST.values())}]+")
END = "</w>"
NONE = 1 << 62
PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


class Merges:
    """Exact merging of one piece. Built from the vocabulary file's content."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["unk_token"] is not None:
            raise ValueError("a BPE vocabulary with word ends and without an unknown token is asked for")
        vocab = model["vocab"]
        alphabet = byte_alphabet()
        self.first = [vocab[c] for c in alphabet]
        self.last = [vocab[c + END] for c in alphabet]
        # A pair's rank and what it becomes, as one number.
        self.order = {vocab[a] << 24 | vocab[b]: k << 24 | vocab[a + b] for k, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = dict(map(reversed, vocab.items())) | {i: t for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.first[b] for b in piece[:-1]] + [self.last[piece[-1]]]
        get = self.order.get
        ranks = [get(a << 24 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        if len(ids) > 64:
            return self._merge_long(ids, ranks)
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 24 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 24 | ids[i], NONE)
        return ids

    def _merge_long(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for a piece of any length."""
        n, get = len(ids), self.order.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j < 0 or get(ids[i] << 24 | ids[j]) != r:
                continue
            ids[i], ids[j] = r & 0xFFFFFF, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (got := get(ids[a] << 24 | ids[b])) is not None:
                    heapq.heappush(heap, (got, a))
        return [x for x in ids if x is not None]


class Pieces:
    """NFC, lower case (each character by itself), then the pattern.

    Python, its regex module and the tokenizers library follow different versions of Unicode. lower and classes tell how the
    library sees the characters on which they differ (see library_unicode); only texts that hold one take the slow way.
    """

    def __init__(self, lower: dict[str, str] | None = None, classes: dict[str, tuple[str, str]] | None = None) -> None:
        self.lower = lower or {}
        more, less = ({k: v[i] for k, v in (classes or {}).items()} for i in (0, 1))
        odd = "".join([*map(regex.escape, self.lower), *more.values(), *less.values()])
        self.odd = regex.compile(f"[{odd}]") if odd else None

        def of(name: str, plain: str) -> str:
            """A set of characters of the class as the library has it."""
            own = f"[{plain}{more.get(name, '')}]"
            return f"[{own}--[{less[name]}]]" if less.get(name) else own

        letter, number, space = of("L", LETTER), of("N", NUMBER), of("S", SPACE)
        self.exact = regex.compile(f"(?V1){ENDINGS}|{letter}+|{number}|(?:(?!{letter}|{number}|{space})(?s:.))+") if odd else PIECE

    def of(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return LATIN.findall(text.lower())  # these are composed already
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text)
        if self.odd is None or not self.odd.search(text):
            return PIECE.findall(text.replace("Σ", "σ").lower())
        return self.exact.findall("".join(got if (got := self.lower.get(c)) is not None else c.replace("Σ", "σ").lower() for c in text))


def _ranges(codes: list[int]) -> str:
    """A pattern's ranges for sorted code points."""
    out, at = [], 0
    for k in range(1, len(codes) + 1):
        if k == len(codes) or codes[k] != codes[k - 1] + 1:
            out.append(f"\\U{codes[at]:08x}-\\U{codes[k - 1]:08x}")
            at = k
    return "".join(out)


@functools.cache
def library_unicode() -> tuple[dict[str, str], dict[str, tuple[str, str]]]:
    """What Pieces needs to follow the library's Unicode version, asked of the library for all code points.

    Lower cases of characters that Python lower-cases otherwise; and by class the ranges of characters that it has more
    and less.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    kinds = {"L": (r"\p{L}", LETTER), "N": (r"\p{N}", NUMBER), "S": (r"\s", SPACE)}
    more, less, lower = {k: [] for k in kinds}, {k: [] for k in kinds}, {}
    # In blocks, so that the driver holds few of them at once.
    for first in range(0x80, 0x110000, 1 << 14):
        codes = [c for c in range(first, min(first + (1 << 14), 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, codes))
        for name, (theirs, ours) in kinds.items():
            held = np.ones(len(codes), bool)
            for _, (a, b) in pre_tokenizers.Split(Regex(theirs), "removed").pre_tokenize_str(text):
                held[a:b] = False
            mine = regex.compile(f"[{ours}]").match
            for c, h in zip(codes, held.tolist(), strict=True):
                if h != (mine(chr(c)) is not None):
                    (more if h else less)[name].append(c)
        low = normalizers.Lowercase().normalize_str("\n".join(text)).split("\n") if codes else []
        lower |= {chr(c): got for c, got in zip(codes, low, strict=True) if got != chr(c).replace("Σ", "σ").lower()}
    return lower, {k: (_ranges(more[k]), _ranges(less[k])) for k in kinds}


class Transducer:
    """A minimal acyclic automaton of byte strings. Arcs carry numbers whose sum along a word is its place in order."""

    @staticmethod
    def build(words: list[bytes], ids: list[list[int]]) -> bytes:
        """The file's content; words are sorted and distinct."""
        # A state that can't change any more is (final, labels, targets), numbered once; targets have smaller numbers.
        register: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[int, int]]] = [([False], {})]
        prior = b""

        def settled() -> int:
            (final,), arcs = path.pop()
            return register.setdefault((final, bytes(arcs), tuple(arcs.values())), len(register))

        for w in [*words, b""]:
            same = len(os.path.commonprefix([w, prior]))
            while len(path) - 1 > same:
                state = settled()
                path[-1][1][prior[len(path) - 1]] = state
            path += [([False], {}) for _ in w[same:]]
            if w or words[:1] == [w]:
                path[-1][0][0] = True
            prior = w
        settled()
        # The root is the last; in the file it is the first. Each state knows how many words follow.
        root = len(register) - 1
        follow = np.zeros(len(register), np.int64)
        keys, targets, outs, final = array("q"), array("q"), array("q"), bytearray(len(register))
        for s, (ends, labels, below) in enumerate(register):
            passed = int(ends)
            for label, t in zip(labels, below, strict=True):
                keys.append((root - s) << 8 | label)
                targets.append(root - t)
                outs.append(passed)
                passed += int(follow[t])
            follow[s] = passed
            final[root - s] = ends
        arrays = [np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(outs, "<i4"), np.frombuffer(final, "u1"), np.cumsum([0, *map(len, ids)]).astype("<i4"), np.array([i for x in ids for i in x], "<u4")]
        by = np.argsort(arrays[0], kind="stable")
        arrays[:3] = [a[by] for a in arrays[:3]]
        head = struct.pack("<7q", max(map(len, words), default=0), *map(len, arrays))
        out = bytearray(head)
        for a in arrays:
            out += b"\0" * (-len(out) % 8) + a.tobytes()
        return bytes(out)

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.longest, *sizes = struct.unpack("<7q", f.read(56))
        at, arrays = 56, []
        for n, kind in zip(sizes, ("<i8", "<i4", "<i4", "u1", "<i4", "<u4"), strict=True):
            at += -at % 8
            arrays.append(np.asarray(np.memmap(path, kind, "r", at, (n,))) if n else np.zeros(0, kind))
            at += n * np.dtype(kind).itemsize
        self.keys, self.targets, self.outs, self.final, self.offsets, self.ids = arrays

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, or -1; all words take a step together."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        place = np.full(len(words), -1, np.int64)
        live = np.flatnonzero(size <= self.longest) if len(self.keys) else np.zeros(0, np.int64)
        state, out = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            done = size[live] == step
            if done.any():
                ended = done & (self.final[state] > 0)
                place[live[ended]] = out[ended]
                live, state, out = live[~done], state[~done], out[~done]
                if not len(live):
                    break
            key = state << 8 | flat[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, out = self.targets[at].astype(np.int64), out[ok] + self.outs[at]
            step += 1
        return place

    @classmethod
    def mapped(cls, content: bytes) -> Transducer:
        """Map a copy of the file that goes when the process ends."""
        f, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(f, "wb") as out:
                out.write(content)
            return cls(path)
        finally:
            os.unlink(path)


class Encoder:
    """Encodes whole texts; the lexicon answers for frequent pieces, merging for the rest."""

    def __init__(self, merges: Merges, lexicon: Transducer, pieces: Pieces) -> None:
        self.merges, self.lexicon, self.pieces = merges, lexicon, pieces
        self.token = [merges.token.get(i, "").encode() for i in range(max(merges.token) + 1)]

    def _pieces(self, found: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Of each piece its ids (4 bytes each) and its decoded form."""
        words = list(found)
        if not words:
            return {}
        coded = [w.encode() for w in words]
        places = self.lexicon.find(coded)
        frequent = np.flatnonzero(places >= 0)
        first, last = self.lexicon.offsets[places[frequent]].astype(np.int64), self.lexicon.offsets[places[frequent] + 1].astype(np.int64)
        ends = np.cumsum(last - first)
        flat = self.lexicon.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - (last - first)), last - first)].tolist()
        ids: list = [None] * len(words)
        begin = 0
        for k, end in zip(frequent.tolist(), ends.tolist(), strict=True):
            ids[k] = flat[begin:end]
            begin = end
        token, merge, pack = self.token, self.merges.merge, PACKERS
        out = {}
        for w, c, got in zip(words, coded, ids, strict=True):
            if got is None:
                got = merge(c)
            out[w] = pack[len(got)](*got) if len(got) < len(pack) else struct.pack(f"<{len(got)}I", *got), b" ".join([token[i] for i in got])
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text in UTF-8) of each text."""
        runs, known = [], set()
        for text in texts:
            parts = self.merges.split.split(text) if text and self.merges.split else [text] if text else []
            run = [(p, None) if k % 2 else (None, self.pieces.of(p)) for k, p in enumerate(parts) if p]
            for _, pieces in run:
                known.update(pieces or ())
            runs.append(run)
        table = self._pieces(known)
        out = []
        for run in runs:
            got: list[tuple[bytes, bytes]] = []
            for special, pieces in run:
                if special is not None:
                    got.append((struct.pack("<I", self.merges.special[special]), special.encode()))
                else:
                    got += [table[p] for p in pieces]
            out.append((b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])))
        return out


def _count(pieces: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        cut = Pieces(*pieces)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

        for batch in batches:
            for t in batch["text"]:
                found.update([p for p in cut.of(t.as_py() or "") if len(p) <= 32])
                if len(found) > 300_000:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    return run


def compile_lexicon(docs: DataFrame, merges: Merges, text: str = "text", words: int = LEXICON) -> bytes:
    """The transducer file for the most frequent pieces (at most words of them) of all documents.

    What it holds changes the speed, never the ids: pieces that it lacks are merged.
    """
    scratch = Scratch(docs.sparkSession, "lexicon")
    some = docs.select(F.col(text).alias("text")).where("text is not null")
    counts = some.mapInArrow(_count(library_unicode()), "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    top = scratch.put(counts.orderBy(F.col("n").desc(), "piece").limit(words), "words")
    held = sorted(piece.encode() for piece in top.select("piece").toArrow()["piece"].to_pylist())
    return Transducer.build(held, [merges.merge(w) for w in held])


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = LEXICON, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per input row: the keep columns, n_tokens, ids, decoded, ids_sha256 and decoded_sha256.

    vocabulary is a tokenizer file (BPE with word ends) that the driver reads; its content goes to the executors with
    the compiled lexicon. ids are those of the tokenizers library without added special tokens; special tokens that
    a text itself spells out keep their ids. decoded is the library's decoding of ids: tokens joined by blanks.
    Of ids and decoded only those named in outputs are returned; their digests always are. A null or empty text has no
    tokens. Whole texts are read, a few at a time; pieces of any length are merged in n log n; other columns are
    ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    lexicon = compile_lexicon(docs, Merges(content), text, words)
    shared = docs.sparkSession.sparkContext.broadcast((content, lexicon, library_unicode()))
    names = [f"kept_{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(shared.value[0]), Transducer.mapped(shared.value[1]), Pieces(*shared.value[2]))
        for batch in batches:
            for first, texts in text_runs(batch["text"], CHUNK):
                got = encoder.encode(texts)
                own = batch.slice(first, len(texts))
                new = [pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string()), pa.array([hashlib.sha256(g[1]).hexdigest() for g in got], pa.string())]
                if "ids" in outputs:
                    ends = np.cumsum([0, *[len(g[0]) // 4 for g in got]])
                    new.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join([g[0] for g in got]), "<i4"))))
                if "decoded" in outputs:
                    new.append(pa.array([g[1].decode() for g in got], pa.string()))
                yield pa.RecordBatch.from_arrays([*[own[c] for c in names], *new], [*names, *added])

    kinds = {"ids": "array<int>", "decoded": "string"}
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *[o for o in kinds if o in outputs]]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text") + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {o} {kinds[o]}" for o in kinds if o in outputs)
    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *added)
