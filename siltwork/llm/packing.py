"""Token ids packed into rows of one length, as binary matrices."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm.words import text_runs

LENGTH, SHARD = 2048, 1 << 22
#: The pattern that goes with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_COLUMNS = "shard bigint, row int, n_tokens int, doc_ids array<{kind}>, pieces array<int>, last array<boolean>, cu_seqlens array<int>, ids binary, positions binary"


class Capacities:
    """How many rows have each free capacity, in a segment tree: the least capacity that fits is found in log(length) steps."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def best(self, size: int) -> int:
        """The least capacity of at least size, or -1."""
        i = self.leaves + size
        if self.count[i]:
            return size
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # the next subtree to the right
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def pack_lengths(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of pieces whose sizes add up to length at most: best fit, decreasing; equal sizes in order."""
    free = Capacities(length)
    open_rows: list[list[int]] = [[] for _ in range(length + 1)]
    rows: list[list[int]] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        if (capacity := free.best(size)) >= 0:
            row = open_rows[capacity].pop()
            free.add(capacity, -1)
        else:
            row, capacity = len(rows), length
            rows.append([])
        rows[row].append(k)
        if left := capacity - size:
            open_rows[left].append(row)
            free.add(left, 1)
    return rows


class Shard:
    """Documents of about SHARD tokens. Documents longer than a row are split; each piece knows its number."""

    def __init__(self, length: int, pad: int, kind: str) -> None:
        self.length, self.pad, self.kind = length, pad, kind
        self.docs, self.tokens, self.total = [], [], 0

    def add(self, doc, tokens: np.ndarray) -> None:
        self.docs.append(doc)
        self.tokens.append(tokens)
        self.total += len(tokens)

    def rows(self) -> Iterator[tuple[int, list, list[int], list[bool], list[int], bytes, bytes]]:
        pieces = [(d, k, t[i : i + self.length], i + self.length >= len(t)) for d, t in enumerate(self.tokens) for k, i in enumerate(range(0, len(t), self.length))]
        for held in pack_lengths(np.array([len(p[2]) for p in pieces], np.int64), self.length):
            own = [pieces[k] for k in held]
            size = [len(p[2]) for p in own]
            row = np.full(self.length, self.pad, self.kind)
            row[: sum(size)] = np.concatenate([p[2] for p in own])
            positions = np.zeros(self.length, "<u4")
            positions[: sum(size)] = np.concatenate([np.arange(n) for n in size])
            yield sum(size), [self.docs[p[0]] for p in own], [p[1] for p in own], [p[3] for p in own], np.cumsum([0, *size]).tolist(), row.tobytes(), positions.tobytes()


def _packed(tokens_of, length: int, pad: int, kind: str, schema: pa.Schema, shard: int):
    """Pack what a task reads, shard by shard: nothing is shuffled and a task holds one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of()
        task, number, held = TaskContext.get().partitionId(), 0, Shard(length, pad, kind)

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(held.rows())
            for i in range(0, len(rows), 512):
                part = rows[i : i + 512]
                columns = [[task << 32 | number] * len(part), [*range(i, i + len(part))], *zip(*part, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, ids in tokens(batch):
                held.add(doc, ids)
                if held.total >= shard:
                    yield from out()
                    number, held = number + 1, Shard(length, pad, kind)
        if held.docs:
            yield from out()

    return run


def _run(rows: DataFrame, tokens_of, length: int, pad: int, most: int, shard: int) -> DataFrame:
    schema = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(_arrow(rows))), ("pieces", pa.list_(pa.int32())), ("last", pa.list_(pa.bool_())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary())])
    return rows.mapInArrow(_packed(tokens_of, length, pad, "<u2" if most < 1 << 16 else "<u4", schema, shard), _COLUMNS.format(kind=dict(rows.dtypes)["doc"]))


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["doc"].dataType)


def pack_ids(docs: DataFrame, length: int = LENGTH, pad: int = 0, ids: str = "ids", id_col: str = "doc_id", vocabulary: int = 1 << 16, shard: int = SHARD) -> DataFrame:
    """Rows of length token ids from an array column of ids; see pack_texts for the columns.

    Null lists and empty ones have no piece, so a document of one is in no row; a null id_col stays null in doc_ids.
    vocabulary is one more than the largest id and tells how wide ids are written. Repeated rows are packed each, lists longer
    than a row are split, an empty table gives an empty result, and other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(ids).cast("array<int>").alias("tokens"))

    def tokens_of():
        def tokens(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc, t in zip(batch["doc"].to_pylist(), batch["tokens"], strict=True):
                if t.is_valid and len(t.values):
                    yield doc, np.asarray(t.values, np.int64)

        return tokens

    return _run(rows, tokens_of, length, pad, max(vocabulary - 1, pad), shard)


def pack_texts(docs: DataFrame, vocabulary: str, length: int = LENGTH, text: str = "text", id_col: str = "doc_id", pattern: str = PATTERN, shard: int = SHARD) -> DataFrame:
    """Rows of length token ids: shard, row, n_tokens, doc_ids, pieces, last, cu_seqlens, ids and positions.

    vocabulary is a rank file, read by the driver; the id after its last one ends each document and fills up rows. ids
    holds length little-endian ids (2 bytes each where the vocabulary allows, else 4) and positions as many 4-byte
    places that start at 0 with each segment. Segment k of a row is tokens cu_seqlens[k] to cu_seqlens[k + 1]: piece
    pieces[k] of document doc_ids[k], its last if last[k]. A document longer than a row is split into full pieces and
    a rest, so that its pieces in order are its tokens. A task packs what it reads in shards of about shard tokens by
    best fit decreasing: each piece goes to the row with the least free capacity that holds it, which a segment tree
    over capacities finds. A row holds no more than length tokens, and at most one row of a shard is half full or less.

    A null text is empty; an empty text is its end alone. Ids may be of any type and null. Repeated rows are packed
    each. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()
    end = sum(1 for line in content.splitlines() if line.strip())
    shared = docs.sparkSession.sparkContext.broadcast(content)
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def tokens_of():
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line.strip())}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def tokens(batch: pa.RecordBatch) -> Iterator[tuple]:
            for first, texts in text_runs(batch["text"], 1 << 20):
                for doc, t in zip(batch["doc"].slice(first, len(texts)).to_pylist(), texts, strict=True):
                    yield doc, np.array([*encoding.encode_ordinary(t), end], np.int64)

        return tokens

    return _run(rows, tokens_of, length, end, end, shard)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: a record holds a row of the id matrix, its position resets and its segments.

    A task writes its shards one after another, each shard's rows in order. The path must not exist yet.
    """
    packed.write.option("compression", "zstd").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """What write_matrices() wrote, as the same columns."""
    return spark.read.parquet(path)


def matrix(rows: list, length: int = LENGTH) -> np.ndarray:
    """The id matrix of collected rows, in their order."""
    return np.stack([np.frombuffer(r["ids"], f"<u{len(r['ids']) // length}") for r in rows]) if rows else np.zeros((0, length), "<u2")


def digests(packed: DataFrame) -> DataFrame:
    """The packed rows with SHA-256 of ids and positions (lowercase hex) in place of their bytes; an empty table gives none."""
    return packed.withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("positions_sha256", F.sha2("positions", 256)).drop("ids", "positions")
