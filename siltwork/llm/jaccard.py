"""N-gram Jaccard join by an R-tree over count vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, connected_components, parallelism
from siltwork.llm.words import mix, text_runs, word_hashes

#: Shingles that a task of the join holds, about: at least and at most (8 bytes each, and their points).
LEAST, MOST = 1 << 16, 1 << 20
#: Points of a leaf, about how many members a large group is first compared with, and counts of a tree (2 bytes each).
LEAF, PIVOTS, POINTS = 32, 16, 1 << 25
#: Sets of a cell up to which its pairs are counted; a larger one is a star.
PAIRED = 64
#: Up to so many keys (8 bytes each) go to all executors to leave other texts out of a shuffle; beyond, all texts are shuffled.
KEYS = 1 << 20
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_WHOLE = _SEEDS[11]
#: What is added to a number of either sign to keep it above 0 in 32 bits.
_MIDDLE = 1 << 31


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text of fewer words is one shingle, without words none."""
    words, sizes = word_hashes(texts)
    full = np.full(max(len(words) - width + 1, 0), width, np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * _SEEDS[k % 64] + np.uint64(k)
    full = mix(full)  # those that reach over the end of a text are never taken
    out, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            out.append(np.unique(full[at : at + n - width + 1]))
        elif n:
            total = np.uint64(n)
            with np.errstate(over="ignore"):
                for k in range(n):
                    total += words[at + k] * _SEEDS[k % 64] + np.uint64(k)
            out.append(mix(np.array([total])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Directory:
    """The root of the tree: which coordinates of a set's finest count vector, one for each shingle, are looked up in the corpus.

    A set may lack n - need of its n shingles in a similar one, need being percent of n rounded up. So of any more of its
    coordinates at least one has a minimum of 1, and of its coordinates in any order that all sets share, the first
    n - need + 1 hold one. A part of all hashes is enough to look up: where a set has at most n - need shingles in that
    part, it looks up all of them besides, in a directory of such sets alone, as its similar sets may be such too.
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent
        share = min(100, 100 - percent + 15)
        self.limit = np.uint64(((1 << 64) - 1) * share // 100)

    def may_lack(self, n: int) -> int:
        return n * (100 - self.percent) // 100

    def code(self, n: int, looked: int, which: int) -> int:
        """A set's size, how many of the shared ones come first less the number looked up, and the directory."""
        return n << 33 | (self.may_lack(n) + 1 - looked + _MIDDLE) << 1 | which

    def lookups(self, shingles: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(coordinates, code) in either directory."""
        n = len(shingles)
        held = shingles[: np.searchsorted(shingles, self.limit, "right")]
        out = [(held, self.code(n, len(held), 0))]
        if len(held) <= self.may_lack(n):
            out.append((mix(shingles ^ _WHOLE), self.code(n, n, 1)))
        return out

    def within(self, shingles: np.ndarray, cluster: int) -> tuple[np.ndarray, int]:
        """All coordinates, in a directory of the cluster's own sets, and the code."""
        n = len(shingles)
        return mix(shingles ^ np.uint64(cluster % (1 << 64))), self.code(n, n, 1)


def _size(code: Column) -> Column:
    return F.shiftright(code, 33)


def _first(code: Column) -> Column:
    """How many of a set's shared coordinates come first, less their number."""
    return F.shiftright(code, 1).bitwiseAND(F.lit(2 * _MIDDLE - 1)) - _MIDDLE


def _signed(width: int, percent: int):
    """Row number, size, digest and coordinates to look up of each text; of equal sets in a task only the first looks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, seen, row = Directory(percent), set(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, texts in text_runs(batch["text"], 1 << 21):
                sizes, digests, found = [], [], []
                for s in shingle_sets(texts, width):
                    digest = digest_of(s)
                    sizes.append(len(s))
                    digests.append(digest)
                    found.append(directory.lookups(s) if len(s) and digest not in seen else [])
                    if len(seen) < 1_000_000:  # beyond, some copies are looked up for nothing
                        seen.add(digest)
                n = len(texts)
                spread = [pa.array([f[k][0].tobytes() if k < len(f) else None for f in found], pa.binary()) for k in (0, 1)]
                codes = [pa.array([f[k][1] if k < len(f) else None for f in found], pa.int64()) for k in (0, 1)]
                ids = pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch["doc"].slice(first, n), batch["th"].slice(first, n), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), ids, spread[0], codes[0], spread[1], codes[1]], ["row", "doc", "th", "n", "digest", "id", "part", "part_code", "whole", "whole_code"])
                row += n

    return run


def _rows(keys: list[np.ndarray], ids: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, id, code) for each key of each set."""
    sizes = [len(k) for k in keys]
    ids, codes = np.repeat(ids, sizes), np.repeat(codes, sizes)
    flat = np.concatenate([*keys, np.zeros(0, np.int64)])
    for i in range(0, len(flat), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in (flat, ids, codes)], ["h", "id", "code"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each coordinate that a set looks up."""
    for batch in batches:
        for name in ("part", "whole"):
            keys = [np.frombuffer(s.as_buffer(), "<i8") if s.is_valid else np.zeros(0, np.int64) for s in batch[name]]
            yield from _rows(keys, np.asarray(batch["id"]), np.asarray(batch[f"{name}_code"].fill_null(0)))


def _spread_within(width: int, percent: int):
    """A row for each coordinate of a cluster's member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = Directory(percent)
        for batch in batches:
            for first, texts in text_runs(batch["text"], 1 << 21):
                own = batch.slice(first, len(texts))
                columns = [own[c].to_pylist() for c in ("cluster", "member", "digest")]
                found = [(member, *directory.within(s, cluster)) for cluster, member, digest, s in zip(*columns, shingle_sets(texts, width), strict=True) if digest_of(s) == digest]
                if found:  # else other texts of the same ids and hashes
                    ids, keys, codes = zip(*found, strict=True)
                    yield from _rows([k.view(np.int64) for k in keys], np.array(ids, np.int64), np.array(codes, np.int64))

    return run


class Tree:
    """An R-tree over count vectors. A node knows the largest count of each group and the smallest and largest set below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, known: np.ndarray, members: np.ndarray | None = None) -> None:
        members = np.arange(len(points)) if members is None else members
        own = points[members]
        self.most, self.low, self.high = own.max(0), int(sizes[members].min()), int(sizes[members].max())
        self.members, self.below = members, []
        #: The component that all members are known to be in, or -1.
        self.inside = int(known[members[0]]) if (known[members] == known[members[0]]).all() else -1
        if len(members) > LEAF:
            spread = own.max(0) - own.min(0)
            by = known[members] if self.inside < 0 else sizes[members] if self.high > 1.05 * self.low else own[:, int(spread.argmax())]
            order = np.argsort(by, kind="stable")
            half = len(order) // 2
            self.below = [Tree(points, sizes, known, members[order[:half]]), Tree(points, sizes, known, members[order[half:]])]


class Links:
    """Similar sets among some, as the edges of a spanning forest. Sets with the same label are known to be connected."""

    def __init__(self, sets: list[np.ndarray], percent: int, labels: list | None = None) -> None:
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        # About one group for each shingle of the largest set, so that the bound leaves few pairs, but POINTS counts at most.
        groups = 1 << max(4, min(10, int(self.sizes.max(initial=1)).bit_length(), (POINTS // max(1, len(sets))).bit_length() - 1))
        points = np.stack([np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups) for s in sets])
        self.points = points.astype(np.int16 if points.max() < 1 << 15 else np.int32)
        self.root = list(range(len(sets)))
        self.edges: list[tuple[int, int]] = []
        first: dict = {}
        for k, label in enumerate(labels or ()):
            if label is not None:
                self.root[k] = first.setdefault(label, k)

    def find(self, a: int) -> int:
        while self.root[a] != a:
            self.root[a] = a = self.root[self.root[a]]
        return a

    def _bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs may link: the overlap is at most the sum of the smaller counts."""
        most = np.minimum(self.points[a][:, None], self.points[b][None]).sum(2, dtype=np.int64)
        return most * (100 + self.percent) >= self.percent * (self.sizes[a][:, None] + self.sizes[b][None])

    def _verify(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            same = len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True))
            if same * (100 + self.percent) >= self.percent * int(self.sizes[a] + self.sizes[b]):
                self.root[max(x, y)] = min(x, y)
                self.edges.append((a, b))

    def _leaf(self, one: Tree, two: Tree) -> None:
        may = self._bound(one.members, two.members)
        if one is two:
            may = np.triu(may, 1)
        for i, j in zip(*np.nonzero(may), strict=True):
            self._verify(int(one.members[i]), int(two.members[j]))

    def join(self) -> list[tuple[int, int]]:
        # Most members of a group of copies link with one another: a few are compared with all, and nodes inside one
        # component need no comparison any more.
        everyone = np.arange(len(self.sets))
        for pivot in range(min(4, len(self.sets))):
            for i in range(0, len(everyone), 512):
                near = everyone[i : i + 512]
                for k in near[self._bound(np.array([pivot]), near)[0] & (near != pivot)].tolist():
                    self._verify(pivot, k)
        known = np.array([self.find(k) for k in range(len(self.sets))])
        tree = Tree(self.points, self.sizes, known)
        todo = [(tree, tree)]
        while todo:
            one, two = todo.pop()
            if one.inside >= 0 and one.inside == two.inside:
                continue
            if 100 * min(one.high, two.high) < self.percent * max(one.low, two.low):
                continue
            if one is not two and int(np.minimum(one.most, two.most).sum(dtype=np.int64)) * (100 + self.percent) < self.percent * (one.low + two.low):
                continue
            if not one.below and not two.below:
                self._leaf(one, two)
            elif one is two:
                todo += [(one.below[0], one.below[1]), (one.below[1], one.below[1]), (one.below[0], one.below[0])]
            elif one.below and (not two.below or len(one.members) >= len(two.members)):
                todo += [(x, two) for x in one.below]
            else:
                todo += [(one, x) for x in two.below]
        return self.edges


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated rows' texts go to a unit once from each task."""
    seen: set = set()
    for batch in batches:
        new = []
        for key in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["member"].to_pylist(), strict=True):
            new.append(key not in seen)
            if len(seen) < 1_000_000:
                seen.add(key)
        yield batch.filter(pa.array(new, pa.bool_()))


def _verified(width: int, percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        groups: dict[int, dict[int, tuple[np.ndarray, int | None]]] = {}
        for batch in table.to_batches():
            for first, texts in text_runs(batch["text"], 1 << 21):
                own = batch.slice(first, len(texts))
                columns = [own[c].to_pylist() for c in ("cluster", "member", "digest", "label")]
                for cluster, member, digest, label, s in zip(*columns, shingle_sets(texts, width), strict=True):
                    if digest_of(s) == digest:  # else another text of the same id and hash
                        groups.setdefault(cluster, {})[member] = s, label
        edges: list[tuple[int, int]] = []
        for held in groups.values():
            names = sorted(held)
            if len(names) > 1:
                found = Links([held[m][0] for m in names], percent, [held[m][1] for m in names])
                found.join()
                edges += [(names[a], names[b]) for a, b in found.edges]
        return pa.table({"src": pa.array([e[0] for e in edges], pa.int64()), "dst": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _paired(cells: DataFrame, percent: int) -> DataFrame:
    """(src, dst): the pairs of cells(h, id, code) that may link by their sizes and by how many coordinates they share.

    Of two sets the one whose first coordinates end first has all those of them that are common in both, so it lacks the
    others. It may lack as many as its size is above the overlap that a link of the two needs.
    """
    members = cells.groupBy("h").agg(F.collect_set(F.struct("id", "code")).alias("all"))
    near = lambda a, b: (F.least(_size(a["code"]), _size(b["code"])) * 100 >= F.greatest(_size(a["code"]), _size(b["code"])) * percent)
    pairs = members.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda b: (b["id"] > F.col("a")["id"]) & near(F.col("a"), b))).alias("b"))
    pairs = pairs.groupBy(F.col("a.id").alias("src"), F.col("a.code").alias("a"), F.col("b.id").alias("dst"), F.col("b.code").alias("b")).agg(F.count(F.lit(1)).alias("common"))

    def least(code: str) -> Column:
        """Of a set's first coordinates, the common ones less the overlap; one that looks all up has no such bound."""
        lack = F.expr(f"shiftright({code}, 33) * {100 - percent} div 100")
        return F.when(_first(F.col(code)) <= 0, lack + 1 - _size(F.col(code)))

    overlap = F.ceil(percent * (_size(F.col("a")) + _size(F.col("b"))) / (100 + percent))
    # Two sets that both look all up meet in the directory of such sets.
    return pairs.where(F.col("common") >= F.least(least("a"), least("b")) + overlap).select("src", "dst")


def _candidates(looked: DataFrame, percent: int, scratch: Scratch, label: str) -> DataFrame:
    """(id, cluster) of the sets of looked(h, id, code) whose bound leaves them, by the coordinates they share."""
    shared = scratch.put(looked.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    of_set = Window.partitionBy("id", "code")
    # Rare coordinates come first. Those of one set alone are before all of these and shared with none.
    ranked = looked.join(shared.hint("shuffle_hash"), "h").withColumn("rank", F.dense_rank().over(of_set.orderBy("df", "h")))
    ranked = ranked.withColumn("of", F.max("rank").over(of_set)).where(F.col("rank") <= _first(F.col("code")) + F.col("of"))
    cells = scratch.put(ranked.select("h", "id", "code").dropDuplicates(["id", "code", "h"]), "cells")
    hubs = scratch.put(cells.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("h", "k", "hub"), "hubs")
    cells = cells.join(hubs, "h")
    stars = cells.where(F.col("k") > PAIRED).where("id <> hub").select(F.col("id").alias("src"), F.col("hub").alias("dst")).distinct()
    pairs = _paired(cells.where(F.col("k") <= PAIRED).select("h", "id", "code"), percent)
    found = scratch.put(connected_components(stars.unionByName(pairs), scratch, "candidates").select(F.col("node").alias("id"), F.col("comp").alias("cluster")), label)
    scratch.drop("shared", "cells", "hubs")
    return found


def _clusters(signed: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(cluster, member, doc, th, n, digest) of the classes whose root bound leaves them."""
    looked = signed.where("part is not null").select("id", "part", "part_code", "whole", "whole_code").mapInArrow(_spread, "h bigint, id bigint, code bigint")
    found = _candidates(looked, percent, scratch, "clusters")
    return scratch.put(classes.join(found, "id").select("cluster", F.col("row").alias("member"), "doc", "th", "n", "digest"), "members")


def _of_members(texts: DataFrame, members: DataFrame, many: int) -> DataFrame:
    """The texts, those of others left out where the members are few."""
    if many > KEYS:
        return texts
    keys = members.select(F.xxhash64("doc", "th").alias("key")).distinct()
    return texts.join(F.broadcast(keys), F.xxhash64("doc", "th") == F.col("key"), "left_semi")


def _split(texts: DataFrame, members: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """members, with clusters above PAIRED sets clustered again by all coordinates of their sets."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > PAIRED)
    large = scratch.put(members.join(size, "cluster").select("cluster", "member", "doc", "th", "n", "digest"), "large")
    many = large.count()
    if not many:
        return members
    dealt = large.select(F.col("doc").alias("own"), F.col("th").alias("own_th"), "cluster", "member", "digest")
    read = _of_members(texts, large, many).join(dealt, F.col("doc").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th"))).select("text", "cluster", "member", "digest")
    looked = scratch.put(read.mapInArrow(_spread_within(width, percent), "h bigint, id bigint, code bigint"), "looked")
    found = _candidates(looked, percent, scratch, "split-clusters")
    again = large.drop("cluster").join(found, F.col("member") == F.col("id")).select("cluster", "member", "doc", "th", "n", "digest")
    out = scratch.put(members.join(size, "cluster", "left_anti").unionByName(again), "split")
    scratch.drop("large", "looked", "members")
    return out


def _links(texts: DataFrame, members: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """(src, dst): a spanning forest of the links between members, cluster by cluster."""
    size = scratch.put(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles")).where("k > 1"), "sizes")
    total = size.agg(F.sum("shingles"), F.sum("k")).first()
    unit = min(MOST, max(LEAST, (total[0] or 0) // (4 * parallelism(texts.sparkSession))))
    units = max(1, -(-(total[0] or 0) // unit))
    members = members.join(size, "cluster").withColumn("parts", F.ceil(F.col("shingles") / unit).cast("long"))
    members = scratch.put(members.select("cluster", "member", "doc", "th", "digest", "k", "parts", F.pmod(F.xxhash64("member"), F.col("parts")).alias("part")), "dealt")
    scratch.drop("sizes")
    texts = _of_members(texts, members, total[1] or 0)

    def joined(dealt: DataFrame, label: str) -> DataFrame:
        """dealt(cluster, member, doc, th, digest, label, a, b): the links within each unit (a, b)."""
        dealt = dealt.select(F.col("doc").alias("own"), F.col("th").alias("own_th"), "cluster", "member", "digest", "label", "a", "b")
        read = texts.join(dealt, F.col("doc").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th"))).select("text", "cluster", "member", "digest", "label", "a", "b")
        read = read.mapInArrow(_once, read.schema)
        return scratch.put(read.groupBy("a", "b").applyInArrow(_verified(width, percent), "src bigint, dst bigint"), label)

    none, long = F.lit(None).cast("long").alias("label"), lambda x: F.lit(x).cast("long")
    columns = ("cluster", "member", "doc", "th", "digest", "parts", "part")
    # Small clusters share units. A large one is dealt in parts, and about PIVOTS of its members go to all parts.
    small = members.where("parts = 1").select(*columns, none, long(-1).alias("a"), F.pmod(F.xxhash64("cluster"), long(units)).alias("b"))
    large = members.where("parts > 1")
    pivot = F.pmod(F.xxhash64("member", F.lit(1)), F.greatest(long(1), F.ceil(F.col("k") / PIVOTS).cast("long"))) == 0
    every = F.sequence(long(0), F.col("parts") - 1)
    first = large.select(*columns, none, F.col("cluster").alias("a"), F.explode(F.when(pivot, every).otherwise(F.array("part"))).alias("b"))
    links = joined(small.unionByName(first), "links")
    if large.isEmpty():
        return links
    # What is not in its cluster's largest component yet meets all members, in units of two parts; where that is few, all of
    # a cluster's strays are one part.
    label = scratch.put(connected_components(links, scratch, "first").select(F.col("node").alias("member"), F.col("comp").alias("label")), "labels")
    large = large.join(label, "member", "left").withColumn("label", F.coalesce("label", "member"))
    count = large.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("in"))
    main = scratch.put(count.groupBy("cluster").agg(F.max(F.struct("in", "label")).alias("top"), F.sum("in").alias("all")), "main")
    large = large.join(main, "cluster").withColumn("stray", F.col("label") != F.col("top.label")).withColumn("strays", F.col("all") - F.col("top.in"))
    large = large.where("strays > 0").withColumn("bands", F.ceil(F.col("strays") * F.col("parts") / F.col("all")).cast("long"))
    band = F.pmod(F.xxhash64("member", F.lit(2)), F.col("bands"))
    # Unit (part, band): the members of a part and the strays of a band; bands of strays are no larger than parts.
    meets = F.flatten(F.array(
        F.transform(F.sequence(long(0), F.col("bands") - 1), lambda x: F.col("part") * F.col("bands") + x),
        F.when(F.col("stray"), F.transform(every, lambda x: x * F.col("bands") + band)).otherwise(F.array().cast("array<bigint>")),
    ))
    second = large.select(*columns, F.col("label"), F.col("cluster").alias("a"), F.explode(F.array_distinct(meets)).alias("b"))
    return links.unionByName(joined(second, "more-links"))


def _components(docs: DataFrame, text: str, id_col: str, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows(row, doc, th, n, digest), one for each row of docs, and known(digest, class, component) of the sets with shingles.

    class is the same for the sets of a component, component its smallest doc.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = dict(texts.dtypes)["doc"]
    schema = f"row bigint, doc {kind}, th bigint, n bigint, digest binary, id bigint, part binary, part_code bigint, whole binary, whole_code bigint"
    signed = scratch.put(texts.select("doc", "th", "text").mapInArrow(_signed(width, percent), schema), "signed")
    rows = signed.select("row", "doc", "th", "n", "digest", "id")
    # The member that stands for a set is a row with its smallest id.
    head = rows.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "th", "row", "n", "id")).alias("head"))
    classes = scratch.put(head.select("digest", "head.doc", "head.th", "head.row", "head.n", "head.id"), "classes")
    members = _clusters(signed, classes, percent, scratch)
    rows = scratch.put(rows.drop("id"), "rows")
    scratch.drop("signed")
    members = _split(texts, members, width, percent, scratch)
    links = _links(texts, members, width, percent, scratch)
    found = connected_components(links, scratch, "links-cc").select(F.col("node").alias("row"), F.col("comp").alias("class"))
    known = classes.select("row", "digest", "doc").join(found, "row", "left").select("digest", "doc", F.coalesce("class", "row").alias("class"))
    known = scratch.put(known, "linked")
    least = scratch.put(known.groupBy("class").agg(F.min("doc").alias("component")), "least")
    known = scratch.put(known.join(least, "class").select("digest", "class", "component"), "components")
    scratch.keep("rows", "components")
    return rows, known


def similar_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct shingles of width words
    (runs without ASCII white space, A-Z lower-cased). Fewer words are one shingle. A null text or one without words
    has no shingle and links with nothing, so its component is its own doc_id. Repeated rows are copies. A null
    doc_id is never the smallest; a component without any doc_id has a null component_id. An empty table gives an
    empty result. Other columns are ignored, whatever their names. Shingles are told apart by 64-bit hashes of keyed word
    hashes (two texts of n shingles are mistaken with a chance of about n * n / 2**64), sets by 128-bit digests.

    Sets are points: counts of their shingles by group. The sum of the smaller counts bounds the overlap of two points, and
    with the largest counts below a node that of nodes. Equal sets are one point.

    1. At the root, with one group for each shingle, the other points' largest count is 1 where another document holds the
       shingle and else 0. A point whose summed minima with that can't reach what a link needs has no link, and is
       done with; this leaves few besides copies. See Directory for which coordinates are looked up.
    2. The next level has a cell for each coordinate. A point belongs to the cells of its rarest coordinates only, so
       many that all others together can't reach what a link needs. Connected components of points that share a cell
       are clusters: no link leaves one, and a hot cell is a star, never its pairs. A cluster above PAIRED sets goes through
       both levels again, with all coordinates of its sets, among these alone: texts that share a passage but are otherwise
       unlike are done with, so they never meet pair by pair.
    3. A cluster is an R-tree over coarser groups, joined node against node; pairs that survive are verified by their sets, but
       for those already connected. A cluster beyond a task is dealt in parts that are joined within, and with a few pivots.
       Then only the members outside the cluster's largest component so far meet all parts, so that
       a large group of near copies is sent twice, not once for each part.
    4. Connected components of the links.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows, known = _components(docs, text, id_col, width, percent, scratch)
    out = rows.select("doc", "n", "digest").join(known.select("digest", "component"), "digest", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id"))


def unlike_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each component, with its own columns, and all rows without words.

    The row with the smallest doc_id stays; of several such, or where no row has an id, the one whose text has the smallest
    hash. Rows that repeat both id and text count as one.
    """
    scratch = Scratch(docs.sparkSession, "unlike")
    rows, known = _components(docs, text, id_col, width, percent, scratch)
    rows = rows.join(known.select("digest", "class"), "digest", "left")
    first = rows.where("n > 0").groupBy("class").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "th")).alias("head")).select("head.doc", "head.th")
    bare = rows.where("n = 0").select("doc", "th").distinct()
    repeats = rows.where("n > 0").groupBy("doc", "th").agg(F.count(F.lit(1)).alias("times"))
    first = first.join(repeats, first["doc"].eqNullSafe(repeats["doc"]) & (first["th"] == repeats["th"])).select(first["doc"], first["th"], (F.col("times") > 1).alias("again"))
    stay = scratch.put(first.unionByName(bare.withColumn("again", F.lit(False))), "stay")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_th"))
    kept = own.join(stay, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_th") == F.col("th")))
    once = kept.where("again").dropDuplicates(["_doc", "_th"])
    return kept.where("not again").unionByName(once).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
