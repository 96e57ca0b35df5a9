"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch

BLOCK_BYTES = 4096
#: Keys of different blocks that are broadcast, at most; more are joined.
COLLISIONS = 1 << 20


def _named(keys: DataFrame) -> DataFrame:
    """Distinct keys, sorted where they lie, with an integer name for each."""
    return keys.distinct().sortWithinPartitions(*keys.columns).withColumn("name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame, key: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(key, block, name): each block's name, found by its key; and the keys that several blocks share, if any.

    block is null where no other block shares the key.
    """
    named = scratch.put(_named(blocks.select("block")).select(key.alias("key"), "name"), "names")
    shared = named.groupBy("key").count().where("count > 1").select("key")
    if shared.isEmpty():
        return named.withColumn("block", F.lit(None).cast("binary")), None
    shared = scratch.put(shared, "shared")
    odd = _named(blocks.select(key.alias("key"), "block").join(shared, "key", "left_semi").select("block"))
    odd = odd.select(key.alias("key"), (-1 - F.col("name")).alias("name"), "block")
    rest = named.join(shared, "key", "left_anti").withColumn("block", F.lit(None).cast("binary"))
    return scratch.put(rest.unionByName(odd), "names-with-blocks"), shared


def exact_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, key_bits: int = 128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, identity.

    Texts are cut into blocks of block_bytes bytes. The distinct blocks are sorted and numbered; then adjacent
    names are paired, the distinct pairs sorted and numbered, and so on until a document has one name. The
    identity (level, name) is equal for two rows exactly if their texts are: names come from sorted contents,
    and a block's hash (MD5, or key_bits of a shorter one) only serves to send its name back. Blocks whose keys collide are told
    apart by content.

    The row with the largest doc_id of a group stays; a null doc_id is smaller than any other, and of repeated
    rows with that doc_id one stays. A null text counts as empty, and all empty texts are one group. An empty
    table gives an empty result. Other columns are ignored, whatever their names.

    Hot blocks and hot groups are pre-aggregated before each shuffle; names come back by equi-joins that
    adaptive execution splits. Texts are shuffled once, as distinct blocks.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes).cast("int")))
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(bytes, i * {block_bytes} + 1, {block_bytes}))")
    key = F.unhex(F.md5("block")) if key_bits == 128 else F.xxhash64("block").bitwiseAND(F.lit((1 << min(key_bits, 63)) - 1))

    names, shared = _block_names(rows.select(F.explode(cut).alias("block")), key, scratch)
    at = rows.select(F.monotonically_increasing_id().alias("row"), "doc", F.sha2("bytes", 256).alias("sha"), "n", cut.alias("blocks"))
    at = at.select("row", "doc", "sha", "n", F.posexplode("blocks").alias("at", "block")).withColumn("key", key)
    head = [F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("doc", "sha")]
    if shared is None:
        at = at.select("row", "n", "at", *head, "key").join(names.select("key", "name"), "key")
    else:  # only the bytes of blocks that share their key go along; keys that collide are few at any size of the corpus
        few = shared.withColumnRenamed("key", "odd")
        few = F.broadcast(few) if shared.count() <= COLLISIONS else few
        at = at.join(few, F.col("key") == F.col("odd"), "left").select("row", "n", "at", *head, "key", F.when(F.col("odd").isNotNull(), F.col("block")).alias("block"))
        at = at.join(names.withColumnRenamed("block", "whole"), "key").where(F.col("whole").isNull() | (F.col("whole") == F.col("block")))
    at = scratch.put(at.select("row", "n", "at", "doc", "sha", "name"), "level-0")
    scratch.keep("level-0")

    whole = [at.where("n = 1").select("row", "doc", "sha", F.lit(0).alias("level"), "name")]
    most, level = at.agg(F.max("n")).first()[0] or 1, 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        pairs = at.where("n > 1").groupBy("row", (F.col("at") / 2).cast("int").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b"),
            F.max("doc").alias("doc"), F.max("sha").alias("sha"), F.max(((F.col("n") + 1) / 2).cast("int")).alias("n"),
        )
        pairs = scratch.put(pairs.withColumn("b", F.coalesce("b", F.lit(-(2**62)))), f"pairs-{level}")
        names = scratch.put(_named(pairs.select("a", "b")), f"names-{level}")
        at = scratch.put(pairs.join(names, ["a", "b"]).select("row", "n", "at", "doc", "sha", "name"), f"level-{level}")
        scratch.drop(f"pairs-{level}", f"names-{level}")
        whole.append(at.where("n = 1").select("row", "doc", "sha", F.lit(level).alias("level"), "name"))
    every = whole[0]
    for part in whole[1:]:
        every = every.unionByName(part)
    last = every.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc", "row")).alias("last"))
    last = scratch.put(last, "groups")  # a table of its own: only then can the join split a hot group
    found = every.join(last, ["level", "name"])
    return found.select(
        F.col("doc").alias("doc_id"), F.col("last.doc").alias("keep_id"), F.col("group_size"), (F.col("row") == F.col("last.row")).alias("kept"),
        F.col("sha").alias("text_sha256"), F.struct("level", "name").alias("identity"),
    )


def distinct_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_duplicates() keeps, one of each group of equal texts, with their own columns.

    Of rows that repeat both the kept doc_id and its text one stays. An empty table gives an empty result, and clashing
    names of other columns do no harm. Texts are shuffled once more, to meet the keys of the kept rows; only rows that
    repeat are shuffled again.
    """
    found = exact_duplicates(docs, text, id_col)
    times = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias("_again")).where("kept")
    kept = Scratch(docs.sparkSession, "distinct").put(times.select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_sha"), "_again"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_doc"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("_hash"))
    rows = rows.join(kept, F.col("_doc").eqNullSafe(F.col("_kept")) & (F.col("_hash") == F.col("_sha")))
    once = rows.where("_again").dropDuplicates(["_doc", "_hash"])
    return rows.where("not _again").unionByName(once).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
