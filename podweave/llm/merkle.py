"""Merkle manifest of a dataset: every row a leaf, a tree of threes per source, and a tree of the sources' roots.

Nodes of a level are numbered within their source without any task seeing a whole source (range partitions, counted).
Aligned blocks of THREES levels then hold each of their levels as one string of hexadecimal digests: a parent is the hash
of a fixed-width substring, and a node's siblings are the substrings beside it. The blocks' roots are the nodes of the
next round, so a source of any size takes a few rounds, each a small fraction of the one before. On the way back every
block hands its nodes the sibling segments above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podweave.llm.landing import dropped, landed

#: Nodes that make one parent, and levels within a block.
RUN, THREES = 3, 5

#: Nodes of a block, and characters of a digest.
BLOCK, WIDTH = RUN**THREES, 64

STEPS = "array<struct<left:string,right:string>>"


def _written(value: Column) -> Column:
    """`-` for null, else the number of its UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values as written one after another, as lowercase hexadecimal digits."""
    return F.sha2(F.concat(*map(_written, values)), 256)


def _numbered(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The nodes with `place`, from 0 within their source, by `order`, which must tell all rows apart, and `total`; and the
    stored tables that this reads."""
    by = ["source", *order]
    ranged = nodes.repartitionByRange(*by).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in by))
    # stored before it is counted: a range partitioning done again may draw its bounds elsewhere
    ranged = landed(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    parts = ranged.groupBy("part", "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("source")
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = landed(parts.select(
        "part", F.col("source").alias("named"), "first", (F.sum("n").over(earlier) - F.col("n")).alias("base"),
        F.sum("n").over(own).alias("total")))
    joined = ranged.join(parts, (ranged["part"] == parts["part"]) & F.col("source").eqNullSafe(F.col("named")))
    return joined.select(*nodes.columns, (F.col("at") - F.col("first") + F.col("base")).alias("place"), "total"), [ranged, parts]


def _level_above(level: Column) -> Column:
    """The parents of a level, both as one string: hashes of its substrings of RUN digests, the last one of fewer."""
    return F.array_join(F.transform(
        F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (RUN * WIDTH)).cast("int")),
        lambda i: F.sha2(F.substring(level, i * RUN * WIDTH + 1, F.lit(RUN * WIDTH)), 256)), "")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """source, block, total, members (place in the block, digest, carried), level0 to level<THREES> (null from the tree's
    end on), and node (the block's root). `nodes`: source, place, total, digest and the carried columns."""
    member = F.struct(F.pmod("place", F.lit(BLOCK)).cast("int").alias("i"), "digest", *carried)
    rows = nodes.groupBy("source", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members"))
    rows = rows.withColumn("level0", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    for k in range(1, THREES + 1):
        below = F.col(f"level{k - 1}")
        # a source of more than RUN^(k-1) nodes has a level k; a lone node at the end of a larger source is hashed too
        rows = rows.withColumn(f"level{k}", F.when(F.col("total") > RUN ** (k - 1), _level_above(below)))
    return rows.withColumn("node", F.coalesce(*(f"level{k}" for k in range(THREES, -1, -1))))


def _steps(i: Column, levels: list[Column]) -> Column:
    """Siblings left and right of node `i` of a block and of its ancestors in it, level by level."""
    found = []
    for k, level in enumerate(levels[:-1]):
        at = F.floor(i / RUN**k).cast("int")
        run = F.floor(at / RUN).cast("int") * RUN
        # no parent, no siblings: the node is the root of its tree
        found.append(F.when(levels[k + 1].isNotNull(), F.struct(
            F.substring(level, run * WIDTH + 1, (at - run) * WIDTH).alias("left"),
            F.substring(level, (at + 1) * WIDTH + 1, (RUN - 1 + run - at) * WIDTH).alias("right"))))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def _tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, narrowest last; and source, node of the roots. `nodes` as `_blocks` takes them."""
    rounds, carried = [], [c for c in nodes.columns if c not in ("source", "place", "total", "digest")]
    while True:
        blocks = landed(_blocks(nodes, carried))
        rounds.append(blocks)
        if blocks.where(F.col("total") > BLOCK).isEmpty():
            return rounds, blocks.select("source", "node")
        # a source that is done stands by with its root as a tree of one node
        nodes, carried = blocks.select("source", F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"),
                                       F.col("node").alias("digest")), []


def _climbed(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """source, member, subroot, steps of the nodes of the first round. `above`: source as `named`, subroot (its root), and
    the steps over that."""
    levels = [f"level{k}" for k in range(THREES + 1)]
    known = above.withColumn("at", F.lit(0).cast("bigint"))
    for k, blocks in reversed(list(enumerate(rounds))):
        held = blocks.join(known, F.col("source").eqNullSafe(F.col("named")) & (F.col("block") == F.col("at")))
        rows = held.select("source", "block", "subroot", F.explode(F.transform("members", lambda m: F.struct(
            m.alias("member"), F.concat(_steps(m["i"], [F.col(x) for x in levels]), F.col("steps")).alias("steps")))).alias("x"))
        if not k:
            return rows.select("source", "x.member", "subroot", "x.steps")
        known = landed(rows.select(
            F.col("source").alias("named"), (F.col("block") * BLOCK + F.col("x.member.i")).alias("at"), "subroot", "x.steps"))


def manifest(documents: DataFrame, key: str = "doc_id", source: str = "source", fields: list[str] | None = None,
             changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: key, source, leaf, subroot, root, steps (siblings left and right, from the leaf's level up),
    and proof_leaf, the leaf of the same row under `changed` (null if that changes nothing).

    A leaf is the `leaf_hash` of `fields` (by default key, source, lang, n_chars, text). Leaves of a source ascend by key,
    null first, rows of one key by leaf; every RUN consecutive nodes, the last run of fewer, make a parent until one is
    left, the subroot. Subroots, by source with null first, make the root in the same way; a lone node is its own root.

    `changed` maps columns to what they are to be taken for, which `fold` then shows. Repeated rows are leaves of their
    own, with the same proofs but for their places. A null source is a source. An empty table has no root and no rows.
    Other columns are not looked at. Needs the shared folder.
    """
    names = fields or [key, source, "lang", "n_chars", "text"]
    leaf = leaf_hash(*(F.col(c) for c in names))
    other = leaf_hash(*((changed or {}).get(c, F.col(c)) for c in names)) if changed else F.lit(None).cast("string")
    rows = documents.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), leaf.alias("digest"), other.alias("other"))
    rows = landed(rows.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other"))).withColumn(
        "row", F.monotonically_increasing_id()))
    leaves, tables = _numbered(rows, ["key", "digest", "row"])
    rounds, subroots = _tree(leaves.drop("row"))
    dropped(rows, *tables)
    # the sources are the leaves of one more tree
    top, tables = _numbered(subroots.select(F.lit(0).alias("source"), F.col("source").alias("name"), F.col("node").alias("digest")), ["name"])
    over, roots = _tree(top)
    dropped(*tables)
    root = roots.first()  # one digest, or none of an empty table
    whole = roots.select(F.col("source").alias("named"), F.col("node").alias("subroot"), F.array().cast(STEPS).alias("steps"))
    above = landed(_climbed(over, whole).select(
        F.col("member.name").alias("named"), F.col("member.digest").alias("subroot"), "steps"))
    return _climbed(rounds, above).select(
        F.col("member.key").alias(key), F.col("source").alias(source), F.col("member.digest").alias("leaf"), "subroot",
        F.lit(root and root["node"]).cast("string").alias("root"), "steps", F.col("member.other").alias("proof_leaf"))


def proofs(manifested: DataFrame) -> DataFrame:
    """The rows of `manifest` with proof_sha256 (of all siblings, level by level, left to right), folded_root (from
    proof_leaf, or the leaf where that is null) and verified, instead of steps and proof_leaf."""
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    rows = manifested.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn(
        "folded_root", fold(F.coalesce("proof_leaf", "leaf"), F.col("steps")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")).drop("steps", "proof_leaf")


def manifest_report(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of `documents`, the rows whose doc_id has an even
    CRC-32 (of its decimal digits) tampered with: their texts lose all line feeds."""
    even = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return proofs(manifest(documents, changed={"text": text})).drop("source")
