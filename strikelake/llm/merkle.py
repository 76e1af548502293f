"""Merkle manifest of a dataset: one binary tree per language, one over the languages' roots.

Leaves are hashed by native expressions and put in order by a range shuffle, which gives each its place in its tree without
a window over a language. A tree is cut into superblocks of ``BLOCK`` consecutive nodes:

* going up, every superblock is reduced to one node in ``applyInPandas``; these nodes are the leaves of the next level, so
  a level has ``BLOCK`` times fewer rows, and two levels hold 16 million leaves of one language;
* coming down, the nodes of a level are cogrouped by superblock with the outer nodes their paths need (the siblings from
  the superblock up to the root). One function then finishes the reduction within the superblock, joins the inner and
  the outer part of each proof and, at the leaves, folds the claimed leaf up to a root.

No task sees more than ``BLOCK`` nodes of one superblock, and the driver only two numbers (the longest language and the
number of languages), by which it counts the levels.

Defined results: nulls in any column go into the leaf as ``-``; a null language is a tree of its own, before all others;
null ids come before others, and rows with one id are ordered by their leaf, so that repeated rows are interchangeable;
texts of any length are hashed whole; columns beside the five are not read, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikelake.llm.components import stored

BLOCK_LEVELS = 12
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_DIVISOR = 7
# A row id of Spark has the partition above its lowest 33 bits.
_PARTITION_SHIFT = 33

_NODE = "tree bigint, block bigint, place bigint, n bigint, digest binary"
_PATH = "tree bigint, place bigint, digest binary, path array<string>, subroot binary, root binary"
_LEAF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF = ", place bigint, proof array<string>"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(columns: dict[str, Column]) -> Column:
    """The leaf of a row: each value as byte count, colon and value, or ``-`` if null."""
    def shown(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[shown(columns[c]) for c in LEAF_COLUMNS]), 256))


def tampered_chars() -> Column:
    """``n_chars`` of the checked query's tampered copy: one more where 7 divides the id's checksum."""
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPER_DIVISOR == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``place`` 0, 1, 2 ... of every row within its ``tree``, and ``n``, the size of the tree.

    A range shuffle deals the rows out in order, however long a tree is; rows that are equal throughout are spread too. Only
    the counts of a tree in each partition meet in a window.
    """
    first = [F.col(c).asc_nulls_first() for c in ["tree", *order]]
    dealt = rows.repartitionByRange(*first, F.rand(1).asc()).sortWithinPartitions(*first)
    dealt = stored(dealt.withColumn("_row", F.monotonically_increasing_id()), "ranked").withColumn(
        "_part", F.shiftright("_row", _PARTITION_SHIFT))
    counts = dealt.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = counts.select("tree", "_part", F.sum("_n").over(tree).alias("n"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(spans, ["tree", "_part"]).withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _levels(digests: list[str], rounds: int | None) -> list[list[str]]:
    """All levels above some nodes: ``rounds`` of them, or until one node remains."""
    levels = [digests]
    while len(levels[-1]) > 1 if rounds is None else len(levels) <= rounds:
        low = levels[-1]
        levels.append([h(*low[i:i + 2]) for i in range(0, len(low), 2)])
    return levels


def _sorted_levels(nodes: pd.DataFrame, rounds: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """The levels of one superblock; a tree of one superblock ends with its last node."""
    nodes = nodes.sort_values("place", kind="stable")
    alone = int(nodes["n"].iloc[0]) <= 1 << rounds
    return nodes, _levels([bytes(d).hex() for d in nodes["digest"]], None if alone else rounds)


def _inner_path(levels: list[list[str]], i: int) -> list[str]:
    """Per level ``<`` and the sibling before, ``>`` and the one behind, or nothing without one."""
    path = []
    for level in levels[:-1]:
        j = i ^ 1
        path.append("" if j >= len(level) else ("<" if j < i else ">") + level[j])
        i >>= 1
    return path


def fold(digest: str, path: list[str]) -> str:
    """The root that a node and the siblings on its path lead to."""
    for step in path:
        digest = h(step[1:], digest) if step[:1] == "<" else h(digest, step[1:])
    return digest


def _with_block(nodes: DataFrame, rounds: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", rounds))


def _reduced(nodes: DataFrame, rounds: int) -> DataFrame:
    """One node per superblock, as the next level's nodes."""
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        _, levels = _sorted_levels(block, rounds)
        n = (int(block["n"].iloc[0]) + (1 << rounds) - 1) >> rounds
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "n": [n], "digest": [bytes.fromhex(levels[-1][0])]})
    grouped = _with_block(nodes.select("tree", "place", "n", "digest"), rounds).groupBy("tree", "block")
    return stored(grouped.applyInPandas(run, "tree bigint, place bigint, n bigint, digest binary"), "nodes")


def _climb(nodes: DataFrame, longest: int, rounds: int) -> list[DataFrame]:
    """The levels of all trees, the last with one node per tree."""
    levels = [nodes]
    while True:
        levels.append(_reduced(levels[-1], rounds))
        longest = (longest + (1 << rounds) - 1) >> rounds
        if longest <= 1:
            return levels


def _exchange(nodes: DataFrame, outer: DataFrame, rounds: int) -> DataFrame:
    """The path of every node: its siblings within the superblock, then the superblock's own path."""
    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, levels = _sorted_levels(block, rounds)
        rest, subroot, root = list(above["path"].iloc[0]), above["subroot"].iloc[0], above["root"].iloc[0]
        return pd.DataFrame({"tree": block["tree"], "place": block["place"], "digest": block["digest"],
                             "path": [[*_inner_path(levels, i), *rest] for i in range(len(block))], "subroot": subroot, "root": root})
    pairs = _with_block(nodes.select("tree", "place", "n", "digest"), rounds).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return pairs.applyInPandas(run, _PATH)


def _as_outer(paths: DataFrame) -> DataFrame:
    """A node of one level is a superblock of the level below."""
    return paths.select("tree", F.col("place").alias("block"), "path", "subroot", "root")


def _finish(leaves: DataFrame, outer: DataFrame, rounds: int, proofs: bool) -> DataFrame:
    """The exchange at the leaves: proofs are joined, hashed and folded at once."""
    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, levels = _sorted_levels(block, rounds)
        rest = list(above["path"].iloc[0])
        subroot, root = bytes(above["subroot"].iloc[0]).hex(), bytes(above["root"].iloc[0]).hex()
        paths = [[*_inner_path(levels, i), *rest] for i in range(len(block))]
        folded = [fold(leaf if c is None else bytes(c).hex(), path) for leaf, c, path in zip(levels[0], block["claimed"], paths)]
        out = {"doc_id": block["doc_id"], "leaf": levels[0], "subroot": subroot, "root": root,
               "proof_sha256": [h(*[step[1:] for step in path]) for path in paths], "folded_root": folded,
               "verified": [f == root for f in folded]}
        return pd.DataFrame(out | ({"place": block["place"], "proof": paths} if proofs else {}))
    pairs = _with_block(leaves, rounds).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return pairs.applyInPandas(run, _LEAF + (_PROOF if proofs else ""))


def manifest(docs: DataFrame, claimed_chars: Column | None = None, rounds: int = BLOCK_LEVELS, proofs: bool = False) -> DataFrame:
    """Leaf, roots and proof of every row, and the root that the row as claimed folds to.

    ``claimed_chars`` is the ``n_chars`` of the copy to verify, by default that of the table itself. With ``proofs`` the
    siblings come along, per level with their side, as ``fold`` takes them.
    """
    columns = {c: F.col(c) for c in LEAF_COLUMNS}
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", leaf_hash(columns).alias("digest"),
                       *([] if claimed_chars is None else [leaf_hash(columns | {"n_chars": claimed_chars}).alias("claimed")]))
    if claimed_chars is None:
        rows = rows.withColumn("claimed", F.lit(None).cast("binary"))
    else:  # only what differs travels
        rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed")))
    langs = stored(ranked(docs.select("lang").distinct().withColumn("tree", F.lit(0).cast("bigint")), ["lang"]), "languages")
    numbers = langs.select(F.col("lang").alias("_lang"), F.col("place").alias("tree"))
    rows = rows.join(numbers, F.col("lang").eqNullSafe(F.col("_lang"))).select("tree", "doc_id", "digest", "claimed")
    leaves = stored(ranked(rows, ["doc_id", "digest"]), "leaves")
    sizes = leaves.agg(F.max("n"), F.max("tree")).first()
    if sizes[0] is None:
        return docs.sparkSession.createDataFrame([], _LEAF + (_PROOF if proofs else ""))

    trees = _climb(leaves, sizes[0], rounds)
    subroots = trees.pop().select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"),
                                  F.lit(sizes[1] + 1).cast("bigint").alias("n"), "digest")
    tops = _climb(subroots, sizes[1] + 1, rounds)
    outer = tops.pop().select("tree", F.lit(0).cast("bigint").alias("block"), F.array().cast("array<string>").alias("path"),
                              F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for level in reversed(tops):
        paths = stored(_exchange(level, outer, rounds), "paths")
        outer = _as_outer(paths)
    outer = paths.select(F.col("place").alias("tree"), F.lit(0).cast("bigint").alias("block"), "path", F.col("digest").alias("subroot"), "root")
    for level in reversed(trees[1:]):
        outer = _as_outer(stored(_exchange(level, outer, rounds), "paths"))
    return _finish(leaves, outer, rounds, proofs)
