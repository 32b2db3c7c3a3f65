"""A Merkle manifest of a table: leaves, proofs, and the roots that claims fold to.

Every row is a leaf of its group's tree; the groups' roots are the leaves of one
tree above them. A tree is cut into superblocks of ``2 ** LEVELS`` nodes. Going
up, each superblock is reduced to the node above it, until every tree is one
node. Going down, the nodes of a superblock are cogrouped with the one outer row
that the superblock needs (the siblings from its own node up to the root); one
grouped task then finishes the local reduction, joins the local siblings with the
outer ones to a proof, and folds each leaf's claim along it. No task sees more
than a superblock, whatever the size of a tree.

A leaf's place comes from a written table that is sorted by ranges: it is the
row's number in its file, behind the counts of the files before it. Equal rows
are dealt by their place in the written input, so they too spread over ranges.

Edge cases: a null group is a group of its own and the first; null ids come
first in their group; rows with one id are ordered by their leaf (equal rows
have equal leaves, so the digests do not depend on their order); null fields are
part of the leaf; a lone leaf is its group's root and a lone group's root is the
root, with an empty proof; a row without a claim folds its own leaf; an empty
table gives no rows; texts are hashed whole, in Spark; other columns may have
any name.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import CRC32_SQL, materialize, table

#: Levels of the tree in a superblock.
LEVELS = 10
#: Counts of sorted files are broadcast up to so many rows (about 100 bytes each).
BROADCAST_COUNTS = 200_000


def encoded(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*fields: Column) -> Column:
    """The leaf of a row with these fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in fields]), 256))


def _h(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level from the given ones to ``levels`` above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([_h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """Per level the other node of the run that holds node ``i``: L or R and the node, or ``-`` for a run of one."""
    out = []
    for nodes in levels[:-1]:
        j = i ^ 1
        out.append("-" if j >= len(nodes) else ("R" if j > i else "L") + nodes[j])
        i >>= 1
    return out


def fold(node: str, proof: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for s in proof:
        node = _h(node) if s == "-" else _h(node, s[1:]) if s[0] == "R" else _h(s[1:], node)
    return node


def _height(count: int, most: int) -> int:
    """Levels that a superblock of a tree with ``count`` nodes is reduced by."""
    return min(most, (count - 1).bit_length())


def _placed(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` (tree, id, node, claim) with ``pos``, their place in the tree's order, and ``count``, the tree's nodes."""
    spark = rows.sparkSession
    own = ["tree", "id", "node", "claim"]
    written = materialize(rows.select(*own), f"{label}-rows")
    dealt = written.select(*own, F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("salt"))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = dealt.repartitionByRange(width, "tree", "id", "node", "salt").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged.sortWithinPartitions("tree", "id", "node", "salt").drop("salt"), f"{label}-sorted")
    at = ranged.select(*own, "part", F.col("_metadata.row_index").alias("row"))
    counts = at.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("c"))
    by = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(by).alias("count"))
    counts = materialize(counts, f"{label}-counts")  # a row a file and tree that it holds
    if counts.count() <= BROADCAST_COUNTS:
        counts = F.broadcast(counts)
    return at.join(counts, ["tree", "part"]).select(*own, (F.col("row") + F.col("shift")).alias("pos"), "count")


def _block(most: int) -> Column:
    return F.shiftright("pos", most).alias("block")


def _above(nodes: DataFrame, most: int) -> DataFrame:
    """Each superblock's own node, as a row of the next table up."""

    def top(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        count = int(g["count"].iloc[0])
        node = reduced([x.hex() for x in g["node"]], _height(count, most))[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "count": [-(-count >> most) if count > 1 else 1], "node": [bytes.fromhex(node[0])]})

    return nodes.select("tree", "pos", "count", "node", _block(most)).groupBy("tree", "block").applyInPandas(top, "tree string, pos long, count long, node binary")


def _tables(nodes: DataFrame, label: str, most: int) -> list[DataFrame]:
    """The table of nodes and those above it, up to one node a tree."""
    out = [nodes]
    while True:
        out.append(materialize(_above(out[-1], most), label))
        if out[-1].where("count > 1").isEmpty():
            return out


def _finished(nodes: DataFrame, outer: DataFrame, most: int) -> DataFrame:
    """Every node with its path to the root. ``outer``: tree, pos, path, subroot, root of the superblocks' own nodes.

    The superblock is reduced again, the siblings inside it stand in front of the outer ones, and what the row claims
    (its own node without a claim) is folded along both.
    """

    def finish(key, own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        levels = reduced([x.hex() for x in own["node"]], _height(int(own["count"].iloc[0]), most))
        path = list(above["path"].iloc[0])
        proofs = [[*siblings(levels, i), *path] for i in range(len(own))]
        claims = [n if c is None else c.hex() for n, c in zip(levels[0], own["claim"])]
        return pd.DataFrame(
            {
                "tree": key[0],
                "pos": own["pos"].to_numpy(),
                "id": own["id"].to_numpy(),  # as text, which null ids leave whole
                "node": own["node"].to_numpy(),
                "path": proofs,
                "subroot": above["subroot"].iloc[0],
                "root": above["root"].iloc[0],
                "folded": [fold(c, p) for c, p in zip(claims, proofs)],
            }
        )

    left = nodes.select("tree", "pos", "count", F.col("id").cast("string").alias("id"), "node", "claim", _block(most)).groupBy("tree", "block")
    right = outer.select("tree", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("tree", "block")
    schema = "tree string, pos long, id string, node binary, path array<string>, subroot string, root string, folded string"
    return left.cogroup(right).applyInPandas(finish, schema)


def _down(tables: list[DataFrame], outer: DataFrame, label: str, most: int) -> DataFrame:
    """The lowest table's nodes with their paths, from the outer rows of the highest one."""
    for i, nodes in reversed(list(enumerate(tables[:-1]))):
        if "id" not in nodes.columns:
            nodes = nodes.select("tree", "pos", "count", F.lit(None).cast("long").alias("id"), "node", F.lit(None).cast("binary").alias("claim"))
        outer = _finished(nodes, outer, most)
        if i:
            outer = materialize(outer, label)
    return outer


def manifest(rows: DataFrame, id_col: str, group_col: str, leaf: Column, claim: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row: id, group, leaf, subroot (its group's root), root, proof and folded, digests as hex text.

    ``leaf``: the row's digest as bytes. ``claim``: the digest that somebody claims for it, null where it is the leaf.
    ``proof``: the siblings from the leaf to the root, each behind its side (L or R; ``-``: the node stands alone).
    ``folded``: the root that the claim gives; the claim holds where it equals ``root``. ``levels``: those of a superblock.
    """
    group = F.col(group_col).cast("string")
    leaves = rows.select(
        # a group is named so that null comes first and no name is null
        F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group)).alias("tree"),
        F.col(id_col).cast("long").alias("id"),
        leaf.alias("node"),
        (F.lit(None) if claim is None else claim).cast("binary").alias("claim"),
    )
    own = _tables(_placed(leaves, "merkle"), "merkle-up", levels)
    roots = own[-1].select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("id"), "node", F.lit(None).cast("binary").alias("claim"), F.col("tree").alias("name"))
    # the groups' roots are ordered by the groups' names: few rows as a rule, but dealt like any others
    top = _tables(_placed_roots(roots), "merkle-top", levels)
    path = F.array().cast("array<string>").alias("path")
    root = F.lower(F.hex("node"))
    outer = top[-1].select("tree", "pos", path, root.alias("subroot"), root.alias("root"))
    paths = materialize(_down(top, outer, "merkle-paths", levels), "merkle-paths")
    named = top[0].select("tree", "pos", "name")
    outer = paths.join(named, ["tree", "pos"]).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.lower(F.hex("node")).alias("subroot"), "root")
    out = _down(own, materialize(outer, "merkle-outer"), "merkle-paths", levels)
    return out.select(
        F.col("id").cast("long").alias(id_col),
        F.when(F.col("tree") == "0", None).otherwise(F.substring("tree", 2, 2**31 - 1)).alias(group_col),
        F.lower(F.hex("node")).alias("leaf"),
        "subroot",
        "root",
        F.col("path").alias("proof"),
        "folded",
    )


def _placed_roots(roots: DataFrame) -> DataFrame:
    """``roots`` with ``pos`` in the order of their names, and ``count``."""
    # the name takes the place of the tree while the order is made: one tree of all names, a row each
    spark = roots.sparkSession
    written = materialize(roots, "merkle-roots")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = written.repartitionByRange(width, "name").withColumn("part", F.spark_partition_id()).sortWithinPartitions("name")
    ranged = materialize(ranged, "merkle-roots-sorted")
    at = ranged.select(*roots.columns, "part", F.col("_metadata.row_index").alias("row"))
    counts = at.groupBy("part").agg(F.count("*").alias("c"))  # a row a file
    every = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("c").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part", before.alias("shift"), F.sum("c").over(every).alias("count"))
    return at.join(F.broadcast(counts), "part").select(*roots.columns, (F.col("row") + F.col("shift")).alias("pos"), "count")


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, as hex text."""
    return F.sha2(F.array_join(F.transform(F.filter(proof, lambda s: s != "-"), lambda s: F.substring(s, 2, 64)), ""), 256)


def op11_merkle_exchange(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [*fields[:3], F.col("n_chars") + 1, fields[4]]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    out = manifest(docs, "doc_id", "lang", digest(*fields), F.when(hit, digest(*tampered)))
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


def _enc(e: str) -> str:
    return f"CASE WHEN {e} IS NULL THEN '-' ELSE strlen({e}::varchar) || ':' || {e} END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_enc(e) for e in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _up(name: str, base: str, by: str) -> str:
    """Every level of the trees in ``base`` (by, pos, node, n)."""
    return f"""{name} AS (SELECT {by}, 0 AS lvl, pos, node, n FROM {base} UNION ALL
  SELECT {by}, lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY {by}, lvl, pos // 2, n)"""


OP11_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf('n_chars')} AS leaf, CASE WHEN {CRC32_SQL} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS claim FROM documents),
l AS MATERIALIZED (SELECT *, leaf AS node, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_up('u', 'l', 'g')},
s AS MATERIALIZED (SELECT g, node, 0 AS t, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM u WHERE n = 1),
{_up('v', 's', 't')},
-- one list of steps a leaf: through its group's tree, then through the tree of the groups' roots
steps AS (SELECT l.g, l.pos AS leaf_pos, u.lvl, l.pos >> u.lvl AS at, u.node FROM l JOIN u ON u.g = l.g AND u.n > 1 AND u.pos = xor(l.pos >> u.lvl, 1)
  UNION ALL SELECT l.g, l.pos, 1000 + v.lvl, s.pos >> v.lvl, v.node FROM l JOIN s USING (g) JOIN v ON v.n > 1 AND v.pos = xor(s.pos >> v.lvl, 1)),
lone AS (SELECT l.g, l.pos AS leaf_pos, u.lvl FROM l JOIN u ON u.g = l.g AND u.n > 1 AND u.pos = l.pos >> u.lvl
  UNION ALL SELECT l.g, l.pos, 1000 + v.lvl FROM l JOIN s USING (g) JOIN v ON v.n > 1 AND v.pos = s.pos >> v.lvl),
path AS MATERIALIZED (SELECT lone.g, lone.leaf_pos, row_number() OVER (PARTITION BY lone.g, lone.leaf_pos ORDER BY lone.lvl) AS step, steps.node, steps.at & 1 AS right_side
  FROM lone LEFT JOIN steps USING (g, leaf_pos, lvl)),
folds AS (SELECT g, pos AS leaf_pos, 0 AS step, coalesce(claim, leaf) AS cur FROM l UNION ALL
  SELECT folds.g, folds.leaf_pos, folds.step + 1, sha256(CASE WHEN path.node IS NULL THEN cur WHEN right_side = 1 THEN path.node || cur ELSE cur || path.node END)
  FROM folds JOIN path ON path.g = folds.g AND path.leaf_pos = folds.leaf_pos AND path.step = folds.step + 1),
ends AS (SELECT g, leaf_pos, max_by(cur, step) AS folded_root FROM folds GROUP BY 1, 2),
proofs AS (SELECT g, leaf_pos, coalesce(string_agg(node, '' ORDER BY step), '') AS siblings FROM path GROUP BY 1, 2),
r AS (SELECT node AS root FROM v WHERE n = 1)
SELECT doc_id, leaf, s.node AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s USING (g) JOIN ends ON ends.g = l.g AND ends.leaf_pos = l.pos LEFT JOIN proofs ON proofs.g = l.g AND proofs.leaf_pos = l.pos CROSS JOIN r"""
