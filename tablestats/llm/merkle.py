"""Merkle manifest of a table: one tree per source, one tree over the sources' roots.

A leaf is the SHA-256 of a row's columns. Within a source the leaves ascend by id;
every ``ARITY`` consecutive nodes are one run, and the hash of a run's digests is
their parent, until one node is left (the subroot). The subroots, in the order of
their sources, are the nodes of the tree whose last node is the root. A leaf's path
holds its siblings on every level from the leaf to the root, so that the root can be
folded from any one leaf without the rest of the table.

The levels are windows. Rows sit in window partitions of ``ARITY ** LEVELS``
consecutive leaves of a source, sorted by position. A node of level j lives on the
row of its first leaf, so its siblings are ``lag`` and ``lead`` columns with the
fixed offsets 1 * ARITY^j, 2 * ARITY^j, masked by the node's slot in its run and the run's
length; the row of the first child hashes the parent. A run never crosses a window
partition, so no level needs another shuffle. The nodes that remain, one per
partition, are dealt to window partitions again until every source has one node.
Paths then go down: what a partition's top node has above it is joined to its rows,
one row per partition and key, so a source of any size is many small keys.

Positions come from a range sort by (source, id, leaf) and the number of rows that each
range holds of each source; a source that holds most rows spans many ranges.

Edge cases: null columns are hashed as ``-``; a null source is a source of its own, before all
others; null ids come first within their source; rows of one id are ordered by
their leaf, and equal rows take neighbouring positions (their paths differ, the root
does not depend on which is which); empty texts hash as ``0:``; one row alone is its own
subroot, one source alone its subroot the root; an empty table has no rows and no
root; columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablestats.llm.common import broadcast_if_small, column, saved, shuffle_partitions, written

ARITY = 3
#: Levels hashed in one window partition, of ARITY ** LEVELS nodes.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits below the partition number in Spark's row tags.
_LOW_BITS = 33


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of fields: ``-`` for null, else byte count, ``:``, value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)]), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a group g) with pos, the place within the group by ``order``, and n, the group's rows."""
    keys = ["g", *order]
    tagged = saved(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("tag", F.monotonically_increasing_id()))
    runs = saved(tagged.groupBy(F.shiftright("tag", _LOW_BITS).alias("part"), "g").agg(F.min("tag").alias("first"), F.count(F.lit(1)).alias("c")))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = broadcast_if_small(runs.select("part", "g", (before - F.col("first")).alias("shift"), F.sum("c").over(group).alias("n")), runs)
    return tagged.withColumn("part", F.shiftright("tag", _LOW_BITS)).join(starts, ["part", "g"]).withColumn("pos", F.col("tag") + F.col("shift")).drop("part", "tag", "shift")


def _stage(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` (g, n, pos, h, ...) with block, the path within the block, and top, the digest of the block's node on its first row."""
    size = arity**levels
    here = nodes.withColumns({"block": F.expr(f"pos div {size}"), "top": F.col("h")})
    ordered = Window.partitionBy("g", "block").orderBy("pos")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)

    def near(o: int, step: int, slot: str, run: str) -> Column:
        other = (F.lag if o < 0 else F.lead)("top", abs(o) * step).over(ordered)
        return F.when(F.expr(f"{slot} + {o} >= 0 AND {slot} + {o} < {run}"), other)

    for j in range(levels):
        step = arity**j
        count, slot = f"((n + {step - 1}) div {step})", f"((pos div {step}) % {arity})"
        run = f"least({arity}, {count} - (pos div {step}) + {slot})"
        left, right = (F.concat_ws("", *[near(o, step, slot, run) for o in side]) for side in (range(1 - arity, 0), range(1, arity)))
        here = here.withColumn(f"sib{j}", F.when(F.expr(f"pos % {step} = 0 AND {count} > 1"), F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(F.expr(f"{count} = 1"), F.col("top")).otherwise(F.sha2(F.concat("top", f"sib{j}.right"), 256))
        here = here.withColumn("top", F.when(F.expr(f"pos % {step * arity} = 0"), parent))
    # A node's siblings are those of all rows below it.
    sibs = [F.col("sib0")] + [F.last(f"sib{j}", ignorenulls=True).over(so_far) for j in range(1, levels)]
    return here.withColumn("path", F.filter(F.array(*sibs), lambda s: s.isNotNull())).drop(*[f"sib{j}" for j in range(levels)])


def _tops(stage: DataFrame, size: int) -> DataFrame:
    """The blocks' nodes as (g, n, pos, h)."""
    return stage.where("top IS NOT NULL").select("g", F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("block").alias("pos"), F.col("top").alias("h"))


def _climb(nodes: DataFrame, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The written stages from ``nodes`` (g, n, pos, h, ...) up, and the groups' roots (g, n, pos, h)."""
    size = arity**levels
    stages, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        stages.append(written(_stage(nodes, arity, levels)))
        nodes = _tops(stages[-1], size)
        most = -(-most // size)
        if most <= 1:
            return stages, saved(nodes)


def _descend(stages: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """The first stage's rows with whole paths; ``above``: (g, pos, path, carried...) of the last stage's blocks."""
    for stage in reversed(stages):
        over = above.select("g", F.col("pos").alias("block"), F.col("path").alias("rest"), *carried)
        above = stage.join(over, ["g", "block"]).withColumn("path", F.concat("path", "rest")).drop("rest", "block", "top")
    return above


def trees(leaves: DataFrame, group_col: str, order: list[str], leaf_col: str = "leaf", arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``leaves`` with path (siblings left and right, level by level up to the root), subroot and root.

    ``leaves`` has a digest in ``leaf_col``; its rows are ordered by ``order`` within each value of ``group_col``.
    """
    if arity < 2 or levels < 1:
        raise ValueError("arity of at least 2, levels of at least 1")
    # Groups as text that is never null and sorts as the groups do, null first.
    named = leaves.withColumn("g", F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string"))))
    stages, subroots = _climb(_placed(named, order).withColumn("h", F.col(leaf_col)), arity, levels)
    over = _placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("source_g"), "h"), ["source_g"])
    top_stages, top = _climb(over, arity, levels)
    last = top.select("g", "pos", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("h").alias("root"))
    of_source = _descend(top_stages, last, ["root"]).select(F.col("source_g").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("h").alias("subroot"), "root")
    return _descend(stages, saved(of_source), ["subroot", "root"]).drop("g", "n", "pos", "h")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, source, leaf, path, subroot, root) of every row."""
    leaves = saved(docs.select(column(docs, id_col).alias("id"), column(docs, group_col).cast("string").alias("source"), digest(*[column(docs, f) for f in fields]).alias("leaf")))
    return trees(leaves, "source", ["id", "leaf"])


def verified(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The manifest of ``docs`` checked against a copy in which every document whose id has an even crc32 lost its line breaks.

    One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the copy's leaf and the manifest's siblings), verified.
    """
    doc_id, text = column(docs, id_col), column(docs, text_col)
    changed = (F.crc32(doc_id.cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    copy = F.when(changed, digest(*[F.replace(text, F.lit("\n"), F.lit("")) if f == text_col else column(docs, f) for f in fields]))
    leaves = docs.select(doc_id.alias("doc_id"), column(docs, group_col).cast("string").alias("source"), digest(*[column(docs, f) for f in fields]).alias("leaf"), copy.alias("copy"))
    rows = trees(saved(leaves), "source", ["doc_id", "leaf"])
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.coalesce("copy", "leaf"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
