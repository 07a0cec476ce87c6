"""Embedding near-duplicates by cover trees and dual traversal.

Two vectors of one label link if their cosine is at least ``threshold``. On the
unit sphere that is a distance of at most ``sqrt(2 - 2 * threshold)``, and distances
obey the triangle inequality: of two tree nodes whose centres are further apart
than their covering radii and that distance together, no vectors link; of two so
close that all do, none need be looked at.

The tree has nested levels with halving radii. Its top is built by Spark: a node
with more than ``LEAF`` vectors takes a few of them as centres (a net of half its
radius over a bounded sample), every vector joins its nearest centre, and the
exact covering radius of each child is the largest distance measured. Pairs of
nodes are traversed level by level as joins, keeping those the radii allow. Neighbouring
nodes then share blocks of about ``BLOCK`` vectors, so that a block is sent to few tasks; blocks of which
any two nodes stay meet in a task, where the tree goes on down to single vectors with
numpy and both trees are traversed together. Where the radii rule out too little a level
down, as among vectors that all lie far apart, the rows themselves are compared in
one matrix product.

Equal vectors of a label are one entry with a count, so copies cost nothing. What
leaves a task is one row per linked vector (how many it links with, and the
smallest vector it hangs together with there); components are put together by star
contraction.

Centres come from samples, but every vector is placed and every pair that the
radii do not rule out is compared, so the links are exact.

Edge cases: vectors that are null, empty, zero, or hold null, NaN or infinite
components, and those without a label or id, link with nothing and are their own
component; vectors of different lengths never link; rows that repeat a vector link
with one another; ties go to the smaller id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablestats.llm.common import column, saved
from tablestats.llm.graph import components

THRESHOLD = 0.98
LEAF, BLOCK, FAN = 2048, 4096, 8
#: Vectors of a node that its children's centres are chosen from (about).
SAMPLE = 64
MAX_LEVELS = 40
#: Slack for rounding when bounds are compared; links themselves are decided by the cosine.
SLACK = 1e-7
#: Vectors of a tree node that are compared directly.
SMALL = 32
#: A tree node goes on where at most one in FEW of its rows becomes a centre, and a pair of nodes where at
#: least 1 - WORTH of its pairs of rows are ruled out a level down.
FEW, WORTH = 4, 0.6
#: Rows whose cosines with a block are held at once.
ROWS = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def net(x: np.ndarray, radius: float, most: int | None = None, give_up: int | None = None) -> list[int]:
    """Greedy net: rows further than ``radius`` from all rows taken before; none if it takes more than ``give_up``."""
    centres: list[int] = []
    near = np.full(len(x), np.inf)
    while most is None or len(centres) < most:
        far = np.flatnonzero(near > radius)
        if not len(far):
            break
        i = int(far[0]) if most is None else int(far[near[far].argmax()])
        centres.append(i)
        if give_up is not None and len(centres) > give_up:
            return []
        near = np.minimum(near, distances(x, x[i:i + 1])[:, 0])
    return centres


class Tree:
    """A cover tree over some rows: children cover a node's rows within about half its radius; made when they are first asked for."""

    __slots__ = ("x", "rows", "centre", "radius", "children")

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: np.ndarray):
        self.x, self.rows, self.centre = x, rows, centre
        self.radius = float(distances(x[rows], centre[None]).max())
        self.children: list[Tree] | None = None

    def split(self) -> list[Tree]:
        """The children; none where half the radius takes a centre for every few rows, so that going down gains nothing."""
        if self.children is None:
            self.children = []
            if len(self.rows) > SMALL and self.radius > 1e-9:
                own = self.x[self.rows]
                at = net(own, self.radius / 2, give_up=len(own) // FEW)
                if len(at) > 1:
                    nearest = distances(own, own[at]).argmin(1)
                    self.children = [Tree(self.x, self.rows[nearest == k], own[i]) for k, i in enumerate(at) if (nearest == k).any()]
        return self.children


def links(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, raw: tuple[np.ndarray, np.ndarray] | None = None,
          compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with a cosine of at least the threshold between unit rows of x and y.

    ``raw``: the vectors before scaling, for cosines that rounding could move over the threshold.
    ``compared`` gets the numbers of pairs of rows whose cosines were computed.
    """
    limit = math.sqrt(max(0.0, 2 - 2 * threshold))
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(rows: np.ndarray, others: np.ndarray) -> None:
        if compared is not None:
            compared.append(len(rows) * len(others))
        for lo in range(0, len(rows), ROWS):
            some = rows[lo:lo + ROWS]
            cos = x[some] @ y[others].T
            hit = cos >= threshold
            if raw is not None:
                for i, j in np.argwhere(np.abs(cos - threshold) < 1e-12):
                    u, v = raw[0][some[i]].astype(np.float64), raw[1][others[j]].astype(np.float64)
                    hit[i, j] = u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold
            i, j = np.nonzero(hit)
            out.append((some[i], others[j]))

    a = Tree(x, np.arange(len(x)), x[0])
    stack = [(a, a if y is x else Tree(y, np.arange(len(y)), y[0]))]
    while stack:
        a, b = stack.pop()
        d = float(distances(a.centre[None], b.centre[None])[0, 0])
        if d > a.radius + b.radius + limit + SLACK:
            continue
        if d + a.radius + b.radius < limit - SLACK:
            out.append((np.repeat(a.rows, len(b.rows)), np.tile(b.rows, len(a.rows))))
            continue
        if len(a.rows) * len(b.rows) <= SMALL * SMALL or not (a.split() or b.split()):
            compare(a.rows, b.rows)
            continue
        # Both go down a level at once; the children's centres are compared in one product.
        ka, kb = a.split() or [a], b.split() or [b]
        far = distances(np.array([t.centre for t in ka]), np.array([t.centre for t in kb]))
        near = far <= np.array([t.radius for t in ka])[:, None] + np.array([t.radius for t in kb]) + limit + SLACK
        stay = np.array([len(t.rows) for t in ka]) @ near @ np.array([len(t.rows) for t in kb])
        if stay > WORTH * len(a.rows) * len(b.rows) and (far[near] > limit).mean() > WORTH:
            # The radii rule out too little, and few of these can link as a whole: the rows themselves, in one product.
            compare(a.rows, b.rows)
        else:
            stack += [(ka[i], kb[j]) for i, j in np.argwhere(near)]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows hangs together with."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between two blocks (or within one): (pid, n, root)."""
    for b in batches:
        for r in range(b.num_rows):
            row = {c: b.column(c)[r] for c in b.schema.names}
            same = row["a"].as_py() == row["b"].as_py()
            sides = []
            for s in "ab":
                pid, count = (np.array(row[f"{s}_rows"].values.field(f)) for f in ("pid", "count"))
                flat = row[f"{s}_rows"].values.field("vec")
                raw = np.array(flat.flatten(), np.float64).reshape(len(pid), -1)
                order = np.argsort(pid)
                sides.append((pid[order], count[order], raw[order]))
                if same:
                    sides.append(sides[0])
                    break
            (p, m, u), (q, k, v) = sides
            x = unit(u)
            i, j = links(x, x if same else unit(v), threshold, (u, v))
            if same:
                i, j = i[i != j], j[i != j]
                pids, n = p, np.bincount(i, k[j], len(p))
                root = roots_of(len(p), i, j)
            else:
                # Rows of both blocks, by pid, so that the smallest is the root.
                pids, at = np.unique(np.concatenate([p, q]), return_inverse=True)
                i, j = at[:len(p)][i], at[len(p):][j]
                counts = np.zeros(len(pids))
                counts[at[:len(p)]], counts[at[len(p):]] = m, k
                n = np.bincount(i, counts[j], len(pids)) + np.bincount(j, counts[i], len(pids))
                root = roots_of(len(pids), i, j)
            hit = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(pids[hit]), pa.array(n[hit].astype(np.int64)), pa.array(pids[root[hit]])], ["pid", "n", "root"])


def _centres(rows: pd.DataFrame) -> pd.DataFrame:
    """Children's centres of one node: a net of half the sample's radius, halved further until it has two."""
    rows = rows.sort_values("pid")
    x = unit(np.stack(rows["vec"].to_numpy()))
    radius = float(distances(x, x[:1]).max()) / 2
    at = net(x, radius, FAN)
    while len(at) < 2 and radius > 1e-6:
        radius /= 2
        at = net(x, radius, FAN)
    return pd.DataFrame({"parent": [rows["node"].iloc[0]], "centres": [[x[i].tolist() for i in at]]})


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every vector of a split node to its nearest centre."""
    for b in batches:
        nodes, far = [], []
        for node, vec, centres in zip(b.column("node").to_pylist(), b.column("vec"), b.column("centres")):
            if not centres.is_valid:
                nodes.append(node)
                far.append(0.0)
                continue
            c = np.array(centres.values.flatten()).reshape(len(centres), -1)
            d = distances(unit(np.array(vec.values)[None]), c)[0]
            k = int(d.argmin())
            # A node that cannot be split any more is marked, so that it is left as it is.
            nodes.append(f"{node}/{k}" if len(c) > 1 else f"{node}!")
            far.append(float(d[k]))
        yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("count"), b.column("vec"), pa.array(nodes, pa.string()), pa.array(far)], ["pid", "count", "vec", "node", "far"])


_FAR = "sqrt(greatest(0D, 2 - 2 * aggregate(zip_with(x.centre, y.centre, (u, v) -> u * v), 0D, (s, z) -> s + z)))"


def _leaf_pairs(points: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Points with their leaves, and the pairs of leaves whose radii allow links."""
    limit = math.sqrt(max(0.0, 2 - 2 * threshold))
    placed = points
    live = saved(placed.select("node").distinct().select("node", F.lit(None).cast("array<double>").alias("centre"), F.lit(None).cast("double").alias("radius")))
    pairs = live.select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in range(MAX_LEVELS):
        big = saved(placed.groupBy("node").agg(F.count(F.lit(1)).alias("held")).where(f"held > {LEAF} AND NOT endswith(node, '!')"))
        if big.isEmpty():
            break
        draw = F.pmod(F.xxhash64(F.lit(level), "pid"), F.lit(1_000_000)) < F.ceil(F.lit(1_000_000.0 * SAMPLE) / F.col("held"))
        centres = saved(placed.join(big, "node").where(draw).select("node", "pid", "vec").groupBy("node").applyInPandas(_centres, "parent string, centres array<array<double>>"))
        joined = placed.select("pid", "count", "vec", "node").join(centres, placed["node"] == centres["parent"], "left").select("pid", "count", "vec", "node", "centres")
        moved = saved(joined.mapInArrow(_assign, "pid long, count long, vec array<double>, node string, far double"))
        # Levels: children of split nodes with their covering radii, others as they were.
        radii = moved.groupBy("node").agg(F.max("far").alias("radius"))
        born = (centres.select("parent", F.posexplode("centres").alias("k", "centre"), F.size("centres").alias("many"))
                .select("parent", F.when(F.col("many") > 1, F.concat("parent", F.lit("/"), F.col("k").cast("string"))).otherwise(F.concat("parent", F.lit("!"))).alias("node"), "centre"))
        born = born.join(radii, "node").select("parent", "node", "centre", "radius")
        stay = live.join(centres, live["node"] == centres["parent"], "left_anti").select(F.col("node").alias("parent"), "node", "centre", "radius")
        kids = saved(born.unionByName(stay))
        x, y = kids.alias("x"), kids.alias("y")
        pairs = saved(pairs.join(x, F.col("a") == F.col("x.parent")).join(y, F.col("b") == F.col("y.parent"))
                      .where("(a <> b OR x.node <= y.node)").where(f"x.centre IS NULL OR y.centre IS NULL OR x.node = y.node OR {_FAR} <= x.radius + y.radius + {limit + SLACK}")
                      .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        live, placed = kids.select("node", "centre", "radius"), moved
    return placed.select("pid", "count", "vec", "node"), pairs


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vec = column(rows, vector_col).cast("array<double>")
    rows = rows.select(column(rows, id_col).cast("long").alias("vec_id"), column(rows, label_col).cast("string").alias("label"), vec.alias("vec"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
             & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0))
    rows = rows.withColumn("vec", F.when(F.coalesce(sound, F.lit(False)), F.col("vec")))
    entries = rows.where("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("count"))
    # Numbered by partition and position, and written, so the numbers stay.
    entries = saved(entries.withColumn("pid", F.monotonically_increasing_id()))
    points = entries.select("pid", "count", "vec", F.concat_ws("|", F.size("vec").cast("string"), F.regexp_replace("label", "[/!]", "_"), F.hex("label")).alias("node"))
    placed, pairs = _leaf_pairs(points, threshold)
    placed = saved(placed)
    # Blocks: small nodes of a label side by side, the rows of a large one (which could not be split) by hash.
    held = placed.groupBy("node").agg(F.count(F.lit(1)).alias("held")).withColumn("of", F.regexp_replace(F.substring_index("node", "/", 1), "!$", ""))
    so_far = F.sum(F.when(F.col("held") <= BLOCK, F.col("held")).otherwise(0)).over(Window.partitionBy("of").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shared = F.array(F.concat_ws("#", "of", F.floor(so_far / BLOCK).cast("string")))
    alone = F.transform(F.sequence(F.lit(1), F.ceil(F.col("held") / BLOCK).cast("int")), lambda k: F.concat_ws("#", "node", k.cast("string"), F.lit("")))
    names = saved(held.select("node", F.when(F.col("held") <= BLOCK, shared).otherwise(alone).alias("names")))
    mine = F.element_at("names", (F.pmod(F.xxhash64("pid"), F.size("names")) + 1).cast("int"))
    blocks = saved(placed.join(names, "node").select(mine.alias("name"), F.struct("pid", "count", "vec").alias("row")).groupBy("name").agg(F.collect_list("row").alias("rows")))
    a, b = (names.select(F.col("node").alias(s), F.explode("names").alias(f"{s}_name")) for s in "ab")
    # Each two blocks meet once, whichever of their nodes may have links.
    meet = pairs.join(a, "a").join(b, "b").select(F.least("a_name", "b_name").alias("a_name"), F.greatest("a_name", "b_name").alias("b_name"))
    meet = saved(meet.distinct())
    a, b = (blocks.select(F.col("name").alias(f"{s}_name"), F.col("rows").alias(f"{s}_rows")) for s in "ab")
    found = (meet.join(a, "a_name").join(b, "b_name").select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), "a_rows", "b_rows")
             .mapInArrow(lambda it: _compare(it, threshold), "pid long, n long, root long"))
    found = saved(found)
    counts = found.groupBy("pid").agg(F.sum("n").alias("n"))
    roots = components(found.where("pid <> root").select("pid", "root").distinct())
    named = entries.join(roots, entries["pid"] == roots["node"], "left").select("label", "vec", "first", "count", "pid", F.coalesce("root", "pid").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    result = saved(named.join(smallest, "root").join(counts, "pid", "left").select(F.col("label").alias("l"), F.col("vec").alias("v"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("count") - 1).alias("n_links")))
    out = rows.join(result, (rows["label"] == result["l"]) & (rows["vec"] == result["v"]), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
