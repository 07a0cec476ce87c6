"""SimHash near-duplicates by segment popcounts.

A document's fingerprint has a bit set where more than half of its shingles'
64-bit hashes have it. Two fingerprints link if at most ``max_bits`` bits differ.

The search maps a fingerprint to its embedding: the number of set bits in each of
32 two-bit segments. Embeddings of linked fingerprints are at a Manhattan
distance of at most the bit distance, so a grid join that finds every pair of
embeddings within it misses nothing. Every embedding reports to its own grid
point and to those one step away; two embeddings within distance two share a
point (one between them), and each pair is taken at one such point only. What
the join finds is verified on the exact bit distance.

Equal fingerprints are one entry, so groups of copies never meet pair by pair.
At a grid point with more than ``MAX_AT_POINT`` fingerprints, pairs are not
listed; its fingerprints are linked through the 64-bit words one bit away from
them: two fingerprints are within two bits exactly if they share such a word (or
are one bit apart), so this is exact as well, and linear.

Edge cases: a null text has no words and the fingerprint zero, which links like
any other; null ids get a fingerprint and a component, but never name one (a
group without any id has a null component); repeated rows stay; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tablestats.llm.common import column, free_names, saved, shuffle_partitions, small_batches
from tablestats.llm.graph import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
MAX_AT_POINT = 32
#: Shingle hashes counted at once, to bound memory on very long texts.
BLOCK = 100_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text, unsigned."""
    words = text.encode().lower().split()  # bytes: ASCII only, as wanted
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[lo:min(n, lo + BLOCK)].tolist(), last[lo:lo + BLOCK].tolist())], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    return _hashed(docs, id_col, text_col, shingle).select("doc_id", "fp")


def _hashed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, h, fp): h is the text's hash."""
    small_batches(docs.sparkSession)
    text = column(docs, text_col).cast("string")
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])

    return rows.mapInArrow(run, "doc_id long, h long, fp long")


# The embedding of fp: 32 counts of two bits each, in one long.
# Of a segment's two bits, their count has the low bit where they differ and the high bit where both are set.
_LOW = "6148914691236517205L"
_EMBED = f"(((fp ^ shiftrightunsigned(fp, 1)) & {_LOW}) | shiftleft(fp & shiftrightunsigned(fp, 1) & {_LOW}, 1))"
# Grid points: step 0 is the embedding itself, step s > 0 adds one to count s, step -s takes one from it.
# A count moves between 0 and 1 by flipping its low bit, between 1 and 2 by flipping both.
_POINTS = """
filter(transform(sequence(-32, 32), s -> CASE
  WHEN s = 0 THEN struct(s AS step, e AS point)
  WHEN s > 0 AND (shiftrightunsigned(e, 2 * s - 2) & 3) = 0 THEN struct(s AS step, e ^ shiftleft(1L, 2 * s - 2) AS point)
  WHEN s > 0 AND (shiftrightunsigned(e, 2 * s - 2) & 3) = 1 THEN struct(s AS step, e ^ shiftleft(3L, 2 * s - 2) AS point)
  WHEN s < 0 AND (shiftrightunsigned(e, -2 * s - 2) & 3) = 1 THEN struct(s AS step, e ^ shiftleft(1L, -2 * s - 2) AS point)
  WHEN s < 0 AND (shiftrightunsigned(e, -2 * s - 2) & 3) = 2 THEN struct(s AS step, e ^ shiftleft(3L, -2 * s - 2) AS point)
  END), x -> x IS NOT NULL)
"""
# Each pair at one point: equal embeddings at their own; neighbours at the one above; others at the
# point where the smaller fingerprint has moved the lower count.
_ONCE = """(a.step = 0 AND b.step = 0) OR (a.step = 0 AND b.step > 0) OR (b.step = 0 AND a.step > 0)
  OR (a.step <> 0 AND b.step <> 0 AND a.step <> b.step AND abs(a.step) <= abs(b.step))"""


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(x, y): links that connect the same fingerprints as all pairs within ``max_bits`` bits; ``prints`` has a distinct column fp."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the grid has steps for at most 2 differing bits")
    # The few bytes of a fingerprint become some 50 points: spread them first.
    prints = prints.repartition(shuffle_partitions(prints.sparkSession), "fp")
    points = prints.selectExpr("fp", f"{_EMBED} AS e").selectExpr("fp", f"explode({_POINTS}) AS p").selectExpr("fp", "p.step AS step", "p.point AS point")
    # Dealt out once, at every size: the count reads all columns, so that Spark reuses the join's exchange for it.
    points = points.repartition("point")
    crowd = points.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.max("step").alias("top"))
    crowd = crowd.where("lo <> hi AND top IS NOT NULL").select("point", "n")
    shared = saved(points.join(crowd.hint("merge"), "point"))
    a, b = (shared.where(f"n <= {MAX_AT_POINT}").select("point", "fp", "step").alias(x) for x in "ab")
    pairs = a.join(b, F.expr(f"a.point = b.point AND a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= {max_bits} AND ({_ONCE})")).selectExpr("a.fp AS x", "b.fp AS y")
    # Crowded points: through the words within one bit of each fingerprint.
    many = shared.where(f"n > {MAX_AT_POINT}").select("fp").distinct()
    near = {0: "array(fp)", 1: "array(fp)", 2: "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"}[max_bits]
    words = saved(many.selectExpr("fp", f"explode({near}) AS word"))
    if max_bits == 1:  # one of two neighbours is the other's word
        flips = many.selectExpr("fp", "explode(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))) AS word")
        stars = flips.join(words.withColumnRenamed("fp", "y"), "word").selectExpr("fp AS x", "y")
    else:
        least = saved(words.groupBy("word").agg(F.min("fp").alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        stars = words.join(least, "word").where("fp <> y").selectExpr("fp AS x", "y").distinct()
    return pairs.unionByName(stars)


def _rooted(entries: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, first) from (fp, first), one row per fingerprint."""
    entries = saved(entries)
    roots = components(links(entries.select("fp"), max_bits))
    return saved(entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = saved(fingerprints(docs, id_col, text_col, shingle))
    own = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), max_bits)
    names = saved(own.groupBy("root").agg(F.min("first").alias("component_id")))
    named = saved(own.join(names, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates.

    It is the one with the smallest id (one without an id only where the group has none);
    where that id is repeated in the group, or missing, the text with the smallest hash; where text
    and id are repeated, the smallest of the other columns.
    """
    rows = _hashed(docs, id_col, text_col, shingle)
    own = _rooted(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")), max_bits)
    i, h, k, l, row = free_names(docs, "id_", "hash_", "first_id_", "first_hash_", "row_")
    stay = saved(own.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(k), F.col("first.h").alias(l)))
    keyed = docs.withColumns({i: column(docs, id_col).cast("long"), h: F.xxhash64(column(docs, text_col).cast("string"))})
    # A null text has xxhash64's seed as its hash, so hashes are never null.
    keyed = keyed.join(stay, keyed[i].eqNullSafe(stay[k]) & (keyed[h] == stay[l]), "left_semi")
    whole = F.struct(*[column(docs, c) for c in docs.columns])
    order = F.struct(F.lit(0), *[column(docs, f.name) for f in docs.schema.fields if isinstance(f.dataType, AtomicType) and f.name != text_col])
    return keyed.groupBy(i, h).agg(F.min_by(whole, order).alias(row)).select(f"{row}.*")
