"""Substring dedup: passages that stand in more than one place.

Seed and extend on winnowed anchors. Of every ``length - SEED + 1`` consecutive
word ``SEED``-grams, the one with the smallest hash is an anchor (the first of
equal ones), so every window of ``length`` words holds exactly one anchor of its
own, chosen by its words alone: equal windows have equal anchors at the same
offset. Anchors that stand in one place only end there. The
others, joined by hash, are the seeds: each is extended both ways over the windows
that belong to it. Places of a seed whose whole stretch of such words agrees with
another place's are settled at once; the rest (the ends of a repeat) are compared
window by window with one place of each settled stretch and with one another.
Neighbouring matches merge into maximal repeats.

Every place is compared with all others through counts by 128-bit hash, so a
passage that stands in thousands of documents costs its own size, not pairs, and
equal texts are looked at once. Anchors that agree by chance cost time only. Texts
are compressed before they are dealt out, and one row of each text is dealt out once
to meet its seeds; later steps deal out only texts with seeds.

Edge cases: a null text has no words; a document shorter than ``length`` words
keeps all; overlapping repeats within one document count (a window may repeat one
that overlaps it); repeated rows are repeats of each other, with rows of equal id
and text decided alike; null ids are kept and behave like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablestats.llm.common import column, saved, shuffles_released, small_batches, written

LENGTH = 35
SEED = 8
#: Odd multipliers of the two rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def packed(raw: bytes) -> bytes:
    """Compressed, with its length before it."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _keys(doc_id: int | None, raw: bytes) -> tuple[bytes, bytes]:
    """A key for the text, and one for the row: the text and its id."""
    key = hashlib.blake2b(raw, digest_size=16).digest()
    return key, hashlib.blake2b(key + str(doc_id).encode(), digest_size=16).digest()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2^64 of any stretch of words, from prefix sums."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(powers, dtype=np.uint64)[:n], dtype=np.uint64)])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[first]) * self.inverse[first] + (end - first).astype(np.uint64))


def anchors(hashes: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The seed-gram hashes and, for every window of ``length`` words, the position of its anchor."""
    n, span = len(hashes) - seed + 1, length - seed + 1
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n)
    grams = Rolling(hashes, _BASES[0]).of(at, at + seed)
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    own = np.empty(len(views), np.int64)
    for lo in range(0, len(views), 65_536):
        own[lo:lo + 65_536] = views[lo:lo + 65_536].argmin(1) + at[lo:lo + 65_536][: len(views) - lo]
    return grams, own


def runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window of each anchor and how many follow one another with it."""
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return first, np.diff(np.append(first, len(own)))


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _scan(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Per document: keys for its text and its row, its word count, the digest of all words, its anchors' hashes."""
    for b in batches:
        keys, rows, counts, digests, hashes = [], [], [], [], []
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
            raw = (t.as_py() or "").encode()
            words = raw.split()
            grams, own = anchors(word_hashes(words), length, seed)
            key, row = _keys(i, raw)
            keys.append(key)
            rows.append(row)
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            at = own[runs(own)[0]]
            hashes.append(grams[at].view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(rows, pa.binary()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), _list(hashes, pa.int64())], ["doc_id", "key", "row", "n_words", "all_sha256", "anchors"])


def _stretches(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The stretch of every seed: (row, copies, anchor, at, n, s1, s2), n windows from word ``at`` on."""
    for b in batches:
        for row, copies, seeds, t in zip(b.column("row").to_pylist(), b.column("copies").to_pylist(), b.column("seeds"), b.column("packed")):
            hashes = word_hashes(unpacked(t.as_py()).split())
            grams, own = anchors(hashes, length, seed)
            first, n = runs(own)
            hot = np.isin(grams[own[first]], seeds.values.to_numpy().view(np.uint64))
            first, n = first[hot], n[hot]
            s1, s2 = (Rolling(hashes, base).of(first, first + n + length - 1).view(np.int64) for base in _BASES)
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(first), pa.binary()), pa.array([copies] * len(first), pa.int64()), pa.array(grams[own[first]].view(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(s1), pa.array(s2)], ["row", "copies", "anchor", "at", "n", "s1", "s2"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The windows of chosen stretches: (row, weight, asks, at, h1, h2)."""
    for b in batches:
        for row, t, todo in zip(b.column("row").to_pylist(), b.column("packed"), b.column("todo").to_pylist()):
            hashes = word_hashes(unpacked(t.as_py()).split())
            rolls = [Rolling(hashes, base) for base in _BASES]
            for lo in range(0, len(todo), 4096):
                some = todo[lo:lo + 4096]
                n = np.array([x["n"] for x in some])
                at = np.repeat(np.array([x["at"] for x in some]) - np.cumsum(n) + n, n) + np.arange(n.sum())
                h1, h2 = (r.of(at, at + length).view(np.int64) for r in rolls)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(at), pa.binary()), pa.array(np.repeat([x["weight"] for x in some], n), pa.int64()), pa.array(np.repeat([x["asks"] for x in some], n), pa.bool_()), pa.array(at.astype(np.int32)), pa.array(h1), pa.array(h2)], ["row", "weight", "asks", "at", "h1", "h2"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, texts = [], []
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
            raw = (t.as_py() or "").encode()
            rows.append(_keys(i, raw)[1])
            texts.append(packed(raw))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(texts, pa.binary())], ["row", "packed"])


def repeated_windows(docs: DataFrame, scanned: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(texts, repeats): texts (row, key, packed) with seeds, and (row, found), the stretches
    of windows (struct at, n) of each that stand anywhere else too.

    ``docs`` (doc_id, text), ``scanned`` as from ``_scan``. A text held by several
    rows is looked at once, in one of them, and counts as often as it is held.
    """
    texts = saved(scanned.where("size(anchors) > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"), F.first("anchors").alias("anchors")))
    places = texts.select("row", "copies", F.explode("anchors").alias("anchor"))
    shared = saved(places.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"))
    seeds = saved(places.join(shared, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("seeds")))
    seeds = texts.select("row", "key", "copies").join(seeds, "row")
    held = written(docs.mapInArrow(_packed, "row binary, packed binary").join(seeds, "row").dropDuplicates(["row"]))

    found = written(held.mapInArrow(lambda it: _stretches(it, length, seed), "row binary, copies long, anchor long, at int, n int, s1 long, s2 long"))
    same = saved(found.groupBy("s1", "s2").agg(F.sum("copies").alias("m"), F.min("row").alias("one")).where("m > 1").select("s1", "s2", "one"))
    judged = written(found.join(same, ["s1", "s2"], "left"))
    settled, open_ = judged.where("one IS NOT NULL"), judged.where("one IS NULL")
    # Stretches that match no other whole: their windows, against those of one place of each settled stretch.
    asked = saved(open_.select("anchor").distinct())
    models = (settled.where("row = one").groupBy("s1", "s2", "row", "anchor", "n").agg(F.min("at").alias("at")).join(asked, "anchor")
              .select("row", "at", "n", F.lit(2).cast("long").alias("weight"), F.lit(False).alias("asks")))
    todo = open_.select("row", "at", "n", F.col("copies").alias("weight"), F.lit(True).alias("asks")).unionByName(models)
    todo = todo.groupBy("row").agg(F.collect_list(F.struct("at", "n", "weight", "asks")).alias("todo"))
    windows = written(held.select("row", "packed").join(saved(todo), "row").mapInArrow(lambda it: _windows(it, length), "row binary, weight long, asks boolean, at int, h1 long, h2 long"))
    twice = saved(windows.groupBy("h1", "h2").agg(F.sum("weight").alias("m"), F.max("asks").alias("asks")).where("m > 1 AND asks").select("h1", "h2"))
    more = windows.where("asks").join(twice, ["h1", "h2"]).select("row", F.struct("at", F.lit(1).alias("n")).alias("x"))
    repeats = settled.select("row", F.struct("at", "n").alias("x")).unionByName(more).groupBy("row").agg(F.collect_list("x").alias("found"))
    return held.select("row", "key", "packed"), repeats


def spans(found: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal repeats, as (first word, end), from stretches of repeated windows."""
    out: list[tuple[int, int]] = []
    for x in sorted(found, key=lambda x: x["at"]):
        first, end = x["at"], x["at"] + x["n"] - 1 + length
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _remove(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """What remains of texts with repeats: (key, n_removed, kept_sha256)."""
    for b in batches:
        removed, digests = [], []
        for found, t in zip(b.column("found").to_pylist(), b.column("packed")):
            words = unpacked(t.as_py()).split()
            kept, at = [], 0
            for first, end in spans(found, length):
                kept += words[at:first]
                at = end
            kept += words[at:]
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["key", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by a space)."""
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    with shuffles_released(docs.sparkSession):
        scanned = written(rows.mapInArrow(lambda it: _scan(it, length, seed), "doc_id long, key binary, row binary, n_words long, all_sha256 string, anchors array<bigint>"))
        texts, repeats = repeated_windows(rows, scanned, length, seed)
        left = saved(texts.join(saved(repeats), "row").mapInArrow(lambda it: _remove(it, length), "key binary, n_removed long, kept_sha256 string"))
    return (scanned.select("doc_id", "key", "n_words", "all_sha256").join(left, "key", "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256")))
