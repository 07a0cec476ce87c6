"""Byte-level BPE encoding and decoding over texts of any length.

A long text is dealt out as overlapping chunks. Every chunk is pre-tokenised on
its own, in parallel. Two neighbours are stitched where their pre-token
boundaries first agree inside the overlap: boundaries have no memory, so from
there on both go on alike. The pieces between stitches are then encoded, each
pre-token separately, and a document's ids are its pieces' ids in order.
Decoding concatenates the raw bytes of the ids.

A text of at most one chunk needs no stitching and is encoded where it is read;
only chunks of longer texts are shuffled.

Edge cases: a null text counts as empty (0 ids); equal rows give equal result
rows, as many as there were; null ids are kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablestats.llm.common import column, saved, small_batches
from tablestats.llm.pretokens import pretoken_ends, safe_cut

#: Characters in a chunk, and the least that neighbours share.
CHUNK, OVERLAP = 32_768, 512
#: A boundary this near the end of a chunk may change with the text after it.
MARGIN = 3
#: Pre-tokens above this many characters bypass the library's regex engine.
LONG_PRETOKEN = 100_000


@functools.lru_cache(2)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file (once per Python worker)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_piece(enc, text: str) -> np.ndarray:
    """Ids of a text that starts and ends at pre-token boundaries."""
    if len(text) <= LONG_PRETOKEN:
        return np.array(enc.encode_ordinary(text), np.uint32)
    out, at = [], 0
    ends = pretoken_ends(text)
    for i, end in enumerate(ends):
        if end - at > LONG_PRETOKEN:
            out += enc._encode_single_piece(text[at:end])
        elif i + 1 < len(ends) and ends[i + 1] - at <= LONG_PRETOKEN:
            continue
        else:
            out += enc.encode_ordinary(text[at:end])
        at = end
    return np.array(out, np.uint32)


def decode_ids(enc, ids: np.ndarray) -> bytes:
    return enc.decode_bytes(ids.tolist())


def chunk_bounds(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of overlapping chunks; each overlap holds a boundary that any tokenisation has.

    Such a boundary is what makes neighbours agree. Where none comes for long
    (one huge pre-token), the chunk grows up to the next.
    """
    at = 0
    while True:
        sure = safe_cut(text, at + size + overlap)
        end = min(len(text), sure + MARGIN + 1)
        yield at, end
        if end >= len(text):
            return
        at = max(at + size, sure - overlap)


def _split(batches: Iterator[pa.RecordBatch], path: str, pattern: str, size: int) -> Iterator[pa.RecordBatch]:
    """Short texts: their ids' digests. Longer ones: overlapping chunks."""
    enc = encoding(path, pattern)
    for batch in batches:
        out = []
        weight = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if len(text) <= size:
                ids = encode_piece(enc, text)
                out.append((doc_id, None, None, None, None, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode_ids(enc, ids)).hexdigest()))
            else:
                key = hashlib.sha256(text.encode()).hexdigest()
                for k, (start, end) in enumerate(chunk_bounds(text, size)):
                    out.append((doc_id, key, k, start, text[start:end], None, None, None))
                    weight += end - start
                    if weight > 4_000_000:
                        yield _rows(out, _SPLIT)
                        out, weight = [], 0
        yield _rows(out, _SPLIT)


_SPLIT = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("k", pa.int32()), ("start", pa.int64()), ("chunk", pa.string()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_SPLIT_DDL = "doc_id long, key string, k int, start long, chunk string, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-token boundaries of each chunk, as positions in the document."""
    for batch in batches:
        both = []
        for start, chunk in zip(batch.column("start").to_pylist(), batch.column("chunk").to_pylist()):
            ends = np.array([0, *pretoken_ends(chunk)], np.int64)
            both.append((start + ends[ends <= 2 * OVERLAP + MARGIN], start + ends[(ends >= len(chunk) - 2 * OVERLAP - MARGIN) & (ends <= len(chunk) - MARGIN)]))
        head, tail = (pa.array([x[i] for x in both], pa.list_(pa.int64())) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, head, tail], [*batch.schema.names, "head", "tail"])


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path, pattern)
    for batch in batches:
        rows = batch.to_pylist()
        ids = [encode_piece(enc, r["chunk"][r["first"] - r["start"]: None if r["next"] is None else r["next"] - r["start"]]).astype("<u4").tobytes() for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("k"), pa.array(ids, pa.binary())], ["doc_id", "key", "k", "ids"])


def _assemble(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Digests of whole documents from their pieces, which come in order; equal rows come side by side."""
    enc = encoding(path, pattern)
    now, copies, piece, n, ids_hash, decoded_hash = None, 0, -1, 0, None, None

    def done():
        return [(now[0], n, ids_hash.hexdigest(), decoded_hash.hexdigest())] * copies

    for batch in batches:
        out = []
        for doc_id, key, k, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "k", "ids"))):
            if (doc_id, key) != now:
                out += done() if now else []
                now, copies, piece, n, ids_hash, decoded_hash = (doc_id, key), 0, -1, 0, hashlib.sha256(), hashlib.sha256()
            copies += k == 0
            if k > piece:
                piece, n = k, n + len(ids) // 4
                ids_hash.update(ids)
                decoded_hash.update(decode_ids(enc, np.frombuffer(ids, "<u4")))
        yield _rows(out, _DIGESTS)
    if now:
        yield _rows(done(), _DIGESTS)


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_DIGESTS_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def long_pieces(parts: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, key, k, ids): the encoded pieces of the chunks in ``parts``."""
    chunks = parts.where("key IS NOT NULL").select("doc_id", "key", "k", "start", "chunk")
    read = saved(chunks.repartition("key", "k").mapInArrow(_boundaries, "doc_id long, key string, k int, start long, chunk string, head array<bigint>, tail array<bigint>"))
    one = read.groupBy("key", "k").agg(F.first("head").alias("head"), F.first("tail").alias("tail"))
    ahead = one.select("key", (F.col("k") - 1).alias("k"), F.col("head").alias("next_head"))
    stitch = one.join(ahead, ["key", "k"]).select("key", "k", F.array_min(F.array_intersect("tail", "next_head")).alias("cut"))
    # A chunk's piece goes from its stitch with the one before to that with the one after.
    cuts = (stitch.select("key", "k", F.lit(None).cast("long").alias("first"), F.col("cut").alias("next"))
            .unionByName(stitch.select("key", (F.col("k") + 1).alias("k"), F.col("cut").alias("first"), F.lit(None).cast("long").alias("next")))
            .groupBy("key", "k").agg(F.max("first").alias("first"), F.max("next").alias("next")))
    pieces = read.drop("head", "tail").join(cuts, ["key", "k"], "left").withColumn("first", F.coalesce("first", "start"))
    return pieces.mapInArrow(lambda it: _encode(it, path, pattern), "doc_id long, key string, k int, ids binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: n_tokens, and SHA-256 of its ids (little-endian
    unsigned 32-bit) and of the bytes decoded from them."""
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    # Written once: both kinds of row come from one pass over the texts.
    parts = saved(rows.mapInArrow(lambda it: _split(it, path, pattern, chunk), _SPLIT_DDL))
    short = parts.where("key IS NULL").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    whole = (long_pieces(parts, path, pattern).repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "k")
             .mapInArrow(lambda it: _assemble(it, path, pattern), _DIGESTS_DDL))
    return short.unionByName(whole)


def encode_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The ids themselves, in order of ``piece``: (doc_id, piece, ids array<int>); a text of one chunk has one piece."""
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))

    def ids_of(it):
        enc = encoding(path, pattern)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * b.num_rows, pa.int32()), pa.array([encode_piece(enc, t or "").astype(np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "piece", "ids"])

    def unpack(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in b.column("ids").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "piece", "ids"])

    small = F.coalesce(F.char_length("text"), F.lit(0)) <= chunk
    short = rows.where(small).mapInArrow(ids_of, "doc_id long, piece int, ids array<int>")
    parts = rows.where(~small).mapInArrow(lambda it: _split(it, path, pattern, chunk), _SPLIT_DDL)
    return short.unionByName(long_pieces(parts, path, pattern).mapInArrow(unpack, "doc_id long, piece int, ids array<int>"))
