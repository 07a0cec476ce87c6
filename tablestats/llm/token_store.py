"""Token ids as binary shards with Elias-Fano document boundaries.

Documents are tokenised in ascending id order, an end id is appended to each,
and the ids are written as shards in the shared folder; each range partition of
the ids writes its own shards, of about ``SHARD_IDS`` ids. A shard is one blob:

    magic "EFTS", format version, bytes per id (2 where the vocabulary allows,
    else 4), documents, documents without an id, ids, the smallest document id,
    ids written before it by its partition, byte lengths of the two sequences
    (all fixed-width little-endian);
    the document ids less the smallest, an Elias-Fano sequence;
    the end of each document in the id array, an Elias-Fano sequence;
    the id array.

An Elias-Fano sequence of n values up to u takes about 2 + log2(u / n) bits a
value: the low bits are packed, the high bits are set bits of a bit vector in
which the i-th value is the i-th set bit. ``select`` finds that bit from the
position of every 64th one, which is stored too, so the boundaries of any
document are read without a table of 64-bit offsets.

Blobs are rows of a Parquet folder, so any shared store works and a task that
runs twice leaves one copy.

Tokenising: texts are split into pre-tokens for a whole batch at once; each
distinct pre-token goes through the tokenizer once, and a bounded cache keeps
the ids from batch to batch. The tokenizer's added tokens (such as
``<|endoftext|>``) are found as the library finds them by default: a piece of text
that holds one goes to the library whole, and no text is cut inside one.

Edge cases: a null text is an empty one (just the end id); null ids come first;
repeated ids stay side by side, in order of their texts' hash; an empty table
gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablestats.llm.common import column, shuffle_partitions, small_batches, work_dir
from tablestats.llm.pretokens import code_points, safe_pieces, starts, uncertain

SHARD_IDS = 1_000_000
#: Characters worked on at once.
SLICE = 3_000_000
#: Distinct pre-tokens whose ids a Python worker keeps.
CACHED = 1_000_000
SAMPLE = 64
_HEAD = struct.Struct("<4sHHQQQqQQQ")
MAGIC, VERSION = b"EFTS", 1


class EliasFano:
    """A non-decreasing sequence of unsigned integers."""

    _SIZE = struct.Struct("<QBQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, int(math.log2(top // n))) if n and top >= n else 0
        low = np.zeros(0, np.uint8)
        if bits:
            shifts = np.arange(bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = ((values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32 if n and ones[-1] < 2**32 else np.uint64))

    def to_bytes(self) -> bytes:
        wide = self.samples.dtype == np.uint64
        return self._SIZE.pack(self.n, self.low_bits | (128 if wide else 0), len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, bits, low, high = cls._SIZE.unpack_from(raw)
        at = cls._SIZE.size
        return cls(n, bits & 127, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low),
                   np.frombuffer(raw, np.uint64 if bits & 128 else np.uint32, offset=at + low + high))

    def select(self, i: int) -> int:
        """Position of the i-th set bit of the high bits."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        bits = int(self.high[byte]) >> (at % 8)
        base = at
        while bits.bit_count() <= left:
            left -= bits.bit_count()
            byte += 1
            base, bits = byte * 8, int(self.high[byte])
        while True:
            if bits & 1:
                if not left:
                    return base
                left -= 1
            bits >>= 1
            base += 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = i * self.low_bits
        low = int.from_bytes(self.low[at // 8:(at + self.low_bits + 7) // 8].tobytes(), "little") >> at % 8 & (1 << self.low_bits) - 1
        return self.select(i) - i << self.low_bits | low

    def __len__(self) -> int:
        return self.n

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        out = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out


class Shard:
    """One blob: documents' ids and boundaries, and the token ids."""

    def __init__(self, blob: bytes):
        magic, version, self.width, self.n_docs, self.n_null, self.n_ids, self.base, self.before, a, b = _HEAD.unpack_from(blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard")
        at = _HEAD.size
        self.doc_ids, self.ends = EliasFano.from_bytes(blob[at:at + a]), EliasFano.from_bytes(blob[at + a:at + a + b])
        self.ids = np.frombuffer(blob, "<u2" if self.width == 2 else "<u4", self.n_ids, at + a + b)

    @staticmethod
    def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int, before: int) -> bytes:
        known = [x for x in doc_ids if x is not None]
        base = known[0] if known else 0
        a = EliasFano.of(np.array([x - base for x in known], np.uint64)).to_bytes()
        b = EliasFano.of(np.cumsum(lengths, dtype=np.uint64)).to_bytes()
        head = _HEAD.pack(MAGIC, VERSION, width, len(doc_ids), len(doc_ids) - len(known), len(ids), base, before, len(a), len(b))
        return head + a + b + ids.astype("<u2" if width == 2 else "<u4").tobytes()

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i starts and ends in the id array."""
        return self.ends[i - 1] if i else 0, self.ends[i]

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.ids[start:end]

    def find(self, doc_id: int) -> range:
        """The documents with this id: a binary search whose every step is one select."""
        if doc_id < self.base:
            return range(0)
        first = bisect.bisect_left(self.doc_ids, doc_id - self.base)
        return range(self.n_null + first, self.n_null + bisect.bisect_right(self.doc_ids, doc_id - self.base, lo=first))

    def all_ids(self) -> list[int | None]:
        return [None] * self.n_null + [self.base + int(x) for x in self.doc_ids.values()]


class PretokenEncoder:
    """Texts to ids, each distinct pre-token tokenised once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Literals that the library takes out of a text before it splits it, the longest first.
        self.added = tuple(sorted((t.content for t in added if t.content), key=len, reverse=True))
        #: Those of them that also look at, or take in, what is around them.
        self.wide = tuple(t.content for t in added if t.content and (t.lstrip or t.rstrip or t.single_word))
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(names.values()) + 1, np.int64)
        self.token_bytes[list(names.values())] = [len(x) for x in names]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size, self.first, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.used = 0

    def _tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens, and how many each has.

        Pre-tokens that split again the same way when written one after the other
        (a space and something after it) go to the tokenizer as one text; so do
        those without white space, with line breaks between. A token stands for
        as many bytes as its name has characters, which tells where each ends.
        """
        spaced, solid, rest = [], [], []
        for i, w in enumerate(words):
            (rest if w.isspace() or w[0] > 127 and w.decode().isspace() else spaced if w[0] == 0x20 else solid).append(i)
        joined = ["".join(words[i].decode() for i in spaced), "".join("\n" + words[i].decode() for i in solid)]
        if any(map(self._holds_added, joined)):  # an added token with a space or a line break in it
            joined, rest, spaced, solid = [], rest + spaced + solid, [], []
        order = spaced + [x for i in solid for x in (-1, i)] + rest
        ids: list[int] = []
        for text in (*joined, *(words[i].decode() for i in rest)):
            ids += self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        flat = np.array(ids, np.int32)
        ends = np.searchsorted(np.cumsum(self.token_bytes[flat]), np.cumsum([1 if i < 0 else len(words[i]) for i in order])) + 1
        sizes = np.diff(ends, prepend=0)
        own = np.array(order) >= 0
        flat = flat[np.repeat(own, sizes)]
        sizes = sizes[own]
        # Back to the order of the words.
        at = np.array([i for i in order if i >= 0])
        first = np.cumsum(sizes) - sizes
        by_word = np.empty(len(words), np.int64)
        by_word[at] = np.arange(len(words))
        sizes, first = sizes[by_word], first[by_word]
        ends = np.cumsum(sizes)
        return flat[np.repeat(first - (ends - sizes), sizes) + np.arange(len(flat))], sizes

    def _learn(self, words: list[bytes]) -> None:
        flat, sizes = self._tokens(words)
        n, total = len(self.known), int(sizes.sum())
        while n + len(words) > len(self.size):
            self.size, self.first = np.resize(self.size, 2 * len(self.size)), np.resize(self.first, 2 * len(self.first))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[n:n + len(words)] = sizes
        self.first[n:n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used:self.used + total] = flat
        self.used += total
        self.known.update(zip(words, range(n, n + len(words))))

    def _holds_added(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def _library(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _slice(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of non-empty pieces."""
        whole = [self._holds_added(p) for p in pieces]
        if any(whole):
            library = iter(self._library([p for p, w in zip(pieces, whole) if w]))
            others = [p for p, w in zip(pieces, whole) if not w]
            own = iter(self._slice(others) if others else ())
            return [next(library if w else own) for w in whole]
        text = "".join(pieces)
        points = code_points(text)
        if uncertain(points):
            return self._library(pieces)
        firsts = np.cumsum([0, *map(len, pieces[:-1])])
        at = np.flatnonzero(starts(points, firsts))
        raw = text.encode()
        if len(raw) == len(points):
            offsets = at
        else:
            width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            offsets = (np.cumsum(width, dtype=np.int64) - width)[at]
        offsets = np.append(offsets, len(raw)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > CACHED:
            self._forget()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            self._learn(new)
        which = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        sizes = self.size[which].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.first[which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        cuts = ends[np.searchsorted(at, firsts[1:]) - 1] if len(firsts) > 1 else []
        return np.split(ids, cuts)

    def _pieces(self, text: str) -> Iterable[str]:
        if len(text) > SLICE and any(x in text for x in self.wide):
            return (text,)
        return safe_pieces(text, SLICE, self.added)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        owners, pieces, weight = [], [], 0

        def flush() -> None:
            nonlocal owners, pieces, weight
            if pieces:
                for i, ids in zip(owners, self._slice(pieces)):
                    out[i].append(ids)
            owners, pieces, weight = [], [], 0

        for i, t in enumerate(texts):
            for p in self._pieces(t) if t else ():
                owners.append(i)
                pieces.append(p)
                weight += len(p)
                if weight >= SLICE:
                    flush()
        flush()
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.int32) for x in out]


@functools.lru_cache(2)
def encoder(path: str) -> PretokenEncoder:
    """One per Python worker, kept from task to task."""
    return PretokenEncoder(path)


_SHARDS = "part int, seq int, n_docs long, n_ids long, blob binary"


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    width = 2 if max(enc.vocabulary, end_id + 1) <= 1 << 16 else 4
    part, seq, before = TaskContext.get().partitionId(), 0, 0
    docs: list[int | None] = []
    lengths: list[int] = []
    ids: list[np.ndarray] = []
    held = 0

    def shard() -> pa.RecordBatch:
        nonlocal seq, before, docs, lengths, ids, held
        blob = Shard.pack(docs, lengths, np.concatenate(ids), width, before)
        row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "n_docs", "n_ids", "blob"])
        seq, before, docs, lengths, ids, held = seq + 1, before + held, [], [], [], 0
        return row

    for b in batches:
        for lo in range(0, b.num_rows, 512):
            some = b.slice(lo, 512)
            for doc_id, got in zip(some.column(0).to_pylist(), enc.encode([t or "" for t in some.column(1).to_pylist()])):
                docs.append(doc_id)
                lengths.append(len(got) + 1)
                ids += [got, np.array([end_id], np.int32)]
                held += len(got) + 1
                if held >= SHARD_IDS:
                    yield shard()
    if docs:
        yield shard()


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise ``docs`` into a store under ``folder`` (a shared one)."""
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    n = shuffle_partitions(docs.sparkSession)
    # The text's hash, so that the rows of one id are spread as well.
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(lambda it: _write(it, tokenizer_path, end_id), _SHARDS).write.mode("error").option("compression", "zstd").parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, blob in zip(b.column("part").to_pylist(), b.column("blob")):
            s = Shard(blob.as_py())
            ends = s.ends.values().astype(np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            wide = s.ids.astype("<u4")
            crc = [zlib.crc32(wide[x:y]) for x, y in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([part] * s.n_docs, pa.int32()), pa.array(s.all_ids(), pa.int64()), pa.array(begins + s.before), pa.array(ends - begins), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a store: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.parquet(folder)
    # One row per range partition: their number is the writer's setting, not the data's size.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return (shards.select("part", "blob").mapInArrow(_read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
            .join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def read_documents(spark: SparkSession, folder: str, doc_ids: Iterable[int]) -> DataFrame:
    """(doc_id, ids) of some documents of a store, their end ids included; one row for each time an id is stored.

    ``doc_ids`` is a list the caller holds; every task gets it. Nothing but the documents asked for is
    decoded: a shard's two sequences say by selects where they lie.
    """
    wanted = spark.sparkContext.broadcast(sorted({int(i) for i in doc_ids}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob"):
                s = Shard(blob.as_py())
                known = len(s.doc_ids)
                if not known:
                    continue
                low = bisect.bisect_left(wanted.value, s.base + s.doc_ids[0])
                high = bisect.bisect_right(wanted.value, s.base + s.doc_ids[known - 1])
                found = [(i, s.document(k)) for i in wanted.value[low:high] for k in s.find(i)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spark.read.parquet(folder).select("blob").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store under the shared checkpoint folder and read it back."""
    folder = work_dir(docs.sparkSession, "tokens") + "/store"
    write_store(docs, folder, tokenizer_path, end_id, id_col, text_col)
    return read_store(docs.sparkSession, folder)
