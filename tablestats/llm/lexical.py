"""Ranked lexical search by presence masks.

Terms are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z
lower-cased. A document's score for an item sums, over the item's terms with
repeats, the term's weight times a saturating function of how often the document
holds it, discounted by the document's length; everything but the weight's
logarithm is integer arithmetic, so scores are the same on any cluster.

Items are a query set, taken in blocks of bounded size; documents are never
collected. For a block of items, one pass over the documents keeps what each holds
of the block's terms, and counts documents, terms and document frequencies. A second
pass takes these postings in runs of documents. For each item, a run's documents
get a mask with one bit per distinct term of the item, set from the terms' document
lists, and are grouped by mask. A mask's maximum is the sum of what its terms give
at most in the run. Masks are evaluated by descending maximum, all documents
of a mask at once, until the next maximum is below the item's last place; a maximum
equal to it is still evaluated, as its documents may have smaller ids. Each task so
gives at most ``top`` documents per item, of which the first ``top`` stay.

Edge cases: null and term-less texts are no documents (they count nowhere); null or
term-less items give no rows; repeated documents and repeated items count
each; documents with a null id come last among equal scores; empty tables give an
empty result; other columns are ignored. An item or a document has to fit in a
task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablestats.llm.common import column, small_batches, work_dir, written

TOP = 10
#: Bytes of item texts in a block.
BLOCK_BYTES = 1 << 20
#: Documents, and postings, after which a run ends.
RUN_DOCS, RUN_HITS = 16_384, 2_000_000
#: Documents evaluated before the maxima are looked at again.
STEP = 64

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RESULT = "item int, item_id long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple]]:
    """(number, id, terms) of the items, in lists of about ``size`` bytes of text."""
    block, weighs = [], 0
    rows = items.select(column(items, id_col).cast("long"), column(items, text_col).cast("string"))
    for number, (item_id, text) in enumerate(rows.toLocalIterator()):
        found = terms(text)
        if not found:
            continue
        if block and weighs + len(text) > size:
            yield block
            block, weighs = [], 0
        block.append((number, item_id, found))
        weighs += len(text)
    if block:
        yield block


def _postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs): a document's number of terms, and its terms of ``vocabulary`` with their counts."""
    spark = docs.sparkSession
    small_batches(spark)
    words = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = words.value.get
        for b in batches:
            ns, ends, ids, tfs = [], [0], [], []
            for text in b.column("text"):
                found = terms(text.as_py())
                hits, counts = np.unique(np.array([i for i in map(number, found) if i is not None], np.int32), return_counts=True)
                ns.append(len(found))
                ends.append(len(hits))
                ids.append(hits)
                tfs.append(counts)
            offsets = pa.array(list(accumulate(ends)), pa.int32())
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(ns, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(flat[0], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(flat[1], pa.int64())),
            ], ["doc_id", "n", "ids", "tfs"])

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, hits = [], 0, 0
    for b in batches:
        held.append(b)
        docs += len(b)
        hits += len(b.column("ids").flatten())
        if docs >= RUN_DOCS or hits >= RUN_HITS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, hits = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Run:
    """Postings of a run of documents: per term, its documents in order and what it gives each before weighing."""

    def __init__(self, table: pa.Table, n_docs: int, n_terms: int, vocabulary: int):
        ids = table.column("doc_id").combine_chunks()
        self.null = np.asarray(ids.is_null())
        self.doc_id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.size = len(self.null)
        lists = table.column("ids").combine_chunks()
        doc = np.repeat(np.arange(self.size), np.diff(lists.offsets.to_numpy()))
        term = lists.flatten().to_numpy()
        tf = table.column("tfs").combine_chunks().flatten().to_numpy()
        # Whole numbers of any size: n times n_docs may pass 64 bits.
        m = np.array([25 + 75 * n * n_docs // n_terms for n in table.column("n").to_pylist()] if n_terms else [0] * self.size, np.int64)
        gives = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.docs, self.gives = doc[order], gives[order]
        self.starts = np.searchsorted(term[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.gives, self.starts[held])

    def of(self, term: int) -> slice:
        return slice(self.starts[term], self.starts[term + 1])


def masks(run: Run, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The run's documents with any term of ``item`` grouped by mask: masks as rows of 0 and 1, documents ordered by mask, starts of the masks' documents."""
    words = np.zeros((run.size, -(-len(item) // 64)), np.uint64)
    for bit, term in enumerate(item):
        words[run.docs[run.of(term)], bit // 64] |= np.uint64(1 << bit % 64)
    held = np.flatnonzero(words.any(1))
    words = words[held]
    order = np.lexsort(words.T) if len(held) else np.empty(0, np.int64)
    words = words[order]
    starts = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(1)])) if len(held) else order
    bits = np.unpackbits(words[starts].astype("<u8").view(np.uint8).reshape(len(starts), -1), axis=1, bitorder="little")[:, :len(item)]
    return bits, held[order], np.append(starts, len(held))


def search_run(run: Run, item: np.ndarray, weights: np.ndarray, best: list[tuple], top: int) -> list[tuple]:
    """``best`` (entries (-score, id is null, doc_id), sorted) with what the run's documents add to it."""
    most = weights * run.most[item]
    item, weights, most = item[most > 0], weights[most > 0], most[most > 0]
    if not len(item) or len(best) == top and most.sum() < -best[-1][0]:
        return best
    bits, docs, starts = masks(run, item)
    maxima = bits.astype(np.int64) @ most
    order = np.argsort(-maxima, kind="stable")
    at = 0
    while at < len(order) and (len(best) < top or maxima[order[at]] >= -best[-1][0]):
        # A step: the next masks, as long as they may matter, with about STEP documents.
        chosen, count = [], 0
        while at < len(order) and count < STEP and (len(best) < top or maxima[order[at]] >= -best[-1][0]):
            g = order[at]
            chosen.append(docs[starts[g]:starts[g + 1]])
            count += len(chosen[-1])
            at += 1
        taken = np.sort(np.concatenate(chosen))
        scores = np.zeros(len(taken), np.int64)
        for term, w in zip(item, weights):
            own = run.docs[run.of(term)]
            place = np.searchsorted(own, taken)
            has = place < len(own)
            has[has] = own[place[has]] == taken[has]
            scores[has] += w * run.gives[run.of(term)][place[has]]
        stay = scores > 0 if len(best) < top else scores >= max(1, -best[-1][0])
        taken, scores = taken[stay], scores[stay]
        first = np.lexsort((run.doc_id[taken], run.null[taken], -scores))[:top]
        best = sorted(best + list(zip((-scores[first]).tolist(), run.null[taken[first]].tolist(), run.doc_id[taken[first]].tolist())))[:top]
    return best


def _ranked(postings: DataFrame, block: list[tuple], vocabulary: dict[bytes, int], top: int) -> DataFrame:
    """(item, item_id, doc_id, score): the first ``top`` of each task for every item of the block."""
    spark = postings.sparkSession
    n_docs, n_terms = postings.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, count in postings.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator():  # one row per term of the block
        df[term] = count
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    queries = []
    for number, item_id, found in block:
        ids, repeats = np.unique([vocabulary[t] for t in found], return_counts=True)
        queries.append((number, item_id, ids, repeats * weights[ids]))
    asked, size = spark.sparkContext.broadcast(queries), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked.value]
        for table in _runs(batches):
            here = Run(table, n_docs, n_terms, size)
            best = [search_run(here, ids, w, b, top) for (_, _, ids, w), b in zip(asked.value, best)]
        rows = [(number, item_id, None if null else doc_id, -score) for (number, item_id, _, _), b in zip(asked.value, best) for score, null, doc_id in b]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["item", "item_id", "doc_id", "score"])

    return postings.select("doc_id", "n", "ids", "tfs").mapInArrow(run, _RESULT)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
           top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of every item."""
    spark = docs.sparkSession
    folder, blocks = work_dir(spark, "search"), 0
    for block in _blocks(items, item_id_col, item_text_col, block_bytes):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, found in block for t in found}))}
        postings = written(_postings(docs, id_col, text_col, vocabulary))
        _ranked(postings, block, vocabulary, top).write.parquet(f"{folder}/{blocks}")
        blocks += 1
    found = spark.read.schema(_RESULT).parquet(*[f"{folder}/{k}" for k in range(blocks)]) if blocks else spark.createDataFrame([], _RESULT)
    best = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # Tasks' lists are cut in two steps, so that no task reads those of all tasks.
    some = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*best)
    of_item = Window.partitionBy("item").orderBy(*best)
    cut = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    return cut.withColumn("rank", F.row_number().over(of_item)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
