"""A hidden Markov language model of a corpus, and the exact likelihood of texts under it.

A text's tokens are its words, A-Z lower-cased, and one end. Every training token is counted;
the counts stay a distributed table that grows with the corpus. A state emits classes of
words. A word that makes up at least one in ``FREQUENT`` training tokens is a
class of its own, of which there can be at most ``FREQUENT``; any other word belongs to the class of its
ending, and is drawn within it by its own count: (c + 0.1) / (n + 0.1 (v + 1)) for a class with n tokens
and v words, the one word more standing for all that were not seen. So a word's probability in a state is
that of its class there times its own within the class. The second factor does not
depend on the state: only classes pass through the recursions, and a rare word's count is
joined in once.

Training is Baum-Welch. The training texts are laid side by side in blocks once, and written in that form.
In every round each task runs the scaled forward and backward
recursions over its blocks and sums the expected numbers of starts, transitions and
emissions; the tasks' sums are added by class in a shuffle, and the new probabilities, whose size
is bounded by the number of classes, are broadcast. The ``ROUNDS`` start from random
emissions, and each counts all training texts. Longer texts are trained on in segments of ``SEGMENT`` tokens; a segment that
goes on a text has a start distribution of its own. Texts are scored whole.

The likelihood is the forward recursion's: at every few tokens the state probabilities are
normalised, and the logarithms of the normalisers add up to the text's. Texts run side by
side, longest first, so that a step is one small matrix product for all of them.

Edge cases: a null or empty text is one end; a null id is not held out and trains; repeated rows
count each time; without training texts every word is unseen; an empty table gives an empty
result; other columns are ignored. A text's class numbers (four bytes a token) have to fit
in a task's memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestats.llm.common import column, small_batches, written

STATES = 8
FREQUENT = 1_000_000
#: Classes of other words, by a hash of their last characters.
ENDINGS, ENDING_CHARS = 4096, 3
#: Added to every count.
ADDED = 0.1
#: Tokens' worth of the corpus' own class frequencies added to every state's emissions.
PRIOR = 50.0
#: Rounds, each on all training texts, and a round's tasks.
ROUNDS, TASKS_PER_CORE = 14, 2
#: Tokens a round's task has at least, where there are several.
TASK_TOKENS = 3_000_000
SEGMENT = 2048
#: Tokens that run side by side, and distinct words a task counts before it passes them on.
BLOCK_TOKENS, HELD_WORDS = 300_000, 300_000
#: Blocks of tokens whose sequences are dealt out by length, and those that share a row and its list of classes.
HELD_BLOCKS, ROW_BLOCKS = 8, 2
#: Tokens between two normalisations, and the smallest sum that training may meet there (single precision ends at 1e-38).
SCALED_EVERY, SMALLEST = 4, 1e-18
#: Columns of one product in the sums of transitions, which are in the model's precision within it.
MOVE_TOKENS = 4_000
#: How the rows of blocks, of about a megabyte each, are written: in row groups of a few rows, as a reader holds one.
_ROWS_OF_BLOCKS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4", "parquet.enable.dictionary": "false"}
SEED = 7
#: Rows of a round's sums that are no classes: a state's transitions are at -1 - state.
_STARTS, _GOES_ON, _LOG = -1001, -1002, -1003


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of a batch of texts, without their ends: numbers into the list of different words, and where each text's begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at either end of a text leaves empty strings
    kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    coded = flat.filter(some).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), kept[offsets - offsets[0]], coded.dictionary


def ending_classes(found: pa.Array) -> np.ndarray:
    """Of every word the number of its ending's class."""
    coded = pc.utf8_slice_codeunits(found, -ENDING_CHARS).dictionary_encode()
    own = np.array([zlib.crc32(x.encode()) % ENDINGS for x in coded.dictionary.to_pylist()], np.int32)
    return own[coded.indices.to_numpy(zero_copy_only=False)]


class Classes(NamedTuple):
    """What the corpus' counts say about classes: those of the frequent words ``own``, in their order, then those of endings."""

    own: pa.Array
    counts: np.ndarray  # of the frequent words
    tokens: int
    types: int
    logs: np.ndarray  # per class, the part of a word's log10 probability within it that all its words share
    share: np.ndarray  # per class, its share of all tokens

    @property
    def log_total(self) -> float:
        return float(np.log10(self.tokens + ADDED * (self.types + 1)))


class Model(NamedTuple):
    emit: np.ndarray  # classes x states
    move: np.ndarray  # from state x to state
    start: np.ndarray  # at the start of a text, at that of a later segment


def _held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            numbers, _, found = words(b.column(0))
            counts = np.append(np.bincount(numbers, minlength=len(found)), b.num_rows)
            held.append(pa.table({"word": pa.concat_arrays([found, pa.array([""], found.type)]), "c": counts}))
            if sum(map(len, held)) > 2 * HELD_WORDS:
                held = [_added(held)]
                if len(held[0]) > HELD_WORDS:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from _added(held).filter(pc.field("c") > 0).to_batches()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _added(held: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
    return both.rename_columns(["word", "c"] if both.column_names[0] == "word" else ["c", "word"]).select(["word", "c"])


def classes(counts: DataFrame) -> Classes:
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    own = F.expr(f"c >= {tokens / FREQUENT}D OR word = ''")
    found = counts.where(own).select("word", "c").toArrow()  # at most FREQUENT words and the end
    found = found.sort_by("word")
    ending = F.pmod(F.crc32(F.encode(F.right("word", F.lit(ENDING_CHARS)), "utf-8")), F.lit(ENDINGS)).alias("k")
    mass = np.full(ENDINGS, ADDED)
    for k, c, v in counts.where(~own).groupBy(ending).agg(F.sum("c"), F.count(F.lit(1))).collect():
        mass[k] += c + ADDED * v
    c = found.column("c").to_numpy()
    share = np.concatenate([c + ADDED, mass])
    return Classes(pa.array(found.column("word").to_pylist(), pa.string()), c, tokens, types, np.concatenate([np.zeros(len(c)), -np.log10(mass)]), share / share.sum())


def encode(docs: DataFrame, known: Classes) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, n_known, base, classes, rare, times) from (doc_id, held_out, text).

    ``n_known`` and ``base`` count the frequent words only; the others are in ``rare``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs = shared.value.own, np.log10(shared.value.counts + ADDED)
        for b in batches:
            n = b.num_rows
            codes, offsets, found = words(b.column("text"))
            found = pa.concat_arrays([found, pa.array([""], found.type)])
            # Every text's words, then its end.
            ends = offsets + np.arange(n + 1)
            tokens = np.full(ends[-1], len(found) - 1, np.int64)
            at_word = np.ones(len(tokens), bool)
            at_word[ends[1:] - 1] = False
            tokens[at_word] = codes
            text = np.repeat(np.arange(n), np.diff(ends))
            number = pc.index_in(found, own.cast(found.type)).fill_null(-1).to_numpy(zero_copy_only=False)
            number = np.where(number < 0, len(own) + ending_classes(found), number).astype(np.int32)
            seq = number[tokens]
            frequent = seq < len(own)
            known = np.bincount(text[frequent], minlength=n)
            base = np.bincount(text[frequent], logs[seq[frequent]], n).astype(np.float64)
            # Rare words of a text, each once, with how often they occur.
            pairs, times = np.unique(text[~frequent] * len(found) + tokens[~frequent], return_counts=True)
            whose, which = np.divmod(pairs, len(found))
            lists = pa.array(np.searchsorted(whose, np.arange(n + 1)), pa.int32())
            rare = found.take(pa.array(which)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([
                b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(ends)), pa.array(known), pa.array(base),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(seq)), pa.ListArray.from_arrays(lists, rare), pa.ListArray.from_arrays(lists, pa.array(times)),
            ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "classes", "rare", "times"])

    return rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, classes array<int>, rare array<string>, times array<long>")


class Packed(NamedTuple):
    """Sequences side by side, longest first: the tokens of step t are those from ends[t - 1] to ends[t]."""

    order: np.ndarray
    tokens: np.ndarray
    ends: list[int]


def pack(seqs: list[np.ndarray]) -> Packed:
    lengths = np.array([len(s) for s in seqs])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    flat = np.concatenate([seqs[i] for i in order])
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends = np.cumsum(np.bincount(step))
    # A step's tokens stand in the sequences' order, since those that have ended are the last.
    tokens = np.empty_like(flat)
    tokens[np.concatenate([[0], ends[:-1]])[step] + np.repeat(np.arange(len(seqs)), lengths)] = flat
    return Packed(order, tokens, ends.tolist())


def log_likelihoods(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of each sequence's probability."""
    p = pack(seqs)
    logs = np.zeros(len(seqs))
    # A row per state, as in ``recursions``.
    emits, forward = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    state, at, held, first = None, 0, None, 0
    for t, end in enumerate(p.ends, 1):
        if held is None or end > first + held.shape[1]:  # emissions for some steps at a time
            first = at
            held = emits.take(p.tokens[at:max(end, at + BLOCK_TOKENS // 4)], axis=1)
        n = end - at
        after = p.ends[t] - end if t < len(p.ends) else 0  # sequences that go on
        state = held[:, at - first:end - first] * (model.start[0][:, None] if state is None else forward @ state[:, :n])
        done = 0 if t % SCALED_EVERY == 0 else after
        if done < n:
            scale = state[:, done:].sum(0)
            state[:, done:] /= scale
            logs[done:n] += np.log10(scale)
        at = end
    out = np.empty(len(seqs))
    out[p.order] = logs
    return out


def room_for(tokens: int, states: int, kind: type = np.float64) -> np.ndarray:
    """Working space of ``expected``, to be used block after block."""
    return np.empty((3, tokens * states), kind)


def expected(seqs: list[np.ndarray], later: np.ndarray, model: Model, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected state probabilities of the tokens with their classes, transitions, the two kinds of starts, and the log10 likelihood.

    In the precision of ``model``. ``later``: 1 for sequences that go on a text, else 0. What comes back may lie in ``room``.
    """
    p = pack(seqs)
    emits, peaks = peaked(model.emit.T)
    ahead, after, moves, begin, log = recursions(p.tokens, p.ends, later[p.order], model, emits, room)
    return p.tokens, np.multiply(ahead, after, out=after).T, moves, begin, log + float(np.log10(peaks)[p.tokens].sum())


def peaked(emits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions, a row per state, over each class's largest, and those in double precision."""
    peaks = emits.max(0)
    return np.ascontiguousarray(emits / peaks), peaks.astype(np.float64)


def recursions(tokens: np.ndarray, ends: list[int], later: np.ndarray, model: Model, emits: np.ndarray, room: np.ndarray | None = None,
               every: int = SCALED_EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Of packed sequences, two factors of the state probabilities (a row per state), the transitions, the two kinds of starts, and the log10 likelihood.

    ``tokens`` number the columns of ``emits``, as ``peaked`` makes them; ``later`` is in the packed order. State
    probabilities are normalised at every ``every``-th token; should they become small between, at every token.
    """
    n, size = len(model.move), len(tokens)
    if room is None or room.shape[1] < n * size:
        room = room_for(size, n, emits.dtype)
    # One row per state: a step's part of each row lies side by side.
    emit, ahead, after = (x[:n * size].reshape(n, size) for x in room)
    np.take(emits, tokens, axis=1, out=emit, mode="clip")
    starts, scales = [0, *ends[:-1]], []
    forward = np.ascontiguousarray(model.move.T)
    ahead[:, :ends[0]] = model.start[later].T
    before = 0
    for t, (a, b) in enumerate(zip(starts, ends), 1):
        state, own = ahead[:, a:b], emit[:, a:b]
        if a:
            np.matmul(forward, ahead[:, before:before + b - a], state)
        np.multiply(state, own, state)
        if t % every == 0:
            total = np.add.reduce(state, 0)
            np.divide(state, total, state)
            np.divide(own, total, own)
            scales.append(total)
        before = a
    # The last tokens of sequences: the longest is the first.
    widths = np.diff(ends, prepend=0)
    ended = widths - np.append(widths[1:], 0)
    last = np.repeat(np.array(ends) - widths, ended) + np.arange(widths[0])[::-1]
    whole = ahead[:, last].sum(0)
    scales = np.concatenate([*scales, whole])
    if every > 1 and not scales.min() > SMALLEST:
        return recursions(tokens, ends, later, model, emits, room, 1)
    # Per token, its emission times what follows; after is that passed to the token before.
    after[:, last] = 1 / whole
    for t in range(len(ends) - 1, 0, -1):
        a, b, before = starts[t], ends[t], starts[t - 1]
        follows = emit[:, a:b]
        np.multiply(follows, after[:, a:b], follows)
        np.matmul(model.move, follows, after[:, before:before + b - a])
    moves = np.zeros((n, n))
    # Within a run of steps of one width, the token before lies that width before: one product for many steps.
    cuts = [1, *(np.flatnonzero(np.diff(widths[1:])) + 2).tolist(), len(widths)]
    for lo, hi in zip(cuts, cuts[1:]):
        if lo < hi:
            a, b, before, w = starts[lo], ends[hi - 1], starts[lo - 1], int(widths[lo])
            moves += ahead[:, before:before + w] @ emit[:, a:a + w].T
            for c in range(a, b - w, MOVE_TOKENS):
                d = min(b - w, c + MOVE_TOKENS)
                moves += ahead[:, c:d] @ emit[:, c + w:d + w].T
    moves *= model.move
    first = ahead[:, :ends[0]] * after[:, :ends[0]]
    begin = np.array([first[:, later == k].sum(1) for k in (0, 1)])
    return ahead, after, moves, begin, float(np.log10(scales).sum(dtype=np.float64))


def _blocks(batches: Iterator[pa.RecordBatch], name: str, segment: int | None) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Sequences of about BLOCK_TOKENS tokens with, for each, whether it goes on a text.

    A few blocks' sequences are dealt out by length, so that those of a block end at about the same step.
    """
    seqs, later, count = [], [], 0

    def dealt() -> Iterator[tuple[list[np.ndarray], list[int]]]:
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        first, size = 0, 0
        for at, i in enumerate(order, 1):
            size += len(seqs[i])
            if size >= BLOCK_TOKENS or at == len(order):
                yield [seqs[j] for j in order[first:at]], [later[j] for j in order[first:at]]
                first, size = at, 0

    for b in batches:
        lists = b.column(name)
        flat, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        at = 0
        for n in ends.tolist():
            for k in range(0, n, segment or n):
                seqs.append(flat[at + k:at + min(n, k + (segment or n))])
                later.append(int(k > 0))
                count += len(seqs[-1])
            at += n
        if count >= HELD_BLOCKS * BLOCK_TOKENS:
            yield from dealt()
            seqs, later, count = [], [], 0
    yield from dealt()


def packed(encoded: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows of some blocks of the sequences in ``encoded``, as arrays in bytes.

    ``classes``: those in the row, the most frequent first; ``tokens``: their numbers in that list, block by block in packed order;
    ``widths``: of every step its tokens; ``steps``: of every block its steps; ``later``: of every sequence whether it goes on a text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Packed, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            tokens = np.concatenate([p.tokens for p, _ in held])
            counts = np.bincount(tokens)
            found = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)]
            place = np.zeros(len(counts), np.uint16 if len(found) <= 1 << 16 else np.uint32)
            place[found] = np.arange(len(found))
            widths = [np.diff(p.ends, prepend=0) for p, _ in held]
            parts = [found.astype(np.int32), place[tokens], np.concatenate(widths).astype(np.int32), np.array([len(x) for x in widths], np.int32),
                     np.concatenate([x for _, x in held]).astype(np.int8)]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["classes", "tokens", "widths", "steps", "later"])

        for seqs, later in _blocks(batches, "classes", segment):
            p = pack(seqs)
            held.append((p, np.array(later)[p.order]))
            if len(held) == ROW_BLOCKS:
                yield row()
                held.clear()
        if held:
            yield row()

    return encoded.select("classes").mapInArrow(run, "classes binary, tokens binary, widths binary, steps binary, later binary")


def sums(encoded: DataFrame, model: Model, segment: int = SEGMENT) -> DataFrame:
    """(class, s0, s1, ...): a round's expected counts, added up over the tasks."""
    return _sums(packed(encoded, segment), model, segment)


def _sums(blocks: DataFrame, model: Model, segment: int = SEGMENT) -> DataFrame:
    # State by state in memory, as the recursions read it; they add and multiply nothing but
    # positive numbers scaled at every token, so single precision does. The sums are double.
    shared = blocks.sparkSession.sparkContext.broadcast(Model(*[np.asfortranarray(x, np.float32) for x in model]))
    n = len(model.move)
    names = [f"s{i}" for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        emits, moves, begins, log = np.zeros((n, len(m.emit))), np.zeros((n, n)), np.zeros((2, n)), 0.0
        room, fine = room_for(BLOCK_TOKENS + segment, n, m.emit.dtype), np.empty(BLOCK_TOKENS + segment)
        for b in batches:
            for i in range(b.num_rows):
                read = lambda name, kind: np.frombuffer(b.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                found, widths, later = read("classes", np.int32), read("widths", np.int32), read("later", np.int8)
                tokens = read("tokens", np.uint16 if len(found) <= 1 << 16 else np.uint32)
                (known, peaks), own = peaked(m.emit.T[:, found]), np.zeros((n, len(found)))
                log += float(np.bincount(tokens, minlength=len(found)) @ np.log10(peaks))
                step = token = text = 0
                for steps in read("steps", np.int32).tolist():
                    ends = np.cumsum(widths[step:step + steps]).tolist()
                    codes = tokens[token:token + ends[-1]].astype(np.intp)
                    ahead, after, move, begin, likelihood = recursions(codes, ends, later[text:text + ends[0]], m, known, room)
                    seen = fine[:len(codes)]
                    for s in range(n):
                        part = np.bincount(codes, np.multiply(ahead[s], after[s], out=seen))
                        own[s, :len(part)] += part
                    moves += move
                    begins += begin
                    log += likelihood
                    step, token, text = step + steps, token + ends[-1], text + ends[0]
                emits[:, found] += own
        held = np.flatnonzero(emits.any(0))
        keys = [*(-1 - np.arange(n)), _STARTS, _GOES_ON, _LOG, *held]
        rows = np.concatenate([moves, begins, [[log] + [0.0] * (n - 1)], emits[:, held].T])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(rows[:, s]) for s in range(n)]], ["class", *names])

    parts = blocks.mapInArrow(run, "class int, " + ", ".join(f"{x} double" for x in names))
    return parts.groupBy("class").agg(*[F.sum(x).alias(x) for x in names])


def fitted(rows: pa.Table, share: np.ndarray, n: int) -> tuple[Model, float]:
    """The model that a round's sums give (one row per class that was seen), and the log10 likelihood of the model before."""
    keys, values = rows.column("class").to_numpy(), np.column_stack([rows.column(f"s{s}").to_numpy() for s in range(n)])
    other = {int(k): v for k, v in zip(keys[keys < 0], values[keys < 0])}
    emits = np.zeros((len(share), n))
    emits[keys[keys >= 0]] = values[keys >= 0]
    moves, begins, log = np.stack([other[-1 - s] for s in range(n)]), np.stack([other[_STARTS], other[_GOES_ON]]), float(other[_LOG][0])
    emit = (emits + PRIOR * share[:, None]) / (emits.sum(0) + PRIOR)
    return Model(emit, (moves + 1) / (moves.sum(1, keepdims=True) + n), (begins + 1) / (begins.sum(1, keepdims=True) + n)), log


def first_model(share: np.ndarray, n: int) -> Model:
    noise = np.random.default_rng(SEED).exponential(size=(len(share), n)) ** 2 + 0.05
    emit = share[:, None] * noise
    return Model(emit / emit.sum(0), np.full((n, n), 0.1 / n) + 0.9 * np.eye(n), np.full((2, n), 1 / n))


def train(encoded: DataFrame, known: Classes, states: int = STATES, sample_rounds: int = 0, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """A model of the sequences in ``encoded`` and the log10 likelihoods before each round.

    Every round counts all sequences; ``sample_rounds``, from when the first rounds took a sample, are further rounds.
    """
    model, logs = first_model(known.share, states), []
    if encoded.isEmpty():
        return model, logs
    # A task's sums are as large as the classes it met, however few its texts: some tasks per core are enough, fewer for few texts.
    parts = min(TASKS_PER_CORE * encoded.sparkSession.sparkContext.defaultParallelism, known.tokens // TASK_TOKENS)
    blocks = written(packed(encoded.coalesce(max(1, parts))), **_ROWS_OF_BLOCKS).coalesce(max(1, parts))
    for _ in range(sample_rounds + rounds):
        model, log = fitted(_sums(blocks, model).toArrow(), known.share, states)
        logs.append(log)
    return model, logs


def _scored(encoded: DataFrame, model: Model, known: Classes) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, n_known, base, hidden): hidden leaves out the counts of rare words."""
    shared = encoded.sparkSession.sparkContext.broadcast((model._replace(emit=np.asfortranarray(model.emit)), known.logs))
    plain = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, logs = shared.value
        for b in batches:
            lists = b.column("classes")
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            own = np.concatenate([[0.0], np.cumsum(logs[flat])])
            hidden = log_likelihoods([flat[i:j] for i, j in zip(offsets, offsets[1:])], m) + np.diff(own[offsets]) if len(b) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in plain], pa.array(hidden)], [*plain, "hidden"])

    return encoded.select(*plain, "classes").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, hidden double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    doc_id = column(docs, id_col).cast("long")
    texts = docs.select(doc_id.alias("doc_id"), _held_out(doc_id).alias("held_out"), column(docs, text_col).cast("string").alias("text"))
    counts = written(count_words(texts.where("NOT held_out")))
    known = classes(counts)
    encoded = written(encode(texts, known))
    model, _ = train(encoded.where("NOT held_out"), known, states)
    scored = written(_scored(encoded, model, known))
    # The counts of rare words, one row per document and word.
    pairs = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rare = pairs.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + ADDED)).alias("logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("seen"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(known.log_total)).alias("base_score"), (F.col("hidden") + logs).alias("score"))
