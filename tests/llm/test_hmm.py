import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablestats.llm import hmm


def model_of(classes, states, seed=0):
    rng = np.random.default_rng(seed)
    unit = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(unit(rng.random((classes, states)) + 0.01, 0), unit(rng.random((states, states)), 1), unit(rng.random((2, states)), 1))


def by_paths(seq, model, k=0):
    """Probability, expected states and moves over all state paths."""
    n = len(model.move)
    total, seen, moves = 0.0, np.zeros((len(seq), n)), np.zeros((n, n))
    for path in itertools.product(range(n), repeat=len(seq)):
        p = model.start[k][path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        total += p
        for t, s in enumerate(path):
            seen[t, s] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
    return total, seen / total, moves / total


@pytest.mark.parametrize("texts", [[], [None], ["", " \t\n\x0b\x0c\r "], ["A b  a\x0bB ", None, "É é\u00a0x\u2003y\x1cz ÀA", "a" * 10_000, "  B"], ["one"]])
def test_words(texts):
    codes, offsets, found = hmm.words(pa.array(texts, pa.string()))
    found = [w.encode() for w in found.to_pylist()]
    assert len(set(found)) == len(found) and len(offsets) == len(texts) + 1
    got = [[found[c] for c in codes[i:j]] for i, j in zip(offsets, offsets[1:])]
    assert got == [(t or "").encode().lower().split() for t in texts]


SEQS = [np.array(x, np.int32) for x in ([0], [3, 1, 2], [1, 1, 4, 0, 2], [2, 0], [4, 3, 2, 1, 0, 1])]


def test_forward_is_the_sum_over_all_paths(monkeypatch):
    model = model_of(5, 3)
    want = [math.log10(by_paths(s, model)[0]) for s in SEQS]
    assert np.allclose(hmm.log_likelihoods(SEQS, model), want, rtol=1e-12)
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 4)  # emissions a step or so at a time
    assert np.allclose(hmm.log_likelihoods(SEQS, model), want, rtol=1e-12)


def test_expected_counts_are_those_over_all_paths():
    model, later = model_of(5, 3), np.array([0, 1, 0, 1, 0])
    tokens, seen, moves, begin, log = hmm.expected(SEQS, later, model)
    slow = [by_paths(s, model, k) for s, k in zip(SEQS, later)]
    assert math.isclose(log, sum(math.log10(x[0]) for x in slow))
    assert np.allclose(moves, sum(x[2] for x in slow))
    for k in (0, 1):
        assert np.allclose(begin[k], sum(x[1][0] for x, l in zip(slow, later) if l == k))
    for c in range(5):
        assert np.allclose(seen[tokens == c].sum(0), sum(x[1][s == c].sum(0) for x, s in zip(slow, SEQS)))


def test_long_sequences_do_not_underflow():
    model = model_of(50, 4)
    seq = np.random.default_rng(1).integers(0, 50, 200_000).astype(np.int32)
    alone = hmm.log_likelihoods([seq], model)[0]
    assert -400_000 < alone < -200_000
    assert math.isclose(hmm.log_likelihoods([SEQS[1], seq, SEQS[1]], model)[1], alone, rel_tol=1e-12)


A, B = ["red", "green", "blue", "grey"], ["uno", "dos", "tres", "cuatro"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        side = A if i % 2 else B
        text = " ".join(rng.choice(side) for _ in range(rng.choice([3, 12, 30])))
        rows.append((i, text + (f" rare{i}ing" if i % 3 == 0 else " ÉTÉ\n")))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, row int").repartition(3)
    got = hmm.score(df)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def brute_base(rows):
    def tokens(t):
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (t or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w] + [""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted([(i, held(i), len(x := tokens(t)), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) for i, t in rows], key=str)


def test_query_against_brute_force_and_better_than_words_alone(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 200)  # so that some words are rare
    rows = corpus(300) + [(None, "red red"), (900, None), (901, ""), (901, ""), (902, "zzz ÉTÉ été\x0bZZZ"), (903, "red uno " * 30_000)]
    got, want = run(spark, rows), brute_base(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    held = [r for r in got if r[1] and r[0] < 300]
    assert len(held) > 15
    gain = sum(r[6] - r[5] for r in held) / sum(r[2] for r in held)
    assert gain > 0.2  # two vocabularies of equal size: 0.3 at best


def test_probabilities_of_all_texts_add_up_to_one(spark, monkeypatch):
    """Over all words, and one unseen word per ending, every state's emissions add up to one."""
    monkeypatch.setattr(hmm, "FREQUENT", 100)
    df = spark.createDataFrame(corpus(120), "doc_id long, text string").withColumn("held_out", F.lit(False))
    counts = hmm.count_words(df)
    known = hmm.classes(counts)
    model, logs = hmm.train(hmm.encode(df, known), known, states=3, sample_rounds=3, rounds=2)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and np.allclose(model.start.sum(1), 1)
    own = set(known.own.to_pylist())
    rare = [(r["word"], r["c"]) for r in counts.collect() if r["word"] not in own]
    assert rare and "" in own
    mass = np.zeros(hmm.ENDINGS)
    for w, c in rare:
        k = zlib.crc32(w[-3:].encode()) % hmm.ENDINGS
        assert hmm.ending_classes(pa.array([w]))[0] == k
        mass[k] += (c + 0.1) * 10 ** known.logs[len(known.own) + k]
    assert np.allclose(mass + 0.1 * 10 ** known.logs[len(known.own):], 1)


def test_likelihood_grows_with_the_rounds(spark):
    df = spark.createDataFrame(corpus(200), "doc_id long, text string").withColumn("held_out", F.lit(False))
    known = hmm.classes(hmm.count_words(df))
    encoded = hmm.encode(df, known).repartition(4)
    _, logs = hmm.train(encoded, known, states=2, sample_rounds=0, rounds=6)
    assert len(logs) == 6 and all(b > a - 1e-3 * abs(a) for a, b in zip(logs, logs[1:])) and logs[-1] > 0.97 * logs[0]


def test_segments_and_tasks_count_all_tokens(spark):
    df = spark.createDataFrame(corpus(60) + [(99, "red green " * 500)], "doc_id long, text string").withColumn("held_out", F.lit(False))
    known = hmm.classes(hmm.count_words(df))
    encoded = hmm.encode(df, known)
    model = hmm.first_model(known.share, 3)
    tables = [{r[0]: np.array(r[1:]) for r in hmm.sums(encoded.repartition(n), model, seg).collect()} for n, seg in ((1, 64), (5, 64), (2, 1 << 20))]
    for t in tables:
        assert np.isclose(sum(v.sum() for k, v in t.items() if k >= 0), known.tokens)
    assert all(np.allclose(tables[0][k], tables[1][k]) for k in tables[0])


def test_no_training_text_and_empty_table(spark):
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = run(spark, [(alone, "some words")])
    assert got[0][:6] == (alone, True, 3, 0, 0, 0.0) and math.isfinite(got[0][6])
    assert run(spark, []) == []


def test_every_round_counts_all_training_texts(spark):
    """More texts than the 4,000 that the first rounds once took as a sample."""
    df = spark.range(9000, numPartitions=3).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "red green").otherwise("uno dos").alias("text"), F.lit(False).alias("held_out"))
    known = hmm.classes(hmm.count_words(df))
    encoded = hmm.encode(df, known).localCheckpoint()
    model, logs = hmm.train(encoded, known, states=2, sample_rounds=2, rounds=1)
    want, step = [], hmm.first_model(known.share, 2)
    texts = [np.array(r[0], np.int32) for r in encoded.select("classes").collect()]
    for _ in range(3):
        want.append(hmm.log_likelihoods(texts, step).sum())
        step, _ = hmm.fitted(hmm.sums(encoded, step).toArrow(), known.share, 2)
    assert np.allclose(logs, want, rtol=1e-6) and np.allclose(model.emit, step.emit, rtol=1e-4)


def test_single_precision_counts_as_double_does():
    rng = np.random.default_rng(4)
    model, seqs = model_of(500, 8), [rng.integers(0, 500, n).astype(np.int32) for n in (1, 40, 2048, 2048)]
    later = np.array([0, 0, 0, 1])
    fine = hmm.expected(seqs, later, model)
    rough = hmm.expected(seqs, later, hmm.Model(*[x.astype(np.float32) for x in model]))
    assert rough[1].dtype == np.float32 and np.allclose(rough[1], fine[1], rtol=1e-4, atol=1e-6)
    assert np.allclose(rough[2], fine[2], rtol=1e-5) and math.isclose(rough[4], fine[4], rel_tol=1e-6)


def test_blocks_hold_every_sequence_once(monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 50)
    rng = np.random.default_rng(3)
    texts, at = [], 0
    for n in rng.integers(1, 60, 200).tolist():
        texts.append(np.arange(at, at + n, dtype=np.int32))
        at += n
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i:i + 30])], ["classes"]) for i in range(0, 200, 30)]
    blocks = list(hmm._blocks(iter(batches), "classes", 25))
    found = [(s[0], len(s), k) for seqs, later in blocks for s, k in zip(seqs, later)]
    assert sorted(found) == sorted((t[k], len(t[k:k + 25]), int(k > 0)) for t in texts for k in range(0, len(t), 25))
    assert len(blocks) > 20 and max(sum(map(len, seqs)) for seqs, _ in blocks) < 50 + 25


def test_rows_of_blocks_hold_every_sequence_once(monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 100)
    monkeypatch.setattr(hmm, "HELD_BLOCKS", 4)
    monkeypatch.setattr(hmm, "ROW_BLOCKS", 3)
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 40, n).astype(np.int32) for n in [*rng.integers(1, 60, 80).tolist(), 181]]

    class Here:  # runs the function of mapInArrow in this process, where the sizes are changed
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            batches = [pa.RecordBatch.from_arrays([pa.array(texts[i:i + 30])], ["classes"]) for i in range(0, len(texts), 30)]
            return pa.Table.from_batches(run(iter(batches))).to_pylist()

    seqs, later, blocks = [], [], 0
    got = hmm.packed(Here(), 32)
    for r in got:
        kinds = {"classes": np.int32, "tokens": np.uint16, "widths": np.int32, "steps": np.int32, "later": np.int8}
        found, tokens, widths, steps, goes_on = (np.frombuffer(r[c], k) for c, k in kinds.items())
        counts = np.bincount(tokens, minlength=len(found))
        assert counts.min() > 0 and (np.diff(counts) <= 0).all() and len(set(found)) == len(found)
        own, words, text = found[tokens].tolist(), widths.tolist(), 0
        for n in steps.tolist():
            block = [[] for _ in range(words[0])]
            for w in words[:n]:
                for i, x in enumerate(own[:w]):
                    block[i].append(x)
                own = own[w:]
            words = words[n:]
            seqs += block
            later += goes_on[text:text + len(block)].tolist()
            text, blocks = text + len(block), blocks + 1
        assert not own and not words and text == len(goes_on)
    want = [(x[k:k + 32].tolist(), int(k > 0)) for x in texts for k in range(0, len(x), 32)]
    assert sorted(zip(seqs, later)) == sorted(want) and blocks > len(got) > 3


def test_texts_are_packed_once_for_all_rounds(spark, monkeypatch):
    df = spark.createDataFrame(corpus(80), "doc_id long, text string").withColumn("held_out", F.lit(False))
    known = hmm.classes(hmm.count_words(df))
    encoded = hmm.encode(df, known).localCheckpoint()
    made = []
    monkeypatch.setattr(hmm, "packed", lambda *a, _packed=hmm.packed: made.append(1) or _packed(*a))
    _, logs = hmm.train(encoded, known, states=2, rounds=3)
    assert len(made) == 1 and len(logs) == 3


@pytest.mark.parametrize("kind, rtol", [(np.float64, 1e-9), (np.float32, 1e-3)])
def test_normalising_every_few_tokens_counts_as_at_every_token(kind, rtol):
    model, later = model_of(5, 3), np.array([0, 1, 0, 1, 0])
    m = hmm.Model(*[x.astype(kind) for x in model])
    p = hmm.pack(SEQS)
    emits, peaks = hmm.peaked(m.emit.T)
    assert np.allclose(emits.max(0), 1)
    ways = [hmm.recursions(p.tokens, p.ends, later[p.order], m, emits, None, every) for every in (1, 2, 4, 100)]
    for ahead, after, *rest in ways[1:]:
        assert np.allclose(ahead * after, ways[0][0] * ways[0][1], rtol=rtol)
        assert all(np.allclose(x, y, rtol=rtol) for x, y in zip(rest, ways[0][2:]))


def test_sums_too_small_for_single_precision_are_normalised_at_every_token():
    emit = np.full((4, 2), 1e-9)
    emit[[0, 1], [0, 1]] = 0.4  # a class of either state alone, and almost no way from one to the other
    move = np.array([[1 - 1e-9, 1e-9], [1e-9, 1 - 1e-9]])
    model = hmm.Model(emit, move, np.full((2, 2), 0.5))
    seqs = [np.array([0, 1] * 40, np.int32), np.array([1, 0, 1, 0, 1, 0, 1], np.int32)]
    fine = hmm.expected(seqs, np.array([0, 0]), model)
    rough = hmm.expected(seqs, np.array([0, 0]), hmm.Model(*[x.astype(np.float32) for x in model]))
    assert math.isclose(fine[4], hmm.log_likelihoods(seqs, model).sum(), rel_tol=1e-9)
    assert np.isfinite(rough[1]).all() and np.allclose(rough[1], fine[1], atol=1e-4) and math.isclose(rough[4], fine[4], rel_tol=1e-5)
