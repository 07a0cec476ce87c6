import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablestats.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    counted = [(i, Counter(slow_terms(t)), len(slow_terms(t))) for i, t in docs]
    counted = [x for x in counted if x[2]]
    N, L = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in counted:
            m = 100 - 75 + (75 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in slow_terms(text) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        scored.sort(key=lambda x: x[:3])
        out += [(item_id, r + 1, x[3], -x[0]) for r, x in enumerate(scored[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, n string, score int")
    i = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, item string")
    got = lexical.search(d.repartition(5), i, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("text", ["", "A b-C_d9", "É ñandú\x00x\x7f~Ω", "ǅ x İ", "a" * 100_000 + " B" * 1000])
def test_terms(text):
    assert [t.decode() for t in lexical.terms(text)] == slow_terms(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_scores(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 8, 30, 200]))) for i in range(400)]
    docs += [(i, docs[0][1]) for i in range(400, 430)] + [(7, docs[7][1]), (None, docs[0][1]), (None, None), (901, ""), (902, "-- !"), (903, "W1 " * 3000)]
    items = [(k, text(rng.choice([1, 4, 20, 120]))) for k in range(25)] + [(3, "w1 w1 W1"), (None, "w2"), (50, None), (51, "--"), (52, "absent"), (53, " ".join(words + [f"x{i}" for i in range(100)]))]
    monkeypatch.setattr(lexical, "RUN_DOCS", 64)
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block_bytes=200) == want
    assert run(spark, docs, items[:8], top=3) == brute(docs, items[:8], 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None)], [(1, "a"), (2, None)]) == []


def test_a_term_of_every_document_weighs_as_it_should(spark):
    docs = [(i, "all " + "other " * (i % 3)) for i in range(600)]
    assert run(spark, docs, [(1, "all"), (2, "all other")]) == brute(docs, [(1, "all"), (2, "all other")])


def test_masks_stop_early(monkeypatch):
    """Only the masks that may hold a first place are evaluated."""
    rng = np.random.default_rng(3)
    size, vocabulary = 5000, 12
    import pyarrow as pa
    ids = [np.flatnonzero(rng.random(vocabulary) < 0.2).astype(np.int32) for _ in range(size)]
    table = pa.table({"doc_id": pa.array(range(size), pa.int64()), "n": pa.array([50] * size, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())), "tfs": pa.array([[1] * len(x) for x in ids], pa.list_(pa.int64()))})
    run = lexical.Run(table, size, 50 * size, vocabulary)
    item, weights = np.arange(vocabulary), np.full(vocabulary, 1000)
    bits, docs, starts = lexical.masks(run, item)
    assert len(bits) > 200 and starts[-1] == len(docs) == sum(len(x) > 0 for x in ids)
    seen = []
    real = np.searchsorted
    monkeypatch.setattr(lexical.np, "searchsorted", lambda a, v, *r, **k: (seen.append(len(v)), real(a, v, *r, **k))[1])
    best = lexical.search_run(run, item, weights, [], 10)
    monkeypatch.undo()
    assert max(seen) < size / 10
    scores = np.array([len(x) for x in ids]) * 1000 * int(1_000_000_000 // (1000 + 8 * 100))
    order = np.lexsort((np.arange(size), -scores))[:10]
    assert [(-s, d) for s, _, d in best] == list(zip(scores[order].tolist(), order.tolist()))
