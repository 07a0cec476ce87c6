import random
import zlib

import numpy as np
import pytest

from tablestats.llm import quality


def corpus(n=160):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "ba ce di fo gu le".split() for b in "rn st ll nd".split()]
    rows = []
    for i in range(n):
        good = i % 3 != 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 200)))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), int(good)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    return rows, docs, quality.learn(docs, labels)


def test_held_out_accuracy(trained):
    rows, docs, model = trained
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(held) == sorted(i for i, r in got.items() if r["held_out"])
    assert sum(got[i]["predicted"] == rows[i][2] for i in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_scores_depend_on_the_text_alone(trained, docs_of):
    _, _, model = trained
    rows = [(5, "ba ce di"), (6, "ba ce di", "other"), (None, "ba ce di"), (7, None), (8, ""), (9, "long " * 50_000)]
    got = [(r["doc_id"], r["score"], r["held_out"]) for r in quality.score(docs_of(rows, "score"), model).collect()]
    by = dict((i, s) for i, s, _ in got)
    assert by[5] == by[6] == by[None] and by[7] == by[8] and all(0 <= s <= 1 for s in by.values())
    assert dict((i, h) for i, _, h in got)[None] is False
    assert quality.score(docs_of([]), model).collect() == []


def test_kept_rows_are_unchanged(trained, docs_of):
    rows, _, model = trained
    docs = docs_of([(i, t) for i, t, _ in rows], "score")
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert set(kept.collect()) <= set(docs.collect())


def test_long_texts_conflicting_labels_and_repeated_ids(spark, monkeypatch):
    rows = corpus()
    docs = [(i, t if i % 9 else t * 40) for i, t, _ in rows] + [(i, t) for i, t, _ in rows if i % 10 == 3] + [(7, "other text of 7")]
    labels = [(i, q, 0) for i, _, q in rows] + [(i, 1 - q, 0) for i, _, q in rows if i % 4 == 1]
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda r, **k: (seen.append(sorted(r)), fit(r, **k))[1])
    monkeypatch.setattr(quality, "MAX_SAMPLE_CHARS", 500)
    models = []
    for n in (1, 5):
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
        models.append(quality.learn(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(n)))
    assert seen[0] == seen[1] and (models[0].weights == models[1].weights).all()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    good = [(t, rows[i][2]) for i, t in docs if i % 4 != 1 and not held(i)]
    assert len(seen[0]) == len(good) and all(len(t) <= 500 for t, _ in seen[0])
    assert all(any(t in whole and y == q and len(t) == min(500, len(whole)) for whole, q in good) for t, y in seen[0])


def test_sizes_are_those_of_the_library():
    """The features recomputed with plain zstandard calls, and the score with a plain loop over the weights."""
    import zstandard
    rows = [(t, q) for _, t, q in corpus(90)]
    model = quality.fit(rows, seed=3)
    text = rows[5][0] + " é"
    sizes = []
    for content in (model.good, model.bad):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append(len(c.compress(text.encode())))
    good, bad = sizes
    n = len(text.encode()) + 16
    f = [(bad - good) / n, good / n, (bad - good) / (bad + good), float(np.log(n))]
    z = [(min(max(v, lo), hi) - m) / s for v, lo, hi, m, s in zip(f, model.low, model.high, model.mean, model.scale)]
    terms = [1.0, *z, *(z[i] * z[j] for i in range(4) for j in range(i, 4))]
    want = 1 / (1 + np.exp(-sum(w * t for w, t in zip(model.weights, terms))))
    assert np.isclose(model.scorer().scores([text])[0], want, rtol=1e-12)


@pytest.mark.parametrize("gap", [0.0, 0.5, 5.0])
def test_the_curve_settles_even_where_labels_are_separable(gap):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 4)), rng.normal(size=(300, 4)) + 6 + gap])
    y = np.repeat([0.0, 1.0], 300)
    x = (x - x.mean(0)) / x.std(0)
    w = quality._curve(quality._design(x), y)
    p = 1 / (1 + np.exp(-(quality._design(x) @ w)))
    assert np.abs(w).max() < 50 and ((p >= 0.3) == y).mean() > 0.99


def test_without_labels_nothing_is_rejected(spark, docs_of):
    docs = docs_of([(1, "a"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in quality.score(docs, quality.learn(docs, labels)).collect()] == [1, 1]


def test_held_out_labels_are_not_learnt(spark, trained):
    rows, docs, model = trained
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, _, q in rows]
    again = quality.learn(docs, spark.createDataFrame(wrong, "doc_id long, quality int, toxic int"))
    assert (again.weights == model.weights).all() and again.good == model.good
