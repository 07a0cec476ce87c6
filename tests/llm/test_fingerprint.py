import hashlib

import pytest
from pyspark.sql import functions as F

from tablestats.llm import fingerprint


def prose(k, n=40):
    return "\n".join(" ".join(f"w{(k * 131 + i * 17 + j * j) % 997}" for j in range(12)) for i in range(n))


def test_edited_texts(docs_of):
    rows = [(5, prose(1)), (9, "é日a" * 3), (-3, None), (7, ""), (100, "odd"), (None, "without id"), (9, "same id"), (200, prose(2)), (201, prose(1))]
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprint.edited_fingerprints(docs_of(rows, "g")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        want = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        r = got[i, len(t)]
        assert r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if want == t:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1
    assert got[5, len(prose(1))]["fingerprint"] == got[201, len(prose(1))]["fingerprint"]
    assert got[200, len(prose(2))]["fingerprint"] != got[201, len(prose(1))]["fingerprint"]
    assert got[201, len(prose(1))]["near_edited"] > 0.3 > got[201, len(prose(1))]["near_next"]


def test_an_id_with_very_many_rows_is_cut(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "GROUP", 20)
    texts = [f"text {i * 7919 % 1000} {'x' * (i % 13)}" for i in range(1200)]
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, "same" if i % 4 == 0 else t) for i, t in enumerate(texts)]
    placed = fingerprint.followed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(placed) == len(rows)
    sizes = {}
    for r in placed:
        sizes[r["g"]] = sizes.get(r["g"], 0) + 1
    assert max(sizes.values()) < 120 and len({r["g"] for r in placed if r["doc_id"] is None}) > 8
    # One cycle through all rows, ids descending, null last, whose next text is the next row's.
    by = {(r["g"], r["i"]): r for r in placed}
    assert len(by) == len(rows)
    at = start = max(by, key=lambda k: (by[k]["doc_id"] is not None, by[k]["doc_id"] or 0, k[0], -k[1]))
    seen = []
    while True:
        r = by[at]
        seen.append(r["doc_id"])
        at = r["next_g"], r["next_i"]
        assert by[at]["text"] == r["next_text"]
        if at == start:
            break
    assert len(seen) == len(rows)
    assert seen == sorted(seen, key=lambda i: (i is None, -(i or 0)))


def slow_lanes(text):
    """The lanes counted one by one: sums over paragraphs and pieces, by the same hashes."""
    import xxhash
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = lambda data, seed: xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    identity, sketch, pieces = [0] * fingerprint.IDENTITY, [0] * fingerprint.SKETCH, 0
    for p in text.split("\n"):
        for i in range(fingerprint.IDENTITY // 2):
            # Spark hashes several columns by taking each one's hash as the next one's seed.
            x = h(p.encode(), h(i.to_bytes(4, "little"), 42))
            identity[2 * i] += x & 0xFFFFFFFF
            identity[2 * i + 1] += x >> 32
        words = [h(w.encode(), 42) for w in fingerprint_words(p)]
        for a, b in zip(words, [*words[1:], None]):
            x = h(a.to_bytes(8, "little"), 42)
            x = x if b is None else h(b.to_bytes(8, "little"), x)
            pieces += 1
            for i in range(fingerprint.PACKED):
                for k in range(3):
                    sketch[3 * i + k] += x >> (i + 21 * k) & 1
    return [v % 2**32 for v in [*identity, *sketch, pieces]]


def fingerprint_words(p):
    return [w for w in p.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]


@pytest.mark.parametrize("text", ["", "one", "one two three", "a\nb b b\n\nc d\te", "é 日本 x\x0by " * 30, prose(3)])
def test_lanes_are_the_sums_over_paragraphs_and_pieces(docs_of, text):
    assert lanes(docs_of([(1, text)])).first()["lanes"] == slow_lanes(text)


def test_one_document_follows_itself(docs_of):
    (r,) = fingerprint.edited_fingerprints(docs_of([(1, "abcd")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1
    assert fingerprint.edited_fingerprints(docs_of([])).collect() == []


def lanes(docs):
    return fingerprint.fingerprint_lanes(docs, ["doc_id"])


def test_homomorphic(docs_of):
    a, b, whole, mixed = "one two\nthree four five", "six\nseven eight", "one two\nthree four five\nsix\nseven eight", "seven eight\none two\nsix\nthree four five"
    got = {r["doc_id"]: r["lanes"] for r in lanes(docs_of([(1, a), (2, b), (3, whole), (4, mixed)])).collect()}
    assert got[3] == got[4] == [(x + y) % 2**32 for x, y in zip(got[1], got[2])]
    df = lanes(docs_of([(1, a), (2, b), (3, whole)]))
    x, y, z = (df.where(f"doc_id = {i}").select(F.col("lanes").alias(f"l{i}")) for i in (1, 2, 3))
    row = x.crossJoin(y).crossJoin(z).select(fingerprint.combine(F.col("l1"), F.col("l2")) == F.col("l3"), fingerprint.without(F.col("l3"), F.col("l2")) == F.col("l1")).first()
    assert row[0] and row[1]


@pytest.mark.parametrize("text", ["w " * 40_000, "\n".join(f"line {i}" for i in range(500))])
def test_blocks_add_up(docs_of, monkeypatch, text):
    whole = lanes(docs_of([(1, text)])).first()["lanes"]
    monkeypatch.setattr(fingerprint, "BLOCK_PARAGRAPHS", 3)
    monkeypatch.setattr(fingerprint, "BLOCK_BITS", 5)
    assert lanes(docs_of([(1, text)])).first()["lanes"] == whole


def test_no_python_in_the_plan(docs_of):
    plan = lanes(docs_of([(1, "a\nb")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
