import itertools
import random

import pytest
import xxhash

from tablestats.llm import graph, simhash


def brute_roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "One", "One two", "a B\tc\x0bD e É f", "x " * 500, "Tiếng Việt và nữa", "\n"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(2001, 2100)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == brute_roots(nodes, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("crowd", [simhash.MAX_AT_POINT, 2])
def test_links_connect_as_all_pairs(spark, monkeypatch, crowd, bits):
    monkeypatch.setattr(simhash, "MAX_AT_POINT", crowd)
    rng = random.Random(crowd)
    prints = {0, 1, 3, 2**64 - 1, 2**63, 2**63 + 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(14):
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & 2**64 - 1).bit_count() <= bits]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = [(r["x"], r["y"]) for r in simhash.links(df, bits).collect()]
    assert all(((a ^ b) & 2**64 - 1).bit_count() <= 2 for a, b in got)
    assert brute_roots(signed, got) == brute_roots(signed, pairs)


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_groups(docs_of):
    long = " ".join(f"w{i}" for i in range(400))
    near = long.replace("w7 ", "W7 ")
    rows = [(9, long), (4, near), (4, near), (12, None), (3, ""), (None, "alone among words here"), (20, "quite another text"), (None, long)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs_of(rows, "fp")).collect()), key=str)
    assert got == sorted([(9, 4), (4, 4), (4, 4), (12, 3), (3, 3), (None, None), (20, 20), (None, 4)], key=str)
    kept = sorted((r["doc_id"] for r in simhash.keep_representatives(docs_of(rows, "component_id")).collect()), key=str)
    assert kept == sorted([4, 3, 20, None], key=str)  # the copy without an id goes with its group
    copies = [(None, near), (None, long), (None, long), (None, None), (None, "")]
    kept = [(r["doc_id"], simhash.fingerprint(r["text"] or "")) for r in simhash.keep_representatives(docs_of(copies)).collect()]
    assert len(kept) == 2 and {i for i, _ in kept} == {None} and len({f for _, f in kept}) == 2
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_every_group_keeps_one_row_where_ids_are_repeated(docs_of):
    a, b = (" ".join(f"{x}{i}" for i in range(400)) for x in "ab")
    near = a.replace("a7 ", "A7 ")
    rows = [(1, a), (1, b), (2, near), (1, near), (3, b, "t"), (1, "short one here", "u"), (1, "short one here", "t"), (1, "short one here", "u")]
    kept = sorted((r["doc_id"], simhash.fingerprint(r["text"]), r["source"]) for r in simhash.keep_representatives(docs_of(rows)).collect())
    assert kept == sorted([(1, simhash.fingerprint(a), "s"), (1, simhash.fingerprint(b), "s"), (1, simhash.fingerprint("short one here"), "t")])
    texts = [{r["text"] for r in simhash.keep_representatives(docs_of(x)).collect()} for x in (rows, rows[::-1])]
    assert texts[0] == texts[1]
