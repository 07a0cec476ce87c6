import glob
import hashlib
import random
import time
from collections import Counter

import pytest

from tablestats.llm import substring


def brute(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k:k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words):
        cover = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] > 1:
                cover[k:k + length] = [True] * length
        kept = [x for x, c in zip(w, cover) if not c]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def check(docs_of, rows, length, seed):
    got = sorted(map(tuple, substring.substring_dedup(docs_of(rows, "key"), length=length, seed=seed).collect()), key=str)
    assert got == brute(rows, length)


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(docs_of, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{rng.randrange(40)}" for _ in range(rng.randint(8, 40))] for k in range(4)]
    rows = []
    for i in range(60):
        words = [f"r{rng.randrange(6 if seed == 2 else 4000)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            at = rng.randint(0, len(words))
            words[at:at] = p
        rows.append((i, " ".join(words)))
    check(docs_of, rows, 12, 4)


def test_edges(docs_of):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(1, same), (2, same), (2, same), (3, None), (4, ""), (5, "a " * 100), (6, "a\tb\n" * 30), (None, same + " more"), (None, "short"), (7, " ".join(f"w{i}" for i in range(34))), (8, "A" * 5000)]
    check(docs_of, rows, 35, 8)
    assert substring.substring_dedup(docs_of([])).collect() == []


def test_same_document_overlap(docs_of):
    check(docs_of, [(1, "x y z " * 30 + "q " + " ".join(str(i) for i in range(50)))], 35, 8)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}


def test_disk(docs_of, spark, monkeypatch):
    """A text is dealt out once to meet its seeds, and the steps leave no shuffle files."""
    plans, own = [], substring.written

    def seen(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, **options)

    monkeypatch.setattr(substring, "written", seen)
    passage = " ".join(f"w{i}" for i in range(50))
    docs, before = docs_of([(i, f"{passage} {i}") for i in range(20)] + [(i, f"own{i}") for i in range(20, 40)]), shuffle_files(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = substring.substring_dedup(docs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    held = next(p for p in plans if "seeds" in p and "MapInArrow" in p)
    above = held[:held.index("MapInArrow")]
    assert above.count("Exchange") == 1
    assert sorted(r.n_removed for r in out.collect()) == [0] * 20 + [50] * 20


def test_packed():
    for raw in (b"", b"a", "\u00e9 \0 ".encode() * 5000):
        assert substring.unpacked(substring.packed(raw)) == raw
