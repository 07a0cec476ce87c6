import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tablestats.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i:i + 3])) for i in range(0, len(x), 3)])
    return levels


def siblings(levels, i):
    out = []
    for x in levels[:-1]:
        a = i - i % 3
        out.append((x[a:i], x[i + 1:a + 3]))
        i //= 3
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order]) if order else []
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            told = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                told = (*r[:4], r[4].replace("\n", ""))
            h = leaf(told)
            for a, b in path:
                h = sha("".join(a) + h + "".join(b))
            proof = sha("".join(x for a, b in path for x in a + b))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.select("*", F.lit("x").alias("leaf"), F.lit(1).alias("g"), F.lit(2).alias("pos"))


def run(spark, rows):
    got = merkle.verified(frame(spark, rows))
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(source, n, text="a\nb"):
    return [(i * 7 % 1009, source, "en", i, f"{text} {i}") for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_run_lengths(spark, n):
    rows = rows_of("s", n)
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(not r[6] for r in got) or n < 4


def test_many_sources_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, None, "en", 1, ""), (5, "", "en", 1, "\n"), (5, "", "en", 1, "\n"), (5, "", "de", 1, "x"),
            (None, "é", "fr", 3, "é\n\né"), (-3, "é", "fr", 3, "z" * 200_000 + "\n"), (8, "Z", None, None, None)]
    rows += [r for k in range(11) for r in rows_of(f"s{k}", k + 1)]
    assert run(spark, rows) == brute(rows)


def test_several_window_partitions_and_stages(spark, monkeypatch):
    rows = rows_of("hot", 300) + rows_of("b", 31) + rows_of("c", 1) + [r for k in range(12) for r in rows_of(f"t{k}", 2)]
    want = brute(rows)
    leaves = frame(spark, rows).select("doc_id", "source", merkle.digest(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    for levels in (1, 2, 6):
        got = merkle.trees(leaves, "source", ["doc_id", "leaf"], levels=levels)
        got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), merkle.fold(F.col("leaf"), F.col("path")))
        got = sorted((tuple(r) for r in got.collect()), key=str)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert all(r[5] == r[3] for r in got)


def test_manifest_and_empty_table(spark):
    rows = rows_of("s", 5) + rows_of("t", 2)
    got = merkle.manifest(frame(spark, rows))
    assert got.columns == ["id", "source", "leaf", "path", "subroot", "root"]
    assert {(r["id"], r["root"]) for r in got.collect()} == {(r[0], r[3]) for r in brute(rows)}
    assert run(spark, []) == []


def test_any_changed_column_changes_the_root(spark):
    rows = rows_of("s", 7)
    roots = {merkle.manifest(frame(spark, x)).first()["root"] for x in (rows, rows[::-1], [(*rows[0][:2], "de", *rows[0][3:]), *rows[1:]], rows[1:], [(rows[0][0], "t", *rows[0][2:]), *rows[1:]])}
    assert len(roots) == 4
