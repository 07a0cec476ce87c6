from collections import Counter

from pyspark.sql import functions as F

from tablestats.llm import line_dedup


def brute(rows, ratio, least):
    pages, held = Counter(), Counter()
    for _, t, s in rows:
        pages[s] += 1
        held.update((s, x) for x in set((t or "").split("\n")) if t is not None and x)
    bad = {k for k, n in held.items() if n > ratio * pages[k[0]] and n >= least}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad)) for i, t, s in rows]


def test_against_brute_force(docs_of):
    rows = [(i, f"Menu\nline {i}\n\nMenu\nshared {i % 7}\nfoot ", "abc"[i % 3 % 2]) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "Menu", None), (None, "Menu\nown", "a"), (103, "Menu", "lonely"), (3, rows[3][1], rows[3][2]), (104, "x" * 200_000, "b")]
    docs = docs_of(rows, "host_")
    got = line_dedup.drop_boilerplate(docs, max_ratio=0.2, min_pages=4)
    assert got.columns == docs.columns
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(brute(rows, 0.2, 4), key=key)


def test_counts_and_empty(docs_of):
    rows = [(i, "Top\nown %d" % i) for i in range(10)] + [(10, None)]
    got = line_dedup.drop_boilerplate(docs_of(rows), counts=("n_lines", "n_dropped")).collect()
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in got} == {(i, 2, 1) for i in range(10)} | {(10, 0, 0)}
    assert line_dedup.drop_boilerplate(docs_of([])).collect() == []


def test_no_python_in_the_plan(docs_of):
    plan = line_dedup.drop_boilerplate(docs_of([(1, "a\nb")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_host_of(spark):
    urls = ["https://A.example.com:8/x", "http://u@b.org", "nothing", None]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(line_dedup.host_of(F.col("url"))).collect()
    assert [r[0] for r in got] == ["a.example.com", "b.org", "", None]
