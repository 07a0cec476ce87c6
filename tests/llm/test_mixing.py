from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablestats.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_budget_is_hit_as_well_as_the_sizes_left_allow(pairs, budget):
    sizes, counts = (np.array(x) for x in zip(*pairs))
    take = mixing.fit_budget(sizes, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    got, whole = int((take * sizes).sum()), int((sizes * counts).sum())
    assert got <= budget
    if budget >= whole:
        assert got == whole
    else:  # the best of all choices beyond the proportional share
        share = np.array([int(c) * budget // whole for c in counts])
        sums = {int((share * sizes).sum())}
        for s, c in zip(sizes, counts - share):
            sums = {x + int(s) * k for x in sums for k in range(c + 1)}
        assert got == max(x for x in sums if x <= budget)


def test_large_budgets_go_to_the_largest_sizes_first(monkeypatch):
    monkeypatch.setattr(mixing, "DP_BUDGET", 50)
    sizes = np.array([3, 7, 101, 999])
    counts = np.array([500, 40, 9, 5])
    for budget in range(0, int((sizes * counts).sum()), 97):
        take = mixing.fit_budget(sizes, counts, budget)
        gap = budget - int((take * sizes).sum())
        assert (take <= counts).all() and 0 <= gap < sizes[take < counts].min()


def test_rests_above_the_old_table_are_fitted_exactly():
    """Budgets whose rest after whole shares is far above 65,536 words: the sum is hit, and shares are rounded up at most once."""
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 40, len(sizes))
    whole = int((sizes * counts).sum())
    for budget in (whole // 3, whole // 2 + 1, 2 * whole // 3 + 7):
        share = np.array([int(c) * budget // whole for c in counts])
        rest = budget - int((share * sizes).sum())
        assert rest > 2_000_000
        take = mixing.fit_budget(sizes, counts, budget)
        assert int((take * sizes).sum()) == budget and (take <= counts).all() and (take >= share).all()
        assert (take - share > 1).sum() < 30  # but for the few that the last words are made of


@pytest.mark.parametrize("seed", range(5))
def test_large_tables_equal_brute_force(seed):
    """Few large documents, budgets above 65,536 words: every reachable sum is tried."""
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(20_000, 90_000, 9))
    counts = rng.integers(1, 3, len(sizes))
    whole = int((sizes * counts).sum())
    budget = int(rng.integers(100_000, whole))
    take = mixing.fit_budget(sizes, counts, budget)
    share = np.array([int(c) * budget // whole for c in counts])
    sums = {int((share * sizes).sum())}
    for s, c in zip(sizes, counts - share):
        sums = {x + int(s) * k for x in sums for k in range(c + 1)}
    assert int((take * sizes).sum()) == max(x for x in sums if x <= budget)


def slow_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(docs_of):
    rows = [(i, "word " * (i * 7 % 40), f"src{i * i % 11}") for i in range(400)]
    rows += [(1000 + i, "one two three", "src0") for i in range(150)] + [(2000, None, "src1"), (2001, "a b c", None), (2002, "x " * 500, "tiny"), (None, "y " * 20, "src5"), (5, "", "src5")]
    docs = docs_of(rows, "copies")
    got = mixing.mix(docs).collect()
    source = {r[0]: r[2] for r in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    for r in got:
        s = source[r["doc_id"]] if r["doc_id"] != 5 else "src3" if r["size"] else "src5"
        s = "src3" if r["doc_id"] == 5 and r["size"] else s
        if r["doc_id"] == 5:
            continue
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) and r["source_size"] == sizes[s]
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = slow_targets(dict(sizes))
    assert target == pytest.approx(want)
    for s in target:
        if s not in (source[5], "src3"):
            assert abs(taken[s] - target[s]) <= 20
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixed_rows_follow_the_plan(docs_of):
    rows = [(i, "word " * (1 + i % 9), f"s{i % 4}") for i in range(120)] + [(None, "w", "s1"), (500, "w", None)]
    docs = docs_of(rows, "copy_")
    plan = defaultdict(int)
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"]] += r["taken"] // r["size"]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in plan.items() if n})


def test_empty(docs_of):
    assert mixing.mix(docs_of([])).collect() == [] and mixing.mixed(docs_of([])).collect() == []
    assert [(r["target"], r["taken"]) for r in mixing.mix(docs_of([(1, None), (2, "")])).collect()] == [(0.0, 0)] * 2


def test_rows_with_one_id_are_counted_one_by_one(docs_of):
    rows = [(None, "a b c d", "x")] * 90 + [(None, f"a b c d{i % 7}", "x") for i in range(60)] + [(7, "one two", "x")] * 50 + [(i, "w " * 4, "x") for i in range(100, 120)] + [(5, "p q", None)] * 40 + [(i, "y " * 30, "z") for i in range(40)]
    docs = docs_of(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        taken[r["source_size"], r["target"]] += r["taken"]
    assert len(taken) == 3
    smallest = {780: 2, 80: 2, 1200: 30}
    for (size, target), words in taken.items():
        assert target - smallest[size] <= words <= target + 0.5
    out = mixing.mixed(docs).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(taken.values())
