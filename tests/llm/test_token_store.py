import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from tablestats.llm import token_store
from tablestats.llm.common import work_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text):
    t = Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=300))
def test_elias_fano(values):
    values.sort()
    e = token_store.EliasFano.from_bytes(token_store.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert e.values().tolist() == values and [e[i] for i in range(len(values))] == values
    with pytest.raises(IndexError):
        e[len(values)]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 3000, 20_000)).astype(np.uint64)
    assert len(token_store.EliasFano.of(ends).to_bytes()) * 8 / len(ends) < 14.5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab'stre \n\té１日<|endoftext|>.,͸", max_size=30), max_size=8))
def test_encoder_equals_the_library(texts):
    assert [x.tolist() for x in token_store.encoder(PATH).encode(texts)] == [plain(t) for t in texts]


def test_encoder_in_slices_and_after_forgetting(monkeypatch):
    monkeypatch.setattr(token_store, "SLICE", 50)
    monkeypatch.setattr(token_store, "CACHED", 20)
    text = "Many different words, one after another; and 's some's more\n\n  " * 20
    enc = token_store.PretokenEncoder(PATH)
    assert [x.tolist() for x in enc.encode([text, "", "tail"])] == [plain(text), [], plain("tail")]


@pytest.mark.parametrize("shard", [token_store.SHARD_IDS, 20])
def test_round_trip(spark, docs_of, monkeypatch, shard):
    monkeypatch.setattr(token_store, "SHARD_IDS", shard)
    rows = [(i * 37 % 101 - 20, f"document {i} has words " * (i % 9)) for i in range(60)] + [(None, "no id"), (-20_000_000_000, None), (9_000_000_000_000, "far " * 3000)]
    got = [tuple(r) for r in token_store.round_trip(docs_of(rows, "part"), PATH, end_id=0).collect()]
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(t) + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_shard_selects_documents(spark, docs_of):
    folder = work_dir(spark, "test") + "/store"
    token_store.write_store(docs_of([(1, "one two"), (4, None), (9, "three")]), folder, PATH)
    docs = {i: s.document(k).tolist() for r in spark.read.parquet(folder).collect() for s in [token_store.Shard(bytes(r["blob"]))] for k, i in enumerate(s.all_ids())}
    assert docs == {1: plain("one two") + [0], 4: [0], 9: plain("three") + [0]}
    with pytest.raises(ValueError):
        token_store.Shard(b"x" * 100)


def test_repeated_ids_and_empty(spark, docs_of):
    got = sorted(tuple(r)[:3] for r in token_store.round_trip(docs_of([(3, "a"), (3, "a"), (3, "a b")]), PATH).collect())
    assert [g[0] for g in got] == [3, 3, 3] and sorted(g[2] for g in got) == [2, 2, 3] and len({g[1] for g in got}) == 3
    assert token_store.round_trip(docs_of([]), PATH).collect() == []


from_file = functools.lru_cache(Tokenizer.from_file)


def unmodified(text, path=PATH):
    return from_file(path).encode(text or "", add_special_tokens=False).ids


END = "<|endoftext|>"


def test_added_tokens_are_found_as_the_library_finds_them():
    texts = [f"one {END} two", END, f"{END}{END}'s", "<|endoftext", "|>", f"a  {END}  b\n\n{END}\n", f"x{END}y \u0378", "none here", ""]
    assert [x.tolist() for x in token_store.PretokenEncoder(PATH).encode(texts)] == [unmodified(t) for t in texts]
    assert unmodified(texts[0]) == [505, 220, 50256, 734]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([END, "<|", "endoftext", "|>", " ", "  \n", "words", "'s", "é", "1", "."]), max_size=40).map("".join), st.integers(1, 30))
def test_no_cut_inside_an_added_token(text, size):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(token_store, "SLICE", size)
        assert token_store.encoder(PATH).encode([text])[0].tolist() == unmodified(text)


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}])
def test_other_added_tokens(tmp_path, monkeypatch, flags):
    t = Tokenizer.from_file(PATH)
    t.add_tokens([AddedToken(x, normalized=False, **flags) for x in ("new york", "york\nold", "wo", "word")])
    t.save(path := str(tmp_path / "t.json"))
    monkeypatch.setattr(token_store, "SLICE", 9)
    texts = ["in new york or york\nold", "in new  york", "a  word  of words, wo", "a new then a york one", "york then old", "york, old"]
    assert [x.tolist() for x in token_store.PretokenEncoder(path).encode(texts)] == [unmodified(x, path) for x in texts]
    monkeypatch.setattr(token_store, "SLICE", 1000)
    assert [x.tolist() for x in token_store.PretokenEncoder(path).encode(texts)] == [unmodified(x, path) for x in texts]


def test_round_trip_with_an_added_token(spark, docs_of):
    rows = [(1, "before"), (2, f"one {END} two"), (3, "after")]
    got = sorted(tuple(r) for r in token_store.round_trip(docs_of(rows), PATH).collect())
    want, at = [], 0
    for i, t in rows:
        ids = unmodified(t) + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_some_documents_are_read_by_select(spark, docs_of, monkeypatch):
    rows = [(i * 3 - 50, f"text number {i} " * (i % 7)) for i in range(120)] + [(None, "no id"), (10, "same id"), (10, None)]
    folder = work_dir(spark, "some") + "/store"
    token_store.write_store(docs_of(rows), folder, PATH)
    asked = [-50, 10, 11, 40, 307, 9999, -9999]
    got = sorted((r["doc_id"], r["ids"]) for r in token_store.read_documents(spark, folder, asked).collect())
    assert got == sorted((i, unmodified(t or "") + [0]) for i, t in rows if i in asked)
    assert token_store.read_documents(spark, folder, []).collect() == []
    monkeypatch.setattr(token_store.EliasFano, "values", None)  # find needs no whole sequence
    s = token_store.Shard(token_store.Shard.pack([None, 4, 4, 9], [1, 2, 3, 4], np.arange(10), 2, 0))
    assert [list(s.find(i)) for i in (3, 4, 9, 10)] == [[], [1, 2], [3], []] and s.document(2).tolist() == [3, 4, 5]
