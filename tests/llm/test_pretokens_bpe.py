import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tablestats.llm import bpe, pretokens

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TRICKY = st.text(alphabet="ab'strevmdl 1\n\t é２.,! 日٣͸<|>", max_size=40)


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_boundaries_equal_the_pattern(text):
    assert pretokens.pretoken_ends(text) == [m.end() for m in regex.finditer(PATTERN, text)]


@settings(max_examples=100, deadline=None)
@given(st.lists(TRICKY.filter(bool), min_size=1, max_size=6))
def test_starts_of_many_texts(texts):
    points = pretokens.code_points("".join(texts))
    if pretokens.uncertain(points):
        return
    firsts = np.cumsum([0, *map(len, texts[:-1])])
    want = [f + m.start() for f, t in zip(firsts.tolist(), texts) for m in regex.finditer(PATTERN, t)]
    assert np.flatnonzero(pretokens.starts(points, firsts)).tolist() == want


@settings(max_examples=100, deadline=None)
@given(TRICKY, st.integers(1, 6))
def test_pieces_keep_the_pretokens(text, size):
    whole = regex.findall(PATTERN, text)
    assert [w for p in pretokens.safe_pieces(text, size) for w in regex.findall(PATTERN, p)] == whole


def expected(text):
    ids = bpe.encoding(RANKS, PATTERN).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


TEXTS = [None, "", " ", "a", "don't we're 's", "x" * 9000, " " * 3000 + "y", "word " * 900, "it's " * 700 + "\n\n" * 400 + "end", "日本語。" * 800, "no<|endoftext|>special", "tab\t\tand\r\nlines " * 300]


@pytest.mark.parametrize("chunk", [bpe.CHUNK, 600])
def test_digests_whatever_the_chunk(spark, docs_of, chunk):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (None, "null id " * 400), (7, "another text")]
    got = sorted(map(tuple, bpe.encode_digests(docs_of(rows, "key"), RANKS, PATTERN, chunk=chunk).collect()), key=str)
    assert got == sorted([(i, *expected(t)) for i, t in rows], key=str)


def test_ids_in_order(spark, docs_of):
    text = "We'll say it again, and again. " * 200
    got = bpe.encode_ids(docs_of([(1, text), (2, "short")]), RANKS, PATTERN, chunk=500).orderBy("doc_id", "piece").collect()
    enc = bpe.encoding(RANKS, PATTERN)
    assert [x for r in got if r["doc_id"] == 1 for x in r["ids"]] == enc.encode_ordinary(text)
    assert [list(r["ids"]) for r in got if r["doc_id"] == 2] == [enc.encode_ordinary("short")]


def test_huge_pretokens_skip_the_regex_engine():
    enc = bpe.encoding(RANKS, PATTERN)
    text = "x" * 150_000 + " yes" * 9 + "'" * 120_000 + " end"
    assert bpe.encode_piece(enc, text).tolist() == enc.encode_ordinary(text)


def test_empty_table(docs_of):
    assert bpe.encode_digests(docs_of([]), RANKS, PATTERN).collect() == []
