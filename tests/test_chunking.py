import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators.chunking import chunk_documents, chunk_text, tail


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (-1, 0), (10, 10), (10, 11), (10, -1)])
def test_bad_settings_raise(size, overlap):
    with pytest.raises(ValueError):
        chunk_text("x", size, overlap)


def test_small_cases():
    assert chunk_text("") == [] == chunk_text(None) == chunk_text(" \n ")
    assert chunk_text(" short ") == ["short"]
    assert chunk_text("a" * 512) == ["a" * 512]
    assert [len(c) for c in chunk_text("a" * 1000, 100, 0)] == [100] * 10


def test_tail_begins_with_a_word():
    assert tail("hello big world", 8) == "world"
    assert tail("unbroken", 4) == "oken"
    assert tail("x", 0) == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdefg", min_size=1, max_size=12), min_size=1, max_size=200), st.integers(20, 80), st.integers(0, 15))
def test_no_word_is_lost_and_no_chunk_too_long(words, size, overlap):
    chunks = chunk_text(" ".join(words), size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    # a word that doesn't fit beside a whole overlap may be cut
    if overlap + 1 + max(map(len, words)) <= size:
        assert set(words) <= set(" ".join(chunks).split())


def test_a_word_beside_a_long_overlap_is_cut():
    assert chunk_text("aaaaaaaa bbbbbbbb cccccccccccc", 20, 8) == ["aaaaaaaa bbbbbbbb", "bbbbbbbb ccccccccccc", "ccccccccc"]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 300), (2, ""), (3, None)], "doc_id int, text string")
    rows = chunk_documents(docs).collect()
    assert {r["doc_id"] for r in rows} == {1}
    assert sorted(r["chunk_index"] for r in rows) == list(range(len(rows)))
