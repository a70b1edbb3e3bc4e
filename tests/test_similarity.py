from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from parley.functions import similarity as sim

FEW = st.text(alphabet="ab ", max_size=60)
MANY = st.text(alphabet="doc_123.pf é😀", max_size=120)


@settings(max_examples=400, deadline=None)
@given(st.one_of(FEW, MANY), st.one_of(FEW, MANY))
def test_ratio_equals_the_standard_library(a, b):
    assert sim.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


@settings(max_examples=200, deadline=None)
@given(FEW, FEW)
def test_the_block_that_counts_is_the_same(a, b):
    m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
    i, j, n = sim.longest_block(a, b)
    assert n == m.size and (not n or (i, j) == (m.a, m.b))


def test_long_second_texts_lose_their_popular_characters():
    for n in (199, 200, 340):
        assert sim.ratio("abcx", "x" * n + "abc") == SequenceMatcher(None, "abcx", "x" * n + "abc").ratio()
    a, b = "qabcabcx", "bca" * 100
    assert sim.ratio(a, b) == SequenceMatcher(None, a, b).ratio() < SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_empty_sides():
    assert sim.ratio("", "") == 1.0 and sim.ratio("a", "") == 0.0
    assert sim.name_score("", "") == 0 and sim.name_score("a", "a") == 100
