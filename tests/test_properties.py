"""Properties of the per-row helpers that hold for any text or sequence of hits."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.functions.vectors import DIMENSIONS, hash_trigrams
from docketry.operators.limits import Bucket
from docketry.operators.spans import LEAST_SPAN, spans_of
from docketry.operators.verify import LEAST_QUOTE, fold, fold_with_places, place_of

LETTERS = st.text(alphabet=" \t\n\x0b\x0cabcXYZ019.,-\u2014\u2013\u2019\u2018\u201c\u201d\u2026\u00a0\u2003\u200b\u00ad\u00e9\u00df\ufb01\u00bd", max_size=200)
BLOCKS = st.lists(st.sampled_from(["IV. Analysis", "B. The rule", "short", "word " * 9 + "end", "x" * 60, "", "\f", "  spaced out " * 5]), max_size=12)


@given(LETTERS)
def test_folding_twice_changes_nothing(s):
    assert fold(fold(s)) == fold(s)


@given(LETTERS)
def test_both_ways_to_fold_agree(s):
    folded, places = fold_with_places(s)
    assert folded == fold(s) and len(places) == len(folded) and places == sorted(places)


@settings(max_examples=200)
@given(LETTERS, st.integers(0, 100), st.integers(20, 90))
def test_a_cut_of_a_source_is_found_in_it(s, at, n):
    quote = s[at : at + n]
    reason, start, end = place_of(quote, s)
    if len(re.sub(r"^\s+|\s+$", "", quote)) >= LEAST_QUOTE and len(fold(quote)) >= LEAST_QUOTE:
        assert reason is None and fold(quote) in fold(s) and fold(s[start:end]).startswith(fold(quote)[:3])
    else:
        assert reason in (None, "quote_too_short", "empty_quote", "source_missing", "not_found_in_source")


@given(BLOCKS, st.sampled_from(["\n\n", "\n \t\n", "\n\n\n"]))
def test_passages_lie_where_they_say(blocks, gap):
    text = gap.join(blocks)
    found = spans_of(text)
    assert [s["ordinal"] for s in found] == list(range(1, len(found) + 1))
    for s in found:
        assert text[s["char_start"] : s["char_end"]] == s["text"] == s["text"].strip() and len(s["text"]) >= LEAST_SPAN
        assert (s["page"] or 1) == text.count("\f", 0, s["char_start"]) + 1
    assert all(a["char_end"] <= b["char_start"] for a, b in zip(found, found[1:]))


@given(st.lists(st.integers(0, 40), max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_no_window_lets_through_more_than_its_limit(gaps, limit, window):
    bucket, at, opened, through = Bucket(), 0, None, 0
    for gap in gaps:
        at += gap * 500_000
        if opened is None or at - opened > window * 1_000_000:
            opened, through = at, 0
        allowed, remaining, wait = bucket.hit(at, limit, window)
        through += allowed
        assert through <= limit and remaining == max(0, limit - through) if allowed else wait >= 1
        assert allowed == (bucket.hits <= limit) and bucket.opened == opened


@given(st.text(alphabet="abc 019", max_size=60))
def test_vectors_are_units_or_zero(t):
    v = hash_trigrams(t.encode())
    assert len(v) == DIMENSIONS and (abs((v**2).sum() - 1) < 1e-9 or not v.any())
