"""Blocks and borders counted where the texts are, against the tables of blocks."""

import numpy as np
import pytest

from glyphgrid.operators import count, factorize
from glyphgrid.plans.catalogue import QUERIES

from test_index import case  # noqa: F401
from test_odd_texts import odd, planned  # noqa: F401


@pytest.mark.parametrize("mixing", [True, False])
def test_blocks_counted_in_place(case, monkeypatch, mixing):  # noqa: F811
    """Without mixing all hashes are equal: what differs is told apart by its characters."""
    rows = case[0].coalesce(1)
    blocks = factorize.factors(rows, 5).collect()
    texts = {r.doc_id: r.text for r in rows.collect()}
    freq, met = {}, {}
    for r in blocks:
        end = r.start + r.len
        pair = (r.factor[-2:], texts[r.doc_id][end : end + 2])
        freq[r.factor], met[pair] = freq.get(r.factor, 0) + 1, met.get(pair, 0) + 1
    if not mixing:
        monkeypatch.setattr(factorize, "mixed", lambda a, b: np.zeros(len(a), np.uint64))
    monkeypatch.setattr(factorize, "CHARS_AT_ONCE", 100)
    assert {r.factor: r.freq for r in factorize.factor_counts(rows, 5).collect()} == freq
    assert {(r.factor, r.next): r.n for r in factorize.borders(rows, 5, 2).collect()} == met


def test_decomposition_from_borders(case):  # noqa: F811
    rows, own = case[0], ["a", "ab", "aa", "ca", "gca"]
    dictionary = factorize.factor_counts(rows, 7)
    inner = factorize.sub_factors(dictionary)
    one = count.decomposition(factorize.factors(rows, 7), dictionary, inner, own, 7).collect()
    assert sorted(one) == sorted(count.decomposition(None, dictionary, inner, own, 7, factorize.borders(rows, 7, 2)).collect())


@pytest.mark.parametrize("name", ["count_decomposition", "suffix_range_count", "prefix_range_count", "sub_factor_counts"])
def test_no_blocks_move(spark, odd, name):  # noqa: F811
    plan = planned(QUERIES[name](spark, odd[0]))
    assert "Window" not in plan and "ord#" not in plan
