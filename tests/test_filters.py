from __future__ import annotations

import pytest

import skyledger as sl


def test_nothing_picked_means_everything():
    assert sl.FilterSpec.from_selection() == sl.FilterSpec()
    assert sl.FilterSpec().classes == ("E", "P", "B")


def test_picked_values_become_codes():
    spec = sl.FilterSpec.from_selection(["Business", "Economy"], ["ASIA"], "1998", 30)
    assert spec == sl.FilterSpec(("B", "E"), ("ASIA",), 1998, 30)


@pytest.mark.parametrize("top_n", [0, 4, 31, 100_000])
def test_top_n_may_have_any_size(top_n):
    assert sl.FilterSpec.from_selection(top_n=top_n).top_n == top_n


def test_unknown_cabin_is_refused():
    with pytest.raises(ValueError, match="First"):
        sl.FilterSpec.from_selection(["First"])


def test_negative_top_n_is_refused():
    with pytest.raises(ValueError, match="negative"):
        sl.FilterSpec(top_n=-1)
