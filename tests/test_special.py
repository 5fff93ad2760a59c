"""Distribution functions against published tables, and identities."""

import math

import numpy as np
import pytest

from tallygrove.functions import special
from tallygrove.operators.tests_param import shapiro


def test_published_critical_values():
    assert special.t_ppf(0.975, 10) == pytest.approx(2.228, abs=5e-4)
    assert special.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=5e-5)
    assert special.f_sf(4.103, 2, 10) == pytest.approx(0.05, abs=5e-5)
    assert special.studentized_range_sf(3.877, 3, 10) == pytest.approx(0.05, abs=5e-4)
    assert special.studentized_range_ppf(0.95, 3, 10) == pytest.approx(3.877, abs=5e-3)
    assert special.norm_cdf(1.96) == pytest.approx(0.9750, abs=5e-5)
    assert special.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-5)


def test_tails_add_up():
    for t in (-2.5, 0.0, 1.3):
        assert special.t_sf(t, 7) + special.t_sf(-t, 7) == pytest.approx(1)
    assert special.f_sf(2.3**2, 1, 12) == pytest.approx(2 * special.t_sf(2.3, 12))
    assert special.chi2_sf(4.0, 2) == pytest.approx(math.exp(-2))


def test_exact_rank_distributions_by_enumeration():
    from itertools import combinations

    us = [sum(c) - 6 for c in combinations(range(1, 8), 3)]
    for u in range(13):
        assert special.mannwhitney_exact_sf(u, 3, 4) == pytest.approx(sum(x >= u for x in us) / len(us))
    ws = [sum(r for r in range(1, 7) if m >> (r - 1) & 1) for m in range(64)]
    for w in range(22):
        assert special.wilcoxon_exact_cdf(w, 6) == pytest.approx(sum(x <= w for x in ws) / 64)


def test_shapiro_of_a_published_sample():
    # Royston's (1982) example of weights of 11 men: W = 0.79
    x = np.sort(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    w, p = shapiro(x)
    assert w == pytest.approx(0.79, abs=0.01)
    assert p < 0.01
