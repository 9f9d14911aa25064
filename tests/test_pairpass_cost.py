"""What a pair of blocks holds at a time and hands on."""

import numpy as np
import pandas as pd

from tallyscope.operators import pairpass


def test_distances_fit_a_cache_and_labels_take_one_row():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 64)), rng.normal(size=(4096, 64))
    a, b = (pd.DataFrame({"id": np.arange(len(v)), "v": list(v), "name": [f"n{i % 7}" if i % 11 else None for i in range(len(v))]}) for v in (x, y))
    sums = pairpass.LabelSums("name")
    sums.start(a, b, True)
    for part, d2 in pairpass.distance_rows(x, y):
        assert d2.nbytes <= 1 << 21
        sums.see(part, d2)
    near, far = (pd.DataFrame(side) for side in sums.rows())
    assert len(near) == a["name"].count() and len(far) == b["name"].count()
    d = np.sqrt(((x[5] - y) ** 2).sum(1))
    row = near[near["_id"] == 5].iloc[0]
    for t, s, n in zip(row["_tags"], row["_xs"], row["_ns"], strict=True):
        own = (b["name"] == t).to_numpy()
        assert n == own.sum() and abs(s - d[own].sum()) < 1e-9 * s


def test_squares_of_very_different_size_do_not_hide_what_cancels():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 64)) * np.where(np.arange(40) % 2, 1e-3, 1e3)[:, None]
    y = np.vstack([x[::-1], x + 1e-9])
    got = np.concatenate([d for _, d in pairpass.distance_rows(x, y)])
    i, j = np.divmod(np.arange(got.size), len(y))
    want = pairpass.differences(x, y, i, j).reshape(got.shape)
    assert (got[np.arange(40), np.arange(40)[::-1]] == 0).all() and np.allclose(got, want, rtol=1e-12, atol=0)


def test_roots_are_shared_and_limits_hold_to_the_last_bit():
    limits = np.array([0.0, -1.0, 1e-160, 1.0, 0.1, 9.0, 11.3, 1 / 3, 1e5, np.nan])
    squares = pairpass._square(limits)
    assert np.isnan(squares[-1]) and not squares[:2].any()
    some = squares[3:-1]
    assert (np.sqrt(some) >= limits[3:-1]).all() and (np.sqrt(np.nextafter(some, 0)) < limits[3:-1]).all()
    rng = np.random.default_rng(3)
    d2 = np.concatenate([rng.random(2000) * 200, some, np.nextafter(some, 0), np.nextafter(some, np.inf)])
    for limit, square in zip(limits, squares, strict=True):
        assert ((np.sqrt(d2) < limit) == (d2 < square)).all()
    # rows come with what answers in one span, whatever their ids
    f = pd.DataFrame({"id": [5, 1, 4, 2, 3], "_answers": [True, False, True, False, True], "_first": pd.Series([True, None, True, False, True], dtype=object)})
    assert pairpass.ordered(f)["id"].tolist() == [3, 4, 5, 2, 1] and "_side" not in pairpass.ordered(f)
    assert pairpass._span(np.array([False, True, True, False])) == slice(1, 3) and isinstance(pairpass._span(np.array([True, False, True])), np.ndarray)
