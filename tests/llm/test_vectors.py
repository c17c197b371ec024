"""Embedding links: recall near the least cosine with components, odd vectors, windows."""

import numpy as np

from shelfmark.llm import vectors


def truth(x, cosine=0.9):
    """(links, smallest vector reachable) of each row, by all cosines."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    top = np.arange(len(x))
    while True:
        low = np.where(linked, top[None, :], len(x)).min(1, initial=len(x))
        new = np.minimum(top, low)
        if (new == top).all():
            return linked, top
        top = new


def planted(rng, n, dim, pairs, groups):
    """Random vectors, partners at cosines of 0.90 to 0.92, groups of near copies, exact copies."""
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, dim))
    y -= (y * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9002, 0.92, (pairs, 1))
    near = c * x[:pairs] + np.sqrt(1 - c * c) * y
    packs = [x[-k - 1] + 0.03 * rng.standard_normal((120, dim)) for k in range(groups)]
    return np.vstack([x, near, *packs, x[:7], 3 * x[7:9]])


def frame(spark, x, kind="float"):
    return spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>, hash int").repartition(3)


def test_recall_of_links_just_above_the_least_cosine_and_components(spark):
    rng = np.random.default_rng(12)
    x = planted(rng, 1500, 64, 400, 3).astype(np.float32)
    linked, top = truth(x.astype(float))
    out = sorted(vectors.vector_links(frame(spark, x)).collect())
    n, component = np.array([r.n_links for r in out]), np.array([r.component_id for r in out])
    assert [r.vec_id for r in out] == [*range(len(x))] and all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert (n <= linked.sum(1)).all() and n.sum() >= 0.98 * linked.sum()
    at_threshold = slice(1500, 1900)  # each has one partner
    assert n[at_threshold].sum() >= 0.9 * linked.sum(1)[at_threshold].sum()
    # components only ever fall apart where a link was missed, and never join what isn't joined
    assert all(len(set(top[component == c])) == 1 for c in set(component))
    assert (component == top).mean() >= 0.97


def test_odd_vectors_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0, 0.0, 0.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [-inf, 1.0, 1.0], [None, 1.0, 1.0]]
    good = [[1.0, 1.0, 1.0], [2.0, 2.0, 2.0], [-1.0, -1.0, -1.0], [1.0, 1.0], [1e-30, 1e-30, 1e-30], [-0.0, 0.0, 1.0], [0.0, 0.0, 1.0]]
    rows = [(i, v) for i, v in enumerate(odd)] + [(100 + i, v) for i, v in enumerate(good)] + [(100, [1.0, 1.0, 1.0]), (None, [5.0, 5.0, 5.0])]
    for kind in ("float", "double"):
        out = vectors.vector_links(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
        by = {}
        for r in out:
            by.setdefault(r.vec_id, set()).add((r.n_links, r.component_id, r.kept))
        assert len(out) == len(rows) and all(by[i] == {(0, i, True)} for i in range(len(odd)))
        assert by[100] == {(4, 100, True)} and by[101] == by[104] == {(4, 100, False)} and by[None] == {(4, 100, False)}
        assert by[102] == {(0, 102, True)} and by[103] == {(0, 103, True)} and by[105] == {(1, 105, True)} and by[106] == {(1, 105, False)}


def test_windows_are_centred_on_queries():
    rng = np.random.default_rng(13)
    left, right = (np.sort(rng.integers(-3 * vectors.STEPS, 3 * vectors.STEPS, 60)) for _ in range(2))
    right[:5] = left[:5] + vectors.REACH
    right.sort()
    pairs = set(zip(*map(np.ndarray.tolist, vectors._windows(left, right, False))))
    assert pairs == {(i, j) for i in range(60) for j in range(60) if abs(left[i] - right[j]) <= vectors.REACH}
    pairs = set(zip(*map(np.ndarray.tolist, vectors._windows(left, left, True))))
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if left[j] - left[i] <= vectors.REACH}


def test_calibration_holds_at_any_size():
    for n in (1, 500, 50_000, 10**10):
        nested, bands, least = vectors.calibrate(n)
        apart = vectors._same_cell(2**0.5, vectors.CELL) ** nested * vectors._in_window(2**0.5)
        assert n * apart <= vectors.MATES * 1.01 and 0 < least < vectors.COUNTED and bands >= 1
        assert 1 - (1 - vectors._same_cell(0.2**0.5, vectors.CELL) ** nested * vectors._in_window(0.2**0.5)) ** bands >= vectors.RECALL
