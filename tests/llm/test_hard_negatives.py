"""Hard negatives against scoring every pair."""

from __future__ import annotations

import math

import numpy as np
import pytest

from vinculum.llm import hard_negatives as hn


def rows():
    """(id, label, vector): clusters, copies of one vector, one label with a third of the rows, odd rows."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 0.4, (6, 12))
    out = []
    for i in range(420):
        label = 9 if i % 3 == 0 else int(rng.integers(0, 8))
        vector = centres[label % 6] + rng.normal(0, 0.15, 12) if i % 4 else centres[0]
        out.append((i, label, [float(x) for x in vector.astype(np.float32)]))
    out += [(500, 1, [0.5] * 12), (550, 77, [0.5] * 12), (600, 1, [0.0] * 12), (601, 2, [0.0] * 12), (650, 1, [-0.5] * 12), (700, 3, [0.5] * 3), (701, 3, [0.5] * 20), (702, 4, [])]
    out += [(750, None, [0.5] * 12), (751, 1, None), (752, 1, [None] + [0.5] * 11), (753, 1, [math.nan] + [0.5] * 11), (754, 1, [math.inf] + [0.5] * 11), (None, 1, [0.5] * 12)]
    out += [out[50], out[50], out[51], (50, 5, [0.3] * 12), (51, 5, [0.4] * 12)]
    return out


def by_hand(data, is_anchor, positives=5, negatives=3, low=50, high=95):
    usable = []
    for i, label, v in data:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, label, tuple(math.floor(256 * x) for x in v)))
    usable = sorted(set(usable))
    out = []
    for i, label, q in usable:
        if not is_anchor(i):
            continue
        pairs = {(sum(a * b for a, b in zip(q, other, strict=False)), k, l == label) for k, l, other in usable if k != i}
        same = sorted(((s, k) for s, k, is_same in pairs if is_same), key=lambda x: (-x[0], x[1]))[:positives]
        rest = sorted(((s, k) for s, k, is_same in pairs if not is_same), key=lambda x: (-x[0], x[1]))
        for ps, p in same:
            inside = [(s, k) for s, k in rest if low * ps <= 100 * s <= high * ps][:negatives]
            out += [(i, p, rank, k, ps, s) for rank, (s, k) in enumerate(inside, 1)]
    return sorted(out)


def frame(spark, data):
    clashing = "block int, anchor int, wanted string, score int, columns int, rank int"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5) for r in data], f"vec int, label smallint, v array<float>, {clashing}").repartition(5)


@pytest.mark.parametrize(("block_rows", "anchor_rows", "cell_blocks"), [(16, 3, 2), (4096, 256, 16)])
def test_all_pairs(spark, block_rows, anchor_rows, cell_blocks):
    usable = hn.usable(frame(spark, rows()), "vec", "label", "v")
    found = hn.hard_negatives(usable, usable.where("id % 10 = 0"), block_rows=block_rows, anchor_rows=anchor_rows, cell_blocks=cell_blocks)
    assert sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == by_hand(rows(), lambda i: i % 10 == 0)


def test_numbers_too_large_for_doubles(spark):
    data = [(i, i % 2, [float(x) for x in np.random.default_rng(i).integers(-(2**19), 2**19, 8).astype(np.float32)]) for i in range(0, 60)]
    data += [(100, 0, [2.0**24, 1.0]), (101, 1, [0.0, 3.0])]
    usable = hn.usable(spark.createDataFrame(data, "vec bigint, label int, v array<float>"), "vec", "label", "v")
    found = hn.hard_negatives(usable, usable.where("id % 10 = 0"), block_rows=16)
    columns = found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in columns.collect()) == by_hand(data, lambda i: i % 10 == 0)


def test_no_rows(spark):
    none = hn.usable(frame(spark, rows()).where("false"), "vec", "label", "v")
    assert hn.hard_negatives(none, none).collect() == []
    lonely = hn.usable(spark.createDataFrame([(50, 1, [0.5])], "vec bigint, label int, v array<float>"), "vec", "label", "v")
    assert hn.hard_negatives(lonely, lonely).collect() == []


def block(m, label=0):
    return hn.Block(label, np.arange(len(m)), [np.ascontiguousarray(c, "<i4").tobytes() for c in m.T], m.min(axis=0), m.max(axis=0), np.dtype("<i4"))


def test_bounds_spare_dimensions_and_blocks():
    """Few dimensions are read for most candidates, none of a block that cannot hold one."""
    rng = np.random.default_rng(1)
    q = np.round(200 * 0.9 ** np.arange(64)).astype(np.int64)
    near, far = block(rng.integers(-20, 20, (4096, 64))), block(rng.integers(-20, 20, (4096, 64)) - 300)
    whole = np.frombuffer(b"".join(near.columns), "<i4").reshape(64, -1).T @ q
    score, ids = hn.best(q, -1, [near, far], 5)
    order = np.lexsort((np.arange(4096), -whole))[:5]
    assert score.tolist() == whole[order].tolist() and ids.tolist() == order.tolist()
    assert far.read == 0 and near.read < 0.6 * 4096 * 64
    near.read = 0
    first, last = np.array([score[-1] - 50]), np.array([score[-1] - 10])
    inside = [(s, i) for s, i in sorted(zip(-whole, range(4096), strict=True)) if first[0] <= -s <= last[0]][:3]
    got = hn.best_in_windows(q, -1, [near, far], first, last, 3)
    assert [(-s, i) for s, i in zip(*got[0], strict=True)] == inside
    assert far.read == 0 and near.read < 0.6 * 4096 * 64


def test_windows_round_inwards():
    first, last = hn.windows([101, 1, 0, -7], 50, 95)
    assert first.tolist() == [51, 1, 0, -3] and last.tolist() == [95, 0, 0, -7]
