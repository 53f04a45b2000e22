import pytest

from diffproto.operators import drift as D
from conftest import rows


def test_drift_consecutive_and_from_base(spark):
    # one class, vectors 0, 2, 4 (d = 1) in rank order: keys chosen so the
    # seeded order is known, then checked against the running mean
    from diffproto.operators.sampling import top_per_class

    base = spark.createDataFrame([(i, 0, 0) for i in range(3)], "claim_id bigint, set_pos int, label int")
    order = [r[1] for r in sorted(rows(top_per_class(base, 1, 3), "rank", "claim_id"))]
    vals = {cid: float(2 * k) for k, cid in enumerate(order)}
    pairs = spark.createDataFrame([(cid, 0, 0, [vals[cid]]) for cid in vals],
                                  "claim_id bigint, set_pos int, label int, diff array<double>")
    run = sorted(rows(D.running_prototypes(pairs, 1, 3), "rank", "c"))
    assert run == [(1, 0.0), (2, 1.0), (3, 2.0)]
    cons = sorted(rows(D.drift_pairs(pairs, 1, [(1, 2), (2, 3)]), "start", "drift"))
    assert cons == [(1, 1.0), (2, 1.0)]
    fb = sorted(rows(D.drift_from_base(pairs, 1, [1, 2, 3]), "step", "s"))
    assert fb == [(1, 1.0), (2, 1.0)]          # 1/1 and 2/2


def test_class_smaller_than_m_carries_last(spark):
    pairs = spark.createDataFrame([(0, 0, 0, [1.0]), (1, 0, 0, [3.0])],
                                  "claim_id bigint, set_pos int, label int, diff array<double>")
    d = sorted(rows(D.drift_pairs(pairs, 1, [(2, 3), (3, 4)]), "start", "drift"))
    assert d == [(2, 0.0), (3, 0.0)]
