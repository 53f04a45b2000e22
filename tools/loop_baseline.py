"""Comparison only: the sweep grid run the way the reference runs it -- one
separate job per (seed, m) cell, each re-reading and re-deriving the pairs --
against the one-plan sweep.  Times a few cells and extrapolates linearly.

    python tools/loop_baseline.py [sf_dir] [n_cells]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    n_cells = int(argv[2]) if len(argv) > 2 else 5
    from diffproto.operators import evaluate
    from diffproto.plans import experiment, registry, sweep
    from diffproto.session import get_spark

    spark = get_spark("local[8]", shuffle_partitions=8)
    registry.flagship_pairs(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
    cells = [(s, m) for s in sweep.REFERENCE_SEEDS for m in sweep.REFERENCE_SHOTS][:n_cells]
    t0 = time.time()
    for seed, m in cells:   # one job per cell, as the reference launches one process per cell
        scored = experiment.score(registry.flagship_pairs(spark, sf_dir), seed, m)
        evaluate.confusion_long(scored).collect()
    per_cell = (time.time() - t0) / len(cells)
    t1 = time.time()
    registry.q_sweep_summary(spark, sf_dir).write.format("noop").mode("overwrite").save()
    one_plan = time.time() - t1
    n_grid = len(sweep.REFERENCE_SEEDS) * len(sweep.REFERENCE_SHOTS)
    print(json.dumps({"sf_dir": sf_dir, "grid_cells": n_grid, "loop_sec_per_cell": round(per_cell, 3),
                      "loop_sec_extrapolated": round(per_cell * n_grid, 1),
                      "one_plan_sec": round(one_plan, 3)}))


if __name__ == "__main__":
    main(sys.argv)
