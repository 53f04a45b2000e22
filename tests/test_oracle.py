"""Driver-style check: Spark query vs DuckDB SQL twin (row count, columns,
order-insensitive value hash) on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from conftest import SF_SMALL  # noqa: E402

QUICK = ["flatten_pairs", "flatten_first_evidence", "corpus_pairs", "corpus_dedup", "fit_sample", "dev_complement",
         "binary_split", "pair_diff_abs", "dist_tsss", "encode_hashing", "prototypes", "predict_three",
         "f1_per_class", "errors_wrong", "drift_from_base", "sweep_summary", "parse_runs"]


@pytest.fixture(scope="module")
def duck():
    import oracle_check

    return oracle_check.duck(SF_SMALL)


def test_every_query_of_the_core_has_sql():
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    from diffproto.plans import oracle, registry

    assert set(sql) <= set(qs)
    assert set(registry.REGISTRY) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, duck, name):
    import oracle_check

    import __spark_entry__ as E

    r = oracle_check.compare(spark, duck, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["cols_match"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["hash_match"], r


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert {"accuracy", "f1_macro", "seed", "m"} <= set(df.columns)
