"""The corpus queries against their SQL."""

import compare
import pytest

from hazardloom.llm import queries as corpus

QUERIES, ORACLES = corpus.queries(), corpus.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert compare.difference(QUERIES[name](spark, sf_dir), compare.connect(sf_dir), ORACLES[name]) is None


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
