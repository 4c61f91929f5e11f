"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as contract
from oracle_check import differences

ORACLE = contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    assert differences(contract.queries()[name](spark, sf_dir), sf_dir, ORACLE[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["id", "text", "metadata", "similarity"]
    assert rows.count() > 0


def test_recall(spark, sf_dir):
    row = contract.queries()["ann_recall"](spark, sf_dir).first()
    assert row.n_queries == 500 and row.recall == 1.0


def test_recall_is_that_asked_of_an_index(spark, sf_dir):
    assert contract.queries()["ann_recall"](spark, sf_dir).first().recall >= 0.9
