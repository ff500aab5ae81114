"""Every query against its SQL, and the invariants of those without one."""

import pytest
from compare import connect, differences
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agrees_with_sql(spark, folder, connection, name):
    assert differences(queries()[name], oracle_sql()[name], spark, connection, folder) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_is_the_transition_table(spark):
    assert {"user_id", "step", "dim", "obs", "action", "reward", "terminal"} <= set(entry(spark).columns)


def test_vectors_have_their_width(spark, folder):
    assert {r.width for r in queries()["description_word2vec"](spark, folder).select("width").collect()} == {128}
    rows = queries()["feature_vector"](spark, folder).collect()
    assert {(r.width, r.has_nan) for r in rows} == {(324, False)}
