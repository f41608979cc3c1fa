"""Every query of the library's own operators against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from conftest import SF
from compare import rows

from gleanmill.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries()
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_tables_are_covered(spark):
    n = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    judged = QUERIES["sf51_question_rules"](spark, SF).toPandas()
    assert len(judged) == n("conversations") and (judged.fault == "length").any()
    assert QUERIES["sf17_mask_variables"](spark, SF).count() == n("pages")
    assert QUERIES["agg9_term_frequency"](spark, SF).filter("df < 3").count() > 0
