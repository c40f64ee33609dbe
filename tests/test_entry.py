import inspect

import __spark_entry__ as entry
from marlstone import plans


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(plans.queries()) > 130


def test_every_query_names_what_it_covers():
    assert set(plans.COVERS) == set(plans.queries()) and all(plans.COVERS.values())


def test_no_query_is_capped_by_ids():
    for name, f in plans.queries().items():
        source = inspect.getsource(f)
        assert ".sample(" not in source and "head(" not in source, name


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() == 3 and {"k", "precision", "recall", "ndcg", "map"} <= set(found.columns)
