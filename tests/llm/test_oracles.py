import pytest

import corpus_pipeline
from compare import database, same_rows
from sightline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    assert same_rows(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], database(sf)) > 0


def test_entry_lists_them(spark):
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
