import re

from gleanix.llm import registry


def test_names_and_entry():
    import __spark_entry__

    names = set(registry.queries())
    assert all(re.fullmatch(r"p[1-9]_\w+", n) for n in names) and names <= set(__spark_entry__.queries())
    assert {f"p{n}_found" for n in (1, 3, 4, 5, 6, 9)} <= names
    assert set(registry.sql()) <= names


def test_sql_where_it_exists(same_as_sql):
    for name, sql in registry.sql().items():
        same_as_sql(registry.queries()[name], sql)
