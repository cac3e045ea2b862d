import __spark_entry__ as entry
from waybill.plans import registry


def test_core_queries_run_on_small_tables(spark, sf):
    for name, query in registry.QUERIES.items():
        assert query(spark, sf).count() >= 0, name


def test_every_oracle_has_its_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "waybill.llm" not in path.read_text(), path
