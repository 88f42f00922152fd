import pytest

from lakewarden.plans import registry
from tests import oracle

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, data, duck):
    oracle.check(registry.queries()[name], SQL[name], spark, data, duck)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs_with_stable_schema(name, spark, data):
    df = registry.queries()[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.count()


def test_decontaminate_against_brute_force(spark, data):
    from lakewarden.functions.text import words

    held = {tuple(words(r.question)) for r in spark.read.parquet(f"{data}/qa_heldout.parquet").collect() if r.question is not None}
    qa = spark.read.parquet(f"{data}/qa.parquet").collect()
    want = sorted(r.id for r in qa if r.question is not None and tuple(words(r.question)) not in held)
    assert sorted(r.id for r in registry.queries()["decontaminate"](spark, data).collect()) == want
