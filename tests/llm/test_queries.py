import pytest

from lakewarden.llm import queries
from tests import oracle

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, data):
    oracle.check(queries.queries()[name], SQL[name], spark, data, oracle.connect(data))


@pytest.mark.parametrize("name, columns", [("p1_found", ["candidate_id_a", "candidate_id_b"]), ("p2_found", ["heldout_id", "qa_id"]), ("p4_found", ["candidate_id"]), ("p5_found", ["origin", "record_id", "kind"]), ("p6_found", ["item_id", "doc_id"]), ("p8_found", ["doc_id"])])
def test_found_has_its_columns_and_distinct_rows(name, columns, spark, data):
    df = queries.queries()[name](spark, data)
    assert df.columns == columns
    assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(name, spark, data):
    queries.queries()[name](spark, data).count()


def test_both_tables_have_their_policy_version(spark, data):
    for name in ("p3_policy_percentiles", "p3_policy_months"):
        rows = queries.queries()[name](spark, data).where("origin = 'layer2_results'")
        assert rows.where("policy_version is not null").count() > 0 and rows.where("policy_version is null").count() == 0


def test_rest_does_not_import_this_subpackage():
    import os
    import re

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "lakewarden")):
        if os.path.basename(folder) != "llm" and "__pycache__" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"lakewarden\.llm|from \.+llm", open(os.path.join(folder, n), encoding="utf-8").read().replace('* ``llm``', "")), n
