"""What plans look like: pruned scans, pushed filters, no Python and no cross products."""

import re

import pytest
from conftest import DATA

from tessera.plans import catalog

#: Queries that leave the JVM, each for a reason.
PYTHON = {
    "cosine_topk": "matrix products", "llm_split": "a sequential cut", "summary_compat": "formatted on the driver", "cdc_stream": "a written stream",
    "source_excel": "a file format of our own", "binning_function": "a function over arrays of texts", "llm_infer": "a model", "llm_stack": "JSON merged by Python",
    "qa_chunks": "a sequential cut and a model", "vector_search": "matrix products",
}
#: Joins without an equality are what these are about, or have one row on a side.
UNEQUAL = {"cross_join", "theta_join", "range_join", "late_filter", "scalar_subquery", "summary_nist_percentile", "summary_quartiles", "roc_points", "auc", "onehot_index", "row_ids", "cte", "pk_candidate"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(PYTHON)))
def test_plans_stay_in_the_jvm(spark, name):
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert not re.search(r"\w*(Python|Pandas|Arrow)\w*(Eval|Map|Group|Aggregate)", text)
    if name not in UNEQUAL:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    ("name", "pushed", "columns"),
    [
        ("pricing_summary", "LessThanOrEqual(l_shipdate", {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"}),
        ("drop_missing", None, {"o_orderkey", "o_orderstatus"}),
        ("in_subquery", "EqualTo(c_mktsegment,BUILDING)", None),
        ("assert_unique_key", None, {"o_orderkey", "o_custkey"}),
        ("binning_predict", None, {"l_extendedprice"}),
        ("group_by_having", None, {"l_suppkey", "l_quantity"}),
    ],
)
def test_scans_read_what_they_need(spark, name, pushed, columns):
    text = plan(catalog.QUERIES[name](spark, DATA))
    if pushed:
        assert pushed in text
    if columns:
        schemas = [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]
        assert schemas and all(s <= columns for s in schemas)
