"""Cases where an operator once did less than its whole job."""

from graphspark.functions.values import NON_FUNCTIONAL
from graphspark.operators import intents


def test_all_non_functional_keywords(spark):
    rows = [(f"User: {k} of the page",) for k in NON_FUNCTIONAL] + [("User: View the rendered page",), ("Docker: View orders",)]
    assert sorted(r.intent for r in intents.filter_non_functional(spark.createDataFrame(rows, "intent string")).collect()) == ["Docker: View orders", "User: View the rendered page"]
