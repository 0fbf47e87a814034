from pyspark.sql import functions as F
from test_graph import edges, u

from rookery.operators import graph as G

N = 20


def test_chains_of_any_length_and_cycles(spark):
    step = spark.createDataFrame([("r", f"M{i}", f"m{i + 1}") for i in range(N)] + [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a")], "root string, module string, superclass_module string")
    got = {tuple(r) for r in G.superclass_chain(step).collect()}
    assert got == {("r", f"m{i}", f"m{j}") for i in range(N) for j in range(i + 1, N + 1)} | {("s", a, b) for a in "abc" for b in "abc"}


def test_macros_nested_to_any_depth(spark):
    rows = [u("c", "m/g", calls=["mac0"]), *[u(f"mac{i}", f"m/mac{i}") for i in range(N)], u("t", "m/target"), u("z", "m/other")]
    nxt = F.concat(F.lit("mac"), (F.regexp_extract("unit_id", r"(\d+)", 1).cast("int") + 1).cast("string"))
    gen = F.when(F.col("unit_id") == f"mac{N - 1}", F.array(F.lit("target"), F.lit("mac0"))).when(F.col("unit_id").like("mac%"), F.array(nxt)).otherwise(F.array().cast("array<string>"))
    op = F.when(F.col("unit_id").like("mac%"), "defmacro").otherwise("defn")
    assert edges(spark, rows, form_operator=op, generated_calls=gen) == [("c", "mac0"), ("c", "t")]
