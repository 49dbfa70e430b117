"""Demand-driven assembly (operators.assembly): rows of the whole view, only the joins that are needed."""

import itertools
import os
import sys

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.assembly import Block, Derive, Expand, Only, assemble, needed_steps

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture()
def view(spark):
    base = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 40)], "id int, k int")
    one = spark.createDataFrame([(10, "a"), (20, "b")], "k int, x string")
    many = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p")], "id int, y string")
    inner = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id int, z int")
    built = []

    def block(name, df, **how):
        on = df.columns[0]
        return Block([on], df.columns[1:], lambda used: built.append((name, frozenset(used))) or df, **how)
    steps = [block("one", one), block("many", many, many=True), Only(["id"], F.col("id") < 4), block("inner", inner, inner=True),
             Derive("zz", ["z"], F.col("z") * 2), Expand("e", ["z"], F.sequence(F.lit(1), F.col("z") - 4)), Derive("xe", ["x", "e"], F.concat("x", "e"))]
    return base, steps, built


def test_every_choice_of_columns_has_the_rows_of_the_whole_view(view):
    base, steps, _ = view
    names = ["id", "k", "x", "y", "z", "zz", "e", "xe"]
    whole = [tuple(r) for r in assemble(base, steps, names).collect()]
    assert len(whole) == 7           # id 1 twice, id 2 twice for e, id 3 three times
    for n in (1, 2, 3):
        for some in itertools.combinations(names, n):
            got = sorted(str(tuple(r)) for r in assemble(base, steps, some).collect())
            assert got == sorted(str(tuple(r[names.index(c)] for c in some)) for r in whole), some


def test_only_needed_blocks_are_built(view):
    base, steps, built = view
    assemble(base, steps, ["id", "zz"])
    assert built == [("many", frozenset()), ("inner", frozenset({"z"}))]
    assert needed_steps(steps, ["xe"])[1] == {"id", "k"}
    with pytest.raises(ValueError, match="nope"):
        assemble(base, steps, ["nope"])


def test_burndown_reads_less_than_the_status_and_keeps_its_rows(spark):
    import __spark_entry__  # noqa: F401
    from ledgerline.plans.status import STATUS_COLUMNS, _status
    from ledgerline.sources import load_tables

    t = load_tables(spark, "/root/testdata/sf0.001")
    some = ["customer_id", "next_expected_deduction_date"]
    whole, narrow = _status(spark, t), _status(spark, t, some)
    assert list(STATUS_COLUMNS) == whole.columns and narrow.columns == some
    assert sorted(map(str, narrow.collect())) == sorted(map(str, whole.select(*some).collect()))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")
    assert scans(narrow) < scans(whole)
    assert "ledgerline_" not in narrow._jdf.queryExecution().optimizedPlan().toString()      # neither ledger nor schedule
