"""Edge rows of each operator, with literal data."""

import pytest
from pyspark.errors import PySparkException
from relflow.errors import WorkflowFault
from relflow.functions.registry import Registry
from relflow.workflow import query

INT2 = "WITH COLUMNS (INTEGER, INTEGER)"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ints(spark, data, width=2):
    return spark.createDataFrame(data, ", ".join(f"c{i} int" for i in range(width)))


def run(spark, text, result, registry=None, legacy=False, **tables):
    return rows(query(spark, text, tables, result, None, registry, legacy))


def test_set_operations_keep_left_multiplicity(spark):
    a = ints(spark, [(1, 2), (1, 2), (3, 4), (3, 4), (None, 5)])
    b = ints(spark, [(1, 2), (None, 5), (9, 9)])
    head = f"CREATE RELATION a {INT2}, CREATE RELATION b {INT2}, "
    assert run(spark, head + "(a) INTERSECT (b) AS x", "x", a=a, b=b) == rows(ints(spark, [(1, 2), (1, 2), (None, 5)]))
    assert run(spark, head + "(a) DIFFERENCE (b) AS x", "x", a=a, b=b) == [(3, 4), (3, 4)]
    assert len(run(spark, head + "(a) UNION (b) AS x", "x", a=a, b=b)) == 8


def test_left_constants(spark):
    head = "CREATE RELATION r WITH COLUMNS (INTEGER), "
    seven, two = ints(spark, [(7,)], 1), ints(spark, [(2,)], 1)
    assert run(spark, head + "SUB [5, r_0] FROM (r) AS x", "x", r=seven) == [(-2,)]
    assert run(spark, head + "SUB [5, r_0] FROM (r) AS x", "x", r=seven, legacy=True) == [(2,)]
    assert run(spark, head + "DIV [7, r_0] FROM (r) AS x", "x", r=two) == [(3,)]
    assert run(spark, head + "DIV [7, r_0] FROM (r) AS x", "x", r=two, legacy=True) == [(0,)]


def test_integer_division_truncates_and_zero_raises(spark):
    head = f"CREATE RELATION r {INT2}, "
    assert run(spark, head + "DIV [r_0, r_1] FROM (r) AS x", "x", r=ints(spark, [(-7, 2)])) == [(-3, 2)]
    with pytest.raises(PySparkException):
        run(spark, head + "DIV [r_0, r_1] FROM (r) AS x", "x", r=ints(spark, [(1, 0)]))


def test_aggregates(spark):
    d = spark.createDataFrame([("k", 2.0), ("k", 3.0)], "k string, v double")
    head = "CREATE RELATION d WITH COLUMNS (STRING, DOUBLE), "
    assert run(spark, head + "AGG [d_1, -] FROM (d) GROUP BY [d_0] AS x", "x", d=d) == [("k", -5.0)]
    assert run(spark, head + "AGG [d_1, /] FROM (d) GROUP BY [d_0] AS x", "x", d=d) == [("k", 1 / 6)]
    assert run(spark, head + "AGG [d_1, *] FROM (d) AS x", "x", d=d) == [("ALL", 6.0)]
    r = ints(spark, [(1, 5), (1, 7)])
    head = f"CREATE RELATION r {INT2}, "
    assert run(spark, head + "AGG [r_1, r_0, *] FROM (r) GROUP BY [r_0] AS x", "x", r=r) == [(1, 35, 1)]
    with pytest.raises(PySparkException):
        run(spark, head + "AGG [r_1, *] FROM (r) AS x", "x", r=ints(spark, [(0, 2**30 + 1), (0, 2**30 + 1)]))


def test_extremes(spark):
    t = spark.createDataFrame([("k", 5, 1), ("k", 5, 9), ("k", 4, 99)], "k string, a int, b int")
    head = "CREATE RELATION t WITH COLUMNS (STRING, INTEGER, INTEGER), "
    assert run(spark, head + "MAXIMUM [t_1, t_2] FROM (t) GROUP BY [t_0] AS x", "x", t=t) == [("k", 5, 9)]
    assert run(spark, head + "MINIMUM [t_1, t_2] FROM (t) AS x", "x", t=t) == [("ALL", 4, 99)]
    n = spark.createDataFrame([("k", -2.0), ("k", -1.0)], "k string, v double")
    assert run(spark, "CREATE RELATION n WITH COLUMNS (STRING, DOUBLE), MAXIMUM [n_1] FROM (n) GROUP BY [n_0] AS x", "x", n=n) == [("k", -1.0)]
    nulls = spark.createDataFrame([("k", None, 1), ("k", 5, 2), ("m", None, 3)], "k string, a int, b int")
    for word in ("MINIMUM", "MAXIMUM"):
        got = run(spark, head + f"{word} [t_1, t_2] FROM (t) GROUP BY [t_0] AS x", "x", t=nulls)
        assert sorted(got) == [("k", 5, 2), ("m", None, None)]


def test_empty_global_aggregates(spark):
    e = ints(spark, [])
    head = f"CREATE RELATION e {INT2}, "
    for text in ("AGG [e_0, +]", "MAXIMUM [e_0]", "MINIMUM [e_0]"):
        assert run(spark, head + f"{text} FROM (e) AS x", "x", e=e) == []
    assert run(spark, head + "COUNT [e_0] FROM (e) AS x", "x", e=e) == [("ALL", 0)]


def test_multi_key_join_pairs_in_listed_order(spark):
    a, b = ints(spark, [(1, 2)]), ints(spark, [(2, 1), (1, 2)])
    head = f"CREATE RELATION a {INT2}, CREATE RELATION b {INT2}, "
    assert run(spark, head + "(a) JOIN (b) ON a_0, a_1 AND b_1, b_0 AS x", "x", a=a, b=b) == [(1, 2)]


def test_sort_order(spark):
    r = ints(spark, [(i * 7 % 50, i) for i in range(50)])
    out = query(spark, f"CREATE RELATION r {INT2}, SORT DEC ON [r_0] FROM (r) WHERE [(r_1 < 40)] AS x", {"r": r}, "x").collect()
    assert [x[0] for x in out] == sorted((x[0] for x in out), reverse=True) and len(out) == 40


@pytest.mark.parametrize(("test", "passes"), [("<", 5), ("<=", 6), ("<>", 5)])
def test_counted_loops(spark, test, passes):
    text = f"CREATE RELATION l WITH COLUMNS (INTEGER), CREATE RELATION v WITH COLUMNS (INTEGER), WHILE [(l_0 {test} 5)] DO (SUM [v_0, 10] FROM (v) AS v, SUM [l_0, 1] FROM (l) AS l)"
    assert run(spark, text, "v", l=ints(spark, [(0,)], 1), v=ints(spark, [(0,), (1,)], 1)) == [(10 * passes,), (10 * passes + 1,)]


def test_loop_false_at_start_and_several_passes_per_cut(spark):
    head = "CREATE RELATION l WITH COLUMNS (INTEGER), "
    assert run(spark, head + "WHILE [(l_0 < 0)] DO (SUM [l_0, 1] FROM (l) AS l)", "l", l=ints(spark, [(3,)], 1)) == [(3,)]
    assert run(spark, head + "WHILE [(l_0 < 23)] DO (SUM [l_0, 2] FROM (l) AS l)", "l", l=ints(spark, [(0,)], 1)) == [(24,)]


def test_data_dependent_loop_and_its_one_row_rule(spark):
    text = f"CREATE RELATION v {INT2}, AGG [v_1, +] FROM (v) AS t, WHILE [(t_1 < 100)] DO (MUL [v_1, 3] FROM (v) AS v, AGG [v_1, +] FROM (v) AS t)"
    assert run(spark, text, "v", v=ints(spark, [(0, 1), (1, 4)])) == [(0, 27), (1, 108)]
    with pytest.raises(WorkflowFault):
        run(spark, f"CREATE RELATION v {INT2}, WHILE [(v_0 < 3)] DO (SUM [v_0, v_1] FROM (v) AS v)", "v", v=ints(spark, [(0, 1), (0, 2)]))


def test_nested_loops(spark):
    text = """CREATE RELATION i WITH COLUMNS (INTEGER), CREATE RELATION z WITH COLUMNS (INTEGER), CREATE RELATION v WITH COLUMNS (INTEGER),
    WHILE [(i_0 < 3)] DO (PROJECT [z_0] FROM (z) AS j, WHILE [(j_0 < 2)] DO (SUM [v_0, 1] FROM (v) AS v, SUM [j_0, 1] FROM (j) AS j), SUM [i_0, 1] FROM (i) AS i)"""
    one = lambda: ints(spark, [(0,)], 1)
    assert run(spark, text, "v", i=one(), z=one(), v=one()) == [(6,)]


def test_functions_and_sources(spark):
    r = Registry().row_function("Swap", lambda t: (t[1], t[0])).frame_function("Twice", lambda df: df.selectExpr("r_0 * 2")).source("/jobs/x", lambda s: s.range(3).selectExpr("id", "cast(id as string)"))
    head = f"CREATE RELATION r {INT2}, "
    data = ints(spark, [(1, 2)])
    assert run(spark, head + "UDF /f Swap ON r AS x WITH COLUMNS (INTEGER, INTEGER)", "x", r, r=data) == [(2, 1)]
    assert run(spark, head + "UDF /f Twice ON r AS x WITH COLUMNS (INTEGER)", "x", r, r=data) == [(2,)]
    assert run(spark, "BLACK BOX any /jobs/x AS x WITH COLUMNS (INTEGER, STRING)", "x", r) == [(0, "0"), (1, "1"), (2, "2")]
    with pytest.raises(WorkflowFault):
        run(spark, head + "UDF /f None ON r AS x WITH COLUMNS (INTEGER)", "x", r, r=data)
