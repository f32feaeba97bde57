"""Sources, sinks, front ends, plans and the driver's queries against SQL."""

import pytest
from relflow import cli, workloads
from relflow.api import relation
from relflow.errors import AnalysisFault
from relflow.sources.catalog import Catalog
from relflow.streaming import runner
from relflow.vertex import vertex_program
from relflow.workflow import Workflow

TEXT = "CREATE RELATION e WITH COLUMNS (INTEGER, DOUBLE, STRING), AGG [e_1, +] FROM (e) GROUP BY [e_2] AS t"


def test_text_in_and_out(spark, tmp_path):
    (tmp_path / "in" / "e").mkdir(parents=True)
    (tmp_path / "in" / "e" / "part").write_text("1 2.5 a\n2 0.5 a\n3 1.0 b\n")
    (tmp_path / "w.flow").write_text(TEXT)
    assert cli.main(["run", str(tmp_path / "w.flow"), "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out")]) == 0
    lines = sorted(line for p in (tmp_path / "out" / "t").glob("part-*") for line in p.read_text().splitlines())
    assert lines == ["a 3.0", "b 1.0"]
    assert Workflow(TEXT).save(Catalog(spark, str(tmp_path / "in")), str(tmp_path / "pq"), "parquet") == ["t"]
    assert spark.read.parquet(str(tmp_path / "pq" / "t")).count() == 2


def test_explain_command(tmp_path, capsys):
    (tmp_path / "w.flow").write_text(TEXT)
    cli.main(["explain", str(tmp_path / "w.flow")])
    assert "AGG + t (STRING, DOUBLE)" in capsys.readouterr().out
    cli.main(["explain", "--dot", str(tmp_path / "w.flow")])
    assert "digraph" in capsys.readouterr().out


def test_command_with_parameters_functions_and_parquet(spark, tmp_path, monkeypatch):
    (tmp_path / "work_functions.py").write_text("from relflow.functions.registry import Registry\nimport pyarrow.compute as pc\nregistry = Registry().column_function('Twice', lambda a, b: (a, pc.multiply(b, 2)))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.createDataFrame([(1, 5), (2, 50)], "a long, b long").write.parquet(str(tmp_path / "in" / "t"))
    (tmp_path / "w.txt").write_text("CREATE RELATION t WITH COLUMNS (INTEGER, INTEGER), SELECT [t_0, t_1] FROM (t) WHERE [(t_1 > {{least}})] AS big, UDF /f Twice ON big AS x WITH COLUMNS (INTEGER, INTEGER)")
    assert cli.main(["run", str(tmp_path / "w.txt"), "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--format", "parquet", "--input-format", "parquet", "--param", "least=9", "--registry", "work_functions:registry"]) == 0
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "x")).collect()] == [(2, 100)]
    with pytest.raises(AnalysisFault):
        cli.main(["explain", str(tmp_path / "w.txt")])


def test_declared_types_must_fit(spark):
    with pytest.raises(AnalysisFault):
        Workflow(TEXT).run(Catalog(spark).frame("e", spark.range(1)))
    with pytest.raises(AnalysisFault):
        Catalog(spark).frame("e", spark.sql("select array(1) as a"))
    with pytest.raises(AnalysisFault):
        Workflow(TEXT).run(Catalog(spark))


def test_fluent_api(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "k long, v double")
    q = relation("t", "INTEGER", "DOUBLE")
    get = lambda x: sorted(tuple(r) for r in x.to(spark, t=df).collect())
    assert get(q.group_by([0], "PLUS", [1])) == [(1, 5.0), (2, 5.0)]
    assert get(q.group_by([0], "MAX", [1])) == [(1, 3.0), (2, 5.0)]
    assert get(q.group_by([0], "COUNT", [])) == [(1, 2), (2, 1)]
    assert get(q.where((q[1] > 2) & (q[0] != 2))) == [(1, 3.0)]
    assert get(q.where(~(q[0] == 1) | (q[1] <= 2))) == [(1, 2.0), (2, 5.0)]
    assert get(q.select(1, compute=10 - q[1])) == [(5.0,), (7.0,), (8.0,)]
    assert get(q.count()) == [(3,)]
    assert get(q.min(1, 0)) == [("ALL", 2.0, 1)]
    assert get(q.select(0).union(q.select(0))) == [(1,), (2,)]
    assert get(q.concat(q).count()) == [(6,)]
    assert get(q.join(q, [0], [0]).count()) == [(5,)]
    assert get(q.select(0).except_(q.where(q[0] == 1).select(0))) == [(2,)]
    assert get(q.iterate(lambda s: s.compute(s[1] * 2), 3)) == [(1, 16.0), (1, 24.0), (2, 40.0)]
    with pytest.raises(AnalysisFault):
        q[2]


def test_vertex_faults():
    e, v = relation("e", "INTEGER", "INTEGER"), relation("v", "INTEGER", "DOUBLE")
    with pytest.raises(AnalysisFault):
        vertex_program(e, v, 1, "median")
    with pytest.raises(AnalysisFault):
        vertex_program(e, v, 1, "+", ("SUM", "EDGEVAL"))


def test_stream_runs_the_workflow_per_batch(spark, tmp_path):
    spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "a")], "i long, v double, k string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("i long, v double, k string").parquet(str(tmp_path / "s"))
    got = []
    q = runner.start(Workflow(TEXT), stream, "e", Catalog(spark), lambda name, df, batch: got.append((name, df.collect())), str(tmp_path / "c"), once=True)
    q.awaitTermination(60)
    assert [(n, [tuple(r) for r in rows]) for n, rows in got] == [("t", [("a", 5.0)])]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = workloads.WORK["select_where"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,150000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


@pytest.mark.parametrize("name", sorted(workloads.queries()))
def test_query_matches_sql(name, same):
    same(workloads.queries()[name], workloads.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["ckey", "spent"]
