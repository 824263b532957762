import numpy as np
import pytest
from pyspark.sql import functions as F

from surestat.config import Settings
from surestat.operators import expansion
from surestat.plans import queries as plans
from surestat.sources import sinks, tables
from surestat.streaming import ingest


def test_notes_with_line_feeds_and_quotes(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('discharge_summary,index\n"a\n""q"", b",2\nplain,1\nlast,3\n')
    rows = tables.notes(spark, str(tmp_path / "notes.csv"), Settings(start_index=1))
    assert {(r["index"], r.text) for r in rows.collect()} == {(2, 'a\n"q", b'), (3, "last")}
    with pytest.raises(tables.MissingInput):
        tables.notes(spark, str(tmp_path / "none.csv"), Settings())


def test_a_task_writes_csv_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 30)
    path = str(tmp_path / "kg")
    sinks.append_csv(spark.range(100).coalesce(1).selectExpr("id AS x_index", "'a\nb' AS x_name"), path)
    rows = tables.kg_edges(spark, path)
    assert [r.x_index for r in rows.orderBy("ord").collect()] == list(range(100)) and {r.x_name for r in rows.collect()} == {"a\nb"}
    assert [len(f.read_text().split("\"\n")) - 1 for f in sorted((tmp_path / "kg").glob("*.csv"))] == [30, 30, 30, 10]


def test_the_graph_goes_to_more_files_as_it_grows(spark, monkeypatch):
    wrote, write = [], sinks.append_csv
    monkeypatch.setattr(plans, "FILE_ROWS", 1000)
    monkeypatch.setattr(sinks, "append_csv", lambda rows, path: (wrote.append(rows.rdd.getNumPartitions()), write(rows, path)))
    got = plans.QUERIES["kg_scan"](spark, "/root/testdata/sf0.001")
    assert wrote[0] >= 6 and got.exceptAll(plans.QUERIES["kg_edges_weighted"](spark, "/root/testdata/sf0.001")).isEmpty()


def test_ranges_by_place(spark):
    rows = spark.range(0, 1000, 3).select(F.col("id").alias("index")).repartition(5)
    assert sorted(r["index"] for r in tables.in_range(rows, 2, 5).collect()) == [6, 9, 12]
    assert tables.in_range(rows, 330, 9999).count() == 4 and tables.in_range(rows).count() == 334


def test_last_entities_of_an_index_hold(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"index": 1, "entities": ["a"]}\n\n{"index": 2, "entities": []}\n{"index": 1, "entities": ["b"]}\n')
    got = tables.entities(spark, str(tmp_path / "e.jsonl"))
    assert {(r["index"], tuple(r.entities)) for r in got.collect()} == {(1, ("b",)), (2, ())}
    notes = spark.createDataFrame([(1,), (3,)], "index long")
    assert {(r["index"], tuple(r.entities)) for r in tables.with_entities(notes, got).collect()} == {(1, ("b",)), (3, ())}


def test_resuming(spark, tmp_path):
    notes = spark.createDataFrame([(1,), (2,), (3,)], "index long")
    path = str(tmp_path / "done")
    assert tables.remaining(notes, tables.done(spark, path)).count() == 3
    sinks.append_csv(spark.createDataFrame([(2, "x, \"y\"\nz")], "index long, disease string"), path)
    sinks.append_csv(spark.createDataFrame([(2, "more")], "index long, disease string"), path)
    left = tables.remaining(notes, tables.done(spark, path))
    assert {r["index"] for r in left.collect()} == {1, 3}
    found = spark.createDataFrame([(1, "a", 0.5)], "index long, disease string, uq double")
    assert {tuple(r) for r in expansion.with_placeholders(left, found, {}).collect()} == {(1, "a", 0.5), (3, None, None)}
    assert tables.scores(spark, path, "x").columns == ["index", "disease", "uq_x"]
    sinks.append_json(notes, str(tmp_path / "json"))
    assert tables.done(spark, str(tmp_path / "json"), "json").count() == 3


def test_score_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Index,Disease,CCP_Score\n1.0,Flu,0.5\n2,NA,0.1\nx,Gout,1\n")
    got = tables.scores(spark, str(tmp_path / "s.csv"), "ccp")
    assert {tuple(r) for r in got.collect()} == {(1, "Flu", 0.5), (2, None, 0.1)}
    assert tables.scores(spark, str(tmp_path / "none.csv"), "ccp").count() == 0
    (tmp_path / "p.csv").write_text("index,disease,uq_pure,is_expanded\n1,Flu,0.5,False\n9,Gout,0.2,True\n")
    rows = tables.predictions(spark, str(tmp_path / "p.csv"), Settings(ignore_expansion=True))
    assert [(r.disease, r.uq_pure, r.uq_rrf) for r in rows.collect()] == [("Flu", 0.5, None)]
    assert tables.predictions(spark, str(tmp_path / "p.csv"), Settings(limit_index=8)).count() == 1
    assert tables.method_scores(rows, "uq_pure", "full").columns == ["index", "disease", "score_full"]


def test_embedding_matrix(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.array([[1 + 2j, 3 - 1j], [0.5j, 1]]))
    (tmp_path / "map.csv").write_text("primekg_node_id,matrix_index\n7,1\nA,0\n")
    got = tables.kge(spark, str(tmp_path / "m.npy"), str(tmp_path / "map.csv"), rows_at_once=1)
    assert {(r.node_id, tuple(r.vec)) for r in got.collect()} == {("7", (0.0, 1.0, 0.5, 0.0)), ("A", (1.0, 3.0, 2.0, -1.0))}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "method string, ndcg_5 double")
    sinks.by_method(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m") + "/method=a").count() == 1
    sinks.summary_csv(rows, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("part-*"))) == 1
    sinks.append_table(rows, str(tmp_path), Settings(), "metrics")
    assert spark.read.parquet(str(tmp_path / "metrics")).where("dataset = 'mimic'").count() == 2
    sinks.reset(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 0
    stats = sinks.walk_stats(spark.createDataFrame([(1, 2, 1.0, 1.0, 1.0, 1.0)], "note long, index long, C double, S double, W double, prob double"), spark.createDataFrame([(2, "flu")], "index long, name string"))
    assert tuple(stats.first()) == (1, "flu", 1.0, 1.0, 1.0, 1.0)


def test_reports_are_printed(spark, capsys):
    sinks.report(spark.createDataFrame([(1, "a long name that isn't cut off anywhere")], "index long, name string"))
    assert "a long name that isn't cut off anywhere" in capsys.readouterr().out


def test_incremental_runs_take_new_files_only(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for n in (3, 2):
        spark.range(n).write.mode("append").parquet(source)
        ingest.available_now(spark, source, "id long", lambda d: d.withColumn("twice", F.col("id") * 2), sink, state)
    assert spark.read.parquet(sink).count() == 5


def test_the_command_line_runs_and_resumes(spark, tmp_path, monkeypatch):
    import numpy as np

    from surestat.__main__ import main
    from surestat.models import Stub

    names = Stub.names
    (tmp_path / "notes.csv").write_text("index,discharge_summary\n" + "".join(f'{i},"HPI: note {i}\nAllergies: none"\n' for i in range(1, 4)))
    columns = "x_index,x_id,x_type,x_name,y_index,y_id,y_type,y_name,display_relation"
    pairs = [(i, j) for i in range(6) for j in range(i + 1, 6)]
    (tmp_path / "kg.csv").write_text("\n".join([columns, *(f"{i},P{i},disease,{names[i]},{j},P{j},disease,{names[j]},{'parent-child' if j == i + 1 else 'associated with'}" for i, j in pairs)]))
    np.save(tmp_path / "m.npy", np.arange(12.0).reshape(6, 2) + 1j)
    (tmp_path / "map.csv").write_text("primekg_node_id,matrix_index\n" + "".join(f"P{i},{i}\n" for i in range(6)))
    monkeypatch.setenv("KGE_EMB_PATH", str(tmp_path / "m.npy"))
    monkeypatch.setenv("KGE_MAP_PATH", str(tmp_path / "map.csv"))
    common = ["--root", str(tmp_path / "out"), "--notes", str(tmp_path / "notes.csv"), "--provider", "surestat.models:Stub", "--num-samples", "4", "--kg", str(tmp_path / "kg.csv")]
    assert main(["extract", *common, "--end-index", "2"], spark).count() == 2
    assert sorted(r["index"] for r in main(["extract", *common], spark).collect()) == [1, 2, 3]  # the two that are done aren't asked again
    assert {r["index"] for r in main(["sample", *common], spark).collect()} == {1, 2, 3}
    scored = main(["combine", *common], spark)
    assert {r["index"] for r in scored.collect()} == {1, 2, 3} and "uq_rrf" in scored.columns
    metrics = main(["evaluate", *common], spark)
    assert metrics.count() > 0 and {"ndcg_5", "kendall_tau_b"} <= set(metrics.columns)
    with pytest.raises(SystemExit):
        main(["guess"], spark)
