"""Tables that change together: all of a version or none, two writers, and upserts that are written."""

import pytest

from planspark.sources import sinks, versions

NODES, EDGES = "page_id long, node string", "page_id long, a string, b string"


def graph(spark, page, *names):
    nodes = spark.createDataFrame([(page, n) for n in names], NODES)
    return {"edges": spark.createDataFrame([(page, a, b) for a, b in zip(names, names[1:], strict=False)], EDGES), "nodes": nodes}


def held(spark, root):
    return {t: sorted(tuple(r) for r in versions.read(spark, root, t).collect()) for t in ("nodes", "edges")}


def test_a_writer_that_stops_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert versions.version(spark, root) == (0, None) and versions.read(spark, root, "nodes") is None
    assert versions.replace_together(spark, root, graph(spark, 1, "x", "y", "z"), 0) == 1
    assert versions.replace_together(spark, root, graph(spark, 2, "p", "q"), 1) == 2
    before = held(spark, root)
    assert before == {"nodes": [(1, "x"), (1, "y"), (1, "z"), (2, "p"), (2, "q")], "edges": [(1, "x", "y"), (1, "y", "z"), (2, "p", "q")]}
    broken = graph(spark, 1, "n", "m")
    broken["nodes"] = broken["nodes"].selectExpr("page_id", "cast(raise_error('lost') as string) as node")
    with pytest.raises(Exception, match="lost"):  # edges are written, nodes are not
        versions.replace_together(spark, root, broken, 2)
    assert held(spark, root) == before and versions.version(spark, root)[0] == 2
    with monkeypatch.context() as m:
        m.setattr(versions, "_mark", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            versions.replace_together(spark, root, graph(spark, 1, "n", "m"), 2)
    assert held(spark, root) == before
    assert versions.replace_together(spark, root, graph(spark, 1, "n", "m"), 2) == 3
    assert held(spark, root) == {"nodes": [(1, "m"), (1, "n"), (2, "p"), (2, "q")], "edges": [(1, "n", "m"), (2, "p", "q")]}


def test_of_two_writers_the_second_is_told_and_readers_keep_their_version(spark, tmp_path):
    root = str(tmp_path)
    versions.replace_together(spark, root, graph(spark, 1, "x", "y"), 0)
    seen = versions.version(spark, root)
    versions.replace_together(spark, root, graph(spark, 1, "later"), 1)
    with pytest.raises(versions.Conflict):
        versions.replace_together(spark, root, graph(spark, 1, "mine"), 1)
    with pytest.raises(versions.Conflict):
        versions._mark(spark, root, 2, "other")
    assert sorted(r.node for r in versions.read(spark, root, "nodes", at=seen).collect()) == ["x", "y"]
    assert [r.node for r in versions.read(spark, root, "nodes").collect()] == ["later"] and versions.read(spark, root, "edges").count() == 0
    gone = graph(spark, 1)
    assert versions.replace_together(spark, root, gone, 2, pages=spark.createDataFrame([(1,)], "page_id long")) == 3
    assert versions.read(spark, root, "nodes").count() == 0


def test_upserts_are_written_and_the_last_of_a_key_counts(spark, tmp_path):
    root, shape = str(tmp_path), "id long, name string, at int"
    first = spark.createDataFrame([(k, f"n{k}", 0) for k in range(50)], shape)
    assert versions.upsert_written(spark, root, "rooms", first, ["id"], "at") == 1
    more = spark.createDataFrame([(3, "old", 1), (3, "new", 2), (99, "fresh", 1)], shape)
    assert versions.upsert_written(spark, root, "rooms", more, ["id"], "at") == 2
    got = {r.id: r.name for r in versions.read(spark, root, "rooms", "bucket").collect()}
    assert got == {k: f"n{k}" for k in range(50)} | {3: "new", 99: "fresh"}
    assert sinks.upsert(first, more, ["id"], "at").where("id = 3").count() == 1
