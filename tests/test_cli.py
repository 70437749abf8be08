import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom import cli, stages
from corpusloom.functions import parse
from corpusloom.operators import sampling
from corpusloom.sources import service, tables
from corpusloom.streaming import runner

SF = "/root/testdata/sf0.001"


def test_rounding_is_no_drift():
    assert stages.same({"x": [1.0]}, {"x": [1.0 + 1e-13]}) and not stages.same([1.0], [1.1]) and not stages.same({"a": 1}, {"b": 1}) and not stages.same(1.0, None)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_audit_and_list(spark, capsys):
    assert cli.faults(spark, SF)["integrity_unique"] >= 1
    assert cli.main(["list"]) == 0 and "facts_copy_rate" in capsys.readouterr().out


def test_labels_site_and_report(tmp_path, monkeypatch):
    def stop(*_, **__):
        raise KeyboardInterrupt

    assert cli.merged_labels({"a": "New", "b": "Other"}, {"a": {"label": "Mine", "status": "approved"}}) == {"a": {"label": "Mine", "status": "approved"}, "b": {"label": "Other", "status": "draft"}}
    folder = str(tmp_path / "site")
    cli.swap(folder, {"x.json": {"a": 1}, "d/y.json": []})
    cli.swap(folder, {"z.json": 1})
    assert sorted(os.listdir(folder)) == [cli._MARK, "z.json"]
    with pytest.raises(TypeError):
        cli.swap(folder, {"bad.json": {1, 2}})
    here = os.listdir(tmp_path)
    assert sorted(os.listdir(folder)) == [cli._MARK, "z.json"] and len(here) == 2 and [n for n in here if not n.startswith(".")] == ["site"]
    for step in ("symlink", "replace"):  # stopped before the new files are in place, the old ones are there
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(cli.os, step, stop)
            cli.swap(folder, {"y.json": 2})
        assert sorted(os.listdir(folder)) == [cli._MARK, "z.json"]
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(cli.shutil, "rmtree", stop)
        cli.swap(folder, {"y.json": 2})
    assert sorted(os.listdir(folder)) == [cli._MARK, "y.json"]
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "a").write_text("x")
    with pytest.raises(ValueError):
        cli.swap(str(tmp_path / "mine"), {})
    assert "| a | 0.5 |" in cli.report({"a": {"value": 0.5}, "b": {"value": [1]}}) and "1 rows" in cli.report({"b": {"value": [1]}})


def test_snapshot_copies_what_is_journaled(spark, tmp_path):
    source, target = (tables.Store(spark, str(tmp_path / x)) for x in "ab")
    rows = lambda u: {"clusters": spark.createDataFrame([(u,)], "cluster_id string")}
    stage = runner.Runner(source, "s", ["clusters"])
    stage.run(["u1", "u2"], lambda batch: (rows(batch[0]), {}), 1)
    source.write_part("clusters", "p-orphan", rows("lost")["clusters"])
    stage.close()
    assert runner.snapshot(source, target, "s", ["clusters"]) == 2 and runner.snapshot(source, target, "s", ["clusters"]) == 0
    assert sorted(r.cluster_id for r in target.read("clusters").collect()) == ["u1", "u2"]


def answer(request):
    """A made-up service of 250 items for the first query, with one that repeats, and 5 for others."""
    n = 250 if request["q"] == "big" else 5
    items = [{"repo": f"{request['q']}{i % 249}", "path": "p", "size": i} for i in range(n)]
    page = items[(request["page"] - 1) * request["per_page"] : request["page"] * request["per_page"]]
    return 200, {"items": page}


def test_connector_reads_all_pages(spark):
    spark.sparkContext.addPyFile(__file__)  # tasks call the transport by its name
    spark.dataSource.register(service.PagedSource)
    rows = spark.read.format("paged").options(transport="test_cli:answer", queries="big\nsmall", schema="repo string, path string, size bigint, other string", keys="repo,path").load()
    got = [(r.repo, r.size, r.other) for r in rows.collect()]
    assert len(got) == 254 and ("small4", 4, None) in got


def test_pacing_and_retries():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    replies = iter([(503, {}), (200, {"incomplete_results": True}), (200, {"a": 1}), (404, {})])
    paced = service.Paced(lambda r: next(replies), 2.0, 5, lambda: now[0], sleep)
    assert paced.ask({}) == {"a": 1} and [w for w in waits if w] == [2.0, 4.0]
    with pytest.raises(service.Unavailable):
        paced.ask({})
    with pytest.raises(service.Unavailable):
        service.Paced(lambda r: (429, {}), 0.0, 3, lambda: 0.0, lambda s: None).ask({})
    asked = []
    assert len(list(service.pages(lambda p: asked.append(p) or [{"k": (p, i)} for i in range(100)], ("k",)))) == 1000 and len(asked) == 10


def test_capped_values_are_split_by_qualifiers():
    held = [5] * 30 + [9] * 7
    count = lambda a, b, q="": sum(a <= x <= b for x in held) if not q else {"small": 8, "big": 20}[q]
    assert sorted(sampling.bisect(count, 10, 0, 15, ("small", "big"))) == [(5, 5, 2, "overflow"), (5, 5, 8, "leaf"), (5, 5, 20, "capped"), (8, 15, 7, "leaf")]


def test_trees_and_pages(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("d", "e")], "up string, node string")
    assert {r.node: r.n for r in sampling.below(edges).collect()} == {"a": 4, "c": 2, "d": 1}
    with pytest.raises(ValueError):
        sampling.below(edges.unionByName(spark.createDataFrame([("e", "a")], "up string, node string")), 8)
    html = "<p class='x1'>one</p>\n<script>\nvar a = 5;</script>\n<!-- 7 -->\ntotal 42 &#160; <b>x</b>\n&amp;9"
    rows = spark.createDataFrame([(html,), (None,)], "html string")
    assert [[(d.line, d.snippet) for d in r.d or []] for r in rows.select(parse.digits(F.col("html")).alias("d")).collect()][0] == [(4, "total 42    x"), (5, "9")]


def test_legacy_blobs(spark, tmp_path):
    import zstandard

    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "abc.zst").write_bytes(zstandard.compress(b'{"redact_version": 1, "counts": {"jwt": 2}}\nline\nmore'))
    row = tables.legacy_blobs(spark, str(tmp_path)).first()
    assert (row.oid, row.version, json.loads(row.counts), row.text) == ("abc", 1, {"jwt": 2}, "line\nmore")
