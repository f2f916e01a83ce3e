import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import export, graphs
from corvane.sources import registry

SPECS = "spec_id string, repo string, path string, project string, name string, title string, tags array<string>, summary string, ext string, content string"


def specs(spark):
    row = lambda k, repo, title, tags: (f"{repo}:{k}.md", repo, f"{k}.md", "_root", f"n{k}", title, tags, None, "md", "text")
    return spark.createDataFrame([row(1, "r", "One", ["a", "b"]), row(2, "r", "", ["A "]), row(3, "r", None, []), row(4, "other", "Four", ["a"])], SPECS)


def test_repo_graph_modes(spark):
    own = specs(spark)
    none = spark.createDataFrame([], "spec_id string, vec array<double>")
    some = spark.createDataFrame([("r:1.md", [1.0, 0.0]), ("r:3.md", [0.6, 0.8]), ("other:4.md", [1.0, 0.0])], "spec_id string, vec array<double>")
    pairs = lambda links: [(r.source, r.target, r.weight) for r in links.collect()]
    nodes, links = export.repo_graph(own, none, "r")  # no vectors: tags
    assert pairs(links) == [("r:1.md", "r:2.md", 0.5)]
    assert {(r.id, r.label, r.norm_label) for r in nodes.collect()} == {("r:1.md", "One", "one"), ("r:2.md", "n2", "n2"), ("r:3.md", "n3", "n3")} and "content" not in nodes.columns
    assert pairs(export.repo_graph(own, some, "r")[1]) == [("r:1.md", "r:3.md", 0.6)]
    assert pairs(export.repo_graph(own, some, "r", "nodes")[1]) == [] and pairs(export.repo_graph(own, some, "none")[1]) == []
    assert "content" in export.repo_graph(own, some, "r", "nodes", content=True)[0].columns
    with pytest.raises(ValueError):
        export.repo_graph(own, some, "r", "edges")


def test_repo_graph_takes_typed_links(spark):
    edges = spark.createDataFrame([("component://c", "free", "depends_on", "r", "1.md", "dependsOn")], "src string, dst string, type string, repo string, path string, field string")
    entities = spark.createDataFrame([("component://c", "component", "r", "1.md", "C", ""), ("free", "", "", "", "", "unresolved")], "id string, kind string, repo string, path string, title string, flags string")
    own = specs(spark)
    nodes, links = export.repo_graph(own, spark.createDataFrame([], "spec_id string, vec array<double>"), "r", "tags", typed=graphs.typed_links(edges, entities, own, "r"))
    told = {(r.source, r.target): r for r in links.collect()}
    assert told["r:1.md", "free"].source_location == "frontmatter:dependsOn" and told["r:1.md", "r:2.md"].relation is None
    assert {r.source for r in told.values()} | {r.target for r in told.values()} <= {r.id for r in nodes.collect()}


def test_node_link_document(spark, tmp_path):
    nodes = spark.createDataFrame([("b", 'say "hi"\n', None), ("a", "é", "x"), ("a", "é", "x")], "id string, label string, kind string")
    links = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.5), ("a", "a", 1.0)], "source string, target string, weight double")
    for n, x in ((nodes, links), (nodes.limit(0), links.limit(0)), (nodes, links.limit(0))):
        path = str(tmp_path / "graph")
        export.write_node_link(n, x, path, {"repo": "r"})
        got = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
        assert got["graph"] == {"repo": "r"} and not got["directed"] and not got["multigraph"]
        assert [r["id"] for r in got["nodes"]] == sorted(r.id for r in n.collect())
        assert [(r["source"], r["target"]) for r in got["links"]] == sorted((r.source, r.target) for r in x.collect())
    assert "kind" not in got["nodes"][2] and got["nodes"][2]["label"] == 'say "hi"\n'


def test_stars_sources_and_orders(spark):
    results = spark.createDataFrame([("r:1", "One", "docs/ears/1.md", 0), ("r:2", "Two", "2.go", 20)], "spec_id string, label string, path string, place int")
    nodes, links = export.star(results)
    assert {r.id: (r.kind, round(r.relevance, 6)) for r in nodes.collect()} == {export.QUERY: ("query", 1.0), "r:1": ("ears", 0.9), "r:2": ("code", 0.2)}
    assert [(r.source, r.target) for r in links.collect()] == [(export.QUERY, "r:1"), (export.QUERY, "r:2")]
    assert [(r.kind, r.place) for r in export.kinds(nodes, nodes.kind).collect()] == [("ears", 3), ("code", 8), ("query", 9)]
    sources = spark.createDataFrame([(None, "2.go", None, ""), ("r:1", None, None, None)], "spec_id string, path string, name string, title string")
    told = export.with_sources(spark.createDataFrame([("r:1", None), ("z", "2.go"), ("y", ""), ("x", None)], "id string, path string"), sources)
    assert {r.id: r.is_source for r in told.collect()} == {"r:1": True, "z": True, "y": False, "x": False}
    assert [r.relevance for r in export.by_relevance(spark.createDataFrame([(None,), (0.1,), (0.7,)], "relevance double")).collect()] == [0.7, 0.1, None]
    repos = spark.createDataFrame([("a", False, 9), ("b", True, 1), ("c", True, 5), ("d", False, 0)], "repo string, has_graph boolean, n_specs int")
    assert [r.repo for r in export.picker(repos, ["d"]).collect()] == ["d", "c", "b", "a"] and export.picker(repos, []).first().repo == "c"


def test_external_graphs(tmp_path):
    file, graph = tmp_path / "list", tmp_path / "g.json"
    graph.write_text("{}")
    found = registry.load_graphs(str(file))
    assert found == {}
    registry.add_graph(found, registry.ExternalGraph("z", str(graph), n_nodes=3))
    registry.add_graph(found, registry.ExternalGraph("a", str(tmp_path / "gone"), "code-review-graph"))
    for bad in (registry.ExternalGraph("z", "x"), registry.ExternalGraph("y", "x", "other")):
        with pytest.raises(ValueError):
            registry.add_graph(found, bad)
    registry.save_graphs(str(file), found)
    again = registry.load_graphs(str(file))
    assert list(again) == ["a", "z"] and again == found
    assert registry.prune_graphs(again) == ["a"] and list(again) == ["z"]
    registry.remove_graph(again, "z")
    with pytest.raises(KeyError):
        registry.remove_graph(again, "z")


def test_repo_of_one_tag(spark):
    """A repo whose specs all have one tag has links in proportion to its specs."""
    columns = {"spec_id": F.format_string("r:%05d", "id"), "repo": F.lit("r"), "tags": F.array(F.lit("t"))}
    specs = spark.range(9000).select(*[c.alias(n) for n, c in columns.items()], *[F.lit("x").alias(n) for n in ("project", "path", "name", "title", "summary", "ext")])
    none = specs.select("spec_id", F.array(F.lit(1.0)).alias("vec")).limit(0)
    assert export.repo_graph(specs, none, "r")[1].count() == 9000 // 9 * 36
