"""From text to vector to search and graph: golden weights, the fusion, queries without tokens, upkeep."""

import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import extract
from corvane.operators import fts, graphs, segments, semantic

FILES = {
    "guides/alpha.md": "---\ntags: alpha, beta\n---\n# Alpha Doc\n\nAlpha paragraph mentions [[Beta Doc]] here.\n",
    "guides/beta.md": "---\ntags: beta\n---\n# Beta Doc\n\nBeta paragraph with @spec req://core/beta-req body.\n",
    "root.md": "# Root Doc\n\nRoot content about alpha things.\n",
}


@pytest.fixture(scope="module")
def specs(spark):
    rows = spark.createDataFrame([("r", p, c) for p, c in FILES.items()], "repo string, path string, content string")
    name = extract.base_name(F.col("path"))
    return rows.select(
        F.concat("repo", F.lit(":"), "path").alias("spec_id"), "repo", "path", extract.project(F.col("path")).alias("project"), name.alias("name"), extract.title(F.col("content"), name).alias("title"),
        extract.split_tags(extract.combined_tags(F.col("content"))).alias("tags"), extract.summary(extract.body(F.col("content"))).alias("summary"), F.lit("md").alias("ext"), "content",
    ).cache()


@pytest.fixture(scope="module")
def vectors(spark, specs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "v")
    semantic.save(semantic.index(specs), path)
    return semantic.load(spark, path)


def test_golden_graphs(specs, vectors):
    """The weights that the fixture's texts have, by tag, about a query's text, and of a repo."""
    nodes, links = graphs.by_tag(specs, vectors.whole(specs), "BETA")
    assert nodes.count() == 2 and [r.weight for r in links.collect()] == [0.4515]
    nodes, links = semantic.ego(vectors, specs, "alpha")
    assert nodes.count() == 3
    assert {(frozenset((r.source, r.target)), r.weight) for r in links.collect()} == {(frozenset(("r:guides/alpha.md", "r:guides/beta.md")), 0.4515), (frozenset(("r:guides/alpha.md", "r:root.md")), 0.378)}
    assert sorted(r.weight for r in semantic.linked(vectors, specs).collect()) == [0.378, 0.4515]
    nodes, links = semantic.ego(vectors, specs, "?!")
    assert nodes.count() == 0 == links.count() and semantic.ego(vectors, specs, "alpha", "other")[0].count() == 0


def test_query_weights_are_those_of_texts(spark):
    texts = ["Alpha alpha beta", "ÜBER die Brücke 12", "x² ½ a_b", "", "?!", "νερά чай 한국어"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, x string")
    got = {k: {} for k in range(len(texts))}
    for r in semantic.embedded(df, "k", F.col("x")).collect():
        got[r.k][r.bucket] = r.weight
    for k, t in enumerate(texts):
        want = semantic.query_weights(t)
        assert got[k] == pytest.approx(want) and (not want or math.isclose(sum(x * x for x in want.values()), 1))


def plain_fusion(idx, vectors, specs, query, repo, k):
    hits = [r.spec_id for r in fts.search_specs(idx, specs, query, None if repo is None else [repo]).collect()]
    cosine = {r.spec_id: r.cosine for r in vectors.cosines(semantic.query_weights(query), specs).collect()}
    near = sorted((h for h in hits if h in cosine), key=lambda h: (-cosine[h], hits.index(h)))
    score = {h: 1 / (60 + i) + (1 / (60 + near.index(h)) if h in cosine else 0) for i, h in enumerate(hits)}
    return [(h, score[h]) for h in sorted(hits, key=lambda h: (-score[h], hits.index(h)))][:k]


def test_hybrid(spark, specs, vectors, tmp_path):
    more = specs.unionByName(specs.withColumns({"repo": F.lit("s"), "spec_id": F.concat(F.lit("s:"), "path"), "content": F.concat(F.lit("alpha alpha doc "), "content")})).unionByName(specs.limit(1).withColumns({"spec_id": F.lit("none"), "title": F.lit("?"), "summary": F.lit(""), "content": F.lit("!"), "name": F.lit("alpha")}))
    idx, own = segments.create(spark, str(tmp_path / "i"), more, fts.COLUMNS), semantic.index(more)
    for query, repo, k in (("alpha", None, 50), ("alpha OR doc", None, 3), ("alpha doc", "s", 50), ("beta", "none", 5)):
        got = [(r.spec_id, r.score) for r in semantic.hybrid(idx, own, more, query, repo, None, k).collect()]
        want = plain_fusion(idx, own, more, query, repo, k)
        assert [x for x, _ in got] == [x for x, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])
    assert semantic.hybrid(idx, own, more, "alpha", None, "ROOT").select("path").distinct().collect()[0].path == "root.md"
    assert semantic.hybrid(idx, own, more, "").count() == 0


def test_nearest_and_upkeep(spark, specs, vectors):
    all_ = {r.spec_id: r.vec for r in vectors.whole(specs).collect()}
    for query, k in (("alpha doc", 2), ("root things", 3), ("zebra", 3), ("alpha", 9)):
        q = semantic.query_weights(query)
        want = sorted(((-sum(q.get(b, 0) * x for b, x in enumerate(v)), s) for s, v in all_.items()))[:k]
        got = [(r.spec_id, r.cosine) for r in semantic.nearest(vectors, query, k).collect()]
        assert [c for _, c in got] == pytest.approx([-c for c, _ in want], abs=1e-9) and len(got) == min(k, 3)
    assert semantic.nearest(vectors, "", 5).count() == 0
    changed = specs.where("name = 'root'").withColumn("content", F.lit("quite another text"))
    after = semantic.updated(vectors, changed, specs.where("name = 'beta'"))
    anew = semantic.index(specs.where("name = 'alpha'").unionByName(changed))
    key = lambda v: sorted((r.bucket, r.spec_id, round(r.weight, 12)) for r in v.weights.collect())
    assert key(after) == key(anew)


def test_a_search_reads_its_buckets(vectors):
    plan = vectors.cosines(semantic.query_weights("alpha beta"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(bucket" in plan
