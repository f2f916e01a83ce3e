import random

from pyspark.sql import functions as F

from corvane.operators import codegraph, graphs, incremental, kg, rank


def greedy(pairs, cap):
    used, out = {}, set()
    for block, a, b, w in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if used.get((block, a), 0) < cap and used.get((block, b), 0) < cap:
            out.add((block, a, b))
            for e in (a, b):
                used[block, e] = used.get((block, e), 0) + 1
    return out


def test_capped_is_greedy(spark):
    r = random.Random(1)
    pairs = [(f"g{g}", a, b, r.choice([0.3, 0.5, 0.5, 0.9])) for g in range(6) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.5]
    df = spark.createDataFrame(pairs, "block string, a long, b long, weight double")
    for cap in (1, 3):
        assert {(x.block, x.a, x.b) for x in graphs.capped(df, cap).collect()} == greedy(pairs, cap)
    assert graphs.capped(df.where("a < 0")).count() == 0


def test_capped_before(spark):
    """Rounds and one-by-one give the same, with ends that have some links already."""
    r = random.Random(4)
    pairs = [("g", a, b, r.choice([0.4, 0.6, 0.6])) for a in range(15) for b in range(a + 1, 15)]
    used = {k: r.choice([0, 1, 2, 3]) for k in range(0, 15, 2)}
    df, before = spark.createDataFrame(pairs, "block string, a long, b long, weight double"), spark.createDataFrame([("g", k, n) for k, n in used.items()], "block string, end long, used long")
    have, want = dict(used), set()
    for block, a, b, w in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if have.get(a, 0) < 3 and have.get(b, 0) < 3:
            want.add((a, b))
            have[a], have[b] = have.get(a, 0) + 1, have.get(b, 0) + 1
    for few in (0, 20, graphs.FEW):
        assert {(x.a, x.b) for x in graphs.capped(df, 3, before=before, few=few).collect()} == want
        assert {(x.block, x.a, x.b) for x in graphs.capped(df, 2, few=few).collect()} == greedy(pairs, 2)


def test_links_of_tags(spark):
    """Links by bunches of equal sets are those of one-by-one greedy, for odd and empty sets of tags too."""
    r = random.Random(2)
    rows = [(f"g{k % 2}", f"n{r.random()}", r.choice([["x"], ["x", "Y "], ["y"], ["y", "x", "x"], ["z", "x", "y"], [""], [], None, ["z", "w"]])) for k in range(150)]
    df = spark.createDataFrame(rows, "block string, id string, tags array<string>")
    pairs = [tuple(x) for x in graphs.pairs_of_tags(df).collect()]
    for cap in (0, 1, 3, 8):
        got = graphs.links_of_tags(df, cap).collect()
        assert len(got) == len({(x.block, x.a, x.b) for x in got}) and {(x.block, x.a, x.b) for x in got} == greedy(pairs, cap)


def test_pairs_of_bunches(spark, monkeypatch):
    """Pairs are those of brute force, each once, where sets of tags are several bunches; what is joined is bunches and not ids."""
    monkeypatch.setattr(graphs, "TILE", 7)
    r = random.Random(6)
    rows = [(f"g{k % 2}", k, r.choice([["x"], ["X", "y "], ["y"], ["z", "x", "y"], [], None])) for k in range(120)]
    got = graphs.pairs_of_tags(spark.createDataFrame(rows, "block string, id long, tags array<string>"))
    assert "explode(near" in got._jdf.queryExecution().toString()
    sets = {k: {t.strip().lower() for t in tags or []} for _, k, tags in rows}
    want = sorted((block, a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for block, a, _ in rows for other, b, _ in rows if block == other and a < b and sets[a] & sets[b])
    assert sorted(tuple(x) for x in got.collect()) == want


def test_links_of_many_equal_sets(spark):
    """A clique of thousands has links in proportion to its nodes, and no rounds."""
    df = spark.range(20000).select(F.lit("g").alias("block"), F.format_string("n%05d", "id").alias("id"), F.array(F.lit("t")).alias("tags"))
    got = graphs.links_of_tags(df)
    assert got.count() == 2222 * 36 + 1 and got.agg(F.min("weight")).first()[0] == 1.0


def test_entities(spark):
    decls = spark.createDataFrame([("beta", "a.md", "req://r1", "req", "B"), ("alpha", "z.md", "req://r1", "req", "A"), ("a", "x.md", "component://c", "component", "C")], "repo string, path string, id string, kind string, title string")
    edges = spark.createDataFrame([("component://c", "capability://search/rank", "depends_on", "a", "x.md", "dependsOn"), ("component://c", "free", "depends_on", "a", "x.md", "dependsOn")], "src string, dst string, type string, repo string, path string, field string")
    nodes = {r.id: r for r in kg.resolve(decls, edges).collect()}
    assert nodes["req://r1"].flags == "conflict" and nodes["req://r1"].repo == "alpha" and nodes["req://r1"].provenance == ["alpha:z.md", "beta:a.md"]
    assert nodes["capability://search/rank"].flags == "unresolved" and nodes["capability://search/rank"].kind == "capability" and nodes["free"].kind == ""
    assert nodes["component://c"].flags == ""
    lines = [r.line for r in kg.export(kg.resolve(decls, edges), edges).collect()]
    assert lines[0].startswith("node\tcapability") and lines[-1].startswith("edge\tcomponent://c\tdepends_on\tfree")
    told = kg.explain_json(kg.resolve(decls, edges), edges, "component://c")
    assert told["schema_version"] == 1 and len(told["outgoing"]["depends_on"]) == 2 and kg.explain_json(kg.resolve(decls, edges), edges, "no")["node"] is None
    assert kg.fingerprint(decls, edges).collect() == kg.fingerprint(decls.orderBy("id"), edges).collect() != kg.fingerprint(decls.where("repo = 'a'"), edges).collect()


def test_code_graph(spark):
    names = ["handle_payment", "process_payment", "charge_card", "log_audit", "lonely"]
    nodes = spark.createDataFrame([(n, f"pkg.{n}") for n in names], "name string, qualified_name string")
    edges = spark.createDataFrame([("CALLS", f"pkg.{a}", f"pkg.{b}") for a, b in zip(names, names[1:4])], "kind string, source_qualified string, target_qualified string")
    q = lambda df: [r.name for r in df.collect()]
    seed = "pkg.process_payment"
    assert q(codegraph.callers(nodes, edges, seed)) == ["handle_payment"] and q(codegraph.callees(nodes, edges, seed)) == ["charge_card"]
    assert set(q(codegraph.blast(nodes, edges, seed, 1))) == {"handle_payment", "charge_card"}
    assert set(q(codegraph.blast(nodes, edges, seed, 2))) == {"handle_payment", "charge_card", "log_audit"}
    assert len(q(codegraph.blast(nodes, edges, seed, 2, 1))) == 1 and q(codegraph.blast(nodes, edges, "pkg.none")) == []
    assert q(codegraph.find(nodes, "payment"))[0] == "handle_payment" and q(codegraph.find(nodes, "PROCESS_payment")) == ["process_payment"]
    assert {r.name: r.degree for r in codegraph.hubs(nodes, edges).collect()}["log_audit"] == 0


def test_scores(spark):
    for values, want in (([42.0], [1.0]), ([3.0, 3.0], [1.0, 1.0]), ([0.0, 5.0, 10.0], [0.0, 0.5, 1.0]), ([-10.0, -5.0, -1.0], [0.0, 5 / 9, 1.0])):
        got = rank.min_max(spark.createDataFrame([(v,) for v in values], "score double"), "score").collect()
        assert sorted(r.score for r in got) == want
    df = spark.createDataFrame([("pkg.find", "Find"), ("a.xfind", "xfind"), ("b.find", "other")], "q string, n string")
    assert [r[0] for r in df.select(rank.name_bonus(F.col("q"), F.col("n"), "find")).collect()] == [0.5, 0.0, 0.25]


def test_incremental_is_full(spark, tmp_path):
    schema = "repo string, path string, modified_unix long, size long, title string"
    row = lambda k, v: (f"r{k % 2}", f"{k}.md", v, 10 * v + k, f"t{k}-{v}")
    base = spark.createDataFrame([row(k, 1) for k in range(6)], schema)
    disk = spark.createDataFrame([row(0, 1), row(1, 2), row(2, 1), row(7, 1)], schema)
    fresh = incremental.changed(base, disk)
    assert {r.path for r in fresh.collect()} == {"1.md", "7.md"}
    gone = base.join(disk, ["repo", "path"], "left_anti")
    assert sorted(incremental.upsert(base, fresh, gone).collect()) == sorted(disk.collect())
    assert sorted(incremental.replace_repo(base, disk.where("repo = 'r0'"), "r0").collect()) == sorted(base.where("repo = 'r1'").union(disk.where("repo = 'r0'")).collect())
    incremental.write_repos(base, str(tmp_path / "t"))
    incremental.write_repos(disk.where("repo = 'r1'"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("repo = 'r1'").count() == 2 and spark.read.parquet(str(tmp_path / "t")).where("repo = 'r0'").count() == 3


def clustered(groups, size, dims, spread, seed=3):
    import numpy as np

    g = np.random.default_rng(seed)
    v = np.repeat(g.normal(size=(groups, dims)), size, axis=0) + spread * g.normal(size=(groups * size, dims))
    v[1] = v[0]  # copies, and an opposite
    v[2] = -v[0]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_metric_join(spark):
    """Pairs are those of brute force, at any threshold and number of pivots; where vectors lie in groups, few pairs meet."""
    import numpy as np

    for spread, least, tile in ((0.1, 0.8, 5), (0.1, 0.3, 40), (2.0, 0.3, 25), (2.0, 0.3, 1024), (0.1, -0.2, 30)):
        v = clustered(12, 15, 8, spread)
        df = spark.createDataFrame([(k % 2, k, x.tolist()) for k, x in enumerate(v)], "block int, id long, vec array<double>")
        cos = v @ v.T
        want = {(a % 2, a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if a % 2 == b % 2 and cos[a, b] >= least}
        got = graphs.pairs_of_vectors(df, least, tile).collect()
        assert len(got) == len(want) and {(r.block, r.a, r.b) for r in got} == want
        assert all(abs(r.weight - cos[r.a, r.b]) < 1e-9 for r in got)
        if (spread, least) == (0.1, 0.8):
            each = np.array([90, 90])
            assert graphs.candidates(df, least, tile).count() < (each * (each - 1) // 2).sum() / 4
    empty = df.where("id < 0")
    assert graphs.pairs_of_vectors(empty).count() == 0 == graphs.near_links(empty).count()


def test_links_by_bands(spark):
    """Bands of cosines give the links of one-by-one greedy, ties too; vectors that are full take no part in later bands."""
    v = clustered(6, 12, 6, 0.3, 5)
    v[20:26] = v[20]
    df = spark.createDataFrame([("g", k, x.tolist()) for k, x in enumerate(v)], "block string, id long, vec array<double>")
    pairs = [tuple(r) for r in graphs.pairs_of_vectors(df, 0.3).collect()]
    for cap, bands in ((2, (0.95, 0.6)), (8, graphs.BANDS)):
        told = []
        got = graphs.near_links(df, 0.3, cap, bands, 20, told).collect()
        assert {(r.block, r.a, r.b) for r in got} == greedy(pairs, cap)
        if cap == 2:
            assert told[0] == len(v) and told[-1] < len(v) / 2


def test_links_by_sampled_bands(spark, monkeypatch):
    """Bands found by a sample give the links of one-by-one greedy, whatever it says; most vectors take no part in the last."""
    monkeypatch.setattr(graphs, "SAMPLE", 16)
    monkeypatch.setattr(graphs, "TILE", 16)
    monkeypatch.setattr(graphs, "FEW", 64)
    v = clustered(4, 60, 8, 1.0, 11)
    v[100:120] = v[100]
    rows = [("g" if k % 3 else "h", k, x.tolist()) for k, x in enumerate(v)] + [("g", 900, [None, *v[5].tolist()[1:]]), ("g", 901, None), ("g", 902, []), (None, 903, v[0].tolist())]
    df = spark.createDataFrame(rows, "block string, id long, vec array<double>")
    pairs = [tuple(r) for r in graphs.pairs_of_vectors(df, 0.1).collect()]
    for cap in (2, 8):
        told = []
        got = graphs.near_links(df, 0.1, cap, told=told).collect()
        assert {(r.block, r.a, r.b) for r in got} == greedy(pairs, cap)
        assert 1 < len(told) < 1 + len(graphs.BANDS) and told == sorted(told, reverse=True) and told[-1] < len(v) / 2


def test_plain_tiles(spark, monkeypatch):
    """A block of several tiles, below the size where pivots pay, has no pivots to be found: nothing is cut, and pairs are those of brute force."""
    import numpy as np

    v = clustered(30, 170, 6, 0.2, 13)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<double>").select((F.col("id") % 41 == 0).cast("int").alias("block"), "id", "vec")
    assert len(v) - 125 > 4 * graphs.TILE
    monkeypatch.setattr(graphs, "cut", None)
    got = graphs.pairs_of_vectors(df, 0.95)
    i, j = np.nonzero(np.triu(v @ v.T >= 0.95 - 1e-12, 1))
    same = (i % 41 == 0) == (j % 41 == 0)
    assert {(r.a, r.b) for r in got.collect()} == set(zip(i[same].tolist(), j[same].tolist(), strict=True)) and got.count() == same.sum()


def test_pairs_in_matrices(spark):
    """A cell larger than a tile, copies, vectors of other lengths, with null and without elements: pairs of brute force, and no row for each pair that meets."""
    v = clustered(8, 30, 6, 0.2, 7)
    v[40:110] = v[40]
    rows = [("g" if k % 3 else "h", f"n{k:03d}", x.tolist()) for k, x in enumerate(v)]
    rows += [("g", "odd1", [1.0, 0.0]), ("g", "odd2", [0.6, 0.8]), ("g", "none", []), ("g", "null", None), ("g", "part", [None] * 6)]
    df = spark.createDataFrame(rows, "block string, id string, vec array<double>")
    cos = v @ v.T
    want = {(rows[a][0], rows[a][1], rows[b][1]) for a in range(len(v)) for b in range(a + 1, len(v)) if rows[a][0] == rows[b][0] and cos[a, b] >= 0.7}
    for tile in (20, None):
        got = graphs.pairs_of_vectors(df, 0.55, tile)
        assert "FlatMapGroups" in got._jdf.queryExecution().toString()
        found = [(r.block, r.a, r.b) for r in got.where("weight >= 0.7 or a like 'odd%'").collect()]
        assert len(found) == len(want) + 1 and set(found) == want | {("g", "odd1", "odd2")}


def test_nearest(spark):
    """Nearest vectors of brute force, ties by id, the query itself left out; no row for each query and vector."""
    v = clustered(10, 30, 6, 0.5, 9)
    v[100:120] = v[100]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(998, [1.0]), (999, None)], "id long, vec array<double>").repartition(3)
    q = df.where("id % 10 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    found = graphs.nearest(q, df, 5)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    dots = [[sum(x * y for x, y in zip(a, b)) for b in v] for a in v[::10]]
    want = {(10 * n, k, i + 1) for n, d in enumerate(dots) for i, k in enumerate(sorted((k for k in range(len(v)) if k != 10 * n), key=lambda k: (-d[k], k))[:5])}
    assert {(r.query, r.id, r.place) for r in found.collect()} == want
    few = graphs.nearest(q, df, 500, 0.9).collect()
    assert len(few) == sum(x >= 0.9 for n, d in enumerate(dots) for k, x in enumerate(d) if k != 10 * n)


def test_nearest_in_one_pass(spark):
    """Thousands of queries read the vectors once; vectors with a null element are no one's nearest."""
    import numpy as np

    v = np.random.default_rng(2).normal(size=(5000, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(k, [None, *v[0].tolist()[1:]]) for k in (6000, 6001)]
    df = spark.createDataFrame(rows, "id long, vec array<double>").coalesce(1)
    found = graphs.nearest(df.select(F.col("id").alias("query"), F.col("vec").alias("qvec")), df, 1)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    cos = v @ v.T - 3 * np.eye(len(v))
    assert {r.query: r.id for r in found.collect()} == dict(enumerate(cos.argmax(axis=1).tolist()))


def test_vectors_are_dealt_out(spark):
    """One file of vectors is many tasks."""
    from corvane.queries import vectors_nearest

    from .conftest import SMALL

    plan = vectors_nearest(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(vec_id" in plan[plan.index("MapInArrow") :]


def test_nodes_by_tag(spark, monkeypatch):
    """Nodes alone make no links."""
    monkeypatch.setattr(graphs, "near_links", None)
    from corvane.more_queries import graph_by_tag_nodes

    from .conftest import SMALL

    assert graph_by_tag_nodes(spark, SMALL).count() > 0


def test_copies_by_tag(spark, monkeypatch):
    """Links of 100 copies of one vector are cliques of nine, and no rounds for each."""
    cuts, real = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: cuts.append(1) or real(df))
    specs = spark.range(100).select(F.col("id").alias("spec_id"), *[F.lit("x").alias(c) for c in ("title", "name", "repo", "project")], F.array(F.lit("t")).alias("tags"))
    links = graphs.by_tag(specs, specs.select("spec_id", F.array(F.lit(0.6), F.lit(0.8)).alias("vec")), "T")[1]
    assert links.count() == 11 * 36 and len(cuts) < 6


def test_many_nodes_by_tag(spark, monkeypatch):
    """Nodes of several tiles are linked as one-by-one greedy does, in one band if their pairs are few, and with a handful of cuts."""
    monkeypatch.setattr(graphs, "TILE", 64)
    cuts, real = [], graphs.cut
    v = clustered(5, 120, 12, 1.5, 17)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "spec_id long, vec array<double>")
    specs = df.select("spec_id", *[F.lit("x").alias(c) for c in ("title", "name", "repo", "project")], F.array(F.lit("t")).alias("tags"))
    pairs = [tuple(r) for r in graphs.pairs_of_vectors(df.select(F.lit("").alias("block"), F.col("spec_id").alias("id"), "vec")).collect()]
    monkeypatch.setattr(graphs, "cut", lambda df: cuts.append(1) or real(df))
    links = graphs.by_tag(specs, df, "T")[1]
    assert {(r.block, r.a, r.b) for r in links.collect()} == greedy(pairs, graphs.CAP) and len(cuts) < 8


def test_large_group_by_tag(spark, monkeypatch):
    """Hundreds of near copies and of copies, and copies with a rival that is off by rounding, are linked as one-by-one greedy does, without all their pairs."""
    import numpy as np

    monkeypatch.setattr(graphs, "TILE", 32)
    monkeypatch.setattr(graphs, "MANY", 16, raising=False)
    g = np.random.default_rng(19)
    v = g.normal(size=(420, 8))
    v[:240] = v[0] + 0.05 * g.normal(size=(240, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[240:360], v[360:380] = v[240], v[360]
    v[370] *= 1 + 2.0**-52
    at = g.permutation(420)
    df = spark.createDataFrame([(int(at[k]), x.tolist()) for k, x in enumerate(v)], "spec_id long, vec array<double>")
    specs = df.select("spec_id", *[F.lit("x").alias(c) for c in ("title", "name", "repo", "project")], F.array(F.lit("t")).alias("tags"))
    pairs = [tuple(r) for r in graphs.pairs_of_vectors(df.select(F.lit("").alias("block"), F.col("spec_id").alias("id"), "vec")).collect()]
    made, real = [], graphs.cut

    def counted(df):
        out = real(df)
        made.append(out.count() if "a" in out.columns else 0)
        return out

    monkeypatch.setattr(graphs, "cut", counted)
    for few in (1 << 20, 500):
        monkeypatch.setattr(graphs, "FEW", few)
        assert {(r.block, r.a, r.b) for r in graphs.by_tag(specs, df, "T", cap=2)[1].collect()} == greedy(pairs, 2)
    assert max(made) < len(pairs) / 3


def test_few_meetings_few_tasks(spark):
    """Hundreds of shuffle partitions don't make hundreds of tasks of one block's meetings; blocks by the hundred may have them all."""
    from corvane.operators import export

    v = clustered(5, 60, 12, 1.5, 17)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<double>")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 500)
    try:
        count = lambda block: graphs.pairs_of_vectors(df.select(block.alias("block"), "id", "vec")).rdd.getNumPartitions()
        assert count(F.lit("r")) == 8 * spark.sparkContext.defaultParallelism and count(F.col("id") % 200) == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    specs = df.select(F.col("id").alias("spec_id"), F.lit("r").alias("repo"), *[F.lit("x").alias(c) for c in ("title", "name", "project", "path", "summary", "ext")], F.array(F.lit("t")).alias("tags"))
    own = df.select(F.col("id").alias("spec_id"), "vec")
    pairs = [tuple(r) for r in graphs.pairs_of_vectors(df.select(F.lit("r").alias("block"), "id", "vec")).collect()]
    assert {("r", r.source, r.target) for r in export.repo_graph(specs, own, "r")[1].collect()} == greedy(pairs, graphs.CAP)


def test_chain(spark):
    """A chain in which each pair waits for the one before it takes no round for each."""
    df = spark.range(3000).select(F.lit("g").alias("block"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (1 - F.col("id") / 5000).alias("weight"))
    assert [r.a for r in graphs.capped(df, 1).orderBy("a").collect()] == list(range(0, 3000, 2))


def test_hash_tree(spark):
    """Equal tables in any order have one tree; a change shows at its path, and in the folders and repos above alone."""
    decls = spark.createDataFrame([(r, f"{f}/{k}.md", f"component://{k}", "component", "T") for r in "ab" for f in ("x", "x/y", "z") for k in range(3)], "repo string, path string, id string, kind string, title string")
    edges = spark.createDataFrame([("a", "b", "t", r, "x/1.md", "f") for r in "ab"], "src string, dst string, type string, repo string, path string, field string")
    tree = kg.hash_tree(decls, edges)
    assert tree.where("level = 3").count() == 18 and tree.where("level < 3").count() == 6 + 2 + 1
    assert sorted(map(repr, tree.collect())) == sorted(map(repr, kg.hash_tree(decls.orderBy(F.desc("path")).repartition(3), edges).collect()))
    turned = decls.withColumn("title", F.when(F.expr("repo = 'a' and path = 'x/y/1.md'"), "U").otherwise(F.col("title")))
    other = kg.hash_tree(turned, edges.unionByName(edges.where("repo = 'b'")))
    assert {tuple(r) for r in kg.differing(tree, other).collect()} == {("a", "x/y/1.md", "changed"), ("b", "x/1.md", "changed")}
    both = tree.join(other, ["level", "hash"], "left_anti").where("level = 2").select("repo", "folder").collect()
    assert {tuple(r) for r in both} == {("a", "x/y"), ("b", "x")}
    assert kg.differing(tree, tree).count() == 0 and {r.what for r in kg.differing(tree, kg.hash_tree(decls.limit(0), edges.limit(0))).collect()} == {"removed"}
