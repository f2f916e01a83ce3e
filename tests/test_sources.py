import json
import sqlite3
import subprocess

import pytest

from corvane.operators import fts, graphs, incremental, kg, render
from corvane.operators.commits import Conflict, Lease
from corvane.plans import scope
from corvane.sources import files, registry
from corvane.sources import graphs as graph_files
from corvane.streaming import events


def test_folder(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"guides/alpha.md": "---\nid: component://alpha\ndependsOn: [req://missing]\n---\n# Alpha\n\nText", "guides/beta.md": "# Beta\n", "root.md": "no heading", "skip/x.md": "x", "pic.png": "\x89", "pic.md": "# Picture\n", "lone.jpg": "y", "b.txt": "text", "b.gif": "g", "code.py": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="latin-1")
    rows = files.with_companions(files.read_folder(spark, str(root), "r", ["skip"]))
    specs = files.specs(rows).cache()
    got = {r.path: r for r in specs.collect()}
    assert set(got) == {"guides/alpha.md", "guides/beta.md", "root.md", "pic.png"}
    assert got["pic.png"].title == "Picture" and got["root.md"].project == "_root" and got["guides/beta.md"].node_id == "r:guides/beta.md"
    decls, edges = files.declarations(specs)
    nodes = {r.id: r.flags for r in kg.resolve(decls, edges).collect()}
    assert nodes["component://alpha"] == "" and nodes["req://missing"] == "unresolved"
    links, more = graphs.typed_links(edges, kg.resolve(decls, edges), specs, "r")
    assert [(r.source, r.target) for r in links.collect()] == [("r:guides/alpha.md", "req://missing")] and [r.id for r in more.collect()] == ["req://missing"]


def test_names_and_bytes(spark, tmp_path):
    root = tmp_path / "a repo%20"
    names = ["a%20b.md", "c d.md", "e#f.md", "g%h.MD", "sub [x]/{y}/i*.md", "skip/deep/j.md", "k.png"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(b"ok \xff\xfe\x80 \xef\xbf\xbd\xef\xbf\xbd end\xc3")
    rows = {r.path: r for r in files.read_folder(spark, str(root), "r", ["skip"]).collect()}
    assert set(rows) == set(names) - {"skip/deep/j.md"}
    assert rows["c d.md"].content == "ok � �� end�" and rows["k.png"].content is None and rows["k.png"].size == 18 and rows["g%h.MD"].ext == "md"
    assert {r.path for r in files.read_folder(spark, str(root), "r", [], {"sub [x]/{y}"}).collect()} == {"sub [x]/{y}/i*.md"}
    assert files.read_folder(spark, str(tmp_path / "empty"), "r", [], {"none"}).count() == 0


def test_ids_of_lists(spark):
    rows = spark.createDataFrame([("r", "a.md", "md", 0, 1, "---\nid: [component://a]\n---\n"), ("r", "b.md", "md", 0, 1, "---\nid: ' component://b '\n---\n")], "repo string, path string, ext string, modified_unix long, size long, content string")
    assert {x.path: x.node_id for x in files.specs(rows).collect()} == {"a.md": "r:a.md", "b.md": "component://b"}


def test_upkeep_equals_rebuild(spark, tmp_path):
    """After changes, renames, deletions and changed companions, refreshed tables are those of a rebuild."""
    root = tmp_path / "repo"
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    def put(name, text):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    root.mkdir()
    run("init", "-q")
    for k in range(6):
        put(f"d/{k}.md", f"---\nid: component://c{k % 4}\ndependsOn: [component://c{k + 1}, req://x]\n---\n# T{k}\n\nbody {k}")
    put("pic.png", "x")
    put("pic.md", "# Picture\n")
    put("skip/z.md", "z")
    run("add", ".")
    run("commit", "-qm", "one")
    repo = registry.Repo("r", str(root), ["skip"])
    store = incremental.Store(spark, str(tmp_path / "store"))
    incremental.rebuild(store, [repo], "t1", {"r": registry.changed_files(str(root), None)[1]})
    assert incremental.refresh(store, repo, "t2") == 0 and store.meta()["last_scan"] == "t1"
    put("d/1.md", "# changed and longer\n")
    put("pic.md", "# Another picture\n")
    put("new.txt", "new")
    put("skip/z.md", "zz")
    run("mv", "d/2.md", "d/moved.md")
    (root / "d/3.md").unlink()
    assert incremental.due(str(root), store.meta()["git_commit_r"]) and incremental.refresh(store, repo, "t3") > 0
    fresh = incremental.Store(spark, str(tmp_path / "fresh"), indexed=False)
    incremental.rebuild(fresh, [repo], "t3")
    anew = fts.index(fresh.tables()["specs"])
    for query in ("changed OR picture", "body 0"):
        assert {r.spec_id: round(r["rank"], 9) for r in fts.search(store.index(), query).collect()} == {r.spec_id: round(r["rank"], 9) for r in fts.search(anew, query).collect()}
    for name in incremental.TABLES:
        one, two = ([json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in s.tables()[name].select(*sorted(store.tables()[name].columns)).collect()] for s in (store, fresh))
        assert sorted(one) == sorted(two), name
    assert {r.path: r.title for r in store.tables()["specs"].collect()}["pic.png"] == "Another picture"
    assert store.meta()["last_index_update_r"] == "t3"
    incremental.drop(store, "r", "t4")
    assert all(df.count() == 0 for df in store.tables().values()) and "git_commit_r" not in store.meta() and store.index().totals() == (0, 0)
    with pytest.raises(registry.GitError):
        registry.changed_files(str(root), "0" * 40)
    for name in ("rest.txt", "code.py"):
        head = registry.changed_files(str(root), None)[1]
        put(name, "pass")
        run("add", ".")
        run("commit", "-qm", name)
    # A commit of other files is no reason to scan; a folder without git always is.
    assert registry.changed_files(str(root), head)[1] != head and not incremental.due(str(root), head) and incremental.due(str(tmp_path / "store"), None)
    assert incremental.due(str(root), "0" * 40) and registry.changed_files(str(tmp_path / "store"), None) == ([], None)


def test_names_for_shells():
    assert registry.lock_name("a/b\\c") == "a_b_c.lock" and registry.quoted("it's") == "'it'\\''s'"


def test_graph_cache(spark, tmp_path):
    import os

    path = str(tmp_path / "g.json")
    write = lambda n: (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": str(k)} for k in range(n)], "links": []}))
    cache = graph_files.GraphCache(spark)
    assert cache.get(path) is None
    write(2)
    first = cache.get(path)
    assert first[0].count() == 2 and cache.get(path) is first and graph_files.count_nodes(spark, path).first().n == 2
    write(3)
    os.utime(path, (1, 1))
    assert cache.get(path)[0].count() == 3
    os.remove(path)
    assert cache.get(path) is None


def test_two_writers(spark, tmp_path, monkeypatch):
    """Changes of two repos at once both come through, as after a rebuild; of two of one repo the second fails; a trigger that meets another's lease does nothing."""
    repos = []
    for n in "ab":
        root = tmp_path / n
        root.mkdir()
        subprocess.run(["git", "-C", str(root), "init", "-q"], check=True)
        for k in range(3):
            (root / f"{k}.md").write_text(f"---\nid: component://{k}\ndependsOn: [component://{k + 1}, req://{n}]\n---\n# {n}{k}\n\ntext\n")
        subprocess.run(["git", "-C", str(root), "add", "."], check=True)
        subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "one"], check=True)
        repos.append(registry.Repo(n, str(root)))
    store = incremental.Store(spark, str(tmp_path / "store"))
    incremental.rebuild(store, repos, "t1", {r.name: registry.changed_files(r.path, None)[1] for r in repos})
    (tmp_path / "a/0.md").write_text("---\nid: component://new\n---\n# changed one\n")
    (tmp_path / "b/1.md").unlink()
    (tmp_path / "b/4.md").write_text("---\nid: component://2\n---\n# another two\n")
    commit, held = incremental._commit, [repos[1]]

    def meanwhile(*args):
        if held:
            incremental.refresh(store, held.pop(), "t2")
        return commit(*args)

    monkeypatch.setattr(incremental, "_commit", meanwhile)
    assert incremental.refresh(store, repos[0], "t3") == 1
    fresh = incremental.Store(spark, str(tmp_path / "fresh"), indexed=False)
    incremental.rebuild(fresh, repos, "t")
    for name in incremental.TABLES:
        one, two = (sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in s.tables()[name].select(*sorted(store.tables()[name].columns)).collect()) for s in (store, fresh))
        assert one == two, name
    anew = fts.index(fresh.tables()["specs"])
    assert sorted(r.spec_id for r in fts.search(store.index(), "changed OR another OR text").collect()) == sorted(r.spec_id for r in fts.search(anew, "changed OR another OR text").collect())
    assert {"last_index_update_a", "last_index_update_b"} <= set(store.meta())
    (tmp_path / "a/0.md").write_text("# changed twice\n")
    held.append(repos[0])
    with pytest.raises(Conflict):
        incremental.refresh(store, repos[0], "t4")
    assert {r.title for r in store.tables()["specs"].where("repo = 'a' and path = '0.md'").collect()} == {"changed twice"}
    store.vacuum()
    assert store.tables()["nodes"].count() > 0
    with Lease(spark, store.path, registry.lock_name("a")):
        assert incremental.triggered(store, repos[0], "t5") is None
    assert incremental.triggered(store, registry.Repo("b", str(tmp_path / "b")), "t6") >= 0


def test_rendered(spark, tmp_path):
    assert render.as_json({"a": "<&>"}) == '{\n  "a": "\\u003c\\u0026\\u003e"\n}\n' and render.served(str(tmp_path / "none")) == render.as_json({"nodes": [], "links": []})
    render.write_json(str(tmp_path / "x.json"), [1])
    assert render.served(str(tmp_path / "x.json")) == "[\n  1\n]\n"
    rows = [{"repo": "a", "project": "p", "name": "n", "title": "T", "ext": "md"}, {"repo": "a", "project": "q", "name": "m", "title": "M", "ext": "md"}, {"repo": "b", "project": "q", "name": "m", "title": "M", "ext": "txt"}]
    assert list(render.listing(rows)) == ["[a]", "  p/", "    n  T  .md", "  q/", "    m  M  .md", "[b]", "  q/", "    m  M  .txt"] and list(render.listing([])) == ["No specs found."]
    assert render.rows_as_json(spark.createDataFrame([], "a int")) == "null\n"
    found = spark.createDataFrame([("specs", "r", "n" * 60, 0.5), ("code", "g", "q", 1.0)], "type string, repo string, name string, score double")
    assert [r.line.split()[:3] for r in render.found(found).collect()] == [["1.00", "code", "g"], ["0.50", "specs", "r"]]
    repos = spark.createDataFrame([("b", "/b", 3, "abcdef0123", 40), ("a", "/a", 0, None, 0)], "repo string, path string, n_specs int, commit string, scanned_unix long")
    assert [r.line.split() for r in render.repos(repos, 100).collect()] == [["a", "0", "—", "—", "/a"], ["b", "3", "1m", "abcdef0", "/b"]]
    assert render.stats({"n_repos": 1, "n_specs": 2, "n_projects": 1, "n_tags": 0, "n_bytes": 9})[-1].endswith("never")
    assert render.explanation(None, {}, {}) == ["No such node."]


def test_ignore_lines():
    cases = {"node_modules": "node_modules", "build/": "build", "/dist/": "dist", "/dist": None, "# c": None, "!x": None, "*.log": None, "a/b": None, "": None, ".venv/": ".venv"}
    assert {k: files.ignore_line(k) for k in cases} == cases
    assert files.skip_names([" b", "a", "..", "a/b", "a"]) == ["a", "b"]


def test_registry(tmp_path):
    assert registry.parse_line("a|/p").skip == [] and registry.parse_line("a|/p|x,y|2024-01-02T03:04:05Z").added_at.year == 2024
    assert registry.parse_line("a|/p|x/y") is None and registry.parse_line("a") is None and registry.parse_line("a|/p||never").added_at is None
    registry.save(str(tmp_path / "r"), [registry.Repo("a", "/p", ["x"])])
    assert registry.load(str(tmp_path / "r")) == [registry.Repo("a", "/p", ["x"])]
    at = registry.parse_line("a|/p||2024-01-02T03:04:05Z")
    assert [registry.format_line(x) for x in (registry.Repo("a", "/p"), registry.Repo("a", "/p", ["y", "x"]), at)] == ["a|/p", "a|/p|x,y", "a|/p||2024-01-02T03:04:05Z"]
    assert registry.project_repositories(registry.render_project(["a", "b"])) == ["a", "b"]


def test_scope(tmp_path):
    repos = {"outer": "/w", "inner": "/w/in", "other": "/wide"}
    assert scope.nearest_repo("/w/in/x", repos) == "inner" and scope.nearest_repo("/wider", repos) is None
    assert scope.partition(["a", "graph:b", "c", "graph:d"]) == (["a", "c"], ["b", "d"])
    assert scope.search_plan(["a", "b"], ["b"]).rank == "graph-aware" and scope.search_plan(["a", "b"], ["b"], repo="a").source == "fts"
    (tmp_path / "scope.toml").write_text('scope = ["x"]\n[weights]\nspecs = 2.0\n')
    got = scope.resolve(None, str(tmp_path / "deep/er"), "/none", repos)
    assert got.entries == ["x"] and got.weights["specs"] == 2.0 and got.weights["code"] == 0.8 and scope.resolve(["f"], "/", "/", {}).entries == ["f"]
    assert scope.scan_target("all", "/", repos)[0] == "full"
    with pytest.raises(ValueError):
        scope.scan_target("nobody", "/", repos)


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"directed": False, "nodes": [{"id": "a", "label": "A", "x": 1}, {"id": "b", "label": "B", "norm_label": "bee"}], "links": [{"source": "a", "target": "b"}, {"source": "a", "target": "a"}]}))
    nodes, links = graph_files.node_link(spark, str(tmp_path / "g.json"))
    assert {(r.id, r.degree, r.norm_label) for r in nodes.collect()} == {("a", 3, "a"), ("b", 1, "bee")} and links.count() == 2
    with sqlite3.connect(tmp_path / "graph.db") as db:
        db.execute("create table nodes(kind, name, qualified_name, file_path, line_start, line_end, language, is_test)")
        db.execute("create table edges(kind, source_qualified, target_qualified)")
        db.execute("insert into nodes values ('F','f','p.f','f.py',1,2,'py',1)")
    db.close()
    assert graph_files.kind_of_file(str(tmp_path / "graph.db")) == "code" and graph_files.kind_of_file("x.json") == "graphify"
    found = graph_files.detect_code_graph(str(tmp_path))
    assert graph_files.code_graph(spark, found)[0].first().is_test is True


def test_git(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.md").write_text("a")
    run("add", ".")
    run("commit", "-qm", "one")
    first, head = registry.changed_files(str(tmp_path), None)
    (tmp_path / "b.md").write_text("b")
    (tmp_path / "c.py").write_text("c")
    assert first == ["a.md"] and registry.changed_files(str(tmp_path), head)[0] == ["b.md"]


def test_merges(spark):
    rows = spark.createDataFrame([(1, "a", "x", "/p", 1), (2, "a", "x", "/p", 2), (3, "b", "y", "", 3)], "seq long, repo string, name string, fullpath string, v long")
    assert {r.v for r in events.merge_sources(rows).collect()} == {1, 3}
    told = spark.createDataFrame([(1, ["a"], [("m", "old")]), (2, ["b", "a"], [("m", "new")])], "seq long, scope array<string>, missing array<struct<repo:string,reason:string>>")
    got = events.merge_provenance(told).first()
    assert got.scope == ["a", "b"] and got.missing[0].reason == "new"
