from pyspark.sql import functions as F

from corvane.functions import extract, formats, vectors
from corvane.functions.extract import frontmatter_fields


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "content string").select(*columns).first()


def test_reference_tags(spark):
    cases = {
        "see @spec req://payments/Settlement-finality@1.0#R2": ["spec:payments/settlement-finality"],
        "@spec annotations": [],
        "[[Refund Policy]] and [[payments/settlement]]": ["link:refund-policy", "link:payments-settlement"],
        "[[Onboarding#step-2|the second step]] [[onboarding]]": ["link:onboarding"],
        "[[_COMMUNITY_Community 12|x]]": [],
        'if [[ -d "$x" ]]; then': [],
        "```\n[[Inside]]\n```\n[[Outside]]": ["link:outside"],
        "req://<path>/<id>": [],
        "@spec req://foo.bar@1#c": [],
        "@spec req://a/b/": ["spec:a/b"],
        "[[$x]] [[a$b]]": [],
        "[[foo ]] [[ foo]] [[Foo]]": ["link:foo"],
        "see ```[[in-code]]``` and\n  ~~~\n[[indent]]\n  ~~~ [[out]]": ["link:out"],
        "[[_AB_x]] [[_ab_x]] [[A & B]] [[-]]": ["link:ab-x", "link:a-b"],
        '---\nsee: "[[Front Link]]"\n---\n[[Body]]': ["link:front-link", "link:body"],
        "---\nreq: '@spec req://a/b@1'\n---\n@spec req://c@2": ["spec:a/b", "spec:c"],
    }
    for text, want in cases.items():
        assert one(spark, text, extract.ref_tags(F.col("content")))[0] == want, text


def test_title_tags_summary(spark):
    text = "---\nid: component://a\ntags: alpha, beta\n---\n\n# Alpha Doc\n\nFirst line\n# not this\nsecond line\n\nnext [[Beta Doc]]\n"
    got = one(spark, text, extract.title(F.col("content"), F.lit("n")), extract.combined_tags(F.col("content")), extract.summary(extract.body(F.col("content"))), extract.parse_frontmatter(F.col("content")).alias("f"))
    assert got[0] == "Alpha Doc" and got[1] == "alpha, beta, link:beta-doc" and got[2] == "First line second line"
    assert got.f.fields["id"] == ["component://a"] and not got.f.malformed
    assert one(spark, "plain", extract.title(F.col("content"), F.lit("n")))[0] == "n"
    assert one(spark, "---\ntags:\n  - first\n  - second\n---\n", extract.raw_tags(F.col("content")))[0] == "- first"
    assert one(spark, None, extract.summary(F.col("content")))[0] == ""


def test_frontmatter():
    assert frontmatter_fields("a: [x, [y, 3], true]\nb: plain") == ({"a": ["x", "y"], "b": ["plain"]}, False)
    assert frontmatter_fields("title: a: b\nid: x") == ({"title": ["a: b"], "id": ["x"]}, False)
    assert frontmatter_fields("a: 1\na: 2")[1] and frontmatter_fields("- list")[1] and frontmatter_fields("a: [")[1]
    assert frontmatter_fields("a: yes\nd: 2024-01-01") == ({"a": ["yes"], "d": ["2024-01-01"]}, False)
    assert frontmatter_fields("") == ({}, False)


def test_typed_edges(spark):
    fields = {"relationships": ["r"], "implementedBy": ["i"], "dependsOn": ["component://d", "free text"], "from-discovery": ["f"], "zRelated": ["component://x"], "notes": ["prose"], "tags": ["component://t"], "authoredIn": ["context://legacy"]}
    rows = spark.createDataFrame([("self", "repo", "p.md", fields)], "node_id string, repo string, path string, fields map<string,array<string>>")
    got = {(r.src, r.dst, r.type) for r in extract.typed_edges(rows).collect()}
    assert got == {("self", "r", "related_to"), ("i", "self", "implements"), ("self", "component://d", "depends_on"), ("self", "free text", "depends_on"), ("self", "f", "from_discovery")}
    assert rows.select(extract.unrecognized_fields(F.col("fields"))).first()[0] == ["authoredIn", "zRelated"]


def test_vectors(spark):
    def fnv(word):
        h = 2166136261
        for b in word.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    for w in ("alpha", "é", "a1"):
        assert one(spark, w, vectors.fnv1a(F.col("content")))[0] == fnv(w)
    rows = spark.createDataFrame([(1, ["alpha", "beta", "alpha"]), (2, [])], "id long, tokens array<string>")
    got = {r.bucket: r.weight for r in vectors.hashed_weights(rows, "id", "tokens").collect()}
    want: dict = {}
    for w, n in (("alpha", 2), ("beta", 1)):
        want[fnv(w) % 256] = want.get(fnv(w) % 256, 0) + n * (1 if fnv(w) & 65536 else -1)
    length = sum(x * x for x in want.values()) ** 0.5
    assert got == {k: v / length for k, v in want.items()}
    assert vectors.decode(vectors.encode([1.5, -2.0]) + b"x") == [1.5, -2.0]
    assert one(spark, "x", vectors.round4(F.lit(0.45145)), vectors.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))[1] == 0


def test_formats(spark):
    row = one(spark, "docs/ADRs/x.md", formats.kind_of_path(F.col("content")), formats.short_commit(F.lit("abcdef012")), formats.human_bytes(F.lit(5 << 30)), formats.human_age(F.lit(7300)))
    assert tuple(row) == ("adr", "abcdef0", "5.0 GB", "2h")
