"""Full-text queries against SQLite's FTS5, which has the same language and ranks."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.functions.text import stem
from corvane.operators import catalog, fts
from corvane.operators.corpus import specs_from_documents

from .conftest import SMALL

QUERIES = ["the", "the of", "la OR der", "the NOT with of", "the NOT with AND of", "(la OR the) AND of", "onon*", '"of the"', "of + the", "NEAR(of the, 3)", "NEAR(of the with, 5)", "^the", "content:the", "{title content}: of", "-content: en", "lang: x", "the OR", "foo-bar", "a/b/c:d(e)", "?", 'say "hi', "étre", "Things running", "name:doc_7", "NOT the", "or near", ""]


@pytest.fixture(scope="module")
def both(spark):
    specs = specs_from_documents(spark, SMALL).where("doc_id < 120").cache()
    db = sqlite3.connect(":memory:")
    for name, porter in (("plain", ""), ("stemmed", "porter ")):
        db.execute(f"create virtual table {name} using fts5(repo, name, title, tags, summary, content, spec_id unindexed, tokenize='{porter}unicode61')")
        db.executemany(f"insert into {name} values (?,?,?,?,?,?,?)", [(r.repo, r.name, r.title, ", ".join(r.tags), r.summary, r.content, r.spec_id) for r in specs.collect()])
    return {n: (fts.index(specs, porter=n == "stemmed"), db) for n in ("plain", "stemmed")}


def expected(db, name, query):
    def run(text):
        return {r[0]: r[1] for r in db.execute(f"select spec_id, rank from {name} where {name} match ?", (text,))}

    if not query.strip():
        return {}
    try:
        return run(query)
    except sqlite3.OperationalError:
        return run(" ".join('"' + t.replace('"', '""') + '"' for t in query.split()))


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("name", ["plain", "stemmed"])
def test_same_as_fts5(both, name, query):
    idx, db = both[name]
    got = {r.spec_id: r["rank"] for r in fts.search(idx, query).collect()}
    want = expected(db, name, query)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_saved_index(spark, both, tmp_path):
    idx, _ = both["plain"]
    fts.save(idx, str(tmp_path / "index"))
    saved = fts.load(spark, str(tmp_path / "index"))
    assert sorted(fts.search(saved, "the NOT of").collect()) == sorted(fts.search(idx, "the NOT of").collect())
    plan = saved.postings.where("term = 'the'").select("spec_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,the)]" in plan


def test_maintained_index(spark, both, tmp_path):
    """An index after changes equals one made anew, in rows and in ranks, with and without stems."""
    specs = specs_from_documents(spark, SMALL).where("doc_id < 60").select("spec_id", "repo", "name", "title", "tags", "summary", "content", "doc_id")
    changed = specs.where("doc_id % 7 = 1").withColumn("content", F.lit("things are running of the mill"))
    added = specs.where("doc_id = 3").withColumns({"spec_id": F.lit("new"), "content": F.lit("running things")})
    deleted = specs.where("doc_id % 7 = 2")
    after = specs.where("doc_id % 7 not in (1, 2)").unionByName(changed).unionByName(added)
    for porter in (False, True):
        fts.save(fts.index(specs, porter=porter), str(tmp_path / f"a{porter}"))
        kept = fts.updated(fts.load(spark, str(tmp_path / f"a{porter}"), porter), changed.unionByName(added), deleted)
        fts.save(kept, str(tmp_path / f"b{porter}"))
        one, two = fts.load(spark, str(tmp_path / f"b{porter}"), porter), fts.index(after, porter=porter)
        assert sorted(map(tuple, one.postings.collect())) == sorted(map(tuple, two.postings.collect()))
        ranks = [{r.spec_id: r["rank"] for r in fts.search(x, "running OR the NOT mill").collect()} for x in (one, two)]
        assert ranks[0] == pytest.approx(ranks[1]) and "new" in ranks[0]


def test_one_scan_of_postings(spark, both, tmp_path):
    idx, _ = both["plain"]
    fts.save(idx, str(tmp_path / "index"))
    saved = fts.load(spark, str(tmp_path / "index"))
    plan = fts.search(saved, '"of the" OR NEAR(with by, 3) NOT la*')._jdf.queryExecution().optimizedPlan().toString()
    # Postings are read for counts and, the same plan again, for frequencies; no texts, no lengths.
    assert plan.count("Relation [term") <= 2 and plan.count("Relation [spec_id") == 0


def test_search_of_specs(spark, both):
    idx, _ = both["plain"]
    specs = specs_from_documents(spark, SMALL).where("doc_id < 120")
    whole = fts.search_specs(idx, specs, "the", limit=None).collect()
    some = fts.search_specs(idx, specs, "the", ["src1", "src2"]).collect()
    assert {r.repo for r in some} == {"src1", "src2"} and {r.spec_id: r["rank"] for r in some}.items() <= {r.spec_id: r["rank"] for r in whole}.items()
    assert fts.search_specs(idx, specs, "the", []).count() == 0 and all(r.path.startswith("en/") for r in fts.search_specs(idx, specs, "the", directory="EN/").collect())
    assert [r.outcome for r in catalog.looked_up(specs, "DOC_3").collect()] == ["one"] and catalog.looked_up(specs, "nobody").count() == 0
    many = catalog.looked_up(specs.withColumn("name", F.lit("Same")), "same").collect()
    assert len(many) == specs.count() and {r.outcome for r in many} == {"many"}
    names = [r.name for r in catalog.legacy_names(specs, "C_11").collect()]
    assert names and all("c_11" in n for n in names) and catalog.legacy_names(specs, "c%11").count() >= len(names)
    near = catalog.legacy_related(specs, idx, "oc_7").collect()
    first = catalog.legacy_names(specs, "oc_7").first()
    terms = ["doc", first.name.split("_")[1], *first.tags]
    want = fts.search(idx, " OR ".join(terms)).join(specs.select("spec_id", "name", "repo", "path"), "spec_id").where(F.col("name") != first.name).orderBy("rank", "repo", "path").limit(10)
    assert [r.spec_id for r in near] == [r.spec_id for r in want.collect()]
    with pytest.raises(LookupError):
        catalog.legacy_related(specs, idx, "nothing of that name")
    with pytest.raises(LookupError):
        catalog.related(specs, idx, "nobody")


def test_related_terms():
    query = catalog.related_query("Flow", "The flow: payments, payments!", ["flow", "money", "money"])
    assert [p.terms for p in query.parts] == [["money"], ["money"], ["payments"], ["payments"]] and catalog.related_query("a", "a b c", []) is None


def test_stems():
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    for k, w in enumerate(words, 1):
        db.execute("insert into t(rowid, x) values (?, ?)", (k, w))
    want = {words[doc - 1]: term for term, doc in db.execute("select term, doc from v")}
    assert {w: stem(w) for w in words} == want


def fts5_tokens(texts):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(texts, 1))
    out = [[] for _ in texts]
    for term, doc in db.execute("select term, doc from v order by doc, offset"):
        out[doc - 1].append(term)
    return out


#: Letters with another case that came to Unicode after the version that FTS5's folding has.
YOUNGER = [(0x13A0, 0x13FF), (0x1C80, 0x1CBF), (0x37F, 0x37F), (0x528, 0x52F), (0x2C2F, 0x2C2F), (0xA698, 0xA69B), (0xA796, 0xA79F), (0xA7AB, 0xA7F5), (0xAB70, 0xABBF)]


def test_folding_of_all_letters(spark):
    """Each letter, digit and mark of the basic plane within a word, for texts (Spark) and for queries, as FTS5 has it."""
    import unicodedata

    chars = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and not any(a <= c <= b for a, b in YOUNGER)]
    chars = [c for c in chars if unicodedata.category(c)[0] in "LN" or c in text.LEFT_OUT or unicodedata.ucd_3_2_0.category(c) in ("Mn", "Mc", "Po", "Zs")]
    words = [f"q{c}q" for c in chars]
    want = fts5_tokens(words)
    parted = {c for c, w in zip(chars, want, strict=True) if len(w) == 2 and unicodedata.category(c)[0] in "LN"}
    assert len(parted) < 30  # some letters of newer versions are no letters to FTS5
    rows = [(w, x) for c, w, x in zip(chars, words, want, strict=True) if c not in parted]
    assert [text.tokens_of(w) for w, _ in rows] == [x for _, x in rows]
    df = spark.createDataFrame([(k, w) for k, (w, _) in enumerate(rows)], "k int, x string")
    # Java may know a version of Unicode older than Python's, so not the newest letters.
    known = F.col("x").rlike(r"^q[\p{L}\p{N}\p{Co}]q$")
    got = df.select("k", text.tokens(F.col("x")).alias("t"), known.alias("known")).collect()
    assert all(r.t == rows[r.k][1] for r in got if r.known or len(rows[r.k][1]) == 2 or rows[r.k][1] == ["qq"])
    assert sum(r.known for r in got) > 0.95 * sum(len(x) == 1 and x != ["qq"] for _, x in rows)


@pytest.mark.parametrize("word", ["чай", "한국어", "tiếng", "νερά", "がくせい", "Ünïcode", "ЁЖИК", "ΣΟΦΌΣ", "सत्य", "été", "ﬁne", "İstanbul"])
def test_scripts(spark, word):
    """A word finds its text, and that of another case, as FTS5 does."""
    texts = [f"a {word} b", f"a {word.upper()} b", "nothing", f"{word}{word}"]
    specs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "spec_id string, content string")
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(content, spec_id unindexed)")
    db.executemany("insert into t values (?, ?)", [(t, str(k)) for k, t in enumerate(texts)])
    want = {r[0]: r[1] for r in db.execute("select spec_id, rank from t where t match ?", (f'"{word}"',))}
    got = {r.spec_id: r["rank"] for r in fts.search(fts.index(specs, ("content",)), f'"{word}"').collect()}
    assert "0" in got and got == pytest.approx(want)
