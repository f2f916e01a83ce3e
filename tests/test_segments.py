"""The index of segments: against an index made anew and against SQLite's FTS5, its bounds, its upkeep and its log."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from corvane.operators import fts, segments
from corvane.operators.commits import Conflict, Lease, Log
from corvane.operators.corpus import specs_from_documents

from .conftest import SMALL
from .test_fts import QUERIES

SPECS = "spec_id string, title string, content string"


def made(n, seed=1):
    """Specs of 3 to some hundred words, few of them long, of a skewed vocabulary; most have the word hot."""
    r, out = random.Random(seed), []
    book = [f"w{k}" for k in range(300)]
    for k in range(n):
        words = r.choices(book, [1 / (i + 1) for i in range(300)], k=3 + int(min(600, r.lognormvariate(3.5, 1)))) + ["hot"] * r.choice((0, 1, 1, 2, 3, 9)) + ["cold"] * (r.random() < 0.1)
        r.shuffle(words)
        out.append((f"s{k:05d}", f"Title {r.choice(book)}", " ".join(words)))
    return out


def ranks(rows):
    return [(r.spec_id, round(r["rank"], 8)) for r in rows]


def both_ways(idx, other, query, limit=15):
    """All of search(), and the best of top() with bounds and without, as the other index has them."""
    want = ranks(fts.search(other, query).orderBy("rank", "spec_id").collect())
    assert sorted(ranks(fts.search(idx, query).collect())) == sorted(want), query
    for kw in ({"at_once": 0, "probed": 1}, {}):
        got = ranks(fts.top(idx, query, limit, **kw).collect())
        assert [x for _, x in got] == pytest.approx([x for _, x in want[:limit]], abs=1e-7), query
        assert set(got) <= set(want)


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    specs = specs_from_documents(spark, SMALL).where("doc_id < 150").cache()
    folder = tmp_path_factory.mktemp("segments")
    return {porter: (segments.create(spark, f"{folder}/{porter}", specs, fts.COLUMNS, porter), fts.index(specs, porter=porter)) for porter in (False, True)}


@pytest.mark.parametrize("query", QUERIES[::2])
def test_as_other_index(pair, query):
    both_ways(*pair[False], query)


@pytest.mark.parametrize("query", ["the OR things", "running*", '"of the"', "NEAR(of the, 3) NOT la"])
def test_stems(pair, query):
    both_ways(*pair[True], query)


def test_reads_a_part(spark, tmp_path):
    """The best of hot terms, as FTS5 has them, from less than a quarter of the blocks. Where two terms of equal weight may each stand anywhere, bounds of blocks are loose, and half is read."""
    rows = made(9000)
    idx = segments.create(spark, str(tmp_path / "i"), spark.createDataFrame(rows, SPECS), ("title", "content"))
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(spec_id unindexed, title, content)")
    db.executemany("insert into t values (?, ?, ?)", rows)
    for query in ("hot OR cold", "w9 AND w7", "hot NOT w1", "w2 OR w3"):
        want = [round(x, 8) for (x,) in db.execute("select rank from t where t match ? order by rank limit 20", (query,))]
        told = {}
        got = fts.top(idx, query, 20, at_once=0, probed=2, told=told).collect()
        assert [round(r["rank"], 8) for r in got] == pytest.approx(want, abs=1e-7), query
        assert told["blocks"] >= 400 and told["read"] <= told["blocks"] / (2 if query == "w2 OR w3" else 4), (query, told)


def test_ranks_of_a_phrase_count_all(spark, tmp_path):
    """How rare a phrase, a prefix, a first word or a column's word is comes from all blocks, though few are read."""
    rows = made(1500, 2)
    df = spark.createDataFrame(rows, SPECS)
    idx, other = segments.create(spark, str(tmp_path / "i"), df, ("title", "content")), fts.index(df, ("title", "content"))
    for query in ('"hot w0" OR w1*', "^hot", "title: w3 OR NEAR(hot cold, 4)", "(w5 OR w6) NOT (hot + w0)"):
        both_ways(idx, other, query)


def test_scope(spark, pair):
    idx, other = pair[False]
    scope = fts.search(other, "of").select("spec_id")
    want = ranks(fts.search(other, "the", scope=scope).orderBy("rank", "spec_id").limit(7).collect())
    assert ranks(fts.top(idx, "the", 7, scope=scope, at_once=0, probed=1).collect()) == want


@pytest.mark.parametrize("porter", [False, True])
def test_upkeep(spark, tmp_path, porter):
    """After changes, additions and deletions, one after the other, the index equals one made anew; each change writes its own specs, until segments of one tier become one."""
    columns, now, seen = ("title", "content"), {r[0]: r for r in made(300, 3)}, []
    idx = segments.create(spark, str(tmp_path / "i"), spark.createDataFrame(list(now.values()), SPECS), columns, porter)
    r = random.Random(5)
    for step in range(2 if porter else 5):
        fresh = [(f"n{step}_{k}", "running things", f"hot mills {k} running") for k in range(4)]
        turned = [(s, t, f"{c} changed hot") for s, t, c in r.sample(sorted(now.values()), 5)]
        gone = r.sample(sorted(set(now) - {t[0] for t in turned}), 6 if step < 4 else len(now) - 20)
        now |= {x[0]: x for x in (*fresh, *turned)}
        for s in gone:
            del now[s]
        before = set(idx.live)
        idx = idx.updated(spark.createDataFrame(fresh + turned, SPECS), spark.createDataFrame([(s,) for s in gone] + [("never there",)], "spec_id string"))
        seen.append(sum(s["n_docs"] for s in idx.state["segments"] if s["segment"] not in before))
        assert idx.totals()[0] == len(now)
        if step in (1, 4):
            other = fts.index(spark.createDataFrame(list(now.values()), SPECS), columns, porter)
            anew = other.postings.groupBy("term").agg(F.count("*").alias("n_places"), F.count_distinct("spec_id").alias("n_specs"))
            assert sorted(map(tuple, idx.dictionary().collect())) == sorted(map(tuple, anew.collect()))
            for query in ("changed OR running", 'hot NOT "mills 2"'):
                both_ways(idx, other, query, 10)
    assert seen[:2] == [9, 9] and (porter or len(idx.live) < 6)


def test_conflict_and_readers(spark, tmp_path):
    """Of two changes to one commit the second fails and changes nothing; a reader keeps what it opened; vacuum deletes what no commit names."""
    df = spark.createDataFrame(made(40, 4), SPECS)
    one = segments.create(spark, str(tmp_path / "i"), df, ("content",))
    two = segments.Segments(spark, str(tmp_path / "i"))
    after = one.updated(None, df.where("spec_id < 's00010'").select("spec_id"))
    with pytest.raises(Conflict):
        two.updated(None, df.where("spec_id >= 's00030'").select("spec_id"))
    assert fts.search(two, "w0*").count() == 40 and fts.search(after, "w0*").count() == 30 == segments.Segments(spark, str(tmp_path / "i")).totals()[0]
    rest = after.updated(None, df.select("spec_id"))
    assert rest.totals() == (0, 0) and fts.search(rest, "hot").count() == 0 == fts.top(rest, "hot").count()
    rest.vacuum()
    again = rest.updated(df)
    assert again.totals()[0] == 40 and sorted(ranks(fts.search(again, "hot OR w0").collect())) == sorted(ranks(fts.search(fts.index(df, ("content",)), "hot OR w0").collect()))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SPECS)
    idx = segments.create(spark, str(tmp_path / "i"), none, ("content",))
    assert fts.search(idx, "a").count() == 0 == fts.top(idx, "a OR b*").count() and fts.top(idx, "").count() == 0
    rows = [("a", None, "x"), ("b", "", None), ("c", "x", "")]
    idx = idx.updated(spark.createDataFrame(rows, SPECS))
    assert idx.totals() == (3, 1) and [r.spec_id for r in fts.top(idx, "x").collect()] == ["a"]


def test_plan_reads_terms_alone(spark, pair):
    """A search's postings are filtered by term in the scan, and bounds do not read places."""
    idx, _ = pair[False]
    plan = fts.search(idx, "the NOT of")._jdf.queryExecution().toString()
    assert "In(term, [of,the])" in plan[plan.index("PushedFilters") :], plan[plan.index("PushedFilters") :][:300]
    assert "places" not in idx.bounds([("the", False)])._jdf.queryExecution().executedPlan().toString()


def test_log(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.latest() == (-1, None)
    log.commit(0, {"a": "é"})
    with pytest.raises(Conflict):
        log.commit(0, {"a": 2})
    assert log.latest() == (0, {"a": "é"}) and log.change(lambda v, c: c | {"b": v}) == 1 and log.change(lambda v, c: None) == 1
    assert Log(spark, str(tmp_path / "log")).latest() == (1, {"a": "é", "b": 0}) and log.versions() == [0, 1]


def test_change_again_after_a_conflict(spark, tmp_path):
    log, other = (Log(spark, str(tmp_path / "log")) for _ in range(2))
    log.commit(0, {"n": 0})

    def add(version, content, met=[]):
        if not met:
            met.append(other.change(lambda v, c: {"n": c["n"] + 10}))
        return {"n": content["n"] + 1}

    assert log.change(add) == 2 and log.latest()[1] == {"n": 11}


def test_lease(spark, tmp_path):
    clock = [0.0]
    lease = lambda: Lease(spark, str(tmp_path), "scan", 10, lambda: clock[0])
    with lease() as first:
        with lease() as second:
            assert first and not second
        clock[0] = 11
        with lease() as third:
            assert third
    with lease() as again:
        assert again
