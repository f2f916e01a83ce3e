"""The registered queries on the smallest tables: against their SQL in DuckDB, or against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from corvane.llm import licenses, queries
from corvane.llm.tokens import vocabulary

from ..conftest import SMALL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.sql(f"create view {t} as from '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return {k: t or "" for k, t in db.cursor().execute("select doc_id, text from documents").fetchall()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SMALL)
    cursor = db.cursor().execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_op1(spark, texts):
    rows = {r.doc_id: r for r in queries.op1_quality_rules(spark, SMALL).collect()}
    assert rows.keys() == texts.keys()
    word = re.compile("[^\x20\x09-\x0d]+")
    for k, t in texts.items():
        w = word.findall(t)
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(g)
        covered = len({i + j for i, x in enumerate(g) if n[x] > 1 for j in range(3)})
        lines = [x for x in t.split("\n") if word.search(x)]
        failed = len(w) < 50 or 100 * covered > 50 * len(w)
        assert tuple(rows[k])[1:7] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), covered, failed) and not (failed and rows[k].kept), k
        assert failed or rows[k].kept == (rows[k].quality >= 0.5)


def test_op2_and_op5(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {k: library.encode(t, add_special_tokens=False).ids + [1] for k, t in texts.items()}
    sequences, own = defaultdict(list), defaultdict(list)
    for r in queries.op2_packing(spark, SMALL).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append((r.start, r.length))
    for found in (*sequences.values(), *own.values()):
        assert [a for a, _ in sorted(found)] == [0, *np.cumsum([n for _, n in sorted(found)])[:-1]]
    assert all(sum(n for _, n in x) <= 2048 for x in sequences.values()) and {k: sum(n for _, n in x) for k, x in own.items()} == {k: len(x) for k, x in ids.items()}
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows, start = {r.doc_id: tuple(r) for r in queries.op5_token_files(spark, SMALL).collect()}, 0
    for k in sorted(texts):
        x = np.array(library.encode(texts[k], add_special_tokens=False).ids + [2], "<u4")
        assert rows[k] == (k, start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_op6_separates(spark, db):
    """Good labelled documents score higher than bad ones."""
    label = {k: q for k, q, _ in db.cursor().execute("select * from labels").fetchall()}
    score = {r.doc_id: r.score for r in queries.op6_lm_scoring(spark, SMALL).collect()}
    good, bad = ([s for k, s in score.items() if s is not None and label.get(k) == q] for q in (1, 0))
    assert len(score) == db.cursor().execute("select count(*) from documents").fetchone()[0] and np.mean(good) > np.mean(bad)


def test_op9(spark, texts):
    rows, lower = {r.doc_id: r for r in queries.op9_license_scan(spark, SMALL).collect()}, {c: c + 32 for c in range(65, 91)}
    assert rows.keys() == texts.keys()
    for k, t in texts.items():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(lower))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        base = {x for _, x in places}
        assert tuple(rows[k])[1:6] == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base))) and base <= set(rows[k].labels.split(",")) | {""} and 0 <= rows[k].score <= 1
