"""Operator 11 against a plain version, on texts in one piece and cut into tiny chunks."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import middles

from .test_llm import SCHEMA, docs, empty, got, odd  # noqa: F401


def plain(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    cuts = (None, None) if form == "plain" else (len(p), len(m))
    return doc_id, n, form, *cuts, *(hashlib.sha256(x.encode()).hexdigest() for x in (out, text))


def noise(r, n):
    return "".join(r.choices("ab<<PSM>> é漢🙂\n", k=n))


def test_composition_is_that_of_states():
    """Every function of the table is what the bytes do, one after the other, and the table is associative."""
    dfa, r = middles.automaton(middles.SENTINELS), random.Random(3)
    for _ in range(300):
        f, g, h = (r.randrange(len(dfa.exits)) for _ in range(3))
        assert dfa.then[dfa.then[f, g], h] == dfa.then[f, dfa.then[g, h]]
        assert (dfa.exits[dfa.then[f, g]] == dfa.exits[g][dfa.exits[f]]).all()


@pytest.mark.parametrize("size", [0, 1, 2, 3, 31, 64, 65, 500])
def test_tree(size):
    r = random.Random(size)
    dfa, text = middles.automaton(middles.SENTINELS), noise(r, size)
    tree = middles.Tree(dfa, np.frombuffer(text.encode(), np.uint8))
    raw = text.encode()
    for entry in np.flatnonzero(~dfa.found):
        places = np.arange(len(raw) + 1)
        states, tokens, chars = tree.before(places, int(entry))
        state, count, letters = int(entry), 0, 0
        starts = []
        for i, b in enumerate(raw):
            assert (states[i], tokens[i], chars[i]) == (state, count, letters)
            if dfa.begins[int(dfa.lettered[state]), b]:
                starts.append(letters)
            count += dfa.begins[int(dfa.lettered[state]), b]
            letters += dfa.chars[b]
            state = dfa.exits[dfa.of_byte[b], state]
        assert (states[-1], tokens[-1], chars[-1]) == (state, count, letters)
        if starts:
            assert tree.begin(np.arange(count), np.full(count, entry)).tolist() == starts


def test_scan_of_many():
    r = random.Random(8)
    texts = [noise(r, r.randint(0, 40)) for _ in range(400)] + [None, "", "<P>", "<P", "S>", "é" * 50]
    first, second = (np.array([r.randrange(1 << 32) for _ in texts]) for _ in range(2))
    for t, a, b, n, has, x, y in zip(texts, first, second, *middles.scan(pa.array(texts), first, second), strict=True):
        tokens = re.findall("[A-Za-z]+|[^A-Za-z]", t or "")
        u, v = sorted((a % (len(tokens) + 1), b % (len(tokens) + 1)))
        assert (n, has, x, y) == (len(tokens), any(s in (t or "") for s in middles.SENTINELS), len("".join(tokens[:u])), len("".join(tokens[:v])))


@pytest.mark.parametrize("chunk", [middles.CHUNK, 7, 64])
def test_digests(spark, docs, odd, empty, chunk):  # noqa: F811
    for df in (docs, odd):
        want = sorted((plain(x.doc_id, x.text) for x in df.collect()), key=repr)
        assert sorted((tuple(x) for x in middles.digests(df, chunk=chunk).collect()), key=repr) == want
    assert middles.digests(empty, chunk=chunk).count() == 0


def test_sentinels_over_chunk_borders(spark):
    r = random.Random(2)
    rows = [(k, noise(r, 30) + "<P>"[: r.randint(1, 3)] + noise(r, 30)) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(plain(*x) for x in rows)
    for chunk in (1, 2, 5):
        assert sorted(tuple(x) for x in middles.digests(df, chunk=chunk).collect()) == want


def test_giant(spark):
    """A text of several chunks of the real size, without a space, with a sentinel at its very end or none."""
    rows = [(1, "ab1" * 1_500_000), (2, "x" * 3_000_000), (3, "x" * 3_000_000 + "<M>"), (4, "漢字 " * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in middles.digests(df).collect()) == sorted(plain(*x) for x in rows)


def test_columns_and_restore(spark):
    """All columns come along, those with our names too, and the text comes back from output and form."""
    rows = [(k, noise(random.Random(k), 50), "mine", -1, k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int, key int")
    out = middles.transform(df, plain_from=60, spm_below=50)
    back = out.select("doc.*", middles.restore(out.output, out.form).alias("back")).collect()
    assert sorted((x.doc_id, x.text, x.form, x.n, x.key) for x in back) == rows and all(x.back == x.text for x in back)
    forms = {x.form for x in out.select("form").collect()}
    assert forms == {"plain", "psm", "spm"}
