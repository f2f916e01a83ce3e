"""Each operator against a brute-force version, on a small fixture with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import chat, common, decontaminate, language_models, licenses, near_duplicates, packing, quality, simple8b, substrings, suffixes, token_files, warc
from corvane.llm.tokens import Encoder, encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node string, batch int"


def texts():
    r = random.Random(5)
    vocabulary_of = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choices(vocabulary_of, k=n))
    passage = say(70)
    out = {k: say(r.randint(1, 200)) for k in range(40)}
    out |= {40: None, 41: "", 42: " \n\t ", 43: "word", 44: "Der " * 400, 45: "Der " * 300, 46: "x" * 5000, 47: say(9000)}
    base = say(150).split()
    for k in range(50, 62):  # near copies
        own = list(base)
        own[r.randrange(150)] = "changed"
        out[k] = " ".join(own)
    for k in range(62, 70):  # copies, and a passage between others
        out[k] = out[3] if k % 2 else f"{say(30)} {passage} {say(20)}"
    out |= {70: "Released under the MIT License.\nLicensed under CC BY-NC 4.0. ", 71: "GNU  General-Public\tLICENSE gnu general public license, version 3", 72: "line one\nline one\n\n\nline one\nother", 73: "###$$$ " * 60, 74: "ß" * 100, 75: "żółć " * 30}
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or ""), True, "n", 1) for k, t in TEXTS.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and repeated rows."""
    long = "one two three four five six seven eight nine ten eleven twelve"
    return spark.createDataFrame([(None, long, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (5, long, "a", "b", 1, True, "n", 1), (5, long, "a", "b", 1, True, "n", 1), (5, "other", "a", "b", 1, True, "n", 1), (9, long, None, None, 1, None, None, None)], SCHEMA)


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


WORD = re.compile("[^\x20\x09-\x0d]+")


def test_quality(docs, empty, odd):
    rows = got(quality.score(docs))
    for k, t in TEXTS.items():
        t = t or ""
        w = WORD.findall(t)
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(g)
        covered = {i + j for i, x in enumerate(g) if n[x] > 1 for j in range(3)}
        seen, repeats = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                repeats += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeats, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert tuple(rows[k][1:7]) == want, k
        assert not (rows[k].base_failed and rows[k].kept)
    assert not rows[73].kept and rows[47].kept
    assert quality.score(empty).count() == 0 and quality.score(odd).count() == 6
    kept = quality.filter(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.kept}


def test_quality_of_other_scripts(spark):
    r = random.Random(6)
    say = lambda letters: " ".join("".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(150)) + "."
    latin, junk = [say("abcdefghijklmnopqrst") for _ in range(200)], ["#$ %& | 12 " * 60 for _ in range(40)]
    others = {"Cyrillic": say("абвгдежзиклмнопрст"), "Greek": say("αβγδεζηθικλμνοπρστ"), "Arabic": say("ابتثجحخدذرزسشصضطظع"), "Hindi": " ".join(["नमस्ते", "दुनिया", "हिन्दी", "किताब"][r.randrange(4)] + str(k) for k in range(150))}
    rows = [(k, t) for k, t in enumerate(latin + junk)] + [(-1 - k, t) for k, t in enumerate(others.values())]
    kept = {x.doc_id for x in quality.score(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()}
    assert kept == {*range(200), *range(-len(others), 0)}
    votes = quality.statistics(spark.createDataFrame(rows, "doc_id long, text string")).withColumns(quality.rules())
    assert {x.letters for x in votes.where("doc_id < 0").collect()} == {1}
    left = quality.filter(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in left.collect()} == kept


def test_expectation_maximisation_finds_accuracies():
    r, counts = random.Random(2), Counter()
    for _ in range(4000):
        good = r.random() < 0.8
        counts[tuple((1 if (r.random() < a) == good else -1) if r.random() < 0.7 else 0 for a in (0.95, 0.8, 0.7, 0.9))] += 1
    found = quality.Model(list("abcd")).fit(counts).accuracies()
    assert all(abs(found[k] - a) < 0.06 for k, a in zip("abcd", (0.95, 0.8, 0.7, 0.9)))


def test_quality_posterior(spark):
    """Posterior and kept against a plain expectation-maximisation over documents, one by one."""
    r = random.Random(8)
    say = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n))
    made = [say(r.randint(60, 200)) for _ in range(60)] + ["# $ % x " * r.randint(20, 60) for _ in range(12)] + ["AAA BBB CCC " * r.randint(20, 40) for _ in range(8)] + [say(20)] * 3
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    names = list(quality.rules())
    votes = {x.doc_id: [x[n] for n in names] for x in quality.statistics(df).withColumns(quality.rules()).collect()}
    share, rates, n = 0.8, {c: [dict(quality.START[c]) for _ in names] for c in quality.START}, len(votes)

    def posterior(v):
        odds = np.log(share) - np.log(1 - share) + sum(np.log(rates["good"][k][x]) - np.log(rates["bad"][k][x]) for k, x in enumerate(v))
        return 1 / (1 + np.exp(-odds))

    for _ in range(200):
        good = {d: posterior(v) for d, v in votes.items()}
        new = (sum(good.values()) + 0.04 * n) / (1.05 * n)
        for c in rates:
            for k in range(len(names)):
                mass = {x: quality.PRIOR[c][x] * n * (new if c == "good" else 1 - new) + sum((good[d] if c == "good" else 1 - good[d]) for d, v in votes.items() if v[k] == x) for x in quality.VOTES}
                rates[c][k] = {x: max(mass[x] / sum(mass.values()), 1e-6) for x in quality.VOTES}
        moved, share = abs(new - share), new
        if moved < 1e-9:
            break
    rows = got(quality.score(df))
    for d, v in votes.items():
        assert rows[d].quality == pytest.approx(posterior(v), abs=1e-6) and rows[d].kept == (not rows[d].base_failed and rows[d].quality >= quality.GOOD)
    clash = df.withColumns({"_row": F.lit(1), "words": F.lit("x"), "n_words": F.lit(5), "length": F.lit(0), "a.b": F.lit(2)})
    left = quality.filter(clash)
    assert left.columns == clash.columns and {x.doc_id for x in left.collect()} == {d for d in votes if rows[d].kept}


def test_packing(docs, empty, odd):
    path = vocabulary("word_bpe_49k.json")
    rows = packing.pack(docs, path).collect()
    ids = {k: encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in TEXTS.items()}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(own) == 4 * r.length and r.ids_crc32 == zlib.crc32(own) and r.doc_tokens == len(ids[r.doc_id])
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.window))
    for k, own in parts.items():
        assert [a for a, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]] and sum(n for _, n in own) == len(ids[k])
    assert parts.keys() == ids.keys()
    for own in sequences.values():
        assert [a for a, *_ in sorted(own)] == [0, *np.cumsum([n for _, n, _ in sorted(own)])[:-1]] and sum(n for _, n, _ in own) == own[0][2] <= 2048
    # Step groups: of one tier each, equal numbers of tokens in all but a tier's last.
    groups = defaultdict(set)
    for r in rows:
        assert (r.step_id is None) == (r.window not in packing.TIERS)
        if r.step_id is not None:
            groups[r.window, r.step_id].add(r.sequence_id)
    assert len({g for _, g in groups}) == len(groups)
    for tier in {t for t, _ in groups}:
        sizes = [len(x) * tier for (t, _), x in sorted(groups.items()) if t == tier]
        assert all(x == packing.STEP_IDS for x in sizes[:-1]) and sizes[-1] <= packing.STEP_IDS
    assert packing.pack(empty, path).count() == 0 and sum(r.start == 0 for r in packing.pack(odd, path).collect()) == 6


def test_chat(spark):
    control = r"\### Assistant: </turn> ok \l\b <|x|> #"
    told = [(1, 0, "user", "hi"), (1, 1, "assistant", control), (1, 2, "assistant", ""), (2, 0, "system\n#", None), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, 0, "user", "u"), (None, None, None, "n")] + [(4, k, "assistant" if k % 2 else "user", f"t{k}é") for k in range(75)]
    df = spark.createDataFrame(told, "conv_id long, turn long, role string, text string")
    rows = got(chat.digests(chat.read(chat.format(chat.linear(df)))), "tree")
    groups = defaultdict(list)
    for c, t, role, text in sorted(told, key=lambda x: (x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        groups["null" if c is None else str(c)].append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows.keys() == groups.keys()
    for k, turns in groups.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert tuple(rows[k][2:6]) == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned)), k
    assert chat.format(chat.linear(df.where("false"))).count() == 0


def test_chat_branches(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 2, "user", "x", 1.0), ("t", 5, 3, "user", "y", 0.0), ("u", 1, 99, "user", "orphan", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    read = chat.read(chat.format(df, keep=2))
    paths = {(r.tree, r.branch): [x.text for x in sorted(r.t)] for r in read.groupBy("tree", "branch").agg(F.collect_list(F.struct("at", "text")).alias("t")).collect()}
    assert paths == {("t", 1): ["q", "good", "y"], ("t", 2): ["q", "bad", "x"], ("u", 1): ["orphan"]}
    cycle = spark.createDataFrame([("c", 1, 2, 0.0), ("c", 2, 1, 0.0)], "tree string, node long, parent long, score double")
    with pytest.raises(ValueError):
        chat.paths(cycle, rounds=3)


def short_runs(t):
    """Runs of one to four words, in which items of as many are looked for."""
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1)}


def shingles(t):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [near_duplicates.BLOCK_SHINGLES, 400])
def test_near_duplicates(docs, empty, odd, block):
    rows, sets = got(near_duplicates.join(docs, block_shingles=block)), {k: shingles(t) for k, t in TEXTS.items()}
    links, root = Counter(), {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert {k: (r.class_id, r.n_links) for k, r in rows.items()} == {k: (top(k), links[k]) for k in sets}
    assert near_duplicates.join(empty).count() == 0
    assert Counter(tuple(r) for r in near_duplicates.join(odd).collect()) == Counter([(None, None, 0)] * 2 + [(5, 5, 2)] * 2 + [(5, 5, 0)] + [(9, 5, 2)])
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in sets if top(k) == k}


def test_few_rows_in_few_files(spark, docs, monkeypatch):
    """What is written between is as many files as rows need or cores run at once, not one for each partition of a shuffle; only what is verified keeps its tasks."""
    files, cut = [], near_duplicates.cut

    def counted(df):
        files.append((out := cut(df)).rdd.getNumPartitions())
        return out

    for module in (common, near_duplicates, substrings, decontaminate):
        monkeypatch.setattr(module, "cut", counted)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        one, most = docs.coalesce(2), 2 * spark.sparkContext.defaultParallelism
        kept = {r.doc_id for r in near_duplicates.keep_one(one).collect()}
        assert sum(n > most for n in files) == 1 and len(files) > 6
        files.clear()
        substrings.cut_out(one).count()
        decontaminate.remove(one, one.limit(3).select(F.col("doc_id").alias("item_id"), "text")).count()
        assert files and max(files) <= most
        assert corpus_pipeline.in_files(spark.range(100).repartition(40), spark.range(9, numPartitions=2)).rdd.getNumPartitions() == most
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert kept == {r.doc_id for r in near_duplicates.keep_one(docs).collect()}


def test_forest_depth():
    least = near_duplicates.least_depth()
    assert near_duplicates.recall(least) >= near_duplicates.TARGET and (least == near_duplicates.DEPTH or near_duplicates.recall(least + 1) < near_duplicates.TARGET)


def test_codec():
    r = np.random.default_rng(1)
    for k in range(60):
        v = r.integers(0, 2**63, r.integers(0, 700), dtype=np.uint64) >> np.uint64(r.integers(0, 64))
        if k % 4 == 0 and len(v):
            v[:: max(1, len(v) // 5)] = 2**64 - 1  # escapes
            v[: len(v) // 2] = 0
        assert (simple8b.decode(simple8b.encode(v), len(v)) == v).all()


def test_encoder_is_the_library():
    r = random.Random(3)
    signs = [chr(k) for k in range(256)] + list(" " * 40 + "'stremvdl\n\n\t ") + ["ŝ", "中", "é"]
    fuzz = ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(1500)] + ["a" * 2000 + " b", "don't 'll l'x", "<|endoftext|>", None]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(vocabulary(name))
        want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in fuzz]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(fuzz)] == want


def test_encoder_is_the_library_as_loaded():
    from tokenizers import Tokenizer

    told = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y <|endoftext|>", "<|ENDOFTEXT|> z", "中<|endoftext|>", "plain"]
    for name, special in (("byte_bpe_50k.json", 50256), ("word_bpe_49k.json", 49407)):
        library = Tokenizer.from_file(vocabulary(name))
        want = [library.encode(t, add_special_tokens=False).ids for t in told]
        assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(vocabulary(name)).encode(told)] == want and want[0] == [special]


def test_token_files(spark, docs, empty, odd):
    path = vocabulary("byte_bpe_50k.json")
    folder = token_files.folder(spark)
    token_files.write(docs, folder, path, 2, 3)
    start = 0
    rows, whole = got(token_files.read(spark, folder)), got(token_files.tokens(spark, folder))
    for k in sorted(TEXTS):
        ids = encoder(path).tokenizer.encode(TEXTS[k] or "", add_special_tokens=False).ids + [2]
        assert tuple(rows[k]) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and whole[k].ids == ids
        start += len(ids)
    for df, n in ((empty, 0), (odd, 6)):
        folder = token_files.folder(spark)
        token_files.write(df, folder, path, 2)
        assert token_files.read(spark, folder).count() == n


def test_language_models(spark, docs, empty, odd):
    targets = spark.createDataFrame([(k,) for k in range(0, 40, 2)] + [(None,), (9999,)], "doc_id long")
    rows = got(language_models.score(docs, targets, batch_bytes=5000, bucket_bytes=20000))
    words = {k: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for k, t in TEXTS.items()}
    models = []
    for own in (range(0, 40, 2), TEXTS):
        models.append((Counter(w for k in own for w in words[k]), Counter(p for k in own for p in zip(words[k], words[k][1:]))))
    known = {w for w, n in models[1][0].items() if n >= 2}

    def loss(model, w):
        one, two = model
        total, inside = sum(one.values()), sum(n for x, n in one.items() if x in known)
        out = 0.0
        for i, x in enumerate(w):
            p = ((one[x] if x in known else total - inside) + 0.5) / (total + 0.5 * (len(known) + 1))
            if i:
                both = w[i - 1] in known and x in known
                p = ((two[w[i - 1], x] if both else 0) + 4 * p) / ((one[w[i - 1]] if both else 0) + 4)
            out -= np.log(p)
        return out / len(w)

    for k, w in words.items():
        assert rows[k].n_words == len(w)
        if w:
            assert abs(rows[k].target_loss - loss(models[0], w)) < 1e-9 and abs(rows[k].background_loss - loss(models[1], w)) < 1e-9
        else:
            assert rows[k].score is None
    assert language_models.score(empty, targets).count() == 0 and language_models.score(odd, targets.where("false")).count() == 6


def test_language_models_in_two_hops(spark, docs):
    targets = spark.createDataFrame([(k,) for k in range(0, 40, 2)], "doc_id long")
    one, two = (got(language_models.score(docs, targets, batch_bytes=3000, bucket_bytes=3000, fan=fan)) for fan in (4096, 3))
    assert one.keys() == two.keys() and all(tuple(one[k]) == pytest.approx(tuple(two[k]), nan_ok=True) if one[k].score is not None else two[k].score is None for k in one)


def test_language_models_query_takes_all_labels(spark):
    from corvane.llm import queries

    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    want = got(language_models.score(docs, labels.where("quality = 1 and toxic = 0")))
    rows = got(queries.op6_lm_scoring(spark, folder))
    assert labels.where("quality = 1 and toxic = 0 and doc_id % 5 = 0").count() > 0 and rows.keys() == want.keys()
    assert all((r.target_loss or 0.0) == pytest.approx(want[k].target_loss or 0.0, abs=1e-6) for k, r in rows.items())


def test_decontaminate(spark, docs, empty, odd):
    words = TEXTS[47].split()
    cut = " ".join(words[100:160]), " ".join(words[200:230] + [f"x{k}" for k in range(30)]), " ".join(words[300:350] + ["x"])
    items = spark.createDataFrame([(0, cut[0].replace("a", "A")), (1, cut[1]), (2, cut[2]), (3, None), (4, ""), (5, "word"), (None, cut[0]), (2, cut[2]), (7, TEXTS[62])], "item_id long, text string").withColumn("doc_id", F.lit(1))
    sets = {k: shingles(t) | short_runs(t) for k, t in TEXTS.items()}
    want = set()
    for i, t in items.select("item_id", "text").collect():
        s = shingles(t)
        want |= {(k, i, len(s), len(s & own)) for k, own in sets.items() if s and i is not None and len(s & own) >= 0.8 * len(s)}
    for limit in (decontaminate.BLOCK_BYTES, 600):
        assert {tuple(r)[:4] for r in decontaminate.search(docs, items, block_bytes=limit).collect()} == want
    assert (47, 0, 56, 56) in want and (43, 5, 1, 1) in want and not any(i == 1 for _, i, *_ in want)
    assert {r.doc_id for r in decontaminate.remove(docs, items).collect()} == set(TEXTS) - {k for k, *_ in want}
    assert decontaminate.search(empty, items).count() == 0 and decontaminate.search(odd, items.where("false")).count() == 0
    assert all(decontaminate.signature_size(n) > n - decontaminate.needed(n) for n in range(1, 3000))


def test_short_items_within_documents(spark):
    """Items of one to four words are found wherever their words stand one after the other, and nowhere else."""
    items = spark.createDataFrame([(1, "Answer is forty-two"), (2, "zebra"), (3, "one two"), (4, "a b c d e f"), (5, "is forty")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "and so the answer is forty two indeed my friend of old"), (2, "forty two is the answer"), (3, "zebra"), (4, "two one, TWO"), (5, "a b c d e"), (6, "x " * 9 + "zebra. zebra"), (7, None), (8, "")], "doc_id long, text string")
    want = {(1, 1, 1), (1, 5, 1), (3, 2, 1), (4, 3, 1), (6, 2, 1)}
    for limit in (decontaminate.BLOCK_BYTES, 1):
        assert {(r.doc_id, r.item_id, r.n_common) for r in decontaminate.search(docs, items, block_bytes=limit).collect()} == want
    assert {r.doc_id for r in decontaminate.remove(docs, items).collect()} == {2, 5, 7, 8}


def test_verify_looks_at_touched_texts(monkeypatch):
    """Of many short unlike texts, a few of them alike, each is compared with those it meets: the links are those of brute force, and the time is not that of all pairs."""
    import time

    r = random.Random(9)
    common = [1, 2, 3]
    sets = [np.unique(np.array(common + [r.randrange(10, 1 << 40) for _ in range(12)], np.uint64)) for _ in range(3000)]
    for k in range(0, 300, 3):
        sets[k + 1] = np.unique(np.append(sets[k][:-1], np.uint64(7 + k)))
    rows = [(b"%06d" % k, 0, 1 + k % 2, s) for k, s in enumerate(sets)]
    began = time.process_time()
    counts, forest = near_duplicates.verify(rows, 0, 0, 0.8)
    assert time.process_time() - began < 20
    want = {}
    for k in range(0, 300, 3):
        a, b = set(sets[k].tolist()), set(sets[k + 1].tolist())
        if len(a & b) >= 0.8 * len(a | b):
            want |= {b"%06d" % k: 1 + (k + 1) % 2, b"%06d" % (k + 1): 1 + k % 2}
    assert counts == want and len(forest) == len(want) // 2


def test_decontaminate_repeated_ids(spark):
    w = [f"w{k}" for k in range(60)]
    say = lambda a, b: " ".join(w[a:b])
    items = spark.createDataFrame([(1, say(0, 30)), (2, say(0, 20)), (2, say(10, 40)), (2, say(10, 40)), (3, say(40, 60))], "item_id long, text string")
    docs = spark.createDataFrame([(1, say(0, 15)), (1, say(15, 30)), (2, say(0, 40)), (2, say(0, 40)), (3, say(40, 60)), (3, "other words than these stand here"), (4, say(0, 20))], "doc_id long, text string")
    want = sorted([(2, 1, 26, 26)] * 2 + [(2, 2, 36, 36)] * 2 + [(3, 3, 16, 16)])
    for limit in (decontaminate.BLOCK_BYTES, 1):
        assert sorted(tuple(r)[:4] for r in decontaminate.search(docs, items, block_bytes=limit).collect()) == want, limit


@pytest.mark.parametrize("how", [{}, {"batch_bytes": 4000, "bucket_bytes": 4000, "hot": 2}, {"few": 1}, {"batch_bytes": 4000, "bucket_bytes": 4000, "fan": 2}])
def test_substrings(docs, empty, odd, how):
    raw, first = {k: (t or "").encode() for k, t in TEXTS.items()}, {}
    for k in sorted(raw):
        for i in range(len(raw[k]) - 49):
            first.setdefault(raw[k][i : i + 50], k)
    rows, left = got(substrings.digests(docs, **how)), got(substrings.cut_out(docs, **how))
    for k, t in raw.items():
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < k:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        assert tuple(rows[k])[1:] == (len(t), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])[: len(t)]).sum()), hashlib.sha256(kept).hexdigest()), k
        assert (left[k].text or "") == kept.decode("utf-8", "ignore") and left[k].n_chars == len(left[k].text or "") and left[k].batch == 1
    assert substrings.digests(empty, **how).count() == 0
    assert sorted(r.n_removed for r in substrings.digests(odd, **how).collect()) == [0, 0, 0, 0, 0, 62]


def test_suffix_order():
    r = random.Random(4)
    for k in range(60):
        data = bytes(r.choices(b"ab" if k % 2 else b"abcdefgh", k=r.randint(60, 400)))
        starts = np.array([r.randrange(len(data) - 49) for _ in range(r.randint(1, 150))])
        order, group = suffixes.sort(data, starts, 50, small=r.choice([1, 8, 1000]), shallow=r.choice([8, 32]))
        own = [data[s : s + 50] for s in starts[order]]
        assert own == sorted(own) and all((group[i] == group[i - 1]) == (own[i] == own[i - 1]) for i in range(1, len(own)))


def test_licenses(docs, empty, odd):
    rows, lower = got(licenses.scan(docs)), {c: c + 32 for c in range(65, 91)}
    for k, t in TEXTS.items():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        assert tuple(rows[k][1:6]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))), k
    assert rows[70].labels == "cc-by,cc-by-nc,mit,mit-notice" and rows[71].labels == "gpl,gpl-3" and rows[70].score == 1.0 and rows[47].score == 0.0
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd).count() == 6


def test_licenses_of_a_bundle(spark):
    other = "some words stand between notices "
    bundle = other.join(t + ". " for t, _ in licenses.TEMPLATES.values())
    some = other.join(licenses.TEMPLATES[k][0] + ". " for k in ("bsd", "unlicense", "gpl-3", "mit-notice", "apache-2"))
    rows = got(licenses.scan(spark.createDataFrame([(1, bundle), (2, some), (3, other), (4, "version 3 of a gnu general work, by public cc")], "doc_id long, text string")))
    found = lambda k: set(rows[k].labels.split(",")) - set(licenses.BASE.values())
    assert found(1) == set(licenses.TEMPLATES) and found(2) == {"bsd", "unlicense", "gpl-3", "mit-notice", "apache-2"}
    assert rows[3].labels == rows[4].labels == "" and rows[1].score == 1.0


def test_licenses_of_mixtures(spark):
    """Labels and score against a brute-force search for key phrases, on random mixtures of cut and changed templates."""
    r = random.Random(9)
    pool = sorted({w for t, _ in licenses.TEMPLATES.values() for w in t.split()}) + ["wor\u212a", "LICENSE\u0130", "éclair"]
    made = []
    for _ in range(80):
        words = []
        for label in r.sample(sorted(licenses.TEMPLATES), r.randint(0, 4)):
            own = licenses.TEMPLATES[label][0].split()
            for _ in range(r.choice([0, 0, 1, 3])):
                own[r.randrange(len(own))] = r.choice(pool)
            words += [r.choice([w, w.upper(), w.title()]) for w in own[: r.choice([len(own), len(own) // 2])]] + r.choices(pool, k=r.randint(0, 6))
        made.append(r.choice([" ", "\n* ", ", "]).join(words))
    rows = got(licenses.scan(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")))
    lower = {c: c + 32 for c in range(65, 91)}
    for k, text in enumerate(made):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(lower))
        labels = {label for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()}
        best = 0.0
        for label, (template, key) in licenses.TEMPLATES.items():
            t, q = template.split(), key.split()
            before = next(i for i in range(len(t)) if t[i : i + len(q)] == q)
            for i in range(len(w)):
                share = sum(0 <= i - before + j < len(w) and w[i - before + j] == x for j, x in enumerate(t)) / len(t)
                if w[i : i + len(q)] == q and share >= 0.3:
                    labels.add(label)
                    best = max(best, share)
        assert rows[k].labels == ",".join(sorted(labels)) and rows[k].score == pytest.approx(best, abs=1e-12), k


def test_licenses_by_rare_words(spark):
    """The rarest words are looked up, others never: with rarities inverted other postings are read, and the candidates, once verified, come out the same. Prose with a long notice's key phrase is no notice."""
    rarity = {w: float(k) for k, w in enumerate(licenses.VOCABULARY)}
    one, two = (licenses.rare_postings({w: f * x for w, x in rarity.items()}) for f in (1, -1))
    assert set(one) != set(two) and max(Counter(label for _, label, _ in one).values()) == licenses.RARE
    texts = {k: t.split() for k, (t, _) in licenses.TEMPLATES.items()}
    files = spark.createDataFrame([(k, ["before", "it", *w]) for k, w in texts.items()] + [("none", ["license", "version", "gnu"]), ("cut", texts["gpl-3"][4:])], "file string, words array<string>")
    met = [{r.file: {(c.label, c.start) for c in r.candidates} for r in licenses.candidates(files, p).collect()} for p in (one, two)]
    for k in texts:
        assert (k, 2) in met[0][k] and (k, 2) in met[1][k]
    assert "none" not in met[0] and ("gpl-3", -4) in met[0]["cut"]
    prose = "Nobody here has read the GNU Affero General Public License, as far as we know."
    assert got(licenses.scan(spark.createDataFrame([(1, prose)], "doc_id long, text string")))[1].labels == ""


def test_licenses_of_a_hot_file(spark):
    """A file that a third of all documents copy is looked up once, and each of them has its labels."""
    rows = [(k, licenses.TEMPLATES["mit-notice"][0] if k % 3 == 0 else licenses.TEMPLATES["boost"][0] + f" {k}" if k % 3 == 1 else "the license") for k in range(3600)]
    found = Counter((r.doc_id % 3, r.labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == {(0, "mit,mit-notice"): 1200, (1, "boost"): 1200, (2, ""): 1200}


def test_licenses_with_words_elsewhere(spark):
    key = "GNU General Public License version 3"
    rows = got(licenses.scan(spark.createDataFrame([(1, key), (2, f"{key}. Whatever is licensed, this work comes under it.")], "doc_id long, text string")))
    assert rows[1].labels == rows[2].labels == "gpl,gpl-3" and rows[1].score == rows[2].score == 0.5


def test_warc(spark):
    pages = [(1, "http://b.example.com/x?q=1", "<p>é</p>"), (2, "http://a.example.org", None), (3, None, ""), (4, "https://B.example.com:80/x", "<p>é</p>"), (9, "http://b.example.com/x?q=1", "<p>é</p>"), (None, "x", "<p>é</p>"), (7, "http://c/\r\n", "alone\r\n\r\nhere"), (8, "http://c/2", "y" * 300000), (8, "http://c/2", "y" * 300000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(1))
    folder = warc.folder(spark)
    warc.write(df, folder, 3)
    rows = Counter(tuple(r)[:5] for r in warc.read(spark, folder).collect())
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = Counter()
    for i, _, h in pages:
        best = max((x for x, _, y in pages if (y or "") == (h or "") and x is not None), default=None)
        want[i, len((h or "").encode()), digest(h), "response" if i == best else "revisit", None if i == best else best] += 1
    assert rows == want
    found = warc.look_up(spark, folder, "http://b.example.com/x?q=1")
    assert sorted(f["WARC-Record-ID"] for f, _ in found) == ["<urn:page:1>", "<urn:page:9>"] and {p for _, p in found} == {b"", "<p>é</p>".encode()}
    assert warc.look_up(spark, folder, "http://nowhere/") == []
    other = warc.folder(spark)
    warc.write(df.where("false"), other)
    assert warc.read(spark, other).count() == 0


def test_warc_keys(spark):
    told = {"https://B.example.com:443/x": "com,example,b)/x", "http://B.example.com:80/x": "com,example,b)/x", "http://b.example.com:8080/x": "com,example,b:8080)/x", "http://b.example.com:443/": "com,example,b:443)/", "http://u:p@b.example.com/x?y": "com,example,b)/x?y", "http://[::1]:80/a": "[::1])/a", "no url": ")no url", None: ")"}
    rows = spark.createDataFrame([(u,) for u in told], "url string").select("url", warc.url_key(F.col("url")).alias("key")).collect()
    assert {r.url: r.key for r in rows} == told


def test_warc_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 5)
    r = random.Random(1)
    pages = [(k, f"http://h{k % 3}.org/{k}", "".join(r.choices("abcdef", k=r.choice([10, 900, 5000])))) for k in range(60)]
    folder = warc.folder(spark)
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), folder, 2)
    blocks = spark.read.parquet(f"{folder}/directory").collect()
    assert len(blocks) > 12 and max(b.captures for b in blocks) <= 5 and max(b.bytes for b in blocks) < 2000 + 6000
    assert {(x.page_id, x.payload_bytes) for x in warc.read(spark, folder).collect()} == {(k, len(h)) for k, _, h in pages}


def test_mail(spark):
    """Rows posted grow with what is sent, not with senders times places; two hops deliver the same."""
    from collections.abc import Iterator

    import pyarrow as pa

    from corvane.llm.common import MAIL, delivered, posted

    def sent(n: int, fan: int):
        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield posted(list(range(n)), [b"%d:%d;" % (k, p) for p in range(n)], n, fan)

        return spark.range(n).repartition(3).mapInArrow(post, MAIL)

    for n in (20, 80):
        rows = sent(n, 4)
        assert rows.count() <= 4 * n and sent(n, 100).count() == n * n
        whole = defaultdict(list)
        for x in delivered(rows, n, 4).collect():
            whole[x.to] += bytes(x.raw).split(b";")[:-1]
        assert whole.keys() == set(range(n)) and all(sorted(v) == sorted(b"%d:%d" % (k, p) for k in range(n)) for p, v in whole.items())


def test_long_text(spark):
    """One text of 3.4 MiB, beyond every chunk, piece and block, with a copy of a part of it."""
    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n))
    long = say(550_000)
    assert len(long) > 3 << 20
    passage = long[2_000_000:2_000_600]
    df = spark.createDataFrame([(1, long), (2, f"{say(60)} {passage} {say(60)}"), (3, long), (4, say(100))], "doc_id long, text string")
    assert {d: (x.n_words, x.kept) for d, x in got(quality.score(df)).items()}[1] == (550_000, True)
    assert {d: (x.class_id, x.n_links) for d, x in got(near_duplicates.join(df)).items()} == {1: (1, 1), 2: (2, 0), 3: (1, 1), 4: (4, 0)}
    cuts = got(substrings.digests(df))
    assert cuts[1].n_removed == 0 and 600 <= cuts[2].n_removed <= 602 and cuts[3].n_removed == len(long) and cuts[4].n_removed == 0
    items = spark.createDataFrame([(7, passage.split(" ", 1)[1].rsplit(" ", 1)[0])], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.search(df, items).collect()} == {1, 2, 3}
    path = vocabulary("word_bpe_49k.json")
    pieces = packing.pack(df, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(pieces) == 4 and all(x.n == x.m for x in pieces)
    folder = token_files.folder(spark)
    token_files.write(df, folder, vocabulary("byte_bpe_50k.json"), 2, 2)
    rows = got(token_files.read(spark, folder))
    assert rows[1].n_tokens == rows[3].n_tokens and rows[1].ids_crc32 == rows[3].ids_crc32 and rows[2].start == rows[1].n_tokens
    scores = got(language_models.score(df, df.where("doc_id = 1").select("doc_id")))
    assert scores[1].n_words == 550_000 and scores[1].score == pytest.approx(scores[3].score)
    assert got(licenses.scan(df))[1].n_words == 550_000


def test_clashing_names(spark):
    rows = [(k, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * (3 if k else 1), 5, "b", 7, "x", 8) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch int, node string, `to` int, raw string, component int")
    assert substrings.cut_out(df).columns == df.columns and substrings.cut_out(df).count() == 3
    assert near_duplicates.keep_one(df).columns == df.columns and near_duplicates.keep_one(df).count() == 2
    assert decontaminate.remove(df, spark.createDataFrame([(1, "x", 5)], "item_id long, text string, doc_id int")).count() == 3


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, null texts, repeated and null ids go through all stages; what is dropped is what the stages say."""
    import corpus_pipeline

    r = random.Random(14)
    say = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n)) + "."
    good = [say(150) for _ in range(30)]
    passage = say(60)
    told = [(k, t) for k, t in enumerate(good)] + [(100, good[3]), (101, good[3].replace("a", "a", 1)), (102, f"{say(80)} {passage} {say(80)}"), (103, f"{say(80)} {passage} {say(80)}"), (104, None), (105, ""), (None, say(150)), (106, "# $ % & " * 80), (107, f"{say(70)} leaked {good[29].upper()[:0]}{'alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi'} {say(70)}")]
    frame = lambda rows: spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"), (2, None)], "item_id long, text string")
    for name, rows in (("some", told), ("none", [])):
        folder = str(tmp_path / name)
        frame(rows).write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        docs, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
        for stage, f in corpus_pipeline.STAGES[:-1]:
            f(spark, docs, folder).write.parquet(f"{folder}/{stage}")
            docs = spark.read.parquet(f"{folder}/{stage}")
            left[stage] = {x.doc_id: x.text for x in docs.collect()}
        out = corpus_pipeline.run(spark, folder).collect()
        assert {x.doc_id for x in out} == set(left["benchmark"])
        if not rows:
            assert not out
            continue
        assert left["quality"].keys() == {k for k, _ in told} - {104, 105, 106}
        assert left["near_duplicates"].keys() == left["quality"].keys() - {100, 101}
        assert passage in left["suffixes"][102] and passage not in left["suffixes"][103] and left["suffixes"].keys() == left["near_duplicates"].keys()
        assert left["benchmark"].keys() == left["suffixes"].keys() - {107}


def test_pipeline(spark):
    import corpus_pipeline

    names = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").columns
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == names, name
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


def test_verify_counts_in_pieces(monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    rows = [(bytes([k]), 0, 1, np.unique(np.concatenate([base[: 60 - k % 9], r.integers(0, 2**63, k % 9, dtype=np.uint64)]))) for k in range(40)]
    sets = {n: set(own.tolist()) for n, *_, own in rows}
    want = {n: c for n in sets if (c := sum(n != m and 10 * len(sets[n] & sets[m]) >= 8 * len(sets[n] | sets[m]) for m in sets))}
    for most in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(near_duplicates, "AT_ONCE", most)
        assert near_duplicates.verify(rows, 0, 0, 0.8)[0] == want
