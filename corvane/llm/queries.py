"""Queries of the operators: one opN_<name> for each, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, compression, decontaminate, language_models, licenses, middles, near_duplicates, packing, quality, resampling, substrings, token_files, warc
from .common import table
from .tokens import vocabulary


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = told.union(spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], told.schema))
    formatted = chat.format(chat.linear(told))
    return chat.digests(chat.read(formatted)).select(F.when(F.col("tree") != "null", F.col("tree").cast("long")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.folder(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, path)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is all documents that labels call good and not toxic. Losses in millionths of a nat."""
    labels = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    scored = language_models.score(table(spark, sf_dir, "documents"), labels)
    return scored.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.folder(spark)
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middles.digests(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_chat_format, op4_near_duplicates, op5_token_files, op6_lm_scoring, op7_decontaminate, op8_suffix_dedup, op9_license_scan, op10_warc, op11_fill_in_middle, op12_importance_resampling, op13_quality_classifier)}
# Words and shingles as common.words and common.shingles have them; of one to four words, all of them are the one shingle.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SHINGLES = r"""SELECT {id}, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
 FROM (SELECT {id}, regexp_extract_all({lower}, '[0-9a-z\x{{80}}-\x{{10ffff}}]+') AS w FROM {table} WHERE {id} IS NOT NULL)"""

# Runs of documents' words, of as many words as some item has, five at most; an item of fewer than five words is found as a run of as many.
RUNS = r"""SELECT doc_id, unnest(list_distinct(flatten(list_transform(ks, lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')))))) AS s
 FROM (SELECT doc_id, regexp_extract_all({lower}, '[0-9a-z\x{{80}}-\x{{10ffff}}]+') AS w FROM documents WHERE doc_id IS NOT NULL), (SELECT coalesce(list(DISTINCT least(5, len(regexp_extract_all({lower}, '[0-9a-z\x{{80}}-\x{{10ffff}}]+')))), [5]) AS ks FROM benchmark WHERE len(regexp_extract_all({lower}, '[0-9a-z\x{{80}}-\x{{10ffff}}]+')) > 0)"""


def _shingles(table_name: str, own: str) -> str:
    return SHINGLES.format(id=own, table=table_name, lower=LOWER)


def _license_sql() -> str:
    """The base phrases' places, and of each template the best share of its words in their places where its key phrase stands, if that is the least share or more; only texts with a sign are searched."""

    def places(phrase: str) -> str:
        words = phrase.split()
        return f"CASE WHEN signed THEN list_filter(range(1, len(w) - {len(words)} + 2), lambda i: w[i : i + {len(words) - 1}] = {words!r}) ELSE [] END"

    found, shares = [], []
    for k, (label, (template, key)) in enumerate(licenses.TEMPLATES.items()):
        words, start = template.split(), f" {template} ".index(f" {key} ")
        before = len(template[:start].split())
        found.append(f"{places(key)} AS t{k}")
        word = f"i - {before} + j - 1"
        share = f"list_sum(list_transform(range(1, {len(words) + 1}), lambda j: CASE WHEN {word} >= 1 AND w[{word}] = {words!r}[j] THEN 1 ELSE 0 END)) / {len(words)}"
        shares.append(f"list_filter(list_transform(t{k}, lambda i: {share}), lambda x: x >= {licenses.LEAST}) AS s{k}")
    base = [f"{places(phrase)} AS b{k}" for k, phrase in enumerate(licenses.BASE)]
    named = lambda letter, labels: "[" + ", ".join(f"CASE WHEN len({letter}{k}) > 0 THEN '{x}' END" for k, x in enumerate(labels)) + "]"
    joined = lambda x: f"array_to_string(list_sort(list_distinct({x})), ',')"
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), s AS (SELECT *, list_has_any(w, {licenses.SIGNS!r}) AS signed FROM d), p AS (SELECT doc_id, w, {", ".join(base + found)} FROM s),
p2 AS (SELECT *, {", ".join(shares)} FROM p), q AS (SELECT *, flatten([{", ".join(f"b{k}" for k in range(len(base)))}]) AS spots, {named("b", licenses.BASE.values())} AS base, {named("s", licenses.TEMPLATES)} AS more, flatten([{", ".join(f"s{k}" for k in range(len(shares)))}]) AS shares FROM p2)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) - 1 AS first_word, list_max(spots) - 1 AS last_word, {joined("base")} AS base_labels, {joined("list_concat(base, more)")} AS labels, coalesce(list_max(shares), 0.0)::DOUBLE AS score FROM q"""


def _model_sql() -> str:
    """Word and pair counts of all and of target documents, and each word's loss by both."""

    def loss(count: str, unknown: str, size: str, pair: str, history: str) -> str:
        word = f"((CASE WHEN c.n >= 2 THEN c.{count} ELSE {unknown} END) + 0.5) / ({size} + 0.5 * (vocabulary + 1))"
        both = "c.n >= 2 AND h.n >= 2"
        return f"-ln(CASE WHEN w.before IS NULL THEN {word} ELSE ((CASE WHEN {both} THEN {pair} ELSE 0 END) + 4 * {word}) / ((CASE WHEN {both} THEN {history} ELSE 0 END) + 4) END)"

    return rf"""WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0), d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM good) AS t, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10ffff}}]+') AS ws FROM documents),
w AS (SELECT doc_id, t, x, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, t, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d)), c AS (SELECT x, count(*) AS n, count(*) FILTER (t) AS m FROM w GROUP BY x), p AS (SELECT before, x, count(*) AS n, count(*) FILTER (t) AS m FROM w WHERE before IS NOT NULL GROUP BY ALL),
z AS (SELECT count(*) FILTER (n >= 2) AS vocabulary, sum(n) AS total, sum(m) AS target, sum(n) FILTER (n < 2) AS rare, coalesce(sum(m) FILTER (n < 2), 0) AS rare_target FROM c),
l AS (SELECT w.doc_id, {loss("m", "coalesce(rare_target, 0)", "target", "p.m", "h.m")} AS a, {loss("n", "coalesce(rare, 0)", "total", "p.n", "h.n")} AS b FROM w JOIN c USING (x) LEFT JOIN c h ON h.x = w.before LEFT JOIN p ON p.before = w.before AND p.x = w.x CROSS JOIN z)
SELECT documents.doc_id, count(a) AS n_words, round(avg(a), 6) AS target_loss, round(avg(b), 6) AS background_loss, round(avg(b) - avg(a), 6) + 0.0 AS score FROM documents LEFT JOIN l USING (doc_id) GROUP BY documents.doc_id"""


ORACLES: dict[str, str] = {
    "op6_lm_scoring": _model_sql(),
    "op9_license_scan": _license_sql(),
    "op3_chat_format": r"""WITH told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, length(regexp_replace(text, '[^\\<#]', '', 'g')) AS escapes, length(regexp_replace(role, '[^\\<#\n]', '', 'g')) AS role_escapes FROM told)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(4 + length(role) + role_escapes + 1 + length(text) + escapes + 8) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id""",
    "op4_near_duplicates": f"""WITH RECURSIVE s AS ({_shingles("documents", "doc_id")}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y) SELECT x AS doc_id, min(y) AS class_id, (SELECT count(*) FROM l WHERE l.x = reach.x) AS n_links FROM reach GROUP BY x""",
    "op7_decontaminate": f"""WITH d AS ({RUNS.format(lower=LOWER)}), i AS ({_shingles("benchmark", "item_id")}), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id), m AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, c AS n_common, c / n AS containment FROM m JOIN n USING (item_id) WHERE 10 * c >= 8 * n""",
    # A window's string by doubling, 50 = 32 + 16 + 2.
    "op8_suffix_dedup": """WITH r AS (SELECT doc_id, unnest(h) AS byte, generate_subscripts(h, 1) AS j FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents)),
a AS (SELECT *, byte || lead(byte, 1) OVER p AS s2 FROM r WINDOW p AS (PARTITION BY doc_id ORDER BY j)), b AS (SELECT *, s2 || lead(s2, 2) OVER p AS s4 FROM a WINDOW p AS (PARTITION BY doc_id ORDER BY j)), c AS (SELECT *, s4 || lead(s4, 4) OVER p AS s8 FROM b WINDOW p AS (PARTITION BY doc_id ORDER BY j)),
d AS (SELECT doc_id, j, byte, s2, s8 || lead(s8, 8) OVER p AS s16 FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY j)), e AS (SELECT *, s16 || lead(s16, 16) OVER p AS s32 FROM d WINDOW p AS (PARTITION BY doc_id ORDER BY j)), w AS (SELECT doc_id, j, byte, s32 || lead(s16, 32) OVER p || lead(s2, 48) OVER p AS s FROM e WINDOW p AS (PARTITION BY doc_id ORDER BY j)),
f AS (SELECT s, min(doc_id) AS m FROM w WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) <> max(doc_id)), g AS (SELECT doc_id, j, byte, coalesce(max(CASE WHEN m < doc_id THEN j END) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS cut FROM w LEFT JOIN f USING (s)),
k AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY j), false) AS first FROM g)
SELECT doc_id, count(j) AS n_bytes, count(*) FILTER (cut) AS n_removed, count(*) FILTER (first) AS n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY j) FILTER (NOT cut), ''))) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id""",
    "op11_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, len(w) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS r FROM d), f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM e),
g AS (SELECT *, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, array_to_string(w[1 : a], '') AS p, array_to_string(w[a + 1 : b], '') AS m, array_to_string(w[b + 1 :], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM g""",
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT x, max(page_id) AS best FROM p GROUP BY x)
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
 CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM p JOIN m USING (x)""",
}
