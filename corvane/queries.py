"""Queries over the driver's tables, one for each operator or group of operators, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import formats, vectors
from .functions.text import stem, tokens
from .operators import catalog, codegraph, export, fts, graphs, kg, rank, retrieval, segments
from .operators.corpus import specs_from_documents
from .session import shared_folder, table
from .streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A text's first paragraph: lines trimmed, headings left out, up to the first blank line behind the start; 300 characters.
SUMMARY = """(SELECT coalesce(left(array_to_string(list_filter(ls[f : coalesce(e, len(ls) + 1) - 1], lambda x: NOT starts_with(x, '#')), ' '), 300), '') FROM (SELECT ls, f, list_filter(range(1, len(ls) + 1), lambda i: i > f AND ls[i] = '')[1] AS e FROM
 (SELECT ls, list_filter(range(1, len(ls) + 1), lambda i: ls[i] <> '' AND NOT starts_with(ls[i], '#'))[1] AS f FROM (SELECT list_transform(string_split(coalesce({0}, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(12) || chr(13))) AS ls))))"""
SPECS = f"""specs AS (SELECT d.source || ':' || d.lang || '/doc_' || d.doc_id || '.md' AS spec_id, d.source AS repo, d.lang || '/doc_' || d.doc_id || '.md' AS path, d.lang AS project,
 'doc_' || d.doc_id AS name, 'doc_' || d.doc_id AS title, list_filter([d.lang, CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags,
 1704067200 + d.doc_id * 3600 AS modified_unix, strlen(d.text) AS size, 'md' AS ext, {SUMMARY.format("d.text")} AS summary, d.text AS content, d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id))"""


def query(sql: str | None = None, specs: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {SPECS} " if specs else "") + sql
        return f

    return register


# Catalog


@query("SELECT repo, project, count(*) AS n_specs FROM specs GROUP BY ALL", specs=True)
def catalog_projects(spark, d):
    return catalog.projects(specs_from_documents(spark, d))


@query("SELECT tag, count(*) AS n_specs FROM (SELECT unnest(tags) AS tag FROM specs) GROUP BY ALL", specs=True)
def catalog_tags(spark, d):
    return catalog.tags(specs_from_documents(spark, d))


@query("SELECT count(DISTINCT repo) AS n_repos, count(*) AS n_specs, count(DISTINCT project) AS n_projects, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_bytes, (SELECT count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM specs)) AS n_tags FROM specs", specs=True)
def catalog_stats(spark, d):
    return catalog.stats(specs_from_documents(spark, d))


@query("SELECT r.repo, count(s.repo) AS n_specs FROM (SELECT DISTINCT source AS repo FROM documents UNION SELECT 'empty') r LEFT JOIN specs s USING (repo) GROUP BY ALL", specs=True)
def catalog_repos(spark, d):
    specs = specs_from_documents(spark, d)
    registry = specs.select("repo").distinct().union(spark.createDataFrame([("empty",)], "repo string"))
    return catalog.repos(registry, specs)


@query("SELECT spec_id, project, name FROM specs WHERE repo = 'src3'", specs=True)
def catalog_list(spark, d):
    return catalog.listing(specs_from_documents(spark, d), "src3").select("spec_id", "project", "name")


@query("SELECT spec_id, repo, name FROM specs WHERE project = 'fr'", specs=True)
def catalog_list_project(spark, d):
    return catalog.listing(specs_from_documents(spark, d), "fr").select("spec_id", "repo", "name")


@query("SELECT spec_id, modified_unix FROM specs ORDER BY modified_unix DESC, repo, path LIMIT 10", specs=True)
def catalog_recent(spark, d):
    return catalog.recent(specs_from_documents(spark, d)).select("spec_id", "modified_unix")


@query("SELECT spec_id FROM specs WHERE list_contains(tags, 'toxic')", specs=True)
def catalog_by_tag(spark, d):
    return catalog.by_tag(specs_from_documents(spark, d), "Toxic").select("spec_id")


@query("SELECT spec_id FROM specs WHERE lower(name) = 'doc_7' AND path ILIKE '%'", specs=True)
def catalog_read(spark, d):
    return catalog.read(specs_from_documents(spark, d), "DOC_7", directory="").select("spec_id")


@query("SELECT spec_id, size FROM specs WHERE path ILIKE 'EN/doc_1%'", specs=True)
def filter_directory(spark, d):
    specs = specs_from_documents(spark, d)
    return specs.where(catalog.in_directory(F.col("path"), "EN/doc_1")).select("spec_id", "size")


@query("SELECT spec_id FROM specs WHERE NOT contains(path, 'fr/') AND NOT contains(path, '_9')", specs=True)
def filter_location(spark, d):
    return catalog.excluding(specs_from_documents(spark, d), ["fr/", "_9"]).select("spec_id")


@query("SELECT ext, count(*) AS n FROM specs GROUP BY ALL", specs=True)
def facets_extension(spark, d):
    return catalog.extension_facets(specs_from_documents(spark, d))


@query("SELECT tag, count(*) AS n_specs FROM (SELECT unnest(tags) AS tag FROM specs) GROUP BY ALL ORDER BY n_specs DESC, tag LIMIT 10", specs=True)
def facets_top_tags(spark, d):
    return catalog.top_tags(specs_from_documents(spark, d))


@query("SELECT spec_id FROM specs WHERE repo IN ('src1', 'src2') AND list_has_any(tags, ['quality', 'toxic']) AND contains(name, '_1')", specs=True)
def facets_explorer(spark, d):
    nodes = specs_from_documents(spark, d)
    return catalog.facets(nodes, repos=["src1", "src2"], tags=["quality", "toxic"], text="_1").select("spec_id")


# Full text, over all six columns. Phrases as lists of terms; prefixes end with *.

_indexes: dict[tuple, segments.Segments] = {}


def built_index(spark: SparkSession, d: str, porter: bool = False) -> segments.Segments:
    """The index of a folder's specs, made once in a session: building it is one thing, querying it another."""
    key = spark.sparkContext.applicationId, d, porter
    if key not in _indexes:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        _indexes[key] = segments.create(spark, path, specs_from_documents(spark, d), fts.COLUMNS, porter)
    return _indexes[key]


TOKENS = r"""flat AS (SELECT spec_id, unnest(['repo', 'name', 'title', 'tags', 'summary', 'content']) AS col, unnest([repo, name, title, array_to_string(tags, ', '), summary, content]) AS t FROM specs),
arrays AS (SELECT spec_id, col, regexp_extract_all(strip_accents(lower(t)), '[\p{L}\p{N}]+') AS ts FROM flat),
toks AS (SELECT spec_id, col, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM arrays), lens AS (SELECT spec_id, CAST(sum(len(ts)) AS BIGINT) AS n_tokens FROM arrays GROUP BY ALL), totals AS (SELECT count(*) AS n_docs, avg(n_tokens) AS mean_tokens FROM lens)"""


def _fts_sql(phrases: list[str], truth: str, scored: list[int], extra: dict[int, str] | None = None, limit: int = 0) -> str:
    parts = []
    for k, p in enumerate(phrases):
        terms = p.split()
        cond = lambda t, a: f"starts_with({a}.term, '{t[:-1]}')" if t.endswith("*") else f"{a}.term = '{t}'"
        joins = "".join(f" JOIN toks t{j} ON t{j}.spec_id = t0.spec_id AND t{j}.col = t0.col AND t{j}.pos = t0.pos + {j} AND {cond(t, f't{j}')}" for j, t in enumerate(terms) if j)
        parts.append(f"p{k} AS (SELECT t0.spec_id, count(*) AS tf FROM toks t0{joins} WHERE {cond(terms[0], 't0')}{(extra or {}).get(k, '')} GROUP BY ALL)")
    rows = lambda k: f"(SELECT count(DISTINCT spec_id) FROM toks WHERE term = '{phrases[k]}')" if "EXISTS" in (extra or {}).get(k, "") else f"(SELECT count(*) FROM p{k})"
    joined = "lens " + " ".join(f"LEFT JOIN p{k} USING (spec_id)" for k in range(len(phrases)))
    score = " + ".join(f"(CASE WHEN n_docs - {rows(k)} <= {rows(k)} THEN 1e-6 ELSE ln((n_docs - {rows(k)} + 0.5) / ({rows(k)} + 0.5)) END) * coalesce(p{k}.tf, 0) * 2.2 / (coalesce(p{k}.tf, 0) + 1.2 * (0.25 + 0.75 * n_tokens / mean_tokens))" for k in scored)
    has = truth
    for k in range(len(phrases)):
        has = has.replace(f"#{k}", f"(p{k}.tf IS NOT NULL)")
    end = f" ORDER BY rank, spec_id LIMIT {limit}" if limit else ""
    return f"WITH {SPECS}, {TOKENS}, {', '.join(parts)} SELECT spec_id, round(-({score}), 9) AS rank FROM {joined} CROSS JOIN totals WHERE {has}{end}"


def _fts(name: str, text: str, oracle: str | None, limit: int = 0, porter: bool = False) -> None:
    def run(spark, d):
        idx = built_index(spark, d, porter)
        # Ranks of nine places may tie where those of all places do not; ties are then in order of spec_id, and a few more hits decide the last.
        found = fts.top(idx, text, 2 * limit) if limit else fts.search(idx, text)
        found = found.withColumn("rank", F.round("rank", 9))
        return found.orderBy("rank", "spec_id").limit(limit) if limit else found

    run.__name__ = name
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


_close = lambda other: f" AND EXISTS (FROM toks o WHERE o.spec_id = t0.spec_id AND o.col = t0.col AND o.term = '{other}' AND greatest(o.pos, t0.pos) - least(o.pos, t0.pos) - 1 <= 3)"
_fts("fts_search", "the OR eant OR erkeit", _fts_sql(["the", "eant", "erkeit"], "#0 OR #1 OR #2", [0, 1, 2], limit=200), limit=200)
_fts("fts_term", "erheed", _fts_sql(["erheed"], "#0", [0]))
_fts("fts_and", "the of with", _fts_sql(["the", "of", "with"], "#0 AND #1 AND #2", [0, 1, 2]))
_fts("fts_or_and", "la AND de OR der AND die", _fts_sql(["la", "de", "der", "die"], "(#0 AND #1) OR (#2 AND #3)", [0, 1, 2, 3]))
_fts("fts_not", "the NOT with of", _fts_sql(["the", "with", "of"], "#0 AND NOT (#1 AND #2)", [0]))
_fts("fts_not_and", "the NOT with AND of", _fts_sql(["the", "with", "of"], "(#0 AND NOT #1) AND #2", [0, 2]))
_fts("fts_prefix", "ononh*", _fts_sql(["ononh*"], "#0", [0]))
_fts("fts_phrase", '"of the" OR "to the"', _fts_sql(["of the", "to the"], "#0 OR #1", [0, 1]))
_fts("fts_phrase_prefix", 'the + er*', _fts_sql(["the er*"], "#0", [0]))
_fts("fts_repeated", "the OR the OR src1", _fts_sql(["the", "the", "src1"], "#0 OR #1 OR #2", [0, 1, 2]))
_fts("fts_first", "^the", _fts_sql(["the"], "#0", [0], {0: " AND t0.pos = 0"}))
_fts("fts_near", "NEAR(with by, 3)", _fts_sql(["with", "by"], "#0 AND #1", [0, 1], {0: _close("by"), 1: _close("with")}))
_fts("fts_column", "summary:the AND {name content}: of NOT -content: toxic", _fts_sql(["the", "of", "toxic"], "#0 AND (#1 AND NOT #2)", [0, 1], {0: " AND t0.col = 'summary'", 1: " AND t0.col IN ('name', 'content')", 2: " AND t0.col <> 'content'"}))
_fts("fts_fallback", "the/ (of", _fts_sql(["the", "of"], "#0 AND #1", [0, 1]))
_fts("fts_accents", "éte OR etre", _fts_sql(["ete", "etre"], "#0 OR #1", [0, 1]))
_fts("fts_stemmed", "threads OR being", None, porter=True)


@query(f"WITH {SPECS}, {TOKENS} SELECT term, count(*) AS n_places, count(DISTINCT spec_id) AS n_specs FROM toks GROUP BY ALL")
def fts_dictionary(spark, d):
    return built_index(spark, d).dictionary()


RANKED = """tf AS (SELECT k, spec_id, count(*) AS tf FROM q JOIN toks ON term = word GROUP BY ALL), df AS (SELECT k, count(*) AS df FROM tf GROUP BY ALL),
ranks AS (SELECT spec_id, -sum((CASE WHEN n_docs - df <= df THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean_tokens))) AS rank FROM tf JOIN df USING (k) JOIN lens USING (spec_id) CROSS JOIN totals GROUP BY spec_id)"""


@query(f"""WITH {SPECS}, {TOKENS}, q AS (SELECT unnest(tags) AS word, generate_subscripts(tags, 1) AS k FROM (SELECT tags FROM specs WHERE lower(name) = 'doc_5' ORDER BY repo, path LIMIT 1)), {RANKED}
SELECT spec_id, repo, project, name, round(rank, 9) AS rank FROM ranks JOIN specs USING (spec_id) WHERE lower(name) <> 'doc_5' ORDER BY round(rank, 9), repo, path LIMIT 10""")
def retrieval_related(spark, d):
    found = catalog.related(specs_from_documents(spark, d), built_index(spark, d), "DOC_5", n=None).withColumn("rank", F.round("rank", 9))
    return found.orderBy("rank", "repo", "path").limit(10).select("spec_id", "repo", "project", "name", "rank")


@query(f"""WITH {SPECS}, {TOKENS}, q AS (SELECT unnest(['the', 'eant']) AS word, unnest([0, 1]) AS k), {RANKED}
SELECT spec_id, repo, project, name, title, array_to_string(tags, ',') AS tags, path, ext, round(rank, 9) AS rank FROM ranks JOIN specs USING (spec_id) WHERE repo = 'src2' AND path ILIKE 'EN/doc_1%' ORDER BY round(rank, 9), spec_id LIMIT 200""")
def retrieval_search(spark, d):
    found = fts.search_specs(built_index(spark, d), specs_from_documents(spark, d), "the OR eant", ["src2"], "EN/doc_1", limit=None)
    return found.withColumns({"rank": F.round("rank", 9), "tags": F.array_join("tags", ",")}).orderBy("rank", "spec_id").limit(200)


@query(f"""WITH {SPECS}, {TOKENS}, q AS (SELECT unnest(['la', 'erkeit']) AS word, unnest([0, 1]) AS k), {RANKED}
SELECT spec_id, round(rank, 9) AS rank, row_number() OVER (PARTITION BY repo ORDER BY round(rank, 9), spec_id) AS place, repo FROM ranks JOIN specs USING (spec_id) WHERE repo IN ('src3', 'src1') QUALIFY place <= 200""")
def retrieval_by_repo(spark, d):
    """Each repo's best; ranks are rounded, so ties go by id in both."""
    specs = specs_from_documents(spark, d)
    hits = fts.search(built_index(spark, d), "la OR erkeit").join(specs.select("spec_id", "repo"), "spec_id").withColumn("rank", F.round("rank", 9))
    found = rank.per_repo(hits, ["src3", "src1"])
    return found.select("spec_id", "rank", F.row_number().over(Window.partitionBy("repo").orderBy("rank", "spec_id")).cast("long").alias("place"), "repo")


# Vectors and ranks

UNIT = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS vec FROM embeddings)"""


def _units(spark, d):
    """Vectors of length 1. They are dealt out as they are stored, as one large file would be one task."""
    return table(spark, d, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id").select(F.col("vec_id").alias("id"), "label", vectors.unit(F.col("embedding")).alias("vec"))


@query(f"WITH {UNIT} SELECT x.label AS block, x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.vec, y.vec), 6) AS weight FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_dot_product(x.vec, y.vec) >= 0.3")
def vectors_pairs(spark, d):
    return graphs.pairs_of_vectors(_units(spark, d).withColumnRenamed("label", "block")).withColumn("weight", F.round("weight", 6))


@query(f"WITH {UNIT} SELECT q.vec_id AS query, x.vec_id AS id, round(list_dot_product(q.vec, x.vec), 6) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.vec, x.vec) DESC, x.vec_id) AS place FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id QUALIFY place <= 8")
def vectors_nearest(spark, d):
    v = _units(spark, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    return graphs.nearest(q, v, 8).withColumn("cosine", F.round("cosine", 6)).withColumn("place", F.col("place").cast("long"))


def _greedy_sql(before: str, nodes: str, pairs: str) -> str:
    """Pairs (block, a, b, w) taken one by one in each block, heaviest first, while both ends have fewer than eight: a step of the recursion looks at each block's next pair."""
    return f"""WITH RECURSIVE {before}, n AS (SELECT block, id, row_number() OVER (PARTITION BY block ORDER BY id) AS k FROM ({nodes})), p AS ({pairs}),
e AS (SELECT p.block, a, b, w, x.k AS ka, y.k AS kb, row_number() OVER (PARTITION BY p.block ORDER BY w DESC, a, b) AS i FROM p JOIN n x ON x.block = p.block AND x.id = a JOIN n y ON y.block = p.block AND y.id = b),
g(block, i, deg, took) AS (SELECT block, CAST(0 AS BIGINT), list(0), false FROM n GROUP BY block UNION ALL
 SELECT g.block, e.i, CASE WHEN g.deg[e.ka] < 8 AND g.deg[e.kb] < 8 THEN list_transform(g.deg, lambda x, j: CASE WHEN j = e.ka OR j = e.kb THEN x + 1 ELSE x END) ELSE g.deg END, g.deg[e.ka] < 8 AND g.deg[e.kb] < 8 FROM g JOIN e ON e.block = g.block AND e.i = g.i + 1)
SELECT e.block, a, b, floor(w * 1e4 + 0.5) / 1e4 AS weight FROM g JOIN e ON e.block = g.block AND e.i = g.i WHERE took"""


@query(_greedy_sql(UNIT, "SELECT label AS block, vec_id AS id FROM v", "SELECT x.label AS block, x.vec_id AS a, y.vec_id AS b, list_dot_product(x.vec, y.vec) AS w FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_dot_product(x.vec, y.vec) >= 0.3"))
def graph_knn(spark, d):
    return graphs.near_links(_units(spark, d).withColumnRenamed("label", "block"))


@query(f"""WITH {UNIT}, c AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.vec, y.vec) AS w FROM v x JOIN v y ON x.vec_id <> y.vec_id), mid AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY list_dot_product(vec, q) DESC, vec_id) AS seed FROM v CROSS JOIN mid QUALIFY seed <= 10),
near AS (SELECT a, b, w, seed, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS place FROM c JOIN seeds ON a = vec_id WHERE w >= 0.3 QUALIFY place <= 8)
SELECT a AS source, b AS target, floor(w * 1e4 + 0.5) / 1e4 AS weight FROM near QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seed, place) = 1""")
def graph_ego(spark, d):
    """About the first vector as it stands, which is a query and no node."""
    first = table(spark, d, "embeddings").orderBy("vec_id").limit(1)
    q = first.select(F.lit(-1).cast("long").alias("query"), F.transform("embedding", lambda x: x.cast("double")).alias("qvec"))
    return graphs.ego(q, _units(spark, d))[1].select("source", "target", "weight")


@query(f"WITH {UNIT}, hits AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1], vec_id) - 1 AS i FROM embeddings QUALIFY i < 200), near AS (SELECT h.vec_id, row_number() OVER (ORDER BY list_dot_product(x.vec, q.vec) DESC, i) - 1 AS j FROM hits h JOIN v x USING (vec_id) JOIN v q ON q.vec_id = 0) SELECT vec_id AS spec_id, round(1.0 / (60 + i) + 1.0 / (60 + j), 9) AS score FROM hits JOIN near USING (vec_id) ORDER BY 1.0 / (60 + i) + 1.0 / (60 + j) DESC, i LIMIT 50")
def rank_rrf(spark, d):
    raw, v = table(spark, d, "embeddings"), _units(spark, d)
    q = v.where("id = 0").select(F.col("vec").alias("q"))
    cosine = v.join(F.broadcast(q)).select(F.col("id").alias("spec_id"), vectors.dot(F.col("vec"), F.col("q")).alias("cosine"))
    hits = raw.select(F.col("vec_id").alias("spec_id"), F.col("embedding")[0].alias("rank"))
    return rank.rrf(hits, cosine).withColumn("score", F.round("score", 9))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS t FROM documents), n AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT t, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(0, CAST(strlen(t) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(t)), 2 * i + 1, 2) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS h FROM (SELECT DISTINCT t FROM n)),
s AS (SELECT doc_id, CAST(h % 256 AS INTEGER) AS bucket, CAST(sum(CASE WHEN h & 65536 <> 0 THEN n ELSE -n END) AS DOUBLE) AS w FROM n JOIN h USING (t) GROUP BY ALL HAVING w <> 0)
SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM s""")
def vectors_embedding(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))
    return vectors.hashed_weights(docs, "doc_id", "tokens").withColumn("weight", F.round("weight", 6))


@query("""WITH hits AS (SELECT source AS repo, 'doc_' || doc_id AS name, -1.0 * n_chars / 1000 AS rank FROM documents), deg AS (SELECT source AS repo, 'doc_' || doc_id AS low, doc_id % 50 AS degree FROM documents WHERE lang <> 'fr')
SELECT repo, name, round(rank * least(1.5, 1 + ln(1 + coalesce(degree, 0)) / 8), 9) AS rank FROM hits LEFT JOIN deg ON hits.repo = deg.repo AND hits.name = deg.low""".replace("SELECT repo, name, round", "SELECT hits.repo, name, round"))
def rank_graph_aware(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("doc_"), "doc_id")
    hits = docs.select(F.col("source").alias("repo"), name.alias("name"), (F.col("n_chars") * F.lit(-1.0) / 1000).alias("rank"))
    degrees = docs.where("lang <> 'fr'").select(F.col("source").alias("repo"), F.upper(name).alias("label"), (F.col("doc_id") % 50).alias("degree"))
    return rank.graph_aware(hits, degrees).select("repo", "name", F.round("rank", 9).alias("rank"))


@query("SELECT s.repo AS block, s.spec_id AS a, t.spec_id AS b, round(len(list_intersect(s.tags, t.tags)) / len(list_distinct(list_concat(s.tags, t.tags))), 6) AS weight FROM specs s JOIN specs t ON s.repo = t.repo AND s.spec_id < t.spec_id WHERE len(list_intersect(s.tags, t.tags)) > 0", specs=True)
def graph_tag_pairs(spark, d):
    specs = specs_from_documents(spark, d).select(F.col("repo").alias("block"), F.col("spec_id").alias("id"), "tags")
    return graphs.pairs_of_tags(specs).withColumn("weight", F.round("weight", 6))


@query(_greedy_sql(SPECS, "SELECT repo AS block, spec_id AS id FROM specs", "SELECT x.repo AS block, x.spec_id AS a, y.spec_id AS b, len(list_intersect(x.tags, y.tags)) / len(list_distinct(list_concat(x.tags, y.tags))) AS w FROM specs x JOIN specs y ON x.repo = y.repo AND x.spec_id < y.spec_id WHERE list_has_any(x.tags, y.tags)"))
def graph_tag_links(spark, d):
    specs = specs_from_documents(spark, d).select(F.col("repo").alias("block"), F.col("spec_id").alias("id"), "tags")
    return graphs.links_of_tags(specs)


# Graphs as they are given out

@query("SELECT spec_id AS id, name AS label, lower(name) AS norm_label, repo, project, path, ext AS file_type, array_to_string(tags, ',') AS tags FROM specs", specs=True)
def graph_nodes(spark, d):
    nodes = export.spec_nodes(specs_from_documents(spark, d))
    return nodes.select("id", "label", "norm_label", "repo", "project", "path", "file_type", F.array_join("tags", ",").alias("tags"))


@query("WITH top AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents QUALIFY place < 20) SELECT '__query__' AS source, source || ':' || lang || '/doc_' || doc_id || '.md' AS target, round(greatest(0.2, 0.9 - 0.08 * place), 6) AS weight FROM top")
def graph_star(spark, d):
    top = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(20)  # a list of results
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1)
    path = F.concat("lang", F.lit("/doc_"), "doc_id", F.lit(".md"))
    results = placed.select(F.concat("source", F.lit(":"), path).alias("spec_id"), F.concat(F.lit("doc_"), "doc_id").alias("label"), path.alias("path"), "place")
    return export.star(results)[1].withColumn("weight", F.round("weight", 6))


@query("SELECT spec_id AS id, spec_id IN (SELECT spec_id FROM specs WHERE list_contains(tags, 'quality')) OR path IN (SELECT path FROM specs WHERE list_contains(tags, 'quality')) AS is_source FROM specs", specs=True)
def graph_sources(spark, d):
    specs = specs_from_documents(spark, d)
    return export.with_sources(export.spec_nodes(specs).select("id", "path"), specs.where(F.array_contains("tags", "quality"))).select("id", "is_source")


@query("SELECT DISTINCT CASE WHEN source = 'src1' THEN 'hld' WHEN source = 'src2' THEN 'adr' WHEN source = 'src3' THEN 'code' ELSE 'doc' END AS kind FROM documents")
def graph_kinds(spark, d):
    ends = F.when(F.col("source") == "src1", "docs/HLD/a.md").when(F.col("source") == "src2", "x/docs/decisions/a.md").when(F.col("source") == "src3", "a.py").otherwise("a.rst")
    return export.kinds(table(spark, d, "documents").select(ends.alias("path"))).select("kind")


@query("SELECT repo, row_number() OVER (ORDER BY repo IN ('src3', 'src4') DESC, repo <> 'src1' DESC, count(*) DESC, repo) AS place FROM specs GROUP BY repo", specs=True)
def catalog_picker(spark, d):
    repos = specs_from_documents(spark, d).groupBy("repo").agg(F.count("*").alias("n_specs")).withColumn("has_graph", F.col("repo") != "src1")
    ordered = export.picker(repos, ["src3", "src4"])
    return ordered.select("repo", F.row_number().over(Window.orderBy(F.desc("selected"), F.desc("has_graph"), F.desc("n_specs"), "repo")).cast("long").alias("place"))


# Knowledge graph: made declarations and edges of documents

DECLS = """decls AS (SELECT source AS repo, lang || '/' || doc_id || '.md' AS path, 'component://c' || (doc_id % 97) AS id, CASE WHEN doc_id % 5 = 0 THEN 'file' ELSE 'component' END AS kind, 'T' || doc_id AS title FROM documents),
edges AS (SELECT DISTINCT 'component://c' || (doc_id % 97) AS src, 'component://c' || ((doc_id * 7) % 120) AS dst, CASE WHEN doc_id % 2 = 0 THEN 'depends_on' ELSE 'upstream' END AS type, source AS repo, lang || '/' || doc_id || '.md' AS path, 'dependsOn' AS field FROM documents)"""
NODES = """keyed AS (SELECT *, repo || ':' || path AS key FROM decls), nodes AS (SELECT id, arg_min(kind, key) AS kind, arg_min(repo, key) AS repo, arg_min(path, key) AS path, arg_min(title, key) AS title, CASE WHEN count(*) > 1 THEN 'conflict' ELSE '' END AS flags, list_sort(list(key)) AS provenance FROM keyed GROUP BY id
UNION ALL SELECT id, 'component', '', '', '', 'unresolved', CAST([] AS VARCHAR[]) FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM decls))"""


def _decls(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat("lang", F.lit("/"), "doc_id", F.lit(".md"))
    own = F.concat(F.lit("component://c"), F.col("doc_id") % 97)
    decls = docs.select(F.col("source").alias("repo"), path.alias("path"), own.alias("id"), F.when(F.col("doc_id") % 5 == 0, "file").otherwise("component").alias("kind"), F.concat(F.lit("T"), "doc_id").alias("title"))
    edges = docs.select(own.alias("src"), F.concat(F.lit("component://c"), (F.col("doc_id") * 7) % 120).alias("dst"), F.when(F.col("doc_id") % 2 == 0, "depends_on").otherwise("upstream").alias("type"), F.col("source").alias("repo"), path.alias("path"), F.lit("dependsOn").alias("field")).distinct()
    return decls, edges


@query(f"WITH {DECLS}, {NODES} SELECT id, kind, repo, path, title, flags, array_to_string(provenance, '|') AS provenance FROM nodes")
def kg_resolve(spark, d):
    return kg.resolve(*_decls(spark, d)).withColumn("provenance", F.array_join("provenance", "|"))


@query(f"""WITH {DECLS}, {NODES} SELECT d.repo, count(*) FILTER (kind = 'file') AS n_structural, count(*) FILTER (kind <> 'file') AS n_typed, (SELECT count(*) FROM edges e WHERE e.repo = d.repo) AS n_edges,
(SELECT count(DISTINCT x.id) FROM decls x JOIN nodes n USING (id) WHERE x.repo = d.repo AND n.flags = 'conflict') AS n_conflicts,
(SELECT count(DISTINCT n.id) FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.repo = d.repo AND n.flags = 'unresolved') AS n_unresolved FROM decls d GROUP BY d.repo""")
def kg_summary(spark, d):
    decls, edges = _decls(spark, d)
    return kg.summary(decls, edges, kg.resolve(decls, edges))


@query(f"WITH {DECLS} SELECT 'outgoing' AS direction, * FROM edges WHERE src = 'component://c7' UNION ALL SELECT 'incoming', * FROM edges WHERE dst = 'component://c7'")
def kg_explain(spark, d):
    decls, edges = _decls(spark, d)
    _, out, back = kg.explain(kg.resolve(decls, edges), edges, "component://c7")
    return out.select(F.lit("outgoing").alias("direction"), *edges.columns).union(back.select(F.lit("incoming"), *edges.columns))


@query(f"WITH {DECLS}, {NODES} SELECT concat_ws(chr(9), 'node', id, kind, repo, path, title, flags, CAST(to_json(provenance) AS VARCHAR)) AS line FROM nodes UNION ALL SELECT concat_ws(chr(9), 'edge', src, type, dst, repo, path, field) FROM edges")
def kg_export(spark, d):
    decls, edges = _decls(spark, d)
    return kg.export(kg.resolve(decls, edges), edges)


@query()
def kg_fingerprint(spark, d):
    return kg.fingerprint(*_decls(spark, d))


# Code graph: regions call nations, and these customers and suppliers

CODE = """nodes AS (SELECT 'r' || r_regionkey AS name, 'r' || r_regionkey AS qualified_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey || '.n' || n_nationkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey || '.n' || n_nationkey || '.s' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
edges AS (SELECT 'r' || n_regionkey AS s, 'r' || n_regionkey || '.n' || n_nationkey AS t FROM nation UNION ALL SELECT 'r' || n_regionkey || '.n' || n_nationkey, 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'r' || n_regionkey || '.n' || n_nationkey || '.s' || s_suppkey, 'r' || n_regionkey || '.n' || n_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def _code(spark, d):
    read = lambda n: table(spark, d, n)
    r, n = F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey")
    cust = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("name"), n.alias("above"))
    supp = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("name"), n.alias("above"))
    under = F.concat("above", F.lit("."), "name")
    nodes = read("region").select(r.alias("name"), r.alias("qualified_name")).union(read("nation").select(F.concat(F.lit("n"), "n_nationkey"), n)).union(cust.select("name", under)).union(supp.select("name", under))
    links = read("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("source_qualified"), n.alias("target_qualified")).union(cust.select("above", under)).union(supp.select(under, "above"))
    return nodes, links.withColumn("kind", F.lit("CALLS"))


@query(f"WITH {CODE} SELECT qualified_name, CASE WHEN name = 'n1' THEN 0 WHEN ends_with(qualified_name, '.n1') THEN 1 ELSE 2 END AS place FROM nodes WHERE contains(qualified_name, 'n1') ORDER BY place, length(qualified_name), qualified_name LIMIT 50")
def code_find(spark, d):
    return codegraph.find(_code(spark, d)[0], "N1").select("qualified_name", "place")


@query(f"WITH {CODE} SELECT qualified_name FROM nodes JOIN edges ON s = qualified_name WHERE t = 'r0.n0' ORDER BY 1 LIMIT 200")
def code_callers(spark, d):
    return codegraph.callers(*_code(spark, d), "r0.n0").select("qualified_name")


@query(f"WITH {CODE} SELECT qualified_name FROM nodes JOIN edges ON t = qualified_name WHERE s = 'r0.n0' ORDER BY 1 LIMIT 200")
def code_callees(spark, d):
    return codegraph.callees(*_code(spark, d), "r0.n0").select("qualified_name")


@query(f"WITH {CODE} SELECT qualified_name, count(s) AS degree FROM nodes LEFT JOIN edges ON s = qualified_name GROUP BY ALL ORDER BY degree DESC, qualified_name LIMIT 20")
def code_hubs(spark, d):
    return codegraph.hubs(*_code(spark, d)).select("qualified_name", "degree")


@query(f"WITH RECURSIVE {CODE}, ways AS (SELECT s, t FROM edges UNION SELECT t, s FROM edges), walk(q, hop) AS (SELECT 'r1', 0 UNION SELECT t, hop + 1 FROM walk JOIN ways ON s = q WHERE hop < 3) SELECT q AS qualified_name, CAST(min(hop) AS INTEGER) AS hop FROM walk WHERE q <> 'r1' GROUP BY q ORDER BY hop, q LIMIT 50")
def code_blast(spark, d):
    return codegraph.blast(*_code(spark, d), "r1", hops=3).select("qualified_name", "hop")


# Retrieval from three sources. Code is that above with nation 1 named en, so that one query meets all of them.

CALLS = rf"""{CODE}, cn AS (SELECT CASE WHEN name = 'n1' THEN 'en' ELSE name END AS name, regexp_replace(qualified_name, '\.n1(\.|$)', '.en\1') AS qn FROM nodes), ce AS (SELECT regexp_replace(s, '\.n1(\.|$)', '.en\1') AS s, regexp_replace(t, '\.n1(\.|$)', '.en\1') AS t FROM edges)"""
FOUND = f"""{SPECS}, {TOKENS}, {CALLS}, q AS (SELECT 'en' AS word, 0 AS k), {RANKED},
docs AS (SELECT repo, name, -rank AS score FROM ranks JOIN specs USING (spec_id) WHERE repo IN ('src1', 'src2') ORDER BY rank, spec_id LIMIT 20),
graph AS (SELECT source AS repo, lang || ' ' || doc_id AS name, ln(1 + doc_id % 30) AS score FROM documents WHERE source IN ('src1', 'src2') AND contains(lang || ' ' || doc_id, 'en') QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id % 30 DESC, doc_id) <= 10),
deg AS (SELECT name, qn, count(s) AS degree FROM cn LEFT JOIN ce ON s = qn GROUP BY ALL),
code AS (SELECT 'graph:calls' AS repo, qn AS name, ln(1 + degree) + CASE WHEN name = 'en' THEN 0.5 WHEN ends_with(qn, '.en') THEN 0.25 ELSE 0 END AS score FROM deg WHERE contains(qn, 'en') ORDER BY CASE WHEN name = 'en' THEN 0 WHEN ends_with(qn, '.en') THEN 1 ELSE 2 END, length(qn), qn LIMIT 10),
u AS (SELECT 'specs' AS type, 1.0 AS w, * FROM docs UNION ALL SELECT 'graph', 0.7, * FROM graph UNION ALL SELECT 'code', 0.8, * FROM code), m AS (SELECT type, min(score) AS lo, max(score) AS hi FROM u GROUP BY ALL),
scored AS (SELECT type, repo, name, round(w * CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END, 6) AS score FROM u JOIN m USING (type))"""
SCOPE = ["src1", "nobody", "graph:calls", "src2", "graph:lost"]


def _sources(spark, d) -> retrieval.Sources:
    docs = table(spark, d, "documents")
    graph = docs.select(F.col("source").alias("repo"), F.col("doc_id").alias("id"), F.concat("lang", F.lit(" "), "doc_id").alias("label"), (F.col("doc_id") % 30).alias("degree"))
    nodes, edges = _code(spark, d)
    named = lambda c: F.regexp_replace(c, r"\.n1(\.|$)", ".en$1")
    nodes = nodes.select(F.lit("graph:calls").alias("graph"), F.when(F.col("name") == "n1", "en").otherwise(F.col("name")).alias("name"), named("qualified_name").alias("qualified_name"))
    edges = edges.select(F.lit("graph:calls").alias("graph"), "kind", named("source_qualified").alias("source_qualified"), named("target_qualified").alias("target_qualified"))
    return retrieval.Sources(built_index(spark, d), specs_from_documents(spark, d), graph, nodes, edges, [f"src{k}" for k in range(8)], ["src1", "src2"], ["src1", "graph:calls", "graph:lost"], ["src2", "src1", "graph:lost"])


@query(f"WITH {FOUND} SELECT * FROM scored ORDER BY score DESC, type, repo, name LIMIT 30")
def retrieval_find(spark, d):
    found, _ = retrieval.find(_sources(spark, d), "en", SCOPE, limit=None)
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "type", "repo", "name").limit(30)


@query("SELECT * FROM (VALUES ('src1', 'document graph unreadable'), ('src2', 'document graph unreadable'), ('src1', 'code graph unreadable'), ('graph:lost', 'code graph unreadable')) t(repo, reason)")
def retrieval_missing(spark, d):
    return retrieval.find(_sources(spark, d), "en", SCOPE)[1].select("repo", "reason")


@query(f"""WITH RECURSIVE {FOUND}, ways AS (SELECT s, t FROM ce UNION SELECT t, s FROM ce), top AS (SELECT name FROM code ORDER BY score DESC, name LIMIT 1),
walk(q, hop) AS (SELECT name, 0 FROM top UNION SELECT t, hop + 1 FROM walk JOIN ways ON s = q WHERE hop < 2), near AS (SELECT q AS qualified_name, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY q HAVING min(hop) > 0 ORDER BY hop, q LIMIT 50)
SELECT 'code' AS type, top.name, qualified_name, hop FROM top, near""")
def retrieval_context(spark, d):
    found, _ = retrieval.context(_sources(spark, d), "en", SCOPE, limit=None)
    return found.select("type", "name", F.explode("blast").alias("b")).select("type", "name", "b.qualified_name", "b.hop")


# Projections

@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024) ELSE printf('%.1f MB', n_chars / 1048576) END AS size, CASE WHEN doc_id = 0 THEN '—' WHEN doc_id * 37 < 60 THEN doc_id * 37 || 's' WHEN doc_id * 37 < 3600 THEN doc_id * 37 // 60 || 'm' WHEN doc_id * 37 < 86400 THEN doc_id * 37 // 3600 || 'h' ELSE doc_id * 37 // 86400 || 'd' END AS age, CASE WHEN length(text) > 20 THEN left(text, 19) || '…' ELSE text END AS short FROM documents")
def projection_formats(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", formats.human_bytes(F.col("n_chars")).alias("size"), formats.human_age(F.col("doc_id") * 37).alias("age"), formats.truncated(F.col("text"), 20).alias("short"))


@query("SELECT spec_id, summary FROM specs", specs=True)
def projection_summary(spark, d):
    return specs_from_documents(spark, d).select("spec_id", "summary")


@query()
def fts_stems(spark, d):
    @F.pandas_udf("string")
    def stems(terms: pd.Series) -> pd.Series:
        return terms.map(stem)

    words = table(spark, d, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    return words.select("term", stems("term").alias("stem"))


# Events and conversations

@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), a AS (SELECT conv_id, i, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM t WHERE role = 'assistant'),
s AS (SELECT a.conv_id, CASE WHEN p.role = 'user' THEN a.i - 1 ELSE a.i END AS start FROM a LEFT JOIN t p ON p.conv_id = a.conv_id AND p.i = a.i - 1 WHERE k = 3 AND EXISTS (FROM a b WHERE b.conv_id = a.conv_id AND b.k = 4))
SELECT conv_id, turn, role FROM t LEFT JOIN s USING (conv_id) WHERE s.start IS NULL OR t.i >= s.start""")
def events_cap_turns(spark, d):
    return events.cap_turns(table(spark, d, "conversations")).select("conv_id", "turn", "role")


#: White space as the classifier has it, in RE2's notation.
JS = r"\t\n\v\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


@query(rf"""WITH t AS (SELECT conv_id, turn, regexp_replace(HEAD, '[{JS}]+$', '') AS x FROM conversations)
SELECT conv_id, turn, ends_with(x, '?') AND length(x) <= 300 AND NOT regexp_matches(x, '\n[{JS}]*\n') AND NOT contains(x, '```') AND NOT regexp_matches(x, '(^|\n)[{JS}]{{0,3}}#{{1,6}}[{JS}]')
 AND NOT regexp_matches(x, '(^|\n)[{JS}]{{0,3}}([-*+]|[0-9]+[.)])[{JS}]') AND NOT regexp_matches(x, '(^|\n)[{JS}]*\|[^\n\r\x{{2028}}\x{{2029}}]*\|') AS is_question FROM t""".replace("HEAD", """(['', '#tag ', '# ', '1) ', '1)', '- ', '| a | b ', '|', 'Which: '][turn % 9 + 1] || left(text, 20 + CAST(turn AS INT) * 50) || CASE WHEN conv_id % 5 < 4 THEN '?' || chr(10) ELSE '' END)"""))
def events_questions(spark, d):
    """Heads of the texts behind beginnings of all kinds, most of them with a question mark."""
    begins = F.array(*map(F.lit, ["", "#tag ", "# ", "1) ", "1)", "- ", "| a | b ", "|", "Which: "]))
    head = F.concat(F.get(begins, (F.col("turn") % 9).cast("int")), F.substring(F.col("text"), F.lit(1), (20 + F.col("turn") * 50).cast("int")), F.when(F.col("conv_id") % 5 < 4, F.lit("?\n")).otherwise(F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", events.ends_with_question(head).alias("is_question"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def events_history(spark, d):
    return events.history(table(spark, d, "events"), "user_id", "event_id", "ts").select("user_id", "event_id")


#: What each kind of event does to a session: a query, output with an answer or with a question, the agent's end, a cancel.
ACTIONS = {"signup": ("query", None), "click": ("line", '{"type":"result","result":"It is so."}'), "view": ("line", '{"type":"result","result":"Which one?"}'), "purchase": ("close", None), "error": ("cancel", None)}


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), g AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER w AS turn FROM o WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
f AS (SELECT *, coalesce(bool_or(event_type = 'view') OVER w, false) AS asked, coalesce(bool_or(event_type = 'click') OVER w, false) AS answered FROM g WINDOW w AS (PARTITION BY user_id, turn ORDER BY seq)),
p AS (SELECT *, CASE event_type WHEN 'signup' THEN 'running' WHEN 'view' THEN 'awaiting-reply' WHEN 'error' THEN 'done' WHEN 'purchase' THEN CASE WHEN NOT asked THEN 'done' END END AS moved FROM f)
SELECT user_id, event_id, coalesce(last_value(moved IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq), 'idle') AS phase, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'error' THEN 1 ELSE CASE WHEN asked OR answered THEN 0 ELSE 1 END END AS n_events FROM p""")
def events_sessions(spark, d):
    e = table(spark, d, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    of = lambda k: functools.reduce(lambda c, x: c.when(F.col("event_type") == x[0], F.lit(x[1][k])), list(ACTIONS.items())[1:], F.when(F.col("event_type") == "signup", F.lit(ACTIONS["signup"][k])))
    told = events.sessions(e.select(F.col("user_id").cast("string").alias("session"), "seq", of(0).alias("action"), of(1).alias("text")))
    met = told.join(e.select(F.col("user_id").cast("string").alias("session"), "seq", "user_id", "event_id"), ["session", "seq"])
    return met.select("user_id", "event_id", "phase", F.size(F.from_json("events", "array<struct<type: string>>")).alias("n_events"))


@query("SELECT DISTINCT source AS repo FROM documents WHERE source NOT IN ('src1', 'src2', 'src3')")
def sets_unreached(spark, d):
    told = spark.createDataFrame([(1, ["src1"], [("src3", "slow")]), (2, ["src2", "src1"], [("src3", "lost")])], "seq long, scope array<string>, missing array<struct<repo: string, reason: string>>")
    return events.unreached(table(spark, d, "documents").select(F.col("source").alias("repo")), events.merge_provenance(told))


from . import more_queries  # noqa: E402, F401  registers the rest
