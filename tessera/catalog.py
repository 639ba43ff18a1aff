"""Every query of the engine's own operators, with its DuckDB twin where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.functions import text as tx
from tessera.operators import access, bm25, chunking, dense, evaluation, formatting, fusion, graph, incremental, navigation, ranking
from tessera.plans import benchmark
from tessera.plans.search import Settings, search
from tessera.session import materialize, shared_dir, table
from tessera.sources import files
from tessera.sources.store import Store
from tessera.streaming import watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query, with its twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_RE2 = tx.TOKEN.replace("\\x{85}", "\\x{85}\\x0b")
_CAMEL = "string_split(regexp_replace(regexp_replace({w}, '([a-z])([A-Z])', concat('\\1', chr(1), '\\2'), 'g'), '([A-Z])([A-Z][a-z])', concat('\\1', chr(1), '\\2'), 'g'), chr(1))"


def tokens_sql(text: str) -> str:
    """The tokens of a text in DuckDB."""
    camel = _CAMEL.format(w="w")
    return (
        f"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '{_RE2}'), lambda w: list_concat([lower(w)], "
        f"CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda p: p <> '') ELSE CAST([] AS VARCHAR[]) END, "
        f"CASE WHEN len({camel}) > 1 THEN list_filter(list_transform({camel}, lambda p: lower(trim(p, '_'))), lambda p: p <> '' AND p <> lower(w)) ELSE CAST([] AS VARCHAR[]) END)))"
    )


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def meaningful_sql(tokens: str) -> str:
    return f"list_distinct(list_filter({tokens}, lambda t: length(t) > 1 AND t NOT IN ({_STOP}) AND regexp_matches(t, '[a-z0-9]')))"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: chunk_id, file_path (the source), text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_path"), "text", F.col("lang").alias("language"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# -- tokens and the lexical index


@query(f"WITH d AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM d")
def tokenize_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH {fx.values(fx.QUERIES, fx.QUERY_COLUMNS, 'q')} SELECT query_id, array_to_string({tokens_sql('query')}, ' ') AS tokens, array_to_string(list_sort({meaningful_sql(tokens_sql('query'))}), ' ') AS meaningful FROM q")
def meaningful_tokens(spark, sf_dir):
    q = fx.frame(spark, fx.QUERIES, fx.QUERY_COLUMNS)
    t = tx.tokenize(F.col("query"))
    return q.select("query_id", F.array_join(t, " ").alias("tokens"), F.array_join(F.array_sort(tx.meaningful(t)), " ").alias("meaningful"))


_BM25 = f"""tk AS (SELECT doc_id AS chunk_id, {tokens_sql('text')} AS t FROM documents),
dl AS (SELECT chunk_id, len(t) AS dl FROM tk), nn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ra AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, nn),
mi AS (SELECT CAST(sum(CAST(raw AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS m FROM ra),
te AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * m ELSE raw END AS idf FROM ra, mi),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round(CAST(sum(CAST(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS DECIMAL(28,12))) AS DOUBLE), 6) AS score
  FROM qt JOIN tf USING (term) JOIN te USING (term) JOIN dl USING (chunk_id), nn GROUP BY ALL),
sp AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM sc WHERE score > 0) WHERE rank <= 50)"""


@query(f"WITH {_BM25} SELECT term, df, round(idf, 9) AS idf FROM te")
def term_stats(spark, sf_dir):
    return bm25.build(corpus(spark, sf_dir)).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_BM25} SELECT query_id, rank, chunk_id, score FROM sp WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return bm25.search(bm25.build(corpus(spark, sf_dir)), questions(spark, sf_dir), 5)


# -- dense vectors and fusion

_KNN = """vq AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
vs AS (SELECT query_id, vec_id AS chunk_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(e[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))), 6) AS score FROM embeddings, vq),
de AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM vs) WHERE rank <= 50)"""


def vectors(spark, sf_dir):
    return dense.checked(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), 64)


def probes(spark, sf_dir):
    """Every vector whose id is divisible by 50 as a query against all vectors."""
    return vectors(spark, sf_dir).where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")


@query(f"WITH {_KNN} SELECT query_id, rank, chunk_id, score FROM de WHERE rank <= 10")
def knn_topk(spark, sf_dir):
    return dense.knn(vectors(spark, sf_dir), probes(spark, sf_dir), 10)


@query(ORACLES["knn_topk"])
def knn_native(spark, sf_dir):
    return dense.knn_native(vectors(spark, sf_dir), probes(spark, sf_dir), 10)


def _rrf_sql(left: str, right: str) -> str:
    pick = lambda name, t: f"SELECT query_id, chunk_id, rank AS {name}_rank, score AS {name}_score FROM {t}"
    return f"""d1 AS ({pick('dense', left)}), s1 AS ({pick('sparse', right)}),
fu AS (SELECT coalesce(d1.query_id, s1.query_id) AS query_id, coalesce(d1.chunk_id, s1.chunk_id) AS chunk_id, dense_rank, dense_score, sparse_rank, sparse_score,
  round(coalesce(0.5::DOUBLE / (60 + dense_rank), 0) + coalesce(0.5::DOUBLE / (60 + sparse_rank), 0), 9) AS rrf_score FROM d1 FULL JOIN s1 ON d1.query_id = s1.query_id AND d1.chunk_id = s1.chunk_id),
fr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, chunk_id) AS INTEGER) AS rank FROM fu) WHERE rank <= 60)"""


_FUSED = "SELECT query_id, rank, chunk_id, dense_rank, dense_score, sparse_rank, sparse_score, rrf_score FROM fr"


def _near(spark, sf_dir):
    return dense.knn(vectors(spark, sf_dir), probes(spark, sf_dir), 50)


def _lexical(spark, sf_dir):
    return bm25.search(bm25.build(corpus(spark, sf_dir)), questions(spark, sf_dir), 50)


_HYBRID = f"WITH {_BM25}, {_KNN}, {_rrf_sql('de', 'sp')}"


@query(f"{_HYBRID} {_FUSED}")
def rrf_hybrid(spark, sf_dir):
    return fusion.fuse_mode("hybrid", _near(spark, sf_dir), _lexical(spark, sf_dir))


@query(f"WITH {_BM25}, {_KNN}, ee AS (SELECT * FROM sp WHERE false), {_rrf_sql('de', 'ee')} {_FUSED}")
def rrf_dense_only(spark, sf_dir):
    return fusion.fuse_mode("dense", _near(spark, sf_dir), None)


@query(f"WITH {_BM25}, {_KNN}, ee AS (SELECT * FROM de WHERE false), {_rrf_sql('ee', 'sp')} {_FUSED}")
def rrf_sparse_only(spark, sf_dir):
    return fusion.fuse_mode("sparse", None, _lexical(spark, sf_dir))


# -- query analysis and ranking


def _expand_sql(q: str) -> str:
    lists = [f"CASE WHEN list_contains({meaningful_sql(tokens_sql(q))}, '{k}') THEN [{', '.join(repr(x) for x in v)}] ELSE CAST([] AS VARCHAR[]) END" for k, v in ranking.INTENTS]
    lists += [f"CASE WHEN list_contains({tokens_sql(q)}, '{k}') THEN [{', '.join(repr(x) for x in v)}] ELSE CAST([] AS VARCHAR[]) END" for k, v in ranking.QUESTIONS]
    more = f"flatten([{', '.join(lists)}])"
    new = f"list_filter({more}, lambda x, i: NOT contains(lower({q}), x) AND list_position({more}, x) = i)"
    return f"trim(concat({q}, ' ', array_to_string({new}, ' ')))"


_EXPANDED = f"{fx.values(fx.QUERIES, fx.QUERY_COLUMNS, 'q')}, qe AS (SELECT query_id, query, {_expand_sql('query')} AS expanded FROM q)"


def _expanded(spark):
    return fx.frame(spark, fx.QUERIES, fx.QUERY_COLUMNS).withColumn("expanded", ranking.expand(F.col("query")))


@query(f"WITH {_EXPANDED} SELECT query_id, query, expanded FROM qe")
def expand_query(spark, sf_dir):
    return _expanded(spark)


_BOOST = f"""{_EXPANDED}, {fx.values(fx.CHUNKS, fx.CHUNK_COLUMNS, 'ch')},
b0 AS (SELECT query_id, chunk_id, lower(query) AS low, lower(symbol_name) AS sym, {meaningful_sql(tokens_sql('expanded'))} AS want,
  {meaningful_sql(tokens_sql("translate(file_path, '/.', '  ')"))} AS pt, {meaningful_sql(tokens_sql("concat_ws(' ', nullif(symbol_name, ''), nullif(context_header, ''), nullif(docstring, ''))"))} AS ot FROM qe, ch),
b1 AS (SELECT *, coalesce(sym <> '' AND (contains(low, sym) OR contains(low, replace(sym, '_', ' '))), false) AS exact, list_sort(list_filter(want, lambda x: list_contains(pt, x))) AS p, list_sort(list_filter(want, lambda x: list_contains(ot, x))) AS o FROM b0),
bo AS (SELECT query_id, chunk_id, round(CASE WHEN exact THEN 2.5::DOUBLE ELSE 0 END + least(2.4::DOUBLE, 0.9::DOUBLE * len(p)) + least(3.6::DOUBLE, 0.9::DOUBLE * len(o)), 6) AS boost,
  concat_ws(' | ', CASE WHEN exact THEN 'exact symbol' END, CASE WHEN len(p) > 0 THEN 'path: ' || array_to_string(p, ', ') END, CASE WHEN len(o) > 0 THEN 'terms: ' || array_to_string(o, ', ') END) AS reasons FROM b1)"""


@query(f"WITH {_BOOST} SELECT query_id, chunk_id, boost, reasons FROM bo")
def exact_boost(spark, sf_dir):
    d = _expanded(spark).join(F.broadcast(fx.chunks(spark)), F.lit(True))  # thirteen inline rows
    b = ranking.boost(F.col("query"), F.col("expanded"), F.col)
    return d.withColumn("b", b).select("query_id", "chunk_id", F.col("b.boost").alias("boost"), F.array_join("b.reasons", " | ").alias("reasons"))


_DIVERSE = f"""WITH {_BM25}, h AS (SELECT sp.*, source AS file_path, CAST(chunk_id % 7 AS INTEGER) AS start_line FROM sp JOIN documents ON doc_id = chunk_id),
c1 AS (SELECT *, concat(file_path, ':L', start_line, '-L', start_line + 9) AS citation FROM h),
c2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, citation ORDER BY score DESC, rank, chunk_id) AS r1 FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, rank, chunk_id) AS r2 FROM c2 WHERE r1 = 1),
c4 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS INTEGER) AS final_rank FROM c3 WHERE r2 <= 4)
SELECT query_id, final_rank, chunk_id, citation, score FROM c4 WHERE final_rank <= 20"""


@query(_DIVERSE)
def diversity_topk(spark, sf_dir):
    c = corpus(spark, sf_dir)
    hits = bm25.search(bm25.build(c), questions(spark, sf_dir), 50).join(c.select("chunk_id", "file_path"), "chunk_id")
    hits = hits.withColumn("start_line", (F.col("chunk_id") % 7).cast("int")).withColumn("end_line", F.col("start_line") + 9)
    return ranking.diversify(hits, 20).select("query_id", "final_rank", "chunk_id", "citation", "score")


@query(f"""{_HYBRID}, b AS (SELECT *, CAST(chunk_id % 5 AS DOUBLE) AS boost FROM fr WHERE rank = 1),
s AS (SELECT query_id, round(CASE WHEN dense_rank IS NOT NULL AND sparse_rank IS NOT NULL THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN boost > 0 THEN least(0.4::DOUBLE, boost / 7.5) ELSE 0 END + CASE WHEN dense_score >= 0.35 THEN 0.15::DOUBLE ELSE 0 END, 3) AS reliability_score FROM b)
SELECT query_id, reliability_score, CASE WHEN reliability_score >= 0.65 THEN 'high' WHEN reliability_score >= 0.35 THEN 'medium' ELSE 'low' END AS reliability FROM s""")
def reliability_label(spark, sf_dir):
    top = fusion.fuse(_near(spark, sf_dir), _lexical(spark, sf_dir)).withColumn("boost", (F.col("chunk_id") % 5).cast("double")).withColumnRenamed("rank", "final_rank")
    return ranking.reliability(top).select("query_id", "reliability_score", "reliability")


# -- chunks


def _lines(text: str) -> str:
    return f"string_split(regexp_replace(regexp_replace(coalesce({text}, ''), '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10))"


def _windows_sql(source: str, path: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""l AS (SELECT {path} AS file_path, {_lines('text')} AS ls FROM {source} WHERE coalesce(text, '') <> ''),
w AS (SELECT file_path, ls, unnest(range(0, CAST(greatest(0, ceil((len(ls) - {size}) / {step}.0)) AS BIGINT) + 1)) AS w FROM l),
x AS (SELECT file_path, CAST(w * {step} + 1 AS INTEGER) AS start_line, CAST(least(len(ls), w * {step} + {size}) AS INTEGER) AS end_line, array_to_string(ls[w * {step} + 1 : w * {step} + {size}], chr(10)) AS content FROM w)
SELECT concat(translate(file_path, '/\\.', '___'), '_L', start_line, '_L', end_line, '_', substr(sha256(content), 1, 12)) AS chunk_id, file_path, start_line, end_line, length(content) AS n_chars FROM x WHERE regexp_matches(content, '\\S')"""


def _window_rows(files, size, overlap):
    return chunking.sliding_windows(files, size, overlap).select("chunk_id", "file_path", "start_line", "end_line", F.length("content").cast("long").alias("n_chars"))


def _doc_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), "text")


_DOC_PATH = "concat(source, '/', doc_id, '.txt')"


@query(f"WITH {_windows_sql('documents', _DOC_PATH, 75, 10)}")
def sliding_chunks(spark, sf_dir):
    return _window_rows(_doc_files(spark, sf_dir), 75, 10)


@query(f"WITH {_windows_sql('documents', _DOC_PATH, 10, 2)}")
def sliding_chunks_small(spark, sf_dir):
    return _window_rows(_doc_files(spark, sf_dir), 10, 2)


@query(f"""WITH l AS (SELECT {_DOC_PATH} AS file_path, {_lines('text')} AS ls FROM documents WHERE coalesce(text, '') <> ''),
e AS (SELECT file_path, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM l),
b AS (SELECT *, (no BETWEEN 3 AND 4 OR NOT regexp_matches(line, '\\S')) AS brk FROM e),
g AS (SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY file_path ORDER BY no ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT file_path, CAST(min(no) AS INTEGER) AS start_line, CAST(max(no) AS INTEGER) AS end_line, md5(string_agg(line, chr(10) ORDER BY no)) AS digest FROM g WHERE NOT brk GROUP BY file_path, g HAVING max(no) - min(no) + 1 >= 3""")
def line_islands(spark, sf_dir):
    files = _doc_files(spark, sf_dir)
    covered = files.select("file_path", F.lit(3).alias("start_line"), F.lit(4).alias("end_line"))
    return chunking.islands(files, covered).select("file_path", "start_line", "end_line", F.md5("content").alias("digest"))


@query(f"""WITH {fx.values(fx.FILES, fx.FILE_COLUMNS, 'f')}, l AS (SELECT file_path, {_lines('text')} AS ls FROM f),
h AS (SELECT file_path, ls, unnest(ls) AS title, generate_subscripts(ls, 1) AS s FROM l),
k AS (SELECT *, lead(s) OVER (PARTITION BY file_path ORDER BY s) AS nx FROM h WHERE starts_with(title, '#'))
SELECT file_path, substr(trim(regexp_replace(trim(title), '^#+', '')), 1, 30) AS symbol_name, CAST(s AS INTEGER) AS start_line, CAST(coalesce(nx - 1, len(ls)) AS INTEGER) AS end_line, array_to_string(ls[s : coalesce(nx - 1, len(ls))], chr(10)) AS content FROM k""")
def markdown_sections(spark, sf_dir):
    return chunking.markdown_sections(fx.files(spark)).select("file_path", "symbol_name", "start_line", "end_line", "content")


@query(f"""WITH l AS (SELECT {_DOC_PATH} AS file_path, {_lines('text')} AS ls FROM documents WHERE coalesce(text, '') <> ''),
w AS (SELECT *, unnest(CASE WHEN len(ls) > 20 THEN range(0, CAST(ceil((len(ls) - 20) / 15.0) AS BIGINT) + 1) ELSE [0] END) AS w FROM l)
SELECT file_path, CAST(w * 15 + 1 AS INTEGER) AS start_line, CAST(least(len(ls), w * 15 + 20) AS INTEGER) AS end_line, CASE WHEN len(ls) > 20 THEN CAST(w + 1 AS INTEGER) END AS part, CASE WHEN len(ls) > 20 THEN concat('doc [part ', w + 1, ']') ELSE 'doc' END AS context_header, md5(array_to_string(ls[w * 15 + 1 : w * 15 + 20], chr(10))) AS digest
FROM (SELECT file_path, ls, CASE WHEN len(ls) > 20 THEN w ELSE 0 END AS w FROM w)""")
def split_parts(spark, sf_dir):
    ls = chunking.lines_of(F.col("text"))
    d = _doc_files(spark, sf_dir).withColumn("ls", ls).where(F.size("ls") > 0)
    none = lambda t: F.lit(None).cast(t)
    typed = {n: none("string") for n in chunking.NAMES} | {"file_path": F.col("file_path"), "start_line": F.lit(1), "end_line": F.size("ls"), "content": F.array_join("ls", "\n"), "context_header": F.lit("doc"), "dependencies": none("array<string>"), "metadata": none("struct<part:int,is_split:boolean>")}
    c = chunking.split_large(d.select(*(typed[n].alias(n) for n in chunking.NAMES)), 20, 5)
    return c.select("file_path", "start_line", "end_line", F.col("metadata.part").alias("part"), "context_header", F.md5("content").alias("digest"))


@query()
def code_chunks(spark, sf_dir):
    """Python, structural, Markdown and window chunks of inline files; tests pin their values."""
    return chunking.chunk_files(fx.files(spark)).select("chunk_id", "file_path", "language", "symbol_name", "symbol_type", "parent_scope", "start_line", "end_line", "context_header", "docstring", F.array_join("dependencies", ",").alias("dependencies"))


@query(f"""WITH {fx.values(fx.CHUNKS, fx.CHUNK_COLUMNS, 'c')} SELECT chunk_id, concat(translate(file_path, '/\\.', '___'), '_L', start_line, '_L', end_line, '_', substr(sha256(content), 1, 12)) AS made_id,
CASE WHEN start_line = end_line THEN concat(file_path, ':L', start_line) ELSE concat(file_path, ':L', start_line, '-L', end_line) END AS citation, CAST(greatest(1, end_line - start_line + 1) AS INTEGER) AS n_lines,
concat_ws(chr(10), 'File: ' || file_path, CASE WHEN coalesce(language, '') <> '' THEN 'Language: ' || language END, CASE WHEN coalesce(symbol_name, '') <> '' THEN 'Symbol: ' || symbol_type || ' ' || symbol_name END,
CASE WHEN coalesce(context_header, '') <> '' THEN 'Header: ' || context_header END, CASE WHEN coalesce(docstring, '') <> '' THEN 'Docstring: ' || docstring END, 'Code:', content) AS searchable FROM c""")
def chunk_identity(spark, sf_dir):
    c = fx.chunks(spark).withColumn("parent_scope", F.lit(None).cast("string"))
    s, e = F.col("start_line"), F.col("end_line")
    return c.select("chunk_id", tx.chunk_id(F.col("file_path"), s, e, F.col("content")).alias("made_id"), tx.citation(F.col("file_path"), s, e).alias("citation"), tx.line_count(s, e).alias("n_lines"), tx.searchable_text(F.col).alias("searchable"))


# -- scalar text


def _redact_sql(c: str) -> str:
    for p, put in tx.SECRETS:
        flags = "gi" if p.startswith("(?i)") else "g"
        c = f"regexp_replace({c}, '{p.removeprefix('(?i)')}', '{put.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', '{flags}')"
    return c


@query(f"WITH {fx.values(fx.SECRETS, fx.SECRET_COLUMNS, 's')}, a AS (SELECT CAST(id AS BIGINT) AS id, raw FROM s UNION ALL SELECT 1000 + doc_id, text FROM documents) SELECT id, {_redact_sql('raw')} AS redacted FROM a")
def redact_secrets(spark, sf_dir):
    a = fx.frame(spark, fx.SECRETS, fx.SECRET_COLUMNS).select(F.col("id").cast("long").alias("id"), "raw").union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 1000, "text"))
    return a.select("id", tx.redact(F.col("raw")).alias("redacted"))


@query(f"""WITH {fx.values(fx.LABELS, fx.LABEL_COLUMNS, 'l')} SELECT id, regexp_replace(trim(regexp_replace(regexp_replace(label, '{tx.EMOJI}', '', 'g'), '[^a-zA-Z0-9_.\\-()]', ' ', 'g')), '\\s+', ' ', 'g') AS clean FROM l""")
def sanitize_label(spark, sf_dir):
    return fx.frame(spark, fx.LABELS, fx.LABEL_COLUMNS).select("id", tx.sanitize_label(F.col("label")).alias("clean"))


@query(f"""WITH {fx.values(fx.URLS, fx.URL_COLUMNS, 'u')}, b AS (SELECT id, regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.git$', '') AS b FROM u),
m AS (SELECT id, b, CASE WHEN contains(b, '://') THEN regexp_matches(b, '^https?://(?:www\\.)?github\\.com/[a-zA-Z0-9_.\\-]+/[a-zA-Z0-9_.\\-]+$') WHEN starts_with(b, 'github.com/') THEN regexp_matches(b, '^github\\.com/[a-zA-Z0-9_.\\-]+/[a-zA-Z0-9_.\\-]+$') ELSE regexp_matches(b, '^[a-zA-Z0-9_.\\-]+/[a-zA-Z0-9_.\\-]+$') END AS ok,
 regexp_extract(b, '([a-zA-Z0-9_.\\-]+)/([a-zA-Z0-9_.\\-]+)$', 1) AS o, regexp_extract(b, '([a-zA-Z0-9_.\\-]+)/([a-zA-Z0-9_.\\-]+)$', 2) AS r FROM b)
SELECT id, ok AND NOT starts_with(o, '-') AND NOT starts_with(r, '-') AS ok, CASE WHEN ok AND NOT starts_with(o, '-') AND NOT starts_with(r, '-') THEN o END AS owner, CASE WHEN ok AND NOT starts_with(o, '-') AND NOT starts_with(r, '-') THEN r END AS repo FROM m""")
def repository_url(spark, sf_dir):
    return fx.frame(spark, fx.URLS, fx.URL_COLUMNS).select("id", tx.repository_of(F.col("url")).alias("x")).select("id", "x.ok", "x.owner", "x.repo")


@query(f"""SELECT page_id, CASE lower(regexp_extract(p, '(\\.[^./\\\\]+)$', 1)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.LANGUAGES.items())} ELSE 'text' END AS language FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)""")
def language_by_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.language_of(F.regexp_replace("url", "[?#].*$", "")).alias("language"))


# -- graph

_CODE = ", ".join(f"'{e}'" for e in graph.CODE)
_GRAPH = f"""{fx.values(fx.CHUNKS, fx.CHUNK_COLUMNS, 'ch')},
gc AS (SELECT * FROM ch WHERE coalesce(symbol_name, '') <> '' AND NOT symbol_name ILIKE 'block_L%' AND lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) IN ({_CODE}) AND NOT (symbol_type = 'block' AND ends_with(symbol_name, concat('_L', start_line)))),
sy AS (SELECT *, symbol_name AS name, concat('sym:', file_path, ':', symbol_name) AS id FROM gc),
nd AS (SELECT DISTINCT concat('file:', file_path) AS id, regexp_extract(file_path, '([^/]+)$', 1) AS label, regexp_extract(file_path, '([^/]+)$', 1) AS name, 'file' AS type, file_path AS full_path, 1 AS grp FROM gc
  UNION ALL SELECT id, CASE WHEN symbol_type IN ('function', 'method') THEN name || '()' ELSE name END, name, symbol_type, file_path, 2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start_line DESC, chunk_id DESC) AS r FROM sy) WHERE r = 1),
df AS (SELECT name AS called, arg_max(id, struct_pack(a := file_path, b := start_line, c := chunk_id)) AS target FROM sy GROUP BY name),
us AS (SELECT DISTINCT id, name, unnest(CASE WHEN len(dependencies) > 0 THEN dependencies ELSE regexp_extract_all(substr(content, 1, 4096), '\\b[A-Za-z_][A-Za-z0-9_]*\\b') END) AS called FROM sy),
ed AS (SELECT DISTINCT concat('file:', file_path) AS source, id AS target, 'defines' AS relation FROM sy UNION ALL SELECT DISTINCT us.id, df.target, 'calls' FROM us JOIN df USING (called) WHERE us.called <> us.name)"""


def _graph(spark):
    c = graph.graph_chunks(fx.chunks(spark))
    return graph.nodes(c), graph.edges(c)


@query(f"WITH {_GRAPH} SELECT id, label, name, type, full_path, grp FROM nd")
def graph_nodes(spark, sf_dir):
    return _graph(spark)[0].select("id", "label", "name", "type", "full_path", F.col("group").alias("grp"))


@query(f"WITH {_GRAPH} SELECT source, target, relation FROM ed")
def graph_edges(spark, sf_dir):
    return _graph(spark)[1]


@query(f"""WITH RECURSIVE {_GRAPH}, bo AS (SELECT source AS a, target AS b FROM ed UNION SELECT target, source FROM ed),
re AS (SELECT id, 0 AS step FROM nd WHERE contains(lower(label), 'apply_tax') OR contains(lower(name), 'apply_tax') UNION SELECT b, step + 1 FROM re JOIN bo ON a = id WHERE step < 2)
SELECT id, min(step) AS step FROM re GROUP BY id""")
def graph_focus(spark, sf_dir):
    return graph.focus_ids(*_graph(spark), "Apply_Tax")


@query(f"""WITH {_GRAPH}, sl AS (SELECT id FROM nd JOIN (SELECT id AS i2, max(start_line) AS s FROM sy GROUP BY id) ON id = i2 WHERE grp = 2 ORDER BY full_path, grp, s, id LIMIT 6), ac AS (SELECT id FROM nd WHERE grp = 1 UNION ALL SELECT id FROM sl)
SELECT source, target, relation FROM ed WHERE source IN (SELECT id FROM ac) AND target IN (SELECT id FROM ac)""")
def graph_global(spark, sf_dir):
    return graph.view(*_graph(spark), limit=6)[1].select("source", "target", "relation")


# -- navigation

_NAV = f"{fx.values(fx.CHUNKS, fx.CHUNK_COLUMNS, 'ch')}, {fx.values(fx.REQUESTS, fx.REQUEST_COLUMNS, 'rq')}"


def _requests(spark):
    return fx.frame(spark, fx.REQUESTS, fx.REQUEST_COLUMNS)


@query(f"WITH {_NAV} SELECT request_id, chunk_id, symbol_name FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY start_line, chunk_id) AS r FROM rq JOIN ch USING (file_path) WHERE line + 1 BETWEEN start_line AND end_line) WHERE r = 1")
def nav_at_position(spark, sf_dir):
    return navigation.at_position(_requests(spark).drop("symbol"), fx.chunks(spark))


@query(f"WITH {_NAV} SELECT request_id, ch.file_path, start_line - 1 AS start_0, end_line - 1 AS end_0, 80 AS end_character FROM rq JOIN ch ON lower(symbol) = lower(symbol_name)")
def nav_definitions(spark, sf_dir):
    return navigation.definitions(_requests(spark).drop("file_path", "line"), fx.chunks(spark))


@query(f"WITH {_NAV} SELECT request_id, ch.file_path, start_line - 1 AS start_0, end_line - 1 AS end_0, 80 AS end_character FROM rq JOIN ch ON contains(content, symbol) AND coalesce(symbol_name, '') <> symbol")
def nav_references(spark, sf_dir):
    return navigation.references(_requests(spark).drop("file_path", "line"), fx.chunks(spark))


@query(f"""WITH {_NAV}, h AS (SELECT request_id, ch.* FROM rq, ch WHERE (rq.file_path = ch.file_path AND line + 1 BETWEEN start_line AND end_line) OR lower(symbol) = lower(symbol_name)),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY file_path, start_line, chunk_id) AS r FROM h) SELECT request_id, chunk_id, trim(substr(content, 1, 300)) AS snippet, coalesce(docstring, 'No documentation.') AS documentation FROM r WHERE r = 1""")
def nav_hover(spark, sf_dir):
    return navigation.hover(_requests(spark), fx.chunks(spark))


@query(f"""WITH {_NAV}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol_name ORDER BY file_path, start_line, chunk_id) AS r FROM ch WHERE coalesce(symbol_name, '') <> '' AND NOT starts_with(symbol_name, 'block_L'))
SELECT symbol_name AS label, CASE symbol_type WHEN 'function' THEN 3 WHEN 'class' THEN 7 ELSE 6 END AS kind, concat(file_path, ':', start_line) AS place FROM f WHERE r = 1 ORDER BY file_path, start_line LIMIT 50""")
def nav_completion(spark, sf_dir):
    return navigation.completion(fx.chunks(spark))


# -- changes, counts, events


@query("""WITH a AS (SELECT concat('d/', doc_id) AS file_path, sha256(text) AS old FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT concat('d/', doc_id) AS file_path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS new FROM documents WHERE doc_id % 9 <> 1)
SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN new IS NULL THEN 'deleted' WHEN old IS NULL THEN 'new' WHEN old <> new THEN 'modified' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.file_path = b.file_path""")
def change_set(spark, sf_dir):
    """A made-up second state of the corpus: some documents gone, some changed, some new."""
    d = table(spark, sf_dir, "documents")
    path, changed = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file_path"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = d.where("doc_id % 10 <> 1").select(path, F.sha2("text", 256).alias("file_hash"))
    return incremental.change_set(old, d.where("doc_id % 9 <> 1").select(path, F.sha2(changed, 256).alias("file_hash")))


@query("SELECT count(*) AS total_files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS total_lines, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, CAST(count(*) AS BIGINT) AS total_chunks FROM documents")
def corpus_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.size(F.split("text", "\n", -1)).alias("total_lines"), F.octet_length("text").alias("total_bytes"), F.lit(1).alias("chunk_count"))
    return incremental.corpus_stats(d)


@query("SELECT o_orderkey, max(o_totalprice) AS o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0) GROUP BY o_orderkey")
def upsert_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0")
    new = new.union(new.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return incremental.upsert(o, new, ["o_orderkey"], F.col("o_totalprice"))


@query("WITH q AS (SELECT unnest(range(0, 60)) AS p) SELECT CAST(p AS INTEGER) AS rank, doc_id AS chunk_id, lang AS language FROM q JOIN documents ON doc_id = (p * 37 + 11) % 1500")
def hydrate_in_order(spark, sf_dir):
    ids = spark.range(60).select(F.col("id").cast("int").alias("rank"), ((F.col("id") * 37 + 11) % 1500).alias("chunk_id"))
    return ranking.hydrate(F.broadcast(ids), corpus(spark, sf_dir).select("chunk_id", "language"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("path"), "value")


@query("""WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000, true) AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(CAST(nw AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS batch FROM g)
SELECT user_id, CAST(batch AS BIGINT) AS batch, min(ts) AS started, max(ts) AS last, count(*) AS events FROM b GROUP BY user_id, batch""")
def debounce_batches(spark, sf_dir):
    return watch.debounce_batch(_events(spark, sf_dir), "user_id", 1_800_000)


@query("""WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000, true) AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(CAST(nw AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS batch FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS paths, count(*) AS events FROM b GROUP BY user_id, batch""")
def debounce_sessions(spark, sf_dir):
    d = watch.debounce(_events(spark, sf_dir), "user_id", "30 minutes", None)
    return d.select("user_id", "started", "ended", F.array_join("paths", ",").alias("paths"), "events")


def _load(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "ts")


@query("SELECT event_id AS request_id, user_id AS client, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) AS in_window FROM events")
def offered_load(spark, sf_dir):
    return access.offered_load(_load(spark, sf_dir), 86_400)


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
r AS (SELECT event_id, user_id, ts, n, true AS allowed, [us] AS times FROM e WHERE n = 1
UNION ALL SELECT event_id, user_id, ts, n, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END FROM (SELECT e.*, list_filter(r.times, lambda x: e.us - x < 86400000000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id AS request_id, user_id AS client, ts, allowed FROM r""")
def rate_limit(spark, sf_dir):
    """Accepted and refused requests; what is accepted depends on what was, so the twin goes through each client's requests in turn."""
    return access.limit_requests(_load(spark, sf_dir), 3, 86_400)


# -- evaluation

_PICK = ", ".join(f"round(list_sort(list(value))[CAST(least(floor({p} * count(*)), count(*) - 1) AS BIGINT) + 1], 2) AS {k}" for k, p in evaluation.PERCENTILES.items())


@query(f"SELECT event_type, count(*) AS count, round(min(value), 2) AS min, round(max(value), 2) AS max, round(sum(value) / count(*), 2) AS mean, {_PICK}, round(100.0 * count(*) FILTER (value < 50) / count(*), 2) AS below_pct FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_stats(spark, sf_dir):
    return evaluation.latency_stats(table(spark, sf_dir, "events"), "value", ("event_type",), 50.0)


_RECORDS = f"""{_BM25}, t AS (SELECT query_id, rank, chunk_id FROM sp WHERE rank <= 5), x AS (SELECT t.query_id, t.rank, contains(d.text, substr(b.text, 1, 40)) AS hit FROM t JOIN documents d ON doc_id = chunk_id JOIN benchmark b ON item_id = query_id),
f AS (SELECT query_id, min(CASE WHEN hit THEN rank END) AS h FROM x GROUP BY query_id)"""


@query(f"""WITH {_RECORDS} SELECT count(*) AS queries, {', '.join(f"round(avg(CASE WHEN h <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_{k}" for k in (1, 3, 5))}, {', '.join(f"round(avg(CASE WHEN h <= {k} THEN 1.0::DOUBLE ELSE 0 END) / {k}, 6) AS hit_precision_{k}" for k in (1, 3, 5))}, round(avg(coalesce(1.0::DOUBLE / h, 0)), 6) AS mrr FROM f""")
def retrieval_metrics(spark, sf_dir):
    q = questions(spark, sf_dir)
    hits = bm25.search(bm25.build(corpus(spark, sf_dir)), q, 5).join(corpus(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    rows = F.array_sort(F.collect_list(F.struct("rank", "text")))
    got = hits.groupBy("query_id").agg(F.transform(rows, lambda x: x["text"]).alias("retrieved_files"), F.transform(rows, lambda x: F.lit("")).alias("retrieved_symbols"))
    return evaluation.retrieval_metrics(got.join(q, "query_id").select("query_id", F.substring("query", 1, 40).alias("expected_file"), F.lit("").alias("target_symbol"), "retrieved_files", "retrieved_symbols"))


# -- answers

_TOP = f"""{_BM25}, t AS (SELECT sp.*, source || '/' || chunk_id AS citation, lang, text FROM sp JOIN documents ON doc_id = chunk_id WHERE rank <= 3)"""


def _results(spark, sf_dir):
    c = corpus(spark, sf_dir)
    d = bm25.search(bm25.build(c), questions(spark, sf_dir), 3).join(c, "chunk_id")
    return d.select("query_id", F.col("rank").alias("final_rank"), "chunk_id", "score", "file_path", F.concat("file_path", F.lit("/"), F.col("chunk_id").cast("string")).alias("citation"), "language", F.lit(None).cast("string").alias("context_header"), F.lit(None).cast("string").alias("symbol_name"), F.array().cast("array<string>").alias("dependencies"), F.col("text").alias("content"))


@query(f"WITH {_TOP} SELECT query_id, string_agg(concat('[', rank, '] ', citation, ' (', lang, ')', chr(10), text), chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY query_id")
def prompt_context(spark, sf_dir):
    return formatting.prompt_context(_results(spark, sf_dir))


@query(f"WITH {_TOP} SELECT query_id, string_agg(concat(rank, '. ', citation, ' score ', printf('%.4f', score), ', ', lang, ', N/A', chr(10), '```', lang, chr(10), text, chr(10), '```'), chr(10) ORDER BY rank) AS summary FROM t GROUP BY query_id")
def markdown_summary(spark, sf_dir):
    return formatting.markdown_summary(_results(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id AS query_id, text AS answer, CAST(ceil(length(text) / 640.0) AS BIGINT) AS n FROM documents), p AS (SELECT query_id, answer, n, unnest(range(0, n + 1)) AS part FROM c)
SELECT query_id, CAST(part AS INTEGER) AS part, CASE WHEN part = n THEN '' ELSE substr(answer, part * 640 + 1, 640) END AS delta, part = n AS done FROM p""")
def answer_deltas(spark, sf_dir):
    return formatting.deltas(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer")))


@query(f"""WITH {_TOP}, s AS (SELECT query_id, string_agg(concat('### ', rank, '. ', split_part(citation, '/', 1), ' - ', citation, chr(10), array_to_string(string_split(text, chr(10))[1:32], chr(10)), CASE WHEN len(string_split(text, chr(10))) > 32 THEN concat(chr(10), '... ', len(string_split(text, chr(10))) - 32, ' more lines in ', citation) ELSE '' END), chr(10) || chr(10) ORDER BY rank) AS body FROM t GROUP BY query_id),
d AS (SELECT query_id, concat('Best match: ', split_part(citation, '/', 1), ' at ', citation) AS direct FROM t WHERE rank = 1)
SELECT item_id AS query_id, CASE WHEN direct IS NULL THEN 'No evidence was found.' ELSE concat_ws(chr(10) || chr(10), direct, body, 'Not covered: anything outside the cited lines.') END AS answer FROM benchmark LEFT JOIN d ON d.query_id = item_id LEFT JOIN s ON s.query_id = item_id""")
def extractive_answer(spark, sf_dir):
    return formatting.extractive_answer(_results(spark, sf_dir), questions(spark, sf_dir))


@query(f"""WITH {_TOP}, c AS (SELECT query_id, string_agg(concat('[', rank, '] ', citation, ' (', lang, ')', chr(10), text), chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY query_id)
SELECT item_id AS query_id, concat_ws(chr(10) || chr(10), '{formatting.INSTRUCTIONS}', concat('Evidence:', chr(10), coalesce(context, 'none')), concat('Question: ', text)) AS prompt FROM benchmark LEFT JOIN c ON query_id = item_id""")
def rag_prompt(spark, sf_dir):
    return formatting.rag_prompt(_results(spark, sf_dir), questions(spark, sf_dir))


# -- the state of an index: its store, counts, rebuilds and files


_PATHS = "concat('d/', doc_id)"


def _as_files(spark, sf_dir):
    """documents as files: file_path, text, language."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file_path"), "text", F.col("lang").alias("language"), "source")


@query("""WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS f, CAST(sum(len(string_split(text, chr(10)))) AS DOUBLE) AS l, CAST(sum(strlen(text)) AS DOUBLE) AS b FROM documents)
SELECT unnest(['total_files', 'total_chunks', 'total_lines', 'total_bytes', 'seconds', 'lines_per_second']) AS key, unnest([f, f, l, b, 2.0::DOUBLE, l / 2]) AS value FROM s""")
def index_manifest(spark, sf_dir):
    d = _as_files(spark, sf_dir).select(F.size(F.split("text", "\n", -1)).alias("total_lines"), F.octet_length("text").alias("total_bytes"), F.lit(1).alias("chunk_count"))
    return incremental.manifest(d, 2.0).select("key", F.get_json_object("value", "$.value").cast("double").alias("value"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_rows(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return incremental.delete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query(f"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_PATHS} AS file_path, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS digest FROM documents WHERE (source <> 'src1' OR lang = 'de') AND lang <> 'fr'")
def store_round_trip(spark, sf_dir):
    """Documents as chunks in a store: saved, some replaced or added, the files of a language deleted, read in order."""
    d = _as_files(spark, sf_dir).withColumns({"chunk_id": F.substr("file_path", F.lit(3)), "start_line": F.lit(1)})
    chunks = d.withColumnRenamed("text", "content")
    store = Store(spark, f"{shared_dir(spark)}/tessera-store/{uuid.uuid4().hex}")
    store.save_chunks(chunks.where("source <> 'src1'"))
    store.save_chunks(chunks.where("language = 'de'").withColumn("content", F.concat("content", F.lit("!"))))
    store.record_files(d.select("file_path", F.sha2("text", 256).alias("file_hash")))
    store.delete_files(d.where("language = 'fr'").select("file_path"))
    out = materialize(store.all_chunks().select("chunk_id", "file_path", F.sha2("content", 256).alias("digest")), "store")
    store.clear()
    return out


_STATE = "(SELECT doc_id, source, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text FROM documents WHERE lang <> 'fr')"


@query(f"WITH {_windows_sql(_STATE, _PATHS, 10, 2)}")
def rebuild_changed(spark, sf_dir):
    """Chunks brought from one state of the files to the next, by parsing what changed only."""
    d = _as_files(spark, sf_dir)
    hashed = lambda x: x.withColumn("file_hash", F.sha2("text", 256))
    old, now = hashed(d.where("source <> 'src1'")), hashed(d.where("language <> 'fr'").withColumn("text", F.when(F.col("language") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    parse = lambda files: _window_rows(files, 10, 2)
    return incremental.apply_changes(parse(old), now, incremental.change_set(old, now), parse)


@query(f"SELECT {_PATHS} AS file_path, array_to_string({_lines('text')}[2:5], chr(10)) AS content FROM documents WHERE doc_id = 0")
def line_range(spark, sf_dir):
    return files.line_range(_as_files(spark, sf_dir), "d/0", 2, 5)


#: Names that are read, and names that patterns, hidden parts or extensions leave out.
_NAMES = ("main.py", "id_rsa.py", "my_secret.ts", "Makefile", ".env.js", "app.min.js", "notes.xyz", "vendor/a.go", "b.GO", "redis-stable-7/x.c")


def _globs(c: str) -> str:
    return " OR ".join(f"{c} GLOB '{p}'" for p in files.IGNORED)


@query(f"""WITH p AS (SELECT page_id, length(html) * 200 AS size, concat(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/', [{', '.join(f"'{n}'" for n in _NAMES)}][CAST(page_id % {len(_NAMES)} AS INTEGER) + 1]) AS path FROM pages), q AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, path, ({_globs('path')}) OR len(list_filter(parts, lambda x: {_globs('x')})) > 0 OR len(list_filter(parts, lambda x: starts_with(x, '.') AND x NOT IN ('.', '..'))) > 0
OR NOT (lower(regexp_extract(parts[-1], '.(\\.[^.]+)$', 1)) IN ({', '.join(f"'{e}'" for e in files.EXTENSIONS)}) OR parts[-1] IN ({', '.join(f"'{e}'" for e in files.PLAIN_NAMES)})) OR size > {files.MOST_BYTES} AS ignored FROM q""")
def ignored_paths(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    d = table(spark, sf_dir, "pages").select("page_id", (F.length("html") * 200).alias("size"), F.concat(F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1), F.lit("/"), name).alias("path"))
    return d.select("page_id", "path", files.is_ignored(F.col("path"), F.col("size"), list(files.IGNORED)).alias("ignored"))


@query("SELECT vec_id, CAST(j AS INTEGER) AS place, round(list_sum(list_transform(range(0, 8), lambda i: CASE WHEN i <= vec_id % 8 THEN CAST(embedding[i * 8 + j + 1] AS DOUBLE) ELSE 0 END)) / (vec_id % 8 + 1), 6) AS value FROM embeddings, range(0, 8) r(j)")
def mean_pooling(spark, sf_dir):
    """Vectors as eight vectors of tokens, of which a mask hides some."""
    eight = F.sequence(F.lit(0), F.lit(7))
    tokens = F.transform(eight, lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8)))
    mask = F.transform(eight, lambda i: F.when(i <= F.col("vec_id") % 8, 1.0).otherwise(0.0))
    d = table(spark, sf_dir, "embeddings").select("vec_id", dense.mean_pool(tokens, mask).alias("v"))
    return d.select("vec_id", F.posexplode("v").alias("place", "value")).withColumn("value", F.round("value", 6))


_RERANKED = f"""{_BM25}, h AS (SELECT sp.query_id, sp.rank, chunk_id, {meaningful_sql(tokens_sql('b.text'))} AS q, {meaningful_sql(tokens_sql(f"substr(concat('File: ', source, chr(10), 'Language: ', lang, chr(10), 'Code:', chr(10), d.text), 1, {ranking.RERANK_CHARS})"))} AS t FROM sp JOIN documents d ON doc_id = chunk_id JOIN benchmark b ON item_id = query_id WHERE sp.rank <= 20),
rs AS (SELECT query_id, rank, chunk_id, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_filter(q, lambda x: list_contains(t, x)))::DOUBLE / len(q), 6) END AS rerank_score FROM h)"""


@query(f"WITH {_RERANKED} SELECT query_id, rank, chunk_id, rerank_score, round(rerank_score + 0.25, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS r FROM rs) WHERE r <= 10")
def rerank_topk(spark, sf_dir):
    """The built-in reranker over the twenty best lexical hits, and the final score beside a boost."""
    none = {c: F.lit(None).cast("string") for c in ("parent_scope", "symbol_name", "symbol_type", "context_header", "docstring")}
    c = corpus(spark, sf_dir)
    hits = bm25.search(bm25.build(c), questions(spark, sf_dir), 20).join(c.withColumnRenamed("text", "content"), "chunk_id").join(questions(spark, sf_dir), "query_id")
    d = ranking.rerank(hits.withColumns(none | {"boost": F.lit(0.25)}), keep=10)
    return d.select("query_id", "rank", "chunk_id", "rerank_score", ranking.final_score(True).alias("score"))


@query(f"""WITH f AS (SELECT doc_id, {_PATHS} AS path, regexp_extract_all(text, '[^\n]*\n|[^\n]+$') AS ls FROM documents WHERE text <> ''), g AS (SELECT *, least(len(ls), 4) AS n FROM f)
SELECT doc_id AS query_id, path AS file_path, concat('--- a/', path, chr(10), '+++ b/', path, chr(10), '@@ -1', CASE WHEN n = 1 THEN '' ELSE ',' || n END, ' +1,', n + 1, ' @@', chr(10), ' ', ls[1], '+# review', chr(10), array_to_string(list_transform(ls[2:n], lambda x: ' ' || x), '')) AS diff FROM g""")
def unified_diffs(spark, sf_dir):
    """A comment put before the second line of each document."""
    f = _as_files(spark, sf_dir).where("text <> ''")
    hits = f.select(F.substr("file_path", F.lit(3)).cast("long").alias("query_id"), "file_path", F.lit(1).alias("final_rank"), F.lit(2).alias("start_line"), F.lit("python").alias("language"))
    return formatting.unified_diffs(hits, f)


# -- models that a caller brings


class _Marks:
    """A stand-in for an encoder: a text sets the four dimensions from its length on."""

    dim = 8

    def encode(self, texts):
        return [[float((j - len(t)) % 8 < 4) for j in range(8)] for t in texts]


class _Broken:
    """A stand-in for a reranker that fails."""

    def score(self, pairs):
        raise RuntimeError("no scores")


@query("SELECT doc_id AS chunk_id, CAST(j AS INTEGER) AS place, CASE WHEN (j - length(coalesce(text, '')) % 8 + 8) % 8 < 4 THEN 0.5::DOUBLE ELSE 0 END AS value FROM documents, range(0, 8) r(j)")
def encode_texts(spark, sf_dir):
    """Each text through the caller's encoder, once; vectors have length one."""
    d = dense.encode(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), _Marks)
    return d.select("chunk_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("place", "value"))


@query(f"WITH {_KNN} SELECT query_id, rank, chunk_id, round(1.0::DOUBLE / rank, 6) AS rerank_score FROM de WHERE rank <= 10")
def rerank_fallback(spark, sf_dir):
    """A reranker that fails leaves the order of the ranking before it."""
    hits = dense.knn(vectors(spark, sf_dir), probes(spark, sf_dir), 20)
    none = {c: F.lit(None).cast("string") for c in ("language", "parent_scope", "symbol_name", "symbol_type", "context_header", "docstring")}
    hits = hits.withColumns(none | {"file_path": F.lit("f"), "query": F.lit("q"), "content": F.col("chunk_id").cast("string")})
    return ranking.rerank(hits, _Broken, keep=10).select("query_id", "rank", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


# -- the symbols of a generated source tree, as many modules as there are documents

_TREE = f"""m AS (SELECT id, CAST(id AS VARCHAR) AS n, [{', '.join(f"'{x}'" for x in benchmark.SUBJECTS)}][CAST(id % {len(benchmark.SUBJECTS)} AS INTEGER) + 1] AS s, [{', '.join(f"'{x}'" for x in benchmark.ACTIONS)}][CAST(id // {len(benchmark.SUBJECTS)} % {len(benchmark.ACTIONS)} AS INTEGER) + 1] AS a, id * 37 % 100 AS share FROM range(0, (SELECT count(*) FROM documents)) r(id)),
k AS (SELECT *, upper(s[1]) || s[2:] || upper(a[1]) || a[2:] || n AS name, 'src/' || s || '/' || a || '_' || n AS path FROM m),
f AS (SELECT *, CAST(j AS INTEGER) AS j, a || '_' || s || '_' || n || '_' || j AS method FROM k, range(1, {benchmark.METHODS + 1}) r(j)),
sy AS (SELECT path || '.py' AS file_path, a || '_' || n AS symbol_name, 'module' AS symbol_type, NULL AS parent_scope, 1 AS start_line, 3 AS end_line, 'Module ' || a || '_' || n || '.py docstring' AS context_header, 'The ' || s || ' module.' AS docstring, 'math' AS dependencies FROM k WHERE share < 60
UNION ALL SELECT path || '.py', name, 'class', NULL, 6, 8, 'class ' || name, 'Can ' || a || ' the ' || s || '.', 'math' FROM k WHERE share < 60
UNION ALL SELECT path || '.py', method, 'method', name, 6 * j + 3, 6 * j + 7, 'class ' || name || ' > def ' || method || '(self, value, limit)', 'Step ' || j || ' to ' || a || ' a ' || s || '.', 'math' FROM f WHERE share < 60
UNION ALL SELECT path || '.ts', name, 'class', NULL, CASE WHEN j = 1 THEN 1 ELSE 66 END, CASE WHEN j = 1 THEN 75 ELSE 86 END, 'Typescript class: ' || name || ' [part ' || j || ']', NULL, '' FROM f WHERE share >= 60 AND share < 85 AND j <= 2
UNION ALL SELECT path || '.go', name, 'struct', NULL, 3, 5, 'Go struct: ' || name, NULL, '' FROM k WHERE share >= 85
UNION ALL SELECT path || '.go', method, 'method', NULL, 7 * j, 7 * j + 5, 'Go method: ' || method, NULL, '' FROM f WHERE share >= 85)"""


def _tree_chunks(spark, sf_dir):
    count = table(spark, sf_dir, "documents").count()
    return chunking.chunk_files(benchmark.source_tree(spark, count * 6 * benchmark.METHODS))


@query(f"WITH {_TREE} SELECT * FROM sy")
def tree_symbols(spark, sf_dir):
    """Modules, classes, methods, types and functions of three languages, each by its parser."""
    return _tree_chunks(spark, sf_dir).where("language <> 'markdown'").select("file_path", "symbol_name", "symbol_type", "parent_scope", "start_line", "end_line", "context_header", "docstring", F.array_join("dependencies", ",").alias("dependencies"))


@query(f"WITH {_TREE}, rq AS (SELECT id AS request_id, name FROM k) SELECT request_id, file_path, CAST(start_line - 1 AS INTEGER) AS start_0, CAST(end_line - 1 AS INTEGER) AS end_0 FROM rq JOIN sy ON lower(name) = lower(symbol_name)")
def tree_definitions(spark, sf_dir):
    """The definition of each module's type, asked for in capitals."""
    lines = table(spark, sf_dir, "documents").count() * 6 * benchmark.METHODS
    named = F.concat(F.initcap("subject"), F.initcap("action"), "number")
    asked = benchmark.modules(spark, lines).select(F.col("number").cast("long").alias("request_id"), F.upper(named).alias("symbol"))
    return navigation.definitions(asked, _tree_chunks(spark, sf_dir)).select("request_id", "file_path", "start_0", "end_0")


@query("SELECT doc_id, concat('[', source, '/', doc_id, ':L1', CASE WHEN n = 1 THEN '' ELSE '-L' || n END, '](file:///', source, '/', doc_id, '#L1-L', n, ')') AS link FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM documents)")
def citation_links(spark, sf_dir):
    path, start = F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), F.lit(1)
    d = table(spark, sf_dir, "documents").withColumn("n", F.size(F.split("text", "\n", -1)))
    return d.select("doc_id", tx.markdown_link(tx.citation(path, start, F.col("n")), F.concat(F.lit("file:///"), path), start, F.col("n")).alias("link"))


@query(ORACLES["term_stats"])
def lexical_store(spark, sf_dir):
    """The terms of an index that was written and read again."""
    store = Store(spark, f"{shared_dir(spark)}/tessera-store/{uuid.uuid4().hex}")
    store.save_lexical(bm25.build(corpus(spark, sf_dir)))
    out = materialize(store.lexical().terms.select("term", "df", F.round("idf", 9).alias("idf")), "lexical")
    store.clear()
    return out


@query("SELECT unnest(['chunks', 'files', 'vectors', 'manifest']) AS name, unnest([true, true, false, false]) AS ready, unnest([(SELECT count(*) FROM documents), (SELECT count(DISTINCT source) FROM documents), NULL, NULL]) AS n")
def store_catalogue(spark, sf_dir):
    """Which tables a store has, and what SQL counts in their views."""
    store, name = Store(spark, f"{shared_dir(spark)}/tessera-store/{uuid.uuid4().hex}"), f"t{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("file_path"))
    store.save_chunks(d)
    store.record_files(d.select("file_path"))
    ready = store.catalogue(name)
    counts = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {name}_{t}" for t in ("chunks", "files"))
    out = materialize(ready.join(spark.sql(counts), "name", "left"), "catalogue")
    store.clear()
    for t in ("chunks", "files"):
        spark.catalog.dropTempView(f"{name}_{t}")
    return out


# -- whole searches


@query()
def hybrid_search(spark, sf_dir):
    """The whole search plan over documents, with the built-in encoder and reranker."""
    c = corpus(spark, sf_dir).withColumns({"symbol_name": F.lit(None).cast("string"), "symbol_type": F.lit("block"), "parent_scope": F.lit(None).cast("string"), "context_header": F.lit(None).cast("string"), "docstring": F.lit(None).cast("string"), "start_line": F.lit(1), "end_line": F.size(F.split("text", "\n", -1)), "content": F.col("text")}).drop("text")
    v = materialize(c.select("chunk_id", dense.hashed(F.col("content"), 64).alias("embedding")), "vectors")
    q = questions(spark, sf_dir).withColumn("embedding", dense.hashed(F.col("query"), 64))
    d = search(q, c, bm25.build(c.select("chunk_id", F.col("content").alias("text"))), v, Settings())
    return d.select("query_id", "final_rank", "chunk_id", "score", "rrf_score", "rerank_score", "boost", "citation")
