"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.abbreviations import ABBREVIATIONS
from ..operators import ask, chunk, detect, graph, lexical, retrieve, store, vector
from ..runtime import Query, forget, kept, numbered, once, sent, stage, staged_dir, table
from ..sources import files, providers

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Fixed terms for the queries of the graph alone.
TERMS = ["БС11", "Белоперевалское"]
TOP_K = 7

_C = "c AS (SELECT DISTINCT chunk_id, chunk_no, text, page, source_file, document_id, type, image_path FROM chunks)"
_M = "m AS (SELECT DISTINCT type, name, canonical, source_file, page, chunk_id, pos FROM entities)"
_WS = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """The collection: repeated rows are dropped, as an ingestion does."""
    return kept(s, ("chunks", d), lambda: once(table(s, d, "chunks").select("chunk_id", "chunk_no", "text", "page", "source_file", "document_id", "type", "image_path"), "repeated-chunks"))


def _mentions(s: SparkSession, d: str) -> DataFrame:
    made = lambda: stage(table(s, d, "entities").select("type", "name", "canonical", "source_file", "page", "chunk_id", "pos").distinct(), "mentions")
    return kept(s, ("mentions", d), made)


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---- sources and store


@query()
def doc_discovery(s, d):
    return files.discover(s, d, "*.parquet").select("name", "length")


@query("SELECT id, name, lower(regexp_extract(name, '(\\.[^.\\\\/]+)$', 1)) IN ('.pdf', '.docx', '.doc', '.djvu') AS accepted FROM registry")
def ext_filter(s, d):
    return table(s, d, "registry").select("id", "name", tx.accepted_extension(F.col("name")).alias("accepted"))


@query(f"WITH {_C}, h AS (SELECT image_path, min(text) AS cached FROM c WHERE image_path <> '' AND type = 'text' GROUP BY 1) SELECT c.chunk_id, c.image_path, h.cached IS NOT NULL AS hit, coalesce(h.cached, '') AS text FROM c LEFT JOIN h USING (image_path) WHERE c.image_path <> ''")
def ocr_cache_lookup(s, d):
    c = _chunks(s, d)
    cache = c.filter("image_path <> '' and type = 'text'").groupBy("image_path").agg(F.min("text").alias("text"))
    hit, miss = store.cached_ocr(c.filter("image_path <> ''").select("chunk_id", "image_path"), cache)
    return hit.select("chunk_id", "image_path", F.lit(True).alias("hit"), F.col("cached").alias("text")).unionByName(miss.select("chunk_id", "image_path", F.lit(False).alias("hit"), F.lit("").alias("text")))


@query(f"WITH {_C} SELECT chunk_id, text, page, source_file, document_id, type, image_path FROM c")
def collection_get_all(s, d):
    return _chunks(s, d).drop("chunk_no")


@query(f"WITH {_C} SELECT count(*) AS n FROM c")
def collection_count(s, d):
    c = table(s, d, "chunks")
    # repeated rows have equal hashes; no text is exchanged
    return c.select("chunk_id", F.xxhash64(*c.columns).alias("row")).distinct().agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_C}, gone AS (SELECT id FROM registry WHERE status <> 'indexed') SELECT chunk_id, page, source_file, document_id, type FROM c WHERE document_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'new_' || id || '_c0', 1, name, id, 'image' FROM registry WHERE status <> 'indexed' AND coalesce(text_chunks, 0) > 0")
def store_replace_by_doc(s, d):
    reg = table(s, d, "registry").filter("status <> 'indexed'")
    old = _chunks(s, d).select("chunk_id", "page", "source_file", "document_id", "type")
    new = reg.filter("coalesce(text_chunks, 0) > 0").select(
        F.concat(F.lit("new_"), "id", F.lit("_c0")).alias("chunk_id"), F.lit(1).alias("page"), F.col("name").alias("source_file"), F.col("id").alias("document_id"), F.lit("image").alias("type")
    )
    return store.replace_by_document(old, new, reg.select(F.col("id").alias("document_id")))


@query(f"WITH {_C} SELECT chunk_id, document_id FROM c WHERE document_id NOT IN (SELECT id FROM registry WHERE status = 'error')")
def delete_by_doc(s, d):
    gone = table(s, d, "registry").filter("status = 'error'").select(F.col("id").alias("document_id"))
    return store.delete_by_document(_chunks(s, d).select("chunk_id", "document_id"), gone)


@query("SELECT document_id, x.status AS status, x.ts AS ts, x.progress AS progress, changes FROM (SELECT document_id, max({'ts': ts, 'status': status, 'progress': coalesce(progress, '')}) AS x, count(DISTINCT (ts, status)) AS changes FROM registry_events GROUP BY 1)")
def registry_latest(s, d):
    return store.latest_state(table(s, d, "registry_events"))


def _moments(embedded: DataFrame, id_col: str) -> DataFrame:
    """The length of each vector and its coordinates' sum, weighted by their numbers, in units of the least one."""
    each = embedded.select(id_col, F.size("embedding").alias("dim"), F.posexplode("embedding").alias("i", "f")).withColumn("x", F.col("f").cast("double"))
    ratio = F.sum(F.col("x") * (F.col("i") + 1)) / F.min(F.when(F.col("x") > 0, F.col("x")))
    return each.groupBy(id_col, "dim").agg(F.coalesce(F.floor(ratio + 0.23), F.lit(0)).alias("moment"))


def _moments_sql(id_col: str, source: str) -> str:
    return f"""t AS (SELECT {id_col}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[а-яёa-z0-9]+')) AS x FROM {source}),
b AS (SELECT {id_col}, ('0x' || substr(md5(x), 1, 8))::BIGINT % 64 AS i, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
v AS (SELECT {id_col}, floor(sum(n * (i + 1)) / min(n) + 0.23)::BIGINT AS moment FROM b GROUP BY 1)
SELECT {id_col}, 64 AS dim, coalesce(moment, 0)::BIGINT AS moment FROM (SELECT DISTINCT {id_col} FROM {source}) LEFT JOIN v USING ({id_col})"""


@query(f"WITH {_C}, {_moments_sql('chunk_id', 'c')}")
def ingest_batch_embed(s, d):
    return _moments(vector.embed_with(_chunks(s, d), "chunk_id", vector.HashingEmbedder()), "chunk_id")


# ---- projections and predicates


@query("SELECT id, CASE WHEN e = '.docx' THEN 'docx' WHEN e = '.doc' THEN 'doc' WHEN e = '.djvu' THEN 'djvu' WHEN e = '.pdf' THEN NULL ELSE 'unknown' END AS doc_type, CASE WHEN e IN ('.docx', '.doc') THEN 'text_only' WHEN e = '.pdf' THEN NULL ELSE 'vlm' END AS strategy, CASE WHEN e IN ('.docx', '.doc') THEN 1.0::DOUBLE END AS coverage FROM (SELECT id, lower(regexp_extract(name, '(\\.[^.\\\\/]+)$', 1)) AS e FROM registry)")
def detect_type_by_ext(s, d):
    t = detect.type_by_extension(F.col("name")).alias("t")
    return table(s, d, "registry").select("id", t).select("id", "t.doc_type", "t.strategy", "t.coverage")


def _detect_sql(least: int) -> str:
    return f"WITH p AS (SELECT source, length(trim(text)) AS len, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT doc_id, source, text FROM documents)), a AS (SELECT source, round(avg(CASE WHEN len >= {least} THEN 1.0 ELSE 0.0 END), 3) AS text_coverage, round(avg(coalesce(len, 0)), 1) AS avg_chars, count(*) AS sample_pages FROM p WHERE i % greatest(1, n // 10) = 0 AND i // greatest(1, n // 10) < 10 GROUP BY source) SELECT *, CASE WHEN text_coverage >= 0.7 THEN 'text_pdf' WHEN text_coverage >= 0.35 THEN 'hybrid_pdf' ELSE 'scan_pdf' END AS doc_type, CASE WHEN text_coverage >= 0.35 THEN 'hybrid' ELSE 'vlm' END AS strategy FROM a"


@query(_detect_sql(150))
def detect_type_pdf(s, d):
    return detect.type_by_pages(table(s, d, "documents").select("doc_id", "source", "text").distinct(), "source", "doc_id", "text")


@query(_detect_sql(900))
def detect_type_pdf_long(s, d):
    return detect.type_by_pages(table(s, d, "documents").select("doc_id", "source", "text").distinct(), "source", "doc_id", "text", 900)


@query("SELECT doc_id, CASE WHEN length(trim(text)) >= 150 THEN 'direct' ELSE 'ocr' END AS route FROM documents")
def route_page(s, d):
    return table(s, d, "documents").select("doc_id", detect.route(F.col("text")).alias("route"))


@query("SELECT doc_id, n AS route_direct FROM (SELECT 1 AS doc_id, count(*) AS n FROM documents WHERE length(trim(text)) >= 150)")
def strategy_direct(s, d):
    return table(s, d, "documents").agg(F.lit(1).alias("doc_id"), F.count_if(detect.route(F.col("text")) == "direct").alias("route_direct"))


_OCR_SQL = f"""WITH {_C}, r AS (SELECT chunk_id, CASE WHEN type = 'text' THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) END AS body, CASE WHEN image_path <> '' THEN 'схема ' || image_path ELSE 'отсутствуют' END AS dia, CASE WHEN page IS NULL THEN 'нет' ELSE 'стр — страница' END AS abb FROM c)
SELECT chunk_id, concat_ws(chr(10) || chr(10), nullif(coalesce(body, ''), ''), CASE WHEN dia <> 'отсутствуют' THEN 'Визуальные элементы страницы:' || chr(10) || dia END, CASE WHEN abb <> 'нет' THEN 'Аббревиатуры:' || chr(10) || abb END) AS text FROM r"""


def _ocr_raw(s: SparkSession, d: str) -> DataFrame:
    c = _chunks(s, d)
    body = F.when(F.col("type") == "text", F.regexp_replace("text", "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")).otherwise("")
    dia = F.when(F.length("image_path") > 0, F.concat(F.lit("схема "), "image_path")).otherwise("отсутствуют")
    abb = F.when(F.col("page").isNull(), "нет").otherwise("стр — страница")
    raw = F.concat(F.lit("мусор\n=== ТЕКСТ ===\n"), body, F.lit("\n=== ДИАГРАММЫ ===\n"), dia, F.lit("\n=== АББРЕВИАТУРЫ ===\n"), abb)
    return c.select("chunk_id", "page", raw.alias("raw"))


@query(_OCR_SQL)
def parse_ocr_sections(s, d):
    return _ocr_raw(s, d).select("chunk_id", tx.ocr_sections(F.col("raw")).alias("text"))


@query(f"WITH {_C} SELECT count(*) FILTER (WHERE image_path <> '') AS with_diagrams, count(*) FILTER (WHERE page IS NOT NULL) AS with_abbreviations FROM c")
def section_presence(s, d):
    t = _ocr_raw(s, d).select(tx.ocr_sections(F.col("raw")).alias("t"))
    return t.agg(F.count_if(F.col("t").contains("Визуальные элементы страницы:\n")).alias("with_diagrams"), F.count_if(F.col("t").contains("Аббревиатуры:\n")).alias("with_abbreviations"))


@query("SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) AS t FROM documents) GROUP BY 1")
def tokenize(s, d):
    return table(s, d, "documents").select(F.explode(tx.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _expanded_sql(col: str) -> str:
    """The first occurrence of each abbreviation, longer ones first; what stands beside it is taken and given back."""
    order = sorted(ABBREVIATIONS, key=lambda a: (-len(a), list(ABBREVIATIONS).index(a)))
    for a in order:
        quoted = lambda x: x.replace("'", "''")
        col = f"regexp_replace({col}, '(^|[^А-ЯЁA-Zа-яёa-z0-9]){quoted(a)}($|[^А-ЯЁA-Zа-яёa-z0-9])', '\\1{quoted(a)} ({quoted(ABBREVIATIONS[a])})\\2')"
    return col


@query(f"SELECT item_id, {_expanded_sql('text')} AS text FROM benchmark")
def expand_abbreviations(s, d):
    return table(s, d, "benchmark").select("item_id", tx.expand_abbreviations(F.col("text")).alias("text"))


@query("SELECT chunk_id, CASE WHEN image_path <> '' THEN regexp_extract(image_path, '([^\\\\/]+)$', 1) END AS image FROM chunks")
def resolve_image_path(s, d):
    return table(s, d, "chunks").select("chunk_id", tx.basename(F.col("image_path")).alias("image"))


@query("SELECT id, CASE WHEN length(st) > 40 THEN substr(st, 1, 40) || '…' ELSE st END AS short FROM (SELECT id, regexp_replace(name, '\\.[^.\\\\/]+$', '') AS st FROM registry)")
def short_name(s, d):
    return table(s, d, "registry").select("id", tx.short_name(F.col("name")).alias("short"))


@query("SELECT doc_id, substr(text, 1, 700) AS body, substr(title, 1, 200) AS caption, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '…' ELSE text END AS preview, right(replace(replace(source, '.pdf', ''), '.img', ''), 28) AS trace FROM documents")
def truncate_fields(s, d):
    t = F.col("text")
    src = F.replace(F.replace(F.col("source"), F.lit(".pdf"), F.lit("")), F.lit(".img"), F.lit(""))
    return table(s, d, "documents").select(
        "doc_id", F.substring(t, 1, 700).alias("body"), F.substring("title", 1, 200).alias("caption"),
        F.when(F.length(t) > 280, F.concat(F.substring(t, 1, 280), F.lit("…"))).otherwise(t).alias("preview"), F.right(src, F.lit(28)).alias("trace"),
    )


@query("SELECT doc_id, text FROM documents WHERE lang = 'en'")
def where_eq(s, d):
    return table(s, d, "documents").filter("lang = 'en'").select("doc_id", "text")


@query(f"WITH {_C} SELECT chunk_id, text FROM c WHERE type = 'text' AND page = 3")
def where_and(s, d):
    return _chunks(s, d).filter("type = 'text' and page = 3").select("chunk_id", "text")


@query(f"WITH {_C}, f AS (SELECT *, coalesce(type = 'image', false) AS m, max(coalesce(type = 'image', false)) OVER (PARTITION BY source_file) AS a FROM c) SELECT chunk_id, source_file, type FROM f WHERE m OR NOT a")
def postfilter_or_all(s, d):
    return retrieve.keep_matching_or_all(_chunks(s, d), F.col("type") == "image", "source_file").select("chunk_id", "source_file", "type")


@query("SELECT doc_id, len(regexp_extract_all(t, '\\[[0-9a-f-]{8,}:[0-9]+\\]')) AS n FROM (SELECT doc_id, text || ' [' || substr(md5(doc_id::VARCHAR), 1, 12) || ':' || n_chars || ']' AS t FROM documents)")
def count_citations(s, d):
    return table(s, d, "documents").select("doc_id", tx.count_citations(_cited()).alias("n"))


def _cited():
    return F.concat("text", F.lit(" ["), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), F.lit(":"), F.col("n_chars").cast("string"), F.lit("]"))


@query("SELECT doc_id, substr(md5(doc_id::VARCHAR), 1, 12) AS document_id, n_chars::INT AS page FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL")
def extract_citations(s, d):
    got = table(s, d, "documents").select("doc_id", F.explode(tx.citations(_cited())).alias("x"))
    return got.select("doc_id", "x.document_id", "x.page")


_VERDICTS = [
    (1, "ТОЧНОСТЬ: 5/5\nПОЛНОТА: 4/5\nГАЛЛЮЦИНАЦИИ: нет\nИТОГ: ОТЛИЧНО\nКОММЕНТАРИЙ: всё: верно"),
    (2, "  ТОЧНОСТЬ: 2\nГАЛЛЮЦИНАЦИИ: Есть\nИТОГ: ПЛОХО"),
    (3, "ТОЧНОСТЬ: n/a\nПОЛНОТА: 5\nИТОГ: ХОРОШО\nТОЧНОСТЬ: 3"),
    (4, "ничего"),
]
_VERDICT_SQL = (
    "WITH v(id, raw) AS (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in _VERDICTS) + "), l AS (SELECT id, "
    + ", ".join(f"list_extract(regexp_extract_all(raw, '(?m)^[ \\t]*{n}:{p}', 1), -1) AS {a}" for n, p, a in (("ТОЧНОСТЬ", "[ \\t]*([0-9])", "ac"), ("ПОЛНОТА", "[ \\t]*([0-9])", "co"), ("ГАЛЛЮЦИНАЦИИ", "(.*)", "ha"), ("ИТОГ", "(.*)", "ve"), ("КОММЕНТАРИЙ", "(.*)", "cm")))
    + " FROM v) SELECT id, ac::INT AS accuracy, co::INT AS completeness, contains(lower(ha), 'есть') AS hallucinations, trim(ve) AS verdict, coalesce(trim(cm), '') AS comment, round((coalesce(ac::INT, 3) + coalesce(co::INT, 3)) / 2, 1) AS score FROM l"
)


@query(_VERDICT_SQL)
def parse_verdict(s, d):
    return s.createDataFrame(_VERDICTS, "id int, raw string").select("id", tx.verdict(F.col("raw")).alias("v")).select("id", "v.*")


@query(f"WITH p AS ({_VERDICT_SQL}) SELECT count(*) FILTER (WHERE score >= 3) AS ok, avg(coalesce(score, 0)) AS mean_score, count(*) FILTER (WHERE hallucinations) AS hallucinated, count(*) FILTER (WHERE verdict IN ('ОТЛИЧНО', 'ХОРОШО')) AS good FROM p")
def eval_summary(s, d):
    p = parse_verdict(s, d)
    return p.agg(
        F.count_if(F.col("score") >= 3).alias("ok"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"),
        F.count_if("hallucinations").alias("hallucinated"), F.count_if(F.col("verdict").isin("ОТЛИЧНО", "ХОРОШО")).alias("good"),
    )


_VERBS = "|".join(tx.VERB_ENDINGS)


@query(f"SELECT t AS word, regexp_matches(t, '({_VERBS})$') AS verb FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) AS t FROM documents)")
def is_verb(s, d):
    return tokenize(s, d).select(F.col("token").alias("word"), tx.is_verb(F.col("token")).alias("verb"))


@query("SELECT name, substr(lower(name), 1, 6) AS stem FROM entities")
def stem6(s, d):
    return table(s, d, "entities").select("name", tx.stem6(F.col("name")).alias("stem"))


@query("WITH t(term) AS (VALUES " + ", ".join(f"('{t}')" for t in TERMS) + "), n AS (SELECT DISTINCT name FROM entities) SELECT term, name FROM t, n WHERE contains(lower(name), lower(term)) OR contains(lower(term), lower(name)) OR (least(length(name), length(term)) >= 5 AND substr(lower(name), 1, 6) = substr(lower(term), 1, 6))")
def terms_match(s, d):
    names = table(s, d, "entities").select("name").distinct()
    return _terms(s).join(names, tx.terms_match(F.col("term"), F.col("name"))).select("term", "name")


def _terms(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(t,) for t in TERMS], "term string")


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_NAMES)


@query(f"SELECT type, name, length(name) BETWEEN 2 AND 60 AND lower(name) NOT IN ({_STOP}) AND NOT regexp_matches(lower(name), '({_VERBS})$') AND (type NOT IN ('свита', 'месторождение', 'формация') OR (substr(name, 1, 1) = upper(substr(name, 1, 1)) AND substr(name, 1, 1) <> lower(substr(name, 1, 1)))) AND (type NOT IN ('пласт', 'горизонт', 'скважина') OR (NOT (name = lower(name) AND lower(name) <> upper(name) AND length(name) < 4) AND regexp_matches(name, '[А-ЯЁа-яёA-Za-z]'))) AS valid FROM entities")
def valid_entity_name(s, d):
    return table(s, d, "entities").select("type", "name", tx.valid_entity_name(F.col("name"), F.col("type")).alias("valid"))


@query("SELECT type, name, upper(type) || '_' || regexp_replace(upper(regexp_replace(name, '[.\\-]+$', '')), '[^А-ЯЁA-Z0-9]', '_', 'g') AS canonical FROM entities")
def canonical_id(s, d):
    return table(s, d, "entities").select("type", "name", tx.canonical_id(F.col("type"), F.col("name")).alias("canonical"))


@query("SELECT document_id, ts, " + " || ',' || ".join(f"CASE WHEN regexp_matches(coalesce(progress, ''), '(?i)({p})') THEN '{k}' ELSE '' END" for k, p in sorted(tx.PIPELINE_STEPS.items())) + " AS steps FROM registry_events")
def pipeline_steps(s, d):
    steps = tx.pipeline_steps(F.col("progress"))
    flat = F.array_join(F.transform(F.array(*(F.lit(k) for k in sorted(tx.PIPELINE_STEPS))), lambda k: F.when(F.array_contains(steps, k), k).otherwise("")), ",")
    return table(s, d, "registry_events").select("document_id", "ts", flat.alias("steps"))


@query("SELECT id, coalesce(nullif(regexp_extract(lower(p), 'тип[=:]?\\s*(text_pdf|scan_pdf|hybrid_pdf|docx|doc|djvu)', 1), ''), nullif(regexp_extract(lower(p), '(text_pdf|scan_pdf|hybrid_pdf)', 1), ''), '') AS badge FROM (SELECT id, coalesce(progress, '') || ' тип: ' || regexp_extract(name, '([^.]+)$', 1) AS p FROM registry)")
def doc_type_badge(s, d):
    p = F.concat(F.coalesce("progress", F.lit("")), F.lit(" тип: "), F.regexp_extract("name", "([^.]+)$", 1))
    return table(s, d, "registry").select("id", tx.doc_type_badge(p).alias("badge"))


@query("SELECT vec_id, round(abs(embedding[1]::DOUBLE) * 100)::INT AS percent FROM embeddings")
def percent_score(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(F.abs(F.col("embedding")[0].cast("double")) * 100).cast("int").alias("percent"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM documents")
def html_escape(s, d):
    return table(s, d, "documents").select("doc_id", tx.html_escape(F.col("text")).alias("html"))


def _case_sql(col: str, values: dict[str, str], other: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{other}' END"


@query(f"SELECT id, {_case_sql('status', tx.STATUS_ICONS, tx.OTHER_ICON)} AS icon FROM registry")
def status_icon_case(s, d):
    return table(s, d, "registry").select("id", tx.status_icon(F.col("status")).alias("icon"))


@query(f"SELECT DISTINCT type, {_case_sql('type', tx.TYPE_COLORS, tx.OTHER_COLOR)} AS color FROM entities")
def type_color(s, d):
    return table(s, d, "entities").select("type", tx.type_color(F.col("type")).alias("color")).distinct()


_MODES = [("rag",), ("hybrid",), ("graphrag",), ("",), ("RAG",), (None,)]


@query("SELECT m AS mode, CASE WHEN m IN ('rag', 'hybrid', 'graphrag') THEN m ELSE 'hybrid' END AS used FROM (VALUES ('rag'), ('hybrid'), ('graphrag'), (''), ('RAG'), (NULL)) v(m)")
def normalise_mode(s, d):
    return s.createDataFrame(_MODES, "mode string").select("mode", tx.normalise_mode(F.col("mode")).alias("used"))


_EVENTS = ["ask", "start", "done", "fail"]


@query("""WITH e AS (SELECT r.id, r.status, r.progress, r.error_msg, x.event FROM registry r, (VALUES ('ask'), ('start'), ('done'), ('fail')) x(event)),
t AS (SELECT *, CASE event WHEN 'ask' THEN status <> 'indexing' WHEN 'start' THEN status = 'pending' ELSE status = 'indexing' END AS taken FROM e)
SELECT id, event, CASE WHEN NOT taken THEN status WHEN event = 'ask' THEN 'pending' WHEN event = 'start' THEN 'indexing' WHEN event = 'done' THEN 'indexed' ELSE 'error' END AS status,
CASE WHEN taken AND event = 'ask' THEN '' WHEN taken AND event = 'start' THEN 'Начало обработки…' WHEN taken AND event = 'done' THEN 'Индексация завершена' ELSE progress END AS progress,
CASE WHEN taken AND event = 'ask' THEN '' WHEN taken AND event = 'fail' THEN repeat('x', 1000) ELSE error_msg END AS error_msg, taken FROM t""")
def status_machine(s, d):
    """Each document after each event."""
    r = table(s, d, "registry")
    events = r.select("id", F.explode(F.array(*map(F.lit, _EVENTS))).alias("event"), F.repeat(F.lit("x"), 2000).alias("message"))
    return store.advance(r, events)


@query("SELECT id, CASE WHEN total_pages > 0 THEN round(date_diff('microsecond', uploaded_at, indexed_at) / 1e6 / total_pages * 461 / 60) END AS minutes FROM registry WHERE indexed_at IS NOT NULL")
def vlm_forecast(s, d):
    """Minutes for a book of 461 pages at each document's pace."""
    seconds = (F.unix_micros(F.col("indexed_at").cast("timestamp")) - F.unix_micros(F.col("uploaded_at").cast("timestamp"))) / 1e6
    return table(s, d, "registry").filter("indexed_at is not null").select("id", F.when(F.col("total_pages") > 0, providers.forecast(seconds, F.col("total_pages"))).alias("minutes"))


@query("SELECT id, status, CASE WHEN status = 'indexing' THEN 'rejected' ELSE 'indexing' END AS next FROM registry")
def status_transition(s, d):
    return table(s, d, "registry").select("id", "status", store.can_index(F.col("status")).alias("next"))


@query(f"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')[1:3], ' ') AS terms FROM benchmark")
def query_fallback_terms(s, d):
    return table(s, d, "benchmark").select("item_id", F.array_join(tx.fallback_terms(F.col("text")), " ").alias("terms"))


# ---- chunking

_PAGES = "p AS (SELECT DISTINCT doc_id::VARCHAR AS document_id, coalesce(source, '') AS source_file, doc_id AS page, coalesce(text, '') AS text FROM documents)"
_WIN = f"w AS (SELECT document_id, source_file, page, text AS body, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS ws FROM p), x AS (SELECT *, unnest(range(0, ((len(ws) - 1) // 350)::BIGINT + 1)) AS window_no FROM w WHERE len(ws) > 0)"


def _doc_pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.coalesce("source", F.lit("")).alias("source_file"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("image_path")
    ).distinct()


@query(f"WITH {_PAGES}, {_WIN} SELECT document_id, page, window_no::INT AS window_no, 'text' AS type, array_to_string(ws[window_no * 350 + 1 : window_no * 350 + 400], ' ') AS text FROM x WHERE length(body) >= 30 AND length(array_to_string(ws[window_no * 350 + 1 : window_no * 350 + 400], ' ')) >= 30 UNION ALL SELECT document_id, page, 0, 'image', '[Страница ' || page || ' из ' || source_file || ']' FROM p WHERE length(text) < 30")
def chunk_pages(s, d):
    return chunk.chunk_pages(_doc_pages(s, d)).select("document_id", "page", "window_no", "type", "text")


_FLOW = f"{_PAGES}, {_WIN}, f AS (SELECT document_id, source_file, (window_no * 350 // 300 + 1)::INT AS page, window_no::INT AS window_no, array_to_string(ws[window_no * 350 + 1 : window_no * 350 + 400], ' ') AS text FROM x), fl AS (SELECT * FROM f WHERE length(text) >= 30)"


@query(f"WITH {_FLOW} SELECT * FROM fl")
def chunk_flow(s, d):
    return chunk.chunk_flow(_doc_pages(s, d))


@query(f"WITH {_FLOW} SELECT document_id, page, window_no, (row_number() OVER w - 1)::INT AS chunk_no, document_id || '_c' || (row_number() OVER w - 1) AS chunk_id FROM fl WINDOW w AS (PARTITION BY document_id ORDER BY page, window_no, text)")
def chunk_ids(s, d):
    return chunk.number_chunks(chunk.chunk_flow(_doc_pages(s, d))).select("document_id", "page", "window_no", "chunk_no", "chunk_id")


# ---- retrieval

_BM25 = f"""{_C}, tok AS (SELECT chunk_id, regexp_extract_all(lower(text), '[а-яёa-z0-9]+') AS t FROM c WHERE text IS NOT NULL),
len AS (SELECT chunk_id, len(t) AS dl FROM tok), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, corpus),
term AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_LEX = f"""bx AS (SELECT item_id, {_expanded_sql('text')} AS text FROM benchmark WHERE length(trim(text)) > 0),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) AS term FROM bx) GROUP BY ALL),
ls AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM q JOIN term USING (term) JOIN post USING (term) JOIN len USING (chunk_id), corpus GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ls WHERE score > 0)"""
_VEC = """b AS (SELECT chunk_id, ('0x' || substr(md5(x), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS x FROM (SELECT chunk_id, unnest(t) AS x FROM tok) GROUP BY ALL), bn AS (SELECT chunk_id, sqrt(sum(x * x)) AS nn FROM b GROUP BY 1),
qb AS (SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, sum(qtf)::DOUBLE AS y FROM q GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(y * y)) AS mm FROM qb GROUP BY 1),
vs AS (SELECT query_id, chunk_id, s, nn, mm FROM (SELECT query_id, chunk_id, sum(x * y) AS s FROM b JOIN qb USING (bucket) GROUP BY ALL) JOIN bn USING (chunk_id) JOIN qn USING (query_id)),
va AS (SELECT query_id, chunk_id, round(s / nn / mm, 4) AS score FROM vs), vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM va)"""
_RRF = """j AS (SELECT query_id, chunk_id, min(r1) AS r1, min(r2) AS r2, round(coalesce(1.0::DOUBLE / (60 + min(r1)), 0) + coalesce(1.0::DOUBLE / (60 + min(r2)), 0), 12) AS rrf FROM (SELECT query_id, chunk_id, rank AS r1, NULL::BIGINT AS r2 FROM vec WHERE rank <= 7 UNION ALL SELECT query_id, chunk_id, NULL, rank FROM lex WHERE rank <= 7) GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, round(rrf / max(rrf) OVER (PARTITION BY query_id), 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(r1, 1073741824), coalesce(r2, 1073741824), chunk_id) AS rank FROM j)"""


class _Collection(ask.Library):
    """The collection with its vectors, index and graph, each made once for an application, when it is first asked for."""

    def __init__(self, s: SparkSession, d: str):
        self.s, self.d = s, d

    @property
    def chunks(self) -> DataFrame:
        return _chunks(self.s, self.d).filter("text is not null")

    @property
    def vectors(self) -> DataFrame:
        return kept(self.s, ("vectors", self.d), lambda: stage(vector.hashed_rows(self.chunks, "chunk_id"), "vectors"))

    @property
    def index(self) -> lexical.LexicalIndex:
        return kept(self.s, ("index", self.d), lambda: lexical.build(self.chunks))

    @property
    def graph(self) -> graph.Graph:
        def made() -> graph.Graph:
            m = _mentions(self.s, self.d)
            # edges are made where they are asked for; no question does
            return graph.Graph(m, stage(graph.nodes(m), "graph"), graph.edges(m), stage(graph.locations(m), "graph"))

        return kept(self.s, ("graph", self.d), made)


def _library(s: SparkSession, d: str) -> ask.Library:
    return _Collection(s, d)


def _asked(s: SparkSession, d: str) -> DataFrame:
    return ask.accepted(_questions(s, d))


def _lexical(s: SparkSession, d: str, k: int = TOP_K) -> DataFrame:
    return ask.lexical_hits(_library(s, d), _asked(s, d), k)


def _semantic(s: SparkSession, d: str, k: int = TOP_K) -> DataFrame:
    return ask.vector_hits(_library(s, d), _asked(s, d), k)


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM term")
def bm25_build(s, d):
    forget(s, ("index", d))  # it is built anew; searches use it from then on
    return _library(s, d).index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25}, {_LEX} SELECT query_id, chunk_id, score, rank::INT AS rank FROM lex WHERE rank <= 7")
def bm25_topk(s, d):
    return _lexical(s, d)


@query(f"WITH {_BM25}, {_LEX}, {_VEC} SELECT query_id, chunk_id, score, rank::INT AS rank FROM vec WHERE rank <= 7")
def hashed_topk(s, d):
    return _semantic(s, d)


def _vector_sql(where: str) -> str:
    return f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings q JOIN embeddings e ON {where} WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 7"


def _embedded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings")
    vectors = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")
    return vectors, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(_vector_sql("true"))
def vector_topk(s, d):
    """Queries: every vector whose id is divisible by 20, against all vectors."""
    v, q = _embedded(s, d)
    return vector.cosine_topk(v, q, TOP_K)


@query(_vector_sql("e.label = 3"))
def vector_topk_filtered(s, d):
    v, q = _embedded(s, d)
    return vector.cosine_topk(v.filter("label = 3"), q, TOP_K)


@query(f"WITH qs AS (SELECT item_id AS query_id, {_expanded_sql('text')} AS text FROM benchmark), {_moments_sql('query_id', 'qs')}")
def embed_query(s, d):
    asked = _asked(s, d).select("query_id", F.col("asked").alias("text"))
    return _moments(vector.embed_with(asked, "query_id", vector.HashingEmbedder(), "query"), "query_id")


@query(f"WITH {_BM25}, {_LEX}, {_VEC}, {_RRF} SELECT query_id, chunk_id, score, rank::INT AS rank FROM fused WHERE rank <= 7")
def retrieve_hybrid(s, d):
    return retrieve.rrf_merge(_semantic(s, d), _lexical(s, d), TOP_K)


@query("WITH v AS (SELECT doc_id::VARCHAR AS chunk_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r1 FROM documents QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 200), l AS (SELECT doc_id::VARCHAR AS chunk_id, row_number() OVER (ORDER BY title DESC NULLS LAST, doc_id) AS r2 FROM documents QUALIFY row_number() OVER (ORDER BY title DESC NULLS LAST, doc_id) <= 200), j AS (SELECT chunk_id, r1, r2, round(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0), 12) AS rrf FROM v FULL JOIN l USING (chunk_id)) SELECT 0 AS query_id, chunk_id, round(rrf / max(rrf) OVER (), 4) AS score, (row_number() OVER (ORDER BY rrf DESC, r1, r2, chunk_id))::INT AS rank FROM j QUALIFY rank <= 50")
def rrf_merge(s, d):
    a, b = _two_lists(s, d)
    return retrieve.rrf_merge(a, b, 50)


def _two_lists(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(s, d, "documents").select(F.lit(0).alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "n_chars", "title")
    # two ranked lists of 200 hits each
    one = lambda *o: docs.orderBy(*o).limit(200).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*o)))
    return one(F.desc("n_chars"), "doc_id"), one(F.desc_nulls_last("title"), "doc_id")


@query("WITH v AS (SELECT doc_id::VARCHAR AS chunk_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, 0 AS list FROM documents QUALIFY rank <= 200 UNION ALL SELECT doc_id::VARCHAR, row_number() OVER (ORDER BY title DESC NULLS LAST, doc_id) AS rank, 1 FROM documents QUALIFY rank <= 200) SELECT 0 AS query_id, chunk_id, list, round(61.0::DOUBLE / (60 + rank), 4) AS score, (row_number() OVER (ORDER BY rank, list))::INT AS rank FROM v QUALIFY row_number() OVER (ORDER BY v.rank, list) <= 50")
def rrf_merge_compat(s, d):
    a, b = _two_lists(s, d)
    return retrieve.rrf_merge_as_written(a, b, 50)


_GQ = "g AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") v(term))"
_NODES = f"""{_M}, fo AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY source_file NULLS FIRST, page NULLS FIRST, chunk_id NULLS FIRST, pos NULLS FIRST, name) AS k FROM m), n AS (SELECT f.canonical, f.type, f.name FROM fo f WHERE k = 1)"""
_MATCH = "mt AS (SELECT DISTINCT n.canonical FROM n, g WHERE contains(lower(name), lower(term)) OR contains(lower(term), lower(name)) OR (least(length(name), length(term)) >= 5 AND substr(lower(name), 1, 6) = substr(lower(term), 1, 6)))"
_EDGES = "pe AS (SELECT DISTINCT source_file, page, canonical FROM m WHERE source_file IS NOT NULL AND page IS NOT NULL AND canonical IS NOT NULL), e AS (SELECT a.canonical AS src, b.canonical AS dst, count(*) AS weight, count(DISTINCT source_file) AS sources, count(DISTINCT page) AS pages, min(source_file) AS first_source FROM pe a JOIN pe b USING (source_file, page) WHERE a.canonical < b.canonical GROUP BY 1, 2)"
_BOTH = "bw AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"
_GP = "gp AS (SELECT DISTINCT source_file, page FROM m JOIN mt USING (canonical) WHERE page IS NOT NULL)"


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = _mentions(s, d)
    return m, graph.nodes(m), graph.edges(m)


_VERB = f"regexp_matches(lower({{0}}), '({_VERBS})$')"
_VALID = SQL["valid_entity_name"].split("SELECT type, name, ", 1)[1].rsplit(" AS valid FROM", 1)[0]


def _entities_of(source: str, key: str) -> str:
    """CTE ents(key, type, name, canonical, ord) of the texts of ``source``."""
    parts = " UNION ALL ".join(
        f"SELECT {key}, '{t}' AS type, {p} AS p, unnest(regexp_extract_all(text, '(?i){r}', 1)) AS raw, generate_subscripts(regexp_extract_all(text, '(?i){r}', 1), 1) - 1 AS i FROM {source}" for p, (t, r) in enumerate(graph.PATTERNS)
    )
    return f"""er AS ({parts}), ev AS (SELECT {key}, type, trim(raw) AS name, p, i FROM er), ek AS (SELECT *, row_number() OVER (PARTITION BY {key}, type, upper(name) ORDER BY p, i, name) AS o FROM ev WHERE {_VALID}),
ents AS (SELECT {key}, type, name, upper(type) || '_' || regexp_replace(upper(regexp_replace(name, '[.\\-]+$', '')), '[^А-ЯЁA-Z0-9]', '_', 'g') AS canonical, (p * 1000000 + i)::BIGINT AS ord FROM ek WHERE o = 1)"""


_QT = f"""qs0 AS (SELECT item_id AS query_id, text FROM benchmark), {_entities_of('qs0', 'query_id')},
qn0 AS (SELECT query_id, name AS term FROM ents WHERE NOT {_VERB.format('name')} AND length(name) > 2),
qc AS (SELECT query_id, unnest(regexp_extract_all(text, '{graph.CAPITALISED}', 1)) AS term, unnest(regexp_extract_all(text, '{graph.CAPITALISED}', 2)) AS nxt, generate_subscripts(regexp_extract_all(text, '{graph.CAPITALISED}', 1), 1) AS i FROM qs0),
q1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr(lower(term), 1, 6) ORDER BY i) AS r FROM qc WHERE nxt = '' AND NOT {_VERB.format('term')}),
qt AS (SELECT query_id, term FROM qn0 UNION ALL SELECT query_id, term FROM q1 WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM qn0 x WHERE x.query_id = q1.query_id AND substr(lower(x.term), 1, 6) = substr(lower(q1.term), 1, 6)))"""
_GRAPHED = f"""{_BM25}, {_LEX}, {_VEC}, {_NODES}, {_QT},
mq AS (SELECT DISTINCT query_id, canonical FROM n, qt WHERE contains(lower(name), lower(term)) OR contains(lower(term), lower(name)) OR (least(length(name), length(term)) >= 5 AND substr(lower(name), 1, 6) = substr(lower(term), 1, 6))),
g6 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_file, page) AS p FROM (SELECT DISTINCT query_id, source_file, page FROM m JOIN mq USING (canonical) WHERE page IS NOT NULL AND source_file IS NOT NULL) QUALIFY p <= 6),
nr AS (SELECT g6.query_id, va.chunk_id, va.score, text, p, row_number() OVER (PARTITION BY g6.query_id, p ORDER BY va.score DESC, va.chunk_id) AS r FROM g6 JOIN c USING (source_file, page) JOIN va ON va.query_id = g6.query_id AND va.chunk_id = c.chunk_id WHERE va.score > 0),
near AS (SELECT * FROM nr WHERE r <= 3 QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY p, r) = 1),
nh AS (SELECT query_id, count(*) AS held FROM near GROUP BY 1),
ft AS (SELECT vec.query_id, chunk_id, score, rank, held FROM vec JOIN c USING (chunk_id) JOIN nh USING (query_id) WHERE rank <= 7 AND NOT EXISTS (SELECT 1 FROM near x WHERE x.query_id = vec.query_id AND x.text = c.text) QUALIFY row_number() OVER (PARTITION BY vec.query_id, text ORDER BY rank) = 1),
fi AS (SELECT * FROM ft QUALIFY held + row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 7),
gu AS (SELECT query_id, chunk_id, score, 'graph' AS via FROM near UNION ALL SELECT query_id, chunk_id, score, 'vector' FROM fi),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM gu QUALIFY rank <= 7)"""
#: Requests: the mode goes round by item, and every fourth asks one source only.
_SOURCE = "(SELECT min(source_file) FROM c WHERE text IS NOT NULL)"
_MODES_SQL = f"""{_GRAPHED}, qs AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'rag' WHEN 1 THEN 'hybrid' ELSE 'graphrag' END AS mode, CASE WHEN item_id % 4 = 1 THEN {_SOURCE} END AS src FROM benchmark),
pl AS (SELECT query_id, mode, CASE WHEN mode <> 'graphrag' THEN src END AS f FROM qs WHERE mode <> 'graphrag' OR query_id NOT IN (SELECT query_id FROM g6)),
vf AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM va JOIN pl USING (query_id) JOIN c USING (chunk_id) WHERE f IS NULL OR source_file = f QUALIFY rank <= 7),
lf AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ls JOIN pl USING (query_id) JOIN c USING (chunk_id) WHERE score > 0 AND (f IS NULL OR source_file = f) QUALIFY rank <= 7),
mj AS (SELECT query_id, chunk_id, min(r1) AS r1, min(r2) AS r2, round(coalesce(1.0::DOUBLE / (60 + min(r1)), 0) + coalesce(1.0::DOUBLE / (60 + min(r2)), 0), 12) AS rrf FROM (SELECT query_id, chunk_id, rank AS r1, NULL::BIGINT AS r2 FROM vf UNION ALL SELECT query_id, chunk_id, NULL, rank FROM lf) JOIN pl USING (query_id) WHERE mode <> 'rag' GROUP BY ALL),
mf AS (SELECT query_id, chunk_id, round(rrf / max(rrf) OVER (PARTITION BY query_id), 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(r1, 1073741824), coalesce(r2, 1073741824), chunk_id) AS rank FROM mj QUALIFY rank <= 7),
gm AS (SELECT gr.*, src IS NULL OR source_file = src AS ok FROM gr JOIN qs USING (query_id) JOIN c USING (chunk_id) WHERE mode = 'graphrag'),
gk AS (SELECT *, max(ok) OVER (PARTITION BY query_id) AS any_ok FROM gm),
hits AS (SELECT query_id, chunk_id, score, via, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM gk WHERE ok OR NOT any_ok
UNION ALL SELECT query_id, chunk_id, score, 'vector', rank::INT FROM vf JOIN pl USING (query_id) WHERE mode = 'rag' UNION ALL SELECT query_id, chunk_id, score, 'fused', rank::INT FROM mf)"""


def _requests(s: SparkSession, d: str) -> DataFrame:
    source = _library(s, d).chunks.agg(F.min("source_file").alias("one"))  # a single row
    m, f = F.col("query_id") % 3, F.col("query_id") % 4 == 1
    mode = F.when(m == 0, "rag").when(m == 1, "hybrid").otherwise("graphrag")
    return _questions(s, d).join(F.broadcast(source)).select("query_id", "text", mode.alias("mode"), F.lit(None).cast("string").alias("document_id"), F.when(f, F.col("one")).alias("source_file"))


@query(f"WITH {_MODES_SQL} SELECT query_id, mode, chunk_id, score, via, rank FROM hits JOIN qs USING (query_id)")
def retrieve_mode(s, d):
    return ask.retrieve_by_mode(_library(s, d), _requests(s, d))


@query(f"WITH {_GRAPHED} SELECT query_id, chunk_id, score, via, rank::INT AS rank FROM gr")
def graphrag_retrieve(s, d):
    """All questions that have graph pages; the others fall back to hybrid (retrieve_mode)."""
    hits, _, _ = ask.graph_hits(_library(s, d), _asked(s, d), TOP_K)
    return hits.select("query_id", "chunk_id", "score", "via", "rank")


_TRACED = f"""{_GRAPHED}, {_RRF}, th AS (SELECT query_id, chunk_id, via, rank FROM gr UNION ALL SELECT query_id, chunk_id, 'fused', rank FROM fused WHERE rank <= 7 AND query_id NOT IN (SELECT query_id FROM g6)),
tc AS (SELECT query_id, count(*) FILTER (WHERE via = 'graph') AS chunks_from_graph, count(*) FILTER (WHERE via <> 'graph') AS chunks_from_vector, count(*) AS total_chunks, string_agg('[' || document_id || ':' || coalesce(page, 0) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM th JOIN c USING (chunk_id) GROUP BY 1),
ta AS (SELECT query_id, chunks_from_graph, chunks_from_vector, total_chunks, len(regexp_extract_all(concat_ws(chr(10), '**Запрос:**', b.text, '---', '**Найденные отрывки:**', CASE WHEN length(context) > 3000 THEN substr(context, 1, 3000) || '…' ELSE context END), '\\[[0-9a-f-]{{8,}}:[0-9]+\\]'))::BIGINT AS citations FROM tc JOIN benchmark b ON item_id = query_id),
tt AS (SELECT query_id, string_agg(term, '|' ORDER BY term) AS terms FROM qt GROUP BY 1), tp AS (SELECT query_id, string_agg(x, '|' ORDER BY x) AS pages FROM (SELECT query_id, right(replace(replace(source_file, '.pdf', ''), '.img', ''), 28) || ':' || page AS x FROM g6) GROUP BY 1)"""


@query(f"WITH {_TRACED} SELECT query_id, coalesce(terms, '') AS terms, coalesce(pages, '') AS pages, chunks_from_graph, chunks_from_vector, total_chunks, citations FROM ta LEFT JOIN tt USING (query_id) LEFT JOIN tp USING (query_id)")
def graph_trace(s, d):
    return ask.trace(_library(s, d), _questions(s, d))


@query(f"WITH {_BM25}, {_LEX} SELECT DISTINCT query_id, source_file, page FROM lex JOIN c USING (chunk_id) WHERE rank <= 7")
def sources_distinct(s, d):
    return _lexical(s, d).join(_chunks(s, d), "chunk_id").select("query_id", "source_file", "page").distinct()


@query(f"WITH {_BM25}, {_LEX}, i AS (SELECT query_id, image_path, min(rank) AS rank FROM lex JOIN c USING (chunk_id) WHERE rank <= 7 AND image_path <> '' GROUP BY ALL) SELECT query_id, image_path, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS place FROM i QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 4")
def images_dedup(s, d):
    hits = _lexical(s, d).join(_chunks(s, d), "chunk_id").filter("image_path <> ''").groupBy("query_id", "image_path").agg(F.min("rank").alias("rank"))
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("place <= 4").drop("rank")


_CONTEXT = "ctx AS (SELECT query_id, string_agg('[' || document_id || ':' || coalesce(page, 0) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM lex JOIN c USING (chunk_id) WHERE rank <= 7 GROUP BY 1)"


@query(f"WITH {_BM25}, {_LEX}, {_CONTEXT} SELECT * FROM ctx")
def format_context(s, d):
    return retrieve.format_context(sent(stage(_lexical(s, d), "context-hits")).join(_chunks(s, d), "chunk_id"))


_OFFLINE = "concat_ws(chr(10), '**Запрос:**', q2.text, '---', '**Найденные отрывки:**', CASE WHEN length(context) > 3000 THEN substr(context, 1, 3000) || '…' ELSE context END)"


@query(f"WITH {_BM25}, {_LEX}, {_CONTEXT} SELECT query_id, {_OFFLINE} AS answer FROM ctx JOIN benchmark q2 ON item_id = query_id")
def raw_context_fallback(s, d):
    return format_context(s, d).join(_questions(s, d), "query_id").select("query_id", retrieve.offline_answer(F.col("text"), F.col("context")).alias("answer"))


_ANSWERED = f"""{_MODES_SQL}, hx AS (SELECT query_id, count(*) AS chunks, count(DISTINCT (source_file, page)) AS sources, count(DISTINCT image_path) FILTER (WHERE image_path <> '') AS images, string_agg('[' || document_id || ':' || coalesce(page, 0) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN c USING (chunk_id) GROUP BY 1),
an AS (SELECT query_id, mode, CASE WHEN context IS NULL THEN '{ask.NOTHING_FOUND}' ELSE {_OFFLINE} END AS answer, coalesce(chunks, 0) AS chunks, coalesce(sources, 0) AS sources, coalesce(images, 0) AS images FROM qs JOIN benchmark q2 ON item_id = query_id LEFT JOIN hx USING (query_id))"""


@query(f"WITH {_ANSWERED} SELECT * FROM an")
def answer_bundle(s, d):
    """Requests in all three modes, with and without a filter."""
    q = _requests(s, d)
    return ask.answers(_library(s, d), q, ask.retrieve_by_mode(_library(s, d), q))


@query(f"""WITH {_ANSWERED}, cs AS (SELECT DISTINCT query_id, document_id, page FROM (SELECT query_id, unnest(regexp_extract_all(answer, '\\[([0-9a-f-]{{8,}}):([0-9]+)\\]', 1)) AS document_id, unnest(regexp_extract_all(answer, '\\[([0-9a-f-]{{8,}}):([0-9]+)\\]', 2))::INT AS page FROM an)),
fh AS (SELECT query_id, chunk_id, document_id, page, image_path FROM hits JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, document_id, page ORDER BY rank) = 1)
SELECT query_id, document_id, page, chunk_id, image_path FROM cs LEFT JOIN fh USING (query_id, document_id, page)""")
def cited_chunks(s, d):
    """Each citation of an answer with the first of its hits that it can mean."""
    q, lib = _requests(s, d), _library(s, d)
    hits = stage(ask.retrieve_by_mode(lib, q), "hits")
    return ask.cited_chunks(lib, ask.answers(lib, q, hits), hits)


@query(f"WITH {_BM25}, {_LEX}, {_VEC}, tm AS (SELECT DISTINCT item_id AS query_id, lower(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')[1]) AS term FROM benchmark) SELECT vec.query_id, score, contains(lower(c.text), term) AS found, CASE WHEN score >= 0.5 AND contains(lower(c.text), term) THEN 'ok' WHEN score >= 0.5 OR contains(lower(c.text), term) THEN 'partly' ELSE 'no' END AS status FROM vec JOIN c USING (chunk_id) JOIN tm ON tm.query_id = vec.query_id WHERE rank = 1")
def retrieval_eval(s, d):
    q = _questions(s, d).select("query_id", F.lower(tx.words(F.col("text"))[0]).alias("term")).distinct()
    hits = _semantic(s, d, 1).join(_chunks(s, d).select("chunk_id", "text"), "chunk_id").join(q, "query_id")
    found, enough = F.contains(F.lower("text"), F.col("term")), F.col("score") >= 0.5
    return hits.select("query_id", "score", found.alias("found"), F.when(enough & found, "ok").when(enough | found, "partly").otherwise("no").alias("status"))


#: Questions of quality, the terms of which one must be in the best hit, and its least score.
_QUALITY = [
    (1, "Что такое каустобиолиты?", ["каустобиолиты", "органическое", "углерод"], 0.5),
    (2, "Классификация нефтяных ловушек", ["ловушка", "антиклиналь", "структур"], 0.5),
    (3, "Геохимия органического вещества в нефтепроизводящих породах", ["органическое вещество", "ОВ", "геохимия", "нефтепроизводящ"], 0.5),
    (4, "ВНК водонефтяной контакт", ["контакт", "нефть", "вода", "ВНК"], 0.45),
    (5, "Методы сейсмической разведки нефти и газа", ["сейсм", "разведка", "волн"], 0.45),
]
_QUALITY_SQL = ", ".join(f"({i}, '{q}', [{', '.join(repr(t) for t in ts)}], {m}::DOUBLE)" for i, q, ts, m in _QUALITY)


@query(f"""WITH qu AS (SELECT * FROM (VALUES {_QUALITY_SQL}) v(item_id, text, terms, least)), benchmark AS (SELECT item_id::BIGINT AS item_id, text FROM qu), {_BM25}, {_LEX}, {_VEC}, {_RRF}
SELECT query_id, score, array_to_string(list_sort(list_filter(terms, lambda t: contains(lower(c.text), lower(t)))), '|') AS found_terms, CASE WHEN score < least THEN 'no' WHEN len(list_filter(terms, lambda t: contains(lower(c.text), lower(t)))) > 0 THEN 'ok' ELSE 'partly' END AS status FROM fused JOIN c USING (chunk_id) JOIN qu ON qu.item_id = query_id WHERE rank = 1""")
def retrieval_quality(s, d):
    """Fixed questions, each with the terms expected in its best hybrid hit and the score that it needs."""
    lib = _library(s, d)
    asked = s.createDataFrame(_QUALITY, "query_id bigint, text string, terms array<string>, least double")
    best = ask.retrieve_by_mode(lib, asked.select("query_id", "text", F.lit("hybrid").alias("mode")), TOP_K).filter("rank = 1")
    known = best.select("query_id", "chunk_id", "score").join(lib.chunks.select("chunk_id", F.lower("text").alias("body")), "chunk_id").join(asked, "query_id")
    found = F.filter("terms", lambda t: F.contains(F.col("body"), F.lower(t)))
    status = F.when(F.col("score") < F.col("least"), "no").when(F.size(found) > 0, "ok").otherwise("partly")
    return known.select("query_id", "score", F.array_join(F.array_sort(found), "|").alias("found_terms"), status.alias("status"))


# ---- entities and graph


@query(f"WITH {_C}, {_entities_of('c', 'chunk_id')} SELECT * FROM ents")
def extract_entities(s, d):
    return graph.extract_entities(_chunks(s, d).select("chunk_id", "text"), ["chunk_id"])


@query(f"WITH {_M} SELECT source_file, page, canonical, x.chunk_id AS chunk_id, x.pos AS pos FROM (SELECT source_file, page, canonical, min({{'chunk_id': chunk_id, 'pos': pos}}) AS x FROM m GROUP BY ALL)")
def page_entities(s, d):
    return graph.page_entities(_mentions(s, d))


@query(f"WITH {_NODES} SELECT canonical, n.type, n.name, (SELECT count(DISTINCT source_file) FROM m WHERE m.canonical = n.canonical) AS sources, (SELECT count(DISTINCT page) FROM m WHERE m.canonical = n.canonical) AS pages FROM n")
def graph_nodes(s, d):
    return graph.nodes(_mentions(s, d))


@query(f"WITH {_M}, {_EDGES} SELECT * FROM e")
def graph_edges(s, d):
    e = graph.edges(_mentions(s, d)).drop("relation")
    return e.withColumns({"sources": F.size("sources").cast("bigint"), "pages": F.size("pages").cast("bigint")})


@query(f"WITH {_NODES}, {_EDGES} SELECT coalesce(type, 'unknown') AS type, count(*) AS nodes, (SELECT count(*) FROM n) AS all_nodes, (SELECT count(*) FROM e) AS all_edges FROM n GROUP BY 1")
def graph_stats(s, d):
    _, n, e = _graph(s, d)
    by = n.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("nodes"))
    total = n.agg(F.count(F.lit(1)).alias("all_nodes")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("all_edges"))))  # single rows
    return by.join(F.broadcast(total))


@query(f"WITH {_NODES} SELECT coalesce(type, 'unknown') AS type, count(*) AS nodes FROM n GROUP BY 1 ORDER BY nodes DESC, type LIMIT 4")
def top_types(s, d):
    return graph.nodes(_mentions(s, d)).groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("nodes")).orderBy(F.desc("nodes"), "type").limit(4)


@query(f"WITH {_M}, {_EDGES}, {_BOTH} SELECT src AS canonical, count(*) AS degree FROM bw GROUP BY 1")
def node_degree(s, d):
    return graph.degrees(graph.edges(_mentions(s, d)))


@query(f"WITH {_NODES}, {_EDGES}, {_BOTH}, {_GQ}, {_MATCH}, nb AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM bw WHERE src IN (SELECT canonical FROM mt)), h AS (SELECT DISTINCT dst AS canonical FROM nb WHERE r <= 8 AND dst NOT IN (SELECT canonical FROM mt)), al AS (SELECT canonical, false AS hop1 FROM mt UNION ALL SELECT canonical, true FROM h), tp AS (SELECT src AS canonical, true AS hop1 FROM bw GROUP BY src ORDER BY count(*) DESC, src LIMIT 30), fi AS (SELECT * FROM al ORDER BY hop1, canonical LIMIT 30) SELECT * FROM fi UNION ALL SELECT * FROM tp WHERE NOT EXISTS (SELECT 1 FROM mt)")
def graph_neighborhood(s, d):
    _, n, e = _graph(s, d)
    return graph.neighbourhood(n, e, _terms(s))


_NEAR = f"""{_NODES}, {_EDGES}, {_BOTH}, {_GQ}, {_MATCH}, nb AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM bw WHERE src IN (SELECT canonical FROM mt)),
hp AS (SELECT DISTINCT dst AS canonical FROM nb WHERE r <= 8 AND dst NOT IN (SELECT canonical FROM mt)), nn AS (SELECT canonical, hop1 FROM (SELECT canonical, false AS hop1 FROM mt UNION ALL SELECT canonical, true FROM hp) ORDER BY hop1, canonical LIMIT 30)"""


@query(f"WITH {_NEAR} SELECT src, dst, 'co-occurrence' AS relation, weight, src IN (SELECT canonical FROM mt) OR dst IN (SELECT canonical FROM mt) AS is_seed_edge FROM e WHERE src IN (SELECT canonical FROM nn) AND dst IN (SELECT canonical FROM nn)")
def graph_neighborhood_edges(s, d):
    _, n, e = _graph(s, d)
    return graph.neighbourhood_edges(stage(graph.neighbourhood(n, e, _terms(s)), "near"), e)


@query(f"WITH {_NEAR}, {_GP} SELECT (SELECT count(*) FROM mt) AS seeds, (SELECT count(*) FROM hp) AS hop1_count, (SELECT count(*) FROM nn) AS nodes, (SELECT count(*) FROM e WHERE src IN (SELECT canonical FROM nn) AND dst IN (SELECT canonical FROM nn)) AS edges, (SELECT count(*) FROM gp) AS pages")
def graph_neighborhood_summary(s, d):
    return graph.neighbourhood_summary(graph.Graph.of(_mentions(s, d)), _terms(s))


@query(f"""WITH {_C}, cx AS (SELECT chunk_id, source_file, page, text FROM c), {_entities_of('cx', 'chunk_id')}, m AS (SELECT ents.*, source_file, page FROM ents JOIN cx USING (chunk_id)),
n AS (SELECT canonical, first(type ORDER BY source_file NULLS FIRST, page NULLS FIRST, chunk_id, ord, name) AS type FROM m GROUP BY 1),
pe AS (SELECT DISTINCT source_file, page, canonical FROM m WHERE source_file IS NOT NULL AND page IS NOT NULL), e AS (SELECT DISTINCT a.canonical AS src, b.canonical AS dst FROM pe a JOIN pe b USING (source_file, page) WHERE a.canonical < b.canonical)
SELECT type, count(*) AS nodes, (SELECT count(*) FROM n) AS all_nodes, (SELECT count(*) FROM e) AS all_edges FROM n GROUP BY 1""")
def rebuild_graph(s, d):
    """Extraction from all chunks, the graph's tables written and read back, and their statistics."""
    g = graph.rebuild(_chunks(s, d), f"{staged_dir(s)}/graph-{abs(hash(d))}")
    by = g.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("nodes"))
    total = g.nodes.agg(F.count(F.lit(1)).alias("all_nodes")).join(F.broadcast(g.edges.agg(F.count(F.lit(1)).alias("all_edges"))))  # single rows
    return by.join(F.broadcast(total))


@query(f"WITH {_NODES}, {_EDGES}, {_GQ}, {_MATCH} SELECT src, dst, weight FROM e WHERE src IN (SELECT canonical FROM mt) AND dst IN (SELECT canonical FROM mt)")
def induced_subgraph(s, d):
    _, n, e = _graph(s, d)
    return graph.induced(e, graph.matching(n, _terms(s))).select("src", "dst", "weight")


@query(f"WITH {_NODES}, {_GQ}, {_MATCH}, {_GP} SELECT * FROM gp")
def graph_pages(s, d):
    m, n, _ = _graph(s, d)
    return graph.pages_of(m, graph.matching(n, _terms(s)))


@query(f"WITH {_NODES}, {_GQ}, {_MATCH} SELECT DISTINCT a.source_file, b.page FROM m a JOIN m b USING (canonical) WHERE canonical IN (SELECT canonical FROM mt) AND a.source_file IS NOT NULL AND b.page IS NOT NULL")
def graph_pages_cross(s, d):
    m, n, _ = _graph(s, d)
    return graph.pages_of(m, graph.matching(n, _terms(s)), cross=True)


@query(f"WITH {_QT} SELECT query_id, term FROM qt")
def query_entities(s, d):
    return graph.query_terms(_questions(s, d))


# ---- aggregates and reports


@query("SELECT substr(source_file, 1, 50) AS source, count(*) AS n FROM chunks GROUP BY 1")
def chunks_per_source(s, d):
    return table(s, d, "chunks").groupBy(F.substring("source_file", 1, 50).alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query(f"WITH {_C} SELECT document_id, count(*) FILTER (WHERE type = 'text') AS text_chunks, count(*) FILTER (WHERE image_path <> '') AS images, count(DISTINCT image_path) FILTER (WHERE image_path <> '') AS distinct_images, coalesce(max(page), 0) AS total_pages FROM c GROUP BY 1")
def ingest_stats(s, d):
    return store.ingest_stats(_chunks(s, d))


@query(f"WITH {_C}, {_NODES}, {_EDGES} SELECT count(*) AS docs, count(*) FILTER (WHERE status = 'indexed') AS indexed, coalesce(sum(text_chunks) FILTER (WHERE status = 'indexed'), 0)::BIGINT AS text_chunks, coalesce(sum(total_pages) FILTER (WHERE status = 'indexed'), 0)::BIGINT AS pages, (SELECT count(*) FROM c) AS collection, (SELECT count(DISTINCT canonical) FROM m) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT string_agg(type || '=' || k, ',' ORDER BY type) FROM (SELECT type, count(*) AS k FROM n GROUP BY 1)) AS types FROM registry")
def system_metrics(s, d):
    on = F.col("status") == "indexed"
    r = table(s, d, "registry").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(on).alias("indexed"),
        F.coalesce(F.sum(F.when(on, F.col("text_chunks"))), F.lit(0)).cast("bigint").alias("text_chunks"), F.coalesce(F.sum(F.when(on, F.col("total_pages"))), F.lit(0)).cast("bigint").alias("pages"),
    )
    g = _library(s, d).graph
    by = g.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("k"))  # as many rows as types
    types = by.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "type", F.col("k").cast("string")))), ",").alias("types"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    for one in (collection_count(s, d).withColumnRenamed("n", "collection"), n(g.nodes, "nodes"), n(g.edges, "edges"), types):
        r = r.join(F.broadcast(one))  # single rows
    return r


@query(f"WITH {_C} SELECT count(*) FILTER (WHERE type = 'text') AS text_chunks, count(*) FILTER (WHERE type = 'image') AS image_chunks, count(*) FILTER (WHERE length(trim(text)) >= 150) AS direct, count(*) FILTER (WHERE NOT coalesce(length(trim(text)) >= 150, false)) AS ocr FROM c")
def strategy_counts(s, d):
    r = detect.route(F.col("text"))
    return _chunks(s, d).agg(F.count_if(F.col("type") == "text").alias("text_chunks"), F.count_if(F.col("type") == "image").alias("image_chunks"), F.count_if(r == "direct").alias("direct"), F.count_if(r == "ocr").alias("ocr"))


@query(f"WITH {_C} SELECT source_file, count(*) FILTER (WHERE type = 'text') AS text, count(*) FILTER (WHERE type = 'image') AS image FROM c GROUP BY 1")
def per_source_stats(s, d):
    return _chunks(s, d).groupBy("source_file").pivot("type", ["text", "image"]).agg(F.count(F.lit(1))).fillna(0, ["text", "image"])


@query("SELECT id, name, (row_number() OVER (ORDER BY uploaded_at DESC NULLS LAST, id))::INT AS place FROM registry")
def order_docs(s, d):
    return numbered(table(s, d, "registry").select("id", "name", "uploaded_at"), [F.desc_nulls_last("uploaded_at"), F.col("id")], "order").select("id", "name", "place")


@query(f"WITH {_C} SELECT chunk_id, 'direct' AS via FROM c WHERE coalesce(image_path, '') = '' UNION ALL SELECT chunk_id, 'ocr' FROM c WHERE image_path <> ''")
def union_chunks(s, d):
    c = _chunks(s, d)
    return c.filter("coalesce(image_path, '') = ''").select("chunk_id", F.lit("direct").alias("via")).unionByName(c.filter("image_path <> ''").select("chunk_id", F.lit("ocr").alias("via")))


@query(f"WITH {_C} SELECT DISTINCT text FROM c WHERE text IS NOT NULL AND document_id NOT IN (SELECT id FROM registry WHERE status = 'indexed')")
def unseen_texts(s, d):
    done = table(s, d, "registry").filter("status = 'indexed'").select(F.col("id").alias("document_id"))
    return _chunks(s, d).filter("text is not null").join(done, "document_id", "left_anti").select("text").distinct()


@query("SELECT name FROM (VALUES ('acme/vision-chat'), ('acme/text-only'), ('other/Vision-large')) v(name) WHERE contains(lower(name), 'vision')")
def model_catalogue(s, d):
    return s.createDataFrame([("acme/vision-chat",), ("acme/text-only",), ("other/Vision-large",)], "name string").filter(F.contains(F.lower("name"), F.lit("vision")))
