"""Questions to a collection: retrieval by mode, answers and their traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citations, count_citations, expand_abbreviations, normalise_mode, terms_match
from ..runtime import sent, stage
from . import lexical, retrieve, vector
from .graph import Graph, query_terms

#: What a question without hits, or to an empty collection, is answered.
NOTHING_FOUND = "По данному запросу ничего не найдено."
NOT_INDEXED = "Документы ещё не проиндексированы. Загрузите PDF."
MOST_PAGES = 6
#: So many rows of question terms (about 60 bytes each) may be sent to every task.
QUESTION_TERMS = 200_000


@dataclass
class Library:
    """A collection as it stands after ingestion: chunks (chunk_id unique), vectors (chunk_id, v), index and graph."""

    chunks: DataFrame
    vectors: DataFrame
    index: lexical.LexicalIndex
    graph: Graph


def accepted(questions: DataFrame) -> DataFrame:
    """query_id, text, asked (with abbreviations expanded), mode, document_id, source_file. A blank question is rejected,
    an unknown mode is hybrid, and a document's filter goes before a source's."""
    own = {c: F.col(c) if c in questions.columns else F.lit(None).cast("string") for c in ("mode", "document_id", "source_file")}
    filled = lambda c: F.when(F.length(own[c]) > 0, own[c])
    source = F.when(filled("document_id").isNull(), filled("source_file"))
    out = questions.filter(F.col("query_id").isNotNull() & (F.length(F.trim("text")) > 0))
    return out.select("query_id", "text", expand_abbreviations(F.col("text")).alias("asked"), normalise_mode(own["mode"]).alias("mode"), filled("document_id").alias("document_id"), source.alias("source_file"))


def _allowed(library: Library, q: DataFrame) -> DataFrame:
    """(query_id, chunk_id) that the filter of a question with one lets pass."""
    c = library.chunks.select("chunk_id", F.col("document_id").alias("d"), F.col("source_file").alias("s"))
    by_doc = q.filter("document_id is not null").join(c, F.col("document_id") == F.col("d"))
    by_source = q.filter("source_file is not null").join(c, F.col("source_file") == F.col("s"))
    return by_doc.select("query_id", "chunk_id").unionByName(by_source.select("query_id", "chunk_id"))


def _embedded(q: DataFrame) -> DataFrame:
    return vector.dense(vector.hashed_counts(q.select("query_id", F.col("asked").alias("text")), "query_id"), "query_id", "q")


def vector_hits(library: Library, q: DataFrame, k: int, filtered: bool = True) -> DataFrame:
    """query_id, chunk_id, score, rank by cosine; a question with a filter is scored against its own chunks only."""
    e = _embedded(q)
    if not filtered:
        return vector.cosine_topk(library.vectors, e, k)
    limited = q.filter("document_id is not null or source_file is not null")
    if limited.isEmpty():
        return vector.cosine_topk(library.vectors, e, k)
    free = e.join(limited.select("query_id"), "query_id", "left_anti")
    own = _allowed(library, limited).join(library.vectors, "chunk_id").join(e, "query_id").select("query_id", "chunk_id", vector.cosine(F.col("v"), F.col("q")).alias("score"))
    return vector.cosine_topk(library.vectors, free, k).unionByName(lexical.ranked(own.filter("score is not null"), k))


def lexical_hits(library: Library, q: DataFrame, k: int) -> DataFrame:
    limited = q.filter("document_id is not null or source_file is not null")
    where = None if limited.isEmpty() else _allowed(library, limited)
    return lexical.search(library.index, q.select("query_id", F.col("asked").alias("text")), k, where)


def graph_pages(library: Library, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of each question (query_id, term), and its first pages in the graph (query_id, source_file, page, p)."""
    terms = stage(query_terms(q.select("query_id", "text")), "terms")
    few = terms.limit(QUESTION_TERMS + 1).count() <= QUESTION_TERMS
    names = library.graph.nodes.select("canonical", "name")
    # a match isn't an equality, so all terms meet all names; few terms go to the nodes
    met = names.join(F.broadcast(terms) if few else terms, terms_match(F.col("term"), F.col("name"))).select("query_id", "canonical").distinct()
    at = met.join(library.graph.locations.filter("page is not null and source_file is not null"), "canonical").select("query_id", "source_file", "page").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("source_file", "page"))
    return terms, at.withColumn("p", place).filter(F.col("p") <= MOST_PAGES)


def graph_hits(library: Library, q: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits of the questions that have graph pages (query_id, chunk_id, score, via, rank), their terms and their pages."""
    terms, pages = graph_pages(library, q)
    pages = stage(pages, "graph-pages")
    text = library.chunks.select("chunk_id", "text", "source_file", "page")
    on_page = sent(pages).join(text, ["source_file", "page"]).join(library.vectors, "chunk_id").join(_embedded(q), "query_id")
    near = on_page.select("query_id", "p", "chunk_id", vector.cosine(F.col("v"), F.col("q")).alias("score"), "text").filter("score > 0")
    asked = q.join(pages.select("query_id").distinct(), "query_id", "left_semi")
    best = sent(stage(vector_hits(library, asked, k, filtered=False), "graph-fill")).join(text.select("chunk_id", "text"), "chunk_id")
    return retrieve.graph_retrieve(near, best, k), terms, pages


def retrieve_by_mode(library: Library, questions: DataFrame, k: int = 7) -> DataFrame:
    """query_id, mode, chunk_id, score, via, rank.

    rag: vectors; hybrid: vectors and BM25, fused; graphrag: chunks of the pages where the question's terms are in the
    graph, filled up by vectors, or as hybrid where there are none. A filter holds in rag and hybrid before the ranking;
    in graphrag afterwards, unless nothing would be left.
    """
    q = stage(accepted(questions), "questions")
    mode = F.col("mode")
    by_graph, _, pages = graph_hits(library, q.filter(mode == "graphrag"), k)
    limited = q.filter(mode == "graphrag").select("query_id", "document_id", "source_file")
    held = by_graph.join(library.chunks.select("chunk_id", F.col("document_id").alias("d"), F.col("source_file").alias("s")), "chunk_id").join(limited, "query_id")
    match = F.coalesce((F.col("d") == F.col("document_id")) | (F.col("s") == F.col("source_file")), F.lit(False))
    free = F.col("document_id").isNull() & F.col("source_file").isNull()
    by_graph = lexical.ranked(retrieve.keep_matching_or_all(held, free | match, "query_id").select("query_id", "chunk_id", "score", "via"), k)
    fallback = q.filter(mode == "graphrag").join(pages.select("query_id").distinct(), "query_id", "left_anti")
    # the fallback asks without a filter, which then holds afterwards
    unfiltered = fallback.withColumns({"document_id": F.lit(None).cast("string"), "source_file": F.lit(None).cast("string")})
    plain = q.filter(mode != "graphrag").unionByName(unfiltered.select(q.columns))
    vectors = stage(vector_hits(library, plain, k), "vector-hits")
    both = plain.filter(mode != "rag")
    fused = retrieve.rrf_merge(vectors.join(both.select("query_id"), "query_id", "left_semi"), lexical_hits(library, both, k), k)
    only = vectors.join(plain.filter(mode == "rag").select("query_id"), "query_id", "left_semi")
    tag = lambda df, via: df.select("query_id", "chunk_id", "score", F.lit(via).alias("via"), "rank")
    hits = by_graph.select("query_id", "chunk_id", "score", "via", "rank").unionByName(tag(only, "vector")).unionByName(tag(fused, "fused"))
    return hits.join(q.select("query_id", "mode"), "query_id").select("query_id", "mode", "chunk_id", "score", "via", "rank")


def answers(library: Library, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, mode, answer, chunks, sources, images: the offline answer from the hits, or that nothing was found."""
    q = accepted(questions)
    known = sent(stage(hits, "answer-hits")).join(library.chunks, "chunk_id")
    n = known.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.size(F.collect_set(F.struct("source_file", "page"))).cast("bigint").alias("sources"),
        F.count_distinct(F.when(F.length("image_path") > 0, F.col("image_path"))).alias("images"),
    )
    empty = library.chunks.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))  # a single row
    context = retrieve.format_context(known)
    out = q.join(context, "query_id", "left").join(n, "query_id", "left").join(F.broadcast(empty))
    answer = F.when(F.col("context").isNotNull(), retrieve.offline_answer(F.col("text"), F.col("context"))).when(F.col("empty"), NOT_INDEXED).otherwise(NOTHING_FOUND)
    return out.select("query_id", "mode", answer.alias("answer"), "chunks", "sources", "images").fillna(0, ["chunks", "sources", "images"])


def trace(library: Library, questions: DataFrame, k: int = 7) -> DataFrame:
    """One row a question, as asked by graphrag: its terms and graph pages (sorted, joined by |), hits by the way they
    came, and citations in the offline answer."""
    q = stage(accepted(questions).withColumn("mode", F.lit("graphrag")), "questions")
    terms, pages = graph_pages(library, q)
    hits = stage(retrieve_by_mode(library, q.select("query_id", "text", "mode"), k), "trace-hits")
    said = answers(library, q.select("query_id", "text", "mode"), hits).select("query_id", count_citations(F.col("answer")).cast("bigint").alias("citations"))
    joined = lambda df, x, name: df.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(x)), "|").alias(name))
    short = F.right(F.replace(F.replace(F.col("source_file"), F.lit(".pdf"), F.lit("")), F.lit(".img"), F.lit("")), F.lit(28))
    came = hits.groupBy("query_id").agg(F.count_if(F.col("via") == "graph").alias("chunks_from_graph"), F.count_if(F.col("via") != "graph").alias("chunks_from_vector"), F.count(F.lit(1)).alias("total_chunks"))
    out = q.select("query_id").join(joined(terms, F.col("term"), "terms"), "query_id", "left").join(joined(pages, F.concat_ws(":", short, F.col("page").cast("string")), "pages"), "query_id", "left")
    return out.join(came, "query_id", "left").join(said, "query_id", "left").fillna("", ["terms", "pages"]).fillna(0)


def cited_chunks(library: Library, answered: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, document_id, page, chunk_id, image_path: each citation of an answer with the first hit that it can mean."""
    said = answered.select("query_id", F.explode(citations(F.col("answer"))).alias("c")).select("query_id", "c.document_id", "c.page").distinct()
    known = sent(hits).select("query_id", "chunk_id", "rank").join(library.chunks.select("chunk_id", "document_id", "page", "image_path"), "chunk_id")
    first = known.groupBy("query_id", "document_id", "page").agg(F.min_by(F.struct("chunk_id", "image_path"), "rank").alias("x"))
    return said.join(first, ["query_id", "document_id", "page"], "left").select("query_id", "document_id", "page", "x.chunk_id", "x.image_path")
