"""Semantics that the given tables don't reach."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq import runtime
from corpusq.operators import ask, chunk, detect, graph, lexical, retrieve, store, vector
from corpusq.sources import files, providers


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).collect()[0][0]


@pytest.mark.parametrize("n", [0, 1, 349, 350, 351, 400, 401, 750, 2101])
def test_windows_cover(spark, n):
    words = [f"слово{i}" for i in range(n)]
    df = spark.createDataFrame([("d", "s", "  ".join(words))], "document_id string, source_file string, text string")
    got = [r.body.split() for r in chunk.windows(df, "text").orderBy("window_no").collect()]
    assert len(got) == -(-n // 350)
    assert {w for g in got for w in g} == set(words)
    assert all(len(g) <= 400 for g in got)


def test_chunk_pages_edges(spark):
    rows = [("d", "f", 1, "коротко", ""), ("d", "f", 2, None, ""), ("d", "f", 3, " " * 40, ""), ("d", "f", 4, "слово " * 10, "")]
    df = spark.createDataFrame(rows, "document_id string, source_file string, page int, text string, image_path string")
    got = {(r.page, r.type) for r in chunk.chunk_pages(df).collect()}
    assert got == {(1, "image"), (2, "image"), (4, "text")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("K1 и K", "K1 (нижний мел) и K (меловой период)"),
        ("ВНК и ВНК", "ВНК (водонефтяной контакт) и ВНК"),
        ("внк, слоВНК", "внк, слоВНК"),
    ],
)
def test_abbreviations(spark, text, want):
    assert one(spark, tx.expand_abbreviations, text) == want


def test_abbreviations_as_written(spark):
    assert one(spark, lambda c: tx.expand_abbreviations(c, as_written=True), "K1").startswith("K (меловой период)1")


def test_ocr_sections(spark):
    raw = "до\n=== ТЕКСТ ===\nпервая\n=== ДИАГРАММЫ ===\nОтсутствуют\n=== ТЕКСТ ===\nвторая\n=== АББРЕВИАТУРЫ ===\nнет"
    assert one(spark, tx.ocr_sections, raw) == "первая\nвторая"
    assert one(spark, tx.ocr_sections, "просто") == "просто"
    assert one(spark, tx.ocr_sections, None) is None


@pytest.mark.parametrize(
    ("kind", "name", "ok"),
    [("скважина", "12", False), ("скважина", "12а", False), ("скважина", "12А", True), ("пласт", "БС10", True), ("свита", "мегионская", False), ("свита", "Мегионская", True), ("пласт", "называется", False), ("пласт", "x", False)],
)
def test_entity_names(spark, kind, name, ok):
    assert one(spark, lambda c: tx.valid_entity_name(c, F.lit(kind)), name) is ok


def test_entities_of_all_types(spark):
    text = "Пласт БС10. Скважина № 12А, скв. 7Б; горизонт Ю-2 и Мегионская свита. Самотлорское месторождение, Баженовская формация."
    got = {(r.type, r.canonical) for r in graph.extract_entities(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), ["id"]).collect()}
    assert ("пласт", "ПЛАСТ_БС10") in got and ("скважина", "СКВАЖИНА_12А") in got
    assert {k for k, _ in got} == {"пласт", "скважина", "горизонт", "свита", "месторождение", "формация"}


def mentions(spark, rows):
    return spark.createDataFrame(rows, "type string, name string, canonical string, source_file string, page int, chunk_id string, pos int")


def test_graph_pages_are_real_pairs(spark):
    m = mentions(spark, [("пласт", "А1", "X", "A", 1, "a", 0), ("пласт", "А1", "X", "B", 9, "b", 0), ("пласт", "Б2", "Y", "A", 1, "a", 1), ("пласт", "В3", None, None, None, "c", 0)])
    hit = graph.matching(graph.nodes(m), spark.createDataFrame([("а1",)], "term string"))
    assert {tuple(r) for r in graph.pages_of(m, hit).collect()} == {("A", 1), ("B", 9)}
    assert len(graph.pages_of(m, hit, cross=True).collect()) == 4
    e = graph.edges(m).collect()
    assert [(r.src, r.dst, r.weight) for r in e] == [("X", "Y", 1)]


def test_neighbourhood_fallback(spark):
    m = mentions(spark, [("пласт", "А1", "X", "A", 1, "a", 0), ("пласт", "Б2", "Y", "A", 1, "a", 1)])
    got = graph.neighbourhood(graph.nodes(m), graph.edges(m), spark.createDataFrame([("нет такого",)], "term string")).collect()
    assert {r.canonical for r in got} == {"X", "Y"} and all(r.hop1 for r in got)


def test_bm25_filter_and_order(spark):
    rows = [("a", "нефть газ"), ("b", "нефть нефть вода"), ("c", "песок"), ("d", ""), ("e", None)]
    c = spark.createDataFrame(rows, "chunk_id string, text string").filter("text is not null")
    q = spark.createDataFrame([(1, "нефть вода"), (2, "нигде")], "query_id bigint, text string")
    ix = lexical.build(c)
    all_ = [r.chunk_id for r in lexical.search(ix, q, 5).orderBy("rank").collect()]
    assert all_[0] == "b"
    only = lexical.search(ix, q, 5, spark.createDataFrame([(1, "a"), (2, "a")], "query_id bigint, chunk_id string")).collect()
    assert {r.chunk_id for r in only} <= {"a"}
    shuffled = lexical.search(lexical.build(c.repartition(3)), q, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in shuffled] == all_


def test_rrf(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    got = [(r.chunk_id, r.score) for r in retrieve.rrf_merge(v, b, 7).orderBy("rank").collect()]
    assert got[0] == ("b", 1.0) and [g[0] for g in got] == ["b", "a", "c"]
    compat = [r.chunk_id for r in retrieve.rrf_merge_as_written(v, b, 4).orderBy("rank").collect()]
    assert compat == ["a", "b", "b", "c"]
    assert retrieve.rrf_merge(v.limit(0), b.limit(0), 7).count() == 0


def test_cosine_edges(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 0.0])], "chunk_id string, v array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id bigint, q array<double>")
    assert [(r.chunk_id, r.score) for r in vector.cosine_topk(v, q, 3).orderBy("rank").collect()] == [("a", 1.0), ("d", 1.0)]


@pytest.mark.parametrize(("n", "long", "want"), [(1, 1, "text_pdf"), (10, 4, "hybrid_pdf"), (10, 3, "scan_pdf"), (25, 25, "text_pdf"), (11, 6, "hybrid_pdf"), (11, 7, "text_pdf")])
def test_detect(spark, n, long, want):
    df = spark.createDataFrame([("d", i, "x" * (150 if i < long else 149)) for i in range(n)], "doc string, page int, text string")
    r = detect.type_by_pages(df, "doc", "page", "text").collect()[0]
    assert r.doc_type == want and r.sample_pages <= 10


def test_store_replace_and_empty(spark, tmp_path):
    path = str(tmp_path / "chunks")
    mk = lambda *rows: spark.createDataFrame(rows, "document_id string, text string")
    ids = lambda *d: spark.createDataFrame([(x,) for x in d], "document_id string")
    read = lambda: sorted((r.document_id, r.text) for r in store.read_documents(spark, path).collect())
    store.write_documents(spark, mk(("a", "1"), ("b", "1"), *((f"c{i}", "1") for i in range(400))), path, ids("a", "b"))
    store.write_documents(spark, mk(("a", "2")), path, ids("a", "b"))
    assert read() == [("a", "2"), *sorted((f"c{i}", "1") for i in range(400))]
    store.write_documents(spark, mk(("a", "2")).limit(0), path, ids("a", *(f"c{i}" for i in range(400))))
    assert read() == []
    store.recreate(mk(("z", "9")), path)
    assert read() == [("z", "9")]


def test_stream(spark, tmp_path):
    from corpusq.streaming.ingest import PAGES, index_stream

    src, dst, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    read = lambda: {(r.document_id, r.type, r.page) for r in store.read_documents(spark, dst).collect()}
    spark.createDataFrame([("d1", "f", 1, "слово " * 50, ""), ("d2", "f", 1, "", "x.jpg")], PAGES).write.parquet(src)
    index_stream(spark, src, dst, cp).awaitTermination(120)
    assert read() == {("d1", "text", 1), ("d2", "image", 1)}
    spark.createDataFrame([("d1", "f", 7, "слово " * 50, ""), (None, "f", 1, "слово " * 50, "")], PAGES).write.mode("append").parquet(src)
    index_stream(spark, src, dst, cp).awaitTermination(120)
    assert read() == {("d1", "text", 7), ("d2", "image", 1)}


def test_status_machine(spark):
    docs = spark.createDataFrame([("a", "indexing", "50 %", ""), ("b", "error", "x", "старая")], "id string, status string, progress string, error_msg string")
    on = lambda e: {r.id: r for r in store.advance(docs, spark.createDataFrame([(i, e, "м" * 2000) for i in "ab"], "id string, event string, message string")).collect()}
    asked, failed = on("ask"), on("fail")
    assert (asked["a"].status, asked["a"].taken) == ("indexing", False) and tuple(asked["b"])[2:5] == ("pending", "", "")
    assert failed["a"].status == "error" and len(failed["a"].error_msg) == 1000 and not failed["b"].taken


def library(spark, rows, mentions_rows):
    c = spark.createDataFrame([(f"{d}_c{i}", i, t, p, s, d, "text", "") for i, (t, p, s, d) in enumerate(rows)], "chunk_id string, chunk_no int, text string, page int, source_file string, document_id string, type string, image_path string")
    v = vector.dense(vector.hashed_counts(c, "chunk_id"), "chunk_id")
    return ask.Library(c, v, lexical.build(c), graph.Graph.of(mentions(spark, mentions_rows)))


QUESTIONS = "query_id bigint, text string, mode string, document_id string, source_file string"


def test_modes_and_filters(spark):
    rows = [("пласт бс10 нефть", 1, "A", "d1"), ("нефть и газ", 2, "A", "d1"), ("вода и песок", 1, "B", "d2"), ("пласт бс10 нефть", 3, "B", "d2"), ("водонефтяной контакт", 4, "B", "d2")]
    lib = library(spark, rows, [("пласт", "БС10", "ПЛАСТ_БС10", "A", 1, "d1_c0", 0)])
    asked = [(1, "нефть", "rag", None, None), (2, "нефть", "hybrid", "d2", "A"), (3, "Что за пласт БС10?", "graphrag", None, None), (4, "нефть и вода", "graphrag", None, None), (5, "  ", "rag", None, None), (6, "вода", "нет такого", None, "B"), (7, "ВНК", "hybrid", None, None), (8, "пласт БС10", "graphrag", None, "нет")]
    hits = ask.retrieve_by_mode(lib, spark.createDataFrame(asked, QUESTIONS), 3).collect()
    of = lambda q: [h for h in sorted(hits, key=lambda h: h.rank) if h.query_id == q]
    assert not of(5) and {h.via for h in of(1)} == {"vector"}
    assert {h.chunk_id[:2] for h in of(2)} == {"d2"}  # the document's filter goes before the source's
    assert "graph" in {h.via for h in of(3)} and len({h.chunk_id for h in of(3)}) == len(of(3))
    assert {h.via for h in of(4)} == {"fused"} and of(6)[0].mode == "hybrid" and {h.chunk_id[:2] for h in of(6)} == {"d2"}
    assert of(7)[0].chunk_id == "d2_c4"  # found by the expansion of the abbreviation
    assert of(8)  # no hit passes the filter, so all stay
    said = {r.query_id: r for r in ask.answers(lib, spark.createDataFrame([*asked, (9, "щщщ", "rag", "никакой", None)], QUESTIONS), ask.retrieve_by_mode(lib, spark.createDataFrame(asked, QUESTIONS), 3)).collect()}
    assert said[9].answer == ask.NOTHING_FOUND and said[9].chunks == 0 and 5 not in said and "[d1:1]" in said[3].answer
    nothing = library(spark, rows[:1], [("пласт", "БС10", "X", "A", 1, "c", 0)])
    nothing.chunks = nothing.chunks.limit(0)
    assert {r.answer for r in ask.answers(nothing, spark.createDataFrame(asked[:1], QUESTIONS), ask.retrieve_by_mode(lib, spark.createDataFrame(asked[:1], QUESTIONS)).limit(0)).collect()} == {ask.NOT_INDEXED}
    t = {r.query_id: r for r in ask.trace(lib, spark.createDataFrame(asked, QUESTIONS).select("query_id", "text"), 3).collect()}
    assert t[3].terms == "БС10" and t[3].pages == "A:1" and t[3].chunks_from_graph >= 1 and t[4].chunks_from_graph == 0


def test_citations_meet_their_first_chunk(spark):
    lib = library(spark, [("раз", 1, "A", "abcdef01"), ("два", 1, "A", "abcdef01"), ("три", None, "A", "abcdef02")], [("пласт", "БС10", "X", "A", 1, "c", 0)])
    answered = spark.createDataFrame([(1, "[abcdef01:1] и [abcdef01:1], [abcdef09:4]")], "query_id bigint, answer string")
    hits = spark.createDataFrame([(1, "abcdef01_c1", 1), (1, "abcdef01_c0", 2), (1, "abcdef02_c2", 3)], "query_id bigint, chunk_id string, rank int")
    got = {(r.document_id, r.page, r.chunk_id) for r in ask.cited_chunks(lib, answered, hits).collect()}
    assert got == {("abcdef01", 1, "abcdef01_c1"), ("abcdef09", 4, None)}


def test_graph_saved_and_read(spark, tmp_path):
    c = spark.createDataFrame([("c0", "Пласт БС10 и Мегионская свита", "f", 1), ("c1", "пласт БС10.", "g", 2), ("c2", None, "g", 3)], "chunk_id string, text string, source_file string, page int")
    g = graph.rebuild(c, str(tmp_path / "g"))
    assert {(r.canonical, r.sources, r.pages) for r in g.nodes.collect()} == {("ПЛАСТ_БС10", 2, 2), ("СВИТА_МЕГИОНСКАЯ", 1, 1)}
    assert [(r.src, r.dst, r.relation, r.weight) for r in g.edges.collect()] == [("ПЛАСТ_БС10", "СВИТА_МЕГИОНСКАЯ", "co-occurrence", 1)]
    assert g.to_json().count() == 3
    seen = graph.neighbourhood_summary(g, spark.createDataFrame([("бс10",)], "term string")).collect()[0]
    assert tuple(seen) == (1, 1, 2, 1, 2)
    none = graph.neighbourhood_summary(g, spark.createDataFrame([("нет",)], "term string")).collect()[0]
    assert (none.seeds, none.hop1_count, none.nodes) == (0, 2, 2)


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as k")
    got = [(r.k, r.id) for r in runtime.numbered(df.repartition(5), [F.desc("k"), F.col("id")], "n").orderBy("place").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1]))
    assert {r.place for r in runtime.numbered(df, [F.col("id")], "n").collect()} == set(range(1, 1001))


def test_kept_tables_are_made_anew(spark):
    import shutil

    made = []

    def make():
        made.append(1)
        return runtime.stage(spark.range(3), "kept-test")

    assert runtime.kept(spark, ("kept-test",), make).count() == runtime.kept(spark, ("kept-test",), make).count() == 3 and len(made) == 1
    shutil.rmtree(runtime.staged_dir(spark).removeprefix("file://"))
    assert runtime.kept(spark, ("kept-test",), make).count() == 3 and len(made) == 2
    runtime.clear_staged(spark)
    assert runtime.kept(spark, ("kept-test",), make).count() == 3 and len(made) == 3


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            class Nothing:
                @staticmethod
                def isDefined():
                    return False

            return Nothing

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_reading_asking_and_judging_in_plans(spark):
    pages = spark.createDataFrame([("d", 1, "a.jpg"), ("d", 2, "b.jpg"), ("e", 1, "b.jpg"), ("e", 2, ""), ("e", 3, "none.jpg")], "document_id string, page int, image_path string")
    cache = spark.createDataFrame([("a.jpg", "из кэша")], "image_path string, text string")
    read, full = providers.read_pages(pages, cache, providers.LookupOcr({"b.jpg": "прочитано"}), pause=0.0)
    assert {(r.document_id, r.page, r.raw_text) for r in read.collect()} == {("d", 1, "из кэша"), ("d", 2, "прочитано"), ("e", 1, "прочитано"), ("e", 2, ""), ("e", 3, "")}
    assert {r.image_path for r in full.collect()} == {"a.jpg", "b.jpg"}
    q = spark.createDataFrame([(1, "что?", "вода в песке")], "query_id bigint, text string, context string")
    answered = q.join(providers.chat(q, providers.OfflineChat()), "query_id")
    raw = providers.judged(answered, providers.OverlapJudge())
    got = raw.select(tx.verdict(F.col("raw")).alias("v")).select("v.*").collect()[0]
    assert "вода в песке" in answered.collect()[0].answer and got.accuracy is not None
    waited = []
    gate = providers.Throttle(2.0, clock=lambda: 10.0, sleep=waited.append)
    gate.wait()
    gate.wait()
    assert waited == [2.0]


def test_docx_and_broken(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>абзац</w:t></w:r></w:p></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    assert files.docx_text(buf.getvalue()) == "абзац\nx | y"
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.doc").write_bytes(b"old")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error is None) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("абзац\nx | y", True) and not got["b.docx"][1] and not got["c.doc"][1]


def test_providers():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert providers.with_retries(flaky, sleep=lambda _: None) == "ok"
    assert providers.with_retries(lambda: 1 / 0, attempts=2, sleep=lambda _: None) == ""
    assert "ТОЧНОСТЬ: 5" in providers.OverlapJudge().judge("q", "вода", "вода")


def test_files_to_collection(spark, tmp_path):
    from corpusq.plans.ingest import ingest_files

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    with zipfile.ZipFile(folder / "book.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>{"слово " * 500}</w:t></w:r></w:p></w:body></w:document>')
    (folder / "broken.docx").write_bytes(b"nothing")
    got = {r.document_id: r for r in ingest_files(spark, str(folder), target).collect()}
    assert (got["book"].status, got["book"].doc_type, got["book"].text_chunks, got["book"].total_pages) == ("indexed", "docx", 2, 2)
    assert got["broken"].status == "error" and got["broken"].text_chunks == 0
    rows = store.read_documents(spark, target).collect()
    assert {r.chunk_id for r in rows} == {"book_c0", "book_c1"} and all(len(r.embedding) == vector.DIM for r in rows)


def test_keep_matching_or_all(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "g string, v int")
    assert {tuple(r) for r in retrieve.keep_matching_or_all(df, F.col("v") == 1, "g").collect()} == {("a", 1), ("b", 2)}


def exchanged(spark, name, folder):
    """Bytes that a query exchanges, with the collection made anew, and the bytes of the chunks."""
    import os

    import __spark_entry__

    runtime.clear_staged(spark)
    store_ = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store_.executorSummary("driver").totalShuffleWrite()
    __spark_entry__.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return store_.executorSummary("driver").totalShuffleWrite() - before, os.path.getsize(f"{folder}/chunks.parquet")


@pytest.mark.parametrize("name", ["bm25_topk"])
def test_questions_exchange_little(spark, name):
    """Neither postings, texts nor scores of all chunks are exchanged."""
    moved, size = exchanged(spark, name, "/root/testdata/sf0.01")
    assert moved < 2 * size, (moved, size)


@pytest.mark.parametrize("limit", [10**6, 1])
def test_blocks_of_the_index(spark, monkeypatch, limit):
    """Whatever the size of blocks, and whether questions' terms are sent or joined; a null text counts as a chunk, a null id is no hit."""
    texts = [(f"c{i:02}", f"нефть {'газ ' * (i % 4)} слово{i % 5}") for i in range(40)] + [("e", ""), ("n", None)]
    c = spark.createDataFrame(texts, "chunk_id string, text string").repartition(2)
    q = spark.createDataFrame([(1, "газ газ слово3"), (2, "слово1 нет"), (3, "нет"), (4, "газ")], "query_id bigint, text string")
    where = spark.createDataFrame([(4, f"c{i:02}") for i in (0, 1, 5, 38)], "query_id bigint, chunk_id string")
    whole = {tuple(r) for r in lexical.search(lexical.build(c), q, 5, where).collect()}
    assert {r[0] for r in whole} == {1, 2, 4} and {r[1] for r in whole if r[0] == 4} == {"c01", "c05", "c38"}
    monkeypatch.setattr(lexical, "QUESTION_TERMS", limit)
    index = lexical.build(c, block_chunks=3)
    assert index.corpus.collect()[0].n == 42 and index.blocks.filter("term is null").count() >= 14
    assert {tuple(r) for r in lexical.search(index, q, 5, where).collect()} == whole
    null = lexical.build(spark.createDataFrame([(None, "газ"), ("a", "газ"), ("b", "нефть"), ("d", "вода"), ("f", "песок")], "chunk_id string, text string"))
    assert [r.chunk_id for r in lexical.search(null, q.filter("query_id = 4"), 5).collect()] == ["a"]


def test_once_keeps_each_row_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "id int, text string")
    for limit in (10, 1):
        monkeypatch.setattr(runtime, "REPEATED_ROWS", limit)
        assert sorted(map(tuple, runtime.once(df, "test-once").collect()), key=str) == [(1, "a"), (2, None), (3, "b")]
