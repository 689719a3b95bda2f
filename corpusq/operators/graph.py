"""Entity extraction and the co-occurrence graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, canonical_id, is_verb, stem6, terms_match, valid_entity_name
from ..runtime import stage

_S = SPACES
#: Entity patterns by type, in order. A word's beginning is spelled out, as \b is ASCII in some engines.
PATTERNS: list[tuple[str, str]] = [
    ("скважина", f"скважин[аыею]{_S}*(?:№|#|N°?)?{_S}*([0-9]+[а-яА-ЯёЁ]?)"),
    ("скважина", f"(?:^|[^0-9A-Za-zА-Яа-яЁё_])скв\\.?{_S}*(?:№|#)?{_S}*([0-9]+[а-яА-ЯёЁ]?)"),
    ("пласт", f"пласт[аыею]?{_S}+([А-ЯЁа-яёA-Za-z][А-ЯЁа-яёA-Za-z0-9\\-\\.]{{1,20}})"),
    ("горизонт", f"горизонт[аыею]?{_S}+([А-ЯЁа-яёA-Za-z][А-ЯЁа-яёA-Za-z0-9\\-\\.]{{1,20}})"),
    ("свита", f"([А-ЯЁ][а-яё]{{3,}}(?:ск|овск|евск)(?:ая|ой|ую|ом)){_S}+свит"),
    ("свита", f"свит[аыу]{_S}+([А-ЯЁ][а-яё]{{3,}})"),
    ("месторождение", f"([А-ЯЁ][а-яё]{{3,}}(?:ск|овск|евск)(?:ое|ого|ому)?){_S}+месторожден"),
    ("месторождение", f"месторожден[ияе]{_S}+([А-ЯЁ][а-яё]{{3,}})"),
    ("формация", f"([А-ЯЁ][а-яё]{{3,}}(?:ск|овск|евск)(?:ая|ой)){_S}+форма[цc]и"),
]


#: A capitalised word of four letters or more, and the letter or digit right after it, which it may not have.
CAPITALISED = "(?:^|[^0-9A-Za-zА-Яа-яЁё_])([А-ЯЁ][а-яё]{3,})([0-9A-Za-zА-Яа-яЁё_]?)"


def extract_entities(texts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with type, name, canonical, ord for each entity of ``text``; per text each (type, NAME) once,
    the first by pattern and position. ``keep`` must identify the text."""
    found = F.array(*(F.regexp_extract_all("text", F.lit(f"(?iu){p}"), F.lit(1)) for _, p in PATTERNS))
    kinds = F.array(*(F.lit(t) for t, _ in PATTERNS))
    each = texts.select(*keep, F.posexplode(found).alias("p", "names")).select(*keep, "p", F.posexplode("names").alias("i", "name"))
    kind = kinds[F.col("p")]
    named = each.select(*keep, kind.alias("type"), F.trim("name").alias("name"), "p", "i")
    valid = named.filter(valid_entity_name(F.col("name"), F.col("type")))
    first = valid.groupBy(*keep, "type", F.upper("name").alias("_u")).agg(F.min(F.struct("p", "i", "name")).alias("x"))
    return first.select(*keep, "type", "x.name", canonical_id(F.col("type"), F.col("x.name")).alias("canonical"), (F.col("x.p") * 1_000_000 + F.col("x.i")).cast("bigint").alias("ord"))


def page_entities(mentions: DataFrame) -> DataFrame:
    """Distinct canonical per (source_file, page), in order of first mention."""
    return mentions.groupBy("source_file", "page", "canonical").agg(F.min(F.struct("chunk_id", "pos")).alias("x")).select("source_file", "page", "canonical", "x.chunk_id", "x.pos")


def locations(mentions: DataFrame) -> DataFrame:
    """Distinct (canonical, source_file, page): where each node is, one row a place, however many there are."""
    return mentions.filter("canonical is not null").select("canonical", "source_file", "page").distinct()


def nodes(mentions: DataFrame) -> DataFrame:
    """canonical, type and name of the first mention, and the numbers of distinct sources and pages (see ``locations``)."""
    first = F.struct("source_file", "page", "chunk_id", "pos", "name")
    named = mentions.filter("canonical is not null").groupBy("canonical").agg(F.min_by("type", first).alias("type"), F.min_by("name", first).alias("name"))
    at = locations(mentions)
    count = lambda c: at.filter(F.col(c).isNotNull()).select("canonical", c).distinct().groupBy("canonical").agg(F.count(F.lit(1)).alias(c + "s"))
    out = named.join(count("source_file").withColumnRenamed("source_files", "sources"), "canonical", "left").join(count("page"), "canonical", "left")
    return out.fillna(0, ["sources", "pages"])


@dataclass
class Graph:
    """mentions, nodes, edges and locations of a collection."""

    mentions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    locations: DataFrame

    TABLES = ("mentions", "nodes", "edges", "locations")

    @staticmethod
    def of(mentions: DataFrame) -> Graph:
        return Graph(mentions, nodes(mentions), edges(mentions), locations(mentions))

    def save(self, path: str) -> None:
        """All four tables below ``path``, which replace those that were there."""
        for t in self.TABLES:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        return Graph(*(spark.read.parquet(f"{path}/{t}") for t in Graph.TABLES))

    def to_json(self) -> DataFrame:
        """One JSON text a node or edge (a node-link export in lines)."""
        node = self.nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), F.col("canonical").alias("id"), "type", "name", "sources", "pages")).alias("json"))
        edge = self.edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "weight")).alias("json"))
        return node.unionByName(edge)


def mentions_of(chunks: DataFrame) -> DataFrame:
    """Mentions in chunks (chunk_id, text, source_file, page): pos is the order within the chunk."""
    found = extract_entities(chunks.select("chunk_id", "text", "source_file", "page"), ["chunk_id", "source_file", "page"])
    return found.select("type", "name", "canonical", "source_file", "page", "chunk_id", F.col("ord").alias("pos"))


def rebuild(chunks: DataFrame, path: str) -> Graph:
    """Extract all chunks' entities, write the graph's tables and read them back."""
    mentions = stage(mentions_of(chunks), "mentions")
    Graph.of(mentions).save(path)
    return Graph.load(chunks.sparkSession, path)


def edges(mentions: DataFrame) -> DataFrame:
    """Pairs on one (source_file, page): src < dst, weight (pages shared), distinct sources and pages, first source.

    The pair set is the edge set itself, which is the result; counts are combined map-side.
    """
    m = mentions.filter("source_file is not null and page is not null and canonical is not null").select("source_file", "page", "canonical").distinct()
    a, b = m.withColumnRenamed("canonical", "src"), m.withColumnRenamed("canonical", "dst")
    return (
        a.join(b, ["source_file", "page"])
        .filter("src < dst")
        .groupBy("src", "dst")
        .agg(
            F.count(F.lit(1)).alias("weight"),
            F.sort_array(F.collect_set("source_file")).alias("sources"),
            F.sort_array(F.collect_set("page")).alias("pages"),
            F.min("source_file").alias("first_source"),
        )
        .withColumn("relation", F.lit("co-occurrence"))
    )


def both_ways(edge: DataFrame) -> DataFrame:
    e = edge.select("src", "dst", "weight")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edge: DataFrame) -> DataFrame:
    return both_ways(edge).groupBy(F.col("src").alias("canonical")).agg(F.count(F.lit(1)).alias("degree"))


def matching(node: DataFrame, terms: DataFrame) -> DataFrame:
    """Nodes whose name matches any term. Terms come from one query, so they're few; Spark broadcasts them."""
    return node.join(terms, terms_match(F.col("term"), F.col("name")), "left_semi")


def induced(edge: DataFrame, kept: DataFrame) -> DataFrame:
    return edge.join(kept.select(F.col("canonical").alias("src")), "src", "left_semi").join(kept.select(F.col("canonical").alias("dst")), "dst", "left_semi")


def neighbourhood(node: DataFrame, edge: DataFrame, terms: DataFrame, each: int = 8, most: int = 30) -> DataFrame:
    """canonical, hop1: matching nodes and their ``each`` strongest neighbours, at most ``most``, seeds first;
    without a match the ``most`` nodes of highest degree."""
    seeds = matching(node, terms).select("canonical")
    near = _hop(seeds, edge, each)
    found = seeds.withColumn("hop1", F.lit(False)).unionByName(near).orderBy("hop1", "canonical").limit(most)
    top = degrees(edge).orderBy(F.desc("degree"), "canonical").limit(most).select("canonical", F.lit(True).alias("hop1"))
    none = seeds.agg((F.count(F.lit(1)) == 0).alias("none"))
    return found.unionByName(top.join(F.broadcast(none)).filter("none").drop("none"))


def _hop(seeds: DataFrame, edge: DataFrame, each: int) -> DataFrame:
    """The ``each`` strongest neighbours of each seed that are no seeds."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    near = both_ways(edge).join(seeds.select(F.col("canonical").alias("src")), "src", "left_semi").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= each)
    return near.select(F.col("dst").alias("canonical")).distinct().join(seeds, "canonical", "left_anti").withColumn("hop1", F.lit(True))


def neighbourhood_edges(near: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges between the nodes of a ``neighbourhood``, and whether a seed is at one end."""
    seeds = near.filter(~F.col("hop1")).select("canonical", F.lit(True).alias("is_seed"))
    end = lambda c: seeds.select(F.col("canonical").alias(c), F.col("is_seed").alias("seed_" + c))
    out = induced(edge, near).join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    return out.select("src", "dst", "relation", "weight", F.coalesce("seed_src", "seed_dst", F.lit(False)).alias("is_seed_edge"))


def neighbourhood_summary(graph: Graph, terms: DataFrame, each: int = 8, most: int = 30) -> DataFrame:
    """One row: seeds, hop1_count (before the cap; the shown nodes where nothing matches), nodes, edges, pages of the seeds."""
    seeds = stage(matching(graph.nodes, terms).select("canonical"), "seeds")
    near = stage(neighbourhood(graph.nodes, graph.edges, terms, each, most), "near")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [n(seeds, "seeds"), n(_hop(seeds, graph.edges, each), "hop"), n(near, "nodes"), n(induced(graph.edges, near), "edges"), n(pages_of(graph.locations, seeds), "pages")]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(F.broadcast(x))  # single rows
    return out.select("seeds", F.when(F.col("seeds") > 0, F.col("hop")).otherwise(F.col("nodes")).alias("hop1_count"), "nodes", "edges", "pages")


def pages_of(mentions: DataFrame, matched: DataFrame, cross: bool = False) -> DataFrame:
    """(source_file, page) of the matched nodes' mentions or locations; ``cross``: each of a node's sources with each of its pages."""
    at = mentions.join(matched.select("canonical"), "canonical", "left_semi")
    if not cross:
        return at.filter("page is not null").select("source_file", "page").distinct()
    sources = at.filter("source_file is not null").select("canonical", "source_file").distinct()
    return sources.join(at.filter("page is not null").select("canonical", "page").distinct(), "canonical").select("source_file", "page").distinct()


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: entities named in the query, then capitalised words whose stem isn't there yet."""
    ents = extract_entities(queries, ["query_id"]).filter(~is_verb(F.col("name")) & (F.length("name") > 2)).select("query_id", F.col("name").alias("term"), F.col("ord"))
    got = lambda k: F.regexp_extract_all("text", F.lit(CAPITALISED), F.lit(k))
    each = queries.select("query_id", F.posexplode(F.arrays_zip(got(1).alias("term"), got(2).alias("then"))).alias("ord", "x"))
    c = each.select("query_id", "ord", "x.term", "x.then").filter((F.col("then") == "") & ~is_verb(F.col("term")))
    first = c.withColumn("r", F.row_number().over(Window.partitionBy("query_id", stem6(F.col("term"))).orderBy("ord"))).filter("r = 1")
    known = ents.select("query_id", stem6(F.col("term")).alias("stem"))
    extra = first.withColumn("stem", stem6(F.col("term"))).join(known, ["query_id", "stem"], "left_anti")
    return ents.select("query_id", "term").unionByName(extra.select("query_id", "term"))


