"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Query, table
from .cooccur import co_occurrences
from .langid import Languages
from .leak import leaked_items
from .lines import repeated_lines, without_repeated_lines
from .mix import Mixture
from .neardup import NearDuplicates
from .scan_noise import ScanRepair
from .split import split_oversized


def _text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("type = 'text'")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ScanRepair(table(spark, d, "chunks")).found()


def p1_repair(spark: SparkSession, d: str) -> DataFrame:
    return ScanRepair(table(spark, d, "chunks")).texts()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks")).select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(_text_chunks(spark, d)).select("chunk_id", "line_no").distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_repeated_lines(_text_chunks(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(_text_chunks(spark, d)).chunk_pairs()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(_text_chunks(spark, d)).groups()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # five shared pages at three times chance have a ratio of 4.3 at least, so 3.84 (5 %) takes none away
    return co_occurrences(table(spark, d, "entities"), 5, 0.003, 3.0, min_llr=3.84).select("item_a", "item_b")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = co_occurrences(table(spark, d, "entities"), 2)
    return out.withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 4)})


def p5_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    # every pair, those of one shared page included; p5_pairs keeps its threshold
    out = co_occurrences(table(spark, d, "entities"))
    return out.withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 4)})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).plan


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def p7_budget_mix(spark: SparkSession, d: str) -> DataFrame:
    # twice the tokens that the sources hold: some targets pass a source's limit, so the exponent is bisected
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), budget=2.0, relative=True).plan


def p7_budget_shares(spark: SparkSession, d: str) -> DataFrame:
    mix = Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), budget=2.0, relative=True)
    return mix.shares.withColumn("exponent", F.lit(mix.exponent))


def p7_entropy_shares(spark: SparkSession, d: str) -> DataFrame:
    mix = Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), entropy=0.97)
    return mix.shares.withColumn("exponent", F.lit(mix.exponent))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares.select("source", "target_share", "max_repeats", "source_texts")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return Languages(table(spark, d, "documents")).mislabelled()


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return Languages(table(spark, d, "documents")).segments


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return Languages(table(spark, d, "documents")).documents()


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_repair, p2_found, p2_pieces, p3_found, p3_clean, p4_found, p4_groups, p5_found, p5_pairs, p5_all_pairs, p6_found, p7_mix, p7_shares, p7_budget_mix, p7_budget_shares, p7_entropy_shares, p7_texts, p8_found, p8_segments, p8_documents)}
_SPACE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_ITEMS = f"""i AS (SELECT DISTINCT source_file, page, trim(type) || ':' || n AS item FROM (SELECT *, regexp_replace(regexp_replace(translate(regexp_replace(upper(name), '[\\x{{2010}}-\\x{{2015}}\\x{{2212}}\\x{{ad}}\\x{{fe58}}\\x{{fe63}}\\x{{ff0d}}]', '-', 'g'), 'ABEKMHOPCTXY', 'АВЕКМНОРСТХУ'), '^[{_SPACE}]+', ''), '[{_SPACE}\\pP\\pS]+$', '') AS n FROM entities) WHERE source_file IS NOT NULL AND page IS NOT NULL AND n <> ''),
t AS (SELECT count(DISTINCT (source_file, page)) AS n FROM i), f AS (SELECT item, count(*) AS pages FROM i GROUP BY 1),
pr AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS shared FROM i a JOIN i b USING (source_file, page) WHERE a.item < b.item GROUP BY ALL),
pc AS (SELECT item_a, item_b, shared, fa.pages AS pages_a, fb.pages AS pages_b, t.n AS pages FROM pr JOIN f fa ON fa.item = item_a JOIN f fb ON fb.item = item_b, t)"""
_X = "CASE WHEN {0} > 0 THEN {0} * ln(({0})::DOUBLE) ELSE 0 END"
_LLR = "2 * (" + " + ".join(_X.format(f"({c})") for c in ("shared", "pages_a - shared", "pages_b - shared", "pages - pages_a - pages_b + shared", "pages")) + " - " + " - ".join(_X.format(f"({c})") for c in ("pages_a", "pages - pages_a", "pages_b", "pages - pages_b")) + ")"

_NEAR = f"""c AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[а-яёa-z0-9]+') AS t FROM chunks WHERE type = 'text' AND len(regexp_extract_all(text, '[^{_SPACE}]+')) >= 20),
s AS (SELECT DISTINCT chunk_id, hash(t[k] || ' ' || t[k + 1] || ' ' || t[k + 2]) AS h FROM (SELECT chunk_id, t, unnest(range(1, len(t) - 1)) AS k FROM c)), n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS o FROM s a JOIN s b USING (h) WHERE a.chunk_id < b.chunk_id GROUP BY ALL),
near AS (SELECT chunk_a, chunk_b, o = x.n AND o = y.n AS same FROM o JOIN n x ON x.chunk_id = chunk_a JOIN n y ON y.chunk_id = chunk_b WHERE o >= 0.7 * (x.n + y.n - o))"""

SQL: dict[str, str] = {
    # levenshtein counts bytes, so Cyrillic letters become single ones
    "p3_found": """WITH t AS (SELECT DISTINCT chunk_id, source_file, text FROM chunks WHERE type = 'text' AND chunk_id IS NOT NULL AND source_file IS NOT NULL AND text IS NOT NULL),
l AS (SELECT source_file, chunk_id, line_no, regexp_replace(lower(x), '[^\\pL]', '', 'g') AS k FROM (SELECT source_file, chunk_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM t)),
z AS (SELECT source_file, greatest(5.0::DOUBLE, 0.1::DOUBLE * count(DISTINCT chunk_id)) AS need FROM t GROUP BY 1),
o AS (SELECT DISTINCT source_file, k, chunk_id FROM l WHERE k <> ''), s AS (SELECT source_file, k, length(k) AS n, translate(k, 'абвгдежзийклмнопрстуфхцчшщъыьэюяё', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456') AS e, count(*) AS c FROM o GROUP BY ALL),
q AS (SELECT s.* FROM s JOIN z USING (source_file) WHERE c > 1 AND c >= 0.125 * need AND n >= 18),
r AS (SELECT a.source_file, a.k, b.k AS other FROM q a JOIN q b ON a.source_file = b.source_file AND (b.c > a.c OR (b.c = a.c AND b.k < a.k)) AND greatest(a.n, b.n) >= 20 AND abs(a.n - b.n) <= 2 WHERE levenshtein(a.e, b.e) <= 2),
ab AS (SELECT DISTINCT source_file, k FROM r WHERE (source_file, other) NOT IN (SELECT source_file, k FROM r)),
tm AS (SELECT * FROM q WHERE (source_file, k) NOT IN (SELECT source_file, k FROM ab)),
p AS (SELECT tm.source_file, tm.k AS template, s.k FROM tm JOIN s ON s.source_file = tm.source_file AND abs(s.n - tm.n) <= 2 WHERE s.k = tm.k OR (greatest(s.n, tm.n) >= 20 AND s.n >= 18 AND levenshtein(s.e, tm.e) <= 2)
UNION ALL SELECT source_file, k, k FROM s JOIN z USING (source_file) WHERE n < 18 AND c >= need),
u AS (SELECT p.source_file, template FROM p JOIN o ON o.source_file = p.source_file AND o.k = p.k JOIN z ON z.source_file = p.source_file GROUP BY p.source_file, template, need HAVING count(DISTINCT chunk_id) >= need)
SELECT DISTINCT chunk_id, line_no FROM l JOIN p ON p.source_file = l.source_file AND p.k = l.k JOIN u ON u.source_file = p.source_file AND u.template = p.template""",
    "p7_texts": """WITH t AS (SELECT regexp_replace(lower(trim(source)), '[_\\s]+', '-', 'g') AS source, target_share, max_repeats FROM mix_targets),
o AS (SELECT text, min({'r': max_repeats, 's': t.source}) AS x FROM documents d JOIN t ON t.source = regexp_replace(lower(trim(d.source)), '[_\\s]+', '-', 'g') WHERE doc_id IS NOT NULL AND text <> '' GROUP BY 1),
n AS (SELECT x.s AS source, count(*) AS n FROM o GROUP BY 1)
SELECT source, target_share, max_repeats, coalesce(n, 0)::BIGINT AS source_texts FROM t LEFT JOIN n USING (source)""",
    "p2_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE len(regexp_extract_all(text, '[^{_SPACE}]+')) > 400",
    "p4_found": f"WITH {_NEAR} SELECT chunk_a, chunk_b FROM near",
    "p4_groups": f"""WITH RECURSIVE {_NEAR}, e AS (SELECT chunk_a AS a, chunk_b AS b, same FROM near UNION ALL SELECT chunk_b, chunk_a, same FROM near),
cl AS (SELECT chunk_id, least(chunk_id, coalesce(min(b), chunk_id)) AS class_id FROM n LEFT JOIN e ON a = chunk_id AND same GROUP BY 1),
r(id, g) AS (SELECT chunk_id, chunk_id FROM n UNION SELECT e.b, r.g FROM r JOIN e ON r.id = e.a), gr AS (SELECT id, min(g) AS group_id FROM r GROUP BY 1),
l AS (SELECT a, count(DISTINCT class_id) AS links FROM e JOIN cl ON chunk_id = b WHERE NOT same GROUP BY 1)
SELECT chunk_id, class_id, coalesce(links, 0)::BIGINT AS links, group_id FROM cl JOIN gr ON id = chunk_id LEFT JOIN l ON a = chunk_id""",
    "p5_found": f"WITH {_ITEMS} SELECT item_a, item_b FROM pc WHERE shared >= 5 AND shared >= 0.003::DOUBLE * pages AND shared * pages >= 3.0 * pages_a * pages_b",
    "p5_pairs": f"WITH {_ITEMS} SELECT item_a, item_b, shared, pages_a, pages_b, pages, round(shared * pages / (pages_a * pages_b)::DOUBLE, 6) AS lift, round({_LLR}, 4) AS llr FROM pc WHERE shared >= 2",
    "p5_all_pairs": f"WITH {_ITEMS} SELECT item_a, item_b, shared, pages_a, pages_b, pages, round(shared * pages / (pages_a * pages_b)::DOUBLE, 6) AS lift, round({_LLR}, 4) AS llr FROM pc",
}
