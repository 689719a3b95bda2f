"""Scalar text operators as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .abbreviations import ABBREVIATIONS

#: Unicode White_Space, spelled out.
SPACES = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Fixed values.
TOKEN = "[а-яёa-z0-9]+"
CITATION = "\\[[0-9a-f-]{8,}:[0-9]+\\]"
VERB_ENDINGS = ("ться", "тся", "ются", "ется", "ваться", "иться", "аться", "ывать", "ивать", "овать")
#: Fixed values.
STOP_NAMES = (
    "не", "на", "по", "при", "до", "из", "без", "над", "под", "про",
    "как", "так", "или", "что", "где", "все", "это", "тот", "те", "таких",
    "такой", "такие", "такое", "самой", "самого", "чаще", "реже", "часто", "редко", "обычно",
    "полностью", "частично", "обнажались", "сравнительно", "последовало", "называется", "распределение", "характеризуются", "отличаются", "условными",
    "возвышается",
)
PROPER_TYPES = ("свита", "месторождение", "формация")
CODE_TYPES = ("пласт", "горизонт", "скважина")
#: What shows in a progress text that a step was done, by step.
PIPELINE_STEPS = {
    "detect": "тип:|text_pdf|scan_pdf|hybrid|docx|djvu|определен",
    "render": "ренд|render|\\[[0-9]+/",
    "direct": "прямое извлечени|direct|текстов[а-я]+ страниц",
    "vlm": "vlm|qwen|vision",
    "embed": "jina|эмбедд|embed",
    "chroma": "chroma",
    "graph": "граф|graph",
}
SECTIONS = ("ТЕКСТ", "ДИАГРАММЫ", "АББРЕВИАТУРЫ")


#: A document's sign by its status, and a node's colour by its type.
STATUS_ICONS = {"indexed": "✅", "indexing": "⏳", "error": "❌", "pending": "🕐"}
TYPE_COLORS = {"скважина": "#3b82f6", "пласт": "#22c55e", "горизонт": "#f59e0b", "свита": "#a855f7", "месторождение": "#ef4444", "формация": "#06b6d4"}
OTHER_ICON, OTHER_COLOR = "📄", "#64748b"


def _looked_up(key: Column, values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def status_icon(status: Column) -> Column:
    return _looked_up(status, STATUS_ICONS, OTHER_ICON)


def type_color(kind: Column) -> Column:
    return _looked_up(kind, TYPE_COLORS, OTHER_COLOR)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def tokenize(text: Column) -> Column:
    """Lower-case runs of Russian and English letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "(\\.[^.\\\\/]+)$", 1))


def accepted_extension(name: Column) -> Column:
    return extension(name).isin(".pdf", ".docx", ".doc", ".djvu")


def basename(path: Column) -> Column:
    """What follows the last slash or backslash; null for null or empty paths."""
    return F.when(F.length(path) > 0, F.regexp_extract(path, "([^\\\\/]+)$", 1))


def short_name(name: Column, most: int = 40) -> Column:
    stem = F.regexp_replace(name, "\\.[^.\\\\/]+$", "")
    return F.when(F.length(stem) > most, F.concat(F.substring(stem, 1, most), F.lit("…"))).otherwise(stem)


def is_verb(word: Column) -> Column:
    return F.lower(word).rlike("(" + "|".join(VERB_ENDINGS) + ")$")


def stem6(word: Column) -> Column:
    return F.substring(F.lower(word), 1, 6)


def terms_match(term: Column, label: Column) -> Column:
    """One holds the other, or both have five letters or more and equal first six."""
    t, n = F.lower(term), F.lower(label)
    prefix = (F.least(F.length(t), F.length(n)) >= 5) & (F.substring(t, 1, 6) == F.substring(n, 1, 6))
    return F.contains(n, t) | F.contains(t, n) | prefix


def valid_entity_name(name: Column, kind: Column) -> Column:
    low = F.lower(name)
    first = F.substring(name, 1, 1)
    upper_first = (first == F.upper(first)) & (first != F.lower(first))
    all_lower = (name == low) & (low != F.upper(name))
    return (
        F.length(name).between(2, 60)
        & ~low.isin(*STOP_NAMES)
        & ~is_verb(name)
        & (~kind.isin(*PROPER_TYPES) | upper_first)
        & (~kind.isin(*CODE_TYPES) | (~(all_lower & (F.length(name) < 4)) & name.rlike("[А-ЯЁа-яёA-Za-z]")))
    )


def canonical_id(kind: Column, name: Column, strip_end: bool = True) -> Column:
    """TYPE_NAME. By default a name's trailing dots and dashes are left off, so that one thing has one node."""
    n = F.regexp_replace(name, "[.\\-]+$", "") if strip_end else name
    return F.concat(F.upper(kind), F.lit("_"), F.regexp_replace(F.upper(n), "[^А-ЯЁA-Z0-9]", "_"))


def count_citations(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CITATION))


def citations(text: Column) -> Column:
    """Array of (document_id, page)."""
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    part = lambda c: F.split(F.regexp_replace(c, "[\\[\\]]", ""), ":")
    return F.transform(found, lambda c: F.struct(part(c)[0].alias("document_id"), part(c)[1].cast("int").alias("page")))


def expand_abbreviations(text: Column, as_written: bool = False) -> Column:
    """The first occurrence of each abbreviation, if no letter stands beside it, gets its expansion in brackets.

    By default longer abbreviations go first and digits bound like letters, so K1 isn't read as K;
    ``as_written`` keeps the dictionary's order and lets digits stand beside. Each output feeds the next step.
    """
    order = list(ABBREVIATIONS) if as_written else sorted(ABBREVIATIONS, key=lambda a: (-len(a), list(ABBREVIATIONS).index(a)))
    beside = "А-ЯЁA-Zа-яёa-z" if as_written else "А-ЯЁA-Zа-яёa-z0-9"
    entries = F.array(
        *(F.struct(F.lit(f"(?<![{beside}]){a}(?![{beside}])").alias("p"), F.lit(f"{a} ({ABBREVIATIONS[a]})").alias("full"), F.lit(len(a)).alias("n")) for a in order)
    )

    def step(s: Column, e: Column) -> Column:
        at = F.regexp_instr(s, e["p"])
        return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at - 1), e["full"], F.substr(s, at + e["n"]))).otherwise(s)

    return F.reduce(entries, text, step)


def ocr_sections(raw: Column) -> Column:
    """A recogniser's three-part answer as one text; an answer without the TEXT header stays as it is.

    Lines belong to the last header above them, repeated headers go on, lines before any are dropped.
    """
    step = lambda s, line: F.when(line.contains("=== ТЕКСТ ==="), F.lit(1)).when(line.contains("=== ДИАГРАММЫ ==="), F.lit(2)).when(
        line.contains("=== АББРЕВИАТУРЫ ==="), F.lit(3)
    )
    start = F.struct(F.lit(0).alias("at"), *(F.array().cast("array<string>").alias(f"s{k}") for k in (1, 2, 3)))

    def fold(s: Column, line: Column) -> Column:
        new = step(s, line)
        put = lambda k: F.when(new.isNull() & (s["at"] == k), F.concat(s[f"s{k}"], F.array(line))).otherwise(s[f"s{k}"])
        return F.struct(F.coalesce(new, s["at"]).alias("at"), *(put(k).alias(f"s{k}") for k in (1, 2, 3)))

    def join(s: Column) -> Column:
        clean = lambda k: F.regexp_replace(F.array_join(s[f"s{k}"], "\n"), f"^{SPACES}+|{SPACES}+$", "")
        body, diagrams, short = clean(1), clean(2), clean(3)
        parts = F.array(
            body,
            F.when((diagrams != "") & ~F.contains(F.substring(F.lower(diagrams), 1, 60), F.lit("отсутствуют")), F.concat(F.lit("Визуальные элементы страницы:\n"), diagrams)).otherwise(""),
            F.when((short != "") & (F.lower(short) != "нет"), F.concat(F.lit("Аббревиатуры:\n"), short)).otherwise(""),
        )
        return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")

    return F.when(raw.contains("=== ТЕКСТ ==="), F.reduce(F.split(raw, "\r?\n"), start, fold, join)).otherwise(raw)


def pipeline_steps(progress: Column) -> Column:
    """Sorted keys of the steps that a progress text shows; an empty array for null."""
    text = F.coalesce(progress, F.lit(""))
    keys = [F.when(text.rlike(f"(?iu)({p})"), F.lit(k)) for k, p in sorted(PIPELINE_STEPS.items())]
    return F.array_compact(F.array(*keys))


def doc_type_badge(progress: Column) -> Column:
    low = F.lower(progress)
    named = F.regexp_extract(low, "тип[=:]?\\s*(text_pdf|scan_pdf|hybrid_pdf|docx|doc|djvu)", 1)
    bare = F.regexp_extract(low, "(text_pdf|scan_pdf|hybrid_pdf)", 1)
    return F.when(named != "", named).when(bare != "", bare).otherwise("")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def verdict(raw: Column) -> Column:
    """A judge's reply as a struct; of repeated fields the last line counts, unset grades count as 3 in the score."""
    last = lambda name: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(raw, F.lit(f"(?m)^[ \\t]*{name}:(.*)$"), F.lit(1))), -1)
    digit = lambda name: F.element_at(
        F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(raw, F.lit(f"(?m)^[ \\t]*{name}:[ \\t]*([0-9])"), F.lit(1))), -1
    ).cast("int")
    accuracy, completeness = digit("ТОЧНОСТЬ"), digit("ПОЛНОТА")
    return F.struct(
        accuracy.alias("accuracy"),
        completeness.alias("completeness"),
        F.contains(F.lower(last("ГАЛЛЮЦИНАЦИИ")), F.lit("есть")).alias("hallucinations"),
        F.trim(last("ИТОГ")).alias("verdict"),
        F.coalesce(F.trim(last("КОММЕНТАРИЙ")), F.lit("")).alias("comment"),
        F.round((F.coalesce(accuracy, F.lit(3)) + F.coalesce(completeness, F.lit(3))) / 2, 1).alias("score"),
    )


def normalise_mode(mode: Column) -> Column:
    return F.when(mode.isin("rag", "hybrid", "graphrag"), mode).otherwise("hybrid")


def fallback_terms(query: Column) -> Column:
    return F.slice(words(query), 1, 3)
