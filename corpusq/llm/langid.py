"""Problem 8: missing or wrong language labels, and texts of several languages.

Segmentation-marginalised unigrams: for each language, probabilities of the pieces of a fixed public
vocabulary; a word's probability is the sum over all its segmentations into pieces, found by the
forward algorithm. Piece probabilities are fitted by expectation maximisation on a bounded sample of
labelled rows; as labels are wrong here and there, the sample's sentences are labelled anew by the
model and it is fitted again. Sentences are then decoded by Viterbi with a price for a change of
language. Words are scored once a task, not once an occurrence.
"""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LANGUAGES = ("ru", "en", "uk", "kk", "de", "fr", "es")

#: Names that a label may have, besides the codes and what follows them after - or _.
LABEL_NAMES = {
    "ru": "rus russian русский",
    "en": "eng english английский",
    "uk": "ukr ukrainian українська украинский ua",
    "kk": "kaz kazakh қазақ қазақша казахский kz",
    "de": "ger deu german deutsch немецкий",
    "fr": "fre fra french français francais французский",
    "es": "spa spanish español espanol castellano испанский",
}
#: Romanisations (of the usual systems) and plain spellings, by language.
ROMAN = {
    "ru": dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".split())),
    "uk": dict(zip("абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "a b v h g d e ie zh z y i i i k l m n o p r s t u f kh ts ch sh shch _ iu ia".split())),
    "kk": dict(zip("аәбвгғдеёжзийкқлмнңоөпрстуұүфхһцчшщъыіьэюя", "a ä b v g ğ d e e j z i i k q l m n ñ o ö p r s t u ū ü f h h ts ch ş shch _ y i _ e iu ia".split())),
}
PLAIN = {
    "uk": dict(zip("іїєґ", "иеег")),
    "kk": dict(zip("әғқңөұүһі", "агкноуухи")),
    "de": {"ä": "a", "ö": "o", "ü": "u", "ß": "ss"},
    "fr": dict(zip("àâçéèêëîïôùûüÿœæ", "aaceeeeiiouuuyoa")),
    "es": dict(zip("áéíóúüñ", "aeiouun")),
}
SPELLED_OUT = {"de": {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}}
ASCII_KK = {"ä": "a", "ğ": "g", "ñ": "n", "ö": "o", "ū": "u", "ü": "u", "ş": "sh"}
#: Letters of the two scripts that look alike.
_TO_CYRILLIC = str.maketrans("aeopcxyikmtbh", "аеорсхуікмтвн")
_TO_LATIN = str.maketrans("аеорсхуі", "aeopcxyi")

#: Classes: the languages, then other spellings that have models of their own.
CLASSES = (*LANGUAGES, "ru-Latn", "uk-Latn", "kk-Latn", "uk-plain", "kk-plain")
CLASS_LANGUAGE = np.array([LANGUAGES.index(c.split("-")[0]) for c in CLASSES])

_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_SENTENCE = re.compile(r"[^\n.!?…]+(?:[.!?…]+(?=\S)[^\n.!?…]+)*[.!?…]*[»”\")\]]*")
_ASIDE = re.compile(r"[(\[][^()\[\]\n]{0,80}[)\]]")
_CYRILLIC, _LATIN = re.compile("[Ѐ-ӿ]"), re.compile("[a-zà-ɏ]")


def label_language(col: Column) -> Column:
    """The language a label names: a code, a code with a region, or a name, in any case; else null."""
    key = F.regexp_extract(F.lower(F.trim(col)), "^([^-_\\s]+)", 1)
    out = F.lit(None).cast("string")
    for lang, names in LABEL_NAMES.items():
        out = F.when(key.isin(lang, *names.split()), F.lit(lang)).otherwise(out)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Character spans of the sentences; a line end also ends one. Brackets don't hide a sentence's end."""
    bare = _ASIDE.sub(lambda m: "(" + "x" * (len(m[0]) - 2) + ")" if len(m[0]) > 1 else m[0], text)
    return [(m.start(), m.end()) for m in _SENTENCE.finditer(bare) if not m[0].isspace()]


def words_of(text: str) -> list[str]:
    """Words as scored: lower case, without aside in brackets, look-alikes of the other script put right."""
    return [one_script(w) for w in _WORD.findall(_ASIDE.sub(" ", text.lower()))]


def one_script(w: str) -> str:
    c, latin = len(_CYRILLIC.findall(w)), len(_LATIN.findall(w))
    if c and latin:
        return w.translate(_TO_CYRILLIC) if c + 1 >= latin else w.translate(_TO_LATIN)
    return w


def load_pieces(path: str, longest: int = 12) -> set[str]:
    """The vocabulary's pieces that are letters, lower case; a word's first piece begins with a space."""
    out = set()
    for line in open(path, "rb"):
        try:
            p = base64.b64decode(line.split()[0]).decode().lower()
        except UnicodeDecodeError:
            continue
        body = p[1:] if p.startswith(" ") else p
        if body.isalpha() and len(body) <= longest:
            out.add(p)
    return out


class PieceModel:
    """Piece probabilities by class."""

    def __init__(self, pieces: set[str], classes: int):
        self.n = classes
        self.longest = max(map(len, pieces), default=1)
        self.index = {p: i for i, p in enumerate(sorted(pieces))}
        self.p = np.full((len(self.index), classes), 1.0 / max(1, len(self.index)))
        self.floor = np.full(classes, 1e-7)
        self.logs: dict[str, np.ndarray] = {}

    def _lattice(self, w: str) -> list[tuple[int, int, int]]:
        """(from, to, piece) of all pieces in the word; a letter that is no piece has number -1."""
        s, get = " " + w, self.index.get
        n, out = len(s), []
        for i in range(n):
            if i == 1:
                continue  # the mark of a word's beginning is no piece of its own
            first = i + 2 if i == 0 else i + 1
            single = False
            for j in range(first, min(n, i + self.longest) + 1):
                k = get(s[i:j])
                if k is not None:
                    out.append((i, j, k))
                    single |= j == first
            if not single:
                out.append((i, first, -1))
        return out

    def _piece(self, k: int) -> np.ndarray:
        return self.floor if k < 0 else self.p[k]

    def log_probability(self, w: str) -> np.ndarray:
        """Natural log of the word's probability in each class, summed over all segmentations."""
        n = len(w) + 1
        alpha = np.zeros((n + 1, self.n))
        alpha[0] = 1.0
        shift, done = np.zeros(self.n), 0
        for i, j, k in self._lattice(w):
            if i > done and i % 16 == 0:  # long words: keep the numbers in range
                done = i
                top = alpha[i:].max(axis=0)
                top[top <= 0] = 1.0
                alpha[i:] /= top
                shift += np.log(top)
            alpha[j] += alpha[i] * self._piece(k)
        return np.log(np.maximum(alpha[n], 1e-300)) + shift

    def fit(self, words: dict[str, np.ndarray], rounds: int = 2) -> None:
        """Expectation maximisation; ``words``: how often each word occurs in each class."""
        for _ in range(rounds):
            seen = np.zeros_like(self.p)
            for w, c in words.items():
                if len(w) > 40:
                    continue
                edges = self._lattice(w)
                n = len(w) + 1
                alpha, beta = np.zeros((n + 1, self.n)), np.zeros((n + 1, self.n))
                alpha[0], beta[n] = 1.0, 1.0
                for i, j, k in edges:
                    alpha[j] += alpha[i] * self._piece(k)
                for i, j, k in reversed(edges):
                    beta[i] += beta[j] * self._piece(k)
                scale = c / np.maximum(alpha[n], 1e-300)
                for i, j, k in edges:
                    if k >= 0:
                        seen[k] += alpha[i] * beta[j] * self.p[k] * scale
            total = seen.sum(axis=0)
            smooth = 0.01
            self.p = (seen + smooth) / (total + smooth * len(seen))
            self.floor = 0.1 * smooth / (total + smooth * len(seen))


def _spelled(words: dict[str, Counter]) -> dict[str, np.ndarray]:
    """Counts by class of the languages' words and of their other spellings."""
    out: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES)))
    at = {c: i for i, c in enumerate(CLASSES)}

    def turn(w: str, by: dict[str, str]) -> str:
        return "".join(by.get(ch, ch) for ch in w).replace("_", "")

    for lang, counts in words.items():
        if not counts:
            continue
        total = sum(counts.values())
        for w, c in counts.items():
            c = c / total * 20_000  # every language weighs the same
            if lang in ROMAN and not _CYRILLIC.search(w):
                out[w][at[f"{lang}-Latn"]] += c
                continue
            out[w][at[lang]] += c
            if lang in ROMAN:
                roman = turn(w, ROMAN[lang])
                out[roman][at[f"{lang}-Latn"]] += c
                if lang == "kk":
                    out[turn(roman, ASCII_KK)][at["kk-Latn"]] += c
            if f"{lang}-plain" in at:
                out[turn(w, PLAIN[lang])][at[f"{lang}-plain"]] += c
            elif lang in PLAIN and (plain := turn(w, PLAIN[lang])) != w:
                out[plain][at[lang]] += 0.2 * c
            if lang in SPELLED_OUT and (plain := turn(w, SPELLED_OUT[lang])) != w:
                out[plain][at[lang]] += 0.2 * c
            if lang == "ru" and "ё" in w:
                out[w.replace("ё", "е")][at[lang]] += 0.5 * c
    return dict(out)


class LanguageModel:
    """Fitted on (text, language) rows of which most labels are right."""

    def __init__(self, labelled: list[tuple[str, str]], vocabulary: str = VOCABULARY, relabelled: int = 2, rounds: int = 2):
        pieces = load_pieces(vocabulary)
        sents = [([w for w in words_of(t[b:e])], lang) for t, lang in labelled for b, e in sentences(t)]
        sents = [(ws, lang) for ws, lang in sents if ws]
        letters = {ch for ws, _ in sents for w in ws for ch in w if ch.isalpha()}
        self.model = PieceModel(pieces | letters | {" " + x for x in letters}, len(CLASSES))
        for k in range(relabelled + 1):
            words: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}
            for ws, lang in sents:
                if k:
                    lang = self._sure(ws)
                    if lang is None:
                        continue
                words[lang].update(ws if k or lang not in ROMAN else [w for w in ws if _CYRILLIC.search(w)])
            self.model.fit(_spelled(words), rounds if k == 0 else 1)
            self.model.logs = {}
        # classes without any training word can't win
        self.known = self.model.p.max(axis=0) > 1.5 / max(1, len(self.model.p))

    def _sure(self, ws: list[str]) -> str | None:
        scores = sum(self.score(w) for w in ws)
        by = np.array([scores[CLASS_LANGUAGE == i].max() for i in range(len(LANGUAGES))])
        order = np.argsort(-by)
        return LANGUAGES[order[0]] if by[order[0]] - by[order[1]] > 4 else None

    def score(self, w: str) -> np.ndarray:
        x = self.model.logs.get(w)
        if x is None:
            x = self.model.log_probability(w)
            if len(self.model.logs) < 400_000:
                self.model.logs[w] = x
        return x

    def decode(self, texts: list[str], change: float = 6.0) -> list[list[tuple[int, int, int, float, int]]]:
        """Per text: (begin, end, language number or -1, confidence, letters) of each sentence."""
        rows: list[np.ndarray] = []
        spans = []
        raw_ids: dict[str, int] = {}
        flat: list[int] = []
        bounds = [0]
        for t in texts:
            low = t.lower() if len(t.lower()) == len(t) else t
            mine = []
            for b, e in sentences(t):
                n = 0
                for w in _WORD.findall(_ASIDE.sub(" ", low[b:e])):
                    i = raw_ids.get(w)
                    if i is None:
                        i = raw_ids[w] = len(rows)
                        rows.append(self.score(one_script(w)))
                    flat.append(i)
                    n += len(w)
                bounds.append(len(flat))
                mine.append((b, e, n))
            spans.append(mine)
        table = np.array(rows) if rows else np.zeros((1, len(CLASSES)))
        sums = np.concatenate([np.zeros((1, len(CLASSES))), np.cumsum(table[np.array(flat, np.int64)], axis=0)]) if flat else np.zeros((1, len(CLASSES)))
        edges = np.array(bounds)
        by_class = sums[edges[1:]] - sums[edges[:-1]]
        by_class[:, ~self.known] = -np.inf
        by = np.stack([by_class[:, CLASS_LANGUAGE == i].max(axis=1) for i in range(len(LANGUAGES))], axis=1) if len(edges) > 1 else np.zeros((0, len(LANGUAGES)))
        by = np.nan_to_num(by, neginf=-1e9)
        top = by.max(axis=1, keepdims=True) if len(by) else by
        post = np.exp(by - top)
        post /= post.sum(axis=1, keepdims=True)
        out, at = [], 0
        for mine in spans:
            k = len(mine)
            langs = viterbi(by[at : at + k], change)
            out.append([(b, e, int(lang) if n else -1, float(post[at + i, lang]) if n else 0.0, n) for i, ((b, e, n), lang) in enumerate(zip(mine, langs))])
            at += k
        return out


def viterbi(scores: np.ndarray, change: float) -> list[int]:
    """The best sequence of languages, with a price for each change; ties: the earlier language."""
    if not len(scores):
        return []
    best = scores[0].copy()
    back = []
    for row in scores[1:]:
        j = int(best.argmax())
        stay = best >= best[j] - change
        back.append(np.where(stay, np.arange(len(row)), j))
        best = np.where(stay, best, best[j] - change) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def labelled_sample(documents: DataFrame, per_label: int) -> list[tuple[str, str]]:
    """At most 2 * per_label texts of each language's label, about per_label, chosen by hash of the text."""
    named = documents.select("text", label_language(F.col("lang")).alias("named")).filter("named is not null and text is not null")
    counts = {r[0]: r[1] for r in named.groupBy("named").count().collect()}
    out: list[tuple[str, str]] = []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("named") == lang, F.lit(min(1.0, per_label / n))).otherwise(share)
    part = named.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)
    taken: Counter = Counter()
    for text, lang in part.limit(2 * per_label * max(1, len(counts))).collect():
        taken[lang] += 1
        if taken[lang] <= 2 * per_label:
            out.append((text, lang))
    return sorted(out)


SEGMENTS = "doc_id bigint, segment_no int, first_char int, end_char int, lang string, confidence double, letters int"


def _segments(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            cols: list[list] = [[] for _ in range(8)]
            for doc, text_hash, found in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), model.decode(part.column(1).to_pylist())):
                runs: list[list] = []
                for b, e, lang, conf, n in found:
                    if lang < 0:
                        continue
                    if runs and runs[-1][2] == lang:
                        runs[-1][1] = e
                        runs[-1][3] += conf * n
                        runs[-1][4] += n
                    else:
                        runs.append([b, e, lang, conf * n, n])
                for k, (b, e, lang, conf, n) in enumerate(runs):
                    for c, v in zip(cols, (doc, k, b, e, LANGUAGES[lang], round(conf / n, 6), n, text_hash)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int64()))],
                names=["doc_id", "segment_no", "first_char", "end_char", "lang", "confidence", "letters", "text_hash"],
            )


class Languages:
    """Languages of documents and of their stretches.

    ``per_label`` bounds the sample that the model is fitted on (texts for each language that labels
    name); every document is then scored, whole. Null texts have no segments, nor have texts without
    letters; repeated rows count once (what they give is dropped after scoring, so texts aren't shuffled); a
    doc_id with several texts has the stretches of each.
    """

    def __init__(self, documents: DataFrame, per_label: int = 200, vocabulary: str = VOCABULARY):
        spark = documents.sparkSession
        ship(spark)
        rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").filter("doc_id is not null and text is not null")
        self.rows = rows
        held = spark.sparkContext.broadcast(LanguageModel(labelled_sample(rows, per_label), vocabulary))
        text_hash = F.xxhash64("text")
        scored = rows.select("doc_id", "text", text_hash).mapInArrow(lambda it: _segments(it, held.value), SEGMENTS + ", text_hash bigint")
        self.segments = scored.dropDuplicates(["doc_id", "text_hash", "segment_no"]).drop("text_hash")
        self._labelled = rows.select("doc_id", label_language(F.col("lang")).alias("named"), "text", text_hash).mapInArrow(
            lambda it: _totals(it, held.value), "doc_id bigint, text_hash bigint, named string, lang string, letters int, confidence double"
        )

    def mislabelled(self, min_letters: int = 50) -> DataFrame:
        """(doc_id, lang): languages of at least ``min_letters`` letters which the label doesn't name."""
        wrong = F.col("named").isNull() | (F.col("named") != F.col("lang"))
        return self._labelled.filter((F.col("letters") >= min_letters) & wrong).select("doc_id", "lang").distinct()

    def documents(self) -> DataFrame:
        """doc_id, lang (of most letters), confidence, share of the letters, and what the label names."""
        once = self._labelled.groupBy("doc_id", "text_hash", "lang").agg(F.max("letters").alias("letters"), F.max("confidence").alias("confidence"), F.max("named").alias("named"))
        most = once.groupBy("doc_id").agg(F.max(F.struct("letters", "lang", "confidence", "named")).alias("x"), F.sum("letters").alias("n"))
        return most.select("doc_id", "x.lang", "x.confidence", (F.col("x.letters") / F.col("n")).alias("share"), "x.named")


def _totals(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            cols: list[list] = [[] for _ in range(6)]
            for doc, named, text_hash, found in zip(*(part.column(i).to_pylist() for i in (0, 1, 3)), model.decode(part.column(2).to_pylist())):
                letters: Counter = Counter()
                sure: Counter = Counter()
                for _, _, lang, conf, n in found:
                    if lang >= 0:
                        letters[lang] += n
                        sure[lang] += conf * n
                for lang, n in letters.items():
                    for c, v in zip(cols, (doc, text_hash, named, LANGUAGES[lang], n, round(sure[lang] / n, 6))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64()))],
                names=["doc_id", "text_hash", "named", "lang", "letters", "confidence"],
            )
