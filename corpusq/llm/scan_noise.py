"""Problem 1: noise in text from scanned pages.

Running heads, feet and page numbers are found first: lines whose template (see lines.py) is in a large
share of a source's scanned chunks, and lines that are nothing but a page number. What is left is read
as a noisy channel: a word as it should be, times the probability that the recogniser confused its
characters or the line end divided it, times the corpus n-gram likelihood; Viterbi decodes each line
over candidate words.

Word and bigram counts are of the whole corpus. A word meets the corpus words that it may stand for in a
join by skeleton (its characters' confusion classes), once for all its occurrences. The commonest words go
to every task with their counts and readings (a fixed number), so do the commonest pairs and bitmaps of all
words and pairs; with them most stretches are decoded where they stand. Between two words that are read as
written, Viterbi over the stretch is Viterbi over the line. What lacks a count leaves its text as a stretch,
and the counts come back by joins, first of words, then of pairs. The result is a list of edits, which
``found`` reports and ``texts`` applies.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, stage
from .bitmap import Bitmap
from .lines import repeated_lines

_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_TOKEN_OR_END = re.compile(r"[^\W_]+(?:-[^\W_]+)*|\n")
_WORD_OR_END = re.compile(r"\w+(?:-\w+)*|\n")  # the same where there is no underscore
_MARK = re.compile(r"([^\W_]+(?:-[^\W_]+)*)[-¬­]+\s*$")
_MARKS = "-¬­"
_PAGE = re.compile(r"^[\W_]*(?:стр|страница|с|page|p|pp)?[\W_]*([0-9lIоОOoЗзбSs]{1,5})[\W_]*$", re.IGNORECASE)
_PLAIN_NUMBER = re.compile(r"^\s*\d{1,5}\s*$")
_DIGIT_READ = str.maketrans("lIоОOoЗзбSs", "11000033655")
_CYR, _LAT, _DIG = re.compile("[Ѐ-ӿ]"), re.compile("[A-Za-zÀ-ɏ]"), re.compile(r"\d")

#: What a recogniser writes and what stood there. Latin and Cyrillic twins, digits for
#: letters, and letters of like shape; the twins hold in both directions.
TWINS = list(zip("aeopcxykmtbhi", "аеорсхукмтвні"))
DIGITS = [("0", "о"), ("0", "o"), ("3", "з"), ("6", "б"), ("8", "в"), ("4", "ч"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g")]
SHAPES = [("и", "н"), ("г", "т"), ("п", "л"), ("ы", "м"), ("л", "д"), ("ш", "щ"), ("c", "e"), ("l", "i"), ("f", "t"), ("o", "a"), ("и", "й"), ("з", "э"), ("ц", "и"), ("п", "н"), ("о", "с"), ("u", "n"), ("v", "y")]
LONGER = [("ьi", "ы"), ("ьі", "ы"), ("rn", "m"), ("ri", "n"), ("lo", "ю"), ("ii", "н"), ("cl", "d"), ("vv", "w"), ("li", "h")]


def _confusions() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in [*TWINS, *[(b, a) for a, b in TWINS], *DIGITS, *SHAPES, *[(b, a) for a, b in SHAPES], *LONGER]:
        out.setdefault(a, []).append(b)
    return out


def _classes() -> dict[str, str]:
    """Each character's class: its least character among those that single confusions join to it."""
    of: dict[str, str] = {}

    def top(x: str) -> str:
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in [*TWINS, *DIGITS, *SHAPES]:
        x, y = sorted((top(a), top(b)))
        of[y] = x
    return {x: top(x) for x in sorted(of)}


CONFUSIONS, CLASSES = _confusions(), _classes()
_SKELETON = str.maketrans(CLASSES)
#: A word that has a confusable twin at least this many times as frequent is taken for a misreading of it.
RATIO = 30
#: Probability that a line end divides a word without a mark.
UNMARKED = 0.01
#: A confusion that the corpus doesn't show.
UNSEEN = 1e-4
#: So many of the commonest words and pairs are sent to every task; the others are joined.
COMMON_WORDS, COMMON_PAIRS = 100_000, 100_000
#: 64-bit blocks of the bitmaps of all words and all pairs (what isn't in them needs no join).
BITMAP_BLOCKS = 1 << 18
#: A task sends its counts on when it holds so many words or pairs.
HELD_WORDS, HELD_PAIRS = 500_000, 2_000_000


def scripts(w: str) -> tuple[int, int, int]:
    """Cyrillic letters, Latin letters, digits."""
    return len(_CYR.findall(w)), len(_LAT.findall(w)), len(_DIG.findall(w))


def is_sound(w: str) -> bool:
    """Letters of one script, no digits."""
    c, latin, d = scripts(w)
    return d == 0 and (c == 0 or latin == 0) and c + latin > 0


def is_fixed(w: str) -> bool:
    """Too short, or more digits than letters: always read as written."""
    c, latin, d = scripts(w)
    return c + latin + d < 5 or c + latin <= d


def sound_column(w: Column) -> Column:
    return ~w.rlike("(?U)\\d") & (w.rlike("[Ѐ-ӿ]") != w.rlike("[A-Za-zÀ-ɏ]"))


def is_page_number(line: str, page: int | None, edge: bool) -> bool:
    m = _PAGE.match(line)
    if not m or not (_DIG.search(line) or page is not None):
        return False
    number = m[1].translate(_DIGIT_READ)
    if not number.isdigit():
        return False
    if page is not None:
        if int(number) == page:
            return True
        # a misread digit, or a number of its own: only where such lines stand
        return edge and _DIG.search(m[1]) is not None and not _PLAIN_NUMBER.match(line)
    return edge or not _PLAIN_NUMBER.match(line)


def plain_lower(line: str) -> str:
    """Lower case with plain hyphens, letter by letter where case changes the length."""
    low = line.lower()
    if len(low) != len(line):
        low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in line))
    return low.replace("‐", "-").replace("‑", "-")


def reportable(w: str) -> bool:
    return not _DIG.search(w) and sum(ch.isalpha() for ch in w) >= 6


def slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """Smaller batches, as a batch becomes Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# ---- what a written word may stand for


def starts(w: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """The word, and for a mixed one its forms in one script, with the confusions that they imply."""
    out = [(w, [])]
    if is_sound(w):
        return out
    for other, own in ((_LAT, _CYR), (_CYR, _LAT)):
        v, ops = [], []
        for ch in w:
            foreign = other.match(ch) or ch.isdigit()
            right = next((b for b in CONFUSIONS.get(ch, ()) if own.match(b)), None) if foreign else None
            v.append(right or ch)
            if right:
                ops.append((ch, right))
        if ops:
            out.append(("".join(v), ops))
    return out


def skeletons(w: str) -> set[str]:
    """Skeletons of the words that at most two confusions, after ``starts``, lead to."""
    forms = {s for s, _ in starts(w)}
    step = forms
    for _ in range(2):
        step = {f[:i] + b + f[i + len(a) :] for f in step for a, b in LONGER for i in range(len(f) - 1) if f.startswith(a, i)}
        forms = forms | step
    return {f.translate(_SKELETON) for f in forms}


def explain(s: str, v: str, most: int) -> list[tuple[str, str]] | None:
    """At most ``most`` confusions that turn s into v, as few as can be, or None."""
    i, n = 0, min(len(s), len(v))
    while i < n and s[i] == v[i]:
        i += 1
    s, v = s[i:], v[i:]
    if not s and not v:
        return []
    if not s or not v or most == 0:
        return None
    best = None
    for k in (1, 2):
        if v[0] in CONFUSIONS.get(s[:k], ()) and len(s) >= k and (rest := explain(s[k:], v[1:], most - 1)) is not None:
            if best is None or len(rest) + 1 < len(best):
                best = [(s[:k], v[0]), *rest]
    return best


def route(w: str, v: str, own: int) -> tuple[int, list[tuple[str, str]]] | None:
    """Level (1: at most one confusion besides those of ``starts``; 2: two) and confusions from w to v."""
    most = 2 if own == 0 and len(w) >= 6 else 1
    got = [(max(1, len(ops)), [*base, *ops]) for s, base in starts(w) if (ops := explain(s, v, most)) is not None]
    return min(got, key=lambda x: (x[0], len(x[1]))) if got else None


def _bones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, own, s) for w, own in zip(*(batch.column(i).to_pylist() for i in (0, 1))) if not is_fixed(w) for s in sorted(skeletons(w))]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["word", "own", "bone"])


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for w, own, v, cv in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if got := route(w, v, own):
                for c, x in zip(out, (w, v, cv, got[0], [a + ">" + b for a, b in got[1]])):
                    c.append(x)
        types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["word", "v", "cv", "level", "ops"])


def look_alikes(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """For ``words`` (word, own: its count besides one occurrence): the corpus words v, RATIO times as frequent, that it may stand for."""
    met = words.mapInArrow(_bones, "word string, own bigint, bone string").join(lexicon, "bone")
    far = met.filter((F.col("v") != F.col("word")) & (F.col("cv") >= F.greatest(F.lit(2), RATIO * F.col("own"))))
    each = far.select("word", "own", "v", "cv").distinct().mapInArrow(_routes, "word string, v string, cv bigint, level int, ops array<string>")
    return each


# ---- counts of the corpus


class _Numbers(dict):
    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        return n


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (b empty) and of neighbouring words in a line. In a scan a line's outer words may be halves and are left out."""
    ids = _Numbers({"\n": 0})
    ones = np.zeros(0, np.int64)
    keys = counts = np.empty(0, np.int64)
    held: list[np.ndarray] = []
    waiting = 0

    def merge() -> None:
        nonlocal keys, counts, held, waiting
        k, c = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
        keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, c]), len(keys)).astype(np.int64)
        held, waiting = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal ones, keys, counts
        merge()
        names = pa.array(list(ids), pa.string())
        own = np.flatnonzero(ones)
        a, b = np.divmod(keys, 1 << 32)
        first = pa.concat_arrays([names.take(pa.array(own)), names.take(pa.array(a))])
        second = pa.concat_arrays([pa.array([""] * len(own), pa.string()), names.take(pa.array(b))])
        whole = pa.RecordBatch.from_arrays([first, second, pa.array(np.concatenate([ones[own], counts]))], names=["a", "b", "c"])
        for i in range(0, len(whole), 50_000):
            yield whole.slice(i, 50_000)
        ids.clear()
        ids["\n"] = 0
        ones, keys, counts = np.zeros(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    for batch in slices(batches):
        texts, scan = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for of_scan in (False, True):
            joined = "\n".join(["", *(t for t, s in zip(texts, scan) if s == of_scan), ""])
            cut = _TOKEN_OR_END if "_" in joined else _WORD_OR_END
            flat = np.fromiter(map(ids.__getitem__, cut.findall(plain_lower(joined))), np.int64)
            end = flat == 0
            keep = ~end
            if of_scan:
                keep[1:] &= ~end[:-1]
                keep[:-1] &= ~end[1:]
            new = np.bincount(flat[keep], minlength=len(ids))
            new[: len(ones)] += ones
            ones = new
            both = keep[1:] & keep[:-1]
            held.append((flat[:-1][both] << 32) | flat[1:][both])
            waiting += len(held[-1])
        if waiting > HELD_PAIRS:
            merge()
        if len(ids) > HELD_WORDS or len(keys) > HELD_PAIRS:
            yield from flush()
    yield from flush()


# ---- open stretches of a text


def line_join(low: str, nxt: str, x: str, y: str) -> int:
    """How a line that ends with word x and the next, which begins with y, may be joined: 0 not, 1 without a mark, 2 by one."""
    if not nxt.lower().replace("‐", "-").replace("‑", "-").startswith(y):
        return 0
    if low[-1] in _MARKS:
        m = _MARK.search(low, len(low) - len(low.rsplit(None, 1)[-1]))
        return 2 if m and m[1] == x and 2 * len(_DIG.findall(y)) < len(y) else 0
    return int(low.endswith(x) and nxt[0].islower() and len(x) + len(y) >= 5 and not _DIG.search(y))


def open_stretches(text: str, page: int | None, furniture: set[int], channel: Channel) -> tuple[list[int], list[list]]:
    """Numbers of the lines that are no text, and the open stretches.

    A stretch is a list of parts [line, number of its first word in the line, words, word before, word after,
    how it is joined to the next part: 0 not, 1 perhaps, 2 by a mark].
    """
    plain = channel.plain
    raw = text.split("\n")
    full = [i for i, x in enumerate(raw) if x.strip()]
    edges = {*full[:3], *full[-3:]}
    gone = [i for i in full if i + 1 in furniture or is_page_number(raw[i], page, i in edges)]
    out = set(gone)
    body = [i for i in full if i not in out]
    lows = [plain_lower(raw[i]) for i in body]
    words = [_TOKEN.findall(x) for x in lows]
    links = [0] * (len(body) + 1)  # links[k]: between the lines k - 1 and k
    for k in range(1, len(body)):
        if words[k - 1] and words[k] and (got := line_join(lows[k - 1].rstrip(), raw[body[k]].lstrip(), words[k - 1][-1], words[k][0])):
            x, y = words[k - 1][-1], words[k][0]
            if got == 2 or x not in plain or y not in plain or channel.words.may_have(x + y):
                links[k] = got
    units: list[list] = []
    carried = None  # the stretch that the last line's end belongs to
    for k, ws in enumerate(words):
        if not links[k] and not links[k + 1] and plain.issuperset(ws):
            carried = None
            continue
        last = len(ws) - 1
        opened = [w not in plain for w in ws]
        if links[k]:
            opened[0] = True
        if links[k + 1]:
            opened[last] = True
        i = 0
        while i <= last:
            if not opened[i]:
                i += 1
                continue
            j = i
            while j <= last and opened[j]:
                j += 1
            part = [body[k], i, ws[i:j], ws[i - 1] if i else None, ws[j] if j <= last else None, links[k + 1] if j > last else 0]
            if i == 0 and links[k] and carried is not None:
                carried.append(part)
            else:
                carried = [part]
                units.append(carried)
            i = j
        if not links[k + 1]:
            carried = None
    return [i + 1 for i in gone], units


# ---- decoding

Reading = tuple[str, float, int]


class Channel:
    """Confusion probabilities, common words and pairs, and the decoding of stretches.

    What a stretch lacks is noted in ``lacks_words`` or ``lacks_pairs``; ``learn`` takes what the joins gave.
    """

    def __init__(self, price: dict[str, float], total: int, common: list[tuple[str, int, list | None]], pairs: list[tuple[str, str, int]], bitmaps: tuple[Bitmap, Bitmap]):
        self.price, self.total = price, max(1, total)
        self.words, self.word_pairs = bitmaps
        self.common_pairs = {a + " " + b: c for a, b, c in pairs}
        self.counts = {w: c for w, c, _ in common}
        self.common = {w: self._readings(w, c, alike or ()) for w, c, alike in common}
        self.plain = frozenset(w for w, r in self.common.items() if len(r) == 1 and r[0][0] == w)
        self.learn(None, None)

    def learn(self, found: list[dict] | None, pairs: list[dict] | None) -> None:
        """What the joins gave for the words and pairs that a text lacked; None before the join."""
        self.asked_words, self.asked_pairs = found is not None, pairs is not None
        self.found = {r["word"]: r for r in found or ()}
        self.pairs = {r["a"] + " " + r["b"]: r["c"] for r in pairs or ()}

    def count(self, w: str) -> int:
        c = self.counts.get(w)
        if c is not None or not self.words.may_have(w):
            return c or 0
        if w in self.found:
            return self.found[w]["c"] or 0
        self.lacks_words = not self.asked_words
        return 0

    def sound_count(self, w: str) -> int:
        return self.count(w) if is_sound(w) else 0

    def pair(self, a: str, b: str) -> int:
        key = a + " " + b
        c = self.common_pairs.get(key)
        if c is not None or not self.word_pairs.may_have(key):
            return c or 0
        if not self.asked_pairs:
            self.lacks_pairs.add((a, b))
        return self.pairs.get(key, 0)

    def readings(self, w: str) -> list[Reading]:
        """Candidate words with log channel probability and count; the word itself if nothing speaks against it."""
        got = self.common.get(w)
        if got is not None:
            return got
        if is_fixed(w):
            return [(w, 0.0, self.count(w))]
        if not self.asked_words:
            self.lacks_words = True
            return [(w, 0.0, 0)]
        row = self.found.get(w)
        return self._readings(w, row["c"] or 0 if row else 0, (row["alike"] if row else None) or ())

    def _readings(self, w: str, own: int, alike: list) -> list[Reading]:
        if is_fixed(w):
            return [(w, 0.0, own)]
        level = min((r["level"] for r in alike), default=0)
        out = [(r["v"], sum(self.price.get(o, math.log(UNSEEN)) for o in r["ops"]), r["cv"]) for r in alike if r["level"] == level]
        if out:  # the word is a misreading of a far more frequent one
            return sorted(out, key=lambda x: (-x[1], x[0]))
        if not is_sound(w):
            c, latin, digits = scripts(w)
            forms = [s for s, _ in starts(w)[1:] if is_sound(s)]
            if forms and digits * 3 <= c + latin:
                return [(forms[0] if c >= latin else forms[-1], 0.0, 0)]
        return [(w, 0.0, own)]

    def one(self, c: int) -> float:
        return (c + 0.1) / self.total

    def known(self, w: str) -> tuple[str, float] | None:
        """The most probable corpus word that w reads as, with its score."""
        found = [(v, lp + math.log(self.one(c))) for v, lp, c in self.readings(w) if c > 1 and is_sound(v)]
        return max(found, key=lambda x: x[1]) if found else None

    def log_pair(self, a: str, ca: int, b: str, cb: int) -> float:
        """Log of the interpolated bigram and unigram likelihood of b after a."""
        both = self.pair(a, b) / ca if ca else 0.0
        return math.log(0.7 * min(1.0, both) + 0.3 * self.one(cb))

    def join(self, x: str, y: str, marked: bool) -> str | None:
        """The word that two halves make, or None if they are two words."""
        whole, kept = x + y, x + "-" + y
        c = self.sound_count(whole)
        if marked:
            ck = self.sound_count(kept)
            if c or ck:
                return self.readings(whole if c >= ck else kept)[0][0]
            if self.known(x) and self.known(y):
                return None
            found = [r for r in (self.known(whole), self.known(kept)) if r]
            if found:
                return max(found, key=lambda r: r[1])[0]
            row = self.found.get(x)
            return self.readings(kept if row and (row["first"] or 0) > 2 else whole)[0][0]
        cx, cy = self.sound_count(x), self.sound_count(y)
        read = None if not c and cx and cy else self.known(whole)
        if read is None or (cx and cy and self.pair(x, y)):
            return None
        return read[0] if read[1] + math.log(UNMARKED) > math.log(self.one(cx)) + self.log_pair(x, cx, y, cy) else None

    def viterbi(self, steps: list[list[Reading]]) -> list[str]:
        best = [(lp + math.log(self.one(c)), [v], c) for v, lp, c in steps[0]]
        for step in steps[1:]:
            nxt = []
            for v, lp, c in step:
                score, path = max(((s + self.log_pair(p[-1], cp, v, c), p) for s, p, cp in best), key=lambda x: x[0])
                nxt.append((score + lp, [*path, v], c))
            best = nxt
        return max(best, key=lambda x: x[0])[1]

    def decode(self, unit: list[list]) -> list[tuple]:
        """Edits (line, number of the word, word, line whose first word is its end or None); to be used if nothing is lacking."""
        self.lacks_words, self.lacks_pairs = False, set()
        edits: list[tuple] = []
        parts = [[p[0], p[1], list(p[2]), p[3], p[4], p[5]] for p in unit]
        spent = False  # the part's only word went to the line before
        for a, b in zip(parts, parts[1:]):
            if a[5] and a[2] and not spent:
                whole = self.join(a[2][-1], b[2][0], a[5] == 2)
                if whole is not None and not (self.lacks_words or self.lacks_pairs):
                    edits.append((a[0], a[1] + len(a[2]) - 1, whole, b[0]))
                    a[2].pop()
                    b[2].pop(0)
                    b[1] += 1
            spent = not b[2]
        for line, at, words, before, after, _ in parts:
            if not words:
                continue
            context = lambda w: [] if w is None else [[(w, 0.0, self.counts[w])]]
            steps = [*context(before), *(self.readings(w) for w in words), *context(after)]
            read = [s[0][0] for s in steps] if all(len(s) == 1 for s in steps) else self.viterbi(steps)
            edits += [(line, at + i, v, None) for i, (w, v) in enumerate(zip(words, read[before is not None :])) if v != w]
        return edits

    def asks(self, unit: list[list]) -> set[str]:
        """All words whose counts may decide the unit, but the common ones."""
        ws = {w for p in unit for w in p[2]}
        for a, b in zip(unit, unit[1:]):
            if a[5]:
                ws |= {a[2][-1] + b[2][0], a[2][-1] + "-" + b[2][0]}
        return {w for w in ws if w not in self.counts}

    def settle(self, units: list[list]) -> tuple[list[tuple], list[list], set[str], set[tuple[str, str]]]:
        """Edits of the units that lack nothing, the other units, and the words and pairs that they lack."""
        edits, rest, words, pairs = [], [], set(), set()
        for unit in units:
            got = self.decode(unit)
            if self.lacks_words or self.lacks_pairs:
                rest.append(unit)
                pairs |= self.lacks_pairs
                words |= self.asks(unit) if self.lacks_words else set()
            else:
                edits += got
        return edits, rest, words, pairs


EDITS = "array<struct<line:int,at:int,word:string,to:int>>"
_EDIT_TYPE = pa.list_(pa.struct([("line", pa.int32()), ("at", pa.int32()), ("word", pa.string()), ("to", pa.int32())]))
_FOUND = "array<struct<word:string,c:bigint,first:bigint,alike:array<struct<v:string,cv:bigint,level:int,ops:array<string>>>>>"
_PAIRS = "array<struct<a:string,b:string>>"


def _edit_rows(edits: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("line", "at", "word", "to"), x)) for x in e] for e in edits], _EDIT_TYPE)


def _units(rest: list[list]) -> str | None:
    return json.dumps(rest, ensure_ascii=False) if rest else None


def _first_pass(batches: Iterator[pa.RecordBatch], channel: Channel) -> Iterator[pa.RecordBatch]:
    """chunk_id, text, text_hash, page, drop: edits of what common words decide, the other stretches and the words that they lack."""
    for batch in slices(batches):
        lines, edits, rest, lack = [], [], [], []
        for text, page, drop in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
            gone, units = open_stretches(text, page, set(drop or ()), channel)
            mine, left, words, _ = channel.settle(units)
            for c, x in zip((lines, edits, rest, lack), (gone, mine, _units(left), sorted(words))):
                c.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(lines, pa.list_(pa.int32())), _edit_rows(edits), pa.array(rest, pa.string()), pa.array(lack, pa.list_(pa.string()))],
            names=["chunk_id", "text_hash", "lines", "edits", "units", "lack"],
        )


def _second_pass(batches: Iterator[pa.RecordBatch], channel: Channel) -> Iterator[pa.RecordBatch]:
    """chunk_id, text_hash, units, found: with the words' counts; the pairs that are lacking now."""
    for batch in slices(batches):
        edits, rest, wants, kept = [], [], [], []
        for units, found in zip(*(batch.column(i).to_pylist() for i in (2, 3))):
            channel.learn(found or [], None)
            mine, left, _, pairs = channel.settle(json.loads(units))
            for c, x in zip((edits, rest, wants, kept), (mine, _units(left), [{"a": a, "b": b} for a, b in sorted(pairs)], found if left else None)):
                c.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), _edit_rows(edits), pa.array(rest, pa.string()), pa.array(kept, batch.schema.field(3).type), pa.array(wants, pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())])))],
            names=["chunk_id", "text_hash", "edits", "units", "found", "wants"],
        )


def _third_pass(batches: Iterator[pa.RecordBatch], channel: Channel) -> Iterator[pa.RecordBatch]:
    """chunk_id, text_hash, units, found, pairs: with the pairs' counts."""
    for batch in slices(batches):
        edits = []
        for units, found, pairs in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            channel.learn(found or [], pairs or [])
            edits.append(channel.settle(json.loads(units))[0])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _edit_rows(edits)], names=["chunk_id", "text_hash", "edits"])


def _cased(new: str, old: str) -> str:
    body = [ch for ch in old if ch.isalpha()]
    if len(body) > 1 and all(ch.isupper() for ch in body):
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def apply_edits(text: str, gone: set[int], edits: list[dict]) -> str:
    """The text in paragraphs, without the lines that are no text, with its words put right."""
    raw = text.split("\n")
    by_line: dict[int, dict[int, dict]] = {}
    for e in edits:
        by_line.setdefault(e["line"], {})[e["at"]] = e
    skip = {e["to"] for e in edits if e["to"] is not None}
    paragraphs: list[list[str]] = [[]]
    last = None
    for i, line in enumerate(raw):
        if not line.strip() or i + 1 in gone:
            continue
        if last is not None and i not in skip and (any(not raw[j].strip() for j in range(last + 1, i)) or (len(line) > 1 and line[:2].isspace())):
            paragraphs.append([])
        last = i
        mine = by_line.get(i, {})
        if not mine and i not in skip:
            paragraphs[-1].append(" ".join(line.split()))
            continue
        parts, at = [], 0
        for k, m in enumerate(_TOKEN.finditer(plain_lower(line))):
            if k == 0 and i in skip:
                at = m.end()
            elif k in mine:
                parts.append(line[at : m.start()])
                parts.append(_cased(mine[k]["word"], line[m.start() : m.end()]))
                at = len(line) if mine[k]["to"] is not None else m.end()
        paragraphs[-1].append(" ".join(("".join(parts) + line[at:]).split()))
    good = [" ".join(x for x in p if x) for p in paragraphs]
    # what follows a joined word without a space is its punctuation
    return "\n\n".join(re.sub(r" ([.,;:!?»)])", r"\1", g) for g in good if g)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, words = [], []
        for text, lines, edits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            texts.append(apply_edits(text, set(lines or ()), edits or []))
            words.append(sorted({e["word"] for e in edits or () if reportable(e["word"])}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(words, pa.list_(pa.string()))], names=["chunk_id", "text", "lines", "words"])


class ScanRepair:
    """Repair of text chunks with an image.

    ``edits``: chunk_id, text_hash, lines (numbers of those left out), edits (line from 0, number of the word in
    it, the word put right, the line whose first word is its end). A word of fewer than five letters and digits,
    or of more digits than letters, is always read as written. Counts are of all text chunks; a word that occurs
    once counts as unseen. A running head of fewer than ``short_head`` letters must be the outermost line at least
    half the times. Null texts or ids are left out, a null page only takes away one sign of a page number,
    repeated rows count once; of a chunk_id with different texts each is repaired.
    """

    def __init__(self, chunks: DataFrame, min_chunks: int = 4, min_share: float = 0.12, short_head: int = 10):
        spark = chunks.sparkSession
        ship(spark)
        texts = chunks.filter("type = 'text' and text is not null and chunk_id is not null")
        scanned = F.coalesce(F.length("image_path") > 0, F.lit(False))
        self.scans = texts.filter(scanned).select("chunk_id", "source_file", "page", "text")
        heads = repeated_lines(self.scans, min_chunks, min_share, edits=3)
        brief = F.length("template") < short_head
        outer = heads.filter(brief).groupBy("source_file", "template").agg(F.avg(F.col("outer").cast("int")).alias("share")).filter("share >= 0.5")
        heads = heads.filter(~brief).unionByName(heads.filter(brief).join(outer.drop("share"), ["source_file", "template"], "left_semi").select(heads.columns))
        drop = heads.select("chunk_id", "line_no").distinct().groupBy("chunk_id").agg(F.collect_list("line_no").alias("drop"))
        counts = stage(
            texts.select("text", scanned.alias("scan")).mapInArrow(_count_words, "a string, b string, c bigint").groupBy("a", "b").agg(F.sum("c").alias("c")).filter("c > 1"),
            "p1-counts",
        )
        words = stage(counts.filter("b = ''").select(F.col("a").alias("word"), "c"), "p1-words")
        total = words.agg(F.sum("c")).collect()[0][0] or 0
        own = F.when(sound_column(F.col("word")), F.coalesce(F.col("c"), F.lit(1)) - 1).otherwise(0)
        keys, values = "".join(CLASSES), "".join(CLASSES.values())
        lexicon = words.filter(sound_column(F.col("word"))).select(F.col("word").alias("v"), F.col("c").alias("cv"), F.translate("word", keys, values).alias("bone"))
        twins = stage(look_alikes(words.select("word", own.alias("own")), lexicon), "p1-twins")
        alike = F.collect_list(F.struct("v", "cv", "level", "ops")).alias("alike")
        top = words.orderBy(F.desc("c"), "word").limit(COMMON_WORDS).join(twins.groupBy("word").agg(alike), "word", "left").toArrow()
        pairs = counts.filter("b <> ''")
        top_pairs = pairs.orderBy(F.desc("c"), "a", "b").limit(COMMON_PAIRS).toArrow()
        bitmaps = Bitmap.of(words.select(F.xxhash64("word")), BITMAP_BLOCKS), Bitmap.of(pairs.select(F.xxhash64(F.concat_ws(" ", "a", "b"))), BITMAP_BLOCKS)
        columns = lambda t, *names: zip(*(t.column(n).to_pylist() for n in names))
        channel = spark.sparkContext.broadcast(
            Channel(self._prices(words, twins), total, list(columns(top, "word", "c", "alike")), list(columns(top_pairs, "a", "b", "c")), bitmaps)
        )
        key = ["chunk_id", "text_hash"]
        rows = self.scans.select("chunk_id", "page", "text").repartition("chunk_id").dropDuplicates(["chunk_id", "text"]).join(drop, "chunk_id", "left")
        first = stage(
            rows.select("chunk_id", "text", F.xxhash64("text"), "page", "drop").mapInArrow(
                lambda it: _first_pass(it, channel.value), f"chunk_id string, text_hash bigint, lines array<int>, edits {EDITS}, units string, lack array<string>"
            ),
            "p1-first",
        )
        asked = first.select(*key, F.explode("lack").alias("word"))
        seen = asked.select("word").distinct().join(words, "word", "left")
        firsts = words.filter(F.col("word").contains("-")).groupBy(F.substring_index("word", "-", 1).alias("word")).agg(F.sum("c").alias("first"))
        near = look_alikes(seen.select("word", own.alias("own")), lexicon).groupBy("word").agg(alike)
        looked = seen.join(firsts, "word", "left").join(near, "word", "left").filter("c is not null or first is not null or alike is not null")
        found = asked.join(looked, "word").groupBy(*key).agg(F.collect_list(F.struct("word", "c", "first", "alike")).cast(_FOUND).alias("found"))
        second = stage(
            first.filter("units is not null").select(*key, "units").join(found, key, "left").mapInArrow(
                lambda it: _second_pass(it, channel.value), f"chunk_id string, text_hash bigint, edits {EDITS}, units string, found {_FOUND}, wants {_PAIRS}"
            ),
            "p1-second",
        )
        wants = second.select(*key, F.explode("wants").alias("w")).select(*key, "w.a", "w.b").join(counts, ["a", "b"])
        counted = wants.groupBy(*key).agg(F.collect_list(F.struct("a", "b", "c")).alias("pairs"))
        third = second.filter("units is not null").select(*key, "units", "found").join(counted, key, "left").mapInArrow(
            lambda it: _third_pass(it, channel.value), f"chunk_id string, text_hash bigint, edits {EDITS}"
        )
        none = F.lit(None).cast("array<int>").alias("lines")
        self.edits = first.select(*key, "lines", "edits").unionByName(second.select(*key, none, "edits")).unionByName(third.select(*key, none, "edits"))

    @staticmethod
    def _prices(words: DataFrame, twins: DataFrame) -> dict[str, float]:
        """Log probability of each confusion: how often it explains a rare word by a frequent one. As many rows as there are confusions."""
        singles = [x for x in CLASSES if len(x) == 1]
        could = words.select(F.explode(F.split("word", "")).alias("ch"), "c").filter(F.col("ch").isin(singles)).groupBy("ch").agg(F.sum("c")).collect()
        rare = twins.join(words, "word").filter((F.length("word") >= 6) & (F.col("cv") >= RATIO * F.col("c")) & (F.size("ops") == 1))
        seen = rare.select(F.col("ops")[0].alias("op"), "c").groupBy("op").agg(F.sum("c")).collect()
        n, of = {r[0]: r[1] for r in could}, {r[0]: r[1] for r in seen}
        ops = [(a, b) for a, bs in CONFUSIONS.items() for b in bs]
        return {f"{a}>{b}": math.log(min(0.02, max(1e-5, (of.get(f"{a}>{b}", 0) + 0.5) / (n.get(b, 0) + 1000)))) for a, b in ops}

    def found(self) -> DataFrame:
        """(chunk_id, kind, item): the lines left out and the words put right."""
        item = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("item"))
        report = lambda e: (F.length(F.regexp_replace(e["word"], "(?U)[^\\p{L}]", "")) >= 6) & ~e["word"].rlike("(?U)\\d")
        lines = F.transform(F.coalesce("lines", F.array().cast("array<int>")), lambda n: item("line", n))
        words = F.transform(F.filter("edits", report), lambda e: item("word", e["word"]))
        return self.edits.select("chunk_id", F.explode(F.concat(lines, words)).alias("x")).select("chunk_id", "x.kind", "x.item").distinct()

    def texts(self) -> DataFrame:
        """chunk_id, text (paragraphs), lines (left out), words (put right)."""
        per = self.edits.groupBy("chunk_id", "text_hash").agg(F.max("lines").alias("lines"), F.flatten(F.collect_list("edits")).alias("edits"))
        rows = self.scans.select("chunk_id", "text", F.xxhash64("text").alias("text_hash")).join(per, ["chunk_id", "text_hash"]).dropDuplicates(["chunk_id", "text_hash"])
        return rows.select("chunk_id", "text", "lines", "edits").mapInArrow(_apply, "chunk_id string, text string, lines array<int>, words array<string>")
