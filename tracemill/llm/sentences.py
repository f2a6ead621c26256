r"""Sentence units of texts in many languages and scripts.

A text falls into blocks (fenced code, headings, list items, paragraphs), and paragraphs fall into
sentences at end marks. What makes a mark ambiguous is settled in two passes, without word lists:

1. Every document gives evidence from places that are not ambiguous: which words stand before a full
   stop, and whether then a paragraph ends, a small letter, a digit or a comma follows; how often the
   same words stand without a stop; with which words paragraphs and plain sentences begin, and how
   often the same words stand elsewhere. The evidence is summed over the corpus.
2. A full stop after a word that, in the corpus, is hardly ever without its stop and never ends a
   paragraph belongs to an abbreviation and ends nothing. After one that does end paragraphs (etc.,
   p.m.) it ends a sentence if what follows looks like a beginning. Of words that the corpus says
   nothing about, those that the whole document at hand shows to be abbreviations end a sentence only
   before a known beginning or a word that the document also writes small, not before a name. A
   number before a stop is an ordinal where the next word is hardly ever a beginning.

Marks inside quotations and brackets end nothing; after a quotation that holds an end mark, the next
word decides: a small letter or a dash goes on, a known beginning starts anew. Full-width marks need
no blank after them, Thai splits at blanks between Thai letters, Greek also at its question mark. A
line break ends a unit only where the next word would have fitted on the line.

Edge cases: null, empty and invisible texts have no sentences. Offsets count code points of the text
as stored. A fence that is never closed runs to the end. Very long texts cost linear time. Rows equal
in text give equal units; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Corpus evidence of up to so many words is sent to the workers at once; more is joined by document.
SENT_AT_ONCE = 200_000
#: Longest word that can be an abbreviation, and the share of its stops that may end paragraphs.
ABBREVIATION, SELDOM_LAST = 7, 0.02
#: Upper bound of the share of its stops that end paragraphs, below which a word is an abbreviation even if it is also written without.
SURELY = 0.113
#: Part of a wrapped text's width within which the next word clearly would have fitted.
SLACK = 0.75
#: Share of a word's occurrences that must be beginnings for it to be one.
BEGINNING = 0.15

FENCE = re.compile(r"[ \t]*(```|~~~)")
HEADING = re.compile(r"#{1,6}\s")
ITEM = re.compile(r"[ \t]*(?:[-*+•‣]|\(?\d{1,3}[.)])[ \t]+\S")
CODE = re.compile(r"(?:def |class |import |from \w+ import|return\b|for \w+ in |if .*:$|while .*:$|#include|function |const |let |var )")
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
#: A stop after which a sentence clearly goes on.
GOES_ON = re.compile(r"[\p{L}\p{M}\d]\.[\s\p{Z}”»」』）)\]’\"'】》›“]*[\p{Ll}\d,;:]")
GREEK, GREEK_WORD, THAI = re.compile(r"\p{Greek}"), re.compile(r"\p{Greek}[^;;]{0,3}$"), re.compile(r"\p{Thai}")
CAPITAL = re.compile(r"[“„«\"]?\p{Lu}(?:\p{Ll}|['’. ]|\s)")
ADDRESS = re.compile(r"[/@\\]\S*$")
THAI_END = re.compile(r"(?<=[\p{Thai}])\s+(?=\p{Lu}\p{Ll})|(?<=[\p{Thai}])\s*[\r\n]\s*(?=\p{L})")
GRAPH = re.compile(r"\S+")
BREAK = re.compile(r"[ \t]*(?:\r\n|\r|\n)[ \t]*")
INNER = re.compile(r"(?<=[\p{Ll}\p{N}],? )\p{L}")
INVISIBLE = re.compile(r"[\s\p{Z}\p{Cc}\p{Cf}]*")
#: Opening marks with their closing ones; the plain double mark is both.
PAIRS = {"“": "”“", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‘": "’", "【": "】", "《": "》", "‹": "›"}
CLOSING = "”»」』）)]’\"'】》›“"
BRACKET = re.compile(r"[“”„«»「」『』（）()\[\]‘’\"【】《》‹›]")
WIDE = "。！？｡"
MARK = re.compile(r"[.!?…。！？｡।॥؟;;]+")
WORD = re.compile(r"(?:\p{L}[\p{L}\p{M}]*[.’'-])*[\p{L}\p{M}]+$|\d+$")
NEXT = re.compile(r"[\p{L}\p{M}]+|\d+")
TOKEN = re.compile(r"\p{L}[\p{L}\p{M}.’'-]*")
#: A word written with a capital inside a line, after a word in small letters or a comma: no place where a sentence could begin.
NAME = re.compile(r"(?<=[\p{Ll}\p{M}],? )\p{Lu}[\p{L}\p{M}]+")
CJK = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
THAI_GAP = re.compile(r"(?<=[\p{Thai}])(?:[ \t ]+|\s*[\r\n]\s*)(?=[\p{Thai}])")
SPACE = " \t\r\n  　  "


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """``start, end, kind`` of the blocks; kind is ``unit`` or ``prose``."""
    lines = [(m.start(), m.end()) for m in LINE.finditer(text) if m.end() > m.start()]
    start = None  # of the running block
    kind = "prose"
    i = 0
    while i < len(lines):
        a, b = lines[i]
        line = text[a:b].rstrip("\r\n")
        if FENCE.match(line):
            if start is not None:
                yield start, a, kind
                start = None
            mark = FENCE.match(line)[1]
            j = i + 1
            while j < len(lines) and not text[lines[j][0] : lines[j][1]].strip().startswith(mark):
                j += 1
            last = min(j, len(lines) - 1)
            rest = text[lines[last][0] : lines[last][1]].strip()[len(mark) :] if j < len(lines) else ""
            end = lines[last][1]
            if rest.strip():  # words behind the closing fence are no part of it
                end = lines[last][0] + text[lines[last][0] : lines[last][1]].index(mark) + len(mark)
            yield a, end, "unit"
            if end < lines[last][1]:
                start, kind = end, "prose"
            i = last + 1
            continue
        if not INVISIBLE.fullmatch(line):
            item, heading = ITEM.match(line), HEADING.match(line) and kind != "code"
            if start is not None and (item or heading) and kind != "code":
                yield start, a, kind
                start = None
            if start is None:
                start = a
                kind = "heading" if heading else "item" if item else "code" if CODE.match(line) else "prose"
            elif kind in ("item", "heading") and not line[0].isspace() and (kind == "heading" or not line[0].islower()):
                yield start, a, kind
                start, kind = a, "prose"
        elif start is not None:
            yield start, a, kind
            start = None
        i += 1
    if start is not None:
        yield start, len(text), kind


def spans(p: str) -> list[tuple[int, int]]:
    """Quotations and brackets of a paragraph: positions of their opening and closing marks."""
    if not BRACKET.search(p):
        return []
    out, stack = [], []
    plain = None
    for m in BRACKET.finditer(p):
        c, i = m[0], m.start()
        if c == '"':
            if plain is None:
                plain = i
            else:
                out.append((plain, i))
                plain = None
            continue
        if c == "’" and i + 1 < len(p) and p[i + 1].isalpha() and i and p[i - 1].isalpha():
            continue  # an apostrophe
        at = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRS[stack[k][0]]), None)
        if at is not None and not (c in PAIRS and c != "“"):
            out.append((stack[at][1], i))
            del stack[at:]
        elif c in PAIRS:
            stack.append((c, i))
    return sorted(out)


def width(text: str) -> int:
    """The longest line, if the text looks wrapped, else 0."""
    lines = re.split(r"\r\n|\r|\n", text)
    longest = max((len(x) for x, y in zip(lines, lines[1:], strict=False) if x.strip() and y.strip()), default=0)
    return longest if 0 < longest <= 120 else 0


def before(p: str, i: int) -> str:
    """The word that ends right before position i; # for a short number, ## for a long one."""
    c = p[i - 1 : i]
    if c.isascii():
        if not c.isalnum():
            return ""
        j, lo = i - 1, max(0, i - 24)
        if c.isdigit():
            while j > lo and p[j - 1].isdigit():
                j -= 1
            return "#" if i - j < 3 else "##"
        while j > lo and p[j - 1].isascii() and p[j - 1].isalpha():
            j -= 1
        if j == lo or p[j - 1] in " \n(\"\t":
            return p[j:i]
    m = WORD.search(p, max(0, i - 24), i)
    return "" if m is None else m[0] if not m[0].isdigit() else "#" if len(m[0]) < 3 else "##"


def opening(p: str, j: int) -> str:
    """The word that starts at or right after position j, or three signs of a script without spaces."""
    while j < len(p) and (p[j] in SPACE or p[j] in PAIRS or p[j] in "\"¿¡—–-*_"):
        j += 1
    if CJK.match(p, j):
        return p[j : j + 3]
    m = NEXT.match(p, j)
    return m[0] if m else ""


def evidence(text: str) -> dict[str, list[int]]:
    """``word -> a, b, c``: words keyed ``s:`` (stops, last, small next), ``w:`` (alone), ``b:`` (beginnings, all)."""
    out: dict[str, list[int]] = {}

    def add(w: str, a: int, b: int, c: int) -> None:
        x = out.get(w)
        if x is None:
            out[w] = [a, b, c]
        else:
            x[0] += a
            x[1] += b
            x[2] += c

    for start, end, kind in blocks(text):
        if kind != "prose":
            continue
        p = text[start:end].strip()
        n = len(p)
        starts = [0]
        hidden = bytearray(n + 1)
        for x, y in spans(p):
            hidden[x:y] = b"\x01" * (y - x)
        for m in MARK.finditer(p):
            i, j, mark = m.start(), m.end(), m[0]
            if p[i] in WIDE and not hidden[i] and j < n and p[j] not in CLOSING:
                starts.append(j)
            if mark != ".":
                if j < n and p[j] in SPACE and not hidden[i] and "…" not in mark and ".." not in mark and p[i] in "!?।؟":
                    starts.append(j)
                continue
            w = before(p, i).lower()
            if not w or j < n and p[j] not in SPACE and p[j] not in CLOSING and p[j] not in ",;:":
                continue
            k = j
            while k < n and (p[k] in SPACE or p[k] in CLOSING):
                k += 1
            small = k < n and (p[k].islower() or p[k].isdigit() or p[k] in ",;:")
            add("s:" + w, 1, int(k >= n), int(small))
            if not hidden[i] and k < n and p[k].isupper() and len(w) > ABBREVIATION:
                starts.append(j)
        cjk = CJK.search(p) is not None
        for w, times in Counter(opening(p, s) for s in starts).items():
            if w and CJK.match(w):
                add("b:" + w, times, times, 0)
            elif w:
                add("b:" + w.lower(), times, 0, 0)
        for w, times in Counter(TOKEN.findall(p.lower())).items():
            w = w.rstrip("’'-")
            if w[-1:] == "." or cjk and CJK.match(w):
                continue
            add("b:" + w.split("’")[0].split("'")[0], 0, times, 0)
            if len(w) <= ABBREVIATION:
                add("w:" + w, times, 0, 0)
    return out


def lookups(text: str) -> set[str]:
    """Every key that ``cut_points`` may ask for: the words before and after each mark, whatever closes in between."""
    keys = set()
    for a, b, kind in blocks(text):
        if kind != "prose":
            continue
        p = text[a:b]
        for m in MARK.finditer(p):
            keys.add("s:" + before(p, m.start()).lower())
            k = m.end()
            while True:
                gap = k
                while gap < len(p) and p[gap] in SPACE:
                    gap += 1
                word = opening(p, gap)
                keys.add("b:" + (word if CJK.match(word or " ") else word.lower()))
                if k >= len(p) or p[k] not in CLOSING:
                    break
                k += 1
    return keys


def gathered(texts: DataFrame, text: str) -> DataFrame:
    """``word, a, b, c`` summed over the corpus; each batch is summed before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for t in batch.column(0).to_pylist():
                for w, (a, b, c) in evidence(t).items() if t else ():
                    s = sums.get(w)
                    if s is None:
                        sums[w] = [a, b, c]
                    else:
                        s[0] += a
                        s[1] += b
                        s[2] += c
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([s[k] for s in sums.values()], pa.int64()) for k in range(3))], ["word", "a", "b", "c"])

    return texts.select(text).mapInArrow(run, "word string, a long, b long, c long").groupBy("word").agg(*[F.sum(k).alias(k) for k in "abc"])


def decided(sums: DataFrame) -> DataFrame:
    """``word, verdict``: the words the corpus says something about.

    ``s:`` words: 2 an abbreviation that ends nothing, 1 one that may end a sentence. ``b:`` words: 1 a beginning.
    """
    stops = sums.where("word like 's:%'").selectExpr("substring(word, 3) as w", "a as stops", "b as last", "c as small")
    alone = sums.where("word like 'w:%'").selectExpr("substring(word, 3) as w", "a as alone")
    s = stops.join(alone, "w", "left").na.fill({"alone": 0})
    rare_alone = F.expr(f"length(w) <= {ABBREVIATION} and alone <= 0.2 * stops and w not in ('#', '##')")
    followed = F.expr(f"length(w) <= {ABBREVIATION} and small >= 0.5 * stops")
    dotted = F.expr("w like '%.%'")
    ends = F.expr(f"last >= {SELDOM_LAST} * stops")
    # Wilson's upper bound of the share of stops that end a paragraph
    high = F.expr("(last / stops + 1.9208 / stops + 1.96 * sqrt(last / stops * (1 - last / stops) / stops + 0.9604 / (stops * stops))) / (1 + 3.8416 / stops)")
    never = F.expr(f"length(w) <= {ABBREVIATION} and w not in ('#', '##')") & (high <= SURELY)
    verdict = F.when(never, 2).when((rare_alone & (followed | ~ends)) | (followed & F.expr("stops >= 3")) | dotted, F.when(ends, 1).otherwise(2))
    a = s.withColumn("verdict", verdict).where("verdict is not null and (stops >= 2 or w like '%.%')").selectExpr("concat('s:', w) as word", "verdict")
    b = sums.where(f"word like 'b:%' and a >= 2 and a >= {BEGINNING} * b").selectExpr("word", "1 as verdict")
    return a.unionByName(b)


def sentences(text: str | None, known: dict[str, int]) -> list[tuple[int, int]]:
    """Offsets of the units of a text; ``known`` holds the verdicts of ``decided`` by word."""
    if not text or INVISIBLE.fullmatch(text):
        return []
    out: list[tuple[int, int]] = []
    wide = width(text)
    lower = not any(c.isupper() for c in text[:2000]) and not any(c.isupper() for c in text)
    own = Own(text, lower)
    for a, b, kind in blocks(text):
        cuts = [b] if kind != "prose" else [*(a + c for c in cut_points(text[a:b], known, wide, lower, own)), b]
        start = a
        for c in cuts:
            x, y = start, c
            while x < y and INVISIBLE.match(text, x, x + 1).end() > x:
                x += 1
            while y > x and INVISIBLE.match(text, y - 1, y).end() == y and INVISIBLE.match(text, y - 1, y).end() > y - 1:
                y -= 1
            if y > x:
                out.append((x, y))
            start = c
    return out


class Own:
    """What a document shows of its own words, from their unambiguous places in all its paragraphs.

    ``short``: abbreviations (a small letter, digit or comma follows their stop, they end no paragraph and never stand without
    it; of more than 4 letters only if shown twice). ``small``: words also written small, so that a capital makes no name of
    them. ``names``: words with a capital where no sentence can begin, and never small.
    """

    __slots__ = ("_capitals", "names", "short", "small", "text")

    def __init__(self, text: str, lower: bool) -> None:
        self.text, self._capitals = text, None
        self.short: set[str] = set()
        self.small: set[str] = set()
        self.names: set[str] = set()
        # where all is written small, a small letter after a stop shows nothing
        if lower or not GOES_ON.search(text):
            return
        cases = text.lower()
        if len(cases) != len(text):  # offsets would differ
            cases = text
        shown = {before(text, m.start() + 1).lower() for m in GOES_ON.finditer(text)} - {"", "#", "##"}
        words: set[str] | None = None
        for w in shown:
            if len(w) > ABBREVIATION:
                continue
            words = words or set(TOKEN.findall(cases))
            if w in words:  # it stands without a stop too
                continue
            stops = small = 0
            at = cases.find(w + ".")
            while at >= 0:
                k = at + len(w) + 1
                if not (at and cases[at - 1].isalnum()) and (k >= len(text) or text[k] in SPACE or text[k] in CLOSING or text[k] in ",;:"):
                    start = k
                    while k < len(text) and (text[k] in SPACE or text[k] in CLOSING):
                        k += 1
                    if k >= len(text) or text.count("\n", start, k) > 1 or text.count("\r", start, k) > 1:
                        small = -len(text)  # it ends a paragraph
                    stops += 1
                    small += k < len(text) and (text[k].islower() or text[k].isdigit() or text[k] in ",;:")
                at = cases.find(w + ".", at + 1)
            if small >= (1 if len(w) <= 4 else 2) and 2 * small >= stops:
                self.short.add(w)
        if self.short:
            self.small = {w for w in NEXT.findall(text) if w.islower()}
            self.names = {w for w in NAME.findall(text) if w.lower() not in self.small}

    def capitals(self) -> bool:
        """Whether the document writes nouns with capitals: many of its words inside sentences have one. Numbers with a stop are ordinals there."""
        if self._capitals is None:
            inside = INNER.findall(self.text)
            self._capitals = sum(c.isupper() for c in inside) >= 0.2 * len(inside) > 0
        return self._capitals


def cut_points(p: str, known: dict[str, int], wide: int, lower: bool, own: Own) -> list[int]:
    cuts: list[int] = []
    inside = spans(p)
    hidden = bytearray(len(p) + 1)
    closes: dict[int, int] = {}
    for x, y in inside:
        hidden[x:y] = b"\x01" * (y - x)
        closes[y] = x
    plain = p.isascii()
    greek = not plain and GREEK.search(p) is not None
    n = len(p)
    for m in MARK.finditer(p):
        i, j = m.start(), m.end()
        if j < n and p[j] == "‍":
            continue
        mark = m[0]
        if mark[0] in ";;" and not (greek and GREEK_WORD.search(p, max(0, i - 8), i) and len(mark) == 1):
            continue
        k = j
        while k < n and p[k] in CLOSING and (k in closes or p[k] in "”»」』）)]’\"" and not hidden[k]):
            k += 1
        quoted = k > j
        if quoted and any(hidden[q] and q not in closes for q in (k - 1,)):
            continue
        if hidden[k - 1] and not (k - 1 in closes and not any(x < k - 1 < y for x, y in _around(inside, k - 1))):
            continue
        if not quoted and hidden[i]:
            continue
        if k >= n:
            continue
        gap = k
        while gap < n and p[gap] in SPACE:
            gap += 1
        if gap >= n:
            continue
        spaced = gap > k
        nxt = p[gap]
        word = opening(p, gap)
        begins = known.get("b:" + (word if CJK.match(word or " ") else word.lower()), 0) == 1
        if mark[-1] in WIDE or mark[0] in WIDE:
            if nxt in CLOSING and nxt not in "“\"" or nxt in "，、,：:；":
                continue
            if quoted and not (nxt in PAIRS or begins or nxt.isupper()):
                continue
            cuts.append(k)
            continue
        if mark[0] in "।॥؟":
            cuts.append(k)
            continue
        if mark[0] in ";;":
            if spaced:
                cuts.append(k)
            continue
        if nxt in ",;:)]}" or nxt in "—–" and not (spaced and gap + 1 < n and (p[gap + 1] in "¿¡" or p[gap + 1].isupper() or p[gap + 1] in SPACE and opening(p, gap)[:1].isupper())):
            continue
        cased = nxt.isupper() or nxt in "¿¡—–" or nxt in PAIRS and nxt not in "([" or nxt in '"\'([#*_' and opening(p, gap)[:1].isupper()
        caseless = nxt.isalpha() and not nxt.isupper() and not nxt.islower()
        other = not nxt.isalnum() and nxt not in PAIRS and nxt not in "\"'“"
        fresh = cased or caseless or other and not CJK.match(p, gap)
        if "…" in mark or ".." in mark:
            if CJK.match(p, gap) and not spaced:
                continue
            if fresh and (spaced or quoted) or lower and spaced and begins:
                cuts.append(k)
            continue
        if mark[-1] in "!?" or "!" in mark or "?" in mark:
            if not spaced and not nxt.isupper() and nxt not in PAIRS and not CJK.match(p, gap):
                continue
            if quoted and (nxt.islower() and not (lower and begins)):
                continue
            if nxt.islower() and not lower and i and p[i - 1] in SPACE and p[i - 1] != "\n" and not begins:
                continue
            if CJK.match(p, gap) and quoted and not begins:
                continue
            cuts.append(k)
            continue
        # a full stop
        w = before(p, i)
        if not spaced:
            if CJK.match(p, gap) or not (nxt.isupper() or nxt in "“„«\"" and opening(p, gap)[:1].isupper()) or not CAPITAL.match(p, gap, gap + 3) or len(w) < 2 and not quoted:
                continue
            if "." in w and not begins and not quoted:
                continue
            if ADDRESS.search(p, max(0, i - 60), i):
                continue
        if w in ("#", "##"):
            if nxt.isdigit() or nxt.islower() and not lower:
                continue
            if w == "#" and not begins and (nxt.isupper() or nxt.islower()) and not quoted and own.capitals():
                continue
            if p[1 + max(p.rfind("\n", 0, i), p.rfind("\r", 0, i)) : i].strip().isdigit():
                continue
            cuts.append(k)
            continue
        low = w.lower()
        verdict = known.get("s:" + low, 0)
        if verdict == 0 and low in own.short:  # it may end a sentence only before a beginning, not before a name
            verdict = 1 if fresh and word not in own.names and (begins or word[:1].isupper() and word.lower() in own.small) else 2
        initial = len(w) == 1 and w.isupper() or len(w) == 1 and not w.islower() and w.isalpha()
        if verdict == 0 and initial:
            verdict = 2
        if quoted:
            if nxt.islower() and not (lower and begins):
                continue
            cuts.append(k)
            continue
        if verdict == 2:
            continue
        if verdict == 1:
            if fresh and not nxt.isdigit() or lower and begins:
                cuts.append(k)
            continue
        if nxt.isdigit() and not (len(w) > 3):
            continue
        if nxt.islower() and not lower and "." in w:
            continue
        cuts.append(k)
    if not plain and THAI.search(p):
        for m in THAI_GAP.finditer(p):
            if not hidden[m.start()]:
                cuts.append(m.start())
        for m in THAI_END.finditer(p):
            cuts.append(m.start())
    # line breaks that no line width explains
    if "\n" in p or "\r" in p:
        for m in BREAK.finditer(p.rstrip()):
            i, j = m.start(), m.end()
            if j >= n or i == 0 or hidden[i]:
                continue
            last = p[1 + max(p.rfind("\n", 0, i), p.rfind("\r", 0, i)) : i]
            rest = GRAPH.match(p, j)
            if rest is None or p[i - 1] in ",;،、-–(":
                continue
            fits = not wide or len(last) + 1 + len(rest[0]) <= SLACK * wide
            first = p[j + 1 : j + 2] if p[j] in PAIRS or p[j] in "\"¿¡" else p[j]
            small = first.islower() or not first.isalpha()
            if fits and (first.isupper() or not wide and (lower or not small)):
                cuts.append(i)
    return sorted(set(cuts))


def _around(inside: list[tuple[int, int]], i: int) -> list[tuple[int, int]]:
    return [(x, y) for x, y in inside if x < i < y]


def split(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, sent_start, sent_end`` of every sentence of every row of ``df``."""
    spark = df.sparkSession
    from tracemill.session import written

    verdicts = written(decided(written(gathered(df, text), "sums")), "verdicts")
    schema = df.select(key).schema.add("sent_start", "integer").add("sent_end", "integer")

    def emit(keys: list, units: list[list[tuple[int, int]]], kind: pa.DataType) -> pa.RecordBatch:
        flat = [(k, a, b) for k, u in zip(keys, units, strict=True) for a, b in u]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], kind), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.int32())], [key, "sent_start", "sent_end"])

    if verdicts.count() <= SENT_AT_ONCE:
        shared = spark.sparkContext.broadcast({r.word: r.verdict for r in verdicts.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield emit(b.column(0).to_pylist(), [sentences(t, shared.value) for t in b.column(1).to_pylist()], b.column(0).type)

        return df.select(key, text).mapInArrow(run, schema)

    # texts are told by their digest: keys may be null or repeated, and equal texts give equal units
    rows = df.select(key, text, F.md5(text).alias("_text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [(h, w) for h, t in dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)).items() for w in lookups(t)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.string())], ["_text", "word"])

    asked = rows.where("_text is not null").select("_text", text).mapInArrow(words, "_text string, word string").distinct()
    told = asked.join(verdicts, "word").groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("word", "verdict"))).alias("known"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            yield emit(b.column(0).to_pylist(), [sentences(t, dict(k or ())) for t, k in found], b.column(0).type)

    return rows.join(told, "_text", "left").select(key, text, "known").mapInArrow(run_joined, schema)
