r"""Defects of prompt and answer pairs, by clauses tagged with a conditional random field.

An answer is cut into clauses at end marks and line breaks. A linear-chain conditional random field
tags each as answer, refusal, echo, foreign or unfinished from features of the clause: its words, its
language against the wanted one, how much of it the artifact holds and where, whether it stands
verbatim in the artifact or the instruction, its end, its place, and what the others of the answer are.

It is fitted with stochastic gradients on all answers to a bounded number of cases (``SAMPLE``, by hash;
one documented bound, whatever the size of the tables). The labels don't come from those features but
from how the answers to one case agree: an answer that shares next to nothing with the others is a
refusal if it is short beside them and foreign if not; clauses of an answer that gives the artifact
back where the others changed it are echoes; the last clause of an answer whose end its case's texts run
on from (``truncation``) is unfinished; all else is answer. All rows are tagged, in batches.

A pair's defect is the first that holds: ``empty`` (no clause is left without blanks, wrappers, opening
lines and placeholders), ``refusal`` (refusing clauses cover what isn't a remark), ``copy`` (echoes cover
it; then, as an exact check, the whole artifact or the instruction must be there), ``language`` (foreign
clauses cover most; then, as an exact check, another language must show in them), ``truncated`` (a clause
is unfinished; then, as an exact check, ``truncation`` must say so too).

Edge cases: a null answer is empty. An answer to an unknown case can be empty, a refusal or
truncated. A null artifact or instruction takes part in no comparison. Code has no language. Equal
answers to one prompt are tagged once. Whole answers are read. An empty table gives an empty result.
"""

from __future__ import annotations

import re as plain
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.spelling import squeezed
from tracemill.llm import truncation
from tracemill.session import drop_written, mark, sized_broadcast, written

#: Answers that the tagger is fitted on (all those to some cases), steps taken (as many at every size), their length, places of features.
SAMPLE, STEPS, STEP, PLACES = 6000, 12000, 0.15, 1 << 13
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
A, R, E, N, U = range(5)
#: Least part of an answer that must be refusing, an echo, or foreign.
REFUSES, COPIES, FOREIGN = 0.6, 0.6, 0.6
#: Share of an answer's word pairs that others know, below which it stands alone; its length beside theirs below which it is short, above which long.
ALONE, SHORT, LONG = 0.25, 0.35, 0.6
#: Weight against ``answer`` at an answer's end: an exact check of unfinished ends follows, so doubt counts for them.
LEAN = 3.0

#: Cases whose keys are sent to all tasks (some 30 MB); of more cases the keys are joined.
KEYS = 500_000

#: Ends of clauses: an end mark (and a closing quote) before a blank, a full-width mark, a line break.
CLAUSE = plain.compile(r"(?<=[.!?…])\s+|(?<=[.!?…][\"”’»)])\s+|(?<=[。！？।؟])(?=[^”」』）])|(?<!\s)\s*[\r\n]+\s*")
#: The same for texts without full-width marks: only the first of some blanks is looked at, where ``CLAUSE`` tries every sign.
BLANK = plain.compile(r"\s(?<!\s\s)(?:(?<=[.!?…]\s)\s*|(?<=[.!?…][\"”’»)]\s)\s*|(?<=[\r\n])\s*|\s*[\r\n]\s*)")
FULL = plain.compile(r"[。！？।؟]")
#: What doesn't count as an edit: layout, quoting and emphasis.
LAYOUT = re.compile(r"[\s\p{Z}\p{Cf}\"'“”„‘’«»`>*~|]+")
LAYOUT_ASCII = {i: None for i in range(128) if LAYOUT.match(chr(i))}
INVISIBLE = re.compile(r"[\s\p{Z}\p{Cc}\p{Cf}\p{Mn}]+")
WRAPPER = re.compile(r"```[\w+-]*|~~~|</?[\p{L}][^<>]{0,60}>|[\"“”'‘’`*_#>{}\[\]()|-]")
#: Placeholders for an answer, opening lines and remarks (fixed lists).
PLACEHOLDER = re.compile(r"(?:null|none|nil|n/?a|undefined|nan|empty|no (?:content|answer|response|output)|tbd|todo|placeholder|\.+|…+)?[.!…]*", re.I)
OPENING = re.compile(r"(?:(?:sure|certainly|of course|okay|ok|absolutely|gladly|claro|gerne|natürlich|bien sûr|voici|hier ist|aquí)\b[^\n:.!]{0,40}[:.!]?|(?:here(?: is|['’]s)|below is|this is|revised|edited|corrected|updated|final|the (?:revised|edited|corrected))\b[^\n:]{0,60}:|[^\n:.]{0,40}\bhere (?:is|are)\b[^\n:.]{0,40}[:.])", re.I)
REMARK = re.compile(r"(?:i hope|let me know|feel free|is there anything|please (?:tell|let)|happy to|i (?:fixed|changed|made|corrected|shortened|kept)|you asked)\b", re.I)
#: Frequent short words by which languages in Latin script are told apart (fixed lists).
COMMON = {
    "en": "the and of to in was is were that with for because it on as this by not a if until since although before are be from under have",
    "de": "der die das und hat ist nicht den dem mit zum zur im auf von ein eine vor nach ohne wie für sich kann ich diesen",
    "fr": "le la les des et une pour avec sans dans est sur au aux du que qui ne pas à son malgré avant après ce je",
    "es": "el la los las una y con por para sin del que al se de no es su en antes después muy este lo",
    "it": "il lo gli una con per che del della di è non sono nel alla dei", "pt": "o os as uma com por para que do da não em ao dos é",
}
OF_WORD: dict[str, list[str]] = {}
for _l, _ws in COMMON.items():
    for _w in _ws.split():
        OF_WORD.setdefault(_w, []).append(_l)
SCRIPTS = [("zh", r"\p{Han}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("ru", r"\p{Cyrillic}"), ("el", r"\p{Greek}"), ("ar", r"\p{Arabic}"), ("hi", r"\p{Devanagari}"), ("th", r"\p{Thai}"), ("ko", r"\p{Hangul}"), ("he", r"\p{Hebrew}")]
SCRIPTS = [(k, re.compile(p)) for k, p in SCRIPTS]
#: Names of languages in instructions (fixed list).
NAMED = {"german": "de", "french": "fr", "spanish": "es", "english": "en", "italian": "it", "portuguese": "pt", "russian": "ru", "greek": "el", "arabic": "ar", "hindi": "hi", "chinese": "zh", "japanese": "ja", "thai": "th", "korean": "ko", "hebrew": "he", "deutsch": "de", "französisch": "fr", "englisch": "en", "spanisch": "es", "español": "es", "inglés": "en", "francés": "fr", "alemán": "de", "anglais": "en", "allemand": "de", "espagnol": "es", "français": "fr"}
NAMING = {k: re.compile(rf"\b(?:into|in|to|a|an|auf|ins|en|al?|au)\s+{k}\b|\b{k}\s+version\b") for k in NAMED}
WORDS = re.compile(r"[\p{L}\p{M}'’]+|\d+")


@lru_cache(200_000)
def language(s: str) -> str:
    """The language of a piece of text, '' if it doesn't show. Quoted foreign words are outweighed."""
    if not s.isascii():
        counts = [(len(p.findall(s)), k) for k, p in SCRIPTS]
        most = max(counts)
        if most[0] * 2 > sum(c.isalpha() for c in s) * (0.5 if most[1] in ("zh", "ja") else 1):
            return "ja" if most[1] == "zh" and counts[1][0] else most[1]
    votes: dict[str, float] = {}
    for w in s.lower().split():
        if ls := OF_WORD.get(w.strip(".,;:!?\"'()“”«»„")):
            for k in ls:
                votes[k] = votes.get(k, 0) + 1 / len(ls)
    if not votes:
        return ""
    best = sorted(votes.items(), key=lambda x: -x[1])
    return best[0][0] if len(best) == 1 or best[0][1] > best[1][1] else ""


@lru_cache(100_000)
def word_place(w: str) -> int:
    """The place of a word's feature."""
    return 64 + crc32(w.encode()) % (PLACES - 64)


def bare(s: str) -> str:
    return (s.translate(LAYOUT_ASCII) if s.isascii() else LAYOUT.sub("", s)).lower()


def clauses(s: str) -> list[str]:
    """The clauses of a text."""
    return (BLANK if s.isascii() or not FULL.search(s) else CLAUSE).split(s)


def hollow(s: str) -> bool:
    """Nothing but blanks, invisible signs, wrappers, an opening line or a placeholder."""
    s = INVISIBLE.sub(" ", WRAPPER.sub(" ", s)).strip()
    return not s or bool(PLACEHOLDER.fullmatch(s) or OPENING.fullmatch(s))


class Clause:
    """What one clause is beside its prompt, whatever answer it stands in; ``static`` are its features."""

    __slots__ = ("asked", "bare", "foreign", "hollow", "last", "open", "pairs", "remark", "share", "size", "static", "verbatim", "weight")

    def __init__(self, text: str, prompt: Prompt) -> None:
        self.size, self.bare = len(text), bare(text)
        self.hollow = hollow(text)
        self.remark = bool(REMARK.match(text) or OPENING.fullmatch(text))
        self.verbatim = len(self.bare) > 3 and self.bare in prompt.art
        self.asked = len(self.bare) > 3 and (self.bare in prompt.ask or len(prompt.ask) > 10 and prompt.ask in self.bare and len(self.bare) < 2 * len(prompt.ask))
        ws = WORDS.findall(text.lower())
        self.pairs = list(zip(ws, ws[1:], strict=False)) or [(w, "") for w in ws]
        at = [prompt.pairs[p] for p in self.pairs if p in prompt.pairs]
        self.share = 3 if self.verbatim else 0 if not at else 1 if 2 * len(at) < len(self.pairs) else 2
        lang = language(text)
        self.foreign = bool(lang and prompt.want and lang != prompt.want and not prompt.code)
        self.open = text[-1].isalnum() or text[-1] in ",-"
        self.last = bool(at) and max(at) >= prompt.words - 3 or self.verbatim and prompt.art.endswith(self.bare)
        f = [0, 1 + self.share, 6 + self.foreign, 8 + self.remark, 10 + self.open, 12 + self.asked, 14 + self.last]
        # the words of a clause that the artifact holds say nothing of the answer
        self.static = np.array([*f, *{word_place(w) for w in ws}] if self.share < 2 else f)
        self.weight: np.ndarray | None = None


class Prompt:
    """An artifact and an instruction, and the clauses seen in answers to them."""

    def __init__(self, artifact: str | None, instruction: str | None) -> None:
        artifact, instruction = artifact or "", instruction or ""
        low = instruction.lower()
        self.code = bool(re.search(r"(?m)^\s*(?:def |class |return\b|import |for .*:$)|[;{}]\s*$", artifact))
        named = next((NAMED[k] for k, x in NAMING.items() if k in low and x.search(low)), "")
        ws = WORDS.findall(artifact.lower())
        self.pairs = {p: i for i, p in enumerate(zip(ws, ws[1:], strict=False))}
        self.words = len(ws)
        self.art, self.ask = bare(artifact), bare(instruction)
        self.want = named or language(re.sub(r"[“«„「][^”»“」]*[”»“」]", " ", artifact))
        self.clauses: dict[str, Clause] = {}

    def cut(self, answer: str) -> list[Clause]:
        """The clauses of an answer; those with nothing visible are left out."""
        out = []
        for c in clauses(answer):
            k = self.clauses.get(c)
            if k is None:
                if not c or not c[0].isalnum() and INVISIBLE.fullmatch(c):
                    continue
                k = self.clauses[c] = Clause(c, self)
            out.append(k)
        return out


def places(p: Prompt, clauses: list[Clause]) -> list[int]:
    """A number for each clause that stands for its place and the rest of its answer (see ``place_features``)."""
    n = len(clauses)
    text = "".join(c.bare for c in clauses)
    whole = len(p.art) > 20 and p.art in text
    told = sum(len(c.bare) for c in clauses if c.verbatim)
    part = 3 * told // max(1, len(text))  # 0 to 3
    new = all(c.share < 2 for c in clauses)
    rest = [i for i, c in enumerate(clauses) if not (c.remark or c.hollow)]
    end = rest[-1] if rest else n - 1
    return [((((min(n, 5) * 4 + part) * 2 + whole) * 2 + new) * 2 + (i == 0)) * 8 + ((i == end) * (1 + c.open + 2 * c.last)) + 0 for i, c in enumerate(clauses)]


def place_features(code: int) -> list[int]:
    """Features of the number of ``places``: of the end, the first place, novelty, the whole artifact, verbatim part, length."""
    end, rest = code % 8, code // 8
    first, rest = rest % 2, rest // 2
    new, rest = rest % 2, rest // 2
    whole, rest = rest % 2, rest // 2
    part, n = rest % 4, rest // 4
    return [16 + end, 24 + first, 26 + new, 28 + whole, 30 + part, 34 + n, 40 + (end if part > 0 else 7), 48 + 4 * whole + part]


class Tagger:
    """Linear-chain conditional random field over hashed features."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None) -> None:
        self.w = np.zeros((PLACES, 5)) if weights is None else weights
        self.t = np.zeros((5, 5)) if moves is None else moves
        self.of_place: dict[int, np.ndarray] = {}

    def step(self, feats: list[np.ndarray], gold: list[int], rate: float) -> None:
        """One gradient step on the log-likelihood, by forward and backward sums."""
        e = np.array([self.w[f].sum(0) for f in feats])
        n = len(e)
        fwd, bwd = np.zeros((n, 5)), np.zeros((n, 5))
        fwd[0] = e[0]
        for i in range(1, n):
            m = fwd[i - 1][:, None] + self.t
            top = m.max(0)
            fwd[i] = top + np.log(np.exp(m - top).sum(0)) + e[i]
        for i in range(n - 2, -1, -1):
            m = self.t + (e[i + 1] + bwd[i + 1])[None]
            top = m.max(1)
            bwd[i] = top + np.log(np.exp(m - top[:, None]).sum(1))
        top = fwd[-1].max()
        z = top + np.log(np.exp(fwd[-1] - top).sum())
        p = np.exp(fwd + bwd - z)
        for i, (f, g) in enumerate(zip(feats, gold, strict=True)):
            d = -p[i]
            d[g] += 1
            self.w[f] += rate / np.sqrt(len(f)) * d
        for i in range(1, n):
            q = np.exp(fwd[i - 1][:, None] + self.t + e[i][None] + bwd[i][None] - z)
            self.t -= rate * 0.2 * q
            self.t[gold[i - 1], gold[i]] += rate * 0.2

    def emissions(self, clauses: list[Clause], codes: list[int]) -> np.ndarray:
        """A row of weights for each clause at its place; those of a clause are summed once."""
        for c in clauses:
            if c.weight is None:
                c.weight = self.w[c.static].sum(0)
        for code in set(codes) - self.of_place.keys():
            self.of_place[code] = self.w[place_features(code)].sum(0) + (-LEAN * (np.arange(5) == A) if code % 8 else 0)
        return np.array([c.weight for c in clauses]) + np.array([self.of_place[k] for k in codes])

    def tag(self, answers: list[tuple[Prompt, list[Clause]]]) -> list[list[int]]:
        """The likeliest tags of many answers at once."""
        lens = np.array([len(c) for _, c in answers], np.int64)
        if not lens.sum():
            return [[] for _ in answers]
        flat = self.emissions([c for _, cs in answers for c in cs], [k for p, cs in answers if cs for k in places(p, cs)])
        starts = np.cumsum(lens) - lens
        order = np.argsort(-lens, kind="stable")  # longest first, so that the running ones are always a prefix
        lens_, starts_ = lens[order], starts[order]
        live = int((lens_ > 0).sum())
        best = flat[starts_[:live]].copy()
        back = []
        for i in range(1, int(lens_[0])):
            live = int((lens_ > i).sum())
            m = best[:live, :, None] + self.t
            back.append(m.argmax(1))
            best[:live] = m.max(1) + flat[starts_[:live] + i]
        # back from each answer's end, all that reach a place at once
        tags = np.zeros(len(flat), np.int64)
        tags[(starts_ + lens_ - 1)[: len(best)]] = best.argmax(1)
        for i in range(len(back) - 1, -1, -1):
            at = starts_[: len(back[i])] + i
            tags[at] = back[i][np.arange(len(at)), tags[at + 1]]
        told = tags.tolist()
        return [told[a : a + n] for a, n in zip(starts.tolist(), lens.tolist(), strict=True)]


def labels(p: Prompt, answers: list[list[Clause]], cut: list[bool]) -> list[list[int] | None]:
    """Labels of the clauses of all answers to one prompt, by how they agree; none for empty ones."""
    m = len(answers)
    same = Counter(b for cs in answers for b in {c.bare for c in cs})
    known = Counter(x for cs in answers for x in {x for c in cs for x in c.pairs})
    least = 1 + max(1, 0.15 * (m - 1))
    parts = []
    for cs in answers:
        pairs = [x for c in cs if not c.remark for x in c.pairs]
        parts.append(sum(known[x] > least for x in pairs) / len(pairs) if pairs else 1.0)
    size = lambda cs: sum(len(c.bare) for c in cs if not c.remark)
    agreed = sum(k >= ALONE for k in parts) * 2 >= m
    normal = [(size(cs), len(cs)) for cs, k in zip(answers, parts, strict=True) if k >= 0.5 or not agreed] or [(0, 0)]
    usual, number = (float(np.median(x)) for x in zip(*normal, strict=True))
    out: list[list[int] | None] = []
    for cs, part, is_cut in zip(answers, parts, cut, strict=True):
        told = [c for c in cs if not (c.remark or c.hollow)]
        changed = any(c.verbatim and same[c.bare] - 1 <= 0.5 * (m - 1) for c in told)
        back = changed and sum(len(c.bare) for c in told if c.verbatim or c.asked) >= 0.8 * sum(len(c.bare) for c in told)
        if all(c.hollow for c in cs):
            out.append(None)
        elif part < ALONE and not back:
            # where hardly any answers agree (translations), standing alone shows nothing
            # scripts differ in the letters they need, so the number of clauses counts too
            short, long = size(cs) < SHORT * usual and len(told) <= max(1.0, 0.5 * number), size(cs) >= LONG * usual or len(told) >= LONG * number
            tag = R if short else (N if agreed else A) if long else None
            out.append(None if tag is None else [E if c.asked else tag for c in cs])
        else:
            tags = [E if c.asked or back and c.verbatim else A for c in cs]
            if is_cut and told:
                tags[max(i for i, c in enumerate(cs) if c is told[-1])] = U
            out.append(tags)
    return out


def fit(rows: list[tuple[str, str | None, str | None, bool]]) -> Tagger:
    """Fit the tagger on (answer, artifact, instruction, whether cut) rows; their order doesn't matter."""
    groups: dict[tuple, dict[str, bool]] = {}
    for answer, art, ask, cut in sorted(rows, key=lambda r: (crc32(r[0].encode()), r[0], r[1] or "", r[2] or "")):
        groups.setdefault((art, ask), {})[answer] = cut
    plain_, special = [], []
    for (art, ask), answers in sorted(groups.items(), key=str):
        p = Prompt(art, ask)
        cs = [p.cut(a) for a in answers]
        for c, tags in zip(cs, labels(p, cs, list(answers.values())), strict=True):
            if c and tags:
                feats = [np.array([*k.static, *place_features(n)]) for k, n in zip(c, places(p, c), strict=True)]
                (plain_ if set(tags) == {A} and not all(k.share < 2 for k in c) else special).append((feats, tags))
    # as many unremarkable answers as others, so that steps aren't spent on them; translations are remarkable
    step = max(1, len(plain_) // max(1, len(special)))
    data = special + plain_[::step]
    data = [data[i] for i in np.random.default_rng(7).permutation(len(data))]
    tagger = Tagger()
    for k in range(STEPS if data else 0):
        tagger.step(*data[k % len(data)], STEP / (1 + k // 3000))
    return tagger


def decide(p: Prompt, clauses: list[Clause], tags: list[int]) -> str | None:
    """The defect that the coverage of an answer's tagged clauses shows; ``unfinished`` stands for what may be truncated."""
    left = [c for c in clauses if not c.hollow]
    if all(c.remark for c in left) and len(left) <= 2 and not any(c.asked for c in clauses):
        return "empty"
    part, rest, kept, echo, other, abroad = [0] * 5, 0, 0, 0, 0, 0
    for tag, c in zip(tags, clauses, strict=True):
        if c.hollow and not c.asked or c.remark and tag in (A, U):
            continue  # remarks and wrappers are no part of the answer
        part[tag] += c.size
        rest += c.size
        kept += c.size * (tag != R and c.share >= 2)
        abroad += c.size * (tag == N and c.foreign)
        if not c.asked:
            other += len(c.bare)
            echo += len(c.bare) * (tag == E)
    text = "".join(c.bare for c in clauses)
    if rest and part[R] >= REFUSES * rest and kept < 0.2 * rest:
        return "refusal"
    # clauses that an edited version leaves as they are echo nothing more than the quoted artifact
    if len(p.art) > 20 and other and min(echo, text.count(p.art) * len(p.art)) >= COPIES * other:
        return "copy"
    if p.ask and part[E] >= COPIES * rest and p.ask in text:
        return "copy"
    if rest and part[N] >= FOREIGN * rest and 2 * abroad >= part[N]:
        return "language"
    return "unfinished" if U in tags else None


def defects(rows: list[tuple[str | None, str | None, str | None]], tagger: Tagger, prompts: dict | None = None) -> list[str | None]:
    """The defects of (answer, artifact, instruction) rows. Rows of one prompt should follow one another: its clauses are kept only so long."""
    out: list[str | None] = [None] * len(rows)
    todo: list[tuple[int, Prompt, list[Clause]]] = []
    key, p = None, None
    for i, (answer, art, ask) in enumerate(rows):
        if answer is None:
            out[i] = "empty"
            continue
        if p is None or key != (art, ask):
            key, p = (art, ask), Prompt(art, ask)
        todo.append((i, p, p.cut(answer)))
    for (i, p, cs), tags in zip(todo, tagger.tag([(p, cs) for _, p, cs in todo]), strict=True):
        out[i] = decide(p, cs, tags)
    return out


def found(results: DataFrame, cases: DataFrame) -> DataFrame:
    """``seq, defect`` of the defective rows of results."""
    spark = results.sparkSession
    before = mark()
    cut = written(truncation.judged(results, cases).where("cut").select("ckey", "eid"), "cut")
    drop_written(before, 1)
    case = cases.where("id is not null").select(squeezed(F.col("id")).alias("case_key"), "artifact", "task_instruction").dropDuplicates(["case_key"])
    prompt = case.withColumn("pk", F.xxhash64(F.coalesce("artifact", F.lit("\0")), F.coalesce("task_instruction", F.lit("\0"))))
    prompt = written(prompt, "prompts")
    keys = sized_broadcast(prompt.select("case_key", "pk"), prompt.count(), KEYS)
    key = F.expr(f"coalesce({truncation.cluster('case_key')}, '')").alias("ckey")
    rows = results.select("seq", squeezed(F.col("case_id")).alias("case_key"), "response").join(keys, "case_key", "left").select("seq", "pk", key, "response")
    eid = F.when(F.col("response").isNotNull(), F.xxhash64("response")).otherwise(0)
    # answers to one prompt lie together, and each is tagged once
    texts = rows.groupBy("pk", "response").agg(F.min("ckey").alias("ckey"))
    prompts = prompt.groupBy("pk").agg(F.first("artifact").alias("artifact"), F.first("task_instruction").alias("task_instruction"))
    spread = F.coalesce("pk", F.xxhash64("response")).alias("_j")  # answers without a prompt don't meet in one task
    pairs = written(texts.select("*", spread).join(prompts.withColumnRenamed("pk", "_j").hint("merge"), "_j", "left").select("pk", "ckey", eid.alias("eid"), "response", "artifact", "task_instruction"), "pairs")
    sizes = pairs.where("pk is not null and response is not null").groupBy("pk").agg(F.count("*").alias("n")).where(f"n <= {SAMPLE // 4}")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    near = sizes.where(F.expr(f"pmod(xxhash64(pk, 'fit'), 1000000) < {int(1_000_000 * min(1.0, SAMPLE / max(1, total)))}")).select("pk")
    sample = pairs.join(near, "pk", "left_semi").where("response is not null").join(cut.withColumn("cut", F.lit(True)), ["ckey", "eid"], "left")
    tagger = fit([(r[0], r[1], r[2], bool(r[3])) for r in sample.select("response", "artifact", "task_instruction", "cut").limit(2 * SAMPLE).collect()])
    shared = spark.sparkContext.broadcast((tagger.w.astype(np.float32), tagger.t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tagger(*shared.value)
        for b in batches:
            got = defects(list(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)), t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], ["pk", "eid", "defect"])

    told = pairs.select("pk", "eid", "response", "artifact", "task_instruction").mapInArrow(run, "pk long, eid long, defect string").where("defect is not null")
    # a null key is a prompt of its own: no artifact and no instruction
    none = F.coalesce("pk", F.lit(0)).alias("pk")
    told = written(told.select(none, "eid", "defect"), "told")
    placed = rows.select("seq", none, "ckey", eid.alias("eid")).join(told, ["pk", "eid"])
    checked = placed.join(cut.withColumn("cut", F.lit(True)), ["ckey", "eid"], "left")
    return checked.where("defect <> 'unfinished' or cut").select("seq", F.when(F.col("defect") == "unfinished", "truncated").otherwise(F.col("defect")).alias("defect"))
