"""The text operators on small fixtures, brute force and round trips, with their edge cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracemill.llm import bpe, consensus, mixture, pairs, sentences, truncation

PATH = f"{bpe.FOLDER}/byte_bpe_50k.tiktoken"


def brute(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_merges_equal_brute_force_and_decode():
    e = bpe.Encoder(PATH)
    words = {v: k for k, v in e.ranks.items()}
    r = random.Random(3)
    for n in (1, 2, 3, 17, 64, 200):
        raw = "".join(r.choice("abe théü漢字🙂  \n12") for _ in range(n))
        for piece in e.cut(raw):
            assert bpe.merged(piece.encode(), e.ranks) == brute(piece.encode(), e.ranks)
        assert b"".join(words[i] for i in e.encode(raw)).decode() == raw
    long = "ab" * 40_000
    assert b"".join(words[i] for i in e.encode(long)).decode() == long


def test_encode_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "hi <|endoftext|>", "x")], "doc_id int, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == [] and got[3] == [220] and 50256 not in got[4]
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def votes(n=400):
    r = random.Random(5)
    skill = {f"a{k}": v for k, v in enumerate([(0.95, 0.95), (0.92, 0.95), (0.9, 0.9), (0.7, 0.7), (0.97, 0.2), (0.1, 0.1)])}
    truth, rows = {}, []
    for i in range(n):
        truth[f"i{i}"] = t = r.random() < 0.6
        for a in r.sample(sorted(skill), 4):
            rows.append((f"i{i}", a, t if r.random() < skill[a][0 if t else 1] else not t, f"2026-03-0{r.randrange(1, 9)} 10:00:00"))
    return truth, rows


AUDIT = "audit_id string, annotator string, genuine_paste boolean, ts string"


def test_consensus_beats_majority(spark):
    truth, rows = votes()
    df = spark.createDataFrame(rows + [("i0", " A0", None, "2026-09-01 00:00:00"), ("none", "a1", None, None)], AUDIT)
    got = {r.audit_id: r for r in consensus.consensus(df).collect()}
    right = sum(got[k].consensus == v for k, v in truth.items()) / len(truth)
    yes = {k: sum(x for i, _, x, _ in rows if i == k) for k in truth}
    majority = sum((yes[k] > 2) == v for k, v in truth.items()) / len(truth)
    assert right >= 0.9 and right > majority
    assert got["none"].consensus is None and got["none"].n_labels == 0
    rel = {r.annotator: r.reliability for r in consensus.reliability(df).collect()}
    assert rel["A0"] > rel["A3"] > rel["A5"]


def test_latest_label_counts(spark):
    df = spark.createDataFrame([("i", "a", True, "2026-03-01T10:00:00.500Z"), ("i", "A ", False, "2026-03-01 10:00:01"), ("i", "a", True, "nonsense")], AUDIT)
    assert consensus.latest(df, "audit_id", "annotator", "genuine_paste", "ts").collect()[0].x is False
    assert consensus.consensus(df.limit(0)).count() == 0


def test_mix_holds_shares(spark):
    docs = spark.createDataFrame([(i, "x", "big", 10, i * 7919 % 104729 << 40) for i in range(300)] + [(1000 + i, "x", "small", 10, i * 104729 << 40) for i in range(20)], "doc_id long, text string, source string, n_tokens long, key long").drop("text")
    targets = spark.createDataFrame([("big", 50.0, 1), ("small", 50.0, 3), ("gone", 20.0, 2), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    got = {r.source: r for r in mixture.shares(docs, targets).collect()}
    assert got["small"].most_copies == 3 and got["small"].tokens == 600 and got["gone"].tokens == 0
    assert abs(got["big"].reached_share - 0.5) < 0.02 and got["gone"].target_share == 0
    assert mixture.mix(docs.limit(0), targets).count() == 0


CASES = "id string, artifact string, reference string, afterthought string, task_instruction string, source string"
ART = "The committee sorted the weekly rota with seperate notes. Our assistant checked the floor plan in a very unique way."
REF = "The committee sorted the weekly rota with separate notes. Our assistant checked the floor plan in a distinct way."


def test_cut_answers(spark):
    case = spark.createDataFrame([("s:1:clean:x", ART, None, "Call the dentist on Monday please.", "Fix this:", "s")], CASES)
    answers = {
        1: REF, 2: REF[:100], 3: REF[:-3].rsplit(" ", 1)[0][:90] + "...", 4: "The committee sorted the weekly rota with separate notes.", 5: REF + "\nCall the dentist on Monday please.",
        6: None, 7: "", 8: REF[:95] + "\n</artifact>", 9: ART,
    }
    res = spark.createDataFrame([(k, " S:1:clean:X", v, "extra") for k, v in answers.items()], "seq long, case_id string, response string, ckey string")
    assert sorted(r.seq for r in truncation.found(res, case).collect()) == [2, 3, 4, 8]
    assert truncation.found(res.limit(0), case).count() == 0
    assert {r.n_cut for r in truncation.shares(res, case, truncation.found(res, case)).collect()} == {4}


@pytest.mark.parametrize(("whole", "cut"), [
    ("{}委员会整理了每周的名册并检查平面图的尺寸。", "甲委员会整理了每周的名册并检查平面"), ("{}さんは毎週の名簿を整理しました。", "甲さんは毎週の名簿を整理し"), ("{} กรรมการตรวจแผนผังและจัดรายชื่อประจำสัปดาห์", "甲 กรรมการตรวจแผนผังและจัดราย"),
    ("Velm{} checked the Report, then left.", "Orsal checked the report"), ("Velm{} called it “a plain report” twice.", "Orsal called it “a plain report"),
])
def test_cut_answers_that_only_the_corpus_knows(spark, whole, cut):
    case = spark.createDataFrame([("s:1:clean:x", ART, None, None, "Fix this:", "s")], CASES)
    res = spark.createDataFrame([(i, "s:1:clean:x", whole.format(chr(0x5000 + i))) for i in range(120)] + [(500, "s:1:clean:x", cut)], "seq long, case_id string, response string")
    assert [r.seq for r in truncation.found(res, case).collect()] == [500]


def test_counts_decide_every_cut(spark, monkeypatch):
    case = spark.createDataFrame([("s:1:clean:x", ART, REF, "Call the dentist on Monday please.", "Fix this:", "s")], CASES)
    res = spark.createDataFrame([(1, "s:1:clean:x", REF), (2, "s:1:clean:x", REF[:100]), (3, "s:1:clean:x", REF[:70] + "\n\nI hope this helps!"), (4, None, REF[:100]), (5, "s:1:clean:x", REF + "\n\nI hope this helps!")], "seq long, case_id string, response string")
    assert sorted(r.seq for r in truncation.found(res, case).collect()) == [2, 3]
    whole = truncation.counted
    monkeypatch.setattr(truncation, "counted", lambda s: whole(s).limit(0))
    assert truncation.found(res, case).count() == 0


def test_marks_after_a_cut_of_any_length(spark):
    case = spark.createDataFrame([("s:1:clean:x", ART, REF, None, "Fix this:", "s")], CASES)
    res = spark.createDataFrame([(1, "s:1:clean:x", REF), (2, "s:1:clean:x", REF[:100] + " […]" + "\n" * 500 + "```"), (3, "s:1:clean:x", REF + " " * 500)], "seq long, case_id string, response string")
    assert [r.seq for r in truncation.found(res, case).collect()] == [2]


def test_whole_thai_answers_end_without_a_mark(spark):
    case = spark.createDataFrame([("s:1:clean:x", ART, None, None, "Fix this:", "s")], CASES)
    a, b = "กรรมการตรวจแผนผังแล้ว", "ทีมงานจัดรายชื่อประจำสัปดาห์"
    res = spark.createDataFrame([(i, "s:1:clean:x", f"{chr(0x5000 + i)} {a} {b}") for i in range(120)] + [(500, "s:1:clean:x", f"{b} {a}")], "seq long, case_id string, response string")
    assert truncation.found(res, case).count() == 0


def test_ends_are_joined_with_all_counts_at_once(spark):
    case = spark.createDataFrame([("s:1:clean:x", ART, REF, None, "Fix this:", "s")], CASES)
    res = spark.createDataFrame([(k, "s:1:clean:x", REF[: 40 + k]) for k in range(60)], "seq long, case_id string, response string")
    plan = truncation.judged(res, case)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 4  # the ends, the sizes of cases, the trigrams asked for and their counts


def test_words_are_runs_of_letters_marks_and_digits(spark):
    texts = ["", " _ ", "Two_words, it's 3.5x ", "ÉTÉ naïve é ½ Ⅳ", "委员会b整理", "กรรมการ ตรวจ", "İstanbul 🙂ok", "a­b​c", "राम है।"]
    words = [[], [], ["two", "words", "it", "s", "3", "5x"], ["été", "naïve", "é", "½", "ⅳ"], ["委", "员", "会", "b", "整", "理"], [*"กรรมการตรวจ"], ["i̇stanbul", "ok"], ["a", "b", "c"], ["राम", "है"]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").selectExpr("i", f"{truncation._words('t')} as w", f"{truncation._first_word('t')} as first").orderBy("i")
    got = df.collect()
    assert [r.w for r in got] == words and [r["first"] for r in got] == [(w or [""])[0] for w in words]


def test_pair_defects(spark):
    case = spark.createDataFrame([(f"s:{k}:clean:x", ART + f" Case {k}.", None, None, "Fix this text:", "s") for k in range(6)], CASES)
    answers = {
        1: REF, 2: None, 3: "```\n```" + " " * 300, 4: "Here is the revised version:\n\n", 5: "I'm sorry, but I cannot help with this request.", 6: "> " + ART.upper() + " CASE 1.", 7: "Fix this text:",
        8: FRENCH, 9: REF[:100], 10: REF + "\n\nI hope this helps!",
    }
    more = ["I cannot edit this.", "Sorry, I am unable to do that.", "I must decline.", "I'm sorry, but I can't help.", FRENCH, ART + " Case {}.", REF[:70], "Fix this text:", *EDITED]
    rows = [(100 + 20 * k + i, f"s:{k}:clean:x", a.format(k)) for k in range(6) for i, a in enumerate(more)]
    res = spark.createDataFrame([(k, "s:1:clean:x", v) for k, v in answers.items()] + rows + [(900, None, None), (901, "gone", "")], "seq long, case_id string, response string")
    got = {r.seq: r.defect for r in pairs.found(res, case).where("seq < 100 or seq >= 900").collect()}
    assert got == {2: "empty", 3: "empty", 4: "empty", 5: "refusal", 6: "copy", 7: "copy", 8: "language", 9: "truncated", 900: "empty", 901: "empty"}
    assert pairs.found(res.limit(0), case).count() == 0


REFUSALS = [f"{a} {b}" for a in ("Sorry,", "Unfortunately,", "I apologize;") for b in ("I cannot do this.", "I am unable to assist.", "I must decline.", "I can't help here.")]
EDITED = [REF, REF + " Done.", REF.replace("weekly", "whole"), REF.replace("floor ", ""), REF.replace("distinct", "simple"), REF.replace("notes", "slips")]
FRENCH = "Le comité a traduit le guide avant la réunion. La relectrice a vérifié le tableau avec beaucoup de soin."


def tagger(refusals=REFUSALS):
    rows = [(r, f"{ART} Case {i * 4 // len(refusals)}.", "Fix:", False) for i, r in enumerate(refusals)]
    for i in range(4):
        rows += [(x, f"{ART} Case {i}.", "Fix:", False) for x in (*EDITED, f"{ART} Case {i}.", FRENCH)] + [(REF[:60], f"{ART} Case {i}.", "Fix:", True)]
    return pairs.fit(rows)


def test_clauses_are_cut_alike_with_and_without_full_marks_and_in_time():
    texts = ["One.  Two?\n\nthree \n “Four!” five", "a .\x0b b…»\r\nc", " \n", "x.\n", "Ünd. \t so – weiter\n"]
    for t in texts:
        assert [c for c in pairs.clauses(t) if c] == [c for c in pairs.CLAUSE.split(t) if c]
        assert pairs.clauses(t + "。z")[-1] == "z"
    began = time.process_time()
    p = pairs.Prompt(ART, "Fix:")
    assert [len(p.cut("a" + " " * 60_000 + x)) for x in ("b", "b。c", "\nb", ". b")] == [1, 2, 2, 2]
    assert time.process_time() - began < 3


def test_labels_come_from_agreement():
    p = pairs.Prompt(ART, "Fix:")
    answers = [*EDITED, "I cannot do this.", FRENCH, ART, REF[:60]]
    got = pairs.labels(p, [p.cut(a) for a in answers], [a == REF[:60] for a in answers])
    assert [set(x) for x in got[-4:-1]] == [{pairs.R}, {pairs.N}, {pairs.E}] and got[-1][-1] == pairs.U and all(set(x) == {pairs.A} for x in got[:5])


def test_tags_decide_every_defect_but_empty():
    t, p = tagger(), pairs.Prompt(ART, "Fix:")
    rows = {"refusal": "Sorry, I am unable to do this.", "copy": "> " + ART.upper(), "language": FRENCH, "unfinished": REF[:60]}
    assert pairs.defects([(x, ART, "Fix:") for x in rows.values()], t) == list(rows)
    for want, x in rows.items():
        cs = p.cut(x)
        assert pairs.decide(p, cs, [pairs.A] * len(cs)) is None, want
    assert pairs.defects([("```", ART, "Fix:"), (None, None, None), ("", ART, None), ("x", None, None)], t)[:3] == ["empty"] * 3


def test_quoted_artifact_beside_an_edited_version_is_no_copy():
    got = pairs.defects([(x, ART, "Fix:") for x in (ART + "\n\n" + REF, ART, ART + "\n" + ART.upper(), "Fix:\n" + ART + "\nCall the dentist.")], tagger())
    assert got[0] != "copy" and got[1:] == ["copy"] * 3


def test_tagger_learns_held_out_rows():
    assert pairs.defects([("Sorry, I must decline to help here.", ART, "Fix:"), (REF, ART, "Fix:"), (EDITED[3], ART, "Fix:")], tagger(REFUSALS[1:])) == ["refusal", None, None]


def test_tagging_in_batches_equals_single_rows_and_long_texts():
    t = tagger()
    rows = [(x, ART, "Fix:") for x in (*REFUSALS, *EDITED, FRENCH, "", "```", REF * 500, "a" * 100_000)]
    assert pairs.defects(rows, t) == [pairs.defects([r], t)[0] for r in rows]


@pytest.mark.parametrize(("text", "units"), [
    ("One ends. Two asks? Yes!", ["One ends.", "Two asks?", "Yes!"]),
    ("He shouted “Stop! Now.” and left. Then (see Fig. 2.) it went on.", ["He shouted “Stop! Now.” and left.", "Then (see Fig. 2.) it went on."]),
    ("# Head\n- item one. more\n- item two\n\nPara without mark", ["# Head", "- item one. more", "- item two", "Para without mark"]),
    ("Text.\n```python\nx = 1. \n\ny\n```\nEnd.", ["Text.", "```python\nx = 1. \n\ny\n```", "End."]),
    ("他说：“太长了。删掉。”然后离开了。真的！", ["他说：“太长了。删掉。”然后离开了。", "真的！"]),
    ("ราคา 6.3 บาท ใครจะอ่าน", None), ("यह है। वह था।", ["यह है।", "वह था।"]), ("Ποιος θα; Εγώ.", ["Ποιος θα;", "Εγώ."]), ("It rose to 4.2. See a.b.com now", ["It rose to 4.2.", "See a.b.com now"]),
    ("", []), (None, []), (" \n​", []),
])
def test_sentences(text, units):
    got = sentences.sentences(text, {"s:fig": 2})
    if units is not None:
        assert [text[a:b] for a, b in got] == units


def test_abbreviations_come_from_the_corpus(spark):
    n = 40
    docs = [(i, f"Dr. Velm{i} came late. The others left, cf. the notes.\n\nThey said so.") for i in range(n)]
    df = spark.createDataFrame([*docs, (n, "It was Dr. Orsal. Nobody came.")], "doc_id int, text string")
    got = sentences.split(df, "doc_id", "text").where(F.col("doc_id") == n).orderBy("sent_start").collect()
    assert [(r.sent_start, r.sent_end) for r in got] == [(0, 17), (18, 30)]
    sentences.SENT_AT_ONCE, keep = -1, sentences.SENT_AT_ONCE
    try:
        assert sentences.split(df, "doc_id", "text").where(F.col("doc_id") == n).count() == 2
    finally:
        sentences.SENT_AT_ONCE = keep


def test_joined_verdicts_give_equal_sentences(spark):
    texts = ["他说：“太长了。”然后离开了。", "然后离开了。然后离开了。", "Das ist gut. well-known words stay. Well, they do.", "Dr. Velm came, cf. the notes.", "ราคา 6.3 บาท ใครจะอ่าน", "यह है। वह था।", "Ποιος θα; Εγώ.", "قال: “طويل.” ثم ذهب. عاد؟ نعم.", "Он сказал: «Хватит!» и ушёл. Потом вернулся.", "See e.g.the notes. It rose to 4.2. «Oui.» Puis il part.", "", None]
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 7, t) for i, t in enumerate(texts * 4)], "doc_id int, text string")
    whole = sorted(map(str, sentences.split(df, "doc_id", "text").collect()))
    sentences.SENT_AT_ONCE, keep = -1, sentences.SENT_AT_ONCE
    try:
        joined = sorted(map(str, sentences.split(df, "doc_id", "text").collect()))
    finally:
        sentences.SENT_AT_ONCE = keep
    assert joined == whole


def test_abbreviations_of_the_document_hold_in_all_its_paragraphs():
    shown, asked = "They met the abt. of Velm and the abt. of Orsal, as planned.", "It was abt. Orsal who came. We left the abt. The others stayed."
    got = [f[a:b] for f in [f"{shown}\n\n{asked}"] for a, b in sentences.sentences(f, {})]
    assert got == [shown, "It was abt. Orsal who came.", "We left the abt.", "The others stayed."]


def test_both_ways_to_the_verdicts_agree_on_a_whole_table(spark):
    import pathlib

    path = "/root/testdata/sf0.001/documents.parquet"
    if not pathlib.Path(path).exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(path)
    whole = sorted(map(tuple, sentences.split(docs, "doc_id", "text").collect()))
    sentences.SENT_AT_ONCE, keep = -1, sentences.SENT_AT_ONCE
    try:
        joined = sorted(map(tuple, sentences.split(docs, "doc_id", "text").collect()))
    finally:
        sentences.SENT_AT_ONCE = keep
    assert joined == whole and len(whole) > 100
