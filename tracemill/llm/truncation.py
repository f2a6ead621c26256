r"""Answers whose text was cut off, found by word trigrams that run on elsewhere but hardly ever end a text.

Pure SQL. All distinct answers and the artifacts, references and afterthoughts of the cases are read as
words (single signs in scripts without spaces, case and marks aside), and one pass counts
every trigram of every text: how often it stands in it, how often as its end, how often near its end.
The counts are kept per case (answers to one case are versions of one text) and are summed over the
corpus. The trigram at an answer's end is joined with them, and the counts decide:

* in the own case: the trigram is frequent (it runs on in a share ``FREQUENT`` of the case's answers) and
  hardly ever an end (``RARELY_LAST``): cut. It is the end of one of the case's own texts: whole.
* if the case doesn't know it, its third word may be a piece of one: trigrams with the same first two
  words whose third begins like it are counted instead; or an edited word stands at the end: the last
  known of the trigrams that leave out up to ``BACK`` words is counted, and must hardly ever be near an end.
* a last paragraph that no other text of the case goes on with may have been added: then the end before
  it is judged too, by the same counts.
* what the case doesn't know at all (translations, remarks) is asked of the corpus in the same way; there
  the share of ends must be low with confidence (Wilson's upper bound) and the answer has no end mark.

All bounds are shares, so a verdict doesn't hang on the corpus' size. Closing marks (fences, tags, notes
of truncation) that may be added after a cut are taken off first.

Edge cases: null, empty and blank answers are no case (there is no text to be cut), nor are answers of
fewer than three words that nothing continues. Null case ids are judged by the corpus alone, unknown
ones also by the other answers to them. Repeated deliveries are judged one by one and alike, and count as
one text. Extra columns are ignored. Whole texts are counted. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.spelling import squeezed
from tracemill.session import drop_written, mark, sized_broadcast, written

#: Last words that may be left out to find a known trigram, and words by which an edited ending may be shorter.
BACK, EDIT = 5, 5
#: Part of a case's answers that a trigram must run on in to be frequent, and largest share of ends among its places.
FREQUENT, RARELY_LAST = 0.3, 0.1
#: Upper bound of the share of ends among a trigram's places in the corpus.
CORPUS_LAST = 0.25
#: Texts of one case that are counted in one partition; a case with more is split.
TOGETHER = 20_000
# The patterns of an end are written backwards and read from the start of the reversed text, so that they cost what they match.
#: Tags and notes that may be added after a cut (with letters, so that they would be taken for words).
ADDED = r"^(?:[^\p{L}\p{N}>)\]]*+(?:>[\p{L}\d_-]+/?<|[)\]](?i:tuc|erom|detacnurt|deunitnoc)[(\[]))+"
#: Closing marks, and an end mark before them.
STOPPED = r"^(?:\s|```|~~~|>[\p{L}\d_-]+/?<|[)\]](?i:tuc|erom|detacnurt|deunitnoc|[^\p{L}\p{N}\s]*)[(\[]|\.{2,}|…|[\"”’»」』*_])*+[.!?。！？।؟;；:)）\]}]"
#: The last words of a text.
LAST = r"^(?:[^a-z\p{L}\p{M}\p{N}]*+[a-z\p{L}\p{M}\p{N}]++){0,%d}"
#: A word in lower case. Latin letters and digits are listed, as a list is looked up at once and a range or a property is called for every sign.
WORD = r"[[abcdefghijklmnopqrstuvwxyz0123456789][\p{L}\p{M}\p{N}]]+"
#: Signs that are words by themselves (Thai, Kana and Han; ranges are much faster than scripts).
SIGN = r"[\x{0E01}-\x{0E5B}\x{3041}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
#: Thai has no end mark: a blank between its letters ends a sentence, so the words before it are an end too.
THAI = r"[\x{0E01}-\x{0E5B}]"
THAI_GAP = rf"(?<={THAI})\s+(?={THAI})"


def _lowered(c: str) -> str:
    """A text in lower case, signs that are words set apart (texts in ASCII have none)."""
    return f"lower(if(octet_length({c}) > length({c}) and {c} rlike r'{SIGN}', regexp_replace({c}, r'({SIGN})', ' $1 '), {c}))"


def _words(c: str) -> str:
    """Array of the words of a text."""
    return f"regexp_extract_all({_lowered(c)}, r'{WORD}', 0)"


def _first_word(c: str) -> str:
    """The first word of a text, '' if it has none."""
    return f"regexp_extract({_lowered(c)}, r'{WORD}', 0)"


def _gram(k: str) -> str:
    """Hash of the first two words, and the third, of the trigram that leaves out the last ``k`` words of ``w``."""
    return f"case when size(w) >= {k} + 3 then xxhash64(get(w, size(w) - {k} - 3), get(w, size(w) - {k} - 2)) end as ab, get(w, size(w) - {k} - 1) as c"


def _rarely(last: str, n: str) -> str:
    """Wilson's upper bound of the share ``last / n`` is low (false for n = 0)."""
    z = 1.96**2
    return f"({n} > 0 and ({last} + {z / 2} + 1.96 * sqrt({last} * (1 - {last} / greatest({n}, 1)) + {z / 4})) / ({n} + {z}) <= {CORPUS_LAST})"


def cluster(case_id: str) -> str:
    """A case's key without its condition and digest (``source:number``), or the whole key if it has no such form."""
    return rf"regexp_replace({case_id}, '^([^:]+:[^:]+):.*$', '$1')"


def views(results: DataFrame, cases: DataFrame) -> SparkSession:
    """``_cut_rows``: the answers with the key of their case ('' for null); ``_cut_texts``: the distinct texts of each case."""
    spark = results.sparkSession
    results.where("response is not null").select("seq", squeezed(F.col("case_id")).alias("_k"), "response").createOrReplaceTempView("_cut_answers")
    cases.select(squeezed(F.col("id")).alias("_k"), "artifact", "reference", "afterthought").createOrReplaceTempView("_cut_cases")
    spark.sql(f"select seq, coalesce({cluster('_k')}, '') as ckey, response from _cut_answers").createOrReplaceTempView("_cut_rows")
    texts = spark.sql(rf"""
        select ckey, response as text, true as answer from _cut_rows where response rlike r'[\p{{L}}\p{{N}}]' group by ckey, response
        union all select distinct coalesce({cluster('_k')}, '') as ckey, text, false as answer from (select _k, explode(array(artifact, reference, afterthought)) as text from _cut_cases) where text is not null""")
    written(texts, "texts").createOrReplaceTempView("_cut_texts")
    return spark


def tails(spark: SparkSession) -> DataFrame:
    """``ckey, kh, eid, w, w1, p, stopped, stopped1``: the last words of each distinct answer and of it without its last paragraph.

    Left out are answers that end as the artifact, the reference or the afterthought of their case does: they are whole.
    A text is reversed once, and all is read from the start of ``r`` and of ``s``, the text and it without its last paragraph, backwards.
    """
    # last words go as one string through the join, which takes less room than an array
    end = lambda r: f"reverse(regexp_extract(regexp_replace({r}, r'{ADDED}', ''), r'{LAST % (BACK + 3)}', 0))"
    last_words = lambda w: f"array_join(slice({w}, greatest(size({w}) - {BACK + 2}, 1), {BACK + 3}), ' ')"
    apart = lambda w: f"split(nullif({w}, ''), ' ')"
    spark.sql(f"select distinct kh, {_gram('0')} from (select xxhash64(ckey) as kh, {_words('t')} as w from (select ckey, {end('reverse(text)')} as t from _cut_texts where not answer))").createOrReplaceTempView("_cut_sure")
    return spark.sql(rf"""
        with a as (select ckey, text, reverse(text) as r from _cut_texts where answer),
        b as (select *, xxhash64(text) as eid, nullif(regexp_extract(r, r'(?s)\n\s*\n\s*(\S.*)$', 1), '') as s from a),
        c as (select ckey, eid, {end('r')} as t, {end('s')} as t1, substr(text, length(s) + 1) as p, r rlike r'{STOPPED}' as stopped, coalesce(s rlike r'{STOPPED}', false) as stopped1 from b),
        d as (select *, {_words('t')} as w, {_words('t1')} as w1, nullif({_first_word('p')}, '') as p1 from c),
        e as (select ckey, xxhash64(ckey) as kh, eid, {last_words('w')} as w, {last_words('w1')} as w1, p1 as p, stopped, stopped1, {_gram('0')} from d),
        f as (select e.* from e left anti join _cut_sure s on e.kh = s.kh and e.ab = s.ab and e.c = s.c)
        select ckey, kh, eid, {apart('w')} as w, {apart('w1')} as w1, p, stopped, stopped1 from f""")


def asked(spark: SparkSession) -> None:
    """``_cut_asked``: the trigrams asked for (``v`` 0 the end, 1 the end before the last paragraph, 2 across it; ``k`` words left out)."""
    spark.sql(f"""
        with e as (select ckey, kh, eid, stopped, explode(array(struct(0 as v, w), struct(1 as v, w1 as w), struct(2 as v, array(get(w1, size(w1) - 2), get(w1, size(w1) - 1), p) as w))) as e from _cut_tails),
        f as (select ckey, kh, eid, stopped, e.v, e.w, explode(if(e.v = 2, array(0), sequence(0, {BACK}))) as k from e where size(e.w) >= 3)
        select ckey, kh, eid, v, k, stopped, {_gram('k')} from f where size(w) >= k + 3""").createOrReplaceTempView("_cut_asked")


def counted(spark: SparkSession) -> DataFrame:
    """``kh, ab, c, n, last, near``: each trigram (hash of two words, and the third) of each case, counted over all its texts.

    ``n`` places, ``last`` of them at an end, ``near`` near one.
    """
    sizes = spark.sql(f"select xxhash64(ckey) as kh, cast(ceil(count(*) / {TOGETHER}) as int) as parts from _cut_texts group by ckey having count(*) > {TOGETHER}")
    texts = spark.sql("select xxhash64(ckey) as kh, text from _cut_texts").join(sized_broadcast(sizes, sizes.count()), "kh", "left")
    texts.select("kh", F.expr("pmod(xxhash64(text), coalesce(parts, 1))").alias("salt"), "text").repartition("kh", "salt").createOrReplaceTempView("_cut_spread")
    # the texts of a case lie together, so its trigrams shrink to their counts before they are shuffled;
    # outer explodes, as plain ones are computed twice: once more in a filter that Spark puts before them
    spark.sql(rf"""
        with pieces as (select kh, salt, explode_outer(case when octet_length(text) > length(text) and text rlike r'{THAI}' then split(text, r'{THAI_GAP}') else array(text) end) as text from _cut_spread),
        bare as (select kh, salt, if(text rlike r'[>)\]][^\p{{L}}\p{{N}}]*+$', reverse(regexp_replace(reverse(text), r'{ADDED}', '')), text) as text from pieces),
        words as (select kh, salt, {_words('text')} as w from bare),
        beside as (select kh, salt, size(w) - 3 as m, {', '.join(f'slice(w, {k + 1}, greatest(size(w) - 2, 0)) as {x}' for k, x in enumerate('abc'))} from words),
        grams as (select kh, salt, m, posexplode_outer(arrays_zip(a, b, c)) as (i, x) from beside)
        select kh, xxhash64(x.a, x.b) as ab, x.c, count(*) as n, count_if(m = i) as last, count_if(m - i <= {BACK + EDIT}) as near from grams where x is not null group by kh, salt, xxhash64(x.a, x.b), x.c""").createOrReplaceTempView("_cut_partial")
    return spark.sql("select kh, ab, c, sum(n) as n, sum(last) as last, sum(near) as near from (select /*+ REPARTITION(kh, ab) */ * from _cut_partial) group by kh, ab, c")


def told(spark: SparkSession) -> DataFrame:
    """The counts ``kh, ab, c, n, last, near`` of the trigrams asked for in their case (``own``), or of the corpus (``everywhere``).

    Both are null where not asked for, and true where the third word may be a piece of a longer one (only those of whole ends may).
    """
    counted(spark).createOrReplaceTempView("_cut_counts")
    of_corpus = written(spark.sql("select ab, bool_or(k = 0) as everywhere from _cut_asked where v = 0 and k <= 1 and not stopped group by ab"), "asked")
    sized_broadcast(of_corpus, of_corpus.count(), 1_000_000).createOrReplaceTempView("_cut_asked_ab")
    # outer joins, as inner ones would be pushed below the count, which would then be made for each of them
    return spark.sql("""
        select c.*, o.own, e.everywhere from _cut_counts c left join (select kh, ab, bool_or(k = 0 and v < 2) as own from _cut_asked where ckey <> '' group by kh, ab) o on c.kh = o.kh and c.ab = o.ab left join _cut_asked_ab e on c.ab = e.ab
        where o.own is not null or e.everywhere is not null""")


def judged(results: DataFrame, cases: DataFrame) -> DataFrame:
    """``ckey, eid, cut`` of each distinct answer to a case whose end isn't one of the case's own texts' (``eid`` is its text's hash)."""
    spark = views(results, cases)
    written(tails(spark), "tails").createOrReplaceTempView("_cut_tails")
    spark.sql("select ckey, count(*) as answers from _cut_texts where answer group by ckey").createOrReplaceTempView("_cut_sizes")
    asked(spark)
    written(told(spark), "counts").createOrReplaceTempView("_cut_kept")
    # what is known of a trigram in a case, or in the corpus (kh 0): its counts, and how often longer words that begin like its
    # last one stand there (``piece``); each counted word gives its beginnings, so that both sides meet by equality
    spark.sql("""
        with scopes as (select ab, c, n, last, near, explode(filter(array(struct(kh, own as piece), struct(0L as kh, everywhere as piece)), x -> x.piece is not null)) as s from _cut_kept),
        begun as (select s.kh, ab, c, n, last, near, explode(sequence(if(s.piece, 1, length(c)), length(c))) as i from scopes)
        select kh, ab, left(c, i) as c, sum(if(i = length(c), n, 0)) as n, sum(if(i = length(c), last, 0)) as last, sum(if(i = length(c), near, 0)) as near, sum(if(i < length(c), n, 0)) as piece from begun group by kh, ab, left(c, i)""").createOrReplaceTempView("_cut_told")
    spark.sql("""
        with a as (select kh, eid, v, k, ab, c, explode(filter(array(if(ckey <> '', kh, null), if(v = 0 and k <= 1 and not stopped, 0L, null)), x -> x is not null)) as of from _cut_asked),
        b as (select a.kh, a.eid, a.v, a.k, a.of <> 0 as own, x.n, x.last, x.near, x.piece from a join _cut_told x on a.of = x.kh and a.ab = x.ab and a.c = x.c)
        select kh, eid, map_from_entries(collect_list(if(own and n > 0, struct(v * 10 + k, struct(n, last, near)), null))) as m, max(if(own and v = 0 and k = 0, piece, null)) as piece, max(if(own and v = 1 and k = 0, piece, null)) as piece1,
          max(if(not own and k = 0 and n > 0, n - 1, null)) as n0, max(if(not own and k = 0 and n > 0, last - 1, null)) as l0, max(if(not own and k = 1 and n > 0, n - 1, null)) as n1, max(if(not own and k = 1 and n > 0, last, null)) as l1, max(if(not own and k = 0, piece, null)) as corpus_piece
        from b group by kh, eid""").createOrReplaceTempView("_cut_known")

    def rule(v: int, stopped: str, piece: str) -> str:
        """Whether the end ``v`` is cut by the counts of its own case: null where it doesn't know; an answer's own place is taken off."""
        at = lambda k: f"try_element_at(m, {10 * v + k})"
        n, last = f"(coalesce({at(0)}.n, 0) - 1)", f"greatest(coalesce({at(0)}.last, 0) - {1 - v}, 0)"
        many = lambda c: f"{c} >= {FREQUENT} * answers"
        back = f"coalesce({', '.join(f'if({at(k)}.n > 1, {at(k)}, null)' for k in range(1, BACK + 1))})"
        return f"""case when {many(f'({n} - {last})')} and {last} <= {RARELY_LAST} * {n} then true
            when {many(piece)} and {n} <= {RARELY_LAST} * {piece} and not {stopped} then true
            when {n} > 0 then {f'if({last} > 0, false, null)' if v == 0 else 'null'}
            when {many(f'({back}.n - 1)')} and not {stopped} then {back}.near - 1 <= {RARELY_LAST} * ({back}.n - 1) end"""

    new = "size(w1) >= 2 and p is not null and coalesce(try_element_at(m, 20).n, 0) <= 1"
    return spark.sql(f"""
        with j as (select t.ckey, t.eid, t.w1, t.p, t.stopped, t.stopped1, s.answers, coalesce(o.m, map()) as m, coalesce(o.piece, 0) as piece, coalesce(o.piece1, 0) as piece1, o.n0, o.l0, o.n1, o.l1, o.corpus_piece
          from _cut_tails t join _cut_sizes s on t.ckey = s.ckey left join _cut_known o on t.kh = o.kh and t.eid = o.eid),
        r as (select *, if(ckey = '', null, {rule(0, 'stopped', 'piece')}) as cut0, if(ckey <> '' and {new}, {rule(1, 'stopped1', 'piece1')}, null) as cut1 from j)
        select ckey, eid, coalesce(cut0, false) or coalesce(cut1, false) or (coalesce(cut0, cut1) is null and not stopped
          and ({_rarely('coalesce(l0, 0)', 'coalesce(n0, 0)')} or coalesce(n0, 0) <= 0 and (coalesce(corpus_piece, 0) > 0 or {_rarely('coalesce(l1, 0)', 'coalesce(n1, 0)')}))) as cut from r""")


def found(results: DataFrame, cases: DataFrame) -> DataFrame:
    """``seq`` of the cut rows of results."""
    before = mark()
    cut = written(judged(results, cases).where("cut").select("ckey", "eid"), "cut")
    drop_written(before, 1)
    cut.createOrReplaceTempView("_cut_found")
    return cut.sparkSession.sql("select seq from (select seq, ckey, xxhash64(response) as eid from _cut_rows) left semi join _cut_found using (ckey, eid)")


def shares(results: DataFrame, cases: DataFrame, flagged: DataFrame) -> DataFrame:
    """``source, n_rows, n_cut, share`` of results by the source of their case (null where unknown), and what ``finish_reason`` said:
    ``n_said`` rows that it calls cut, ``n_both`` of them cut indeed."""
    source = cases.where("id is not null").groupBy(squeezed(F.col("id")).alias("case_key")).agg(F.max("source").alias("source"))
    reason = F.lower("finish_reason") if "finish_reason" in results.columns else F.lit(None).cast("string")
    said = F.coalesce(reason.isin("length", "max_tokens"), F.lit(False)).alias("said")
    rows = results.select("seq", squeezed(F.col("case_id")).alias("case_key"), said).join(source, "case_key", "left").join(flagged.select("seq", F.lit(1).alias("cut")), "seq", "left")
    out = rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.count("cut").alias("n_cut"), F.count_if("said").alias("n_said"), F.count_if(F.col("said") & F.col("cut").isNotNull()).alias("n_both"))
    return out.withColumn("share", F.col("n_cut") / F.col("n_rows"))
