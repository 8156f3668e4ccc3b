"""The query catalogue: each operator over tables derived from the driver's, with the same query for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, ShortType

from .functions import lexicon, signal, text
from .operators import intervals, lines, lyrics, scoring, timeline, words
from .plans import ctc, duck, fixtures, reconcile, score
from .plans.fixtures import Tables, with_sql
from .sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, using: str = "", recursive: bool = False):
    """Registers a query; whole numbers come out as longs and decimals as doubles, as DuckDB has them."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.select(*(F.col(x.name).cast("long").alias(x.name) if isinstance(x.dataType, IntegerType | ShortType) else F.col(x.name) for x in df.schema))

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = with_sql(using, sql, recursive) if using else sql
        return f

    return register


def r6(c) -> object:
    return F.round(c, 6)


# --- text ---


@query(
    f"""WITH l AS (SELECT song_id, line_no, text, {duck.normalize('text')} AS norm, {duck.repetition_key('text')} AS k FROM lines),
    p AS (SELECT *, lag(k) OVER (PARTITION BY song_id ORDER BY line_no) AS pk FROM l),
    kept AS (SELECT * FROM p WHERE k = '' OR pk IS NULL OR k <> pk)
    SELECT song_id, line_no, '[' || {duck.format_lrc('line_no * 2345.678')} || '] ' || norm AS line FROM kept WHERE norm <> ''""",
    "lines",
)
def q_lrc_lines(t: Tables) -> DataFrame:
    kept = words.drop_repeated(fixtures.lines(t), "text", "line_no").withColumn("norm", text.normalize(F.col("text"))).where("norm <> ''")
    stamp = text.format_lrc(F.col("line_no") * F.lit(2345.678).cast("double"))
    return kept.select("song_id", "line_no", F.concat(F.lit("["), stamp, F.lit("] "), "norm").alias("line"))


@query(f"SELECT song_id, line_no, {duck.normalize('text')} AS norm FROM lines", "lines")
def q_normalize(t: Tables) -> DataFrame:
    return fixtures.lines(t).select("song_id", "line_no", text.normalize(F.col("text")).alias("norm"))


SAMPLES = ("Đorđe ŠĆČŽ ‘n’ roll", "Приветствую, Жёлтый щука!", "Љубав Њега Ђак ћевапи", "θάλασσα ψυχή ωμέγα", "Œuvre — ça va… straße", "* ## Æther_and/or\\x *", "**bold** line**", "Ĳsland ŉ ŋ ſ", "«quoted» „text“ … ’tis", "#1 #2 ***")
HANGUL = ("한국어 가사", "사랑해요 ㅋㅋ ㅏ", "노래 song")


@query(f"SELECT i, x AS original, {duck.normalize('x')} AS norm FROM (SELECT unnest(range({len(SAMPLES)})) AS i, unnest({duck.listed(SAMPLES)}) AS x)")
def q_translit_literals(t: Tables) -> DataFrame:
    rows = t.spark.range(1).select(F.posexplode(F.array(*map(F.lit, SAMPLES))).alias("i", "original"))
    return rows.select(F.col("i").cast("long").alias("i"), "original", text.normalize(F.col("original")).alias("norm"))


def _hangul_sql(x: str) -> str:
    c = f"unicode({x}) - 44032"
    return f"CASE WHEN {c} BETWEEN 0 AND 11171 THEN {duck.listed(text.HANGUL_FIRST)}[({c}) // 588 + 1] || {duck.listed(text.HANGUL_MIDDLE)}[({c}) % 588 // 28 + 1] || {duck.listed(text.HANGUL_LAST)}[({c}) % 28 + 1] ELSE {x} END"


@query(f"SELECT i, x AS original, {duck.normalize('y')} AS norm FROM (SELECT i, x, array_to_string(list_transform(string_split(x, ''), lambda c: {_hangul_sql('c')}), '') AS y FROM (SELECT unnest(range({len(HANGUL)})) AS i, unnest({duck.listed(HANGUL)}) AS x))")
def q_hangul_literals(t: Tables) -> DataFrame:
    rows = t.spark.range(1).select(F.posexplode(F.array(*map(F.lit, HANGUL))).alias("i", "original"))
    return rows.select(F.col("i").cast("long").alias("i"), "original", text.normalize(F.col("original")).alias("norm"))


@query(f"SELECT song_id, line_no, {duck.score_normalize('text')} AS norm, {duck.score_normalize('text')} IN {duck.names(lexicon.PLACEHOLDERS)} AS placeholder FROM lines", "lines")
def q_score_norm(t: Tables) -> DataFrame:
    norm = text.score_normalize(F.col("text"))
    return fixtures.lines(t).select("song_id", "line_no", norm.alias("norm"), lexicon.is_placeholder(norm).alias("placeholder"))


@query(f"SELECT song_id, line_no, {duck.strip('marked')} AS stripped, trim(text, {duck.WS}) AS trimmed FROM (SELECT *, CASE line_no % 3 WHEN 0 THEN '## ' || text || ' **' WHEN 1 THEN '**' || text || '**' ELSE chr(9) || '*' || text END AS marked FROM lines)", "lines")
def q_strip_markdown(t: Tables) -> DataFrame:
    x, k = F.col("text"), F.col("line_no") % 3
    marked = F.when(k == 0, F.concat(F.lit("## "), x, F.lit(" **"))).when(k == 1, F.concat(F.lit("**"), x, F.lit("**"))).otherwise(F.concat(F.lit("\t*"), x))
    return fixtures.lines(t).select("song_id", "line_no", text.strip_markdown(marked).alias("stripped"), text.trim_blank(x).alias("trimmed"))


_SIM = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) END"


@query(
    f"""WITH d AS (SELECT DISTINCT song_id, {duck.normalize('text')} AS w FROM words),
    d2 AS (SELECT * FROM d WHERE w <> '')
    SELECT x.song_id, x.w AS a, y.w AS b, CAST(round(1 - levenshtein(x.w, y.w) / greatest(length(x.w), length(y.w)), 6) AS DOUBLE) AS sim
    FROM d2 x JOIN d2 y ON x.song_id = y.song_id AND x.w < y.w WHERE round(1 - levenshtein(x.w, y.w) / greatest(length(x.w), length(y.w)), 6) >= 0.6""",
    "words",
)
def q_similarity(t: Tables) -> DataFrame:
    w = fixtures.words(t).select("song_id", text.normalize(F.col("text")).alias("w")).where("w <> ''").distinct()
    pairs = w.withColumnRenamed("w", "a").join(w.withColumnRenamed("w", "b"), "song_id").where("a < b")
    return pairs.select("song_id", "a", "b", r6(text.similarity(F.col("a"), F.col("b"))).alias("sim")).where("sim >= 0.6")


@query(f"SELECT song_id, ord, event_type FROM (SELECT *, lag(k) OVER (PARTITION BY song_id ORDER BY ord) AS pk FROM (SELECT *, {duck.repetition_key('event_type')} AS k FROM seq)) WHERE k = '' OR pk IS NULL OR k <> pk", "seq")
def q_repeat_drop(t: Tables) -> DataFrame:
    return words.drop_repeated(fixtures.sequence(t), "event_type", "ord").select("song_id", "ord", "event_type")


# --- words ---


@query(
    """WITH a AS (SELECT *, CASE WHEN text[1] = ' ' OR row_number() OVER (PARTITION BY song_id, seg ORDER BY pos) = 1 THEN 1 ELSE 0 END AS b FROM tokens WHERE NOT starts_with(text, '[_')),
    w AS (SELECT *, sum(b) OVER (PARTITION BY song_id, seg ORDER BY pos) - 1 AS word FROM a),
    g AS (SELECT song_id, seg, word, string_agg(text, '' ORDER BY pos) AS text, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms, min(prob) AS prob FROM w GROUP BY ALL)
    SELECT song_id, CAST(seg AS BIGINT) AS seg, CAST(word AS BIGINT) AS word, CASE WHEN word > 0 AND text[1] = ' ' THEN text[2:] ELSE text END AS text, start_ms, end_ms, prob FROM g""",
    "tokens",
)
def q_token_words(t: Tables) -> DataFrame:
    return words.merge_tokens(fixtures.tokens(t))


_GOOD = f"SELECT * FROM (SELECT *, {duck.normalize('text')} AS norm FROM words) WHERE norm <> '' AND regexp_matches(norm, '[a-z]') AND prob >= 0.2"


@query(
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY seg, pos) AS rn FROM ({_GOOD})),
    fold AS (SELECT song_id, rn, norm AS ln, start_ms AS ls, true AS keep FROM g WHERE rn = 1
      UNION ALL SELECT g.song_id, g.rn, CASE WHEN dup THEN ln ELSE g.norm END, CASE WHEN dup THEN ls ELSE g.start_ms END, NOT dup
      FROM (SELECT g.*, f.ln, f.ls, g.norm = f.ln AND abs(g.start_ms - f.ls) < 40 AND g.end_ms - g.start_ms < 60 AS dup FROM fold f JOIN g ON g.song_id = f.song_id AND g.rn = f.rn + 1) g)
    SELECT g.song_id, row_number() OVER (PARTITION BY g.song_id ORDER BY g.rn) - 1 AS widx, g.seg, g.text, g.norm, round(g.start_ms, 6) AS start_ms, round(g.end_ms, 6) AS end_ms, g.prob FROM g JOIN fold f ON f.song_id = g.song_id AND f.rn = g.rn WHERE f.keep""",
    "words",
    recursive=True,
)
def q_word_clean(t: Tables) -> DataFrame:
    return words.clean_words(fixtures.words(t)).withColumns({c: r6(c) for c in ("start_ms", "end_ms")})


@query("SELECT s.song_id, s.seg, round(coalesce(avg(prob), 0), 9) AS mean_prob, round(coalesce(avg(prob), 0) + 0.05 * ln(1 + count(w.pos)), 9) AS score, count(w.pos) AS n_words FROM segments s LEFT JOIN words w ON w.song_id = s.song_id AND w.seg = s.seg GROUP BY ALL", "words")
def q_segment_score(t: Tables) -> DataFrame:
    m, n = signal.mean_probability(F.col("words")), F.size("words")
    return fixtures.segments(t).select("song_id", "seg", F.round(m, 9).alias("mean_prob"), F.round(signal.segment_score(m, n), 9).alias("score"), n.alias("n_words"))


# --- intervals ---

_COVER = """o AS (SELECT s.song_id, s.seg, s.text, s.start_ms + 130 AS start_ms, s.end_ms + 130 AS end_ms, coalesce(avg(w.prob), 0) AS mean, count(w.pos) AS n FROM segments s LEFT JOIN other_words w ON w.song_id = s.song_id AND w.seg = s.seg GROUP BY ALL),
    c AS (SELECT s.song_id, s.seg, coalesce(avg(o.mean), 0) AS coverage, string_agg(o.text, ' ' ORDER BY o.seg) AS o_text, coalesce(sum(o.n), 0) AS o_n FROM segments s LEFT JOIN o ON o.song_id = s.song_id AND s.start_ms < o.end_ms AND o.start_ms < s.end_ms GROUP BY ALL)"""


@query(f"WITH {_COVER} SELECT song_id, seg, round(coverage, 9) AS coverage FROM c", "words other_words")
def q_overlap_coverage(t: Tables) -> DataFrame:
    return intervals.coverage(fixtures.segments(t), fixtures.other_segments(t)).withColumn("coverage", F.round("coverage", 9))


@query(
    f"""WITH {_COVER}, p AS (SELECT s.song_id, s.seg, s.text, coalesce(avg(w.prob), 0) + 0.05 * ln(1 + count(w.pos)) AS score, count(w.pos) AS n FROM segments s LEFT JOIN words w ON w.song_id = s.song_id AND w.seg = s.seg GROUP BY ALL),
    j AS (SELECT p.*, coverage, o_text, o_n, coverage > score - 0.2 AND o_n > 0 AND o_text <> '' AS replaced FROM p JOIN c USING (song_id, seg))
    SELECT song_id, seg, replaced, CASE WHEN replaced THEN o_text ELSE text END AS text, CAST(CASE WHEN replaced THEN o_n ELSE n END AS BIGINT) AS n_words FROM j""",
    "words other_words",
)
def q_bilingual_merge(t: Tables) -> DataFrame:
    out = intervals.merge_bilingual(fixtures.segments(t), fixtures.other_segments(t), margin=-0.2)
    return out.select("song_id", "seg", "replaced", "text", F.size("words").alias("n_words"))


# --- classification ---


@query(
    f"""WITH n AS (SELECT *, {duck.normalize('text')} AS norm FROM words), s AS (SELECT *, {duck.normalize('text')} AS norm FROM segments)
    SELECT s.song_id, s.seg, CAST(count(*) FILTER (WHERE n.norm IN {duck.names(lexicon.MARKERS)}) AS BIGINT) AS n_markers, {duck.narration('s.norm')} OR coalesce(bool_and(n.norm IN {duck.names(lexicon.MARKERS)}), true) AS non_lyric
    FROM s LEFT JOIN n ON n.song_id = s.song_id AND n.seg = s.seg GROUP BY s.song_id, s.seg, s.norm""",
    "words",
)
def q_markers(t: Tables) -> DataFrame:
    norms = lexicon.normalized_words(F.transform("words", lambda w: w["text"]))
    rows = fixtures.segments(t).select("song_id", "seg", text.normalize(F.col("text")).alias("norm"), norms.alias("norms"))
    return rows.select("song_id", "seg", F.size(F.filter("norms", lexicon.is_marker)).alias("n_markers"), lexicon.is_non_lyric(F.col("norm"), F.col("norms")).alias("non_lyric"))


_PHRASES = f"""p AS (SELECT DISTINCT array_to_string(list_slice(string_split(norm, ' '), 1, 3), ' ') AS phrase FROM (SELECT {duck.normalize('text')} AS norm FROM benchmark) WHERE len(string_split(norm, ' ')) >= 3),
    l AS (SELECT song_id, line_no, {duck.normalize('text')} AS norm FROM lines)"""


@query(f"WITH {_PHRASES} SELECT song_id, line_no, phrase FROM l JOIN p ON contains(' ' || norm || ' ', ' ' || phrase || ' ')", "lines")
def q_narration_hits(t: Tables) -> DataFrame:
    """Phrases and lines meet by their 3-word n-grams, so the join has an equality key."""

    def threes(w: object) -> object:
        return F.transform(F.when(F.size(w) >= 3, F.sequence(F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(w, i, 3), " "))

    b = t.benchmark.select(F.split(text.normalize(F.col("text")), " ").alias("w")).where(F.size("w") >= 3)
    phrases = b.select(F.array_join(F.slice("w", 1, 3), " ").alias("phrase")).distinct()
    grams = fixtures.lines(t).withColumn("w", F.split(text.normalize(F.col("text")), " ")).select("song_id", "line_no", F.explode(F.array_distinct(threes(F.col("w")))).alias("phrase"))
    return grams.join(phrases, "phrase").select("song_id", "line_no", "phrase")


_CLEAN = f"regexp_replace(regexp_replace(trim(text, {duck.WS}), '[\\n\\r\\t]', ' ', 'g'), ' +', ' ', 'g')"
_SEG_LINES = f"""wn AS (SELECT song_id, seg, bool_and(n IN {duck.names(lexicon.MARKERS)}) AS all_m, bool_and(n IN {duck.names(lexicon.MARKERS + lexicon.INTERJECTIONS)}) AS all_mi, avg(prob) AS conf FROM (SELECT *, {duck.normalize('text')} AS n FROM words) GROUP BY ALL),
    sl AS (SELECT s.song_id, row_number() OVER (PARTITION BY s.song_id ORDER BY s.seg) - 1 AS line_index, start_ms, end_ms, coalesce(conf, 0) AS confidence, clean, {duck.narration('norm')} OR coalesce(all_mi, true) AS silent
      FROM (SELECT *, {_CLEAN} AS clean, {duck.normalize('text')} AS norm FROM segments) s LEFT JOIN wn ON wn.song_id = s.song_id AND wn.seg = s.seg WHERE clean <> ''),
    al AS (SELECT song_id, line_index, start_ms, end_ms, confidence, CASE WHEN silent THEN '[humming]' ELSE clean END AS text, CASE WHEN silent THEN '' ELSE clean END AS align_text FROM sl)"""


@query(f"WITH {_SEG_LINES} SELECT song_id, line_index, start_ms, end_ms, round(confidence, 9) AS confidence, text, align_text FROM al", "words")
def q_humming(t: Tables) -> DataFrame:
    return lines.segments_to_lines(fixtures.segments(t)).withColumn("confidence", F.round("confidence", 9))


_PIECES = f"""pieces AS (SELECT song_id, line_no * 2 + k AS line_index, array_to_string(CASE k WHEN 0 THEN w[:-2] ELSE w[-1:] END, ' ') AS text, line_no * 1000.0 + k * 600 AS start_ms, line_no * 1000.0 + k * 600 + 500 AS end_ms, CAST((line_no * 2 + k) % 10 / 10.0 AS DOUBLE) AS confidence
      FROM (SELECT song_id, line_no, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM lines), (SELECT unnest([0, 1]) AS k)),
    pn AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY line_index) AS rn, {duck.normalize('text')} AS norm, octet_length(encode(replace(text, ' ', ''))) AS wt, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS nw FROM pieces WHERE text <> '')"""


@query(
    f"""WITH {_PIECES},
    fold AS (SELECT song_id, rn, 0::BIGINT AS grp, norm AS an, wt::BIGINT AS aw, confidence AS ac FROM pn WHERE rn = 1
      UNION ALL SELECT song_id, rn, CASE WHEN tail THEN grp ELSE grp + 1 END, CASE WHEN tail THEN trim(an || ' ' || norm) ELSE norm END, CASE WHEN tail THEN aw + wt ELSE wt END, CASE WHEN tail THEN (ac * aw + confidence * wt) / greatest(1, aw + wt) ELSE confidence END
      FROM (SELECT p.*, f.grp, f.an, f.aw, f.ac, p.nw <= 2 AND (p.nw = 0 OR p.norm = '' OR NOT contains(' ' || f.an || ' ', ' ' || p.norm || ' ')) AS tail FROM fold f JOIN pn p ON p.song_id = f.song_id AND p.rn = f.rn + 1))
    SELECT f.song_id, f.grp AS line_index, CAST(min(start_ms) AS DOUBLE) AS start_ms, CAST(max(end_ms) AS DOUBLE) AS end_ms, string_agg(text, ' ' ORDER BY f.rn) AS text, round(arg_max(f.ac, f.rn), 6) AS confidence FROM fold f JOIN pn p ON p.song_id = f.song_id AND p.rn = f.rn GROUP BY f.song_id, f.grp""",
    "lines",
    recursive=True,
)
def q_tail_merge(t: Tables) -> DataFrame:
    return lines.merge_split_lines(_pieces(t)).select("song_id", "line_index", "start_ms", "end_ms", "text", r6("confidence").alias("confidence"))


def _pieces(t: Tables) -> DataFrame:
    """Lines split into all but their last two words, and their last."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = fixtures.lines(t).withColumn("w", w).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    head, last = F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - 1)), F.slice("w", F.greatest(F.lit(1), F.size("w")), 1)
    start = F.col("line_no") * 1000.0 + F.col("k") * 600.0
    index = F.col("line_no") * 2 + F.col("k")
    rows = rows.select("song_id", index.alias("line_index"), F.array_join(F.when(F.col("k") == 0, head).otherwise(last), " ").alias("text"), start.alias("start_ms"), (start + 500.0).alias("end_ms"), (index % 10 / 10.0).cast("double").alias("confidence"))
    return rows.where("text <> ''").withColumn("align_text", F.col("text"))


@query()
def q_merge_rules(t: Tables) -> DataFrame:
    """Every rule of the registry on the same lines; what is compared is counts, as the rules' verdicts are tested elsewhere."""
    rows = _pieces(t).select("song_id", F.col("line_index").alias("seg"), "start_ms", "text")
    out = None
    for name, rule in lines.RULES.items():
        merged = lines.merge_by_rule(rows, rule)
        one = merged.groupBy("song_id").agg(F.count("*").alias("n_lines"), F.count_if(text.score_words(F.col("text")) <= 2).alias("n_fragments"), F.max(F.length("text")).alias("longest")).withColumn("rule", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# --- timeline ---

_SEQ = ["song_id", "ord"]


@query(
    """WITH a AS (SELECT song_id, ord, least(start_ms, end_ms) AS lo, greatest(start_ms, end_ms) AS hi FROM seq),
    b AS (SELECT *, max(hi) OVER (PARTITION BY song_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM a)
    SELECT song_id, ord, greatest(lo, pe) AS start_ms, greatest(hi, pe) AS end_ms FROM b""",
    "seq",
)
def q_clamp_monotone(t: Tables) -> DataFrame:
    return timeline.clamp_monotone(fixtures.sequence(t), "ord").select(*_SEQ, "start_ms", "end_ms")


@query(
    """WITH a AS (SELECT song_id, ord AS line, start_ms, greatest(start_ms, end_ms) AS end_ms, event_type = 'purchase' AS recovered FROM seq),
    b AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start_ms, recovered, line) - 1 AS ord FROM a)
    SELECT song_id, ord, line, recovered, greatest(start_ms, lag(end_ms) OVER (PARTITION BY song_id ORDER BY ord)) AS start_ms, end_ms FROM b""",
    "seq",
)
def q_merge_recovered(t: Tables) -> DataFrame:
    rows = fixtures.sequence(t).select("song_id", F.col("ord").alias("line"), "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), (F.col("event_type") == "purchase").alias("r"))
    return timeline.merge_recovered(rows.where("not r").drop("r"), rows.where("r").drop("r")).select("song_id", "ord", "line", "recovered", "start_ms", "end_ms")


@query(
    """WITH a AS (SELECT *, lead(start_ms) OVER (PARTITION BY song_id ORDER BY ord) - end_ms > 900 AS far FROM seq)
    SELECT song_id, ord, false AS blank, start_ms, end_ms FROM a UNION ALL SELECT song_id, ord, true, end_ms, end_ms FROM a WHERE far""",
    "seq",
)
def q_paragraph_breaks(t: Tables) -> DataFrame:
    return timeline.paragraph_breaks(fixtures.sequence(t), "ord", 900.0).select(*_SEQ, "blank", "start_ms", "end_ms")


@query("SELECT song_id, ord, CAST(sum(CASE WHEN gap >= 900 THEN 1 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY ord) AS BIGINT) AS session FROM (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY song_id ORDER BY ord) AS gap FROM seq)", "seq")
def q_gap_sessions(t: Tables) -> DataFrame:
    return timeline.gap_sessions(fixtures.sequence(t), "ord").select(*_SEQ, "session")


@query(
    """WITH w AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY seg, pos) - 1 AS widx FROM words),
    f AS (SELECT *, widx - row_number() OVER (PARTITION BY song_id ORDER BY widx) AS run FROM w WHERE length(text) % 7 <> 0)
    SELECT song_id, min(widx) AS run_start, max(widx) AS run_end, count(*) AS n_words, round(arg_min(start_ms, widx), 6) AS start_ms, round(arg_max(end_ms, widx), 6) AS end_ms FROM f GROUP BY song_id, run HAVING count(*) >= 6 AND arg_max(end_ms, widx) - arg_min(start_ms, widx) >= 300""",
    "words",
)
def q_uncovered_runs(t: Tables) -> DataFrame:
    widx = F.row_number().over(Window.partitionBy("song_id").orderBy("seg", "pos")) - 1
    w = fixtures.words(t).withColumn("widx", widx)
    return timeline.uncovered_runs(w, w.where(F.length("text") % 7 == 0), 6, 300.0).withColumns({c: r6(c) for c in ("start_ms", "end_ms")})


_FILL = """m AS (SELECT *, last_value(CASE WHEN matched THEN line END IGNORE NULLS) OVER a AS pl, first_value(CASE WHEN matched THEN line END IGNORE NULLS) OVER b AS nl,
      last_value(CASE WHEN matched THEN end_ms END IGNORE NULLS) OVER a AS pe, first_value(CASE WHEN matched THEN start_ms END IGNORE NULLS) OVER b AS ns, count(*) OVER (PARTITION BY song_id) AS n, row_number() OVER (PARTITION BY song_id ORDER BY line) - 1 AS nth FROM timed
      WINDOW a AS (PARTITION BY song_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY song_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


@query(
    f"""WITH {_FILL}, l AS (SELECT *, sum(CASE WHEN n_words > 0 THEN n_words * 700.0 ELSE 1500.0 END) OVER (PARTITION BY song_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back FROM m WHERE NOT matched AND pl IS NULL AND nl IS NOT NULL),
    s AS (SELECT *, CAST(greatest(0, ns - back) AS DOUBLE) AS s FROM l)
    SELECT song_id, line, s AS start_ms, CAST(greatest(s, coalesce(lead(s) OVER (PARTITION BY song_id ORDER BY line), ns) - 20) AS DOUBLE) AS end_ms FROM s""",
    "timed",
)
def q_interp_leading(t: Tables) -> DataFrame:
    return _unmatched(t, "pl is null and nl is not null")


def _unmatched(t: Tables, where: str) -> DataFrame:
    rows = fixtures.timed_lines(t)
    w = Window.partitionBy("song_id").orderBy("line")
    own = F.when(F.col("matched"), F.col("line"))
    where_to = rows.select("song_id", "line", F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("pl"), F.first(own, True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("nl"))
    out = timeline.interpolate_lines(rows).join(where_to, ["song_id", "line"]).where("not matched").where(where)
    return out.select("song_id", "line", r6("start_ms").alias("start_ms"), r6("end_ms").alias("end_ms"))


@query(
    f"""WITH {_FILL}, l AS (SELECT *, sum(n_words) OVER (PARTITION BY song_id, pl, nl ORDER BY line) AS acc, sum(n_words) OVER (PARTITION BY song_id, pl, nl) AS total FROM m WHERE NOT matched AND pl IS NOT NULL AND nl IS NOT NULL),
    s AS (SELECT *, pe + (ns - pe) * acc / greatest(1, total) AS s FROM l)
    SELECT song_id, line, round(CAST(s AS DOUBLE), 6) AS start_ms, round(CAST(greatest(s, coalesce(lead(s) OVER (PARTITION BY song_id, pl, nl ORDER BY line), ns) - 20) AS DOUBLE), 6) AS end_ms FROM s""",
    "timed",
)
def q_interp_interior(t: Tables) -> DataFrame:
    return _unmatched(t, "pl is not null and nl is not null")


@query(
    f"""WITH {_FILL}, l AS (SELECT *, sum(50 + 550.0 * greatest(n_words, 1)) OVER (PARTITION BY song_id ORDER BY line) AS fwd FROM m WHERE NOT matched AND nl IS NULL AND pl IS NOT NULL)
    SELECT song_id, line, CAST(pe + fwd - 550.0 * greatest(n_words, 1) AS DOUBLE) AS start_ms, CAST(pe + fwd AS DOUBLE) AS end_ms FROM l
    UNION ALL SELECT song_id, line, round(t1 * nth / n, 6), round(t1 * (nth + 1) / n, 6) FROM m WHERE NOT matched AND nl IS NULL AND pl IS NULL""",
    "timed",
)
def q_interp_trailing(t: Tables) -> DataFrame:
    return _unmatched(t, "nl is null")


@query(
    """WITH k AS (SELECT *, last_value(end_ms IGNORE NULLS) OVER a AS pe, first_value(start_ms IGNORE NULLS) OVER b AS ns, count(start_ms) OVER (PARTITION BY song_id ORDER BY line) AS island FROM timed
      WINDOW a AS (PARTITION BY song_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY song_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    r AS (SELECT *, row_number() OVER (PARTITION BY song_id, island ORDER BY line) - 1 AS rank, count(*) OVER (PARTITION BY song_id, island) AS size, greatest(0, ns - pe) AS span FROM k WHERE start_ms IS NULL),
    s AS (SELECT *, CASE WHEN pe IS NOT NULL AND ns IS NOT NULL THEN pe + span * (rank + 1) / (size - rank + 1) WHEN pe IS NOT NULL THEN pe + 200 WHEN ns IS NOT NULL THEN greatest(0, ns - 3000) ELSE 0 END AS s FROM r)
    SELECT song_id, line, round(CAST(s AS DOUBLE), 6) AS start_ms, round(CAST(CASE WHEN pe IS NOT NULL AND ns IS NOT NULL THEN s + least(3000, span / (size - rank + 1) + 800) WHEN pe IS NOT NULL THEN s + 2000 WHEN ns IS NOT NULL THEN ns ELSE 0 END AS DOUBLE), 6) AS end_ms FROM s
    UNION ALL SELECT song_id, line, start_ms, end_ms FROM timed WHERE start_ms IS NOT NULL""",
    "timed",
)
def q_empty_line_fill(t: Tables) -> DataFrame:
    return timeline.fill_empty(fixtures.timed_lines(t)).select("song_id", "line", r6("start_ms").alias("start_ms"), r6("end_ms").alias("end_ms"))


@query(
    f"WITH {_SEG_LINES} SELECT song_id, line_index, CAST(greatest(0, trunc(start_ms) - 250) AS BIGINT) AS start_ms, CAST(greatest(0, trunc(end_ms) - 250) AS BIGINT) AS end_ms, text FROM al WHERE text = '' OR round(confidence, 9) >= 0.45",
    "words",
)
def q_lead_minconf(t: Tables) -> DataFrame:
    rows = lines.segments_to_lines(fixtures.segments(t)).withColumn("confidence", F.round("confidence", 9))
    kept = lines.minimum_confidence(rows, 0.45)
    return kept.select("song_id", "line_index", *(signal.lead_shift(F.col(c), 250).cast("long").alias(c) for c in ("start_ms", "end_ms")), "text")


# --- sources and sinks ---


@query(
    f"""WITH a AS (SELECT song_id, line_no, '[' || {duck.format_lrc('line_no * 12345.67')} || '] ' || text AS line FROM lines),
    b AS (SELECT *, regexp_extract(line, '^\\[(\\d+):(\\d+(\\.\\d+)?)\\]\\s*(.*)$', ['m', 's', 'f', 'x']) AS g FROM a)
    SELECT song_id, line_no AS j, round(CAST(g['m'] AS DOUBLE) * 60 + CAST(g['s'] AS DOUBLE), 6) AS t_s, len(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS n_words FROM (SELECT *, CASE WHEN n0 IN {duck.names(lexicon.PLACEHOLDERS)} THEN '' ELSE n0 END AS norm FROM (SELECT *, {duck.score_normalize("g['x']")} AS n0 FROM b))""",
    "lines",
)
def q_lrc_roundtrip(t: Tables) -> DataFrame:
    stamp = text.format_lrc(F.col("line_no") * F.lit(12345.67).cast("double"))
    rows = fixtures.lines(t).select("song_id", "line_no", F.concat(F.lit("["), stamp, F.lit("] "), "text").alias("text"))
    return readers.predicted_lines(rows).select("song_id", "j", r6("t_s").alias("t_s"), F.size("words").alias("n_words"))


@query(
    f"""SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY start_ms, line) - 1 AS ord, '[' || {duck.format_lrc('greatest(0, start_ms)')} || '] ' || event_type AS line FROM (SELECT song_id, ord AS line, start_ms, event_type FROM seq)""",
    "seq",
)
def q_lrc_write(t: Tables) -> DataFrame:
    return writers.lrc(fixtures.sequence(t).select("song_id", F.col("ord").alias("line_index"), "start_ms", F.col("event_type").alias("text")))


@query(
    f"""SELECT song_id, line_no AS i, round(line_no * 1.5, 6)::DOUBLE AS t_s, norm FROM (SELECT *, {duck.score_normalize('text')} AS norm FROM lines WHERE song_id = 7) WHERE norm <> '' AND norm NOT IN {duck.names(lexicon.PLACEHOLDERS)}""",
    "lines",
)
def q_song_lookup(t: Tables) -> DataFrame:
    line = F.transform(F.split("text", "\n"), lambda x, i: F.format_string("[%02d:%04.1f] %s", F.floor(i * 1.5 / 60), (i * F.lit(1.5).cast("double")) % 60, x))
    songs = t.documents.select(F.col("doc_id").alias("song_id"), F.array_join(line, "\n").alias("synced_lyrics"))
    return readers.song_lines(songs, 7).select("song_id", "i", r6("t_s").alias("t_s"), F.array_join("words", " ").alias("norm"))


_RAW = "SELECT song_id, line_no, CASE WHEN line_no % 6 = 1 THEN ['Ref.', '[Chorus 1]', 'Refren:'][1 + (song_id + line_no // 6) % 3] ELSE text END AS text FROM lines"


@query(
    f"""WITH r AS (SELECT song_id, line_no, trim(text, {duck.WS}) AS text FROM ({_RAW})),
    m AS (SELECT *, CASE WHEN lower(text) IN ('ref.', 'ref', 'ref:') THEN 'Ref.' WHEN starts_with(lower(text), '[chorus') OR lower(text) IN ('[ref]', '[ref.') THEN text WHEN contains(lower(text), 'refren') OR contains(lower(text), 'refrain') THEN 'Ref.' END AS label FROM r),
    b AS (SELECT *, count(label) OVER (PARTITION BY song_id ORDER BY line_no) AS block FROM m),
    k AS (SELECT song_id, block, max(label) AS label, list(text ORDER BY line_no) FILTER (WHERE label IS NULL AND text <> '') AS ls FROM b WHERE block > 0 GROUP BY ALL),
    c AS (SELECT song_id, label, arg_max(ls, block) AS ls FROM k WHERE ls IS NOT NULL GROUP BY ALL),
    o AS (SELECT song_id, line_no, 0 AS k, text, label IS NOT NULL AS is_ref, false AS is_expanded FROM b WHERE text <> ''
      UNION ALL SELECT b.song_id, b.line_no, generate_subscripts(c.ls, 1), unnest(c.ls), false, true FROM b JOIN c ON c.song_id = b.song_id AND c.label = b.label)
    SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY line_no, k) - 1 AS index, text, CASE WHEN is_ref THEN '' ELSE {duck.normalize('text')} END AS normalized, is_ref, is_expanded FROM o""",
    "lines",
)
def q_chorus_expand(t: Tables) -> DataFrame:
    marker = F.element_at(F.array(F.lit("Ref."), F.lit("[Chorus 1]"), F.lit("Refren:")), (1 + (F.col("song_id") + F.floor(F.col("line_no") / 6)) % 3).cast("int"))
    raw = fixtures.lines(t).withColumn("text", F.when(F.col("line_no") % 6 == 1, marker).otherwise(F.col("text")))
    return lyrics.parse_lyrics(raw)


# --- frames and samples ---

_VOCABULARY = "MAP {" + ", ".join(f"{duck.quoted(k)}: {v}" for k, v in ctc.VOCABULARY.items()) + "}"
_TOKENS = f"SELECT song_id, line_no, list_filter(list_transform(string_split({duck.normalize('text')}, ''), lambda c: {_VOCABULARY}[c]), lambda x: x IS NOT NULL) AS toks FROM lines"


@query(
    f"""WITH k AS ({_TOKENS}), s AS (SELECT song_id, line_no, s AS state, CASE WHEN s % 4 = 1 THEN toks[s // 4 + 1] ELSE 0 END AS token_id, CASE WHEN s % 4 = 1 THEN s // 4 ELSE -1 END AS serial
      FROM (SELECT *, unnest(range(0, greatest(0, 4 * len(toks) - 1))) AS s FROM k))
    SELECT song_id, line_no, count(*) AS n_states, CAST(sum((state + 1) * token_id) AS BIGINT) AS tokens, CAST(sum((state + 1) * serial) AS BIGINT) AS serials FROM s GROUP BY song_id, line_no""",
    "lines",
)
def q_tokenize_path(t: Tables) -> DataFrame:
    """Sums over each line's states that tell any two paths apart which differ in one state."""
    rows = fixtures.lines(t).withColumn("path", signal.bound(signal.tokenize(text.normalize(F.col("text")), ctc.VOCABULARY), signal.ctc_path)).where(F.size("path") > 0)
    total = lambda c: F.aggregate("path", F.lit(0).cast("long"), lambda a, s: a + (s["state"].cast("long") + 1) * s[c])
    return rows.select("song_id", "line_no", F.size("path").alias("n_states"), total("token_id").alias("tokens"), total("serial").alias("serials"))


@query(
    """WITH f AS (SELECT label AS song_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, list_transform(embedding, lambda x, i: CASE WHEN i = 29 THEN -1e9::DOUBLE ELSE x::DOUBLE + CASE WHEN i IN (5, 7, 11) THEN 5.0 ELSE 0.0 END END) AS r FROM embeddings),
    e AS (SELECT song_id, t, list_transform(r, lambda x: exp(x - list_max(r))) AS e FROM f),
    p AS (SELECT song_id, t, list_transform(e, lambda x: round(ln(x / list_sum(e) + 1e-10), 6)) AS p FROM e)
    SELECT CAST(song_id AS BIGINT) AS song_id, t, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS best, list_max(p) AS top, p[29] AS masked, p[5] AS boosted FROM p""",
)
def q_log_softmax(t: Tables) -> DataFrame:
    p = signal.boosted_log_softmax(signal.mask(F.col("logp")), F.array(F.lit(4), F.lit(6), F.lit(10)), F.lit(5.0))
    rows = fixtures.frames(t).select("song_id", "t", F.transform(p, lambda x: F.round(x, 6)).alias("p"))
    top = F.array_max("p")
    return rows.select("song_id", "t", (F.array_position("p", top) - 1).alias("best"), top.alias("top"), F.col("p")[28].alias("masked"), F.col("p")[4].alias("boosted"))


_Q16 = "sign(y) * floor(abs(y) + 0.5)"


@query(f"SELECT vec_id, list_transform(list_transform(embedding, lambda x: greatest(-1.0, least(1.0, x::DOUBLE * 3))), lambda x: CAST({_Q16.replace('y', '(x * CASE WHEN x < 0 THEN 32768.0 ELSE 32767.0 END)')} AS INT))[1] AS first, CAST(list_sum(list_transform(list_transform(embedding, lambda x: greatest(-1.0, least(1.0, x::DOUBLE * 3))), lambda x: CAST({_Q16.replace('y', '(x * CASE WHEN x < 0 THEN 32768.0 ELSE 32767.0 END)')} AS BIGINT))) AS BIGINT) AS total FROM embeddings".replace("[1] AS first", "[1]::BIGINT AS first"))
def q_pcm16(t: Tables) -> DataFrame:
    s = signal.pcm16(F.transform("embedding", lambda x: x.cast("double") * 3))
    return t.embeddings.select("vec_id", s.alias("s")).select("vec_id", F.col("s")[0].alias("first"), F.aggregate("s", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


# --- scoring ---


def _edited(t: Tables) -> DataFrame:
    """(song_id, line, words, pred_words): lines and the same without every fifth word."""
    w = text.score_word_list(F.col("text"))
    # a generator, so that the filter and the edit do not compute the words again
    rows = fixtures.lines(t).select("song_id", F.col("line_no").alias("line"), F.explode(F.array(w)).alias("words")).where(F.size("words") > 0)
    return rows.withColumn("pred_words", F.filter("words", lambda x, i: (i + F.col("line")) % (2 + F.col("line") % 4) != 0))


_EDITED = f"""ed AS (SELECT *, list_filter(words, lambda x, i: (i - 1 + line) % (2 + line % 4) <> 0) AS pred_words FROM (SELECT song_id, line_no AS line, list_filter(string_split({duck.score_normalize('text')}, ' '), lambda x: x <> '') AS words FROM lines) WHERE len(words) > 0),
    rc AS (SELECT song_id, line, w, count(*) AS n FROM (SELECT song_id, line, unnest(words) AS w FROM ed) GROUP BY ALL), pc AS (SELECT song_id, line, w, count(*) AS n FROM (SELECT song_id, line, unnest(pred_words) AS w FROM ed) GROUP BY ALL),
    sc AS (SELECT rc.song_id, rc.line, CAST(sum(least(rc.n, coalesce(pc.n, 0))) AS DOUBLE) / sum(rc.n) AS c FROM rc LEFT JOIN pc ON pc.song_id = rc.song_id AND pc.line = rc.line AND pc.w = rc.w GROUP BY ALL)"""


@query(f"WITH {_EDITED} SELECT song_id, line, round(c, 6) AS containment FROM sc", "lines")
def q_containment(t: Tables) -> DataFrame:
    return scoring.containment(_edited(t), ["song_id", "line"]).select("song_id", "line", r6("containment").alias("containment"))


@query(f"WITH {_EDITED} SELECT song_id, count(*) AS gt, count(*) FILTER (WHERE c >= 0.8) AS ok, count(*) FILTER (WHERE c >= 0.5 AND c < 0.8) AS part, count(*) FILTER (WHERE c < 0.5) AS miss, round(count(*) FILTER (WHERE c >= 0.8) / count(*), 6) AS acc FROM sc GROUP BY ROLLUP (song_id)", "lines")
def q_buckets_rollup(t: Tables) -> DataFrame:
    return scoring.report(scoring.containment(_edited(t), ["song_id", "line"])).withColumn("acc", r6("acc"))


_RESID = "rs AS (SELECT song_id, ord, CAST((event_id % 13 - 6) / 4.0 AS DOUBLE) AS r FROM seq), md AS (SELECT song_id, list(r ORDER BY r)[count(*) // 2 + 1] AS median FROM rs GROUP BY song_id)"


@query(f"WITH {_RESID} SELECT song_id, median, round(avg(CASE WHEN abs(r - median) <= 0.5 THEN 1 ELSE 0 END), 6) AS acc_05, round(avg(CASE WHEN abs(r - median) <= 1 THEN 1 ELSE 0 END), 6) AS acc_1, round(avg(CASE WHEN abs(r - median) <= 2 THEN 1 ELSE 0 END), 6) AS acc_2 FROM rs JOIN md USING (song_id) GROUP BY song_id, median", "seq")
def q_residual_median(t: Tables) -> DataFrame:
    rows = fixtures.sequence(t).select("song_id", ((F.col("event_id") % 13 - 6) / 4.0).cast("double").alias("residual"))
    return scoring.without_median(rows).groupBy("song_id", "median").agg(*(F.round(c, 6).alias(n) for n, c in scoring.tolerance_shares(F.col("residual")).items()))


@query(f"WITH k AS (SELECT song_id, {duck.repetition_key('text')} AS key, count(*) AS n FROM lines GROUP BY ALL) SELECT song_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE n >= 3), 0) AS BIGINT) AS n_repeated, round(coalesce(sum(n) FILTER (WHERE n >= 3), 0) / sum(n), 6) AS share FROM k GROUP BY song_id", "lines")
def q_repetition_rate(t: Tables) -> DataFrame:
    return scoring.repetition(fixtures.lines(t).withColumn("key", text.repetition_key(F.col("text"))), "key").withColumn("share", r6("share"))


@query(
    f"""WITH w AS (SELECT song_id, line_no AS line, list_distinct(list_filter(string_split({duck.normalize('text')}, ' '), lambda x: length(x) <= 4)) AS ws FROM lines),
    p AS (SELECT *, lag(ws) OVER (PARTITION BY song_id ORDER BY line) AS pw FROM w),
    a AS (SELECT *, CASE WHEN pw IS NULL THEN 1 WHEN len(list_distinct(list_concat(ws, pw))) = 0 THEN 0 WHEN len(list_intersect(ws, pw)) / len(list_distinct(list_concat(ws, pw))) < 0.3 THEN 1 ELSE 0 END AS apart FROM p),
    r AS (SELECT song_id, sum(apart) OVER (PARTITION BY song_id ORDER BY line) AS run FROM a), c AS (SELECT song_id, run, count(*) AS n FROM r GROUP BY ALL)
    SELECT song_id, max(n) AS longest FROM c GROUP BY song_id""",
    "lines",
)
def q_neardup_runs(t: Tables) -> DataFrame:
    w = F.array_distinct(F.filter(F.split(text.normalize(F.col("text")), " "), lambda x: F.length(x) <= 4))
    return scoring.near_runs(fixtures.lines(t).select("song_id", F.col("line_no").alias("line"), w.alias("words")), 0.3)


@query("SELECT CAST(quality AS BIGINT) AS label, median(CAST(n_chars AS DOUBLE)) AS median_chars, median(CAST(len(string_split(text, chr(10))) AS DOUBLE)) AS median_lines, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def q_signal_medians(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", F.size(F.split("text", "\n")).alias("n_lines")).join(t.labels, "doc_id")
    return rows.groupBy(F.col("quality").alias("label")).agg(F.median("n_chars").alias("median_chars"), F.median("n_lines").alias("median_lines"), F.count("*").alias("n"))


# --- kernels ---


def _hints(t: Tables) -> DataFrame:
    """Lines of the words of every third segment, some misspelt and every seventh missing."""
    w = fixtures.words(t).where("seg % 3 <> 2").select("song_id", "seg", "pos", "text")
    w = w.where("pos % 7 <> 3").withColumn("text", F.when(F.col("pos") % 5 == 4, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    raw = w.groupBy("song_id", F.col("seg").alias("index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    return lyrics.hint_words(raw.select("song_id", "index", "text", text.normalize(F.col("text")).alias("normalized"), F.lit(False).alias("is_ref")))


def _clean(t: Tables) -> DataFrame:
    return words.clean_words(fixtures.words(t))


@query()
def q_word_align(t: Tables) -> DataFrame:
    return reconcile.align(_hints(t), _clean(t)).withColumn("sim", r6("sim"))


@query()
def q_reconcile(t: Tables) -> DataFrame:
    return reconcile.reconcile(_hints(t), _clean(t))


@query()
def q_recover_missing(t: Tables) -> DataFrame:
    return reconcile.reconcile(_hints(t), _clean(t), recover_missing=True).where("recovered")


@query()
def q_ctc_align(t: Tables) -> DataFrame:
    return ctc.align_lines(fixtures.frames(t), _frame_lines(t))


def _frame_lines(t: Tables) -> DataFrame:
    """All lines, with all words, of the songs that have frames."""
    rows = fixtures.lines(t).join(fixtures.frames(t).select("song_id").distinct(), "song_id", "left_semi")
    return rows.select("song_id", F.col("line_no").alias("line"), F.array_join(text.words_of(F.col("text")), " ").alias("text"))


@query()
def q_refine(t: Tables) -> DataFrame:
    rows = _frame_lines(t).select("song_id", F.col("line").alias("line_index"), (F.col("line") * 250.0).alias("start_ms"), (F.col("line") * 250.0 + 200.0).alias("end_ms"), F.lit(0.3).cast("double").alias("confidence"), "text", F.col("text").alias("align_text"))
    return ctc.refine(rows, fixtures.frames(t), lead_ms=40)


@query()
def q_block_score(t: Tables) -> DataFrame:
    # both sides of a line at once, so that words are found once
    t_s = F.col("line") * 2.0
    gt = F.struct(F.lit(score.REFERENCE).alias("side"), t_s.alias("t_s"), "words")
    pred = F.struct(F.lit(score.PREDICTED).alias("side"), (t_s + 0.3).alias("t_s"), F.col("pred_words").alias("words"))
    sides = F.when(F.col("line") % 4 != 3, F.array(gt, pred)).otherwise(F.array(gt))
    rows = _edited(t).select("song_id", F.col("line").alias("at"), F.explode(sides).alias("s")).select("song_id", "at", "s.*")
    return score.totals(score.score_sides(rows))
