"""Queries over `documents` for the craft measurements, each with its DuckDB counterpart.

The SQL works on exploded tokens and windows, the Spark side on arrays within a row, so
the two agree only if both are right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalar as S
from ..operators import craft


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def text_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(col: str) -> str:
    return f"translate({col}, {text_sql(S.FOLD_FROM)}, {text_sql(S.FOLD_TO)})"


def bare(col: str) -> str:
    return f"regexp_replace({col}, '^[''-]+|[''-]+$', '', 'g')"


def token_sql(where: str = "true", source: str = "documents", key: str = "doc_id") -> str:
    """CTEs: tok (every token), w (words with word_idx and key), sent (sentence of each token)."""
    own = r"[\p{L}\p{N}''\-]"
    return f"""
    toks AS (SELECT {key} AS doc_id, regexp_extract_all(coalesce(text, ''), {text_sql(S.LOSSLESS)}) AS ts FROM {source} WHERE {where}),
    tok AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM toks),
    w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS word_idx, t AS word, {norm('t')} AS norm, {bare(norm('t'))} AS key
          FROM tok WHERE regexp_matches(t, '^[{S.LETTER}]')),
    around AS (
        SELECT doc_id, i, t,
            coalesce(lag(t, 6) OVER d, '') || coalesce(lag(t, 5) OVER d, '') || coalesce(lag(t, 4) OVER d, '') || coalesce(lag(t, 3) OVER d, '') || coalesce(lag(t, 2) OVER d, '') || coalesce(lag(t) OVER d, '') AS pre,
            coalesce(lead(t) OVER d, '') || coalesce(lead(t, 2) OVER d, '') AS nx,
            max(CASE WHEN regexp_matches(t, '\\S') THEN i END) OVER (PARTITION BY doc_id) AS last_i
        FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    before AS (SELECT *, lower(regexp_extract(pre, '{own}*$')) AS wd, right(regexp_replace(pre, '{own}*$', ''), 1) AS pc FROM around),
    ends AS (
        SELECT doc_id, i, t, CASE
            WHEN regexp_matches(t, '^\\s+$') THEN CASE WHEN regexp_matches(t, '\\n[ \\t]*\\n') THEN 1 ELSE 0 END
            WHEN NOT regexp_matches(t, '^[.!?…]') THEN 0
            WHEN t = '.' AND regexp_matches(pre, '\\p{{Nd}}$') AND regexp_matches(nx, '^\\p{{Nd}}') THEN 0
            WHEN left(t, 1) = '.' AND wd IN ({quoted(L.NEVER_END)}) THEN 0
            WHEN left(t, 1) = '.' AND wd IN ({quoted(L.LABELS)}) AND regexp_matches(nx, '^[ \\t]*(\\p{{Nd}}|\\p{{Ll}}|[IVXLC]+([^\\p{{L}}\\p{{N}}]|$))') THEN 0
            WHEN left(t, 1) = '.' AND regexp_matches(wd, '^\\p{{L}}$') AND pc IN ('', ' ', chr(9), chr(10), '(', '[', '"', '''', '“', '‘') THEN 0
            WHEN left(t, 1) = '.' AND length(wd) = 1 AND pc = '.' THEN 0
            WHEN i >= last_i THEN 1
            WHEN regexp_matches(nx, '^[ \\t]*\\n[ \\t]*\\n') THEN 1
            WHEN NOT regexp_matches(nx, '^\\s') THEN 0
            WHEN regexp_matches(nx, '^[ \\t]*\\n?[ \\t]*[\\p{{Lu}}\\p{{Nd}}"''“‘(\\[#*\\->—]') THEN 1 ELSE 0 END AS bd
        FROM before),
    numbered AS (SELECT doc_id, i, t, coalesce(sum(bd) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM ends),
    spoken AS (
        SELECT doc_id, sid, count(*) FILTER (regexp_matches(t, '^[{S.LETTER}]')) AS n,
               coalesce(arg_min({norm('t')}, i) FILTER (regexp_matches(t, '^[{S.LETTER}]')), '') AS opener,
               list({norm('t')} ORDER BY i) FILTER (regexp_matches(t, '^[{S.LETTER}]')) AS ws,
               regexp_replace(string_agg(t, '' ORDER BY i), '^\\s+|\\s+$', '', 'g') AS body
        FROM numbered GROUP BY 1, 2 HAVING count(*) FILTER (regexp_matches(t, '\\S')) > 0),
    sent AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS sent_idx FROM spoken)
    """


SYLLABLES = """CASE WHEN length(y) = 0 THEN 0 WHEN length(y) <= 3 THEN 1 ELSE greatest(1,
    len(regexp_extract_all(y, '[aeiouy]+'))
    - CASE WHEN regexp_matches(y, 'e$') AND NOT regexp_matches(y, '(ee|ye)$') THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(y, '[^aeiouy]le$') THEN 1 ELSE 0 END
    - CASE WHEN regexp_matches(y, '[^td]ed$') THEN 1 ELSE 0 END) END"""

EN = "lang = 'en'"


def _docs(spark: SparkSession, sf_dir: str, english: bool = False) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return docs.where(EN) if english else docs


def _over(fn, english: bool = False):
    return lambda spark, sf_dir: fn(_docs(spark, sf_dir, english))


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, and the scores in hundredths rounded down."""
    out = craft.readability(_docs(spark, sf_dir, True))
    return out.select("doc_id", "words", "sentences", "syllables", "long_words", *[F.floor(F.col(c) * 100 + F.lit(1e-6)).cast("long").alias(c) for c in ("ease", "grade", "fog")])


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = craft.lengths(_docs(spark, sf_dir))
    tenth = lambda c: F.round(F.col(c) * 10).cast("long").alias(c)
    return d.select("doc_id", "n", "total", "squares", F.col("shortest").cast("long"), F.col("longest").cast("long"), tenth("p10"), tenth("p50"), tenth("p90"), "flat")


def syllable_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.transform(S.words(F.col("text")), S.syllables).alias("y"))
    total = F.aggregate("y", F.lit(0).cast("long"), lambda a, b: a + b)
    return d.select("doc_id", total.alias("syllables"), F.size(F.filter("y", lambda n: n >= 3)).cast("long").alias("long_words"))


def opener_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return craft.opener_top(_docs(spark, sf_dir))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("sentences"), F.aggregate(F.transform(s, F.char_length), F.lit(0).cast("long"), lambda a, b: a + b).alias("chars"))


def paragraph_lengths(spark, sf_dir):
    """Quantiles in tenths, as for sentences."""
    out = craft.paragraph_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    tenths = {f"p{q}": F.round(F.col(f"p{q}") * 10).cast("long").alias(f"p{q}") for q in (10, 50, 90)}
    return out.select(*[tenths.get(c, F.col(c).cast("long").alias(c) if c != "doc_id" else F.col(c)) for c in out.columns])


def opener_variety(spark, sf_dir):
    out = craft.opener_variety(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "sentences", "openers", F.round(F.col("openers") * 1000 / F.col("sentences")).cast("long").alias("variety"))


QUERIES = {
    "paragraph_lengths": paragraph_lengths,
    "opener_variety": opener_variety,
    "word_counts": _over(craft.word_counts),
    "lossless_tokens": _over(craft.offsets),
    "token_spans": _over(craft.token_spans),
    "syllable_totals": syllable_totals,
    "sentence_counts": sentence_counts,
    "sentence_lengths": lengths,
    "readability": readability,
    "echo_pairs": _over(craft.echoes, True),
    "filter_words": _over(craft.filter_words, True),
    "passive_sentences": _over(craft.passives, True),
    "opener_runs": _over(craft.opener_runs),
    "opener_top20": opener_top,
    "stock_phrases": _over(craft.phrases, True),
    "modal_counts": _over(craft.modals, True),
    "acronym_counts": _over(craft.acronyms),
    "term_spellings": _over(craft.terms, True),
    "dialogue_share": _over(craft.dialogue),
    "token_estimates": token_estimates,
    "extractive_summaries": _over(craft.summaries),
}

ORACLES = {
    "word_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(text, {text_sql(S.WORD)})) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars FROM documents",
    "lossless_tokens": f"""
        WITH {token_sql()}
        SELECT doc_id, count(*) AS tokens, count(*) FILTER (regexp_matches(t, '^[{S.LETTER}]')) AS words, CAST(sum(length(t)) AS BIGINT) AS covered,
               string_agg(t, '' ORDER BY i) = any_value(text) AS lossless
        FROM tok JOIN documents USING (doc_id) GROUP BY doc_id""",
    "token_spans": f"""
        WITH {token_sql()}
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, CAST(e - length(t) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", t AS token
        FROM (SELECT doc_id, i, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM tok)""",
    "syllable_totals": f"""
        WITH {token_sql()}, y AS (SELECT doc_id, regexp_replace(norm, '[^a-z]', '', 'g') AS y FROM w), n AS (SELECT doc_id, {SYLLABLES} AS n FROM y)
        SELECT documents.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS syllables, count(*) FILTER (n >= 3) AS long_words
        FROM documents LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "sentence_counts": f"""
        WITH {token_sql()}
        SELECT documents.doc_id, count(sid) AS sentences, CAST(coalesce(sum(length(body)), 0) AS BIGINT) AS chars FROM documents LEFT JOIN sent USING (doc_id) GROUP BY 1""",
    "paragraph_lengths": f"""
        WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS t FROM documents),
        s AS (SELECT doc_id, len(regexp_extract_all(t, {text_sql(S.WORD)})) AS n FROM p)
        SELECT doc_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * n) AS BIGINT) AS squares, min(n) AS shortest, max(n) AS longest,
               CAST(round(quantile_cont(n, 0.1) * 10) AS BIGINT) AS p10, CAST(round(quantile_cont(n, 0.5) * 10) AS BIGINT) AS p50, CAST(round(quantile_cont(n, 0.9) * 10) AS BIGINT) AS p90
        FROM s WHERE n > 0 GROUP BY doc_id""",
    "opener_variety": f"""
        WITH {token_sql()} SELECT doc_id, count(*) AS sentences, count(DISTINCT opener) AS openers, CAST(round(count(DISTINCT opener) * 1000 / count(*)) AS BIGINT) AS variety FROM sent GROUP BY 1""",
    "sentence_lengths": f"""
        WITH {token_sql()}, s AS (SELECT doc_id, n FROM sent WHERE n > 0)
        SELECT doc_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * n) AS BIGINT) AS squares, min(n) AS shortest, max(n) AS longest,
               CAST(round(quantile_cont(n, 0.1) * 10) AS BIGINT) AS p10, CAST(round(quantile_cont(n, 0.5) * 10) AS BIGINT) AS p50, CAST(round(quantile_cont(n, 0.9) * 10) AS BIGINT) AS p90,
               count(*) >= 12 AND sqrt(greatest(0, sum(n * n) / count(*) - (sum(n) / count(*)) * (sum(n) / count(*)))) < 0.35 * (sum(n) / count(*)) AS flat
        FROM s GROUP BY doc_id""",
    "readability": f"""
        WITH {token_sql(EN)},
        y AS (SELECT doc_id, {SYLLABLES} AS n FROM (SELECT doc_id, regexp_replace(norm, '[^a-z]', '', 'g') AS y FROM w)),
        a AS (SELECT doc_id, count(*) AS words, CAST(sum(n) AS BIGINT) AS syllables, count(*) FILTER (n >= 3) AS long_words FROM y GROUP BY 1 HAVING count(*) >= 40),
        b AS (SELECT doc_id, count(*) AS sentences FROM sent GROUP BY 1)
        SELECT doc_id, words, sentences, syllables, long_words,
               CAST(floor((206.835::DOUBLE - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (syllables / words)) * 100 + 1e-6) AS BIGINT) AS ease,
               CAST(floor((0.39::DOUBLE * (words / sentences) + 11.8::DOUBLE * (syllables / words) - 15.59::DOUBLE) * 100 + 1e-6) AS BIGINT) AS grade,
               CAST(floor(0.4::DOUBLE * (words / sentences + 100.0::DOUBLE * long_words / words) * 100 + 1e-6) AS BIGINT) AS fog
        FROM a JOIN b USING (doc_id)""",
    "echo_pairs": f"""
        WITH {token_sql(EN)},
        k AS (SELECT doc_id, word_idx, CASE WHEN length(key) > 5 AND key LIKE '%s' THEN left(key, length(key) - 1) ELSE key END AS stem
              FROM w WHERE length(key) >= 5 AND key NOT IN ({quoted(L.STOPWORDS)})),
        p AS (SELECT *, lag(word_idx) OVER (PARTITION BY doc_id, stem ORDER BY word_idx) AS prev, count(*) OVER (PARTITION BY doc_id, stem) AS uses FROM k)
        SELECT doc_id, stem, prev AS first_idx, word_idx, word_idx - prev AS distance FROM p WHERE uses <= 5 AND word_idx - prev <= 120""",
    "filter_words": f"""
        WITH {token_sql(EN)},
        d AS (SELECT doc_id, count(*) AS words, count(*) FILTER (key IN ({quoted(L.FILTER_WORDS)})) AS filters,
                     count(*) FILTER (regexp_matches(key, '^[a-z]{{2,}}ly$') AND key NOT IN ({quoted(L.LY_KEEP)})) AS adverbs FROM w GROUP BY 1 HAVING count(*) >= 60)
        SELECT doc_id, words, filters, adverbs,
               filters * 1000 / words > greatest(6, 2.5 * (sum(filters) OVER ()) * 1000 / (sum(words) OVER ())) AS heavy_filters,
               adverbs * 1000 / words > greatest(6, 2.5 * (sum(adverbs) OVER ()) * 1000 / (sum(words) OVER ())) AS heavy_adverbs
        FROM d""",
    "passive_sentences": f"""
        WITH {token_sql(EN)},
        p AS (SELECT doc_id, sid, unnest(ws) AS x, generate_subscripts(ws, 1) AS j FROM sent),
        l AS (SELECT doc_id, sid, x, coalesce(lead(x) OVER q, '') AS x1, coalesce(lead(x, 2) OVER q, '') AS x2 FROM p WINDOW q AS (PARTITION BY doc_id, sid ORDER BY j)),
        f AS (SELECT doc_id, sid, max(CASE WHEN x IN ({quoted(L.BE)}) AND (
                  x1 IN ({quoted(L.IRREGULAR)}) OR (length(x1) > 4 AND x1 LIKE '%ed' AND x1 NOT IN ({quoted(L.NOT_PARTICIPLE)}))
                  OR (regexp_matches(x1, '^[a-z]{{2,}}ly$') AND (x2 IN ({quoted(L.IRREGULAR)}) OR (length(x2) > 4 AND x2 LIKE '%ed' AND x2 NOT IN ({quoted(L.NOT_PARTICIPLE)}))))
              ) THEN 1 ELSE 0 END) AS hit FROM l GROUP BY 1, 2)
        SELECT doc_id, count(*) AS sentences, CAST(sum(coalesce(hit, 0)) AS BIGINT) AS passives FROM sent LEFT JOIN f USING (doc_id, sid) GROUP BY 1 HAVING count(*) >= 5""",
    "opener_runs": f"""
        WITH {token_sql()},
        g AS (SELECT doc_id, sent_idx, opener, sent_idx - row_number() OVER (PARTITION BY doc_id, opener ORDER BY sent_idx) AS grp FROM sent WHERE opener <> '')
        SELECT doc_id, min(sent_idx) AS sent_idx, opener, count(*) AS run FROM g GROUP BY doc_id, opener, grp HAVING count(*) >= 3""",
    "opener_top20": f"WITH {token_sql()} SELECT opener, count(*) AS n FROM sent GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "stock_phrases": f"""
        WITH {token_sql(EN)},
        g AS (SELECT doc_id, norm || ' ' || lead(norm, 1) OVER q || ' ' || lead(norm, 2) OVER q || ' ' || lead(norm, 3) OVER q AS phrase,
                     key IN ({quoted(L.STOPWORDS)}) AND lead(key, 1) OVER q IN ({quoted(L.STOPWORDS)}) AND lead(key, 2) OVER q IN ({quoted(L.STOPWORDS)}) AND lead(key, 3) OVER q IN ({quoted(L.STOPWORDS)}) AS plain
              FROM w WINDOW q AS (PARTITION BY doc_id ORDER BY word_idx))
        SELECT doc_id, phrase, count(*) AS n FROM g WHERE phrase IS NOT NULL AND NOT plain GROUP BY 1, 2 HAVING count(*) >= 4""",
    "modal_counts": f"""
        WITH {token_sql(EN)}, c AS (SELECT doc_id, {", ".join(f"count(*) FILTER (key = '{m}') AS {m}" for m in L.MODALS)} FROM documents LEFT JOIN w USING (doc_id) WHERE {EN} GROUP BY 1)
        SELECT *, shall >= 3 AND must >= 3 AS mixed_duty, may >= 3 AND can >= 3 AS mixed_leave FROM c""",
    "acronym_counts": f"""
        WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS acronym FROM documents)
        SELECT doc_id, acronym, count(*) AS n FROM a WHERE regexp_full_match(acronym, '[A-Z][A-Z0-9]{{1,7}}') AND acronym NOT IN ({quoted(L.ACRONYM_SKIP)}) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "term_spellings": f"""
        WITH r AS (SELECT unnest(list_concat({", ".join(f"regexp_extract_all(text, {text_sql(rx)})" for rx in craft.TERM_FORMS)})) AS run FROM documents WHERE {EN}),
        p AS (SELECT regexp_split_to_array(trim(run), '\\s+') AS ws FROM r),
        m AS (SELECT ws, [regexp_replace(translate(w, {text_sql(S.FOLD_FROM)}, {text_sql(S.FOLD_TO)}), '^[''-]+|[''-]+$', '', 'g') IN ({quoted([*L.STOPWORDS, *L.CONNECTIVES])}) FOR w IN ws] AS plain, [lower(w) IN ({quoted(L.CONNECTIVES)}) FOR w IN ws] AS joins FROM p),
        c AS (SELECT array_to_string(ws[list_position(plain, false) : len(ws) + 1 - list_position(list_reverse(joins), false)], ' ') AS form FROM m WHERE NOT list_bool_and(plain)),
        k AS (SELECT lower(form) AS form, regexp_replace({norm('form')}, '[^a-z0-9]', '', 'g') AS k FROM c WHERE length(form) >= 4 AND {bare(norm('form'))} NOT IN ({quoted([*L.STOPWORDS, *L.CONNECTIVES])})),
        t AS (SELECT form, CASE WHEN length(k) > 4 AND k LIKE '%ies' THEN left(k, length(k) - 3) || 'y' WHEN length(k) > 4 AND k LIKE '%ses' THEN left(k, length(k) - 2)
                                WHEN length(k) > 4 AND k LIKE '%es' THEN left(k, length(k) - 2) WHEN length(k) > 4 AND k LIKE '%s' THEN left(k, length(k) - 1) ELSE k END AS key FROM k),
        f AS (SELECT key, form, count(*) AS n FROM t WHERE length(key) >= 4 GROUP BY 1, 2)
        SELECT key, count(*) AS forms, CAST(sum(n) AS BIGINT) AS uses, string_agg(form, '|' ORDER BY form) AS spellings FROM f GROUP BY 1
        HAVING count(*) >= 2 AND (sum(n) >= 3 OR count(DISTINCT regexp_replace(form, '[^a-z0-9]', '', 'g')) = 1)""",
    "dialogue_share": f"""
        WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '["“]([^"“”]{{2,600}}?)["”]', 1) AS said FROM documents),
        q AS (SELECT doc_id, unnest(CASE WHEN len(said) > 0 THEN said ELSE regexp_extract_all(regexp_replace(text, '([\\p{{L}}])[''‘’]+([\\p{{L}}])', '\\1\\2', 'g'), '[''‘]([^''‘\n]{{4,600}}?)[''’]', 1) END) AS said FROM s),
        n AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(said, {text_sql(S.WORD)}))) AS BIGINT) AS quoted FROM q GROUP BY 1),
        d AS (SELECT doc_id, CAST(len(regexp_extract_all(text, {text_sql(S.WORD)})) AS BIGINT) AS words FROM documents)
        SELECT doc_id, words, coalesce(quoted, 0) AS quoted FROM d LEFT JOIN n USING (doc_id) WHERE words >= 100""",
    "token_estimates": f"""
        SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE floor(greatest(length(text) / 3.6::DOUBLE, len(regexp_extract_all(text, {text_sql(S.WORD)})) / 0.75::DOUBLE)) + 1 END AS INTEGER) AS tokens FROM documents""",
    "extractive_summaries": f"""
        WITH {token_sql()}, f AS (SELECT doc_id, sent_idx, regexp_replace(body, '\\s+', ' ', 'g') AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM sent)
        SELECT doc_id, string_agg(s, ' ' ORDER BY sent_idx) FILTER (sent_idx < 2) || CASE WHEN any_value(n) > 3 THEN ' … ' || max(CASE WHEN sent_idx = n - 1 THEN s END) ELSE '' END AS summary
        FROM f GROUP BY doc_id""",
}
