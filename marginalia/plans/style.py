"""Fingerprint queries. SQL checks the counts as integers and the statistics in scaled integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalar as S
from ..operators import style
from .leaf import leaf
from .language import quoted, text_sql, token_sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: a fingerprint has no rule of language."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = style.counted(style.windows(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text"))
    return rows.select("doc_id", F.col("window_id").cast("long").alias("window_id"), "words", "sentences", "in_sentences", "squares", "subordinators", "rare", "articles", F.round(F.col("ttr") * 1000000).cast("long").alias("ttr"), "commas", "semis", "dash_marks", "simile_marks", "adverb_words", "quoted")


def _micro(c: str):
    return F.round(F.col(c) * 1000).cast("long").alias(c)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.fit(_docs(spark, sf_dir), "source").select("grp", "metric", "windows", _micro("mean"), _micro("sd"))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its source's baseline. Windows and texts are measured in one
    pass and written: the baseline and the scores both read them."""
    rows = leaf(style.profiled(_docs(spark, sf_dir), "source"))
    return style.drift(style.scored(rows.where("whole"), style.baseline(rows.where("not whole")))).select("doc_id", F.round("drift", 2).alias("drift"), "notable", "metrics")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = leaf(style.fit(_docs(spark, sf_dir), "source"))  # both sides of the join read it
    return style.nearest_group(base).select("grp", "nearest", F.round("distance", 3).alias("distance"), "alike")


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of the roles of conversations."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "role", "text")
    return style.fit(chats, "role").select("grp", "metric", "windows", _micro("mean"), _micro("sd"))


QUERIES = {"style_windows": window_counts, "fingerprint_by_source": fingerprints, "drift_by_document": drift, "nearest_fingerprint": nearest, "speaker_fingerprints": speakers}

def _cut(source: str, key: str, where: str = "true") -> str:
    """CTEs up to `kept`: the sentences of each window of six."""
    return f"""{token_sql(where, source, key)},
        n AS (SELECT doc_id, count(*) AS spans, sum(n) AS all_words FROM sent GROUP BY 1),
        cut AS (SELECT doc_id, sent_idx, CASE WHEN spans < 3 THEN 0 ELSE sent_idx // 6 END AS window_id, ws, n, opener, body FROM sent JOIN n USING (doc_id) WHERE spans >= 3 OR all_words >= 20),
        full_ AS (SELECT doc_id, window_id, count(*) AS spans FROM cut GROUP BY 1, 2 HAVING count(*) >= 3 OR (window_id = 0 AND count(*) = (SELECT x.spans FROM n x WHERE x.doc_id = cut.doc_id))),
        kept AS (SELECT cut.* FROM cut JOIN full_ USING (doc_id, window_id))"""


def _counts(kept: str, p: str = "") -> str:
    """CTEs up to `c`: the counts of each group of sentences in `kept`; p tells two of them apart."""
    ly = quoted([w for w in L.LY_KEEP if w != "italy"])
    return f"""
        ww{p} AS (SELECT doc_id, window_id, sent_idx, unnest(ws) AS norm, generate_subscripts(ws, 1) AS j FROM {kept}),
        wk{p} AS (SELECT doc_id, window_id, regexp_replace(norm, '^[''-]+|[''-]+$', '', 'g') AS k, row_number() OVER (PARTITION BY doc_id, window_id ORDER BY sent_idx, j) - 1 AS pos FROM ww{p}),
        sz{p} AS (SELECT doc_id, window_id, count(*) AS words, count(*) FILTER (k IN ({quoted(L.SUBORDINATORS)})) AS subordinators, count(*) FILTER (k NOT IN ({quoted(L.STOPWORDS)})) AS rare,
                         count(*) FILTER (regexp_full_match(k, '[a-z]{{2,}}ly') AND k NOT IN ({ly})) AS adverb_words FROM wk{p} GROUP BY 1, 2 HAVING count(*) >= 5),
        steps{p} AS (SELECT doc_id, window_id, words, unnest(range(0, greatest(0, words - 50) + 1, 25)) AS st FROM sz{p}),
        dist{p} AS (SELECT s.doc_id, s.window_id, st, count(DISTINCT k) AS d, least(50, any_value(words)) AS width FROM steps{p} s JOIN wk{p} w ON s.doc_id = w.doc_id AND s.window_id = w.window_id AND pos >= st AND pos < st + 50 GROUP BY 1, 2, 3),
        mt{p} AS (SELECT doc_id, window_id, sum(d) / any_value(width) / count(*) AS ttr FROM dist{p} GROUP BY 1, 2),
        sl{p} AS (SELECT doc_id, window_id, count(*) FILTER (n > 0) AS sentences, count(*) AS spans, CAST(sum(n) AS BIGINT) AS in_sentences, CAST(sum(n * n) AS BIGINT) AS squares, count(*) FILTER (opener IN ('a', 'an', 'the')) AS articles,
                         string_agg(body, ' ' ORDER BY sent_idx) AS t FROM {kept} GROUP BY 1, 2),
        q{p} AS (SELECT doc_id, window_id, unnest(regexp_extract_all(t, '["“]([^"“”]{{2,600}}?)["”]', 1)) AS said FROM sl{p}),
        qn{p} AS (SELECT doc_id, window_id, sum(len(regexp_extract_all(said, {text_sql(S.WORD)}))) AS quoted FROM q{p} GROUP BY 1, 2),
        c{p} AS (SELECT *, coalesce(quoted, 0) AS quoted_words, length(t) - length(replace(t, ',', '')) AS commas, length(t) - length(replace(t, ';', '')) AS semis,
                        len(regexp_extract_all(t, '[—–]')) + len(regexp_extract_all(t, ' - ')) AS dash_marks, len(regexp_extract_all(regexp_replace(t, '[À-ɏ]', 'x', 'g'), '(?i)\\b(?:like a|like an|as if|as though|as \\w+ as)\\b')) AS simile_marks
                 FROM sz{p} JOIN sl{p} USING (doc_id, window_id) JOIN mt{p} USING (doc_id, window_id) LEFT JOIN qn{p} USING (doc_id, window_id))"""


def _metrics(p: str = "") -> str:
    """CTE `long`: (doc_id, window_id, words, sentences, metric, value)."""
    w = "words::DOUBLE"
    of = {
        "sentence_words": "in_sentences::DOUBLE / sentences", "sentence_spread": "CASE WHEN sentences > 1 THEN sqrt(greatest(0, squares::DOUBLE / sentences - (in_sentences::DOUBLE / sentences) * (in_sentences::DOUBLE / sentences))) / (in_sentences::DOUBLE / sentences) ELSE 0 END",
        "comma_density": f"commas * 100 / {w}", "semicolons": f"semis * 1000 / {w}", "dashes": f"dash_marks * 1000 / {w}", "subordination": "subordinators::DOUBLE / sentences", "rarity": f"rare / {w}", "ttr": "ttr",
        "adverbs": f"adverb_words * 1000 / {w}", "article_openings": "articles::DOUBLE / spans", "similes": f"simile_marks * 1000 / {w}", "dialogue": f"quoted_words / {w}",
    }
    return f"long{p} AS (" + " UNION ALL ".join(f"SELECT doc_id, window_id, words, sentences, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM c{p}" for m, x in of.items()) + ")"


_SOURCES = "grp_of AS (SELECT doc_id, source AS grp FROM documents)"
_BASE = "base AS (SELECT grp, metric, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS windows FROM long JOIN grp_of USING (doc_id) GROUP BY 1, 2)"
_FIT = f"{_cut('documents', 'doc_id')}, {_counts('kept')}, {_metrics()}, {_SOURCES}, {_BASE}"
_SHOWN = "SELECT grp, metric, windows, CAST(round(mean * 1000) AS BIGINT) AS mean, CAST(round(sd * 1000) AS BIGINT) AS sd FROM base"
_CLAMP = lambda x, limit: f"greatest(-{limit}, least({limit}, {x}))"

ORACLES = {
    "style_windows": f"""
        WITH {_cut("documents", "doc_id")}, {_counts("kept")}
        SELECT doc_id, window_id, words, sentences, in_sentences, squares, subordinators, rare, articles, CAST(round(ttr * 1000000) AS BIGINT) AS ttr, commas, semis, CAST(dash_marks AS BIGINT) AS dash_marks,
               CAST(simile_marks AS BIGINT) AS simile_marks, adverb_words, CAST(quoted_words AS BIGINT) AS quoted FROM c""",
    "fingerprint_by_source": f"WITH {_FIT} {_SHOWN}",
    "speaker_fingerprints": f"""
        WITH chats AS (SELECT row_number() OVER () AS id, role, text FROM conversations), {_cut("chats", "id")}, {_counts("kept")}, {_metrics()}, grp_of AS (SELECT id AS doc_id, role AS grp FROM chats), {_BASE} {_SHOWN}""",
    "nearest_fingerprint": f"""
        WITH {_FIT},
        far AS (SELECT a.grp, b.grp AS other, sqrt(avg(pow({_CLAMP("(a.mean - b.mean) / greatest(a.sd, abs(a.mean) * 0.02::DOUBLE, 1e-6)", 6)}, 2))) AS distance FROM base a JOIN base b USING (metric) WHERE a.grp <> b.grp GROUP BY 1, 2)
        SELECT grp, arg_min(other, distance) AS nearest, round(min(distance), 3) AS distance, min(distance) < 1 AS alike FROM far GROUP BY 1""",
    "drift_by_document": f"""
        WITH {_FIT}, whole AS (SELECT doc_id, 0 AS window_id, sent_idx, ws, n, opener, body FROM sent), {_counts("whole", "2")}, {_metrics("2")},
        z0 AS (SELECT *, coalesce(sd, 0) AS dev FROM long2 JOIN grp_of USING (doc_id) JOIN base USING (grp, metric)
               WHERE (CASE metric WHEN 'sentence_spread' THEN sentences >= 3 WHEN 'article_openings' THEN sentences >= 3 WHEN 'subordination' THEN sentences >= 2 ELSE true END) AND (metric <> 'ttr' OR words >= 50)),
        z AS (SELECT doc_id, CASE WHEN metric IN ({quoted(style.COUNT_RATES)}) AND abs(value - mean) < {style.NOISE} * 1000 / words::DOUBLE THEN 0
                                  WHEN dev <= greatest(1e-9, abs(mean) * 0.02::DOUBLE) THEN {_CLAMP("3.0::DOUBLE * (value - mean) / greatest(abs(mean), 1e-6)", 3)}
                                  ELSE {_CLAMP("(value - mean) / dev", 6)} END AS z FROM z0)
        SELECT doc_id, round(sqrt(avg(z * z)), 2) AS drift, count(*) FILTER (abs(z) >= 1.5) AS notable, count(*) AS metrics FROM z GROUP BY 1""",
}
