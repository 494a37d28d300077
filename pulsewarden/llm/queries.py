"""The registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from pulsewarden.llm import (
    classifier, decontam, hardneg, katz, language, lexical, linkgraph, mixing, ngramjoin, quality, setsketch, suffix, winnow,
)
from pulsewarden.plans.catalog import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.lm_scores(docs).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


@query
def op4_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs).drop("text", "lang")


@query
def op8_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngramjoin.link_documents(docs).select("doc_id", "n_shingles", "component_id")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@query
def op11_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return setsketch.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    # every seventh row has a wrong label, as in mined data
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors, F.col("vec_id") % 100 == 0, label=label)


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.rank_documents(docs, table(spark, sf_dir, "benchmark"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES["op6_line_dedup"] = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
n AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line,
             len({_WORDS.format('line')}) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM n WHERE words > 0),
w AS (SELECT doc_id, min(pos) OVER f AS a, max(pos) OVER f AS b, list(line) OVER f AS ls, sum(words) OVER f AS words
      FROM c WINDOW f AS (PARTITION BY doc_id ORDER BY upto - words RANGE BETWEEN CURRENT ROW AND {winnow.MIN_WORDS - 1} FOLLOWING)
      UNION ALL
      SELECT doc_id, min(pos) OVER f, max(pos) OVER f, list(line) OVER f, sum(words) OVER f
      FROM c WINDOW f AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {winnow.MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
r AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY ls ORDER BY doc_id, a) AS nth
      FROM (SELECT DISTINCT doc_id, a, b, ls FROM w WHERE words >= {winnow.MIN_WORDS})),
y AS (SELECT DISTINCT n.doc_id, n.pos FROM n JOIN r ON n.doc_id = r.doc_id AND n.pos BETWEEN r.a AND r.b
      WHERE r.nth > 1 AND n.words > 0),
g AS (SELECT n.doc_id, n.pos, CASE WHEN n.words > 0 THEN y.pos IS NOT NULL END AS gone
      FROM n LEFT JOIN y ON n.doc_id = y.doc_id AND n.pos = y.pos),
x AS (SELECT doc_id, pos FROM (
        SELECT doc_id, pos, coalesce(gone, last_value(gone IGNORE NULLS) OVER before AND first_value(gone IGNORE NULLS) OVER after) AS gone
        FROM g WINDOW before AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      after AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE gone),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (x.pos IS NULL) AS text,
             count(x.pos) AS n_removed, count(*) AS n_lines
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def _groups_sql(words: int, percent: int, more: str = "") -> str:
    """Groups of documents by all pairs that share a run of words; ``more`` from the id d.doc_id and the group."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    lower = f"translate(coalesce(text, ''), '{linkgraph.UPPER}', '{linkgraph.LOWER}')"
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(lower)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {words} THEN array_to_string(w, ' ') ELSE {shingle} END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (max(na.n) + max(nb.n) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id{more}
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""


ORACLES["op8_jaccard_groups"] = _groups_sql(3, 90)
ORACLES["op11_near_duplicates"] = _groups_sql(4, 80, ", d.doc_id = min(r.y) AS kept")

ORACLES["op13_lexical_search"] = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, unnest(regexp_extract_all(translate(text, '{linkgraph.UPPER}', '{linkgraph.LOWER}'), '{lexical.TERM}')) AS term
           FROM documents),
p AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY rid, term),
l AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY rid),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
m AS (SELECT rid, 10 + (90 * n * docs) // terms AS m FROM l, c),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
q AS (SELECT row_number() OVER () AS qid, item_id, list_distinct(regexp_extract_all(translate(text, '{linkgraph.UPPER}', '{linkgraph.LOWER}'), '{lexical.TERM}')) AS terms
      FROM benchmark),
i AS (SELECT qid, item_id, unnest(terms) AS term FROM q),
s AS (SELECT qid, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY qid, rid)
SELECT item_id, CAST(row_number() OVER v AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW v AS (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER v <= {lexical.FIRST}
"""

# a score is a sum over the components of 64-bit products, in plain integers
ORACLES["op12_hard_negatives"] = rf"""
WITH q AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.id AS anchor_id, b.id, b.rid AS other, a.label = b.label AS same,
             CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM q a JOIN q b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
p AS (SELECT rid, anchor_id, id AS positive_id, other, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, id NULLS LAST, other) <= {hardneg.POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.rid = p.rid AND NOT s.same
WHERE {hardneg.LEAST_PERCENT} * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.id NULLS LAST, s.other)
QUALIFY row_number() OVER w <= {hardneg.NEGATIVES}
"""


_ROUNDS = 100


def _url_verdicts_sql() -> str:
    """Each round of trust and distrust is one more table; after so many what is missing is below 10^-7."""
    keep, a = 1 - linkgraph.DAMPING, linkgraph.DAMPING
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in linkgraph.RULES)
    url = linkgraph.URL.removeprefix("(?s)")
    lower = lambda x: f"translate({x}, '{linkgraph.UPPER}', '{linkgraph.LOWER}')"
    link = linkgraph.LINK.removeprefix("(?i)").replace("'", "''")
    rounds = "".join(f""",
t{i + 1} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
    SELECT * FROM base
    UNION ALL SELECT dst, {a} * share * trust, 0.0 FROM g JOIN t{i} ON src = host
    UNION ALL SELECT src, 0.0, {a} * share * distrust FROM g JOIN t{i} ON dst = host) GROUP BY host)"""
                     for i in range(_ROUNDS))
    return rf"""
WITH rules(h, p, v) AS (VALUES {rules}),
u AS (SELECT page_id, html, {lower(f"coalesce(regexp_extract(url, '{url}', 1, 's'), '')")} AS host,
             coalesce(regexp_extract(url, '{url}', 2, 's'), '') AS path FROM pages),
m AS (SELECT u.*, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
      FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      GROUP BY page_id, html, host, path),
base AS (SELECT host, {keep} * avg((coalesce(v, '') = 'allow')::DOUBLE) AS trust,
                {keep} * avg((coalesce(v, '') = 'block')::DOUBLE) AS distrust FROM m WHERE host <> '' GROUP BY host),
k AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1, 'i')) AS dst FROM u),
c AS (SELECT src, {lower('dst')} AS dst, count(*) AS n FROM k WHERE src <> {lower('dst')} AND src <> '' GROUP BY ALL),
g AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM c),
t0 AS (SELECT * FROM base){rounds}
SELECT page_id, m.host, path, rule, coalesce(v, CASE WHEN distrust >= {linkgraph.THRESHOLD} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN t{_ROUNDS} t ON t.host = m.host
"""


ORACLES["op5_url_verdicts"] = _url_verdicts_sql()
