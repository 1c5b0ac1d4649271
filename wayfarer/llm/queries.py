"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language

    return language(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar

    return similar(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeats

    return repeats(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media

    return media(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scoring import lm_score

    return lm_score(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import token_files

    return token_files(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codebooks import codes

    return codes(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_packing": op3_packing,
    "op4_repeats": op4_repeats,
    "op5_toxicity": op5_toxicity,
    "op6_vector_near_dedup": op6_vector_near_dedup,
    "op7_mixture": op7_mixture,
    "op8_media": op8_media,
    "op9_quality": op9_quality,
    "op10_lm_score": op10_lm_score,
    "op11_collocations": op11_collocations,
    "op12_token_files": op12_token_files,
    "op13_vector_codes": op13_vector_codes,
}

_SHINGLES = """WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN links ON x = id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(root) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id"""

_VECTORS = """WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT y, root FROM reach JOIN links ON x = id)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM embeddings v
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = v.vec_id JOIN (SELECT id, min(root) AS component_id FROM reach GROUP BY id) c ON c.id = v.vec_id"""

_PHRASES = """WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
size AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
every AS (SELECT lang, w[i:i + k - 1] AS p FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i), LATERAL (SELECT unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k)),
f AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM every GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, s.n, CAST((1000::HUGEINT * c.f * s.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:] JOIN size s ON s.lang = c.lang),
low AS (SELECT lang, p, min({'score': score, 'k': k, 'a': a, 'l': l, 'r': r, 'n': n}) AS m FROM cuts GROUP BY lang, p),
inside AS (SELECT lang, p[i:i + k - 1] AS p, max(f) AS most FROM f, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i), LATERAL (SELECT unnest(range(2, len(p) - i + 2)) AS k) WHERE k < len(p) GROUP BY ALL),
kept AS (SELECT low.lang, array_to_string(low.p, ' ') AS phrase, m FROM low LEFT JOIN inside USING (lang, p) WHERE most IS NULL OR 100 * most < 100 * m.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, m.a DESC, phrase) AS rank, phrase, m.a AS a, m.l AS l, m.r AS r, CAST(m.n AS BIGINT) AS n, m.score AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000"""

#: DuckDB SQL of those that SQL expresses whole; the others are tested against brute force or held-out labels.
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard": _SHINGLES, "op6_vector_near_dedup": _VECTORS, "op11_collocations": _PHRASES}
