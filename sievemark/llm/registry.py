"""Queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, differencing, exact_dedup, host_rules, html_extract, language_id, mixing, near_dedup, packing, perspectives, phrases, resampling, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens; :func:`packing.pack_documents` says what nulls, repeats and empty tables give."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; :func:`html_extract.extract` says what nulls, broken markup and empty tables give."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of the rules on it and on its host; see :func:`host_rules.host_rules`."""
    return host_rules.host_rules(table(spark, sf_dir, "documents")).drop("host_rate")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that learns from those not held out; see :func:`language_id.languages`."""
    docs = table(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.learn(docs))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; see :func:`warc.archive_round_trip`."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue once for each of its speakers; see :func:`perspectives.perspectives`."""
    seen = perspectives.perspectives(table(spark, sf_dir, "conversations"))
    return seen.withColumn("spans", perspectives.span_text(seen["spans"]))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; see :func:`mixing.mix`."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document; see :func:`near_dedup.near_duplicates`."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document; see :func:`exact_dedup.exact_duplicates`."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a sample like the good ones takes; see :func:`resampling.resample`."""
    labels = table(spark, sf_dir, "labels")
    return resampling.resample(table(spark, sf_dir, "documents"), labels.where("quality = 1"), resampling.target_share(labels))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector; see :func:`centroids.cluster`."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_multiway_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in near-equal sequences of at most 2048 tokens; see :func:`differencing.pack_documents`."""
    return differencing.pack_documents(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language; see :func:`phrases.collocations`."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_html_extraction": op2_html_extraction,
        "op3_host_rules": op3_host_rules,
        "op4_language_id": op4_language_id,
        "op5_warc_revisits": op5_warc_revisits,
        "op6_perspective_rotation": op6_perspective_rotation,
        "op7_mix_sources": op7_mix_sources,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_importance_resampling": op10_importance_resampling,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_multiway_differencing": op12_multiway_differencing,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


_OP3 = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM t),
g AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER k || ' ' || lead(word, 2) OVER k || ' ' || lead(word, 3) OVER k || ' ' || lead(word, 4) OVER k AS gram
  FROM w WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM c, (SELECT unnest(range(5)) AS j) WHERE n > 1 GROUP BY doc_id),
l AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (
  SELECT t.doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN r ON r.doc_id = t.doc_id LEFT JOIN l ON l.doc_id = t.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 1e-6 AND m * (1 - m) > v THEN least(m * (1 - m) / v - 1, 1000.0) ELSE 1000.0 END AS s FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((k + m * s) / (n + s) > 0.5, false) AS kept
FROM f LEFT JOIN h ON h.source = f.source CROSS JOIN q
"""

_OP5 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM o
"""

_OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(regexp_replace(trim(coalesce(role, '')), '[\x00-\x20]+', '_', 'g'), ''), 'unknown') AS name,
         regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS text
  FROM conversations),
s AS (SELECT DISTINCT conv_id, name AS assistant FROM t WHERE name <> 'system'),
p AS (
  SELECT t.*, s.assistant,
         '<|im_start|>' || CASE WHEN name = assistant THEN 'assistant' WHEN name = 'system' THEN name ELSE 'user name=' || name END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM t JOIN s ON s.conv_id = t.conv_id),
o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER k - length(body) - 1 AS a, sum(length(head) + length(body) + 1) OVER k - 1 AS b
  FROM p WINDOW k AS (PARTITION BY conv_id, assistant ORDER BY turn NULLS LAST, name, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, assistant, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY turn NULLS LAST, name, text) AS text,
       string_agg(a::VARCHAR || '-' || b::VARCHAR, ',' ORDER BY turn NULLS LAST, name, text) FILTER (name = assistant) AS spans,
       sum(b - a) FILTER (name = assistant)::BIGINT AS n_loss_chars
FROM o GROUP BY conv_id, assistant
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rn - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (
  SELECT *, row_number() OVER k AS place, (sum(source_size) OVER ())::DOUBLE AS total,
         (sum(cap) OVER k - cap)::DOUBLE AS cap_before, ((sum(weight) OVER ()) - (sum(weight) OVER k - weight))::DOUBLE AS weight_left
  FROM w WINDOW k AS (ORDER BY cap / weight, rn ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, min(CASE WHEN (total - cap_before) * weight <= cap * weight_left THEN place END) OVER () AS free FROM o),
g AS (
  SELECT *, max(CASE WHEN place = free THEN total - cap_before END) OVER () AS rest,
         max(CASE WHEN place = free THEN weight_left END) OVER () AS rest_weight
  FROM f),
t AS (
  SELECT source, source_size, CASE WHEN place < free THEN cap ELSE weight * rest / rest_weight END AS target FROM g),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS budget
  FROM t),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.budget,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h))::DOUBLE AS upto,
         (sum(d.size) OVER (PARTITION BY d.source, d.h))::DOUBLE AS same
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN upto <= budget OR (upto - same <= budget AND upto - budget < budget - (upto - same)) THEN 1 ELSE 0 END) AS taken
FROM c
"""

_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE
           WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
           WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def _op11() -> str:
    """Five rounds of assignment and update, written out one after the other."""
    near = """SELECT v.vec_id, v.x, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))), 'k': c.k}}) AS m
  FROM v CROSS JOIN c{0} c GROUP BY v.row, v.vec_id, v.x"""
    parts = [r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
s AS (SELECT x, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, 'null')), x) - 1 AS k FROM v),
c0 AS MATERIALIZED (SELECT k, x FROM s WHERE k < 40)"""]
    for r in range(5):
        parts.append(f"""a{r} AS MATERIALIZED ({near.format(r)}),
u{r} AS (SELECT m.k AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
n{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM u{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(n{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN n{r} ON n{r}.k = c{r}.k)""")
    parts.append(f"a5 AS MATERIALIZED ({near.format(5)})")
    return ",\n".join(parts) + r"""
SELECT vec_id, m.k::INT AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.k = a5.m.k
"""


_OP13 = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
      FROM documents))
  WHERE len(words) > 0),
w AS (SELECT piece, lang, unnest(words) AS word, unnest(range(len(words))) AS i FROM p),
t AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
s AS (
  SELECT lang, word AS w1, lead(word, 1) OVER k AS w2, lead(word, 2) OVER k AS w3, lead(word, 3) OVER k AS w4, lead(word, 4) OVER k AS w5
  FROM w WINDOW k AS (PARTITION BY piece ORDER BY i)),
g AS (
  SELECT lang, [w1] AS ws FROM s UNION ALL SELECT lang, [w1, w2] FROM s WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3] FROM s WHERE w3 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3, w4] FROM s WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5] FROM s WHERE w5 IS NOT NULL),
f AS (SELECT lang, ws, array_to_string(ws, ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, ws HAVING count(*) >= 100),
d AS (
  SELECT DISTINCT x.lang, x.phrase FROM f x JOIN f y ON x.lang = y.lang AND len(y.ws) > len(x.ws) AND y.a >= x.a
  AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') WHERE len(x.ws) > 1),
c AS (
  SELECT lang, phrase, a, ws, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = f.lang AND d.phrase = f.phrase)),
q AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000 * c.a::HUGEINT * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:c.k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[c.k + 1:] JOIN t ON t.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS weak FROM q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE weak = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM z WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_host_rules": _OP3,
        "op5_warc_revisits": _OP5,
        "op6_perspective_rotation": _OP6,
        "op7_mix_sources": _OP7,
        "op8_minhash_near_dedup": _OP8,
        "op9_exact_dedup": _OP9,
        "op11_centroid_clustering": _op11(),
        "op13_phrase_collocations": _OP13,
    }
