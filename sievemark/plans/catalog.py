"""Queries of the evidence operators over the test corpora, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import redaction as R
from ..functions import text as T
from ..functions.pattern import Pattern
from ..operators import access as AC
from ..operators import audit as A
from ..operators import budget as B
from ..operators import changes as C
from ..operators import files as FI
from ..operators import ignore as IG
from ..operators import modules as MO
from ..operators import nodes as N
from ..operators import ranges as G
from ..operators import search as S
from ..operators import semantic as M
from ..operators import stats as ST
from ..operators import structure as X
from ..operators import syntax as SX
from ..session import cut
from ..sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Sources and their lines, as the adapters make them.
_SOURCES = "s AS (SELECT concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path, text, doc_id, lang, source FROM documents)"
_LINES = _SOURCES + """,
p AS (SELECT path, string_split(text, chr(10)) AS a FROM s),
u AS (SELECT path, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no, len(a) AS k FROM p),
l AS (SELECT path, line, line_no::INT AS line_no FROM u WHERE NOT (line = '' AND line_no = k))"""


def _count(text: str, term: str) -> str:
    return f"((octet_length(encode({text})) - octet_length(encode(replace({text}, '{term}', '')))) // {len(term.encode())})::BIGINT"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


TION = Pattern("tion", literal=True)


def _skip(key: str, one: int, most: int, files: int) -> str:
    """A fold that skips what does not fit."""
    return f"""WITH RECURSIVE {_SOURCES}, z AS (SELECT path, {key} AS g, octet_length(encode(text))::BIGINT AS size FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY path) AS k FROM z WHERE size <= {one}),
t(g, k, used, n, path, size, ok) AS (SELECT DISTINCT g, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, false FROM r UNION ALL
SELECT r.g, r.k, used + CASE WHEN used + r.size <= {most} AND n < {files} THEN r.size ELSE 0 END, n + CASE WHEN used + r.size <= {most} AND n < {files} THEN 1 ELSE 0 END, r.path, r.size, used + r.size <= {most} AND n < {files}
FROM t JOIN r ON r.g = t.g AND r.k = t.k + 1)"""


# Content search


@query(f"WITH {_LINES} SELECT path, line_no, {_count('line', 'tion')} AS n FROM l WHERE contains(line, 'tion')")
def literal_lines(spark, d):
    return S.matching_lines(corpus.documents(spark, d), TION).select("path", "line_no", "n")


@query(f"WITH {_LINES} SELECT path, count(*) AS match_lines, sum({_count('line', 'tion')})::BIGINT AS occurrences FROM l WHERE contains(line, 'tion') GROUP BY path")
def literal_summary(spark, d):
    return S.ordered_summary(S.summary(corpus.documents(spark, d), TION))


@query(f"WITH {_LINES} SELECT path, line_no, len(regexp_extract_all(line, '[0-9]{{3,}}'))::BIGINT AS n FROM l WHERE regexp_matches(line, '[0-9]{{3,}}')")
def regex_lines(spark, d):
    return S.matching_lines(corpus.documents(spark, d), Pattern("[0-9]{3,}")).select("path", "line_no", "n")


@query(f"WITH {_LINES} SELECT path, line_no, {_count('lower(line)', 'the')} AS n FROM l WHERE contains(lower(line), 'the')")
def ignore_case(spark, d):
    return S.matching_lines(corpus.documents(spark, d), Pattern("THE", literal=True, ignore_case=True)).select("path", "line_no", "n")


@query(f"WITH {_LINES} SELECT 'erh' AS pattern, count(*) AS match_lines FROM l WHERE contains(lower(line), 'erh') UNION ALL SELECT 'Erh', count(*) FROM l WHERE contains(line, 'Erh')")
def smart_case(spark, d):
    out = None
    for text in ("erh", "Erh"):
        one = S.matching_lines(corpus.documents(spark, d), Pattern(text, literal=True, ignore_case=None)).agg(F.count(F.lit(1)).alias("match_lines")).select(F.lit(text).alias("pattern"), "match_lines")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_LINES} SELECT path, count(*) AS match_lines FROM l WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])tion($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])') GROUP BY path")
def whole_word(spark, d):
    return S.summary(corpus.documents(spark, d), Pattern("tion", literal=True, whole_word=True)).select("path", "match_lines")


@query(
    f"""WITH {_LINES},
m AS (SELECT path, line_no, line, (strpos(line, 'tion') - 1)::BIGINT AS a, length(line) AS k FROM l WHERE contains(line, 'tion')),
b AS (SELECT *, least(greatest(0, a - 38), k - 80) AS st FROM m)
SELECT path, line_no, CASE WHEN k <= 80 THEN line ELSE (CASE WHEN st > 0 THEN '…' ELSE '' END) || substring(line, st + 1, 80) || (CASE WHEN st + 80 < k THEN '…' ELSE '' END) END AS excerpt FROM b"""
)
def line_excerpt(spark, d):
    found = S.matching_lines(corpus.documents(spark, d), TION)
    a = F.locate("tion", "line") - 1
    return found.select("path", "line_no", T.excerpt(T.shown(F.col("line")), a, a + 4, 80).alias("excerpt"))


@query(
    f"""WITH {_LINES},
m AS (SELECT path, line_no, lag(line_no) OVER w AS p, lead(line_no) OVER w AS q FROM l WHERE contains(line, 'tion') WINDOW w AS (PARTITION BY path ORDER BY line_no))
SELECT path, line_no, greatest(1, line_no - 2, coalesce((p + line_no) // 2 + 1, 1))::BIGINT AS start_line,
       least(line_no + 2, coalesce((line_no + q) // 2, line_no + 2), k)::BIGINT AS end_line FROM m JOIN (SELECT path, max(line_no) AS k FROM l GROUP BY path) n USING (path)"""
)
def context_windows(spark, d):
    return S.context_windows_of(corpus.documents(spark, d), TION, 2)


@query(f"WITH {_LINES} SELECT path, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM l WHERE contains(line, 'tion') GROUP BY path")
def first_match(spark, d):
    return S.first_match_of(corpus.documents(spark, d), TION)


TERMS = ["tion", "the", "ing"]
_OCC = f"""{_LINES},
t(term_index, term) AS (VALUES (0, 'tion'), (1, 'the'), (2, 'ing')),
g AS (SELECT path, line_no, term_index, term, unnest(string_split(line, term)) AS gap, unnest(range(len(string_split(line, term)))) AS i, len(string_split(line, term)) AS k FROM l, t WHERE contains(line, term)),
o AS (SELECT path, line_no, term_index, term, i, k, (sum(length(gap)) OVER (PARTITION BY path, line_no, term_index ORDER BY i) + i * length(term))::BIGINT AS st FROM g),
occ AS (SELECT path, term_index, term, line_no, st AS "start", st + length(term) AS "end" FROM o WHERE i < k - 1)"""


#: Occurrences counted from the start of the text, and an end that no text reaches.
_IN_TEXT = f"""{_SOURCES},
t(term_index, term) AS (VALUES (0, 'tion'), (1, 'the'), (2, 'ing')),
g AS (SELECT path, term_index, term, unnest(string_split(text, term)) AS gap, unnest(range(len(string_split(text, term)))) AS i, len(string_split(text, term)) AS k FROM s, t WHERE contains(text, term)),
o AS (SELECT path, term_index, term, i, k, (sum(length(gap)) OVER (PARTITION BY path, term_index ORDER BY i) + i * length(term))::BIGINT AS st FROM g),
occ AS (SELECT path, term_index, term, st AS "start", st + length(term) AS "end" FROM o WHERE i < k - 1)"""
_NO_END = 1 << 53


@query(f'WITH {_OCC} SELECT path, term_index::INT AS term_index, term, line_no, "start", "end" FROM occ')
def any_of(spark, d):
    return S.any_of(corpus.documents(spark, d), TERMS)


@query(
    f"""WITH {_SOURCES}, t(term_index, term) AS (VALUES (0, 'tion'), (1, 'the'), (2, 'zzzz'))
SELECT term_index::INT AS term_index, term, sum((length(text) - length(replace(text, term, ''))) // length(term))::BIGINT AS occurrences, count(*) FILTER (contains(text, term)) AS sources FROM s, t GROUP BY ALL"""
)
def term_counts(spark, d):
    return S.term_counts(corpus.documents(spark, d), ["tion", "the", "zzzz"])


@query(f"WITH {_SOURCES} SELECT path FROM s WHERE contains(text, 'tion') AND contains(text, 'ing') AND contains(text, 'ou')")
def all_of_file(spark, d):
    return S.all_of(corpus.documents(spark, d), ["tion", "ing", "ou"])


def _scopes(spark, d) -> DataFrame:
    scope = F.explode(F.array(*[F.struct(F.lit(n).alias("scope"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for n, a, b in (("head", 0, 100), ("tail", 100, _NO_END))]))
    return corpus.documents(spark, d).select("path", scope.alias("x")).select("path", "x.*")


@query(
    f"""WITH {_IN_TEXT}, sc(scope, a, b) AS (VALUES ('head', 0, 100), ('tail', 100, {_NO_END}))
SELECT path, scope FROM occ, sc WHERE "start" >= a AND "end" <= b GROUP BY path, scope HAVING count(DISTINCT term) = 3"""
)
def all_of_within(spark, d):
    return S.all_of_within(S.any_of(corpus.documents(spark, d), TERMS, by_line=False), _scopes(spark, d), 3)


@query(f'WITH {_IN_TEXT} SELECT DISTINCT path, "start", "end" FROM occ WHERE ("start" >= 0 AND "end" <= 100)')
def roles(spark, d):
    r = _scopes(spark, d).withColumn("role", F.when(F.col("scope") == "head", "comment").otherwise("code"))
    return S.with_role(S.any_of(corpus.documents(spark, d), TERMS, by_line=False).select("path", "start", "end"), r, ["comment"]).select("path", "start", "end")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type")
def mtime_window(spark, d):
    e = corpus.table(spark, d, "events")
    kept = S.modified_between(e, "ts", F.to_timestamp(F.lit("2024-01-05 00:00:00")).cast(e.schema["ts"].dataType), F.to_timestamp(F.lit("2024-01-20 12:00:00")).cast(e.schema["ts"].dataType))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINES} SELECT l.path, line_no FROM l WHERE contains(line, 'tion') AND line_no BETWEEN 2 AND 3")
def changed_lines_search(spark, d):
    docs = corpus.documents(spark, d)
    changes = docs.select("path", F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    return S.in_changed_lines(S.matching_lines(docs, TION), changes).select("path", "line_no")


@query(f"WITH {_SOURCES} SELECT path FROM s WHERE regexp_matches(path, '^src1[0-9]*/') AND NOT regexp_matches(path, '/fr/')")
def file_scope(spark, d):
    return corpus.documents(spark, d).where(P.in_scope(F.col("path"), ["src1*/**"], ["**/fr/**"])).select("path")


@query("SELECT url AS path, (length(html) - length(replace(html, '<p>', ''))) // 3 AS occurrences FROM pages WHERE contains(html, '<p>')")
def page_search(spark, d):
    return S.summary(corpus.pages(spark, d), Pattern("<p>", literal=True)).select("path", "occurrences")


@query(
    """WITH c AS (SELECT conv_id, turn, role || ': ' || replace(text, chr(10), ' ') AS line FROM conversations)
SELECT conv_id::VARCHAR || '.chat' AS path, count(*) AS match_lines FROM c WHERE contains(line, 'user') GROUP BY conv_id"""
)
def conversation_search(spark, d):
    return S.summary(corpus.conversations(spark, d), Pattern("user", literal=True)).select("path", "match_lines")


@query(
    f"""WITH RECURSIVE {_LINES}, m AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k FROM l WHERE contains(line, 'tion')),
t(path, k, starts) AS (SELECT DISTINCT path, 0::BIGINT, []::BIGINT[] FROM m UNION ALL
SELECT t.path, m.k, CASE WHEN len(starts) < 2 AND (len(starts) = 0 OR greatest(1, line_no - 3) > starts[-1] + 6) THEN list_append(starts, greatest(1, line_no - 3)::BIGINT) ELSE starts END
FROM t JOIN m ON m.path = t.path AND m.k = t.k + 1),
f AS (SELECT path, unnest(arg_max(starts, k)) AS start_line FROM t GROUP BY path)
SELECT path, start_line, start_line + 6 AS end_line FROM f"""
)
def preview_windows(spark, d):
    return S.preview_windows(S.matching_lines(corpus.documents(spark, d), TION))


@query(
    f"""WITH {_SOURCES}, v AS (SELECT path, sha256(text) AS version FROM s UNION ALL SELECT path, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) FROM s)
SELECT path, count(*) AS n FROM v GROUP BY path HAVING count(DISTINCT version) = 1"""
)
def merged_versions(spark, d):
    docs = corpus.documents(spark, d)
    edited = F.concat("text", F.when(F.col("doc_id") % 7 == 0, F.lit("!")).otherwise(F.lit("")))
    both = docs.select("path", corpus.content_hash(F.col("text")).alias("version")).union(docs.select("path", corpus.content_hash(edited)))
    return S.merged_versions(both).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINES} SELECT path, line_no FROM l JOIN s USING (path) WHERE contains(line, 'tion') AND doc_id % 5 <> 0")
def stable_matches(spark, d):
    docs = corpus.documents(spark, d)
    meta = lambda shift: docs.select("path", F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") + shift).cast("double").alias("mtime_ms"), F.lit(None).cast("double").alias("ctime_ms"))
    changed = F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    return S.stable(S.matching_lines(docs, TION), meta(F.lit(0)), meta(changed)).select("path", "line_no")


@query(
    f"""WITH {_SOURCES}, g AS (SELECT path, unnest(string_split(text, 'è')) AS gap, unnest(range(len(string_split(text, 'è')))) AS i, len(string_split(text, 'è')) AS k FROM s WHERE contains(text, 'è')),
o AS (SELECT path, i, k, (sum(octet_length(encode(gap))) OVER (PARTITION BY path ORDER BY i) + 2 * i)::BIGINT AS st FROM g)
SELECT path, st AS "start", st + 2 AS "end" FROM o WHERE i < k - 1"""
)
def byte_scan(spark, d):
    contents = corpus.documents(spark, d).select("path", F.col("text").cast("binary").alias("content"))
    return S.byte_matches(contents, "è".encode())


# Files and languages


@query(
    f"""WITH {_SOURCES} SELECT path, CASE WHEN contains(path, 'src1') AND contains(path, 'fr') THEN 60 END::INT AS score FROM s WHERE contains(path, 'src1') AND contains(path, 'fr')"""
)
def files_rank(spark, d):
    return FI.discover(corpus.documents(spark, d), "src1 fr")


@query(
    f"""WITH {_SOURCES}, a AS (SELECT path, nullif(strpos(path, 's'), 0) AS p1 FROM s), b AS (SELECT *, p1 + nullif(strpos(substring(path, p1 + 1), '1'), 0) AS p2 FROM a),
c AS (SELECT *, p2 + nullif(strpos(substring(path, p2 + 1), 'e'), 0) AS p3 FROM b), e AS (SELECT *, p3 + nullif(strpos(substring(path, p3 + 1), '7'), 0) AS p4 FROM c)
SELECT path, floor(160.0 / (p4 - p1 + 1) + 0.5)::INT AS score FROM e WHERE p4 IS NOT NULL AND NOT contains(path, 's1e7')"""
)
def files_fuzzy(spark, d):
    return FI.discover(corpus.documents(spark, d), "s1e7")


_EXT = "CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.tsx' WHEN 3 THEN '.mjs' WHEN 4 THEN '.go' WHEN 5 THEN '.md' ELSE '' END"


def _code_paths(spark, d) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".TS", ".tsx", ".mjs", ".go", ".md", "")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return corpus.documents(spark, d).select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), ext).alias("path"))


@query(
    f"""WITH e AS (SELECT lower({_EXT}) AS e FROM documents),
c AS (SELECT CASE e WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.mjs' THEN 'javascript' WHEN '.go' THEN 'go' END AS language, count(*) AS n FROM e GROUP BY 1),
k(language, caps) AS (VALUES ('javascript', ['imports', 'outline', 'roles', 'structure', 'tests']), ('typescript', ['imports', 'outline', 'roles', 'structure', 'tests']), ('tsx', ['imports', 'outline', 'roles', 'structure', 'tests']), ('go', ['roles', 'structure']), ('python', ['outline'])),
x AS (SELECT language, unnest(caps) AS capability FROM k)
SELECT x.language, capability, x.language = 'python' AS available, coalesce(n, 0) AS sources FROM x LEFT JOIN c ON c.language = x.language"""
)
def capabilities(spark, d):
    return FI.capabilities(_code_paths(spark, d))


# Statistics and budgets

_COUNTS = f"{_LINES}, c AS (SELECT path, count(*) AS match_lines, sum({_count('line', 'tion')})::BIGINT AS occurrences FROM l WHERE contains(line, 'tion') GROUP BY path)"


@query(
    """WITH c AS (SELECT url AS path, CASE WHEN contains(html, '<p>') THEN 1 ELSE 0 END AS match_lines, string_split(url, '/')[-1] AS b FROM pages WHERE contains(html, '<p>')),
e AS (SELECT match_lines, lower(regexp_extract(b, '^.+(\\.[^.]*)$', 1)) AS e FROM c),
g AS (SELECT CASE WHEN length(e) < 2 THEN '[no extension]' ELSE e END AS key, count(*) AS sources, sum(match_lines)::BIGINT AS total FROM e GROUP BY 1)
SELECT key, sources, total, greatest((SELECT count(*) FROM g) - 5, 0) AS omitted FROM g ORDER BY total DESC, key LIMIT 5"""
)
def stats_by_type(spark, d):
    return ST.by_type(S.summary(corpus.pages(spark, d).select("path", F.translate("text", "\n", " ").alias("text")), Pattern("<p>", literal=True)))


@query(
    f"""WITH {_COUNTS}, g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS key, count(*) AS sources, sum(match_lines)::BIGINT AS total FROM c GROUP BY 1)
SELECT key, sources, total, greatest((SELECT count(*) FROM g) - 5, 0) AS omitted FROM g ORDER BY total DESC, key LIMIT 5"""
)
def stats_by_dir(spark, d):
    return ST.by_directory(S.summary(corpus.documents(spark, d), TION))


@query(f"WITH {_COUNTS} SELECT path, match_lines FROM c ORDER BY match_lines DESC, path LIMIT 8")
def top_files(spark, d):
    return ST.top_files(S.summary(corpus.documents(spark, d), TION))


@query(f"WITH {_COUNTS} SELECT sum(match_lines)::BIGINT AS match_lines, sum(occurrences)::BIGINT AS occurrences, count(*) AS sources, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS directories FROM c")
def totals(spark, d):
    return ST.totals(S.summary(corpus.documents(spark, d), TION))


@query(
    f"""WITH {_SOURCES}, r AS (SELECT path, octet_length(encode(text))::BIGINT AS size, sum(octet_length(encode(text))) OVER (ORDER BY path) AS upto FROM s)
SELECT path, size FROM r WHERE upto <= 1000000"""
)
def prefix_budget(spark, d):
    sized = corpus.documents(spark, d).select("path", F.octet_length("text").cast("long").alias("size"))
    return B.prefix(sized, "size", 1_000_000, ["path"])


@query(
    f"""WITH {_SOURCES}, r AS (SELECT path, source, octet_length(encode(text))::BIGINT AS size, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY path) AS upto FROM s)
SELECT path, source, size FROM r WHERE upto <= 20000"""
)
def prefix_budget_by_source(spark, d):
    sized = corpus.documents(spark, d).select("path", "source", F.octet_length("text").cast("long").alias("size"))
    return B.prefix(sized, "size", 20_000, ["path"], "source")


@query(f"WITH {_COUNTS} SELECT path, match_lines, ord FROM (SELECT path, match_lines, row_number() OVER (ORDER BY match_lines DESC, path) AS ord FROM c) WHERE ord BETWEEN 31 AND 60")
def page_n(spark, d):
    c = S.summary(corpus.documents(spark, d), TION).select("path", "match_lines", (-F.col("match_lines")).alias("order_"))
    return B.page(c, 1, 30, ["order_", "path"]).drop("order_")


@query(_skip("source", 1 << 40, 20_000, 50) + " SELECT path, g AS source, size FROM t WHERE ok")
def retained(spark, d):
    sized = corpus.documents(spark, d).select("path", "source", F.octet_length("text").cast("long").alias("size"))
    return B.retained(sized, "size", ["path"], "source", 20_000, 50)


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS k FROM events WHERE value IS NOT NULL)
SELECT event_type, count(value) AS "count", max(value) AS top, max(value) FILTER (k = 2) AS "second", quantile_cont(value, 0.5) AS median, min(value) AS "min", max(value) - min(value) AS spread,
       max(value) - max(value) FILTER (k = 2) AS top_margin FROM r GROUP BY event_type"""
)
def score_profile(spark, d):
    return ST.score_profile(corpus.table(spark, d, "events"), "value", "event_type")


# Evidence integrity


@query(f"WITH {_SOURCES} SELECT path, sha256(text) AS content_hash FROM s")
def content_hash(spark, d):
    return corpus.documents(spark, d).select("path", corpus.content_hash(F.col("text")).alias("content_hash"))


@query(
    f"""WITH {_LINES}, t(id, literal) AS (VALUES ('a', 'tion'), ('b', 'Erh'), ('c', 'no such text'))
SELECT id, literal, count(path) AS matches, count(DISTINCT path) AS files, CASE WHEN count(path) > 0 THEN 'present' ELSE 'absent_with_complete_coverage' END AS status
FROM t LEFT JOIN l ON contains(CASE WHEN literal = 'Erh' THEN line ELSE lower(line) END, literal) GROUP BY id, literal"""
)
def audit(spark, d):
    return A.audit(corpus.documents(spark, d), {"a": "tion", "b": "Erh", "c": "no such text"})


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = corpus.documents(spark, d)
    saved = docs.select("path", F.when(F.col("doc_id") % 11 != 0, corpus.content_hash(F.col("text"))).alias("version"))
    edited = F.concat("text", F.when(F.col("doc_id") % 10 == 0, F.lit(" ")).otherwise(F.lit("")))
    return saved, docs.where("doc_id % 15 <> 0").select("path", corpus.content_hash(edited).alias("version"))


@query(
    f"WITH {_SOURCES} SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'unknown' WHEN doc_id % 15 = 0 OR doc_id % 10 = 0 THEN 'stale' ELSE 'current' END AS status FROM s"
)
def validate(spark, d):
    return A.validation_order(A.validate(*_versions(spark, d)))


@query(
    f"""WITH {_SOURCES}, v AS (SELECT lang, CASE WHEN doc_id % 11 = 0 THEN 2 WHEN doc_id % 15 = 0 OR doc_id % 10 = 0 THEN 1 ELSE 3 END AS r FROM s)
SELECT lang, ['stale', 'unknown', 'current'][min(r)] AS status FROM v GROUP BY lang"""
)
def worst_status(spark, d):
    v = A.validate(*_versions(spark, d)).withColumn("lang", F.split("path", "/")[1])
    return ST.worst_status(v, "status", ("stale", "unknown", "current"), "lang")


@query(f"WITH {_SOURCES} SELECT path, CASE WHEN doc_id % 15 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM s WHERE doc_id % 15 = 0 OR doc_id % 10 = 0")
def changed_files(spark, d):
    docs = corpus.documents(spark, d)
    return A.changed_files(docs.select("path", corpus.content_hash(F.col("text")).alias("version")), _versions(spark, d)[1])


@query(f"WITH {_SOURCES} SELECT path FROM s WHERE doc_id % 15 = 0")
def ignored_files(spark, d):
    return A.ignored_files(corpus.documents(spark, d).select("path"), _versions(spark, d)[1])


@query(
    f"""WITH {_SOURCES}, r AS (SELECT sha256(path || chr(0) || sha256(text)) AS h FROM s),
w AS (SELECT count(*) AS n, {', '.join(f"sum(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT)::HUGEINT AS w{i}" for i in range(4))} FROM r)
SELECT substr(sha256(concat_ws(',', n, w0, w1, w2, w3)), 1, 32) AS inventory_hash FROM w"""
)
def inventory_hash(spark, d):
    return A.inventory_hash(corpus.documents(spark, d).select("path", corpus.content_hash(F.col("text")).alias("version")))


# Ranges

#: The last of these overlaps the one before it in some words.
RANGE_TERMS = ["tion", "the", "hen"]
_RANGES = _OCC.replace("'ing'", "'hen'") + """,
a0 AS (SELECT path || ':' || line_no AS k, "start" AS a, "end" AS b FROM occ WHERE term_index < 2), b0 AS (SELECT path || ':' || line_no AS k, "start" AS a, "end" AS b FROM occ WHERE term_index = 2)"""


def _merged(name: str, of: str) -> str:
    return f"""{name} AS (SELECT k, min(a) AS a, max(b) AS b FROM (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM
(SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {of})) GROUP BY k, i)"""


def _range_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Both sides from one scan of the texts."""
    occ = cut(S.any_of(corpus.documents(spark, d), RANGE_TERMS).select(F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("path"), "term_index", "start", "end"))
    return occ.where("term_index < 2").drop("term_index"), occ.where("term_index = 2").drop("term_index")


@query(f'WITH {_RANGES}, {_merged("m", "a0")} SELECT k AS path, a AS "start", b AS "end" FROM m')
def merge_ranges(spark, d):
    return G.merge(_range_inputs(spark, d)[0])


@query(f'WITH {_RANGES} SELECT k AS path, a AS "start", b AS "end" FROM a0 WHERE NOT EXISTS (SELECT 1 FROM b0 WHERE b0.k = a0.k AND b0.a < a0.b AND a0.a < b0.b)')
def overlap_anti(spark, d):
    return G.overlap_anti(*_range_inputs(spark, d))


def _points(wanted: str) -> str:
    return f"""WITH {_RANGES}, pa AS (SELECT DISTINCT k, unnest(range(a, b)) AS x FROM a0), pb AS (SELECT DISTINCT k, unnest(range(a, b)) AS x FROM b0),
w AS (SELECT pa.k, pa.x FROM pa {wanted}), i AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM w)
SELECT k AS path, min(x) AS "start", max(x) + 1 AS "end" FROM i GROUP BY k, g"""


@query(_points("ANTI JOIN pb ON pb.k = pa.k AND pb.x = pa.x"))
def subtract_ranges(spark, d):
    return G.subtract(*_range_inputs(spark, d))


@query(_points("SEMI JOIN pb ON pb.k = pa.k AND pb.x = pa.x"))
def intersect_ranges(spark, d):
    return G.intersect(*_range_inputs(spark, d))


@query(
    f"""WITH RECURSIVE {_RANGES}, e AS (SELECT k, a, b, (a * 37 + b * 11) % 1000 AS rank FROM a0 UNION ALL SELECT k, a, b, (a * 37 + b * 11) % 1000 FROM b0),
q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, a) AS n FROM e),
fold(k, n, kept) AS (SELECT DISTINCT k, 0::BIGINT, []::STRUCT(a BIGINT, b BIGINT, rank BIGINT)[] FROM q UNION ALL
SELECT fold.k, q.n, CASE WHEN len(list_filter(kept, lambda r: r.a < q.b AND q.a < r.b)) = 0 THEN list_append(kept, {{'a': q.a, 'b': q.b, 'rank': q.rank}}) ELSE kept END FROM fold JOIN q ON q.k = fold.k AND q.n = fold.n + 1),
f AS (SELECT k, unnest(arg_max(kept, n)) AS x FROM fold GROUP BY k) SELECT k AS path, x.a AS "start", x.b AS "end", x.rank AS rank FROM f"""
)
def greedy_dedupe(spark, d):
    a, b = _range_inputs(spark, d)
    every = a.union(b).withColumn("rank", (F.col("start") * 37 + F.col("end") * 11) % 1000)
    return G.greedy_dedupe(every)


@query(
    f"""WITH {_IN_TEXT}, sc(name, a, b) AS (VALUES ('file', 0, {_NO_END}), ('head', 0, 100), ('mid', 50, 100)),
j AS (SELECT DISTINCT path, "start" AS x, name, a, b FROM occ, sc WHERE a <= "start" AND "start" < b)
SELECT path, x AS "at", arg_min(name, b - a) AS name FROM j GROUP BY path, x"""
)
def smallest_enclosing(spark, d):
    docs = corpus.documents(spark, d)
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for n, a, b in (("file", 0, _NO_END), ("head", 0, 100), ("mid", 50, 100))]))
    ranges = docs.select("path", named.alias("x")).select("path", "x.*")
    points = S.any_of(docs, TERMS, by_line=False).select("path", F.col("start").alias("at")).distinct()
    return G.smallest_enclosing(points, ranges).select("path", "at", "name")


# Semantic ranking

_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_DOT = "list_sum(list_transform(list_zip(embedding, {q}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def _first_vector(spark, d) -> list[float]:
    return [float(x) for x in corpus.table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query(f"SELECT vec_id, round({_DOT.format(q=_QUERY_VECTOR)}, 9) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20")
def cosine_topk(spark, d):
    scored = M.cosine(corpus.table(spark, d, "embeddings"), _first_vector(spark, d)).select("vec_id", F.round("score", 9).alias("score"))
    return M.top_k(scored, 20, "vec_id")


@query(f"SELECT vec_id // 4 AS passage, max(round({_DOT.format(q=_QUERY_VECTOR)}, 9)) AS score FROM embeddings GROUP BY 1")
def passage_max(spark, d):
    scored = M.cosine(corpus.table(spark, d, "embeddings"), _first_vector(spark, d)).select(F.floor(F.col("vec_id") / 4).alias("passage"), F.round("score", 9).alias("score"))
    return M.passage_scores(scored, "passage")


@query(
    """WITH p AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT label, pos, sum(x) AS x FROM p GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM s GROUP BY 1)
SELECT s.label, pos::INT AS pos, round(x / n, 9) AS x FROM s JOIN n ON n.label = s.label"""
)
def mean_pool(spark, d):
    pooled = M.mean_pool(corpus.table(spark, d, "embeddings"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 9).alias("x"))


@query(f"SELECT vec_id, round({_DOT.format(q=_QUERY_VECTOR)} - 0.02 * (1 - sqrt(least((vec_id % 700) / 500.0, 1.0))), 9) AS ranking_score FROM embeddings")
def rank_correction(spark, d):
    scored = M.cosine(corpus.table(spark, d, "embeddings"), _first_vector(spark, d))
    return scored.select("vec_id", F.round(M.ranking_score(F.col("score"), F.col("vec_id") % 700), 9).alias("ranking_score"))


@query(
    f"""WITH RECURSIVE {_SOURCES}, t(path, text, n, a, b) AS (SELECT path, text, length(text), 0, CASE WHEN length(text) <= 1000 THEN length(text)
WHEN 1001 - strpos(reverse(substring(text, 1, 1001)), chr(10)) > 500 AND contains(substring(text, 1, 1001), chr(10)) THEN 1001 - strpos(reverse(substring(text, 1, 1001)), chr(10)) + 1 ELSE 1000 END FROM s WHERE length(text) > 0 UNION ALL
SELECT path, text, n, a2, CASE WHEN a2 + 1000 >= n THEN n WHEN contains(w, chr(10)) AND length(w) - strpos(reverse(w), chr(10)) > 500 THEN a2 + length(w) - strpos(reverse(w), chr(10)) + 1 ELSE a2 + 1000 END
FROM (SELECT path, text, n, greatest(a + 1, b - 160) AS a2, substring(text, greatest(a + 1, b - 160) + 1, 1001) AS w FROM t WHERE b < n))
SELECT path, a::BIGINT AS "start", b::BIGINT AS "end", (a - length(replace(substring(text, 1, a), chr(10), '')) + 1)::BIGINT AS line FROM t"""
)
def passages(spark, d):
    return M.passages(corpus.documents(spark, d), texts=False)


@query()
def concept(spark, d):
    return M.concept(corpus.documents(spark, d), "the thing", M.HashingEncoder(), 50).drop("text")


@query()
def hybrid(spark, d):
    docs = corpus.documents(spark, d)
    exact = S.matching_lines(docs, Pattern("thing", literal=True), ranges=True, places=True)
    # Overlaps go before the best are taken, so no passage may be left out here.
    return M.hybrid(S.in_text(exact), M.concept(docs, "thing", M.HashingEncoder(), None), 3)


@query(
    """WITH r AS (SELECT event_id AS pos, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'relevant' ELSE 'other' END AS class, value AS probability FROM events),
j AS (SELECT * FROM r WHERE class IS NOT NULL), p AS (SELECT pos AS new_pos, row_number() OVER (ORDER BY pos) AS k FROM j),
o AS (SELECT *, row_number() OVER (ORDER BY CASE class WHEN 'relevant' THEN 1 ELSE 2 END, probability DESC, pos) AS k FROM j)
SELECT pos, class, probability, new_pos FROM o JOIN p USING (k) UNION ALL SELECT pos, class, probability, pos FROM r WHERE class IS NULL"""
)
def judged_order(spark, d):
    return _judged(corpus.table(spark, d, "events"))


def _judged(e: DataFrame) -> DataFrame:
    cls = F.when(F.col("event_id") % 3 == 1, F.lit("relevant")).when(F.col("event_id") % 3 == 2, F.lit("other"))
    return M.judged_order(e.select(F.col("event_id").alias("pos"), cls.alias("class"), F.col("value").alias("probability")), ("relevant", "other"))


# Versions


def _moved(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents as deleted files, and all of them, some changed a little, as added ones."""
    docs = corpus.documents(spark, d)
    edited = F.when(F.col("doc_id") % 40 == 0, F.concat("text", F.lit("\nadded line"))).otherwise(F.col("text"))
    return docs.select("path", "text"), docs.select(F.concat(F.lit("moved/"), "path").alias("path"), edited.alias("text"))


# SQL would compare too many lines here; both are held against brute force in the tests.


@query()
def similarity(spark, d):
    return C.similarity(*_moved(spark, d))


@query()
def rename_pairs(spark, d):
    return C.rename_pairs(C.similarity(*_moved(spark, d)))


@query(
    """WITH h AS (SELECT doc_id, sha256(text) AS v, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path FROM documents)
SELECT path, min(path) OVER w AS class_path, count(*) OVER w AS members FROM h WINDOW w AS (PARTITION BY v)"""
)
def content_classes(spark, d):
    return C.content_classes(corpus.documents(spark, d)).drop("version")


@query(
    f"""WITH {_SOURCES}, b AS (SELECT path, text FROM s WHERE doc_id % 15 <> 0), a AS (SELECT path, text || CASE WHEN doc_id % 10 = 0 THEN '!' ELSE '' END AS text FROM s WHERE doc_id % 4 <> 0)
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM b FULL JOIN a ON a.path = b.path WHERE a.text IS DISTINCT FROM b.text"""
)
def change_set(spark, d):
    docs = corpus.documents(spark, d)
    after = docs.where("doc_id % 4 <> 0").select("path", F.concat("text", F.when(F.col("doc_id") % 10 == 0, F.lit("!")).otherwise(F.lit(""))).alias("text"))
    return C.change_set(docs.where("doc_id % 15 <> 0"), after).select("path", "change")


@query(
    f"""WITH {_LINES}, k AS (SELECT path, max(line_no) AS k FROM l GROUP BY path)
SELECT path, 'new' AS side, (k + 1)::BIGINT AS start_line, (k + 1)::BIGINT AS end_line FROM k WHERE k > 1
UNION ALL SELECT path, side, 1, CASE WHEN k = 1 AND side = 'new' THEN 2 ELSE 1 END FROM k, (VALUES ('new'), ('old')) v(side)"""
)
def line_diff(spark, d):
    docs = corpus.documents(spark, d).select("path", F.concat("text", F.lit("\n")).alias("text"))
    return C.changed_lines(docs, docs.select("path", F.concat(F.lit("# "), "text", F.lit("a new line\n")).alias("text")))


# Redaction and structure

# Names and values on both sides of a sign, taken apart in lists; then runs of characters with an issuer's mark that no
# masked value holds.
_ASSIGNED = r"""([A-Za-z0-9_-]+)["\']{0,1}\s*[:=]\s*("[^"\r\n]*"|[^\s,;}"]+)""".replace("'", "''")


@query(
    rf"""WITH {_SOURCES}, n AS (SELECT path, text, regexp_extract_all(text, '{_ASSIGNED}', 1) AS names, regexp_extract_all(text, '{_ASSIGNED}', 2) AS vals FROM s),
p AS (SELECT *, list_transform(names, lambda x: '_' || replace(lower(x), '-', '_') || '_') AS keys FROM n),
h AS (SELECT *, list_transform(keys, lambda x: len(list_filter(['password', 'passwd', 'secret', 'token', 'apikey', 'api_key', 'accesskey', 'access_key', 'accesstoken', 'access_token', 'privatekey', 'private_key', 'servicekey', 'service_key'], lambda w: contains(x, '_' || w || '_'))) > 0) AS hit FROM p),
m AS (SELECT path, text, len(list_filter(hit, lambda b: b)) AS assigned, list_transform(list_filter(list_zip(vals, hit), lambda z: z[2]), lambda z: z[1]) AS masked FROM h),
marks(mark) AS (VALUES ('sk-'), ('sk_'), ('ghp-'), ('ghp_'), ('xoxb-'), ('xoxa-'), ('xoxp-'), ('xoxr-'), ('xoxs-')),
r AS (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS run FROM s WHERE contains(text, 'sk') OR contains(text, 'ghp') OR contains(text, 'xox')),
t AS (SELECT r.path, count(*) AS marked FROM r JOIN marks ON starts_with(run, mark) WHERE length(run) >= length(mark) + 8 GROUP BY r.path)
SELECT m.path, (assigned + coalesce(marked, 0))::BIGINT AS redactions FROM m LEFT JOIN t ON t.path = m.path"""
)
def redact_counts(spark, d):
    return corpus.documents(spark, d).select("path", R.redaction_count(F.col("text")).alias("redactions"))


#: Three forms of source, by number: nested with brackets and strings, flat, and deep with a comment.
_PYTHON = (
    "class C{i}:\n    \"\"\"def no(x):\"\"\"\n    def run(self,\n            a):\n        return go(a, {i})\n\nasync def go{i}(x): return x\n",
    'import os\n\ndef a{i}(x):\n    s = ["def b():",\n  1]\n    return os.go(x, {i})\n\n@dec(":")\ndef b{i}(): pass',
    'def out{i}():\n    def mid():\n        class In:\n            def leaf(self): return go(self, {i})  # go(1, 2)\n        return In\n\n    x = go("a", "a")\n    return mid\n',
)


def _python_sources(spark, d) -> DataFrame:
    forms = [F.replace(F.lit(text), F.lit("{i}"), F.col("doc_id").cast("string")) for text in _PYTHON]
    text = F.element_at(F.array(*forms), (F.col("doc_id") % 3 + 1).cast("int"))
    return corpus.documents(spark, d).select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


@query(
    """WITH f(form, name, kind, a, b, scope) AS (VALUES
(0, 'C{i}', 'class', 1, 6, ''), (0, 'run', 'method', 3, 6, 'C{i}'), (0, 'go{i}', 'function', 7, 8, ''), (1, 'a{i}', 'function', 3, 7, ''), (1, 'b{i}', 'function', 9, 9, ''),
(2, 'out{i}', 'function', 1, 9, ''), (2, 'mid', 'function', 2, 6, 'out{i}'), (2, 'In', 'class', 3, 4, 'out{i}.mid'), (2, 'leaf', 'method', 4, 4, 'out{i}.mid.In'))
SELECT 'src/' || doc_id || '.py' AS path, replace(name, '{i}', doc_id::VARCHAR) AS name, kind, a::BIGINT AS start_line, b::BIGINT AS end_line, replace(scope, '{i}', doc_id::VARCHAR) AS scope, true AS has_body
FROM documents JOIN f ON form = doc_id % 3"""
)
def python_outline(spark, d):
    return X.outline(_python_sources(spark, d)).select("path", "name", "kind", "start_line", "end_line", F.array_join("scope", ".").alias("scope"), "has_body")


def _python_sql() -> str:
    """The same sources for SQL."""
    quoted = [t.replace("\n", "' || chr(10) || '") for t in _PYTHON]
    return f"p AS (SELECT 'src/' || doc_id || '.py' AS path, doc_id % 3 AS form, doc_id::VARCHAR AS i, replace(CASE doc_id % 3 WHEN 0 THEN '{quoted[0]}' WHEN 1 THEN '{quoted[1]}' ELSE '{quoted[2]}' END, '{{i}}', doc_id::VARCHAR) AS text FROM documents)"


def _piece(begin: str, form: int) -> str:
    """Where the piece of one form of source lies that goes from a string to the next closing bracket."""
    at = f"strpos(text, '{begin}')"
    return f"""SELECT path, ({at} - 1)::BIGINT AS "start", ({at} - 1 + strpos(substring(text, {at}), ')'))::BIGINT AS "end" FROM p WHERE form = {form}"""


@query(f"""WITH {_python_sql()} {_piece("go(a, ", 0)} UNION ALL {_piece("go(self, ", 2)} UNION ALL {_piece('go("a", ', 2)}""")
def structure(spark, d):
    return SX.facts(_python_sources(spark, d), SX.PythonSyntax(), "structure", "go($A, $B)").select("path", "start", "end")


@query(f"""WITH {_python_sql()} {_piece('go("a", ', 2)}""")
def structure_same(spark, d):
    return SX.facts(_python_sources(spark, d), SX.PythonSyntax(), "structure", "go($A, $A)").select("path", "start", "end")


@query(
    """WITH r(form, role, said) AS (VALUES (0, 'declaration', 'C{i}'), (0, 'declaration', 'run'), (0, 'declaration', 'go{i}'), (0, 'string', '\"\"\"def no(x):\"\"\"'), (0, 'call', 'go'),
(1, 'import', 'import os'), (1, 'declaration', 'a{i}'), (1, 'declaration', 'b{i}'), (1, 'string', '"def b():"'), (1, 'call', 'os.go'), (1, 'call', 'dec'), (1, 'string', '":"'),
(2, 'declaration', 'out{i}'), (2, 'declaration', 'mid'), (2, 'declaration', 'In'), (2, 'declaration', 'leaf'), (2, 'call', 'go'), (2, 'comment', '# go(1, 2)'), (2, 'call', 'go'), (2, 'string', '"a"'), (2, 'string', '"a"'))
SELECT 'src/' || doc_id || '.py' AS path, role, count(*) AS n, sum(length(replace(said, '{i}', doc_id::VARCHAR)))::BIGINT AS characters FROM documents JOIN r ON form = doc_id % 3 GROUP BY doc_id, role"""
)
def python_roles(spark, d):
    found = SX.facts(_python_sources(spark, d), SX.PythonSyntax(), "roles").where("name <> 'code'")
    return found.groupBy("path", F.col("name").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("characters"))


@query(
    """SELECT 'src/' || doc_id || '.py' AS path, unnest(['out' || doc_id, 'mid', 'leaf']) AS scope FROM documents WHERE doc_id % 3 = 2 UNION ALL SELECT 'src/' || doc_id || '.py', 'run' FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'src/' || doc_id || '.py', 'a' || doc_id FROM documents WHERE doc_id % 3 = 1"""
)
def all_of_in_functions(spark, d):
    found = SX.all_of_in_functions(_python_sources(spark, d), SX.PythonSyntax(), ["go(", "return"])
    return found.where("status = 'ok'").select("path", F.col("name").alias("scope"))


def _facts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A tree of modules: module k imports ``f`` from module k // 2, which declares it (even k) or re-exports it."""
    k = corpus.documents(spark, d).select(F.col("doc_id").alias("k"))
    path = lambda n: F.concat(F.lit("m/"), n.cast("string"), F.lit(".ts"))
    spec = lambda n: F.concat(F.lit("./"), n.cast("string"))
    half = F.floor(F.col("k") / 2)
    files = k.select(path(F.col("k")).alias("path"))
    imports = k.where("k > 0").select(path(F.col("k")).alias("path"), F.lit("f").alias("local"), F.lit("f").alias("imported"), spec(half).alias("specifier"), F.lit("named").alias("kind"))
    re_export = k.where("k % 2 = 1").select(path(F.col("k")).alias("path"), F.lit("f").alias("exported"), F.lit("f").alias("local"), spec(half).alias("specifier"), F.lit("named").alias("kind"))
    own = k.where("k % 2 = 0").select(path(F.col("k")).alias("path"), F.lit("f").alias("exported"), F.lit(None).cast("string").alias("local"), F.lit(None).cast("string").alias("specifier"), F.lit("named").alias("kind"))
    return imports, re_export.union(own), k.where("k % 2 = 0").select(path(F.col("k")).alias("path"), F.lit("f").alias("name")), files


_TRACE = """WITH RECURSIVE t(k, x, hops) AS (SELECT doc_id, doc_id // 2, 1 FROM documents WHERE doc_id > 0 UNION ALL SELECT k, x // 2, hops + 1 FROM t WHERE x % 2 = 1 AND hops < 8)"""


@query(
    _TRACE
    + """ SELECT 'm/' || k || '.ts' AS path, 'f' AS local, CASE WHEN x % 2 = 0 THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN x % 2 = 1 THEN 'hop-budget' END AS reason,
CASE WHEN x % 2 = 0 THEN 'm/' || x || '.ts' END AS target, 'f' AS name, hops::INT AS hops FROM t WHERE x % 2 = 0 OR hops = 8"""
)
def imports(spark, d):
    return X.trace_imports(*_facts(spark, d))


@query(
    _TRACE
    + """, r AS (SELECT k, x, hops FROM t WHERE x % 2 = 0 AND x % 6 = 0)
SELECT 'm/' || k || '.ts' AS test, 'm/' || x || '.ts' AS target, CASE WHEN hops = 1 THEN 'direct' ELSE 'indirect' END AS association, false AS test_like FROM r"""
)
def tests(spark, d):
    changed = corpus.documents(spark, d).where("doc_id % 6 = 0").select(F.concat(F.lit("m/"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"))
    return X.related_tests(X.trace_imports(*_facts(spark, d)), changed)


# Trees, module graphs and scopes of sources that differ in form by their number

#: Statements that sources are put together of, one for each pair of bits of their number; two letters are a language.
_STATEMENTS = ("{} = f(b)\n", "for i in g(c):\n    h(i)\n", "while t:\n    for j in u:\n        v(j)\n    w()\n", "def k(z):\n    return m(z)\n")


def _built_sources(spark, d) -> DataFrame:
    two = F.coalesce("lang", F.lit("xx"))
    forms = F.array(*[F.replace(F.lit(t), F.lit("{}"), two) for t in _STATEMENTS])
    form = lambda i: (F.floor(F.col("doc_id") / F.pow(F.lit(4), i)) % 4 + 1).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("doc_id") % 6), lambda i: F.element_at(forms, form(i))), "")
    return corpus.documents(spark, d).select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


#: The nodes of each statement: number, last descendant and parent within it, and where it lies.
_TREES = """f(form, length, n) AS (VALUES (0, 10, 5), (1, 24, 9), (2, 46, 12), (3, 26, 6)),
t(form, node, last, parent, kind, name, a, b) AS (VALUES
(0, 0, 4, -1, 'Assign', NULL, 0, 9), (0, 1, 1, 0, 'Name', '{}', 0, 2), (0, 2, 4, 0, 'Call', 'f', 5, 9), (0, 3, 3, 2, 'Name', 'f', 5, 6), (0, 4, 4, 2, 'Name', 'b', 7, 8),
(1, 0, 8, -1, 'For', NULL, 0, 23), (1, 1, 1, 0, 'Name', 'i', 4, 5), (1, 2, 4, 0, 'Call', 'g', 9, 13), (1, 3, 3, 2, 'Name', 'g', 9, 10), (1, 4, 4, 2, 'Name', 'c', 11, 12),
(1, 5, 8, 0, 'Expr', NULL, 19, 23), (1, 6, 8, 5, 'Call', 'h', 19, 23), (1, 7, 7, 6, 'Name', 'h', 19, 20), (1, 8, 8, 6, 'Name', 'i', 21, 22),
(2, 0, 11, -1, 'While', NULL, 0, 45), (2, 1, 1, 0, 'Name', 't', 6, 7), (2, 2, 8, 0, 'For', NULL, 13, 37), (2, 3, 3, 2, 'Name', 'j', 17, 18), (2, 4, 4, 2, 'Name', 'u', 22, 23),
(2, 5, 8, 2, 'Expr', NULL, 33, 37), (2, 6, 8, 5, 'Call', 'v', 33, 37), (2, 7, 7, 6, 'Name', 'v', 33, 34), (2, 8, 8, 6, 'Name', 'j', 35, 36),
(2, 9, 11, 0, 'Expr', NULL, 42, 45), (2, 10, 11, 9, 'Call', 'w', 42, 45), (2, 11, 11, 10, 'Name', 'w', 42, 43),
(3, 0, 5, -1, 'FunctionDef', 'k', 0, 25), (3, 1, 1, 0, 'arg', 'z', 6, 7), (3, 2, 5, 0, 'Return', NULL, 14, 25), (3, 3, 5, 2, 'Call', 'm', 21, 25), (3, 4, 4, 3, 'Name', 'm', 21, 22), (3, 5, 5, 3, 'Name', 'z', 23, 24)),
d AS (SELECT 'src/' || doc_id || '.py' AS path, doc_id, coalesce(lang, 'xx') AS two, unnest(range(1 + doc_id % 6)) AS i FROM documents),
e AS (SELECT path, two, i, ((doc_id >> (2 * i)::INT) & 3)::INT AS form FROM d),
p AS (SELECT e.*, f.length, f.n, coalesce(sum(length) OVER w, 0)::BIGINT AS base, (1 + coalesce(sum(n) OVER w, 0))::BIGINT AS first
  FROM e JOIN f ON f.form = e.form WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT path, first + node AS node, first + last AS last, CASE WHEN parent < 0 THEN 0 ELSE first + parent END AS parent, kind, replace(name, '{}', two) AS name, base + a AS "start", base + b AS "end", t.form, t.node AS own
  FROM p JOIN t ON t.form = p.form)"""


@query(
    f"""WITH {_TREES} SELECT path, node, last, parent, kind, name, "start", "end" FROM x
UNION ALL SELECT path, 0, sum(n)::BIGINT, NULL, 'Module', NULL, 0, sum(length)::BIGINT FROM p GROUP BY path"""
)
def syntax_nodes(spark, d):
    return N.node_table(_built_sources(spark, d), SX.PythonSyntax()).select("path", "node", "last", "parent", "kind", "name", "start", "end")


@query(f"""WITH {_TREES} SELECT path, node, name, "start", "end" FROM x WHERE kind = 'Call' AND form IN (1, 2)""")
def calls_in_loops(spark, d):
    return N.calls_in_loops(N.node_table(_built_sources(spark, d), SX.PythonSyntax()))


@query(f"""WITH {_TREES} SELECT path, node, name, 'k' AS function FROM x WHERE kind = 'Call' AND form = 3""")
def calls_in_functions(spark, d):
    return N.enclosing_functions(cut(N.node_table(_built_sources(spark, d), SX.PythonSyntax())))


def _package_sources(spark, d) -> DataFrame:
    """Packages of five sources each: one re-exports what the next declares, others import it by relative and absolute names."""
    k, form = F.col("doc_id"), F.col("doc_id") % 5
    number = lambda n: (k + n).cast("string")
    folder = F.concat(F.lit("pkg/s"), (k - form).cast("string"), F.lit("/"))
    path = F.when(form == 0, F.concat(folder, F.lit("__init__.py"))).otherwise(F.concat(folder, F.lit("m"), number(0), F.lit(".py")))
    text = (
        F.when(form == 0, F.concat(F.lit("from .m"), number(1), F.lit(" import f as g\n"))).when(form == 1, F.lit("def f(x):\n    return x\n")).when(form == 2, F.lit("from . import g\n"))
        .when(form == 3, F.concat(F.lit("import s"), number(-3), F.lit(".m"), number(-2), F.lit(" as q\n")))
        .otherwise(F.concat(F.lit("from ..s"), number(1), F.lit(".m"), number(2), F.lit(" import f\nimport os\n")))
    )
    return corpus.documents(spark, d).select(path.alias("path"), text.alias("text"))


@query(
    """WITH k AS (SELECT doc_id AS k, doc_id % 5 AS form, 'pkg/s' || (doc_id - doc_id % 5) || '/' AS folder FROM documents),
i AS (
  SELECT folder || '__init__.py' AS path, 'g' AS local, folder || 'm' || (k + 1) || '.py' AS target, k + 1 AS needs, 'f' AS name, 1 AS hops, 'resolved' AS status FROM k WHERE form = 0
  UNION ALL SELECT folder || 'm' || k || '.py', 'g', folder || 'm' || (k - 1) || '.py', k - 1, 'f', 2, 'resolved' FROM k WHERE form = 2
  UNION ALL SELECT folder || 'm' || k || '.py', 'q', folder || 'm' || (k - 2) || '.py', k - 2, '*', 1, 'module' FROM k WHERE form = 3
  UNION ALL SELECT folder || 'm' || k || '.py', 'f', 'pkg/s' || (k + 1) || '/m' || (k + 2) || '.py', k + 2, 'f', 1, 'resolved' FROM k WHERE form = 4
  UNION ALL SELECT folder || 'm' || k || '.py', 'os', NULL, -1, '*', 1, 'resolved' FROM k WHERE form = 4)
SELECT path, local, CASE WHEN h.k IS NULL THEN 'unresolved' ELSE status END AS status,
       CASE WHEN h.k IS NULL THEN CASE WHEN needs < 0 THEN 'package-or-alias' ELSE 'missing' END END AS reason,
       CASE WHEN h.k IS NOT NULL THEN target END AS target, name, hops
FROM i LEFT JOIN k h ON h.k = i.needs"""
)
def python_imports(spark, d):
    sources = _package_sources(spark, d)
    return MO.python_traces(cut(MO.python_facts(sources)), sources.select("path"))


#: Test cases in which a name is used, hidden by a parameter, by a comprehension, by a class, and by an assignment.
_CASES = (
    "def test_{}():\n    go(1)\n", "def test_{}(go):\n    go(1)\n", "def test_{}():\n    return [go for go in x] + [go(1)]\n",
    "class Test{}:\n    go = 1\n    def test_m(self):\n        return go\n", "def test_{}():\n    go = 2\n    return go\n",
)


@query(
    """WITH c(form, lines, line, name) AS (VALUES (0, 2, 2, 'test_{}'), (1, 2, NULL, NULL), (2, 2, 2, 'test_{}'), (3, 4, 4, 'Test{}.test_m'), (4, 3, NULL, NULL)),
k AS (SELECT 'tests/test_' || doc_id || '.py' AS path, (doc_id % 5)::INT AS a, ((doc_id // 5) % 5)::INT AS b FROM documents)
SELECT path, replace(name, '{}', 'a') AS "case", 'go' AS local, (1 + line)::BIGINT AS line FROM k JOIN c ON form = a WHERE line IS NOT NULL
UNION ALL SELECT path, replace(y.name, '{}', 'b'), 'go', (1 + x.lines + y.line)::BIGINT FROM k JOIN c x ON x.form = a JOIN c y ON y.form = b WHERE y.line IS NOT NULL"""
)
def use_sites(spark, d):
    body = lambda form, name: F.element_at(F.array(*[F.lit(t.replace("{}", name)) for t in _CASES]), (form + 1).cast("int"))
    text = F.concat(F.lit("from lib import go\n"), body(F.col("doc_id") % 5, "a"), body(F.floor(F.col("doc_id") / 5) % 5, "b"))
    sources = corpus.documents(spark, d).select(F.concat(F.lit("tests/test_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))
    return MO.python_facts(sources).where("fact = 'use'").select("path", "case", "local", "line")


@query(f"WITH {_SOURCES} SELECT lang, count(*) AS \"count\" FROM s GROUP BY lang")
def class_counts(spark, d):
    return ST.class_counts(corpus.documents(spark, d), "lang")


# Access and order


def _sized(spark, d) -> DataFrame:
    return corpus.documents(spark, d).select("path", F.octet_length("text").cast("long").alias("size"))


@query(
    f"""WITH {_SOURCES}, z AS (SELECT path, octet_length(encode(text))::BIGINT AS size FROM s),
r AS (SELECT *, sum(CASE WHEN size > 20000 THEN 500001 ELSE size END) OVER (ORDER BY path) AS upto, row_number() OVER (ORDER BY path) AS k FROM z)
SELECT path, size, CASE WHEN upto <= 500000 AND k <= 150 THEN 'admitted' ELSE 'unavailable' END AS status FROM r"""
)
def source_budget_sticky(spark, d):
    return AC.admit(_sized(spark, d), "sticky", 500_000, 150, 20_000)


@query(
    f"""WITH {_SOURCES}, z AS (SELECT path, octet_length(encode(text))::BIGINT AS size FROM s),
r AS (SELECT *, sum(size) OVER (ORDER BY path) AS upto, row_number() OVER (ORDER BY path) AS k FROM z WHERE size <= 20000)
SELECT path, size, 'admitted' AS status FROM r WHERE upto <= 500000 AND k <= 150"""
)
def source_budget_stop(spark, d):
    return AC.admit(_sized(spark, d), "stop", 500_000, 150, 20_000)


@query(_skip("0", 20_000, 500_000, 150) + ", y AS (SELECT path FROM t WHERE ok) SELECT z.path, z.size, CASE WHEN y.path IS NULL THEN 'unavailable' ELSE 'admitted' END AS status FROM z LEFT JOIN y ON y.path = z.path")
def source_budget_skip(spark, d):
    return AC.admit(_sized(spark, d), "skip", 500_000, 150, 20_000)


@query(
    f"""WITH {_SOURCES}, i AS (SELECT source, path, doc_id, (doc_id % 3)::BIGINT AS tier FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY tier, source ORDER BY doc_id) AS turn FROM i)
SELECT tier, path, row_number() OVER (PARTITION BY tier ORDER BY turn, source)::INT AS ord FROM t"""
)
def round_robin(spark, d):
    items = corpus.documents(spark, d).select("path", "source", "doc_id", (F.col("doc_id") % 3).alias("tier"))
    return AC.round_robin(items, "tier", "source", "doc_id").select("tier", "path", "ord")


@query(
    f"""WITH {_SOURCES} SELECT path, unnest(['outer', 'outer', 'outer', 'in', 'in', 'deep', 'next']) AS name, unnest([0, 40, 90, 10, 30, 20, 60])::BIGINT AS "start", unnest([10, 60, 100, 20, 40, 30, 90])::BIGINT AS "end" FROM s"""
)
def own_ranges(spark, d):
    nested = [("outer", 0, 100), ("in", 10, 40), ("deep", 20, 30), ("next", 60, 90)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for n, a, b in nested]))
    return AC.own_ranges(corpus.documents(spark, d).select("path", each.alias("x")).select("path", "x.*"))


@query(f"WITH {_SOURCES} SELECT path FROM s WHERE lang <> 'fr'")
def visible_history(spark, d):
    docs = corpus.documents(spark, d)
    return AC.visible_history(docs.select("path"), docs.where("lang = 'fr'"))


@query(
    f"""WITH {_SOURCES} SELECT path FROM s WHERE NOT (
  source LIKE '%1' OR (lang = 'fr' AND source NOT LIKE '%2') OR (lang = 'de' AND doc_id % 10 = 5 AND doc_id % 100 <> 15) OR source IS NULL)"""
)
def history_by_rules(spark, d):
    docs = corpus.documents(spark, d).where("source IS NOT NULL")
    # One file at the top, and one in each folder of a source.
    top = docs.agg(F.count(F.lit(1))).select(F.lit(".gitignore").alias("path"), F.lit("*1/\n# French, but for some sources\nfr/\n!/*2/fr/\n").alias("text"))
    nested = docs.select(F.concat("source", F.lit("/.ignore")).alias("path"), F.lit("de/*5.txt\n!de/15.txt\n!*[0-9]15.txt\n").alias("text")).distinct()
    return IG.visible(docs.select("path"), top.union(nested))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
