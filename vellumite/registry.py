"""All queries of the library's own operators, by name, and their SQL.

``documents`` is read as a corpus whose lines are paragraphs. Each query runs over its
whole table; the SQL is written from the operators' definitions, not from their plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite import registry_docx
from vellumite.functions import match
from vellumite.functions import text as T
from vellumite.operators import read
from vellumite.plans import batch, package
from vellumite.sources import corpus, docx, packages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Paragraphs in SQL: doc_id, pos, id, style, text, and lvl, the level of headings.
P = """WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
p0 AS (SELECT doc_id, CAST(i AS INTEGER) AS pos, s[i] AS text FROM lines, UNNEST(range(1, len(s) + 1)) u(i)),
p AS (SELECT *, printf('p_%06d', pos) AS id, CASE WHEN pos = 1 THEN 'Heading1' WHEN length(text) < 60 THEN 'Heading2' ELSE 'Normal' END AS style FROM p0),
h AS (SELECT doc_id, pos, id, text, CASE style WHEN 'Heading1' THEN 1 ELSE 2 END AS lvl FROM p WHERE style <> 'Normal'),
sec AS (SELECT a.doc_id, a.id, a.text, a.lvl, a.pos, COALESCE((SELECT min(b.pos) FROM h b WHERE b.doc_id = a.doc_id AND b.pos > a.pos AND b.lvl <= a.lvl), n.n + 1) AS fin
  FROM h a JOIN (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id) n ON n.doc_id = a.doc_id)
"""


def query(sql: str | None = None):
    """Registers a function of the paragraphs; ``sql`` follows the common tables of P."""

    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(paragraphs(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql if sql.lstrip().upper().startswith("WITH") else P + sql
        return f

    return add


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every range of a word, with its place and a preview of its paragraph."""
    hits = read.grep(paragraphs(spark, sf_dir), "the", max_chars=60)
    return hits.select("doc_id", "id", "global_ordinal", F.explode("ranges").alias("r"), "preview").select("doc_id", "id", "global_ordinal", F.col("r.start").alias("start"), F.col("r.end").alias("end"), "preview")


def _ranges(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", "id", F.explode("ranges").alias("r")).select("doc_id", "id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


#: Ranges of a literal in SQL: what stands before the k-th piece's end.
def _literal_ranges(word: str, rows: str = "p") -> str:
    n = len(word)
    return f"""g AS (SELECT doc_id, id, pos, string_split(text, '{word}') AS g FROM {rows} WHERE contains(text, '{word}')),
r AS (SELECT doc_id, id, pos, k, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * {n} AS BIGINT) AS start FROM g, UNNEST(range(1, len(g))) u(k))
"""


@query("SELECT doc_id, count(*) AS paragraphs FROM p GROUP BY doc_id")
def paragraph_count(p: DataFrame) -> DataFrame:
    return read.paragraph_count(p)


@query("SELECT doc_id, id, pos AS global_ordinal, style AS style_id, substr(text, 1, 80) AS text FROM p WHERE pos BETWEEN 2 AND 6")
def list_paragraphs_page(p: DataFrame) -> DataFrame:
    return read.list_paragraphs(p, 2, 5)


@query("SELECT doc_id, count(*) FILTER (pos BETWEEN 3 AND 6) AS returned, count(*) AS total FROM p GROUP BY doc_id")
def list_paragraphs_totals(p: DataFrame) -> DataFrame:
    return read.pagination(p, 3, 4)


@query("SELECT doc_id, id, text AS content FROM p WHERE id = 'p_000003'")
def get_paragraph(p: DataFrame) -> DataFrame:
    return read.get_paragraph(p, "p_000003")


@query("SELECT doc_id, 'p_000008' AS target_id, 'paragraph_not_found' AS error FROM p GROUP BY doc_id HAVING count(*) < 8")
def paragraph_not_found(p: DataFrame) -> DataFrame:
    return read.paragraph_not_found(p, "p_000008")


@query("SELECT doc_id, id, pos AS global_ordinal, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS match_count FROM p WHERE regexp_matches(text, '[\\p{L}\\p{N}_]')")
def grep_words(p: DataFrame) -> DataFrame:
    """Python's words, in letters of any script."""
    return read.grep(p, r"\w+", regex=True).select("doc_id", "id", "global_ordinal", F.col("match_count").cast("long").alias("match_count"))


#: Lines with what white space and words are to Python: marks, numerals, separators of units and lines.
_ODD = "a" + chr(0x301) + "b" + chr(0x1C) + "c" + chr(0xA0) + "d" + chr(0x2028) + "½" + chr(0x200D) + "Ⅷ" + chr(0x85) + "٣ ⓐ_"


@query("SELECT doc_id, id, 0 AS nth, 1 AS start, 2 AS \"end\" FROM p WHERE FALSE" + "".join(f" UNION ALL SELECT doc_id, id, {n}, {a}, {b} FROM p WHERE pos = 1" for n, (a, b) in enumerate([(3, 4), (5, 6), (7, 8), (11, 12), (13, 14)])))
def grep_spaces(p: DataFrame) -> DataFrame:
    odd = p.where("record_pos = 1").withColumn("text", F.lit(_ODD))
    hits = read.grep(odd, r"\s+", regex=True).select("doc_id", "id", F.posexplode("ranges").alias("nth", "r"))
    return hits.select("doc_id", "id", "nth", "r.start", "r.end")


@query("SELECT doc_id, id, 0 AS nth, 1 AS start, 2 AS \"end\" FROM p WHERE FALSE" + "".join(f" UNION ALL SELECT doc_id, id, {n}, {a}, {b} FROM p WHERE pos = 1" for n, (a, b) in enumerate([(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11), (12, 13), (15, 16)])))
def grep_odd_words(p: DataFrame) -> DataFrame:
    odd = p.where("record_pos = 1").withColumn("text", F.lit(_ODD))
    hits = read.grep(odd, r"\w+", regex=True).select("doc_id", "id", F.posexplode("ranges").alias("nth", "r"))
    return hits.select("doc_id", "id", "nth", "r.start", "r.end")


@query("WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents) SELECT * FROM d")
def visible_text(p: DataFrame) -> DataFrame:
    return read.visible_text(p).select("doc_id", F.sha2("text", 256).alias("digest"))


@query(", " + _literal_ranges("the") + 'SELECT doc_id, id, start, start + 3 AS "end" FROM r')
def grep_literal(p: DataFrame) -> DataFrame:
    return _ranges(read.grep(p, "the"))


@query("""SELECT doc_id, id, CAST(unnest(range(1, len(m) + 1)) AS INTEGER) AS nth, unnest(m) AS matched FROM (SELECT doc_id, id, regexp_extract_all(text, 'e[a-z]+t') AS m FROM p) WHERE len(m) > 0""")
def grep_regex(p: DataFrame) -> DataFrame:
    hits = read.grep(p, "e[a-z]+t", regex=True).select("doc_id", "id", "preview", F.posexplode("ranges").alias("n", "r"))
    return hits.select("doc_id", "id", (F.col("n") + 1).alias("nth"), F.substring(F.col("preview"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("matched"))


@query("SELECT doc_id, id, CAST((length(text) - length(replace(text, 'en', ''))) / 2 AS INTEGER) AS match_count FROM p WHERE pos BETWEEN 2 AND 4 AND contains(text, 'en')")
def grep_windowed(p: DataFrame) -> DataFrame:
    return read.grep(p, "en", start=2, limit=3).select("doc_id", "id", "match_count")


@query("SELECT doc_id, id, substr(text, 1, 10) AS preview FROM p WHERE contains(substr(text, 41), 'ion')")
def grep_preview(p: DataFrame) -> DataFrame:
    hits = read.grep(p, "ion", max_chars=10)
    return hits.where(F.exists("ranges", lambda r: r["start"] >= 40)).select("doc_id", "id", "preview")


@query("SELECT doc_id, CAST(sum((length(text) - length(replace(text, 'er', ''))) / 2) AS BIGINT) AS matches FROM p GROUP BY doc_id")
def count_matches_literal(p: DataFrame) -> DataFrame:
    return read.count_matches(p, "er")


@query("SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '[A-Z][a-z]+'))) AS BIGINT) AS matches FROM p GROUP BY doc_id")
def count_matches_regex(p: DataFrame) -> DataFrame:
    return read.count_matches(p, "[A-Z][a-z]+", regex=True)


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS matches FROM p WHERE id = 'p_000002'")
def count_matches_one_paragraph(p: DataFrame) -> DataFrame:
    return read.count_matches(p, "[0-9]+", regex=True, paragraph_id="p_000002")


@query(", " + _literal_ranges("and") + "SELECT doc_id, id, start, start + 3 AS \"end\", count(*) OVER (PARTITION BY doc_id) AS total_matches FROM r")
def find_text_all(p: DataFrame) -> DataFrame:
    found = read.find_text(p, "and", occurrence=-1)
    return found.select("doc_id", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "total_matches")


@query(", " + _literal_ranges("and") + ", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS n FROM r) SELECT doc_id, id, start FROM o WHERE n = 3")
def find_text_nth(p: DataFrame) -> DataFrame:
    return read.find_text(p, "and", occurrence=2).select("doc_id", "id", F.col("start").cast("long").alias("start"))


@query(", " + _literal_ranges("with") + ", o AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM r) SELECT doc_id, id, start FROM o WHERE n = 1")
def find_text_unique(p: DataFrame) -> DataFrame:
    return read.find_text(p, "with").where("error is null").select("doc_id", "id", F.col("start").cast("long").alias("start"))


@query("SELECT doc_id, CAST(sum((length(text) - length(replace(text, 'with', ''))) / 4) AS BIGINT) AS total_matches, 'ambiguous_text_match' AS error FROM p GROUP BY doc_id HAVING sum((length(text) - length(replace(text, 'with', ''))) / 4) > 1")
def find_text_ambiguous(p: DataFrame) -> DataFrame:
    return read.find_text(p, "with").where("error is not null").select("doc_id", "total_matches", "error")


@query("SELECT doc_id, CAST(sum((length(text) - length(replace(text, 'and', ''))) / 3) AS BIGINT) AS total_matches, 'text_not_found' AS error FROM p GROUP BY doc_id HAVING sum((length(text) - length(replace(text, 'and', ''))) / 3) <= 2")
def find_text_missing(p: DataFrame) -> DataFrame:
    return read.text_not_found(p, "and", occurrence=2)


@query("SELECT doc_id, id AS heading_id, text AS heading_text, lvl AS level, fin - pos - 1 AS body_count FROM sec")
def list_sections(p: DataFrame) -> DataFrame:
    return read.list_sections(p).select("doc_id", "heading_id", "heading_text", "level", "body_count")


@query("SELECT doc_id, id AS heading_id, fin - pos - 1 AS body_count FROM sec WHERE lvl = 1")
def list_sections_level1(p: DataFrame) -> DataFrame:
    return read.list_sections(p, level=1).select("doc_id", "heading_id", "body_count")


@query("SELECT sec.doc_id, sec.id AS heading_id, p.id AS body_id FROM sec JOIN p ON p.doc_id = sec.doc_id AND p.pos > sec.pos AND p.pos < sec.fin")
def section_bodies(p: DataFrame) -> DataFrame:
    return read.section_bodies(p).select("doc_id", "heading_id", "body_id")


@query("SELECT p.doc_id, p.id AS heading_id, fin - p.pos - 1 AS body_count, CASE WHEN sec.id IS NULL THEN 'not_a_heading' END AS error FROM p LEFT JOIN sec ON sec.doc_id = p.doc_id AND sec.id = p.id WHERE p.id = 'p_000002'")
def get_section(p: DataFrame) -> DataFrame:
    return read.get_section(p, "p_000002").select("doc_id", "heading_id", "body_count", "error")


@query("SELECT doc_id, id, text AS content FROM p JOIN (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id) c USING (doc_id) WHERE n >= 5 AND pos BETWEEN 2 AND 5")
def copy_range(p: DataFrame) -> DataFrame:
    return read.copy_range(p, "p_000002", "p_000005").select("doc_id", "id", "content")


@query("SELECT doc_id, CASE WHEN count(*) < 4 THEN 'paragraph_not_found' ELSE 'reversed_range' END AS error FROM p GROUP BY doc_id")
def copy_range_reversed(p: DataFrame) -> DataFrame:
    return read.copy_range_errors(p, "p_000004", "p_000001")


@query("WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), chr(13) || chr(10) || chr(13)), '\\r\\n|\\r', chr(10), 'g'), '\\n{2,}', chr(1), 'g') AS t FROM documents), y AS (SELECT doc_id, string_split(t, chr(1)) AS s FROM x) SELECT doc_id, CAST(i AS INTEGER) AS pos, s[i] AS text FROM y, UNNEST(range(1, len(s) + 1)) u(i)")
def expand_visible(p: DataFrame) -> DataFrame:
    whole = read.visible_text(p).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\r\n\r")).alias("text"))
    return whole.select("doc_id", F.posexplode(T.expand_visible(F.col("text"))).alias("n", "text")).select("doc_id", (F.col("n") + 1).alias("pos"), "text")


@query("SELECT doc_id, id, replace(replace(text, 'the', '[[DOCX:TAB]]'), '[[DOCX:', chr(92) || '[[DOCX:') AS text FROM p WHERE contains(text, 'the')")
def escape_markers(p: DataFrame) -> DataFrame:
    marked = F.replace("text", F.lit("the"), F.lit("[[DOCX:TAB]]"))
    return p.where(F.contains("text", F.lit("the"))).select("doc_id", "id", T.escape_markers(marked).alias("text"))


@query("SELECT doc_id, id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 79) || '…' END AS preview FROM p")
def preview(p: DataFrame) -> DataFrame:
    return p.select("doc_id", "id", T.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, id, '条款，第 ' || pos || ' 条。说明' AS text FROM p")
def normalize_cjk(p: DataFrame) -> DataFrame:
    raw = F.concat(F.lit("条款,第"), F.col("record_pos").cast("string"), F.lit("   条.说明"))
    return p.select("doc_id", "id", T.space(T.punctuate(raw)).alias("text"))


@query("SELECT doc_id, id, '请看 https://example.com/a?x=' || pos || ' 网页，共 60 天' AS text FROM p")
def normalize_protected(p: DataFrame) -> DataFrame:
    raw = F.concat(F.lit("请看 https://example.com/a?x="), F.col("record_pos").cast("string"), F.lit(" 网页,共60天"))
    return p.select("doc_id", "id", T.normalize(raw).alias("text"))


@query("SELECT doc_id, id, CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS BIGINT) AS replacements, replace(text, 'tion', '$1') AS text FROM p")
def replace_all_literal(p: DataFrame) -> DataFrame:
    return batch.replace_all(p, "tion", "$1").select("doc_id", "id", "replacements", "text")


@query("SELECT doc_id, id, CAST(len(regexp_extract_all(text, '[aeiou]{2}')) AS BIGINT) AS replacements, regexp_replace(text, '[aeiou]{2}', '<>', 'g') AS text FROM p")
def replace_all_regex(p: DataFrame) -> DataFrame:
    return batch.replace_all(p, "[aeiou]{2}", "<>", regex=True).select("doc_id", "id", "replacements", "text")


def _ops(p: DataFrame, *ops: dict) -> DataFrame:
    """The same operations for each document."""
    fields = {"op_id": "string", "op": "string", "target_id": "string", "target_ids": "array<string>", "items": "array<string>", "find": "string", "regex": "boolean", "content": "string", "occurrence": "int", "raw": "boolean"}

    def lit(k: str, x):
        return F.lit(x.get(k)).cast(fields[k]).alias(k)

    each = [F.struct(F.lit(k).alias("seq"), *(lit(f, {"op_id": f"op{k}"} | o) for f in fields)) for k, o in enumerate(ops)]
    return p.select("doc_id").distinct().select("doc_id", F.explode(F.array(*each)).alias("o")).select("doc_id", "o.*")


def _after(p: DataFrame, *ops: dict) -> DataFrame:
    return batch.apply(p, _ops(p, *ops)).paragraphs.select("doc_id", F.col("record_pos").alias("pos"), "text")


@query("SELECT doc_id, pos, CASE WHEN id = 'p_000001' AND contains(text, 'on') THEN substr(text, 1, position('on' IN text) - 1) || 'ON' || substr(text, position('on' IN text) + 2) ELSE text END AS text FROM p")
def replace_text_nth(p: DataFrame) -> DataFrame:
    return _after(p, {"op": "replace_text", "target_id": "p_000001", "find": "on", "content": "ON", "occurrence": 0})


@query("SELECT doc_id, pos, CASE WHEN id = 'p_000001' AND contains(text, 'on') THEN substr(text, 1, position('on' IN text) - 1) || substr(text, position('on' IN text) + 2) ELSE text END AS text FROM p")
def delete_text_first(p: DataFrame) -> DataFrame:
    return _after(p, {"op": "delete_text", "target_id": "p_000001", "find": "on", "occurrence": 0})


@query("SELECT doc_id, pos, CASE WHEN id = 'p_000001' THEN replace(text, 'e', '<e') ELSE text END AS text FROM p")
def insert_text_before(p: DataFrame) -> DataFrame:
    return _after(p, {"op": "insert_text_before", "target_id": "p_000001", "find": "e", "content": "<", "occurrence": -1})


@query("SELECT doc_id, pos, CASE WHEN id = 'p_000001' THEN regexp_replace(text, '([aeiou])', '\\1>', 'g') ELSE text END AS text FROM p")
def insert_text_after(p: DataFrame) -> DataFrame:
    return _after(p, {"op": "insert_text_after", "target_id": "p_000001", "find": "[aeiou]", "regex": True, "content": ">", "occurrence": -1})


@query(", u AS (SELECT doc_id, pos * 10 AS k, text FROM p UNION ALL SELECT DISTINCT doc_id, 8, 'X' FROM p UNION ALL SELECT DISTINCT doc_id, 9, 'Y' FROM p) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS pos, text FROM u")
def insert_para_before(p: DataFrame) -> DataFrame:
    return _after(p, {"op": "insert_para_before", "target_id": "p_000001", "items": ["X\n\nY"]})


@query(", u AS (SELECT doc_id, pos * 10 AS k, text FROM p UNION ALL SELECT DISTINCT doc_id, 11, 'X' FROM p UNION ALL SELECT DISTINCT doc_id, 12, 'Y' FROM p UNION ALL SELECT DISTINCT doc_id, 13, 'Z' FROM p) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS pos, text FROM u")
def insert_para_after(p: DataFrame) -> DataFrame:
    return _after(p, {"op": "insert_para_after", "target_id": "p_000001", "items": ["X", "Y"]}, {"op": "insert_para_after", "target_id": "p_000001", "items": ["Z"]})


@query(", u AS (SELECT doc_id, pos * 10 AS k, text FROM p WHERE pos > 1 UNION ALL SELECT DISTINCT doc_id, 8, 'X' FROM p UNION ALL SELECT DISTINCT doc_id, 9, 'Y' FROM p) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS pos, text FROM u")
def replace_para_many(p: DataFrame) -> DataFrame:
    return _after(p, {"op": "replace_para", "target_id": "p_000001", "items": ["X", "Y"]})


_COUNTED = ", c AS (SELECT p.*, count(*) OVER (PARTITION BY doc_id) AS n FROM p)"


@query(_COUNTED + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS pos, text FROM c WHERE n < 3 OR pos NOT IN (1, 3)")
def delete_para(p: DataFrame) -> DataFrame:
    return _after(p, {"op": "delete_para", "target_ids": ["p_000003", "p_000001"]})


_MIXED = [
    {"op": "insert_para_before", "target_id": "p_000001", "items": ["Head\n\nSecond"]},
    {"op": "insert_para_after", "target_id": "p_000001", "items": ["After"]},
    {"op": "replace_para", "target_id": "p_000002", "items": ["New"]},
    {"op": "delete_para", "target_ids": ["p_000003"]},
    {"op": "replace_text", "target_id": "p_000001", "find": "e", "content": "E", "occurrence": -1},
    {"op": "replace_text", "target_id": "p_000001", "find": "En", "content": "(En)", "occurrence": -1},
]
_MIXED_OK = _COUNTED + ", ok AS (SELECT doc_id FROM c WHERE n >= 3 AND pos = 1 AND contains(replace(text, 'e', 'E'), 'En') AND contains(text, 'e'))"


@query(_MIXED_OK + """, u AS (SELECT doc_id, pos * 10 AS k, text FROM p WHERE doc_id NOT IN (SELECT doc_id FROM ok)
UNION ALL SELECT doc_id, pos * 10, CASE pos WHEN 1 THEN replace(replace(text, 'e', 'E'), 'En', '(En)') WHEN 2 THEN 'New' ELSE text END FROM p WHERE doc_id IN (SELECT doc_id FROM ok) AND pos <> 3
UNION ALL SELECT doc_id, k, t FROM ok, (VALUES (8, 'Head'), (9, 'Second'), (11, 'After')) v(k, t))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS pos, text FROM u""")
def batch_mixed(p: DataFrame) -> DataFrame:
    return _after(p, *_MIXED)


@query(_COUNTED + ", d AS (SELECT doc_id, any_value(n) AS n FROM c GROUP BY doc_id) SELECT doc_id, CASE WHEN n < 2 THEN 1 ELSE 2 END AS operation_index, CASE WHEN n < 2 THEN 'replace_para: no such paragraph' ELSE 'two operations exclude each other on one paragraph' END AS reason FROM d")
def batch_conflicts(p: DataFrame) -> DataFrame:
    ops = _ops(p, {"op": "insert_para_before", "target_id": "p_000001", "items": ["A"]}, {"op": "replace_para", "target_id": "p_000002", "items": ["B"]}, {"op": "delete_para", "target_ids": ["p_000001", "p_000002"]})
    return batch.apply(p, ops).errors.select("doc_id", "operation_index", "reason")


@query(", ok AS (SELECT doc_id FROM p WHERE pos = 1 AND (length(text) - length(replace(text, 'the', ''))) = 3) SELECT doc_id, pos, CASE WHEN pos = 1 AND doc_id IN (SELECT doc_id FROM ok) THEN replace(text, 'the', 'THE') ELSE text END AS text FROM p")
def batch_rollback(p: DataFrame) -> DataFrame:
    return _after(p, {"op": "replace_text", "target_id": "p_000001", "find": "the", "content": "THE"})


@query(", x AS (SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM p WHERE pos = 1) SELECT doc_id, 0 AS seq, CASE WHEN n = 1 THEN 'replace_text' ELSE 'batch' END AS op, CASE WHEN n = 1 THEN 'success' ELSE 'failed' END AS status, CASE WHEN n = 0 THEN 'text_not_found' WHEN n > 1 THEN 'ambiguous_text_match' END AS reason FROM x")
def batch_change_log(p: DataFrame) -> DataFrame:
    ops = _ops(p, {"op": "replace_text", "target_id": "p_000001", "find": "the", "content": "THE"})
    return batch.apply(p, ops).change_log().select("doc_id", "seq", "op", "status", "reason")


@query("SELECT doc_id, 1 AS seq, 'p_' || printf('%06d', n + 2) AS new_id, 'B' AS after_preview, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 79) || '…' END AS before_preview FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p) WHERE pos = 1")
def batch_results(p: DataFrame) -> DataFrame:
    ops = _ops(p, {"op": "insert_para_before", "target_id": "p_000001", "items": ["A"]}, {"op": "insert_para_after", "target_id": "p_000001", "items": ["B"]})
    done = batch.apply(p, ops).results.where("seq = 1")
    return done.select("doc_id", "seq", F.col("new_ids")[0].alias("new_id"), F.col("after_previews")[0].alias("after_preview"), "before_preview")


@query(_MIXED_OK + " SELECT c.doc_id, TRUE AS hashes_ok, TRUE AS removed_ok, TRUE AS count_ok, CASE WHEN ok.doc_id IS NULL THEN any_value(n) ELSE any_value(n) - 3 END AS untouched FROM c LEFT JOIN ok ON ok.doc_id = c.doc_id GROUP BY c.doc_id, ok.doc_id")
def precommit_untouched(p: DataFrame) -> DataFrame:
    ops = _ops(p, *_MIXED)
    return batch.precommit(p, batch.apply(p, ops), ops)


def conversation_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = corpus.from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return read.grep(turns, "the").select("doc_id", "global_ordinal", "match_count")


QUERIES["conversation_grep"] = conversation_grep
ORACLE_SQL["conversation_grep"] = "SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS global_ordinal, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS match_count FROM conversations WHERE contains(text, 'the')"


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _doc_id() -> Column:
    return F.substring_index("path", ".", 1).cast("long").alias("doc_id")


def _package_ops(spark: SparkSession, sf_dir: str, *ops: dict) -> DataFrame:
    """The same operations for each package."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return _ops(docs, *ops).withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit(".docx"))).drop("doc_id")


def docx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docx.scan(_packages(spark, sf_dir))
    return rows.select(_doc_id(), "id", "global_ordinal", "style_id", "text", F.col("error.code").alias("error"))


def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned, edited, rebuilt and scanned again."""
    ops = _package_ops(spark, sf_dir, {"op": "insert_para_after", "target_id": "p_000001", "items": ["X\n\nY"]}, {"op": "replace_text", "target_id": "p_000001", "find": "e", "content": "[e]", "occurrence": -1})
    again = docx.scan(package.as_files(package.edit_packages(_packages(spark, sf_dir), ops)))
    return again.select(_doc_id(), F.col("record_pos").alias("pos"), "text")


QUERIES |= {"docx_scan": docx_scan, "docx_round_trip": docx_round_trip}
ORACLE_SQL["docx_scan"] = P + "SELECT doc_id, id, pos AS global_ordinal, style AS style_id, text, CAST(NULL AS VARCHAR) AS error FROM p"
ORACLE_SQL["docx_round_trip"] = P + """, ok AS (SELECT doc_id FROM p WHERE pos = 1 AND contains(text, 'e')),
u AS (SELECT doc_id, pos * 10 AS k, CASE WHEN pos = 1 THEN replace(text, 'e', '[e]') ELSE text END AS text FROM p WHERE doc_id IN (SELECT doc_id FROM ok) UNION ALL SELECT doc_id, 11, 'X' FROM ok UNION ALL SELECT doc_id, 12, 'Y' FROM ok)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS pos, text FROM u"""

QUERIES |= registry_docx.QUERIES
ORACLE_SQL |= registry_docx.ORACLE_SQL
