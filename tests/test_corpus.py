"""Corpus operators against DuckDB and plain Python, on the smallest tables."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.packages import ABCD, package, para
from vellumite import registry
from vellumite.errors import InvalidPatternError
from vellumite.functions import match
from vellumite.operators import read
from vellumite.plans import batch
from vellumite.plans import package as packages_plan
from vellumite.plans.package import OPERATIONS, as_files, edit_packages, replace_all_packages
from vellumite.sinks.docx import drifted, save_packages
from vellumite.sources import docx
from vellumite.sources.docx import read_packages
from vellumite.streaming import watch

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


def _plain(x):
    if x is None or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) and math.isfinite(x) and x.is_integer() else x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(repr([_plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = registry.QUERIES[name](spark, DATA)
    cursor = con.execute(registry.ORACLE_SQL[name])
    expected = _rows([d[0] for d in cursor.description], cursor.fetchall())
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == expected


@pytest.mark.parametrize("name", ["docx_text_edits", "docx_batch", "docx_results", "docx_change_log", "docx_warnings"])
def test_first_words_that_hold_what_is_edited(spark, tmp_path, name):
    rows = [(1, "EUX et"), (2, "XXX"), (3, "alphabet"), (4, "Xalpha alpha"), (5, ""), (6, None), (7, "pha be")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df = registry.QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(registry.ORACLE_SQL[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in cursor.description], cursor.fetchall())


def test_refused_batches_share_a_scan_and_move_nothing(spark):
    plan = registry.QUERIES["docx_refusals"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_batches_for_all_packages_are_those_of_each(spark, tmp_path):
    good, bad = {"op_id": "a", "op": "replace_text", "target_id": "p_000001", "find": "A", "content": "Z"}, {"op_id": "b", "op": "delete_para", "target_ids": ["p_000009"]}
    for k in range(3):
        package(para(f"A{k}") + para("B"), tmp_path / f"{k}.docx")
    (tmp_path / "no.docx").write_bytes(b"no package")
    files = docx.binary_files(spark, str(tmp_path))
    both = {name: [packages_plan.operation(o)] for name, o in (("good", good), ("bad", bad))}
    got = packages_plan.edit_all_packages(files, both)
    for name, o in (("good", good), ("bad", bad)):
        kinds = dict(x.split() for x in OPERATIONS.split(", "))
        ops = files.select(*(F.col("path") if n == "path" else F.array(*map(F.lit, o[n])).cast(t).alias(n) if n in ("target_ids",) and n in o else F.lit({"seq": 0} .get(n, o.get(n))).cast(t).alias(n) for n, t in kinds.items()))
        assert sorted(map(repr, got.where(F.col("batch") == name).drop("batch").collect())) == sorted(map(repr, edit_packages(files, ops).collect()))
    some = packages_plan.edit_all_packages(files, both, returned=("path", "error"))
    assert some.columns == ["batch", "path", "error"] and some.count() == 8


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for k in range(300):
        package(para(f"A{k}"), tmp_path / f"{k}.docx")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        files = docx.binary_files(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() <= 32 * spark.sparkContext.defaultParallelism
        assert {r["text"] for r in read_packages(spark, str(tmp_path)).select("text").collect()} == {f"A{k}" for k in range(300)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_saved_packages_are_read_by_names_in_one_scan(spark, tmp_path):
    for k in range(70):
        package(para(f"A{k}"), tmp_path / f"{k}.docx")
    (tmp_path / "7.docx.bak").write_bytes((tmp_path / "7.docx").read_bytes())
    (tmp_path / ".9.docx").write_bytes(b"hidden")
    files = docx.folder_files(spark, str(tmp_path))
    key = lambda r: (r["path"].rpartition("/")[2], r["modificationTime"].replace(microsecond=0), r["length"], bytes(r["content"]))
    assert sorted(map(key, files.collect())) == sorted(map(key, docx.binary_files(spark, str(tmp_path)).collect()))
    assert files.rdd.getNumPartitions() <= 32 * spark.sparkContext.defaultParallelism
    assert docx.folder_files(spark, str(tmp_path), ("*.docx", "*.bak")).count() == 71 and docx.folder_files(spark, str(tmp_path), ("*.none",)).count() == 0
    saved = entry.queries()["docx_save"](spark, "/root/testdata/sf0.001")
    plan = saved._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and plan.count("MapInArrow") == 2
    docs = [r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()]
    assert sorted(map(tuple, saved.collect())) == sorted(x for d in docs for x in ((d, "docx", f"second {d}"), (d, "bak", f"first {d}")))


def test_entry(spark):
    assert entry.entry(spark).limit(1).collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["grep_literal", "grep_regex", "find_text_all", "list_sections", "replace_all_regex", "section_bodies"])
def test_reads_stay_in_the_jvm(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_windows_and_ids_reach_the_scan(spark):
    df = registry.paragraphs(spark, DATA).where("doc_id = 5")
    assert "EqualTo(doc_id,5)" in read.grep(df, "the")._jdf.queryExecution().executedPlan().toString()


PATTERNS = [r"\w+", r"\W", r"\s", r"\S+", r"[^\W\d]+", r"\B.", r"[]a-]", r"[\s\d]+x?", r"\v|\t", "th", "e[a-z]+t", r"\bthe\b", "[A-Z]\\w*", "(?i)THE", "a*", "x?", "(?P<n>a)(?P=n)", r"\d+", "aa|a", "a(?=b)", "^a", "b$"]


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text("abTheÉ1２ \n x]-́½²Ⅷ‍\x0b\x1c\x1f\x85\xa0ⓐ٣_", max_size=12), min_size=1, max_size=5), pattern=st.sampled_from(PATTERNS), edit=st.booleans())
def test_regex_ranges_are_pythons(spark, texts, pattern, edit):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", match.ranges(F.col("t"), pattern, True, edit).alias("r"))
    for t, r in df.collect():
        assert [(x["start"], x["end"]) for x in r] == match.find(re.compile(pattern, re.DOTALL if edit else 0), t, edit)


@settings(max_examples=10, deadline=None)
@given(texts=st.lists(st.text("ab\\E$😀", max_size=10), min_size=1, max_size=5), needle=st.text("ab\\E$😀", min_size=1, max_size=3))
def test_literal_ranges(spark, texts, needle):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", match.ranges(F.col("t"), needle).alias("r"), match.count(F.col("t"), needle).alias("n"))
    for t, r, n in df.collect():
        assert [(x["start"], x["end"]) for x in r] == [m.span() for m in re.finditer(re.escape(needle), t)] and n == len(r)


def test_bad_patterns():
    for pattern, regex in (("", False), ("(", True)):
        with pytest.raises(InvalidPatternError):
            match.checked(pattern, regex)


def _ops(spark, *rows):
    names = [x.split()[0] for x in batch.OPERATIONS.replace("array<string>", "a").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], batch.OPERATIONS)


def test_batches_are_atomic_for_each_document(spark):
    p = spark.createDataFrame([(d, f"p_{k:06d}", k, k, "Normal", t) for d in (1, 2) for k, t in enumerate("ABCD", 1)], "doc_id long, id string, record_pos int, global_ordinal int, style_id string, text string")
    one = {"seq": 0, "op_id": "a", "op": "insert_para_before", "target_id": "p_000001", "items": ["Z1", "Z2"]}
    two = {"seq": 1, "op_id": "b", "op": "delete_para", "target_ids": ["p_000001"]}
    bad = {"seq": 1, "op_id": "b", "op": "replace_text", "target_id": "p_000002", "find": "(", "regex": True, "content": "x"}
    out = batch.apply(p, _ops(spark, one | {"doc_id": 1}, two | {"doc_id": 1}, one | {"doc_id": 2}, bad | {"doc_id": 2}))
    texts = {d: [r["text"] for r in out.paragraphs.where(f"doc_id = {d}").orderBy("record_pos").collect()] for d in (1, 2)}
    assert texts == {1: ["Z1", "Z2", "B", "C", "D"], 2: ["A", "B", "C", "D"]}
    assert [(r["doc_id"], r["operation_index"], "cannot search" in r["reason"]) for r in out.errors.collect()] == [(2, 1, True)]
    late = _ops(spark, {"doc_id": 1, "seq": 0, "op_id": "a", "op": "delete_para", "target_ids": ["p_000001", "p_000002"]}, {"doc_id": 1, "seq": 1, "op_id": "b", "op": "insert_para_before", "target_id": "p_000002", "items": ["X"]})
    assert batch.apply(p, late).errors.count() == 1


def test_packages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    package(ABCD, tmp_path / "in" / "a.docx")
    package(para("x"), tmp_path / "in" / "b.docx")
    (tmp_path / "in" / "bad.docx").write_bytes(b"no")
    rows = read_packages(spark, str(tmp_path / "in"))
    assert {r["error"]["code"] for r in rows.where("error is not null").collect()} == {"invalid_document"}
    assert read_packages(spark, str(tmp_path / "in"), "DROPMALFORMED").where("error is not null").count() == 0
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    a = files.where("path like '%a.docx'").first()["path"]
    ops = spark.createDataFrame([(a, 0, "1", "insert_para_after", "p_000002", None, ["E"], None, None, None, None, False)], OPERATIONS)
    edited = edit_packages(files, ops)
    plan = edited._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan binaryFile") == 1 and "SortMergeJoin" not in plan
    saved = save_packages(edited, str(tmp_path / "out")).collect()
    assert sorted(r["dest"].rpartition("/")[2] for r in saved if r["error"] is None) == ["a.docx", "b.docx"]
    again = read_packages(spark, str(tmp_path / "out"))
    assert [r["text"] for r in again.where("path like '%a.docx'").orderBy("record_pos").collect()] == ["A", "B", "E", "C", "D"]
    assert drifted(rows.where("error is null"), files).count() == 0


def test_package_batches(spark, tmp_path):
    package(ABCD, tmp_path / "a.docx")
    package('<w:p><w:hyperlink w:anchor="x"><w:r><w:t>there</w:t></w:r></w:hyperlink></w:p>' + para("B B"), tmp_path / "b.docx")
    (tmp_path / "c.docx").write_bytes(b"no")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    known = read_packages(spark, str(tmp_path)).select("path", "source")
    at = {r["path"].rpartition("/")[2]: r["path"] for r in files.collect()}
    ops = [
        (at["a.docx"], 0, "r", "insert_para_after", "p_000001", None, ["<w:p><w:r><w:t>raw</w:t></w:r></w:p>"], None, None, None, None, True),
        (at["a.docx"], 1, "n", "replace_para", "p_000003", None, ["三十日,共60天"], None, None, None, None, False),
        (at["b.docx"], 0, "w", "replace_para", "p_000001", None, ["here"], None, None, None, None, False),
        (at["b.docx"], 1, "f", "replace_text", "p_000002", None, None, "B", False, "b", None, False),
        (at["c.docx"], 0, "x", "delete_para", None, ["p_000001"], None, None, None, None, None, False),
    ]
    edited = edit_packages(files, spark.createDataFrame(ops, OPERATIONS), normalize_text=True, known=known)
    got = {r["path"].rpartition("/")[2]: r for r in edited.collect()}
    texts = {r["id"]: r["text"] for r in read_texts(spark, edited, "a.docx")}
    assert texts == {"p_000001": "A", "p_000002": "raw", "p_000003": "B", "p_000004": "三十日，共 60 天", "p_000005": "D"}
    assert [x["op_id"] for x in got["a.docx"]["change_log"]] == ["r", "n"] and got["a.docx"]["results"][0]["new_ids"] == ["p_000005"]
    failed = got["b.docx"]
    assert (failed["error"]["code"], failed["error"]["operation_index"], failed["error"]["op_id"], failed["error"]["error_type"]) == ("ambiguous_text_match", 1, "f", "AmbiguousTextMatchError")
    assert [(x["status"], x["expected_paragraph_count"], x["actual_paragraph_count"]) for x in failed["change_log"]] == [("failed", 2, 2)] and failed["results"] == []
    assert got["c.docx"]["error"]["code"] == "invalid_document"
    warned = edit_packages(files, spark.createDataFrame(ops[2:3], OPERATIONS)).where("path like '%b.docx'").first()
    assert list(warned["warnings"]) == ["hyperlink"] == list(warned["results"][0]["warnings"])
    text_raw = edit_packages(files, spark.createDataFrame([(*ops[3][:-1], True)], OPERATIONS)).where("path like '%b.docx'").first()
    assert text_raw["error"]["operation_index"] == 1 - 1 and "raw" in text_raw["error"]["reason"]
    every = {r["path"].rpartition("/")[2]: r for r in replace_all_packages(files, "[AB]", "x", regex=True).collect()}
    assert [(every[k]["replacements"], every[k]["error"] is None) for k in ("a.docx", "b.docx", "c.docx")] == [(2, True), (2, True), (0, False)]
    linked = replace_all_packages(files, "[tB]", "x", regex=True).where("path like '%b.docx'").first()
    assert linked["error"]["code"] == "unsupported_structure" and linked["replacements"] == 0
    package(ABCD + para("E"), tmp_path / "a.docx")
    later = spark.read.format("binaryFile").load(str(tmp_path))
    old = known.where("path like '%b.docx'").unionByName(known.where("path like '%a.docx'").withColumn("source", F.col("source").withField("sha256", F.lit("0"))))
    assert {r["path"].rpartition("/")[2]: r["error"] and r["error"]["code"] for r in edit_packages(later, spark.createDataFrame(ops[:1], OPERATIONS), known=old).collect()}["a.docx"] == "source_changed"


def read_texts(spark, edited, name):
    from vellumite.sources.docx import scan

    return scan(as_files(edited.where(F.col("path").endswith(name)))).orderBy("record_pos").collect()


def test_stream(spark, tmp_path):
    for x in ("in", "out"):
        (tmp_path / x).mkdir()
    package(ABCD, tmp_path / "in" / "a.docx")
    path = spark.read.format("binaryFile").load(str(tmp_path / "in")).first()["path"]
    ops = spark.createDataFrame([(path, 0, "1", "delete_para", None, ["p_000001"], None, None, None, None, None, False)], OPERATIONS)
    watch.edit_stream(watch.read_stream(spark, str(tmp_path / "in")), ops, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r["text"] for r in read_packages(spark, str(tmp_path / "out")).orderBy("record_pos").collect()] == ["B", "C", "D"]
