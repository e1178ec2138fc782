"""Registration, rewriting, restoring, state, columns and streams."""

import contextlib
import csv
import io
import os
import random
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from veilwork.catalog import corpora
from veilwork.operators import allowlist as A
from veilwork.operators.audit import inconsistent_mappings, leaks, round_trip_differences
from veilwork.operators.columns import anonymize_table, put_back, restore_table, target_columns, template_columns, templates
from veilwork.operators.detect import detect, pick_rules
from veilwork.operators.dictionary import candidate_entries, hit_rows
from veilwork.operators.entities import merge_entities
from veilwork.operators.registry import empty_case, number_tokens, open_at_rest, protect_at_rest, register
from veilwork.operators.rewrite import anonymize, anonymize_corpus, deanonymize, find_spans
from veilwork.plans import clear_stages, lookup_join, sequence_table, stage, with_dense_number, with_group_number
from veilwork.operators.spans import span_rows
from veilwork.sources.corpus import list_files, read_corpus, read_table, read_values, write_bucketed_corpus
from veilwork.sources import files, jobs
from veilwork.sources.files import write_files
from veilwork.sources.jobs import anonymize_files, anonymize_folder, restore_files, restore_folder
from veilwork.sources.state import commit_state, load_state
from veilwork.sources.tables import read_delimited
from veilwork.streaming.incremental import anonymize_batch, anonymize_stream, read_state
from veilwork.streaming.lookup import BatchState, KeyTable

TEXTS = [
    "Accepted for john.doe from 10.0.0.5, mail john.doe@example.org",
    "password=Hunter22! later Hunter22! and John.doe; call +32 471 98 76 54 now",
    "mail John.Doe@other.example.org and jane@example.org, (JANE@example.org)",
    "the server at 192.168.1.1 is up",
]


def spans_of(docs):
    return detect(docs, protect=True).drop("left_ctx", "right_ctx")


@pytest.fixture(scope="module")
def run(spark, corpus):
    docs = corpus(TEXTS, 3)
    out, registry = anonymize_corpus(docs, spans_of(docs), empty_case(spark)["registry"], "c")
    return docs, out, registry


def test_registry(run):
    rows = run[2].orderBy("mapping_id").collect()
    assert [r.mapping_id for r in rows] == list(range(1, len(rows) + 1))
    tokens = {r.raw_value: r.token for r in rows}
    assert tokens["john.doe"] == "ANONUSER001"
    assert tokens["john.doe@example.org"] == "ANONEMAIL001"
    assert tokens["John.Doe@other.example.org"] == "ANONEMAIL002"
    person = {r.raw_value: r.entity_id for r in rows}
    assert person["john.doe"] == person["john.doe@example.org"] == person["John.Doe@other.example.org"] == "PERSON001"
    assert person["jane@example.org"] == person["JANE@example.org"]


def test_rewrite_and_restore(run):
    docs, out, registry = run
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] == "password=ANONPASS001 later ANONPASS001 and ANONUSER001; call ANONPHONE001 now"
    assert text[3] == TEXTS[3]
    back = deanonymize(out, registry, "c")
    # a second spelling of a value comes back in the form that holds it
    assert sorted(r.doc_id for r in round_trip_differences(docs, back).collect()) == [1, 2]
    restored = {r.doc_id: r.text for r in back.collect()}
    assert restored[0] == TEXTS[0]
    assert restored[2] == TEXTS[2].replace("jane@", "JANE@")
    assert restored[1] == TEXTS[1].replace("John.doe", "john.doe")
    assert leaks(out, registry, "c").count() == 0
    assert inconsistent_mappings(registry).count() == 0


def test_same_result_for_any_partitioning(spark, corpus, run):
    docs = corpus(TEXTS, 1)
    one = register(spans_of(docs), empty_case(spark)["registry"], "c")
    cols = ["mapping_id", "raw_value", "token", "entity_id"]
    assert sorted(map(tuple, one.select(cols).collect())) == sorted(map(tuple, run[2].select(cols).collect()))


def test_incremental_keeps_tokens(spark, corpus, run):
    docs = corpus(TEXTS)
    first = register(spans_of(docs.where("doc_id < 2")), empty_case(spark)["registry"], "c")
    second = first.unionByName(register(spans_of(docs), first, "c"))
    cols = ["raw_value", "token", "entity_id"]
    assert sorted(map(tuple, second.select(cols).collect())) == sorted(map(tuple, run[2].select(cols).collect()))


def test_cases_are_separate(spark, corpus, run):
    docs = corpus(["only bob@example.org"])
    other = register(spans_of(docs), run[2], "d").collect()
    assert [(r.case_id, r.token, r.entity_id) for r in other] == [("d", "ANONEMAIL001", "PERSON001")]


def test_restore_by_type(spark, corpus, run):
    docs = corpus(["ANONUSER001 ANONEMAIL001 xANONUSER001 ANONUSER999 (ANONEMAIL001)"])
    only = deanonymize(docs, run[2], "c", ["email"]).first().text
    assert only == "ANONUSER001 john.doe@example.org xANONUSER001 ANONUSER999 (john.doe@example.org)"
    assert deanonymize(docs, run[2], "c", []).first().text == docs.first().text


def test_numbering_over_many_partitions(spark):
    df = spark.range(5000).withColumn("g", F.expr("if(id % 3 = 0, 'hot', cast(id % 7 as string))")).repartition(13)
    seq = sequence_table(df, ["id"], "seq")
    rows = with_group_number(with_dense_number(seq, "n"), "g", "gn").orderBy("id").collect()
    seen = {}
    for i, r in enumerate(rows):
        seen[r.g] = seen.get(r.g, 0) + 1
        assert (r.n, r.gn) == (i + 1, seen[r.g])


def test_tokens_past_three_digits(spark):
    values = spark.range(1200).selectExpr(
        "concat('v', id) as raw_value", "id as ord", "0 as start", "'email' as pii_type", "'' as source_doc"
    )
    rows = number_tokens(values, empty_case(spark)["registry"], "c").orderBy("num").collect()
    assert (rows[0].token, rows[-1].token) == ("ANONEMAIL001", "ANONEMAIL1200")


def test_lookup_with_hot_and_null_keys(spark):
    rows = spark.range(600).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 50 = 1, null, cast(id % 40 as string))) as k")
    table = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    got = lookup_join(rows, table, "k").collect()
    assert len(got) == 600 and sum(r.v == 1 for r in got) == 200 and all((r.v == 2) == (r.k == "5") for r in got)


def test_allowlist(spark, corpus):
    docs = corpus(["for a.b from x@staff.example.org y@sub.staff.example.org on LAPTOP-anna host"])
    listed = spark.createDataFrame(
        [("c", "A.B", "username", ""), ("c", "Staff.example.org", "domain", ""), ("other", "LAPTOP-anna", "ioc", "")],
        "case_id string, value string, value_type string, reason string",
    )
    kept = A.drop_allowed(spans_of(docs), listed, "c").collect()
    assert sorted(r.raw_value for r in kept) == ["LAPTOP-anna", "y@sub.staff.example.org"]


def test_columns(spark):
    assert target_columns(["Name", "email", "IP"], ["EMAIL", "none"], ["email"]) == ["email"]
    assert target_columns(["Name", "email", "IP"], None, ["ip"]) == ["Name", "email"]
    assert template_columns("crypto-kyc", ["x"])[0] == ["x"]
    assert templates(spark).count() == 7
    with pytest.raises(ValueError):
        template_columns("none such")
    table = spark.createDataFrame(
        [
            (1, "t1", "tom@example.org", "Tom V", "LAPTOP-TOM", "10.0.0.1"),
            (2, "t2", "tom@example.org", "Lisa M", " ", "10.0.0.2"),
            (3, "t3", "see lisa@example.org!", "x", "unknown", "tom@example.org"),
        ],
        "id int, Timestamp string, UserPrincipalName string, DisplayName string, DeviceName string, IPAddress string",
    )
    out, registry = anonymize_table(table, "id", empty_case(spark)["registry"], "c", template="microsoft-signin")
    rows = [tuple(r) for r in out.orderBy("id").collect()]
    assert rows == [
        (1, "t1", "ANONEMAIL001", "ANONNAME001", "ANONHOST001", "10.0.0.1"),
        (2, "t2", "ANONEMAIL001", "ANONNAME002", " ", "10.0.0.2"),
        (3, "t3", "see ANONEMAIL002!", "x", "ANONNAME003", "tom@example.org"),
    ]
    back = restore_table(out, "id", registry, "c", ["UserPrincipalName", "DisplayName", "DeviceName"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


def test_values_at_rest(spark, run):
    key = spark.createDataFrame([(b"0" * 16, "s")], "key binary, salt string")
    wrong = spark.createDataFrame([(b"1" * 16, "s")], "key binary, salt string")
    closed = protect_at_rest(run[2], key)
    assert "raw_value" not in closed.columns
    opened = {r.raw_value for r in open_at_rest(closed, key).collect()}
    assert opened == {r.raw_value for r in run[2].collect()}
    assert all(r.raw_value is None for r in open_at_rest(closed, wrong).collect())


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "doc_id string, ord bigint, path string, text string"
    docs = spark.createDataFrame([(str(i), i, f"p{i}", t) for i, t in enumerate(TEXTS)], schema)
    writer = lambda: anonymize_stream(
        spark.readStream.schema(schema).parquet(source), str(tmp_path / "state"), str(tmp_path / "out"), "c"
    ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    docs.where("ord < 2").coalesce(1).write.parquet(source)
    writer()
    docs.where("ord >= 1").coalesce(1).write.mode("append").parquet(source)  # p1 comes again
    writer()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.doc_id for r in rows) == ["0", "1", "2", "3"]
    text = {r.doc_id: r.text for r in rows}
    assert text["0"] == "Accepted for ANONUSER001 from 10.0.0.5, mail ANONEMAIL001"
    assert text["2"] == "mail ANONEMAIL002 and ANONEMAIL004, (ANONEMAIL004)"


def test_batches_like_whole_registries(spark, tmp_path):
    """Values, links, numbers and rewriting of batches that look up keys, against jobs on the whole registry; retries too."""
    texts = [
        "mail jan.peeters@example.org", "Accepted for jan.peeters from 10.0.0.9", "user Jan.Peeters and JAN.PEETERS@example.org, 5 kim.li@example.org",
        "nothing here", "for kim.li from 10.0.0.1 and jan.peeters@example.org", "operator: new.one, mail Kim.li@example.org, +1 (555) 000-0167",
        "for new.one from 10.0.0.1: Jan.peeters@example.org; \u00e9 password=Geheim77!",
    ]
    schema = "doc_id string, ord bigint, path string, text string"
    registry, want = empty_case(spark)["registry"], {}
    for n in range(4):
        rows = [(str(i), i, f"p{i}", texts[i % 7] if i < 7 else f"{texts[i % 7]} no{i}@example.org") for i in range(2 * n, 2 * n + 3)]
        docs = spark.createDataFrame(rows, schema)
        anonymize_batch(docs, n, str(tmp_path / "state"), str(tmp_path / "out"), "c")
        if n == 2:  # a batch that was lost after its commit is run again
            anonymize_batch(docs, n, str(tmp_path / "state"), str(tmp_path / "out"), "c")
        fresh = docs.where(~F.col("path").isin(sorted(want) or [""]))
        rewritten, registry = anonymize_corpus(fresh, find_spans(fresh, "c"), registry, "c")
        registry = stage(registry, "whole")
        want |= {r.path: (r.text, r.n_hits) for r in rewritten.collect()}
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(want) == 9 and {r.path: (r.text, r.n_hits) for r in got} == want
    state = read_state(spark, str(tmp_path / "state" / "registry"), registry._jdf.schema().toDDL())
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, registry.collect()))


def test_lookups_stay_flat(spark, tmp_path):
    """The files that a few keys make a batch read don't grow with the table; retries and merges lose nothing."""
    state, live, rows, sizes = BatchState(spark, str(tmp_path)), [], 0, {}
    for n in range(20):
        new = spark.range(rows, rows + 2000).selectExpr("xxhash64(id) as h", "id as v")
        table = KeyTable(state, "t", "v bigint", live, bucket_rows=500)
        table.add(new, n)
        live, rows = KeyTable(state, "t", "v bigint", live, bucket_rows=500).add(new, n), rows + 2000
        if n in (4, 19):
            table = KeyTable(state, "t", "v bigint", live, bucket_rows=500)
            keys = stage(spark.range(0, 5).selectExpr("xxhash64(id * 300) as h"), "keys")
            assert sorted(r.v for r in table.find(keys).collect()) == [0, 300, 600, 900, 1200]
            sizes[n] = sum(f.stat().st_size for p in table.paths(keys) for f in Path(p.removeprefix("file:")).glob("*.parquet"))
    assert len(live) <= 9 and sizes[19] <= 2 * sizes[4]
    whole = KeyTable(state, "t", "v bigint", live).find(stage(spark.range(rows).selectExpr("xxhash64(id) as h"), "keys"))
    assert whole.count() == whole.distinct().count() == rows
    state.commit(3, {"a": 1})
    state.commit(3, {"a": 2})
    assert state.before(3) == {} and state.before(9) == {"a": 2}


def test_manual_links(spark):
    registry = spark.createDataFrame(
        [("c", i, f"P{i}", "name", f"v{i}", f"T{i}", i, "") for i in range(1, 6)], empty_case(spark)["registry"].schema
    )
    entities = spark.createDataFrame([("c", f"P{i}", "person", "") for i in range(1, 6)], empty_case(spark)["entities"].schema)
    links = lambda *rows: spark.createDataFrame([("c", *r) for r in rows], "case_id string, keep string, merge string, n int")
    moved, left = merge_entities(registry, entities, links(("P1", "P1", 0), ("P2", "P3", 1), ("P4", "P3", 2), ("P5", "P4", 3)))
    assert {r.raw_value: r.entity_id for r in moved.collect()} == {"v1": "P1", "v2": "P2", "v3": "P5", "v4": "P5", "v5": "P5"}
    assert moved.count() == 5 and sorted(r.entity_id for r in left.collect()) == ["P1", "P2", "P5"]
    for cycle in ([("P1", "P2", 0), ("P2", "P1", 0)], [("P1", "P2", 0), ("P2", "P3", 0), ("P3", "P1", 0)]):
        with pytest.raises(ValueError):
            merge_entities(registry, entities, links(*cycle))


def test_typed_targets(spark):
    table = spark.createDataFrame([(1, 5551234567, "x"), (2, None, "y")], "id int, phone bigint, note string")
    empty = empty_case(spark)["registry"]
    out, registry = anonymize_table(table, "id", empty, "c", pii_columns=["Phone"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "ANONPHONE001", "x"), (2, None, "y")]
    with pytest.raises(ValueError):
        anonymize_table(table, "id", empty, "c", pii_columns=["id"])
    with pytest.raises(ValueError):
        anonymize_table(table.selectExpr("id", "array(note) as note"), "id", empty, "c", pii_columns=["note"])


def test_column_plan_does_not_grow(spark):
    """The table is read a fixed number of times, whatever the number of columns."""
    mapping = spark.createDataFrame([("a", "T")], "value string, new_value string")
    scans = []
    for n in (1, 6, 30):
        table = spark.range(3).selectExpr("id", *[f"if(id = 1, 'a', 'b{i}') as c{i}" for i in range(n)])
        out = put_back(table, "id", [f"c{i}" for i in range(n)], mapping)
        scans.append(out._jdf.queryExecution().optimizedPlan().toString().count("Range ("))
        assert sorted(map(tuple, out.collect())) == [(0, *[f"b{i}" for i in range(n)]), (1, *["T"] * n), (2, *[f"b{i}" for i in range(n)])]
    assert scans[0] == scans[1] == scans[2] == 2


def test_table_with_allowlist_and_types(spark):
    table = spark.createDataFrame([(1, "tom@example.org"), (2, "ann@example.org"), (3, "Tom V")], "id int, who string")
    listed = spark.createDataFrame([("c", "TOM@example.org", "email", ""), ("c", "tom v", "name", "")], empty_case(spark)["allowlist"].schema)
    out, _ = anonymize_table(table, "id", empty_case(spark)["registry"], "c", pii_columns=["who"], allowlist=listed)
    assert [r.who for r in out.orderBy("id").collect()] == ["tom@example.org", "ANONEMAIL001", "Tom V"]
    out, _ = anonymize_table(table, "id", empty_case(spark)["registry"], "c", pii_columns=["who"], include=["email"])
    assert [r.who for r in out.orderBy("id").collect()] == ["ANONEMAIL001", "ANONEMAIL002", "Tom V"]


def test_entries_of_any_script(spark, corpus):
    docs = corpus(["王芳 и 李, иван", "иванов", "李", "!?李"])
    entries = spark.createDataFrame([("李", "one"), ("王芳", "two"), ("иван", "four"), ("?!", "none")], "variant string, name string")
    hits = hit_rows(docs, entries, "name").collect()
    assert sorted((r.doc_id, r.raw_value) for r in hits if r.raw_value != "иван") == [(0, "李"), (0, "王芳"), (2, "李"), (3, "李")]


def test_candidates_of_other_scripts_stay_few(spark, corpus):
    """Candidates of a document don't grow with the dictionary."""
    alphabet = "абвгдежзийклмнопрст"
    word = lambda i: "".join(alphabet[(i // 19**k) % 19] for k in range(4)) + "ов"
    docs = corpus([" ".join(word(i * 37) for i in range(400))])
    found = []
    for n in (1000, 4000, 16000):
        entries = spark.createDataFrame([(word(i), "x") for i in range(n)], "variant string, name string")
        found.append(candidate_entries(docs, entries, "name").count())
    assert found[2] <= 3 * 400 and found[2] <= 450


def test_leaks_of_other_scripts(spark, corpus):
    docs = corpus(["здесь иванов!", "иван", "про иванова и 王芳李明"])
    registry = spark.createDataFrame(
        [("c", "иванов", "name", "T1"), ("c", "王芳李明", "name", "T2"), ("c", "петров", "name", "T3")],
        "case_id string, raw_value string, pii_type string, token string",
    )
    assert sorted((r.doc_id, r.raw_value) for r in leaks(docs, registry, "c").collect()) == [(0, "иванов"), (2, "иванов"), (2, "王芳李明")]


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    for name, text in {"a.txt": "1", "a/b.txt": "2", "k=v/c.txt": "mail x@example.org", "z.bin": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    paths = [r.path for r in read_corpus(spark, str(root)).orderBy("ord").collect()]
    assert paths == ["a/b.txt", "a.txt", "k=v/c.txt"]
    assert sorted(r.path for r in list_files(spark, str(root), recursive=False).collect()) == ["a.txt", "z.bin"]
    state, summary = anonymize_files(spark, str(root), str(tmp_path / "out"), empty_case(spark), "c")
    assert {r.path: (r.status, r.n_hits) for r in summary.collect()} == {
        "a.txt": ("processed", 0), "a/b.txt": ("processed", 0), "k=v/c.txt": ("processed", 1), "z.bin": ("unsupported", 0)
    }
    texts = {r.text for r in read_corpus(spark, str(tmp_path / "out")).collect()}
    assert texts == {"1", "2", "mail ANONEMAIL001"}
    _, again = anonymize_files(spark, str(root), str(tmp_path / "again"), state, "c")
    assert {r.status for r in again.collect()} == {"done before", "unsupported"}
    restore_files(spark, str(tmp_path / "out"), str(tmp_path / "back"), state, "c")
    assert (tmp_path / "back" / "k=v" / "c.txt").read_bytes() == b"mail x@example.org"


def _tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_files_of_any_name(spark, tmp_path):
    root = tmp_path / "in"
    files = {
        "x.txt": b"a@example.org", "empty.txt": b"", "sub/empty2.log": b"", "_notes.txt": b"b@example.org\n", "a/.hidden.txt": b"\n\n",
        ".d/_e/f.csv": "n,m\r\n\"x\ny\",c@example.org\r\n".encode(), "k=v/w%20 z#?.txt": b"tail ", "é/ü.md": "ö\n".encode(),
        "latin.txt": "caf\u00e9".encode("latin-1"), "none": b"1", "z.bin": b"\x00",
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "_SUCCESS").write_bytes(b"")
    (root / "loop").symlink_to(root)
    assert {r.path: r.length for r in list_files(spark, str(root)).collect()} == {n: len(d) for n, d in files.items()}
    docs = {r.path: r.text for r in read_corpus(spark, str(root)).collect()}
    assert docs == {n: d.decode("latin-1" if n == "latin.txt" else "utf-8") for n, d in files.items() if n not in ("none", "z.bin")}
    summary = anonymize_folder(spark, str(root), str(tmp_path / "out"), str(tmp_path / "case"), "c")
    assert {r.path for r in summary.collect()} == set(files)
    restore_folder(spark, str(tmp_path / "out"), str(tmp_path / "back"), str(tmp_path / "case"), "c")
    want = {n: d for n, d in files.items() if n not in ("none", "z.bin")} | {"latin.txt": "caf\u00e9".encode()}
    assert _tree(tmp_path / "back") == want
    assert b"@" not in b"".join(_tree(tmp_path / "out").values())


def test_a_failed_run_is_repeated(spark, tmp_path, monkeypatch):
    """Between writing the files and the state, and with another run in between."""
    root, out, case = tmp_path / "in", tmp_path / "out", tmp_path / "case"
    root.mkdir()
    for i in range(6):
        (root / f"{i}.txt").write_text(f"mail p{i % 4}@example.org")
    real = jobs.commit_state

    def broken(*args):
        raise OSError("lost")

    monkeypatch.setattr(jobs, "commit_state", broken)
    with pytest.raises(OSError, match="lost"):
        anonymize_folder(spark, str(root), str(out), str(case), "c")
    first = _tree(out)
    assert len(first) == 6 and load_state(spark, str(case))[0] == 0
    monkeypatch.setattr(jobs, "commit_state", real)
    summary = anonymize_folder(spark, str(root), str(out), str(case), "c")
    assert _tree(out) == first and {r.status for r in summary.collect()} == {"processed"}
    number, state = load_state(spark, str(case))
    assert number == 1 and state["registry"].count() == 4 and state["ledger"].count() == 6
    assert {r.status for r in anonymize_folder(spark, str(root), str(out), str(case), "c").collect()} == {"done before"}
    with pytest.raises(RuntimeError, match="another run"):
        commit_state(spark, str(case), state, 1)


def test_an_existing_file_is_never_replaced(spark, tmp_path):
    docs = spark.createDataFrame([("a/x.txt", "new"), ("b.txt", None)], "path string, text string")
    assert sorted((r.path, r.length) for r in write_files(docs, str(tmp_path / "o")).collect()) == [("a/x.txt", 3), ("b.txt", 0)]
    write_files(docs, str(tmp_path / "o"))
    other = spark.createDataFrame([("a/x.txt", "old")], "path string, text string")
    with pytest.raises(Exception, match="exists with other content"):
        write_files(other, str(tmp_path / "o"))
    with pytest.raises(Exception, match="not a path under"):
        write_files(spark.createDataFrame([("../x", "1")], "path string, text string"), str(tmp_path / "o"))
    assert sorted(_tree(tmp_path / "o")) == ["a/x.txt", "b.txt"]


def test_delimited_files(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n"",x\n"l1\nl2",\n,"say ""hi"""\n')
    assert [tuple(r) for r in read_table(spark, str(path)).collect()] == [(0, "", "x"), (1, "l1\nl2", ""), (2, "", 'say "hi"')]
    (tmp_path / "v.csv").write_text('1,"e\nf"\n2,g\n')
    assert [r.value for r in read_values(spark, str(tmp_path / "v.csv"), 1).orderBy("n").collect()] == ["e\nf", "g"]


@pytest.mark.parametrize("block,stray", [(1 << 20, False), (64, False), (7, False), (200, True)])
def test_delimited_blocks(spark, tmp_path, block, stray):
    """Blocks of a few bytes cut quoted cells, line breaks in cells and quotes in quotes anywhere."""
    rnd = random.Random(block)
    cells = ["", "x", "é ü", "a,b", "l1\nl2", "l1\r\nl2", 'say ""hi""'.replace('""', '"'), '"', "\n", ",", "end "]
    rows = [[rnd.choice(cells) for _ in range(3)] for _ in range(60)]
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator=rnd.choice(["\n", "\r\n"])).writerows([["a", "B", "b"], *rows])
    body = text.getvalue() + ("5\" pipe,x,y\n" if stray else "short\n,,,,long\n\nlast,row,no break")
    (tmp_path / "t.csv").write_bytes(body.encode())
    want = [r for r in csv.reader(io.StringIO(body, newline="")) if r][1:]
    got = read_delimited(spark, str(tmp_path / "t.csv"), ",", block).orderBy("row_id").collect()
    assert got[0].__fields__ == ["row_id", "a", "B1", "b2"]
    assert [r.row_id for r in got] == list(range(len(want)))
    assert [list(r)[1:] for r in got] == [(r + [""] * 3)[:3] for r in want]


def test_left_context_of_dense_matches(spark, corpus):
    docs = corpus(["".join(f"({i:03d}) 555-1234" for i in range(30))])
    spans = span_rows(docs, pick_rules(["phone"]), ["doc_id"]).orderBy("start").collect()
    text = docs.first().text
    assert len(spans) >= 30 and all(r.left_ctx == text[max(0, r.start - 50) : r.start] for r in spans)


def test_texts_of_a_bucketed_corpus_stay_in_place(spark, corpus, run):
    """With a bucketed corpus only the matchers move, also where they are too large to be broadcast."""
    write_bucketed_corpus(corpus(TEXTS), "bucketed_texts", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for job in (anonymize, deanonymize):
            out = job(spark.table("bucketed_texts"), run[2], "c")
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange ") == 1 and "Bucketed: true" in plan
            assert out.count() == len(TEXTS)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("drop table bucketed_texts")


def test_stages_are_removed(spark, tmp_path):
    staged = stage(spark.range(3), "some")
    assert staged.count() == 3
    clear_stages(spark)
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|PATH_NOT_FOUND"):
        staged.select("id").collect()


def test_stream_query_has_three_batches_whatever_the_splits(spark, tmp_path):
    """Each batch has fixed costs, so their number must not follow the files or splits of the table."""
    for pieces in (1, 7):
        rows = spark.range(300).selectExpr("id as doc_id", "concat('text ', id) as text").repartition(pieces)
        rows.write.parquet(f"{tmp_path}/{pieces}/documents.parquet")
        seen = []
        arriving = corpora._arrivals(spark, f"{tmp_path}/{pieces}")
        corpora._run(arriving.writeStream.foreachBatch(lambda b, n: seen.append([r[0] for r in b.select("ord").collect()])), spark)  # noqa: B023
        assert [sorted(x) for x in seen] == [list(range(i, 300, 3)) for i in range(3)]


def test_conversation_files_are_written_by_tasks(spark, tmp_path):
    rows = [(7, 2, "b"), (7, None, "a"), (7, 3, None), (-1, 1, "x\ny"), (None, 1, "z")]
    root = corpora.talk_files(spark, spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    root = Path(root)
    found = {p.parent.name: p.read_text() for p in root.rglob("*") if p.is_file()}
    assert found == {"conv_id=7": "a\nb\n\n", "conv_id=-1": "x\ny\n", "conv_id=__HIVE_DEFAULT_PARTITION__": "z\n"}
    assert not [p for p in root.iterdir() if p.is_file()]  # a job that the driver commits leaves a mark


def test_spans_meet_the_allowlist_after_one_detection(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(value):
        rows.add(1)
        return value

    spans = spark.range(40).select("id", F.udf(seen, "string")(F.concat(F.lit("v"), F.col("id") % 4)).alias("raw_value"))
    listed = spark.createDataFrame([("c", "V1", "ioc", "")], "case_id string, value string, value_type string, reason string")
    assert A.drop_allowed(spans.withColumn("pii_type", F.lit("name")), listed, "c").count() == 30
    assert rows.value == 40


def test_a_folder_is_listed_as_a_stream(tmp_path, monkeypatch):
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    (tmp_path / "gone").symlink_to(tmp_path / "nothing")
    assert sorted(files._entries(fs.LocalFileSystem(), str(tmp_path))) == [("a", 1, False), ("b", 1, False), ("gone", 0, False)]
    read = []
    scan = os.scandir

    @contextlib.contextmanager
    def counted(path):
        with scan(path) as found:
            yield (read.append(x) or x for x in found)

    monkeypatch.setattr(files.os, "scandir", counted)
    next(files._entries(fs.LocalFileSystem(), str(tmp_path)))
    assert len(read) == 1


def test_texts_leave_a_batch_one_by_one():
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(50)] + ["none"], "text": ["x" * 1_000_000] * 50 + [None]})
    tracemalloc.start()
    try:
        sizes = {path: len(data) for path, data in files._one_by_one(batch)}
        assert tracemalloc.get_traced_memory()[1] < 5_000_000
    finally:
        tracemalloc.stop()
    assert sizes.pop("none") == 0 and len(sizes) == 50 and set(sizes.values()) == {1_000_000}


def test_log_texts_are_dealt_by_rows(spark, monkeypatch):
    """The rows behind the log texts are few bytes, so neither files nor shuffles may set the number of tasks."""
    from veilwork.catalog.registry import corpus
    from veilwork.plans import spread

    monkeypatch.setattr(spread, "ROWS_PER_TASK", 100)
    texts = corpus(spark, "/root/testdata/sf0.001", "ev_log")
    assert texts.rdd.getNumPartitions() == 15
    assert texts.selectExpr("count(*) as n", "count(distinct doc_id) as d").first() == (1500, 1500)


def test_entries_are_cut_once(spark, capsys):
    """No filter below the keys of the entries cuts the texts again."""
    from veilwork.operators.dictionary import entry_anchors

    entries = spark.range(3).selectExpr("concat('a.b', id) as variant", "'x' as name")
    anchors = entry_anchors(entries, "name")
    assert {(r.core, r.k) for r in anchors.collect()} == {("a.b0", 2), ("a.b1", 2), ("a.b2", 2)}
    capsys.readouterr()
    anchors.explain()
    filters = [line for line in capsys.readouterr().out.splitlines() if "Filter" in line]
    assert filters and not any("split(" in line for line in filters)
