"""The pipeline against brute force, and its cases."""

import corpus_pipeline as pipeline
from test_dedup import classes, simhash_brute
from veilwork.llm import langid, mixing, queries, tiling

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.learn(docs)
    rows = {i: r for i, r in rows.items() if not model.predict([(r.text or "").encode()])[2][0]}
    last = {}
    for i, r in rows.items():
        last[r.text or ""] = max(i, last.get(r.text or "", -1))
    rows = {i: rows[i] for i in last.values()}
    ids = sorted(rows)
    groups = classes([simhash_brute(rows[i].text, 3) for i in ids], 3)
    rows = {ids[c]: rows[ids[c]] for c in set(groups)}
    items = tiling._Items(*zip(*[(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], strict=True))

    def leaks(text):
        words = tiling._words([text.encode()])
        flat = " ".join(words.raw.decode().split())
        h = words.hashes()
        return bool(flat) and any(True for _ in items.hits(h, tiling.Rolling(h), words.first, 0.8))

    rows = {i: r for i, r in rows.items() if not leaks(r.text or "")}
    left = spark.createDataFrame(list(rows.values()), docs.schema)
    mixed = mixing.mix(left, queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_MOST).where("taken > 0")
    want = {r.id: r.taken for r in mixed.collect()}
    got = pipeline.run(spark, SF)
    assert got.columns[:5] == COLUMNS
    assert {r.doc_id: r.taken for r in got.collect()} == want
    assert all(r.copies * r.size == r.taken for r in got.collect())


def test_planted_cases(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("length(text) > 1500").orderBy("doc_id").first()
    near = clean.text.split(" ")
    near[len(near) // 2] = "changed"
    extra = [
        (90_001, clean.text, clean.lang, "s", 1), (90_002, " ".join(near), clean.lang, "s", 1), (90_003, "start " + bench.upper() + " end", "en", "s", 1),
        (90_004, None, "en", None, None), (90_005, "... 12", "en", "s", 1), (90_001, clean.text, clean.lang, "s", 1),
    ]
    own = docs.unionByName(spark.createDataFrame(extra, docs.schema)).selectExpr("*", "1 as size", "'x' as tag")
    kept = own
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == own.columns, name
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and not {90_003, 90_004, 90_005} & set(ids)
    assert len({clean.doc_id, 90_001, 90_002} & set(ids)) == 1
    assert pipeline.STAGES[-1][1](spark, kept, SF).where("taken > 0 and copies > 0").count() > 50


def test_mix_of_repeated_and_null_ids(spark):
    rows = [(i, f"{'word ' * (5 + i % 40)}{i}", "en", "t" if i % 3 else "s", i) for i in range(300)]
    rows += [(None, f"{'null ' * (5 + i % 40)}{i}", "en", None if i % 2 else "s", i) for i in range(60)]
    rows += [(7, f"{'same ' * (5 + i % 40)}{i}", "en", "s" if i % 2 else "t", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = mixing.mix(docs, queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_MOST).where("taken > 0").collect()
    got = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(got) == len({(r.doc_id, r.text) for r in got})
    assert sorted((r.doc_id or -1, r.size, r.target, r.taken) for r in got) == sorted((r.id or -1, r.size, r.target, r.taken) for r in want)
    assert all(r.size == len(r.text.split()) and r.copies * r.size == r.taken for r in got)
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got} <= set(rows)
    # equal rows are one document with the copies of all
    twice = pipeline.STAGES[-1][1](spark, docs.unionByName(docs), SF).collect()
    again = mixing.mix(docs.unionByName(docs), queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_MOST).collect()
    assert len(twice) == len({(r.doc_id, r.text) for r in twice})
    assert sum(r.taken for r in twice) == sum(r.taken for r in again)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
