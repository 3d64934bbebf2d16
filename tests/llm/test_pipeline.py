"""Each stage of the corpus pipeline on its predecessor's rows."""

from __future__ import annotations

import re

import corpus_pipeline as P

from . import brute

SF = "/root/testdata/sf0.001"


def test_near_copies_go_at_five_words_and_80_percent(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = " ".join(f"word{k}" for k in range(100))
    more = [(7001, text), (7002, text + " " + " ".join(f"new{k}" for k in range(15))),
            (7003, text.replace("word50", "edit")), (7004, text.replace("word2", "edit"))]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in more], docs.schema))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {i for i, _, c in brute.similar_groups(rows, 5, 80) if i == c}
    assert 7002 not in want and 7002 in {i for i, _, c in brute.similar_groups(rows) if i == c}
    assert {r.doc_id for r in P.keep_one_of_similar(spark, docs, SF).collect()} == want


def test_the_mix_can_be_rebuilt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "no id here", "en", "s", 10)],
                                                                              docs.schema))
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = P.mix_sources(spark, docs, SF).collect()
    assert len(out) == sum(r.taken > 0 for r in P.mix(docs).collect())
    for r in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        spans = [tuple(map(int, s.split("-"))) for s in r.spans.split(",") if s]
        assert (r.doc_id, r.text) in given and len(words) == r.size
        assert r.taken == r.passes * r.size + sum(len(words[a:b]) for a, b in spans)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(5001, "12 34", "en", "s", 5), (5002, None, None, "s", 0), (5003, docs.first().text, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(name)
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert set(after) == {i for i, t in before if t and re.search(r"[^\W\d_]", t)}
        if name == "line_dedup":
            gone = brute.repeated_lines(before)
            kept = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t]) for i, t in before}
            assert after == {i: t for i, t in kept.items() if t.strip(" \t\n\r\f\v")}
        if name == "ngram_join":
            assert set(after) == {i for i, _, c in brute.similar_groups(before) if i == c}
        if name == "decontamination":
            assert set(after) == {i for i, _, hit, _ in brute.contaminated(before, items) if not hit}
        if name == "mixing":
            out = docs.collect()
            assert {r.doc_id for r in out} <= {i for i, _ in before} and all(0 < r.taken <= 2 * r.size for r in out)
    assert seen == [n for n, _ in P.STAGES]
