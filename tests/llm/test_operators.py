"""Every operator against brute force on the smallest documents and hard rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hireflow.llm import queries as Q
from hireflow.llm.collection_bwt import repeated, sorted_suffixes
from hireflow.llm.decontaminate import decontaminate
from hireflow.llm.exact_dedup import exact_dedup
from hireflow.llm.language_id import language_id
from hireflow.llm.line_dedup import line_dedup
from hireflow.llm.mixing import mix
from hireflow.llm.ngram_join import boundary, ngram_join
from hireflow.llm.substring_dedup import _pieces, substring_dedup
from hireflow.llm.textkit import Texts
from hireflow.llm.unit_dedup import unit_dedup
from hireflow.llm.url_filter import rules_frame, url_filter
from hireflow.plans.compare import compare, duck

from . import brute

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau ypsilon".split()


def _hard_rows():
    rng = random.Random(7)
    base = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60))
    near = [" ".join(w if rng.random() > 0.02 else "edit" for w in base.split()) for _ in range(25)]
    return [
        (900_000, None), (900_001, ""), (900_002, " \n\t "), (900_003, "One"), (900_004, "one"),
        (900_005, "a" * 400), (900_006, "b" + "a" * 300), (900_007, "a" * 49), (900_008, "ab" * 200),
        (900_009, "x\n" + base + "\ny"), (900_010, "é" * 60), (900_010, "another text under one id"),
        (None, base), (None, None), (900_011, "long " * 5000), (900_011, "long " * 5000),
        *[(900_100 + k, t) for k, t in enumerate(near)], *[(900_200 + k, base) for k in range(40)],
    ]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents, hard rows, and columns whose names clash with those inside the operators."""
    hard = spark.createDataFrame(_hard_rows(), "doc_id long, text string")
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(hard)
    return base.select("doc_id", "text", *[F.lit("clash").alias(c) for c in (
        "place", "tag", "key", "row", "size", "node", "lang_pred", "words", "start", "found")],
        F.lit("en").alias("lang"), (F.col("doc_id") % 3).cast("string").alias("source")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def _got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_collection_bwt_sorts_suffixes_and_finds_repeats():
    rng = random.Random(3)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 8))]
        owner = np.array([rng.randint(0, 4) for _ in strings])
        string, offset, lcp = sorted_suffixes(strings, 5)
        suffixes = [strings[a][b:] for a, b in zip(string, offset, strict=True)]
        assert suffixes == sorted(suffixes) and len(suffixes) == sum(len(s) + 1 for s in strings)
        for i in range(1, len(suffixes)):
            n = 0
            while n < min(len(suffixes[i]), len(suffixes[i - 1]), 5) and suffixes[i][n] == suffixes[i - 1][n]:
                n += 1
            assert lcp[i] == n
        want = {(a, i) for a, s in enumerate(strings) for i in range(len(s) - 4)
                if any(owner[b] < owner[a] and s[i:i + 5] in t for b, t in enumerate(strings))}
        assert {(a, i + j) for a, i, n in repeated(strings, owner, 5) for j in range(n)} == want


def test_decontamination(spark, docs, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(9001, "One"), (9002, None), (9003, ""), (9004, "long long"), (9001, "One"), (None, "another text")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    got = decontaminate(docs, bench).withColumn("items", F.array_sort("items"))
    assert [(a, b, c, tuple(d)) for a, b, c, d in _got(got, "doc_id", "n_words", "n_hit", "items")] \
        == brute.contaminated(rows, items)


def test_substring_dedup(docs, rows):
    got = _got(substring_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.substrings(rows)


def test_substring_dedup_tells_pieces_apart_whose_hashes_share_32_bits(spark):
    # Two pieces of 76 bytes around one anchor; the low halves of their content hashes agree.
    texts = ["udahuahfoetqimizlcgxwrmgrgmuooxxqqnhkrfmbxsiwvffogmgoippuydwqgamzpzdegjwvsvn",
             "zkpylnsulvanhodchjywowjgvfmuooxxqqnhkrfmbxsiwvffogcgkrtcvmclidjfnymlqksrlrkt"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    _, _, _, anchor, content, check = _pieces(Texts(data, np.array([0, 76]), np.array([76, 152])), 50)
    assert anchor[0] == anchor[1] and content.astype(np.uint32)[0] == content.astype(np.uint32)[1]
    assert content[0] != content[1] and check[0] != check[1]
    rows = list(enumerate(texts))
    got = _got(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")),
               "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.substrings(rows) and got[1][2] == 0


def test_mixing(docs, rows):
    out = [r.asDict() for r in mix(docs, carry=("source",)).select("*", F.col("row.source").alias("source")).collect()]
    total = sum(r["size"] for r in out)
    targets = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert all(0 <= x["first"] < x["stop"] <= r["size"] for x in r["spans"] or [])
        targets[r["source"]] = (r["target"], r["source_size"])
        spans = sum(s["stop"] - s["first"] for s in r["spans"] or [])
        assert r["taken"] == r["passes"] * r["size"] + spans
    # water filling by hand
    names = sorted(targets, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, want = 1.5 * total, set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate > 2 * targets[s][1]}
        for s in over or open_:
            want[s] = min(2 * targets[s][1], weight[s] * rate)
        left -= sum(want[s] for s in over)
        open_ = open_ - over if over else set()
    for s in names:
        assert targets[s][0] == pytest.approx(want[s])
        taken = sum(r["taken"] for r in out if r["source"] == s)
        assert abs(taken - want[s]) <= 64 + 0.01 * want[s]
    again = _got(mix(docs), "doc_id", "size", "taken")
    assert again == sorted(((r["doc_id"], r["size"], r["taken"]) for r in out), key=str)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(90, None, None, "s", 0), (91, "12 34!", "en", "s", 0), (None, "the and", None, "s", 0)],
                                  docs.schema)
    got = language_id(docs.unionByName(extra)).select("doc_id", "held_out", "lang_pred", "score", "row.lang",
                                                      "row.text").collect()
    held = [r for r in got if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.text in (None, "12 34!")} == {"und"}
    assert not next(r for r in got if r.doc_id is None).held_out


def test_unit_dedup(spark, docs, rows):
    mine = spark.createDataFrame([(1, "Start here.\nA line of words. End."), (2, "Other\n a LINE of  words. end.\nMore."),
                                  (3, "Short. Von."), (4, "Short.\nVon."), (5, None), (None, "short. von.")],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in unit_dedup(mine).collect()}
    assert got[1].n_removed == 0 and (got[2].removed, got[2].kept_text) == ("7-29", "Other\n \nMore.")
    assert got[3].n_removed == got[4].n_removed == 0 and got[5].kept_text is None
    assert got[None].kept_text == ""
    out = unit_dedup(docs).collect()
    texts = {(i, t) for i, t in rows}
    assert len(out) == len(rows)
    for r in out:
        spans = [tuple(map(int, s.split("-"))) for s in r.removed.split(",") if s]
        data = next(t for i, t in texts if i == r.doc_id and (t is None) == (r.kept_text is None)
                    and len((t or "").encode()) == r.n_bytes) or ""
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + data.encode()[at:a], b
        assert hashlib.sha256(kept + data.encode()[at:]).hexdigest() == r.kept_sha256


def test_number_signs_are_no_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    signs = spark.createDataFrame([(95, "\u00bd \u00b2 \u2460", None, "s", 5), (96, "\u00bd x", None, "s", 3)], docs.schema)
    got = {r.doc_id: r for r in language_id(docs.unionByName(signs)).filter("row.lang is null").collect()}
    assert (got[95].lang_pred, got[95].score) == ("und", 0.0) and got[96].lang_pred != "und"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_unit_dedup_query_removes_every_later_line(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    want = brute.repeated_units([tuple(r) for r in docs.collect()])
    got = {r.doc_id: r.removed for r in Q.queries()["op6_unit_dedup"](spark, f"/root/testdata/{sf}").collect()}
    assert got == {i: ",".join(f"{a}-{b}" for a, b in spans) for (i, _), spans in want.items()}


@pytest.mark.parametrize("unit", ["line", "paragraph", "sentence"])
def test_unit_dedup_by_each_unit(spark, unit):
    rows = [(1, "All rights reserved.\nOne text. Short.\n \nA b\nc d"), (2, "Other words\n  ALL rights  reserved.\n\nOne text.\nmore"),
            (3, "Short. One text. And new.\nShort. One text.\n\nA B\n C d\n\nx"), (4, "x One text.\nOne text. Short. y"),
            (5, ""), (6, " \n\n "), (7, "x\n\nx\n\nx " + "word " * 50_000), (8, "x " + "word " * 50_000)]
    want = brute.repeated_units(rows, unit)
    got = {r.doc_id: r.removed for r in
           unit_dedup(spark.createDataFrame(rows, "doc_id long, text string"), unit).collect()}
    assert got == {i: ",".join(f"{a}-{b}" for a, b in s) for (i, _), s in want.items()}


def test_unit_dedup_of_ids_that_are_no_numbers(spark):
    rows = [("a", "same line"), ("b", "same line"), ("7", "same line"), (None, "same line"), (None, "same line")]
    out = unit_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.kept_text) for r in out) == [
        ("", ""), ("", ""), ("7", "same line"), ("a", ""), ("b", "")]


def test_line_dedup(docs, rows):
    # Two texts under one id are ordered by a hash that brute force does not know.
    plain = docs.filter("not (doc_id <=> 900010)")
    want = brute.repeated_lines([r for r in rows if r[0] != 900_010])
    got = {}
    for r in line_dedup(plain).join(plain.select("doc_id", "text").distinct(), "doc_id").collect():
        got.setdefault(r.doc_id, []).append(list(r.removed))
    for (i, _), gone in want.items():
        if i is not None:
            assert gone in got[i]


def test_exact_dedup(spark, docs, rows):
    for keep, best in (("largest", max), ("smallest", min)):
        got = _got(exact_dedup(docs, keep=keep), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        groups = {}
        for i, t in rows:
            groups.setdefault(t or "", []).append(i)
        left = {t: best([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
        assert sorted((str(r[0]) for r in got)) == sorted(str(i) for i, _ in rows)
        assert sum(r[3] for r in got) == len(groups)
        for i, keep_id, n, kept, sha in got:
            t = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == sha)
            assert (keep_id, n) == (left[t], len(groups[t])) and (not kept or i == keep_id)


def test_ngram_join(docs, rows):
    assert _got(ngram_join(docs), "doc_id", "n_shingles", "component_id") == brute.similar_groups(rows)


def test_boundary_of_small_and_large_sets():
    histogram = {s: 100 for s in range(1, 200)}
    assert boundary({}, 1.0, 90) == 0
    assert 9 < boundary(histogram, 1.0, 90) < boundary(histogram, 50.0, 90)


def test_url_filter_hard_urls(spark):
    urls = [None, "", "no-scheme.net/x", "http://net", "http://net/", "HTTP://A.NET/EN/", "http://a.example.net/en/x?y#z",
            "http://example.net/en", "x://Example.COM/de/", "x://badexample.com/de/", "x://a.org/fr/?q", "x://a.org?/fr/",
            "http://a.b://c.net/", "http://" + "a." * 3000 + "net/" + "b/" * 3000, "http://net:80/", "http:///net/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(None, "http://x.net/")] * 2,
                                  "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter(pages, rules_frame(spark)).collect()}
    rule = {4: "net/", 5: "net/", 6: "example.net/en/", 7: "net/", 8: "example.com/de/", 10: "org/fr/", 13: "net/",
            None: "net/"}
    for k in [*range(len(urls)), None]:
        assert got[k][0] == rule.get(k), (k, got[k])
        assert got[k][1] == ("block" if rule.get(k) in ("net/", "example.com/de/") else "allow")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    found = compare(Q.queries()[name](spark, SF), Q.oracle_sql()[name], duck(SF))
    assert found["ok"], found


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    one = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    for out in (decontaminate(docs, bench), substring_dedup(docs), mix(docs), language_id(docs), unit_dedup(docs),
                line_dedup(docs), exact_dedup(docs), ngram_join(docs), url_filter(pages, rules_frame(spark))):
        assert out.count() == 0
    assert decontaminate(one, bench).first().contaminated is False


def test_chat_format(spark):
    from hireflow.llm import chat_format as C
    raw = C.as_transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    held = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2
    model = C.fit(raw.filter(~held))
    want = {(r.conv_id, r.part): r.role for r in raw.filter(held).collect()}
    got = {(r.conv_id, r.turn_no): r for r in C.parse_transcripts(raw.filter(held), model).collect()}
    assert sum(k in got and got[k].role == v for k, v in want.items()) >= 0.93 * len(want)
    assert all(r.rendered == f"<|im_start|>{r.role}\n{r.text}<|im_end|>" for r in got.values())
    # Blocks give the path of a single pass, whatever their size.
    long = raw.filter("conv_id < 40").withColumn("part", F.col("conv_id") * 10 + F.col("part")).withColumn(
        "conv_id", F.lit(1))
    runs = []
    for size in (7, 100_000):
        C.BLOCK, before = size, C.BLOCK
        runs.append(_got(C.parse_transcripts(long, model), "turn_no", "role", "text"))
        C.BLOCK = before
    assert runs[0] == runs[1] and len(runs[0]) > 100
    hard = spark.createDataFrame([(1, 0, None), (2, 0, ""), (3, 0, "\n \n"), (None, 0, "User: x"), (4, None, "User: x"),
                                  (5, 0, "User: hi"), (5, 0, "User: hi"), (6, 0, "word " * 20000)],
                                 "conv_id long, part long, text string").withColumn("role", F.lit("clash"))
    out = C.parse_transcripts(hard, model).collect()
    assert {r.conv_id for r in out} == {5, 6} and sum(r.n_lines for r in out if r.conv_id == 5) == 2
    assert C.parse_transcripts(hard.limit(0), model).count() == 0
