"""Operators on small tables whose results can be worked out by hand."""

from __future__ import annotations

import difflib
import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import grounding, register, stats
from corpusmill.functions import text as X
from corpusmill.functions import vectors as V
from corpusmill.operators import corpus, geometry, gold, judging, layout, prompts, ranking, reports, topics
from corpusmill.sources import readers, store
from corpusmill.streaming import ingest


def value(df):
    return df.first()[0]


# vectors and geometry


def test_unit_floor_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(V.unit(F.col("a")).alias("a"), V.unit(F.col("z")).alias("z"), V.cosine(F.col("a"), F.col("a")).alias("c")).first()
    assert r.a == pytest.approx([0.6, 0.8]) and r.z == [0.0, 0.0] and r.c == pytest.approx(1)


def test_pack_round_trip(spark):
    df = spark.createDataFrame([([1.5, -2.25],), (None,)], "v array<float>")
    assert [r.v for r in df.select(V.unpack(V.pack("v")).alias("v")).collect()] == [[1.5, -2.25], None]


@pytest.fixture(scope="module")
def corpus_vectors(spark):
    rng = np.random.default_rng(0)
    rows, vectors = [], {}
    for p in range(8):
        for method, n in (("full", 1), ("chunk", 3)):
            for i in range(n):
                v = rng.normal(size=6)
                vectors[p, method, i] = v
                rows.append((p % 3, f"p{p}", method, i, v.tolist()))
    poles = {c: {s: rng.normal(size=6) for s in ("pos", "neg")} for c in ("two_worlds", "adaptors", "arbitrariness")}
    docs = spark.createDataFrame(rows, "code_number int, pdf_path string, method string, chunk_idx int, vec array<double>")
    pole_rows = [(c, s, v.tolist()) for c, p in poles.items() for s, v in p.items()]
    return docs, spark.createDataFrame(pole_rows, "criterion string, pole string, vec array<double>"), vectors, poles


@pytest.mark.parametrize(("k", "strength"), [(0, 0.0), (0, 0.5), (2, 1.0)])
def test_geometry_like_numpy(corpus_vectors, k, strength):
    docs, pole_df, vectors, poles = corpus_vectors
    reps = np.array([vectors[p, "full", 0] for p in range(8)])
    mu = reps.mean(axis=0)
    basis = np.linalg.svd(reps - mu, full_matrices=False)[2][:k]
    l2 = geometry.l2
    raw = {c: l2(l2(p["pos"] - mu) - l2(p["neg"] - mu)) for c, p in poles.items()}
    shared = np.linalg.svd(np.stack(list(raw.values())), full_matrices=False)[2][0]
    axes = {c: l2(a - strength * (a @ shared) * shared) for c, a in raw.items()}
    project = lambda v: l2((v - mu) - ((v - mu) @ basis.T) @ basis)
    fitted = geometry.fit(docs, pole_df, k, strength)
    got = {(r.pdf_path, r.method, r.criterion): r.e for r in geometry.recompute(docs, fitted).collect()}
    for p in range(8):
        for method, n in (("full", 1), ("chunk", 3)):
            for c in poles:
                assert got[f"p{p}", method, c] == pytest.approx(max(project(vectors[p, method, i]) @ axes[c] for i in range(n)), abs=1e-9)


def test_sweep_is_recompute_in_each_cell(corpus_vectors):
    docs, pole_df, *_ = corpus_vectors
    swept = geometry.sweep(docs, pole_df, [0, 2], [0.0, 1.0]).where("k = 2 and strength = 1.0")
    want = {(r.pdf_path, r.method, r.criterion): r.e for r in geometry.recompute(docs, geometry.fit(docs, pole_df, 2, 1.0)).collect()}
    got = {(r.pdf_path, r.method, r.criterion): r.e for r in swept.collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_paper_vectors_fall_back(spark):
    df = spark.createDataFrame([(1, "a", "full", 0, [1.0]), (1, "a", "chunk", 0, [2.0]), (1, "b", "full", 0, [3.0]), (1, "c", "abstract", 0, [4.0])], "code_number int, pdf_path string, method string, chunk_idx int, vec array<double>")
    assert {r.pdf_path: r.vec for r in geometry.paper_vectors(df).collect()} == {"a": [2.0], "b": [3.0], "c": [4.0]}
    assert {r.pdf_path: r.vec for r in geometry.representatives(df).collect()} == {"a": [1.0], "b": [3.0], "c": [4.0]}
    with pytest.raises(ValueError):
        geometry.unit_mean(df.limit(0), ["pdf_path"])


def test_topic_ties(spark):
    rows = [("p", 0, 5, 0.9), ("p", 1, 2, 0.9), ("p", 2, 2, 0.1), ("q", 0, 7, 0.3)]
    df = spark.createDataFrame(rows, "pdf_path string, chunk_idx int, topic_id int, similarity double")
    assert {r.pdf_path: r.topic_id for r in topics.dominant(df, ["pdf_path"]).collect()} == {"p": 5, "q": 7}
    labels = spark.createDataFrame([(5, "five")], "topic_id int, label string")
    assert {r.pdf_path: r.topics for r in topics.paper_topics(df, labels, ["pdf_path"]).collect()}["p"] == ["five", "topic 2"]
    two = [(1, np.array([1.0, 0.0])), (2, np.array([1.0, 0.0]))]
    assert value(spark.createDataFrame([([1.0, 0.0],)], "v array<double>").select(topics.nearest(F.col("v"), two)["topic_id"])) == 1


# statistics


def test_rank_statistics(spark):
    rows = [("a", 1.0, True, 1.0), ("a", 1.0, False, 2.0), ("a", 2.0, True, 2.0), ("a", 3.0, True, 4.0), ("b", 1.0, True, 1.0), ("c", 5.0, True, 1.0), ("c", 5.0, False, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, p boolean, y double")
    assert {r.g: r.auc for r in stats.auc(df, "x", "p", ["g"]).collect()} == {"a": pytest.approx(2.5 / 3), "b": None, "c": 0.5}
    rho = {r.g: r.rho for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    assert rho["a"] == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4])[0, 1]) and rho["b"] is None and rho["c"] is None


@pytest.mark.parametrize(("values", "weights", "want"), [([1, 2, 3, 4], [1, 1, 1, 1], 2.5), ([1, 2, 3], [1, 1, 1], 2), ([1, 10], [1, 5], 10), ([5], [2], 5), ([1, 1, 9], [1, 1, 2], 5)])
def test_weighted_median(spark, values, weights, want):
    df = spark.createDataFrame([("g", float(v), float(w)) for v, w in zip(values, weights, strict=True)], "g string, v double, w double")
    assert stats.weighted_median(df, "v", "w", ["g"]).first().weighted_median == want


def test_row_aggregates_and_levels(spark):
    df = spark.createDataFrame([([3.0, None, 1.0],), ([None],)], "v array<double>")
    assert [tuple(r) for r in df.select(*[stats.row_aggregate(F.col("v"), m) for m in ("mean", "median", "min")]).collect()] == [(2.0, 2.0, 1.0), (None, None, None)]
    with pytest.raises(ValueError):
        stats.row_aggregate(F.col("v"), "mode")
    levels = spark.createDataFrame([(-0.75,), (0.24,), (9.0,)], "x double").select(stats.nearest_level(F.col("x")).alias("l"))
    assert [r.l for r in levels.collect()] == [-1.0, 0.0, 1.0]


def test_confusion_without_positives(spark):
    r = stats.confusion(spark.createDataFrame([("g", False, False)], "g string, p boolean, a boolean"), "p", "a", ["g"]).first()
    assert (r.tn, r.precision, r.recall, r.f1) == (1, None, None, None)


def test_best_cell_takes_the_first(spark):
    df = spark.createDataFrame([("c", 0, 0.5), ("c", 1, 0.7), ("c", 2, 0.7), ("d", 0, None)], "criterion string, cell int, rho double")
    assert [(r.criterion, r.cell, r.rho) for r in stats.best_cell(df, ["criterion"], "rho", "cell").collect()] == [("c", 1, 0.7)]


# text


@pytest.mark.parametrize(("url", "doi"), [("https://doi.org/10.1000/ab.c).", "10.1000/ab.c"), ("http://x.org/10.12345/q?y=1", "10.12345/q"), ("http://x.org", None), (None, None)])
def test_doi(spark, url, doi):
    assert value(spark.createDataFrame([(url,)], "u string").select(X.doi(F.col("u")))) == doi


def test_paths(spark):
    df = spark.createDataFrame([("https://a.b/c d?e=ü_",), ("https://doi.org/10.1000/a/b",)], "u string")
    assert [r[0] for r in df.select(X.output_path(F.col("u"), "pdfs/")).collect()] == ["pdfs/a.b_c_d_e.pdf", "pdfs/10.1000_a_b.pdf"]


def test_citation_link(spark):
    html = '<META content="/x.pdf" name="citation_pdf_url"><meta name="citation_pdf_url" content="y">'
    df = spark.createDataFrame([(html, "http://h/a/b"), ("<p>", None)], "h string, b string").withColumn("l", X.nullif_blank(X.citation_link(F.col("h"))))
    assert [r[0] for r in df.select(X.resolved(F.col("l"), F.col("b"))).collect()] == ["http://h/x.pdf", None]


def test_sections(spark):
    text = "Title\nby me\n1. Introduction:\nhello\nMETHODS\nm\nIntroduction\nagain\nReferences\nr"
    df = spark.createDataFrame([("d", text), ("e", "only text"), ("f", "")], "k string, t string")
    got = {(r.k, r.section): r.body for r in X.sections(df, "k", "t").collect()}
    assert got["d", "_preamble"] == "Title\nby me" and got["d", "introduction"] == "1. Introduction:\nhello\nIntroduction\nagain" and got["d", "references"] == "References\nr"
    assert got["e", "_preamble"] == "only text" and got["f", "_preamble"] == ""
    assert {r.k: r.abstract for r in X.abstracts(df, "k", "t", 5).collect()} == {"d": "Title", "e": "only ", "f": ""}


def test_budget(spark):
    text = "P" * 20 + "\nIntroduction\n" + "i" * 200 + "\nResults\n" + "r" * 30 + "\nReferences\n" + "x" * 500
    df = spark.createDataFrame([("d", text), ("s", "short")], "k string, t string")
    got = {r.k: r.t for r in X.within_budget(df, "k", "t", 30).collect()}
    assert got["d"] == "P" * 20 + "\nResults\n" + "r" * 30 and got["s"] == "short"
    assert {r.k: r.t for r in X.within_budget(df, "k", "t", 2).collect()}["d"] == text[:7]


@pytest.mark.parametrize(("n", "want"), [(0, []), (5, [(0, 5)]), (10, [(0, 10)]), (11, [(0, 10), (6, 11)]), (16, [(0, 10), (6, 16)]), (17, [(0, 10), (6, 16), (12, 17)])])
def test_token_windows(spark, n, want):
    df = spark.createDataFrame([([str(i) for i in range(n)],)], "w array<string>")
    assert value(df.select(X.token_windows(F.col("w"), 10, 4))) == [[str(i) for i in range(a, b)] for a, b in want]


def test_windows_make_their_tokens_once(spark):
    tokens = F.shuffle(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: i.cast("string")))
    windows = value(spark.range(1).select(X.token_windows(tokens, 10, 5)))
    assert len(windows) == 19 and all(a[5:] == b[:5] for a, b in zip(windows, windows[1:], strict=False))
    assert sorted(int(t) for t in windows[0] + [t for w in windows[1:] for t in w[5:]]) == list(range(100))
    assert value(spark.range(1).select(X.token_windows(F.lit(None).cast("array<string>"), 10, 5))) == []


def test_prose_windows(spark):
    df = spark.createDataFrame([("abcdefghij",), ("  ",), ("abc",)], "t string")
    assert [r[0] for r in df.select(X.prose_windows(F.col("t"), 6, 2)).collect()] == [["abcdef", "efghij"], [], ["abc"]]


def test_signatures_and_entries(spark):
    refs = "Orr SM, Quill (2005) One\nwrapped 1999 line\nVelt, H.-J. (2000) Two\nno entry"
    df = spark.createDataFrame([("d", refs)], "k string, t string")
    rows = X.reference_entries(df, "k", "t").orderBy("entry_no").select("entry", X.signature(F.col("entry")).alias("s")).collect()
    assert [(r.s.surname, r.s.year) for r in rows] == [("orr", "2005"), ("velt", "2000")] and rows[0].entry.endswith("wrapped 1999 line")
    assert value(spark.createDataFrame([("nobody",)], "t string").select(X.signature(F.col("t")))) is None


def test_open_urls(spark):
    kind = "b struct<url_for_pdf:string,url:string>, o array<struct<url_for_pdf:string,url:string>>"
    df = spark.createDataFrame([(("p1", "u1"), [("p2", "u1"), (None, "u3")]), (None, None)], kind)
    assert [r[0] for r in df.select(X.open_urls(F.col("b"), F.col("o"))).collect()] == [["p1", "p2", "u1", "u3"], []]


# grounding and judging

PASSAGE = "The genetic code maps codons to amino acids; it uses transla-\ntion adaptors and “arbitrary” rules – by conven­tion. Oﬃcial text."


@pytest.mark.parametrize(("quote", "good"), [
    ("maps codons to amino acids", True), ("translation adaptors and \"arbitrary\" rules", True), ("official text", True), ("The genetic code maps codons … uses translation adaptors", True),
    ("nucleotides are translated by universal convention into proteins", False), ("", False), (None, False), ("code", True),
])
def test_grounding(spark, quote, good):
    df = spark.createDataFrame([(quote, PASSAGE)], "q string, p string").withColumn("m", grounding.quote_coverage(F.col("q"), F.col("p")))
    assert value(df.select(grounding.grounded(F.col("m")))) is good


def test_coverage_is_that_of_difflib():
    q, p = grounding.fold_marks("codons map to the amino acid rules"), grounding.fold_marks(PASSAGE)
    sizes = [b.size for b in difflib.SequenceMatcher(None, q, p, autojunk=False).get_matching_blocks()]
    assert grounding.coverage("codons map to the amino acid rules", PASSAGE) == (sum(sizes) / len(q), max(sizes))


def test_gates(spark):
    rows = [(1.0, "made up out of nothing at all", "met"), (0.5, "maps codons to amino acids", "met"), (-1.0, "", "not_met")]
    df = spark.createDataFrame([(*r, PASSAGE) for r in rows], "agreement double, evidence_quote string, verdict string, passage string")
    got = grounding.gate_graded(df).collect()
    assert [(r.agreement, r.raw_agreement, r.grounding_failed) for r in got] == [(0.0, 1.0, True), (0.5, 0.5, False), (-1.0, -1.0, False)]
    assert [(r.verdict, r.grounding_failed) for r in grounding.gate_verdicts(df).collect()] == [("unclear", True), ("met", False), ("not_met", False)]
    cells = grounding.classify_cells(df.withColumn("model", F.lit("m")))
    tally = {r.model: (r.cells, r.strict, r.fuzzy) for r in grounding.gate_cost(cells, ["model"]).collect()}
    assert tally == {"m": (3, 1, 1), None: (3, 1, 1)}


def test_blocks_are_those_of_difflib():
    rng = np.random.default_rng(3)
    for n in range(400):
        q, p = ("".join(rng.choice(list("abcde"[: 2 + n % 4]), size=int(rng.integers(0, k)))) for k in (30, 80))
        want = difflib.SequenceMatcher(None, q, p, autojunk=False).get_matching_blocks()
        assert sorted(grounding.block_sizes(q, p)) == sorted(b.size for b in want if b.size)


def test_quote_queries_by_brute_force(spark, tmp_path):
    from corpusmill.plans import registry

    long = "the genetic code maps every codon to one amino acid and uses adaptors for it"
    quotes = [long, "a code", "Short-ish quote", "", None, "-", "one two three four five six", "nothing of this is anywhere in them"]
    near = long.replace("every codon", "each codon").replace("amino", "Amino")
    texts = [None, "", "x " + long.upper() + " y", near, long[:30] + " zz " + long[34:], "here: a code.", "A  CODE", "short-\nish “quote” and Shortish quote", "one two three four five six", "a - b", "the genetic code maps nothing else at all", long]
    docs = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, texts[2])]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pairs, tally, held = [], {}, []
    for d, t in docs:
        for i, q in enumerate(quotes):
            length = len(grounding.fold_marks(q or ""))
            share, longest = grounding.coverage(q, t)
            can = length > 0 and longest >= min(15, length)
            if can:
                pairs.append((d, i, round(share, 5), longest, share >= 0.85))
            strict = bool(t is not None and q and grounding.fold_spaces(q) and grounding.fold_spaces(q) in grounding.fold_spaces(t))
            fuzzy = can and share >= 0.85
            if t is not None and q is not None and q in t:
                held.append((d, i))
            for model in (None if d is None else str(d % 3), "all"):
                tally.setdefault(model, np.zeros(5, int))
                tally[model] += [1, strict, fuzzy, fuzzy and not strict, t is None]
    run = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(run("quote_grounding")) == order(pairs)
    assert order(run("quote_containment")) == order(held)
    assert order(run("gate_cost_tally")) == order([(None if m in (None, "all") else m, *map(int, n)) for m, n in tally.items()])


def test_parse_verdicts(spark):
    good = json.dumps({"a": {"verdict": "MET", "confidence": 0.5, "evidence_quote": "q"}, "b": {"verdict": "unclear"}})
    rows = [(1, good), (2, f"so:\n```json\n{good}\n```\nbye"), (3, "no object"), (4, '{"a": {"verdict": "maybe"}}'), (5, "{broken")]
    out = judging.parse_verdicts(spark.createDataFrame(rows, "id int, raw string"), "raw", ("a", "b"))
    got = {(r.id, r.criterion): (r.verdict, r.confidence, r.error) for r in out.collect()}
    assert got[1, "a"] == got[2, "a"] == ("met", 0.5, None) and got[1, "b"] == ("unclear", 0.0, None)
    assert got[3, "a"][2] == "no JSON object" and got[4, "a"][2] == "invalid verdict" and got[4, "b"][2] == "missing criterion" and got[5, "a"][0] is None and got[5, "a"][2]


def test_parse_graded_and_exclusions(spark):
    rows = [(1, '{"agreement": " Strongly_Agree ", "confidence": "High"}'), (2, '{"agreement": "agree", "confidence": "odd"}'), (3, '{"agreement": "so so"}'), (4, "{}")]
    got = {r.id: (r.agreement, r.confidence, r.error) for r in judging.parse_graded(spark.createDataFrame(rows, "id int, raw string"), "raw").collect()}
    assert got == {1: (1.0, 1.0, None), 2: (0.5, 0.33, None), 3: (None, 0.33, "invalid agreement"), 4: (None, 0.33, "missing agreement")}
    raw = '{"exclusions": [{"candidate": " A ", "quote": "q"}, {"candidate": ""}, {"quote": "z"}]}'
    df = spark.createDataFrame([("x", raw), ("y", "none")], "k string, raw string")
    assert [(r.k, r.candidate, r.quote, r.reasoning) for r in judging.parse_exclusions(df, "raw").collect()] == [("x", "A", "q", "")]


def test_rollup_confidence_of_first_argmax(spark):
    df = spark.createDataFrame([("p", 0, 0.5, 0.2), ("p", 1, 0.5, 0.9), ("p", 2, -1.0, 0.7), ("q", 0, 0.0, 1.0)], "pdf_path string, chunk_idx int, agreement double, confidence double")
    got = {r.pdf_path: (r.graded_max, round(r.graded_mean, 6), r.confidence, r.verdict) for r in judging.graded_rollup(df, ["pdf_path"]).collect()}
    assert got == {"p": (0.5, 0.0, 0.2, "met"), "q": (0.0, 0.0, 1.0, "not_met")}


def test_scores_and_coherence(spark):
    df = spark.createDataFrame([("met", 3.0), ("odd", 0.0), ("not_met", -1.0)], "v string, e double")
    assert [tuple(r) for r in df.select(judging.verdict_ordinal(F.col("v")), judging.verdict_ordinal(F.col("v"), None), judging.band_score(F.col("v"), F.col("e"))).collect()] == [(1.0, 1.0, 1.0), (0.5, None, 0.5), (0.0, 0.0, 0.0)]
    wide = spark.createDataFrame([("not_met", "met", None)], "two_worlds string, adaptors string, arbitrariness string")
    r = judging.coherence(wide).first()
    assert r.adaptors_vacuous and not r.arbitrariness_vacuous and r.flags == ["adaptors=met but two_worlds=not_met"]


def test_judge_isolates_failures(spark):
    def complete(system, prompt):
        if prompt == "bad":
            raise RuntimeError("boom")
        return f"{system}:{prompt}"

    work = spark.createDataFrame([("s", "ok"), ("s", "bad")], "system string, prompt string")
    assert {r.prompt: (r.raw, r.call_error) for r in judging.judge(work, complete, 2).collect()} == {"ok": ("s:ok", None), "bad": (None, "RuntimeError: boom")}
    vectors = judging.embed(spark.createDataFrame([("a b",), (None,)], "text string"), judging.hashing_encoder(4)).collect()
    assert len(vectors[0].vec) == 4 and vectors[1].vec == [0.0] * 4


def test_method_texts(spark):
    papers = spark.createDataFrame([(1, "p", "a b c d e"), (2, "q", " ")], "code_number int, pdf_path string, text string")
    windows = F.transform(X.token_windows(X.whitespace_tokens(F.col("text")), 3, 1), lambda w: F.array_join(w, " "))
    got = [(r.pdf_path, r.method, r.chunk_idx, r.text) for r in judging.method_texts(papers, windows, F.left("text", F.lit(3))).collect()]
    assert got == [("p", "full", 0, "a b c d e"), ("p", "abstract", 0, "a b"), ("p", "chunk", 0, "a b c"), ("p", "chunk", 1, "c d e")]


def test_gated_verdicts_take_texts_to_python_by_rows(spark):
    df = spark.createDataFrame([("met", "genetic code", "the genetic-code"), ("met", "a b", "b a"), ("unclear", "x", "x"), (None, "x", "y")], "verdict string, evidence_quote string, passage string")
    gated = grounding.gate_verdicts(df)
    assert "ArrowEvalPython" not in gated._jdf.queryExecution().executedPlan().toString()
    assert [(r.verdict, r.grounding_failed) for r in gated.collect()] == [("unclear", True), ("unclear", True), ("unclear", False), (None, False)]


def test_graded_cells_take_texts_to_python_by_rows(spark):
    df = spark.createDataFrame([(0, 0.5, "not there", "some text"), (1, 0.0, "some", "some text"), (2, 0.5, "some", "some text"), (3, 0.0, " ", "some text")], "chunk_idx int, agreement double, evidence_quote string, passage string")
    gated = grounding.gate_graded(df).withColumn("model", F.lit("j"))
    zeroed = store.zeroed_with_quote(gated, ["j"])
    assert "ArrowEvalPython" not in zeroed._jdf.queryExecution().executedPlan().toString() + grounding.classify_cells(df)._jdf.queryExecution().executedPlan().toString()
    assert [r.chunk_idx for r in zeroed.collect()] == [0, 1]


# gold


def join_rows(df):
    """Rows that the joins of a plan gave."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if "Join" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_exclusion_negatives_pair_no_items_with_papers(spark):
    mapped = spark.range(40).selectExpr("cast(40 - id as int) as item_no", "concat('c', 40 - id) as candidate", "if(id < 39, 'q', repeat('x', 200)) as quote", "cast(if(id = 5, null, 7) as int) as mapped_code")
    papers = spark.range(60).selectExpr("cast(7 + id % 2 as int) as code_number", "concat('p', id div 2 % 25) as pdf_path")
    rows, conceptual = gold.exclusion_negatives(mapped, papers)
    assert Counter((r.code_number, r.pdf_path, r.evidence) for r in rows.collect()) == Counter((7, f"p{i}", "excluded 'c1': \"" + "x" * 120 + '"') for i in range(25))
    assert [r.item_no for r in conceptual.collect()] == [35]
    assert join_rows(rows) <= 30


def test_exclude_phase_pairs_no_items_with_papers(spark):
    mapped = spark.range(40).selectExpr("id as item_no", "'c' as candidate", "'q' as quote", "cast(id % 2 as int) as mapped_code")
    papers = spark.range(60).selectExpr("cast(id % 3 as int) as code_number", "concat('p', id div 3) as pdf_path")
    known = papers.where("pdf_path = 'p4' and code_number = 2").selectExpr("code_number", "pdf_path", "'pos' as polarity", *[f"'x' as {c}" for c in ("tier", "source", "criterion", "evidence")])
    phase = gold.exclude_phase(known, mapped, papers, ratified=True)
    want = [(2, "p4", "pos"), *[(c, f"p{i}", "neg") for c in (0, 1) for i in range(20) if i != 4]]
    assert sorted((r.code_number, r.pdf_path, r.polarity) for r in phase.collect()) == sorted(want)
    assert join_rows(phase) <= 100


def test_gold_rules(spark):
    names = spark.createDataFrame([(1, "The Genetic Code"), (2, "Immune code"), (3, "Organic immune codes"), (4, "the code")], "code_number int, code_name string")
    items = spark.createDataFrame([(0, "s", "immune CODE", "q1", ""), (1, "s", "Immune system", "q2", ""), (2, "s", "the", "q3", ""), (3, "s", "an immune", "q4", "")], "item_no int, source_pdf string, candidate string, quote string, reasoning string")
    mapped = gold.match_candidates(items, names)
    assert {r.item_no: r.mapped_code for r in mapped.collect()} == {0: 2, 1: None, 2: None, 3: 2}
    papers = spark.createDataFrame([(1, "p1"), (2, "p2"), (2, "p3")], "code_number int, pdf_path string")
    rows, conceptual = gold.exclusion_negatives(mapped, papers)
    assert {(r.code_number, r.pdf_path, r.tier) for r in rows.collect()} == {(2, "p2", "hard"), (2, "p3", "hard")} and {r.item_no for r in conceptual.collect()} == {1, 2}
    assert {r.evidence[:10] for r in rows.collect()} == {"excluded '"}
    assert [r.pdf_path for r in gold.anchor_papers(papers, names).collect()] == ["p1"]
    assert gold.exclusions_audit(mapped, names, papers).count() == 4
    positives = spark.createDataFrame([(2, "p2", "pos", "2", "db", "all", "e"), (9, "p9", "pos", "2", "db", "all", "")], ", ".join(f"{c} {'int' if c == 'code_number' else 'string'}" for c in gold.COLUMNS))
    assert [r.pdf_path for r in gold.without_conflicts(rows, positives).collect()] == ["p3"]
    cited = spark.createDataFrame([("smith", "2001")], "surname string, year string")
    paper_names = spark.createDataFrame([("p2", "Smith, J. (2001) On codes"), ("p9", "Other (2001)")], "pdf_path string, paper_name string")
    once = gold.promoted(positives, paper_names, cited)
    assert {r.pdf_path: (r.tier, r.source, r.evidence) for r in once.collect()} == {"p2": ("1", "cite", "e | cited: smith 2001"), "p9": ("2", "db", "")}
    assert sorted(map(tuple, gold.promoted(once, paper_names, cited).collect())) == sorted(map(tuple, once.collect()))


# layout


def spell(page, x, top, text):
    return [(page, x + 5.0 * i, x + 5.0 * i + 4, float(top), top + 8.0, c) for i, c in enumerate(text)]


def test_reference_table(spark):
    chars = spell(0, 40, 100, "1") + spell(0, 100, 100, "Alpha") + spell(0, 350, 100, "Smith (2001)") + spell(0, 350, 112, "Jones (1999a)") + spell(0, 40, 200, "2") + spell(0, 100, 200, "Beta") + spell(0, 350, 200, "Bare (2010)")
    chars += spell(1, 350, 50, "Late (2020)") + spell(1, 350, 545, "footer")
    df = spark.createDataFrame([("d", *c) for c in chars], "doc string, page int, x0 double, x1 double, top double, bottom double, text string")
    link = lambda page, x1, top, uri: ("d", page, 348.0, x1, float(top), top + 8.0, uri)
    links = spark.createDataFrame([link(0, 412.0, 100, "http://s"), link(0, 420.0, 112, "http://j"), link(0, 420.0, 112, "mailto:x"), link(1, 410.0, 50, "http://l")], "doc string, page int, x0 double, x1 double, top double, bottom double, uri string")
    got = {(r.code_number, r.code_name, r.paper_name, r.url) for r in layout.extract_references(df, links, ["doc"]).collect()}
    assert got == {(1, "Alpha", "Smith (2001)", "http://s"), (1, "Alpha", "Jones (1999a)", "http://j"), (2, "Beta", "Late (2020)", "http://l")}
    assert {(r.code_number, r.expected, r.found) for r in layout.citation_mismatches(df, links, ["doc"]).collect()} == {(2, 2, 1)}


def exploded_page(spark):
    """Characters and links that a plan explodes from few rows."""
    at = spark.range(100).selectExpr("cast(id div 50 as int) as doc", "cast(id div 10 % 5 as int) as page", "cast(id as string) as n", "id % 10 * 50 + 20.0D as top")
    char = lambda x, text: f"named_struct('x0', {x}D, 'x1', {x}D + 9, 'top', top, 'bottom', top + 8, 'text', {text})"
    chars = at.selectExpr("doc", "page", f"inline(array({char(40, 'n')}, {char(100, repr('code'))}, {char(350, repr('Doe J (1999)'))}))")
    links = at.selectExpr("doc", "page", "inline(array_repeat(named_struct('x0', 344.0D, 'x1', 380.0D, 'top', top, 'bottom', top + 8, 'uri', concat('http://x/', n)), cast(n as int) % 2))")
    return chars, links


def test_mismatches_broadcast_no_characters(spark):
    df = layout.citation_mismatches(*exploded_page(spark), ["doc"])
    assert not re.search(r"BroadcastHashJoin \[[^]]*\bpage#", df._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.code_number, r.expected, r.found) for r in df.collect()) == [(i, 1, 0) for i in range(0, 100, 2)]


def test_references_broadcast_no_characters(spark):
    df = layout.extract_references(*exploded_page(spark), ["doc"])
    assert not re.search(r"BroadcastHashJoin \[[^]]*\bpage#", df._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.code_number, r.paper_name, r.url) for r in df.collect()) == [(i, "Doe J (1999)", f"http://x/{i}" if i % 2 else "") for i in range(100)]


def test_references_and_mismatches_broadcast_no_codes(spark):
    for find in (layout.extract_references, layout.citation_mismatches):
        df = find(*exploded_page(spark), ["doc"])
        assert len(df.collect()) == (100 if find is layout.extract_references else 50)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()  # the plan as it ran


# corpus, store, readers, streaming, reports


def test_selection(spark):
    files = spark.createDataFrame([("a", "a"), ("b", "b")], "pdf_path string, basename string")
    cites = spark.createDataFrame([(2, "a", 1), (1, "a", 0), (3, "b", 2), (4, "c", 3)], "code_number int, pdf_path string, position int")
    assert {r.pdf_path: r.code_number for r in corpus.pool(cites, files).collect()} == {"a": 1, "b": 3}
    found, missing = corpus.found_and_missing(cites, spark.createDataFrame([("a",), ("z",)], "pdf_path string"))
    assert found.count() == 2 and [r.pdf_path for r in missing.collect()] == ["z"]
    assert corpus.seeded_sample(cites, "pdf_path", -1).count() == 0 and corpus.seeded_sample(cites, "pdf_path", 2, 1).count() == 2
    manifest = spark.createDataFrame([("a", "A", "u1", 0), ("b", "B", "", 1), ("x", "B", "", 2), ("", "C", "u1", 3)], "source_file string, paper_name string, url string, position int")
    existing = spark.createDataFrame([(0, "x", "u9"), (5, "B", "")], "code_number int, paper_name string, url string")
    assert sorted(r.position for r in corpus.rows_to_append(manifest, existing).collect()) == [0, 1]
    assert [r.name for r in corpus.seminal_files(manifest, ["b", "zz"], files).collect()] == ["a", "b"]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.init()
    s.init()
    schema = "run string, code_number int, pdf_path string, method string, criterion string, e double, model string, run_ts timestamp"
    row = lambda e, model, path="p": ("r", 1, path, "full", "two_worlds", e, model, None)
    s.upsert("embedding_scores", spark.createDataFrame([row(0.1, "m"), row(0.2, "m", "q")], schema))
    s.upsert("embedding_scores", spark.createDataFrame([row(0.9, None)], schema), ["e", "run_ts"])
    assert {(r.pdf_path, r.e, r.model) for r in s.read("embedding_scores", run="r").collect()} == {("p", 0.9, "m"), ("q", 0.2, "m")}
    s.upsert("embedding_scores", spark.createDataFrame([row(None, None)], schema))
    assert {(r.pdf_path, r.e, r.model) for r in s.read("embedding_scores").collect()} == {("p", None, None), ("q", 0.2, "m")}
    s.delete("embedding_scores", spark.createDataFrame([("r", "q")], "run string, pdf_path string"), ["run", "pdf_path"])
    assert s.read("embedding_scores").count() == 1
    s.vacuum("embedding_scores")
    assert s.read("embedding_scores").count() == 1 and s.read("verdicts").count() == 0
    old = spark.createDataFrame([(1, "p", "c", "met", None), (1, "p", "c", "met", "")], "code_number int, pdf_path string, criterion string, verdict string, model string")
    assert [(r.model, r.verdict) for r in store.migrate(old, "verdicts").collect()] == [("unknown", "met")]


def test_upsert_takes_the_last_and_matches_nulls(spark):
    target = spark.createDataFrame([(1, "old"), (None, "none"), (3, "kept")], "k int, v string")
    source = spark.createDataFrame([(1, "z", 0), (1, "a", 1), (None, "new", 2), (4, None, 3)], "k int, v string, position int")
    got = {(r.k, r.v) for r in store.upsert(target, source, ["k"], order="position").collect()}
    assert got == {(1, "a"), (None, "new"), (3, "kept"), (4, None)}
    assert {(r.k, r.v) for r in store.upsert(target, source, ["k"]).collect()} == {(1, "z"), (None, "new"), (3, "kept"), (4, None)}


def test_store_between_the_steps_of_a_writer(spark, tmp_path, monkeypatch):
    schema = "run string, k string, v string"
    rows = lambda run, v: spark.createDataFrame([(run, "k", v)], schema)
    values = lambda s: {(r.run, r.v) for r in s.read("run_meta").collect()}
    s = store.Store(spark, str(tmp_path))
    s.upsert("run_meta", rows("a", "1"))
    s.upsert("run_meta", rows("b", "1"))
    before = s._entry("run_meta")[1]
    assert values(s) == {("a", "1"), ("b", "1")} and sorted(x for p in before.values() for x in p) == ["a", "b"]
    # a writer dies once its root is written: nothing has changed, and the next one goes on
    with monkeypatch.context() as m:
        m.setattr(store.Store, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            s.upsert("run_meta", rows("a", "2"))
    assert values(s) == {("a", "1"), ("b", "1")}
    # a draft that was never renamed is no entry
    (tmp_path / "run_meta" / "_draft-x").write_text("{")
    s.upsert("run_meta", rows("a", "3"))
    after = s._entry("run_meta")[1]
    assert values(s) == {("a", "3"), ("b", "1")} and [r for r, p in before.items() if p == ["b"]] == [r for r, p in after.items() if p == ["b"]]
    # another writer is faster: the second publishes nothing
    other = store.Store(spark, str(tmp_path))
    with monkeypatch.context() as m:
        write = store.Store._write_root

        def slow(self, table, df):
            root = write(self, table, df)
            if self is s:
                other.upsert("run_meta", rows("a", "4"))
            return root

        m.setattr(store.Store, "_write_root", slow)
        with pytest.raises(store.ConcurrentWriteError):
            s.upsert("run_meta", rows("a", "5"))
    assert values(s) == {("a", "4"), ("b", "1")}
    s.vacuum("run_meta")
    assert values(s) == {("a", "4"), ("b", "1")} and {x.name for x in (tmp_path / "run_meta").iterdir()} == {"_log", *s._entry("run_meta")[1]}
    with pytest.raises(ValueError):
        s.upsert("run_meta", rows(None, "1"))


def test_judging_goes_on_after_a_stop(spark, tmp_path):
    work = spark.range(40).selectExpr("id as cell", "'s' as system", "cast(id as string) as prompt")
    path = str(tmp_path / "done")

    def broken(system, prompt):
        if int(prompt) % 4 == 0:
            raise RuntimeError("boom")
        return "first"

    assert {r.cell for r in judging.judge_and_keep(work, path, ["cell"], broken, 3).collect()} == {i for i in range(40) if i % 4}
    done = judging.judge_and_keep(work, path, ["cell"], lambda system, prompt: "second", 3).collect()
    assert len(done) == 40 and {r.raw for r in done if r.cell % 4} == {"first"} and {r.raw for r in done if r.cell % 4 == 0} == {"second"}


def test_principal_axes_of_many_dimensions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) @ np.diag([9.0, 5.0, 3.0]) @ rng.normal(size=(3, 20)) + 0.1 * rng.normal(size=(60, 20)) + 2
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(5)
    want = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    for most in (512, 4):
        monkeypatch.setattr(geometry, "GRAM", most)
        mu, axes = geometry.principal_axes(df, 2)
        assert mu == pytest.approx(x.mean(axis=0)) and np.abs((axes * want).sum(axis=1)) == pytest.approx(np.ones(2), abs=1e-9)
    monkeypatch.setattr(V, "added", lambda *_: pytest.fail("no matrix is needed"))
    assert geometry.principal_axes(df, 0)[1].shape == (0, 20)


def test_ranks_over_ranges_of_values(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(v)) for i, v in enumerate(rng.choice(np.r_[rng.normal(size=300), [0.0] * 50], 900))] + [("hot", None), ("hot", float("nan")), ("one", 5.0)]
    got = stats.average_ranks(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", ["g"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__range" in plan
    ranks = sorted((r.g, r["rank"]) for r in got.collect())
    want = []
    for g in {g for g, _ in rows}:
        values = [(-math.inf if x is None else math.inf if x != x else x) for h, x in rows if h == g]
        want += [(g, sum(v < x for v in values) + (values.count(x) + 1) / 2) for x in values]
    assert ranks == sorted(want)


def test_means_without_nulls(spark):
    df = spark.createDataFrame([("a", [1.0, None]), ("a", [3.0, 4.0]), ("b", None), (None, [1.0, 1.0])], "g string, v array<double>")
    assert {r.g: r["mean"] for r in V.mean_vector(df, "v", ["g"]).collect()} == {"a": [2.0, 4.0], None: [1.0, 1.0]}
    assert V.mean_vector(df.limit(0), "v", []).collect() == []


def test_too_many_centroids(spark, monkeypatch):
    monkeypatch.setattr(topics, "MOST_BYTES", 8)
    with pytest.raises(ValueError, match="broadcast"):
        topics.nearest(F.col("v"), [(1, np.ones(2))])


def test_command_line(spark, capsys):
    from corpusmill.__main__ import main, parser

    assert main(["list"]) == 0 and "auc_quality" in capsys.readouterr().out
    asked = parser().parse_args(["recompute", "folder", "--run", "r", "--k", "2", "--strength", "0.25", "--self", "x.org"])
    assert (asked.store, asked.run, asked.k, asked.strength, asked.own) == ("folder", "r", 2, 0.25, ["x.org"])
    assert parser().parse_args(["report", "folder"]).judge is None
    with pytest.raises(SystemExit):
        parser().parse_args(["query", "no such query", "data"])


def test_page_says_what_it_leaves_out(spark):
    rows = spark.createDataFrame([(i % 3, f"p{i:02}", float(i)) for i in range(30)], "code_number int, pdf_path string, e_adaptors double")
    page = reports.ranking_page(rows, "t", 10)
    assert "The first 10 of 30 papers by code and path." in page and "p27" in page and "p29" not in page
    assert "The first" not in reports.ranking_page(rows, "t", None) and "p29" in reports.ranking_page(rows, "t", None)


def test_prototypes(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"adaptors": {"pos": ["a", "b"], "neg": ["c"]}, "note": "x"}, indent=1))
    passages = readers.prototype_passages(spark, readers.load_prototypes(spark, str(tmp_path / "p.json")))
    assert {(r.pole, r.passage_no, r.text) for r in passages.collect()} == {("pos", 0, "a"), ("pos", 1, "b"), ("neg", 0, "c")}


def test_projections(spark):
    codes = spark.createDataFrame([("p", 4)], "pdf_path string, code_number int")
    payload = spark.createDataFrame([("p", {"chunk": [[1.0], [2.0]], "full": [[3.0]]})], "pdf_path string, vectors map<string,array<array<float>>>")
    assert sorted((r.method, r.chunk_idx, r.code_number) for r in store.vectors_to_rows(payload, codes, "r").collect()) == [("chunk", 0, 4), ("chunk", 1, 4), ("full", 0, 4)]
    gold_rows = spark.createDataFrame([(1, "p", "pos", "1", "db", " ", "e")], "code_number int, pdf_path string, polarity string, tier string, source string, criterion string, evidence string")
    assert store.gold_to_rows(gold_rows).first().criterion == "all"
    tries = []
    with pytest.raises(ConnectionError):
        store.with_retry(lambda: tries.append(1) or (_ for _ in ()).throw(ConnectionError()), retries=2, sleep=lambda s: None)
    assert len(tries) == 3


def test_readers(spark, tmp_path):
    codes = tmp_path / "codes.csv"
    codes.write_text('Code Number,Code Name,Paper Name,URL\n1,First,"A, ""quoted""\npaper",https://doi.org/10.1000/x\n1,Second,B,https://doi.org/10.1000/x\nx,Bad,C, \n', encoding="utf-8")
    cites = readers.read_citations(spark, str(codes))
    assert cites.count() == 2
    assert [tuple(r) for r in readers.read_code_names(spark, str(codes)).collect()] == [(1, "First")]
    assert readers.paper_names(cites, "pdfs").first().paper_name == 'A, "quoted"\npaper'
    assert readers.citations_by_file(cites, "pdfs").first().code_name == "Second"
    topic = tmp_path / "topics.csv"
    topic.write_text("Topic #,Label,Centroid Text\n1, One ,text\n2,Two,\n", encoding="utf-8")
    assert readers.read_topics(spark, str(topic)).count() == 2 and [r.label for r in readers.read_centroid_texts(spark, str(topic)).collect()] == ["One"]
    log = tmp_path / "log.jsonl"
    log.write_text('{"pdf_path": "p", "chunk_idx": 0, "exclusions": [{"candidate": "A"}, {"candidate": " "}]}\n\n{broken\n{"pdf_path": "q", "chunk_idx": 1}\n', encoding="utf-8")
    rows = readers.read_checkpoint(spark, str(log), "pdf_path string, chunk_idx int, exclusions array<struct<candidate:string,quote:string,reasoning:string>>")
    assert {r.pdf_path for r in rows.collect()} == {"p", "q"} and readers.done_keys(rows, ["pdf_path", "chunk_idx"]).count() == 2
    assert [r.candidate for r in readers.collected_exclusions(rows).collect()] == ["A"]
    assert readers.read_gold(spark, str(tmp_path / "none.csv")).count() == 0 and readers.read_cache(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_bytes(b"hello")
    assert readers.read_documents(spark, str(tmp_path / "docs")).first().text == "hello"


def test_stream_into_the_store(spark, tmp_path):
    s, folder = store.Store(spark, str(tmp_path / "store")), tmp_path / "in"
    folder.mkdir()
    schema = "code_number int, pdf_path string, criterion string, chunk_idx int, model string, agreement double"
    line = lambda a, path="p": json.dumps({"code_number": 1, "pdf_path": path, "criterion": "c", "chunk_idx": 0, "model": "m", "agreement": a})
    (folder / "1.json").write_text(line(0.5) + "\n{broken\n" + line(0.5) + "\n")
    run = lambda: ingest.ingest_to_store(ingest.stream_json(spark, str(folder), schema), s, "chunk_verdicts", str(tmp_path / "state")).awaitTermination()
    run()
    assert s.read("chunk_verdicts").count() == 1
    (folder / "2.json").write_text(line(0.5) + "\n" + line(1.0, "q") + "\n")
    run()
    assert {(r.pdf_path, r.agreement) for r in s.read("chunk_verdicts").collect()} == {("p", 0.5), ("q", 1.0)}


def test_reports(spark, tmp_path, corpus_vectors):
    docs, poles, *_ = corpus_vectors
    s = store.Store(spark, str(tmp_path))
    s.upsert("doc_vectors", docs.withColumn("run", F.lit("baseline")))
    s.upsert("pole_vectors", poles.withColumn("run", F.lit("baseline")))
    s.upsert("control_vectors", spark.createDataFrame([("baseline", "c", [1.0] * 6)], "run string, name string, vec array<float>"))
    reports.recompute_run(s, F.col("pdf_path") == "p7", 1, 0.5, F.lit("2024-01-01").cast("timestamp"))
    assert s.read("embedding_scores").count() == 7 * 2 * 3 and s.read("control_scores").count() == 3
    verdicts = [(p % 3, f"p{p}", c, "m", ["met", "unclear", "not_met"][p % 3]) for p in range(7) for c in ("two_worlds", "adaptors", "arbitrariness")]
    v = spark.createDataFrame(verdicts, "code_number int, pdf_path string, criterion string, model string, verdict string")
    s.upsert("verdicts", v)
    text, wide = reports.main_report(s)
    assert "## two_worlds" in text and wide.count() == 7
    report = ranking.report_rows(s.read("embedding_scores"), s.read("verdicts"))
    gold_rows = spark.createDataFrame([(f"p{p}", "pos" if p % 2 else "neg", "2", "all") for p in range(7)], "pdf_path string, polarity string, tier string, criterion string")
    pairs = ranking.gold_pairs(report, gold_rows)
    assert "| criterion |" in reports.gold_report(pairs, "m") and "# Comparison" in reports.comparison_report(v, v, report)
    records = ranking.with_topics(ranking.with_citations(ranking.ranking_dataset(s.read("embedding_scores"), v), spark.createDataFrame([("p1", "n", "t")], "basename string, code_name string, paper_name string")), spark.createDataFrame([("p1", ["x"])], "pdf_path string, topics array<string>"))
    assert ranking.matching(records, "X").count() == 1 and "<script>" in reports.ranking_page(ranking.ranked(records, "e", "mean"), "Ranking")
    assert tuple(ranking.labelled_counts(records).first()) == (7, 7, 1)
    assert reports.number(float("nan")) == "n/a" and reports.number(0.12345) == "+0.123"
    assert not math.isnan(ranking.pooled_rho(report).where("n > 2").first().rho or 0)


def test_prompts_and_work(spark):
    windows = spark.createDataFrame([("p", 0, "body", "Topic", None), ("p", 1, "more", None, None)], "pdf_path string, chunk_idx int, text string, topic string, blurb string")
    done = spark.createDataFrame([("p", 0, "adaptors")], "pdf_path string, chunk_idx int, criterion string")
    work = prompts.work_list(windows, done)
    assert work.count() == 5
    rows = {(r.chunk_idx, r.criterion): r.prompt for r in work.collect()}
    assert rows[0, "two_worlds"].startswith("Passage:\nbody") and "Topic: Topic" in rows[0, "two_worlds"] and "contrary" in rows[1, "arbitrariness"] and "Topic" not in rows[1, "adaptors"]
    reply = lambda system, prompt: '{"agreement": "agree", "confidence": "high", "evidence_quote": "body"}'
    parsed = judging.parse_graded(judging.judge(work.withColumn("code_number", F.lit(1)), reply), "raw")
    gated = grounding.gate_graded(parsed, passage="text")
    records = judging.chunk_records(gated, F.col("prompt_hash"))
    assert {(r.chunk_idx, r.agreement) for r in records.collect()} == {(0, 0.5), (1, 0.0)}
    assert prompts.registry(work).count() == 3
    assert prompts.payload(spark.createDataFrame([("p", "abcdef")], "pdf_path string, text string"), 3).first() == ("p", "abc", "abcdef")


def test_sql_functions(spark):
    assert "quote_coverage" in register.register(spark)
    assert spark.sql("select quote_coverage('genetic code', 'the genetic-code').coverage").first()[0] < 1
    assert spark.sql("select fold_marks('A\u2013 b')").first()[0] == "ab"


def test_counts_and_files(spark):
    v = spark.createDataFrame([("p", "met"), ("p", "met"), ("q", None)], "pdf_path string, verdict string")
    assert corpus.judged_count(v).first().papers == 1
    manifest = spark.createDataFrame([("a",), ("b",), ("",)], "source_file string")
    assert [r.source_file for r in corpus.missing_files(manifest, spark.createDataFrame([("x/a", "a")], "pdf_path string, basename string")).collect()] == ["b"]
