"""The ten operators and the pipeline against brute force, and with odd inputs: nulls, empty texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, embedding_dedup, mixing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, token_counts, toxicity
from corpusmill.llm.common import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, slot int, component string, shard string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_texts():
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n))
    long = "\n".join(say(12).capitalize() + "." for _ in range(600))
    shared = say(60)
    base = say(120)
    return [
        None, "", "   \n\t ", "one", "one two three", base, base, base + " tail", say(80) + " " + shared, shared + " " + say(30), long, long[:2000] + " x " + long[2000:],
        "é ü ñ 日本語 " * 40, "word " * 300, "Menu | Home | About | News |\n" * 30, "nb sp ace x", base.upper(), "a\rb\x0bc\x0cd\x1ce",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["b", "a", None, ""][i % 4], None if t is None else len(t), 1, 2, "c", "s") for i, t in enumerate(odd_texts())]
    rows += [(5, rows[5][1], "en", "b", 3, 1, 2, "c", "s"), (None, "no id here at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def labelled(spark, docs):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(20)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


# 1


def test_quality_rules_counts(docs):
    got = quality_rules.digest(docs).collect()
    texts = dict(enumerate(odd_texts())) | {None: "no id here at all"}
    assert len(got) == docs.count()
    for r in got:
        text = texts[r.doc_id] or ""
        w = words_of(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(grams)
        repeated = {k for i, g in enumerate(grams) if n[g] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if words_of(x)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed,
        )
        assert not (r.kept and r.base_failed)


def test_quality_rules_verdicts(spark):
    rnd = random.Random(1)
    prose = "\n".join(" ".join(rnd.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(20))
    rows = [(1, prose), (2, "\n".join("Home | About | News | " + w + " |" for w in WORDS)), (3, " ".join(w.upper() + "!!" for w in rnd.sample(WORDS, 24) + rnd.sample(WORDS, 24) + rnd.sample(WORDS, 24)) + "."), (4, "All rights reserved.\n" + prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert out[1].kept and out[4].kept and not out[2].kept and not out[3].kept
    assert out[1].clean_text == prose and out[4].clean_text == prose


def test_quality_rules_with_tabs_and_own_columns(spark):
    rnd = random.Random(1)
    lines = [" ".join(rnd.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(20)]
    menu = "\n".join("        " + "  |  ".join(rnd.sample(WORDS, 5)) + "." for _ in range(20))
    rows = [(1, "\n".join(lines)), (2, "\t\n".join(lines) + "\t"), (3, "\r\n".join(lines)), (4, menu)]
    df = spark.createDataFrame([(i, t, i, i, "x", "mine") for i, t in rows], "doc_id long, text string, t long, row long, l string, __t string")
    out = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert out[1].kept and out[2].kept and out[3].kept and not out[4].kept
    assert all((r["t"], r["row"], r["l"], r["__t"]) == (i, i, "x", "mine") for i, r in out.items())
    assert out[2].clean_text == rows[1][1]


# 2 and 5


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifiers_with_odd_rows(spark, docs, none, module):
    labels = labelled(spark, docs)
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        of, fold = (5, 0) if module is quality_classifier else (4, 2)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % of == fold)
    assert module.classify(none, labels).count() == 0
    assert module.classify(docs, labels.limit(0)).count() == docs.count()


def test_quality_evidence_of_every_byte():
    b = quality_classifier.BLOCK
    data = bytes(np.random.default_rng(1).integers(33, 127, 3 * b, dtype=np.uint8))
    for n in (1, b // 4 - 1, b - 1, b, b + 1, b + b // 4 - 1, b + b // 4, 2 * b, 2 * b + 1, 2 * b + b // 4, 3 * b - 1):
        parts = quality_classifier.blocks(data[:n])
        assert b"".join(parts) == data[:n] and max(map(len, parts)) < b + b // 4


def test_quality_evidence_by_brute_force():
    import zstandard

    scorer = quality_classifier.Scorer(quality_classifier.fit(["good words in order"] * 9, ["bad | bad | bad"] * 9))
    size = lambda block, words: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=quality_classifier.LEVEL, write_content_size=False, write_dict_id=False).compress(block))
    text = "good words in order " * 9 + "bad | bad " * 12 + "a tail of spam"
    pairs = [(size(x, scorer.model.good), size(x, scorer.model.bad)) for x in quality_classifier.blocks(text.encode())]
    each = [(g - b) / (g + b) for g, b in pairs]
    whole = (sum(g for g, _ in pairs) - sum(b for _, b in pairs)) / sum(g + b for g, b in pairs)
    want = [whole, max(each), min(each), sum(max(x, 0) for x in each) / len(each), sum(sorted(each)[-2:]) / 2, float(np.std(each))]
    assert scorer.evidence(text) == pytest.approx(want) and scorer.evidence(" \n") == [0.0] * 6
    assert scorer.evidence("x" * 512) != scorer.evidence("x" * 512 + " bad | bad | bad" * 6)  # the tail counts


def test_labelled_sample_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c" * 50), (2, "x"), (3, "y" * 50), (None, "z"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    assert quality_classifier.labelled_sample(docs, labels, "quality", F.lit(True), 10, 20) == {0: ["x"], 1: ["a"]}


def test_toxicity_trained_by_tasks(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(20)) + (" snotbucket" if i % 3 == 0 else "")) for i in range(80)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    sample = quality_classifier.labelled_sample(docs, labels, "toxic", quality_classifier.fold(of=4) != 2)
    one, other = toxicity.train(docs, labels), toxicity.fit(sample[1], sample[0])
    assert (one.gram_scores == other.gram_scores).all() and one.bias == other.bias and (one.calibration == other.calibration).all()


def brute_grams(word):
    """(size, bytes) of the n-grams of a word between spaces."""
    data = b" " + word + b" "
    return [data[i : i + n] for n in toxicity.GRAMS for i in range(len(data) - n + 1)]


def test_toxicity_evidence_by_brute_force():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), 0.25, np.array([0.0, 1.0, 0.0]))

    def gram_score(g):
        value = 0
        for byte in g:
            value = value * 0x01000193 + byte & 0xFFFFFFFF
        mixed = (value ^ (len(g) - 1) * 0x85EBCA6B & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF
        return float(model.gram_scores[mixed >> 32 - toxicity.BITS])

    def evidence(text):
        words = (text or "").lower().encode().split()
        scores = [np.mean([gram_score(g) for g in brute_grams(w)]) for w in words]
        n = toxicity.WINDOW
        return max(np.mean(scores[i : i + n]) for i in range(max(1, len(words) - n + 1))) + model.bias, np.log(len(words))

    texts = [t for t in odd_texts() if t and words_of(t)]
    assert toxicity.document_evidence(texts, model) == pytest.approx(np.array([evidence(t) for t in texts]), abs=1e-4)
    assert np.isnan(toxicity.document_evidence([None, "", " \n"], model)[:, 0]).all()


def test_toxicity_of_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), 0.0, np.zeros(3))
    text = "\n".join(" ".join(rng.choice(WORDS, 9)) for _ in range(300))
    want = toxicity.document_evidence([text], model)
    for chunk in (64, 500, 4000):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert toxicity.document_evidence([text], model) == pytest.approx(want)
    monkeypatch.setattr(toxicity, "LONGEST", 40)
    pieces = list(toxicity._pieces("y" * 1000 + " end"))
    assert sum(n - again for _, n, again in pieces) == 26 and max(len(data) for data, _, _ in pieces) < 4300


def test_toxicity_learns_words_and_misspellings():
    rnd = random.Random(3)
    filler = lambda: [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(60)]
    bad = ["grumblefart", "snotbucket", "dungbrain"]

    def toxic(spelling=lambda w: w):
        w = filler()
        for _ in range(3):
            w.insert(rnd.randrange(len(w)), spelling(rnd.choice(bad)))
        return " ".join(w)

    model = toxicity.fit([toxic() for _ in range(250)], [" ".join(filler()) for _ in range(300)])
    assert (toxicity.score([" ".join(filler()) for _ in range(100)], model) < 0.3).mean() > 0.95
    assert (toxicity.score([toxic() for _ in range(100)], model) >= 0.3).mean() > 0.95
    assert (toxicity.score([toxic(lambda w: w[:5] + "x" + w[5:]) for _ in range(100)], model) >= 0.3).mean() > 0.8


@pytest.mark.parametrize(("module", "label", "area", "found", "flagged"), [(quality_classifier, "quality", 0.99, 0.98, 0.2), (toxicity, "toxic", 0.95, 0.92, 0.01)])
def test_classifiers_on_held_out_rows(spark, module, label, area, found, flagged):
    """Area under the curve, and at the threshold the share of label 1 that is found and of label 0 that is not."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = module.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").toPandas()
    ranks, y = out.score.rank(), out[label] == 1
    assert (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) > area
    assert (out.predicted[y] == 1).mean() >= found and (out.predicted[~y] == 1).mean() <= flagged


# 3


def brute_links(vectors, threshold=0.95):
    n = len(vectors)
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and np.linalg.norm(v) > 0 for v in vectors]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                near[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    return near


@pytest.mark.parametrize("part", [4096, 5])
def test_embedding_links(spark, monkeypatch, part):
    monkeypatch.setattr(embedding_dedup, "PART", part)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[i % 12] + 0.12 * rng.normal(size=16)).astype("float32").tolist() for i in range(150)]
    vectors += [vectors[3], vectors[3], [2 * x for x in vectors[3]], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0], [float("inf")] + [0.0] * 15]
    ids = [1000 - 3 * i for i in range(len(vectors))]
    df = spark.createDataFrame(list(zip(ids, vectors, [0] * len(ids), strict=True)), "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, recall=1.0).collect()}
    near = brute_links(vectors)
    labels = simhash.spanning(len(ids), *np.nonzero(near))
    for i, v in enumerate(ids):
        assert got[v].n_links == near[i].sum()
        assert got[v].component_id == min(ids[j] for j in range(len(ids)) if labels[j] == labels[i])
        assert got[v].kept == (got[v].component_id == v)


def test_embedding_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.digest(df).count() == 0
    df = spark.createDataFrame([(1, None, 1), (None, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in embedding_dedup.digest(df).collect()) == [(0, 0, True), (1, 0, True)]


@pytest.mark.parametrize("where", ["anywhere", "first half", "second half"])
def test_embedding_recall_of_the_default(spark, where):
    """Links just above the threshold that the query's own search finds, for displacements anywhere and inside one half."""
    import pyarrow.parquet as pq

    x = np.stack(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist()[:1200]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = np.random.default_rng(2).normal(size=x.shape)
    if where != "anywhere":
        step[:, slice(32, 64) if where == "first half" else slice(0, 32)] = 0
        part = x * (step != 0)
        step -= (step * x).sum(axis=1, keepdims=True) / (part * part).sum(axis=1, keepdims=True) * part
    else:
        step -= (step * x).sum(axis=1, keepdims=True) * x
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * step / np.linalg.norm(step, axis=1, keepdims=True)
    both = np.vstack([x, y]).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<float>")
    got = embedding_dedup.digest(df).toPandas().set_index("vec_id").n_links
    unit = both.astype(float) / np.linalg.norm(both.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert (got.sort_index().to_numpy() <= want).all() and got.sum() >= 0.99 * want.sum() > 1200


# 4


def test_fingerprints_bit_by_bit():
    import xxhash

    for text in odd_texts():
        w = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = words_of(w)
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) & (1 << 64) - 1 == want


@pytest.mark.parametrize("limit", [16384, 3])
def test_bit_sliced_links(spark, limit):
    rnd = random.Random(2)
    prints = [rnd.getrandbits(64) for _ in range(150)]
    for p in prints[:60]:
        q = p
        for b in rnd.sample(range(64), rnd.randint(1, 6)):
            q ^= 1 << b
        prints.append(q)
    prints += [0, 1, 3, 7, 15]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    links = simhash.bucket_links(df, simhash.tables(len(prints)), limit=limit)
    got = {r.node & (1 << 64) - 1: r.component & (1 << 64) - 1 for r in connected_components(links).collect()}
    u, v = zip(*[(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4], strict=True)
    want = simhash.spanning(len(prints), np.array(u), np.array(v))
    groups = lambda label: {frozenset(k for k in prints if label(k) == x) for x in {label(k) for k in prints}}
    at = {p: i for i, p in enumerate(prints)}
    assert groups(lambda p: got.get(p, p)) == groups(lambda p: want[at[p]])


def test_near_duplicates_of_odd_texts(docs, none):
    rows = simhash.digest(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].fingerprint == "0" * 16 and by_id[1].component_id == by_id[2].component_id == by_id[0].component_id == 0
    assert by_id[6].component_id == by_id[5].component_id == by_id[16].component_id == 5
    assert simhash.digest(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {5, 0} <= {r.doc_id for r in kept.collect()} and 6 not in {r.doc_id for r in kept.collect()}


def test_keep_one_of_repeated_rows(spark):
    say = lambda tag: " ".join(f"{tag}{i}" for i in range(30))
    rows = [(5, say("t"), 1, "a"), (5, say("t"), 1, "a"), (5, say("t"), 1, "b"), (7, say("t"), 1, "a"), (None, say("t"), 1, "a"), (None, say("own"), 1, "a"), (None, say("own"), 1, "a"), (5, say("other"), 1, "a"), (9, None, 1, "a"), (8, "", 1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long, row string").repartition(4)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert sorted((r[0] or 0, (r[1] or "")[:2]) for r in kept) == [(0, "ow"), (5, "ot"), (5, "t0"), (8, "")]
    assert sorted(kept, key=repr) == sorted((tuple(r) for r in simhash.keep_one(df.repartition(7)).collect()), key=repr)
    assert simhash.keep_one(df.limit(0)).count() == 0


# 6


def test_bpe_like_the_library(docs, none):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(bpe.default_ranks())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.TreeEncoder(ranks, P.PATTERN)
    rnd = random.Random(4)
    letters = "aAbeèü '\n\t  .,!1239日 　sthingtionre\r\x1c\x85"
    texts = [t or "" for t in odd_texts()] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(2000)]
    texts += ["a" * 3000, "ab" * 999, "!" * 777, " " * 500, "".join(rnd.choice("acgt") for _ in range(3000)), "<|endoftext|>"]
    for t in texts:
        assert encoder.encode(t) == library.encode_ordinary(t)
        assert encoder.decode(encoder.encode(t)) == t.encode()
    got = {r.doc_id: r for r in bpe.digest(docs).collect()}
    for i, t in enumerate(odd_texts()):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digest(none).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode_table(bpe.encode_table(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(odd_texts()))


def test_bpe_of_other_patterns_and_long_texts(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(bpe.default_ranks())
    texts = [t or "" for t in odd_texts()] + ["Two words. And  more\n\n of them " * 50]
    for pattern in (r"\p{L}+ ?|[^\p{L}]", r"(?s).{1,7}", P.PATTERN):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for stretch in (1 << 20, 40):
            monkeypatch.setattr(bpe, "STRETCH", stretch)
            encoder = bpe.TreeEncoder(ranks, pattern)
            assert all(encoder.encode(t) == library.encode_ordinary(t) for t in texts)
            assert all("".join(bpe.stretches(t)) == t for t in texts)


def test_bpe_join_is_associative():
    import public_tokenizers as P

    encoder = bpe.TreeEncoder(bpe.load_ranks(bpe.default_ranks()), P.PATTERN)
    rnd = random.Random(6)
    for _ in range(500):
        parts = [bytes(rnd.choice(b"thesindo") for _ in range(rnd.randint(0, 12))) for _ in range(3)]
        a, b, c = (encoder.encode_bytes(p) for p in parts)
        whole = encoder._merged_long(b"".join(parts)) if any(parts) else ()
        assert encoder.join(encoder.join(a, b), c) == encoder.join(a, encoder.join(b, c)) == whole


# 7


def test_token_counts_by_brute_force(docs, none):
    import public_tokenizers as P
    import regex

    scores = token_counts.piece_scores(bpe.load_ranks(bpe.default_ranks()))
    find = regex.compile(P.PATTERN).findall

    def count(token):
        best = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            options = [(best[b][0] + scores[token[b:end]], -best[b][1] - 1) for b in range(end) if token[b:end] in scores]
            s, n = max(options)
            best.append((s, -n))
        return best[-1][1]

    memo = {}
    got = {r.doc_id: r for r in token_counts.digest(docs).collect()}
    for i, t in enumerate(odd_texts()):
        tokens = [m.encode() for m in find(t or "")]
        for m in tokens:
            if m not in memo:
                memo[m] = count(m)
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(tokens), sum(memo[m] for m in tokens))
    assert token_counts.digest(none).count() == 0


def test_token_counts_of_long_pre_tokens():
    import tracemalloc

    rnd = random.Random(8)
    trie = token_counts.CountingTrie(token_counts.piece_scores(bpe.load_ranks(bpe.default_ranks())))
    for n in (5, 300, 5000):
        token = bytes(rnd.choice(b"thesindo") for _ in range(n))
        assert trie.count_long(token) == trie.count(token)
    token = bytes(rnd.choice(b"thesindo") for _ in range(1_000_000))
    nodes = trie.nodes
    tracemalloc.start()
    assert 100_000 < trie.token(token) <= len(token)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20 and trie.nodes == nodes and token not in trie.terminal
    tracemalloc.stop()


# 8


def brute_removal(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        w = (text or "").encode().split()
        cover = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                cover[i : i + 20] = [True] * 20
            seen.add(window)
        kept = [x for x, c in zip(w, cover, strict=True) if not c]
        out[doc_id] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeated_passages(spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    if group == 2:  # lengthened suffixes are combined, shipped and solved a few at a time
        monkeypatch.setattr(substring_dedup, "HELD", 7)
        monkeypatch.setattr(substring_dedup, "CHUNK", 50)
    rnd = random.Random(7)
    say = lambda n: [rnd.choice(WORDS) for _ in range(n)]
    passages = [say(n) for n in (19, 20, 21, 35, 60)]
    rows = []
    for i in range(60):
        w = say(rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            w += rnd.choice(passages) + say(rnd.randint(0, 5))
        rows.append((i, " ".join(w) if i % 7 else "\n".join(w)))
    rows += [(100 + i, rows[11][1]) for i in range(5)] + [(200, "x " * 70), (201, "y"), (202, None), (203, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.digest(df).collect()} == brute_removal(rows)


@pytest.mark.parametrize("group", [20_000, 1])
def test_repeated_passages_without_own_ids(spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    say = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    one, passage = say("one", 40), say("p", 25)
    rows = [(1, one), (None, one), (None, say("own", 30)), (None, say("c", 5) + " " + passage), (None, passage + " " + say("d", 7)), (7, one), (7, say("seven", 33))]
    got = collections.defaultdict(list)
    for r in substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r.doc_id, r.n_words].append(r.n_removed)
    assert sorted(got.pop((None, 30)) + got.pop((None, 32))) == [0, 0, 25]
    assert got == {(1, 40): [0], (None, 40): [40], (7, 40): [40], (7, 33): [0]}


def test_repeated_passages_of_odd_texts(docs, none):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digest(docs).collect()}
    want = brute_removal(list(enumerate(odd_texts())))
    assert all(got[i] == want[i] for i in want)
    assert substring_dedup.digest(none).count() == 0
    out = substring_dedup.cleaned(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[6] == "" and texts[5] == odd_texts()[5]


# 9


def test_shards(spark, docs, none):
    rows = sharding.digest(docs).collect()
    assert len(rows) == docs.count() and sharding.digest(none).count() == 0
    texts = dict(enumerate(odd_texts())) | {None: "no id here at all"}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
    big = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 * 13 as int)) as text")
    out = sharding.digest(big).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert set(loads.index) == set(range(24)) and loads.max() - loads.min() <= 0.01 * loads.mean()
    for _, slots in out.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_shard_map_versions(spark, tmp_path):
    loads = spark.range(64).selectExpr("cast(id as int) as virtual_slot", "id * id + 5 as bytes", "1L as rows")
    path = str(tmp_path / "map")
    sharding.write_map(sharding.initial_map(loads, 4), path, 0)
    sharding.write_map(sharding.rebalanced(sharding.read_map(spark, path), loads, 4), path, 1)
    for _ in range(2):  # a rerun writes the same version again
        sharding.write_map(sharding.rebalanced(sharding.read_map(spark, path, 1), loads, 5), path, 2)  # a fifth shard
    maps = [{r.virtual_slot: r.shard for r in sharding.read_map(spark, path, v).collect()} for v in range(3)]
    assert [sharding.read_map(spark, path, v).count() for v in range(3)] == [64] * 3
    assert {r.version for r in sharding.read_map(spark, path).collect()} == {2}
    byte = {r.virtual_slot: r.bytes for r in loads.collect()}
    sums = [sum(b for s, b in byte.items() if maps[2][s] == k) for k in range(5)]
    assert max(sums) - min(sums) < 0.05 * sum(sums) / 5
    assert sum(maps[1][s] != maps[2][s] for s in byte) < 40
    for before, after, shards in ((maps[0], maps[1], 4), (maps[1], maps[2], 5)):
        assert after == brute_rebalanced(before, byte, shards)
    docs = spark.range(10).selectExpr("id as doc_id", "'q' as shard", "id as __slot", "id as row")
    assigned = sharding.assign(docs, sharding.read_map(spark, path), [F.col("doc_id")], 64)
    assert assigned.columns == ["doc_id", "__slot", "row", "virtual_slot", "shard"]
    assert all(r.shard == maps[2][r.virtual_slot] and r.row == r.doc_id for r in assigned.collect())


def brute_rebalanced(shard_of, byte, shards):
    """Each shard keeps its largest slots up to an equal share; the others go, largest first, to the lightest shard."""
    share, loads, out, pool = sum(byte.values()) / shards, [0] * shards, {}, []
    for shard in sorted(set(shard_of.values())):
        run = 0
        for slot in sorted((s for s in shard_of if shard_of[s] == shard), key=lambda s: (-byte[s], s)):
            run += byte[slot]
            if shard < shards and run <= share:
                out[slot] = shard
                loads[shard] += byte[slot]
            else:
                pool.append(slot)
    for slot in sorted(pool, key=lambda s: (byte[s], s), reverse=True):
        least = min(range(shards), key=lambda k: (loads[k], k))
        out[slot] = least
        loads[least] += byte[slot]
    return out


def test_shards_follow_the_stored_map(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "shared_path", lambda spark, name: str(tmp_path / name))
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 * 13 as int)) as text")
    out = sharding.digest(docs).collect()
    byte = collections.Counter(dict.fromkeys(range(sharding.SLOTS), 0))
    for r in out:
        byte[r.virtual_slot] += r["size"]
    want = brute_rebalanced({s: s % 24 for s in range(sharding.SLOTS)}, byte, 24)
    stored = {r.virtual_slot: r.shard for r in sharding.read_map(spark, str(tmp_path / "slot-map")).collect()}
    assert stored == want and all(r.shard == want[r.virtual_slot] for r in out)


# 10


def water_fill(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in free) if free else 0
        full = {s for s in free if w[s] * level >= 3 * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        out |= {s: 3.0 * sizes[s] for s in full}
        free -= full


def test_mix(spark, docs, none):
    rows = mixing.digest(docs).collect()
    assert len(rows) == docs.count() and mixing.digest(none).count() == 0
    rnd = random.Random(9)
    data = [(i, rnd.choice(["a", "B", "é", None, "zz", "tiny"] + ["hot"] * 6), rnd.randint(0, 60)) for i in range(4000)]
    data = [(i, s, n if s != "tiny" else n % 2) for i, s, n in data]
    df = spark.createDataFrame([(i, s, "w " * n, "x") for i, s, n in data], "doc_id long, source string, text string, target string")
    out = mixing.digest(df).toPandas()
    sizes = collections.Counter()
    for _, s, n in data:
        sizes[s] += n
    want = water_fill(sizes)
    for s, g in out.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= 1
    assert (out.taken <= 3 * out["size"]).all()
    again = mixing.digest(df.repartition(7)).toPandas()
    assert sorted(zip(out.doc_id, out.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    mixed = mixing.sample(df)
    assert mixed.columns == df.columns and mixed.count() == sum(t // n for t, n in zip(out.taken, out["size"], strict=True) if n)


def test_sample_of_repeated_rows(spark):
    rows = [(1, "w " * 10, "a", 0, "x")] * 5 + [(1, "v " * 10, "a", 0, "x"), (None, "u " * 10, "a", 0, "x"), (None, "u " * 10, "a", 0, "y"), (3, "t " * 40, "b", 0, "x"), (3, "t " * 40, "b", 0, "x"), (4, None, "b", 0, "x"), (5, "s " * 500, "c", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __n long, __id string").repartition(4)
    words, plan = collections.Counter(), collections.Counter()
    sampled = mixing.sample(df)
    assert sampled.columns == df.columns
    for r in sampled.collect():
        words[r.source] += len(words_of(r.text))
        assert (r.doc_id, r.text, r.source, r["__n"], r["__id"]) in rows
    for r in mixing.digest(df).collect():
        plan[r.source] += r.taken
        assert r.taken <= 3 * r["size"]
    assert words == plan and mixing.digest(df).count() == len(rows)


def test_fit_takes_what_fits():
    rng = np.random.default_rng(6)
    for _ in range(300):
        lengths = np.unique(rng.integers(0, 400, rng.integers(1, 9)))
        counts = rng.integers(1, 9, len(lengths))
        target = float(rng.uniform(0, 3.2 * (lengths * counts).sum()))
        for programme in (16, 1 << 16):
            passes, extra = mixing.fit(lengths, counts, target, programme=programme)
            size = int((lengths * counts).sum())
            total = passes * size + int((extra * lengths).sum())
            rest = min(3 * size, round(target)) - total
            assert (extra >= 0).all() and (extra <= counts).all() and passes + (extra.max() > 0) <= 3
            assert rest >= 0 and not any(0 < n <= rest and c > e for n, c, e in zip(lengths, counts, extra, strict=True) if passes < 3)


def test_mix_in_salted_groups(spark):
    df = spark.range(500).selectExpr("id as doc_id", "if(id % 2 = 0, 'a', 'b') as source", "7L as size")
    out = mixing.mix(df, group=40)
    copies = {r.source: r.c for r in out.groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "c").collect()}
    assert copies == {"a": 357, "b": 142}


def test_knapsack():
    rnd = random.Random(1)
    for _ in range(60):
        lengths = rnd.sample(range(1, 30), 4)
        counts = [rnd.randint(0, 4) for _ in lengths]
        budget = rnd.randint(1, 120)
        sums = {0}
        for x, n in zip(lengths, counts, strict=True):
            sums = {s + k * x for s in sums for k in range(n + 1)}
        taken = mixing.knapsack(lengths, counts, budget)
        assert all(taken.get(x, 0) <= n for x, n in zip(lengths, counts, strict=True))
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= budget)


# shared parts and the pipeline


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rnd.randrange(50), 100 + rnd.randrange(50)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_a_long_path(spark, monkeypatch):
    from corpusmill.llm import common

    rounds = []
    monkeypatch.setattr(common, "staged", lambda df, name, path=None, staged=common.staged: rounds.append(name) or staged(df, name, path))
    edges = spark.range(10_000).selectExpr("id as u", "id + 1 as v")
    assert [tuple(r) for r in connected_components(edges).groupBy("component").count().collect()] == [(0, 10_001)]
    assert len(rounds) <= 20


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from corpusmill.llm.common import shared_root

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and docs.count() == counts[4]
    assert corpus_pipeline.run(spark, sf).count() == counts[4]


def test_pipeline_like_its_parts_by_brute_force(spark, sf, tmp_path):
    """Documents with repeated rows and a third of copies: what run() gives, from plain code over the stages' rules."""
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.where("doc_id = 3")
    copies = first.withColumn("doc_id", F.explode(F.expr("sequence(5000L, 5099L)")))
    docs = docs.unionByName(docs.where("doc_id < 40")).unionByName(copies).persist()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    # what is not toxic, by the operator's scores: training is not repeated here
    clean = {r.doc_id for r in toxicity.classify(docs, labels).where("predicted = 0").collect()}
    rows = {(r.doc_id, r.text): r for r in docs.collect() if r.doc_id in clean}
    ids = sorted(rows, key=lambda k: k[0])
    prints = [simhash.fingerprint(t) & (1 << 64) - 1 for _, t in ids]
    u, v = [], []
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 4:
                u.append(i)
                v.append(j)
    label = simhash.spanning(len(ids), np.array(u, int), np.array(v, int))
    kept = [ids[i] for i in range(len(ids)) if label[i] == i]
    seen, texts = set(), {}
    for doc_id, text in kept:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        texts[doc_id] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else text
    sizes, source_of = {d: len(words_of(t)) for d, t in texts.items()}, {d: rows[d, t].source for d, t in kept}
    by_source = collections.Counter()
    for d, n in sizes.items():
        by_source[source_of[d]] += n
    want, library = water_fill(by_source), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})
    taken, got = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(texts[r.doc_id] or ""), "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        taken[source_of[r.doc_id]] += sizes[r.doc_id]
        got[r.doc_id] += 1
    largest = {s: max(n for d, n in sizes.items() if source_of[d] == s) for s in want}
    assert max(got.values()) <= 3 and all(-1 < want[s] - taken[s] <= largest[s] for s in want)
