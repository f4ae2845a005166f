"""Operators against brute force on the smallest tables and on rows made for the edges."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm import catalog, op1_substring_dedup, op2_license_scan, op3_secret_scan, op4_simhash, op5_decontaminate, op6_token_file, op7_language_id, op8_lm_score, op9_bpe, op10_media

LOWER = {c: c + 32 for c in range(65, 91)}
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_rnd = random.Random(7)
PASSAGE = " ".join(f"w{_rnd.randint(0, 999)}" for _ in range(70))
KEY = "Ab3dEf6hIj9kLmN0pQrS"
EDGES = [
    (None, "no id " + PASSAGE, "en", "a"),
    (1, None, None, None),
    (2, "", "en", None),
    (3, f"one {PASSAGE} two", "en", "a"),
    (3, f"one {PASSAGE} two", "en", "a"),
    (4, f"Three {PASSAGE}\tfour É Ω", "fr", "b"),
    (5, f"Three {PASSAGE}\tfour É Ω", "fr", "c"),
    (6, "... 123 \n\r\n  ", "en", "a"),
    (7, f"Released under the MIT License. password = '{KEY}' x" + " long" * 30_000, "en", "a"),
    (8, f"token: secret={KEY} AKIA{'Z' * 16} " + "0123456789abcdef" + " <|endoftext|> Straße", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = ("rid", "n_words", "ids", "spans", "score", "at", "k", "word", "n", "rgb", "_id", "_rid", "_k", "_live", "_spans", "sha", "found", "node", "c0")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(PASSAGE.split()[5:30]).upper()), (2, "mit license"), (2, "mit license"), (3, None), (None, "one w")], "item_id long, text string")


@pytest.fixture(scope="module")
def folder(spark, edges, bench, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('edges')}"
    edges.write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def nothing(spark, bench, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('nothing')}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    bench.limit(0).write.parquet(f"{d}/benchmark.parquet")
    return d


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def documents(spark, d):
    return [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def same(got, want):
    assert collected(got) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_table(spark, nothing, name):
    assert catalog.queries()[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_every_row_has_a_result(spark, folder, name):
    got = catalog.queries()[name](spark, folder)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.collect()) == sorted((r[0] is None, r[0]) for r in EDGES)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf, folder, name):
    for d in (sf, folder):
        c = duckdb.connect()
        for t in ("documents", "benchmark"):
            path = d.removeprefix("file://") + f"/{t}.parquet"
            c.sql(f"create view {t} as select * from '{path if d == sf else path + '/*.parquet'}'")
        want = c.sql(catalog.oracle_sql()[name])
        got = catalog.queries()[name](spark, d).select(*want.columns)
        same(got, want.fetchall())


def brute_substrings(docs):
    own = {}
    words = [(d, (t or "").encode().split()) for d, t, *_ in docs]
    for d, w in words:
        for i in range(len(w) - 49 if d is not None else 0):
            k = b" ".join(w[i : i + 50])
            own[k] = min(own.get(k, d), d)
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 49 if d is not None else 0):
            if own[b" ".join(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        yield d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))


def test_substrings(spark, sf, folder):
    for d in (sf, folder):
        same(op1_substring_dedup.op1_substring_dedup(spark, d).drop("n_spans", "longest"), brute_substrings(documents(spark, d)))


@pytest.mark.parametrize("symbols", (1024, 2048))
def test_substrings_that_differ_as_thue_and_morse_are_kept(spark, symbols):
    one = "".join("ab"[i.bit_count() % 2] for i in range(symbols))
    other = one.translate({97: "b", 98: "a"})  # sums over powers of any odd base collide
    fill = [f"f{i}" for i in range(59)]
    docs = spark.createDataFrame([(i, " ".join([x] * 1 + fill[:30] + [x] + fill[30:])) for i, x in enumerate((one, other, one), 1)], "doc_id long, text string")
    words = [one[i : i + 1] for i in range(symbols)]
    spread = [(i, " ".join(w)) for i, w in ((4, words), (5, ["b" if x == "a" else "a" for x in words]))]
    docs = docs.union(spark.createDataFrame(spread, "doc_id long, text string"))
    got = op1_substring_dedup.repeated_spans(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
    same(got, brute_substrings([tuple(r) for r in docs.collect()]))


def test_substrings_of_rows_that_share_an_id_and_words(spark):
    rows = [(1, PASSAGE), (2, "a " + PASSAGE), (2, "a\n" + PASSAGE), (3, "b " + PASSAGE), (3, "c " + PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(op1_substring_dedup.repeated_spans(docs).select("doc_id", "n_words", "n_removed", "kept_sha256"), brute_substrings(rows))


def test_substring_lengths_double_until_none_repeats(spark):
    w = [f"x{i}" for i in range(450)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, "a " + " ".join(w[:210]) + " b"), (3, " ".join(w[300:360]) + " c"), (4, "d")], "doc_id long, text string")
    got = {r["doc_id"]: r["longest"] for r in op1_substring_dedup.repeated_spans(docs).collect()}
    assert got == {1: 200, 2: 200, 3: 50, 4: None}
    kept = {r["doc_id"]: r["text"] for r in op1_substring_dedup.remove_repeats(docs).collect()}
    assert kept == {1: " ".join(w), 2: "a b", 3: "c", 4: "d"}


def test_copies_of_whole_documents_have_a_longest(spark):
    w = [f"y{i}" for i in range(210)]
    rows = [(1, " ".join(w)), (2, "\n".join(w)), (3, " ".join(w[:60]) + " c"), (4, "d"), (5, "d"), (6, "z " * 100), (6, "z " * 100), (7, "v " * 50), (8, "v " * 50), (None, "d")]
    got = {r["doc_id"]: r["longest"] for r in op1_substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 200, 2: 200, 3: 50, 4: None, 5: None, 6: None, 7: 50, 8: 50, None: None}


def test_licenses(spark, sf, folder):
    for d in (sf, folder):
        got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in op2_license_scan.op2_license_scan(spark, d).collect()}
        want = set()
        for doc, text, *_ in documents(spark, d):
            w = ALNUM.findall((text or "").translate(LOWER))
            at = [(i, label) for p, label in op2_license_scan.PHRASES.items() for n in [len(p.split())] for i in range(len(w) - n + 1) if w[i : i + n] == p.split()]
            want.add((doc, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
        assert got == want


def brute_licenses(text):
    """Labels of the method and the best share, from the definition: loops over all places."""
    m = op2_license_scan
    w = ALNUM.findall((text or "").translate(LOWER))
    temps = [(label, re.findall(r"[0-9a-z]+", t.lower()), [p.split() for p in must]) for label, t, must in m.TEMPLATES]
    df = Counter(x for _, t, _ in temps for x in set(t))
    idf = {x: math.log((1 + len(temps)) / (1 + n)) for x, n in df.items()}
    order = {x: i for i, x in enumerate(sorted(set(idf) | {x for p in m.PHRASES for x in p.split()}))}
    labels, share = set(), 0.0
    for label, t, must in temps:
        rare = {x for x in t if idf[x] >= m.RARE * max(idf[y] for y in t)}
        own = sorted(rare & set(w), key=lambda x: (-idf[x], order[x]))[: m.LOOKUP]
        need = min(m.VOTES, len(rare))
        if len(rare & set(w)) < need:
            continue
        for start in range(-len(t) + 1, len(w)):
            inside = lambda j, s=start, t=t: 0 <= s + j < len(w) and w[s + j] == t[j]
            if sum(any(inside(j) for j in range(len(t)) if t[j] == x) for x in own) < need:
                continue
            span = w[max(0, start) : start + len(t)]
            if all(any(span[i : i + len(p)] == p for i in range(len(span))) for p in must):
                labels.add(label)
                share = max(share, sum(inside(j) for j in range(len(t))) / len(t))
    base = {label for p, label in m.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
    return ",".join(sorted(labels | base)), max(share, 0.5 if base else 0.0)


def test_license_labels_equal_brute_force(spark, sf):
    m = op2_license_scan
    rnd = random.Random(4)
    texts = [t for _, t, _ in m.TEMPLATES]
    rows = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r["text"] and len(r["text"]) < 2000][:40]
    for t in texts:
        w = t.split()
        rows += [f"// {t}", "a b c " + " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :]), " ".join(x if rnd.random() < 0.9 else "changed" for x in w)]
        rows.append(" ".join(rnd.sample(w, len(w))))
    rows += [f"{m.TEMPLATES[1][1]} and {m.TEMPLATES[15][1]} and {m.TEMPLATES[4][1]}", "", None, "the software " * 50]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: (",".join(r["labels"]), r["score"]) for r in m.scan(docs).collect()}
    want = {i: brute_licenses(t) for i, t in enumerate(rows)}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-12 for i in want)
    assert {x for labels, _ in got.values() for x in labels.split(",")} >= {label for label, _, _ in m.TEMPLATES}


def test_license_templates_are_found_in_place_only(spark):
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    docs = spark.createDataFrame([(1, "x " + full), (2, " ".join(reversed(full.split()))), (3, "granted software copy of permission")], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in op2_license_scan.scan(docs).collect()}
    assert got == {1: (["mit"], 1.0), 2: ([], 0.0), 3: ([], 0.0)}


def test_secrets_place_and_ownership(spark, edges):
    got = {(r["doc_id"], r["found"] and tuple((x["kind"], x["first"], x["last"], x["owners"], x["live"]) for x in r["found"])) for r in op3_secret_scan.scan(edges).collect() if r["doc_id"] in (7, 8)}
    assert (8, (("assign", 0, 34, 1, True), ("access", 35, 55, 1, False), ("hex", 56, 72, 1, True))) in got
    assert any(d == 7 and x[0][0] == "assign" and x[0][3] == 1 for d, x in got)


def test_secrets_of_many_repositories_are_examples(spark):
    n = op3_secret_scan.COMMON_REPOSITORIES
    docs = spark.createDataFrame([(i, f"password={KEY}", "a") for i in range(n)] + [(n + i, f"password={KEY[::-1]}", "a") for i in range(n - 1)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in op3_secret_scan.redact(docs).collect()}
    assert got[0] == f"password={KEY}" and got[n] == "[SECRET]"


def test_widely_copied_examples_stay(spark):
    docs = spark.createDataFrame([(i, f"api_key={KEY} é", f"s{i}") for i in range(5)] + [(9, f"x token='{KEY[::-1]}' y api_key={KEY}", "z")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in op3_secret_scan.redact(docs).collect()}
    assert got[0] == f"api_key={KEY} é" and got[9] == f"x [SECRET]' y api_key={KEY}"


def brute_simhash(docs, shingle=4):
    prints = []
    for _, text, *_ in docs:
        w = SPACED.findall((text or "").translate(LOWER))
        s = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
        ones = Counter(j for g in s for h in [xxhash.xxh64_intdigest(g.encode(), 42)] for j in range(64) if h >> j & 1)
        prints.append(sum(1 << j for j, n in ones.items() if 2 * n > len(s)))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(docs):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return [(d, f"{prints[i]:016x}", least[find(i)]) for i, (d, *_) in enumerate(docs)]


def test_simhash(spark, sf, folder):
    small = [(r[0], r[1] and r[1][:3000], *r[2:]) for r in documents(spark, folder)]
    same(op4_simhash.op4_simhash(spark, sf), brute_simhash(documents(spark, sf)))
    got = op4_simhash.near_duplicates(spark.createDataFrame(small, SCHEMA)).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")), "component_id")
    same(got, brute_simhash(small))


def test_golay_keys_meet_within_two_bits():
    g, rnd = op4_simhash.Golay(), np.random.default_rng(1)
    for width in (21, 22, 23):
        x = rnd.integers(0, 1 << width, 3000).astype(np.uint32)
        y = x ^ (np.uint32(1) << rnd.integers(0, width, 3000).astype(np.uint32)) ^ (np.uint32(1) << rnd.integers(0, width, 3000).astype(np.uint32))
        (a, oka), (b, okb) = g.keys(x, width), g.keys(y, width)
        assert all(set(p[o]) & set(q[u]) for p, o, q, u in zip(a, oka, b, okb, strict=True))


def test_forest_links_as_all_pairs_do():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 8, dtype=np.uint64)
    fp = np.array([int(base[i % 8]) ^ (1 << int(rnd.integers(64))) for i in range(300)], np.uint64)
    for most in (0, 2, 4):
        joins = lambda ties: {frozenset(c) for c in _classes(300, ties)}
        every = [(i, j) for i in range(300) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= most).tolist()]
        assert joins(op4_simhash.forest([fp], most)) == joins(every)


def _classes(n, ties):
    of = {i: {i} for i in range(n)}
    for a, b in ties:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for x in of[b]:
                of[x] = of[a]
    return of.values()


def test_similar_joins_what_the_shingles_join(spark):
    rnd = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in rnd.integers(0, 5000, int(rnd.integers(40, 300)))]
        texts.append(base)
        for edits in (1, 2, 4, 8):
            w = list(base)
            for at in rnd.integers(0, len(w), edits).tolist():
                w[at] = f"x{rnd.integers(1 << 30)}"
            texts.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    ties = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {i: min(c) for c in _classes(len(texts), ties) for i in c}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op4_simhash.similar(docs).collect()}
    assert got == want


def test_similar_finds_every_variant_of_a_hub(spark):
    rnd = np.random.default_rng(8)
    hub = [f"h{i}" for i in range(100)]
    texts = [hub]
    for _ in range(2000):  # two far words of each changed: 86 of 106 shingles are the hub's, 76 of 116 another's
        w = list(hub)
        for at in (int(rnd.integers(5, 45)), int(rnd.integers(52, 92))):
            w[at] = f"x{rnd.integers(1 << 40)}"
        texts.append(w)
    docs = spark.createDataFrame([(i * 7919 % 2003, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r["component_id"] for r in op4_simhash.similar(docs).collect()} == {0}


def test_a_line_repeated_in_two_texts_does_not_join_them(spark):
    line = " ".join(f"line{i}" for i in range(11))
    texts = [" ".join([line] * 200 + [f"{x}{i}" for i in range(150)]) for x in "ab"]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[0].upper())], "doc_id long, text string")
    same(op4_simhash.similar(docs).select("doc_id", "component_id"), [(1, 1), (2, 2), (3, 1)])


def test_texts_dominated_by_one_word_are_kept_apart(spark):
    texts = [" ".join(["spam"] * 400 + [f"{x}{i}" for i in range(120)]) for x in "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert op4_simhash.keep_one(docs).count() == 3


def test_similar_loses_no_link_within_a_large_family(spark):
    rnd = np.random.default_rng(3)
    base, texts = [f"b{i}" for i in range(150)], []
    for _ in range(600):  # two members of each pair differ by a word; pairs differ from each other by some six
        w = list(base)
        for at in rnd.choice(150, 6, replace=False).tolist():
            w[at] = f"x{rnd.integers(1 << 40)}"
        texts.append(w)
        w = list(w)
        w[int(rnd.integers(0, 150))] = f"y{rnd.integers(1 << 40)}"
        texts.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    ties = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(ties) >= 600
    want = {i: min(c) for c in _classes(len(texts), ties) for i in c}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in op4_simhash.similar(docs).collect()} == want


def test_similar_with_nulls_and_short_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, "one"), (None, "lone"), (6, "two words"), (7, "two others"), (7, "another text of that id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(op4_simhash.similar(docs).select("doc_id", "component_id"), [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (None, None), (6, 6), (7, 7), (7, 7)])
    assert op4_simhash.keep_one(docs).count() == 6
    assert op4_simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_of_each_group(spark):
    w = [f"q{i}" for i in range(400)]
    near = w[:200] + ["changed"] + w[201:]
    docs = spark.createDataFrame([(5, " ".join(w), 1), (2, " ".join(near), 2), (9, "other text altogether, by itself", 3), (9, "other text altogether, by itself", 3), (None, "lone", 4)], "doc_id long, text string, rid int")
    got = op4_simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 2, 9]


def test_decontaminate_spans_and_blocks(spark, edges, bench, monkeypatch):
    one = collected(op5_decontaminate.scan(edges, bench))
    monkeypatch.setattr(op5_decontaminate, "BLOCK_BYTES", 40)
    assert collected(op5_decontaminate.scan(edges, bench)) == one
    for cut in (False, True):
        got = collected(op5_decontaminate.clean(edges, bench, spans=cut))
        with monkeypatch.context() as m:
            m.setattr(op5_decontaminate, "BLOCK_BYTES", 32 << 20)
            assert collected(op5_decontaminate.clean(edges, bench, spans=cut)) == got
        assert len(got) == (len(EDGES) if cut else 4)
    docs = spark.createDataFrame([(1, "Zürich, " + " ".join(PASSAGE.split()[:40]) + " end"), (2, None), (3, "clean")], "doc_id long, text string")
    item = bench.where("item_id = 1")
    assert sorted(r["doc_id"] for r in op5_decontaminate.clean(docs, item).collect()) == [2, 3]
    p = PASSAGE.split()
    kept = {r["doc_id"]: r["text"] for r in op5_decontaminate.clean(docs, item, spans=True).collect()}
    assert kept == {1: "Zürich, " + " ".join(p[:5]) + "  " + " ".join(p[30:40]) + " end", 2: None, 3: "clean"}


def test_decontamination_index_tells_equal_windows_and_is_small():
    rnd = np.random.default_rng(2)
    items = [("a", "x y z " * 20), ("b", "y z x " * 20), ("c", "x y"), ("d", "x y"), ("e", " ".join(f"w{i}" for i in rnd.integers(0, 9, 300)))]
    index = op5_decontaminate.Index(items, 10)
    want = {}
    for name, t in items:
        w = t.split()
        for i in range(max(1, len(w) - 9)):
            want.setdefault(tuple(w[i : i + 10]), set()).add(name)
    for k, (known, _, start, cut, item) in index.of.items():
        assert (np.diff(known.astype(object)) >= 0).all()
        got = {tuple(index.text(s, k).decode().split()): {index.names[x] for x in item[a:b]} for s, a, b in zip(start, cut[:-1], cut[1:], strict=True)}
        assert got == {g: x for g, x in want.items() if len(g) == k}
    text = " ".join(f"word{i}" for i in rnd.integers(0, 1 << 30, 200_000))
    index = op5_decontaminate.Index([("a", text)], 10)
    size = index.buf.nbytes + index.first.nbytes + index.last.nbytes + sum(x.nbytes for v in index.of.values() for x in v)
    assert size < 6 * len(text)


def test_token_files(spark, sf, folder):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d in (sf, folder):
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
        at, want = 0, []
        for r in sorted(docs, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["h"])):
            ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        same(op6_token_file.op6_token_file(spark, d), want)


def test_token_file_reads_one_document_and_notices_damage(tmp_path):
    ids = [(None, np.array([5])), (3, np.arange(1000)), (3, np.array([7, 8])), (9, np.array([], int))]
    raw = op6_token_file.roundtrip(ids)
    (tmp_path / "f").write_bytes(raw)
    assert [x.tolist() for x in op6_token_file.lookup(str(tmp_path / "f"), 3)] == [list(range(1000)), [7, 8]]
    assert op6_token_file.lookup(str(tmp_path / "f"), 4) == []
    (tmp_path / "f").write_bytes(raw[:40] + bytes([raw[40] ^ 1]) + raw[41:])
    with pytest.raises(Exception):
        op6_token_file.lookup(str(tmp_path / "f"), 3)


def test_languages(spark, folder):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = op7_language_id.op7_language_id(spark, d).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    found = {r["doc_id"]: r["lang_pred"] for r in op7_language_id.op7_language_id(spark, folder).collect()}
    assert [found[x] for x in (1, 2, 6)] == ["und"] * 3 and found[4] != "und"


def _bins(text, n):
    raw = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    codes = {int.from_bytes(raw[i : i + n], "big") for i in range(len(raw) - n + 1)}
    bits = op7_language_id.BINS[n].bit_length() - 1
    return codes if n == 1 else {(c * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - bits for c in codes}


def _kernel(x, y):
    total = 0.0
    for n in op7_language_id.BINS:
        a, b = _bins(x, n), _bins(y, n)
        total += len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    return total


def test_language_scores_equal_a_kernel_worked_out_by_sets(spark, monkeypatch):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect() if r["text"]]
    learn, ask = rows[:60], [r["text"] for r in rows[60:90]] + ["", "é", "Ab ab AB"]
    monkeypatch.setattr(op7_language_id, "LANDMARKS", 24)
    texts, labels = [r["text"] for r in learn], [r["lang"] for r in learn]
    model = op7_language_id.solve(op7_language_id.presence(pa.array(texts)), labels)
    turn, order = Counter(), []
    for i, x in enumerate(labels):
        order.append((turn[x], i))
        turn[x] += 1
    mark = [i for _, i in sorted(order)[:24]]
    k = np.array([[_kernel(x, texts[m]) for m in mark] for x in texts])
    y = np.array([[1.0 if x == g else -1.0 for g in model.languages] for x in labels])
    # Ridge regression over functions spanned by the landmarks, penalised by their norm in the kernel's space.
    alpha = np.linalg.lstsq(k.T @ k + op7_language_id.RIDGE * len(texts) * k[mark], k.T @ y, rcond=1e-12)[0]
    want = np.array([[_kernel(x, texts[m]) for m in mark] for x in ask]) @ alpha
    assert np.abs(model.scores(pa.array(ask)) - want).max() < 1e-3
    names, score, value = model.predict(pa.array(ask))
    assert names[-3] == "und" and score[-3] == 0 and names[-1] != "und"
    soft = np.exp(op7_language_id.SHARP * want)
    assert np.abs(score[:30] - (soft / soft.sum(1, keepdims=True)).max(1)[:30]).max() < 1e-2
    assert names[:30] == [model.languages[i] for i in want[:30].argmax(1)]


def test_language_stage_keeps_learned_languages_and_rejects_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op7_language_id.fit(docs, ~op7_language_id.held_out())
    held = docs.where(op7_language_id.held_out())
    assert op7_language_id.accept(held, model).count() >= 0.995 * held.count()
    other = [
        "Il governo italiano ha deciso di aumentare le tasse per tutti i cittadini della repubblica. " * 3,
        "Suomen kieli on uralilainen kieli jota puhutaan Suomessa ja muualla maailmassa. " * 3,
        "0101010 0x9f 0x33 a;;; {}{}[]() // ==== 12345 " * 10,
        "pkftudhcyznirjky lnollkmpqalejfjserwxe qzxv jkwq vbnm zxcv qwrt plkj hgfd sdfg " * 3,
        "", "123 ...", None,
    ]
    rows = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(other)] + [(99, held.first()["text"], None, 5)], "doc_id long, text string, lang string, lang_pred long")
    got = op7_language_id.accept(rows, model).collect()
    assert [(r["doc_id"], r["lang"]) for r in got] == [(99, held.first()["lang"])]
    en = op7_language_id.accept(held, model, languages=["en"])
    assert en.where("lang <> 'en'").count() <= 0.01 * held.count() < en.count()


def test_language_fit_takes_each_id_once(spark):
    rows = [(1, "the cat and the dog", "en")] * 500 + [(1, f"the cat and {i}", "en") for i in range(50)] + [(2, "der Hund und die Katze", "de")] * 3 + [(3, "x", f"junk{i}") for i in range(90)]
    model = op7_language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.languages) == op7_language_id.LANGUAGES and {"en", "de"} <= set(model.languages)


def test_lm_scores(spark, sf, folder):
    for d in (sf, folder):
        docs = [(x, [*SPACED.findall((t or "").translate(LOWER)), "\n"]) for x, t, *_ in documents(spark, d)]
        held = lambda x: zlib.crc32(str(x).encode()) % 7 == 2 if x is not None else False
        c = Counter(w for x, ws in docs if not held(x) for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted((x is None, x, held(x), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for x, ws in docs)
        got = op8_lm_score.op8_lm_score(spark, d).collect()
        assert sorted((r[0] is None, *r[:5], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] <= 0 for r in got)
        ours, base = sum(r["score"] for r in got if r["held_out"]), sum(r["base_score"] for r in got if r["held_out"])
        assert d != sf or ours > base


def test_lm_scores_equal_the_model_worked_out_token_by_token(spark, sf, monkeypatch):
    m, box = op8_lm_score, {}
    train, common = m.train, m._common

    def learn(*args):
        box["weights"] = train(*args)
        return box["weights"]

    def known(counts):
        box["common"] = {r[0] % (1 << 64) for r in common(counts).select(F.xxhash64("word")).collect()}
        return common(counts)

    monkeypatch.setattr(m, "train", learn)
    monkeypatch.setattr(m, "_common", known)
    monkeypatch.setattr(m, "HOT", 3000)
    monkeypatch.setattr(m, "RANGE", 4000)
    rows = [(x, t) for x, t, *_ in documents(spark, sf)]
    got = {r["doc_id"]: r["score"] for r in m.score(spark.createDataFrame(rows, "doc_id long, text string"), ~m.held_out()).collect()}
    docs = [(x, [w.encode() for w in SPACED.findall((t or "").translate(LOWER))] + [b"\n"], zlib.crc32(str(x).encode()) % 7 == 2) for x, t in rows]
    h = {w: m.word_hash(w) for _, ws, _ in docs for w in ws}
    c = Counter(w for _, ws, held in docs if not held for w in ws)
    rank = {w: i for i, w in enumerate(sorted((w for w in c if h[w] in box["common"]), key=lambda w: (-c[w], h[w]))[: m.HEAD])}
    assert len(rank) == m.HEAD and min(c[w] for w in rank) >= max(n for w, n in c.items() if w not in rank)
    sub = {w: x >> 54 for w, x in h.items()}
    mass, rare, count = Counter(), Counter(), Counter()
    for w, n in c.items():
        if w not in rank:
            mass[sub[w]] += n + 1
            if h[w] not in box["common"]:
                rare[sub[w]] += n + 1
                count[sub[w]] += 1
    of_class = Counter()
    for x in range(m.SUBS):
        of_class[x // 32] += mass[x] + 1
    pairs = Counter((p, w) for _, ws, held in docs if not held for p, w in zip([b"", *ws], ws) if w not in rank)
    total, own = Counter(), Counter()
    for (p, w), n in pairs.items():
        total[p, sub[w]] += n
        own[p, sub[w]] += n - m.LESS if n >= 2 else 0

    def bucket(w, size):
        first = size - size // 3 - 1
        return rank[w] if rank.get(w, size) < first else first + h[w] % (size // 3)

    table = box["weights"].classes(np.arange(m.CONTEXTS)) / math.log(10)
    used = set()
    for x, ws, _ in docs:
        want = 0.0
        for i, w in enumerate(ws):
            at = (bucket(ws[i - 1], m.PREV) if i else m.PREV - 1) * m.SKIP + (bucket(ws[i - 2], m.SKIP) if i > 1 else m.SKIP - 1)
            if w in rank:
                used.add("head")
                want += table[at, rank[w] // m.MEMBERS] + box["weights"].words(np.array([at]))[0, rank[w] // m.MEMBERS, rank[w] % m.MEMBERS] / math.log(10)
                continue
            p, k = ws[i - 1] if i else b"", sub[w]
            want += table[at, m.HEADS + k // 32]
            if pairs[p, w] >= 2:
                used.add("pair")
                want += math.log10((mass[k] + 1) / of_class[k // 32]) + math.log10((pairs[p, w] - m.LESS) / total[p, k])
                continue
            common = h[w] in box["common"]
            used.add("common" if common else "rare")
            want += math.log10((c[w] + 1 if common else (rare[k] + 1) / (count[k] + 1)) / of_class[k // 32])
            if own[p, k]:
                used.add("rest")
                want += math.log10(1 - own[p, k] / total[p, k])
        assert abs(got[x] - want) < 0.01 + len(ws) / 2500
    assert used == {"head", "pair", "common", "rare", "rest"}


def test_lm_gains_on_held_out_texts(spark):
    got = op8_lm_score.op8_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.13


def test_lm_hashes_and_packed_columns(spark):
    words = [b"", b"a", b"longer than thirty-two bytes, so that all of the hash is used", "É".encode()]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select(F.xxhash64("w")).collect()
    assert [r[0] % (1 << 64) for r in got] == [op8_lm_score.word_hash(w) for w in words]
    key = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    a, b = np.arange(1000, dtype="<u2"), np.linspace(0, 1, 1000).astype("<f4")
    for n in (0, 1, 1000):
        for x, y in zip(op8_lm_score.unpack(op8_lm_score.pack(key[:n], a[:n], b[:n]), "<u8", "<u2", "<f4"), (key[:n], a[:n], b[:n]), strict=True):
            assert (x == y).all() and len(x) == n
    assert [k for k, *_ in op8_lm_score.ranges_of(key, 7)] == list(range(7))


def test_lm_gradient_is_the_slope_of_the_likelihood():
    rnd = np.random.default_rng(3)
    w = op8_lm_score.Weights(rnd.integers(1, 9, op8_lm_score.CLASSES).astype(float), rnd.integers(1, 9, op8_lm_score.HEAD).astype(float))
    context, n = np.array([5, 700]), rnd.integers(0, 9, (2, op8_lm_score.CLASSES))
    got = op8_lm_score.gradient(w, context, n)
    like = lambda: float((n * w.classes(context)).sum())
    before = like()
    w.c12[700, 3] += 1e-6
    assert abs((like() - before) / 1e-6 - got["c12g"][700, 3]) < 1e-3
    assert np.allclose(np.exp(w.words(context)).sum(-1), 1) and np.allclose(np.exp(w.classes(context)).sum(-1), 1)


def test_lm_training_takes_little_of_the_driver(spark, sf, monkeypatch):
    m, rnd = op8_lm_score, np.random.default_rng(4)
    n = rnd.integers(0, 9, (m.CONTEXTS, m.CLASSES)) * (rnd.random((m.CONTEXTS, 1)) < 0.1)
    by_prev, by_skip = rnd.integers(0, 9, m.PREV * m.HEAD), rnd.integers(0, 9, m.SKIP * m.HEAD)
    head = rnd.integers(0, 9, m.HEAD).astype(float)
    start = lambda: m.Weights(n.sum(0).astype(float), head)
    want, at = start(), np.flatnonzero(n.any(1))
    for _ in range(2):
        got = m.gradient(want, at, n[at])
        for x, have in zip(m.NAMES, (None, None, None, by_prev, by_skip), strict=True):
            old, g = getattr(want, x), got[x + "g"]
            g = g if have is None else have.reshape(g.shape) - g
            setattr(want, x, old + np.clip((g - m.RIDGE * old) / (3 * (got[x + "h"] + m.RIDGE)), -1.0, 1.0))

    sent, casts = [], []
    rows = spark.sparkContext.parallelize([(-1 - i, bytearray(x.tobytes())) for i, x in enumerate(np.split(n, m.PARTS))], m.PARTS)
    counts = spark.createDataFrame(rows, "part int, raw binary")
    frame, context = type(counts), type(spark.sparkContext)
    collect, arrow, broadcast = frame.collect, frame.toArrow, context.broadcast

    def size(got, column):
        sent.append(sum(len(x) for x in column(got)))
        return got

    def cast(*args):
        casts.append(broadcast(*args))
        return casts[-1]

    monkeypatch.setattr(context, "broadcast", cast)
    with monkeypatch.context() as patch:
        patch.setattr(frame, "collect", lambda df: size(collect(df), lambda got: [r["raw"] for r in got]))
        patch.setattr(frame, "toArrow", lambda df: size(arrow(df), lambda got: got["raw"].to_pylist()))
        w = m.train(counts, start(), by_prev, by_skip, 2)
    for x in m.NAMES:
        assert np.allclose(getattr(w, x), getattr(want, x), atol=1e-4)
    assert len(sent) == 2 and max(sent) < 14 << 20  # with each task's whole arrays: 29 MB
    m.score(spark.createDataFrame([(x, t) for x, t, *_ in documents(spark, sf)], "doc_id long, text string"), ~m.held_out(), 1)
    assert len(casts) == 6 and not any(os.path.exists(x._path) for x in casts)  # none is left to the garbage collector


def test_bpe_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, ours, rnd = Tokenizer.from_file(path), op9_bpe.load(path), random.Random(1)
    alphabet = "ab cD'sté\n\t \x1c\x85\xa0 　ßΣσς12٣漢字🙂́.,!?\r\x0b\x0c'll<|endoftext|>"
    for k in range(3000):
        x = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) + ("<|endoftext|>x" if k % 9 == 0 else "") + ("a" * rnd.randint(60, 300) if k % 50 == 0 else "")
        ids = tok.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(x), "<i4").tolist() == ids
        assert ours.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    assert ours.decode([-5, 10**6]) == ""


def test_bpe_query(spark, sf, folder):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in (sf, folder):
        want = []
        for x, t, *_ in documents(spark, d):
            ids = tok.encode(t or "", add_special_tokens=False).ids
            want.append((x, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
        same(op9_bpe.op9_bpe(spark, d), want)


def test_media_round_trip(spark, folder):
    got = {r["doc_id"]: r for r in op10_media.op10_media(spark, folder).collect()}
    for d, t, *_ in EDGES:
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), sha(want), zlib.crc32(want[-32:]))
    assert got[4]["media_sha256"] == got[5]["media_sha256"] and got[4]["feature"] == got[5]["feature"]


def test_media_tensor_is_the_picture_of_the_bytes(spark, monkeypatch):
    m = op10_media
    text = "".join(chr(i) for i in range(32, 1200))
    rows = spark.createDataFrame([(1, text, "clash")], "doc_id long, text string, rgb string")
    r = m.load(m.store(rows)).first()
    payload = m.padded(text.encode())
    assert bytes(r["payload"]) == payload
    units = -(-len(payload) // 384)
    data = np.zeros(units * 384, int)
    data[: len(payload)] = list(payload)
    coef = np.where(data >= 128, data, data - 255).reshape(units, 6, 64)
    coef[:, :, 0] = data.reshape(units, 6, 64)[:, :, 0] + 256
    assert (r["height"], r["width"]) == (16, 16 * units)
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    block = np.zeros((units, 6, 64))
    block[:, :, m.ZIGZAG] = coef
    pixels = np.clip(np.einsum("ux,nbuv,vy->nbxy", basis, block.reshape(units, 6, 8, 8), basis) + 128, 0, 255)
    y = np.concatenate([np.block([[p[0], p[1]], [p[2], p[3]]]) for p in pixels], axis=1)
    cb, cr = (np.concatenate([np.kron(p[k], np.ones((2, 2))) for p in pixels], axis=1) - 128 for k in (4, 5))
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2) + 0.5, 0, 255).astype(int)
    got = np.frombuffer(bytes(r["rgb"]), np.uint8).reshape(r["height"], r["width"], 3)
    assert np.abs(got - want).max() <= 1
    assert np.allclose([r["red"], r["green"], r["blue"]], got.reshape(-1, 3).mean(0))
    assert 0.2 < ((got > 0) & (got < 255)).mean()  # noise, not a saturated plane
    # Symbol by symbol the scans give the same coefficients as taken apart at once.
    fast = m.Picture(bytes(r["media"]))
    monkeypatch.setattr(m.Picture, "_ac_alike", lambda *a: False)
    slow = m.Picture(bytes(r["media"]))
    assert all((a == b).all() for a, b in zip(fast.coef, slow.coef, strict=True))


def test_media_of_very_long_payloads_keeps_within_the_format(monkeypatch):
    m = op10_media
    for size in (576, 100 << 20, 101 << 20, 2 << 30):
        wide, high = m._layout(size)
        assert wide * high * 384 >= size and 16 * wide <= 65535 and 16 * high <= 65535
    monkeypatch.setattr(m, "_MCU_WIDE", 2)
    monkeypatch.setattr(m, "_MCU_HIGH", 3)
    raw = m.padded(bytes(range(256)) * 40)
    assert m.Picture(m.encode(raw)).payload() == raw


def _general_scans(coef, quant_one, wide, high):
    """A greyscale progressive JPEG of any coefficients, by the book: every symbol of 16 bits."""
    symbols = list(range(255))

    def table(kind):
        return op10_media._segment(0xC4, bytes([kind, *[0] * 15, 255, *symbols]))

    def code(s):
        return f"{s:016b}"

    def size(v):
        return abs(v).bit_length()

    def low_bits(v):
        n = size(v)
        return f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    shift = lambda v, s: (abs(v) >> s) * (1 if v >= 0 else -1)
    scan = lambda a, b, h, s, bits: op10_media._scan([1], a, b, h, s, np.frombuffer(bits.encode(), np.uint8) - 48)
    out = [b"\xff\xd8", op10_media._segment(0xDB, bytes([0] + [quant_one] * 64)), op10_media._segment(0xC2, bytes([8, high >> 8, high & 255, wide >> 8, wide & 255, 1, 1, 0x11, 0])), table(0), table(0x10)]
    last, bits = 0, ""
    for row in coef:
        v = int(row[0]) >> 1
        bits += code(size(v - last)) + low_bits(v - last)
        last = v
    out += [scan(0, 0, 0, 1, bits), scan(0, 0, 1, 0, "".join(str(int(r[0]) & 1) for r in coef))]
    bits = ""
    for row in coef:
        run = 0
        for k in range(1, 64):
            v = shift(int(row[k]), 1)
            if not v:
                run += 1
                continue
            while run > 15:
                bits, run = bits + code(0xF0), run - 16
            bits, run = bits + code(run << 4 | size(v)) + low_bits(v), 0
        bits += code(0) if run else ""
    out.append(scan(1, 63, 0, 1, bits))
    bits = ""
    for row in coef:
        run, kept = 0, ""
        ends = max([k for k in range(1, 64) if abs(int(row[k])) == 1], default=0)
        for k in range(1, 64):
            v = abs(int(row[k]))
            if v == 0:
                run += 1
                while run > 15 and k <= ends:
                    bits, kept, run = bits + code(0xF0) + kept, "", run - 16
            elif v > 1:
                kept += str(v & 1)
            else:
                bits, kept, run = bits + code(run << 4 | 1) + ("1" if row[k] > 0 else "0") + kept, "", 0
        bits += code(0) + kept if ends < 63 else ""
    out += [scan(1, 63, 1, 0, bits), b"\xff\xd9"]
    return b"".join(out)


def test_media_decoder_reads_any_coefficients():
    rnd = np.random.default_rng(4)
    coef = np.where(rnd.random((12, 64)) < 0.25, rnd.integers(-40, 41, (12, 64)), 0)
    coef[:, 40:] = np.where(rnd.random((12, 24)) < 0.05, 1, 0)
    coef[:, 0] = rnd.integers(-300, 300, 12)
    p = op10_media.Picture(_general_scans(coef, 2, 32, 24))
    assert (p.coef[0] == coef).all()
    # The transform by its definition, on one block.
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, math.sqrt(0.125), 0.5)[:, None]
    block = np.zeros(64)
    block[op10_media.ZIGZAG] = coef[0] * 2
    want = np.clip(basis.T @ block.reshape(8, 8) @ basis + 128, 0, 255)
    assert np.abs(p.rgb()[:8, :8, 0] - want).max() <= 1


def test_pipeline_against_brute_force(spark, sf, folder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    # Language: the classifier by itself (held to brute force above) decides.
    model = op7_language_id.fit(docs, F.lit(True))
    names, score, value = model.predict(pa.array(list(rows.values())))
    stay = [d for d, g, s, v in zip(rows, names, score, value, strict=True) if g != "und" and s >= op7_language_id.LEAST_SCORE and v >= op7_language_id.LEAST_VALUE]
    # Near duplicates: all pairs.
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d in stay for w in [rows[d].lower().split()]}
    order = sorted(stay)
    ties = [(i, j) for i, x in enumerate(order) for j in range(i) for a, b in [(shingles[x], shingles[order[j]])] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)]
    stay = [order[min(c)] for c in {id(c): c for c in _classes(len(order), ties)}.values()]
    # Decontamination.
    items = [ALNUM.findall(r["text"].translate(LOWER)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(g) for g in grams}
    stay = [d for d in stay for w in [ALNUM.findall(rows[d].translate(LOWER))] if not any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))]
    assert sorted(stay) == sorted(out)
    # Tokens of texts that hold nothing like a secret.
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    clean = [d for d in out if not re.search("(?i)(password|passwd|secret|token|key)|[0-9a-f]{16}|[a-z0-9_+/-]{24}", rows[d])]
    assert len(clean) > 100
    for d in clean:
        assert out[d]["ids"] == tok.encode(rows[d], add_special_tokens=False).ids and out[d]["decoded_sha256"] == sha(rows[d])
    # Stages return the columns of documents and take the edges.
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert got.columns == spark.read.parquet(f"{folder}/documents.parquet").columns and got.count() <= len(EDGES)
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_rows_keep_clashing_columns(spark, edges):
    for got in (op1_substring_dedup.remove_repeats(edges), op4_simhash.keep_one(edges), op3_secret_scan.redact(edges)):
        assert got.columns == edges.columns
        assert {tuple(r[c] for c in EXTRA) for r in got.collect()} == {("clash",) * len(EXTRA)}
