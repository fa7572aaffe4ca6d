"""Each operator against SQL or brute force, and on nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import chat_format, decontaminate, language_id, license_scan, mixing, ngram_join, pii, quality_classifier, quality_rules, queries, token_counts
from oracle import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = ["n_words", "words", "score", "key", "count", "findings", "row", "component", "node", "c", "n", "size", "copies", "target", "g", "a", "b", "lambda", "mean", "free"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun of a late summer day with no care at all "
ROWS = [
    (1, BASE * 3, "en", "s1", 10), (2, BASE * 3 + "tail", "en", "s1", 10), (3, None, "en", None, None), (4, "", None, "s2", 0), (5, " \t\n", "en", "s2", 3),
    (6, "Short one", "en", "s2", 9), (6, "Short one", "en", "s2", 9), (7, "x" * 200_000, "de", "s3", 200_000), (8, "der die das und ein eine zu " * 20_000, "de", "s3", 1),
    (None, "no id at all", "en", "s1", 5), (9, "12345 !!! 67890", "en", "s1", 5), (10, BASE * 3, "en", "é", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    return df.withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_quality_rules(docs, none):
    got = quality_rules.quality_rules(docs)
    assert got.count() == len(ROWS) and quality_rules.quality_rules(none).count() == 0
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and "length" in by[3].broken
    assert by[8].n_words == by[8].n_repeat_words == 140_000 and by[7].word_chars == 200_000
    windows = [w for w in zip(*(WORDS.findall(BASE * 3)[k:] for k in range(3)))]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    assert by[1].n_repeat_words == len(hit)


def brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, ids = [shingles(t) for _, t in rows], [i for i, _ in rows]
    part = {i: i for i in ids}
    known = [(i, s) for i, s in zip(ids, sets) if s and i is not None]
    links = [(i, j) for k, (i, a) in enumerate(known) for j, b in known[:k] if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(part[i], part[j])
            changed |= part[i] != low or part[j] != low
            part[i] = part[j] = low
    return sorted((str(i), len(s), str(part[i])) for i, s in zip(ids, sets))


def test_ngram_join(spark, docs, none):
    assert ngram_join.ngram_components(none).count() == 0
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_components(docs).collect())
    assert got == brute_components([(r[0], r[1]) for r in ROWS])


def test_ngram_join_with_a_null_id_before_an_equal_text(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(None, " ".join(words)), (7, " ".join(words)), (8, " ".join([*words[:-1], "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_components(df).collect())
    assert got == brute_components(rows) and ("8", 116, "7") in got


def test_ngram_join_on_groups_of_near_copies(spark):
    rng = np.random.default_rng(3)
    vocabulary, rows = [f"w{i}" for i in range(400)], []
    passage = " ".join(rng.choice(vocabulary, 60))
    for family in range(4):
        base = list(rng.choice(vocabulary, 90))
        for _ in range(30):
            words = list(base)
            for p in rng.choice(90, int(rng.integers(0, 5)), replace=False):
                words[p] = f"e{rng.integers(6)}"
            rows.append((len(rows), " ".join(words[: int(rng.integers(70, 91))])))
    rows += [(len(rows) + i, passage + " " + " ".join(rng.choice(vocabulary, 80))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_components(df).collect())
    assert got == brute_components(rows)


def test_a_column_of_many_unrelated_documents_links_none(spark):
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 1_000_000, int(rng.integers(3, 12))))) for i in range(5000)]
    rows += [(5000 + i, f"{rows[i][1]} z") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(df).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    asked = [*range(60), *range(5000, 5020)]
    for a in asked:
        assert all(got[a] == got[b] for b in range(5020) if b != a and near(a, b))
    for c in {got[a] for a in asked}:
        own = [i for i, g in got.items() if g == c]
        assert len(own) == 1 or all(any(near(a, b) for b in own if b != a) for a in own)


@pytest.mark.parametrize("often, chunk", [(2, 50), (3, 400), (32, 1_000_000)])
def test_ngram_join_with_small_chunks_and_frequent_columns(spark, monkeypatch, often, chunk):
    monkeypatch.setattr(ngram_join, "OFTEN", often)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = np.random.default_rng(often)
    base = [list(rng.choice([f"w{i}" for i in range(50)], 40)) for _ in range(5)]
    rows = []
    for i in range(120):
        words = list(base[i % 5])
        for p in rng.choice(40, int(rng.integers(0, 3)), replace=False):
            words[p] = f"e{rng.integers(4)}"
        rows.append((i, " ".join(words[: int(rng.integers(30, 41))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_components(df).collect())
    assert got == brute_components(rows)


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([("i", BASE), ("short", "Short, ONE!"), ("none", None), (None, "x"), ("blank", "...")], "item_id string, text string")
    found = decontaminate.find_passages(docs, items)
    assert found.count() == len(ROWS) and decontaminate.find_passages(none, items).count() == 0
    by = {r.doc_id: r for r in found.collect()}
    assert by[6]["items"] == ["short"] and by[6].runs == [[0, 2]] and by[3].n_words == 0
    assert by[1]["items"] == ["i"] and by[1].runs == [[0, 3 * len(BASE.split())]] and by[8]["items"] == []


def test_decontaminate_by_items_without_an_id(spark, monkeypatch, tmp_path):
    d, items = [(1, "a b c d e f"), (2, "b c d x x"), (3, "x x x")], [(None, "b c d"), (None, "e f"), (7, "a b c"), (8, None), (None, None)]
    for name, key, rows in (("documents", "doc_id", d), ("benchmark", "item_id", items)):
        pq.write_table(pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), f"{tmp_path}/{name}.parquet")
    docs, tests = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("documents", "benchmark"))
    for size in (decontaminate.BLOCK_BYTES, 5):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = {r.doc_id: (r.runs, r["items"]) for r in decontaminate.find_passages(docs, tests).collect()}
        assert got == {1: ([[0, 6]], ["7", None]), 2: ([[0, 3]], [None]), 3: ([], [])}
        same(decontaminate.op3_decontaminate(spark, str(tmp_path)), decontaminate.OP3_SQL, str(tmp_path))


def test_decontaminate_in_blocks_and_by_proximity(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b x c d")], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "c d e", "z z", "b c d"])], "item_id long, text string")
    whole = sorted(map(str, decontaminate.find_passages(d, items, slop=1).collect()))
    assert sorted(map(str, decontaminate.find_passages(d, items, slop=1, store=False, shard_tokens=4).collect())) == whole
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 5)
    assert sorted(map(str, decontaminate.find_passages(d, items, slop=1, store=False).collect())) == whole
    assert sorted(map(str, decontaminate.find_passages(d, items, slop=1).collect())) == whole
    assert [r.near_items for r in decontaminate.find_passages(d, items, slop=1).filter("doc_id = 2").collect()] == [["0", "3"]]


def test_proximity_is_the_same_in_any_shard(spark, monkeypatch):
    rng = np.random.default_rng(5)
    d = [(i, " ".join(rng.choice(list("abcdefg"), int(rng.integers(0, 9)), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]))) for i in range(80)]
    tests = [(i, " ".join(rng.choice(list("abcdefg"), 4))) for i in range(25)]

    def near(words, window, slop):
        return any(all(any(w == x and abs(p - s - k) <= slop for p, x in enumerate(words)) for k, w in enumerate(window)) for s in range(-slop - 4, len(words) + slop + 1))

    items = spark.createDataFrame(tests, "item_id long, text string")
    for slop, parts, size in ((1, 1, 1_000_000), (1, 7, 10), (2, 3, 25)):
        monkeypatch.setattr(decontaminate, "SHARD_TOKENS", size)
        found = decontaminate.find_passages(spark.createDataFrame(d, "doc_id long, text string").repartition(parts), items, slop=slop).collect()
        expected = {i: sorted(str(j) for j, u in tests if near(t.split(), u.split(), slop)) for i, t in d}
        assert {r.doc_id: r.near_items for r in found} == expected and any(expected.values())


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a \\ <s>[INST] <r> [/INST]"), (1, 1, "assistant", "</s>\\\n"), (1, 1, "assistant", "</s>\\\n"), (2, 0, "tool [IS] x", None), (2, None, None, ""), (None, 0, "user", "é" * 100_000), (3, 0, "system", " [/INST] "), (3, 1, "user", "q"), (3, 2, "assistant", "r")]
    turns = spark.createDataFrame([(*r, 5, 5) for r in rows], "conv_id long, turn long, role string, text string, segments int, position int").withColumns({c: F.lit(5) for c in ("loss", "in_order", "valid", "n_turns", "formatted_chars", "key", "row")})
    got = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(turns)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[conv].n_turns == len(own)
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and got[conv].loss_chars == len(learned)
    assert got[3].valid and not got[1].valid and not got[2].valid
    assert chat_format.read_chats(chat_format.format_chats(turns.limit(0))).count() == 0


def test_license_scan(spark, sf, docs, none):
    assert license_scan.scan_licenses(docs).count() == len(ROWS) and license_scan.scan_licenses(none).count() == 0
    texts = ["Under the MIT License; under the mit license", "the Apache License, version 2 or CC-BY-NC", "permission is hereby granted free of charge to any person obtaining a copy of this great software and associated documentation files", "gnu general public", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert [(p.start, p.label) for p in got[0].places] == [(0, "mit"), (4, "mit")]
    assert [(p.start, p.label) for p in got[1].places] == [(1, "apache-2"), (6, "cc-by-nc")]
    assert [s.label for s in got[2].spans] == ["mit"] and got[3].spans == [] and got[4].n_words == 0
    whole = [(i, f"before {t} after") for i, (t, _) in enumerate(license_scan.TEMPLATES)]
    labels = {r.doc_id: [s.label for s in r.spans] for r in license_scan.scan_licenses(spark.createDataFrame(whole, "doc_id long, text string")).collect()}
    assert labels == {i: [x] for i, (_, x) in enumerate(license_scan.TEMPLATES)} and len({x for _, x in license_scan.TEMPLATES}) >= 15
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    for row in real(spark, sf).select("text").collect():
        words = decontaminate.tokens(row.text.encode())
        base = [(i, k) for k, (p, _) in enumerate(license_scan.PHRASES) for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
        assert scanner.scan(words)[0] == sorted(base)


def test_license_runs_and_places_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        templates = [(" ".join(rng.choice(list("abc"), int(rng.integers(4, 14)))), str(k)) for k in range(3)]
        words = [w.encode() for w in rng.choice(list("abcx"), 40, p=[0.32, 0.32, 0.32, 0.04])]
        scanner = license_scan.Scanner([("a b", "p")], templates)
        inside = [tuple(t.encode().split()) for t, _ in [("a b", "p"), *templates]]
        held = {t[i:j] for t in inside for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        longest = [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in held), default=0) for i in range(len(words))]
        ends = [i for i, n in enumerate(longest) if n >= license_scan.RUN and (i + 1 == len(words) or longest[i + 1] <= n)]
        places, runs = scanner.scan(words)
        assert [(a, b) for a, b, _ in runs] == [(i + 1 - longest[i], i) for i in ends]
        assert places == [(i, 0) for i in range(39) if words[i : i + 2] == [b"a", b"b"]]
        for a, b, state in runs:
            n = b - a + 1
            expected = {k: [i + n - 1 for i in range(len(t) - n + 1) if t[i : i + n] == tuple(words[a : b + 1])] for k, t in enumerate(inside)}
            assert scanner.automaton.at[state] == {k: v for k, v in expected.items() if v}
    repeated = license_scan.Scanner([], [("a b c d x x x x x x x x x x a b c d e f g h", "t")])
    assert [s[3] for s in repeated.spans(repeated.scan([w.encode() for w in "a b c d x x x x x x x x x x a b c d q e f g h".split()])[1], 0.9)] == [1.0]


def test_token_counts_with_a_tokenizer_that_keeps_space(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.drops_space(public_tokenizers.path("word_bpe_49k.json")) and not token_counts.drops_space(path)
    texts = ["a  b\n\n c", " ", "it's  1 2", "x" * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    plain = Tokenizer.from_file(path)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path).collect()} == {i: len(plain.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}


def test_token_counts(spark, sf, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.count_tokens(none, path).count() == 0
    plain = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(100, "a<|endoftext|>b <|start oftext|>  é x y é ́ 12 it's 's")], "doc_id long, text string")
    for df in (docs, extra, real(spark, sf)):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in token_counts.count_tokens(df, path).collect():
            assert r.n_tokens == len(plain.encode(texts[r.doc_id], add_special_tokens=False)) and r.n_bytes == len(texts[r.doc_id].encode())


def test_language_id(spark, sf, docs, none):
    model = language_id.train(real(spark, sf))
    got = language_id.identify(docs, model)
    assert got.count() == len(ROWS) and language_id.identify(none, model).count() == 0
    by = {r.row.doc_id: r for r in got.collect()}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 9)) and by[8].lang_pred == "de"
    empty = language_id.train(none)
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    rows = queries.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").filter("held_out").join(real(spark, "/root/testdata/sf0.01"), "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_numbers_and_of_null_ids(spark, tmp_path):
    rows = [(1, "² ½ ① Ⅷ"), (None, "the cat and the dog"), (3, "der Hund und die Katze"), (4, "ª"), (5, "the bird and the cat")]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": ["en", "en", "de", "en", "en"]})
    pq.write_table(table, f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language_id.op7_language_id(spark, str(tmp_path)).collect()}
    assert got[1].lang_pred == "und" and got[1].languages == "" and got[4].lang_pred != "und" and got[None].held_out is False and got[3].lang_pred == "de"


def test_language_shares_maximise_the_likelihood():
    rng = np.random.default_rng(4)
    log_p = np.log(rng.dirichlet(np.ones(6), 3))
    for _ in range(20):
        counts = rng.integers(1, 30, 6)
        for chosen in ([0, 1], [1, 2], [0, 2]):
            share, best = language_id.shares(np.exp(log_p[chosen]), counts)
            grid = [counts @ np.log(w * np.exp(log_p[chosen[0]]) + (1 - w) * np.exp(log_p[chosen[1]])) for w in np.linspace(0, 1, 1001)]
            assert abs(share.sum() - 1) < 1e-9 and best <= max(grid) + 1e-6 and best > max(grid) - 0.3


def test_language_mixture_finds_both_languages(spark, sf):
    d = real(spark, sf)
    model = language_id.train(d)
    text = {lang: " ".join(r.text for r in d.filter((F.col("lang") == lang) & (F.length("text") > 500)).limit(3).collect())[:2000] for lang in ("en", "fr")}
    found = dict(model.mixture(language_id.grams(text["en"] + " " + text["fr"])))
    assert set(found) == {"en", "fr"} and all(0.3 < v < 0.7 for v in found.values())
    assert [x for x, _ in model.mixture(language_id.grams(text["fr"]))] == ["fr"]


def test_quality_classifier(spark, docs, none):
    pages = spark.createDataFrame([(1, "http://a/b?c", "<p>x"), (1, None, None), (None, "u", "h")], "page_id long, url string, html string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    few = quality_classifier.classify_quality(docs, pages, marks)
    assert {r.score for r in few.collect()} == {0.5} and few.count() == len(ROWS)
    assert quality_classifier.classify_quality(none, pages, marks).count() == 0
    sf = "/root/testdata/sf0.01"
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "pages", "labels")}
    train = t["labels"].filter("crc32(cast(doc_id as string)) % 3 > 0")
    got = quality_classifier.classify_quality(t["documents"], t["pages"], train).join(t["labels"].join(train, "doc_id", "left_anti"), "doc_id").collect()
    assert len(got) > 80 and sum((r.score >= 0.5) == (r.quality == 1) for r in got) / len(got) > 0.95


def test_co_training_against_one_machine(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 600)
    views = [rng.normal(y[:, None] * 1.5, 1, (600, k)) for k in (3, 2)]
    rows = [(i, v.tolist(), u.tolist()) for i, (v, u) in enumerate(zip(views[0][100:], views[1][100:]))]
    df = spark.createDataFrame(rows, "doc_id long, text_view array<float>, meta_view array<float>").repartition(5)
    labelled, pool = [v[:100] for v in views], [v[100:].astype(np.float32).astype(float) for v in views]
    model = quality_classifier.co_train(labelled, y[:100].astype(float), df, 500)
    fit, good = np.arange(100) % 4 != 3, y[:100].mean()
    own, got = [quality_classifier.Logistic.fit(x[fit], y[:100][fit]) for x in labelled], [np.full(500, np.nan) for _ in range(2)]
    for r in model.rounds:
        assert all(np.allclose(a.weights, b.weights, atol=1e-3) for a, b in zip(own, r.views))
        for k in (0, 1):
            for label, at in quality_classifier._bins(r.views[k], pool[k]).items():
                free = np.isnan(got[1 - k])
                chosen = free & (at >= 0) & (at >= r.least[k, label])
                most = max(1.0, quality_classifier.PER_ROUND * 500 * (good if label else 1 - good))
                assert chosen.sum() <= most or len(set(at[chosen])) == 1
                got[1 - k][chosen] = label
        x = [np.r_[labelled[k][fit], pool[k][~np.isnan(got[k])]] for k in (0, 1)]
        t = [np.r_[y[:100][fit], got[k][~np.isnan(got[k])]] for k in (0, 1)]
        own = [quality_classifier.replace(own[k], weights=quality_classifier._newton(own[k].inputs(x[k]), t[k])) for k in (0, 1)]
    assert len(model.rounds) == quality_classifier.ROUNDS and all((~np.isnan(g)).sum() > 20 for g in got)
    assert ((model.scores(pool)[0] >= 0.5) == y[100:]).mean() > 0.85


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, due = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        left = due - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over


def test_mixing(spark, docs, none):
    assert mixing.mix(none).count() == 0
    assert sum(r.taken for r in mixing.mix(docs.filter("doc_id IN (3, 4, 5)")).collect()) == 0
    for df in (docs, real(spark, "/root/testdata/sf0.01")):
        first, again = ([tuple(r) for r in mixing.mix(df).orderBy("doc_id", "source", "size", "taken").collect()] for _ in range(2))
        assert first == again and len(first) == df.count()
        sizes, taken, target, largest = {}, {}, {}, {}
        for _, source, size, source_size, due, rate, copies, took in first:
            sizes[source], taken[source], target[source] = sizes.get(source, 0) + size, taken.get(source, 0) + took, due
            largest[source] = max(largest.get(source, 0), size)
            assert took == copies * size and 0 <= copies <= 2 and 0 <= rate <= 2
        assert {s: round(v, 6) for s, v in brute_targets(sizes).items()} == {s: round(v, 6) for s, v in target.items()}
        for s, due in target.items():
            own = np.array([size for _, source, size, *_ in first if source == s], float)
            rates = np.array([rate for _, source, _, _, _, rate, _, _ in first if source == s])
            if 0 < due < 2 * sizes[s] * (1 - 1e-6):
                low, high = -1e5, 1e5
                for _ in range(200):
                    middle = (low + high) / 2
                    tilt = np.minimum(2, np.exp(np.minimum(middle * own / own.mean(), 700)))
                    low, high = (middle, high) if (tilt * own).sum() < due else (low, middle)
                assert np.allclose(rates[own > 0], tilt[own > 0], atol=1e-3)
            assert taken[s] <= due + 1e-6 and due - taken[s] <= (0.02 * due if len(first) > 100 else largest[s])


def test_mixing_tells_equal_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 7)
    rows = [(None, "a b c d", "s1")] * 500 + [(i, "a b " * (i % 5), "s2") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted((str(r.doc_id), r.source, r.size, r.copies) for r in mixing.mix(d).collect()) for d in (df, df.repartition(5))]
    copies = [c for i, s, _, c in runs[0] if s == "s1"]
    assert runs[0] == runs[1] and len(runs[0]) == 700 and len(copies) == 500 and len(set(copies)) == 2
    due = mixing.mix(df).filter("source = 's1'").first().target
    assert due - 4 <= 4 * sum(copies) <= due


def test_pii(spark, docs, none):
    assert pii.find_pii(none).count() == 0 and pii.find_pii(docs).count() == len(ROWS)
    texts = {
        1: "é a.b@c.de.fr_x@y.org 1.2.3.4.5 256.1.1.1 0001.2.3.4", 2: "card 4111 1111 1111 1111, 4111-1111-1111-1112 and +1 (234) 555-6789, +12",
        3: "IBAN GB82WEST12345698765432 not GB83WEST12345698765432", 4: "ssn 123-45-6789 but 123-45-6789 alone later on in a text far from it 987-65-4321", 5: 'token = "abcdefgh12"', 6: None,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [(f.kind, f.value) for f in r.findings] for r in pii.find_pii(df).collect()}
    assert got[1] == [("email", "a.b@c.de.fr"), ("email", "_x@y.org"), ("ip", "1.2.3.4"), ("ip", "0001.2.3.4")]
    assert got[2] == [("card", "4111 1111 1111 1111"), ("phone", "+1 (234) 555-6789")]
    assert got[3] == [("iban", "GB82WEST12345698765432")] and got[4][0] == ("ssn", "123-45-6789") and ("ssn", "987-65-4321") not in got[4]
    assert got[5] == [("secret", 'token = "abcdefgh12"')] and got[6] == []
    for r in pii.find_pii(df).collect():
        assert all(r.text[f.start : f.end] == f.value for f in r.findings)
    masked = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    assert masked[2].startswith("card <CARD>, 4111-1111-1111-1112 and <PHONE>, +12") and masked[6] is None
    assert pii.mask_pii(docs).columns == docs.columns and pii.mask_pii(docs).count() == len(ROWS)


def test_pii_is_linear_in_long_runs(spark):
    long = ["a" * 300_000, "1" * 300_000, "1 " * 100_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert pii.find_pii(df).count() == len(long) and pii.find_pii(df).select(F.sum(F.size("findings"))).first()[0] is not None


def test_pii_of_many_matches(spark):
    text = "é mail a.b@c.de x@y.org,1.2.3.4 +1 (234) 555-6789 " * 1500
    df = spark.createDataFrame([(1, text), (2, "x" * 700 + text[:600])], "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)]
        assert [(f.start, f.end) for f in r.findings if f.kind == "email"] == emails
        assert all(r.text[f.start : f.end] == f.value for f in r.findings)
    masked = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    assert masked[1] == "é mail <EMAIL> <EMAIL>,<IP> <PHONE> " * 1500
    assert masked[2] == "x" * 700 + pii.mask_pii(spark.createDataFrame([(text[:600],)], "text string")).first().text


def test_pipeline_on_no_documents(spark, sf):
    now = real(spark, sf).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0


def test_pipeline_stages(spark, sf):
    d = real(spark, sf)
    extra = spark.createDataFrame(ROWS, DOCS).filter("text IS NULL OR length(text) < 1000").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    d = d.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "mixing"]
    now = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, now, sf).collect(), d.schema)
        assert kept.columns == corpus_pipeline.COLUMNS
        before, after = {r.doc_id for r in now.collect()}, {r.doc_id for r in kept.collect()}
        if name == "language_id":
            gone = {r.doc_id for r in now.collect() if not re.search(r"[^\W\d_]", r.text or "")}
            assert after == before - gone
        if name == "near_duplicates":
            parts = {i: c for i, _, c in brute_components([(r.doc_id, r.text) for r in now.collect()])}
            assert {str(i) for i in after if i is not None} == {i for i, c in parts.items() if i == c and i != "None"}
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.find_passages(now, spark.read.parquet(f"{sf}/benchmark.parquet")).withColumn("n_hit", decontaminate.n_hit()).filter(decontaminate.contaminated()).collect()}
            assert bad and after == before - bad
        if name == "pii":
            assert after == before and pii.find_pii(kept).filter(F.exists("findings", lambda f: f["base"])).count() == 0
        now = kept
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    sizes = {}
    for r in now.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORDS.findall(r.text))
    due = brute_targets(sizes)
    assert len(mixed) == now.count() and all(abs(r.target - due[r.source]) < 1e-6 and r.taken == r.copies * r.size for r in mixed)
    for s, t in due.items():
        taken = sum(r.taken for r in mixed if r.source == s)
        assert taken <= t + 1e-6 and t - taken <= max(r.size for r in mixed if r.source == s)
    assert corpus_pipeline.run(spark, sf).count() > 0
