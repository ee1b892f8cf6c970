"""Token counts, packing, quality, language and rules, against brute force on small tables."""

import bisect
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lograft.llm import language, packing, quality, rules, tokens
from lograft.llm.queries import QUERIES

from .conftest import SF_DIR

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "a b c d", "é ́x", "<|endoftext|>x<|startoftext|>", "it's  DON'T\r\n\x0bx\x1cy", "ÀÉ ß İ Σς", "中文 字", "😀" * 5,
    "word" * 5000, "a " * 5000, "x\n\n  y", "᠎z",
]


def column(values):
    return pa.array(values, pa.string())


def test_token_lengths_of_odd_texts():
    exact = Tokenizer.from_file(WORDS).encode_batch([t or "" for t in ODD], add_special_tokens=False)
    assert tokens.lengths(column(ODD), WORDS).tolist() == [len(e) for e in exact]


def test_only_short_words_are_remembered():
    text = "kurz " + "x" * 100_000 + " kurz"
    exact = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False)
    for _ in range(2):
        assert tokens.lengths(column([text]), WORDS).tolist() == [len(exact)]
    assert max(map(len, tokens.word_tokenizer(WORDS)[1])) <= tokens.MEMO_CHARS


def test_token_counts(spark, texts, odd_documents, no_documents):
    tokenizer = Tokenizer.from_file(WORDS)
    got = QUERIES["op4_token_counts"](spark, SF_DIR).collect()
    expected = {d: len(tokenizer.encode(t, add_special_tokens=False)) for d, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in got} == expected and len(got) == len(expected)
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in got)
    odd = tokens.count_tokens(odd_documents.withColumn("n_tokens", F.lit("clash")), WORDS).collect()
    assert len(odd) == 11 and {r.doc_id: r.n_tokens for r in odd if r.doc_id in (3, 4, 5)} == {3: 0, 4: 0, 5: 0}
    assert tokens.count_tokens(no_documents, WORDS).count() == 0
    assert tokens.token_totals(tokens.count_tokens(odd_documents, WORDS), "source").count() == 5


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_ids_of_odd_texts(ranks):
    tokenizer = Tokenizer.from_file(BYTES)
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert [ids.tolist() for ids in packing.token_ids(column(ODD), BYTES, ranks)] == expected


@pytest.mark.parametrize("text", [" " * 400_000, "\n" * 400_000, "a" + "\t " * 200_000 + "b", "^" * 400_000, "x" * 400_000])
def test_ids_of_very_long_runs(text):
    expected = Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids
    assert [ids.tolist() for ids in packing.token_ids(column([text]), BYTES, RANKS)] == [expected]


def tightest(sizes, window):
    """Best fit by looking at every open window."""
    left, placed = [], []
    for size in sizes:
        fits = [w for w, room in enumerate(left) if room >= size]
        if not fits:
            left.append(window)
            fits = [len(left) - 1]
        room = min(left[w] for w in fits)
        placed.append(room - size)
        left[next(w for w in fits if left[w] == room)] -= size
    return placed, len(left)


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    sizes = sorted(rng.integers(1, 65, 500).tolist(), reverse=True)
    placed, offsets = packing.best_fit_decreasing(sizes, 64)
    rooms = [64 - o - s for o, s in zip(offsets, sizes, strict=True)]
    assert (rooms, max(placed) + 1) == tightest(sizes, 64)


def check_packing(rows, expected, window=2048):
    """Every id of every document in exactly one piece; sequences without gaps or overlap."""
    by_doc, by_sequence = Counter(), {}
    for r in rows:
        whole = np.array(expected[r.doc_id], "<u4")
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        by_doc[r.doc_id] += r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return by_doc, by_sequence


def test_packing(spark, texts, odd_documents, no_documents):
    tokenizer = Tokenizer.from_file(BYTES)
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t in texts.items()}
    by_doc, by_sequence = check_packing(QUERIES["op8_packing"](spark, SF_DIR).collect(), ids)
    assert by_doc == {d: len(i) for d, i in ids.items()}
    assert sum(map(len, ids.values())) / (2048 * len(by_sequence)) > 0.98
    rows = odd_documents.collect()
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows}
    clash = odd_documents.withColumn("start", F.lit("x")).withColumn("sequence_id", F.lit(None).cast("string"))
    packed = packing.pack(clash, BYTES, RANKS, pieces_per_block=4)
    by_doc, _ = check_packing(packed.collect(), ids)
    assert by_doc == {d: len(i) * (2 if d == 1 else 1) for d, i in ids.items()}
    again = packing.pack(clash, BYTES, RANKS, pieces_per_block=4)
    assert sorted(packed.collect(), key=str) == sorted(again.collect(), key=str)
    assert packing.sequence_fill(packed).first().n_tokens == sum(by_doc.values())
    assert packing.pack(no_documents, BYTES, RANKS).count() == 0


def test_equal_rows_fill_many_blocks(spark):
    rows = spark.createDataFrame([(5, "the same few words")] * 400 + [(None, None)] * 400, "doc_id long, text string")
    packed = packing.pack(rows, BYTES, RANKS, pieces_per_block=16).collect()
    blocks = Counter(r.sequence_id >> 32 for r in packed)
    assert len(packed) == 800 and len(blocks) > 40 and max(blocks.values()) < 48
    ids = Tokenizer.from_file(BYTES).encode("the same few words", add_special_tokens=False).ids + [1]
    by_doc, _ = check_packing(packed, {5: ids, None: [1]})
    assert by_doc == {5: 400 * len(ids), None: 400}


def plain_features(text):
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    lines = text.split("\n")
    n = max(len(words), 1)
    return {
        "log_words": np.log1p(len(words)),
        "upper": sum("A" <= c <= "Z" for c in text) / max(len(text.encode()) - sum(c in " \n" for c in text), 1),
        "pipes": text.count("|") / n,
        "repeated_neighbours": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "distinct_words": len(set(words)) / np.sqrt(n),
        "distinct_lines": len(set(lines)) / len(lines),
    }


def test_features_of_whole_texts(texts):
    some = [t for t in texts.values() if "\t" not in t][:60] + ["", "a | b | a\na | b"]
    got = quality.features(column(some))
    for row, text in zip(got, some, strict=True):
        for name, value in plain_features(text).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value), name
    assert quality.features(column([None])).tolist() == quality.features(column([""])).tolist()
    assert quality.features(column([])).shape == (0, len(quality.FEATURES))


def test_additive_model():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.7) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    model = quality.fit(x, y)
    fresh = rng.random((2000, 4))
    want = (fresh[:, 0] > 0.7) ^ (fresh[:, 1] > 0.5)
    assert ((model.score(fresh) >= 0.5) == want).mean() > 0.9 and any({a, b} == {0, 1} for a, b, _ in model.pairs)
    assert quality.fit(np.zeros((0, 4)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit(x, np.ones(3000)).score(x[:2]) > 0.9).all()


def test_quality(spark, odd_documents, no_documents):
    got = QUERIES["op7_quality_scores"](spark, "/root/testdata/sf0.01").collect()
    labels = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and len(got) == 1000
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    none = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd_documents, none)
    odd = quality.score_quality(odd_documents.withColumn("score", F.lit("clash")), model)
    assert odd.count() == 11 and {r.score for r in odd.collect()} == {0.5}
    assert quality.score_quality(no_documents, model).count() == 0


def plain_score(model, x):
    total = model.base
    for edges, entries, value in zip(model.edges, model.tables, x, strict=True):
        total += entries[bisect.bisect_right(list(edges), value)]
    for a, b, entries in model.pairs:
        total += entries[bisect.bisect_right(list(model.pair_edges[a]), x[a]), bisect.bisect_right(list(model.pair_edges[b]), x[b])]
    return 1 / (1 + math.exp(-total))


def test_quality_scores_from_the_tables(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, quality.training_labels(labels))
    assert model.tables and model.pairs
    got = {r.doc_id: r for r in QUERIES["op7_quality_scores"](spark, SF_DIR).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        want = plain_score(model, quality.features(column([text]))[0])
        assert got[doc].score == pytest.approx(want, abs=1e-9) and got[doc].predicted == (got[doc].score >= 0.5)


def test_languages_by_plain_compression(spark, texts):
    dictionaries = language.train_dictionaries(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    sizes = {}
    for lang, content in sorted(dictionaries.items()):
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=language.LEVEL)
        plain = zstandard.ZstdCompressionParameters.from_level(
            language.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        for doc, text in texts.items():
            data = text.lower().encode()
            blocks = [data[i : i + language.BLOCK_BYTES] for i in range(0, len(data), language.BLOCK_BYTES)]
            coder = zstandard.ZstdCompressor(dict_data=raw, compression_params=plain)
            sizes.setdefault(doc, {})[lang] = sum(len(coder.compress(b)) for b in blocks)
    for r in QUERIES["op10_language_id"](spark, SF_DIR).collect():
        if not any(c.isalpha() for c in texts[r.doc_id]):
            assert r.lang_pred == "und" and not r.accepted
            continue
        found = sizes[r.doc_id]
        best = min(found, key=found.get)
        lead = min(n for lang, n in found.items() if lang != best) - found[best]
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(found[best] - n) for n in found.values()))
        assert r.accepted == (lead >= max(8, 0.03 * found[best]) and r.score >= 0.6)


def test_languages(spark, odd_documents, no_documents):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_language_id"](spark, sf).collect()
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == 1000
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    dictionaries = language.train_dictionaries(spark.read.parquet(f"{sf}/documents.parquet"))
    assert set(dictionaries) == {"de", "en", "es", "fr"} and max(map(len, dictionaries.values())) < 150_000
    odd = language.identify(odd_documents.withColumn("lang_pred", F.lit(5)), dictionaries).collect()
    found = {r.doc_id: r.lang_pred for r in odd}
    assert [found[i] for i in (3, 4, 5, 8)] == ["und"] * 4 and found[1] == "en" and len(odd) == 11
    assert not any(r.accepted for r in odd if r.lang_pred == "und")
    assert {r.lang_pred for r in language.identify(odd_documents, {}).collect()} == {"und"}
    assert language.train_dictionaries(no_documents) == {} and language.identify(no_documents, dictionaries).count() == 0


def test_texts_of_no_clear_language_are_rejected_at_every_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dictionaries = language.train_dictionaries(docs)
    words = {lang: [] for lang in sorted(dictionaries)}
    for lang, text in duckdb.sql("SELECT lang, text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall():
        words[lang].extend((text or "").split())
    rng = np.random.default_rng(1)
    letters, rows = np.array(list("abcdefghijklmnopqrstuvwxyz")), []
    for n in (100, 500, 3000, 15_000):
        for _ in range(10):
            mixed = [w[rng.integers(len(w))] for w in (words[lang] for _ in range(n // 4) for lang in words)]
            random = ["".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(n)]
            rows += [(f"mixed {n}", " ".join(mixed)), (f"random {n}", " ".join(random))]
    got = language.identify(spark.createDataFrame(rows, "kind string, text string"), dictionaries).collect()
    accepted = Counter(r.kind for r in got if r.accepted)
    assert sum(accepted.values()) <= 2 and not any(kind.startswith("random") for kind in accepted), accepted
    clean = language.identify(docs.where("lang is not null and n_chars >= 100"), dictionaries)
    assert clean.where("accepted").count() >= 0.97 * clean.count()


def plain_measures(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}),
    )


def test_measures(spark, texts, odd_documents, no_documents):
    more = ["a b c a b c", "a a a a", "a b", "x\n\nx\n \n \nx", "a b c d a b", "  \x85 b"]
    every = list(texts.values()) + more
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[m] for m in rules.MEASURES) for r in rules.add_measures(df).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(every)}
    judged = rules.apply_rules(odd_documents.withColumns({"kept": F.lit("x"), "n_words": F.lit("y")})).collect()
    assert len(judged) == 11 and {r.doc_id: r.kept for r in judged if r.doc_id in (3, 4, 5, 6, 7)} == dict.fromkeys((3, 4, 5, 6, 7), False)
    assert rules.apply_rules(no_documents).count() == 0


def test_cascade_does_not_depend_on_the_order(spark, odd_documents):
    own = [rules.Rule("a", F.col("n_words") > 100), rules.Rule("b", F.col("n_symbols") > 0), rules.Rule("none", F.lit(None).cast("boolean"))]
    rows = rules.add_measures(odd_documents)
    got = [[r[0] for r in rows.orderBy("doc_id").select(rules.cascade(order)).collect()] for order in (own, own[::-1])]
    assert got[0] == got[1] and set(got[0]) == {True, False}
    assert {e.rule.name for e in rules.estimate(rows, own)} == {"a", "b", "none"}


def test_rules_come_by_rejection_per_step_among_what_is_left(spark):
    rows = spark.range(1000)
    chars = F.lit(3000)
    own = [
        rules.Rule("dear", F.col("id") % 2 == 0, 10 * chars),
        rules.Rule("cheap", F.col("id") % 2 == 0, chars),
        rules.Rule("repeats", F.col("id") % 4 == 0),  # rejects nothing that "half" lets pass
        rules.Rule("half", F.col("id") % 4 <= 1),
        rules.Rule("few", F.col("id") % 100 == 3),
        rules.Rule("none", F.lit(None).cast("boolean"), F.lit(None).cast("long")),
    ]
    for _ in range(10):
        found = rules.estimate(rows, own)
        assert [e.rule.name for e in found] == ["half", "few", "cheap", "none", "repeats", "dear"]
    assert [e.rejected for e in found[:3]] == pytest.approx([0.5, 0.02, 25 / 49])
    assert rules.estimate(rows, []) == []
    assert {e.rejected for e in rules.estimate(rows.limit(0), own)} == {0.0}


@pytest.mark.parametrize("name", ["op2_sharding", "op6_mix_sources", "op9_quality_rules", "op11_fingerprints"])
def test_no_python_in_native_plans(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "ExistingRDD", "CartesianProduct", "NestedLoop"))
