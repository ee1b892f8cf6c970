"""Fingerprints, spelling variants and target resampling against brute force, and odd inputs."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lograft.llm import fingerprints, reweighting, spelling
from lograft.llm.queries import QUERIES

from .conftest import SF_DIR

PROSE = "the quick brown fox jumps over the lazy dog and runs away from here because it is late, "
ODD_TEXTS = [
    "", "a", "abc", "x" * 19, "y" * 20, "z" * 5000, PROSE * 3, PROSE * 200, "中文字符" * 30, "😀é\n" * 2000,
    "naïve café déjà vu " * 9, "tab\tand\x00null and \x7f end" * 4,
]


def plain_anchors(text):
    k, s = fingerprints.K, fingerprints.S
    crc = [zlib.crc32(text[i : i + s].encode()) for i in range(len(text) - s + 1)]
    found = []
    for i in range(len(text) - k + 1):
        inner = crc[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            parts = [crc[i + j] for j in (0, 5, 10, 15)]
            found.append((i, sum(c * 31**n for n, c in enumerate(parts)) % 1_048_573))
    return found


def plain_tokens(text):
    if not text:
        return []
    if len(text) < fingerprints.K:
        return [zlib.crc32(text.encode()) % 1_048_573 * 16]
    found = plain_anchors(text)
    gaps = [min(b[0] - a[0], 15) for a, b in zip(found, found[1:])] + [0]
    return [h * 16 + g for (_, h), g in zip(found, gaps[: len(found)])]


def plain_print(text):
    return base64.b64encode(b"".join(t.to_bytes(3, "big") for t in plain_tokens(text))).decode()


def plain_likeness(one, other):
    a, b = set(plain_tokens(one)), set(plain_tokens(other))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 64)
    monkeypatch.setattr(fingerprints, "STRETCH", 1000)
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*ODD_TEXTS, None])], "id int, text string, fingerprint string")
    got = {r.id: r.fingerprint for r in fingerprints.fingerprint(rows).collect()}
    assert got == {i: plain_print(t or "") for i, t in enumerate([*ODD_TEXTS, None])}


def test_an_anchor_is_never_far(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    places = [i for i, _ in plain_anchors(text)]
    assert max(b - a for a, b in zip(places, places[1:])) <= fingerprints.K - fingerprints.S
    assert 0.10 < len(places) / len(text) < 0.16
    moved = set(plain_tokens("something else in front. " + text))
    assert len(moved & set(plain_tokens(text))) > 0.99 * len(set(plain_tokens(text)))


def test_edited_texts_and_next_documents(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op11_fingerprints"](spark, SF_DIR).collect()}
    order = sorted(texts)
    near, far = [], []
    for n, doc in enumerate(order):
        text, after = texts[doc], texts[order[(n + 1) % len(order)]]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        row = got[doc]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if n % 10 == 0:
            assert row.fingerprint == plain_print(text) and row.edited_fingerprint == plain_print(edited)
            assert row.near_edited == plain_likeness(text, edited) and row.near_next == plain_likeness(text, after)
        if len(text) > 400 and set(text.split()).isdisjoint(after.split()):
            far.append(row.near_next)
        if len(text) > 400:
            near.append(row.near_edited)
    assert len(got) == len(texts) and np.median(near) > 0.6 and max(far, default=0) < 0.05


def test_documents_of_odd_ids_and_repeated_rows(spark, odd_documents, no_documents):
    rows = fingerprints.compare_edited(odd_documents.withColumn("digest", F.lit(1)).withColumn("bucket", F.lit("x")))
    got = rows.collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.doc_id is not None) == [
        (False, d) for d in (1, 1, 2, 3, 4, 5, 6, 7, 8, 9)
    ] and len(got) == 11
    assert len({r for r in got if r.doc_id == 1}) == 1
    assert all(r.near_edited == 1.0 and r.fingerprint == "" for r in got if r.n_chars == 0)
    assert fingerprints.compare_edited(no_documents).count() == 0
    # One id for most rows, and many equal rows: no bucket holds them all, and the order is still whole.
    many = [(7, f"text number {n} of many that share an id") for n in range(400)] + [(9, "the same again and again")] * 300
    many = spark.createDataFrame([*many, (None, "no id, but some words"), (1, "first")], "doc_id long, text string")
    pairs = fingerprints.with_next(many)
    order = sorted({(-(2**63) if d is None else d, hashlib.md5(t.encode()).hexdigest(), t) for d, t in many.collect()})
    following = {t: order[(n + 1) % len(order)][2] for n, (_, _, t) in enumerate(order)}
    rows = pairs.select("text", "next_text").collect()
    assert len(rows) == 702 and all(following[t] == n for t, n in rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = fingerprints.with_next(many).where("doc_id = 7").select(F.spark_partition_id().alias("part"))
        assert parts.distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def one_edit(one, other):
    """Whether exactly one code point inserted, deleted or replaced makes one of the other."""
    if len(one) > len(other):
        one, other = other, one
    if len(other) - len(one) > 1 or one == other:
        return False
    at = next((i for i, (a, b) in enumerate(zip(one, other)) if a != b), len(one))
    return one[at + (len(one) == len(other)) :] == other[at + 1 :]


WORDS = st.text("abcàz", min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_one_edit(one, other):
    shorter = {one[:i] + one[i + 1 :] for i in range(len(one))}
    replaced = {one[:i] + c + one[i + 1 :] for i in range(len(one)) for c in "abcàz"} - {one}
    longer = {one[:i] + c + one[i:] for i in range(len(one) + 1) for c in "abcàz"}
    near = other in shorter | replaced | longer
    assert one_edit(one, other) == near
    assert list(spelling.near_pairs([one], [other])) == [(one, other)] * near
    assert list(spelling.near_pairs([one], [])) == []


def test_near_words_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 8)
    rng = random.Random(5)
    words = {"".join(rng.choice("abdegàß") for _ in range(rng.randint(3, 6))) for _ in range(700)}
    words |= {"x" * 70_000, "x" * 70_001}
    got = spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    expected = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(expected) > 1000 and {tuple(r) for r in got} == expected


def test_word_counts_cut_no_word(spark, monkeypatch, odd_documents, no_documents):
    monkeypatch.setattr(spelling, "PART_CHARS", 7)
    text = "Straße ÀÉ×÷ naïve-NAÏVE x1y2 " * 50 + "q" * 300
    got = dict(map(tuple, spelling.count_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), 1, False).collect()))
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert got == Counter(re.findall("[A-Za-zÀ-ÿ]+", lower))
    assert spelling.group_variants(odd_documents.withColumn("n", F.lit("clash")), least_length=4).count() > 0
    assert spelling.group_variants(no_documents).count() == 0


def test_chains_of_forms_and_ties(spark):
    counts = {"langwort": 1000, "langwor": 200, "langwo": 40, "langwx": 8, "langwy": 8, "anderes": 25, "andares": 125, "andbres": 125}
    text = " ".join(w for word, n in counts.items() for w in [word] * n)
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame([(None, text)], "doc_id long, text string"), damage=False).collect()}
    assert [(got[w].form, got[w].root) for w in ("langwo", "langwx", "langwort")] == [
        ("langwor", "langwort"), ("langwo", "langwort"), (None, "langwort"),
    ]
    assert got["anderes"].form == "andares" and got["anderes"].form_n == 125 and got["anderes"].n_near == 2
    assert got["andares"].form is None and got["andares"].n_near == 2


def plain_features(text, longest):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1))


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("batch", [16, 4 << 20])
def test_features_by_automaton(monkeypatch, longest, batch):
    monkeypatch.setattr(reweighting, "BATCH_BYTES", batch)
    texts = [None, *ODD_TEXTS, "a-b  c", "long " + "w" * 700 + " word " + "W" * 700 + " end", "same " * 5]
    got = {n: Counter() for n in range(len(texts))}
    for _, rows, crcs in reweighting.features(pa.array(texts, pa.string()), longest):
        for row, crc in zip(rows.tolist(), crcs.tolist(), strict=True):
            got[row][crc] += 1
    assert got == {n: plain_features(t or "", longest) for n, t in enumerate(texts)}


def test_joined_crcs():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 256, 70_001):
        one, other = rng.bytes(13), rng.bytes(size)
        joined = reweighting.join_crc(np.array([zlib.crc32(one)]), np.array([zlib.crc32(other)]), np.array([size]))
        assert joined.tolist() == [zlib.crc32(one + other)]


def test_resampling_against_plain_python(spark, texts):
    target = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{SF_DIR}/benchmark.parquet'").fetchall()]
    for longest, buckets, share in ((1, 10_000, 10), (2, 512, 33)):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        wanted = spark.createDataFrame([(t,) for t in target], "text string")
        got = {r.doc_id: r for r in reweighting.resample(docs, wanted, longest, buckets, share).collect()}
        found = {d: plain_features(t, longest) for d, t in texts.items()}
        counts, aims = Counter(), Counter()
        for feature in found.values():
            for crc, n in feature.items():
                counts[crc % buckets] += n
        for text in target:
            for crc, n in plain_features(text, longest).items():
                aims[crc % buckets] += n
        s_all, t_all = sum(counts.values()) + buckets, sum(aims.values()) + buckets
        scores, eligible = {}, []
        for doc, feature in found.items():
            total = sum(n * math.floor(1000 * math.log((aims[c % buckets] + 1) * s_all / ((counts[c % buckets] + 1) * t_all))) for c, n in feature.items())
            number = sum(feature.values())
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            weight = total // number if number else 0
            scores[doc] = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            assert (got[doc].n_features, got[doc].weight, got[doc].score) == (number, weight, scores[doc])
            if sum(plain_features(texts[doc], 1).values()) >= 20:
                eligible.append(doc)
        drawn = sorted(eligible, key=lambda d: (-scores[d], d))[: share * len(eligible) // 100]
        assert {d: r.rank for d, r in got.items() if r.rank} == {d: n + 1 for n, d in enumerate(drawn)}


def test_resampling_of_odd_documents(spark, odd_documents, no_documents):
    rows = reweighting.resample(odd_documents.withColumn("weight", F.lit("clash")), odd_documents, share=100).collect()
    ranks = sorted(r.rank for r in rows if r.rank)
    assert len(rows) == 11 and ranks == list(range(1, len(ranks) + 1)) and len(ranks) >= 4
    assert all(r.weight == 0 and r.n_features == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert reweighting.resample(no_documents, odd_documents).count() == 0
    assert reweighting.resample(odd_documents, no_documents).count() == 11
    same = spark.createDataFrame([(5, PROSE * 3)] * 500, "doc_id long, text string")
    assert sorted(r.rank for r in reweighting.resample(same, no_documents, share=50).where("rank > 0").collect()) == list(range(1, 251))


def test_near_copies_go_by_row_not_by_id(spark):
    from lograft.llm import near_duplicates as nd

    a, b, other = (" ".join(f"{p}{n}" for n in range(60)) for p in "abc")
    def kept(*rows):
        return sorted(map(tuple, nd.keep_one(spark.createDataFrame(list(rows), "doc_id long, text string")).collect()), key=str)
    assert kept((1, a), (None, a), (None, other)) == [(1, a), (None, other)]
    assert kept((1, a), (5, b), (5, a), (9, b), (5, b)) == [(1, a), (5, b)]
    assert kept((3, a + " more"), (2, a), (2, other), (4, None), (4, ""), (4, None)) == sorted(
        [(2, a), (2, other), (4, None), (4, "")], key=str
    )


def test_dictionaries_of_repeated_rows_and_common_heads(spark):
    from lograft.llm import language

    head = "lizenz kopf zeile " * 60
    rows = [(7, "gleicher text immer wieder " * 40, "de")] * 3000
    rows += [(100 + n, head + f"wort{n} satz{n} " * 200, "de") for n in range(50)] + [(900 + n, "1 2 3", "fr") for n in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.train_dictionaries(docs)
    assert set(found) == {"de"} and len(found["de"]) <= language.DICTIONARY_DOCS * (language.DICTIONARY_CHARS + 1)
    assert found["de"].count(b"lizenz") < 0.6 * found["de"].count(b"satz")


def test_mix_of_rows_without_ids_comes_near_its_target(spark):
    from lograft.llm import mixing

    rows = [(None, " ".join(f"w{n}x{i}" for i in range(100)), "a") for n in range(1000)] + [(n, "wort " * 100, "b") for n in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 100
