"""Sharding, mixing, near duplicates, neighbours and the pipeline, against brute force on small tables."""

from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lograft.llm import language, mixing, near_duplicates as nd, neighbours, quality, sharding
from lograft.llm.queries import QUERIES

from .conftest import SF_DIR
from .test_text_operators import check_packing


def test_lookup_table():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names)
    sizes = Counter(table)
    assert len(table) == 1009 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], slots=len(table))
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.15 * len(table)
    assert sharding.lookup_table(["only"]) == [0] * 101
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, slots=10**6)


def test_placing(spark, odd_documents, no_documents):
    placed = sharding.place(odd_documents.withColumn("slot", F.lit("clash")), ["a", "b", "c"], "doc_id")
    rows = placed.collect()
    assert len(rows) == 11 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.place(no_documents, ["a"], "doc_id").count() == 0
    assert sharding.shard_loads(placed, "n_chars").agg(F.sum("n_rows")).first()[0] == 11


def reshared(sizes, weights=(1, 2, 3), most=3):
    """By the rule itself: cut what is over the stop and deal it out again, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        live = sum(weight[s] for s in order if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else weight[s] * rest / live for s in order}
        over = {s for s in order if s not in stopped and target[s] >= most * sizes[s]}
        if not over:
            return target
        stopped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, None: 5, "é": 2}, {"a": 0, "b": 7}, {"z": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_mixing(spark, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 7)  # many key ranges
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).collect()
    assert got and sorted(got) == sorted(mixing.mix(docs).collect())
    sources = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sources.setdefault(r.source, []).append(r)
    targets = reshared({s: sum(r.size for r in rows) for s, rows in sources.items()})
    for source, rows in sources.items():
        assert rows[0].target == pytest.approx(targets[source])
        assert abs(sum(r.taken for r in rows) - targets[source]) <= max(r.size for r in rows) / 2 + 1
        assert {r.copies for r in rows if r.size} <= {int(targets[source] // sum(r.size for r in rows)) + k for k in (0, 1)}
    odd = mixing.mix(odd_documents.withColumns({"size": F.lit("x"), "taken": F.lit(1)})).collect()
    assert len(odd) == 11 and all(r.taken == 0 for r in odd if r.doc_id in (3, 4, 5))
    assert mixing.mixture(odd_documents).columns == odd_documents.columns
    assert mixing.mix(no_documents).count() == 0


def windows(text):
    words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute_links(texts):
    sets = {d: windows(t) for d, t in texts.items()}
    ids = sorted(sets)
    links, root = Counter(), {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter = len(sets[a] & sets[b])
            if inter and 5 * inter >= 4 * (len(sets[a]) + len(sets[b]) - inter):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (find(d), links[d]) for d in ids}


def near_family(count, words=60):
    """Texts that share all but a few words: many links, not all of them."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(count):
        own = base.copy()
        for at in rng.integers(0, words, int(rng.integers(0, 3))):
            own[at] = f"x{rng.integers(1000)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates(spark, texts, monkeypatch):
    every = dict(texts) | {10_000 + i: t for i, t in enumerate(near_family(60))}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    expected = brute_links(every)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicate_classes(df).collect()}
    assert got == expected
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 4000)  # eight texts a block: the family is many blocks
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicate_classes(df).collect()}
    assert got == expected


def test_near_duplicates_of_odd_rows(spark, odd_documents, no_documents):
    got = [(r.doc_id, r.class_id, r.n_links) for r in nd.near_duplicate_classes(odd_documents.withColumn("node", F.lit("clash"))).collect()]
    assert sorted((g for g in got if g[0]), key=str) == sorted(
        [(1, 1, 2), (1, 1, 2), (2, 1, 2)] + [(i, i, 0) for i in range(3, 10)], key=str
    )
    kept = nd.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert nd.near_duplicate_classes(no_documents).count() == 0 and nd.keep_one(no_documents).count() == 0


def passage_family(count, pairs, pool=60, taken=30, length=50, changed=30):
    """Texts of passages out of a common pool, alike by about a third, and near copies of some of them."""
    rng = np.random.default_rng(7)
    out = [[f"p{i}w{k}" for i in rng.permutation(pool)[:taken] for k in range(length)] for _ in range(count)]
    for words in out[:pairs]:
        own = words.copy()
        for at in rng.permutation(len(own))[:changed]:
            own[at] = f"x{at}"
        out.append(own)
    return [" ".join(words) for words in out]


@pytest.mark.parametrize("most", [4096, 10])
def test_near_duplicates_in_a_family_of_common_passages(spark, monkeypatch, most):
    every = passage_family(800, 200)
    sets = [windows(t) for t in every]
    owners = {}
    for i, own in enumerate(sets):
        for w in own:
            owners.setdefault(w, []).append(i)
    inter = np.zeros((len(every), len(every)), int)
    for own in owners.values():
        inter[np.ix_(own, own)] += 1
    total = np.add.outer([len(s) for s in sets], [len(s) for s in sets])
    linked = (9 * inter >= 4 * total) & ~np.eye(len(every), dtype=bool)
    pairs = {(int(i), int(j)) for i, j in np.argwhere(np.triu(linked))}
    assert pairs == {(i, 800 + i) for i in range(200)}
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", most, raising=False)
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    # Short prefixes crowd the buckets as a hundred thousand texts would.
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicate_classes(df, deepest=2).collect()}
    assert {(c, d) for d, (c, _) in got.items() if c != d} == pairs
    assert sum(n for _, n in got.values()) == 2 * len(pairs)


def test_near_duplicates_of_many_sizes(spark, monkeypatch):
    """One component whose texts grow by a tenth each: links reach over size classes, blocks are many."""
    words = [f"g{i}" for i in range(1500)]
    every = {i: " ".join(words[: int(30 * 1.1**i)]) for i in range(40)}
    every |= {100 + i: every[i] + f" end{i}" for i in range(0, 40, 3)}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    expected = brute_links(every)
    assert {c for c, _ in expected.values()} == {0}
    for most in (500_000, 4000):
        monkeypatch.setattr(nd, "BLOCK_SHINGLES", most)
        got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicate_classes(df).collect()}
        assert got == expected


def test_linked_sizes_lie_in_neighbouring_classes():
    sizes = np.arange(1, 200_000)
    of = lambda n: np.floor(np.log(n) / float(np.log(nd.SIZE_CLASS)))
    assert (of(sizes * 5 // 4) - of(sizes)).max() == 1


def test_forest_leaves_settled_subtrees(spark):
    rows = [(1, b"abc", 10, 10), (1, b"abc", 11, 11), (1, b"axy", 12, 12), (2, b"abc", 10, 10), (2, b"abd", 11, 11)]
    rows = spark.createDataFrame(rows, "key long, path binary, node long, component long")
    edges = lambda t, below: sorted((r.a, r.b, r.ca, r.cb) for r in nd._subtree_edges(t, below).collect())
    assert edges(rows, 3) == [(10, 11, 10, 11)]
    assert edges(rows, 2) == [(10, 11, 10, 11)] * 2
    moved = spark.createDataFrame([(10, 10), (11, 10)], "node long, component long")
    left = nd._unsettled(rows, moved)
    # All of key 2 have come into one component; key 1 goes on, by one edge for its two components.
    assert sorted((r.key, r.node, r.component) for r in left.collect()) == [(1, 10, 10), (1, 11, 10), (1, 12, 12)]
    assert edges(left, 1) == edges(left, 0) == [(10, 12, 10, 12)]


def test_digests_tell_sets_apart():
    values, offsets = nd.shingles(pa.array(["a b c d e f", "b c d e f a", "a b c d e f", ""]))
    high, low = nd._digests(values, offsets)
    assert high[0] == high[2] and low[0] == low[2] and len(set(high)) == len(set(low)) == 3
    assert not set(high[:3]) & set(low[:3])  # the empty set has no sum to mix


def test_shingles_are_sets_of_windows(texts):
    some = [*list(texts.values())[:80], None, "", "a", "a b c d", "a b c d e", "a b c d e " * 9]
    values, offsets = nd.shingles(pa.array(some))
    seen = {}
    for i, text in enumerate(some):
        own = values[offsets[i] : offsets[i + 1]]
        assert len(set(own.tolist())) == len(own) == len(windows(text or ""))
        for j in seen:
            a, b = windows(text or ""), windows(some[j] or "")
            assert len(set(own.tolist()) & seen[j]) == len(a & b)
        seen[i] = set(own.tolist())


def test_forest_depth():
    assert nd.prefix_depth(0.8, nd.TREES, nd.DEPTH, nd.TARGET_RECALL) == 6
    assert nd.prefix_depth(0.1, 2, 5, 0.99) == 1


def test_components_of_a_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = nd.components(edges.union(spark.createDataFrame([(100, 102), (102, 101)], "a long, b long"))).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<double>, score string")


def exact_nearest(points, query, k):
    x = np.array(list(points.values()))
    distance = np.sqrt(((x - points[query]) ** 2).sum(1))
    return [(i, d) for d, i in sorted(zip(distance.tolist(), points, strict=True)) if i != query][:k]


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = {i: rng.normal(size=8) for i in range(600)} | {1000 + i: np.ones(8) for i in range(300)}
    bad = [(2000, None, ""), (2001, [0.0] * 8, ""), (2002, [float("nan")] + [1.0] * 7, ""), (2003, [None] + [1.0] * 7, ""), (2004, [1.0] * 3, ""), (None, [1.0] * 8, "")]
    df = vectors(spark, [(i, v.tolist(), "clash") for i, v in points.items()] + bad)
    monkeypatch.setattr(neighbours, "ENTRIES_PER_BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERIES_PER_BLOCK", 3)
    found = {}
    for r in neighbours.search(df, df.where("vec_id % 100 = 0"), k=10).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i in points if i % 100 == 0} and all(len(f) == 10 for f in found.values())
    truth = {q: exact_nearest(points, q, 10) for q in found}
    assert found[1000] == [(i, 0.0) for i in range(1001, 1011)]  # ties to smaller ids
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in truth[q]}) for q in found)
    assert hits >= 0.9 * 10 * len(found)
    for q, own in found.items():
        for i, score in own:
            assert score == pytest.approx(np.sqrt(((points[i] - points[q]) ** 2).sum()), abs=1e-12)


def test_few_or_no_vectors(spark):
    few = vectors(spark, [(0, [1.0, 2.0], ""), (1, [1.0, 3.0], ""), (1, [1.0, 3.0], "")])
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(few, few, k=10).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (1, 1, 0)]
    assert neighbours.search(vectors(spark, []), vectors(spark, [])).count() == 0


def test_neighbours_query_recall(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_DIR}/embeddings.parquet'").fetchall()
    points = {i: np.array(v, float) for i, v in rows}
    found = QUERIES["op5_nearest_neighbours"](spark, SF_DIR).collect()
    hits = sum(r.vec_id in {i for i, _ in exact_nearest(points, r.query_id, 10)} for r in found)
    assert hits >= 0.9 * len(found) and Counter(r.query_id for r in found) == {i: 10 for i in points if i % 100 == 0}


def test_cells_are_visited_by_summed_distance():
    index = neighbours.MultiIndex(2, np.array([[0.0], [1.0], [5.0]]), np.array([[0.0], [2.0]]))
    first, second = index.distances(np.array([[0.9, 1.5]]))
    order = list(index.traverse(first[0], second[0]))
    sums = [first[0][c // 2] + second[0][c % 2] for c in order]
    assert sorted(order) == list(range(6)) and sums == sorted(sums)


def test_pipeline(spark):
    """Every stage against brute force on what the stage before has kept."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    stays = {r.doc_id for r in kept.collect()}
    assert np.mean([(d in stays) == bool(q) for d, q in labels.items()]) > 0.97
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    clear = corpus_pipeline.language_stage(spark, kept, sf)
    assert clear.count() > 0.97 * len(stays)
    one = corpus_pipeline.duplicates_stage(spark, clear, sf)
    texts = {r.doc_id: r.text for r in clear.collect()}
    assert {r.doc_id for r in one.collect()} == {d for d, (c, _) in brute_links(texts).items() if d == c}
    mixed = corpus_pipeline.mixing_stage(spark, one, sf)
    taken = {r.doc_id: r.copies for r in mixing.mix(one).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == {d: n for d, n in taken.items() if n}
    packed = corpus_pipeline.packing_stage(spark, mixed, sf)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [1] for r in mixed.collect()}
    by_doc, _ = check_packing(packed.collect(), ids)
    assert by_doc == {d: n * len(ids[d]) for d, n in taken.items() if n}
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in sizes) <= 2048 and sum(r.n for r in sizes) / len(sizes) > 0.98 * 2048


def test_stages_take_odd_and_empty_tables(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            assert out.count() <= 3 * docs.count() + 300, name
            if name != "packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)
    assert language.UNKNOWN == "und" and quality.TRAIN_ROWS == 20_000


def test_families_are_not_carried_along_with_strangers(spark, monkeypatch):
    """Of a family that shares a prefix with strangers one member goes on to shorter prefixes, not all of them."""
    family, alike, other = range(1, 301), bytes(240), bytes([1]) * 240
    rows = [(n, [7], bytes([n % 3]) + b"ab", alike) for n in family]
    rows += [(900, [7], b"xyz", other), (901, [7], b"uvw", other), (902, [8], b"abc", alike)]
    classes = spark.createDataFrame(rows, "node long, keys array<long>, rest binary, signature binary")
    written, real = {}, nd.stored
    monkeypatch.setattr(nd, "stored", lambda df, label: written.setdefault(label, []).append(real(df, label)) or written[label][-1])
    got = {r.node: r.component for r in nd.candidate_components(classes, 1, 4, step=1).collect()}
    assert got == {n: 1 for n in family} | {900: 900, 901: 900}
    assert max(t.count() for t in written["unsettled"]) <= 5
