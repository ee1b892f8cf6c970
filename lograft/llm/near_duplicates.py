"""Operator 3: all pairs of texts with a high n-gram Jaccard similarity, by a MinHash LSH forest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lograft.llm.common import buffers, cut_slices
from lograft.session import stored

NGRAM = 5
SIMILARITY = (4, 5)  # 0.8 as a fraction, so that the test is one of whole numbers
TREES = 40
DEPTH = 12
# By so many values a prefix is shortened where its subtree is not settled.
STEP = 3
TARGET_RECALL = 0.99999
# Members of a bucket are linked if their signatures' estimate is at least this. With 240 values a
# pair at 0.8 lies below it with a probability of 4e-8, far less than what the prefixes may miss (1e-5).
LEAST_ESTIMATE = 0.65
BATCH_BYTES = 4 << 20
# Shingles (or 500 a text, if that is more) that are compared in one block.
BLOCK_SHINGLES = 500_000
# More than 5/4 by some margin, so that rounded logarithms part no linked sets by two classes.
SIZE_CLASS = 1.3
# Members of a bucket whose signatures are compared in one block.
BLOCK_MEMBERS = 4096

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    for factor in _MIX:
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def _random(count: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, count + 1, dtype=np.uint64) * _STEP + np.uint64(seed))


_BYTE_VALUES = _random(256, 1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_POSITIONS = _random(NGRAM, 2) | np.uint64(1)


def shingles(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word windows of each whole text, and each text's offsets into them.

    A text of fewer words, one at least, has the window of all its words. All
    texts of the column are hashed together: words by a polynomial over their
    bytes, windows by a sum over mixed words.
    """
    body, offsets = buffers(texts)
    rows = len(offsets) - 1
    space = (body == 32) | ((body >= 9) & (body <= 13))
    edge = np.ones(len(body) + 1, bool)
    edge[1:-1] = space[1:] | space[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    # Horner's rule for all words at once, a byte position at a time; words are short but for junk.
    lengths = ends - starts
    words = np.zeros(len(starts), np.uint64)
    long = lengths > 64
    for i in range(int(lengths[~long].max(initial=0))):
        live = np.flatnonzero(~long & (lengths > i)) if i else np.flatnonzero(~long)
        words[live] = words[live] * _BASE + _BYTE_VALUES[body[starts[live] + i]]
    for i in np.flatnonzero(long):
        value = _BYTE_VALUES[body[starts[i] : ends[i]]]
        powers = np.cumprod(np.full(len(value), _BASE, np.uint64))
        words[i] = (value * powers).sum(dtype=np.uint64)
    words = _mixed(words + lengths.astype(np.uint64))
    first_word = np.searchsorted(starts, offsets)
    counts = np.diff(first_word)
    windows = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    ends_at = np.cumsum(windows)
    row_of = np.repeat(np.arange(rows), windows)
    at = first_word[row_of] + np.arange(len(row_of)) - np.repeat(ends_at - windows, windows)
    values = np.zeros(len(at), np.uint64)
    size = np.minimum(counts, n)[row_of]
    for i in range(n):
        live = slice(None) if i == 0 or size.min(initial=n) == n else np.flatnonzero(size > i)
        values[live] += _mixed(words[at[live] + i] + _POSITIONS[i]) * _POSITIONS[i]
    values = _mixed(values)
    order = np.lexsort((values, row_of))
    values, row_of = values[order], row_of[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row_of[1:] != row_of[:-1])
    return values[fresh], np.searchsorted(row_of[fresh], np.arange(rows + 1))


def signatures(values: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """MinHash values, one row a text; texts without shingles keep the largest number."""
    rows = len(offsets) - 1
    out = np.full((count, rows), np.iinfo(np.uint64).max, np.uint64)
    factors, shifts = _random(count, 3) | np.uint64(1), _random(count, 4)
    filled = np.flatnonzero(np.diff(offsets))
    # Some thousand shingles at a time stay in the processor's cache over all hash functions.
    first = 0
    while first < len(filled):
        last = int(np.searchsorted(offsets[filled], offsets[filled[first]] + 16_384, side="left"))
        last = max(last, first + 1)
        part = filled[first:last]
        lo, hi = offsets[part[0]], offsets[part[-1] + 1]
        own, at = values[lo:hi], offsets[part] - lo
        for k in range(count):
            out[k, part] = np.minimum.reduceat((own ^ shifts[k]) * factors[k], at)
        first = last
    return out.T


def prefix_depth(similarity: float, trees: int, deepest: int, target: float) -> int:
    """The longest matched prefix that still finds a pair of this similarity with the target recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < target:
        depth -= 1
    return depth


def sketch(
    docs: DataFrame, trees: int = TREES, deepest: int = DEPTH, target: float = TARGET_RECALL, similarity: float = 0.8
) -> DataFrame:
    """One row per document: digest of its shingle set, its size, and its path in each tree.

    A tree is a trie over ``deepest`` hash functions. Of each path, ``keys`` holds a hash of the shortest prefix that is
    ever matched (:func:`prefix_depth`), ``signature`` the low byte of the values in it, and ``rest`` that
    of the values behind it, tree by tree.
    """
    depth = prefix_depth(similarity, trees, deepest, target)
    spread = _random(trees * depth, 5).reshape(trees, depth) | np.uint64(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_slices(batch, "text", BATCH_BYTES):
                values, offsets = shingles(part.column("text"))
                rows = len(offsets) - 1
                high, low = _digests(values, offsets)
                paths = signatures(values, offsets, trees * deepest).reshape(rows, trees, deepest)
                matched, rest = paths[:, :, :depth], paths[:, :, depth:]
                keys = _mixed((matched * spread).sum(axis=2, dtype=np.uint64) + np.arange(trees, dtype=np.uint64))
                edges = pa.array(np.arange(rows + 1, dtype=np.int32) * trees)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(high.view(np.int64)),
                        pa.array(low.view(np.int64)),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.ListArray.from_arrays(edges, pa.array(keys.ravel().view(np.int64))),
                        *(pa.array([row.tobytes() for row in side.astype(np.uint8)], pa.binary()) for side in (matched, rest)),
                    ],
                    names=["doc_id", "high", "low", "n_shingles", "keys", "signature", "rest"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, high long, low long, n_shingles long, keys array<long>, signature binary, rest binary"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _digests(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, as two numbers, for the set of a text's shingles, whatever their order."""
    out = []
    for shift in (_STEP, _BASE):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(values ^ shift), dtype=np.uint64)])
        out.append(_mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)))
    return out[0], out[1]


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the component its smallest node.

    Every round each node takes the smallest component among its neighbours', and then
    its component's component, so paths halve. Each round's small table is
    written, and read by the next; nothing but its count of changes comes to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).withColumnRenamed("a", "n"), "c")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["n"]).groupBy("a").agg(F.min("c").alias("near"))
        step = labels.join(near, labels["n"] == near["a"], "left").select(
            "n", F.col("c").alias("old"), F.least("c", F.coalesce("near", "c")).alias("c")
        )
        step = stored(step, "c")
        jump = step.select(F.col("n").alias("m"), F.col("c").alias("further"))
        labels = step.join(jump, step["c"] == jump["m"], "left").select(
            "n", "old", F.least("c", F.coalesce("further", "c")).alias("c")
        )
        labels = stored(labels, "c")
        if not labels.where("old <> c").limit(1).count():
            return labels.select(F.col("n").alias("node"), F.col("c").alias("component"))
        labels = labels.drop("old")
    raise RuntimeError("components did not settle; raise most_rounds")


def candidate_components(
    classes: DataFrame, shortest: int, deepest: int, least_estimate: float = LEAST_ESTIMATE, step: int = STEP
) -> DataFrame:
    """Rows (node, component) for all classes that share a prefix with one that looks alike, directly or by others.

    A node of the forest is all that share a prefix in one tree. Prefixes are matched from the ``deepest``, ``step`` values
    shorter each time, to the ``shortest``, at which the target recall is reached. At each depth a forest node
    gives an edge from its smallest member to one of each other component in it; the edges whose
    signatures look alike join components. A subtree whose members have all come into one component is settled and goes no
    further, so families of near copies leave at long prefixes. Of one component only the smallest member in each subtree
    goes on, as no other gives an edge, so a large family that shares a prefix with a stranger is not carried along. What
    is not settled at the shortest prefix is compared member by member (:func:`_crowd_edges`), so no pair
    depends on a third text.

    Subtrees that hold one class are never followed, and those of two are an edge at once.
    """
    width = deepest - shortest
    leaves = classes.select("node", "rest", F.posexplode("keys").alias("tree", "key")).select(
        "key", F.substring("rest", F.col("tree") * width + 1, F.lit(width)).alias("path"), "node"
    )
    shared = leaves.groupBy("key").agg(
        F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("members")
    )
    shared = stored(shared.where("members > 1"), "buckets")
    crowds = leaves.join(shared.where("members > 2").select("key"), "key")
    crowds = stored(crowds.withColumn("component", F.col("node")), "crowds")
    pairs = shared.where("members = 2").select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    heads, placed = crowds, None
    depths = (*range(deepest, shortest, -step), shortest)
    for depth, next_depth in zip(depths, (*depths[1:], shortest), strict=True):
        edges = _subtree_edges(heads, depth - shortest)
        edges = edges if placed is not None else edges.union(pairs)
        moved = components(stored(_alike(edges.distinct(), classes, least_estimate), "near"))
        placed = moved if placed is None else stored(_followed(placed, moved), "placed")
        heads = stored(_unsettled(heads, moved, next_depth - shortest), "unsettled")
        if heads.isEmpty():
            return placed
    mixed = shared.join(heads.select("key").distinct(), "key").select("key", "members")
    joined = components(stored(_crowd_edges(crowds, mixed, placed, classes, least_estimate), "joined"))
    return _followed(placed, joined)


def _followed(placed: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows (node, component) after components have moved, with the nodes that move for the first time."""
    further = moved.select(F.col("node").alias("__node"), F.col("component").alias("further"))
    now = placed.join(further, placed["component"] == further["__node"], "left").select(
        "node", F.coalesce("further", "component").alias("component")
    )
    return now.union(moved.join(placed.select("node"), "node", "left_anti").select("node", "component"))


def _subtree_edges(unsettled: DataFrame, below: int) -> DataFrame:
    """Edges (a, b, ca, cb) from the smallest member of each subtree to one of each other component in it.

    The subtrees are those ``below`` values under the shortest prefix; ca and cb are the components of a and b.
    """
    subtree = F.xxhash64("key", F.substring("path", F.lit(1), F.lit(below))) if below else F.col("key")
    members = unsettled.groupBy(subtree.alias("subtree"), "component").agg(F.min("node").alias("member"))
    heads = members.groupBy("subtree").agg(
        F.min("member").alias("a"), F.min_by("component", "member").alias("ca"), F.count("*").alias("parts")
    )
    heads = heads.where("parts > 1").drop("parts")
    return members.join(heads, "subtree").where("member <> a").select(
        "a", F.col("member").alias("b"), "ca", F.col("component").alias("cb")
    )


def _unsettled(rows: DataFrame, moved: DataFrame, below: int | None = None) -> DataFrame:
    """The rows with their new components, of those shortest prefixes that still hold several.

    With ``below`` only the smallest node of each component is kept in a subtree that many values under the shortest prefix.
    """
    moved = moved.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    placed = rows.join(moved, F.col("component") == F.col("__node"), "left").select(
        "key", "path", "node", F.coalesce("__component", "component").alias("component")
    )
    if below is not None:
        path = F.substring("path", F.lit(1), F.lit(below)).alias("path")
        placed = placed.groupBy("key", path, "component").agg(F.min("node").alias("node"))
        placed = placed.select("key", "path", "node", "component")
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return placed.join(mixed.where("least <> most").select("key"), "key")


def _alike(edges: DataFrame, classes: DataFrame, least_estimate: float) -> DataFrame:
    """Of edges (a, b, ca, cb) those whose signatures look alike, as edges between components."""
    left = classes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    signed = edges.join(left, "a").join(right, "b").select("ca", "cb", "sa", "sb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for c in ("sa", "sb")
            )
            alike = (x == y).sum(axis=1) >= _least_equal(x.shape[1], least_estimate)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(alike)) for c in ("ca", "cb")], names=["a", "b"]
            )

    return signed.mapInArrow(run, "a long, b long")


def _least_equal(values: int, least_estimate: float) -> int:
    """How many of the signatures' values must be equal; one byte each, so 1 in 256 is equal by chance."""
    return int(np.ceil(values * (least_estimate * (1 - 1 / 256) + 1 / 256) - 1e-9))


def _crowd_edges(
    crowds: DataFrame, mixed: DataFrame, placed: DataFrame, classes: DataFrame, least_estimate: float
) -> DataFrame:
    """Edges between different components whose members meet at a shortest prefix and look alike.

    ``crowds`` holds the rows (key, node) of prefixes, ``mixed`` those with several components (key, members), and
    ``placed`` the components of nodes that are not their own. Every two members
    are compared by their signatures unless they lie in one component already.
    Prefixes are cut into blocks of bounded size; every two blocks of one prefix meet in one
    task, which emits an edge for each two components that it joins, never the pairs.
    """
    blocks = mixed.select("key", F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    keys = ("key", "low", "high")
    members = crowds.select("key", "node").join(blocks, "key").join(placed, "node", "left")
    met = (
        members.withColumns({"own": own, "component": F.coalesce("component", "node")})
        .join(classes.select("node", "signature"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "own",
            "component",
            "signature",
        )
    )
    grouped = met.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if not rows.num_rows:
                continue
            at = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in keys])
            starts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()]
            # The last run may go on in the next batch.
            held = rows.slice(starts[-1])
            if len(starts) > 1:
                yield _joined(rows.slice(0, starts[-1]), starts, least_estimate)
        if held is not None:
            yield _joined(held, [0, held.num_rows], least_estimate)

    return grouped.mapInArrow(run, "a long, b long")


def _joined(rows: pa.Table, starts: list[int], least_estimate: float) -> pa.RecordBatch:
    """Edges between components, of the runs of rows that begin at ``starts``, which ends with the number of rows."""
    labels, own, low, high = (rows.column(c).to_numpy() for c in ("component", "own", "low", "high"))
    body = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    least, count_type = _least_equal(body.shape[1], least_estimate), np.min_scalar_type(body.shape[1])
    found: list[tuple[int, int]] = []
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        label, by_value = labels[lo:hi].copy(), np.ascontiguousarray(body[lo:hi].T)
        one_block = low[lo] == high[lo]
        theirs = np.ones(hi - lo, bool) if one_block else own[lo:hi] == high[lo]
        for i in range(hi - lo) if one_block else np.flatnonzero(~theirs):
            if one_block:
                theirs[i] = False  # those before have met it
            others = np.flatnonzero(theirs & (label != label[i]))
            if not len(others):
                continue
            equal = (by_value[:, others] == by_value[:, i : i + 1]).sum(axis=0, dtype=count_type)
            for j in others[equal >= least]:
                if label[j] != label[i]:
                    found.append((int(labels[lo + i]), int(labels[lo + j])))
                    label[label == label[j]] = label[i]
    columns = [pa.array([edge[k] for edge in found], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common shingles of every text on the left with every one on the right, as a product of 0/1 matrices."""
    sizes = np.array([len(x) for x in (*left, *right)])
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, code, counts = np.unique(values, return_inverse=True, return_counts=True)
    several = counts[code] > 1
    owner, code = owner[several], code[several]
    _, code = np.unique(code, return_inverse=True)
    out = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = max(64, (8 << 20) // max(len(sizes), 1))
    for lo in range(0, int(code.max(initial=-1)) + 1, width):
        own = slice(*np.searchsorted(code, [lo, lo + width]))
        block = np.zeros((len(sizes), min(width, int(code[-1]) + 1 - lo)), np.float32)
        block[owner[own], code[own] - lo] = 1
        out += np.rint(block[: len(left)] @ block[len(left) :].T).astype(np.int64)
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether inter / union >= 4/5, in whole numbers."""
    up, down = SIMILARITY
    inter = _intersections(left, right)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None]
    return (up + down) * inter >= up * total


def verified_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Exact check of all classes of a candidate component against each other, in blocks.

    ``members``: node, component, copies, n_shingles, digest (high, low) and doc_id of a text of the class.
    Returns (node, links, other): the number of documents that are linked to the class, and one linked class
    per row as an edge; together the edges span what is linked. Components are cut
    into blocks of bounded size; two blocks of one component meet in one
    task, which counts the links and emits a row per class, never the pairs. The blocks of a component of several
    lie in size classes, each ``SIZE_CLASS`` times the one before: sets that are linked differ by 5/4 at most, so only
    blocks of one class or of neighbouring classes meet.
    """
    weight = F.greatest("n_shingles", F.lit(500))
    whole = members.groupBy("component").agg((F.sum(weight) <= BLOCK_SHINGLES).alias("one_block"))
    size = F.when(F.col("one_block"), 0).otherwise(F.floor(F.log(F.col("n_shingles")) / float(np.log(SIZE_CLASS))))
    sized = members.join(whole, "component").withColumn("size", size.cast("int"))
    blocks = sized.groupBy("component", "size").agg(F.ceil(F.sum(weight) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    # A row per block that a class meets: those of its own size, and of the sizes beside it.
    met = blocks.select("component", F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1)))).alias("size"), F.struct("size", "blocks").alias("there"))
    met = met.groupBy("component", "size").agg(F.collect_list("there").alias("met"))  # three at most
    met = met.join(blocks, ["component", "size"])
    own = F.struct("size", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    numbered = F.transform(
        "met",
        lambda m: F.transform(F.sequence(F.lit(0), m["blocks"] - 1), lambda i: F.struct(m["size"].alias("size"), i.alias("block"))),
    )
    placed = sized.join(met, ["component", "size"]).select(
        F.col("doc_id").alias("__id"), "node", "high", "low", "component", "copies", own.alias("own"), F.flatten(numbered).alias("met")
    )
    with_text = (
        docs.select("doc_id", "text")
        # One plan for all sizes: the texts meet their classes by id, in one shuffle.
        .join(placed.hint("merge"), docs["doc_id"].eqNullSafe(placed["__id"]))
        .select("node", "high", "low", "component", "copies", "own", F.explode("met").alias("other"), "text")
        .withColumns({"lesser": F.least("own", "other"), "greater": F.greatest("own", "other")})
        .select(
            "node",
            "high",
            "low",
            "copies",
            "component",
            "lesser.size",
            "lesser.block",
            F.col("greater.size").alias("other_size"),
            F.col("greater.block").alias("other_block"),
            ((F.col("own") == F.col("lesser"))).alias("is_lesser"),
            "text",
        )
    )
    keys = ("component", "size", "block", "other_size", "other_block")
    grouped = with_text.repartition(*keys).sortWithinPartitions(*keys, "is_lesser", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def compared() -> pa.RecordBatch:
            nodes, copies, sides, sets, seen = [], [], [], [], set()
            for node, many, lesser, values in held:
                if node not in seen:  # several rows of one id, or of one text
                    seen.add(node)
                    nodes.append(node)
                    copies.append(many)
                    sides.append(lesser)
                    sets.append(values)
            one_block = key[1:3] == key[3:5]
            side = np.array(sides, bool)
            names, many = np.array(nodes, np.int64), np.array(copies, np.int64)
            low, high = np.flatnonzero(side), np.flatnonzero(side if one_block else ~side)
            rows: list[tuple[int, int, int]] = []
            if len(low) and len(high):
                linked = _linked([sets[i] for i in low], [sets[i] for i in high])
                if one_block:
                    np.fill_diagonal(linked, False)
                for mine, theirs, table in ((low, high, linked), (high, low, linked.T)):
                    for i in np.flatnonzero(table.any(axis=1)):
                        rows.append((int(names[mine[i]]), int(table[i] @ many[theirs]), table[i], theirs))
                    if one_block:
                        break
            return _spanning(rows, names)

        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            columns = ("node", "copies", "is_lesser", "high", "low")
            known = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
            for row, values in _row_shingles(batch):
                if at[row] != key:
                    if held:
                        yield compared()
                    key, held = at[row], []
                node, many, lesser, *digest = known[row]
                if [int(d.view(np.int64)[0]) for d in _digests(values, np.array([0, len(values)]))] == digest:
                    held.append((node, many, lesser, values))
        if held:
            yield compared()

    return grouped.mapInArrow(run, "node long, links long, other long")


def _row_shingles(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    first = 0
    for part in cut_slices(batch, "text", BATCH_BYTES):
        values, offsets = shingles(part.column("text"))
        for i in range(part.num_rows):
            yield first + i, values[offsets[i] : offsets[i + 1]]
        first += part.num_rows


def _spanning(rows: list, names: np.ndarray) -> pa.RecordBatch:
    """A row per linked class: its links here, and the smallest class it is joined to by them."""
    root = {int(n): int(n) for n in names}

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for node, _, linked, theirs in rows:
        for j in np.flatnonzero(linked):
            a, b = find(node), find(int(names[theirs[j]]))
            if a != b:
                root[max(a, b)] = min(a, b)
    columns = [[r[0] for r in rows], [r[1] for r in rows], [find(r[0]) for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "other"])


def near_duplicate_classes(
    docs: DataFrame, trees: int = TREES, deepest: int = DEPTH, target: float = TARGET_RECALL, similarity: float = 0.8
) -> DataFrame:
    """One row per document: doc_id, class_id, copy_of, n_links.

    Links join documents whose sets of five-word windows have a Jaccard similarity of 0.8
    or more. ``class_id`` is the smallest id among all that are joined by
    links, directly or not; ``n_links`` the number of other documents that a document is linked
    to, copies included; ``copy_of`` the smallest id with the very same windows.
    Words are runs of non-space characters. Texts of one to four words have one window; NULL
    texts and texts without words have no links, and each is its own class. Repeated rows are
    copies of each other. Other columns are left out.

    Copies collapse first, so a text that stands thousands of times is compared once.
    """
    sketches = stored(sketch(docs, trees, deepest, target, similarity), "sketches")
    texts = sketches.where("n_shingles > 0")
    classes = texts.groupBy("high", "low").agg(
        F.min("doc_id").alias("doc_id"),
        F.count("*").alias("copies"),
        F.first("n_shingles").alias("n_shingles"),
        *(F.first(c).alias(c) for c in ("keys", "signature", "rest")),
    )
    # Numbers for classes, fixed once the table is written; unlike half a digest they never collide.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    candidates = candidate_components(classes, prefix_depth(similarity, trees, deepest, target), deepest)
    slim = classes.select("node", "high", "low", "doc_id", "copies", "n_shingles")
    members = stored(slim.join(candidates, "node"), "members")
    links = stored(verified_links(members, docs), "links")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")).where("a <> b"))
    named = slim.join(joined, "node", "left").join(counted, "node", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "node")), "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of_class = named.join(smallest, "component").select(
        F.col("high").alias("__high"),
        F.col("low").alias("__low"),
        "class_id",
        F.col("doc_id").alias("copy_of"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("__links"),
    )
    alone: Column = F.col("n_shingles") == 0
    return (
        sketches.select("doc_id", "high", "low", "n_shingles")
        .join(of_class, (F.col("high") == F.col("__high")) & (F.col("low") == F.col("__low")) & ~alone, "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("copy_of", "doc_id").alias("copy_of"),
            F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without near duplicates: of each class one row stays.

    That is the one with the smallest id (a missing one comes last), of equal ids the one whose text has the smallest
    MD5. Rows are judged by id and text, so ids may be missing or stand for several texts. Repeated rows stay
    once. Texts without words are no copies of each other; of those each id and text stays once. All columns are kept.
    """
    columns = docs.columns
    key = F.struct(
        docs["doc_id"].isNull().alias("missing"), docs["doc_id"].alias("id"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))).alias("digest")
    )
    keyed = docs.select(*columns, key.alias("__key"))
    classes = near_duplicate_classes(keyed.select(F.col("__key").alias("doc_id"), "text"), **options)
    kept = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("__kept")).distinct()
    found = keyed.join(kept, F.col("__key") == F.col("__kept"), "left_semi").select(*columns)
    return found.dropDuplicates(["doc_id", "text"])
