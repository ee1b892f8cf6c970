"""Operator 11: document fingerprints of closed syncmers, matched by place.

A k-mer of a text (``K`` code points) is an anchor if the least of its inner substrings
(``S`` code points, least by CRC-32) is its first or its last one; ties count. Whether it is depends
on the k-mer alone, so an anchor stays one wherever it stands, and an edit changes
only the anchors that it touches. One k-mer in eight is an anchor, and in any ``K - S`` consecutive
k-mers there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lograft.session import stored

K, S = 20, 5
WIDTH = K - S + 1
# An anchor is kept as place * PLACE + hash; its token is hash * (GAP_LIMIT + 1) + distance to the next one.
PLACE = 1 << 20
HASHES = 1_048_573
GAP_LIMIT = 15
# Code points that are worked on at once, and those cut from a text first, as finding a place in a text is linear.
BLOCK, STRETCH = 4096, 1 << 20
BUCKETS_PER_PARTITION = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column, size: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body(piece, start)`` of pieces in which every k-mer of a text of ``K`` or more code points begins once."""
    starts = F.sequence(F.lit(0), F.length(text) - K, F.lit(size))
    return F.flatten(F.transform(starts, lambda at: body(F.substring(text, at + 1, F.lit(size + K - 1)), at)))


def _with_minima(hashes: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over the minima of ``WIDTH`` hashes from each place on, by windows of doubled width."""

    def widen(minima: Column, span: int) -> Column:
        if span == WIDTH:
            return body(minima)
        step = min(span, WIDTH - span)
        shifted = F.slice(minima, F.lit(step + 1), F.size(minima))
        return _let(F.zip_with(minima, shifted, lambda a, b: F.least(a, b)), lambda wider: widen(wider, span + step))

    return widen(hashes, 1)


def _kmer_hash(hashes: Column, at: Column) -> Column:
    """A hash of the k-mer from those of the substrings that cover it."""
    places = [*range(0, K - S, S), K - S]
    return F.pmod(sum(F.get(hashes, at + place) * F.lit(31**n) for n, place in enumerate(places)), F.lit(HASHES))


def _block_anchors(block: Column, start: Column) -> Column:
    inner = F.regexp_extract_all(block, F.lit(rf"(?s)(?=(.{{{S}}}))."), F.lit(1))
    hashed = F.transform(inner, lambda part: F.crc32(part.cast("binary")))

    def choose(hashes: Column) -> Column:
        def at_edge(minima: Column) -> Column:
            whole = F.slice(minima, F.lit(1), F.size(hashes) - WIDTH + 1)
            last = lambda i: F.get(hashes, i + WIDTH - 1)
            edge = F.transform(whole, lambda low, i: F.when((low == F.get(hashes, i)) | (low == last(i)), i))
            found = F.filter(edge, lambda i: i.isNotNull())
            return F.transform(found, lambda i: (start + i) * F.lit(PLACE) + _kmer_hash(hashes, i))

        return _with_minima(hashes, at_edge)

    return _let(hashed, choose)


def anchors(text: Column) -> Column:
    """The closed syncmers of a text in order: ``place * 2**20 + hash`` each, places from 0; NULL has none.

    Texts are worked on in blocks of bounded size, so that only the anchors grow with a text.
    """
    long = F.length(text) >= K
    found = _pieces(
        text,
        STRETCH,
        lambda stretch, first: _let(
            stretch,
            lambda part: _pieces(part, BLOCK, lambda block, at: _block_anchors(block, (first + at).cast("bigint"))),
        ),
    )
    return F.when(long, found).otherwise(F.array().cast("array<bigint>"))


def tokens(text: Column, found: Column | None = None) -> Column:
    """The fingerprint as numbers of 24 bits, one an anchor: its hash, and how far the next one is (0: none).

    So a token says which k-mer stands there and where it stands in relation to the next, wherever
    the passage lies in the text. A text shorter than a k-mer is one token; an empty or NULL one has none.
    ``found`` are the text's anchors, if they are known already.
    """
    placed = _let(
        anchors(text) if found is None else found,
        lambda all_: F.zip_with(
            all_,
            F.slice(all_, F.lit(2), F.size(all_)),
            lambda here, there: (
                here.bitwiseAND(F.lit(PLACE - 1)) * (GAP_LIMIT + 1)
                + F.least(F.coalesce(F.shiftright(there, 20) - F.shiftright(here, 20), F.lit(0)), F.lit(GAP_LIMIT))
            ).cast("int"),
        ),
    )
    short = F.array((F.crc32(text.cast("binary")) % HASHES * (GAP_LIMIT + 1)).cast("int"))
    empty = F.array().cast("array<int>")
    return F.when(F.length(text) >= K, placed).when(F.length(text) > 0, short).otherwise(empty)


def anchors_after_edit(found: Column, kept: Column, edited: Column) -> Column:
    """The anchors of an edited text of which the first ``kept`` code points, with their anchors, are known.

    Anchors do not depend on what stands around them, so only k-mers that reach into the new part are looked at.
    """
    first_new = F.greatest(kept - (K - 1), F.lit(0))
    old = F.filter(found, lambda anchor: F.shiftright(anchor, 20) < first_new)
    tail = F.substring(edited, first_new + 1, F.length(edited))
    shift = first_new.cast("bigint") * F.lit(PLACE)
    return F.concat(old, _let(tail, lambda rest: F.transform(anchors(rest), lambda anchor: anchor + shift)))


def as_text(tokens_: Column) -> Column:
    """Tokens as a string, four characters (base 64) each."""
    digits = F.transform(tokens_, lambda token: F.lpad(F.hex(token), 6, "0"))
    return F.translate(F.base64(F.unhex(F.array_join(digits, ""))), "\r\n", "")


def likeness(one: Column, other: Column) -> Column:
    """Dice coefficient of the different tokens of two fingerprints; 1 if both have none."""
    total = F.size(F.array_distinct(one)) + F.size(F.array_distinct(other))
    return F.when(total > 0, F.lit(2.0) * F.size(F.array_intersect(one, other)) / total).otherwise(F.lit(1.0))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` (string) to every row, within the row; a column of that name is replaced.

    Equal texts have equal fingerprints; NULL has that of an empty text, which is empty.
    """
    return docs.withColumn("fingerprint", as_text(tokens(F.coalesce(docs[text], F.lit("")))))


def with_next(docs: DataFrame) -> DataFrame:
    """Each text, its anchors and tokens, and text and tokens of the next document by ``doc_id``: ``next_text``, ``next_tokens``.

    The last document is followed by the first. Documents of equal id follow each other by the MD5 of their
    texts; rows equal in both are one document, returned as often as it is there. A missing id
    comes first. NULL texts are empty. Other columns are left out.

    Texts are shuffled once, to buckets of the order. Buckets come from quantiles of the ids, and an id that
    fills several quantiles is dealt over them by the MD5, so that no id makes a large bucket. The first
    document of each bucket goes to the end of the bucket before it as well, so no bucket needs another.
    """
    spark = docs.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("place"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    shares = [n / buckets for n in range(1, buckets)]
    bounds = F.lit(rows.agg(F.percentile_approx("place", shares, 20 * buckets)).first()[0] or [0])
    share = F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") / float(1 << 52)
    below = F.size(F.filter(bounds, lambda bound: bound < F.col("place")))
    equal = F.size(F.filter(bounds, lambda bound: bound == F.col("place")))
    rows = rows.withColumn("digest", F.md5("text")).withColumn("bucket", below + F.floor(share * equal).cast("int"))
    keys = stored(rows.select("bucket", "place", "digest"), "fingerprint-keys")
    repeated = stored(
        keys.groupBy("bucket", "place", "digest").count().where("count > 1").drop("count"), "fingerprint-repeated"
    )
    by = ["bucket", "place", "digest"]
    several = rows.join(repeated, by, "left_semi").groupBy(*by)
    rows = (
        rows.join(repeated, by, "left_anti")
        .select(*by, "doc_id", "text", F.lit(1).cast("bigint").alias("copies"))
        .unionByName(several.agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies")))
    )
    # One row a bucket, so as many at most as there are buckets.
    first = keys.groupBy("bucket").agg(F.min(F.struct("place", "digest")).alias("key"))
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))
    guests = first.select("bucket", "key.place", "key.digest", before.alias("before"))
    stay = F.struct("bucket", F.lit(False).alias("guest"))
    visit = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    dealt = rows.join(F.broadcast(guests), by, "left").withColumn(
        "target", F.explode(F.when(F.col("before").isNull(), F.array(stay)).otherwise(F.array(stay, visit)))
    )
    dealt = dealt.select("target.bucket", "target.guest", "place", "digest", "doc_id", "text", "copies").repartition(
        "bucket"
    )
    order = Window.partitionBy("bucket").orderBy("guest", "place", "digest")
    return (
        dealt.withColumn("anchors", anchors(F.col("text")))
        .withColumn("tokens", tokens(F.col("text"), F.col("anchors")))
        .withColumns({"next_text": F.lead("text").over(order), "next_tokens": F.lead("tokens").over(order)})
        .where("NOT guest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
        .select("doc_id", "text", "anchors", "tokens", "next_text", "next_tokens")
    )


def edited_text(text: Column, following: Column) -> tuple[Column, Column]:
    """The last quarter (rounded down) of the code points replaced by the first as many of the following text.

    Also how many code points are kept.
    """
    quarter = F.floor(F.length(text) / 4).cast("int")
    kept = F.length(text) - quarter
    return F.concat(F.substring(text, F.lit(1), kept), F.substring(following, F.lit(1), quarter)), kept


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and the likeness to that and to the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per row
    of ``docs``. An empty table gives an empty result. For NULLs, repeated rows and ids see :func:`with_next`.
    """
    edited, kept = edited_text(F.col("text"), F.col("next_text"))
    rows = with_next(docs).withColumns({"edited": edited, "kept": kept})
    known = anchors_after_edit(F.col("anchors"), F.col("kept"), F.col("edited"))
    rows = rows.withColumn("edited_anchors", known)
    rows = rows.withColumn("edited_tokens", tokens(F.col("edited"), F.col("edited_anchors")))
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("tokens")).alias("fingerprint"),
        as_text(F.col("edited_tokens")).alias("edited_fingerprint"),
        likeness(F.col("tokens"), F.col("edited_tokens")).alias("near_edited"),
        likeness(F.col("tokens"), F.col("next_tokens")).alias("near_next"),
    )
