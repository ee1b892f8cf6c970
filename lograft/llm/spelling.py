"""Operator 12: spelling variants of the corpus's words, by blocked Gram matrices.

Words are counted, then laid out in blocks by their length and by how many of their letters fall in each
of a few classes. One edit changes the length by one at most and the class counts by one in one or two
classes, so only words of the same or adjacent blocks can be near. For such a pair of blocks one
matrix product of letter counts gives all squared distances; an edit makes two at most. What is left is verified.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lograft.llm.common import cut_slices
from lograft.session import stored

# What a word is made of.
WORD_LETTER = "[A-Za-zÀ-ÿ]"
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
# Some runs lose a letter: those whose hash this number divides.
DELETION = 199

LEAST_LENGTH, LEAST_COUNT, LEAD = 6, 5, 5
# Any few classes of letters of about equal frequency.
CLASSES = ("aejotyàèìðõú", "bfiknuzâçéîò", "chlpsváäëïóû")
BLOCK_WORDS = 1024
BATCH_BYTES = 4 << 20
PART_CHARS = 1 << 20
VERIFIED_CHARS = 1 << 22


def _runs(text: str, pattern: re.Pattern) -> Iterator[Counter]:
    """The runs of a text that the pattern finds, with their counts, by parts of bounded size that cut no run."""
    start = 0
    while start < len(text):
        found = NO_LETTER.search(text, min(start + PART_CHARS, len(text)))
        end = found.start() if found else len(text)
        yield Counter(pattern.findall(text, start, end))
        start = end


def lower_ascii(text: str) -> str:
    """The text with A to Z in lower case; all other characters stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def damaged(run: str, head: int) -> str:
    """The run, without one of its letters if its hash says so; the hash goes on from ``head``, that of what comes before."""
    number = zlib.crc32(run.encode(), head)
    if number % DELETION:
        return run
    at = number % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, damage: bool = True) -> DataFrame:
    """``word``, ``n``: the different words of all texts with at least so many letters, and how often they occur.

    Counted in each batch first, so a frequent word is a row a batch. NULL texts have none; ``damage`` takes
    letters out of some runs (:func:`damaged`).
    """

    # A run only ever gets shorter, so shorter ones need no look.
    pattern = re.compile(f"{WORD_LETTER}{{{max(least_length, 1)},}}")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in cut_slices(batch, "text", BATCH_BYTES):
                totals: Counter = Counter()
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for found in _runs(lower_ascii(text or ""), pattern):
                        for run, n in found.items():
                            word = damaged(run, head) if damage else run
                            if len(word) >= least_length:
                                totals[word] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"]
                )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _letters_in(word: Column, letters: str) -> Column:
    return F.length(word) - F.length(F.translate(word, letters, ""))


def _cell(size: Column, counts: list[Column]) -> Column:
    return F.concat_ws(",", *(c.cast("string") for c in (size, *counts)))


def blocks(words: DataFrame) -> DataFrame:
    """``word``, its cell (length and letters in each class), and the block of the cell that it lies in.

    Cells of many words are cut into blocks of about ``BLOCK_WORDS`` by a hash of the word.
    """
    word = F.col("word")
    counted = words.select("word", F.length(word).alias("size"), F.array(*(_letters_in(word, c) for c in CLASSES)).alias("held"))
    cells = counted.groupBy("size", "held").agg(F.ceil(F.count("*") / BLOCK_WORDS).cast("int").alias("n_blocks"))
    part = F.pmod(F.xxhash64("word"), F.col("n_blocks")).cast("int")
    return counted.join(cells, ["size", "held"]).select("word", "size", "held", part.alias("part"), "n_blocks")


def _moves() -> list[tuple[int, list[int]]]:
    """Changes of length and class counts from a block to those whose words may be near; each two blocks meet once.

    A letter of no class is the class left over, so it shows in the length alone.
    """
    unit = [[int(i == j) for i in range(len(CLASSES))] for j in range(len(CLASSES))] + [[0] * len(CLASSES)]
    longer = [(1, move) for move in unit]
    same = [(0, [a - b for a, b in zip(x, y, strict=True)]) for n, x in enumerate(unit) for y in unit[n + 1 :]]
    return [(0, [0] * len(CLASSES)), *longer, *same]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all words one after another, the word that each belongs to, and the lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.repeat(np.arange(len(words)), lengths), lengths


def _letter_counts(words: list[str]) -> np.ndarray:
    """How often each word has each letter; a row a word."""
    letters, row, _ = _codes(words)
    return np.bincount(row * 256 + letters, minlength=len(words) * 256).reshape(-1, 256).astype(np.float64)


def _laid(words: list[str], width: int, at_end: bool) -> np.ndarray:
    """The words as rows of letters, at the start or the end of a row; the rest is 0, which is no letter."""
    letters, row, lengths = _codes(words)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rows = np.zeros((len(words), width), np.uint8)
    rows[row, place + (width - lengths[row] if at_end else 0)] = letters
    return rows


def near_pairs(home: list[str], guests: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of a word of each list that are one edit apart.

    The Gram product leaves pairs whose letter counts differ by one edit at most; of these one is near if the
    letters that both begin with and those that both end with are all of a word but one.
    """
    one, other = _letter_counts(home), _letter_counts(guests)
    used = one.any(axis=0) | other.any(axis=0)
    one, other = one[:, used], other[:, used]
    squares = (one**2).sum(axis=1)[:, None] + (other**2).sum(axis=1)[None, :]
    left, right = np.nonzero(squares - 2 * (one @ other.T) <= 2)
    if not len(left):
        return
    sizes, guest_sizes = _codes(home)[2], _codes(guests)[2]
    width = int(max(sizes.max(), guest_sizes.max())) + 1
    sides = [(_laid(home, width, end), _laid(guests, width, end)) for end in (False, True)]
    step = max(VERIFIED_CHARS // width, 1)
    for start in range(0, len(left), step):
        a, b = left[start : start + step], right[start : start + step]
        # Both rows have an empty place where the words end, so what is equal is cut to the shorter word.
        shorter, longer = np.minimum(sizes[a], guest_sizes[b]), np.maximum(sizes[a], guest_sizes[b])
        same = (sides[0][0][a] == sides[0][1][b]).all(axis=1)
        begins = (sides[0][0][a] != sides[0][1][b]).argmax(axis=1)
        ends = (sides[1][0][a] != sides[1][1][b])[:, ::-1].argmax(axis=1)
        near = ~same & (longer - shorter <= 1) & (np.minimum(begins, shorter) + np.minimum(ends, shorter) >= longer - 1)
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            yield home[i], guests[j]


def _meet(table: pa.Table) -> pa.Table:
    """The near pairs of two blocks, or of a block with itself; both ways."""
    words, guest = table.column("word").to_pylist(), table.column("guest").to_pylist()
    home, guests = ([w for w, g in zip(words, guest, strict=True) if g is side] for side in (False, True))
    within = table.column("within")[0].as_py()
    found = set(near_pairs(home, home if within else guests))
    both = sorted(found | {(b, a) for a, b in found})
    return pa.table({"word": pa.array([a for a, _ in both], pa.string()), "near": pa.array([b for _, b in both], pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``: all ordered pairs of words one edit apart.

    A task gets two blocks of bounded size at a time. Blocks meet by their cells, through an equi-join on the
    cell that each may reach; nothing else is compared.
    """
    laid = stored(blocks(words), "spelling-blocks")
    cells = laid.groupBy("size", "held", "n_blocks").agg(F.count("*").alias("n"))
    moves = F.array(*(F.struct(F.lit(a).alias("size"), F.array(*map(F.lit, b)).alias("held")) for a, b in _moves()))
    reach = cells.select("size", "held", F.col("n_blocks").alias("home_blocks"), F.explode(moves).alias("move")).select(
        "size",
        "held",
        "home_blocks",
        (F.col("size") + F.col("move.size")).alias("guest_size"),
        F.zip_with("held", "move.held", lambda a, b: a + b).alias("guest_held"),
    )
    others = cells.select(
        F.col("size").alias("guest_size"), F.col("held").alias("guest_held"), F.col("n_blocks").alias("guest_blocks")
    )
    own = (F.col("size") == F.col("guest_size")) & (F.col("held") == F.col("guest_held"))
    meetings = stored(reach.join(others, ["guest_size", "guest_held"]).withColumn("own", own), "spelling-meetings")
    name = F.concat_ws(
        "|", _cell(F.col("size"), [F.col("held")[i] for i in range(len(CLASSES))]), "home_part",
        _cell(F.col("guest_size"), [F.col("guest_held")[i] for i in range(len(CLASSES))]), "guest_part",
    )
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = (
        laid.join(meetings, ["size", "held"])
        .withColumn("home_part", F.col("part"))
        .withColumn("guest_part", parts("guest_blocks"))
        .where("NOT own OR home_part <= guest_part")
        .withColumn("within", F.col("own") & (F.col("home_part") == F.col("guest_part")))
        .select(name.alias("meeting"), "within", "word", F.lit(False).alias("guest"))
    )
    guests = (
        laid.select("word", F.col("size").alias("guest_size"), F.col("held").alias("guest_held"), F.col("part").alias("guest_part"))
        .join(meetings, ["guest_size", "guest_held"])
        .withColumn("home_part", parts("home_blocks"))
        .where("NOT own OR home_part < guest_part")
        .select(name.alias("meeting"), F.lit(False).alias("within"), "word", F.lit(True).alias("guest"))
    )
    # A word stands once in a meeting, so a group has two blocks at most.
    return home.unionByName(guests).groupBy("meeting").applyInArrow(_meet, "word string, near string")


def group_variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    lead: int = LEAD,
    damage: bool = True,
) -> DataFrame:
    """Every frequent word with the word that it is a variant of, if any.

    Columns: word, form, root (string), n, n_near, form_n (bigint). A word's form is its near word of largest
    ``n`` (ties: smallest word) if that is ``lead`` times the word's own or more; the root is where forms lead to.
    NULL and empty texts have no words; repeated rows count as often as they are there; an empty table gives an
    empty result. Other columns are left out.
    """
    words = stored(count_words(docs, least_length, damage).where(F.col("n") >= least_count), "spelling-words")
    pairs = stored(near_words(words), "spelling-pairs")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # The largest n first, then the smallest word: the least of (-n, word).
    best = (
        pairs.join(known, "near")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    )
    is_form = -F.col("best.less") >= lead * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    formed = stored(formed, "spelling-forms")
    # Counts grow by the lead with every step, so chains are short; each round doubles how far a root has been followed.
    largest = words.agg(F.max("n")).first()[0] or least_count
    steps = math.log(max(largest / least_count, 1), lead) + 1
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(steps, 2)))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
