"""Spelling variants: words one edit apart, found by PartEnum signatures on letter multisets.

The letters of a word, each with the number of its occurrence, are a binary vector. Words that
differ by one letter inserted or deleted are at a Hamming distance of one, by one replaced of at
most two. The dimensions are dealt to ``PARTS`` parts, and every choice of two parts to leave out
gives a signature: vectors within two are equal outside some such choice. One edit also leaves the
first or the last half of a word as it is, and the length changes by one at most, so a signature is
taken together with a half and a length. Words meet in an equi-join on signatures, and the edit
distance of those that do is worked out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import stored, whole

# What a run of letters is (in UTF-8, À to ÿ are C3 80 to C3 BF), which runs lose a
# code point, how long and how frequent a word is, and how much more frequent its form.
RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
ALTERED_BY = 31
LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_RATIO = 10

#: Parts that the dimensions are dealt to; two of them are left out of a signature.
PARTS = 4
#: Distinct words whose counts a worker gathers before it hands them on.
COUNTED_AT_ONCE = 200_000
#: Choices of parts left out.
CHOICES = tuple(combinations(range(PARTS), 2))
#: The choices that between them leave out every part: one is enough for a single difference.
COVER = tuple(c for i, c in enumerate(CHOICES)
              if c in {(p, p + 1) for p in range(0, PARTS - 1, 2)}
              or (PARTS % 2 and c == (PARTS - 2, PARTS - 1)))


# ---------------------------------------------------------------- words


def runs_of(doc_id: int | None, text: str) -> Iterator[tuple[bytes, int]]:
    """(result, occurrences) of every distinct run of a text, A-Z lower-cased.

    With h the crc32 of ``<doc_id>:<run>``, a run whose h is divisible by 31 loses its code point
    h % length. Without an id no run is altered.
    """
    start = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
    for run, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower())).items():
        if start is not None:
            h = zlib.crc32(run, start)
            if h % ALTERED_BY == 0:
                letters = run.decode("utf-8")
                at = h % len(letters)
                run = (letters[:at] + letters[at + 1:]).encode("utf-8")
        yield run, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) for the results of at least ``LEAST_LETTERS`` code points, added up as far as a
    bounded table of words goes."""
    found: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([w.decode("utf-8") for w in found], pa.string()),
                               pa.array(found.values(), pa.int64())], ["word", "n"])
        found.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch[0].to_pylist(), batch[1]):
            for word, n in runs_of(doc_id, text.as_py()):
                # Letters of two bytes: only words of at least so many bytes can be long enough.
                if len(word) >= LEAST_LETTERS and (
                        len(word) - word.count(b"\xc3") >= LEAST_LETTERS):
                    found[word] += n
            if len(found) >= COUNTED_AT_ONCE:
                yield flushed()
    if found:
        yield flushed()


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n): the distinct results of at least seven code points that occur twice or more in
    all texts. NULL texts have none; repeated rows count again."""
    counts = docs.select(F.col(f"`{doc_id}`").cast("bigint"), whole(F.col(f"`{text}`"))).mapInArrow(
        _counted, "word string, n bigint")
    return (counts.groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


# ---------------------------------------------------------------- signatures


def _mixed(z: np.ndarray) -> np.ndarray:
    """Well spread 64 bits."""
    z = z + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _part_sums(texts: list[str]) -> np.ndarray:
    """Per word and part, the sum of the hashes of its dimensions: (letter, occurrence) pairs."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    keyed = (np.repeat(np.arange(len(texts), dtype=np.uint64), sizes) << np.uint64(21)) | points
    order = np.argsort(keyed, kind="stable")
    first = np.concatenate(([True], keyed[order][1:] != keyed[order][:-1]))
    at = np.arange(len(order))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    hashes = _mixed((points << np.uint64(32)) | occurrence)
    # Dimensions are dealt out by another hash than the one summed.
    part = _mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(PARTS)
    return np.stack([np.add.reduceat(np.where(part == p, hashes, np.uint64(0)), starts)
                     for p in range(PARTS)])


def _halves(texts: list[str], less: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and the last half for partners of which the shorter has ``less`` letters
    fewer than the word, with that length."""
    def hashed(side: str, part) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(f"{side}{len(t) - less}:{part(t, len(t) - less)}"
                                                  .encode("utf-8", "surrogatepass"))
                         for t in texts], np.uint64)

    return (hashed("<", lambda t, m: t[:m // 2]),
            hashed(">", lambda t, m: t[len(t) - (m - m // 2):]))


def signatures(texts: list[str]) -> np.ndarray:
    """Signatures of non-empty words, one row each.

    First those for partners of the same length or one more (two halves of every choice of parts),
    then those for partners one letter shorter, where the vectors differ in one place only.
    """
    parts = _part_sums(texts)
    total = parts.sum(axis=0)
    out = []
    for choices, less in ((CHOICES, 0), (COVER, 1)):
        for half in _halves(texts, less):
            for c in choices:
                rest = total - parts[c[0]] - parts[c[1]]
                out.append(_mixed(rest + half + np.uint64(CHOICES.index(c) + 1)))
    return np.stack(out, axis=1).view(np.int64)


#: Signatures of a word that meet those of words of its length or longer by one.
OWN = 2 * len(CHOICES)


def links(lexicon: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """(a, b, a_n, b_n), one row for every two distinct words of at least two code points that
    differ by exactly one inserted, deleted or replaced code point; ``a`` is the shorter, of equal
    lengths the smaller one.

    Words must be distinct; rows with a NULL or shorter word have no links.
    """
    @F.arrow_udf("array<bigint>")
    def signed(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        flat = signatures(texts) if texts else np.empty((0, OWN), np.int64)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()),
            pa.array(flat.ravel()))

    keyed = stored(
        lexicon.select(F.col(word).alias("w"), F.col(n).cast("bigint").alias("c"))
        .where(F.length("w") > 1)
        .select("w", "c", F.posexplode(signed("w")).alias("at", "key"))
        .select("key", "w", "c", (F.col("at") >= OWN).alias("longer")), "spelling-signatures")
    own = keyed.where("not longer").select("key", F.col("w").alias("a"), F.col("c").alias("a_n"))
    met = own.join(keyed.select("key", "longer", F.col("w").alias("b"), F.col("c").alias("b_n")),
                   "key")
    near = met.where("(longer or a < b) and levenshtein(a, b, 1) = 1")
    return near.select("a", "b", "a_n", "b_n").distinct()


# ---------------------------------------------------------------- forms


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word reached. A form is more frequent than its word
    by a factor, so there are no cycles and few steps; each round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = stored(now.join(onward, "root", "left")
                       .select("word", F.coalesce("beyond", "root").alias("root"),
                               F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if not after.where("moved").limit(1).count():
            return now
        now = after.select("word", "root")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of all texts.

    Words are the maximal runs of letters (A-Z, a-z, À to ÿ), A-Z lower-cased and altered as
    ``runs_of`` says, of at least seven code points and two occurrences. ``n_near`` counts the words
    one edit apart. ``form`` is the near word of largest n (of equal ones the smallest in code point
    order) where that is at least ten times the word's, else NULL with its ``form_n``; ``root`` is
    what following forms ends at, the word itself without one.

    NULL and empty texts have no words, an empty table gives no rows, a NULL id alters no run.
    Other columns of ``docs``, whatever their names, are not read.
    """
    lexicon = stored(words(docs, text, doc_id), "spelling-words")
    pairs = links(lexicon)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")
                        ).unionAll(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("top"))
    known = stored(
        lexicon.join(best, "word", "left")
        .withColumn("has", F.coalesce(-F.col("top.less") >= FORM_RATIO * F.col("n"), F.lit(False)))
        .select("word", F.when(F.col("has"), F.col("top.near")).alias("form"), "n",
                F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                F.when(F.col("has"), -F.col("top.less")).alias("form_n")), "spelling-forms")
    roots = _roots(known.where("form is not null"))
    return (known.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                    "form_n"))
