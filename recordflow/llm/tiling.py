"""Benchmark decontamination by greedy string tiling.

Runs of words shared by a document and a benchmark item seed the search: documents are filtered by
a bitmap of fixed size, and what passes is joined with the items' runs. Each candidate document is
then tiled with its items: the longest matches that don't overlap are marked again and again, found
by running Karp-Rabin hashing. An item is contained where enough of it is tiled, whatever the order
of the pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import stored, unused

#: Words of the shortest tile, and of the runs that seed the search.
LEAST = 5
#: Share of an item's words that must be tiled.
COVERAGE = 0.5
#: Length at which the search for tiles begins.
START = 20
#: Bits of the filter are 2 to this power: 4 MB.
FILTER_BITS = 25

# Letters, digits and all bytes beyond ASCII make words; A-Z in lower case.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32
               for b in range(256))
_FACTOR = 0x9E3779B97F4A7C15
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def words(text: str) -> list[bytes]:
    """Words in lower case without punctuation."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def run_hashes(tokens: list[bytes], size: int = LEAST) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words, in order."""
    if len(tokens) < size:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    n = len(one) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ one[k:k + n]) * np.uint64(_FACTOR)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in the filter."""
    u, mask = h.view(np.uint64), np.uint64((1 << FILTER_BITS) - 1)
    return (u & mask).astype(np.int64), (u >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def tile(document: list[bytes], item: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, words), in the order of marking.

    At each search length all runs of that many unmarked words of the item are hashed, the document
    is gone through with a rolling hash, and hits are compared and lengthened. Matches are marked
    from the longest to the shortest; what is left of one that has been cut into comes up again at
    a shorter length. A match of twice the search length makes the search begin again with it.
    """
    known = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    a, b = [known.get(w, 0) for w in document], [known[w] for w in item]
    free_a, free_b = [x > 0 for x in a], [True] * len(b)  # words the item lacks match nothing
    tiles: list[tuple[int, int, int]] = []
    if min(len(a), len(b)) < least:
        return tiles
    size = max(least, min(START, len(a), len(b)))
    while True:
        matches = _matches(a, b, free_a, free_b, size)
        longest = max((m[0] for m in matches), default=0)
        if longest >= 2 * size:
            size = longest
            continue
        for length, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i:i + length]) and all(free_b[j:j + length]):
                tiles.append((i, j, length))
                free_a[i:i + length] = free_b[j:j + length] = [False] * length
            elif length > size:
                # A part may be free still: found again as a match of its own.
                for run, p, q in _matches(a, b, free_a, free_b, size, (i, i + length),
                                          (j, j + length)):
                    if all(free_a[p:p + run]) and all(free_b[q:q + run]):
                        tiles.append((p, q, run))
                        free_a[p:p + run] = free_b[q:q + run] = [False] * run
        if size <= least:
            return tiles
        size = size // 2 if size > 2 * least else least


def _runs(free: list[bool], size: int, begin: int, end: int):
    """Unmarked stretches of at least ``size`` words."""
    at = begin
    while at < end:
        if not free[at]:
            at += 1
            continue
        stop = at
        while stop < end and free[stop]:
            stop += 1
        if stop - at >= size:
            yield at, stop
        at = stop


def _rolled(values: list[int], begin: int, end: int, size: int):
    """(place, hash) of each run of ``size`` values."""
    h, top = 0, pow(_BASE, size - 1, _PRIME)
    for k in range(begin, end):
        if k - begin >= size:
            h = (h - values[k - size] * top) % _PRIME
        h = (h * _BASE + values[k]) % _PRIME
        if k - begin >= size - 1:
            yield k - size + 1, h


def _matches(a, b, free_a, free_b, size, in_a=None, in_b=None) -> list[tuple[int, int, int]]:
    """(length, place in a, place in b) of matches of at least ``size`` unmarked words. A match is
    listed from its first word, not once more for every word it goes on."""
    (a0, a1), (b0, b1) = in_a or (0, len(a)), in_b or (0, len(b))
    table: dict[int, list[int]] = {}
    for begin, end in _runs(free_b, size, b0, b1):
        for j, h in _rolled(b, begin, end, size):
            table.setdefault(h, []).append(j)
    found = []
    if not table:
        return found
    for begin, end in _runs(free_a, size, a0, a1):
        for i, h in _rolled(a, begin, end, size):
            for j in table.get(h, ()):
                if i > begin and j > b0 and free_b[j - 1] and a[i - 1] == b[j - 1]:
                    continue
                length = 0
                while (i + length < end and j + length < b1 and free_b[j + length]
                       and a[i + length] == b[j + length]):
                    length += 1
                if length >= size:
                    found.append((length, i, j))
    return found


def _seeds(text: Column) -> Column:
    @F.arrow_udf("struct<runs: array<bigint>, n: int>")
    def seeds(texts: pa.Array) -> pa.Array:
        split = [words(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([run_hashes(w) for w in split], pa.list_(pa.int64())),
             pa.array([len(w) for w in split], pa.int32())], names=["runs", "n"])

    return seeds(text)


def _filter_of(items: DataFrame) -> np.ndarray:
    """The filter: one byte holds eight bits; of the same size whatever there is in the items."""

    @F.arrow_udf("array<int>")
    def places(column: pa.Array) -> pa.Array:
        ends = column.offsets.to_numpy()
        first, second = _bits(column.values.to_numpy(zero_copy_only=False))
        both = np.stack([first, second], axis=1).reshape(-1).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array((2 * ends).astype(np.int32)), pa.array(both))

    rows = (items.select(F.explode(places("runs")).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("bits")).collect())
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in rows:
        out[r["at"]] = r["bits"]
    return out


def _covered(places: Column) -> Column:
    """Words that lie in a run of ``LEAST`` words starting at one of the places."""
    start = F.struct(F.lit(-LEAST).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(places), start, lambda acc, p: F.struct(
        p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(LEAST))).alias("n")),
        lambda acc: acc["n"])


def contained(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE,
              text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_text_key, item_id, coverage, tiles) of every distinct text of ``docs`` and every benchmark
    item of which at least ``coverage`` is tiled by the text.

    ``_text_key`` is ``text_key`` of the text; tiles are (doc_word, item_word, n_words). Items of
    fewer than ``LEAST`` words and NULL texts on either side match nothing. Repeated items of one id
    give one row, that of the best coverage. Texts enter once however often they are repeated.

    What the documents are filtered by has a fixed size. A document is tiled with items that its
    shared runs alone could cover well enough, so those it is held against at once are bounded by
    its own length.
    """
    given = (benchmark.where(F.col(item_text).isNotNull())
             .select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item")).distinct())
    # Equal texts of several ids are tiled once; their ids are joined to the result.
    ids = given.select("item_id", F.md5("item").alias("_item"))
    items = stored(given.select("item").distinct().withColumn("_s", _seeds(F.col("item")))
                   .select("item", F.md5("item").alias("_item"), "_s.runs", "_s.n")
                   .where(f"n >= {LEAST}"), "items")
    bitmap = _filter_of(items)

    @F.arrow_udf("array<bigint>")
    def hits(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            h = run_hashes(words(t))
            first, second = _bits(h)
            left = np.flatnonzero(bitmap[first >> 6] >> (first & 63) & 1)
            left = left[bitmap[second[left] >> 6] >> (second[left] & 63) & 1 == 1]
            out.append(np.unique(h[left]))
        return pa.array(out, pa.list_(pa.int64()))

    found = (docs.where(F.col(text).isNotNull())
             .select(F.col(text).alias("text")).withColumn("hits", hits("text"))
             .where(F.size("hits") > 0).withColumn("_text_key", text_key("text")))
    found = stored(found.groupBy("_text_key").agg(F.first("text").alias("text"),
                                                  F.first("hits").alias("hits")), "tiling-hits")
    runs = items.select("_item", "n", F.posexplode("runs"))
    shared = (found.select("_text_key", F.explode("hits").alias("col")).join(runs, "col")
              .groupBy("_text_key", "_item")
              .agg(F.first("n").alias("n"), F.collect_set("pos").alias("places"))
              .where(_covered(F.col("places")) >= coverage * F.col("n")))
    candidates = (shared.select("_text_key", "_item", "n").join(items.select("_item", "item"), "_item")
                  .groupBy("_text_key")
                  .agg(F.collect_list(F.struct("_item", "item", "n")).alias("items")))
    kind = "array<struct<doc_word:int,item_word:int,n_words:int>>"

    @F.arrow_udf(f"array<{kind}>")
    def tilings(texts: pa.Array, its: pa.Array) -> pa.Array:
        out = []
        for t, row in zip(texts.to_pylist(), its.to_pylist()):
            w = words(t)
            out.append([[{"doc_word": i, "item_word": j, "n_words": n}
                         for i, j, n in tile(w, words(it))] for it in row])
        tiles = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()),
                                    ("n_words", pa.int32())]))
        return pa.array(out, pa.list_(tiles))

    tiled = (found.select("_text_key", "text").join(candidates, "_text_key")
             .withColumn("tiles", tilings("text", F.transform("items", lambda x: x["item"])))
             .select("_text_key", F.explode(F.arrays_zip("items", "tiles")).alias("z"))
             .select("_text_key", "z.items._item", "z.items.n", "z.tiles"))
    total = F.aggregate("tiles", F.lit(0), lambda acc, t: acc + t["n_words"])
    scored = (tiled.withColumn("coverage", total / F.col("n")).where(F.col("coverage") >= coverage)
              .join(ids, "_item"))
    return (scored.groupBy("_text_key", "item_id")
            .agg(F.max(F.struct("coverage", "tiles")).alias("b"))
            .select("_text_key", "item_id", "b.coverage", "b.tiles"))


def text_key(text: str) -> Column:
    return F.md5(F.col(text))


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE,
            text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain a benchmark item, once per item, with item_id, coverage
    and tiles in place of the text; columns of ``docs`` with these names are replaced."""
    key, = unused(docs, "key")
    rest = docs.drop("item_id", "coverage", "tiles").withColumn(key, text_key(text))
    found = contained(docs, benchmark, coverage, text).withColumnRenamed("_text_key", key)
    return rest.drop(text).join(found, key).drop(key)


def remove(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE,
           text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all columns. Rows with a NULL or
    empty text stay."""
    key, = unused(docs, "key")
    gone = contained(docs, benchmark, coverage, text).select(F.col("_text_key").alias(key)).distinct()
    return (docs.withColumn(key, text_key(text)).join(gone, key, "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
