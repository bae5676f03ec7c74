"""Hard negatives by exact integer scores: GEMM in a residue number system, then a window.

Vectors are integer. Modulo each of several small primes their inner products are matrix products
in float32 whose sums stay below 2^24, so they are exact; Chinese remaindering puts the signed
scores together. Anchors are the queries: blocks of them meet strips of all rows, and every task
keeps only the best of what it has seen.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordflow.llm.common import stored

#: Sums of float32 products below this are exact.
EXACT_SUM = 1 << 24
#: Dimensions multiplied at once; longer vectors are multiplied piece by piece.
PIECE = 64
#: Scores lie within this, so that residues fit a long when they are put together.
LARGEST_SCORE = 1 << 50

#: Anchors of one block, rows of one strip, and strips at most: with more rows, strips are longer.
BLOCK, STRIP, STRIPS = 8192, 4096, 1024
#: Scores worked out at a time.
SCORES_AT_ONCE = 1 << 20
NONE = np.iinfo(np.int64).min


# ---------------------------------------------------------------- residues


def primes_for(bound: int) -> list[int]:
    """The largest primes whose symmetric residues can be multiplied ``PIECE`` at a time, as many
    as it takes to tell scores from -bound to bound apart."""
    top = 2 * math.isqrt((EXACT_SUM - 1) // PIECE) + 1
    found: list[int] = []
    product = 1
    for m in range(top, 2, -1):
        if product > 2 * bound:
            break
        if all(m % d for d in range(2, math.isqrt(m) + 1)):
            found.append(m)
            product *= m
    return found


def residues(values: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Symmetric residues of an integer matrix, one float32 matrix per prime."""
    out = []
    for m in primes:
        r = np.mod(values, m)
        out.append((r - m * (r > m // 2)).astype(np.float32))
    return out


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of ``left`` with all rows of ``right``, both given by their
    residues."""
    digits: list[np.ndarray] = []
    total, base = None, 1
    for m, a, b in zip(primes, left, right):
        r = np.zeros((a.shape[0], b.shape[0]), np.int64)
        for at in range(0, a.shape[1], PIECE):
            r += (a[:, at:at + PIECE] @ b[:, at:at + PIECE].T).astype(np.int64)
            if a.shape[1] > PIECE:
                np.remainder(r, m, out=r)
        # Mixed radix: the next digit is what the digits so far leave over, modulo m.
        if total is None:
            total = np.remainder(r, m)
        else:
            digit = np.remainder((r - total) % m * pow(base, -1, m), m)
            total = total + digit * base
        base *= m
    return np.where(total > base // 2, total - base, total)


# ---------------------------------------------------------------- best of a stream


@dataclass
class _Best:
    """The ``size`` best (score, then smaller id) of each of several lists, kept while candidates
    come in."""

    size: int
    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, lists: int, size: int) -> _Best:
        return cls(size, np.full((lists, size), NONE), np.full((lists, size), np.iinfo(np.int64).max))

    def add(self, values: np.ndarray, ids: np.ndarray) -> None:
        """Candidates for every list: a matrix of scores, ``NONE`` for no candidate, and the ids of
        its columns."""
        least = self.scores[:, -1]
        if values.shape[1] > self.size:
            cut = values.shape[1] - self.size
            least = np.maximum(least, np.partition(values, cut, axis=1)[:, cut])
        rows, cols = np.nonzero((values >= least[:, None]) & (values > NONE))
        if not len(rows):
            return
        touched = np.unique(rows)
        rows = np.concatenate((np.repeat(touched, self.size), rows))
        value = np.concatenate((self.scores[touched].ravel(), values[rows[touched.size * self.size:],
                                                                     cols]))
        name = np.concatenate((self.ids[touched].ravel(), ids[cols]))
        order = np.lexsort((name, -np.maximum(value, NONE + 1), rows))
        rows, value, name = rows[order], value[order], name[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        keep = place < self.size
        self.scores[rows[keep], place[keep]] = value[keep]
        self.ids[rows[keep], place[keep]] = name[keep]

    def listed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, s in enumerate(self.scores):
            held = s > NONE
            if held.any():
                yield i, s[held], self.ids[i, held]


# ---------------------------------------------------------------- blocks and strips


def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, strips: int) -> DataFrame:
    """Anchors of every block beside the rows of every strip, one task to a pair, anchors first.

    Rows go to a strip and anchors to a block by the hash of their id, so both are spread evenly
    whatever the labels and however rows lie in the files.
    """
    def placed(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return df.select(
            "*", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    both = placed(anchors, "block", blocks, "strip", strips).withColumn("is_anchor", F.lit(True)) \
        .unionByName(placed(rows, "strip", strips, "block", blocks)
                     .withColumn("is_anchor", F.lit(False)), allowMissingColumns=True)
    return (both.repartition(max(blocks * strips, 1), "block", "strip")
            .sortWithinPartitions("block", "strip", F.desc("is_anchor")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as a matrix; shorter ones end in zeros."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _per_pair(width: int, primes: list[int],
              begin: Callable, step: Callable, end: Callable) -> Callable:
    """A function for ``mapInArrow`` over a grid: ``begin(anchors)`` makes the state of a pair of
    block and strip, ``step(state, scores, anchors, rows)`` takes rows in, ``end(state, anchors)``
    gives what is left. Memory holds one block of anchors and one step of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, collected, state, anchors, left = None, [], None, None, None
        for batch in batches:
            keys = np.stack((batch["block"].to_numpy(), batch["strip"].to_numpy(),
                             ~batch["is_anchor"].to_numpy(zero_copy_only=False)))
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if (keys[0, lo], keys[1, lo]) != pair:
                    if state is not None:
                        yield from end(state, anchors)
                    pair, collected, state = (keys[0, lo], keys[1, lo]), [], None
                if not keys[2, lo]:
                    collected.append(part)
                    continue
                if not collected:
                    continue  # no anchors in this block
                if state is None:
                    anchors = pa.Table.from_batches(collected).combine_chunks()
                    left = residues(_matrix(anchors["vector"].combine_chunks(), width), primes)
                    state = begin(anchors)
                size = max(1, SCORES_AT_ONCE // anchors.num_rows)
                for at in range(0, part.num_rows, size):
                    rows = part.slice(at, size)
                    right = residues(_matrix(rows["vector"], width), primes)
                    step(state, scores(left, right, primes), anchors, rows)
        if state is not None:
            yield from end(state, anchors)

    return run


def _column(table, name: str) -> np.ndarray:
    return table[name].to_numpy() if isinstance(table, pa.Table) else table[name].to_numpy(
        zero_copy_only=False)


def _top(df: DataFrame, keys: list[str], score: str, name: str, size: int, rank: str) -> DataFrame:
    """The first ``size`` rows per key. A key has at most ``size`` rows from each strip."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), name)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= size)


# ---------------------------------------------------------------- the operator


def integer_rows(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                 label: str = "label", scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vector): components floor(scale * x) as longs, x taken as a double.

    Rows with a NULL id, label or vector or any NULL or non-finite component take no part. An id
    names one row: of several rows that share it, the one with the smallest label, then the
    smallest vector, counts.
    """
    x = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = (rows.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
                        F.col(f"`{label}`").cast("bigint").alias("label"), x.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                   & F.coalesce(whole, F.lit(False))))
    one = kept.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    return one.select("vec_id", "r.label", F.transform(
        "r.x", lambda v: F.floor(v * F.lit(scale)).cast("bigint")).alias("vector"))


def mine(rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are those of ``integer_rows``; ``anchors`` is a condition on them, and every row that
    meets it is an anchor. Its positives are its ``positives`` best other rows of the same label;
    for each, the ``negatives`` best rows of other labels whose score is from ``low`` to ``high``
    hundredths of the positive's are returned, ranked from 1. Scores are exact integer inner
    products, a shorter vector counting as ended in zeros; of equal scores the smaller id comes
    first. Fewer are returned where there are no more; an empty table, or one without anchors or
    with one label only, gives no rows. Scores beyond 2^50 raise ``ValueError``.
    """
    spark = rows.sparkSession
    rows = stored(rows, "negatives-rows")
    square = F.aggregate("vector", F.lit(0.0),
                         lambda acc, v: acc + v.cast("double") * v.cast("double"))
    count, n_anchors, width, largest = rows.agg(
        F.count("*"), F.count(F.when(F.expr(anchors), 1)), F.max(F.size("vector")),
        F.max(square)).first()
    # No inner product is larger than the largest square; the margin covers rounding.
    bound = math.ceil((largest or 0) * (1 + 1e-9)) + 1
    if bound > LARGEST_SCORE:
        raise ValueError(f"vectors have squares up to {largest}, scores would go beyond 2^50")
    primes, width = primes_for(bound), max(width or 0, 1)
    blocks = max(1, math.ceil(n_anchors / BLOCK))
    strips = max(1, min(STRIPS, math.ceil(count / STRIP)))

    def begin_positives(held: pa.Table) -> _Best:
        return _Best.of(held.num_rows, positives)

    def step_positives(best: _Best, s: np.ndarray, held: pa.Table, part: pa.RecordBatch) -> None:
        ids = _column(part, "vec_id")
        fits = ((_column(held, "label")[:, None] == _column(part, "label"))
                & (_column(held, "vec_id")[:, None] != ids))
        best.add(np.where(fits, s, NONE), ids)

    def end_positives(best: _Best, held: pa.Table) -> Iterator[pa.RecordBatch]:
        names = _column(held, "vec_id")
        for i, s, ids in best.listed():
            yield pa.record_batch([pa.array(np.full(len(s), names[i])), pa.array(ids), pa.array(s)],
                                  ["anchor_id", "positive_id", "positive_score"])

    asked = rows.where(anchors)
    first = _grid(asked, rows, blocks, strips).mapInArrow(
        _per_pair(width, primes, begin_positives, step_positives, end_positives),
        "anchor_id bigint, positive_id bigint, positive_score bigint")
    pairs = stored(_top(first, ["anchor_id"], "positive_score", "positive_id", positives, "place"),
                   "negatives-positives")
    scored = asked.join(
        pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(
            F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
        .select("vec_id", F.col("p.positive_id").alias("positive_ids"),
                F.col("p.positive_score").alias("positive_scores")), "vec_id")

    def begin_negatives(held: pa.Table) -> tuple:
        given = held["positive_scores"].to_pylist()
        places = max(map(len, given))
        # Where an anchor has fewer positives, nothing lies between 1 and 0.
        p = np.array([[*g, *[0] * (places - len(g))] for g in given]).T
        real = np.array([[True] * len(g) + [False] * (places - len(g)) for g in given]).T
        least = np.where(real, -(-low * p // 100), 1)
        most = np.where(real, high * p // 100, 0)
        return least, most, [_Best.of(held.num_rows, negatives) for _ in range(places)]

    def step_negatives(state: tuple, s: np.ndarray, held: pa.Table, part: pa.RecordBatch) -> None:
        ids = _column(part, "vec_id")
        s = np.where(_column(held, "label")[:, None] != _column(part, "label"), s, NONE)
        for least, most, best in zip(*state):
            best.add(np.where((s >= least[:, None]) & (s <= most[:, None]), s, NONE), ids)

    def end_negatives(state: tuple, held: pa.Table) -> Iterator[pa.RecordBatch]:
        names, ids = _column(held, "vec_id"), held["positive_ids"].to_pylist()
        given = held["positive_scores"].to_pylist()
        for place, best in enumerate(state[2]):
            for i, s, found in best.listed():
                yield pa.record_batch(
                    [pa.array(np.full(len(s), names[i])), pa.array(np.full(len(s), ids[i][place])),
                     pa.array(found), pa.array(np.full(len(s), given[i][place])), pa.array(s)],
                    ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    second = _grid(scored, rows, blocks, strips).mapInArrow(
        _per_pair(width, primes, begin_negatives, step_negatives, end_negatives),
        "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, "
        "negative_score bigint")
    best = _top(second, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives, "rank")
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                       "negative_score")
