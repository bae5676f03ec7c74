"""Hard negatives against brute force; exact products of residues."""

import math

import numpy as np
import pytest

from recordflow.llm import negatives

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
DDL = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every, positives=5, negatives_=10):
    held = {}
    for vec_id, vector, label in sorted(
            (r for r in rows if None not in r and all(
                x is not None and math.isfinite(x) for x in r[1])),
            key=lambda r: (r[0], r[2], r[1])):
        held.setdefault(vec_id, (label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), b, other == label)
                        for b, (other, w) in held.items() if b != a)
        for p, pid, _ in [r for r in ranked if r[2]][:positives]:
            fits = [(s, b) for s, b, same in ranked
                    if not same and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(a, pid, i + 1, b, -p, -s) for i, (s, b) in enumerate(fits[:negatives_])]
    return sorted(out, key=repr)


def vectors(n, dims, seed, labels=4, decimals=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * rng.choice((0.2, 1.0), size=(n, 1))
    x = x + 0.4
    if decimals is not None:
        x = x.round(decimals)
    return [(i, [float(v) for v in row], int(rng.integers(labels))) for i, row in enumerate(x)]


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for width, high in ((1, 3), (64, 256), (130, 40_000), (64, 700_000)):
        a, b = rng.integers(-high, high, (20, width)), rng.integers(-high, high, (30, width))
        bound = width * high * high
        primes = negatives.primes_for(bound)
        assert math.prod(primes) > 2 * bound
        assert max(p // 2 for p in primes) ** 2 * negatives.PIECE < negatives.EXACT_SUM
        got = negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes)
        assert (got == a.astype(object) @ b.T.astype(object)).all()
    largest = np.full((1, 64), math.isqrt(negatives.LARGEST_SCORE // 64))
    primes = negatives.primes_for(negatives.LARGEST_SCORE)
    for sign in (1, -1):
        got = negatives.scores(negatives.residues(largest, primes),
                               negatives.residues(sign * largest, primes), primes)
        assert got[0, 0] == sign * int(largest[0, 0]) ** 2 * 64


@pytest.mark.parametrize("n,dims,decimals", [(300, 8, None), (300, 3, 1), (120, 70, 0)])
def test_agrees_with_brute_force(spark, rows, monkeypatch, n, dims, decimals):
    data = vectors(n, dims, n + dims, decimals=decimals)
    monkeypatch.setattr(negatives, "STRIP", 70)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    out = negatives.mine(negatives.integer_rows(spark.createDataFrame(data, DDL)), "vec_id % 10 = 0")
    assert rows(out, *COLUMNS) == brute(data, 10)


def test_best_of_a_stream_keeps_ties_by_id():
    rng = np.random.default_rng(4)
    best = negatives._Best.of(3, 4)
    seen = [[] for _ in range(3)]
    ids = rng.permutation(400)
    for at in range(0, 400, 37):
        part = ids[at:at + 37]
        values = rng.integers(0, 5, (3, len(part)))
        values[:, rng.random(len(part)) < 0.3] = negatives.NONE
        best.add(values, part)
        for i in range(3):
            seen[i] += [(-v, b) for v, b in zip(values[i], part) if v != negatives.NONE]
    for i, s, found in best.listed():
        assert sorted(seen[i])[:4] == [(-v, b) for v, b in zip(s, found)]


def test_equal_vectors_and_one_hot_label(spark, rows):
    data = [(i, [0.5, 0.25], 1 if i % 3 else 2) for i in range(400)]
    data += [(400 + i, [0.25, 0.125], 2) for i in range(100)]
    out = negatives.mine(negatives.integer_rows(spark.createDataFrame(data, DDL)), "vec_id % 50 = 0")
    assert rows(out, *COLUMNS) == brute(data, 50)


def test_rows_that_take_no_part(spark, rows):
    data = vectors(60, 4, 9)
    data += [(100, None, 1), (101, [1.0, None, 1.0, 1.0], 1), (102, [1.0, float("nan"), 1.0, 1.0], 1),
             (103, [float("inf")] * 4, 1), (104, [1.0] * 4, None), (None, [1.0] * 4, 2),
             (110, [], 1), (120, [0.5], 2), (130, [1.0] * 9, 3), (-10, [1.0] * 4, 1)]
    data += data[:5] + [(3, [9.0] * 4, 9)]
    df = spark.createDataFrame([(*r, "x") for r in data], DDL + ", vector string")
    out = negatives.mine(negatives.integer_rows(df), "vec_id % 10 = 0")
    assert rows(out, *COLUMNS) == brute(data, 10)


def test_empty_and_one_label(spark):
    empty = spark.createDataFrame([], DDL)
    assert negatives.mine(negatives.integer_rows(empty), "vec_id % 10 = 0").count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(20)], DDL)
    assert negatives.mine(negatives.integer_rows(same), "vec_id % 10 = 0").count() == 0
    assert negatives.mine(negatives.integer_rows(same), "vec_id < 0").count() == 0


def test_scores_that_do_not_fit(spark):
    huge = spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 2)], DDL)
    with pytest.raises(ValueError):
        negatives.mine(negatives.integer_rows(huge), "vec_id % 10 = 0")


def test_registered_query(spark, tmp_path, rows):
    from recordflow.llm.queries import QUERIES

    data = vectors(500, 6, 12, labels=10)
    spark.createDataFrame(data, DDL).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    assert dict(out.dtypes) == {c: "int" if c == "rank" else "bigint" for c in COLUMNS}
    moved = [(i, v, (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in data]
    assert rows(out, *COLUMNS) == brute(moved, 100)
