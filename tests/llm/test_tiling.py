"""Decontamination against tiling every document with every item the slow way."""

import random

import pytest

from recordflow.llm import tiling as T


def brute_tiles(a, b, least):
    """Mark a longest match of unmarked words, again and again."""
    free_a, free_b, total, out = [True] * len(a), [True] * len(b), 0, []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while (i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]
                       and free_a[i + k] and free_b[j + k]):
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        out.append((i, j, k))
        free_a[i:i + k] = free_b[j:j + k] = [False] * k
        total += k


def test_tiles_are_valid_and_as_long():
    rnd = random.Random(1)
    for _ in range(300):
        letters = rnd.choice([b"ab", b"abcdefgh", bytes(range(97, 123))])
        item = [bytes([rnd.choice(letters)]) for _ in range(rnd.randint(0, 40))]
        doc = [bytes([rnd.choice(letters)]) for _ in range(rnd.randint(0, 60))]
        if item and rnd.random() < .7:
            cut = rnd.randint(0, len(item))
            doc[10:10] = item[cut:] + [b"x"] + item[:cut]
        got, want = T.tile(doc, item, 3), brute_tiles(doc, item, 3)
        seen_a, seen_b = set(), set()
        for i, j, n in got:
            assert n >= 3 and doc[i:i + n] == item[j:j + n]
            assert not seen_a & set(range(i, i + n)) and not seen_b & set(range(j, j + n))
            seen_a |= set(range(i, i + n))
            seen_b |= set(range(j, j + n))
        assert max((n for *_, n in got), default=0) == max((n for *_, n in want), default=0)
        # Ties may be marked in another order; with many distinct words there are none.
        if len(letters) == 26:
            assert sum(n for *_, n in got) == sum(n for *_, n in want)


ITEM = [f"q{i}" for i in range(30)]


def _cases():
    rnd = random.Random(2)
    fill = lambda n: " ".join(f"f{rnd.randint(0, 10**6)}" for _ in range(n))
    whole = " ".join(ITEM)
    return {
        1: (f"{fill(50)} {whole.upper()}, {fill(50)}", 1.0),
        2: (f"{' '.join(ITEM[20:])} {fill(9)} {' '.join(ITEM[10:20])} {fill(9)} {' '.join(ITEM[:10])}", 1.0),
        3: (f"{fill(5)} {' '.join(ITEM[:16])} {fill(5)}", 16 / 30),
        4: (f"{fill(5)} {' '.join(ITEM[:14])} {fill(5)}", None),
        5: (" ".join(x for i in range(0, 30, 4) for x in (*ITEM[i:i + 4], "gap")), None),
        6: (fill(300), None),
        7: ("", None),
        8: (None, None),
        9: (whole, 1.0),
        10: (whole, 1.0),
        11: (f"{fill(30000)} {whole}", 1.0),
        12: (" ".join(f"{w}." for w in ITEM), 1.0),
    }


@pytest.fixture
def benchmark_table(spark):
    return spark.createDataFrame(
        [(1, " ".join(ITEM)), (2, "too few words"), (3, None), (4, ""), (5, " ".join(ITEM)),
         (6, " ".join(f"other{i}" for i in range(20))), (6, "six again " + " ".join(ITEM[10:]))],
        "item_id int, text string")


def test_matches_and_remove(make_docs, benchmark_table):
    cases = _cases()
    docs = make_docs([(i, t) for i, (t, _) in cases.items()], item_id="old", coverage="x", source="s")
    rows = T.matches(docs, benchmark_table).collect()
    got = {(r.doc_id, r.item_id): r.coverage for r in rows}
    assert len(got) == len(rows)
    for i, (_, want) in cases.items():
        for item in (1, 5):
            assert got.get((i, item)) == (None if want is None else pytest.approx(want))
        assert (i, 2) not in got and (i, 3) not in got
    assert got[(9, 6)] == pytest.approx(20 / 22)
    kept = T.remove(docs, benchmark_table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8}


def test_random_against_brute_force(make_docs, spark):
    rnd = random.Random(4)
    items = [[f"v{rnd.randint(0, 60)}" for _ in range(rnd.randint(5, 25))] for _ in range(12)]
    docs = []
    for d in range(60):
        w = [f"v{rnd.randint(0, 60)}" for _ in range(rnd.randint(0, 60))]
        it = rnd.choice(items)
        cut, end = sorted((rnd.randint(0, len(it)), rnd.randint(0, len(it))))
        w[5:5] = it[cut:end]
        docs.append((d, " ".join(w)))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id int, text string")
    want = {}
    for d, t in docs:
        for i, it in enumerate(items):
            n = sum(k for *_, k in brute_tiles(T.words(t), [x.encode() for x in it], T.LEAST))
            if 2 * n >= len(it):
                want[d, i] = n / len(it)
    got = {(r.doc_id, r.item_id): r.coverage for r in T.matches(make_docs(docs), bench).collect()}
    assert got == pytest.approx(want) and want


def test_empty_tables(make_docs, benchmark_table):
    assert T.matches(make_docs([]), benchmark_table).count() == 0
    docs = make_docs([(1, " ".join(ITEM))])
    assert T.remove(docs, benchmark_table.limit(0)).count() == 1
