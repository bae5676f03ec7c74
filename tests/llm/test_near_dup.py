"""Near-duplicates against comparing all pairs."""

import itertools
import random
import re
import time

import numpy as np
import pytest
import xxhash

from recordflow.llm import golay, graph
from recordflow.llm import near_dup as N


def brute_fp(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, radius):
    """Smallest index reachable, by index."""
    at = list(range(len(fps)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = sorted((top(i), top(j)))
            at[b] = a
    return [top(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_golay_words_two_bits_apart_share_an_index():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 23, 400)
    keys = golay.keys(x)
    assert set((keys >= 0).sum(1)) <= {1, 6}
    flips = [0, *[1 << a for a in range(23)],
             *[1 << a | 1 << b for a, b in itertools.combinations(range(23), 2)]]
    for f in flips:
        other = golay.keys(x ^ f)
        both = (keys[:, :, None] == other[:, None, :]) & (keys[:, :, None] >= 0)
        assert both.any((1, 2)).all()
    one = golay.keys(np.arange(1 << 12) << 11 ^ golay.syndrome(np.arange(1 << 12) << 11))
    assert (one[:, 0] == np.arange(1 << 12)).all() and (one[:, 1:] == -1).all()


def _words(rnd, n):
    return [f"w{rnd.randint(0, 500)}" for _ in range(n)]


def _texts():
    rnd = random.Random(7)
    out = [None, "", " \n", "One", "one", "one two", "ONE  two\x0b", "a b c", "É é", "é é"]
    for _ in range(12):
        base = _words(rnd, rnd.choice([30, 200, 600]))
        out.append(" ".join(base))
        for _ in range(12):  # chains of slightly changed copies
            base = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                base[rnd.randrange(len(base))] = f"x{rnd.randint(0, 9)}"
            out.append(" ".join(base))
    return out + ["word " * 30000, "a b c", "a b c"]


@pytest.mark.parametrize("crowd", [32, 2])
def test_label_against_all_pairs(make_docs, monkeypatch, crowd):
    monkeypatch.setattr(N, "CROWD", crowd)
    texts = _texts()
    docs = make_docs([(100 + i, t) for i, t in enumerate(texts)], fp="old", node="x", component_id="y")
    fps = [brute_fp(t) for t in texts]
    want = brute_classes(fps, 2)
    rows = N.label(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = r.doc_id - 100
        assert r.fp == [signed(fps[i])]
        assert r.component_id == 100 + want[i]


def test_crowded_keys_miss_no_link(spark, monkeypatch):
    """Dense sets of fingerprints around one, with all groups treated as crowded."""
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(64), k)) for k in range(7) for _ in range(60)}
    fps = sorted(fps | {rnd.getrandbits(64) for _ in range(50)})
    want = brute_classes(fps, 2)
    for crowd in (1, 4, 1000):
        monkeypatch.setattr(N, "CROWD", crowd)
        nodes = spark.createDataFrame([(i, [signed(f)]) for i, f in enumerate(fps)],
                                      "node bigint, fp array<bigint>").repartition(3)
        got = {r.node: r.root for r in N.classes(nodes).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_null_and_repeated_ids(make_docs):
    same, other = "p q r s t u v", "k l m n o p q r"
    docs = make_docs([(None, same), (7, same), (5, same), (5, other), (5, same), (None, other),
                      (None, "lonely words here now"), (None, "lonely words here now")], lang="en")
    rows = sorted(((r.doc_id, r.component_id) for r in N.label(docs).collect()), key=repr)
    assert rows == sorted([(None, 5), (7, 5), (5, 5), (5, 5), (5, 5), (None, 5), (None, None),
                           (None, None)], key=repr)
    kept = N.keep_one(docs, N.EXACT)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert [g[0] for g in got] == [5, None] and got[1][1].startswith("lonely")


def test_similar_texts_are_found(make_docs):
    rnd = random.Random(11)
    pairs, clean = [], []
    for i in range(60):
        base = [f"t{rnd.randint(0, 10**6)}" for _ in range(400)]
        near = list(base)
        for at in range(10, 400, 57):  # seven of 400 words: similarity about 0.84
            near[at] = "changed"
        pairs += [(i, " ".join(base)), (1000 + i, " ".join(near))]
        clean.append((2000 + i, " ".join(f"c{rnd.randint(0, 10**6)}" for _ in range(300))))
    # Half of the words in common is not near.
    half = [(3000 + i, " ".join(pairs[2 * i][1].split()[:200] + [f"z{i}_{k}" for k in range(200)]))
            for i in range(20)]
    kept = {r.doc_id for r in N.keep_one(make_docs(pairs + clean + half), N.similar()).collect()}
    assert set(range(60)) <= kept and {c for c, _ in clean} <= kept and {h for h, _ in half} <= kept
    assert len([k for k in kept if 1000 <= k < 2000]) <= 4


def _repeating(rnd, line, times):
    """300 words, one line several times over between lines of its own."""
    own = 300 - times * len(line)
    parts = [[f"r{rnd.randint(0, 10**9)}" for _ in range(own // times)] for _ in range(times)]
    return " ".join(w for p in parts for w in [*p, *line])


def test_a_repeated_line_does_not_make_texts_similar(make_docs):
    rnd = random.Random(23)
    docs = []
    for i in range(40):  # similarity about 0.08
        line = [f"l{rnd.randint(0, 10**9)}" for _ in range(25)]
        docs += [(i, _repeating(rnd, line, 6)), (1000 + i, _repeating(rnd, line, 6))]
    kept = {r.doc_id for r in N.keep_one(make_docs(docs), N.similar()).collect()}
    assert kept == {d for d, _ in docs}


def _shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def _changed(rnd, base, n):
    """A copy with ``n`` words changed, far enough apart to break five shingles each."""
    out = list(base)
    for at in rnd.sample(range(2, len(base) // 6), n):
        out[6 * at] = f"n{rnd.randint(0, 10**9)}"
    return out


@pytest.mark.parametrize("crowd", [4, 1])
def test_similarity_decides_exactly(make_docs, monkeypatch, crowd):
    """Pairs on both sides of 0.8, and groups of more rows than are compared at once."""
    monkeypatch.setattr(N, "CROWD", crowd)
    rnd = random.Random(31)
    texts = []
    for changes in (6, 7, 8, 9, 10, 12, 14):  # 396 shingles: 0.86 down to 0.70
        for _ in range(40):
            base = [f"b{rnd.randint(0, 10**9)}" for _ in range(400)]
            texts += [base, _changed(rnd, base, changes)]
    for _ in range(3):
        base = [f"g{rnd.randint(0, 10**9)}" for _ in range(400)]
        texts += [_changed(rnd, base, rnd.choice([1, 4, 7, 9])) for _ in range(30)]
    texts += [["v%d" % i for i in range(k)] for k in (14, 13, 12, 8, 3, 2)]  # 9 of 10 and 8 of 9 shingles, 4 of 8
    texts = [" ".join(t) for t in texts]
    sets = [_shingles(t) or {t} for t in texts]
    at = list(range(len(texts)))
    for i, j in itertools.combinations(at[:], 2):
        both = len(sets[i] & sets[j])
        if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((at[i], at[j]))
            at = [a if x == b else x for x in at]
    got = {r.doc_id: r.component_id for r in N.label(make_docs(list(enumerate(texts))), N.similar()).collect()}
    assert [got[i] for i in range(len(texts))] == at


def test_empty_tables(make_docs):
    assert N.label(make_docs([])).count() == 0
    assert N.keep_one(make_docs([]), N.similar()).count() == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)]
    edges += [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(120)] + [(500, 500), (None, 3)]
    edges += edges[:5]
    at = {}

    def top(i):
        at.setdefault(i, i)
        while at[i] != i:
            i = at[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            at[y] = x
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = graph.components(df).collect()
    assert {r.node: r.root for r in got} == {n: top(n) for n in at} and len(got) == len(at)
    assert graph.components(df.limit(0)).count() == 0


def test_a_crowded_key_of_sets_that_hardly_link(spark, rows, monkeypatch):
    """Many sets under one min-hash key, a chain of links among them and most of them alone: every
    link is found, and rounds of leaders don't lose any."""
    rng = random.Random(11)
    common = list(range(60))
    sets = [set(common + [1000 * i + j for j in range(40)]) for i in range(300)]
    for i in range(0, 60, 3):  # chains: neighbours are alike, ends need not be
        step = sorted(sets[i])
        sets[i + 1] = set(step[6:] + [9_000_000 + 1000 * i + j for j in range(6)])
        sets[i + 2] = set(sorted(sets[i + 1])[6:] + [8_000_000 + 1000 * i + j for j in range(6)])
    scheme = N.similar(0.8, bands=2, rows=1)
    fps = [[i + 1, len(s), 77, 78] for i, s in enumerate(sets)]  # all share both keys
    nodes = spark.createDataFrame([(fp[0], fp) for fp in fps], "node bigint, fp array<bigint>")
    items = spark.createDataFrame([(i + 1, sorted(s)) for i, s in enumerate(sets)],
                                  "node bigint, items array<bigint>")
    got = dict(N.classes(nodes, scheme, lambda wanted: items.join(
        wanted.select("node").distinct(), "node", "left_semi")).collect())
    parent = list(range(len(sets) + 1))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                x, y = sorted((top(i + 1), top(j + 1)))
                parent[y] = x
    want = {i: top(i) for i in range(1, len(sets) + 1)}
    assert {i: got.get(i, i) for i in want} == want
    assert len(set(want.values())) < len(sets)


def test_simhash_ties_sets_without_a_common_key(make_docs):
    rnd = random.Random(4)
    fresh = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    docs = []
    for i in range(6):
        base = fresh(2000).split()
        docs.append((2 * i, " ".join(base)))
        docs.append((2 * i + 1, " ".join(base[:-1] + ["other"])))
    shared = [(20, fresh(100)), (21, fresh(100))]
    scheme = N.similar(0.8, bands=1, rows=4000)  # a key that only equal sets share
    near = sum(np.bitwise_count(np.uint64((N.simhash(a) ^ N.simhash(b)) & (1 << 64) - 1)) <= 2
               for a, b in ((np.unique(N.shingle_hashes(docs[2 * i + k][1], 5)) for k in (0, 1))
                            for i in range(6)))
    kept = {r.doc_id for r in N.keep_one(make_docs(docs + shared), scheme).collect()}
    assert near and len(kept) == 12 - near + 2


def test_clashing_names_stay(make_docs, rows):
    docs = make_docs([(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "x")],
                     _gone="g", _odd="o", _fp="p", _component="c")
    kept = N.keep_one(docs, N.similar(0.8))
    assert set(kept.columns) == set(docs.columns)
    assert rows(kept, "doc_id", "_gone", "_fp") == [(1, "g", "p"), (3, "g", "p")]


def test_a_step_leaves_no_shuffle_behind(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        held = blocks.getAllFiles().toString()
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", held))

    before = shuffled()
    kept = graph.components(spark.range(100).selectExpr("id as a", "id div 10 as b"))
    assert kept.count() == 100
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
