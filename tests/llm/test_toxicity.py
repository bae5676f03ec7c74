"""Toxicity: the automaton against edit distances, the score on held-out rows."""

import random

from pyspark.sql import functions as F

from recordflow.llm import toxicity as T
from recordflow.llm.common import crc_class


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_against_edit_distance():
    rnd = random.Random(1)
    entries = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 9))) for _ in range(150)})
    trie = T.Trie(entries)
    words = entries + ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 11))) for _ in range(600)]
    for e in entries:  # one edit away
        i = rnd.randrange(len(e))
        words += [e[:i] + e[i + 1:], e[:i] + "z" + e[i:], e[:i] + "d" + e[i + 1:]]
    for w in words:
        assert sorted(trie.near(w)) == [e for e in entries if distance(e, w) <= 1], w
    assert T.Trie([]).near("abc") == []


BAD = ["grobling", "snarfed", "wuzzle", "plonker"]


def _rows(n=900):
    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        w = [f"n{rnd.randint(0, 400)}" for _ in range(rnd.randint(20, 120))]
        toxic = int(i % 5 == 0)
        if toxic:
            for b in rnd.sample(BAD, 2):
                w.insert(rnd.randrange(len(w)), b)
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_rows(make_docs, spark):
    docs, labels = _rows()
    extra = [(10_001, "so n1 n2 groblinng n3 n4 wuzle n5"), (10_002, None), (10_003, ""),
             (10_004, "n1 n2 n3 " * 20000), (10_005, "grobling " * 300), (None, "wuzzle snarfed")]
    table = make_docs(docs + extra, score="old", toxic="x")
    marked = spark.createDataFrame(
        labels + [(None, 1), (3, None), (4, 0), (4, 0), (10_002, 1)], "doc_id bigint, toxic int")
    model = T.fit(table, marked, crc_class("doc_id", 4) != 2)
    assert {b[:4] for b in BAD} <= {t[:4] for t in model.weight}
    out = T.score(table, model).withColumn("held", crc_class("doc_id", 4) == 2).collect()
    assert len(out) == len(docs) + len(extra)
    truth = dict(labels)
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id in truth:
            assert (r.score >= 0.3) == bool(truth[r.doc_id])
    by = {r.doc_id: r.score for r in out}
    assert by[10_001] >= 0.3 > by[10_004] and by[10_002] == by[10_003] < 0.3 <= by[10_005]


def test_quoted_hits_count_less():
    model = T.Model({"grobling": 6.0}, {}, (1.0, 1.0, 0.0, 0.0, 0.0, -3.0))
    plain, quoted = "you grobling go away", 'he said "grobling" go away'
    assert model.score(plain) > model.score(quoted) > model.score("nothing here")
    assert model.features(quoted)[4] == 1.0 and model.features(plain)[4] == 0.0


def test_without_rows_of_both_classes(make_docs, spark):
    docs = make_docs([(1, "a b"), (2, None)])
    none = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    for labels in (none, none.limit(0)):
        model = T.fit(docs, labels, F.lit(True))
        assert {r.score for r in T.score(docs, model).collect()} == {0.5}
    assert T.score(docs.limit(0), model).count() == 0
