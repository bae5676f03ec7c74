"""Quality counts against plain Python; the order of rules never changes a verdict."""

import itertools
import random
import re

from pyspark.sql import functions as F

from recordflow.llm import quality as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in wins if wins.count(x) > 1}
    covered = {i + k for i, x in enumerate(wins) if x in twice for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))
    letters = sum(any(c.isalpha() for c in x) for x in w)
    bad = (base or chars < 3 * len(w) or chars > 12 * len(w) or 10 * symbols > len(w)
           or 10 * len(set(lines)) < 6 * len(lines) or 10 * letters < 7 * len(w))
    return (len(w), chars, symbols, len(lines) - len(set(lines)), len(covered), base, not bad)


def _texts():
    rnd = random.Random(2)
    plain = " ".join(f"word{i}" for i in range(80))
    out = [None, "", " \n\t\x0b", "a", "a b c", plain, plain.replace(" ", " # "), plain + "\n" + plain,
           "\n".join(["same line here"] * 40), "x " * 60, " ".join(["#"] * 10 + [f"w{i}" for i in range(60)]),
           " ".join(f"{'y' * 20}{i}" for i in range(60)), " ".join(str(i) for i in range(100)),
           "\n".join(f"é{i} ü{i % 7} 漢{i % 3} line" for i in range(70)), "a\u00a0b\u3000c\x1cd " * 20, plain, plain]
    for _ in range(150):
        n, m = rnd.randint(0, 150), rnd.choice([3, 8, 60])
        out.append("".join(rnd.choice("abcdefgh"[:1] + f"w{rnd.randint(0, m)} ") * 1
                           if rnd.random() < .1 else f"w{rnd.randint(0, m)}" + rnd.choice([" ", "  ", "\n"])
                           for _ in range(n)))
    return out


def test_counts_and_verdict(make_docs):
    texts = _texts()
    docs = make_docs(list(enumerate(texts)), kept="old", n_words="old", source="s")
    rows = Q.judge(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
        assert got == brute(texts[r.doc_id]), texts[r.doc_id]


def test_keep_is_the_same_in_any_order(make_docs, monkeypatch):
    texts = _texts()[:60]
    docs = make_docs(list(enumerate(texts)), quality="x")
    want = {i for i, t in enumerate(texts) if brute(t)[-1]}
    assert {r.doc_id for r in Q.keep(docs).collect()} == want
    assert Q.keep(docs).columns == docs.columns
    names = list(Q.RULES)
    for permuted in itertools.islice(itertools.permutations(names), 0, 720, 239):
        monkeypatch.setattr(Q, "order", lambda m, p=permuted: list(p))
        assert {r.doc_id for r in Q.keep(docs).collect()} == want


def test_order_by_rejection_per_cost():
    assert Q.order([("dear", 10.0, .5), ("cheap", 1.0, .1), ("idle", .1, .0), ("slow", 9.0, .0)]) == [
        "cheap", "dear", "idle", "slow"]


def test_later_rules_are_not_worked_out(make_docs):
    docs = make_docs([(1, "a b"), (2, "c")])
    rules = {"all": lambda t, w: F.lit(True),
             "never": lambda t, w: F.raise_error(F.lit("worked out")).cast("boolean")}
    real, Q_order = Q.measure, ["all", "never"]
    try:
        Q.measure = lambda *a, **k: [("all", 1.0, 1.0), ("never", 1.0, 0.0)]
        assert Q.keep(docs, rules).count() == 0
        assert Q.order(Q.measure()) == Q_order
    finally:
        Q.measure = real


def test_measure_and_empty_table(make_docs):
    docs = make_docs([(i, f"w{i} " * 60) for i in range(200)])
    measured = Q.measure(docs, Q.RULES)
    assert {n for n, _, _ in measured} == set(Q.RULES)
    assert dict((n, s) for n, _, s in measured)["repeated_words"] == 1.0
    assert Q.keep(make_docs([])).count() == 0
    assert Q.judge(make_docs([])).count() == 0
