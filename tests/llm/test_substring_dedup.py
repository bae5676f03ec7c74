"""Suffix-array dedup against comparing all strings of 50 bytes."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from recordflow.llm import lyndon
from recordflow.llm import substring_dedup as S


def test_suffix_ranks_against_sorting():
    rnd = random.Random(1)
    for _ in range(150):
        letters = rnd.choice([b"ab", b"abc", b"\x00a", bytes(range(97, 123)), b"aaab"])
        base = [bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 60)))
                for _ in range(rnd.randint(1, 4))]
        strings = list(base)
        for _ in range(rnd.randint(0, 10)):
            s = bytearray(rnd.choice(base))
            s[rnd.randrange(len(s))] = rnd.choice(letters)
            strings.append(bytes(s)[rnd.randrange(len(s)):] if rnd.random() < .5 else bytes(s))
        strings.sort(key=lambda s: -len(s))
        size = np.array([len(s) for s in strings])
        data = np.zeros((len(strings), size[0] + lyndon.BLOCK), np.uint8)
        for i, s in enumerate(strings):
            data[i, :len(s)] = np.frombuffer(s, np.uint8)
        rank = lyndon.suffix_ranks(data, size)
        pairs = sorted((s[i:], rank[k, i]) for k, s in enumerate(strings) for i in range(len(s)))
        assert all(r > 0 for _, r in pairs)
        for (a, ra), (b, rb) in zip(pairs, pairs[1:]):
            assert (ra == rb) == (a == b) and ra <= rb


def test_pieces_cover_all_windows_and_follow_content():
    rnd = random.Random(2)
    for text in [b"x" * 49, b"x" * 50, b"x" * 400, b"ab" * 200,
                 bytes(rnd.randrange(97, 123) for _ in range(3000))]:
        h, first, n = S.pieces(text)
        at = [s + i for s, k in zip(first.tolist(), n.tolist()) for i in range(k)]
        assert at == list(range(max(0, len(text) - S.LENGTH + 1)))
        assert all(k <= S.LENGTH - S.GRAM + 1 for k in n)
        file = np.repeat(h, n)
        for k in range(0, len(at), 7):  # a window alone is filed as in its text
            assert S.pieces(text[k:k + S.LENGTH])[0][0] == file[k]


def brute(rows):
    last = S.LAST
    first: dict[bytes, int] = {}
    texts = [((last if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - 49):
            w = b[k:k + 50]
            first[w] = min(i, first.get(w, last))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def _rows():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["é", "漢字"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = make(30), make(200)
    rows = [(1, base), (2, base), (9, base[:400] + "X" + base[401:]), (3, make(50) + passage + make(50)),
            (4, passage + " " + make(20)), (5, make(10) + passage), (6, None), (7, ""), (8, "short"),
            (10, "short"), (11, "spam " * 300), (12, "spam " * 100 + make(30)), (13, "a" * 5000),
            (14, "a" * 49), (15, "a" * 50), (None, base), (None, make(60)), (2, make(30)),
            (2, base), (16, "\x00" * 60 + make(20)), (17, "\x00" * 70)]
    for k in range(25):  # many contexts of one passage, changed copies
        rows.append((20 + k, make(rnd.randint(0, 8)) + passage + make(rnd.randint(0, 8))))
        changed = base.split(" ")
        changed[rnd.randrange(len(changed))] = "other"
        rows.append((60 + k, " ".join(changed)))
    return rows


def test_against_brute_force(make_docs, monkeypatch):
    rows = _rows()
    want = sorted((repr(i), *w) for (i, _), w in zip(rows, brute(rows)))
    got = S.removals(make_docs(rows, owner="x", key="y", n_bytes="z").repartition(3)).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in got) == want


def _same(docs, rows):
    want = sorted((repr(i), *w) for (i, _), w in zip(rows, brute(rows)))
    got = S.removals(docs).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in got) == want


def test_crowded_minimizers_window_by_window(make_docs, monkeypatch):
    """A bound so low that every shared minimizer is crowded."""
    monkeypatch.setattr(S, "GROUP_BYTES", 10)
    rows = _rows()
    _same(make_docs(rows).repartition(3), rows)


def test_one_passage_in_thousands_of_contexts(make_docs, monkeypatch):
    """One minimizer with thousands of distinct contents goes by windows, the others by order."""
    monkeypatch.setattr(S, "GROUP_BYTES", 20_000)
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(rnd.choice(letters) for _ in range(60))
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    rows = [(k, text(30) + passage + text(30)) for k in range(3000)]
    rows += [(5000 + k, text(5) + passage[:55] + rnd.choice("XY") * 20) for k in range(500)]
    crowds = []
    real = S._by_window
    monkeypatch.setattr(S, "_by_window", lambda hot: crowds.append(hot.count()) or real(hot))
    _same(make_docs(rows).repartition(4), rows)
    assert crowds[0] > 2000


def test_empty_table(make_docs):
    assert S.removals(make_docs([])).count() == 0
    assert [r.n_removed for r in S.removals(make_docs([(1, None)])).collect()] == [0]


def test_hits_of_many_texts_at_once():
    marks = [[(0, 3, None), (5, 4, [False, True, False, True])], [], [(2, 2, [True, False])],
             [(60, 5, None)]]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()),
                               ("hit", pa.list_(pa.bool_()))]))
    made = pa.array([[{"start": s, "n": n, "hit": h} for s, n, h in m]
                     for m in [[(1, 1, None)], *marks]], kind).slice(1)
    first, after, cuts = S._stretches(made)
    data = random.Random(5).randbytes(130)
    for m, x, y in zip(marks, cuts[:-1], cuts[1:]):
        gone = {s + i + k for s, n, hit in m for i in range(n) if hit is None or hit[i]
                for k in range(S.LENGTH)}
        runs = sum(i in gone and i - 1 not in gone for i in range(len(data)))
        rest = bytes(b for i, b in enumerate(data) if i not in gone)
        assert S._without(data, first[x:y], after[x:y]) == (
            len(gone), runs, hashlib.sha256(rest).hexdigest())


def test_pieces_of_many_texts_are_those_of_each(monkeypatch):
    rnd = random.Random(7)
    texts = [b"", b"x" * 49, b"ab" * 100, b"q" * 50, b"",
             *(bytes(rnd.choice(b"abc ") for _ in range(rnd.choice([0, 3, 60, 700])))
               for _ in range(60)), b"y" * 30]
    want = [(k, *p) for k, t in enumerate(texts) for p in zip(*(x.tolist() for x in S.pieces(t)))]
    cuts = np.cumsum([5, *map(len, texts)])
    for at_once in (1, 7, 64, 1 << 15):
        monkeypatch.setattr(S, "WINDOWS_AT_ONCE", at_once)
        h, first, n, text = S.pieces_of(b"-" * 5 + b"".join(texts), cuts)
        assert list(zip(text.tolist(), h.tolist(), (first - cuts[text]).tolist(), n.tolist())) == want
    assert len(S.pieces_of(b"", np.array([0]))[0]) == 0


def test_filter_grows_with_the_texts(monkeypatch):
    """With 10 GB of texts few pieces pass it that are found in one text only."""
    assert S.filter_bits(0) == S.filter_bits(850_000_000) == S.FILTER_BITS
    rnd = np.random.default_rng(8)
    monkeypatch.setattr(S, "FILTER_BITS", 12)
    for n_bytes, bits in ((1 << 20, 15), (1 << 40, S.BITS_AT_MOST)):
        assert S.filter_bits(n_bytes) == bits
    top, bitmap = 4, np.zeros(1 << 12, np.uint8)  # 2^15 bits
    held, other = rnd.integers(0, 1 << 64, (2, 1000), np.uint64)
    base = (held >> np.uint64(64 - top)).astype(np.int64) << (15 - top)
    for p in S._places(held, 15 - top):
        np.bitwise_or.at(bitmap, base + p >> 3, (128 >> (base + p & 7)).astype(np.uint8))
    assert S._passes(held, bitmap, top).all() and S._passes(other, bitmap, top).mean() < 0.05


def test_only_stretches_that_may_be_shared_are_ordered(monkeypatch):
    rnd = random.Random(9)
    text = lambda n: bytes(rnd.choice(b"abcdefghijk") for _ in range(n))
    gram, passage = text(S.GRAM), text(55)
    contents = [text(20) + gram + text(26) for _ in range(200)]  # one minimizer, no window in common
    contents += [bytes([x]) * 3 + passage + bytes([x]) * 10 for x in b"opqrst"]
    owner = np.arange(len(contents))[::-1].copy()
    seen = []
    real = S.window_owners
    monkeypatch.setattr(S, "window_owners", lambda c, o: seen.extend(c) or real(c, o))
    got = S._ordered(contents, owner, np.zeros(len(contents), np.int64))
    assert seen == [passage]
    first = {}
    for c, o in sorted(zip(contents, owner.tolist()), key=lambda x: x[1]):
        for k in range(len(c) - S.LENGTH + 1):
            first.setdefault(c[k:k + S.LENGTH], o)
    for c, o, least in zip(contents, owner.tolist(), got):
        want = [first[c[k:k + S.LENGTH]] for k in range(len(c) - S.LENGTH + 1)]
        assert (least is None and set(want) == {o}) or least.tolist() == want


def test_many_later_copies_leave_the_texts_to_one_shuffle(make_docs, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    labels, rows = [], _rows()
    real = S.stored
    monkeypatch.setattr(S, "stored", lambda df, label: labels.append(label) or real(df, label))
    _same(make_docs(rows), rows)
    assert labels.count("dedup-texts") == 1
