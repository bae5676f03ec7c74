"""Spelling variants against brute force."""

import random
import zlib

import pytest

from recordflow.llm import spelling

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = {}
    for doc_id, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
                continue
            if run:
                h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
                if h % 31 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                if len(run) >= 7:
                    counts[run] = counts.get(run, 0) + 1
            run = ""
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def changed(rng, word, letters):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice(letters) + word[i:],
                       word[:i] + rng.choice(letters) + word[i + 1:]])


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aeioußàÿ×"])
def test_agrees_with_brute_force(make_docs, rows, letters):
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(12)]
    pool = base * 12 + [changed(rng, w, letters) for w in base for _ in range(4)]
    pool += [changed(rng, changed(rng, w, letters), letters) for w in base for _ in range(4)]
    docs = [(i, " ".join(rng.choices(pool, k=60))) for i in range(40)]
    assert rows(spelling.variants(make_docs(docs)), *COLUMNS) == brute(docs)


def test_every_single_edit_shares_a_signature():
    rng = random.Random(7)
    for _ in range(3000):
        a = "".join(rng.choice("aabcdé") for _ in range(rng.randint(2, 14)))
        b = changed(rng, a, "abcdéx")
        if a == b or len(b) < 2:
            continue
        a, b = sorted((a, b), key=len)
        first, second = spelling.signatures([a, b])
        own = set(first[:spelling.OWN])
        assert own & set(second[spelling.OWN:] if len(a) < len(b) else second[:spelling.OWN])


def test_chain_of_forms_ends_at_its_root(make_docs, rows):
    docs = [(None, " ".join(["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200))]
    assert rows(spelling.variants(make_docs(docs)), "word", "form", "root", "n_near") == [
        ("abcdefg", "abcdefgh", "abcdefghi", 1), ("abcdefgh", "abcdefghi", "abcdefghi", 2),
        ("abcdefghi", None, "abcdefghi", 1)]


def test_ties_repeats_nulls_and_extra_columns(make_docs, rows):
    docs = [(None, "Abcdefx abcdefX " + "abcdefa " * 20 + "abcdefb " * 20 + "ÀBCDEFG Àbcdefg"),
            (5, None), (5, ""), (6, "short words only")]
    out = rows(spelling.variants(make_docs(docs * 2, word="?", key="1", n="x", c="")), *COLUMNS)
    assert out == brute(docs * 2)
    assert ("abcdefx", "abcdefa", "abcdefa", 4, 2, 40) in out


def test_long_text_of_one_document(make_docs, rows):
    docs = [(3, "variant " * 100_000 + "varyant " * 9000 + "x" * 100_000)]
    assert rows(spelling.variants(make_docs(docs)), *COLUMNS) == brute(docs)


def test_empty_table(make_docs):
    assert spelling.variants(make_docs([])).count() == 0


def test_registered_query(spark, tmp_path, rows):
    from recordflow.llm.queries import QUERIES

    docs = [(i, "Variant varian words beautiful " * 12 + f"beautifull letter{i}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint",
                                "n_near": "bigint", "form_n": "bigint"}
    assert rows(out, *COLUMNS) == brute(docs)
