"""Very long inputs, and input columns named like those the operators use."""

import time

from recordflow.llm import quality, quotes, secret_scan, tiling, urls

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow")]


def test_a_host_of_many_labels(spark):
    pages = spark.createDataFrame(
        [(1, "http://" + "a." * 20_000 + "example.com/en/71"), (2, "http://" + "b." * 20_000 + "org/en/")],
        "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    start = time.monotonic()
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: (None, "allow")}
    assert time.monotonic() - start < 20


def test_a_message_of_many_lines(spark):
    said = "\n".join(f"line number {i} of a long message." for i in range(8000))
    quoted = "\n".join("> " + line for line in said.split("\n"))
    messages = spark.createDataFrame(
        [(1, 1, "user", said, "q", "s"), (1, 2, "user", "Something else.", "q", "s"),
         (1, 3, "user", quoted + "\n\nI agree.", "q", "s")],
        "conv_id bigint, turn bigint, role string, text string, quoted string, said string")
    start = time.monotonic()
    got = {r.turn: (r.parent_turn, r.body) for r in quotes.link(messages).collect()}
    assert got[3] == (1, "I agree.") and got[2][1] == "Something else."
    assert time.monotonic() - start < 60


def test_items_of_one_text_keep_their_ids(spark, rows):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x y z " + text, "k")], "doc_id bigint, text string, _text_key string")
    items = spark.createDataFrame([(i, text) for i in range(5)] + [(None, text)], "item_id bigint, text string")
    found = tiling.matches(docs, items)
    assert rows(found, "doc_id", "item_id", "_text_key") == sorted(
        [(1, i, "k") for i in (*range(5), None)], key=repr)
    assert tiling.remove(docs, items).count() == 0
    clean = spark.createDataFrame([(2, "a b c d e f g", "k")], docs.schema)
    assert rows(tiling.remove(clean, items)) == [(2, "a b c d e f g", "k")]


def test_clashing_columns_stay(make_docs, rows):
    docs = make_docs([(1, "token = abcdef123 and more"), (2, None)], _quality="q", _spans="s")
    assert rows(quality.judge(docs), "doc_id", "_quality") == [(1, "q"), (2, "q")]
    assert rows(secret_scan.redact(docs), "doc_id", "text", "_spans") == [
        (1, "[secret] and more", "s"), (2, None, "s")]
