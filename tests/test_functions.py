import json
import math
import random
import re

from pyspark.sql import functions as F

from recordflow.functions import jsonx
from recordflow.functions import text as x


def evaluate(spark, values, *exprs, schema="i int, v string"):
    df = spark.createDataFrame(list(enumerate(values)), schema)
    found = df.select("i", *[e.alias(f"e{n}") for n, e in enumerate(exprs)]).collect()
    return [tuple(r)[1:] for r in sorted(found, key=lambda r: r["i"])]


def test_clean_strips_what_python_strips(spark):
    spaces = [chr(i) for i in range(0x3001) if not chr(i).strip()]
    values = [f"{s}a{s}b{s}" for s in spaces] + ["​a​", "", None, "  "]
    want = [(v or "").strip() for v in values]
    assert [r[0] for r in evaluate(spark, values, x.clean("v"))] == want


def test_slugs_and_identifiers(spark):
    values = ["Café  Über 2!", "--A__b--", "", None, "a-2", "__x__ _y", "日本", " 9 ", "A\nB"]

    def slug(v):
        return re.sub("[^a-z0-9]+", "-", (v or "").strip().lower()).strip("-")

    def ident(v):
        v = re.sub("[^a-z0-9_]+", "_", (v or "").strip().lower())
        return re.sub("_{2,}", "_", v).strip("_")

    got = evaluate(spark, values, x.slug_text("v"), x.slug_text(x.slug_text("v")),
                   x.identifierify("v"), x.slugify("v", "i"))
    for v, (once, twice, name, full) in zip(values, got):
        assert once == twice == slug(v)
        assert name == ident(v)
        assert full == slug(v) or (slug(v) == "" and re.fullmatch("project-[0-9a-f]{8}", full))


def test_money_rounds_like_python(spark):
    rng = random.Random(5)
    values = [0.125, 1.005, 2.675, 0.0, -0.125, 1e9 + 0.005, 79.0, 0.375, -1.5]
    values += [rng.uniform(-1e6, 1e6) for _ in range(300)] + [i / 8 for i in range(100)]
    got = evaluate(spark, values, x.money2("v"), schema="i int, v double")
    assert [r[0] for r in got] == ["%.2f" % v for v in values]


def test_email_segment_and_falsy(spark):
    values = [" A@B.c ", "", None, " "]
    assert [r[0] for r in evaluate(spark, values, x.norm_email("v"))] == ["a@b.c", None, None, None]
    urls = ["https://h/v2/orders/7XY", "https://h/a//", "///", "", None, "x"]
    assert [r[0] for r in evaluate(spark, urls, x.last_segment("v"))] == [
        "7XY", "a", None, None, None, "x"]
    texts = ["", None, "0", "0.00"]
    assert [r[0] for r in evaluate(spark, texts, x.falsy_or("v", "d", ""))] == [
        "d", "d", "0", "0.00"]


def test_ratio_sizes_and_times(spark):
    got = spark.range(1).select(
        x.safe_ratio(F.lit(1), F.lit(0)), x.safe_ratio(F.lit(1), F.lit(3)), x.mb(F.lit(524287)),
        x.mb(F.lit(524288)), x.mb(F.lit(3 * 1048576 + 5)), x.hms_text(F.lit(359999.9)),
        x.hms_text(F.lit(0))).first()
    assert tuple(got) == (0.0, 100 / 3, None, 0, 3, "99:59:59", "00:00:00")


def entropy(text):
    """The rule character by character."""
    classes = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
               "!@#$%^&*()", "~`-_=+[]{}|;:'\",.<>?/"]
    sizes = [26, 26, 10, 10, 21, 36]
    score, known, met, last = 0, set(), set(), None
    for c in text:
        at = next((n for n, body in enumerate(classes) if c in body), 5)
        if at not in known:
            known.add(at)
            score += sizes[at]
        elif c not in met:
            met.add(c)
            score += 1
        if at != last:
            score, last = score + 1, at
    if not text:
        return 0.0
    return math.floor(len(text) * math.log(score) / 0.6931471805599453 * 100 + 0.5) / 100


def test_entropy_matches_the_sequential_rule(spark):
    rng = random.Random(3)
    alphabet = "aabcXYZ019!@#$^&*()[]{}\\-_=+;:'\",.<>?/|~` \n\té日"
    values = ["", "a", "aa", "aba", "^]-\\[", "🚀🚀x"] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    got = [r[0] for r in evaluate(spark, values, x.char_entropy("v"))]
    assert got == [entropy(v) for v in values]


def test_json_validity_matches_a_strict_parser(spark):
    values = ['{"a":1}', '{"a":1}}', '{"a":1', "null", " null\n", "1,2", '1,"b":2', "1],[2", "", " ",
              "[]", "],[", '"x"', "tru", "true", '{"a":1,"a":2}', "[1,]", "{'a':1}", '1},{"b":2', None]

    def ok(v):
        try:
            json.loads(v)
            return True
        except (ValueError, TypeError):
            return False

    got = [bool(r[0]) for r in evaluate(spark, values, jsonx.is_json("v"))]
    assert got == [ok(v) for v in values]


def test_json_defaults(spark):
    values = ['{"k":5}', "{bad", "", None, "null", "{}", '{"k":5}x']
    parsed = jsonx.json_parse_or("v", "struct<k: bigint>",
                                 F.struct(F.lit(-1).cast("bigint").alias("k")))
    got = [r[0] if r[0] is None else r[0]["k"] for r in evaluate(spark, values, parsed)]
    assert got == [5, -1, -1, -1, None, None, -1]
    empties = spark.range(1).select(
        jsonx.json_or_empty(F.array().cast("array<int>"), "[]"),
        jsonx.json_or_empty(F.create_map().cast("map<string,int>")),
        jsonx.json_or_empty(F.struct(F.lit("é").alias("a")))).first()
    assert tuple(empties) == ("[]", "{}", '{"a":"é"}')


def test_capture_payload_edges(spark):
    full = {"status": "completed", "payer": {"email_address": "p@x.y"}, "purchase_units": [
        {"payments": {"captures": [{"id": "C1", "create_time": "2024-01-01T00:00:00Z",
                                    "amount": {"value": "79.00"},
                                    "seller_receivable_breakdown": {
                                        "paypal_fee": {"value": "2.10"},
                                        "net_amount": {"value": "76.90"}}}]}}]}
    values = [json.dumps(full), "{}", json.dumps({"purchase_units": []}),
              json.dumps({"status": "DECLINED", "purchase_units": [{"payments": {"captures": []}}]}),
              json.dumps({"purchase_units": [{"payments": {"captures": [{"id": "C2"}]}}]})]
    got = [tuple(r[0]) for r in evaluate(spark, values, jsonx.capture_fields("v"))]
    assert got == [
        ("COMPLETED", "p@x.y", "C1", "2024-01-01T00:00:00Z", "79.00", "2.10", "76.90"),
        ("", None, None, None, None, None, None), ("", None, None, None, None, None, None),
        ("DECLINED", None, None, None, None, None, None),
        ("", None, "C2", None, None, None, None)]


def test_webhook_takes_the_first_up_link_with_an_order(spark):
    links = [{"rel": "self", "href": "x"}, {"rel": "up", "href": "/"},
             {"rel": "up", "href": "https://h/orders/O7//"}, {"rel": "up", "href": "https://h/O8"}]
    values = [json.dumps({"event_type": "E", "resource": {"id": "C", "links": links}}),
              json.dumps({"event_type": "E", "resource": {"id": "", "links": []}}),
              json.dumps({"event_type": "E"})]
    got = [tuple(r[0]) for r in evaluate(spark, values, jsonx.webhook_fields("v"))]
    assert got == [("E", "C", "O7"), ("E", None, None), ("E", None, None)]
