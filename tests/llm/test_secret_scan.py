"""Secret scans against the patterns run over whole texts."""

import random
import re
import zlib

from recordflow.llm import secret_scan as S

ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], S.KINDS.index(s[0])))


def signed(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = S.BASE62[d] + digits
    return prefix + body + digits


GOOD = signed("ghp_", "aB3" * 10)
TEXTS = [None, "", "password=abc", "password=abcdef", "é PassWD : 'abcdefg' ü", "token=token=abcdefgh",
         "secret secret=\"x/y+z=\"", "api_key=abcdef apikey:abcdef", "ſecret=abcdefgh toKen=abcdefgh",
         "AKIA" + "A1" * 8, "akia" + "A1" * 8, "AKIAAKIA" + "A" * 13, "AKIA" + "A" * 15, "0" * 24, "0" * 23,
         "g" + "a1" * 12 + "g", "😀" * 3 + "f" * 40 + "é" + "e" * 30, "A" + "password" * 3000 + "=abcdefg",
         "password=" + "a" * 50000, GOOD, GOOD[:-1] + ("0" if GOOD[-1] != "0" else "1"), GOOD + "x",
         signed("npm_", "Zz9" * 10), "card number: 4111 1111 1111 1111", "card: 4111 1111 1111 1112",
         "token=" + "f" * 30, "password = 'abcdef' password='ghijkl'"]


def test_base_spans_against_whole_text_patterns():
    rnd = random.Random(3)
    parts = ["password", "PASSWD", "token", "api_key", "=", ":", " ", "'", '"', "abc", "0f0f0f0f0f0f",
             "AKIA", "A1B2C3D4E5F6G7H8", "é", "😀", "\n", "secret", "x"]
    texts = TEXTS[1:] + ["".join(rnd.choice(parts) for _ in range(30)) for _ in range(3000)]
    for t in texts:
        assert [s for s in S.find(t) if s[0] in S.BASE_KINDS] == brute(t), t


def test_checksums_decide():
    kinds = {i: [k for k, _, _ in S.find(t or "")] for i, t in enumerate(TEXTS)}
    at = TEXTS.index(GOOD)
    assert "github" in kinds[at] and "github" not in kinds[at + 1] + kinds[at + 2]
    assert "npm" in kinds[at + 3] and "card" in kinds[at + 4] and "card" not in kinds[at + 5]
    assert S.luhn_holds(b"4111111111111111") and not S.luhn_holds(b"0000000000000000")


def test_scan_and_redact(make_docs):
    docs = make_docs(list(enumerate(TEXTS)), spans="old", source="s")
    rows = S.scan(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert [tuple(s) for s in r.spans] == S.find(TEXTS[r.doc_id] or "")
    clean = {r.doc_id: r.text for r in S.redact(docs).collect()}
    for i, t in enumerate(TEXTS):
        spans = S.find(t or "")
        if not spans:
            assert clean[i] == t
            continue
        covered, out, inside = {p for _, a, b in spans for p in range(a, b)}, "", False
        starts = {a for _, a, _ in spans}
        end = 0
        for k, a, b in spans:  # overlapping spans give one mark, touching ones two
            if a >= end:
                out += t[end:a] + "[secret]"
            end = max(end, b)
        assert clean[i] == out + t[end:]
        assert covered and starts


def test_empty_table(make_docs):
    assert S.redact(make_docs([])).count() == 0
    assert S.scan(make_docs([])).count() == 0
