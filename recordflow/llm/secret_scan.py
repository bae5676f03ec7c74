"""Secret scans: a keyword automaton finds where to look, anchored patterns look only there.

The text is passed once through an Aho-Corasick automaton of lower-cased keywords; runs of hex
digits are found by the same idea on the text with each byte mapped to its class. A pattern is
tried only at the place of a hit. Kinds whose tokens carry a checksum are reported only where it
holds.
"""

from __future__ import annotations

import functools
import re
import string
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import unused, whole

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "card")

# The patterns of the base kinds and of tokens that carry a checksum.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    rb"([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
CARD = re.compile(rb"""(?i:card)(?:[\x20_-]?(?i:number|no))?["']?\x20*[:=#]?\x20*["']?"""
                  rb"([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])")
HEX_LENGTH, ACCESS_LENGTH, ASSIGN_LENGTH = 24, 20, 6
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase

KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
    "card": ["card"],
}

_IS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = re.compile(rb"x{%d,}" % HEX_LENGTH)

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def checksum_holds(token: bytes) -> bool:
    """The last six characters are the CRC-32 of the others in base 62."""
    value, digits = zlib.crc32(token[:-6]), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return token[-6:] == digits.encode()


def luhn_holds(number: bytes) -> bool:
    """The check digit of a card number."""
    digits = [b - 48 for b in number if 48 <= b <= 57]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return any(digits) and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


#: Kind -> (pattern, what a match must hold to be reported).
CHECKS = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= ASSIGN_LENGTH),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_LENGTH),
    "github": (GITHUB, lambda m: checksum_holds(m[1])),
    "npm": (NPM, lambda m: checksum_holds(m[1])),
    "card": (CARD, lambda m: luhn_holds(m[1])),
}


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for k in keywords:
            automaton.add_word(k, (kind, len(k)))
    automaton.make_automaton()
    return automaton


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text in code points, by start, then kind."""
    data = text.encode("utf-8", "surrogatepass")
    found = [("hex", m.start(), m.end()) for m in _HEX_RUN.finditer(data.translate(_IS_HEX))]
    hits: dict[str, list[int]] = {}
    # One character per byte, so that places in the automaton's text are places in the bytes.
    for end, (kind, size) in _automaton().iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end + 1 - size)
    for kind, places in hits.items():
        pattern, holds = CHECKS[kind]
        free = 0  # matches of a kind don't overlap, whether they are reported or not
        for at in sorted(places):
            if at >= free and (m := pattern.match(data, at)):
                free = m.end()
                if holds(m):
                    found.append((kind, at, free))
    if found and len(data) != len(text):
        points, before, n = {}, 0, 0
        for at in sorted({x for _, a, b in found for x in (a, b)}):
            n += len(data[before:at].decode("utf-8", "surrogatepass"))
            points[at], before = n, at
        found = [(k, points[a], points[b]) for k, a, b in found]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: the spans (kind, start, end) of secrets in the whole text, in code
    points, the end exclusive, by start and then in the order of ``KINDS``.

    NULL and empty texts have none. Spans of one kind never overlap, those of different kinds may.
    A column called ``out`` is replaced.
    """

    @F.arrow_udf(SPANS)
    def spans_of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                   ("end", pa.int64())]))
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(t)]
                         for t in texts.to_pylist()], kind)

    return docs.withColumn(out, spans_of(whole(text)))


def of_kinds(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``, overlapping spans by one.

    Texts without secrets, NULL ones too, stay as they are; all columns stay.
    """
    found, = unused(docs, "spans")
    spans = scan(docs, text, found)
    merged = F.aggregate(
        found,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] < acc["at"],
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        ).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"],
                     F.substring(F.col(text), (acc["at"] + 1).cast("int"),
                                 (s["start"] - acc["at"]).cast("int")),
                     F.lit(mark)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(
            F.col(text), (acc["at"] + 1).cast("int"), F.length(F.col(text)))))
    return (spans.withColumn(text, F.when(F.size(found) > 0, merged).otherwise(F.col(text)))
            .drop(found))
