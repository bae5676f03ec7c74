"""Text, number and scoring expressions. Native column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters a Unicode-aware strip removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85"
    "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Locator kind -> (score, label); every other kind scores 0.
LOCATOR_QUALITY = {
    "role": (100, "recommended"),
    "label": (95, "recommended"),
    "testid": (85, "good"),
    "text": (70, "acceptable"),
    "css": (40, "fragile"),
}
LOCATOR_FALLBACK = (0, "fragile")
READY_SCORE = 70

MB = 1048576
MB_SHOWN_ABOVE = 524287

# Character classes of the entropy score as (regex class body, alphabet size).
ENTROPY_CLASSES = [
    ("a-z", 26),
    ("A-Z", 26),
    ("0-9", 10),
    (r"!@#$%^&*()", 10),
    (r"""~`\-_=+\[\]{}|;:'",.<>?/""", 21),
]
ENTROPY_OTHER = 36


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once per row, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), 0)


def clean(c) -> Column:
    """Strip Unicode whitespace at both ends; NULL becomes ''."""
    return F.btrim(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit(STRIP_CHARS))


def slug_text(c) -> Column:
    """Lower-case words joined by '-'; '' where nothing is left."""
    return F.btrim(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def slugify(c, *id_keys) -> Column:
    """``slug_text``, with 'project-' and a stable 8-character id where it is empty."""
    fallback = F.concat(F.lit("project-"), short_id(8, *id_keys)) if id_keys else F.lit(None)
    return F.coalesce(F.nullif(slug_text(c), F.lit("")), fallback)


def identifierify(c) -> Column:
    """Lower-case words joined by a single '_'; '' stays ''."""
    words = F.regexp_replace(F.lower(clean(c)), "[^a-z0-9_]+", "_")
    return F.btrim(F.regexp_replace(words, "_{2,}", "_"), F.lit("_"))


def norm_email(c) -> Column:
    """Stripped, lower-cased address; empty is NULL."""
    return F.nullif(F.lower(clean(c)), F.lit(""))


def short_id(n: int, *keys) -> Column:
    """First ``n`` hex characters of a hash over the keys: the same in every task attempt."""
    parts = [F.coalesce(_col(k).cast("string"), F.lit("")) for k in keys]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n)


def score_by_type(c, table: dict | None = None, default=LOCATOR_FALLBACK) -> Column:
    """struct(score, label) of a locator kind."""
    kind = F.lower(clean(c))
    score = F.lit(default[0])
    label = F.lit(default[1])
    for name, (points, grade) in (LOCATOR_QUALITY if table is None else table).items():
        score = F.when(kind == name, F.lit(points)).otherwise(score)
        label = F.when(kind == name, F.lit(grade)).otherwise(label)
    return F.struct(score.alias("score"), label.alias("label"))


def status_by_score(score, given=None, ready_at: int = READY_SCORE) -> Column:
    """The given status, else ready / warning by score."""
    ladder = F.when(_col(score) >= ready_at, F.lit("ready")).otherwise(F.lit("warning"))
    return ladder if given is None else F.coalesce(_col(given), ladder)


def falsy_or(c, default, zero=0) -> Column:
    """``c`` unless it is NULL or equal to ``zero`` ('' for text, False for flags)."""
    return F.coalesce(F.nullif(_col(c), F.lit(zero)), F.lit(default))


def last_segment(c) -> Column:
    """Last path part after dropping trailing slashes; NULL where nothing is left."""
    return F.nullif(F.substring_index(F.rtrim(_col(c), F.lit("/")), "/", -1), F.lit(""))


def money2(c) -> Column:
    """Two decimals, rounding the exact binary value half to even (0.125 -> '0.12')."""
    return F.call_function("format_number", _col(c).cast("double"), F.lit("0.00"))


def template(fmt: str, *cols) -> Column:
    """printf-style text over columns."""
    return F.format_string(fmt, *[_col(c) for c in cols])


def hms(seconds) -> Column:
    """struct(h, m, s) of a number of seconds, each rounded down."""
    total = F.floor(_col(seconds)).cast("bigint")
    hours = F.floor(total / 3600).cast("bigint")
    rest = total - hours * 3600
    minutes = F.floor(rest / 60).cast("bigint")
    return F.struct(hours.alias("h"), minutes.alias("m"), (rest - minutes * 60).alias("s"))


def hms_text(seconds) -> Column:
    """'hh:mm:ss' of a number of seconds."""
    parts = hms(seconds)
    return F.format_string("%02d:%02d:%02d", parts["h"], parts["m"], parts["s"])


def safe_ratio(part, total) -> Column:
    """part * 100 / total as a double, 0 where the total is 0."""
    return F.when(_col(total) == 0, F.lit(0.0)).otherwise(
        F.try_divide((_col(part) * 100).cast("double"), _col(total).cast("double"))
    )


def mb(size_bytes) -> Column:
    """Whole megabytes, NULL for sizes too small to show."""
    size = _col(size_bytes)
    return F.when(size > MB_SHOWN_ABOVE, F.floor(size / MB).cast("bigint"))


def char_entropy(c) -> Column:
    """Length times log2 of an alphabet score, two decimals; '' scores 0.

    The score adds the alphabet size of each character class present, one for each distinct
    character met after its class was known, and one per class change (the first counts).
    Restated without a walk: a class adds its distinct characters, less its first one unless
    that comes again. Distinct characters keep the order they first appear in, so the first of
    a class is the first among them. Characters are code points.
    """
    value = F.coalesce(_col(c).cast("string"), F.lit(""))
    listed = "".join(body for body, _ in ENTROPY_CLASSES)
    classes = [(f"[{body}]", size) for body, size in ENTROPY_CLASSES]
    classes.append((f"[^{listed}]", ENTROPY_OTHER))

    def member_of(one: str):
        return lambda ch: ch.rlike(one)

    def alphabet(seen: Column) -> Column:
        total = F.lit(0)
        for one, size in classes:
            own = F.filter(seen, member_of(one))
            first = F.get(own, 0)
            again = F.position(first, value, F.position(first, value) + 1) > 0
            points = F.lit(size) + F.size(own) - F.when(again, 0).otherwise(1)
            total = total + F.when(F.size(own) == 0, 0).otherwise(points)
        return total

    distinct = F.array_distinct(F.split(value, ""))
    runs = F.length(F.regexp_replace(value, "|".join(f"{one}+" for one, _ in classes), "x"))
    score = bind(distinct, alphabet) + runs
    bits = F.length(value) * F.log(score.cast("double")) / F.lit(0.6931471805599453)
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(F.floor(bits * 100 + 0.5) / 100)
