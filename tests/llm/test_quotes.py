"""Quotation linking against a plain walk of the reply tree."""

import hashlib
import random
import re

from recordflow.llm import quotes as Q


def norm(t):
    return re.sub(r"\s+", " ", t.lower()).strip()


def lines_of(text):
    out = []
    for x in (text or "").replace("\r", "").split("\n"):
        m = re.match(r"[ \t]*>[ \t>]*", x)
        out.append((m.group(0).count(">") if m else 0, x[m.end():] if m else x))
    said = re.compile(r"(?i)\b(wrote|writes|schrieb|écrit|escribió)\s*:\s*$")
    return [(-1 if lv == 0 and said.search(c) and i + 1 < len(out) and out[i + 1][0] > 0 else lv, c)
            for i, (lv, c) in enumerate(out)]


def passages(lines):
    runs = []
    for i, (lv, c) in enumerate(lines):
        blank = not c.strip(" ")
        if i and runs[-1][0] == lv and runs[-1][2] == blank:
            runs[-1][1].append(c)
        else:
            runs.append([lv, [c], blank])
    whole = [(lv, norm(" ".join(cs))) for lv, cs, _ in runs]
    whole = [p for p in whole if p[1]]
    return whole, ([(lv, norm(c)) for lv, c in lines if norm(c)]
                   + [(lv, x) for lv, t in whole for x in re.split("(?<=[.!?]) ", t)])


def brute(rows):
    """{(conv, turn): (links, parent, position)} of rows (conv, turn, text)."""
    first, quoted, out = {}, {}, {}
    for conv, turn, text in rows:
        if conv is None or turn is None:
            continue
        runs, single = passages(lines_of(text))
        for lv, p in runs + single:
            if lv == 0:
                first[conv, p] = min(turn, first.get((conv, p), turn))
            elif lv > 0:
                quoted.setdefault((conv, turn), set()).add((lv, p))
    for conv in {c for c, t, _ in rows if c is not None}:
        turns = sorted({t for c, t, _ in rows if c == conv and t is not None})
        parent, links, kids = {}, {}, {}
        for k, t in enumerate(turns):
            links[t] = sorted({(lv, first[conv, p]) for lv, p in quoted.get((conv, t), ())
                               if first.get((conv, p), t) < t})
            one = [f for lv, f in links[t] if lv == 1]
            parent[t] = max(one) if one else turns[k - 1] if k else None
            kids.setdefault(parent[t], []).append(t)
        todo, place = list(reversed(kids.get(None, []))), 0
        while todo:
            t = todo.pop()
            place += 1
            out[conv, t] = (links[t], parent[t], place)
            todo += reversed(kids.get(t, []))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(c, t, x, "old", "u") for c, t, x in rows],
                               "conv_id int, turn int, text string, body string, role string")
    want = brute(rows)
    got = Q.link(df).collect()
    assert len(got) == len(rows)
    for r in got:
        links, parent, place = want.get((r.conv_id, r.turn), ([], None, None))
        assert [tuple(x) for x in r.links] == links
        assert (r.parent_turn, r.position) == (parent, place), (r.conv_id, r.turn)
        lines = lines_of(r.text)
        assert r.body == "\n".join(c for lv, c in lines if lv == 0).strip(" \t\n")
        assert r.n_quotes == sum(lv > 0 for lv, _ in passages(lines)[0])
    return got


def test_levels_and_odd_rows(spark):
    a = "Shall we meet?\nAt noon, in the old\nmarket hall."
    rows = [(1, 0, a), (1, 1, "On Monday Ann wrote:\n> Shall we meet?\n\nYes."),
            (1, 2, "> > Shall we MEET?\n>  Yes.\nFine"), (1, 3, "nothing quoted"),
            (1, 4, "> At noon, in the old market hall.\nno"), (1, 4, "> At noon, in the old market hall.\nno"),
            (1, 7, "> never said\nwhat"), (1, 9, "> what\n> nothing quoted"), (2, 5, None), (2, 6, ""),
            (None, 1, "> x\ny"), (3, None, a), (2, -4, ">>>\n> \n>"), (2, 8, "> " * 500 + "deep"),
            (4, 1, "\r\nx\r\n> x\r\n"), (5, 0, "word\n" * 3000), (5, 1, "> word\n" * 3000 + "end")]
    by = {(r.conv_id, r.turn): r for r in check(spark, rows)}
    assert by[1, 1].body == "Yes." and by[1, 1].parent_turn == 0
    assert by[1, 4].parent_turn == 0 and by[1, 9].parent_turn == 7
    assert hashlib.md5(b"x").hexdigest()


def test_random_trees(spark):
    rnd = random.Random(6)
    rows = []
    for conv in range(6):
        n = rnd.choice([1, 5, 30, 60])
        for t in range(n):
            own = f"line {conv} {t}\n\nsecond {t}"
            if t and rnd.random() < (0.8 if conv % 2 else 0.2):
                to = rnd.randrange(t)
                own = f"> line {conv} {to}\n>> line {conv} {rnd.randrange(t)}\n\n{own}"
            rows.append((conv, t * rnd.choice([1, 3]) if conv == 2 else t, own))
    check(spark, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id int, turn int, text string")
    assert Q.link(df).count() == 0
