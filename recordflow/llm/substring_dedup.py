"""Suffix-array dedup: bytes covered by strings that also start in an earlier document go.

Every window of ``LENGTH`` bytes is filed under its minimizer, the smallest hash of the short strings
in it, so equal windows are filed alike. Consecutive windows with one minimizer make a piece of
text. Pieces whose minimizer occurs in one text only are left out by a filter of bounded size; of the
others, distinct ones meet by minimizer. The suffixes of the stretches in them that others may share
are put in order, and neighbours that agree in ``LENGTH`` bytes show which windows are shared, and
with which document first. The distinct pieces of a minimizer with more than ``GROUP_BYTES`` of them
never meet in one task: their windows are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm import lyndon
from recordflow.llm.common import stored, whole

#: Bytes of a string that counts as repeated, and of the strings hashed in it.
LENGTH, GRAM = 50, 24
#: The filter has 2 to one of these powers bits, 16 to 128 MB: one for so many bytes of text.
FILTER_BITS, BITS_AT_MOST, BYTES_A_BIT = 27, 30, 32
#: Windows hashed at once; their numbers stay in the processor's cache.
WINDOWS_AT_ONCE = 1 << 15
#: Hashes in one task of the filter, bytes of pieces in one task of ordering, bytes ordered at once,
#: and bytes of one minimizer up to which its pieces are ordered in one task.
HASHES_AT_ONCE, PIECES_AT_ONCE, ORDERED_AT_ONCE, GROUP_BYTES = 1 << 20, 1 << 20, 300_000, 1_200_000
#: Rows of (id, key) up to which a side is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Stands for a NULL id: after all others.
LAST = (1 << 63) - 1

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _words(data, start: int, n: int) -> np.ndarray:
    """The eight bytes from each of ``n`` places on as a number."""
    return np.ndarray(n, np.uint64, data, start, (1,)).copy()


def _mixed(h: np.ndarray, spare: np.ndarray) -> None:
    h *= _FACTOR
    np.right_shift(h, np.uint64(29), out=spare)
    h ^= spare


def pieces_of(data, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows, text) of the pieces of texts; none below ``LENGTH`` bytes.

    The i-th text has the bytes from cuts[i] to cuts[i + 1] of ``data``, where first windows are
    counted. A piece ends where the smallest hash changes, or where its leftmost place is left
    behind; so no piece has more windows than a window has strings.
    """
    begin, width = cuts[:-1], LENGTH - GRAM + 1
    lowest, windows = int(cuts[0]), int(cuts[-1]) - LENGTH + 1
    starts, least_at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    spare, one, other = (np.empty(WINDOWS_AT_ONCE + width, np.uint64) for _ in range(3))
    for a in range(lowest, windows, WINDOWS_AT_ONCE):
        b = min(windows, a + WINDOWS_AT_ONCE)
        low = max(a - 1, lowest)  # with the last window of the block before
        n = b - low + width - 1
        w = _words(data, low, n + GRAM - 8)
        h = w[:n].copy()
        _mixed(h, spare[:n])
        for o in range(8, GRAM, 8):
            h ^= w[o:o + n]
            _mixed(h, spare[:n])
        least, span = h, 1
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[:len(least) - step], least[step:],
                               out=one[:len(least) - step])
            one, other, span = other, one, span + step
        new = np.empty(len(least), bool)
        new[0] = a == lowest
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[1:] |= h[:len(least) - 1] == least[:-1]
        of_block = np.searchsorted(begin, (low, b))
        new[begin[of_block[0]:of_block[1]] - low] = True
        if low < a:
            new[0] = False
        at = np.flatnonzero(new)
        starts.append(at + low)
        least_at.append(least[at])
    first, least = np.concatenate(starts), np.concatenate(least_at)
    text = np.searchsorted(begin, first, "right") - 1
    stop = cuts[1:][text] - (LENGTH - 1)
    n = np.minimum(np.append(first[1:], windows)[:len(first)], stop) - first
    good = n > 0
    least = least[good]
    # Smallest hashes crowd at the low end: spread them again.
    spread = least * _FACTOR
    return spread ^ (spread >> np.uint64(31)), first[good], n[good], text[good]


def pieces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of the pieces of a text."""
    return pieces_of(data, np.array([0, len(data)]))[:3]


def _joined(column: pa.Array) -> tuple[pa.Buffer | bytes, np.ndarray]:
    """The bytes of texts one after the other, and the cuts between them."""
    if not len(column):
        return b"", np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, cuts, data = column.buffers()
    cuts = np.frombuffer(cuts, np.int64)[column.offset:column.offset + len(column) + 1]
    return data or b"", cuts


# --------------------------------------------------------------------- filter


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in its part of the filter; the part is told by the top bits."""
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(bits)) & mask).astype(np.int64)


def _twice_at_most(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The hashes in order: once where one text holds it, twice where several do."""
    if not len(h):
        return h
    order = np.argsort(h)
    h, text = h[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)
    return np.repeat(h[first], 1 + several)


def filter_bits(n_bytes: int) -> int:
    """The filter grows with the texts, so that few pieces pass it that none shares."""
    return min(max(int(np.ceil(np.log2(max(1, n_bytes) / BYTES_A_BIT))), FILTER_BITS), BITS_AT_MOST)


def shared_filter(texts: DataFrame, n_bytes: int) -> tuple[np.ndarray, int]:
    """Bits of the minimizers that occur in two texts or more, and how many top bits of a hash tell
    its part. Each part of the filter is made by one task from its own hashes; a batch of texts
    hands on a minimizer twice at most."""
    windows = (LENGTH - GRAM) / 2 + 1  # of a piece, about
    top = min(16, max(4, int(np.ceil(np.log2(max(1.0, n_bytes / windows / HASHES_AT_ONCE))))))
    all_bits = filter_bits(n_bytes)
    bits = all_bits - top

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _, _, text = pieces_of(*_joined(batch.column(0)))
            h = _twice_at_most(h, text)
            if not len(h):
                continue
            part = (h >> np.uint64(64 - top)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange((1 << top) + 1))
            which = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(which, pa.int32()),
                 pa.array([h[cuts[p]:cuts[p + 1]].tobytes() for p in which.tolist()], pa.binary())],
                names=["part", "h"])

    def make(table: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in table["h"].to_pylist()]))
        often = h[1:][h[1:] == h[:-1]]
        part = np.zeros(1 << bits, bool)
        for p in _places(often, bits):
            part[p] = True
        return pa.table({"part": table["part"].slice(0, 1).combine_chunks(),
                         "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    out = np.zeros(1 << (all_bits - 3), np.uint8)
    size = 1 << (bits - 3)
    rows = (texts.select("text").mapInArrow(hand_on, "part int, h binary")
            .groupBy("part").applyInArrow(make, "part int, bits binary").collect())
    for r in rows:
        out[r["part"] * size:(r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out, top


def _passes(h: np.ndarray, bitmap: np.ndarray, top: int) -> np.ndarray:
    bits = len(bitmap).bit_length() + 2 - top
    base = (h >> np.uint64(64 - top)).astype(np.int64) << bits
    good = np.ones(len(h), bool)
    for p in _places(h, bits):
        at = base + p
        good &= (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1) == 1
    return good


# -------------------------------------------------------------------- ordering


def window_owners(contents: list[bytes], owner: np.ndarray) -> list[np.ndarray]:
    """For each window of each content, the smallest owner among the contents that hold it.

    The suffixes of all contents are put in order; windows that agree in ``LENGTH`` bytes are
    neighbours then.
    """
    size = np.fromiter(map(len, contents), np.int64, len(contents))
    order = np.argsort(-size, kind="stable")
    size = size[order]
    width = int(size[0])
    data = np.zeros((len(contents), width + lyndon.BLOCK), np.uint8)
    joined = np.frombuffer(b"".join(contents[i] for i in order.tolist()), np.uint8)
    data[np.arange(data.shape[1]) < size[:, None]] = joined
    rank = lyndon.suffix_ranks(data, size)
    packed = lyndon.blocks(data, width)
    row, place = np.nonzero(np.arange(width) < (size - LENGTH + 1)[:, None])
    by_rank = np.argsort(rank[row, place])
    a, p = row[by_rank], place[by_rank]
    same = np.ones(len(a) - 1, bool)
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        same &= packed[a[1:], p[1:] + k] == packed[a[:-1], p[:-1] + k]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(owner[order][a], first)
    found = np.empty(len(a), np.int64)
    found[by_rank] = np.repeat(least, np.diff(np.append(first, len(a))))
    out: list[np.ndarray] = [found[:0]] * len(contents)
    ends = np.cumsum(size - LENGTH + 1)
    for i, b, e in zip(order.tolist(), (ends - (size - LENGTH + 1)).tolist(), ends.tolist()):
        out[i] = found[b:e]
    return out


def _span_shared(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First window of each content that may be shared, and the one after the last: by hashes, so
    some that are not are among them. Both are 0 where no window is."""
    size = np.fromiter(map(len, contents), np.int64, len(contents))
    n = size - LENGTH + 1
    ends = np.cumsum(n)
    begin = np.cumsum(size) - size
    place = np.arange(ends[-1]) + np.repeat(begin - ends + n, n)
    data = b"".join(contents)
    w = _words(data, 0, len(data) - 7)
    h, spare = w[place], np.empty(len(place), np.uint64)
    _mixed(h, spare)
    for o in (*range(8, LENGTH - 7, 8), LENGTH - 8):
        h ^= w[place + o]
        _mixed(h, spare)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    shared = np.zeros(len(h) + 1, bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    at = np.flatnonzero(shared)
    # The first shared window at or after a content's first one, and the last before its end.
    low, high = np.searchsorted(at, ends - n), np.searchsorted(at, ends)
    some = low < high
    at = np.append(at, 0)
    return (np.where(some, at[low] - (ends - n), 0),
            np.where(some, at[np.maximum(high, 1) - 1] - (ends - n) + 1, 0))


def _ordered(contents: list[bytes], owner: np.ndarray, h: np.ndarray) -> list[np.ndarray | None]:
    """``window_owners`` by minimizer, None where all windows have the content's own owner.

    Minimizers with one content need no order. Of the other contents, the stretches are ordered that
    may be shared, equal ones once, a few minimizers at a time.
    """
    out: list[np.ndarray | None] = [None] * len(contents)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1], [True]])
    several = ~(new[1:] & new[:-1])
    group = np.cumsum(new[:-1])[several]
    order = order[several].tolist()
    if not order:
        return out
    first, after = _span_shared([contents[i] for i in order])
    size_of = np.bincount(group, np.where(after > first, after - first + LENGTH - 1, 0))
    waiting: list[tuple[int, int, bytes]] = []  # content, window a stretch begins with, stretch
    stretches: dict[bytes, int] = {}  # with the smallest owner

    def settle() -> None:
        if stretches:
            at = {c: k for k, c in enumerate(stretches)}
            found = window_owners(list(stretches), np.fromiter(stretches.values(), np.int64))
            for i, a, c in waiting:
                least = found[at[c]]
                if (least < owner[i]).any():
                    out[i] = np.full(len(contents[i]) - LENGTH + 1, owner[i])
                    out[i][a:a + len(least)] = least
            waiting.clear()
            stretches.clear()

    load, last = 0, 0
    for i, g, a, b in zip(order, group.tolist(), first.tolist(), after.tolist()):
        if a == b:
            continue
        if g != last and load + size_of[g] > ORDERED_AT_ONCE:
            settle()
            load = 0
        last = g
        c = contents[i][a:b + LENGTH - 1]
        waiting.append((i, a, c))
        held = stretches.get(c)
        if held is None:
            load += len(c)
        stretches[c] = int(owner[i]) if held is None else min(held, int(owner[i]))
    settle()
    return out


def _crowded(dealt: DataFrame) -> DataFrame:
    """(h) of the minimizers whose contents have more than ``GROUP_BYTES``.

    Only parts that have more can hold one, so few rows are counted by minimizer."""
    dealt = dealt.select("part", "h", "bytes")
    full = stored(dealt.groupBy("part").agg(F.sum("bytes").alias("load"))
                  .where(F.col("load") > GROUP_BYTES).select("part"), "dedup-full")
    return stored(dealt.join(full, "part", "left_semi").groupBy("h")
                  .agg(F.sum("bytes").alias("load")).where(F.col("load") > GROUP_BYTES)
                  .select("h"), "dedup-crowded")


def _digest(contents: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh128_digest(c) for c in contents.to_pylist()], pa.binary())


def _by_window(hot: DataFrame) -> DataFrame:
    """(digest, first, hit) of contents (content, owner, n) of any number under one minimizer.

    Their windows, at most ``LENGTH`` a content, are spread by their own bytes; the smallest owner of
    each is an aggregate, and goes back to the contents that hold the window."""
    digest = F.arrow_udf(_digest, "binary")
    hot = stored(hot.select(digest("content").alias("digest"), "content", "owner", "n"),
                 "dedup-hot")
    starts = F.sequence(F.lit(1), F.octet_length("content") - F.lit(LENGTH - 1))
    windows = hot.select("digest", "owner", "n", F.posexplode(
        F.transform(starts, lambda i: F.substring("content", i, F.lit(LENGTH)))).alias("place", "w"))
    least = windows.groupBy("w").agg(F.min("owner").alias("m"))
    whole_ = (windows.join(least, "w").groupBy("digest", "owner", "n")
              .agg(F.sort_array(F.collect_list(F.struct("place", "m")))["m"].alias("least")))
    shared = F.array_min("least") < F.col("owner")
    return (whole_.where(shared | (F.col("n") > 1))
            .select("digest", F.col("owner").alias("first"), F.when(
                shared, F.transform("least", lambda m: m < F.col("owner"))).alias("hit")))


# -------------------------------------------------------------------- operator


def _few(side: DataFrame) -> bool:
    """Whether ``side`` is broadcast."""
    return side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _stretches(marked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes, bytes after the last, cuts) of what goes: those from cuts[i] to cuts[i + 1] are
    of the i-th text. Where a piece has no hits of its own, all of it goes."""
    marks = marked.flatten()
    start, n, hit = (marks.field(k) for k in ("start", "n", "hit"))
    start, n = start.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64)
    whole_ = hit.is_null().to_numpy(zero_copy_only=False)
    flat = np.flatnonzero(hit.flatten().to_numpy(zero_copy_only=False).astype(bool))
    size = np.where(whole_, 0, hit.value_lengths().fill_null(0).to_numpy())
    ends = np.cumsum(size)
    of = np.searchsorted(ends, flat, "right")
    all_of = np.flatnonzero(whole_)
    first = start[of] + flat - (ends - size)[of]
    mark = np.concatenate([of, all_of])
    order = np.argsort(mark, kind="stable")
    cuts = np.cumsum(np.concatenate([[0], marked.value_lengths().fill_null(0).to_numpy()]))
    return (np.concatenate([first, start[all_of]])[order],
            np.concatenate([first + LENGTH, (start + n + LENGTH - 1)[all_of]])[order],
            np.searchsorted(mark[order], cuts))


def _without(data: bytes, first: np.ndarray, after: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, maximal removed runs, and sha256 of the rest, for a text that loses the bytes
    of some stretches, given by their first byte and the one after their last."""
    change = (np.bincount(first, minlength=len(data) + 1)
              - np.bincount(after, minlength=len(data) + 1))
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    Texts are UTF-8 bytes, NULL ones empty. A byte goes where a string of ``LENGTH`` bytes covers it
    that also starts in a document with a smaller id, judged on the texts as they are. Of equal
    texts only that of the smallest id is looked into; the others go as a whole, if they have
    ``LENGTH`` bytes. A NULL id comes after all others. Rows of one id don't remove one another.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).alias("text"))
    rows = rows.withColumn("owner", F.coalesce("doc_id", F.lit(LAST))).withColumn(
        "key", F.unhex(F.md5("text")))
    facts = stored(rows.select("doc_id", "owner", "key", F.octet_length("text").alias("n_bytes"),
                               F.sha2("text", 256).alias("whole_sha")), "dedup-facts")
    firsts = facts.groupBy("key").agg(F.min("owner").alias("first"))
    later = stored(facts.join(firsts, "key").where("owner > first").select("key", "owner")
                   .distinct(), "dedup-later")
    rows = rows.where(F.octet_length("text") >= LENGTH).select("text", "owner", "key")
    if _few(later):
        texts = rows.join(F.broadcast(later), ["key", "owner"], "left_anti")
    else:  # three passes read the texts: they are shuffled once
        texts = stored(rows.join(later, ["key", "owner"], "left_anti"), "dedup-texts")
    n_bytes = facts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bitmap, top = shared_filter(texts, n_bytes)

    held = docs.sparkSession.sparkContext.broadcast(bitmap)
    del bitmap

    def found(column: pa.Array):
        """The bytes of texts, and (minimizer, first byte, byte after the last, text) of their pieces
        that pass the filter."""
        data, cuts = _joined(column)
        h, first, n, text = pieces_of(data, cuts)
        good = np.flatnonzero(_passes(h, held.value, top))
        first = first[good]
        return bytes(data), h[good], first, first + n[good] + LENGTH - 1, text[good], cuts

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each content of a batch once, with its smallest owner."""
        for batch in batches:
            data, h, first, after, text, _ = found(batch.column(0))
            own: dict[bytes, int] = {}
            at = np.array([own.setdefault(data[a:b], len(own))
                           for a, b in zip(first.tolist(), after.tolist())], np.int64)
            if own:
                least = np.full(len(own), LAST)
                np.minimum.at(least, at, batch.column(1).to_numpy()[text])
                minimizer = np.empty(len(own), np.int64)
                minimizer[at] = h.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(own), pa.binary()), pa.array(minimizer), pa.array(least),
                     pa.array(np.bincount(at))], names=["content", "h", "owner", "n"])

    distinct = stored(texts.select("text", "owner")
                      .mapInArrow(contents, "content binary, h bigint, owner bigint, n bigint")
                      .groupBy("content", "h")
                      .agg(F.min("owner").alias("owner"), F.sum("n").alias("n"))
                      .withColumn("bytes", F.octet_length("content").cast("bigint")), "dedup-pieces")
    size = distinct.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = 1 + size // PIECES_AT_ONCE

    def order(table: pa.Table) -> pa.Table:
        texts_, n = table["content"].to_pylist(), table["n"].to_numpy()
        owner = table["owner"].to_numpy()
        least = _ordered(texts_, owner, table["h"].to_numpy())
        # Contents found once whose windows nothing shares remove nothing.
        keep = [i for i, x in enumerate(least) if x is not None or n[i] > 1]
        return pa.table({
            "digest": pa.array([xxhash.xxh128_digest(texts_[i]) for i in keep], pa.binary()),
            "first": pa.array(owner[keep], pa.int64()),
            "hit": pa.array([None if least[i] is None else least[i] < owner[i] for i in keep],
                            pa.list_(pa.bool_()))})

    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)))
    crowded = _crowded(dealt)
    judged = dealt.join(crowded, "h", "left_anti").drop("bytes").groupBy("part").applyInArrow(
        order, "digest binary, first bigint, hit array<boolean>")
    judged = stored(judged.unionByName(_by_window(dealt.join(crowded, "h", "left_semi"))),
                    "dedup-windows")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _, first, after, text, cuts = found(batch.column(0))
            digest = [xxhash.xxh128_digest(data[a:b]) for a, b in zip(first.tolist(), after.tolist())]
            start = (first - cuts[text]).astype(np.int32)
            n = (after - first - (LENGTH - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(text)), batch.column(1).take(pa.array(text)),
                 pa.array(start), pa.array(n), pa.array(digest, pa.binary())],
                names=["key", "owner", "start", "n", "digest"])

    # Of a content, its first owner loses the windows that others hold before it, and the others all.
    later_owner = F.col("owner") > F.col("first")
    marks = stored(texts.select("text", "owner", "key")
                   .mapInArrow(occurrences, "key binary, owner bigint, start int, n int, digest binary")
                   .join(judged, "digest")
                   .where(later_owner | F.col("hit").isNotNull())
                   .select("key", "start", "n", F.when(~later_owner, F.col("hit")).alias("hit"))
                   .groupBy("key").agg(F.collect_list(F.struct("start", "n", "hit")).alias("marks")),
                   "dedup-marks")

    @F.arrow_udf("struct<n_removed: bigint, n_spans: bigint, sha: string>")
    def cut(column: pa.Array, marked: pa.Array) -> pa.Array:
        out = []
        first, after, cuts = _stretches(marked)
        for t, x, y in zip(column.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            a, b, c = _without(t.encode("utf-8", "surrogatepass"), first[x:y], after[x:y])
            out.append({"n_removed": a, "n_spans": b, "sha": c})
        return pa.array(out, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()),
                                        ("sha", pa.string())]))

    held.destroy()
    touched = texts.select("key", "text")
    if _few(marks):
        touched = touched.join(F.broadcast(marks.select("key")), "key", "left_semi")
    results = (touched.join(marks, "key").select("key", cut("text", "marks").alias("r"))
               .groupBy("key").agg(F.first("r").alias("r")))
    full = F.col("owner") > F.col("first")
    full = full & (F.col("n_bytes") >= LENGTH)
    n_bytes_ = F.col("n_bytes").cast("bigint")

    def choose(gone, cut_value, none) -> Column:
        return F.when(full, gone).when(F.col("r").isNotNull() & (F.col("owner") == F.col("first")),
                                       cut_value).otherwise(none)

    zero = F.lit(0).cast("bigint")
    return (facts.join(firsts, "key").join(results, "key", "left")
            .select("doc_id", n_bytes_.alias("n_bytes"),
                    choose(n_bytes_, F.col("r.n_removed"), zero).alias("n_removed"),
                    choose(zero + 1, F.col("r.n_spans"), zero).alias("n_spans"),
                    choose(F.lit(hashlib.sha256(b"").hexdigest()), F.col("r.sha"),
                           F.col("whole_sha")).alias("kept_sha256")))
