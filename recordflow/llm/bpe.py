"""Byte-level BPE by speculation: propose greedily, verify adjacent pairs, merge only what fails.

For each distinct word, longest matches against the vocabulary propose a token sequence. Such a
sequence is the one that merging yields exactly when every two neighbours stay apart while their
bytes are merged on their own, so one vectorised test of all adjacent pairs settles a whole batch
of words. Words with a pair that fails are merged step by step.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import give_back, whole

# How byte-level vocabularies split text before merging.
SPLIT = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: Distinct words a worker keeps between texts; beyond it only the half used most stays.
KEPT_WORDS = 150_000
#: Words of text encoded at a time.
WORDS_AT_ONCE = 60_000
NEVER = np.int64(1) << 40
NO_MERGE = (1 << 40, -1)
#: Words of up to so many bytes are merged without a heap.
SHORT_WORD = 48


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 characters
    for themselves, the other bytes in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens and merges of one byte-level vocabulary file, as arrays."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        if data.get("normalizer") or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-level vocabularies are supported")
        letters = _byte_letters()
        size = max(max(model["vocab"].values()),
                   max((t["id"] for t in data["added_tokens"]), default=0)) + 1
        self.text = [b""] * size
        for token, i in model["vocab"].items():
            self.text[i] = bytes(letters[c] for c in token)
        self.special = {}
        for token in data["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("added tokens that look at their neighbours are not supported")
            self.special[token["content"]] = token["id"]
            self.text[token["id"]] = token["content"].encode()
        special = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

        ids = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        # rank: when a token is made; bytes are there from the start.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        key, when, made, odd = [], [], [], set()
        for r, (a, b) in enumerate(pairs):
            i, j, k = ids[a], ids[b], ids[a + b]
            if self.rank[k] >= 0:  # a second way to the same token: left to exact merging
                odd.add(k)
            else:
                self.rank[k], self.left[k], self.right[k] = r, i, j
            key.append(i << 32 | j)
            when.append(r)
            made.append(k)
        self.merges = {k: (r, m) for k, r, m in zip(key, when, made)}
        order = np.argsort(np.array(key, np.int64), kind="stable")
        self.keys = np.array(key, np.int64)[order]
        self.when = np.array(when, np.int64)[order]
        self.single = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.single[b] = ids[c]
        self.letter = self.single.tolist()
        self.sound = self._sound(odd)
        # Trie of all tokens that merging can yield: node << 8 | byte -> node.
        self.step: dict[int, int] = {}
        self.at_node = [-1]
        for i, word in enumerate(self.text):
            if word and self.sound[i]:
                node = 0
                for b in word:
                    following = self.step.get(node << 8 | b)
                    if following is None:
                        following = self.step[node << 8 | b] = len(self.at_node)
                        self.at_node.append(-1)
                    node = following
                self.at_node[node] = i

    def _sound(self, odd: set[int]) -> np.ndarray:
        """Which tokens come out of merging their own bytes."""
        sound = np.zeros(len(self.text), bool)
        sound[self.single] = True
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        first = self.first_merge(self.left[made], self.right[made])
        fits = first == self.rank[made]
        for k, good in zip(made.tolist(), fits.tolist()):
            sound[k] = good and k not in odd and sound[self.left[k]] and sound[self.right[k]]
        return sound

    def _when(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b, NEVER where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.when[at], NEVER)

    def first_merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the first merge across the border when left and right stand side by side and
        their bytes are merged; NEVER if they stay apart.

        The two tokens are taken apart again, the part made last first. At each step the parts at
        the border are there together until the one or the other is merged further inside its
        token; a merge across the border that is due before that crosses it. On equal ranks the
        place further left is merged first.
        """
        result = np.full(len(left), NEVER)
        who = np.arange(len(left))
        a, b = left.astype(np.int64), right.astype(np.int64)
        until_a = np.full(len(left), NEVER)
        until_b = until_a.copy()
        while len(who):
            due = self._when(a, b)
            crosses = (due < until_a) & (due <= until_b)
            result[who[crosses]] = due[crosses]  # an earlier one found later takes its place
            ra, rb = self.rank[a], self.rank[b]
            go = (ra >= 0) | (rb >= 0)
            who, a, b, until_a, until_b, ra, rb = (
                x[go] for x in (who, a, b, until_a, until_b, ra, rb))
            on_left = ra > rb
            until_a, until_b = np.where(on_left, ra, until_a), np.where(on_left, until_b, rb)
            a, b = np.where(on_left, self.right[a], a), np.where(on_left, b, self.left[b])
        return result

    def propose(self, word: bytes) -> list[int]:
        """Longest matches from left to right."""
        step, at_node, out, i, n = self.step, self.at_node, [], 0, len(word)
        while i < n:
            node, j, token, end = 0, i, -1, i
            while j < n:
                node = step.get(node << 8 | word[j])
                if node is None:
                    break
                j += 1
                if at_node[node] >= 0:
                    token, end = at_node[node], j
            out.append(token)
            i = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """The tokens of one word by merging: always the lowest rank, of equal ones the leftmost."""
        ids = [self.letter[b] for b in word]
        if len(ids) <= SHORT_WORD:
            return self._merge_short(ids)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(ids) and (m := self.merges.get(ids[i] << 32 | ids[j])):
                heap.append((m[0], i, ids[i], ids[j], m[1]))

        for i in range(len(ids)):
            offer(i)
        heapq.heapify(heap)
        while heap:
            _, i, a, b, token = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = token, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    offered = len(heap)
                    offer(k)
                    if len(heap) > offered:
                        heapq._siftdown(heap, 0, offered)
        return [t for t in ids if t >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same, looking through all pairs for the lowest rank."""
        merge_of = self.merges.get
        due = [merge_of(a << 32 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while due and (first := min(due)) is not NO_MERGE:
            i = due.index(first)
            ids[i:i + 2] = [first[1]]
            del due[i]
            if i:
                due[i - 1] = merge_of(ids[i - 1] << 32 | ids[i], NO_MERGE)
            if i < len(due):
                due[i] = merge_of(ids[i] << 32 | ids[i + 1], NO_MERGE)
        return ids

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Token ids of words, and how many had to be merged exactly."""
        out = [self.propose(w) for w in words]
        size = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for ids in out for t in ids), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(out)), size)
        border = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(flat[border] << 32 | flat[border + 1], return_inverse=True)
        apart = self.first_merge(pairs >> 32, pairs & 0xFFFFFFFF) == NEVER
        failing = np.unique(owner[border[~apart[where]]])
        for i in failing.tolist():
            out[i] = self.merge(words[i])
        return out, len(failing)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of each run, one run after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + size, size)


class _Store:
    """Words already encoded, as one ragged array."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.code: dict[str, int] = {v: i for i, v in enumerate(vocabulary.special)}
        self.flat = np.array(list(vocabulary.special.values()), np.int32)
        self.start, self.size = np.arange(len(self.flat)), np.ones(len(self.flat), np.int64)
        self.used = np.full(len(self.flat), NEVER)

    def shrink(self) -> None:
        """Keep the half of the words that were used most."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[:KEPT_WORDS // 2])
        words = list(self.code)
        self.code = {words[k]: i for i, k in enumerate(kept.tolist())}
        size = self.size[kept]
        self.flat = self.flat[_ragged(self.start[kept], size)]
        self.start, self.size, self.used = np.cumsum(size) - size, size, self.used[kept] // 2

    def codes(self, words: list[str]) -> np.ndarray:
        distinct = set(words)
        fresh = [w for w in distinct if w not in self.code]
        if len(self.code) > KEPT_WORDS // 2 and len(self.code) + len(fresh) > KEPT_WORDS:
            self.shrink()
            fresh = [w for w in distinct if w not in self.code]
        if fresh:
            ids, _ = self.vocabulary.encode_words([w.encode() for w in fresh])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            start = len(self.flat) + np.cumsum(size) - size
            self.code.update(zip(fresh, range(len(self.start), len(self.start) + len(fresh))))
            self.start, self.size = np.append(self.start, start), np.append(self.size, size)
            self.used = np.append(self.used, np.zeros(len(fresh), np.int64))
            self.flat = np.append(self.flat, np.fromiter(
                (t for x in ids for t in x), np.int32, int(size.sum())))
        code = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        self.used += np.bincount(code, minlength=len(self.used))
        return code

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids per text."""
        vocabulary, out, words, ends = self.vocabulary, [], [], []

        def settle() -> None:
            code = self.codes(words)
            size = self.size[code]
            ids, total = self.flat[_ragged(self.start[code], size)], np.cumsum(size)
            cuts = [int(total[e - 1]) if e else 0 for e in ends]
            out.extend(ids[a:b] for a, b in zip([0, *cuts], cuts))
            words.clear()
            ends.clear()

        for text in texts:
            for part in vocabulary.cut.split(text) if vocabulary.cut else [text]:
                if part in vocabulary.special:
                    words.append(part)
                else:
                    words.extend(SPLIT.findall(part))
            ends.append(len(words))
            if len(words) >= WORDS_AT_ONCE:
                settle()
        settle()
        return out


def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


def _with_store(batches: Iterator[pa.Array], file: str, made) -> Iterator[pa.Array]:
    """``made(store, batch)`` of every batch of a task. The store lasts as long as the task: workers
    live on, and what they keep counts for whatever runs in the executor next."""
    store = None
    try:
        for batch in batches:
            store = store or _Store(vocabulary(file))
            yield made(store, batch)
    finally:
        store = None
        give_back()


def _id_arrays(store: _Store, texts: pa.Array) -> pa.Array:
    ids = store.encode(texts.to_pylist())
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _texts(store: _Store, column: pa.Array) -> pa.Array:
    pieces = store.vocabulary.text
    flat = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_pylist()
    return pa.array([b"".join(map(pieces.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace")
                     for a, b in zip(ends, ends[1:])], pa.string())


def encode(docs: DataFrame, file: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the token ids (array of int) of every whole text.

    ``file`` is a byte-level vocabulary that every executor can open. Added tokens that occur in
    a text become their ids. NULL and empty texts give an empty array; a column called ``out`` is
    replaced, all others stay. Equal texts give equal ids, rows are judged one by one.
    """

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _with_store(batches, file, _id_arrays)

    return docs.withColumn(out, ids_of(whole(text)))


def decode(docs: DataFrame, file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``, the text that the token ids stand for, special tokens included.

    Bytes that are no UTF-8 become U+FFFD. NULL or empty ids give ''; ids the vocabulary does not
    have raise.
    """

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _with_store(batches, file, _texts)

    return docs.withColumn(out, text_of(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, file: str, text: str = "text", ids: str = "ids",
               decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of ``encode`` and the text that ``decode`` makes of them, by one pass
    through one Python worker a task."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def made(store: _Store, texts: pa.Array) -> pa.Array:
            ids = _id_arrays(store, texts)
            return pa.StructArray.from_arrays([ids, _texts(store, ids)], names=["ids", "decoded"])

        return _with_store(batches, file, made)

    return (docs.withColumn("_coded", both(whole(text))).withColumn(ids, F.col("_coded.ids"))
            .withColumn(decoded, F.col("_coded.decoded")).drop("_coded"))


def ids_digest(ids: str | Column) -> Column:
    """sha256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
