"""Toxicity: a learned lexicon in a trie, Levenshtein automata for misspellings, context windows.

The lexicon and the weights of the score are fitted on a bounded sample of labelled rows. A text is
scored by what its words match: an entry itself, an entry as the beginning of a longer word, or an
entry one edit away, which the intersection of the word's Levenshtein automaton with the trie of
entries finds. A hit counts by the hits around it, and for less where it is being quoted.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import stored, whole

#: Labelled rows of each class the model is fitted on, about, or all if there are fewer.
SAMPLE_PER_CLASS = 10_000
#: Entries of the lexicon, at most.
ENTRIES = 2_000
#: Likelihood ratio and log odds an entry needs, and how many entries a toxic text should hold
#: before others are no longer looked for on its account.
LEAST_RATIO, LEAST_ODDS, COVER = 30.0, 2.0, 2
#: Toxic texts that must hold an entry: so many, and such a share of them.
LEAST_TEXTS, LEAST_SHARE = 10, 0.002
#: Beginnings of words taken as terms.
STEMS = (4, 5, 6)
#: Entries from this length on are also matched one edit away.
FUZZY_LENGTH = 5
#: Words to either side of a hit that make up its context.
WINDOW = 20
#: What a misspelled entry counts, and a quoted one.
FUZZY_SHARE, QUOTED_SHARE = 0.7, 0.4
#: Distinct words whose match a worker keeps.
KEPT_WORDS = 200_000
#: Terms counted in a worker before they are handed on.
TERMS_AT_ONCE = 500_000

# Marks of quotation, words that announce one, digits used for letters.
QUOTES = "\"“”„«»"
REPORTING = {"said", "says", "wrote", "called", "quote", "quoted", "quoting", "sagte", "dit", "dijo"}
LEET = str.maketrans("013457", "oieast")

_TOKEN = re.compile(rf"\w+|[{QUOTES}]")
N_FEATURES = 6


def tokens(text: str) -> list[str]:
    """Words in lower case and quotation marks."""
    return _TOKEN.findall(text.lower())


def terms(words: set[str]) -> set[str]:
    """The words, and the beginnings of words marked by ``~``."""
    out = set(words)
    for k in STEMS:
        out.update(w[:k] + "~" for w in words if len(w) >= k)
    return out


class Trie:
    """Entries by letters; ``near`` walks it together with the automaton of a word."""

    def __init__(self, entries: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        for e in entries:
            node = 0
            for c in e:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.entry.append(None)
                node = self.next[node][c]
            self.entry[node] = e
        # One edit leaves the first or the second half of an entry as it is.
        self.heads = {e[:len(e) // 2] for e in entries}
        self.tails = {e[len(e) // 2:] for e in entries}
        self.head_sizes = sorted({len(h) for h in self.heads})
        self.tail_sizes = sorted({len(t) for t in self.tails})
        sizes = [len(e) for e in entries] or [0]
        self.shortest, self.longest = min(sizes) - 1, max(sizes) + 1

    def near(self, word: str) -> list[str]:
        """Entries at most one edit from the word.

        The automaton has a bit per place in the word, for no edit and for one; a letter of the
        trie moves both sets of bits on.
        """
        if not self.shortest <= len(word) <= self.longest:
            return []
        if not (any(word[:k] in self.heads for k in self.head_sizes)
                or any(word[-k:] in self.tails for k in self.tail_sizes)):
            return []
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        end, found = 1 << len(word), []
        full = (end << 1) - 1
        todo = [(0, 1, 2)]
        while todo:
            node, none, one = todo.pop()
            if self.entry[node] is not None and (none | one) & end:
                found.append(self.entry[node])
            for c, child in self.next[node].items():
                fits = at.get(c, 0)
                none2 = (none & fits) << 1
                one2 = ((one & fits) << 1 | none | none << 1 | none2 << 1) & full
                if none2 | one2:
                    todo.append((child, none2, one2))
        return found


@dataclass
class Model:
    """Entries with their weights, fuzzy weights of whole words, and the weights of the score."""

    weight: dict[str, float] = field(default_factory=dict)
    fuzzy: dict[str, float] = field(default_factory=dict)
    coef: tuple[float, ...] = (0.0,) * N_FEATURES

    @functools.cached_property
    def trie(self) -> Trie:
        return Trie(sorted(self.fuzzy))

    @functools.cached_property
    def _known(self) -> dict[str, float]:
        return {}

    def __getstate__(self):
        return {"weight": self.weight, "fuzzy": self.fuzzy, "coef": self.coef}

    def near(self, word: str) -> list[str]:
        """Whole-word entries that the word misspells: one edit away, or with digits for letters."""
        plain = word.translate(LEET) if not word.isalpha() and not word.isdigit() else word
        return [e for e in self.trie.near(plain) if e != word] if self.fuzzy else []

    def match(self, word: str) -> float:
        """What a word counts: 0 for most."""
        found = self._known.get(word)
        if found is None:
            found = max([self.weight.get(word, 0.0),
                         *(self.weight.get(word[:k] + "~", 0.0) for k in STEMS if len(word) >= k)])
            if not found:
                found = max((self.fuzzy[e] for e in self.near(word)), default=0.0)
            if len(self._known) >= KEPT_WORDS:
                self._known.clear()
            self._known[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """What the score is made of: the largest sum of weights in a window, the sum over the
        text, hits, hits per hundred words, the share of quoted ones, and 1."""
        words = tokens(text)
        hits = {w: x for w in set(words) if (x := self.match(w))}
        if not hits:
            return [0.0] * (N_FEATURES - 1) + [1.0]
        place, value, quoted, opened = [], [], 0, False
        announced = -WINDOW
        for i, w in enumerate(words):
            if w in QUOTES:
                opened = not opened
            elif w in REPORTING:
                announced = i
            elif w in hits:
                inside = opened or i - announced <= 3
                quoted += inside
                place.append(i)
                value.append(hits[w] * (QUOTED_SHARE if inside else 1.0))
        p, v = np.array(place), np.concatenate([[0.0], np.cumsum(value)])
        near = (v[np.searchsorted(p, p + WINDOW, "right")] - v[np.searchsorted(p, p - WINDOW)])
        return [min(float(near.max()), 30.0) / 10, math.log1p(float(v[-1])), math.log1p(len(p)),
                min(100 * len(p) / len(words), 20.0) / 10, quoted / len(p), 1.0]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.coef, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def ratio(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Likelihood ratio of a term's document counts in the two classes."""
    def part(k, n, share):
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.where(k > 0, k * np.log(k / (n * share)), 0)
                    + np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - share))), 0))

    share = np.clip((pos + neg) / (n_pos + n_neg), 1e-12, 1 - 1e-12)
    return 2 * (part(pos, n_pos, share) + part(neg, n_neg, share))


def odds(pos, neg, n_pos: float, n_neg: float):
    return np.log((pos + .5) / (n_pos + 1)) - np.log((neg + .5) / (n_neg + 1))


def _counted(sample: DataFrame, which: Column, known: frozenset[str] | None) -> DataFrame:
    """(term, n): documents that hold each term, of ``known`` ones if given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()),
                                              pa.array(list(found.values()), pa.int64())],
                                             names=["term", "n"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                mine = terms(set(tokens(text)))
                found.update(mine if known is None else mine & known)
                if len(found) >= TERMS_AT_ONCE:
                    yield rows()
        if found:
            yield rows()

    return (sample.where(which).select("text").mapInArrow(count, "term string, n bigint")
            .groupBy("term").agg(F.sum("n").alias("n")))


def _lexicon(sample: DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """Entries with their log odds.

    Among the terms that mark toxic texts beyond chance, the strongest is taken, then the one that
    is strongest on texts not yet covered, and so on; so the words of one much-copied text don't
    become entries.
    """
    often = (_counted(sample, F.col("label") == 1, None)
             .where(F.col("n") >= max(LEAST_TEXTS, LEAST_SHARE * n_pos)).collect())
    pos = {r["term"]: r["n"] for r in often}
    if not pos:
        return {}
    neg = {r["term"]: r["n"] for r in
           _counted(sample, F.col("label") == 0, frozenset(pos)).collect()}
    names = sorted(pos)
    p = np.array([pos[t] for t in names], float)
    n = np.array([neg.get(t, 0) for t in names], float)
    good = (ratio(p, n, n_pos, n_neg) >= LEAST_RATIO) & (odds(p, n, n_pos, n_neg) >= LEAST_ODDS)
    order = sorted(np.flatnonzero(good).tolist(), key=lambda i: (-p[i], names[i]))[:4 * ENTRIES]
    names, p, n = [names[i] for i in order], p[order], n[order]
    column = {t: i for i, t in enumerate(names)}

    @F.arrow_udf("array<int>")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(column[t] for t in terms(set(tokens(x))) if t in column)
                         for x in texts.to_pylist()], pa.list_(pa.int32()))

    inside = np.zeros((n_pos, len(names)), bool)
    for i, row in enumerate(sample.where("label = 1").select(held("text").alias("t")).collect()):
        inside[i, row["t"]] = True
    left = np.full(len(inside), COVER)
    lexicon: dict[str, float] = {}
    length = np.array([len(t) for t in names])
    open_ = np.ones(len(names), bool)
    while len(lexicon) < ENTRIES and open_.any() and (left > 0).any():
        gain = inside[left > 0].sum(0) * open_
        gains = ratio(gain.astype(float), n, n_pos, n_neg) * (odds(gain, n, n_pos, n_neg) > LEAST_ODDS)
        best = max(np.flatnonzero(open_).tolist(), key=lambda i: (gains[i], length[i], names[i]))
        if gains[best] < LEAST_RATIO:
            break
        lexicon[names[best]] = float(odds(p[best], n[best], n_pos, n_neg))
        left = left - inside[:, best]
        open_[best] = False
        # Terms that only repeat the one taken, as beginnings of one word do.
        stem = names[best].rstrip("~")
        for i in np.flatnonzero(open_).tolist():
            other = names[i].rstrip("~")
            if other.startswith(stem) or stem.startswith(other):
                open_[i] = False
    return lexicon


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, both classes of equal weight."""
    coef = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    ridge = penalty * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge @ coef
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        coef -= step
        if np.abs(step).max() < 1e-8:
            break
    return coef


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, doc_id: str = "doc_id",
        text: str = "text", label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model learned from about ``per_class`` labelled rows of each class, picked by hash.

    ``may_learn`` is a condition on the id; other rows are not looked at. Where one id has several
    labels the largest counts; NULL ids, labels and texts are left out, repeated texts count once.
    Without rows of both classes the model scores every text 0.5.
    """
    marked = (labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & may_learn)
              .groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label")))
    # Of each class those with hashes below a share that leaves about per_class rows.
    sizes = {r["label"]: r["n"] for r in
             marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = [min(1.0, per_class / max(1, sizes.get(c, 0))) for c in (0, 1)]
    low = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < F.when(
        F.col("label") == 1, F.lit(int(share[1] * (1 << 20)))).otherwise(
        F.lit(int(share[0] * (1 << 20))))
    some = marked.where(F.col("label").isin(0, 1) & low)
    # About 2 * per_class ids, whatever there is, so the documents are not shuffled.
    sample = stored(docs.where(F.col(text).isNotNull())
                    .select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
                    .join(F.broadcast(some), "_id")
                    .groupBy(F.xxhash64("text").alias("_h"), F.length("text").alias("_n"))
                    .agg(F.max("label").alias("label"), F.first("text").alias("text"))
                    .select("label", "text"), "toxicity-sample")
    count = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = count.get(1, 0), count.get(0, 0)
    if not n_pos or not n_neg:
        return Model()
    model = Model(_lexicon(sample, n_pos, n_neg))
    plain = {w.rstrip("~") for w in model.weight}
    model.fuzzy = {w: 1.0 for w in plain if len(w) >= FUZZY_LENGTH}
    model.fuzzy = _fuzzy_weights(sample, model, n_pos, n_neg)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([model.features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    rows = sample.select("label", features("text").alias("x")).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    return Model(model.weight, model.fuzzy, tuple(_regression(x, y).tolist()))


def _fuzzy_weights(sample: DataFrame, model: Model, n_pos: int, n_neg: int) -> dict[str, float]:
    """What entries count when misspelled: a share of their weight, but nothing where words one
    edit away are as common in other texts."""

    @F.arrow_udf("array<string>")
    def nearly(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({e for w in set(tokens(t)) if not model.weight.get(w)
                                 for e in model.near(w)}) for t in texts.to_pylist()],
                        pa.list_(pa.string()))

    counts = {r["entry"]: r for r in (
        sample.select("label", F.explode(nearly("text")).alias("entry")).groupBy("entry")
        .agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).collect())}
    out = {}
    for entry in model.fuzzy:
        full = max(model.weight.get(entry, 0.0), model.weight.get(entry + "~", 0.0))
        seen = counts.get(entry)
        neg = seen["neg"] if seen else 0
        learned = float(odds(seen["pos"], neg, n_pos, n_neg)) if seen else full
        weight = FUZZY_SHARE * min(full, learned if neg else full)
        if weight >= FUZZY_SHARE * LEAST_ODDS:
            out[entry] = weight
    return out


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability that the whole text is toxic.

    Only the text decides. NULL and empty texts score as texts without a hit. A column called
    ``out`` is replaced, all others stay.
    """

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(out, scored(whole(text)))
