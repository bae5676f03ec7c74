"""LM scoring: word counts of the whole corpus, a recurrent model trained on it, whole texts scored.

Counts of all training words are an aggregate. The recurrent model is trained in every partition on
whole texts, window by window with the state carried on, and averaged; every text belongs to one of
several rounds, so that what one partition has learned reaches the others. Scoring carries the
state of a text from window to window in the same way, many texts side by side. Counts of frequent words travel with the model, a
table of fixed size; those of rare words are joined.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm import gru
from recordflow.llm.common import stored, whole

#: Frequent symbols of the softmax, the end of a text among them, and spelling classes.
HEADS, TAILS = 2400, 96
#: Size of the state.
HIDDEN = 24
#: Words whose counts travel with the model, and the longest of them in bytes.
KNOWN, LONGEST = 200_000, 48
#: Words counted in a worker before they are handed on.
WORDS_AT_ONCE = 400_000
#: Training: tokens of a window, which back-propagation goes through, texts side by side, and the
#: learning rate of each round; a text is learned from in one of the rounds, as its hash says.
TRUNCATED, SIDE_BY_SIDE, RATES = 32, 128, (0.12, 0.08, 0.05)
#: Scoring: tokens gone through together, texts side by side, steps whose outputs are made at once.
TOKENS_AT_ONCE, LANES, WINDOW = 1_500_000, 256, 48
#: Numbers of a model that travel in one row while models are averaged, and models per first group.
PIECE, GROUP = 1 << 14, 64
LOG10 = math.log(10)


def words(text: str) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    """The spelling class of a word, by its last two bytes."""
    return zlib.crc32(word[-2:]) % TAILS


@dataclass
class Vocabulary:
    """Counts over all training tokens: N, V, ends, and the most frequent words with theirs."""

    total: int
    distinct: int
    ends: int
    words: list[bytes]
    counts: np.ndarray
    tail_total: np.ndarray
    tail_distinct: np.ndarray

    def __post_init__(self):
        # Symbol 0 is the end; the frequent words follow.
        heads = min(HEADS, len(self.words) + 1)
        self.sizes = gru.Sizes(heads, TAILS, HIDDEN)
        self.count = np.concatenate([[self.ends], self.counts]).astype(np.int64)
        self.log_count = np.log10(self.count + 0.5)
        tails = np.fromiter(map(tail_class, self.words[heads - 1:]), np.int64,
                            len(self.words) - heads + 1)
        self.symbol = np.concatenate([np.arange(heads), heads + tails]).astype(np.int32)
        mass = np.concatenate([self.count[:heads], self.tail_total])
        # What is left of a class for words never seen keeps its mass above nothing.
        self.symbol_counts = mass.astype(np.float64)
        self.class_size = np.log10(self.tail_total + 0.5 * (self.tail_distinct + 1))
        self.code: dict[bytes, int] | None = None

    def __getstate__(self):
        return {k: getattr(self, k) for k in self.__dataclass_fields__}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    @property
    def base_size(self) -> float:
        return math.log10(self.total + 0.5 * (self.distinct + 1))

    def encode(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places in the table of counts (-1: not there), symbols, and the words not there."""
        if self.code is None:
            self.code = {w: i + 1 for i, w in enumerate(self.words)}
        place = np.fromiter(map(self.code.get, ws, (-1,) * len(ws)), np.int64, len(ws) + 0)
        symbol = self.symbol[place]
        rare = np.flatnonzero(place < 0).tolist()
        out = [ws[i] for i in rare]
        symbol[rare] = [self.sizes.heads + tail_class(w) for w in out]
        return place, symbol, out


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, tail, n) of all texts: words, their spelling classes, their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(found)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k.decode("utf-8", "replace") for k in keys], pa.string()),
                 pa.array([tail_class(k) for k in keys], pa.int32()),
                 pa.array(list(found.values()), pa.int64())], names=["word", "tail", "n"])
            found.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(words(t))
                if len(found) >= WORDS_AT_ONCE:
                    yield rows()
        if found:
            yield rows()

    return (docs.select(whole(text)).mapInArrow(count, "word string, tail int, n bigint")
            .groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n")))


def _most_frequent(counts: DataFrame) -> DataFrame:
    """The words of the highest counts, ``KNOWN`` at most: those above a count found from the number
    of words per step of a logarithmic scale, a few hundred steps at most."""
    some = counts.where(F.octet_length("word") <= LONGEST).withColumn(
        "step", F.floor(16 * F.log2("n")).cast("int"))
    least, room = None, KNOWN
    for r in sorted(some.groupBy("step").agg(F.count("*").alias("v")).collect(), reverse=True):
        if r["v"] > room:
            break
        least, room = r["step"], room - r["v"]
    return some.where(F.lit(False) if least is None else F.col("step") >= least).select("word", "n")


def learn_vocabulary(train: DataFrame, text: str = "text") -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the training texts, and the table (word, tail, n) of all their words."""
    counts = stored(count_words(train, text), "lm-counts")
    ends = train.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = sorted(_most_frequent(counts).collect(), key=lambda r: (-r["n"], r["word"]))
    known = [r["word"].encode() for r in top]
    frequent = np.array([r["n"] for r in top], np.int64)
    by_tail = {r["tail"]: r for r in counts.groupBy("tail").agg(
        F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tail_total = np.array([by_tail[i]["n"] if i in by_tail else 0 for i in range(TAILS)], np.int64)
    tail_distinct = np.array([by_tail[i]["v"] if i in by_tail else 0 for i in range(TAILS)], np.int64)
    for w, n in zip(known[:HEADS - 1], frequent.tolist()):  # frequent words are symbols of their own
        tail_total[tail_class(w)] -= n
        tail_distinct[tail_class(w)] -= 1
    return Vocabulary(total + ends, distinct + (ends > 0), ends, known, frequent, tail_total,
                      tail_distinct), counts


# -------------------------------------------------------------------- training


def windows(texts: Iterator[np.ndarray], lanes: int, steps: int) -> Iterator[tuple]:
    """(inputs, target, live, keep, on) of consecutive windows over the symbols of whole texts.

    Every lane goes through one text after the other, each with its end, and takes the next text
    where one ends. Arrays are (steps, lanes in use); ``on`` are the numbers of those lanes. An
    input is the symbol before the target; ``keep`` is 0 where a text begins.
    """
    texts = iter(texts)
    rest = [np.zeros(0, np.int64)] * lanes
    before = np.zeros(lanes, np.int64)
    while True:
        target = np.zeros((lanes, steps), np.int64)
        live = np.zeros((lanes, steps), bool)
        keep = np.ones((lanes, steps), bool)
        for i in range(lanes):
            part, got = rest[i], 0
            while got < steps:
                if not len(part):
                    symbols = next(texts, None)
                    if symbols is None:
                        break
                    part = np.append(symbols, 0)
                    keep[i, got] = False
                n = min(len(part), steps - got)
                target[i, got:got + n] = part[:n]
                live[i, got:got + n] = True
                part, got = part[n:], got + n
            rest[i] = part
        on = np.flatnonzero(live[:, 0])
        if not len(on):
            return
        inputs = np.concatenate([before[:, None], target[:, :-1]], axis=1)
        inputs *= keep  # the symbol before a text is an end
        before = target[:, -1].copy()
        yield inputs[on].T, target[on].T, live[on].T, keep[on].T, on


def train_round(train: DataFrame, vocabulary: Vocabulary, vector: np.ndarray, rate: float,
                text: str = "text", replicas: int | None = None) -> np.ndarray:
    """One round: every partition goes on from ``vector`` over its whole texts; the results are
    averaged by their tokens. Partitions are joined to ``replicas`` of them, as many as the cluster
    has cores by default, so that models are few and each sees much text."""
    sizes = vocabulary.sizes
    replicas = replicas or train.sparkSession.sparkContext.defaultParallelism

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = gru.shaped(vector, sizes)
        adagrad, seen = gru.Adagrad(weights, rate), 0
        h = np.zeros((SIDE_BY_SIDE, sizes.hidden), gru.FLOAT)

        def symbols() -> Iterator[np.ndarray]:
            for batch in batches:
                for t in batch.column(0):
                    yield vocabulary.encode(words(t.as_py()))[1]

        for inputs, target, live, keep, on in windows(symbols(), SIDE_BY_SIDE, TRUNCATED):
            g, h[on], _ = gru.gradients(weights, inputs, target, live, h[on], sizes, keep)
            adagrad.step(g)
            seen += int(live.sum())
        if seen:
            out, part = gru.flat(weights), TaskContext.get().partitionId()
            n = -(-len(out) // PIECE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part % GROUP), pa.int32()), pa.array(np.arange(n), pa.int32()),
                 pa.array(np.full(n, float(seen)), pa.float64()),
                 pa.array([out[i * PIECE:(i + 1) * PIECE].tobytes() for i in range(n)], pa.binary())],
                names=["part", "piece", "seen", "mean"])

    shape = "part int, piece int, seen double, mean binary"

    def add(table: pa.Table) -> pa.Table:
        weight = table["seen"].to_pylist()
        seen = sum(weight)
        total = sum(np.frombuffer(b, np.float32) * (w / seen)
                    for b, w in zip(table["mean"].to_pylist(), weight))
        return pa.table({"part": pa.array([0], pa.int32()),
                         "piece": table["piece"].slice(0, 1).combine_chunks(),
                         "seen": pa.array([seen], pa.float64()),
                         "mean": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    summed = (train.select(whole(text)).coalesce(replicas).mapInArrow(learn, shape)
              .groupBy("part", "piece").applyInArrow(add, shape)
              .groupBy("piece").applyInArrow(add, shape).orderBy("piece").collect())
    if not summed:
        return vector
    return np.concatenate([np.frombuffer(r["mean"], np.float32) for r in summed])


@dataclass
class Model:
    vocabulary: Vocabulary
    vector: np.ndarray


def fit(train: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """A model of the texts, and the counts (word, tail, n) it goes with.

    All texts are counted, and each is learned from as a whole, once. NULL texts are empty ones: an
    end. Without any rows every symbol is unseen. How the rows lie in partitions has a small
    influence on the model, as partitions are trained side by side.
    """
    vocabulary, counts = learn_vocabulary(train, text)
    vector = gru.flat(gru.start(vocabulary.sizes, vocabulary.symbol_counts)).astype(np.float64)
    turn = F.pmod(F.xxhash64(whole(text)), F.lit(len(RATES)))
    for number, rate in enumerate(RATES):
        vector = train_round(train.where(turn == number), vocabulary, vector.astype(np.float32),
                             rate, text)
    return Model(vocabulary, vector.astype(np.float32)), counts


# --------------------------------------------------------------------- scoring


def sequence_logs(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the symbols of each text and of its end.

    Texts are dealt out to lanes, longest first, each to the lane with least to do; lanes are gone
    through side by side. The state goes on from window to window and begins anew with a text.
    """
    sizes, w = model.vocabulary.sizes, gru.shaped(model.vector, model.vocabulary.sizes)
    lanes = min(LANES, len(texts))
    load = [(0, i) for i in range(lanes)]
    mine: list[list[int]] = [[] for _ in range(lanes)]
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        n, lane = heapq.heappop(load)
        mine[lane].append(k)
        heapq.heappush(load, (n + len(texts[k]) + 1, lane))
    length = [sum(len(texts[k]) + 1 for k in m) for m in mine]
    order = sorted(range(lanes), key=lambda i: -length[i])
    mine, length = [mine[i] for i in order], np.array([length[i] for i in order])
    target = [np.concatenate([np.append(texts[k], 0) for k in m]) for m in mine]
    owner = [np.repeat(m, [len(texts[k]) + 1 for k in m]) for m in mine]
    out = np.zeros(len(texts))
    h = np.zeros((lanes, sizes.hidden), gru.FLOAT)
    before = np.zeros(lanes, np.int64)
    for s in range(0, int(length[0]), WINDOW):
        on = int((length > s).sum())  # lanes that still have something: the first ones
        steps = min(WINDOW, int(length[0]) - s)
        t = np.zeros((steps, on), np.int64)
        who = np.full((steps, on), -1, np.int64)
        for i in range(on):
            part = target[i][s:s + steps]
            t[:len(part), i], who[:len(part), i] = part, owner[i][s:s + steps]
        inputs = np.concatenate([before[None, :on], t[:-1]])
        keep = (inputs != 0).astype(gru.FLOAT)  # an end before: a text begins
        hs = gru.states(w, inputs, keep, h[:on], None)
        h, before = hs[-1], t[-1]
        live = who.ravel() >= 0
        lp = gru.log_probs(w, hs.reshape(-1, sizes.hidden)[live], t.ravel()[live], sizes)
        out += np.bincount(who.ravel()[live], weights=lp, minlength=len(texts))
    return out / LOG10


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row.

    base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, the end of the text among
    them; score is the model's log10 probability of the whole text. A word outside the model's
    frequent ones has the probability of its spelling class times its smoothed share of it, a word
    never seen that of a word with count zero. NULL and empty texts are an end alone. Equal texts
    have equal scores; repeated rows and NULL ids stay.
    """
    vocabulary = model.vocabulary
    heads, base_size = vocabulary.sizes.heads, vocabulary.base_size

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, symbols, rows = [], [], [], []

        def out() -> pa.RecordBatch:
            model_score = sequence_logs(model, symbols)
            columns = list(zip(*rows))
            made = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.string()),
                 pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.float64()),
                 pa.array(model_score + np.array(columns[3]), pa.float64()),
                 pa.array(columns[4], pa.list_(pa.string()))],
                names=["doc_id", "key", "n_tokens", "n_known", "base", "model", "rare"])
            for x in (ids, keys, symbols, rows):
                x.clear()
            return made

        waiting = 0
        for batch in batches:
            for i, k, t in zip(*(c.to_pylist() for c in batch.columns)):
                ws = words(t)
                place, symbol, rare = vocabulary.encode(ws)
                known = place >= 0
                tail = symbol[symbol >= heads] - heads
                logs = vocabulary.log_count[place]
                shares = logs[known & (symbol >= heads)].sum() - vocabulary.class_size[tail].sum()
                end = vocabulary.log_count[0]
                ids.append(i)
                keys.append(k)
                symbols.append(symbol)
                rows.append((len(ws) + 1, int(known.sum()) + (vocabulary.ends > 0),
                             float(logs[known].sum() + end - (len(ws) + 1) * base_size),
                             float(shares), [w.decode("utf-8", "replace") for w in rare]))
                waiting += len(ws) + 1
                if waiting >= TOKENS_AT_ONCE:
                    yield out()
                    waiting = 0
        if ids:
            yield out()

    found = stored(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                               F.md5(whole(text)).alias("key"), whole(text).alias("text"))
                   .mapInArrow(judged, "doc_id bigint, key string, n_tokens bigint, n_known bigint, "
                                       "base double, model double, rare array<string>"), "lm-scores")
    rare = (found.where(F.size("rare") > 0).groupBy("key").agg(F.first("rare").alias("rare"))
            .select("key", F.explode("rare").alias("word")))
    n = F.coalesce(F.col("n"), F.lit(0))
    logs = (rare.join(counts.select("word", "n"), "word", "left").groupBy("key")
            .agg(F.sum(F.log10(n + 0.5)).alias("logs"), F.sum((n > 0).cast("bigint")).alias("seen")))
    extra, seen = F.coalesce("logs", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return (found.drop("rare").join(logs, "key", "left")
            .select("doc_id", "n_tokens", (F.col("n_known") + seen).alias("n_known"),
                    (F.col("base") + extra).alias("base_score"),
                    (F.col("model") + extra).alias("score")))


def held_out(remainder: Column) -> Column:
    """Whether a row is kept out of training: its remainder is 1."""
    return F.coalesce(remainder == 1, F.lit(False))
