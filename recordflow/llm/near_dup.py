"""Near-duplicates: SimHash found by Golay-code fuzzy hashing, and sets of shingles by Jaccard
similarity.

A SimHash fingerprint is cut into segments of at most 23 bits. Each segment is decoded to the
codewords of the Golay code nearby, whose indices two segments share whenever they differ in two
bits at most. Keys made of several segments meet in one sorted pass, and fingerprints that share a
key are compared. Sets of shingles have a SimHash too, which ties the closest ones in the same way;
min-hash keys find the rest. Both only choose the candidates: the sets themselves are compared.
Links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm import golay
from recordflow.llm.common import stored, unused, whole
from recordflow.llm.graph import components

# Fixed value: the seed of the shingle hashes.
SEED = 42
#: Rows of one key that are compared with each other at once; the rest of larger groups is
#: compared in a join.
CROWD = 4
#: Shingles whose bits are counted at a time.
SHINGLES_AT_ONCE = 1 << 14
#: Members of a set whose values under all hash functions are made at a time.
ITEMS_AT_ONCE = 1 << 10
#: Leaders of a crowded key in one round.
LEADERS = 8
#: Fingerprints whose keys are made at a time.
FINGERPRINTS_AT_ONCE = 1000
#: The filters of crowded keys and of wanted sets have 2 to this power bits.
FILTER_BITS = 24


@dataclass(frozen=True)
class Scheme:
    """How fingerprints are made and compared.

    ``segments`` are (first bit, bits); a table of ``tables`` is (exact segments, segments taken by
    their Golay indices), and each gives a fingerprint one key per combination of indices.
    Fingerprints of one word link at ``radius`` or fewer differing bits.
    """

    words: int
    shingle: int
    segments: tuple[tuple[int, int], ...]
    tables: tuple[tuple[tuple[int, ...], tuple[int, ...]], ...]
    radius: int

    @property
    def rounds(self) -> tuple[int, int]:
        """Tables gone through first, and all."""
        return 1, len(self.tables)

    @property
    def sig(self) -> int:
        """The word that tells which rows of one key may link."""
        return 0

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x ^ y).view(np.uint64)) <= self.radius


#: 64 bits, up to two differing. Of three segments one has no error then, and the next one at most
#: two: the first is taken as it is and the next one by its indices, so no pair is missed.
EXACT = Scheme(1, 3, ((0, 22), (22, 21), (43, 21)),
               tuple(((i,), ((i + 1) % 3,)) for i in range(3)), 2)


@dataclass(frozen=True)
class Sets:
    """Sets of distinct shingles, which link at a Jaccard similarity of ``least`` or more.

    A fingerprint is a digest of the whole set, its size, and ``bands`` keys made of the smallest
    values of ``rows`` hash functions each, -1 for keys of an empty set; behind these words comes
    the set's SimHash. Sets tied by SimHash or sharing a key are candidates, and the sets decide.
    SimHash comes first, then the keys of ``first`` bands, then all.
    """

    least: Fraction
    shingle: int
    bands: int
    rows: int
    first: int = 4

    @property
    def words(self) -> int:
        return 2 + self.bands

    @property
    def rounds(self) -> tuple[int, int]:
        return min(self.first, self.bands), self.bands

    @property
    def sig(self) -> int:
        return 1

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sizes that a pair of ``least`` similarity can have."""
        return (np.minimum(x, y) * self.least.denominator
                >= np.maximum(x, y) * self.least.numerator)

    def alike(self, a: str, b: str) -> Column:
        """Whether two sets, given as arrays, link; in whole numbers."""
        p, q = self.least.numerator, self.least.denominator
        m, n = F.size(a).cast("bigint"), F.size(b).cast("bigint")
        common = F.size(F.array_intersect(a, b)).cast("bigint")
        return F.when(F.least(m, n) * q >= F.greatest(m, n) * p,
                      common * (p + q) >= (m + n) * p).otherwise(False)


def similar(similarity: float = 0.8, shingle: int = 5, bands: int = 24, rows: int = 5) -> Sets:
    """A scheme for sets of shingles of at least this Jaccard similarity.

    Two sets of similarity J share a key with probability 1 - (1 - J ** rows) ** bands: at J = 0.8
    all but 7 in 100,000 pairs do. Whatever shares one is compared exactly.
    """
    return Sets(Fraction(str(similarity)), shingle, bands, rows)


# ---------------------------------------------------------------- fingerprints


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from a hash."""
    z = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included: ``size`` words joined by one space, A-Z in lower
    case; of the whole sequence where there are fewer words; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(size, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED)
                     for a, b in zip(starts.tolist(), ends[last:].tolist())], np.uint64)


def simhash(h: np.ndarray) -> int:
    """64 bits, signed: a bit is set where over half of the hashes have it; 0 without any."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), SHINGLES_AT_ONCE):
        part = h[i:i + SHINGLES_AT_ONCE]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, scheme: Scheme = EXACT) -> list[int]:
    """The SimHash of a text's shingles, repeats included."""
    return [simhash(shingle_hashes(text, scheme.shingle))]


def _digest(items: np.ndarray) -> int:
    """64 bits, signed, of a sorted set of shingle hashes: which node a text belongs to."""
    return int(np.uint64(xxhash.xxh64_intdigest(items.tobytes(), SEED)).view(np.int64))


def set_fingerprint(items: np.ndarray, scheme: Sets) -> np.ndarray:
    """Digest, size, keys and SimHash of a sorted set of shingle hashes."""
    out = np.full(scheme.words + 1, -1, np.int64)
    out[0], out[1], out[-1] = _digest(items), len(items), simhash(items)
    if len(items):
        count = scheme.bands * scheme.rows
        turn = _mixed(np.arange(count, dtype=np.uint64), 1)[:, None]
        odd = _mixed(np.arange(count, dtype=np.uint64), 2)[:, None] | np.uint64(1)
        least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(items), ITEMS_AT_ONCE):
            least = np.minimum(least, ((items[i:i + ITEMS_AT_ONCE] ^ turn) * odd).min(1))
        key = np.arange(scheme.bands, dtype=np.uint64)
        for row in least.reshape(scheme.bands, scheme.rows).T:
            key = _mixed(key ^ row, 3)
        out[2:-1] = (key >> np.uint64(1)).astype(np.int64)
    return out


def fingerprints(docs: DataFrame, scheme: Scheme | Sets = EXACT, text: str = "text",
                 out: str = "fp") -> DataFrame:
    """``docs`` with ``out``, the words of each whole text's fingerprint (array of bigint). NULL
    and empty texts have no shingles."""

    def of(t: str):
        if isinstance(scheme, Sets):
            return set_fingerprint(np.unique(shingle_hashes(t, scheme.shingle)), scheme)
        return fingerprint(t, scheme)

    @F.arrow_udf("array<bigint>")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array([of(t) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return docs.withColumn(out, fp(whole(text)))


def sets_of(docs: DataFrame, scheme: Sets, text: str, nodes: DataFrame) -> DataFrame:
    """(node, items) of the sets in ``nodes``, and of a few others, read off the texts again: so
    only sets that have candidates are ever written."""
    noted = _noted(nodes, "node")

    @F.arrow_udf("struct<node: bigint, items: array<bigint>>")
    def made(texts: pa.Array) -> pa.Array:
        node, ends, flat, wanted = [], [0], [np.zeros(0, np.int64)], []
        for t in texts.to_pylist():
            items = np.unique(shingle_hashes(t, scheme.shingle))
            node.append(_digest(items))
            p = _place(node[-1])
            wanted.append(bool(noted[p >> 6] >> (p & 63) & 1))
            if wanted[-1]:
                flat.append(items.view(np.int64))
            ends.append(ends[-1] + (len(items) if wanted[-1] else 0))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                         pa.array(np.concatenate(flat), pa.int64()))
        return pa.StructArray.from_arrays([pa.array(node, pa.int64()), lists],
                                          names=["node", "items"],
                                          mask=pa.array([not w for w in wanted], pa.bool_()))

    return stored(docs.select(made(whole(text)).alias("s")).where("s is not null")
                  .select("s.node", "s.items").dropDuplicates(["node"]), "near-sets")


# ------------------------------------------------------------------------ keys


def _segment(words: np.ndarray, start: int, size: int) -> np.ndarray:
    w, shift = divmod(start, 64)
    value = words[:, w].view(np.uint64) >> np.uint64(shift)
    if shift + size > 64:
        value = value | words[:, w + 1].view(np.uint64) << np.uint64(64 - shift)
    return (value & np.uint64((1 << size) - 1)).astype(np.int64)


def key_matrix(words: np.ndarray, scheme: Scheme | Sets, tables: int | None = None) -> np.ndarray:
    """The keys of each fingerprint, of the first ``tables`` tables or of all; -1 where it has
    fewer. A key of a ``Scheme`` holds the table's number and the segments' values or indices side
    by side, so no two different ones are equal."""
    if isinstance(scheme, Sets):
        return words[:, 2:][:, :tables]
    value = [_segment(words, *s) for s in scheme.segments]
    index = [golay.keys(v) for v in value]
    out = []
    for number, (plain, fuzzy) in enumerate(scheme.tables[:tables]):
        made = np.full((len(words), 1), number, np.int64)
        for s in plain:
            made = made << scheme.segments[s][1] | value[s][:, None]
        for s in fuzzy:
            wide = made[:, :, None] << golay.MESSAGE | index[s][:, None, :]
            made = np.where((made[:, :, None] < 0) | (index[s][:, None, :] < 0), -1, wide)
            made = made.reshape(len(words), -1)
        out.append(made)
    return np.concatenate(out, axis=1)


def _arrays(column: pa.Array, scheme: Scheme | Sets, tables: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Where each fingerprint's keys end, and all keys one after the other."""
    words = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), scheme.words)
    sizes, flat = [], [np.zeros(0, np.int64)]
    for i in range(0, len(words), FINGERPRINTS_AT_ONCE):
        made = key_matrix(np.ascontiguousarray(words[i:i + FINGERPRINTS_AT_ONCE]), scheme, tables)
        sizes.append((made >= 0).sum(1))
        flat.append(made[made >= 0])
    return np.cumsum(np.concatenate([[0], *sizes])), np.concatenate(flat)


def _keyed(nodes: DataFrame, scheme: Scheme | Sets, tables: int) -> DataFrame:
    """(key, node, sig, root): one row per key of a fingerprint; sig is its telling word."""

    @F.arrow_udf("array<bigint>")
    def keys(column: pa.Array) -> pa.Array:
        ends, flat = _arrays(column, scheme, tables)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))

    return nodes.select(F.explode(keys("fp")).alias("key"), "node", F.get("fp", scheme.sig).alias("sig"),
                        "root")


def _place(key):
    """Where a value is noted in a filter; of numpy arrays and whole numbers."""
    return (key ^ (key >> 17)) & ((1 << FILTER_BITS) - 1)


def _noted(values: DataFrame, name: str) -> np.ndarray:
    """A filter of fixed size, 2 MB, of the values in one column."""
    place = F.col(name).bitwiseXOR(F.shiftright(name, 17)).bitwiseAND((1 << FILTER_BITS) - 1)
    bits = (values.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).collect())
    noted = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in bits:
        noted[r["at"]] = r["bits"]
    return noted


def _crowded_rows(nodes: DataFrame, scheme: Scheme | Sets, crowded: DataFrame) -> DataFrame:
    """(key, node, root, fp) of the keys in ``crowded``, and of a few others.

    The keys go through a filter of fixed size, 2 MB, so the rows of all keys are not shuffled once
    more to find the few wanted ones.
    """
    noted = _noted(crowded, "key")

    @F.arrow_udf("array<struct<key: bigint, wanted: boolean>>")
    def keys(column: pa.Array) -> pa.Array:
        ends, flat = _arrays(column, scheme, None)
        p = _place(flat)
        wanted = (noted[p >> 6] >> (p & 63) & 1).astype(bool)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(flat, pa.int64()), pa.array(wanted)], names=["key", "wanted"]))

    return (nodes.select(F.explode(keys("fp")).alias("k"), "node", "root", "fp")
            .where("k.wanted").select("k.key", "node", "root", "fp"))


# ----------------------------------------------------------------------- links


def _differing(a: str, b: str, scheme: Scheme) -> Column:
    """Bits in which two fingerprints differ."""
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(scheme.words)),
               F.lit(0))


def _matched(batches: Iterator[pa.RecordBatch], scheme: Scheme | Sets,
             crowd: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, key) from rows (key, node, sig, root) sorted by key, then node.

    Only rows of different roots are compared. Groups of up to ``crowd`` rows: all links (a, b) in
    them. Larger ones: the links to their first row, and a row with the key alone, so that a join
    compares the rest; so for the first and last key of a partition, as their groups may go on in
    the next one. At most ``crowd`` rows and one first row are kept from batch to batch.
    """
    rows = np.zeros((4, 0), np.int64)
    lead: np.ndarray | None = None  # the group under way is large: its first row
    started = False

    def packed(a, b, crowded) -> pa.RecordBatch:
        void = pa.nulls(len(crowded), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(a, pa.int64()), void]),
             pa.concat_arrays([pa.array(b, pa.int64()), void]),
             pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(crowded, pa.int64())])],
            names=["a", "b", "key"])

    def near(x, y):
        """Of two sets of rows side by side."""
        return (x[3] != y[3]) & scheme.near(x[2], y[2])

    def to_lead(group: np.ndarray) -> pa.RecordBatch:
        hit = near(group, lead[:, None])
        return packed(group[1][hit], np.full(hit.sum(), lead[1]), [])

    def settled(done: np.ndarray) -> pa.RecordBatch:
        """Links in whole groups."""
        key, n = done[0], done.shape[1]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, n))
        sizes = np.repeat(size, size)
        a, b = [], []
        at = np.flatnonzero((sizes > 1) & (sizes <= crowd))
        for lag in range(1, crowd):
            at = at[at + lag < n]
            at = at[key[at] == key[at + lag]]
            hit = at[near(done[:, at], done[:, at + lag])]
            a.append(done[1][hit])
            b.append(done[1][hit + lag])
        crowded = []
        large = size > crowd
        for f, c in zip(first[large].tolist(), size[large].tolist()):
            group = done[:, f:f + c]
            if (group[3] != group[3][0]).any():
                hit = near(group, group[:, :1])
                a.append(group[1][hit])
                b.append(np.full(hit.sum(), group[1][0]))
                crowded.append(int(group[0][0]))
        none = np.zeros(0, np.int64)
        return packed(np.concatenate([none, *a]), np.concatenate([none, *b]), crowded)

    for batch in batches:
        fresh = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows = np.concatenate([rows, fresh], axis=1)
        if not rows.shape[1]:
            continue
        if not started:
            started = True
            yield packed([], [], [int(rows[0][0])])
        if lead is not None:
            n = int(np.searchsorted(rows[0], lead[0], "right"))
            yield to_lead(rows[:, :n])
            rows = rows[:, n:]
            if not rows.shape[1]:
                continue
            lead = None
        n = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        if n:
            yield settled(rows[:, :n])
        rows = rows[:, n:].copy()
        if rows.shape[1] > crowd:
            lead = rows[:, 0]
            yield packed([], [], [int(lead[0])])
            yield to_lead(rows)
            rows = rows[:, :0]
    if rows.shape[1]:
        yield packed([], [], [int(rows[0][0])])
        yield settled(rows)


def _verified(links: DataFrame, scheme: Scheme | Sets, sets) -> DataFrame:
    """Distinct links, of ``Sets`` those whose whole sets are similar."""
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if isinstance(scheme, Scheme):
        return links
    links = stored(links, "near-candidates")
    items = sets(links.select(F.explode(F.array("a", "b")).alias("node")))
    both = (links.join(items.toDF("a", "_sa"), "a").join(items.toDF("b", "_sb"), "b"))
    return both.where(scheme.alike("_sa", "_sb")).select("a", "b")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _star(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _mixed_keys(rest: DataFrame) -> DataFrame:
    """Rows of the keys that hold several roots."""
    mixed = (rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo != hi").select("key"))
    return stored(rest.select("key", "node", "root").join(mixed, "key", "left_semi"), "near-mixed")


def _loose(rest: DataFrame) -> int:
    """Rows outside of the largest class of their key."""
    sizes = (rest.groupBy("key", "root").agg(F.count("*").alias("n"))
             .groupBy("key").agg((F.sum("n") - F.max("n")).alias("loose")))
    return sizes.agg(F.coalesce(F.sum("loose"), F.lit(0))).first()[0]


def _led(rest: DataFrame, scheme: Sets, items: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rest, links) after rounds of leaders.

    In every round each key has a few leaders, drawn by hash from its rows, and every row is compared
    with one of them, picked by another hash, if it is of another class: one comparison and link a
    row, and a hot key is spread over its leaders. Classes that a link joins go
    on under the smallest of their names, so dense groups are tied in a few rounds. When a round
    leaves most of the rows outside of their key's largest class where they were, those are hardly
    alike, and comparing them pair by pair lists few links.
    """
    turn, every, loose = 0, None, _loose(rest)
    while loose:
        turn += 1
        draw = F.xxhash64("node", F.lit(turn))
        leaders = (rest.groupBy("key", F.pmod(draw, F.lit(LEADERS)).alias("slot"))
                   .agg(F.min_by(F.struct("node", "root"), draw).alias("_l"))
                   .select("key", "slot", F.col("_l.node").alias("lead"),
                           F.col("_l.root").alias("lead_root")))
        slot = F.pmod(F.xxhash64("node", F.lit(-turn)), F.lit(LEADERS))
        pairs = (rest.withColumn("slot", slot).join(leaders, ["key", "slot"])
                 .where("root != lead_root")
                 .select(F.col("node").alias("a"), "root", F.col("lead").alias("b"), "lead_root")
                 .distinct())
        links = stored(pairs.join(items.toDF("a", "_sa"), "a").join(items.toDF("b", "_sb"), "b")
                       .where(scheme.alike("_sa", "_sb")).select("a", "b", "root", "lead_root"),
                       "near-led")
        every = links.select("a", "b") if every is None else every.unionAll(links.select("a", "b"))
        name = (links.select(F.greatest("root", "lead_root").alias("root"),
                             F.least("root", "lead_root").alias("to"))
                .groupBy("root").agg(F.min("to").alias("to")))
        rest = _mixed_keys(rest.join(name, "root", "left").select(
            "key", "node", F.coalesce("to", "root").alias("root")))
        was, loose = loose, _loose(rest)
        if 10 * loose > 9 * was:
            break
    return rest, every


def _by_simhash(nodes: DataFrame, scheme: Sets, sets) -> DataFrame:
    """(node, root) of sets that SimHash ties and that are similar themselves.

    Sets of one SimHash are one node there, under the smallest of them. What a class holds is
    compared with its root: members that are only similar to each other are left to the keys.
    """
    heads = stored(nodes.groupBy("sim").agg(F.min("node").alias("head")), "near-simhashes")
    tied = classes(heads.select(F.col("head").alias("node"), F.array("sim").alias("fp")))
    links = (nodes.select("node", "sim").join(heads, "sim").join(tied.withColumnRenamed("node", "head"), "head", "left")
             .select(F.col("node").alias("a"), F.coalesce("root", "head").alias("b")).where("a != b"))
    return stored(components(_verified(links, scheme, sets)), "near-classes")


def classes(nodes: DataFrame, scheme: Scheme | Sets = EXACT, sets=None) -> DataFrame:
    """(node, root) of nodes (node, fp) that link to others, root being the smallest of its class.
    For ``Sets``, ``sets`` gives (node, items) of a table of nodes, and these may have their SimHash
    in ``sim``.

    Nodes must be distinct, and so must be their fingerprints. The keys are dealt out by ranges of
    (key, node), so one much-used key is spread over several tasks. The keys of the first tables
    alone tie most of what belongs together, of ``Sets`` after SimHash has; then those of all tables
    are gone through, and only rows not yet tied are compared. In groups too large for comparing all their rows at once, a
    join compares what is still not tied. So no link that matters is missed, and a dense group
    isn't listed pair by pair.
    """
    crowd = CROWD
    roots = (_by_simhash(nodes, scheme, sets) if "sim" in nodes.columns
             else nodes.select("node", F.col("node").alias("root")).limit(0))
    for tables in scheme.rounds:
        rows = _keyed(_rooted(nodes, roots), scheme, tables)
        found = stored(rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
                       .mapInArrow(lambda batches: _matched(batches, scheme, crowd),
                                   "a bigint, b bigint, key bigint"), "near-links")
        links = _verified(found.where("key is null"), scheme, sets)
        roots = stored(components(_star(roots).unionAll(links)), "near-classes")

    led = None
    crowded = found.where("key is not null").select("key")
    rest = stored(_crowded_rows(_rooted(nodes, roots), scheme, crowded), "near-crowded")
    if isinstance(scheme, Sets):
        rest = _mixed_keys(rest.drop("fp"))
        items = sets(rest.select("node"))
        rest, led = _led(rest, scheme, items)
        # Two sets are compared under the smallest key they share: each knows all of its keys here.
        keys = rest.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        rest = rest.join(keys, "node").join(items, "node").select(
            "key", "node", "root", F.struct("keys", "items").alias("fp"))
        common = F.array_min(F.array_intersect("_fa.keys", "_fb.keys"))
        close = (common == F.col("key")) & scheme.alike("_fa.items", "_fb.items")
    else:
        close = _differing("_fa", "_fb", scheme) <= scheme.radius
    # The whole fingerprints or sets are compared in the join: what comes out are links.
    more = (rest.toDF("key", "a", "_ra", "_fa").join(rest.toDF("key", "b", "_rb", "_fb"), "key")
            .where((F.col("_ra") < F.col("_rb")) & close)
            .select("a", "b").distinct())
    if led is not None:
        more = more.unionAll(led)
    return components(_star(roots).unionAll(more))


def label(docs: DataFrame, scheme: Scheme | Sets = EXACT, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest id among the rows whose fingerprints can be reached by links, the
    row itself included; NULL where all of them have NULL ids. Rows with equal fingerprints are one
    node, whatever their number. Only fingerprints link: rows of one id with different texts are in
    the classes of their texts. Repeated rows stay; an empty table gives no rows.
    """
    made = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")),
                               scheme, "_t").drop("_t"), "near-fingerprints")
    node = F.get("fp", 0)
    nodes = stored(made.groupBy("fp").agg(F.min("doc_id").alias("least"))
                   .select("fp", node.alias("node"), "least"), "near-nodes")
    words = ([F.slice("fp", 1, scheme.words).alias("fp"), F.element_at("fp", -1).alias("sim")]
             if isinstance(scheme, Sets) else ["fp"])
    root = classes(nodes.select("node", *words), scheme,
                   lambda wanted: sets_of(docs, scheme, text, wanted))
    rooted = nodes.join(root, "node", "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "node").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("_fp", "component_id")
    return (made.join(known, F.col("fp") == F.col("_fp"))
            .select("doc_id", "fp", "component_id"))


def keep_one(docs: DataFrame, scheme: Scheme | Sets, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of its smallest id, with all columns.

    Of rows that share that id and group one stays. Rows with a NULL id go where their group has an
    id; of a group without any, one row per fingerprint stays.
    """
    labelled = stored(label(docs, scheme, doc_id, text), "near-labels")
    odd = (labelled.groupBy("doc_id").agg(F.count("*").alias("n"))
           .where("n > 1 or doc_id is null").select("doc_id"))
    gone_id, odd_id, fp, c = unused(docs, "gone", "odd", "fp", "component")
    gone = (labelled.where("doc_id != component_id").select("doc_id").distinct()
            .withColumnRenamed("doc_id", gone_id))
    if not odd.limit(1).count():  # the usual case: an id tells which row
        return docs.join(gone, F.col(doc_id) == F.col(gone_id), "left_anti")
    several = odd.where("doc_id is not null").withColumnRenamed("doc_id", odd_id)
    single = (docs.where(F.col(doc_id).isNotNull())
              .join(several, F.col(doc_id) == F.col(odd_id), "left_anti")
              .join(gone, F.col(doc_id) == F.col(gone_id), "left_anti"))
    others = docs.where(F.col(doc_id).isNull()).unionAll(
        docs.join(several, F.col(doc_id) == F.col(odd_id), "left_semi"))
    known = labelled.select(F.col("fp").alias(fp), F.col("component_id").alias(c)).distinct()
    others = fingerprints(others, scheme, text, fp).join(known, fp)
    owned = others.where(F.col(doc_id) == F.col(c)).dropDuplicates([c])
    void = others.where(F.col(c).isNull()).dropDuplicates([fp])
    return (single.unionByName(owned.drop(fp, c)).unionByName(void.drop(fp, c))
            .select(*[F.col(f"`{name}`") for name in docs.columns]))
