"""Word-shingle Jaccard join by prefix filters under several global token orders.

A shingle is a 64-bit hash. Two sets that reach the threshold share a shingle within their prefixes under
*every* global order of shingles. There are three: rare first by a fixed-size counting sketch over all documents
(in powers of two, then a hash); a hash alone, which knows nothing of how common shingles are; and rare first
by a second sketch of other hash ranges, then the hash backwards. Pairs come from the first order, must
meet under the other two, must have bitmaps that leave room for the threshold, and only then are whole sets compared. Rare
shingles come first, so passages that many texts share stay out of prefixes of the first order.

Equal sets are one class. A bucket holds the classes that share a prefix shingle. In buckets of up to SMALL
classes all pairs are candidates. A larger one is dealt by a hash into more sub-buckets the commoner its shingle's
hash range is; each class is compared with two members of the bucket, the one with the fewest rarer shingles and one
by hash, which are found a sub-bucket at a time. Buckets whose members have by then joined one component
need nothing more; in the others, pairs from different components are candidates, in buckets of over MIXED
classes only where they share a prefix shingle of the second order too, by a join on both. So a large group of near copies costs a few comparisons a
member, no task holds a whole large bucket, and no link between different components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, dropped, gathered, list_array, lower_ascii, map_text, mixed, only, released, row_ids, text_batches, word_hashes, written
from .components import components

CHUNK = 1 << 12
#: Branches of the tree that adds the tasks' sketches up.
BRANCHES = 64
#: Bits of a set's bitmap.
BITMAP = 1 << 10
#: Sets whose bitmaps are counted at once.
BITMAP_ROWS = 512
#: Classes of a bucket whose pairs are all candidates, before and after components are known.
SMALL, MIXED = 16, 64
#: A bucket has 2**s sub-buckets, s being by how many powers of two over 2**FLAT times the median its shingle's range is, up to SPREAD.
FLAT, SPREAD = 2, 8

def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles in order, repeats included, one text after the other, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as its one shingle."""
    codes, offsets, words = ascii_words(lower_ascii(texts))
    h = word_hashes(words)[codes]
    counts = np.diff(offsets)
    length = np.minimum(counts, size)
    starts = np.where(counts > 0, counts - length + 1, 0)
    at = gathered(offsets[:-1], starts)
    of = np.repeat(length, starts)
    value = of.astype(np.uint64)
    least = int(length[counts > 0].min(initial=size))
    for i in range(size):
        some = slice(None) if i < least else np.flatnonzero(of > i)
        value[some] = mixed(value[some] * np.uint64(0x9E3779B97F4A7C15) + h[at[some] + i])
    return value, np.concatenate(([0], np.cumsum(starts)))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, one text after the other, and where each text's begin."""
    value, offsets = shingles(texts, size)
    fresh = np.ones(len(value), bool)
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if high - low > 1:
            value[low:high].sort()
    fresh[1:] = value[1:] != value[:-1]
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    return value[fresh], np.concatenate(([0], np.cumsum(fresh)))[offsets]


def bitmaps(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set, BITMAP bits: how often, odd or even, a shingle hashes to each. Where two sets' bits
    differ, so does a shingle of theirs, so sets have at least as many unshared shingles as bits that differ."""
    width = BITMAP.bit_length() - 1
    out = np.zeros((len(offsets) - 1, BITMAP // 8), np.uint8)
    for low in range(0, len(out), BITMAP_ROWS):  # the counts of all sets at once would be large
        part = offsets[low : low + BITMAP_ROWS + 1]
        rows = len(part) - 1
        at = row_ids(part) * BITMAP + (mixed(values[part[0] : part[-1]], 201) >> np.uint64(64 - width)).astype(np.int64)
        odd = np.bincount(at, minlength=rows * BITMAP) & 1
        out[low : low + rows] = np.packbits(odd.astype(np.uint8).reshape(rows, BITMAP), axis=1, bitorder="little")
    return out.reshape(-1).view(np.int64)


class _Orders:
    """Key functions of the global orders from two sketches' levels (arrays of 2**bits)."""

    def __init__(self, levels: np.ndarray):
        self.levels, self.bits = levels, int(levels.shape[1]).bit_length() - 1
        some = levels[0][levels[0] > 0]
        self.median = int(np.median(some)) if len(some) else 0

    def _level(self, sketch: int, values: np.ndarray) -> np.ndarray:
        return self.levels[sketch][_ranges(values, sketch, self.bits)]

    def key(self, order: int, values: np.ndarray) -> np.ndarray:
        if order == 2:
            return mixed(values, 2)
        tail = mixed(values, order) >> np.uint64(8)
        if order == 3:
            tail ^= np.uint64((1 << 56) - 1)
        return (self._level(order // 2, values).astype(np.uint64) << np.uint64(56)) | tail

    def spread(self, values: np.ndarray) -> np.ndarray:
        return np.clip(self._level(0, values).astype(np.int64) - self.median - FLAT, 0, SPREAD).astype(np.int8)


def _ranges(values: np.ndarray, sketch: int, bits: int) -> np.ndarray:
    """The hash range of each shingle in a sketch; the two sketches' ranges have nothing to do with each other."""
    return ((mixed(values, 301) if sketch else values) >> np.uint64(64 - bits)).astype(np.int64)


def prefixes(values: np.ndarray, offsets: np.ndarray, orders: _Orders, percent: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in each set's prefix under an order, and where each set's begin."""
    key = orders.key(order, values)
    by = np.empty(len(values), np.int64)
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        by[low:high] = key[low:high].argsort()
        by[low:high] += low
    n = np.diff(offsets)
    length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
    return values[by[gathered(offsets[:-1], length)]], np.concatenate(([0], np.cumsum(length)))


def common_levels(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """For each of 2**bits hash ranges of either sketch, the bit length of the number of shingles of all documents in it,
    repeats included.

    Its size is fixed by ``bits``. Each task adds up its own counts and sends them in chunks, in as many bytes a count as
    they need; those are added up in BRANCHES parts first, then whole, so no task gets more than a small share."""
    chunk = min(CHUNK, 1 << bits)
    schema = "chunk int, branch int, counts binary"

    def packed(parts: dict[int, np.ndarray], branch: int) -> pa.RecordBatch:
        kinds = [np.min_scalar_type(int(x.max())) for x in parts.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), pa.array([branch] * len(parts), pa.int32()), pa.array([x.astype(k).tobytes() for x, k in zip(parts.values(), kinds, strict=True)], pa.binary())],
            ["chunk", "branch", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in text_batches(batches):
            values, _ = shingles(batch.column(0), size)
            for sketch in (0, 1):
                total[sketch] += np.bincount(_ranges(values, sketch, bits), minlength=1 << bits)
            del values
            released()
        parts = {i: x for i, x in enumerate(total.reshape(-1, chunk)) if x.any()}
        if parts:
            yield packed(parts, TaskContext.get().partitionId() % BRANCHES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at, branch, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(counts, f"<u{len(counts) // chunk}").astype(np.int64)
                totals[at, branch] = totals.get((at, branch), 0) + x
        for branch in {b for _, b in totals}:
            yield packed({a: x for (a, b), x in totals.items() if b == branch}, branch)

    counted = docs.select("text").mapInArrow(count, schema).repartition("chunk", "branch").mapInArrow(add, schema)
    counted = counted.withColumn("branch", F.lit(0)).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros((2 << bits) // chunk * chunk, np.int64)
    for at, _, counts in counted.toLocalIterator():
        raw = bytes(counts)
        out[at * chunk : (at + 1) * chunk] = np.frombuffer(raw, f"<u{len(raw) // chunk}")
    return np.frexp(out.astype(np.float64))[1].astype(np.uint8).reshape(2, -1)


PROFILE = "doc_id long, n_shingles long, fp1 long, fp2 long, prefix array<long>, spread array<tinyint>, p2 array<int>, p3 array<int>, bits array<long>"


def _spreads(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list for each set; null where all are 0, as nearly always."""
    some = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(values > 0)))[offsets]))
    kept = np.zeros(len(offsets) - 1, bool)
    kept[some] = True
    lengths = np.where(kept, np.diff(offsets), 0)
    at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values[gathered(offsets[:-1], lengths)], pa.int8()), mask=pa.array(~kept))


def _profiled(size: int, percent: int, levels):
    """Set size, a fingerprint of the set, prefixes (32 bits a shingle do for the further orders, as they only rule out) and bitmap."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        orders = _Orders(levels.value)
        values, offsets = shingle_sets(batch.column("text"), size)
        first, first_at = prefixes(values, offsets, orders, percent, 1)
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values, seed)))) for seed in (101, 102)]
        prints = [(x[offsets[1:]] - x[offsets[:-1]]).view(np.int64) for x in sums]
        more = [list_array((x >> np.uint64(32)).astype(np.uint32).view(np.int32), at, pa.int32()) for x, at in (prefixes(values, offsets, orders, percent, k) for k in (2, 3))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                *map(pa.array, prints),
                list_array(first.view(np.int64), first_at, pa.int64()),
                _spreads(orders.spread(first), first_at),
                *more,
                list_array(bitmaps(values, offsets), np.arange(len(offsets)) * (BITMAP // 64), pa.int64()),
            ],
            ["doc_id", "n_shingles", "fp1", "fp2", "prefix", "spread", "p2", "p3", "bits"],
        )

    return run


def _sets(size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, offsets = shingle_sets(batch.column("text"), size)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(values.view(np.int64), offsets, pa.int64())], ["node", "set"])

    return run


class _Verifier:
    """Compares pairs of classes: prefixes under the further orders, then bitmaps, then whole sets of what is left."""

    def __init__(self, docs: DataFrame, profiles: DataFrame, size: int, percent: int, broadcast_rows: int):
        self.docs, self.profiles, self.size, self.percent, self.broadcast_rows = docs, profiles, size, percent, broadcast_rows

    def _ends(self, pairs: DataFrame) -> tuple[DataFrame, bool]:
        """The nodes of a written table of pairs, and whether they are few enough to broadcast, at 8 bytes each."""
        nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "nodes", 2 * pairs.count())
        return nodes, nodes.count() <= self.broadcast_rows

    def _joined(self, pairs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
        """pairs with columns of both ends' profiles, and the table of ends to drop later."""
        nodes, small = self._ends(pairs)
        ends = self.profiles.where("n_shingles > 0").join(F.broadcast(nodes) if small else nodes, "doc_id").select("doc_id", *columns)
        for end in "ab":
            pairs = pairs.join(ends.select(F.col("doc_id").alias(end), *[F.col(x).alias(f"{x}_{end}") for x in columns]), end)
        return pairs, nodes

    def met(self, pairs: DataFrame) -> DataFrame:
        """Those (a, b) that share a prefix shingle under the second order, then those of them that share one under the third
        and whose bitmaps leave room for the threshold. Each step reads only what is left."""
        found, nodes = self._joined(pairs.select("a", "b"), "p2")
        second = written(found.where(F.arrays_overlap("p2_a", "p2_b")).select("a", "b").distinct(), "second", 32 * pairs.count())
        dropped(nodes)
        found, nodes = self._joined(second, "n_shingles", "p3", "bits")
        n = F.col("n_shingles_a") + F.col("n_shingles_b")
        differ = F.expr(" + ".join(f"bit_count(bits_a[{i}] ^ bits_b[{i}])" for i in range(BITMAP // 64)))
        found = found.where(F.arrays_overlap("p3_a", "p3_b")).where((100 + self.percent) * (n - differ) >= 2 * self.percent * n)
        found = written(found.select("a", "b").distinct(), "met", 32 * second.count())
        for table in (nodes, second):
            dropped(table)
        return found

    def links(self, pairs: DataFrame) -> DataFrame:
        """Written table of those (a, b) that reach the threshold; pairs is a written table."""
        near = self.met(pairs)
        nodes, small = self._ends(near)
        sets = written(map_text(self.docs.join(F.broadcast(nodes) if small else nodes, "doc_id"), _sets(self.size), "node long, set array<long>"), "sets")
        found = near
        for end in "ab":
            found = found.join(sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}")), end)
        both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        union = F.size("set_a") + F.size("set_b") - both
        found = written(found.where(100 * both >= self.percent * union).select("a", "b").distinct(), "links", 64 * near.count())
        for table in (sets, nodes, near):
            dropped(table)
        return found


def _may_link(percent: int):
    def may_link(n: Column, i: Column, m: Column, j: Column) -> Column:
        """Up to their first common shingle, at i and j, the sets share nothing: min(n - i, m - j) are left to share.
        Of the rows of a pair that links, that of its first common shingle passes."""
        return (100 + percent) * F.least(n - i, m - j) >= percent * (n + m)

    return may_link


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class _Prepared:
    """Profiles of all rows, classes of equal sets, and the buckets of classes by shingle of their first prefix.

    buckets: rows of small buckets have ``near``, the earlier members that they may link to; rows of large ones
    have token, salt and the two centres of their sub-bucket."""

    def __init__(self, docs: DataFrame, size: int, percent: int, sketch_bits: int, broadcast_rows: int):
        levels = docs.sparkSession.sparkContext.broadcast(common_levels(docs, size, sketch_bits))
        self.may_link = _may_link(percent)
        self.profiles = written(map_text(docs, _profiled(size, percent, levels), PROFILE), "profiles")
        self.verifier = _Verifier(docs, self.profiles, size, percent, broadcast_rows)
        self.classes = (
            self.profiles.where("n_shingles > 0 and doc_id is not null")
            .groupBy("fp1", "fp2", "n_shingles")
            .agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"), F.first("spread").alias("spread"))
        )
        rows = self.classes.select(F.posexplode("prefix").alias("pos", "token"), "node", F.col("n_shingles").alias("n"), "spread")
        spread = F.coalesce(F.get("spread", F.col("pos")), F.lit(0).cast("tinyint"))
        salt = F.pmod(F.xxhash64("node"), F.expr("shiftleft(1L, cast(spread as int))"))
        rows = rows.withColumn("spread", spread).withColumn("salt", F.when(F.col("spread") > 0, salt.cast("int")))
        # One key for a sub-bucket, so that four narrow columns are all that the shuffle carries.
        rows = rows.select(
            F.when(F.col("spread") > 0, F.xxhash64("token", "salt")).otherwise(F.col("token")).alias("key"),
            "node",
            F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("n_pos"),
            F.when(F.col("spread") > 0, F.struct("token", "salt", "spread")).alias("hot"),
        ).repartition("key")
        rows = rows.select(
            "key", "node", F.shiftright("n_pos", 32).alias("n"), F.col("n_pos").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), F.xxhash64("node").alias("h"),
            F.coalesce("hot.token", "key").alias("token"), F.coalesce("hot.salt", F.lit(0)).alias("salt"), F.coalesce("hot.spread", F.lit(0).cast("tinyint")).alias("spread"),
        )
        # One sort serves both windows; most shingles are one class's own and go after the first.
        rows = rows.sortWithinPartitions("key", "node")
        w = Window.partitionBy("key")
        own = F.struct("node", "n", "pos")
        rows = rows.withColumns({"members": F.count("*").over(w), "c1": F.min(F.struct("pos", "h", "node", "n")).over(w), "c2": F.max(F.struct("h", "node", "n", "pos")).over(w)})
        rows = rows.where("members > 1 or spread > 0").withColumn("peers", F.collect_list(own).over(w.orderBy("node").rowsBetween(-(SMALL - 1), -1)))
        small = (F.col("spread") == 0) & (F.col("members") <= SMALL)
        may = F.filter("peers", lambda x: (x["node"] != F.col("node")) & self.may_link(F.col("n"), F.col("pos"), x["n"], x["pos"]))
        near = F.when(small, F.transform(may, lambda x: x["node"]))
        large = lambda x: F.when(~small, x)
        rows = rows.select(
            "node", near.alias("near"), *[large(F.col(x)).alias(x) for x in ("token", "salt", "spread", "n", "pos")], *[large(F.col(f"c{k}.{x}")).alias(f"{x}{k}") for k in (1, 2) for x in ("node", "n", "pos")]
        )
        self.buckets = written(rows.where("near is null or size(near) > 0"), "buckets")
        self.large = self.buckets.where("near is null").drop("near")

    def small_pairs(self) -> DataFrame:
        return self.buckets.where("near is not null").select("node", F.explode("near").alias("other")).select(*_pair(F.col("node"), F.col("other")))

    def star_pairs(self) -> DataFrame:
        """Members of large buckets with the two centres of the bucket: those of its sub-buckets are reduced to two, which
        come back to each sub-bucket."""
        flat, hot = self.large.where("spread = 0"), self.large.where("spread > 0")
        named = [F.struct(*[F.col(f"{x}{k}").alias(x) for x in ("pos", "h", "node", "n")]) for k in (1, 2)]
        subs = hot.withColumns({"h1": F.xxhash64("node1"), "h2": F.xxhash64("node2")}).select("token", "salt", named[0].alias("s1"), named[1].alias("s2")).distinct()
        tops = subs.groupBy("token").agg(F.min("s1").alias("t1"), F.max(F.struct("s2.h", "s2.node", "s2.n", "s2.pos")).alias("t2"))
        tops = subs.select("token", "salt").join(tops, "token").select("token", "salt", *[F.col(f"t{k}.{x}").alias(f"{x}{k}") for k in (1, 2) for x in ("node", "n", "pos")])
        hot = hot.select("token", "salt", "node", "n", "pos").join(tops, ["token", "salt"])
        out = None
        for rows in (flat, hot):
            for k in (1, 2):
                node, n, pos = (F.col(f"{x}{k}") for x in ("node", "n", "pos"))
                some = rows.where((F.col("node") != node) & self.may_link(F.col("n"), F.col("pos"), n, pos)).select(*_pair(F.col("node"), node))
                out = some if out is None else out.unionByName(some)
        return out

    def doubly_met(self, rows: DataFrame, differ: str, keys: list[str]) -> DataFrame:
        """Pairs of rows (node, n, pos, differ, keys) with equal keys that may link and whose ``differ`` isn't equal."""
        x, y = rows.alias("x"), rows.alias("y")
        same = F.col(f"x.{keys[0]}") == F.col(f"y.{keys[0]}")
        for k in keys[1:]:
            same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
        met = x.join(y, same & (F.col(f"x.{differ}") < F.col(f"y.{differ}")) & self.may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
        return met.select(*_pair(F.col("x.node"), F.col("y.node")))

    def with_second(self, rows: DataFrame) -> DataFrame:
        """rows once for each prefix shingle of the second order, as ``second``."""
        more = self.profiles.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("node"), "p2")
        return rows.join(more, "node").select(rows["*"], F.explode("p2").alias("second")).distinct()


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    sketch_bits: int = 20,
    broadcast_rows: int = 1 << 20,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. Documents link when
    100 * intersection >= percent * union of their sets of distinct ``size``-word shingles.
    component_id is the least doc_id that links reach. Null, empty and blank texts have no shingles,
    link with nothing and are their own component. A null doc_id is never a component and links
    nothing (its component_id is null, or its equal texts' least id). Rows with one doc_id count as
    one document, whose links are those of all its rows. An empty table gives none; other columns play no part.
    sketch_bits fixes the size of the tables of common hash ranges (2**20: 2 MB to each executor);
    broadcast_rows is the most ids (8 bytes each) that are broadcast, beyond it they are joined by a shuffle.
    """
    docs = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    made = _Prepared(docs, size, percent, sketch_bits, broadcast_rows)
    size_of = made.buckets.count()
    stars = written(made.small_pairs().unionByName(made.star_pairs()).distinct(), "pairs", 2 * size_of)
    links = made.verifier.links(stars)
    labels = components(links)
    labelled = made.large.select("token", "salt", "spread", "node", "n", "pos").join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    # Members are counted a sub-bucket at a time, then a bucket, and mixed buckets are found again by sub-bucket.
    state = labelled.groupBy("token", "spread").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members")).where("low <> high")
    state = state.select("token", "members", F.explode(F.expr("sequence(0, cast(shiftleft(1L, cast(spread as int)) - 1 as int))")).alias("salt"))
    left = written(labelled.drop("spread").join(state, ["token", "salt"]), "mixed", size_of)
    rest = None
    if not left.isEmpty():
        few, many = left.where(F.col("members") <= MIXED), left.where(F.col("members") > MIXED)
        rest = made.doubly_met(few, "c", ["token"]).unionByName(made.doubly_met(made.with_second(many), "c", ["token", "second"]))
        rest = written(rest.distinct().join(stars, ["a", "b"], "left_anti"), "pairs", 32 * left.count())
        more = made.verifier.links(rest)
        if not more.isEmpty():
            labels = components(links.union(more))
    for table in (made.buckets, stars, left, rest):
        dropped(table)
    members = made.profiles.select("doc_id", "n_shingles", "fp1", "fp2")
    keys = ["fp1", "fp2", "n_shingles"]
    classes = members.where("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("node"))
    keyed = classes.join(labels, "node", "left").select(*keys, F.coalesce("component", "node").alias("component_id"))
    linked = members.where("n_shingles > 0").join(keyed, keys, "left")
    alone = members.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", "component_id").union(alone.select("doc_id", "n_shingles", "component_id"))


def jaccard_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    sketch_bits: int = 20,
    broadcast_rows: int = 1 << 20,
) -> DataFrame:
    """(a, b), a < b: every link between classes of equal sets, each named by its least doc_id.

    Links are those of ``jaccard_components``, which compares only what components need; here each pair
    of a bucket that may link, and meets under the second order, is compared, so a group of n near copies costs up to n * (n - 1) / 2 of them."""
    docs = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    made = _Prepared(docs, size, percent, sketch_bits, broadcast_rows)
    rows = made.large.select("token", "node", "n", "pos")
    pairs = made.small_pairs().unionByName(made.doubly_met(made.with_second(rows), "node", ["token", "second"]))
    pairs = written(pairs.distinct(), "pairs", 32 * made.buckets.count())
    links = made.verifier.links(pairs)
    for table in (made.buckets, pairs, made.profiles):
        dropped(table)
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay when one document of each component does: that with the least id.

    Rows without an id stay. Of rows that share an id, all stay or go."""
    found = jaccard_components(docs, id_col, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti")
