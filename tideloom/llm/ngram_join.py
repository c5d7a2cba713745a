"""N-gram Jaccard join: documents as sets of word shingles, all links at or above a similarity, and their components.

The join skips by the relations between sets.

* Equal sets are one set.  Everything below is on distinct sets.
* Index lists hold, for each shingle of a set's prefix (in a global order that puts frequent shingles last), the sets by
  size and by the shingle's position in them.  Sizes that can't link cut a list into runs.  Entries of one size and
  position are a block; blocks whose position leaves too few shingles for any partner of the run are skipped by their
  header, and not opened.
* Runs with the same first set are one group, so a pair that shares hundreds of lists is met in few groups.  First parity
  bitmaps, which bound an overlap from above, sort out the sets without a partner; then whole sets are compared.
* In a group, sets follow one another so that similar ones are neighbours.  The overlaps of a set with all others, and by
  them its answers, are derived from those of the set before it: they change only in the sets that are on the group's
  lists of the shingles in which the two differ.  A forest of the links is kept, not all pairs.
* A large group is first dealt out at random into blocks, ``ROUNDS`` times, and links are sought within blocks.  Near
  copies nearly all fall into one component by that.  Then only those outside of a group's largest component have to be
  compared with all others, in pairs of blocks; so the rows that are sent grow with a group of copies, not with its square.

No step compares less than all: order, groups and bitmaps decide about the work, not about the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import anti, bounded_batches, lookup, meet, row_key, semi, spread, stash, unstash

#: Odd multipliers of the words of a shingle: rules make them, from the golden ratio on.
MULTIPLIERS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 5) % 2**64 | 1) for k in range(16)]
CACHE_WORDS = 300_000
#: Shingles are counted in groups of texts of so many characters; one that occurs in so many sets of a group is put
#: into the table of frequent ones, of which at most so many, the most frequent, are kept.  The table only orders.
COUNT_CHARS, COUNT_LEAST, FREQUENT_ROWS = 8_000_000, 6, 1_000_000
#: Blocks of a group have about so many sets and shingles, and large groups are dealt out so often.
BLOCK_SETS, BLOCK_SHINGLES, ROUNDS = 256, 500_000, 3
NODE = "struct<hi:bigint,lo:bigint>"


class Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finaliser of a known generator)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, width: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words, of ASCII lower case; fewer words are one shingle."""
    # bytes know ASCII letters and white space only
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(width, len(h))
    m = len(h) - n + 1
    total = np.full(m, n, np.uint64)
    for k in range(n):
        total += h[k : k + m] * MULTIPLIERS[k]
    return np.unique(mixed(total))


def signature(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of the number of shingles in each bin; there are two bins or more for each shingle."""
    bins = 64
    while bins < 2 * len(hashes):
        bins *= 2
    odd = np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def prefix_size(n: np.ndarray | int, percent: int):
    """So many shingles of a set of ``n``, the first in the order, are indexed: two sets that link share one there."""
    return n + (-percent * n // 100) + 1


def least_overlap(total, percent: int):
    """The overlap that two sets of together ``total`` shingles need."""
    return -(-percent * total // (100 + percent))


def _scan(docs: DataFrame, width: int, schema: str, make: Callable[[Iterator[tuple[list, list[np.ndarray], int]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``make`` of the columns but the last, and of the sets of the last column's texts, in groups of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()

        def groups() -> Iterator[tuple[list, list[np.ndarray], int]]:
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                begin = size = 0
                held: list[np.ndarray] = []
                for k in range(batch.num_rows):
                    text = texts[k].as_py()
                    held.append(shingles(text, width, words))
                    size += len(text or "")
                    if size >= 4_000_000 or k == batch.num_rows - 1:
                        yield batch.slice(begin, k + 1 - begin).columns[:-1], held, size
                        begin, size, held = k + 1, 0, []

        yield from make(groups())

    return bounded_batches(docs).mapInArrow(run, schema)


def profile(docs: DataFrame, width: int) -> DataFrame:
    """From ``_id``, ``_text_hash``, ``_text``: for each row its id and text hash, size, signature and bitmap; and
    with them, in rows of their own, the shingles that are frequent in a group of texts (``shingle``, ``sets``)."""
    kind = docs.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _text_hash binary, size long, hi long, lo long, bits binary, shingle long, sets long"

    def make(groups) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        seen: list[np.ndarray] = []
        chars = 0

        def frequent() -> Iterator[pa.RecordBatch]:
            value, count = np.unique(np.concatenate(seen), return_counts=True)
            value, count = value[count >= COUNT_LEAST], count[count >= COUNT_LEAST]
            if len(value):
                null = lambda t: pa.nulls(len(value), t)
                yield pa.RecordBatch.from_arrays([null(ids.type), null(pa.binary()), null(pa.int64()), null(pa.int64()), null(pa.int64()), null(pa.binary()), pa.array(value.view(np.int64)), pa.array(count)], names=names)

        for (ids, hashes), sets, size in groups:
            marks = np.frombuffer(b"".join(map(signature, sets)), "<i8").reshape(-1, 2)
            null = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(list(map(len, sets)), pa.int64()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), pa.array(list(map(bitmap, sets)), pa.binary()), null, null], names=names)
            seen += sets
            chars += size
            if chars >= COUNT_CHARS:
                yield from frequent()
                seen, chars = [], 0
        if seen:
            yield from frequent()

    return _scan(docs, width, schema, make)


def postings(docs: DataFrame, width: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """From ``_text``: for each shingle of a set's prefix a row ``shingle, hi, lo, size, place``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT_ROWS rows at most

    def make(groups) -> Iterator[pa.RecordBatch]:
        hot, count = shared.value
        known: set[bytes] = set()
        for _, sets, _ in groups:
            out = []
            for s in sets:
                if not len(s) or (mark := signature(s)) in known:
                    continue
                if len(known) >= CACHE_WORDS:
                    known.clear()
                known.add(mark)
                n = prefix_size(len(s), percent)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    # a stable sort of sorted hashes: by count, then by hash
                    s = s[np.argsort(np.where(hot[at] == s, count[at], 0), kind="stable")]
                hi, lo = np.frombuffer(mark, "<i8")
                out.append((s[:n].view(np.int64), np.full(n, hi), np.full(n, lo), np.full(n, len(s)), np.arange(n)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["shingle", "hi", "lo", "size", "place"])

    return _scan(docs, width, "shingle long, hi long, lo long, size long, place long", make)


def grouped(lists: DataFrame, percent: int) -> DataFrame:
    """From postings: the members of groups, ``head, node, size``, with repeats.

    A task streams through its lists in order and holds a batch at a time, whatever a list's length.
    """
    rows = lists.repartition("shingle").sortWithinPartitions("shingle", "size", "place", "hi", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = np.empty((0, 5), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            fresh = len(carried)
            x = np.concatenate([carried, x])
            new = np.r_[True, (x[1:, 0] != x[:-1, 0]) | (100 * x[:-1, 3] < percent * x[1:, 3])]
            if fresh == 2:
                new[1] = False  # the first and the last entry so far of a run that may go on
            repeat = np.r_[False, ~new[1:] & (x[1:, :3] == x[:-1, :3]).all(axis=1)]
            x, new = x[~repeat], new[~repeat]
            begin = np.flatnonzero(new)
            many = np.diff(np.r_[begin, len(x)])
            # the headers of blocks: one size and position of a run
            block = np.flatnonzero(new | np.r_[True, (x[1:, 3:] != x[:-1, 3:]).any(axis=1)])
            run_of = np.searchsorted(begin, block, side="right") - 1
            size, left = x[block, 3], x[block, 3] - x[block, 4]
            smallest = np.maximum(-(-percent * size // 100), x[begin[run_of], 3])
            opened = (many[run_of] > 1) & (left >= least_overlap(size + smallest, percent))
            # runs of two: one pair decides; the last run of a batch may still grow
            pair = begin[(many == 2) & (np.arange(len(begin)) < len(begin) - 1)]
            pair = pair[pair >= fresh]
            rest = x[:, 3] - x[:, 4]
            short = pair[np.minimum(rest[pair], rest[pair + 1]) < least_overlap(x[pair, 3] + x[pair + 1, 3], percent)]
            opened &= ~np.isin(begin[run_of], short)
            at = spread(block[opened], np.diff(np.r_[block, len(x)])[opened])
            head = np.repeat(begin[run_of[opened]], np.diff(np.r_[block, len(x)])[opened])
            last = begin[-1]
            carried = x[[last, len(x) - 1]] if len(x) - 1 > last else x[[last]]
            out = np.unique(np.concatenate([x[head, 1:3], x[at, 1:4]], axis=1), axis=0)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], names=["h_hi", "h_lo", "hi", "lo", "size"])

    out = rows.mapInArrow(run, "h_hi long, h_lo long, hi long, lo long, size long")
    return out.select(F.struct(F.col("h_hi").alias("hi"), F.col("h_lo").alias("lo")).alias("head"), F.struct("hi", "lo").alias("node"), "size")


def sizes_of(members: DataFrame) -> DataFrame:
    """``head, parts`` of the groups of two and more: into how many blocks they go."""
    sizes = members.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("s") / BLOCK_SHINGLES)).cast("int")
    return stash(sizes.select("head", parts.alias("parts")), "sizes")


def gathered(rows: DataFrame, payload: DataFrame) -> DataFrame:
    """``head, first, second, block, node, size`` with ``payload(node, data)``, for ``hopeful`` and ``links``: rows of
    equal ``head, first, second`` together, sorted.  If ``first`` and ``second`` differ, the sets of one block are to be
    compared with those of the other, else all."""
    rows = rows.join(payload, "node").select("head", "first", "second", "block", "node", "size", "data")
    return rows.repartition("head", "first", "second").sortWithinPartitions("head", "first", "second", "size", "node")


def whole_groups(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of the groups that one block holds."""
    zero = [F.lit(0).alias(c) for c in ("first", "second", "block")]
    return meet(members, sizes.where("parts = 1").drop("parts"), "head").select("head", *zero, "node", "size")


def at_random(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of larger groups, dealt out to blocks ``ROUNDS`` times."""
    rows = meet(members, sizes, "head").withColumn("round", F.explode(F.array(*map(F.lit, range(ROUNDS)))))
    block = F.col("round") * F.col("parts") + F.pmod(F.xxhash64("round", "node"), "parts").cast("int")
    return rows.select("head", block.alias("first"), block.alias("second"), block.alias("block"), "node", "size")


def with_rest(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of groups with ``rest``: whether they are outside of the component that has most of a group's members."""
    rows = stash(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    counts = rows.groupBy("head", "root").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("head").agg(F.max(F.struct("n", "root")).alias("top"))
    top = stash(top.select("head", F.col("top.root").alias("top")), "tops")
    return stash(meet(rows, top, "head").select("head", "node", "size", (F.col("root") != F.col("top")).alias("rest")), "rests")


def rest_with_all(rows: DataFrame) -> DataFrame:
    """From ``with_rest``: the rest of each group in blocks, in pairs with each other and with all other blocks."""
    number = lambda rest: F.ceil(F.greatest(F.sum(F.when(F.col("rest") == rest, 1).otherwise(0)) / BLOCK_SETS, F.sum(F.when(F.col("rest") == rest, F.col("size")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    parts = stash(rows.groupBy("head").agg(number(True).alias("few"), number(False).alias("most")).where("few > 0"), "parts")
    rows = meet(rows, parts, "head")
    block = F.when(F.col("rest"), F.pmod(F.xxhash64("node"), "few")).otherwise(F.col("few") + F.pmod(F.xxhash64("node"), F.greatest("most", F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("few") + F.col("most")).otherwise(F.col("few")) - 1)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(others))
    return rows.select("head", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "size")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows in tables of equal ``head_hi, head_lo, first, second``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = tuple(keys[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("head.hi", F.col("head.lo").alias("lo"), "first", "second", "block", F.col("node.hi").alias("n_hi"), F.col("node.lo").alias("n_lo"), "size", "data")


def hopeful(rows: DataFrame, percent: int) -> DataFrame:
    """Of blocked rows with bitmaps: ``head, node, size`` of those that a partner in the group may link to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            size = table.column("size").to_numpy()
            block = table.column("block").to_numpy()
            cross = table.column("first")[0] != table.column("second")[0]
            data = table.column("data").to_pylist()
            live = np.zeros(len(size), bool)
            if len(size) <= 16:
                bits = [int.from_bytes(d, "little") for d in data]
                for j in range(len(size)):
                    for i in range(j):
                        if live[i] and live[j] or 100 * size[i] < percent * size[j] or cross and block[i] == block[j]:
                            continue
                        a, b, bins = bits[i], bits[j], 8 * len(data[i])
                        if len(data[j]) > len(data[i]):  # twice as many bins; folded, they are as many
                            b = (b & ((1 << bins) - 1)) ^ (b >> bins)
                        total = int(size[i] + size[j])
                        if (total - (a ^ b).bit_count()) // 2 >= least_overlap(total, percent):
                            live[i] = live[j] = True
            else:
                words = np.array([len(d) // 8 for d in data])
                for w in np.unique(words):
                    at = np.flatnonzero((words == w) | (words == 2 * w))  # partners have as many bins or twice as many
                    flat = np.stack([np.frombuffer(data[k], np.uint64)[:w] ^ (np.frombuffer(data[k], np.uint64)[w:] if words[k] > w else np.uint64(0)) for k in at])
                    for p, i in enumerate(at):
                        if words[i] != w:
                            continue
                        stop = np.searchsorted(size[at], 100 * size[i] // percent, side="right")
                        others = np.arange(p + 1, stop)
                        if cross:
                            others = others[block[at[others]] != block[i]]
                        if live[i]:
                            others = others[~live[at[others]]]
                        if len(others):
                            total = size[i] + size[at[others]]
                            apart = np.bitwise_count(flat[others] ^ flat[p]).sum(axis=1, dtype=np.int64)
                            good = others[(total - apart) // 2 >= least_overlap(total, percent)]
                            live[at[good]] = True
                            live[i] |= len(good) > 0
            if live.any():
                keep = np.flatnonzero(live)
                yield pa.RecordBatch.from_arrays([table.column(k).to_numpy()[keep] for k in ("hi", "lo", "n_hi", "n_lo", "size")], names=["h_hi", "h_lo", "hi", "lo", "size"])

    out = _flat(rows).mapInArrow(run, "h_hi long, h_lo long, hi long, lo long, size long")
    return out.select(F.struct(F.col("h_hi").alias("hi"), F.col("h_lo").alias("lo")).alias("head"), F.struct("hi", "lo").alias("node"), "size")


def linked(sets: list[np.ndarray], block: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """A forest of the links among sets (of different blocks, if ``cross``)."""
    size = np.array([len(s) for s in sets])
    apart = [np.setxor1d(sets[0], s, assume_unique=True) for s in sets]
    own = np.array([len(d) for d in apart])
    parent = list(range(len(sets)))
    forest = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def join(i: int, j: int) -> None:
        if (a := root(i)) != (b := root(j)):
            parent[b] = a
            forest.append((i, j))

    if len(sets) <= 12:
        for j in range(len(sets)):
            for i in range(j):
                if cross and block[i] == block[j] or root(i) == root(j):
                    continue
                total = size[i] + size[j]
                both = own[j] if i == 0 else len(np.setxor1d(apart[i], apart[j], assume_unique=True))
                if (total - both) // 2 >= least_overlap(total, percent):
                    join(i, j)
        return forest
    # the group's own lists, of the shingles that several sets have
    row = np.repeat(np.arange(len(sets)), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1
    code = np.where(common, np.cumsum(common) - 1, -1)[code]
    row, code = row[code >= 0], code[code >= 0]
    held = np.split(code, np.cumsum(np.bincount(row, minlength=len(sets)))[:-1])
    entry = row[np.argsort(code, kind="stable")]
    many = np.bincount(code, minlength=int(common.sum()))
    start = np.cumsum(many) - many

    def on(codes: np.ndarray) -> np.ndarray:
        """How many of the lists each set is on."""
        return np.bincount(entry[spread(start[codes], many[codes])], minlength=len(sets))

    label = np.arange(len(sets))
    before, answers = np.empty(0, np.int64), np.zeros(len(sets), np.int64)
    # sorted hashes: sets with the same first ones, as similar sets have, follow one another
    for k in sorted(range(len(sets)), key=lambda k: tuple(sets[k][:3].tolist())):
        more, less = np.setdiff1d(held[k], before, assume_unique=True), np.setdiff1d(before, held[k], assume_unique=True)
        if len(more) + len(less) < len(held[k]):
            answers = answers + on(more) - on(less)
        else:  # another kind of set: nothing to derive its overlaps from
            answers = on(held[k])
        before = held[k]
        good = (label != label[k]) & (answers >= least_overlap(size[k] + size, percent))
        if cross:
            good &= block != block[k]
        for i in np.flatnonzero(good).tolist():
            if label[i] != label[k]:
                forest.append((k, i))
                label[label == label[i]] = label[k]
    return forest


def links(rows: DataFrame, percent: int) -> DataFrame:
    """Of blocked rows with sets: a forest of links for each block pair, ``a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            sets = [np.frombuffer(d, np.uint64) for d in table.column("data").to_pylist()]
            cross = table.column("first")[0] != table.column("second")[0]
            forest = np.array(linked(sets, table.column("block").to_numpy(), cross, percent), np.int64).reshape(-1, 2)
            if len(forest):
                hi, lo = table.column("n_hi").to_numpy(), table.column("n_lo").to_numpy()
                yield pa.RecordBatch.from_arrays([hi[forest[:, 0]], lo[forest[:, 0]], hi[forest[:, 1]], lo[forest[:, 1]]], names=["a_hi", "a_lo", "b_hi", "b_lo"])

    out = _flat(rows).mapInArrow(run, "a_hi long, a_lo long, b_hi long, b_lo long")
    node = lambda k: F.struct(F.col(f"{k}_hi").alias("hi"), F.col(f"{k}_lo").alias("lo")).alias(k)
    return out.select(node("a"), node("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node that each node of ``edges(a, b)`` can reach.

    Each round takes the least label of a node's neighbours and then that label's own label, so rounds grow with the
    logarithm of a component's width.  Labels are written to the shared folder after each.
    """
    both = stash(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("root").alias("m"))
        new = labels.join(near.withColumnRenamed("b", "node"), "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stash(new.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        unstash(labels)
        labels = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return labels


def similarity_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``_id``, ``_text_hash`` (MD5 of the text), ``size`` (distinct shingles of ``width``
    words), ``component_id`` (the smallest id in reach by links) and ``winner`` (the struct of null flag, id and text
    hash that is smallest there).  Two documents link if 100 |A∩B| >= ``percent`` |A∪B|.

    Words are runs of other than ASCII white space, of ASCII lower case; fewer words than ``width`` are one shingle.
    Null and empty texts, and texts without words, have empty sets and link with nothing.  Null ids come last: a
    ``component_id`` is null only if all ids there are.  Repeated rows give equal rows.  An empty table gives an empty
    result; columns other than id and text are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    source = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_text_hash"), F.col(text_col).alias("_text"))
    seen = stash(profile(source, width), "profile")
    rows = seen.where("size is not null").select("_id", "_text_hash", "size", F.struct("hi", "lo").alias("node"), "bits")
    full = rows.where("size > 0")

    top = seen.where("size is null").groupBy("shingle").agg(F.sum("sets").alias("sets")).orderBy(F.desc("sets"), "shingle").limit(FREQUENT_ROWS).toArrow()
    value, count = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(value)
    lists = postings(source.select("_text"), width, percent, (value[order], count[order]))
    members = stash(grouped(lists, percent).distinct(), "members")
    sizes = sizes_of(members)
    large = stash(sizes.where("parts > 1"), "large")

    first = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_text_hash").alias("hash"))
    sets = full.groupBy("node").agg(F.min(first).alias("winner"), F.count(F.lit(1)).alias("n"), F.min("_text_hash").alias("hash"), F.min("bits").alias("data"))
    sets = stash(sets, "sets")  # copies are folded before the exchange
    wanted = members.select("node").distinct()
    # written, so that the joins below have exchanges of their own, which can be split where a set is in many groups
    bits = stash(sets.join(wanted, "node", "left_semi").select("node", "data"), "bits")
    near = stash(hopeful(gathered(whole_groups(members, sizes), bits), percent).distinct(), "near")
    crowds = None if large.isEmpty() else stash(semi(members, large.select("head"), "head"), "crowds")

    needed = near.select("node") if crowds is None else near.select("node").unionByName(crowds.select("node"))
    hashes = stash(needed.distinct().join(sets, "node").select(F.col("hash").alias("_text_hash")), "hashes")
    texts = semi(source, hashes, "_text_hash").select("_text")

    def whole(groups) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for _, found, _ in groups:
            out = []
            for s in found:
                if (mark := signature(s)) not in known:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known.add(mark)
                    out.append((*np.frombuffer(mark, "<i8").tolist(), s.tobytes()))
            if out:
                hi, lo, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(data, pa.binary())], names=["hi", "lo", "data"])

    data = _scan(texts, width, "hi long, lo long, data binary", whole).select(F.struct("hi", "lo").alias("node"), "data")
    data = stash(data.groupBy("node").agg(F.min("data").alias("data")), "shingles")
    edges = links(gathered(whole_groups(near, sizes_of(near)), data), percent)
    if crowds is None:
        roots = components(edges)
    else:
        # on bitmaps first, as most of a group may be without partners
        likely = stash(hopeful(gathered(at_random(crowds, large), bits), percent).distinct(), "likely")
        parts = sizes_of(likely)
        dealt = whole_groups(likely, parts).unionByName(at_random(likely, parts.where("parts > 1")))
        edges = stash(edges.unionByName(links(gathered(dealt, data), percent)), "links")
        apart = with_rest(crowds, components(edges))
        left = stash(hopeful(gathered(rest_with_all(apart), bits), percent).distinct(), "left")
        left = apart.join(left.select("head", "node"), ["head", "node"], "left_semi")
        roots = components(edges.unionByName(links(gathered(rest_with_all(stash(left, "left")), data), percent)))

    whole_of = roots.join(sets, "node").groupBy("root").agg(F.min("winner").alias("best"))
    joined = roots.join(whole_of, "root").select("node", "best")
    told = sets.join(joined, "node", "left").where("n > 1 or best is not null").select("node", F.least("winner", F.coalesce("best", "winner")).alias("winner"))
    told = stash(told, "told")
    alone = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_text_hash").alias("hash"))
    out = lookup(rows.select("_id", "_text_hash", "size", "node"), told, "node")
    best = F.when(F.col("size") > 0, F.coalesce("winner", alone)).otherwise(alone)
    return out.select("_id", "_text_hash", "size", best["id"].alias("component_id"), best.alias("winner"))


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``; see ``similarity_components``."""
    out = similarity_components(docs, width, percent, id_col, text_col)
    return out.select(F.col("_id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, less those of which a similar document stays: of each component the
    row with the smallest id stays, of null ids alone that with the smallest text hash.  Rows without words stay, and
    so do all rows that repeat the id and text of one that stays."""
    told = similarity_components(docs, width, percent, id_col, text_col)
    own = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_text_hash").alias("hash"))
    gone = told.where((F.col("size") > 0) & (F.col("winner") != own))
    gone = stash(gone.select(row_key(F.col("_id"), F.hex("_text_hash")).alias("__join_key")).distinct(), "gone")
    key = row_key(F.col(id_col), F.upper(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return anti(docs.withColumn("__join_key", key), gone, "__join_key").drop("__join_key")
