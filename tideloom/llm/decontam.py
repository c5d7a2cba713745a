"""Benchmark decontamination: training passages query a BM25 index of test items by block-max WAND.

Items are cut into chunks, and a chunk's impacts are divided by the score that it has against itself; so the threshold
is the part of a chunk's own score that a passage reaches, and is alike for all.  Document frequencies and the mean
length are of the whole benchmark, however many slices it is searched in.  Chunks are numbered, and all posting lists
are cut at the same numbers into blocks, each with its largest impact; so the blocks of a passage's lists are aligned.
Passages are handled many at a time:

1. a passage whose lists' largest impacts sum to less than the threshold has no pivot anywhere and is skipped;
2. a passage has its pivot in a range of chunks only if the block maxima of its lists there sum to the threshold; blocks
   of other ranges are skipped, and not opened;
3. lists of terms in so many chunks that even all of them together can't lift a chunk far are never opened: what they can
   add is a bound of each range and of each chunk.  A chunk whose partial score and that bound stay below the threshold
   is skipped;
4. the others are scored in full.

What is retrieved is verified: question and answer, as word n-grams, against the whole document, and as words in their
order within a passage of it, as an edit takes away up to five n-grams but one word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import anti, bounded_batches, lookup, row_key, spread, stash

#: Words of a passage, and how far the next one begins; every word of a text is in a passage.
PASSAGE, STRIDE = 64, 32
#: The part of a chunk's own score that retrieves it.
RETRIEVE = 0.3
#: N-gram length, and the parts of the question's and of the answer's n-grams that a document must hold.
GRAM, OVERLAP = 5, 0.8
#: A part of fewer words, in which a few edits are a large share, is judged together with the other part.
SHORT = 10
#: The usual parameters of BM25, and the chunks that a block's range has.
K1, B, BLOCK = 1.2, 0.75, 32
#: Characters of items in a slice's index, which workers hold one at a time; the results don't depend on it.
INDEX_CHARS = 16_000_000
GROUP_CHARS = 1_000_000
#: Bytes of text that aren't letters or digits separate words; those above ASCII count as letters.
SEPARATORS = bytes(b if chr(b).isalnum() or b >= 128 else 0x20 for b in range(256))
SENTENCE = re.compile(r"(?<=[.?!])\s+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SEPARATORS).split()


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: all sentences but the last, and the last; of one sentence, two thirds of the
    words and the rest."""
    sentences = [w for s in SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def chunks_of(words: list[bytes]) -> list[list[bytes]]:
    """The chunks of an item, of ``PASSAGE`` words; a short end takes in words before it."""
    return [words[-PASSAGE:] if begin and len(words) - begin < STRIDE else words[begin : begin + PASSAGE] for begin in range(0, len(words), PASSAGE)]


@dataclass
class Statistics:
    """Of all items: the number of chunks, their mean number of words, and the number of chunks that hold a word."""

    chunks: int
    mean: float
    held: dict[bytes, int]


def statistics(texts: list[str]) -> Statistics:
    pieces = [c for t in texts for c in chunks_of([w for p in parts(t) for w in p])]
    return Statistics(len(pieces), sum(map(len, pieces)) / max(len(pieces), 1), Counter(w for c in pieces for w in set(c)))


@dataclass
class Index:
    """Items of a slice, their chunks' postings by term, and bounds."""

    items: list[tuple[object, list[bytes], list[bytes]]]
    owner: np.ndarray  # item of each chunk
    terms: dict[bytes, int]
    weights: list[dict[int, float]]  # of each chunk: its terms' impacts
    most: np.ndarray  # largest impact of each term
    opened: np.ndarray  # whether a term's list is opened
    start: np.ndarray  # first block of each term
    block_range: np.ndarray  # of each block: its range of chunks, largest impact, and first posting
    block_most: np.ndarray
    block_start: np.ndarray
    chunk: np.ndarray
    impact: np.ndarray
    rest: np.ndarray  # of each chunk: the most that unopened lists add
    range_rest: np.ndarray  # of each range: the largest of that


def build(items: list[tuple[object, str]], told: Statistics, retrieve: float = RETRIEVE) -> Index:
    whole = [(key, *parts(text)) for key, text in sorted(items, key=lambda x: str(x[0]))]
    chunks, owner = [], []
    for k, (_, question, answer) in enumerate(whole):
        for piece in chunks_of(question + answer):
            chunks.append(Counter(piece))
            owner.append(k)
    terms: dict[bytes, int] = {}
    weights = []
    for c in chunks:
        length = K1 * (1 - B + B * sum(c.values()) / told.mean)
        raw = {}
        for w, f in c.items():
            d = told.held[w]
            raw[terms.setdefault(w, len(terms) + 1)] = np.log(1 + (told.chunks - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + length)  # 0 is any other word
        total = sum(raw.values())
        weights.append({t: x / total for t, x in raw.items()})
    n, most = len(chunks), np.zeros(len(terms) + 1)
    where: dict[int, list[int]] = {}
    for k, c in enumerate(weights):
        for t, x in c.items():
            most[t] = max(most[t], x)
            where.setdefault(t, []).append(k)
    # the terms in most chunks stay closed, as long as no chunk gets half the threshold from them
    rest, opened = np.zeros(n), np.ones(len(terms) + 1, bool)
    for t in sorted(where, key=lambda t: (-len(where[t]), t)):
        more = np.array([weights[k][t] for k in where[t]])
        if (rest[where[t]] + more).max() > retrieve / 2:
            break
        rest[where[t]] += more
        opened[t] = False
    start, block_range, block_most, block_start, chunk, impact = [0, 0], [], [], [0], [], []
    for t in range(1, len(terms) + 1):
        if opened[t]:
            held = np.array(where[t])
            cut = np.flatnonzero(np.r_[True, held[1:] // BLOCK != held[:-1] // BLOCK])
            own = np.array([weights[k][t] for k in held])
            block_range += (held[cut] // BLOCK).tolist()
            block_most += np.maximum.reduceat(own, cut).tolist()
            block_start += (len(chunk) + np.r_[cut[1:], len(held)]).tolist()
            chunk += held.tolist()
            impact += own.tolist()
        start.append(len(block_most))
    range_rest = np.maximum.reduceat(rest, np.arange(0, n, BLOCK)) if n else np.zeros(0)
    return Index(
        whole, np.array(owner, np.int64), terms, weights, most, opened, np.array(start), np.array(block_range, np.int64), np.array(block_most), np.array(block_start), np.array(chunk, np.int64), np.array(impact), rest, range_rest
    )


def retrieved(index: Index, texts: list[list[bytes]], retrieve: float = RETRIEVE) -> list[set[int]]:
    """For each text, as words, the items of which one of its passages reaches a chunk."""
    out: list[set[int]] = [set() for _ in texts]
    get = index.terms.get
    sizes = np.array([len(w) for w in texts], np.int64)
    term = np.fromiter((get(w, 0) for words in texts for w in words), np.int64, int(sizes.sum()))
    steps = np.maximum(-(-sizes // STRIDE), 1)  # passage k of a text is its words from k * STRIDE on
    offset = np.cumsum(steps) - steps
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = np.flatnonzero(term)
    if not len(known):
        return out
    step = place[known] // STRIDE
    passage = offset[doc[known]] + step
    also = step > 0
    wide = len(index.most)
    pair = np.unique(np.concatenate([passage * wide + term[known], (passage[also] - 1) * wide + term[known][also]]))
    passage, term = pair // wide, pair % wide

    bound = np.bincount(passage, index.most[term])
    use = (bound[passage] >= retrieve - 1e-9) & index.opened[term]
    passage, term = passage[use], term[use]
    blocks = index.start[term + 1] - index.start[term]
    passage, block = np.repeat(passage, blocks), spread(index.start[term], blocks)
    # the pivots: ranges of chunks in which the aligned block maxima of all lists reach the threshold
    ranges = len(index.range_rest)
    pivot, place = np.unique(passage * ranges + index.block_range[block], return_inverse=True)
    reach = np.bincount(place, index.block_most[block], minlength=len(pivot)) + index.range_rest[pivot % max(ranges, 1)]
    use = (reach >= retrieve - 1e-9)[place]
    passage, block = passage[use], block[use]
    count = index.block_start[block + 1] - index.block_start[block]
    at = spread(index.block_start[block], count)
    n = len(index.owner)
    key, inverse = np.unique(np.repeat(passage, count) * n + index.chunk[at], return_inverse=True)
    partial = np.bincount(inverse, index.impact[at], minlength=len(key))
    key = key[partial + index.rest[key % n] >= retrieve - 1e-9]
    docs = np.searchsorted(offset, key // n, side="right") - 1
    for p, c, d in zip((key // n).tolist(), (key % n).tolist(), docs.tolist(), strict=True):
        item = int(index.owner[c])
        if item in out[d]:
            continue
        begin = (p - int(offset[d])) * STRIDE
        held = {get(w, 0) for w in texts[d][begin : begin + PASSAGE]}
        if sum(x for t, x in index.weights[c].items() if t in held) >= retrieve - 1e-9:
            out[d].add(item)
    return out


def in_order(part: list[bytes], words: list[bytes], least: int) -> int:
    """The most words of ``part`` that stand in their order within a passage of up to 1.25 times its length; 0 if there
    are fewer than ``least``.

    Longest common subsequences, of the part and windows that overlap so that each such passage is in one of them whole;
    a window is read only if it has enough of the part's words.
    """
    n, best = len(part), max(least, 1) - 1
    if not n:
        return 0
    masks: dict[bytes, int] = {}
    for k, w in enumerate(part):
        masks[w] = masks.get(w, 0) | 1 << k
    step = max(1, n // 4)
    size = n + n // 4 + step
    known = np.fromiter((w in masks for w in words), np.int64, len(words))
    total = np.r_[0, np.cumsum(known)]
    begins = np.arange(0, max(len(words) - size, 0) + step, step)
    many = np.minimum(total[np.minimum(begins + size, len(words))] - total[np.minimum(begins, len(words))], n)
    full, found = (1 << n) - 1, 0
    for k in np.argsort(-many, kind="stable").tolist():
        if many[k] <= best:
            break
        row = full  # bits that are off: steps of the longest common subsequence
        begin = int(begins[k])
        for w in words[begin : begin + size]:
            if m := masks.get(w):
                u = row & m
                row = (row + u | row - u) & full
        got = n - row.bit_count()
        if got > best:
            best = found = got
    return found


def overlaps(item: tuple[object, list[bytes], list[bytes]], held: dict[int, set], words: list[bytes], overlap: float = OVERLAP) -> tuple[float, float]:
    """The parts of the question and of the answer that a text has: of their n-grams or, where more, of their words in
    order within a passage.  If one has fewer than ``SHORT`` words, the words of both are counted as one part, as a
    single edit would be a large share of it.  A part shorter than an n-gram is one n-gram, and one without words is
    there.  Words are compared only if n-grams don't suffice and words of the text could."""
    out = []
    for part in item[1:]:
        wanted = grams(part, GRAM)
        n = min(GRAM, len(part))
        if n and n not in held:
            held[n] = grams(words, n) if len(words) >= n else set()
        out.append(len(wanted & held[n]) / len(wanted) if wanted else 1.0)
    if min(out) >= overlap:
        return out[0], out[1]
    if 1 not in held:
        held[1] = grams(words, 1)
    sizes = [len(p) for p in item[1:]]
    most = [sum((w,) in held[1] for w in p) for p in item[1:]]  # bounds
    enough = lambda part, whole: -int(-(overlap * whole - 1e-9) // 1) if part else 0
    if 0 < min(sizes) < SHORT:
        needed = enough(True, sum(sizes))
        if sum(most) < needed:
            return out[0], out[1]
        large, little = (0, 1) if sizes[0] >= sizes[1] else (1, 0)
        got = in_order(item[1 + large], words, needed - most[little])
        if got + most[little] >= needed:
            got += in_order(item[1 + little], words, needed - got)
        if got >= needed:
            return max(out[0], got / sum(sizes)), max(out[1], got / sum(sizes))
        return out[0], out[1]
    for k, part in enumerate(item[1:]):
        needed = enough(part, sizes[k])
        if out[k] < overlap:
            if most[k] < needed or not (got := in_order(part, words, needed)):
                break
            out[k] = max(out[k], got / sizes[k])
    return out[0], out[1]


def leaks(index: Index, texts: list[str | None], retrieve: float, overlap: float) -> list[list[tuple[object, float, float]]]:
    """For each text the verified items: id, and the parts of question and answer that it has."""
    words = [words_of(t) for t in texts]
    out = []
    for w, found in zip(words, retrieved(index, words, retrieve), strict=True):
        held: dict[int, set] = {}
        told = [(index.items[k][0], *overlaps(index.items[k], held, w, overlap)) for k in sorted(found)]
        out.append([x for x in told if x[1] >= overlap and x[2] >= overlap])
    return out


def slices_of(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The items with words as ``_slice, _id, _text``, and the number of slices."""
    items = benchmark.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    number = -(-(items.agg(F.sum(F.char_length("_text"))).first()[0] or 0) // INDEX_CHARS) or 1
    return items.select(F.pmod(F.xxhash64("_text"), F.lit(number)).cast("int").alias("_slice"), "_id", "_text"), number


def counted(items: DataFrame) -> tuple[DataFrame, int, float]:
    """``_slice, word, held``: for each word of each slice the number of chunks that hold it in the whole benchmark; and
    the number of all chunks, and their mean number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for c in chunks_of([w for p in parts(text) for w in p]):
                    held.update((part, w) for w in set(c))
                    held[part, None] += 1
                    held[part, True] += len(c)
            keys = [(part, w if isinstance(w, bytes) else None, w is True) for part, w in held]
            part, word, total = zip(*keys, strict=True) if keys else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(word, pa.binary()), pa.array(total, pa.bool_()), pa.array(list(held.values()), pa.int64())], names=["_slice", "word", "total", "n"])

    rows = items.select("_slice", "_text").mapInArrow(count, "_slice int, word binary, total boolean, n long")
    rows = stash(rows.groupBy("_slice", "word", "total").agg(F.sum("n").alias("n")), "word-counts")
    sums = {r.total: r.n for r in rows.where("word is null").groupBy("total").agg(F.sum("n").alias("n")).collect()}  # two rows
    words = rows.where("word is not null")
    held = words.groupBy("word").agg(F.sum("n").alias("held"))
    return stash(words.select("_slice", "word").join(held, "word"), "words"), sums.get(False, 0), sums.get(True, 0) / max(sums.get(False, 0), 1)


def indexes(benchmark: DataFrame, id_col: str, text_col: str, retrieve: float) -> Iterator[Index]:
    """The index of each slice in turn; the driver holds one at a time."""
    items, number = slices_of(benchmark, id_col, text_col)
    words, chunks, mean = counted(items)
    for k in range(number if chunks else 0):
        rows = [(r["_id"], r["_text"]) for r in items.where(F.col("_slice") == k).collect()]
        if rows:
            told = words.where(F.col("_slice") == k).select("word", "held").toArrow()  # the words of one slice
            held = dict(zip(told.column(0).to_pylist(), told.column(1).to_pylist(), strict=True))
            yield build(rows, Statistics(chunks, mean, held), retrieve)


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def searched(docs: DataFrame, index: Index, retrieve: float, overlap: float) -> DataFrame:
    """``docs``, whose last column is the text, with ``_item``, ``_question``, ``_answer`` instead of it: a row for each
    verified item of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, row = [], [], 0
            for texts in _groups(batch.column(batch.num_columns - 1).to_pylist()):
                for told in leaks(shared.value, texts, retrieve, overlap):
                    at += [row] * len(told)
                    found += told
                    row += 1
            kept = pa.array(at, pa.int64())
            more = [pa.array([str(x[0]) for x in found], pa.string()), *[pa.array([x[k] for x in found], pa.float64()) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*[c.take(kept) for c in batch.columns[:-1]], *more], names=[*batch.schema.names[:-1], "_item", "_question", "_answer"])

    return bounded_batches(docs).mapInArrow(run, f"{schema}, _item string, _question double, _answer double")


def all_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, retrieve: float, overlap: float) -> DataFrame:
    """``_key`` (a hash of id and text) and ``n_items``, ``items``, ``question``, ``answer`` of the rows with leaks.

    Slices are searched one after the other: a pass over the texts has one index, and writes only what it finds.
    """
    rows = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    found = [stash(searched(rows, index, retrieve, overlap), "leaks") for index in indexes(benchmark, item_col, item_text, retrieve)]
    if not found:
        return docs.sparkSession.createDataFrame([], "_key binary, n_items long, items string, question double, answer double")
    told = reduce(DataFrame.unionByName, found).distinct().groupBy("_key")
    told = told.agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("_item")), ",").alias("items"), F.max("_question").alias("question"), F.max("_answer").alias("answer"))
    return stash(told, "leaky")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: id, ``contaminated``, ``n_items``, ``items`` (ids, comma-joined in text order), and
    ``question``, ``answer``: the largest overlaps among them (0 if there is none).

    An item leaks into a document if one of the document's passages reaches ``retrieve`` of the BM25 score that a chunk
    of the item has against itself, and at least ``overlap`` of the question, and of the answer, is in the document: of
    the word n-grams, or of the words in order within a passage (of both together if one has few words).  Null texts and
    items without words have no leaks; null ids and repeated rows keep their rows, and items that repeat are one item
    each; an empty table on either side gives no leaks.  Other columns are not read.

    Workers and driver hold the index of one slice of the benchmark, of ``INDEX_CHARS`` characters; each slice is a pass
    over the texts.  What is retrieved and found doesn't depend on the slices.
    """
    told = all_leaks(docs, benchmark, id_col, text_col, item_col, item_text, retrieve, overlap)
    rows = docs.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_key"))
    out = lookup(rows, told, "_key", narrow=False)
    zero = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return out.select(F.col("_id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), zero("n_items", 0).cast("long").alias("n_items"), zero("items", ""), zero("question", 0.0), zero("answer", 0.0))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` into which no item leaks (see ``find_leaks``), with all their columns."""
    told = all_leaks(docs, benchmark, id_col, text_col, item_col, item_text, retrieve, overlap)
    keyed = docs.withColumn("__leak_key", row_key(F.col(id_col), F.col(text_col)))
    return anti(keyed, told.select(F.col("_key").alias("__leak_key")), "__leak_key").drop("__leak_key")
