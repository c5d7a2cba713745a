"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give scores and offsets.

Labels are of documents only, so tokens are labelled first: a token of a toxic document is toxic if it holds a marker,
a string feature that is many times as frequent in the toxic documents of the training rows as in others.  The field has
two states.  Its emission weights belong to features of the word (the word itself, its character 4- and 5-grams), and
forward-backward runs in log-odds, over all lines of a group of texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, stash

WORD = re.compile(r"\w+")
TOKEN = re.compile(r"\w+|\n")
FOLDS = 5
#: A marker is so many times as frequent in toxic documents as in others.
RATIO = 20
#: Training takes at most so many labelled rows of each class: of those whose texts have at most so many bytes, the ones
#: of the smallest MD5 of the id.  Scoring takes every row and whole texts.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 16_000
#: A worker forgets its scores of words beyond this many; texts are scored in groups of so many characters.
CACHE_WORDS, GROUP_CHARS = 200_000, 1_000_000
#: A character sequence longer than this is no word: it is cut into pieces of so many characters, each of which begins
#: with the last ``LAP`` of the one before, and each piece is a token.
WORD_CHARS, LAP = 200, 50


def cuts(word: str) -> list[tuple[int, int]]:
    """Begin and end of the tokens that a sequence of word characters gives: itself, or the pieces of a long one."""
    size, step = len(word), WORD_CHARS - LAP
    return [(0, size)] if size <= WORD_CHARS else [(k, min(k + WORD_CHARS, size)) for k in range(0, size - LAP, step)]


def pieces(word: str) -> list[str]:
    """The tokens of a sequence of word characters; ``~`` stands where a piece is cut off."""
    return [("~" if a else "") + word[a:b] + ("~" if b < len(word) else "") for a, b in cuts(word)]


def words_of(line: str) -> list[str]:
    found = WORD.findall(line)
    return found if all(len(w) <= WORD_CHARS for w in found) else [p for w in found for p in pieces(w)]


def features(word: str) -> set[str]:
    w = f"<{word}>".replace("<~", "").replace("~>", "")
    return {w} | {w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1)}


def passes(emission: np.ndarray, starts: np.ndarray, ends: np.ndarray, trans: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
    """The forward and the backward pass over the sequences ``emission[starts[i]:ends[i]]``, in log-odds of state 1;
    their sum is the log-odds of a token's marginal.

    ``trans[a, b]`` is the weight of a step from a to b, ``first`` the log-odds of beginning in state 1.
    """
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    starts, ends, size = starts[order], ends[order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences with a token at each step
    ahead = np.empty(len(emission))
    back = np.zeros(len(emission))
    for t in range(longest):
        at = starts[: active[t]] + t
        if t == 0:
            ahead[at] = emission[at] + first
        else:
            r = ahead[at - 1]
            ahead[at] = emission[at] + np.logaddexp(trans[0, 1], trans[1, 1] + r) - np.logaddexp(trans[0, 0], trans[1, 0] + r)
    for t in range(1, longest):
        at = ends[: active[t]] - 1 - t
        r = emission[at + 1] + back[at + 1]
        back[at] = np.logaddexp(trans[1, 0], trans[1, 1] + r) - np.logaddexp(trans[0, 0], trans[0, 1] + r)
    return ahead, back


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Field:
    """A fitted tagger with its document score."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    first: float
    score: np.ndarray
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def emission(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            get = self.weights.get
            got = self.known[word] = self.bias + sum(get(f, 0.0) for f in features(word.lower()))
        return got

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """Log-odds of each word (each piece of a long one) of each text; a line is a sequence."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        scores, breaks, bounds = [], [], [0]
        emission, known = self.emission, self.known
        for text in texts:
            for token in TOKEN.findall(text):
                if token == "\n":
                    breaks.append(len(scores))
                elif (got := known.get(token)) is not None:
                    scores.append(got)
                elif len(token) <= WORD_CHARS:
                    scores.append(emission(token))
                else:
                    scores += map(emission, pieces(token))
            breaks.append(len(scores))
            bounds.append(len(scores))
        ends = np.array(breaks, dtype=np.int64)
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        full = ends > starts
        odds = np.add(*passes(np.array(scores, dtype=np.float64), starts[full], ends[full], self.trans, self.first))
        return [odds[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def scores(self, odds: list[np.ndarray]) -> np.ndarray:
        """Document scores from the marginals of their words."""
        return sigmoid(summary(odds) @ self.score)


def summary(odds: list[np.ndarray]) -> np.ndarray:
    """Of each document: one, the largest marginal, and the expected number of toxic words, in all and per thousand."""
    p = [sigmoid(o) for o in odds]
    top = np.array([x.max() if len(x) else 0.0 for x in p])
    many = np.array([x[x >= 0.5].sum() for x in p])
    size = np.array([max(len(x), 1) for x in p])
    return np.stack([np.ones(len(p)), top, np.log1p(many), np.log1p(1000 * many / size)], axis=1)


def ascend(x: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    """Adam on a concave function."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x


def find_markers(docs: list[list[np.ndarray]], toxic: np.ndarray, of: list[np.ndarray], number: int) -> np.ndarray:
    """Which of ``number`` features mark toxic documents, given the lines of each document as word numbers and the words'
    feature numbers.

    A feature's support is the number of distinct contexts (word, word before, word after) that it has, so that copied
    passages count once.  Markers have support and are in no other document; and further those that each cover the most
    toxic documents not yet covered, if they are ``RATIO`` times as frequent there as elsewhere, or in at most one other
    document to fifty.
    """
    none = np.empty(0, np.int32)

    def held(d: int) -> np.ndarray:
        words = np.unique(np.concatenate(docs[d])) if docs[d] else none
        return np.unique(np.concatenate([of[w] for w in words])) if len(words) else none

    others = np.zeros(number, np.int64)
    for d in np.flatnonzero(~toxic):
        others[held(d)] += 1

    def supported(wanted: np.ndarray) -> tuple[np.ndarray, int]:
        lines = [np.r_[-1, line, -1] for d in np.flatnonzero(wanted) for line in docs[d]]
        if not lines:
            return np.zeros(number, np.int64), 0
        contexts = np.unique(np.concatenate([np.stack([x[1:-1], x[:-2], x[2:]], axis=1) for x in lines]), axis=0)
        support = np.zeros(number, np.int64)
        for w, n in zip(*(x.tolist() for x in np.unique(contexts[:, 0], return_counts=True)), strict=True):
            support[of[w]] += n
        return support, len(contexts)

    (support, total), (elsewhere, rest) = supported(toxic), supported(~toxic)
    enough = max(5, 0.02 * toxic.sum())
    frequent = (support >= enough) & (support * rest >= RATIO * (elsewhere + 0.5) * total)
    likely = frequent | (support >= 3) & (others * 50 <= support)
    found = [(f := held(d))[likely[f]] for d in np.flatnonzero(toxic)]
    feature = np.concatenate(found) if found else none
    doc = np.repeat(np.flatnonzero(toxic), [len(f) for f in found])
    order = np.argsort(feature, kind="stable")
    kind, first, size = np.unique(feature[order], return_index=True, return_counts=True)
    doc = doc[order]
    holders = {f: doc[i : i + n] for f, i, n in zip(kind.tolist(), first.tolist(), size.tolist(), strict=True) if n >= 3 and (frequent[f] or others[f] * 50 <= n)}
    markers, covered = (support >= enough) & (others == 0), np.zeros(len(docs), bool)
    for d in np.flatnonzero(toxic):
        covered[d] = markers[held(d)].any()
    while gain := {f: n for f, h in holders.items() if not markers[f] and (n := int((~covered[h]).sum())) >= 3}:
        # of those that cover as many, the one with the most support
        best = max(gain, key=lambda f: (gain[f], support[f], -f))
        markers[best] = True
        covered[holders[best]] = True
        holders = {f: holders[f] for f in gain}
    return markers


def fit(rows: Iterable[tuple[str, int]], rounds: int = 60) -> Field:
    """Fit a field to texts and their labels (0 or 1)."""
    rows = list(rows)
    ids: dict[str, int] = {}
    docs: list[list[np.ndarray]] = []
    for text, _ in rows:
        found = [[ids.setdefault(w.lower(), len(ids)) for w in words_of(line)] for line in text.split("\n")]
        docs.append([np.array(x, np.int32) for x in found if x])
    labels = np.array([y for _, y in rows], bool)
    base = labels.mean() if len(rows) else 0.0
    rest = Field({}, -8.0, np.zeros((2, 2)), -8.0, np.array([np.log(max(base, 1e-3) / max(1 - base, 1e-3)), 0.0, 0.0, 0.0]))
    if not ids or base in (0.0, 1.0):
        return rest
    numbers: dict[str, int] = {}
    # feature numbers and not strings for each word: the strings are held once
    of = [np.array([numbers.setdefault(f, len(numbers)) for f in sorted(features(w))], np.int32) for w in ids]
    markers = find_markers(docs, labels, of, len(numbers))
    marked = np.array([bool(markers[f].any()) for f in of])

    # sequences: all with a marked word, in documents of either class, and as many others again
    lines = [(line, y) for d, y in zip(docs, labels.tolist(), strict=True) for line in d]
    hit = np.array([bool(marked[line].any()) for line, _ in lines])
    if not hit.any():
        return rest
    plain = np.flatnonzero(~hit)
    chosen = np.r_[np.flatnonzero(hit), plain[:: max(1, len(plain) // max(2000, 2 * int(hit.sum())))]]
    flat = np.concatenate([lines[i][0] for i in chosen])
    truth = np.concatenate([marked[lines[i][0]] & lines[i][1] for i in chosen]).astype(float)
    ends = np.cumsum([len(lines[i][0]) for i in chosen])
    starts = np.r_[0, ends[:-1]]

    used, words = np.unique(flat), len(ids)
    feature = np.concatenate([of[w] for w in used])
    word = np.repeat(used, [len(of[w]) for w in used])
    wanted = (np.bincount(feature, minlength=len(numbers)) >= 2) | markers
    column = np.cumsum(wanted) - 1
    n = int(wanted.sum())
    word, feature = word[wanted[feature]], column[feature[wanted[feature]]]
    names = [f for f, k in numbers.items() if wanted[k]]
    inner = np.ones(len(flat), bool)
    inner[starts] = False
    before, after = np.flatnonzero(inner) - 1, np.flatnonzero(inner)
    steps = np.array([[np.sum((truth[before] == a) & (truth[after] == b)) for b in (0, 1)] for a in (0, 1)], dtype=float)

    def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        emission = x[n] + np.bincount(word, x[feature], minlength=words)
        return emission, np.array([[0.0, x[n + 1]], [0.0, x[n + 2]]]), x[n + 3]

    def gradient(x: np.ndarray) -> np.ndarray:
        emission, trans, first = unpack(x)
        e = emission[flat]
        ahead, back = passes(e, starts, ends, trans, first)
        odds = ahead + back
        off = truth - sigmoid(odds)
        by_word = np.bincount(flat, off, minlength=words)
        # the marginals of steps into state 1: that of the token before, times the step's own given what follows
        p1, r = sigmoid(odds[before]), (e + back)[after]
        to_one = [sigmoid(trans[a, 1] - trans[a, 0] + r) for a in (0, 1)]
        both = [np.sum((1 - p1) * to_one[0]), np.sum(p1 * to_one[1])]
        g = np.r_[np.bincount(feature, by_word[word], minlength=n), off.sum(), steps[0, 1] - both[0], steps[1, 1] - both[1], off[starts].sum()]
        return g / len(chosen) - 1e-4 * x

    x = ascend(np.r_[np.zeros(n), -2.0, 0.0, 0.0, 0.0], gradient, rounds, 0.2)
    _, trans, first = unpack(x)
    model = Field({f: float(x[k]) for k, f in enumerate(names) if abs(x[k]) > 1e-3}, float(x[n]), trans, float(first), rest.score)
    seen = np.concatenate([summary(model.tags(g)) for g in groups([t for t, _ in rows])])
    y = labels.astype(float)
    model.score = ascend(rest.score, lambda s: seen.T @ (y - sigmoid(seen @ s)) / len(y) - 1e-3 * np.r_[0, s[1:]], 400, 0.1)
    model.known.clear()
    return model


def remainder(key) -> object:
    return F.crc32(key.cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Field:
    """A field fitted to the bounded sample of labelled rows that aren't held out."""
    known = labels.where(F.col(label_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    texts = docs.where(F.octet_length(text_col) <= SAMPLE_BYTES).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # only ids are met here, before they are ranked, so that rows with longer texts take nobody's place
    known = stash(known.join(texts.select("_id"), "_id", "left_semi"), "labelled")
    rank = lambda y: known.where(F.col("_label") == y).orderBy(F.md5(F.col("_id").cast("string"))).limit(SAMPLE_ROWS)
    chosen = rank(1).unionByName(rank(0))
    # at most 2 * SAMPLE_ROWS ids are broadcast; repeated rows of an id count once
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    return fit([(r["_text"], int(r["_label"])) for r in sorted(sample, key=lambda r: r["_id"])])


def groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in turn, in groups of bounded size."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``, ``n_spans``, ``spans`` (start:end of
    each toxic word, or piece of a long one, as code points, comma-joined).

    ``held_out`` rows have an id whose CRC-32, as text, is a multiple of ``FOLDS``; their labels are not learnt from.
    Null labels are left out; an id with several labels is toxic if one of them is.  A null id is not held out, and
    never learnt from.  Null and empty texts are scored as texts without words; repeated rows score alike.  Without
    labels of both classes every row scores their share.  An empty table gives an empty result.  Columns other than
    id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            scores, spans, counts = [], [], []
            for texts in groups([t or "" for t in batch.column(1).to_pylist()]):
                odds = tagger.tags(texts)
                scores += tagger.scores(odds).tolist()
                for text, o in zip(texts, odds, strict=True):
                    at = set(np.flatnonzero(o >= 0).tolist())
                    tokens = ((m.start() + a, m.start() + b) for m in WORD.finditer(text) for a, b in cuts(m[0]))
                    found = [f"{a}:{b}" for k, (a, b) in enumerate(tokens) if k in at] if at else []
                    spans.append(",".join(found))
                    counts.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())],
                names=[id_col, "score", "predicted", "n_spans", "spans"],
            )

    scored = bounded_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_spans long, spans string")
    return scored.select(id_col, F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_spans", "spans")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.  Each row is judged by its own text:
    null and empty texts and null ids stay, and repeated rows stay or go alike."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            scores = np.concatenate([tagger.scores(tagger.tags(g)) for g in groups([t or "" for t in texts])] or [np.empty(0)])
            yield batch.filter(pa.array([not t or s < 0.5 for t, s in zip(texts, scores.tolist(), strict=True)], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
