"""Token counts of whole texts under a byte-level BPE vocabulary with word ends.

Texts are cut into pre-tokens, and the pre-tokens that a worker has not met before are merged together: all their
symbols lie in one flat array with row offsets, and each step applies to every sequence its own pair of lowest rank, at
all places at once.  The number of symbols that survive is the number of tokens.  A very long pre-token takes many steps,
so it is merged by itself, with the places of each rank held ready: a step ranks anew only the neighbours of the pairs
that it merged.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import bounded_batches

#: Letters and digits that were added to Unicode so late that the two regular-expression libraries may class them
#: differently.  Texts with one of them are cut by the vocabulary's own library.
LATE = regex.compile(r"[[\U00010000-\U0010FFFF]&&[\p{L}\p{N}\p{Cn}]]|[\u0870-\u08ff\u1c80-\u1c8f\ua7c0-\ua7ff]", regex.V1)

#: A worker forgets its counts of pre-tokens beyond this many; those of more characters than ``LONG`` are merged alone, and
#: not kept.
CACHE_WORDS, LONG = 300_000, 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Counts tokens as the vocabulary file's library does, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.inner = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in byte_symbols()], dtype=np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.never = np.int64(len(pairs))
        self.pairs = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.mark = commonprefix(special)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"], regex.V0).findall
        self.known: dict[str, int] = {}

    def merged(self, words: list[str]) -> np.ndarray:
        """The number of symbols that survive in each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(len(raw)), sizes)
        symbols = self.inner[flat]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[flat[last]]
        count = sizes.copy()
        while len(symbols) > 1:
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            inside = row[:-1] == row[1:]
            rank = np.where(inside & (self.keys[at] == key), self.ranks[at], self.never)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, self.never], starts)
            live = lowest < self.never
            if not live.any():
                break
            spans = np.diff(np.r_[starts, len(row)])
            hit = (np.r_[rank, self.never] == np.repeat(lowest, spans)) & np.repeat(live, spans)
            # in a run of overlapping hits (three equal symbols), every second one applies
            place = np.arange(len(hit))
            opens = hit & ~np.r_[False, hit[:-1]]
            since = place - np.maximum.accumulate(np.where(opens, place, 0))
            hit &= since % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = self.made[rank[where]]
            keep = ~np.r_[False, hit[:-1]] & np.repeat(live, spans)  # finished words leave the arrays
            np.subtract.at(count, row[where], 1)
            symbols, row = symbols[keep], row[keep]
        return count

    def merged_alone(self, word: str) -> int:
        """The number of symbols that survive in a word, however long."""
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner.tolist()
        symbol = [inner[b] for b in raw[:-1]] + [int(self.final[raw[-1]])]
        end, find = len(symbol), self.pairs.get
        after, before = [*range(1, end + 1)], [*range(-1, end - 1)]
        rank = [-1] * end  # of the pair that begins at each place; -1 for none, or a symbol that is gone
        places: dict[int, list[int]] = {}
        ranks: list[int] = []

        def note(k: int) -> None:
            got = find((symbol[k], symbol[after[k]])) if after[k] < end else None
            rank[k] = got[0] if got else -1
            if got:
                if got[0] not in places:
                    heappush(ranks, got[0])
                    places[got[0]] = []
                places[got[0]].append(k)

        for k in range(end):
            note(k)
        count = end
        while ranks:
            lowest = heappop(ranks)
            touched: list[int] = []
            for k in sorted(set(places.pop(lowest))):
                if rank[k] != lowest:  # gone, or merged with its neighbour meanwhile
                    continue
                gone = after[k]
                symbol[k] = find((symbol[k], symbol[gone]))[1]
                after[k] = after[gone]
                if after[k] < end:
                    before[after[k]] = k
                rank[gone] = rank[k] = -1
                if before[k] >= 0:
                    rank[before[k]] = -1
                    touched.append(before[k])
                touched.append(k)
                count -= 1
            for k in set(touched):
                if before[k] < 0 or after[before[k]] == k:  # still there
                    note(k)
        return count

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and the number of special strings in it."""
        parts = self.special.split(text) if self.special and self.mark in text else [text]
        words: list[str] = []
        for part in parts:
            if not part.isascii() and LATE.search(part):
                self.library = self.library or Tokenizer.from_file(self.path)
                plain = self.library.normalizer.normalize_str(part)
                words += [plain[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            else:
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                words += self.find(plain)
        return words, len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; pre-tokens are merged in groups of texts of bounded size."""
        out: list[int] = []
        held: list[tuple[list[str], int]] = []
        size = 0
        for k, text in enumerate(texts):
            held.append(self.pieces(text))
            size += len(text)
            if size >= 2_000_000 or k == len(texts) - 1:
                known = self.known
                if len(known) > CACHE_WORDS:
                    known.clear()
                new = list({w for words, _ in held for w in words if w not in known})
                short = [w for w in new if len(w) <= LONG]
                for i in range(0, len(short), 100_000):
                    part = short[i : i + 100_000]
                    known.update(zip(part, self.merged(part).tolist(), strict=True))
                alone = [w for w in new if len(w) > LONG]
                known.update((w, self.merged_alone(w)) for w in alone)
                out += [sum(map(known.__getitem__, words)) + n for words, n in held]
                for w in alone:
                    del known[w]
                held, size = [], 0
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` of UTF-8, ``n_tokens``, ``over_limit`` (more than ``limit``).

    ``vocabulary`` is a path that every executor can open.  Null and empty texts have 0 bytes and 0 tokens; a null id
    stays null; repeated rows each give a row; an empty table gives an empty result.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = bpe.counts(texts)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return bounded_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
