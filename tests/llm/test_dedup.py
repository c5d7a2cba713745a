"""Exact, line and n-gram deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideloom.llm import common, exact_dedup, line_dedup, ngram_join

BLANKS = " \t\r\x0b\x0c"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, data, schema="doc_id long, text string"):
    return spark.createDataFrame(data, schema)


def exact_brute(data):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in data]
    groups = defaultdict(list)
    for (i, _), n in zip(data, norm):
        groups[n].append(i)
    out = []
    for (i, _), n in zip(data, norm):
        known = [x for x in groups[n] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


EXACT = [(3, "a  b\tc"), (1, "a b c"), (2, "a b c "), (9, None), (8, ""), (7, "\n"), (None, "a\nb c"), (None, "only"), (5, "é" * 9), (5, "é" * 9), (4, "x" * 200_000), (6, "x" * 200_000), (10, "A b c")]


def test_exact(spark):
    assert rows(exact_dedup.exact_dedup(frame(spark, EXACT))) == exact_brute(EXACT)


def test_exact_excludes_collisions(spark):
    weak = lambda c: F.lpad(F.hex(F.length(c) % 3), 32, "0")
    assert rows(exact_dedup.exact_dedup(frame(spark, EXACT), content_hash=weak)) == exact_brute(EXACT)


def units(line, unit):
    return re.split(r"[ \t\r\x0b\x0c]+", line) if unit == "words" else list(line)


def near(a, b, edits):
    """Whether the edit distance of two lists is within the bound, by the textbook's table."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1] <= edits


def lines_brute(data, unit="words", edits=1, least=None):
    least = (line_dedup.NEAR_WORDS if unit == "words" else line_dedup.NEAR_CHARS) if least is None else least
    first = {}
    place = lambda i, p: (i is None, i if i is not None else 0, p)
    for i, t in data:
        for p, line in enumerate((t or "").split("\n")):
            if k := line.strip(BLANKS):
                first[k] = min(first.get(k, (True, 10**9, 0)), place(i, p))
    gone = set()
    keys = [(k, u) for k in first if len(u := units(k, unit)) >= max(least, edits + 1)]
    for n, (x, a) in enumerate(keys):
        for y, b in keys[:n]:
            if edits and first[x] != first[y] and near(a, b, edits):
                gone.add(max(x, y, key=first.get))
    out = []
    for i, t in data:
        kept = [line for p, line in enumerate((t or "").split("\n")) if not (k := line.strip(BLANKS)) or k not in gone and first[k] == place(i, p)]
        out.append((i, None if t is None else "\n".join(kept)))
    return sorted(out, key=repr), len(gone)


def edited(rnd, s, letters):
    k, i = rnd.randrange(3), rnd.randrange(len(s) + 1)
    return s[:i] + [rnd.choice(letters)] + s[i:] if k == 0 else s[:i] + s[i + 1 :] if k == 1 else s[:i] + [rnd.choice(letters)] + s[i + 1 :]


@pytest.mark.parametrize(("unit", "edits", "least"), [("words", 1, None), ("words", 2, 5), ("chars", 1, None), ("chars", 2, 1), ("words", 0, None), ("words", 1, 1)])
def test_lines(spark, unit, edits, least):
    rnd = random.Random(3 + edits)
    letters = ["a", "b", "cd", "é"] if unit == "words" else list("ab cdé𝒳")
    sizes = [1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 25] if unit == "words" else [2, 5, 19, 20, 21, 31, 32, 33]
    base = [[rnd.choice(letters) for _ in range(rnd.choice(sizes))] for _ in range(25)]
    data = []
    for i in range(120):
        held = []
        for _ in range(rnd.randrange(0, 6)):
            s = rnd.choice(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 2, 3])):
                s = edited(rnd, s, letters)
            held.append(rnd.choice(["", "", " ", "\t"]) + (rnd.choice([" ", "  ", "\t"]) if unit == "words" else "").join(s))
        data.append((i if rnd.random() > 0.05 else None, "\n".join(held) if rnd.random() > 0.03 else None))
    long = ["word" + str(k % 7) for k in range(120)]
    data += data[:4] + [(500, " ".join(long)), (501, " ".join([*long[:60], "other", *long[61:]])), (502, ""), (503, "\n \n"), (504, " ".join(long[:-2]))]
    expected, gone = lines_brute(data, unit, edits, least)
    assert (gone > 20 or not edits) and rows(line_dedup.dedup_lines(frame(spark, data), unit=unit, edits=edits, least=least)) == expected


def test_very_long_lines(spark):
    rnd = random.Random(1)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(140_000)]  # a million characters
    texts = [" ".join(long), " ".join([*long[:99_999], "other", *long[100_000:]]), " ".join(long[1:]), " ".join([*long[:5], "x", *long[6:70_000], "y", *long[70_001:]]), "".join(long)]
    out = rows(line_dedup.dedup_lines(frame(spark, [(k, t + "\nend") for k, t in enumerate(texts)])))
    assert [t for _, t in out] == [texts[0] + "\nend", "", "", texts[3], texts[4]]


def test_lines_keep_columns(spark):
    schema = "_id long, _line string, doc_id long, text string, n_chars long, n_lines string"
    docs = frame(spark, [(1, "x", 1, "same words\nb", 12, "q"), (2, "y", 2, "same words\nc", 12, "q"), (3, None, 3, None, None, None)], schema)
    out = line_dedup.dedup_lines(docs, size_col="n_chars")
    assert out.columns == docs.columns
    assert rows(out) == [(1, "x", 1, "same words\nb", 12, "q"), (2, "y", 2, "c", 1, "q"), (3, None, 3, None, None, None)]
    counted = line_dedup.dedup_lines(docs.drop("n_lines"), counts=True).select("doc_id", "n_lines", "n_dropped")
    assert rows(counted) == [(1, 2, 0), (2, 2, 1), (3, 0, 0)]
    assert rows(line_dedup.dedup_lines(docs.limit(0))) == []


def join_brute(data, width, percent):
    sets = []
    for _, t in data:
        x = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(x[k : k + width]) for k in range(max(1, len(x) - width + 1))} if x else set())
    parent = list(range(len(data)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            where[g].append(i)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(data)), key=repr)


def similar(seed, number):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "Zß", "The"]
    base = [[rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 4, 5, 30, 60, 100, 200]))] for _ in range(12)]
    data = []
    for i in range(number):
        d = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
            if d:
                k = rnd.randrange(len(d))
                d[k : k + rnd.randrange(2)] = [rnd.choice(words) for _ in range(rnd.randrange(2))]
        data.append((i if rnd.random() > 0.03 else None, rnd.choice([" ", "\n", "\t "]).join(d) if rnd.random() > 0.02 else None))
    return data + data[:4]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, monkeypatch, width, percent):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 15)  # so that groups take several blocks
    data = similar(5, 240)
    docs = frame(spark, [(*r, "x") for r in data], "doc_id long, text string, node string").repartition(3)
    assert rows(ngram_join.ngram_join(docs, width, percent)) == join_brute(data, width, percent)


def test_ngram_join_of_nothing(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, " \n"), (None, None), (4, "one"), (5, "ONE "), (6, "two words")])
    assert rows(ngram_join.ngram_join(docs)) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None), (4, 1, 4), (5, 1, 4), (6, 1, 6)], key=repr)
    assert rows(ngram_join.ngram_join(docs.limit(0))) == []


def test_keep_one(spark):
    data = similar(6, 120)
    docs = frame(spark, data).withColumn("hash", F.lit(1))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    brute = join_brute(data, 5, 80)
    heads = {c for _, n, c in brute if n and c is not None}
    got = Counter(r.doc_id for r in kept.collect() if r.text and r.text.strip())
    assert {i for i in got if i is not None} == heads
    empty = sum(not (t or "").strip() for _, t in data)
    assert kept.where("text is null or trim(text) = ''").count() == empty


def test_without_broadcasts(spark, monkeypatch):
    """Tables beyond the bound are joined by a shuffle, with the same results."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = frame(spark, EXACT)
    assert rows(exact_dedup.exact_dedup(docs)) == exact_brute(EXACT)
    data = similar(8, 80)
    assert rows(ngram_join.ngram_join(frame(spark, data))) == join_brute(data, 4, 85)
    lines = [(i, f"a first line of words\nline {i // 2} of so many words is long enough to count {'!' * (i % 2)}\nx") for i in range(30)]
    assert lines_brute(lines)[1] >= 15 and rows(line_dedup.dedup_lines(frame(spark, lines))) == lines_brute(lines)[0]
    monkeypatch.setattr(common, "FILTER_SLOTS", 2)  # a filter that lets most rows pass
    assert rows(line_dedup.dedup_lines(frame(spark, lines))) == lines_brute(lines)[0]
    assert rows(exact_dedup.exact_dedup(docs)) == exact_brute(EXACT)


def test_many_near_copies_are_dealt_out_in_proportion(spark, monkeypatch):
    """Rows that are sent for a group of distinct near copies grow with it, not with its square."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 32)
    dealt = []
    monkeypatch.setattr(ngram_join, "gathered", lambda rows, payload, f=ngram_join.gathered: dealt.append(rows.count()) or f(rows, payload))
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    sent = []
    for number in (300, 1200):
        data = []
        for i in range(number):
            d = list(base)
            for _ in range(rnd.choice([1, 1, 2, 3])):
                d[rnd.randrange(150)] = f"x{rnd.randrange(10**6)}"
            data.append((i, " ".join(d)))
        dealt.clear()
        assert rows(ngram_join.ngram_join(frame(spark, data))) == join_brute(data, 4, 85)
        sent.append(sum(dealt))
    assert sent[1] < 1200 * (2 * ngram_join.ROUNDS + 4)


def test_ngram_join_of_very_long_texts(spark):
    rnd = random.Random(6)
    long = [f"w{rnd.randrange(50_000)}" for _ in range(200_000)]
    other = list(long)
    for _ in range(3000):
        other[rnd.randrange(200_000)] = "x"
    data = [(1, " ".join(other)), (2, " ".join(long)), (3, "word " * 100_000), (4, "word " * 5), (5, "x" * 500_000)]
    assert rows(ngram_join.ngram_join(frame(spark, data))) == join_brute(data, 4, 85)
