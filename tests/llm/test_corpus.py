"""WARC archives, benchmark decontamination, mixing, and the pipeline."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tideloom.llm import decontam, mixing, warc


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, data, schema="doc_id long, text string"):
    return spark.createDataFrame(data, schema)


PAGES = "page_id long, url string, html string"


def pages(number=60):
    rnd = random.Random(1)
    body = lambda: "<p>" + " ".join(rnd.choice(["über", "the", "page", "words", "\r\n\r\n"]) for _ in range(rnd.randrange(1, 80))) + "</p>"
    texts = [body() for _ in range(number // 2)]
    data = [(i, f"http://x/{i}?q=ü\n", rnd.choice(texts)) for i in range(number)]
    return data + [(900, None, None), (901, "u", ""), (None, "u", "z" * 150), (None, "u", texts[0]), (902, "u", "z" * 99), (903, "u", "z" * 99), (904, "u", "y" * 300_000), (905, "v", "y" * 300_000), (3, "again", data[3][2])]


def warc_brute(data):
    out = []
    for i, _, h in data:
        b = (h or "").encode()
        same = [j for j, _, g in data if (g or "") == (h or "") and j is not None]
        first = min(same) if len(b) >= 100 and same else i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=repr)


def test_warc_round_trip(spark):
    data = pages()
    frame_ = frame(spark, [(*r, "x") for r in data], PAGES + ", archive string").repartition(3)
    got = warc.round_trip(frame_).drop("target_uri")
    assert rows(got) == warc_brute(data)
    assert rows(warc.round_trip(frame(spark, data[:1], PAGES).limit(0))) == []


def test_warc_payloads_and_archives(spark, tmp_path):
    data = pages()
    warc.write_warc(frame(spark, data, PAGES), str(tmp_path / "w"), archive_bytes=2000)
    back = warc.read_warc(spark, str(tmp_path / "w"), with_payload=True).collect()
    stored = Counter(bytes(r.payload) for r in back if r.record_type == "response")
    assert set(stored) == {(h or "").encode() for *_, h in data}
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) > 3
    for f in files:  # other tools can read them: skippable frames are skipped
        archive = f.read_bytes()
        records = list(warc.frames(archive))
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + int.from_bytes(archive[4:8], "little")]) if archive[:4] == b"\x5d\x2a\x4d\x18" else None)
        assert b"".join(plain.stream_reader(archive, read_across_frames=True).read(-1) for _ in [0]) == b"".join(records)
        assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)


def test_warc_rejects_damage():
    record = warc.record("urn:page:1", "http://x", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "1970-01-01T00:00:00Z")
    coder = zstandard.ZstdCompressor(write_checksum=True)
    good = coder.compress(record)
    assert warc.parse(next(warc.frames(good)))[1] == b"payload"
    spoiled = [record[:-5], record.replace(b"payload", b"pay1oad"), record.replace(b"Content-Length: 7", b"Content-Length: 8"), record.replace(b"WARC-Date", b"WARC-Data"), record.replace(b"Type: response", b"Type: revisit", 1), record.replace(b"Payload-Digest", b"Block-Digest"), b"junk"]
    for bad in spoiled:
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad)
    for bad in (good[:-3], good + b"abc", b"\0" * 12, good + warc.leading_frame(b"d" * 9), warc.leading_frame(b"d" * 9)[:-2]):
        with pytest.raises(warc.ArchiveError):
            list(warc.frames(bad))
    assert len(list(warc.frames(good + warc.SEPARATOR.encode() + good))) == 2


def by_hand(kind, block, *more, version="1.0"):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{kind}>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_ordinary_archives(spark, tmp_path):
    """Frames without a content size, all types of records, digests of other kinds, replies without a length."""
    body = "grüße".encode() * 30
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    chunked = b"A\r\n" + body[:10] + b"\r\n%x;x=1\r\n" % (len(body) - 10) + body[10:] + b"\r\n0\r\n\r\n"
    message = ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}"]
    records = [
        by_hand("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", "WARC-Filename: a.warc.zst"),
        by_hand("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: <http://x/>"),
        by_hand("response", b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\n" + body, *message, "WARC-Target-URI: http://x/ü"),
        by_hand("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked, *message, version="1.1"),
        by_hand("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body, *message),
        by_hand("resource", body, "Content-Type: text/html", f"WARC-Block-Digest: sha1:{sha1}"),
        by_hand("metadata", b"fetchTimeMs: 4\r\n", "Content-Type: application/warc-fields", "WARC-Payload-Digest: crc9:77"),
        by_hand("revisit", b"HTTP/1.1 304 Not Modified\r\nServer: y\r\n\r\n", *message, "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified"),
        by_hand("conversion", body, "Content-Type: text/plain", "WARC-Refers-To: <urn:x:response>"),
        by_hand("own-kind", b"anything"),
    ]
    streamed = []
    for r in records:  # as a stream is compressed, whose length isn't known ahead
        coder = zstandard.ZstdCompressor(write_content_size=False).compressobj()
        streamed.append(coder.compress(r) + coder.flush())
    assert all(zstandard.get_frame_parameters(f).content_size in (0, 2**64 - 1) for f in streamed)
    (tmp_path / "a.warc.zst").write_bytes(b"".join(streamed))
    got = {(r.record_type, k): r for k, r in enumerate(warc.read_warc(spark, str(tmp_path), with_payload=True).collect())}
    assert [k for k, _ in sorted(got, key=lambda x: x[1])] == ["warcinfo", "request", "response", "response", "response", "resource", "metadata", "revisit", "conversion", "own-kind"]
    by = [got[k] for k in sorted(got, key=lambda x: x[1])]
    assert [bytes(by[k].payload) for k in (2, 3, 4, 5, 8)] == [body] * 5 and {by[k].payload_digest for k in (2, 3, 4, 5, 8)} == {hashlib.sha256(body).hexdigest()}
    assert by[1].target_uri == "http://x/" and by[2].target_uri == "http://x/ü" and by[1].payload_bytes == 0
    assert by[7].payload is None and by[7].payload_digest == f"sha1:{sha1}" and by[7].payload_bytes is None and by[8].refers_to == "urn:x:response"
    assert by[9].payload is None
    for bad in (records[2].replace(body, body[:-1] + b"x"), records[5].replace(body, body[:-1] + b"x"), records[7].replace(b"WARC-Profile", b"X-Profile")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad)


def test_warc_names(spark):
    """Ids of any string, and addresses as they were."""
    ids = ["", "a b", "x/y?z", "ü+%2F", None, " padded ", "urn:page:", "1\n2"]
    data = [(i, u, "p" * 200 if k < 3 else f"page {k}") for k, (i, u) in enumerate(zip(ids, ["http://x/a b", "http://x/%20?q=ü", "", None, "http://x/<y>", "plain", "é", "x"]))]
    out = {r.page_id: r for r in warc.round_trip(frame(spark, data, "page_id string, url string, html string")).collect()}
    assert set(out) == set(ids) and all(out[i].target_uri == u for i, u, _ in data)
    assert [out[i].refers_to for i in ids[:4]] == [None, "", "", None] and [out[i].record_type for i in ids[:4]] == ["response", "revisit", "revisit", "response"]


def bm25_brute(items):
    """Of all items: their chunks, as (item, {word: part of the chunk's own BM25 score}), by the formula as it is written
    in textbooks; not by way of the operator."""
    chunks = []
    for key, text in items:
        words = re.sub(r"[^a-z0-9\u0080-\U0010ffff]", " ", text.lower()).split()
        begins = list(range(0, len(words), 64))
        for b in begins:
            chunks.append((key, words[-64:] if b and len(words) - b < 32 else words[b : b + 64]))
    mean = sum(len(c) for _, c in chunks) / max(len(chunks), 1)
    out = []
    for key, c in chunks:
        score = {}
        for w in set(c):
            df = sum(w in o for _, o in chunks)
            tf = c.count(w)
            score[w] = math.log(1 + (len(chunks) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(c) / mean))
        out.append((key, {w: x / sum(score.values()) for w, x in score.items()}))
    return out


def retrieved_brute(chunks, text):
    words = re.sub(r"[^a-z0-9\u0080-\U0010ffff]", " ", text.lower()).split()
    passages = [set(words[b : b + 64]) for b in range(0, max(len(words), 1), 32)]
    return {key for key, score in chunks if any(sum(x for w, x in score.items() if w in p) >= 0.3 - 1e-9 for p in passages)}


def covered_brute(part, text):
    """Whether 0.8 of a part's 5-grams are in a text, or of its words in order within a passage."""
    part, words = decontam.words_of(part), decontam.words_of(text)
    if not part:
        return True
    n = min(5, len(part))
    wanted = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}
    held = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    return len(wanted & held) >= 0.8 * len(wanted) or decontam.in_order(part, words, 1) >= 0.8 * len(part) - 1e-9


def leaks_brute(items, chunks, text):
    out = []
    for key in retrieved_brute(chunks, text or ""):
        item = next(t for i, t in items if i == key)
        told = (key, *decontam.parts(item))
        q, a = decontam.overlaps(told, {}, decontam.words_of(text))
        if q >= decontam.OVERLAP and a >= decontam.OVERLAP:
            out.append(str(key))
        if min(len(told[1]), len(told[2])) >= decontam.SHORT:
            assert (q >= 0.8 and a >= 0.8) == all(covered_brute(" ".join(w.decode() for w in p), text) for p in told[1:])
    return sorted(out)


def test_decontamination(spark):
    rnd = random.Random(9)
    words = [f"{a}{b}" for a in ("an", "the", "or", "st", "qu") for b in ("ing", "ed", "er", "ion", "a", "")]
    prose = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", ".", ","]) for _ in range(n))
    items = [(i, prose(rnd.choice([3, 12, 30, 60, 150]))) for i in range(30)]
    data = []
    for i in range(80):
        text = prose(rnd.choice([0, 5, 40, 300]))
        if rnd.random() < 0.5:
            leak = rnd.choice(items)[1].split()
            leak = leak[rnd.randrange(3) * (rnd.random() < 0.5) :]
            for _ in range(rnd.randrange(3)):
                leak[rnd.randrange(len(leak))] = rnd.choice(words).upper() if leak else ""
            at = rnd.randrange(len(text.split()) + 1)
            text = " ".join(text.split()[:at] + leak + text.split()[at:])
        data.append((i, text))
    data += [(None, items[4][1]), (900, None), (901, ""), (902, (prose(200) + " ") * 20 + items[3][1].upper()), (0, data[0][1])]
    benchmark = frame(spark, items + [(99, None), (98, "")], "item_id long, text string")
    docs = frame(spark, [(*r, True) for r in data], "doc_id long, text string, contaminated boolean")
    out = decontam.find_leaks(docs, benchmark)
    got = sorted(((r.doc_id, r.contaminated, r.n_items, sorted(filter(None, r["items"].split(",")))) for r in out.collect()), key=repr)
    chunks = bm25_brute(items)
    expected = sorted(((i, bool(x := leaks_brute(items, chunks, t)), len(x), x) for i, t in data), key=repr)
    assert got == expected and sum(g[1] for g in got) > 15
    assert decontam.drop_leaks(docs, benchmark).count() == sum(not g[1] for g in got)
    assert decontam.drop_leaks(docs, benchmark).columns == docs.columns
    assert decontam.find_leaks(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontam.find_leaks(docs.limit(0), benchmark).count() == 0


def test_edited_leaks(spark):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice(["an", "the", "or", "st", "qu", "in", "es", "at"]) for _ in range(rnd.randrange(2, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"{prose(rnd.choice([10, 16, 30]))}. {prose(rnd.choice([1, 3, 5, 12]))}.") for i in range(40)]
    data, expected = [], []
    for i, item in items:
        for edits in (1, 2):
            leak = item.split()
            for k in rnd.sample(range(len(leak)), edits if len(leak) >= 15 else 1):
                leak[k] = f"changed{k}"
            data.append((len(data), f"{prose(50)} {' '.join(leak)} {prose(60)}"))
            expected.append(str(i))
    # the question without a short last sentence; and the words of an item out of order, or far apart
    alone = next((i, t) for i, t in items if len(decontam.words_of(t.split(". ")[1])) == 1)
    data.append((len(data), f"{prose(40)} {alone[1].split('. ')[0]} {prose(40)}"))
    expected.append(str(alone[0]))
    mixed, apart = items[0][1].split(), " ".join(f"{w} {prose(6)}" for w in items[1][1].split())
    rnd.shuffle(mixed)
    data += [(len(data), " ".join(mixed)), (len(data) + 1, apart), (len(data) + 2, prose(5000))]
    expected += ["", "", ""]
    out = decontam.find_leaks(frame(spark, data), frame(spark, items, "item_id long, text string"))
    assert sorted((r.doc_id, r["items"]) for r in out.collect()) == list(enumerate(expected))


def test_words_in_order():
    rnd = random.Random(2)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(300):
        part, words = ([rnd.choice(b"abcdef") for _ in range(rnd.randrange(n))] for n in (20, 60))
        wide = len(part) + len(part) // 4
        windows = lambda size: max((common(part, words[k : k + size]) for k in range(max(len(words) - size, 0) + 1)), default=0)
        got = decontam.in_order(part, words, 1)
        assert windows(wide) <= got <= windows(wide + max(1, len(part) // 4))
        assert decontam.in_order(part, words, got) == got and decontam.in_order(part, words, got + 1) == 0


def shared_vocabulary(seed, items, passages):
    rnd = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("an", "the", "or", "st", "qu", "in", "es") for b in ("ing", "ed", "er", "ion", "a", "", "ly", "um") for c in ("", "o", "is", "ta")]
    weight = [1 / (k + 1) for k in range(len(words))]
    prose = lambda n: rnd.choices(words, weight, k=n)
    own = [(i, " ".join(prose(rnd.choice([12, 30, 60, 150])))) for i in range(items)]
    data = []
    for i in range(passages):
        leak = rnd.choice(own)[1].split()
        begin = rnd.randrange(len(leak))
        data.append((i, " ".join(prose(rnd.randrange(60)) + leak[begin : begin + rnd.randrange(len(leak))] + prose(rnd.randrange(60)))))
    return own, data


def test_retrieval_against_bm25():
    items, data = shared_vocabulary(4, 60, 150)
    chunks = bm25_brute(items)
    expected = [retrieved_brute(chunks, t) for _, t in data]
    assert 100 < sum(map(len, expected)) < 6000
    for block in (1, 4, 32):
        decontam.BLOCK, held = block, decontam.BLOCK
        try:
            told = decontam.statistics([t for _, t in items])
            for parts in (1, 4):  # slices of the items, with statistics of all
                got = [set() for _ in data]
                for k in range(parts):
                    index = decontam.build(items[k::parts], told)
                    for mine, found in zip(got, decontam.retrieved(index, [decontam.words_of(t) for _, t in data])):
                        mine |= {index.items[i][0] for i in found}
                assert got == expected
        finally:
            decontam.BLOCK = held


def test_results_do_not_depend_on_slices(spark, monkeypatch):
    items, data = shared_vocabulary(7, 40, 60)
    data += [(100 + i, "start " + t + " end") for i, t in items] + [(None, items[0][1]), (100, "start " + items[0][1] + " end"), (99, None)]
    docs, benchmark = frame(spark, data), frame(spark, items + items[:3], "item_id long, text string")
    whole = rows(decontam.find_leaks(docs, benchmark))
    assert sum(r[1] for r in whole) >= 41
    seen = []
    monkeypatch.setattr(decontam, "INDEX_CHARS", 3000)
    monkeypatch.setattr(decontam, "build", lambda *a, f=decontam.build: seen.append(a) or f(*a))
    assert rows(decontam.find_leaks(docs, benchmark)) == whole and len(seen) >= 3
    assert max(sum(len(t) for _, t in a[0]) for a in seen) < sum(len(t) for _, t in items) / 2
    assert sorted(rows(decontam.drop_leaks(docs, benchmark)), key=repr) == sorted(((i, t) for i, t in data if (i, t) not in {(j, dict(data).get(j) if j is not None else items[0][1]) for j, c, *_ in whole if c}), key=repr)


def test_mixing(spark):
    data = [(i, f"t{i}", "big" if i < 3000 else "small" if i < 3400 else None) for i in range(3500)] + [(3500, None, "small"), (None, "n", "small")]
    docs = frame(spark, [(*r, 1) for r in data], "doc_id long, text string, source string, copy int")
    weights = frame(spark, [("big", 1.0), ("small", 3.0), (None, 1.0), ("absent", 9.0)], "source string, weight double")
    out = mixing.mix_sources(docs, weights, rows=5000)
    share = Counter(r.source for r in out.collect())
    for source, part in (("big", 1000), ("small", 3000), (None, 1000)):
        assert abs(share[source] - part) < 5 * part**0.5 * 1.5
    again = mixing.mix_sources(docs.repartition(7), weights, rows=5000)
    assert rows(out) == rows(again) and out.columns == docs.columns
    per = Counter(r.doc_id for r in out.collect())
    assert all(sorted(r["copy"] for r in g) == list(range(len(g))) for g in _grouped(out, per))
    only = mixing.mix_sources(docs, frame(spark, [("small", 1.0), ("big", None)], "source string, weight double"))
    assert {r.source for r in only.select("source").distinct().collect()} == {"small"}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, copy_col=None).columns == docs.columns


def _grouped(out, per):
    held = {}
    for r in out.collect():
        held.setdefault(r.doc_id, []).append(r)
    return [held[k] for k in per]


def poisson_brute(rate, at):
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if total >= at or k > rate + 12 * rate**0.5 + 20:
            return k
        k += 1


def test_poisson_inverse(spark):
    rnd = random.Random(3)
    data = [(rate, rnd.random()) for rate in (0.01, 0.7, 5.0, 300.0, 2000.0) for _ in range(40)] + [(0.5, 0.0)]
    out = frame(spark, data, "rate double, at double").select("rate", "at", mixing.poisson_inverse(F.col("rate"), F.col("at")).alias("k")).collect()
    assert [r.k for r in out] == [poisson_brute(r.rate, r["at"]) for r in out]


def test_mixing_of_rare_sources_and_null_ids(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("a").alias("source"))
    docs = docs.unionByName(frame(spark, [(7, "rare", "b"), (7, "rare", "b"), (8, None, "b")], "doc_id long, text string, source string"))
    weights = frame(spark, [("a", 1.0), ("b", 9.0)], "source string, weight double")
    out = mixing.mix_sources(docs, weights, rows=1_000_000).cache()
    assert abs(out.where("source = 'a'").count() - 100_000) < 2000
    assert abs(out.where("source = 'a'").select("text").distinct().count() - 63_212) < 1000  # 1 - 1/e of them
    rare = {(r.doc_id, r.text): (r["count"], r.top, r.kinds) for r in out.where("source = 'b'").groupBy("doc_id", "text").agg(F.count("*").alias("count"), F.max("copy").alias("top"), F.count_distinct("copy").alias("kinds")).collect()}
    assert rare[7, "rare"][0] % 2 == 0 and rare[7, "rare"][1] + 1 == rare[7, "rare"][2] == rare[7, "rare"][0] // 2
    assert rare[8, None][1] + 1 == rare[8, None][2] == rare[8, None][0]
    assert all(abs(n - 300_000) < 5000 for n in (rare[8, None][0], rare[7, "rare"][0] // 2))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)


def test_pipeline(spark, tmp_path):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice(["an", "the", "or", "in", "es", "ion", "at", "re"]) for _ in range(rnd.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(40)
    data, labels = [], []
    for i in range(400):
        text = "\n".join(prose(rnd.randrange(8, 40)) for _ in range(rnd.randrange(1, 5)))
        toxic = i % 4 == 0
        if toxic:
            text += " grumpf " + prose(5) + " grumpf"
        data.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, 1, int(toxic)))
    data[1][1] += " " + item
    data[2][1] = data[5][1].rpartition(" ")[0] + " " + prose(1)
    data[6][1] += "\n" + data[7][1].split("\n")[0]
    data += [[1000, None, "en", "s0", None], [1001, "", "en", "s1", 0]]
    for r in data:
        r[4] = None if r[1] is None else len(r[1])
    frame(spark, data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()})
    toxic, lines, similar, leaks, mixed = kept
    assert not [i for i in toxic if i % 4 == 0 and i < 1000] and len(toxic) == 302
    assert lines[7].text.split("\n") == data[7][1].split("\n")[1:] or 7 not in lines
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.values())
    assert 1 in similar and 1 not in leaks and len(leaks) == len(similar) - 1
    assert {1000, 1001} <= set(leaks)
    assert set(mixed) <= set(leaks)
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == rows(docs)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, nulls in any column, very long texts, ties, and columns whose names operators use."""
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choice(["an", "the", "or", "in", "es"]) for _ in range(3)) for _ in range(n))
    item, twice, long = prose(40), prose(30), prose(60_000)
    texts = [(1, twice), (1, twice), (2, twice + "\nand " + prose(12)), (None, prose(20)), (None, None), (None, ""), (3, None), (4, long), (5, "x" * 300_000), (6, prose(25) + " " + item), (7, " \n\t"), (8, "short"), (9, "short")]
    more = "_id string, _key int, _text string, node long, size int, __hash int, source string, lang string, n_chars long"
    data = [(i, t, "x", k % 2, None, k, 1, 2, None if k % 3 else "s", None, None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    schema = f"doc_id long, text string, {more}"
    frame(spark, [(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, [(k, 1, None if k % 2 else k % 3 == 0) for k in range(6)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int")).write.parquet(str(tmp_path / "labels.parquet"))
    for rows_ in (data, []):
        docs = frame(spark, rows_, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")] + ["copy"] * (k == 4)
            path = str(tmp_path / f"{name}-{len(rows_)}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            held = Counter((r.doc_id, r.text and r.text[:9]) for r in docs.collect())
            if not rows_:
                assert not held
            elif k < 4:
                assert held[None, None] == held[None, ""] == held[3, None] == 1 and held[7, " \n\t"] == 1 and held[4, long[:9]] == 1
                assert sum(n for (i, _), n in held.items() if i == 1) == 2 and held[8, "short"] == 1
                assert held[9, "short"] == (1 if k == 0 else 0) and held[6, data[9][1][:9]] == (k < 3)
