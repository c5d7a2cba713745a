"""Licence scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

A licence stands somewhere in a text: alone, within a line, or wrapped over many lines of a file, behind comment marks.
So a template is compared with runs of words, wherever they begin.  Words are cut from the whole text, without regard
to lines, and what is not a letter or digit (comment marks, quotes, borders of boxes) only separates them.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from .license_texts import TEMPLATES

#: Words: runs of ASCII letters and digits, with dots and hyphens between them.
WORDS = r"[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?"


def words_of(text: str) -> list[str]:
    """Words of a normalised text: in lower case, runs of ASCII letters, digits, and dots and hyphens between them."""
    cut = "".join(c if c.isalnum() and c.isascii() or c in ".-" else " " for c in text.lower())
    return [w for w in (x.strip(".-") for x in cut.split()) if w]


def bigrams_of(text: str) -> set[str]:
    w = words_of(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def words_column(text: Column) -> Column:
    """The same as ``words_of`` in Spark."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def telling_words(grams: list[str], threshold: float) -> list[str]:
    """Words of which every text that matches these bigrams has one.

    A match holds more than t / (2-t) of the template's bigrams, so the words of any larger part than the rest of them
    will do; long words are taken first.
    """
    left, missing = set(grams), len(grams) - ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
    chosen = []
    for word in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w)):
        if len(grams) - len(left) > missing:
            break
        chosen.append(word)
        left = {g for g in left if word not in g.split(" ")}
    return chosen


def bounds(size: int, threshold: float) -> tuple[float, int]:
    """How many more bigrams than ``size`` a run may have (a factor), and how many of them that is at most."""
    high = (2 - threshold) / threshold + 1e-9
    return high, int(size * high)


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``license`` (of the best match; ties go to the template listed first),
    ``dice`` of that match, ``n_matches`` templates that match, ``licenses`` (all found, sorted, comma-joined).

    A run is any number of consecutive words, at least as many as the template has distinct bigrams (or the whole text, if
    that has fewer).  A template matches if a run has a Dice coefficient with it of ``threshold``: twice the distinct
    bigrams of the template that are in the run, by the number of the template's and of the run's bigrams; in a run,
    repeated ones count each time.  The sizes bound which runs are tried: those beyond (2-t)/t times the template's size
    can't match, nor can those without a word of which every match has one (``telling_words``), nor runs with too few of
    its bigrams so near to each other.  It is enough to try runs from one of its bigrams to another.

    Null and empty texts match nothing (null ``license``, ``dice`` 0); null and repeated ids keep their rows; an empty
    table gives an empty result; other columns are not read.  All work is within the row.
    """
    known = []
    for rank, (name, text) in enumerate(templates):
        if grams := sorted(bigrams_of(text)):
            known.append(F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("size"), F.lit(bounds(len(grams), threshold)[1]).alias("most"), F.array(*map(F.lit, telling_words(grams, threshold))).alias("hints")))
    hints = sorted({w for _, text in templates if (g := sorted(bigrams_of(text))) for w in telling_words(g, threshold)})

    rows = docs.select(F.col(id_col).alias("_id"), words_column(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"))
    rows = rows.withColumn("_told", F.array_intersect("_words", F.array(*map(F.lit, hints))))
    rows = rows.withColumn("_known", F.when(F.size("_told") > 0, F.filter(F.array(*known), lambda t: F.arrays_overlap(t["hints"], F.col("_told")))))
    pairs = F.zip_with(F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))), F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.withColumn("_pairs", F.when(F.size("_known") > 0, pairs))
    number = F.size("_pairs")

    def best(t: Column, places: Column) -> Column:
        """The largest coefficient of runs from one of the ``places`` to another."""
        least = F.least(t["size"], number)
        needed = F.ceil(F.lit(threshold) * (least + t["size"]) / 2 - 1e-9).cast("int")
        dense = F.filter(F.sequence(F.lit(1), F.size(places)), lambda k: F.coalesce(F.get(places, k + needed - 2) - F.get(places, k - 1) < t["most"], F.lit(False)))

        def run(k: Column) -> Column:
            near = F.filter(F.slice(places, k, t["most"]), lambda p: p - F.get(places, k - 1) < t["most"])
            return F.transform(F.array(F.struct(near.alias("near"), F.transform(near, lambda p: F.get(F.col("_pairs"), p)).alias("grams"))), scores)[0]

        def scores(r: Column) -> Column:
            first = F.transform(r["grams"], lambda g, e: F.struct(F.get(r["near"], e).alias("at"), (F.array_position(r["grams"], g) == e + 1).alias("new")))
            start = F.struct(F.lit(0).alias("both"), F.lit(0.0).alias("top"))

            def step(acc: Column, x: Column) -> Column:
                both = acc["both"] + x["new"].cast("int")
                return F.struct(both.alias("both"), F.greatest(acc["top"], 2 * both / (F.greatest(x["at"] - F.get(r["near"], F.lit(0)) + 1, least) + t["size"])).alias("top"))

            return F.aggregate(first, start, step)["top"]

        return F.array_max(F.transform(dense, run))

    def match(t: Column) -> Column:
        places = F.filter(F.transform(F.col("_pairs"), lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())
        # one-element transforms bind a value to a name, so that it is worked out once
        top = F.transform(F.array(places), lambda p: F.when(F.size(p) > 0, best(t, p)))[0]
        return F.struct(top.alias("dice"), (-t["rank"]).alias("order"), t["name"].alias("name"))

    found = F.filter(F.transform("_known", match), lambda m: m["dice"] >= threshold)
    rows = rows.select("_id", F.coalesce(F.when(number > 0, found), F.array().cast("array<struct<dice:double,order:int,name:string>>")).alias("_found"))
    top = F.array_max("_found")
    return rows.select(
        F.col("_id").alias(id_col),
        top["name"].alias("license"),
        F.coalesce(top["dice"], F.lit(0.0)).alias("dice"),
        F.size("_found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["name"]))), ",").alias("licenses"),
    )
