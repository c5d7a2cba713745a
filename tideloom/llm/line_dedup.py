"""Line deduplication: a line goes if an equal one, or one within the edit bound, stands earlier in the corpus.

Near lines are found by their deletion neighbourhoods over words (or characters).  With a bound of one edit, a line emits
a hashed key for each of its gaps, the places where a word may have been inserted, deleted or replaced: what is left of
the line if that word is taken out, and the line itself with the gap between two words; with a bound of two, for each
pair of gaps.  The gaps' places are part of a key.  So two lines have an equal key exactly if they are within the bound,
and all lines of a key are near to each other: it is enough to know the earliest of each key, and no pairs of a key's
lines are made.

Keys are emitted only where a partner may be.  What is left of a line is cut into segments, and the edits fall into one
of them for each edit.  A line that shares with no other line all the rest but those segments has no partner by edits
there.  That is asked twice, of few large segments of every line, and of as many as the root of the length of the lines
that are left; only the gaps in the segments in question give keys.  Nothing is lost by that, and a line of n words with
one edit costs the power 1.5 of n at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import lookup, meet, row_key, stash

#: How lines are cut: into words at white space, or into characters.
UNITS = ("words", "chars")
#: Lines of fewer words, or characters, must be equal to count as repeated: an edit makes another line of them.
NEAR_WORDS, NEAR_CHARS = 8, 20


def _trimmed(line: Column) -> Column:
    blanks = " \t\r\x0b\x0c"
    framed = reduce(Column.__or__, [c for b in blanks for c in (F.startswith(line, F.lit(b)), F.endswith(line, F.lit(b)))])
    return F.when(framed, F.trim(line, F.lit(blanks))).otherwise(line)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines that are not blank: ``_id``, ``_key`` of the row, ``_pos``, ``_line`` (trimmed)."""
    # the key is worked out below the explode, once for a row
    rows = docs.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    rows = rows.select("_id", "_key", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_raw"))
    return rows.select("_id", "_key", "_pos", _trimmed(F.col("_raw")).alias("_line")).where("_line <> ''")


def _order() -> Column:
    """Where a line stands in the corpus; null ids come last."""
    return F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_pos").alias("pos"))


def units_of(line: Column, unit: str) -> Column:
    return F.split(line, r"[ \t\r\x0b\x0c]+", -1) if unit == "words" else F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def _part(units: Column, begin: Column, end: Column) -> Column:
    """``units`` from ``begin`` up to ``end``, counted from 0."""
    return F.slice(units, begin + 1, F.greatest(end - begin, F.lit(0)))


def _shapes(edits: int) -> list[tuple[int, int]]:
    """Whether a line has a unit in its first and in its second gap; with one edit there is no second gap."""
    return [(a, c) for a in (0, 1) for c in ((0, 1) if edits == 2 else (0,))]


def _rest(units: Column, size: Column, many: Column, i: Column, j: Column, a: int, c: int, edits: int) -> Column:
    """A hash of what is left of a line, less its segments ``i`` and ``j``, if it has ``a`` and ``c`` units in the gaps
    there."""
    length = size - F.lit(a + c)
    bound = lambda k: F.floor(k * length / many).cast("int")
    parts = [length, i, j, _part(units, F.lit(0), bound(i)), _part(units, bound(j + 1) + F.lit(a + c), size)]
    if edits == 2:
        parts.append(_part(units, bound(i + 1) + F.lit(a), F.when(i < j, bound(j) + F.lit(a)).otherwise(0)))
    return F.xxhash64(*parts)


def spaced(line: Column, unit: str) -> Column:
    """A line whose words stand one space apart, as ``_cut`` wants it."""
    odd = reduce(Column.__or__, [F.contains(line, F.lit(b)) for b in ("  ", "\t", "\r", "\x0b", "\x0c")])
    return F.when(odd, F.array_join(units_of(line, unit), " ")).otherwise(line) if unit == "words" else line


def _cut(line: Column, begin: Column | None, end: Column | None, size: Column, unit: str) -> Column:
    """The units of a line from ``begin`` up to ``end`` (None: from its first, up to its last), as a string; without
    cutting the line into an array."""
    if unit == "chars":
        begin = F.lit(0) if begin is None else begin
        return F.substring(line, begin + 1, size - begin if end is None else end - begin)
    if end is not None:
        line, size = F.call_function("substring_index", line, F.lit(" "), end), end
    return line if begin is None else F.call_function("substring_index", line, F.lit(" "), begin - size)


def sized(lines: DataFrame, unit: str) -> DataFrame:
    """``lines`` with ``_spaced``, for ``_cut``, and the number of units ``_size``."""
    lines = lines.withColumn("_spaced", spaced(F.col("_line"), unit))
    return lines.withColumn("_size", F.char_length("_spaced") if unit == "chars" else F.octet_length("_spaced") - F.octet_length(F.replace("_spaced", F.lit(" "))) + 1)


def coarse_keys(unit: str, least: int, edits: int) -> Column:
    """Keys of a line (see ``sized``), of which it shares one with each line within the bound: its rests with one segment
    more than there may be edits, for edits in different segments."""
    line, size, keys = F.col("_spaced"), F.col("_size"), []
    for a, c in _shapes(edits):
        bound = lambda k, n=size - F.lit(a + c): F.floor(n * k / (edits + 1)).cast("int")  # noqa: B023, E731
        for free in range(edits + 1):  # the segment without edits, which begins behind a unit for each gap before it
            begin = bound(free) + F.lit(a if free < edits else a + c) if free else None
            end = bound(free + 1) + F.lit(a if free else 0) if free < edits else None
            keys.append(F.xxhash64(size - F.lit(a + c), F.lit(free), _cut(line, begin, end, size, unit)))
    return F.when(size >= least, F.array(*keys))


def rests(texts: DataFrame, edits: int) -> DataFrame:
    """Of ``_line_hash``, ``_units``: a row for each way in which a line may have its gaps, ``_line_hash, a, c, i, j,
    many, rest``."""
    units, size = F.col("_units"), F.size("_units")

    def ways(a: int, c: int) -> Column:
        many = F.greatest(F.ceil(F.sqrt(size - F.lit(a + c))), F.lit(1)).cast("int")
        way = lambda i, j: F.struct(F.lit(a).alias("a"), F.lit(c).alias("c"), i.alias("i"), j.alias("j"), many.alias("many"), _rest(units, size, many, i, j, a, c, edits).alias("rest"))
        firsts = F.sequence(F.lit(0), many - 1)
        if edits == 1:
            return F.transform(firsts, lambda i: way(i, i))
        return F.flatten(F.transform(firsts, lambda i: F.transform(F.sequence(i, many - 1), lambda j: way(i, j))))

    return texts.select("_line_hash", F.inline(F.concat(*[ways(a, c) for a, c in _shapes(edits)])))


def variants(parts: DataFrame, edits: int) -> DataFrame:
    """Of rests with their lines' ``_first`` and ``_units``: a row for each pair of gaps in the segments, with ``g`` and
    ``h`` for their places and ``variant`` for a hash of the segments less what is in the gaps."""
    units, a, c = F.col("_units"), F.col("a"), F.col("c")
    length = F.size(units) - a - c
    bound = lambda k: F.floor(k * length / F.col("many")).cast("int")
    rows = parts.withColumns({"from_i": bound(F.col("i")), "to_i": bound(F.col("i") + 1), "from_j": bound(F.col("j")), "to_j": bound(F.col("j") + 1), "one": F.col("i") == F.col("j")})
    # the gap behind the last unit belongs to the last segment
    last = lambda k, to: F.when(F.col(k) == F.col("many") - 1, F.col(to)).otherwise(F.col(to) - 1)
    p = {k: F.col(k) for k in ("from_i", "to_i", "from_j", "to_j")}

    def variant(g: Column, h: Column) -> Column:
        middle = _part(units, g + a, F.when(F.col("one"), h + a).otherwise(p["to_i"] + a))
        pieces = [_part(units, p["from_i"], g), middle, _part(units, h + a + c, p["to_j"] + a + c)]
        if edits == 2:
            pieces.append(_part(units, p["from_j"] + a, F.when(F.col("one"), F.lit(0)).otherwise(h + a)))
        return F.struct(g.alias("g"), h.alias("h"), F.xxhash64(*pieces).alias("variant"))

    gaps = F.filter(F.sequence(p["from_i"], F.greatest(last("i", "to_i"), p["from_i"])), lambda g: g <= last("i", "to_i"))
    if edits == 1:
        found = F.transform(gaps, lambda g: variant(g, g))
    else:
        seconds = lambda g: F.greatest(g, p["from_j"])
        found = F.flatten(F.transform(gaps, lambda g: F.transform(F.filter(F.sequence(seconds(g), F.greatest(last("j", "to_j"), seconds(g))), lambda h: h <= last("j", "to_j")), lambda h: variant(g, h))))
    return rows.select("_line_hash", "_first", "a", "c", "rest", F.inline(found))


def _left(units: str, a: str, c: str) -> Column:
    """The units of a line less those in the gaps ``g`` and ``h``."""
    u, a, c, g, h = F.col(units), F.col(a), F.col(c), F.col("g"), F.col("h")
    return F.concat(_part(u, F.lit(0), g), _part(u, g + a, h + a), _part(u, h + a + c, F.size(u)))


def superseded(lines: DataFrame, firsts: DataFrame, unit: str, edits: int) -> DataFrame:
    """``_line_hash`` of the lines that have an earlier one within the bound.  ``firsts`` has a row for each distinct
    line: ``_line_hash``, ``_first`` and its coarse keys."""
    keys = firsts.select("_line_hash", F.explode("_keys").alias("_coarse"))
    shared = keys.groupBy("_coarse").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_coarse")
    partners = keys.join(shared, "_coarse", "left_semi").select("_line_hash").distinct()
    partners = stash(partners.join(firsts, "_line_hash").select("_line_hash", "_first"), "partners")
    # the text of each, from the row where it stands first (of repeated rows, from any)
    texts = meet(lines.withColumns({"_line_hash": F.unhex(F.md5("_line")), "_at": _order()}), partners, "_line_hash").where("_at = _first")
    texts = stash(texts.groupBy("_line_hash").agg(F.min("_first").alias("_first"), F.min("_line").alias("_line")), "near-lines")
    texts = texts.withColumn("_units", units_of(F.col("_line"), unit)).drop("_line")

    parts = stash(rests(texts, edits), "rests")
    met = parts.groupBy("rest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("rest")
    parts = parts.join(met, "rest", "left_semi").join(texts, "_line_hash")
    found = stash(variants(parts, edits), "variants")
    by = ["rest", "g", "h", "variant"]
    earliest = found.groupBy(*by).agg(F.min(F.struct("_first", "_line_hash", "a", "c")).alias("_w"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    earliest = earliest.select(*by, F.col("_w._first").alias("_earlier"), F.col("_w._line_hash").alias("_witness"), F.col("_w.a").alias("_a"), F.col("_w.c").alias("_c"))
    pairs = found.join(earliest, by).where("_earlier < _first").select("_line_hash", "_witness", "a", "c", "_a", "_c", "g", "h").distinct()
    # both lines are the same but for what is in the gaps, compared unit by unit
    other = texts.select(F.col("_line_hash").alias("_witness"), F.col("_units").alias("_others"))
    pairs = pairs.join(texts.select("_line_hash", "_units"), "_line_hash").join(other, "_witness")
    return pairs.where(_left("_units", "a", "c") == _left("_others", "_a", "_c")).select("_line_hash").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "words", edits: int = 1, least: int | None = None) -> DataFrame:
    """``_key`` and the sorted line numbers ``_dropped`` of the rows that lose lines."""
    if unit not in UNITS or edits not in (0, 1, 2):
        raise ValueError("a unit is words or chars, and the bound 0, 1 or 2 edits")
    least = max((NEAR_WORDS if unit == "words" else NEAR_CHARS) if least is None else least, edits + 1)
    lines = _lines(docs, id_col, text_col)
    keys = coarse_keys(unit, least, edits) if edits else F.lit(None).cast("array<bigint>")
    held = sized(lines, unit) if edits else lines
    held = stash(held.select("_id", "_key", "_pos", F.unhex(F.md5("_line")).alias("_line_hash"), keys.alias("_keys")), "lines")
    firsts = held.groupBy("_line_hash").agg(F.min(_order()).alias("_first"), F.count(F.lit(1)).alias("_n"), F.any_value("_keys").alias("_keys"))
    firsts = stash(firsts, "first-lines")
    decided = firsts.where("_n > 1").select("_line_hash", "_first")
    if edits:
        gone = stash(superseded(lines, firsts, unit, edits), "superseded")
        decided = decided.join(gone, "_line_hash", "left_anti")
        decided = decided.unionByName(gone.withColumn("_first", F.lit(None).cast(firsts.schema["_first"].dataType)))  # none of its places stays
    decided = stash(decided, "decided")
    places = meet(held.select("_id", "_key", "_pos", "_line_hash"), decided, "_line_hash")
    places = places.where(F.col("_first").isNull() | (_order() > F.col("_first")))
    return stash(places.groupBy("_key").agg(F.array_sort(F.collect_set("_pos")).alias("_dropped")), "dropped")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, counts: bool = False, unit: str = "words", edits: int = 1, least: int | None = None) -> DataFrame:
    """``docs`` with the repeated lines cut from its texts; every row and column stays.

    Lines end at ``\\n`` and are compared without white space around them; blank lines stay where they are.  Of equal
    lines only the earliest place stays, by id and then by place in the text.  A line of ``least`` units or more
    (``NEAR_WORDS`` words, ``NEAR_CHARS`` characters) also goes, at all its places, if a distinct one that stands earlier
    has as many and is within ``edits`` edits: units inserted, deleted or replaced.  A ``unit`` is one of the words between
    white space, or of the chars (code points).  ``edits`` is 0, 1 or 2; with two, the work for a line that may have a
    partner grows with the square of its length and not with the power 1.5.  What is earlier is judged on the input, so
    a line that goes can take others with it.

    A null text stays null and an empty one empty.  Null ids come last.  Rows that repeat id and text lose the same
    lines, and none to each other; the same holds for lines at the same place of other rows with that id.  With
    ``size_col`` that column is set to the new number of characters; with ``counts`` the columns ``n_lines`` and
    ``n_dropped`` are added (replaced).  An empty table gives an empty result.

    Texts are shuffled only of rows that lose lines, and lines only if they may have a partner (``common.marked``).
    """
    dropped = dropped_lines(docs, id_col, text_col, unit, edits, least).select(F.col("_key").alias("__line_key"), F.col("_dropped").alias("__line_gone"))
    rows = lookup(docs.withColumn("__line_key", row_key(F.col(id_col), F.col(text_col))), dropped, "__line_key", narrow=False)
    lines = F.split(F.col(text_col), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_gone"))
    # binding the split text to a name keeps it from being split again for each line
    cut = F.transform(F.array(F.struct(lines.alias("lines"), stay.alias("stay"))), lambda x: F.array_join(F.transform(x["stay"], lambda i: x["lines"][i]), "\n"))[0]
    extra = {"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_dropped": F.coalesce(F.size("__line_gone"), F.lit(0))} if counts else {}
    extra = {k: F.when(v > 0, v).otherwise(0).cast("long") for k, v in extra.items()}
    rows = rows.withColumns(extra | {text_col: F.when(F.col("__line_gone").isNull(), F.col(text_col)).otherwise(cut)})
    rows = rows.drop("__line_gone", "__line_key")
    return rows if size_col is None else rows.withColumn(size_col, F.char_length(text_col).cast(docs.schema[size_col].dataType))
