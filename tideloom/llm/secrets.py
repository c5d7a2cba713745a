"""Secret scans: spans of candidate credentials, told apart by how widely each value is owned in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import small, stash

#: Fixed patterns: kind, pattern, the group that holds the value, its least length.  The first three are the base.
KINDS = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 20),
]
BASE = ("assign", "access", "hex")
#: What follows the line that the pem kind matches: up to the END line, or else header fields and lines of base64.  Line
#: breaks may be escaped.  All repeats are possessive, so that long bodies neither backtrack nor nest calls.
BREAK = r"(?:\s|\\[nrt])*+"
PEM_BODY = (
    r"((?:[^-]|-(?!----))*+(?=-----END [A-Z ]{0,30}PRIVATE KEY-----)"
    rf"|(?:{BREAK}[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+(?:{BREAK}[A-Za-z0-9+/]{{16,}}+=*+)++(?:[ \t]*+(?:\r?\n|\\n)[ \t]*+[A-Za-z0-9+/]++=*+(?![^\r\n]))?+)?+"
    r"(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?+"
)
#: A text without any of these has no candidate.
TRACE = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|gh[opsur]_|xox[abprs]-|eyJ|-----BEGIN "

#: Matches whose spans are gathered at a time.
CHUNK = 256
SPAN = "array<struct<start:int,rank:int,kind:string,stop:int,value:string>>"


def spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, as code point offsets.

    ``split`` cuts the text at the same matches that ``regexp_extract_all`` returns, so lengths add up to offsets.
    The value of a private key is its body in base64 alone, however it is wrapped, escaped or quoted; without a body it
    is the line that begins it.
    """
    if kind == "pem":
        header, pattern, group = pattern, pattern + PEM_BODY, 1
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if kind == "pem":
        body = lambda v: F.regexp_replace(F.regexp_replace(v, r"\\[nrt]", ""), "[^A-Za-z0-9+/=]", "")
        value = F.zip_with(value, whole, lambda v, w: F.when(body(v) != "", body(v)).otherwise(F.regexp_extract(w, header, 0)))
        least = 1
    gaps = F.split(text, pattern, -1)
    parts = F.transform(
        F.arrays_zip(whole.alias("whole"), value.alias("value"), F.transform(gaps, F.char_length).alias("gap")),
        lambda m: F.struct(F.coalesce(m["gap"], F.lit(0)).alias("gap"), F.char_length(m["whole"]).alias("size"), m["value"].alias("value")),
    )
    empty = F.array().cast(SPAN)

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["size"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("stop"), m["value"].alias("value"))
        good = F.char_length(m["value"]) >= least
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def gathered(p: Column) -> Column:
        """Arrays grow by copies, so spans are gathered in chunks of matches, whose places are summed up before."""
        firsts = F.sequence(F.lit(1), F.size(p), F.lit(CHUNK))
        sizes = F.transform(firsts, lambda k: F.aggregate(F.slice(p, k, F.lit(CHUNK)), F.lit(0), lambda n, m: n + m["gap"] + F.coalesce(m["size"], F.lit(0))))

        def chunks(sizes: Column) -> Column:
            before = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda n, x: n + x)
            return F.transform(firsts, lambda k, i: F.aggregate(F.slice(p, k, F.lit(CHUNK)), F.struct(before(i).alias("at"), empty.alias("out")), step)["out"])

        # one-element transforms bind a value to a name, so that it is worked out once
        return F.flatten(F.transform(F.array(sizes), chunks)[0])

    return F.when(F.size(whole) > 0, F.transform(F.array(parts), gathered)[0]).otherwise(empty)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), common_owners: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, and
    ``n_live``, ``n_example``: how many of the row's spans hold a value that fewer than, or at least, ``common_owners``
    distinct owners have; ``max_owners`` and ``max_repositories`` are the largest counts among its values.

    A null text counts as empty; a null owner or repository column is an owner of its own.  Null and repeated ids each
    keep their row.  A table that lacks an owner or repository column is an error; other columns are not read.  An
    empty table gives an empty result.

    The text is scanned once.  What is shuffled is one narrow row per span, folded before each exchange.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[spans_of(F.col("_text"), i, *k) for i, k in enumerate(KINDS)])
    found = F.when(F.col("_text").rlike(TRACE), F.array_sort(found)).otherwise(F.array().cast(SPAN))
    repository = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(repository_cols)])), 256)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(owner_col).alias("_owner"), F.substring(repository, 1, 16).alias("_repository"), text.alias("_text"))
    rows = rows.withColumn("_spans", found)
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    number = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    rows = rows.select(
        F.monotonically_increasing_id().alias("_row"),
        "_id",
        "_owner",
        "_repository",
        *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("_spans")).alias("spans"),
        F.transform("_spans", lambda s: F.substring(F.sha2(s["value"], 256), 1, 32)).alias("_values"),
    )
    rows = stash(rows, "spans")

    held = rows.select("_row", "_owner", "_repository", F.explode("_values").alias("_value"))
    held = held.groupBy("_value", "_owner", "_repository", "_row").agg(F.count(F.lit(1)).alias("_n"))
    owned = held.groupBy("_value", "_owner", "_repository").agg(F.lit(1).alias("_one"))
    owned = owned.groupBy("_value", "_owner").agg(F.count(F.lit(1)).alias("_r"))
    owned = owned.groupBy("_value").agg(F.count(F.lit(1)).alias("_owners"), F.sum("_r").alias("_repositories"))
    shared = stash(owned.where("_repositories > 1"), "owners")  # values with one owner need no join
    owners, repositories = F.coalesce("_owners", F.lit(1)), F.coalesce("_repositories", F.lit(1))
    told = held.join(small(shared), "_value", "left").groupBy("_row").agg(
        F.sum(F.when(owners < common_owners, F.col("_n")).otherwise(0)).alias("n_live"),
        F.sum(F.when(owners >= common_owners, F.col("_n")).otherwise(0)).alias("n_example"),
        F.max(owners).alias("max_owners"),
        F.max(repositories).alias("max_repositories"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(told, "_row", "left").select(
        F.col("_id").alias(id_col), *[f"n_{k}" for k in BASE], "base_sha256", "spans", *map(zero, ("n_live", "n_example", "max_owners", "max_repositories"))
    )
