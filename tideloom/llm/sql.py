"""DuckDB SQL for the corpus queries that SQL can express, written apart from how the operators work."""

from __future__ import annotations

from . import licenses, line_dedup, secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The first pattern's words in either case, letter by letter: other engines fold more than ASCII.
WORDS = "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"


def line_dedup_sql() -> str:
    """Lines within one word of each other share their first or last half, cut where the longer one's is."""
    least = line_dedup.NEAR_WORDS
    blanks = r"' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    less = lambda x, i: f"list_concat({x}[1:{i} - 1], {x}[{i} + 1:])"
    return f"""
    WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    lines AS (SELECT *, trim(raw, {blanks}) AS line FROM raw),
    firsts AS (SELECT line, min({{'last': doc_id IS NULL, 'id': coalesce(doc_id, 0), 'pos': pos}}) AS fst FROM lines WHERE line <> '' GROUP BY line),
    cut AS MATERIALIZED (SELECT line, fst, string_split_regex(line, '[ \t\r\x0b\x0c]+') AS w, len(string_split_regex(line, '[ \t\r\x0b\x0c]+')) AS n FROM firsts),
    keys AS (SELECT *, unnest([n, n + 1]) AS l FROM cut WHERE n >= {least}),
    halves AS (SELECT line, n, l, 'p' AS side, w[1:l // 2] AS half FROM keys UNION ALL SELECT line, n, l, 's', w[n - (l - l // 2) + 1:] FROM keys),
    pairs AS (SELECT DISTINCT a.line AS a, b.line AS b FROM halves a JOIN halves b ON a.l = b.l AND a.side = b.side AND a.half = b.half AND a.line <> b.line AND a.n >= b.n AND (a.n = a.l OR b.n = b.l)),
    near AS (SELECT x.line AS a, y.line AS b, x.fst AS fa, y.fst AS fb FROM pairs JOIN cut x ON x.line = a JOIN cut y ON y.line = b WHERE CASE WHEN x.n = y.n
        THEN list_bool_or(list_transform(range(1, x.n + 1), lambda i: {less('x.w', 'i')} = {less('y.w', 'i')}))
        ELSE list_bool_or(list_transform(range(1, x.n + 1), lambda i: {less('x.w', 'i')} = y.w)) END),
    gone AS (SELECT DISTINCT CASE WHEN fa > fb THEN a ELSE b END AS line FROM near WHERE fa <> fb),
    told AS (SELECT l.*, l.line = '' OR (g.line IS NULL AND f.fst = {{'last': doc_id IS NULL, 'id': coalesce(doc_id, 0), 'pos': pos}}) AS stays
        FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN gone g ON g.line = l.line)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
        coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text,
        length(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS n_chars
    FROM told GROUP BY doc_id, text"""


def ngram_join_sql(width: int = 4, percent: int = 85) -> str:
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: list_aggregate(w[i:i + {width - 1}], 'string_agg', ' '))) END AS s FROM w),
    x AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM pairs JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= {percent} * (len(sa.s) + len(sb.s) - n)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id"""


def license_sql(threshold: float = 0.8) -> str:
    """All runs between two of a template's bigrams, by joins of their places."""
    values = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))
    words = lambda text: f"regexp_extract_all(lower({text}), '{licenses.WORDS}')"
    return f"""
    WITH v AS (SELECT k, name, {words('text')} AS w FROM (VALUES {values}) AS v(k, name, text)),
    t AS (SELECT k, name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM v),
    tg AS (SELECT k, name, len(g) AS size, unnest(g) AS gram FROM t),
    d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
    p AS (SELECT r, len(w) - 1 AS n, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM d WHERE len(w) > 1),
    m AS MATERIALIZED (SELECT r, n, pos, p.gram, k, name, size FROM p JOIN tg ON tg.gram = p.gram),
    enough AS (SELECT r, k FROM m GROUP BY r, k, n, size HAVING 2 * count(DISTINCT gram) >= {threshold} * (least(n, size) + size) - 1e-9),
    s AS MATERIALIZED (SELECT m.* FROM m SEMI JOIN enough USING (r, k)),
    u AS (SELECT a.r, a.k, any_value(a.name) AS name, any_value(a.size) AS size, any_value(a.n) AS n, list(b.pos ORDER BY b.pos) AS pos, list(b.gram ORDER BY b.pos) AS g
        FROM s a JOIN s b ON a.r = b.r AND a.k = b.k AND b.pos >= a.pos AND b.pos - a.pos < a.size * (2 - {threshold}) / {threshold} GROUP BY a.r, a.k, a.pos),
    c AS (SELECT r, k, name, list_max(list_transform(range(1, len(g) + 1), lambda e: 2.0 * len(list_distinct(g[1:e])) / (greatest(pos[e] - pos[1] + 1, least(n, size)) + size))) AS dice
        FROM u WHERE 2 * len(g) >= {threshold} * (least(n, size) + size) - 1e-9),
    best AS (SELECT r, k, name, max(dice) AS dice FROM c WHERE dice >= {threshold} GROUP BY r, k, name),
    f AS (SELECT r, max({{'dice': dice, 'order': -k, 'name': name}}) AS top, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM best GROUP BY r)
    SELECT d.doc_id, f.top.name AS license, CAST(coalesce(f.top.dice, 0.0) AS DOUBLE) AS dice, coalesce(f.n, 0) AS n_matches, coalesce(f.names, '') AS licenses FROM d LEFT JOIN f ON f.r = d.r"""


def secret_sql(common_owners: int = 3) -> str:
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        if kind == "assign":
            pattern = WORDS + pattern[pattern.index("(?-i)") + len("(?-i)") :]
        p = quoted(pattern)
        # a match's start: all gaps up to it, and all matches before it
        spans.append(
            f"SELECT r, {rank} AS rank, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'size': length(m[i]), 'value': v[i]}})) AS s "
            f"FROM (SELECT r, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, string_split_regex(text, {p}) AS gaps FROM d WHERE regexp_matches(text, {p}))"
        )
    least = " ".join(f"WHEN {k} THEN {n}" for k, (*_, n) in enumerate(secrets.KINDS))
    listed = "string_agg(kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.size AS BIGINT), ',' ORDER BY s.start, rank)"
    number = lambda kind: f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
    s AS (SELECT * FROM ({' UNION ALL '.join(spans)}) WHERE length(s.value) >= CASE rank {least} END),
    o AS (SELECT s.value AS value, count(DISTINCT coalesce(d.source, chr(0))) AS owners, count(DISTINCT coalesce(d.source, chr(0)) || chr(1) || coalesce(d.lang, chr(0))) AS repositories FROM s s JOIN d ON d.r = s.r GROUP BY 1),
    t AS (SELECT s.*, o.owners, o.repositories FROM (SELECT *, s.value AS value FROM s) s JOIN o ON o.value = s.value),
    g AS (SELECT r, {', '.join(map(number, secrets.BASE))}, {listed} FILTER (WHERE rank < {len(secrets.BASE)}) AS base, {listed} AS spans,
        count(*) FILTER (WHERE owners < {common_owners}) AS n_live, count(*) FILTER (WHERE owners >= {common_owners}) AS n_example, max(owners) AS max_owners, max(repositories) AS max_repositories FROM t GROUP BY r)
    SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
        coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(max_owners, 0) AS max_owners, coalesce(max_repositories, 0) AS max_repositories FROM d LEFT JOIN g ON g.r = d.r"""
