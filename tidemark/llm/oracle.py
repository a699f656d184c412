"""The rows of queries that DuckDB SQL can express."""

from __future__ import annotations

from tidemark.llm.language import LONGEST, PROFILE
from tidemark.llm.merkle import CLOSING, LEAF, NODE, WIDTH
from tidemark.llm.quality import GRAM_SHARE, LINE_SHARE

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality_sql() -> str:
    """Operator 2: windows over a table of words; a word is covered if a repeated n-gram begins on it or on one of the n - 1 before it."""
    grams = {n: " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, n)]]) for n in {5, *GRAM_SHARE}}
    columns = ", ".join(f"{text} AS g{n}" for n, text in grams.items())
    twice = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 AS t{n}" for n in grams)
    under = ", ".join(f"max(t{n}::int) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS u{n}" for n in grams)
    sums = ", ".join(f"sum(len * u{n}) AS c{n}" for n in grams)
    worst = ", ".join(f"coalesce(c{n}, 0) / base" for n in GRAM_SHARE)
    broken = " OR ".join(f"coalesce(c{n}, 0) / base > {share}" for n, share in GRAM_SHARE.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{_WORD}') AS ws FROM d)),
g AS (SELECT r, i, length(w) AS len, {columns} FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, len, {twice} FROM g),
u AS (SELECT r, len, {under} FROM t),
s AS (SELECT r, count(*) AS n_words, sum(len) AS word_chars, sum(u5) AS n_repeat_words, {sums} FROM u GROUP BY r),
l AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY r, line),
k AS (SELECT r, sum(n - 1) AS n_dup_lines, sum(CASE WHEN n > 1 THEN n * length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) ELSE 0 END) AS line_chars FROM l GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(word_chars, 0)::bigint AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
 coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, greatest(coalesce(word_chars, 0), 1)::double AS base, coalesce(line_chars, 0) AS line_chars, s.* EXCLUDE (r, n_words, word_chars, n_repeat_words)
 FROM d LEFT JOIN s USING (r) LEFT JOIN k USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, line_chars > {LINE_SHARE} * base OR {broken} AS broken FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT broken AS kept, round(greatest({worst}), 6) AS repeat_share FROM v"""


def merkle_sql() -> str:
    """Operator 7: the same trees by list functions."""
    leaf = f"list_transform(regexp_extract_all(p, '{LEAF}'), lambda y: substr(sha256(y), 1, {WIDTH}))"
    closed = f"array_to_string(list_transform(string_split(x, chr(10)), lambda p: CASE WHEN substr(md5(p), 1, 1) IN ({', '.join(repr(c) for c in CLOSING)}) THEN p || chr(10) ELSE p END), chr(10))"
    tree = f"list_transform(string_split_regex({closed}, '\\n[ \\t\\r]*\\n'), lambda s: list_transform(string_split(s, chr(10)), lambda p: {leaf}))"
    joined = "list_transform(s, lambda p: array_to_string(p, ''))"
    digest = f"substr(sha256(array_to_string(list_transform({joined}, lambda q: sha256(q)), '')), 1, {NODE})"
    branch = f"list_transform(t, lambda s: {{'digest': {digest}, 'paragraphs': array_to_string({joined}, ';'), 'leaves': flatten(s)}})"
    names = "list_transform({}, lambda z: z.digest)"
    print_ = "sha256(sha256({0}) || array_to_string(list_transform({1}, lambda z: z.digest), '')) || '/' || array_to_string(list_transform({1}, lambda z: z.digest || ':' || z.paragraphs), '/')"
    away = f"list_filter(range(len({{0}})), lambda i: NOT list_contains({names.format('{1}')}, {{0}}[i + 1].digest))"
    size = "list_sum(list_transform({}, lambda i: len({}[i + 1].leaves)))"

    def near(a: str, b: str, same: str) -> str:
        opened = lambda x, y: f"list_distinct(flatten(list_transform({x}{y}, lambda i: {x}[i + 1].leaves)))"
        inside = lambda x, y: f"(coalesce(list_sum(list_transform({x}, lambda z: len(z.leaves))), 0) - coalesce({size.format(x + y, x)}, 0))"
        whole = f"({inside(a, b)} + {inside(b, a)})"
        both = f"({whole} + 2 * len(list_intersect({opened(a, b)}, {opened(b, a)})))"
        total = f"({whole} + len({opened(a, b)}) + len({opened(b, a)}))"
        return f"CASE WHEN {same} THEN 1.0 WHEN {total} = 0 THEN 0.0 ELSE {both}::double / {total}::double END"

    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT d.*, coalesce(lead(text) OVER (ORDER BY r), first(text) OVER (ORDER BY r)) AS after FROM d),
x AS (SELECT r, doc_id, text, after, substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2) AS edited FROM n),
trees AS (SELECT r, k, {branch} AS t FROM (SELECT r, k, {tree} AS t FROM (SELECT r, 't' AS k, text AS x FROM x UNION ALL SELECT r, 'e', edited FROM x UNION ALL SELECT r, 'x', after FROM x))),
j AS (SELECT x.r, doc_id, text, edited, after, a.t, b.t AS e, c.t AS x FROM x JOIN trees a ON a.r = x.r AND a.k = 't' JOIN trees b ON b.r = x.r AND b.k = 'e' JOIN trees c ON c.r = x.r AND c.k = 'x'),
m AS (SELECT *, {away.format('t', 'e')} AS te, {away.format('e', 't')} AS et, {away.format('t', 'x')} AS tx, {away.format('x', 't')} AS xt FROM j)
SELECT doc_id, length(text)::bigint AS n_chars, sha256(edited) AS edited_sha256, {print_.format('text', 't')} AS fingerprint, {print_.format('edited', 'e')} AS edited_fingerprint,
 {near('t', 'e', 'text = edited')} AS near_edited, {near('t', 'x', 'text = after')} AS near_next, array_to_string(te, ',') AS edited_sections, array_to_string(tx, ',') AS next_sections FROM m"""


def near_duplicates_sql(n: int, percent: int) -> str:
    """Operator 10: every pair that shares a shingle, and what can be reached from each document."""
    gram = " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, n)]])
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
s AS (SELECT DISTINCT doc_id, hash(g) AS h FROM (SELECT doc_id, {gram} AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL
 UNION ALL SELECT doc_id, hash(array_to_string(ws, ' ')) FROM d WHERE len(ws) BETWEEN 1 AND {n - 1}),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT u, v FROM p JOIN c x ON x.doc_id = u JOIN c y ON y.doc_id = v WHERE 100 * p.n >= {percent} * (x.n + y.n - p.n)),
reach(a, b) AS (SELECT u, u FROM (SELECT DISTINCT u FROM e) UNION SELECT a, v FROM reach JOIN e ON u = b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0)::bigint AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN least ON a = d.doc_id"""


def _crc32(of: str) -> str:
    """CRC-32 of a list of bytes, four bits at a time."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    half = lambda x: f"xor(({x}) >> 4, ({table}::bigint[])[(({x}) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {of}), lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"


def _bytes(text: str) -> str:
    """A text's UTF-8 bytes, by pairs of hex digits."""
    return f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint)"


def _digits(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def jump_shards_sql(shards: int = 8) -> str:
    """Operator 4: the jump loop over a list of draws; a stopped loop has a negative state."""
    name = "coalesce(doc_id::varchar, '')"

    def shard(n: int) -> str:
        draw = f"(({_digits(f'{name} || chr(58) || i')} + 1) / 4294967296.0)"
        land = f"floor((b + 1) / {draw})::bigint"
        step = f"lambda b, i: CASE WHEN b < 0 THEN b WHEN {land} < {n} THEN {land} ELSE -1 - b END"
        end = f"list_reduce(list_prepend(0::bigint, range(1, {n} + 1)), {step})"
        return f"CASE WHEN {end} < 0 THEN -1 - {end} ELSE {end} END::int"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, {_crc32(_bytes('text'))} AS text_crc32, {shard(shards)} AS shard, {shard(shards + 1)} AS grown_shard FROM d),
o AS (SELECT *, {_digits(f"'slot:' || {name} || ':' || text_crc32")} AS o FROM c)
SELECT doc_id, size::bigint AS size, text_crc32::bigint AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY o, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM o"""


def language_sql(profile: int = PROFILE, longest: int = LONGEST) -> str:
    """Operator 8: ranks of n-grams, and distances by a join."""
    held = f"{_crc32(_bytes(chr(99) + 'oalesce(doc_id::varchar, ' + chr(39) * 2 + ')'))} % 5 = 0"
    grams = lambda n: f"SELECT r, {n} AS n, substr({'w' if n == 1 else chr(39) + ' ' + chr(39) + ' || w || ' + chr(39) + ' ' + chr(39)}, j, {n}) AS g"
    padded = [f"{grams(n)} FROM (SELECT r, w, unnest(range(1, length(w) + {1 if n == 1 else 4 - n})) AS j FROM w)" for n in range(1, longest + 1)]
    point = "CASE WHEN substr(g, {0}, 1) = ' ' THEN 0 ELSE least(unicode(substr(g, {0}, 1)), 65534) END::bigint"
    code = " + ".join(f"CASE WHEN n >= {k} THEN ({point.format(k)}) << (16 * (n - {k}))::int ELSE 0 END" for k in range(1, longest + 1))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, text IS NULL AS none, lang, {held} AS held FROM documents),
w AS MATERIALIZED (SELECT r, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM d),
g AS ({' UNION ALL '.join(padded)}),
k AS MATERIALIZED (SELECT r, (({code}) << 2) | n AS gram, count(*) AS c FROM g GROUP BY ALL),
t AS MATERIALIZED (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY c DESC, gram) - 1 AS rank FROM k QUALIFY rank < {profile}),
p AS MATERIALIZED (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, gram) - 1 AS rank FROM k JOIN d USING (r) WHERE NOT held AND NOT none AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank < {profile}),
l AS (SELECT DISTINCT lang FROM p),
f AS (SELECT r, l.lang, count(*) AS used, sum(CASE WHEN p.rank IS NULL THEN {profile} ELSE abs(p.rank - t.rank) END) AS far FROM t CROSS JOIN l LEFT JOIN p ON p.lang = l.lang AND p.gram = t.gram GROUP BY r, l.lang),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, lang) = 1)
SELECT doc_id, held AS held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - far / (used * {profile})::double, 0.0) AS score FROM d LEFT JOIN b USING (r)"""
