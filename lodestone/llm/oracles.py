"""SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from .exponion import ENTRIES, PARTS, ROUNDS, SCALE
from .forest import WORDS
from .merkle import COLUMNS, FANOUT
from .quality import LEAST, LEFT, SHARE
from .secrets import RULES

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def secrets() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(RULES):
        p = quote(r.pattern)
        parts.append(
            f"SELECT doc_id, {k} AS ord, {quote(r.kind)} AS kind, {str(r.base).lower()} AS base, {r.least} AS least, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS h, regexp_extract_all(t, {p}, {r.group}) AS v FROM d"
        )
    spans = "array_to_string(list(kind || ':' || start || ':' || stop ORDER BY start, ord) FILTER ({0}), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m),
s AS (SELECT doc_id, ord, kind, base, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(h[i]) AS size FROM i WHERE length(v[i]) >= least),
e AS (SELECT *, start + size AS stop FROM s),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {spans.format("base")} AS b, {spans.format("true")} AS spans FROM e GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


def shards() -> str:
    digest = "CAST('0x' || substr(md5(name || ':{0}' || {1}), 1, 13) AS BIGINT)"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    scores = f"list_transform(range({{0}}), lambda s: {digest.format('shard', 's')})"
    return f"""
WITH t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: {step}) ORDER BY i) AS tbl FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS name, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, name, len(bytes) + 1 AS size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tbl[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM d, t),
s AS (SELECT *, {scores.format(16)} AS old, {scores.format(17)} AS new, CAST('0x' || substr(md5(name || ':' || text_crc32 || ':slot'), 1, 13) AS BIGINT) AS place FROM c),
o AS (SELECT doc_id, size, text_crc32, CAST(list_position(old, list_max(old)) - 1 AS INTEGER) AS shard, CAST(list_position(new, list_max(new)) - 1 AS INTEGER) AS grown_shard, place FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM o"""


def quality() -> str:
    normal = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000')"
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT doc_id, source, t, line, {_WORDS.format("line")} AS lw FROM l),
x AS (SELECT doc_id, source, t, line, len(lw) AS size, array_to_string({"list_transform(lw, lambda x: " + normal.format("x") + ")"}, ' ') AS norm FROM n WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM x GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY 1),
freq AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS c FROM x GROUP BY 1, 2) JOIN hosts USING (source) WHERE c > {LEAST} AND c > {SHARE} * host_docs),
gone AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS removed_words FROM x JOIN freq USING (source, norm) GROUP BY 1),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN (SELECT doc_id, win FROM win GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, win)) GROUP BY 1),
s AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= {LEFT} * n_words AS kept FROM s"""


def near_duplicates() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, b AS seen FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.seen),
m AS (SELECT doc_id, min(seen) AS low FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def vector_codes() -> str:
    """Every part against every entry, ROUNDS times and once more; products of integers below 2^53 are exact in doubles."""
    parts = ", ".join(f"v[{p} * w + 1:{p + 1} * w]" for p in range(PARTS))
    steps = [f"b0 AS (SELECT p, n AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS n FROM s) WHERE n < {ENTRIES})"]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS (SELECT r, p, min(struct_pack(d := xx - 2 * list_inner_product(s.x, b.x) + list_inner_product(b.x, b.x), e := e)) AS a FROM s JOIN b{k} b USING (p) GROUP BY r, p)")
        if k < ROUNDS:
            steps.append(f"c{k} AS (SELECT p, e, i, floor(sum(y) / count(*)) AS y FROM (SELECT p, a.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k} JOIN s USING (r, p)) GROUP BY 1, 2, 3)")
            steps.append(f"b{k + 1} AS (SELECT p, e, coalesce(l.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS x FROM c{k} GROUP BY 1, 2) l USING (p, e))")
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT r, vec_id, p, x, list_inner_product(x, x) AS xx FROM (SELECT r, vec_id, unnest(range({PARTS})) AS p, unnest([{parts}]) AS x FROM k)),
{", ".join(steps)},
o AS (SELECT r, string_agg(printf('%02x', a.e), '' ORDER BY p) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN o USING (r), h"""


#: Levels that the SQL below writes out: FANOUT ** LEVELS leaves a group, and as many groups.
LEVELS = 8


def merkle() -> str:
    field = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
    body = " || ".join(field.format(c) for c in COLUMNS)
    lower = " || ".join(field.format(_LOWER.format(c) if c == "text" else c) for c in COLUMNS)
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    ctes, out, proof = [], [], []

    def climb(name: str, column: str) -> str:
        """Levels {name}0..; each node's siblings on each of them; the name of the last level."""
        for k in range(LEVELS):
            up = "CASE WHEN count(*) OVER g = 1 THEN d ELSE sha256(string_agg(d, '') OVER r) END"
            ctes.append(f"{name}w{k} AS (SELECT {column}, i, d, {up} AS u, count(*) OVER g AS n, string_agg(d, '') OVER r AS run FROM {name}{k} WINDOW g AS (PARTITION BY {column}), r AS (PARTITION BY {column}, i // {FANOUT} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")
            ctes.append(f"{name}{k + 1} AS (SELECT {column}, i // {FANOUT} AS i, min(u) AS d FROM {name}w{k} GROUP BY 1, 2)")
        return f"{name}{LEVELS}"

    last = climb("l", "g")
    ctes.append(f"t0 AS (SELECT 0 AS z, row_number() OVER (ORDER BY g) - 1 AS i, d, g FROM {last})")
    top = climb("t", "z")
    joins = []
    for name, column, at in (("l", "g", "x.i"), ("t", "0", "y.i")):
        for k in range(LEVELS):
            alias = f"{name}j{k}"
            joins.append(f"JOIN {name}w{k} {alias} ON {alias}.{'g = x.g' if name == 'l' else 'z = 0'} AND {alias}.i = {at} // {FANOUT**k}")
            place = f"64 * ({alias}.i % {FANOUT})"
            out.append((alias, f"{alias}.run[1:{place}]", f"{alias}.run[{place} + 65:]"))
    for alias, before, after in out:
        proof.append(f"CASE WHEN {alias}.n = 1 THEN '' ELSE {before} || {after} END")
    # One CTE for each step keeps the folded digest from being written out again and again.
    folds = ["f0 AS (SELECT *, coalesce(changed, leaf) AS f FROM m)"]
    for k in range(2 * LEVELS):
        folds.append(f"f{k + 1} AS (SELECT * EXCLUDE (f), CASE WHEN n{k} = 1 THEN f ELSE sha256(a{k} || f || b{k}) END AS f FROM f{k})")
    sides = ", ".join(f"{alias}.n AS n{k}, {before} AS a{k}, {after} AS b{k}" for k, (alias, before, after) in enumerate(out))
    return f"""
WITH c AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: {step}) ORDER BY i) AS tbl FROM (SELECT unnest(range(256)) AS i)),
q AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, tbl[xor(c & 255, b) + 1])), 4294967295) AS crc FROM documents, c),
e AS (SELECT doc_id, source AS s, coalesce('+' || source, '') AS g, sha256({body}) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256({lower}) END AS changed FROM q),
x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM e),
l0 AS (SELECT g, i, leaf AS d FROM x),
{", ".join(ctes)},
m AS (SELECT x.doc_id, x.leaf, x.changed, y.d AS subroot, (SELECT d FROM {top}) AS root, sha256({" || ".join(proof)}) AS proof_sha256, {sides} FROM x JOIN t0 y ON y.g = x.g {" ".join(joins)}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{2 * LEVELS}"""
