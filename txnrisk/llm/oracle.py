"""The same rows in DuckDB SQL where SQL can express an operator; written from the contracts, without the method."""

from __future__ import annotations

from txnrisk.llm import secret_scan as SS
from txnrisk.llm import sharding as SD
from txnrisk.llm import url_filter as UF


def _values(rows: list[tuple]) -> str:
    quoted = (", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) for row in rows)
    return "VALUES " + ", ".join(f"({q})" for q in quoted)


def op2() -> str:
    rules = _values([(r.rule, r.rule.partition("/")[0], "/" + r.rule.partition("/")[2], r.verdict) for r in UF.RULES])
    globs = _values([(i, g.glob, g.verdict) for i, g in enumerate(UF.GLOBS)])
    return f"""
    WITH rules(rule, h, p, verdict) AS ({rules}), globs(n, g, verdict) AS ({globs}),
    rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
    judged AS (SELECT *,
        (SELECT max_by(rule, length(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
        (SELECT min_by(g, n) FROM globs WHERE ('.' || host || '#' || path) GLOB g) AS found FROM parts)
    SELECT page_id, host, path, j.rule, coalesce(r.verdict, g.verdict, '{UF.DEFAULT}') AS verdict, CASE WHEN j.rule IS NULL THEN found END AS "glob"
    FROM judged j LEFT JOIN rules r ON j.rule = r.rule LEFT JOIN globs g ON j.found = g.g"""


def op3() -> str:
    def matches(kind: str, pattern: str, least: int, group: int = 0) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return f"""SELECT doc_id, kind, w, place AS start, place + length(w) AS stop FROM (
            SELECT *, sum(length(g)) OVER (PARTITION BY doc_id ORDER BY i)
                + coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
            FROM (SELECT doc_id, '{kind}' AS kind, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(vs) AS v, unnest(gs[1:len(ws)]) AS g
                  FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS ws, regexp_extract_all(t, {p}, {group}) AS vs, string_split_regex(t, {p}) AS gs FROM texts)
                  WHERE len(ws) > 0)) WHERE length(v) >= {least}"""

    classes = " ".join(
        f"WHEN regexp_matches(w, '{c.pattern}') THEN {'NULL' if c.bits is None else f'{c.bits}::DOUBLE'}" for c in SS.CLASSES
    )
    allowed = " OR ".join(f"regexp_matches(w, '{a}')" for a in SS.ALLOWED)
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({matches("assign", SS.ASSIGN, 6, 2)} UNION ALL {matches("access", SS.ACCESS, 20)} UNION ALL {matches("hex", "[0-9a-f]{24,}", 24)}),
    candidates AS ({matches("entropy", "[A-Za-z0-9+/_=-]{20,}", 20)}),
    apart AS (SELECT *, CASE {classes} END AS bound FROM candidates c
              WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c.stop AND c.start < b.stop) AND NOT ({allowed})),
    windows AS (SELECT doc_id, start, stop, bound, substr(w, CAST(j AS BIGINT), {SS.WINDOW}) AS part
                FROM (SELECT *, unnest(range(1, length(w) - {SS.WINDOW} + 2)) AS j FROM apart WHERE bound IS NOT NULL)),
    bits AS (SELECT doc_id, start, stop, bound, list_entropy(string_split(part, '')) AS e FROM windows),
    added AS (SELECT DISTINCT doc_id, 'entropy' AS kind, start, stop FROM bits WHERE e >= bound - 1e-9),
    spans AS (SELECT doc_id, kind, start, stop, list_position(['assign', 'access', 'hex', 'entropy'], kind) AS rank FROM
              (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT * FROM added)),
    per AS (SELECT doc_id, count(CASE WHEN kind = 'assign' THEN 1 END) AS n_assign, count(CASE WHEN kind = 'access' THEN 1 END) AS n_access,
                   count(CASE WHEN kind = 'hex' THEN 1 END) AS n_hex,
                   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'entropy') AS b, {text} AS a
            FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
    FROM texts LEFT JOIN per USING (doc_id)"""


def op7() -> str:
    return f"""
    WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce('=' || doc_id, '') || chr(31) || coalesce('=' || text, '')), 1, 15))::BIGINT AS h,
                      coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
    paths AS (SELECT doc_id, bytes, level, left(lpad(bin(h), {SD.CONTENT_BITS}, '0'), CAST(level AS BIGINT)) AS shard
              FROM (SELECT *, unnest(range(0, {SD.CONTENT_BITS} + 1)) AS level FROM d)),
    nodes AS (SELECT shard, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM paths GROUP BY 1)
    SELECT doc_id, shard, length(shard)::INTEGER AS depth, bytes, shard_bytes, shard_docs, shard_bytes > {SD.LIMIT} AS oversized
    FROM paths JOIN nodes USING (shard) WHERE shard_bytes <= {SD.LIMIT} OR shard_docs = 1
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level) = 1"""


def op11() -> str:
    """Every order is walked step by step, and the Shapley figure is the plain sum over the orders."""
    return r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    f AS (SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
                 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(least < doc_id, false)] AS fails FROM w),
    c AS (SELECT part, fails, count(*) AS n,
                 count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)) AS g,
                 count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)) AS x FROM f GROUP BY ALL),
    i AS (SELECT unnest(range(1, 6)) AS i),
    orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    places AS (SELECT o, i AS step, o[i] AS own, o[1:i - 1] AS before FROM orders, i),
    walked AS (SELECT part, o, step, own, sum(n) AS n,
        sum(n) FILTER (gone) AS gone_before, sum(n) FILTER (NOT gone AND fails[own]) AS removed, sum(n) FILTER (gone AND fails[own]) AS redundant,
        sum(n) FILTER (fails[own] AND len(list_filter(fails, lambda z: z)) = 1) AS unique_fails,
        sum(g) FILTER (NOT gone AND fails[own]) AS good_lost, sum(x) FILTER (NOT gone AND fails[own]) AS toxic_lost
        FROM (SELECT *, len(list_filter(before, lambda b: fails[b])) > 0 AS gone FROM places, c) GROUP BY part, o, step, own)
    SELECT part, array_to_string(list_transform(o, lambda z: substr('ABCDE', z, 1)), '') AS filter_order, step::INTEGER AS step,
           (n - coalesce(gone_before, 0) - coalesce(removed, 0))::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
           coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM walked"""


def op12() -> str:
    """The level is found in one go: sources by the level that fills them, and the first prefix that may be clamped."""
    return r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        ('0x' || substr(md5('=42' || chr(31) || coalesce('=' || doc_id, '') || chr(31) || coalesce('=' || text, '')), 1, 15))::BIGINT AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
    w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
    f AS (SELECT *, 3 * sum(s) OVER () - 4 * coalesce(sum(s) OVER o, 0) AS free, 2 * (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS open
          FROM w WINDOW o AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT arg_min(free, s / w) AS free, arg_min(open, s / w) AS open FROM f WHERE 2 * s * open >= w * free),
    t AS (SELECT source, s, least(2.0::DOUBLE * s, (w * free)::DOUBLE / open::DOUBLE) AS target,
                 CASE WHEN 2 * s * open <= w * free THEN 2 * s ELSE ((w * free) * 2 + open) // (2 * open) END AS words FROM w, level),
    p AS (SELECT source, s, target, CASE WHEN s > 0 THEN words // s ELSE 0 END AS whole, CASE WHEN s > 0 THEN words % s ELSE 0 END AS part FROM t),
    r AS (SELECT d.*, p.s, p.target, p.whole, p.part, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
                 sum(size) OVER (PARTITION BY d.source, h) AS equals FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, size::BIGINT AS size, s AS source_size, target::DOUBLE AS target,
           (whole * size + CASE WHEN upto <= part THEN size WHEN upto - equals < part AND equals > 0 THEN size * (part - upto + equals) // equals ELSE 0 END)::BIGINT AS taken
    FROM r"""


def op13() -> str:
    """Diagonals as islands of six-word matches: a run's diagonal has six words at least."""
    return r"""
    WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM
        (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
    d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS o, len(o) AS n,
                 xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                                 lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h, h // 10 AS g,
                 CASE WHEN n > 0 THEN g % n END AS a, 1 + (n - a) // (3 + g % 8) AS p FROM documents, crc),
    w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE o END AS w FROM d),
    six AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 6], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM w)),
    met AS (SELECT x.doc_id, x.i, x.i - y.i AS lag FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i > y.i),
    islands AS (SELECT doc_id, lag, min(i) - lag AS start, count(*) + 5 AS m FROM
        (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM met) GROUP BY doc_id, lag, island),
    runs AS (SELECT doc_id, start, m + lag AS length, min(lag) AS period FROM islands WHERE m >= greatest(12 - lag, lag) GROUP BY doc_id, start, m + lag),
    per AS (SELECT doc_id, list({'s': start, 'l': length, 'p': period} ORDER BY start, period) AS runs,
                   arg_min({'s': start, 'l': length, 'p': period}, [-length, start, period]) AS best FROM runs GROUP BY doc_id),
    every AS (SELECT doc_id, n, w, best, coalesce(runs, []) AS runs FROM w LEFT JOIN per USING (doc_id))
    SELECT doc_id, len(runs)::BIGINT AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
           sha256(array_to_string(list_transform(runs, lambda r: r.s || ',' || r.l || ',' || r.p || chr(10)), '')) AS runs_sha256,
           sha256(array_to_string(CASE WHEN len(runs) = 0 THEN w ELSE list_transform(
               list_filter(range(n), lambda i: len(list_filter(runs, lambda r: i >= r.s + r.p AND i < r.s + r.l)) = 0), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
    FROM every"""
