"""DuckDB SQL that gives the rows of the operators that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .quality_rules import BOILERPLATE
from .sharding import BITS, DIMENSIONS, SHARDS, curve_tables
from .url_filter import RULES

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOW = f"translate({{0}}, '{UPPER}', '{LOWER}')"


def _near_dedup(k: int = 4, percent: int = 80) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(_LOW.format("text"))}, []) AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
    links AS (SELECT a.doc_id AS p, b.doc_id AS q FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.q FROM reach r JOIN links l ON l.p = r.other),
    c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.doc_id = s.doc_id"""


def _url_filter() -> str:
    """The tables' pages declare no redirects or canonical links, and forms of one url have one rule: what has no rule is allowed."""
    host = r"coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{0}', '{1}'), '')".format(UPPER, LOWER)
    path = r"coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        cases.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')", rule, verdict))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    return f"WITH p AS (SELECT page_id, {host} AS host, {path} AS path FROM pages) SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM p"


def _quality_rules() -> str:
    phrases = " OR ".join(f"contains(low, '{p.decode()}')" for p in BOILERPLATE)
    count = "len(regexp_extract_all({0}, '{1}'))"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, {_WORDS.format("text")} AS w FROM d),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
    v AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS v FROM g),
    again AS (SELECT doc_id, v FROM v GROUP BY 1, 2 HAVING count(*) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM v JOIN again USING (doc_id, v), range(0, 5) t(k) GROUP BY 1),
    l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS at, unnest(string_split(text, chr(10))) AS line FROM d),
    m AS (SELECT doc_id, line, {_LOW.format("line")} AS low, len({_WORDS.format("line")}) AS words, {count.format("line", r"[#*$%&|<>]")} AS symbols, {count.format("line", r"[|>]")} AS bars,
      {count.format("line", "!")} AS bangs, {count.format("line", "[A-Z]")} AS capitals, {count.format("line", "[a-z]")} AS small, regexp_extract(line, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM l),
    f AS (SELECT *, words > 0 AND (bars >= 2 AND 4 * bars >= words OR words < 4 AND NOT regexp_matches(last, '[^\x00-\x7F]|[.!?:;,"'')\]]')
      OR 10 * symbols >= 3 * words AND symbols >= 3 OR 2 * bangs >= words AND bangs >= 3 OR capitals >= 20 AND capitals > 3 * small OR ({phrases}) AND words < 40) AS failed FROM m),
    s AS (SELECT doc_id, count(*) FILTER (WHERE words > 0) - count(DISTINCT CASE WHEN words > 0 THEN line END) AS n_dup_lines, coalesce(sum(words) FILTER (WHERE failed), 0) AS lost FROM f GROUP BY 1),
    r AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, {count.format("text", r"[#*$%&|<>]")}::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
      coalesce(c.n, 0)::BIGINT AS n_repeat_words, lost FROM w JOIN s ON s.doc_id = w.doc_id LEFT JOIN covered c ON c.doc_id = w.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost <= n_words AND lost < n_words AS kept FROM r"""


def _sharding() -> str:
    """Cells by the middles of values' rows; the curve's automaton step by step; CRC-32 byte by byte."""
    digit, then = curve_tables(len(DIMENSIONS))
    parts = ["t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"]
    for d in DIMENSIONS:
        parts.append(f"n_{d} AS (SELECT {d} AS v, count(*)::BIGINT AS c FROM documents WHERE {d} IS NOT NULL GROUP BY 1)")
        parts.append(f"c_{d} AS (SELECT v, ((2 * (sum(c) OVER (ORDER BY v)) - c) * {1 << BITS} // (2 * sum(c) OVER ()))::INTEGER AS cell FROM n_{d})")
    cells = ", ".join(f"coalesce(c_{d}.cell, 0) AS x{k}" for k, d in enumerate(DIMENSIONS))
    joins = " ".join(f"LEFT JOIN c_{d} ON c_{d}.v = documents.{d}" for d in DIMENSIONS)
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    parts.append(f"s{BITS} AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 8 AS size, {crc}::BIGINT AS crc, 0 AS state, 0::BIGINT AS h, {cells} FROM documents {joins}, t)")
    keep = "doc_id, size, crc, " + ", ".join(f"x{k}" for k in range(len(DIMENSIONS)))
    for i in range(BITS - 1, -1, -1):
        orthant = " + ".join(f"((x{k} >> {i}) & 1) * {1 << k}" for k in range(len(DIMENSIONS)))
        at = f"[state * {1 << len(DIMENSIONS)} + {orthant} + 1]"
        parts.append(f"s{i} AS (SELECT {keep}, h * {1 << len(DIMENSIONS)} + {digit}{at} AS h, {then}{at} AS state FROM s{i + 1})")
    parts.append("o AS (SELECT *, row_number() OVER (ORDER BY h, crc NULLS FIRST, doc_id NULLS FIRST, size) - 1 AS pos, count(*) OVER () AS total FROM s0)")
    shard = f"pos * {SHARDS} // total"
    return f"""WITH {", ".join(parts)} SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, ({shard})::INTEGER AS shard, (pos - (({shard}) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard, h::BIGINT AS hilbert FROM o"""


def _mixing() -> str:
    return rf"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
    s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
    t AS (SELECT *, (row_number() OVER (ORDER BY key) - 1) % 3 AS turn FROM s),
    c AS (SELECT *, 3 * source_size AS cap, 1 + turn AS w, (3 * source_size)::DOUBLE / (1 + turn) AS ratio FROM t),
    v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level FROM c WINDOW b AS (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT key, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 0.0) * w) AS target, (turn - 1) / 2::DOUBLE AS slope FROM v),
    p AS (SELECT doc_id, size, source_size, target, slope, round(target)::BIGINT AS take, coalesce(sum(size) OVER (PARTITION BY key ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN g USING (key)),
    x AS (SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS whole FROM p),
    y AS (SELECT *, (whole * size + greatest(0, least(size, take - whole * source_size - before)))::BIGINT AS taken, before / take AS q FROM x)
    SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN q ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * q) - (1 - slope)) / (2 * slope) END + 0.0 END AS position,
      CASE WHEN taken > 0 THEN ceil(taken / size) ELSE 0 END::BIGINT AS passes FROM y"""


def _line_dedup(chars: int = 40, docs: int = 5) -> str:
    return rf"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS at, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    k AS (SELECT *, {_LOW.format(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS key FROM l),
    c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {docs}),
    m AS (SELECT k.doc_id, k."at", k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON c.key = k.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY "at") FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""".replace("AS at,", 'AS "at",')


ORACLES = {
    "op1_near_dedup": _near_dedup(),
    "op2_url_filter": _url_filter(),
    "op3_sharding": _sharding(),
    "op4_quality_rules": _quality_rules().replace(" AS at,", ' AS "at",'),
    "op6_mixing": _mixing(),
    "op10_line_dedup": _line_dedup(),
}
