"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from tickloom.llm.quality import LINE_LIMIT, RUN_LIMITS

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(column: str) -> str:
    """A-Z only: lower() would change other letters too."""
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '{_SPACED}') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
 n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS id, doc_id AS to_id FROM n UNION SELECT r.id, g.b FROM r JOIN g ON g.a = r.to_id), m AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id)
 SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.id = n.doc_id"""

DECONTAMINATION = rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '{_ALNUM}') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({_lower("text")}, '{_ALNUM}') AS w FROM benchmark),
 bw AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS x FROM b WHERE len(w) BETWEEN 1 AND 9 UNION SELECT DISTINCT item_id, 10, array_to_string(w[i:i+9], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)),
 k AS (SELECT DISTINCT n FROM bw), d AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, k WHERE len(w) >= n)),
 h AS (SELECT d.doc_id, d.i, d.n, bw.item_id FROM d JOIN bw ON d.n = bw.n AND d.x = bw.x), c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
 SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_HEX = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT h, max(page_id) AS first FROM p GROUP BY 1), s AS (SELECT p.page_id, p.h, d.first, sha1(p.h) AS hex FROM p JOIN d USING (h)),
 b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: printf('%04b', CAST(strpos('0123456789abcdef', hex[i:i]) - 1 AS INTEGER))), '') AS bits FROM s)"""


def _digit(i: str) -> str:
    """Base32 digit number i (from 0) of a string of bits."""
    value = " + ".join(f"{2 ** (4 - k)} * CAST(bits[5*{i}+{k + 1}:5*{i}+{k + 1}] AS INTEGER)" for k in range(5))
    return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {value}, 1)"


WARC = f"""{_HEX} SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {_digit("i")}), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""


def _quality() -> str:
    runs = sorted({*RUN_LIMITS, 8})
    ctes, joins, columns = [], [], []
    for n in runs:
        ctes.append(
            f"a{n} AS (SELECT doc_id, i, array_to_string(w[i:i+{n - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n})), "
            f"b{n} AS (SELECT doc_id, i FROM a{n} QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1), "
            f"c{n} AS (SELECT doc_id, count(*) AS k, sum(len(w.w[p])) AS s FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM b{n}) JOIN w USING (doc_id) GROUP BY 1)"
        )
        joins.append(f"LEFT JOIN c{n} USING (doc_id)")
    for n in sorted(RUN_LIMITS):
        columns.append(f"CAST(coalesce(c{n}.s, 0) AS DOUBLE) / greatest(wc, 1) AS run{n}_share")
    limits = " AND ".join([f"line_share <= {LINE_LIMIT}", *(f"run{n}_share <= {RUN_LIMITS[n]}" for n in sorted(RUN_LIMITS))])
    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents), {", ".join(ctes)},
 li AS (SELECT doc_id, x, j, len(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM w) WHERE regexp_matches(x, '{_SPACED}')),
 ld AS (SELECT doc_id, count(*) FILTER (k > 1) AS dup, sum(c) FILTER (m > 1) AS s FROM (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id, x ORDER BY j) AS k, count(*) OVER (PARTITION BY doc_id, x) AS m FROM li) GROUP BY 1),
 t AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS wc, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
 f AS (SELECT doc_id, n_words, CAST(wc AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, coalesce(ld.dup, 0) AS n_dup_lines, coalesce(c8.k, 0) AS n_repeat_words, CAST(coalesce(ld.s, 0) AS DOUBLE) / greatest(wc, 1) AS line_share, {", ".join(columns)} FROM t LEFT JOIN ld USING (doc_id) {" ".join(joins)})
 SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {limits} AS kept FROM f"""


QUALITY = _quality()

CHAT = r"""WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role <> 'assistant'), a AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'),
 k AS (SELECT c.*, CASE WHEN role = 'user' AND turn % 8 > 1 THEN turn - 2 END AS before FROM c), v AS (SELECT k.conv_id, k.turn, CASE WHEN p.turn IS NULL THEN 0 END AS level, p.turn AS p FROM k LEFT JOIN c p ON p.conv_id = k.conv_id AND p.turn = k.before),
 l AS (SELECT conv_id, turn, 0 AS level FROM v WHERE p IS NULL UNION ALL SELECT v.conv_id, v.turn, l.level + 1 FROM v JOIN l ON l.conv_id = v.conv_id AND l.turn = v.p)
 SELECT k.conv_id AS conv, k.turn, 'call' AS kind, 'c' || k.conv_id || '-' || k.turn AS call_id, CASE k.role WHEN 'user' THEN 'reply' ELSE 'configure' END AS tool, l.level, a.turn IS NOT NULL AS linked, true AS valid, CAST([] AS VARCHAR[]) AS errors,
 '{"after":' || CASE WHEN k.before IS NULL THEN '[]' ELSE '["c' || k.conv_id || '-' || k.before || '"]' END || ',"arguments":{"final":' || CASE WHEN k.turn % 8 = 0 THEN 'true' ELSE 'false' END || ',"text":' || CAST(to_json(k.text) AS VARCHAR) || ',"turn":' || k.turn || '},"id":"c' || k.conv_id || '-' || k.turn || '","tool":"' || CASE k.role WHEN 'user' THEN 'reply' ELSE 'configure' END || '","type":"call"}' AS json
 FROM k JOIN l ON l.conv_id = k.conv_id AND l.turn = k.turn LEFT JOIN a ON a.conv_id = k.conv_id AND a.turn = k.turn + 1
 UNION ALL SELECT a.conv_id, a.turn, 'result', 'c' || a.conv_id || '-' || (a.turn - 1), CASE k.role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'configure' END, l.level, k.turn IS NOT NULL, k.turn IS NOT NULL, CASE WHEN k.turn IS NULL THEN ['call is unknown'] ELSE CAST([] AS VARCHAR[]) END,
 '{"content":' || CAST(to_json(a.text) AS VARCHAR) || ',"id":"c' || a.conv_id || '-' || (a.turn - 1) || '","tool":"' || coalesce(CASE k.role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'configure' END, '') || '","type":"result"}'
 FROM a LEFT JOIN k ON k.conv_id = a.conv_id AND k.turn = a.turn - 1 LEFT JOIN l ON l.conv_id = k.conv_id AND l.turn = k.turn"""


def mixing(levels: list[str], weights: dict[str, dict[str, float]], share: float = 0.5, epochs: int = 3, seed: str = "mix-1") -> str:
    """Water-filling level by level, then whole epochs and the prefix of one more."""
    parts, above = [], ""
    for k, name in enumerate(levels):
        path = ", ".join(levels[: k + 1])
        given = weights.get(name, {})
        weight = f"CASE {name} {' '.join(f'WHEN {x!r} THEN CAST({w} AS DOUBLE)' for x, w in given.items())} ELSE 1 END" if given else "CAST(1 AS DOUBLE)"
        parent = f"(SELECT sum(tokens) * {share} FROM leaf)" if k == 0 else f"w{k - 1}.budget"
        using = "" if k == 0 else f" JOIN w{k - 1} USING ({', '.join(levels[:k])})"
        group = ("PARTITION BY " + ", ".join(levels[:k])) if k else ""
        parts.append(
            f"n{k} AS (SELECT {path}, sum(tokens) * {epochs} AS supply FROM leaf GROUP BY ALL), m{k} AS (SELECT {path}, n{k}.supply, {weight} AS wt, {parent} AS pb FROM n{k}{using}), "
            f"o{k} AS (SELECT *, (pb - coalesce(sum(supply) OVER ({group} ORDER BY supply / wt, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER ({group} ORDER BY supply / wt, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM m{k}), "
            f"w{k} AS (SELECT {path}, least(greatest(CASE WHEN supply / wt <= lv THEN supply ELSE wt * max(CASE WHEN supply / wt > lv THEN lv END) OVER ({group}) END, 0), supply) AS budget FROM o{k})"
        )
        above = f"w{k}"
    keys = ", ".join(levels)
    return rf"""WITH d AS (SELECT doc_id, 'd' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4) AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS n_tokens FROM documents),
 leaf AS (SELECT {keys}, sum(n_tokens) AS tokens FROM d GROUP BY ALL), {", ".join(parts)},
 pl AS (SELECT {keys}, CAST(floor(floor(round(budget, 6)) / tokens) AS BIGINT) AS full_, CAST(floor(round(budget, 6)) AS BIGINT) - CAST(floor(floor(round(budget, 6)) / tokens) AS BIGINT) * tokens AS rest FROM {above} JOIN leaf USING ({keys})),
 o AS (SELECT d.*, full_, rest, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY md5('{seed}:' || full_ || ':' || doc_id), CAST(doc_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN pl USING ({keys}))
 SELECT doc_id, {keys}, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch FROM (SELECT *, unnest(range(0, full_ + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM o)"""


COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower("text")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
 w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
 g AS (SELECT lang, k, x, count(*) AS c FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i+k-1])) AS x FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 10),
 c AS (SELECT * FROM g WHERE k > 1), t AS (SELECT lang, x, unnest([x[1:2], x[2:3]]) AS y, c FROM g WHERE k = 3), m AS (SELECT lang, y, max(c) AS longer FROM t GROUP BY 1, 2),
 s AS (SELECT c.lang, c.x, c.c AS a, j, l.c AS l, r.c AS r, (CAST(1000000 AS HUGEINT) * c.c * c.c) // (CAST(l.c AS HUGEINT) * r.c) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN g l ON l.lang = c.lang AND l.x = c.x[1:c.j] JOIN g r ON r.lang = c.lang AND r.x = c.x[c.j+1:c.k]),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, j) = 1),
 f AS (SELECT b.*, array_to_string(b.x, ' ') AS phrase FROM b LEFT JOIN m ON m.lang = b.lang AND m.y = b.x WHERE m.longer IS NULL OR 100 * m.longer < 50 * b.a)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM f JOIN n USING (lang) QUALIFY rank <= 2000"""

_SHARE = "1 + (CAST(1000000000 AS HUGEINT) * ({c} + 2)) // ({n} + 2 * {v})"
DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_lower("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 t AS (SELECT id, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10), g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT t.lang, t.source, t.term, count(*) AS gc FROM t JOIN k USING (lang, term) GROUP BY ALL), nl AS (SELECT lang, sum(lc) AS n_lang, count(*) AS v FROM k GROUP BY 1), ng AS (SELECT lang, source, sum(gc) AS n FROM c GROUP BY 1, 2),
 f AS (SELECT g.lang, g.source, k.term, coalesce(c.gc, 0) AS gc, CAST({_SHARE.format(c="coalesce(c.gc, 0)", n="coalesce(ng.n, 0)", v="nl.v")} AS HUGEINT) AS p, CAST({_SHARE.format(c="k.lc", n="nl.n_lang", v="nl.v")} AS HUGEINT) AS q
  FROM g JOIN nl USING (lang) JOIN k ON k.lang = g.lang LEFT JOIN ng ON ng.lang = g.lang AND ng.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM f WHERE gc > 0 AND p > q)
 SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10"""
