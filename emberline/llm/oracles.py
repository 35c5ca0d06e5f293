"""SQL for DuckDB with the rows of those queries that SQL can express."""

from __future__ import annotations

CHAT = r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER o - 1 AS i,
        len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]{1,6}|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]{1,3}')) + 4 AS n,
        length(coalesce(role, '')) + 9 + length(regexp_replace(coalesce(text, ''), '(<<?/?|\[/?)(\\*)(s>|INST\]|SYS>>)', '\1\\\2\3', 'g')) AS shown
    FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) - n AS s FROM t),
k AS (SELECT conv_id, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS kept, 512 - max(CASE WHEN i = 0 AND role = 'system' THEN n ELSE 0 END) AS room, max(CASE WHEN i = 0 AND role = 'system' THEN shown ELSE 0 END) AS lead, count(*) AS cnt FROM p GROUP BY conv_id),
old AS (SELECT a.conv_id, a.i, max(a.s - b.s) AS old FROM p a JOIN k USING (conv_id) JOIN p b ON b.conv_id = a.conv_id AND b.i >= kept AND b.i <= a.i AND a.s - b.s <= 128 GROUP BY ALL),
q AS (SELECT p.*, kept, room, CASE WHEN coalesce(old, 0) + n <= room THEN coalesce(old, 0) ELSE 0 END AS old FROM p JOIN k USING (conv_id) LEFT JOIN old USING (conv_id, i)),
win(conv_id, w, first, begin_s, held) AS (
    SELECT k.conv_id, 0, k.kept, coalesce(q.s, 0), CAST(0 AS HUGEINT) FROM k LEFT JOIN q ON q.conv_id = k.conv_id AND q.i = k.kept
    UNION ALL
    SELECT conv_id, w + 1, x.i, x.s, x.old FROM (SELECT win.conv_id, win.w, arg_min({'i': q.i, 's': q.s, 'old': CAST(q.old AS HUGEINT)}, q.i) AS x
        FROM win JOIN q ON q.conv_id = win.conv_id AND q.i > win.first AND q.s + q.n - win.begin_s + win.held > q.room GROUP BY win.conv_id, win.w)),
spans AS (SELECT win.*, coalesce(lead(first) OVER (PARTITION BY win.conv_id ORDER BY w), cnt) AS stop, k.kept, k.lead FROM win JOIN k USING (conv_id)),
chars AS (SELECT conv_id, sum(c) AS formatted_chars FROM (SELECT spans.conv_id, w, lead + coalesce(sum(shown) FILTER (i >= kept AND i < stop AND (i >= first OR (held > 0 AND begin_s - s <= held))), 0) AS c
    FROM spans JOIN p USING (conv_id) GROUP BY spans.conv_id, w, lead) GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(any_value(formatted_chars) AS BIGINT) AS formatted_chars FROM p JOIN chars USING (conv_id) GROUP BY conv_id"""


def _level(k: int, path: list[str], weight: str, above: str | None) -> str:
    """Common tables n{k}, b{k}: the nodes of a level and their budgets, by sharing in order of capacity for weight."""
    keys, parents = ", ".join(path), path[:-1]
    budget = "total" if above is None else "g.budget"
    source = "leaf, sums" if above is None else "leaf JOIN {} g USING ({})".format(above, ", ".join(parents))
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    return f"""
n{k} AS (SELECT *, sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw, coalesce(sum(capacity) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
    FROM (SELECT {keys}, {weight} AS weight, sum(capacity) AS capacity, any_value({budget}) AS budget FROM {source} GROUP BY {keys}) WINDOW r AS ({part} ORDER BY capacity / weight, {path[-1]} NULLS FIRST)),
o{k} AS (SELECT *, first_value(CASE WHEN short THEN budget - used END IGNORE NULLS) OVER r AS rest, first_value(CASE WHEN short THEN lw END IGNORE NULLS) OVER r AS per
    FROM (SELECT *, capacity * lw > weight * greatest(budget - used, 0) AS short FROM n{k}) WINDOW r AS ({part} ORDER BY capacity / weight, {path[-1]} NULLS FIRST)),
b{k} AS (SELECT {keys}, CASE WHEN rest IS NULL THEN capacity ELSE least(capacity, (weight * greatest(rest, 0)) // per) END AS budget FROM o{k})"""


MIXTURE = f"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-4]$') THEN 'books' ELSE 'other' END AS domain, CAST((length(coalesce(text, '')) + 3) // 4 AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(2 * sum(tokens) AS HUGEINT) AS capacity FROM d GROUP BY ALL),
sums AS (SELECT CAST(floor(sum(tokens) * CAST(0.6 AS DOUBLE)) AS HUGEINT) AS total FROM d),
{_level(1, ["domain"], "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END", None)},
{_level(2, ["domain", "lang"], "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END", "b1")},
{_level(3, ["domain", "lang", "source"], "CASE source WHEN 'src0' THEN 2 ELSE 1 END", "b2")},
e AS (SELECT d.*, epoch, md5('17:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM d, (VALUES (0), (1)) v(epoch)),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, place) AS upto FROM e)
SELECT doc_id, domain, lang, source, CAST(epoch AS INT) AS epoch, tokens FROM r JOIN b3 USING (domain, lang, source) WHERE upto <= budget"""

LINES = r"""
WITH RECURSIVE l AS (SELECT doc_id, pos - 1 AS pos, line FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
u AS (SELECT row_number() OVER (ORDER BY line) AS id, line FROM (SELECT DISTINCT line FROM l WHERE trim(line) <> '')),
g AS (SELECT id, lower(line) AS line FROM u),
s AS (SELECT DISTINCT id, substring(line, CAST(k AS BIGINT), 5) AS g FROM (SELECT id, line, unnest(range(1, greatest(length(line) - 3, 2))) AS k FROM g)),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
z AS (SELECT id, g, n FROM s JOIN c USING (id)),
x AS (SELECT a.id AS a, b.id AS b, count(*) AS n, any_value(a.n) AS p, any_value(b.n) AS q FROM z a JOIN z b ON a.g = b.g AND a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY ALL),
e AS (SELECT a, b FROM x WHERE n >= 0.8 * (p + q - n)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b),
comp AS (SELECT a AS id, min(b) AS cls FROM reach GROUP BY a),
m AS (SELECT l.*, coalesce(cls, u.id) AS cls FROM l LEFT JOIN u USING (line) LEFT JOIN comp USING (id)),
f AS (SELECT *, cls IS NOT NULL AND row_number() OVER (PARTITION BY cls ORDER BY doc_id NULLS LAST, pos) > 1 AS gone FROM m),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE length(kept) END AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)"""

SQL = {"op1_chat_windows": CHAT, "op6_hierarchical_mixture": MIXTURE, "op9_fuzzy_lines": LINES}
