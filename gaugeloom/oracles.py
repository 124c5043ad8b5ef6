"""DuckDB's SQL of the catalog's queries about graders, records and intervals; each builds the same replies from the tables and reads them with its own patterns."""

from __future__ import annotations

from .functions.stats import MIDDLE, MIDDLE_BELOW, OUTER, OUTER_BELOW, TAIL
from .plans.adapters import EVENT_SQL, LEDGER_SQL

_REPLIES = """
WITH r AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1) AS word, conv_id * 7 + turn AS k, (conv_id * 7 + turn) % 12 AS kind FROM conversations
)"""
_SQUASH = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\s+#.*$', ''), '^[\s`''\"]+|[\s`''\"]+$', '', 'g'), '\.+$', ''), '\s+', '', 'g')"
_NUMBER = r"try_cast(replace(regexp_extract({0}, '[-+]?[0-9][0-9,]*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?'), ',', '') AS DOUBLE)"
_BARE = r"(CASE WHEN regexp_full_match(regexp_replace({0}, '^[\s*_`''\"$]+|[\s*_`''\"$]+$', '', 'g'), '[+-]?(\d+|\d{{1,3}}(,\d{{3}})+)') THEN replace(regexp_replace({0}, '^[\s*_`''\"$]+|[\s*_`''\"$]+$', '', 'g'), ',', '')::HUGEINT END)"


def _squash(x: str) -> str:
    return _SQUASH.format(x)


EXACT_MATCH = _REPLIES + rf""", q AS (
  SELECT *, CASE kind WHEN 0 THEN e'Well.\nANSWER: no\n> answer = ' || word || e'  # it is\n' WHEN 1 THEN 'I think {{"result": "x"}} or rather {{"answer": "' || word || '"}} ok' WHEN 2 THEN e'Code:\n```py\n' || word || e'\n```\nDone'
    WHEN 3 THEN '  `' || word || '.` ' WHEN 4 THEN '`''' || word || '''` # ' || word WHEN 5 THEN e' \n ' WHEN 6 THEN 'about ' || k || '.0 of them' WHEN 7 THEN 'ANSWER: 1,' || lpad(k::VARCHAR, 3, '0') || ' apples' WHEN 8 THEN k::VARCHAR
    WHEN 9 THEN '"' || word || '"' WHEN 10 THEN '[1, 2] then {{"line": ' || k || '}}' ELSE text END AS reply, kind IN (6, 7, 8, 10) AS numeric,
    CASE WHEN turn % 5 = 4 THEN [] WHEN kind IN (6, 7, 8, 10) THEN [k::VARCHAR, '-1'] ELSE ['nothing', word] END AS gold FROM r
), parts AS (
  SELECT *, regexp_replace(reply, '^\s+|\s+$', '', 'g') AS body, trim(list_last(regexp_extract_all(reply, '(?im)^[ \t>*\-]*answer[ \t]*[:=][ \t]*(.+?)[ \t]*$', 1))) AS line,
    list_last(regexp_extract_all(reply, '\{{"(?:answer|result|line)": "?([^"}}]*)"?\}}', 1)) AS keyed, regexp_extract_all(reply, '(?s)```(?:[a-zA-Z0-9_+-]+)?\n(.*?)```', 1) AS fences FROM q
), found AS (
  SELECT *, CASE WHEN body <> '' THEN coalesce(CASE WHEN regexp_full_match(body, '"[^"]*"') THEN body[2:-2] WHEN regexp_full_match(body, '-?(0|[1-9][0-9]*)') THEN body END, nullif(line, ''), keyed, CASE WHEN len(fences) = 1 THEN trim(fences[1], e' \n\t\r') END, body) END AS answer FROM parts
), hit AS (
  SELECT *, CASE WHEN numeric THEN len(list_filter(gold, lambda g: coalesce(abs({_NUMBER.format("g")} - {_NUMBER.format("answer")}) <= 1e-9 * greatest(abs({_NUMBER.format("g")}), abs({_NUMBER.format("answer")})), false))) > 0
    ELSE len(list_filter(gold, lambda g: {_squash("g")} = {_squash("answer")})) > 0 END AS hit FROM found
)
SELECT conv_id, turn, answer, CASE WHEN len(gold) > 0 AND answer IS NOT NULL AND hit THEN 1.0 ELSE 0.0 END::DOUBLE AS value, CASE WHEN len(gold) = 0 THEN 'grader_error' WHEN answer IS NULL THEN 'unparseable' ELSE 'ok' END AS status FROM hit"""

ANSWER_SET = _REPLIES + rf""", q AS (
  SELECT *, CASE kind % 4 WHEN 0 THEN e'Well.\nANSWER 1: x\n> answer #2 = ' || word || e' \nANSWER 1: **' || format('{{:,}}', k * 1000) || '**' WHEN 1 THEN 'So {{"answers": {{"1": "no"}}}} no, {{"answers": {{"1": ' || k * 1000 || ', "2": "' || word || '", "x": 1}}}}'
    WHEN 2 THEN 'ANSWER 1: $' || k * 1000 || e'$\nanswer 2: +7\nANSWER 9: z' ELSE text END AS reply, turn % 3 = 0 AS numeric, [(k * 1000)::VARCHAR, CASE WHEN kind % 4 = 2 THEN '7' ELSE word END, 'third'] AS g FROM r
), parts AS (
  SELECT *, CASE WHEN turn % 3 = 0 THEN g[1:1] WHEN kind % 4 = 2 THEN g[1:2] ELSE g END AS gold, regexp_extract_all(reply, '(?im)^[ \t>*\-]*answer[ \t]*#?[ \t]*(\d+)[ \t]*[:=][ \t]*(.+?)[ \t]*$', 1) AS ks,
    regexp_extract_all(reply, '(?im)^[ \t>*\-]*answer[ \t]*#?[ \t]*(\d+)[ \t]*[:=][ \t]*(.+?)[ \t]*$', 2) AS vs, regexp_extract_all(list_last(string_split(reply, '"answers": ')), '"(\d+)": "?([^",}}]*)', 1) AS jk,
    regexp_extract_all(list_last(string_split(reply, '"answers": ')), '"(\d+)": "?([^",}}]*)', 2) AS jv FROM q
), got AS (
  SELECT *, CASE WHEN len(ks) > 0 THEN ks WHEN contains(reply, '"answers"') THEN jk ELSE [] END AS k2, CASE WHEN len(ks) > 0 THEN vs WHEN contains(reply, '"answers"') THEN jv ELSE [] END AS v2 FROM parts
), answered AS (
  SELECT *, list_transform(range(1, len(gold) + 1), lambda i: list_last(list_transform(list_filter(range(1, len(k2) + 1), lambda j: k2[j]::INT = i), lambda j: v2[j]))) AS a FROM got
), judged AS (
  SELECT *, len(k2) = 0 AS blank, numeric AND len(list_filter(a, lambda x: x IS NOT NULL AND {_BARE.format("x")} IS NULL)) > 0 AS odd, numeric AND len(list_filter(gold, lambda x: {_BARE.format("x")} IS NULL)) > 0 AS wrong,
    len(list_filter(range(1, len(gold) + 1), lambda i: coalesce(CASE WHEN numeric THEN {_BARE.format("a[i]")} = {_BARE.format("gold[i]")} ELSE {_squash("a[i]")} = {_squash("gold[i]")} END, false))) AS hits FROM answered
)
SELECT conv_id, turn, round(CASE WHEN blank OR odd OR wrong THEN 0 ELSE hits / len(gold) END + 1e-9, 4) AS value, CASE WHEN blank THEN 'unparseable' WHEN wrong THEN 'grader_error' WHEN odd THEN 'unparseable' ELSE 'ok' END AS status,
  CASE WHEN NOT (blank OR odd OR wrong) THEN hits::DOUBLE END AS found FROM judged"""

VERBATIM_ANCHOR = r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '["\\\x00-\x1f]', ' ', 'g') AS text FROM documents),
q AS (SELECT doc_id, text, substr(text, 1, 30) AS a, substr(text, 8, 40) AS b FROM d),
s AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN '' ELSE text END AS source, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN [b] ELSE [a, b, '  ' || a, 'not said there at all', 'of'] END AS raw FROM q
), t AS (
  SELECT doc_id, source, trim(regexp_replace(source, '\s+', ' ', 'g')) AS loose, list_transform(raw, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS quotes FROM s
), w AS (
  SELECT *, list_filter(quotes, lambda x: len(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')) >= 3) AS long FROM t
), n AS (
  SELECT *, len(list_distinct(list_filter(list_transform(long, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: contains(loose, x)))) AS n_loose, len(list_distinct(list_filter(long, lambda x: contains(source, x)))) AS n_strict FROM w
)
SELECT doc_id, round(CASE WHEN loose = '' OR quotes IS NULL THEN 0 ELSE n_loose / greatest(5, len(quotes)) END + 1e-9, 4) AS value, CASE WHEN loose = '' THEN 'grader_error' WHEN quotes IS NULL THEN 'unparseable' ELSE 'ok' END AS status,
  CASE WHEN loose <> '' AND quotes IS NOT NULL THEN n_loose::DOUBLE END AS n_verbatim, round(CASE WHEN source = '' OR quotes IS NULL THEN 0 ELSE n_strict / greatest(2, len(quotes)) END + 1e-9, 4) AS strict FROM n"""

GRADE_CLASSIFICATION = _REPLIES + """, said AS (
  SELECT conv_id, turn AS idx, [1, 0, 1, 0, 1, 0, NULL, 1][k % 8 + 1] AS p FROM r WHERE k % 5 <> 4 AND conv_id % 9 < 7 UNION ALL SELECT DISTINCT conv_id, 999, 1 FROM r WHERE conv_id % 9 < 7
), gold AS (SELECT conv_id, turn AS idx, k % 3 % 2 AS label FROM r WHERE conv_id % 11 <> 10),
met AS (SELECT coalesce(g.conv_id, s.conv_id) AS conv_id, coalesce(g.idx, s.idx) AS idx, label, p, coalesce(p, 1 - label) AS v FROM gold g FULL JOIN (SELECT * FROM said WHERE p IS NOT NULL) s ON g.conv_id = s.conv_id AND g.idx = s.idx),
c AS (
  SELECT conv_id, count(label) AS n, count(*) FILTER (label = 1 AND v = 1) AS tp, count(*) FILTER (label = 0 AND v = 1) AS fp, count(*) FILTER (label = 0 AND v = 0) AS tn, count(*) FILTER (label = 1 AND v = 0) AS fn,
    coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx) FILTER (p IS NULL), '') AS missing_idx, coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx) FILTER (label IS NULL), '') AS extra_idx FROM met GROUP BY conv_id
), m AS (
  SELECT *, (tp + tn) / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
    CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS auroc FROM c
), s AS (SELECT DISTINCT r.conv_id, CASE WHEN coalesce(n, 0) = 0 THEN 'grader_error' WHEN r.conv_id % 9 = 8 THEN 'unparseable' ELSE 'ok' END AS status FROM r LEFT JOIN m ON m.conv_id = r.conv_id)
SELECT s.conv_id, round(CASE WHEN status = 'ok' THEN coalesce(auroc, accuracy) ELSE 0 END + 1e-9, 4) AS value, status, CASE WHEN status = 'ok' THEN n END AS n, CASE WHEN status = 'ok' THEN tp END AS tp, CASE WHEN status = 'ok' THEN fp END AS fp,
  CASE WHEN status = 'ok' THEN tn END AS tn, CASE WHEN status = 'ok' THEN fn END AS fn, CASE WHEN status = 'ok' THEN round(accuracy + 1e-9, 4) END AS accuracy, CASE WHEN status = 'ok' THEN round(precision + 1e-9, 4) END AS precision,
  CASE WHEN status = 'ok' THEN round(recall + 1e-9, 4) END AS recall, CASE WHEN status = 'ok' THEN round(f1 + 1e-9, 4) END AS f1, CASE WHEN status = 'ok' THEN round(auroc + 1e-9, 4) END AS auroc,
  CASE WHEN status = 'ok' THEN missing_idx END AS missing_idx, CASE WHEN status = 'ok' THEN extra_idx END AS extra_idx FROM s LEFT JOIN m ON m.conv_id = s.conv_id"""

VALIDATOR_GRADE = r"""
WITH p AS (
  SELECT p_partkey, p_partkey % 3 AS exit, CASE WHEN p_partkey % 5 = 0 THEN 'Traceback: boom' ELSE e'checking\nVALIDATION FAILED: ' || p_partkey % 8 || e' error(s)\n  - first of ' || p_name || e'\n - second' END AS stderr,
    CASE WHEN p_partkey % 4 = 0 THEN e'item ok\nCHECK PASSED: ' || p_size || e'/50 points\n\n' WHEN p_partkey % 4 = 3 THEN '' ELSE 'CHECK FAILED: ' || p_size || '.5/50 points, ' || p_partkey % 8 || ' items below full' END AS stdout,
    CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey % 8 - (p_partkey % 7 = 0)::INT END AS code FROM part
), v AS (
  SELECT *, try_cast(regexp_extract(stderr, 'VALIDATION FAILED:\s*(\d+)\s+error', 1) AS BIGINT) AS errors, list_last(list_filter(string_split(stdout, chr(10)), lambda x: trim(x) <> '')) AS last FROM p
), c AS (
  SELECT *, try_cast(regexp_extract(last, '^CHECK PASSED: (\d+)/(\d+) points\s*$', 1) AS BIGINT) AS got, try_cast(regexp_extract(last, '^CHECK PASSED: (\d+)/(\d+) points\s*$', 2) AS BIGINT) AS all_,
    try_cast(regexp_extract(last, '^CHECK FAILED: ([\d.]+)/(\d+) points, (\d+) items below full\s*$', 1) AS DOUBLE) AS points, try_cast(regexp_extract(last, '^CHECK FAILED: ([\d.]+)/(\d+) points, (\d+) items below full\s*$', 2) AS BIGINT) AS total,
    try_cast(regexp_extract(last, '^CHECK FAILED: ([\d.]+)/(\d+) points, (\d+) items below full\s*$', 3) AS BIGINT) AS below FROM v
)
SELECT p_partkey, round(CASE WHEN exit = 0 THEN 1 WHEN exit = 1 AND errors IS NOT NULL THEN greatest(0, 1 - errors / 5) ELSE 0 END + 1e-9, 4) AS value, CASE WHEN exit = 0 OR (exit = 1 AND errors IS NOT NULL) THEN 'ok' ELSE 'grader_error' END AS status,
  CASE WHEN exit = 1 AND errors IS NOT NULL THEN regexp_extract(stderr, '(?m)^\s*-\s+(.*)$', 1) END AS first_error,
  round(CASE WHEN got IS NOT NULL THEN (code = 0 AND got = all_)::INT WHEN total IS NOT NULL AND code = below THEN least(1, points / total) ELSE 0 END + 1e-9, 4) AS checked,
  CASE WHEN (got IS NOT NULL AND code = 0 AND got = all_) OR (total IS NOT NULL AND code = below) THEN 'ok' ELSE 'grader_error' END AS check_status, CASE WHEN total IS NOT NULL AND code = below THEN below::DOUBLE END AS below FROM c"""

GRADER_DISPATCH = EVENT_SQL + """SELECT event_id, round(CASE WHEN run_status <> 'ok' THEN 0 WHEN event_type = 'purchase' THEN value WHEN event_type = 'click' THEN (k IN (7, 8))::INT ELSE 0 END + 1e-9, 4) AS value,
  CASE WHEN run_status = 'ok' AND event_type IN ('purchase', 'click') THEN 'ok' ELSE 'grader_error' END AS status,
  CASE WHEN run_status <> 'ok' THEN 'run_status=' || run_status WHEN event_type NOT IN ('purchase', 'click') THEN 'unknown grader ' || event_type END AS reason FROM runs"""

_CHAPTERS = r"""
WITH t AS (
  SELECT p_partkey, 'See the part' || repeat('.', (198 + p_partkey % 5)::INT) || '<XRef id="p' || p_partkey % 4 || '" />. As told by <Cite key={''' || p_brand || '''}/>. twice twice In file <CodeRef path="' || CASE WHEN p_size % 3 = 0 THEN 'b.py' ELSE 'a.py' END || '" line="' || p_size || '" lineEnd="'
    || CASE WHEN p_size % 7 = 0 THEN 'x' ELSE '30' END || '"/>. Elsewhere <BookLink book="b" to="' || CASE WHEN p_size % 2 = 0 THEN '' ELSE 't' END || e'">more</BookLink>. <!-- <Cite key="Brand#12"/> -->\n```\n<Cite key="Brand#12"/>\n```\nzzz <BookLink book="b" to="t"/>' AS text FROM part
), shown AS (SELECT p_partkey, regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?sm)^[ \t]*```.*?^[ \t]*```', '', 'g') AS s FROM t),
a AS (
  SELECT p_partkey, regexp_extract(s, '<XRef id="([^"]*)"', 1) AS id, regexp_extract(s, '<Cite key=\{''([^'']*)''\}', 1) AS cite, regexp_extract(s, '<CodeRef path="([^"]*)"', 1) AS path, try_cast(regexp_extract(s, ' line="([^"]*)"', 1) AS INT) AS lo,
    coalesce(try_cast(regexp_extract(s, 'lineEnd="([^"]*)"', 1) AS INT), -1) AS hi, regexp_extract(s, ' to="([^"]*)"', 1) AS goal, len(regexp_extract_all(s, '<Cite\b')) AS n_cite FROM shown
), f AS (SELECT *, CASE path WHEN 'a.py' THEN 30 WHEN 'b.py' THEN 10 END AS n_lines FROM a),
g AS (SELECT *, coalesce(lo BETWEEN 1 AND n_lines AND hi BETWEEN 1 AND n_lines AND lo <= hi, false) AS fits FROM f)"""

CHAPTER_ITEMS = _CHAPTERS + """, p AS (
  SELECT p_partkey, CASE WHEN p_partkey % 5 > 2 THEN 0.0 WHEN id = 'p1' THEN 1.0 WHEN id IN ('p2', 'p9') AND id IN ('p1', 'p2') THEN 0.5 ELSE 0.0 END::DOUBLE AS p0, (cite = 'Brand#12')::INT::DOUBLE AS p1, (path = 'a.py' AND fits)::INT::DOUBLE AS p2, (goal <> '')::INT::DOUBLE AS p3, (n_cite = 1)::INT::DOUBLE AS p4, 0.0::DOUBLE AS p5, 0.0::DOUBLE AS p6 FROM g
)
SELECT *, round((p0 + p1 + p2 + p3 + p4 + p5 + p6) / 7 + 1e-9, 4) AS value, ((p0 < 1)::INT + (p1 < 1)::INT + (p2 < 1)::INT + (p3 < 1)::INT + (p4 < 1)::INT + 2)::BIGINT AS below FROM p"""

CHAPTER_VIOLATIONS = _CHAPTERS + """SELECT p_partkey, 'xref' AS kind, 1::BIGINT AS n FROM g WHERE id NOT IN ('p1', 'p2') UNION ALL SELECT p_partkey, 'cite', 1 FROM g WHERE cite NOT IN ('Brand#12', 'Brand#13', 'Brand#21')
UNION ALL SELECT p_partkey, 'coderef', 1 FROM g WHERE NOT fits UNION ALL SELECT p_partkey, 'booklink', 1 FROM g WHERE goal = ''"""

RUN_RECORDS = """
WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_id % 13 = 0 AS failed FROM events)
SELECT event_id, CASE WHEN k = 99 THEN 'parse_fail' WHEN k % 7 = 0 AND k % 2 = 0 AND k % 3 = 0 THEN 'rate_limited' WHEN k % 7 = 0 OR failed THEN 'infra_error' ELSE 'ok' END AS run_status,
  round(CASE WHEN k % 11 = 0 THEN 0 ELSE k / 100 END + 1e-9, 4) AS cost_usd, CASE WHEN k = 99 THEN 0 ELSE k END AS num_turns, CASE WHEN k <> 99 THEN 'm-' || k END AS model_resolved, k % 5 = 2 AS usage_drifted,
  CASE WHEN k % 5 = 0 THEN k END AS input_tokens, CASE WHEN k % 5 = 0 THEN 0::BIGINT END AS output_tokens, CASE WHEN k % 5 = 1 THEN k END AS cache_read_tokens, NULL::BIGINT AS cache_creation_tokens, k % 3 = 0 AND k <> 99 AS hard_limit FROM e"""

SWEEP_SUMMARY = EVENT_SQL + """, a AS (SELECT *, CASE k % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'regrade' ELSE 'run' END AS action FROM runs)
SELECT count(*) AS n_cells, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'regrade') AS regraded, count(*) FILTER (action = 'run' AND run_status = 'ok') AS ran, count(*) FILTER (action = 'run' AND run_status <> 'ok') AS failed,
  count(*) FILTER (action <> 'skip' AND run_status = 'ok' AND grade_status = 'ok') AS graded_ok, count(*) FILTER (action <> 'skip' AND run_status = 'ok' AND grade_status = 'unparseable') AS unparseable,
  count(*) FILTER (action <> 'skip' AND run_status = 'ok' AND grade_status = 'grader_error') AS grader_error FROM a"""

TOOL_COUNTS = """
WITH c AS (SELECT user_id, event_type AS t, count(*) AS n FROM events GROUP BY ALL),
u AS (SELECT user_id, string_agg(t || '=' || n, ',' ORDER BY t) AS counts, list(t) AS ts FROM c GROUP BY user_id)
SELECT user_id, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE counts END AS counts,
  CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'click,view,zoom' ELSE array_to_string(list_filter(['click', 'view', 'zoom'], lambda x: NOT list_contains(ts, x)), ',') END AS disallowed,
  CASE WHEN user_id % 5 < 2 THEN 0 ELSE len(list_filter(ts, lambda x: x NOT IN ('click', 'view'))) END::BIGINT AS n_unknown FROM u"""

LABEL_PROMPT = """
SELECT conv_id, md5(string_agg('<msg idx=' || turn || '>' || coalesce(text, '') || '</msg>', chr(10) ORDER BY turn)) AS prompt, string_agg(CASE WHEN role = 'user' THEN '1' ELSE '0' END, '' ORDER BY turn) AS gold FROM conversations GROUP BY conv_id"""

SMALL_FUNCTIONS = r"""
WITH p AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'a:b' WHEN 1 THEN 'with space' ELSE 'srv' END || ': http://' || p_brand AS line FROM part)
SELECT p_partkey, CASE WHEN NOT contains(string_split(line, ': ')[1], ' ') THEN string_split(line, ': ')[1] END AS server, least(60, 2 * pow(2, p_partkey % 9))::DOUBLE AS pause,
  trim(regexp_replace(lower(' ' || p_name || '/' || p_brand), '[^a-z0-9._-]+', '-', 'g'), '-') AS slug, format('{} [{}/low none #{}]', p_name, p_brand, p_size) AS label,
  substr(sha256(length(p_name) || ':' || p_name || '0:' || length(p_type) || ':' || p_type), 1, 12) AS digest, CASE WHEN p_size < 20 THEN 2 WHEN p_size < 40 THEN 3 ELSE 1 END::BIGINT AS level, CASE WHEN p_size BETWEEN 20 AND 39 THEN 'zeal' ELSE '' END AS level_name,
  abs(p_retailprice - p_retailprice * 1.0001) <= 1e-3 * abs(p_retailprice * 1.0001) AS near, p_brand || '-{a}' AS rendered, CASE WHEN p_size = 1 THEN 0 ELSE floor(p_retailprice) END::BIGINT AS whole, md5(p_name || ' x') AS normal FROM p"""

JSON_PAYLOADS = _REPLIES + """SELECT conv_id, turn, CASE WHEN k % 6 < 4 THEN k::VARCHAR END AS payload, CASE WHEN k % 6 < 3 THEN '{"a":' || k || '}' WHEN k % 6 = 3 THEN '[' || k || ']' END AS lenient FROM r"""

LEDGER_LEAKS = """
WITH c AS (SELECT count(*) FILTER (contains(event_type, 'click')) AS clicks, count(*) AS n FROM events)
SELECT field, n FROM (SELECT unnest(['event_type', 'tags', 'nested', 'by_type', 'props']) AS field, unnest([clicks, clicks, clicks, clicks + n, n]) AS n FROM c) WHERE n > 0"""

_CELL = "task_id, model, effort, variant"
REGRADE_SELECTION = LEDGER_SQL + f"""SELECT {_CELL}, tie_part % 4 AS epoch, run_id, 1.0::DOUBLE AS value, 'ok' AS grade_status, 'v9' AS grader_version, grader_version AS regrade_of FROM ledger WHERE run_status = 'ok' AND task_id IN ('1-URGENT', '5-LOW')
QUALIFY row_number() OVER (PARTITION BY {_CELL}, tie_part % 4 ORDER BY ts DESC, run_id DESC, tie_part DESC, tie_supplier DESC, tie_price DESC) = 1"""

TASK_FILTER = LEDGER_SQL + f"""SELECT {_CELL}, NOT EXISTS (SELECT 1 FROM cells o WHERE o.task_id = c.task_id AND o.mean_value >= c.mean_value AND o.mean_latency <= c.mean_latency AND (o.mean_value > c.mean_value OR o.mean_latency < c.mean_latency)) AS pareto,
  min(mean_latency) OVER () > 0 AND max(mean_latency) OVER () >= 10 * min(mean_latency) OVER () AS log_x, true AS bars_fit, coalesce(n_dropped, 0) AS n_dropped FROM cells c LEFT JOIN dropped USING ({_CELL}) WHERE task_id = '1-URGENT'"""

#: Means of resamples of lists ``v`` of (key, measure, v): all n^n up to five values, else ``draws`` hashed ones.
_RESAMPLED = """, resampled AS (
  SELECT key, measure, list_sum(list_transform(v, lambda x, i: v[1 + CASE WHEN n <= 5 THEN floor(m / pow(n, i - 1))::BIGINT % n ELSE floor(('0x' || substr(md5('42:' || (m + 1) || ':' || (i - 1)), 1, 8))::BIGINT / 4294967296 * n)::BIGINT END])) / n AS mean
  FROM (SELECT *, unnest(range(CASE WHEN n <= 5 THEN pow(n, n)::BIGINT ELSE {draws} END)) AS m FROM (SELECT *, len(v) AS n FROM lists) WHERE n >= {least})
), bounds AS (SELECT key, measure, quantile_disc(mean, 0.025) AS low, quantile_disc(mean, 0.975) AS high FROM resampled GROUP BY key, measure)"""



def intervals_sql(source: str, keys: str, measures: dict[str, str], buckets: int = 1024, resamples: int = 200, least: int = 3) -> str:
    """CTEs up to ``intervals``: ``keys`` with the bootstrap bounds of the mean of each measure over ``source``, runs dealt to buckets that have Poisson weights in each resample."""
    poisson = " + ".join(f"(u >= {t})::INT" for t in (24109, 48219, 60273, 64291, 65296, 65497, 65530, 65535))
    sums = ", ".join(f"coalesce(sum(({x})::DOUBLE), 0) AS s_{m}, count({x}) AS k_{m}" for m, x in measures.items())
    means = ", ".join(f"sum(w * s_{m}) / nullif(sum(w * k_{m}), 0) AS m_{m}" for m in measures)
    ends = ", ".join(f"CASE WHEN any_value(n_{m}) >= {least} THEN quantile_disc(m_{m}, {q}) END AS {m}_{end}" for m in measures for end, q in (("low", 0.025), ("high", 0.975)))
    return f""", weights AS (
  SELECT bucket, b, {poisson} AS w FROM (SELECT bucket, b, ('0x' || substr(md5('42:' || bucket || ':' || ((b - 1) // 8)), 1 + 4 * ((b - 1) % 8), 4))::INT AS u FROM range({buckets}) t(bucket), range(1, {resamples + 1}) s(b))
), sums AS (SELECT {keys}, ('0x' || substr(md5(run_id), 1, 8))::BIGINT % {buckets} AS bucket, {sums} FROM {source} GROUP BY ALL),
sizes AS (SELECT {keys}, {", ".join(f"sum(k_{m}) AS n_{m}" for m in measures)} FROM sums GROUP BY ALL),
means AS (SELECT {keys}, b, {means} FROM sums JOIN weights USING (bucket) WHERE w > 0 GROUP BY ALL),
intervals AS (SELECT {keys}, {ends} FROM sizes LEFT JOIN means USING ({keys}) GROUP BY {keys})
"""


CELL_INTERVALS = LEDGER_SQL + ", monthly AS (SELECT * REPLACE (substr(ts, 1, 7) AS variant, NULL::DOUBLE AS cost_usd) FROM grades)" + intervals_sql(
    "monthly", _CELL, {"value": "value", "cost": "cost_usd", "latency": "latency_s", "total_tokens": "input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens"}
) + """SELECT task_id, model, effort, variant, round(value_low + 1e-9, 4) AS value_low, round(value_high + 1e-9, 4) AS value_high, round(latency_low + 1e-9, 4) AS latency_low, round(latency_high + 1e-9, 4) AS latency_high, cost_low,
  round(total_tokens_high + 1e-9, 4) AS total_tokens_high FROM intervals"""

AB_COMPARE = LEDGER_SQL + """, pairs AS (
  SELECT task_id, model, effort, avg(value) FILTER (variant = 'F') AS ma, avg(value) FILTER (variant = 'O') AS mb, count(*) FILTER (grade_status = 'unparseable') AS bad FROM grades WHERE variant IN ('F', 'O') GROUP BY ALL
), kept AS (SELECT *, round(mb - ma, 12) AS diff FROM pairs WHERE ma IS NOT NULL AND mb IS NOT NULL),
lists AS (SELECT task_id AS key, 'diff' AS measure, list(diff ORDER BY model, effort) AS v FROM kept GROUP BY task_id)""" + _RESAMPLED.format(draws=2000, least=2) + """,
tasks AS (SELECT task_id, count(*) AS n_pairs, avg(ma) AS mean_a, avg(mb) AS mean_b, avg(diff) AS delta, count(*) FILTER (diff <> 0) AS n_nonzero, sum(bad)::BIGINT AS n_unparseable, list(diff ORDER BY model, effort) FILTER (diff <> 0) AS d FROM kept GROUP BY task_id),
tested AS (SELECT *, (SELECT avg((abs(s) / n_nonzero >= abs(list_sum(d)) / n_nonzero - 1e-12)::INT::DOUBLE) FROM
  (SELECT list_sum(list_transform(d, lambda x, i: CASE WHEN (m >> (i - 1)) % 2 = 1 THEN x ELSE -x END)) AS s FROM (SELECT unnest(range((1 << n_nonzero)::BIGINT)) AS m))) AS p FROM tasks LEFT JOIN bounds ON key = task_id)
SELECT task_id, n_pairs, round(mean_a + 1e-9, 4) AS mean_a, round(mean_b + 1e-9, 4) AS mean_b, round(delta + 1e-9, 4) AS delta, n_nonzero, n_unparseable, round(p + 1e-9, 4) AS p_value, coalesce(p <= 0.05, false) AS real, round(low + 1e-9, 4) AS ci_low, round(high + 1e-9, 4) AS ci_high,
  coalesce(nullif(concat_ws('; ', CASE WHEN p IS NULL THEN 'all diffs zero — no directional evidence' END, CASE WHEN p IS NOT NULL AND n_nonzero < 6 THEN 'n_nonzero=' || n_nonzero || ' < 6 — p cannot reach 0.05 (min p = ' || ['1', '0.5', '0.25', '0.125', '0.0625'][n_nonzero] || ')' END,
    CASE WHEN low = high THEN 'CI degenerate (all diffs identical)' END), ''), 'exact sign-flip test') AS note FROM tested"""

EPOCH_INTERVAL = EVENT_SQL + """, grades AS (SELECT * FROM (SELECT * FROM runs WHERE run_status = 'ok' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1) WHERE grade_status <> 'grader_error'),
lists AS (SELECT user_id AS key, 'value' AS measure, list(round(value, 6) ORDER BY value) AS v FROM grades GROUP BY user_id)""" + _RESAMPLED.format(draws=2000, least=3) + """
SELECT l.key AS user_id, round(low + 1e-9, 4) AS low, round(high + 1e-9, 4) AS high FROM lists l LEFT JOIN bounds b ON b.key = l.key"""

SHUFFLED_AUROC = """
WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS ones, count(*) FILTER (coalesce(toxic, 1 - quality) = 1) AS said FROM labels JOIN documents USING (doc_id) GROUP BY lang),
e AS (SELECT *, greatest(0, ones + said - n) AS low, unnest(range(greatest(0, ones + said - n), least(ones, said) + 1)) AS k FROM c),
l AS (SELECT *, sum(CASE WHEN k > low THEN ln((ones - k + 1) * (said - k + 1) / (k * (n - ones - said + k))::DOUBLE) ELSE 0 END) OVER (PARTITION BY lang ORDER BY k) AS log_p FROM e),
p AS (SELECT *, exp(log_p - max(log_p) OVER (PARTITION BY lang)) AS p FROM l),
u AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY k) / sum(p) OVER (PARTITION BY lang) AS upto FROM p),
b AS (SELECT lang, n, ones, said, low, b, low + count(*) FILTER (upto < ('0x' || substr(md5('12345:' || b || ':' || lang), 1, 8))::BIGINT / 4294967296) AS tp FROM u, range(200) t(b) GROUP BY lang, n, ones, said, low, b)
SELECT lang, n, round(avg((tp / nullif(ones, 0) + (n - ones - said + tp) / nullif(n - ones, 0)) / 2) + 1e-9, 4) AS shuffled_auroc FROM b GROUP BY lang, n"""


def _horner(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _share_sql(x: str) -> str:
    """The normal law's distribution function; 80 terms of its series."""
    series = "1.0"
    for k in range(80, 0, -1):
        series = f"(1 + {x} * {x} / {2 * k + 1} * {series})"
    return f"CASE WHEN {x} < -7 THEN 0 WHEN {x} > 7 THEN 1 ELSE 0.5 + exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {x} * {series} END"


AUROC_INTERVALS = f"""
WITH m AS (SELECT source, quality AS y, coalesce(1 - toxic, 1 - quality) AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM m GROUP BY source),
pt AS (SELECT *, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS auroc, tp + fp + tn + fn >= 10 AND tp + fn > 0 AND fp + tn > 0 AS fit FROM c),
e AS (SELECT source, unnest(['tp', 'fp', 'tn', 'fn']) AS name, unnest([tp, fp, tn, fn]) AS n FROM pt WHERE fit),
ks AS (SELECT *, unnest(CASE WHEN n > 0 THEN range(greatest(0, n - ceil(10 * sqrt(n))::BIGINT - 20), n + ceil(10 * sqrt(n))::BIGINT + 21) ELSE [0::BIGINT] END) AS k FROM e),
lp AS (SELECT *, sum(CASE WHEN k > low THEN ln(n / k::DOUBLE) ELSE 0 END) OVER (PARTITION BY source, name ORDER BY k) AS log_p FROM (SELECT *, min(k) OVER (PARTITION BY source, name) AS low FROM ks)),
p AS (SELECT *, exp(log_p - max(log_p) OVER (PARTITION BY source, name)) AS p FROM lp),
upto AS (SELECT source, name, k, sum(p) OVER (PARTITION BY source, name ORDER BY k) / sum(p) OVER (PARTITION BY source, name) AS u FROM p),
draws AS (SELECT source, name, b, ('0x' || substr(md5('42:' || b || ':' || name || ':' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296 AS u FROM e, range(1000) t(b)),
d AS (SELECT s.source, s.name, s.b, min(k) AS k FROM draws s JOIN upto t ON s.source IS NOT DISTINCT FROM t.source AND s.name = t.name AND t.u >= s.u GROUP BY s.source, s.name, s.b),
w AS (SELECT source, b, max(k) FILTER (name = 'tp') AS tp, max(k) FILTER (name = 'fp') AS fp, max(k) FILTER (name = 'tn') AS tn, max(k) FILTER (name = 'fn') AS fn FROM d GROUP BY source, b),
x AS (SELECT source, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS x FROM w),
r AS (SELECT source, count(x) AS n_x, min(x) AS lo, max(x) AS hi, (count(*) FILTER (x < auroc - 1e-12) + 0.5 * count(*) FILTER (abs(x - auroc) <= 1e-12)) / nullif(count(x), 0) AS share FROM x JOIN pt USING (source) GROUP BY source),
j AS (SELECT source, unnest([tp, fp, tn, fn]) AS n, unnest([
    CASE WHEN tp > 0 THEN ((tp - 1) / nullif(tp - 1 + fn, 0) + tn / nullif(tn + fp, 0)) / 2 END, CASE WHEN fp > 0 THEN (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp - 1, 0)) / 2 END,
    CASE WHEN tn > 0 THEN (tp / nullif(tp + fn, 0) + (tn - 1) / nullif(tn - 1 + fp, 0)) / 2 END, CASE WHEN fn > 0 THEN (tp / nullif(tp + fn - 1, 0) + tn / nullif(tn + fp, 0)) / 2 END]) AS v FROM pt WHERE fit),
jm AS (SELECT source, sum(n * v) / sum(n) FILTER (v IS NOT NULL) AS m FROM j GROUP BY source),
ja AS (SELECT source, sum(n * (m - v) ** 2) AS sq, sum(n * (m - v) ** 3) AS cu FROM j JOIN jm USING (source) GROUP BY source),
z AS (SELECT *, cu / nullif(6 * sq ** 1.5, 0) AS a, coalesce(lo < hi AND sq > 0 AND share > 0 AND share < 1, false) AS vary, least(share, 1 - share) AS t, share - 0.5 AS q FROM r JOIN ja USING (source)),
zq AS (SELECT *, CASE WHEN NOT vary THEN NULL WHEN t < {TAIL} THEN -sign(q) * {_horner(OUTER, "sqrt(-2 * ln(t))")} / {_horner(OUTER_BELOW, "sqrt(-2 * ln(t))")}
  ELSE q * {_horner(MIDDLE, "(q * q)")} / {_horner(MIDDLE_BELOW, "(q * q)")} END AS z FROM z),
pos AS (SELECT *, z + (z - 1.959963984540054) / (1 - a * (z - 1.959963984540054)) AS xl, z + (z + 1.959963984540054) / (1 - a * (z + 1.959963984540054)) AS xh FROM zq),
pl AS (SELECT source, vary, n_x, ({_share_sql("xl")}) * (n_x - 1) AS hl, ({_share_sql("xh")}) * (n_x - 1) AS hh FROM pos),
o AS (SELECT source, x, row_number() OVER (PARTITION BY source ORDER BY x) - 1 AS i FROM x WHERE x IS NOT NULL),
f AS (SELECT pl.source, vary, sum(x * greatest(0, 1 - abs(i - hl))) AS low, sum(x * greatest(0, 1 - abs(i - hh))) AS high FROM pl JOIN o USING (source) GROUP BY pl.source, vary)
SELECT pt.source, round(auroc + 1e-9, 4) AS auroc, CASE WHEN vary THEN round(low + 1e-9, 4) END AS low, CASE WHEN vary THEN round(high + 1e-9, 4) END AS high, CASE WHEN NOT vary THEN 'degenerate' END AS note FROM pt LEFT JOIN f ON pt.source IS NOT DISTINCT FROM f.source"""

SQL = {
    "auroc_intervals": AUROC_INTERVALS,
    "exact_match": EXACT_MATCH, "answer_set": ANSWER_SET, "verbatim_anchor": VERBATIM_ANCHOR, "grade_classification": GRADE_CLASSIFICATION, "validator_grade": VALIDATOR_GRADE, "grader_dispatch": GRADER_DISPATCH,
    "chapter_items": CHAPTER_ITEMS, "chapter_violations": CHAPTER_VIOLATIONS, "run_records": RUN_RECORDS, "sweep_summary": SWEEP_SUMMARY, "tool_counts": TOOL_COUNTS, "label_prompt": LABEL_PROMPT, "small_functions": SMALL_FUNCTIONS,
    "json_payloads": JSON_PAYLOADS, "regrade_selection": REGRADE_SELECTION, "task_filter": TASK_FILTER, "cell_intervals": CELL_INTERVALS, "ab_compare": AB_COMPARE, "epoch_interval": EPOCH_INTERVAL, "shuffled_auroc": SHUFFLED_AUROC, "ledger_leaks": LEDGER_LEAKS,
}
