"""DuckDB SQL with the results of the registered queries, written apart from their code."""

from __future__ import annotations

from sluicebox.functions.rules import PATTERN_RULES
from sluicebox.operators.selection import SEED
from sluicebox.plans.queries import AUDIT, CAP, FIELDS, SNIPPETS, VOCABULARY_MIN

_WORD = r"[\p{L}\p{N}_]"
#: str.isspace(), as a class of code points.
_BLANK = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKEN = rf"[A-Z_a-z]{_WORD}*|\p{{Nd}}+(?:\.\p{{Nd}}+)?|\*\*|//|<<|<=|==|!=|>=|>>|[^{_BLANK}]"
_LINE = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_MODES = "['sql','command_injection','directory_traversal','open_redirect','remote_code_execution','xss','xsrf']"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {_q(_TOKEN)})"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"


def _nonblank(x: str) -> str:
    """Stripped lines without blank ones."""
    return f"list_filter(list_transform(string_split_regex({x}, {_q(_LINE)}), lambda y: {_strip('y')}), lambda y: y <> '')"


def _labelled(columns: str = "d.*") -> str:
    return f"SELECT {columns}, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS quality, coalesce(CAST(l.toxic AS VARCHAR), 'unknown') AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def _starts(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN [] ELSE list_distinct(list_append(range(0, greatest({n} - 200, 0) + 1, 5), greatest({n} - 200, 0))) END"


#: Documents with their parts, and from them tokens and part spans by character.
_PARTS = f"""
    held AS (SELECT d.doc_id, d.text, list(b.text ORDER BY b.item_id) AS parts FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> '' GROUP BY ALL),
    cut AS (SELECT doc_id, {_tokens("text")} AS t, string_split_regex(text, {_q(_TOKEN)}) AS g FROM held),
    tok AS (SELECT doc_id, i, len, sum(gap + len) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM
        (SELECT doc_id, i, length(g[i]) AS gap, length(t[i]) AS len FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM cut))),
    pieces AS (SELECT doc_id, part, string_split(text, part) AS p FROM (SELECT doc_id, text, unnest(parts) AS part FROM held)),
    spans AS (SELECT doc_id, list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(part) AS a, length(part) AS n
        FROM (SELECT *, unnest(range(1, len(p))) AS k FROM pieces)),
    hit AS (SELECT DISTINCT doc_id, i FROM tok JOIN spans USING (doc_id) WHERE b - len < a + n AND a < b),
    docs AS (SELECT doc_id, text, lang, {_tokens("text")} AS t FROM documents),
    win AS (SELECT doc_id, lang, t, unnest({_starts("len(t)")}) AS s FROM docs),
    positive AS (SELECT DISTINCT w.doc_id, w.s FROM win w JOIN tok f ON f.doc_id = w.doc_id AND f.i = w.s + 1
        JOIN tok l ON l.doc_id = w.doc_id AND l.i = least(w.s + 200, len(w.t)) JOIN spans p ON p.doc_id = w.doc_id AND f.b - f.len < p.a + p.n AND p.a < l.b),
    labelled AS (SELECT w.*, CASE WHEN p.s IS NULL THEN 0 ELSE 1 END AS label FROM win w LEFT JOIN positive p ON p.doc_id = w.doc_id AND p.s = w.s)"""

_BALANCE = f"""WITH {_PARTS},
    y AS (SELECT doc_id, count(*) AS n, sum(label) AS p FROM labelled WHERE doc_id IN (SELECT doc_id FROM held) GROUP BY doc_id),
    h AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
    balance AS (SELECT c.doc_id, CAST(len(c.t) AS INTEGER) AS tokens, CAST(coalesce(h.n, 0) AS INTEGER) AS part_tokens, CAST(p AS INTEGER) AS positive,
        CAST(y.n - p AS INTEGER) AS negative, coalesce(h.n, 0)::DOUBLE / len(c.t) AS share FROM cut c JOIN y USING (doc_id) LEFT JOIN h USING (doc_id))"""

_SHINGLES = f"""
    t AS (SELECT doc_id, lang, text, {_tokens("text")} AS t FROM documents),
    items AS (SELECT DISTINCT doc_id, lang, array_to_string(t[i:i + 4], ' ') AS item FROM (SELECT *, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM t WHERE len(t) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
    near AS (SELECT doc_id, earlier_id, similarity FROM (SELECT a.doc_id, b.doc_id AS earlier_id, count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) AS similarity
        FROM items a JOIN items b ON a.item = b.item AND a.lang = b.lang AND b.doc_id < a.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id)
        WHERE similarity >= 0.9::DOUBLE)"""

#: The policy one document after another: those accepted beforehand first, then in the order of doc_id, over those that have a partner.
_GREEDY = f"""WITH RECURSIVE {_SHINGLES},
    lower_t AS (SELECT doc_id, {_tokens("lower(text)")} AS t FROM documents),
    hashed AS (SELECT doc_id, sha256({_strip("regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')")} || chr(0) || {_strip("lang")}) AS h, array_to_string(list_sort(list_distinct(t)), ' ') AS w, doc_id % 7 = 0 AS pinned,
        CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1000000000000 END + doc_id AS place FROM documents JOIN lower_t USING (doc_id)),
    links AS (SELECT a.doc_id AS x, b.doc_id AS y, 1 AS rank, 1.0 AS s FROM hashed a JOIN hashed b ON a.h = b.h UNION ALL SELECT a.doc_id, b.doc_id, 2, 1.0 FROM hashed a JOIN hashed b ON a.w = b.w
        UNION ALL SELECT doc_id, earlier_id, 3, similarity FROM near UNION ALL SELECT earlier_id, doc_id, 3, similarity FROM near),
    edges AS (SELECT l.x AS doc_id, l.y AS earlier_id, rank, a.place, b.place AS earlier_place FROM links l JOIN hashed a ON a.doc_id = l.x JOIN hashed b ON b.doc_id = l.y WHERE b.place < a.place AND NOT a.pinned),
    nodes AS (SELECT doc_id, row_number() OVER (ORDER BY place) AS i, es FROM (SELECT doc_id, any_value(place) AS place, list(DISTINCT earlier_id) AS es FROM edges GROUP BY doc_id)),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone UNION ALL
        SELECT n.i, CASE WHEN len(list_filter(n.es, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, n.doc_id) ELSE w.gone END FROM walk w JOIN nodes n ON n.i = w.i + 1),
    gone AS (SELECT unnest(gone) AS doc_id FROM (SELECT gone FROM walk ORDER BY i DESC LIMIT 1)),
    why AS (SELECT e.doc_id, min((rank, CASE WHEN rank < 3 THEN lpad(CAST(earlier_place AS VARCHAR), 20, '0') ELSE CAST(earlier_id AS VARCHAR) END, earlier_id)) AS m
        FROM edges e WHERE e.doc_id IN (SELECT doc_id FROM gone) AND e.earlier_id NOT IN (SELECT doc_id FROM gone) GROUP BY e.doc_id),
    decided AS (SELECT d.doc_id, w.doc_id IS NULL AS accepted, CASE w.m[1] WHEN 1 THEN 'exact_code_pair' WHEN 2 THEN 'normalized_ast' WHEN 3 THEN 'near_duplicate' END AS failed_check, w.m[3] AS matched_id FROM documents d LEFT JOIN why w USING (doc_id))"""

_COMMITS = f"commits AS (SELECT *, {_MODES}[conv_id % 7 + 1] AS mode, 'real:' || {_MODES}[conv_id % 7 + 1] || ':repo:' || conv_id AS group_id FROM conversations)"
_RANKED = f"ranked AS (SELECT mode, group_id, row_number() OVER (PARTITION BY mode ORDER BY sha256('{SEED}|' || group_id), group_id) AS pos, count(*) OVER (PARTITION BY mode) AS n FROM (SELECT DISTINCT mode, group_id FROM commits))"
_SPLITS = f"""WITH {_COMMITS}, {_RANKED},
    bounds AS (SELECT *, greatest(1, CAST(floor(n * 0.70::DOUBLE) AS BIGINT)) AS train FROM ranked),
    splits AS (SELECT mode, group_id, CASE WHEN pos <= train THEN 'train' WHEN n >= 3 AND pos <= least(greatest(train + 1, CAST(floor(n * 0.85::DOUBLE) AS BIGINT)), n - 1) THEN 'validation' ELSE 'test' END AS split FROM bounds)"""

_REVIEWS = """reviews AS (SELECT d.*, l.quality, l.toxic, l.quality IS NOT NULL AS reviewed, l.toxic = 0 AS required, CASE n_chars % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'not_run' ELSE 'completed' END AS status,
    CASE WHEN n_chars % 9 = 0 THEN 'unsure' WHEN n_chars % 23 = 0 THEN 'maybe' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS verdict,
    CASE WHEN quality = 1 AND n_chars % 7 > 0 THEN 'none' ELSE ['none', 'wrong_cwe', 'incomplete_fix', 'wrong_context', 'runtime_issue', 'other', 'weak fix'][n_chars % 7 + 1] END AS reason_category,
    n_chars % 31 > 0 AS complete, coalesce(quality = 1 AND n_chars > 200 AND n_chars % 31 > 0, false) AS whole FROM documents d LEFT JOIN labels l USING (doc_id))"""
_PASSED = "(status = 'completed' AND verdict = 'pass' AND reason_category = 'none' AND whole)"
_CONSISTENT = "(complete AND verdict IN ('pass', 'fail', 'unsure') AND reason_category <> 'weak fix' AND CASE WHEN verdict = 'pass' THEN whole AND reason_category = 'none' ELSE reason_category <> 'none' END)"

#: documents as a log of records: what of it the reports look at. A safe mode, or unknown.
_LOG = f"""{_REVIEWS}, log AS (SELECT *, doc_id % 13 > 0 AS has_context, doc_id % 11 > 0 AS validated,
        CASE WHEN doc_id % 8 < 7 THEN {_MODES}[doc_id % 8 + 1] WHEN doc_id % 13 = 0 THEN 'unknown' WHEN doc_id % 16 = 7 THEN lang WHEN doc_id % 3 = 0 THEN 'sql' ELSE 'unknown' END AS mode,
        CASE WHEN doc_id % 8 < 7 THEN {_MODES}[doc_id % 8 + 1] WHEN doc_id % 13 > 0 AND doc_id % 16 = 7 THEN lang ELSE 'unknown' END AS export_mode,
        CASE WHEN doc_id % 50 = 1 THEN 'dup' WHEN doc_id % 50 <> 2 THEN 'r' || doc_id END AS id,
        doc_id % 5 = 0 OR (doc_id % 13 > 0 AND doc_id % 7 = 0) AS balanced,
        CASE WHEN doc_id % 13 > 0 THEN ['Flask','Django','CLI','API','script'][doc_id % 5 + 1] ELSE 'unknown' END AS application_type,
        CASE WHEN doc_id % 13 > 0 AND doc_id % 3 = 0 THEN 'direct' ELSE 'unknown' END AS flow_pattern,
        CASE WHEN doc_id % 13 > 0 THEN ['class_based','single_function'][n_chars % 2 + 1] ELSE 'unknown' END AS structure,
        CASE WHEN doc_id % 13 > 0 THEN ['easy','medium','hard'][n_chars % 3 + 1] ELSE 'unknown' END AS difficulty FROM reviews),
    post AS (SELECT *, CASE WHEN NOT validated THEN NULL WHEN doc_id % 4 = 0 AND NOT (mode = 'xss' AND n_chars % 9 > 0 AND n_chars % 5 > 0) THEN 'rules.cwe-79.xss-helper' WHEN doc_id % 4 = 1 THEN 'rules.cwe-89.sql-injection' END AS left_rule FROM log)"""
_PARTS4 = ["application_type", "flow_pattern", "structure", "difficulty"]
_CONTEXT4 = " || '|' || ".join(_PARTS4)


def _count(section: str, key: str, where: str = "true", n: str = "count(*)", source: str = "post") -> str:
    return f"SELECT {section} AS section, {key} AS key, CAST({n} AS BIGINT) AS value FROM {source} WHERE {where} GROUP BY ALL"


def _covered(source: str = "post") -> str:
    one = [_count("'accepted'", "mode", source=source), *[_count(f"mode || '.{f}'", f, source=source) for f in _PARTS4], _count("mode || '.contexts'", _CONTEXT4, source=source), _count("'total'", "'accepted'", source=source), f"SELECT 'accepted', unnest({_MODES}), 0"]
    return f"SELECT section, key, CAST(sum(value) AS BIGINT) AS value FROM ({' UNION ALL '.join(one)}) GROUP BY ALL"


def _validated(source: str = "post") -> str:
    state = "CASE WHEN NOT validated THEN 'missing' WHEN n_chars % 4 > 0 THEN 'passed' ELSE 'failed' END"
    structural = "CASE WHEN NOT validated OR n_chars % 9 = 0 THEN 'missing' WHEN n_chars % 5 > 0 THEN 'passed' ELSE 'failed' END"
    before = "['success', 'missing', 'timeout', 'unknown', 'success', 'unavailable'][doc_id % 6 + 1]"
    rows = [
        _count("'validation'", state, source=source), _count("'structural'", structural, source=source), _count("'warnings'", "'records'", "validated AND n_chars % 3 > 0", source=source), _count("'warnings'", "'count'", "validated AND n_chars % 3 > 0", "sum(n_chars % 3)", source=source),
        _count("'tools.bandit.before'", before, "validated", source=source), _count("'tools.bandit.after'", "'success'", "validated", source=source), _count("'tools.semgrep.before'", "'unavailable'", "validated", source=source),
        _count("'tools.semgrep.after'", "CASE WHEN doc_id % 2 = 0 THEN 'success' ELSE 'unavailable' END", "validated", source=source), _count("'post_fix_rules'", "left_rule", "left_rule IS NOT NULL", source=source),
    ]
    return " UNION ALL ".join(rows)


_SAFE_CATEGORY = "CASE WHEN reason_category = 'weak fix' THEN 'unknown' ELSE reason_category END"


def _reviewed(accepted: str, rejected: str) -> str:
    need = "reviewed AND required"
    a, r = f"({accepted}) AND {need}", f"({rejected}) AND {need}"
    ran = f"{r} AND status <> 'not_run'"
    state = f"CASE WHEN NOT reviewed THEN 'legacy_missing' WHEN NOT required THEN 'skipped' WHEN {_PASSED} THEN 'passed' ELSE 'failed' END"
    values = {"status": "status", "verdict": "verdict", "reason_category": _SAFE_CATEGORY, "provider": "lang"}
    rows = [_count("'review.accepted'", state, accepted), _count("'review.accepted'", "'required'", a), *[_count(f"'review.accepted.{f}'", x, a) for f, x in values.items()]]
    rows += [_count("'review.rejected'", "CASE WHEN status = 'not_run' THEN 'not_run' ELSE 'total' END", r), *[_count(f"'review.rejected.{f}'", x, ran) for f, x in values.items()]]
    return " UNION ALL ".join(rows)


def _rejected(source: str = "judged") -> str:
    rows = [_count("'rejected'", "'total'", source=source), _count("'rejected.by_mode'", "mode", source=source), _count("'rejected.by_category'", "category", source=source)]
    rows += [_count("'rejected.checks'", "CASE WHEN n_chars % 2 = 0 THEN 'near_duplicate' ELSE 'unknown' END", "category = 'diversity'", source=source)]
    rows += [*[_count(f"'rejected.{f}'", f, source=source) for f in _PARTS4], _count("'rejected.contexts'", _CONTEXT4, source=source)]
    return " UNION ALL ".join(rows)


_JUDGED = """judged AS (SELECT *, CASE WHEN toxic = 1 THEN 'diversity' WHEN reviewed AND required AND (status = 'error' OR (status = 'completed' AND verdict <> 'pass')) THEN 'reviewer' WHEN NOT validated THEN 'generation'
    WHEN contains(lower(text), 'badparts') OR contains(lower(text), 'goodparts') THEN 'export_parts' WHEN contains(lower(text), 'bandit') OR contains(lower(text), 'semgrep') OR contains(lower(text), 'tool') THEN 'analyzer_tool' ELSE 'structural_validation' END AS category FROM post)"""

_ISSUES = f"""issues AS (SELECT unnest(list_filter([CASE WHEN NOT validated THEN ('validation', 'missing_validation') END, CASE WHEN validated AND balanced THEN ('validation', 'missing_window_balance_validation') END,
        CASE WHEN validated AND n_chars % 4 = 0 THEN ('validation', 'failed_validation') END, CASE WHEN validated AND n_chars % 9 = 0 THEN ('validation', 'missing_structural_validation') END,
        CASE WHEN validated AND n_chars % 9 > 0 AND n_chars % 5 = 0 THEN ('validation', 'failed_structural_validation') END, CASE WHEN left_rule IS NOT NULL THEN ('validation', 'post_fix_rule_finding') END,
        CASE WHEN reviewed AND required AND NOT {_PASSED} THEN ('review', 'review_not_passed') END], lambda x: x IS NOT NULL)) AS i, id, nullif(mode, 'unknown') AS mode FROM post)"""

_EXPORTED = """exported AS (SELECT *, row_number() OVER (PARTITION BY export_mode ORDER BY doc_id) AS row_index FROM post),
    named AS (SELECT *, coalesce(id, printf('sample_%06d', row_index)) AS commit_id FROM exported)"""

_RUNS = """runs AS (SELECT event_id, event_type AS tool, CASE WHEN user_id % 2 = 0 THEN 'before' ELSE 'after' END AS phase, event_id % 3 AS code,
    CASE WHEN event_type = 'error' THEN 'missing' WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 5 < 2 OR event_id % 3 = 2 THEN 'error' ELSE 'success' END AS status FROM events)"""

_PLACED = f"""placed AS (SELECT doc_id, {_MODES}[doc_id % 7 + 1] AS mode, ['Flask','Django','API'][doc_id // 7 % 3 + 1] AS application_type, ['direct','indirect'][doc_id // 21 % 2 + 1] AS flow_pattern,
    ['class_based','single_function'][doc_id // 5 % 2 + 1] AS structure, ['easy','medium','hard'][doc_id // 11 % 3 + 1] AS difficulty FROM documents)"""

_CONTEXTS = """apps AS (SELECT * FROM (VALUES ('sql', ['Flask','Django','API','script']), ('command_injection', ['Flask','Django','CLI','API','script']), ('directory_traversal', ['Flask','API','CLI','script']),
        ('open_redirect', ['Flask','Django','API']), ('remote_code_execution', ['Flask','Django','CLI','API','script']), ('xss', ['Flask','Django','API']), ('xsrf', ['Flask'])) t(mode, apps)),
    forms AS (SELECT * FROM (VALUES ('single_function', 'direct'), ('class_based', 'direct'), ('class_based', 'indirect'), ('class_based', 'complex'), ('multi_function', 'indirect'), ('multi_function', 'complex')) t(structure, flow_pattern)),
    levels AS (SELECT unnest(['easy', 'medium', 'hard']) AS difficulty),
    contexts AS (SELECT mode, unnest(apps) AS application_type, structure, flow_pattern, difficulty FROM apps, forms, levels)"""

_GUESSES = "guesses AS (SELECT lang, source, quality AS truth, CASE WHEN n_chars % 1000 >= 500 THEN 1 ELSE 0 END AS guess FROM documents JOIN labels USING (doc_id))"


def _confusion(keys: str) -> str:
    cell = lambda t, g: f"count(*) FILTER (WHERE truth = {t} AND guess = {g})"
    return f"SELECT {keys}, {cell(0, 0)} AS tn, {cell(0, 1)} AS fp, {cell(1, 0)} AS fn, {cell(1, 1)} AS tp FROM guesses GROUP BY {keys}"


def _metrics(keys: str) -> str:
    ratio = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"
    f1, f0 = ratio("2 * tp", "2 * tp + fp + fn"), ratio("2 * tn", "2 * tn + fp + fn")
    has1, has0 = "CAST(tp + fp + fn > 0 AS INTEGER)", "CAST(tn + fp + fn > 0 AS INTEGER)"
    return f"""SELECT {keys}, {ratio("tp + tn", "tp + tn + fp + fn")} AS accuracy, {ratio("tp", "tp + fp")} AS "precision", {ratio("tp", "tp + fn")} AS recall, {f1} AS f1,
        {ratio(f"({f1}) * {has1} + ({f0}) * {has0}", f"{has1} + {has0}")} AS macro_f1, tp + tn + fp + fn AS support FROM cells"""


def _vocabulary() -> str:
    return f"""tk AS (SELECT doc_id, {_tokens("text")} AS t FROM documents),
        vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 AS INTEGER) AS index, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM tk) GROUP BY token HAVING count(*) >= {VOCABULARY_MIN}))"""


def _safe_value(x: str) -> str:
    return f"CASE WHEN regexp_full_match({_strip(x)}, '[A-Za-z0-9_.:-]+') THEN {_strip(x)} ELSE 'unknown' END"


_UNSAFE = r"(?i)(?:authorization|bearer\s|api[-_]?key|https?://|[A-Z]:[/\\]|(?:^|[/\\])(?:home|temp|tmp|users)(?:[/\\]|$))"


def _safe_text(x: str) -> str:
    return f"CASE WHEN {_strip(x)} <> '' AND NOT regexp_matches({_strip(x)}, {_q(_UNSAFE)}) THEN {_strip(x)} END"


def _any(x: str, *marks: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(m)})" for m in marks) + ")"


def _predicates() -> str:
    verbs = _any("low", "select ", "insert ", "update ", "delete ")
    flags = {
        "sql": f"""{_any("low", ".execute(", ".executemany(")} AND {verbs} AND (regexp_matches(c, 'execute\\s*\\(\\s*f["'']') OR regexp_matches(c, '=\\s*f["'']') OR regexp_matches(c, 'return\\s+f["'']') OR {_any("c", " + ", " % ", ".format(")})""",
        "shell": _any("c", "shell=True", "os.system(", "subprocess.getoutput("),
        "listed": "contains(c, 'subprocess.run([') AND NOT contains(c, 'shell=True')",
        "path": f"""{_any("low", "request.args", "request.form", "input(", "sys.argv")} AND {_any("low", "open(", "send_file(")} AND NOT {_any("low", ".resolve()", "commonpath", "safe_join")}""",
        "contained": f"""NOT contains(low, '.startswith(') AND CASE WHEN contains(low, 'safe_join(') THEN {_any("low", " is none", "== none")} ELSE {_any("low", ".resolve(", "os.path.realpath(")} AND ({_any("low", ".is_relative_to(", ".relative_to(")} OR (contains(low, '.parents') AND {_any("low", " not in ", " in ")}) OR (contains(low, 'commonpath(') AND {_any("low", "==", "!=")})) END""",
        "redirect": f"""contains(low, 'redirect(') AND {_any("low", "request.args", "next", "target", "url")}""",
        "validated": f"""contains(low, 'redirect(') AND {_any("low", "urlparse", "netloc", "scheme", "startswith", "allowed")}""",
        "dynamic": r"regexp_matches(c, '(^|[^\p{L}\p{M}\p{N}_])(eval|exec|compile)\s*\(')",
        "xss": f"""{_any("low", "render_template_string", "response(")} AND {_any("c", " + ", "%", ".format(", "Markup(", 'f"', "f'")} AND NOT contains(low, 'escape(')""",
        "xss_fix": _any("low", "escape(", "format_html(", "{{", "render_template("),
        "csrf": f"""(contains(low, 'csrf_enabled') AND contains(low, 'false')) OR ({_any("low", "@app.post", 'methods=["post"', "methods=['post'")} AND NOT {_any("low", "csrfprotect", "csrf_protect", "csrfmiddlewaretoken")})""",
        "csrf_fix": _any("low", "csrfprotect", "csrf_protect", "csrfmiddlewaretoken", 'wtf_csrf_enabled"] = true'),
        "csrf_order": "NOT contains(low, 'csrfprotect(app)') OR (contains(low, 'app = flask') AND strpos(low, 'app = flask') < strpos(low, 'csrfprotect(app)'))",
    }
    counts = ", ".join(f"count(*) FILTER (WHERE {x}) AS {n}" for n, x in flags.items())
    snippets = "[" + ", ".join(_q(s) for s in SNIPPETS) + "]"
    return f"SELECT lang, {counts} FROM (SELECT *, lower(c) AS low FROM (SELECT lang, text || {snippets}[doc_id % {len(SNIPPETS)} + 1] AS c FROM documents)) GROUP BY lang"


def _pattern_rules() -> str:
    code = "'return ''' || html || ''' + ' || CASE page_id % 3 WHEN 0 THEN 'escape(x)' WHEN 1 THEN 'redirect(next_url)' ELSE 'csrf.exempt' END"
    parts = []
    for name, (sink, excuse) in PATTERN_RULES.items():
        but = f" AND NOT regexp_matches(c, {_q(excuse)})" if excuse else ""
        parts.append(f"SELECT '{name}' AS rule, count(*) AS n FROM code WHERE regexp_matches(c, {_q(sink)}){but} HAVING count(*) > 0")
    return f"WITH code AS (SELECT {code} AS c FROM pages) " + " UNION ALL ".join(parts)


def _coverage(fields: list[str]) -> str:
    one = " UNION ALL ".join(f"SELECT mode, '{f}' AS field, {f} AS value, count(*) AS n FROM r GROUP BY mode, {f}" for f in fields)
    context = " || '|' || ".join(fields)
    return f"SELECT mode, 'total' AS field, '' AS value, count(*) AS n FROM r GROUP BY mode UNION ALL {one} UNION ALL SELECT mode, 'context', {context}, count(*) FROM r GROUP BY ALL"


def _marked() -> str:
    """The lines that show weakness and fix, each class by its own marks."""
    snippets = "[" + ", ".join(_q(x) for x in SNIPPETS) + "]"
    before = {
        "sql": _any("lower(x)", "execute(", "select", "insert", "update", "delete"), "command_injection": _any("lower(x)", "shell=true", "os.system(", "subprocess.getoutput("), "directory_traversal": _any("lower(x)", "open(", "send_file(", "os.path.join", "request.args", "input("),
        "open_redirect": "contains(x, 'redirect(') AND NOT starts_with(x, 'from ') AND NOT starts_with(x, 'import ')", "remote_code_execution": _any("lower(x)", "eval(", "exec(", "compile("), "xss": _any("lower(x)", "render_template_string", "markup(", 'return "<', "return '<"),
    }
    after = {
        "sql": f"contains(x, 'execute(') AND {_any('x', '?', '%s', ', (')}", "command_injection": _any("x", "subprocess.run([", "shell=False"), "directory_traversal": _any("lower(x)", ".resolve()", "commonpath", "safe_join", "parents", "relative_to"),
        "open_redirect": _any("lower(x)", "urlparse", "netloc", "scheme", "allowed", "startswith"), "remote_code_execution": _any("lower(x)", "literal_eval", "whitelist", "dispatch"), "xss": _any("lower(x)", "escape(", "{{", "render_template("),
        "xsrf": _any("lower(x)", "csrfprotect", "csrf_protect", "csrfmiddlewaretoken", "wtf_csrf_enabled"),
    }
    pick = lambda test: f"len(list_filter(ls, lambda x: {test}))"
    off, posts = pick(_any("lower(x)", "wtf_csrf_enabled", "csrf.exempt")), pick("contains(lower(x), 'methods=') AND contains(lower(x), 'post')")
    b = " ".join(f"WHEN '{m}' THEN {pick(t)}" for m, t in before.items()) + f" WHEN 'xsrf' THEN CASE WHEN {off} > 0 THEN {off} ELSE {posts} END"
    a = " ".join(f"WHEN '{m}' THEN {pick(t)}" for m, t in after.items())
    return f"""WITH c AS (SELECT {_nonblank('t')} AS ls FROM (SELECT text || {snippets}[doc_id % {len(SNIPPETS)} + 1] AS t FROM documents))
        SELECT mode, CAST(sum(CASE mode {b} END) AS BIGINT) AS before_lines, CAST(sum(CASE mode {a} END) AS BIGINT) AS after_lines FROM c, (SELECT unnest({_MODES}) AS mode) GROUP BY mode"""


def _split_of(files: str) -> str:
    """``parted``: dataset, mode, group_id, split of files' groups."""
    return f"""ranks AS (SELECT dataset, mode, group_id, row_number() OVER (PARTITION BY dataset, mode ORDER BY sha256('{SEED}|' || group_id), group_id) AS pos, count(*) OVER (PARTITION BY dataset, mode) AS n FROM (SELECT DISTINCT dataset, mode, group_id FROM {files})),
        parted AS (SELECT dataset, mode, group_id, CASE WHEN pos <= greatest(1, CAST(floor(n * 0.70::DOUBLE) AS BIGINT)) THEN 'train'
            WHEN n >= 3 AND pos <= least(greatest(greatest(1, CAST(floor(n * 0.70::DOUBLE) AS BIGINT)) + 1, CAST(floor(n * 0.85::DOUBLE) AS BIGINT)), n - 1) THEN 'validation' ELSE 'test' END AS split FROM ranks)"""


def _release() -> str:
    return f"""WITH {_COMMITS}, f AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS dataset, mode, group_id, 'f' || turn AS filename, text AS source, string_split(text, ' ')[2] AS part FROM commits), {_split_of('f')},
        k AS (SELECT *, {_tokens('source')} AS t, string_split_regex(source, {_q(_TOKEN)}) AS g, row_number() OVER () AS r FROM f),
        tok AS (SELECT r, i, length(t[i]) AS len, sum(length(g[i]) + length(t[i])) OVER (PARTITION BY r ORDER BY i) AS b FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM k)),
        pieces AS (SELECT r, part, string_split(source, part) AS p FROM k WHERE part <> '' AND part IS NOT NULL),
        spans AS (SELECT r, list_sum(list_transform(p[1:j], lambda x: length(x))) + (j - 1) * length(part) AS a, length(part) AS n FROM (SELECT *, unnest(range(1, len(p))) AS j FROM pieces)),
        win AS (SELECT r, dataset, mode, group_id, filename, t, unnest({_starts('len(t)')}) AS s FROM k),
        hit AS (SELECT DISTINCT w.r, w.s FROM win w JOIN tok f ON f.r = w.r AND f.i = w.s + 1 JOIN tok l ON l.r = w.r AND l.i = least(w.s + 200, len(w.t)) JOIN spans p ON p.r = w.r AND f.b - f.len < p.a + p.n AND p.a < l.b),
        labelled AS (SELECT w.*, CASE WHEN h.s IS NULL THEN 0 ELSE 1 END AS label FROM win w LEFT JOIN hit h ON h.r = w.r AND h.s = w.s),
        kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, label ORDER BY sha256('{SEED}|' || group_id || '|' || filename || '|' || label || '|' || array_to_string(t[s + 1:s + 200], ' ')), s) AS pos FROM labelled) WHERE pos <= 4),
        grid AS (SELECT dataset, mode FROM (SELECT unnest(['real', 'synthetic']) AS dataset), (SELECT unnest({_MODES}) AS mode)),
        per AS (SELECT dataset, mode, count(DISTINCT group_id) AS g, count(*) AS n FROM f GROUP BY ALL)
        SELECT dataset || '_commits' AS section, mode AS key, coalesce(g, 0) AS value FROM grid LEFT JOIN per USING (dataset, mode) UNION ALL SELECT dataset || '_file_records', mode, n FROM per
        UNION ALL SELECT 'windows', dataset || ':' || split, count(*) FROM kept JOIN parted USING (dataset, mode, group_id) GROUP BY ALL
        UNION ALL SELECT 'labels', CASE WHEN label = 1 THEN 'positive_windows' ELSE 'negative_windows' END, count(*) FROM kept GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    fields = ", ".join(FIELDS)
    record_rank = f"sha256('{SEED}|' || doc_id), doc_id"
    norm = f"{_strip('''regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')''')} || chr(0) || {_strip('lang')}"
    path = "regexp_extract(url, '//[^/]+(.*)$', 1)"
    return {
        "lex_tokens": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, sha256(array_to_string(t, ' ')) AS tokens_sha FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
        "token_counts": f"SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST(max(n) AS INTEGER) AS longest FROM (SELECT lang, len({_tokens('text')}) AS n FROM documents) GROUP BY lang",
        "window_starts": f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_windows, CAST(list_max(s) AS INTEGER) AS last_start, CAST(coalesce(list_sum(s), 0) AS BIGINT) AS start_sum FROM (SELECT doc_id, {_starts('n')} AS s FROM (SELECT doc_id, len({_tokens('text')}) AS n FROM documents))",
        "window_rows": f"WITH {_PARTS} SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(len(t[s + 1:s + 200]) AS INTEGER) AS n_tokens, label, md5(array_to_string(t[s + 1:s + 200], ' ')) AS tokens_md5 FROM labelled",
        "window_labels": f"WITH {_PARTS} SELECT d.doc_id, CAST(count(l.s) AS INTEGER) AS windows, CAST(coalesce(sum(label), 0) AS INTEGER) AS positive FROM documents d LEFT JOIN labelled l USING (doc_id) GROUP BY d.doc_id",
        "label_counts": f"WITH {_PARTS} SELECT d.lang, count(DISTINCT d.doc_id) AS docs, count(l.s) AS windows, CAST(coalesce(sum(label), 0) AS BIGINT) AS positive FROM documents d LEFT JOIN labelled l USING (doc_id) GROUP BY d.lang",
        "badpart_spans": f"WITH {_PARTS} SELECT doc_id, CAST(a AS INTEGER) AS span_start, CAST(a + n AS INTEGER) AS span_end FROM spans",
        "window_balance": f"{_BALANCE} SELECT * FROM balance",
        "window_balance_reasons": f"""{_BALANCE} SELECT doc_id, array_to_string(list_filter([CASE WHEN tokens < 420 THEN 'too few tokens' END, CASE WHEN tokens > 900 THEN 'too many tokens' END, CASE WHEN positive < 1 THEN 'no positive window' END,
            CASE WHEN negative < 1 THEN 'no negative window' END, CASE WHEN round(share, 6) > 0.15::DOUBLE THEN 'parts cover too much' END, CASE WHEN round((tokens - part_tokens)::DOUBLE / tokens, 6) < 0.75::DOUBLE THEN 'fix keeps too little' END], lambda x: x IS NOT NULL), ';') AS reasons FROM balance""",
        "window_cap": f"""WITH {_PARTS}, hashed AS (SELECT l.doc_id, label, s, t, count(*) OVER (PARTITION BY l.doc_id) AS n, sha256('{SEED}|' || l.doc_id || '|' || d.source || '|' || label || '|' || array_to_string(t[s + 1:s + 200], ' ')) AS rank FROM labelled l JOIN documents d USING (doc_id))
            SELECT doc_id, label, CAST(s AS INTEGER) AS start, CAST(n AS INTEGER) AS n_windows, md5(array_to_string(t[s + 1:s + 200], ' ')) AS tokens_md5 FROM hashed QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY rank, s) <= 4""",
        "corpus_chunk_rows": f"""SELECT pos // 200 AS chunk, CAST(count(*) AS INTEGER) AS n_tokens, sha256(string_agg(token, ' ' ORDER BY pos)) AS text_sha FROM (SELECT token, row_number() OVER (ORDER BY doc_id % 11 > 0, doc_id, i) - 1 AS pos
            FROM (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS i FROM (SELECT doc_id, {_tokens('lower(text)')} AS t FROM documents))) GROUP BY chunk""",
        "changed_parts": f"""WITH raw AS (SELECT doc_id, i, CASE WHEN i % 2 = 1 THEN '-' ELSE '+' END || x AS line FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
            part AS (SELECT doc_id, left(line, 1) AS sign, {_strip('substr(line, 2)')} AS body, min(i) AS i FROM raw WHERE NOT (starts_with(line, '---') OR starts_with(line, '+++') OR starts_with(line, '@@')) GROUP BY ALL HAVING body <> '')
            SELECT d.doc_id, CAST(count(*) FILTER (WHERE sign = '-') AS INTEGER) AS removed, CAST(count(*) FILTER (WHERE sign = '+') AS INTEGER) AS added,
              sha256(coalesce(string_agg(body, chr(10) ORDER BY sign DESC, i), '')) AS parts_sha FROM documents d LEFT JOIN part p USING (doc_id) GROUP BY d.doc_id""",
        "string_lists": f"""WITH l AS (SELECT doc_id, {_strip('unnest(s)')} AS x, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
            SELECT d.doc_id, CAST(count(x) FILTER (WHERE x <> '') AS INTEGER) AS n_lines, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE x <> ''), '')) AS lines_sha FROM documents d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id""",
        "marker_lines": f"""WITH l AS (SELECT page_id, list_filter({_nonblank('html')}, lambda x: {_any('lower(x)', '<script', '<article', 'onclick')}) AS x FROM pages)
            SELECT page_id, CAST(len(x) AS INTEGER) AS n_lines, sha256(array_to_string(x, chr(10))) AS lines_sha FROM l""",
        "json_objects": "SELECT event_id % 3 AS shape, count(*) AS n, count(k) AS parsed, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events) GROUP BY shape",
        "exact_hash_dups": f"SELECT sha256({norm}) AS pair_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY pair_hash HAVING count(*) > 1",
        "shingles": f"WITH {_SHINGLES} SELECT d.doc_id, CAST(count(item) AS INTEGER) AS n_shingles, min(item) AS least, max(item) AS greatest FROM documents d LEFT JOIN items USING (doc_id) GROUP BY d.doc_id",
        "jaccard_pairs": f"WITH {_SHINGLES} SELECT * FROM near",
        "greedy_dedup": f"{_GREEDY} SELECT * FROM decided",
        "dup_policy_summary": f"{_GREEDY} SELECT coalesce(failed_check, 'accepted') AS outcome, count(*) AS n FROM decided GROUP BY outcome",
        "stable_rank": f"SELECT doc_id, sha256('{SEED}|' || doc_id) AS rank FROM documents",
        "commit_cap": f"WITH {_COMMITS}, {_RANKED} SELECT mode, group_id, turn FROM commits JOIN ranked USING (mode, group_id) WHERE pos <= {CAP}",
        "commit_split": f"{_SPLITS} SELECT * FROM splits",
        "split_counts": f"{_SPLITS} SELECT mode, split, count(DISTINCT group_id) AS groups, count(*) AS files FROM commits JOIN splits USING (mode, group_id) GROUP BY mode, split",
        "audit_pairs": f"""WITH r AS ({_labelled('d.doc_id, d.source, d.lang')}), f AS (SELECT *, count(*) OVER (PARTITION BY source) AS pool, row_number() OVER (PARTITION BY source, {fields} ORDER BY {record_rank}) AS nth FROM r)
            SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY {record_rank}) AS INTEGER) AS audit_rank, doc_id FROM f WHERE pool <= {AUDIT} OR nth = 1
            QUALIFY pool <= {AUDIT} OR row_number() OVER (PARTITION BY source ORDER BY {record_rank}) <= {AUDIT}""",
        "balanced_rounds": f"WITH r AS ({_labelled('d.doc_id, d.source, d.lang')}) SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source, {fields} ORDER BY {record_rank}) AS INTEGER) AS round FROM r",
        "compatible_tuples": f"""WITH {_CONTEXTS}, p AS (SELECT unnest(['compact', 'window_balanced']) AS profile)
            SELECT mode, profile, application_type, structure, count(*) AS contexts FROM contexts, p WHERE profile = 'compact' OR structure <> 'single_function' GROUP BY ALL""",
        "existing_contexts": f"WITH {_CONTEXTS}, {_PLACED} SELECT c.mode, c.application_type, c.flow_pattern, c.structure, c.difficulty, count(p.doc_id) AS n FROM contexts c LEFT JOIN placed p USING (mode, application_type, flow_pattern, structure, difficulty) GROUP BY ALL",
        "coverage_marginals": f"WITH r AS (SELECT source AS mode, * FROM ({_labelled('d.source, d.lang')})) SELECT * FROM ({_coverage(FIELDS)}) WHERE field <> 'context'",
        "coverage_tuples": f"""WITH r AS (SELECT lang AS mode, * FROM ({_labelled('d.source, d.lang')})) SELECT * FROM ({_coverage(['source', 'quality', 'toxic'])}) WHERE field IN ('context', 'total')
            UNION ALL SELECT unnest({_MODES}), 'total', '', 0""",
        "value_counts": f"WITH r AS ({_labelled('d.source, d.lang')}) " + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM r GROUP BY {f}" for f in ["source", *FIELDS]),
        "uncovered_values": f"WITH r AS ({_labelled('d.source, d.lang')}) SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM r) s, (SELECT DISTINCT lang FROM r) l EXCEPT SELECT source, lang FROM r WHERE toxic = '1'",
        "next_sample_id": "SELECT source, source || '_' || printf('%06d', coalesce(max(doc_id) FILTER (WHERE doc_id % 4 < 2), 0) + 1) AS next_id FROM documents GROUP BY source",
        "rejection_category": f"""WITH {_REVIEWS}, w AS (SELECT *, lower(text) || CASE length(text) % 5 WHEN 0 THEN ' tool' WHEN 1 THEN ' badparts' ELSE '' END AS why FROM reviews)
            SELECT CASE WHEN toxic = 1 THEN 'diversity' WHEN reviewed AND required AND (status = 'error' OR (status = 'completed' AND verdict <> 'pass')) THEN 'reviewer' WHEN n_chars % 3 = 0 THEN 'generation'
              WHEN {_any('why', 'badparts', 'goodparts')} THEN 'export_parts' WHEN {_any('why', 'bandit', 'semgrep', 'tool')} THEN 'analyzer_tool' ELSE 'structural_validation' END AS category, lang, count(*) AS n FROM w GROUP BY ALL""",
        "revalidation_category": f"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS x FROM documents), m AS (SELECT lang, lower(x) AS x, ['post_fix_rules', 'post_fix_rules', 'validation', 'path_containment', 'review', 'record_schema', 'validation'][length(x) % 7 + 1] AS own FROM l)
            SELECT CASE WHEN own = 'post_fix_rules' OR {_any('x', 'other classes', 'rules still report')} THEN 'post_fix_rules' WHEN own = 'path_containment' OR contains(x, 'path-safe containment') THEN 'path_containment'
              WHEN own = 'review' OR contains(x, 'reviewer') THEN 'review' WHEN own = 'record_schema' OR contains(x, 'could not be reconstructed') THEN 'record_schema' ELSE 'validation' END AS category, lang, count(*) AS n FROM m GROUP BY ALL""",
        "review_summary": f"""WITH {_REVIEWS} SELECT source, count(*) FILTER (WHERE reviewed AND required) AS required, count(*) FILTER (WHERE reviewed AND required AND {_PASSED}) AS passed, count(*) FILTER (WHERE reviewed AND required AND NOT {_PASSED}) AS failed,
            count(*) FILTER (WHERE reviewed AND NOT required) AS skipped, count(*) FILTER (WHERE NOT reviewed) AS legacy_missing FROM reviews GROUP BY source""",
        "review_states": f"""WITH {_REVIEWS}, n AS (SELECT * FROM reviews WHERE reviewed AND required) SELECT 'status' AS field, status AS value, count(*) AS n FROM n GROUP BY status UNION ALL SELECT 'verdict', verdict, count(*) FROM n GROUP BY verdict
            UNION ALL SELECT 'reason_category', CASE WHEN reason_category = 'weak fix' THEN 'unknown' ELSE reason_category END, count(*) FROM n GROUP BY reason_category UNION ALL SELECT 'provider', lang, count(*) FROM n GROUP BY lang""",
        "review_consistency": f"WITH {_REVIEWS} SELECT lang, count(*) FILTER (WHERE {_CONSISTENT}) AS consistent, count(*) FILTER (WHERE {_PASSED}) AS passed, count(*) AS n FROM reviews WHERE reviewed GROUP BY lang",
        "parsed_reviews": f"WITH {_REVIEWS} SELECT lang, count(*) AS n, count(*) FILTER (WHERE {_CONSISTENT} AND doc_id % 6 > 0) AS parsed FROM reviews WHERE reviewed GROUP BY lang",
        "tool_status_matrix": f"WITH {_RUNS} SELECT tool, phase, status, count(*) AS n FROM runs GROUP BY ALL",
        "tool_messages": f"""WITH {_RUNS} SELECT tool, CASE status WHEN 'success' THEN 'ran' WHEN 'missing' THEN 'scanner is not available' WHEN 'timeout' THEN 'scanner timed out'
            ELSE 'scanner failed to run' || CASE WHEN code = 2 THEN ': last line' ELSE '' END END AS message, count(*) AS n FROM runs GROUP BY ALL""",
        "validation_summary": f"""WITH r AS ({_labelled()}), v AS (SELECT lang, quality <> 'unknown' AS known, n_chars % 2 = 1 AS remains, doc_id % 2 <> 0 AND doc_id % 5 <> 0 AS missed FROM r)
            SELECT lang, count(*) FILTER (WHERE known AND NOT remains) AS passed, count(*) FILTER (WHERE known AND remains) AS failed, count(*) FILTER (WHERE NOT known) AS missing,
            count(*) FILTER (WHERE known AND missed) AS warned, count(*) FILTER (WHERE known AND missed) AS warnings FROM v GROUP BY lang""",
        "rule_verdicts": f"""WITH {_PLACED}, v AS (SELECT mode, doc_id % 2 = 1 AS missing, doc_id % 3 = 0 AS last_left, doc_id % 3 = 1 AS xss_left, doc_id % 5 > 0 AS structural FROM placed),
            r AS (SELECT mode, mode = 'xss' AND last_left AND structural AS helper, missing, CASE WHEN mode = 'xss' THEN last_left OR xss_left ELSE last_left END AS remains, mode <> 'xss' AND xss_left AS other FROM v)
            SELECT mode, count(*) FILTER (WHERE helper) AS warnings, CAST(sum(CAST(missing AS INTEGER) + CAST(remains AND NOT helper AS INTEGER) + CAST(other AS INTEGER)) AS BIGINT) AS reasons,
            count(*) FILTER (WHERE NOT missing AND (NOT remains OR helper) AND NOT other) AS passed FROM r GROUP BY mode""",
        "slot_outcomes": "SELECT conv_id AS slot, count(*) AS attempts, min(turn) FILTER (WHERE role = 'assistant' AND length(text) % 3 = 0) AS accepted_attempt FROM conversations GROUP BY conv_id",
        "safe_value": f"""SELECT page_id, {_safe_value('string_split(url, chr(47))[-1]')} AS last_part, {_safe_value('string_split(url, chr(47))[3]')} AS host, CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE CAST(page_id % 3 AS VARCHAR) END AS number,
            CAST(page_id % 3 AS VARCHAR) AS numeral, CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'unknown' END AS truth FROM pages""",
        "safe_text": f"""WITH w AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' C:/x' ELSE '' END AS whole, list_transform(string_split(text, chr(10)), lambda x: {_safe_text('x')}) AS ls FROM documents)
            SELECT doc_id, sha256({_safe_text('whole')}) AS text_sha, CAST(len(list_filter(ls, lambda x: x IS NULL)) AS INTEGER) AS unsafe_lines, sha256(array_to_string(list_filter(ls, lambda x: x IS NOT NULL), chr(10))) AS lines_sha FROM w""",
        "safe_numbers": "SELECT event_id, CASE WHEN floor(value - 20) >= 0 THEN CAST(floor(value - 20) AS BIGINT) END AS whole, CASE WHEN value - 20 >= 0 THEN round((value - 20) / 7, 6) END AS real FROM events",
        "relative_filename": f"""SELECT page_id, CASE WHEN page_id % 16 = 7 THEN '..' WHEN page_id % 8 = 3 THEN {_strip("'C:app' || " + path)} WHEN f = '' THEN 'app.py' ELSE f END AS filename FROM (SELECT page_id, url, CASE WHEN page_id % 4 = 1 THEN {_strip("'src' || " + path)} ELSE string_split({_strip(path)}, '/')[-1] END AS f FROM pages)""",
        "fold_names": """SELECT CASE doc_id % 3 WHEN 0 THEN 'directory_traversal' WHEN 1 THEN source ELSE '' END AS mode, CASE WHEN doc_id % 2 = 0 THEN 'window_balanced' ELSE 'compact' END AS planned,
            CASE WHEN doc_id % 2 = 0 THEN 'window_balanced' ELSE 'unknown' END AS verified, count(*) AS n FROM documents GROUP BY ALL""",
        "finding_ids": "SELECT array_to_string(list_sort(list_distinct(['x.other.' || event_type, event_type, 'rules.' || event_type, 'rules.' || event_type || '', 'rules.d.rules.' || event_type, CASE WHEN event_type = 'click' THEN 'known.rules.click' ELSE 'rules.' || event_type END])), chr(10)) AS ids, count(*) AS n FROM events GROUP BY ids",
        "row_index": "SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS row_index FROM documents",
        "last_wins": "SELECT conv_id, arg_max(role, turn) AS role, sha256(arg_max(text, turn)) AS text_sha FROM conversations GROUP BY conv_id",
        "dup_ids": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
        "export_rows": f"""SELECT lang AS mode, 'curated/' || lang AS repo, CASE WHEN doc_id % 5 > 0 THEN 'c' || doc_id ELSE printf('sample_%06d', row_number() OVER (PARTITION BY lang ORDER BY doc_id)) END AS commit_id,
            source AS msg, source || '.py' AS filename, sha256({_strip('text')} || chr(10)) AS before_sha FROM documents""",
        "nested_flatten": f"""SELECT lang AS mode, 'curated/' || lang AS repo, CASE WHEN doc_id % 5 > 0 THEN 'c' || doc_id ELSE printf('sample_%06d', row_number() OVER (PARTITION BY lang ORDER BY doc_id)) END AS commit_id,
            source || '.py' AS filename, source AS msg, sha256({_strip('text')} || chr(10)) AS source_sha, 2 AS n_badparts FROM documents""",
        "integrity_diff": """WITH o AS (SELECT CASE WHEN n_chars % 17 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN n_chars % 11 = 0 THEN lower(text) ELSE text END AS text FROM documents WHERE n_chars % 13 > 0)
            SELECT coalesce(d.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS state
            FROM documents d FULL JOIN o ON o.doc_id = d.doc_id WHERE o.doc_id IS NULL OR d.doc_id IS NULL OR d.text <> o.text""",
        "link_check": "SELECT 'r' AS repo, CAST(a.conv_id AS VARCHAR) AS commit_id, 'f' || (a.turn + 1) AS filename FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)",
        "confusion_matrix": f"WITH {_GUESSES} {_confusion('lang')}",
        "metric_rows": f"WITH {_GUESSES}, cells AS ({_confusion('lang')}) {_metrics('lang')}",
        "mean_macro_f1": f"WITH {_GUESSES}, cells AS ({_confusion('source, lang')}), m AS ({_metrics('source, lang')}) SELECT source, round(avg(macro_f1), 9) AS mean_macro_f1 FROM m GROUP BY source",
        "conditions_union": """WITH r AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS dataset, ['train', 'validation', 'test'][turn % 3 + 1] AS split FROM conversations),
            uses AS (SELECT * FROM (VALUES ('A', 'real', 'train'), ('B', 'synthetic', 'train'), ('C', 'real', 'train'), ('C', 'synthetic', 'train'), ('A', 'real', 'validation'), ('B', 'synthetic', 'validation'), ('C', 'real', 'validation'), ('A', 'real', 'test'), ('B', 'real', 'test'), ('C', 'real', 'test')) t(condition, dataset, split))
            SELECT condition, split AS role, dataset, count(*) AS n FROM r JOIN uses USING (dataset, split) GROUP BY ALL""",
        "vocabulary": f"WITH {_vocabulary()} SELECT * FROM vocab",
        "token_id_sequence": f"""WITH {_vocabulary()}, ids AS (SELECT doc_id, i, coalesce(v.index + 1, 0) AS id FROM (SELECT doc_id, unnest(range(1, 201)) AS i, t FROM tk) x LEFT JOIN vocab v ON v.token = x.t[x.i])
            SELECT doc_id, CAST(count(*) FILTER (WHERE id > 0) AS INTEGER) AS known, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY i)) AS ids_sha FROM ids GROUP BY doc_id""",
        "mean_pool": """WITH w AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding) AS x FROM embeddings), u AS (SELECT DISTINCT user_id AS who FROM events),
            p AS (SELECT user_id AS who, dim, CAST(sum(CAST(CAST(x AS DOUBLE) AS DECIMAL(20, 10))) AS DOUBLE) / count(*) AS v FROM events JOIN w ON vec_id = CAST(json_extract_string(props, '$.k') AS BIGINT) GROUP BY ALL)
            SELECT who, CAST(dim AS INTEGER) AS dim, round(coalesce(v, 0), 6) AS value FROM u CROSS JOIN (SELECT unnest(range(64)) AS dim) LEFT JOIN p USING (who, dim)""",
        "coverage_report": f"WITH {_LOG} {_covered()}",
        "validation_report": f"WITH {_LOG} {_validated()}",
        "review_report": f"WITH {_LOG} {_reviewed("lang = 'en'", "lang <> 'en'")}",
        "rejection_report": f"WITH {_LOG}, {_JUDGED} {_rejected()}",
        "record_issues": f"WITH {_LOG}, {_ISSUES} SELECT i[1] AS stage, i[2] AS code, mode, count(*) AS n, count(id) AS named FROM issues GROUP BY ALL",
        "export_counts": f"WITH {_LOG}, {_EXPORTED} SELECT m.mode, count(DISTINCT commit_id) AS commits FROM (SELECT unnest({_MODES}) AS mode) m LEFT JOIN named n ON n.export_mode = m.mode GROUP BY m.mode",
        "sidecar_rows": f"""WITH {_LOG}, {_EXPORTED} SELECT export_mode AS mode, CAST(row_index AS INTEGER) AS row_index, commit_id, coalesce(id, commit_id) AS id, CASE WHEN balanced THEN 'window_balanced' ELSE 'compact' END AS generation_profile,
            CASE WHEN has_context THEN application_type END AS context_application_type, CASE WHEN has_context THEN ['direct', NULL, 'complex flow'][doc_id % 3 + 1] END AS context_flow_pattern,
            CASE WHEN validated AND n_chars % 4 > 0 THEN 'true' ELSE 'false' END AS validation_summary_passed, CAST(CASE WHEN validated THEN len(string_split(text, chr(10))) ELSE 0 END AS VARCHAR) AS validation_summary_reason_count,
            CASE WHEN validated AND n_chars % 9 > 0 THEN 'a' END AS validation_summary_structural_vulnerable_markers, CASE WHEN validated THEN ['success', 'missing', 'timeout', 'unknown', 'success', 'unavailable'][doc_id % 6 + 1] ELSE 'unavailable' END AS validation_summary_bandit_before_status,
            CASE WHEN validated AND doc_id % 4 = 0 THEN 'lib.rules.cwe-79.xss-helper' WHEN validated AND doc_id % 4 = 1 THEN 'other.rule' END AS validation_summary_semgrep_after_finding_ids, CASE WHEN reviewed THEN verdict END AS review_summary_verdict FROM named""",
        "integrity_issues": f"""WITH {_LOG}, {_EXPORTED}, known AS (SELECT * FROM named WHERE list_contains({_MODES}, export_mode)), found AS (
              SELECT 'duplicate_accepted_id' AS code, NULL AS mode FROM (SELECT id FROM post WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
              UNION ALL SELECT 'unknown_export_mode', nullif(export_mode, 'unknown') FROM (SELECT DISTINCT export_mode FROM named WHERE NOT list_contains({_MODES}, export_mode))
              UNION ALL SELECT DISTINCT 'plain_payload_mismatch', export_mode FROM known WHERE (export_mode = 'xss' AND commit_id LIKE '%8') OR (export_mode = 'sql' AND commit_id LIKE '%9')
              UNION ALL SELECT 'sidecar_link_missing', nullif(export_mode, 'unknown') FROM named WHERE commit_id LIKE '%77' OR (export_mode = 'xss' AND commit_id LIKE '%8')
              UNION ALL SELECT 'unexpected_plain_file', 'odd' UNION ALL SELECT 'plain_file_missing', 'sql' UNION ALL SELECT 'metadata_missing', NULL)
            SELECT code, mode, count(*) AS n FROM found GROUP BY ALL""",
        "plan_marginals": f"""WITH {_CONTEXTS}, {_PLACED}, c AS (SELECT c.*, (SELECT count(*) FROM placed p WHERE p.mode = c.mode AND p.application_type = c.application_type AND p.flow_pattern = c.flow_pattern AND p.structure = c.structure AND p.difficulty = c.difficulty) AS n FROM contexts c)
            """ + " UNION ALL ".join(f"SELECT mode, '{f}' AS field, {f} AS value, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL" for f in _PARTS4),
        "candidate_fields": f"""WITH e AS (SELECT a.conv_id, a.turn, a.text AS b, c.text AS a FROM conversations a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 1),
            r AS (SELECT *, CASE WHEN conv_id % 8 = 2 THEN 'no JSON object' WHEN turn % 5 = 0 OR {_strip('b')} = '' OR {_strip('a')} = '' THEN
              'missing fields: ' || array_to_string(list_filter([CASE WHEN turn % 5 = 0 THEN 'commit_message' END, CASE WHEN {_strip('b')} = '' THEN 'vulnerable_code' END, CASE WHEN {_strip('a')} = '' THEN 'fixed_code' END], lambda x: x IS NOT NULL), ', ') END AS error FROM e)
            SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN CASE WHEN turn % 2 = 0 THEN 'a/b.py' ELSE 'app.py' END END AS filename, CASE WHEN error IS NULL THEN 'fix ' || turn END AS commit_message,
              CASE WHEN error IS NULL THEN sha256({_strip('b')} || chr(10)) END AS before_sha, CASE WHEN error IS NULL THEN {_strip('string_split(b, chr(10))[1]')} END AS first_part FROM r""",
        "marked_lines": _marked(),
        "response_texts": "SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN sha256(text || chr(10) || 'end') WHEN 4 THEN NULL ELSE sha256(text) END AS text_sha FROM conversations",
        "prompt_texts": f"WITH {_PLACED}, p AS (SELECT mode, CASE WHEN mode = 'xss' AND application_type IN ('Flask', 'API') THEN doc_id % 4 ELSE -1 END AS form, application_type, flow_pattern, structure, difficulty FROM placed) SELECT mode, count(*) AS n, count(DISTINCT (form, application_type, flow_pattern, structure, difficulty)) AS distinct_prompts FROM p GROUP BY mode",
        "release_report": _release(),
        "missing_slices": f"""WITH f AS (SELECT CASE WHEN conv_id % 5 = 0 THEN 'synthetic' ELSE 'real' END AS dataset, mode, group_id FROM ({_COMMITS.split(' AS (', 1)[1][:-1]})), {_split_of('f')},
            need AS (SELECT * FROM (VALUES ('real', 'train'), ('real', 'validation'), ('real', 'test'), ('synthetic', 'train'), ('synthetic', 'validation')) t(dataset, split))
            SELECT mode, dataset, split FROM (SELECT unnest({_MODES}) AS mode), need EXCEPT SELECT mode, dataset, split FROM parted""",
        "loaded_records": f"""WITH {_LOG} SELECT {_MODES}[doc_id % 8 + 1] AS mode, count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS with_parts, count(*) FILTER (WHERE NOT has_context) AS unknown_flow,
            min('synthetic:' || {_MODES}[doc_id % 8 + 1] || ':curated:' || id) AS first_group FROM post WHERE doc_id % 8 < 7 AND id IS NOT NULL GROUP BY ALL""",
        "rule_regex_flags": _pattern_rules(),
        "text_predicates": _predicates(),
    }
