"""SQL twins, for an independent engine, of the queries that SQL can express on whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def chat(odd_text: str) -> str:
    """Operator 1: a turn is escaped where it holds a control string or ends in a backslash."""
    text, role = r"(\\*)(### |</turn>)", r"(\\*)(### |</turn>|: )"
    escaped = lambda x, controls: rf"regexp_replace(regexp_replace({x}, '{controls}', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')"
    odd = odd_text.replace("'", "''")
    return rf"""
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{odd}' UNION ALL SELECT -7, 1, 'assistant', '{odd}'),
    marked AS (SELECT *, regexp_matches(text, '### |</turn>') OR regexp_matches(role, '### |</turn>|: ') OR ends_with(text, '\') OR ends_with(role, '\') AS odd FROM turns),
    shown AS (SELECT *, CASE WHEN odd THEN {escaped('role', role)} ELSE role END AS role2, CASE WHEN odd THEN {escaped('text', text)} ELSE text END AS text2 FROM marked)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length(role2) + length(text2) + length('### : </turn>') + 1)::BIGINT AS formatted_chars
    FROM shown GROUP BY conv_id"""


def near_copies(words: int, percent: int = 80) -> str:
    """Operator 2: all pairs that share a shingle, counted; then all documents within reach."""
    last = words - 1
    return rf"""
    WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {last} + 1), lambda i: array_to_string(w[i : i + {last}], ' '))) END AS s FROM split),
    sized AS (SELECT doc_id, len(s) AS n FROM sets),
    held AS MATERIALIZED (SELECT doc_id, unnest(s) AS v FROM sets),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM held a JOIN held b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM sized LEFT JOIN least USING (doc_id)"""


def urls(rules: list[tuple[str, str, str]], otherwise: str = "allow") -> str:
    """Operator 9: the longest rule that fits, by trying each."""
    values = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in rules)
    return rf"""
    WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    rules(verdict, rule_host, rule_path) AS (VALUES {values})
    SELECT page_id, host, path, best.rule, coalesce(best.verdict, '{otherwise}') AS verdict FROM (
        SELECT page_id, host, path, (SELECT arg_max({{'rule': rule_host || rule_path, 'verdict': verdict}}, length(rule_host || rule_path)) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best FROM parts)"""


def filter_orders() -> str:
    """Twin of operator 12: failures a document, then every order of the filters, counted step by step."""
    tests = {
        "A": "len(ws) < 100",
        "B": "100 * len(list_distinct(ws)) < 80 * len(ws)",
        "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)",
        "D": "regexp_matches(t, '[#$%&*|]')",
        "E": "least < doc_id",
    }
    flags = ", ".join(f"({test})::INT AS {name}" for name, test in tests.items())
    fails = "CASE f " + " ".join(f"WHEN '{name}' THEN {name}" for name in tests) + " END"
    return f"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least,
                regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
            FROM documents
        ),
        marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        rows AS (SELECT part, {flags}, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM texts LEFT JOIN marks USING (doc_id) GROUP BY ALL),
        orders AS (
            SELECT '' AS o UNION ALL
            SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)
        ),
        steps AS (SELECT o, k AS step, o[k] AS f FROM orders, range(1, 6) u(k) WHERE length(o) = 5),
        judged AS (
            SELECT part, o, step, f, n, good, toxic, {fails} = 1 AS bad, A + B + C + D + E AS failed,
                {" + ".join(f"(strpos(o, '{name}') < step)::INT * {name}" for name in tests)} > 0 AS gone
            FROM rows, steps
        ),
        counted AS (
            SELECT part, o AS filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS removed,
                coalesce(sum(n) FILTER (gone AND bad), 0) AS redundant, coalesce(sum(n) FILTER (bad AND failed = 1), 0) AS unique_fails,
                coalesce(sum(n) FILTER (NOT gone AND bad AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND bad AND toxic = 1), 0) AS toxic_lost
            FROM judged GROUP BY ALL
        )
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
            good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
        FROM counted
    """
