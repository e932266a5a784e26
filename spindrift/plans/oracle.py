"""The same answers in DuckDB SQL, stated from the semantics and not from the Spark plans."""

from __future__ import annotations

from spindrift.plans.derived import LINK_FORMS, ROBOTS

SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"
BASE = "TIMESTAMP '2024-01-01 00:00:00'"


def scheme(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '^({SCHEME}):', 1)), '')"


def host(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '^(?:{SCHEME}:)?//([^/?#:]*)', 1)), '')"


def port(u: str) -> str:
    return f"try_cast(nullif(regexp_extract({u}, '^(?:{SCHEME}:)?//[^/?#]*:([0-9]+)', 1), '') AS INTEGER)"


def path(u: str) -> str:
    return f"nullif(regexp_extract({u}, '^(?:{SCHEME}:)?(?://[^/?#]*)?([^?#]*)', 1), '')"


def query(u: str) -> str:
    return rf"nullif(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '')"


def fragment(u: str) -> str:
    return f"nullif(regexp_extract({u}, '^[^#]*#(.*)$', 1), '')"


def content_key(u: str, html: str) -> str:
    encoded = f"replace(replace(url_encode(coalesce({query(u)}, '')), '%20', '+'), '~', '%7E')"
    return f"md5({host(u)} || coalesce({path(u)}, '')) || CASE WHEN {html} THEN {encoded} ELSE '' END"


def rank(*keys: str) -> str:
    """Position in the order of the key's md5, then the key."""
    text = f"md5(concat_ws(chr(10), {', '.join(keys)}))"
    return f"row_number() OVER (ORDER BY {text}, {', '.join(keys)})"


def mixed_html() -> str:
    html = "html"
    for letters, form in LINK_FORMS:
        html = f"""regexp_replace({html}, 'href="/([{letters}])', 'href="{form}\\1', 'g')"""
    return html


# The link pattern and the pattern of robots lines, as DuckDB writes them.
LINK = """(?i)<a.+?href=("|'')(.+?)("|'')"""
DIRECTIVE = "(?i)^((dis)?allow|user-agent)[^:]*:.+"


def found(pages: str) -> str:
    return f"""SELECT page_id, url, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS pos, unnest(h) AS href
    FROM (SELECT page_id, url,
          regexp_extract_all(html, '{LINK}', 2) AS h FROM {pages})"""


def resolved(links: str) -> str:
    return f"""SELECT page_id, url, pos, href, CASE
      WHEN regexp_matches(href, '^{SCHEME}:') THEN href
      WHEN starts_with(href, '//') THEN split_part(url, '/', 1) || href
      WHEN starts_with(href, '/') THEN origin || href
      WHEN starts_with(href, '?') THEN origin || p || href
      WHEN starts_with(href, '../') THEN origin || regexp_replace(d, '[^/]+/$', '') || substr(href, 4)
      WHEN starts_with(href, './') THEN origin || d || substr(href, 3)
      ELSE origin || d || href END AS resolved
    FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, coalesce({path('url')}, '/') AS p,
          regexp_extract(coalesce({path('url')}, '/'), '^(.*/)', 1) AS d FROM {links})"""


def normalized(links: str) -> str:
    return f"""SELECT page_id, url, pos, href, resolved,
      coalesce({scheme('resolved')}, {scheme('url')}) AS scheme,
      coalesce({host('resolved')}, {host('url')}) AS host,
      coalesce({path('resolved')}, '/') AS path,
      {query('resolved')} AS query, {fragment('resolved')} AS fragment,
      coalesce({scheme('resolved')}, {scheme('url')}) IN ('http', 'https') AS scheme_supported
    FROM {links}"""


def domains(pages: str) -> str:
    return f"""SELECT id, name, {BASE} + to_hours(CAST(id % 3 - 1 AS BIGINT)) AS next_visit
    FROM (SELECT {rank('name')} AS id, name FROM (SELECT DISTINCT {host('url')} AS name FROM {pages}))"""


def queues(pages: str, domain: str) -> str:
    return f"""SELECT page_id AS id, url, {BASE} + to_seconds(page_id * 7919 % 100) AS added, d.id AS domain_id
    FROM {pages} JOIN {domain} d ON d.name = {host('url')}"""


def urls(pages: str, domain: str) -> str:
    return f"""SELECT {rank('path', 'domain_id', 'scheme_id')} AS id, path, domain_id, scheme_id FROM (
      SELECT DISTINCT coalesce({path('url')}, '/') AS path, d.id AS domain_id,
        CASE {scheme('url')} WHEN 'http' THEN 0 ELSE 1 END::BIGINT AS scheme_id
      FROM {pages} JOIN {domain} d ON d.name = {host('url')})"""


def grown_domains(domain: str, names: str, now: str) -> str:
    return f"""SELECT id, name, next_visit FROM {domain} UNION ALL
    SELECT (SELECT coalesce(max(id), 0) FROM {domain}) + {rank('name')}, name, {now}
    FROM (SELECT DISTINCT host AS name FROM {names} WHERE host IS NOT NULL AND host NOT IN (SELECT name FROM {domain}))"""


def grown_urls(url: str, targets: str) -> str:
    return f"""SELECT id, path, domain_id, scheme_id FROM {url} UNION ALL
    SELECT (SELECT coalesce(max(id), 0) FROM {url}) + {rank('path', 'domain_id', 'scheme_id')},
      path, domain_id, scheme_id
    FROM (SELECT path, domain_id, scheme_id FROM {targets} EXCEPT SELECT path, domain_id, scheme_id FROM {url})"""


def grown_queue(queue: str, wanted: str, now: str, given: str | None = None) -> str:
    """``wanted`` has columns url and domain_id; ``given`` holds all ids given so far, by default those in the queue."""
    return f"""SELECT id, url, added, domain_id FROM {queue} UNION ALL
    SELECT (SELECT coalesce(max(id), 0) FROM {given or queue}) + {rank('url')}, url, {now}, domain_id
    FROM (SELECT url, min(domain_id) AS domain_id FROM {wanted}
          WHERE url NOT IN (SELECT url FROM {queue}) GROUP BY url)"""


def with_ids(links: str, domain: str) -> str:
    return f"""SELECT n.*, d.id AS domain_id, CASE n.scheme WHEN 'http' THEN 0 ELSE 1 END::BIGINT AS scheme_id
    FROM {links} n JOIN {domain} d ON d.name = n.host WHERE n.scheme_supported"""


def outcome(status: str, content_type: str, body: str) -> str:
    return f"""CASE WHEN coalesce({status}, '') NOT IN ('HTTP/1.1 200 OK', 'HTTP/1.0 200 OK') THEN 'skipped'
      WHEN contains(lower({content_type}), 'text/html') THEN 'html'
      WHEN length({body}) = 0 THEN 'empty' ELSE 'other' END"""


def fetched(pages: str) -> str:
    return f"""SELECT url,
      CASE page_id % 10 WHEN 0 THEN 'HTTP/1.1 404 Not Found' WHEN 1 THEN 'HTTP/1.1 301 Moved Permanently'
        WHEN 4 THEN 'HTTP/1.0 200 OK' ELSE 'HTTP/1.1 200 OK' END AS status_line,
      CASE WHEN page_id % 10 IN (2, 3) THEN 'application/pdf' WHEN page_id % 10 = 4 THEN 'text/html; charset=utf-8'
        ELSE 'text/html' END AS content_type,
      CASE WHEN page_id % 10 = 3 THEN '' ELSE html END AS body,
      {BASE} + to_seconds(page_id) AS fetched_at
    FROM {pages}"""


def verdicts(targets: str, key: str, agent: str) -> str:
    """Blocked keys of ``targets`` (columns key, host, target) for an agent."""
    return f"""SELECT {key} FROM (
      SELECT t.{key}, r.allow FROM {targets} t JOIN rules r ON r.host = t.host
      WHERE r.agent = CASE WHEN EXISTS (SELECT 1 FROM rules o WHERE o.host = t.host AND o.agent = '{agent}')
                      THEN '{agent}' ELSE '*' END
        AND regexp_matches(t.target, r.regex)
      QUALIFY row_number() OVER (PARTITION BY t.{key} ORDER BY r.rule_len DESC, r.pos DESC) = 1)
    WHERE NOT allow"""


def robots_target(u: str) -> str:
    return f"""coalesce({path(u)} || coalesce('?' || {query(u)}, '') || coalesce('#' || {fragment(u)}, ''), {u})"""


def robots_bodies() -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ROBOTS.items())
    return f"SELECT name AS host, CASE id % 4 {cases} END AS body FROM domain WHERE id % 4 <> 0"


COMMON = {
    "mixed": f"SELECT page_id, url, {mixed_html()} AS html FROM pages",
    "secure": "SELECT * FROM pages WHERE url LIKE 'https:%'",
    "plain_found": found("pages"),
    "mixed_found": found("mixed"),
    "plain_resolved": resolved("plain_found"),
    "mixed_resolved": resolved("mixed_found"),
    "plain_links": normalized("plain_resolved"),
    "mixed_links": normalized("mixed_resolved"),
    "domain": domains("pages"),
    "queue": queues("pages", "domain"),
    "url": urls("pages", "domain"),
    "s_domain": domains("secure"),
    "s_queue": queues("secure", "s_domain"),
    "s_url": urls("secure", "s_domain"),
    "supported": "SELECT * FROM mixed_links WHERE scheme_supported",
    "g_domain": grown_domains("s_domain", "supported", BASE),
    "targets": with_ids("mixed_links", "g_domain"),
    "fetches": fetched("pages"),
    "refetched": """SELECT * FROM fetches UNION ALL
      SELECT url, status_line, content_type, body || ' again', fetched_at + INTERVAL 1 HOUR FROM fetches""",
    "classified": f"""SELECT r.*, {outcome('status_line', 'content_type', 'body')} AS outcome, d.id AS domain_id
      FROM refetched r JOIN domain d ON d.name = {host('r.url')}""",
    "contents": f"""SELECT domain_id, content_key, url, body, fetched_at FROM (
        SELECT *, {content_key('url', "outcome = 'html'")} AS content_key FROM classified
        WHERE outcome IN ('html', 'other'))
      QUALIFY row_number() OVER (PARTITION BY domain_id, content_key
        ORDER BY fetched_at DESC, url DESC, md5(body) DESC) = 1""",
    "robots": robots_bodies(),
    "lines": """SELECT host, pos, trim(regexp_replace(raw, '#.*$', '')) AS text FROM (
        SELECT host, unnest(string_split(body, chr(10))) AS raw,
          CAST(generate_subscripts(string_split(body, chr(10)), 1) - 1 AS INTEGER) AS pos FROM robots)""",
    "fields": """SELECT host, pos, lower(trim(split_part(text, ':', 1))) AS field,
        trim(split_part(text, ':', 2)) AS pattern
      FROM lines WHERE regexp_matches(text, '"""
    + DIRECTIVE
    + """')""",
    "owned": """SELECT *, last_value(CASE WHEN field = 'user-agent' THEN pattern END IGNORE NULLS)
        OVER (PARTITION BY host ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent
      FROM fields""",
    "rules": r"""SELECT host, agent, pos, pattern, regex, CAST(strlen(regex) AS INTEGER) AS rule_len,
        NOT starts_with(field, 'dis') AS allow
      FROM (SELECT *, replace(regexp_replace(
              regexp_replace(pattern, '([\\^+?.()\[\]{}|$])', '\\\1', 'g'), '\\\$$', '$'), '*', '.*') AS regex
            FROM owned WHERE field <> 'user-agent' AND agent <> '' AND pattern <> '')""",
    "page_targets": f"SELECT page_id, url, {host('url')} AS host, {robots_target('url')} AS target FROM pages",
    "list": """SELECT u.id, CASE u.scheme_id WHEN 0 THEN 'http' ELSE 'https' END AS http, d.name AS host,
        u.path AS url, CASE u.scheme_id WHEN 0 THEN 'http' ELSE 'https' END || '://' || d.name || u.path AS link
      FROM url u JOIN domain d ON d.id = u.domain_id""",
    "statuses": f"""SELECT {host('url')} AS host, coalesce({path('url')}, '/') AS path,
        bool_or(status_line IN ('HTTP/1.1 200 OK', 'HTTP/1.0 200 OK')) AS ok,
        min(CASE WHEN status_line NOT IN ('HTTP/1.1 200 OK', 'HTTP/1.0 200 OK') THEN status_line END) AS failure
      FROM fetches GROUP BY ALL""",
    "from_to": f"SELECT *, {host('url')} AS from_host FROM mixed_links",
    "words": r"""SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents""",
    "posted": "SELECT term, doc_id, CAST(count(*) AS BIGINT) AS tf FROM words WHERE term <> '' GROUP BY ALL",
    # State before a first crawl step, and the fetches of pages with all forms of link.
    "queue_0": "SELECT * FROM queue",
    "domain_0": "SELECT * FROM domain",
    "url_0": "SELECT * FROM url",
    "tried_0": "SELECT url FROM pages WHERE false",
    "answers": fetched("mixed"),
}


def step(k: int, skip_known: bool) -> dict[str, str]:
    """The tables after crawl step ``k``, from those after ``k - 1``."""
    now = f"({BASE} + INTERVAL {15 * (k - 1)} SECOND)"
    p = k - 1
    known = f"WHERE resolved NOT IN (SELECT url FROM tried_{k})" if skip_known else ""
    return {
        f"batch_{k}": f"""SELECT q.*, {host('q.url')} AS host, {robots_target('q.url')} AS target FROM queue_{p} q
          QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY added, id) = 1""",
        f"blocked_{k}": verdicts(f"batch_{k}", "id", "*"),
        f"outcome_{k}": f"""SELECT b.id, b.url, CASE WHEN b.host IS NULL THEN 'invalid'
            WHEN NOT EXISTS (SELECT 1 FROM domain_{p} d WHERE d.name = b.host AND d.next_visit < {now}) THEN 'not_due'
            WHEN b.id IN (SELECT id FROM blocked_{k}) THEN 'blocked'
            ELSE {outcome('a.status_line', 'a.content_type', 'a.body')} END AS outcome
          FROM batch_{k} b LEFT JOIN answers a ON a.url = b.url""",
        f"kept_{k}": f"SELECT * FROM outcome_{k} WHERE outcome IN ('html', 'other')",
        f"links_{k}": f"SELECT m.* FROM supported m JOIN kept_{k} o ON o.url = m.url",
        f"all_domain_{k}": grown_domains(f"domain_{p}", f"links_{k}", now),
        f"targets_{k}": with_ids(f"links_{k}", f"all_domain_{k}"),
        f"domain_{k}": f"""SELECT id, name, CASE WHEN name IN (SELECT {host('url')} FROM kept_{k})
            THEN {now} + INTERVAL 5 SECOND ELSE next_visit END AS next_visit FROM all_domain_{k}""",
        f"url_{k}": grown_urls(f"url_{p}", f"targets_{k}"),
        f"tried_{k}": f"""SELECT url FROM tried_{p} UNION SELECT url FROM outcome_{k} WHERE outcome <> 'not_due'""",
        f"wanted_{k}": f"SELECT resolved AS url, domain_id FROM targets_{k} {known}",
        f"all_queue_{k}": grown_queue(
            f"queue_{p}", f"wanted_{k}", now,
            "(" + " UNION ALL ".join(f"SELECT id FROM all_queue_{j}" for j in range(1, k)) + ")" if k > 1 else None,
        ),
        f"queue_{k}": f"""SELECT * FROM all_queue_{k}
          WHERE id NOT IN (SELECT id FROM outcome_{k} WHERE outcome <> 'not_due')""",
    }


def sql(final: str, rounds: int = 0, skip_known: bool = False) -> str:
    """A query with the common tables it uses, directly or through others."""
    tables = dict(COMMON)
    for k in range(1, rounds + 1):
        tables |= step(k, skip_known)
    import re

    needed, open_texts = set(), [final]
    while open_texts:
        words = set(re.findall(r"\w+", open_texts.pop()))
        for name in (words & tables.keys()) - needed:
            needed.add(name)
            open_texts.append(tables[name])
    # Several of these are used more than once; evaluate each once.
    ctes = [f"{name} AS MATERIALIZED ({text})" for name, text in tables.items() if name in needed]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + final


def agent_verdicts(agent: str) -> str:
    return f"""SELECT page_id, url, '{agent}' AS agent,
      page_id IN ({verdicts('page_targets', 'page_id', agent)}) AS blocked FROM pages"""


THROTTLE = """WITH RECURSIVE taken(user_id, ts) AS (
    SELECT user_id, min(ts) FROM events GROUP BY user_id
  UNION ALL
    SELECT t.user_id, min(e.ts) FROM taken t JOIN events e
      ON e.user_id = t.user_id AND e.ts > t.ts + INTERVAL 6 HOUR GROUP BY t.user_id, t.ts)
  SELECT e.user_id, e.ts, min(e.event_id) AS event_id
  FROM taken t JOIN events e ON e.user_id = t.user_id AND e.ts = t.ts GROUP BY e.user_id, e.ts"""

LEGACY = f"""SELECT page_id, url, pos, href,
    coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS resolved
  FROM (SELECT *, CASE
      WHEN starts_with(href, '..') THEN array_to_string(list_slice(levels, 1, greatest(len(levels) - climbs, 0)), '/')
        || '/' || replace(href, '../', '')
      WHEN starts_with(href, '//') THEN {scheme('url')} || ':' || href
      WHEN regexp_matches(href, '^/|^./') THEN {scheme('url')} || '://' || {host('url')} || href
      WHEN starts_with(href, 'http') THEN href
      WHEN regexp_matches(href, '^[a-zA-Z0-9]') THEN array_to_string(levels, '/') || '/' || href END AS own
    FROM (SELECT *, string_split(regexp_replace(url, '/+[^/]*/*$', ''), '/') AS levels,
        CAST(sum(CASE WHEN starts_with(href, '..') THEN (length(href) - length(replace(href, '../', ''))) // 3
          ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS climbs
      FROM mixed_found))"""

CONTENT_TYPES = """(VALUES (1, 'text/html; charset=utf-8'), (2, 'text/plain'), (3, 'text/html')) c(id, value)"""
TYPE_IDS = f"""SELECT v.value, coalesce(min(c.id), 3 + dense_rank() OVER (
      PARTITION BY min(c.id) IS NULL ORDER BY md5(lower(v.value)), lower(v.value)))::BIGINT AS id
  FROM (SELECT DISTINCT content_type AS value FROM fetches) v
  LEFT JOIN {CONTENT_TYPES} ON contains(lower(c.value), lower(v.value)) GROUP BY v.value"""

COUNT = "CAST(count(*) AS BIGINT)"

ORACLE = {
    "links_per_host": sql(
        f"SELECT host, {COUNT} AS links, CAST(count(DISTINCT path) AS BIGINT) AS paths FROM plain_links GROUP BY host"
    ),
    "read_pages": "SELECT *, 'HTTP/1.1 200 OK' AS status_line, 'text/html' AS content_type FROM pages",
    "url_parts": f"""SELECT page_id, {scheme('url')} AS scheme, {host('url')} AS host, {port('url')} AS port,
        {path('url')} AS path, {query('url')} AS query, {fragment('url')} AS fragment FROM pages""",
    "content_key": sql(
        f"""SELECT url, {content_key('url', "contains(content_type, 'text/html')")} AS content_key FROM fetches"""
    ),
    "robots_target": f"SELECT page_id, {robots_target('url')} AS target FROM pages",
    "extract_links": sql("SELECT * FROM plain_found"),
    "resolve_links": sql("SELECT * FROM plain_resolved"),
    "resolve_links_mixed": sql("SELECT * FROM mixed_resolved"),
    "resolve_links_legacy": sql(LEGACY),
    "normalize_links": sql("SELECT * FROM mixed_links"),
    "assign_ids": sql(
        f"SELECT host, path, 100 + {rank('host', 'path')} AS id FROM (SELECT DISTINCT host, path FROM plain_links)"
    ),
    "upsert_domain": sql("SELECT * FROM g_domain"),
    "upsert_protocol": sql(
        f"""SELECT * FROM (VALUES (0::BIGINT, 'http'), (1::BIGINT, 'https')) f(id, name) UNION ALL
        SELECT 1 + {rank('name')}, name FROM (SELECT DISTINCT scheme AS name FROM mixed_links
          WHERE scheme NOT IN ('http', 'https'))"""
    ),
    "insert_urls": sql(grown_urls("s_url", "targets")),
    "url_ids": sql(
        """SELECT t.page_id, t.pos, t.resolved, u.id AS url_id FROM targets t LEFT JOIN s_url u
        ON u.path = t.path AND u.domain_id = t.domain_id AND u.scheme_id = t.scheme_id"""
    ),
    "content_type_ids": sql(TYPE_IDS),
    "content_type_table": sql(
        f"""SELECT id::BIGINT AS id, value FROM {CONTENT_TYPES}
        UNION ALL SELECT id, min(value) FROM ({TYPE_IDS}) WHERE id > 3 GROUP BY id"""
    ),
    "match_domains": sql(
        """SELECT h.host, d.id AS domain_id, d.name FROM (SELECT DISTINCT host FROM mixed_links) h
        JOIN domain d ON d.name = h.host"""
    ),
    "match_domains_pattern": sql(
        """SELECT h.host, d.id AS domain_id, d.name FROM (
          SELECT name AS host FROM domain UNION SELECT replace(name, '.', '_') FROM domain
          UNION SELECT regexp_replace(name, '^[^.]*', '%') FROM domain) h JOIN domain d ON d.name LIKE h.host"""
    ),
    "enqueue": sql(
        grown_queue("s_queue", "(SELECT resolved AS url, domain_id FROM targets)", BASE)
    ),
    "add_seeds": sql(
        f"""SELECT * FROM ({grown_queue('s_queue', f'''(SELECT p.url, d.id AS domain_id FROM pages p
          JOIN ({grown_domains('s_domain', f"(SELECT {host('url')} AS host FROM pages)", BASE)}) d
          ON d.name = {host('p.url')})''', BASE)})"""
    ),
    "dequeue": sql(
        f"SELECT * FROM queue WHERE id NOT IN ({verdicts('page_targets', 'page_id', '*')})"
    ),
    "split_valid": sql(
        f"SELECT page_id, pos, href AS url, {host('href')} AS host, {host('href')} IS NOT NULL AS valid FROM mixed_links"
    ),
    "first_per_domain": sql(
        "SELECT * FROM queue QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY added, id) = 1"
    ),
    "frontier": sql(
        """SELECT * FROM (SELECT * FROM queue QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY added, id) = 1)
        ORDER BY added, id LIMIT 10"""
    ),
    "frontier_due_first": sql(
        f"""SELECT * FROM (SELECT q.* FROM queue q JOIN domain d ON d.id = q.domain_id
          WHERE d.next_visit < {BASE}
          QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY added, q.id) = 1)
        ORDER BY added, id LIMIT 10"""
    ),
    "due": sql(
        f"""SELECT q.*, d.name AS host FROM queue q JOIN domain d ON d.name = {host('q.url')}
        WHERE d.next_visit < {BASE}"""
    ),
    "update_next_visit": sql(
        f"""SELECT id, name, CASE WHEN id IN (SELECT domain_id FROM classified WHERE outcome IN ('html', 'other'))
          THEN {BASE} + INTERVAL 5 SECOND ELSE next_visit END AS next_visit FROM domain"""
    ),
    "parse_robots": sql("SELECT host, agent, pos, pattern, regex, rule_len, allow FROM rules"),
    "robots_blocked": sql(
        f"SELECT page_id, url, page_id IN ({verdicts('page_targets', 'page_id', '*')}) AS blocked FROM pages"
    ),
    "robots_agent_fallback": sql(f"{agent_verdicts('Bot')} UNION ALL {agent_verdicts('Other')}"),
    "robots_blocked_links": sql(
        f"""SELECT page_id, pos, resolved AS url, key IN ({verdicts(
          f'''(SELECT page_id * 1000000 + pos AS key, host, {robots_target('resolved')} AS target
             FROM plain_links)''', 'key', '*')}) AS blocked
        FROM (SELECT *, page_id * 1000000 + pos AS key FROM plain_links)"""
    ),
    "classify_fetch": sql(
        f"SELECT url, {outcome('status_line', 'content_type', 'body')} AS outcome FROM fetches"
    ),
    "content_store": sql("SELECT * FROM contents"),
    "content_sink": sql(
        """SELECT domain_id, content_key, url, md5(body) AS body_md5, CAST(domain_id % 16 AS INTEGER) AS bucket
        FROM contents"""
    ),
    "link_list": sql("SELECT * FROM list"),
    "crawl_report": sql(
        f"""SELECT (SELECT {COUNT} FROM url) AS links, (SELECT {COUNT} FROM domain) AS domains,
        (SELECT {COUNT} FROM queue) AS queued"""
    ),
    "page_summary": sql(f"SELECT {COUNT} AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM url"),
    "page_of": sql("SELECT * FROM list ORDER BY id LIMIT 10 OFFSET 20"),
    "page_of_stored": sql("SELECT * FROM list ORDER BY id LIMIT 10 OFFSET ((SELECT count(*) FROM list) - 1) // 10 * 10"),
    "page_index": sql("SELECT *, (row_number() OVER (ORDER BY id) - 1) // 10 + 1 AS page FROM list"),
    "crawl_step_outcomes": sql("SELECT * FROM outcome_1", 1),
    "crawl_step_queue": sql("SELECT * FROM queue_1", 1),
    "crawl_step_domain": sql("SELECT * FROM domain_1", 1),
    "crawl_step_urls": sql("SELECT * FROM url_1", 1),
    "crawl_step_content": sql(
        f"""SELECT d.id AS domain_id, {content_key('k.url', "k.outcome = 'html'")} AS content_key, k.url, a.body,
          {BASE} AS fetched_at
        FROM kept_1 k JOIN answers a ON a.url = k.url JOIN domain d ON d.name = {host('k.url')}""",
        1,
    ),
    "crawl_rounds": sql(
        " UNION ALL ".join(f"SELECT *, {k} AS round FROM outcome_{k}" for k in (1, 2, 3)), 3, skip_known=True
    ),
    "throttle": THROTTLE,
    "throttle_hot_keys": THROTTLE,
    "stream_links": sql("SELECT DISTINCT scheme, host, path FROM plain_links"),
    "stream_merge_queue": sql(
        grown_queue(
            "s_queue",
            f"""(SELECT resolved AS url, d.id AS domain_id FROM plain_links
              JOIN ({grown_domains('s_domain', 'plain_links', BASE)}) d ON d.name = host)""",
            BASE,
        )
    ),
    "stream_merge_urls": sql(
        grown_urls(
            "s_url", f"({with_ids('plain_links', '(' + grown_domains('s_domain', 'plain_links', BASE) + ')')})"
        )
    ),
    "stream_throttle": THROTTLE,
    "broken_links": sql(
        """SELECT l.page_id, l.url, l.pos, l.href, l.host, l.path, coalesce(s.failure, 'not in snapshot') AS cause
        FROM supported l LEFT JOIN statuses s ON s.host = l.host AND s.path = l.path
        WHERE s.ok IS NULL OR NOT s.ok"""
    ),
    "link_structure_page": sql(
        f"""SELECT page_id, {COUNT} AS links_out, CAST(count(DISTINCT (host, path)) AS BIGINT) AS targets,
          CAST(count(*) FILTER (host = from_host) AS BIGINT) AS internal,
          CAST(count(*) FILTER (host <> from_host) AS BIGINT) AS external
        FROM from_to GROUP BY page_id"""
    ),
    "link_structure_host": sql(
        f"""SELECT host, CAST(sum(p) AS BIGINT) AS pages, CAST(sum(o) AS BIGINT) AS links_out,
          CAST(sum(i) AS BIGINT) AS links_in
        FROM (SELECT {host('url')} AS host, 1 AS p, 0 AS o, 0 AS i FROM pages
          UNION ALL SELECT from_host, 0, 1, 0 FROM from_to UNION ALL SELECT host, 0, 0, 1 FROM from_to)
        GROUP BY host"""
    ),
    "host_edges": sql(f"SELECT from_host, host AS to_host, {COUNT} AS links FROM from_to GROUP BY ALL"),
    "inverted_index": sql("SELECT * FROM posted"),
    "term_frequency": sql(f"SELECT term, {COUNT} AS df FROM posted GROUP BY term"),
    "search": sql(
        """SELECT doc_id, round(sum(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1))), 6) AS score
        FROM posted JOIN (SELECT term, count(*) AS df FROM posted GROUP BY term) USING (term)
        WHERE term IN ('the', 'thand', 'nicht', 'para', 'eau')
        GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10"""
    ),
}

ORACLE["stored_pages_step"] = ORACLE["crawl_step_outcomes"]
ORACLE["stored_search"] = ORACLE["search"]

# Links of pages that answered and are not blocked.
ANSWERED = f"""(SELECT l.* FROM plain_links l JOIN fetches f ON f.url = l.url
  WHERE {outcome('f.status_line', 'f.content_type', 'f.body')} IN ('html', 'other') AND l.page_id NOT IN ({verdicts('page_targets', 'page_id', '*')}))"""
ORACLE["stream_links_answered"] = sql(f"SELECT DISTINCT scheme, host, path FROM {ANSWERED}")
ORACLE["stream_merge_answered"] = sql(
    grown_queue(
        "s_queue",
        f"""(SELECT resolved AS url, d.id AS domain_id FROM {ANSWERED}
          JOIN ({grown_domains('s_domain', ANSWERED, BASE)}) d ON d.name = host)""",
        BASE,
    )
)
