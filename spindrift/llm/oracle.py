"""SQL for the queries that it can express, over whole tables."""

from __future__ import annotations

# The alphabet of base32, and the words of texts.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def base32(digest: str) -> str:
    """Base32 of a SHA-1 in hexadecimal: five digits are four characters."""
    signs = " || ".join(f"substr('{BASE32}', 1 + ((v >> {shift}) & 31)::INT, 1)" for shift in (15, 10, 5, 0))
    fives = f"list_transform(range(0, 8), lambda i: ('0x' || substr({digest}, (1 + 5 * i)::INT, 5))::INT)"
    return f"array_to_string(list_transform({fives}, lambda v: {signs}), '')"


def words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORDS}')"


def crc32(text: str, table: str) -> str:
    """CRC-32 of an ASCII text; ``table`` is the list of the remainders of one byte."""
    signs = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    step = f"lambda c, x: xor(c >> 8, {table}[1 + (xor(c, x) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {signs}), {step}), 4294967295::BIGINT)"


# The remainders of one byte, by the polynomial in reversed order.
CRC_TABLE = (
    "SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc"
)

ORACLE = {
    "op2_warc": f"""
        WITH payloads AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first, sha1(payload) AS digest FROM payloads)
        SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {base32('digest')} AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> first THEN first END AS refers_to, url AS target_uri
        FROM firsts""",
    "op5_fm_index_decontamination": f"""
        WITH items AS (SELECT item_id, {words('text')} AS w FROM benchmark),
        windows AS (
          SELECT item_id, least(len(w), 10) AS k, array_to_string(w[pos : pos + least(len(w), 10) - 1], ' ') AS key
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM items WHERE len(w) > 0)),
        texts AS (SELECT doc_id, {words('text')} AS w FROM documents),
        places AS (
          SELECT doc_id, k, pos, array_to_string(w[pos : pos + k - 1], ' ') AS key
          FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS pos
                FROM texts, (SELECT DISTINCT k FROM windows))),
        hits AS (SELECT DISTINCT p.doc_id, p.pos, p.k, w.item_id FROM places p JOIN windows w ON w.key = p.key AND w.k = p.k),
        covered AS (
          SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS word FROM hits) GROUP BY doc_id),
        found AS (
          SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
          sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM texts t LEFT JOIN covered c ON c.doc_id = t.doc_id LEFT JOIN found f ON f.doc_id = t.doc_id""",
    "op6_suffix_dedup": """
        WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        strings AS (
          SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, 200)) AS string
          FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 99)) AS pos FROM texts)),
        again AS (
          SELECT doc_id, pos FROM strings QUALIFY row_number() OVER (PARTITION BY string ORDER BY doc_id, pos) > 1),
        marked AS (
          SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 100 THEN 0 ELSE 1 END AS new FROM again),
        spans AS (
          SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b
          FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM marked)
          GROUP BY doc_id, span),
        gaps AS (
          SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
        cut AS (
          SELECT t.doc_id, any_value(t.h) AS h, count(g.a) AS n, coalesce(sum(g.b - g.a), 0) AS gone, coalesce(max(g.b), 0) AS last,
            coalesce(string_agg(substr(t.h, 2 * g.since + 1, 2 * (g.a - g.since)), '' ORDER BY g.a), '') AS kept
          FROM texts t LEFT JOIN gaps g ON g.doc_id = t.doc_id GROUP BY t.doc_id)
        SELECT doc_id, (strlen(h) // 2)::BIGINT AS n_bytes, gone::BIGINT AS n_removed, n::BIGINT AS n_spans,
          sha256(unhex(kept || substr(h, 2 * last + 1))) AS kept_sha256
        FROM cut""",
    "op11_conversation_prefixes": f"""
        WITH turns AS (
          SELECT conv_id, length(words) AS chars, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
          FROM (SELECT conv_id, turn, coalesce(text, '') AS words, coalesce(role, '') AS who,
                  md5(length(who)::VARCHAR || ':' || who || ':' || words) AS digest FROM conversations WHERE conv_id IS NOT NULL)),
        convs AS (
          SELECT conv_id, {crc32('conv_id::VARCHAR', 'crc')} % 6 AS h
          FROM (SELECT DISTINCT conv_id FROM turns), ({CRC_TABLE})),
        joined AS (
          SELECT c.conv_id, 0 AS own, t.pos, digest, chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 WHERE t.pos <= h
          UNION ALL SELECT c.conv_id, 1, t.pos, digest, chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.pos > h),
        placed AS (
          SELECT conv_id, chars, digest, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM joined),
        paths AS (
          SELECT conv_id, depth, chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM placed
          UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
        nodes AS (
          SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
            CASE WHEN depth > 0 THEN substr(key, 1, strlen(key) - 32) END AS up
          FROM paths GROUP BY key, depth),
        childless AS (SELECT n.*, c.n AS children FROM nodes n LEFT JOIN (SELECT up, count(*) AS n FROM nodes GROUP BY up) c ON c.up = n.key),
        below AS (
          SELECT p.key, sum((n.n - 1) * n.chars) AS saved, count(*) FILTER (children IS NULL) AS leaves
          FROM childless n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key),
        ends AS (
          SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
          FROM (SELECT conv_id, max_by(key, depth) AS key FROM paths GROUP BY conv_id) GROUP BY key)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n.children, 0)::BIGINT AS n_children,
          b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM childless n JOIN below b ON b.key = n.key LEFT JOIN nodes u ON u.key = n.up LEFT JOIN ends e ON e.key = n.key""",
}
