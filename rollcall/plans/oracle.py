"""The same results as :mod:`rollcall.plans.catalog`, as SQL for DuckDB.

Written from the rules rather than from the Spark jobs: windows where those use
aggregates and joins, and a recursive query where those use a fold.
"""

from __future__ import annotations

from rollcall.plans.catalog import MASTER_URL, MASTER_WEB_UI_URL, PAGE_TAGS, TOP

_LOGS = """
    message AS (
        SELECT event_id AS seq, ts, 'container-' || user_id AS id,
               'host-' || (user_id // 2) AS host,
               'host-' || (user_id // 2) || ':7078' AS address,
               CAST(512 * (1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 4)
                    AS INTEGER) AS memory,
               value,
               CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'lost'
                    ELSE 'heartbeat' END AS kind
        FROM events
        WHERE event_type IN ('signup', 'error', 'view', 'click', 'purchase')
    ),
    reg AS (
        SELECT *, CAST(floor(least(value, memory)) AS INTEGER) AS memory_used,
               row_number() OVER (PARTITION BY address ORDER BY ts, seq) AS nth,
               first_value(id) OVER (PARTITION BY address ORDER BY ts, seq) AS owner
        FROM message WHERE kind = 'register'
    ),
    accepted AS (SELECT * FROM reg WHERE nth = 1),
    hb AS (
        SELECT m.seq, m.ts, m.id, coalesce((a.ts, a.seq) < (m.ts, m.seq), FALSE) AS updates
        FROM message m LEFT JOIN accepted a ON a.id = m.id
        WHERE m.kind = 'heartbeat'
    ),
    seen AS (
        SELECT a.id, coalesce(max(h.ts), a.ts) AS last_seen
        FROM accepted a LEFT JOIN hb h ON h.id = a.id AND h.updates
        GROUP BY a.id, a.ts
    )
"""

_FLEET = f"""
    {_LOGS},
    fleet AS (
        SELECT id, address, host, 7078 AS port, memory, memory_used,
               memory - memory_used AS memory_free, 'ALIVE' AS state, ts AS last_heartbeat,
               'http://' || host || ':8082' AS web_ui_address, ts AS accepted_at,
               seq AS accepted_seq
        FROM accepted
    )
"""


def _memory_text(column: str) -> str:
    """Memory text of whole MB below 2 TB."""
    return f"""CASE WHEN {column} >= 2048 THEN printf('%.1f GB', round({column} / 1024.0, 1))
        WHEN {column} >= 2 THEN printf('%.1f MB', round({column} * 1.0, 1))
        WHEN {column} = 1 THEN '1024.0 KB' ELSE '0.0 B' END"""


_LISTING = f"""id, web_ui_address, address, state, memory, memory_used, memory_free,
    {_memory_text("memory")} || ' (' || {_memory_text("memory_used")} || ' Used)' AS memory_text"""

_TOTALS = """count(*) FILTER (state = 'ALIVE') AS alive,
    CAST(coalesce(sum(memory) FILTER (state = 'ALIVE'), 0) AS BIGINT) AS memory,
    CAST(coalesce(sum(memory_used) FILTER (state = 'ALIVE'), 0) AS BIGINT) AS memory_used,
    count(*) AS listed, 'ALIVE' AS status"""

# Whole ms are cut, not rounded, from the stamp.
_CONTAINER_JSON = """CAST(to_json({'id': id, 'host': host, 'port': port,
    'webuiaddress': web_ui_address, 'memory': memory, 'memoryused': memory_used,
    'memoryfree': memory_free, 'state': state,
    'lastheartbeat': epoch_us(last_heartbeat) // 1000}) AS VARCHAR)"""

_FLEET_LINES = f"""
    WITH {_FLEET}, total AS (SELECT {_TOTALS} FROM fleet)
    SELECT 0 AS part, '' AS id, '{{"url":"{MASTER_URL}","workers":[' AS line
    UNION ALL
    SELECT 1, id, CASE WHEN row_number() OVER (ORDER BY id) = 1 THEN '' ELSE ',' END
           || {_CONTAINER_JSON} FROM fleet
    UNION ALL
    SELECT 2, '', '],"memory":' || memory || ',"memoryused":' || memory_used
           || ',"status":"ALIVE"}}' FROM total"""


_REGISTRATION_OUTCOMES = f"""
    WITH {_LOGS}, labelled AS (
        SELECT seq, ts, id, address,
               CASE WHEN nth = 1 THEN 'REGISTERED' WHEN id = owner THEN 'DUPLICATE_ID'
                    ELSE 'DUPLICATE_ADDRESS' END AS outcome
        FROM reg
    )
    SELECT *, CASE outcome WHEN 'DUPLICATE_ID' THEN 'Duplicate container ID'
                  WHEN 'DUPLICATE_ADDRESS'
                  THEN 'Attempted to re-register worker at same address: ' || address
              END AS message
    FROM labelled
"""

# One row per address and step; step n has seen the first n messages of the address.
_REPLAY = f"""
    {_LOGS},
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY address ORDER BY ts, seq) AS step
        FROM message
    ),
    fold AS (
        SELECT DISTINCT address, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS seq,
               CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS kind,
               CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS outcome,
               CAST(NULL AS VARCHAR) AS replaced, CAST(NULL AS VARCHAR) AS owner,
               FALSE AS lost, CAST(NULL AS VARCHAR) AS dead
        FROM message
        UNION ALL
        SELECT n.address, n.step, n.seq, n.ts, n.kind, n.id,
               CASE WHEN n.kind = 'register' THEN
                        CASE WHEN n.id IS NOT DISTINCT FROM f.owner THEN 'DUPLICATE_ID'
                             WHEN f.owner IS NULL OR f.lost THEN 'REGISTERED'
                             ELSE 'DUPLICATE_ADDRESS' END
                    WHEN n.kind = 'heartbeat' THEN
                        CASE WHEN n.id IS NOT DISTINCT FROM f.owner THEN 'UPDATED'
                             WHEN n.id IS NOT DISTINCT FROM f.dead THEN 'RECONNECT'
                             ELSE 'IGNORED' END
                    WHEN n.id IS NOT DISTINCT FROM f.owner THEN 'MARKED_UNKNOWN'
                    ELSE 'NO_EFFECT' END,
               CASE WHEN n.kind = 'register' AND n.id IS DISTINCT FROM f.owner AND f.lost
                    THEN f.owner END,
               CASE WHEN n.kind = 'register' AND (f.owner IS NULL OR f.lost)
                         AND n.id IS DISTINCT FROM f.owner
                    THEN n.id ELSE f.owner END,
               CASE WHEN n.id IS NOT DISTINCT FROM f.owner THEN f.lost OR n.kind = 'lost'
                    WHEN n.kind = 'register' THEN FALSE
                    ELSE f.lost END,
               CASE WHEN n.kind <> 'register' OR n.id IS NOT DISTINCT FROM f.owner THEN f.dead
                    WHEN f.lost THEN f.owner END
        FROM fold f JOIN numbered n ON n.address = f.address AND n.step = f.step + 1
    ),
    final AS (
        SELECT * FROM fold
        QUALIFY row_number() OVER (PARTITION BY address ORDER BY step DESC) = 1
    ),
    listed AS (
        SELECT address, owner AS id, CASE WHEN lost THEN 'UNKNOWN' ELSE 'ALIVE' END AS state
        FROM final WHERE owner IS NOT NULL
        UNION ALL
        SELECT address, dead, 'DEAD' FROM final WHERE dead IS NOT NULL
    ),
    replayed AS (
        SELECT l.address, l.id, l.state, max(f.ts) AS accepted_at, max(f.seq) AS accepted_seq
        FROM listed l JOIN fold f ON f.address = l.address AND f.id = l.id
             AND f.outcome = 'REGISTERED'
        GROUP BY ALL
    )
"""

_REPLAY_ROWS = f"""
    WITH RECURSIVE {_REPLAY}
    SELECT seq, ts, kind, id, address, outcome, replaced FROM fold WHERE step > 0
"""

_SPANS = """
    gaps AS (SELECT *, lag(ts) OVER (PARTITION BY id ORDER BY ts, seq) AS before FROM active),
    numbered AS (
        SELECT *, sum(CASE WHEN ts - before > INTERVAL 24 HOUR THEN 1 ELSE 0 END)
                  OVER (PARTITION BY id ORDER BY ts, seq) AS span
        FROM gaps
    ),
    spans AS (
        SELECT id, min(ts) AS started_at, max(ts) AS last_active,
               max(ts) + INTERVAL 24 HOUR AS ended_at, count(*) AS events
        FROM numbered GROUP BY id, span
    )
"""


def _short(ms: str) -> str:
    return f"""CASE WHEN {ms} < 100 THEN printf('%d ms', {ms})
        WHEN {ms} < 1000 THEN printf('%.1f s', round({ms} / 1000.0, 1))
        WHEN {ms} < 60000 THEN printf('%.0f s', round({ms} / 1000.0))
        WHEN {ms} < 600000 THEN printf('%.1f min', round({ms} / 60000.0, 1))
        WHEN {ms} < 3600000 THEN printf('%.0f min', round({ms} / 60000.0))
        ELSE printf('%.1f h', round({ms} / 3600000.0, 1)) END"""


def _long(ms: str) -> str:
    def part(within: str, size: int, unit: str) -> str:
        n = f"(({within}) // {size})"
        return f"""CASE {n} WHEN 0 THEN '' WHEN 1 THEN '1 {unit}'
            ELSE {n} || ' {unit}s' END"""

    second = part(f"{ms} % 60000", 1000, "second")
    minute = part(f"{ms} % 3600000", 60000, "minute")
    hour = part(f"{ms} % 86400000", 3600000, "hour")
    day = part(f"{ms} % 604800000", 86400000, "day")
    week = part(f"{ms} % 31536000000", 604800000, "week")
    year = part(ms, 31536000000, "year")
    milli = f"CASE WHEN {ms} >= 1000 AND {ms} % 1000 = 0 THEN '' ELSE ({ms} % 1000) || ' ms' END"

    def line(*parts: str) -> str:
        return " || ' ' || ".join(f"({one})" for one in parts)

    return f"""CASE WHEN {ms} < 1000 THEN {milli}
        WHEN {ms} < 60000 THEN {line(second, milli)}
        WHEN {ms} < 3600000 THEN {line(minute, second)}
        WHEN {ms} < 86400000 THEN {line(hour, minute, second)}
        WHEN {ms} < 604800000 THEN {line(day, hour, minute)}
        WHEN {ms} < 31536000000 THEN {line(week, day, hour)}
        ELSE {line(year, week, day)} END"""


def _durations(source: str, key: str, ts: str, text) -> str:
    texts = ", ".join(
        f"CASE WHEN {one}_ms IS NOT NULL THEN {text(f'{one}_ms')} END AS {one}_text"
        for one in ("min", "median", "max")
    )
    return f"""
        WITH gaps AS (
            SELECT {key}, (epoch_us({ts}) - epoch_us(lag({ts}) OVER (
                       PARTITION BY {key} ORDER BY {ts}))) // 1000 AS gap
            FROM {source}
        ),
        stats AS (
            SELECT {key}, count(gap) AS gaps, min(gap) AS min_ms,
                   CAST(floor(median(gap)) AS BIGINT) AS median_ms, max(gap) AS max_ms
            FROM gaps GROUP BY {key}
        )
        SELECT *, {texts} FROM stats
    """


def _magnitude(value: str) -> str:
    return f"""CASE WHEN {value} >= 2e12 THEN printf('%.1f T', round({value} / 1e12, 1))
        WHEN {value} >= 2e9 THEN printf('%.1f B', round({value} / 1e9, 1))
        WHEN {value} >= 2e6 THEN printf('%.1f M', round({value} / 1e6, 1))
        WHEN {value} >= 2e3 THEN printf('%.1f K', round({value} / 1e3, 1))
        ELSE CAST(CAST(trunc({value}) AS INTEGER) AS VARCHAR) END"""


def _magnitudes(source: str, keys: str, measure: str) -> str:
    return f"""
        WITH sums AS (
            SELECT {keys}, count(*) AS rows, sum({measure}) AS raw
            FROM {source} GROUP BY {keys}
        )
        SELECT * EXCLUDE (raw), round(raw, 2) AS total, {_magnitude("rows")} AS rows_text,
               {_magnitude("raw")} AS total_text
        FROM sums
    """


def _stamps(source: str, key: str, ts: str) -> str:
    return f"""
        SELECT {key}, strftime(min({ts}), '%Y/%m/%d %H:%M:%S') AS first_text,
               strftime(max({ts}), '%Y/%m/%d %H:%M:%S') AS last_text
        FROM {source} GROUP BY {key}
    """


def _audit(allowed: tuple[str, ...]) -> str:
    """CTEs ending in ``audit``; ``href`` has one row per link."""
    names = ", ".join(f"'{tag}'" for tag in allowed)
    return rf"""
        clean AS (
            SELECT page_id, url,
                   regexp_replace(html, '(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>', '', 'g') AS html
            FROM pages
        ),
        tag AS (
            SELECT DISTINCT page_id,
                   unnest(regexp_extract_all(html, '<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)', 1)) AS tag
            FROM clean
        ),
        offending AS (
            SELECT page_id, string_agg(tag, ',' ORDER BY tag) AS tags
            FROM tag WHERE tag NOT IN ({names}) GROUP BY page_id
        ),
        anchor AS (
            SELECT page_id, url, unnest(regexp_extract_all(html,
                '<(?:[\w.-]+:)?a(?:\s((?:[^>"'']|"[^"]*"|''[^'']*'')*))?/?>', 1)) AS attributes
            FROM clean
        ),
        attribute AS (
            SELECT page_id, url, unnest(regexp_extract_all(attributes,
                '[^\s=>"''/]+\s*=\s*(?:"[^"]*"|''[^'']*'')')) AS attribute
            FROM anchor
        ),
        href AS (
            SELECT page_id, url, regexp_extract(attribute, '(?s)["''](.*)["'']$', 1) AS href
            FROM attribute WHERE regexp_matches(attribute, '^(?:[\w.-]+:)?href\s*=')
        ),
        audit AS (
            SELECT c.page_id, c.url, coalesce(o.tags, '') AS offending_tags,
                   CAST((SELECT count(*) FROM anchor a WHERE a.page_id = c.page_id) AS INTEGER)
                       AS anchors,
                   CAST((SELECT count(*) FROM href h WHERE h.page_id = c.page_id
                         AND NOT starts_with(h.href, '/')) AS INTEGER) AS outside_links
            FROM clean c LEFT JOIN offending o ON o.page_id = c.page_id
        ),
        piece AS (
            SELECT page_id, unnest(string_split(html, '<')[2:]) AS piece FROM clean
        ),
        opener AS (
            SELECT page_id, CASE WHEN strpos(piece, '>') = 0 THEN piece
                                 ELSE regexp_replace(regexp_replace(piece, '"[^"]*"', 'Q', 'g'),
                                                     '''[^'']*''', 'Q', 'g') END AS bare
            FROM piece WHERE regexp_matches(piece, '^(?:[\w.-]+:)?[A-Za-z_]')
        ),
        step AS (
            SELECT page_id, pos, regexp_extract(tag, '^</?([^\s/>]+)', 1) AS name,
                   CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END AS step
            FROM (SELECT page_id, unnest(found) AS tag, generate_subscripts(found, 1) AS pos
                  FROM (SELECT page_id, regexp_extract_all(html,
                            '</?[A-Za-z_:][^<>"'']*(?:(?:"[^"<]*"|''[^''<]*'')[^<>"'']*)*>') AS found FROM clean) x) y
            WHERE NOT ends_with(tag, '/>')
        ),
        placed AS (
            SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) + CASE WHEN step < 0 THEN 1 ELSE 0 END AS level
            FROM step
        ),
        turn AS (
            SELECT *, row_number() OVER w AS place, lead(name) OVER w AS next_name, lead(step) OVER w AS next_step
            FROM placed WINDOW w AS (PARTITION BY page_id, level ORDER BY pos)
        ),
        broken AS (
            SELECT DISTINCT page_id FROM opener
            WHERE strpos(bare, '>') = 0
               OR NOT regexp_matches(trim(left(bare, strpos(bare, '>') - 1)) || ' ',
                                     '^[\w.:-]+(\s+[^\s=Q/]+\s*=\s*Q)*\s*/?\s*$')
            UNION
            SELECT page_id FROM piece WHERE NOT regexp_matches(piece, '^/?[A-Za-z_:]')
            UNION
            SELECT page_id FROM clean
            WHERE strpos(regexp_replace(html, '&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);', '', 'g'), '&') > 0
            UNION
            SELECT page_id FROM turn
            WHERE level < 1 OR (place % 2 = 0 AND step > 0)
               OR (place % 2 = 1 AND (step < 0 OR next_step IS DISTINCT FROM -1 OR next_name IS DISTINCT FROM name))
        ),
        judged AS (
            SELECT *, CASE WHEN offending_tags <> '' THEN 'ESCAPE_TAG'
                           WHEN page_id IN (SELECT page_id FROM broken) THEN 'ESCAPE_MALFORMED'
                           WHEN outside_links > 0 THEN 'ESCAPE_LINK' ELSE 'ALLOW' END AS verdict
            FROM audit
        )
    """


_STRICT = _audit(("a", "span"))

_LINKS = rf"""
    {_STRICT},
    link AS (
        SELECT page_id, href,
               regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), '/$', '')
                   || '/' || regexp_replace(href, '^/', '') AS resolved
        FROM href WHERE starts_with(href, '/')
    )
"""

_BY_FLAG = """
    SELECT l_returnflag, count(*) AS rows, sum(l_quantity) AS quantity
    FROM lineitem WHERE l_quantity > 30 GROUP BY l_returnflag
"""


def oracle_sql() -> dict[str, str]:
    return {
        "registration_outcomes": _REGISTRATION_OUTCOMES,
        "accepted_registry": f"WITH {_FLEET} SELECT * FROM fleet",
        "heartbeat_outcomes": f"""
            WITH {_LOGS}
            SELECT seq, ts, id, CASE WHEN updates THEN 'UPDATED' ELSE 'IGNORED' END AS outcome
            FROM hb""",
        "last_seen": f"WITH {_LOGS} SELECT id, last_seen FROM seen",
        "fleet_snapshot": f"WITH {_FLEET} SELECT {_TOTALS} FROM fleet",
        "fleet_snapshot_by_memory_free": f"""
            WITH {_FLEET} SELECT memory_free, {_TOTALS} FROM fleet GROUP BY memory_free""",
        "fleet_snapshot_text": f"""
            WITH {_FLEET}, total AS (SELECT {_TOTALS} FROM fleet)
            SELECT *, {_memory_text("memory")} || ' Total, ' || {_memory_text("memory_used")}
                   || ' Used' AS memory_text FROM total""",
        "fleet_listing": f"WITH {_FLEET} SELECT {_LISTING} FROM fleet ORDER BY id",
        "listing_by_memory": f"""
            WITH {_FLEET} SELECT {_LISTING} FROM fleet
            ORDER BY memory DESC, memory_used DESC, id""",
        "listing_by_memory_top": f"""
            WITH {_FLEET} SELECT {_LISTING} FROM fleet
            ORDER BY memory DESC, memory_used DESC, id LIMIT {TOP}""",
        "container_state": f"""
            WITH {_FLEET}
            SELECT host, port, id AS container_id, '{MASTER_URL}' AS master_url, memory,
                   memory_used, '{MASTER_WEB_UI_URL}' AS master_web_ui_url
            FROM fleet WHERE id IN (SELECT id FROM message WHERE kind = 'lost')""",
        "container_state_json": f"""
            WITH {_FLEET}
            SELECT id, '{{"id":"' || id || '","masterurl":"{MASTER_URL}","masterwebuiurl":"'
                   || '{MASTER_WEB_UI_URL}","memory":' || memory || ',"memoryused":'
                   || memory_used || '}}' AS json
            FROM fleet WHERE id IN (SELECT id FROM message WHERE kind = 'lost')""",
        "container_json": f"WITH {_FLEET} SELECT id, {_CONTAINER_JSON} AS json FROM fleet",
        "fleet_json": _FLEET_LINES,
        "fleet_document": f"""
            SELECT line, CAST(coalesce(sum(strlen(line) + 1) OVER (
                       ORDER BY part, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
            FROM ({_FLEET_LINES}) x""",
        "attempt_tiers": f"""
            WITH {_LOGS}, numbered AS (
                SELECT seq, ts, id,
                       row_number() OVER (PARTITION BY id ORDER BY ts, seq) - 1 AS attempt
                FROM reg
            )
            SELECT *, CASE WHEN attempt = 0 THEN 'FIRST' WHEN attempt <= 6 THEN 'INITIAL'
                           WHEN attempt <= 16 THEN 'PROLONGED' ELSE 'GAVE_UP' END AS tier
            FROM numbered""",
        "replay": _REPLAY_ROWS,
        "replay_registry": f"WITH RECURSIVE {_REPLAY} SELECT * FROM replayed",
        "replay_fleet_snapshot": f"""
            WITH RECURSIVE {_REPLAY}, fleet AS (
                SELECT r.state, q.memory, q.memory_used
                FROM replayed r JOIN reg q ON q.seq = r.accepted_seq
            )
            SELECT {_TOTALS} FROM fleet""",
        "liveness": f"""
            WITH {_LOGS}
            SELECT id, last_seen,
                   CASE WHEN (SELECT max(ts) FROM events) - last_seen <= INTERVAL 24 HOUR
                        THEN 'ALIVE' ELSE 'DEAD' END AS state
            FROM seen""",
        "heartbeat_gaps": f"""
            WITH {_LOGS}, beats AS (
                SELECT h.seq, h.ts, h.id,
                       epoch_us(h.ts) - epoch_us(coalesce(
                           lag(h.ts) OVER (PARTITION BY h.id ORDER BY h.ts, h.seq), a.ts)) AS gap
                FROM hb h JOIN accepted a ON a.id = h.id WHERE h.updates
            )
            SELECT seq, ts, id, gap // 1000 AS gap_ms,
                   greatest(gap // 21600000000 - 1, 0) AS missed
            FROM beats""",
        "alive_spans": f"""
            WITH {_LOGS}, active AS (
                SELECT id, ts, seq FROM accepted
                UNION ALL SELECT id, ts, seq FROM hb WHERE updates
            ), {_SPANS} SELECT * FROM spans""",
        "fleet_by_hour": f"""
            WITH {_LOGS}, active AS (
                SELECT id, ts, seq FROM accepted
                UNION ALL SELECT id, ts, seq FROM hb WHERE updates
            ), {_SPANS}, times AS (SELECT DISTINCT date_trunc('hour', ts) AS as_of FROM events)
            SELECT as_of, count(s.id) AS alive, CAST(coalesce(sum(a.memory), 0) AS BIGINT) AS memory,
                   (SELECT count(*) FROM accepted x WHERE x.ts <= as_of) AS listed
            FROM times LEFT JOIN spans s ON s.started_at <= as_of AND as_of <= s.ended_at
            LEFT JOIN accepted a ON a.id = s.id GROUP BY as_of""",
        "state_at_losses": f"""
            WITH {_LOGS}, active AS (
                SELECT id, ts FROM accepted UNION SELECT id, ts FROM hb WHERE updates
            )
            SELECT l.id, l.ts AS as_of, a.ts AS last_seen,
                   CASE WHEN l.ts - a.ts <= INTERVAL 24 HOUR THEN 'ALIVE'
                        WHEN a.ts IS NOT NULL THEN 'DEAD' END AS state
            FROM (SELECT id, ts FROM message WHERE kind = 'lost') l
            ASOF LEFT JOIN active a ON l.id = a.id AND l.ts >= a.ts""",
        "stream_registration_outcomes": _REGISTRATION_OUTCOMES,
        "stream_last_seen": f"""
            WITH {_LOGS} SELECT id, max(ts) AS last_seen FROM hb GROUP BY id""",
        "stream_alive_spans": f"""
            WITH {_LOGS}, active AS (SELECT id, ts, seq FROM hb), {_SPANS}
            SELECT * FROM spans""",
        "stream_replay": _REPLAY_ROWS,
        # What the watermark, an hour before the latest time, has passed.
        "stream_answers": f"""
            SELECT seq, ts, kind, id, address, outcome FROM ({_REPLAY_ROWS}) r
            WHERE ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""",
        "stream_registration_answers": f"""
            SELECT seq, ts, id, address, outcome FROM ({_REGISTRATION_OUTCOMES}) r
            WHERE ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events WHERE event_type = 'signup')""",
        "stream_closed_spans": f"""
            WITH {_LOGS}, active AS (SELECT id, ts, seq FROM hb), {_SPANS}
            SELECT * FROM spans
            WHERE ended_at <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM hb)""",
        "duration_report_events": _durations("events", "user_id", "ts", _short),
        "duration_report_orders": _durations("orders", "o_custkey", "o_orderdate", _short),
        "duration_report_verbose_events": _durations("events", "user_id", "ts", _long),
        "duration_report_verbose_orders": _durations(
            "orders", "o_custkey", "o_orderdate", _long
        ),
        "magnitude_report_lineitem": _magnitudes("lineitem", "l_returnflag", "l_extendedprice"),
        "magnitude_report_suppliers": _magnitudes(
            "lineitem", "l_suppkey, l_linestatus", "l_quantity"
        ),
        "magnitude_report_orders": _magnitudes("orders", "o_orderpriority", "o_totalprice"),
        "stamp_report_events": _stamps("events", "user_id", "ts"),
        "stamp_report_orders": _stamps("orders", "o_custkey", "o_orderdate"),
        "progress_report": """
            WITH counts AS (
                SELECT o_orderpriority, count(*) AS total,
                       count(*) FILTER (o_orderstatus = 'F') AS completed,
                       count(*) FILTER (o_orderstatus = 'O') AS started,
                       CAST(0 AS BIGINT) AS failed,
                       count(*) FILTER (o_orderstatus = 'P') AS skipped
                FROM orders GROUP BY o_orderpriority
            )
            SELECT *, CAST(completed AS DOUBLE) / total * 100 AS completed_percent,
                   CAST(started AS DOUBLE) / total * 100 AS started_percent,
                   completed || '/' || total
                       || CASE WHEN failed > 0 THEN ' (' || failed || ' failed)' ELSE '' END
                       || CASE WHEN skipped > 0 THEN ' (' || skipped || ' skipped)' ELSE '' END
                       AS label
            FROM counts""",
        "markup_audit": f"WITH {_STRICT} SELECT * FROM judged",
        "markup_audit_page_tags": f"WITH {_audit(PAGE_TAGS)} SELECT * FROM judged",
        "shown_markup": rf"""
            WITH {_audit(PAGE_TAGS)}
            SELECT page_id, verdict, CASE WHEN verdict = 'ALLOW'
                THEN regexp_replace(html, '(<a href=")/?', '\1/proxy/', 'g')
                ELSE replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
                     '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') END AS shown
            FROM judged JOIN (SELECT page_id, html FROM pages) p USING (page_id)""",
        "markup_summary": f"""
            WITH {_STRICT}
            SELECT nullif(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1), '') AS host,
                   verdict, count(*) AS pages
            FROM judged GROUP BY ALL""",
        "offending_tags": f"""
            WITH {_STRICT}
            SELECT tag, count(*) AS pages FROM tag WHERE tag NOT IN ('a', 'span')
            GROUP BY tag""",
        "resolve_links": f"WITH {_LINKS} SELECT * FROM link",
        "link_in_degree": f"""
            WITH {_LINKS} SELECT resolved, count(*) AS links FROM link GROUP BY resolved""",
        "cached_query": f"""
            {_BY_FLAG} UNION ALL SELECT 'all', count(*), sum(l_quantity) FROM lineitem""",
        "released_query": f"""
            SELECT *, FALSE AS pinned, TRUE AS other_pinned FROM ({_BY_FLAG}) x""",
        "partition_footprint": """
            SELECT count(*) AS partitions, CAST(sum(n) AS BIGINT) AS rows, max(n) AS largest,
                   avg(n) AS mean, max(n) / avg(n) AS skew
            FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey % 8) x""",
    }
