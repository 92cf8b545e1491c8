"""The same queries as plain SQL for the check engine."""

from __future__ import annotations

from wardline.driver.views import CUSTOMER_HEADER, ORDER_HEADER, check_view
from wardline.operators.rules import MAJOR_VERSIONS, PRODUCTS

AS_OF = 1706659200000
LAG = 14400000
NOW = AS_OF - LAG
MONTH = f"ts >= {AS_OF - 14 * 86400000 - LAG} AND ts < {NOW}"

CHECKS: dict[str, str] = {}


def number(ip: str) -> str:
    parts = [f"try_cast(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)]
    return "(" + " + ".join(parts) + ")"


def dotted(n: str) -> str:
    octets = [f"CAST(({n} // {256 ** (3 - i)}) % 256 AS VARCHAR)" for i in range(4)]
    return f"concat({octets[0]}, '.', {octets[1]}, '.', {octets[2]}, '.', {octets[3]})"


def add(name: str, views: str, body: str, extra: str = "", recursive: bool = False) -> None:
    """Register a check: named input views, further CTEs, then the final select."""
    ctes = [f"v_{v} AS ({check_view(v)})" for v in views.split()]
    if extra:
        ctes.append(extra)
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else ""
    CHECKS[name] = head + body


# ---------------------------------------------------------------- shared addresses

NAT_VIEWS = "requests accounts industries networks"


def nat_rows(request_filter: str = "", account_filter: str = "") -> str:
    return f"""
    t1 AS (SELECT ip, cpcode, user_agent AS ua, CAST(sum(total_counter) AS BIGINT) AS total FROM v_requests
           WHERE {MONTH} {request_filter} GROUP BY ip, cpcode, user_agent),
    t2 AS (SELECT DISTINCT cpcode, account_name, account FROM v_accounts {account_filter}),
    t3 AS (SELECT DISTINCT account_id, vertical, subvertical FROM v_industries),
    nat AS (SELECT t1.ip, t2.account_name, t3.subvertical, t1.ua, t1.total, g.company, g.country, g.domain,
                   g.network_type, g.asnum
            FROM t1 LEFT JOIN t2 ON t1.cpcode = t2.cpcode LEFT JOIN t3 ON t2.account = t3.account_id
            LEFT JOIN v_networks g ON {number('t1.ip')} BETWEEN g.lo AND g.lo + 65535
            WHERE t3.subvertical IN ('Logistics', 'Advertising Technology', 'Enterprise Software (B2B)',
                'Enterprise Hardware', 'Asset Management', 'Business Services', 'BPO', 'Information Services',
                'Security Software') OR t3.vertical IN ('Software as a Service', 'Business Services'))"""


NAT = nat_rows(account_filter="WHERE NOT regexp_matches(lower(account_name), 'iran|iraq|kenya')")
OS = """CASE WHEN ua LIKE '%Windows NT%' THEN 'Windows' WHEN ua LIKE '%iPhone%' THEN 'iOS'
    WHEN ua LIKE '%Macintosh%' THEN 'Mac OS X' WHEN ua LIKE '%Android%' THEN 'Android'
    WHEN ua LIKE '%X11%' THEN 'Linux' ELSE 'Other' END"""
DEVICE = """CASE WHEN ua LIKE '%iPhone%' THEN 'iPhone' WHEN ua LIKE '%Macintosh%' THEN 'Mac'
    WHEN ua LIKE '%Android%' THEN 'Pixel 5' ELSE 'Other' END"""
BROWSER = """CASE WHEN ua LIKE '%Firefox/%' THEN 'Firefox' WHEN ua LIKE '%Chrome/% Mobile%' THEN 'Chrome Mobile'
    WHEN ua LIKE '%Chrome/%' THEN 'Chrome' WHEN ua LIKE '%Mobile/%' THEN 'Mobile Safari'
    WHEN ua LIKE '%Safari/%' THEN 'Safari' ELSE 'curl' END"""
VERSION = """CASE WHEN ua LIKE '%Firefox/%' THEN '94.0' WHEN ua LIKE '%Chrome/% Mobile%' THEN '95.0.4638'
    WHEN ua LIKE '%Chrome/%' THEN '96.0.4664' WHEN ua LIKE '%Mobile/%' THEN '14.0'
    WHEN ua LIKE '%Safari/%' THEN '14.1' ELSE '7.68.0' END"""
LABEL = "concat(CASE WHEN coalesce(subvertical, '') = '' THEN 'Sub-Vertical Not Found' ELSE subvertical END, ' --> ', account_name)"
FOUND = """
    raw AS (SELECT ts - ts % 3600000 AS hour, accounts, hosts, evidences, ip FROM v_intel
            WHERE heuristic_detected IS NOT NULL AND lower(heuristic_detected) <> 'false'),
    found AS (SELECT ip, hour, string_split(accounts[2:-2], ',') AS accounts, string_split(hosts[2:-2], ',') AS hosts,
                     regexp_extract(evidences, '''heuristic_name'': ''([^;]*);', 1) AS heuristic,
                     regexp_extract(evidences, '''category'': ''([^'']*)''', 1) AS category,
                     regexp_extract(evidences, '''hosts'': \\[''([^'']*)''', 1) AS attacked
              FROM raw)"""

add("nat_detection", NAT_VIEWS, "SELECT * FROM nat", NAT)
add(
    "nat_detection_listed",
    NAT_VIEWS + " intel",
    "SELECT * FROM nat",
    FOUND + "," + nat_rows(request_filter="AND ip IN (SELECT ip FROM found)"),
)
add(
    "nat_result_file",
    NAT_VIEWS,
    f"SELECT *, {OS} AS os, {DEVICE} AS device, {BROWSER} AS browser, {VERSION} AS browser_version, "
    "'nat_query' AS query_file FROM nat",
    NAT,
)
AGENTS = f", agents AS (SELECT DISTINCT ua, {OS} AS os, {DEVICE} AS device, {BROWSER} AS browser FROM nat)"
add(
    "nat_ua_distribution",
    NAT_VIEWS,
    " UNION ALL ".join(
        f"SELECT '{k}' AS kind, {k} AS value, count(*) AS items FROM agents GROUP BY {k}" for k in ("os", "device", "browser")
    ),
    NAT + AGENTS,
)
add(
    "nat_ua_kinds",
    NAT_VIEWS,
    "SELECT count(DISTINCT os) AS os_count, count(DISTINCT device) AS device_count, "
    "count(DISTINCT browser) AS browser_count, count(DISTINCT ua) AS ua_count FROM agents",
    NAT + AGENTS,
)
add("nat_account_labels", NAT_VIEWS, f"SELECT DISTINCT {LABEL} AS label FROM nat", NAT)


def split_sql(key: str, first_row: bool) -> str:
    partition = f"{key}, " if key else ""
    picked = "WHERE rn = 1" if first_row else ""
    select_key = f"a.{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    join = f"JOIN p USING ({key})" if key else "CROSS JOIN p"
    return f"""
    , l AS (SELECT *, {LABEL} AS label, coalesce(subvertical, '') = 'Advertising Technology' AS ad FROM nat),
    r AS (SELECT *, row_number() OVER (PARTITION BY {partition}label ORDER BY ip, ua, total) AS rn FROM l),
    a AS (SELECT {partition}count(DISTINCT ua) AS uas, count(DISTINCT label) AS accounts FROM l {group}),
    p AS (SELECT {partition}count(DISTINCT label) FILTER (WHERE ad) AS ad_accounts,
                 count(DISTINCT ua) FILTER (WHERE ad) AS ad_uas,
                 CAST(coalesce(sum(total) FILTER (WHERE ad), 0) AS BIGINT) AS ad_requests,
                 CAST(coalesce(sum(total) FILTER (WHERE NOT ad), 0) AS BIGINT) AS business_requests
          FROM r {picked} {group}),
    s AS (SELECT {select_key}ad_accounts, ad_uas, ad_requests, accounts - ad_accounts AS business_accounts,
                 uas - ad_uas AS business_uas, business_requests FROM a {join})"""


GUESS = """CASE WHEN business_accounts < 10 THEN 'IP[s] Does Not Seem To Be Shared'
    WHEN business_accounts <= 30 THEN 'IP[s] Seem To Be a Small Sized NAT'
    WHEN business_accounts <= 100 THEN 'IP[s] Seem To Be a Medium Sized NAT'
    WHEN business_accounts <= 150 THEN 'IP[s] Seem To Be a Large Sized NAT'
    ELSE 'Unable To Decide - Business-Related Account Count Is Too High!' END AS guess"""
add("nat_account_split", NAT_VIEWS, "SELECT * FROM s", NAT + split_sql("", False))
add("nat_account_split_first_row", NAT_VIEWS, "SELECT * FROM s", NAT + split_sql("", True))
add("nat_account_split_per_ip", NAT_VIEWS, "SELECT * FROM s", NAT + split_sql("ip", False))
add("nat_account_split_per_ip_first_row", NAT_VIEWS, "SELECT * FROM s", NAT + split_sql("ip", True))
add("nat_size_guess", NAT_VIEWS, f"SELECT business_accounts, {GUESS} FROM s", NAT + split_sql("", False))
add("nat_size_guess_per_ip", NAT_VIEWS, f"SELECT ip, business_accounts, {GUESS} FROM s", NAT + split_sql("ip", False))
add(
    "nat_first_row_per_ip",
    NAT_VIEWS,
    "SELECT ip, company, country, domain, network_type, asnum FROM (SELECT *, row_number() OVER (PARTITION BY ip "
    "ORDER BY account_name, subvertical, ua, total) AS rn FROM nat) WHERE rn = 1",
    NAT,
)

# ---------------------------------------------------------------- logins

add(
    "ato_profile",
    "logins",
    "SELECT ip, count(DISTINCT host) AS count_hosts, count(DISTINCT email_hash) AS count_emails, "
    f"string_agg(DISTINCT host, ',' ORDER BY host) AS host_collection, 0 AS list_part FROM v_logins WHERE {MONTH} GROUP BY ip",
)
add(
    "ato_totals",
    "logins",
    "SELECT CAST(sum(h) AS BIGINT) AS hosts, CAST(sum(e) AS BIGINT) AS emails FROM (SELECT ip, count(DISTINCT host) "
    f"AS h, count(DISTINCT email_hash) AS e FROM v_logins WHERE {MONTH} GROUP BY ip)",
)

add(
    "ato_profile_approx",
    "logins",
    f"SELECT ip, count(DISTINCT host) AS hosts, count(DISTINCT email_hash) AS emails, TRUE AS near FROM v_logins WHERE {MONTH} GROUP BY ip",
)
CHECKS["sketched_clients"] = """SELECT event_type, CAST(epoch_us(ts) // 86400000000 AS INTEGER) AS day, count(*) AS n,
    count(DISTINCT user_id) AS users, TRUE AS near FROM events GROUP BY ALL"""
_HOURS = [AS_OF - 14 * 86400000 - LAG, NOW]
_HOURS = [bound // 3600000 * 3600000 for bound in _HOURS]
CHECKS["sketched_window"] = f"""SELECT count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS near FROM events
    WHERE epoch_us(ts) // 1000 >= {_HOURS[0]} AND epoch_us(ts) // 1000 < {_HOURS[1]}"""

# ---------------------------------------------------------------- client intelligence

add(
    "client_intel_rollup",
    "intel",
    "SELECT DISTINCT 'category' AS kind, category AS value FROM found UNION ALL "
    "SELECT * FROM (SELECT DISTINCT 'host' AS kind, unnest(hosts) AS value FROM found) WHERE value <> '' UNION ALL "
    "SELECT * FROM (SELECT DISTINCT 'account' AS kind, unnest(accounts) AS value FROM found) WHERE value <> ''",
    FOUND,
)
add("attack_hours", "intel", "SELECT DISTINCT hour FROM found", FOUND)
add(
    "heuristic_hosts",
    "intel",
    "SELECT heuristic, string_agg(DISTINCT attacked, ',' ORDER BY attacked) AS hosts, 0 AS list_part FROM found GROUP BY heuristic",
    FOUND,
)
PER_ACCOUNT = """, pairs AS (SELECT DISTINCT unnest(accounts) AS account, heuristic FROM found),
    per AS (SELECT account, string_agg(heuristic, ',' ORDER BY heuristic) AS heuristics FROM pairs GROUP BY account)"""
add("account_heuristics", "intel", "SELECT account, heuristics, 0 AS list_part FROM per", FOUND + PER_ACCOUNT)
add(
    "attacked_accounts",
    "intel accounts",
    "SELECT per.account, coalesce(n.name, '(ACCOUNT DETAILS MISSING)') AS account_name, "
    "coalesce(n.name, per.account) AS sort_name, heuristics, 0 AS list_part FROM per LEFT JOIN "
    "(SELECT CAST(account AS VARCHAR) AS account, min(account_name) AS name FROM v_accounts GROUP BY 1) n "
    "ON per.account = n.account WHERE per.account <> ''",
    FOUND + PER_ACCOUNT,
)
add(
    "evidence",
    "intel scores properties host_stats networks ips",
    f"""SELECT d.client_id AS ip, g.company, g.domain, d.heuristic_name, d.score, p.key, p.value, h.hosts,
        0 AS list_part, d.ts
    FROM v_scores d JOIN v_properties p ON d.id = p.id AND d.ts = p.ts
    LEFT JOIN (SELECT id, ts, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM v_host_stats
               WHERE ts IN (SELECT hour FROM found) GROUP BY id, ts) h ON d.id = h.id AND d.ts = h.ts
    LEFT JOIN v_networks g ON {number('d.client_id')} BETWEEN g.lo AND g.lo + 65535
    WHERE d.client_id IN (SELECT ip FROM v_ips) AND d.ts IN (SELECT hour FROM found)
      AND p.ts IN (SELECT hour FROM found) AND d.heuristic_name NOT LIKE '%Score%' AND d.group_ids LIKE '%production%'""",
    FOUND,
)

# ---------------------------------------------------------------- metrics and time windows

HOURLY = f"""SELECT concat('heuristics.', heuristic_name, '.dc1') AS path, count(DISTINCT client_id) AS count_ips,
    CAST(ts // 1000 AS VARCHAR) AS ts FROM v_scores WHERE group_ids LIKE '%production%'
    AND ts >= {AS_OF - 14 * 86400000 - LAG} AND ts <= {NOW} GROUP BY heuristic_name, ts"""
add("heuristic_hourly", "scores", HOURLY)
add("metric_points", "scores", f"SELECT concat(path, ' ', count_ips, ' ', ts) AS value FROM ({HOURLY})")
HOUR, DAY = 3600000, 86400000
TOKEN_REACH = {
    "@hour_ago": HOUR,
    "@5_hours_ago": 5 * HOUR,
    "@day_ago": DAY,
    "@3_days_ago": 3 * DAY,
    "@week_ago": 7 * DAY,
    "@2_weeks_ago": 14 * DAY,
    "@month_ago": 14 * DAY,
    "@30_mins_ago": 1800000,
}
add(
    "time_token_window",
    "requests",
    " UNION ALL ".join(
        f"SELECT '{token}' AS token, {NOW - reach} AS lo, {NOW} AS hi, count(*) AS n FROM v_requests "
        f"WHERE ts >= {NOW - reach} AND ts < {NOW}"
        for token, reach in TOKEN_REACH.items()
    ),
)
add(
    "templated_sql",
    "requests",
    "SELECT ip, count(*) AS requests, CAST(sum(total_counter) AS BIGINT) AS total FROM v_requests "
    f"WHERE ts >= {NOW - 14 * DAY} AND ts < {NOW} AND ts <> 1705739400000 GROUP BY ip",
)
add(
    "full_day_sql",
    "",
    "SELECT ip, count(*) AS requests FROM v_requests WHERE ts >= epoch_ms(TIMESTAMP '2024-01-22 00:00:00') "
    "AND ts < epoch_ms(TIMESTAMP '2024-01-23 00:00:00') GROUP BY ip",
    f"v_requests AS ({check_view('requests')})",
)
add(
    "span_window",
    "requests",
    "SELECT ip, count(*) AS requests FROM v_requests WHERE ts >= epoch_ms(TIMESTAMP '2024-01-29 09:00:00') "
    "AND ts < epoch_ms(TIMESTAMP '2024-01-29 14:00:00') GROUP BY ip",
)

# ---------------------------------------------------------------- addresses and ranges

add(
    "ip_expand",
    "ranges",
    f"SELECT range_id, address, {dotted('address')} AS ip FROM (SELECT range_id, unnest(generate_series(lo, hi)) AS address FROM v_ranges)",
)
add(
    "ip_cidr_cover",
    "ranges",
    f"SELECT range_id, concat({dotted('cur')}, '/', 32 - CAST(log2(size) AS INTEGER)) AS cidr FROM walk WHERE cur <= hi",
    """first AS (SELECT range_id, lo AS cur, hi FROM v_ranges),
    walk AS (SELECT range_id, cur, hi, least(cur & (-cur), CAST(2 ** floor(log2(hi - cur + 1)) AS BIGINT)) AS size FROM first
        UNION ALL SELECT range_id, cur + size, hi,
            least((cur + size) & (-(cur + size)), CAST(2 ** floor(log2(greatest(hi - cur - size + 1, 1))) AS BIGINT))
        FROM walk WHERE cur + size <= hi)""",
    recursive=True,
)
STRICT = "regexp_full_match(clean, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')"
add(
    "ip_validate",
    "address_tokens",
    f"SELECT event_id, clean, {STRICT} AS is_ipv4, {STRICT} OR contains(clean, ':') AS is_address, "
    f"CASE WHEN {STRICT} THEN {number('clean')} END AS address FROM "
    "(SELECT event_id, replace(replace(replace(replace(token, '\"', ''), ',', ''), '[', ''), ']', '') AS clean FROM v_address_tokens)",
)
add(
    "ip_range_normalise",
    "ranges",
    f"SELECT range_id, concat({dotted('lo')}, '-', hi % 256) AS text, {dotted('least(lo, e)')} AS first, "
    f"{dotted('greatest(lo, e)')} AS last FROM (SELECT *, lo // 256 * 256 + hi % 256 AS e FROM v_ranges)",
)
add(
    "ip_reverse",
    "ips",
    "SELECT ip, concat(split_part(ip, '.', 4), '.', split_part(ip, '.', 3), '.', split_part(ip, '.', 2), '.', "
    "split_part(ip, '.', 1)) AS reversed FROM v_ips",
)
add("ip_numbers", "requests", f"SELECT event_id, {number('ip')} AS number, ip AS back, ip AS from_binary FROM v_requests")
INSIDE = f"EXISTS (SELECT 1 FROM v_ranges r WHERE {number('i.ip')} BETWEEN r.lo AND r.hi)"
add("ip_membership", "ips ranges", f"SELECT ip, {INSIDE} AS in_set FROM v_ips i")
add("request_membership", "requests ranges", f"SELECT event_id, ip, {INSIDE} AS in_set FROM v_requests i")
add("ip_not_in", "ips ranges", f"SELECT ip FROM v_ips i WHERE NOT {INSIDE}")
add("ip_in", "ips ranges", f"SELECT ip FROM v_ips i WHERE {INSIDE}")
add(
    "ip_enrich",
    "requests owners ips",
    "SELECT event_id, ip, owner FROM v_requests LEFT JOIN best USING (ip)",
    f"""best AS (SELECT ip, owner FROM (SELECT i.ip, o.owner, row_number() OVER (PARTITION BY i.ip
        ORDER BY o.prefix_len DESC, o.owner) AS rn FROM v_ips i JOIN v_owners o
        ON {number('i.ip')} BETWEEN o.lo AND o.lo + CAST(2 ** (32 - o.prefix_len) AS BIGINT) - 1) WHERE rn = 1)""",
)
add(
    "merge_intervals",
    "overlaps ips",
    "SELECT min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(n) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM "
    "(SELECT lo, hi, CASE WHEN lo <= max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 "
    "THEN 0 ELSE 1 END AS n FROM every)) GROUP BY g",
    f"every AS (SELECT lo, hi FROM v_overlaps UNION ALL SELECT {number('ip')}, {number('ip')} FROM v_ips)",
)
DRIFT = """SELECT prefix, CASE WHEN o.prefix IS NULL THEN 'added' WHEN n.prefix IS NULL THEN 'removed' ELSE 'unchanged' END
    AS status, CAST(CASE WHEN o.prefix IS NULL THEN 1 WHEN n.prefix IS NULL THEN -1 ELSE 0 END AS BIGINT) AS change
    FROM {old} o FULL JOIN {new} n USING (prefix)"""
PLAIN_DRIFT = DRIFT.format(old="v_prefix_old", new="v_prefix_new")
add("prefix_drift", "prefix_old prefix_new", PLAIN_DRIFT)
add(
    "prefix_drift_summary",
    "prefix_old prefix_new",
    "SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, "
    "count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status <> 'unchanged') = 0 AS equal "
    f"FROM ({PLAIN_DRIFT})",
)
add(
    "range_symmetric_difference",
    "ranges overlaps",
    "SELECT lo, hi FROM (SELECT lo, hi FROM v_ranges UNION ALL SELECT lo, hi FROM v_overlaps) GROUP BY lo, hi HAVING count(*) = 1",
)
add(
    "cloud_range_drift",
    "prefix_old prefix_new",
    DRIFT.format(old="v_prefix_old", new="ec2"),
    "ec2 AS (SELECT prefix FROM v_prefix_new WHERE prefix NOT LIKE '%.7.%')",
)
add(
    "cloud_membership",
    "requests cloud_entries",
    f"""SELECT event_id, ip, CASE WHEN EXISTS (SELECT 1 FROM b WHERE {number('i.ip')} BETWEEN b.lo AND b.hi)
        THEN 'IN' ELSE 'NOT IN' END AS label FROM v_requests i""",
    f"""b AS (SELECT {number("split_part(value, '/', 1)")} AS lo, {number("split_part(value, '/', 1)")} + 7 AS hi
              FROM v_cloud_entries WHERE value LIKE '%/29'
        UNION ALL SELECT {number("split_part(value, '-', 1)")}, {number("split_part(value, '-', 1)")} + 9
              FROM v_cloud_entries WHERE value LIKE '%-%'
        UNION ALL SELECT {number('value')}, {number('value')} FROM v_cloud_entries
              WHERE value NOT LIKE '%-%' AND value NOT LIKE '%/%')""",
)
add("listed_requests", "requests logins", "SELECT event_id, ip FROM v_requests WHERE ip IN (SELECT ip FROM v_logins)")
QUAD = "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
LINES = f"""
    split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_no, unnest(parts) AS line FROM split),
    spots AS (SELECT *, regexp_extract_all(line, '[0-9.]+') AS runs FROM lines WHERE regexp_matches(line, '{QUAD}')),
    tokens AS (SELECT doc_id, line_no, unnest(runs) AS run FROM spots),
    trimmed AS (SELECT doc_id, line_no, regexp_replace(run, '[.]+$', '') AS tok FROM tokens),
    named AS (SELECT tok AS ip FROM trimmed WHERE regexp_full_match(tok, '{QUAD}')),
    wanted AS (SELECT ip FROM named UNION SELECT regexp_replace(ip, '([0-9])[0-9]$', '\\1') FROM named UNION SELECT ip FROM v_ips)"""
add("ip_search_lines", "ips", "SELECT ip, doc_id, line_no, line FROM spots JOIN wanted ON contains(line, ip)", LINES)
add("ip_search_tokens", "ips", "SELECT DISTINCT ip, doc_id, line_no FROM trimmed JOIN wanted ON tok = ip", LINES)

# ---------------------------------------------------------------- typed load

VALUE_TYPE = """CASE WHEN regexp_full_match(v, '\\s*[+-]?[0-9]+\\s*') THEN
        CASE WHEN abs(try_cast(v AS HUGEINT)) <= 2147483647 THEN 'int' ELSE 'bigint' END
    WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'double'
    WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v AS DATE) IS NOT NULL THEN 'date' ELSE 'text' END"""


def votes_sql(tag: str, lines: str, key: str, header: list[str], keep: str = "TRUE") -> str:
    values = ", ".join(f"{{'c': '{name}', 'o': {i}, 'v': f[{i + 1}]}}" for i, name in enumerate(header))
    return f"""
    {tag}_f AS (SELECT {key} AS k, string_split(line, chr(9)) AS f FROM {lines} WHERE {keep}),
    {tag}_c AS (SELECT k, unnest([{values}]) AS s FROM {tag}_f),
    {tag}_t AS (SELECT k, s.c AS c, s.o AS o, {VALUE_TYPE.replace('(v', '(s.v').replace(' v ', ' s.v ')} AS t FROM {tag}_c),
    {tag}_g AS (SELECT c, o, t, count(*) AS n, min(k) AS first FROM {tag}_t GROUP BY c, o, t),
    {tag}_r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, first) AS rn FROM {tag}_g),
    {tag} AS (SELECT c AS "column", o AS ordinal, CASE WHEN bool_or(t = 'text') THEN 'text' WHEN bool_or(t = 'bigint')
        THEN 'bigint' ELSE max(t) FILTER (WHERE rn = 1) END AS type, CAST(sum(n) AS BIGINT) AS votes FROM {tag}_r GROUP BY c, o)"""


ORDER_VOTES = votes_sql("ov", "v_order_lines", "o_orderkey", ORDER_HEADER, "o_orderkey % 97 <> 0")
CUSTOMER_VOTES = votes_sql("cv", "v_customer_lines", "c_custkey", CUSTOMER_HEADER)
add("type_vote", "order_lines", "SELECT * FROM ov", ORDER_VOTES)
add(
    "schema_diff",
    "order_lines customer_lines",
    "SELECT ordinal, type FROM (SELECT ordinal, type FROM ov UNION ALL SELECT ordinal, type FROM cv) "
    "GROUP BY ordinal, type HAVING count(*) = 1",
    ORDER_VOTES + "," + CUSTOMER_VOTES,
)
CHECKS["typed_load"] = """SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey,
    CAST(o_orderkey AS INTEGER) AS order_key, CAST(o_custkey AS INTEGER) AS cust_key, o_orderkey * 10000000 AS big,
    o_orderstatus AS status, o_totalprice AS total_price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date,
    CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 7 END AS mixed, o_orderpriority AS priority
    FROM orders WHERE o_orderkey % 97 <> 0"""
add("rejected_lines", "order_lines", "SELECT line FROM v_order_lines WHERE o_orderkey % 97 = 0")
CHECKS["unfit_values"] = """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 97 <> 0)
    SELECT 'order_key' AS "column", count(*) FILTER (WHERE o_orderkey > 2147483647) AS unfit FROM o
    UNION ALL SELECT 'cust_key', count(*) FILTER (WHERE o_custkey > 2147483647) FROM o
    UNION ALL SELECT 'big', count(*) FILTER (WHERE o_orderkey * 10000000 > 2147483647) FROM o
    UNION ALL SELECT 'status', count(*) FILTER (WHERE o_orderstatus <> '') FROM o
    UNION ALL SELECT 'total_price', count(*) FILTER (WHERE o_totalprice IS NOT NULL) FROM o
    UNION ALL SELECT 'order_date', 0 FROM (SELECT 1)
    UNION ALL SELECT 'mixed', count(*) FILTER (WHERE o_orderkey % 4 = 3) FROM o
    UNION ALL SELECT 'priority', count(*) FILTER (WHERE o_orderpriority <> '') FROM o"""
CHECKS["split_files"] = """SELECT o_orderkey, o_orderstatus, rn AS row_no,
    CAST(1 + rn // greatest((n + 1) // 8, 1) AS INTEGER) AS part
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)"""

CHECKS["evidence_by_hour"] = CHECKS["evidence"]
add("counted_files", "requests", "SELECT ip AS key, count(*) AS n FROM v_requests GROUP BY ip")
_NAMES = ", ".join(f"'{name}'" for name in PRODUCTS)
_PER = len(MAJOR_VERSIONS) + 1
# All products stand as Name/digits here: the rule is that of the first product and its number of digits.
CHECKS["agent_rules"] = f"""WITH names AS (SELECT [{_NAMES}] AS n), agents AS (
    SELECT DISTINCT concat('Mozilla/5.0 ', list_extract(n, CAST(event_id % {len(PRODUCTS)} AS INTEGER) + 1), '/', user_id % 1200, '.1 ',
      list_extract(n, CAST((event_id * 7 + 3) % {len(PRODUCTS)} AS INTEGER) + 1), '/', event_id % 40) AS agent FROM events, names),
    found AS (SELECT agent, regexp_extract_all(agent, '[A-Za-z0-9]+/[0-9]+') AS pairs FROM agents),
    pairs AS (SELECT agent, unnest(pairs) AS pair, generate_subscripts(pairs, 1) AS place FROM found),
    parts AS (SELECT agent, place, split_part(pair, '/', 1) AS product, split_part(pair, '/', 2) AS digits FROM pairs),
    ranked AS (SELECT agent, place, product, digits, (list_position(n, product) - 1) * {_PER} + least(length(digits), {_PER}) AS rule_no FROM parts, names)
    SELECT agent, CAST(rule_no AS INTEGER) AS rule_no,
      product || CASE WHEN length(digits) < {_PER} THEN ' ' || repeat('x', length(digits)) ELSE '' END AS label,
      CASE WHEN length(digits) < {_PER} THEN digits ELSE product END AS part
    FROM ranked QUALIFY row_number() OVER (PARTITION BY agent ORDER BY rule_no, place) = 1"""

# ---------------------------------------------------------------- files, archives and tables

NOTED = """replace(replace(replace(coalesce(text, ''), ' the ', ' "the"' || chr(9)), '. ', '.' || chr(10)), 'ab', 'a\\')"""
CHECKS["quoted_records"] = f"SELECT doc_id, coalesce(lang, '') AS lang, md5({NOTED}) AS text_md5 FROM documents"
CHECKS["quoted_sink"] = CHECKS["quoted_records"]
CHECKS["archived_lines"] = f"""SELECT doc_id, CAST(len(string_split({NOTED}, chr(10))) AS BIGINT) AS n_lines, md5({NOTED}) AS text_md5,
    TRUE AS numbered FROM documents"""
add("listed_lines", "address_tokens", "SELECT rtrim(token, ' ' || chr(9)) AS value, count(*) AS n FROM v_address_tokens GROUP BY ALL")
_LEFT = "o_orderkey % 4 IN (0, 2) OR (o_orderkey % 4 = 3 AND o_orderstatus = 'F')"
_STATES = {
    "appended": "o_orderkey % 4 < 3", "load repeated with other rows": _LEFT, "replace refused": _LEFT, "append refused": _LEFT,
    "replaced": "TRUE", "renamed": "o_orderkey % 4 = 0",
}
CHECKS["table_lifecycle"] = " UNION ALL ".join(
    f"""SELECT '{step}' AS step, o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE {rows} GROUP BY o_orderstatus"""
    for step, rows in _STATES.items()
)

# ---------------------------------------------------------------- logs, rules, JSON

LOG_NAMES = {
    "TimeStamp": "CAST(ts AS VARCHAR)",
    "Client IP": "ip",
    "Http Method": "'GET'",
    "ARL": "concat('/a b/', event_id, '?q=x+y/z')",
    "Status Code": "CASE WHEN event_id % 5 = 0 THEN '404' ELSE '200' END",
    "Content Type": "'-'",
    "Host": "'www.example'",
    "Cookies": "'-'",
    "Referer": "'-'",
    "User Agent": "user_agent",
    "If Modified Since": "'-'",
    "SSL": "'-'",
    "Request Number": "CAST(total_counter AS VARCHAR)",
    "Client request header size": "'-'",
    "Accept Language": "'-'",
    "Request ID": "'-'",
    "X-Forwarded-For": "'-'",
    "Filtered Forward-IP": "'-'",
    "Client rate limiting configuration": "'-'",
    "Client Request Body Size - POST/PUT requests": "'-'",
    "WAF Info (triggered waf rules)": "'rule \"2005\" %zz'",
    "Multi Purpase Name Value": "'-'",
    "Request body inspection details": "'-'",
    "QuickRetry Information": "concat('end', cpcode)",
}
add(
    "log_parse",
    "requests",
    "SELECT event_id, " + ", ".join(f'{e} AS "{n}"' for n, e in LOG_NAMES.items()) + " FROM v_requests",
)
add("url_unquote", "packed_urls", "SELECT page_id, url_decode(url) AS url FROM v_packed_urls")
add("noise_filter", "client_lines", "SELECT * FROM v_client_lines WHERE event_id % 10 NOT IN (0, 1)")
add("tab_lines", "client_lines", "SELECT * FROM v_client_lines WHERE event_id % 10 NOT IN (1, 2)")
add(
    "rule_category",
    "rule_rows",
    """SELECT *, CASE WHEN r BETWEEN 1000 AND 1007 THEN 'SQLi' WHEN r = 2000 THEN 'CMDi' WHEN r IN (2001, 2006) THEN 'RFI'
        WHEN r IN (2002, 2003, 2004, 2007, 2008) THEN 'PHPi' WHEN r = 2005 THEN 'RFIi' WHEN r IN (2009, 3000) THEN 'Scanners'
        WHEN r BETWEEN 4000 AND 4005 OR r = 5000 THEN 'XSS' WHEN r BETWEEN 6000 AND 6003 THEN 'LFI' END AS category
    FROM (SELECT *, CAST(rule_id AS INTEGER) AS r FROM v_rule_rows) WHERE category IS NOT NULL""".replace("SELECT *,", "SELECT * EXCLUDE (r),", 1),
)
add(
    "json_quality",
    "json_texts",
    """SELECT event_id, event_id % 8 NOT IN (5, 6) AS valid,
        CASE event_id % 8 WHEN 1 THEN 'k' WHEN 7 THEN 'b' ELSE '' END AS duplicate_keys,
        CASE event_id % 8 WHEN 2 THEN 'l=1' WHEN 3 THEN 'o.l=x' ELSE '' END AS duplicate_values FROM v_json_texts""",
)
add(
    "json_override",
    "ranges",
    f"SELECT {dotted('block * 256')} AS first_ip, concat('{{', string_agg(concat('\"', {dotted('address')}, '\":{{\"Other\":0}}'), ',' "
    "ORDER BY address), '}') AS document FROM (SELECT DISTINCT address, address // 256 AS block FROM "
    "(SELECT unnest(generate_series(lo, hi)) AS address FROM v_ranges)) GROUP BY block",
)
add(
    "json_whitelist",
    "requests prefix_new",
    """SELECT code, part, concat('{"global":{"', code, '":[', list, ']}}') AS document FROM packed
       CROSS JOIN (SELECT DISTINCT CAST(cpcode AS VARCHAR) AS code FROM v_requests)""",
    """n AS (SELECT greatest(CAST(ceil(count(*) / 20.0) AS INTEGER), 1) AS n FROM v_prefix_new),
    packed AS (SELECT CAST(CAST(concat('0x', substring(md5(prefix), 1, 8)) AS BIGINT) % n.n AS INTEGER) AS part,
        string_agg(concat('"', prefix, '"'), ',' ORDER BY prefix) AS list FROM v_prefix_new, n GROUP BY 1)""",
)

# ---------------------------------------------------------------- fingerprints, reputation

B = "don''t fragment bit set and id non-zero (ipv4)"
A = "don''t fragment bit set (ipv4)"
add(
    "tcp_fingerprint",
    "fingerprints",
    "SELECT user_id, fp, ip_version, CAST(ttl AS BIGINT) AS ttl, CAST(distance AS BIGINT) AS distance, "
    "CAST(initial_ttl AS BIGINT) AS initial_ttl, CAST(\"window\" AS BIGINT) AS \"window\", CAST(mss AS BIGINT) AS mss, "
    "CAST(scale AS BIGINT) AS scale, quirk_meanings, CAST(mtu AS BIGINT) AS mtu, link_type, raw_signature, "
    "general_signature FROM v_fingerprints JOIN x ON user_id % 5 = k",
    f"""x(k, ip_version, ttl, distance, initial_ttl, "window", mss, scale, quirk_meanings, mtu, link_type, raw_signature, general_signature) AS (VALUES
    (0, '4', 64, 0, 64, 65535, 1460, 1, '{B}', 1500, 'Ethernet or modem (PPPoE)', '4:64:0:1460:65535,1:mss,nop,ws,nop,nop,ts,sok,eol+1:df,id+:0', '*:64:0:*:44*mss,1:mss,nop,ws,nop,nop,ts,sok,eol+1:df,id+:0'),
    (1, '4', 116, 12, 128, 8192, 1460, 8, '{B}', 1500, 'Ethernet or modem (PPPoE)', '4:128:0:1460:8192,8:mss,nop,ws,nop,nop,sok:df,id+:0', '*:128:0:*:5*mss,8:mss,nop,ws,nop,nop,sok:df,id+:0'),
    (2, '4', 57, 7, 64, 29200, 1460, 7, '{B}', 1500, 'Ethernet or modem (PPPoE)', '4:64:0:1460:29200,7:mss,sok,ts,nop,ws:df,id+:0', '*:64:0:*:20*mss,7:mss,sok,ts,nop,ws:df,id+:0'),
    (3, '4', 128, 0, 128, 65535, 1460, 0, '{B}', 1500, 'Ethernet or modem (PPPoE)', '4:128:0:1460:65535,0:mss,nop,nop,sok:df,id+:0', '*:128:0:*:44*mss,0:mss,nop,nop,sok:df,id+:0'),
    (4, '4', 60, 4, 64, 16384, 1460, 0, '{A}; malformed tcp options (tcp)', 1500, 'Ethernet or modem (PPPoE)', '4:64:0:1460:16384,0:mss:df,bad:0', '*:64:0:*:11*mss,0:mss:df,bad:0'))""",
)
STRICT_MATCHES = """
    (0, 's:unix:Mac OS X:10.x', '*:64:0:*:65535,1:mss,nop,ws,nop,nop,ts,sok,eol+1:df,id+:0'),
    (0, 'g:unix:Mac OS X:', '*:64:0:*:65535,*:mss,nop,ws,nop,nop,ts,sok,eol+1:df,id+:0'),
    (1, 's:win:Windows:7 or 8', '*:128:0:*:8192,8:mss,nop,ws,nop,nop,sok:df,id+:0'),
    (1, 'g:win:Windows:NT kernel 6.x', '*:128:0:*:8192,*:mss,nop,ws,nop,nop,sok:df,id+:0'),
    (1, 'g:win:Windows:NT kernel', '*:128:0:*:*,*:mss,nop,ws,nop,nop,sok:df,id+:0'),
    (2, 'g:unix:Linux:2.2.x-3.x', '*:64:0:*:*,*:mss,sok,ts,nop,ws:df,id+:0'),
    (3, 's:win:Windows:XP', '*:128:0:*:65535,0:mss,nop,nop,sok:df,id+:0'),
    (3, 'g:win:Windows:NT kernel 5.x', '*:128:0:*:65535,*:mss,nop,nop,sok:df,id+:0'),
    (3, 'g:win:Windows:NT kernel', '*:128:0:*:*,*:mss,nop,nop,sok:df,id+:0')"""
LOOSE_MATCHES = STRICT_MATCHES + """,
    (2, 's:unix:Linux:3.11 and newer', '*:64:0:*:mss*20,7:mss,sok,ts,nop,ws:df,id+:0')"""
for _name, _rows in (("tcp_os_match", LOOSE_MATCHES), ("tcp_os_match_strict", STRICT_MATCHES)):
    add(
        _name,
        "fingerprints",
        "SELECT user_id, os, signature FROM v_fingerprints JOIN x ON user_id % 5 = k",
        f"x(k, os, signature) AS (VALUES {_rows})",
    )
add(
    "blacklist_consolidate",
    "ips scan_feed category_feed spam_feed threat_feed",
    """SELECT ip, coalesce(s.r, 'Not Listed') AS scan, coalesce(t.r, 'Not Listed') AS threat,
        coalesce(c.r, 'Not Listed') AS category, coalesce(p.r, 'Not Listed') AS spam
    FROM (SELECT ip, concat(split_part(ip, '.', 4), '.', split_part(ip, '.', 3), '.', split_part(ip, '.', 2), '.10') AS rev FROM v_ips)
    LEFT JOIN s USING (ip) LEFT JOIN c USING (ip) LEFT JOIN p USING (ip) LEFT JOIN t ON rev = t.reversed_ip""",
    """s AS (SELECT ip, nullif(regexp_extract(max(body), 'BLACKLISTED [0-9]+/[0-9]+'), '') AS r FROM v_scan_feed GROUP BY ip),
    c AS (SELECT ip, 'Threat ' || nullif(regexp_extract(max(body), 'Categories":\\[".*?\\]'), '') AS r
          FROM v_category_feed GROUP BY ip),
    p AS (SELECT ip, CASE WHEN b LIKE '%<appears>yes<%' THEN concat('Listed (Frequency: ',
            regexp_extract(b, '<frequency>([0-9]+)', 1), ', Last Seen: 2024-01-02)') ELSE 'Not Listed' END AS r
          FROM (SELECT ip, max(body) AS b FROM v_spam_feed GROUP BY ip)),
    t AS (SELECT reversed_ip, CASE split_part(max(body), '.', 4) WHEN '0' THEN 'Search Engine' WHEN '1' THEN 'Suspicious'
            WHEN '2' THEN 'Harvester' WHEN '3' THEN 'Suspicious Harvester' WHEN '4' THEN 'Comment Spammer'
            WHEN '5' THEN 'Suspicious Comment Spammer' WHEN '6' THEN 'Harvester / Comment Spammer'
            WHEN '7' THEN 'Suspicious / Harvester / Comment Spammer' ELSE 'Not Listed' END AS r
          FROM v_threat_feed GROUP BY reversed_ip)""",
)
CHECKS["spf_include"] = """SELECT DISTINCT concat('_spf.n', s_nationkey, '.example') AS name,
    concat('_nb', s_suppkey, '.example') AS target,
    unnest([concat('ip4:10.', s_suppkey % 200, '.0.0/16'), concat('ip4:172.16.', s_suppkey % 250, '.0/24')]) AS token FROM supplier"""

# ---------------------------------------------------------------- counting and activity

add("ip_counter", "requests", "SELECT ip, count(*) AS count FROM v_requests GROUP BY ip")
DAYS = """d AS (SELECT ip, count(DISTINCT ts // 86400000) AS num_days,
    max(ts // 86400000) - min(ts // 86400000) + 1 - count(DISTINCT ts // 86400000) AS days_gap FROM v_logins GROUP BY ip)"""
add("active_days", "logins", "SELECT * FROM d", DAYS)
add("activity_gaps", "logins", "SELECT num_days, days_gap, count(*) AS num_ips FROM d GROUP BY num_days, days_gap", DAYS)
add(
    "heuristic_stream",
    "scores",
    """SELECT concat('heuristics.', heuristic_name, '.dc1') AS path, count(DISTINCT client_id) AS count_ips, ts // 1000 AS ts
    FROM v_scores WHERE group_ids LIKE '%production%' GROUP BY heuristic_name, ts""",
)
