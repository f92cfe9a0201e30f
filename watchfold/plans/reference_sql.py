"""SQL fragments shared by the check queries. They restate the columns of ``driver_tables``
and the definitions of the operators independently of how the operators compute them."""

EV = """
ev AS (
  SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS raw_us,
    CAST(json_extract(props, '$.k') AS INTEGER) AS k,
    1704067200000000 + (epoch_us(ts) - 1704067200000000) // 60 AS us,
    CASE user_id % 5 WHEN 0 THEN '10.1.0.7' WHEN 1 THEN '172.200.4.9' WHEN 2 THEN '203.0.113.44'
      WHEN 3 THEN NULL ELSE '' END AS src_ip,
    CASE user_id % 5 WHEN 3 THEN 'svc-backup' WHEN 4 THEN NULL
      ELSE CASE WHEN user_id % 2 = 0 THEN 'root' ELSE 'alice' END END AS user_name,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'host-' || (user_id % 3) END AS host_name,
    CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
    CASE WHEN event_type IN ('error', 'signup') THEN 'auth' WHEN event_type = 'click' THEN 'process'
      ELSE 'network' END AS event_class,
    CASE event_type WHEN 'error' THEN 'ssh_login_failed' WHEN 'signup' THEN 'ssh_login_success'
      WHEN 'click' THEN 'sudo_command' ELSE 'network_flow' END AS action,
    CASE WHEN event_id % 3 = 0 THEN -60.0 + 20 * (event_id % 7) END AS lat,
    CASE WHEN event_id % 3 = 0 THEN -150.0 + 30 * (event_id % 11) END AS lon,
    CAST(floor(value * 1e6) AS BIGINT) AS nbytes,
    CASE event_id % 4 WHEN 0 THEN 'syslog' WHEN 1 THEN 'auth_log' WHEN 2 THEN 'cloudtrail'
      ELSE 'cicids' END AS source_type,
    least(CAST(round(value * 100) AS BIGINT) * 5 // 6, 10000) / 10000.0 AS score
  FROM events),
e AS (
  SELECT *,
    coalesce(nullif(src_ip, ''), nullif(user_name, ''), 'unknown') AS entity,
    coalesce(nullif(src_ip, ''), nullif(host_name, ''), nullif(user_name, ''), 'unknown') AS entity2,
    CASE k % 10 WHEN 0 THEN 22 WHEN 1 THEN 3389 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 445
      WHEN 5 THEN 139 WHEN 6 THEN 0 ELSE 1000 + k END AS port,
    CASE WHEN k = 99 THEN '' WHEN k < 50 THEN '10.0.0.' || (k % 20) ELSE '198.51.100.' || k END AS dip,
    CASE WHEN event_type = 'click' THEN CASE WHEN k < 40 THEN 'sudo systemctl restart svc' || k
      WHEN k < 60 THEN 'chmod u+s /usr/bin/tool' ELSE 'ls -la' END ELSE '' END AS command_line,
    CASE WHEN event_type = 'click' THEN CASE k % 4 WHEN 0 THEN 'winword.exe' WHEN 1 THEN 'excel.exe'
      ELSE 'explorer.exe' END ELSE '' END AS parent_process,
    CASE WHEN event_type = 'click' THEN CASE k % 3 WHEN 0 THEN 'cmd.exe' WHEN 1 THEN 'powershell.exe'
      ELSE 'notepad.exe' END ELSE '' END AS process,
    us // 300000000 AS bucket
  FROM ev)"""

# Sliding windows by a self join on (entity, arrival order); running values inside the bucket.
WINDOWED = """
c AS (
  SELECT a.event_id,
    count(*) FILTER (b.us >= a.us - 60000000) AS c1m,
    count(*) FILTER (b.us >= a.us - 300000000) AS c5m,
    count(*) AS c1h,
    count(*) FILTER (b.us >= a.us - 300000000 AND b.outcome = 'failure') AS f5m,
    count(DISTINCT CASE WHEN b.bucket = a.bucket THEN nullif(b.port, 0) END) AS ports,
    count(DISTINCT CASE WHEN b.bucket = a.bucket THEN nullif(b.dip, '') END) AS ips,
    sum(CASE WHEN b.bucket = a.bucket THEN b.nbytes END) AS bytes
  FROM e a JOIN e b ON a.entity = b.entity AND b.us >= a.us - 3600000000
    AND (b.us < a.us OR (b.us = a.us AND b.event_id <= a.event_id))
  GROUP BY a.event_id)"""

# Sum of squares of the 24 counters as a running total of 2v+1 per increment.
TOD = """
r AS (
  SELECT event_id, us,
    row_number() OVER (PARTITION BY (us // 3600000000) % 24 ORDER BY us, event_id) AS rh,
    row_number() OVER (ORDER BY us, event_id) AS n
  FROM e),
q AS (
  SELECT event_id, rh, n, 24 + sum(2 * rh + 1) OVER (ORDER BY us, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qq
  FROM r),
z AS (
  SELECT event_id, CASE WHEN qq / 24.0 - pow((24 + n) / 24.0, 2) > 0 THEN
    (rh + 1 - (24 + n) / 24.0) / sqrt(qq / 24.0 - pow((24 + n) / 24.0, 2)) ELSE 0 END AS tod
  FROM q)"""

GEO = """
g AS (
  SELECT event_id, us, lat, lon,
    lag(us) OVER w AS pus, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
  FROM e WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY us, event_id)),
v AS (
  SELECT event_id, CASE WHEN pus IS NULL THEN 0 ELSE
    6371.0 * 2 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2)
      + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))))
    / greatest((us - pus) / 1e6, 1.0) * 3600 END AS vel
  FROM g)"""

# All nine features per event.
NINE = f"""WITH {EV}, {WINDOWED}, {TOD}, {GEO},
nine AS (
  SELECT e.*, c1m, c5m, c1h, f5m / greatest(c5m, 1) AS ratio, ports, ips, bytes,
    tod, coalesce(vel, 0) AS vel
  FROM e JOIN c USING (event_id) JOIN z USING (event_id) LEFT JOIN v USING (event_id))"""
