"""Date and time functions."""

from tarn.plans.registry import register as q

q("dte_extract", """SELECT event_id, extract(YEAR FROM ts)::bigint AS y, extract(MONTH FROM ts)::bigint AS m, extract(DAY FROM ts)::bigint AS d, date_part('hour', ts)::bigint AS h,
extract(MINUTE FROM ts)::bigint AS mi, extract(QUARTER FROM ts)::bigint AS qu, extract(WEEK FROM ts)::bigint AS w, extract(DOY FROM ts)::bigint AS doy FROM events""", """SELECT event_id, CAST(extract(YEAR FROM ts) AS BIGINT) AS y, CAST(extract(MONTH FROM ts) AS BIGINT) AS m, CAST(extract(DAY FROM ts) AS BIGINT) AS d, CAST(extract(HOUR FROM ts) AS BIGINT) AS h,
CAST(extract(MINUTE FROM ts) AS BIGINT) AS mi, CAST(extract(QUARTER FROM ts) AS BIGINT) AS qu, CAST(extract(WEEK FROM ts) AS BIGINT) AS w, CAST(extract(DOY FROM ts) AS BIGINT) AS doy FROM events""")
q("dte_second", "SELECT event_id, extract(SECOND FROM ts)::bigint AS s FROM events", "SELECT event_id, CAST(second(ts) AS BIGINT) AS s FROM events")
q("dte_dow", "SELECT event_id, extract(DOW FROM ts)::bigint AS dow FROM events", "SELECT event_id, CAST(extract(DOW FROM ts) AS BIGINT) AS dow FROM events")
q("dte_epoch", "SELECT event_id, extract(EPOCH FROM ts) AS e FROM events", "SELECT event_id, CAST(floor(extract(EPOCH FROM ts)) AS BIGINT) AS e FROM events")
q("dte_trunc", "SELECT event_id, date_trunc('month', ts) AS m, date_trunc('hour', ts) AS h FROM events", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h FROM events")
q("dte_to_char", "SELECT event_id, to_char(ts, 'YYYY-MM-DD HH24:MI') AS s FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS s FROM events")
q("dte_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '3 days' AS later, o_orderdate - INTERVAL '1 month' AS earlier FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL '3' DAY AS later, o_orderdate - INTERVAL '1' MONTH AS earlier FROM orders")
q("dte_month_clamp", "SELECT ('2024-01-31 00:00:00'::timestamp + INTERVAL '1 month')::text AS s", "SELECT CAST(TIMESTAMP '2024-01-31 00:00:00' + INTERVAL '1' MONTH AS VARCHAR) AS s")
q("dte_now_is_now", "SELECT now()::date = CURRENT_DATE AS same, CURRENT_TIMESTAMP >= now() AS later, CURRENT_TIME ~ '^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]' AS clock", "SELECT TRUE AS same, TRUE AS later, TRUE AS clock")
q("dte_age_months", "SELECT o_orderkey, age('2024-01-01'::timestamp, o_orderdate) AS a FROM orders", """WITH a AS (SELECT o_orderkey, TIMESTAMP '2024-01-01' AS h, o_orderdate AS l FROM orders), d AS (SELECT o_orderkey, (year(h) - year(l)) * 12 + month(h) - month(l) - CAST(day(h) < day(l) AS INTEGER) AS m,
day(h) - day(l) + CASE WHEN day(h) < day(l) THEN day(date_trunc('month', h) - INTERVAL 1 DAY) ELSE 0 END AS d FROM a)
SELECT o_orderkey, concat_ws(' ', CASE m // 12 WHEN 0 THEN NULL WHEN 1 THEN '1 year' ELSE m // 12 || ' years' END, CASE m % 12 WHEN 0 THEN NULL WHEN 1 THEN '1 month' ELSE m % 12 || ' months' END, CASE d WHEN 0 THEN NULL WHEN 1 THEN '1 day' ELSE d || ' days' END) AS a FROM d""")
