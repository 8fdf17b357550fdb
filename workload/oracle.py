"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations


def r6(x: str) -> str:
    return f"round(({x}) + CAST(1e-9 AS DOUBLE), 6)"


# One CTE per name; with_ctes pulls in what a query needs.
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ev": ("""SELECT 'm' || CAST(user_id % 2 AS VARCHAR) AS machine, lower(event_type) AS sensor, ts, value,
              event_id AS ingest_seq FROM events""", ()),
    "dict": ("""SELECT * FROM (VALUES
        ('click', CAST(NULL AS DOUBLE), CAST(120 AS DOUBLE), 'max', 'M-1'),
        ('purchase', 5, NULL, 'min', 'M-1'), ('view', 1, 150, 'avg', 'M-1'),
        ('signup', NULL, NULL, 'min', 'M-2'), ('error', NULL, NULL, 'avg', 'M-2'))
        AS t(sensor, low_limit, high_limit, aggregation_rule, machine_group)""", ()),
    "judged": ("""SELECT ev.*, coalesce(value < low_limit, false) OR coalesce(value > high_limit, false) AS bad
                  FROM ev LEFT JOIN dict USING (sensor)""", ("ev", "dict")),
    "r1": ("""SELECT machine, sensor, date_trunc('hour', ts) AS bucket_start, count(value) AS n, sum(value) AS sum_v,
              count(value) FILTER (NOT bad) AS n_valid, count(*) FILTER (bad) AS n_invalid,
              min(value) AS min_v, max(value) AS max_v FROM judged GROUP BY ALL""", ("judged",)),
    "tick": ("""SELECT machine, ts, row_number() OVER (PARTITION BY machine ORDER BY ts) - 1 AS idx
                FROM (SELECT DISTINCT machine, bucket_start AS ts FROM r1)""", ("r1",)),
    "step": ("""SELECT machine, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY machine ORDER BY ts)) AS step_s
                FROM tick""", ("tick",)),
    "freq": ("""SELECT machine, CAST(step_s AS BIGINT) AS freq_s FROM (
                SELECT machine, step_s, row_number() OVER (PARTITION BY machine ORDER BY count(*) DESC, step_s) AS k
                FROM step WHERE step_s IS NOT NULL GROUP BY machine, step_s) WHERE k = 1""", ("step",)),
    "grid": (f"""SELECT t.machine, s.sensor, t.ts, t.idx, coalesce(r1.n, 0) AS n, r1.sum_v,
                coalesce(n_valid, 0) AS n_valid, coalesce(n_invalid, 0) AS n_invalid,
                {r6('r1.sum_v / nullif(r1.n, 0)')} AS mean
                FROM tick t JOIN (SELECT DISTINCT machine, sensor FROM r1) s ON t.machine = s.machine
                LEFT JOIN r1 ON r1.machine = t.machine AND r1.sensor = s.sensor AND r1.bucket_start = t.ts""",
             ("r1", "tick")),
    "cal": ("""SELECT m.machine, s.sensor, m.ts, CAST(epoch(m.ts - m.lo) / 3600 AS BIGINT) AS idx,
               coalesce(r1.n, 0) AS n, coalesce(n_invalid, 0) AS n_invalid,
               CAST(coalesce(r1.n, 0) AS DOUBLE) AS mean FROM (
               SELECT machine, min(bucket_start) AS lo,
                 unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 1 HOUR)) AS ts
               FROM r1 GROUP BY machine) m
               JOIN (SELECT DISTINCT machine, sensor FROM r1) s ON m.machine = s.machine
               LEFT JOIN r1 ON r1.machine = m.machine AND r1.sensor = s.sensor AND r1.bucket_start = m.ts""", ("r1",)),
    "means": (f"""SELECT machine, sensor, bucket_start AS ts, {r6('sum_v / nullif(n, 0)')} AS mean, n_invalid AS alarms
                 FROM r1""", ("r1",)),
    "li": ("""SELECT l_linestatus AS machine, lower(l_returnflag) AS sensor, l_shipdate AS ts, l_extendedprice AS value
              FROM lineitem""", ()),
    "day": ("""SELECT machine, sensor, date_trunc('day', ts) AS bucket_start, count(value) AS n, sum(value) AS sum_v
               FROM li GROUP BY ALL""", ("li",)),
    "dgrid": (f"""SELECT t.machine, s.sensor, t.ts, row_number() OVER (PARTITION BY t.machine, s.sensor ORDER BY t.ts) - 1
                 AS idx, coalesce(n, 0) AS n, {r6('sum_v / nullif(n, 0)')} AS mean
                 FROM (SELECT DISTINCT machine, bucket_start AS ts FROM day) t
                 JOIN (SELECT DISTINCT machine, sensor FROM day) s ON t.machine = s.machine
                 LEFT JOIN day ON day.machine = t.machine AND day.sensor = s.sensor AND day.bucket_start = t.ts""",
              ("day",)),
    "parts": ("""SELECT lower(tag) AS tag, tag_description, machine_group, low_threshold, high_threshold, threshold_type,
                 'avg' AS aggregation_rule, engineering_units, category FROM (
                 SELECT 'P' || p_partkey AS tag, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' ' ELSE p_name END
                   AS tag_description, p_brand AS machine_group,
                 CASE WHEN p_partkey % 13 = 0 THEN '1,799,' || p_partkey
                      WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS VARCHAR) END AS low_threshold,
                 CASE WHEN p_partkey % 17 = 0 THEN CAST(p_size - 5 AS VARCHAR)
                      WHEN p_partkey % 19 <> 0 THEN CAST(p_size + 20 AS VARCHAR) END AS high_threshold,
                 CASE p_partkey % 4 WHEN 0 THEN 'Down' WHEN 1 THEN 'Up' WHEN 2 THEN 'Up/Down' END AS threshold_type,
                 CASE p_partkey % 5 WHEN 0 THEN 'Kg/cm2' WHEN 1 THEN 'Kgf/cm2' WHEN 2 THEN 'mm' ELSE 'kg/cm2' END
                   AS engineering_units, p_type AS category FROM part)""", ()),
    "plim": ("""SELECT tag AS sensor, tag_description, threshold_type,
                CASE WHEN threshold_type IN ('Down', 'Up/Down') THEN TRY_CAST(low_threshold AS DOUBLE) END AS low_limit,
                CASE WHEN threshold_type IN ('Up', 'Up/Down') THEN TRY_CAST(high_threshold AS DOUBLE) END AS high_limit
                FROM parts""", ("parts",)),
    "pr": ("""SELECT l_linestatus AS machine, 'p' || (l_partkey + l_suppkey) AS sensor, l_shipdate AS ts,
              l_quantity AS value FROM lineitem""", ()),
    "quart": ("""SELECT machine, sensor, quantile_cont(mean, 0.25) AS q1, quantile_cont(mean, 0.5) AS q2,
                 quantile_cont(mean, 0.75) AS q3, count(mean) AS n, min(mean) AS x0, max(mean) AS x1,
                 avg(mean) AS m, stddev_samp(mean) AS s FROM grid GROUP BY ALL""", ("grid",)),
    "fence": ("""SELECT g.machine, g.sensor, g.ts, g.mean, q.* EXCLUDE (machine, sensor),
                 q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi
                 FROM grid g JOIN quart q ON g.machine = q.machine AND g.sensor = q.sensor""", ("grid", "quart")),
    "bad": ("""SELECT machine, sensor, ts FROM grid JOIN freq USING (machine) WHERE n < freq_s // 1800""",
            ("grid", "freq")),
    "isle": ("""SELECT machine, sensor, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS n_buckets FROM (
                SELECT *, sum(opens) OVER (PARTITION BY machine, sensor ORDER BY ts) AS island FROM (
                SELECT b.*, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY machine, sensor ORDER BY ts))
                <= freq_s THEN 0 ELSE 1 END AS opens FROM bad b JOIN freq USING (machine)))
                GROUP BY machine, sensor, island""", ("bad", "freq")),
    "a8": ("""SELECT machine, sensor, expected, actual, expected - actual AS missing,
              (expected - actual) / CAST(expected AS DOUBLE) * 100 AS missing_pct FROM (
              SELECT machine, sensor, CAST(sum(n) AS BIGINT) AS actual FROM r1 GROUP BY ALL) JOIN (
              SELECT machine, CAST((epoch(max(bucket_start)) - epoch(min(bucket_start))) // 1800 AS BIGINT) AS expected
              FROM r1 GROUP BY machine) USING (machine)""", ("r1",)),
    "miss": ("""SELECT machine, sensor, avg(CASE WHEN mean IS NULL THEN 1.0::DOUBLE ELSE 0 END) * 100 AS missing_pct
                FROM grid GROUP BY ALL""", ("grid",)),
    "pair": ("""SELECT machine, sensor_a, sensor_b, n_pairs,
                CASE WHEN n_pairs > 1 AND vx > 0 AND vy > 0 THEN c / sqrt(vx * vy) END AS r FROM (
                SELECT a.machine, a.sensor AS sensor_a, b.sensor AS sensor_b, count(*) AS n_pairs,
                  var_pop(a.mean) AS vx, var_pop(b.mean) AS vy, covar_pop(a.mean, b.mean) AS c
                FROM grid a JOIN grid b ON a.machine = b.machine AND a.ts = b.ts AND a.sensor < b.sensor
                WHERE a.mean IS NOT NULL AND b.mean IS NOT NULL GROUP BY ALL)""", ("grid",)),
    "wm": ("""SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS wm FROM events""", ()),
    "closed": ("""SELECT r1.* FROM r1, wm WHERE bucket_start + INTERVAL 1 HOUR <= wm""", ("r1", "wm")),
    "dupsize": ("""SELECT machine, count(*) AS c FROM (
                   SELECT machine, ts, list((sensor, mean) ORDER BY sensor) AS record FROM cal GROUP BY machine, ts)
                   GROUP BY machine, record""", ("cal",)),
}


#: Additive decomposition with a period of 24 over the calendar grid, as CTEs t, p and c.
DECOMPOSED = """t AS (SELECT machine, sensor, ts, idx % 24 AS phase, mean AS observed,
    CASE WHEN count(*) OVER w = 25 THEN (sum(mean) OVER w - (lag(mean, 12) OVER o + lead(mean, 12) OVER o) / 2)
    / 24 END AS trend FROM cal WINDOW o AS (PARTITION BY machine, sensor ORDER BY idx),
    w AS (PARTITION BY machine, sensor ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
    p AS (SELECT machine, sensor, phase, avg(observed - trend) AS d FROM t GROUP BY ALL),
    c AS (SELECT machine, sensor, phase, d - avg(d) OVER (PARTITION BY machine, sensor) AS seasonal FROM p)"""


def with_ctes(body: str, *names: str) -> str:
    """*body* under WITH, preceded by the named CTEs and everything they use."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][1]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + body


DUP_COLUMNS = """CAST(sum(c) AS BIGINT) AS total_rows,
  CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS dup_rows,
  coalesce(sum(c) FILTER (c > 1), 0) / CAST(2 AS DOUBLE) AS dup_half,
  CAST(coalesce(sum(c - 1) FILTER (c > 1), 0) AS BIGINT) AS dup_extra, """
DUP_PCT = r6("coalesce(sum(c) FILTER (c > 1), 0) / CAST(2 AS DOUBLE) / sum(c) * 100") + " AS dup_pct"

ROLLING = """CASE WHEN count({v}) OVER w = {k} THEN {f}({v}) OVER w END"""
ROLL_WINDOW = "WINDOW w AS (PARTITION BY machine, sensor ORDER BY idx ROWS BETWEEN {b} PRECEDING AND CURRENT ROW)"


def _rolled(kind: str, source: str, rows: int, extra: str = "") -> str:
    name = "rolling_mean" if kind == "avg" else "rolling_std"
    value = r6(ROLLING.format(v="mean", k=rows, f=kind))
    return (f"SELECT machine, sensor, ts, mean AS value, {value} AS {name}{extra} FROM {source} "
            + ROLL_WINDOW.format(b=rows - 1))


# numpy's automatic bins: narrower of Sturges and Freedman-Diaconis
LAYOUT = """SELECT machine, sensor, n, x0 AS low, (x1 - x0) / nb AS w, nb FROM (
  SELECT *, CAST(ceil((x1 - x0) / CASE WHEN q3 > q1
    THEN least((q3 - q1) * 2 / pow(CAST(n AS DOUBLE), CAST(1 AS DOUBLE) / 3), (x1 - x0) / (log2(n) + 1))
    ELSE (x1 - x0) / (log2(n) + 1) END) AS BIGINT) AS nb FROM quart)"""

# The wide table: every sensor at every tick of a machine, zero counts where nothing was read.
WIDE = f"""SELECT t.machine, s.sensor, t.ts AS bucket_start, coalesce(n, 0) AS n, {r6('sum_v')} AS sum_v,
  coalesce(n_valid, 0) AS n_valid, coalesce(n_invalid, 0) AS n_invalid
  FROM tick t CROSS JOIN (SELECT DISTINCT sensor FROM r1) s
  LEFT JOIN r1 ON r1.machine = t.machine AND r1.sensor = s.sensor AND r1.bucket_start = t.ts"""

SQL: dict[str, str] = {
    "hourly_rollup": with_ctes(
        f"SELECT machine, sensor, bucket_start, n, {r6('sum_v')} AS sum_v, n_valid, n_invalid FROM r1", "r1"),
    "daily_rollup_from_hourly": with_ctes(
        f"""SELECT machine, sensor, date_trunc('day', ts) AS bucket_start, count(value) AS n, {r6('sum(value)')} AS sum_v,
            count(value) FILTER (NOT bad) AS n_valid, count(*) FILTER (bad) AS n_invalid, min(value) AS min_v,
            max(value) AS max_v FROM judged GROUP BY ALL""", "judged"),
    "rollup_by_rule": with_ctes(
        f"""SELECT machine, sensor, bucket_start, aggregation_rule, {r6('''CASE aggregation_rule WHEN 'min' THEN min_v
            WHEN 'max' THEN max_v ELSE sum_v / n END''')} AS agg_value FROM r1 LEFT JOIN dict USING (sensor)""", "r1"),
    "annotate_mean": with_ctes("SELECT machine, sensor, ts, mean, n_invalid AS alarms FROM grid", "grid"),
    "wide_round_trip": with_ctes(
        WIDE, "tick"),
    "machine_table_from_files": with_ctes(WIDE, "tick"),
    "machine_table_from_catalogue": with_ctes(
        """SELECT t.machine, s.sensor, count(*) AS cells, CAST(coalesce(sum(n), 0) AS BIGINT) AS points
            FROM tick t JOIN (SELECT DISTINCT machine, sensor FROM r1) s ON s.machine = t.machine
            LEFT JOIN r1 ON r1.machine = t.machine AND r1.sensor = s.sensor AND r1.bucket_start = t.ts
            GROUP BY t.machine, s.sensor""", "tick"),
    "missing_intervals_from_wide": with_ctes("SELECT * FROM isle", "isle"),
    "dictionary_from_csv": with_ctes("SELECT * FROM parts", "parts"),
    "wide_export": with_ctes(
        "SELECT machine, ts, " + ", ".join(
            f"max(mean) FILTER (sensor = '{s}') AS {s}, max(n_invalid) FILTER (sensor = '{s}') AS {s}_alarms"
            for s in ("click", "error", "purchase", "signup", "view")) + " FROM grid GROUP BY machine, ts", "grid"),
    "wide_export_lines": with_ctes("SELECT machine, sensor, ts, mean, n_invalid AS alarms FROM grid", "grid"),
    "combined_means_and_alarms": with_ctes(
        f""", daily AS (SELECT machine, sensor, date_trunc('day', bucket_start) AS ts, CAST(sum(n_invalid) AS BIGINT) AS alarms
              FROM r1 GROUP BY ALL)
            SELECT coalesce(r1.machine, d.machine) AS machine, coalesce(r1.sensor, d.sensor) AS sensor,
              coalesce(bucket_start, d.ts) AS ts, {r6('sum_v / nullif(n, 0)')} AS mean, alarms
            FROM r1 FULL JOIN daily d ON r1.machine = d.machine AND r1.sensor = d.sensor AND bucket_start = d.ts""", "r1"),
    "selected_sensors": with_ctes(
        "SELECT machine, sensor, count(value) AS points FROM ev WHERE sensor IN ('click', 'error') GROUP BY ALL", "ev"),
    "tags_with_data": with_ctes("SELECT * FROM parts WHERE tag IN (SELECT sensor FROM pr)", "parts", "pr"),
    "tags_of_machine": with_ctes("SELECT * FROM parts WHERE machine_group = 'Brand#2'", "parts"),
    "tags_of_machine_by_pattern": with_ctes(
        "SELECT * FROM parts WHERE contains(lower(machine_group), 'rand#2')", "parts"),
    "machine_groups": with_ctes("SELECT DISTINCT machine_group FROM parts", "parts"),
    "sensors_per_group": with_ctes("SELECT machine_group, count(*) AS sensors FROM parts GROUP BY 1", "parts"),
    "tag_limits": with_ctes("SELECT sensor, threshold_type, low_limit, high_limit FROM plim", "plim"),
    "sensor_labels": with_ctes(
        """SELECT s.sensor, coalesce(tag_description || ' (' || s.sensor || ')', s.sensor) AS label,
           substr(s.sensor, 2) AS digits FROM (SELECT DISTINCT sensor FROM pr) s LEFT JOIN plim USING (sensor)""",
        "pr", "plim"),
    "metadata_lint": with_ctes(
        """, twice AS (SELECT * FROM parts UNION ALL SELECT * REPLACE (CASE WHEN tag LIKE '%3' THEN '7' ELSE high_threshold END AS high_threshold)
          FROM parts WHERE category = 'ECONOMY'),
        spelled AS (SELECT engineering_units AS unit, CASE lower(engineering_units) WHEN 'kgf/cm2' THEN 'kg/cm2'
          ELSE lower(engineering_units) END AS folded, count(*) AS uses FROM twice GROUP BY ALL),
        odd AS (SELECT unit FROM (SELECT unit, row_number() OVER (PARTITION BY folded ORDER BY uses DESC, unit) AS k
          FROM spelled) WHERE k > 1)
        SELECT DISTINCT tag AS sensor, 'threshold_malformed' AS issue FROM twice WHERE low_threshold LIKE '%,%'
        UNION ALL SELECT DISTINCT tag, 'low_threshold_missing' FROM twice
          WHERE threshold_type IN ('Down', 'Up/Down') AND low_threshold IS NULL
        UNION ALL SELECT DISTINCT tag, 'high_threshold_missing' FROM twice
          WHERE threshold_type IN ('Up', 'Up/Down') AND high_threshold IS NULL
        UNION ALL SELECT DISTINCT tag, 'low_above_high' FROM twice
          WHERE TRY_CAST(low_threshold AS DOUBLE) > TRY_CAST(high_threshold AS DOUBLE)
        UNION ALL SELECT DISTINCT tag, 'not_assessed' FROM twice WHERE threshold_type IS NULL
        UNION ALL SELECT DISTINCT tag, 'untrimmed_text' FROM twice WHERE tag_description LIKE '% '
        UNION ALL SELECT DISTINCT tag, 'unit_spelling' FROM twice WHERE engineering_units IN (SELECT unit FROM odd)
        UNION ALL SELECT tag, 'duplicate_tag' FROM twice GROUP BY tag HAVING count(*) > 1
        UNION ALL SELECT tag, 'conflicting_limits' FROM twice GROUP BY tag HAVING count(DISTINCT
          coalesce(CASE WHEN threshold_type IN ('Down', 'Up/Down') THEN CAST(TRY_CAST(low_threshold AS DOUBLE) AS VARCHAR) END, '-') || '/' ||
          coalesce(CASE WHEN threshold_type IN ('Up', 'Up/Down') THEN CAST(TRY_CAST(high_threshold AS DOUBLE) AS VARCHAR) END, '-')) > 1""", "parts"),
    "unmatched_sensors": with_ctes(
        """SELECT DISTINCT sensor, 'no_metadata' AS issue FROM pr WHERE sensor NOT IN (SELECT tag FROM parts)
           UNION ALL SELECT tag, 'no_data' FROM parts WHERE tag NOT IN (SELECT sensor FROM pr)""", "pr", "parts"),
    "infer_freq": with_ctes(
        "SELECT machine, freq_s, freq_s // 1800 AS agg_freq, 'ok' AS status FROM freq", "freq"),
    "time_steps": with_ctes(
        "SELECT machine, ts, CAST(step_s AS BIGINT) AS step_s FROM step WHERE step_s IS NOT NULL", "step"),
    "general_info": with_ctes(
        f"""SELECT machine, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS total_points,
            count(*) - count(mean) AS missing, count(DISTINCT sensor) AS sensors,
            {r6('(count(*) - count(mean)) / CAST(count(*) AS DOUBLE) * 100')} AS missing_pct
            FROM grid GROUP BY machine""", "grid"),
    "points_per_sensor": with_ctes("SELECT machine, sensor, count(mean) AS points FROM grid GROUP BY ALL", "grid"),
    "describe_stats": with_ctes(
        f"""SELECT machine, sensor, count(mean) AS n, {r6('avg(mean)')} AS mean, {r6('stddev_samp(mean)')} AS std,
            {r6('min(mean)')} AS min, {r6('quantile_cont(mean, 0.25)')} AS p25, {r6('quantile_cont(mean, 0.5)')} AS p50,
            {r6('quantile_cont(mean, 0.75)')} AS p75, {r6('max(mean)')} AS max FROM means GROUP BY ALL""", "means"),
    "describe_raw_readings": with_ctes(
        f"""SELECT machine, sensor, count(value) AS n, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std,
            {r6('min(value)')} AS min, {r6('quantile_cont(value, 0.25)')} AS p25,
            {r6('quantile_cont(value, 0.5)')} AS p50, {r6('quantile_cont(value, 0.75)')} AS p75,
            {r6('max(value)')} AS max FROM li GROUP BY ALL""", "li"),
    "missing_pct": with_ctes(
        f"""SELECT machine, sensor, {r6('missing_pct')} AS missing_pct,
            CASE WHEN missing_pct > 0 THEN 'missing_values' ELSE 'ok' END AS status FROM miss""", "miss"),
    "completeness": with_ctes(
        f"""SELECT machine, sensor, {r6('missing_pct')} AS missing_pct, {r6('100 - missing_pct')} AS complete_pct,
            {r6('100 - avg(missing_pct) OVER (PARTITION BY machine)')} AS overall_pct,
            missing_pct > 100 - CAST(77.7 AS DOUBLE) AS below_threshold FROM miss""", "miss"),
    "duplicates": with_ctes(f"SELECT machine, {DUP_COLUMNS} {DUP_PCT} FROM dupsize GROUP BY machine", "dupsize"),
    "duplicate_measurements":
        f"""SELECT {DUP_COLUMNS} {DUP_PCT} FROM (
            SELECT count(*) AS c FROM lineitem GROUP BY l_quantity, l_discount, l_tax)""",
    "duplicate_texts":
        f"""SELECT lang, {DUP_COLUMNS} {DUP_PCT} FROM (
            SELECT lang, count(*) AS c FROM documents GROUP BY lang, text) GROUP BY lang""",
    "timestamp_order":
        """SELECT machine, count(*) AS total_rows, count(*) FILTER (ts < prev) AS n_backward,
           count(*) FILTER (ts = prev) AS n_equal, count(*) FILTER (ts < prev) = 0 AS monotonic,
           CASE WHEN count(*) FILTER (ts < prev) = 0 THEN 'ok' ELSE 'out_of_order' END AS status FROM (
           SELECT o_orderstatus AS machine, o_orderdate AS ts,
             lag(o_orderdate) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS prev FROM orders)
           GROUP BY machine""",
    "timestamp_order_events": with_ctes(
        """SELECT machine, count(*) AS total_rows, count(*) FILTER (ts < prev) AS n_backward,
           count(*) FILTER (ts = prev) AS n_equal, count(*) FILTER (ts < prev) = 0 AS monotonic,
           CASE WHEN count(*) FILTER (ts < prev) = 0 THEN 'ok' ELSE 'out_of_order' END AS status FROM (
           SELECT machine, ts, lag(ts) OVER (PARTITION BY machine ORDER BY ingest_seq) AS prev FROM ev)
           GROUP BY machine""", "ev"),
    "timestamp_order_unnumbered":
        """SELECT machine, count(*) AS total_rows, count(*) FILTER (ts < prev) AS n_backward,
           count(*) FILTER (ts = prev) AS n_equal, count(*) FILTER (ts < prev) = 0 AS monotonic,
           CASE WHEN count(*) FILTER (ts < prev) = 0 THEN 'ok' ELSE 'out_of_order' END AS status FROM (
           SELECT l_linestatus AS machine, l_shipdate AS ts, lag(l_shipdate) OVER (PARTITION BY l_linestatus ORDER BY place) AS prev
           FROM (SELECT *, row_number() OVER () AS place FROM lineitem))
           GROUP BY machine""",
    "timestamp_order_repeated_numbers":
        """SELECT machine, count(*) AS total_rows, count(*) FILTER (ts < prev) AS n_backward,
           count(*) FILTER (ts = prev) AS n_equal, count(*) FILTER (ts < prev) = 0 AS monotonic,
           CASE WHEN count(*) FILTER (ts < prev) = 0 THEN 'ok' ELSE 'out_of_order' END AS status FROM (
           SELECT l_linestatus AS machine, l_shipdate AS ts,
             lag(l_shipdate) OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_shipdate) AS prev FROM lineitem)
           GROUP BY machine""",
    "missing_readings": with_ctes(
        f"""SELECT machine, sensor, expected, actual, missing, {r6('missing_pct')} AS missing_pct,
            CASE WHEN missing > 0 THEN 'missing_readings' ELSE 'ok' END AS status FROM a8""", "a8"),
    "missing_readings_by_buckets": with_ctes(
        f"""SELECT machine, sensor, expected, actual, expected - actual AS missing,
            {r6('(expected - actual) / CAST(expected AS DOUBLE) * 100')} AS missing_pct,
            CASE WHEN expected > actual THEN 'missing_readings' ELSE 'ok' END AS status FROM (
            SELECT machine, sensor, CAST(sum(n) AS BIGINT) AS actual FROM day GROUP BY ALL) JOIN (
            SELECT machine, 2 * (date_diff('day', min(bucket_start), max(bucket_start)) + 1) AS expected
            FROM day GROUP BY machine) USING (machine)""", "day"),
    "missing_intervals": with_ctes("SELECT * FROM isle", "isle"),
    "missing_intervals_calendar": with_ctes(
        """, cells AS (SELECT c.machine, s.sensor, c.ts, coalesce(day.n, 0) AS n FROM (
             SELECT machine, unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 1 DAY)) AS ts
             FROM day GROUP BY machine) c JOIN (SELECT DISTINCT machine, sensor FROM day) s ON c.machine = s.machine
             LEFT JOIN day ON day.machine = c.machine AND day.sensor = s.sensor AND day.bucket_start = c.ts)
           SELECT machine, sensor, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS n_buckets FROM (
             SELECT *, date_diff('day', DATE '1990-01-01', ts)
               - row_number() OVER (PARTITION BY machine, sensor ORDER BY ts) AS island FROM cells WHERE n < 2)
           GROUP BY machine, sensor, island""", "day"),
    "missing_report": with_ctes(
        f"""SELECT a8.machine, a8.sensor, expected, missing, {r6('missing_pct')} AS missing_pct,
            count(n_buckets) AS periods, CAST(coalesce(sum(n_buckets), 0) AS BIGINT) AS bad_buckets,
            coalesce(max(n_buckets), 0) AS longest_buckets
            FROM a8 LEFT JOIN isle ON a8.machine = isle.machine AND a8.sensor = isle.sensor
            GROUP BY ALL""", "a8", "isle"),
    "missing_summary": with_ctes(
        f"SELECT machine, sensor, missing, {r6('missing_pct')} AS missing_pct FROM a8", "a8"),
    "gap_list": with_ctes(
        """SELECT s.machine, s.sensor, coalesce(string_agg(strftime(gap_start, '%Y-%m-%d %H:%M:%S') || '..' ||
             strftime(gap_end, '%Y-%m-%d %H:%M:%S'), ';' ORDER BY gap_start), '') AS gaps,
           CASE WHEN count(gap_start) = 0 THEN 'no_missing_periods' ELSE 'missing_periods' END AS status
           FROM (SELECT DISTINCT machine, sensor FROM r1) s
           LEFT JOIN isle ON isle.machine = s.machine AND isle.sensor = s.sensor
           GROUP BY s.machine, s.sensor""", "r1", "isle"),
    "alarm_stats": with_ctes(
        f""", per AS (SELECT machine, sensor, count(*) AS rws, CAST(sum(n_invalid) AS BIGINT) AS alarms,
              avg(n_invalid) AS av FROM grid GROUP BY ALL)
            SELECT machine, max(rws) * max(freq_s // 1800) AS total_readings,
              CAST(sum(rws) AS BIGINT) * max(freq_s // 1800) AS total_readings_all_sensors,
              count(*) FILTER (alarms > 0) AS sensors_with_alarms,
              CAST(coalesce(sum(alarms), 0) AS BIGINT) AS total_alarms, {r6('avg(av) FILTER (alarms > 0)')} AS avg_alarms,
              arg_max(sensor, (alarms, -rnk)) FILTER (alarms > 0) AS max_sensor,
              max(alarms) FILTER (alarms > 0) AS max_alarms,
              CASE WHEN sum(alarms) > 0 THEN 'alarms' ELSE 'no_alarms' END AS status
            FROM (SELECT *, row_number() OVER (ORDER BY sensor) AS rnk FROM per) JOIN freq USING (machine)
            GROUP BY machine""", "grid", "freq"),
    "alarm_by_sensor": with_ctes(
        """SELECT machine, sensor, CAST(sum(n_invalid) AS BIGINT) AS alarms FROM r1 GROUP BY ALL
           HAVING sum(n_invalid) > 0""", "r1"),
    "invalid_counts": with_ctes(
        f"""SELECT machine, sensor, bucket_start, n - n_valid AS n_invalid,
            {r6('(n - n_valid) / CAST(2 AS DOUBLE) * 100')} AS invalid_pct FROM r1""", "r1"),
    "invalid_buckets": with_ctes(
        "SELECT machine, sensor, ts, mean, alarms FROM means WHERE alarms >= 2", "means"),
    "means_at_bad_buckets": with_ctes("SELECT machine, sensor, ts, mean FROM means WHERE alarms >= 1", "means"),
    "invalid_report": with_ctes(
        """SELECT machine, sensor, CAST(sum(n_invalid) AS BIGINT) AS alarms,
           count(*) FILTER (n_invalid >= 1) AS alarm_buckets, max(n_invalid) AS worst_bucket
           FROM grid GROUP BY ALL HAVING max(n_invalid) > 0""", "grid"),
    "accuracy_of_means": with_ctes(
        f"""SELECT machine, sensor, n, issues, {r6('issues / CAST(n AS DOUBLE) * 100')} AS issue_pct,
            CASE WHEN issues > 0 THEN 'accuracy_issues' ELSE 'ok' END AS status FROM (
            SELECT machine, sensor, count(mean) AS n, count(*) FILTER (mean < low_limit OR mean > high_limit) AS issues
            FROM means JOIN dict USING (sensor) GROUP BY ALL)""", "means", "dict"),
    "accuracy_issues": with_ctes(
        f"""SELECT machine, sensor, n, issues, {r6('issues / CAST(n AS DOUBLE) * 100')} AS issue_pct,
            'accuracy_issues' AS status FROM (SELECT machine, sensor, count(value) AS n,
              count(*) FILTER (value < low_limit OR value > high_limit) AS issues
            FROM pr JOIN plim USING (sensor) GROUP BY ALL) WHERE issues > 0""", "pr", "plim"),
    "accuracy_measured": with_ctes(
        f"""SELECT machine, sensor, n, issues, {r6('issues / CAST(n AS DOUBLE) * 100')} AS issue_pct,
            'accuracy_issues' AS status FROM (SELECT machine, sensor, count(value) AS n,
              count(*) FILTER (value < low_limit OR value > high_limit) AS issues
            FROM pr JOIN plim USING (sensor) GROUP BY ALL) WHERE issues > 0""", "pr", "plim"),
    "hourly_rollup_measured": with_ctes(
        f"SELECT machine, sensor, bucket_start, n, {r6('sum_v')} AS sum_v, n_valid, n_invalid FROM r1", "r1"),
    "iqr_outliers": with_ctes(
        f"""SELECT machine, sensor, {r6('avg(CASE WHEN mean < lo OR mean > hi THEN 1.0::DOUBLE ELSE 0 END) * 100')}
            AS outlier_pct FROM fence GROUP BY ALL""", "fence"),
    "iqr_outliers_raw": with_ctes(
        f""", q AS (SELECT machine, sensor, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
              FROM li GROUP BY ALL)
            SELECT machine, sensor, {r6('''avg(CASE WHEN value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5
              THEN 1.0::DOUBLE ELSE 0 END) * 100''')} AS outlier_pct FROM li JOIN q USING (machine, sensor)
            GROUP BY ALL""", "li"),
    "zscore_outliers": with_ctes(
        """SELECT machine, sensor, count(*) FILTER (abs(mean - m) > s * 3) AS outliers FROM fence GROUP BY ALL""",
        "fence"),
    "anomalies": with_ctes(
        "SELECT machine, sensor, ts, mean AS value FROM fence WHERE abs(mean - m) > s * 2", "fence"),
    "missing_and_outliers": with_ctes(
        f"""SELECT machine, sensor, {r6('avg(CASE WHEN mean IS NULL THEN 1.0::DOUBLE ELSE 0 END) * 100')} AS missing_pct,
            {r6('avg(CASE WHEN mean < lo OR mean > hi THEN 1.0::DOUBLE ELSE 0 END) * 100')} AS outlier_pct
            FROM fence GROUP BY ALL""", "fence"),
    "histogram": with_ctes(
        f""", lay AS ({LAYOUT}),
        edges AS (SELECT *, unnest(generate_series(0, nb - 1)) AS bin FROM lay)
        SELECT e.machine, e.sensor, nb AS n_bins, bin, {r6('low + bin * w')} AS bin_low,
          {r6('low + (bin + 1) * w')} AS bin_high, count(*) AS count
        FROM edges e JOIN grid g ON g.machine = e.machine AND g.sensor = e.sensor
          AND (g.mean >= low + bin * w OR bin = 0) AND (g.mean < low + (bin + 1) * w OR bin = nb - 1)
        GROUP BY e.machine, e.sensor, nb, bin, low, w""", "quart"),
    "histogram_dense": with_ctes(
        f""", lay AS ({LAYOUT}),
        edges AS (SELECT *, unnest(generate_series(0, nb - 1)) AS bin FROM lay)
        SELECT e.machine, e.sensor, nb AS n_bins, bin, {r6('low + bin * w')} AS bin_low,
          {r6('low + (bin + 1) * w')} AS bin_high, count(g.ts) AS count
        FROM edges e LEFT JOIN grid g ON g.machine = e.machine AND g.sensor = e.sensor
          AND (g.mean >= low + bin * w OR bin = 0) AND (g.mean < low + (bin + 1) * w OR bin = nb - 1) AND g.mean IS NOT NULL
        GROUP BY e.machine, e.sensor, nb, bin, low, w""", "quart"),
    "kde": with_ctes(
        f""", st AS (SELECT machine, sensor, n, x0, x1, s * pow(CAST(n AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS bw,
              unnest(generate_series(0, 199)) AS point FROM quart),
            pt AS (SELECT *, x0 + point * ((x1 - x0) / 199) AS x FROM st)
            SELECT pt.machine, pt.sensor, CAST(point AS INTEGER) AS point, {r6('x')} AS x,
              {r6('sum(exp(-0.5 * pow((x - mean) / bw, 2))) / (pt.n * bw * sqrt(2 * pi()))')} AS density
            FROM pt JOIN grid g ON g.machine = pt.machine AND g.sensor = pt.sensor AND g.mean IS NOT NULL
            GROUP BY pt.machine, pt.sensor, point, pt.x, pt.n, bw""", "quart"),
    "kde_from_moments": with_ctes(
        f""", st AS (SELECT machine, sensor, n, x0, x1, s * pow(CAST(n AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS bw,
              unnest(generate_series(0, 199)) AS point FROM quart),
            pt AS (SELECT *, x0 + point * ((x1 - x0) / 199) AS x FROM st)
            SELECT pt.machine, pt.sensor, CAST(point AS INTEGER) AS point, {r6('x')} AS x,
              {r6('sum(exp(-0.5 * pow((x - mean) / bw, 2))) / (pt.n * bw * sqrt(2 * pi()))')} AS density
            FROM pt JOIN grid g ON g.machine = pt.machine AND g.sensor = pt.sensor AND g.mean IS NOT NULL
            GROUP BY pt.machine, pt.sensor, point, pt.x, pt.n, bw""", "quart"),
    "kde_of_raw_readings": with_ctes(
        f""", st AS (SELECT machine, sensor, count(value) AS n, min(value) AS x0, max(value) AS x1,
              stddev_samp(value) * pow(CAST(count(value) AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS bw,
              unnest(generate_series(0, 39)) AS point FROM ev GROUP BY machine, sensor),
            pt AS (SELECT *, x0 + point * ((x1 - x0) / 39) AS x FROM st)
            SELECT pt.machine, pt.sensor, CAST(point AS INTEGER) AS point, {r6('x')} AS x,
              {r6('sum(exp(-0.5 * pow((x - value) / bw, 2))) / (pt.n * bw * sqrt(2 * pi()))')} AS density
            FROM pt JOIN ev g ON g.machine = pt.machine AND g.sensor = pt.sensor AND g.value IS NOT NULL
            GROUP BY pt.machine, pt.sensor, point, pt.x, pt.n, bw""", "ev"),
    "box_stats": with_ctes(
        f"""SELECT machine, sensor, {r6('q1')} AS q1, {r6('q2')} AS median, {r6('q3')} AS q3,
            {r6('min(mean) FILTER (mean >= lo)')} AS low_whisker, {r6('max(mean) FILTER (mean <= hi)')} AS high_whisker,
            count(*) FILTER (mean < lo OR mean > hi) AS fliers FROM fence GROUP BY machine, sensor, q1, q2, q3""",
        "fence"),
    "box_fliers": with_ctes(
        "SELECT machine, sensor, ts, mean AS value FROM fence WHERE mean < lo OR mean > hi", "fence"),
    "correlation_blocks": with_ctes(
        f"SELECT machine, sensor_a, sensor_b, {r6('r')} AS r, n_pairs FROM pair", "pair"),
    "correlation_pivot": with_ctes(
        f"SELECT machine, sensor_a, sensor_b, {r6('r')} AS r, n_pairs FROM pair", "pair"),
    "correlation_cells": with_ctes(
        f"""SELECT a.machine, a.sensor AS sensor_a, b.sensor AS sensor_b,
            {r6('CASE WHEN a.sensor = b.sensor THEN 1.0::DOUBLE ELSE covar_pop(a.mean, b.mean) / sqrt(var_pop(a.mean) * var_pop(b.mean)) END')} AS r
            FROM dgrid a JOIN dgrid b ON a.machine = b.machine AND a.ts = b.ts
            WHERE a.mean IS NOT NULL AND b.mean IS NOT NULL GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"),
        "dgrid"),
    "strong_pairs": with_ctes(
        f"SELECT machine, sensor_a, sensor_b, {r6('r')} AS r, n_pairs FROM pair WHERE abs(r) > CAST(0.04 AS DOUBLE)",
        "pair"),
    "strong_pairs_of_gappy_series": with_ctes(
        f"SELECT machine, sensor_a, sensor_b, {r6('r')} AS r, n_pairs FROM pair WHERE abs(r) > CAST(0.04 AS DOUBLE)",
        "pair"),
    "strong_pairs_pruned": with_ctes(
        f"""SELECT machine, sensor_a, sensor_b, {r6('c / sqrt(vx * vy)')} AS r, n_pairs FROM (
            SELECT a.machine, a.sensor AS sensor_a, b.sensor AS sensor_b, count(*) AS n_pairs,
              var_pop(a.mean) AS vx, var_pop(b.mean) AS vy, covar_pop(a.mean, b.mean) AS c
            FROM cal a JOIN cal b ON a.machine = b.machine AND a.ts = b.ts AND a.sensor < b.sensor GROUP BY ALL)
            WHERE vx > 0 AND vy > 0 AND abs(c / sqrt(vx * vy)) > CAST(0.04 AS DOUBLE)""", "cal"),
    "rolling_mean": with_ctes(_rolled("avg", "cal", 24), "cal"),
    "rolling_mean_of_means": with_ctes(_rolled("avg", "dgrid", 7), "dgrid"),
    "rolling_std": with_ctes(_rolled("stddev_samp", "cal", 24), "cal"),
    "series_with_limits": with_ctes(
        _rolled("avg", "cal LEFT JOIN dict USING (sensor)", 24, ", low_limit, high_limit"), "cal", "dict"),
    "seasonal_decompose": with_ctes(
        f""", {DECOMPOSED}
            SELECT t.machine, t.sensor, ts, 'ok' AS status, observed, {r6('trend')} AS trend,
              {r6('seasonal')} AS seasonal, {r6('observed - trend - seasonal')} AS resid
            FROM t JOIN c ON c.machine = t.machine AND c.sensor = t.sensor AND c.phase = t.phase""", "cal"),
    "decomposition_status": with_ctes(
        """SELECT machine, sensor, CASE WHEN count(mean) < count(*) THEN 'has_nulls' WHEN count(*) < 48 THEN 'too_short'
           ELSE 'ok' END AS status FROM grid GROUP BY ALL""", "grid"),
    "exploration_summary": with_ctes(
        f"""SELECT machine, sensor, max(n) AS n, {r6('max(q2)')} AS p50, count(*) FILTER (abs(mean - m) > s * 3) AS outliers,
            count(*) FILTER (mean < lo OR mean > hi) AS fliers,
            {r6('max(mean) FILTER (mean <= hi)')} AS high_whisker,
            count(*) FILTER (abs(mean - m) > s * 2) AS anomalies FROM fence GROUP BY machine, sensor""", "fence"),
    "exploration_of_counts": with_ctes(
        f""", {DECOMPOSED}
            SELECT t.machine, t.sensor, count(*) AS cells, count(trend) AS with_trend, {r6('sum(trend)')} AS trend,
              {r6('sum(seasonal * seasonal)')} AS seasonal_energy, {r6('sum(pow(observed - trend - seasonal, 2))')} AS resid_energy
            FROM t JOIN c ON c.machine = t.machine AND c.sensor = t.sensor AND c.phase = t.phase GROUP BY t.machine, t.sensor""", "cal"),
    "exploration_parts": with_ctes(
        f""", lay AS ({LAYOUT}),
          st AS (SELECT machine, sensor, n, x0, x1, s * pow(CAST(n AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS bw,
            unnest(generate_series(0, 199)) AS point FROM quart),
          est AS (SELECT st.machine, st.sensor, point,
              sum(exp(-0.5 * pow((x0 + point * ((x1 - x0) / 199) - mean) / bw, 2))) / (st.n * bw * sqrt(2 * pi())) AS density
            FROM st JOIN grid g ON g.machine = st.machine AND g.sensor = st.sensor AND g.mean IS NOT NULL
            GROUP BY st.machine, st.sensor, point, st.n, bw),
          p(machine, sensor, part, n_rows, total) AS (
          SELECT machine, sensor, 'describe', 1, n FROM quart
          UNION ALL SELECT machine, sensor, 'zscore', 1, count(*) FILTER (abs(mean - m) > s * 3) FROM fence GROUP BY machine, sensor
          UNION ALL SELECT machine, sensor_a, 'correlation', count(*), sum(n_pairs) FROM pair GROUP BY machine, sensor_a
          UNION ALL SELECT machine, sensor, 'limits', count(*), sum(mean) FROM grid GROUP BY machine, sensor
          UNION ALL SELECT g.machine, g.sensor, 'histogram', count(DISTINCT greatest(0, least(nb - 1, floor((g.mean - low) / w)))), count(g.mean)
            FROM grid g JOIN lay USING (machine, sensor) WHERE g.mean IS NOT NULL GROUP BY g.machine, g.sensor
          UNION ALL SELECT machine, sensor, 'density', 200, sum(density) FROM est GROUP BY machine, sensor
          UNION ALL SELECT machine, sensor, 'box', 1, count(*) FILTER (mean < lo OR mean > hi) FROM fence GROUP BY machine, sensor
          UNION ALL SELECT machine, sensor, 'fliers', count(*), sum(mean) FROM fence WHERE mean < lo OR mean > hi GROUP BY machine, sensor
          UNION ALL SELECT machine, sensor, 'decomposition', count(*), NULL FROM grid GROUP BY machine, sensor
          UNION ALL SELECT machine, sensor, 'anomalies', count(*), sum(mean) FROM fence WHERE abs(mean - m) > s * 2 GROUP BY machine, sensor)
        SELECT machine, sensor, part, CAST(n_rows AS BIGINT) AS "rows", {r6('CAST(total AS DOUBLE)')} AS total FROM p""",
        "fence", "pair", "quart"),
    "load_report": with_ctes(
        f"""SELECT machine, machine_group, freq_s, freq_s // 1800 AS agg_freq, count(*) AS cells, count(mean) AS points,
            CAST(sum(n_invalid) AS BIGINT) AS alarms, {r6('avg(sum_v / nullif(n, 0))')} AS avg_mean
            FROM grid JOIN freq USING (machine) LEFT JOIN dict USING (sensor) GROUP BY ALL""", "grid", "freq", "dict"),
    "stream_rollup_equals_batch": with_ctes(
        f"SELECT machine, sensor, bucket_start, n, {r6('sum_v')} AS sum_v, n_valid, n_invalid FROM r1", "r1"),
    "stream_rollup_closed": with_ctes(
        f"SELECT machine, sensor, bucket_start, n, {r6('sum_v')} AS sum_v, n_valid, n_invalid FROM closed", "closed"),
    "stream_alarms": with_ctes(
        f"""SELECT machine, sensor, bucket_start AS ts, {r6('sum_v / n')} AS mean, n_invalid AS alarms
            FROM closed WHERE n_invalid >= 1""", "closed"),
    "stream_gaps": with_ctes(
        """, front AS (SELECT min(bucket_start) AS lo, max(bucket_start) AS hi FROM closed),
           cal AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS b, hi FROM front),
           short AS (SELECT s.machine, s.sensor, b, hi FROM (SELECT DISTINCT machine, sensor FROM ev) s CROSS JOIN cal
             LEFT JOIN closed c ON c.machine = s.machine AND c.sensor = s.sensor AND c.bucket_start = b WHERE coalesce(n, 0) < 2)
           SELECT machine, sensor, min(b) AS gap_start, max(b) AS gap_end, count(*) AS n_buckets
           FROM (SELECT *, epoch(b) // 3600 - row_number() OVER (PARTITION BY machine, sensor ORDER BY b) AS island FROM short)
           GROUP BY machine, sensor, island, hi HAVING max(b) < hi""", "closed", "ev"),
    "stream_open_gaps": with_ctes(
        """, front AS (SELECT (SELECT min(bucket_start) FROM closed) AS lo, date_trunc('hour', wm) - INTERVAL 1 HOUR AS hi FROM wm),
           known AS (SELECT DISTINCT machine, sensor FROM ev UNION SELECT 'm-dead', sensor FROM ev),
           owed AS (SELECT k.machine, k.sensor, coalesce(max(c.bucket_start) + INTERVAL 1 HOUR, any_value(lo)) AS gap_start, any_value(hi) AS hi
             FROM known k CROSS JOIN front LEFT JOIN closed c ON c.machine = k.machine AND c.sensor = k.sensor AND c.n >= 2 GROUP BY ALL)
           SELECT machine, sensor, gap_start FROM owed WHERE gap_start <= hi""", "closed", "ev", "wm"),
    "stream_short_buckets": with_ctes(
        """SELECT machine, sensor, min(bucket_start) AS gap_start, max(bucket_start) AS gap_end, count(*) AS n_buckets
           FROM (SELECT *, epoch(bucket_start) // 3600 - row_number() OVER (
             PARTITION BY machine, sensor ORDER BY bucket_start) AS island FROM closed WHERE n < 2), wm
           GROUP BY machine, sensor, island, wm HAVING max(bucket_start) + INTERVAL 2 HOUR <= wm""", "closed", "wm"),
    "stream_first_readings": with_ctes(
        "SELECT DISTINCT machine, sensor, ts, value, ingest_seq FROM ev", "ev"),
    "stream_silent_buckets": with_ctes(
        """SELECT t.machine, s.sensor, t.ts AS bucket_start FROM tick t
           JOIN (SELECT DISTINCT machine, sensor FROM ev) s ON s.machine = t.machine, wm
           WHERE t.ts + INTERVAL 1 HOUR <= wm AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.machine = t.machine
             AND r1.sensor = s.sensor AND r1.bucket_start = t.ts)""", "tick", "ev", "wm", "r1"),
}


def _tidy(source: str, keys: str, rows: list[tuple[str, str, str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {keys}, '{check}' AS \"check\", '{metric}' AS metric, {r6(f'CAST({value} AS DOUBLE)')} AS value, "
        f"{status} AS status FROM {source}" for check, metric, value, status in rows)


_STATS = """, st AS (SELECT q.*, q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi, rws, mp, low_limit, high_limit
  FROM quart q JOIN (SELECT machine, sensor, count(*) AS rws, avg(CASE WHEN mean IS NULL THEN 1.0::DOUBLE ELSE 0 END) * 100
    AS mp FROM grid GROUP BY ALL) USING (machine, sensor) LEFT JOIN dict USING (sensor)),
  mt AS (SELECT machine, min(ts) AS t0, max(ts) AS t1, count(*) AS cells, count(mean) AS pts,
    count(DISTINCT sensor) AS ns FROM grid GROUP BY machine),
  mo AS (SELECT mt.*, 100 - (SELECT avg(mp) FROM st WHERE st.machine = mt.machine) AS overall FROM mt),
  dev AS (SELECT f.machine, f.sensor, avg(CASE WHEN f.mean < lo OR f.mean > hi THEN 1.0::DOUBLE ELSE 0 END) * 100 AS op,
    count(*) FILTER (abs(f.mean - m) > 3 * s) AS z, count(*) FILTER (f.mean < low_limit OR f.mean > high_limit)
    / CAST(count(f.mean) AS DOUBLE) * 100 AS ip FROM fence f LEFT JOIN dict USING (sensor) GROUP BY f.machine, f.sensor),
  ds AS (SELECT machine, count(*) AS c FROM (SELECT machine, ts, list((sensor, mean) ORDER BY sensor) AS record
    FROM grid GROUP BY machine, ts) GROUP BY machine, record),
  du AS (SELECT machine, coalesce(sum(c) FILTER (c > 1), 0) AS dr, coalesce(sum(c - 1) FILTER (c > 1), 0) AS dx,
    sum(c) AS tr FROM ds GROUP BY machine),
  od AS (SELECT machine, count(*) FILTER (ts < prev) AS nb, count(*) FILTER (ts = prev) AS ne FROM (
    SELECT machine, ts, lag(ts) OVER (PARTITION BY machine ORDER BY ingest_seq) AS prev FROM ev) GROUP BY machine)
"""
_OK = "'ok'"
_PROFILE = [
    ("general", "points", "n", _OK), ("missing", "missing_pct", "mp", "CASE WHEN mp > 0 THEN 'missing_values' ELSE 'ok' END"),
    ("completeness", "complete_pct", "100 - mp", "CASE WHEN mp > 10 THEN 'below_threshold' ELSE 'ok' END"),
]
_MACHINE = [
    ("general", "start_epoch_s", "epoch(t0)", _OK), ("general", "end_epoch_s", "epoch(t1)", _OK),
    ("general", "sensors", "ns", _OK), ("general", "total_points", "cells", _OK),
    ("general", "total_missing", "cells - pts", _OK),
    ("general", "total_missing_pct", "(cells - pts) / CAST(cells AS DOUBLE) * 100", _OK),
    ("completeness", "overall_complete_pct", "overall", "CASE WHEN overall < 90 THEN 'below_threshold' ELSE 'ok' END"),
]
_MS, _M = "machine, sensor", "machine, CAST(NULL AS VARCHAR) AS sensor"
_DUP = "CASE WHEN dr > 0 THEN 'duplicates' ELSE 'ok' END"
_ORDER = "CASE WHEN nb = 0 THEN 'ok' ELSE 'out_of_order' END"
_REPORT = [
    _tidy("st", _MS, _PROFILE + [
        ("describe", "mean", "m", _OK), ("describe", "std", "s", _OK), ("describe", "min", "x0", _OK),
        ("describe", "p25", "q1", _OK), ("describe", "p50", "q2", _OK), ("describe", "p75", "q3", _OK),
        ("describe", "max", "x1", _OK)]),
    _tidy("mo", _M, _MACHINE),
    _tidy("dev", _MS, [
        ("outliers", "outlier_pct", "op", "CASE WHEN op > 0 THEN 'outliers' ELSE 'ok' END"),
        ("outliers", "zscore_outliers", "z", "CASE WHEN z > 0 THEN 'outliers' ELSE 'ok' END"),
        ("accuracy", "issue_pct", "ip", "CASE WHEN ip > 0 THEN 'accuracy_issues' ELSE 'ok' END")]),
    _tidy("du", _M, [("duplicates", "dup_rows", "dr", _DUP), ("duplicates", "dup_half", "dr / 2.0::DOUBLE", _DUP),
                     ("duplicates", "dup_extra", "dx", _DUP),
                     ("duplicates", "dup_pct", "dr / 2.0::DOUBLE / tr * 100", _DUP)]),
    _tidy("od", _M, [("timestamp_order", "n_backward", "nb", _ORDER), ("timestamp_order", "n_equal", "ne", _ORDER)]),
    f"""SELECT machine, sensor_a AS sensor, 'correlation' AS "check", 'r:' || sensor_b AS metric, {r6('r')} AS value,
        'strong' AS status FROM pair WHERE abs(r) > CAST(0.04 AS DOUBLE)""",
]
SQL["quality_report"] = with_ctes(_STATS + "\nUNION ALL ".join(_REPORT), "fence", "dict", "ev", "pair")
SQL["stream_quality_report"] = with_ctes(
    _STATS + "\nUNION ALL ".join(part for part in _REPORT if "timestamp_order" not in part), "fence", "dict", "ev", "pair")
_CLOSED = "date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"
SQL["stream_history_report"] = with_ctes(
    _STATS + "\nUNION ALL ".join(_REPORT[:3]), "fence", "dict", "ev").replace(
    "event_id AS ingest_seq FROM events", f"event_id AS ingest_seq FROM events WHERE {_CLOSED}").replace(
    r6("r1.sum_v / nullif(r1.n, 0)"), "r1.sum_v / nullif(r1.n, 0)")
SQL["rollup_folded_in_batches"] = with_ctes(
    f"SELECT machine, sensor, bucket_start, n, {r6('sum_v')} AS sum_v, n_valid, n_invalid FROM r1", "r1")
SQL["readings_without_time"] = """
SELECT l_linestatus AS machine, lower(l_returnflag) AS sensor, count(*) AS "rows", count(*) FILTER (l_tax <= 0) AS untimed,
       CASE WHEN count(*) FILTER (l_tax <= 0) > 0 THEN 'untimed_readings' ELSE 'ok' END AS status
FROM lineitem GROUP BY ALL"""
SQL["describe_with_stored_bins"] = SQL["describe_raw_readings"]
