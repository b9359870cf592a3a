"""SQL answers for the event-log tables and reports, straight from the tables.

Nothing here goes through JSON: `t` is one row per task, `s` per stage, `j` per
job, `p` per SQL execution, derived from line items, orders, customers and parts.
Milli- and nanoseconds are rounded to seconds as decimals: Spark rounds the printed number,
and in binary 0.285 is not a tie.
"""

from __future__ import annotations

BASE = """
WITH o AS (
    SELECT o_orderkey, o_custkey, o_orderstatus, 5 * (o_orderkey // 10000) + o_custkey % 5 AS k,
           epoch_ms(o_orderdate) AS submit, o_orderkey % 10000 AS stage_no,
           min(o_orderkey) OVER (PARTITION BY o_orderkey // 10000, o_custkey) % 10000 AS job_id
    FROM orders),
t0 AS (
    SELECT o.k, o.o_orderkey, o.stage_no, o.o_orderstatus, o.submit, o.job_id,
           l_linenumber, l_partkey, l_suppkey,
           CAST(l_quantity AS BIGINT) AS qty,
           CAST(round(l_extendedprice) AS BIGINT) AS dur,
           CAST(round(l_discount * 100) AS BIGINT) AS discount,
           (l_returnflag = 'R' AND l_tax > 0.07) AS speculative,
           CASE WHEN l_linenumber = 7 OR (l_suppkey % 20 = 19 AND l_linenumber > 2)
                THEN 0 ELSE l_suppkey % 20 END AS e,
           (l_orderkey + l_linenumber) % 50 = 0 AS failed,
           CASE WHEN l_orderkey % 10 = 3 AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS attempt
    FROM lineitem JOIN o ON l_orderkey = o.o_orderkey),
t AS (
    SELECT *, 'c-0001' AS cluster_id,
           'application_1700000000_' || lpad(CAST(k AS VARCHAR), 12, '0') AS app_id,
           dur * (500000 + 8000 * qty) AS cpu,
           dur * discount * 3 // 100 AS gc,
           l_partkey * 500000 AS remote_bytes, qty * 40000000 AS local_bytes,
           CASE WHEN qty > 49 THEN 268435456 ELSE 0 END AS disk_spill,
           CASE WHEN qty > 47 THEN 67108864 ELSE 0 END AS memory_spill,
           CASE WHEN dur > 0 THEN (dur * discount * 3 // 100) / dur * 100 ELSE 0.0 END AS gc_pct,
           CASE WHEN dur > 0 THEN (dur * (500000 + 8000 * qty)) / 1e6 / dur * 100 END AS cpu_pct
    FROM t0),
s AS (
    SELECT cluster_id, app_id, k, stage_no AS stage_id, attempt AS attempt_id, submit,
           'stage ' || o_orderkey AS stage_name,
           CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'FAILED'
                ELSE 'COMPLETED' END AS status,
           CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'aborted'
                ELSE '' END AS failure_reason,
           count(*) AS num_tasks, submit + o_orderkey % 1000 AS first_task,
           submit + max(dur) + 1000 AS complete, max(dur) + 1000 AS duration_ms,
           o_orderkey % 1000 AS scheduling_delay_ms,
           CAST(sum(dur) AS BIGINT) AS run, CAST(sum(cpu) AS BIGINT) AS cpu,
           CAST(sum(gc) AS BIGINT) AS gc, CAST(sum(l_linenumber) AS BIGINT) AS lines,
           CAST(sum(qty) AS BIGINT) AS qty,
           CAST(sum(1024 + l_linenumber) AS BIGINT) AS result_size,
           CAST(sum(l_partkey * 1000) AS BIGINT) AS peak,
           CAST(sum(memory_spill) AS BIGINT) AS memory_spill,
           CAST(sum(disk_spill) AS BIGINT) AS disk_spill,
           CAST(sum(remote_bytes) AS BIGINT) AS remote_bytes,
           CAST(sum(local_bytes) AS BIGINT) AS local_bytes,
           CAST(sum(l_suppkey % 100) AS BIGINT) AS wait,
           CAST(sum(gc) AS BIGINT) / CAST(sum(dur) AS BIGINT) * 100 AS gc_pct,
           CAST(sum(cpu) AS BIGINT) / 1e6 / CAST(sum(dur) AS BIGINT) * 100 AS cpu_pct
    FROM t GROUP BY cluster_id, app_id, k, stage_no, attempt, o_orderkey, o_orderstatus, submit),
j AS (
    SELECT 'c-0001' AS cluster_id,
           'application_1700000000_' || lpad(CAST(k AS VARCHAR), 12, '0') AS app_id, k,
           job_id, o_custkey, min(submit) + o_custkey AS submit,
           CASE WHEN o_custkey % 7 <> 0
                THEN min(submit) + o_custkey + count(*) * 7 * 86400000 END AS complete,
           CASE WHEN o_custkey % 7 <> 0
                THEN CASE WHEN o_custkey % 11 = 0 THEN 'JobFailed' ELSE 'JobSucceeded' END
           END AS job_result,
           '[' || string_agg(CAST(stage_no AS VARCHAR), ',' ORDER BY stage_no) || ']' AS stage_ids
    FROM o GROUP BY k, job_id, o_custkey),
a AS (
    SELECT 'c-0001' AS cluster_id,
           'application_1700000000_' || lpad(CAST(k AS VARCHAR), 12, '0') AS app_id, k,
           min(submit) - 1000 AS begin_ms, max(submit) + CAST(40 AS BIGINT) * 86400000 AS finish_ms
    FROM o GROUP BY k),
ex AS (SELECT DISTINCT cluster_id, app_id, k, e FROM t),
p AS (
    SELECT 'c-0001' AS cluster_id,
           'application_1700000000_' || lpad(CAST(p_partkey % 5 AS VARCHAR), 12, '0') AS app_id,
           p_partkey % 5 AS k, p_partkey, p_name, p_type, p_size,
           CASE WHEN p_size % 2 = 0 THEN 'Photon' ELSE '' END AS fast,
           1700000000000 + p_partkey * 1000 AS start_ms,
           CASE WHEN p_size <> 50 THEN
                1700000000000 + p_partkey * 1000 + p_partkey * 7919 % 100003 END AS end_ms,
           CASE WHEN p_size = 49 THEN NULL
                WHEN p_type IN ('ECONOMY', 'STANDARD')
                THEN (CASE WHEN p_size % 2 = 0 THEN 'Photon' ELSE '' END) || 'BroadcastHashJoin'
                WHEN p_type = 'MEDIUM' THEN 'SortMergeJoin'
                WHEN p_type = 'LARGE' THEN 'ShuffledHashJoin'
                ELSE 'CartesianProduct' END AS join_name
    FROM part)
"""

# Severity and advice of each bottleneck.
ADVICE = """    ('STAGE_FAILURE', 'HIGH', 'failure_reason を確認。OOM の場合は executor memory を増加。'),
    ('DISK_SPILL', 'HIGH', 'executor memory を増加。AQE を有効化: spark.sql.adaptive.enabled=true'),
    ('HIGH_GC', 'MEDIUM', 'UDF・collect の見直し。オブジェクト生成を削減。G1GC チューニングを検討。'),
    ('DATA_SKEW', 'MEDIUM', 'AQE スキュー結合を有効化: spark.sql.adaptive.skewJoin.enabled=true または JOIN キーのサルティング。'),
    ('HEAVY_SHUFFLE', 'LOW', 'Broadcast Join を検討 (spark.sql.autoBroadcastJoinThreshold)。shuffle partitions 数を調整。'),
    ('MEMORY_SPILL', 'LOW', 'spark.memory.fraction を増加。repartition() でパーティションサイズを削減。'),
    ('MODERATE_GC', 'LOW', 'GC 傾向を監視。executor memory の増加を検討。'),
    ('OK', 'NONE', 'ボトルネックなし。')"""

# Per stage attempt, successful tasks only.
PROFILE = """,
pr AS (
    SELECT cluster_id, app_id, stage_no AS stage_id, attempt AS attempt_id, count(*) AS task_count,
           min(dur) AS task_min_ms, max(dur) AS task_max_ms, avg(dur) AS task_avg_ms,
           quantile_disc(dur, 0.5) AS p50, quantile_disc(dur, 0.75) AS p75,
           quantile_disc(dur, 0.95) AS p95, quantile_disc(dur, 0.99) AS p99,
           quantile_disc(gc, 0.95) AS gc_p95,
           quantile_disc(l_partkey * 1000, 0.95) AS peak_p95,
           count(*) FILTER (WHERE speculative) AS speculative_tasks,
           count(*) FILTER (WHERE disk_spill > 0) AS tasks_with_disk_spill,
           min(remote_bytes + local_bytes) AS sh_min, max(remote_bytes + local_bytes) AS sh_max,
           quantile_disc(remote_bytes + local_bytes, 0.5) AS sh_p50,
           CAST(sum(cpu) AS BIGINT) AS cpu_ns, CAST(sum(dur) AS BIGINT) AS run_ms,
           CAST(sum(gc) AS BIGINT) AS gc_ms
    FROM t WHERE NOT failed GROUP BY cluster_id, app_id, stage_no, attempt),
st0 AS (
    SELECT s.cluster_id, s.app_id, CAST(s.stage_id AS INTEGER) AS stage_id, attempt_id,
           stage_name, status, failure_reason, CAST(num_tasks AS INTEGER) AS num_tasks,
           pr.task_count, CASE WHEN pr.task_count IS NOT NULL THEN 0 END AS failed_tasks,
           submit AS submission_ts, first_task AS first_task_ts, complete AS completion_ts,
           duration_ms, scheduling_delay_ms, run AS executor_run_time_ms,
           gc_pct AS gc_overhead_pct, cpu_pct AS cpu_efficiency_pct, gc AS jvm_gc_time_ms,
           round(run * 1024 / 1048576.0::DOUBLE, 1) AS input_mb,
           round(run * 10 / 1048576.0::DOUBLE, 1) AS output_mb,
           round((remote_bytes + local_bytes) / 1048576.0::DOUBLE, 1) AS shuffle_read_mb,
           round(peak / 1048576.0::DOUBLE, 1) AS shuffle_write_mb,
           wait AS shuffle_fetch_wait_ms,
           round(disk_spill / 1048576.0::DOUBLE, 1) AS disk_spill_mb,
           round(memory_spill / 1048576.0::DOUBLE, 1) AS memory_spill_mb,
           disk_spill > 0 AS has_disk_spill, memory_spill > 0 AS has_memory_spill,
           peak AS peak_exec_memory_bytes,
           task_min_ms, task_avg_ms, p50 AS task_p50_ms, p75 AS task_p75_ms,
           p95 AS task_p95_ms, p99 AS task_p99_ms, task_max_ms,
           CASE WHEN p50 > 0 THEN round(task_max_ms / p50, 2) END AS task_skew_ratio,
           task_max_ms - p50 AS time_skew_gap_ms,
           round(sh_min / 1048576.0::DOUBLE, 2) AS task_shuffle_min_mb,
           round(sh_p50 / 1048576.0::DOUBLE, 2) AS task_shuffle_p50_mb,
           round(sh_max / 1048576.0::DOUBLE, 2) AS task_shuffle_max_mb,
           CASE WHEN sh_p50 > 0 THEN round(sh_max / sh_p50, 2) END AS shuffle_skew_ratio,
           round((sh_max - sh_min) / 1048576.0::DOUBLE, 2) AS data_skew_gap_mb,
           round((sh_max - sh_p50) / 1048576.0::DOUBLE, 2) AS data_skew_gap_p50_mb,
           gc_p95 AS gc_p95_ms, round(peak_p95 / 1048576.0::DOUBLE, 1) AS peak_mem_p95_mb,
           speculative_tasks, tasks_with_disk_spill,
           remote_bytes + local_bytes AS read_bytes, disk_spill, memory_spill
    FROM s LEFT JOIN pr USING (cluster_id, app_id, stage_id, attempt_id)),
st1 AS (
    SELECT *, CASE
           WHEN status = 'FAILED' THEN 'STAGE_FAILURE'
           WHEN disk_spill > 0 THEN 'DISK_SPILL'
           WHEN gc_overhead_pct > 20 THEN 'HIGH_GC'
           WHEN task_skew_ratio > 5 THEN 'DATA_SKEW'
           WHEN read_bytes > 10737418240 THEN 'HEAVY_SHUFFLE'
           WHEN memory_spill > 0 THEN 'MEMORY_SPILL'
           WHEN gc_overhead_pct > 10 THEN 'MODERATE_GC'
           ELSE 'OK' END AS bottleneck_type
    FROM st0),
advice(bottleneck_type, severity, recommendation) AS (VALUES
""" + ADVICE + """),
st AS (
    SELECT st1.* EXCLUDE (read_bytes, disk_spill, memory_spill), severity, recommendation
    FROM st1 JOIN advice USING (bottleneck_type))
"""

BOTTLENECKS = """,
bn AS (
    SELECT st.cluster_id, st.app_id, CAST(m.job_id AS INTEGER) AS job_id, st.stage_id,
           stage_name, status, severity, bottleneck_type, duration_ms, num_tasks,
           task_skew_ratio, gc_overhead_pct, disk_spill_mb, memory_spill_mb, shuffle_read_mb,
           task_p95_ms, task_p99_ms, recommendation, failure_reason
    FROM st LEFT JOIN (SELECT k, job_id, stage_no FROM o) m
      ON m.stage_no = st.stage_id
     AND st.app_id = 'application_1700000000_' || lpad(CAST(m.k AS VARCHAR), 12, '0')
    WHERE bottleneck_type <> 'OK')
"""

JOBS = """,
jp AS (
    SELECT cluster_id, app_id, CAST(job_id AS INTEGER) AS job_id,
           CASE WHEN job_result = 'JobSucceeded' THEN 'SUCCEEDED'
                WHEN job_result IS NOT NULL THEN 'FAILED' ELSE 'RUNNING' END AS status,
           submit AS submit_ts, complete AS complete_ts, complete - submit AS duration_ms,
           round((complete - submit) / 60000, 2) AS duration_min, job_result, stage_ids
    FROM j)
"""

# The plain interval join, as it is defined; only DuckDB runs it.
CONCURRENCY = JOBS + """,
cc AS (
    SELECT a.app_id, a.job_id, count(b.job_id) AS concurrent_jobs_at_start
    FROM jp a LEFT JOIN jp b
      ON a.app_id = b.app_id AND a.job_id <> b.job_id AND b.submit_ts <= a.submit_ts
     AND (b.complete_ts IS NULL OR b.complete_ts >= a.submit_ts)
    GROUP BY a.app_id, a.job_id),
jt AS (
    SELECT app_id, job_id, count(*) AS tasks, CAST(sum(cpu) AS BIGINT) AS cpu,
           CAST(sum(dur) AS BIGINT) AS run, avg(cpu) AS mean_cpu, CAST(sum(gc) AS BIGINT) AS gc
    FROM t WHERE NOT failed GROUP BY app_id, job_id),
jc AS (
    SELECT jp.cluster_id, jp.app_id, jp.job_id, CAST(jp.job_id AS VARCHAR) AS job_id_str,
           status, job_result, submit_ts, complete_ts, duration_ms,
           CAST(round(CAST(duration_ms AS DECIMAL(18, 0)) * 0.001, 1) AS DOUBLE) AS duration_sec, duration_min,
           concurrent_jobs_at_start, tasks AS job_total_tasks,
           CAST(round(CAST(cpu AS DECIMAL(25, 0)) * 0.000000001, 2) AS DOUBLE) AS total_cpu_time_sec,
           CAST(round(CAST(run AS DECIMAL(18, 0)) * 0.001, 1) AS DOUBLE) AS total_exec_run_time_sec,
           round(cpu / 1e6 / greatest(run, 1) * 100, 1) AS job_cpu_efficiency_pct,
           round(mean_cpu / 1e6, 1) AS avg_task_cpu_time_ms,
           CAST(round(CAST(gc AS DECIMAL(18, 0)) * 0.001, 1) AS DOUBLE) AS total_gc_time_sec
    FROM jp JOIN cc USING (app_id, job_id) LEFT JOIN jt USING (app_id, job_id))
"""

APPLICATIONS = """,
sa AS (
    SELECT k, count(*) AS total_stages,
           count(*) FILTER (WHERE status = 'COMPLETED') AS completed_stages,
           count(*) FILTER (WHERE status = 'FAILED') AS failed_stages,
           CAST(sum(num_tasks) AS BIGINT) AS total_tasks, CAST(sum(run) AS BIGINT) AS run,
           CAST(sum(gc) AS BIGINT) AS gc,
           CAST(sum(remote_bytes + local_bytes) AS BIGINT) AS read_bytes,
           CAST(sum(disk_spill + memory_spill) AS BIGINT) AS spill,
           count(*) FILTER (WHERE disk_spill > 0) AS stages_with_disk_spill
    FROM s GROUP BY k),
ja AS (
    SELECT k, count(*) AS total_jobs,
           count(*) FILTER (WHERE job_result = 'JobSucceeded') AS succeeded_jobs,
           count(*) FILTER (WHERE job_result <> 'JobSucceeded') AS failed_jobs
    FROM j WHERE job_result IS NOT NULL GROUP BY k),
ap AS (
    SELECT cluster_id, app_id, 'app ' || a.k AS app_name, 'user' || a.k AS spark_user,
           begin_ms AS start_ts, CASE WHEN a.k <> 4 THEN finish_ms END AS end_ts,
           CASE WHEN a.k <> 4 THEN finish_ms - begin_ms END AS duration_ms,
           CASE WHEN a.k <> 4 THEN (finish_ms - begin_ms) / 60000 END AS duration_min,
           total_jobs, succeeded_jobs, failed_jobs,
           round(succeeded_jobs / total_jobs * 100, 1) AS job_success_rate,
           total_stages, completed_stages, failed_stages, total_tasks,
           round(run * 1024 / 1073741824.0::DOUBLE, 3) AS total_input_gb,
           round(read_bytes / 1073741824.0::DOUBLE, 3) AS total_shuffle_gb,
           round(spill / 1073741824.0::DOUBLE, 3) AS total_spill_gb, stages_with_disk_spill,
           gc AS total_gc_time_ms, round(gc / run * 100, 2) AS gc_overhead_pct,
           run AS total_exec_run_ms
    FROM a LEFT JOIN sa USING (k) LEFT JOIN ja USING (k))
"""

EXECUTORS = """,
xl AS (
    SELECT cluster_id, app_id, k, e, count(*) AS total_tasks,
           CAST(sum(dur) AS BIGINT) AS total_task_ms, avg(dur) AS avg_task_ms,
           CAST(sum(gc) AS BIGINT) AS total_gc_ms, avg(gc_pct) AS avg_gc_pct,
           avg(cpu_pct) AS avg_cpu_efficiency_pct,
           CAST(sum(remote_bytes + local_bytes) AS BIGINT) AS read_bytes,
           CAST(sum(l_partkey * 1000) AS BIGINT) AS write_bytes,
           CAST(sum(memory_spill) AS BIGINT) AS total_memory_spilled,
           CAST(sum(disk_spill) AS BIGINT) AS total_disk_spilled,
           max(l_partkey * 1000) AS peak,
           count(*) FILTER (WHERE speculative) AS speculative_tasks
    FROM t WHERE NOT failed GROUP BY cluster_id, app_id, k, e),
xn AS (
    SELECT app_id, avg(total_task_ms) AS mean_ms, stddev_samp(total_task_ms) AS spread
    FROM xl GROUP BY app_id),
xx AS (
    SELECT xl.cluster_id, xl.app_id, CAST(e AS VARCHAR) AS executor_id, 'h' || e AS host,
           CAST(4 + e % 3 AS INTEGER) AS total_cores, begin_ms + 500 + e AS add_ts,
           CASE WHEN e % 5 = 0 THEN begin_ms + CAST(86400000 AS BIGINT) * (e + 1) END AS remove_ts,
           CASE WHEN e % 5 = 0 THEN 'idle' END AS removed_reason,
           CAST(e % 2 AS INTEGER) AS resource_profile_id,
           CAST(4096 * (e % 2 + 1) AS DOUBLE) AS onheap_memory_mb,
           CAST(1024 * (e % 2) AS DOUBLE) AS offheap_memory_mb, 1.0::DOUBLE AS task_cpus,
           total_tasks, total_task_ms, avg_task_ms, total_gc_ms,
           round(avg_gc_pct, 6) AS avg_gc_pct,
           round(avg_cpu_efficiency_pct, 6) AS avg_cpu_efficiency_pct,
           round(total_task_ms * 1024 / 1073741824.0::DOUBLE, 3) AS input_gb,
           round(read_bytes / 1073741824.0::DOUBLE, 3) AS shuffle_read_gb,
           round(write_bytes / 1073741824.0::DOUBLE, 3) AS shuffle_write_gb,
           total_memory_spilled, total_disk_spilled,
           round(peak / 1048576.0::DOUBLE, 1) AS peak_memory_mb, speculative_tasks,
           mean_ms AS app_avg_task_ms,
           CASE WHEN mean_ms > 0 THEN round(total_task_ms / mean_ms, 2) END AS load_vs_avg,
           CASE WHEN spread > 0 THEN round((total_task_ms - mean_ms) / spread, 2) END AS z_score,
           round(total_task_ms / mean_ms, 2) > 1.5 AS is_straggler,
           round(total_task_ms / mean_ms, 2) < 0.5 AS is_underutilized
    FROM xl JOIN xn USING (app_id) JOIN a USING (k))
"""

SQLS = """,
sq AS (
    SELECT cluster_id, app_id, p_partkey AS execution_id, 'run ' || p_name AS description_short,
           start_ms AS start_ts, CAST(round(CAST((end_ms - start_ms) AS DECIMAL(18, 0)) * 0.001, 2) AS DOUBLE) AS duration_sec,
           CASE WHEN p_size <> 49 THEN 3 END AS total_operators,
           CASE WHEN p_size <> 49 THEN CAST(fast <> '' AS INTEGER)
                + CAST(join_name LIKE 'Photon%' AS INTEGER) END AS photon_operators,
           CASE WHEN p_size <> 49 THEN round((CAST(fast <> '' AS INTEGER)
                + CAST(join_name LIKE 'Photon%' AS INTEGER)) / 3 * 100, 1) END AS photon_pct,
           CASE WHEN p_size <> 49 THEN CAST(fast <> '' AS VARCHAR) END AS is_photon,
           CAST(join_name = 'BroadcastHashJoin' AS INTEGER) AS bhj_count,
           CAST(join_name = 'PhotonBroadcastHashJoin' AS INTEGER) AS photon_bhj_count,
           CAST(join_name = 'SortMergeJoin' AS INTEGER) AS smj_count,
           CAST(join_name IN ('BroadcastHashJoin', 'PhotonBroadcastHashJoin', 'SortMergeJoin')
                AS INTEGER) AS total_join_count,
           CASE WHEN p_size <> 49 THEN 'Scan' || CASE WHEN fast = '' THEN ', Filter' ELSE '' END
                || CASE WHEN join_name LIKE 'Photon%' THEN '' ELSE ', ' || join_name END
           END AS non_photon_op_list
    FROM p)
"""

CONFIG = """
    ('spark.sql.adaptive.enabled', 'false'), ('spark.sql.adaptive.skewJoin.enabled', 'false'),
    ('spark.executor.memory', (4 + k % 7) || 'g'), ('spark.executor.cores', '4'),
    ('spark.sql.shuffle.partitions', CAST(200 + k AS VARCHAR)), ('spark.memory.fraction', '0.6')
"""

TABLES = {
    "bronze_raw_events": BASE + """,
ev AS (
    SELECT app_id, 'SparkListenerTaskEnd' AS event_type, count(*) AS events FROM t GROUP BY app_id
    UNION ALL SELECT app_id, 'SparkListenerStageCompleted', count(*) FROM s GROUP BY app_id
    UNION ALL SELECT app_id, 'SparkListenerJobStart', count(*) FROM j GROUP BY app_id
    UNION ALL SELECT app_id, 'SparkListenerJobEnd', count(job_result) FROM j GROUP BY app_id
    UNION ALL SELECT app_id, 'SparkListenerApplicationStart', 1 FROM a
    UNION ALL SELECT app_id, 'SparkListenerApplicationEnd', 1 FROM a WHERE k <> 4
    UNION ALL SELECT app_id, 'SparkListenerEnvironmentUpdate', 1 FROM a
    UNION ALL SELECT app_id, 'SparkListenerResourceProfileAdded', 2 FROM a
    UNION ALL SELECT app_id, 'SparkListenerExecutorAdded', count(*) FROM ex GROUP BY app_id
    UNION ALL SELECT app_id, 'SparkListenerExecutorRemoved', count(*) FROM ex WHERE e % 5 = 0
              GROUP BY app_id
    UNION ALL SELECT app_id,
              'org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart', count(*)
              FROM p GROUP BY app_id
    UNION ALL SELECT app_id,
              'org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd', count(end_ms)
              FROM p GROUP BY app_id)
SELECT 'c-0001' AS cluster_id, app_id, event_type, CAST(events AS BIGINT) AS events FROM ev
""",
    "silver_application_events": BASE + """
SELECT cluster_id, app_id, 'SparkListenerApplicationStart' AS event_type, 'app ' || k AS app_name,
       'user' || k AS spark_user, begin_ms AS timestamp_ts, begin_ms AS timestamp_ms FROM a
UNION ALL
SELECT cluster_id, app_id, 'SparkListenerApplicationEnd', NULL, NULL, finish_ms, finish_ms
FROM a WHERE k <> 4
""",
    "silver_job_events": BASE + """
SELECT cluster_id, app_id, 'SparkListenerJobStart' AS event_type, CAST(job_id AS INTEGER) AS job_id,
       submit AS submission_ts, CAST(NULL AS BIGINT) AS completion_ts, submit AS submission_ms,
       CAST(NULL AS BIGINT) AS completion_ms, CAST(NULL AS VARCHAR) AS job_result, stage_ids FROM j
UNION ALL
SELECT cluster_id, app_id, 'SparkListenerJobEnd', job_id, NULL, complete, NULL, complete,
       job_result, NULL FROM j WHERE complete IS NOT NULL
""",
    "silver_stage_events": BASE + """
SELECT cluster_id, app_id, CAST(stage_id AS INTEGER) AS stage_id, attempt_id, stage_name,
       status, failure_reason, CAST(num_tasks AS INTEGER) AS num_tasks, submit AS submission_ts,
       first_task AS first_task_ts, complete AS completion_ts, duration_ms, scheduling_delay_ms,
       run AS executor_run_time_ms, cpu AS executor_cpu_time_ns, gc AS jvm_gc_time_ms,
       gc_pct AS gc_overhead_pct, cpu_pct AS cpu_efficiency_pct, lines AS deserialize_ms,
       qty AS result_serialize_ms, result_size AS result_size_bytes,
       peak AS peak_exec_memory_bytes, memory_spill AS memory_bytes_spilled,
       disk_spill AS disk_bytes_spilled, run * 1024 AS input_bytes, qty * 10 AS input_records,
       run * 10 AS output_bytes, qty AS output_records,
       remote_bytes + local_bytes AS shuffle_read_bytes, qty * 100 AS shuffle_read_records,
       remote_bytes AS shuffle_remote_bytes, local_bytes AS shuffle_local_bytes,
       lines AS shuffle_remote_blocks, qty AS shuffle_local_blocks, wait AS shuffle_fetch_wait_ms,
       peak AS shuffle_write_bytes, qty AS shuffle_write_records, run * 1000 AS shuffle_write_time_ns
FROM s
""",
    "silver_task_events": BASE + """
SELECT cluster_id, app_id, CAST(stage_no AS INTEGER) AS stage_id, attempt AS attempt_id,
       o_orderkey * 100 + l_linenumber AS task_id, l_linenumber AS index,
       'ResultTask' AS task_type,
       CASE WHEN failed THEN 'ExceptionFailure' ELSE 'Success' END AS task_result,
       CAST(e AS VARCHAR) AS executor_id, 'h' || e AS host, 'NODE_LOCAL' AS locality, speculative,
       submit AS launch_ts, dur AS task_duration_ms, dur AS executor_run_time_ms,
       cpu AS executor_cpu_time_ns, CAST(l_linenumber AS BIGINT) AS deserialize_ms,
       qty AS result_serialize_ms, gc AS gc_time_ms, gc_pct AS gc_overhead_pct,
       cpu_pct AS cpu_efficiency_pct, CAST(1024 + l_linenumber AS BIGINT) AS result_size_bytes,
       l_partkey * 1000 AS peak_exec_memory_bytes,
       CAST(memory_spill AS BIGINT) AS memory_bytes_spilled,
       CAST(disk_spill AS BIGINT) AS disk_bytes_spilled,
       remote_bytes + local_bytes AS shuffle_read_bytes, qty * 100 AS shuffle_read_records,
       remote_bytes AS shuffle_remote_bytes, local_bytes AS shuffle_local_bytes,
       CAST(l_linenumber AS BIGINT) AS shuffle_remote_blocks, qty AS shuffle_local_blocks,
       l_suppkey % 100 AS shuffle_fetch_wait_ms, l_partkey * 1000 AS shuffle_write_bytes,
       qty AS shuffle_write_records, dur * 1000 AS shuffle_write_time_ns,
       dur * 1024 AS input_bytes, qty * 10 AS input_records, dur * 10 AS output_bytes,
       qty AS output_records
FROM t
""",
    "silver_executor_events": BASE + """
SELECT ex.cluster_id, ex.app_id, 'SparkListenerExecutorAdded' AS event_type,
       CAST(e AS VARCHAR) AS executor_id, begin_ms + 500 + e AS timestamp_ts, 'h' || e AS host,
       CAST(4 + e % 3 AS INTEGER) AS total_cores, CAST(NULL AS VARCHAR) AS removed_reason,
       CAST(e % 2 AS INTEGER) AS resource_profile_id
FROM ex JOIN a USING (k)
UNION ALL
SELECT ex.cluster_id, ex.app_id, 'SparkListenerExecutorRemoved', CAST(e AS VARCHAR),
       begin_ms + CAST(86400000 AS BIGINT) * (e + 1), NULL, NULL, 'idle', NULL
FROM ex JOIN a USING (k) WHERE e % 5 = 0
""",
    "silver_resource_profiles": BASE + """
SELECT cluster_id, app_id, CAST(i AS INTEGER) AS resource_profile_id,
       CAST(4096 * (i + 1) AS DOUBLE) AS onheap_memory_mb,
       CAST(1024 * i AS DOUBLE) AS offheap_memory_mb, 1.0::DOUBLE AS task_cpus
FROM a, (VALUES (0), (1)) AS v(i)
""",
    "silver_spark_config": BASE + f"""
SELECT cluster_id, app_id, config_key, config_value
FROM a, LATERAL (VALUES {CONFIG}) AS v(config_key, config_value)
""",
    "silver_sql_executions": BASE + """
SELECT cluster_id, app_id, p_partkey AS execution_id,
       '  run ' || chr(10) || '  ' || p_name || '  ' AS description,
       CASE WHEN p_size <> 49 THEN '(1) Scan parquet' || chr(10) || '(2) ' || fast || 'Filter'
            || chr(10) || '(3) ' || join_name END AS physical_plan,
       start_ms AS start_time_ms, end_ms AS end_time_ms
FROM p
""",
    "gold_application_summary": BASE + APPLICATIONS + "SELECT * FROM ap",
    "gold_job_performance": BASE + JOBS + "SELECT * FROM jp",
    "gold_stage_performance": BASE + PROFILE + "SELECT * FROM st",
    "gold_executor_analysis": BASE + EXECUTORS + "SELECT * FROM xx",
    "gold_bottleneck_report": BASE + PROFILE + BOTTLENECKS + "SELECT * FROM bn",
    "gold_job_concurrency": BASE + CONCURRENCY + "SELECT * FROM jc",
    "gold_sql_photon_analysis": BASE + SQLS + "SELECT * FROM sq",
    "work_stage_task_profile": BASE + PROFILE + """
SELECT cluster_id, app_id, CAST(stage_id AS INTEGER) AS stage_id, attempt_id,
       p50 AS task_p50_ms, p75 AS task_p75_ms, p95 AS task_p95_ms, p99 AS task_p99_ms,
       task_min_ms, task_max_ms, task_avg_ms, gc_p95 AS gc_p95_ms,
       peak_p95 AS peak_mem_p95_bytes, sh_p50 AS task_shuffle_p50_bytes,
       sh_min AS task_shuffle_min_bytes, sh_max AS task_shuffle_max_bytes, task_count,
       0 AS failed_tasks, speculative_tasks, tasks_with_disk_spill, cpu_ns,
       task_count AS cpu_tasks, run_ms, gc_ms
FROM pr
""",
    "work_job_stage_map": BASE + """
SELECT 'c-0001' AS cluster_id,
       'application_1700000000_' || lpad(CAST(k AS VARCHAR), 12, '0') AS app_id,
       CAST(job_id AS INTEGER) AS job_id, CAST(stage_no AS INTEGER) AS stage_id
FROM o
""",
    "work_executor_load": BASE + EXECUTORS + """
SELECT cluster_id, app_id, CAST(e AS VARCHAR) AS executor_id, 'h' || e AS host, total_tasks,
       total_task_ms, avg_task_ms, total_gc_ms, round(avg_gc_pct, 6) AS avg_gc_pct,
       round(avg_cpu_efficiency_pct, 6) AS avg_cpu_efficiency_pct,
       total_task_ms * 1024 AS input_bytes, read_bytes AS shuffle_read_bytes,
       write_bytes AS shuffle_write_bytes, total_memory_spilled, total_disk_spilled,
       peak AS peak_memory_bytes, speculative_tasks
FROM xl
""",
}

# --- reports ---------------------------------------------------------------------------

# Dataset -> (CTEs, relation). Seconds and text columns are added as the reports show them.
DATASETS = {
    "application": (APPLICATIONS, "ap"),
    "job": (JOBS + """,
jd AS (SELECT * EXCLUDE (job_id), CAST(job_id AS VARCHAR) AS job_id_str,
              duration_ms / 1000.0::DOUBLE AS duration_sec FROM jp)
""", "jd"),
    "stage": (PROFILE + """,
sd AS (SELECT *, CAST(stage_id AS VARCHAR) AS stage_id_str,
              CAST(round(CAST(scheduling_delay_ms AS DECIMAL(18, 0)) * 0.001, 2) AS DOUBLE) AS scheduling_delay_sec,
              CAST(round(CAST(shuffle_fetch_wait_ms AS DECIMAL(18, 0)) * 0.001, 2) AS DOUBLE) AS shuffle_fetch_wait_sec,
              CAST(round(CAST(task_p50_ms AS DECIMAL(18, 0)) * 0.001, 3) AS DOUBLE) AS task_p50_sec,
              CAST(round(CAST(task_max_ms AS DECIMAL(18, 0)) * 0.001, 3) AS DOUBLE) AS task_max_sec,
              CAST(round(CAST(time_skew_gap_ms AS DECIMAL(18, 0)) * 0.001, 3) AS DOUBLE) AS time_skew_gap_sec FROM st)
""", "sd"),
    "executor": (EXECUTORS + """,
xd AS (SELECT * EXCLUDE (is_straggler, is_underutilized, speculative_tasks),
              avg_task_ms / 1000.0::DOUBLE AS avg_task_sec,
              CAST(is_straggler AS VARCHAR) AS is_straggler_str,
              CAST(is_underutilized AS VARCHAR) AS is_underutilized_str FROM xx)
""", "xd"),
    "concurrency": (CONCURRENCY, "jc"),
    "bottleneck": (PROFILE + BOTTLENECKS, "bn"),
    "sql": (SQLS, "sq"),
}
NOT_IN_STAGE_DATASET = (
    "executor_run_time_ms, jvm_gc_time_ms, input_mb, output_mb, has_disk_spill,"
    " has_memory_spill, peak_exec_memory_bytes, data_skew_gap_p50_mb, gc_p95_ms,"
    " peak_mem_p95_mb, speculative_tasks, tasks_with_disk_spill"
)


def _from(dataset: str, select: str) -> str:
    ctes, relation = DATASETS[dataset]
    return BASE + ctes + select.replace("{r}", relation)


def _slowest(tiles: int, output: str) -> str:
    return _from("sql", f"""
SELECT round(avg(photon_pct), 6) AS {output} FROM (
    SELECT photon_pct, ntile({tiles}) OVER (
        ORDER BY duration_sec DESC, cluster_id, app_id, execution_id) AS tile
    FROM {{r}} WHERE duration_sec IS NOT NULL) WHERE tile = 1
""")


LEVEL = "CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"

REPORTS = {
    "dataset_application": _from("application", "SELECT * FROM {r}"),
    "dataset_job": _from("job", "SELECT * FROM {r}"),
    "dataset_stage": _from("stage", f"SELECT * EXCLUDE ({NOT_IN_STAGE_DATASET}) FROM {{r}}"),
    "dataset_executor": _from("executor", "SELECT * FROM {r}"),
    "dataset_concurrency": _from("concurrency", "SELECT * FROM {r} ORDER BY submit_ts"),
    "dataset_bottleneck": _from("bottleneck", "SELECT * FROM {r}"),
    "dataset_sql": _from("sql", "SELECT * FROM {r} ORDER BY duration_sec DESC NULLS LAST"),
    "jobs_by_submit_time": BASE + JOBS + "SELECT * FROM jp ORDER BY submit_ts",
    "bottlenecks_by_severity": _from(
        "bottleneck", f"SELECT * FROM {{r}} ORDER BY {LEVEL}, duration_ms DESC"
    ),
    "slowest_5_percent": _slowest(20, "avg_photon_pct_top5"),
    "slowest_10_percent": _slowest(10, "avg_photon_pct_top10"),
    "application_figures": _from("application", """
SELECT total_jobs, succeeded_jobs, failed_jobs, round(job_success_rate, 1) AS job_success_rate,
       round(total_shuffle_gb, 2) AS total_shuffle_gb, round(total_spill_gb, 2) AS total_spill_gb,
       round(gc_overhead_pct, 1) AS gc_overhead_pct, round(duration_min, 1) AS duration_min
FROM {r} ORDER BY start_ts, cluster_id, app_id LIMIT 1
"""),
    "bottleneck_counts": _from("bottleneck", f"""
SELECT bottleneck_type, severity, count(*) AS cnt FROM {{r}}
GROUP BY bottleneck_type, severity ORDER BY {LEVEL}, cnt DESC
"""),
    "slowest_jobs": BASE + JOBS + """
SELECT job_id, CAST(round(CAST(duration_ms AS DECIMAL(18, 0)) * 0.001, 1) AS DOUBLE) AS duration_sec, job_result, stage_ids
FROM jp ORDER BY duration_ms DESC NULLS LAST, cluster_id, app_id, job_id LIMIT 5
""",
    "worst_stages": BASE + PROFILE + """
SELECT stage_id, stage_name, bottleneck_type, severity,
       CAST(round(CAST(duration_ms AS DECIMAL(18, 0)) * 0.001, 1) AS DOUBLE) AS duration_sec, num_tasks,
       round(task_skew_ratio, 1) AS task_skew_ratio, round(shuffle_read_mb, 0) AS shuffle_read_mb,
       round(gc_overhead_pct, 1) AS gc_overhead_pct, recommendation
FROM st WHERE bottleneck_type <> 'OK'
ORDER BY duration_ms DESC NULLS LAST, cluster_id, app_id, stage_id, attempt_id LIMIT 5
""",
    "least_efficient_jobs": _from("concurrency", """
SELECT job_id, round(duration_sec, 1) AS duration_sec, concurrent_jobs_at_start,
       round(job_cpu_efficiency_pct, 1) AS cpu_efficiency_pct,
       round(total_gc_time_sec, 1) AS gc_time_sec
FROM {r} ORDER BY job_cpu_efficiency_pct ASC NULLS LAST, cluster_id, app_id, job_id LIMIT 5
"""),
    "least_accelerated": _from("sql", """
SELECT description_short, round(duration_sec, 1) AS duration_sec,
       round(photon_pct, 1) AS photon_pct, non_photon_op_list
FROM {r} WHERE duration_sec IS NOT NULL
ORDER BY photon_pct ASC NULLS FIRST, duration_sec DESC NULLS LAST, cluster_id, app_id,
         execution_id LIMIT 5
"""),
    "counters_application": _from("application", """
SELECT CAST(sum(total_tasks) AS BIGINT) AS total_tasks,
       CAST(sum(total_stages) AS BIGINT) AS total_stages,
       CAST(sum(total_jobs) AS BIGINT) AS total_jobs,
       round(sum(total_shuffle_gb), 6) AS total_shuffle_gb,
       round(sum(total_spill_gb), 6) AS total_spill_gb,
       round(avg(job_success_rate), 6) AS job_success_rate FROM {r}
"""),
    "counters_sql": _from("sql", """
SELECT round(avg(photon_pct), 6) AS avg_photon_pct,
       CAST(sum(photon_operators) AS BIGINT) AS photon_operators,
       CAST(sum(total_operators) AS BIGINT) AS total_operators,
       CAST(sum(smj_count) AS BIGINT) AS smj_count, CAST(sum(bhj_count) AS BIGINT) AS bhj_count,
       CAST(sum(photon_bhj_count) AS BIGINT) AS photon_bhj_count FROM {r}
"""),
    "counters_concurrency": _from("concurrency", """
SELECT max(concurrent_jobs_at_start) AS max_concurrent_jobs,
       avg(concurrent_jobs_at_start) AS avg_concurrent_jobs,
       round(avg(job_cpu_efficiency_pct), 6) AS avg_cpu_efficiency_pct,
       round(sum(total_cpu_time_sec), 6) AS total_cpu_time_sec,
       round(sum(total_gc_time_sec), 6) AS total_gc_time_sec FROM {r}
"""),
    "counters_stage": _from(
        "stage", "SELECT max(scheduling_delay_sec) AS max_scheduling_delay_sec FROM {r}"
    ),
    "acceptance_bottlenecks": _from(
        "bottleneck", "SELECT bottleneck_type, severity, stage_name, recommendation FROM {r}"
    ),
    "acceptance_skew": _from("stage", """
SELECT stage_id, stage_name, task_skew_ratio, task_p50_ms, task_max_ms, time_skew_gap_ms FROM {r}
"""),
    "acceptance_sql": _from("sql", """
SELECT description_short, duration_sec, photon_pct, non_photon_op_list FROM {r}
"""),
    "acceptance_concurrency": _from("concurrency", """
SELECT job_id, concurrent_jobs_at_start, job_cpu_efficiency_pct, duration_sec FROM {r}
"""),
}

CHARTS = {
    "job_duration": ("job", "job_id_str, status", "max(duration_sec)"),
    "bottlenecks": ("bottleneck", "bottleneck_type, severity", "count(stage_id)"),
    "stage_duration": ("stage", "stage_id_str, bottleneck_type", "max(duration_ms)"),
    "executor_mean_task": ("executor", "executor_id, is_straggler_str", "max(avg_task_sec)"),
    "time_skew_gap": ("stage", "stage_id_str, bottleneck_type", "max(time_skew_gap_sec)"),
    "data_skew_gap": ("stage", "stage_id_str, bottleneck_type", "max(data_skew_gap_mb)"),
    "shuffle_read": ("stage", "stage_id_str, bottleneck_type", "max(shuffle_read_mb)"),
    "shuffle_write": ("stage", "stage_id_str, bottleneck_type", "max(shuffle_write_mb)"),
    "fetch_wait": ("stage", "stage_id_str, bottleneck_type", "max(shuffle_fetch_wait_sec)"),
    "executor_shuffle": ("executor", "executor_id, is_straggler_str", "max(shuffle_read_gb)"),
    "cpu_efficiency": ("concurrency", "job_id_str, status", "max(job_cpu_efficiency_pct)"),
    "concurrency": ("concurrency", "job_id_str, status", "max(concurrent_jobs_at_start)"),
    "scheduling_delay": ("stage", "stage_id_str, bottleneck_type", "max(scheduling_delay_sec)"),
}
SCATTERS = {
    "skew_vs_duration": ("stage", "task_skew_ratio, duration_ms, bottleneck_type"),
    "data_vs_time_skew": ("stage", "shuffle_skew_ratio, task_skew_ratio, bottleneck_type"),
    "concurrency_vs_cpu": (
        "concurrency", "concurrent_jobs_at_start, job_cpu_efficiency_pct, status",
    ),
    "concurrency_vs_duration": ("concurrency", "concurrent_jobs_at_start, duration_sec, status"),
}
DETAILS = {
    "bottleneck": (
        "bottleneck",
        "job_id, stage_id, recommendation, num_tasks, status, bottleneck_type, failure_reason",
    ),
    "stage": (
        "stage",
        """stage_id_str, recommendation, disk_spill_mb, duration_ms, failed_tasks,
        memory_spill_mb, num_tasks, shuffle_read_mb, shuffle_write_mb, stage_id,
        scheduling_delay_ms, task_count, status, attempt_id, cpu_efficiency_pct,
        gc_overhead_pct, task_avg_ms, task_max_ms, task_min_ms, task_p50_ms, task_p75_ms,
        task_p95_ms, task_p99_ms, task_skew_ratio, app_id, bottleneck_type, failure_reason,
        severity, stage_name, completion_ts, first_task_ts, submission_ts""",
    ),
    "executor": (
        "executor",
        """executor_id, host, total_cores, task_cpus, resource_profile_id, onheap_memory_mb,
        offheap_memory_mb, is_straggler_str, is_underutilized_str, removed_reason,
        avg_task_sec, total_tasks, total_task_ms, avg_gc_pct, avg_cpu_efficiency_pct,
        load_vs_avg, z_score, input_gb, shuffle_read_gb, shuffle_write_gb, peak_memory_mb,
        total_memory_spilled, total_disk_spilled, add_ts, remove_ts""",
    ),
    "skew": (
        "stage",
        """stage_id_str, stage_name, bottleneck_type, num_tasks, task_p50_sec, task_max_sec,
        time_skew_gap_sec, task_skew_ratio, task_shuffle_min_mb, task_shuffle_p50_mb,
        task_shuffle_max_mb, data_skew_gap_mb, shuffle_skew_ratio""",
    ),
    "sql": (
        "sql",
        """execution_id, description_short, start_ts, duration_sec, photon_pct, is_photon,
        total_join_count, photon_bhj_count, bhj_count, smj_count, non_photon_op_list""",
    ),
    "shuffle": (
        "stage",
        """stage_id_str, stage_name, bottleneck_type, num_tasks, shuffle_read_mb,
        shuffle_write_mb, shuffle_fetch_wait_sec, task_shuffle_min_mb, task_shuffle_p50_mb,
        task_shuffle_max_mb, shuffle_skew_ratio, data_skew_gap_mb, duration_ms, severity,
        recommendation""",
    ),
    "concurrency": (
        "concurrency",
        """job_id_str, status, job_result, submit_ts, complete_ts, duration_sec,
        concurrent_jobs_at_start, job_total_tasks, total_cpu_time_sec,
        total_exec_run_time_sec, job_cpu_efficiency_pct, avg_task_cpu_time_ms,
        total_gc_time_sec""",
    ),
}

# The English advice.
ENGLISH = """
    ('STAGE_FAILURE', 'Check failure_reason; increase executor memory for OOM.'),
    ('DISK_SPILL', 'Increase executor memory; enable AQE'),
    ('HIGH_GC', 'Review UDFs; reduce object creation; tune G1GC'),
    ('DATA_SKEW', 'Enable AQE skew join; salt join keys'),
    ('HEAVY_SHUFFLE', 'Use broadcast joins; tune shuffle partitions'),
    ('MEMORY_SPILL', 'Increase spark.memory.fraction; repartition'),
    ('MODERATE_GC', 'Monitor GC trends; consider more executor memory'),
    ('OK', 'No action needed')
"""

OPTIONS = {
    "option_english_texts": BASE + PROFILE + f"""
SELECT app_id, stage_id, attempt_id, bottleneck_type, severity, e.text AS recommendation
FROM st JOIN (VALUES {ENGLISH}) AS e(kind, text) ON e.kind = bottleneck_type
""",
    "option_ignored_failures": BASE + PROFILE + """
SELECT app_id, stage_id, attempt_id, status, CASE
       WHEN status = 'FAILED' AND failure_reason NOT LIKE 'abort%' THEN 'STAGE_FAILURE'
       WHEN disk_spill > 0 THEN 'DISK_SPILL'
       WHEN gc_overhead_pct > 20 THEN 'HIGH_GC'
       WHEN task_skew_ratio > 5 THEN 'DATA_SKEW'
       WHEN read_bytes > 10737418240 THEN 'HEAVY_SHUFFLE'
       WHEN memory_spill > 0 THEN 'MEMORY_SPILL'
       WHEN gc_overhead_pct > 10 THEN 'MODERATE_GC'
       ELSE 'OK' END AS bottleneck_type
FROM st0
""",
    "option_other_joins": BASE + SQLS + """
SELECT sq.app_id, execution_id, total_join_count,
       CAST(join_name IN ('ShuffledHashJoin', 'CartesianProduct') AS INTEGER) AS other_join_count
FROM sq JOIN p ON p.p_partkey = execution_id
""",
    "stage_task_extras": BASE + """
SELECT cluster_id, app_id, CAST(stage_no AS INTEGER) AS stage_id, attempt AS attempt_id,
       count(*) FILTER (WHERE failed) AS failed_task_attempts,
       CAST(0 AS BIGINT) AS scheduling_delay_from_tasks_ms
FROM t GROUP BY cluster_id, app_id, stage_no, attempt
""",
    "rule_counts": BASE + """
SELECT 'silver_application_events' AS table_name, 'valid_app_id' AS rule,
       2 * count(*) - count(*) FILTER (WHERE k = 4) AS rows, CAST(0 AS BIGINT) AS broken FROM a
UNION ALL SELECT 'silver_job_events', 'valid_job_id', count(*) + count(job_result), 0 FROM j
UNION ALL SELECT 'silver_stage_events', 'valid_stage_id', count(*), 0 FROM s
UNION ALL SELECT 'silver_stage_events', 'has_tasks', count(*), 0 FROM s
UNION ALL SELECT 'silver_task_events', 'valid_task_id', count(*), 0 FROM t
UNION ALL SELECT 'silver_task_events', 'has_metrics', count(*), 0 FROM t
""",
}

QUERIES = TABLES | OPTIONS
QUERIES |= {f"report_{name}": sql for name, sql in REPORTS.items()}
QUERIES |= {
    f"ranked_{name}": f"SELECT *, row_number() OVER () AS place FROM ({REPORTS[name]})"
    for name in ("slowest_jobs", "worst_stages", "least_efficient_jobs", "least_accelerated")
}
QUERIES |= {
    f"report_chart_{name}": _from(d, f"SELECT {by}, {value} AS value FROM {{r}} GROUP BY {by}")
    for name, (d, by, value) in CHARTS.items()
}
QUERIES |= {
    f"report_scatter_{name}": _from(d, f"SELECT {columns} FROM {{r}}")
    for name, (d, columns) in SCATTERS.items()
}
QUERIES |= {
    f"report_detail_{name}": _from(d, f"SELECT {columns} FROM {{r}}")
    for name, (d, columns) in DETAILS.items()
}
