"""SQL for DuckDB that states what the general pipeline queries must give."""

_REL = """CASE WHEN starts_with(ltrim({p}, '/'), trim(m.table_location, '/') || '/')
 THEN ltrim(substr(ltrim({p}, '/'), length(trim(m.table_location, '/')) + 2), '/') ELSE ltrim({p}, '/') END"""


def _rel(column: str) -> str:
    return _REL.format(p=column)


_BASE = f"""
sn AS (SELECT DISTINCT s.table_uuid, s.snapshot_id, s.timestamp_ms, s.sequence_number, {_rel('s.manifest_list')} AS list FROM snapshots s JOIN table_metadata m USING (table_uuid)),
mf AS (SELECT DISTINCT f.table_uuid, {_rel('f.manifest_list')} AS list, {_rel('f.manifest_path')} AS manifest FROM manifest_files f JOIN table_metadata m USING (table_uuid)),
df AS (SELECT f.* EXCLUDE (manifest_path, file_path), {_rel('f.manifest_path')} AS manifest, {_rel('f.file_path')} AS file_path,
 coalesce(f.sequence_number, (SELECT max(x.sequence_number) FROM snapshots x WHERE x.table_uuid = f.table_uuid AND x.snapshot_id = f.snapshot_id)) AS seq FROM data_files f JOIN table_metadata m USING (table_uuid)),
ob AS (SELECT o.table_uuid, {_rel('o.object_path')} AS path, o.event_ms, lower(o.event_type) = 'put' AS is_put, o.size_bytes FROM stored_objects o JOIN table_metadata m USING (table_uuid)),
ol AS (SELECT table_uuid, path, is_put, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY table_uuid, path ORDER BY event_ms DESC, is_put DESC, size_bytes DESC) AS r FROM ob) WHERE r = 1),
le AS (SELECT * FROM df WHERE (table_uuid, manifest) IN (SELECT (mf.table_uuid, mf.manifest) FROM mf JOIN sn ON mf.table_uuid = sn.table_uuid AND mf.list = sn.list JOIN table_metadata m ON m.table_uuid = sn.table_uuid AND m.current_snapshot_id = sn.snapshot_id))
"""

_SMALL = f"""WITH {_BASE},
lf AS (SELECT table_uuid, file_path, max(CASE WHEN partition_values IS NULL OR cardinality(partition_values) = 0 THEN '' ELSE list_sort(map_entries(partition_values))::varchar END) AS part, max(file_size_in_bytes) AS size FROM le GROUP BY ALL),
small AS (SELECT l.table_uuid, l.file_path, l.part FROM lf l JOIN ol o ON o.table_uuid = l.table_uuid AND o.path = l.file_path AND o.is_put WHERE CASE WHEN l.size > 0 THEN l.size ELSE o.size_bytes END < 16777216),
found AS (SELECT table_uuid, file_path FROM (SELECT *, count(*) OVER (PARTITION BY table_uuid, part) AS n FROM small) WHERE n >= 4)
"""

_COLUMNS = "task_id, workflow_id, status, started_at::varchar AS started_at, completed_at::varchar AS completed_at, duration_ms::varchar AS duration_ms, error_message, worker_id"

_EPOCH = "CASE WHEN abs({t}) < 100000000000 THEN {t} * 1000 WHEN abs({t}) < 100000000000000 THEN {t} ELSE {t} // 1000 END"

_WALK = """WITH RECURSIVE node AS (SELECT snapshot_id AS id, min(parent_snapshot_id) AS parent FROM snapshots GROUP BY 1),
link AS (SELECT n.id, p.id AS parent FROM node n LEFT JOIN node p ON n.parent = p.id),
down AS (SELECT id, id AS root, 0 AS depth, id::varchar AS path FROM link WHERE parent IS NULL UNION ALL SELECT l.id, d.root, d.depth + 1, d.path || '/' || l.id FROM link l JOIN down d ON l.parent = d.id)
"""

_BOUNDS = f"""WITH {_BASE},
ex AS (SELECT d.table_uuid, d.file_path, d.seq, d.record_count, k.key::int AS field_id, t.field_type, t.required, t.value_pattern,
 d.value_counts[k.key] AS v, d.null_value_counts[k.key] AS n, d.lower_bounds[k.key] AS lo, d.upper_bounds[k.key] AS hi
 FROM df d JOIN table_metadata m USING (table_uuid), unnest(map_keys(d.value_counts)) AS k(key) JOIN table_fields t ON t.schema_id = m.current_schema_id AND t.field_id = k.key::int),
tx AS (SELECT *, CASE WHEN lo LIKE '{{"t":%' THEN CASE WHEN json_valid(lo) THEN json_extract_string(lo, '$.v') END ELSE lo END AS lt, CASE WHEN hi LIKE '{{"t":%' THEN CASE WHEN json_valid(hi) THEN json_extract_string(hi, '$.v') END ELSE hi END AS ht FROM ex),
ty AS (SELECT *, CASE WHEN field_type = 'int' THEN TRY_CAST(lt AS int)::double WHEN field_type = 'long' THEN TRY_CAST(lt AS bigint)::double WHEN field_type = 'double' AND lower(lt) <> 'nan' THEN TRY_CAST(lt AS double) END AS ln,
 CASE WHEN field_type = 'int' THEN TRY_CAST(ht AS int)::double WHEN field_type = 'long' THEN TRY_CAST(ht AS bigint)::double WHEN field_type = 'double' AND lower(ht) <> 'nan' THEN TRY_CAST(ht AS double) END AS hn FROM tx),
"""

SQL = {
    "p1_found": _SMALL + "SELECT * FROM found",
    "p1_records": _SMALL + f"SELECT DISTINCT t.table_uuid, t.file_path, {_COLUMNS} FROM task_logs t JOIN found USING (table_uuid, file_path)",
    "p1_blocks": _SMALL
    + f""", rec AS (SELECT table_uuid, file_path, count(*) AS n FROM (SELECT DISTINCT t.table_uuid, t.file_path, {_COLUMNS} FROM task_logs t) AS t GROUP BY ALL)
SELECT table_uuid, count(*) AS files, coalesce(sum(n), 0)::bigint AS records, count(*) FILTER (n IS NULL) AS empty_files, true AS well_sized FROM found LEFT JOIN rec USING (table_uuid, file_path) GROUP BY ALL""",
    "p1_files": """SELECT table_uuid, file_path, strlen(content)::int AS bytes, sha256(content) AS sha256 FROM
 (SELECT table_uuid, file_path, string_agg(task_id, chr(10) ORDER BY task_id) || chr(10) AS content FROM (SELECT DISTINCT table_uuid, file_path, task_id FROM task_logs WHERE task_id IS NOT NULL) GROUP BY ALL)""",
    "p2_found": f"""WITH {_BASE},
refs AS (SELECT 'snapshots' AS source_table, table_uuid, list AS ref_path FROM sn UNION SELECT 'manifest_files', table_uuid, manifest FROM mf UNION SELECT 'data_files', table_uuid, file_path FROM df)
SELECT r.* FROM refs r LEFT JOIN ol o ON o.table_uuid = r.table_uuid AND o.path = r.ref_path WHERE r.ref_path <> '' AND NOT coalesce(o.is_put, false)""",
    "p2_report": f"""WITH {_BASE},
st AS (SELECT table_uuid, snapshot_id, max({_EPOCH.format(t='timestamp_ms')}) AS ref_ms FROM sn GROUP BY ALL),
sl AS (SELECT table_uuid, list, min({_EPOCH.format(t='timestamp_ms')}) AS ref_ms FROM sn WHERE list <> '' GROUP BY ALL),
refs AS (SELECT 'snapshots' AS source_table, table_uuid, list AS path, {_EPOCH.format(t='timestamp_ms')} AS ref_ms FROM sn
 UNION SELECT 'manifest_files', mf.table_uuid, manifest, ref_ms FROM mf LEFT JOIN sl ON sl.table_uuid = mf.table_uuid AND sl.list = mf.list
 UNION SELECT 'data_files', df.table_uuid, file_path, ref_ms FROM df LEFT JOIN st ON st.table_uuid = df.table_uuid AND st.snapshot_id = df.snapshot_id),
judged AS (SELECT r.*, o.is_put, o.path IS NULL AS unknown, coalesce((SELECT arg_max(e.is_put, e.event_ms) FROM ob e WHERE e.table_uuid = r.table_uuid AND e.path = r.path AND e.event_ms <= coalesce(r.ref_ms + 3600000, 4611686018427387904)), false) AS was FROM refs r LEFT JOIN ol o ON o.table_uuid = r.table_uuid AND o.path = r.path WHERE r.path <> '')
SELECT source_table, table_uuid, strftime(make_timestamp(ref_ms * 1000), '%Y-%m') AS month, CASE WHEN unknown THEN 'missing' WHEN NOT is_put THEN 'deleted' ELSE 'late' END AS state, count(*) AS n_references
FROM judged WHERE unknown OR NOT is_put OR NOT was GROUP BY ALL""",
    "p3_found": f"""WITH {_BASE},
lf AS (SELECT table_uuid, file_path, max(seq) AS seq FROM le GROUP BY ALL),
ok AS (SELECT DISTINCT r.table_uuid, r.from_sequence_number AS a, coalesce(r.to_sequence_number, s.sequence_number) AS b FROM run_log r LEFT JOIN sn s ON s.table_uuid = r.table_uuid AND s.snapshot_id = r.to_snapshot_id WHERE lower(r.status) = 'success')
SELECT table_uuid, file_path FROM lf WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.table_uuid = lf.table_uuid AND lf.seq > ok.a AND lf.seq <= ok.b)""",
    "p3_run": f"""WITH {_BASE}, rec AS (SELECT DISTINCT table_uuid, file_path, {_COLUMNS} FROM task_logs)
SELECT table_uuid, file_path, count(*) AS records FROM (SELECT DISTINCT table_uuid, file_path FROM df WHERE file_path <> '') JOIN rec USING (table_uuid, file_path) GROUP BY ALL""",
    "p4_found": _BOUNDS
    + """fl AS (SELECT table_uuid, file_path, field_id, min(seq) AS seq, any_value(v) AS v, any_value(n) AS n, bool_or(coalesce(v < 0 OR n < 0 OR n > v OR (required AND n > 0), false) OR coalesce(record_count <> v, false)
 OR (field_type <> 'string' AND ((lo IS NOT NULL AND ln IS NULL) OR (hi IS NOT NULL AND hn IS NULL))) OR coalesce(CASE WHEN field_type = 'string' THEN lt > ht ELSE ln > hn END, false)
 OR coalesce(value_pattern IS NOT NULL AND (NOT regexp_full_match(lt, value_pattern) OR NOT regexp_full_match(ht, value_pattern)), false)) AS bad FROM ty GROUP BY ALL),
pr AS (SELECT *, sum(CASE WHEN n BETWEEN 0 AND v THEN n END) OVER w AS pn, sum(CASE WHEN n BETWEEN 0 AND v THEN v END) OVER w AS pv FROM fl WINDOW w AS (PARTITION BY table_uuid, field_id ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT table_uuid, file_path, field_id FROM pr WHERE bad OR (v >= 100 AND pv >= 500 AND abs(n / v - pn / pv) > 0.4)""",
    "p4_statistics": _BOUNDS
    + """fl AS (SELECT table_uuid, file_path, field_id, min(CASE WHEN n BETWEEN 0 AND v THEN v END) AS v, min(CASE WHEN n BETWEEN 0 AND v THEN n END) AS n, min(ln) AS ln, max(hn) AS hn,
 min(CASE WHEN field_type = 'string' THEN lt END) AS lt, max(CASE WHEN field_type = 'string' THEN ht END) AS ht FROM ty GROUP BY ALL)
SELECT table_uuid, field_id, count(*) AS files, coalesce(sum(v), 0)::bigint AS n_values, coalesce(sum(n), 0)::bigint AS n_nulls, CASE WHEN sum(v) > 0 THEN sum(n) / sum(v) END AS null_rate, min(ln) AS min_number, max(hn) AS max_number, min(lt) AS min_text, max(ht) AS max_text FROM fl GROUP BY ALL""",
    "p4_profile": "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::varchar AS value, {f'{c}::double' if c in ('started_at', 'completed_at', 'duration_ms') else 'NULL::double'} AS number, {f'NOT regexp_full_match({c}, {chr(39)}{p}{chr(39)})' if p else 'false'} AS bad FROM task_logs" for c, p in (("task_id", "task-[0-9]{10}"), ("workflow_id", "wf-[a-z]+-[0-9]{4}"), ("status", ""), ("started_at", ""), ("completed_at", ""), ("duration_ms", ""), ("error_message", ""), ("worker_id", "worker-[0-9]{4}"), ("table_uuid", ""), ("file_path", ""), ("loaded_at", "")))
    + """), g AS (SELECT col, value, any_value(number) AS number, count(*) AS n, any_value(bad) AS bad FROM c GROUP BY col, value)
SELECT col AS "column", sum(n)::bigint AS rows, coalesce(sum(n) FILTER (value IS NULL), 0)::bigint AS nulls, coalesce(sum(n) FILTER (value IS NULL), 0) / sum(n) AS null_rate, count(value) AS distinct_values,
 CASE WHEN max(number) IS NULL THEN min(value) ELSE arg_min(value, number) END AS min_value, CASE WHEN max(number) IS NULL THEN max(value) ELSE arg_max(value, number) END AS max_value, max(n) FILTER (value IS NOT NULL) AS top_count, coalesce(sum(n) FILTER (bad AND value IS NOT NULL), 0)::bigint AS pattern_violations FROM g GROUP BY col""",
    "p4_shares": "WITH m AS (SELECT *, (year(loaded_at) * 12 + month(loaded_at))::bigint AS period FROM task_logs WHERE loaded_at IS NOT NULL), c AS ("
    + " UNION ALL ".join(f"SELECT period, '{c}' AS col, count(*) AS rows, count(*) FILTER ({c} IS NULL) / count(*) AS null_share, {f'count(*) FILTER (NOT regexp_full_match({c}, {chr(39)}{p}{chr(39)})) / count(*)' if p else '0.0::double'} AS bad_share FROM m GROUP BY period" for c, p in (("table_uuid", ""), ("file_path", ""), ("task_id", "task-[0-9]{10}"), ("workflow_id", "wf-[a-z]+-[0-9]{4}"), ("status", ""), ("started_at", ""), ("completed_at", ""), ("duration_ms", ""), ("error_message", ""), ("worker_id", "worker-[0-9]{4}"), ("loaded_at", "")))
    + """) SELECT period, col AS "column", rows, null_share, bad_share, null_share - lag(null_share) OVER w AS null_change, bad_share - lag(bad_share) OVER w AS bad_change FROM c WINDOW w AS (PARTITION BY col ORDER BY period)""",
    "p5_found": _WALK
    + """, lost AS (SELECT l.id FROM link l WHERE l.id NOT IN (SELECT id FROM down)),
walk AS (SELECT id AS origin, id AS here, 0 AS n FROM lost UNION ALL SELECT w.origin, l.parent, w.n + 1 FROM walk w JOIN link l ON l.id = w.here WHERE w.n <= (SELECT count(*) FROM lost)),
far AS (SELECT origin, here FROM walk WHERE n = (SELECT count(*) FROM lost)),
ring AS (SELECT origin AS id, min(here) AS least FROM walk WHERE origin IN (SELECT here FROM far) GROUP BY 1)
SELECT id AS snapshot_id, root AS root_snapshot_id, depth AS link_depth FROM down UNION ALL SELECT f.origin, r.least, -1 FROM far f JOIN ring r ON r.id = f.here""",
    "p5_paths": _WALK + "SELECT id AS snapshot_id, path FROM down",
    "p5_descendants": _WALK
    + """, pairs AS (SELECT id, parent AS above FROM link WHERE parent IS NOT NULL AND id IN (SELECT id FROM down) UNION ALL SELECT p.id, l.parent FROM pairs p JOIN link l ON l.id = p.above WHERE l.parent IS NOT NULL)
SELECT above AS snapshot_id, any_value(root) AS root_snapshot_id, count(*) AS descendants FROM pairs JOIN down ON down.id = above GROUP BY 1""",
}

#: Siblings by id: the list of ids from the root down gives the order in which a walk around the tree enters the snapshots.
SQL["p5_intervals"] = f"""WITH RECURSIVE found AS ({SQL['p5_found']}),
cut AS (SELECT f.snapshot_id AS id, f.root_snapshot_id AS root, n.parent, f.link_depth < 0 AS lost FROM found f JOIN (SELECT snapshot_id, min(parent_snapshot_id) AS parent FROM snapshots GROUP BY 1) n USING (snapshot_id)),
tree AS (SELECT id, root, [id] AS way FROM cut WHERE id = root UNION ALL SELECT c.id, c.root, list_append(t.way, c.id) FROM cut c JOIN tree t ON c.parent = t.id WHERE c.id <> c.root),
below AS (SELECT id, count(*) - 1 AS n FROM (SELECT unnest(way) AS id FROM tree) GROUP BY 1),
placed AS (SELECT id, root, 2 * (row_number() OVER (PARTITION BY root ORDER BY way) - 1) - (len(way) - 1) AS enter, count(*) OVER (PARTITION BY root) - 1 AS others FROM tree),
ring AS (SELECT unnest(t.way) AS id FROM cut c JOIN tree t ON t.id = c.parent WHERE c.id = c.root AND c.lost)
SELECT id AS snapshot_id, root AS root_snapshot_id, enter, enter + 2 * n + 1 AS leave, CASE WHEN id IN (FROM ring) THEN others ELSE n END AS descendants, id IN (FROM ring) AS on_circle FROM placed JOIN below USING (id)"""
