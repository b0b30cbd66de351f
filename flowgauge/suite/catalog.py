"""Registered checks of declarations, contracts and passed outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.functions import schedules
from flowgauge.operators import catalog, outputs
from flowgauge.suite.registry import query
from flowgauge.suite.sql_views import FAILURES, texts

_CANONICAL = ("int", "int", "bigint", "bigint", "decimal(10,2)", "decimal(12,0)", "varchar(20)", "array<int>",
              "map<string,bigint>", "struct<a:int,b:array<boolean>>", "timestamp_ntz", "", "", "float",
              "struct<a:int,b:string>", "", "struct<a:int,b:struct<a:int>>", "array<" * 14 + "bigint" + ">" * 14, "", "struct<ab:int,b:int>")
_TYPED = {"v_typed": f"SELECT *, nullif({texts(_CANONICAL)}[pk % {len(_CANONICAL)} + 1], '') AS type FROM v_declarations"}


def typed(v):
    return catalog.canonical_declarations(v.declarations)


@query("d26_canonical_types", "SELECT asset, pipeline, column_name, type FROM v_typed", **_TYPED)
def _(v):
    return typed(v).select("asset", "pipeline", "column_name", "type")


@query("c01_type_conflicts", """
    SELECT asset, column_name, pipeline, type, types FROM v_typed JOIN (
      SELECT asset, column_name, count(DISTINCT type) AS types FROM v_typed GROUP BY 1, 2 HAVING types > 1)
    USING (asset, column_name)""", **_TYPED)
def _(v):
    return catalog.type_conflicts(typed(v))


@query("c02_size_conflicts", """
    SELECT asset, pipeline, columns FROM (SELECT *, min(columns) OVER (PARTITION BY asset) AS a,
      max(columns) OVER (PARTITION BY asset) AS z FROM (
      SELECT asset, pipeline, count(*) AS columns FROM v_declarations GROUP BY 1, 2)) WHERE a < z""")
def _(v):
    return catalog.size_conflicts(v.declarations)


@query("c03_richest_declaration", """
    SELECT asset, pipeline, score FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY score DESC, first_pk) AS n
      FROM (SELECT asset, pipeline, min(pk) AS first_pk, sum(1 + (NOT nullable)::INT + primary_key::INT
        + partition_key::INT + (description <> '')::INT)::BIGINT AS score FROM v_declarations GROUP BY 1, 2)) WHERE n = 1""")
def _(v):
    return catalog.richest_declaration(v.declarations.withColumn("position", F.col("pk")))


@query("c04_duplicate_columns", """
    SELECT p_name AS asset, p_brand AS pipeline, CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE 'C' END || (p_size % 5) AS column_name,
      count(*) AS times FROM part GROUP BY 1, 2, 3 HAVING times > 1""")
def _(v):
    named = v.table("part").selectExpr(
        "p_name AS asset", "p_brand AS pipeline",
        "concat(CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE 'C' END, p_size % 5) AS column_name")
    return catalog.duplicate_columns(named)


@query("c05_schema_drift", """
    SELECT asset, pipeline, column_name, type, actual_type, drift FROM (
      SELECT coalesce(d.asset, x.asset) AS asset, coalesce(d.pipeline, x.pipeline) AS pipeline,
        coalesce(d.column_name, x.column_name) AS column_name, d.type, x.actual_type, CASE
          WHEN x.actual_type IS NULL THEN 'missing' WHEN d.asset IS NULL THEN 'extra'
          WHEN CASE d.type WHEN 'varchar(20)' THEN 'string' ELSE d.type END IS DISTINCT FROM x.actual_type THEN 'type changed'
          WHEN NOT d.nullable THEN 'nullability changed' END AS drift
      FROM v_typed d FULL JOIN (SELECT a.*, f.* FROM (SELECT DISTINCT asset, pipeline FROM v_declarations) a,
        (VALUES ('c0', 'bigint'), ('c1', 'string'), ('c3', 'int'), ('p_name', 'string')) AS f(column_name, actual_type)) x
      ON x.asset = d.asset AND x.pipeline = d.pipeline AND x.column_name = d.column_name) WHERE drift IS NOT NULL""", **_TYPED)
def _(v):
    stored = v.table("part").selectExpr("p_partkey AS c0", "p_type AS c1", "p_size AS c3", "p_name")
    return catalog.schema_drift(typed(v), stored)


@query("c06_contract_violations", """
    SELECT * FROM (
      SELECT 'p_type' AS column_name, 'length' AS rule, count(*) FILTER (length(p_type) > 6) AS violations FROM part
      UNION ALL SELECT 'p_brand', 'byte length', count(*) FILTER (strlen(p_brand) <> 7) FROM part
      UNION ALL SELECT 'p_name', 'unique', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM part GROUP BY p_name HAVING c > 1)
      UNION ALL SELECT 'p_size,p_brand', 'primary key', coalesce(sum(c), 0)::BIGINT FROM (
        SELECT count(*) AS c FROM part GROUP BY p_size, p_brand HAVING c > 1)) WHERE violations > 0""")
def _(v):
    return catalog.contract_violations(v.table("part"), [
        {"name": "p_partkey", "nullable": False, "unique": True}, {"name": "p_type", "max_length": 6},
        {"name": "p_brand", "bytes": 7, "primary_key": False}, {"name": "p_name", "unique": True},
        {"name": "p_size", "primary_key": True}, {"name": "p_brand", "primary_key": True}])


@query("c09_granularity_mismatch", """
    SELECT p_partkey, granularity, inferred FROM (SELECT p_partkey, ['daily', 'hourly', 'weekly'][p_size % 3 + 1] AS granularity,
      ['hourly', 'daily', NULL, 'weekly', 'monthly'][p_partkey % 5 + 1] AS inferred FROM part) WHERE inferred <> granularity""")
def _(v):
    names = ("year,month,day,hour", "y,m,d", "region", "year,week", "year,month")
    columns = F.element_at(F.array(*[F.lit(n) for n in names]), F.expr("cast(p_partkey % 5 AS int) + 1"))
    assets = v.table("part").selectExpr(
        "p_partkey", "element_at(array('daily', 'hourly', 'weekly'), p_size % 3 + 1) AS granularity")
    inferred = schedules.granularity_of_partition_columns(F.split(columns, ","))
    return catalog.granularity_mismatches(assets, inferred)


@query("g27_fingerprint", """
    SELECT run_id AS version, CASE WHEN count(*) = count(DISTINCT t) THEN sha256('[' || string_agg('["' || t || '\\"\\\\é","' || h || '"]', ','
      ORDER BY t, h) || ']') END AS fingerprint, count(*) > count(DISTINCT t) AS repeated FROM (
      SELECT run_id, 't' || (task_no % 6) AS t, sha256('spec ' || pk) AS h FROM v_tasks_all) GROUP BY 1""")
def _(v):
    specs = v.tasks_all.selectExpr(
        "run_id AS version", "concat('t', task_no % 6, chr(34), chr(92), 'é') AS task_id", "sha2(concat('spec ', pk), 256) AS text_hash")
    return catalog.fingerprint(specs)


_RESOLVED = f"""
    SELECT e.run_id, e.task_no, e.upstream_no, CASE WHEN u.run_id IS NULL THEN 'missing'
      WHEN u.status = 'success' OR (u.status = 'skipped' AND u.skip_origin IN ('manual', 'run')) THEN
        CASE WHEN o.run_id IS NULL THEN 'missing' WHEN o.pk % 11 = 0 THEN 'manually_resolved' WHEN o.pk % 13 = 0 THEN 'pointer'
          WHEN o.pk % 17 = 0 THEN 'truncated' ELSE 'value' END
      WHEN u.status IN {FAILURES} THEN 'upstream_failed' ELSE 'missing' END AS outcome, o.result
    FROM v_edges e LEFT JOIN v_tasks u ON u.run_id = e.run_id AND u.task_no = e.upstream_no
    LEFT JOIN v_outputs o ON o.run_id = e.run_id AND o.task_no = e.upstream_no"""


@query("x01_upstream_outputs", f"""
    SELECT run_id, task_no, upstream_no, outcome, CASE WHEN outcome IN ('value', 'pointer') THEN result END AS result
    FROM ({_RESOLVED})""")
def _(v):
    return outputs.resolve_upstream_outputs(v.edges, v.tasks, v.outputs)


@query("j14_output_classes", f"SELECT outcome, count(*) AS pairs FROM ({_RESOLVED}) GROUP BY 1")
def _(v):
    return outputs.resolve_upstream_outputs(v.edges, v.tasks, v.outputs).groupBy("outcome").agg(F.count("*").alias("pairs"))


@query("x02_pointers", """
    SELECT run_id, task_no, 'store://bucket/' || pk || '.json' AS path FROM v_outputs WHERE pk % 11 <> 0 AND pk % 13 = 0""")
def _(v):
    return outputs.pointers(v.outputs).select("run_id", "task_no", "path")


@query("x02_dereferenced", """
    SELECT run_id, task_no, path, p_name AS document FROM (
      SELECT run_id, task_no, 'store://bucket/' || pk || '.json' AS path, pk FROM v_outputs WHERE pk % 11 <> 0 AND pk % 13 = 0)
    LEFT JOIN part ON p_partkey = pk AND p_partkey % 2 = 0""")
def _(v):
    documents = v.table("part").selectExpr(
        "concat('file:///', CASE WHEN p_partkey % 2 = 0 THEN 'bucket' ELSE 'other/bucket' END, '/', p_partkey, '.json') AS path",
        "p_name AS document")
    return outputs.dereference(v.outputs, documents).select("run_id", "task_no", "path", "document")


@query("x03_manual_resolutions", """
    SELECT run_id, task_no, 'skip' AS resolution, 'op' || sk AS operator, 'r' AS reason, run_id::VARCHAR AS marked_run
    FROM v_outputs WHERE pk % 11 = 0""")
def _(v):
    return outputs.manual_resolutions(v.outputs)
