"""Cluster texts made from the order tables, parsed back and asked about; oracles compute from the tables' own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import cluster
from brindle.sources import lines as ln
from brindle.sources.tables import read


def node_health(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by their lines: state letters, device counts, reasons; what is free, and whether a job fits."""
    line = """concat('NodeName=n', p_partkey, ' Arch=x86 State=', CASE p_size % 6 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'MIXED+PLANNED' WHEN 2 THEN 'ALLOCATED' WHEN 3 THEN 'IDLE+DRAIN' WHEN 4 THEN 'MIXED' ELSE 'UNKNOWN' END,
        CASE WHEN p_size % 7 = 0 THEN ' Reason=bad ecc [root@2024]' WHEN p_size % 7 = 1 THEN ' Reason=slow disk' ELSE '' END, ' Gres=gpu:h100:', p_size % 5, '(S:0-1) GresUsed=gpu:h100:', p_size % 4, '(IDX:0) CfgTRES=cpu=64,mem=', p_size, 'G,gres/gpu=', p_size % 5 + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END,
        ' AllocTRES=cpu=', p_size, ',mem=1000M,gres/gpu=1')"""
    node = read(spark, sf, "part").selectExpr("p_partkey", f"{line} AS line").select("p_partkey", ln.node(F.col("line")).alias("node"))
    free = lambda k: F.coalesce(F.try_element_at("node.cfg", F.lit(k)), F.lit(0)) - F.coalesce(F.try_element_at("node.alloc", F.lit(k)), F.lit(0))
    return node.select("p_partkey", "node.name", F.col("node.reason").alias("reason"), cluster.unhealthy(F.col("node")).alias("unhealthy"), free("cpu").alias("cpus"), free("mem").alias("megabytes"), cluster.fits(F.col("node"), F.lit(40), F.lit(2048), F.lit(1), F.lit("")).alias("fits"))


NODES = """
WITH n AS (SELECT *, CASE p_size % 6 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'MIXED+PLANNED' WHEN 2 THEN 'ALLOCATED' WHEN 3 THEN 'IDLE+DRAIN' WHEN 4 THEN 'MIXED' ELSE 'UNKNOWN' END AS state, CASE p_size % 7 WHEN 0 THEN 'bad ecc' WHEN 1 THEN 'slow disk' ELSE '' END AS reason,
  p_size % 5 AS gres, p_size % 4 AS used, p_size % 5 + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS cfg FROM part),
u AS (SELECT *, CASE WHEN state LIKE '%DRAIN%' THEN 'state ' || state || CASE WHEN reason <> '' THEN ' (' || reason || ')' ELSE '' END WHEN state = 'UNKNOWN' THEN 'state UNKNOWN'
  WHEN gres <> cfg THEN 'GRES mismatch: Gres reports ' || gres || ' gpu, CfgTRES ' || cfg WHEN used > gres THEN 'GRES mismatch: GresUsed ' || used || ' gpu exceeds Gres ' || gres WHEN reason = 'bad ecc' THEN 'reason: bad ecc' ELSE '' END AS unhealthy FROM n)
SELECT p_partkey, 'n' || p_partkey AS name, reason, unhealthy, 64 - p_size AS cpus, p_size * 1024 - 1000 AS megabytes, unhealthy = '' AND (state LIKE 'IDLE%' OR state LIKE 'MIXED%') AND 64 - p_size >= 40 AND p_size * 1024 - 1000 >= 2048 AND cfg - 1 >= 1 AS fits FROM u
"""


def free_devices(spark: SparkSession, sf: str) -> DataFrame:
    """Free devices of partitions by type, from lines between bars, on nodes that take work."""
    line = """concat('p', p_size % 3, CASE WHEN p_size % 3 = 0 THEN '*' ELSE '' END, ' | n', p_partkey, '|', CASE p_size % 5 WHEN 0 THEN 'idle' WHEN 1 THEN 'mixed-' WHEN 2 THEN 'mixed' WHEN 3 THEN 'down*' ELSE 'allocated' END,
        '|gpu:', CASE WHEN p_size % 2 = 0 THEN 'a100:' ELSE '' END, p_size % 9, '(S:0-1)|gpu:', CASE WHEN p_size % 2 = 0 THEN 'a100:' ELSE '' END, p_size % 4, '(IDX:0-3)')"""
    cells = read(spark, sf, "part").selectExpr(f"{line} AS line").select(ln.piped(F.col("line"), 5).alias("c"))
    return cluster.free_devices(cells.select(*[F.col("c")[k].alias(n) for k, n in ((0, "partition"), (2, "state"), (3, "gres"), (4, "used"))]))


FREE = """
SELECT 'p' || p_size % 3 AS partition, CASE WHEN p_size % 2 = 0 THEN 'a100' ELSE 'untyped' END AS type, sum(greatest(0, p_size % 9 - p_size % 4))::BIGINT AS free
FROM part WHERE p_size % 5 IN (0, 2, 4) AND p_size % 9 > p_size % 4 GROUP BY 1, 2
"""


def device_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Devices of each brand from a resource string; the total without a type only where no type is named."""
    line = "concat('cpu=9,gres/gpu=', p_size % 4, CASE WHEN p_size % 3 = 0 THEN concat(',gres/gpu:h200=', p_size, ',gres/gpu:l40s=2') ELSE '' END)"
    found = read(spark, sf, "part").selectExpr("p_brand", f"{line} AS tres").select("p_brand", F.explode(ln.inventory(F.col("tres"))).alias("x"))
    return found.groupBy("p_brand", F.col("x.type").alias("type")).agg(F.sum("x.n").alias("n"))


INVENTORY = """
SELECT p_brand, type, sum(n)::BIGINT AS n FROM (SELECT p_brand, 'h200' AS type, p_size AS n FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_brand, 'l40s', 2 FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_brand, 'untyped', p_size % 4 FROM part WHERE p_size % 3 > 0 AND p_size % 4 > 0) GROUP BY 1, 2
"""


def text_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of texts by section; what stands before the first is of the section _."""
    text = "concat('top ', c_custkey, '\\n@@NAME\\n', c_name, '\\nnation ', c_nationkey, '\\n@@ SEG \\n', c_mktsegment)"
    return ln.sections(read(spark, sf, "customer").selectExpr("c_custkey", f"{text} AS text"), "text")


SECTIONS = """
SELECT c_custkey, section, place, line FROM (SELECT c_custkey, '_' AS section, 0 AS place, 'top ' || c_custkey AS line FROM customer UNION ALL SELECT c_custkey, 'NAME', 0, c_name FROM customer
UNION ALL SELECT c_custkey, 'NAME', 1, 'nation ' || c_nationkey FROM customer UNION ALL SELECT c_custkey, 'SEG', 0, c_mktsegment FROM customer)
"""


def quota_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Quota tables' rows; headings, rulers and other lines are left out."""
    line = "CASE c_custkey % 4 WHEN 0 THEN '---- | --- | - | - | - | - | -' WHEN 1 THEN 'Space | a | b | c | d | e | f' ELSE concat('HOME ', c_custkey, '  |  ', c_nationkey, '.0 | 200.0 | 35.48 | 277.2K | 1.0M | ', c_nationkey) END"
    return read(spark, sf, "customer").selectExpr(f"{line} AS line").select(ln.quota(F.col("line")).alias("q")).where("q is not null").select("q.*")


QUOTA = "SELECT 'HOME ' || c_custkey AS space, c_nationkey || '.0' AS used_gb, '200.0' AS limit_gb, '35.48' AS pct_space, '277.2K' AS files, '1.0M' AS file_limit, c_nationkey::VARCHAR AS pct_files FROM customer WHERE c_custkey % 4 > 1"


def device_processes(spark: SparkSession, sf: str) -> DataFrame:
    """Devices and processes of a node's listings, and how many devices are visible and allocated."""
    rows = read(spark, sf, "supplier").selectExpr(
        "s_suppkey", "concat('GPU 0: A100 (UUID: GPU-', s_suppkey, ')\\nnoise\\nGPU 1: H100') AS smi", "concat(s_suppkey, ', GPU-1, python, x\\nno, GPU-2, y\\n7,GPU-3') AS apps",
        "CASE s_suppkey % 3 WHEN 0 THEN '0,1,' WHEN 1 THEN 'NoDevFiles' END AS visible", "CASE WHEN s_suppkey % 2 = 0 THEN concat('gpu:h100:', s_suppkey % 5) END AS on_node", "CASE WHEN s_suppkey % 5 > 0 THEN '0,1,2' END AS listed",
    )
    apps = F.array_join(F.transform(ln.processes(F.col("apps")), lambda x: F.concat_ws("/", x["pid"].cast("string"), x["gpu"], x["name"])), ";")
    return rows.select("s_suppkey", F.array_join(ln.devices(F.col("smi")), ";").alias("devices"), apps.alias("processes"), ln.visible(F.col("visible")).alias("visible"), ln.allocated(F.col("on_node"), F.col("listed")).alias("allocated"))


PROCESSES = """
SELECT s_suppkey, 'GPU-' || s_suppkey || ';GPU 1: H100' AS devices, s_suppkey || '/GPU-1/python, x;7/GPU-3/' AS processes, CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS visible,
       CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 5)::INTEGER WHEN s_suppkey % 5 > 0 THEN 3 END AS allocated FROM supplier
"""


def mount_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Tier of each mount, by server, else by path, else other."""
    rows = read(spark, sf, "supplier").selectExpr("s_suppkey", "CASE s_suppkey % 4 WHEN 0 THEN 'flash01.local:/x' WHEN 1 THEN 'odd.local:/y' WHEN 2 THEN '' END AS source", "CASE s_suppkey % 3 WHEN 0 THEN '/home/u' WHEN 1 THEN '/data/archive/z' ELSE '/mnt' END AS path")
    return rows.select("s_suppkey", cluster.mount_tier(F.col("source"), F.col("path"), [(r"flash\d", "flash"), ("cap", "capacity")], [("/data/archive/", "archive"), ("/home", "home")]).alias("tier"))


MOUNTS = "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'flash' WHEN s_suppkey % 3 = 0 THEN 'home' WHEN s_suppkey % 3 = 1 THEN 'archive' ELSE 'other' END AS tier FROM supplier"


def project_entitlements(spark: SparkSession, sf: str) -> DataFrame:
    """Projects that users have or lack the groups for."""
    projects = read(spark, sf, "region").selectExpr("r_name AS project", "array(concat('g', r_regionkey), concat('g', r_regionkey + 2)) AS groups")
    held = read(spark, sf, "customer").selectExpr("c_custkey AS user", "array(concat('g', c_nationkey % 7), concat('g', c_custkey % 3)) AS held")
    return cluster.entitlements(projects, held)


ENTITLED = "SELECT c_custkey AS user, r_name AS project, c_nationkey % 7 IN (r_regionkey, r_regionkey + 2) OR c_custkey % 3 IN (r_regionkey, r_regionkey + 2) AS granted FROM customer, region"


def reservation_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """The first reservation that a job would run into: of its partition, or cluster-wide."""
    jobs = read(spark, sf, "orders").selectExpr("o_orderkey AS job", "o_orderpriority AS partition", "cast(o_orderdate AS timestamp) AS now", "(o_orderkey % 40) * 43200 AS seconds")
    held = read(spark, sf, "customer").selectExpr("concat('r', c_custkey) AS reservation", "timestamp_seconds(unix_seconds(timestamp'1996-01-01 00:00:00') + c_custkey * 86400 + 3600) AS starts", "CASE c_nationkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE 'x' END AS partition", "CASE WHEN c_nationkey % 6 = 2 THEN 'MAINT,SPEC' ELSE 'SPEC' END AS flags")
    return cluster.conflicts(jobs, held)


CONFLICTS = """
WITH r AS (SELECT 'r' || c_custkey AS reservation, epoch(TIMESTAMP '1996-01-01 00:00:00')::BIGINT + c_custkey * 86400 + 3600 AS starts, CASE c_nationkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE 'x' END AS covers, c_nationkey % 6 = 2 AS wide FROM customer),
j AS (SELECT o_orderkey AS job, o_orderpriority AS own, epoch(o_orderdate)::BIGINT AS now, (o_orderkey % 40) * 43200 AS seconds FROM orders WHERE o_orderkey % 40 > 0)
SELECT job, reservation, starts - now AS fits FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY starts, reservation) AS k FROM j JOIN r ON starts > now AND starts <= now + seconds AND (wide OR covers = own)) WHERE k = 1
"""


def allocation_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with a job's devices."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_size % 9 > 0 THEN 'j' END AS job", "CASE WHEN p_size % 7 > 0 THEN cast(p_size % 3 AS int) END AS alloc", "CASE WHEN p_size % 4 > 0 THEN cast(p_size % 4 AS int) END AS visible", "CASE WHEN p_size % 5 > 0 THEN array_repeat('d', p_size % 3) END AS listed")
    return rows.select("p_partkey", F.array_join(cluster.problems(rows), "; ").alias("problems"))


PROBLEMS = """
SELECT p_partkey, concat_ws('; ', CASE WHEN p_size % 9 = 0 THEN 'not inside a job' END, CASE WHEN p_size % 7 = 0 THEN 'no allocation' END, CASE WHEN p_size % 5 = 0 AND p_size % 7 > 0 AND p_size % 3 > 0 THEN 'none listed, ' || p_size % 3 || ' allocated' END,
  CASE WHEN p_size % 4 > 0 AND p_size % 7 > 0 AND p_size % 4 <> p_size % 3 THEN p_size % 4 || ' visible, ' || p_size % 3 || ' allocated' END) AS problems FROM part
"""


def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots' paths: added, removed, changed; rendered numbers have a tolerance, whole ones none."""
    parts = read(spark, sf, "part")
    old = parts.where("p_partkey % 10 > 0").selectExpr("concat('node.', p_partkey, CASE WHEN p_size % 11 = 0 THEN '.files' ELSE '' END) AS path", "CASE p_size % 4 WHEN 0 THEN concat(p_size, '.5K') WHEN 1 THEN cast(p_size AS string) WHEN 2 THEN '0.0' ELSE p_brand END AS value")
    new = parts.where("p_partkey % 10 < 9").selectExpr("concat('node.', p_partkey, CASE WHEN p_size % 11 = 0 THEN '.files' ELSE '' END) AS path", "CASE p_size % 4 WHEN 0 THEN concat(p_size, '.8K') WHEN 1 THEN cast(p_size + p_partkey % 2 AS string) WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '0.1' END ELSE CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END END AS value")
    return cluster.snapshot_changes(old, new, [r"\.files$"])


CHANGES = """
WITH o AS (SELECT 'node.' || p_partkey AS path, CASE p_size % 4 WHEN 0 THEN p_size || '.5K' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN '0.0' ELSE p_brand END AS before FROM part WHERE p_partkey % 10 > 0 AND p_size % 11 > 0),
n AS (SELECT 'node.' || p_partkey AS path, CASE p_size % 4 WHEN 0 THEN p_size || '.8K' WHEN 1 THEN (p_size + p_partkey % 2)::VARCHAR WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '0.1' END ELSE CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END END AS after, p_size, p_partkey, p_brand, p_name FROM part WHERE p_partkey % 10 < 9 AND p_size % 11 > 0)
SELECT path, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (path)
WHERE before IS NULL OR after IS NULL OR (p_size % 4 = 0 AND 0.3 / (p_size + 0.8) >= 0.01) OR (p_size % 4 IN (1, 2) AND p_partkey % 2 = 1) OR (p_size % 4 = 3 AND p_partkey % 2 = 1 AND p_brand <> p_name)
"""

QUERIES = {
    "node_health": (node_health, NODES),
    "free_devices": (free_devices, FREE),
    "device_inventory": (device_inventory, INVENTORY),
    "text_sections": (text_sections, SECTIONS),
    "quota_rows": (quota_rows, QUOTA),
    "device_processes": (device_processes, PROCESSES),
    "mount_tiers": (mount_tiers, MOUNTS),
    "project_entitlements": (project_entitlements, ENTITLED),
    "reservation_conflicts": (reservation_conflicts, CONFLICTS),
    "allocation_problems": (allocation_problems, PROBLEMS),
    "snapshot_changes": (snapshot_changes, CHANGES),
}
