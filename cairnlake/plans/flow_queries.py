"""Quality rules, transport networks, greedy choices, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnlake.operators import graph, greedy, quality, summaries
from cairnlake.operators.scan import Scan, following, total
from cairnlake.plans.checkpoints import cut, use_checkpoint_dir
from cairnlake.plans.find_queries import BAG
from cairnlake.plans.registry import Registry
from cairnlake.sources import io
from cairnlake.streaming import jobs

R = Registry()


def folder(t, name):
    """A folder of its own in the place that the cluster shares."""
    return f"{use_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def counted(rows):
    """Each rule's path and message, how many keys break it, and the least and greatest of them."""
    return rows.groupBy("path", "rule", "message").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("greatest"))


def rules_sql(ctes, path, **rules):
    """The SQL that says the same: for each rule its message and a query of the keys that break it."""
    keys = " UNION ALL ".join(f"SELECT '{name}' AS rule, '{message}' AS message, k::VARCHAR AS k FROM ({query}) q(k)" for name, (message, query) in rules.items())
    return f"{ctes} SELECT '{path}' AS path, rule, message, count(*) AS n, min(k) AS least, max(k) AS greatest FROM ({keys}) GROUP BY ALL"


# --- quality rules, on tables with faults at fixed places

@R.add("j1_index_rules", rules_sql(
    "", "index",
    unique_id=("an id is repeated", "SELECT o_orderkey % 14900 FROM orders GROUP BY 1 HAVING count(*) > 1"),
    unique_url=("a url is repeated", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1"),
    unique_order=("an order is repeated", "SELECT o_totalprice FROM orders GROUP BY 1 HAVING count(*) > 1"),
    default=("the default is missing", "SELECT -1"),
    file_name=("the file is not named by its id", "SELECT o_orderkey % 14900 FROM orders WHERE o_orderkey % 500 = 1"),
))
def j1(t):
    rows = t.orders.select((F.col("o_orderkey") % 14900).alias("id"), F.col("o_custkey").alias("url"), F.col("o_totalprice").alias("ord"), F.concat((F.col("o_orderkey") % 14900).cast("string"), F.when(F.col("o_orderkey") % 500 == 1, ".txt").otherwise(".json")).alias("file"))
    return counted(quality.index_rules(rows, "id", "url", "ord", "-1", "file"))


@R.add("j2_locale_rules", rules_sql(
    """WITH l AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'partial' ELSE 'planned' END AS st, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS cov,
      CASE WHEN c_custkey % 11 = 0 THEN c_custkey WHEN c_custkey % 11 = 1 THEN c_custkey + 1 WHEN c_custkey % 11 = 2 THEN c_custkey - 1 WHEN c_custkey % 11 = 3 THEN -5 END AS fb FROM customer)""", "locales",
    coverage=("coverage does not fit the status",
        "SELECT id FROM l WHERE NOT CASE st WHEN 'available' THEN cov = 1 WHEN 'partial' THEN cov > 0 AND cov < 1 ELSE cov = 0 "
        "END"),
    own_fallback=("a locale falls back to itself", "SELECT id FROM l WHERE fb = id"),
    fallback=("the fallback is not declared", "SELECT id FROM l WHERE fb IS NOT NULL AND fb NOT IN (SELECT id FROM l)"),
    cycle=("fallbacks form a cycle", "SELECT id FROM l WHERE fb = id OR EXISTS (SELECT 1 FROM l m WHERE m.id = l.fb AND m.fb = l.id AND l.fb <> l.id)"),
))
def j2(t):
    k = F.col("c_custkey")
    status = F.when(k % 3 == 0, "available").when(k % 3 == 1, "partial").otherwise("planned")
    cover = F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 0.5).otherwise(0.0)
    back = F.when(k % 11 == 0, k).when(k % 11 == 1, k + 1).when(k % 11 == 2, k - 1).when(k % 11 == 3, F.lit(-5))
    return counted(quality.locale_rules(t.customer.select(k.alias("id"), status.alias("st"), cover.alias("cov"), back.alias("fb")), "id", "st", "cov", "fb"))


@R.add("j2_locale_cycles", rules_sql(
    """WITH l AS (SELECT c_custkey AS id, c_custkey // 50 AS ring, CASE WHEN c_custkey // 50 % 2 = 1 THEN c_custkey - 50 WHEN (c_custkey + 1) // 50 = c_custkey // 50 THEN c_custkey + 1 ELSE c_custkey // 50 * 50 END AS fb FROM customer)""", "locales",
    fallback=("the fallback is not declared", "SELECT id FROM l WHERE fb NOT IN (SELECT id FROM l)"),
    cycle=("fallbacks form a cycle", "SELECT id FROM l WHERE ring % 2 = 0 AND (SELECT count(*) FROM l m WHERE m.ring = l.ring) = 50"),
))
def j2_cycles(t):
    """Fallbacks in rings of fifty locales, and locales that lead into a ring without being part of it."""
    k = F.col("c_custkey")
    ring = F.floor(k / 50)
    back = F.when(ring % 2 == 1, k - 50).when(F.floor((k + 1) / 50) == ring, k + 1).otherwise(ring * 50)
    rows = t.customer.select(k.alias("id"), F.lit("available").alias("st"), F.lit(1.0).alias("cov"), back.alias("fb"))
    return counted(quality.locale_rules(rows, "id", "st", "cov", "fb"))


@R.add("j3_profile_rules", rules_sql(
    """WITH p AS (SELECT p_partkey AS id, p_name || '.' || CASE WHEN p_partkey % 2 = 0 THEN 'PAK' ELSE 'dat' END AS name, p_partkey % 700 AS ord, p_partkey % 3 <> 0 AS enabled,
      CASE WHEN p_partkey % 90 = 0 THEN 'xxx' WHEN p_partkey % 2 = 0 THEN 'pak' ELSE 'dat' END AS kind, p_partkey % 50 = 1 AS excl, p_partkey % 40 = 0 AS conf, CASE WHEN p_partkey % 80 <> 0 THEN p_size END AS v FROM part)""", "profile",
    unique_name=("a name is repeated but for case", "SELECT lower(name) FROM p GROUP BY 1 HAVING count(*) > 1"),
    unique_order=("an order of enabled rows is repeated", "SELECT ord FROM p WHERE enabled GROUP BY 1 HAVING count(*) > 1"),
    kind=("the kind is not the extension", "SELECT id FROM p WHERE kind = 'xxx'"),
    excluded=("an excluded row is enabled", "SELECT id FROM p WHERE excl AND enabled"),
    confirmed=("a confirmed row has nulls", "SELECT id FROM p WHERE conf AND v IS NULL"),
))
def j3(t):
    k = F.col("p_partkey")
    ext = F.when(k % 2 == 0, "pak").otherwise("dat")
    rows = t.part.select(k.alias("id"), F.concat("p_name", F.lit("."), F.when(k % 2 == 0, "PAK").otherwise("dat")).alias("name"), (k % 700).alias("ord"), (k % 3 != 0).alias("enabled"), F.when(k % 90 == 0, "xxx").otherwise(ext).alias("kind"), (k % 50 == 1).alias("excl"), (k % 40 == 0).alias("conf"), F.when(k % 80 != 0, F.col("p_size")).alias("v"))
    return counted(quality.profile_rules(rows, "id", "name", "ord", "enabled", "kind", "excl", "conf", ["v"]))


@R.add("j4_exact_table", rules_sql(
    "", "table",
    missing=("a row is not as pinned", "SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 1"),
    extra=("a row is not as pinned", "SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 2"),
    differs=("a row is not as pinned", "SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 3"),
))
def j4(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    actual = rows.where("o_orderkey % 100 <> 1").withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 == 3, -1).otherwise(F.col("o_custkey")))
    return counted(quality.exact_table(actual, rows.where("o_orderkey % 100 <> 2"), "o_orderkey", ["o_orderstatus", "o_custkey"]))


@R.add("j5_manifest_rules", rules_sql(
    """WITH m AS (SELECT p_partkey AS id, p_size * 10 AS x0, CASE WHEN p_partkey % 20 = 0 THEN p_size * 10 - 10 ELSE p_size * 10 + 100 END AS x1, CASE WHEN p_partkey % 30 = 0 THEN 5 ELSE 0 END AS y0,
      CASE WHEN p_partkey % 40 = 0 THEN -999 ELSE p_size * 10 + 50 END AS cx, p_partkey % 25 = 0 AS bad_res, p_partkey % 2 = 0 AS ready, p_partkey % 60 = 0 AS lacks FROM part)""", "manifest",
    extent=("the extent is not ordered", "SELECT id FROM m WHERE x0 >= x1"), aligned=("the extent is not aligned to cells", "SELECT id FROM m WHERE y0 % 10 <> 0"),
    centre=("the centre is outside", "SELECT id FROM m WHERE NOT cx BETWEEN x0 AND x1"), resolutions=("resolutions do not fall", "SELECT id FROM m WHERE bad_res"),
    ready=("a ready map lacks something", "SELECT id FROM m WHERE ready AND lacks"),
))
def j5(t):
    k, s = F.col("p_partkey"), F.col("p_size") * 10
    rows = t.part.select(k.alias("id"), s.alias("x0"), F.when(k % 20 == 0, s - 10).otherwise(s + 100).alias("x1"), F.when(k % 30 == 0, 5).otherwise(0).alias("y0"), F.lit(200).alias("y1"), F.when(k % 40 == 0, -999).otherwise(s + 50).alias("cx"), F.lit(100).alias("cy"),
                        F.when(k % 25 == 0, F.array(F.lit(4.0), F.lit(4.0))).otherwise(F.array(F.lit(4.0), F.lit(2.0))).alias("res"), (k % 2 == 0).alias("ready"), F.when(k % 60 != 0, 1).alias("need"))
    return counted(quality.manifest_rules(rows, "id", ["x0", "y0", "x1", "y1"], ["cx", "cy"], 10, "res", "ready", ["need"]))


@R.add("j5_manifest_rules_full", rules_sql(
    """WITH m AS (SELECT p_partkey AS id, p_size * 10 AS x0, p_size * 10 + 100 AS x1, p_size * 10 + (p_partkey % 45 = 0)::INT AS ox, 200 - (p_partkey % 35 = 0)::INT AS oy,
      CASE p_partkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'blocked' ELSE 'draft' END AS status, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS blockers, p_partkey % 5 <> 0 AS exact, p_partkey % 4 <> 0 AS confirmed,
      p_partkey % 11 = 0 AS no_tiles, CASE WHEN p_partkey % 13 = 0 THEN 'manual' ELSE 'generated' END AS kind FROM part)""", "manifest",
    origin=("the origin is not the top left corner", "SELECT id FROM m WHERE ox <> x0 OR oy <> 200"),
    blocked=("blocked without a blocker", "SELECT id FROM m WHERE status = 'blocked' AND blockers = 0"),
    unblocked=("blockers although it is not blocked", "SELECT id FROM m WHERE status <> 'blocked' AND blockers > 0"),
    exact=("an exact profile is not confirmed", "SELECT id FROM m WHERE exact AND NOT confirmed"),
    ready_exact=("ready without an exact profile", "SELECT id FROM m WHERE status = 'ready' AND NOT exact"),
    ready=("a ready map lacks something", "SELECT id FROM m WHERE status = 'ready' AND no_tiles"),
    generated=("ready but not generated", "SELECT id FROM m WHERE status = 'ready' AND kind <> 'generated'"),
))
def j5_full(t):
    k, x = F.col("p_partkey"), F.col("p_size") * 10
    status = F.when(k % 3 == 0, "ready").when(k % 3 == 1, "blocked").otherwise("draft")
    rows = t.part.select(
        k.alias("id"), x.alias("x0"), (x + 100).alias("x1"), F.lit(0).alias("y0"), F.lit(200).alias("y1"), (x + 50).alias("cx"), F.lit(100).alias("cy"), F.array(F.lit(4.0), F.lit(2.0)).alias("res"),
        (x + (k % 45 == 0).cast("int")).alias("ox"), (F.lit(200) - (k % 35 == 0).cast("int")).alias("oy"), status.alias("status"), (status == "ready").alias("ready"),
        F.when(k % 7 == 0, 1).otherwise(0).alias("blockers"), (k % 5 != 0).alias("exact"), (k % 4 != 0).alias("confirmed"), F.when(k % 11 != 0, "t").alias("tiles"), F.when(k % 13 == 0, "manual").otherwise("generated").alias("kind"),
    )
    readiness = quality.readiness_rules("status", "blockers", "exact", "confirmed", "kind")
    return counted(quality.manifest_rules(rows, "id", ["x0", "y0", "x1", "y1"], ["cx", "cy"], 10, "res", "ready", ["tiles"], ["ox", "oy"], readiness))


@R.add("j6_catalog_rules", rules_sql(
    """WITH c AS (SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'x.' ELSE 'demo.' END || l_orderkey % 9000 || '-' || l_linenumber AS id, l_extendedprice AS x, l_quantity AS y,
      floor(l_extendedprice / 100)::BIGINT + (l_suppkey % 13 = 0)::INT AS cx, floor(l_quantity / 100)::BIGINT AS cy FROM lineitem)""", "places",
    unique_id=("an id is repeated", "SELECT id FROM c GROUP BY 1 HAVING count(*) > 1"), scope=("an id is out of scope", "SELECT id FROM c WHERE NOT starts_with(id, 'demo.')"),
    cell=("coordinates and cell differ", "SELECT id FROM c WHERE floor(x / 100) <> cx OR floor(y / 100) <> cy"),
))
def j6(t):
    ident = F.concat(F.when(F.col("l_orderkey") % 97 == 0, "x.").otherwise("demo."), (F.col("l_orderkey") % 9000).cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    rows = t.lineitem.select(ident.alias("id"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), (F.floor(F.col("l_extendedprice") / 100) + (F.col("l_suppkey") % 13 == 0).cast("int")).alias("cx"), F.floor(F.col("l_quantity") / 100).alias("cy"))
    return counted(quality.catalog_rules(rows, "id", "demo", "x", "y", "cx", "cy", 100.0))


@R.add("j7_names_rules", rules_sql(
    "", "names",
    aliases=("aliases repeat but for case", "SELECT p_partkey FROM part WHERE p_partkey % 9 IN (0, 3)"), primary=("the name is its own alias", "SELECT p_partkey FROM part WHERE p_partkey % 9 IN (1, 4)"),
    blank=("a name is blank", "SELECT p_partkey FROM part WHERE p_partkey % 9 IN (2, 5)"),
))
def j7(t):
    k = F.col("p_partkey") % 9
    aliases = F.when(k == 0, F.array(F.lit("One"), F.lit("ONE"))).when(k == 1, F.array(F.lit("x"), F.upper("p_name"))).when(k == 2, F.array(F.lit("x"), F.lit("  ")))
    aliases = aliases.when(k == 3, F.array(F.lit("Éa"), F.lit(" éA\u00a0"))).when(k == 4, F.array(F.concat(F.lit("\t"), "p_name"))).when(k == 5, F.array(F.lit("\u2003"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    return counted(quality.names_rules(t.part.select("p_partkey", "p_name", aliases.alias("aliases")), "p_partkey", "p_name", "aliases"))


@R.add("j8_map_asset_rules", rules_sql(
    "", "assets",
    unique_id=("an id is repeated over both lists", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT p_partkey FROM part)"),
    zooms=("zooms are not ordered", "SELECT p_partkey FROM part WHERE p_size > 40"), resolutions=("not one resolution per zoom", "SELECT p_partkey FROM part WHERE 40 - p_size + 1 <> 3"),
))
def j8(t):
    pyramids = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("lo"), F.lit(40).alias("hi"), F.array(F.lit(4), F.lit(2), F.lit(1)).alias("res"))
    return counted(quality.map_asset_rules(t.supplier.select(F.col("s_suppkey").alias("id")), pyramids, "id", "lo", "hi", "res"))


@R.add("j9_coverage_rules", """WITH q AS (SELECT (l_orderkey % 5)::INTEGER + (l_orderkey % 5 = 3)::INTEGER AS z, l_orderkey AS x, l_linenumber * 10 AS lo, l_linenumber * 10 + l_partkey % 11 - 1 AS hi FROM lineitem), s AS (SELECT *, max(hi) OVER (PARTITION BY z, x ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM q),
    f AS (SELECT CASE WHEN lo > hi THEN 'reversed' WHEN lo <= b THEN 'overlap' WHEN lo = b + 1 THEN 'adjacent' END AS rule, 'ranges are not in order' AS message, z || '|' || x || '|' || lo AS k FROM s
      UNION ALL SELECT 'bounds', 'a column is outside', z || '|' || x || '|' || lo FROM q WHERE x >= 14000 UNION ALL SELECT 'zoom', 'a zoom is missing', '3')
    SELECT 'coverage' AS path, rule, message, count(*) AS n, min(k) AS least, max(k) AS greatest FROM f WHERE rule IS NOT NULL GROUP BY ALL""")
def j9(t):
    rows = t.lineitem.select(((F.col("l_orderkey") % 5) + (F.col("l_orderkey") % 5 == 3).cast("int")).cast("int").alias("z"), F.col("l_orderkey").alias("x"), (F.col("l_linenumber") * 10).alias("lo"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 11 - 1).alias("hi"))
    return counted(quality.coverage_rules(rows, "z", "x", "lo", "hi", 0, 4, F.lit(14000)))


@R.add("j9_coverage_identity", """
    WITH q AS (SELECT DISTINCT o_custkey % 40 AS cov, (o_orderkey % 5)::INTEGER AS z, o_orderkey % 60 AS x, o_orderkey // 60 % 50 * 2 AS y FROM orders),
    c AS (SELECT cov, count(*) AS n FROM q GROUP BY cov),
    d AS (SELECT cov, n + (cov % 9 = 0)::INT AS declared, CASE WHEN cov % 10 = 3 THEN 'other' ELSE 'set' END AS dataset, 's' || cov % 2 AS snapshot, CASE WHEN cov % 11 = 5 THEN -1 ELSE cov END AS pyramid FROM c),
    p AS (SELECT cov AS pyramid, n AS tiles, 0 AS lowest, CASE WHEN cov % 8 = 2 THEN 5 ELSE 4 END AS highest FROM c WHERE cov % 11 <> 5),
    b AS (SELECT q.*, ceil(7000.0 / (16.0 * pow(2, p.highest - z) * 8)) AS columns, ceil(9000.0 / (16.0 * pow(2, p.highest - z) * 8)) AS rows FROM q JOIN p ON q.cov = p.pyramid WHERE z BETWEEN p.lowest AND p.highest),
    f AS (SELECT 'dataset' AS rule, 'the dataset is another one' AS message, cov::VARCHAR AS k FROM d WHERE dataset <> 'set'
      UNION ALL SELECT 'snapshot', 'the snapshot is another one', cov::VARCHAR FROM d WHERE snapshot <> 's0'
      UNION ALL SELECT 'pyramid', 'the pyramid is not declared', cov::VARCHAR FROM d WHERE pyramid NOT IN (SELECT pyramid FROM p)
      UNION ALL SELECT 'declared', 'the number of tiles is not that of the ranges', cov::VARCHAR FROM d JOIN c USING (cov) WHERE declared <> n
      UNION ALL SELECT 'integrity', 'the number of tiles is not that of the pyramid', d.cov::VARCHAR FROM d JOIN p USING (pyramid) WHERE declared <> tiles
      UNION ALL SELECT 'zooms', 'the zooms are not those of the pyramid', cov || '|' || z FROM (SELECT cov, unnest(range(lowest, highest + 1)) AS z FROM d JOIN p USING (pyramid) EXCEPT SELECT cov, z FROM q)
      UNION ALL SELECT 'columns', 'a column is outside', cov || '|' || z || '|' || x || '|' || y FROM b WHERE x < 0 OR x >= columns
      UNION ALL SELECT 'rows', 'a row is outside', cov || '|' || z || '|' || x || '|' || y FROM b WHERE y < 0 OR y >= rows)
    SELECT 'coverage' AS path, rule, message, count(*) AS n, min(k) AS least, max(k) AS greatest FROM f GROUP BY ALL""")
def j9_identity(t):
    """Forty coverages of ranges of one tile each, with declared counts, identities and pyramids of which some are wrong."""
    k = F.col("o_orderkey")
    ranges = t.orders.select((F.col("o_custkey") % 40).alias("cov"), (k % 5).cast("int").alias("z"), (k % 60).alias("x"), (F.floor(k / 60) % 50 * 2).alias("low")).distinct().withColumn("high", F.col("low"))
    counts = ranges.groupBy("cov").agg(F.count("*").alias("n"))
    cov = F.col("cov")
    declared = counts.select(cov, (F.col("n") + (cov % 9 == 0).cast("int")).alias("tiles"), F.when(cov % 10 == 3, "other").otherwise("set").alias("dataset"), F.concat(F.lit("s"), cov % 2).alias("snapshot"), F.when(cov % 11 == 5, -1).otherwise(cov).alias("pyramid"))
    pyramids = counts.where("cov % 11 <> 5").select(cov.alias("pyramid"), F.col("n").alias("tiles"), F.lit(0).alias("lowest"), F.when(cov % 8 == 2, 5).otherwise(4).alias("highest"), F.lit(7000.0).alias("width"), F.lit(9000.0).alias("height"), F.lit(16.0).alias("finest"), F.lit(8).alias("tile"))
    return counted(quality.coverage_identity(ranges, declared, pyramids, "cov", {"dataset": "set", "snapshot": "s0"}))


@R.add("j10_backup_rules", rules_sql(
    """WITH b AS (SELECT o_custkey, o_orderdate AS c, o_orderdate + to_days((o_orderkey % 20 - 1)::INT) AS u, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + to_days((o_orderkey % 30)::INT) END AS d, o_orderpriority AS p, o_custkey || '|' || o_orderpriority AS k FROM orders)""", "backup",
    unique=("an identity is repeated", "SELECT k FROM b GROUP BY k HAVING count(*) > 1"), dataset=("the dataset is not declared", "SELECT k FROM b WHERE p NOT IN ('1-URGENT', '2-HIGH', '5-LOW')"),
    times=("updated before it was created", "SELECT k FROM b WHERE c > u"), deleted=("deleted outside its life", "SELECT k FROM b WHERE d IS NOT NULL AND NOT d BETWEEN c AND u"),
))
def j10(t):
    day = lambda c: F.make_dt_interval(c.cast("int"))
    rows = t.orders.select("o_custkey", F.col("o_orderdate").alias("c"), (F.col("o_orderdate") + day(F.col("o_orderkey") % 20 - 1)).alias("u"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate") + day(F.col("o_orderkey") % 30)).alias("d"), F.col("o_orderpriority").alias("p"))
    return counted(quality.backup_rules(rows, ["o_custkey", "p"], ["1-URGENT", "2-HIGH", "5-LOW"], "p", "c", "u", "d"))


def metrics(t, table, key):
    return getattr(t, table).groupBy(F.col(key).cast("string").alias("metric")).agg(F.count("*").alias("value"))


@R.add("j11_expected_counts",
    "WITH a AS (SELECT o_orderpriority AS metric, count(*) AS v FROM orders WHERE o_orderkey % 50 <> 1 AND o_orderpriority "
    "<> '5-LOW' GROUP BY 1), e AS (SELECT o_orderpriority AS metric, count(*) AS v FROM orders GROUP BY 1) SELECT metric, "
    "e.v AS expected, coalesce(a.v, 0) AS actual FROM e LEFT JOIN a USING (metric) WHERE e.v <> coalesce(a.v, 0)")
def j11(t):
    actual = t.orders.where("o_orderkey % 50 <> 1 and o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("value"))
    return quality.expected_counts(actual, metrics(t, "orders", "o_orderpriority"), "metric", "value")


@R.add("j12_reconcile",
    "WITH a AS (SELECT l_returnflag AS metric, count(*) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS metric, "
    "count(*) AS v FROM lineitem WHERE l_quantity <> 7 GROUP BY 1) SELECT metric, a.v AS a, b.v AS b FROM a JOIN b USING "
    "(metric) WHERE a.v <> b.v AND metric <> 'N'")
def j12(t):
    other = t.lineitem.where("l_quantity <> 7").groupBy(F.col("l_returnflag").alias("metric")).agg(F.count("*").alias("value"))
    return quality.reconcile(metrics(t, "lineitem", "l_returnflag"), other, "metric", "value", ["N"])


@R.add("j13_fixed_exceptions",
    "SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'unexpected' ELSE 'stale' END AS state, count(*) AS n FROM supplier WHERE "
    "s_suppkey % 10 IN (0, 2) GROUP BY 1")
def j13(t):
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    found = quality.fixed_exceptions(rows.where("s_suppkey % 10 in (0, 1)"), rows.where("s_suppkey % 10 in (1, 2)"), rows.columns)
    return found.groupBy("state").agg(F.count("*").alias("n"))


@R.add("j15_self_hash", "SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 7")
def j15(t):
    from cairnlake.functions.keys import canonical_json

    fields = ["o_custkey", "o_orderkey", "o_orderstatus"]
    honest = F.sha2(canonical_json(*[F.col(f) for f in fields]), 256)
    rows = t.orders.select(*fields, F.when(F.col("o_orderkey") % 100 == 7, F.reverse(honest)).otherwise(honest).alias("stored"))
    return quality.self_hash_mismatches(rows, "stored", fields).select("o_orderkey")


@R.add("j16_pyramid_matches_manifest",
    "SELECT p_partkey, CASE WHEN p_partkey % 15 = 0 THEN 'resolutions' ELSE 'outside' END AS rule FROM part WHERE p_partkey "
    "% 15 = 0 OR p_partkey % 15 = 4")
def j16(t):
    k = F.col("p_partkey")
    manifest = t.part.select("p_partkey", F.lit(0).alias("x0"), F.lit(100).alias("x1"), F.array(F.lit(4.0), F.lit(2.0)).alias("res"))
    pyramid = t.part.select("p_partkey", F.when(k % 15 == 4, -1).otherwise(5).alias("px0"), F.when(k % 15 == 0, F.array(F.lit(4.0), F.lit(1.0))).otherwise(F.array(F.lit(4.0), F.lit(2.0))).alias("pres"))
    rows = manifest.join(pyramid, "p_partkey")
    return quality.row_rules(rows, "pyramid", "p_partkey", {"outside": (F.col("px0") < F.col("x0"), "the extent is outside"), "resolutions": (F.col("res") != F.col("pres"), "resolutions differ")}).select(F.col("key").cast("long").alias("p_partkey"), "rule")


@R.add("j17_rule_totals",
    "SELECT l_orderkey, have, total FROM (SELECT l_orderkey, count(*) AS have, count(*) + (l_orderkey % 40 = 0)::INT AS "
    "total FROM lineitem GROUP BY 1) WHERE have <> total")
def j17(t):
    counts = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    totals = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("c")).select("l_orderkey", (F.col("c") + (F.col("l_orderkey") % 40 == 0).cast("int")).alias("total"))
    return quality.rule_totals(counts, "l_orderkey", "n", totals, "total").select("l_orderkey", "have", "total")


@R.add("j18_gate_summary",
    "WITH g AS (SELECT event_type AS gate, value < 400 AS ok FROM events), p AS (SELECT gate, bool_and(ok) AS passed, "
    "count(*) FILTER (NOT ok) AS failures FROM g GROUP BY 1) SELECT * FROM p UNION ALL SELECT 'all', bool_and(passed), "
    "sum(failures)::BIGINT FROM p")
def j18(t):
    return quality.gate_summary(t.events.select(F.col("event_type").alias("gate"), (F.col("value") < 400).alias("ok")), "gate", "ok")


INVENTORY = """i AS (SELECT o_orderkey AS ord, (o_orderkey // 2000)::INTEGER AS z, o_orderkey % 2000 - CASE WHEN o_orderkey % 97 = 0 THEN 5 WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END AS x, CASE WHEN o_orderkey % 89 IN (0, 88) THEN 7 ELSE o_custkey END AS y, o_orderkey % 100 = 1 AS odd, o_orderkey % 70 = 3 AS same FROM orders),
    r AS (SELECT *, 'tiles/' || CASE WHEN same THEN '0/0/0' ELSE z || '/' || x || '/' || y END || CASE WHEN odd THEN '.png' ELSE '.webp' END AS path FROM i)"""


@R.add("j19_inventory_rules", f"""WITH {INVENTORY}
    SELECT 'path' AS rule, path AS key FROM r WHERE path <> 'tiles/' || z || '/' || x || '/' || y || '.webp' UNION ALL SELECT 'zoom', path FROM r WHERE NOT z BETWEEN 0 AND 6
    UNION ALL SELECT 'unique_tile', z || '|' || x || '|' || y FROM r GROUP BY z, x, y HAVING count(*) > 1 UNION ALL SELECT 'unique_path', path FROM r GROUP BY path HAVING count(*) > 1
    UNION ALL SELECT 'order', r.path FROM r JOIN r b ON b.ord = r.ord - 1 WHERE NOT (b.z, b.x, b.y) < (r.z, r.x, r.y)""")
def j19(t):
    k = F.col("o_orderkey")
    z, x = F.floor(k / 2000).cast("int"), k % 2000 - F.when(k % 97 == 0, 5).when(k % 89 == 0, 1).otherwise(0)
    rows = t.orders.select(k.alias("ord"), z.alias("z"), x.alias("x"), F.when((k % 89).isin(0, 88), F.lit(7)).otherwise(F.col("o_custkey")).alias("y"))
    place = F.concat_ws("/", F.col("z").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"))
    path = F.concat(F.lit("tiles/"), F.when(F.col("ord") % 70 == 3, "0/0/0").otherwise(place), F.when(F.col("ord") % 100 == 1, ".png").otherwise(".webp"))
    return quality.inventory_rules(rows.withColumn("path", path), "z", "x", "y", "path", "ord", 0, 6, "tiles/").select("rule", "key")


# --- transport networks


SIDES = (
    "d AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey END AS cell, 'n' || s_suppkey % 60 AS name, "
    "CASE s_suppkey % 2 WHEN 0 THEN 'boat' ELSE 'cart' END AS mode, s_acctbal AS x, (s_suppkey * 37 % 5000)::DOUBLE AS y "
    "FROM supplier), p AS (SELECT c_custkey AS q, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey END AS cell, 'n' || c_custkey "
    "% 60 AS name, CASE c_custkey % 2 WHEN 0 THEN 'boat' ELSE 'cart' END AS mode, c_acctbal AS x, (c_custkey * 53 % "
    "5000)::DOUBLE AS y FROM customer)"
)


def sides(t):
    def side(df, k, n, x, m, out):
        key = F.col(k)
        return df.select(key.alias(out), F.when(key % 4 == 0, F.col(n)).alias("cell"), F.concat(F.lit("n"), key % 60).alias("name"), F.when(key % 2 == 0, "boat").otherwise("cart").alias("mode"), F.col(x).alias("x"), (key * m % 5000).cast("double").alias("y"))

    return side(t.supplier, "s_suppkey", "s_nationkey", "s_acctbal", 37, "k"), side(t.customer, "c_custkey", "c_nationkey", "c_acctbal", 53, "q")


MATCH = (
    f"WITH {SIDES}, j AS (SELECT k, q, d.cell AS dc, round(sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)), 3) AS "
    "dist, d.cell = p.cell AS same, d.name = p.name AS named FROM d JOIN p ON d.mode = p.mode AND (d.cell = p.cell OR "
    "(d.cell IS NULL AND p.cell IS NULL AND (d.name = p.name OR sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)) "
    "<= 600)))), b AS (SELECT k, any_value(dc) AS dc, arg_min(q, (dist, q)) AS q, min(dist) AS dist FROM j GROUP BY k)"
)


@R.add("e16_nearest_compatible", MATCH +
    " SELECT d.k, CASE WHEN b.q IS NOT NULL AND (b.dc IS NOT NULL OR dist <= 600) THEN b.q END AS q, CASE WHEN b.q IS NOT "
    "NULL AND (b.dc IS NOT NULL OR dist <= 600) THEN 'matched' ELSE 'none' END AS match FROM d LEFT JOIN b ON b.k = d.k")
def e16(t):
    d, p = sides(t)
    return graph.nearest_compatible(d, p, "k", "q", 600.0).select("k", "q", "match")


@R.add("e15_providers",
    "SELECT c_custkey, o_orderkey AS place, CASE WHEN o_orderkey IS NULL THEN 'no_placement' WHEN c_custkey IN (4, 7) THEN "
    "'excluded' WHEN c_custkey % 6 = 0 THEN 'unclassified' END AS reason FROM customer LEFT JOIN orders ON o_custkey = "
    "c_custkey")
def e15(t):
    actors = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, "x").alias("label"))
    return graph.providers(actors, t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("place")), "c_custkey", [4, 7], "label").select("c_custkey", "place", "reason")


@R.add("e21_reciprocal_edges",
    "WITH r AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b, l_returnflag AS m FROM lineitem), x AS (SELECT r.*, "
    "EXISTS (SELECT 1 FROM r s WHERE s.a = r.b AND s.b = r.a AND s.m = r.m) AS reciprocal FROM r) SELECT a, b, m, reciprocal "
    "FROM x WHERE NOT reciprocal OR a <= b")
def e21(t):
    return graph.reciprocal_edges(t.lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), F.col("l_returnflag").alias("m")), "a", "b", ["m"])


@R.add("i17_service_class",
    "SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN 'boat' WHEN c_nationkey = 3 THEN 'cart' END AS mode, "
    "CASE WHEN lower(c_mktsegment) = 'building' THEN 'river' WHEN c_nationkey = 3 THEN 'road' END AS subtype FROM customer")
def i17(t):
    return graph.service_class(t.customer, [("c_mktsegment", "building", "boat", "river"), ("c_nationkey", "3", "cart", "road")]).select("c_custkey", "mode", "subtype")


@R.add("i18_annotations",
    "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'in debt' END, CASE WHEN c_nationkey < 5 "
    "THEN 'near' END], lambda x: x IS NOT NULL), ';') AS notes FROM customer")
def i18(t):
    rows = graph.annotations(t.customer, [(F.col("c_acctbal") < 0, "in debt"), (F.col("c_nationkey") < 5, "near")])
    return rows.select("c_custkey", F.array_join("notes", ";").alias("notes"))




@R.add("t1_exit_anchor")
def t1(t):
    # about five doors a room, so that the rooms follow the table; the ninth door is the last that the reference opens
    rooms = max(300, t.orders.count() // 5)
    starts = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") % rooms).alias("room"), F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    k = F.col("o_orderkey")
    doors = t.orders.select(F.concat(F.lit("d"), F.lpad(k.cast("string"), 9, "0")).alias("door"), (k % rooms).alias("room"), (k * 17 % 1000).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.when(k % 23 != 0, (k * 7 + 11) % rooms).alias("dest"), (k % 500).cast("double").alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return graph.exit_anchor(starts, doors, "id")


STOPS = (
    "sp AS (SELECT c_custkey AS provider, CASE c_custkey % 3 WHEN 0 THEN 'guild' ELSE 'cart' END AS mode, CASE WHEN "
    "c_custkey % 2 = 0 THEN c_nationkey END AS hall, c_nationkey AS region FROM customer), s AS (SELECT *, "
    "substr(sha256(mode || '|' || CASE WHEN mode = 'guild' AND hall IS NOT NULL THEN 'hall:' || hall ELSE 'at:' || provider "
    "END), 1, 16) AS stop FROM sp)"
)


def stop_rows(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("provider"), k.alias("placement"), F.when(k % 3 == 0, "guild").otherwise("cart").alias("mode"), F.when(k % 2 == 0, F.col("c_nationkey")).alias("hall"), F.col("c_nationkey").alias("region"))


@R.add("t2_stops",
    f"WITH {STOPS} SELECT stop, min(mode) AS mode, min(region) AS region, count(*) AS providers, min(region) NOT IN (SELECT "
    "n_nationkey FROM nation WHERE n_regionkey <> 2) AS external FROM s GROUP BY stop")
def t2(t):
    shown = t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("region"))
    return graph.stops(stop_rows(t), "guild", shown, "region")


def network(t):
    from cairnlake.functions.keys import piped_id

    rows = stop_rows(t)
    place = F.when((F.col("mode") == "guild") & F.col("hall").isNotNull(), F.concat(F.lit("hall:"), F.col("hall").cast("string"))).otherwise(F.concat(F.lit("at:"), F.col("placement").cast("string")))
    stop_of = rows.select("provider", piped_id(F.col("mode"), place).alias("stop"), (F.col("region") % 5 == 2).alias("external"))
    d, p = sides(t)
    matched = graph.nearest_compatible(d, p, "k", "q", 600.0).select(F.col("k").alias("dest"), F.col("q").alias("provider"), "match")
    legs = t.orders.select(F.col("o_custkey").alias("provider"), F.col("o_orderkey").alias("leg"), (F.col("o_orderkey") % 100).alias("dest"))
    return graph.routes(legs, matched, stop_of), matched


NET = MATCH + (
    f", {STOPS}, mt AS (SELECT d.k AS dest, b.q AS p2 FROM d JOIN b ON b.k = d.k WHERE b.dc IS NOT NULL OR dist <= 600), rt "
    "AS (SELECT DISTINCT o_custkey AS provider, o_orderkey AS leg, a.stop AS start, z.stop AS finish FROM orders JOIN mt ON "
    "mt.dest = o_orderkey % 100 JOIN s a ON a.provider = o_custkey JOIN s z ON z.provider = mt.p2 WHERE a.stop <> z.stop AND "
    "NOT (a.region % 5 = 2 AND z.region % 5 = 2))"
)


@R.add("t3_routes", NET + " SELECT provider, leg, start, finish FROM rt")
def t3(t):
    return network(t)[0]


@R.add("t4_network_summary", NET +
    " SELECT (SELECT count(*) FROM rt) AS routes, (SELECT count(DISTINCT v) FROM (SELECT start AS v FROM rt UNION ALL SELECT "
    "finish FROM rt)) AS stops, (SELECT count(*) FROM d) - (SELECT count(*) FROM mt) AS unmatched")
def t4(t):
    return summaries.network_summary(*network(t))


@R.add("t5_exclusions",
    "SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN 'no_placement' WHEN c_custkey IN (4, 7) THEN 'excluded' WHEN "
    "c_custkey % 6 = 0 THEN 'unclassified' END AS reason FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE "
    "o_orderkey IS NULL OR c_custkey IN (4, 7) OR c_custkey % 6 = 0")
def t5(t):
    return summaries.exclusions(e15(t), "c_custkey")


@R.add("t5_exclusion_texts", """
    WITH e AS (SELECT c_name || ': ' || CASE WHEN o_orderkey IS NULL THEN 'no_placement' WHEN c_custkey IN (4, 7) THEN 'excluded' WHEN c_custkey % 6 = 0 THEN 'unclassified' END AS text FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
    SELECT DISTINCT text FROM e WHERE text IS NOT NULL""")
def t5_texts(t):
    named = e15(t).join(t.customer.select("c_custkey", "c_name"), "c_custkey")
    return summaries.exclusion_texts(named, "c_name")


def _links(t):
    """Each order and the next dearer one, numbered."""
    rows = t.orders.select(F.col("o_orderkey").alias("a"), "o_totalprice", F.col("o_orderkey").alias("o"))
    found = Scan(rows, [], ["o_totalprice", "o"]).add(k=total(F.lit(1)), _next=following("a")).rows
    return found.select("a", F.col("_next.a").alias("b"), "k").where("b is not null")


@R.add("s6_chain_places", """
    WITH o AS (SELECT o_orderkey AS node, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k FROM orders),
    p AS (SELECT node, k // 1000 AS c, k FROM o)
    SELECT node, first_value(node) OVER (PARTITION BY c ORDER BY k) AS head, k % 1000 AS n FROM p WHERE c IN (SELECT c FROM p GROUP BY c HAVING count(*) > 1)""")
def s6_places(t):
    """Orders chained by price, each thousandth link cut; contracted until 2,000 links are left."""
    return graph.chain_places(_links(t).where("k % 1000 <> 0"), "a", "b", few=2000)


@R.add("s6_linear_chain", """WITH o AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (ORDER BY o_totalprice, o_orderkey) AS b, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k FROM orders), n AS (SELECT count(*) AS n FROM orders), last AS (SELECT a FROM o WHERE b IS NULL)
    SELECT 'whole' AS chain, 1::BIGINT AS starts, n - 1 AS length, false AS repeated, true AS ends_at_current, true AS ok FROM n
    UNION ALL SELECT 'cut', 2, NULL, false, false, false UNION ALL SELECT 'forked', 1, NULL, true, false, false UNION ALL SELECT 'stale', 1, n - 1, false, false, false FROM n""")
def s6(t):
    """Orders chained by price: as they are, with a link cut out, with one added, and with another end expected."""
    links = cut(_links(t))
    last, n = links.agg(F.max_by("b", "k")).first()[0], links.count()
    edges = links.select("a", "b")
    cases = {"whole": (edges, last), "cut": (links.where(F.col("k") != n // 2).select("a", "b"), last), "forked": (edges.unionByName(links.where("k = 3").select("a", F.lit(last).alias("b"))), last), "stale": (edges, last + 1)}
    same = graph.chain_end(edges, "a", "b")  # of both cases that have these edges
    found = [graph.linear_chain(e, "a", "b", end, found=same if e is edges else None).withColumn("chain", F.lit(name)) for name, (e, end) in cases.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


# --- greedy choices

@R.add("g9_multi_metric_pick")
def g9(t):
    """Lines that share order and number count as one row, as ids must be unique."""
    lines = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    rows = lines.agg(F.min("l_returnflag").alias("l_returnflag"), *[F.max(c).alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount")])
    return greedy.multi_metric_pick(rows, "id", "l_returnflag", ["l_extendedprice", "l_quantity", "l_discount"], F.col("id") % 30011 == 7, 8, 40)


@R.add("g10_union_top",
    "WITH a AS (SELECT p_partkey, p_retailprice, 0 AS o FROM part WHERE p_size < 5 ORDER BY p_retailprice DESC, p_partkey "
    "LIMIT 64), b AS (SELECT p_partkey, p_retailprice, 1 FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 32), u AS "
    "(SELECT *, row_number() OVER (ORDER BY o, p_retailprice DESC, p_partkey) AS r FROM (SELECT * FROM a UNION ALL SELECT * "
    "FROM b)), m AS (SELECT p_partkey, min(r) AS r FROM u GROUP BY 1) SELECT p_partkey, row_number() OVER (ORDER BY "
    "r)::INTEGER AS place FROM m")
def g10(t):
    return greedy.union_top(t.part, F.col("p_size") < 5, 64, 32, "p_retailprice", "p_partkey").select("p_partkey", "place")


@R.add("g11_next_fit_parts")
def g11(t):
    items = t.lineitem.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), (F.col("l_quantity") * 100).cast("long").alias("bytes"))
    return greedy.next_fit_parts(items, "l_suppkey", "o", "bytes", 20_000)


@R.add("f28_asset_fingerprint",
    "WITH r AS (SELECT DISTINCT l_suppkey AS slot, s_nationkey AS asset FROM lineitem JOIN supplier ON s_suppkey = "
    f"l_suppkey), h AS (SELECT sha256('{{\"asset\":' || asset || ',\"slot\":' || slot || '}}') AS h, asset FROM r) SELECT "
    f"{BAG} AS digest, count(*) AS n, count(DISTINCT asset) AS payloads FROM h")
def f28(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("slot")).distinct().join(t.supplier.select(F.col("s_suppkey").alias("slot"), F.col("s_nationkey").alias("asset")), "slot")
    return summaries.asset_fingerprint(rows, "asset")


# --- files

@R.add("a1_scan_record_log",
    "SELECT event_type AS tag, count(*) AS n, sum(length(props))::BIGINT AS bytes, 0::BIGINT AS broken FROM (SELECT upper(substr(event_type || "
    "'____', 1, 4)) AS event_type, props FROM events) GROUP BY 1")
def a1(t):
    return record_log(t).groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload") - 8).cast("long").alias("bytes"), F.count("error").alias("broken"))


def record_log(t):
    """events written as framed records and read again."""
    le = lambda c: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 8, "0"), i, 2) for i in (7, 5, 3, 1)]))
    body = F.concat(F.encode(F.lit("PROP"), "UTF-8"), le(F.octet_length("props")), F.encode("props", "UTF-8"))
    tag = F.upper(F.substring(F.concat("event_type", F.lit("____")), 1, 4))
    frame = F.concat(F.encode(tag, "UTF-8"), le(F.octet_length(body)), le(F.lit(0)), le(F.col("event_id")), body)
    out = folder(t, "records")
    io.write_record_log(t.events.select(frame.alias("frame")).where("frame is not null"), out)
    return io.scan_record_log(t.spark, out).where(F.col("error").isNotNull() | (F.col("tag") != io.FILLER))


@R.add("a2_explode_subrecords", "SELECT 'PROP' AS tag, count(*) AS n, sum(length(props))::BIGINT AS bytes, 0::BIGINT AS broken FROM events")
def a2(t):
    return io.explode_subrecords(record_log(t)).groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).cast("long").alias("bytes"), F.count("error").alias("broken"))


@R.add("a7_strict_ndjson", "SELECT c_custkey, c_mktsegment FROM customer")
def a7(t):
    out = folder(t, "ndjson")
    io.write_canonical_ndjson(t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"], out)
    rows, problems = io.read_strict_ndjson(t.spark, out, "c_custkey long, c_mktsegment string")
    return rows.unionByName(problems.select(F.lit(-1).cast("long").alias("c_custkey"), F.col("problem").alias("c_mktsegment")))


@R.add("a9_canonical_ndjson", "SELECT '{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS value FROM customer")
def a9(t):
    out = folder(t, "ndjson")
    io.write_canonical_ndjson(t.customer.select("c_mktsegment", "c_custkey"), ["c_custkey"], out)
    return t.spark.read.text(out)


FILES = (
    "f AS (SELECT s_nationkey AS nation, string_agg(s_suppkey || '|' || s_name || chr(10), '' ORDER BY s_suppkey) AS body "
    "FROM supplier GROUP BY 1)"
)


def written(t, name):
    """One text file per nation, of its suppliers in order, written by Spark and listed again."""
    out = folder(t, name)
    rows = t.supplier.select(F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name").alias("value"), F.col("s_nationkey").alias("nation"), "s_suppkey")
    rows.repartition("nation").sortWithinPartitions("nation", "s_suppkey").drop("s_suppkey").write.partitionBy("nation").text(out)
    return io.file_inventory(t.spark, out).withColumn("path", F.regexp_extract("path", r"nation=(\d+)/", 1))


@R.add("a8_file_inventory", f"WITH {FILES} SELECT nation::VARCHAR AS path, strlen(body)::BIGINT AS bytes, sha256(body) AS sha256 FROM f")
def a8(t):
    return written(t, "inventory")


@R.add("j14_artifact_integrity",
    "SELECT n_nationkey::VARCHAR AS path, CASE WHEN n_nationkey NOT IN (SELECT s_nationkey FROM supplier) THEN 'missing' "
    "WHEN n_nationkey % 5 = 1 THEN 'bytes' ELSE 'sha256' END AS rule FROM nation WHERE n_nationkey NOT IN (SELECT "
    "s_nationkey FROM supplier) OR n_nationkey % 5 IN (1, 2) UNION ALL SELECT 'x' || n_nationkey, 'missing' FROM nation")
def j14(t):
    """Descriptors worked out from the table, for every nation and for files that do not exist; some with a wrong size or digest."""
    k = F.col("n_nationkey")
    line = F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name")
    lines = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("l")))), lambda x: F.concat(x["l"], F.lit("\n"))).alias("lines"))
    body = F.array_join("lines", "")
    honest = t.nation.join(lines, "n_nationkey", "left").select(
        k.cast("string").alias("path"), (F.coalesce(F.octet_length(body), F.lit(0)) + (k % 5 == 1).cast("int")).cast("long").alias("bytes"),
        F.when(k % 5 == 2, F.sha2(F.concat(body, F.lit("!")), 256)).otherwise(F.sha2(body, 256)).alias("sha256"))
    absent = t.nation.select(F.concat(F.lit("x"), k.cast("string")).alias("path"), F.lit(1).cast("long").alias("bytes"), F.lit("").alias("sha256"))
    return io.artifact_integrity(written(t, "artifacts"), honest.unionByName(absent))


@R.add("a11_publish_immutable", "SELECT count(*) AS n, true AS first, false AS second FROM supplier")
def a11(t):
    root = folder(t, "published")
    target, first = io.publish_immutable(t.supplier, root)
    _, second = io.publish_immutable(t.supplier.repartition(3), root)
    return t.spark.read.parquet(target).agg(F.count("*").alias("n")).withColumn("first", F.lit(first)).withColumn("second", F.lit(second))


@R.add("a13_load_many", "SELECT count(*) FILTER (c_custkey % 20 <> 0) AS good, count(*) FILTER (c_custkey % 20 = 0) AS issues FROM customer")
def a13(t):
    from pyspark.sql.types import LongType, StringType, StructType

    out = folder(t, "manifests")
    line = F.when(F.col("c_custkey") % 20 == 0, F.concat(F.lit('{"id": '), "c_name")).otherwise(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))
    t.customer.select(line.alias("value")).write.text(out)
    good, issues = io.load_many(t.spark, out, StructType().add("id", LongType()).add("name", StringType()))
    return good.agg(F.count("*").alias("good")).crossJoin(issues.agg(F.count("*").alias("issues")))


@R.add("i14_parse_log_markers", "SELECT event_id, event_type AS what, round(value, 2) AS at FROM events".replace(" AS at", ' AS "at"'))
def i14(t):
    lines = t.events.select("event_id", F.concat(F.lit("["), "event_type", F.lit("] at="), F.round("value", 2).cast("string"), F.lit(";")).alias("line"))
    return io.parse_log_markers(lines, "line", r"\[(\w+)\] at=([-0-9.E]+);", ["what", "at"]).select("event_id", "what", F.col("at").cast("double").alias("at"))


@R.add("i14_log_against_plan", """
    WITH e AS (SELECT event_id, user_id, value * 1234.5678 AS x FROM events), said AS (SELECT user_id, event_id, CASE WHEN event_id % 50 = 7 THEN printf('%.5e', x + 1)::DOUBLE ELSE printf('%.5e', x)::DOUBLE END AS s, x FROM e WHERE event_id % 40 <> 9),
    lost AS (SELECT user_id, event_id FROM e WHERE event_id % 40 = 9), wrong AS (SELECT user_id, event_id FROM said WHERE s <> printf('%.5e', x)::DOUBLE)
    SELECT u.user_id, (SELECT count(*) FROM e WHERE e.user_id = u.user_id) AS planned, (SELECT count(*) FROM said WHERE said.user_id = u.user_id) AS found, (SELECT count(*) FROM lost WHERE lost.user_id = u.user_id) AS missing, 0::BIGINT AS unplanned, 0::BIGINT AS repeated,
           (SELECT count(*) FROM wrong WHERE wrong.user_id = u.user_id) AS wrong, (SELECT max(abs(s - x)) FROM said WHERE said.user_id = u.user_id AND s = printf('%.5e', x)::DOUBLE) AS rounding
    FROM (SELECT DISTINCT user_id FROM e) u""")
def i14_plan(t):
    """Lines written with six digits; some say another number, some are missing."""
    x = F.col("value") * 1234.5678
    plan = t.events.select("user_id", "event_id", x.alias("at"))
    told = F.format_string("%.5e", F.when(F.col("event_id") % 50 == 7, x + 1).otherwise(x))
    lines = t.events.where("event_id % 40 <> 9").select(F.concat(F.lit("u="), "user_id", F.lit(" e="), "event_id", F.lit(" at=("), told, F.lit(")")).alias("line"))
    found = io.parse_log_markers(lines, "line", r"u=(-?\d+) e=(-?\d+) at=\((-?\d+(?:\.\d+)?(?:e[+-]?\d+)?)\)", ["user_id", "event_id", "at"])
    return io.check_log_markers(found.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), "at"), plan, "user_id", ["event_id"], ["at"])


# --- streams: the events table read as a file stream, drained

def stream(t, name):
    out = folder(t, name)
    t.events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(f"{out}/in")
    return jobs.file_stream(t.spark, f"{out}/in", t.spark.read.parquet(f"{out}/in").schema), out


@R.add("l1_live_counts", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def l1(t):
    rows, out = stream(t, "live")
    return jobs.drained(jobs.live_counts(rows, "user_id", "event_type", "click"), t.spark, "complete", out)


@R.add("l1_live_counts_update", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def l1_update(t):
    """The same in update mode: each trigger commits the counts that changed."""
    rows, out = stream(t, "changes")
    jobs.live_counts_stream(rows, "user_id", f"{out}/counts", f"{out}/log", "event_type", "click").awaitTermination()
    return jobs.counts_now(t.spark, f"{out}/counts", jobs.live_counts(rows, "user_id").schema)


@R.add("l2_lww_stream",
    "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, "
    "(event_type = 'error')::INT DESC, event_id DESC) = 1")
def l2(t):
    rows, out = stream(t, "lww")
    changes, rule = rows.withColumn("deleted", F.col("event_type") == "error"), (["user_id"], "ts", "deleted", "event_id")
    jobs.lww_stream(changes, *rule, f"{out}/state", f"{out}/log", merge_every=2).awaitTermination()
    return jobs.lww_state(t.spark, f"{out}/state", *rule, changes.schema).select("user_id", "event_id", "event_type")


GUARDED = """WITH e AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'finish' ELSE 'fail' END AS kind, event_id // 2500 AS gen FROM events),
    w AS (SELECT *, max(CASE WHEN kind = 'start' THEN gen * 10000000 + event_id END) OVER p AS s, max(CASE WHEN kind = 'fail' THEN gen * 10000000 + event_id END) OVER p AS f FROM e WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, user_id, gen FROM w WHERE kind = 'finish' AND s // 10000000 = gen AND (f IS NULL OR f < s)"""


def loads(events):
    kind = F.when(F.col("event_id") % 3 == 0, "start").when(F.col("event_id") % 3 == 1, "finish").otherwise("fail")
    return events.select("event_id", "user_id", kind.alias("kind"), F.floor(F.col("event_id") / 2500).alias("gen"))


@R.add("l3_generation_guard", GUARDED)
def l3(t):
    return jobs.generation_guard(loads(t.events), "user_id", ["event_id"], "kind", "gen").select("event_id", "user_id", "gen")


@R.add("l3_generation_guard_stream", GUARDED)
def l3_stream(t):
    """The same over a stream: three triggers, each of many files, one after the other; inside a trigger events come in any order."""
    out = folder(t, "guard")
    first, last = t.events.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.floor((F.col("event_id") - first) * 3 / (last - first + 1))
    for i in range(3):
        loads(t.events.where(part == i)).repartition("user_id").write.mode("append").parquet(f"{out}/in")
        rows = jobs.file_stream(t.spark, f"{out}/in", loads(t.events).schema, files_per_trigger=1_000_000)
        found = jobs.drained(jobs.generation_guard_stream(rows, "user_id", "event_id", "kind", "gen"), t.spark, "append", out)
    return found.select("event_id", "user_id", "gen")


@R.add("l4_resume_incremental", "SELECT event_id FROM events WHERE event_id % 10 <> 0")
def l4(t):
    rows, out = stream(t, "resume")
    done = t.events.where("event_id % 10 = 0").select("event_id")
    rows = rows.select("event_id")
    jobs.resume_incremental(rows, ["event_id"], "plan-1", f"{out}/out", f"{out}/log", done).awaitTermination()
    return jobs.CommitLog(t.spark, f"{out}/out").read(rows.schema).drop("batch")


@R.add("l5_dedupe_stream", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def l5(t):
    rows, out = stream(t, "dedupe")
    twice = rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    kept = jobs.drained(jobs.dedupe_stream(twice, ["event_id"], "ts", "3650 days").select("event_id", "event_type"), t.spark, "append", out)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
