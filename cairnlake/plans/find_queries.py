"""Catalog, classification, identity and search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnlake.functions import keys
from cairnlake.operators import catalog, find, summaries
from cairnlake.plans.checkpoints import use_checkpoint_dir
from cairnlake.plans.grid_queries import P, points
from cairnlake.plans.registry import Registry

R = Registry()
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
PLACES = "places AS (SELECT p_partkey, p_name, p_brand AS type, 'r' || p_size % 5 AS region, p_size % 5 AS min_zoom, p_type FROM part)"
PROGRESS = "prog AS (SELECT user_id AS p_partkey, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1)"


def places(t):
    return t.part.select("p_partkey", "p_name", F.col("p_brand").alias("type"), F.concat(F.lit("r"), F.col("p_size") % 5).alias("region"), (F.col("p_size") % 5).alias("min_zoom"), "p_type")


def progress(t):
    return t.events.groupBy(F.col("user_id").alias("p_partkey")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def joined(t):
    return find.status_or_default(places(t), progress(t), "p_partkey", "status")


J = (
    f"WITH {PLACES}, {PROGRESS}, j AS (SELECT places.*, coalesce(status, 'unvisited') AS status FROM places LEFT JOIN prog "
    "USING (p_partkey))"
)


@R.add("c1_facet_filter", J +
    " SELECT p_partkey FROM j WHERE region = 'r2' AND type IN ('Brand#2', 'Brand#7', 'Brand#11') AND status IN ('unvisited', "
    "'click') AND min_zoom <= 3")
def c1(t):
    return find.facet_filter(joined(t), "r2", ["Brand#2", "Brand#7", "Brand#11"], ["unvisited", "click"], 3).select("p_partkey")


@R.add("c2_status_or_default", J + " SELECT p_partkey, status FROM j")
def c2(t):
    return joined(t).select("p_partkey", "status")


@R.add("c3_available_values",
    "SELECT DISTINCT p_brand AS type, (substr(p_brand, 7)::INTEGER - 1) AS rank FROM part WHERE p_brand IN (SELECT 'Brand#' "
    "|| i FROM range(1, 26) r(i))")
def c3(t):
    return find.available_values(places(t), "type", BRANDS)


REASONS = [("orphan", lambda: F.col("s_suppkey").isNull()), ("cheap", lambda: F.col("l_extendedprice") < 2000), ("returned", lambda: F.col("l_returnflag") == "R"), ("late", lambda: F.col("l_tax") > 0.06)]
C5 = (
    "r AS (SELECT l_orderkey, CASE WHEN s_suppkey IS NULL THEN 'orphan' WHEN l_extendedprice < 2000 THEN 'cheap' WHEN "
    "l_returnflag = 'R' THEN 'returned' WHEN l_tax > 0.06 THEN 'late' END AS reason FROM lineitem LEFT JOIN (SELECT * FROM "
    "supplier WHERE s_suppkey % 11 <> 0) ON s_suppkey = l_suppkey)"
)


def reasoned(t):
    rows = t.lineitem.join(t.supplier.where("s_suppkey % 11 <> 0").select("s_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return catalog.first_failing_reason(rows, [(n, c()) for n, c in REASONS])


@R.add("c5_first_failing_reason",
    f"WITH {C5}, k AS (SELECT * FROM (VALUES (0, 'orphan'), (1, 'cheap'), (2, 'returned'), (3, 'late')) v(ord, reason)), d AS "
    "(SELECT ord, k.reason, (SELECT count(*) FROM r WHERE r.reason = k.reason) AS dropped FROM k) SELECT ord::INTEGER AS "
    "ord, reason, dropped, ((SELECT count(*) FROM r) - sum(dropped) OVER (ORDER BY ord))::BIGINT AS passed FROM d")
def c5(t):
    return catalog.stage_counts(reasoned(t), [n for n, _ in REASONS])


@R.add("c6_fail_on", f"WITH {C5} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM r GROUP BY 1")
def c6(t):
    return catalog.fail_on(reasoned(t), ["never"]).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@R.add("c7_within_extent",
    f"WITH {P} SELECT count(*) FILTER (x BETWEEN -30000 AND 5000 AND y BETWEEN -20000 AND 10000) AS closed, count(*) FILTER "
    "(x >= -30000 AND x < 5000 AND y >= -20000 AND y < 10000) AS half_open, bool_and(x BETWEEN -40000 AND 100000) AS all_in "
    "FROM p")
def c7(t):
    x, y = F.col("x"), F.col("y")
    box = (-30000, -20000, 5000, 10000)
    return points(t).agg(F.count_if(catalog.within_extent(x, y, *box)).alias("closed"), F.count_if(catalog.within_extent(x, y, *box, closed=False)).alias("half_open"), F.bool_and(x.between(-40000, 100000)).alias("all_in"))


@R.add("c8_scope_filter", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def c8(t):
    return catalog.scope_filter(t.customer, t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey").select("c_custkey")


@R.add("c9_visible_edges",
    "SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND (l_suppkey IN "
    "(SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) OR l_partkey IN (SELECT s_suppkey FROM supplier WHERE "
    "s_nationkey = 3))")
def c9(t):
    routes = t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    return find.visible_edges(routes, t.supplier, ["A", "R"], 3, "l_suppkey", "l_partkey", "l_returnflag", "s_suppkey", "s_nationkey")


@R.add("c10_path_safety", """
    WITH p AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '/' || event_type WHEN 1 THEN event_type || '/../x' WHEN 2 THEN event_type || chr(92) || 'x' WHEN 3 THEN 'C:' || event_type WHEN 4 THEN event_type || '/a.EXE' WHEN 5 THEN '.git/' || event_type WHEN 6 THEN '' ELSE 'data/' || event_type || '.json' END AS path FROM events),
    r AS (SELECT CASE WHEN path = '' THEN 'empty' WHEN starts_with(path, '/') THEN 'absolute' WHEN contains(path, chr(92)) THEN 'backslash' WHEN regexp_matches(path, '^[A-Za-z]:') THEN 'drive' WHEN list_contains(string_split(path, '/'), '..') THEN 'dots' WHEN regexp_matches(lower(path), '[.]exe$') THEN 'suffix' WHEN list_contains(string_split(path, '/'), '.git') THEN 'folder' ELSE 'fine' END AS problem FROM p)
    SELECT problem, count(*) AS n FROM r GROUP BY problem""")
def c10(t):
    kind, e = F.col("event_id") % 8, F.col("event_type")
    path = F.when(kind == 0, F.concat(F.lit("/"), e)).when(kind == 1, F.concat(e, F.lit("/../x"))).when(kind == 2, F.concat(e, F.lit("\\x"))).when(kind == 3, F.concat(F.lit("C:"), e)).when(kind == 4, F.concat(e, F.lit("/a.EXE"))).when(kind == 5, F.concat(F.lit(".git/"), e)).when(kind == 6, "").otherwise(F.concat(F.lit("data/"), e, F.lit(".json")))
    return t.events.select(path.alias("path")).groupBy(F.coalesce(keys.path_problem(F.col("path"), (".exe",), (".git",)), F.lit("fine")).alias("problem")).agg(F.count("*").alias("n"))


@R.add("c11_normalize_state", """
    WITH u AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'nowhere' ELSE 'r' || event_id % 4 END AS region, event_id * 3 % 50000 AS place, event_id % 5 AS k, value FROM events),
    s AS (SELECT event_id, pl.region AS pr, CASE WHEN p_partkey IS NOT NULL THEN place::VARCHAR END AS place, u.region AS ur, k, value FROM u LEFT JOIN (SELECT p_partkey, 'r' || p_size % 5 AS region FROM part) pl ON p_partkey = place)
    SELECT event_id, place, coalesce(pr, CASE WHEN ur IN ('r0', 'r1', 'r2', 'r3', 'r4') THEN ur END, 'all') AS region, CASE k WHEN 0 THEN 'cave' WHEN 1 THEN 'cave,ship' ELSE NULL END AS types, CASE WHEN k <> 4 THEN least(greatest(value, 1.0), 20.0) END::DOUBLE AS z FROM s""")
def c11(t):
    k = F.col("event_id") % 5
    types = F.when(k == 0, "cave").when(k == 1, "ship,cave,bogus").when(k == 2, "town,ship,cave").otherwise("bogus")
    region = F.when(F.col("event_id") % 4 == 0, "nowhere").otherwise(F.concat(F.lit("r"), F.col("event_id") % 4))
    z = F.when(k == 4, "Infinity").otherwise(F.col("value").cast("string"))
    url = F.concat(F.lit("https://x.test/?region="), region, F.lit("&place="), F.col("event_id") * 3 % 50000, F.lit("&types="), types, F.lit("&z="), z)
    known = t.part.select(F.col("p_partkey").cast("string").alias("place"), F.concat(F.lit("r"), F.col("p_size") % 5).alias("place_region"))
    found = find.normalize_state(t.events.select("event_id", url.alias("url")), "url", [f"r{i}" for i in range(5)], ["cave", "ship", "town"], known, {"z": (1.0, 20.0)})
    return found.select("event_id", "place", "region", F.array_join("types", ",").alias("types"), "z")


@R.add("f20_facet_counts", J + """, c AS (SELECT 'region' AS axis, 'r' || i AS value, (SELECT count(*) FROM j WHERE region = 'r' || i AND status IN ('unvisited')) AS n FROM range(7) r(i)
    UNION ALL SELECT 'status', v, (SELECT count(*) FROM j WHERE status = v AND region IN ('r1', 'r2')) FROM (VALUES ('unvisited'), ('click'), ('lost')) t(v)) SELECT * FROM c""")
def f20(t):
    return find.facet_counts(joined(t), {"region": [f"r{i}" for i in range(7)], "status": ["unvisited", "click", "lost"]}, {"region": ["r1", "r2"], "status": ["unvisited"]})


@R.add("g1_label_priority", J + " SELECT p_partkey FROM j ORDER BY p_partkey IN (5, 77) DESC, p_name LIKE '%ring%' DESC, type, status, p_partkey LIMIT 20")
def g1(t):
    return find.label_priority(joined(t), F.col("p_partkey").isin(5, 77), F.col("p_name").contains("ring"), ["type", "status"], "p_partkey").select("p_partkey")


FUZZY = """WITH w AS (SELECT p_partkey, p_name, p_type, list_max(list_transform(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''), lambda x: 1.0::DOUBLE - levenshtein(x, 'wigdet') / greatest(length(x), 6)::DOUBLE)) AS a, 1.0::DOUBLE - levenshtein(lower(p_type), 'wigdet') / greatest(length(p_type), 6)::DOUBLE AS b FROM part),
    s AS (SELECT p_partkey, round(least(1.0::DOUBLE - 1.0::DOUBLE * a, 1.0::DOUBLE - 0.25::DOUBLE * b), 6) AS score FROM w)"""


@R.add("i6_weighted_fuzzy", FUZZY + " SELECT p_partkey, score FROM s WHERE score <= 0.4")
def i6(t):
    return find.weighted_fuzzy(t.part, "wigdet", {"p_name": 1.0, "p_type": 0.25}, 0.4).select("p_partkey", "score")


@R.add("g2_top_k_search", FUZZY + " SELECT p_partkey, score FROM s WHERE score <= 0.4 ORDER BY score, p_partkey LIMIT 40")
def g2(t):
    return find.top_k_search(t.part, "wigdet", {"p_name": 1.0, "p_type": 0.25}, "p_partkey", 40, 0.4).select("p_partkey", "score")


@R.add("g3_page", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 20")
def g3(t):
    return find.page(t.events, ["user_id"], ["ts", "event_id"], 10, 2).select("user_id", "event_id")


@R.add("g14_departures", "SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_partkey WHERE l_suppkey = 7")
def g14(t):
    return find.departures(t.lineitem.select("l_suppkey", "l_partkey").distinct(), t.supplier, "l_suppkey", "l_partkey", "s_suppkey", "s_name", 7).select("l_partkey", "s_name")


@R.add("g15_deterministic_order", "SELECT n_nationkey, n_name FROM nation")
def g15(t):
    return summaries.deterministic_order(t.nation, ["n_name"], "n_nationkey").select("n_nationkey", "n_name")


@R.add("e1_resolve_base",
    "SELECT l_returnflag, s_suppkey IS NOT NULL AS matched, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM supplier "
    "WHERE s_suppkey % 3 = 0) ON lower('SUPPLIER#' || lpad(l_suppkey::VARCHAR, 9, '0')) = lower(s_name) GROUP BY ALL")
def e1(t):
    refs = t.lineitem.select("l_returnflag", F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("base"))
    return catalog.resolve(refs, t.supplier.where("s_suppkey % 3 = 0"), "base", "s_name", fold=True).groupBy("l_returnflag", "matched").agg(F.count("*").alias("n"))


@R.add("e2_resolve_destination",
    "SELECT c_mktsegment, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 10 GROUP "
    "BY 1")
def e2(t):
    found = catalog.resolve(t.orders.select("o_custkey"), t.customer, "o_custkey", "c_custkey")
    return found.where("matched and c_nationkey < 10").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@R.add("e3_region_for_grid",
    "SELECT CASE WHEN n_regionkey IS NULL THEN 'no_land' WHEN r_name IS NULL THEN 'no_region' ELSE r_name END AS outcome, "
    "count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 0) ON n_nationkey = c_nationkey "
    "LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = n_regionkey GROUP BY 1")
def e3(t):
    land = t.nation.where("n_nationkey % 6 <> 0").select(F.col("n_nationkey").alias("g"), F.col("n_regionkey").alias("source"))
    regions = t.region.where("r_regionkey <> 2").select(F.col("r_regionkey").alias("source"), F.col("r_name").alias("region"))
    found = catalog.region_for_grid(t.customer.select(F.col("c_nationkey").alias("g")), land, regions, ["g"], "source", "region")
    return found.groupBy(F.coalesce("problem", "region").alias("outcome")).agg(F.count("*").alias("n"))


@R.add("e4_conflicting_groups",
    "SELECT o_custkey, count(DISTINCT o_orderpriority) AS values FROM orders GROUP BY 1 HAVING count(DISTINCT "
    "o_orderpriority) > 1".replace("AS values", 'AS "values"'))
def e4(t):
    return catalog.conflicting_groups(t.orders, ["o_custkey"], "o_orderpriority")


@R.add("e5_localize", """
    WITH p AS (SELECT p_partkey AS k, p_size FROM part WHERE p_partkey % 9 <> 0), n AS (SELECT p_partkey AS k, p_name AS name FROM part WHERE p_partkey % 8 <> 0)
    SELECT coalesce(p.k, n.k) AS k, CASE WHEN p.k IS NULL THEN 'name_without_place' WHEN n.k IS NULL THEN 'place_without_name' END AS problem, CASE WHEN starts_with(name, 'red ') AND coalesce(p_size > 10, false) THEN substr(name, 5) ELSE name END AS label FROM p FULL JOIN n ON p.k = n.k""")
def e5(t):
    p = t.part.where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("k"), "p_size")
    n = t.part.where("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return catalog.localize(p, n, "k", "red ", F.col("p_size") > 10).select("k", "problem", "label")


LOC = (
    "n AS (SELECT p_partkey AS k, 'fr' AS loc, 'fr ' || p_name AS name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT "
    "p_partkey, 'en', p_name FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'xx', 'x' FROM part)"
)


def locales(t):
    row = lambda where, loc, name: t.part.where(where).select(F.col("p_partkey").alias("k"), F.lit(loc).alias("loc"), name.alias("name"))
    return row("p_partkey % 3 = 0", "fr", F.concat(F.lit("fr "), "p_name")).unionByName(row("p_partkey % 5 <> 0", "en", F.col("p_name"))).unionByName(row("true", "xx", F.lit("x")))


@R.add("e6_fallback_chain",
    f"WITH {LOC} SELECT p_partkey AS k, coalesce(f.name, e.name) AS name, coalesce(f.loc, e.loc) AS used FROM part LEFT JOIN "
    "n f ON f.k = p_partkey AND f.loc = 'fr' LEFT JOIN n e ON e.k = p_partkey AND e.loc = 'en'")
def e6(t):
    return catalog.fallback_chain(t.part.select(F.col("p_partkey").alias("k")), locales(t), "k", "loc", ["fr", "en"]).select("k", "name", "used")


@R.add("e6_incomplete_locales",
    f"WITH {LOC} SELECT loc, (SELECT count(*) FROM part) - count(DISTINCT k) AS missing FROM n GROUP BY loc HAVING (SELECT "
    "count(*) FROM part) > count(DISTINCT k)")
def e6b(t):
    return catalog.incomplete_locales(t.part.select(F.col("p_partkey").alias("k")), locales(t), "k", "loc")


@R.add("e17_nearest_named", """
    WITH s AS (SELECT s_suppkey, s_nationkey, 'red widget' AS nm, s_acctbal AS x FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_nationkey, 'Small Ring', s_acctbal FROM supplier WHERE s_suppkey % 2 = 1),
    p AS (SELECT p_partkey, p_size % 25 AS reg, lower(p_name) AS nm, p_retailprice AS x FROM part)
    SELECT s_suppkey, arg_min(p_partkey, (round(abs(s.x - p.x), 3), p_partkey)) AS nearest FROM s LEFT JOIN p ON reg = s_nationkey AND p.nm = lower(s.nm) GROUP BY s_suppkey""")
def e17(t):
    from cairnlake.operators.graph import nearest_named

    stops = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("reg"), F.when(F.col("s_suppkey") % 2 == 0, "red widget").otherwise("Small Ring").alias("nm"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    named = t.part.select("p_partkey", (F.col("p_size") % 25).alias("reg"), F.array("p_name").alias("names"), F.col("p_retailprice").alias("x"), F.lit(0.0).alias("y"))
    return nearest_named(stops, named, "s_suppkey", "p_partkey", "reg", "nm", "names").select("s_suppkey", F.col("p_partkey").alias("nearest"))


NAMES = (
    "ext AS (SELECT DISTINCT p_size % 5 AS region, split_part(p_name, ' ', 1) AS name FROM part), inn AS (SELECT DISTINCT "
    "p_size % 5 AS region, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', ', ') WHEN 2 THEN "
    "replace(p_name, ' ', ': ') ELSE split_part(p_name, ' ', 1) || ' Hall' END AS name FROM part)"
)


def names(t):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    kind = F.col("p_partkey") % 4
    inner = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.replace("p_name", F.lit(" "), F.lit(", "))).when(kind == 2, F.replace("p_name", F.lit(" "), F.lit(": "))).otherwise(F.concat(first, F.lit(" Hall")))
    region = (F.col("p_size") % 5).alias("region")
    return t.part.select(region, first.alias("name")).distinct(), t.part.select(region, inner.alias("name")).distinct()


@R.add("e18_related_by_prefix",
    f"WITH {NAMES} SELECT e.region, e.name AS outer_name, i.name AS inner_name FROM ext e JOIN inn i ON e.region = i.region "
    "AND (lower(i.name) = lower(e.name) OR starts_with(lower(i.name), lower(e.name) || ',') OR starts_with(lower(i.name), "
    "lower(e.name) || ':') OR lower(i.name) = lower(e.name) || ' hall')")
def e18(t):
    outer, inner = names(t)
    return catalog.related_by_prefix(outer, inner, "name", "region", ("hall",))


RULES = [(r"\bring\b", "jewel"), (r"^red", "red thing"), (r"widget|bolt", "part")]
I1 = (
    "CASE WHEN regexp_matches(lower(p_name), '\\bring\\b') THEN 1 WHEN regexp_matches(lower(p_name), '^red') THEN 2 WHEN "
    "regexp_matches(lower(p_name), 'widget|bolt') THEN 3 ELSE 0 END AS rule"
)


@R.add("i1_classify_by_rules",
    "SELECT p_partkey, rule::INTEGER AS rule, ['other', 'jewel', 'red thing', 'part'][rule + 1] AS label FROM (SELECT "
    f"p_partkey, {I1} FROM part)")
def i1(t):
    return catalog.classify_by_rules(t.part, "p_name", RULES, "other").select("p_partkey", "rule", "label")


@R.add("i2_classify_with_evidence",
    "SELECT p_partkey, CASE WHEN rule > 0 THEN ['jewel', 'red thing', 'part'][rule] WHEN p_type = 'ECONOMY' THEN 'ship' WHEN "
    f"p_brand LIKE '%2%' THEN 'cave' ELSE 'place' END AS label FROM (SELECT *, {I1} FROM part)")
def i2(t):
    rows = t.part.withColumn("evidence", F.array("p_type", "p_brand"))
    return catalog.classify_with_evidence(rows, "p_name", "evidence", RULES, [("^economy$", "ship"), ("2", "cave")], "place").select("p_partkey", "label")


@R.add("i3_classify_by_neighbors", """
    WITH r AS (SELECT o_custkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'house' WHEN 1 THEN 'cave' WHEN 2 THEN 'tomb' ELSE 'place' END AS label FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey % 9 IN (1, 3, 4)),
    s AS (SELECT k, count(*) FILTER (label = 'house') AS h, count(DISTINCT label) FILTER (label NOT IN ('place', 'house')) AS d, min(label) FILTER (label NOT IN ('place', 'house')) AS l, count(*) FILTER (label NOT IN ('place', 'house')) AS c, count(*) AS n FROM r GROUP BY k)
    SELECT c_custkey, CASE WHEN h > 0 THEN 'settlement' WHEN d = 1 AND (l <> 'cave' OR 2 * c >= n) THEN l ELSE 'place' END AS label FROM customer LEFT JOIN s ON k = c_custkey""")
def i3(t):
    kind = F.col("o_orderkey") % 9
    related = t.orders.where((F.col("o_custkey") % 2 == 0) | kind.isin(1, 3, 4)).select(F.col("o_custkey").alias("c_custkey"), F.when(kind == 0, "house").when(kind == 1, "cave").when(kind == 2, "tomb").otherwise("place").alias("label"))
    return catalog.classify_by_neighbors(t.customer.select("c_custkey"), related, "c_custkey", "label", ["house"], "place", "cave")


@R.add("i4_civic_prefixes",
    f"WITH {NAMES} SELECT DISTINCT split_part(i.name, ',', 1) AS prefix FROM inn i WHERE contains(i.name, ',') AND "
    "regexp_matches(lower(i.name), '\\b(ring|widget)$') AND split_part(i.name, ',', 1) IN (SELECT name FROM ext)")
def i4(t):
    outer, inner = names(t)
    return catalog.civic_prefixes(inner.where(F.col("name").contains(",")), "name", outer, "name", ["ring", "widget"])


@R.add("i5_tier_by_type",
    "SELECT p_type, min(CASE p_type WHEN 'ECONOMY' THEN 2 WHEN 'STANDARD' THEN 3 ELSE 4 END)::INTEGER AS tier FROM part "
    "GROUP BY p_type")
def i5(t):
    return t.part.groupBy("p_type").agg(F.min(catalog.tier_by_type(F.col("p_type"), {"ECONOMY": 2, "STANDARD": 3}, 4)).alias("tier"))


@R.add("i7_stable_id",
    "SELECT p_partkey, 'demo.place-' || substr(sha256('[\"' || p_brand || '\",\"' || p_partkey || '\"]'), 1, 20) AS id, "
    "substr(sha256(p_brand || '|' || p_partkey), 1, 16) AS short FROM part")
def i7(t):
    return t.part.select("p_partkey", keys.stable_id("demo", "place", F.col("p_brand"), F.col("p_partkey")).alias("id"), keys.piped_id(F.col("p_brand"), F.col("p_partkey").cast("string")).alias("short"))


#: The digest of a bag of rows from their SHA-256 in column h: eight sums of 32-bit numbers, and the number of rows.
BAG = "sha256(concat_ws(',', " + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)" for i in range(8)) + ", count(*)))"


@R.add("i8_set_digest", f"""
    WITH r AS (SELECT sha256('{{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}}') AS h FROM orders)
    SELECT {BAG} AS digest, count(*) AS n FROM r""")
def i8(t):
    from cairnlake.operators.quality import set_digest

    return set_digest(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))


LEAVES = """l0 AS (SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS node, sha256('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}') AS h FROM orders)"""
UP = ", l{b} AS (SELECT node // 64 AS node, CASE WHEN (SELECT count(*) FROM l{a}) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY node)) END AS h FROM l{a} GROUP BY 1)"


def _numbered(t, status):
    return t.orders.select("o_orderpriority", F.col("o_orderkey").alias("k"), status.alias("s"))


@R.add("i8_ordered_digest", f"WITH {LEAVES}" + "".join(UP.format(a=i, b=i + 1) for i in range(5)) + """
    , n AS (SELECT count(*) AS n FROM orders)
    SELECT h AS digest, n, CASE WHEN n <= 1 THEN 0 WHEN n <= 64 THEN 1 WHEN n <= 4096 THEN 2 WHEN n <= 262144 THEN 3 WHEN n <= 16777216 THEN 4 ELSE 5 END::INTEGER AS levels FROM l5, n""")
def i8_ordered(t):
    from cairnlake.operators.merkle import ordered_digest

    return ordered_digest(_numbered(t, F.col("o_orderstatus")), ["o_orderpriority", "k"], ["k", "s"])


@R.add("i8_changed_ranges", """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS node FROM orders), c AS (SELECT node FROM r WHERE o_orderkey % 97 < 2),
    g AS (SELECT node, node - row_number() OVER (ORDER BY node) AS g FROM c)
    SELECT min(node) AS first, max(node) AS last, count(*) AS n FROM g GROUP BY g""")
def i8_changed(t):
    """A snapshot against one in which some orders have another status."""
    from cairnlake.operators.merkle import changed_ranges, tree

    changed = F.when(F.col("o_orderkey") % 97 < 2, F.lit("X")).otherwise(F.col("o_orderstatus"))
    return changed_ranges(*[tree(_numbered(t, status), ["o_orderpriority", "k"], ["k", "s"]) for status in (F.col("o_orderstatus"), changed)])


@R.add("i9_canonical_json", "SELECT o_orderkey, '{\"k\":' || o_orderkey || ',\"n\":null,\"s\":\"' || o_orderstatus || '\"}' AS line FROM orders")
def i9(t):
    return t.orders.select("o_orderkey", keys.canonical_json(F.col("o_orderkey").alias("k"), F.lit(None).cast("string").alias("n"), F.col("o_orderstatus").alias("s")).alias("line"))


@R.add("i10_normalize_path", """
    WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'A' || chr(92) || './B//' || page_id WHEN 1 THEN '/x' WHEN 2 THEN 'x/../y' WHEN 3 THEN 'D:/x' ELSE 'Meshes/ÄB.obj' END AS raw FROM pages)
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/b/' || page_id WHEN 4 THEN 'meshes/Äb.obj' END AS path, CASE page_id % 5 WHEN 1 THEN 'absolute' WHEN 2 THEN 'parent' WHEN 3 THEN 'drive' END AS error FROM p""")
def i10(t):
    k = F.col("page_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("A\\./B//"), F.col("page_id"))).when(k == 1, "/x").when(k == 2, "x/../y").when(k == 3, "D:/x").otherwise("Meshes/ÄB.obj")
    return t.pages.select("page_id", keys.normalize_path(raw).alias("p")).select("page_id", "p.path", "p.error")


@R.add("i11_strip_prefix", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'red ') THEN substr(p_name, 5) ELSE p_name END AS label FROM part")
def i11(t):
    return t.part.select("p_partkey", keys.strip_prefix(F.col("p_name"), "red ").alias("label"))


@R.add("i13_hex_ref", "SELECT o_orderkey, '0x' || lpad(lower(to_hex(o_orderkey * 77)), 8, '0') AS ref FROM orders")
def i13(t):
    return t.orders.select("o_orderkey", keys.hex_ref(F.col("o_orderkey") * 77).alias("ref"))


@R.add("i15_log_findings", """
    WITH l AS (SELECT event_id, user_id, event_type || CASE event_id % 6 WHEN 0 THEN ' ERROR: disk' WHEN 1 THEN ' error: benign cache' ELSE ' done' END AS line FROM events)
    SELECT user_id, count(*) FILTER (regexp_matches(lower(line), 'error:') AND NOT contains(line, 'benign')) AS failures, count(*) FILTER (regexp_matches(lower(line), 'error:') AND contains(line, 'benign')) AS benign FROM l GROUP BY user_id""")
def i15(t):
    from cairnlake.operators.quality import log_findings

    k = F.col("event_id") % 6
    lines = t.events.select(F.col("user_id").alias("log"), F.concat("event_type", F.when(k == 0, " ERROR: disk").when(k == 1, " error: benign cache").otherwise(" done")).alias("line"))
    expected = t.events.select(F.col("user_id").alias("log")).distinct()
    return log_findings(lines, expected, "log", "line", "(?i)error:", "benign").select(F.col("log").alias("user_id"), "failures", "benign")


@R.add("i19_identifier_ok", "SELECT event_id % 7 AS form, event_id % 7 < 4 AS ok, count(*) AS n FROM events GROUP BY ALL")
def i19(t):
    """Ids with dots, colons and dashes are fine; capitals, other scopes and doubled or closing marks are not."""
    k, word = F.col("event_id") % 7, F.replace("event_type", F.lit("_"), F.lit("-"))
    forms = [F.concat(F.lit("demo."), word), F.concat(F.lit("demo."), word, F.lit(":"), F.col("event_id").cast("string")), F.concat(F.lit("demo.a-b:c."), word), F.concat(F.lit("demo."), word, F.lit("-1")), F.concat(F.lit("Demo."), word), F.concat(F.lit("other."), word), F.concat(F.lit("demo.:"), word)]
    name = F.element_at(F.array(*forms), (k + 1).cast("int"))
    return t.events.select(k.alias("form"), keys.identifier_ok(name, "demo").alias("ok")).groupBy("form", "ok").agg(F.count("*").alias("n"))


@R.add("f1_catalog_counts",
    "SELECT CASE WHEN grouping(region) = 0 THEN 'region' WHEN grouping(p_type) = 0 THEN 'type' ELSE 'total' END AS axis, "
    "coalesce(region, p_type, '') AS value, count(*) AS n FROM (SELECT 'r' || p_size % 5 AS region, p_type FROM part) GROUP "
    "BY GROUPING SETS ((), (region), (p_type))")
def f1(t):
    return summaries.catalog_counts(places(t), {"region": "region", "type": "p_type"})


@R.add("f2_size_histogram", "SELECT n AS size, count(*) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def f2(t):
    return summaries.size_histogram(t.orders, "o_custkey")


NESTED = (
    "WITH n AS (SELECT c_custkey AS id, list({'o': o_orderkey, 'p': o_totalprice}) FILTER (o_orderkey IS NOT NULL) AS "
    "entrances FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"
)


def nested(t):
    children = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("p"))
    return summaries.nested_catalog(t.customer.select(F.col("c_custkey").alias("id")), children, "id", ["o", "p"], "entrances")


@R.add("f3_artifact_metrics", NESTED +
    " SELECT count(*) AS places, count(*) FILTER (entrances IS NOT NULL) AS interiors, sum(coalesce(len(entrances), "
    "0))::BIGINT AS entrances, max(coalesce(len(entrances), 0))::BIGINT AS most FROM n")
def f3(t):
    return summaries.artifact_metrics(nested(t), "entrances")


@R.add("a10_nested_catalog", """SELECT '{"entrances":[' || coalesce(string_agg('{"o":' || o_orderkey || ',"p":' || o_totalprice || '}', ',' ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL), '') || '],"id":' || c_custkey || '}' AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def a10(t):
    """Written as one JSON object a line, in order, and read again as text."""
    out = f"{use_checkpoint_dir(t.spark)}/catalog-{uuid.uuid4().hex}"
    summaries.write_nested_catalog(nested(t), ["id"], out)
    return t.spark.read.text(out).select("value")


@R.add("a12_explode_catalog",
    "SELECT c_custkey AS id, o_orderkey AS entrance, o_totalprice AS price FROM customer LEFT JOIN orders ON o_custkey = "
    "c_custkey")
def a12(t):
    out = f"{use_checkpoint_dir(t.spark)}/catalog-{uuid.uuid4().hex}"
    summaries.write_nested_catalog(nested(t), ["id"], out)
    rows, _ = summaries.explode_catalog(t.spark, out, nested(t).schema, "entrances")
    return rows.select("id", F.col("o").alias("entrance"), F.col("p").alias("price"))


CELLS = f"{P}, c AS (SELECT DISTINCT l_partkey, floor(x / 8192.0)::BIGINT AS cx, floor(y / 8192.0)::BIGINT AS cy FROM p)"


def bucket_cells(t):
    from cairnlake.functions.grid import world_to_cell

    return points(t).select("l_partkey", world_to_cell(F.col("x"), 8192.0).alias("cx"), world_to_cell(F.col("y"), 8192.0).alias("cy")).distinct()


@R.add("f4_chebyshev_span",
    f"WITH {CELLS} SELECT l_partkey, greatest(max(cx) - min(cx), max(cy) - min(cy)) AS span, count(*) AS cells FROM c GROUP "
    "BY 1 HAVING greatest(max(cx) - min(cx), max(cy) - min(cy)) > 1")
def f4(t):
    return summaries.chebyshev_span(bucket_cells(t), "l_partkey", "cx", "cy")


@R.add("f5_split_names",
    "SELECT p_name, count(*) AS n, array_to_string(list_sort(list(p_partkey)), ',') AS ids FROM part GROUP BY p_name HAVING "
    "count(*) > 1")
def f5(t):
    return summaries.split_names(t.part, "p_name", "p_partkey").withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@R.add("f6_medoid",
    f"WITH {P}, s AS (SELECT a.l_orderkey, a.l_linenumber, round(sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - "
    "b.y))), 3) AS total FROM p a JOIN p b USING (l_orderkey) GROUP BY a.l_orderkey, a.l_linenumber) SELECT l_orderkey, "
    "l_linenumber AS medoid, total FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY total, l_linenumber) = "
    "1")
def f6(t):
    return catalog.medoid(points(t), "l_orderkey", "x", "y", "l_linenumber")


@R.add("f7_central_member",
    f"WITH {CELLS}, m AS (SELECT l_partkey, avg(cx) AS mx, avg(cy) AS my FROM c GROUP BY 1), d AS (SELECT c.*, round((cx - "
    "mx) * (cx - mx) + (cy - my) * (cy - my), 6) AS d FROM c JOIN m USING (l_partkey)) SELECT l_partkey, cx AS central_x, cy "
    "AS central_y FROM d QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY d, cx, cy) = 1")
def f7(t):
    return catalog.central_member(bucket_cells(t), ["l_partkey"], "cx", "cy")


F8 = f"""WITH RECURSIVE {CELLS}, n AS (SELECT *, row_number() OVER (ORDER BY l_partkey, cx, cy) AS id FROM c), e AS (SELECT a.id AS u, b.id AS v FROM n a JOIN n b ON a.l_partkey = b.l_partkey AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1),
    r AS (SELECT id, id AS seen FROM n UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.seen), k AS (SELECT id, min(seen) AS a FROM r GROUP BY id)"""


@R.add("f8_components8", F8 + " SELECT n.l_partkey, n.cx, n.cy, m.cx AS anchor_x, m.cy AS anchor_y FROM k JOIN n USING (id) JOIN n m ON m.id = k.a")
def f8(t):
    return catalog.components8(bucket_cells(t), "l_partkey", "cx", "cy")


@R.add("f9_component_sizes", F8 +
    ", s AS (SELECT l_partkey, a, count(*) AS n FROM k JOIN n USING (id) GROUP BY ALL) SELECT l_partkey, count(*) AS "
    "components, max(n) AS largest FROM s GROUP BY 1")
def f9(t):
    sizes = catalog.components8(bucket_cells(t), "l_partkey", "cx", "cy").groupBy("l_partkey", "anchor_x", "anchor_y").agg(F.count("*").alias("n"))
    return sizes.groupBy("l_partkey").agg(F.count("*").alias("components"), F.max("n").alias("largest"))


@R.add("f21_duplicate_values", "SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1")
def f21(t):
    return summaries.duplicate_values(t.part, "p_name")


@R.add("f22_conflicting_records", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
def f22(t):
    return catalog.conflicting_groups(t.lineitem.withColumn("content", F.concat("l_returnflag", "l_linestatus")), ["l_orderkey"], "content").select("l_orderkey")


@R.add("f23_casefold_collisions",
    "WITH w AS (SELECT p_name AS w, p_partkey AS k FROM part), v AS (SELECT DISTINCT CASE k % 4 WHEN 0 THEN upper(w) WHEN 1 "
    "THEN w || chr(160) WHEN 2 THEN w || ' STRASSE' ELSE w || ' straße' END AS v, lower(CASE WHEN k % 4 < 2 THEN w ELSE w || "
    "' strasse' END) AS folded FROM w) SELECT folded, count(*) AS spellings FROM v GROUP BY 1 HAVING count(*) > 1")
def f23(t):
    k = F.col("p_partkey") % 4
    spelled = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit("\u00a0"))).when(k == 2, F.concat("p_name", F.lit(" STRASSE"))).otherwise(F.concat("p_name", F.lit(" straße")))
    return summaries.casefold_collisions(t.part.select(spelled.alias("w")), "w")


@R.add("f24_runtime_rollup",
    "SELECT event_type, count(*) AS runs, round(sum(value), 2) AS total, max(value) AS most, count(DISTINCT user_id) AS "
    "variants FROM events GROUP BY 1")
def f24(t):
    return summaries.runtime_rollup(t.events, "event_type", "value", "user_id")


@R.add("f24_runtime_report",
    "SELECT event_type, count(*) AS runs, round(sum(value), 2) AS total, max(value) AS most, count(DISTINCT user_id) AS variants, max(event_id % 977) AS memory, sum(length(props))::BIGINT AS markers FROM events GROUP BY 1")
def f24_report(t):
    runs = t.events.withColumns({"memory": F.col("event_id") % 977, "markers": F.length("props").cast("long")})
    return summaries.runtime_rollup(runs, "event_type", "value", "user_id", "memory", "markers")


@R.add("f24_variant_counts",
    "WITH v AS (SELECT event_type, user_id, count(*) AS runs FROM events GROUP BY ALL) SELECT *, round(runs / sum(runs) OVER (PARTITION BY event_type), 6) AS share FROM v")
def f24_variants(t):
    return summaries.variant_counts(t.events, "event_type", "user_id")


@R.add("f25_node_flags",
    "SELECT node, array_to_string(list_sort(list(DISTINCT m)), ',') AS modes, bool_or(q = 1) AS any_local, bool_or(q > 40) "
    "AS any_intercity FROM (SELECT l_suppkey AS node, l_returnflag AS m, l_quantity AS q FROM lineitem UNION ALL SELECT "
    "l_partkey, l_returnflag, l_quantity FROM lineitem) GROUP BY node")
def f25(t):
    from cairnlake.operators.graph import node_flags

    routes = t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag", (F.col("l_quantity") == 1).alias("local"), (F.col("l_quantity") > 40).alias("intercity"))
    return node_flags(routes, ["l_suppkey", "l_partkey"], "l_returnflag", "local", "intercity").withColumn("modes", F.array_join("modes", ","))


@R.add("f26_texture_usage",
    "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS used FROM lineitem WHERE l_suppkey <> 0 "
    "GROUP BY 1")
def f26(t):
    return summaries.texture_usage(t.lineitem, "l_orderkey", "l_suppkey").withColumn("used", F.array_join(F.transform("used", lambda s: s.cast("string")), ","))


@R.add("f27_alias_set", """
    WITH a AS (SELECT p_brand AS k, 'small ring' AS pri, trim(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || '  ' ELSE '  ' || replace(p_name, ' ', '   ') END, '\\s+', ' ', 'g')) AS al FROM part),
    o AS (SELECT k, lower(al) AS f, min(al) AS al FROM a WHERE al <> '' AND lower(al) <> pri GROUP BY 1, 2) SELECT k, array_to_string(list_sort(list(al)), '|') AS aliases FROM o GROUP BY k""")
def f27(t):
    alias = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit("  "))).otherwise(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   "))))
    rows = t.part.select(F.col("p_brand").alias("k"), F.lit("small ring").alias("pri"), alias.alias("al"))
    return catalog.alias_set(rows, "k", "pri", "al").withColumn("aliases", F.array_join("aliases", "|"))
