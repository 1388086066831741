"""Merge and user-data queries on the events, lineitem and conversations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions.keys import ascii_fold
from cairnlake.operators import merge, userdata
from cairnlake.plans.registry import Registry

R = Registry()
ORDER = ["ts", "event_id"]
E = (
    "e AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props, "
    "event_type = 'error' AS deleted, epoch_ms(ts) AS ms FROM events)"
)


def log(t):
    """events as an ordered log: tombstones are errors, some values are missing."""
    return t.events.select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "props", (F.col("event_type") == "error").alias("deleted"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


LATEST = "l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"


@R.add("slice1_reasons", """
    WITH v AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    r AS (SELECT CASE WHEN s_suppkey IS NULL THEN 'unresolved' WHEN value < 10 THEN 'low' ELSE 'ok' END AS reason FROM v LEFT JOIN supplier ON s_suppkey = user_id WHERE event_type <> 'error')
    SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def slice1(t):
    from cairnlake.operators.catalog import first_failing_reason

    live = merge.latest_wins(t.events.withColumn("deleted", F.col("event_type") == "error"), ["user_id"], ORDER, "deleted")
    resolved = live.join(t.supplier.select("s_suppkey"), F.col("user_id") == F.col("s_suppkey"), "left")
    rows = first_failing_reason(resolved, [("unresolved", F.col("s_suppkey").isNull()), ("low", F.col("value") < 10)], passed="ok")
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@R.add("b1_ascii_fold",
    "SELECT translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded, count(*) AS n FROM "
    "documents GROUP BY 1")
def b1(t):
    return t.documents.groupBy(ascii_fold("text").alias("folded")).agg(F.count("*").alias("n"))


@R.add("b2_latest_wins", f"WITH {E}, {LATEST} SELECT user_id, event_id, event_type, value FROM l WHERE NOT deleted")
def b2(t):
    return merge.latest_wins(log(t), ["user_id"], ORDER, "deleted").select("user_id", "event_id", "event_type", "value")


@R.add("b3_latest_then_qualify", f"WITH {E}, {LATEST} SELECT user_id, event_id, value FROM l WHERE value > 10")
def b3(t):
    return merge.latest_then_qualify(log(t), ["user_id"], ORDER, F.col("value") > 10).select("user_id", "event_id", "value")


@R.add("b4_first_wins",
    "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY "
    "l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_discount, l_quantity) = 1")
def b4(t):
    return merge.first_wins(t.lineitem, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


EPOCH = (
    "p AS (SELECT *, sum(deleted::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS "
    "epoch FROM e)"
)


@R.add("b5_epoch_merge", f"""
    WITH {E}, {EPOCH}, live AS (SELECT user_id, epoch FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND NOT deleted)
    SELECT user_id, epoch, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value,
           arg_min(event_id, (ts, event_id)) AS event_id, array_to_string(list_sort(list(DISTINCT props)), ';') AS props
    FROM p JOIN live USING (user_id, epoch) WHERE NOT deleted GROUP BY user_id, epoch""")
def b5(t):
    merged = merge.epoch_merge(log(t), "user_id", ORDER, "deleted", always=["event_type"], carry=["value"], first=["event_id"], collect=["props"])
    return merged.withColumn("props", F.array_join("props", ";"))


@R.add("b6_child_of_live_epoch", f"""
    WITH {E}, {EPOCH}, live AS (SELECT user_id, epoch FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND NOT deleted)
    SELECT user_id, epoch, count(*) AS children FROM p JOIN live USING (user_id, epoch) WHERE event_type = 'click' GROUP BY user_id, epoch""")
def b6(t):
    rows = merge.with_epoch(log(t), "user_id", ORDER, "deleted")
    live = merge.latest_wins(rows, ["user_id"], ORDER, "deleted")
    return merge.child_of_live_epoch(rows.where("event_type = 'click'"), live, "user_id").groupBy("user_id", "epoch").agg(F.count("*").alias("children"))


@R.add("b7_two_tier_latest",
    f"WITH {E} SELECT user_id, event_id, event_type, deleted FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "
    "(event_type = 'purchase')::INT DESC, ts DESC, event_id DESC) = 1")
def b7(t):
    return merge.two_tier_latest(log(t).withColumn("tier", (F.col("event_type") == "purchase").cast("int")), ["user_id"], ORDER, "tier").select("user_id", "event_id", "event_type", "deleted")


@R.add("b8_remap_identity", """
    WITH r AS (SELECT o_orderkey, o_custkey % 10 AS owner, ((o_orderkey % 5) << 24) | (o_orderkey % 1000) AS raw FROM orders),
    p AS (SELECT n_nationkey % 10 AS owner, 1 + n_nationkey // 10 AS ordinal, 100 + n_nationkey AS parent FROM nation)
    SELECT o_orderkey, raw, coalesce(parent, r.owner)::BIGINT AS origin, (CASE WHEN parent IS NULL THEN raw ELSE raw & 16777215 END)::BIGINT AS local
    FROM r LEFT JOIN p ON p.owner = r.owner AND p.ordinal = (raw >> 24) & 255""")
def b8(t):
    refs = t.orders.select("o_orderkey", (F.col("o_custkey") % 10).alias("owner"), F.shiftleft(F.col("o_orderkey") % 5, 24).bitwiseOR(F.col("o_orderkey") % 1000).alias("raw"))
    parents = t.nation.select((F.col("n_nationkey") % 10).cast("long").alias("owner"), (1 + F.floor(F.col("n_nationkey") / 10)).alias("ordinal"), (100 + F.col("n_nationkey")).cast("long").alias("parent"))
    return merge.remap_identity(refs, parents, "raw", "owner").select("o_orderkey", "raw", "origin", "local")


@R.add("b9_check_dependencies", """
    WITH l AS (SELECT l_orderkey AS idx, 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS parent FROM lineitem),
    j AS (SELECT CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN s_suppkey >= idx THEN 'not_earlier' ELSE 'fine' END AS problem FROM l LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 9 <> 0) ON s_name = parent)
    SELECT problem, count(*) AS n FROM j GROUP BY problem""")
def b9(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("idx"), F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("parent"))
    found = merge.check_dependencies(links, t.supplier.where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("name")))
    return found.groupBy(F.coalesce("problem", F.lit("fine")).alias("problem")).agg(F.count("*").alias("n"))


@R.add("b10_override_counters", f"""
    WITH {E}, s AS (SELECT deleted, NOT coalesce(lag(deleted) OVER w, true) AS was_live, lead(event_id) OVER w IS NULL AS is_last FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT count(*) AS raw, count(*) FILTER (is_last AND NOT deleted) AS effective, count(*) FILTER (was_live AND NOT deleted) AS overrides, count(*) FILTER (deleted) AS deletions FROM s""")
def b10(t):
    return merge.override_counters(log(t), "user_id", ORDER, "deleted")


@R.add("b11_type_counts", "SELECT user_id, event_type, count(*) AS records FROM events GROUP BY ALL")
def b11(t):
    return merge.type_counts_by_source(t.events, "user_id", "event_type")


@R.add("b12_drop_flagged",
    "SELECT user_id, count(*) AS n, (SELECT count(*) FROM events WHERE event_id & 4096 <> 0) AS dropped FROM events WHERE "
    "event_id & 4096 = 0 GROUP BY user_id")
def b12(t):
    kept, dropped = merge.drop_flagged(t.events, "event_id", 0x1000)
    return kept.groupBy("user_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(dropped))


@R.add("b13_overlay", """
    SELECT l_partkey, l_suppkey, l_returnflag, l_linenumber, l_orderkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY (l_returnflag = 'R')::INT DESC, l_linenumber DESC, l_orderkey DESC, l_returnflag DESC) = 1""")
def b13(t):
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_orderkey").withColumn("mount", F.struct("l_linenumber", "l_orderkey", "l_returnflag"))
    return merge.overlay_resolve(rows, ["l_partkey", "l_suppkey"], (F.col("l_returnflag") == "R").cast("int"), "mount").drop("mount")


@R.add("b13_overlay_conflicts", "SELECT l_partkey, l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def b13c(t):
    return merge.overlay_conflicts(t.lineitem, ["l_partkey", "l_suppkey"], "l_linenumber")


@R.add("b14_candidate_fallback", """
    WITH c AS (SELECT o_orderkey, unnest([o_orderkey * 3 % 4001, o_custkey, o_orderkey % 17]) AS cand, unnest([0, 1, 2]) AS pos FROM orders),
    h AS (SELECT o_orderkey, arg_min(cand, pos) AS resolved, min(pos)::INTEGER AS pos FROM c WHERE cand IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY o_orderkey)
    SELECT o_orderkey, resolved FROM orders LEFT JOIN h USING (o_orderkey)""")
def b14(t):
    rows = t.orders.select("o_orderkey", F.array(F.col("o_orderkey") * 3 % 4001, "o_custkey", F.col("o_orderkey") % 17).alias("candidates"))
    return merge.candidate_fallback(rows, "o_orderkey", "candidates", t.part.where("p_size > 25"), "p_partkey").select("o_orderkey", "resolved")


@R.add("a3_marker_groups", """
    WITH g AS (SELECT conv_id, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS grp, turn, role FROM conversations)
    SELECT conv_id, grp, count(*) AS n, min(turn) AS first_turn FROM g GROUP BY conv_id, grp""")
def a3(t):
    return merge.marker_groups(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user").groupBy("conv_id", "grp").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@R.add("a3_marker_groups_prefixed", """
    WITH k AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'm' WHEN 'click' THEN 'p' WHEN 'view' THEN 't' ELSE 'o' END AS kind FROM events),
    n AS (SELECT event_id, kind, sum((kind = 'm')::INT) OVER r AS c, last_value(CASE WHEN kind IN ('m', 'p') THEN kind END IGNORE NULLS) OVER r AS anchor,
                 coalesce(lag(kind) OVER w, '') AS b1, coalesce(lag(kind, 2) OVER w, '') AS b2, coalesce(lead(kind) OVER w, '') AS f1, coalesce(lead(kind, 2) OVER w, '') AS f2,
                 lag(event_id, 2) OVER w AS claimer
          FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id,
           CASE WHEN kind = 'm' THEN c WHEN kind = 'p' AND f1 = 't' AND f2 = 'm' OR kind = 't' AND b1 = 'p' AND f1 = 'm' THEN c + 1 WHEN kind = 'p' OR kind = 't' AND b1 = 'p' THEN NULL
                WHEN anchor IS NULL THEN 0 WHEN anchor = 'm' THEN c END::BIGINT AS grp,
           CASE WHEN kind = 'p' AND f1 <> 't' THEN 'prefix_without_target' WHEN kind = 'm' AND b1 = 't' AND b2 = 'p' AND claimer % 3 <> event_id % 3 THEN 'identity_mismatch' END AS problem
    FROM n""")
def a3_prefixed(t):
    tag = lambda name: F.col("event_type") == name
    identity = F.col("event_id") % 3
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    return merge.marker_groups(rows, ["user_id"], ORDER, tag("purchase"), tag("click"), tag("view"), identity, identity).select("event_id", "grp", "problem")


@R.add("a4_pivot_tags", """
    SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_user, arg_min(text, turn) FILTER (role = 'assistant') AS first_assistant, arg_max(text, turn) FILTER (role = 'system') AS last_system
    FROM conversations GROUP BY conv_id""")
def a4(t):
    return merge.pivot_tags(t.conversations, ["conv_id"], "role", "text", ["turn"], {"user": "last", "assistant": "first", "system": "last"})


@R.add("a5_pair_consecutive", """
    WITH r AS (SELECT conv_id, turn, role, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS paired FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, paired FROM r WHERE role = 'user'""")
def a5(t):
    return merge.pair_consecutive(t.conversations, ["conv_id"], ["turn"], "role", "text", "user", "assistant").select("conv_id", "turn", "paired")


@R.add("a6_head_with_tails", """
    WITH g AS (SELECT conv_id, turn, role, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT conv_id, grp, arg_min(text, turn) AS head_value, arg_max(text, turn) FILTER (role = 'assistant') AS last_tail, count(*) FILTER (role = 'assistant') AS tails FROM g WHERE grp > 0 GROUP BY conv_id, grp""")
def a6(t):
    return merge.head_with_tails(t.conversations, ["conv_id"], ["turn"], "role", "text", "user", "assistant")


@R.add("k1_apply_patches", f"""
    WITH {E} SELECT user_id, coalesce(arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL), -1.0)::DOUBLE AS value, coalesce(arg_max(event_type, (ts, event_id)) FILTER (event_type IS NOT NULL AND event_type <> 'error'), 'unvisited') AS kind FROM e GROUP BY user_id""")
def k1(t):
    rows = log(t).withColumn("kind", F.when(~F.col("deleted"), F.col("event_type")))
    return userdata.apply_patches(rows, ["user_id"], ORDER, {"value": F.lit(-1.0), "kind": F.lit("unvisited")})


@R.add("k2_monotonic_time", """
    WITH c AS (SELECT event_id, user_id, epoch_ms(ts) // 3600000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
    SELECT event_id, user_id, (max(ms - i) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + i)::BIGINT AS at FROM c""")
def k2(t):
    rows = t.events.select("event_id", "user_id", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600000).alias("ms"))
    return userdata.monotonic_time(rows, "user_id", ["event_id"], "ms").select("event_id", "user_id", "at")


@R.add("k2_monotonic_time_hot", """
    WITH c AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id, epoch_ms(ts) // 3600000 AS ms FROM events),
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM c)
    SELECT event_id, user_id, (max(ms - i) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + i)::BIGINT AS at FROM i""")
def k2_hot(t):
    """Half of all events are one user's, whose rows are worked off in blocks."""
    user = F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("user_id"))
    rows = t.events.select("event_id", user.alias("user_id"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600000).alias("ms"))
    return userdata.monotonic_time(rows, "user_id", ["event_id"], "ms", most=100).select("event_id", "user_id", "at")


@R.add("k3_upsert_markers", f"""
    WITH {E}, m AS (SELECT user_id, event_id, '  ' || event_type || props || ' ' AS label, event_id % 50 // 49 AS dataset, event_type = 'error' AND event_id % 40 = 0 AS del FROM e),
    s AS (SELECT *, trim(label) AS label_out, coalesce(max(del::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS gone,
                 first_value(dataset) OVER w AS d0, lag(trim(label)) OVER w = trim(label) AS same, first_value(event_id) OVER w AS created FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, label_out, created, CASE WHEN gone THEN 'after_delete' WHEN dataset <> d0 THEN 'other_dataset' WHEN length(label_out) > 14 AND NOT coalesce(same, false) THEN 'too_long' END AS reason FROM s""")
def k3(t):
    rows = log(t).select("user_id", "event_id", F.concat(F.lit("  "), "event_type", "props", F.lit(" ")).alias("label"), F.floor(F.col("event_id") % 50 / 49).alias("dataset"), (F.col("deleted") & (F.col("event_id") % 40 == 0)).alias("del"))
    return userdata.upsert_markers(rows, "user_id", ["event_id"], "label", "dataset", "del", 14).select("user_id", "event_id", "label_out", "created", "reason")


@R.add("k4_soft_delete", """
    WITH r AS (SELECT o_orderkey, epoch_ms(o_orderdate) AS updated FROM orders), q AS (SELECT l_orderkey AS o_orderkey, min(epoch_ms(l_shipdate)) AS tm FROM lineitem WHERE l_quantity = 50 GROUP BY 1)
    SELECT o_orderkey, greatest(tm, updated + 1) AS deleted_at, coalesce(greatest(tm, CASE WHEN tm IS NOT NULL THEN updated + 1 END), updated) AS updated FROM r LEFT JOIN q USING (o_orderkey)""".replace("greatest(tm, updated + 1) AS deleted_at", "CASE WHEN tm IS NOT NULL THEN greatest(tm, updated + 1) END AS deleted_at"))
def k4(t):
    requests = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("at"))
    return userdata.soft_delete(t.orders.select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated")), requests, "o_orderkey", "at", "updated")


HALVES = (
    f"WITH {E}, h AS (SELECT user_id, event_id % 2 AS side, max(ts) AS tm, max(event_id) AS id, bool_or(event_type = 'error') "
    "AS gone FROM e GROUP BY 1, 2)"
)


@R.add("k5_import_backup", HALVES + """
    , o AS (SELECT * FROM h WHERE side = 0 AND user_id % 5 <> 0), n AS (SELECT user_id, side, CASE WHEN user_id % 3 = 0 THEN (SELECT tm FROM o WHERE o.user_id = h.user_id) ELSE tm END AS tm, id, user_id % 2 = 0 AS gone FROM h WHERE side = 1 AND user_id % 7 <> 0),
    o2 AS (SELECT user_id, tm, id, user_id % 4 = 0 AS gone FROM o), n2 AS (SELECT user_id, tm, id, gone FROM n WHERE tm IS NOT NULL),
    j AS (SELECT user_id, o2.tm AS oa, o2.id AS oi, o2.gone AS og, n2.tm AS na, n2.id AS ni, n2.gone AS ng, o2.id IS NOT NULL AS has_o, n2.id IS NOT NULL AS has_n FROM o2 FULL JOIN n2 USING (user_id)),
    k AS (SELECT *, CASE WHEN has_n THEN NOT has_o OR na > oa OR (na = oa AND ng AND NOT og) END AS taken FROM j)
    SELECT user_id, taken, CASE WHEN coalesce(taken, false) THEN ni ELSE oi END AS id, CASE WHEN coalesce(taken, false) THEN ng ELSE og END AS gone FROM k""")
def k5(t):
    halves = log(t).groupBy("user_id", (F.col("event_id") % 2).alias("side")).agg(F.max("ts").alias("at"), F.max("event_id").alias("id"))
    old = halves.where("side = 0 and user_id % 5 <> 0").select("user_id", "at", "id", (F.col("user_id") % 4 == 0).alias("gone"))
    new = halves.where("side = 1 and user_id % 7 <> 0").join(old.select("user_id", F.col("at").alias("old_at")), "user_id", "left")
    new = new.select("user_id", F.when(F.col("user_id") % 3 == 0, F.col("old_at")).otherwise(F.col("at")).alias("at"), "id", (F.col("user_id") % 2 == 0).alias("gone")).where("at is not null")
    return userdata.import_backup(old, new, ["user_id"], "at", "gone").select("user_id", "taken", "id", "gone")


@R.add("k6_export_backup",
    "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '2-HIGH' THEN 'unbound' END AS problem FROM orders "
    "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def k6(t):
    bindings = t.orders.select("o_orderpriority").distinct().where("o_orderpriority <> '2-HIGH'")
    return userdata.export_backup(t.orders.select("o_orderkey", "o_orderpriority"), bindings, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@R.add("k7_binding_state", """
    WITH w AS (SELECT c_custkey AS d, c_nationkey AS s FROM customer), b AS (SELECT c_custkey AS d, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE c_nationkey + 1 END AS bound FROM customer WHERE c_custkey % 4 <> 0),
    r AS (SELECT o_custkey AS d, count(*) AS records FROM orders WHERE o_totalprice > 300000 GROUP BY 1),
    j AS (SELECT d, s, bound, coalesce(records, 0) AS records FROM w LEFT JOIN b USING (d) LEFT JOIN r USING (d))
    SELECT d, records, CASE WHEN bound = s THEN 'ready' WHEN bound IS NOT NULL AND records > 0 THEN 'conflict' WHEN bound IS NOT NULL THEN 'rebind' WHEN records > 0 THEN 'conflict' ELSE 'bind' END AS state FROM j""")
def k7(t):
    wanted = t.customer.select(F.col("c_custkey").alias("d"), F.col("c_nationkey").alias("s"))
    bindings = wanted.where("d % 4 <> 0").withColumn("s", F.when(F.col("d") % 3 == 0, F.col("s")).otherwise(F.col("s") + 1))
    records = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("d"))
    return userdata.binding_state(wanted, bindings, records, "d", "s").select("d", "records", "state")


@R.add("k8_import_problems", """
    WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey AS d, l_partkey AS p, l_linenumber % 2 AS s FROM lineitem), j AS (SELECT i.*, want, k.p IS NOT NULL AS known
      FROM i LEFT JOIN (SELECT s_suppkey AS d, s_suppkey % 2 AS want FROM supplier WHERE s_suppkey % 5 <> 0) USING (d) LEFT JOIN (SELECT DISTINCT l_suppkey AS d, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A') k ON k.d = i.d AND k.p = i.p)
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN want IS NULL THEN 'unknown_dataset' WHEN want <> s THEN 'other_snapshot' WHEN NOT known THEN 'unknown_place' END AS reason FROM j) WHERE reason IS NOT NULL GROUP BY reason""")
def k8(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("d"), F.col("l_partkey").alias("p"), (F.col("l_linenumber") % 2).alias("s"))
    datasets = t.supplier.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("d"), (F.col("s_suppkey") % 2).alias("s"))
    places = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("d"), F.col("l_partkey").alias("p"))
    return userdata.import_problems(rows, places, datasets, "d", "p", "s").groupBy("reason").agg(F.count("*").alias("n"))


@R.add("k9_visible_rows", f"WITH {E} SELECT event_id, value FROM e WHERE value IS NULL")
def k9(t):
    return userdata.visible_rows(log(t).select("event_id", "value"), "value")
