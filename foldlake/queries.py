"""The queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashes, numbers, values
from .model import DELETE, StoreOptions
from .operators import aggregates, ordered, ranges, read, script, sets, sketch
from .plans import fold as folds
from .plans.store import Store
from .shared import scratch
from .sources import edits as src
from .sources import generators
from .streaming import ingest

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, re.sub(r"\b(pivot|at)\b", r'"\1"', sql) if sql else None)  # words of SQL's own
        return f

    return add


# --- SQL that the oracles share

K = "'user' || lpad(CAST({} AS VARCHAR), 20, '0')"
OE = f"SELECT {K.format('o_custkey')} AS key, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 0 END AS op, CAST(floor(o_totalprice) AS BIGINT) AS i32 FROM orders"
EE = f"SELECT {K.format('user_id')} || '/' || json_extract_string(props, '$.k') AS key, event_id AS seq, CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'click' THEN 3 ELSE 0 END AS op, CAST(floor(value) AS BIGINT) AS i32 FROM events WHERE event_type <> 'view'"
CI = f"SELECT {K.format('c_custkey')} AS key, c_custkey AS seq, 2 AS op, c_name AS value FROM customer"
DI = "SELECT 'doc' || lpad(CAST(doc_id AS VARCHAR), 20, '0') AS key, doc_id AS seq, 2 AS op, text AS value FROM documents"
PIVOTS = f"SELECT {K.format('c_custkey')} AS key FROM customer WHERE c_custkey % 100 = 0"
ROUTES = f"SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS INT) AS pivot, key AS lo, lead(key) OVER (ORDER BY key) AS hi FROM ({PIVOTS}) p"


def fold_sql(edits: str) -> str:
    return f"""SELECT key, CAST(CASE WHEN top_op <> 3 THEN top_op WHEN bar_op IS NULL THEN 3 ELSE 2 END AS INT) AS op,
  CAST(((CASE WHEN top_op <> 3 THEN top_v WHEN bar_op = 2 THEN adds + bar_v ELSE adds END + 2147483648) & 4294967295) - 2147483648 AS BIGINT) AS i32, seq
FROM (SELECT key, max_by(op, seq) AS top_op, max_by(i32, seq) AS top_v, max(seq) AS seq,
    CAST(sum(CASE WHEN op = 3 AND (bar IS NULL OR seq > bar) THEN i32 ELSE 0 END) AS BIGINT) AS adds,
    max(CASE WHEN seq = bar THEN op END) AS bar_op, max(CASE WHEN seq = bar THEN i32 END) AS bar_v
  FROM (SELECT *, max(CASE WHEN op IN (0, 2) THEN seq END) OVER (PARTITION BY key) AS bar FROM ({edits}) e) m GROUP BY key) g"""


FOLD = fold_sql(OE)
ITEMS = f"SELECT * FROM ({FOLD}) f WHERE op IN (2, 3, 4)"


def _key(n: int) -> str:
    return f"user{n:020d}"


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    hits = src.table(spark, sf, "supplier").select(values.user_key(F.col("s_suppkey")).alias("key"))
    return hits.unionByName(src.table(spark, sf, "customer").select(values.user_key(F.col("c_custkey") + 1000000).alias("key")))


PROBES = f"SELECT {K.format('s_suppkey')} AS key FROM supplier UNION ALL SELECT {K.format('c_custkey + 1000000')} FROM customer"


def _pivots(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "customer").where("c_custkey % 100 = 0").select(values.user_key(F.col("c_custkey")).alias("key"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return folds.items(src.order_edits(spark, sf))


# --- folds


@query(FOLD)
def q_fold_full(spark, sf):
    """The canonical fold over the orders' log."""
    return folds.fold(src.order_edits(spark, sf))


@query(ITEMS)
def q_fold_items(spark, sf):
    return _items(spark, sf)


@query(f"SELECT key, op, i32, seq FROM ({fold_sql(EE)}) f WHERE op IN (2, 3, 4)")
def q_fold_events(spark, sf):
    return folds.items(src.event_edits(spark, sf))


@query(f"SELECT key, max_by(op, seq) AS op, max_by(i32, seq) AS i32, max(seq) AS seq FROM ({OE}) e GROUP BY key")
def q_lww_latest(spark, sf):
    return folds.latest(src.order_edits(spark, sf))


@query(f"SELECT * FROM ({FOLD}) f")
def q_fold_chunked(spark, sf):
    """Folded in chunks of 1,000 sequence numbers first."""
    return folds.fold(src.order_edits(spark, sf), chunk=1000)


@query(f"SELECT key, CAST(((sum(i32) + 2147483648) & 4294967295) - 2147483648 AS BIGINT) AS i32 FROM ({OE}) e WHERE op = 3 GROUP BY key")
def q_counter_merge(spark, sf):
    """Adds alone: the registered-operator path sums them."""
    adds = src.order_edits(spark, sf).where("op = 3").withColumn("op", F.lit(5))
    folds.register_merge(5, lambda c: numbers.wrap32(F.sum(c)))
    return folds.fold_registered(adds, 5)


@query(f"SELECT key, op, i32, seq FROM ({FOLD}) f WHERE op = 0")
def q_delete_visibility(spark, sf):
    """Deletes that the items hide."""
    return folds.fold(src.order_edits(spark, sf)).where(F.col("op") == DELETE)


@query(f"SELECT key, seq, op, i32 FROM ({OE}) e WHERE op = 3")
def q_needs_combine(spark, sf):
    return folds.needs_combine(src.order_edits(spark, sf))


@query(FOLD)
def q_tier_union(spark, sf):
    """Base, delta and active thirds of the log as one."""
    e = src.order_edits(spark, sf)
    n = e.count()
    tier = e.withColumn("tier", F.expr(f"seq * 3 div {max(1, n)}"))
    return folds.fold(folds.union_tiers(*(tier.where(F.col("tier") == t).drop("tier") for t in (0, 1, 2)), tier.where("tier > 2").drop("tier")))


@query(f"SELECT key, op, i32, seq FROM ({FOLD}) f")
def q_incremental_equals_full(spark, sf):
    """Batches of 1,000 folded each, then their folds."""
    e = src.order_edits(spark, sf)
    parts = folds._fold(e.withColumn("batch_id", F.expr("seq div 1000")), ["key", "batch_id"]).drop("batch_id")
    return folds.fold(parts)


@query(f"SELECT batch_id, count(*) AS keys, CAST(sum(CASE WHEN op = 0 THEN 1 ELSE 0 END) AS BIGINT) AS deletes, CAST(sum(i32) AS BIGINT) AS total FROM ({fold_sql(f'SELECT key || chr(1) || CAST(seq // 1000 AS VARCHAR) AS key, seq, op, i32 FROM ({OE}) x').replace('SELECT key,', 'SELECT CAST(split_part(key, chr(1), 2) AS BIGINT) AS batch_id,', 1)}) f GROUP BY 1")
def q_batch_fold(spark, sf):
    """What each batch's fold holds."""
    e = src.order_edits(spark, sf).withColumn("batch_id", F.expr("seq div 1000"))
    return folds._fold(e, ["key", "batch_id"]).groupBy("batch_id").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("op") == 0).alias("deletes"), F.sum("i32").cast("long").alias("total"))


@query(fold_sql(f"SELECT * FROM ({OE}) e WHERE seq // 1000 > 4"))
def q_batch_replay_dedup(spark, sf):
    """Batches up to 4 come again and are ignored."""
    e = src.order_edits(spark, sf).withColumn("batch_id", F.expr("seq div 1000"))
    return folds.fold(ranges.after_batch(e, 4).drop("batch_id"))


@query(f"SELECT key, seq, op, i32 FROM ({OE}) e WHERE seq > 7000")
def q_unflushed(spark, sf):
    return ranges.unflushed(src.order_edits(spark, sf), 7000)


@query(f"SELECT batch_id, CAST(batch_id % 4 = 3 AS BOOLEAN) AS checkpoint, count(*) AS edits FROM (SELECT seq // 1000 AS batch_id FROM ({OE}) e) b GROUP BY 1, 2")
def q_count_checkpoint(spark, sf):
    """Batches after which a checkpoint is due with chi 4."""
    e = src.order_edits(spark, sf).groupBy(F.expr("seq div 1000").alias("batch_id")).agg(F.count(F.lit(1)).alias("edits"))
    return e.select("batch_id", (F.col("batch_id") % 4 == 3).alias("checkpoint"), "edits")


# --- reads


@query(f"SELECT key, op, i32, seq FROM ({FOLD}) f WHERE op IN (2, 3, 4) AND key = '{_key(42)}'")
def q_point_get(spark, sf):
    return read.get(_items(spark, sf), _key(42))


@query(f"SELECT key, op, i32, seq FROM ({FOLD}) f WHERE op IN (2, 3, 4) AND key IN ({PROBES})")
def q_multi_get(spark, sf):
    return read.multi_get(_items(spark, sf), _probes(spark, sf))


@query(f"SELECT DISTINCT key FROM ({PROBES}) p WHERE key NOT IN (SELECT key FROM ({ITEMS}) i)")
def q_missing_keys(spark, sf):
    return read.missing(_probes(spark, sf), _items(spark, sf))


@query(f"SELECT * FROM ({ITEMS}) i WHERE key >= '{_key(100)}' ORDER BY key LIMIT 100")
def q_scan_range(spark, sf):
    return read.scan(_items(spark, sf), _key(100), 100)


@query(f"SELECT DISTINCT key FROM ({OE}) e WHERE key >= '{_key(100)}' ORDER BY key LIMIT 100")
def q_scan_keys(spark, sf):
    return read.scan_keys(src.order_edits(spark, sf), _key(100), 100)


@query(f"SELECT * FROM ({ITEMS}) i WHERE key > (SELECT max(key) FROM (SELECT key FROM ({ITEMS}) j WHERE key >= '{_key(100)}' ORDER BY key LIMIT 100) l) ORDER BY key LIMIT 100")
def q_scan_page2(spark, sf):
    items = _items(spark, sf)
    last = read.scan(items, _key(100), 100).agg(F.max("key")).first()[0]
    return read.page_after(items, last or "", 100)


@query(f"SELECT key, value FROM ({CI}) c WHERE key >= '{_key(500)}' ORDER BY key LIMIT 250")
def q_cursor_read(spark, sf):
    """Read through a cursor with pages of 60."""
    rows = read.Cursor(src.customer_items(spark, sf).select("key", "value"), _key(500), page=60).read(250)
    return spark.createDataFrame([(r.key, r.value) for r in rows], "key string, value string")


@query(f"SELECT key, value FROM ({CI}) c WHERE key IN ({PROBES})")
def q_payload_get(spark, sf):
    return read.multi_get(src.customer_items(spark, sf).select("key", "value"), _probes(spark, sf))


@query(f"SELECT key, op, i32 FROM ({OE}) e WHERE 1 = 1")
def q_sorted_edits(spark, sf):
    """Edits in key order inside each range of keys."""
    return ordered.sort_edits(src.order_edits(spark, sf)).select("key", "op", "i32")


# --- ranges


@query(f"SELECT * FROM ({ITEMS}) i WHERE NOT (key BETWEEN '{_key(200)}' AND '{_key(400)}')")
def q_range_drop_closed(spark, sf):
    return ranges.drop_closed(_items(spark, sf), _key(200), _key(400))


@query(f"SELECT * FROM ({ITEMS}) i WHERE NOT (key >= '{_key(200)}' AND key < '{_key(400)}')")
def q_range_drop_half_open(spark, sf):
    return ranges.drop_half_open(_items(spark, sf), _key(200), _key(400))


@query(f"SELECT * FROM ({ITEMS}) i WHERE key <= '{_key(300)}'")
def q_range_up_to(spark, sf):
    return ranges.up_to(_items(spark, sf), _key(300))


@query(f"SELECT * FROM ({ITEMS}) i WHERE key >= '{_key(300)}'")
def q_slice_from(spark, sf):
    return ranges.from_key(_items(spark, sf), _key(300))


@query(f"SELECT CASE WHEN key < '{_key(300)}' THEN 'lower' ELSE 'upper' END AS side, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM ({ITEMS}) i GROUP BY 1")
def q_split_at_key(spark, sf):
    low, high = ranges.split_at(_items(spark, sf), _key(300))
    return low.withColumn("side", F.lit("lower")).unionByName(high.withColumn("side", F.lit("upper"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query(f"SELECT key, seq, op, i32, pivot FROM ({OE}) e JOIN ({ROUTES}) r ON key >= lo AND (hi IS NULL OR key < hi)")
def q_pivot_route(spark, sf):
    return ranges.route(src.order_edits(spark, sf), _pivots(spark, sf))


@query(f"SELECT key, seq, op, i32, pivot FROM ({OE}) e JOIN ({ROUTES}) r ON key >= lo AND (hi IS NULL OR key < hi)")
def q_pivot_route_many(spark, sf):
    """The same as if there were too many pivots to broadcast."""
    return ranges.route(src.order_edits(spark, sf), _pivots(spark, sf), bound=1).select("key", "seq", "op", "i32", F.col("pivot").cast("int"))


@query(f"SELECT key, seq, op, i32, pivot FROM ({OE}) e JOIN ({ROUTES}) r ON key >= lo AND (hi IS NULL OR key < hi) WHERE pivot IN (0, 2, 5)")
def q_pivot_prune(spark, sf):
    return ranges.only_pivots(ranges.route(src.order_edits(spark, sf), _pivots(spark, sf)), 0b100101)


@query(f"SELECT key, seq, op, i32 FROM ({OE}) e WHERE key IN ({PROBES})")
def q_membership(spark, sf):
    return ranges.maybe_member(src.order_edits(spark, sf), _probes(spark, sf))


@query(f"SELECT key, seq, op, i32 FROM ({OE}) e WHERE (CAST(('0x' || substr(md5(key), 1, 8)) AS BIGINT) & 7) = 0")
def q_hash_sample(spark, sf):
    return ranges.sample_by_hash(src.order_edits(spark, sf), 7)


@query(f"SELECT a.pivot AS a, b.pivot AS b, CAST(a.hi <= b.lo AS BOOLEAN) AS before FROM ({ROUTES}) a JOIN ({ROUTES}) b ON b.pivot = a.pivot + 1")
def q_range_order(spark, sf):
    """Neighbouring ranges do not overlap."""
    r = ranges.pivot_ranges(_pivots(spark, sf))
    nxt = r.select((F.col("pivot") - 1).alias("a"), F.col("pivot").alias("b"), F.col("lo").alias("next_lo"))
    return r.join(nxt, r.pivot == nxt.a).select("a", "b", (F.col("hi") <= F.col("next_lo")).alias("before"))


# --- sets


@query(f"SELECT key, value FROM ({CI}) c UNION ALL SELECT key, value FROM ({DI}) d")
def q_concat_disjoint(spark, sf):
    return sets.concat_disjoint(src.customer_items(spark, sf).select("key", "value"), src.document_items(spark, sf).select("key", "value"))


@query(f"SELECT key, op, i32, seq FROM ({FOLD}) f WHERE NOT (key >= '{_key(10)}' AND key < '{_key(20)}')")
def q_range_difference(spark, sf):
    return ranges.drop_half_open(folds.fold(src.order_edits(spark, sf)), _key(10), _key(20))


@query(f"SELECT key, CASE WHEN s.skey IS NULL THEN value ELSE s_name END AS value FROM ({CI}) c LEFT JOIN (SELECT {K.format('s_suppkey')} AS skey, s_name FROM supplier) s ON s.skey = c.key UNION ALL SELECT {K.format('s_suppkey')}, s_name FROM supplier WHERE {K.format('s_suppkey')} NOT IN (SELECT key FROM ({CI}) c)")
def q_replace_all(spark, sf):
    """Suppliers upserted over customers: a batch merged into a set."""
    batch = src.table(spark, sf, "supplier").select(values.user_key(F.col("s_suppkey")).alias("key"), F.col("s_name").alias("value"))
    return sets.replace_all(src.customer_items(spark, sf), batch)


@query(f"SELECT * FROM ({ITEMS}) i ORDER BY key LIMIT 120")
def q_take_first(spark, sf):
    return ordered.first_n(_items(spark, sf), 120)


@query(f"SELECT key, op, i32, seq FROM (SELECT *, row_number() OVER (ORDER BY key) AS rn FROM ({ITEMS}) i) r WHERE rn > 120")
def q_drop_first(spark, sf):
    return ordered.drop_first_n(_items(spark, sf), 120)


# --- aggregates

SIZE = "(9 + octet_length(encode(key)) + octet_length(encode(value)))"


@query(f"SELECT count(*) AS n, CAST(sum{SIZE} AS BIGINT) AS bytes FROM ({DI}) d")
def q_packed_size(spark, sf):
    return aggregates.set_size(src.document_items(spark, sf))


@query(f"SELECT count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM ({ITEMS}) i")
def q_key_stats(spark, sf):
    return aggregates.key_stats(_items(spark, sf))


@query(f"SELECT count(DISTINCT key) AS n_keys FROM ({OE}) e")
def q_distinct_keys(spark, sf):
    return aggregates.distinct_keys(src.order_edits(spark, sf))


@query(f"SELECT CAST(sum(CASE WHEN op IN (2, 3, 4) THEN 0 ELSE 1 END) AS BIGINT) AS drop_count, CAST(sum(CASE WHEN op IN (2, 3, 4) THEN 1 ELSE 0 END) AS BIGINT) AS key_count, CAST(sum(CASE WHEN op IN (2, 3, 4) THEN octet_length(encode(key)) ELSE 0 END) AS BIGINT) AS key_bytes, CAST(sum(CASE WHEN op IN (2, 3, 4) THEN octet_length(encode(CAST(i32 AS VARCHAR))) ELSE 0 END) AS BIGINT) AS value_bytes FROM ({FOLD}) f")
def q_leaf_summary(spark, sf):
    return aggregates.leaf_summary(folds.fold(src.order_edits(spark, sf)).withColumn("value", F.col("i32").cast("string")))


PENDING = f"SELECT pivot, CAST(sum(9 + octet_length(encode(key)) + octet_length(encode(CAST(i32 AS VARCHAR)))) AS BIGINT) AS bytes FROM ({OE}) e JOIN ({ROUTES}) r ON key >= lo AND (hi IS NULL OR key < hi) GROUP BY pivot"


def _pending(spark, sf):
    return aggregates.pending_bytes(ranges.route(src.order_edits(spark, sf), _pivots(spark, sf)))


@query(PENDING)
def q_pending_bytes(spark, sf):
    return _pending(spark, sf)


@query(f"SELECT pivot, bytes FROM ({PENDING}) p ORDER BY bytes DESC, pivot LIMIT 1")
def q_max_pending(spark, sf):
    return aggregates.fullest_pivot(_pending(spark, sf))


@query(f"SELECT pivot, bytes, CAST(bytes >= 20000 AS BOOLEAN) AS flush FROM ({PENDING}) p ORDER BY bytes DESC, pivot LIMIT 1")
def q_flush_decision(spark, sf):
    return aggregates.flush_wanted(_pending(spark, sf), 20000, 3)


@query(f"SELECT pivot, CAST(ceil(bytes / (16384.0 - 585)) AS BIGINT) AS segments FROM ({PENDING}) p")
def q_segment_estimate(spark, sf):
    return aggregates.segment_estimate(_pending(spark, sf), 16384, 585)


@query(f"SELECT tier, count(DISTINCT key) AS keys, count(*) AS edits, CAST(sum(octet_length(encode(key))) AS BIGINT) AS key_bytes, CAST(count(DISTINCT pivot) AS INT) AS pivots FROM (SELECT key, seq * 3 // (SELECT count(*) FROM orders) AS tier, pivot FROM ({OE}) e JOIN ({ROUTES}) r ON key >= lo AND (hi IS NULL OR key < hi)) t GROUP BY tier")
def q_segment_counts(spark, sf):
    e = src.order_edits(spark, sf)
    return aggregates.level_counts(ranges.route(e.withColumn("tier", F.expr(f"seq * 3 div {max(1, e.count())}")), _pivots(spark, sf)))


@query(f"SELECT op, count(*) AS n, min(i32) AS min_v, max(i32) AS max_v, CAST(sum(i32) AS BIGINT) AS sum_v FROM ({OE}) e GROUP BY op")
def q_metrics_by_op(spark, sf):
    return aggregates.op_metrics(src.order_edits(spark, sf))


@query(f"SELECT edits, keys, edits * 1000 // greatest(keys, 1) AS per_key_milli, adds * 1000 // greatest(edits, 1) AS adds_milli FROM (SELECT count(*) AS edits, count(DISTINCT key) AS keys, count(*) FILTER (op = 3) AS adds FROM ({OE}) e) a")
def q_metrics_ratios(spark, sf):
    return aggregates.edits_per_key(src.order_edits(spark, sf))


@query("SELECT o_orderpriority, count(v) AS runs, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM (SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders) o GROUP BY 1")
def q_run_stats(spark, sf):
    return aggregates.run_stats(src.table(spark, sf, "orders").select("o_orderpriority", F.floor("o_totalprice").cast("long").alias("v")), "o_orderpriority", "v")


# --- order

ISIZE = "(9 + octet_length(encode(key)) + octet_length(encode(CAST(i32 AS VARCHAR))))"
RUNS = f"SELECT key, CAST(sum({ISIZE}) OVER (ORDER BY key) AS BIGINT) AS run, {ISIZE} AS sz FROM ({ITEMS}) i"


def _size():
    return F.lit(9) + F.octet_length("key") + F.octet_length(F.col("i32").cast("string"))


@query(f"SELECT key, run FROM ({RUNS}) r")
def q_running_total(spark, sf):
    return ordered.running_total(_items(spark, sf), _size()).select("key", "run")


@query(f"SELECT key, run FROM ({RUNS}) r WHERE run <= 10000")
def q_trim_to_bytes(spark, sf):
    return ordered.trim_to(_items(spark, sf), _size(), 10000).select("key", "run")


@query(f"WITH r AS ({RUNS}), t AS (SELECT max(run) AS total FROM r) SELECT CAST(floor((run - 1) * greatest(1, (total + 3743) // 3744) / total) AS INT) AS part, count(*) AS n, CAST(sum(sz) AS BIGINT) AS bytes, min(key) AS min_key FROM r, t GROUP BY 1")
def q_even_parts(spark, sf):
    """Parts of at most 4,096 bytes."""
    return ordered.part_sizes(ordered.even_parts(_items(spark, sf), _size(), 4096, 352), _size())


@query(f"WITH r AS ({RUNS}), t AS (SELECT max(run) AS total FROM r) SELECT key FROM r, t ORDER BY abs(2 * (run - sz) - total), key LIMIT 1")
def q_leaf_split_point(spark, sf):
    return ordered.split_point(_items(spark, sf), _size())


@query(f"SELECT key, seq, op, i32, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS revision FROM ({OE}) e")
def q_revision_numbers(spark, sf):
    return ordered.revisions(src.order_edits(spark, sf))


COMMON = "coalesce(list_min(list_filter(range(1, least(length(lo), length(hi)) + 1), lambda i: substr(lo, i, 1) <> substr(hi, i, 1))) - 1, least(length(lo), length(hi)))"


@query(f"SELECT rn, substr(hi, 1, {COMMON} + 1) AS separator FROM (SELECT key AS hi, lag(key) OVER (ORDER BY key) AS lo, row_number() OVER (ORDER BY key) AS rn FROM ({ITEMS}) i) r WHERE (rn - 1) % 16 = 0 AND rn > 1")
def q_separators(spark, sf):
    return ordered.separators(_items(spark, sf)).select("rn", "separator")


@query("SELECT user_id, t, ops, (ops - lag(ops) OVER w) / greatest(t - lag(t) OVER w, 1e-10) AS rate FROM (SELECT user_id, event_id, CAST(event_id AS DOUBLE) AS t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS ops FROM events) e WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def q_rates(spark, sf):
    e = src.table(spark, sf, "events")
    counted = e.select("user_id", F.col("event_id").cast("double").alias("t"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("double").alias("ops"))
    return ordered.rates(counted, "user_id", "t", "ops")


@query(f"SELECT key, seq, op, i32 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({OE}) e) r WHERE rn = 1")
def q_adjacent_dedupe(spark, sf):
    return ordered.newest_of_runs(src.order_edits(spark, sf))


@query(f"SELECT pivot, CAST(sum(CASE WHEN down THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT pivot, lag(key) OVER (PARTITION BY pivot ORDER BY seq) > key AS down FROM ({OE}) e JOIN ({ROUTES}) r ON key >= lo AND (hi IS NULL OR key < hi)) d GROUP BY pivot")
def q_sortedness(spark, sf):
    """Inversions of the log's order in each range of keys."""
    return ordered.out_of_order(ranges.route(src.order_edits(spark, sf), _pivots(spark, sf)), "pivot", "seq")


@query(f"SELECT batch_id, CAST(floor(log2(xor(batch_id, n))) AS INT) AS level FROM (SELECT DISTINCT seq // 1000 AS batch_id FROM ({OE}) e) b, (SELECT max(o_orderkey) // 1000 + 1 AS n FROM orders) m")
def q_compaction_levels(spark, sf):
    """Where each batch lies after binary-counter merging."""
    b = src.order_edits(spark, sf).select(F.expr("seq div 1000").alias("batch_id")).distinct()
    n = b.agg((F.max("batch_id") + 1).alias("n"))
    return b.join(F.broadcast(n), how="cross").select("batch_id", ordered.level_of(F.col("batch_id"), F.col("n")).alias("level"))


# --- scalar functions


@query("SELECT o_orderkey, CAST(v AS BIGINT) AS back, 4 AS size, lower(hex(b)) AS bytes FROM (SELECT o_orderkey, v, unhex(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS b FROM (SELECT o_orderkey, v, lpad(printf('%X', v & 4294967295), 8, '0') AS h FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) - 250000 AS v FROM orders) a) c) d")
def q_value_codec(spark, sf):
    """Integers encoded as four little-endian bytes and read back."""
    o = src.table(spark, sf, "orders").select("o_orderkey", (F.floor("o_totalprice").cast("long") - 250000).alias("v")).withColumn("b", values.encode_i32(F.col("v")))
    return o.select("o_orderkey", values.as_i32(F.col("b")).alias("back"), F.octet_length("b").alias("size"), F.lower(F.hex("b")).alias("bytes"))


@query("SELECT o_orderkey, CASE WHEN k = 0 THEN 0 WHEN v >= CAST(pow(256, k) AS BIGINT) // 2 THEN v - CAST(pow(256, k) AS BIGINT) ELSE v END AS v FROM (SELECT o_orderkey, k, CAST(coalesce(list_sum(list_transform(range(0, k), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT) * CAST(pow(256, i) AS BIGINT))), 0) AS BIGINT) AS v FROM (SELECT o_orderkey, lpad(printf('%X', CAST(floor(o_totalprice) AS BIGINT) * 7919993), 12, '0') AS h, least(o_orderkey % 7, 4) AS k FROM orders) a) b")
def q_as_i32(spark, sf):
    """Bytes of orders' prices, none to six of them, read as little-endian integers of their length, four at most."""
    h = F.lpad(F.hex(F.floor("o_totalprice").cast("long") * 7919993), 12, "0")
    o = src.table(spark, sf, "orders").select("o_orderkey", F.unhex(F.substring(h, F.lit(1), (F.col("o_orderkey") % 7 * 2).cast("int"))).alias("b"))
    return o.select("o_orderkey", values.as_i32(F.col("b")).alias("v"))


@query(f"SELECT key, seq, CAST((CASE WHEN length(CAST(i32 AS VARCHAR)) <= 8 THEN -9223372036854775808 ELSE 0 END) + CAST(op AS BIGINT) * 281474976710656 + length(CAST(i32 AS VARCHAR)) AS BIGINT) AS tag, CAST(op AS INT) AS op_back, CAST(length(CAST(i32 AS VARCHAR)) AS BIGINT) AS size_back, length(CAST(i32 AS VARCHAR)) <= 8 AS inline_back FROM ({OE}) e")
def q_tag_pack(spark, sf):
    size = F.length(F.col("i32").cast("string"))
    e = src.order_edits(spark, sf).withColumn("tag", values.pack_tag(F.col("op"), size, size <= 8))
    return e.select("key", "seq", "tag", values.tag_op(F.col("tag")).alias("op_back"), values.tag_size(F.col("tag")).alias("size_back"), values.tag_inline(F.col("tag")).alias("inline_back"))


@query("SELECT lo, hi, substr(hi, 1, " + COMMON + " + 1) AS separator FROM (SELECT lag(c_name) OVER (ORDER BY c_name) AS lo, c_name AS hi FROM (SELECT DISTINCT c_name FROM customer) d) n WHERE lo IS NOT NULL")
def q_separator(spark, sf):
    names = src.table(spark, sf, "customer").select(F.col("c_name").alias("key")).distinct()
    ranked = ordered.running_total(names, F.lit(1), "rn")
    prev = ranked.select((F.col("rn") + 1).alias("rn"), F.col("key").alias("lo"))
    return ranked.withColumnRenamed("key", "hi").join(prev, "rn").select("lo", "hi", values.separator("lo", "hi").alias("separator"))


@query()
def q_key_hash(spark, sf):
    """64-bit hashes of the keys, for indexes and for filters; without SQL, tested against another XXH64."""
    return src.order_edits(spark, sf).select("key").distinct().select("key", hashes.index_hash(F.col("key")).alias("h"), hashes.filter_hash(F.col("key")).alias("filter"))


@query(f"SELECT count(*) AS asked, count(*) FILTER (c % 2 = 0) AS present, CAST(0 AS BIGINT) AS missed, true AS few_false FROM (SELECT DISTINCT o_custkey AS c FROM orders) o")
def q_membership_sketch(spark, sf):
    """Keys of even customers in a sketch, which is asked for all: none of them is missed, under 3 % of the others pass."""
    even = src.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(values.user_key(F.col("c_custkey")).alias("key"))
    asked = src.table(spark, sf, "orders").select("o_custkey").distinct().select("o_custkey", values.user_key(F.col("o_custkey")).alias("key"))
    passed = sketch.membership_sketch(even).may_contain(asked).select("o_custkey", F.lit(True).alias("passed"))
    is_in, hit = F.col("o_custkey") % 2 == 0, F.coalesce("passed", F.lit(False))
    counts = asked.join(passed, "o_custkey", "left").agg(F.count(F.lit(1)).alias("asked"), F.count_if(is_in).alias("present"), F.count_if(is_in & ~hit).alias("missed"), F.count_if(~is_in & hit).alias("false"))
    return counts.select("asked", "present", "missed", (F.col("false") <= 0.03 * (F.col("asked") - F.col("present"))).alias("few_false"))


@query(f"SELECT key, md5(key) AS checksum FROM ({CI}) c")
def q_checksum(spark, sf):
    return sets.checksums(src.customer_items(spark, sf))


@query("SELECT bits, CASE WHEN 18.0 / greatest(bits, 12) <= 0.85 THEN 16 ELSE 8 END AS tag_bits, round(least(0.85, CASE WHEN 18.0 / greatest(bits, 12) <= 0.85 THEN CAST(18.0 AS DOUBLE) / greatest(bits, 12) ELSE CAST(10.2 AS DOUBLE) / greatest(bits, 12) END), 9) AS load FROM (SELECT CAST(n_nationkey + 8 AS INT) AS bits FROM nation) b")
def q_filter_sizing(spark, sf):
    b = src.table(spark, sf, "nation").select((F.col("n_nationkey") + 8).cast("int").alias("bits"))
    bits = F.greatest(F.col("bits"), F.lit(12))
    return b.select("bits", numbers.filter_tag_bits(bits.cast("double")).alias("tag_bits"), F.round(numbers.filter_load_factor(F.col("bits")), 9).alias("load"))


@query("SELECT o_orderkey, o_orderkey * 65536 + 7 AS locator, o_orderkey AS block, 7 AS slot, o_orderkey * 65536 AS memtable, o_orderkey AS batch FROM orders")
def q_id_math(spark, sf):
    o = src.table(spark, sf, "orders").select("o_orderkey").withColumns({"locator": numbers.slot_locator(F.col("o_orderkey"), F.lit(7)), "memtable": numbers.memtable_of(F.col("o_orderkey"))})
    return o.select("o_orderkey", "locator", numbers.locator_block(F.col("locator")).alias("block"), numbers.locator_slot(F.col("locator")).cast("int").alias("slot"), "memtable", numbers.batch_of(F.col("memtable")).alias("batch"))


@query("SELECT o_orderkey, CAST((b - a + 4294967296) % 4294967296 BETWEEN 1 AND 2147483647 AS BOOLEAN) AS before FROM (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS a, (o_orderkey * 40503 + 4294967000) % 4294967296 AS b FROM orders) c")
def q_circular_order(spark, sf):
    o = src.table(spark, sf, "orders").select("o_orderkey", F.expr("o_orderkey * 2654435761L % 4294967296L").alias("a"), F.expr("(o_orderkey * 40503L + 4294967000L) % 4294967296L").alias("b"))
    return o.select("o_orderkey", numbers.circular_less(F.col("a"), F.col("b")).alias("before"))


@query("SELECT doc_id, n, CASE WHEN n <= 32768 THEN CAST(pow(2, ceil(log2(greatest(n, 1)))) AS BIGINT) ELSE CAST(ceil(n / 32768.0) AS BIGINT) * 32768 END AS buffer FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents) d")
def q_buffer_sizes(spark, sf):
    d = src.table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return d.select("doc_id", "n", numbers.buffer_size(F.col("n")).cast("long").alias("buffer"))


@query("SELECT o_orderkey, CAST(bit_count(o_orderkey & 1023) AS INT) AS rank, CAST((o_orderkey >> 3) & 1 AS INT) AS bit3, o_orderkey | 32 AS with5, CAST(CASE WHEN o_orderkey = 0 THEN -1 ELSE bit_count((o_orderkey & -o_orderkey) - 1) END AS INT) AS first FROM orders")
def q_bitset(spark, sf):
    c = F.col("o_orderkey")
    return src.table(spark, sf, "orders").select(c, numbers.bit_rank(c, 10).alias("rank"), numbers.bit_test(c, 3).alias("bit3"), numbers.bit_set(c, 5).alias("with5"), numbers.first_bit(c).alias("first"))


@query(f"SELECT key, '0x' || lower(hex(encode(value))) AS lit, '[' || key || ', ' || value || ')' AS shown FROM ({CI}) c")
def q_render(spark, sf):
    c = src.customer_items(spark, sf)
    return c.select("key", values.hex_literal(F.encode("value", "UTF-8")).alias("lit"), values.range_text(F.col("key"), F.col("value")).alias("shown"))


@query(f"SELECT c_custkey, {K.format('c_custkey')} AS key, length({K.format('c_custkey')}) AS size FROM customer")
def q_generate_keys(spark, sf):
    k = values.user_key(F.col("c_custkey"))
    return src.table(spark, sf, "customer").select("c_custkey", k.alias("key"), F.length(k).cast("long").alias("size"))


# --- sources

SCRIPT = f"SELECT o_orderkey * 2 AS at, 'P ' || {K.format('o_custkey')} || ' ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS line FROM orders UNION ALL SELECT o_orderkey * 2 + 1, 'G ' || {K.format('(o_custkey * 7 + 3) % 1500')} FROM orders"


def _script(spark, sf):
    o = src.table(spark, sf, "orders")
    price = F.floor("o_totalprice").cast("long").cast("string")
    puts = o.select((F.col("o_orderkey") * 2).alias("at"), F.concat_ws(" ", F.lit("P"), values.user_key(F.col("o_custkey")), price).alias("value"))
    gets = o.select((F.col("o_orderkey") * 2 + 1).alias("at"), F.concat_ws(" ", F.lit("G"), values.user_key((F.col("o_custkey") * 7 + 3) % 1500)).alias("value"))
    return src.parse_workload(puts.unionByName(gets), at="at")


@query(f"WITH s AS (SELECT at, split_part(line, ' ', 1) AS op, split_part(line, ' ', 2) AS key, nullif(split_part(line, ' ', 3), '') AS value FROM ({SCRIPT}) l) SELECT g.at, g.op, g.key, (SELECT max_by(p.value, p.at) FROM s p WHERE p.op = 'P' AND p.key = g.key AND p.at < g.at) AS found FROM s g WHERE g.op = 'G'")
def q_workload_replay(spark, sf):
    """A script of puts and gets: every get sees the put before it."""
    return script.answer_gets(_script(spark, sf)).drop("expected")


SCANS = f"SELECT o_orderkey * 2 + 1 AS at, {K.format('(o_custkey * 7 + 3) % 1500')} AS key, CAST(o_orderkey % 37 AS INT) AS n FROM orders WHERE o_orderkey % 50 = 0"


def _scan_script(spark, sf):
    """Orders as puts; every fiftieth is followed by a scan of up to 36 rows."""
    o = src.table(spark, sf, "orders")
    puts = o.select((F.col("o_orderkey") * 2).alias("at"), F.concat_ws(" ", F.lit("P"), values.user_key(F.col("o_custkey")), F.floor("o_totalprice").cast("long").cast("string")).alias("value"))
    scans = o.where("o_orderkey % 50 = 0").select((F.col("o_orderkey") * 2 + 1).alias("at"), F.concat_ws(" ", F.lit("S"), values.user_key((F.col("o_custkey") * 7 + 3) % 1500), (F.col("o_orderkey") % 37).cast("string")).alias("value"))
    return src.parse_workload(puts.unionByName(scans), at="at")


@query(f"WITH p AS (SELECT o_orderkey * 2 AS at, {K.format('o_custkey')} AS key, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS value FROM orders), s AS ({SCANS}), k AS (SELECT s.at, s.n, p.key, max_by(p.value, p.at) AS value FROM s JOIN p ON p.key >= s.key AND p.at < s.at GROUP BY s.at, s.n, p.key), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY at ORDER BY key) - 1 AS INT) AS rank FROM k) SELECT at, rank, key, value FROM r WHERE rank < n")
def q_workload_scans(spark, sf):
    """A script of puts and scans: every scan sees the puts before it, in key order."""
    return script.answer_scans(_scan_script(spark, sf))


@query(f"SELECT op, count(*) AS n, count(DISTINCT key) AS keys FROM (SELECT split_part(line, ' ', 1) AS op, split_part(line, ' ', 2) AS key FROM ({SCRIPT}) l) s GROUP BY op")
def q_workload_parse(spark, sf):
    return _script(spark, sf).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


@query("SELECT doc_id, CAST(i AS INT) AS at, substr(text, CAST(i + 1 AS BIGINT), 24) AS key, substr(text, CAST(i + 1 AS BIGINT), 100) AS value FROM (SELECT doc_id, text, unnest(range(0, length(text) - 99, 100)) AS i FROM documents WHERE length(text) >= 100) w")
def q_byte_windows(spark, sf):
    return src.byte_windows(src.table(spark, sf, "documents").select("doc_id", "text"), "text", step=100).select("doc_id", "at", "key", "value")


@query()
def q_byte_windows_all(spark, sf):
    """A window at every place of every text, as the reference has them; q_byte_windows takes every hundredth, as its SQL does."""
    return src.byte_windows(src.table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "at", "key", "value")


@query("SELECT o_orderpriority AS workload, CAST(o_custkey % 32 AS INT) AS threads, CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) AS kops, CAST(NULL AS DOUBLE) AS latency_us FROM (SELECT replace(o_orderpriority, ' ', '_') AS o_orderpriority, o_custkey, o_totalprice FROM orders) o")
def q_result_log(spark, sf):
    """Result lines written from orders, and parsed."""
    o = src.table(spark, sf, "orders")
    line = F.concat(F.lit("[out] workload="), F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.lit(" threads="), (F.col("o_custkey") % 32).cast("string"), F.lit(" kops="), F.floor("o_totalprice").cast("long").cast("string"))
    return src.parse_results(o.select(line.alias("value")))


@query("SELECT c_custkey AS id, substr('_abcdefghijklmnopqrstuvwxyz', CAST((c_custkey + 1) % 27 + 1 AS BIGINT), 1) || substr('_abcdefghijklmnopqrstuvwxyz', CAST((c_custkey + 1) // 27 % 27 + 1 AS BIGINT), 1) || substr('_abcdefghijklmnopqrstuvwxyz', CAST((c_custkey + 1) // 729 % 27 + 1 AS BIGINT), 1) || substr('_abcdefghijklmnopqrstuvwxyz', CAST((c_custkey + 1) // 19683 % 27 + 1 AS BIGINT), 1) || '____' AS value FROM customer")
def q_generate_values(spark, sf):
    """The odometer's values of eight places."""
    return src.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), values.sequential_text(F.col("c_custkey"), 8).alias("value"))


@query("SELECT CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS keys, CAST(24 AS INT) AS key_size, CAST(50 AS INT) AS value_size, CAST(1 AS INT) AS letters")
def q_generate_result_set(spark, sf):
    """A thousand random items: distinct keys, values of one letter."""
    g = generators.result_set(spark, 1000, seed=3, value_size=50)
    letters = F.length(F.regexp_replace("value", r"(.)\1+", "$1"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"), F.max(F.length("key")).alias("key_size"), F.max(F.length("value")).alias("value_size"), F.max(letters).alias("letters"))


@query("SELECT replace(o_orderpriority, ' ', '_') AS workload, CAST(o_custkey % 32 AS INT) AS threads, CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) AS kops, CAST(NULL AS DOUBLE) AS latency_us FROM orders")
def q_result_sink(spark, sf):
    """Results written as lines and read back."""
    path = scratch(spark, "results")
    runs = src.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("workload"), (F.col("o_custkey") % 32).cast("int").alias("threads"), F.floor("o_totalprice").cast("double").alias("kops"), F.lit(None).cast("double").alias("latency_us"))
    src.write_results(runs, path)
    return src.parse_results(spark.read.text(path))


# --- store and streaming


def _filled(spark, sf, chi: int, parts: int = 5, policy: str = "levelled", min_flush: int = 64 << 20) -> Store:
    e = src.order_edits(spark, sf)
    n = e.agg(F.max("seq")).first()[0]
    store = Store.create(spark, f"{scratch(spark, 'store')}/s", StoreOptions(chi=chi, policy=policy, min_flush=min_flush))
    for p in range(parts):
        store.append(e.where(F.expr(f"seq * {parts} div {(n or 0) + 1} = {p}")), p)
    return store


@query(f"SELECT key, i32, seq FROM ({ITEMS}) i")
def q_store_items(spark, sf):
    """Five batches through a store with chi 2: snapshot and deltas."""
    return Store.open(spark, _filled(spark, sf, 2).path).items().select("key", "i32", "seq")


@query(f"SELECT key, op, i32, seq FROM ({FOLD}) f")
def q_store_winners(spark, sf):
    """Raw winners from deltas alone, deletes shown."""
    return _filled(spark, sf, 100).winners().select("key", "op", "i32", "seq")


@query(f"SELECT key, i32, seq FROM ({ITEMS}) i WHERE key >= '{_key(700)}' ORDER BY key LIMIT 50")
def q_store_scan(spark, sf):
    """A limited scan that reads only the files it needs."""
    store = _filled(spark, sf, 3, policy="tiered")
    store.force_checkpoint()
    return store.scan(_key(700), 50).select("key", "i32", "seq")


@query(f"SELECT key, op, i32, seq FROM ({fold_sql(f'SELECT * FROM ({OE}) e WHERE seq * 5 // (SELECT max(o_orderkey) + 1 FROM orders) < 3')}) f WHERE op IN (2, 3, 4)")
def q_checkpoint_scan(spark, sf):
    """The snapshot alone: the last two of five batches are not in it."""
    return _filled(spark, sf, 3).checkpoint_items().select("key", "op", "i32", "seq")


@query(f"SELECT key, i32, seq FROM ({ITEMS}) i")
def q_stream_ingest(spark, sf):
    """Files of edits streamed into a store, two files a batch."""
    feed = scratch(spark, "feed")
    e = src.order_edits(spark, sf).withColumn("value", F.lit(None).cast("string"))
    n = (e.agg(F.max("seq")).first()[0] or 0) + 1
    for p in range(4):  # in order: a file's edits are newer than those of the files before
        e.where(F.expr(f"seq * 4 div {n} = {p}")).coalesce(1).write.mode("append").parquet(feed)
    store = Store.create(spark, f"{scratch(spark, 'streamed')}/s", StoreOptions(chi=2))
    ingest.ingest(ingest.edit_stream(spark, feed, files_per_trigger=1), store, scratch(spark, "offsets")).awaitTermination()
    return Store.open(spark, store.path).items().select("key", "i32", "seq")


@query(f"SELECT key, i32, seq FROM ({ITEMS}) i")
def q_store_flush_range(spark, sf):
    """A snapshot of two batches; the fullest ranges of the later three move down one by one, the last ones stay deltas."""
    e = src.order_edits(spark, sf)
    n = (e.agg(F.max("seq")).first()[0] or 0) + 1
    store = Store.create(spark, f"{scratch(spark, 'store')}/s", StoreOptions(chi=100, policy="tiered", max_records_per_file=max(1, n // 20)))
    for p in range(5):
        store.append(e.where(F.expr(f"seq * 5 div {n} = {p}")), p)
        if p == 1:
            store.force_checkpoint()
    store.flush_fullest()
    store.flush_fullest()
    return Store.open(spark, store.path).items().select("key", "i32", "seq")


@query(f"SELECT key, i32, seq FROM ({ITEMS}) i")
def q_store_pivot_policy(spark, sf):
    """Batches through a store that moves a range down as soon as enough of its bytes wait."""
    return _filled(spark, sf, 4, parts=3, policy="pivot", min_flush=2000).items().select("key", "i32", "seq")


FEW = f"SELECT {K.format('s_suppkey')} AS key, s_name AS value, s_suppkey AS n FROM supplier WHERE s_suppkey < 100"


def _put_few(spark, sf, chi: int = 2) -> Store:
    """Suppliers below 100 put one by one, in two batches; each fifth removed, each third put again."""
    rows = src.table(spark, sf, "supplier").where("s_suppkey < 100").select(values.user_key(F.col("s_suppkey")).alias("key"), "s_name", "s_suppkey").orderBy("s_suppkey").collect()
    store = Store.create(spark, f"{scratch(spark, 'store')}/s", StoreOptions(chi=chi))
    for r in rows:
        store.put(r.key, r.s_name)
    store.flush()
    for r in rows:
        if r.s_suppkey % 5 == 0:
            store.remove(r.key)
        elif r.s_suppkey % 3 == 0:
            store.put(r.key, "again")
    store.flush()
    return store


PUT = f"SELECT key, CASE WHEN n % 3 = 0 THEN 'again' ELSE value END AS value FROM ({FEW}) f WHERE n % 5 <> 0"


@query(f"SELECT key, op, i32, seq, CAST(1 AS INT) AS level FROM ({fold_sql(f'SELECT * FROM ({OE}) e WHERE seq * 3 // (SELECT max(o_orderkey) + 1 FROM orders) < 2')}) f UNION ALL SELECT key, op, i32, seq, CAST(0 AS INT) FROM ({fold_sql(f'SELECT * FROM ({OE}) e WHERE seq * 3 // (SELECT max(o_orderkey) + 1 FROM orders) = 2')}) g")
def q_store_levels(spark, sf):
    """Three batches merged as a binary counter carries: the first two on level 1, the third on level 0, each read alone."""
    store = _filled(spark, sf, 100, parts=3)
    level = lambda k: store.level(k).select("key", "op", "i32", "seq", F.lit(k).alias("level"))
    return level(1).unionByName(level(0))


@query(PUT)
def q_store_put_remove(spark, sf):
    """Puts and removes through the store's own calls."""
    return _put_few(spark, sf).items().select("key", "value")


@query(f"SELECT key, value FROM ({PUT}) p WHERE key = '{_key(7)}'")
def q_store_get(spark, sf):
    r = _put_few(spark, sf).get(_key(7))
    return spark.createDataFrame([(r.key, r.value)] if r else [], "key string, value string")


@query(f"SELECT key, value FROM ({PUT}) p WHERE key IN ({PROBES})")
def q_store_multi_get(spark, sf):
    return _put_few(spark, sf).multi_get(_probes(spark, sf)).select("key", "value")


@query(f"SELECT key, value, CAST(2 AS BIGINT) AS batches, CAST(1 AS BIGINT) AS checkpoints FROM ({PUT}) p")
def q_store_set_chi(spark, sf):
    """Two batches wait with chi 100; chi 1 takes effect at once, so the snapshot alone has all items."""
    store = _put_few(spark, sf, chi=100)
    store.set_chi(1)
    m = store.metrics()
    return store.checkpoint_items().select("key", "value", F.lit(m["batches"]).cast("long").alias("batches"), F.lit(m["checkpoints"]).cast("long").alias("checkpoints"))


@query(f"WITH f AS (SELECT DISTINCT key, seq * 5 // (SELECT max(o_orderkey) + 1 FROM orders) AS part FROM ({OE}) e), c AS ({fold_sql(f'SELECT * FROM ({OE}) e WHERE seq * 5 // (SELECT max(o_orderkey) + 1 FROM orders) < 4')}) SELECT CAST(count(DISTINCT part) AS BIGINT) AS batches, CAST(count(DISTINCT part) // 2 AS BIGINT) AS checkpoints, CAST(count(DISTINCT part) % 2 AS BIGINT) AS deltas, CAST(max(part) AS BIGINT) AS upper, count(*) AS edits, count(*) FILTER (part = 4) AS delta_rows, (SELECT count(*) FROM c WHERE op IN (2, 3, 4)) AS snapshot_rows FROM f")
def q_store_metrics(spark, sf):
    """Counters of a store that five batches went through with chi 2."""
    names = ("batches", "checkpoints", "deltas", "upper", "edits", "delta_rows", "snapshot_rows")
    m = _filled(spark, sf, 2).metrics()
    return spark.createDataFrame([tuple(m[k] for k in names)], ", ".join(f"{k} bigint" for k in names))


SIXTHS = "seq * 6 // (SELECT max(o_orderkey) + 1 FROM orders)"


@query(f"SELECT CAST(b AS BIGINT) AS batch, CAST((b + 1) // 3 AS BIGINT) AS checkpoints, CAST((b + 1) % 3 AS BIGINT) AS deltas, CASE (b + 1) // 3 WHEN 0 THEN 0 WHEN 1 THEN (SELECT count(*) FROM ({fold_sql(f'SELECT * FROM ({OE}) e WHERE {SIXTHS} < 3')}) f WHERE op IN (2, 3, 4)) ELSE (SELECT count(*) FROM ({ITEMS}) i) END AS snapshot_rows FROM (SELECT DISTINCT {SIXTHS} AS b FROM ({OE}) e) d")
def q_store_checkpoints(spark, sf):
    """What a store with chi 3 holds after each of six batches: a checkpoint after every third."""
    e = src.order_edits(spark, sf)
    n = (e.agg(F.max("seq")).first()[0] or 0) + 1
    store, rows = Store.create(spark, f"{scratch(spark, 'store')}/s", StoreOptions(chi=3, policy="tiered")), []
    for b in range(6):
        store.append(e.where(F.expr(f"seq * 6 div {n} = {b}")), b)
        m = store.metrics()
        rows.append((b, m["checkpoints"], m["deltas"], m["snapshot_rows"]))
    return spark.createDataFrame(rows, "batch bigint, checkpoints bigint, deltas bigint, snapshot_rows bigint")


def _streamed(spark, sf, name: str, build, columns: list[str]) -> DataFrame:
    """What a streaming query over a table's rows, as Parquet files in the shared folder, has written when it ends."""
    feed, out = scratch(spark, "feed"), f"{scratch(spark, 'live')}/rows"
    rows = src.table(spark, sf, name).select(*columns)
    rows.repartition(3).write.mode("append").parquet(feed)
    stream = build(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(feed))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"SELECT key, max_by(op, seq) AS op, max_by(i32, seq) AS i32, max(seq) AS seq FROM ({OE}) e GROUP BY key")
def q_live_latest(spark, sf):
    """The newest edit of each key as streaming state, whatever the order of the files."""
    return _streamed(spark, sf, "orders", lambda o: ingest.live_latest(src.as_order_edits(o)), ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"])


@query(f"SELECT key, CAST(sum(i32) AS BIGINT) AS i32 FROM ({OE}) e WHERE op = 3 GROUP BY key")
def q_add_counters(spark, sf):
    """Sums of the adds of each key as streaming state."""
    return _streamed(spark, sf, "orders", lambda o: ingest.add_counters(src.as_order_edits(o)), ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_windowed_counts(spark, sf):
    """Events by hour and type, in windows that close behind a watermark of 3,650 days, so that none is late."""
    counts = lambda e: ingest.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", late="3650 days")
    return _streamed(spark, sf, "events", counts, ["ts", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in REGISTRY.items() if s}
