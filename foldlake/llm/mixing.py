"""Mixing sources to target weights: a Pfair schedule, in DataFrame operations only.

Documents of a source, in the order of their ids' MD5, form blocks of BLOCK rows. Weights become whole shares a of a
period of A slots (largest remainders, one share at least), so w = a / A. Block j of a source (from 0) is released at slot
floor(j / w) and due by slot ceil((j + 1) / w); at each slot the released block with the earliest deadline goes (equal
deadlines: the source that sorts first). As the shares fill the period, no deadline is missed and in front of every slot
t each source is less than one block from w * t, while it lasts; slots of a source that has run out stay empty.

The schedule repeats each period, so it is worked out once for A slots and joined to the blocks; it has as many rows as
the resolution (or the number of sources, if that is larger), whatever the corpus, and is broadcast up to SMALL rows, by a
count. Its fold takes A steps in one task, each over the sources with more than one share: 10,000 sources take 2 s, 50,000
take 14 s, and it is not meant for millions. Ranks within
a source come from counts of (id, salt) summed in 4,096 ranges of the hash: no source, however large, is sorted in one
task, and rows that share an id, or have none, are spread by a hash of their other columns.

Defined cases: a null source counts as the source ''; rows that repeat a doc_id are ranked in any order among
themselves; a null doc_id hashes as ''. Sources without a target weight get the smallest share. An empty table gives no
rows. Texts are passed on whole and not looked into; the documents' columns stay inside one column, so that no name
can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import cut, table

BLOCK, RESOLUTION, TEMPER = 16, 1000, 0.5
#: Rows of a schedule that is broadcast; parts that rows with one id are dealt to.
SMALL, SALTS = 1_000_000, 64


def shares(docs: DataFrame, weights: DataFrame | None = None, resolution: int = RESOLUTION, temper: float = TEMPER) -> DataFrame:
    """(src, a): whole shares of the period. ``weights`` is (source, weight); else a source of n rows weighs n ** temper."""
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        raw = counts.select("src", (F.sqrt("n") if temper == 0.5 else F.pow("n", F.lit(temper))).alias("w"))
    else:
        given = weights.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src")).agg(F.sum("weight").alias("w"))
        raw = counts.join(given, "src", "left").select("src", F.coalesce("w", F.lit(0.0)).alias("w"))
    everything = Window.partitionBy(F.lit(1))  # a row for each source
    exact = resolution * F.col("w") / F.greatest(F.sum("w").over(everything), F.lit(1e-300))
    q = raw.select("src", exact.alias("x")).select("src", F.greatest(F.lit(1), F.floor("x")).cast("long").alias("f"), (F.col("x") - F.floor("x")).alias("r"))
    rest = resolution - F.sum("f").over(everything)
    return q.select("src", "f", "r", rest.alias("m"), F.row_number().over(everything.orderBy(F.desc("r"), "src")).alias("k")).select("src", (F.col("f") + (F.col("k") <= F.col("m")).cast("long")).alias("a"))


def schedule(parts: DataFrame) -> DataFrame:
    """(src, a, period, k, slot): where the k-th block (from 0) of each source goes within a period.

    Sources with a share of one have a single block, released at once and due at the period's end: they wait in one queue,
    in the order of their names, so that a step looks at its head and at the sources with larger shares, of which there are
    no more than the resolution, however many sources there are."""
    one = parts.agg(F.sort_array(F.collect_list(F.struct("src", "a"))).alias("s"), F.sum("a").alias("period")).where("period > 0")
    split = one.select("s", "period", F.expr("filter(transform(s, (x, i) -> named_struct('a', x.a, 'i', i)), x -> x.a > 1)").alias("h"), F.expr("filter(transform(s, (x, i) -> if(x.a = 1, i, null)), i -> i is not null)").alias("q"))
    step = """
      aggregate(sequence(0L, period - 1), named_struct('c', transform(h, x -> 0L), 'p', 0, 'o', cast(array() as array<int>)),
        (st, t) -> element_at(transform(array(least(
            array_min(transform(h, (x, j) ->
              if(st.c[j] < x.a and st.c[j] * period div x.a <= t,
                 named_struct('due', ((st.c[j] + 1) * period + x.a - 1) div x.a, 'i', x.i, 'j', j), null))),
            if(st.p < size(q), named_struct('due', period, 'i', get(q, st.p), 'j', -1), null))),
          b -> named_struct('c', if(b.j < 0, st.c, transform(st.c, (n, j) -> if(j = b.j, n + 1, n))), 'p', if(b.j < 0, st.p + 1, st.p),
                            'o', concat(st.o, array(b.i)))), 1),
        st -> st.o)"""
    slots = split.select("s", "period", F.posexplode(F.expr(step)).alias("slot", "i"))
    return slots.select(F.expr("s[i].src").alias("src"), F.expr("s[i].a").alias("a"), "period", F.col("slot").cast("long").alias("slot"), (F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1).cast("long").alias("k"))


def ranked(docs: DataFrame) -> DataFrame:
    """(src, rank, row): the place of each row in its source, from 0, by the MD5 of its id; row has the columns of ``docs``."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    src, order = F.coalesce(F.col("source").cast("string"), F.lit("")), F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(src.alias("src"), order.alias("order"), F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int").alias("salt"), F.struct("*").alias("row"))
    keys = rows.groupBy("src", "order", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.substring(F.hex("order"), 1, 3))
    sizes = keys.groupBy("src", "bucket").agg(F.sum("n").alias("size"))
    ahead = sizes.select("src", "bucket", (F.sum("size").over(Window.partitionBy("src").orderBy("bucket")) - F.col("size")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("src", "bucket").orderBy("order", "salt")) - F.col("n")
    places = keys.withColumn("inside", inside).join(ahead, ["src", "bucket"]).select("src", "order", "salt", (F.col("ahead") + F.col("inside")).alias("place"))
    nth = F.row_number().over(Window.partitionBy("src", "order", "salt").orderBy("place")) - 1
    return rows.join(places, ["src", "order", "salt"]).select("src", (F.col("place") + nth).alias("rank"), "row")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, resolution: int = RESOLUTION) -> DataFrame:
    """(src, block, slot, pos, row) for each of ``docs``: the order is slot, then pos; row has the columns of ``docs``."""
    plan = cut(schedule(shares(docs, weights, resolution)))
    few = plan.count() <= SMALL
    small = F.broadcast if few else lambda df: df
    length = plan.select("src", "a", "period").distinct()  # a row for each source
    slots = plan.select("src", "k", F.col("slot").alias("within"))  # a row for each slot of a period
    return (
        ranked(docs)
        .withColumns({"block": F.floor(F.col("rank") / block), "pos": F.col("rank") % block})
        .join(small(length), "src")
        .withColumn("k", F.col("block") % F.col("a"))
        .join(small(slots), ["src", "k"])
        .select("src", "block", (F.expr("block div a") * F.col("period") + F.col("within")).alias("slot"), "pos", "row")
    )


def in_order(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The rows and columns of ``docs``, in the order of the schedule."""
    return mix(docs, weights).orderBy("slot", "pos").select("row.*")


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return mix(docs).select(F.col("row.doc_id").alias("doc_id"), F.col("src").alias("source"), "block", "slot", F.col("pos").cast("long").alias("pos"))


SQL = f"""
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS src, count(*) AS c FROM documents GROUP BY 1),
w AS (SELECT src, {RESOLUTION} * sqrt(c) / sum(sqrt(c)) OVER () AS x FROM n),
q AS (SELECT src, CAST(greatest(1, floor(x)) AS BIGINT) AS f, x - floor(x) AS r FROM w),
p AS (SELECT src, f, r, {RESOLUTION} - sum(f) OVER () AS m FROM q),
a AS (SELECT src, CAST(f + CASE WHEN row_number() OVER (ORDER BY r DESC, src) <= m THEN 1 ELSE 0 END AS BIGINT) AS a,
        row_number() OVER (ORDER BY src) AS i FROM p),
s AS (SELECT list(a ORDER BY i) AS a, CAST(sum(a) AS BIGINT) AS period FROM a),
e(t, c, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM s
  UNION ALL
  SELECT t, list_transform(c, lambda n, i: CASE WHEN i = pick THEN n + 1 ELSE n END), pick FROM (
    SELECT e.t + 1 AS t, e.c AS c, list_min(list_transform(s.a, lambda x, i:
        CASE WHEN e.c[i] < x AND e.c[i] * s.period // x <= e.t + 1
             THEN ((e.c[i] + 1) * s.period + x - 1) // x * 1000000 + i END)) % 1000000 AS pick
    FROM e, s WHERE e.t + 1 < s.period) u),
k AS (SELECT src, a, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM e JOIN a ON a.i = e.pick WHERE t >= 0),
d AS (SELECT doc_id, coalesce(source, '') AS src,
        row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r FROM documents)
SELECT doc_id, d.src AS source, CAST(r // {BLOCK} AS BIGINT) AS block,
  CAST(r // {BLOCK} // a.a * s.period + k.t AS BIGINT) AS slot, CAST(r % {BLOCK} AS BIGINT) AS pos
FROM d JOIN a ON a.src = d.src CROSS JOIN s JOIN k ON k.src = d.src AND k.k = (r // {BLOCK}) % a.a
"""
