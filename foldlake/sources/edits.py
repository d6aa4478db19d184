"""Edit logs from tables, workload scripts, byte windows and result logs, which are written as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import user_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(c: str) -> Column:
    return F.floor(F.col(c)).cast("long")


def order_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edits of their customers: status F writes, O adds, others delete."""
    return as_order_edits(table(spark, sf_dir, "orders"))


def as_order_edits(orders: DataFrame) -> DataFrame:
    """The same for a table or a stream of orders."""
    op = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 3).otherwise(0)
    return orders.select(user_key(F.col("o_custkey")).alias("key"), F.col("o_orderkey").alias("seq"), op.alias("op"), _whole("o_totalprice").alias("i32"))


def event_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of (user, k): signup writes, purchase and click add, error deletes; views are reads."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    op = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type").isin("purchase", "click"), 3).otherwise(0)
    k = F.get_json_object("props", "$.k")
    return e.select(F.concat(user_key(F.col("user_id")), F.lit("/"), k).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), _whole("value").alias("i32"))


def customer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as written items with a payload."""
    return table(spark, sf_dir, "customer").select(user_key(F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("seq"), F.lit(2).alias("op"), F.col("c_name").alias("value"))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("key"), F.col("doc_id").alias("seq"), F.lit(2).alias("op"), F.col("text").alias("value"))


def parse_workload(lines: DataFrame, line: str = "value", at: str | None = None) -> DataFrame:
    """Script lines -> (at, op, key, value, n, want).

    P key value (put), G key (get), T key expected (get and check), S min_key n (scan), V min_key n r (key value)*r (scan
    and check), L label. Columns that an op has not are null; ``want`` holds V's pairs as an array.
    """
    w, op = F.col("__words"), F.col("__words")[0]
    # exploded from an array of one: below a generator nothing is computed twice, where filters on op would each split the line again
    words = lines.select(*([F.col(at).alias("at")] if at else []), F.explode(F.array(F.split(F.trim(F.col(line)), r"\s+"))).alias("__words"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(w[3].cast("int"), F.lit(1)) - 1), lambda i: F.struct(F.get(w, F.lit(4) + i * 2).alias("key"), F.get(w, F.lit(5) + i * 2).alias("value")))
    return words.where(op.isin("P", "G", "T", "S", "V", "L")).select(
        *(["at"] if at else []),
        op.alias("op"),
        F.when(op != "L", F.get(w, F.lit(1))).alias("key"),
        F.when(op.isin("P", "T"), F.get(w, F.lit(2))).when(op == "L", F.get(w, F.lit(1))).alias("value"),
        F.when(op.isin("S", "V"), F.get(w, F.lit(2)).cast("int")).alias("n"),
        F.when((op == "V") & (F.get(w, F.lit(3)) != "0"), pairs).alias("want"),
    )


#: Windows in a block: more of them share a middle, but each walks further in what is before and after it.
BLOCK = 16


def byte_windows(blobs: DataFrame, text: str, key_size: int = 24, value_size: int = 100, step: int = 1) -> DataFrame:
    """Sliding windows over each text: key and value both begin at every ``step``-th place with room for both.

    In ASCII a window is a range of the text's bytes. Else ``BLOCK`` neighbours are joined from what they share and a few
    characters before and after it, so that no window is decoded or walked to its end by itself.
    """
    long, short = max(key_size, value_size), min(key_size, value_size)
    span = step * max(1, min(BLOCK, long) // step)
    last = span - step  # where a block's last window begins
    ascii = F.is_valid_utf8(text) & (F.octet_length(text) == F.length(text))
    # four bytes a character: a block is found by its place, where a text in UTF-8 would be walked from its start
    wide = blobs.withColumns({"__ascii": ascii, "__ends": F.length(text) - F.lit(long), "__bytes": F.when(ascii, F.col(text).cast("binary")), "__wide": F.when(~ascii, F.encode(F.col(text), "UTF-32"))})
    cut = lambda start, n: F.when(~F.col("__ascii"), F.decode(F.substring("__wide", (F.col("__from") + start) * 4 + 1, F.lit(4 * n)), "UTF-32"))
    blocks = wide.select("*", F.explode(F.when(F.col("__ends") >= 0, F.sequence(F.lit(0), "__ends", F.lit(span)))).alias("__from"))
    blocks = blocks.withColumns({"__before": cut(0, last), "__shared": cut(last, long - last), "__after": cut(long, last)})
    windows = blocks.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(last), F.col("__ends") - F.col("__from")), F.lit(step))).alias("__in"))
    windows = windows.withColumn("at", F.col("__from") + F.col("__in"))
    part = lambda n: F.substring("__bytes", F.col("at") + 1, F.lit(n)).cast("string")
    joined = F.concat(F.substr("__before", F.col("__in") + 1), "__shared", F.substring("__after", F.lit(1), F.col("__in")))
    windows = windows.withColumn("__long", F.when(F.col("__ascii"), part(long)).otherwise(joined))
    windows = windows.withColumn("__short", F.when(F.col("__ascii"), part(short)).otherwise(F.substring("__long", 1, short)))
    key, value = ("__short", "__long") if key_size < value_size else ("__long", "__short")
    return windows.withColumns({"key": F.col(key), "value": F.col(value)}).drop("__ascii", "__ends", "__bytes", "__wide", "__from", "__before", "__shared", "__after", "__in", "__long", "__short")


def write_results(runs: DataFrame, path: str) -> None:
    """Rows of results as lines of 'name=value' fields, which ``parse_results`` reads back; nulls are left out. Further
    files are added to those in ``path``."""
    parts = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\s", "_"))) for c in runs.columns]
    runs.select(F.concat_ws(" ", F.lit("[out]"), *parts).alias("value")).write.mode("append").text(path)


def parse_results(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines of 'name=value' fields -> workload, threads, kops, latency; null where a field is missing."""
    field = lambda name, kind: F.nullif(F.regexp_extract(line, rf"\b{name}=([^\s]+)", 1), F.lit("")).cast(kind).alias(name)
    return lines.select(field("workload", "string"), field("threads", "int"), field("kops", "double"), field("latency_us", "double"))
