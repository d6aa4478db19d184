"""Workload scripts replayed as sets: every read sees the puts before it."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .ordered import CHUNK, carried, running_total
from .ranges import route

#: Keys that a scan looks at together.
GROUP = 256
#: Scans that a copy of a group's keys serves; pairs of a scan and a group, or keys, that go to all tasks.
LOAD, FEW = 4096, 1 << 16


def _last_put(lines: DataFrame, chunk: int = CHUNK, span: int | None = None) -> DataFrame:
    """``lines`` with ``found``: the value last put to the key in front of each; hot keys are split. ``span``: of times, if known."""
    put = F.when(F.col("op") == "P", F.col("value"))
    # a part's own row counts as well, but only answers are looked at, and they put nothing
    both = carried(lines, "key", "at", F.last(put, ignorenulls=True), F.max_by(put, F.when(F.col("op") == "P", F.col("at"))), lambda end: F.last(end, ignorenulls=True), chunk, span)
    return both.withColumn("found", F.coalesce("__inside", "__carry")).drop("__inside", "__carry")


def answer_gets(script: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(at, op, key, found, expected) for each G or T line: the value last put before it, null if none."""
    lines = script.where("op IN ('P', 'G', 'T')").select("at", "op", "key", "value")
    return _last_put(lines, chunk).where("op <> 'P'").select("at", "op", "key", "found", F.col("value").alias("expected"))


def check_gets(script: DataFrame) -> DataFrame:
    """T lines whose answer is not the expected one."""
    return answer_gets(script).where((F.col("op") == "T") & ~F.col("found").eqNullSafe(F.col("expected")))


def _met(asks: DataFrame, groups: DataFrame, n: int, few: int) -> DataFrame:
    """``asks`` with the keys of their group. Few asks go to all groups; else a group with many asks is dealt out in copies,
    one for each LOAD asks, so that no task has all asks of a hot group."""
    if n <= few:
        return groups.select("group", "keys").join(F.broadcast(asks), "group")
    copies = asks.groupBy("group").agg(F.count(F.lit(1)).alias("__copies")).withColumn("__copies", F.expr(f"cast((__copies - 1) div {LOAD} + 1 as int)"))
    dealt = asks.join(copies, "group").withColumn("__copy", F.pmod(F.xxhash64("at"), "__copies").cast("int")).drop("__copies")
    asked = groups.select("group", "keys").join(copies, "group").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")
    parts = min(n // LOAD + 1, 8192)  # by the work, which is more than the rows' size tells
    by = ("group", "__copy")
    return dealt.repartition(parts, *by).join(asked.repartition(parts, *by), list(by)).drop("__copy")


def answer_scans(script: DataFrame, group: int = GROUP, few: int = FEW) -> DataFrame:
    """(at, rank, key, value) for each S or V line: the first n keys from its key on that were put before it, and the
    values last put before it; ranks from 0. Scans without a row give none.

    Keys, with the time they were first put, lie in groups of ``group`` by their order, a row for each group. A scan takes
    what it needs of its own group's row; while it lacks rows, it meets the next 1, 2, 4, ... groups, and all the rest once
    that is at most ``few`` pairs of a scan and a group. So it reads about as many keys as it needs, no key is a row that
    moves unless it is an answer, and the number of rounds follows the logarithm of the longest way. Values then come as
    for gets; where answers have at most ``few`` keys, from the puts to these alone.
    """
    puts = script.where("op = 'P'")
    first = puts.groupBy("key").agg(F.min("at").alias("since"), F.max("at").alias("until"))
    keys = running_total(first, F.lit(1), "rn").select("key", "since", "until", F.expr(f"(rn - 1) div {group}").cast("int").alias("group"))
    groups = cut(keys.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("key", "since"))).alias("keys"), F.min("since").alias("since"), F.max("until").alias("until")))  # ``group`` at most
    last, since, until = groups.agg(F.max("group"), F.min("since"), F.max("until")).first()
    scans = script.where("op IN ('S', 'V')").select("at", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    if last is None:
        return scans.where("false").select("at", F.lit(0).alias("rank"), "key", F.lit("").alias("value"))
    # the first group begins below every key
    lows = groups.select(F.when(F.col("group") == 0, F.lit("")).otherwise(F.col("keys")[0]["key"]).alias("key"))
    open_ = cut(route(scans.where("n > 0"), lows).select("at", F.col("key").alias("low"), F.col("n").alias("need"), F.col("pivot").alias("next"), F.lit(0).alias("have")))
    asked_at = open_.agg(F.min("at"), F.max("at")).first()
    times = [t for t in (since, until, *asked_at) if t is not None]
    found, width = [], 1
    while n := open_.count():
        if n * (last + 1) <= few:
            width = last + 1
        asks = open_.withColumn("group", F.explode(F.sequence("next", F.least(F.col("next") + (width - 1), F.lit(last))))) if width > 1 else open_.withColumn("group", F.col("next"))
        hits = F.slice(F.filter("keys", lambda k: (k["key"] >= F.col("low")) & (k["since"] < F.col("at"))), F.lit(1), F.col("need"))
        met = _met(asks, groups, n * width, few).select("at", "low", "need", "next", "have", "group", F.transform(hits, lambda k: k["key"]).alias("hits"))
        if width > 1:  # what the groups before it leave to a group
            before = F.coalesce(F.sum(F.size("hits")).over(Window.partitionBy("at").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            met = met.withColumn("before", before.cast("int")).withColumn("hits", F.slice("hits", F.lit(1), F.greatest(F.col("need") - F.col("before"), F.lit(0))))
        else:
            met = met.withColumn("before", F.lit(0))
        met = cut(met)
        found.append(met.where(F.size("hits") > 0).select("at", (F.col("have") + F.col("before")).alias("rank"), "hits"))
        rest = met.select("at", "low", "need", "next", "have", F.size("hits").alias("got"))
        if width > 1:
            rest = rest.groupBy("at", "low", "need", "next", "have").agg(F.sum("got").cast("int").alias("got"))
        rest = rest.select("at", "low", (F.col("need") - F.col("got")).alias("need"), (F.col("next") + width).alias("next"), (F.col("have") + F.col("got")).alias("have"))
        open_ = cut(rest.where((F.col("need") > 0) & (F.col("next") <= last)))
        width *= 2
    if not found:
        return scans.where("false").select("at", F.lit(0).alias("rank"), "key", F.lit("").alias("value"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    # each hit is a get at its scan's time
    hits = hits.select("at", "rank", F.posexplode("hits").alias("pos", "key"))
    asked = hits.select("at", F.lit("G").alias("op"), "key", F.lit(None).cast("string").alias("value"), (F.col("rank") + F.col("pos")).alias("rank"))
    answers = asked.select("key").distinct()
    if answers.limit(few + 1).count() <= few:
        puts = puts.join(F.broadcast(answers), "key", "left_semi")
    both = puts.select("at", "op", "key", "value", F.lit(None).cast("int").alias("rank")).unionByName(asked)
    return _last_put(both, span=max(times) - min(times)).where("op = 'G'").select("at", "rank", "key", F.col("found").alias("value"))


def check_scans(script: DataFrame) -> DataFrame:
    """(at, want, found) of the V lines whose rows are not the expected ones, in order."""
    rows = answer_scans(script.where("op IN ('P', 'V')")).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "value"))).alias("rows"))  # n at most
    pairs = F.transform("rows", lambda r: F.struct(r["key"].alias("key"), r["value"].alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return script.where("op = 'V'").select("at", F.coalesce("want", none).alias("want")).join(rows, "at", "left").select("at", "want", F.coalesce(pairs, none).alias("found")).where("NOT want <=> found")


class OrderedModel:
    """put, get, scan and remove over an ordered map; the reference model of tests."""

    def __init__(self):
        self._keys: list[str] = []
        self._map: dict[str, str] = {}

    def put(self, key: str, value: str) -> None:
        if key not in self._map:
            insort(self._keys, key)
        self._map[key] = value

    def get(self, key: str) -> str | None:
        return self._map.get(key)

    def scan(self, min_key: str, n: int) -> list[tuple[str, str]]:
        i = bisect_left(self._keys, min_key)
        return [(k, self._map[k]) for k in self._keys[i : i + n]]

    def remove(self, key: str) -> None:
        if self._map.pop(key, None) is not None:
            self._keys.pop(bisect_left(self._keys, key))


def golden(lines: list[str]) -> list[str]:
    """A script with answers: G becomes T with its value, S becomes V with its rows. For scripts of test size."""
    model, out = OrderedModel(), []
    for line in lines:
        op, *w = line.split()
        if op == "P":
            model.put(*w)
            out.append(line)
        elif op == "G":
            out.append(" ".join(["T", w[0], model.get(w[0]) or ""]).strip())
        elif op == "S":
            rows = model.scan(w[0], int(w[1]))
            out.append(" ".join(["V", w[0], w[1], str(len(rows)), *(x for r in rows for x in r)]))
        else:
            out.append(line)
    return out
