"""The fold against its step-by-step model, and what the store, the stream and the scripts promise."""

import random
from functools import reduce

import pytest

from foldlake.functions import hashes, numbers, values
from foldlake.model import EDIT_SCHEMA, StoreOptions, TreeOptions
from foldlake.operators import ordered, ranges, read, script, sketch
from foldlake.plans import fold as folds
from foldlake.plans.store import Store
from foldlake.sources import edits as src
from foldlake.sources import generators
from foldlake.streaming import ingest
from pyspark.sql import functions as F

COLUMNS = "key string, seq bigint, op int, i32 bigint"


def log(seed, n, keys=40, ops=(0, 2, 3)):
    r = random.Random(seed)
    drawn = [(r.randrange(keys), r.choice(ops), r.randrange(-(2**31), 2**31)) for _ in range(n)]
    return [(f"k{k:03}", i, op, v if op > 1 else 0) for i, (k, op, v) in enumerate(drawn)]


def model(rows):
    """key -> (op, i32), newest first, edit by edit."""
    by: dict = {}
    for k, s, op, v in sorted(rows, key=lambda r: -r[1]):
        by.setdefault(k, []).append((op, v))
    return {k: reduce(folds.combine, e) for k, e in by.items()}


def folded(df):
    return {r.key: (r.op, r.i32) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_fold_of_all_ops(spark, seed):
    rows = log(seed, 600, ops=(0, 1, 2, 3, 4))
    assert folded(folds.fold(spark.createDataFrame(rows, COLUMNS), full_history=True)) == model(rows)


@pytest.mark.parametrize("chunk", [1, 7, 100, None])
def test_chunked_fold(spark, chunk):
    rows = log(9, 800)
    assert folded(folds.fold(spark.createDataFrame(rows, COLUMNS), chunk=chunk)) == model(rows)


def test_fold_of_one_hot_key(spark):
    rows = [("hot", i, 3, 1) for i in range(5000)] + [("cold", 5000, 2, 5)]
    assert folded(folds.fold(spark.createDataFrame(rows, COLUMNS), chunk=64)) == {"hot": (3, 5000), "cold": (2, 5)}


def test_associative_ops():
    some = [(op, v) for op in (0, 2, 3) for v in (0, 5, 2**31 - 1, -(2**31)) if op or not v]
    for a in some:
        for b in some:
            for c in some:
                assert folds.combine(folds.combine(a, b), c) == folds.combine(a, folds.combine(b, c))


def test_noop_breaks_associativity():
    add, noop, write = (3, 1), (1, 0), (2, 5)
    assert folds.combine(folds.combine(add, noop), write) == (2, 6)
    assert folds.combine(add, folds.combine(noop, write)) == (3, 1)


def test_sums_wrap(spark):
    rows = [("a", 0, 2, 2**31 - 1), ("a", 1, 3, 1)]
    assert folded(folds.fold(spark.createDataFrame(rows, COLUMNS))) == {"a": (2, -(2**31))}


def test_registered_merge(spark):
    folds.register_merge(9, F.max)
    df = spark.createDataFrame([("a", 0, 9, 4), ("a", 1, 9, 2), ("b", 2, 9, 1), ("b", 3, 2, 7)], COLUMNS)
    assert {r.key: r.i32 for r in folds.fold_registered(df, 9).collect()} == {"a": 4, "b": 1}
    with pytest.raises(ValueError):
        folds.register_merge(3, F.max)


@pytest.mark.parametrize("chi, policy", [(1, "levelled"), (2, "tiered"), (3, "levelled"), (8, "tiered")])
def test_store_in_batches_equals_one_fold(spark, tmp_path, chi, policy):
    rows = log(chi, 300)
    store = Store.create(spark, str(tmp_path / "s"), StoreOptions(chi=chi, policy=policy))
    for b in range(4):
        assert store.append(spark.createDataFrame(rows[b * 75 : b * 75 + 75], COLUMNS), b)
    assert not store.append(spark.createDataFrame(rows[:75], COLUMNS), 1)  # comes again
    # of values: an add over a delete that a checkpoint has dropped stays an add
    want = {k: v for k, (op, v) in model(rows).items() if op}
    numbers_of = lambda df: {k: v for k, (_, v) in folded(df).items()}
    again = Store.open(spark, store.path)
    assert numbers_of(again.items()) == want
    assert [r.key for r in again.scan("k010", 7).collect()] == sorted(k for k in want if k >= "k010")[:7]
    again.force_checkpoint()
    assert numbers_of(Store.open(spark, store.path).checkpoint_items()) == want


def test_store_put_get_remove(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"), StoreOptions(chi=3))
    store.put("b", "two")
    store.put("a", "one")
    store.put("a", "")
    store.flush()
    store.remove("b")
    store.add("n", 4)
    store.flush()
    store.add("n", -1)
    store.flush()
    assert store.get("a").value == "" and store.get("b") is None and store.get("n").i32 == 3
    assert [r.key for r in store.scan_keys("", 10).collect()] == ["a", "n"]
    with pytest.raises(FileExistsError):
        Store.create(spark, store.path)
    with pytest.raises(FileNotFoundError):
        Store.open(spark, str(tmp_path / "none"))
    store.set_chi(1)
    assert store.metrics()["deltas"] == 0 and Store.open(spark, store.path).chi == 1


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    a = Store.create(spark, str(tmp_path / "s"), StoreOptions(chi=100))
    b = Store.open(spark, a.path)
    a.append(spark.createDataFrame([("k", 0, 2, 1)], COLUMNS))
    with pytest.raises(RuntimeError):
        b.append(spark.createDataFrame([("k", 0, 2, 2)], COLUMNS))
    assert folded(Store.open(spark, a.path).items()) == {"k": (2, 1)}


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    rows, feed = log(5, 200), str(tmp_path / "feed")
    store = Store.create(spark, str(tmp_path / "s"), StoreOptions(chi=2))
    for part in range(4):
        spark.createDataFrame([(*r, None) for r in rows[part * 50 : part * 50 + 50]], EDIT_SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        ingest.ingest(ingest.edit_stream(spark, feed, files_per_trigger=1), store, str(tmp_path / "offsets")).awaitTermination()
    got = {k: v for k, (_, v) in folded(Store.open(spark, store.path).items()).items()}
    assert got == {k: v for k, (op, v) in model(rows).items() if op}


def test_bytes_close_a_batch(spark, tmp_path):
    feed = str(tmp_path / "feed")
    for part in range(3):
        spark.createDataFrame([(f"k{i}", part * 100 + i, 2, 1, None) for i in range(100)], EDIT_SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    store = Store.create(spark, str(tmp_path / "s"), StoreOptions(chi=10))
    stream = ingest.edit_stream(spark, feed, files_per_trigger=None, bytes_per_trigger=1000)
    ingest.ingest(stream, store, str(tmp_path / "offsets")).awaitTermination()
    assert Store.open(spark, store.path).metrics()["batches"] == 3
    with pytest.raises(ValueError):
        ingest.edit_stream(spark, feed, files_per_trigger=None)


@pytest.mark.parametrize("rows_per_file", [5, 1000])
def test_ranges_move_down_one_by_one(spark, tmp_path, rows_per_file):
    rows = log(11, 400)
    store = Store.create(spark, str(tmp_path / "s"), StoreOptions(chi=100, policy="tiered", max_records_per_file=rows_per_file))
    store.append(spark.createDataFrame(rows[:150], COLUMNS))
    store.force_checkpoint()
    store.append(spark.createDataFrame(rows[150:300], COLUMNS))
    store.append(spark.createDataFrame(rows[300:], COLUMNS))
    want = {k: v for k, (op, v) in model(rows).items() if op}
    values_of = lambda df: {k: v for k, (_, v) in folded(df).items()}
    moved, before = 0, {f["path"] for f in store._state["files"]}
    while (at := store.flush_fullest()) is not None:
        moved += 1
        now = {f["path"] for f in store._state["files"]}
        assert len(before - now) <= 1, "one file is replaced, no other"
        before = now
        again = Store.open(spark, store.path)
        assert values_of(again.items()) == want and at in again.ranges() or rows_per_file == 5
        assert [r.key for r in again.scan("k007", 5).collect()] == sorted(k for k in want if k >= "k007")[:5]
    assert moved >= (3 if rows_per_file == 5 else 1) and store.metrics()["deltas"] == 0
    assert values_of(Store.open(spark, store.path).checkpoint_items()) == want


def test_pivot_policy(spark, tmp_path):
    rows = log(12, 300)
    store = Store.create(spark, str(tmp_path / "s"), StoreOptions(chi=100, policy="pivot", max_records_per_file=10, min_flush=200))
    for b in range(4):
        store.append(spark.createDataFrame(rows[b * 75 : b * 75 + 75], COLUMNS))
        if b == 0:
            store.force_checkpoint()
    assert store.metrics()["flushes"] > 2
    assert all(r.bytes < 200 for r in store.waiting().collect())
    assert {k: v for k, (_, v) in folded(store.items()).items()} == {k: v for k, (op, v) in model(rows).items() if op}


def test_readers_of_earlier_states_are_not_cut_off(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"), StoreOptions(chi=1, retain=1))
    store.append(spark.createDataFrame([("a", 0, 2, 1)], COLUMNS))
    early = store.items()
    for n in range(1, 3):
        store.append(spark.createDataFrame([("a", n, 2, n + 1)], COLUMNS))
    assert folded(early) == {"a": (2, 1)} and folded(store.items()) == {"a": (2, 3)}
    first = store._state["snapshots"]
    for n in range(3, 9):
        store.append(spark.createDataFrame([("a", n, 2, n + 1)], COLUMNS))
    assert not any((tmp_path / "s" / name).exists() for names in first for name in names)


def test_a_claim_that_came_to_nothing_is_taken_over(spark, tmp_path):
    import os

    store = Store.create(spark, str(tmp_path / "s"), StoreOptions(chi=100))
    lock = tmp_path / "s" / "manifest" / f"{1:020d}.lock"
    lock.write_text("")
    one = spark.createDataFrame([("a", 0, 2, 1)], COLUMNS)
    with pytest.raises(RuntimeError):
        store.append(one)
    os.utime(lock, (0, 0))
    assert store.append(one) and folded(store.items()) == {"a": (2, 1)}


def test_options_from_the_session(spark):
    spark.conf.set("foldlake.store.chi", "7")
    spark.conf.set("foldlake.store.bloom", "false")
    try:
        o = StoreOptions.from_conf(spark.conf)
    finally:
        spark.conf.unset("foldlake.store.chi")
        spark.conf.unset("foldlake.store.bloom")
    assert (o.chi, o.bloom, o.policy) == (7, False, "levelled") and StoreOptions.from_conf(spark.conf).chi == 1


@pytest.mark.parametrize("seed, group", [(1, 2), (2, 7), (3, 256)])
def test_scan_scripts_against_the_model(spark, seed, group):
    r, lines = random.Random(seed), []
    for _ in range(250):
        k = f"k{r.randrange(60):02}"
        lines.append(r.choice([f"P {k} {r.randrange(1000)}"] * 3 + [f"S {k} {r.choice([0, 1, 3, 10, 100])}", f"G {k}", "S a 4", "S z 4"]))
    full = script.golden(lines)
    df = spark.createDataFrame(list(enumerate(full)), "at int, value string")
    parsed = src.parse_workload(df, at="at")
    found: dict = {}
    for x in script.answer_scans(parsed, group).orderBy("at", "rank").collect():
        found.setdefault(x.at, []).extend([x.key, x.value])
    for at, line in enumerate(full):
        if line.startswith("V"):
            assert found.get(at, []) == line.split()[4:], line
    assert script.check_scans(parsed).count() == 0 and script.check_gets(parsed.where("value IS NOT NULL OR op <> 'T'")).count() == 0
    wrong = [line.replace("V", "V", 1) + ("x" if line.startswith("V") and line.split()[3] != "0" else "") for line in full]
    bad = sum(a != b for a, b in zip(wrong, full))
    assert script.check_scans(src.parse_workload(spark.createDataFrame(list(enumerate(wrong)), "at int, value string"), at="at")).count() == bad > 0


def test_scans_of_the_shipped_kind(spark):
    """Scans alone and more than there are keys; and a script without puts."""
    lines = [f"P user{i:020} v{i}" for i in range(63)] + [f"S user{i % 70:020} {i % 100 + 1}" for i in range(200)]
    parsed = src.parse_workload(spark.createDataFrame(list(enumerate(script.golden(lines))), "at int, value string"), at="at")
    assert script.check_scans(parsed).count() == 0
    none = src.parse_workload(spark.createDataFrame([(0, "S a 3")], "at int, value string"), at="at")
    assert script.answer_scans(none).collect() == []


def test_places_in_bounds(spark):
    bounds = sorted(f"{i * 37 % 1000:04}" for i in range(300))
    keys = [f"{i:04}" for i in range(0, 1010, 3)] + ["", "zz"]
    df = spark.createDataFrame([(k,) for k in keys], "key string").select("key", ordered.place_in(bounds, F.col("key")).alias("n"))
    assert all(r.n == sum(b <= r.key for b in bounds) for r in df.collect())


@pytest.mark.parametrize("few", [0, 5])
def test_scans_of_a_hot_group_are_dealt_out(spark, few, monkeypatch):
    monkeypatch.setattr(script, "LOAD", 3)
    r = random.Random(few)
    lines = [f"P k{r.randrange(60):02} v{i}" if r.random() < 0.6 else f"S k{r.choice([3, 3, 3, 40]):02} {r.choice([0, 1, 7, 30])}" for i in range(150)]
    want = [(i, w[4:]) for i, w in enumerate(x.split() for x in script.golden(lines)) if w[0] == "V" and w[3] != "0"]
    parsed = src.parse_workload(spark.createDataFrame(list(enumerate(lines)), "at int, value string"), at="at")
    got: dict = {}
    for x in script.answer_scans(parsed, 4, few).orderBy("at", "rank").collect():
        assert x.rank == len(got.setdefault(x.at, [])) // 2
        got[x.at] += [x.key, x.value]
    assert sorted(got.items()) == want


def test_a_script_line_is_split_once(spark):
    lines = spark.createDataFrame([(0, " P a 1"), (1, "S a 3"), (2, "# x"), (3, None)], "at int, value string")
    puts = src.parse_workload(lines, at="at").where("op = 'P'")
    assert puts._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [tuple(x) for x in puts.collect()] == [(0, "P", "a", "1", None, None)]


def test_odometer(spark):
    state, want = [0] * 3, []
    for _ in range(800):
        for k in range(3):
            state[k] = (state[k] + 1) % 27
            if state[k]:
                break
        want.append("".join("_abcdefghijklmnopqrstuvwxyz"[d] for d in state))
    assert [r.value for r in generators.sequential_values(spark, 800, 3).orderBy("id").collect()] == want


def test_odometer_turns_all_places(spark):
    ids = [0, 27**4 - 2, 27**4 - 1, 27**4, 899999, 27**7, 27**8 - 1]
    want = ["".join("_abcdefghijklmnopqrstuvwxyz"[(i + 1) // 27**k % 27] for k in range(8)) for i in ids]
    got = spark.createDataFrame([(i,) for i in ids], "id bigint").select(values.sequential_text(F.col("id"), 8).alias("v")).collect()
    assert [r.v for r in got] == want and want[1:3] == ["zzzz____", "____a___"]


def test_result_sink_reads_back(spark, tmp_path):
    runs = spark.createDataFrame([("a b", 4, 1.5, None), ("c", 8, 2.0, 7.25)], "workload string, threads int, kops double, latency_us double")
    src.write_results(runs, str(tmp_path / "log"))
    src.write_results(runs.limit(1), str(tmp_path / "log"))
    back = src.parse_results(spark.read.text(str(tmp_path / "log")))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([("a_b", 4, 1.5, None)] * 2 + [("c", 8, 2.0, 7.25)], key=repr)


def test_value_constructors(spark):
    r = spark.range(1).select(values.from_text(F.lit("é")).alias("t"), values.deleted().alias("d"), values.write_i32(F.lit(-2).cast("long")).alias("w"), values.add_i32(F.lit(258).cast("long")).alias("a")).first()
    assert (r.t.op, bytes(r.t.value)) == (2, "é".encode()) and (r.d.op, bytes(r.d.value)) == (0, b"")
    assert (r.w.op, bytes(r.w.value)) == (2, b"\xfe\xff\xff\xff") and (r.a.op, bytes(r.a.value)) == (3, b"\x02\x01\0\0")


def test_windows_of_wide_characters(spark):
    text = "aé中\U0001f600" * 40
    got = src.byte_windows(spark.createDataFrame([(0, text), (1, "short"), (2, None)], "doc_id int, text string"), "text").collect()
    assert sorted((r.at, r.key, r.value) for r in got) == [(i, text[i : i + 24], text[i : i + 100]) for i in range(len(text) - 99)]


@pytest.mark.parametrize("key_size, value_size, step", [(24, 100, 1), (24, 100, 3), (24, 100, 100), (30, 8, 1), (5, 5, 2), (1, 1, 1), (20, 40, 17)])
def test_windows_in_blocks(spark, key_size, value_size, step):
    r = random.Random(8)
    texts = [*("".join(r.choice(letters) for _ in range(n)) for letters in ("ab c", "aé中\U0001f600", "aaaaaaaaaaaaaaaé") for n in (1, 29, 30, 99, 100, 101, 115, 116, 117, 250)), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = src.byte_windows(df, "text", key_size, value_size, step)
    assert got.columns == ["id", "text", "at", "key", "value"]
    assert src.byte_windows(df.withColumnRenamed("text", "value"), "value", key_size, value_size, step).columns == ["id", "value", "at", "key"]
    assert sorted((x.id, x.at, x.key, x.value) for x in got.collect()) == [(k, i, t[i : i + key_size], t[i : i + value_size]) for k, t in enumerate(texts) if t is not None for i in range(0, len(t) - max(key_size, value_size) + 1, step)]


def test_no_window_is_decoded_by_itself(spark):
    plan = src.byte_windows(spark.createDataFrame([(0, "é" * 200)], "id int, text string"), "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "UTF-32" in plan and "UTF-32" not in plan.partition("Generate explode")[0]


@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 22])
def test_groups_split_in_chunks(spark, chunk):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b"]), i, f"v{r.randrange(9)}", r.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, seq bigint, key string, n int")
    by: dict = {}
    for g, i, k, n in rows:
        by.setdefault(g, []).append((i, k, n))
    assert {x.g: x.n for x in ordered.out_of_order(df, "g", "seq", chunk).collect()} == {g: sum(b[1] < a[1] for a, b in zip(v, v[1:])) for g, v in by.items()}
    numbered = ordered.revisions(df.select(F.col("g").alias("key"), "seq"), chunk).collect()
    assert all(by[x.key][x.revision][0] == x.seq for x in numbered) and len(numbered) == 300
    rates = {(x.g, x.seq): x.rate for x in ordered.rates(df, "g", "seq", "n", chunk).collect()}
    assert all(rates[g, v[0][0]] is None and all(rates[g, b[0]] == (b[2] - a[2]) / (b[0] - a[0]) for a, b in zip(v, v[1:])) for g, v in by.items())
    lines = [(i, "G" if i % 3 else "P", g, k if i % 3 == 0 else None) for g, i, k, _ in rows]
    last: dict = {}
    want = {}
    for i, op, g, k in lines:
        if op == "P":
            last[g] = k
        else:
            want[i] = last.get(g)
    assert {x.at: x.found for x in script.answer_gets(spark.createDataFrame(lines, "at bigint, op string, key string, value string"), chunk).collect()} == want


def test_hashes_against_another_xxh64(spark):
    import xxhash

    keys = ["", "a", "user00000000000000000042", "é" * 50, "x" * 1000]
    for seed in (0, 42, hashes.FILTER_SEED, 2**64 - 1):
        rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", hashes.xxh64(F.col("key"), seed).alias("h")).collect()
        assert all(r.h % 2**64 == xxhash.xxh64(r.key.encode(), seed=seed).intdigest() for r in rows)
    assert all(r.h & 1 for r in spark.range(50).select(hashes.index_hash(F.col("id").cast("string")).alias("h")).collect())


@pytest.mark.parametrize("broadcast", [8192, 0])
def test_sketch_misses_none(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sketch, "BROADCAST_BLOCKS", broadcast)
    every = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    passed = {r.id for r in sketch.membership_sketch(every.where("id % 4 = 0")).may_contain(every).collect()}
    assert set(range(0, 20_000, 4)) <= passed and len(passed) < 5000 + 0.02 * 15_000
    assert sketch.membership_sketch(every.where("false")).may_contain(every).collect() == []


def test_store_levels_and_cache(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"), StoreOptions(chi=100))
    for n in range(3):
        store.append(spark.createDataFrame([(f"k{n}", n, 2, n), ("all", n, 3, 1)], COLUMNS))
    assert folded(store.level(1)) == {"k0": (2, 0), "k1": (2, 1), "all": (3, 2)}
    assert folded(store.level(0, "b")) == {"k2": (2, 2)} and store.level(5).collect() == []
    kept = store.cache()
    assert kept.is_cached and folded(kept) == {"k0": (2, 0), "k1": (2, 1), "k2": (2, 2), "all": (3, 3)}
    kept.unpersist()


def test_cursor_pages(spark):
    items = spark.createDataFrame([(f"k{i:02}", i) for i in range(25)], "key string, v int")
    c = read.Cursor(items, "k03", page=4)
    assert c.peek().key == "k03" and c.read_keys(5) == [f"k{i:02}" for i in range(3, 8)]
    assert [r.v for r in c] == list(range(8, 25)) and c.next() is None


def test_scripts(spark):
    lines = ["P b 2", "P a 1", "G a", "S a 2", "P a 3", "L end", "G c", "T a 3"]
    assert script.golden(lines) == ["P b 2", "P a 1", "T a 1", "V a 2 2 a 1 b 2", "P a 3", "L end", "T c", "T a 3"]
    parsed = src.parse_workload(spark.createDataFrame(list(enumerate(script.golden(lines))), "at int, value string"), at="at")
    assert script.check_gets(parsed.where("at <> 6")).count() == 0
    v = parsed.where("op = 'V'").first()
    assert v.n == 2 and [(x.key, x.value) for x in v.want] == [("a", "1"), ("b", "2")]


def test_ranges_against_a_list(spark):
    keys = [f"{i:03}" for i in range(0, 200, 3)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = lambda d: sorted(r.key for r in d.collect())
    r = random.Random(1)
    for _ in range(4):
        a, b = sorted((f"{r.randrange(220):03}", f"{r.randrange(220):03}"))
        assert got(ranges.drop_closed(df, a, b)) == [k for k in keys if not a <= k <= b]
        assert got(ranges.drop_half_open(df, a, b)) == [k for k in keys if not a <= k < b]
        low, high = ranges.split_at(df, a)
        assert (got(low), got(high)) == ([k for k in keys if k < a], [k for k in keys if k >= a])


@pytest.mark.parametrize("bound", [1, 8192])
def test_routes(spark, bound):
    pivots = ["", "05", "1", "17", "4"]
    keys = [f"{i:02}" for i in range(60)]
    df, p = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(x,) for x in pivots], "key string")
    assert {r.key: r.pivot for r in ranges.route(df, p, bound).collect()} == {k: max(i for i, x in enumerate(pivots) if x <= k) for k in keys}


def test_even_parts_hold_their_bounds(spark):
    r = random.Random(2)
    sizes = [r.randint(1, 6) for _ in range(300)]
    df = spark.createDataFrame([(f"{i:04}", s) for i, s in enumerate(sizes)], "key string, s int")
    parts = ordered.part_sizes(ordered.even_parts(df, F.col("s"), 30, 6), F.col("s")).collect()
    assert sum(p.bytes for p in parts) == sum(sizes) and max(p.bytes for p in parts) <= 30
    assert max(p.bytes for p in parts) - min(p.bytes for p in parts) <= 2 * 6


def test_i32_codec(spark):
    vals = [0, 1, -1, 2**31 - 1, -(2**31), 123456, -654321]
    df = spark.createDataFrame([(v,) for v in vals], "v bigint").select("v", values.as_i32(values.encode_i32(F.col("v"))).alias("back"), numbers.wrap32(F.col("v") + (1 << 32)).alias("w"))
    assert all(r.v == r.back == r.w for r in df.collect())


def test_prefixes_of_bytes_as_integers(spark):
    """Of fe 01 fe 7b 09, by length."""
    df = spark.createDataFrame(list(enumerate(["", "FE", "FE01", "FE01FE", "FE01FE7B", "FE01FE7B09"])), "n bigint, h string")
    assert [r.v for r in df.select("n", values.as_i32(F.unhex("h")).alias("v")).orderBy("n").collect()] == [0, -2, 510, -130562, 2080244222, 2080244222]


def test_sizes():
    t = TreeOptions()
    assert t.max_item_size == 585 and t.item_size_hint == 133 and t.flush_size + t.trie_reserve == t.leaf_size


def test_empty_logs(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert folds.items(none).collect() == [] and read.scan(folds.items(none), "", 5).collect() == []
    assert ordered.running_total(none, F.col("i32")).collect() == []


def test_many_pivots_are_kept_and_counted_apart(spark):
    """At sf0.1, which has 150 pivots: against SQL, written here without a modulus."""
    import duckdb

    from foldlake import queries as own

    sf, con = "/root/testdata/sf0.1", duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(own.oracle_sql()["q_pivot_prune"])
    got = own.queries()["q_pivot_prune"](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    counts = "SELECT tier, count(DISTINCT p) FROM (SELECT o_orderkey * 3 // (SELECT count(*) FROM orders) AS tier, (SELECT count(*) FROM customer WHERE c_custkey % 100 = 0 AND c_custkey <= o_custkey) AS p FROM orders) r WHERE p > 0 GROUP BY tier"
    counted = {r.tier: r.pivots for r in own.queries()["q_segment_counts"](spark, sf).collect()}
    assert counted == dict(con.sql(counts).fetchall()) and max(counted.values()) > 64


def test_pivots_beyond_a_word(spark):
    df = spark.range(200).selectExpr("cast(id as int) AS pivot")
    keep = lambda active: [r.pivot for r in ranges.only_pivots(df, active).orderBy("pivot").collect()]
    assert keep(0b100101) == [0, 2, 5] and keep(1 << 64 | 1 << 150) == [64, 150] and keep(0) == []


def test_a_window_at_every_place(spark):
    import duckdb

    from foldlake import queries as own

    sf = "/root/testdata/sf0.001"
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' WHERE length(text) < 3000").fetchall()
    want = sorted((d, i, t[i : i + 24], t[i : i + 100]) for d, t in texts for i in range(len(t) - 99))
    short = [d for d, _ in texts]
    got = own.queries()["q_byte_windows_all"](spark, sf).where(F.col("doc_id").isin(short)).collect()
    assert want and sorted(map(tuple, got)) == want
