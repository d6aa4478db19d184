"""MinHash near-dedup: BagMinHash signatures, banding, and exact multiset overlap.

A text is the bag of its runs of five words (fewer than five words: one run of all). Each distinct run of weight w (its
count) owns Poisson processes over the discretised weights [0,1), [1,2), [2,4), [4,8), ... as far as w reaches. A
process yields points in time, each with a signature component and a weight level; levels at or above w are passed over.
A component's value is the time of its first point, so that two bags agree in it with the probability of their weighted
Jaccard similarity. Points come in time order and a process stops once its time is past every component of the text, so
the cost is near runs + m log m, not runs x m.

Then: equal texts count once (by MD5); BANDS bands of ROWS values meet in buckets; each text is compared with its
bucket's hub (joins, no pairs within a bucket); links join classes; and in buckets that still hold several classes the
members are compared with one another inside the task, in blocks of bounded size, of which only links that join two
classes come out. The bucket's most frequent class is not compared with itself: with n members outside of it, each of the
bucket's texts is sent to about n / BLOCK groups. Every link counts on the exact overlap of the bags; signatures only choose what to compare (a pair at
0.8 meets in a bucket with probability 0.9995, and in blocks pairs are passed over whose signatures agree in fewer than
ESTIMATE of the components).

Defined cases: a null text counts as ''. Texts without words are in a class with equal texts only. A class is named by its
smallest doc_id (null first); where one doc_id has several texts, two classes can bear one name. Rows that repeat a doc_id
and text are copies like any others: one row of a class is kept, any of those that repeat its first. An empty table gives
no rows. Other columns pass through ``keep_one`` whatever their names. A text is held whole by one task, with some 16
bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, cut, slices, table

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 7
M = BANDS * ROWS
ESTIMATE = 0.7
BLOCK = 512
LEAST = -(2**63)
_MEMO = 100_000

U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Words(dict):
    """word -> 64-bit hash; forgets all when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Words()


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, run's hash, count), sorted by index and hash, each pair once."""
    owner, runs = [], []
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - WORDS + 1)
        s = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(h))):
            s += h[k : k + n] * _ODD[k]
        runs.append(mix(s + U(min(WORDS, len(h)))))
        owner.append(np.full(n, i, np.int64))
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, run = np.concatenate(owner), np.concatenate(runs)
    order = np.lexsort((run, owner))
    owner, run = owner[order], run[order]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (run[1:] != run[:-1]))))
    return owner[first], run[first], np.diff(np.concatenate((first, [len(run)])))


def signatures(n: int, owner: np.ndarray, run: np.ndarray, count: np.ndarray, m: int = M) -> np.ndarray:
    """(n, m) times of first points; inf where a text has no runs."""
    h = np.full(n * m, np.inf)
    octaves = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(run)), octaves)
    octave = np.arange(len(at)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    low = np.where(octave > 0, 2.0 ** (octave - 1), 0.0)
    size = np.maximum(low, 1.0)
    doc, weight, seed = owner[at], count[at], mix(run[at] + U(0x632BE59BD9B4E019) * octave.astype(np.uint64))
    t, drawn, points = np.zeros(len(at)), 0, 1
    while len(doc):
        steps = np.arange(drawn, drawn + points, dtype=np.uint64)
        a = mix(seed[:, None] + (U(2) * steps + U(1)) * _ODD[0])
        b = mix(seed[:, None] + (U(2) * steps + U(2)) * _ODD[0])
        u = ((a >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        times = t[:, None] + np.cumsum(-np.log(u) / (size[:, None] * m), axis=1)
        part = ((b >> U(40)) * U(m) >> U(24)).astype(np.int64)
        level = low[:, None] + np.floor((b & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * size[:, None])
        ok = level < weight[:, None]
        np.minimum.at(h, (doc[:, None] * m + part)[ok], times[ok])
        t = times[:, -1]
        going = t < h.reshape(n, m).max(axis=1)[doc]
        doc, weight, seed, t, low, size = doc[going], weight[going], seed[going], t[going], low[going], size[going]
        drawn, points = drawn + points, min(64, 2 * points)
    return h.reshape(n, m)


def bands(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket names."""
    x = mix(signature.view(np.uint64)).reshape(len(signature), BANDS, ROWS)
    out = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        out = mix(out * _ODD[1] + x[:, :, k])
    return mix(out + np.arange(BANDS, dtype=np.uint64) * _ODD[2])


def named(docs: DataFrame) -> DataFrame:
    """(node, id, text): the MD5 of each text, and the doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(text)).alias("node"), F.col("doc_id").cast("bigint").alias("id"), text.alias("text"))


def _sign(df: DataFrame) -> DataFrame:
    """(doc_id, node, text) -> (doc_id, node, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, nodes, texts in slices(batches, 2):
            owner, hashes, count = bags(texts)
            made = bands(signatures(len(texts), owner, hashes, count)).view(np.int64)
            has = np.zeros(len(texts), bool)
            has[owner] = True
            rows = [b if k else None for b, k in zip(made, has)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

    return df.mapInArrow(run, "doc_id bigint, node binary, bands array<bigint>")


def _unfold(df: DataFrame) -> DataFrame:
    """(n, text) -> (n, bag, sign): each run with its number of earlier equals, hashed; 16 bits of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in slices(batches, 1):
            owner, hashes, count = bags(texts)
            short = (mix(signatures(len(texts), owner, hashes, count).view(np.uint64)) >> U(48)).astype(np.uint16)
            at = np.repeat(np.arange(len(hashes)), count)
            again = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            full = mix(hashes[at] + again.astype(np.uint64) * _ODD[3]).view(np.int64)
            ends = np.searchsorted(owner[at], np.arange(len(texts) + 1))
            rows = [full[a:b] for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array([s.tobytes() for s in short], pa.binary())], ["n", "bag", "sign"])

    return df.mapInArrow(run, "n bigint, bag array<bigint>, sign binary")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags as ``_unfold`` gives them: their members differ, so sets will do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, label): the smallest n of each node's component; edges are (a, b). Labels spread and are followed until none
    changes; each round is a written table."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    rounds = Rounds(edges.sparkSession)
    labels = rounds.keep(nodes.select("n", F.col("n").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("n")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("n") == F.col("a"), "left").select("n", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        spread = rounds.keep(spread)
        if not spread.where("label <> old").limit(1).count():
            return spread.select("n", "label")
        jump = spread.select(F.col("n").alias("m"), F.col("label").alias("far"))
        labels = rounds.keep(spread.join(jump, F.col("label") == F.col("m")).select("n", F.col("far").alias("label")))


def _links(members: DataFrame) -> DataFrame:
    """(bucket, i, j, n, label, block, bag, sign) -> links (a, b) that join two labels, from each group of two blocks."""

    def group(t):
        n, label = t.column("n").to_numpy(), t.column("label").to_numpy()
        block = t.column("block").to_numpy()
        order = np.lexsort((n, block))
        n, label, block = n[order], label[order], block[order]
        bag = t.column("bag").combine_chunks()
        raw = t.column("sign").combine_chunks()
        sign = np.stack([np.frombuffer(raw[int(k)].as_py(), np.uint16) for k in order])
        same = block[0] == block[-1]
        half = len(n) if same else int((block == block[0]).sum())
        found: list[tuple[float, int, int]] = []
        for x in range(len(n) if same else half):
            others = np.arange(x + 1 if same else half, len(n))
            others = others[label[others] != label[x]]
            if len(others):
                agree = (sign[others] == sign[x]).mean(axis=1)
                found += [(-float(s), x, int(y)) for s, y in zip(agree, others) if s >= ESTIMATE]
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while parent.get(k, k) != k:
                parent[k] = k = parent.get(parent[k], parent[k])
            return k

        kept: dict[int, np.ndarray] = {}

        def own(k: int) -> np.ndarray:
            if k not in kept:
                kept[k] = bag[int(order[k])].values.to_numpy()
            return kept[k]

        out = []
        for _, x, y in sorted(found):
            a, b = root(int(label[x])), root(int(label[y]))
            if a != b and overlap(own(x), own(y)) >= SIMILARITY:
                parent[a] = b
                out.append((int(n[x]), int(n[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return members.groupBy("bucket", "i", "j").applyInArrow(group, "a bigint, b bigint")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, node, row) of every row, (node, rep, rep_row, class_id, first) of every distinct text).

    rep is the smallest doc_id with that text, rep_row one row that has it; the first text of a class has its smallest
    doc_id (then MD5). Rows and texts are numbered as they are written to the shared folder, so numbers are unique."""
    signed = _sign(named(docs).select(F.col("id").alias("doc_id"), "node", "text"))
    signed = cut(signed.withColumn("row", F.monotonically_increasing_id()))
    distinct = signed.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.first("bands").alias("bands"))
    distinct = cut(distinct.withColumn("n", F.monotonically_increasing_id()))
    spots = distinct.select("n", F.explode("bands").alias("bucket"))
    hubs = spots.groupBy("bucket").agg(F.min("n").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = cut(hubs)
    spots = cut(spots.join(hubs, "bucket"))
    pairs = spots.where("n <> hub").select("hub", "n").distinct()

    nodes = spots.select("n").distinct()
    wanted = distinct.join(nodes, "n", "left_semi").select("n", "node", F.col("rep.doc_id").alias("rep"))
    # a row of each wanted text: the copies' ids differ, so no reducer gets them all
    texts = named(docs).join(wanted.withColumnRenamed("node", "named"), (F.col("node") == F.col("named")) & F.col("id").eqNullSafe(F.col("rep"))).select("n", "text")
    # cut after the last exchange, so that the joins with it can be split by size
    unfolded = cut(_unfold(texts).dropDuplicates(["n"]))
    left = unfolded.select(F.col("n").alias("hub"), F.col("bag").alias("hub_bag"))
    both = F.size(F.array_intersect("bag", "hub_bag"))
    checked = pairs.join(unfolded, "n").join(left, "hub").select("hub", "n", both.alias("both"), (F.size("bag") + F.size("hub_bag")).alias("all"))
    edges = cut(checked.where(F.col("both") >= F.lit(SIMILARITY) * (F.col("all") - F.col("both"))).select(F.col("hub").alias("a"), F.col("n").alias("b")))
    labels = components(edges, nodes)

    # buckets whose members other than the hub are in several classes: compared within, as far as labels differ
    held = spots.where("size > 2 AND n <> hub").join(labels, "n")
    counts = held.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("of_label"))
    mains = counts.groupBy("bucket").agg(F.max_by("label", F.struct("of_label", "label")).alias("main"), F.max("of_label").alias("of_main"), F.sum("of_label").alias("all")).where("of_main < all")
    mains = cut(mains)  # cut, so that the join with a bucket of very many texts can be split by size
    # the most frequent label's members are not compared with one another: its blocks (below 0) meet the others' alone
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    dealt = held.join(mains, "bucket").select("bucket", "n", "label", (F.col("label") == F.col("main")).alias("is_main"), pieces(F.col("of_main")).alias("main_blocks"), pieces(F.col("all") - F.col("of_main")).alias("blocks"))
    spot = F.pmod(F.xxhash64("n", F.lit(1)), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("is_main"), -1 - spot).otherwise(spot))
    first, last = F.when(F.col("is_main"), F.lit(0)).otherwise(-F.col("main_blocks")), F.col("blocks") - 1
    met = dealt.withColumn("other", F.explode(F.sequence(first, last))).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n", "label", "block")
    # these links join labels, so the labels are the nodes of what is left to do
    more = cut(_links(met.join(unfolded, "n")).distinct())
    ends = labels.select(F.col("n").alias("a"), F.col("label").alias("x")), labels.select(F.col("n").alias("b"), F.col("label").alias("y"))
    merged = cut(more.join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    onto = components(merged, merged.select(F.col("a").alias("n")).union(merged.select("b")).distinct())
    onto = onto.select(F.col("n").alias("label"), F.col("label").alias("to"))
    labels = labels.join(onto, "label", "left").select("n", F.coalesce("to", "label").alias("label"))

    texts = distinct.select("node", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.row").alias("rep_row"))
    joined = texts.join(labels, "n").select("node", "rep", "label")
    named_by = cut(joined.groupBy("label").agg(F.min(F.struct("rep", "node")).alias("class")))  # cut, as above: a class can be large
    near = joined.join(named_by, "label").select("node", "class")
    whole = texts.join(near, "node", "left").select("node", "rep", "rep_row", F.coalesce(F.col("class"), F.struct("rep", "node")).alias("class"))
    whole = whole.select("node", "rep", "rep_row", F.col("class.rep").alias("class_id"), (F.col("class.node") == F.col("node")).alias("first"))
    return signed.select("doc_id", "node", "row"), cut(whole)  # cut, so that a join of the rows with it can be split by size


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, whole = classes(table(spark, sf_dir, "documents"))
    return rows.join(whole, "node").select("doc_id", "class_id", (F.col("first") & (F.col("row") == F.col("rep_row"))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, all columns as they were: that of the smallest doc_id."""
    id_ = lambda c: F.coalesce(c, F.lit(LEAST))
    first = classes(docs)[1].where("first").select("node", id_(F.col("rep")).alias("id"), F.col("rep").isNull().alias("none"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.col("doc_id").cast("bigint")
    # the document's columns stay inside one, so that names cannot clash
    rows = docs.select(F.unhex(F.md5(text)).alias("node"), id_(own).alias("id"), own.isNull().alias("is_none"), F.struct("*").alias("row"))
    kept = rows.join(first, ["node", "id"]).where("none = is_none")
    return kept.dropDuplicates(["node", "id"]).select("row.*")  # shares the join's exchange
