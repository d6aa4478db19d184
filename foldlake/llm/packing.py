"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document of n ids (its tokens and an end id) gives floor(n / 2048) full pieces, each a sequence of its own, and a
tail. Tails are dealt at random to groups of about GROUP documents; each group sorts its tails by size, largest first,
and puts each into the first sequence with room. A tournament tree over the sequences' free places finds that sequence
in O(log n). Only a piece's place and size are shuffled, never text or ids. The number of groups follows the number of
documents, so a group's memory stays the same at every size.

Documents that were written in an order can be packed in it: groups are then ranges of RANGE documents that follow each
other, and a group's sequences are numbered by the mean place of what they hold, so by sequence_id they keep to the order
to within a range.

Defined cases: a null or empty text is one piece of the end id alone. Equal sizes go by doc_id (nulls first), then by
checksum; rows that repeat a doc_id are packed each on their own. An empty table gives no rows. A text of any length is
encoded whole and cut into pieces. Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table

LENGTH, END, GROUP, RANGE = 2048, 1, 2048, 1024
#: Names of so many files are broadcast.
FILES = 1_000_000
SPECIAL = "<|endoftext|>"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, deal int, place bigint"
PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str, pattern: str):
    """text -> uint32 ids, as the tokenizer file gives them.

    The same vocabulary as ranks is faster; texts it cannot take (the special token's string, extreme runs of white
    space) go through the tokenizer file itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    exact = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(json_path))

    def encode(text: str) -> np.ndarray:
        if SPECIAL not in text:
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the library's panic is no Exception
                if isinstance(e, KeyboardInterrupt | SystemExit):
                    raise
        return np.array(exact().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each of ``sizes``, which come largest first.

    ``tree[1]`` is the largest free place of any bin; the leaves are the bins in the order of their opening. Descending
    to the left wherever there is room ends in the first bin that fits.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - tree[at]
        tree[at] -= size
        at //= 2
        while at:
            top = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == top:
                break
            tree[at] = top
            at //= 2
    return bins, offsets


def pieces(df: DataFrame, groups: int, length: int = LENGTH, end: int = END, json_path: str | None = None, ranks_path: str | None = None, place: str | None = None) -> DataFrame:
    """A row for each piece, with the group that it is dealt to and the document's place, from column ``place``, or null.

    With places, a range of ``groups`` places is a group. Else the deal hashes doc_id with a row counter of the task, so
    that rows which repeat one doc_id spread as well; a task run again counts the same rows again.
    """
    import public_tokenizers as P

    paths = (json_path or P.path("byte_bpe_50k.json"), ranks_path or P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, count = encoder(*paths), 0
        for ids, texts, places in slices(batches, 1):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text, place in zip(ids, texts, places):
                tokens = np.append(encode(text), np.uint32(end)).astype("<u4")
                deal = zlib.crc32(f"{doc_id}:{count}".encode()) % groups if place is None else place // groups
                count += 1
                for start in range(0, len(tokens), length):
                    part = tokens[start : start + length]
                    for col, x in zip(out, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(tokens), deal, place)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 5 + [pa.int32(), pa.int64()])], [x.split(" ")[0] for x in PIECES.split(", ")])

    at = F.col(place) if place else F.lit(None).cast("bigint")
    return df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), at).mapInArrow(run, PIECES)


def pack(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Packs the pieces of each group; see the module."""

    def group(key, t):  # no hints: partly hinted functions are refused
        size = t.column("length").to_numpy()
        full = np.flatnonzero(size >= length)
        tail = np.flatnonzero(size < length)
        doc, crc = (np.array(t.column(c).fill_null(-(2**62)).to_numpy()) for c in ("doc_id", "ids_crc32"))
        tail = tail[np.lexsort((crc[tail], doc[tail], -size[tail]))]
        seq, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        seq[tail], offset[tail] = first_fit_decreasing(size[tail], length)
        seq[full] = (seq[tail].max() + 1 if len(tail) else 0) + np.arange(len(full))
        if not t.column("place").null_count:
            place, start = t.column("place").to_numpy(), t.column("start").to_numpy()
            seq[full[np.lexsort((start[full], place[full]))]] = seq[full]
            mean = np.bincount(seq, place * size) / np.bincount(seq, size)
            rank = np.empty(len(mean), np.int64)
            rank[np.argsort(mean, kind="stable")] = np.arange(len(mean))
            seq = rank[seq]
        seq += key[0].as_py() << 32
        return t.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    return parts.groupBy("deal").applyInArrow(group, PACKED)


def pack_documents(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    groups = max(1, -(-docs.count() // group))
    return pack(pieces(docs, groups, length), length)


def pack_in_order(docs: DataFrame, length: int = LENGTH, span: int = RANGE) -> DataFrame:
    """Packs ``docs``, read from files, in the order in which they were written: by file name, then by row."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.length("file"), "file")  # a row for each file; a sixth digit sorts behind five
    before = sizes.select("file", (F.sum("n").over(order) - F.col("n")).alias("before"))
    if sizes.count() <= FILES:
        before = F.broadcast(before)
    placed = rows.join(before, "file").select("doc_id", "text", (F.col("before") + F.col("row")).alias("place"))
    return pack(pieces(placed, span, length, place="place"), length)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
