"""Substring dedup: sliding sentence spans.

A text's sentences end at . ! ? before white space, at their wide forms (with or without white space) and at line ends.
A sentence of more than LONG words counts as several: it is cut behind pairs of words that a hash picks, so the same
passage is cut alike wherever it stands, and after LONG words at the latest. A run is SENTENCES or more consecutive
sentences with MIN_WORDS or more words. Spans are the shortest run that starts at each sentence and the shortest one that
ends at each (the same one often): together they cover every run that repeats, up to its last sentence. A text of a
single sentence of MIN_WORDS or more words is a span as well. Spans are hashed over their words and compared by 95 bits
over all texts. The first occurrence of a span is the one in the smallest doc_id, then the smallest text hash, then the
earliest; all sentences that another occurrence covers are removed, with the white space that follows them.

Each text is read into spans once. A task sorts its spans in chunks of about CHUNK: only the first of equal spans in a
chunk is sent to be compared with other chunks' spans; the rest cannot be first and go straight to their documents. So a
span with very many occurrences reaches its group at most once for each chunk, and no task gets a whole group.

Defined cases: a null doc_id counts as the smallest, a null text as ''. Rows that repeat a doc_id and text are one
document and get the same result. Texts of fewer words than a span needs stay as they are, and so does a repeated
sentence of up to LONG words between others that do not repeat: it is no run. Two Han or kana characters count as a word.
An empty table gives no rows. Other columns are not read, so their names cannot clash. A text is read in time that grows
with its length, and is held whole by one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices, table

SENTENCES, MIN_WORDS = 2, 16
#: Sentences of more words are cut; about one pair of words in PICK is a place to cut.
LONG, PICK = 32, 16
CLOSERS = "[\"'”’)\\]」』）]*+"
STOPS = ".!?…。！？"
#: A line end; or a whole run of stops that holds a wide one, or is followed by white space. Looked at once a run.
END = re.compile(rf"\n\s*|(?<![{STOPS}])(?:[.!?…]*+[。！？][{STOPS}]*+{CLOSERS}|[.!?…]++{CLOSERS}(?=\s))\s*")
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
WORD = re.compile(f"(?:{WIDE.pattern}{{1,2}}|[^\\s{WIDE.pattern[1:-1]}]+)\\s*")
LEAST = -(2**63)
#: Spans that a task sorts at once, and the h2 of those that have an earlier equal in their chunk.
CHUNK, LATER = 400_000, -1


def _parts(text: str) -> tuple[list[tuple[int, int]], list[str], list[int]]:
    """(start, end) of each sentence, long ones in pieces; their words with one space between; their numbers of words."""
    wide = not text.isascii() and WIDE.search(text) is not None
    cuts, joined, sizes = [], [], []

    def add(a: int, b: int, words: list[str], n: int) -> None:
        cuts.append((a, b))
        joined.append(" ".join(words))
        sizes.append(n)

    a, size = len(text) - len(text.lstrip()), len(text)
    for b in [*(m.end() for m in END.finditer(text, a)), size]:
        if a == b:
            continue
        words = text[a:b].split()
        n = len(words)
        if wide and (k := len(WIDE.findall(text, a, b))):
            n = (k + 1) // 2 + len(WIDE.sub(" ", text[a:b]).split())
        if n <= LONG:
            add(a, b, words, n)
        else:
            last, n = "", 0
            for m in WORD.finditer(text, a, b):
                now, n = m[0].rstrip(), n + 1
                if m.end() < b and (n == LONG or zlib.crc32(f"{last} {now}".encode("utf-8", "surrogatepass")) % PICK == 0):
                    add(a, m.end(), text[a : m.end()].split(), n)
                    a, n = m.end(), 0
                last = now
            add(a, b, text[a:b].split(), n)
        a = b
    return cuts, joined, sizes


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each, long ones in pieces; they cover the text but for white space in front."""
    return _parts(text)[0]


def _runs(sizes: list[int]) -> list[tuple[int, int]]:
    """(first, last) of each span, for the sentences' numbers of words."""
    found, many = set(), len(sizes)
    if many == 1 and sizes[0] >= MIN_WORDS:
        found.add((0, 0))
    j = words = 0
    for i in range(many):
        while j < many and (words < MIN_WORDS or j - i < SENTENCES):
            words += sizes[j]
            j += 1
        if words < MIN_WORDS or j - i < SENTENCES:
            break
        found.add((i, j - 1))
        words -= sizes[i]
    i = words = 0
    for j in range(many):
        words += sizes[j]
        while words - sizes[i] >= MIN_WORDS and j - i >= SENTENCES:
            words -= sizes[i]
            i += 1
        if words >= MIN_WORDS and j - i + 1 >= SENTENCES:
            found.add((i, j))
    return sorted(found)


def _hashed(joined: list[str], sizes: list[int]) -> list[tuple[int, int, bytes]]:
    return [(i, j, xxhash.xxh3_128_digest(" ".join(joined[i : j + 1]).encode("utf-8", "surrogatepass"))) for i, j in _runs(sizes)]


def spans(text: str, cuts: list[tuple[int, int]]) -> list[tuple[int, int, bytes]]:
    """(first sentence, last sentence, 16-byte hash) of each span."""
    assert (parts := _parts(text))[0] == cuts
    return _hashed(*parts[1:])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __id and __text, which name a document, and __t, its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)), "__hash": F.xxhash64(text), "__t": text})


def _sift(cols: list[np.ndarray]) -> list[np.ndarray]:
    """A chunk's (h1, h2, id, hash, place): the first of equal spans stays, others get the key (of their own, LATER)."""
    order = np.lexsort(cols[::-1])
    h1, h2, id_, hash_, place = (c[order] for c in cols)
    n = len(h1)
    changes = np.ones((2, n), bool)  # of key, of place
    changes[0, 1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    changes[1, 1:] = changes[0, 1:] | (id_[1:] != id_[:-1]) | (hash_[1:] != hash_[:-1]) | (place[1:] != place[:-1])
    later = ~changes[0]
    with np.errstate(over="ignore"):
        h1[later] = (id_ ^ hash_)[later] + place[later] * 0x9E3779B1  # spreads them
    h2[later] = LATER
    return [c[changes[1]] for c in (h1, h2, id_, hash_, place)]  # a repeated row's places are one


def _occurrences(df: DataFrame, chunk: int) -> DataFrame:
    """(id, hash, text) -> (h1, h2, id, hash, place) for the spans of each; place is start << 32 | stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            out = _sift([np.concatenate(c) for c in zip(*held)])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["h1", "h2", "id", "hash", "place"])

        for ids, hashes, texts in slices(batches, 2):
            digests, places, counts = [], [], []
            for text in texts:
                found = _hashed(*_parts(text)[1:])
                digests += [h for *_, h in found]
                places += [i << 32 | j for i, j, _ in found]
                counts.append(len(found))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            held.append([h[:, 0], (h[:, 1] & 0x7FFFFFFF).astype(np.int32), np.repeat(np.array(ids, np.int64), counts), np.repeat(np.array(hashes, np.int64), counts), np.array(places, np.int64)])
            if (size := size + len(h)) >= chunk:
                yield batch()
                size = 0
        if size:
            yield batch()

    return df.mapInArrow(run, "h1 bigint, h2 int, id bigint, hash bigint, place bigint")


def covered(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(__id, __hash, __spans): the places of the non-first spans of each document that has any."""
    found = _occurrences(keyed(docs).select("__id", "__hash", "__t"), chunk)
    nth = F.rank().over(Window.partitionBy("h1", "h2").orderBy("id", "hash", "place"))
    later = found.withColumn("nth", nth).where((F.col("nth") > 1) | (F.col("h2") == LATER))
    places = later.groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(F.collect_set("place").alias("__spans"))
    return cut(places)  # cut, so that the join of the rows with it is split by size where many rows are one document


def _strip(text: str, found: list[int] | None) -> tuple[str, int, int]:
    """(text without the covered sentences, sentences, sentences removed)."""
    cuts = sentences(text)
    if not found:
        return text, len(cuts), 0
    gone: set[int] = set()
    for place in found:
        gone.update(range(place >> 32, (place & 0xFFFFFFFF) + 1))
    lead = text[: cuts[0][0]]
    return lead + "".join(text[a:b] for k, (a, b) in enumerate(cuts) if k not in gone), len(cuts), len(gone)


def dedup_spans(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each of ``docs``: doc_id, text without repeated spans, n_sentences, n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found, texts in slices(batches, 2):
            made = [_strip(t, f) for t, f in zip(texts, found)]
            cols = [ids, [m[0] for m in made], [m[1] for m in made], [m[2] for m in made]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["doc_id", "text", "n_sentences", "n_removed"])

    # neither side is broadcast by hint: the spans' side grows with the corpus
    joined = keyed(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "__id", "__hash", "__t").join(covered(docs, chunk), ["__id", "__hash"], "left")
    return joined.select("doc_id", "__spans", "__t").mapInArrow(run, "doc_id bigint, text string, n_sentences bigint, n_removed bigint")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"))
