"""Quality rules: compression bands.

A document is kept if its base rules hold and its zstandard ratio (bytes / compressed bytes), over the whole text and
over each fixed chunk of 4,096 bytes and the rest behind the last one, lies inside the band of its length. Short texts
compress little and long ones more, so each class of length has its own band: too high means repetition, too low means
noise that does not compress. The lowest ratios lie between those measured for noise (base64, letters and digits, random
words over 94 symbols) and for clean text (en, de, es, fr) of the class; below 128 bytes the two are not told apart.

Parameter ``share``: the share of a text's bytes in chunks outside their band that still passes, 0 unless the caller
says otherwise: one such chunk and the document goes. The rest behind the last chunk is judged by the band of its length.

Defined cases: a null or empty text has no words, fails the base rules and is not kept. Rows are judged one by one, so
repeated rows get equal verdicts. An empty table gives no rows. Texts are read whole, in time that grows with their
length. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
CHUNK, LEVEL, WINDOW = 4096, 3, 8
#: For texts of this many bytes and more: the lowest and the highest ratio of the whole text.
BANDS = (
    (0, 0.0, 8.0), (128, 1.05, 4.0), (192, 1.12, 4.0), (256, 1.2, 4.0), (384, 1.26, 4.0), (512, 1.33, 4.0), (768, 1.41, 4.0),
    (1024, 1.49, 4.0), (2048, 1.6, 4.5), (4096, 1.65, 4.5), (16384, 1.65, 6.0), (131072, 1.65, 8.0),
)
#: The lowest and the highest ratio of a full chunk, and the share of a text's bytes in chunks that may lie outside.
CHUNK_BAND, CHUNK_SHARE = (1.65, 6.0), 0.0
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, least_chunk_ratio double, most_chunk_ratio double, chunks_outside bigint"


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[tuple, int] = {}
    runs = list(zip(*(words[i:] for i in range(window))))
    if len(set(runs)) == n:
        return 0
    for r in runs:
        seen[r] = seen.get(r, 0) + 1
    total = until = 0
    for i, r in enumerate(runs):
        if seen[r] > 1:
            total += i + window - max(i, until)
            until = i + window
    return total


def dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif WORD.search(line):
            seen.add(line)
    return n


def band(size: int) -> tuple[float, float]:
    return BANDS[bisect_right(BANDS, (size, float("inf"))) - 1][1:]


def verdict(data: bytes, zip_size, share: float = CHUNK_SHARE) -> tuple[float, float, float, int, bool]:
    """Ratio of the whole, lowest and highest of the chunks', chunks outside their band, and whether the text passes."""
    if not data:
        return 0.0, 0.0, 0.0, 0, False
    ratio = len(data) / zip_size(data)
    low, high = band(len(data))
    chunks, outside, amiss = [], 0, 0
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        x = len(part) / zip_size(part) if len(data) > CHUNK else ratio
        least, most = CHUNK_BAND if len(part) == CHUNK else band(len(part))
        chunks.append(x)
        if not least <= x <= most:
            outside, amiss = outside + 1, amiss + len(part)
    return ratio, min(chunks), max(chunks), outside, low <= ratio <= high and amiss <= share * len(data)


def compression_bands(docs: DataFrame, share: float = CHUNK_SHARE) -> DataFrame:
    def kernel(cols: list[list]) -> dict[str, list]:
        press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        zip_size = lambda b: len(press.compress(b))
        out: dict[str, list] = {f.split(" ")[0]: [] for f in SCHEMA.split(", ")}
        for doc_id, text in zip(*cols):
            words = WORD.findall(text)
            n, again = len(words), repeat_words(words)
            failed = n < 20 or 100 * again > 30 * n
            ratio, least, most, outside, passes = verdict(text.encode("utf-8", "surrogatepass"), zip_size, share)
            row = (doc_id, n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup_lines(text), again, failed, passes and not failed, ratio, least, most, outside)
            for col, x in zip(out.values(), row):
                col.append(x)
        return out

    return map_texts(docs, ["doc_id"], "text", kernel, SCHEMA)


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))
