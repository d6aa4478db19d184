"""WARC: Merkle fixity audit.

A record's bytes (a WARC/1.1 header and the page) are hashed where they lie; only hashes move from there on. Records
are laid out in files by hash, about FILE_RECORDS in each, in the order of their hashes, with offsets as written. Over a
file's records, ranges of FANOUT entries in offset order are hashed to a node, ranges of nodes to the next level, up to
the root. Two replicas are compared root against root; where roots differ, only the mismatching nodes of each level are
opened, down to the records that are damaged. Levels shrink by FANOUT, and the depth follows FILE_RECORDS, not the corpus.

``audit_replicas`` takes two inventories as they are, ``warc_records`` reads the records of files in their bytes.

Defined cases: null html or url counts as ''. Rows that repeat a whole record are one record with a count of copies. A
record that a replica lacks (a null leaf) hashes as MISSING there, in the tree and in the comparison; one that both lack
is no damage. Empty tables give no rows. Records are hashed whole, whatever their length. Other columns of pages are not
read. A file that cannot be read on gives its records up to there and a row with the reason in ``error``; a null or empty
file has no records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

FILE_RECORDS, FANOUT, LEVELS = 512, 8, 4
MISSING = "missing"
#: The audited replica of the query has its first byte changed in the pages whose MD5 of page_id begins with this.
ROT = "5a"


def record(html="html", url="url", page_id="page_id"):
    """The bytes of a response record, as text."""
    body, uri = F.coalesce(F.col(html).cast("string"), F.lit("")), F.coalesce(F.col(url).cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), uri)
    return F.concat(head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def layout(records: DataFrame, files: int) -> DataFrame:
    """(page_id, digest, length, copies) -> with file, idx and offset; ``files`` follows the number of records."""
    file = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % files
    order = Window.partitionBy("file").orderBy("digest", "page_id")
    return records.withColumn("file", file).withColumns({"idx": F.row_number().over(order).cast("long") - 1, "offset": F.sum("length").over(order) - F.col("length")})


def level_up(nodes: DataFrame, hashes: list[str], top: bool) -> DataFrame:
    """Nodes of (file, idx, hashes...) hashed in ranges of FANOUT, at the top all to one; children go in order of idx."""
    child = F.struct("idx", *hashes)
    joined = nodes.groupBy("file", (F.lit(0).cast("long") if top else F.expr(f"idx div {FANOUT}")).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    return joined.select("file", F.col("up").alias("idx"), *[F.sha2(F.concat_ws("", F.transform("c", lambda x: x[h])), 256).alias(h) for h in hashes])


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two replicas' leaves (file, idx, digest) -> (file, idx, a, b), null where a replica lacks the record."""
    return a.withColumnRenamed("digest", "a").join(b.withColumnRenamed("digest", "b"), ["file", "idx"], "full")


def audit(leaves: DataFrame) -> DataFrame:
    """Leaves (file, idx, a, b, ...) -> the leaves with root_ok and ok; ok is looked at below mismatching nodes only."""
    names = leaves.columns
    trees = [leaves.select("file", "idx", *[F.coalesce(c, F.lit(MISSING)).alias(c) for c in ("a", "b")])]
    for k in range(LEVELS):
        trees.append(level_up(trees[-1], ["a", "b"], k == LEVELS - 1))
    open_ = trees[-1].where("a <> b").select("file", "idx")  # roots, a row for each file
    roots = trees[-1].select("file", F.col("a").alias("root_a"), F.col("b").alias("root_b"))
    for k, nodes in enumerate(reversed(trees[:-1])):
        below = nodes.withColumn("up", F.lit(0).cast("long") if k == 0 else F.expr(f"idx div {FANOUT}")).join(open_.withColumnRenamed("idx", "up"), ["file", "up"], "left_semi")
        open_ = below.where("a <> b").select("file", "idx")
    bad = open_.withColumn("bad", F.lit(True))
    return leaves.join(roots, "file").join(bad, ["file", "idx"], "left").select(*names, "root_a", "root_b", (F.col("root_a") == F.col("root_b")).alias("root_ok"), F.col("bad").isNull().alias("ok"))


def audit_replicas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two inventories (record, digest) of one archive -> record, a, b, root_ok, ok for the records of either.

    Records that an inventory repeats with different digests are compared one by one, in the order of the digests."""
    nth = F.row_number().over(Window.partitionBy("record").orderBy("digest"))
    one = lambda df, name: df.select("record", "digest").distinct().withColumn("nth", nth).withColumnRenamed("digest", name)
    both = cut(one(a, "a").join(one(b, "b"), ["record", "nth"], "full"))
    files = max(1, -(-both.count() // FILE_RECORDS))
    name = F.md5(F.coalesce(F.col("record").cast("string"), F.lit("")))
    file = F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % files
    idx = F.row_number().over(Window.partitionBy("file").orderBy("record", "nth")).cast("long") - 1
    return audit(cut(both.withColumn("file", file).withColumn("idx", idx))).select("record", "a", "b", "root_ok", "ok")


RECORDS = "idx bigint, offset bigint, length bigint, type string, uri string, digest string, body binary, error string"


def read_records(blob: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes, one by one; the last one bears the error if the file breaks off or is no WARC."""
    at = n = 0
    while at < len(blob):
        head = blob.find(b"\r\n\r\n", at)
        lines = blob[at:head].decode("utf-8", "replace").split("\r\n") if head >= 0 else [""]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = fields.get("content-length", "")
        if not lines[0].startswith("WARC/") or not size.isascii() or not size.isdigit():
            yield {"idx": n, "offset": at, "error": "no record's head"}
            return
        body = head + 4
        end = body + int(size)
        if blob[end : end + 4] != b"\r\n\r\n":
            yield {"idx": n, "offset": at, "error": f"no end of record behind {size} bytes"}
            return
        yield {"idx": n, "offset": at, "length": end + 4 - at, "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": hashlib.sha256(blob[at : end + 4]).hexdigest(), "body": blob[body:end]}
        at, n = end + 4, n + 1


def warc_records(df: DataFrame, key: str, blob: str) -> DataFrame:
    """One row for each record in each value of the binary column ``blob``, with ``key``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    fields = _parse_datatype_string(RECORDS)
    picked = df.select(F.col(f"`{key}`").alias("key_"), F.col(f"`{blob}`").cast("binary").alias("blob_"))
    schema = StructType([picked.schema[0], *fields.fields])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for row in read_records(batch.column(1)[i].as_py() or b""):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).cast(out.types[0]), *(pa.array([row.get(n)], t) for n, t in zip(fields.names, out.types[1:]))], out.names)

    return picked.mapInArrow(run, schema).withColumnRenamed("key_", key + "_" * (key in fields.names))


def replicas(pages: DataFrame) -> DataFrame:
    """Each record with its length and its digests in both replicas; the second one has rotten bytes (see ROT)."""
    rotten = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, len(ROT)) == ROT
    both = pages.select("page_id", record().alias("r")).select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest"), F.when(rotten, F.sha2(F.concat(F.lit("w"), F.expr("substr(r, 2)")), 256)).alias("rot"))
    return both.groupBy("page_id", "length", "digest", "rot").agg(F.count(F.lit(1)).alias("copies")).withColumn("b", F.coalesce("rot", "digest")).drop("rot")


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = max(1, -(-pages.count() // FILE_RECORDS))
    laid = cut(layout(replicas(pages), files).withColumnRenamed("digest", "a"))  # hashes only; each level reads it
    return audit(laid).select("page_id", "file", "idx", "offset", "length", "copies", F.col("a").alias("sha256"), F.col("b").alias("replica_sha256"), "root_a", "root_b", "root_ok", "ok")


def _sql() -> str:
    levels = "".join(
        f", t{k} AS (SELECT file, {'CAST(0 AS BIGINT)' if k == LEVELS else f'idx // {FANOUT}'} AS idx, sha256(string_agg(a, '' ORDER BY idx)) AS a, sha256(string_agg(b, '' ORDER BY idx)) AS b FROM t{k - 1} GROUP BY 1, 2)" for k in range(1, LEVELS + 1)
    )
    return f"""
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR)
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM pages),
n AS (SELECT greatest(1, (count(*) + {FILE_RECORDS - 1}) // {FILE_RECORDS}) AS files FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(r)) AS BIGINT) AS length, sha256(r) AS a, sha256('w' || substr(r, 2)) AS w FROM r),
g AS (SELECT page_id, length, a, w, count(*) AS copies FROM h GROUP BY ALL),
l AS (SELECT page_id, length, copies, a, CASE WHEN md5(coalesce(CAST(page_id AS VARCHAR), '')) LIKE '{ROT}%' THEN w ELSE a END AS b,
  CAST(('0x' || substr(a, 1, 8)) AS BIGINT) % files AS file FROM g, n),
o AS (SELECT *, row_number() OVER f - 1 AS idx, CAST(sum(length) OVER f - length AS BIGINT) AS "offset" FROM l WINDOW f AS (PARTITION BY file ORDER BY a, page_id)),
t0 AS (SELECT file, idx, a, b FROM o){levels}
SELECT page_id, o.file, o.idx, "offset", length, copies, o.a AS sha256, o.b AS replica_sha256, t.a AS root_a, t.b AS root_b, t.a = t.b AS root_ok, o.a = o.b AS ok
FROM o JOIN t{LEVELS} t ON t.file = o.file"""


SQL = _sql()
