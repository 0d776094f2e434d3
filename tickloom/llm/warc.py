"""WARC archives written and read as splittable text, with record boundaries verified as a chain.

Reading cuts files at every occurrence of the version magic, in parallel and inside records too. Each
piece that parses as a record header is only a candidate: it names the offset where its successor must
begin. Tasks contract the candidates of a stretch of the file to where their chain leaves it, pointer
jumping from the start of the file finds the true entry of each stretch, and only candidates on the
chain are records. A magic inside a payload is never on it.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.tables import BROADCAST_IDS, forget, written

MAGIC = "WARC/1."
#: Bytes of a file whose candidates one group holds.
STRETCH = 1 << 20
RECORD = "file string, offset long, record_type string, record_id string, url string, refers_to string, digest string, full_length long, length long, payload_digest string"
_HEADER = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def _base32_sha1(hex_digest):
    """Base32 of a hex SHA-1, in SQL: eight digits from every five bytes."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records_per_file: int = 50_000) -> None:
    """One record per row under `path`; of equal payloads the one with the largest id is a response, others revisit it.

    The payload is the html in UTF-8, a null one empty. Rows with equal id and payload are all responses
    or all revisits; a row with a null id is a response. An empty table writes no record.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), _base32_sha1(F.sha1(html.cast("binary"))).alias("digest"))
    digests = written(rows.select("id", "digest").where("id IS NOT NULL"), "digests")
    first = written(digests.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("least")).where("least < refers_to").select("digest", "refers_to"), "first_seen")
    revisits = written(digests.join(first, "digest").where("id < refers_to").distinct(), "revisits")
    few = revisits.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(revisits) if few else revisits, ["id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    length = F.octet_length("html")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    safe_url = F.regexp_replace(F.regexp_replace("url", r"[\r\n]+", " "), re.escape(MAGIC), "WARC%2F1.")
    record = F.concat(
        F.lit(MAGIC + "0\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(name(F.col("id")), F.lit("<urn:page:>"))),
        F.coalesce(line("WARC-Target-URI", safe_url), F.lit("")),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", length.cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(length.cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
        F.lit("\r\n"),
    )
    # the writer's line separator is the last line break of a record
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(path)
    forget(digests, first, revisits)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("bytes"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """File, split, number and place in the split, and bytes of each piece; pieces come in file order."""
    now, number, place = None, 0, 0
    for batch in batches:
        for file, split, data in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("bytes"), strict=True):
            if (file, split) != now:
                now, number, place = (file, split), 0, 0
            own = data.as_py() or b""
            yield file, split, number, place, own
            number, place = number + 1, place + len(own) + len(MAGIC)


def _header(own: bytes) -> tuple[int, dict[str, str]] | None:
    """Size of a record's header, counted from the magic, and its fields; None if the piece has none."""
    end = own.find(b"\r\n\r\n")
    if own[:3] not in (b"0\r\n", b"1\r\n") or end < 0:
        return None
    fields = {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(own[3 : end + 2])}
    return (len(MAGIC) + end + 4, fields) if fields.get("content-length", "").strip().isdigit() else None


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


_CANDIDATE = {
    "file": pa.string(), "split": pa.int64(), "number": pa.int64(), "place": pa.int64(), "size": pa.int64(), "head": pa.int64(), "length": pa.int64(),
    "record_type": pa.string(), "record_id": pa.string(), "url": pa.string(), "refers_to": pa.string(), "digest": pa.string(), "full_length": pa.int64(), "payload_digest": pa.string(),
}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_CANDIDATE), _CANDIDATE.values(), strict=True)], list(_CANDIDATE))
    for file, split, number, place, own in _numbered(batches):
        row = (file, split, number, place, len(own) + len(MAGIC))
        if (found := _header(own)) is None:
            rows.append(row + (None,) * 9)
        else:
            head, f = found
            length = min(int(f["content-length"]), 1 << 50)
            body = own[head - len(MAGIC) :]
            full = f.get("x-payload-length", "")
            rows.append(
                (*row, head, length, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest"), int(full) if full.isdigit() else None, _base32(body[:length]) if len(body) >= length else None)
            )
        if len(rows) >= 5000:
            yield flush()
            rows.clear()
    yield flush()


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a stretch leaves the stretch."""
    group = group.drop_duplicates("offset").sort_values("offset", ascending=False)
    away: dict[int, int] = {}
    for offset, following in zip(group["offset"], group["following"], strict=True):
        away[offset] = away.get(following, following)
    return pd.DataFrame({"file": group["file"], "offset": group["offset"], "away": [away[o] for o in group["offset"]]})


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a stretch on the chain from its entry."""
    step = dict(zip(group["offset"], group["following"], strict=True))
    at, on = int(group["entry"].iloc[0]), []
    while at in step:
        on.append(at)
        at = step[at]
    return pd.DataFrame({"file": [group["file"].iloc[0]] * len(on), "offset": on})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under `path`: file, offset, header fields, length and payload_digest.

    payload_digest is the base32 SHA-1 of the payload as read. Offsets are bytes in the file. A file's
    chain ends at the first place that is no record, as in any sequential reader.
    """
    pieces = written(_pieces(spark, path).mapInArrow(_candidates, ", ".join(f"{k} {'string' if t == pa.string() else 'long'}" for k, t in _CANDIDATE.items())), "pieces")
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.groupBy("file", "split").agg(F.sum("size").alias("bytes")).withColumn("base", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
    bases = written(bases.drop("bytes"), "bases")
    located = pieces.join(bases, ["file", "split"])
    located = located.withColumn("offset", F.col("base") + F.col("place") - len(MAGIC)).withColumn("following", F.expr("offset + head + length + 4"))
    located = written(located.withColumn("stretch", F.floor(F.col("offset") / STRETCH)).drop("base"), "located")
    forget(pieces, bases)
    links = located.where("head IS NOT NULL AND offset >= 0").select("file", "stretch", "offset", "following")

    # contract each stretch, then jump from the start of every file
    away = written(links.groupBy("file", "stretch").applyInPandas(_exits, "file string, offset long, away long"), "away")
    doors = away.select("file", F.col("away").alias("offset")).distinct()
    start = away.select("file", F.lit(0).cast("long").alias("offset")).distinct()
    jumps = written(away.join(doors.unionByName(start).distinct(), ["file", "offset"], "left_semi"), "jumps")
    reached = written(start, "reached")
    longest = links.agg(F.max("stretch")).first()[0] or 0
    for _ in range(math.ceil(math.log2(longest + 2))):
        before = reached, jumps
        reached = written(reached.unionByName(reached.join(jumps, ["file", "offset"]).select("file", F.col("away").alias("offset"))).distinct(), "reached")
        hop = jumps.select("file", F.col("offset").alias("away"), F.col("away").alias("further"))
        jumps = written(jumps.join(hop, ["file", "away"], "left").select("file", "offset", F.coalesce("further", "away").alias("away")), "jumps")
        forget(*before)
    entries = reached.join(links.select("file", "offset", "stretch"), ["file", "offset"]).select("file", "stretch", F.col("offset").alias("entry"))
    on_chain = links.join(entries.groupBy("file", "stretch").agg(F.min("entry").alias("entry")), ["file", "stretch"])
    on_chain = written(on_chain.groupBy("file", "stretch").applyInPandas(_walk, "file string, offset long"), "on_chain")
    records = written(located.join(on_chain, ["file", "offset"]), "records")
    forget(away, jumps, reached, on_chain)

    split_up = written(records.where("payload_digest IS NULL").select("file", F.col("offset").alias("record"), "head", "length", "following"), "split_up")
    if not split_up.isEmpty():
        records = records.join(_reassembled(spark, path, located, split_up), ["file", "offset"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "whole_digest"))
    forget(located)
    return records.select(*(x.split()[0] for x in RECORD.split(", ")))


def _reassembled(spark: SparkSession, path: str, located: DataFrame, split_up: DataFrame) -> DataFrame:
    """Payload digests of records that contain the magic, from the pieces between them and their successors."""
    spread = split_up.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("record") / STRETCH), F.floor(F.col("following") / STRETCH))))
    wanted = located.join(spread.select("file", "stretch", "record", F.col("head").alias("own_head"), F.col("length").alias("own_length"), F.col("following").alias("until")), ["file", "stretch"])
    wanted = wanted.where("offset >= record AND offset < until").select("file", "split", "number", "offset", "record", "own_head", "own_length")
    wanted = written(wanted, "wanted")

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, number, _, own in _numbered(batches):
            if chosen is None or (file, split, number) in chosen:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split], pa.int64()), pa.array([number], pa.int64()), pa.array([own], pa.binary())], ["file", "split", "number", "bytes"])

    few = wanted.limit(BROADCAST_IDS + 1).collect()
    chosen = {(r["file"], r["split"], r["number"]) for r in few} if len(few) <= BROADCAST_IDS else None
    found = _pieces(spark, path).mapInArrow(bytes_of, "file string, split long, number long, bytes binary").join(wanted, ["file", "split", "number"])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("offset")
        head, length = int(group["own_head"].iloc[0]), int(group["own_length"].iloc[0])
        data = (MAGIC.encode() + MAGIC.encode().join(bytes(b) for b in group["bytes"]))[head : head + length]
        return pd.DataFrame({"file": group["file"].iloc[:1], "offset": group["record"].iloc[:1], "whole_digest": [_base32(data)]})

    return found.groupBy("file", "record").applyInPandas(whole, "file string, offset long, whole_digest string")


def page_records(records: DataFrame) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type and refers_to.

    A revisit's length and digest are those of the payload that it stands for.
    """
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) AS BIGINT)")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("full_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("digest", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, number("refers_to")).alias("refers_to"),
    )
