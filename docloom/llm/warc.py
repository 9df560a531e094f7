"""WARC archives: writing with payload de-duplication, and a reader that salvages.

Writing: every task rolls ``.warc.gz`` files of its own (one gzip member per record) and moves
each into place when it is complete, so a task that is run again replaces its files.  Among
records of equal payload the one with the largest id is the response; the others are revisit
records that name it.

Reading: the reader walks from member to member (or, in uncompressed archives, from version
line to version line).  When a check fails - gzip data, header, length, trailing blank lines,
block digest - it searches for the next position where a whole record passes its checks, goes
on from there, and logs the bytes between as a quarantined gap.  Inside a member the search is
over its inflated bytes, as far as they inflate.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, shared_dir, stored

ROLL_BYTES = 64 << 20
MIN_PAYLOAD = 0
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS = "file string, offset long, length long, kind string, reason string, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record.  A revisit's block holds the HTTP headers only, with the full length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record that starts at ``at``: (record, end, '') or (None, at, what failed)."""
    if not data.startswith(VERSION, at):
        return None, at, "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None, at, "header does not end"
    fields: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "header line without a colon"
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        return None, at, "no content length"
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n" or end + 4 > len(data):
        return None, at, "length does not lead to the record's end"
    block = data[begin:end]
    digest = fields.get("warc-block-digest")
    if digest and digest != f"sha1:{base32_sha1(block)}":
        return None, at, "block digest differs"
    http, found, payload = block.partition(b"\r\n\r\n")
    is_http = fields.get("content-type", "").startswith("application/http") and found
    length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None) if is_http else None
    payload = payload if is_http else block
    kind = fields.get("warc-type", "")
    strip = lambda name: fields.get(name, "").strip("<>") or None
    record = {
        "type": kind,
        "record_id": strip("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": strip("warc-refers-to"),
        "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
        "payload_bytes": length if kind == "revisit" else len(payload),
        "payload": None if kind == "revisit" else payload,
    }
    if kind == "response" and record["payload_digest"] not in (None, base32_sha1(payload)):
        return None, at, "payload digest differs"
    return record, end + 4, ""


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What inflates of the gzip member at ``at``, where it ends, and what failed.  A member
    that fails has no known end (``at``); its bytes up to the fault are given."""
    inflater = zlib.decompressobj(31)
    out, pos, step, view = [], at, 1 << 16, memoryview(data)
    try:
        while not inflater.eof:
            if pos >= len(data):
                return b"".join(out), at, "gzip member is cut off"
            out.append(inflater.decompress(view[pos : pos + step]))
            pos += step
    except zlib.error as e:
        # once more, at last byte by byte: nothing that inflates before the fault is lost
        inflater = zlib.decompressobj(31)
        out = [inflater.decompress(view[at:pos])]
        with contextlib.suppress(zlib.error):
            for i in range(pos, min(pos + step, len(data))):
                out.append(inflater.decompress(view[i : i + 1]))
        return b"".join(out), at, f"gzip: {e}".split(":")[0] + " data fails"
    return b"".join(out), min(pos, len(data)) - len(inflater.unused_data), ""


def _walk(inside: bytes) -> tuple[list[dict], str]:
    """The sound records of inflated bytes, and the first reason why others were left out."""
    records, pos, why = [], 0, ""
    while 0 <= pos < len(inside):
        record, end, reason = parse_record(inside, pos)
        if record is not None:
            records.append(record)
            pos = end
        else:
            why = why or reason
            pos = inside.find(VERSION, pos + 1)
    return records, why


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(offset, length, record, '') for each sound record and (offset, length, None, reason) for
    each gap of quarantined bytes, in order; gaps and members (or records) cover ``data``.

    Records of one gzip member have its range.  Within the inflated bytes the next version line
    at which a whole record passes its checks is searched for as in uncompressed archives; a
    member that lost records that way is also logged as a gap.  Of a member whose data fail, the
    records that inflate whole before the fault are given, with the range up to the next place
    where something sound starts, which is logged as a gap as well; if all of its records pass
    their checks, so that none shows the fault, the last one is held back.
    """
    at, bad, why, early, given = 0, -1, "", [], set()
    while at < len(data):
        records, end, reason = [], at, "no record starts here"
        if data.startswith(GZIP, at):
            inside, end, reason = _member(data, at)
            records, lost = _walk(inside)
            if end == at:  # the member fails; look for the next after its start
                early += [(at, r) for r in (records if lost else records[:-1])]
                records = []
            else:
                reason, given = lost, set()
        elif data.startswith(VERSION, at):
            record, end, reason = parse_record(data, at)
            records = [record] if record else []
        if records:
            if bad >= 0:
                yield from ((x, at - x, r, "") for x, r in early)
                yield bad, at - bad, None, why
                given |= {tuple(r.values()) for _, r in early}
                bad, early = -1, []
            for record in records:
                again = tuple(record.values()) in given  # a member's uncompressed block, seen from outside
                yield at, end - at, *((None, "given with its member") if again else (record, ""))
            if reason:  # other records of the member are not sound
                yield at, end - at, None, reason
            at = end
            continue
        if bad < 0:
            bad, why = at, reason
        nexts = [x for x in (data.find(GZIP, at + 1), data.find(VERSION, at + 1)) if x >= 0]
        at = min(nexts, default=len(data))
    if bad >= 0:
        yield from ((x, len(data) - x, r, "") for x, r in early)
        yield bad, len(data) - bad, None, why


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri: str = "url", body: str = "html", min_payload: int = MIN_PAYLOAD, roll: int = ROLL_BYTES) -> DataFrame:
    """Write a record per row under ``path``; returns the stored manifest (file, records, bytes).

    Defined cases: a null body is an empty payload, a null uri an empty one; payloads below
    min_payload bytes are always responses; rows that repeat the largest id of a payload are
    all responses; a null id is written as 'null' and is a revisit if its payload has an id,
    else a response.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("body")))
    sums = rows.filter(F.octet_length("body") >= min_payload).groupBy("digest").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    twice = stored(sums.filter("n > 1"), "warc-twice")
    known = lookup(rows, twice, "digest", "n")

    def write(batches):
        from pyarrow import fs

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))
        made, out, count, size = [], None, 0, 0
        name, temp = "", ""

        def close():
            nonlocal out, count, size
            if out is not None:
                out.close()
                store.move(temp, name)
                made.append((name, count, size))
            out, count, size = None, 0, 0

        for batch in batches:
            for i, u, b, top in zip(*(batch.column(c).to_pylist() for c in ("id", "uri", "body", "top")), strict=True):
                refers = None if top is None or top == i else f"urn:page:{top}"
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record_bytes(f"urn:page:{'null' if i is None else i}", u, b, refers)
                data = member.compress(data) + member.flush()
                if out is None:
                    # another attempt may roll elsewhere: its files have other names, and the manifest those that count
                    name = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(made):04d}.warc.gz"
                    temp = name.replace("/part-", "/_part-").removesuffix(".warc.gz")
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(temp)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([x[0] for x in made], pa.string()), "records": pa.array([x[1] for x in made], pa.int64()), "bytes": pa.array([x[2] for x in made], pa.int64())})

    return stored(known.select("id", "uri", "body", "top").mapInArrow(write, "file string, records long, bytes long"), "warc-files")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, manifest: DataFrame | None = None) -> DataFrame:
    """Columns RECORDS: kind 'record' for each sound record, 'gap' for each quarantined range.

    ``manifest`` (file) names the archives that count, as ``write_warc`` returns it; others,
    which a lost attempt may have left, give no rows.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = dict(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True))

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, held = batch.column("path")[i].as_py(), defaultdict(list), 0
                for offset, length, record, reason in salvage(batch.column("content")[i].as_py()):
                    row = {"file": file, "offset": offset, "length": length, "kind": "record" if record else "gap", "reason": reason or None, **(record or {})}
                    if not with_payload:
                        row["payload"] = None
                    held += len(row.get("payload") or b"") + 1
                    for c in names:
                        rows[c].append(row.get(c))
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pydict({c: pa.array(rows[c], types[c]) for c in names})
                        rows, held = defaultdict(list), 0
                if rows:
                    yield pa.RecordBatch.from_pydict({c: pa.array(rows[c], types[c]) for c in names})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    rows = files.select("path", "content").mapInArrow(read, RECORDS)
    if manifest is None:
        return rows
    base = lambda c: F.substring_index(c, "/", -1)
    counted = manifest.select(base("file").alias("counted")).distinct()
    return rows.join(counted, base(rows["file"]) == F.col("counted"), "left_semi")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/docloom-warc-{uuid.uuid4().hex}"
    made = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    if made.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return read_warc(spark, path, with_payload=False, manifest=made).filter("kind = 'record'").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page(F.coalesce("refers_to", F.lit(""))).alias("refers_to")
    )


_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v{g} >> {s}) & 31)::INTEGER + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
OP4_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
v AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top, {", ".join(f"('0x' || substr(hex, {5 * g + 1}, 5))::BIGINT AS v{g}" for g in range(8))} FROM h)
SELECT page_id, payload_bytes, {_CHARS} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM v
"""
