"""WARC archives as Spark text files: writing with revisit records and continuation segments, reading back by reassembly.

Archives are written by Spark's text sink, one record a row, so they land wherever Spark can write (no local files); each file
begins with a warcinfo record. A payload longer than a segment is split over one response record and continuation records
that name their origin and segment number; the last one carries the total length. Each HTTP body uses chunked transfer
framing, and a chunk ends inside any text that looks like a record's first line, so such a line never occurs within a record.

Reading takes archives of version 1.0 and 1.1, also mixed and from elsewhere. Files are cut at what begins a version line and
framed by Content-Length: pieces are put together again until a record has its bytes, so a version line within a block does
no harm. A record that is cut short, lacks a length or is followed by other bytes than an empty line is a row that is not
intact; what comes after it is read as usual, and nothing is left out. Compressed files are read by one task each; of plain
ones that are split the pieces are brought together by file.

Continuation records are grouped by their origin, ordered by segment number, and their total length is verified; then the
chunked framing comes off. Unsegmented records are never shuffled; a group of segments is one payload. A revisit takes length
and digest from the response that it refers to, and is intact where that is there, intact, and has the digest that it names.

Null payloads count as empty ones. Record ids hold the page_id and the start of the payload's digest. Rows that repeat a
page_id each give a record; those that share the smallest page_id of equal payloads are all responses. Extra input columns
are ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import settle

#: A version line is MARK, a digit and a line end.
MARK = "WARC/1."
VERSION = MARK + "1\r\n"
#: Code points of a payload in one record and in one chunk, and payload bytes from which equal payloads become revisits.
SEGMENT_CHARS, CHUNK_CHARS, REVISIT_MIN_BYTES = 32_768, 4_096, 100
DATE = "2024-01-01T00:00:00Z"
INFO = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"


def _chunked(text: str) -> bytes:
    """Chunked transfer framing; what begins a version line is always cut in two."""
    out = []
    for piece in text.replace(MARK, MARK[:4] + "\0CUT\0" + MARK[4:]).split("\0CUT\0") if MARK in text else [text]:
        for at in range(0, len(piece), CHUNK_CHARS):
            raw = piece[at : at + CHUNK_CHARS].encode("utf-8", "surrogatepass")
            out += [f"{len(raw):x}\r\n".encode(), raw, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunk(body: bytes) -> bytes:
    """The body without chunked transfer framing; raises ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk is cut short")
        at = end + 4 + n


def _record(kind: str, name: str, uri: str, block: bytes, **more: str) -> str:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {uri}"] if uri else []),
        *(f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v), f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head) + "\r\n\r\n" + block.decode("utf-8", "surrogatepass") + "\r\n"


def _safe_uri(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")


def records_of(page_id: int | None, url: str | None, payload: str, digest: str, refers_to: int | None) -> list[str]:
    """The WARC records of one page: a revisit, or a response with its continuations. Each lacks its last line end."""
    name, uri = f"urn:page:{'' if page_id is None else page_id}:{digest[:16]}", _safe_uri(url)
    size = len(payload.encode("utf-8", "surrogatepass"))
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        return [_record("revisit", name, uri, head, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            WARC_Payload_Digest=f"sha256:{digest}", WARC_Refers_To=f"<urn:page:{refers_to}:{digest[:16]}>",
                Content_Type="application/http;msgtype=response")]
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + _chunked(payload).decode("utf-8", "surrogatepass")
    parts = []
    while block:
        end = SEGMENT_CHARS
        for k in range(1, len(MARK)):  # a segment never ends inside what looks like a version line
            if block[max(0, end - k) : end + len(MARK) - k] == MARK:
                end -= k
        parts.append(block[:end].encode("utf-8", "surrogatepass"))
        block = block[end:]
    total = sum(map(len, parts))
    first = {"WARC_Payload_Digest": f"sha256:{digest}", "Content_Type": "application/http;msgtype=response"}
    if len(parts) > 1:
        first["WARC_Segment_Number"] = "1"
    out = [_record("response", name, uri, parts[0], **first)]
    for k, part in enumerate(parts[1:], 2):
        out.append(_record("continuation", f"{name}:{k}", uri, part, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=str(k),
            WARC_Segment_Total_Length=str(total) if k == len(parts) else ""))
    return out


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes the pages as WARC records under path.

    Equal payloads are found by SHA-256 with partial aggregation; only (key, response's key) pairs of repeats are joined
    back, by the page's own key, so a payload that a third of all pages share lands on no single task.
    """
    src = pages.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{url}`").cast("string").alias("u"),
        F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("p"))
    ids = src.select("k", F.sha2(F.col("p").cast("binary"), 256).alias("d"), F.octet_length("p").alias("n")).where(F.col("n") >= REVISIT_MIN_BYTES)
    groups = ids.groupBy("d").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last")
    repeats = ids.join(groups, "d").where(F.col("k") > F.col("first")).select("k", "d", F.col("first").alias("refers_to")).dropDuplicates(["k", "d"])
    full = src.withColumn("d", F.sha2(F.col("p").cast("binary"), 256)).join(repeats, ["k", "d"], "left").select("k", "u", "p", "d", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = False
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                if not began:
                    began = True
                    yield pa.RecordBatch.from_arrays([pa.array([_record("warcinfo", f"urn:info:{uuid.uuid4()}", "", INFO,
                        Content_Type="application/warc-fields")])], names=["value"])
                rows = whole.slice(at, 500).to_pydict()
                out = [r for row in zip(rows["k"], rows["u"], rows["p"], rows["d"], rows["refers_to"]) for r in records_of(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    full.mapInArrow(run, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


#: Bytes in which a header ends.
MAX_HEADER = 1 << 20
_NO_HEADER = dict.fromkeys(("kind", "name", "uri", "digest", "refers_to", "origin")) | {"segment": 0, "total": 0}


def _header(raw: bytes | bytearray) -> tuple[dict, int, int] | None:
    """The fields of a record (from its version line's digit on), its Content-Length (-1: none) and where its block begins;
    None without a whole header."""
    head = bytes(raw[:MAX_HEADER])
    line, sep, _ = head.partition(b"\n")
    ends = [(k, k + n) for k, n in ((head.find(b"\r\n\r\n"), 4), (head.find(b"\n\n"), 2)) if k >= 0]
    if not sep or line.strip() not in (b"0", b"1") or not ends:
        return None
    end, start = min(ends)
    fields = {}
    for x in head[len(line) : end].splitlines():
        k, _, v = x.decode("utf-8", "replace").partition(":")
        fields[k.strip().lower()] = v.strip()
    number = lambda name, default=0: int(fields[name]) if fields.get(name, "").isdecimal() else default
    bare = lambda name: fields.get(name, "").strip("<>")
    return {
        "kind": fields.get("warc-type"), "name": bare("warc-record-id"), "uri": fields.get("warc-target-uri"),
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"),
        "refers_to": bare("warc-refers-to") or None, "origin": bare("warc-segment-origin-id") or None, "segment": number("warc-segment-number"),
            "total": number("warc-segment-total-length"),
    }, number("content-length", -1), start


def frame(pieces: Iterable[bytes]) -> Iterator[dict]:
    """The records of a file from its pieces between MARKs, the first of which comes before any record.

    A record takes pieces until it has its Content-Length and only an empty line follows. Where that never fits, its first
    piece stands for it and is not whole, and the others are read by themselves."""
    source, waiting, held, ended = iter(pieces), deque(), 0, False

    def following() -> bytes | None:
        nonlocal held, ended
        if waiting:
            held -= len(MARK) + len(waiting[0])
            return waiting.popleft()
        piece = next(source, None)
        ended = piece is None
        return piece

    first = following()
    if first and first.strip():
        yield _NO_HEADER | {"block": first, "whole": False}
    while (piece := following()) is not None:
        taken, whole, used, head = bytearray(piece), False, [], _header(piece)
        while True:
            if head:
                missing = head[1] - (len(taken) - head[2])
                if head[1] < 0 or ended and missing > held:
                    break
                if missing <= 0:
                    after = taken[head[2] + head[1] :]
                    whole = b"\n" in after and not after.strip()
                    break
            elif len(taken) > MAX_HEADER:
                break
            more = following()
            if more is None:
                break
            used.append(more)
            taken += MARK.encode() + more
            head = head or _header(taken)
        if whole:
            yield head[0] | {"block": bytes(taken[head[2] : head[2] + head[1]]), "whole": True}
            continue
        waiting.extendleft(reversed(used))
        held += sum(len(MARK) + len(x) for x in used)
        fields, _, start = _header(piece) or (_NO_HEADER, -1, 0)
        yield fields | {"block": piece[start:], "whole": False}


_RECORD = pa.schema([
    *[(c, pa.string()) for c in ("kind", "name", "uri", "digest", "refers_to", "origin")], ("segment", pa.int32()), ("total", pa.int64()),
        ("block", pa.binary()), ("whole", pa.bool_()),
])
RECORD = "kind string, name string, uri string, digest string, refers_to string, origin string, segment int, total long, block binary, whole boolean"
#: Kinds of records that carry a page; others (warcinfo, request, metadata) are only read past.
PAGES = ("response", "revisit", "continuation", "resource")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record under path; whole is false where it breaks the format."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")]
    lines = spark.read.option("lineSep", MARK).text(path)
    split = not all(f.endswith((".gz", ".deflate", ".zst")) for f in lines.inputFiles())
    if split:  # pieces of a file, in order
        lines = lines.select(F.col("value").cast("binary").alias("value"), *place).repartition("file").sortWithinPartitions("file", "block", "row")
    else:
        lines = lines.select(F.col("value").cast("binary").alias("value"), place[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((file, value) for b in batches for at in range(0, b.num_rows, 500) for file,
            value in zip(*(b.slice(at, 500).column(k).to_pylist() for k in (1, 0))))
        out, held = [], 0
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            for x in frame(value for _, value in own):
                out.append(x)
                held += len(x["block"])
                if held > 4 << 20 or len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RECORD)

    return lines.mapInArrow(run, RECORD)


_PAYLOAD = pa.schema([
    *[(c, pa.string()) for c in ("name", "uri", "kind", "refers_to", "digest")], ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("payload", pa.binary()), ("intact", pa.bool_()),
    ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("origin", pa.string()),
])
_PARTS = "name string, uri string, kind string, refers_to string, digest string, payload_bytes long, payload_digest string, payload binary, intact boolean, segment int, total long, block binary, origin string"
PAYLOAD = _PARTS.split(", segment")[0]


def _payload(r: dict, block: bytes, intact: bool, keep_payload: bool) -> dict:
    """A row of the result: HTTP headers and chunked framing come off, and the digest is taken of the whole payload."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    out = {k: r[k] for k in ("name", "uri", "kind", "refers_to", "digest")}
    if r["kind"] == "revisit":
        return out | {"payload_bytes": None, "payload_digest": None, "payload": None, "intact": intact}
    if r["kind"] == "resource":
        body = block
    elif fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        try:
            body = unchunk(body)
        except ValueError:
            intact = False
    digest = hashlib.sha256(body).hexdigest()
    said = r["digest"] or ""
    known = len(said) == 64 and all(c in "0123456789abcdef" for c in said)  # other digests (SHA-1) are not checked
    return out | {"payload_bytes": len(body), "payload_digest": digest, "payload": body if keep_payload else None,
        "intact": intact and (not known or digest == said)}


def reassemble(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row per response, resource or revisit, and per record that breaks the format: continuation records are put behind
    their origin by segment number and the total length is verified. intact is false where a segment is missing, a length
    differs, the payload's digest is not the recorded one, or a revisit's response is not there."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Unsegmented records are done; segments pass with their block."""
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows = []
                for r in whole.slice(at, 500).to_pylist():
                    if r["whole"] and (r["origin"] or r["segment"]):
                        rows.append({k: r[k] for k in ("name", "uri", "kind", "refers_to", "digest", "segment", "total", "block", "origin")})
                    else:
                        rows.append(_payload(r, r["block"], r["whole"], keep_payload))
                yield pa.RecordBatch.from_pylist(rows, schema=_PAYLOAD)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                r = whole.slice(at, 1).to_pylist()[0]
                # a page that was written more than once has each of its segments as often
                copies = sum(p["segment"] == r["parts"][0]["segment"] for p in r["parts"]) or 1
                parts = r["parts"][::copies]
                block = b"".join(p["block"] for p in parts)
                ok = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and len(block) == r["total"]
                yield pa.RecordBatch.from_pylist([_payload(r, block, ok, keep_payload)] * copies, schema=_PAYLOAD)

    read = settle(records.where(F.col("kind").isin(*PAGES) | ~F.col("whole")).mapInArrow(single, _PARTS), "payloads")
    names = [x.split()[0] for x in PAYLOAD.split(", ")]
    of_origin = lambda c: F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c)
    cut = read.where("block is not null").withColumn("name", F.coalesce("origin", "name"))
    parts = cut.groupBy("name").agg(*map(of_origin, ("uri", "digest", "refers_to", "kind")), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    joined = settle(parts.mapInArrow(several, _PARTS).select(*names), "reassembled")
    found = read.where("block is null").select(*names).unionByName(joined)
    # a revisit's payload is that of the response it names
    again = F.col("kind").eqNullSafe("revisit")
    sent = found.where(~again & F.col("name").isNotNull()).groupBy(F.col("name").alias("refers_to"))
    sent = sent.agg(F.max("payload_bytes").alias("n"), F.max("payload_digest").alias("d"), F.max("intact").alias("ok"))
    revisits = found.where(again).join(sent, "refers_to", "left")
    same = F.coalesce((F.col("digest") == F.col("d")) & F.col("ok"), F.lit(False))
    revisits = revisits.withColumns({"payload_bytes": F.col("n"), "payload_digest": F.col("d"), "intact": F.col("intact") & same})
    return found.where(~again).select(*names).unionByName(revisits.select(*names))
