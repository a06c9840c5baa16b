"""WARC archives: writing with identical-payload revisits, and reading by boundary chains."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, buffers, table

MAGIC = b"WARC/1.1\r\n"
BOUNDARY = "\r\nWARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
HEAD = re.compile(rb"(?:WARC/1\.1\r\n)?((?:[^\r\n:]+:[^\r\n]*\r\n)+)\r\n")


def sha1_base32(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digests(batches):
    for b in batches:
        buf, off = buffers(b.column(2))
        view = memoryview(np.ascontiguousarray(buf))
        digest = [sha1_base32(view[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(digest, pa.string()), pa.array(np.diff(off))], ["page_id", "url", "html", "digest", "n"])


def _records(date: str):
    def run(batches):
        for b in batches:
            out = []
            for page, url, html, digest, n, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
                kind = "response" if refers is None else "revisit"
                body = http + (html or "") if refers is None else http
                head = [
                    f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}",
                    f"WARC-Target-URI: {UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
                ]
                if refers is not None:
                    head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
                head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body.encode())}"]
                out.append("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n" + body + "\r\n")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return run


def write(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", least_bytes: int = 0, per_file: int = 20_000) -> None:
    """Writes a record per row of pages (page_id, url, html) to gzip-compressed archives under `path`.

    Of records with equal payloads of `least_bytes` at least, that with the largest page_id is a
    response and the others revisit it; payloads are compared by SHA-1 and length. Files go
    through Spark's text writer and its commit protocol, `per_file` records each at most, so they
    may lie in any store and a lost task leaves nothing behind. The largest page_id of a payload
    comes from a pre-aggregated group-by; the join back is one that the adaptive planner splits
    where a payload is frequent.

    Null html: an empty payload. Null page_id: a revisit where a row with the same payload has an
    id, else a response. Rows with the same id and payload: alike. Null url: empty; control
    characters and blanks in a url are percent-encoded. Empty table: no records.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = page.mapInArrow(_digests, "page_id long, url string, html string, digest string, n long")
    most = rows.groupBy("digest", "n").agg(F.max("page_id").alias("leader"), F.count("*").alias("copies")).where(f"copies > 1 AND n >= {int(least_bytes)}")
    most = most.select(F.col("digest").alias("_d"), F.col("n").alias("_n"), "leader")
    refers = F.when(F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader"))
    rows = rows.join(most.hint("merge"), (F.col("digest") == F.col("_d")) & (F.col("n") == F.col("_n")), "left").select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "n", refers.alias("refers_to"))
    rows.mapInArrow(_records(date), "value string").write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _fields(row: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """Bytes up to the block, and the header fields, of a row that begins a record; None if it doesn't."""
    m = HEAD.match(row)
    if not m:
        return None
    fields = dict(x.split(b":", 1) for x in m[1].split(b"\r\n") if x)
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    if not fields.get(b"content-length", b"").isdigit() or b"warc-type" not in fields:
        return None
    return m.end(), fields


def _record(row: bytes, start: int, fields: dict[bytes, bytes]) -> dict:
    """What a whole record says; digest and size of a response are taken from its payload."""
    block = row[start : start + int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", x)) else None
    kind = fields[b"warc-type"].decode("ascii", "replace")
    if kind == "response":
        n, digest = len(payload), sha1_base32(payload)
    else:
        said = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)
        n, digest = int(said[1]) if said else 0, fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
    return {
        "page_id": number(fields.get(b"warc-record-id", b"")), "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
        "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get(b"warc-refers-to", b"")),
    }


ROWS = f"file long, split long, seq long, at long, size long, need long, {RECORDS}"


def _candidates(batches):
    """A row for each piece between magics: where it lies in its split, its bytes, and, of one that begins a record, the bytes that the record needs; what the record says if the piece holds it whole."""
    now, seq, at = None, 0, 0
    cols = [x.split()[0] for x in ROWS.split(", ")]
    types = [pa.string() if x.split()[1] == "string" else pa.int64() for x in ROWS.split(", ")]
    for b in batches:
        out = []
        buf, off = buffers(b.column(2))
        data = memoryview(np.ascontiguousarray(buf))
        for file, split, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            if (file, split) != now:
                now, seq, at = (file, split), 0, 0
            row = bytes(data[i:j])
            x = {"file": file, "split": split, "seq": seq, "at": at, "size": len(row), "need": None}
            if got := _fields(row):
                x["need"] = got[0] + int(got[1][b"content-length"])
                if x["need"] <= len(row):
                    x |= _record(row, *got)
            out.append(x)
            seq, at = seq + 1, at + len(row) + len(BOUNDARY)
        yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in out], t) for c, t in zip(cols, types, strict=True)], cols)


def _exits(block: int):
    """Follows each candidate inside its block of the file to the first successor beyond it; null where the chain ends or breaks."""

    def run(t: pa.Table) -> pa.Table:
        o, nxt, end = t.column("o").to_numpy(), t.column("nxt").to_numpy(), (t.column("blk")[0].as_py() + 1) * block
        place, out = {}, [None] * len(o)
        for i in np.argsort(o, kind="stable")[::-1].tolist():
            out[i] = int(nxt[i]) if nxt[i] >= end else place.get(int(nxt[i]))
            place[int(o[i])] = out[i]
        return pa.Table.from_arrays([t.column("file"), t.column("blk"), t.column("o"), pa.array(out, pa.int64())], ["file", "blk", "o", "exit"])

    return run


def _follow(t: pa.Table) -> pa.Table:
    """The candidates that a reachable entry of the block leads to."""
    o, nxt, entry = t.column("o").to_pylist(), dict(zip(t.column("o").to_pylist(), t.column("nxt").to_pylist(), strict=True)), t.column("entry").to_pylist()
    got = set()
    for x in (x for x, e in zip(o, entry, strict=True) if e):
        while x in nxt and x not in got:
            got.add(x)
            x = nxt[x]
    return pa.Table.from_arrays([pa.array([t.column("file")[0].as_py()] * len(got), pa.int64()), pa.array(sorted(got), pa.int64())], ["file", "o"])


def reachable(scratch: Scratch, cands: DataFrame, block: int = 4 << 20) -> DataFrame:
    """(file, o) of the candidates (file, o, nxt) that the chain from offset 0 of their file reaches.

    Inside blocks of `block` bytes chains are followed in a task. Between blocks, entries are
    marked by pointer jumping: in each round a marked entry marks the one it points to, and every
    pointer doubles, so rounds grow with the logarithm of a file's blocks.

    Every table here has a row a record or a block, which grows with the archives, so none is broadcast: joins are by merging.
    """
    cands = cands.withColumn("blk", F.floor(F.col("o") / block))
    exits = scratch.cut(cands.groupBy("file", "blk").applyInArrow(_exits(block), "file long, blk long, o long, exit long"), "exits")
    hit = exits.select("file", F.col("exit").alias("o")).where("o IS NOT NULL").distinct()
    state = exits.join(hit.hint("merge"), ["file", "o"], "left_semi").where("o > 0").unionByName(exits.where("o = 0"))
    state = scratch.cut(state.select("file", "o", F.col("exit").alias("j"), (F.col("o") == 0).alias("marked")), "jumps")
    known = -1
    while (n := state.where("marked").count()) != known:
        known = n
        marks = state.where("marked AND j IS NOT NULL").select("file", F.col("j").alias("o"), F.lit(True).alias("hit")).distinct()
        further = state.select("file", F.col("o").alias("j"), F.col("j").alias("jj"))
        nxt = state.join(further.hint("merge"), ["file", "j"], "left").join(marks.hint("merge"), ["file", "o"], "left")
        # A pointer past its last entry stays, so that a late mark still passes on.
        nxt = nxt.select("file", "o", F.coalesce("jj", "j").alias("j"), (F.col("marked") | F.coalesce("hit", F.lit(False))).alias("marked"))
        nxt = scratch.cut(nxt, "jumps")
        scratch.drop(state)
        state = nxt
    entry = state.where("marked").select("file", "o", F.lit(True).alias("entry"))
    return cands.join(entry.hint("merge"), ["file", "o"], "left").groupBy("file", "blk").applyInArrow(_follow, "file long, o long")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", BOUNDARY).text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _whole(t: pa.Table) -> pa.Table:
    """Records from the pieces of one record each."""
    order = np.lexsort((t.column("seq").to_numpy(), t.column("split").to_numpy()))
    row = BOUNDARY.encode().join(t.column("value")[i].as_py() for i in order)
    x = _record(row, *_fields(row))
    cols = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.Table.from_arrays([pa.array([x[c]], pa.string() if isinstance(x[c], str) else pa.int64()) for c in cols], cols)


def _numbered(batches):
    now, seq = None, 0
    for b in batches:
        n = []
        for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if key != now:
                now, seq = key, 0
            n.append(seq)
            seq += 1
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), b.column(2)], ["file", "split", "seq", "value"])


def read(spark: SparkSession, path: str, scratch: Scratch, block: int = 4 << 20) -> DataFrame:
    """The records of the archives under `path`: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Files are cut at every magic, in splits where they can be split. Each piece that begins like
    a record is a candidate, whose header gives its successor's offset; only candidates on the
    chain from the start of the file are records, so a magic inside a payload, even with a whole
    record after it, is rejected. A record in several pieces is put together in a second pass over the
    archives, made only if there are any. Digest and size of a response are computed from its
    payload. Broken or empty files: the records up to the break. No files: an error of the reader.
    """
    rows = scratch.cut(pieces(spark, path).mapInArrow(_candidates, ROWS), "pieces")
    ends = rows.groupBy("file", "split").agg(F.max(F.col("at") + F.col("size") + len(BOUNDARY)).alias("n"))
    ends = ends.withColumn("base", F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")).drop("n")
    rows = rows.join(ends.hint("merge"), ["file", "split"])
    start = F.col("base") + F.col("at")
    first = start == 0
    cands = rows.where("need IS NOT NULL").select("*", F.when(first, 0).otherwise(start - len(MAGIC)).cast("long").alias("o"), (start + F.col("need") + 4).alias("nxt"))
    cands = scratch.cut(cands, "candidates")
    ok = scratch.cut(reachable(scratch, cands.select("file", "o", "nxt"), block), "reachable")
    records = cands.join(ok.hint("merge"), ["file", "o"], "left_semi")
    names = [c.split()[0] for c in RECORDS.split(", ")]
    out = records.where("need <= size").select(*names)
    parted = records.where("need > size").select("file", "o", "nxt", "split", "seq")
    if parted.isEmpty():
        return out
    every = rows.select("file", "split", "seq", (start - F.when(first, 0).otherwise(len(MAGIC))).cast("long").alias("p"))
    own = F.last("o", True).over(Window.partitionBy("file").orderBy("p")).alias("owner")
    owner = every.join(parted.select("file", F.col("o").alias("p"), "o", "nxt").hint("merge"), ["file", "p"], "left")
    owner = owner.select("file", "split", "seq", "p", own, F.last("nxt", True).over(Window.partitionBy("file").orderBy("p")).alias("until")).where("owner IS NOT NULL AND p < until")
    parts = pieces(spark, path).mapInArrow(_numbered, "file long, split long, seq long, value binary").join(owner.hint("merge"), ["file", "split", "seq"])
    return out.unionByName(parts.groupBy("file", "owner").applyInArrow(_whole, RECORDS))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = scratch.path("archives")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
