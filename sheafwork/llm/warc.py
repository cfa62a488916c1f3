"""WARC derivatives: metadata and plain-text conversion records from response records.

A record is its WARC header lines, an empty line, the block, and two empty lines. Each response gives a metadata record
(JSON: source headers, digests, title, links) and a conversion record (plain text). Both name the response in
WARC-Refers-To and each other's id, and keep its target, date and digests. Record ids follow from the content, so a task
that runs again gives the same records. Files hold one gzip member for each record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import pieces, shared_folder, unbounded
from sheafwork.llm.token_records import file_system

VERSION = "WARC/1.1"
#: Starts of what leaves no text: comments, declarations, and elements with all they hold.
UNSEEN = re.compile(r"<(?:!|(script|style|template|noscript|title|head)\b)", re.I)
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "template", "noscript", "title", "head")}
BREAKS = re.compile(r"<(?:br|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|aside|main|pre|blockquote|dl|dt|dd"
                    r"|form|figure|hr|title|body|html))\b[^>]*>", re.I)
CELLS = re.compile(r"</t[dh]\s*>", re.I)
TAGS = re.compile(r"</?[a-zA-Z][^>]*>")
BLANKS = re.compile(r"[ \t\f\r]+")
TITLE = re.compile(r"<title\b[^>]*>", re.I)
LINKS = re.compile(r"<(a|area|link|img|script|iframe)\b[^>]*>", re.I)
ADDRESS = re.compile(r"\s(?:href|src)\s*=\s*", re.I)
VALUE = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record; header values lose line ends."""
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join([VERSION, *lines, "", ""]).encode() + block + b"\r\n\r\n"


def header_lines(text: str) -> list[tuple[str, str]]:
    """Name and value of each header line; a line that begins with a blank goes on the one before."""
    out: list[tuple[str, str]] = []
    for line in text.split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse(record: bytes | None) -> tuple[dict[str, str], bytes] | None:
    """Headers (names lower-cased, first of each) and block; None if it is no whole record."""
    head, found, rest = (record or b"").partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not found or not first.startswith(b"WARC/"):
        return None
    headers: dict[str, str] = {}
    for k, v in header_lines(lines.decode("utf-8", "replace")):
        headers.setdefault(k.lower(), v)
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or len(rest) < int(size):
        return None
    return headers, rest[:int(size)]


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        try:
            size = int(body[at:stop].split(b";")[0], 16) if stop >= 0 else 0
        except ValueError:
            return body  # not chunked after all
        if size <= 0:
            return b"".join(out)
        out.append(body[stop + 2:stop + 2 + size])
        at = stop + 2 + size + 2


def payload(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload bytes of an HTTP response; a block without HTTP header is all payload."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    status, _, lines = head.decode("iso-8859-1").partition("\r\n")
    return status, header_lines(lines), body


def decoded(headers: list[tuple[str, str]], body: bytes) -> str:
    """The payload as text: transfer and content encodings undone, bytes of the named charset or UTF-8."""
    named: dict[str, str] = {}
    for k, v in headers:
        named.setdefault(k.lower(), v)
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = unchunked(body)
    how = named.get("content-encoding", "").lower()
    if how in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):
            try:
                body = zlib.decompress(body, bits)
                break
            except zlib.error:
                continue
    charset = CHARSET.search(named.get("content-type", ""))
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def whole_tags(page: str) -> int:
    """Where the last tag ends: a start behind it is never closed, and no pattern need look for its end."""
    return page.rfind(">") + 1


def seen(page: str) -> list[str]:
    """The parts of a page between what leaves no text, from one pass from left to right: that no end of a kind follows is
    found once."""
    out, at, look = [], 0, 0
    missing: set[str] = set()

    def end_of(kind: str, start: int, find) -> int:
        if kind in missing:
            return -1
        stop = find(start)
        if stop < 0:
            missing.add(kind)
        return stop

    def element_end(name: str, start: int) -> int:
        found = ENDS[name].search(page, start)
        return found.end() if found else -1

    while found := UNSEEN.search(page, look):
        start, look = found.start(), found.end()
        stop = -1
        if found[1] is None:
            if page.startswith("--", look):
                stop = end_of("comment", look + 2, lambda i: page.find("-->", i))
                stop += 3 if stop >= 0 else 0
            if stop < 0:
                stop = end_of("tag", look, lambda i: page.find(">", i)) + 1 or -1
        else:
            name = found[1].lower()
            open_end = end_of("tag", look, lambda i: page.find(">", i))
            if open_end >= 0:
                stop = end_of(name, open_end + 1, lambda i: element_end(name, i))
        if stop >= 0:
            out.append(page[at:start])
            at = look = stop
    return [*out, page[at:]]


def plain(page: str) -> str:
    """Text of a page: a line for each block, blanks joined, empty lines left out. Takes time in line with its length, whatever
    is left unclosed."""
    page = "\n".join(seen(page)).replace("\n", " ")
    for tags, text in ((CELLS, "\t"), (BREAKS, "\n"), (TAGS, "")):
        last = whole_tags(page)
        page = tags.sub(text, page[:last]) + page[last:]
    page = BLANKS.sub(" ", html.unescape(page))
    return "\n".join([x for line in page.split("\n") if (x := line.strip())])


def links(page: str) -> list[tuple[str, str]]:
    """Tag and address of each link: the first address of a tag that has a value."""
    out, at, last = [], 0, whole_tags(page)
    while found := LINKS.search(page, at, last):
        at = found.end()
        for name in ADDRESS.finditer(page, found.start(), found.end()):
            value = VALUE.match(page, name.end())
            if value:
                out.append((found[1].lower(), html.unescape(value[1] or value[2] or value[3] or "").strip()))
                at = max(at, value.end())
                break
    return out


def title_of(page: str) -> str | None:
    start = TITLE.search(page, 0, whole_tags(page))
    stop = ENDS["title"].search(page, start.end()) if start else None
    return " ".join(html.unescape(page[start.end():stop.start()]).split()) if stop else None


def derived(record: bytes | None) -> tuple[str, bytes, bytes] | None:
    """Response id, metadata record and conversion record; None for what is no response record."""
    whole = parse(record)
    if whole is None or whole[0].get("warc-type", "").lower() != "response" or "warc-record-id" not in whole[0]:
        return None
    source, block = whole
    status, headers, body = payload(block)
    page = decoded(headers, body)
    text = plain(page).encode()
    origin = source["warc-record-id"]
    kept = [(name, source[name.lower()]) for name in ("WARC-Target-URI", "WARC-Date") if name.lower() in source]
    meta_id, text_id = record_id(origin, "metadata"), record_id(origin, "conversion")
    envelope = {
        "warc-headers": source, "http": {"status": status, "headers": headers},
        "payload-length": len(body), "payload-digest": digest(body), "block-digest": digest(block),
        "source-payload-digest": source.get("warc-payload-digest"), "source-block-digest": source.get("warc-block-digest"),
        "conversion": text_id, "conversion-digest": digest(text),
        "title": title_of(page), "links": [{"tag": tag, "url": url} for tag, url in links(page)],
    }
    info = json.dumps(envelope, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    metadata = build([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), ("WARC-Refers-To", origin), *kept,
                      ("Content-Type", "application/json"), ("WARC-Block-Digest", digest(info)), ("X-Conversion-ID", text_id)], info)
    conversion = build([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), ("WARC-Refers-To", origin), *kept,
                        ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(text)),
                        ("X-Source-Payload-Digest", source.get("warc-payload-digest") or digest(body)), ("X-Metadata-ID", meta_id)], text)
    return origin, metadata, conversion


def response_of(key: str, url: str, page: bytes, date: str) -> bytes:
    """A response record of a fetched page."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page)}\r\n\r\n").encode() + page
    own = digest(page)
    return build([("WARC-Type", "response"), ("WARC-Record-ID", record_id(key, url, own)), ("WARC-Target-URI", url),
                  ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
                  ("WARC-Payload-Digest", own), ("WARC-Block-Digest", digest(block)), ("X-Page-ID", key)], block)


def responses(pages: DataFrame, date: str) -> DataFrame:
    """(page_id, record): a response record for each row of ``pages`` (page_id, url, html); null url and html are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(
                [response_of("" if i is None else str(i), u or "", (h or "").encode(), date) for i, u, h in rows], pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, record binary")


def derive(records: DataFrame) -> DataFrame:
    """(page_id, origin, metadata, conversion) of each row of ``records`` (page_id, record).

    Rows that hold no whole response record (null, cut off, or of another type) give no row; repeated rows give each
    theirs. Null page_ids stay. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                got = [(i, *d) for i, r in zip(part.column("page_id").to_pylist(), part.column("record").to_pylist())
                       if (d := derived(r)) is not None]
                yield pa.RecordBatch.from_pydict({
                    "page_id": pa.array([g[0] for g in got], pa.int64()), "origin": pa.array([g[1] for g in got], pa.string()),
                    "metadata": pa.array([g[2] for g in got], pa.binary()), "conversion": pa.array([g[3] for g in got], pa.binary())})

    return records.select("page_id", "record").mapInArrow(run, "page_id bigint, origin string, metadata binary, conversion binary")


def write_files(derivatives: DataFrame, folder: str) -> DataFrame:
    """Writes each task's records as <name>.metadata.warc.gz and <name>.text.warc.gz below ``folder``; the manifest (name, n).

    Names are the tasks' own, and only those that finished are in the manifest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, files, n = uuid.uuid4().hex, None, 0
        for batch in batches:
            if files is None:
                fs.create_dir(root, recursive=True)
                files = {c: fs.open_output_stream(f"{root}/{name}.{end}.warc.gz", compression=None)
                         for c, end in (("metadata", "metadata"), ("conversion", "text"))}
            for c, f in files.items():
                for record in batch.column(c):
                    f.write(gzip.compress(record.as_py(), 3, mtime=0))
            n += batch.num_rows
        if files is not None:
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "n": pa.array([n], pa.int64())})

    manifest = f"{folder}/manifest"
    derivatives.mapInArrow(run, "name string, n bigint").write.parquet(manifest)
    return derivatives.sparkSession.read.schema("name string, n bigint").parquet(manifest)


def members(f, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked one after the other."""
    unpack, out, data = zlib.decompressobj(31), [], b""
    while data or (data := f.read(size)):
        out.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("a gzip member is cut off")


def read_files(manifest: DataFrame, folder: str, end: str) -> DataFrame:
    """(record_id, refers_to, target, date, type, block_digest, digest_ok, other_id, source_digest, block) of the files ``end``."""
    names = ["record_id", "refers_to", "target", "date", "type", "block_digest", "other_id", "source_digest"]
    keys = ["warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "warc-type", "warc-block-digest", None,
            "x-source-payload-digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(f"{root}/{name}.{end}.warc.gz", compression=None) as f:
                    records = members(f)
                    while got := [parse(r) or ({}, b"") for r in islice(records, 128)]:
                        yield pa.RecordBatch.from_pydict({
                            **{n: pa.array([h.get(k) if k else h.get("x-conversion-id", h.get("x-metadata-id")) for h, _ in got], pa.string())
                               for n, k in zip(names, keys)},
                            "digest_ok": pa.array([digest(b) == h.get("warc-block-digest") for h, b in got]),
                            "block": pa.array([b for _, b in got], pa.binary())})

    # as many tasks as files: rows of names are too small for Spark to judge by
    return manifest.select("name").repartition(max(1, manifest.count()), "name").mapInArrow(
        run, ", ".join(f"{n} string" for n in names) + ", digest_ok boolean, block binary")


def derivatives_of(pages: DataFrame, date: str, folder: str | None = None) -> DataFrame:
    """Builds responses of ``pages``, writes their derivatives as WARC files in a shared folder and reads both back.

    One row for each different response: page_id, its record ids, target, the source's payload digest, title, n_links,
    n_chars and SHA-256 of the text, and linked (all identifiers, digests and headers agree). Pages with the same page_id,
    url and html are one response; a null page_id, url or html is empty. ``folder`` is one that all executors share.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    manifest = write_files(derive(responses(pages, date)).drop("origin"), folder)
    info = F.col("block").cast("string")
    meta = read_files(manifest, folder, "metadata").select(
        F.expr("try_cast(get_json_object(CAST(block AS STRING), '$.warc-headers.x-page-id') AS BIGINT)").alias("page_id"),
        F.col("refers_to").alias("response_id"), F.col("record_id").alias("metadata_id"), F.col("other_id").alias("conversion_id"),
        "target", F.get_json_object(info, "$.source-payload-digest").alias("payload_digest"),
        (F.col("digest_ok") & (F.get_json_object(info, "$.payload-digest") == F.get_json_object(info, "$.source-payload-digest")) &
         (F.get_json_object(info, "$.block-digest") == F.get_json_object(info, "$.source-block-digest"))).alias("ok"),
        F.get_json_object(info, "$.conversion-digest").alias("text_digest"), F.get_json_object(info, "$.title").alias("title"),
        F.coalesce(F.json_array_length(F.get_json_object(info, "$.links")), F.lit(0)).cast("bigint").alias("n_links")).distinct()
    text = read_files(manifest, folder, "text").select(
        F.col("record_id").alias("conversion_id"), F.col("refers_to").alias("r"), F.col("other_id").alias("m"), F.col("target").alias("t"),
        F.col("source_digest").alias("s"), F.col("block_digest").alias("b"), F.col("digest_ok").alias("ok2"),
        F.length(info).cast("bigint").alias("n_chars"), F.sha2(F.col("block"), 256).alias("text_sha256")).distinct()
    agree = (F.col("ok") & F.col("ok2") & (F.col("r") == F.col("response_id")) & (F.col("m") == F.col("metadata_id")) &
             (F.col("t") == F.col("target")) & (F.col("s") == F.col("payload_digest")) & (F.col("b") == F.col("text_digest")))
    return meta.join(unbounded(text), "conversion_id").select(
        "page_id", "response_id", "metadata_id", "conversion_id", "target", "payload_digest", "title", "n_links", "n_chars", "text_sha256",
        F.coalesce(agree, F.lit(False)).alias("linked"))
