"""WARC: records read and written, and revisits that a server answered with 304 resolved.

A revisit takes the payload of the latest earlier full response of the same canonical URL, if their
validators agree, and the headers that a 304 may update.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import in_arrow, written

#: Headers of a stored response that a 304 replaces.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

NOT_MODIFIED, IDENTICAL = "server-not-modified", "identical-payload-digest"

SCHEMA = "record_id string, type string, profile string, url string, date string, status int, headers map<string,string>, digest string, length long, body binary"


def record(kind: str, record_id: str, url: str | None, date: str, status: str, headers: list[tuple[str, str]], body: bytes, digest: str | None = None, profile: str = NOT_MODIFIED) -> bytes:
    """One record as a gzip member."""
    block = (f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + body
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest)]
    if kind == "revisit":
        head.append(("WARC-Profile", f"http://netpreserve.org/warc/1.1/revisit/{profile}"))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 1, mtime=0)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in b" \t" and last:  # folded
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, _, value = line.partition(b":")
            last = name.strip().lower().decode("utf-8", "replace")
            value = value.strip().decode("utf-8", "replace")
            out[last] = f"{out[last]}, {value}" if last in out else value
    return out


class _Damage(Exception):
    """The bytes that follow can't be read; what is behind the next mark may be."""


class _Source:
    """Bytes of a WARC file, plain or of gzip members, a part at a time; knows how to go on behind damage."""

    STEP = 1 << 16

    def __init__(self, stream: io.BufferedIOBase):
        self.stream, self.raw, self.out, self.at = stream, stream.read(self.STEP), b"", 0
        self.gzip = self.raw[:2] == b"\x1f\x8b"
        self.member = None  # the decompressor of the open one
        self.broken = False

    def _more(self) -> bool:
        """More bytes in ``out``; False at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.STEP)
                if not self.raw:
                    if self.member is not None:
                        self.member = None
                        raise _Damage
                    return False
            if not self.gzip:
                new, self.raw = self.raw, b""
            else:
                if self.member is None:
                    self.raw = self.raw.lstrip(b"\0")
                    if not self.raw:
                        continue
                    self.member = zlib.decompressobj(31)
                part, self.raw = self.raw[: self.STEP], self.raw[self.STEP :]
                try:
                    new = self.member.decompress(part)
                except zlib.error:
                    self.raw, self.broken = part + self.raw, True
                    raise _Damage from None
                if self.member.eof:
                    self.raw, self.member = self.member.unused_data + self.raw, None
            if new:
                self.out, self.at = self.out[self.at :] + new, 0
                return True

    def readline(self) -> bytes:
        begin = 0
        while (end := self.out.find(b"\n", self.at + begin)) < 0:
            begin = len(self.out) - self.at
            if not self._more():
                end = len(self.out) - 1
                break
        line, self.at = self.out[self.at : end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        parts, got = [], 0
        while True:
            part = self.out[self.at : self.at + n - got]
            parts.append(part)
            got += len(part)
            self.at += len(part)
            if got == n or not self._more():
                return b"".join(parts)

    def resume(self, rest: bytes) -> int:
        """Goes to the next record in ``rest`` and what is read already, else to the next gzip member or record of the file; the bytes passed over."""
        if not self.broken:
            text = rest + self.out[self.at :]
            if found := re.search(rb"(?:(?<=\n)|^)WARC/1\.", text):
                self.out, self.at = text[found.start() :], 0
                return found.start()
            passed = len(text)
        else:  # its first byte isn't taken for the mark again
            passed, self.raw, self.member, self.broken = 1, self.raw[1:], None, False
        self.out, self.at = b"", 0
        mark = re.compile(rb"\x1f\x8b\x08" if self.gzip else rb"(?<=\n)WARC/1\.")
        if self.gzip and self.member is None and self.raw[:1] == b"\x1f" and passed != 1:
            return passed  # at the start of a member
        self.member = None
        while True:
            if found := mark.search(self.raw):
                self.raw = self.raw[found.start() :]
                return passed + found.start()
            keep = self.raw[-8:]
            new = self.stream.read(self.STEP)
            if not new:
                passed, self.raw = passed + len(self.raw), b""
                return passed
            passed, self.raw = passed + len(self.raw) - len(keep), keep + new


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of a WARC file, plain or of gzip members, read one at a time.

    Where bytes are damaged (a broken member, a length that is no number or reaches beyond the file) a record
    of type ``damaged`` takes their place, its length the bytes passed over, and reading goes on at the next
    member or record.
    """
    source = _Source(stream)
    while True:
        try:
            rest = b""
            line = source.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                continue
            lines = []
            while (line := source.readline()).strip():
                lines.append(line.rstrip(b"\r\n"))
            head = _headers(lines)
            length = head.get("content-length", "0").strip()
            if not re.fullmatch("[0-9]{1,18}", length):
                raise _Damage
            rest = block = source.read(int(length))
            if len(block) < int(length):
                raise _Damage
        except _Damage:
            yield {"record_id": None, "type": "damaged", "profile": None, "url": None, "date": None, "status": None, "headers": {}, "digest": None, "length": source.resume(rest), "body": b""}
            continue
        status, headers, body = None, {}, block
        if "application/http" in head.get("content-type", ""):
            top, _, body = block.partition(b"\r\n\r\n")
            rows = top.split(b"\r\n")
            word = rows[0].split(b" ")
            status = int(word[1]) if len(word) > 1 and re.fullmatch(b"[0-9]{1,9}", word[1]) else None
            headers = _headers(rows[1:])
        yield {
            "record_id": head.get("warc-record-id", "").strip("<>") or None, "type": head.get("warc-type"), "profile": head.get("warc-profile"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "status": status, "headers": headers, "digest": head.get("warc-payload-digest"), "length": len(body), "body": body,
        }


_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("profile", pa.string()), ("url", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("length", pa.int64()), ("body", pa.binary())])


def _batches(records: Iterator[dict], body: bool) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def made():
        return pa.RecordBatch.from_pylist([r | {"headers": list(r["headers"].items()), "body": r["body"] if body else None} for r in rows], _ARROW)

    for r in records:
        rows.append(r)
        size += r["length"]
        if size > 4 << 20 or len(rows) >= 1000:
            yield made()
            rows, size = [], 0
    if rows:
        yield made()


def read_warc(spark: SparkSession, paths: list[str], body: bool = True) -> DataFrame:
    """Records of WARC files, one task a file, streamed; ``paths`` may be of any file system pyarrow opens."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with system.open_input_file(at) as f:
                    yield from _batches(parse(f), body)

    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.repartition(max(1, len(paths)), "path").transform(in_arrow, run, SCHEMA)


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment and empty query; parameters in order; null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    full = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(F.lit("")))
    return F.when(url.isNull(), None).when(scheme == "", bare).otherwise(full)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit with the response it stands for: ``(record_id, url, date, response_id, reason, status, headers, digest, length)``.

    ``reason`` tells by which validator a not-modified revisit is resolved (``etag``, ``last-modified``,
    ``digest``), or why it isn't: ``no url``, ``no date`` (none or a malformed one), ``no earlier response``,
    ``mismatch`` or ``no validator``; then only the revisit's own headers are given. A revisit of an identical
    payload (by its profile, or without one by a status other than 304) has a whole response's headers of its
    own: ``identical`` takes only digest and length from the response, if the digests agree. The latest
    response counts that is strictly earlier and full (status 200), of equal dates the one with the greatest
    id. Entity tags compare without their weakness mark. Repeated records give repeated rows; records of other
    types, and responses without a date or URL, take part in nothing; other columns are not read.

    Records are read once, without their bodies. What a URL's revisits look up is one row for each of its
    dates, filled within days and then over days, so a URL that holds a large share of all records is split.
    """
    full = F.coalesce((F.col("type") == "response") & (F.col("status") == 200), F.lit(False))
    r = records.select("record_id", "profile", "url", "date", "status", "headers", "digest", "length", F.try_to_timestamp("date").alias("at"), canonical(F.col("url")).alias("canon"), full.alias("full"), (F.col("type") == "revisit").alias("again"))
    r = written(r.where("full or again").drop("again"), "records")
    own = F.max_by(F.when(F.col("full"), F.struct("record_id", "status", "headers", "digest", "length")), F.when(F.col("full"), F.struct(F.coalesce("record_id", F.lit("")), "digest", "length")))
    dates = r.where("canon is not null and at is not null").groupBy("canon", "at").agg(own.alias("own")).withColumn("day", F.to_date("at"))
    in_day = W.partitionBy("canon", "day").orderBy("at")
    dates = written(dates.withColumn("of", F.last("own", ignorenulls=True).over(in_day.rowsBetween(W.unboundedPreceding, -1))), "dates")
    days = dates.groupBy("canon", "day").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("at"))).alias("l"))
    days = days.select("canon", "day", F.last("l", ignorenulls=True).over(W.partitionBy("canon").orderBy("day").rowsBetween(W.unboundedPreceding, -1)).alias("earlier")).where("earlier is not null")
    dates = dates.join(days, ["canon", "day"], "left").select("canon", "at", F.coalesce("of", "earlier").alias("of")).where("of is not null")
    joined = r.where("not full").drop("full").join(dates, ["canon", "at"], "left")

    tag = lambda m: F.regexp_replace(F.element_at(m, "etag"), r"^W/", "")
    mine, theirs = F.col("headers"), F.col("of.headers")
    pairs = [("etag", tag(mine), tag(theirs)), ("last-modified", F.element_at(mine, "last-modified"), F.element_at(theirs, "last-modified")), ("digest", F.col("digest"), F.col("of.digest"))]
    identical = F.coalesce(F.col("profile").contains(IDENTICAL), F.coalesce(F.col("status") != 304, F.lit(False)))
    reason = F.when(F.col("canon").isNull(), "no url").when(F.col("at").isNull(), "no date").when(F.col("of").isNull(), "no earlier response")
    reason = reason.when(identical, F.when(F.col("digest").isNull() | F.col("of.digest").isNull(), "no validator").when(F.col("digest") == F.col("of.digest"), "identical").otherwise("mismatch"))
    for name, a, b in pairs:
        reason = reason.when(a.isNotNull() & b.isNotNull(), F.when(a == b, name).otherwise("mismatch"))
    joined = joined.withColumn("reason", reason.otherwise("no validator"))
    good, same = F.col("reason").isin("etag", "last-modified", "digest"), F.col("reason") == "identical"
    kept = F.map_filter(theirs, lambda k, _: ~(k.isin(*PERMITTED) & F.map_contains_key(mine, k)))
    new = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    pick = lambda name, other, when: F.when(when, F.col(f"of.{name}")).otherwise(other).alias(name)
    return joined.select(
        "record_id", "url", "date", F.when(good | same, F.col("of.record_id")).alias("response_id"), "reason", pick("status", F.col("status"), good), F.when(good, F.map_concat(kept, new)).otherwise(mine).alias("headers"),
        pick("digest", F.lit(None).cast(T.StringType()), good | same), pick("length", F.lit(None).cast(T.LongType()), good | same),
    )


def _crawl(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: each page once in full and once, a day on, as not modified, written as WARC and read again."""
    stamp = lambda days: F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("n") * 60 + days * 86_400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    n = F.coalesce("page_id", F.lit(0))
    rows = pages.select(n.alias("n"), "url", F.coalesce("html", F.lit("")).alias("html")).select("n", "url", "html", stamp(0).alias("d0"), stamp(F.when(F.col("n") % 13 == 0, -1).otherwise(1)).alias("d1"), F.sha2("html", 256).alias("sha"))

    def made(batches) -> Iterator[dict]:
        for b in batches:
            for n, url, html, d0, d1, sha in zip(*(c.to_pylist() for c in b.columns)):
                tag = [] if n % 7 == 0 else [("ETag", f'"{sha[:16]}"')]
                other = [] if n % 7 == 0 else [("ETag", 'W/"gone"' if n % 11 == 0 else f'W/"{sha[:16]}"')]
                since = [] if n % 5 == 0 else [("Last-Modified", d0)]
                first = record("response", f"r{n}", url, d0, "200 OK", [("Content-Type", "text/html"), ("Date", d0), *tag, *since], html.encode(), f"sha256:{sha}")
                later = record("revisit", f"v{n}", None if url is None else url + "#again", d1, "304 Not Modified", [("Date", d1), ("Content-Length", "0"), ("Cache-Control", "max-age=60"), *other, *since], b"")
                yield from parse(io.BytesIO(first + later))

    return rows.transform(in_arrow, lambda batches: _batches(made(batches), False), SCHEMA)


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(_crawl(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return out.withColumn("headers", lines)


#: The same from the pages themselves; URLs hold no default port or upper-case host there, so only fragment and order of parameters differ.
ORACLE = r"""
WITH p AS (SELECT coalesce(page_id, 0) AS n, url, coalesce(html, '') AS html FROM pages),
c AS (SELECT n, url, sha256(html) AS sha, strlen(html) AS size,
  strftime(make_timestamp((1704067200 + n * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS d0,
  strftime(make_timestamp((1704067200 + n * 60 + CASE WHEN n % 13 = 0 THEN -1 ELSE 1 END * 86400) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS d1,
  regexp_replace(url, '#.*$', '') AS bare FROM p),
k AS (SELECT *, regexp_replace(bare, '\?.*$', '') || CASE WHEN bare LIKE '%?%' THEN '?' || array_to_string(list_sort(string_split(regexp_extract(bare, '\?(.*)$', 1), '&')), '&') ELSE '' END AS canon FROM c),
j AS (SELECT v.n, v.url, v.d0 AS since, v.d1, v.sha AS vsha, r.n AS rn, r.sha, r.size, r.d0, row_number() OVER (PARTITION BY v.n, v.url ORDER BY r.d0 DESC NULLS LAST, 'r' || r.n DESC) AS pick
  FROM k v LEFT JOIN k r ON r.canon = v.canon AND r.d0 < v.d1),
w AS (SELECT *, CASE WHEN rn IS NULL THEN 'no earlier response'
  WHEN n % 7 <> 0 AND rn % 7 <> 0 THEN CASE WHEN (CASE WHEN n % 11 = 0 THEN 'gone' ELSE vsha[1:16] END) = sha[1:16] THEN 'etag' ELSE 'mismatch' END
  WHEN n % 5 <> 0 AND rn % 5 <> 0 THEN CASE WHEN since = d0 THEN 'last-modified' ELSE 'mismatch' END
  ELSE 'no validator' END AS reason FROM j WHERE pick = 1),
g AS (SELECT *, reason IN ('etag', 'last-modified') AS good FROM w)
SELECT 'v' || n AS record_id, url || '#again' AS url, d1 AS date, CASE WHEN good THEN 'r' || rn END AS response_id, reason, CASE WHEN good THEN 200 ELSE 304 END::INTEGER AS status,
  array_to_string(list_sort(list_filter([
    'cache-control: max-age=60', 'date: ' || d1,
    CASE WHEN n % 7 <> 0 THEN 'etag: W/"' || CASE WHEN n % 11 = 0 THEN 'gone' ELSE vsha[1:16] END || '"' WHEN good AND rn % 7 <> 0 THEN 'etag: "' || sha[1:16] || '"' END,
    CASE WHEN n % 5 <> 0 THEN 'last-modified: ' || since WHEN good AND rn % 5 <> 0 THEN 'last-modified: ' || d0 END,
    CASE WHEN good THEN 'content-type: text/html' ELSE 'content-length: 0' END], lambda x: x IS NOT NULL)), chr(10)) AS headers,
  CASE WHEN good THEN 'sha256:' || sha END AS digest, CASE WHEN good THEN size END::BIGINT AS length
FROM g
"""
