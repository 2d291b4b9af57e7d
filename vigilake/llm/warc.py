"""WARC derivatives: metadata and plain-text conversion records of response records.

A record is a row: record_id, warc_type, warc_date, target_uri, refers_to, refers_to_uri,
refers_to_date, content_type, content_length, block_digest, payload_digest and block. ``derive``
makes two records of each response. Both name the response they come from (identifier, target
and date); the metadata record keeps the response's status, headers and digests as
``application/warc-fields``; the conversion record holds the page's plain text.
Other record types are passed over. Identifiers follow from content, so reruns agree.

Nulls: a null page is empty, a null url leaves the target out (null) and counts as empty in the
identifier; null ids are carried. A response without an empty line after its headers has an
empty payload. A comment, script or style that is never closed takes the rest of the page. Pages of
any length are taken whole. Repeated rows give repeated records, identifiers included. Extra columns
are ignored. Empty tables give no records.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.llm.common import map_rows, table

DATE = "2024-01-31T00:00:00Z"
RECORD = (
    "page_id long, record_id string, warc_type string, warc_date string, target_uri string, refers_to string, refers_to_uri string, "
    "refers_to_date string, content_type string, content_length long, block_digest string, payload_digest string, block string"
)
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "warc_date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "refers_to_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date",
    "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
    "content_length": "Content-Length",
}
_DROP = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)")
_BREAK = re.compile(
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
_TAG, _BLANKS, _LINES = re.compile(r"<[^>]*>"), re.compile(r"[ \t\r\f\v]+"), re.compile(r" ?\n[ \n]*")


def plain_text(page: str) -> str:
    """Visible text, a line for each block; white space inside a line is one space."""
    page = _TAG.sub("", _BREAK.sub("\n", _DROP.sub("", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", html_lib.unescape(page))).strip(" \n")


def digest(data: str) -> str:
    return "sha256:" + hashlib.sha256(data.encode()).hexdigest()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5('|'.join(parts).encode()).hexdigest())}>"


def record(page_id, kind: str, target, content_type: str, block: str, payload: str, name: str, refers=(None, None, None), date=DATE) -> tuple:
    return (page_id, name, kind, date, target, *refers, content_type, len(block.encode()), digest(block), digest(payload), block)


def _columns(rows: list[tuple]) -> dict[str, list]:
    return {c: [r[k] for r in rows] for k, c in enumerate(COLUMNS)}


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record, with an HTTP head, of each row of (page_id, url, html)."""
    def make():
        def work(batch):
            rows = []
            for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                page = page or ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page.encode())}\r\n\r\n"
                name = identifier("response", "" if page_id is None else str(page_id), url or "")
                rows.append(record(page_id, "response", url, "application/http; msgtype=response", head + page, page, name, date=date))
            return _columns(rows)

        return work

    return map_rows(pages.select("page_id", "url", "html"), RECORD, make)


def derive(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response."""
    def make():
        def work(batch):
            rows = []
            for r in zip(*[batch[c] for c in COLUMNS], strict=True):
                r = dict(zip(COLUMNS, r, strict=True))
                head, _, payload = (r["block"] or "").partition("\r\n\r\n")
                status, *lines = head.split("\r\n")
                refers = (r["record_id"], r["target_uri"], r["warc_date"])
                text = plain_text(payload)
                fields = [f"http-status: {status.split(' ')[1] if ' ' in status else ''}", *[f"http-header: {x}" for x in lines]]
                fields += [f"source-block-digest: {r['block_digest']}", f"source-payload-digest: {digest(payload)}", f"text-digest: {digest(text)}"]
                names = [identifier(kind, r["record_id"] or "") for kind in ("metadata", "conversion")]
                fields.append(f"conversion-record: {names[1]}")
                block = "".join(f"{x}\r\n" for x in fields)
                rows.append(record(r["page_id"], "metadata", r["target_uri"], "application/warc-fields", block, block, names[0], refers, r["warc_date"]))
                rows.append(record(r["page_id"], "conversion", r["target_uri"], "text/plain; charset=utf-8", text, text, names[1], refers, r["warc_date"]))
            return _columns(rows)

        return work

    return map_rows(records.filter("warc_type = 'response'").select(*COLUMNS), RECORD, make)


def serialise(records: DataFrame) -> DataFrame:
    """page_id, record_id and the record in the WARC 1.1 file format; null headers are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")) for c, name in HEADERS.items()]
    head = F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\n"))
    return records.select("page_id", "record_id", F.concat(head, F.coalesce("block", F.lit("")), F.lit("\r\n\r\n")).alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over all pages: every derivative record."""
    return derive(responses(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def _uuid_sql(text: str) -> str:
    return f"(SELECT '<urn:uuid:' || substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21) || '>' FROM (SELECT md5({text}) AS h))"


#: DuckDB form; it decodes the references that the pages use.
ORACLE = rf"""
WITH page AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         {_uuid_sql("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS response
  FROM pages
), plain AS (
  SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
           || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS http,
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', '', 'g'),
      '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS marked
  FROM page
), text AS (
  SELECT *, trim(regexp_replace(regexp_replace(
      regexp_replace(replace(replace(replace(replace(replace(marked, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'),
      '[ \t\r\f\v]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS body,
    {_uuid_sql("'metadata|' || response")} AS metadata, {_uuid_sql("'conversion|' || response")} AS conversion
  FROM plain
), fields AS (
  SELECT *, array_to_string(['http-status: 200', 'http-header: Content-Type: text/html; charset=utf-8',
      'http-header: Content-Length: ' || strlen(html), 'source-block-digest: sha256:' || sha256(http),
      'source-payload-digest: sha256:' || sha256(html), 'text-digest: sha256:' || sha256(body), 'conversion-record: ' || conversion, ''],
      chr(13) || chr(10)) AS warc_fields
  FROM text
), records AS (
  SELECT page_id, metadata AS record_id, 'metadata' AS warc_type, url, response, 'application/warc-fields' AS content_type, warc_fields AS block FROM fields
  UNION ALL
  SELECT page_id, conversion, 'conversion', url, response, 'text/plain; charset=utf-8', body FROM fields
)
SELECT page_id, record_id, warc_type, '{DATE}' AS warc_date, url AS target_uri, response AS refers_to, url AS refers_to_uri,
       '{DATE}' AS refers_to_date, content_type, CAST(strlen(block) AS BIGINT) AS content_length,
       'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(block) AS payload_digest, block
FROM records
"""
