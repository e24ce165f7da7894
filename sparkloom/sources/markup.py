"""Texts of XML documents and of e-mail."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators.documents import page_text

#: The entities every XML document knows, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def xml_text(xml: Column) -> Column:
    """The character data of an XML document with one space for each run of white space and markup; null for null.

    Comments, instructions and the document type have no text; CDATA is taken as it is.
    Entities of the document's own and by number stay as they are written.
    """
    def plain(part: Column) -> Column:
        out = F.regexp_replace(part, r"(?s)<\?.*?\?>|<!DOCTYPE[^\[>]*(?:\[.*?\])?[^>]*>|<[^>]*>", " ")
        for entity, character in ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(character))
        return out

    # Every other part stood in CDATA.
    parts = F.split(F.regexp_replace(xml, r"(?s)<!--.*?-->", " "), r"<!\[CDATA\[|\]\]>")
    whole = F.array_join(F.transform(parts, lambda part, k: F.when(k % 2 == 1, part).otherwise(plain(part))), "")
    return F.when(xml.isNotNull(), F.trim(F.regexp_replace(whole, r"\s+", " ")))


def mail_texts(mails: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, subject, sender, receivers, sent, text, attachments) of messages as they are sent, headers and parts decoded.

    The text is that of the first plain part, else of the first HTML part without its
    markup; ``sent`` is the date as it is written, ``attachments`` are names.  Null or
    empty messages have an empty text and null fields; of a damaged one what can be read is given.
    """
    rows = mails.select(F.col(key).alias("key"), F.col(raw).cast("binary").alias("raw"))
    schema = StructType([rows.schema["key"], *StructType.fromDDL("subject string, sender string, receivers string, sent string, body string, html boolean, attachments array<string>").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from email import message_from_bytes
        from email.policy import default

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def header(message, name: str) -> str | None:
            try:
                value = message[name]
                return None if value is None else str(value).encode("utf-8", "replace").decode()
            except (ValueError, IndexError, AttributeError):
                return None

        def content(part) -> str:
            data = part.get_payload(decode=True) or b""
            try:
                return data.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                return data.decode("utf-8", "replace")

        for batch in batches:
            out = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                message = message_from_bytes(data or b"", policy=default)
                parts = [p for p in message.walk() if not p.is_multipart()]
                names = [p.get_filename() or "" for p in parts if p.get_content_disposition() == "attachment"]
                texts = [p for p in parts if p.get_content_disposition() != "attachment" and p.get_content_maintype() == "text"]
                best = next((p for kind in ("text/plain", "text/html") for p in texts if p.get_content_type() == kind), None)
                out.append((k, *(header(message, n) for n in ("subject", "from", "to", "date")), content(best) if best is not None else "", best is not None and best.get_content_type() == "text/html", names))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    text = F.when(F.col("html"), page_text(F.col("body"))).otherwise(F.col("body"))
    return rows.mapInArrow(read, schema).select(F.col("key").alias(key), "subject", "sender", "receivers", "sent", text.alias("text"), "attachments")
