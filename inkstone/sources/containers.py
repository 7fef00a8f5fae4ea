"""Readers of container files: EPUB books, DOCX and Markdown manuscripts, mbox archives and SQLite chats.

Files are read by Spark (binaryFile), so any store will do, and taken apart in Arrow batches, one row in, many rows out.
A file that can't be read gives one row with its error, and no others. A file is handled whole in one task.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import html
import io
import posixpath
import re
import sqlite3
import tempfile
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>")
_BREAK = re.compile(r"(?i)<(?:br|/p|/div|/h[1-6]|/li)\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")


def plain(markup: str) -> str:
    """Markup as text: paragraphs at block ends, entities resolved."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n\n", _BLOCK.sub("", markup))))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n"))).strip()


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _files(spark: SparkSession, path: str, take, columns: str) -> DataFrame:
    """take(path, bytes) yields tuples of columns; adds path, part (from 0) and error."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(frames):
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows, error = list(take(where, bytes(content))), None
                except Exception as bad:  # a broken file is data, and is reported as such
                    rows, error = [], f"{type(bad).__name__}: {bad}"
                out = [(where, i, None, *r) for i, r in enumerate(rows)] or ([(where, None, error, *[None] * len(names))] if error else [])
                if out:
                    yield pd.DataFrame(out, columns=["path", "part", "error", *names])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, part long, error string, {columns}")


def epub_parts(where: str, data: bytes):
    """(title, text) in the order of the spine, parts without text left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        package = next(n.get("full-path") for n in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if _local(n) == "rootfile")
        root = ElementTree.fromstring(book.read(package))
        items = {n.get("id"): n.get("href") for n in root.iter() if _local(n) == "item"}
        for ref in (n.get("idref") for n in root.iter() if _local(n) == "itemref"):
            markup = book.read(posixpath.normpath(posixpath.join(posixpath.dirname(package), items[ref]))).decode("utf-8", "replace")
            head = re.search(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>", markup)
            if text := plain(markup):
                yield plain(head[1]) if head else None, text


def epub_chapters(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, epub_parts, "title string, text string")


def docx_lines(data: bytes) -> list[tuple[bool, str]]:
    """(is a heading, text) of each paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as f:
        root = ElementTree.fromstring(f.read("word/document.xml"))
    out = []
    for p in root.iter():
        if _local(p) == "p":
            style = next((v for n in p.iter() if _local(n) == "pStyle" for k, v in n.attrib.items() if k.endswith("val")), "")
            out.append((style.lower().startswith(("heading", "title")), "".join(n.text or "" for n in p.iter() if _local(n) == "t")))
    return out


def sections(lines: list[tuple[bool, str]], window: int = 2000):
    """(heading, text) at headings; without any, parts of `window` words, the last one shorter."""
    if not any(h for h, _ in lines):
        every = " ".join(t for _, t in lines).split()
        yield from ((None, " ".join(every[i : i + window])) for i in range(0, len(every), window))
        return
    head, body = None, []
    for is_head, text in [*lines, (True, "")]:
        if is_head:
            if said := "\n\n".join(body).strip():
                yield head, said
            head, body = text.strip(), []
        elif text.strip():
            body.append(text.strip())


def manuscripts(spark: SparkSession, path: str, window: int = 2000) -> DataFrame:
    """DOCX, Markdown and plain text files in sections."""

    def take(where: str, data: bytes):
        kind = where.rsplit(".", 1)[-1].lower()
        if kind == "docx":
            return sections(docx_lines(data), window)
        heads = re.compile(r"^#{1,3}\s+") if kind == "md" else re.compile(r"(?i)^chapter\s+(\d+|[ivxlc]+)\b")
        lines = data.decode("utf-8-sig").splitlines()
        return sections([(bool(heads.match(x)), re.sub(r"^#{1,3}\s+", "", x)) for x in lines], window)

    return _files(spark, path, take, "title string, text string")


def body_of(message) -> str:
    part = message.get_body(("plain", "html"))
    if part is None:
        return ""
    text = part.get_content()
    return plain(text) if part.get_content_type() == "text/html" else text


def own_words(text: str) -> str:
    """A mail's text up to its signature or the quoted mail, without quoted lines."""
    kept = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.rstrip("\r") in ("-- ", "--") or re.match(r"(?i)^-{2,}\s*(original|forwarded) message", line) or re.match(r"^On .{4,200} wrote:\s*$", line):
            break
        if not line.startswith(">"):
            kept.append(line)
    return "\n".join(kept).strip()


def mbox_parts(where: str, data: bytes):
    for raw in re.split(rb"(?m)^From [^\n]*\n", data)[1:]:
        m = email.message_from_bytes(re.sub(rb"(?m)^>(>*From )", rb"\1", raw), policy=email.policy.default)
        try:
            sent = email.utils.parsedate_to_datetime(str(m["Date"])) if m["Date"] else None
        except ValueError:
            sent = None
        before = re.findall(r"<[^>]+>", f"{m.get('References', '')} {m.get('In-Reply-To', '')}")
        yield str(m.get("Message-ID", "")).strip(), (before or [None])[0], email.utils.parseaddr(str(m.get("From", "")))[1].lower(), str(m.get("Subject", "")), sent and sent.timestamp(), own_words(body_of(m))


def mbox_messages(spark: SparkSession, path: str, sender: str | None = None) -> DataFrame:
    """Messages with what their writer wrote; thread is the first message referred to, or the message itself."""
    df = _files(spark, path, mbox_parts, "message_id string, root string, sender string, subject string, sent double, text string")
    df = df.withColumn("thread", F.coalesce("root", "message_id")).drop("root")
    return df if sender is None else df.where(F.col("sender") == sender.lower())


def sqlite_rows(spark: SparkSession, path: str, sql: str, columns: str) -> DataFrame:
    """Rows of one statement over each SQLite file, which is copied to the task's own temporary file for it."""

    def take(where: str, data: bytes):
        with tempfile.NamedTemporaryFile(suffix=".db") as f:
            f.write(data)
            f.flush()
            con = sqlite3.connect(f.name)
            try:
                yield from con.execute(sql)
            finally:
                con.close()

    return _files(spark, path, take, columns)


def chat_days(messages: DataFrame, zone: str = "UTC") -> DataFrame:
    """Outgoing messages (contact, at as epoch seconds, text) as one text per contact and local day, in order of time."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros((F.col("at") * 1_000_000).cast("long")), zone))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return messages.where("text is not null AND trim(text) <> ''").groupBy("contact", day.alias("day")).agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x.text), "\n").alias("text"))
