"""Files cut into retrieval chunks: `file -> rows` functions of two profiles.

local: byte windows with overlap at line ends (code) or natural boundaries (text, by heading).
remote: line windows (code) and character windows (text), and records of mails, contacts, calendars.
Each file is cut within its own row; nothing is shuffled.
"""

from __future__ import annotations

import email
import quopri
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from email import policy
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.filetypes import file_type, is_code
from quarrylake.functions.hashes import chunk_id, content_hash
from quarrylake.functions.text import clock, plain_html

# Fixed values.
CODE_BYTES, CODE_OVERLAP = 3000, 1000
TEXT_BYTES, TEXT_OVERLAP = 2400, 400
CODE_LINES, CODE_LINE_OVERLAP = 300, 50
SECTION_CHARS, SECTION_OVERLAP = 2000, 200
MEDIA_SECONDS, MEDIA_OVERLAP = 360, 60
MAIL_HEADERS = ["Subject", "From", "To", "Cc", "Date"]
CONTACT_FIELDS = {"FN": "Name", "N": "Name", "ORG": "Organization", "TITLE": "Title", "EMAIL": "Email", "TEL": "Phone", "ADR": "Address", "URL": "URL", "NOTE": "Note", "CATEGORIES": "Categories"}
EVENT_FIELDS = {"SUMMARY": "Title", "DTSTART": "Start", "DTEND": "End", "DUE": "Due", "LOCATION": "Location", "DESCRIPTION": "Description", "ORGANIZER": "Organizer", "ATTENDEE": "Attendee", "STATUS": "Status", "URL": "URL"}

HEADING = re.compile(r"^#{1,6}\s", re.M)
Piece = tuple[str, int | None, int | None]  # content, first and last line from 1


def code_windows(text: str, limit: int = CODE_BYTES, overlap: int = CODE_OVERLAP) -> list[Piece]:
    """Runs of lines of up to `limit` bytes (one line at least); the next run repeats the fewest whole lines
    that hold `overlap` bytes, or none if that would be the whole run. Blank runs are left out."""
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + [lines[-1]]
    total = [0, *accumulate(map(len, lines))]
    n, start, out = len(lines), 0, []
    while start < n:
        end = max(start + 1, bisect_right(total, total[start] + limit) - 1)
        piece = raw[total[start] : total[end]]
        if piece.strip():
            last = end - 1 if end == n and not lines[-1] else end
            out.append((piece.decode("utf-8", "replace"), start + 1, last))
        if end == n:
            break
        back = bisect_right(total, total[end] - overlap) - 1
        start = back if back > start else end
    return out


def _sections(text: str) -> list[tuple[int, int]]:
    """Ranges that begin at a heading (or the text's start)."""
    cuts = [m.start() for m in HEADING.finditer(text)]
    if not cuts:
        return [(0, len(text))] if text.strip() else []
    cuts = ([0] if cuts[0] else []) + cuts + [len(text)]
    return list(zip(cuts, cuts[1:]))


def text_windows(text: str, limit: int = TEXT_BYTES, overlap: int = TEXT_OVERLAP) -> list[Piece]:
    """Sections by heading, each in windows of up to `limit` bytes. A window ends after the last blank line in
    its second half, else after the last line end, sentence or blank there, else anywhere between two
    characters; the next begins `overlap` bytes before its end. Line numbers are those of the text."""
    out = []
    line_ends = [m.start() for m in re.finditer(b"\n", text.encode("utf-8", "surrogatepass"))]
    offset = 0
    for a, b in _sections(text):
        raw = text[a:b].encode("utf-8", "surrogatepass")
        start = 0
        while True:
            end = start + limit
            if end >= len(raw):
                end = len(raw)
            else:
                half = start + limit // 2
                for mark in (b"\n\n", b"\n", b". ", b" "):
                    if (i := raw.rfind(mark, half, end)) >= 0:
                        end = i + len(mark)
                        break
                else:
                    while raw[end] & 0xC0 == 0x80:
                        end -= 1
            piece = raw[start:end]
            if piece.strip():
                first = 1 + bisect_left(line_ends, offset + start)
                last = 1 + bisect_left(line_ends, offset + end - 1)
                out.append((piece.decode("utf-8", "replace"), first, max(first, last)))
            if end == len(raw):
                break
            nxt = end - overlap
            while nxt > start and raw[nxt] & 0xC0 == 0x80:
                nxt -= 1
            start = nxt if nxt > start else end
        offset += len(raw)
    return out


def line_blocks(text: str, size: int = CODE_LINES, overlap: int = CODE_LINE_OVERLAP) -> list[Piece]:
    lines = text.splitlines(keepends=True)
    starts = [s for s in range(0, len(lines), size - overlap) if s == 0 or s + overlap < len(lines)]
    blocks = (("".join(lines[s : s + size]), s + 1, min(s + size, len(lines))) for s in starts)
    return [b for b in blocks if b[0].strip()]


def char_windows(text: str, size: int, overlap: int) -> list[str]:
    if len(text) <= size:
        return [text]
    return [text[s : s + size] for s in range(0, len(text), size - overlap) if s == 0 or s + overlap < len(text)]


def section_windows(text: str) -> list[Piece]:
    """Sections by heading in windows of characters, with the lines they stand on."""
    out = []
    for a, b in _sections(text):
        at = a
        for k, piece in enumerate(char_windows(text[a:b], SECTION_CHARS, SECTION_OVERLAP)):
            at = a + k * (SECTION_CHARS - SECTION_OVERLAP)
            if piece.strip():
                first = 1 + text.count("\n", 0, at)
                out.append((piece, first, first + piece.rstrip("\n").count("\n")))
    return out


def packed_records(records: list[str], limit: int = SECTION_CHARS) -> list[str]:
    """Records joined by blank lines into texts of up to `limit` characters; a longer one is cut into windows of its own."""
    out: list[str] = []
    open_: list[str] = []
    for r in filter(None, map(str.strip, records)):
        if len(r) > limit:
            out += ["\n\n".join(open_)] if open_ else []
            open_ = []
            out += char_windows(r, limit, SECTION_OVERLAP)
        elif open_ and sum(map(len, open_)) + 2 * len(open_) + len(r) > limit:
            out.append("\n\n".join(open_))
            open_ = [r]
        else:
            open_.append(r)
    return out + (["\n\n".join(open_)] if open_ else [])


def _texts(texts: list[str]) -> list[Piece]:
    return [(t.strip(), None, None) for t in texts if t.strip()]


def mail_chunks(raw: bytes) -> list[Piece]:
    """Windows over a mail's body, each under the mail's header lines. Plain parts go before HTML; attachments are left out."""
    m = email.message_from_bytes(raw, policy=policy.default)
    head = "\n".join(f"{n}: {m[n]}" for n in MAIL_HEADERS if m[n]).strip()
    found: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for part in m.walk():
        kind = part.get_content_type()
        if part.is_multipart() or part.get_content_disposition() == "attachment" or kind not in found:
            continue
        try:
            text = str(part.get_content())
        except LookupError:
            text = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
        found[kind].append((plain_html(text) if kind == "text/html" else text).strip())
    body = ("\n\n".join(filter(None, found["text/plain"])) or "\n\n".join(filter(None, found["text/html"]))).strip()
    if not body:
        return _texts([head])
    room = max(SECTION_CHARS - len(head) - 2, SECTION_CHARS // 2)
    return _texts([f"{head}\n\n{w}" if head else w for w in char_windows(body, room, min(SECTION_OVERLAP, room // 4))])


def structured_value(value: str) -> str:
    """Quoted-printable and backslash escapes resolved, semicolons to blanks, white space to single blanks."""
    value = quopri.decodestring(value.encode("utf-8", "replace")).decode("utf-8", "replace")
    value = re.sub(r"\\([n,;])", lambda m: "\n" if m[1] == "n" else m[1], value)
    return " ".join(value.replace(";", " ").split())


def _unfolded(text: str) -> list[str]:
    return re.sub(r"\n[ \t]", "", re.sub(r"\r\n?", "\n", text)).split("\n")


def _blocks(lines: list[str], name: str) -> list[list[str]]:
    out, open_ = [], None
    for line in lines:
        up = line.upper()
        if up == f"BEGIN:{name}":
            open_ = []
        elif up == f"END:{name}" and open_ is not None:
            out.append(open_)
            open_ = None
        elif open_ is not None:
            open_.append(line)
    return out


def record_chunks(raw: bytes, names: list[str], fields: dict[str, str], title: str) -> list[Piece]:
    """Records of the first kind in `names` that occurs (else the whole text), as labelled lines, packed."""
    lines = _unfolded(raw.decode("utf-8-sig", "replace"))
    blocks = next((b for n in names if (b := _blocks(lines, n))), [lines])
    records = []
    for i, block in enumerate(blocks, 1):
        got: dict[str, list[str]] = {}
        for line in block:
            key, colon, value = line.partition(":")
            if colon and (value := structured_value(value)):
                got.setdefault(key.split(";")[0].upper(), []).append(value)
        records.append("\n".join([f"{title} {i}", *(f"{label}: {v}" for key, label in fields.items() for v in got.get(key, []))]))
    return _texts(packed_records(records))


def chunk_bytes(raw: bytes, kind: str, code: bool, profile: str, describe: Callable[[bytes, str], list[str]] | None = None) -> list[Piece]:
    """Chunks of one file. `describe` turns files that need a model (pages, images, media) into texts; without it they get a placeholder."""
    if kind == "eml":
        return mail_chunks(raw)
    if kind == "vcf":
        return record_chunks(raw, ["VCARD"], CONTACT_FIELDS, "Contact")
    if kind == "ics":
        return record_chunks(raw, ["VEVENT", "VTODO"], EVENT_FIELDS, "Calendar item")
    if kind in ("pdf", "docx", "pptx"):
        texts = describe(raw, kind) if describe else [""]
        return [((t or "").strip() or f"[Page {i}: no extractable text]", None, None) for i, t in enumerate(texts, 1)]
    if kind in ("image", "audio", "video", "msg"):
        texts = describe(raw, kind) if describe else []
        return _texts(texts) or [(f"[{kind.capitalize()} file]", None, None)]
    if profile == "local":
        text = raw.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode("utf-8", "replace")
        return code_windows(text) if code else text_windows(text)
    text = raw.decode("utf-8-sig", "replace")
    return line_blocks(text) if code else section_windows(text)


def chunk_files(files: DataFrame, profile: str = "local", describe: Callable[[bytes, str], list[str]] | None = None) -> DataFrame:
    """Chunk rows of files (root_id, path, content binary or string). Null contents have none, blank ones neither."""
    kind = file_type(F.col("path"), profile)
    code = is_code(F.col("path")) if profile == "local" else ~kind.isin("markdown", "text") & is_code(F.col("path"))
    given = files.where(F.col("content").isNotNull()).select("root_id", "path", kind.alias("file_type"), F.coalesce(code, F.lit(False)).alias("code"), F.col("content").cast("binary").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for root, path, t, c, raw in zip(b["root_id"], b["path"], b["file_type"], b["code"], b["content"]):
                rows += [(root, path, t, i, *piece) for i, piece in enumerate(chunk_bytes(bytes(raw), t, bool(c), profile, describe))]
            out = pd.DataFrame(rows, columns=["root_id", "file_path", "file_type", "chunk_index", "content", "line_start", "line_end"])
            yield out.astype({"line_start": "Int32", "line_end": "Int32", "chunk_index": "int32"})

    cut = given.mapInPandas(run, "root_id string, file_path string, file_type string, chunk_index int, content string, line_start int, line_end int")
    paged = F.col("file_type").isin("pdf", "docx", "pptx")
    return cut.select(
        chunk_id(F.col("root_id"), F.col("file_path"), F.col("chunk_index")).alias("id"), "root_id", "file_path", "chunk_index", "content", content_hash(F.col("content")).alias("content_hash"),
        "file_type", F.when(paged, F.col("chunk_index")).alias("page_number"), F.lit(None).cast("string").alias("image_path"), "line_start", "line_end",
    )


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (chunk_index, content): windows of characters as built-in expressions; blank ones are left out."""
    n, stride = F.length(text), size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda s: (s == 0) | (s + overlap < n))
    pieces = F.filter(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))), lambda p: F.trim(p) != "")
    return F.transform(pieces, lambda p, i: F.struct(i.alias("chunk_index"), p.alias("content")))


def line_windows(text: Column, size: int = CODE_LINES, overlap: int = CODE_LINE_OVERLAP) -> Column:
    """Array of (line_start, line_end, content): windows of lines (ending in LF) as built-in expressions."""
    lines = F.filter(F.split(text, r"(?<=\n)"), lambda x: x != "")
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < n))
    whole = F.transform(starts, lambda s: F.struct((s + 1).alias("line_start"), F.least(s + size, n).alias("line_end"), F.array_join(F.slice(lines, s + 1, F.lit(size)), "").alias("content")))
    return F.filter(whole, lambda w: F.trim(w["content"]) != "")


def media_ranges(seconds: Column, size: int = MEDIA_SECONDS, overlap: int = MEDIA_OVERLAP) -> Column:
    """Array of (index, start, end) in seconds; a media file of unknown length has one full window."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.ceil(seconds).cast("int"), F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < seconds))
    some = F.transform(starts, lambda s, i: F.struct(i.alias("index"), s.cast("double").alias("start"), F.least(s + size, seconds).cast("double").alias("end")))
    return F.when(F.coalesce(seconds, F.lit(0)) <= 0, F.array(F.struct(F.lit(0).alias("index"), F.lit(0.0).alias("start"), F.lit(float(size)).alias("end")))).otherwise(some)


def media_label(start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("["), clock(start), F.lit("-"), clock(end), F.lit("] "), text)
