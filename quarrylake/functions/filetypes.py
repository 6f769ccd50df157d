"""File types by path, in the two profiles that chunk boundaries depend on."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions.paths import base_name, extension

# Types by extension.
DOCUMENTS = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".pptx": "pptx", ".ppt": "pptx", ".eml": "eml", ".msg": "msg", ".vcf": "vcf", ".ics": "ics", ".mp3": "audio", ".wav": "audio", ".mp4": "video", ".mov": "video"}
IMAGES = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp"]
CODE = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "shell", ".bash": "bash", ".lua": "lua", ".pl": "perl", ".r": "r", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss",
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json", ".xml": "xml", ".proto": "proto", ".graphql": "graphql", ".hcl": "hcl", ".tf": "terraform",
}
REMOTE_MORE = {".jsx": "javascript", ".tsx": "typescript", ".h": "c", ".hpp": "cpp", ".md": "markdown", ".rst": "markdown", ".txt": "text"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def remote_kind(path: Column) -> Column:
    """Coarse type that routes a file: a document type, `image`, or `auto`."""
    return F.coalesce(_lookup(DOCUMENTS | dict.fromkeys([*IMAGES, ".svg"], "image"), extension(path)), F.lit("auto"))


def file_type(path: Column, profile: str = "local") -> Column:
    """Type of a file. local: code by 33 extensions, `svg`, default markdown. remote: more extensions, default text."""
    base, ext = F.lower(base_name(path)), extension(path)
    if profile == "local":
        named = F.when(base == "dockerfile", "dockerfile").when(base == "makefile", "makefile")
        return F.coalesce(_lookup(DOCUMENTS | dict.fromkeys(IMAGES, "image") | {".svg": "svg"} | CODE, ext), named, F.lit("markdown"))
    table = DOCUMENTS | dict.fromkeys([*IMAGES, ".svg"], "image") | {k: v for k, v in CODE.items() if k != ".cc"} | REMOTE_MORE
    return F.when(base.isin("dockerfile", "makefile", "rakefile", "gemfile"), "shell").otherwise(F.coalesce(_lookup(table, F.regexp_extract(base, r"(?<=.)\.[^.]*$", 0)), F.lit("text")))


def local_chunkable(path: Column) -> Column:
    """Whether a file is text that needs no extraction service; svg is, though it is an image."""
    return (extension(path) == ".svg") | (remote_kind(path) == "auto")


def is_code(path: Column) -> Column:
    return extension(path).isin(*CODE) | F.lower(base_name(path)).isin("dockerfile", "makefile")
