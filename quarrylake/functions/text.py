"""Small text functions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def slug(c: Column) -> Column:
    """Letters a-z and digits kept, runs of - _ . and blanks become one dash, all else goes."""
    kept = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9\-_ .]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\-_ .]+", "-"), r"^-+|-+$", "")


def safe_object_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9\-_.]", "")


def policy_text(c: Column) -> Column:
    """Ignore policy with LF line ends; null where it has a NUL or more than 256 KiB."""
    t = F.regexp_replace(c, "\r\n", "\n")
    return F.when(~t.contains("\0") & (F.octet_length(t) <= 256 * 1024), t)


def email_address(c: Column) -> Column:
    return F.lower(F.trim(c))


def email_domain(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"@([^@]*)$", 1)), F.lit(""))


def byte_size(c: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    unit = lambda power, name: F.concat(F.format_string("%.1f", c / float(1 << power)), F.lit(f" {name}"))
    return F.when(c >= 1 << 30, unit(30, "GB")).when(c >= 1 << 20, unit(20, "MB")).when(c >= 1 << 10, unit(10, "KB")).otherwise(F.concat(c.cast("string"), F.lit(" B")))


def clock(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on; negative times are 0."""
    s = F.greatest(F.rint(seconds).cast("long"), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def image_url(root: Column, key: Column) -> Column:
    return F.concat(F.lit("/roots/"), root, F.lit("/assets?key="), F.url_encode(key))


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9, in order."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if (t := data.strip()) != "":
            self.parts.append(t)


def plain_html(html: str) -> str:
    """Text nodes, trimmed, one a line."""
    p = _Text()
    p.feed(html)
    return "\n".join(p.parts)


@F.pandas_udf(StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: plain_html(x) if isinstance(x, str) else None)


def flat_pairs(prefix: str, raw: str | None) -> list[tuple[str, str]] | None:
    """(dotted key, value) of JSON; arrays as key[i], keys sorted, scalars as JSON writes them; null for no JSON."""
    try:
        value = json.loads(raw, parse_float=str, parse_int=str)
    except (TypeError, ValueError):
        return None
    out: list[tuple[str, str]] = []
    stack = [(prefix, value)]
    while stack:
        key, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{key}.{k}", v[k]) for k in sorted(v, reverse=True)]
        elif isinstance(v, list):
            stack += [(f"{key}[{i}]", v[i]) for i in range(len(v) - 1, -1, -1)]
        else:
            out.append((key, v if isinstance(v, str) else json.dumps(v)))
    return out or [(prefix, raw)]


def flatten_json(df: DataFrame, key: str, raw: str, prefix: str = "content") -> DataFrame:
    """(key, pos, name, value) of each JSON text; rows that aren't JSON, or null, have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, n, v) for k, r in zip(b["key"], b["raw"]) for i, (n, v) in enumerate(flat_pairs(prefix, r) or [])]
            yield pd.DataFrame(rows, columns=["key", "pos", "name", "value"])

    return df.where(F.col(raw).isNotNull()).select(F.col(key).alias("key"), F.col(raw).alias("raw")).mapInPandas(run, f"key {kind}, pos int, name string, value string").withColumnRenamed("key", key)
