"""Column functions on links, form bodies and blobs of a hosting service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hunkyard.functions.text import index_language


def pull_request(link: Column) -> tuple[Column, Column]:
    """Repository and number of ``https://github.com/o/r/pull/N`` or ``o/r#N``; null for anything else."""
    url, short = r"github\.com/([^/\s]+/[^/\s]+)/pull/(\d+)", r"^\s*([^/\s#]+/[^/\s#]+)#(\d+)\s*$"
    get = lambda n: F.coalesce(F.nullif(F.regexp_extract(link, url, n), F.lit("")), F.nullif(F.regexp_extract(link, short, n), F.lit("")))
    return get(1), get(2).cast("int")


def payload(body: Column, content_type: Column) -> Column:
    """The JSON text of a delivery, which may be a form with the text in its ``payload`` field."""
    form = F.try_url_decode(F.nullif(F.regexp_extract(body, r"(?:^|&)payload=([^&]*)", 1), F.lit("")))
    text = F.when(F.coalesce(content_type, F.lit("")).startswith("application/x-www-form-urlencoded"), form).otherwise(body)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def blob_text(path: Column, content: Column, encoding: Column) -> Column:
    """The text of a base64 blob in a language of the index; bytes outside UTF-8 are replaced; null where unsupported."""
    raw = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    return F.when(index_language(path).isNotNull() & (encoding == "base64"), F.decode(F.encode(F.make_valid_utf8(raw.cast("string")), "utf-8"), "utf-8"))


def without_json_comments(c: Column) -> Column:
    """A JSON text without block comments and without lines that are comments."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"(?m)^\s*//.*$", "")
