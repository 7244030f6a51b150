"""Scalar functions as Column expressions: ids, hashes, names, titles and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of shared-store point ids.
POINT_NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
#: Prefix of shared collection names; a setting, to be given where collections of another tool are read.
COLLECTION_PREFIX = "code_"
#: What text.split() separates at: Unicode white space and the four information separators.
_WHITE = r"(?U)[\s\x1c-\x1f]+"


def sha_prefix(value: Column, n: int = 64) -> Column:
    return F.substring(F.sha2(value, 256), 1, n)


def deterministic_id(repo: Column, branch: Column, file: Column, start_line: Column) -> Column:
    return sha_prefix(F.concat_ws(":", repo, branch, file, start_line.cast("string")), 32)


def content_hash(text: Column) -> Column:
    return sha_prefix(text, 16)


def normalized_hash(content: Column) -> Column:
    """SHA-256 of the lower-cased content with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(content), _WHITE, " ")), 256)


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """UUID version 5 of a name, byte for byte."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12)
    )


def collection_name(repo: Column, prefix: str = COLLECTION_PREFIX) -> Column:
    return F.concat(F.lit(prefix), sha_prefix(repo, 16))


def trim_slashes(path: Column) -> Column:
    return F.rtrim(path, F.lit("/"))


def repo_name(path: Column) -> Column:
    """Last part of a path, without slashes at its end."""
    return F.substring_index(trim_slashes(path), "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def file_stem(path: Column) -> Column:
    """Basename without its last extension; a leading dot is no extension."""
    base = F.substring_index(path, "/", -1)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")


def visibility(name: Column) -> Column:
    return F.when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")


def signature(kind: Column, name: Column, params: Column, returns: Column) -> Column:
    """kind name(params) -> returns; params come with parentheses of their own, which are kept."""
    return F.concat(
        kind, F.lit(" "), name, F.when(params != "", F.concat(F.lit("("), params, F.lit(")"))).otherwise(""), F.when(returns != "", F.concat(F.lit(" -> "), returns)).otherwise("")
    )


def qualified_name(file: Column, parent: Column, name: Column) -> Column:
    return F.concat(file, F.lit("::"), F.when(F.coalesce(parent, F.lit("")) != "", F.concat(parent, F.lit("."))).otherwise(""), name)


def token_estimate(code: Column) -> Column:
    """Characters over four."""
    return F.floor(F.char_length(code) / 4).cast("long")


def context_cost(text: Column) -> Column:
    """UTF-8 bytes over four."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def split_params(params: Column) -> Column:
    """Trimmed, non-empty parameters of a comma-separated list with or without parentheses."""
    inner = F.regexp_replace(params, r"^\s*\(|\)\s*$", "")
    return F.filter(F.transform(F.split(inner, ",", -1), lambda p: F.trim(p)), lambda p: p != "")


def auto_title(content: Column) -> Column:
    """First line without a **What**: mark, at most 80 characters."""
    first = F.trim(F.substring_index(F.trim(content), "\n", 1))
    return F.substring(F.trim(F.replace(first, F.lit("**What**:"), F.lit(""))), 1, 80)


def preview(content: Column, n: int = 200) -> Column:
    return F.when(F.char_length(content) > n, F.concat(F.substring(content, 1, n), F.lit("..."))).otherwise(content)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def iso_utc(time: Column) -> Column:
    """A time as ISO text with microseconds and offset; the clock is the caller's. The session's time zone must be UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def from_iso(text: Column) -> Column:
    """The time of ISO or RFC 3339 text, with or without fractions of a second; null where it is none."""
    return text.try_cast("timestamp")
