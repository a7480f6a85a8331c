"""Identity: content hashes, keys and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the DNS namespace of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def identity_key(repo: Column, path: Column) -> Column:
    return F.concat(repo, F.lit("/"), F.translate(path, "\\", "/"))


def uuid5(name: Column) -> Column:
    """UUID version 5 in the DNS namespace."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_id(key: Column, start_line: Column, hash_: Column) -> Column:
    return uuid5(F.concat_ws(":", key, start_line.cast("string"), hash_))


def group_hash(hashes: Column) -> Column:
    """Of a set of chunk hashes, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(hashes), "|"), 256)


def prompt_version(version: Column, model: Column, prompt: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", version, model, prompt), 256), 1, 8)


def split_70_30(text: Column) -> Column:
    """Calibration or check, by the first byte of the hash."""
    return F.when(F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int") % 10 >= 7, "check").otherwise("calibration")
