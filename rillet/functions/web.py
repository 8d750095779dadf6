"""UUIDs, URLs and what concerns the host."""

from __future__ import annotations

import os
import socket

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import builtin


def _named(hashed: Column, version: str) -> Column:
    """32 hex digits with version and variant bits set, in the usual groups."""
    variant = F.translate(F.substring(hashed, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda a, n: F.substring(hashed, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit(version), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def _bytes(namespace: Column | str, name: Column) -> Column:
    ns = namespace if isinstance(namespace, Column) else F.lit(namespace)
    return F.concat(F.unhex(F.replace(ns, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8"))


@builtin("uuid3/1")
def uuid3(name: Column, namespace: Column | str) -> Column:
    return _named(F.md5(_bytes(namespace, name)), "3")


@builtin("uuid5/1")
def uuid5(name: Column, namespace: Column | str) -> Column:
    return _named(F.substring(F.sha1(_bytes(namespace, name)), 1, 32), "5")


@builtin("uuid4/0")
def uuid4() -> Column:
    return F.uuid()


@builtin("random/0")
def random() -> Column:
    return F.rand()


@builtin("hostname/0", "hostname/1")
def hostname(which: str | None = None) -> Column:
    """The driver's, as a literal."""
    return F.lit(socket.getfqdn() if which == "fqdn" else socket.gethostname())


@builtin("env/0")
def environment() -> Column:
    """The driver's environment as a literal map; only for those who ask for it."""
    pairs = [F.lit(x) for kv in sorted(os.environ.items()) for x in kv]
    return F.create_map(*pairs)


@builtin("uriparse/0")
def uriparse(url: Column) -> Column:
    """The parts of a URL; port -1 if absent, query_obj a map of arrays of decoded values."""
    part = lambda n: F.try_parse_url(url, F.lit(n))
    authority, query = part("AUTHORITY"), part("QUERY")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    raw = F.regexp_extract(url, r"^[^:/?#]+:(?://[^/?#]*)?([^?#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.url_decode(F.get(F.split(p, "=", 2), 0)).alias("k"), F.url_decode(F.get(F.split(p, "=", 2), 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.struct(
        part("PROTOCOL").alias("scheme"), part("USERINFO").alias("user_info"), authority.alias("raw_authority"), F.url_decode(authority).alias("authority"), part("HOST").alias("host"),
        F.when(port != "", port.cast("int")).otherwise(-1).alias("port"), raw.alias("raw_path"), F.url_decode(raw).alias("path"), query.alias("raw_query"), F.url_decode(query).alias("query"),
        F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]).alias("value")))).alias("query_obj"),
        part("REF").alias("raw_fragment"), F.url_decode(part("REF")).alias("fragment"), F.regexp_extract(url, r"^[^:/?#]+:([^#]*)", 1).alias("scheme_specific_part"),
    )
