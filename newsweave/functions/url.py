"""URL functions as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions.binding import let
from newsweave.functions.hosts import with_ascii_host

# scheme, user info, host, port, path, query, fragment
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^:/?#]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return F.lower(_part(url, 3))


def parts(url: Column) -> Column:
    """Struct of scheme, credentials, host, port (empty when default), path and query; all empty when the text is no
    absolute URL."""
    raw = let(url, lambda u: F.struct(
        scheme(u).alias("scheme"), _part(u, 2).alias("credentials"), host(u).alias("host"),
        F.regexp_replace(_part(u, 4), "^0+(?=[0-9])", "").alias("port"), _part(u, 5).alias("path"), _part(u, 6).alias("query")))
    default = lambda r: ((r["scheme"] == "https") & (r["port"] == "443")) | ((r["scheme"] == "http") & (r["port"] == "80"))
    return let(raw, lambda r: F.struct(
        r["scheme"], r["credentials"], r["host"], F.when(default(r), "").otherwise(r["port"]).alias("port"),
        F.when(r["path"] == "", "/").otherwise(_remove_dots(r["path"])).alias("path"), r["query"]))


def path_and_query(url: Column) -> Column:
    return let(parts(url), lambda p: F.concat(p["path"], p["query"]))


def publisher_host(url: Column) -> Column:
    return F.regexp_replace(host(url), K.PUBLISHER_PREFIX, "")


def _remove_dots(path: Column) -> Column:
    """Resolve `.` and `..` path segments."""
    return let(path, _without_dots)


def _without_dots(path: Column) -> Column:
    segments = F.split(path, "/")
    popped = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("..", "%2e%2e", "%2E%2E"), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    joined = F.concat(F.array_join(popped, "/"), tail)
    return F.when(path.rlike(r"/(\.{1,2}|%2[eE]%2[eE])(/|$)"), F.regexp_replace(joined, "^(?!/)", "/")).otherwise(path)


def _form_encode(value: Column) -> Column:
    """Decode and re-encode a form value; malformed escapes stay as they are."""
    return F.url_encode(F.coalesce(F.try_url_decode(value), value))


def _clean_query(query: Column) -> Column:
    pairs = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda p: p != "")
    named = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)).alias("name"),
            i.alias("pos"),
            F.concat(_form_encode(F.substring_index(p, "=", 1)), F.lit("=")).alias("head"),
            F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.lit(1 << 30)))
            .otherwise(F.lit("")).alias("value"),
        ),
    )
    kept = F.array_sort(F.filter(named, lambda n: ~n["name"].rlike(K.TRACKING_PARAM)))
    text = F.array_join(F.transform(kept, lambda n: F.concat(n["head"], _form_encode(n["value"]))), "&")
    return F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")


def canonical_url(url: Column) -> Column:
    """One spelling per address: no fragment, no tracking parameters, parameters sorted by name, no trailing
    slash (unless the path is `/`), percent-encoded path, lower-case host in ASCII form, no default port.  Null when the text is no absolute URL."""
    return let(parts(with_ascii_host(F.trim(url))), _canonical)


def _port_suffix(p: Column) -> Column:
    return F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise("")


# Characters that a serialised path holds percent-encoded.
_ENCODED = "[^!-~]|[\"<>`{}]"


def _encode_path(path: Column) -> Column:
    """Percent-encode non-ASCII letters, blanks and the like; escapes that are there already stay."""
    character = lambda c: F.when(c.rlike(_ENCODED), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    encoded = F.array_join(F.transform(F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0)), character), "")
    return F.when(path.rlike(_ENCODED), encoded).otherwise(path)


def _canonical(p: Column) -> Column:
    credentials = F.when(p["credentials"] != "", F.concat(p["credentials"], F.lit("@"))).otherwise("")
    path = F.when(p["path"].rlike("^/+$"), "/").otherwise(_encode_path(F.regexp_replace(p["path"], "/+$", "")))
    text = F.concat(p["scheme"], F.lit("://"), credentials, p["host"], _port_suffix(p), path, _clean_query(p["query"]))
    return F.when((p["scheme"] != "") & (p["host"] != ""), text)


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of a link found on the page `base`."""
    shape = r"^([^?#]*)(.*)$"
    base_parts = let(parts(base), lambda p: F.struct(
        p["scheme"], F.concat(p["scheme"], F.lit("://"), p["host"], _port_suffix(p)).alias("origin"), p["path"], p["query"]))
    link = F.struct(F.trim(href).alias("href"), F.regexp_extract(F.trim(href), shape, 1).alias("path"), F.regexp_extract(F.trim(href), shape, 2).alias("tail"))
    return let(F.struct(link.alias("link"), base_parts.alias("base")), lambda x: _resolve(x["link"], x["base"]))


def _resolve(link: Column, base: Column) -> Column:
    h = link["href"]
    directory = F.regexp_replace(base["path"], "[^/]*$", "")
    full = F.when(h.startswith("/"), link["path"]).otherwise(F.concat(directory, link["path"]))
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(base["scheme"], F.lit(":"), h))
        .when(h.startswith("?"), F.concat(base["origin"], base["path"], h))
        .when(h.startswith("#") | (h == ""), F.concat(base["origin"], base["path"], base["query"], h))
        .otherwise(F.concat(base["origin"], _remove_dots(full), link["tail"]))
    )


def url_rejection(url: Column, max_chars: int | None = None) -> Column:
    """Null for an admissible public HTTPS address, otherwise the first reason against it.  With `max_chars`, longer ones are `too_long`."""
    checked = let(parts(url), lambda p: _rejection(p, F.regexp_replace(p["host"], r"\.$", "")))
    return F.when(url.isNull(), "not_absolute").otherwise(checked if max_chars is None else F.coalesce(checked, F.when(F.length(url) > max_chars, "too_long")))


def _rejection(p: Column, host_name: Column) -> Column:
    return let(F.struct(p.alias("p"), host_name.alias("h")), lambda x: (
        F.when((x["p"]["scheme"] == "") | (x["h"] == ""), "not_absolute")
        .when(x["p"]["scheme"] != "https", "not_https")
        .when(x["p"]["credentials"] != "", "credentials")
        .when(x["p"]["port"] != "", "port")
        .when(F.contains(x["h"], F.lit(":")) | x["h"].rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$"), "ip_literal")
        .when(~F.contains(x["h"], F.lit(".")), "no_dot")
        .when(x["h"].rlike(K.LOCAL_SUFFIX), "local_suffix")
        .when(x["h"].rlike(K.REBINDING_HOST), "rebinding_suffix")
    ))


def is_public_url(url: Column) -> Column:
    return url_rejection(url).isNull()


def _ipv4_number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_public_ip(ip: Column) -> Column:
    """Globally reachable address: IPv4 outside every special-use range, or IPv6 global unicast outside the
    documentation and transition ranges."""
    return let(ip, _public_ip)


def _public_ip(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    number = sum((F.get(octets, F.lit(i)).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.get(octets, F.lit(0)).cast("long") * 256**3)
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    special = let(number, lambda n: reduce(or_, [n.between(_ipv4_number(a), _ipv4_number(b)) for a, b in K.SPECIAL_IPV4]))
    v4 = F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), ~special).otherwise(False)
    groups = F.split(ip, ":")
    group = lambda i: F.conv(F.coalesce(F.nullif(F.get(groups, F.lit(i)), F.lit("")), F.lit("0")), 16, 10).cast("long")
    reserved = let(F.struct(group(0).alias("a"), group(1).alias("b")), lambda g: (g["a"] == 0x2002)
                   | ((g["a"] == 0x2001) & ((g["b"] < 0x200) | (g["b"] == 0xDB8))) | ((g["a"] == 0x3FFF) & (g["b"] < 0x1000)))
    v6 = F.when(ip.rlike("^[23][0-9a-fA-F]{3}:[0-9a-fA-F:]*$"), ~reserved).otherwise(False)
    return F.when(F.contains(ip, F.lit(":")), v6).otherwise(v4)
