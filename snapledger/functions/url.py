"""URL canonicalisation and URL predicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.functions.text import once

# Query keys that only track where a click came from.
TRACKING_KEYS = (
    "campaign", "fbclid", "gclid", "gh_src", "lever-source", "lever-via", "mc_cid", "mc_eid", "ref", "referrer", "source", "src", "tracking",
)
# Two hosts that serve the same board; the second is the canonical one.
BOARD_HOSTS = ("boards.greenhouse.io", "job-boards.greenhouse.io")
BOARD_ID_KEY = "gh_jid"

#: URLs whose characters need no decoding: everything below is then plain text work.
_PLAIN = "^[A-Za-z]+://[A-Za-z0-9.-]+(:[0-9]+)?(/[A-Za-z0-9._~/-]*)?(\\?[A-Za-z0-9._~=&-]*)?(#[\\x21-\\x7e]*)?$"


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


# the whole of a plain URL, and its parts behind one another with a sign between that no plain URL has
_PARTS = "^([A-Za-z]+)://([A-Za-z0-9.-]+)(?::([0-9]+))?(/[^?#]*)?(?:\\?([^#]*))?.*$"
_BETWEEN = "\u0001"


def canonical_url_plain(url: Column) -> Column:
    """canonical_url of URLs that match _PLAIN, as built-in expressions; null for others."""

    def split(u: Column) -> Column:
        # one pass of the expression; a group for each part would take one pass each
        whole = F.regexp_replace(u, F.lit(_PARTS), F.lit(_BETWEEN.join(f"${i}" for i in range(1, 6))))
        return F.when(u.rlike(_PLAIN), once(F.split(whole, _BETWEEN), lambda g: once(named(g), join)))

    def named(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        return F.struct(
            F.lower(at(0)).alias("scheme"), F.lower(at(1)).alias("host"), at(2).alias("port"), at(3).alias("path"), at(4).alias("query"), F.lower(at(1)).isin(*BOARD_HOSTS).alias("board"),
        )

    def join(p: Column) -> Column:
        scheme = F.when(p["board"], F.lit("https")).otherwise(p["scheme"])
        host = F.when(p["board"], F.lit(BOARD_HOSTS[1])).otherwise(p["host"])
        usual = (p["port"] == "") | ((scheme == "https") & (p["port"] == "443")) | ((scheme == "http") & (p["port"] == "80"))
        path = F.when(F.length(p["path"]) > 1, F.when(p["path"].endswith("/"), F.substr(p["path"], F.lit(1), F.length(p["path"]) - 1)).otherwise(p["path"])).otherwise("/")
        pairs = F.transform(
            F.filter(F.split(p["query"], "&"), lambda x: x != ""),
            lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substr(x, F.length(F.substring_index(x, "=", 1)) + 2).alias("v")),
        )
        kept = F.filter(
            pairs,
            lambda x: ~(F.lower(x["k"]).isin(*TRACKING_KEYS) | F.lower(x["k"]).startswith("utm_") | (p["board"] & (x["k"] == BOARD_ID_KEY))),
        )
        query = F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat_ws("=", x["k"], x["v"])), "&")
        tail = once(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        whole = F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), p["port"])), path, tail)
        return F.when(scheme.isin("http", "https"), F.regexp_replace(whole, "/$", "")).otherwise("")

    return once(F.trim(url), split)


def _canonical(url: str) -> str:
    from urllib.parse import parse_qsl, unquote, urlencode, urlsplit

    try:
        u = urlsplit(url.strip())
        scheme, name, port = u.scheme.lower(), (u.hostname or "").lower(), u.port
        unquote(u.path, errors="strict")
    except ValueError:
        return ""
    if scheme not in ("http", "https") or not name or "@" in u.netloc:
        return ""
    if board := name in BOARD_HOSTS:
        scheme, name = "https", BOARD_HOSTS[1]
    if ":" in name:
        name = f"[{name}]"
    if port is not None and port != {"http": 80, "https": 443}[scheme]:
        name += f":{port}"
    path, at = u.path.replace(" ", "%20") or "/", 0
    while (at := path.find("%", at)) >= 0:
        code = path[at + 1 : at + 3]
        if len(code) < 2 or any(c not in "0123456789abcdefABCDEF" for c in code):
            return ""
        path = path[:at] + "%" + code.upper() + path[at + 3 :]
        at += 3
    if len(path) > 1:
        path = path.removesuffix("/")
    pairs = [
        (k, v)
        for k, v in parse_qsl(u.query, keep_blank_values=True)
        if k.lower() not in TRACKING_KEYS and not k.lower().startswith("utm_") and not (board and k == BOARD_ID_KEY)
    ]
    query = urlencode(sorted(pairs))
    return f"{scheme}://{name}{path}{'?' + query if query else ''}".removesuffix("/")


@F.pandas_udf(T.StringType())
def _canonical_udf(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else _canonical(u))


def canonical_url(url: Column) -> Column:
    """One spelling for the URLs of a posting; empty if the URL is not a usable http(s) address.

    Scheme and host in lower case; no default port, fragment, single trailing slash or tracking keys; query sorted; the
    escapes of the path stay, in upper case. Plain URLs never leave the JVM's expressions; the others go through one Arrow
    UDF.
    """
    odd = F.when(~F.trim(url).rlike(_PLAIN), url)
    return F.coalesce(canonical_url_plain(url), _canonical_udf(odd), F.lit(""))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda s: s != "")


def same_site(a: Column, b: Column) -> Column:
    """Whether two hosts are equal or one is a sub-domain of the other; `www.` does not count."""
    x, y = (F.regexp_replace(F.lower(h), "^www\\.", "") for h in (a, b))
    return (x != "") & (y != "") & ((x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x)))


def blocked_host(name: Column, blocked: tuple[str, ...]) -> Column:
    """Whether a host is on the list, or below a host that is."""
    found = F.lit(False)
    for b in blocked:
        found = found | (name == b) | name.endswith(f".{b}")
    return found


def valid_http_url(url: Column) -> Column:
    return F.coalesce(F.lower(part(url, "PROTOCOL")).isin("http", "https") & (part(url, "HOST") != ""), F.lit(False))
