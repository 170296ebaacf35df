"""URLs by the public URL standard, for http and https: parsing, resolving, and what a crawl asks of them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PORTS = {"http": "80", "https": "443"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
_DOT, _DOTS = re.compile(r"\.|%2e", re.I), re.compile(r"(?:\.|%2e){2}", re.I)
#: Percent-encode sets, besides controls and what is not ASCII.
_PATH, _QUERY, _USER = ' "#<>?^`{}', " \"#<>'", ' "#<>?^`{}/:;=@[\\]|'


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str
    host: str
    port: str
    path: str
    query: str | None

    @property
    def search(self) -> str:
        return f"?{self.query}" if self.query else ""

    def __str__(self) -> str:
        mark = "" if self.query is None else f"?{self.query}"
        return f"{self.scheme}://{self.user}{self.host}{':' + self.port if self.port else ''}{self.path}{mark}"


def encode(text: str, chars: str) -> str:
    if text.isascii() and text.isprintable() and not any(c in chars for c in text):
        return text
    return "".join(c if " " <= c <= "~" and c not in chars else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def decode(text: str) -> str:
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "replace"))
    return raw.decode("utf-8", "replace")


def ipv4(host: str) -> str | None:
    """A host whose last label is a number, as four parts; None if it is no address.  Other hosts come back as they are."""
    labels = host[:-1].split(".") if host.endswith(".") else host.split(".")
    if not re.fullmatch(r"[0-9]+|0x[0-9a-f]*", labels[-1]):
        return host
    try:
        parts = [0 if x == "0x" else int(x, 16 if x.startswith("0x") else 8 if len(x) > 1 and x[0] == "0" else 10) for x in labels]
    except ValueError:
        return None
    if len(parts) > 4 or any(x > 255 for x in parts[:-1]) or parts[-1] >= 256 ** (5 - len(parts)):
        return None
    value = parts[-1] + sum(x << 8 * (3 - i) for i, x in enumerate(parts[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def host_of(raw: str) -> str | None:
    if raw.startswith("["):
        return raw.lower() if re.fullmatch(r"\[[0-9A-Fa-f:.]+\]", raw) else None
    name = decode(raw)
    if not name.isascii():
        try:
            name = name.encode("idna").decode()
        except UnicodeError:
            return None
    name = name.lower()
    return None if not name or _BAD_HOST.search(name) else ipv4(name)


def authority(raw: str, scheme: str) -> tuple[str, str, str] | None:
    who, at, where = raw.rpartition("@")
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", where)
    host = host_of(found[1]) if found else None
    if host is None or (found[2] and int(found[2]) > 65535):
        return None
    port = str(int(found[2])) if found[2] else ""
    name, colon, word = who.partition(":")
    user = encode(name, _USER) + (":" + encode(word, _USER) if word else "")
    return (f"{user}@" if user else "", host, "" if port == PORTS[scheme] else port)


def walked(path: str, before: list[str]) -> str:
    """A path without dot segments, after the segments of a base."""
    out, parts = list(before), path.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if _DOTS.fullmatch(part):
            out = out[:-1]
            part = "" if last else None
        elif _DOT.fullmatch(part):
            part = "" if last else None
        if part is not None:
            out.append(encode(part, _PATH))
    return "/" + "/".join(out)


def parse(raw: str, base: Url | None = None) -> Url | None:
    """The URL without its fragment, resolved against a base; None for what is invalid or neither http nor https."""
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33))))).partition("#")[0]
    scheme, found = None, _SCHEME.match(text)
    if found:
        scheme = found[1].lower()
        if scheme not in PORTS:
            return None
        text = text[found.end() :]
        if base and base.scheme == scheme and not re.match(r"[/\\]", text):
            scheme = None  # 'http:page' is relative to a base of the same scheme
    if scheme is None and base is None:
        return None
    text, mark, query = text.partition("?")
    query, text = encode(query, _QUERY) if mark else None, text.replace("\\", "/")
    if scheme or text.startswith("//"):
        scheme = scheme or base.scheme
        where, slash, path = text.lstrip("/").partition("/")
        got = authority(where, scheme)
        return got and Url(scheme, *got, walked(path, []), query)
    if not text:
        return Url(base.scheme, base.user, base.host, base.port, base.path, query if mark else base.query)
    before = [] if text.startswith("/") else base.path[1:].split("/")[:-1]
    return Url(base.scheme, base.user, base.host, base.port, walked(text.removeprefix("/"), before), query)


def normalize(raw: str | None, base: str | None = None) -> str | None:
    """A URL in the form by which pages are told apart; None if there is none."""
    start = parse(base) if base else None
    got = None if raw is None or (base and start is None) else parse(raw, start)
    return got and str(got)


def apply_params(url: str, policy: str = "crawl", names: Iterable[str] = ()) -> str:
    """crawl keeps the query, strip drops it, anything else drops the named parameters."""
    got = parse(url)
    if policy == "crawl" or got is None:
        return url
    kept, names = None, set(names)
    if policy != "strip" and got.query is not None:
        pairs = [p for p in got.query.split("&") if p]
        kept = "&".join(p for p in pairs if decode(p.partition("=")[0].replace("+", " ")) not in names) or None
    return str(Url(got.scheme, got.user, got.host, got.port, got.path, kept))


@F.pandas_udf(StringType())
def _normalize(urls: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([normalize(u, b) for u, b in zip(urls, bases, strict=True)], dtype=object)


def normalized(url: Column, base: Column | None = None) -> Column:
    return _normalize(url, F.lit(None).cast("string") if base is None else base)


def parameters(url: Column, policy: str = "crawl", names: Iterable[str] = ()) -> Column:
    """apply_params for a column; nothing runs in Python where queries are kept."""
    if policy == "crawl":
        return url
    names = tuple(names)

    @F.pandas_udf(StringType())
    def apply(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: None if u is None else apply_params(u, policy, names))

    return apply(url)


def host(url: Column) -> Column:
    """The host of a normalised URL."""
    return F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)


def base_domain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def is_internal(url: Column, domain: str, subdomains: bool = False) -> Column:
    """Whether a URL's host, without www, is the domain, or below it if subdomains count."""
    bare = base_domain(host(url))
    return (bare == domain) | bare.endswith("." + domain) if subdomains else bare == domain


def in_scope(url: Column, include: Iterable[str] = (), exclude: Iterable[str] = (), usable=None) -> Column:
    """Not excluded, and included by some pattern if there are any; a pattern that `usable` refuses is taken literally."""

    def any_of(patterns: Iterable[str]) -> Column | None:
        known = [p.strip() for p in patterns if p.strip()]
        parts = [f"(?:{p})" if usable is None or usable(p) else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", p) for p in known]
        return url.rlike("(?i)" + "|".join(parts)) if parts else None

    inside, outside = any_of(include), any_of(exclude)
    ok = F.lit(True) if inside is None else inside
    return ok if outside is None else ok & ~outside


#: Extensions of files that hold no page, and of images.
BINARY = r"(?i)\.(zip|rar|7z|gz|tar|exe|dmg|pkg|msi|pdf|doc|docx|xls|xlsx|ppt|pptx|mp3|mp4|avi|mov|wmv|webm|ogg|wav|flv|swf|woff2?|ttf|otf|eot|ico)(\?|$)"
IMAGE = r"(?i)\.(png|jpe?g|gif|webp|avif|svg|bmp)(\?|$)"


def looks_binary(url: Column) -> Column:
    return url.rlike(BINARY)


def looks_image(url: Column) -> Column:
    return url.rlike(IMAGE)


def link_canonical(header: Column) -> Column:
    """The canonical URL of a Link header, as it stands there; null without one."""
    found = F.regexp_extract(header, r"(?i)<([^>]+)>\s*;[^,]*rel=[\"']?canonical", 1)
    return F.nullif(found, F.lit(""))


#: Phrases of status codes.
STATUS = {
    200: "OK", 201: "Created", 204: "No Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 410: "Gone", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}


def status_text(code: Column) -> Column:
    table = F.create_map(*[x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit(""))


def days_ago(n: int) -> Column:
    """The UTC date n days ago, as text."""
    return F.date_format(F.date_sub(F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())), n), "yyyy-MM-dd")
