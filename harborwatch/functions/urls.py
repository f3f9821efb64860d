"""URL column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborwatch.config import CHANNEL, DARK, WEB
from harborwatch.functions.text import let

_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\\]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; empty where there is none."""
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    return F.lower(F.regexp_extract(authority, r"^(?:.*@)?([^:]*)", 1))


def origin_category(url: Column, is_channel: Column | None = None) -> Column:
    web = F.when(url_host(url).endswith(".onion"), DARK).otherwise(WEB)
    return web if is_channel is None else F.when(is_channel, CHANNEL).otherwise(web)


def _encode(part: Column, odd: str) -> Column:
    """Percent-encode every character of the class ``odd``."""
    def one(ch: Column) -> Column:
        return F.when(ch.rlike(odd), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)

    def whole(text: Column) -> Column:
        return F.when(text.rlike(odd), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)

    return let(part, whole)


def _tidy_path(path: Column) -> Column:
    """Remove ``.`` and ``..`` steps; the path starts with a slash."""
    up, stay = ("..", ".%2e", "%2e.", "%2e%2e"), (".", "%2e")

    def fold(done: Column, step: Column) -> Column:
        parent = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        low = F.lower(step)
        return F.when(low.isin(*up), parent).when(low.isin(*stay), done).otherwise(F.concat(done, F.array(step)))

    def walk(steps: Column) -> Column:
        kept = F.aggregate(steps, F.array().cast("array<string>"), fold)
        open_end = F.when(F.lower(F.element_at(steps, -1)).isin(*up, *stay), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, open_end), "/"))

    def tidy(p: Column) -> Column:
        dotted = p.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|\z)")
        return F.when(dotted, let(F.split(F.substr(p, F.lit(2)), "/", -1), walk)).otherwise(p)

    return let(path, tidy)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, tidy path, percent-encoding; http(s) only."""
    def parts(u: Column) -> Column:
        return F.struct(
            u.alias("url"),
            F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)).alias("scheme"),
            F.regexp_extract(u, _AUTHORITY, 1).alias("authority"),
            F.regexp_extract(u, _AUTHORITY + r"(.*)\z", 2).alias("rest"),
        )

    def build(p: Column) -> Column:
        host = F.lower(F.regexp_extract(p["authority"], r"([^@]*)\z", 1))
        port = F.when(p["scheme"] == "http", r":(80)?\z").otherwise(r":(443)?\z")
        path = F.translate(F.regexp_extract(p["rest"], r"^([^?#]*)", 1), "\\", "/")
        built = F.concat(
            p["scheme"], F.lit("://"),
            F.regexp_extract(p["authority"], r"^(.*@)", 1),
            F.regexp_replace(host, port, F.lit("")),
            _encode(let(path, lambda x: F.when(x == "", "/").otherwise(_tidy_path(x))), r"[^!-~]|[\"<>`{}^]"),
            _encode(F.regexp_extract(p["rest"], r"^[^?#]*(\?[^#]*)", 1), r"[^!-~]|[\"<>']"),
            _encode(F.regexp_extract(p["rest"], r"(#.*)\z", 1), r"[^!-~]|[\"<>`]"),
        )
        return F.when(p["scheme"].isin("http", "https"), built).otherwise(p["url"])

    return let(let(url, parts), build)


def resolve_url(href: Column, base: Column) -> Column:
    """The link as seen from its page; a missing link is the page itself (without its fragment)."""
    controls = F.lit("".join(map(chr, range(33))))
    parts = F.struct(
        F.regexp_replace(F.btrim(F.coalesce(href, F.lit("")), controls), r"[\t\n\r]", "").alias("h"),
        F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1).alias("scheme"),
        F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\]*)", 1).alias("root"),
        F.regexp_extract(base, _AUTHORITY + r"([^?#]*)", 2).alias("path"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
    )

    def full(p: Column) -> Column:
        h, root = p["h"], p["root"]
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        return (
            F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(p["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(root, h))
            .when(h.startswith("?"), F.concat(root, path, h))
            .when(h.startswith("#"), F.concat(root, path, p["query"], h))
            .when(h == "", F.concat(root, path, p["query"]))
            .otherwise(F.concat(root, F.regexp_extract(path, r"^(.*/)", 1), h))
        )

    return normalize_url(let(parts, full))
