"""Package paths, references and resource URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = "https://epub.local"
# File endings and what they hold.
CONTENT_TYPES = {
    "xhtml": "application/xhtml+xml", "xml": "application/xhtml+xml", "opf": "application/xhtml+xml",
    "html": "text/html; charset=utf-8", "htm": "text/html; charset=utf-8",
    "css": "text/css; charset=utf-8",
    "js": "text/javascript; charset=utf-8", "mjs": "text/javascript; charset=utf-8",
    "json": "application/json; charset=utf-8",
    "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
    "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2",
    "smil": "application/smil+xml",
}
CRITICAL_ENDINGS = ("css", "ttf", "otf", "woff", "woff2")
AUDIO_ENDINGS = ("mp3", "m4a", "m4b", "mp4", "aac", "ogg", "opus", "flac", "wav", "wma", "aiff")
_SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"


def strip_lead(path: Column) -> Column:
    """One leading slash goes, then backslashes become slashes (so a leading backslash stays, as a slash)."""
    return F.regexp_replace(F.regexp_replace(path, "^/", ""), r"\\", "/")


def slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def _fold(parts: Column, keep_above: bool) -> Column:
    """Segments with '.' and empty ones gone and '..' taking back one; above the root '..' is dropped, or kept."""

    def step(acc: Column, x: Column) -> Column:
        back = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
        up = F.when(back, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(F.lit(".."))) if keep_above else acc)
        return F.when((x == "") | (x == "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def resolve(base: Column, relative: Column) -> Column:
    """relative against base's folder; never above the root; the first fragment stays."""
    path, hash = F.split_part(relative, F.lit("#"), F.lit(1)), F.split_part(relative, F.lit("#"), F.lit(2))
    folder = F.when(base.contains("/"), F.regexp_replace(base, "/[^/]*$", "")).otherwise(F.lit(""))
    whole = F.concat_ws("/", folder, path)
    out = F.array_join(_fold(F.split(whole, "/"), False), "/")
    return F.when(hash != "", F.concat(out, F.lit("#"), hash)).otherwise(out)


def normalise(path: Column) -> Column:
    """Slashes, '.' and '..' resolved; '..' above the root stays."""
    return F.array_join(_fold(F.split(strip_lead(path), "/"), True), "/")


def percent_decode(text: Column) -> Column:
    """Percent-decoding in which '+' is itself; what is malformed stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def comparable(path: Column) -> Column:
    return normalise(F.array_join(F.transform(F.split(path, "/"), percent_decode), "/"))


def reference_path(ref: Column) -> Column:
    """What stands before the first '#', normalised but not decoded; null if empty."""
    return F.nullif(normalise(F.split_part(ref, F.lit("#"), F.lit(1))), F.lit(""))


def reference_fragment(ref: Column) -> Column:
    """What stands behind the first '#', decoded; null if there is none."""
    at = F.instr(ref, "#")
    return F.when(at > 0, F.nullif(percent_decode(F.substring(ref, at + 1, F.length(ref))), F.lit("")))


def is_for_chapter(ref: Column, chapter_path: Column) -> Column:
    """An empty path means the chapter itself; others must be the chapter's when decoded."""
    path = F.split_part(ref, F.lit("#"), F.lit(1))
    return (path == "") | (comparable(path) == comparable(chapter_path))


def has_scheme(url: Column) -> Column:
    return url.rlike(_SCHEME)


def safe_href(href: Column) -> Column:
    """A local stylesheet link: not empty, no scheme, not protocol-relative."""
    h = F.trim(href)
    return (h != "") & ~h.startswith("//") & ~has_scheme(h)


def stylesheet_path(base: Column, href: Column) -> Column:
    """The package path of a local stylesheet link; null for remote ones and those that leave the package."""
    clean = F.trim(F.regexp_replace(href, "[?#].*$", ""))
    folder = F.when(base.contains("/"), F.regexp_replace(base, "/[^/]*$", "")).otherwise(F.lit(""))
    out = F.array_join(_fold(F.split(F.concat_ws("/", folder, percent_decode(clean)), "/"), True), "/")
    return F.when((clean == "") | ~safe_href(clean) | out.startswith(".."), F.lit(None)).otherwise(out)


def ending(path: Column) -> Column:
    """What stands behind the last dot of the last segment, if something stands before it."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)/*$", 1))


def content_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ending(path)), F.lit("application/octet-stream"))


def is_critical(path: Column, kind: Column) -> Column:
    """Stylesheets and fonts, by request type or ending."""
    return F.lower(F.trim(kind)).isin("stylesheet", "font") | ending(path).isin(*CRITICAL_ENDINGS)


def is_audio(path: Column) -> Column:
    return ending(path).isin(*AUDIO_ENDINGS)


# Schemes whose URLs have a host, and their usual ports.
_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def _dots_removed(path: Column) -> Column:
    """A URL's path without dot segments, also percent-encoded ones; never above the root. Empty segments stay."""

    def step(acc: Column, x: Column) -> Column:
        plain = F.replace(F.lower(x), F.lit("%2e"), F.lit("."))
        return F.when(plain == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(plain == ".", acc).otherwise(F.concat(acc, F.array(x)))

    parts = F.split(path, "/")
    last = F.replace(F.lower(F.element_at(parts, -1)), F.lit("%2e"), F.lit("."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.array_join(folded, "/"), F.when(last.isin(".", "..") & (F.size(folded) > 0), "/").otherwise(""))


def _decoded(path: Column) -> Column:
    """Percent-decoded; null where that gives no UTF-8 text."""
    out = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    broken = out.contains("\ufffd") & ~path.contains("\ufffd") & ~F.upper(path).contains("%EF%BF%BD")
    return F.when(~broken, out)


def classify_url(url: Column) -> Column:
    """struct<kind, path, reason>: 'epub-resource' with its package path, 'inline-resource', or 'blocked' with the reason.

    Only the package's origin is allowed: its scheme, its host and the usual port. The path may be empty, and may not
    lead out of the package when its encoded slashes are decoded.
    """
    text = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.substring(text, F.length(scheme) + 2, F.length(text))
    hosted = scheme.isin(*_PORTS)
    place = F.regexp_replace(F.regexp_extract(rest, r"^[/\\]*([^/\\?#]*)", 1), "^.*@", "")  # without a user
    host, port = F.lower(F.regexp_extract(place, r"^(\[.*\]|[^:]*)", 1)), F.regexp_extract(place, r":([^:\]]*)$", 1)
    usual = F.try_element_at(F.create_map(*[F.lit(x) for kv in _PORTS.items() for x in kv]), scheme)
    number = F.regexp_replace(port, r"^0+(?=\d)", "")
    bad = (scheme == "") | (hosted & ((host == "") | host.rlike(r"[\x00-\x20<>^|%]") | ~port.rlike(r"^\d*$") | (number.try_cast("int") > 65535) | (F.length(number) > 5)))
    origin = F.when(hosted, F.concat(scheme, F.lit("://"), host, F.when((number == "") | (number == usual), "").otherwise(F.concat(F.lit(":"), number)))).otherwise("null")
    raw = F.replace(F.regexp_extract(rest, r"^[/\\]*[^/\\?#]*([^?#]*)", 1), F.lit("\\"), F.lit("/"))
    decoded = _decoded(F.regexp_replace(_dots_removed(F.regexp_replace(raw, "^/", "")), "^/+", ""))
    folded = F.array_join(_fold(F.split(decoded, "/"), True), "/")
    path = F.concat(folded, F.when(decoded.endswith("/") & (folded != ""), "/").otherwise(""))
    out = decoded.isNull() | (folded == "..") | folded.startswith("../")
    make = lambda kind, p, why: F.struct(F.lit(kind).alias("kind"), p.cast("string").alias("path"), why.cast("string").alias("reason"))
    none = F.lit(None)
    return (
        F.when(scheme.isin("data", "blob"), make("inline-resource", none, none))
        .when(bad, make("blocked", none, F.lit("invalid URL")))
        .when(origin != ORIGIN, make("blocked", none, F.concat(F.lit("origin "), origin, F.lit(" is not allowed"))))
        .when(out, make("blocked", none, F.lit("invalid EPUB resource path")))
        .otherwise(make("epub-resource", F.regexp_replace(slashes(path), "^/+", ""), none))
    )


def encode_path(path: Column) -> Column:
    """Each segment percent-encoded, but for letters, digits and - _ . ! ~ * ' ( )."""

    def encoded(x: Column) -> Column:
        out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
        for c, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
            out = F.replace(out, F.lit(code), F.lit(c))
        return out

    return F.array_join(F.transform(F.split(F.regexp_replace(slashes(path), "^/+", ""), "/"), encoded), "/")


def base_href(chapter_path: Column) -> Column:
    """The URL of a chapter's folder, against which its links are resolved."""
    own = F.regexp_replace(slashes(chapter_path), "^/+", "")
    return F.concat(F.lit(ORIGIN + "/"), encode_path(F.regexp_extract(own, "^(.*/)", 1)))


def inject_base(html: Column, href: Column) -> Column:
    """html with a base element at the beginning of its head; as it is if it has one already, or no head."""
    at, tag = F.regexp_instr(html, F.lit(r"(?i)<head[^>]*>")), F.regexp_extract(html, r"(?i)(<head[^>]*>)", 1)
    behind = at + F.length(tag)
    made = F.concat(F.substring(html, F.lit(1), behind - 1), F.lit('\n  <base href="'), href, F.lit('">'), F.substring(html, behind, F.length(html)))
    return F.when((at == 0) | html.rlike(r"(?i)<base\s"), html).otherwise(made)


def safe_audio_path(path: Column) -> Column:
    """Not empty, not absolute (Unix or Windows), and inside its folder."""
    p = F.trim(path)
    return (p != "") & ~p.rlike(r"^(?:/|\\|[A-Za-z]:)") & ~normalise(p).startswith("..")


def bundle_id(identifier: Column, title: Column, spine_ids: Column | None = None) -> Column:
    """The identifier with runs of white space as '-', else the beginning of the SHA-256 of title (and spine ids)."""
    own = F.nullif(F.regexp_replace(F.trim(identifier), r"\s+", "-"), F.lit(""))
    seed = title if spine_ids is None else F.concat(title, F.lit("|"), F.array_join(spine_ids, ","))
    return F.coalesce(own, F.substring(F.sha2(seed, 256), 1, 16))


def code_units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")
