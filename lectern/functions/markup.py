"""Features of markup and style sheets that a fixed page can't show, and HTML helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.css import strip_comments

# Code, label, level; patterns; details.
FEATURES = (
    ("fixed-layout", "Fixed-layout indicators", "unsupported"),
    ("table-layout", "Tables / complex table layout", "degraded"),
    ("positioned-layout", "Floats / absolute positioning", "degraded"),
    ("ruby-text", "Ruby text annotations", "degraded"),
    ("mathml-content", "MathML content", "unsupported"),
    ("svg-text-flow", "SVG-heavy text flow", "degraded"),
    ("rtl-direction", "RTL directionality", "unsupported"),
    ("vertical-writing-mode", "Vertical writing mode", "unsupported"),
)
MARKUP_PATTERNS = (
    ("table-layout", r"(?i)<\s*(?:[a-z0-9_-]+:)?(?:table|thead|tbody|tfoot|tr|td|th|caption|colgroup|col)\b", "contains table markup (<table>/<tr>/<td>/...)"),
    ("ruby-text", r"(?i)<\s*(?:[a-z0-9_-]+:)?(?:ruby|rb|rt|rp)\b", "contains ruby annotations (<ruby>/<rt>)"),
    ("mathml-content", r"(?i)<\s*(?:[a-z0-9_-]+:)?math\b", "contains MathML (<math>)"),
    ("svg-text-flow", r"(?i)<\s*(?:[a-z0-9_-]+:)?svg\b", "contains inline SVG content (<svg>)"),
    ("rtl-direction", r"""(?i)\bdir\s*=\s*["']rtl["']""", 'contains dir="rtl" markup'),
)
_FLOAT = r"\bfloat\s*:\s*(?:left|right|inline-start|inline-end)\b"
_POSITION = r"\bposition\s*:\s*(?:absolute|fixed)\b"
_TABLE = r"\btable-layout\s*:|\bdisplay\s*:\s*(?:inline-)?table(?:-[a-z-]+)?\b"
_RTL = r"\bdirection\s*:\s*rtl\b|\bunicode-bidi\s*:\s*(?:embed|bidi-override|isolate|isolate-override|plaintext)\b"
_VERTICAL = r"\bwriting-mode\s*:\s*(?:vertical(?:-rl|-lr)?|tb-rl|tb-lr|sideways-rl|sideways-lr)\b|\btext-orientation\s*:\s*(?:upright|sideways(?:-right)?)\b"
#: (code, patterns that must match, patterns that must not, detail)
CSS_RULES = (
    ("table-layout", (_TABLE,), (), "uses table display/layout CSS declarations"),
    ("positioned-layout", (_FLOAT, _POSITION), (), "uses float and absolute/fixed positioning CSS declarations"),
    ("positioned-layout", (_FLOAT,), (_POSITION,), "uses float CSS declarations"),
    ("positioned-layout", (_POSITION,), (_FLOAT,), "uses absolute/fixed positioning CSS declarations"),
    ("rtl-direction", (_RTL,), (), "uses RTL directionality CSS (direction/unicode-bidi)"),
    ("vertical-writing-mode", (_VERTICAL,), (), "uses vertical writing-mode/text-orientation CSS"),
)
_FIXED_LAYOUT = (
    (r"""(?i)\brendition:layout\s*=\s*["']pre-paginated["']""", 'OPF package metadata declares rendition:layout="pre-paginated"'),
    (r"""(?i)<meta\b[^>]*\bproperty\s*=\s*["']rendition:layout["'][^>]*>\s*pre-paginated\s*</meta>""", 'OPF metadata contains <meta property="rendition:layout">pre-paginated</meta>'),
    (r"""(?i)<meta\b[^>]*\bname\s*=\s*["']fixed-layout["'][^>]*\bcontent\s*=\s*["'](?:true|yes|1)["']|<meta\b[^>]*\bcontent\s*=\s*["'](?:true|yes|1)["'][^>]*\bname\s*=\s*["']fixed-layout["']""", "OPF metadata contains fixed-layout=true indicator"),
    (r"(?i)\brendition:layout-pre-paginated\b", "OPF contains rendition:layout-pre-paginated spine/manifest properties"),
)


def _found(code: str, detail: str, on: Column) -> Column:
    return F.when(on, F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail")))


def markup_features(html: Column) -> Column:
    """array<struct<code, detail>>"""
    return F.array_compact(F.array(*[_found(c, d, html.rlike(p)) for c, p, d in MARKUP_PATTERNS]))


def css_features(css: Column) -> Column:
    text = F.lower(strip_comments(css, " "))
    out = []
    for code, must, must_not, detail in CSS_RULES:
        on = F.lit(True)
        for p in must:
            on = on & text.rlike(p)
        for p in must_not:
            on = on & ~text.rlike(p)
        out.append(_found(code, detail, on))
    return F.array_compact(F.array(*out))


def package_features(opf: Column, properties: Column, hrefs: Column) -> Column:
    """Signs of fixed layout in a package document; properties: array<array<string>> of the manifest, hrefs: of its items."""
    marked = F.filter(F.arrays_zip(properties.alias("p"), hrefs.alias("h")), lambda z: F.exists(z["p"], lambda x: F.lower(x) == "rendition:layout-pre-paginated"))
    sample = F.array_join(F.transform(F.slice(marked, 1, 3), lambda z: F.concat(F.lit('"'), z["h"], F.lit('"'))), ", ")
    many = F.format_string("manifest marks %d items as rendition:layout-pre-paginated (e.g. %s)", F.size(marked), sample)
    few = F.format_string("manifest marks item(s) as rendition:layout-pre-paginated (%s)", sample)
    first = F.when(F.size(marked) > 0, F.struct(F.lit("fixed-layout").alias("code"), F.when(F.size(marked) > 3, many).otherwise(few).alias("detail")))
    return F.array_compact(F.array(first, *[_found("fixed-layout", d, opf.rlike(p)) for p, d in _FIXED_LAYOUT]))


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(text: Column) -> Column:
    return F.replace(F.replace(escape_html(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def search_text(text: Column) -> Column:
    """Lower case, white space as one blank, dashes as '-', trimmed; curly quotes stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), "[—–]", "-"))
