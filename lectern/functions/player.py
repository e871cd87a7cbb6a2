"""Small decisions of a player: jump requests, taps, start, audio formats, request sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import paths

# Audio formats, their file names, labels and encoder arguments.
AUDIO_FORMATS = {
    "opus": ("audio.opus", "OGG Opus", ("-c:a", "libopus", "-b:a", "48k", "-vbr", "on", "-application", "voip")),
    "m4a": ("audio.m4a", "M4A (AAC)", ("-c:a", "aac", "-b:a", "48k")),
}


def audio_format(name: Column) -> Column:
    """struct<format, file_name, label, encoder array<string>>; an unknown format raises an error."""
    n = F.lower(F.trim(name))
    out = F.raise_error(F.concat(F.lit("Unsupported audio format: "), name, F.lit(". Expected one of: " + ", ".join(AUDIO_FORMATS)))).cast("struct<format:string,file_name:string,label:string,encoder:array<string>>")
    for key, (file, label, arguments) in AUDIO_FORMATS.items():
        made = F.struct(F.lit(key).alias("format"), F.lit(file).alias("file_name"), F.lit(label).alias("label"), F.array(*map(F.lit, arguments)).alias("encoder"))
        out = F.when(n == key, made).otherwise(out)
    return out


def jump_page(zero_based: Column, one_based: Column) -> Column:
    """The page asked for, 0-based: a request's texts or numbers; the 0-based one goes first; negative or unreadable ones are none."""
    zero, one = zero_based.cast("string").try_cast("int"), one_based.cast("string").try_cast("int") - 1
    return F.coalesce(F.when(zero >= 0, zero), F.when(one >= 0, one))


def is_tap(moved: Column, slop: Column, duration_ms: Column, pointers: Column) -> Column:
    """One finger that moved at most half the slop, for at most 220 ms."""
    return (moved <= 0.5 * slop) & (duration_ms <= 220) & (pointers == 1)


def start_page(asked: Column, saved_page: Column, pages: Column) -> Column:
    """The page to open: the one asked for, else the saved one, else the first; inside the book."""
    return F.greatest(F.lit(0), F.least(pages - 1, F.coalesce(asked, saved_page, F.lit(0))))


def is_stylesheet(kind: Column, content_type: Column, path: Column) -> Column:
    """By the request's type, by the content type, or by the ending."""
    return (F.lower(F.trim(kind)) == "stylesheet") | F.lower(content_type).startswith("text/css") | (paths.ending(path) == "css")


def request_source(referer: Column, fallback: Column) -> Column:
    """Where a request came from: the package path of its referer, or the referer itself if it has none; without a referer the fallback."""
    found = paths.classify_url(referer)
    return F.when(F.coalesce(referer, F.lit("")) == "", fallback).otherwise(F.coalesce(found["path"], referer))
