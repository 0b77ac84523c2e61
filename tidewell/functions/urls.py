"""URL and file-name columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell import constants as K

_URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)([^?#]*)"


def netloc(url: Column) -> Column:
    """Authority part with user info and port, as written."""
    return F.regexp_extract(url, _URL, 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def url_to_filename(url: Column) -> Column:
    path = F.replace(F.trim(url_path(url), F.lit("/")), F.lit("/"), F.lit("_"))
    name = F.when(path == "", netloc(url)).otherwise(F.concat(netloc(url), F.lit("_"), path))
    return F.when(name.endswith(".html"), name).otherwise(F.concat(name, F.lit(".html")))


def video_id_from_url(url: Column) -> Column:
    found = [
        F.nullif(F.regexp_extract(url, "(?i)" + pattern, 1), F.lit(""))
        for pattern in K.VIDEO_ID_PATTERNS
    ]
    return F.coalesce(*found)


def file_format(filename: Column, mime: Column) -> Column:
    """Parser for a file: known MIME type, else known last extension, else text."""
    table = F.create_map(*[F.lit(x) for pair in K.FORMAT_BY_KEY.items() for x in pair])
    ext = F.when(
        filename.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(filename, ".", -1)))
    )
    return F.coalesce(
        F.try_element_at(table, F.lower(mime)), F.try_element_at(table, ext), F.lit("text")
    )


def guess_mime(filename: Column) -> Column:
    guess = F.lit(K.DEFAULT_MIME)
    for ending, mime in K.MIME_BY_ENDING.items():
        guess = F.when(filename.endswith(ending), mime).otherwise(guess)
    return guess
