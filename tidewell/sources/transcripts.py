"""Timed segments to text blocks of about two minutes of speech or 120 words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions.rows import explode_rows
from tidewell.functions.text import strip, word_count

SEGMENTS = "array<struct<text:string,start:double,duration:double>>"


def video_id_from_filename(filename: Column) -> Column:
    base = F.substring_index(F.substring_index(filename, "/", -1), "\\", -1)
    return F.replace(F.replace(base, F.lit(".youtube"), F.lit("")), F.lit("youtube_"), F.lit(""))


def segments_from_json(text: Column) -> Column:
    """Segments of a transcript file; null when the file is not a list of them."""
    return F.from_json(text, SEGMENTS)


def time_label(seconds: Column) -> Column:
    """mm:ss, with hours in front from one hour on."""
    s = seconds.cast("long")
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, sec)).otherwise(
        F.format_string("%02d:%02d", m, sec)
    )


def transcript_blocks(segments: Column, video_id: Column) -> Column:
    """array<struct<type, content, page_number, media_path, metadata>> for one transcript.

    Blank segments are skipped. The fold keeps word and second counts and closes a
    block on the segment that reaches either limit.
    """
    cut = "struct<lo:int,hi:int>"
    spoken = F.filter(
        F.transform(
            segments,
            lambda s: F.struct(
                strip(F.coalesce(s["text"], F.lit(""))).alias("text"),
                F.coalesce(s["start"], F.lit(0.0)).alias("start"),
                F.coalesce(s["duration"], F.lit(0.0)).alias("duration"),
            ),
        ),
        lambda s: s["text"] != "",
    )

    def bounds(kept: Column) -> Column:
        counts = F.transform(
            kept,
            lambda s, i: F.struct(
                i.alias("i"), word_count(s["text"]).alias("n"), s["duration"].alias("d")
            ),
        )
        zero = F.struct(
            F.lit(0).alias("lo"), F.lit(0).alias("n"), F.lit(0.0).alias("d"),
            F.array().cast(f"array<{cut}>").alias("done"),
        )

        def step(acc: Column, c: Column) -> Column:
            n, d = acc["n"] + c["n"], acc["d"] + c["d"]
            full = (n >= K.TRANSCRIPT_WORDS) | (d >= K.TRANSCRIPT_SECONDS)
            piece = F.struct(acc["lo"].alias("lo"), (c["i"] + 1).alias("hi")).cast(cut)
            return F.struct(
                F.when(full, c["i"] + 1).otherwise(acc["lo"]).alias("lo"),
                F.when(full, 0).otherwise(n).alias("n"),
                F.when(full, 0.0).otherwise(d).alias("d"),
                F.when(full, F.concat(acc["done"], F.array(piece))).otherwise(acc["done"]).alias("done"),
            )

        def finish(acc: Column) -> Column:
            rest = F.struct(acc["lo"].alias("lo"), F.size(kept).alias("hi")).cast(cut)
            return F.when(
                acc["lo"] < F.size(kept), F.concat(acc["done"], F.array(rest))
            ).otherwise(acc["done"])

        return F.aggregate(counts, zero, step, finish)

    def block(kept: Column, b: Column) -> Column:
        part = F.slice(kept, b["lo"] + 1, b["hi"] - b["lo"])
        start = F.get(part, 0)["start"]
        last = F.element_at(part, -1)
        end = last["start"] + last["duration"]
        label = F.concat(F.lit("["), time_label(start), F.lit(" - "), time_label(end), F.lit("] "))
        link = F.concat(
            F.lit("https://www.youtube.com/watch?v="), video_id,
            F.lit("&t="), start.cast("long").cast("string"), F.lit("s"),
        )
        return F.struct(
            F.lit("text").alias("type"),
            F.concat(label, F.array_join(F.transform(part, lambda s: s["text"]), " ")).alias("content"),
            F.lit(1).alias("page_number"),
            link.alias("media_path"),
            F.create_map(
                F.lit("video_id"), video_id,
                F.lit("start_seconds"), start.cast("string"),
                F.lit("end_seconds"), end.cast("string"),
                F.lit("source"), F.lit("youtube"),
            ).alias("metadata"),
        )

    # The one-element array binds the kept segments once for all uses below.
    return F.flatten(
        F.transform(
            F.array(spoken), lambda kept: F.transform(bounds(kept), lambda b: block(kept, b))
        )
    )


def transcript_to_blocks(df: DataFrame, segments: str, video_id: str) -> DataFrame:
    keep = [c for c in df.columns if c != segments]
    blocks = transcript_blocks(F.col(segments), F.col(video_id))
    return explode_rows(df, keep, blocks, "_b", "block_no").select(*keep, "block_no", "_b.*")
