"""Text rules as Spark columns: protocol lines, colours, names, times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted endings.
VIDEO, AUDIO = ("mp4", "mkv", "webm", "mov", "avi"), ("mp3", "wav", "flac", "m4a", "ogg")
#: Containers and codecs of an export.
CODECS, FORMATS = ("H264", "H265", "HEVC", "VP9"), ("MP4", "MKV", "WEBM")
#: Horizontal and vertical scale of a rapid word in its first four frames.
RAPID_SCALES = [(1.0, 8.0), (8.0, 1.0), (1.0, 6.0), (6.0, 1.0)]


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def accepted(path: Column, kinds: tuple[str, ...]) -> Column:
    return ending(path).isin(*kinds)


def metadata_value(line: Column, key: str) -> Column:
    """The finite number after key in a log line; null where there is none."""
    text = F.split(F.ltrim(F.substring(line, F.instr(line, F.lit(key)) + len(key), F.length(line))), r"\s+", 2)[0]
    found = text.try_cast("double")
    finite = found.isNotNull() & ~F.isnan(found) & (F.abs(found) < float("inf"))
    return F.when(F.contains(line, F.lit(key)) & finite, found)


def hex_colour(text: Column) -> Column:
    """r, g, b of #RRGGBB or #AARRGGBB; white for anything else."""
    h = F.regexp_replace(F.coalesce(text, F.lit("")), "^#+", "")
    body = F.when(F.length(h) == 8, F.substring(h, 3, 6)).when(F.length(h) == 6, h)
    good = F.coalesce(body.rlike("^[0-9A-Fa-f]{6}$"), F.lit(False))
    part = lambda at: F.when(good, F.conv(F.substring(body, at, 2), 16, 10).cast("int")).otherwise(255)
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def valid_job_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z0-9-]{1,100}$"), F.lit(False))


def codec(text: Column) -> Column:
    return F.replace(F.upper(text), F.lit("."), F.lit(""))


def valid_export(codec_text: Column, format_text: Column, bitrate: Column) -> Column:
    c, f = codec(codec_text), F.upper(format_text)
    return c.isin(*CODECS) & f.isin(*FORMATS) & ((f != "WEBM") | (c == "VP9")) & bitrate.between(1, 100)


def clock(seconds: Column) -> Column:
    """m:ss.d"""
    s = F.floor(seconds)
    tenths = F.floor((seconds - s) * 10)
    return F.when(seconds.isNull() | F.isnan(seconds), "0:00.0").otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("."), tenths.cast("string")))


def number_or(text: Column, path: str, default: float) -> Column:
    """A finite number of a JSON text, or the default."""
    found = F.get_json_object(text, path).try_cast("double")
    return F.when(found.isNull() | F.isnan(found) | (F.abs(found) == float("inf")), default).otherwise(found)


def progress(line: Column) -> Column:
    """percent and message of PROGRESS:percent:message, result of RESULT:json; nulls for other lines."""
    own = line.startswith("PROGRESS:")
    parts = F.split(line, ":", 3)
    return F.struct(F.when(own, F.get(parts, F.lit(1)).try_cast("double")).alias("percent"), F.when(own, F.get(parts, F.lit(2))).alias("message"), F.when(line.startswith("RESULT:"), F.substring(line, 8, 1 << 30)).alias("result"))


def policy(mode: Column, no_repeat: Column, smart: Column) -> Column:
    """How shots are chosen: long clips never repeat, then smart flow, then no repeats (unless switched off), else classic."""
    return F.when(mode == "long_clip", "no_repeat").when((mode == "scenepack") & F.coalesce(smart, F.lit(False)), "smart").when(F.coalesce(no_repeat, F.lit(True)), "no_repeat").otherwise("classic")


def cache_key(*parts: Column) -> Column:
    """A JSON array of strings: no two lists of texts have the same one."""
    return F.to_json(F.array(*parts))


def fingerprint(path: Column, length: Column, modified: Column) -> Column:
    return F.concat_ws(":", path, length.cast("string"), modified.cast("string"))


def rapid_scale(frame: Column) -> Column:
    """sx and sy of a rapid word so many frames after its start; as it is from the fifth on."""
    at = lambda i: F.coalesce(*(F.when(frame == k, F.lit(s[i])) for k, s in enumerate(RAPID_SCALES)), F.lit(1.0))
    return F.struct(at(0).alias("sx"), at(1).alias("sy"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


TRANSCRIPT = "text string, language string, duration double, segments array<struct<start double, end double, text string, words array<struct<word string, start double, end double, probability double>>>>"


def transcript(result: Column) -> Column:
    """The transcript that a RESULT text holds, or null where it isn't JSON or lacks text, language, duration or segments."""
    found = F.from_json(result, TRANSCRIPT)
    whole = found["text"].isNotNull() & found["language"].isNotNull() & found["duration"].isNotNull() & found["segments"].isNotNull()
    return F.when(whole, found)
