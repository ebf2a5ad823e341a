"""Expressions on file names, paths, accounts and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, ignored names, provider hosts in order.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".heic", ".heif", ".avif", ".bmp", ".tiff")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".mkv", ".webm", ".m4v", ".avi", ".ts", ".flv")
IGNORED_NAMES = (".ds_store", "thumbs.db", "desktop.ini", ".gitkeep", ".directory")
IGNORED_SUFFIXES = (".part", ".tmp", ".crdownload", ".download", ".json", ".txt", ".nfo")
HOSTS = (("instagram.com", "instagram"), ("imginn.com", "imginn"), ("pixnoy.com", "pixnoy"), ("picuki.com", "picuki"), ("dumpor.com", "dumpor"), ("sotwe.com", "sotwe"), ("twitter.com", "twitter"), ("x.com", "twitter"))
UNSAFE = "[^A-Za-z0-9._-]+"


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def classify_media(path: Column) -> Column:
    """image, video or other by extension; null for names to ignore."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ignored = name.isin(*IGNORED_NAMES) | name.startswith(".") | any_of([name.endswith(s) for s in IGNORED_SUFFIXES])
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return F.when(ignored, None).when(suffix.isin(*IMAGE_EXTENSIONS), "image").when(suffix.isin(*VIDEO_EXTENSIONS), "video").otherwise("other")


def account_name(raw: Column) -> tuple[Column, Column]:
    """The trimmed name without leading @, and whether it is allowed."""
    name = F.regexp_replace(F.trim(raw), "^@+", "")
    return name, F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]{1,64}\z") & ~name.isin(".", ".."), F.lit(False))


def infer_provider(url: Column, more: tuple[tuple[str, str], ...] = ()) -> Column:
    """Provider of the URL's host by the first hint that it equals or is below; else custom."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    out = F.lit("custom")
    for suffix, provider in reversed((*HOSTS, *more)):
        out = F.when((host == suffix) | host.endswith(f".{suffix}"), provider).otherwise(out)
    return out


def sanitize_filename(name: Column, fallback: str = "file", most: int = 180) -> Column:
    cleaned = F.trim(F.regexp_replace(name, UNSAFE, "_"), F.lit("._"))
    return F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(fallback)), 1, most)


def extension_for(url: Column, media_type: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\.([A-Za-z0-9]{2,5})(?:$|[?#])", 1))
    usual = F.when(media_type == "image", ".jpg").when(media_type == "video", ".mp4").otherwise(".bin")
    return F.when(found != "", F.concat(F.lit("."), found)).otherwise(usual)


def target_path(remote_id: Column, url: Column, media_type: Column, posted_at: Column) -> Column:
    """Deterministic place of a remote item below its account."""
    stem = F.trim(F.substring(F.regexp_replace(remote_id, UNSAFE, "_"), 1, 80), F.lit("._"))
    stem = F.coalesce(F.nullif(stem, F.lit("")), F.lit("item"))
    folder = F.when(media_type == "video", "videos").otherwise("photos")
    day = F.coalesce(F.date_format(posted_at, "yyyyMMdd"), F.lit("00000000"))
    return F.concat(folder, F.lit("/"), day, F.lit("_"), stem, extension_for(url, media_type))


def path_escapes(path: Column) -> Column:
    """Whether a relative path leaves its root: absolute, or more .. than folders before."""
    step = lambda acc, p: F.when((acc < 0) | (p == "") | (p == "."), acc).when(p == "..", acc - 1).otherwise(acc + 1)
    return path.startswith("/") | (F.aggregate(F.split(path, "/"), F.lit(0), step) < 0)


def parse_iso(text: Column) -> Column:
    """ISO text to a timestamp without zone, null when it can't be read."""
    return F.try_to_timestamp(F.nullif(text, F.lit(""))).cast("timestamp_ntz")


def stable_remote_id(url: Column, prefix: str = "") -> Column:
    """Id from the URL's path alone, so a rotating query doesn't change it."""
    path = F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.concat(F.lit(prefix), F.replace(path, F.lit("/"), F.lit("-")))
