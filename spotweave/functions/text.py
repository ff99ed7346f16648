"""Text expressions; all of them work on whole values and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spotweave.settings import SECTION_LABELS

# Unicode whitespace plus the four separator controls.
_WS = r"[\s\x1c-\x1f]"
_LINE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_WS}+|{_WS}+$", "")


def labelled_section(text: Column, label: str) -> Column:
    """Text after the label on the last line starting with it, ``''`` without such a line."""
    lines = F.filter(F.transform(F.split(text, _LINE), strip), lambda line: F.startswith(line, F.lit(label)))
    last = F.get(lines, F.size(lines) - 1)
    return F.coalesce(strip(F.substring(last, len(label) + 1, 2_000_000_000)), F.lit(""))


def scene_sections(text: Column, labels: dict[str, str] = SECTION_LABELS) -> list[Column]:
    return [labelled_section(text, label).alias(name) for name, label in labels.items()]


def clean_narrative(text: Column) -> Column:
    """One plain line from a description with emphasis marks, headings, bullets or numbering.

    A line may open with a heading mark, then a bullet, then a number; white space that breaks a line or
    is longer than one character becomes a single space.
    """
    opening = "".join(f"(?:{_WS}*{mark}{_WS}+)?" for mark in ("#{1,6}", "[-•]", r"\d+\."))
    plain = F.regexp_replace(text, r"(?U)\*{1,3}([^*\n]+)\*{1,3}", "$1")
    unmarked = F.regexp_replace(plain, f"(?dmU)^{opening}", "")
    return F.coalesce(strip(F.regexp_replace(unmarked, rf"(?U){_WS}{{2,}}|\n", " ")), F.lit(""))


def keyword_tags(text: Column, limit: int = 12, max_chars: int = 40, max_words: int = 3) -> Column:
    """First distinct short tags of a comma- or newline-separated answer."""
    raw = F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(",")), ","), lambda t: F.lower(strip(t)))
    short = F.filter(raw, lambda t: (F.length(t) >= 1) & (F.length(t) <= max_chars)
                     & (F.size(F.split(t, rf"(?U){_WS}+")) <= max_words))
    return F.slice(F.array_distinct(short), 1, limit)


def parsed_score(raw: Column) -> Column:
    """Number in [0, 1], else NULL."""
    plain = strip(raw)
    number = F.when(F.rlike(plain, F.lit(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")), plain).try_cast("double")
    return F.when((number >= 0) & (number <= 1), number)


def label_band(score: Column, positive: float = 0.7, negative: float = 0.3) -> Column:
    return (F.when(score >= positive, F.lit("positive")).when(score <= negative, F.lit("negative"))
            .when(score.isNotNull(), F.lit("ambiguous")))


def basename(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.get(parts, F.size(parts) - 1)


def quoted(name: Column) -> Column:
    """Percent-encoding that keeps letters, digits and ``_ . - ~``."""
    encoded = F.url_encode(name)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def ad_url(base: str, ad_type: Column, path: Column) -> Column:
    folder = F.when(ad_type == "video_clip", F.lit("videos")).otherwise(F.lit("images"))
    return F.concat(F.lit(f"{base}/media/ads/"), folder, F.lit("/"), basename(path))


def source_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(f"{base}/media/source/"), quoted(basename(path)))


def mounted_path(path: Column, ad_type: Column, video_dir: str, image_dir: str) -> Column:
    """Stored path moved to the mounted media folder unless it is already there."""
    folder = F.when(ad_type == "video_clip", F.lit(video_dir)).otherwise(F.lit(image_dir))
    drive = (F.length(path) >= 3) & (F.substring(path, 2, 1) == ":")
    moved = F.concat(folder, F.lit("/"), basename(path))
    return (F.when(path.isNull() | (path == ""), F.lit("")).when(drive, moved)
            .when((folder != "") & ~F.startswith(path, folder), moved).otherwise(path))


def format_time(seconds: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``, rounded down, never negative."""
    whole = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60

    def two(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")

    return (F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest)))
            .otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(rest))))


def title_key(filename: Column) -> Column:
    """Name up to the first dot, dashes and underscores as spaces, trimmed, lower case."""
    head = F.get(F.split(filename, r"\."), F.lit(0))
    return F.lower(strip(F.regexp_replace(head, "[-_]", " ")))
