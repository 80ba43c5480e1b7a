"""Text normalisation, word sets, file-name rules and box text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .binding import let


def query_norm(text: Column) -> Column:
    """Lower case, punctuation removed, runs of white space collapsed."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def words(norm_text: Column) -> Column:
    """Words of a normalised text (empty text has none)."""
    return F.filter(F.split(norm_text, " "), lambda w: w != "")


def word_set(norm_text: Column) -> Column:
    return F.array_distinct(words(norm_text))


def answer_tokens(text: Column) -> Column:
    """Lower-case tokens with ``. ! ? ,`` split off."""
    spaced = F.regexp_replace(F.lower(text), r"([.!?,])", " $1 ")
    return F.filter(F.split(F.trim(spaced), r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams in order, empty when there are fewer than ``n`` tokens."""

    def grams(t):
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, joined).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two duplicate-free arrays; two empty arrays give 0."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(shared.cast("double"), total.cast("double")))


def stable_query_id(text: Column) -> Column:
    """md5 of the trimmed lower-case text, written as a UUID."""
    digest = F.md5(F.lower(F.trim(text)))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def scene_text(sensor: Column, modality: Column, obj: Column) -> Column:
    """Search text of a scene; absent or empty parts are skipped."""
    blank = F.lit("")
    return F.concat_ws(" ", F.nullif(sensor, blank), F.nullif(modality, blank), F.nullif(obj, blank))


def scene_text_placed(obj: Column, sensor: Column, modality: Column, wkt: Column) -> Column:
    """Search text with the place: object, sensor, modality and the first point of the outline to one digit."""
    blank = F.lit("")
    point = F.split(F.trim(F.regexp_extract(wkt, r"^POLYGON\(\(([^,)]*)", 1)), r"\s+")
    lon, lat = F.get(point, 0).try_cast("double"), F.get(point, 1).try_cast("double")
    digit = lambda x: F.format_string("%.1f", F.bround(x, 1))
    near = F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("near "), digit(lon), F.lit(","), digit(lat)))
    return F.concat_ws(" ", F.nullif(obj, blank), F.nullif(sensor, blank), F.nullif(modality, blank), near)


def task_of_file(name: Column) -> Column:
    """Task of a training file by its name; the first word of ``fv.TASK_FILE_WORDS`` decides, ``vqa`` without any."""
    lower = F.lower(F.element_at(F.split(name, "/"), -1))
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for word, task in fv.TASK_FILE_WORDS:
        out = out.when(F.contains(lower, F.lit(word)), task)
    return out.otherwise("vqa")


def semantic_query_text(text: Column, obj: Column) -> Column:
    blank = F.lit("")
    joined = F.concat_ws(" ", F.nullif(F.trim(text), blank), F.nullif(F.trim(obj), blank))
    return F.nullif(joined, blank)


def contains_any(text: Column, keywords: list[str]) -> Column:
    """True when any keyword is a substring of the text."""
    escaped = [k.replace("\\", "\\\\").replace(".", "\\.").replace("-", "\\-") for k in keywords]
    return text.rlike("|".join(escaped))


def detect_modality(path: Column, default: str = "unknown") -> Column:
    """Modality from the base name of a path: radar, then fusion, then optical words."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = None
    for modality in ("sar", "fusion", "optical"):
        hit = contains_any(name, fv.MODALITY_KEYWORDS[modality])
        out = F.when(hit, modality) if out is None else out.when(hit, modality)
    return out.otherwise(default)


def _unit_box(parts: list[Column]) -> Column:
    x1, y1, x2, y2 = (p.try_cast("double") for p in parts)
    ok = (x2 > x1) & (y2 > y1)
    for v in (x1, y1, x2, y2):
        ok = ok & (v >= 0.0) & (v <= 1.0)
    return F.when(ok, F.array(x1, y1, x2, y2))


def parse_bbox_text(text: Column) -> Column:
    """Four numbers in [0, 1] from any of four written forms, null when none is valid."""
    num = r"([\d.]+)"
    comma = r"\s*,\s*"
    plain = rf"\[\s*{num}{comma}{num}{comma}{num}{comma}{num}\s*\]"
    pairs = rf"\[\s*\(\s*{num}{comma}{num}\s*\){comma}\(\s*{num}{comma}{num}\s*\)\s*\]"
    angle = rf"<\s*{num}{comma}{num}{comma}{num}{comma}{num}\s*>"
    # the first form that occurs decides, even if its numbers are out of range
    out = None
    for form in (plain, pairs, angle):
        box = _unit_box([F.regexp_extract(text, form, i) for i in range(1, 5)])
        out = F.when(text.rlike(form), box) if out is None else out.when(text.rlike(form), box)
    keyed = [F.regexp_extract(text, rf"{k}\s*=\s*{num}", 1) for k in ("x1", "y1", "x2", "y2")]
    return out.otherwise(_unit_box(keyed))


def format_bbox(box: Column) -> Column:
    text = F.format_string("[%.2f, %.2f, %.2f, %.2f]", *[F.get(box, i).cast("double") for i in range(4)])
    return F.when(F.size(box) == 4, text).otherwise("[0.25, 0.25, 0.75, 0.75]")


def strip_json_fence(reply: Column) -> Column:
    """Array of the non-empty lines of a model reply, taken from its first markdown fence if it has one."""
    inside = F.regexp_extract(reply, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    body = F.when(F.contains(reply, F.lit("```")), inside).otherwise(reply)
    return F.filter(F.transform(F.split(body, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def to_utc(text: Column) -> Column:
    """ISO text to a timestamp; text without a zone is UTC (the session zone), bad text is null."""
    return F.try_to_timestamp(text)
