"""What a text value can be shown as: an image, a URL, a date, a colour, base64, percent-coding, a token, escapes.

All are Column expressions; the first kind that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = r"(?i)^(?:https?://[^\s?#]+\.(?:png|jpe?g|gif|webp|svg|bmp|ico)(?:[?#]\S*)?|data:image/[a-z.+-]+;base64,\S+)$"
URL = r"(?i)^https?://[^\s/?#]+\S*$"
COLOUR = r"(?i)^(?:#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})|(?:rgb|hsl)a?\([\d\s.,%/deg-]+\))$"
JWT = r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$"
ISO = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?)?$"


def epoch(text: Column) -> Column:
    """Seconds (10 digits) or milliseconds (13) since 1970 as a timestamp, else null."""
    n = text.try_cast("long")
    return F.when(text.rlike(r"^\d{10}$"), F.timestamp_seconds(n)).when(text.rlike(r"^\d{13}$"), F.timestamp_millis(n))


def date(text: Column) -> Column:
    return F.coalesce(epoch(text), F.when(text.rlike(ISO), F.try_to_timestamp(text)))


def base64_text(text: Column) -> Column:
    """The decoded text if the value is base64 of plain UTF-8, else null."""
    fits = text.rlike(r"^[A-Za-z0-9+/]{8,}={0,2}$") & (F.length(text) % 4 == 0)
    plain = F.when(fits, F.try_to_binary(text, F.lit("base64")))
    decoded = F.try_validate_utf8(plain.cast("string"))
    return F.when(decoded.rlike(r"^[^\x00-\x08\x0e-\x1f\x7f]+$"), decoded)


def jwt_payload(text: Column) -> Column:
    """The second part of a token as JSON text, null if it is none."""
    part = F.translate(F.get(F.split(text, r"\."), F.lit(1)), "-_", "+/")
    filled = F.rpad(part, (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.try_validate_utf8(F.try_to_binary(filled, F.lit("base64")).cast("string"))
    return F.when(text.rlike(JWT) & F.try_parse_json(decoded).isNotNull() & decoded.startswith("{"), decoded)


def percent_decoded(text: Column) -> Column:
    return F.when(text.rlike(r"%[0-9A-Fa-f]{2}"), F.try_url_decode(text))


def unescaped(text: Column) -> Column:
    r"""Text with \uXXXX written out."""
    return F.when(text.rlike(r"\\u[0-9a-fA-F]{4}"), F.from_json(F.concat(F.lit('["'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"]')), "array<string>")[0])


def preview_kind(text: Column) -> Column:
    return (
        F.when(text.rlike(IMAGE), "image")
        .when(text.rlike(URL), "url")
        .when(date(text).isNotNull(), "date")
        .when(text.rlike(COLOUR), "colour")
        .when(jwt_payload(text).isNotNull(), "jwt")
        .when(base64_text(text).isNotNull(), "base64")
        .when(percent_decoded(text).isNotNull(), "percent")
        .when(unescaped(text).isNotNull(), "escapes")
    )


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, host, path, query and fragment by pattern, empty where absent."""
    p = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    return {n: F.coalesce(F.regexp_extract(url, p, k), F.lit("")) for k, n in enumerate(("scheme", "host", "path", "query", "fragment"), 1)}


def query_table(url: Column) -> Column:
    """The query as an array of (name, value), decoded, in order."""
    q = url_parts(url)["query"]
    parts = F.when(q == "", F.array().cast("array<string>")).otherwise(F.split(q, "&"))
    return F.transform(parts, lambda x: F.struct(F.try_url_decode(F.substring_index(x, "=", 1)).alias("name"), F.try_url_decode(F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("")).alias("value")))
