"""String functions: tokens, names, masks and labels. All are built-in expressions."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

# Letters that do not decompose, and Latin letters with marks beside their bare form.
ATOMIC = {
    "Ø": "O", "ø": "o", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th", "Ð": "D", "ð": "d", "ß": "ss",
    "Ł": "L", "ł": "l", "Đ": "D", "đ": "d",
}
# Parameters whose value is a secret.
SECRET_KEYS = ("api-key", "API_Key", "api_key", "apikey", "token", "access_token", "key")
# Loggers of the application, by name and by the start of the name.
APP_LOGGERS = ("main", "services", "middleware")
APP_PREFIXES = ("main", "services.", "middleware.")


def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition holds one ASCII character, those characters, and texts of the longer ones."""
    marked, bare, longer = [], [], {}
    for code in (c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            marked.append(chr(code))
            bare.append(plain)
        elif plain:
            longer[chr(code)] = plain
    return "".join(marked), "".join(bare), longer


MARKED, BARE, LONGER = _plain_letters()


def folded(text: Column) -> Column:
    """ASCII text: atomic letters spelled out, all others by their decomposition, the rest removed.

    Characters that stand for several (ligatures, fractions, squared units) are looked up
    one by one; they are sought only among what is not ASCII once all others are replaced.
    """
    longer = {**LONGER, **{k: v for k, v in ATOMIC.items() if len(v) > 1}}
    single = {k: v for k, v in ATOMIC.items() if len(v) == 1}
    table = F.from_json(F.lit(json.dumps(longer)), "map<string, string>")

    def spelled(t: Column) -> Column:
        rest = F.array_distinct(F.split(F.regexp_replace(t, r"[\x00-\x7F]+", ""), ""))
        return F.aggregate(rest, t, lambda done, c: F.when(c == "", done).otherwise(F.replace(done, c, F.coalesce(F.try_element_at(table, c), F.lit("")))))

    plain = let(F.translate(text, MARKED + "".join(single), BARE + "".join(single.values())), spelled)
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)


def sanitize_token(text: Column) -> Column:
    """A safe identifier: words capitalised and joined, other characters to single underscores."""
    bare = folded(F.regexp_replace(F.coalesce(text, F.lit("")), "['\"`]", ""))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    titled = F.concat_ws("", F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))))
    return F.regexp_replace(F.regexp_replace(titled, "[^A-Za-z0-9_]|_+", "_"), "^_+|_+$|_(?=_)", "")


def sanitize_project(text: Column, default: str = "Terrain") -> Column:
    """Letters, digits, blanks, dashes and underscores, single ones, trimmed, 64 at most, else a default."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9 _-]", "")
    short = F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(kept, "[ ]+", " "), "_+", "_"), F.lit(64)), "^[ _-]+|[ _-]+$", "")
    return F.when(short == "", default).otherwise(short)


def guid16(text: Column) -> Column:
    return F.upper(F.substring(F.sha2(text, 256), 1, 16))


def auto_name(country: Column, lat: Column, lon: Column) -> Column:
    """Country with rounded latitude and longitude, half to even."""
    return F.concat(
        country, F.lit("_"), F.bround(F.abs(lat), 0).cast("int").cast("string"), F.when(lat >= 0, "N").otherwise("S"), F.lit("_"),
        F.bround(F.abs(lon), 0).cast("int").cast("string"), F.when(lon >= 0, "E").otherwise("W"),
    )


def mask_secrets(url: Column) -> Column:
    """Values of secret parameters replaced up to the next ``&``, with = or %3D, in any case, whatever stands before the name."""
    return F.regexp_replace(url, rf"(?i)((?:{'|'.join(SECRET_KEYS)})(?:=|%3D))[^&]+", "$1***")


def host_label(url: Column) -> Column:
    """The host of a URL, or the text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1), F.lit("")), url)


def human_size(n: Column) -> Column:
    """Bytes in the first of B, KB, MB, GB that stays under 1024, else TB; one decimal, half to even."""

    def shown(power: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}"))

    size = F.when(n < 1024, shown(0, "B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        size = size.when(n < 1024 ** (power + 1), shown(power, unit))
    return size.when(n.isNotNull(), shown(4, "TB"))


def log_level(level: Column) -> Column:
    """Application log levels to job levels; what is below a warning is information."""
    low = F.lower(level)
    return F.when(low.isin("critical", "error"), "error").when(low == "warning", "warning").otherwise("info")


def app_logger(name: Column) -> Column:
    """Whether records of this logger belong to a job's log."""
    return name.isin(*APP_LOGGERS) | F.coalesce(name.rlike("^(?:" + "|".join(p.replace(".", "[.]") for p in APP_PREFIXES) + ")"), F.lit(False))


def strip_job_tag(message: Column) -> Column:
    return F.regexp_replace(message, r"^\[job:[^\]]*\]\s*", "")


def quadrant(x: Column, z: Column, width: Column, depth: Column) -> Column:
    """NW, NE, SW or SE by halves; C when a coordinate is missing."""
    name = F.concat(F.when(z >= depth / 2, "N").otherwise("S"), F.when(x >= width / 2, "E").otherwise("W"))
    return F.when(x.isNull() | z.isNull(), "C").otherwise(name)
