"""URLs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import safe


def host(c: Column) -> Column:
    """Lower-case host without user, port or scheme."""
    rest = F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def site(c: Column) -> Column:
    """The host's last two labels, three where the last is a country and the one before is short; without www."""
    h = F.regexp_replace(host(c), r"^www\.", "")
    labels = F.split(h, r"\.")
    n = F.size(labels)
    long = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
    return F.when(long, F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def path(c: Column) -> Column:
    rest = F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def query(c: Column) -> Column:
    """Query parameters as a map, values undecoded; later keys of one name are dropped."""
    text = F.regexp_extract(c, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(text, "&"), lambda p: F.contains(p, F.lit("=")))
    kv = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, r"=(.*)$", 1).alias("v")))
    first = F.filter(kv, lambda x: F.lit(True))
    keys = F.array_distinct(F.transform(first, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(first, lambda x: x["k"] == k), 1)["v"]))


def path_parts(c: Column) -> Column:
    return F.filter(F.split(path(c), "/"), lambda x: x != "")


def shorten(c: Column, width: int = 50) -> Column:
    """Without scheme and www; a longer one keeps its host and its last part around an ellipsis, cut to width."""
    s = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^www\.", "")
    ends = F.concat(F.regexp_extract(s, r"^([^/]*)", 1), F.lit("/.../"), F.element_at(F.split(s, "/"), -1))
    out = F.when(F.length(s) <= width, s).when(F.contains(s, F.lit("/")) & (F.length(ends) <= width), ends).otherwise(s)
    return F.when(F.length(out) <= width, out).otherwise(F.concat(F.substring(out, 1, width - 3), F.lit("...")))


def to_file_name(c: Column, most: int = 250) -> Column:
    """A safe file name for a URL; longer ones end in their md5."""
    s = safe(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 33), F.lit("_"), F.md5(c)))


def quote(c: Column) -> Column:
    """Percent-encoded after the scheme, slashes kept."""
    head = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    rest = F.substr(c, F.length(head) + 1)
    return F.concat(head, F.replace(F.replace(F.url_encode(rest), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def unquote(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def image_extension(c: Column) -> Column:
    """The canonical extension of an image file name; others keep theirs in lower case."""
    ext = F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.when(ext.isin("jpg", "jpeg", "jpe", "jfif"), "jpg").when(ext.isin("tif", "tiff"), "tif").otherwise(ext)


def split_name(c: Column) -> Column:
    """struct(dir, base, ext) of a path."""
    d = F.regexp_extract(c, r"^(.*/)?", 0)
    name = F.substr(c, F.length(d) + 1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.struct(d.alias("dir"), F.substr(name, F.lit(1), F.length(name) - F.length(ext)).alias("base"), ext.alias("ext"))


def numbered(name: Column, n: Column, sep: str = " ") -> Column:
    """A path with a counter before its extension; 0 leaves it alone."""
    p = split_name(name)
    return F.when(n == 0, name).otherwise(F.concat(p["dir"], p["base"], F.lit(sep), n.cast("string"), p["ext"]))


def calendar_link(start: Column, end: Column, title: Column, base: str) -> Column:
    """An event link from two timestamps; `base` is the address of the calendar's form."""
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(F.lit(base + "?action=TEMPLATE&text="), F.url_encode(title), F.lit("&dates="), stamp(start), F.lit("/"), stamp(end))
