"""String, hash, date, path-query and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_of_case(x: Column, by: str) -> Column:
    """``ThisIsCamelCase`` in lower case with ``by`` between its words."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", f"$1{by}$2"), "([a-z0-9])([A-Z])", f"$1{by}$2"))


def snake_case(x: Column) -> Column:
    return words_of_case(x, "-")


def underscore_case(x: Column) -> Column:
    return words_of_case(x, "_")


def camel_case(x: Column) -> Column:
    """Words between dashes or underscores, each with a capital."""
    return F.array_join(F.transform(F.split(x, "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def wrapped(x: Column, a: str, b: str) -> Column:
    return F.concat(F.lit(a), x, F.lit(b))


def bracketed(x: Column) -> Column:
    return wrapped(x, "(", ")")


def squared(x: Column) -> Column:
    return wrapped(x, "[", "]")


def braced(x: Column) -> Column:
    return wrapped(x, "{", "}")


def quoted(x: Column) -> Column:
    return wrapped(x, '"', '"')


def trim_quotes(x: Column) -> Column:
    """Trimmed, and without one pair of double quotes around the rest."""
    t = F.trim(x)
    return F.when((F.length(t) > 1) & t.startswith('"') & t.endswith('"'), F.substring(t, 2, F.length(t) - 2)).otherwise(t)


def hashed(x: Column) -> Column:
    return F.sha1(F.encode(x, "utf-8"))


def has_common_bigram(x: Column, bigrams: list[str]) -> Column:
    return F.lower(x).rlike("|".join(bigrams))


CLASSES = {"midrise": "acemnorsuvwxz", "ascender": "bdfhklt", "descender": "gjpqy", "caps": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ligature": "ﬀﬁﬂﬃﬄÆæŒœ"}
COMBINING = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))


def char_class(c: Column) -> Column:
    """The class of a one-character string, null if it has none."""
    out = F.lit(None).cast("string")
    for name, chars in reversed(CLASSES.items()):
        out = F.when(F.instr(F.lit(chars), c) > 0, name).otherwise(out)
    return F.when(F.length(c) == 1, out)


def code_point(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-32BE")), 16, 10).cast("int")


def is_combining(c: Column) -> Column:
    p = code_point(c)
    out = F.lit(False)
    for low, high in COMBINING:
        out = out | p.between(low, high)
    return out


def instant(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def stamped_name(name: Column, ts: Column) -> Column:
    """A file name with a time before its extension."""
    return F.concat(F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1), F.lit("-"), F.date_format(ts, "yyyyMMddHHmmss"), F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2))


def path_filter(x: Column, regex: str) -> Column:
    """The regular expression matches all of the text."""
    return x.rlike(f"^(?:{regex})$")


def lquery_regex(query: str) -> str:
    """Regular expression of a dotted path query: names, ``*`` for any levels (also none), ``*{n}``, ``*{n,}``, ``*{,m}``, ``*{n,m}``, ``a|b``, ``!a``, and ``a*`` for a prefix."""
    import re

    out = ""
    for part in query.split("."):
        star = re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", part)
        if star:
            low, comma, high = star.groups(default="")
            times = "*" if "{" not in part else f"{{{low or 0}{',' + high if comma else ''}}}"
            out += rf"(?:(?:^|\.)[^.]+){times}"
            continue
        negated, part = part.startswith("!"), part.removeprefix("!")
        names = "|".join(re.escape(p.removesuffix("*")) + ("[^.]*" if p.endswith("*") else "") for p in part.split("|"))
        name = rf"(?!(?:{names})(?:\.|$))[^.]+" if negated else f"(?:{names})"
        out += rf"(?:^|\.){name}"
    return f"^{out}$"


def path_matches(path: Column, query: str) -> Column:
    return path.rlike(lquery_regex(query))


def under_path(path: Column, root: Column | str) -> Column:
    """The path itself and what is below it."""
    root = root if isinstance(root, Column) else F.lit(root)
    return (path == root) | F.startswith(path, F.concat(root, F.lit(".")))


def parsed(x: Column, schema: str) -> Column:
    """JSON of a schema; a malformed text is an error."""
    return F.from_json(x, schema, {"mode": "FAILFAST"})


def parsed_or_null(x: Column, schema: str) -> Column:
    return F.from_json(x, schema, {"mode": "PERMISSIVE"})


def box_from_json(x: Column) -> Column:
    """A box given as a list of four numbers or as an object of left, top, width and height."""
    from quire.functions import fixed

    listed = F.from_json(x, "array<double>")
    named = F.from_json(x, "left double, top double, width double, height double")
    is_list = F.ltrim(x).startswith("[")
    pick = lambda i, n: fixed.to_exact(F.when(is_list, F.get(listed, F.lit(i))).otherwise(named[n]))
    return F.struct(*[pick(i, n).alias(n) for i, n in enumerate(("left", "top", "width", "height"))])


def box_to_json(struct: Column) -> Column:
    return F.to_json(F.array(*[struct[n] / 100.0 for n in ("left", "top", "width", "height")]))


# --- arrays -----------------------------------------------------------------------------


def zip_all(a: Column, b: Column) -> Column:
    return F.arrays_zip(a, b)


def pairs(a: Column) -> Column:
    """Each element with the next."""
    return F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def drop(a: Column, n: int) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def take(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def intersperse(a: Column, x: Column) -> Column:
    return F.flatten(F.transform(a, lambda e, i: F.when(i == 0, F.array(e)).otherwise(F.array(x, e))))


def transposed(rows: Column, fill: Column) -> Column:
    """Columns of an array of arrays, short rows padded."""
    width = F.aggregate(rows, F.lit(0), lambda m, r: F.greatest(m, F.size(r)))
    column = lambda i: F.transform(rows, lambda r: F.coalesce(F.get(r, i), fill))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), column)).otherwise(F.array())
