"""Column functions: text folding, paths, names, coordinates, dates, ratios. All stay in the JVM."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """A-Z folded only; À and the like keep their case."""
    return F.translate(col(c), UPPER, LOWER)


def name_matches(c: Column | str, name: str, mode: str) -> Column:
    """exact, prefix or contains, without regard to ASCII case; wildcards have no meaning."""
    folded, want = ascii_lower(c), F.lit("".join(x.lower() if x in UPPER else x for x in name))
    return {"exact": folded == want, "prefix": folded.startswith(want), "contains": folded.contains(want)}[mode]


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def presented(df: DataFrame, *coordinates: str) -> DataFrame:
    """Stored zero-based coordinates as one-based, null kept."""
    return df.withColumns({c: F.col(c) + 1 for c in coordinates})


def seconds(c: Column | str) -> Column:
    return F.timestamp_seconds(col(c))


def monday_week(c: Column | str) -> Column:
    """Year and week 00 to 53, weeks beginning on Mondays, of epoch seconds."""
    d = seconds(c)
    week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("string")
    return F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad(week, 2, "0"))


def sunday_weekday(c: Column | str) -> Column:
    return F.dayofweek(seconds(c)) - 1


def segments(path: Column | str) -> Column:
    return F.split(col(path), "/")


def directory_prefix(path: Column | str, depth: int) -> Column:
    """The first `depth` directories, without the file name; `.` if there is none."""
    s = segments(path)
    n = F.least(F.lit(depth), F.size(s) - 1)
    return F.when(n > 0, F.array_join(F.slice(s, F.lit(1), F.greatest(n, F.lit(1))), "/")).otherwise(".")


def leading_segments(path: Column | str, depth: int) -> Column:
    """The first `depth` segments, the file name included."""
    return F.array_join(F.slice(segments(path), 1, depth), "/")


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def bare_type(raw: Column | str) -> Column:
    """A type's own name: without qualifiers, references, pointers, arguments and scopes. Function pointers
    have none."""
    s = col(raw)
    for pattern in (r"\b(const|volatile|restrict|mutable)\b", r"\b(struct|enum|union|class)\b", r"^&'[a-zA-Z_]\w*\s+(mut\s+)?", r"^&mut\s+", r"^&", r"[\*&\[\]?]+$"):
        s = F.regexp_replace(s, pattern, "")
    plain = F.substring_index(s, "<", 1)
    plain = F.when(plain.contains("::"), F.substring_index(plain, "::", -1)).otherwise(F.substring_index(plain, ".", -1))
    return F.when(s.rlike(r"\(\s*\*\s*\)"), F.lit("")).otherwise(F.trim(plain, F.lit(" \t\r\n")))


def member_name(raw: Column | str) -> Column:
    """What follows the last dot; the whole where nothing does."""
    after = F.trim(F.substring_index(col(raw), ".", -1), F.lit(" \t\r\n"))
    return F.when(~col(raw).contains("."), col(raw)).otherwise(F.coalesce(F.nullif(after, F.lit("")), col(raw)))


def return_type(signature: Column | str) -> Column:
    """After `):`, else `->`, else `:` in the first line that is not blank; null if none."""
    lines = F.filter(F.transform(F.split(col(signature), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    found = [F.nullif(F.trim(F.regexp_extract(first, p, 1)), F.lit("")) for p in (r"\)\s*:\s*([^={]+)$", r"->\s*([^={]+)$", r":\s*([^={]+)$")]
    return F.coalesce(*found)


def rename_paths(path: Column | str) -> Column:
    """Both paths of `a/{b => c}/d` and `a => b`; otherwise the path alone. Doubled slashes are closed."""
    p = col(path)
    brace = r"^(.*)\{(.*) => (.*)\}(.*)$"
    part = lambda k: F.regexp_extract(p, brace, k)
    shut = lambda c: F.regexp_replace(c, "//+", "/")
    return (
        F.when(p.rlike(brace), F.array(shut(F.concat(part(1), part(2), part(4))), shut(F.concat(part(1), part(3), part(4)))))
        .when(p.contains(" => "), F.array(F.substring_index(p, " => ", 1), F.substring_index(p, " => ", -1)))
        .otherwise(F.array(p))
    )


def plain_path(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(col(path), "\\", "/"), "^(\\./)+", ""), "^/+|/+$", "")


def in_scope(path: Column | str, scope: Column | str) -> Column:
    """Equal, at the end of, or within a path by whole segments."""
    p, s = plain_path(path), plain_path(scope)
    return (p == s) | p.endswith(F.concat(F.lit("/"), s)) | s.endswith(F.concat(F.lit("/"), p)) | p.startswith(F.concat(s, F.lit("/"))) | p.contains(F.concat(F.lit("/"), s, F.lit("/")))


def iso_seconds(text: str | None, end_of_day: bool = False) -> int | None:
    """Epoch seconds of a date or time in ISO form; a bare date may mean its last second; None if invalid."""
    if not text:
        return None
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        return None
    t = t if t.tzinfo else t.replace(tzinfo=UTC)
    if end_of_day and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        t += timedelta(days=1, seconds=-1)
    return int(t.timestamp() // 1)


def message_prefix(message: Column | str) -> Column:
    """Up to and with the first colon in lower case; `(other)` without one."""
    m = col(message)
    return F.when(m.contains(":"), F.lower(F.concat(F.substring_index(m, ":", 1), F.lit(":")))).otherwise("(other)")


def structural_text(*parts: Column | str) -> Column:
    """Distinct trimmed parts that are not blank, one a line."""
    own = F.array(*[F.trim(F.coalesce(col(p), F.lit(""))) for p in parts])
    return F.array_join(F.array_distinct(F.filter(own, lambda x: x != "")), "\n")


def token_estimate(c: Column | str) -> Column:
    return F.ceil(F.length(col(c)) / 4)


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def line_slice(source: Column | str, first: int, last: int) -> Column:
    """Lines first to last, one-based, as far as there are."""
    return F.array_join(F.slice(F.split(col(source), "\n"), first, last - first + 1), "\n")


def line_count(source: Column | str) -> Column:
    return F.size(F.split(col(source), r"\r\n|\r|\n"))


def line_lengths(source: Column | str) -> Column:
    lines = F.split(col(source), r"\r\n|\r|\n")
    plain = F.octet_length(col(source)) == F.length(col(source))  # ASCII: no pairs of surrogates to look for
    return F.when(plain, F.transform(lines, lambda x: F.length(x))).otherwise(F.transform(lines, lambda x: utf16_length(x)))


def glob_regexp(glob: str) -> str:
    """A glob with `*`, `?`, `**` and braces as an anchored regular expression."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.sub(r"([\\.^$+()\[\]{}|])", r"\\\1", c)
        i += 1
    return f"^{out}$"


def selected(path: Column | str, include: list[str], exclude: list[str] | None = None) -> Column:
    """Within an include glob (all without any) and no exclude glob."""
    p = col(path)
    yes, no = F.lit(not include), F.lit(False)
    for g in include:
        yes = yes | p.rlike(glob_regexp(g))
    for g in exclude or []:
        no = no | p.rlike(glob_regexp(g))
    return yes & ~no
