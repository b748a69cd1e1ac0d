"""Column expressions that let only harmless values through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicebox.functions.pycode import round_binary
from sluicebox.functions.text import strip

#: Words and forms that metadata mustn't carry: credentials, addresses, local paths.
UNSAFE = r"(?i)(?:authorization|bearer\s|api[-_]?key|https?://|[A-Z]:[/\\]|(?:^|[/\\])(?:home|temp|tmp|users)(?:[/\\]|$))"


def truthy(c: Column, default: str) -> Column:
    """The value, or the default for null and the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def safe_value(c: Column) -> Column:
    """The stripped value if it is made of letters, digits and _.:- only; else ``unknown``, also for the number 0 and for false."""
    s = strip(c.cast("string"))
    # The type is known when the plan is made, so this folds away for strings.
    none = ~F.typeof(c).isin("string", "void") & s.isin("0", "0.0", "false")
    return F.when(none, "unknown").when(s.rlike(r"\A[-.:\w]+\z") & s.rlike(r"\A[\x21-\x7e]+\z"), s).otherwise("unknown")


def safe_text(c: Column, pattern: str = UNSAFE) -> Column:
    """The stripped text, or null where it is blank or matches the pattern."""
    s = strip(c)
    return F.when((s != "") & ~s.rlike(pattern), s)


def safe_integer(c: Column) -> Column:
    """A number of at least 0 as bigint, else null."""
    n = c.cast("string").try_cast("bigint")
    return F.when(n >= 0, n)


def safe_float(c: Column) -> Column:
    """A finite number of at least 0, rounded to 6 digits by its binary value, else null."""
    x = c.cast("string").try_cast("double")
    return round_binary(F.when((x >= 0) & ~F.isnan(x) & (x < F.lit(float("inf"))), x))


def safe_scalar(c: Column) -> Column:
    """Numbers and truth values as they are (in text form); texts as :func:`safe_text` has them."""
    return F.when(~F.typeof(c).isin("string", "void"), c.cast("string")).otherwise(safe_text(c.cast("string")))


def relative_filename(c: Column, default: str = "app.py") -> Column:
    """Slashes forward; of absolute paths, paths on a drive and paths with .. only the last part; blank gives the default."""
    s = F.replace(strip(truthy(c, default)), F.lit("\\"), F.lit("/"))
    risky = s.startswith("/") | s.rlike(r"\A[A-Za-z]:/") | F.array_contains(F.split(s, "/", -1), "..")
    out = F.when(risky, F.element_at(F.split(s, "/", -1), -1)).otherwise(s)
    return truthy(out, default)


def fold_profile(c: Column, fallback: str) -> Column:
    """A known profile in lower case, else the fallback (planning falls back to compact, verification to unknown)."""
    p = F.lower(strip(truthy(c, "compact")))
    return F.when(p.isin("compact", "window_balanced"), p).otherwise(fallback)


def fold_mode(c: Column) -> Column:
    """Lower case, stripped, with the old name of directory traversal replaced."""
    m = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(m == "path_disclosure", "directory_traversal").otherwise(m)


def rule_id(c: Column, prefix: str, known: list[str] | None = None) -> Column:
    """Scanner rule ids come with the path of their file in front: from the first ``.prefix.`` on, where it occurs; known ids as they are."""
    tail = F.regexp_extract(c, rf"(?s)\.({prefix}\..*)", 1)
    own = c.isin(known or [])
    return F.when(own | (tail == ""), c).otherwise(tail)


def finding_ids(c: Column) -> Column:
    """Ids that are safe texts, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: safe_text(x)), lambda x: x.isNotNull())))
