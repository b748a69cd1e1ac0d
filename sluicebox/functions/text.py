"""Column expressions over source text: tokens, token windows, literal spans, shingles, diffs' changed parts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 200
STRIDE = 5
SHINGLE = 5
#: White space as str.strip() knows it; SQL trim() takes blanks only.
SPACE = r"[\s\x1c-\x1f]+"
_PAIRS = ("**", "//", "<<", "<=", "==", "!=", ">=", ">>")
#: White space, and what may follow the first letter of a name, one by one: the engines' own classes differ at controls, accents and superscripts.
_BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Identifier, number, two-sign operator, or any other sign.
TOKEN = "|".join([r"[A-Z_a-z][\p{L}\p{N}_]*", r"\p{Nd}+(?:\.\p{Nd}+)?", *map(re.escape, _PAIRS), f"[^{_BLANK}]"])
#: Where str.splitlines() splits.
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"


#: The same, character by character: looked at from both ends only, where a pattern would be tried at every place of the text.
_EDGES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_EDGES))


def newlines(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def lines(c: Column) -> Column:
    """Stripped lines without the blank ones."""
    return F.filter(F.transform(F.split(c, LINE_END, -1), strip), lambda x: x != "")


def normal_code(c: Column) -> Column:
    """Unified line ends, stripped, one LF at the end."""
    return F.concat(strip(newlines(c)), F.lit("\n"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once: within a lambda, an expression over columns runs anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SPANS = "array<struct<a:int,b:int>>"
_CHUNK = 256


def token_ends(c: Column) -> Column:
    """[start, end) of every token, in characters. Running sums go by chunks: one array over all tokens would be copied for each."""
    size = lambda p: p["g"] + p["t"]
    none = F.array().cast(_SPANS)

    def chunked(pairs: Column) -> Column:
        last = ((F.size(pairs) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(pairs, i * _CHUNK + 1, _CHUNK))

    def bases(chunks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + F.aggregate(x, F.lit(0), lambda s, p: s + size(p))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(chunks, start, step, lambda acc: acc["out"])

    def ends(pairs: Column, base: Column) -> Column:
        span = lambda acc, p: F.array(F.struct((acc["at"] + p["g"]).alias("a"), (acc["at"] + size(p)).alias("b")))
        step = lambda acc, p: F.struct((acc["at"] + size(p)).alias("at"), F.concat(acc["out"], span(acc, p)).alias("out"))
        return F.aggregate(pairs, F.struct(base.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def of(t: Column) -> Column:
        pairs = F.zip_with(t, F.slice(F.split(c, TOKEN, -1), 1, F.greatest(F.size(t), F.lit(1))), lambda x, g: F.struct(F.length(g).alias("g"), F.length(x).alias("t")))
        return let(pairs, lambda p: let(chunked(p), lambda cs: F.flatten(F.zip_with(cs, bases(cs), ends))))

    return let(tokens(c), lambda t: F.when(F.size(t) == 0, none).otherwise(of(t)))


def literal_pattern(part: Column) -> Column:
    r"""A regular expression for the text itself; \E within it is quoted on its own."""
    return F.concat(F.lit(r"\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def part_spans(c: Column, parts: Column) -> Column:
    """Non-overlapping occurrences, from the left, of each non-empty part, parts in order. Their starts are a running sum."""
    none = F.array().cast(_SPANS)

    def of(part: Column) -> Column:
        n = F.length(part)
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        # Occurrences by chunks of pieces: one array over all of them would be copied for each.
        step = lambda acc, p: F.struct((acc["at"] + F.length(p) + n).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p)).alias("a"), (acc["at"] + F.length(p) + n).alias("b")))).alias("out"))
        size = lambda chunk: F.aggregate(chunk, F.lit(0), lambda s, p: s + F.length(p) + n)

        def chunked(pieces: Column) -> Column:
            last = ((F.size(pieces) - 2) / _CHUNK).cast("int")
            chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(pieces, i * _CHUNK + 1, F.least(F.lit(_CHUNK), F.size(pieces) - 1 - i * _CHUNK)))
            bases = lambda cs: F.aggregate(cs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
            ends = lambda x, base: F.aggregate(x, F.struct(base.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
            return let(chunks, lambda cs: F.flatten(F.zip_with(cs, bases(cs), ends)))

        found = lambda pieces: F.when(F.size(pieces) > 1, chunked(pieces)).otherwise(none)
        return let(F.split(c, literal_pattern(part), -1), found)

    return F.flatten(F.transform(F.filter(parts, lambda p: (p != "") & F.contains(c, p)), of))


def window_starts(n: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """Starts at every stride, and one aligned to the end; none for no tokens."""
    last = F.greatest(n - window, F.lit(0))
    strides = F.sequence(F.lit(0), last, F.lit(stride))
    return F.when(n > 0, F.when(last % stride == 0, strides).otherwise(F.concat(strides, F.array(last)))).otherwise(F.array().cast("array<int>"))


def window_labels(c: Column, parts: Column, window: int = WINDOW, stride: int = STRIDE, starts: Column | None = None) -> Column:
    """1 for each window whose characters overlap a part, else 0. Positions are computed only where a part occurs; ``starts``, where they are known already, save the tokens of other texts."""

    def label(spans: Column, at: Column, s: Column) -> Column:
        first, last = F.get(at, s)["a"], F.get(at, F.least(s + window, F.size(at)) - 1)["b"]
        return F.exists(spans, lambda x: (first < x["b"]) & (x["a"] < last)).cast("int")

    def marked(spans: Column) -> Column:
        none = F.transform(window_starts(F.size(tokens(c)), window, stride) if starts is None else starts, lambda _: F.lit(0))
        some = let(token_ends(c), lambda at: F.transform(window_starts(F.size(at), window, stride), lambda s: label(spans, at, s)))
        return F.when(F.size(spans) == 0, none).otherwise(some)

    return let(part_spans(c, parts), marked)


def part_token_count(c: Column, parts: Column) -> Column:
    """Tokens that overlap a part, each once."""
    hit = lambda spans: F.filter(token_ends(c), lambda t: F.exists(spans, lambda x: (t["a"] < x["b"]) & (x["a"] < t["b"])))
    return let(part_spans(c, parts), lambda spans: F.when(F.size(spans) == 0, F.lit(0)).otherwise(F.size(hit(spans))))


def token_windows(c: Column, labels: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """structs (start, label, tokens) of all windows; the labels in the order of :func:`window_starts`."""

    def of(t: Column) -> Column:
        return F.zip_with(window_starts(F.size(t), window, stride), labels, lambda s, y: F.struct(s.alias("start"), y.alias("label"), F.slice(t, s + 1, window).alias("tokens")))

    return let(tokens(c), of)


def window_texts(t: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """The tokens of each window, joined by blanks, in the order of :func:`window_starts`.

    Windows that begin at a stride are put together from runs of a stride's tokens, which are joined once.
    """
    plain = lambda s: F.array_join(F.slice(t, s + 1, window), " ")
    starts = window_starts(F.size(t), window, stride)
    if window % stride:
        return F.transform(starts, plain)
    runs = F.transform(F.sequence(F.lit(0), ((F.size(t) - 1) / stride).cast("int")), lambda i: F.array_join(F.slice(t, i * stride + 1, stride), " "))
    of = lambda r: F.transform(starts, lambda s: F.when(s % stride == 0, F.array_join(F.slice(r, (s / stride).cast("int") + 1, window // stride), " ")).otherwise(plain(s)))
    return F.when(F.size(t) > 0, let(runs, of)).otherwise(F.array().cast("array<string>"))


def shingles(t: Column, k: int = SHINGLE) -> Column:
    """Distinct runs of k tokens joined by blanks; fewer than k tokens are one run, none are none."""
    runs = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, k), " ")))
    return let(t, lambda x: F.when(F.size(x) > 0, runs(x)).otherwise(F.array().cast("array<string>")))


def pair_tokens(before: Column, after: Column) -> Column:
    """The tokens of both texts of a pair, with a mark between them."""
    return F.concat(before, F.array(F.lit("<FIXED>")), after)


def changed_parts(diff: Column, sign: str) -> Column:
    """Distinct stripped lines of a unified diff that begin with the sign, in order; header-like prefixes are passed over."""
    own = F.filter(F.split(diff, LINE_END, -1), lambda x: x.startswith(sign) & ~x.startswith("---") & ~x.startswith("+++") & ~x.startswith("@@"))
    return F.array_distinct(F.filter(F.transform(own, lambda x: strip(F.substring(x, 2, 1 << 30))), lambda x: x != ""))


def string_list(c: Column) -> Column:
    """Stripped items without the blank ones; null is no items."""
    return F.coalesce(F.filter(F.transform(c, strip), lambda x: x != ""), F.array().cast("array<string>"))


def lines_present(code: Column, wanted: Column) -> Column:
    """Whether every non-blank wanted line stands in the code, stripped."""
    return F.size(F.array_except(string_list(wanted), lines(code))) == 0


def pair_hash(before: Column, after: Column) -> Column:
    """SHA-256 of both normalised texts with a NUL between them."""
    clean = lambda x: strip(newlines(F.coalesce(x, F.lit(""))))
    return F.sha2(F.concat(clean(before), F.char(F.lit(0)), clean(after)), 256)


def marker_lines(code: Column, markers: list[str], ignore_case: bool = True) -> Column:
    """Stripped lines that hold one of the markers, in order, as often as they occur."""
    fold = F.lower if ignore_case else (lambda x: x)
    hit = lambda x: F.exists(F.array(*[F.lit(m.lower() if ignore_case else m) for m in markers]), lambda m: F.contains(fold(x), m))
    return F.filter(lines(code), hit)


def json_object(c: Column) -> Column:
    """The JSON object of a reply: the whole text once a code fence is off, else from the first { to the last }; null where neither is JSON. A second value behind the first is passed over."""
    bare = strip(F.regexp_replace(strip(F.regexp_replace(strip(c), r"(?i)^```(?:json)?", "")), r"```$", ""))
    inner = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    valid = lambda x: F.try_parse_json(x).isNotNull()
    whole = ~bare.startswith("{") | bare.endswith("}")
    return F.when(whole & valid(bare), bare).when(valid(inner), inner)
