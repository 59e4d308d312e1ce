"""Text column helpers, all native Spark expressions (no Python per row)."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour / the standard library it calls).
# Value mapping of the categorical standardiser:
YES_TOKENS = ["yes", "y", "true", "1"]
NO_TOKENS = ["no", "n", "false", "0"]
NULL_TOKENS = ["nan", "none", "null", ""]
# Python's textwrap word splitter (public stdlib pattern), written for Java regex with Unicode
# classes: a whitespace run, an em-dash between words, or a word with an optional hyphen break.
_WS = r"[\t\n\x0B\f\r ]"
_NWS = r"[^\t\n\x0B\f\r ]"
_WP = r"""[\w!"'&.,?]"""
_LT = r"[^\d\W]"
WORDSEP = (
    "(?U)("
    + _WS + "+"
    + "|(?<=" + _WP + ")-{2,}(?=\\w)"
    + "|" + _NWS + "+?(?:"
    + "-(?:(?<=" + _LT + "{2}-)|(?<=" + _LT + "-" + _LT + "-))(?=" + _LT + "-?" + _LT + ")"
    + "|(?=" + _WS + "|\\z)"
    + "|(?<=" + _WP + ")(?=-{2,}\\w)"
    + "))"
)
TAB_SIZE = 8
# ---------------------------------------------------------------------------
# Python's whitespace (what ``str.strip`` removes and ``\s`` keeps), derived by rule.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
_WS_CLASS = "".join("\\x{%x}" % ord(ch) for ch in WHITESPACE)


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: removes every kind of leading/trailing whitespace (Spark ``trim``
    only removes spaces); a character-set trim, no regular expression."""
    return F.btrim(c, F.lit(WHITESPACE))


def normalise_text(c: Column) -> Column:
    """strip -> lower -> delete characters outside word/space; text ``nan`` becomes null."""
    out = F.regexp_replace(F.lower(strip_ws(c)), "[^\\p{L}\\p{N}_" + _WS_CLASS + "]", "")
    return F.when(out == "nan", F.lit(None).cast("string")).otherwise(out)


def standardise_values(c: Column) -> Column:
    """Fold yes/no spellings to ``yes``/``no`` and null spellings to null."""
    return (F.when(c.isin(*YES_TOKENS), F.lit("yes"))
            .when(c.isin(*NO_TOKENS), F.lit("no"))
            .when(c.isin(*NULL_TOKENS), F.lit(None).cast("string"))
            .otherwise(c))


def expand_tabs(c: Column, tabsize: int = TAB_SIZE) -> Column:
    """``str.expandtabs``: each tab pads to the next multiple of ``tabsize``; the column count
    restarts after a newline or carriage return. Only rows holding a tab pay for the fold."""
    lines = F.split(c, r"(?<=[\n\r])")

    def expand_line(line: Column) -> Column:
        segs = F.split(line, "\t", -1)
        return F.aggregate(
            F.slice(segs, 2, 1 << 30), F.element_at(segs, 1),
            lambda acc, seg: F.concat(
                acc, F.repeat(F.lit(" "), F.lit(tabsize) - F.length(acc) % tabsize), seg))

    return F.when(F.instr(c, "\t") > 0, F.array_join(F.transform(lines, expand_line), "")) \
        .otherwise(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: inside a lambda, an expression of the row would be
    evaluated again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wrap_chunks(c: Column, width: int = 500) -> Column:
    """Greedy word wrap into lines of at most ``width`` characters, equal to Python's
    ``textwrap.wrap(text, width)`` with default options: ``array<string>``, expressions only.

    Texts without hyphens break at blanks alone, and one regular expression finds the lines: the
    longest run up to ``width`` that ends with a word. Texts with hyphens take ``wrap_at_marks``. Those
    with a longer run of non-blanks than a line, or a leading blank, take ``wrap_by_tokens``."""
    w = int(width)
    run = f"[^ ].{{0,{w - 2}}}[^ ]|[^ ]" if w > 1 else "[^ ]"

    def wrapped(text: Column) -> Column:
        rare = F.startswith(text, F.lit(" ")) | text.rlike(rf"(?:\A| )[^ ]{{{w + 1}}}")
        hyphens = (F.instr(text, "-") > 0) | (F.instr(text, "—") > 0)
        return (F.when(rare, _by_tokens(text, w)).when(hyphens, wrap_at_marks(text, w))
                .otherwise(F.regexp_extract_all(text, F.lit(rf"(?s)\G *({run})(?= |\z)"), 1)))

    return let(F.translate(expand_tabs(c), "\n\x0b\x0c\r", "    "), wrapped)


def wrap_at_marks(text: Column, width: int) -> Column:
    """``wrap_chunks`` for blank-normalised texts without leading blanks or tokens longer than a line.

    The standard library's word splitter gives the tokens, once a text. Their lengths make a string of
    marks as long as the text, in which ``h`` stands for each last character of a token, where a line
    may end; the longest match up to ``width`` marks is a line, and the next search starts behind it.
    The number of tokens that a line's marks hold cuts the lines out of the token array."""
    body = rf"(?:[^ ].{{0,{width - 2}}})?h" if width > 1 else "h"

    def lines(tokens: Column) -> Column:
        marks = F.array_join(F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit(" ")), t).otherwise(
            F.concat(F.repeat(F.lit("x"), F.length(t) - 1), F.lit("h")))), "")
        held = F.transform(F.regexp_extract_all(marks, F.lit(rf"\G *{body}"), 0), lambda m: F.regexp_count(m, F.lit("h| +")))

        def cut(counts: Column) -> Column:
            start = F.aggregate(counts, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
            return let(start, lambda at: F.zip_with(F.slice(at, F.lit(1), F.size(counts)), counts,
                                                    lambda s, n: F.ltrim(F.array_join(F.slice(tokens, s + 1, n), ""))))

        return let(held, cut)

    return let(F.filter(F.regexp_extract_all(text, F.lit(WORDSEP), 1), lambda t: F.length(t) > 0), lines)


def wrap_by_tokens(c: Column, width: int = 500) -> Column:
    """``wrap_chunks`` for any text: the standard library's word splitter as a pattern, and a fold
    over the tokens.

    Every line is a contiguous slice of the whitespace-normalised text, so one ``aggregate`` over
    the token lengths folds integer positions only (no string is built per token); the lines are
    cut out once at the end. Blank tokens enter the fold as negative lengths. A word longer than the
    width is cut where a line is full, or after its last hyphen before that."""
    return let(F.translate(expand_tabs(c), "\n\x0b\x0c\r", "    "), lambda text: _by_tokens(text, int(width)))


def _by_tokens(text: Column, w: int) -> Column:
    tokens = F.filter(F.regexp_extract_all(text, F.lit(WORDSEP), 1), lambda t: F.length(t) > 0)
    lens = F.transform(tokens, lambda t: F.when(F.substring(t, 1, 1) == " ", -F.length(t)).otherwise(F.length(t)))
    span = "array<struct<s:int,e:int>>"

    def seg(s: Column, e: Column) -> Column:
        return F.struct(s.alias("s"), e.alias("e"))

    def state(out, cs, ce, we, cb, p):
        return F.struct(out.alias("out"), cs.alias("cs"), ce.alias("ce"), we.alias("we"), cb.alias("cb"),
                        p.alias("p"))

    def step(acc: Column, v: Column) -> Column:
        out, cs, ce, we, cb, p = (acc[k] for k in ("out", "cs", "ce", "we", "cb", "p"))
        b = v < 0
        n = F.abs(v)
        end = p + n
        empty = ce == cs
        start = F.when(empty, p).otherwise(cs)          # where the current line starts
        cut_n = F.floor((end - start - 1) / w).cast("int")  # full slices when a run overflows

        def cut(a: Column, _: Column) -> Column:
            """One more line of an overlong word: a = (lines, line start, place in the word)."""
            room = F.lit(w) - (a["q"] - a["s"])
            part = F.substring(text, a["q"] + 1, room)
            hyphen = room - F.instr(F.reverse(part), "-") + 1  # characters up to the last hyphen
            by_hyphen = (F.instr(part, "-") > 0) & (hyphen > 1) & F.substring(part, F.lit(1), hyphen - 1).rlike("[^-]")
            to = a["q"] + F.when(by_hyphen, hyphen).otherwise(room)
            more = end - a["s"] > w
            return F.when(more, F.struct(F.concat(a["l"], F.array(seg(a["s"], to))).alias("l"), to.alias("s"), to.alias("q"))).otherwise(a)

        cuts = F.when(n > w, F.aggregate(F.sequence(F.lit(0), n), F.struct(F.array().cast(span).alias("l"), start.alias("s"), p.alias("q")), cut))
        flushed = F.when(cb, out).otherwise(F.concat(out, F.array(seg(cs, we))))
        return (
            # blank run at the start of a later line: dropped
            F.when(empty & b & (F.size(out) > 0), state(out, cs, ce, we, cb, end))
            # fits on the current line
            .when((ce - cs) + n <= w, state(out, start, end, F.when(~b, end).when(empty, p).otherwise(we),
                                            (cb | empty) & b, end))
            # blank run that does not fit: end the line, drop the run
            .when(b & ~cb, state(flushed, end, end, end, F.lit(True), end))
            .when(b & (F.size(out) > 0), state(out, end, end, end, F.lit(True), end))
            .when(b, state(out, start + cut_n * w, end, start + cut_n * w, F.lit(True), end))
            # word longer than the width: cut into full lines, the rest stays open
            .when(n > w, state(F.concat(out, cuts["l"]), cuts["s"], end, end, F.lit(False), end))
            # word that does not fit: end the line, start a new one with the word
            .otherwise(state(flushed, p, end, end, F.lit(False), end))
        )

    zero = F.lit(0)
    init = state(F.array().cast(span), zero, zero, zero, F.lit(True), zero)
    spans = F.aggregate(lens, init, step,
                        lambda acc: F.when(acc["cb"] | (acc["ce"] == acc["cs"]), acc["out"])
                        .otherwise(F.concat(acc["out"], F.array(seg(acc["cs"], acc["we"])))))
    return F.transform(spans, lambda r: F.substring(text, r["s"] + 1, r["e"] - r["s"]))


# Code points of character references: the names that end in ``;`` (public table of the standard
# library), and the numbers 128-159, which browsers read as Windows-1252.
_NAMES: dict[str, dict[str, str]] = {}  # by the first two letters: a map is searched from its front
for _name, _text in html.entities.html5.items():
    if _name.endswith(";"):
        _NAMES.setdefault("&" + _name[:2], {})["&" + _name] = _text
_CP1252 = json.dumps({str(i): bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)})


def unescape_entities(c: Column) -> Column:
    """Every character reference decoded once, named or by number; unknown ones stay as they are."""
    names = F.from_json(F.lit(json.dumps(_NAMES)), "map<string,map<string,string>>")
    old = F.from_json(F.lit(_CP1252), "map<string,string>")

    def by_number(n: Column) -> Column:
        valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(valid, F.coalesce(F.try_element_at(old, n.cast("string")), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))) \
            .otherwise(F.lit("\ufffd"))

    def piece(x: Column) -> Column:
        ref = F.regexp_extract(x, r"^&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});", 0)
        body = F.substring(ref, F.lit(3), F.length(ref) - 3)
        hexa = F.conv(F.substring(ref, F.lit(4), F.length(ref) - 4), 16, 10).cast("bigint")
        char = F.when(ref.rlike("^&#[0-9]"), by_number(body.try_cast("bigint"))) \
            .when(ref.rlike("^&#"), by_number(hexa)).when(ref != "", F.try_element_at(F.try_element_at(names, F.substring(ref, 1, 3)), ref))
        return F.coalesce(F.concat(char, F.substring(x, F.length(ref) + 1, F.length(x))), x)

    return F.when(F.instr(c, "&") == 0, c).otherwise(F.array_join(F.transform(F.split(c, "(?=&)"), piece), ""))
