"""Column functions over text: normalisation, tokens, n-grams, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keywords whose overlap is scored.
KEYWORDS = [
    "and", "as", "assert", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global",
    "if", "import", "in", "is", "lambda", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
]
#: Tokens of control flow and the class each stands for.
FLOW = {"for": "LOOP", "while": "LOOP", "do": "LOOP", "if": "COND", "switch": "COND", "else": "ALT", "case": "ALT", "default": "ALT", "elif": "ALT"}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def clean(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(clean(text)), F.lit("[a-z0-9]+"), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(clean(text), "\n")


def strip_comments(text: Column) -> Column:
    """Removes ``#`` and ``//`` comments, then ``/* */`` ones; strings that hold these marks are cut as well."""
    out = F.regexp_replace(clean(text), "(?m)#.*?$", "")
    out = F.regexp_replace(out, "(?m)//.*?$", "")
    return F.regexp_replace(out, r"(?s)/\*.*?\*/", "")


def ngrams(items: Column, n: int, sep: str = " ") -> Column:
    """Windows of n items, joined; an input of 1 to n - 1 items is one window, an empty one has none."""

    def windows(x: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat_ws(sep, *[F.get(x, i + k) for k in range(n)]))  # a slice would copy x
        return F.when(F.size(x) >= n, every).when(F.size(x) > 0, F.array(F.array_join(x, sep))).otherwise(F.array().cast("array<string>"))

    return let(items, windows)


def hashes(items: Column) -> Column:
    return F.transform(items, lambda x: F.xxhash64(x))


def shingles(toks: Column, n: int) -> Column:
    """64-bit hashes of the windows of n tokens, as ``ngrams`` cuts them; no string is built."""

    def windows(h: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(F.size(h) >= n, every).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes(toks), windows)


def char_ngrams(text: Column, n: int) -> Column:
    """Windows of n characters. The characters are an array first: a position in a string is found from its start."""
    return ngrams(F.filter(F.split(text, ""), lambda c: c != ""), n, "")


def ngram_text(text: Column) -> Column:
    """Text as character n-grams see it: numbers are N, quoted strings S, white space one blank."""
    out = F.regexp_replace(clean(text), '"[^"]*"', "S")
    out = F.regexp_replace(out, "[0-9]+", "N")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def flow_tokens(toks: Column) -> Column:
    """Control-flow classes and numbers, in order."""
    names = F.create_map(*[F.lit(x) for kv in FLOW.items() for x in kv])
    mapped = F.transform(toks, lambda t: F.coalesce(names[t], F.when(F.regexp_like(t, F.lit("^[0-9]+$")), F.lit("NUM"))))
    return F.filter(mapped, lambda t: t.isNotNull())


def winnow(hashes: Column, window: int, rightmost: bool = False) -> Column:
    """Positions (from 1) of the least hash of every window, leftmost or rightmost of equal ones, each once.

    Fewer hashes than a window keep all of them.
    """

    def least(h: Column) -> Column:
        sign = -1 if rightmost else 1
        at = lambda i: F.array_min(F.array(*[F.struct(F.get(h, i + k).alias("h"), F.lit(sign * k).alias("o"), (i + k + 1).alias("p")) for k in range(window)]))["p"]
        every = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - window), at))
        return F.when(F.size(h) >= window, every).when(F.size(h) > 0, F.sequence(F.lit(1), F.size(h))).otherwise(F.array().cast("array<int>"))

    return let(hashes, least)


#: Tokens that nearly every program has.
BOILERPLATE = ["import", "from", "sys", "os", "def", "main", "if", "__name__", "__main__"]


def without_boilerplate(toks: Column) -> Column:
    """The tokens less those that nearly every program has; all of them if nothing else is left."""
    return let(F.filter(toks, lambda t: ~t.isin(BOILERPLATE)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(toks))


def normalized_names(toks: Column) -> Column:
    """Names by the place of their first occurrence among the names, numbers as one token, keywords as they are."""
    number, word = F.lit(r"^[0-9]+$"), F.lit(r"^[A-Za-z_]\w*$")

    def of(w: Column) -> Column:
        names = F.array_distinct(F.filter(w, lambda t: F.regexp_like(t, word) & ~t.isin(KEYWORDS)))
        return let(names, lambda n: F.transform(w, lambda t: F.when(t.isin(KEYWORDS), t).when(F.regexp_like(t, number), F.lit("__NUM__")).when(F.array_position(n, t) > 0, F.concat(F.lit("__VAR"), (F.array_position(n, t) - 1).cast("string"), F.lit("__"))).otherwise(t)))

    return let(toks, of)


def variable_kinds(toks: Column) -> Column:
    """What kind of name each token is: a loop counter, the object itself, a dunder, a constant, private, or any other."""
    kind = lambda t: (
        F.when(t.isin("i", "j", "k"), "LOOP_VAR").when(t.isin("self", "this"), "SELF").when(F.regexp_like(t, F.lit("^__.*__$")), "DUNDER")
        .when(F.regexp_like(t, F.lit("^[A-Z][A-Z0-9_]+$")), "CONST").when(F.startswith(t, F.lit("_")), "PRIVATE_VAR").otherwise("VAR")
    )
    return F.transform(toks, kind)


def line_windows(text: Column, size: int = 25, step: int = 20) -> Column:
    """Windows of lines that overlap; a short text is one window."""
    return let(lines(text), lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - (size - step) - 1, F.lit(0)), F.lit(step)), lambda i: F.array_join(F.slice(x, i + 1, F.lit(size)), "\n")))
