"""Authorship signals of a document, as column expressions over its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import clean, let, lines

#: Weights of the signals.
WEIGHTS = {"perplexity": 0.18, "burstiness": 0.14, "stylometry": 0.16, "patterns": 0.20, "entropy": 0.12, "vocabulary": 0.08, "whitespace": 0.06, "docstrings": 0.06}


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def runs_entropy(items: Column) -> Column:
    """Shannon entropy in bits of the values of an array; sorted once, runs counted, so n log n."""

    def of(s: Column) -> Column:
        edge = lambda x, i: (i == 0) | (F.coalesce(F.get(s, i - 1) != x, F.lit(True)))
        starts = F.filter(F.transform(s, lambda x, i: F.when(edge(x, i), i)), lambda i: i.isNotNull())
        n = F.size(s)
        counts = let(starts, lambda p: F.transform(p, lambda a, k: (F.coalesce(F.get(p, k + 1), n) - a).cast("double")))
        return F.aggregate(counts, F.lit(0.0), lambda t, c: t - c / n * F.log2(c / n))

    return let(F.sort_array(items), lambda s: F.when(F.size(s) == 0, 0.0).otherwise(of(s)))


def perplexity(toks: Column) -> Column:
    """Low entropy of tokens and of their pairs reads as generated."""
    pairs = lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return let(toks, lambda w: F.when(F.size(w) < 10, 0.0).otherwise(unit(1 - (0.4 * runs_entropy(w) + 0.6 * runs_entropy(pairs(w))) / 5)))


def burstiness(text: Column) -> Column:
    """Even lines read as generated: 1 - CV / 1.2 of indent / 4 + length / 80."""
    body = F.filter(F.transform(lines(text), lambda x: F.rtrim(x)), lambda x: x != "")
    cost = lambda xs: F.transform(xs, lambda x: (F.length(x) - F.length(F.ltrim(x))) / 4 + F.length(F.ltrim(x)) / 80)

    def of(c: Column) -> Column:
        n = F.size(c)
        mean = F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / n
        spread = let(mean, lambda m: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n) / m)
        return F.when(n < 5, 0.0).when(mean < 1e-9, 0.5).otherwise(unit(1 - spread / 1.2))

    return let(cost(body), of)


def vocabulary(toks: Column) -> Column:
    """Few distinct tokens in windows of 50 (step 25), and few tokens that occur once, read as generated."""

    def of(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(F.sequence(F.lit(0), n - 51, F.lit(25)), lambda i: F.size(F.array_distinct(F.slice(w, i + 1, F.lit(50)))) / 50)
        mean = let(windows, lambda t: F.aggregate(t, F.lit(0.0), lambda a, x: a + x) / F.size(t))
        distinct = F.size(F.array_distinct(w))
        ttr = F.when(n > 50, mean).otherwise(distinct / n)
        alone = let(F.sort_array(w), lambda s: F.size(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) != x, F.lit(True)) & F.coalesce(F.get(s, i + 1) != x, F.lit(True)))))
        return F.when(n < 20, 0.0).otherwise(unit(0.6 * unit(1 - ttr / 0.7) + 0.4 * unit(1 - alone / distinct)))

    return let(toks, of)


def whitespace(text: Column) -> Column:
    """Runs of blank lines of one length read as generated; fewer than three runs say nothing."""
    marks = F.array_join(F.transform(lines(text), lambda x: F.when(F.trim(x) == "", F.lit("0")).otherwise(F.lit("1"))), "")
    runs = F.transform(F.filter(F.split(marks, "1+"), lambda r: r != ""), F.length)

    def of(r: Column) -> Column:
        kinds = F.size(F.array_distinct(r))
        return F.when(F.size(r) < 3, 0.0).when(kinds <= 1, 1.0).otherwise(unit(1 - runs_entropy(r) / F.log2(kinds)))

    return let(runs, of)


#: Names that say little, and the patterns of generated comments, names and structure.
GENERIC = ["result", "output", "data", "value", "temp", "final", "new", "processed", "formatted", "cleaned"]
PATTERNS = [
    r"(?i)#\s*(Let's|Let us|We can|We will|We need to|We first|We then)\b",
    r"(?i)#\s*(Here we|Here is|Here's|This function|This method|This class)\b",
    r"(?i)#\s*(Note:|Note that|NOTE:|TODO:|FIXME:|Step \d+:)",
    r"(?i)#\s*(Initialize|Create|Define|Compute|Calculate|Return|Check|Handle)\b",
    r"(?m)#\s*[A-Z][a-z]+(?: [a-z]+){2,}\s*$",
    r"#\s*-{3,}",
    r'(?i)"""[\s\S]{0,40}(?:Initialize|Create|Define|Compute|Calculate|Return|Check|Handle)',
    r"\b(result|output|data|value|temp|final|new|processed|formatted|cleaned)\b",
    r"\b(process_|handle_|compute_|calculate_|generate_|validate_|parse_)\w+",
    r"\b(input_data|output_data|result_list|data_list|item_list|temp_list)\b",
    r"\b(is_valid|is_empty|is_none|has_error|has_value)\b",
    r"(?i)if\s+\w+\s+is\s+None\s*:",
    r"(?i)raise\s+ValueError\s*\(f?['\"]",
    r"(?i)raise\s+TypeError\s*\(f?['\"]",
    r"(?i)logging\.(debug|info|warning|error)\s*\(f?['\"]",
    r"return\s+\[\s*\w+\s+for\s+\w+\s+in\s+\w+\s*\]",
    r"Optional\[",
    r"Union\[",
    r"Dict\[str,",
    r"List\[str\]",
    r"-> (?:None|bool|int|str|float|List|Dict|Optional)\s*:",
]
#: What is counted for a style.
ASSIGNED, LETTER, HINT = r"\b[a-zA-Z_]\w*\s*=", r"(?<![\p{L}\p{N}_])[a-z](?![\p{L}\p{N}_])", r"->\s*(?:None|bool|int|str|float|List|Dict|Optional|Union)"
DOCSTRING, FUNCTION, TRY = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''", r"(?m)^[^\S\n]*def\s+\w+", r"(?m)^[^\S\n]*try\s*:"
COMPREHENSION, LOOP = r"\[.*for.*in.*\]", r"(?m)^[^\S\n]*for\s+\w+\s+in\s+"
#: COMPREHENSION for a backtracking matcher, in linear time: a line has one match at most, from its first bracket on, and
#: what stood first stays.
LINEAR_COMPREHENSION = r"(?dm)^[^\[\n]*+\[(?>[^\n]*?for)(?>[^\n]*?in)[^\n]*\]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(clean(text), F.lit(pattern))


def patterns(text: Column) -> Column:
    """Matches of the pattern library for each line, times five."""
    found = sum((count(text, p) for p in PATTERNS[1:]), count(text, PATTERNS[0]))
    return unit(5 * found / F.size(lines(text)))


def stylometry(text: Column) -> Column:
    """Generic names, documentation, type hints, no one-letter names, handled errors and comprehensions read as generated."""
    of = lambda a, b: count(text, a) / F.greatest(count(text, b), F.lit(1))
    generic = r"\b(?:" + "|".join(GENERIC) + r")\b"
    documented = count(text, DOCSTRING) / F.size(lines(text))
    return unit(of(generic, ASSIGNED) * 0.25 + documented * 0.20 + of(HINT, FUNCTION) * 0.20 + (1 - of(LETTER, ASSIGNED)) * 0.15 + of(TRY, FUNCTION) * 0.10 + F.least(F.lit(1.0), of(LINEAR_COMPREHENSION, LOOP)) * 0.10)


def docstrings(text: Column) -> Column:
    """Docstrings for each function, or for every ten lines where there is none."""
    n, functions = count(text, DOCSTRING), count(text, FUNCTION)
    return F.when(functions > 0, unit(n / F.greatest(functions, F.lit(1)) * 0.75)).otherwise(F.least(F.lit(1.0), n / F.greatest(F.lit(1.0), F.size(lines(text)) / 10)))


def evenness(items: Column) -> Column:
    """1 less the entropy of an array's values over its greatest; 1 where they are all the same."""

    def of(r: Column) -> Column:
        kinds = F.size(F.array_distinct(r))
        return F.when(kinds <= 1, 1.0).otherwise(unit(1 - runs_entropy(r) / F.log2(kinds)))

    return let(items, of)


def indentation(text: Column) -> Column:
    """Even indents read as generated: what structure says of a text that is not parsed."""
    body = F.filter(lines(text), lambda x: F.regexp_like(x, F.lit(r"\S")))
    levels = F.transform(body, lambda x: F.floor((F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))) / 4))
    return let(levels, lambda v: F.when(F.size(v) == 0, 0.0).otherwise(evenness(v) * 0.6))


def structure(nodes: Column, text: Column) -> Column:
    """Even kinds of syntax nodes read as generated; a source that does not parse (null) is read by its indents."""
    return F.when(nodes.isNull(), indentation(text)).when(F.size(nodes) == 0, 0.0).otherwise(evenness(nodes) * 0.8)


#: Below these sizes a signal is trusted 0, 0.3 and 0.6; other forms stand beside them.
TRUST = {"perplexity": ("tokens", 10, 50, 100), "burstiness": ("filled", 5, 10, 20), "stylometry": ("lines", 20, 50, 100), "vocabulary": ("tokens", 20, 50, 100), "whitespace": ("lines", 10, 20, 30), "docstrings": ("functions", 1, 3, 5)}


def trust(sizes: dict[str, Column]) -> dict[str, Column]:
    """How far each signal of a text that is not parsed can be trusted, by its tokens, lines, filled lines and functions."""
    steps = {k: F.when(sizes[of] < a, 0.0).when(sizes[of] < b, 0.3).when(sizes[of] < c, 0.6).otherwise(1.0) for k, (of, a, b, c) in TRUST.items()}
    return steps | {"patterns": F.when(sizes["lines"] < 5, 0.5).when(sizes["lines"] < 20, 0.7).otherwise(1.0), "entropy": F.when(sizes["filled"] < 10, 0.3).otherwise(0.6)}


def styles(text: Column) -> dict[str, Column]:
    """Line length, indent, comments, blanks: what a style vector holds."""
    ls = lines(text)
    n = F.size(ls)
    total = lambda f: F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + f(x))
    return {
        "mean_line": total(lambda x: F.length(x).cast("long")) / n,
        "mean_indent": total(lambda x: (F.length(x) - F.length(F.ltrim(x))).cast("long")) / n,
        "comment_ratio": total(lambda x: F.when(F.regexp_like(x, F.lit(r"^ *(#|//)")), 1).otherwise(0).cast("long")) / n,
        "blank_ratio": total(lambda x: F.when(F.trim(x) == "", 1).otherwise(0).cast("long")) / n,
    }
