"""Secret scans (8), DataFrame functions only: pattern kinds plus a battery of randomness tests.

Three pattern kinds (``assign``, ``access``, ``hex``) give the base spans. The
battery looks at every run of 20 or more characters of ``A-Za-z0-9+/=_-``,
infers its encoding from the characters it uses, and tests its symbol codes
against uniform random data: a chi-squared test over the encoding's alphabet, a
runs test about the alphabet's middle, and the lag-1 serial correlation. The
three p-values are combined (three times the smallest, two-sided each). A run
is *structured* when its p-value falls to a Benjamini-Hochberg discovery among
all runs of the corpus; p-values are weighted by length, since the tests have
little power on short runs. Runs that are not discoveries, and long enough for
their alphabet (80 bits), pass as random data and become spans of kind
``random``. Base spans are blanked before runs are looked for, so what a span
leaves of a run is tested as a run of its own (separators at its ends aside,
should it have no encoding with them).

Matches are walked in blocks of about the square root of their number, so a text
of very many matches costs little more than its length.

Positions are code points, end exclusive. Null and empty texts have no spans;
matches never overlap within a kind (leftmost first); rows are independent, so
ties and repeated rows repeat their result; an empty table gives no rows. Only
``doc_id`` and ``text`` are read for spans, other columns pass through where
stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern kinds (pattern, group whose length counts, least length), in their order.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
RUN = r"[A-Za-z0-9+/=_-]{20,}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Encodings in the order in which they are tried (name, characters that make it up, must also match, alphabet).
ENCODINGS = (
    ("decimal", r"^[0-9]+$", r"[0-9]", DIGITS),
    ("hex_lower", r"^[0-9a-f]+$", r"^(?=.*[0-9]).*[a-f]", DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", r"^(?=.*[0-9]).*[A-F]", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", r"^(?=.*[2-7]).*[A-Z]", UPPER + "234567"),
    ("upper36", r"^[A-Z0-9]+$", r"^(?=.*[0-9]).*[A-Z]", DIGITS + UPPER),
    ("lower36", r"^[a-z0-9]+$", r"^(?=.*[0-9]).*[a-z]", DIGITS + LOWER),
    ("base62", r"^[A-Za-z0-9]+$", r"^(?=.*[0-9])(?=.*[A-Z]).*[a-z]", DIGITS + UPPER + LOWER),
    ("base64", r"^[A-Za-z0-9+/]+$", r"^(?=.*[0-9])(?=.*[A-Z]).*[a-z]", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", r"^(?=.*[0-9])(?=.*[A-Z]).*[a-z]", UPPER + LOWER + DIGITS + "-_"),
)
LEAST_BITS = 80.0
FDR = 0.05
BINS_PER_DECADE, DECADES = 100, 30
MASK = "[SECRET]"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _in_blocks(items: Column, reach, walk) -> Column:
    """The arrays ``walk(block, at, to)`` of consecutive blocks of ``items``, as one array.

    A block begins ``at`` what ``reach(block, at)`` gave for the block before, the first one at 0, and reaches ``to``. An array grows by
    copying, so a walk over one block costs its square, and all of them about the power 1.5 of the number of items."""
    state = "struct<at:int,starts:array<int>>"

    def blocks(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(xs), size)
        return F.transform(firsts, lambda k: F.slice(xs, k, size))

    def walked(bs: Column) -> Column:
        def step(acc: Column, block: Column) -> Column:
            to = reach(block, acc["at"])
            return F.struct(to.alias("at"), F.concat(acc["starts"], F.array(to)).alias("starts")).cast(state)

        begin = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("starts")).cast(state)
        return _bound(F.aggregate(bs, begin, step, lambda acc: acc["starts"]), lambda starts: F.flatten(
            F.transform(bs, lambda block, k: walk(block, F.get(starts, k), F.get(starts, k + 1)))))

    return _bound(items, lambda xs: F.when(F.size(xs) > 0, _bound(blocks(xs), walked)))


def _with_positions(text: Column, pattern: str, hits: Column, values: Column, kind: int) -> Column:
    """(start, kind, end, value) of every match, from the lengths of the matches and of the gaps between them."""
    gaps = F.split(text, pattern, -1)
    row = "struct<start:int,kind:int,end:int,value:string>"
    zipped = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.arrays_zip(hits.alias("hit"), values.alias("value")),
                        lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h["hit"]).alias("long"), h["value"].alias("value")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["long"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["long"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out")).cast(f"struct<at:int,out:array<{row}>>")

    def walk(block: Column, at: Column, to: Column) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast(f"array<{row}>").alias("out")).cast(f"struct<at:int,out:array<{row}>>")
        return F.aggregate(block, begin, step, lambda acc: acc["out"])

    walked = _in_blocks(zipped, lambda block, at: F.aggregate(block, at, lambda n, x: n + x["gap"] + x["long"]), walk)
    return F.when(F.size(hits) > 0, walked).otherwise(F.array().cast(f"array<{row}>"))


def _at_least(least: int):
    return lambda s: F.length(s["value"]) >= least


def with_base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base`` (array of start, kind, end; kind is the index in KINDS) sorted by start, then kind. Needs a column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("*", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_hit{i}") for i, (p, _, _) in enumerate(KINDS.values())))
    parts = []
    for i, (pattern, group, least) in enumerate(KINDS.values()):
        hits = F.col(f"_hit{i}")
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        found = _with_positions(text, pattern, hits, values, i)
        parts.append(F.filter(found, _at_least(least)))
    spans = F.transform(F.concat(*parts), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return out.withColumn("base", F.array_sort(spans.cast(_SPAN))).drop(*(f"_hit{i}" for i in range(len(KINDS))))


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal for |z| (rational approximation of erfc, relative error below 2e-7)."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + x / 2)
    # Coefficients of the Chebyshev fit of erfc.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    total = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        total = F.lit(c) + t * total
    return t * F.exp(-x * x + total)


def _blanks(n: Column) -> Column:
    return F.repeat(F.lit(" "), n)


def with_runs(docs: DataFrame) -> DataFrame:
    """Adds ``runs``: (start, end, n, p, weight) of each tested run of a known encoding outside the base spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blanked = docs.withColumn("_free", masked_text(text, F.col("base"), _blanks, _blanks))
    out = blanked.select("*", F.regexp_extract_all("_free", F.lit(RUN), F.lit(0)).alias("_run"))
    free = _with_positions(F.col("_free"), RUN, F.col("_run"), F.col("_run"), len(KINDS))

    def encoding(value: Column) -> Column:
        letter = None
        for _, all_of, some, alphabet in ENCODINGS:
            test = value.rlike(all_of) & value.rlike(some)
            letter = F.when(test, F.lit(alphabet)) if letter is None else letter.when(test, F.lit(alphabet))
        return letter

    known = F.transform(free, lambda s: F.struct(s["start"], s["end"], F.regexp_replace(s["value"], "=+$", "").alias("value")))
    known = F.transform(known, lambda s: F.struct(s["start"], s["end"], F.when(
        (F.size("base") > 0) & encoding(s["value"]).isNull(), F.regexp_replace(s["value"], "^[/+=_-]+|[/+_-]+$", "")).otherwise(s["value"]).alias("value")))
    known = F.transform(known, lambda s: F.struct(s["start"], s["end"], s["value"], encoding(s["value"]).alias("alphabet")))
    known = F.filter(known, lambda s: s["alphabet"].isNotNull())
    known = F.transform(known, lambda s: F.struct(
        s["start"], s["end"], F.length(s["value"]).cast("double").alias("n"), F.length(s["alphabet"]).cast("double").alias("a"),
        F.transform(F.split(s["value"], ""), lambda c: (F.call_function("position", c, s["alphabet"]) - 1).cast("double")).alias("codes"),
        F.aggregate(F.transform(F.split(s["alphabet"], ""), lambda c: F.pow(F.length(s["value"]) - F.length(F.replace(s["value"], c, F.lit(""))), F.lit(2.0))),
                    F.lit(0.0), lambda x, y: x + y).alias("squares")))
    known = F.transform(known, lambda s: F.struct(
        s["start"], s["end"], s["n"], s["a"], s["squares"],
        F.transform(s["codes"], lambda c: c - (s["a"] - 1) / 2).alias("dev"),
        F.size(F.filter(s["codes"], lambda c: c * 2 < s["a"])).cast("double").alias("low")))
    known = F.transform(known, lambda s: F.struct(
        s["start"], s["end"], s["n"], s["a"], s["squares"], s["low"],
        F.aggregate(F.transform(s["dev"], lambda d: d * d), F.lit(0.0), lambda x, y: x + y).alias("var"),
        F.zip_with(F.slice(s["dev"], 1, F.size(s["dev"]) - 1), F.slice(s["dev"], 2, F.size(s["dev"]) - 1),
                   lambda x, y: F.struct((x * y).alias("xy"), F.when((x < 0) != (y < 0), 1.0).otherwise(0.0).alias("turn"))).alias("pairs")))
    known = F.transform(known, lambda s: F.struct(
        s["start"], s["end"], s["n"], s["a"], s["squares"], s["low"], s["var"],
        F.aggregate(s["pairs"], F.lit(0.0), lambda x, y: x + y["xy"]).alias("serial"),
        F.aggregate(s["pairs"], F.lit(1.0), lambda x, y: x + y["turn"]).alias("turns")))

    def tests(s: Column) -> Column:
        n, df, high = s["n"], s["a"] - 1, s["n"] - s["low"]
        chi = s["squares"] * s["a"] / n - n
        spread = F.lit(2.0) / (df * 9)
        chi_z = (F.cbrt(chi / df) - (F.lit(1.0) - spread)) / F.sqrt(spread)  # Wilson-Hilferty
        both = s["low"] * high * 2
        runs_var = both * (both - n) / (n * n * (n - 1))
        runs_z = F.when(runs_var > 0, (s["turns"] - both / n - 1) / F.sqrt(runs_var)).otherwise(F.sqrt(n))  # all on one side
        serial_z = F.when(s["var"] > 0, s["serial"] / s["var"] * F.sqrt(n)).otherwise(F.sqrt(n))
        p = F.least(F.lit(1.0), F.least(_normal_tail(chi_z), _normal_tail(runs_z), _normal_tail(serial_z)) * 3)
        return F.struct(s["start"], s["end"], n, p.alias("p"), (n / 40).alias("weight"), (n * F.log2(s["a"])).alias("bits"))

    return out.withColumn("runs", F.transform(known, tests)).drop("_run", "_free")


def _bin(run: Column) -> Column:
    """Weighted p-values on a fixed logarithmic grid, rounded up to the next grid value."""
    q = F.greatest(run["p"] / run["weight"], F.lit(10.0 ** -DECADES))
    return F.greatest(F.lit(0), F.floor(-F.log10(q) * BINS_PER_DECADE)).cast("int")


def structured_bin(with_run_column: DataFrame, fdr: float = FDR) -> int:
    """The least bin that Benjamini-Hochberg at level ``fdr`` calls structured, over the runs of all rows.

    Counts per bin are aggregated first; the cumulative count runs over the
    grid, at most 3,001 rows. Without a discovery it is a bin beyond the grid.
    """
    counts = (with_run_column.select(F.explode(F.transform("runs", _bin)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")))
    table = {r["bin"]: r["n"] for r in counts.collect()}  # one row per grid value
    total, above, best = sum(table.values()), 0, DECADES * BINS_PER_DECADE + 1
    for b in sorted(table, reverse=True):
        above += table[b]
        if 10.0 ** (-b / BINS_PER_DECADE) * total <= fdr * above:
            best = b
    return best


def with_random_spans(docs: DataFrame, limit_bin: int) -> DataFrame:
    """``runs`` replaced by ``random``: spans of the runs that pass as random data."""
    kept = F.filter("runs", lambda r: (_bin(r) < limit_bin) & (r["bits"] >= LEAST_BITS))
    spans = F.transform(kept, lambda r: F.struct(r["start"], F.lit(len(KINDS)).alias("kind"), r["end"]))
    return docs.withColumn("random", spans.cast(_SPAN)).drop("runs")


def spans_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "random")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked_text(text: Column, spans: Column, mask=lambda n: F.lit(MASK), more_mask=lambda n: F.lit("")) -> Column:
    """The text with each span replaced by ``mask(length)``, and what a span adds to one that it overlaps by ``more_mask(length)``.

    Spans are sorted by start. A block of spans works on its own part of the text, since finding a character costs the way to it."""
    state = "struct<at:int,out:array<string>>"

    def reach(block: Column, at: Column) -> Column:
        return F.aggregate(block, at, lambda n, s: F.greatest(n, s["end"]))

    def walk(block: Column, begin: Column, to: Column) -> Column:
        def pieces(part: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                gap = F.substring(part, acc["at"] - begin + 1, s["start"] - acc["at"])
                apart = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, mask(s["end"] - s["start"]))).alias("out"))
                more = F.greatest(s["end"] - acc["at"], F.lit(0))
                longer = F.struct((acc["at"] + more).alias("at"), F.concat(acc["out"], F.array(more_mask(more))).alias("out"))
                return F.when(s["start"] >= acc["at"], apart.cast(state)).otherwise(longer.cast(state))

            first = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
            return F.aggregate(block, first, step, lambda acc: acc["out"])

        return _bound(F.substring(text, begin + 1, to - begin), pieces)

    end = F.aggregate(spans, F.lit(0), lambda n, s: F.greatest(n, s["end"]))
    joined = F.concat(F.array_join(_in_blocks(spans, reach, walk), ""), F.substring(text, end + 1, F.length(text)))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def masked_rows(docs: DataFrame) -> DataFrame:
    """All rows and columns with the spans masked in ``text`` (and ``n_chars``, where there is one, brought up to date).

    The scan runs twice over the texts, once for the corpus-wide decision and
    once for the masks, so that no text has to be shuffled.
    """
    own = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))  # no clash with working columns
    rows = docs.select(own.alias("_row"), F.col("text").alias("text"))
    limit = structured_bin(with_runs(with_base_spans(rows.select("text"))))
    spans = with_random_spans(with_runs(with_base_spans(rows)), limit)
    masked = spans.select("_row", masked_text(F.col("text"), F.array_sort(F.concat("base", "random"))).alias("_text"))
    out = []
    for i, c in enumerate(docs.columns):
        value = F.col(f"_row.c{i}")
        if c == "text":
            value = F.col("_text")
        elif c == "n_chars":
            value = F.when(F.col("_text").isNull(), value).otherwise(F.length("_text")).cast(docs.schema[i].dataType)
        out.append(value.alias(c))
    return masked.select(*out)
