"""Secret scan with DataFrame functions only: fixed patterns and a randomness test battery.

Fixed patterns give the base spans: assignments to a secret's name, access keys
and long hex strings. The battery adds spans of kind ``random``: every run of 16
or more letters, digits, ``+/_-`` (and up to two ``=`` behind it) is tried against
"drawn evenly from its encoding", with or without a digit or a letter. The encoding
is the smallest of hex, base 32, base 36, base 62 and base 64 that holds the run.

Four p-values are combined by Fisher's rule: chi-squared over the alphabet's
symbols, chi-squared over its classes (digits, small, capital, marks), the runs
test about the middle of the alphabet, and the correlation of neighbours. Benjamini
and Hochberg's rule, applied to each band of lengths apart, then says which runs
are not random, with at most ``rate`` of them wrong; a short run needs stronger
evidence than a long one only as its own band demands. What is left is reported,
unless it lies within a base span.

The p-values of a band are counted on a fixed grid, so the driver gets at most
bands times cells rows. No row is exchanged but those counts.

Null and empty texts have no spans. Rows are treated one by one, so repeated rows
give repeated results and null ids stay null. Offsets are code points, ends
exclusive. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.llm.common import written

# The patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

LEAST_RUN = 16
#: The same matches as a run of any length with a length test behind it, found without trying the short ones.
ACCESS_LONG = rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"
HEX_LONG = rf"[0-9a-f]{{{LEAST_HEX},}}"
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}"
#: Lower ends of the bands of lengths.
BANDS = (16, 20, 24, 32, 48, 96)
RATE = 0.05
#: Cells of the grid per power of ten, and the smallest p-value told apart.
CELLS, SMALLEST = 64, 16

_SPANS = "array<struct<start:int,kind_no:int,kind:string,stop:int>>"


def _found(text: str, pattern: str, kind: int, keep: str = "true") -> Column:
    """Spans of ``pattern`` in the column ``text``: matches, and the lengths of what lies between them."""
    p = _quoted(pattern)
    return F.expr(
        f"""CASE WHEN {text} RLIKE {p} THEN aggregate(
          {_zipped(text, p, 2 if "value" in keep else 0)},
          named_struct('at', 0, 'out', CAST(array() AS {_SPANS})),
          (acc, x) -> named_struct(
            'at', acc.at + length(x.gap) + coalesce(length(x.hit), 0),
            'out', CASE WHEN x.hit IS NOT NULL AND {keep} THEN concat(acc.out, array(named_struct(
                'start', acc.at + length(x.gap), 'kind_no', {kind}, 'kind', '{KINDS[kind]}',
                'stop', acc.at + length(x.gap) + length(x.hit)))) ELSE acc.out END),
          acc -> acc.out)
        ELSE CAST(array() AS {_SPANS}) END"""
    )


def _zipped(text: str, pattern: str, group: int) -> str:
    """``gap, hit, value`` structs: the text before each match, the match and its group; a last gap has no hit."""
    pairs = (
        f"zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), "
        "(g, h) -> named_struct('gap', g, 'hit', h))"
    )
    return (
        f"zip_with({pairs}, regexp_extract_all({text}, {pattern}, {group}), "
        "(m, v) -> named_struct('gap', m.gap, 'hit', m.hit, 'value', v))"
    )


def _quoted(pattern: str) -> str:
    """A pattern as a raw SQL literal; a quote in it is written as its code."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def base_spans(text: str) -> Column:
    """All base spans in order of start, then kind as listed."""
    return F.array_sort(
        F.concat(
            _found(text, ASSIGN, 0, f"length(x.value) >= {LEAST_ASSIGNED}"),
            _found(text, ACCESS_LONG, 1),
            _found(text, HEX_LONG, 2),
        )
    )


def _upper_tail(z: str) -> str:
    """P(N > z) of the standard normal, by the five-term formula; never below the smallest told apart."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = (
        f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    )
    tail = f"(exp(-{z} * {z} / 2) / 2.5066282746310002 * {poly})"
    return f"greatest(1e-{SMALLEST}D, CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def with_tests(runs: Column) -> tuple[Column, Callable[[str], str]]:
    """Statistics of each of an array of ``start, stop, run`` structs, and SQL for minus the log of the joint p-value."""
    step = lambda array, make: F.transform(array, lambda x: make(x))

    def told(x: Column) -> Column:
        core = F.regexp_replace(x["run"], "=+$", "")
        size = (
            F.when(core.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16)
            .when(core.rlike("^[A-Z2-7]+$"), 32)
            .when(core.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36)
            .when(core.rlike("^[0-9A-Za-z]+$"), 62)
            .otherwise(64)
        )
        codes = F.transform(F.regexp_extract_all(core, F.lit("."), F.lit(0)), F.ascii)
        return F.struct(
            x["start"].alias("start"),
            x["stop"].alias("stop"),
            F.length(core).alias("n"),
            size.alias("k"),
            codes.alias("c"),
        )

    def valued(x: Column) -> Column:
        def value(c: Column) -> Column:
            digit = F.when(x["k"] == 32, c - 50 + 26).otherwise(c - 48)
            capital = F.when(x["k"] == 32, c - 65).when(x["k"] >= 62, c - 65 + 36).otherwise(c - 65 + 10)
            mark = F.when(c.isin(43, 45), 62).otherwise(63)
            return F.when(c < 48, mark).when(c == 95, 63).when(c < 58, digit).when(c < 91, capital).otherwise(c - 97 + 10)

        # The slash lies between the marks and the digits in the code table: below 48 as they are.
        count = lambda test: F.size(F.filter(x["c"], test)).cast("double")
        return F.struct(
            x["start"].alias("start"),
            x["stop"].alias("stop"),
            x["n"].cast("double").alias("n"),
            x["k"].cast("double").alias("k"),
            F.transform(x["c"], lambda c: value(c).cast("double")).alias("v"),
            F.aggregate(
                F.array_distinct(x["c"]),
                F.lit(0.0),
                lambda acc, d: acc + F.pow(F.size(F.filter(x["c"], lambda c: c == d)).cast("double"), 2),
            ).alias("squares"),
            count(lambda c: c.between(48, 57)).alias("digits"),
            count(lambda c: c.between(65, 90)).alias("capitals"),
            count(lambda c: c.between(97, 122)).alias("smalls"),
        )

    def summed(x: Column) -> Column:
        n, k, v = x["n"], x["k"], x["v"]
        high = F.transform(v, lambda a: (a >= k / 2).cast("int"))
        mean = F.aggregate(v, F.lit(0.0), lambda acc, a: acc + a) / n
        spread = F.aggregate(v, F.lit(0.0), lambda acc, a: acc + (a - mean) * (a - mean))
        neighbours = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: (a - mean) * (b - mean))
        turns = F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda a, b: (a != b).cast("int"))
        total = lambda array: F.aggregate(array, F.lit(0.0), lambda acc, a: acc + a)
        letters = x["capitals"] + x["smalls"]
        one_case = k < 62

        def cell(seen: Column, share: Column) -> Column:
            return F.when(share > 0, F.pow(seen - n * share, 2) / (n * share)).otherwise(0.0)

        digit_share = F.when(k == 16, 10 / 16).when(k == 32, 6 / 32).otherwise(10 / k)
        letter_share = F.when(one_case, 1 - digit_share).otherwise(26 / k)
        mark_share = F.when(k == 64, F.lit(2 / 64)).otherwise(0.0)
        classes = (
            cell(x["digits"], digit_share)
            + F.when(one_case, cell(letters, letter_share)).otherwise(
                cell(x["capitals"], letter_share) + cell(x["smalls"], letter_share)
            )
            + cell(n - x["digits"] - letters, mark_share)
        )
        return F.struct(
            x["start"].alias("start"),
            x["stop"].alias("stop"),
            n.alias("n"),
            k.alias("k"),
            (k / n * x["squares"] - n).alias("symbols"),
            classes.alias("classes"),
            F.when(one_case, 1.0).when(k == 62, 2.0).otherwise(3.0).alias("free"),
            total(F.transform(high, lambda a: a.cast("double"))).alias("highs"),
            (total(F.transform(turns, lambda a: a.cast("double"))) + 1).alias("runs"),
            F.when(spread > 0, total(neighbours) / spread).otherwise(1.0).alias("r"),
        )

    def combined(x: str) -> str:
        lows = f"({x}.n - {x}.highs)"
        mixed = f"(2 * {x}.highs * {lows})"
        variance = f"({mixed} * ({mixed} - {x}.n) / ({x}.n * {x}.n * ({x}.n - 1)))"
        z_symbols = f"(({x}.symbols - ({x}.k - 1)) / sqrt(2 * ({x}.k - 1) * (1 - 1 / {x}.n)))"
        # Cube-root rule for chi-squared with few degrees of freedom.
        z_classes = f"((pow({x}.classes / {x}.free, 1D / 3) - (1 - 2 / (9 * {x}.free))) / sqrt(2 / (9 * {x}.free)))"
        z_runs = f"CASE WHEN {variance} > 0 THEN abs({x}.runs - {mixed} / {x}.n - 1) / sqrt({variance}) ELSE sqrt({x}.n) END"
        z_pairs = f"(abs({x}.r + 1 / {x}.n) * sqrt({x}.n))"
        z = f"""transform(array(
            named_struct('z', CAST({z_symbols} AS DOUBLE), 'sides', 1D), named_struct('z', CAST({z_classes} AS DOUBLE), 'sides', 1D),
            named_struct('z', CAST({z_runs} AS DOUBLE), 'sides', 2D), named_struct('z', CAST({z_pairs} AS DOUBLE), 'sides', 2D)),
            t -> ln(least(1D, t.sides * {_upper_tail("t.z")})))"""
        return f"aggregate({z}, 0D, (acc, l) -> acc - l)"

    tested = step(step(step(runs, told), valued), summed)
    return tested, combined


def band_of(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} >= {low} THEN {low}" for low in reversed(BANDS)) + " END"


def candidates(text: str) -> Column:
    """``start, stop, run`` of each run."""
    p = _quoted(RUN)
    return F.expr(
        f"""CASE WHEN {text} RLIKE {p} THEN filter(aggregate(
          {_zipped(text, p, 0)},
          named_struct('at', 0, 'out', CAST(array() AS array<struct<start:int,stop:int,run:string>>)),
          (acc, x) -> named_struct(
            'at', acc.at + length(x.gap) + coalesce(length(x.hit), 0),
            'out', CASE WHEN x.hit IS NOT NULL THEN concat(acc.out, array(named_struct(
                'start', acc.at + length(x.gap), 'stop', acc.at + length(x.gap) + length(x.hit), 'run', x.hit)))
                ELSE acc.out END),
          acc -> acc.out), x -> true)
        ELSE CAST(array() AS array<struct<start:int,stop:int,run:string>>) END"""
    )


def tested_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, base, tried``: base spans, and ``start, stop, band, p`` of each run that was tried."""
    base = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    found = base.select("doc_id", base_spans("text").alias("base"), candidates("text").alias("runs"))
    tested, combined = with_tests(F.col("runs"))
    # Fisher: twice the sum has 8 degrees of freedom, whose tail has a closed form.
    halves = found.select("doc_id", "base", tested.alias("tested")).select(
        "doc_id",
        "base",
        F.expr(
            f"transform(tested, x -> named_struct('start', x.start, 'stop', x.stop, 'n', x.n, 'h', {combined('x')}))"
        ).alias("tested"),
    )
    tail = f"greatest(1e-{SMALLEST}D, exp(-x.h) * (1 + x.h + x.h * x.h / 2 + x.h * x.h * x.h / 6))"
    return halves.select(
        "doc_id",
        "base",
        F.expr(
            f"transform(tested, x -> named_struct('start', x.start, 'stop', x.stop, 'band', {band_of('x.n')}, "
            f"'cell', CAST(floor(-log10(least(1D, {tail})) * {CELLS}) AS INT)))"
        ).alias("tried"),
    )


def thresholds(tried: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per band, the smallest cell whose runs are called not random.

    A p-value counts as the upper edge of its cell, which only makes the rule
    stricter. Bands without such a cell are left out.
    """
    cells = tried.select(F.explode("tried").alias("x")).groupBy("x.band", "x.cell").count()
    band = Window.partitionBy("band")
    up_to = band.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("smaller", F.sum("count").over(up_to)).withColumn("all", F.sum("count").over(band))
    edge = F.pow(F.lit(10.0), -F.col("cell") / F.lit(float(CELLS)))
    passing = ranked.filter(edge <= rate * F.col("smaller") / F.col("all"))
    return {r["band"]: r["cell"] for r in passing.groupBy("band").agg(F.min("cell").alias("cell")).collect()}


def scan(docs: DataFrame, rate: float = RATE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, base, spans``: arrays of ``start, kind_no, kind, stop`` for each row of ``docs``."""
    tried = written(tested_documents(docs, id_column, text_column), "secret-runs")
    limits = thresholds(tried, rate)
    not_random = " OR ".join(f"(x.band = {b} AND x.cell >= {c})" for b, c in sorted(limits.items())) or "false"
    extra = F.expr(
        f"""transform(filter(tried, x -> NOT ({not_random})
              AND NOT exists(base, b -> b.start <= x.start AND b.stop >= x.stop)),
            x -> named_struct('start', x.start, 'kind_no', 3, 'kind', 'random', 'stop', x.stop))"""
    )
    return tried.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def joined_spans(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')")


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` (one row per ``doc_id``) with every span replaced by ``mark``; overlapping spans become one."""
    both = docs.join(found.select("doc_id", "spans"), "doc_id", "left")
    text = F.expr(
        f"""aggregate(coalesce(spans, CAST(array() AS {_SPANS})), named_struct('at', 0, 'out', ''),
          (acc, x) -> CASE WHEN x.stop <= acc.at THEN acc ELSE named_struct('at', x.stop, 'out',
            concat(acc.out, substring(text, acc.at + 1, greatest(0, x.start - acc.at)),
                   CASE WHEN x.start < acc.at THEN '' ELSE '{mark}' END)) END,
          acc -> concat(acc.out, substring(text, acc.at + 1)))"""
    )
    return both.withColumn("text", text).drop("spans")
