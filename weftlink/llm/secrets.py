"""Secret scans: fixed patterns, and a randomness test battery over token runs.

Native: only DataFrame expressions. A candidate is a run of 20 or more characters
of base-64 alphabets. Its encoding is inferred from its characters; under that
encoding's uniform distribution a chi-squared test, a runs test and a
serial-correlation test give a p-value each, and the least of the three one p-value
(Sidak): random tokens reach a level of it with probability 1 - level. Short natural
words reach it too. So each band of encoding and length gets its own level: the
lowest at which the estimated share of natural tokens among its discoveries is at
most ``FDR``. The estimate takes the rate at which plain lower-case words of that
length reach the level for that of all natural tokens; a band in which no level
serves has no discoveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns; of each match, the first group (or all) must have so many characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
BASE = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))
#: Where a pattern's short matches are dropped whole, a text without a long enough run needs no closer look.
_LIKELY = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

MIN_LENGTH = 20
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
FDR = 0.05
#: Levels of the p-value that a band can get, lowest first.
LEVELS = (0.03, 0.1, 0.3, 0.5)
#: A rational approximation of exp(x * x) * erfc(x) in 1 / (1 + ERFC_T * x), within 1.5e-7 (Abramowitz and Stegun 7.1.26).
ERFC_T = 0.3275911
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Encodings in the order they are tried, with their alphabets.
_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("digits", "^[0-9]+$", _DIG), ("hex", "^[0-9a-f]+$", _DIG + "abcdef"), ("HEX", "^[0-9A-F]+$", _DIG + "ABCDEF"), ("lower", "^[a-z]+$", _LOW), ("upper", "^[A-Z]+$", _UP),
    ("letters", "^[A-Za-z]+$", _UP + _LOW), ("upper36", "^[A-Z0-9]+$", _UP + _DIG), ("lower36", "^[a-z0-9]+$", _LOW + _DIG), ("base64", "", _UP + _LOW + _DIG + "+/"), ("base64url", "[-_]", _UP + _LOW + _DIG + "-_"),
)
_SPAN = "array<struct<s:int,e:int,m:string,v:string>>"


def located(text: Column, pattern: str, likely: str | None = None) -> Column:
    """Leftmost non-overlapping matches: start, end (code points, exclusive), match, first group.

    The matches and the pieces between them are zipped, then one pass adds up their lengths.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("v"))
    start = F.struct(F.lit(0).alias("p"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        s = acc["p"] + F.length(x["g"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(e.alias("p"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["v"].alias("v"))))).alias("out"))

    return F.when(text.rlike(likely or pattern), F.aggregate(parts, start, step)["out"]).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, kind>> of the base kinds, by start, then kind as listed."""
    kinds = []
    for k, (kind, pattern, least) in enumerate(BASE):
        long = F.filter(located(text, pattern, _LIKELY[kind]), _longer(least))
        kinds.append(F.transform(long, _as_kind(k, kind)))
    return F.array_sort(F.concat(*kinds))


def _longer(least: int):
    return lambda x: F.length(x["v"]) >= least


def _as_kind(k: int, kind: str):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"))


def _encoding(token: Column) -> Column:
    """struct<enc, letters> of the first encoding that the token fits."""
    *fit, (_, _, plain), (_, url, both) = ENCODINGS
    out = F.when(token.rlike(url), F.struct(F.lit("base64url").alias("enc"), F.lit(both).alias("a"))).otherwise(F.struct(F.lit("base64").alias("enc"), F.lit(plain).alias("a")))
    for name, pattern, letters in reversed(fit):
        out = F.when(token.rlike(pattern), F.struct(F.lit(name).alias("enc"), F.lit(letters).alias("a"))).otherwise(out)
    return out


def _p_values(scores: Column) -> Column:
    """array<double>: the p-values of an array of structs of a normal score z and its number of sides."""
    at = F.transform(scores, lambda x: F.struct(x["z"].alias("z"), x["sides"].alias("sides"), (1 / (1 + ERFC_T / 2**0.5 * F.abs(x["z"]))).alias("t")))

    def p(x):
        tail = F.lit(0.0)
        for c in reversed(ERFC):
            tail = (tail + c) * x["t"]
        return F.struct((tail * F.exp(-x["z"] * x["z"] / 2)).alias("both"), x["z"].alias("z"), x["sides"].alias("sides"))

    upper = lambda x: F.when(x["sides"] == 2, x["both"]).when(x["z"] > 0, x["both"] / 2).otherwise(1 - x["both"] / 2)
    return F.transform(F.transform(at, p), upper)


def battery(x: Column) -> Column:
    """struct<s, e, enc, band, p> of a candidate that has s, e, m (token) and t (its encoding)."""
    token, letters = x["m"], x["t"]["a"]
    n, k = F.length(token).cast("double"), F.length(letters).cast("double")
    chars = F.split(token, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    # Pearson's statistic has mean k - 1 and variance 2 (k - 1) (n - 1) / n: a scaled chi-squared, whose cube root is nearly normal.
    wide = 2 * (n - 1) / (9 * (k - 1) * n)
    chi = (F.pow(F.greatest(squares * k / n - n, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - 1 + wide) / F.sqrt(wide)
    # One pass over the characters: runs of the alphabet's halves, and products of neighbours' deviations.
    zero = F.struct(F.lit(-1.0).alias("x"), F.lit(0.0).alias("hi"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("prod"))
    mean = (k + 1) / 2

    def step(a, c):
        i = F.instr(letters, c).cast("double")
        up = i > k / 2
        first = a["x"] < 0
        return F.struct(
            i.alias("x"),
            (a["hi"] + up.cast("double")).alias("hi"),
            (a["runs"] + F.when(first | ((a["x"] > k / 2) != up), 1.0).otherwise(0.0)).alias("runs"),
            (a["prod"] + F.when(first, 0.0).otherwise((i - mean) * (a["x"] - mean))).alias("prod"),
        )

    def tests(a):
        hi, lo = a["hi"], n - a["hi"]
        expect = 2 * hi * lo / n + 1
        var = (expect - 1) * (expect - 2) / (n - 1)
        runs = F.when(var > 0, F.abs(a["runs"] - expect) / F.sqrt(var)).otherwise(99.0)
        serial = F.abs(a["prod"]) / ((k * k - 1) / 12 * F.sqrt(n - 1))
        return F.array(*[F.struct(z.alias("z"), F.lit(sides).alias("sides")) for z, sides in ((chi, 1), (runs, 2), (serial, 2))])

    least = F.array_min(_p_values(F.aggregate(chars, zero, step, tests)))
    p = 1 - F.pow(1 - least, F.lit(3.0))
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"]["enc"].alias("enc"), F.least(F.floor(n / 8).cast("int"), F.lit(32)).alias("band"), p.alias("p"))


def candidates(text: Column) -> Column:
    found = F.transform(located(text, CANDIDATE), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _encoding(x["m"]).alias("t")))
    return F.transform(found, battery)


def accepted_bands(docs: DataFrame, text: str = "text", fdr: float = FDR) -> list[tuple[str, int, float]]:
    """(encoding, length band, level): the lowest level at which the band's estimated false-discovery rate is at most fdr; few, whatever the input.

    Of N candidates in a band D reach a level; with r = 1 - level the rate of random ones
    and b that of natural ones of this length, (r N - D) / (r - b) are natural and b
    times as many of them reach it. One more natural token is counted, as the level is
    chosen after the fact; b is at least half a token's share. A level that natural
    words reach as often as random ones is refused.
    """
    reach = [F.sum((F.col("c.p") >= level).cast("long")).alias(f"d{i}") for i, level in enumerate(LEVELS)]
    found = docs.select(F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("c"))
    rows = found.groupBy("c.enc", "c.band").agg(F.count("*").alias("n"), *reach).collect()
    return sorted(
        (r["enc"], r["band"], level)
        for r in rows
        if (level := _level(r, [x for x in rows if x["enc"] == "lower"], fdr)) is not None
    )


def _level(row, natural, fdr: float) -> float | None:
    """The level of one band, given the counts of plain lower-case words by band."""
    for i, level in enumerate(LEVELS):
        d, n, r = row[f"d{i}"], row["n"], 1 - level
        rates = {x["band"]: (x[f"d{i}"] + 0.5) / (x["n"] + 1) for x in natural}
        # Longer words than any seen: the longest known band's rate, which is an upper bound, as power grows with length.
        b = rates.get(row["band"], min((v for k, v in rates.items() if k <= row["band"]), default=0.5))
        if d and b < r and (min(max(0.0, (r * n - d) / (r - b)), n) + 1) * b <= fdr * d:
            return level
    return None


def scan(docs: DataFrame, text: str = "text", bands: list[tuple[str, int, float]] | None = None) -> DataFrame:
    """docs with ``secrets``: array<struct<s, k, e, kind>> by start, then kind (assign, access, hex, random).

    Places count code points, ends are exclusive. A random span is added where it
    overlaps no base span. Null and empty texts have no spans; each input row is
    returned once.
    """
    bands = accepted_bands(docs, text) if bands is None else bands
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_base", base_spans(t))
    if bands:
        levels = F.create_map(*[F.lit(x) for enc, band, level in bands for x in (f"{enc}:{band}", level)])
        good = F.filter(candidates(t), lambda c: c["p"] >= F.element_at(levels, F.concat_ws(":", c["enc"], c["band"].cast("string"))))
        free = F.filter(good, lambda c: ~F.exists(F.col("_base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
        more = F.transform(free, _as_kind(len(BASE), "random"))
    else:
        more = F.filter(F.col("_base"), lambda b: F.lit(False))
    return out.withColumn("secrets", F.array_sort(F.concat(F.col("_base"), more))).drop("_base")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones as one, replaced by the mark."""
    zero = F.struct(F.lit(0).alias("p"), F.lit("").alias("out"))

    def step(a, x):
        inside = x["s"] < a["p"]
        gap = F.substring(text, a["p"] + 1, F.greatest(x["s"] - a["p"], F.lit(0)))
        return F.struct(F.greatest(a["p"], x["e"]).alias("p"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], gap, F.lit(mark))).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["p"] + 1, F.length(text))))).otherwise(text)
