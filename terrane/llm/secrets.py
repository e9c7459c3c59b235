"""Secrets in whole texts: fixed patterns, and long tokens that pass a battery of randomness tests.

A token is tested against the alphabet of its encoding, the smallest of hex, base 32, base 62
and base 64 that holds all its characters:

* chi-squared of the symbol counts, uniform under randomness;
* runs above and below the middle of the alphabet;
* serial correlation of neighbouring symbols.

Each gives a p-value that is about uniform for key material and close to 0 for ordinary text;
Fisher's method combines them. Which tokens are kept is decided by a false-discovery estimate
for each encoding and length class: the tokens above 1/2 tell how many random ones there are
(theirs are spread evenly), so for each threshold t the share of others above t is known, and
the lowest t with a share of at most `rate` is taken. Short tokens, where text is harder to
tell from keys, so get a stricter threshold than long ones. A class with too few tokens above t
to refuse it is judged with its neighbouring length classes, then its whole encoding; where
these are too few as well, t must be at least LEAST_P.

Everything is column functions. Only counts per encoding, length class and step are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base patterns and the least lengths of their matches.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGNED_LENGTH = 6
KINDS = ("assign", "access", "hex", "random")

# Candidates of the battery: 20 characters or more with an upper or lower case letter and a digit.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

RATE = 0.1  # accepted share of ordinary tokens among those kept
STEPS = 200  # of a p-value
LONGEST_CLASS = 12  # length classes are powers of two; the last one holds all longer tokens
ENOUGH = 20  # tokens above a threshold that are enough to refuse it
NEIGHBOURS = (1, 2)  # length classes to either side whose counts are merged with a class that has fewer
LEAST_P = 0.01  # lowest p kept where even the whole encoding has fewer

# Standard alphabets.
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    ("hex", _DIGITS + "abcdef", r"^[0-9a-f]+=*$"),
    ("hex_upper", _DIGITS + "ABCDEF", r"^[0-9A-F]+=*$"),
    ("base32", _UPPER + "234567", r"^[A-Z2-7]+=*$"),
    ("base62", _DIGITS + _UPPER + _UPPER.lower(), r"^[0-9A-Za-z]+=*$"),
    ("base64", _DIGITS + _UPPER + _UPPER.lower() + "+/", r"^[0-9A-Za-z+/]+=*$"),
    ("base64url", _DIGITS + _UPPER + _UPPER.lower() + "-_", r"^[0-9A-Za-z_-]+=*$"),
    ("mixed", _DIGITS + _UPPER + _UPPER.lower() + "+/-_", r"."),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, by a rational approximation good to 1e-7."""

    def tail(v: Column) -> Column:
        t = v["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.struct(v["z"].alias("z"), (F.exp(-v["z"] * v["z"] / 2) * poly * 0.3989422804014327).alias("tail"))

    start = let(z, lambda v: F.struct(v.alias("z"), (F.lit(1.0) / (F.abs(v) * 0.2316419 + 1.0)).alias("t")))
    return let(let(start, tail), lambda v: F.greatest(F.when(v["z"] >= 0, v["tail"]).otherwise(1 - v["tail"]), F.lit(1e-300)))


def battery(token: Column) -> Column:
    """Struct (encoding, length, p): the combined p-value of a token under randomness."""
    encoding, alphabet = F.lit(ALPHABETS[-1][0]), F.lit(ALPHABETS[-1][1])
    for name, letters, pattern in reversed(ALPHABETS[:-1]):
        encoding = F.when(token.rlike(pattern), F.lit(name)).otherwise(encoding)
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def placed(s: Column) -> Column:
        places = F.transform(F.split(s["core"], ""), lambda c: (F.instr(s["alphabet"], c) - 1).cast("double"))
        n, k = F.length(s["core"]).cast("double"), F.length(s["alphabet"]).cast("double")
        return s.withField("places", places).withField("n", n).withField("k", k)

    def sums(s: Column) -> Column:
        squares = F.transform(F.split(s["alphabet"], ""), lambda c: F.pow(s["n"] - F.length(F.replace(s["core"], c, F.lit(""))), F.lit(2.0)))
        halves = F.transform(s["places"], lambda p: (p >= s["k"] / 2).cast("double"))
        return F.struct(
            s["encoding"].alias("encoding"), s["n"].alias("n"), s["k"].alias("k"), s["places"].alias("places"), halves.alias("halves"),
            (total(squares) * s["k"] / s["n"] - s["n"]).alias("chi"), total(halves).alias("high"), (total(s["places"]) / s["n"]).alias("mean"),
        )

    def scores(s: Column) -> Column:
        n, k, mean, high, halves, places = (s[x] for x in ("n", "k", "mean", "high", "halves", "places"))
        # Wilson and Hilferty: the cube root of chi-squared over its degrees is nearly normal.
        spread = F.lit(2.0) / ((k - 1) * 9)
        z_chi = (F.pow(F.greatest(s["chi"], F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        later = F.sequence(F.lit(1), n.cast("int") - 1)
        runs = 1 + total(F.transform(later, lambda i: F.abs(halves[i] - halves[i - 1])))
        pairs = high * (n - high) * 2
        variance = pairs * (pairs - n) / (n * n * (n - 1))
        z_runs = F.when(variance > 0, F.abs(runs - pairs / n - 1) / F.sqrt(variance)).otherwise(F.lit(6.0))
        power = total(F.transform(places, lambda p: (p - mean) * (p - mean)))
        cross = total(F.transform(later, lambda i: (places[i] - mean) * (places[i - 1] - mean)))
        serial = let(F.struct(cross.alias("cross"), power.alias("power")), lambda c: F.when(c["power"] > 0, F.abs(c["cross"] / c["power"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(6.0)))
        logs = F.log(upper_tail(z_chi)) + F.log(F.least(upper_tail(z_runs) * 2, F.lit(1.0))) + F.log(F.least(upper_tail(serial) * 2, F.lit(1.0)))
        return F.struct(s["encoding"].alias("encoding"), n.cast("int").alias("length"), (-logs).alias("h"))

    def combined(s: Column) -> Column:
        # Fisher: twice h is chi-squared with six degrees, whose tail is a short sum.
        h = s["h"]
        return F.struct(s["encoding"].alias("encoding"), s["length"].alias("length"), F.least(F.exp(-h) * (1 + h + h * h / 2), F.lit(1.0)).alias("p"))

    start = F.struct(F.regexp_replace(token, "=+$", "").alias("core"), alphabet.alias("alphabet"), encoding.alias("encoding"))
    return let(let(let(let(start, placed), sums), scores), combined)


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, found) of all leftmost non-overlapping matches, in code points.

    The text between matches and the matches take turns, so their lengths give the places.
    `found` is the group asked for; matches where it is shorter than `least` are left out.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    between = F.split(text, pattern, -1)
    whole, inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        one = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["inner"].alias("found")))
        return F.struct(end.alias("at"), F.when(F.length(x["inner"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    turns = F.arrays_zip(between.alias("gap"), whole.alias("whole"), inner.alias("inner"))
    found = F.aggregate(F.filter(turns, lambda x: x["whole"].isNotNull()), first, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _scanned(docs: DataFrame, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    random = spans(F.col("_text"), TOKEN, "random")
    tested = F.transform(
        F.filter(random, lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]")),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), battery(s["found"]).alias("test")),
    )
    base = F.concat(spans(F.col("_text"), ASSIGN, "assign", 2, ASSIGNED_LENGTH), spans(F.col("_text"), ACCESS, "access"), spans(F.col("_text"), HEX, "hex"))
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    # The row travels as one struct, so that its column names meet no others.
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("_text"))
    return rows.withColumns({"_base": F.array_sort(plain), "_tested": tested})


def _length_class(test: Column) -> Column:
    return F.least(F.floor(F.log2(test["length"].cast("double"))).cast("int"), F.lit(LONGEST_CLASS))


def _key(test: Column) -> Column:
    return F.concat(test["encoding"], F.lit(":"), _length_class(test).cast("string"))


def thresholds(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """One row with the map `least`: from encoding and length class to the lowest p kept."""
    # Outer, so that the tokens are not computed a second time for a filter before it.
    tests = scanned.select(F.explode_outer("_tested.test").alias("test")).where("test IS NOT NULL")
    step = F.least(F.floor(F.col("test")["p"] * STEPS).cast("int"), F.lit(STEPS - 1))
    counts = tests.groupBy(F.col("test")["encoding"].alias("encoding"), _length_class(F.col("test")).alias("length"), step.alias("step")).count()
    # At most 7 encodings times 13 length classes times STEPS rows from here on. Steps without tokens count too.
    classes = counts.groupBy("encoding", "length").agg(F.map_from_entries(F.collect_list(F.struct("step", "count"))).alias("seen"))
    filled = classes.select("encoding", "length", "seen", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    filled = filled.withColumn("n0", F.coalesce(F.try_element_at("seen", F.col("step")), F.lit(0)))
    near = Window.partitionBy("encoding", "step").orderBy("length")
    # Ordinary tokens of another encoding say nothing about this one, so the merging ends with the encoding.
    merged = [near.rangeBetween(-w, w) for w in NEIGHBOURS] + [Window.partitionBy("encoding", "step")]
    filled = filled.withColumns({f"n{i}": F.sum("n0").over(w) for i, w in enumerate(merged, 1)})
    own = Window.partitionBy("encoding", "length")
    levels = range(len(merged) + 1)
    above = {f"above{i}": F.sum(f"n{i}").over(own.orderBy(F.desc("step"))) for i in levels}
    random = {f"random{i}": F.sum(F.when(F.col("step") >= STEPS // 2, F.col(f"n{i}")).otherwise(0)).over(own) * 2 for i in levels}
    fit = filled.withColumns(above | random).where(F.col("step") <= STEPS // 2)
    # Few tokens may let a threshold through, but only ENOUGH of them may refuse it; the rest is left to the next level.
    kept = F.col("step") >= math.ceil(LEAST_P * STEPS)
    for i in reversed(levels):
        count = F.col(f"above{i}")
        fits = (count > 0) & (count - F.col(f"random{i}") * (1 - F.col("step") / STEPS) <= count * rate)
        kept = F.when(fits, True).when(count >= ENOUGH, False).otherwise(kept)
    least = fit.where(kept).groupBy(F.concat_ws(":", "encoding", "length").alias("class")).agg((F.min("step") / STEPS).alias("least"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("class", "least"))).alias("least"))


def _found(docs: DataFrame, text_column: str, rate: float) -> DataFrame:
    scanned = _scanned(docs, text_column)
    least = thresholds(scanned, rate).scalar()
    random = F.filter("_tested", lambda s: F.coalesce(s["test"]["p"] >= F.col("_least")[_key(s["test"])], F.lit(False)))
    plain = F.transform(random, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    new = F.filter(plain, lambda s: ~F.exists("_base", lambda b: (b["start"] == s["start"]) & (b["end"] == s["end"])))
    return scanned.withColumn("_least", least).withColumn("_found", F.array_sort(F.concat("_base", new)))


def scan(docs: DataFrame, text_column: str = "text", rate: float = RATE) -> DataFrame:
    """`docs` with `base` and `found`, arrays of (start, kind, end) sorted by place, then kind.

    Kinds are numbered as in KINDS; `found` holds the base spans and those of the battery that
    are not equal to one of them. Null and empty texts have none. Every row is judged by itself,
    so repeated rows get equal results; an empty table gives an empty one. Columns of `docs`
    with the names of the new ones are left out.
    """
    own = [F.col(f"row.{c}").alias(c) for c in docs.columns if c not in ("base", "found")]
    return _found(docs, text_column, rate).select(*own, F.col("_base").alias("base"), F.col("_found").alias("found"))


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def masked(docs: DataFrame, text_column: str = "text", mask: str = "[secret]", rate: float = RATE) -> DataFrame:
    """`docs` with every span found replaced by `mask` and n_chars, if there, set anew.

    Overlapping spans become one mask. Null texts stay null.
    """
    text = F.col("_text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(piece, F.lit(mask))).alias("parts"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    hit = F.size("_found") > 0
    clean = _found(docs, text_column, rate).withColumn("_clean", F.when(hit, F.aggregate("_found", start, step, end)))
    columns = {c: F.col(f"row.{c}") for c in docs.columns}
    columns[text_column] = F.when(hit, F.col("_clean")).otherwise(columns[text_column])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(hit, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return clean.select(*[v.alias(c) for c, v in columns.items()])
