"""Column-expression helpers shared by the operators (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: dict) -> Column:
    """A literal MAP column built from a small fixed dict (constant-folded by Catalyst)."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def lookup(c, mapping: dict) -> Column:
    """``mapping[c]``; unmapped or NULL keys give NULL."""
    return F.element_at(literal_map(mapping), col_or(c)) if mapping else F.lit(None)


def lookup_case(c, mapping: dict, default=None) -> Column:
    """Same lookup as a CASE chain: keeps literal types and needs no map allocation per row."""
    c = col_or(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def strip_ws(c) -> Column:
    """Python ``str.strip()``: removes all leading/trailing whitespace, not only blanks."""
    return F.regexp_replace(col_or(c), r"^\s+|\s+$", "")


def nan_to_null(c) -> Column:
    c = col_or(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def in_range(c, lo: float, hi: float) -> Column:
    """Inclusive range test where NULL counts as *outside* (never NULL itself)."""
    return F.coalesce(col_or(c).between(F.lit(lo), F.lit(hi)), F.lit(False))


def in_domain(c, values) -> Column:
    """Exact-match domain test where NULL counts as *outside* (never NULL itself)."""
    return F.coalesce(col_or(c).isin(list(values)), F.lit(False))


def _let(value: Column, use) -> Column:
    """``use(value)``, the value being computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _units(x: Column, places: int) -> Column:
    """|x| in units of 10 ** -places, rounded half-even on the exact binary value, as a long.

    |x| = m / 2 ** b with a whole number m below 2 ** 56, so |x| * 10 ** places is divided by a power of two in
    whole numbers (DECIMAL) and the remainder is compared with the half: nothing is rounded before.
    """
    def parts(a: Column) -> Column:
        b = F.when(a * 10.0 ** places < 0.25, F.lit(0)).otherwise(F.greatest(F.lit(0), 54 - F.floor(F.log2(a)).cast("int")))
        return _let(b, lambda b: F.struct(scaled(a, b).alias("scaled"), power(b).alias("power")))

    def scaled(a: Column, b: Column) -> Column:
        m = F.when(a * 10.0 ** places < 0.25, F.lit(0)).otherwise(a * F.pow(F.lit(2.0), b)).cast("bigint")
        return m.cast("decimal(19,0)") * F.lit(10 ** places).cast("decimal(10,0)")

    def power(b: Column) -> Column:
        two = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
        return (two(F.least(b, F.lit(40))).cast("decimal(19,0)") * two(b - F.least(b, F.lit(40))).cast("decimal(18,0)")).cast("decimal(38,0)")

    def nearest(s: Column) -> Column:
        whole = F.floor(F.try_divide(s["scaled"], s["power"])).cast("bigint")
        return _let(whole, lambda w: _let((s["scaled"] - w.cast("decimal(19,0)") * s["power"]).cast("decimal(38,0)") * 2, lambda rest: _let(
            # the quotient keeps few digits, so it may be one too many
            F.struct(F.when(rest < 0, w - 1).otherwise(w).alias("w"), F.when(rest < 0, rest + s["power"] * 2).otherwise(rest).alias("rest")),
            lambda t: t["w"] + ((t["rest"] > s["power"]) | ((t["rest"] == s["power"]) & (t["w"] % 2 == 1))).cast("bigint"))))

    return _let(F.abs(x), lambda a: _let(parts(a), nearest))


def _minus(x: Column) -> Column:
    return (x < 0) | (x.cast("string") == "-0.0")


def format_fixed(c, places: int, plus: bool = False) -> Column:
    """``%.<places>f`` (or ``%+.<places>f``) of a double below 2 ** 53 / 10 ** places, as C and Python print
    it: rounded half-even on the exact binary value (16.65 is 16.6499…, so 16.6). NULL stays NULL."""
    x = col_or(c).cast("double")
    sign = F.when(_minus(x), "-").otherwise("+" if plus else "")

    def digits(n: Column) -> Column:
        if not places:
            return n.cast("string")
        text = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(places + 1)), F.lit("0"))
        return _let(text, lambda t: F.concat(F.substr(t, F.lit(1), F.length(t) - places), F.lit("."), F.substr(t, F.length(t) - places + 1)))

    text = _let(_units(x, places), digits)
    odd = F.when(F.isnan(x), "+nan" if plus else "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf")))
    return F.coalesce(odd, F.concat(sign, text))


def round_exact(c, places: int) -> Column:
    """Python's ``round`` of a double: half-even on the exact binary value."""
    x = col_or(c).cast("double")
    n = _units(x, places).cast("double") / 10.0 ** places
    return F.when(_minus(x), -n).otherwise(n)


def round_half_even(c, places: int) -> Column:
    """``round`` of a numpy or pandas column: scaled, rounded to the nearest whole number (ties to the
    even one), scaled back, all in doubles."""
    return F.rint(col_or(c).cast("double") * 10.0 ** places) / 10.0 ** places


def rnd(c, places: int) -> Column:
    return F.round(col_or(c).cast("double"), places)


def round_columns(df: DataFrame, names, places: int, keep=()) -> DataFrame:
    """``keep`` and the doubles ``names`` rounded half-up. They are rounded as one array: two dozen roundings
    written out make generated code too long for the JVM to compile, which then interprets it."""
    each = F.transform(F.array(*[F.col(c).cast("double") for c in names]), lambda x: F.round(x, places))
    return df.select(*keep, each.alias("_rounded")).select(*keep, *[F.get("_rounded", F.lit(i)).alias(c) for i, c in enumerate(names)])


def pct(part, whole, places: int) -> Column:
    """``round(part / whole * 100, places)``, half-even; 0.0 when the whole is zero."""
    ratio = F.try_divide(col_or(part).cast("double"), col_or(whole).cast("double"))
    return F.coalesce(round_half_even(ratio * 100.0, places), F.lit(0.0))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 with NULL mapped to 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))
