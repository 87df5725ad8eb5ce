"""Scalar expressions: cleaning, ratios, probabilities, angles, bits, paths.  All are plain Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_double(c) -> Column:
    """Number of a text; what can't be read, NaN and empty text are null."""
    v = _col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def half_even(c, digits: int = 6) -> Column:
    """Rounding half to even, the one used for every reported figure."""
    return F.bround(_col(c), digits)


def asymmetry(left, right) -> Column:
    """(left - right) / (left + right + eps); null if either side is unknown."""
    left, right = _col(left), _col(right)
    return (left - right) / (left + right + F.lit(EPS))


def contrast(left, right, scale=None) -> dict[str, Column]:
    """A side contrast and its size: (left - right) over a scale (a deviation), else over the sum of both sizes; null if a side is unknown."""
    left, right = _col(left), _col(right)
    d = (left - right) / ((_col(scale) if scale is not None else F.abs(left) + F.abs(right)) + F.lit(EPS))
    return {"signed": d, "size": F.abs(d)}


def pretty_name(c, names: dict[str, str], prefixes: dict[str, str]) -> Column:
    """A feature's name for readers: as listed, else its prefix replaced, underscores as spaces."""
    out, rest = None, F.replace(_col(c), F.lit("_"), F.lit(" "))
    for key, text in names.items():
        out = F.when(_col(c) == key, F.lit(text)) if out is None else out.when(_col(c) == key, F.lit(text))
    for key, text in prefixes.items():
        hit, named = _col(c).startswith(key), F.concat(F.lit(text), F.replace(F.substr(_col(c), F.lit(len(key) + 1)), F.lit("_"), F.lit(" ")))
        out = F.when(hit, named) if out is None else out.when(hit, named)
    return rest if out is None else out.otherwise(rest)


def to_inches(pixels, inch) -> Column:
    """A length in inches by the inches of a pixel; null for an unknown or senseless scale."""
    return F.when(_col(inch) > 0, _col(pixels) * _col(inch))


def to_square_inches(pixels, inch) -> Column:
    return F.when(_col(inch) > 0, _col(pixels) * _col(inch) * _col(inch))


def diameter_mm(area, inch) -> Column:
    """Diameter in millimetres of the disc with that area in pixels."""
    return F.when(_col(inch) > 0, 2 * F.sqrt(_col(area) / F.pi()) * _col(inch) * 25.4)


def signal_value(c) -> Column:
    """The number of a signal; what can't be read counts as 0."""
    return F.coalesce(_col(c).try_cast("int"), F.lit(0))


def guarded_ratio(part, whole, above: float = 1.0) -> Column:
    """part / whole where the whole is known and over ``above``, else null."""
    whole = _col(whole)
    return F.when(whole > above, _col(part) / whole)


def quotient(verified, raw) -> Column:
    """verified / (raw + eps)."""
    return _col(verified) / (_col(raw) + F.lit(EPS))


def logit(p) -> Column:
    """ln(p / (1 - p)) with p held within eps of 0 and 1."""
    held = F.least(F.greatest(_col(p), F.lit(EPS)), F.lit(1 - EPS))
    return F.when(_col(p).isNotNull(), F.ln(held / (1 - held)))


def sigmoid(z) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(z)))


def renormalise(probabilities, fallback=None) -> Column:
    """An array of probabilities divided by its sum; ``fallback`` (else itself) if the sum is 0."""
    p = _col(probabilities)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(p if fallback is None else _col(fallback))


def lerp(x, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Linear between two points, constant outside; null for an unknown x."""
    u = F.least(F.greatest((_col(x) - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))
    return F.when(_col(x).isNotNull(), y0 + u * (y1 - y0))


def fold_axis(degrees) -> Column:
    """Angle of an undirected axis in (-90, 90]."""
    a = F.pmod(_col(degrees), F.lit(180.0))
    return F.when(a > 90, a - 180).otherwise(a)


def shortest_turn(degrees) -> Column:
    """Angle of the shortest rotation, in (-180, 180]."""
    a = F.pmod(_col(degrees), F.lit(360.0))
    return F.when(a > 180, a - 360).otherwise(a)


def basename(path) -> Column:
    """Last part of a path with either separator."""
    return F.regexp_extract(_col(path), r"[^/\\]+$", 0)


def stem(path) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def folder(path) -> Column:
    """What precedes the last part, without its separator."""
    return F.regexp_replace(_col(path), r"[/\\]?[^/\\]*$", "")


def bits_of(code, n: int = 4) -> Column:
    """The n low bits of a code, lowest first."""
    return F.array(*[F.shiftright(_col(code), k).bitwiseAND(F.lit(1)).cast("int") for k in range(n)])


def code_of(bits) -> Column:
    """Number of an array of bits, lowest first."""
    pairs = F.transform(_col(bits), lambda b, k: b.cast("long") * F.pow(F.lit(2.0), k.cast("double")).cast("long"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)


def bit_text(code, n: int = 4) -> Column:
    """A code in binary, n digits."""
    return F.lpad(F.bin(_col(code).cast("long")), n, "0")


def code_to_bin(code, bins: int = 9, review: int = 9) -> Column:
    """A code from 1 to ``bins`` is its bin, any other (or none) goes to review."""
    code = _col(code)
    return F.when(code.between(1, bins), code).otherwise(F.lit(review)).cast("int")


def decimal_comma(c) -> Column:
    """Text of a number with a comma for its point."""
    return F.replace(_col(c).cast("string"), F.lit("."), F.lit(","))


def number_in(text, pattern: str) -> Column:
    """The first group of a pattern in a text, as a number."""
    return clean_double(F.regexp_extract(_col(text), pattern, 1))


def arc_places(n: int, radius: float, centre: float = 90.0, step: float = 20.0) -> Column:
    """(x, y) of n places on an arc around its centre angle, evenly spaced."""
    first = centre - step * (n - 1) / 2
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((radius * F.cos(F.radians(first + step * k))).alias("x"), (radius * F.sin(F.radians(first + step * k))).alias("y")))
