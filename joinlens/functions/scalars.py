"""Scalar functions of the workload study, as Column expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantile of a two-sided interval at 99 %.
Z99 = 2.5758293035489004


def sha1_bucket(text: Column, n: int) -> Column:
    """The SHA-1 of a text, as a 160-bit integer, modulo n; folded eight hex digits at a time."""
    digest = F.sha1(text)
    folded: Column = F.lit(0).cast("long")
    for at in range(1, 41, 8):
        folded = F.pmod(folded * F.lit(2**32 % n) + F.conv(F.substring(digest, at, 8), 16, 10).cast("long"), F.lit(n))
    return folded


def min_max(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low), kept within 0 and 1; 0 where low = high."""
    share = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def log_norm(value: Column, low: float, high: float, base2: bool = False) -> Column:
    """Logarithm of value (1 at least), scaled from the log range low..high to 0..1."""
    log = F.log2 if base2 else F.ln
    return (log(F.greatest(value.cast("double"), F.lit(1.0))) - low) / (high - low)


def log_denorm(share: Column, low: float, high: float) -> Column:
    """The inverse of log_norm."""
    return F.exp(share * (high - low) + low)


def ngrams(text: Column, n: int) -> Column:
    """Character n-grams of a pattern without its percent signs."""
    bare = F.replace(text, F.lit("%"), F.lit(""))
    return F.when(F.length(bare) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - n + 1, F.lit(1))), lambda i: F.substr(bare, i, F.lit(n)))
    )


def has_digit(text: Column) -> Column:
    return text.rlike(r"\d")


def floored(value: Column) -> Column:
    return F.greatest(value.cast("double"), F.lit(1.0))


def signed_qerror(true: Column, estimate: Column) -> Column:
    """-true/estimate where the estimate is too low, else estimate/true; both floored at 1."""
    y, e = floored(true), floored(estimate)
    return F.when(y > e, -(y / e)).otherwise(e / y)


def qerror(true: Column, estimate: Column) -> Column:
    y, e = floored(true), floored(estimate)
    return F.greatest(y / e, e / y)


def relative_error(true: Column, estimate: Column, epsilon: float = 1e-10) -> Column:
    return F.abs(estimate - true) / F.greatest(F.lit(epsilon), true)


def absolute_error(true: Column, estimate: Column) -> Column:
    return F.abs(estimate - true)


def scaled_norm_loss(true: Column, estimate: Column) -> Column:
    """Squared error where the target is within -1 and 1, else half the squared relative deviation."""
    small = (true > -1) & (true < 1)
    return F.when(small, (estimate - true) * (estimate - true)).otherwise(0.5 * (estimate / true - 1) * (estimate / true - 1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of doubles; null where one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def keep_matching(words: Column, pattern: str) -> Column:
    """Members of a word list that match a regular expression."""
    return F.filter(words, lambda w: w.rlike(pattern))


def integers_in(text: Column) -> Column:
    """All integers in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("long"))


def strip_quotes(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit(""))


def choose(n: int, k: int) -> Column:
    """Binomial coefficient as a product of ratios."""
    return reduce(lambda acc, i: acc * F.lit(n - i) / F.lit(i + 1), range(k), F.lit(1.0)).cast("long")


def half_interval(sd: Column, n: Column) -> Column:
    """Half width of the 99 % interval of a mean."""
    return sd * Z99 / F.sqrt(n)


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) > 0)


def log_bucket(value: Column, base: float, buckets: int) -> Column:
    """i where base^i < value < base^(i+1), strictly; buckets (overflow) otherwise, so also for exact powers."""
    out: Column | None = None
    for i in range(buckets):
        inside = (value > base**i) & (value < base ** (i + 1))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out.otherwise(buckets)


def numeric_text(text: Column) -> Column:
    """The number that a text holds; null where it holds none."""
    plain = r"^(?:[1-9]\d*|0)?(?:\.\d+)?$"
    return F.when(text.rlike(plain), text.try_cast("double"))
