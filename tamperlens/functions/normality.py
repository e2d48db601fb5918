"""Normal quantiles and the Shapiro-Wilk statistic as SQL over ranks and moments.

After Wichura's AS 241 (1988) and Royston's AS R94 (1995).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: coefficients of AS 241, lowest power first: (numerator, denominator)
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
     3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# fixed values: polynomial coefficients of AS R94, lowest power first
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)
SMALL_GAMMA = (-2.273, 0.459)
#: largest sample for which the p-value was calibrated
CALIBRATED_ROWS = 5000


def polynomial(coefficients: Sequence[float], x: str) -> str:
    text = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        text = f"({c!r}D + ({x}) * {text})"
    return text


def _ratio(pair: tuple[Sequence[float], Sequence[float]], x: str) -> str:
    return f"{polynomial(pair[0], x)} / {polynomial(pair[1], x)}"


def lower_quantile(share: str, root: str | None = None) -> str:
    """Standard normal value below which ``share`` (at most one half) lies.

    ``root`` is sqrt(-ln(share)), where it is known.
    """
    q, r = f"({share} - 0.5D)", root or f"sqrt(-ln({share}))"
    return (
        f"CASE WHEN {q} >= -0.425D THEN {q} * {_ratio(MIDDLE, f'(0.180625D - {q} * {q})')} "
        f"WHEN {r} <= 5 THEN -{_ratio(TAIL, f'({r} - 1.6D)')} ELSE -{_ratio(FAR, f'({r} - 5)')} END"
    )


def with_quantiles(df: DataFrame, shares: dict[str, str]) -> DataFrame:
    """Columns of the standard normal values below which the given shares lie.

    The smaller side of each share and its root are columns first: the formula uses them
    many times, and as text they would outgrow generated code.
    """
    sides = {f"_{name}_side": F.expr(f"least({p}, 1 - {p})") for name, p in shares.items()}
    roots = {f"_{name}_root": F.expr(f"sqrt(-ln(_{name}_side))") for name in shares}
    found = {
        name: F.expr(f"if({p} <= 0.5D, 1, -1) * ({lower_quantile(f'_{name}_side', f'_{name}_root')})")
        for name, p in shares.items()
    }
    return df.withColumns(sides).withColumns(roots).withColumns(found).drop(*sides, *roots)


#: ranks at either end whose scores are summed one by one; further in, the corrected
#: integrals below are good to 1e-12
EDGE_RANKS = 64
#: fixed values: corrections of the midpoint rule by the first and third derivative
FIRST, THIRD = "(1D / 24)", "(7D / 5760)"


def density(z: str) -> str:
    return f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()))"


def score_integral(z: str) -> str:
    """Antiderivative over ranks of the normal score at ``z``, corrected for sums of whole ranks.

    With h = 1 / (n + 1/4) the score z(x) has the derivatives h / d and h^3 (1 + 2 z^2) / d^3
    for the density d, and its integral is -d / h. The difference between the values half a
    rank beyond either end is the sum of the scores in between.
    """
    d, h = density(z), "(1D / (n + 0.25D))"
    return (
        f"(-{d} / {h} - {FIRST} * {h} / {d} "
        f"+ {THIRD} * pow({h} / {d}, 3) * (1 + 2 * {z} * {z}))"
    )


def square_integral(share: str, z: str) -> str:
    """The same for the squares of the scores, whose integral is (share - z d) / h."""
    d, h = density(z), "(1D / (n + 0.25D))"
    return (
        f"(({share} - {z} * {d}) / {h} - {FIRST} * 2 * {z} * {h} / {d} "
        f"+ {THIRD} * 2 * {z} * pow({h} / {d}, 3) * (4 + 2 * {z} * {z}))"
    )


def share_of_rank(rank: str) -> str:
    """Share of the distribution below the score of a rank of n."""
    return f"(({rank} - 0.375D) / (n + 0.25D))"


def edge_sum(first: str, last: str, power: int = 1) -> str:
    """Sum over low ranks from ``first`` to ``last``, at most ``EDGE_RANKS`` of them."""
    score = f"pow({lower_quantile(share_of_rank('r'))}, {power})" if power != 1 else lower_quantile(share_of_rank("r"))
    return (
        f"CASE WHEN {first} <= {last} THEN "
        f"aggregate(sequence({first}, {last}), 0D, (s, r) -> s + {score}) ELSE 0D END"
    )


def shapiro_w() -> str:
    """W from n, sum_sq (of deviations), norm2, low1, low2, mid and the outer gaps.

    ``low1`` and ``low2`` are the two lowest expected normal scores, ``mid`` is the sum
    of score times value over the ranks in between, ``gap1`` and ``gap2`` are the
    distances of the outermost and second outermost values.
    """
    u = "(1 / sqrt(n))"
    last = f"({polynomial(LAST_WEIGHT, u)} - low1 / sqrt(norm2))"
    after = f"({polynomial(NEXT_WEIGHT, u)} - low2 / sqrt(norm2))"
    two = (
        f"{last} * gap1 + {after} * gap2 + mid / sqrt((norm2 - 2 * low1 * low1 - 2 * low2 * low2) "
        f"/ (1 - 2 * {last} * {last} - 2 * {after} * {after}))"
    )
    # of four or five values only the outermost weight is set, of three all are known
    one = (
        f"{last} * gap1 + mid / sqrt((norm2 - 2 * low1 * low1) / (1 - 2 * {last} * {last}))"
    )
    linear = f"CASE WHEN n > 5 THEN {two} WHEN n > 3 THEN {one} ELSE sqrt(0.5D) * gap1 END"
    return f"least(pow({linear}, 2) / sum_sq, 1D)"


def shapiro_z() -> str:
    """Standard normal score of ``w``, whose upper tail is the p-value; for n > 3."""
    small = f"(-ln({polynomial(SMALL_GAMMA, 'n')} - ln(1 - w)) - {polynomial(SMALL_MEAN, 'n')})"
    large = f"(ln(1 - w) - {polynomial(LARGE_MEAN, 'ln(n)')})"
    return (
        f"CASE WHEN w = 1 THEN double('-infinity') "
        f"WHEN n > 11 THEN {large} / exp({polynomial(LARGE_LOG_SD, 'ln(n)')}) "
        f"WHEN ln(1 - w) >= {polynomial(SMALL_GAMMA, 'n')} THEN double('infinity') "
        f"ELSE {small} / exp({polynomial(SMALL_LOG_SD, 'n')}) END"
    )
