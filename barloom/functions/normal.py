"""The normal distribution as column expressions, and the same formulas as SQL text.

Neither engine has an error function, so both evaluate one published rational
approximation: Hart's as given by West (2005) for the distribution function (double
precision), Wichura's AS241 (1988) for its inverse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hart's coefficients, highest power first.
HART_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_SPLIT = 7.07106781186547
ROOT_2PI = 2.506628274631

#: Wichura's coefficients, lowest power first, numerator and denominator of the
#: centre, the near tail and the far tail.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
NEAR_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _horner(coefficients, x):
    """Highest power first."""
    out = None
    for c in coefficients:
        out = F.lit(float(c)) if out is None else out * x + F.lit(float(c))
    return out


def norm_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * _horner(HART_P, z) / _horner(HART_Q, z)
    tail = z + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = z + F.lit(k) / tail
    low = F.when(z > 37, F.lit(0.0)).when(z < HART_SPLIT, near).otherwise(e / tail / ROOT_2PI)
    return F.when(x > 0, F.lit(1.0) - low).otherwise(low)


def norm_ppf(p: Column) -> Column:
    """Null outside (0, 1)."""

    def ratio(pair, x):
        return _horner(pair[0][::-1], x) / _horner(pair[1][::-1], x)

    q = p - 0.5
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5, ratio(NEAR_TAIL, r - 1.6)).otherwise(ratio(FAR_TAIL, r - 5))
    found = F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), found)


def norm_cdf_sql(x: str) -> str:
    """The expression of ``norm_cdf`` as SQL over the expression ``x``."""

    def horner(coefficients, z):
        out = ""
        for c in coefficients:
            out = f"{c!r}::DOUBLE" if not out else f"({out} * {z} + {c!r}::DOUBLE)"
        return out

    z = f"abs({x})"
    e = f"exp(-{z} * {z} / 2)"
    tail = f"({z} + 0.65::DOUBLE)"
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = f"({z} + {k} / {tail})"
    low = f"CASE WHEN {z} > 37 THEN 0.0::DOUBLE WHEN {z} < {HART_SPLIT!r}::DOUBLE THEN {e} * {horner(HART_P, z)} / {horner(HART_Q, z)} ELSE {e} / {tail} / {ROOT_2PI!r}::DOUBLE END"
    return f"(CASE WHEN {x} > 0 THEN 1.0::DOUBLE - ({low}) ELSE ({low}) END)"
