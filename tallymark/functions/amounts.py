"""Exact arithmetic on amounts that are stored as doubles with a fixed number of decimals.

A sum of doubles depends on the order of the rows, so it changes with the partitioning and
with every retried task, and it loses cents once it is large. A sum of decimals is exact but
about ten times slower. Here each amount becomes a long first; longs add up exactly, in any
order, inside generated code. The rare amount that is too large for that goes to a decimal
column of its own, which costs nothing where it is null.

The expressions are SQL text: one call from Python to the JVM each, instead of one per step.
"""

from pyspark.sql import Column, functions as F

# Beyond 2 ** 51, a double times a power of ten can round to the wrong whole number; beyond
# twice that, doubles no longer tell whole numbers of units apart.
MAX_UNITS = 2**51
# The limbs of a long have 22 bits, so this many of them add up within a long.
MAX_ROWS = 2**41
_WORDS = ("no", "one", "two", "three", "four", "five", "six")


def quoted(name: str) -> str:
    """Return a column name for use in SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scaled(name: str, decimals: int) -> tuple[str, str]:
    """Return SQL for an amount's number of units and for whether a long holds it safely."""
    scaled = f"rint({quoted(name)} * {10**decimals}D)"
    return scaled, f"abs({scaled}) <= {MAX_UNITS}D"


def _refused(name: str, decimals: int) -> str:
    number = _WORDS[decimals] if decimals < len(_WORDS) else str(decimals)
    text = _literal(f"{name} is not an amount with {number} decimals: ")
    return f"raise_error({text} || {quoted(name)})"


def units(name: str, decimals: int = 2) -> Column:
    """Return the amount in column ``name`` as a long number of units of ``10 ** -decimals``.

    Null for null, and for an amount of more than ``MAX_UNITS`` units, which ``large_amount``
    returns instead. Fails the query on a value with more decimals, rather than round it.
    Dividing the whole number by a power of ten gives back the very same double exactly when
    the value had no further decimals.
    """
    scaled, fits = _scaled(name, decimals)
    return F.expr(
        f"""
        CASE
            WHEN {fits} AND {scaled} / {10**decimals}D = {quoted(name)} THEN CAST({scaled} AS BIGINT)
            WHEN {fits} THEN {_refused(name, decimals)}
        END
        """
    )


def hundredths(name: str) -> Column:
    """Return the amount in column ``name`` times 100 as a long; see ``units``."""
    return units(name, 2)


def large_amount(name: str, decimals: int = 2) -> Column:
    """Return as a decimal the amount in column ``name`` if ``units`` has null for it.

    Null for null and for amounts that fit. A double stands for the shortest decimal number
    that reads back as the same double. Fails the query on a value with more decimals, on NaN,
    on an infinity and on what a decimal of 38 digits cannot hold.
    """
    _, fits = _scaled(name, decimals)
    exact = f"try_cast({quoted(name)} AS DECIMAL(38, {decimals}))"
    return F.expr(
        f"""
        CASE WHEN NOT {fits} THEN coalesce(
            CASE WHEN CAST({exact} AS DOUBLE) = {quoted(name)} THEN {exact} END,
            CAST({_refused(name, decimals)} AS DECIMAL(38, {decimals}))
        ) END
        """
    )


def exact_sum(name: str, decimals: int, large: str | None = None) -> Column:
    """Aggregate a column of longs that count units of ``10 ** -decimals`` to a decimal.

    ``large`` names a column of decimals that are added, null in most rows. The longs are cut
    into limbs of 22 bits, which are summed apart and joined once per group: no sum of fewer
    than ``MAX_ROWS`` rows leaves a long, with or without ANSI mode. More rows in a group, and
    a total of more than 38 digits, fail the query in either mode.
    """
    x = quoted(name)
    total = f"""
        (CAST(sum(shiftright({x}, 44)) AS DECIMAL(19, 0)) * {2**44}BD
        + CAST(sum(shiftright({x}, 22) & {2**22 - 1}L) AS DECIMAL(19, 0)) * {2**22}BD
        + CAST(sum({x} & {2**22 - 1}L) AS DECIMAL(19, 0))) * {10**-decimals:.{decimals}f}BD
    """
    total = f"""
        CASE WHEN count({x}) < {MAX_ROWS} THEN CAST({total} AS DECIMAL(38, {decimals}))
        ELSE CAST(raise_error('a group has too many rows') AS DECIMAL(38, {decimals})) END
    """
    if large is None:
        return F.expr(total)
    y = quoted(large)
    more = f"try_sum({y}) FILTER (WHERE {y} IS NOT NULL)"
    return F.expr(
        f"""
        CASE
            WHEN count({y}) = 0 THEN {total}
            ELSE coalesce(
                try_add({more}, coalesce({total}, 0BD)),
                CAST(raise_error('a total has more than 38 digits') AS DECIMAL(38, {decimals}))
            )
        END
        """
    )
