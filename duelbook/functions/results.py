"""Result alphabet, percentages and labels (SC8, SC11-SC20, AGG11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# V = win, E = draw, D = loss.
WIN, DRAW, LOSS = "V", "E", "D"
RESULTS = (WIN, DRAW, LOSS)


def is_valid(result: Column) -> Column:
    return result.isin(*RESULTS)


def home_result(home: Column, away: Column) -> Column:
    return F.when(home > away, F.lit(WIN)).when(home < away, F.lit(LOSS)).otherwise(F.lit(DRAW))


def mirrored(result: Column) -> Column:
    return F.translate(result, WIN + LOSS, LOSS + WIN)


def count_of(value: str, result: Column | None = None) -> Column:
    return F.count_if((F.col("result") if result is None else result) == value)


def pct2(n: Column, d: Column) -> Column:
    """n/d*100 to two decimals, half-even in exact integer arithmetic; 0.0 when d = 0."""
    n, d = n.cast("long"), d.cast("long")
    top = n * 20000 + d
    q = F.call_function("div", top, d * 2)
    tie = (top % (d * 2) == 0) & (q % 2 == 1)
    return F.when(d == 0, F.lit(0.0)).otherwise((q - F.when(tie, 1).otherwise(0)) / F.lit(100.0))


def pct_exact(n: Column, d: Column) -> Column:
    """Unrounded percentage; 0.0 when d = 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d.cast("double") * 100.0)


def delta2(a: Column, b: Column) -> Column:
    """Difference of two rounded percentages, rounded again."""
    return F.round(a - b, 2)


def shrunk(pct: Column, sample: Column, prior: int) -> Column:
    """Percentage pulled towards 50 by ``prior`` fictitious matches."""
    return F.when(sample <= 0, F.lit(50.0)).otherwise(
        (pct * sample + F.lit(50.0 * prior)) / (sample + F.lit(prior))
    )


def trend(delta: Column, available: Column, threshold: float) -> Column:
    """UP / DOWN / STABLE; a zero delta is STABLE even at threshold 0; NULL without a sample."""
    return (
        F.when(available == 0, F.lit(None).cast("string"))
        .when((delta > 0) & (delta >= threshold), F.lit("UP"))
        .when((delta < 0) & (delta <= -threshold), F.lit("DOWN"))
        .otherwise(F.lit("STABLE"))
    )


def sample_status(available: Column, window: Column) -> Column:
    return (
        F.when(available == 0, F.lit("EMPTY"))
        .when(available < window, F.lit("LOW_SAMPLE"))
        .otherwise(F.lit("COMPLETE"))
    )


def indicator(wins: Column, draws: Column, losses: Column) -> Column:
    """GREEN when wins reach half, else RED when losses do (GREEN first on ties)."""
    return (
        F.when(wins >= draws + losses, F.lit("GREEN"))
        .when(losses >= wins + draws, F.lit("RED"))
        .otherwise(F.lit("NONE"))
    )


def balance(indicator_value: Column, shown: Column) -> Column:
    return (
        F.when(shown & (indicator_value == "GREEN"), F.lit("🟢"))
        .when(shown & (indicator_value == "RED"), F.lit("🔴"))
        .otherwise(F.lit(""))
    )


def confirmation(ind_a: Column, res_a: Column, ind_b: Column, res_b: Column) -> Column:
    """Whether both sides' results bear out their indicators."""
    def bears_out(ind, res):
        return ((ind == "GREEN") & (res == WIN)) | ((ind == "RED") & (res == LOSS))

    both = bears_out(ind_a, res_a) & bears_out(ind_b, res_b)
    return F.when(
        both,
        F.when(ind_a != ind_b, F.lit("MIXED")).when(ind_a == "GREEN", F.lit("BOTH_GREEN")).otherwise(F.lit("BOTH_RED")),
    )


# --- short strings (WIN3, WIN6, WIN7): day, window or segment sequences ------

def count_in(seq: Column, value: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(value), F.lit("")))


def tail(seq: Column, k: int) -> Column:
    return F.right(seq, F.lit(k))


def _trailing(seq: Column, results) -> Column:
    """Length of the run of ``results`` at the end; linear in the text, whatever stands in it."""
    return F.length(seq) - F.length(F.rtrim(seq, results))


def win_run(seq: Column) -> Column:
    """Trailing wins."""
    return _trailing(seq, F.lit(WIN))


def unbeaten_run(seq: Column) -> Column:
    """Trailing results without a loss."""
    return _trailing(seq, F.lit(WIN + DRAW))


def winless_run(seq: Column) -> Column:
    """Trailing results without a win."""
    return _trailing(seq, F.lit(DRAW + LOSS))


def drawless_run(seq: Column) -> Column:
    """Trailing results without a draw."""
    return _trailing(seq, F.lit(WIN + LOSS))


def same_run(seq: Column) -> Column:
    """Length of the trailing run of equal results."""
    return _trailing(seq, F.right(seq, F.lit(1)))


def best_run(seq: Column, value: str) -> Column:
    """Longest run of ``value``."""
    lengths = F.transform(F.regexp_extract_all(seq, F.lit(f"{value}+"), F.lit(0)), F.length)
    return F.coalesce(F.array_max(lengths), F.lit(0))


def fmt_pct(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.format_string("%.2f%%", value))


def fmt_score(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.format_string("%.2f", value))
