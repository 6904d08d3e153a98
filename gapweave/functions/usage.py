"""Column functions over cost and token accounting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CANCELLED, FAILED, FINISHED, HIGH_COST, INITIALIZING, RUNNING


def extract_cost(usage: Column) -> Column:
    """``total_cost``, else ``cost``, else 0 of a usage map."""
    return F.coalesce(
        F.try_element_at(usage, F.lit("total_cost")),
        F.try_element_at(usage, F.lit("cost")),
        F.lit(0.0),
    )


def money(cost: Column | str) -> Column:
    """A cost as a decimal with twelve places, so that sums are exact in any order."""
    return F.col(cost).cast("decimal(26,12)") if isinstance(cost, str) else cost.cast("decimal(26,12)")


def exact_sum(cost: Column) -> Column:
    """Sum that does not depend on the order of rows; nothing is rounded away from single costs."""
    return F.sum(money(cost)).cast("double")


def cost_per(total: Column, n: Column) -> Column:
    """Cost per item, rounded in whole millionths; 0 where there is no item."""
    return F.coalesce(F.round(F.try_divide(F.round(total * 1_000_000), n)) / F.lit(1_000_000.0), F.lit(0.0))


def token_count(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def token_reduction(tokens_in: Column, tokens_out: Column) -> Column:
    """Percent saved; 0 where there was no input."""
    return F.coalesce(F.try_divide(tokens_in - tokens_out, tokens_in) * 100, F.lit(0.0))


def overall_reduction(stages: Column) -> Column:
    """First stage's input against last stage's output; null without stages."""
    return F.when(
        F.size(stages) > 0,
        token_reduction(F.get(stages, F.lit(0))["input"], F.try_element_at(stages, F.lit(-1))["output"]),
    )


def is_high_cost(total: Column, limit: float = HIGH_COST) -> Column:
    return total > limit


def rate(part: Column, whole: Column) -> Column:
    """Share with 0 where the whole is empty."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


# The texts of a run's state.
def status_text(status, serp_done, scraping, extracting, extracted, failed, found, errors) -> Column:
    """One line telling how far a run has come."""
    active = F.concat_ws(
        ", ",
        F.when(scraping > 0, F.format_string("%d scraping", scraping)),
        F.when(extracting > 0, F.format_string("%d extracting", extracting)),
    )
    done = F.concat(
        F.format_string("%d extracted", extracted),
        F.when(failed > 0, F.format_string(", %d failed", failed)).otherwise(""),
        F.format_string(" of %d", found),
    )
    return (
        F.when(status == INITIALIZING, "Initializing pipeline...")
        .when((status == RUNNING) & ~serp_done, "Searching for URLs...")
        .when((status == RUNNING) & (active != ""), F.concat(active, F.lit(" | "), done))
        .when(status == RUNNING, F.concat(F.lit("Processing... | "), done))
        .when(
            status == FINISHED,
            F.format_string("Finished: %d/%d successful extractions", extracted, found),
        )
        .when(
            status == FAILED,
            F.format_string("Failed: %d/%d completed, %d errors", extracted, found, errors),
        )
        .when(
            status == CANCELLED,
            F.format_string("Cancelled: %d/%d completed before cancellation", extracted, found),
        )
        .otherwise(F.concat(F.lit("Status: "), status))
    )


def live_summary(query: Column, text: Column, seconds: Column, total_cost: Column) -> Column:
    """Query, state, elapsed seconds and cost in one line."""
    return F.format_string(
        "%s | %s | %ss | $%s",
        query,
        text,
        seconds.cast("decimal(18,1)").cast("string"),
        total_cost.cast("decimal(18,3)").cast("string"),
    )
