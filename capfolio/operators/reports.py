"""Report datasets: link topology, budget concentration, big lines, period movement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from capfolio.functions.casts import beyond_money, exact_money, money_sum, money_total
from capfolio.functions.joins import join_many_to_one
from capfolio.functions.signs import direction
from capfolio.operators.derive import within_variance_guard
from capfolio.operators.scope import one_of
from capfolio.sinks.staging import stage


def fan_out(tables, period: str = "current") -> DataFrame:
    """How many schedules and lines are linked once or several times, by side and agency."""
    at = tables.period("schedule_history", period)
    edges = tables["link_edges"].where(F.col("reporting_period") == at)
    sides = [
        edges.groupBy("pid").agg(F.min("managing_agency").alias("managing_agency"), F.count("*").alias("n"))
        .select(F.lit("schedule").alias("side"), "managing_agency", "n"),
        edges.groupBy("fms_id", "managing_agency").agg(F.count("*").alias("n"))
        .select(F.lit("budget").alias("side"), "managing_agency", "n"),
    ]
    return sides[0].unionByName(sides[1]).groupBy("side", "managing_agency").agg(
        F.count("*").alias("n_entities"),
        F.count_if(F.col("n") == 1).alias("n_one_to_one"),
        F.count_if(F.col("n") > 1).alias("n_fan_out"),
        F.sum("n").alias("n_links"),
        F.max("n").alias("max_links"),
    )


def fan_out_extremes(tables, period: str = "current", n: int = 20) -> DataFrame:
    """The schedules funded by the most lines in one period."""
    at = tables.period("schedule_history", period)
    edges = tables["link_edges"].where(F.col("reporting_period") == at)
    return (
        edges.groupBy("pid")
        .agg(F.count("*").alias("n_links"), money_sum(F.col("commitments")).alias("commitments"))
        .orderBy(F.desc("n_links"), "pid")
        .limit(n)
    )


def budget_concentration(tables) -> DataFrame:
    """Cumulative share of budget by descending line budget, one row per distinct budget.

    Lines of equal budget are first folded into one row, which is staged. The running sums are prefix sums over ranges: rows are
    dealt out by falling budget, each range is added up, the totals of the ranges before (one row per range) are
    its offset, and each range adds its own running sum. No task orders more than one range, whose number and size follow the
    session's shuffle partitions.
    """
    lines = tables["lifetime_budget_variance"].where(F.col("latest_budget").isNotNull())
    steps = stage(lines.groupBy("latest_budget").agg(
        F.count("*").alias("n_lines"),
        F.sum(exact_money(F.col("latest_budget"))).alias("amount"),
        F.sum(beyond_money(F.col("latest_budget"))).alias("beyond"),
    ))
    dealt = stage(steps.repartitionByRange(F.desc("latest_budget")).withColumn("part", F.spark_partition_id()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    offsets = dealt.groupBy("part").agg(
        F.sum("n_lines").alias("part_lines"), F.sum("amount").alias("part_amount"), F.sum("beyond").alias("part_beyond"),
    ).select(
        "part",
        F.coalesce(F.sum("part_lines").over(before), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("part_amount").over(before), F.lit(0)).alias("amount_before"),
        F.sum("part_beyond").over(before).alias("beyond_before"),
        money_total(F.sum("part_amount").over(whole), F.sum("part_beyond").over(whole)).alias("total"),
    )
    inside = W.partitionBy("part").orderBy(F.desc("latest_budget")).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = dealt.select(
        "part", "latest_budget", "n_lines",
        F.sum("n_lines").over(inside).alias("l"), F.sum("amount").over(inside).alias("a"),
        F.sum("beyond").over(inside).alias("b"),
    ).join(offsets, "part")
    beyond = F.coalesce(F.col("beyond_before") + F.col("b"), "beyond_before", "b")
    cumulative = money_total(F.col("amount_before") + F.coalesce("a", F.lit(0)), beyond)
    return running.select(
        "latest_budget", "n_lines",
        (F.col("lines_before") + F.col("l")).alias("cumulative_lines"),
        cumulative.alias("cumulative_budget"),
        F.round(cumulative / F.nullif("total", F.lit(0.0)), 6).alias("cumulative_share"),
    )


def big_lines(tables, category: str, min_budget: float) -> DataFrame:
    """Lines of a category at or above a budget, one row per schedule linked in the newest period.

    Linked lines start from the links, the side that can be hot; the rest are added after. Large lines and the links of the
    newest period are staged, both far fewer than what they are taken from; the state is put together for schedules
    linked to them alone.
    """
    line = ["fms_id", "managing_agency"]
    budgets = (*line, "latest_budget", "original_budget", "cumulative_budget_change", "spend_to_date")
    shown = ("pid", "agency_project_name", "current_phase", "lifecycle_status", "sponsor_agency", "forecast_completion")
    tables = tables.sharing(
        {"link_edges": 1, "latest_project_state": 1, "lifetime_budget_variance": 1, "category_dim": 1},
        {"latest_project_state": shown, "lifetime_budget_variance": budgets},
    )
    spent = F.lit(100.0) * F.col("spend_to_date") / F.nullif("latest_budget", F.lit(0.0))
    lines = stage(_large(tables, category, min_budget).select(*budgets, F.round(spent, 2).alias("spent_pct")))
    at = tables.period("schedule_history", "current")
    now = tables["link_edges"].where(F.col("reporting_period") == at).select(*line, "pid").distinct()
    now = stage(join_many_to_one(now, lines.select(*line), line, "left_semi"))
    state = tables["latest_project_state"].select(*shown).withColumnRenamed("sponsor_agency", "sponsor")
    state = state.join(now.select("pid").distinct(), "pid", "left_semi")
    linked = join_many_to_one(join_many_to_one(now, lines, line), state, ["pid"])
    idle = lines.join(now.select(*line).distinct(), line, "left_anti")
    return linked.unionByName(idle, allowMissingColumns=True)


def _large(tables, category: str, min_budget: float) -> DataFrame:
    kind = tables["category_dim"].where(F.col("category") == category)
    return (
        tables["lifetime_budget_variance"]
        .where(F.col("latest_budget") >= min_budget)
        .join(kind, "fms_id", "left_semi")
    )


def big_lines_summary(tables, category: str, min_budget: float) -> DataFrame:
    """Per holder and in total (NULL agency, ``level`` 'total'): lines, budget, spend share."""
    tables = tables.sharing(
        {"lifetime_budget_variance": 1, "category_dim": 1},
        {"lifetime_budget_variance": (
            "fms_id", "managing_agency", "latest_budget", "cumulative_budget_change", "spend_to_date",
        )},
    )
    lines = _large(tables, category, min_budget)
    grouped = lines.rollup("managing_agency").agg(
        F.grouping("managing_agency").alias("g"),
        F.count("*").alias("n_lines"),
        money_sum(F.col("latest_budget")).alias("budget"),
        money_sum(F.col("spend_to_date")).alias("spend"),
        F.count_if(F.col("cumulative_budget_change") > 0).alias("n_above_original"),
    )
    return grouped.select(
        F.when(F.col("g") == 1, "total").otherwise("agency").alias("level"),
        "managing_agency", "n_lines", "budget",
        F.round(F.lit(100.0) * F.col("spend") / F.nullif("budget", F.lit(0.0)), 2).alias("spent_pct"),
        "n_above_original",
    )


def change_monitor(tables) -> DataFrame:
    """The agency rollup with its movement since the agency's previous period.

    A window partition holds one row per period of an agency: calendar-bounded.
    """
    by_time = W.partitionBy("managing_agency").orderBy("reporting_period")
    moved = ("total_budget", "total_spend", "delayed_count", "completed_count")
    rollup = tables["agency_rollup_by_period"]
    changes = [(F.col(c) - F.lag(c).over(by_time)).alias(f"{c}_change") for c in moved]
    return rollup.select("*", *changes).withColumn(
        "budget_direction", direction(F.col("total_budget_change"), "budget")
    )


WATCHED = ("budget", "schedule")


def _moves(tables, entity: str) -> DataFrame:
    """Each line's change of budget since its snapshot before, or each schedule's reported variance, where there is one."""
    if entity == "budget":
        by_time = W.partitionBy("fms_id", "managing_agency").orderBy("reporting_period")
        return (
            tables["budget_history"]
            .select(
                F.col("fms_id").alias("id"), "managing_agency", "reporting_period",
                F.col("total_budget").alias("value"), F.lag("total_budget").over(by_time).alias("previous_value"),
            )
            .withColumn("movement", F.col("value") - F.col("previous_value"))
            .where(F.col("movement") != 0)
        )
    by_time = W.partitionBy("pid").orderBy("reporting_period")
    total = F.sum("variance_day").over(by_time.rowsBetween(W.unboundedPreceding, W.currentRow))
    days = F.col("variance_day")
    return (
        tables["schedule_history"]
        .where(within_variance_guard(days))
        .select("pid", "managing_agency", "reporting_period", "variance_day")
        .select(
            F.col("pid").alias("id"), "managing_agency", "reporting_period",
            total.cast("double").alias("value"), (total - days).cast("double").alias("previous_value"),
            days.cast("double").alias("movement"),
        )
        .where(F.col("movement") != 0)
    )


def watchlist(tables, n: int = 10, entities: Sequence[str] = WATCHED) -> DataFrame:
    """The ``n`` greatest movements of every agency and period, by absolute size; ties go by id.

    A budget line moves by the change of its budget since its own snapshot before; a schedule by the days it reports, and
    its values are the days added up so far. Schedules beyond the variance guard and rows that did not move are left out. Within
    an agency and period, ``rank`` runs from 1 for each entity.

    Up to Spark's window group limit (1 000 by default) each task drops what cannot be among the ``n`` before the shuffle, so an
    agency with most of all rows costs no more than ``n`` rows from each task. The windows over time hold one row per
    period of a line or schedule.
    """
    parts = []
    for entity in entities:
        one_of("entity", entity, WATCHED)
        size = W.partitionBy("managing_agency", "reporting_period").orderBy(F.abs("movement").desc(), "id")
        parts.append(
            _moves(tables, entity)
            .withColumn("rank", F.row_number().over(size))
            .where(F.col("rank") <= max(1, int(n)))
            .select(
                F.lit(entity).alias("entity"), "managing_agency", "reporting_period", "rank", "id",
                "previous_value", "value", "movement",
                direction(F.col("movement"), "budget" if entity == "budget" else "schedule").alias("direction"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def watched_history(tables, n: int = 10, period: str = "current") -> DataFrame:
    """All periods of the lines and schedules that are on one period's watchlist: what a click on an entry opens.

    ``amount`` and ``spend`` of a line's snapshot, ``days`` of a schedule's report. The list of one period has ``n`` entries per
    agency and entity, so it is the small side of both joins.
    """
    rows = []
    for entity, table, key in (("budget", "budget_history", ["fms_id", "managing_agency"]), ("schedule", "schedule_history", ["pid"])):
        at = tables.period(table, period)
        listed = watchlist(tables, n, (entity,)).where(F.col("reporting_period") == at)
        listed = listed.select(F.col("id").alias(key[0]), "managing_agency", "rank")
        if entity == "budget":
            shown = (F.col("total_budget").alias("amount"), F.col("spend_to_date").alias("spend"))
        else:
            listed = listed.withColumnRenamed("managing_agency", "holder")
            shown = (F.col("variance_day").alias("days"), "lifecycle_status")
        found = join_many_to_one(tables[table], listed, key, null_matches=True)
        holder = F.col("managing_agency") if entity == "budget" else F.col("holder").alias("managing_agency")
        rows.append(found.select(F.lit(entity).alias("entity"), F.col(key[0]).alias("id"), holder, "rank", "reporting_period", *shown))
    return rows[0].unionByName(rows[1], allowMissingColumns=True)
