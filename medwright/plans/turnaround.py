"""Ambulatory pharmacy turnaround: entered -> filled -> verified (Q8, Q8a-Q8d).

Plan shape
----------
``tat_detail`` takes the window's dispenses first, cuts the action log to their
actions by a semi-join, pivots it per action (the three action types' times and
users, a partial+final aggregate), joins that one row per action to the
dispenses, and keeps one row per order+fill.
The report then attaches

* per-action flag lists (``tat_flags``: cut to the detail's actions, listed, then joined 1:1),
* per-pharmacy-name integer averages (``tat_pharmacy_averages``),
* per-row step durations (``tat_step_durations``).

The detail feeds three consumers, so ``turnaround_report`` stores it once as a
temp table (``sources.temptables``). The two aggregated sides are small at run time and AQE broadcasts them; their
size is measured, never assumed. Step durations are computed in place:
the report joins them back on the detail's own unique key.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import duration_text, lit_ts, minute_boundaries
from ..functions.predicates import as_numbers, not_equal, optional_in
from ..functions.text import concat_ws_null_empty
from ..operators.aggs import aligned_fields, int_avg, pivot_max
from ..sources.temptables import stored_once

DETAIL_COLUMNS = ["pharmacy_name", "rx_number", "fill_number", "pharmacy_id", "entered_dttm", "entered_user",
                  "filled_dttm", "filled_user", "verified_dttm", "verified_user", "action_id", "order_med_id"]


def _flagged_actions(tables: Mapping[str, DataFrame], flag_ids: Iterable[str]) -> DataFrame:
    """Action ids carrying at least one of ``flag_ids``."""
    flags = tables["ord_act_flags"].select("action_id", F.col("rx_resolv_flag_id").alias("record_id"))
    info = tables["flag_info"].select("record_id").filter(F.col("record_id").isin(list(flag_ids)))
    return flags.join(info, "record_id").select("action_id")


def tat_detail(tables: Mapping[str, DataFrame], start, end, pharmacies: Iterable | None = None,
               flags: Iterable[str] | None = None, report_option: str | None = None,
               service_areas: Iterable = K.TURNAROUND_SERVICE_AREAS,
               intervention_flags: Iterable[str] = K.INTERVENTION_FLAG_IDS) -> DataFrame:
    """One row per order+fill with the pivoted action times and users.

    ``report_option``: ``'2'`` clean orders only (no intervention flag on the
    order), ``'3'`` rows whose action has an intervention flag, ``'1'`` or
    None both (P17). ``flags`` and option 3 restrict rows through the
    left-joined flag table, so rows without flags drop (K24).
    """
    report_option = None if report_option is None else str(report_option).strip()
    odi = (tables["order_disp_info"]
           .filter((F.col("action_instant") >= lit_ts(start)) & (F.col("action_instant") <= lit_ts(end))
                   & F.col("fill_service_date").isNotNull()
                   & not_equal("fill_status_c", K.EXCLUDED_FILL_STATUS))
           .select("order_med_id", "fill_number", "rx_num_formatted_hx", "fill_phr_id", "contact_date_real"))
    om = (tables["order_med"].filter(F.col("ordering_mode_c") == K.OUTPATIENT_ORDERING_MODE)
          .select("order_med_id", "login_dep_id"))
    dep = tables["clarity_dep"].filter(F.col("serv_area_id").isin(as_numbers(service_areas))).select(
        F.col("department_id").alias("login_dep_id"))
    phr = tables["rx_phr"].filter(optional_in("pharmacy_id", pharmacies)).select(
        F.col("pharmacy_id").alias("fill_phr_id"), "pharmacy_id", "pharmacy_name")
    link = tables["ord_act_ord_info"].select("action_id", F.col("order_id").alias("order_med_id"),
                                             F.col("order_date").alias("contact_date_real"))
    keys = ["order_med_id", "contact_date_real"]
    # The links of the window's orders, from two inputs alone: what else has to be cut to the
    # window meets these, not the rows below with all their joins.
    window_links = link.join(odi.select(*keys), keys, "left_semi")
    acts = tables["ord_act_ot"].filter(F.col("action_type_c").isin(K.ACTION_ENTERED, K.ACTION_FILLED, K.ACTION_VERIFIED))
    emp = tables["clarity_emp"].select(F.col("epic_emp_id").alias("user_id"), F.col("name").alias("user_name"))

    rows = (odi.join(om, "order_med_id").join(dep, "login_dep_id").join(phr, "fill_phr_id")
            .join(link, keys))

    # Left-joined flags only matter when a predicate reads them; without one
    # the join only duplicates rows, which MAX ignores, so it is left out.
    flag_filter = [f for f in (flags or []) if f not in (None, "")]
    if report_option == "3":
        wanted = set(intervention_flags) & set(flag_filter) if flag_filter else set(intervention_flags)
        rows = rows.join(_flagged_actions(tables, sorted(wanted)), "action_id", "left_semi")
    elif flag_filter:
        rows = rows.join(_flagged_actions(tables, flag_filter), "action_id", "left_semi")
    if report_option == "2":
        # Only the window's orders can be dirty.
        dirty = window_links.join(_flagged_actions(tables, intervention_flags), "action_id").select(*keys)
        rows = rows.join(dirty, keys, "left_anti")
    elif report_option not in (None, "", "1", "2", "3"):
        rows = rows.filter(F.lit(False))  # an unknown option selects nothing, as the OR-chain does

    # The log is cut to the window's actions before anything is shuffled, and
    # reduced to one line per action, type and user before the user lookup, so
    # neither history nor a busy action or user meets a join line by line. MAX
    # is associative: the max per order+fill of per-action maxes equals the
    # report's single MAX over the joined lines. Whether an action was verified
    # comes from the same lines, known user or not.
    t, ts, who = "action_type_c", "action_dttm_local", "user_name"
    lines = (acts.join(window_links.select("action_id"), "action_id", "left_semi")
             .groupBy("action_id", t, "user_id").agg(F.max(ts).alias(ts))
             .join(emp.withColumn("_known", F.lit(True)), "user_id", "left")
             .withColumn(ts, F.when(F.col("_known"), F.col(ts))))
    per_action = (lines.groupBy("action_id").agg(
        pivot_max(t, ts, K.ACTION_ENTERED).alias("entered_dttm"),
        pivot_max(t, who, K.ACTION_ENTERED).alias("entered_user"),
        pivot_max(t, ts, K.ACTION_FILLED).alias("filled_dttm"),
        pivot_max(t, who, K.ACTION_FILLED).alias("filled_user"),
        pivot_max(t, ts, K.ACTION_VERIFIED).alias("verified_dttm"),
        pivot_max(t, who, K.ACTION_VERIFIED).alias("verified_user"),
        F.max(F.col(t) == K.ACTION_VERIFIED).alias("_verified"), F.max("_known").alias("_known"))
        .filter("_verified AND _known").drop("_verified", "_known"))
    rows = rows.join(per_action, "action_id")

    return (rows.groupBy(F.col("order_med_id").alias("_order"), F.col("fill_number").alias("_fill")).agg(
        F.max("pharmacy_name").alias("pharmacy_name"),
        F.max("rx_num_formatted_hx").alias("rx_number"),
        F.max("fill_number").alias("fill_number"),
        F.max("pharmacy_id").alias("pharmacy_id"),
        *[F.max(c).alias(c) for c in ("entered_dttm", "entered_user", "filled_dttm", "filled_user",
                                      "verified_dttm", "verified_user")],
        F.max("action_id").alias("action_id"),
        F.max(concat_ws_null_empty("order_med_id", F.lit("-"), "fill_number")).alias("order_med_id"),
    ).select(*DETAIL_COLUMNS))


def tat_flags(tables: Mapping[str, DataFrame], detail: DataFrame, flags: Iterable[str] | None = None) -> DataFrame:
    """Flag names and ids per detail action (Q8b). Lists are sorted by flag id
    and line up; repeats are kept when details share an action (K21)."""
    info = tables["flag_info"].filter(optional_in("record_id", flags))
    times = detail.groupBy("action_id").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    # Flags are cut to the detail's actions and listed per action first; each
    # list then meets its action once, and repeats as often as details share it.
    listed = (tables["ord_act_flags"].select("action_id", F.col("rx_resolv_flag_id").alias("record_id"))
              .join(times, "action_id", "left_semi").join(info, "record_id")
              .join(tables["flg_map"].select(F.col("community_id").alias("record_id")), "record_id")
              .groupBy("action_id").agg(F.array_sort(F.collect_list(F.struct(
                  F.col("record_id").alias("_k"), F.col("display_name").cast("string").alias("flag_list"),
                  F.col("record_id").cast("string").alias("flag_ids")))).alias("_flags")))
    repeated = F.flatten(F.transform("_flags", lambda f: F.array_repeat(f, F.col("_times"))))
    lists = aligned_fields("_flags", ["flag_list", "flag_ids"], ",")
    return listed.join(times, "action_id").withColumn("_flags", repeated).select("action_id", *[c.alias(n) for n, c in lists.items()])


def _durations() -> dict[str, F.Column]:
    e, f, v = F.col("entered_dttm"), F.col("filled_dttm"), F.col("verified_dttm")
    return {"time_to_filled": duration_text(e, f), "time_to_verified": duration_text(f, v),
            "turnaround_time": duration_text(e, v)}


def tat_step_durations(detail: DataFrame) -> DataFrame:
    """``H:MM`` step times for fills that were filled and verified."""
    done = detail.filter(F.col("filled_dttm").isNotNull() & F.col("verified_dttm").isNotNull())
    return done.select("pharmacy_id", "order_med_id", *[c.alias(n) for n, c in _durations().items()])


def tat_pharmacy_averages(detail: DataFrame) -> DataFrame:
    """Integer-minute averages per pharmacy *name* (Q8d, A9, K22)."""
    e, f, v = F.col("entered_dttm"), F.col("filled_dttm"), F.col("verified_dttm")
    done = detail.filter(e.isNotNull() & f.isNotNull() & v.isNotNull())
    return done.groupBy("pharmacy_name").agg(
        F.max("pharmacy_id").alias("pharmacy_id"),
        int_avg(minute_boundaries(e, v)).alias("average_turn_around_time_min"),
        int_avg(minute_boundaries(e, f)).alias("average_time_to_filled_min"),
        int_avg(minute_boundaries(f, v)).alias("average_time_to_verified_min"))


def turnaround_report(tables: Mapping[str, DataFrame], start, end, pharmacies=None, flags=None,
                      report_option: str | None = None, cache: bool = True, display_names: bool = False,
                      **kw) -> DataFrame:
    """The full report (Q8): detail + flag lists + pharmacy averages + step times.

    Averages join on the pharmacy id that is the *max* id of its name group,
    so pharmacies sharing a name with a higher id get no averages (K20).
    """
    detail = tat_detail(tables, start, end, pharmacies, flags, report_option, **kw)
    if cache:
        return stored_once(detail, "tat_detail", lambda d: _assemble(tables, d, flags, display_names))
    return _assemble(tables, detail, flags, display_names)


def _assemble(tables: Mapping[str, DataFrame], detail: DataFrame, flags, display_names: bool) -> DataFrame:
    flag_lists = tat_flags(tables, detail, flags)
    averages = tat_pharmacy_averages(detail).drop("pharmacy_name")
    done = F.col("filled_dttm").isNotNull() & F.col("verified_dttm").isNotNull()
    out = (detail.join(flag_lists, "action_id", "left").join(averages, "pharmacy_id", "left"))
    report = out.select(
        "pharmacy_name", F.col("rx_number"), F.col("order_med_id").alias("order_id"),
        F.col("fill_number").alias("rx_fill_number"), "action_id",
        F.col("flag_list").alias("flag_name"), "flag_ids",
        "entered_dttm", "entered_user", "filled_dttm", "filled_user", "verified_dttm", "verified_user",
        *[F.when(done, c).alias(n) for n, c in _durations().items()],
        F.col("average_time_to_filled_min").alias("average_time_to_filled_minutes"),
        F.col("average_time_to_verified_min").alias("average_time_to_verified_minutes"),
        F.col("average_turn_around_time_min").alias("average_turn_around_time_minutes"))
    if display_names:
        report = report.select(*[F.col(c).alias(K.TURNAROUND_LABELS[c]) for c in report.columns])
    return report
