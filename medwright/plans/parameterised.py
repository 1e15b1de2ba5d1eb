"""Reports as SQL text with parameters (IO15).

A report kept as text takes its parameters as named markers (``:start_ts``), never as text pasted into it: a quote
in a value is a character of the value. A list parameter is an array; an empty one means
"no filter", and as the marker is a constant the optimizer drops the whole predicate. ``{name}`` stands for a
table and is bound to a DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.predicates import as_numbers


def list_parameter(values: Sequence | None) -> Column:
    """An array for a list parameter; None and empty values are left out. Its type is given in the text."""
    return F.array(*[F.lit(v) for v in values or [] if v is not None and v != ""])


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], parameters: Mapping) -> DataFrame:
    """The report ``text`` over ``tables`` with its markers bound."""
    return spark.sql(text, args=dict(parameters), **{n: tables[n] for n in tables if f"{{{n}}}" in text})


#: One row per order and fill with its entered, filled and verified times and users.
TURNAROUND_DETAIL = """
WITH fills AS (
  SELECT d.order_med_id, d.contact_date_real, d.fill_number, d.rx_num_formatted_hx, p.pharmacy_id, p.pharmacy_name
  FROM {order_disp_info} d
  JOIN {order_med} m ON m.order_med_id = d.order_med_id
  JOIN {clarity_dep} c ON c.department_id = m.login_dep_id
  JOIN {rx_phr} p ON p.pharmacy_id = d.fill_phr_id
  WHERE d.action_instant BETWEEN CAST(:start_ts AS TIMESTAMP_NTZ) AND CAST(:end_ts AS TIMESTAMP_NTZ) AND d.fill_service_date IS NOT NULL AND d.fill_status_c <> :excluded_status
    AND m.ordering_mode_c = :ordering_mode AND array_contains(CAST(:service_areas AS ARRAY<BIGINT>), c.serv_area_id)
    AND (size(:pharmacies) = 0 OR array_contains(CAST(:pharmacies AS ARRAY<BIGINT>), p.pharmacy_id))),
known_flags AS (
  SELECT f.action_id, i.record_id FROM {ord_act_flags} f JOIN {flag_info} i ON i.record_id = f.rx_resolv_flag_id),
linked AS (
  SELECT f.*, l.action_id FROM fills f
  JOIN {ord_act_ord_info} l ON l.order_id = f.order_med_id AND l.order_date = f.contact_date_real
  WHERE :report_option IN ('1', '2', '3')
    AND ((size(:flags) = 0 AND :report_option <> '3') OR l.action_id IN (
      SELECT k.action_id FROM known_flags k
      WHERE (size(:flags) = 0 OR array_contains(CAST(:flags AS ARRAY<STRING>), k.record_id))
        AND (:report_option <> '3' OR array_contains(CAST(:intervention_flags AS ARRAY<STRING>), k.record_id))))
    AND (:report_option <> '2' OR NOT EXISTS (
      SELECT 1 FROM {ord_act_ord_info} o JOIN known_flags k ON k.action_id = o.action_id
      WHERE o.order_id = f.order_med_id AND o.order_date = f.contact_date_real AND array_contains(CAST(:intervention_flags AS ARRAY<STRING>), k.record_id)))),
steps AS (
  SELECT a.action_id, a.action_type_c, a.user_id, max(a.action_dttm_local) AS at FROM {ord_act_ot} a
  WHERE a.action_type_c IN (:entered, :filled, :verified) AND a.action_id IN (SELECT action_id FROM linked)
  GROUP BY a.action_id, a.action_type_c, a.user_id),
actions AS (
  SELECT s.action_id,
         max(CASE WHEN s.action_type_c = :entered AND e.epic_emp_id IS NOT NULL THEN s.at END) AS entered_dttm,
         max(CASE WHEN s.action_type_c = :entered THEN e.name END) AS entered_user,
         max(CASE WHEN s.action_type_c = :filled AND e.epic_emp_id IS NOT NULL THEN s.at END) AS filled_dttm,
         max(CASE WHEN s.action_type_c = :filled THEN e.name END) AS filled_user,
         max(CASE WHEN s.action_type_c = :verified AND e.epic_emp_id IS NOT NULL THEN s.at END) AS verified_dttm,
         max(CASE WHEN s.action_type_c = :verified THEN e.name END) AS verified_user
  FROM steps s LEFT JOIN {clarity_emp} e ON e.epic_emp_id = s.user_id
  GROUP BY s.action_id
  HAVING bool_or(s.action_type_c = :verified) AND bool_or(e.epic_emp_id IS NOT NULL))
SELECT max(pharmacy_name) AS pharmacy_name, max(rx_num_formatted_hx) AS rx_number, fill_number, max(pharmacy_id) AS pharmacy_id,
       max(entered_dttm) AS entered_dttm, max(entered_user) AS entered_user, max(filled_dttm) AS filled_dttm, max(filled_user) AS filled_user,
       max(verified_dttm) AS verified_dttm, max(verified_user) AS verified_user, max(action_id) AS action_id,
       concat(coalesce(CAST(order_med_id AS STRING), ''), '-', coalesce(CAST(fill_number AS STRING), '')) AS order_med_id
FROM linked JOIN actions USING (action_id)
GROUP BY linked.order_med_id, fill_number
"""


def turnaround_detail(spark: SparkSession, tables: Mapping[str, DataFrame], start, end, pharmacies: Sequence | None = None,
                      flags: Sequence[str] | None = None, report_option: str | None = None,
                      service_areas: Sequence = K.TURNAROUND_SERVICE_AREAS) -> DataFrame:
    """``TURNAROUND_DETAIL`` with the parameters of ``turnaround.tat_detail``; an option left empty means both kinds."""
    option = "" if report_option is None else str(report_option).strip()
    return run_sql(spark, TURNAROUND_DETAIL, tables, {
        "start_ts": str(start), "end_ts": str(end), "report_option": option or "1",
        "pharmacies": list_parameter(pharmacies), "flags": list_parameter(flags),
        "service_areas": list_parameter(as_numbers(service_areas)),
        "intervention_flags": list_parameter(K.INTERVENTION_FLAG_IDS),
        "ordering_mode": K.OUTPATIENT_ORDERING_MODE, "excluded_status": K.EXCLUDED_FILL_STATUS,
        "entered": K.ACTION_ENTERED, "filled": K.ACTION_FILLED, "verified": K.ACTION_VERIFIED})
