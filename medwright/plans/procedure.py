"""The daily load as a SQL procedure: variables, a handler that logs and re-raises.

Spark SQL scripting runs the steps on catalog tables as one compound statement. Its parameters
are bound as markers (load date, run time, table names); its variables carry the row counts from step to
step and into the audit log. The target is a view over its newest snapshot table and moves as the last step, so
an error anywhere leaves it as it was. An error jumps to the handler, which logs a Failed row with the
counts reached, drops what the run made and raises again.

The load is the one of ``plans.load``: closed date slice, one row per key by one aggregation
instead of a window, an upsert on the key alone that keeps creation times, NULL keys matching nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..functions.dates import _as_date
from .load import LOG_SCHEMA

FAILED_MESSAGE = "The load failed; its row in the audit log has the counts it reached."


def _name(text: str) -> str:
    """A plain identifier, dotted or not: names also go into statement text, values never do."""
    if not re.fullmatch(r"\w+(\.\w+)*", text):
        raise ValueError(f"not a plain identifier: {text!r}")
    return text


def load_script(key: str, value_cols: Sequence[str], order: Sequence[str], date_col: str) -> str:
    """The procedure's text for a table of ``key`` and ``value_cols``.

    Markers are literals, their types are given in the text. They are: source, target, log, stage, kept, snapshot (table names), procedure, load_date, run_ts and
    max_length (longest value allowed, NULL for any).
    """
    key, date_col, values, order = _name(key), _name(date_col), [_name(c) for c in value_cols], [_name(c) for c in order]
    packed = ", ".join([*order, *[c for c in values if c not in order]])
    first = ", ".join(f"top.{c} AS {c}" for c in values)
    taken = ", ".join(f"CASE WHEN s.hit THEN s.{c} ELSE t.{c} END AS {c}" for c in (key, *values))
    too_long = " OR ".join(f"length(CAST({c} AS STRING)) > CAST(:max_length AS INT)" for c in values)
    log = """INSERT INTO IDENTIFIER(:log)
        SELECT :procedure, :load_date, rows_staged, CASE WHEN rows_kept > 0 THEN rows_staged - rows_kept ELSE 0 END, rows_kept, '{status}', CAST(:run_ts AS TIMESTAMP_NTZ)"""
    return f"""
    BEGIN
      DECLARE rows_staged BIGINT DEFAULT 0;
      DECLARE rows_kept BIGINT DEFAULT 0;
      DECLARE EXIT HANDLER FOR SQLEXCEPTION
      BEGIN
        {log.format(status=K.STATUS_FAILED)};
        DROP TABLE IF EXISTS IDENTIFIER(:stage);
        DROP TABLE IF EXISTS IDENTIFIER(:kept);
        DROP TABLE IF EXISTS IDENTIFIER(:snapshot);
        SELECT raise_error(:failed_message);
      END;

      CREATE TABLE IDENTIFIER(:stage) USING parquet AS
        SELECT * FROM IDENTIFIER(:source) WHERE {date_col} BETWEEN :load_date AND date_add(:load_date, 1);
      SET rows_staged = (SELECT count(*) FROM IDENTIFIER(:stage));

      IF :max_length IS NOT NULL AND EXISTS (SELECT 1 FROM IDENTIFIER(:stage) WHERE {too_long}) THEN
        SELECT raise_error(:gate_message);
      END IF;

      CREATE TABLE IDENTIFIER(:kept) USING parquet AS
        SELECT {key}, {first} FROM (SELECT {key}, max(struct({packed})) AS top FROM IDENTIFIER(:stage) GROUP BY {key});
      SET rows_kept = (SELECT count(*) FROM IDENTIFIER(:kept));

      CREATE TABLE IDENTIFIER(:snapshot) USING parquet AS
        SELECT {taken}, CASE WHEN t.known THEN t.createddatetime ELSE CAST(:run_ts AS TIMESTAMP_NTZ) END AS createddatetime,
               CASE WHEN s.hit THEN CAST(:run_ts AS TIMESTAMP_NTZ) ELSE t.lastupdateddatetime END AS lastupdateddatetime
        FROM (SELECT *, true AS known FROM IDENTIFIER(:target)) t
        FULL JOIN (SELECT *, true AS hit FROM IDENTIFIER(:kept)) s ON s.{key} = t.{key};
      {log.format(status=K.STATUS_SUCCESS)};
      EXECUTE IMMEDIATE 'CREATE OR REPLACE VIEW ' || :target || ' AS SELECT * FROM ' || :snapshot;

      DROP TABLE IDENTIFIER(:stage);
      DROP TABLE IDENTIFIER(:kept);
    END"""


class LoadProcedure:
    """The procedure over a target view and a log table of the catalog.

    ``create`` sets both up; ``call`` runs one load. ``source`` is any table or view.
    """

    def __init__(self, spark: SparkSession, source: str, target: str, log: str, key: str = "patientid", value_cols: Sequence[str] = ("wicresult",),
                 order: Sequence[str] = ("wicresultdate", "wicresult"), date_col: str = "wicresultdate"):
        self.spark, self.source, self.target, self.log = spark, _name(source), _name(target), _name(log)
        self.text = load_script(key, value_cols, order, date_col)

    def _fresh(self, kind: str) -> str:
        return f"{self.target}_{kind}_{uuid.uuid4().hex}"

    def create(self, first: DataFrame) -> None:
        """The target with the rows of ``first`` and an empty audit log."""
        snapshot = self._fresh("snap")
        first.write.format("parquet").saveAsTable(snapshot)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.target} AS SELECT * FROM {snapshot}")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.log} ({columns}) USING parquet")

    def call(self, load_date, run_ts, max_length: int | None = None) -> None:
        """Run the load; an error is logged, then raised."""
        self.spark.sql(self.text, args={
            "source": self.source, "target": self.target, "log": self.log,
            "stage": self._fresh("stage"), "kept": self._fresh("kept"), "snapshot": self._fresh("snap"),
            "procedure": K.LOAD_PROCEDURE_NAME, "load_date": _as_date(load_date), "run_ts": str(run_ts),
            "max_length": max_length, "gate_message": K.SCHEMA_GATE_MESSAGE, "failed_message": FAILED_MESSAGE})
