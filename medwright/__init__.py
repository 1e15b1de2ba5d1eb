"""medwright: clinical reporting and ETL pipelines expressed as Spark DataFrame plans.

Subpackages
-----------
functions   Column expressions (date arithmetic with SQL-Server counting rules,
            null-as-empty concatenation, percentage text, code-prefix matching).
operators   DataFrame operators (latest-row-per-key, conditional pivots, aligned
            string lists, integer averages, role-aliased dimension joins).
plans       End-to-end reports and loads (measures, medication safety, pharmacy
            turnaround, dispensing/payer detail, lab outreach, incremental load,
            vendor schema gate).
sources     CSV extracts, snapshot publishing and audit logs.
testing     Clinical views over the supplied test tables, the DuckDB oracle
            and the registry behind ``__spark_entry__``.
cli         ``python -m medwright <report> --tables … --out …``.
"""

__version__ = "0.1.0"
