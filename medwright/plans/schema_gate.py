"""Vendor schema gate (Q5): compare an expected schema table with a source's
actual columns and fail the load before any data is written.

The expected schema is data (IO11, IO12). The actual columns (IO13) come
from the source DataFrame: names and types from its schema, and string
lengths *measured* over the data in one distributed aggregation, because
Parquet files carry no declared ``varchar(n)``. For catalog tables pass
``declared_lengths(df)``, which reads the declared lengths, and use
``length_rule="declared"`` (the report's ``<>`` test); for files the rule is "observed length exceeds
the expected maximum".

Matching on schema, table and column names ignores case, as the usual
SQL Server collation does. Extra vendor columns do not fail the gate (K30);
``extra_columns`` lists them.

``InPlanGate`` is the gate as part of the write it guards: what the source's schema shows is
checked before a row is read, and value lengths while the rows are written, so the source is
not scanned a second time and nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

EXPECTED_SCHEMA = T.StructType([
    T.StructField("source_name", T.StringType()), T.StructField("table_schema", T.StringType()),
    T.StructField("table_name", T.StringType()), T.StructField("column_name", T.StringType()),
    T.StructField("expected_data_type", T.StringType()), T.StructField("expected_max_length", T.IntegerType()),
    T.StructField("is_required", T.BooleanType()),
])

# Spark type name -> SQL Server type name used in expected-schema tables.
SQL_TYPE_NAMES = {
    "tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "real",
    "double": "float", "string": "varchar", "boolean": "bit", "date": "date", "timestamp": "datetime2",
    "timestamp_ntz": "datetime2", "binary": "varbinary",
}


class SchemaMismatch(RuntimeError):
    """Raised by :func:`assert_schema`; ``details`` holds the failing rows."""

    def __init__(self, message: str, details: list):
        super().__init__(message)
        self.details = details


def expected_schema(spark: SparkSession, rows: Iterable[tuple] = K.VENDOR_EXPECTED_SCHEMA) -> DataFrame:
    """The expected-schema table as a DataFrame (created once, then stored)."""
    return spark.createDataFrame(list(rows), EXPECTED_SCHEMA)


def sql_type_name(dtype: T.DataType) -> str:
    name = dtype.simpleString()
    if name.startswith("decimal"):
        return "decimal"
    if name.startswith(("varchar", "char")):
        return name.split("(")[0]
    return SQL_TYPE_NAMES.get(name, name)


def declared_lengths(df: DataFrame) -> dict[str, int]:
    """Declared ``char(n)``/``varchar(n)`` lengths of a catalog table's columns.

    Spark reads such columns as strings and keeps the declared type in the
    field's metadata; files carry none, so the result is empty for them.
    """
    found = {f.name: re.fullmatch(r"(?:var)?char\((\d+)\)", f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")) for f in df.schema.fields}
    return {name: int(m[1]) for name, m in found.items() if m}


def actual_columns(df: DataFrame, table_schema: str, table_name: str,
                   declared_lengths: Mapping[str, int] | None = None) -> DataFrame:
    """One row per source column: schema, table, column, SQL type name and
    character length (declared if given, else the longest value present)."""
    fields = df.schema.fields
    measured = [f.name for f in fields if isinstance(f.dataType, T.StringType) and not declared_lengths]
    lengths = df.agg(*[F.max(F.length(F.col(c))).alias(c) for c in measured]) if measured else None
    entries = []
    for f in fields:
        if declared_lengths and f.name in declared_lengths:
            length = F.lit(declared_lengths[f.name])
        elif f.name in measured:
            length = F.col(f"`{f.name}`")
        else:
            length = F.lit(None)
        entries.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(sql_type_name(f.dataType)).alias("data_type"),
                                length.cast("int").alias("character_maximum_length")))
    base = lengths if lengths is not None else df.sparkSession.range(1)
    return (base.select(F.explode(F.array(*entries)).alias("c"))
            .select(F.lit(table_schema).alias("table_schema"), F.lit(table_name).alias("table_name"), "c.*"))


def validate_schema(expected: DataFrame, actual: DataFrame, source_name: str = K.VENDOR_SOURCE_NAME,
                    length_rule: str = "observed") -> DataFrame:
    """Per required expected column: what was found and whether it fails."""
    exp = expected.filter((F.col("source_name") == source_name) & F.col("is_required"))
    act = actual.select(*[F.col(c).alias(f"actual_{c}") for c in actual.columns])
    key = lambda a, b: F.lower(F.col(a)) == F.lower(F.col(b))
    joined = exp.join(act, key("table_schema", "actual_table_schema") & key("table_name", "actual_table_name")
                      & key("column_name", "actual_column_name"), "left")
    missing = F.col("actual_column_name").isNull()
    wrong_type = F.col("actual_data_type") != F.col("expected_data_type")
    if length_rule == "declared":
        bad_len = F.col("actual_character_maximum_length") != F.col("expected_max_length")
    else:
        bad_len = F.col("actual_character_maximum_length") > F.col("expected_max_length")
    wrong_len = F.col("expected_max_length").isNotNull() & bad_len
    return joined.select(
        "table_schema", "table_name", "column_name", "expected_data_type",
        F.col("actual_data_type"), "expected_max_length",
        F.col("actual_character_maximum_length").alias("actual_max_length"),
        missing.alias("is_missing"), F.coalesce(wrong_type, F.lit(False)).alias("is_wrong_type"),
        F.coalesce(wrong_len, F.lit(False)).alias("is_wrong_length"),
        F.coalesce(missing | wrong_type | wrong_len, F.lit(False)).alias("is_mismatch"))


def mismatch_count(detail: DataFrame) -> DataFrame:
    """``SELECT @MismatchCount = COUNT(*) ..`` as a one-row DataFrame."""
    return detail.agg(F.count_if(F.col("is_mismatch")).alias("mismatch_count"))


def extra_columns(expected: DataFrame, actual: DataFrame, source_name: str = K.VENDOR_SOURCE_NAME) -> DataFrame:
    """Vendor columns the expected schema does not know (warnings only)."""
    exp = expected.filter(F.col("source_name") == source_name).select(
        F.lower("table_schema").alias("s"), F.lower("table_name").alias("t"), F.lower("column_name").alias("c"))
    act = actual.withColumn("s", F.lower("table_schema")).withColumn("t", F.lower("table_name")) \
        .withColumn("c", F.lower("column_name"))
    return act.join(exp, ["s", "t", "c"], "left_anti").drop("s", "t", "c")


def assert_schema(expected: DataFrame, actual: DataFrame, source_name: str = K.VENDOR_SOURCE_NAME,
                  length_rule: str = "observed") -> None:
    """Raise :class:`SchemaMismatch` when any required column fails."""
    detail = validate_schema(expected, actual, source_name, length_rule)
    bad = detail.filter("is_mismatch").collect()  # at most one row per expected column
    if bad:
        raise SchemaMismatch(K.SCHEMA_GATE_MESSAGE, [r.asDict() for r in bad])


class InPlanGate:
    """The gate inside the plan of a write.

        gate = InPlanGate(expected_rows)
        gate.over(rows).write.parquet(stage)    # the write itself runs the checks
        gate.verify()                           # raises if rows failed

    ``expected`` are expected-schema rows (as in ``constants.VENDOR_EXPECTED_SCHEMA``).
    ``over`` raises at once for missing columns and wrong types. Lengths are checked value by value:
    with ``fail="count"`` the write goes on and an ``Observation`` counts the bad rows of each
    column, which ``verify`` reports, all of them; with ``fail="first"`` a guarded column is only readable through a check
    that raises, so the first bad value fails its task and with it the write.
    """

    def __init__(self, expected: Iterable[tuple] = K.VENDOR_EXPECTED_SCHEMA, source_name: str = K.VENDOR_SOURCE_NAME, fail: str = "count"):
        if fail not in ("count", "first"):
            raise ValueError("fail must be 'count' or 'first'")
        names = EXPECTED_SCHEMA.fieldNames()
        self.expected = [e for e in (dict(zip(names, row)) for row in expected) if e["source_name"] == source_name and e["is_required"]]
        self.fail = fail
        self._seen: Observation | None = None

    def _limits(self, df: DataFrame) -> dict[str, int]:
        actual = {f.name.lower(): f for f in df.schema.fields}
        wrong = []
        for e in self.expected:
            field = actual.get(e["column_name"].lower())
            if field is None or sql_type_name(field.dataType) != e["expected_data_type"]:
                wrong.append({"column_name": e["column_name"], "is_missing": field is None, "expected_data_type": e["expected_data_type"],
                              "actual_data_type": field and sql_type_name(field.dataType)})
        if wrong:
            raise SchemaMismatch(K.SCHEMA_GATE_MESSAGE, wrong)
        return {actual[e["column_name"].lower()].name: e["expected_max_length"] for e in self.expected if e["expected_max_length"] is not None}

    def over(self, df: DataFrame) -> DataFrame:
        """``df`` with the checks in its plan; same rows, same columns."""
        limits = self._limits(df)
        if not limits:
            return df
        if self.fail == "first":
            for name, most in limits.items():
                c = F.col(f"`{name}`")
                said = F.concat(F.lit(f"{K.SCHEMA_GATE_MESSAGE} {name}: "), F.length(c).cast("string"), F.lit(f" characters, at most {most} expected"))
                df = df.withColumn(name, F.when(F.length(c) > most, F.raise_error(said).cast(df.schema[name].dataType)).otherwise(c))
            return df
        self._seen = Observation(f"gate-{id(self)}")
        return df.observe(self._seen, *[F.count_if(F.length(F.col(f"`{name}`")) > most).alias(name) for name, most in limits.items()])

    def counts(self) -> dict[str, int]:
        """Bad rows by column, once the write has run."""
        return dict(self._seen.get) if self._seen else {}

    def verify(self) -> None:
        bad = [{"column_name": name, "bad_rows": n} for name, n in self.counts().items() if n]
        if bad:
            raise SchemaMismatch(K.SCHEMA_GATE_MESSAGE, bad)
