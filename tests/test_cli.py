"""The command line runs a report over a directory of Parquet tables."""
from medwright import cli
from medwright.plans import dispense, turnaround
from medwright.session import shared_dir
from medwright.testing import oracle
from medwright.testing.testmap import tables_for

from .conftest import SF_SMALL


def _write_tables(spark, tables: dict) -> str:
    root = shared_dir(spark, "cli-tables")
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
    return root


def test_parse_params():
    p = cli.parse_params(["service_areas=9503,10", "flags=90024,90025", "days=30", "null_as_zero=true",
                          'rules=[{"pos_ids": [1], "excluded_payors": ["X"]}]', "as_of=2024-01-16",
                          "age_range=18,75", "threshold=7.5", "service_area=9503"])
    assert p == {"service_areas": [9503, 10], "flags": ["90024", "90025"], "days": 30, "null_as_zero": True,
                 "rules": [{"pos_ids": [1], "excluded_payors": ["X"]}], "as_of": "2024-01-16",
                 "age_range": [18, 75], "threshold": 7.5, "service_area": 9503}


def test_cli_turnaround_and_dispense(spark):
    t = tables_for(spark, SF_SMALL)
    tat = oracle.TAT
    root = _write_tables(spark, t.tat_tables())
    out = cli.main(["turnaround", "--tables", root, "--out", shared_dir(spark, "cli-out"),
                    "--param", f"start={tat['start']}", "--param", f"end={tat['end']}",
                    "--param", "report_option=2", "--param", "display_names=true"], spark=spark)
    back = spark.read.option("header", True).csv(out)
    direct = turnaround.turnaround_report(t.tat_tables(), tat["start"], tat["end"], report_option="2", cache=False)
    assert back.count() == direct.count() > 0 and back.columns[0] == "Pharmacy_Name"

    d = oracle.DISPENSE
    root = _write_tables(spark, t.dispense_tables())
    out = cli.main(["dispense-payer", "--tables", root, "--out", shared_dir(spark, "cli-out"), "--single-file",
                    "--param", f"as_of={d['as_of']}", "--param", "npis=" + ",".join(d["npis"]),
                    "--param", "days=365"], spark=spark)
    direct = dispense.dispense_payer_detail(t.dispense_tables(), d["as_of"], d["npis"], days=365)
    assert spark.read.option("header", True).csv(out).count() == direct.count() > 0
