"""Readings up to what the tables' DECIMAL(14,2) hold are loaded."""
from sitelens.operators.electricity import clean_electricity


def test_large_readings_are_kept(spark):
    def meter(name, values):
        return [(name, "x", f"2021-{k + 1:02d}", v) for k, v in enumerate(values)]

    raw = meter("A", ["1000000000", "1000000000000", "-5000000000"]) + meter("C", ["999999999999.99"])
    # Median 900,000,000,000: 950,000,000 repaired fits, 1,900,000,000 (taken as 1.9 * 10**12) does not.
    raw += meter("B", ["900000000000"] * 5 + ["950000000", "1900000000"])
    rows = [(1, n + 2, *r, "kWh") for n, r in enumerate(raw)]
    df = spark.createDataFrame(rows, "company_id int, source_row_number bigint, meter_id string, meter_description string, "
                                     "period string, consumption string, unit string")
    result = clean_electricity(df)
    got = sorted((r.meter_id, float(r.consumption_kwh)) for r in result.facts.collect())
    assert got == sorted([("A", 1e9), ("C", 999999999999.99), ("A", -5e9), *[("B", 9e11)] * 5, ("B", 9.5e11)])
    rejected = [r.source_row_number for r in result.issues.where("action = 'rejected'").collect()]
    assert sorted(rejected) == [3, 12]
