"""DuckDB SQL for the projected inputs and for the tables the operators should yield.

``CTES`` maps a name to (needed names, body). ``query`` assembles a statement.
"""

from __future__ import annotations

from registered.inputs import AREA_NAMES, FACTORS, WORDS
from sitelens.operators.rules import CATALOGUE
from sitelens.sources.reference import FACTOR_KEY_BY_ACTIVITY, INCIDENT_TYPES, SITE_AREAS


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(v if isinstance(v, str) and v.startswith("CAST(") else
                                     (str(v) if isinstance(v, int) else text(v)) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def array(items) -> str:
    return "[" + ", ".join(text(x) for x in items) + "]"


SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8239) || chr(12288) || chr(65279)"


def trim(c: str) -> str:
    return f"trim({c}, {SPACES})"


def plain(c: str) -> str:
    return rf"CASE WHEN contains(CAST({c} AS VARCHAR), '.') THEN regexp_replace(CAST({c} AS VARCHAR), '\.?0+$', '') ELSE CAST({c} AS VARCHAR) END"


def date_value(t: str) -> str:
    return rf"""CASE WHEN regexp_full_match({t}, '\d{{4}}-\d{{2}}-\d{{2}}') THEN TRY_CAST({t} AS DATE)
      WHEN regexp_full_match({t}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN CAST(try_strptime({t}, '%d/%m/%Y') AS DATE)
      WHEN regexp_full_match({t}, '[A-Za-z]{{3,9}}-\d{{2}}')
        THEN CAST(try_strptime('01 ' || substr({t}, 1, 3) || ' 20' || right({t}, 2), '%d %b %Y') AS DATE) END"""


def date_layout(t: str) -> str:
    return rf"""CASE WHEN regexp_full_match({t}, '\d{{4}}-\d{{2}}-\d{{2}}') THEN 'iso'
      WHEN regexp_full_match({t}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN 'day-first-slash'
      WHEN regexp_full_match({t}, '[A-Za-z]{{3,9}}-\d{{2}}') THEN 'month-year' END"""


NUMBER = r"'[+-]?(\d+\.?\d*|\.\d+)'"


def pct(actual: str, base: str) -> str:
    return f"CASE WHEN {base} = 0 AND outage_month IS NOT NULL THEN 0.0 ELSE floor(({actual} - {base}) / {base} * 100.0 * 10 + 0.5) / 10 END"


def issue(rule: str, source: str, where: str, key: str = "NULL", field: str | None = None, line: str = "source_row_number",
          original: str = "NULL", resolved: str = "NULL", severity: str | None = None, action: str | None = None) -> str:
    r = next(x for x in CATALOGUE if x.rule_id == rule)
    return f"""SELECT company_id, '{rule}' AS rule_id, '{r.source_file}' AS source_file,
      CAST({line} AS BIGINT) AS source_row_number, CAST({key} AS VARCHAR) AS record_key,
      CAST({text(field)} AS VARCHAR) AS field, '{severity or r.default_severity}' AS severity,
      '{action or r.default_action}' AS action, CAST({original} AS VARCHAR) AS original_value,
      CAST({resolved} AS VARCHAR) AS resolved_value FROM {source} WHERE {where}"""


def outliers(source: str, value: str, key: str = "company_id", carry: str = "month") -> str:
    """Robust outlier columns over a short series."""
    return f"""SELECT s.{key}, s.{carry}, s.{value}, m.med AS median_value, d.mad,
      CASE WHEN d.mad = 0 THEN 0.0 ELSE 0.6745 * (s.{value} - m.med) / d.mad END AS modified_z,
      CASE WHEN m.med = 0 THEN false ELSE abs(CASE WHEN d.mad = 0 THEN 0.0 ELSE 0.6745 * (s.{value} - m.med) / d.mad END) > 3.5
        AND abs(s.{value} - m.med) / m.med >= 0.2 END AS is_outlier
      FROM (SELECT {key}, {carry}, CAST({value} AS DOUBLE) AS {value} FROM {source}) s
      JOIN (SELECT {key}, median(CAST({value} AS DOUBLE)) AS med FROM {source} GROUP BY 1) m USING ({key})
      JOIN (SELECT a.{key}, median(abs(CAST(a.{value} AS DOUBLE) - b.med)) AS mad FROM {source} a
        JOIN (SELECT {key}, median(CAST({value} AS DOUBLE)) AS med FROM {source} GROUP BY 1) b USING ({key}) GROUP BY 1) d USING ({key})"""


_sign = "CASE WHEN l_returnflag = 'R' AND l_discount > 0.095 THEN '-' ELSE '' END"
_litres = "CAST(l_quantity * 1000 AS BIGINT)"
_price = "CAST(l_extendedprice AS DECIMAL(14,2))"
_known = "(" + ", ".join(text(n) for n, _ in SITE_AREAS) + ")"
_codes = "(" + ", ".join(text(c) for c, _ in INCIDENT_TYPES) + ")"
_names = {k: a for a, k in FACTOR_KEY_BY_ACTIVITY.items()}
_written = "quantity || ' ' || unit"
_head = "company_id, source_row_number"

CTES: dict[str, tuple[list[str], str]] = {
    "factors": ([], values([(k, _names[k], s, u, f"CAST({r} AS DECIMAL(10,4))") for k, s, u, r in FACTORS],
                           "factor_key, activity, scope, unit, kg_co2e_per_unit")),
    "areas": ([], values(SITE_AREAS, "name, category")),
    "types": ([], values(INCIDENT_TYPES, "code, label")),
    "rules": ([], values([tuple(r) for r in CATALOGUE], "rule_id, title, source_file, category, default_severity, default_action, rationale")),

    # ------------------------------------------------------------------ fuel
    "fuel_dated": ([], """SELECT *, CASE WHEN date_trunc('month', moved) = DATE '2021-05-01'
        THEN CAST(moved + INTERVAL 1 MONTH AS DATE) ELSE moved END AS sd
      FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) + INTERVAL 276 MONTH AS DATE) AS moved FROM lineitem)"""),
    "fuel_raw": (["fuel_dated"], f"""SELECT l_suppkey % 5 AS company_id,
      (l_orderkey * 8 + l_linenumber) * 16777216 + CAST(round(l_extendedprice * 100) AS BIGINT) AS source_row_number,
      'INV-' || l_orderkey AS invoice_no,
      CASE WHEN l_partkey % 89 = 0 THEN '' WHEN l_partkey % 97 = 0 THEN strftime(sd, '%m/%d/%Y')
        WHEN l_orderkey % 3 = 0 THEN strftime(sd, '%Y-%m-%d') WHEN l_orderkey % 3 = 1 THEN strftime(sd, '%d/%m/%Y')
        ELSE strftime(sd, '%b-%y') END AS delivery_date,
      CASE WHEN l_partkey % 53 = 0 THEN 'Kerosene' WHEN l_returnflag = 'N' THEN 'Petrol (ULP)' ELSE 'Diesel' END AS fuel_type,
      CASE WHEN l_partkey % 83 = 0 THEN '0' ELSE {_sign} || CASE l_linenumber % 4
        WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 1 THEN format('{{:,}}', {_litres})
        WHEN 2 THEN CAST({_litres} AS VARCHAR) ELSE {_litres} || '.5' END END AS quantity,
      CASE WHEN l_partkey % 71 = 0 THEN 'drum' ELSE CASE l_linenumber % 4 WHEN 0 THEN 'kL' WHEN 1 THEN 'L'
        WHEN 2 THEN 'litres' ELSE 'Litres' END END AS unit,
      CASE WHEN l_tax > 0.075 THEN '' WHEN l_partkey % 101 = 0 THEN 'N/A'
        WHEN l_linenumber % 2 = 1 THEN '$' || {_sign} || format('{{:,.2f}}', l_extendedprice)
        ELSE {_sign} || {_price} END AS cost,
      ({array(AREA_NAMES)})[(l_suppkey % 8) + 1] AS site_area FROM fuel_dated"""),
    "fuel_parsed": (["fuel_raw"], rf"""SELECT *,
      CASE WHEN date IS NULL THEN 'date' WHEN number IS NULL OR number = 0 OR factor IS NULL THEN 'quantity'
        WHEN fuel_type NOT IN ('Diesel', 'Petrol (ULP)') THEN 'fuel_type' END AS early,
      CAST(floor(number * factor * 100 + 0.5) / 100 AS DECIMAL(14,2)) AS litres,
      CASE WHEN regexp_full_match(cost, '-?\$?-?[\d,]+(\.\d+)?') THEN
        TRY_CAST(regexp_replace(cost, '[$,\-]', '', 'g') AS DECIMAL(14,2)) * CASE WHEN contains(cost, '-') THEN -1 ELSE 1 END END AS cost_aud
      FROM (SELECT *, {date_value('delivery_date')} AS date, {date_layout('delivery_date')} AS date_format,
        CASE WHEN regexp_full_match(replace(quantity, ',', ''), {NUMBER})
          THEN CAST(replace(quantity, ',', '') AS DECIMAL(18,3)) END AS number,
        CASE lower(unit) WHEN 'l' THEN 1 WHEN 'litres' THEN 1 WHEN 'kl' THEN 1000 END AS factor FROM fuel_raw)"""),
    "fuel_rows": (["fuel_parsed"], """SELECT p.*,
      CASE WHEN early IS NOT NULL THEN early WHEN rn > 1 THEN 'duplicate' END AS reject,
      o.first_line, o.first_sig = concat_ws('|', delivery_date, fuel_type, quantity, unit, cost, site_area) AS same_row
      FROM fuel_parsed p
      LEFT JOIN (SELECT company_id, source_row_number,
          row_number() OVER w AS rn, first(source_row_number) OVER w AS first_line,
          first(concat_ws('|', delivery_date, fuel_type, quantity, unit, cost, site_area)) OVER w AS first_sig
        FROM fuel_parsed WHERE early IS NULL
        WINDOW w AS (PARTITION BY company_id, invoice_no ORDER BY source_row_number
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) o USING (company_id, source_row_number)"""),
    "fuel_facts": (["fuel_rows"], """SELECT company_id, source_row_number, invoice_no, date AS delivery_date,
      CASE date_format WHEN 'month-year' THEN 'month' ELSE 'day' END AS date_precision, fuel_type,
      CASE fuel_type WHEN 'Diesel' THEN 'diesel' ELSE 'petrol_ulp' END AS factor_key,
      litres AS quantity_l, cost_aud, site_area, litres < 0 AS is_credit_note, delivery_date AS original_date,
      quantity AS original_quantity, unit AS original_unit, nullif(cost, '') AS original_cost
      FROM fuel_rows WHERE reject IS NULL"""),
    "fuel_months": (["fuel_rows"], """SELECT company_id, CAST(date_trunc('month', date) AS DATE) AS month,
      sum(greatest(litres, 0)) AS litres FROM fuel_rows WHERE reject IS NULL GROUP BY 1, 2"""),
    "fuel_spikes": (["fuel_months"], outliers("fuel_months", "litres")),
    "fuel_gaps": (["fuel_months"], """SELECT company_id, lo AS first_month, hi AS last_month, month FROM (
        SELECT company_id, min(month) AS lo, max(month) AS hi,
          unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM fuel_months GROUP BY 1)
      ANTI JOIN fuel_months USING (company_id, month)"""),
    "fuel_formats": (["fuel_rows"], """SELECT *, CAST(iso > 0 AS INT) + CAST(day_first_slash > 0 AS INT) + CAST(month_year > 0 AS INT) AS date_formats
      FROM (SELECT company_id,
        count(*) FILTER (WHERE date IS NOT NULL AND date_format = 'iso') AS iso,
        count(*) FILTER (WHERE date IS NOT NULL AND date_format = 'day-first-slash') AS day_first_slash,
        count(*) FILTER (WHERE date IS NOT NULL AND date_format = 'month-year') AS month_year,
        count(*) FILTER (WHERE reject IS DISTINCT FROM 'date' AND reject IS DISTINCT FROM 'quantity'
          AND cost_aud IS NOT NULL AND regexp_matches(cost, '[$,]')) AS formatted_costs,
        count(*) FILTER (WHERE reject IS NULL) AS loaded_rows FROM fuel_rows GROUP BY 1)"""),
    "fuel_issues": (["fuel_rows", "fuel_formats", "fuel_spikes", "fuel_gaps"], " UNION ALL ".join([
        issue("FUEL-FORMAT-01", "fuel_rows", "reject = 'date'", "invoice_no", "Delivery Date", original="delivery_date",
              severity="error", action="rejected"),
        issue("FUEL-DATE-PRECISION-01", "fuel_rows", "date IS NOT NULL AND date_format = 'month-year'", "invoice_no",
              "Delivery Date", original="delivery_date"),
        issue("FUEL-FORMAT-01", "fuel_rows", "reject = 'quantity'", "invoice_no", "Quantity", original=_written,
              severity="error", action="rejected"),
        issue("FUEL-UNIT-KL-01", "fuel_rows", "coalesce(reject, '') NOT IN ('date', 'quantity') AND factor = 1000", "invoice_no",
              "Quantity", original=_written, resolved=f"({plain('litres')}) || ' L'"),
        issue("FUEL-FORMAT-01", "fuel_rows", "coalesce(reject, '') NOT IN ('date', 'quantity') AND cost <> '' AND cost_aud IS NULL",
              "invoice_no", "Cost (AUD)", original="cost", severity="warning", action="flagged"),
        issue("FUEL-CREDIT-01", "fuel_rows", "coalesce(reject, '') NOT IN ('date', 'quantity') AND litres < 0", "invoice_no",
              "Quantity", original=_written),
        issue("FUEL-PRICE-01", "fuel_rows", """coalesce(reject, '') NOT IN ('date', 'quantity') AND cost_aud IS NOT NULL
              AND NOT (CAST(cost_aud AS DOUBLE) / CAST(litres AS DOUBLE) BETWEEN 1.0 AND 3.0)""",
              "invoice_no", "Quantity", original=f"{_written} || ' for ' || cost"),
        issue("FUEL-FORMAT-01", "fuel_rows", "reject = 'fuel_type'", "invoice_no", "Fuel Type", original="fuel_type",
              severity="error", action="rejected"),
        issue("FUEL-DUP-01", "fuel_rows", "reject = 'duplicate'", "invoice_no", "Invoice No", original="invoice_no"),
        issue("FUEL-SITE-UNKNOWN-01", "fuel_rows", f"reject IS NULL AND site_area NOT IN {_known}", "invoice_no", "Site Area",
              original="site_area"),
        issue("FUEL-SITE-FLEET-01", "fuel_rows", "reject IS NULL AND site_area = 'Light Vehicles' AND fuel_type = 'Diesel'",
              "invoice_no", "Site Area", original="site_area"),
        issue("FUEL-FORMAT-01", "fuel_formats", "date_formats > 1 OR formatted_costs > 0", line="NULL",
              original="date_formats || ' date formats, ' || formatted_costs || ' formatted costs'",
              resolved="'ISO dates, numeric costs'"),
        issue("FUEL-VOLUME-SPIKE-01", "fuel_spikes", "is_outlier AND litres > median_value", "month", "Quantity", "NULL",
              "CAST(round(CAST(litres AS DECIMAL(18,2)), 0) AS BIGINT) || ' L'"),
        issue("FUEL-MONTH-GAP-01", "fuel_gaps", "true", "strftime(month, '%Y-%m')", "Delivery Date", "NULL", "'0 deliveries'"),
    ])),

    # ----------------------------------------------------------- electricity
    "power_raw": ([], """SELECT company_id, source_row_number, 'MTR-0' || n AS meter_id, meter_description,
      CASE WHEN o_orderkey % 199 = 0 THEN '2021/13' ELSE strftime(m, '%Y-%m') END AS period,
      CASE WHEN o_orderkey % 211 = 0 THEN 'n/a' ELSE CAST(CASE
        WHEN n = 7 AND m >= DATE '2022-01-01' THEN CAST(round(price * 0.001, 2) AS DECIMAL(14,2))
        WHEN m = DATE '2021-03-01' THEN CAST(round(price * 0.25, 2) AS DECIMAL(14,2)) ELSE price END AS VARCHAR) END AS consumption,
      'kWh' AS unit
      FROM (SELECT o_orderkey, o_custkey % 5 AS company_id, o_orderkey + 2 AS source_row_number,
        CASE WHEN (o_custkey // 5) % 6 = 5 THEN 7 ELSE (o_custkey // 5) % 6 + 1 END AS n,
        'Feeder ' || o_orderpriority AS meter_description,
        CAST(date_trunc('month', CAST(o_orderdate AS DATE) + INTERVAL 276 MONTH) AS DATE) AS m,
        CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DECIMAL(20,2)) AS price FROM orders)"""),
    "power_parsed": (["power_raw"], rf"""SELECT company_id, source_row_number, meter_id, meter_description, unit, period AS raw_period,
      consumption AS raw_consumption, TRY_CAST(period || '-01' AS DATE) AS period,
      CASE WHEN regexp_full_match(consumption, {NUMBER}) THEN CAST(consumption AS DECIMAL(18,2)) END AS value FROM power_raw"""),
    "power_suspects": (["power_parsed"], """SELECT p.*, t.top,
        coalesce(value > 0 AND log10(CAST(value AS DOUBLE)) <= log10(CAST(top AS DOUBLE)) - 2.5, false) AS suspect
      FROM (SELECT * FROM power_parsed WHERE period IS NOT NULL AND value IS NOT NULL) p
      LEFT JOIN (SELECT company_id, meter_id, max(value) AS top FROM power_parsed
        WHERE period IS NOT NULL AND value > 0 GROUP BY 1, 2) t USING (company_id, meter_id)"""),
    "power_rows": (["power_suspects"], """SELECT s.*, r.reference,
      CASE WHEN suspect AND reference > 0 THEN CASE WHEN CAST(value * 1000 AS DOUBLE) BETWEEN reference * 0.2 AND reference * 5.0
        THEN 'fixed' ELSE 'flagged' END END AS repair
      FROM power_suspects s LEFT JOIN (SELECT company_id, meter_id, median(CAST(value AS DOUBLE)) AS reference
        FROM power_suspects WHERE NOT suspect GROUP BY 1, 2) r USING (company_id, meter_id)"""),
    "power_facts": (["power_rows"], """SELECT company_id, source_row_number, meter_id, period,
      CAST(value * CASE repair WHEN 'fixed' THEN 1000 ELSE 1 END AS DECIMAL(14,2)) AS consumption_kwh,
      value AS original_consumption, unit AS original_unit,
      CASE repair WHEN 'fixed' THEN 1000 ELSE 1 END AS unit_correction_factor FROM power_rows"""),
    "power_months": (["power_facts"], """SELECT company_id, period AS month, sum(consumption_kwh) AS kwh,
      count(DISTINCT meter_id) AS meter_count FROM power_facts GROUP BY 1, 2"""),
    "power_drops": (["power_months"], outliers("power_months", "kwh")),
    "meters": (["power_rows"], """SELECT company_id, meter_id, arg_max(meter_description, source_row_number) AS description,
      min(period) AS first_period, max(period) AS last_period FROM power_rows GROUP BY 1, 2"""),
    "meter_numbers": (["meters"], r"SELECT company_id, CAST(regexp_extract(meter_id, '^MTR-(\d+)$', 1) AS BIGINT) AS n, * EXCLUDE (company_id) FROM meters"),
    "meter_missing": (["meter_numbers"], """SELECT company_id, n FROM (SELECT company_id, unnest(generate_series(min(n), max(n))) AS n
        FROM meter_numbers GROUP BY 1) ANTI JOIN meter_numbers USING (company_id, n)"""),
    "meter_gap_rows": (["meter_missing", "meters"], """SELECT company_id, printf('MTR-%02d', min(n)) || CASE WHEN count(*) > 1
        THEN printf(' ... MTR-%02d', max(n)) ELSE '' END AS listed,
      (SELECT count(*) FROM meters m WHERE m.company_id = g.company_id) AS meters FROM meter_missing g GROUP BY 1"""),
    "power_issues": (["power_parsed", "power_rows", "power_drops", "meter_gap_rows"], " UNION ALL ".join([
        issue("ELEC-UNIT-SCALE-01", "power_parsed", "period IS NULL OR value IS NULL", "meter_id",
              original="raw_period || ' ' || raw_consumption", severity="error", action="rejected"),
        issue("ELEC-UNIT-SCALE-01", "power_rows", "repair = 'fixed'", "meter_id || ' ' || strftime(period, '%Y-%m')", "consumption",
              original=f"({plain('value')}) || ' ' || unit", resolved=f"({plain('value * 1000')}) || ' kWh'"),
        issue("ELEC-UNIT-SCALE-01", "power_rows", "repair = 'flagged'", "meter_id || ' ' || strftime(period, '%Y-%m')", "consumption",
              original=f"({plain('value')}) || ' ' || unit", action="flagged"),
        issue("ELEC-METER-GAP-01", "meter_gap_rows", "true", "listed", "meter_id", "NULL", "meters || ' meters present'"),
        issue("ELEC-CONSUMPTION-DROP-01", "power_drops", "is_outlier AND kwh < median_value", "strftime(month, '%Y-%m')",
              "consumption", "NULL", "CAST(round(CAST(kwh AS DECIMAL(18,2)), 0) AS BIGINT) || ' kWh'"),
    ])),

    # ------------------------------------------------------------- incidents
    "incident_raw": ([], f"""SELECT doc_id % 4 AS company_id, doc_id + 2 AS source_row_number,
      'INC-' || (CASE WHEN doc_id % 11 = 0 AND doc_id >= 4 THEN doc_id - 4 ELSE doc_id END
        + CASE WHEN doc_id >= 150 THEN 1000 ELSE 0 END) AS incident_id,
      CASE WHEN doc_id % 61 = 0 THEN '31/02/2021' WHEN doc_id % 2 = 0 THEN strftime(day, '%Y-%m-%d')
        ELSE strftime(day, '%d/%m/%Y') END AS incident_date,
      ({array(AREA_NAMES)})[doc_id % 7 + 1] AS location,
      CASE lang WHEN 'en' THEN 'VEH' WHEN 'fr' THEN 'ELE' WHEN 'de' THEN 'OTH' ELSE 'XX' END AS type_code,
      CASE WHEN quality IS NULL THEN '' WHEN quality = 1 AND toxic = 0 THEN '1' WHEN quality = 0 AND toxic = 0 THEN 'Low'
        WHEN quality = 1 AND toxic = 1 THEN '3' ELSE 'medium' END AS severity,
      {trim("text || CASE WHEN doc_id % 13 = 0 THEN ' Dust at the Crusher.' ELSE '' END")} AS description
      FROM (SELECT *, CAST(DATE '2020-01-01' + CAST(doc_id % 1400 AS INT) AS DATE) AS day FROM documents LEFT JOIN labels USING (doc_id))"""),
    "incident_rows": (["incident_raw"], rf"""SELECT r.*, u.use, CASE WHEN u.use > 1 THEN incident_id || '-' || u.use ELSE incident_id END AS id,
      CASE WHEN severity IN ('1', '2', '3') THEN CAST(severity AS INT) WHEN lower(severity) = 'low' THEN 1
        WHEN lower(severity) = 'medium' THEN 2 WHEN lower(severity) = 'high' THEN 3 END AS level,
      CASE WHEN severity IN ('1', '2', '3') THEN 'numeric' WHEN lower(severity) IN ('low', 'medium', 'high') THEN 'ordinal-text' END AS scale,
      TRY_CAST(nullif(regexp_extract(incident_id, '(\d+)$', 1), '') AS BIGINT) AS n
      FROM (SELECT *, {date_value('incident_date')} AS date FROM incident_raw) r
      LEFT JOIN (SELECT company_id, source_row_number, row_number() OVER (PARTITION BY company_id, incident_id ORDER BY source_row_number) AS use
        FROM (SELECT *, {date_value('incident_date')} AS date FROM incident_raw) WHERE date IS NOT NULL) u USING (company_id, source_row_number)"""),
    "incident_facts": (["incident_rows"], """SELECT company_id, source_row_number, id, incident_id AS source_incident_id, date AS incident_date,
      nullif(location, '') AS site_area, location AS location_raw, type_code, level AS severity, severity AS severity_raw, description
      FROM incident_rows WHERE date IS NOT NULL"""),
    "incident_reuse": (["incident_facts"], """SELECT company_id, description, min(source_row_number) AS first_line, count(*) AS occurrences,
      count(DISTINCT location_raw) AS locations, arg_min(incident_date, source_row_number) AS first_date,
      arg_max(incident_date, source_row_number) AS last_date, arg_min(id, source_row_number) || CASE WHEN arg_min(id, source_row_number) = arg_max(id, source_row_number)
        THEN '' ELSE ' ... ' || arg_max(id, source_row_number) END AS ids
      FROM incident_facts GROUP BY 1, 2 HAVING count(*) > 1"""),
    "incident_jump": (["incident_rows"], """SELECT company_id, min(n) AS resumes_at FROM (
      SELECT company_id, n, n - lag(n) OVER (PARTITION BY company_id ORDER BY n) AS gap FROM incident_rows
      WHERE date IS NOT NULL AND n IS NOT NULL) WHERE gap > 20 GROUP BY 1"""),
    "incident_late": (["incident_rows", "incident_jump"], """SELECT r.company_id, j.resumes_at, r.n, r.source_row_number, r.incident_id
      FROM incident_rows r JOIN incident_jump j USING (company_id) WHERE r.date IS NOT NULL AND r.n >= j.resumes_at"""),
    "incident_late_sum": (["incident_late"], """SELECT company_id, resumes_at, CASE WHEN lo = hi THEN lo ELSE lo || ' ... ' || hi END AS ids FROM (
      SELECT company_id, resumes_at, first(incident_id ORDER BY n, source_row_number) AS lo,
        first(incident_id ORDER BY n DESC, source_row_number DESC) AS hi FROM incident_late GROUP BY 1, 2)"""),
    "incident_scales": (["incident_rows"], """SELECT company_id, count(*) FILTER (WHERE scale = 'numeric') AS numeric,
      count(*) FILTER (WHERE scale = 'ordinal-text') AS ordinal_text FROM incident_rows WHERE date IS NOT NULL GROUP BY 1"""),
    "incident_issues": (["incident_rows", "incident_reuse", "incident_late_sum", "incident_scales"], " UNION ALL ".join([
        issue("INC-DUP-ID-01", "incident_rows", "date IS NULL", "incident_id", "incident_date", original="incident_date",
              severity="error", action="rejected"),
        issue("INC-SEV-MAPPED-01", "incident_rows", "date IS NOT NULL AND scale = 'ordinal-text'", "incident_id", "severity",
              original="severity", resolved="level"),
        issue("INC-SEV-SCALE-01", "incident_rows", "date IS NOT NULL AND scale IS NULL", "incident_id", "severity",
              original="severity", severity="error", action="flagged"),
        issue("INC-TYPE-UNKNOWN-01", "incident_rows", f"date IS NOT NULL AND type_code NOT IN {_codes}", "incident_id", "type_code",
              original="type_code"),
        issue("INC-DUP-ID-01", "incident_rows", "date IS NOT NULL AND use > 1", "incident_id", "incident_id",
              original="incident_id", resolved="id"),
        issue("INC-LOCATION-01", "incident_rows", """date IS NOT NULL AND location IN ('Haul Fleet', 'Light Vehicles')
              AND regexp_matches(lower(description), 'crusher|wash plant|chpp|rom pad|thickener')""", "incident_id", "location",
              original="location"),
        issue("INC-SEV-SCALE-01", "incident_scales", "numeric > 0 AND ordinal_text > 0", field="severity", line="NULL",
              original="'numeric: ' || numeric || ', ordinal-text: ' || ordinal_text"),
        issue("INC-DESC-REUSED-01", "incident_reuse", "true", "ids",
              "description", "NULL", "occurrences || ' occurrences'"),
        issue("INC-ID-SEQUENCE-01", "incident_late_sum", "true", "ids", "incident_id", "NULL", "ids"),
    ])),
    "ledger": (["fuel_issues", "power_issues", "incident_issues", "supplier_issues"],
               "SELECT * FROM fuel_issues UNION ALL SELECT * FROM power_issues UNION ALL SELECT * FROM incident_issues "
               "UNION ALL SELECT * FROM supplier_issues"),

    # -------------------------------------------------------------- suppliers
    "supplier_raw": ([], f"""SELECT c_nationkey % 5 AS company_id, c_custkey + 2 AS source_row_number, typo, c_custkey AS key,
      CASE c_custkey % 5 WHEN 0 THEN ' Pty Ltd' WHEN 1 THEN ' P/L' WHEN 2 THEN ' & Co.' WHEN 3 THEN ' LIMITED' ELSE '' END AS suffix,
      CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 50 = 1 THEN '51 824 753 556' WHEN c_custkey % 13 = 0 THEN '1234567'
        ELSE substr(digits, 1, 2) || ' ' || substr(digits, 3, 3) || ' ' || substr(digits, 6, 3) || ' ' || substr(digits, 9, 3) END AS abn_text,
      CASE WHEN c_custkey % 17 = 0 THEN '' ELSE c_mktsegment END AS category_text, CAST(c_acctbal AS DECIMAL(14,2)) AS fy_spend_aud
      FROM (SELECT *, CASE WHEN c_custkey % 9 = 4 THEN substr(name, 1, 7) || 'x' || substr(name, 9, 40)
          WHEN c_custkey % 9 = 5 THEN substr(name, 1, 12) || substr(name, 15, 40) ELSE name END AS typo,
          lpad(CAST(c_custkey * 7919 + 10000000000 AS VARCHAR), 11, '0') AS digits
        FROM (SELECT *, {" || ' ' || ".join(f"({array(WORDS)})[(base // {10 ** p}) % 10 + 1]" for p in (4, 3, 2, 1, 0))} AS name
          FROM (SELECT *, CASE c_custkey % 9 WHEN 4 THEN c_custkey - 1 WHEN 5 THEN c_custkey - 2 WHEN 7 THEN c_custkey - 1
            ELSE c_custkey END AS base FROM customer)))"""),
    "supplier_parsed": (["supplier_raw"], rf"""SELECT *, nullif(regexp_replace(abn_text, '\D', '', 'g'), '') AS abn,
      nullif(abn_text, '') AS abn_raw, nullif(category_text, '') AS category,
      array_to_string(list_transform(string_split(typo, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || suffix AS supplier_name,
      regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(typo || suffix), '&', ' and ', 'g'),
        '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), '( (pty|ptyltd|ltd|limited|pl|inc|incorporated|co|company|corp|corporation|group|holdings))+$', '') AS name_canonical
      FROM supplier_raw"""),
    "supplier_checked": (["supplier_parsed"], """SELECT *, coalesce(length(abn) = 11, false) AS abn_well_formed,
      coalesce(length(abn) = 11 AND (list_sum(list_transform([10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19],
        lambda w, i: w * TRY_CAST(substr(abn, i, 1) AS INT))) - 10) % 89 = 0, false) AS abn_valid FROM supplier_parsed"""),
    "supplier_names": (["supplier_parsed"], "SELECT company_id, name_canonical AS name, min(source_row_number) AS node FROM supplier_parsed GROUP BY 1, 2"),
    "supplier_pairs": (["supplier_names", "supplier_parsed"], """SELECT DISTINCT a.company_id, a.node AS a, b.node AS b FROM supplier_names a JOIN supplier_names b
        ON a.company_id = b.company_id AND a.node <> b.node AND abs(length(a.name) - length(b.name)) <= 2
          AND least(length(a.name), length(b.name)) >= 10 AND levenshtein(a.name, b.name) <= 2
      UNION SELECT DISTINCT x.company_id, n.node, m.node FROM supplier_parsed x JOIN supplier_parsed y
        ON x.company_id = y.company_id AND x.abn = y.abn AND x.name_canonical <> y.name_canonical
        JOIN supplier_names n ON n.company_id = x.company_id AND n.name = x.name_canonical
        JOIN supplier_names m ON m.company_id = y.company_id AND m.name = y.name_canonical"""),
    "supplier_reach": (["supplier_names", "supplier_pairs"], """SELECT company_id, node, node AS other FROM supplier_names
      UNION SELECT r.company_id, r.node, p.b FROM supplier_reach r JOIN supplier_pairs p ON p.company_id = r.company_id AND p.a = r.other"""),
    "supplier_clusters": (["supplier_reach", "supplier_names"], """SELECT company_id, name AS name_canonical, component FROM supplier_names
      JOIN (SELECT company_id, node, min(other) AS component FROM supplier_reach GROUP BY 1, 2) USING (company_id, node)"""),
    "supplier_primaries": (["supplier_checked", "supplier_clusters"], """SELECT *, first(source_row_number) OVER w AS primary_line,
      first(supplier_name) OVER w AS primary_name, first(category) OVER w AS primary_category, first(abn) OVER w AS primary_abn,
      first(name_canonical) OVER w AS primary_canonical
      FROM supplier_checked JOIN supplier_clusters USING (company_id, name_canonical)
      WINDOW w AS (PARTITION BY company_id, component ORDER BY abn IS NULL, fy_spend_aud DESC, source_row_number
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""),
    "supplier_facts": (["supplier_primaries"], """SELECT company_id, source_row_number, supplier_name, name_canonical, abn_raw, abn,
      abn_well_formed, abn_valid, category,
      CASE WHEN primary_line <> source_row_number AND category IS NOT NULL AND primary_category IS NOT NULL
        THEN primary_category ELSE category END AS category_canonical, fy_spend_aud,
      CASE WHEN primary_line <> source_row_number THEN primary_line END AS duplicate_of_row,
      CASE WHEN primary_line <> source_row_number THEN primary_name END AS duplicate_of_name,
      CASE WHEN primary_line = source_row_number THEN NULL WHEN abn = primary_abn THEN 'identical-abn'
        WHEN name_canonical = primary_canonical THEN 'identical-canonical-name'
        WHEN least(length(name_canonical), length(primary_canonical)) >= 10 AND levenshtein(name_canonical, primary_canonical) <= 2
        THEN 'near-identical-name' ELSE 'linked-through-cluster' END AS match_reason FROM supplier_primaries"""),
    "supplier_checks": (["supplier_facts"], """SELECT company_id, count(*) FILTER (WHERE abn_well_formed) AS well_formed,
      count(*) FILTER (WHERE abn_well_formed AND NOT abn_valid) AS failing FROM supplier_facts GROUP BY 1"""),
    "supplier_issues": (["supplier_facts", "supplier_checks"], " UNION ALL ".join([
        issue("SUP-ABN-FORM-01", "supplier_facts", "NOT abn_well_formed", "supplier_name", "abn", original="coalesce(abn_raw, '(blank)')"),
        issue("SUP-DUP-01", "supplier_facts", "duplicate_of_row IS NOT NULL", "supplier_name", "supplier_name", original="supplier_name",
              resolved="'duplicate of ' || duplicate_of_name"),
        issue("SUP-CATEGORY-01", "supplier_facts", "category_canonical <> category", "supplier_name", "category", original="category",
              resolved="category_canonical"),
        issue("SUP-ABN-CHECKSUM-01", "supplier_checks", "well_formed > 0 AND failing = well_formed", field="abn", line="NULL",
              original="failing || '/' || well_formed || ' fail checksum'"),
    ])),

    # ------------------------------------------------------------------ marts
    "row_counts": (["fuel_issues", "power_issues"], """SELECT company_id, source_file, source_row_number, count(*) AS issues,
      count(*) FILTER (WHERE severity = 'error') AS errors FROM (SELECT * FROM fuel_issues UNION ALL SELECT * FROM power_issues)
      WHERE source_row_number IS NOT NULL GROUP BY 1, 2, 3"""),
    "v1": (["fuel_facts", "power_facts", "factors", "row_counts"], """SELECT f.company_id, CAST(date_trunc('month', f.delivery_date) AS DATE) AS month,
        ef.scope, ef.activity, f.factor_key, sum(f.quantity_l) AS activity_amount, min(ef.unit) AS activity_unit,
        round(sum(CAST(f.quantity_l * ef.kg_co2e_per_unit AS DECIMAL(30,6))), 2) AS kg_co2e, count(*) AS contributing_records,
        sum(coalesce(q.issues, 0)) AS quality_issue_count, sum(coalesce(q.errors, 0)) AS quality_error_count,
        bool_or(coalesce(q.errors, 0) > 0) AS has_quality_flags, bool_or(f.date_precision = 'month') AS has_imprecise_dates
      FROM fuel_facts f JOIN factors ef USING (factor_key) LEFT JOIN row_counts q ON q.company_id = f.company_id
        AND q.source_file = 'fuel_deliveries.csv' AND q.source_row_number = f.source_row_number GROUP BY 1, 2, 3, 4, 5
      UNION ALL SELECT r.company_id, r.period, ef.scope, ef.activity, ef.factor_key, sum(r.consumption_kwh), min(ef.unit),
        round(sum(CAST(r.consumption_kwh * ef.kg_co2e_per_unit AS DECIMAL(30,6))), 2), count(*), sum(coalesce(q.issues, 0)),
        sum(coalesce(q.errors, 0)), bool_or(coalesce(q.errors, 0) > 0), false
      FROM power_facts r JOIN factors ef ON ef.factor_key = 'grid_electricity_qld' LEFT JOIN row_counts q ON q.company_id = r.company_id
        AND q.source_file = 'electricity_meter_readings.csv' AND q.source_row_number = r.source_row_number GROUP BY 1, 2, 3, 4, 5"""),
    "v3": (["v1"], """SELECT company_id, month, scope1_kg_co2e, scope2_kg_co2e, total_kg_co2e,
      CAST(round(CASE WHEN total_kg_co2e = 0 THEN 0 ELSE CAST(scope1_kg_co2e AS DOUBLE) / CAST(total_kg_co2e AS DOUBLE) * 100 END, 1) AS DECIMAL(10,1)) AS scope1_share_pct,
      CAST(round(CASE WHEN before = 0 THEN NULL ELSE CAST(total_kg_co2e - before AS DOUBLE) / CAST(before AS DOUBLE) * 100 END, 1) AS DECIMAL(10,1)) AS month_on_month_pct,
      before AS previous_month_kg_co2e, contributing_records, quality_issue_count, quality_error_count, has_quality_flags, has_imprecise_dates
      FROM (SELECT *, lag(total_kg_co2e) OVER (PARTITION BY company_id ORDER BY month) AS before FROM (
        SELECT company_id, month, coalesce(sum(kg_co2e) FILTER (WHERE scope = 1), 0) AS scope1_kg_co2e,
          coalesce(sum(kg_co2e) FILTER (WHERE scope = 2), 0) AS scope2_kg_co2e, sum(kg_co2e) AS total_kg_co2e,
          sum(contributing_records) AS contributing_records, sum(quality_issue_count) AS quality_issue_count,
          sum(quality_error_count) AS quality_error_count, bool_or(has_quality_flags) AS has_quality_flags,
          bool_or(has_imprecise_dates) AS has_imprecise_dates FROM v1 GROUP BY 1, 2))"""),
    "v4": (["fuel_facts", "factors", "areas"], """SELECT f.company_id, CAST(date_trunc('month', f.delivery_date) AS DATE) AS month,
      CASE WHEN f.site_area = '' THEN '(unrecorded)' ELSE f.site_area END AS site_area,
      coalesce(a.category, 'unknown') AS site_area_category, f.fuel_type, sum(f.quantity_l) AS litres,
      round(sum(CAST(f.quantity_l * ef.kg_co2e_per_unit AS DECIMAL(30,6))), 2) AS kg_co2e, count(*) AS delivery_count
      FROM fuel_facts f JOIN factors ef USING (factor_key) LEFT JOIN areas a ON a.name = f.site_area GROUP BY 1, 2, 3, 4, 5"""),
    "v5": (["v3"], """SELECT company_id, year(month) + CASE WHEN month(month) >= 7 THEN 1 ELSE 0 END AS financial_year,
      sum(scope1_kg_co2e) AS scope1_kg_co2e, sum(scope2_kg_co2e) AS scope2_kg_co2e, sum(total_kg_co2e) AS total_kg_co2e,
      count(*) AS months_with_data, count(*) = 12 AS is_complete_year, min(month) AS first_month, max(month) AS last_month,
      sum(quality_error_count) AS quality_error_count FROM v3 GROUP BY 1, 2"""),
    "v6": (["incident_facts", "types"], """SELECT i.company_id, CAST(date_trunc('month', incident_date) AS DATE) AS month, type_code,
      t.label AS type_label, severity, count(*) AS incident_count FROM incident_facts i LEFT JOIN types t ON t.code = i.type_code
      GROUP BY 1, 2, 3, 4, 5"""),

    # --------------------------------------------------------------- findings
    "finding_raw": ([], """SELECT doc_id % 4 AS company_id, doc_id * 2 + turn AS seq,
      CASE WHEN doc_id % 19 = 0 THEN 'INC-X' || doc_id ELSE 'DOC-' || doc_id END AS incident_id,
      CASE lang WHEN 'de' THEN 'Psychosocial hazard' ELSE 'Other' END AS category, lang = 'de' AS is_psychosocial,
      doc_id % 4 AS severity_assessment, CAST((doc_id % 120) / 100.0 AS DECIMAL(3,2)) AS confidence,
      CASE WHEN turn = 1 THEN quote WHEN doc_id % 7 = 1 THEN '~' || quote WHEN doc_id % 7 = 2 THEN '   ' || chr(10)
        WHEN doc_id % 7 = 3 THEN '  ' || quote || chr(10) || ' ' ELSE quote END AS evidence_quote,
      'm1' AS model, CASE turn WHEN 0 THEN 'v1' ELSE 'v2' END AS prompt_version, 1600000000 + doc_id * 60 + turn AS created
      FROM (SELECT *, substr(text, CAST(length(text) // 3 AS BIGINT) + 1, 60) AS quote, unnest([0, 1]) AS turn FROM documents)"""),
    "finding_incidents": ([], """SELECT doc_id % 4 AS company_id, 'DOC-' || doc_id AS id, quality + 1 AS severity, text AS description,
      CAST(DATE '2020-01-01' + CAST(doc_id % 1400 AS INT) AS DATE) AS incident_date FROM documents LEFT JOIN labels USING (doc_id)"""),
    "finding_checked": (["finding_raw", "finding_incidents"], f"""SELECT f.*, {trim('f.evidence_quote')} AS quote, i.id IS NOT NULL AS known,
      i.severity AS recorded_severity, coalesce(contains(i.description, {trim('f.evidence_quote')}), false) AS verbatim
      FROM finding_raw f LEFT JOIN finding_incidents i ON i.company_id = f.company_id AND i.id = f.incident_id"""),
}


def findings_verdicts(partition: str) -> str:
    """Verdicts with a running accepted flag over ``partition``."""
    return f"""SELECT *, CASE WHEN NOT known THEN 'unknown-incident'
      WHEN coalesce(max(CASE WHEN known AND quote <> '' AND verbatim THEN 1 ELSE 0 END) OVER
        (PARTITION BY {partition} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'duplicate-finding'
      WHEN quote = '' THEN 'quote-empty' WHEN NOT verbatim THEN 'quote-not-verbatim' END AS reason FROM finding_checked"""


CTES["finding_verdicts"] = (["finding_checked"], findings_verdicts("company_id, incident_id"))
CTES["finding_run_verdicts"] = (["finding_checked"], findings_verdicts("company_id, incident_id, model, prompt_version"))
CTES["findings"] = (["finding_run_verdicts"], """SELECT *, coalesce(recorded_severity <> severity_assessment, false) AS severity_mismatch
  FROM finding_run_verdicts WHERE reason IS NULL""")


def query(final: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the needed tables in order, then ``final``."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for need in CTES[name][0]:
            visit(need)
        done.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in done]
    parts += [f"{name} AS ({body})" for name, body in (extra or {}).items()]
    recursive = "RECURSIVE " if "supplier_reach" in done else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + final
