"""Raw inputs projected from the driver's tables (all rows, whole texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sitelens.sources.reference import FACTOR_KEY_BY_ACTIVITY

AREA_NAMES = ["Open Cut - North Pit", "Open Cut - South Pit", "Processing Plant", "Site Services",
              "Haul Fleet", "Light Vehicles", "Tailings Dam", ""]
WORDS = ["amba", "birk", "codo", "dusk", "elmy", "fjor", "gyps", "hemp", "iron", "jute"]
SPREAD = {"lineitem", "orders", "documents", "customer"}
FACTORS = [("diesel", 1, "L", "2.7000"), ("petrol_ulp", 1, "L", "2.3100"), ("grid_electricity_qld", 2, "kWh", "0.7100")]


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A driver table. Its file holds one row group, which one task would read whole,
    so a scan with fewer splits than cores is spread; a larger input is left as it is.
    ``spread`` is false where a join shuffles whole texts next, or none leave the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if not spread or name not in SPREAD or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def pick(values: list[str], index) -> F.Column:
    """The ``index``-th (0-based) of fixed values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def factors(spark: SparkSession) -> DataFrame:
    names = {key: activity for activity, key in FACTOR_KEY_BY_ACTIVITY.items()}
    return spark.createDataFrame([(k, names[k], s, u, r) for k, s, u, r in FACTORS],
                                 "factor_key string, activity string, scope int, unit string, rate string") \
        .select("factor_key", "activity", F.col("scope").cast("smallint").alias("scope"), "unit",
                F.col("rate").cast("decimal(10,4)").alias("kg_co2e_per_unit"))


def _shifted(day):
    """Dates 23 years on, so that two-digit years read back; May 2021 moves to June."""
    moved = F.add_months(F.to_date(day), 276)
    return F.when(F.trunc(moved, "MM") == F.lit("2021-05-01").cast("date"), F.add_months(moved, 1)).otherwise(moved)


def fuel_raw(spark: SparkSession, d: str) -> DataFrame:
    """Fuel export rows from ``lineitem``: three date styles, four unit styles, defects."""
    li = table(spark, d, "lineitem").withColumn("sd", _shifted(F.col("l_shipdate")))
    part, order, line = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    litres = (F.col("l_quantity") * 1000).cast("bigint")
    sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.095), "-").otherwise("")
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    return li.select(
        (F.col("l_suppkey") % 5).cast("bigint").alias("company_id"),
        ((order * 8 + line) * 16777216 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("source_row_number"),
        F.concat(F.lit("INV-"), order.cast("string")).alias("invoice_no"),
        F.when(part % 89 == 0, "").when(part % 97 == 0, F.date_format("sd", "MM/dd/yyyy"))
        .when(order % 3 == 0, F.date_format("sd", "yyyy-MM-dd"))
        .when(order % 3 == 1, F.date_format("sd", "dd/MM/yyyy"))
        .otherwise(F.date_format("sd", "MMM-yy")).alias("delivery_date"),
        F.when(part % 53 == 0, "Kerosene").when(F.col("l_returnflag") == "N", "Petrol (ULP)")
        .otherwise("Diesel").alias("fuel_type"),
        F.when(part % 83 == 0, F.lit("0")).otherwise(F.concat(
            sign,
            F.when(line % 4 == 0, F.col("l_quantity").cast("bigint").cast("string"))
            .when(line % 4 == 1, F.format_number(litres, 0))
            .when(line % 4 == 2, litres.cast("string"))
            .otherwise(F.concat(litres.cast("string"), F.lit(".5"))))).alias("quantity"),
        F.when(part % 71 == 0, "drum").when(line % 4 == 0, "kL").when(line % 4 == 1, "L")
        .when(line % 4 == 2, "litres").otherwise(" Litres ").alias("unit"),
        F.when(F.col("l_tax") > 0.075, F.lit("")).when(part % 101 == 0, F.lit("N/A"))
        .when(line % 2 == 1, F.concat(F.lit("$"), sign, F.format_number(price, 2)))
        .otherwise(F.concat(sign, price.cast("string"))).alias("cost"),
        pick(AREA_NAMES, F.col("l_suppkey") % 8).alias("site_area"))


def power_raw(spark: SparkSession, d: str) -> DataFrame:
    """Meter readings from ``orders``: one meter turns to MWh in 2022, one month collapses."""
    o = table(spark, d, "orders").withColumn("m", F.trunc(F.add_months(F.to_date("o_orderdate"), 276), "MM"))
    k = F.floor(F.col("o_custkey") / 5) % 6
    number = F.when(k == 5, 7).otherwise(k + 1).cast("int")
    price = F.col("o_totalprice").cast("decimal(14,2)")
    value = F.when((number == 7) & (F.col("m") >= F.lit("2022-01-01").cast("date")),
                   F.round(price * F.expr("0.001BD"), 2).cast("decimal(14,2)")) \
        .when(F.col("m") == F.lit("2021-03-01").cast("date"), F.round(price * F.expr("0.25BD"), 2).cast("decimal(14,2)")) \
        .otherwise(price)
    return o.select(
        (F.col("o_custkey") % 5).alias("company_id"), (F.col("o_orderkey") + 2).alias("source_row_number"),
        F.concat(F.lit("MTR-0"), number.cast("string")).alias("meter_id"),
        F.concat(F.lit("Feeder "), F.col("o_orderpriority")).alias("meter_description"),
        F.when(F.col("o_orderkey") % 199 == 0, "2021/13").otherwise(F.date_format("m", "yyyy-MM")).alias("period"),
        F.when(F.col("o_orderkey") % 211 == 0, F.lit("n/a")).otherwise(value.cast("string")).alias("consumption"),
        F.lit("kWh").alias("unit"))


def incident_raw(spark: SparkSession, d: str) -> DataFrame:
    """Incident register from ``documents`` (whole texts) and ``labels``."""
    docs, labels = table(spark, d, "documents", spread=False), table(spark, d, "labels")
    doc = F.col("doc_id")
    number = F.when(doc % 11 == 0, doc - F.when(doc >= 4, 4).otherwise(0)).otherwise(doc) \
        + F.when(doc >= 150, 1000).otherwise(0)
    day = F.date_add(F.lit("2020-01-01").cast("date"), (doc % 1400).cast("int"))
    severity = F.when(F.col("quality").isNull(), "") \
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), "1") \
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), "Low") \
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), "3").otherwise("medium")
    return docs.join(labels, "doc_id", "left").select(
        (doc % 4).alias("company_id"), (doc + 2).alias("source_row_number"),
        F.concat(F.lit("INC-"), number.cast("string")).alias("incident_id"),
        F.when(doc % 61 == 0, "31/02/2021").when(doc % 2 == 0, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "dd/MM/yyyy")).alias("incident_date"),
        pick(AREA_NAMES, doc % 7).alias("location"),
        F.when(F.col("lang") == "en", "VEH").when(F.col("lang") == "fr", "ELE")
        .when(F.col("lang") == "de", "OTH").otherwise("XX").alias("type_code"),
        severity.alias("severity"),
        F.concat("text", F.when(doc % 13 == 0, " Dust at the Crusher.").otherwise("")).alias("description"))


def supplier_raw(spark: SparkSession, d: str) -> DataFrame:
    """Supplier register from ``customer``: number words, typos, suffixes, shared numbers."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    base = F.when(key % 9 == 4, key - 1).when(key % 9 == 5, key - 2).when(key % 9 == 7, key - 1).otherwise(key)
    def word(place):
        return pick(WORDS, F.floor(base / 10 ** place) % 10)
    name = F.concat_ws(" ", word(4), word(3), word(2), word(1), word(0))
    typo = F.when(key % 9 == 4, F.concat(F.substring(name, 1, 7), F.lit("x"), F.substring(name, 9, 40))) \
        .when(key % 9 == 5, F.concat(F.substring(name, 1, 12), F.substring(name, 15, 40))).otherwise(name)
    suffix = F.when(key % 5 == 0, " Pty Ltd").when(key % 5 == 1, " P/L").when(key % 5 == 2, " & Co.") \
        .when(key % 5 == 3, " LIMITED").otherwise("")
    digits = F.lpad((key * 7919 + 10000000000).cast("string"), 11, "0")
    abn = F.when(key % 4 == 0, "").when(key % 50 == 1, "51 824 753 556").when(key % 13 == 0, "1234567") \
        .otherwise(F.concat_ws(" ", F.substring(digits, 1, 2), F.substring(digits, 3, 3), F.substring(digits, 6, 3),
                               F.substring(digits, 9, 3)))
    return c.select(
        (F.col("c_nationkey") % 5).cast("bigint").alias("company_id"), (key + 2).alias("source_row_number"),
        F.concat(F.initcap(typo), suffix).alias("supplier_name"), abn.alias("abn"),
        F.when(key % 17 == 0, "").otherwise(F.col("c_mktsegment")).alias("category"),
        F.col("c_acctbal").cast("decimal(14,2)").cast("string").alias("fy_spend_aud"))


def tenants(spark: SparkSession, d: str) -> DataFrame:
    """All tenants; some of them have no rows in any register."""
    return table(spark, d, "nation").select((F.col("n_nationkey") % 7).cast("bigint").alias("company_id")).distinct()


def finding_raw(spark: SparkSession, d: str) -> DataFrame:
    """Two findings per document: quotes from the middle of its text, some spoilt."""
    docs = table(spark, d, "documents", spread=False)
    doc, n = F.col("doc_id"), F.length("text")
    quote = F.substring("text", F.floor(n / 3).cast("int") + 1, F.lit(60))
    spoilt = F.when(doc % 7 == 1, F.concat(F.lit("~"), quote)).when(doc % 7 == 2, F.lit("   \n")) \
        .when(doc % 7 == 3, F.concat(F.lit("  "), quote, F.lit("\n "))).otherwise(quote)
    both = docs.select("doc_id", "lang", F.explode(F.array(
        F.struct(F.lit(0).alias("turn"), spoilt.alias("q")),
        F.struct(F.lit(1).alias("turn"), quote.alias("q")))).alias("f"))
    turn = F.col("f.turn")
    return both.select(
        (doc % 4).alias("company_id"), (doc * 2 + turn).alias("seq"),
        F.when(doc % 19 == 0, F.concat(F.lit("INC-X"), doc.cast("string")))
        .otherwise(F.concat(F.lit("DOC-"), doc.cast("string"))).alias("incident_id"),
        F.when(F.col("lang") == "de", "Psychosocial hazard").otherwise("Other").alias("category"),
        (F.col("lang") == "de").alias("is_psychosocial"), F.lit("Not applicable").alias("psychosocial_subtype"),
        (doc % 4).cast("int").alias("severity_assessment"),
        ((doc % 120) / 100).cast("decimal(3,2)").alias("confidence"),
        F.col("f.q").alias("evidence_quote"), F.lit("read").alias("rationale"),
        F.lit("m1").alias("model"), F.when(turn == 0, "v1").otherwise("v2").alias("prompt_version"),
        F.timestamp_seconds(F.lit(1_600_000_000) + doc * 60 + turn).alias("created_at"))


def finding_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as incidents the findings speak about (whole texts)."""
    docs, labels = table(spark, d, "documents", spread=False), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(
        (F.col("doc_id") % 4).alias("company_id"), F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1400).cast("int")).alias("incident_date"),
        (F.col("quality") + 1).cast("smallint").alias("severity"), F.col("text").alias("description"))


def loads(spark: SparkSession, d: str) -> DataFrame:
    """Load attempts from ``orders``."""
    o = table(spark, d, "orders")
    failed = F.col("o_orderstatus") == "F"
    return o.select(
        (F.col("o_custkey") % 5).alias("company_id"), F.lit("cli").alias("source"),
        F.col("o_orderkey").alias("load_id"),
        F.when(failed, "failed").otherwise("succeeded").alias("status"),
        F.when(failed & (F.col("o_orderkey") % 10 > 0), F.col("o_orderpriority")).alias("failure_reason"),
        (F.unix_timestamp(F.to_timestamp("o_orderdate")) * 10_000_000 + F.col("o_orderkey")).alias("started_at"))


def out(df: DataFrame) -> DataFrame:
    """Money to DOUBLE, integers to BIGINT, dates to text: one form for comparison."""
    columns = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        columns.append(c.alias(field.name))
    return df.select(*columns)
