"""Value normalisers. Each returns a struct whose ``error`` is null on success.

They read text that ``numbers.strip`` has trimmed: operators trim every field once, in
a projection of its own, instead of once per use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitelens.functions.numbers import money_half_up, once, parse_decimal

# ---------------------------------------------------------------- fixed values
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun",
          "jul", "aug", "sep", "oct", "nov", "dec"]
LITRES_PER_UNIT = {
    "l": 1, "lt": 1, "litre": 1, "litres": 1,
    "kl": 1000, "kilolitre": 1000, "kilolitres": 1000,
}
PRICE_BAND = (1.0, 3.0)
AMOUNT_TEXT = r"^-?\$?-?[\d,]+(\.\d+)?$"
ORDINAL_SEVERITY = {"low": 1, "medium": 2, "high": 3}
ABN_WEIGHTS = [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
LEGAL_SUFFIXES = ["pty", "ptyltd", "ltd", "limited", "pl", "inc", "incorporated",
                  "co", "company", "corp", "corporation", "group", "holdings"]
# -----------------------------------------------------------------------------


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def normalise_date(text: Column) -> Column:
    """ISO, day-first slash or ``Mon-yy`` text to a calendar date.

    Returns ``struct<value DATE, precision, format, error>``. Error codes: empty,
    not-a-date, month-first (valid only the other way round), unknown-month,
    unknown-format. ``Mon-yy`` means year 2000+yy, day 1, precision ``month``.
    """
    return once(text, _normalised_date)


def _normalised_date(text: Column) -> Column:
    iso = F.when(text >= "0100", text.try_cast("date"))
    slashed = F.right(text, F.lit(4)) >= "0100"
    day_first = F.when(slashed, F.try_to_date(text, "d/M/yyyy"))
    month_first = F.when(slashed, F.try_to_date(text, "M/d/yyyy"))
    month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS]),
                                F.lower(F.substring(text, 1, 3)))
    anchored = F.make_date(F.lit(2000) + F.right(text, F.lit(2)).cast("int"), month_no, F.lit(1))

    def result(value, precision, fmt, error):
        return F.struct(
            value.cast("date").alias("value"),
            F.lit(precision).cast("string").alias("precision"),
            F.lit(fmt).cast("string").alias("format"),
            (error if isinstance(error, Column) else F.lit(error)).cast("string").alias("error"),
        )

    none = F.lit(None)
    return (
        F.when(text == "", result(none, None, None, "empty"))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"),
              F.when(iso.isNotNull(), result(iso, "day", "iso", None))
              .otherwise(result(none, None, None, "not-a-date")))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
              F.when(day_first.isNotNull(), result(day_first, "day", "day-first-slash", None))
              .when(month_first.isNotNull(), result(none, None, None, "month-first"))
              .otherwise(result(none, None, None, "not-a-date")))
        .when(text.rlike(r"^[A-Za-z]{3,9}-\d{2}$"),
              F.when(month_no > 0, result(anchored, "month", "month-year", None))
              .otherwise(result(none, None, None, "unknown-month")))
        .otherwise(result(none, None, None, "unknown-format"))
    )


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def _quantity_error(quantity: Column, unit: Column, number: Column, factor: Column) -> Column:
    return (
        F.when(quantity == "", F.lit("quantity-empty"))
        .when(unit == "", F.lit("unit-empty"))
        .when(number.isNull(), F.lit("quantity-not-a-number"))
        .when(number == 0, F.lit("quantity-zero"))
        .when(factor.isNull(), F.lit("unknown-unit"))
    )


def normalise_quantity(quantity_text: Column, unit_text: Column) -> Column:
    """Quantity and unit text to litres: ``struct<litres, unit, factor, error>``."""
    def read(text: Column) -> Column:
        plain_text = F.translate(text["quantity"], ",", "")
        return F.struct(text["quantity"].alias("quantity"), text["unit"].alias("unit"),
                        once(plain_text, lambda t: parse_decimal(t, "decimal(18,6)")).alias("number"),
                        _lookup(LITRES_PER_UNIT, F.lower(text["unit"])).alias("factor"))

    def judged(r: Column) -> Column:
        error = _quantity_error(r["quantity"], r["unit"], r["number"], r["factor"])
        return F.struct(r["unit"].alias("unit"), r["number"].alias("number"), r["factor"].alias("factor"), error.alias("error"))

    def result(r: Column) -> Column:
        # Within a quantity's 18 digits the product with factor 1 is the number itself.
        litres = once((r["number"] * r["factor"]).cast("decimal(24,6)"), money_half_up)
        return F.struct(
            F.when(r["error"].isNull(), litres).alias("litres"),
            r["unit"].alias("unit"),
            F.when(r["error"].isNull(), r["factor"]).alias("factor"),
            r["error"].alias("error"),
        )

    text = F.struct(quantity_text.alias("quantity"), unit_text.alias("unit"))
    return once(text, lambda t: once(read(t), lambda r: once(judged(r), result)))


def apart(value: Column) -> Column:
    """``value`` as it is, through a lambda. Spark does not fuse a projection that holds one with its
    neighbours: all parsers in one method are more than HotSpot compiles."""
    return once(value, lambda v: v)


def with_date(df: DataFrame, text: str, out: str) -> DataFrame:
    """``normalise_date`` of a text column, as column ``out``.

    This and the next two give what the column functions give, in projections: every step is a
    column that later steps read, so Spark compiles each once, where lambdas are interpreted.
    """
    return df.select("*", _normalised_date(F.col(text)).alias(out))


def with_quantity(df: DataFrame, quantity: str, unit: str, out: str) -> DataFrame:
    """``normalise_quantity`` of two text columns, as column ``out``."""
    read = F.col("_error").isNull()
    return df.select("*", F.translate(quantity, ",", "").alias("_text"), F.lower(unit).alias("_unit")) \
        .select(*df.columns, parse_decimal(F.col("_text"), "decimal(18,6)").alias("_number"),
                _lookup(LITRES_PER_UNIT, F.col("_unit")).alias("_factor")) \
        .select("*", _quantity_error(F.col(quantity), F.col(unit), F.col("_number"), F.col("_factor")).alias("_error")) \
        .select(*df.columns, "_error", F.when(read, F.col("_factor")).alias("_factor"),
                F.when(read, (F.col("_number") * F.col("_factor")).cast("decimal(24,6)")).alias("_product")) \
        .select(*df.columns, "_error", "_factor", money_half_up(F.col("_product")).alias("_litres")) \
        .select(*df.columns, apart(F.struct(F.col("_litres").alias("litres"), F.col(unit).alias("unit"),
                                             F.col("_factor").alias("factor"), F.col("_error").alias("error"))).alias(out))


def implied_price(cost: Column, litres: Column) -> Column:
    """Price per litre, null when there are no litres."""
    return F.when(litres != 0, cost.cast("double") / litres.cast("double"))


def price_is_plausible(price: Column) -> Column:
    return F.coalesce(price.between(*PRICE_BAND), F.lit(False))


def _amount_number(text: Column) -> Column:
    # Text without a digit is no number; a cast that fails costs an exception.
    return F.when(text.rlike(r"\d"), F.translate(text, "$,-", "").try_cast("decimal(14,2)"))


def _amount_error(text: Column, number: Column) -> Column:
    return (
        F.when(text == "", F.lit("amount-empty"))
        .when(~text.rlike(AMOUNT_TEXT), F.lit("amount-format"))
        .when(number.isNull(), F.lit("amount-not-a-number"))
    )


def _signed_amount(text: Column, number: Column) -> Column:
    return F.when(text.contains("-"), -number).otherwise(number).cast("decimal(14,2)")


def parse_amount(text: Column) -> Column:
    """Currency text to DECIMAL: ``struct<value, formatted, error>``.

    A minus anywhere makes the amount negative. ``formatted`` says that the text
    carried a currency sign or thousands separators.
    """
    def read(text: Column) -> Column:
        return F.struct(text.alias("text"), _amount_number(text).alias("number"))

    def judged(r: Column) -> Column:
        return F.struct(r["text"].alias("text"), r["number"].alias("number"), _amount_error(r["text"], r["number"]).alias("error"))

    def result(r: Column) -> Column:
        return F.struct(
            F.when(r["error"].isNull(), _signed_amount(r["text"], r["number"])).alias("value"),
            r["text"].rlike(r"[$,]").alias("formatted"),
            r["error"].alias("error"),
        )

    return once(text, lambda t: once(read(t), lambda r: once(judged(r), result)))


def with_amount(df: DataFrame, text: str, out: str) -> DataFrame:
    """``parse_amount`` of a text column, as column ``out``."""
    t = F.col(text)
    return df.select("*", _amount_number(t).alias("_number")) \
        .select("*", _amount_error(t, F.col("_number")).alias("_error")) \
        .select(*df.columns, "_error", F.when(F.col("_error").isNull(), _signed_amount(t, F.col("_number"))).alias("_value"),
                t.rlike(r"[$,]").alias("_formatted")) \
        .select(*df.columns, apart(F.struct(F.col("_value").alias("value"), F.col("_formatted").alias("formatted"),
                                             F.col("_error").alias("error"))).alias(out))


def normalise_severity(text: Column) -> Column:
    """``struct<severity, scale, error>``; scale is ``numeric`` or ``ordinal-text``."""
    numeric = F.when(text.rlike("^[123]$"), text.cast("int"))
    ordinal = _lookup(ORDINAL_SEVERITY, F.lower(text))
    return F.struct(
        F.coalesce(numeric, ordinal).cast("int").alias("severity"),
        F.when(numeric.isNotNull(), F.lit("numeric"))
        .when(ordinal.isNotNull(), F.lit("ordinal-text")).alias("scale"),
        F.when(text == "", F.lit("severity-empty"))
        .when(numeric.isNull() & ordinal.isNull(), F.lit("severity-unknown")).alias("error"),
    )


def normalise_abn(raw: Column) -> Column:
    """``struct<digits, present, well_formed, checksum_valid>`` of a business number."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")
    well_formed = F.length(digits) == 11
    # Weighted digit sum, the first digit less one, must divide by 89.
    total = sum(
        (F.substring(digits, i + 1, 1).cast("int") - (1 if i == 0 else 0)) * F.lit(w)
        for i, w in enumerate(ABN_WEIGHTS)
    )
    return F.struct(
        F.when(digits != "", digits).alias("digits"),
        (digits != "").alias("present"),
        well_formed.alias("well_formed"),
        F.when(well_formed, total % 89 == 0).otherwise(F.lit(False)).alias("checksum_valid"),
    )


def canonical_name(name: Column) -> Column:
    """Lower-case identifying core of a trading name; legal suffixes leave the tail only."""
    value = F.regexp_replace(F.lower(name), "&", " and ")
    value = F.regexp_replace(value, r"[^a-z0-9\s]", "")
    value = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.regexp_replace(value, rf"(?<=\S)(?: (?:{'|'.join(LEGAL_SUFFIXES)}))+$", "")


def meter_number(meter_id: Column) -> Column:
    return F.regexp_extract(meter_id, r"^MTR-(\d+)$", 1).try_cast("bigint")


def trailing_number(identifier: Column) -> Column:
    return F.regexp_extract(identifier, r"(\d+)$", 1).try_cast("bigint")


def error_profile(df, result: str):
    """How often each outcome of a normalised struct column occurs, per tenant."""
    return df.groupBy("company_id", F.col(f"{result}.error").alias("error")).count()
