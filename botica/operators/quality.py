"""Row validation and schema enforcement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from botica.functions.money import percent_to_fraction
from botica.functions.numbers import decimal_of, int_of
from botica.functions.text import trimmed
from botica.functions.timing import timestamp_of
from botica.sources.tables import DEFAULT_FORMAT, read_table

# The quantity editor's bounds.
MIN_QUANTITY, MAX_QUANTITY = 0, 9999

TEXT_FIELDS = ("cart_id", "transaction_id", "industry_name", "product_id", "product_name")
AMOUNT_FIELDS = ("unit_price", "taxes_price")
REQUIRED_FIELDS = (*TEXT_FIELDS, "sale_datetime", *AMOUNT_FIELDS, "quantity")

# What reads the fields that are not text, from their trimmed text.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "sale_datetime": timestamp_of,
    "unit_price": lambda t: decimal_of(t, 2),
    "taxes_price": lambda t: decimal_of(t, 2),
    "discount_applied": lambda t: percent_to_fraction(decimal_of(t, 8)),
    "quantity": int_of,
}


def _once(df: DataFrame, name: str, values: dict[str, Column]) -> DataFrame:
    """Adds a struct of values that Spark works out once for each row.

    Exploding a one-element array keeps it from copying them into whatever uses them.
    """
    return df.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias(name))


def check_fields(
    raw: DataFrame,
    required: Sequence[str],
    texts: Sequence[str],
    parsers: dict[str, Callable[[Column], Column]],
    problem: Column | None = None,
) -> DataFrame:
    """typed (trimmed and parsed), raw (the row as it came), errors (all rules it breaks).

    A row that breaks no rule has ``typed`` and no errors, one that breaks some has
    ``raw`` and its errors; the other struct is NULL. A row with a ``problem`` has that as
    its only error. Each field is trimmed once and parsed once; broken rules are the bits
    of a number, which becomes texts for rejected rows only.
    """
    fields = list(dict.fromkeys([*required, *texts, *parsers]))
    rows = raw.select("*", *[trimmed(F.col(f)).alias(f"_text_{f}") for f in fields])
    text = {f: F.col(f"_text_{f}") for f in fields}
    blank = {f: F.coalesce(text[f] == "", F.lit(True)) for f in fields}
    rows = _once(rows, "_value", {f: parse(text[f]) for f, parse in parsers.items()})
    rules = [(f"{f} is required", blank[f]) for f in required]
    for field in parsers:
        unreadable = ~blank[field] & F.col(f"_value.{field}").isNull()
        rules.append((f"{field} is not a valid value", unreadable))
    out_of_range = ~F.col("_value.quantity").between(MIN_QUANTITY, MAX_QUANTITY)
    message = f"quantity is not between {MIN_QUANTITY} and {MAX_QUANTITY}"
    rules.append((message, F.coalesce(out_of_range, F.lit(False))))
    broken = F.lit(0).cast("long")
    for k, (_, rule) in enumerate(rules):
        broken = broken + F.when(rule, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    if problem is not None:
        broken = F.when(problem.isNotNull(), F.lit(-1).cast("long")).otherwise(broken)
    rows = _once(rows, "_broken", {"rules": broken})
    rules_broken = F.col("_broken.rules")
    named = [
        F.when(rules_broken.bitwiseAND(F.lit(1 << k)) != 0, F.lit(said)) for k, (said, _) in enumerate(rules)
    ]
    errors = F.when(rules_broken == 0, F.array().cast("array<string>"))
    if problem is not None:
        errors = errors.when(rules_broken == -1, F.array(problem))
    values = {f: F.col(f"_value.{f}") for f in parsers} | {f: text[f] for f in texts}
    typed = F.struct(*[values.get(c, F.col(c)).alias(c) for c in raw.columns])
    return rows.select(
        F.when(rules_broken == 0, typed).alias("typed"),
        F.when(rules_broken != 0, F.struct(*raw.columns)).alias("raw"),
        errors.otherwise(F.array_compact(F.array(*named))).alias("errors"),
    )


def check_lines(raw: DataFrame) -> DataFrame:
    return check_fields(raw, REQUIRED_FIELDS, TEXT_FIELDS, PARSERS)


def accepted(checked: DataFrame) -> DataFrame:
    """Rows that break no rule, with trimmed texts and typed values."""
    return checked.filter(F.size("errors") == 0).select("typed.*")


def rejected(checked: DataFrame) -> DataFrame:
    """Rows that break a rule, as they came, with ``errors`` listing every broken rule."""
    return checked.filter(F.size("errors") > 0).select("raw.*", "errors")


def split_lines(raw: DataFrame, folder: str, fmt: str = DEFAULT_FORMAT) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) lines, checked in one pass and stored in a folder of their own."""
    check_lines(raw).write.format(fmt).save(folder)
    checked = read_table(raw.sparkSession, folder, fmt)
    return accepted(checked), rejected(checked)


def accepted_lines(raw: DataFrame) -> DataFrame:
    return accepted(check_lines(raw))


def rejected_lines(raw: DataFrame) -> DataFrame:
    return rejected(check_lines(raw))


def positive_quantity(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("quantity") > 0)


def enforce_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The frame in the schema's column order, checked against it.

    Names and types are compared at once. NULLs in required columns fail the job
    that consumes the frame, in the same pass over the data.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: wanted {f.dataType.simpleString()}, found "
        f"{have[f.name].simpleString() if f.name in have else 'nothing'}"
        for f in schema.fields
        if have.get(f.name) != f.dataType
    ]
    wrong += [f"{name}: not in the schema" for name in have if name not in schema.fieldNames()]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(
        *[
            F.col(f.name)
            if f.nullable
            else F.coalesce(
                F.col(f.name),
                F.raise_error(F.lit(f"{f.name} must not be NULL")).cast(f.dataType),
            ).alias(f.name)
            for f in schema.fields
        ]
    )


def split_corrupt(
    df: DataFrame, corrupt_column: str, folder: str, fmt: str = DEFAULT_FORMAT
) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, malformed rows) of a permissive read, parsed once.

    The parsed rows are stored in a folder of their own first. A malformed row has its
    whole source line and whatever fields could be read.
    """
    df.write.format(fmt).save(folder)
    stored = read_table(df.sparkSession, folder, fmt)
    corrupt = F.col(corrupt_column).isNotNull()
    return stored.filter(~corrupt).drop(corrupt_column), stored.filter(corrupt)
