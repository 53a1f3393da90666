"""Names, types and other small texts, as column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a system name at most.
MAX_NAME = 63
#: Open ends of validity.
MIN_DATE, MAX_DATE = "1900-01-01 00:00:00", "9999-12-31 00:00:00"


def undefined_min_date() -> Column:
    return F.lit(MIN_DATE).cast("timestamp_ntz")


def undefined_max_date() -> Column:
    return F.lit(MAX_DATE).cast("timestamp_ntz")


def valid_system_name(raw: Column, whole: bool = True) -> Column:
    """Lower case, runs of anything but word characters as one underscore, an underscore before a leading
    digit of a whole name, MAX_NAME characters."""
    name = F.regexp_replace(raw, r"^(\d)", "_$1") if whole else raw
    return F.left(F.lower(F.regexp_replace(name, r"(?U)\W+", "_")), F.lit(MAX_NAME))


def compose_system_name(name: Column, prefix: Column | None = None, postfix: Column | None = None, delimiter: str = "_") -> Column:
    """prefix, name and postfix with delimiters; the name is cut so that the whole fits."""

    def cost(part: Column | None):
        return F.lit(0) if part is None else F.coalesce(F.length(F.concat(part, F.lit(delimiter))), F.lit(0))

    middle = F.left(name, F.lit(MAX_NAME) - cost(prefix) - cost(postfix))
    return F.concat_ws(delimiter, *(p for p in (prefix, middle, postfix) if p is not None))


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([^_]+?)([A-Z])", "$1_$2"))


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, MAX_NAME * 100))


def _parts(name: Column) -> Column:
    return F.filter(F.split(name, "_"), lambda x: x != "")


def snake_to_camel(name: Column) -> Column:
    """Words capitalised and joined; null if there is none."""
    return F.nullif(F.array_join(F.transform(_parts(name), _capital), ""), F.lit(""))


def abbreviate_name(name: Column, adjust: bool = False, max_length: int | None = MAX_NAME, leave_last: int = 0) -> Column:
    """Words as their capitals, joined by underscores. adjust: only as many of the first words as the
    whole needs to fit. leave_last keeps characters after a word's last capital; words with fewer are
    left out. Null if nothing fits."""

    def word(x: Column) -> Column:
        tail = F.substring(x, 2, MAX_NAME * 100)
        return F.concat(F.upper(F.left(x, F.lit(1))), F.when(tail == F.upper(tail), F.lower(tail)).otherwise(tail))

    def short(x: Column) -> Column:
        capitals = F.regexp_replace(x, "[^A-Z/]", "")
        if leave_last <= 0:
            return capitals
        rest = F.regexp_extract(x, f"[A-Z]([^A-Z]{{{leave_last}}})[^A-Z]*$", 1)
        return F.when(rest != "", F.concat(capitals, rest))

    words = F.transform(_parts(name), word)
    shorts = F.transform(words, short)

    def candidate(k: Column) -> Column:
        head = F.array_join(F.filter(F.slice(shorts, 1, k), lambda x: x.isNotNull()), "_")
        if not adjust:
            return head
        rest = F.array_join(F.slice(words, k + 1, F.size(words)), "_")
        return F.when(rest != "", F.concat_ws("_", head, rest)).otherwise(head)

    count = F.size(words)
    found = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), candidate)).otherwise(
        F.array().cast("array<string>")
    )
    if adjust:
        found = F.concat(F.array(name), found)
    if max_length is not None:
        found = F.filter(found, lambda x: F.length(x) <= max_length)
    return F.get(found, F.lit(0)) if adjust else F.get(F.reverse(found), F.lit(0))


def indent_text(text: Column, level: int) -> Column:
    """Tabs after every line break (level > 0), or so many tabs taken away there (level < 0)."""
    if level > 0:
        return F.replace(text, F.lit("\n"), F.lit("\n" + "\t" * level))
    return F.replace(text, F.lit("\n" + "\t" * -level), F.lit("\n")) if level else text


def column_type_specification(data_type: Column, char_length: Column, precision: Column, scale: Column, fraction: Column) -> Column:
    """The canonical text of a column's type."""
    return (
        F.when(data_type.isin("character varying", "character") & char_length.isNotNull(), F.format_string("%s(%d)", data_type, char_length))
        .when((data_type == "numeric") & precision.isNotNull(), F.format_string("numeric(%d,%d)", precision, F.coalesce(scale, F.lit(0))))
        .when((data_type == "timestamp without time zone") & fraction.isNotNull(), F.format_string("timestamp(%d) without time zone", fraction))
        .otherwise(data_type)
    )


UNITS = ("kB", "MB", "GB", "TB")


def pretty_size(size: Column, largest: str = UNITS[-1]) -> Column:
    """Bytes, then kB, MB, GB and TB up to the largest unit, each from ten thousand of the one before, rounded."""
    out = F.concat(size.cast("string"), F.lit(" bytes"))
    for power, unit in enumerate(UNITS[: UNITS.index(largest) + 1], 1):
        value = F.round(size / F.lit(1024.0**power)).cast("long").cast("string")
        out = F.when(size >= 10 * 1024**power, F.concat(value, F.lit(f" {unit}"))).otherwise(out)
    return out


def whole_percent(part: Column, total: Column) -> Column:
    """How much larger part is than total, as a whole number with a percent sign; null without a total."""
    return F.concat(F.round(F.try_divide((part - total) * 100, total)).cast("long").cast("string"), F.lit("%"))


_BLOCK = r"(?s)/\*\s*#if\s+#server_major_version\s*(>=|<=|>|<|=)\s*(\d+)\s*\*/(.*?)/\*\s*#endif\s*\*/"
_SPACE_AROUND = r"^\s+|\s+$"


def expand_compatibility_macros(code: Column, level: Column) -> Column:
    """code with its conditional comment blocks resolved for a version; below 12 no materialisation fence.
    Without a version it stays as it is. Versions are compared as numbers."""

    def chosen(block: Column) -> Column:
        sign, number = (F.regexp_extract(block, _BLOCK, i) for i in (1, 2))
        number = number.cast("int")
        halves = F.split(F.regexp_extract(block, _BLOCK, 3), r"/\*\s*#else\s*\*/")
        then = F.regexp_replace(F.get(halves, F.lit(0)), r"/\*\s*#then\s*\*/", "")
        # the other branch stands in a comment, so that the code is valid as it is
        other = F.regexp_replace(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), _SPACE_AROUND, "")
        other = F.regexp_replace(other, r"^/\*|\*/$", "")
        holds = (
            F.when(sign == ">=", level >= number)
            .when(sign == "<=", level <= number)
            .when(sign == ">", level > number)
            .when(sign == "<", level < number)
            .otherwise(level == number)
        )
        return F.regexp_replace(F.when(holds, then).otherwise(other), _SPACE_AROUND, "")

    blocks = F.transform(F.regexp_extract_all(code, F.lit(_BLOCK), F.lit(0)), chosen)
    between = F.split(code, _BLOCK, -1)
    rest = F.zip_with(blocks, F.slice(between, 2, F.size(blocks)), lambda a, b: F.concat(a, b))
    out = F.concat(F.get(between, F.lit(0)), F.array_join(rest, ""))
    plain = F.regexp_replace(out, r"\bas\s+(not\s+)?materialized\b", "as")
    return F.when(level.isNull(), code).when(level < 12, plain).otherwise(out)


def target_routine_name(signature: Column) -> Column:
    """A routine's name with its argument types, without the schema before it."""
    return F.regexp_replace(signature, r"^[^.(]+\.", "")


def month_names(spark: SparkSession, languages: list[tuple[str, str]]) -> DataFrame:
    """Twelve months for each (language, country), spelled in it."""
    every = spark.createDataFrame([(a, f"{a}-{b}", m) for a, b in languages for m in range(1, 13)], "lang_code string, locale string, n_month int")

    def spelled(locale: str, pattern: str) -> Column:
        return F.to_csv(F.struct(F.make_date(F.lit(2024), F.col("n_month"), F.lit(1))), {"locale": locale, "dateFormat": pattern})

    def by_locale(pattern: str) -> Column:
        out = F.lit(None).cast("string")
        for a, b in languages:
            out = F.when(F.col("locale") == f"{a}-{b}", spelled(f"{a}-{b}", pattern)).otherwise(out)
        return F.regexp_replace(out, '[".]', "")

    named = every.withColumn("s_month_mm", F.lpad(F.col("n_month").cast("string"), 2, "0"))
    named = named.withColumn("s_month_mon", F.lower(by_locale("LLL"))).withColumn("s_month", F.lower(by_locale("LLLL")))
    return named.withColumns(
        {
            "s_month_mon_cap": F.initcap("s_month_mon"),
            "s_month_cap": F.initcap("s_month"),
            "s_month_mon_uc": F.upper("s_month_mon"),
            "s_month_uc": F.upper("s_month"),
        }
    )
