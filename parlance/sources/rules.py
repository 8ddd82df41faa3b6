"""Screening rules as an input table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.rulesets import RuleSet, rule_set
from parlance.rules import sets as RS

#: Rules become expressions of the plan; a table with more is refused.
MOST_RULES = 1000


def rules_table(spark: SparkSession) -> DataFrame:
    """The built-in rules, base and extended, as the table that ``read_rules`` takes: write it out, edit it, load it."""
    return spark.createDataFrame([*RS.BASE_ROWS, *RS.EXTENDED_ROWS], RS.COLUMNS)


def _faults(spark: SparkSession, row) -> list[str]:
    found = []
    if row.layer not in RS.LAYERS:
        found.append(f"layer {row.layer!r} is none of {', '.join(RS.LAYERS)}")
    if row.place is None or not row.label or not row.pattern:
        return [*found, "place, label and pattern must be given"]
    if any(not (c.isalnum() or c in "_-") for c in row.label):
        found.append("a label has letters, digits, _ and - only")
    if '"' in row.pattern:
        found.append(r'a quote is written as \x22')
    if row.layer == "pii" and not row.mask:
        found.append("personal data needs a mask")
    try:
        compiled = spark.sparkContext._jvm.java.util.regex.Pattern.compile(row.pattern)
        if compiled.matcher("").find():
            found.append("the pattern matches an empty text")
    except Exception as e:  # the JVM's message says what is wrong with the pattern
        found.append(str(getattr(e, "java_exception", e)).splitlines()[0])
    return found


def load_rules(table: DataFrame, sets: Iterable[str] = ("base",)) -> RuleSet:
    """The rules of the given sets, checked and compiled when the plan is built; ValueError names every faulty row."""
    rows = table.where(F.col("rule_set").isin(list(sets))).select(*[c.split()[0] for c in RS.COLUMNS.split(", ")]).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    faults = [f"{r.layer}/{r.label}: {f}" for r in rows for f in _faults(table.sparkSession, r)]
    if faults:
        raise ValueError("; ".join(faults))
    return rule_set(tuple(r) for r in rows)


def read_rules(spark: SparkSession, path: str, sets: Iterable[str] = ("base",), fmt: str = "json") -> RuleSet:
    """``load_rules`` from JSON lines, CSV with a header, or Parquet."""
    reader = spark.read.schema(RS.COLUMNS).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return load_rules(reader.load(path), sets)
