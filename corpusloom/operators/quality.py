"""Checks on an edition: which relations a query may read, drift between two sets of facts, the freeze gate."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import digest, sums


def relations(spark: SparkSession, text: str) -> set[str]:
    """Names of all relations that a query reads, by Spark's own parser (its with-names left out)."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    names = set(re.findall(r"'UnresolvedRelation \[([^\]]+)\]", plan))
    own = set(re.findall(r"(?:WITH|,)\s+(\w+)\s+AS\s*\(", text, re.I))
    return {n.replace(", ", ".") for n in names} - own


def fact_kind(spark: SparkSession, text: str) -> str:
    """scalar or series, as the first line says; only views named v_... may be read."""
    head = re.match(r"--\s*kind:\s*(scalar|series)\s*\n", text)
    if not head:
        raise ValueError("a fact starts with -- kind: scalar or -- kind: series")
    if other := {n for n in relations(spark, text) if not n.startswith("v_")}:
        raise ValueError(f"facts may not read {sorted(other)}")
    return head[1]


def fact(spark: SparkSession, text: str):
    """A fact's value: one number, or a list of rows (a published series is short)."""
    kind, rows = fact_kind(spark, text), spark.sql(text)
    if kind == "series":
        return [r.asDict() for r in rows.toLocalIterator()]
    found = rows.limit(2).collect()
    if len(found) != 1 or len(rows.columns) != 1:
        raise ValueError("a scalar fact has one row and one column")
    return float(found[0][0]) if found[0][0] is not None and not isinstance(found[0][0], int | str) else found[0][0]


def drift(now: DataFrame, was: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on one side only, or with values that differ by more than rounding."""
    a, b = now.select(F.col(key).alias("k"), F.col(value).alias("a")), was.select(F.col(key).alias("k"), F.col(value).alias("b"))
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(1e-12), F.lit(1e-9) * F.greatest(F.abs("a"), F.abs("b")))
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~near, "drift")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), state.alias("state")).filter("state is not null")


def content_hash(table: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: the count and sums of pieces of their hashes."""
    return digest(sums(table))


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def violations(tables: dict[str, DataFrame], unique: dict[str, list[str]], refs: list[tuple[str, str, str, str]]) -> list[tuple[str, int]]:
    """(rule, number) of keys that repeat and of references to nothing; empty tables have none."""
    parts = [(f"{t}: repeated keys", duplicates(tables[t], keys)) for t, keys in unique.items()]
    parts += [(f"{a}.{x}: without {b}", dangling(tables[a], x, tables[b], y)) for a, x, b, y in refs]
    if not parts:
        return []
    counted = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")) for k, (_, df) in enumerate(parts)])
    there = {r.k: r.n for r in counted.collect()}  # a row for each rule
    return [(rule, there.get(k, 0)) for k, (rule, _) in enumerate(parts)]


def freeze(tables: dict[str, DataFrame], unique: dict[str, list[str]], refs: list[tuple[str, str, str, str]], version: int, stored: DataFrame | None = None, pending: int = 0, hashes: dict[str, str] | None = None) -> dict:
    """The manifest of an edition; a ValueError names what stands against it. stored: blobs with the version they were redacted
    under; pending: inputs that are not parsed yet; hashes: of the tables, where they are known."""
    against = [f"{rule} ({n})" for rule, n in violations(tables, unique, refs) if n]
    if stored is not None and (stale := stored.filter(F.col("version") < version).count()):
        against.append(f"{stale} blobs redacted under an older version")
    if pending:
        against.append(f"{pending} inputs not parsed")
    if against:
        raise ValueError("; ".join(against))
    hashes = hashes or {t: content_hash(df) for t, df in sorted(tables.items())}
    return {"redact_version": version, "tables": hashes, "edition_hash": hashlib.sha256(repr((version, sorted(hashes.items()))).encode()).hexdigest()}


def approved(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """ids: id. labels: id (or * for all), label, status. id, label, status of the approved one, else of the wildcard's, else
    draft; a digit in an approved label is an error."""
    digit = F.raise_error(F.concat(F.lit("a digit in the label of "), F.col("id")))
    good = labels.filter("status = 'approved'").withColumn("label", F.when(F.col("label").rlike("[0-9]"), digit.cast("string")).otherwise(F.col("label")))
    own = good.filter("id != '*'").select("id", F.col("label").alias("own"))
    other = good.filter("id = '*'").agg(F.max("label").alias("other"))  # one row
    told = ids.join(own, "id", "left").join(F.broadcast(other))
    return told.select("id", F.coalesce("own", "other").alias("label"), F.when(F.coalesce("own", "other").isNull(), "draft").otherwise("approved").alias("status"))
