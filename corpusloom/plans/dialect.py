"""One query text for Spark SQL and for DuckDB: where the two differ, a dialect writes the expression."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Spark:
    name = "spark"
    semi = "LEFT SEMI"

    def re(self, pattern: str) -> str:
        return "r'" + pattern.replace("'", "\\x27") + "'"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def explode(self, x: str) -> str:
        return f"explode({x})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def some(self, items: str) -> str:
        """The items that aren't null, as an array."""
        return f"filter(array({items}), x -> x IS NOT NULL)"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.re(pattern)})"

    def found(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, {group})"

    def first(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.re(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.re(pattern)}, {self.re(by)})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.re(by)}, -1)"

    def count_unique(self, x: str) -> str:
        """The number of different x in groups that hold each x once and no null: no task keeps the values."""
        return f"count({x})"

    def first_of(self, table: str, n: int) -> str:
        """Rows of a table that hold the first n of each language by the digest of doc_id, with digests for texts: found share by share, so no task
        sorts a whole language."""
        share = f"SELECT sha2(text, 256) AS text, lang, doc_id, row_number() OVER (PARTITION BY lang, pmod(xxhash64(doc_id), 64) ORDER BY md5(CAST(doc_id AS STRING))) AS share FROM {{{table}}}"
        return f"({share}) WHERE share <= {n}"

    def lines_of(self, table: str, keys: str, x: str) -> str:
        """A query: keys, n (from 1), line."""
        return f"SELECT {keys}, pos + 1 AS n, line FROM {table} LATERAL VIEW posexplode(split({x}, r'\\n', -1)) v AS pos, line"

    def sorted_set(self, x: str, where: str = "true") -> str:
        return f"array_join(array_sort(collect_set(CASE WHEN {where} THEN {x} END)), ',')"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '{path}')"

    def epoch(self, x: str) -> str:
        return f"unix_seconds(CAST({x} AS TIMESTAMP))"


class Duck(Spark):
    name = "duck"
    semi = "SEMI"

    def re(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def explode(self, x: str) -> str:
        return f"unnest({x})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def some(self, items: str) -> str:
        return f"list_filter([{items}], lambda x: x IS NOT NULL)"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.re(pattern)})"

    def found(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.re(pattern)}, {self.re(by.replace('$', chr(92)))}, 'g')"

    def split(self, x: str, by: str) -> str:
        return f"string_split_regex({x}, {self.re(by)})"

    def sorted_set(self, x: str, where: str = "true") -> str:
        return f"coalesce(string_agg(DISTINCT {x}, ',' ORDER BY {x}) FILTER (WHERE {where}), '')"

    def count_unique(self, x: str) -> str:
        return f"count(DISTINCT {x})"

    def first_of(self, table: str, n: int) -> str:
        return f"{{{table}}}"

    def lines_of(self, table: str, keys: str, x: str) -> str:
        return f"SELECT {keys}, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS line FROM (SELECT *, string_split({x}, chr(10)) AS a FROM {table}) v"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '{path}')"

    def epoch(self, x: str) -> str:
        return f"CAST(floor(epoch({x})) AS BIGINT)"


@dataclass
class Sql:
    """A query by its text; views are named by the tables' names. oracle: DuckDB's text where it isn't the same one."""

    text: Callable[[Spark], str]
    oracle: Callable[[Duck], str] | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        text = self.text(Spark())
        mark = hashlib.md5(sf_dir.encode()).hexdigest()[:8]  # views of two folders live side by side
        for t in TABLES:
            if f"{{{t}}}" in text:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"{t}_{mark}")
                text = text.replace(f"{{{t}}}", f"{t}_{mark}")
        return spark.sql(text)

    def duck(self) -> str:
        text = (self.oracle or self.text)(Duck())
        for t in TABLES:
            text = text.replace(f"{{{t}}}", t)
        return text
