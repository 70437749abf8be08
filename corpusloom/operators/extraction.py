"""The contract with a model that extracts records from texts: batches that can't be forged, typed checks of what comes
back, answers that are kept, and batches that are halved when a call fails.

The first record of an id counts; its fields are checked in order, each by its JSON type, and a quote must be in its source up
to white space. Defined cases: records that aren't objects, of unknown ids, or of ids seen before are ignored; a source
without a record is "missing"; a null source counts as empty; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_QUOTE, MOST_CHARS, BATCH = 200, 6000, 20
TEXT_KINDS = ("claude_md", "skill", "agent", "command")


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def meant(quote: Column) -> Column:
    return flat(F.replace(F.replace(quote, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')))


def quoted(quote: Column, source: Column) -> Column:
    """Whether a quote is in its source; an empty one never is."""
    said = meant(quote)
    return F.coalesce((said != "") & (source.contains(quote) | flat(source).contains(said)), F.lit(False))


def _field(record: Column, key: str) -> Column:
    return F.try_variant_get(record, f"$.{key}", "variant")


def _is(value: Column, kind: str) -> Column:
    """Whether a VARIANT is there and of a JSON type."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _string(value: Column) -> Column:
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def reason(record: Column, source: Column) -> Column:
    """Why a record (VARIANT) is rejected; null if it isn't. Techniques are judged one by one, the first fault counts."""
    notable, listed = _field(record, "notable"), _field(record, "techniques_described")

    def fault(t: Column) -> Column:
        quote = _string(_field(t, "evidence_quote"))
        return (
            F.when(~_is(t, "OBJECT") | ~_is(_field(t, "name"), "STRING"), "bad_techniques")
            .when(quote.isNull() | (F.length(quote) > MOST_QUOTE) | (meant(quote) == ""), "bad_quote_length")
            .when(~quoted(quote, source), "quote_not_verbatim")
        )

    techniques = F.when(_is(listed, "ARRAY"), F.try_variant_get(listed, "$", "array<variant>"))
    faults = F.filter(F.transform(techniques, fault), lambda x: x.isNotNull())
    return (
        F.when(F.coalesce(F.trim(_string(_field(record, "use_case"))), F.lit("")) == "", "bad_use_case")
        .when(~_is(_field(record, "domain_guess"), "STRING"), "bad_domain_guess")
        .when(~_is(_field(record, "non_coding"), "BOOLEAN"), "bad_non_coding")
        .when(notable.isNotNull() & ~_is(notable, "VOID") & ~_is(notable, "STRING"), "bad_notable")
        .when(techniques.isNull(), "bad_techniques")
        .otherwise(F.get(faults, F.lit(0)))
    )


def score(sources: DataFrame, records: DataFrame) -> DataFrame:
    """sources: id, source; records: n (order), json. One row per source: id, record (VARIANT), reason (missing: no record)."""
    read = records.select("n", F.try_parse_json("json").alias("record"))
    named = read.filter(_is(F.col("record"), "OBJECT")).withColumn("id", _string(_field(F.col("record"), "id"))).filter("id is not null")
    place = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    first = named.withColumn("place", place).filter("place = 1").select("id", "record")
    told = sources.join(first, "id", "left")
    return told.select("id", "record", F.when(F.col("record").isNull(), "missing").otherwise(reason(F.col("record"), F.coalesce("source", F.lit("")))).alias("reason"))


def representatives(clusters: DataFrame, artifacts: DataFrame) -> DataFrame:
    """cluster_id, artifact_id, source: the canonical artifact of each cluster of texts, cut to MOST_CHARS characters."""
    texts = artifacts.select("artifact_id", F.substring(F.coalesce("text", F.lit("")), 1, MOST_CHARS).alias("source"))
    wanted = clusters.filter(F.col("kind").isin(*TEXT_KINDS)).select("cluster_id", F.col("canonical_artifact").alias("artifact_id"))
    return wanted.join(texts, "artifact_id").select("cluster_id", "artifact_id", "source")


def prompts(numbered: DataFrame, nonce: str) -> DataFrame:
    """numbered: batch, id, source. batch, prompt: the sources of a batch between tags that hold a nonce, so no text can close
    its own. A batch holds BATCH sources or so; its prompt is one row."""
    tag = F.concat(F.lit("artifact-"), F.substring(F.sha2(F.concat(F.lit(nonce), F.col("batch").cast("string")), 256), 1, 12))
    one = F.concat(F.lit("<"), tag, F.lit(' id="'), "id", F.lit('">\n'), "source", F.lit("\n</"), tag, F.lit(">"))
    gathered = F.array_sort(F.collect_list(F.struct("id", one.alias("text"))))
    return numbered.groupBy("batch").agg(F.array_join(F.transform(gathered, lambda x: x["text"]), "\n\n").alias("prompt"))


def answer_key(*parts) -> str:
    """What an answer is kept under: model, system text, prompt and schema."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:24]


def unanswered(asked: DataFrame, kept: DataFrame) -> DataFrame:
    """The calls (key and others) that no kept answer has the key of."""
    return asked.join(kept.select("key").distinct(), "key", "left_anti")


def halved(items: list, call: Callable[[list], list | None]) -> tuple[list, list]:
    """(answers, items that failed alone): a call that gives None is made again for each half of its items."""
    pending, done, failed = [items], [], []
    while pending:
        some = pending.pop()
        if (found := call(some)) is not None:
            done += found
        elif len(some) > 1:
            middle = len(some) // 2
            pending += [some[middle:], some[:middle]]
        else:
            failed += some
    return done, failed


class LimitReached(Exception):
    """The plan's limit: nothing more may be asked for now."""


def envelope(text: str) -> tuple[dict | None, str | None]:
    """(data, error) of a call's JSON envelope: structured_output, or else its result as JSON."""
    try:
        told = json.loads(text)
    except ValueError as e:
        return None, f"envelope: {e}"
    if not isinstance(told, dict):
        return None, "envelope is not an object"
    if told.get("api_error_status") == 429:
        raise LimitReached(str(told.get("result")))
    if told.get("is_error"):
        return None, f"is_error: {told.get('result')}"
    data = told.get("structured_output")
    if data is None:
        try:
            data = json.loads(told.get("result") or "")
        except ValueError:
            return None, "no structured_output"
    return (data, None) if isinstance(data, dict) else (None, "structured_output is not an object")


def fake_answers(sources: DataFrame) -> DataFrame:
    """id, n, json: what a deterministic stand-in for a model says of each source."""
    said = F.regexp_extract("source", r"(?m)^Uses Claude to .+$", 0)
    lines = F.filter(F.transform(F.split("source", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    use = F.when(said != "", said).otherwise(F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, 120))
    quotes = F.when(use != "", F.array(F.struct(F.lit("stated purpose").alias("name"), F.substring(use, 1, MOST_QUOTE).alias("evidence_quote")))).otherwise(F.array().cast("array<struct<name:string,evidence_quote:string>>"))
    record = F.struct("id", use.alias("use_case"), F.lit("fixture").alias("domain_guess"), F.lower(use).contains("novel").alias("non_coding"), quotes.alias("techniques_described"))
    return sources.select("id", F.lit(0).alias("n"), F.to_json(record).alias("json"))
