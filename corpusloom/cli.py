"""Command line: python -m corpusloom.cli COMMAND.

list                                    names of all queries
query NAME FOLDER [--to PATH]           a query over the tables in a folder; shows it, or writes Parquet
run STAGE|all EDITION [--reset]         a stage of an edition; exits 2 if it was stopped
status EDITION                          what each stage has, as JSON
reredact EDITION                        redacts blobs of older versions again
freeze EDITION                          checks the tables and writes the manifest; exits 2 if something stands against it
facts EDITION [--check]                 publishes facts.json; with --check, exits 2 if it isn't what the tables say
labels EDITION FILE                     adds draft labels of use cases to a JSON file, keeping what is approved there
snapshot FROM TO --stage STAGE          copies the parts of a stage that the other edition's journal has and this one's hasn't
supervise STAGE EDITION                 starts a stage again until it ends well
site EDITION FOLDER                     writes the facts and use cases as JSON files, all or none
audit FOLDER                            the quality queries that found something; exits 2 if there are any
parse FILES --to PATH                   parses a Parquet table of files (repo, path, kind, text)
redact TABLE --to PATH                  redacts a Parquet table of doc_id, text
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import time
import uuid

from pyspark.sql import SparkSession

from corpusloom import stages
from corpusloom.functions import parse, redact
from corpusloom.plans import catalogue
from corpusloom.plans.facts import QUALITY
from corpusloom.sources.tables import Store
from corpusloom.streaming import runner

#: Quality queries that give a row for each fault, and the column that must be zero in those that count.
_ROWS = ("audit_duplicates", "exclusive_key_union_all")
_COUNTS = {"integrity_unique": "violations", "integrity_refs": "dangling", "not_in_anti_join": "dangling"}
_MARK = ".written-by-corpusloom"


def faults(spark: SparkSession, folder: str) -> dict[str, int]:
    found = {name: QUALITY[name](spark, folder).count() for name in _ROWS if name in QUALITY}
    for name, column in _COUNTS.items():
        found[name] = QUALITY[name](spark, folder).filter(f"{column} > 0").count()
    return {k: n for k, n in found.items() if n}


def merged_labels(drafts: dict[str, str], there: dict[str, dict]) -> dict[str, dict]:
    """Labels by id: those that are there stay as they are, new ids come as drafts."""
    return there | {k: {"label": v, "status": "draft"} for k, v in drafts.items() if k not in there}


def swap(folder: str, files: dict[str, object]) -> None:
    """Puts JSON files in place of a folder, all or none; refuses one that this command hasn't written. The folder is a link that one rename
    points to the new files, which lie hidden beside it, so it is there, old or new, at any time."""
    folder = folder.rstrip("/")
    if os.path.isdir(folder) and os.listdir(folder) and not os.path.exists(f"{folder}/{_MARK}"):
        raise ValueError(f"{folder} holds other files")
    part = os.path.join(os.path.dirname(folder), f".{os.path.basename(folder)}.{uuid.uuid4().hex}")
    try:
        for name, value in {_MARK: "", **files}.items():
            os.makedirs(os.path.dirname(f"{part}/{name}"), exist_ok=True)
            with open(f"{part}/{name}", "w") as f:
                f.write(value if isinstance(value, str) else json.dumps(value, sort_keys=True, indent=1))
    except BaseException:
        shutil.rmtree(part, ignore_errors=True)
        raise
    was = os.path.realpath(folder) if os.path.islink(folder) else None
    if was is None and os.path.isdir(folder):  # a folder of an older version, or an empty one
        was = f"{part}.old"
        os.rename(folder, was)
    os.symlink(os.path.basename(part), f"{part}.link")
    os.replace(f"{part}.link", folder)
    if was:
        shutil.rmtree(was, ignore_errors=True)


def report(facts: dict[str, dict]) -> str:
    """Facts as a table in markdown: numbers as they are, series by their length."""
    shown = lambda v: f"{len(v)} rows" if isinstance(v, list) else f"{v:,.4g}" if isinstance(v, float) else f"{v}"
    return "\n".join(["| fact | value |", "|-|-|", *[f"| {k} | {shown(v['value'])} |" for k, v in sorted(facts.items())]]) + "\n"


def main(args: list[str]) -> int:
    ask = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ask.add_argument("command", choices=("list", "query", "run", "status", "reredact", "freeze", "facts", "labels", "snapshot", "supervise", "site", "audit", "parse", "redact"))
    ask.add_argument("names", nargs="*")
    ask.add_argument("--to")
    ask.add_argument("--stage", choices=tuple(stages.STAGES))
    ask.add_argument("--check", action="store_true")
    ask.add_argument("--reset", action="store_true")
    told = ask.parse_args(args)
    if told.command == "list":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    names = told.names
    if told.command == "query":
        result = catalogue.queries()[names[0]](spark, names[1])
        result.write.parquet(told.to) if told.to else result.show(truncate=False)
    elif told.command in ("run", "supervise"):
        store = Store(spark, names[1])
        wanted = list(stages.STAGES) if names[0] == "all" else [names[0]]
        if told.command == "supervise":
            runner.supervise(lambda: 2 if any(stages.run(store, s).stopped for s in wanted) else 0, lambda: sum(n for s in stages.status(store).values() for n in s["rows"].values()), time.sleep)
            return 0
        for stage in wanted:
            if stages.run(store, stage, told.reset).stopped:
                return 2
    elif told.command == "status":
        print(json.dumps(stages.status(Store(spark, names[0])), sort_keys=True))
    elif told.command == "reredact":
        print(stages.reredact(Store(spark, names[0])))
    elif told.command == "freeze":
        try:
            print(json.dumps(stages.freeze(Store(spark, names[0])), sort_keys=True))
        except ValueError as against:
            print(against, file=sys.stderr)
            return 2
    elif told.command == "facts":
        against = stages.publish(Store(spark, names[0]), told.check)
        print("\n".join(against), file=sys.stderr)
        return 2 if against else 0
    elif told.command == "labels":
        rows = Store(spark, names[0]).read("use_cases").select("use_case_id", "label").toLocalIterator()
        there = json.load(open(names[1])) if os.path.exists(names[1]) else {}  # noqa: SIM115
        with open(names[1], "w") as f:
            json.dump(merged_labels({r.use_case_id: r.label for r in rows}, there), f, sort_keys=True, indent=1)
    elif told.command == "snapshot":
        print(runner.snapshot(Store(spark, names[0]), Store(spark, names[1]), told.stage, list(stages.STAGES[told.stage][2])))
    elif told.command == "site":
        store = Store(spark, names[0])
        facts = json.loads(stages.read_text(store, "facts.json") or '{"facts": {}}')
        cases = [r.asDict() for r in store.read("use_cases").orderBy("use_case_id").toLocalIterator()]
        swap(names[1], {"facts.json": facts, "use_cases.json": cases, "report.md": report(facts["facts"])})
    elif told.command == "audit":
        found = faults(spark, names[0])
        print(json.dumps(found, sort_keys=True))
        return 2 if found else 0
    else:
        table = spark.read.parquet(names[0])
        (parse.parse(table) if told.command == "parse" else redact.redact(table)).write.parquet(told.to)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
