"""Digits in page copy: what counts, what doesn't, and where."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.copydigits import copy_digits, scan


@pytest.mark.parametrize("source, want", [
    ("<p>We saw 12 of them</p>", [(1, "We saw 12 of them")]),
    ("<p>\n  none\n  in 3 rows\n</p>", [(3, "in 3 rows")]),
    ("<p>none</p><!-- 7 --><style>a { width: 9px }</style>", []),
    ('<a href="/x/2" class="c3" data-n="4" title="five">x</a>', []),
    ('<img alt="Figure 2" width="30">', [(1, "Figure 2")]),
    ("<p>{count + 10}</p>", []),
    ('<p>{ok ? "yes" : "at 5 pm"}</p>', [(1, "at 5 pm")]),
    ("<p>{rows.map((r) => <li>row 8 {r.n}</li>)}</p>tail 9", [(1, "row 8"), (1, "tail 9")]),
    ("<p>{rows.map((r) => { return <b>in {r.x * 2} of 4</b>; })}</p>", [(1, "of 4")]),
    ("{a < 5 && <br>}6", [(1, "6")]),
    ('<script>const a = 5; // 6\n/* 7 */ const b = "eight 8"; const c = "./m9.js";</script>', [(2, "eight 8")]),
    ("<script>\nimport x from 'lib2';\nexport * from \"pkg3\";\nconst y = 'v4';</script><p>5</p>", [(4, "v4"), (4, "5")]),
    ("<p>{`a ${n + 1} b2 ${`c3`} d`}</p>", [(1, "b2"), (1, "c3")]),
    ("<p>{`/path/${n}/2`}</p>", []),
    ("---\nimport a from 'x1';\nconst t = 'two 2';\n---\n<p>three 3</p>", [(3, "two 2"), (5, "three 3")]),
    ('<div set:html={x} />', [(1, "set:html")]),
    ('<C title={"n 1"} n={2} />', [(1, "n 1")]),
    ("<p>it's {'it\\'s 4'}</p>", [(1, "it\\'s 4")]),
    ("<!DOCTYPE html5><p>a<b", []),
    ("<script>const s = 'x", []),
    ("<p>{unclosed 'a 1'", [(1, "a 1")]),
    ("3 < 4", [(1, "3 < 4")]),
    ("", []), (None, []),
])
def test_what_counts(source, want):
    assert sorted(copy_digits(source)) == sorted(want)


def test_any_text_ends(spark):
    """Whatever the source, the machine ends; a long one in time about linear."""
    rng = random.Random(2)
    pieces = ["<p>", "</p>", "{", "}", "`", "${", '"', "'", "<", ">", "/", "<!--", "-->", "<script>", "</script>", "---\n", "\n", "1", "a=", "return ", "\\", "//", "/*", "*/", "=", "<style>"]
    for _ in range(3000):
        copy_digits("".join(rng.choices(pieces, k=rng.randint(1, 40))))
    began = time.time()
    for text in ("<p>{x.map(y => <b>1</b>)}</p>\n" * 20_000, "`${" * 20_000, "<p " * 50_000, "{" * 100_000, "'" * 100_000):
        copy_digits(text)
    assert time.time() - began < 20


def test_pages(spark):
    rows = spark.createDataFrame([(1, "<p>1</p>"), (2, None), (3, ""), (1, "<p>1</p>")], "id bigint, html string")
    got = sorted((r.id, [tuple(x) for x in r.found]) for r in scan(rows, "id", F.col("html")).collect())
    assert got == [(1, [(1, "1")]), (1, [(1, "1")]), (2, []), (3, [])] and scan(rows.limit(0), "id", F.col("html")).count() == 0
