"""The filter audit and the line deduplication against plain versions."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sitescore.llm import filter_audit, line_dedup

from .conftest import edge_cases, rows

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    lowest = {}
    for i, t, *_ in docs:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    cases = []
    for i, t, lang, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len({*w}) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > lowest[t]}
        cases.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {c[0] for c in cases}:
        own = [c[1:] for c in cases if c[0] == part]
        shapley, steps = defaultdict(int), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                here = [c for c in left if c[0][f]]
                redundant = sum(c[0][f] for c in own) - len(here)
                left = [c for c in left if not c[0][f]]
                shapley[f] += len(here)
                unique = sum(c[0][f] and sum(c[0].values()) == 1 for c in own)
                steps.append((part, order, k + 1, len(left), len(here), redundant, unique, sum(c[1] for c in here), sum(c[2] for c in here)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, None), (None, 1, 1), (7, 1, 0), (7, 1, 0), (11, 0, 1), (3, 1, 0)]


def some_documents():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "Bb", "c$", "CC", "d"]) for _ in range(rng.choice([5, 150, 250]))) for _ in range(12)]
    texts += [" ".join(f"w{i}" for i in range(260)), "ÄÖÜ " * 300, "é" * 40]
    return [(rng.randrange(40), rng.choice(texts), rng.choice(["en", "fr", "", None]), "s") for _ in range(150)]


@pytest.mark.parametrize("docs", [edge_cases(), some_documents()], ids=["edges", "random"])
def test_audit_against_plain_orders(spark, docs):
    labels = spark.createDataFrame([(*x, "x") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    schema = "doc_id long, text string, lang string, source string, mask string, n string"
    got = filter_audit.audit(spark.createDataFrame([(*d, "x", "y") for d in docs], schema), labels)
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, LABELS)


def test_audit_of_nothing(empty, labels):
    assert filter_audit.audit(empty, labels).collect() == []
    with pytest.raises(ValueError):
        filter_audit.interactions(empty.select("part", "mask", "n", "good", "toxic"), [*"ABCDEFGH"])


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "x"), (3, "x")], "doc_id long, text string").withColumn("kind", F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, {"S": lambda t, w: F.size(w) < 2}, "kind").orderBy("filter_order", "step").collect()
    assert [tuple(r) for r in got] == [("1", "ES", 1, 2, 1, 0, 0, 0, 0, 1), ("1", "ES", 2, 1, 1, 1, 1, 0, 0, 3), ("1", "SE", 1, 1, 2, 0, 1, 0, 0, 3), ("1", "SE", 2, 1, 0, 1, 0, 0, 0, 1)]


def plain_lines(docs):
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t, *_ in docs:
        for x in (t or "").split("\n"):
            first[key(x)] = min(order(i), first.get(key(x), order(i)))
    out = []
    for i, t, *_ in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or order(i) == first[key(x)]]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect()), key=str)


def line_documents():
    rng = random.Random(8)
    lines = ["A line of prose", " a LINE of prose\t", "Ärger über Straßen", "ärger über straßen", "short", "", "  ", "ten chars.", "nine char", "one more line here\r", "common footer of all"]
    lines += [f"a line that is rarer {i}" for i in range(60)]
    docs = [(rng.randrange(60), "\n".join(rng.choices(lines, k=rng.choice([0, 1, 5, 90]))) + rng.choice(["", "\n"]) + "common footer of all", "en", "s") for _ in range(120)]
    return docs + docs[:5] + [(None, docs[0][1], None, None), (None, "a line only this one has\nA line of prose", None, None), (3, None, None, None), (4, "", None, None), (900, "common footer of all\n" * 3000, "en", "s")]


@pytest.mark.parametrize(("sample", "most", "size"), [(20_000, 1_000, 1 << 25), (20_000, 1_000, -1), (0, 0, 0), (20_000, 2, 0)], ids=["common", "shuffled", "ranges", "few"])
def test_lines_against_plain_version(spark, sample, most, size):
    docs = line_documents()
    table = spark.createDataFrame(rows(docs), "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"c{i} string" for i in range(len(rows(docs)[0]) - 5))).repartition(5)
    assert found(line_dedup.deduplicated(table, sample, most, size)) == plain_lines(docs)


def test_lines_of_edge_cases(edge, empty):
    assert found(line_dedup.deduplicated(edge)) == plain_lines(edge_cases())
    assert line_dedup.deduplicated(empty).collect() == []
    assert line_dedup.keep_bitmaps(empty).collect() == []


def test_bitmaps_name_the_lines_that_stay(spark):
    lines = [f"line number {i}" for i in range(200)]
    docs = spark.createDataFrame([(1, "\n".join(lines[70:75])), (2, "\n".join(lines))], "doc_id long, text string")
    (got,) = line_dedup.keep_bitmaps(docs).collect()
    assert (got["doc"], got["n_dropped"], [w["at"] for w in got["keep"]]) == (2, 5, [1])
    assert got["keep"][0]["bits"] == ~(0b11111 << 6)


def test_no_python_and_one_range_exchange(spark, sf):
    plan = line_dedup.dropped_lines(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and not re.search("Python|Arrow|Pandas", plan)
