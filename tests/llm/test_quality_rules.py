"""Quality rules against plain Python and the registered SQL."""

import os
import random
import re
from collections import Counter

import pytest
from oracle import compare, duck

from tablab.llm import quality_rules as R
from tablab.llm.queries import ORACLE, QUERIES


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in R.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, sf):
    ok, message = compare(QUERIES["op5_quality_rules"](spark, sf), duck(sf), ORACLE["op5_quality_rules"])
    assert ok, message


def test_counts_and_odd_texts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one two three four five", "a b c d e a b c d e", "x " * 30000, "é😀 " * 12, "l\nl\nl \n\nl"]
    texts += ["".join(rng.choice(["a", "b", "c"]) + rng.choice(" \n\t\x0b") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, rules string")
    rows = R.judge(docs)
    name = rows.columns[-1]
    assert rows.columns[:3] == docs.columns
    got = Counter(tuple(r[name])[:6] for r in rows.collect())
    assert got == Counter(brute(t) for t in texts)
    assert R.judge(docs.limit(0)).count() == 0


def test_lines(spark):
    prose = "This is a sentence of prose that stands on its own line and ends well."
    cases = {
        prose: (0, True),
        prose + "\nHome | About | News | Contact": (1, True),
        prose + "\nAll rights reserved.": (1, True),
        prose + "\n\n" + "no end at all here": (1, True),
        "\n".join(["a | b | c | d | e | f | g | h."] * 1 + [f"x{i} | y{i} | z{i} | q{i}." for i in range(4)]): (5, False),
        " ".join(f"word{i}&&&" for i in range(40)) + ".": (1, False),
        " ".join(f"WORD{i}!!" for i in range(40)): (1, False),
    }
    docs = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in R.judge(docs).collect():
        assert (r.rules.n_lines_removed, r.rules.kept) == cases[r.text], r
        assert r.rules.clean_text.split("\n")[0] in (prose, "")


def test_native_plan(spark):
    plan = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(Eval)|Exchange", plan)
    assert os.path.exists(R.__file__)
