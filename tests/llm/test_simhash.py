"""SimHash near-duplicates against brute force over all pairs."""

import random

import pytest
import xxhash

from tablab.llm.queries import QUERIES
from tablab.llm.simhash import drop_near_duplicates, near_pairs, shingle_hashes, simhash, simhash_components

SF = "/root/testdata/sf0.001"


def brute_print(text, size=3):
    words = "" if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """prints: list of (id, fp); smallest id reachable for each row."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                group[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(prints))]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in docs]
    want = sorted((k, f"{fp:016x}", c) for (k, fp), c in zip(prints, brute_components(prints, 2)))
    got = sorted(tuple(r) for r in QUERIES["op9_simhash_near_dedup"](spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_links_give_the_components_of_all_close_pairs(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            for _ in range(rng.randint(0, 4)):
                b ^= 1 << rng.randrange(64)
            prints.add(b)
    prints = sorted(prints)
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    pairs = near_pairs(spark.createDataFrame(rows, "fp long"), radius).collect()
    mask = (1 << 64) - 1
    assert all(((p.a ^ p.b) & mask).bit_count() <= radius for p in pairs)
    group = {p: p for p in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for p in pairs:
        group[root(p.a & mask)] = root(p.b & mask)
    numbered = [(i, p) for i, p in enumerate(prints)]
    want = brute_components(numbered, radius)
    assert len({root(p) for p in prints}) == len(set(want))


def test_odd_inputs(spark):
    rows = [(1, "Same words here again", "x"), (2, "same  words\there again", "y"), (2, "same  words\there again", "y"),
            (3, None, "z"), (4, "", "z"), (5, "two words", None), (None, "same words here again", "n"), (7, "w " * 70000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash_components(docs).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 5), (7, 7)]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7]
    assert simhash_components(docs.limit(0)).count() == 0
    assert drop_near_duplicates(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "q r s t")], "doc_id long, text string")
    assert [r.component_id for r in simhash_components(nameless).collect()] == [None] * 3
    assert drop_near_duplicates(nameless).count() == 2


def test_one_row_of_every_component(spark):
    rng = random.Random(3)
    near = {}  # a text one or two bits from another, by brute force
    words = [f"w{i}" for i in range(400)]
    while len(near) < 3:
        text = [rng.choice(words) for _ in range(300)]
        for k in range(300):
            other = [*text[:k], "changed", *text[k + 1 :]]
            if 1 <= (brute_print(" ".join(text)) ^ brute_print(" ".join(other))).bit_count() <= 2:
                near[" ".join(text)] = " ".join(other)
                break
    (a, a2), (b, b2), (c, c2) = near.items()
    # id 5 is the smallest of two unrelated components; copies without ids that are 1 or 2 bits apart are one component
    rows = [(5, a), (6, a2), (5, b), (7, b2), (None, c), (None, c2), (None, c)]
    assert len(set(brute_components([(i, brute_print(t)) for i, (_, t) in enumerate(rows)], 2))) == 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in drop_near_duplicates(docs).collect()]
    assert sorted(r for r in kept if r[0]) == sorted([(5, a), (5, b)])
    assert [r[1] in (c, c2) for r in kept if r[0] is None] == [True]
    named = spark.createDataFrame([(f"k{i}" if i else None, t) for i, t in rows], "doc_id string, text string")
    assert sorted(drop_near_duplicates(named).collect(), key=str) == sorted([("k5" if i else None, t) for i, t in kept], key=str)


def test_fingerprint_needs_more_than_half():
    assert simhash(shingle_hashes("a b c", 3)) == xxhash.xxh64_intdigest(b"a b c", 42)
    a, b = (xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c d"))
    assert simhash(shingle_hashes("A b c d", 3)) == a & b
