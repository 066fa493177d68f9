"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Base kinds are found by pattern, leftmost and non-overlapping per kind: ``assign`` (a keyword, ``:`` or ``=`` and a value
of 12 or more characters), ``access`` (``AKIA...``, 18 or more) and ``hex`` (16 or more).  The method then judges
*values*: those of the base spans and bare tokens of 20 or more characters.  Every value's hash is counted over the whole
corpus by distinct owners and repositories.  A value that many owners hold is a copied example; a value that at most
``max_owners`` owners and ``max_repositories`` repositories hold, and that looks live (letters and digits, many different
characters, no placeholder word), is a credential of its own: it gets a span of kind ``live`` wherever it occurs, also
where no keyword stands before it.  Base spans stay whatever the verdict.

Positions are code points, end exclusive.  Spark's functions return matches without places, so a text is both split at
and searched for a pattern, and places are running sums over the lengths of gaps and matches, in blocks of 64, so that a
text with many matches takes no quadratic time.

At scale: texts are read once and never shuffled.  Only values travel: owner counts go through partially aggregated
groups of (hash, owner, repository), then (hash, owner), then hash; the verdict returns by ``common.join_facts``, so a
value pasted into a third of all documents meets no single task.  Rows get numbers of their own in a written table, so
repeated or null ids neither merge nor get lost.

Defined results: a null text is an empty one: no spans; a null owner or repository counts as one unknown owner or
repository; repeated rows count as rows but not as owners; rows with null or repeated ids each keep their own result;
extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablab.llm.common import join_facts, materialise, ref

#: Kinds in the order that breaks ties between spans with one start; the last is the one the method adds.
KINDS = ("assign", "access", "hex", "live")
KEYWORDS = ("password", "passwd", "secret", "token")
#: Shortest value of an assignment, and of a live-looking value anywhere.
MIN_VALUE, BARE = 12, "[A-Za-z0-9+/_-]{20,}"
#: Words that mark a value as a placeholder, in lower case, and the fewest different characters of a live one.
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "xxxx", "0000", "1234567", "abcdef")
DISTINCT_CHARACTERS = 8
_BLOCK = 64


def either_case(word: str) -> str:
    """Pattern of an ASCII word in either case, without the case folding of other alphabets."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORD = "(" + "|".join([*map(either_case, KEYWORDS), f"{either_case('api')}_?{either_case('key')}"]) + ")"
ASSIGN = KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Maximal runs, so the shortest length can stand in the pattern itself.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _ends(steps: Column) -> Column:
    """Running sums of an array of int, by blocks."""
    def with_blocks(blocks: Column) -> Column:
        return _let(
            F.transform(blocks, lambda _, b: _sum(F.slice(blocks, F.lit(1), b))),
            lambda before: F.transform(steps, lambda _, i: F.get(before, F.floor(i / _BLOCK).cast("int"))
                                       + _sum(F.slice(steps, (i - i % _BLOCK) + 1, i % _BLOCK + 1))),
        )

    starts = F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(_BLOCK))
    return _let(F.transform(starts, lambda s: _sum(F.slice(steps, s + 1, F.lit(_BLOCK)))), with_blocks)


def _matches(text: Column, pattern: str, kind: int, value_of=lambda m: m) -> Column:
    """Array of (start, end, kind, at, value) of all matches; ``at`` is where the value starts, which ends with the match."""
    def placed(found: Column) -> Column:
        def spans(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
            return _let(steps, lambda s: _let(_ends(s), lambda ends: F.transform(found, lambda m, i: _let(value_of(m), lambda v: F.struct(
                (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind"),
                (F.get(ends, i) - F.length(v)).alias("at"), v.alias("value"))))))

        return _let(F.split(text, pattern), spans)

    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,at:int,value:string>>)")
    return F.when(F.rlike(text, F.lit(pattern)), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def looks_live(value: Column) -> Column:
    """Letters and digits, enough different characters, no placeholder word."""
    return (
        (F.length(value) >= MIN_VALUE)
        & F.rlike(value, F.lit("[0-9]"))
        & F.rlike(value, F.lit("[A-Za-z]"))
        & ~F.rlike(F.lower(value), F.lit("|".join(PLACEHOLDERS)))
        & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_CHARACTERS)
    )


def candidates(text: Column) -> Column:
    """All base spans and bare tokens of a text as array of (start, end, kind, at, hash, live); bare tokens have the
    kind of ``live`` and stay only if they look live."""
    def assigned(m: Column) -> Column:
        return F.regexp_extract(m, ASSIGN, 2)

    assign = F.filter(_matches(text, ASSIGN, 0, assigned), lambda x: F.length(x["value"]) >= MIN_VALUE)
    bare = F.filter(_matches(text, BARE, 3), lambda x: looks_live(x["value"]))
    found = F.concat(assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2), bare)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"),
                                                 x["at"].alias("at"), F.sha2(x["value"], 256).alias("hash"), looks_live(x["value"]).alias("live")))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, occurrences) of every value, from rows (hash, owner, repository)."""
    one = F.count(F.lit(1))
    by_repository = found.groupBy("hash", "owner", "repository").agg(one.alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(one.alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(one.alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("occurrences"))


def scan_secrets(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text",
                 max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """One row per row of ``docs``: the id column; ``base`` and ``live``, arrays of (start, end, kind) sorted by place, of
    the pattern's spans and of the spans that the method adds; ``copied``, the number of base spans whose value more
    owners or repositories hold."""
    text = F.coalesce(ref(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), ref(id_col).alias("id"), owner.alias("owner"), repository.alias("repository"),
                       candidates(text).alias("found"))
    rows = materialise(rows, "secret-candidates")
    values = materialise(rows.select("row", "owner", "repository", F.inline("found")), "secret-values")
    facts = materialise(ownership(values), "secret-owners")
    judged = join_facts(values.select("row", "start", "end", "kind", "at", "live", "hash"), facts, ["hash"], "occurrences")
    own = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    # one document's spans meet again: as many as its text holds
    verdict = judged.groupBy("row").agg(
        F.sort_array(F.collect_set(F.when(own & F.col("live"), F.struct(F.col("at").alias("start"), "end", F.lit(3).alias("kind"))))).alias("live"),
        F.count(F.when(~own & (F.col("kind") < 3), 1)).alias("copied"),
    )
    base = F.sort_array(F.transform(F.filter("found", lambda x: x["kind"] < 3), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    out = rows.select("row", "id", F.transform(base, span).alias("base")).join(verdict, "row", "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("live", none).alias("live"), F.coalesce("copied", F.lit(0)).cast("long").alias("copied"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    by_place = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(by_place, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
