"""Line-first quality rules, in DataFrame functions only.

Base counts look at the whole text; then every line is judged on its own by punctuation, navigation and boilerplate
rules, the lines that fail are removed, and a document that loses too much of its text that way is rejected.

All work on a document happens inside its row: arrays of words, lines and five-word windows, no shuffle, no grouping, so
no source or repeated text can make a task heavier than its share of bytes.  Repeated windows are found by sorting the
windows' 64-bit hashes within the document, which takes n log n steps for a text of n words.

Defined results: a null text is an empty one: all counts 0, base failed; a line without a word is neither counted nor
judged; rows are independent of one another, so repeated rows, null ids and extra columns change nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablab.llm.common import ref, temp_name

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Signs one of which ends a sentence or clause; a line without any is no prose.
STOPS = ".!?:;…。！？।"
#: Signs that stand between the entries of a menu.
SEPARATORS = "|»›·•→"
#: Phrases of short navigation lines and of boilerplate lines, in lower case.
NAVIGATION = ("log in", "sign in", "sign up", "read more", "click here", "skip to content", "next page", "previous page",
              "back to top", "share this", "add to cart", "main menu")
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
               "enable javascript", "javascript is disabled", "powered by", "lorem ipsum", "copyright ©")
NAVIGATION_WORDS, BOILERPLATE_WORDS = 10, 40
#: Symbols or doubled exclamation marks per 100 words from which a line fails; words lost per 100 beyond which a
#: document does.
SIGNS_PERCENT, LOST_PERCENT = 20, 40


def one_of(characters: str) -> str:
    """Regular expression of one of the characters."""
    return "[" + "".join("\\" + c if c in "|*$.?[]^-\\" else c for c in characters) + "]"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _line_facts(line: Column) -> Column:
    return F.struct(
        line.alias("line"),
        count_of(line, "[^\\x20\\x09-\\x0D]+").alias("words"),
        count_of(line, one_of(SYMBOLS) + "|!!").alias("signs"),
        (~F.rlike(line, F.lit(one_of(STOPS)))).alias("no_stop"),
        count_of(line, one_of(SEPARATORS)).alias("separators"),
    )


def _line_verdict(x: Column) -> Column:
    words = x["words"]
    phrase = lambda phrases: F.rlike(x["line"], F.lit("(?i)" + "|".join(phrases)))  # noqa: E731  looked for in short lines only
    punctuation = x["no_stop"] | (x["signs"] * 100 >= words * SIGNS_PERCENT)
    navigation = ((x["separators"] >= 3) & (x["separators"] * 4 >= words)) | ((words <= NAVIGATION_WORDS) & phrase(NAVIGATION))
    boilerplate = (words <= BOILERPLATE_WORDS) & phrase(BOILERPLATE)
    return F.struct(x["line"].alias("line"), words.alias("words"), (punctuation | navigation | boilerplate).alias("fails"))


def _repeat_words(df: DataFrame, words: str, out: str, make) -> DataFrame:
    """Add ``out``: words inside windows of ``WINDOW`` words that occur at least twice in the row."""
    hashes, plain, windows, at = make("hashes"), make("plain"), make("windows"), make("at")
    df = df.withColumn(hashes, F.transform(ref(words), lambda w: F.xxhash64(w)))
    n = F.size(ref(hashes))
    starts = F.slice(ref(hashes), F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0)))
    df = df.withColumn(plain, F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(ref(hashes), i + k) for k in range(1, WINDOW)])))
    # places are needed only where some window occurs twice
    placed = F.transform(ref(plain), lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    df = df.withColumn(windows, F.when(F.size(F.array_distinct(ref(plain))) < F.size(ref(plain)), F.sort_array(placed)).otherwise(none))
    # equal windows stand side by side now
    twin = lambda x, i: (F.get(ref(windows), i + 1)["h"].eqNullSafe(x["h"])) | (F.get(ref(windows), F.when(i > 0, i - 1).otherwise(F.size(ref(windows))))["h"].eqNullSafe(x["h"]))
    df = df.withColumn(at, F.sort_array(F.transform(F.filter(ref(windows), twin), lambda x: x["at"])))
    total = F.aggregate(
        ref(at),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return df.withColumn(out, total).drop(hashes, plain, windows, at)


def judge(docs: DataFrame, text_col: str = "text", lost_percent: int = LOST_PERCENT) -> DataFrame:
    """``docs`` plus the struct column ``rules`` (renamed if taken): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines, n_lines_removed, n_words_removed, clean_text (the lines left) and kept."""
    made: list[str] = []

    def make(stem: str) -> str:
        made.append(temp_name(df, stem))
        return made[-1]

    df = docs
    text, words, lines, facts, judged, repeat = (make(s) for s in ("text", "words", "lines", "facts", "judged", "repeat"))
    df = df.withColumn(text, F.coalesce(ref(text_col), F.lit("")))
    df = df.withColumn(words, F.filter(F.split(ref(text), SPACES), lambda w: w != ""))
    df = df.withColumn(lines, F.filter(F.split(ref(text), "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))))
    df = _repeat_words(df, words, repeat, make)
    df = df.withColumn(facts, F.transform(ref(lines), _line_facts))
    df = df.withColumn(judged, F.transform(ref(facts), _line_verdict))
    n_words = F.size(ref(words)).cast("long")
    failing = F.filter(ref(judged), lambda x: x["fails"])
    lost = F.aggregate(failing, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    base_failed = (n_words < 10) | (ref(repeat) * 100 > n_words * 20)
    kept_lines = F.transform(F.filter(ref(judged), lambda x: ~x["fails"]), lambda x: x["line"])
    rules = F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join(ref(words), "")).cast("long").alias("word_chars"),
        count_of(ref(text), one_of(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(ref(lines)) - F.size(F.array_distinct(ref(lines)))).cast("long").alias("n_dup_lines"),
        ref(repeat).alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        F.size(ref(lines)).cast("long").alias("n_lines"),
        F.size(failing).cast("long").alias("n_lines_removed"),
        lost.alias("n_words_removed"),
        F.array_join(kept_lines, "\n").alias("clean_text"),
        (~base_failed & (lost * 100 <= n_words * lost_percent)).alias("kept"),
    )
    out = "rules" if "rules" not in {c.lower() for c in docs.columns} else temp_name(docs, "rules")
    return df.withColumn(out, rules).select(*[ref(c) for c in docs.columns], ref(out))
