"""Registered queries of this folder: each applies one operator to its whole table, with production parameters.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLE`` holds DuckDB SQL where SQL can express the
result, the others are held against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of 3-word shingles and component over links of at most 2 bits, for all documents."""
    from tablab.llm.simhash import simhash_components

    rows = simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2, seed=42)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def vocabulary(name: str = "byte_bpe_50k.json") -> bytes:
    """Content of a public tokenizer file, read on the driver; executors get it by broadcast."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@register("op2_bpe_encode_decode")
def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all whole documents with the streaming transducer."""
    from tablab.llm.bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), vocabulary())


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by scanning flat token files of the whole corpus for separators (id 50256)."""
    from tablab.llm.token_counts import documents_token_counts

    return documents_token_counts(table(spark, sf_dir, "documents"), vocabulary(), eod=50256)


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens, each closed by id 2."""
    from tablab.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=1024, separator=2)


@register("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of all documents once every repeated 35-word window is gone, as a digest."""
    from tablab.llm.substrings import repeated_spans, text_key, words_of

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = repeated_spans(docs, window=35).select("key", F.col("n_words").alias("words"), "n_removed", F.sha2("kept", 256).alias("kept_sha"))
    words = words_of(F.coalesce("text", F.lit("")))
    own = docs.select("doc_id", text_key(F.col("text")).alias("key"), words.alias("words")).select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"), F.sha2(F.concat_ws(" ", "words"), 256).alias("own_sha")
    )
    return own.join(spans.drop("words"), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha", "own_sha").alias("kept_sha256"),
    )


def _op5_sql() -> str:
    from tablab.llm import quality_rules as R

    count = lambda col, chars: f"(length({col}) - length(regexp_replace({col}, '{R.one_of(chars)}', '', 'g')))"
    any_of = lambda phrases: "(" + " OR ".join(f"contains(lower(l), '{p}')" for p in phrases) + ")"
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM t),
win AS (SELECT r, unnest(range(1, greatest(len(ws) - {R.WINDOW - 2}, 1))) AS i, ws FROM w),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + {R.WINDOW - 1}], ' ')) AS c FROM win),
gap AS (SELECT r, least({R.WINDOW}, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), {R.WINDOW})) AS g FROM dup WHERE c > 1),
rep AS (SELECT r, sum(g) AS n FROM gap GROUP BY r),
ln AS (SELECT r, unnest(ls) AS l FROM w),
facts AS (SELECT r, l, len(regexp_extract_all(l, '{word}')) AS n,
                 {count('l', R.SYMBOLS)} + (length(l) - length(replace(l, '!!', ''))) / 2 AS signs,
                 {count('l', R.STOPS)} AS stops, {count('l', R.SEPARATORS)} AS seps,
                 {any_of(R.NAVIGATION)} AS nav, {any_of(R.BOILERPLATE)} AS boiler FROM ln),
lost AS (SELECT r, sum(n) AS n FROM facts
         WHERE stops = 0 OR signs * 100 >= n * {R.SIGNS_PERCENT} OR (seps >= 3 AND seps * 4 >= n)
            OR (nav AND n <= {R.NAVIGATION_WORDS}) OR (boiler AND n <= {R.BOILERPLATE_WORDS}) GROUP BY r),
base AS (SELECT r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                {count('text', R.SYMBOLS)}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0) AS lost
         FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost * 100 <= n_words * {R.LOST_PERCENT} AS kept
FROM base"""


@register("op5_quality_rules", _op5_sql())
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and line-first verdict of all whole documents."""
    from tablab.llm.quality_rules import judge

    r = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@register(
    "op1_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS keeper FROM p),
bits AS (SELECT *, list_aggregate(list_transform(range(1, 40, 2), lambda i:
           lpad(bin(('0x' || substr(hex, i::INT, 2))::INT), 8, '0')), 'string_agg', '') AS b FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j:
           substr(b, (5 * k + j + 1)::INT, 1)::INT * (1 << (4 - j)::INT)))::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM bits""",
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, then every record read back by the index."""
    from tablab.llm.warc import archive_and_read

    records = archive_and_read(table(spark, sf_dir, "pages"), min_payload=0)
    return records.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@register(
    "op3_exact_top_k",
    """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every vector whose id is divisible by 50, among all others."""
    from tablab.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all whole documents, learnt from the training fold's positives and unlabelled text."""
    from tablab.llm.quality_classifier import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all whole documents by a convolutional classifier learnt from the training fold."""
    from tablab.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op13_sql() -> str:
    from tablab.llm import secret_scan as S

    def found(kind: int, pattern: str, value: str, least: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
SELECT r, {kind} AS kind, m, {value} AS value, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
FROM (SELECT r, ms, gaps, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT r, regexp_extract_all(text, '{quoted}') AS ms, string_split_regex(text, '{quoted}') AS gaps FROM d WHERE regexp_matches(text, '{quoted}')))
WHERE {least}"""

    quoted = S.ASSIGN.replace("'", "''")
    value = f"regexp_extract(m, '{quoted}', 2)"
    live = f"""(length(value) >= {S.MIN_VALUE} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
      AND NOT regexp_matches(lower(value), '{"|".join(S.PLACEHOLDERS)}') AND len(list_distinct(string_split(value, ''))) >= {S.DISTINCT_CHARACTERS})"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source, lang FROM documents),
f AS ({found(0, S.ASSIGN, value, f"length({value}) >= {S.MIN_VALUE}")}
UNION ALL {found(1, S.ACCESS, "m", "true")} UNION ALL {found(2, S.HEX, "m", "true")} UNION ALL {found(3, S.BARE, "m", "true")}),
c AS (SELECT f.*, (start + length(m))::BIGINT AS stop, {live} AS live FROM f),
v AS (SELECT c.*, source, lang FROM c JOIN d USING (r) WHERE kind < 3 OR live),
own AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(lang, chr(0)))) AS repositories FROM v GROUP BY value),
spans AS (SELECT r, kind, start, stop FROM v WHERE kind < 3
          UNION SELECT r, 3, stop - length(value), stop FROM v JOIN own USING (value) WHERE live AND owners <= 1 AND repositories <= 3),
named AS (SELECT *, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop AS name FROM spans),
g AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, count(*) FILTER (kind = 3) AS l,
             string_agg(name, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind, stop) AS spans
      FROM named GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(l, 0)::BIGINT AS n_live
FROM d LEFT JOIN g USING (r)"""


@register("op13_secret_scan", _op13_sql())
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all whole documents; a source is an owner, its documents of one language a repository."""
    from tablab.llm.secret_scan import scan_secrets, spans_text

    rows = scan_secrets(table(spark, sf_dir, "documents"), F.col("source"), F.col("lang"))
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "live")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    )


@register(
    "op12_importance_resampling",
    """
WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
               CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
      FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
      FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d),
vocab AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM b)),
place AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i::INT, 2))::BIGINT)),
                        lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)])), 4294967295) % 10000 AS bucket FROM vocab, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN place USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN place USING (w) GROUP BY bucket),
tot AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS big_s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS big_t),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (big_s + 10000) / ((s.n::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS g
         FROM s LEFT JOIN t USING (bucket), tot),
wt AS (SELECT r, sum(g)::BIGINT AS weight FROM dw JOIN place USING (w) JOIN gain USING (bucket) GROUP BY r),
sc AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
       FROM d LEFT JOIN wt USING (r)),
rk AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features, r) END AS place FROM sc)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= 10 * (SELECT count(*) FROM sc WHERE n_features >= 20) // 100 THEN place END::BIGINT AS rank
FROM rk""",
)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents with at least 20 words, drawn towards the benchmark's word distribution."""
    from tablab.llm.resampling import resample

    rows = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_words=1, buckets=10000, percent=10, min_words=20, seed=2024)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


@register(
    "op11_phrase_collocations",
    """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
f1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM p) GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM p)) GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM p))
       GROUP BY ALL HAVING count(*) >= 10),
covered AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
two AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r FROM f2
        JOIN f1 x ON x.lang = f2.lang AND x.w = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w = f2.w2
        LEFT JOIN covered ON covered.lang = f2.lang AND covered.w1 = f2.w1 AND covered.w2 = f2.w2
        WHERE f2.f >= 10 AND coalesce(100 * covered.f < 50 * f2.f, true)),
three AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l1, t.f AS r1, h.f AS l2, z.f AS r2,
                 (1000000::HUGEINT * f3.f * f3.f) // (x.f::HUGEINT * t.f) AS s1, (1000000::HUGEINT * f3.f * f3.f) // (h.f::HUGEINT * z.f) AS s2
          FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w = f3.w1 JOIN f1 z ON z.lang = f3.lang AND z.w = f3.w3
          JOIN f2 h ON h.lang = f3.lang AND h.w1 = f3.w1 AND h.w2 = f3.w2 JOIN f2 t ON t.lang = f3.lang AND t.w1 = f3.w2 AND t.w2 = f3.w3),
every AS (SELECT lang, phrase, a, l, r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM two
          UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)::BIGINT FROM three),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN total USING (lang) WHERE rank <= 2000""",
)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of every language, from all whole documents."""
    from tablab.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), min_count=10, max_words=3, top=2000, cover_percent=50)
