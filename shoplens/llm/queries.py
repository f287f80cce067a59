"""The registered queries of the subpackage and their SQL twins (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import n_words, table
from shoplens.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"
#: id that ends a document
END_ID = 2


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.token_files import document_digests, write_packed

    path = f"{work_dir(spark, 'token_files')}/segments"
    write_packed(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), "space", END_ID)
    return document_digests(spark, path)


@_query
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.rules import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE["op4_host_rules"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
base AS (SELECT doc_id, source, len(w) AS n_words,
                length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM line WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
gram AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id),
stat AS (SELECT base.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words
         FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
rule AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols * 10 > n_words
                OR n_dup_lines * 10 > n_lines * 3 AS failed FROM stat),
host AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM rule GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM host),
verdict AS (SELECT source, CASE WHEN v = 0 THEN m
                                ELSE (f + m * greatest(0, m * (1 - m) / v - 1)) / (n + greatest(0, m * (1 - m) / v - 1)) END
                           <= 0.5 AS ok FROM host, prior)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ok AS kept
FROM rule JOIN verdict ON rule.source IS NOT DISTINCT FROM verdict.source
"""


@_query
def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    passes = mix(docs, F.col("size"))
    return (passes.groupBy("source", "mix_bucket", "mix_row", "doc_id", "mix_size", "mix_source_size", "mix_target")
            .agg(F.sum("mix_taken").alias("taken"))
            .select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                    F.col("mix_target").alias("target"), "taken"))


ORACLE["op5_fair_mix"] = f"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
                 - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
v AS (SELECT max(level) FILTER (weight * level <= 3 * source_size) AS lv FROM l),
t AS (SELECT source, source_size,
             CAST(least(coalesce(weight * lv, 3 * source_size), 3 * source_size) AS DOUBLE) AS target FROM l, v),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
                                    ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - ahead))
            + greatest(0, least(size, floor(target) - source_size - ahead))
            + greatest(0, least(size, floor(target) - 2 * source_size - ahead)) AS BIGINT) AS taken
FROM q
"""


@_query
def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "byte", END_ID, 1024)


@_query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.common import shuffle_partitions
    from shoplens.llm.fingerprints import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"), shuffle_partitions(spark))


@_query
def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.line_runs import drop_repeated_runs

    return drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("run_lines").alias("n_lines"), F.col("run_removed").alias("n_removed"), "text")


ORACLE["op3_line_runs"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, count(*) OVER (PARTITION BY doc_id) AS n,
             lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS line2,
             lead(line, 2) OVER (PARTITION BY doc_id ORDER BY i) AS line3,
             lead(i, 2) OVER (PARTITION BY doc_id ORDER BY i) AS third,
             max(i) OVER (PARTITION BY doc_id) AS last
      FROM l WHERE regexp_matches(line, '{WORD}')),
w AS (SELECT doc_id, i AS a, coalesce(third, last) AS b, concat_ws(chr(10), line, line2, line3) AS run
      FROM k WHERE r <= greatest(1, n - 2)),
later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS rn FROM w) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later),
left_ AS (SELECT l.doc_id, l.line, l.i, gone.i IS NOT NULL AS removed
          FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i),
agg AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '') AS text FROM left_ GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, agg.text
FROM documents d LEFT JOIN agg USING (doc_id)
"""


#: words of repeated whole clauses from which a run counts: a passage of over 50 words
#: keeps at most its two cut-off end clauses
RUN_WORDS = 40


@_query
def op7_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.units import drop_repeated_runs_of_units

    left = drop_repeated_runs_of_units(table(spark, sf_dir, "documents").select("doc_id", "text"), "clause", RUN_WORDS)
    spans = F.transform(F.arrays_zip("unit_starts", "unit_stops"), lambda x: F.concat_ws("-", x["unit_starts"], x["unit_stops"]))
    return left.select("doc_id", F.coalesce(F.size("unit_starts"), F.lit(0)).cast("long").alias("n_removed"),
                       F.coalesce(F.array_join(spans, " "), F.lit("")).alias("removed"), "text")


#: a clause as one pattern: up to a line end, or up to marks and the spaces behind them
CLAUSE = r"(?:[^\n.!?,;:]|[.!?,;:]+[^\n \t.!?,;:])*(?:[.!?,;:]+(?:[ \t]+|\n|$)|\n|$)"

ORACLE["op7_repeated_units"] = rf"""
WITH x AS (SELECT doc_id, regexp_extract_all(text, '{CLAUSE}') AS u FROM documents),
l AS (SELECT * FROM (SELECT doc_id, unnest(u) AS unit, unnest(range(len(u))) AS i FROM x) WHERE unit <> ''),
p AS (SELECT *, CAST(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop,
             trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS norm FROM l),
w AS (SELECT *, len(string_split(norm, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
             lead(norm) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM p WHERE norm <> ''),
r AS (SELECT *, next IS NOT NULL AND row_number() OVER (PARTITION BY norm, next ORDER BY doc_id, i) > 1 AS pair,
             words >= {RUN_WORDS} AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) > 1 AS alone FROM w),
f AS (SELECT *, pair OR alone OR coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY k), false) AS later FROM r),
g AS (SELECT *, sum((NOT later)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM f),
h AS (SELECT doc_id, i, later AND sum(CASE WHEN later THEN words END) OVER (PARTITION BY doc_id, run) >= {RUN_WORDS} AS removed FROM g),
m AS (SELECT p.*, coalesce(removed, false) AS removed FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND p.i = h.i),
a AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed,
             coalesce(string_agg((stop - length(unit)) || '-' || stop, ' ' ORDER BY i) FILTER (removed), '') AS removed,
             coalesce(string_agg(unit, '' ORDER BY i) FILTER (NOT removed), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, coalesce(a.text, d.text) AS text
FROM documents d LEFT JOIN a USING (doc_id)
"""


#: score from which a document counts as good
GOOD = 0.3


@_query
def op9_passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.classifier import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= GOOD).cast("int").alias("predicted"))


@_query
def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 85, 100).select(
        "doc_id", "n_shingles", "component_id", "kept")


@_query
def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.context_mixing import score

    return score(table(spark, sf_dir, "documents"))


@_query
def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.alignment import alignment

    return alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                     tokenizer_path("piece_bpe_32k.model"))


@_query
def op13_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.warc import read_records, write_bundles

    path = f"{work_dir(spark, 'warc')}/bundles"
    write_bundles(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op13_seekable_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k,
             first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN k > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND payload_bytes >= 100 THEN least END AS refers_to
FROM f
"""


@_query
def op11_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoplens.llm.lexical import build_index, search

    docs = table(spark, sf_dir, "documents")
    return search(docs, build_index(docs), table(spark, sf_dir, "benchmark"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op11_bit_sliced_search"] = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // len) AS m FROM n, c),
q AS (SELECT item_id, term, count(*) AS k
      FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{TERM}')) AS term FROM benchmark)
      GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf, c WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
