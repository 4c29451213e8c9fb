"""One query per operator, over whole tables, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm.cotraining import quality_scores
from dayspan.llm.decontamination import contamination
from dayspan.llm.language_id import language_scores
from dayspan.llm.licences import COPYRIGHT_LINE, KNOWN, SPELLINGS, TITLE_LINE, scan_licences
from dayspan.llm.line_chunks import remove_repeated_chunks
from dayspan.llm.line_frequency import judge_by_lines
from dayspan.llm.mixing import mix_sources
from dayspan.llm.packing import pack_documents
from dayspan.llm.partenum import jaccard_components
from dayspan.llm.pii import find_personal_data, labelled_table
from dayspan.llm.resampling import resample
from dayspan.llm.sharding import histogram_shards
from dayspan.llm.vector_codes import compress_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, capacity=1024)


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op6_winnowing_decontamination", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
       FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
       FROM d, (SELECT DISTINCT n FROM iw) AS x, unnest(range(1, len(w) - n + 2)) AS u(s)),
h AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + n)) AS u(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)


@query("op5_line_chunk_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_chunks(docs).withColumn("n_lines", F.size(F.split("text", "\n")))


@query("op3_compression_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = language_scores(docs.withColumn("_held_out", held_out), docs.where(~held_out))
    return scored.select("doc_id", F.col("_held_out").alias("held_out"), "lang_pred", "score", "rejected")


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=5, percent=80)


@query("op4_histogram_sort_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"), shards=40)


SPACE_SQL = r"[\x20\x09-\x0D]+"
SPLIT_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op1_line_frequency_rules", rf"""
WITH d AS (SELECT doc_id, source, text, {SPLIT_SQL} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM r, unnest(range(i, i + 3)) AS u(p) GROUP BY doc_id),
raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, source, line, lower(trim(regexp_replace(line, '{SPACE_SQL}', ' ', 'g'))) AS norm FROM raw
      WHERE regexp_matches(line, '[^ 	-
]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
often AS (SELECT source, norm FROM l GROUP BY source, norm HAVING count(DISTINCT doc_id) > 20),
gone AS (SELECT doc_id, count(*) AS n_lines, sum(len(norm) - len(replace(norm, ' ', '')) + 1) AS n_words
         FROM l JOIN often USING (source, norm) GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(len(regexp_replace(coalesce(text, ''), '{SPACE_SQL}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed,
             coalesce(gone.n_lines, 0) AS n_lines_removed, CAST(len(w) - coalesce(gone.n_words, 0) AS BIGINT) AS n_words_left
      FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT *, NOT base_failed AND n_words_left > 0 AND 100 * n_words_left >= 50 * n_words AS kept FROM b
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_by_lines(table(spark, sf_dir, "documents"), host="source", max_docs=20, least_share=50)


def _canonical_sql(text: str) -> str:
    plain = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    plain = f"regexp_replace({plain}, '{TITLE_LINE}', '')"
    out = f"' ' || replace(trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '  ') || ' '"
    for one, other in SPELLINGS:
        out = f"replace({out}, ' {one} ', ' {other} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


@query("op10_licence_digests", f"""
WITH known AS (SELECT d, min(licence_id) AS licence_id FROM (
       SELECT licence_id, {_canonical_sql("text")} AS d FROM (VALUES {_values(KNOWN)}) AS v(licence_id, text)) GROUP BY d),
doc AS (SELECT doc_id, text, {_canonical_sql("text")} AS form FROM documents),
line AS (SELECT DISTINCT doc_id, licence_id FROM (
       SELECT doc_id, {_canonical_sql("line")} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc)) AS x JOIN known ON x.form = known.d WHERE form <> ''),
note AS (SELECT doc_id, string_agg(licence_id, ',' ORDER BY licence_id) AS notices FROM line GROUP BY doc_id)
SELECT doc.doc_id, CASE WHEN form <> '' THEN sha256(form) END AS canonical_sha256, licence_id, coalesce(notices, '') AS notices
FROM doc LEFT JOIN known ON form = known.d AND form <> '' LEFT JOIN note ON doc.doc_id = note.doc_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


@query("op7_crf_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"), labelled_table(spark))


@query("op8_cotraining_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_low_discrepancy_mix", rf"""
WITH d AS (SELECT doc_id, source, CAST(len({SPLIT_SQL}) AS BIGINT) AS size FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) - 1 AS copy FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
      FROM d GROUP BY source),
b AS (SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS words, CAST(sum(weight) OVER () AS DOUBLE) AS weights,
             CAST(coalesce(sum(3 * source_size) OVER o, 0) AS DOUBLE) AS caps_before, CAST(coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS weights_before
      FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (words - caps_before) / (weights - weights_before) AS level FROM b),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN level * weight < cap THEN level END) OVER () * weight,
             CAST(cap AS DOUBLE))) AS target FROM l),
g AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal FROM t),
e AS (SELECT c.*, epoch, goal, md5(concat_ws(':', 2024, epoch, coalesce(CAST(doc_id AS VARCHAR), ''), size, copy)) AS key
      FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source, unnest(range(0, 3)) AS u(epoch) WHERE size > 0),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY epoch, key, doc_id NULLS LAST, size, copy) - size AS pos FROM e),
k AS (SELECT source, doc_id, size, copy, sum(greatest(0, least(size, goal - pos))) AS taken FROM p GROUP BY source, doc_id, size, copy)
SELECT c.doc_id, c.source, c.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source LEFT JOIN k ON c.source IS NOT DISTINCT FROM k.source
     AND c.doc_id IS NOT DISTINCT FROM k.doc_id AND c.size = k.size AND c.copy = k.copy
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), block=1024, weights=3, most=3)


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Rounds of assignment and means written out one after another."""

    def assign(book: str) -> str:
        return f"""SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS best FROM (
            SELECT x.vec_id, x.p, e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
            FROM x JOIN {book} AS b ON x.p = b.p) GROUP BY vec_id, p"""

    steps = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
             f"""x AS (SELECT vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM v, unnest(range({parts})) AS u(p))""",
             f"""b0 AS (SELECT p, e, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries})
        USING (vec_id))"""]
    for r in range(rounds):
        steps += [f"a{r} AS ({assign(f'b{r}')})",
                  f"""m{r} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (
            SELECT x.p, best.e AS e, i, CAST(floor(sum(x.v[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
            FROM x JOIN a{r} USING (vec_id, p), unnest(range(1, len(x.v) + 1)) AS u(i) GROUP BY x.p, best.e, i) GROUP BY p, e)""",
                  f"b{r + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} AS b LEFT JOIN m{r} AS m ON b.p = m.p AND b.e = m.e)"]
    return "WITH " + ",\n".join(steps) + f""",
last AS ({assign(f'b{rounds}')}),
code AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM code JOIN v USING (vec_id)
"""


@query("op12_walsh_hadamard_codes", _codes_sql(parts=16, entries=64, rounds=2))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", parts=16, entries=64, rounds=2)


@query("op13_importance_resampling", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), i AS (SELECT {WORDS_SQL} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x FROM d), iw AS (SELECT unnest(w) AS x FROM i),
tab AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)),
        lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(k))),
bytes AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM iw)),
word AS (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda j: CAST('0x' || h[2 * j + 1:2 * j + 2] AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN word USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM iw JOIN word USING (x) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + 10000))::DOUBLE
        / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM iw) + 10000))::DOUBLE)) AS BIGINT) AS gain
      FROM range(10000) AS b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight
      FROM dw JOIN word USING (x) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT z.*, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), runs=(1, 1), buckets=10_000, percent=10, least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
