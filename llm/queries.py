"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, conversations, fingerprint, licenses, line_dedup, near_dedup, packing, quality, secrets, spelling, suffix_dedup, toxicity, warc
from llm.text import documents, reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_near_dedup", """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[]
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (
  WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
  SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs, secrets.fit_field(docs))
    names = "array(" + ", ".join(f"'{k}'" for k in secrets.KINDS) + ")"
    joined = (lambda only: f"array_join(transform(filter(spans, s -> s.kind < {only}), "  # noqa: E731
              f"s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")
    return found.selectExpr(
        "doc_id", *(f"CAST(size(filter(spans, s -> s.kind = {i})) AS BIGINT) AS n_{k}" for i, k in enumerate(secrets.KINDS[:3])),
        f"sha2({joined(3)}, 256) AS base_sha256", f"{joined(4)} AS spans")


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).drop("text")


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_fingerprint")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprints(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                      "near_edited", "near_next")


@query("op6_licenses")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("blocks")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: CRC-32 of a list of bytes in SQL, one table entry a byte value by the generator's rule
CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""
CRC = "xor(list_reduce(list_concat([4294967295], {0}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _least(*items: str) -> str:
    return f"list_sort(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL))[1]"


def _edit(state: str, cost: str, letter: str, line: str = "''", when: str = "TRUE") -> str:
    added = f"{state}.t || {line}" if line == "''" else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}"
    return (f"CASE WHEN {state} IS NOT NULL AND {when} THEN "
            f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {added}}} END")


def _reads(fault: str = "r.fault", line: str = "r.text") -> str:
    """The four states after one more row, from states 0 to 3 after their inserts."""
    open_ = f"{fault} IN (0, 3)"
    stays = f"CASE WHEN {fault} = 3 THEN 5 ELSE 0 END"

    def into(start: str, name: str) -> list[str]:
        return [_edit(start, stays, "K", f"r.role || ':' || {line}", f"{open_} AND r.role[1] = '{name[0]}'"),
                _edit(start, f"1 + {stays}", "R", f"'{name}:' || {line}", open_)]

    dropped = [_edit(f"s{i}", "2", "D") for i in range(4)]
    system = _edit("s0", stays, "K", f"r.role || ':' || {line}", f"{open_} AND r.role[1] = 's'")
    return ", ".join((f"{dropped[0]} AS s0", f"{_least(dropped[1], system)} AS s1",
                      f"{_least(dropped[2], *into('s0', 'user'), *into('s1', 'user'), *into('s3', 'user'))} AS s2",
                      f"{_least(dropped[3], *into('s2', 'assistant'))} AS s3"))


#: inserts before the next row: one user row from any state, then one assistant row; more cannot be cheapest
_INSERTED = f"""SELECT k, i, s0, s1, s2, {_least("s3", _edit("s2", "5", "I", "'assistant:'"))} AS s3 FROM (
  SELECT k, i, s0, s1, {_least("s2", *(_edit(f"s{i}", "5", "I", "'user:'") for i in (0, 1, 3)))} AS s2, s3 FROM walk)"""
_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
_BARE = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("op12_conversations", f"""
WITH RECURSIVE tab AS ({CRC_TABLE}),
a AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
f AS (SELECT *, {CRC.format("list_transform(string_split(id, ''), lambda x: ord(x))")} % 20 AS damage FROM a, tab),
d AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
  CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE damage <> 0),
g AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS k, row_number() OVER (PARTITION BY conv_id
  ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i FROM d),
r AS (SELECT *, CASE WHEN {_BARE} = '' THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2
  WHEN right({_BARE}, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
  CASE WHEN i > 1 THEN lag(role[1]) OVER (PARTITION BY k ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') END AS bad FROM g),
walk AS (
  SELECT DISTINCT k, CAST(1 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM r
  UNION ALL
  SELECT r.k, r.i + 1 AS i, {_reads()} FROM ({_INSERTED}) AS w JOIN r ON r.k = w.k AND r.i = w.i),
e AS (SELECT k, {_least("s0", "s3")} AS best FROM ({_INSERTED}) AS w
  WHERE i = (SELECT max(i) + 1 FROM r WHERE r.k = w.k)),
n AS (SELECT k, conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
  count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE bad) AS illegal
  FROM r GROUP BY k, conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN n ON o.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN e ON e.k = n.k""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair(rows, conversations.damaged(rows))


@query("op13_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    folder = warc.archive_folder(spark)
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_spelling", f"""
WITH RECURSIVE tab AS ({CRC_TABLE}),
u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM u
  WHERE length(run) >= 5 GROUP BY ALL),
x AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM r),
h AS (SELECT run, n, {CRC.format("list_transform(range(1, length(b), 2), lambda i: CAST('0x' || substr(b, i, 2) AS BIGINT))")} AS h FROM x, tab),
d AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
e AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
c AS (SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS less FROM e),
g AS (SELECT word, left(word, i - 1) || '*' || substr(word, i + 1) AS gap FROM e),
p AS (SELECT c.word AS a, v.word AS b FROM c JOIN v ON v.word = c.less UNION SELECT v.word, c.word FROM c JOIN v ON v.word = c.less
  UNION SELECT x.word, y.word FROM g AS x JOIN g AS y ON x.gap = y.gap AND x.word <> y.word),
s AS (SELECT a, count(*) AS n_near, list_sort(list({{'m': -v.n, 'w': b}}))[1] AS best FROM p JOIN v ON v.word = b GROUP BY a),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form,
  CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM v LEFT JOIN s ON s.a = v.word),
w AS (SELECT word, word AS root, form AS further FROM f UNION ALL
  SELECT w.word, f.word AS root, f.form FROM w JOIN f ON f.word = w.further)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN w ON w.word = f.word AND w.further IS NULL""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.corpus_words(documents(spark, sf_dir)))
