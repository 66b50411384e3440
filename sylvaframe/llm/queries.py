"""The queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, filter_audit, fingerprint, license_scan, packing, periodic, quality, search, simhash, token_counts, toxicity, warc
from .common import documents, work_dir
from .labelled import fold


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.load_ranks(_vocabulary("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir), ranks), ranks)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("ids_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(documents(spark, sf_dir))).withColumn("score", F.round("score", 6))


def _classified(scored: DataFrame, parts: int, held: int, least: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, _labels(spark, sf_dir), fold("doc_id", 5) != 0)
    return _classified(toxicity.score(docs, model), 5, 0, 0.5)


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = search.top_k(docs, docs.where("doc_id % 100 = 0"), 10)
    return found.withColumn("score", F.round("score", 6))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.edited_pairs(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("own")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("own"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
        fingerprint.containment(F.col("own"), F.col("edited_sketch")).alias("own_in_edited"),
        fingerprint.containment(F.col("edited_sketch"), F.col("own")).alias("edited_in_own"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), token_counts.load_vocabulary(_vocabulary("piece_bpe_32k.model")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, _labels(spark, sf_dir), fold("doc_id", 4) != 2)
    return _classified(quality.score(docs, model), 4, 2, 0.7)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    read = warc.facts(warc.read_records(spark, path).select("page_id", "record"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", F.nullif("refers_to", F.lit("")).cast("bigint").alias("refers_to"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("byte_bpe_50k.json")
    rows = chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.read_back(chat.format_conversations(rows, path), path).drop("n_tokens")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), _labels(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_planted_runs(documents(spark, sf_dir)))
    best = found.withColumn("best", periodic.longest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_license_scan, op3_toxicity, op4_search, op5_fingerprints, op6_packing, op7_token_counts, op8_quality, op9_simhash, op10_warc, op11_chat, op12_filter_audit, op13_periodic_runs)}

#: Runs of digits, letters and all beyond ASCII in the text with A-Z lower-cased.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _license_sql() -> str:
    """Every word of every text against every word of every template; a place counts if all mandatory words stand there."""
    rows = []
    for t, template in enumerate(license_scan.BASE + license_scan.NOTICES):
        inside = {i for a, b in license_scan._spans(template) for i in range(a, b)}
        rows += [f"({t}, '{template.label}', {template.base}, {i}, '{w}', {i in inside}, {min(inside)})" for i, w in enumerate(template.text.split())]
    labels = "array_to_string(list_sort(list(DISTINCT label){}), ',')"
    return f"""
WITH tpl(t, label, base, pos, word, must, first) AS (VALUES {", ".join(rows)}),
lists AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM lists),
idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)) + 1e-3 AS v FROM (SELECT DISTINCT word FROM tpl) LEFT JOIN w USING (word) GROUP BY 1),
whole AS (SELECT t, sum(v) AS total, count(*) FILTER (must) AS needed FROM tpl JOIN idf USING (word) GROUP BY 1),
m AS (SELECT doc_id, t, label, base, i - pos + first AS start, sum(v) / any_value(total) AS score FROM w JOIN tpl USING (word) JOIN idf USING (word) JOIN whole USING (t) GROUP BY doc_id, t, label, base, i - pos, first HAVING count(*) FILTER (must) = any_value(needed)),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, {labels.format(" FILTER (base)")} AS base_labels, {labels.format("")} AS labels, max(score) AS score FROM m GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score FROM lists LEFT JOIN a USING (doc_id)"""


_SEARCH_SQL = f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
l AS (SELECT d.doc_id, count(term) AS n FROM documents d LEFT JOIN w USING (doc_id) GROUP BY 1),
g AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.tf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * d.tf * {search.K1 + 1} / (d.tf + {search.K1} * ({1 - search.B} + {search.B} * l.n / mean))) AS score
 FROM tf q JOIN df USING (term) JOIN tf d ON d.term = q.term JOIN l ON l.doc_id = d.doc_id CROSS JOIN g WHERE q.doc_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""

_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f"""

#: A conversation's control strings in a text get one more backslash; the rest are sums over its turns.
_CHAT_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)(turn>|text>|/turn>)', '<\\\1\2', 'g')) + length(regexp_replace(text, '<(\\*)(turn>|text>|/turn>)', '<\\\1\2', 'g')) + length('<turn><text></turn>') + 1 AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(n)::BIGINT AS formatted_chars FROM e GROUP BY 1"""

#: Every order step by step over the documents of each mask: a document goes at the first filter of the order that it fails.
_AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY 1),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, good, toxic, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END) || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
 || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails FROM d JOIN least USING (t) LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS c, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, c, sum(n) FILTER (translate(fails, before || c, '') = fails) AS kept, sum(n) FILTER (contains(fails, c) AND translate(fails, before, '') = fails) AS removed,
 sum(n) FILTER (contains(fails, c) AND translate(fails, before, '') <> fails) AS redundant, sum(n) FILTER (fails = c) AS unique_fails,
 sum(good) FILTER (contains(fails, c) AND translate(fails, before, '') = fails) AS good_lost, sum(toxic) FILTER (contains(fails, c) AND translate(fails, before, '') = fails) AS toxic_lost FROM m, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
 coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r"""

#: The CRC-32 of a string of ASCII, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(range(0, 8 * length({0})), lambda c, k: (CASE WHEN (xor(c, {1}) & 1) = 1 THEN xor(xor(c, {1}) >> 1, 3988292384) ELSE xor(c, {1}) >> 1 END), 4294967295))"""

#: All pairs of equal words at most a quarter of the text apart; neighbours of one distance form stretches.
_RUNS_SQL = f"""
WITH t AS (SELECT doc_id, doc_id::VARCHAR AS s, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, {_CRC_SQL.format("s", "(CASE WHEN k % 8 = 0 THEN ascii(substr(s, k // 8 + 1, 1)) ELSE 0 END)")} AS h FROM t),
a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
e AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + (CASE WHEN i < a THEN i ELSE a + (i - a) % p END)]) ELSE w END AS w FROM p),
x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM e),
q AS (SELECT b.doc_id, c.i - b.i AS q, b.i FROM x b JOIN x c ON b.doc_id = c.doc_id AND b.word = c.word AND c.i > b.i AND 4 * (c.i - b.i) <= b.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM q),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY 1, 2, 3),
f AS (SELECT doc_id, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, max(length) AS length, first(period ORDER BY length DESC, start, period) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)"""

#: The other queries rest on a tokenizer's file, a trained model or XXH64, which SQL has not; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_license_scan": _license_sql(), "op4_search": _SEARCH_SQL, "op10_warc": _WARC_SQL, "op11_chat": _CHAT_SQL, "op12_filter_audit": _AUDIT_SQL, "op13_periodic_runs": _RUNS_SQL}
