"""The queries of this part, each with its SQL where SQL can say it."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsift.llm import dialogue, html_text, licenses, merkle, mixing, ngram_join, packing, pii, quality, token_files, topk, toxicity, warc

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), tri AS (
  SELECT rid, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS p FROM w WHERE len(w) > 2)
), rep AS (
  SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    (length(t) - length(regexp_replace(t, '\p{L}', '', 'g')))::BIGINT AS n_letters,
    (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_upper
  FROM w LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, (RULES)::BIGINT AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
""".replace("RULES", " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES))


@query("op7_quality_ledger", QUALITY_SQL)
def quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger of every document and the verdict of the newest training policy."""
    rows = quality.apply_policy(quality.ledger(table(spark, folder, "documents").select("doc_id", "text")))
    return rows.select(
        "doc_id",
        *quality.MEASURES,
        (F.col("failures").bitwiseAND(F.lit(3)) != 0).alias("base_failed"),
        "kept",
        "failures",
    )


MIXING_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS z, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w
  FROM d GROUP BY source
), water AS (
  SELECT 0 AS step, []::VARCHAR[] AS stopped, false AS null_stopped, (SELECT sum(z) FROM s)::BIGINT AS num, (SELECT sum(w) FROM s)::BIGINT AS den, true AS more
  UNION ALL
  SELECT step + 1, n.names, n.null_in, n.num, n.den, n.k > len(stopped) + null_stopped::INT FROM (
    SELECT step, stopped, null_stopped, num AS num0, den AS den0, (
      SELECT {'names': coalesce(list(source) FILTER (source IS NOT NULL AND over), []), 'null_in': coalesce(bool_or(over AND source IS NULL), false),
        'num': ((SELECT sum(z) FROM s) - coalesce(sum(3 * z) FILTER (over), 0))::BIGINT, 'den': sum(w) FILTER (NOT over)::BIGINT, 'k': count(*) FILTER (over)}
      FROM (SELECT *, 3 * z * water.den < water.num * w AS over FROM s)) AS n FROM water WHERE more AND step < 1000)
), last AS (SELECT num, den FROM water ORDER BY step DESC LIMIT 1
), t AS (
  SELECT source, z, CASE WHEN 3 * z * den < num * w THEN (3 * z)::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target,
    CASE WHEN 3 * z * den < num * w THEN 3 * z ELSE (w * num) // den END AS whole FROM s, last
), b AS (
  SELECT *, CASE WHEN z > 0 THEN whole // z ELSE 0 END AS repeats FROM t
), one AS (
  SELECT d.*, z, target, repeats, whole - repeats * z AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS run
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), gap AS (
  SELECT *, run <= budget AS first, budget - coalesce(max(run) FILTER (run <= budget) OVER (PARTITION BY source), 0) AS rest FROM one
), two AS (
  SELECT *, sum(CASE WHEN NOT first AND size <= rest THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS run2 FROM gap
)
SELECT doc_id, size, z AS source_size, target, (size * (repeats + (first OR size <= rest AND run2 <= rest)::INT))::BIGINT AS taken FROM two
"""


@query("op6_mix_sources", MIXING_SQL)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents by the weights 5, 2, 1 of their sources."""
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"))


@query("op3_token_files")
def write_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in token files, and what the files give back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.read(token_files.write(table(spark, folder, "documents"), path))


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), s AS (
  SELECT page_id, first, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM s
"""


@query("op8_warc_index", WARC_SQL)
def warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """All pages in archives, looked up by the keys of their URLs and read back by ranges."""
    pages = table(spark, folder, "pages")
    _, directory = warc.archive(pages)
    found = warc.fetch(warc.lookup(warc.keys_of(pages), directory), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 90 * (x.n + y.n - o)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c ON c.doc_id = d.doc_id
"""


@query("op5_ngram_jaccard", JACCARD_SQL)
def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents whose sets of three-word shingles link at 0.9."""
    return ngram_join.join(table(spark, folder, "documents").select("doc_id", "text"))


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 10
"""


@query("op10_top_k", TOP_SQL)
def top_ten(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best partners, among all vectors, of every vector whose id 100 divides."""
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


LICENSE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT rid, unnest(w) AS x, unnest(range(0, len(w))) AS pos, w FROM d
), f(parts, label) AS (VALUES PHRASES
), hit AS (
  SELECT rid, pos, label FROM p JOIN f ON x = parts[1] AND w[pos + 1 : pos + len(parts)] = parts
), base AS (
  SELECT rid, count(*) AS n, min(pos) AS a, max(pos) AS z, list(DISTINCT label) AS labels FROM hit GROUP BY rid
), t(k, label, size, need, tokens) AS (VALUES TEMPLATES
), token AS (SELECT k, label, size, need, unnest(tokens) AS x FROM t
), shared AS (
  SELECT rid, b, k, label, size, need, count(DISTINCT x) AS n FROM (
    SELECT rid, unnest([pos // 32, pos // 32 - 1]) AS b, x FROM p) JOIN token USING (x) WHERE b >= 0 GROUP BY ALL
), found AS (
  SELECT rid, list(DISTINCT label) AS labels, max(n::DOUBLE / size::DOUBLE) AS best FROM shared WHERE n >= need GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)
"""


def _listed(tokens) -> str:
    return "[" + ", ".join(f"'{x}'" for x in tokens) + "]"


LICENSE_SQL = LICENSE_SQL.replace("PHRASES", ", ".join(f"({_listed(licenses.words(p))}, '{label}')" for p, label in licenses.PHRASES.items())).replace(
    "TEMPLATES",
    ", ".join(
        f"({k}, '{label}', {len(s)}, {-((-licenses.THRESHOLD * len(s)) // 1)}, {_listed(sorted(s))})"
        for k, (label, s) in enumerate(licenses.template_sets(licenses.TEMPLATES))
    ),
)


@query("op4_license_scan", LICENSE_SQL)
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and blocks that hold 0.8 of a template's tokens, in all documents."""
    return licenses.scan(table(spark, folder, "documents"))


@query("op1_pack_sequences")
def pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, cut and packed into sequences of 1024 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.pieces(table(spark, folder, "documents"), path))


@query("op9_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents: base spans, and those that boosted trees add."""
    return pii.find(table(spark, folder, "documents"))


@query("op2_toxicity")
def score_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that may be learned."""
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


#: CRC-32 of an ASCII text ``{}``, by a table of 256 entries built from the polynomial.
CRC_TABLE = """crc_step(k, c, b) AS (
  SELECT 0, b::BIGINT, b::BIGINT FROM range(0, 256) r(b)
  UNION ALL
  SELECT k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b FROM crc_step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_step WHERE k = 8)"""
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda z: ascii(z)::BIGINT)),
  lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295::BIGINT)"""

MERKLE_SQL = """
WITH RECURSIVE CRC_TABLE, d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, text, PREFIX AS prefix,
    coalesce(CRC % 3 = 0, false) AS chosen FROM documents, crc_table
), leaf AS (
  SELECT doc_id, g, sha256(prefix || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(prefix || CASE WHEN chosen THEN coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')
      ELSE coalesce(strlen(text) || ':' || text, '-') END) AS now FROM d
), tree(g, k, nodes) AS (
  SELECT g, 0, list(leaf ORDER BY doc_id NULLS FIRST) FROM leaf GROUP BY g
  UNION ALL
  SELECT g, k + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], ''))) FROM tree WHERE len(nodes) > 1
), sub AS (SELECT g, nodes[1] AS subroot, k AS height FROM tree WHERE len(nodes) = 1
), top(k, nodes) AS (
  SELECT 0, list(subroot ORDER BY g) FROM sub
  UNION ALL
  SELECT k + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], ''))) FROM top WHERE len(nodes) > 1
), spot AS (
  SELECT leaf.*, subroot, height, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS i,
    dense_rank() OVER (ORDER BY g) - 1 AS j FROM leaf JOIN sub USING (g)
), step AS (
  SELECT doc_id, spot.g, i, k, (i // (8 ** k)::BIGINT)::BIGINT AS p, nodes FROM spot JOIN tree ON tree.g = spot.g AND k < height
  UNION ALL
  SELECT doc_id, g, i, height + k, (j // (8 ** k)::BIGINT)::BIGINT, nodes FROM spot, top WHERE len(nodes) > 1
), side AS (
  SELECT g, i, k, array_to_string(nodes[p // 8 * 8 + 1 : p], '') AS l, array_to_string(nodes[p + 2 : p // 8 * 8 + 8], '') AS r FROM step
), path AS (
  SELECT g, i, list({'l': l, 'r': r} ORDER BY k) AS path FROM side GROUP BY g, i
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.l || s.r), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM (
  SELECT *, list_reduce(list_prepend({'l': '', 'r': now}, coalesce(path, [])), lambda h, s: {'l': '', 'r': sha256(s.l || h.r || s.r)}).r AS folded_root
  FROM spot LEFT JOIN path USING (g, i), (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1))
""".replace("CRC_TABLE", CRC_TABLE).replace("CRC %", CRC.format("doc_id::VARCHAR") + " %").replace(
    "PREFIX", " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in merkle.FIELDS[:-1])
)


@query("op13_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Roots, proofs and their verification for all documents."""
    return merkle.manifest(table(spark, folder, "documents"))


#: Backward over the rows: cost, edits and lines from each state (a start, b after s, u, w after a);
#: the least struct is the cheapest and then the ASCII-least.
DIALOGUE_SQL = r"""
WITH RECURSIVE CRC_TABLE, c AS (
  SELECT conv_id, coalesce('1' || conv_id, '0') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    CRC % 20 AS what FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations), crc_table
), dam AS (
  SELECT g, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN what = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE what <> 0
), num AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY g ORDER BY turn DESC NULLS LAST, role DESC, text DESC, copy DESC) AS k FROM dam
), r AS (
  SELECT *, left(role, 1) AS ini, left(lag(role) OVER (PARTITION BY g ORDER BY i), 1) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM num
), dp(g, k, a, b, u, w) AS (
  SELECT DISTINCT g, 0::BIGINT, {'c': 0::BIGINT, 'e': '', 't': ''}, {'c': 10::BIGINT, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'},
    {'c': 5::BIGINT, 'e': 'I', 't': chr(10) || 'assistant:'}, {'c': 0::BIGINT, 'e': '', 't': ''} FROM r
  UNION ALL
  SELECT g, k, INSERT(a0, 'user', u1, a), INSERT(b0, 'user', u1, b), u1, w1 FROM (
    SELECT *, INSERT(u0, 'assistant', w0, u) AS u1, INSERT(w0, 'user', u0, w) AS w1 FROM (
      SELECT g, r.k, ROW_OF(a, 'user', u, b) AS a0, ROW_OF(b, 'user', u, NULL) AS b0, ROW_OF(u, 'assistant', w, NULL) AS u0, ROW_OF(w, 'user', u, NULL) AS w0
      FROM dp JOIN r USING (g) WHERE r.k = dp.k + 1))
), best AS (SELECT g, last(a ORDER BY k) AS x FROM dp GROUP BY g
), told AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.c, 0)::BIGINT AS cost,
  coalesce(x.e, '') AS audit, sha256(coalesce(substr(x.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM c) LEFT JOIN told USING (g) LEFT JOIN best USING (g)
"""


def _dialogue_sql(text: str) -> str:
    def insert(now, role, to, _):
        return f"list_min([{now}, {{'c': {to}.c + 5, 'e': 'I' || {to}.e, 't': chr(10) || '{role}:' || {to}.t}}])"

    def row_of(same, role, to, system):
        kept = f"CASE WHEN ini = '{role[0]}' THEN {{'c': {to}.c + m, 'e': 'K' || {to}.e, 't': l || {to}.t}} ELSE {{'c': {to}.c + m + 1, 'e': 'R' || {to}.e, 't': chr(10) || '{role}:' || text || {to}.t}} END"
        first = f", CASE WHEN ini = 's' AND fault IN ('', 't') THEN {{'c': {system}.c + m, 'e': 'K' || {system}.e, 't': l || {system}.t}} END" if system != "NULL" else ""
        every = f"[{{'c': {same}.c + 2, 'e': 'D' || {same}.e, 't': {same}.t}}, CASE WHEN fault IN ('', 't') THEN {kept} END{first}]"
        return f"list_min(list_filter({every}, lambda z: z IS NOT NULL))".replace("+ m", "+ CASE fault WHEN 't' THEN 5 ELSE 0 END").replace(" l ||", " chr(10) || role || ':' || text ||")

    for name, fn in (("INSERT", insert), ("ROW_OF", row_of)):
        text = re.sub(rf"{name}\(([^()]*)\)", lambda m, fn=fn: fn(*[x.strip(" '") for x in m[1].split(",")]), text)
    return text.replace("CRC_TABLE", CRC_TABLE).replace("CRC %", CRC.format("key") + " %")


@query("op12_repair_conversations", _dialogue_sql(DIALOGUE_SQL))
def repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and repaired text's hash of all conversations."""
    return dialogue.repair(table(spark, folder, "conversations"))


@query("op11_extract_html")
def extract_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, folder, "pages"))
