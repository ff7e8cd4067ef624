"""The registered queries of this subpackage, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.llm import (
    archive, exact_dedup, inner_products, language_id, language_model, manifest, mixing, near_dedup, phrases, secrets, sentence_pieces, token_ids, toxicity,
)
from contractlake.llm.common import new_path, table


def _tokenizer(name: str) -> str:
    """Where the public tokenizers' file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, rank, CASE WHEN cap / weight <= level THEN cap
    ELSE weight * max(CASE WHEN cap / weight > level THEN level END) OVER () END AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, d.key, CAST(floor(t.target) AS BIGINT) AS quota,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, greatest(0, least(size, quota - pos)) AS one, greatest(0, least(size, quota - pos - source_size)) AS two,
    CASE WHEN rank % 2 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS w0, CASE WHEN rank % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS slope FROM p)
SELECT doc_id, size, source_size, target, one + two AS taken,
  round(CASE WHEN one > 0 THEN 2 * (CAST(pos AS DOUBLE) / quota) / (w0 + sqrt(greatest(0, w0 * w0 + 2 * slope * (CAST(pos AS DOUBLE) / quota))))
    ELSE 1 + CAST(('0x' || substr(key, 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE END, 6) AS position
FROM k
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    stored = archive.write_archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    records = archive.read_archive(spark, path, table=stored)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", F.sha2("record", 256).alias("record_sha256"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p),
r AS (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to, true AS verified,
  sha256(concat(concat_ws(chr(13) || chr(10), 'WARC/1.1', CASE WHEN again THEN 'WARC-Type: revisit' ELSE 'WARC-Type: response' END,
      concat('WARC-Record-ID: <urn:page:', page_id, '>'), 'WARC-Date: 2000-01-01T00:00:00Z', 'WARC-Target-URI: ' || translate(url, chr(13) || chr(10), ''),
      concat('WARC-Payload-Digest: sha256:', payload_digest), CASE WHEN again THEN concat('WARC-Refers-To: <urn:page:', first_id, '>') END,
      CASE WHEN again THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END, 'Content-Type: text/html; charset=utf-8',
      concat('Content-Length: ', CASE WHEN again THEN 0 ELSE payload_bytes END)),
    chr(13), chr(10), chr(13), chr(10), CASE WHEN again THEN '' ELSE payload END, chr(13), chr(10), chr(13), chr(10))) AS record_sha256
FROM r
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tokenizer = new_path(spark, "token-shards"), _tokenizer("word_bpe_49k.json")
    token_ids.write_shards(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer, path)
    return token_ids.read_documents(spark, path, tokenizer)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT r, unnest(list_concat(['<s> '], words)) AS v, unnest(list_concat(words, ['</s> '])) AS w FROM d WHERE len(words) > 0),
one AS (SELECT w, count(*)::DOUBLE AS n FROM w GROUP BY w),
start AS (SELECT v AS w, count(*)::DOUBLE AS n FROM w WHERE v = '<s> ' GROUP BY v),
two AS (SELECT v, w, count(*)::DOUBLE AS n FROM w GROUP BY v, w),
s AS (
  SELECT two.v, two.w, CASE WHEN two.n >= 2 THEN ln(two.n / cv.n) ELSE ln(0.4::DOUBLE * cw.n / (SELECT count(*) FROM w)) END AS s
  FROM two JOIN (SELECT * FROM one UNION ALL SELECT * FROM start) AS cv ON two.v = cv.w JOIN one AS cw ON two.w = cw.w),
t AS (SELECT r, count(*) AS n_words, sum(s) AS log_score FROM w JOIN s USING (v, w) GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(log_score, 5) AS log_score, round(log_score / n_words, 6) AS mean_log_score
FROM d LEFT JOIN t USING (r)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), _tokenizer("piece_bpe_32k.model"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY u, v),
l AS (SELECT u, v FROM b JOIN n AS x ON u = x.doc_id JOIN n AS y ON v = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS t FROM n UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.t = e.u),
k AS (SELECT doc_id, min(t) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.least, d.doc_id) AS component_id, d.doc_id = coalesce(k.least, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents", *manifest.FIELDS))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
d AS (
  SELECT doc_id, lang, array_to_string(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
      lambda x: CASE WHEN x IS NULL THEN '-' ELSE concat(octet_length(encode(x)), ':', x) END), '') AS head,
    CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', text) END AS body,
    CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS changed,
    doc_id IS NOT NULL AND xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 3 = 0 AS tampered
  FROM documents, crc),
h AS (SELECT doc_id, lang, sha256(concat(head, body)) AS leaf, CASE WHEN tampered THEN sha256(concat(head, changed)) ELSE sha256(concat(head, body)) END AS seen FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM h),
n AS (
  SELECT lang, 0 AS level, place, leaf AS digest FROM l
  UNION ALL
  SELECT lang, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS m FROM n) WHERE m > 1 GROUP BY lang, level + 1, place // 8),
s AS (SELECT lang, digest AS subroot FROM n QUALIFY level = max(level) OVER (PARTITION BY lang)),
u AS (SELECT lang, subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM s),
t AS (
  SELECT 0 AS level, place, subroot AS digest FROM u
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER () AS m FROM t) WHERE m > 1 GROUP BY level + 1, place // 8),
r AS (SELECT digest AS root FROM t QUALIFY level = max(level) OVER ()),
e AS (
  SELECT a.lang, a.place, n.level, coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (WHERE n.place < a.place // CAST(8 ** n.level AS BIGINT)), '') AS before,
    coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (WHERE n.place > a.place // CAST(8 ** n.level AS BIGINT)), '') AS after
  FROM l AS a JOIN (SELECT *, max(level) OVER (PARTITION BY lang) AS top FROM n) AS n
    ON a.lang IS NOT DISTINCT FROM n.lang AND n.level < n.top AND n.place // 8 = a.place // CAST(8 ** (n.level + 1) AS BIGINT)
  GROUP BY a.lang, a.place, n.level
  UNION ALL
  SELECT a.lang, a.place, 100 + n.level, coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (WHERE n.place < u.place // CAST(8 ** n.level AS BIGINT)), ''),
    coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (WHERE n.place > u.place // CAST(8 ** n.level AS BIGINT)), '')
  FROM l AS a JOIN u ON a.lang IS NOT DISTINCT FROM u.lang JOIN (SELECT *, max(level) OVER () AS top FROM t) AS n ON n.level < n.top AND n.place // 8 = u.place // CAST(8 ** (n.level + 1) AS BIGINT)
  GROUP BY a.lang, a.place, 100 + n.level),
p AS (SELECT lang, place, sha256(string_agg(concat(before, after), '' ORDER BY level)) AS proof_sha256, list(concat(before, '|', after) ORDER BY level) AS steps FROM e GROUP BY lang, place),
f AS (
  SELECT l.doc_id, l.leaf, u.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_concat([l.seen], coalesce(p.steps, [])), lambda x, y: sha256(concat(split_part(y, '|', 1), x, split_part(y, '|', 2)))) AS folded_root
  FROM l JOIN u ON l.lang IS NOT DISTINCT FROM u.lang CROSS JOIN r LEFT JOIN p ON l.lang IS NOT DISTINCT FROM p.lang AND l.place = p.place)
SELECT *, folded_root = root AS verified FROM f
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _op12_sql() -> str:
    classes = []
    for kind in secrets.CLASSES:
        low = "lower(what)" if kind.kind == "hexrun" else "what"
        test = ("" if kind.kind == "hexrun" else "NOT ") + "regexp_matches(what, '^[0-9A-Fa-f]+$')"
        held = "".join(f" AND regexp_matches(what, '{x}')" for x in secrets.HELD[kind.kind])
        weights = ", ".join(str(secrets.weighted(c)) for c in range(kind.width + 1))
        classes.append(rf"""
  SELECT r, {secrets.KINDS.index(kind.kind)} AS kind, a FROM (
    SELECT r, a, x, count(*) AS c FROM (
      SELECT r, a, unnest(range(1, {kind.width + 1})) AS j, s, i, substr(s, CAST(i + j AS BIGINT), 1) AS x FROM (
        SELECT r, first + i AS a, s, i FROM (SELECT r, first, {low} AS s, unnest(range(0, len(what) - {kind.width - 1})) AS i FROM runs WHERE {test}{held} AND NOT allowed))) GROUP BY r, a, x)
  GROUP BY r, a HAVING sum(([{weights}])[c + 1]) <= {secrets.limit(kind)}""")
    # What the other engine's patterns can't say (lookarounds, repeated groups) follows from leftmost, greedy matching of whole runs.
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
q AS (SELECT * FROM (VALUES
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'), (5, '[0-9A-Za-z+/_=-]+')) AS v(kind, pattern)),
m AS (SELECT r, kind, pattern, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS gaps FROM d, q),
g AS (SELECT r, kind, pattern, unnest(found) AS what, unnest(gaps[:len(found)]) AS gap, unnest(range(1, len(found) + 1)) AS i FROM m WHERE len(found) > 0),
e AS (SELECT *, CAST(sum(len(gap) + len(what)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM g),
base AS (
  SELECT r, kind, stop - len(what) AS start, stop FROM e
  WHERE CASE kind WHEN 0 THEN len(regexp_extract(what, pattern, 2)) >= 8 WHEN 1 THEN len(what) >= 16 WHEN 2 THEN len(what) >= 32 ELSE false END),
runs AS (
  SELECT r, stop - len(what) AS first, what,
    regexp_matches(what, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$') OR len(list_distinct(string_split(what, ''))) <= 1
    OR (replace(what, what[1:2], '') IN ('', what[1:1])) OR regexp_matches(lower(what), 'abcdefghijkl|qwertyuiop|0123456789|1234567890|example|placeholder|changeme|xxxxxxxx') AS allowed
  FROM e WHERE kind = 5 AND len(what) >= 24),
w AS ({" UNION ALL ".join(classes)}),
i AS (SELECT *, CASE WHEN a < lag(a) OVER (PARTITION BY r, kind ORDER BY a) + 24 THEN 0 ELSE 1 END AS opens FROM w),
k AS (SELECT r, kind, a, sum(opens) OVER (PARTITION BY r, kind ORDER BY a) AS island FROM i),
x AS (SELECT r, kind, min(a) AS start, max(a) + 24 AS stop FROM k GROUP BY r, kind, island),
al AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM x),
j AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(concat([{", ".join(repr(x) for x in secrets.KINDS)}][kind + 1], ':', start, ':', stop), ',' ORDER BY start, kind) FILTER (WHERE is_base) AS base,
    string_agg(concat([{", ".join(repr(x) for x in secrets.KINDS)}][kind + 1], ':', start, ':', stop), ',' ORDER BY start, kind) AS spans
  FROM al GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents", "lang", "text"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (
  SELECT lang, piece_id, unnest(words) AS a, unnest(range(len(words))) AS i
  FROM (SELECT lang, row_number() OVER () AS piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p)),
x AS (SELECT lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM w WINDOW o AS (PARTITION BY piece_id ORDER BY i)),
g AS (
  SELECT lang, 1 AS k, a AS phrase FROM x UNION ALL SELECT lang, 2, concat_ws(' ', a, b) FROM x WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, concat_ws(' ', a, b, c) FROM x WHERE c IS NOT NULL UNION ALL SELECT lang, 4, concat_ws(' ', a, b, c, d) FROM x WHERE d IS NOT NULL),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
a AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM c WHERE k > 1 AND f >= 30),
u AS (SELECT lang, k, phrase, a, words, unnest(range(1, k)) AS cut FROM a),
s AS (
  SELECT u.lang, u.phrase, u.a, u.k, u.cut, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * u.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM u JOIN c AS x ON x.lang = u.lang AND x.phrase = array_to_string(words[:cut], ' ') JOIN c AS y ON y.lang = u.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
j AS (SELECT lang, a, words, k, unnest([2, 3]) AS size FROM a WHERE k > 2),
h AS (SELECT lang, a, words, size, unnest(range(1, k - size + 2)) AS i FROM j WHERE size < k),
m AS (SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, max(a) AS longest FROM h GROUP BY 1, 2),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN m ON b.lang = m.lang AND b.phrase = m.phrase WHERE m.longest IS NULL OR CAST(100 AS HUGEINT) * m.longest < CAST(80 AS HUGEINT) * b.a)
SELECT o.lang, rank, o.phrase, a, l, r, n.n, score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (
        op1_mixing, op2_token_ids, op3_warc, op4_exact_dedup, op5_lm_scoring, op6_toxicity, op7_top_k,
        op8_sentence_pieces, op9_near_dedup, op10_language_id, op11_merkle_manifest, op12_secret_scan, op13_collocations, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1_SQL, "op3_warc": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op5_lm_scoring": OP5_SQL, "op7_top_k": OP7_SQL, "op9_near_dedup": OP9_SQL,
        "op11_merkle_manifest": OP11_SQL, "op12_secret_scan": _op12_sql(), "op13_collocations": OP13_SQL,
    }
