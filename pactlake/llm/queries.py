"""One query for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cpsjoin import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_shuffle_bpe import encode_decode

    return encode_decode(
        _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN
    )


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import flac

    return flac.features(flac.stored(_read(spark, sf_dir, "documents")))


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bottomk import edited_neighbours

    return edited_neighbours(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_read(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import gbdt

    docs = _read(spark, sf_dir, "documents")
    return gbdt.score(docs, gbdt.train(docs, _read(spark, sf_dir, "labels")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import skipchain

    docs = _read(spark, sf_dir, "documents")
    return skipchain.find(docs, skipchain.learn(docs))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .yinyang import vector_codes

    return vector_codes(_read(spark, sf_dir, "embeddings"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_runs import line_dedup

    return line_dedup(_read(spark, sf_dir, "documents"))


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_links import token_links

    return token_links(
        _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_flac, op3_bottom_k, op4_token_counts, op5_quality, op6_pii, op7_mixing, op8_repeats,
        op9_byte_bpe, op10_warc, op11_yinyang, op12_line_runs, op13_token_links
    )
}

_NEAR = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w)>=5 THEN list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w)>0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM t),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
c AS (SELECT a.doc_id x, b.doc_id y, count(*) k FROM s a JOIN s b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id=x JOIN n q ON q.doc_id=y WHERE 100*k >= 75*(p.n+q.n-k)),
e AS (SELECT x u, y v FROM l UNION ALL SELECT y, x FROM l),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v=e.u)
SELECT d.doc_id, coalesce(n.n,0)::BIGINT n_shingles, m.component_id, d.doc_id=m.component_id kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u doc_id, min(v) component_id FROM r GROUP BY 1) m USING (doc_id)
"""
_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text,''))) h, octet_length(encode(coalesce(text,''))) n FROM documents),
w AS (SELECT doc_id, p, substr(h, p*2+1, 200) s FROM (SELECT doc_id, h, unnest(range(0, greatest(n-99,0))) p FROM d)),
f AS (SELECT hash(s) k, s, min((doc_id, p)) m FROM w GROUP BY s HAVING count(*)>1),
x AS (SELECT w.doc_id, w.p FROM w JOIN f ON w.s=f.s WHERE (w.doc_id, w.p) <> f.m),
b AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END nw FROM x),
g AS (SELECT doc_id, min(p) a, max(p)+100 z FROM (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY p) i FROM b) GROUP BY doc_id, i),
q AS (SELECT doc_id, a, z, lag(z,1,0) OVER (PARTITION BY doc_id ORDER BY a) pz FROM g),
o AS (SELECT doc_id, string_agg(substr(h, pz*2+1, (a-pz)*2), '' ORDER BY a) kept, max(z) last, sum(z-a) removed, count(*) spans FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT n_bytes, coalesce(removed,0)::BIGINT n_removed, coalesce(spans,0)::BIGINT n_spans, sha256(unhex(coalesce(kept,'') || substr(h, coalesce(last,0)*2+1))) kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
_WARC = """
WITH b AS (SELECT page_id, octet_length(encode(coalesce(html,'')))::BIGINT n, sha256(coalesce(html,'')) s FROM pages), f AS (SELECT s, min(page_id) m FROM b WHERE n >= 100 GROUP BY s)
SELECT page_id, n payload_bytes, s payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END record_type, CASE WHEN m <> page_id THEN m END refers_to FROM b LEFT JOIN f USING (s)
"""
_LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) line, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) p FROM documents),
k AS (SELECT *, translate(trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k FROM l),
c AS (SELECT k, max(doc_id) last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, line, p, coalesce(doc_id < last, false) dropped FROM k LEFT JOIN c USING (k))
SELECT doc_id, count(*)::BIGINT n_lines, count(*) FILTER (dropped)::BIGINT n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT dropped), '')) kept_sha256 FROM m GROUP BY doc_id
"""


def _codes(rounds: int = 4) -> str:
    """Lloyd's iterations as CTEs: every part against every entry; u holds (distance, entry) as one number."""
    nearest = "SELECT p.vec_id, p.m, min((p.q + b.q - 2 * list_dot_product(p.x, b.x))::BIGINT * 256 + b.e) u FROM p JOIN b{} b ON p.m = b.m GROUP BY ALL"
    sql = """
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT *, list_dot_product(x, x) q FROM (SELECT vec_id, m, v[m * (len(v) // 4) + 1 : (m + 1) * (len(v) // 4)] x FROM k, range(4) r(m))),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 e FROM k ORDER BY vec_id LIMIT 256),
b0 AS MATERIALIZED (SELECT m, e, x, q FROM p JOIN f USING (vec_id)),"""
    for i in range(rounds):
        sql += f"""
a{i} AS MATERIALIZED ({nearest.format(i)}),
s{i} AS (SELECT m, u % 256 e, i, floor(sum(c) / count(*)) c FROM (SELECT p.m, u, unnest(x) c, generate_subscripts(x, 1) i FROM p JOIN a{i} USING (vec_id, m)) GROUP BY ALL),
n{i} AS (SELECT m, e, list(c ORDER BY i) y FROM s{i} GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT m, e, coalesce(y, x) x, list_dot_product(coalesce(y, x), coalesce(y, x)) q FROM b{i} LEFT JOIN n{i} USING (m, e)),"""
    return sql + f"""
z AS MATERIALIZED ({nearest.format(rounds)}),
h AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY m, e, i)) s FROM (SELECT m, e, unnest(x) c, generate_subscripts(x, 1) i FROM b{rounds})),
c AS (SELECT vec_id, string_agg(printf('%02x', u % 256), '' ORDER BY m) code, sum(u // 256)::BIGINT error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT label_error, s codebooks_sha256 FROM c JOIN k USING (vec_id), h
"""


#: DuckDB SQL where it can express an operator.
ORACLES: dict[str, str] = {"op1_near_dedup": _NEAR, "op8_repeats": _REPEATS, "op10_warc": _WARC, "op11_yinyang": _codes(), "op12_line_runs": _LINES}
