"""The queries opN_<name> with the production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import ann, bpe, centroids, html_text, line_dedup, minhash, packing, quality, rlz_dedup, suffix_dedup, toxicity, vector_dedup
from voxlake.llm.common import crc32_text, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, derive={"ids_crc32": ("bigint", packing.ids_crc32)})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def _judged(scores: DataFrame, folds: int, held: int, least: float) -> DataFrame:
    held_out = crc32_text("doc_id") % folds == held
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc32_text("doc_id") % 3 != 1)
    return _judged(toxicity.score(docs, machine), 3, 1, 0.7)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality.fit(docs, table(spark, sf_dir, "labels"), crc32_text("doc_id") % 5 != 0)
    return _judged(quality.score(docs, network), 5, 0, 0.3)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    derive: suffix_dedup.Derive = {"kept_sha256": ("string", lambda kept, spans: hashlib.sha256(kept).hexdigest())}
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), 50, derive)


def _ids_sha256(codec: bpe.ByteCodec, ids) -> str:
    return hashlib.sha256(",".join([codec.decimal[i] for i in ids.tolist()]).encode()).hexdigest()


def _decoded_sha256(codec: bpe.ByteCodec, ids) -> str:
    return hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    derive: bpe.Derive = {"n_tokens": ("bigint", lambda codec, ids: len(ids)), "ids_sha256": ("string", _ids_sha256), "decoded_sha256": ("string", _decoded_sha256)}
    return bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, derive)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.dedup_lines(docs, "source")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    derive: rlz_dedup.Derive = {"kept_sha256": ("string", lambda kept, spans: hashlib.sha256(kept).hexdigest())}
    return rlz_dedup.dedup_passages(table(spark, sf_dir, "documents"), 35, derive)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_pack, op2_minhash, op3_toxicity, op4_quality, op5_suffix_dedup, op6_bpe, op7_html_text, op8_ann, op9_vector_dedup, op10_line_dedup, op11_centroids, op12_rlz_dedup)
}

OP10_SQL = f"""
with lines as (select rowid_ rid, coalesce('=' || source, '-') host, unnest(string_split(text, chr(10))) line
               from (select row_number() over () rowid_, source, text from documents)),
counts as (select host, line, count(distinct rid) pages from lines where trim(line) <> '' group by all),
totals as (select coalesce('=' || source, '-') host, count(*) total from documents group by all),
common as (select host, list(line) bp from counts join totals using (host)
           where pages >= {line_dedup.MIN_PAGES} and total >= {line_dedup.MIN_HOST_PAGES} and pages > total * {line_dedup.RATIO} group by host),
cut as (select doc_id, string_split(text, chr(10)) ls, coalesce(bp, []) bp
        from documents left join common on common.host = coalesce('=' || source, '-')),
kept as (select doc_id, ls, list_filter(ls, lambda x: not list_contains(bp, x)) ks from cut)
select doc_id, coalesce(len(ls), 0)::bigint n_lines, coalesce(len(ls) - len(ks), 0)::bigint n_dropped,
       case when ls is null then null else sha256(array_to_string(ks, chr(10))) end kept_sha256 from kept
"""



def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds written out one after another: a<r> assigns to c<r>, c<r + 1> moves."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} as materialized (select rid, c, sum((x - v) * (x - v)) d from parts join c{r} using (i) group by all),
a{r} as materialized (select rid, c, d from (select *, row_number() over (partition by rid order by d, c) p from d{r}) where p = 1)""")
        if r < rounds:
            steps.append(f"""m{r} as (select c, i, sum(x) s, count(*) n from a{r} join parts using (rid) group by all),
c{r + 1} as materialized (select c{r}.c, c{r}.i, case when n is null then v else (s - ((s % n) + n) % n) // n end v from c{r} left join m{r} using (c, i))""")
    return f"""
with kept as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::hugeint) q from embeddings
                           where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
parts as materialized (select rid, unnest(range(64)) i, unnest(q) x from kept),
first as (select rid, row_number() over (order by sha256('1:' || vec_id), q) - 1 c from kept where vec_id is not null),
c0 as materialized (select c, i, x v from first join parts using (rid) where c < {k}),
{", ".join(steps)},
shas as (select c, sha256(string_agg(v::varchar, ',' order by i)) sha from c{rounds} group by c)
select vec_id, c::int as cluster, d::bigint distance, (sum(d) over (partition by c))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, sha centroid_sha256
from a{rounds} join kept using (rid) join shas using (c)
"""


OP12_SQL = r"""
with docs as materialized (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
starts as materialized (select rid, unnest(range(1, len(ws) - 33)) p, unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) w from docs),
twice as materialized (select rid, p from starts join (select w from starts group by w having count(*) > 1) using (w)),
words as materialized (select rid, unnest(range(1, len(ws) + 1)) p, unnest(ws) w from docs),
near as (select words.rid, p, w, max(twice.p) over (partition by words.rid order by p) last from words left join twice using (rid, p)),
flagged as (select rid, p, w, coalesce(last >= p - 34, false) gone from near),
sums as (select rid, count(*) n, count(*) filter (gone) cut, string_agg(w, ' ' order by p) filter (not gone) kept from flagged group by rid)
select doc_id, coalesce(n, 0)::bigint n_words, coalesce(cut, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from docs left join sums using (rid)
"""

SQL: dict[str, str] = {"op10_line_dedup": OP10_SQL, "op11_centroids": _op11_sql(), "op12_rlz_dedup": OP12_SQL}
