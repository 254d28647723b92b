"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from rankfold.llm import ann, bpe_codec, jaccard, merkle, packing, periodic_runs, quality, secrets, sharding, suffix_dedup, topk, warc, whitening
from rankfold.llm.common import table

QUERIES, ORACLE = {}, {}


def query(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql:
        ORACLE[fn.__name__] = sql
    return fn


@query
def op1_best_two_fit_packing(spark, sf_dir):
    """All documents, cut and packed into sequences of 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), 2048)


@query
def op3_two_pass_shuffle(spark, sf_dir):
    """All documents dealt to 24 shards from a global random order."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op10_bpe_round_trip(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    return bpe_codec.encode_and_decode(table(spark, sf_dir, "documents"))


@query
def op4_quality_classifier(spark, sf_dir):
    """Quality score of every document."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_transaction_assembly(spark, sf_dir):
    """All pages written as WARC records, read back and assembled."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


ORACLE["op2_transaction_assembly"] = """
with p as (
    select page_id, coalesce(html, '') as h from pages),
d as (
    select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest from p),
m as (
    select payload_digest, min(page_id) as first_page from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, cast(d.payload_bytes as bigint) as payload_bytes, d.payload_digest,
    case when m.first_page is not null and d.page_id is distinct from m.first_page then 'revisit' else 'response' end as record_type,
    case when m.first_page is not null and d.page_id is distinct from m.first_page then m.first_page end as refers_to
from d left join m using (payload_digest)
"""


@query
def op5_credential_linking(spark, sf_dir):
    """Secrets and linked credentials of every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op7_histogram_selection(spark, sf_dir):
    """The ten highest integer inner products of every hundredth vector against all others."""
    rows = topk.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return topk.top_k(rows.where("id % 100 = 0"), rows, 10)


ORACLE["op7_histogram_selection"] = """
with v as (
    select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as w
    from embeddings
    where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
    select q.vec_id as query_id, c.vec_id,
        cast(list_sum([q.w[i] * c.w[i] for i in range(1, len(q.w) + 1)]) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""


@query
def op9_projection_forest(spark, sf_dir):
    """The twenty nearest found by inner product for every twentieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"))


@query
def op6_prefix_filter_join(spark, sf_dir):
    """Shingle counts and near-duplicate components of all documents."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query
def op8_difference_cover_dedup(spark, sf_dir):
    """Bytes of every document that belong to strings of 100 bytes which also start earlier."""
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


@query
def op11_suffix_tree_runs(spark, sf_dir):
    """Runs of repeated words of every document, a tenth of which get a planted periodic tail, and the texts without them."""
    docs = periodic_runs.with_planted_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.summary(periodic_runs.find_runs(docs))


@query
def op12_polarised_whitening(spark, sf_dir):
    """All embeddings projected on sixteen whitened principal components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_merkle_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))
