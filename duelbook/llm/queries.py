"""Registered queries of this package: each applies one operator, with its production parameters, to its whole table.

The digest columns (hashes, checksums, counts) are derived here from what the operators return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.llm import (
    byte_bpe, centroids, chat, language_id, minhash, packing, projection_knn, quality_knn, sharding, simhash, spelling, superkmers, transport_stream,
)
from duelbook.llm.common import prepare
from duelbook.plans.registry import registry

QUERIES, ORACLE, register = registry()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


@register()
def op2_packing(spark, sf):
    """All documents packed into windows of 2048 tokens by best-fit decreasing."""
    pieces = packing.pack(table(spark, sf, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


@register()
def op4_sharding(spark, sf):
    """All documents on a bounded-load ring of 16 shards; row counts are at most one apart."""
    placed = sharding.shard_documents(table(spark, sf, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_CHAT = """with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
  coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
  sum(length('<|turn|><|body|><|end|>' || chr(10) || role) + length(replace(replace(replace(text, '&', '&a;'), '<', '&l;'), '[', '&b;'))) as chars
  from c group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from f"""


@register(_CHAT)
def op5_chat(spark, sf):
    """All conversations, and one that is made of control strings, formatted and read back."""
    raw = table(spark, sf, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    both = raw.unionByName(control)
    chats = chat.format_chats(both.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    turns = F.array_join(F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.learned_text(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans"))
    read = chats.select("conv_id", F.size(chat.pieces_of(F.col("formatted"))).cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"), "formatted")
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


@register()
def op10_byte_bpe(spark, sf):
    """All documents encoded by the transducer and decoded again."""
    coded = byte_bpe.encode_documents(table(spark, sf, "documents"))
    return coded.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@register()
def op8_minhash(spark, sf):
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@register()
def op3_super_kmers(spark, sf):
    """All documents without the words that windows of 13 words share with an earlier document."""
    cleaned = superkmers.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "removal.n_words", "removal.n_removed", F.sha2("removal.kept", 256).alias("kept_sha256"))


@register()
def op9_quality(spark, sf):
    """Quality of all documents by the vote of their nearest labelled documents."""
    return quality_knn.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register()
def op1_language_id(spark, sf):
    """Language of all documents from text, declaration, and source prior."""
    found = language_id.identify_documents(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "language_id.*")


@register()
def language_id_of_pages(spark, sf):
    """The same operator on all web pages: text, markup, address suffix, host and domain prior."""
    found = language_id.identify_pages(table(spark, sf, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "language_id.*")


@register()
def op6_transport_stream(spark, sf):
    """All documents stored as transport streams, and read back."""
    stored = transport_stream.store_documents(table(spark, sf, "documents"))
    back = F.col("parsed.payload")
    return stored.select(
        "doc_id", "n_bytes", F.octet_length(back).cast("long").alias("payload_bytes"), F.sha2(back, 256).alias("payload_sha256"),
        F.crc32(F.substring(back, -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), transport_stream.feature(F.col("parsed")).alias("feature"))


@register()
def op7_projection_knn(spark, sf):
    """The ten nearest vectors of every hundredth one."""
    return projection_knn.nearest(table(spark, sf, "embeddings"))


@register()
def op11_spelling_variants(spark, sf):
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(table(spark, sf, "documents"))


@register()
def op12_simhash(spark, sf):
    """Fingerprints of all documents and the components of those that differ in at most two bits."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


def _centroid_sql(clusters: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Every round as a pair of common table expressions: assignment, means."""
    square = f"list_sum([(x.v[i] - k.v[i]) * (x.v[i] - k.v[i]) for i in range(1, {size + 1})])"
    parts = [f"""x as materialized (select vec_id, [cast(floor(1024 * cast(c as double)) as bigint) for c in embedding] as v from embeddings
  where len(embedding) = {size} and len([c for c in embedding if isfinite(c)]) = {size})""",
             f"k0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 as c, v from x order by sha256('3:' || vec_id) limit {clusters})"]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (select vec_id, v, c, d from (select x.vec_id, x.v, k.c, {square} as d from x, k{r} k)
  qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if r < rounds:
            parts.append(f"""k{r + 1} as materialized (select k.c, coalesce(m.v, k.v) as v from k{r} k left join (select c, list((s - (s % n + n) % n) // n order by i) as v from
  (select c, i, sum(e) as s, count(*) as n from (select c, unnest(v) as e, unnest(range({size})) as i from a{r}) group by c, i) group by c) m using (c))""")
    return f"""with {", ".join(parts)}
select vec_id, cast(c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(k.v, ',')) as centroid_sha256 from a{rounds} join k{rounds} k using (c)"""


@register(_centroid_sql())
def op13_centroids(spark, sf):
    """Eight clusters of all vectors after ten rounds."""
    return centroids.with_inertia(*centroids.cluster(table(spark, sf, "embeddings")))
