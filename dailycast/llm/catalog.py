"""The queries of this package, each with its SQL check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.llm import (
    best_fit,
    bpe_stream,
    decontaminate,
    line_runs,
    part_codes,
    passage_quality,
    pivot_simhash,
    preference_chat,
    projection_forest,
    suffix_lm,
    token_alignment,
    token_counts,
    toxic_segments,
)
from dailycast.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_counts")
def op1_token_counts(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(docs, path).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )


@query("op6_decontamination")
def op6_decontamination(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, root, "benchmark"))
    hit = F.col("contamination")
    return found.select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"),
        decontaminate.contaminated(hit).alias("contaminated"),
    )


@query(
    "op9_line_dedup",
    r"""
    with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as body from documents),
    lines as (
        select rid, doc_id, unnest(string_split(body, chr(10))) as line,
               generate_subscripts(string_split(body, chr(10)), 1) as pos
        from docs),
    keyed as (
        select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
        from lines),
    common as (
        select key from keyed where length(key) >= 1 group by key having count(distinct rid) >= 10),
    marked as (select k.*, c.key is not null as gone from keyed k left join common c using (key))
    select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
    from marked group by rid, doc_id""",
)
def op9_line_dedup(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    done = line_runs.drop_common_lines(docs)
    return done.select(
        "doc_id",
        F.col("line_dedup.n_lines").alias("n_lines"),
        F.col("line_dedup.n_dropped").alias("n_dropped"),
        F.sha2(F.col("line_dedup.kept"), 256).alias("kept_sha256"),
    )


@query("op5_simhash_dedup")
def op5_simhash_dedup(spark, root):
    found = pivot_simhash.near_duplicates(table(spark, root, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def fold(divisor: int):
    """The remainder that says whether a document's label may be learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def known_labels(spark, root, column: str, learn) -> DataFrame:
    return table(spark, root, "labels").filter(learn).select("doc_id", F.col(column).alias("label"))


def judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op3_quality")
def op3_quality(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    labels = known_labels(spark, root, "quality", fold(3) != 1)
    return judged(passage_quality.score_quality(docs, labels), fold(3) == 1)


@query("op7_toxicity")
def op7_toxicity(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    labels = known_labels(spark, root, "toxic", fold(5) != 0)
    scored = toxic_segments.score_toxicity(docs, labels)
    return judged(scored.withColumn("score", F.col("toxicity.score")), fold(5) == 0)


def packed(docs: DataFrame) -> DataFrame:
    """Documents cut, numbered and packed as the packing contract has it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = best_fit.document_pieces(docs, path, keep_ids=False).drop("ids")
    return best_fit.pack(pieces)


@query("op10_packing")
def op10_packing(spark, root):
    return packed(table(spark, root, "documents").select("doc_id", "text"))


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark, root):
    return projection_forest.nearest(table(spark, root, "embeddings"), F.col("id") % 20 == 0)


@query("op2_lm_scores")
def op2_lm_scores(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    scored = suffix_lm.score_documents(docs, F.coalesce(fold(7) != 2, F.lit(True)))
    held_out = F.coalesce(fold(7) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def shown_spans(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["first"], s["last"])), ",")


@query(
    "op8_preference_chat",
    """
    with turns as (
        select conv_id // 2 as pair_id, conv_id % 2 = 0 as side, coalesce(role, '') as role, coalesce(text, '') as body,
               row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
        from conversations),
    sizes as (
        select pair_id, count(*) filter (where side) as n_chosen, count(*) filter (where not side) as n_rejected
        from turns group by pair_id),
    met as (
        select pair_id, pos, count(*) = 2 and count(distinct role || chr(0) || body) = 1 as same
        from turns group by pair_id, pos),
    common as (
        select pair_id, coalesce(min(pos) filter (where not same) - 1, max(pos)) as n_common from met group by pair_id),
    drawn as (
        select t.*, n_common, '<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10) as shown
        from turns t join common using (pair_id)),
    placed as (
        select *, coalesce(sum(length(shown)) over (
                      partition by pair_id, side, pos > n_common order by pos
                      rows between unbounded preceding and 1 preceding), 0) + 13 + length(role) as first
        from drawn)
    select pair_id, any_value(n_common)::integer as n_common, any_value(n_chosen)::integer as n_chosen,
           any_value(n_rejected)::integer as n_rejected,
           coalesce(string_agg(shown, '' order by pos) filter (where side and pos <= n_common), '') as prompt,
           case when any_value(n_chosen) > 0 then
               coalesce(string_agg(shown, '' order by pos) filter (where side and pos > n_common), '') end as chosen,
           case when any_value(n_chosen) > 0 then
               coalesce(string_agg(first::bigint || '-' || (first + length(body) + 10)::bigint, ',' order by pos)
                        filter (where side and pos > n_common and role = 'assistant'), '') end as chosen_mask,
           case when any_value(n_rejected) > 0 then
               coalesce(string_agg(shown, '' order by pos) filter (where not side and pos > n_common), '') end as rejected,
           case when any_value(n_rejected) > 0 then
               coalesce(string_agg(first::bigint || '-' || (first + length(body) + 10)::bigint, ',' order by pos)
                        filter (where not side and pos > n_common and role = 'assistant'), '') end as rejected_mask
    from placed join sizes using (pair_id) group by pair_id""",
)
def op8_preference_chat(spark, root):
    """Conversations 2k and 2k + 1 are a pair, the even one chosen."""
    turns = table(spark, root, "conversations")
    turns = turns.withColumn("pair_id", F.floor(F.col("conv_id") / 2)).withColumn("is_chosen", F.col("conv_id") % 2 == 0)
    pairs = preference_chat.preference_pairs(turns, "pair_id", "is_chosen")
    return pairs.withColumn("chosen_mask", shown_spans("chosen_mask")).withColumn(
        "rejected_mask", shown_spans("rejected_mask")
    )


def lloyd_sql(rounds: int = part_codes.ROUNDS) -> str:
    """Rounds of assigning and moving written one after the other, over all rows."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
    near{k} as (
        select rid, p, any_value(part) as part, min(far * 16 + k) as best
        from (select m.rid, m.p, m.part, b.k, list_sum(list_transform(
                         list_zip(m.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as far
              from members m join book{k} b on m.p = b.p) group by rid, p)""")
        if k < rounds:
            steps.append(f"""
    mean{k} as (
        select p, k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as entry
        from (select p, best % 16 as k, i, sum(part[i])::bigint as s, count(*) as n
              from near{k}, unnest(range(1, len(part) + 1)) t(i) group by all) group by p, k),
    book{k + 1} as (
        select b.p, b.k, coalesce(m.entry, b.entry) as entry from book{k} b left join mean{k} m on b.p = m.p and b.k = m.k)""")
    return f"""
    with kept as (
        select row_number() over () as rid, vec_id, label,
               list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v
        from embeddings where embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    members as (
        select rid, vec_id, v, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) as part
        from kept, unnest(range(8)) t(p)),
    book0 as (
        select p, k, part as entry from (
            select p, part, row_number() over (partition by p order by vec_id nulls last, v) - 1 as k from members) where k < 16),
    {",".join(steps)},
    coded as (
        select rid, string_agg(printf('%02x', best % 16), '' order by p) as code, sum(best // 16)::bigint as error
        from near{rounds} group by rid)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
           (select sha256(string_agg(x::varchar, ',' order by p, k, i))
            from (select p, k, i, entry[i] as x from book{rounds}, unnest(range(1, len(entry) + 1)) t(i))) as codebooks_sha256
    from coded join kept using (rid)"""


@query("op11_vector_codes", lloyd_sql())
def op11_vector_codes(spark, root):
    coded, codebooks = part_codes.compress(table(spark, root, "embeddings"))
    return coded.select(
        "vec_id",
        F.array_join(F.transform("code.entries", lambda k: F.lpad(F.lower(F.hex(k)), 2, "0")), "").alias("code"),
        F.col("code.error").alias("error"),
        F.col("code.label_error").alias("label_error"),
        F.lit(part_codes.codebooks_sha256(codebooks)).alias("codebooks_sha256"),
    )


@query("op12_token_alignment")
def op12_token_alignment(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.aligned(docs, *paths).select("doc_id", "alignment.*")


@query("op13_bpe_codec")
def op13_bpe_codec(spark, root):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, root, "documents").select("doc_id", bpe_stream.round_trip(F.col("text"), path).alias("codec"))
    return docs.select(
        "doc_id",
        (F.octet_length("codec.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("codec.ids", 256).alias("ids_sha256"),
        F.sha2("codec.text", 256).alias("decoded_sha256"),
    )
