"""Queries of the training-data operators over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fm_index, hmm, hnsw, language_id, merkle, minhash, mixing, outliers, paragraphs, snapshots, token_lengths, warc, whitening
from .common import fold, materialize, table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of benchmark items."""
    found = fm_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=13, share=5)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose crc32 fold is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = language_id.fit(docs.filter(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document, and whether it is no robust outlier of its language and source."""
    found = outliers.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document, learnt from those whose crc32 fold is not 0."""
    return hmm.score(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents (in words) that repeat a paragraph or passage of an earlier document, the owner."""
    return paragraphs.repeats(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "owner", "n_words")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicate documents on 2-word shingles, with its smallest id kept."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact histogram of encoded lengths of all documents, with suffix sums."""
    return token_lengths.length_histogram(token_lengths.encoded_lengths(table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from the archives that all pages were written to; gaps, if any, are logged beside the archives."""
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(spark)
    found = materialize(warc.read(warc.write(warc.planned(pages), folder), with_payload=False), "records")
    warc.quarantine(found, folder)
    kind = pages.schema["page_id"].dataType
    return found.filter("gap is null").select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered conversations that are no snapshot of a longer one."""
    return snapshots.formatted(table(spark, sf_dir, "conversations"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights 1, 2, 3, ... takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four whitened components of every embedding, fitted on the distinct vectors."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that the tampered document would give."""
    return merkle.verified(merkle.documents_manifest(table(spark, sf_dir, "documents"), fanout=8))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest embeddings, by cosine, of every 50th one, from a navigable graph per shard."""
    return hnsw.every_nth(table(spark, sf_dir, "embeddings"), nth=50, nearest=5)


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_language_id": op2_language_id,
    "op3_quality_outliers": op3_quality_outliers,
    "op4_hmm_scoring": op4_hmm_scoring,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_token_lengths": op7_token_lengths,
    "op8_warc": op8_warc,
    "op9_chat_snapshots": op9_chat_snapshots,
    "op10_source_mixing": op10_source_mixing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_FIELD = "coalesce(octet_length(encode(cast({0} as varchar))) || ':' || {0}, '-')"
_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ord(c) as bigint)),
    lambda a, c: list_reduce(range(8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(a, c)), 4294967295))"""


def _levels(name: str, nodes: str) -> str:
    """Levels of a tree above `nodes` (g, i, n, h), siblings of their nodes, as SQL."""
    return f"""
        {name}(l, g, i, n, h) as (
            select 0, g, i, n, h from {nodes}
            union all
            select l + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from {name} where n > 1 group by l, g, i // 8, n
        ),
        {name}_near as (
            select l, g, i,
                coalesce(string_agg(h, '') over (partition by l, g, i // 8 order by i rows between unbounded preceding and 1 preceding), '') as b,
                coalesce(string_agg(h, '') over (partition by l, g, i // 8 order by i rows between 1 following and unbounded following), '') as a
            from {name} where n > 1
        ),
        {name}_walk(doc_id, l, g, i, x, s) as (
            select doc_id, 0, g, i, x, s from {nodes}_starts
            union all
            select w.doc_id, w.l + 1, w.g, w.i // 8, sha256(b || x || a), s || b || a from {name}_walk w join {name}_near r on w.l = r.l and w.g = r.g and w.i = r.i
        ),
        {name}_ends as (select w.doc_id, w.g, w.x, w.s, u.h from {name}_walk w join {name} u on w.l = u.l and w.g = u.g and w.i = u.i where u.n = 1)"""


ORACLES: dict[str, str] = {
    "op12_merkle_manifest": f"""
        with recursive fields as (
            select doc_id, coalesce('=' || lang, '') as g, text, {_CRC32} % 3 = 0 as struck,
                {_FIELD.format("doc_id")} || {_FIELD.format("source")} || {_FIELD.format("lang")} || {_FIELD.format("n_chars")} as head
            from documents
        ),
        hashed as (
            select doc_id, g, sha256(head || {_FIELD.format("text")}) as h,
                case when struck then sha256(head || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) end as t
            from fields
        ),
        docs as (
            select doc_id, g, h, coalesce(t, h) as x, '' as s, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, count(*) over (partition by g) as n
            from hashed
        ),
        docs_starts as (select doc_id, g, i, x, s from docs),
        {_levels("up", "docs")},
        langs as (select 'all' as g, g as lang, h, row_number() over (order by g) - 1 as i, count(*) over () as n from up where n = 1),
        langs_starts as (select doc_id, langs.g, langs.i, e.x, e.s from up_ends e join langs on e.g = langs.lang),
        {_levels("top", "langs")}
        select d.doc_id, d.h as leaf, u.h as subroot, t.h as root, sha256(t.s) as proof_sha256, t.x as folded_root, t.x = t.h as verified
        from docs d join up_ends u on d.doc_id = u.doc_id join top_ends t on d.doc_id = t.doc_id
    """,
    "op1_benchmark_decontamination": f"""
        with d as (select doc_id, {_ALNUM.format(_LOWER)} as w from documents),
        b as (select item_id, {_ALNUM.format(_LOWER)} as w from benchmark),
        win as (
            select item_id, list_slice(w, i, i + least(13, len(w)) - 1) as x, least(13, len(w)) as k
            from (select item_id, w, unnest(range(1, greatest(2, len(w) - 11))) as i from b where len(w) > 0)
        ),
        sizes as (select distinct k from win),
        grams as (
            select doc_id, i, k, list_slice(w, i, i + k - 1) as x
            from (select doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) as i from d, sizes)
        ),
        found as (select g.doc_id, g.i, g.k, win.item_id from grams g join win on g.k = win.k and g.x = win.x),
        hits as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from found) group by doc_id),
        items as (
            select doc_id, count(*) as n, string_agg(x, ',' order by x) as x
            from (select distinct doc_id, cast(item_id as varchar) as x from found) group by doc_id
        )
        select d.doc_id, len(w) as n_words, coalesce(hits.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
            sha256(coalesce(items.x, '')) as items_sha256,
            coalesce(hits.n, 0) > 0 and 20 * coalesce(hits.n, 0) >= len(w) as contaminated
        from d left join hits using (doc_id) left join items using (doc_id)
    """,
    "op6_minhash_dedup": f"""
        with recursive w as (select doc_id, {_WORDS.format(_LOWER)} as w from documents),
        s as (
            select doc_id, list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                else w end) as s from w
        ),
        e as (select doc_id, len(s) as n, unnest(s) as x from s),
        link as (
            select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ),
        reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
        comp as (select a, min(b) as b from reach group by a)
        select doc_id, len(s) as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id,
            doc_id = least(doc_id, coalesce(b, doc_id)) as kept
        from s left join comp on a = doc_id
    """,
    "op9_chat_snapshots": """
        with s as (
            select conv_id, list(struct_pack(r := role, x := text) order by turn nulls first, role nulls first, text nulls first) as t
            from conversations where conv_id is not null group by conv_id
        )
        select conv_id, 0 as part, len(t) as n_turns,
            array_to_string(list_transform(t, lambda v: '<|' || coalesce(v.r, 'unknown') || '|>' || chr(10) || coalesce(v.x, '') || chr(10)), '') as text
        from s where not exists (
            select 1 from s o where o.conv_id <> s.conv_id and o.t[1:len(s.t)] = s.t and (len(o.t) > len(s.t) or o.conv_id < s.conv_id)
        )
    """,
    "op8_warc": """
        with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x, min(page_id) over (partition by coalesce(html, '')) as m from pages)
        select page_id, octet_length(encode(h)) as payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + cast((cast('0x' || substr(x, cast((i // 4) * 5 + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint), 1)), '') as payload_digest,
            case when m is null or m is not distinct from page_id then 'response' else 'revisit' end as record_type,
            case when m is distinct from page_id then m end as refers_to
        from p
    """,
}
