"""The queries of this subpackage and the SQL that DuckDB can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vidlake.llm.centroids import clusters_with_digests
from vidlake.llm.chat import render
from vidlake.llm.decontaminate import find_contamination
from vidlake.llm.fixity import audit
from vidlake.llm.linededup import dedup_lines
from vidlake.llm.ngramjoin import ngram_join
from vidlake.llm.packing import pack
from vidlake.llm.passages import repeated_passages
from vidlake.llm.pieces import encoded_and_decoded
from vidlake.llm.pii import replace_pii
from vidlake.llm.quality import judge
from vidlake.llm.repair import damaged, repair_report
from vidlake.llm.secrets import scan_secrets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


#: Stands in for a secret that a caller would hold.
PII_KEY = "check"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of pages against a replica with damage: bodies changed, and records lost, at set page ids."""
    pages = table(spark, sf_dir, "pages")
    changed = F.when(F.col("page_id") % 97 == 3, F.concat("html", F.lit("\x00"))).otherwise(F.col("html"))
    return audit(pages, pages.where("page_id % 389 <> 11").withColumn("html", changed))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with the set damage, repaired."""
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_decoded(table(spark, sf_dir, "documents"), piece_model_path())


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_with_digests(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_secret_scan": op8_secret_scan,
    "op9_passage_dedup": op9_passage_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_SHINGLES = """
    words as (select doc_id, {words} as w from documents),
    gram as (
        select distinct doc_id, g from (
            select doc_id, unnest(case when len(w) >= 5
                then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
            from words))
""".format(words=_WORDS.format(text=_LOWER))

_NEAREST = """
    far{n} as (select rid, q, c, list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, cent{n}),
    near{n} as (select rid, any_value(q) as q, arg_min(c, (d, c)) as c, min(d) as d from far{n} group by rid)"""
_MOVED = """
    sum{n} as (select c, j, sum(q[j])::bigint as s, count(*) as n from near{n}, range(1, 65) r(j) group by c, j),
    mean{n} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as m from sum{n} group by c),
    cent{m} as (select c, coalesce(mean{n}.m, cent{n}.m) as m from cent{n} left join mean{n} using (c))"""

ORACLE: dict[str, str] = {
    "op13_centroid_clustering": f"""
        with whole as (
            select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where len(embedding) = 64),
        kept as (
            select row_number() over () as rid, vec_id, list_transform(e, lambda x: floor(64 * x)::bigint) as q from whole
            where len(list_filter(e, lambda x: x is not null and isfinite(x))) = 64),
        cent0 as (select (row_number() over (order by sha256('1:' || vec_id), q) - 1)::int as c, q as m from kept
            qualify c < 16),
        {",".join(_NEAREST.format(n=n) + "," + _MOVED.format(n=n, m=n + 1) for n in range(3))},
        {_NEAREST.format(n=3)},
        total as (select c, sum(d)::bigint as ci from near3 group by c)
        select vec_id, c as cluster, d as distance, ci as cluster_inertia, (select sum(d)::bigint from near3) as inertia,
            sha256(array_to_string(m, ',')) as centroid_sha256
        from near3 join kept using (rid) join total using (c) join cent3 using (c)
    """,
    "op1_benchmark_decontamination": f"""
        with {_SHINGLES},
        items as (select distinct item_id, text from benchmark),
        item_words as (select item_id, {_WORDS.format(text=_LOWER)} as w from items),
        item_gram as (
            select distinct item_id, unnest(case when len(w) >= 5
                then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
            from item_words),
        size as (select item_id, count(*) as n from item_gram group by 1)
        select doc_id, item_id, any_value(n)::bigint as n_shingles, count(*)::bigint as n_shared
        from gram join item_gram using (g) join size using (item_id)
        group by doc_id, item_id having count(*) * 100 >= any_value(n) * 80
    """,
    "op3_line_dedup": r"""
        with line as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from documents),
        keyed as (
            select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
            from line),
        often as (select k as often from keyed where length(k) > 0 group by k having count(distinct doc_id) >= 10)
        select doc_id, count(*)::bigint as n_lines, count(often)::bigint as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (often is null), '')) as kept_sha256
        from keyed left join often on k = often group by doc_id
    """,
    "op6_ngram_jaccard_join": f"""
        with recursive {_SHINGLES},
        size as (select doc_id, count(*) as n from gram group by 1),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as i from gram a join gram b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        link as (select a, b from shared join size x on x.doc_id = a join size y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
        reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
        select d.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, least(d.doc_id, min(r.b)) as component_id
        from documents d left join size s on s.doc_id = d.doc_id left join reach r on r.a = d.doc_id
        group by d.doc_id
    """,
    "op5_chat_formatting": """
        with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null and turn is not null),
        c as (select conv_id, list({'turn': turn, 'role': role, 'text': text} order by turn, role, text) as l from t group by 1),
        kept as (
            select conv_id from c a where not exists (
                select 1 from c b where b.conv_id <> a.conv_id and b.l[1:len(a.l)] = a.l and (
                    (len(b.l) > len(a.l) and b.l[len(a.l) + 1].turn > a.l[-1].turn) or (len(b.l) = len(a.l) and b.conv_id < a.conv_id)))),
        said as (
            select conv_id, turn // 64 as block, turn,
                '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as said
            from t where conv_id in (from kept))
        select conv_id, block, min(turn) as first_turn, count(*)::bigint as n_turns, string_agg(said, '' order by turn, said) as text
        from said group by conv_id, block
    """,
    "op7_warc_fixity": """
        with r as (
            select page_id, page_id // 1024 as file, strlen(coalesce(html, '')) as body,
                strlen('WARC/1.0..WARC-Type: response..WARC-Target-URI: ' || coalesce(url, '') || '..Content-Length: ' || strlen(coalesce(html, '')) || '....') as head
            from pages where page_id is not null),
        placed as (
            select page_id, file, (head + body + 4)::bigint as length,
                coalesce(sum(head + body + 4) over (partition by file order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
            from r)
        select page_id, file, "offset", length, case when page_id % 389 = 11 then 'missing' else 'altered' end as status
        from placed where page_id % 389 = 11 or page_id % 97 = 3
    """,
}
