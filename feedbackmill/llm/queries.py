"""The queries of this subpackage and, where SQL can express them, their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedbackmill.llm import (
    ann, chat, conversation_trie, decontaminate, exact, langid, packing, pii, simhash, token_files, toxicity, warc, whitening,
)
from feedbackmill.llm.common import held_out
from feedbackmill.sources.sample_tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns or ("doc_id", "text"))


@query
def op1_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


# A conversation of control strings of another format, besides those of the table.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string"
    )
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat.conversation_digest(turns.unionByName(tricky), path, public_tokenizers.PATTERN)


def _escaped_sql(column: str) -> str:
    sql = f"replace({column}, '{chat.ESCAPE}', '{chat.ESCAPE * 2}')"
    for control in chat.CONTROL:
        sql = f"replace({sql}, '{control}', '{control[0]}{chat.ESCAPE}{control[1:]}')"
    return sql


ORACLES["op2_chat_format"] = f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, md5(text))) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, md5(text)) filter (role = 'assistant'), '')) as loss_sha256,
       cast({len(chat.MARKS[0])} + sum({sum(map(len, chat.MARKS[1:]))} + length({_escaped_sql("role")})
            + length({_escaped_sql("text")})) as bigint) as formatted_chars
from turns group by conv_id
"""


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_copies(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", "offending"
    )


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(documents(spark, sf_dir), word_tokenizer(), end_id=2)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), word_tokenizer(), capacity=2048, end_id=0)
    return packing.pack_pieces(pieces, capacity=2048)


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = langid.train(documents(spark, sf_dir, "doc_id", "text", "lang"))
    return langid.predict_language(documents(spark, sf_dir), net).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


@query
def op9_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc_packages"] = f"""
with pages as (
    select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages
), same as (
    select *, payload_bytes >= {warc.SHARED_BYTES} and page_id <> max(page_id) over (partition by html) as again,
           max(page_id) over (partition by html) as original
    from pages
)
select page_id, payload_bytes, sha1(html) as payload_digest,
       case when again then 'revisit' else 'response' end as record_type,
       case when again then original end as refers_to
from same
"""


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    counts = [pii.count_kind("base", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir), hash_unique=True)


ORACLES["op11_exact_dedup"] = r"""
with rows as (
    select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       row_number() over (partition by text_sha256 order by doc_id nulls last) = 1 as kept, text_sha256
from rows window same as (partition by text_sha256)
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_trie.prefix_nodes(spark, turns)


# Unsigned crc32 of an id's digits, bit by bit.
_CRC32_SQL = """xor(4294967295, list_reduce(
    list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
    lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda v, i:
        case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(crc, byte)), 4294967295))"""
ORACLES["op13_conversation_trie"] = f"""
with recursive own as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as pos
    from conversations where conv_id is not null
), convs as (
    select conv_id, conv_id - conv_id % 20 as base, {_CRC32_SQL} % 4 as h from (select distinct conv_id from own)
), said as (
    select c.conv_id, o.pos, o.role, o.text from convs c join own o on o.conv_id = c.base and o.pos < c.h
    union all select c.conv_id, o.pos, o.role, o.text from convs c join own o on o.conv_id = c.conv_id and o.pos >= c.h
), turns as (
    select *, row_number() over (partition by conv_id order by pos) as depth,
           len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words
    from said
), paths as (
    select conv_id, 0 as depth, '' as node, '' as above, 0 as words from convs
    union all
    select p.conv_id, p.depth + 1, md5(p.node || md5(t.role) || md5(t.text)), p.node, t.words
    from paths p join turns t on t.conv_id = p.conv_id and t.depth = p.depth + 1
), nodes as (
    select node, min(depth) as depth, min(above) as above, min(words) as words, min(conv_id) as conv_id, count(*) as n_convs
    from paths group by node
), lasts as (
    select conv_id, max(depth) as depth from paths group by conv_id
), ended as (
    select p.node, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
    from paths p join lasts using (conv_id, depth) group by p.node
), children as (
    select above as node, count(*) as n from nodes where depth > 0 group by above
), below as (
    select u.node, v.node as lower from paths u join paths v on u.conv_id = v.conv_id and u.depth <= v.depth group by all
), sums as (
    select b.node, sum((v.n_convs - 1) * v.words) as saved, count(*) filter (c.n is null) as leaves
    from below b join nodes v on v.node = b.lower left join children c on c.node = v.node group by b.node
)
select n.conv_id, cast(n.depth as bigint) as depth, case when n.depth > 0 then a.conv_id end as parent_conv_id, n.n_convs,
       coalesce(c.n, 0) as n_children, s.leaves as n_leaves, cast(s.saved as bigint) as saved_tokens,
       sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join sums s using (node) left join children c using (node) left join ended e using (node)
left join nodes a on a.node = n.above
"""
