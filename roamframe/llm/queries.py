"""One query per operator, over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roamframe.llm.columns import prepare, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.exact_dedup import exact_dedup

    prepare(spark)
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.warc import warc_round_trip

    prepare(spark)
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.parity_join import parity_join

    prepare(spark)
    return parity_join(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.decontaminate import contaminated

    prepare(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.pieces import piece_round_trip

    prepare(spark)
    return piece_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.token_counts import token_counts

    prepare(spark)
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.suffixes import without_repeats

    prepare(spark)
    return without_repeats(table(spark, sf_dir, "documents"))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.ring import ring_shards

    prepare(spark)
    return ring_shards(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.toxicity import fit, toxicity

    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.personal_data import fit, personal_data

    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, fit(docs))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.merkle import manifest_check

    prepare(spark)
    return manifest_check(table(spark, sf_dir, "documents"))


def op12_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.chat_tree import chat_round_trip

    prepare(spark)
    return chat_round_trip(table(spark, sf_dir, "conversations"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamframe.llm.repair import damaged_and_repaired

    prepare(spark)
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc": op2_warc,
    "op3_parity_join": op3_parity_join,
    "op4_decontaminate": op4_decontaminate,
    "op5_pieces": op5_pieces,
    "op6_token_counts": op6_token_counts,
    "op7_repeats": op7_repeats,
    "op8_ring_shards": op8_ring_shards,
    "op9_toxicity": op9_toxicity,
    "op10_personal_data": op10_personal_data,
    "op11_merkle": op11_merkle,
    "op12_chat_tree": op12_chat_tree,
    "op13_repair": op13_repair,
}

#: Unsigned CRC-32 of a short ASCII text in SQL: the table of all bytes, then one step per character.
CRC_TABLE = """
crc_table as (
    select list(list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, s:
        case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as crc_of
    from (select unnest(range(256)) as n)
)
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of the SQL expression ``text``, where ``crc_of`` of ``CRC_TABLE`` is in reach."""
    codes = f"list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as bigint))"
    step = "xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {codes}), lambda c, b: {step}), 4294967295)"


ORACLE = {
    "op1_exact_dedup": r"""
with t as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (
    select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm
)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256,
       cast(octet_length(encode(t.norm)) as bigint) as n_bytes
from t join g on g.norm = t.norm
""",
    "op2_warc": r"""
with p as (
    select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes,
           sha256(coalesce(html, '')) as payload_digest
    from pages
), f as (
    select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest
)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when p.page_id <> f.first then 'revisit' else 'response' end as record_type,
       case when p.page_id <> f.first then f.first end as refers_to
from p left join f on f.payload_digest = p.payload_digest
""",
    "op11_merkle": f"""
with recursive {CRC_TABLE},
docs as (
    select doc_id, lang, n_chars,
           coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-')
           || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') as front,
           coalesce(octet_length(encode(text)) || ':' || text, '-') as back,
           coalesce({crc32_sql("cast(doc_id as varchar)")} % 7 = 0, false) as tampered
    from documents, crc_table
), leaves as (
    select doc_id, lang, sha256(front || coalesce(length(cast(n_chars as varchar)) || ':' || n_chars, '-') || back) as leaf,
           sha256(front || coalesce(length(cast(n_chars + tampered::int as varchar)) || ':' || (n_chars + tampered::int), '-') || back) as seen
    from docs
), placed as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
           dense_rank() over (order by encode(lang) nulls first) - 1 as tree
    from leaves
), nodes as (
    select tree, 0 as lvl, pos, leaf as d, count(*) over (partition by tree) as n from placed
    union all
    select tree, lvl + 1, pos // 2, sha256(string_agg(d, '' order by pos)), (n + 1) // 2
    from nodes where n > 1 group by tree, lvl, pos // 2, n
), tops as (
    select tree as pos, 0 as lvl, d, count(*) over () as n from nodes where n = 1
    union all
    select pos // 2, lvl + 1, sha256(string_agg(d, '' order by pos)), (n + 1) // 2 from tops where n > 1 group by lvl, pos // 2, n
), depths as (
    select tree, max(lvl) as up from nodes group by tree
), every_node as (
    select tree, lvl, pos, d, n from nodes where n > 1
    union all
    select depths.tree, depths.up + tops.lvl, tops.pos, tops.d, tops.n from tops, depths
), walk as (
    select doc_id, pos as leaf_pos, tree, 0 as lvl, pos, leaf, seen as led, '' as proof from placed
    union all
    select w.doc_id, w.leaf_pos, w.tree, w.lvl + 1, p.pos // 2, w.leaf,
           sha256(case when p.pos % 2 = 1 then s.d || w.led else w.led || coalesce(s.d, '') end), w.proof || coalesce(s.d, '')
    from walk w
    join depths using (tree)
    cross join lateral (select case when w.lvl = depths.up then w.tree else w.pos end as pos) p
    join every_node e on e.tree = w.tree and e.lvl = w.lvl and e.pos = p.pos and e.n > 1
    left join every_node s on s.tree = w.tree and s.lvl = w.lvl and s.pos = xor(p.pos, 1)
), ends as (
    select tree, leaf_pos, arg_max(proof, lvl) as proof, arg_max(led, lvl) as folded_root from walk group by all
)
select p.doc_id, p.leaf, u.d as subroot, r.d as root, sha256(e.proof) as proof_sha256, e.folded_root, e.folded_root = r.d as verified
from placed p
join ends e on e.tree = p.tree and e.leaf_pos = p.pos
join nodes u on u.tree = p.tree and u.n = 1
cross join (select d from tops where n = 1) r
""",
    "op12_chat_tree": r"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns as (
    select *, sha256(octet_length(encode(role)) || ':' || role || text) as mark,
           length(regexp_replace(text, '(\\|</?s>|\[/?INST\])', '\\\1', 'g')) as text_size,
           length(regexp_replace(role, '(\\|</?s>|\[/?INST\]|\n)', '\\\1', 'g')) as role_size
    from said
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, mark)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, mark) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(case when role = 'assistant' then text_size + 7 else text_size + role_size + 14 end) as bigint) as formatted_chars
from turns group by conv_id
""",
    "op13_repair": f"""
with recursive {CRC_TABLE},
said as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
    from conversations, crc_table
), broken as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
           case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
           unnest(range(case when kind = 0 then 0 when kind = 3 then 2 else 1 end)) as again
    from said
), marked as (
    select *, dense_rank() over (order by conv_id nulls first) as conv,
           sha256(octet_length(encode(role)) || ':' || role || text) as mark,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
    from broken
), ordered as (
    select *, row_number() over (partition by conv order by turn nulls first, mark, again) as i from marked
), rows_with_fault as (
    select *, case when body = '' then 'blank'
                   when row_number() over (partition by conv, role, text order by i) > 1 then 'duplicate'
                   when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
           lag(left(role, 1)) over (partition by conv order by i) || left(role, 1) as pair
    from ordered
), counted as (
    select conv, conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
           count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
           count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
    from rows_with_fault group by conv, conv_id
), steps as (
    select conv, 0 as i, 0 as q, {{'cost': 0, 'audit': '', 'fixed': cast(null as varchar)}} as best from counted
    union all
    select conv, i, q, min({{'cost': cost, 'audit': audit, 'fixed': fixed}}) from (
        select w.conv, r.i,
               case when e.edit = 'D' then w.q when e.edit = 'K' and left(r.role, 1) = 's' then 1 when w.q = 2 then 3 else 2 end as q,
               w.cost + case e.edit when 'D' then 3 when 'R' then 2 else 0 end
                      + case when r.fault = 'truncated' and e.edit <> 'D' then 1 else 0 end as cost,
               w.audit || e.edit as audit,
               case when e.edit = 'D' then w.fixed
                    else coalesce(w.fixed || chr(10), '') || case when e.edit = 'K' then r.role when w.q = 2 then 'assistant' else 'user' end
                         || ':' || r.text end as fixed
        from (
            select conv, i, case when n = 0 then q when n = 1 then case when q = 2 then 3 else 2 end else 3 end as q,
                   best.cost + 2 * n as cost, best.audit || repeat('I', n) as audit,
                   case when n = 0 then best.fixed else coalesce(best.fixed || chr(10), '')
                       || case when n = 2 then 'user:' || chr(10) || 'assistant:' when q = 2 then 'assistant:' else 'user:' end end as fixed
            from steps, range(3) as inserts(n) where not (n = 2 and q = 2)
        ) w
        join rows_with_fault r on r.conv = w.conv and r.i = w.i + 1
        cross join (select unnest(['D', 'K', 'R']) as edit) e
        where e.edit = 'D' or (r.fault not in ('blank', 'duplicate') and (e.edit = 'R'
              or (left(r.role, 1) = 's' and w.q = 0) or (left(r.role, 1) = 'a' and w.q = 2) or (left(r.role, 1) = 'u' and w.q <> 2)))
    ) group by conv, i, q
), ended as (
    select s.conv, min({{'cost': s.best.cost + 2 * more,
                        'audit': s.best.audit || repeat('I', more),
                        'fixed': case when more = 0 then s.best.fixed else coalesce(s.best.fixed || chr(10), '')
                            || case when more = 2 then 'user:' || chr(10) || 'assistant:' else 'assistant:' end end}}) as best
    from steps s join counted c on c.conv = s.conv and c.n = s.i cross join range(3) as inserts(more)
    where (more = 0 and s.q in (0, 3)) or (more = 1 and s.q = 2) or (more = 2 and s.q <> 2)
    group by s.conv
)
select o.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate,
       coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal, cast(coalesce(e.best.cost, 0) as bigint) as cost,
       coalesce(e.best.audit, '') as audit, sha256(coalesce(e.best.fixed, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id
left join ended e on e.conv = c.conv
""",
}


