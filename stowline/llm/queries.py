"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.llm import (collocations, mixing, near_vectors, neighbours, packing, page_text, pieces, quality,
                          simhash, spelling, token_files, toxicity, urls)
from stowline.llm.common import table
from stowline.sources.staging import staging_root

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]
PIECES, WORD_IDS, END_ID, PACK_END_ID = "piece_bpe_32k.model", "word_bpe_49k.json", 2, 1


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES), keep=("page_id",))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep=("doc_id",))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       pieces.ids_sha256(F.col("ids")).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging_root(spark)}/token-files-{uuid4().hex}"
    tokens = token_files.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_IDS), END_ID)
    token_files.write_ids(tokens, path)
    return token_files.read_ids(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(table(spark, sf_dir, "pages"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.near_neighbours(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_texts(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_IDS), PACK_END_ID).drop("part", "ids")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_pieces, op3_token_files, op4_near_vectors, op5_page_text,
                                   op6_neighbours, op7_simhash, op8_mixing, op9_quality, op10_toxicity,
                                   op11_collocations, op12_spelling, op13_packing, pipeline)}

_OP1 = """
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest
             from pages),
parts as (select page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
    ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (select page_id, host, path, max_by(rhost || rpath, length(rhost) * 100 + length(rpath)) as rule,
    max_by(verdict, length(rhost) * 100 + length(rpath)) as verdict
    from parts left join rules on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath)
    group by page_id, host, path)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from best
"""

_OP8 = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
               from documents),
sources as (select source, sum(size)::bigint as source_size,
    row_number() over (order by source nulls last) as rank from sized group by source),
levels as (select *, 2 * source_size as cap, [3, 1, 2][((rank - 1) % 3 + 1)::int] as w,
    (2 * source_size)::double / [3, 1, 2][((rank - 1) % 3 + 1)::int] as level from sources),
met as (select *, sum(cap) over o as caps, sum(w) over o as ws, 1.5::double * sum(source_size) over () as budget,
    sum(w) over () as all_w from levels window o as (order by level, rank)),
filled as (select *, caps::double + level * (all_w - ws)::double <= budget as full_ from met),
rest as (select coalesce(sum(cap) filter (full_), 0)::double as caps, coalesce(sum(w) filter (full_), 0) as ws from filled),
goals as (select source, rank, source_size, case when full_ then cap::double
    else (budget - rest.caps) / (all_w - rest.ws)::double * w end as target, budget from filled, rest),
offered as (select doc_id, size, rank, source_size, target, budget, md5('mix:' || coalesce(doc_id::varchar, '')) as turn,
    sum(size) over (partition by rank order by md5('mix:' || coalesce(doc_id::varchar, '')), doc_id, size
                    rows unbounded preceding) as offered
    from sized join goals on sized.source is not distinct from goals.source),
items as (select *, (again * source_size + offered)::double / target as finish from offered, (values (0), (1)) r(again)
    where target > 0),
served as (select *, sum(size) over (order by finish, rank, turn, doc_id, size, again rows unbounded preceding) as served
    from items),
taken as (select rank, turn, doc_id, size, count(*) as copies from served where served <= budget group by all)
select o.doc_id, o.size, o.source_size, o.target, (coalesce(t.copies, 0) * o.size)::bigint as taken
from offered o left join taken t on o.doc_id = t.doc_id and o.rank = t.rank and o.size = t.size
"""

_OP11 = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
parted as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
grams as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2),
    lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from parted, range(1, 6) t(k)),
f as (select lang, k, phrase, count(*)::bigint as a from grams group by all),
lengths as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
candidates as (select * from f where k >= 2 and a >= 100),
kept as (select * from candidates c where not exists (select 1 from candidates o where o.lang = c.lang and o.k > c.k
    and 100 * o.a >= 100 * c.a and contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts as (select kept.lang, kept.phrase, kept.a, n, cut, hd.a as l, rs.a as r,
    (1000::hugeint * kept.a * n) // (hd.a::hugeint * rs.a) as score
    from kept join lengths using (lang), range(1, 5) t(cut), f hd, f rs
    where cut < kept.k and hd.lang = kept.lang and rs.lang = kept.lang
    and hd.phrase = array_to_string(string_split(kept.phrase, ' ')[:cut], ' ')
    and rs.phrase = array_to_string(string_split(kept.phrase, ' ')[cut + 1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n,
    score::bigint as score
from best qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""

ORACLE = {"op11_collocations": _OP11, "op1_url_filter": _OP1, "op8_mixing": _OP8}
