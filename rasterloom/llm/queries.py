"""The operators applied to their tables with production parameters, and the SQL that states the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytepairs import encode_documents as encode_byte_pairs
from .htmltext import extract_text
from .minhash import near_duplicates
from .mixing import mix_sources
from .multiindex import near_vectors
from .periodic import periodic_runs
from .quality import score_quality
from .sentencepieces import encode_documents
from .substring import remove_repeats
from .topk import top_k
from .toxicity import score_toxicity
from .turns import damage, repair_conversations
from .warc import page_archive_records


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_labels(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return read(spark, sf_dir, "labels").where(~is_held_out()).select("doc_id", F.col(label).alias("label"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_archive_records(spark, read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10, scale=1024)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read(spark, sf_dir, "documents"), training_labels(spark, sf_dir, "toxic"))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence", "cosines")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), power=0.5, rate=1.0, seed=1)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(read(spark, sf_dir, "documents"), training_labels(spark, sf_dir, "quality"))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(*damage(read(spark, sf_dir, "conversations")))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_byte_pairs(read(spark, sf_dir, "documents"), decode=True, packed=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def rearranged(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word that stands at each of n places: one document in ten repeats a stretch of its words to its end."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return np.append(np.arange(a), a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(read(spark, sf_dir, "documents"), rearranged)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_exact_topk, op3_minhash, op4_substring_dedup, op5_toxicity, op6_sentencepiece, op7_mixing, op8_html_text, op9_near_vectors, op10_quality, op11_conversations, op12_byte_pairs, op13_periodic_runs)}

_REACH = """
  reach as (select id, other from edges union select r.id, e.other from reach r join edges e on r.other = e.id),
  named as (select id, least(id, min(other)) as component_id from reach group by id)
"""

SQL: dict[str, str] = {
    "op1_warc": """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
  g as (select payload_digest, max(page_id) as keep from p where payload_bytes >= 1000 group by payload_digest)
select p.page_id, p.payload_bytes::bigint as payload_bytes, p.payload_digest,
  case when g.keep is not null and p.page_id <> g.keep then 'revisit' else 'response' end as record_type,
  case when p.page_id <> g.keep then g.keep end as refers_to
from p left join g using (payload_digest)""",
    "op2_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings),
  s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score from v q join v d on q.vec_id % 100 = 0 and q.vec_id <> d.vec_id)
select * from (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from s) where rank <= 10""",
    "op3_minhash": rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as x from w),
  n as (select doc_id, count(*) as n from s group by doc_id),
  p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
  links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
  edges as (select a as id, b as other from links union all select b, a from links), {_REACH}
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_id, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join named on named.id = d.doc_id""",
    "op4_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
  t as (select doc_id, w, unnest(range(1, len(w) - 11)) as pos from w),
  x as (select doc_id, pos, md5(array_to_string(w[pos:pos + 12], ' ')) as x from t),
  f as (select x, min(doc_id) as first from x group by x),
  c as (select distinct doc_id, unnest(range(pos, pos + 13)) as pos from x join f using (x) where doc_id > first),
  each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from w),
  k as (select e.doc_id, count(*) as n_words, count(c.pos) as n_removed, string_agg(e.word, ' ' order by e.pos) filter (where c.pos is null) as kept from each e left join c on c.doc_id = e.doc_id and c.pos = e.pos group by e.doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join k using (doc_id)""",
    "op7_mixing": """
with m as (select coalesce(source, '') as s, sum(length(coalesce(text, ''))) as mass from documents group by 1),
  r as (select s, case when mass > 0 then sum(mass) over () * (sqrt(mass) / sum(sqrt(mass)) over ()) / mass else 0 end as rate from m),
  n_of as (select s, rate, unnest(range(0, 30 + cast(ceil(rate + 12 * sqrt(rate)) as bigint))) as j from r),
  t as (select s, j, rate, case when j = 0 then exp(-rate) when rate > 0 then exp(-rate + j * ln(rate) - lgamma(j + 1)) else 0 end as p from n_of),
  cdf as (select s, j, sum(p) over (partition by s order by j) as c from t),
  u as (select *, ('0x' || substr(md5('1:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 as u from documents),
  n as (select u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) as n from u join cdf on cdf.s = coalesce(u.source, '') and cdf.c <= u.u group by all)
select doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::integer as copy from n""",
    "op11_conversations": r"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
  crc as (select key, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(key)), lambda i: ascii(key[i + 1])::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end)) as c from (select distinct key from raw)),
  hurt as (select r.conv_id, r.turn, xor(c.c, 4294967295::bigint) % 20 as kind, r.role, r.text from raw r join crc c using (key)),
  one as (select conv_id, turn, kind, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from hurt where kind <> 0),
  dam as (select conv_id, turn, role, text from one union all select conv_id, turn, role, text from one where kind = 3),
  num as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text)) as n from dam),
  seq as (select *, n > min(n) over (partition by conv_id, role, text) as again, rtrim(text, E' \t\n\x0b\x0c\r') as body from num),
  f as (select conv_id, n, turn, role, text, substr(role, 1, 1) as i, ltrim(body, E' \t\n\x0b\x0c\r') = '' as blank, again, right(body, 1) not in ('.', '!', '?') as cut, lag(substr(role, 1, 1)) over (partition by conv_id order by n) as before from seq),
  g as (select conv_id, n, i, role, text, turn, blank, again and not blank as dup, cut and not blank and not again as tru, case when n > 1 and before || i not in ('su', 'ua', 'au') then 1 else 0 end as bad from f),
  len as (select conv_id, max(n) as len from g group by conv_id),
  back as (select conv_id, len + 1 as n, 0 as c0, 6 as c1, 3 as c2, 0 as c3 from len
    union all select conv_id, n, least(b0, b2 + 3, b3 + 6), least(b1, b2 + 3, b3 + 6), least(b2, b3 + 3), least(b3, b2 + 3) from (
      select g.conv_id, g.n,
        least(b.c0 + 4, case when g.blank or g.dup then 1000000000 else (case when g.tru then 3 else 0 end) + least(b.c2 + 3, case g.i when 's' then b.c1 when 'u' then b.c2 else 1000000000 end) end) as b0,
        least(b.c1 + 4, case when g.blank or g.dup then 1000000000 else (case when g.tru then 3 else 0 end) + least(b.c2 + 3, case g.i when 'u' then b.c2 else 1000000000 end) end) as b1,
        least(b.c2 + 4, case when g.blank or g.dup then 1000000000 else (case when g.tru then 3 else 0 end) + least(b.c3 + 3, case g.i when 'a' then b.c3 else 1000000000 end) end) as b2,
        least(b.c3 + 4, case when g.blank or g.dup then 1000000000 else (case when g.tru then 3 else 0 end) + least(b.c2 + 3, case g.i when 'u' then b.c2 else 1000000000 end) end) as b3
      from back b join g on g.conv_id is not distinct from b.conv_id and g.n = b.n - 1)),
  cost as (select conv_id, n, unnest([0, 1, 2, 3]) as s, unnest([c0, c1, c2, c3]) as c from back),
  opt as (select b.conv_id, b.n, b.s, b.c, g.i, g.role, g.text, g.blank or g.dup as gone, case when g.tru then 3 else 0 end as extra, case when b.s = 2 then 3 else 2 end as nx,
      case when g.i = 's' and b.s = 0 then 1 when g.i = 'u' and b.s <> 2 then 2 when g.i = 'a' and b.s = 2 then 3 end as kp from cost b left join g on g.conv_id is not distinct from b.conv_id and g.n = b.n),
  step as (select o.*, case when o.i is not null and d.c + 4 = o.c then 'D' when ins.c + 3 = o.c then 'I' when o.i is not null and not gone and kp is not null and k.c + extra = o.c then 'K' when o.i is not null and not gone then 'R' end as e
    from opt o left join cost d on d.conv_id is not distinct from o.conv_id and d.n = o.n + 1 and d.s = o.s left join cost ins on ins.conv_id is not distinct from o.conv_id and ins.n = o.n and ins.s = o.nx
      left join cost k on k.conv_id is not distinct from o.conv_id and k.n = o.n + 1 and k.s = o.kp),
  path as (select conv_id, 1::bigint as n, 0 as s, '' as audit, []::varchar[] as said from len
    union all select p.conv_id, case when t.e = 'I' then p.n else p.n + 1 end, case t.e when 'D' then p.s when 'K' then t.kp else t.nx end, p.audit || t.e,
      case t.e when 'D' then p.said when 'K' then list_append(p.said, t.role || ':' || t.text) else list_append(p.said, (case t.nx when 2 then 'user:' else 'assistant:' end) || case t.e when 'R' then t.text else '' end) end
    from path p join step t on t.conv_id is not distinct from p.conv_id and t.n = p.n and t.s = p.s where t.e is not null),
  fin as (select conv_id, arg_max(audit, length(audit)) as audit, arg_max(said, length(audit)) as said from path group by conv_id),
  sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (tru) as truncated, sum(bad) as illegal from g group by conv_id)
select o.conv_id, coalesce(s.gaps, 0)::bigint as gaps, coalesce(s.blank, 0)::bigint as blank, coalesce(s.duplicate, 0)::bigint as duplicate, coalesce(s.truncated, 0)::bigint as truncated, coalesce(s.illegal, 0)::bigint as illegal,
  coalesce(b.c0, 0)::bigint as cost, coalesce(f.audit, '') as audit, sha256(coalesce(array_to_string(f.said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join sums s on s.conv_id is not distinct from o.conv_id left join fin f on f.conv_id is not distinct from o.conv_id left join back b on b.conv_id is not distinct from o.conv_id and b.n = 1""",
    "op9_near_vectors": f"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
  ok as (select vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from v where v is not null and list_inner_product(v, v) > 0),
  edges as (select a.vec_id as id, b.vec_id as other from ok a join ok b on a.vec_id <> b.vec_id where list_inner_product(a.v, b.v) >= 0.95), {_REACH}
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, coalesce(component_id, e.vec_id) as component_id, coalesce(component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join (select id, count(*) as n from edges group by id) c on c.id = e.vec_id left join named on named.id = e.vec_id""",
    "op13_periodic_runs": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, doc_id::varchar as key from documents),
  crc as (select doc_id, w, len(w) as n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(key)), lambda i: ascii(key[i + 1])::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end)), 4294967295::bigint) as h from w),
  g as (select doc_id, w, n, h % 10 = 0 and n > 0 as moved, case when n > 0 then (h // 10) % n else 0 end as a, h // 10 as g from crc),
  p as (select *, 1 + (n - a) // (3 + g % 8) as p from g),
  each as (select doc_id, n, i, case when moved and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end as word from (select doc_id, w, n, moved, a, p, unnest(range(0, n)) as i from p)),
  pair as (select x.doc_id, y.i - x.i as q, x.i from each x join each y on y.doc_id = x.doc_id and y.word = x.word and y.i > x.i and 3 * (y.i - x.i) <= x.n),
  isle as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from pair),
  long_ as (select doc_id, q, min(i) as start, count(*) + q as length from isle group by doc_id, q, k having count(*) + q >= greatest(24, 3 * q)),
  run as (select doc_id, start, length, min(q) as period from long_ group by doc_id, start, length),
  best as (select * from (select *, row_number() over (partition by doc_id order by length / period desc, start, period) as r from run) where r = 1),
  told as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed from run group by doc_id),
  gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
  kept as (select e.doc_id, string_agg(e.word, ' ' order by e.i) as kept from each e left join gone o on o.doc_id = e.doc_id and o.i = e.i where o.i is null group by e.doc_id)
select d.doc_id, coalesce(t.n_runs, 0)::bigint as n_runs, b.start::bigint as start, b.length::bigint as length, b.period::bigint as period, (1000 * b.length // b.period)::bigint as exponent_milli,
  sha256(coalesce(t.listed, '')) as runs_sha256, sha256(coalesce(k.kept, '')) as collapsed_sha256
from documents d left join told t on t.doc_id = d.doc_id left join best b on b.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id""",
}
