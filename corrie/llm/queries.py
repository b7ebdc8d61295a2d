"""One query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corrie.llm import filter_audit, lines, media, neighbours, packing, passages, phrases, pieces, pii, quality, simhash, token_counts, toxicity
from corrie.llm.common import prepare, table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return lines.dedup_lines(docs).select("doc_id", "text", "n_chars")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.pii_digest(pii.pii_spans(table(spark, sf_dir, "documents")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return media.media_digest(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pieces.piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.score(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return passages.cut_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op5, which SQL can express."""
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express; the checksum is that of the bytes read back."""
    return op6_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_neighbours, op2_token_counts, op3_lines, op4_packing, op5_pii, op6_media, op7_simhash, op8_pieces, op9_toxicity, op10_quality, op11_filter_audit, op12_passages, op13_phrases, pii_base, media_payload)}

DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
LUHN = "list_sum(list_transform(range(len(d)), lambda i: (case when i % 2 = 0 then ascii(d[len(d) - i]) - 48 else (ascii(d[len(d) - i]) - 48) * 2 - (case when ascii(d[len(d) - i]) > 52 then 9 else 0 end) end))) % 10 = 0"

#: DuckDB SQL for those queries that it can express.
ORACLES: dict[str, str] = {
    "pii_base": "with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents), "
    r"ip as (select r, unnest(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')) as x from t), "
    r"card as (select r, " + DIGITS + r" as d from (select r, unnest(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+')) as x from t)), "
    r"phone as (select r, " + DIGITS + r" as d from (select r, unnest(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]')) as x from t)), "
    "found as (select r, 1 as ip, 0 as card, 0 as phone from ip where len(list_filter(string_split(x, '.'), lambda y: coalesce(try_cast(y as hugeint), 256) > 255)) = 0 "
    "union all select r, 0, 1, 0 from card where len(d) between 14 and 19 and " + LUHN + " union all select r, 0, 0, 1 from phone where len(d) between 10 and 15), "
    "n as (select r, sum(ip) as ip, sum(card) as card, sum(phone) as phone from found group by r) "
    r"select t.doc_id, len(regexp_extract_all(t.text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::bigint as n_email, coalesce(n.ip, 0)::bigint as n_ip, coalesce(n.card, 0)::bigint as n_card, coalesce(n.phone, 0)::bigint as n_phone from t left join n on n.r = t.r",
    "media_payload": "with t as (select doc_id, encode(coalesce(text, '')) as b from documents), s as (select *, octet_length(b)::bigint as n, greatest(1, (octet_length(b) + 575) // 576)::bigint * 576 as m from t) "
    "select doc_id, n as n_bytes, m as payload_bytes, sha256(b || unhex(repeat('FF', (m - n)::int))) as payload_sha256 from s",
    "op11_filter_audit": "with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents), "
    r"w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first_id from t), "
    r"m as (select doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] as bits from w), "
    "l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id), "
    "c as (select m.part, m.bits, count(*) as n, count(*) filter (where l.good) as good, count(*) filter (where l.toxic) as toxic from m left join l on l.doc_id = m.doc_id group by m.part, m.bits), "
    "x(k, a) as (values (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')), "
    "o as (select p.a || q.a || r.a || s.a || t.a as filter_order, [p.k, q.k, r.k, s.k, t.k] as ks from x p, x q, x r, x s, x t where len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5), "
    "e as (select c.part, o.filter_order, i.step, o.ks[i.step] as k, c.n, c.good, c.toxic, list_contains(list_transform(o.ks[1:i.step - 1], lambda y: c.bits[y]), true) as gone, c.bits[o.ks[i.step]] as fails, len(list_filter(c.bits, lambda y: y)) as f from c, o, (select unnest(range(1, 6))::int as step) i), "
    "g as (select part, filter_order, step, any_value(k) as k, coalesce(sum(n) filter (where not gone and not fails), 0)::bigint as kept, coalesce(sum(n) filter (where not gone and fails), 0)::bigint as removed, coalesce(sum(n) filter (where gone and fails), 0)::bigint as redundant, "
    "coalesce(sum(n) filter (where fails and f = 1), 0)::bigint as unique_fails, coalesce(sum(good) filter (where not gone and fails), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where not gone and fails), 0)::bigint as toxic_lost from e group by all) "
    "select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, k))::bigint as shapley from g",
    "op13_phrases": r"with t as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents), "
    "u as (select row_number() over () as piece, lang, w from t where len(w) > 0), v as (select piece, lang, unnest(w) as w, generate_subscripts(w, 1) as i from u), "
    "n as (select lang, count(*)::bigint as n from v group by lang), "
    "g as (select lang, w as w1, lead(w, 1) over p as w2, lead(w, 2) over p as w3, lead(w, 3) over p as w4 from v window p as (partition by piece order by i)), "
    "p4 as (select lang, w1 as phrase, 1 as k from g union all select lang, w1 || ' ' || w2, 2 from g union all select lang, w1 || ' ' || w2 || ' ' || w3, 3 from g union all select lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 from g), "
    "f as materialized (select lang, k, phrase, count(*)::bigint as f from p4 where phrase is not null group by all having count(*) >= 30), "
    "c as (select *, string_split(phrase, ' ') as w from f where k > 1), "
    "halves as materialized (select c.lang, c.phrase, c.f as a, j, array_to_string(c.w[1:j], ' ') as one, array_to_string(c.w[j + 1:], ' ') as two from c, (select unnest([1, 2, 3]) as j) where j < c.k), "
    "cut as (select h.lang, h.phrase, h.a, h.j, x.f as l, y.f as r, (2000000::hugeint * h.a) // (x.f + y.f)::hugeint as score from halves h join f x on x.lang = h.lang and x.phrase = h.one join f y on y.lang = h.lang and y.phrase = h.two), "
    "low as (select lang, phrase, a, arg_min((l, r, score), (score, j)) as s from cut group by all), "
    "sub as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(f) as holds from c, (select unnest([1, 2, 3]) as i), (select unnest([2, 3]) as m) where m < k and i + m - 1 <= k group by all), "
    "z as (select low.lang, low.phrase, a, s[1] as l, s[2] as r, n.n, s[3]::bigint as score from low join n on n.lang = low.lang left join sub on sub.lang = low.lang and sub.phrase = low.phrase where coalesce(100::hugeint * holds < 80::hugeint * a, true)) "
    "select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z) where rank <= 2000",
}
