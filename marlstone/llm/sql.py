"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others rest on hashes that DuckDB lacks (XXH64, random vectors), on differencing, or on
matches with their places; the tests hold them against brute force.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
with d as (select doc_id, {_WORDS} w from documents),
 win as (select doc_id, i, array_to_string(w[i:i+12], ' ') s from (select doc_id, w, unnest(range(1, len(w)-11)) i from d where len(w) >= 13)),
 f as (select s, min(doc_id) first from win group by s),
 gone as (select distinct doc_id, unnest(range(i, i+13)) i from win join f using (s) where first < doc_id),
 g as (select doc_id, list(i) gi from gone group by doc_id),
 k as (select doc_id, len(w) n_words, coalesce(len(gi), 0) n_removed, case when gi is null then w else list_transform(list_filter(range(1, len(w)+1), lambda j: not list_contains(gi, j)), lambda j: w[j]) end kept from d left join g using (doc_id))
select doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) kept_sha256 from k
"""

WARC = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
 f as (select payload_digest, min(page_id) first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when first is not null and first <> page_id then 'revisit' else 'response' end record_type,
 case when first is not null and first <> page_id then first end refers_to
from p left join f using (payload_digest)
"""


def line_frequency(least_docs: int, host_share: float, most_removed: float) -> str:
    fold = r"array_to_string(regexp_extract_all(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ')"
    return rf"""
with d as (select doc_id, coalesce(text, '') t, coalesce('s' || source, '') host, {_WORDS} w from documents),
 win as (select doc_id, i, array_to_string(w[i:i+7], ' ') s from (select doc_id, w, unnest(range(1, len(w)-6)) i from d where len(w) >= 8)),
 twice as (select doc_id, s from win group by 1, 2 having count(*) > 1),
 cover as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i+8)) j from win semi join twice using (doc_id, s)) group by 1),
 lines as (select doc_id, host, l, {fold} k, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) n from (select doc_id, host, unnest(string_split(t, chr(10))) l from d)),
 full_lines as (select * from lines where n > 0),
 dup as (select doc_id, count(*) - count(distinct l) n from full_lines group by 1),
 hosts as (select host, count(distinct doc_id) docs from d group by 1),
 bad as (select host, k from full_lines join hosts using (host) group by host, k having count(distinct doc_id) > {least_docs} and count(distinct doc_id) > {host_share} * any_value(docs)),
 removed as (select doc_id, sum(n)::bigint removed_words from full_lines semi join bad using (host, k) group by 1),
 m as (select doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(cover.n, 0) n_repeat_words, coalesce(removed_words, 0) removed_words
  from d left join dup using (doc_id) left join cover using (doc_id) left join removed using (doc_id))
select doc_id, n_words, coalesce(word_chars, 0) word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100*n_repeat_words > 30*n_words base_failed,
 not (n_words < 20 or 100*n_repeat_words > 30*n_words) and removed_words <= {most_removed}*n_words kept, removed_words from m
"""
