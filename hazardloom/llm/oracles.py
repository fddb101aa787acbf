"""SQL for the queries of this folder that SQL can express, on the given tables."""

from __future__ import annotations

from .quality_rules import MAX_DOCS, MIN_LEFT
from .shared import UPPER
from .suffix_dedup import LEAST

_BLANKS = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '')"
_TOKENS = (
    f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

ORACLES: dict[str, str] = {}

ORACLES["op1_line_frequency"] = f"""
with d as (select row_number() over () r, doc_id, source, coalesce(text, '') t, md5(coalesce(text, '')) k, {_WORDS} w from documents),
tok as (select r, unnest(w) word, generate_subscripts(w, 1) p from d),
win as (select r, p, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o g from tok window o as (partition by r order by p)),
rep as (select r, p from (select r, p, count(*) over (partition by r, g) c from win where g is not null) where c > 1),
cov as (select r, count(distinct q) n_repeat from (select r, unnest([p, p + 1, p + 2]) q from rep) group by r),
line as (select r, unnest(string_split(t, chr(10))) x from d),
own as (select r, x from line where regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
dup as (select r, count(*) - count(distinct x) n_dup from own group by r),
norm as (
    select r, len(lw) n, lower(array_to_string(lw, ' ')) y
    from (select r, list_filter(regexp_split_to_array(x, '{_BLANKS}'), lambda v: v <> '') lw from own)
),
freq as (select source, y from norm join d using (r) group by source, y having count(distinct k) > {MAX_DOCS}),
gone as (
    select norm.r, sum(n) gone from norm join d using (r)
    join freq on norm.y = freq.y and d.source is not distinct from freq.source group by norm.r
),
base as (
    select r, doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
        coalesce(n_dup, 0)::bigint n_dup_lines, coalesce(n_repeat, 0)::bigint n_repeat_words,
        (len(w) - coalesce(gone, 0))::bigint words_left
    from d left join dup using (r) left join cov using (r) left join gone using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, words_left,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and words_left >= {MIN_LEFT} * n_words kept
from base
"""

ORACLES["op4_prefix_decontamination"] = f"""
with d as (select row_number() over () r, doc_id, {_TOKENS} w from documents),
b as (select item_id, {_TOKENS} w from benchmark),
item as (
    select distinct item_id, m, list_slice(w, i, i + m - 1) g
    from (select item_id, w, least(13, len(w)) m, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from b where len(w) > 0)
),
size as (select distinct m from item),
win as (
    select r, i, m, list_slice(w, i, i + m - 1) g
    from (select r, w, m, unnest(range(1, len(w) - m + 2)) i from d, size where len(w) >= m)
),
hit as (select distinct r, i, item.m, item_id from win join item using (g)),
n as (select r, count(distinct q) n_hit from (select r, unnest(range(i, i + m)) q from hit) group by r),
ids as (
    select r, count(*) n_items, sha256(string_agg(x, ',' order by x)) digest
    from (select distinct r, item_id::varchar x from hit) group by r
)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
    coalesce(digest, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join n using (r) left join ids using (r)
"""

ORACLES["op5_url_rules"] = f"""
with u as (
    select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages
),
p as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u
),
rules(rh, rp, action) as (
    values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
best as (
    select page_id, host, path, arg_max(rh || rp, length(rh || rp)) rule, arg_max(action, length(rh || rp)) verdict
    from p left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
    group by page_id, host, path
)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from best
"""

ORACLES["op6_warc_salvage"] = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d from pages),
owner as (select d, max(page_id) owner, count(*) c from p where n >= 1000 group by d)
select page_id, n::bigint payload_bytes, p.d payload_digest,
    case when c > 1 and page_id <> owner then 'revisit' else 'response' end record_type,
    case when c > 1 and page_id <> owner then owner end refers_to
from p left join owner on p.d = owner.d
"""

ORACLES["op7_bagminhash"] = f"""
with recursive d as (select row_number() over () r, doc_id, text, {_WORDS} w from documents),
distinct_text as (select min(r) node, text, any_value(w) w from d where len(w) > 0 group by text),
runs as (
    select node, case when len(w) < 5 then w else list_slice(w, i, i + 4) end s
    from (select node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from distinct_text)
),
bag as (select node, s, count(*) c from runs group by node, s),
total as (select node, sum(c) n from bag group by node),
common as (
    select x.node a, y.node b, sum(least(x.c, y.c)) k from bag x join bag y on x.s = y.s and x.node < y.node group by 1, 2
),
link as (
    select a, b from common join total ta on ta.node = a join total tb on tb.node = b where k >= 0.8 * (ta.n + tb.n - k)
),
both_ways as (select a, b from link union all select b, a from link),
reach as (select node, node other from distinct_text union select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a),
label as (select node, min(other) label from reach group by node),
member as (select d.r, d.doc_id, label from d left join distinct_text using (text) left join label using (node)),
class as (select label, min(doc_id) class_id, count(*) class_docs from member where label is not null group by label)
select doc_id, coalesce(class_id, doc_id) class_id, coalesce(class_docs, 1)::bigint class_docs
from member left join class using (label)
"""

ORACLES["op8_sparse_suffixes"] = f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t, {_WORDS} w from documents),
distinct_text as (select min(r) node, t, any_value(w) w, count(*) copies from d group by t),
win as (
    select node, i, list_slice(w, i + 1, i + {LEAST}) g
    from (select node, w, unnest(range(0, len(w) - {LEAST - 1})) i from distinct_text where len(w) >= {LEAST})
),
shared as (select g from win group by g having count(distinct node) > 1),
hit as (select node, i from win join shared using (g)),
edge as (select node, i, case when i > lag(i) over (partition by node order by i) + {LEAST} then 1 when lag(i) over (partition by node order by i) is null then 1 else 0 end fresh from hit),
island as (select node, i, sum(fresh) over (partition by node order by i) k from edge),
part as (select node, min(i) s, max(i) + {LEAST} e from island group by node, k),
span as (
    select node, s, e from part where node not in (select node from distinct_text where copies > 1)
    union all select node, 0, len(w) from distinct_text where copies > 1 and len(w) >= {LEAST}
)
select doc_id, s::bigint start_word, e::bigint end_word, (e - s)::bigint n_words
from d join distinct_text using (t) join span using (node)
"""

# ids rewritten as the query has it; runs from all pairs of equal least seeds at distances up to a quarter of the text
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), "
    "lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"
)
ORACLES["op11_kruskal_runs"] = f"""
with d as (select row_number() over () r, doc_id, {_WORDS} w, {_CRC} h from documents),
a as (select *, len(w) n, (h // 10) % greatest(len(w), 1) a0, h // 10 g from d),
b as (select *, 1 + (n - a0) // (3 + g % 8) p from a),
v as (
    select r, doc_id, n, case when h % 10 = 0 and n > 0
        then list_transform(range(n), lambda i: w[1 + case when i < a0 then i else a0 + (i - a0) % p end]) else w end w
    from b
),
tok as (select r, n, unnest(w) x, generate_subscripts(w, 1) - 1 i from v),
gram as (
    select r, n, i, concat_ws(' ', x, lead(x) over o, lead(x, 2) over o, lead(x, 3) over o, lead(x, 4) over o) y
    from tok window o as (partition by r order by i) qualify lead(x, 4) over o is not null
),
pair as (select s.r, s.i, t.i - s.i q from gram s join gram t on s.r = t.r and s.y = t.y and t.i > s.i and 4 * (t.i - s.i) <= s.n),
stretch as (
    select r, q, min(i) start, count(*) + 4 + q length
    from (select *, i - row_number() over (partition by r, q order by i) z from pair) group by r, q, z
),
long as (select * from stretch where length >= greatest(6, 4 * q)),
run as (
    select r, start, length, q period from long x
    where not exists (from long y where y.r = x.r and y.q < x.q and y.start <= x.start and y.start + y.length >= x.start + x.length)
),
dropped as (select distinct r, i from (select r, unnest(range(start + period, start + length)) i from run)),
kept as (select r, string_agg(x, ' ' order by i) t from tok anti join dropped using (r, i) group by r),
per as (
    select r, count(*) n_runs, string_agg(concat_ws(',', start, length, period) || chr(10), '' order by start, period) listed,
        list(row(start, length, period) order by (length::double / period) desc, start, period)[1] best
    from run group by r
)
select doc_id, coalesce(n_runs, 0) n_runs, best[1] start, best[2] length, best[3] period, 1000 * best[2] // best[3] exponent_milli,
    sha256(coalesce(listed, '')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256, n::bigint n_words
from v left join per using (r) left join kept using (r)
"""


def _codebook_rounds(rounds: int) -> str:
    """Nearest entries by full comparison, then floored means; once more for the final codes."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
n{i} as (
    select r, p, any_value(x) x, min(row(d, e)) best
    from (
        select r, part.p, e, part.x,
            list_sum(list_transform(range(1, len(part.x) + 1), lambda j: (part.x[j] - b.x[j]) * (part.x[j] - b.x[j])))::bigint d
        from part join b{i} b on b.p = part.p
    ) group by r, p
),""")
        if i < rounds:
            steps.append(f"""
m{i} as (select p, best[2] e, j, sum(x[j])::bigint s, count(*) c from n{i}, (select unnest(range(1, 5)) j) group by p, best[2], j),
f{i} as (select p, e, list((s - ((s % c) + c) % c) // c order by j) x from m{i} group by p, e),
b{i + 1} as (select p, e, coalesce(f{i}.x, b{i}.x) x from b{i} left join f{i} using (p, e)),""")
    return "".join(steps)


ORACLES["op12_orchard_codes"] = f"""
with k as (
    select row_number() over () r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
part as (select r, p, v[4 * p + 1:4 * p + 4] x from k, (select unnest(range(16)) p)),
lead64 as (select r, row_number() over (order by vec_id) - 1 e from k qualify e < 64),
b0 as (select p, e, x from part join lead64 using (r)),{_codebook_rounds(2)}
coded as (select r, string_agg(printf('%02x', best[2]), '' order by p) code, sum(best[1])::bigint error from n2 group by r),
book as (select sha256(string_agg(y, ',' order by p, e, j)) s from (select p, e, unnest(x)::varchar y, generate_subscripts(x, 1) j from b2))
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, s codebooks_sha256
from k join coded using (r), book
"""

# the given pages have one article element each; its blocks by pattern
_DECODED = "x"
for _name, _char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")]:
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"
ORACLES["op13_tree_extract"] = f"""
with a as (select row_number() over () r, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) h from pages),
b as (select r, unnest(regexp_split_to_array(h, '</?(p|h1)>')) x, generate_subscripts(regexp_split_to_array(h, '</?(p|h1)>'), 1) i from a),
c as (select r, i, {_DECODED} x from (select r, i, regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g') x from b)),
d as (select r, i, trim(regexp_replace(x, '\\s+', ' ', 'g')) x from c),
t as (select r, string_agg(x, chr(10) || chr(10) order by i) x from d where x <> '' group by r)
select page_id, url, coalesce(x, '') text, length(coalesce(x, ''))::bigint n_chars from a left join t using (r)
"""
