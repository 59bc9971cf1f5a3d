"""Reference SQL of the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

from plotproof.llm.license_scan import PHRASES, TEMPLATES
from plotproof.llm.quality_rules import CUTOFFS, RULES

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRINGS = f"""
with docs as (select doc_id, {_PLAIN} w from documents),
words as (select doc_id, unnest(w) word, generate_subscripts(w, 1) i from docs),
starts as (select doc_id, w, unnest(range(1, len(w) - 48)) i from docs where len(w) >= 50),
windows as (select doc_id, i, array_to_string(w[i:i + 49], ' ') s from starts),
later as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) first from windows) where first < doc_id),
gone as (select distinct doc_id, i + k i from later, (select unnest(range(50)) k)),
kept as (
  select words.doc_id, count(*) n, count(gone.i) r,
         coalesce(string_agg(case when gone.i is null then word end, ' ' order by words.i), '') t
  from words left join gone on gone.doc_id = words.doc_id and gone.i = words.i group by 1)
select doc_id, coalesce(n, 0) n_words, coalesce(r, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from documents left join kept using (doc_id)
"""

DECONTAMINATION = f"""
with docs as (select doc_id, {_ALNUM} w from documents),
items as (select item_id::varchar item, {_ALNUM} w from benchmark where item_id is not null),
sized as (select item, w, least(len(w), 10) n from items where len(w) > 0),
patterns as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') s
  from (select item, w, n, unnest(range(1, len(w) - n + 2)) i from sized)),
windows as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from docs, (select distinct n from patterns) where len(w) >= n)),
hits as (select doc_id, i, n, item from windows join patterns using (n, s)),
covered as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + n)) j from hits) group by 1),
found as (
  select doc_id, count(*) n, string_agg(item, ',' order by item) l from (select distinct doc_id, item from hits) group by 1)
select doc_id, len(w) n_words, coalesce(c.n, 0) n_hit, coalesce(f.n, 0) n_items, sha256(coalesce(f.l, '')) items_sha256,
       coalesce(c.n, 0) > 0 contaminated
from docs left join covered c using (doc_id) left join found f using (doc_id)
"""

LINES = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
marked as (select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') t from lines),
worded as (select doc_id, i, t, row_number() over (partition by doc_id order by i) k from marked where t <> ''),
windows as (
  select doc_id, k, t || chr(10) || lead(t, 1) over d || chr(10) || lead(t, 2) over d w
  from worded window d as (partition by doc_id order by k)),
later as (
  select doc_id, k from (select *, row_number() over (partition by w order by doc_id, k) n from windows where w is not null) where n > 1),
gone as (select distinct doc_id, k + d k from later, (select unnest(range(3)) d)),
places as (select doc_id, i, true g from worded join gone using (doc_id, k)),
kept as (
  select doc_id, count(*) filter (t <> '') n, count(g) r, coalesce(string_agg(case when g is null then line end, chr(10) order by i), '') t
  from marked left join places using (doc_id, i) group by 1)
select doc_id, coalesce(n, 0) n_lines, coalesce(r, 0) n_removed, sha256(case when text is not null then kept.t end) kept_sha256
from documents left join kept using (doc_id)
"""


def _quality() -> str:
    rates = " union all ".join(
        f"select doc_id, lang, failed, '{rule}' rule, 1000.0 * {top} / greatest({bottom}, 1) v from measured"
        for rule, (top, bottom) in RULES.items()
    )
    return rf"""
with docs as (select doc_id, coalesce(lang, '') lang, coalesce(text, '') text, {_PLAIN} w from documents),
runs as (
  select doc_id, i, count(*) over (partition by doc_id, s) n
  from (select doc_id, i, array_to_string(w[i:i + 4], ' ') s
        from (select doc_id, w, unnest(range(1, len(w) - 3)) i from docs where len(w) >= 5))),
repeats as (
  select doc_id, count(distinct j) n from (select doc_id, i + d j from runs, (select unnest(range(5)) d) where n > 1) group by 1),
lines as (
  select doc_id, count(*) n, count(distinct line) d from (select doc_id, unnest(string_split(text, chr(10))) line from docs)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
measured as (
  select docs.doc_id, lang, len(w) n_palavras, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) n_caracteres,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_simbolos,
         length(text) - length(replace(text, '|', '')) n_barras,
         length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) n_maiusculas,
         coalesce(lines.n, 0) n_linhas, coalesce(lines.n - lines.d, 0) n_linhas_repetidas, coalesce(repeats.n, 0) n_palavras_repetidas,
         len(w) < 10 or 100 * coalesce(repeats.n, 0) > 20 * len(w) failed
  from docs left join lines using (doc_id) left join repeats using (doc_id)),
rates as ({rates}),
holdout as (select rates.*, quality from rates join labels using (doc_id) where quality in (0, 1) and not failed),
tried as (
  select lang, rule, c, count(*) filter (quality = 1) n, count(*) filter (quality = 1 and v > c) k, count(*) filter (quality = 0 and v > c) bad
  from holdout, (select unnest({list(CUTOFFS)}) c) group by all),
tails as (
  select lang, rule, c, bad,
         list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)) for i in range(k + 1)]) tail
  from tried where n > 0 and bad > 0 and k < 0.01 * n),
chosen as (
  select lang, rule, max_by(c, (bad, c)) c from tails
  where tail <= 0.05 / ((select count(distinct lang) from holdout) * {len(RULES) * len(CUTOFFS)}) group by all),
broken as (select distinct doc_id from rates join chosen using (lang, rule) where v > c)
select doc_id, n_palavras n_words, n_caracteres word_chars, n_simbolos n_symbols, n_linhas_repetidas n_dup_lines,
       n_palavras_repetidas n_repeat_words, failed base_failed, not failed and doc_id not in (select doc_id from broken) kept
from measured
"""

TRIE = r"""
with turns as (
  select conv_id, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id order by turn nulls first, role, text) k
  from conversations where conv_id is not null),
sizes as (select conv_id, count(*) n from turns group by 1),
crc as (
  select conv_id, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::ubigint)),
    lambda crc, byte: list_reduce(
      list_prepend(xor(crc, byte), list_transform(range(8), lambda i: i::ubigint)),
      lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) x
  from sizes),
plan as (
  select conv_id, conv_id - conv_id % 5 base, (xor(x, 4294967295::ubigint) % 9)::bigint h from crc),
rebuilt as (
  select p.conv_id, t.k, role, text from plan p join turns t on t.conv_id = p.base and t.k <= h
  union all
  select p.conv_id, t.k - h + least(h, coalesce(s.n, 0)), role, text
  from plan p join turns t on t.conv_id = p.conv_id and t.k > h left join sizes s on s.conv_id = p.base),
paths as (
  select conv_id, k d, text, list(sha256(length(role)::varchar || ':' || role || text)) over (partition by conv_id order by k) p from rebuilt
  union all select conv_id, 0, '', [] from sizes),
nodes as (select p, any_value(d) d, min(conv_id) conv_id, count(*) n, any_value(strlen(text)) b from paths group by p),
families as (select p[1:d - 1] p, count(*) c from nodes where d > 0 group by 1),
above as (select nodes.*, unnest(range(d + 1)) up from nodes),
sums as (
  select a.p[1:up] p, count(*) filter (f.p is null) leaves, sum((n - 1) * b) saved from above a left join families f on f.p = a.p group by 1),
deepest as (select conv_id, arg_max(p, d) p from paths group by 1),
ends as (select p, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) s from deepest group by 1)
select n.conv_id, n.d depth, parent.conv_id parent_conv_id, n.n n_convs, coalesce(f.c, 0) n_children, leaves::bigint n_leaves,
       saved::bigint saved_tokens, coalesce(e.s, sha256('')) ends_sha256
from nodes n join sums using (p) left join families f using (p) left join ends e using (p)
left join nodes parent on n.d > 0 and parent.p = n.p[1:n.d - 1]
"""


def _licenses() -> str:
    given = [*PHRASES, *TEMPLATES]
    rows = ", ".join(f"({i}, '{label}', '{text}', {i < len(PHRASES)})" for i, (label, text) in enumerate(given))
    return rf"""
with given(m, label, text, phrase) as (values {rows}),
models as (select m, label, phrase, {_ALNUM} w from given),
places as (
  select m, label, phrase, len(w) n, i, array_to_string(w[i + 1:i + case when phrase then 2 else 3 end], ' ') g
  from (select *, unnest(range(len(w) - case when phrase then 1 else 2 end)) i from models)),
docs as (select doc_id, {_ALNUM} w from documents),
grams as (
  select doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') g
  from (select doc_id, w, k, unnest(range(len(w) - k + 1)) i from docs, (values (2), (3)) sizes(k) where len(w) >= k)),
hits as (select doc_id, m, label, phrase, n, grams.i - places.i diagonal, grams.i word, places.i place from grams join places on grams.g = places.g and (k = 2) = phrase),
base as (select doc_id, label, diagonal from hits where phrase group by doc_id, m, label, n, diagonal having count(*) = n - 1),
diagonals as (select doc_id, m, label, n, diagonal, min(word) start, list(place) l from hits where not phrase group by all),
marked as (
  select *, case when abs(diagonal - lag(diagonal) over o) <= 3 and start - lag(start) over o < n then 0 else 1 end fresh
  from diagonals window o as (partition by doc_id, m order by start, diagonal)),
spans as (select *, sum(fresh) over (partition by doc_id, m order by start, diagonal) span from marked),
held as (
  select doc_id, label, count(distinct place + d) / n share
  from (select doc_id, m, label, n, span, unnest(l) place from spans), (values (0), (1), (2)) more(d)
  group by doc_id, m, label, n, span),
found as (
  select doc_id, count(*) n, min(diagonal)::bigint a, max(diagonal)::bigint z, string_agg(distinct label, ',' order by label) l from base group by 1),
labelled as (
  select doc_id, string_agg(distinct label, ',' order by label) l, max(share) s
  from (select doc_id, label, 1.0::double share from base union all select doc_id, label, share from held where share >= 0.75) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(f.n, 0) n_base, f.a first_word, f.z last_word, coalesce(f.l, '') base_labels,
       coalesce(e.l, '') labels, coalesce(e.s, 0.0)::double score
from docs left join found f using (doc_id) left join labelled e using (doc_id)
"""


FILTERS = rf"""
with docs as (select doc_id, coalesce(lang, '') part, coalesce(text, '') text, {_PLAIN} w from documents),
first as (select text, min(doc_id) id from docs group by 1),
masks as (
  select part,
         (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
         + 4 * (100 * length(regexp_replace(docs.text, '[^A-Z]', '', 'g')) > 10 * length(docs.text))::int
         + 8 * regexp_matches(docs.text, '[#$%&*|]')::int + 16 * (doc_id > id)::int mask,
         doc_id in (select doc_id from labels where quality = 1) good, doc_id in (select doc_id from labels where toxic = 1) toxic
  from docs join first on first.text = docs.text),
counted as (select part, mask, count(*) n, count(*) filter (good) g, count(*) filter (toxic) t from masks group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) c),
orders as (
  select a.c || b.c || c.c || d.c || e.c o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps as (
  select o, step, 1 << (ascii(o[step]) - 65) bit, list_sum([1 << (ascii(x) - 65) for x in string_split(o[:step - 1], '') if x <> ''])::int before
  from orders, (select unnest(range(1, 6)) step)),
applied as (
  select part, o, step, bit,
         coalesce(sum(n) filter (mask & (coalesce(before, 0) | bit) = 0), 0) kept,
         coalesce(sum(n) filter (mask & coalesce(before, 0) = 0 and mask & bit > 0), 0) removed,
         coalesce(sum(n) filter (mask & coalesce(before, 0) > 0 and mask & bit > 0), 0) redundant,
         coalesce(sum(n) filter (mask = bit), 0) alone,
         coalesce(sum(g) filter (mask & coalesce(before, 0) = 0 and mask & bit > 0), 0) good,
         coalesce(sum(t) filter (mask & coalesce(before, 0) = 0 and mask & bit > 0), 0) toxic
  from counted, steps group by all)
select part, o filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, alone::bigint unique_fails,
       good::bigint good_lost, toxic::bigint toxic_lost, (sum(removed) over (partition by part, bit))::bigint shapley
from applied
"""


ORACLE = {
    "op1_substring_dedup": SUBSTRINGS,
    "op3_decontamination": DECONTAMINATION,
    "op6_quality_rules": _quality(),
    "op8_line_dedup": LINES,
    "op11_prefix_trie": TRIE,
    "op12_license_scan": _licenses(),
    "op13_filter_audit": FILTERS,
}
