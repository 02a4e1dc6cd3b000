"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from protomatch.llm.chosen_path import DENOMINATOR, NUMERATOR, RUN_WORDS
from protomatch.llm.hard_negatives import LEAST, POSITIVES, SCALE
from protomatch.llm.hard_negatives import NEGATIVES as NEGATIVES_EACH
from protomatch.llm.lexical_search import LOWER, TERM, TOP, UPPER
from protomatch.llm.licenses import BASE_PHRASES, BREAK, expression_rules, gate_words, signature_rules
from protomatch.llm.mixing import BLOCK_BYTES, DEPTH, EXPONENT, PARTS, POINTS
from protomatch.llm.repeated_windows import LAST_ID
from protomatch.llm.repeated_windows import LENGTH as WINDOW
from protomatch.llm.suffix import LENGTH


def mix_sql() -> str:
    levels, weight = range(1, DEPTH + 1), f"pow(greatest(bytes, {BLOCK_BYTES // PARTS}), {EXPONENT})"
    nodes = ", ".join(f"max(own) filter (depth = {d}) as w{d}, max(cell) filter (depth = {d}) as c{d}" for d in range(DEPTH + 1))
    # 1 for the right half of a node, and for a node that has all of its parent.
    rights = ", ".join(f"(c{d} % 2 = 1 or w{d} = w{d - 1})::bigint as r{d}" for d in levels)
    up = ", ".join(f"((s{d} + 1) * w{d - 1} + (1 - r{d}) * (w{d} - 1)) // w{d} - 2 + r{d} as s{d - 1}" for d in reversed(levels))
    down = ", ".join(f"((n{d - 1} + 1) * w{d} + r{d} * (w{d - 1} - 1)) // w{d - 1} - r{d} as n{d}" for d in levels)
    return f"""
with docs as (
  select doc_id, source, coalesce(octet_length(encode(text)), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as key from documents
),
sizes as (select source, sum(size)::bigint as bytes from docs group by source),
shares as (
  select source, greatest(1, round({POINTS} * {weight} / sum({weight}) over ()))::bigint as share,
         greatest(ceil(bytes / {BLOCK_BYTES // PARTS}), 1)::bigint as parts,
         md5(case when source is null then 'none' else 'source ' || source end) as place
  from sizes
),
line as (select *, 2 * sum(share) over (order by place) - share as middle, 2 * sum(share) over () as ends from shares),
cells as (select *, (middle::bigint * (1::bigint << depth)) // ends::bigint as cell from line, (select unnest(range(0, {DEPTH + 1})) as depth)),
nodes as (select depth, cell, sum(share)::bigint as own from cells group by depth, cell),
widths as (select source, any_value(parts) as parts, {nodes} from cells join nodes using (depth, cell) group by source),
paths as (select *, {rights} from widths),
lasts as (select *, parts - 1 as s{DEPTH}, {up} from paths),
ends as (select max(s0) + 1 as n0 from lasts),
quotas as (select p.*, n0, {down} from paths p, ends),
placed as (
  select d.doc_id, d.source, least(coalesce(sum(size) over (partition by d.source order by key, doc_id nulls first, size
         rows between unbounded preceding and 1 preceding), 0)::bigint // {BLOCK_BYTES // PARTS}, q.parts - 1)::bigint as part, q.*  exclude (source)
  from docs d join quotas q on d.source is not distinct from q.source
),
copies as (select *, unnest(range(0, (n{DEPTH} - 1 - part) // parts + 1)) as copy from placed),
slots as (select *, part + copy * parts as s{DEPTH}, {up} from copies)
select doc_id, source, s0::bigint as mix_slot, (part // {PARTS})::bigint as mix_block, copy::bigint as mix_copy from slots
"""


def license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    named, expressions = signature_rules(), expression_rules()
    rules = ",\n".join(
        f"({k}, {quoted(r.label)}, {quoted(r.pattern)}, {quoted(r.keyword)}, {r.confidence}, {r.n_words > 0})" for k, r in enumerate([*named, *expressions]))
    base = ",\n".join(f"({quoted(label)}, {quoted(phrase)}, {phrase.count(' ') + 1})" for phrase, label in BASE_PHRASES)
    any_expression = "|".join(r.pattern for r in expressions)
    held = "|".join(gate_words(expressions))
    return f"""
with rules(rank, label, pattern, keyword, confidence, named) as (values {rules}),
base(label, phrase, n) as (values {base}),
docs as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '{BREAK}'), lambda w: w <> '') as words from documents
),
starts as (
  select doc_id, words, unnest(range(0, len(words))) as start from docs
  where list_has_any(words, ['license', 'licensed', 'cc', 'gpl', 'creative'])
),
texts as (select doc_id, start, list_aggregate(words[start + 1:start + 14], 'string_agg', ' ') || ' ' as ahead from starts),
likely as (select *, true as named from texts where regexp_matches(ahead, '^([^ ]+ ){{0,5}}(gnu|apache|mit|bsd|mozilla|eclipse|common|european|isc|zlib|artistic|boost|python|open|sil|cc|creative|simplified|new|modified) ')),
further as (
  select doc_id, start, array_to_string(words[start + 1:start + 160], ' ') || ' ' as ahead, false as named
  from (select doc_id, words, unnest(range(0, len(words))) as start from docs where regexp_matches(array_to_string(words, ' '), '{held}'))
),
tried as materialized (select * from likely union all select * from further where regexp_matches(ahead, '^(?:{any_expression}) ')),
matched as (
  select doc_id, start, rank, label, confidence, regexp_extract(ahead, '^(' || pattern || ') ', 1) as found from tried join rules using (named)
  where contains(ahead, keyword)
),
detected as (select *, start + len(string_split(found, ' ')) as finish from matched where found <> ''),
kept as (
  select * from (select *, coalesce(max(finish) over (partition by doc_id order by start, finish desc, rank
    rows between unbounded preceding and 1 preceding), 0) as reach from detected) where finish > reach
),
places as (select doc_id, start, label from texts, base where starts_with(ahead, phrase || ' ')),
labels as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels
  from (select doc_id, label from places union all select doc_id, label from kept) group by doc_id
)
select d.doc_id, len(words)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.first_word::bigint as first_word,
       b.last_word::bigint as last_word, coalesce(b.base_labels, '') as base_labels, coalesce(l.labels, '') as labels,
       greatest(coalesce(k.score, 0), case when b.n > 0 then 0.75 else 0 end)::double as score
from docs d
left join (select doc_id, count(*) as n, min(start) as first_word, max(start) as last_word,
           string_agg(distinct label, ',' order by label) as base_labels from places group by doc_id) b using (doc_id)
left join labels l using (doc_id)
left join (select doc_id, max(confidence) as score from kept group by doc_id) k using (doc_id)
"""


SIMILAR = f"""
with recursive words as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') as w from documents
),
runs as (
  select distinct doc_id, array_to_string(w[i:i + {RUN_WORDS - 1}], ' ') as run
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {RUN_WORDS - 1}, 1) + 1)) as i from words where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from runs group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from runs a join runs b on a.run = b.run and a.doc_id <> b.doc_id group by all
),
links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where {DENOMINATOR} * c >= {NUMERATOR} * (a.n + b.n - c)
  union
  select a.doc_id, b.doc_id from words a join words b on a.text = b.text and a.doc_id <> b.doc_id where len(a.w) = 0
),
reached(x, y) as (
  select doc_id, doc_id from words
  union
  select r.x, l.y from reached r join links l on l.x = r.y
)
select x as doc_id, min(y) as class_id, (select count(*) from links l where l.x = r.x) as n_links from reached r group by x
"""

# Texts as hexadecimal digits, two per byte.
REPEATS = f"""
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as digits from documents),
pieces as (
  select doc_id, p, substr(digits, 2000 * p + 1, {2 * (1000 + LENGTH - 1)}) as part
  from (select doc_id, digits, unnest(range(0, len(digits) // 2000 + 1)) as p from texts)
),
strings as (
  select doc_id, 1000 * p + j as i, substr(part, 2 * j + 1, {2 * LENGTH}) as string
  from (select doc_id, p, part, unnest(range(0, least(1000, greatest(len(part) // 2 - {LENGTH - 1}, 0)))) as j from pieces)
),
firsts as (select string, min(doc_id) as first from strings group by string),
lost as (select s.doc_id, s.i from strings s join firsts f using (string) where f.first < s.doc_id),
marked as (select *, i > coalesce(lag(i) over (partition by doc_id order by i), -{LENGTH + 1}) + {LENGTH} as opens from lost),
numbered as (select *, sum(opens::int) over (partition by doc_id order by i) as span from marked),
spans as (select doc_id, span, min(i) as lo, max(i) + {LENGTH} as hi from numbered group by doc_id, span),
kept as (
  select doc_id, string_agg(substr(digits, 2 * coalesce(before, 0) + 1, 2 * (lo - coalesce(before, 0))), '' order by lo) as head
  from (select s.doc_id, digits, lo, lag(hi) over (partition by s.doc_id order by lo) as before from spans s join texts using (doc_id))
  group by doc_id
),
sums as (select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, max(hi) as last from spans group by doc_id)
select t.doc_id, (len(digits) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(head, '') || substr(digits, 2 * coalesce(last, 0) + 1))) as kept_sha256
from texts t left join sums using (doc_id) left join kept using (doc_id)
"""


# A window is its words with a space between, which no word holds.
WINDOWS = f"""
with texts as (
  select row_number() over () as r, doc_id, coalesce(doc_id, {LAST_ID}) as place, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
),
windows as (
  select r, place, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) as w
  from (select r, place, words, unnest(range(1, len(words) - {WINDOW} + 2)) as i from texts)
),
firsts as (select w, min(place) as first from windows group by w),
lost as (select r, i from windows join firsts using (w) where first < place),
covered as (select distinct r, i + j as i from lost, range(0, {WINDOW}) as t(j)),
placed as (select r, unnest(words) as word, generate_subscripts(words, 1) as i from texts),
kept as (select r, string_agg(word, ' ' order by i) as text from placed anti join covered using (r, i) group by r),
sums as (
  select r, count(*) as n, count(*) filter (where opens) as spans
  from (select r, i > coalesce(lag(i) over (partition by r order by i), -1) + 1 as opens from covered) group by r
)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256,
       coalesce(spans, 0)::bigint as n_spans
from texts left join sums using (r) left join kept using (r)
"""

RANKED = f"""
with words as (
  select doc_id, row_number() over () as r, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from documents
),
counts as (select r, doc_id, term, count(*) as tf from words group by all),
docs as (select r, sum(tf)::bigint as n from counts group by r),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as terms from docs),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from counts, corpus group by term),
asked as (
  select q, item_id, term, count(*) as times
  from (select row_number() over () as q, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from benchmark)
  group by all
),
scored as (
  select q, item_id, r, doc_id, sum(times * w * (1000000000 * tf // (1000 * tf + 8 * (25 + 75 * n * docs // terms))))::bigint as score
  from asked join counts using (term) join weights using (term) join docs using (r), corpus group by all
)
select item_id, row_number() over (partition by q order by score desc, doc_id nulls last)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= {TOP}
"""

NEGATIVES = f"""
with usable as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.r as anchor, a.vec_id as anchor_id, b.r, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from usable a join usable b on a.vec_id % 100 = 0 and a.r <> b.r
),
positives as (
  select anchor, r, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor order by score desc, vec_id) <= {POSITIVES}
),
paired as (
  select s.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor, p.r order by s.score desc, s.vec_id)::int as rank
  from positives p join scored s on s.anchor = p.anchor and not s.same
   and {LEAST} * p.positive_score <= 100 * s.score and s.score <= p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from paired where rank <= {NEGATIVES_EACH}
"""


ORACLES: dict[str, str] = {
    "op1_mix_sources": mix_sql(),
    "op3_suffix_dedup": REPEATS,
    "op5_chosen_path": SIMILAR,
    "op7_license_scan": license_sql(),
    "op11_repeated_windows": WINDOWS,
    "op12_ranked_search": RANKED,
    "op13_hard_negatives": NEGATIVES,
}
