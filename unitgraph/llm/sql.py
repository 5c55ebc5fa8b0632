"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from unitgraph.llm.quality import COMMON_WORDS, WORD_BINS

SPACES = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array({{text}}, '{SPACES}'), lambda w: w <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, {WORDS.format(text=LOWER)} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, unnest(s) as x from s),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as (select a, b from links union select b, a from links),
r(node, other) as (select doc_id, doc_id from n union select r.node, l.b from r join both_ways l on l.a = r.other)
select n.doc_id, n.n as n_shingles, min(r.other) as component_id, n.doc_id = min(r.other) as kept from n join r on r.node = n.doc_id group by n.doc_id, n.n"""

SUBSTRING = f"""
with w as (select doc_id, {WORDS.format(text="coalesce(text, '')")} as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
gone as (select doc_id, i from (select *, min(doc_id) over (partition by h) as first from windows) where first < doc_id),
words as (select doc_id, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from w),
marked as (select k.doc_id, k.k, k.word, g.i is not null and g.i > k.k - 50 as is_gone from words k asof left join gone g on g.doc_id = k.doc_id and k.k >= g.i),
per as (select doc_id, count(*) filter (is_gone) as n_removed, string_agg(word, ' ' order by k) filter (not is_gone) as kept from marked group by 1)
select w.doc_id, len(w.w) as n_words, coalesce(p.n_removed, 0) as n_removed, sha256(coalesce(p.kept, '')) as kept_sha256 from w left join per p using (doc_id)"""

#: ASCII punctuation but for the counted symbols, as a pattern within an SQL string.
PUNCT = r"""[!"''()+,\-./:;=?@\[\\\]^_`{}~]"""
CLASSES = 7
_LIST = "[" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + "]"


def _sums(column: str, n: int) -> str:
    return "[" + ", ".join(f"sum({column}[{i}])" for i in range(1, n + 1)) + "]"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two histograms, base 2."""
    a, b = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    half = lambda x: f"case when {x} > 0 then {x} * log2({x} / (({a} + {b}) / 2)) else 0 end"
    return f"case when list_sum({p}) > 0 and list_sum({q}) > 0 then sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {half(a)} + {half(b)})) / 2)) end"


QUALITY = f"""
with t as (select doc_id, lang, coalesce(text, '') as t from documents),
w as (select *, {WORDS.format(text="t")} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
c as (select doc_id, lang, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  length(t) as chars, len(regexp_extract_all(t, '[A-Z]')) as up, len(regexp_extract_all(t, '[0-9]')) as dig, len(regexp_extract_all(t, '{PUNCT}')) as pun, strlen(t) - length(t) as oth,
  list_transform({_LIST}, lambda k: len(list_filter(w, lambda x: x = k))) || [len(list_filter(w, lambda x: not list_contains({_LIST}, x)))] as common from w),
f as (select *, [greatest(0, word_chars - up - dig - n_symbols - pun - oth), up, dig, chars - word_chars, n_symbols, pun, oth] as classes from c),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as h from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
again as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 8)) as k from (select *, count(*) over (partition by doc_id, h) as c from g) where c > 1) group by 1),
refs as (select coalesce(lang, '') as l, sum(n_words) as ref_words, {_sums('classes', CLASSES)} as rc, {_sums('common', WORD_BINS)} as rw from f group by 1),
d as (select f.*, coalesce(a.n, 0) as n_repeat_words, ref_words, {_distance('classes', 'rc')} as cd, {_distance('common', 'rw')} as wd from f join refs on l = coalesce(lang, '') left join again a using (doc_id)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, ref_words >= 10000 and n_words >= 50 as enough from d)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(cd, 6) as class_distance, round(wd, 6) as word_distance, base_failed,
  not base_failed and not coalesce(enough and (cd > 0.28 or n_words >= 100 and wd > 0.24), false) as kept from j"""

INTERACTION = f"""
with t as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
least as (select t, min(doc_id) as least from t group by 1),
w as (select t.*, {WORDS.format(text="t.t")} as w, coalesce(doc_id > least, false) as e from t join least using (t)),
l as (select doc_id, max(coalesce((quality = 1)::int, 0)) as good, max(coalesce((toxic = 1)::int, 0)) as toxic from labels group by 1),
f as (select part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), e] as fails, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l using (doc_id)),
g as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
letter as (select * from (values (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) v(i, c)),
orders as (select a.c || b.c || c.c || d.c || e.c as filter_order, [a.i, b.i, c.i, d.i, e.i] as o from letter a, letter b, letter c, letter d, letter e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (select *, unnest([1, 2, 3, 4, 5]) as step from orders),
s as (select part, filter_order, step, o[step] as i, n, good, toxic, fails[o[step]] as mine, len(list_filter(o[:step - 1], lambda k: fails[k])) > 0 as gone, len(list_filter(fails, lambda x: x)) as failed from g, steps),
c as (select part, filter_order, step, i, sum(case when not gone and not mine then n else 0 end)::bigint as kept, sum(case when not gone and mine then n else 0 end)::bigint as removed, sum(case when gone and mine then n else 0 end)::bigint as redundant,
  sum(case when mine and failed = 1 then n else 0 end)::bigint as unique_fails, sum(case when not gone and mine then good else 0 end)::bigint as good_lost, sum(case when not gone and mine then toxic else 0 end)::bigint as toxic_lost from s group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, i))::bigint as shapley from c"""

ORACLES: dict[str, str] = {"op1_minhash": NEAR_DUPLICATES, "op7_substring": SUBSTRING, "op8_quality": QUALITY, "op11_interaction": INTERACTION}
