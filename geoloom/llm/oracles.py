"""The SQL twins of queries whose operators SQL can express, for DuckDB.

Each takes the plain way: all windows, all pairs, all counts.
"""

from __future__ import annotations

import string

from .decontaminate import WINDOW_WORDS
from .lm_scoring import SMOOTHING
from .near_duplicates import SIMILARITY
from .probminhash import SHINGLE_WORDS
from .url_filter import BINS, EDGE, FOLDS, ORDER, RULES, SIGNS

#: The words of a text: runs of 0-9, a-z and everything from U+0080 on, after A-Z are lowered.
WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def near_duplicates() -> str:
    """Probability Jaccard of all pairs that overlap enough to reach the similarity, then what each text reaches."""
    size = SHINGLE_WORDS
    return f"""
    with recursive d as (select doc_id, {WORDS} as w from documents),
    r as (select doc_id, w, min(doc_id) over (partition by w) as rep from d where len(w) > 0),
    n as (select distinct rep, w from r),
    s as (select rep, sh, count(*)::double as c from (select rep, unnest(list_transform(range(1, greatest(len(w) - {size - 2}, 2)), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) as sh from n) group by all),
    t as (select rep, sum(c) as total from s group by rep),
    p as (select a.rep as x, b.rep as y from s a join s b on a.sh = b.sh and a.rep < b.rep join t as ta on ta.rep = a.rep join t as tb on tb.rep = b.rep
          group by all having sum(least(a.c / ta.total, b.c / tb.total)) >= {SIMILARITY} - 1e-9),
    u as (select x, y, sh, sum(a) as a, sum(b) as b from (select x, y, sh, c as a, 0.0::double as b from p join s on rep = x union all select x, y, sh, 0.0::double, c from p join s on rep = y) group by all),
    j as (select x, y, sum(1 / f) as j from (select i.x, i.y, i.sh, sum(greatest(k.a / i.a, k.b / i.b)) as f from u as i join u as k on i.x = k.x and i.y = k.y where i.a > 0 and i.b > 0 group by all) group by all),
    e as (select x, y from j where j >= {SIMILARITY} - 1e-9 union all select y, x from j where j >= {SIMILARITY} - 1e-9),
    reach(a, b) as (select rep, rep from n union select reach.a, e.y from reach join e on e.x = reach.b),
    c as (select a, min(b) as class_id from reach group by a)
    select doc_id, rep as rep_id, class_id from r join c on a = rep union all select doc_id, doc_id, doc_id from d where len(w) = 0
    """


def decontaminate() -> str:
    """All windows of the items against all windows of as many words of the documents."""
    return f"""
    with i as (select item_id, {WORDS} as w from benchmark), d as (select doc_id, {WORDS} as w from documents),
    k as (select item_id, least(len(w), {WINDOW_WORDS}) as n, unnest(list_transform(range(1, greatest(len(w) - {WINDOW_WORDS - 2}, 2)), lambda p: array_to_string(w[p:p + least(len(w), {WINDOW_WORDS}) - 1], ' '))) as win from i where len(w) > 0),
    x as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as pos, w from d, (select distinct n from k) where len(w) >= n),
    h as (select doc_id, pos, k.n, item_id from (select doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') as win from x) as x join k on k.n = x.n and k.win = x.win),
    c as (select doc_id, count(distinct q)::bigint as n_hit from (select doc_id, unnest(range(pos, pos + n)) as q from h) group by doc_id),
    m as (select doc_id, count(*)::bigint as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from h where item_id is not null) group by doc_id)
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join c using (doc_id) left join m using (doc_id)
    """


def cross_entropy_difference() -> str:
    """Counts of all words, contexts and pairs of both sides, less each document's own."""
    def loss(side: str) -> str:
        own = "case when target then {} else 0 end" if side == "t" else "case when target then 0 else {} end"
        pair, word, context, every = (f"(coalesce({x}, 0) - {own.format(y)})" for x, y in ((f"pair_{side}", "own_pair"), (f"word_{side}", "own_word"), (f"context_{side}", "own_context"), (f"all_{side}", "n")))
        return f"avg(-ln(({pair} + {SMOOTHING}::double * (({word} + 1.0::double) / ({every} + classes))) / ({context} + {SMOOTHING}::double)))"

    return f"""
    with d as (select doc_id, {WORDS} as w, doc_id in (select doc_id from labels where quality = 1 and toxic = 0) as target from documents),
    k as (select doc_id, target, len(w) as n, unnest(w) as w, unnest(list_prepend('<', w[1:len(w) - 1])) as v from d where len(w) > 0),
    p as (select v, w, count(*) filter (target) as pair_t, count(*) filter (not target) as pair_b from k group by all),
    o as (select w, count(*) filter (target) as word_t, count(*) filter (not target) as word_b from k group by all),
    c as (select v, count(*) filter (target) as context_t, count(*) filter (not target) as context_b from k group by all),
    a as (select count(*) filter (target) as all_t, count(*) filter (not target) as all_b, count(distinct w) + 1 as classes from k),
    own as (select doc_id, n, target, v, w, count(*) over (partition by doc_id, v, w) as own_pair, count(*) over (partition by doc_id, w) as own_word, count(*) over (partition by doc_id, v) as own_context from k),
    s as (select doc_id, {loss('t')} as x, {loss('b')} as y from own join p using (v, w) join o using (w) join c using (v), a group by doc_id)
    select d.doc_id, len(w)::bigint as n_tokens, round(x, 6) as target_loss, round(y, 6) as background_loss, round(x - y, 6) as difference from d left join s using (doc_id)
    """


def url_filter() -> str:
    """The rules, both Markov models entry by entry, the threshold on the held-out fold, and the verdicts."""
    fits = [(name, start, rule) for rule in sorted(RULES, key=lambda r: (len(r), [-ord(c) for c in r]), reverse=True) for name, _, start in [rule.partition("/")]]
    rule = " ".join(f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{start}') then '{rule}'" for name, start, rule in fits)
    allowed = ", ".join(f"'{r}'" for r, v in RULES.items() if v == "allow")
    models, below = [], "select 0::bigint as id, 1.0::double / 32 as yes, 1.0::double / 32 as no"
    for order in range(ORDER + 1):
        size, width = SIGNS ** (order + 1), SIGNS**order if order else 1
        side = lambda x: f"case when coalesce(all_{x}, 0) > 0 then (coalesce(n_{x}, 0) + kinds_{x} * b.{x}) / (all_{x} + kinds_{x}) else b.{x} end as {x}"
        models.append(f"""c{order} as (select gram % {size} as id, sum(n_yes)::double as n_yes, sum(n_no)::double as n_no from seen group by 1),
    x{order} as (select id // 32 as context, sum(n_yes) as all_yes, sum(n_no) as all_no, count_if(n_yes > 0)::double as kinds_yes, count_if(n_no > 0)::double as kinds_no from c{order} group by 1),
    m{order} as (select e.id, {side('yes')}, {side('no')} from (select range as id from range({size})) as e left join c{order} as c on c.id = e.id left join x{order} as x on x.context = e.id // 32 join ({below}) as b on b.id = e.id % {width})""")
        below = f"select * from m{order}"
    own, to = string.ascii_lowercase + string.digits + "/.-", string.ascii_uppercase + "[" * 10 + "\\]_"
    return f"""
    with p as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    h as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
    r as (select *, case {rule} end as rule from h),
    s as (select page_id, host, path, rule, list_filter(list_transform(string_split('@@@' || translate(regexp_replace(regexp_replace(lower(coalesce(url, '')), '^[a-z]*://', ''), '[^a-z0-9/.\\-]', '^', 'g'), '{own}', '{to}') || '@', ''), lambda x: ascii(x) - 64), lambda x: x >= 0) as c from r),
    g as (select page_id, host, path, rule, rule in ({allowed}) as accepted, ('0x' || substr(md5(page_id::varchar), 1, 8))::bigint % {FOLDS} = 0 as held,
          list_transform(range({ORDER + 1}, len(c) + 1), lambda i: ((c[i - 3]::bigint * 32 + c[i - 2]) * 32 + c[i - 1]) * 32 + c[i]) as grams from s),
    seen as (select gram, count_if(accepted) as n_yes, count_if(not accepted) as n_no from (select accepted, unnest(grams) as gram from g where rule is not null and not held) group by gram),
    {', '.join(models)},
    ratio as (select id, (ln(yes) - ln(no))::float::double as r from m{ORDER}),
    w as (select page_id, sum(r) / count(*) as score from (select page_id, unnest(grams) as gram from g) join ratio on id = gram group by page_id),
    k as (select g.*, score, least(greatest(floor(score * {BINS}), -{EDGE}), {EDGE})::bigint as bin from g join w using (page_id)),
    b as (select bin, count_if(accepted)::double as yes, count_if(not accepted)::double as no from k where rule is not null and held group by bin),
    f as (select least(bin, greatest(0, coalesce(lag(bin) over (order by bin) + 1, -{EDGE}))) as bin, sum(yes) over (order by bin) - yes as missed, sum(no) over (order by bin) - no as caught, sum(yes) over () as yes, sum(no) over () as no from b),
    t as (select coalesce((select bin from f where yes > 0 and no > 0 order by missed / yes + (no - caught) / no, abs(bin), bin limit 1), 0) as least_bin)
    select page_id, host, path, rule, case when rule is not null then case when accepted then 'allow' else 'block' end when bin >= least_bin then 'allow' else 'block' end as verdict, round(score, 6) as score from k, t
    """
