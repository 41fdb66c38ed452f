"""Texts that lost their end, found by word trigrams that occur inside texts but almost never end one.

Everything is one SQL pipeline: split texts into sentences and words, count each
trigram inside sentences and at their ends, join the last trigram of every text
that has no closing mark, and judge it by those counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from concordat.runtime import cut_lineage, sql_over

#: A text that ends in one of these was cut and says so, or ends on a separator or an opened bracket.
MARKED = r"(…|\\.{3,}|[\\p{L}\\p{N}]-|\\s[-–—]|[,:;(\\[{]|[\\[(](more|cut|truncated|continued|…)[\\])]?|�)$"


def texts_of(responses: DataFrame) -> DataFrame:
    """``(response_id, channel, field_name, pos, text)``: every non-blank reasoning (pos -1) and step."""
    return responses.selectExpr(
        "response_id",
        "channel",
        """explode(concat(
             array(named_struct('field_name', 'reasoning', 'pos', -1L, 'text', reasoning)),
             transform(coalesce(step_by_step, cast(array() as array<string>)),
                       (x, i) -> named_struct('field_name', 'step_by_step', 'pos', cast(i as bigint), 'text', x)))) as t""",
    ).selectExpr("response_id", "channel", "t.field_name", "t.pos", "t.text").where("trim(text) <> ''")


# Words of every sentence: numbers are one word, marks at the ends of words are dropped.
_SENTENCES = r"""
select response_id, channel, field_name, pos, text,
       rtrim(text) rlike '[.?!∎]$' and not rtrim(text) rlike '([0-9]\\.|\\.\\.\\.)$' as closed,
       -- an end that may be whole as well as cut: only the trigram test speaks about it
       rtrim(text) rlike '[)\\]}”»"]$' and not rtrim(text) rlike '(\\[[^\\]]*\\.\\.\\.\\]|[\\[(](more|cut|truncated|continued|…)[\\])])$' as bracketed
from @texts
"""

_UNITS = r"""
filter(split(regexp_replace(rtrim(text), '(?<=[?!;∎]|(?<![0-9])\\.|[0-9]\\.(?=\\s))\\s+', '\n'), '\n+'), s -> s <> '')
"""

_WORDS = r"""
filter(split(regexp_replace(regexp_replace(UNIT, '[0-9]+([.,][0-9]*)*', '#'), '^\\s*[-*•]\\s+|[.,;:?!…]+(?=\\s|$)', ''), '\\s+'), w -> w <> '')
"""

# One entry per word: its opening (second and first word of the sentence), the trigram that ends with it, and
# whether a word follows, or the sentence ends closed, or the whole text ends open on it.
_GRAMS = r"""
select inline(transform(u, (w, i) -> named_struct(
         'o', if(size(u) > 1, u[1], ''), 'f', u[0],
         'a', if(i > 1, u[i - 2], '^'), 'b', if(i > 0, u[i - 1], '^'), 'w', w,
         'place', if(i < size(u) - 1, 0, if(k < n - 1 or closed, 1, 2)))))
from (select closed, n, k, WORDS as u
      from (select closed, size(units) as n, posexplode(units) as (k, s) from (select closed, UNITS as units from @sentences)))
where size(u) > 0
"""

_TYPES = """
select o, f, a, b, w, count_if(place = 0) as inside, count_if(place = 1) as closed, count_if(place = 2) as open
from @grams group by o, f, a, b, w
"""

# Texts with a closing mark are whole; only the others are split, and only their last sentence is read.
_OPEN = "select * from @sentences where not closed"

_TAILS = r"""
select response_id, channel, field_name, pos, length(text) as len, bracketed, rtrim(text) rlike '{marked}' as marked, rtrim(text) rlike '[.?!]$' as stopped,
       coalesce(text rlike '\n|;\\s|^\\s*[-*•]\\s' and not text rlike '[.?!]\\s', false) as listed,
       if(size(u) > 1, u[1], '') as o, u[0] as f,
       if(size(u) > 2, u[size(u) - 3], '^') as a, if(size(u) > 1, u[size(u) - 2], '^') as b, u[size(u) - 1] as w
from (select *, WORDS as u from (select *, coalesce(element_at(UNITS, -1), '') as s from @open)) where size(u) > 0
"""

#: Single letters, the symbols of formulas, count as one word at the last level.
_MASK = r"if(\1 rlike '^\\\\p{L}$', '@', \1)"

_JUDGED = """
with plain as (select a, b, w, sum(inside) as inside, sum(closed) as closed, sum(open) as open from @types group by a, b, w),
     lead as (select f, b, w, sum(inside) as inside, sum(closed) as closed, sum(open) as open from @types group by f, b, w),
     masked as (select MASK(a) as a, MASK(b) as b, MASK(w) as w, sum(inside) as inside, sum(closed) as closed, sum(open) as open
                from plain group by 1, 2, 3),
     follows as (select b, w, sum(inside + closed) as n from plain group by b, w),
     -- beginnings of words, in the lengths that the last words of open texts have
     begun as (select b, w, n, filter(LENGTHS, i -> i < length(w)) as cuts from follows),
     longer as (select b, p, sum(n) as n from (select b, n, explode(transform(cuts, i -> left(w, i))) as p from begun) group by b, p),
     word as (select w, sum(n) as n from follows group by w),
     longer_word as (select p, sum(n) as n from longer group by p),
     -- many texts of a field end alike: each kind of tail is judged once
     tail_types as (select o, f, a, b, w, MASK(a) as ma, MASK(b) as mb, MASK(w) as mw from @tails group by o, f, a, b, w)
select t.o, t.f, t.a, t.b, t.w,
       -- the closest level with enough occurrences decides
       coalesce(NEVER_ENDS(p1), NEVER_ENDS(p2), NEVER_ENDS(p3), NEVER_ENDS(p4), false) as never_ends,
       coalesce(p3.closed >= 0.1 * (p3.inside + p3.closed), false) as ends_elsewhere,
       coalesce(p2.closed + p2.open > p2.inside and (p2.closed >= 1 or p2.open >= 2), false) as ends_such_items,
       -- whole texts that end without a mark do so in the same few ways
       (t.o <> '' and OFTEN_OPEN(p1)) or OFTEN_OPEN(p2) or OFTEN_OPEN(p3) or OFTEN_OPEN(p4) as often_open,
       coalesce(l.n >= :support and coalesce(f.n, 0) <= :share * l.n, false)
         or coalesce(lw.n >= :support, false) and coalesce(v.n, 0) = 0 as part_of_word
from tail_types t
left join @types p1 on t.o = p1.o and t.f = p1.f and t.a = p1.a and t.b = p1.b and t.w = p1.w
left join lead p2 on t.f = p2.f and t.b = p2.b and t.w = p2.w
left join plain p3 on t.a = p3.a and t.b = p3.b and t.w = p3.w
left join masked p4 on t.ma = p4.a and t.mb = p4.b and t.mw = p4.w
left join follows f on t.b = f.b and t.w = f.w
left join longer l on t.b = l.b and t.w = l.p
left join word v on t.w = v.w
left join longer_word lw on t.w = lw.p
"""

#: Ends that are open may be cuts themselves, so only closed ones speak clearly against a cut.
_NEVER_ENDS = (
    r"case when \1.inside + \1.closed >= :support or \1.closed + \1.open >= 3 * :support then "
    r"\1.inside >= :support and \1.closed <= :share * (\1.inside + \1.closed) and \1.open <= \1.inside end"
)

#: The text's own open end is among the counted ones and says nothing about itself.
_OFTEN_OPEN = r"coalesce(\1.open - 1 > \1.inside and \1.open - 1 >= 0.2 * \1.closed, false)"

_REASONS = """
select t.response_id, t.field_name, t.pos, t.channel, t.len, t.stopped or t.bracketed as stopped,
       -- the trigram test comes first; items of a list carry no full stop, so there it and the item's first word must agree
       case when j.never_ends and not (t.listed and (j.ends_elsewhere or j.ends_such_items)) then 'within a sentence'
            when t.bracketed then null
            when t.marked then 'marked' when j.part_of_word then 'within a word'
            when not t.listed and not t.stopped and not j.often_open then 'without its end' end as reason
from @tails t join @judged j on t.o = j.o and t.f = j.f and t.a = j.a and t.b = j.b and t.w = j.w
"""

# A field limit: a length at which a source's cut texts pile up, far above the lengths around it, and few others end.
_LIMITS = """
select channel, field_name, len
from (select *, coalesce(sum(cut) over (partition by channel, field_name order by len range between 40 preceding and 3 preceding), 0)
              + coalesce(sum(cut) over (partition by channel, field_name order by len range between 3 following and 40 following), 0) as around
      from (select channel, field_name, len, count(*) as n, count_if(reason is not null) as cut from @reasons group by 1, 2, 3))
where cut >= 2 * :support and cut >= 0.6 * n and cut >= 8 * around / 76
"""

_VERDICT = """
select r.response_id, r.field_name, r.pos, r.channel, coalesce(r.reason, if(l.len is not null and not r.stopped, 'field limit', null)) as reason
from @reasons r left join @limits l on r.channel <=> l.channel and r.field_name = l.field_name and r.len = l.len
"""


def truncated_texts(responses: DataFrame, min_support: int = 3, max_end_share: float = 0.05) -> DataFrame:
    """``(response_id, field_name, pos, channel, reason)``: the texts whose end is missing.

    ``responses`` needs response_id, channel, reasoning and step_by_step; other
    columns are ignored. A text without a closing mark is cut where its last
    trigram (told apart by the sentence's opening words where that is frequent
    enough, else alone, else with letters masked) is seen inside sentences at least
    ``min_support`` times and closes one in at most ``max_end_share`` of all cases, where its last word is only ever seen
    as the beginning of longer words, where a cut mark is left, where it is no list
    and its last trigram is usually not the open end of a text, or where its length is a limit at which the source's texts pile up unclosed.

    A text that ends on a closing bracket or quote may be whole or cut, so there only the trigram test speaks.

    Null and blank texts are no cases, a null channel is a source of its own,
    repeated rows give repeated findings, an empty table gives no rows.
    """
    limits_of = {"support": min_support, "share": max_end_share}
    words_of = lambda query: query.replace("WORDS", _WORDS.replace("UNIT", "s")).replace("UNITS", _UNITS)
    sentences = sql_over(_SENTENCES, texts=texts_of(responses))
    types = cut_lineage(sql_over(_TYPES, grams=sql_over(words_of(_GRAMS), sentences=sentences)))
    tails = cut_lineage(sql_over(words_of(_TAILS.replace("{marked}", MARKED)), open=sql_over(_OPEN, sentences=sentences)))
    judging = re.sub(r"OFTEN_OPEN\((\w+)\)", _OFTEN_OPEN, _JUDGED)
    judging = re.sub(r"MASK\((\w)\)", _MASK, re.sub(r"NEVER_ENDS\((\w+)\)", _NEVER_ENDS, judging))
    lengths = sorted(r["n"] for r in tails.selectExpr("length(w) as n").distinct().collect())  # a few numbers
    judging = judging.replace("LENGTHS", f"array({', '.join(map(str, lengths or [1]))})")
    judged = sql_over(judging, limits_of, types=types, tails=tails)
    reasons = sql_over(_REASONS, tails=tails, judged=judged)
    limits = sql_over(_LIMITS, {"support": min_support}, reasons=reasons)
    return sql_over(_VERDICT, reasons=reasons, limits=limits).where("reason is not null")


#: Reasons for a find and the columns that count them per source.
REASONS = {"within a sentence": "in_sentence", "within a word": "in_word", "marked": "marked", "without its end": "without_end", "field limit": "at_limit"}


def truncation_by_source(responses: DataFrame, **options: object) -> DataFrame:
    """``(channel, field_name, n_texts, n_cut, cut_share, <one count per reason>)``: how often each source cuts each field, and what told."""
    by_reason = [f"count_if(reason = '{r}') as {c}" for r, c in REASONS.items()]
    found = truncated_texts(responses, **options).selectExpr("channel", "field_name", "reason")
    cut = sql_over(f"select channel, field_name, count(*) as n_cut, {', '.join(by_reason)} from @found group by 1, 2", found=found)
    zero = ", ".join(f"coalesce(c.{c}, 0) as {c}" for c in REASONS.values())
    return sql_over(
        f"""select t.channel, t.field_name, t.n_texts, coalesce(c.n_cut, 0) as n_cut, coalesce(c.n_cut, 0) / t.n_texts as cut_share, {zero}
           from (select channel, field_name, count(*) as n_texts from @texts group by 1, 2) t
           left join @cut c on t.channel <=> c.channel and t.field_name = c.field_name""",
        texts=texts_of(responses),
        cut=cut,
    )
