"""The card gate over conversations: an assistant's turn is a card that cites the turns beside it; users' turns are evidence and knowledge units."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cards as K
from ..operators import curation as C
from ..operators import merges as M
from ..session import table
from .registry import query

_KEY = r"lower(regexp_replace({}, '[^\p{{L}}\p{{M}}\p{{Nd}}]+', '', 'g'))"


def _key(x: str) -> str:
    return _KEY.format(x)


def _tight(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _noise(x: str) -> tuple[str, str]:
    """The bare text, and the tests on it that need no n-grams."""
    bare = rf"regexp_replace(trim(regexp_replace({_tight(f'coalesce({x}, {chr(39) * 2})')}, '{K.TIME_RANGE}', '')), '{K.NOISE_ENDS}', '', 'g')"
    marks = " + ".join(f"(length(tight) - length(replace(tight, '{m}', ''))) / {len(m)}" for m in K.WATERMARKS)
    return bare, rf"(bare = '' or regexp_matches(tight, '{K.CREDIT}') or {marks} >= 2 or regexp_matches(regexp_replace(bare, '{K.MARKS}', '', 'g'), '{K.CUE}'))"


@query("fm17_card_gate", rf"""
with t as (select conv_id as material, turn, role, text, lag(text) over (partition by conv_id order by turn) as before from conversations),
c as (select material, turn as card, '什么是 ' || substr({_tight('coalesce(before, text)')}, 1, 60) || '？' as question, {_tight('before')} as hint, text as answer, role from t where role = 'assistant'),
e as (select material, turn, text from t where role <> 'assistant'),
r as (select c.material, card, x.d, e.turn is null as foreign_, coalesce(e.text, '') as snippet from c, (values (-1), (1)) x(d) left join e on e.material = c.material and e.turn = card + x.d),
s as (select material, card, count(*) filter (foreign_) as n_foreign, {_key("string_agg(snippet, ' ' order by d)")} as source from r group by 1, 2),
u as (select c.material, card, count(*) filter (e.turn is null) as strange, count(*) filter (e.turn is not null and x.d = -3) as apart from c, (values (-1), (-3)) x(d) left join e on e.material = c.material and e.turn = card + x.d where card + x.d >= 0 group by 1, 2),
q as (select material, count(*) as n from e group by 1),
a as (select *, case when regexp_matches({_tight('x')}, '{K.ARTEFACT}') or x = '' then null when length(x) > 1200 then regexp_replace(substr(x, 1, 1200), '\s+$', '') || '...' else x end as y from
  (select c.*, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(answer, '\r\n?', chr(10), 'g'), chr(10)), lambda l: regexp_replace(l, '\s+$', '')), lambda l: not regexp_matches(l, '{K.DROPPED_LINE}')), chr(10)), '{K.PARENT_MARK}', ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as x from c)),
kinds as (select material, card, 'answer' as kind, y as v from a union all select material, card, 'question', question from c union all select material, card, 'hint', case when length(hint) > 180 then rtrim(substr(hint, 1, 180)) || '...' else hint end from c),
b as (select *, regexp_replace(bare, '\s+', '', 'g') as tight, regexp_replace(bare, '{C.NOISE_MARKS}', '', 'g') as k, row_number() over () as id from (select *, {_noise('v')[0]} as bare from kinds)),
g as (select distinct id from (select id, length(k) as n, w, substr(k, i, w) as g, count(*) as c from (select *, unnest(range(1, length(k) - w + 2)) as i from b, range(3, 13) w(w) where length(k) >= 18 and length(k) >= 3 * w) group by all) where c >= 3 and c * w * 100 >= n * 60),
p as (select distinct id from (select id, bare, l, unnest(range(1, greatest(1, length(bare) - 3 * l))) as i from b, range(2, 15) l(l)) where substr(bare, i, l) || ' ' || substr(bare, i, l) || ' ' || substr(bare, i, l) = substr(bare, i, 3 * l + 2)),
noisy as (select material, card, kind, v, {_noise('v')[1]} or id in (select id from g) or id in (select id from p) as noise from b),
parts as (select material, card, regexp_replace(regexp_replace(trim(part), '{K.LIST_MARK}', ''), '^(?:{K.CONNECTORS})[，,:：\s]*', '') as p from
  (select material, card, unnest(string_split(regexp_replace(p, '[，,]\s*({K.CONNECTORS})', chr(1) || '\1', 'g'), chr(1))) as part from (select material, card, unnest(regexp_split_to_array(y, '{C.CLAIM_ENDS}')) as p from a) where not starts_with(ltrim(p), '#'))),
claims as (select row_number() over () as id, material, card, {_key('p')} as claim, source from parts join s using (material, card) where {_key('p')} <> ''),
cg as (select id, count(distinct x) as n, count(distinct case when contains(source, x) then x end) as hit from (select id, source, substr(claim, i, w) as x from (select *, unnest(range(1, length(claim) - w + 2)) as i from (select *, case when length(claim) <= 12 then 3 else 4 end as w from claims))) group by 1),
cr as (select id, bool_or(contains(source, substr(claim, i, least(4, length(claim))))) as run from (select *, unnest(range(1, length(claim) - least(4, length(claim)) + 2)) as i from claims) group by 1),
ok as (select material, card, bool_and(contains(source, claim) or (coalesce(run, false) and coalesce(hit::double / n, 0) >= 0.08)) as held from claims left join cg using (id) left join cr using (id) group by 1, 2),
n as (select material, card, bool_or(noise) filter (kind = 'answer') as na, bool_or(noise) filter (kind = 'question') as nq, bool_or(noise) filter (kind = 'hint') as nh, max(v) filter (kind = 'hint') as h from noisy group by 1, 2),
ladder as (select a.*, h, {_key('question')} as k, n.*exclude (material, card, h), source, n_foreign, strange, apart, held, q.n as units from a join s using (material, card) join n using (material, card) left join u using (material, card) left join ok using (material, card) left join q using (material)),
f as (select *, case when y is null then 'no_answer' when n_foreign > 0 then 'unknown_evidence' when units is not null and strange > 0 then 'unknown_unit' when units is not null and apart > 0 then 'unit_apart'
  when na or source = '' or {_key('y')} = '' or not (contains(source, {_key('y')}) or coalesce(held, false)) then 'not_held'
  when length(k) not between 8 and 180 or len(regexp_extract_all(question, '[？?]')) > 1 or regexp_matches(question, '{K.ASKED_ON}') or regexp_matches(question, '{C.ANSWER_IN_QUESTION}') or regexp_matches(question, '{K.ARTEFACT}') or nq
    or regexp_matches(question, '{K.TEACHING_START}') or regexp_matches(question, '{C.POINTING_START}') or regexp_matches(question, '{C.TASK_START}') or regexp_matches(question, '{K.INTERVIEW}') or regexp_matches(question, '{K.VAGUE}')
    or not (regexp_matches(question, '{C.QUESTION_FORM}') or regexp_matches(question, '{C.RECALL_FORM}')) then 'question'
  when h is null or length({_key('h')}) not between 6 and 180 or regexp_matches(h, '{K.ARTEFACT}') or nh or regexp_matches(regexp_replace(h, '{K.HINT_ENDS}', '', 'g'), '{K.GENERIC_HINT}') then 'hint' end as reason from ladder),
d as (select material, card, units, case when reason is null and row_number() over (partition by material, k, reason is null order by card, answer) > 1 then 'repeated_question' else reason end as reason from f),
v as (select material, count(distinct turn) as covered from (select d.material, e.turn from d, (values (-1), (-3)) x(d) join e on e.material = d.material and e.turn = card + x.d where reason is null) group by 1)
select material, card, reason, reason is null and (units is null or coalesce(covered, 0) >= least(units, greatest(1, ceil(units * 0.4)))) as published from d left join v using (material)""")
def fm17(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda shift: (F.col("turn") + shift).cast("string")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    said = c.filter("role = 'assistant'").join(before, ["conv_id", "turn"], "left")
    question = F.concat(F.lit("什么是 "), F.substring(T.collapsed(F.coalesce("before", "text")), 1, 60), F.lit("？"))
    units = F.filter(F.array(F.when(F.col("turn") >= 1, name(-1)), F.when(F.col("turn") >= 3, name(-3))), lambda x: x.isNotNull())
    cards = said.select(F.col("conv_id").alias("material"), F.col("turn").alias("card"), question.alias("question"), T.collapsed(F.col("before")).alias("hint"), F.col("text").alias("answer"), F.array(name(-1), name(1)).alias("evidence_ids"), units.alias("unit_ids"))
    asked = c.filter("role <> 'assistant'").select(F.col("conv_id").alias("material"), name(0).alias("id"), F.col("text").alias("snippet"))
    return K.gate(cards, asked.withColumnRenamed("id", "evidence_id"), asked.select("material", F.col("id").alias("unit_id"), F.array("id").alias("evidence_ids")), relaxed=True)


_MERGES = r"""with t as (select conv_id as candidate, turn, text, lag(text) over (partition by conv_id order by turn) as before,
  lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) as k from conversations where text is not null),
c as (select candidate, (row_number() over (partition by candidate order by turn))::int as card, substr(text, 1, 60) as question, before as hint, text as answer, k, turn from t),
g as (select candidate, list(card order by card) as cards from c where k <> '' group by candidate, 'first ' || k[1:1] having count(*) > 1
  union all select candidate, list(card order by card) from c where k <> '' group by candidate, 'last ' || k[-1:] having count(*) > 1),
p as (select *, (row_number() over (partition by candidate order by cards))::int as grp from g),
x as (select candidate, grp, unnest(cards) as card from p),
claims as (select candidate, card, lower(regexp_replace(substr(regexp_replace(regexp_replace(s, '^\s*(?:[-*+>] |\d+[.)]\s*)', ''), '^\s+|\s+$', '', 'g'), 1, 1200), '[^\p{L}\p{N}]+', '', 'g')) as claim
  from (select candidate, card, unnest(regexp_split_to_array(answer, '[。！？!?；;\n]+')) as s from c)),
o as (select candidate, grp, bool_or(grp > low) as again from (select *, min(grp) over (partition by candidate, card) as low from x) group by 1, 2),
m as (select candidate, grp, min(card) as head, substr(string_agg(answer, chr(10) order by card), 1, 1200) as answer, arg_min(question, card) as question, arg_min(coalesce(hint, ''), card) as hint, list(card order by card) as cards from x join c using (candidate, card) group by 1, 2),
l as (select candidate, grp, bool_or(not contains(lower(regexp_replace(m.answer, '[^\p{L}\p{N}]+', '', 'g')), claim)) as lost from x join claims using (candidate, card) join m using (candidate, grp) where claim <> '' group by 1, 2),
f as (select m.*, case when again then 1 when lost or trim(hint) = '' then 3 end as stage, case when again then 'overlap' when lost then 'claim_lost' when trim(hint) = '' then 'no_hint' end as fault from m join o using (candidate, grp) left join l using (candidate, grp)),
v as (select candidate, count(fault) = 0 as accepted, min({'s': stage, 'g': grp, 'f': fault}) filter (fault is not null) as z from f group by 1)
"""


def _merge_plan(spark, d):
    """Turns as cards; cards of a conversation that begin, or end, with one letter shall become one card."""
    t = table(spark, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("candidate"), "turn", "text")
    by_turn = Window.partitionBy("candidate").orderBy("turn")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 0))
    t = t.select(
        "candidate", F.row_number().over(by_turn).alias("card"), F.substring("text", 1, 60).alias("question"), F.lag("text").over(by_turn).alias("hint"),
        F.col("text").alias("answer"), words.alias("unit_ids"), F.array(F.col("turn").cast("string")).alias("evidence_ids"), M.key(F.col("text")).alias("k"),
    )
    cards = t.withColumn("question_keys", F.array(M.key(F.col("question"))))
    ends = F.explode(F.array(F.concat(F.lit("first "), F.substring("k", 1, 1)), F.concat(F.lit("last "), F.substring("k", -1, 1))))
    held = F.array_sort(F.collect_list(F.struct("card", "question", F.coalesce("hint", F.lit("")).alias("hint"), "answer", "unit_ids", "evidence_ids", "question_keys")))
    g = cards.filter("k <> ''").withColumn("end", ends).groupBy("candidate", "end").agg(held.alias("h")).filter(F.size("h") > 1)
    union = lambda name: F.array_distinct(F.flatten(F.col("h." + name)))
    first = lambda name: F.col("h")[0][name]
    merged = F.struct(
        first("question").alias("question"), first("hint").alias("hint"), F.substring(F.array_join("h.answer", "\n"), 1, 1200).alias("answer"),
        union("unit_ids").alias("unit_ids"), union("evidence_ids").alias("evidence_ids"), union("question_keys").alias("question_keys"),
    )
    claims = F.flatten(F.transform("h.answer", lambda a: F.split(a, M.CLAIM_ENDS)))
    claims = F.transform(claims, lambda x: F.regexp_replace(x, M.CLAIM_MARK, ""))
    plan = g.select(
        "candidate", "end", F.col("h.card").alias("card_indexes"), F.col("end").alias("topic"), F.col("end").alias("reason"), first("question").alias("target"),
        F.array("end").alias("hint_topics"), union("unit_ids").alias("unit_ids"), union("evidence_ids").alias("evidence_ids"), claims.alias("claims"), merged.alias("merged"),
    )
    return cards.drop("k"), plan.withColumn("group", F.row_number().over(Window.partitionBy("candidate").orderBy("card_indexes", "end"))).drop("end")


@query("fm12_merge_verdicts", _MERGES + "select candidate, accepted, z.f as fault, z.g as fault_group from v")
def fm12_verdicts(spark, d):
    return M.verdicts(*_merge_plan(spark, d))


@query("fm12_merged_cards", _MERGES + """, a as (select f.* from f join v using (candidate) where accepted)
select candidate, card, c.question, c.hint, c.answer, false as merged from c where not exists (select 1 from a where a.candidate = c.candidate and list_contains(a.cards, c.card))
union all select candidate, head, question, hint, answer, true from a""")
def fm12_cards(spark, d):
    return M.applied(*_merge_plan(spark, d)).select("candidate", "card", "question", "hint", "answer", "merged")


@query("fm12_fingerprints", _MERGES + r""", i as (select candidate, 'question:' || lower(regexp_replace(question, '[^\p{L}\p{N}]+', '', 'g')) as v from c union
  select candidate, 'unit:' || w from (select candidate, unnest(regexp_split_to_array(lower(answer), '[^\p{L}\p{N}]+')) as w from c) where w <> '' union select candidate, 'evidence:' || turn from c)
select candidate, count(*) as n_items, sum(('0x' || substr(md5(v), 1, 15))::bigint)::varchar as item_sum from i where v <> 'question:' group by 1""")
def fm12_fingerprints(spark, d):
    return M.fingerprints(_merge_plan(spark, d)[0])
