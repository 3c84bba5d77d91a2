"""DuckDB SQL of the morphology and decision queries, written from a profile's values: rules restated over relations."""

from __future__ import annotations

from morphlake.profile import LanguageProfile


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(map(_text, sorted(set(values)))) + ")"


def _array(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]::varchar[]"


def sounds(p: LanguageProfile, source: str, name: str) -> str:
    """CTEs ending in `name` (word, valid, errors, warnings) for the distinct words of `source` (word)."""
    vowel = lambda c: f"({c} <> '' and contains({_text(p.vowels)}, {c}))"
    allowed = {*p.codas, *p.extra_codas, *p.loan_finals, *p.vowels}
    return f"""{name}_s as (select word, i, s, length(s) as n, substr(s, 1, 1) as a, substr(s, 2, 1) as b, substr(s, 3, 1) as c, substr(s, 1, 2) as two, substr(s, 1, 3) as three,
        substr(s, greatest(length(s) - 1, 1)) as e2, substr(s, greatest(length(s), 1)) as e1
        from (select word, unnest(range(1, len(l) + 1)) as i, unnest(l) as s from (select word, list_filter(string_split(word, '-'), lambda x: x <> '') as l from (select distinct word from {source})))),
    {name}_e as (select word, i, s, n, e1, list_filter([
        case when translate(case when a = '''' then substr(s, 2) else s end, {_text(p.vowels)}, '') = case when a = '''' then substr(s, 2) else s end then 'no_vowel' end,
        case when a <> '''' and n >= 2 and not {vowel("a")} and not {vowel("b")} and three not in {_list(p.clusters)} and case when two in {_list(p.digraphs)} then n >= 3 and not {vowel("c")} else two not in {_list(p.clusters)} end then 'onset' end,
        case when n >= 2 and e2 not in {_list(p.digraphs)} and not {vowel("substr(e2, 1, 1)")} and not {vowel("e1")} and e2 not in {_list(p.geminates)} then 'final_cluster' end,
        case when e2 in {_list(p.aspirates)} then 'final_aspirate' end,
        case when case when e2 in {_list(p.digraphs)} then e2 else e1 end not in {_list(allowed)} then 'coda' end, case when ends_with(s, 'dz') then 'final_dz' end], lambda x: x is not null) as er,
        list_filter([case when e1 in {_list(p.loan_finals)} then 'loan_final' end, case when n > 12 then 'long_segment' end], lambda x: x is not null) as wa from {name}_s),
    {name}_w as (select word, flatten(list(er order by i)) as er, flatten(list(wa order by i)) as wa from {name}_e group by word),
    {name} as (select word, len(er) = 0 as valid, array_to_string(er, ';') as errors, array_to_string(wa, ';') as warnings from (select d.word,
        case when d.word = '' then ['empty'] when d.word in {_list(p.exceptions)} then [] when d.word in {_list(p.invalid_alone)} then ['invalid_alone'] else coalesce(er, []) || list_filter([
            case when translate(d.word, {_text(p.letters)}, '') <> '' then 'illegal_characters' end, case when d.word <> '' and contains({_text(p.no_final_vowels)}, translate(right(d.word, 1), 'áéíóúý', 'aeiouy')) then 'final_vowel' end], lambda x: x is not null) end as er,
        case when d.word in {_list(p.exceptions)} then ['exception'] else coalesce(wa, []) end as wa from (select distinct word from {source}) d left join {name}_w using (word)))"""


def parses(p: LanguageProfile, source: str, roots: str, name: str) -> str:
    """CTEs ending in `name`: ranked parses of the words of `source` (word) over `roots` (word, pos)."""
    own = [x for x in p.prefixes if x.productive]
    prefix = ", ".join(f"({_text(x.form)}, {_array(x.applies_to)})" for x in own)
    suffix = ", ".join(f"({_text(v)}, {_array(s.applies_to)}, {_array(s.hosts)})" for s in p.suffixes for v in (s.form, *s.variants))
    digraphs = "|".join(p.digraphs)
    fits = lambda pos, targets: f"(len({targets}) = 0 or list_contains(list_transform({targets}, lambda t: lower(t)), lower({pos})))"
    strip = lambda above: f"""select word, substr(rest, length(x.form) + 1) as rest, list_append(used, x.form) as used, list_append(o.targets, x.targets) as targets
        from {above} o join {name}_p x on starts_with(rest, x.form) and length(rest) > length(x.form) + 1 and not list_contains(used, x.form)"""  # noqa: E731
    infixes = " union all ".join(
        f"""select word, 'infix_detected' as status, root, true as root_known, r.pos, []::varchar[] as prefixes, null as suffix, {_text(x.form)} as infix from
        (select word, head || substr(word, length(head) + {len(x.form) + 1}) as root from (select word, regexp_extract(word, '^({digraphs}|.)', 1) as head from {name}_q)
         where starts_with(substr(word, length(head) + 1), {_text(x.form)}) and length(word) > length(head) + {len(x.form)}) join {name}_r r on r.word2 = root"""
        for x in p.infixes
    )
    return f"""{name}_q as (select distinct word from {source}), {name}_r as (select distinct word as word2, pos from {roots}),
    {name}_p(form, targets) as (values {prefix}), {name}_x(form, targets, hosts) as (values {suffix}),
    {name}_0 as (select word, word as rest, []::varchar[] as used, []::varchar[][] as targets from {name}_q), {name}_1 as ({strip(name + "_0")}), {name}_2 as ({strip(name + "_1")}), {name}_3 as ({strip(name + "_2")}),
    {name}_l as (select rest as word from {name}_1 where rest not in (select word2 from {name}_r)), {sounds(p, name + "_l", name + "_v")},
    {name}_c as (select word, 'direct_match' as status, word as root, true as root_known, pos, []::varchar[] as prefixes, null as suffix, null as infix from {name}_q join {name}_r on word = word2
        union all select word, case when len(used) = 1 then 'derived_form' else 'stacked_form' end, rest, true, pos, used, null, null from (from {name}_1 union all from {name}_2 union all from {name}_3) join {name}_r on rest = word2
            where len(list_filter(targets, lambda t: not {fits("pos", "t")})) = 0
        union all select q.word, 'suffix_stripped', word2, true, pos, [], form, null from {name}_q q join {name}_x on ends_with(q.word, form) and length(q.word) > length(form) + 1
            join {name}_r on word2 = left(q.word, length(q.word) - length(form)) where (len(hosts) = 0 or list_contains(hosts, word2)) and {fits("pos", "targets")}
        union all {infixes}
        union all select c.word, 'derived_form', rest, false, null, used, null, null from {name}_1 c join {name}_v v on v.word = rest where v.valid),
    {name}_g as (select word, status, root, root_known, prefixes, suffix, infix, len(prefixes) + (suffix is not null)::int + (infix is not null)::int as n from {name}_c group by all),
    {name}_k as (select *, round((case when status = 'direct_match' then 2.0 else 0.0 end + case when root_known then 1.0 + 0.5 * n + case when n > 0 then 0.4 else 0 end else -0.5 + 0.2 * n end
        + case when len(prefixes) > 0 then 0.3 else 0 end - 0.05 * greatest(0, n - 1))::double, 3) as score from {name}_g),
    {name} as (select *, row_number() over (partition by word order by status <> 'direct_match', score desc, root_known desc, n, length(root) desc, root, array_to_string(prefixes, '-'), status) as rank, count(*) over (partition by word) as parses from {name}_k)"""


def phonotactics(cte: str, p: LanguageProfile) -> str:
    return f"with {cte}, {sounds(p, 'cnt', 'snd')} select word, valid, errors, warnings from snd"


def morph_parses(cte: str, p: LanguageProfile) -> str:
    return f"""with {cte}, rts as (select surface as word, pos from lexi), {parses(p, "cnt", "rts", "par")}
    select word, status, root, root_known, array_to_string(prefixes || [root] || case when suffix is null then [] else [suffix] end, ' → ') as chain, score, (parses - 1)::int as n_alternatives from par where rank = 1"""


def compound_splits(cte: str, p: LanguageProfile) -> str:
    blocked = [*p.free_morphemes, *p.clitics]
    return f"""with {cte}, {sounds(p, "(select surface as word from lexi)", "snd")}, ok as (select surface as w, pos from lexi join snd on snd.word = surface where valid),
    cut as (select word, k, left(word, k) as l, substr(word, k + 1) as r from (select word, unnest(range(3, length(word) - 2)) as k from cnt where length(word) >= 6)),
    best as (select word, arg_min({{'l': l, 'r': r, 'p': a.pos, 'q': b.pos}}, (abs(length(l) - length(r)), k)) as m from cut join ok a on a.w = l join ok b on b.w = r
        where l not in {_list([*blocked, *(x.form for x in p.prefixes)])} and r not in {_list(blocked)} group by word),
    tag as (select 'noun' as pos, 'N' as t union all select 'verb', 'V' union all select 'adj', 'ADJ' union all select 'adv', 'ADJ')
    select word, m.l as left, m.r as right, true as both_open, x.t || '+' || y.t as pattern from best join tag x on x.pos = m.p join tag y on y.pos = m.q"""


def sandhi_reverse(cte: str, p: LanguageProfile) -> str:
    rules = ", ".join(f"({i}, {_text(r.id)}, {_text(r.trigger)}, {_text(r.initials)}, {_text(r.surface)}, {_array(r.exceptions)}, {_text(r.kind)})" for i, r in enumerate(p.sandhi) if r.kind != "never")
    return f"""with {cte}, rl(i, id, trig, ini, surf, exc, kind) as (values {rules}),
    f as (select word, arg_min({{'id': id, 't': trig, 'r': substr(word, length(surf) + 1)}}, i) as m from cnt join rl on starts_with(word, surf) and length(word) > length(surf)
        and case when kind = 'geminate' then starts_with(substr(word, length(surf) + 1), ini) else contains(ini, substr(word, length(surf) + 1, 1)) end and not list_contains(exc, trig || substr(word, length(surf) + 1)) group by word)
    select cnt.word, m.id as rule_id, m.t as reconstructed_prefix, m.r as reconstructed_root, case when m is not null then m.r in (select root from lexi) end as root_confirmed from cnt left join f on f.word = cnt.word"""


def word_votes(cte: str, p: LanguageProfile) -> str:
    fold = lambda c: f"translate(translate({c}, 'ïñáéíóúý', 'inaeiouy'), '''', '')"
    return f"""with {cte}, rts as (select surface as word, pos from lexi union select root, pos from lexi), {parses(p, "cnt", "rts", "par")}, {sounds(p, "cnt", "snd")},
    fr as (select word as w, round_even(log2(1 + count) * 2, 0) >= 10 as high from cnt where count >= 5),
    v as (select cnt.word, cnt.word in (select surface from lexi) or {fold("cnt.word")} in (select {fold("surface")} from lexi) as known, b.n > 0 as affixed,
            b.root_known and b.root not in {_list(p.closed_roots)} as plausible, snd.valid as sound, coalesce(high, false) as high
        from cnt left join (select * from par where rank = 1) b on b.word = cnt.word join snd on snd.word = cnt.word left join fr on fr.w = cnt.word)
    select word, known as in_lexicon, known or coalesce(affixed, false) as morph_valid, sound as phon_valid,
        array_to_string(list_filter([case when high then 'frequent' end, case when known then 'in_lexicon' end, case when affixed then 'morphology' end, case when sound then 'phonotactic' end], lambda x: x is not null), ',') as signals,
        (case when known then 3 else 0 end + case when affixed then case when plausible then 2 else 1 end else 0 end + case when sound then 1 else 0 end + case when high then 2 else 0 end)::int as score from v"""


SIGN_TEST = """with r as (select count(*) filter (n_chars % 3 <> 0 and n_chars % 5 < 2) as fixed, count(*) filter (n_chars % 3 = 0 and n_chars % 5 >= 2) as broken from documents),
    s as (select fixed, broken, fixed + broken as n, unnest(range(0, least(fixed, broken) + 1)) as i from r)
    select fixed, broken, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 9) as p_value from s group by fixed, broken"""


def rate_limits(rules: tuple[tuple[int, int], ...]) -> str:
    """Decisions of two windows, event by event of each visitor."""
    (l1, w1), (l2, w2) = rules
    return f"""with recursive e as (select event_id, user_id as key, epoch(ts)::double as t, row_number() over (partition by user_id order by ts, event_id) as rn from events where user_id is not null and ts is not null),
    d as (select event_id, key, t, rn, t as o1, 1 as n1, t as o2, 1 as n2, null::bigint as wait from e where rn = 1
        union all select event_id, key, t, rn, o1, case when wait is null then n1 + 1 else n1 end, o2, case when wait is null then n2 + 1 else n2 end, wait
        from (select *, case when n1 >= {l1} or n2 >= {l2} then greatest(1, ceil(greatest(case when n1 >= {l1} then o1 + {w1} - t else 0 end, case when n2 >= {l2} then o2 + {w2} - t else 0 end)))::bigint end as wait
            from (select e.event_id, e.key, e.t, e.rn, case when d.o1 + {w1} <= e.t then e.t else d.o1 end as o1, case when d.o1 + {w1} <= e.t then 0 else d.n1 end as n1,
                case when d.o2 + {w2} <= e.t then e.t else d.o2 end as o2, case when d.o2 + {w2} <= e.t then 0 else d.n2 end as n2 from d join e on e.key = d.key and e.rn = d.rn + 1)))
    select event_id, key, t as ts, wait from d union all select event_id, user_id, epoch(ts)::double, null from events where user_id is null or ts is null"""


def complex_words(cte: str, p: LanguageProfile) -> str:
    """Hyphenated patterns and solid compounds."""
    bare = lambda c: f"translate({c}, {_text(p.vowels)}, '')"
    solid = compound_splits(cte, p).split("select word, m.l as left", 1)[0]
    return f"""{solid}, h as (select word, x[1] as a, x[2] as b, x[3] as c, len(x) as n from (select word, string_split(word, '-') as x from cnt)),
    k as (select word, a, b, case when n = 3 and b = c then 'triplication' when n = 3 and a = c and b in {_list(p.interfixes_a)} then 'reduplication_interfix_A' when n = 3 and a = c and b in {_list(p.interfixes_b)} then 'reduplication_interfix_B'
        when n = 2 and a = b then 'total_reduplication' when n = 2 and {bare("a")} = {bare("b")} and {bare("a")} <> '' then 'partial_reduplication_vowel'
        when n = 2 and (a in (select surface from lexi) or b in (select surface from lexi)) then 'compound_hyphenated' when n = 2 then 'potential_compound' end as type from h where n > 1)
    select word, type, case when type in ('reduplication_interfix_A', 'reduplication_interfix_B', 'total_reduplication') then a else a || '+' || b end as components from k where type is not null
    union all select word, 'compound_fusion', m.l || '+' || m.r from best where not contains(word, '-')"""


def welded(cte: str, floor: int, p: LanguageProfile) -> str:
    fold = lambda c: f"translate(translate({c}, 'ïñáéíóúý', 'inaeiouy'), '''', '')"
    return f"""with {cte}, s as (select word, unnest(range(1, length(word))) as k from cnt where count < {floor}), h as (select word, k, left(word, k) as head, substr(word, k + 1) as rest from s)
    select word, arg_min(head, k) as head, arg_min(rest, k) as rest from h where head in {_list(p.free_morphemes)} and length(rest) >= 2 and {fold("rest")} in (select {fold("word")} from cnt where count >= {floor}) group by word"""


def missing_space(cte: str, floor: int) -> str:
    plain = "translate(translate(word, 'ïñáéíóúýÏÑÁÉÍÓÚÝ', 'inaeiouyINAEIOUY'), '''', '')"
    return f"""with {cte}, a as (select surface || root as word from lexi union select word from cnt), known as (select word from cnt where count >= {floor}),
    c as (select word, unnest(range(1, length(word))) as k from cnt where count >= {floor}),
    f as (select distinct word from c where (k > 1 or left(word, k) in ('u', 'i')) and (length(word) - k > 1 or substr(word, k + 1) in ('u', 'i')) and left(word, k) in (from known) and substr(word, k + 1) in (from known))
    select word from a where word in (from f) or (not contains(word, '-') and {plain} not in (select word from cnt))"""


def edit_candidates(cte: str, p: LanguageProfile) -> str:
    """Orthographic rewrites, in their order, and repairs of banned letters, sorted."""
    vowels = "aáeéiíoóuúyýï"
    between = f"'([^{vowels}])e([^{vowels}])', '\\1ie\\2', 'g'"
    table = " ".join(f"when {_text(k)} then {_array(v)}" for k, v in p.banned.items())
    pairs = ", ".join(f"case when contains(w, {_text(a)}) then replace(w, {_text(a)}, {_text(b)}) end" for a, b in p.banned_pairs)
    return f"""with {cte}, c as (select word as w, string_split(word, '') as cs, length(word) as n from cnt),
    t as (select w, [array_to_string(list_filter(cs, lambda x, i: i = 1 or x <> cs[i - 1] or contains('{vowels}', x)), ''), case when ends_with(w, 'ng') and not ends_with(w, 'ang') then left(w, n - 2) || 'n' end,
            case when ends_with(w, 'n') then w || 'g' end, case when ends_with(w, 'gn') then left(w, n - 2) || 'ng' end, case when ends_with(w, 'g') and not ends_with(w, 'ng') then left(w, n - 1) || 'ng' end,
            case when contains(w, 'ie') then regexp_replace(w, 'ie', 'i') end, case when contains(w, 'ie') then regexp_replace(w, 'ie', 'e') end, case when contains(w, 'ei') then regexp_replace(w, 'ei', 'ie') end,
            case when not contains(w, 'ie') then regexp_replace(regexp_replace(w, {between}), {between}) end] as l,
        [{pairs}] || flatten(list_transform(range(1, n + 1), lambda i: list_transform(case substr(w, i, 1) {table} else []::varchar[] end, lambda r: left(w, i - 1) || r || substr(w, i + 1)))) as b from c),
    k as (select w, list_filter(l, lambda x: x is not null and x <> w and length(x) >= 2) as l, list_distinct(list_filter(b, lambda x: x is not null and x <> w and x <> '')) as b from t)
    select w as word, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as normalised, array_to_string(list_sort(b)[1:12], ' ') as repairs from k"""


def pool_tally(cte: str, deletes: str, headwords: int, floor: int, banned: str, latin: str, p: LanguageProfile) -> str:
    """How many corpus words each admission test stops; headwords are the types of so many occurrences."""
    fold = lambda c: f"translate(translate({c}, 'ïñáéíóúý', 'inaeiouy'), '''', '')"
    restored = """regexp_replace(case when starts_with(word, 'ia') then 'ï' || substr(word, 2) when starts_with(word, 'jingia') then 'jingï' || substr(word, 6)
        when starts_with(word, 'pynia') then 'pynï' || substr(word, 5) when starts_with(word, 'nongia') then 'nongï' || substr(word, 6) else word end, 'ain$', 'aiñ')"""
    return f"""with {cte}, lx as (select word as surface, case when length(word) > 6 then left(word, length(word) - 3) else word end as root from cnt where count >= {headwords}),
    forms as (select surface as word from lx union select root from lx), hi as (select word, count from cnt where count >= {floor}), {sounds(p, "hi", "snd")},
    x as (select word, count, unnest({deletes}) as deletion from cnt), pr as (select distinct a.word, b.word as nb from x a join x b using (deletion) where a.count >= {floor} and a.word <> b.word and b.count >= a.count * 5),
    dom as (select distinct word from pr where damerau_levenshtein(translate(word, 'ñï', '12'), translate(nb, 'ñï', '12')) = 1
        and regexp_full_match(coalesce(array_to_string(list_filter(string_split(nb, ''), lambda x: not list_contains(string_split(word, ''), x)), ''), ''), '[a-z]*')),
    r as (select word, count, {restored} as made from hi),
    c as (select word, count, case when ends_with(made, 'aiñ') and not ends_with(word, 'aiñ') then regexp_replace(made, 'aiñ$', 'ain') else made end as canon from r),
    d as (select c.word, count, case when c.word in (from forms) or {fold("c.word")} in (select {fold("surface")} from lx) then 'in_lexicon' when translate(c.word, {_text(latin)}, '') <> '' then 'foreign_char'
        when translate(c.word, {_text(banned)}, '') <> c.word then 'banned_letter' when translate(c.word, 'ïñ', 'in') in (select translate(word, 'ïñ', 'in') from forms) then 'folds_onto_headword' when not valid then 'phonotactic'
        when c.word in (from dom) then 'dominated' when canon <> c.word and canon in (from forms) then 'restored_onto_headword' else 'admitted' end as reason from c join snd on snd.word = c.word
        union all select word, count, 'below_floor' from cnt where count < {floor})
    select reason, count(*) as words, sum(count)::bigint as occurrences from d group by reason"""


def lexicon_repair(cte: str, p: LanguageProfile) -> str:
    """Outcomes of the standard rules over entries made to need some of them."""
    rules = {
        "white_space": r"trim(regexp_replace(s, '\s+', ' ', 'g'))", "trailing_hyphen": "regexp_replace(s, '-+$', '')",
        "brackets": r"trim(regexp_replace(regexp_replace(s, '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g'), '\s+', ' ', 'g'))", "double_i": "regexp_replace(s, 'i[iï]', 'ïi', 'g')",
        "opening_ia": r"regexp_replace(regexp_replace(s, '^ia', 'ïa'), '^I([aA])', 'Ï\1')", "closing_tilde": "regexp_replace(s, 'ain$', 'aiñ')", "umlaut": "translate(s, 'äëöü', 'aeou')",
        "apostrophes": "translate(s, '’ʼ`', '''''''')", "marks": r"regexp_replace(s, '[\^~«»•|{}\\]', '', 'g')",
    }
    first = ", ".join(f"case when {e} <> s and {e} <> '' then {{'rule': '{k}', 'made': {e}}} end" for k, e in rules.items())
    return f"""with {cte}, b as (select md5(surface) as id, case when length(surface) % 5 = 0 then surface || '-' when length(surface) % 7 = 0 then surface || ' (n.)' else surface end as s, lower('gloss of ' || surface) as g from lexi),
    f as (select id, s, g, list_filter([{first}], lambda x: x is not null)[1] as m from b),
    met as (select f.id, bool_or(contains(f.g, b.g) or contains(b.g, f.g)) as same from f join b on lower(f.m.made) = lower(b.s) and f.id <> b.id group by f.id),
    w as (select id, unnest(string_split_regex(lower(coalesce(m.made, s)), '\\s+')) as word from f), {sounds(p, "w", "snd")},
    bad as (select distinct id from w join snd using (word) where not valid)
    select case when same then 'duplicate' when same is not null then 'conflict' when bad.id is not null then 'quarantine' when m is not null then 'rewrite' else 'keep' end as outcome, m.rule as rule, count(*) as n
    from f left join met on met.id = f.id left join bad on bad.id = f.id group by 1, 2"""


def transcriptions(cte: str) -> str:
    """Sounds of graphemes between their neighbours, part by part of hyphenated words."""
    from morphlake.functions import phonetics as g2p

    units = "|".join(sorted((*g2p.CONSONANTS, *g2p.VOWELS), key=len, reverse=True))
    cuts = lambda c: f"regexp_extract_all({c}, {_text('(?s)' + units + '|.')})"
    table = lambda d: "map([" + ", ".join(map(_text, d)) + "], [" + ", ".join(map(_text, d.values())) + "])"
    vowel = lambda x: f"coalesce(list_contains({_array(g2p.VOWELS)}, {x}), false)"
    consonant = lambda x: f"coalesce(list_contains({_array(g2p.CONSONANTS)}, {x}), false)"
    closing = f"(g[i + 1] is null and i > 1 and {vowel('g[i - 1]')})"
    sound = f"""case when {consonant("x")} then case when x = 'h' and {closing} then 'ʔ' when x in ('t', 'd') and {closing} and ends_with(g[i - 1], 'i') then 'c' else {table(g2p.CONSONANTS)}[x] end
        when not {vowel("x")} then x when x = 'y' and {vowel("g[i + 1]")} then 'ʔ' when x = 'ï' and {vowel("g[i + 1]")} then 'j'
        when {table(g2p.VOWELS)}[x] = 'i' and x not in ('y', 'ï') and {consonant("g[i + 1]")} and g[i + 1] <> 'h' and not {vowel("g[i + 2]")} then 'ɪ' else {table(g2p.VOWELS)}[x] end"""
    return f"""with {cte}, p as (select word, unnest(range(1, len(l) + 1)) as k, unnest(l) as part from (select word, string_split(word, '-') as l from cnt)),
    g as (select word, k, {cuts("part")} as g from p), s as (select word, string_agg(array_to_string(list_transform(g, lambda x, i: {sound}), ''), '-' order by k) as ipa from g group by word)
    select word, '/' || ipa || '/' as surface, '{g2p.VERSION}' as generated_by, not contains(word, '-') and len(list_filter({cuts("word")}, lambda x: {vowel("x")})) = 1
        and list_contains({_array(g2p.LONG_FINALS)}, {cuts("word")}[-1]) as needs_review from s"""
