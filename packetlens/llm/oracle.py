"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {
    "op7_decontamination": r"""
        with words as (
            select 'd' as kind, doc_id, '' as item_id, text from documents
            union all select 'b', null, cast(item_id as varchar), text from benchmark
        ), split as (
            select kind, doc_id, item_id, row_number() over () as row_id, regexp_extract_all(
                translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from words
        ), windows as (
            select distinct item_id, least(len(w), 10) as n, unnest(list_transform(
                range(1, greatest(len(w) - 9, 1) + 1),
                lambda i: array_to_string(w[i:i + 9], ' '))) as g
            from split where kind = 'b' and len(w) > 0
        ), sizes as (select distinct n from windows),
        places as (
            select row_id, n, unnest(range(1, len(w) - n + 2)) as i,
                unnest(list_transform(range(1, len(w) - n + 2),
                    lambda i: array_to_string(w[i:i + n - 1], ' '))) as g
            from split, sizes where kind = 'd' and len(w) >= n
        ), hits as (select row_id, item_id, i, n from places join windows using (n, g)),
        hit_words as (
            select row_id, count(distinct p) as n_hit
            from (select row_id, unnest(range(i, i + n)) as p from hits) group by 1
        ), hit_items as (
            select row_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
            from (select distinct row_id, item_id from hits) group by 1
        )
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit,
            coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 as contaminated
        from split left join hit_words using (row_id) left join hit_items using (row_id)
        where kind = 'd'
    """,
    "op10_near_dedup": r"""
        with recursive words as (
            select doc_id, list_filter(
                string_split_regex(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') as w
            from documents
        ), sets as (
            select doc_id, list_distinct(case
                when len(w) = 0 then []
                when len(w) < 5 then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                end) as s
            from words
        ), items as (select doc_id, unnest(s) as g from sets),
        pairs as (
            select a.doc_id as a, b.doc_id as b, count(*) as common
            from items a join items b on a.g = b.g and a.doc_id < b.doc_id group by all
        ), links as (
            select a, b from pairs
            join sets x on x.doc_id = a join sets y on y.doc_id = b
            where 100 * common >= 75 * (len(x.s) + len(y.s) - common)
        ), both_ways as (select a, b from links union all select b, a from links),
        reach as (
            select doc_id as a, doc_id as b from documents
            union
            select r.a, l.b from reach r join both_ways l on r.b = l.a
        ), least as (select a as doc_id, min(b) as component_id from reach group by a)
        select doc_id, cast(len(s) as bigint) as n_shingles, component_id,
            doc_id = component_id as kept
        from sets join least using (doc_id)
    """,
    "op12_ranked_search": r"""
        with words as (
            select row_number() over () as row_id, doc_id, regexp_extract_all(
                translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
            from documents
        ), size as (
            select cast(count(*) filter (len(w) > 0) as bigint) as docs,
                cast(sum(len(w)) as bigint) as terms
            from words
        ), item_terms as (
            select distinct item_row, item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from (select row_number() over () as item_row, item_id, text from benchmark)
        ), counts as (
            select row_id, term, count(*) as tf
            from (select row_id, unnest(w) as term from words)
            where term in (select term from item_terms) group by all
        ), weights as (
            select term, cast(floor(1000 * ln((2.0::double * any_value(docs) + 2) / (2 * count(*) + 1)))
                as bigint) as weight
            from counts, size group by term
        ), norms as (
            select row_id, doc_id, 100 - 90 + ((90 * len(w) * docs) // terms) as m
            from words, size where len(w) > 0
        ), scores as (
            select item_row, item_id, row_id, doc_id, cast(sum(
                weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
            from item_terms join counts using (term) join weights using (term) join norms using (row_id)
            group by all
        ), ranked as (
            select *, row_number() over (
                partition by item_row order by score desc, doc_id nulls last) as place
            from scores where score > 0
        )
        select item_id, cast(place as integer) as rank, doc_id, score from ranked where place <= 10
    """,
    "op13_repair": r"""
        with recursive keyed as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
            from conversations
        ), crc_table as (
            select i, list_reduce(range(0, 9), lambda c, s: case when s = 0 then c when c % 2 = 1
                then xor(c // 2, 3988292384) else c // 2 end, i) as v
            from range(256) t(i)
        ), crc_list as (select list(v order by i) as v from crc_table),
        kinds as (
            select *, xor(list_reduce(list_prepend(4294967295::bigint,
                list_transform(range(1, length(k) + 1), lambda p: cast(ascii(k[p]) as bigint))),
                lambda c, b: xor(c // 256, v[1 + (xor(c, b) & 255)])), 4294967295::bigint) % 20 as kind
            from keyed, crc_list
        ), damaged as (
            select conv_id, turn, case when kind = 4 then 'user' else role end as role,
                case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
                unnest(case when kind = 3 then [0, 1] else [0] end) as copy
            from kinds where kind <> 0
        ), placed as (
            select *, row_number() over c as i, lag(left(role, 1)) over c as before,
                rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed,
                row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth
            from damaged
            window c as (partition by conv_id order by turn nulls first, role, sha256(text), copy)
        ), faults as (
            select conv_id, i, left(role, 1) as initial, before, turn, role, text,
                trimmed = '' as blank, trimmed <> '' and nth > 1 as duplicate,
                trimmed <> '' and nth = 1 and right(trimmed, 1) not in ('.', '!', '?') as truncated
            from placed
        ), walk as (
            select conv_id, cast(0 as bigint) as i, {'c': 0, 'a': ''} as s0, {'c': 999999999, 'a': ''} as s1,
                {'c': 999999999, 'a': ''} as s2, {'c': 999999999, 'a': ''} as s3
            from (select distinct conv_id from conversations)
            union all
            select conv_id, i, list_min([d0]) as s0, list_min([d1, s]) as s1,
                list_min([d2, u, r2]) as s2, list_min([d3, a, r3]) as s3
            from (
                select conv_id, i, {'c': s0.c + 3, 'a': s0.a || 'D'} as d0, {'c': s1.c + 3, 'a': s1.a || 'D'} as d1,
                    {'c': s2.c + 3, 'a': s2.a || 'D'} as d2, {'c': s3.c + 3, 'a': s3.a || 'D'} as d3,
                    {'c': s0.c + late + if(initial = 's', gone, 999999999), 'a': s0.a || 'K'} as s,
                    {'c': f.c + late + if(initial = 'u', gone, 999999999), 'a': f.a || 'K'} as u,
                    {'c': e2.c + late + if(initial = 'a', gone, 999999999), 'a': e2.a || 'K'} as a,
                    {'c': f.c + late + 2 + gone, 'a': f.a || 'R'} as r2,
                    {'c': e2.c + late + 2 + gone, 'a': e2.a || 'R'} as r3
                from (
                    select *, list_min([s0, s1, e3]) as f,
                        list_min([s2, {'c': s0.c + 2, 'a': s0.a || 'I'}, {'c': s1.c + 2, 'a': s1.a || 'I'},
                            {'c': s3.c + 2, 'a': s3.a || 'I'}]) as e2
                    from (
                        select w.conv_id, g.i, s0, s1, s2, s3, initial,
                            if(truncated, 1, 0) as late, if(blank or duplicate, 999999999, 0) as gone,
                            list_min([s3, {'c': s2.c + 2, 'a': s2.a || 'I'}, {'c': s0.c + 4, 'a': s0.a || 'II'},
                                {'c': s1.c + 4, 'a': s1.a || 'II'}]) as e3
                        from walk w join faults g on w.conv_id is not distinct from g.conv_id and g.i = w.i + 1
                    )
                )
            )
        ), ends as (
            select conv_id, list_min([s0, s3, {'c': s2.c + 2, 'a': s2.a || 'I'}, {'c': s1.c + 4, 'a': s1.a || 'II'}]) as e
            from walk qualify row_number() over (partition by conv_id order by i desc) = 1
        ), letters as (
            select conv_id, e.a as audit, unnest(range(1, length(e.a) + 1)) as p from ends
        ), edits as (
            select conv_id, p, audit[p] as x,
                count(*) filter (audit[p] <> 'I') over (partition by conv_id order by p) as i
            from letters
        ), kept as (
            select e.conv_id, p, x, initial, role, text,
                row_number() over (partition by e.conv_id order by p) as place
            from edits e left join faults f on e.conv_id is not distinct from f.conv_id and e.i = f.i and x <> 'I'
            where x <> 'D'
        ), headed as (
            select *, max(if(place = 1 and x = 'K' and initial = 's', 1, 0)) over (partition by conv_id) as has_s
            from kept
        ), mended as (
            select conv_id, sha256(string_agg(
                case when x = 'K' then role when (place - has_s) % 2 = 1 then 'user' else 'assistant' end
                || ':' || case when x = 'I' then '' else text end, chr(10) order by place)) as sha
            from headed group by conv_id
        ), counts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
                count(*) filter (truncated) as truncated,
                count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal
            from faults group by conv_id
        )
        select ends.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank,
            coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
            coalesce(illegal, 0) as illegal, cast(e.c as bigint) as cost, e.a as audit,
            coalesce(sha, sha256('')) as repaired_sha256
        from ends left join counts on ends.conv_id is not distinct from counts.conv_id
        left join mended on ends.conv_id is not distinct from mended.conv_id
    """,
}
