"""DuckDB SQL of the operators' queries that SQL can express, written from their
contracts on the tables and without the hashing that the Spark queries use."""

from __future__ import annotations

SPACE = r"\x20\x09-\x0D"
BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def warc_sql() -> str:
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::int >> {s}) & 31), 1)"
        for i in range(8) for s in (15, 10, 5, 0))
    return f"""
    with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
    f as (select h, min(page_id) as least from p group by h)
    select p.page_id, strlen(body)::bigint as payload_bytes, {letters.replace("(h,", "(p.h,")} as payload_digest,
      case when least = p.page_id then 'response' else 'revisit' end as record_type,
      case when least <> p.page_id then least end as refers_to
    from p join f on p.h = f.h"""


def quality_sql(max_rate: float) -> str:
    return f"""
    with d as (select doc_id, source, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') as w from documents),
    lines as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
    dup as (select doc_id, count(*) - count(distinct line) as n from lines
        where trim(line, {BLANK}) <> '' group by doc_id),
    win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as x
        from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
    many as (select doc_id, i, count(*) over (partition by doc_id, x) as n from win),
    rep as (select doc_id, sum(least(8, coalesce(step, 8))) as n from
        (select doc_id, lead(i) over (partition by doc_id order by i) - i as step from many where n > 1) group by doc_id),
    base as (select d.doc_id, d.source, len(w)::bigint as n_words,
        length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
        from d left join dup using (doc_id) left join rep using (doc_id)),
    judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base),
    hosts as (select source, count(*)::double as docs, count(*) filter (where base_failed)::double as failures
        from judged group by source),
    tot as (select sum(failures) / sum(docs) as m, sum(docs) as n, count(*)::double as h,
        sum(docs * (failures / docs) * (failures / docs)) / sum(docs) as sq from hosts),
    spread as (select m, n, h, m * (1 - m) as noise,
        case when n > h then (sq - m * m - m * (1 - m) * h / n) / (1 - h / n) end as between_hosts from tot),
    prior as (select m, case when h > 1 and n > h and between_hosts > 0
        then greatest(noise / between_hosts - 1, 1.0) else 1.0 end as k from spread)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      not base_failed and (failures + m * k) / (docs + k) <= {max_rate} as kept
    from judged join hosts on judged.source is not distinct from hosts.source, prior"""


def url_sql(rules: dict[str, str], blocked_hosts: list[str]) -> str:
    listed = ", ".join(f"('{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{a}')" for r, a in rules.items())
    hosts = ", ".join(f"('{h}')" for h in blocked_hosts)
    fits = "(u.host = x.host or ends_with(u.host, '.' || x.host))"
    return f"""
    with rules(rule, host, path, action) as (values {listed}), blocked(host) as (values {hosts}),
    p as (select page_id, coalesce(url, '') as url from pages),
    u as (select page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from p),
    best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
        from u join rules x on {fits} and starts_with(u.path, x.path) group by page_id),
    bad as (select distinct page_id from u join blocked x on {fits})
    select u.page_id, u.host, u.path, best.rule,
      coalesce(best.action, case when bad.page_id is null then 'allow' else 'block' end) as verdict
    from u left join best using (page_id) left join bad using (page_id)"""


def secret_sql(copied: int) -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
    keyword = "(?:" + "|".join(map(either, ("password", "passwd", "secret", "token"))) \
        + f"|{either('api')}_?{either('key')})"
    assign = keyword + r"""["'']?\x20*[:=]\x20*["'']?"""
    kinds = [(assign + "[A-Za-z0-9+/_.=-]+", "regexp_extract(hit, '^" + assign + "(.*)$', 1)"),
             ("AKIA[A-Z0-9]{16,}", "hit"), ("[0-9a-f]{24,}", "hit"), ("[A-Za-z0-9+/_-]{24,}={0,2}", "hit")]
    found = " union all ".join(f"""
        select doc_id, source, {rank} as rank, {value} as value, length(hit) as size,
            sum(gap + length(hit)) over (partition by doc_id order by i) as stop
        from (select doc_id, source, unnest(regexp_extract_all(t, '{pattern}')) as hit,
            unnest(list_transform(string_split_regex(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}'))],
                lambda x: length(x))) as gap,
            generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) as i from d)"""
                               for rank, (pattern, value) in enumerate(kinds))
    one = "list(kind || ':' || start || ':' || stop order by start, rank)"
    listed, base_listed = (f"array_to_string({one}{which}, ',')" for which in ("", " filter (where rank < 3)"))
    return f"""
    with d as (select doc_id, source, coalesce(text, '') as t from documents),
    hits as ({found}),
    spans as (select doc_id, source, rank, value, (stop - size)::bigint as start, stop::bigint as stop,
        ['assign', 'access', 'hex', 'token'][rank + 1] as kind from hits where length(value) >= 6
        and (rank < 3 or (length(regexp_replace(value, '[^0-9]', '', 'g')) >= 3
                          and length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= 3))),
    base as (select * from spans where rank < 3),
    more as (select * from spans m where rank = 3 and not exists (
        select 1 from base b where b.doc_id = m.doc_id and b.start < m.stop and m.start < b.stop)),
    every as (select * from base union all select * from more),
    repos as (select value, t, min_by(coalesce(source, ''), (source is not null, source)) as owner
        from (select every.value, every.source, d.t from every join d using (doc_id)) group by value, t),
    held as (select value, count(*) as repos, count(distinct owner) as owners from repos group by value),
    kept as (select e.*, h.owners < {copied} as is_live, h.repos || ':' || h.owners as held
        from every e join held h on e.value = h.value),
    per_doc as (select doc_id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access,
        count(*) filter (where rank = 2) as n_hex, {base_listed} as base,
        {listed} as spans, count(*) filter (where is_live) as n_live,
        array_to_string(list(held order by start, rank), ',') as held
        from kept where rank < 3 or is_live group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live,
      coalesce(held, '') as held
    from d left join per_doc using (doc_id)"""


def line_sql(ratio: float, min_pages: int) -> str:
    worded = f"trim(line, {BLANK}) <> ''"
    return f"""
    with totals as (select source, count(*) as n from documents group by source),
    lines as (select source, unnest(list_distinct(string_split(text, chr(10)))) as line from documents),
    drops as (select l.source, l.line from lines l join totals t on t.source is not distinct from l.source
        where {worded} group by l.source, l.line, t.n having count(*) >= {min_pages} and count(*) > {ratio} * t.n),
    host as (select source, list(line) as bad from drops group by source),
    cut as (select d.*, string_split(d.text, chr(10)) as every,
        list_filter(string_split(d.text, chr(10)), lambda line: not ({worded} and coalesce(list_contains(host.bad, line), false))) as kept
        from documents d left join host on d.source is not distinct from host.source)
    select doc_id, lang, source, n_chars, case when kept is null then text else array_to_string(kept, chr(10)) end as text,
      case when kept is null then 0 else len(every) - len(kept) end::bigint as n_dropped
    from cut"""


def cluster_sql(k: int, rounds: int, dim: int, scale: int) -> str:
    nearest = lambda n: f"""
    a{n} as (select v.vec_id, v.v, v.row, arg_min(c.c, (list_sum(list_transform(list_zip(v.v, c.v),
            lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.c)) as c,
        min(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::bigint as d
        from v, c{n} c group by v.vec_id, v.v, v.row)"""  # noqa: E731
    moved = lambda n: f"""
    s{n} as (select c, p, sum(x)::bigint as s, count(*) as n from
        (select c, unnest(v) as x, generate_subscripts(v, 1) as p from a{n}) group by c, p),
    c{n + 1} as (select c, list((s - ((s % n) + n) % n) // n order by p) as v from s{n} group by c
        union all select c, v from c{n} where c not in (select c from a{n}))"""  # noqa: E731
    steps = ",".join(part for n in range(rounds) for part in (nearest(n), moved(n)))
    return f"""
    with v as (select vec_id, row_number() over () as row,
            list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
        where len(embedding) = {dim} and len(list_filter(embedding, lambda x: isfinite(x))) = {dim}),
    c0 as (select row_number() over (order by h, v) - 1 as c, v from (select sha256('1:' || vec_id) as h, v from v)
        qualify c < {k}),{steps},{nearest(rounds)}
    select vec_id, a.c::integer as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia,
        (sum(d) over ())::bigint as inertia, sha256(array_to_string(f.v, ',')) as centroid_sha256
    from a{rounds} a join c{rounds} f on a.c = f.c"""


def top_k_sql(k: int, every: int, scale: int) -> str:
    return f"""
    with v as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
        where len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
    scored as (select q.vec_id as query_id, c.vec_id,
            list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
        from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {every} = 0)
    select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
    from scored qualify rank <= {k}"""


def repair_sql() -> str:
    crc = """xor(4294967295::bigint, list_reduce(flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0])),
        lambda acc, b: xor(xor(acc, b) >> 1, 3988292384::bigint * (xor(acc, b) & 1)), 4294967295::bigint))"""
    best = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda z: z is not null))"

    def add(state, cost, letter, line=None, when="true"):
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"case when {state} is not null and {when} then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}} end"

    def taken(state, to):     # a row kept, or given the role that the next state asks for
        role = {"u": "user", "a": "assistant", "s": "system"}[to]
        kept = add(state, "r.more", "K", "r.role || ':' || r.text", f"r.fault < 2 and r.kind = '{to}'")
        return [kept] if to == "s" else [kept, add(state, "r.more + 3", "R", f"'{role}:' || r.text", "r.fault < 2")]

    grown_u = best("u", *[add(z, 3, "I", "'user:'") for z in ("e", "s", "a")])
    grown_a = best("a", add("u", 3, "I", "'assistant:'"))
    return f"""
    with recursive own as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
    hit as (select *, {crc} % 20 as hit from own),
    damaged as (select conv_id, turn, case when hit = 4 then 'user' else role end as role,
            case hit when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
            unnest(range(case hit when 0 then 0 when 3 then 2 else 1 end)) as copy from hit),
    numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
        trim(text, {BLANK}) as bare, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as kind
        from damaged),
    r as materialized (select conv_id, turn, role, text, i, kind, case when bare = '' then 3
            when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
            when right(bare, 1) not in ('.', '!', '?') then 1 else 0 end as fault,
            case when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as more,
            lag(kind) over (partition by conv_id order by i) || kind as pair from numbered),
    facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n,
        count(*) filter (where fault = 3) as blank, count(*) filter (where fault = 2) as duplicate,
        count(*) filter (where fault = 1) as truncated,
        count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
    w as (
        select conv_id, 0::bigint as i, {{'c': 0, 'a': '', 't': []::varchar[]}} as e, {{'c': 0, 'a': '', 't': []::varchar[]}} as s,
            {{'c': 3, 'a': 'I', 't': ['user:']}} as u, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}} as a from facts
        union all
        select conv_id, i, e, s, u, {grown_a} as a from (select conv_id, i, e, s, {grown_u} as u, a from (
            select w.conv_id, r.i, {add("w.e", 4, "D")} as e,
                {best(add("w.s", 4, "D", None, "w.i > 0"), *taken("w.e", "s"))} as s,
                {best(add("w.u", 4, "D"), *[x for z in ("w.e", "w.s", "w.a") for x in taken(z, "u")])} as u,
                {best(add("w.a", 4, "D"), *taken("w.u", "a"))} as a
            from w join r on w.conv_id is not distinct from r.conv_id and r.i = w.i + 1))),
    ended as (select w.conv_id, {best("e", "a")} as z from w join facts f
        on w.conv_id is not distinct from f.conv_id and w.i = f.n)
    select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
        coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(z.c, 0)::bigint as cost,
        coalesce(z.a, '') as audit, sha256(coalesce(array_to_string(z.t, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) c left join facts f on c.conv_id is not distinct from f.conv_id
        left join ended on c.conv_id is not distinct from ended.conv_id"""
