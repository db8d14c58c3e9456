r"""SQL twins of the queries that SQL can express, written from the contracts.

Encoding (merges by rank, op1 and op13) and the trained classifier have none; tests hold them
against the tokenizers library and against held-out labels.
"""

from __future__ import annotations

from tessera.llm import jaccard, line_dedup, mixing, quality, urls, warc


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# white space of the contracts: blank and the five control characters
WS = r"[\x20\x09-\x0D]"
_ASCII_LOWER = f"translate({{}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lower(expr: str) -> str:
    return _ASCII_LOWER.format(expr)


def _words(expr: str) -> str:
    return f"list_filter(string_split_regex(coalesce({expr}, ''), '{WS}+'), lambda w: w <> '')"


OP3 = r"""
with t as (select doc_id, coalesce(text, '') as x from documents),
kinds(kind, rank, pat, near, prior) as (values
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'e-?mail|mail|contact|write', 0.9),
  ('ip', 1, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 'ip|address|host|server', 0.7),
  ('card', 2, '[0-9](?:[ -]?[0-9])+', 'card|visa|credit|payment|account', 0.7),
  ('phone', 3, '\+[0-9][ ().0-9-]+[0-9]', 'phone|tel|call|mobile|fax', 0.7),
  ('iban', 4, '[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?', 'iban|bank|account|transfer', 0.6),
  ('ssn', 5, '[0-9]{3}-[0-9]{2}-[0-9]{4}', 'ssn|social|security|insurance', 0.3),
  ('secret', 6, '[A-Za-z0-9+/_-]{20,}', 'token|secret|key|apikey|password|passwd|pwd|credentials?|bearer|auth', 0.3),
  ('access_key', 7, '(?:AKIA|ASIA)[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}', 'token|secret|key', 0.7),
  ('private_key', 8, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 'key', 0.9)),
m as (
  select doc_id, kind, rank, '(?i)(?:^|[^a-z])(?:' || near || ')(?:[^a-z]|$)' as near, prior,
    regexp_extract_all(x, pat) as found, string_split_regex(x, pat) as pieces
  from t, kinds),
hits as (
  select doc_id, kind, rank, near, prior, found[i] as hit, replace(found[i], ' ', '') as bare, right(pieces[i], 40) as pre, left(pieces[i+1], 40) as post,
    list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i-1], lambda f: length(f))), 0) as start
  from m, unnest(range(1, len(found) + 1)) as u(i)),
d as (
  select *, regexp_replace(hit, '[^0-9]', '', 'g') as digits,
    least(10, round(10 * prior)::int + case when regexp_matches(pre, near) or regexp_matches(post, near) then 3 else 0 end) / 10 as score
  from hits),
good as (
  select doc_id, kind, rank, score, start::bigint as start, (start + length(hit))::bigint as stop from d where
    kind = 'email'
    or kind = 'ip' and list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3 and try_cast('0' || right(p, 3) as int) <= 255))
    or kind = 'phone' and length(digits) between 10 and 15
    or kind = 'card' and length(digits) between 14 and 19 and (
      list_sum(list_transform(range(1, length(digits) + 1),
        lambda i: case when i % 2 = 1 then substr(reverse(digits), i, 1)::int
             when substr(reverse(digits), i, 1)::int > 4 then 2 * substr(reverse(digits), i, 1)::int - 9
             else 2 * substr(reverse(digits), i, 1)::int end)) % 10 = 0)
    or rank > 3 and score >= 0.5 and not regexp_matches(right(pre, 1) || left(post, 1), '[A-Za-z0-9]') and (
      kind = 'iban' and length(bare) between 15 and 34 and list_reduce(list_transform(string_split(substr(bare, 5) || left(bare, 4), ''),
        lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1), lambda a, v: (a * case when v < 10 then 10 else 100 end + v) % 97) = 1
      or kind = 'ssn' and not regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$')
      or kind = 'secret' and length(hit) <= 256 and regexp_matches(hit, '[0-9][A-Za-z]|[A-Za-z][0-9]')
        and len(list_distinct(string_split(hit, ''))) >= 8
      or kind in ('access_key', 'private_key'))),
g as (
  select doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
    count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 4) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans,
    count(*) filter (rank > 5) as n_secret, count(*) as n_spans, max(score) as top_score
  from good group by doc_id)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card,
  coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_secret, 0) as n_secret, coalesce(n_spans, 0) as n_spans, coalesce(top_score, 0)::double as top_score
from t left join g using (doc_id)
"""

OP4 = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select * from (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from p)
where rank <= 10
"""


def _op5() -> str:
    rules = ",\n  ".join(
        f"({i}, {_text(r.host)}, {_text(r.path)}, {_text(r.verdict)}, {str(r.listed).lower()})"
        for i, r in enumerate([*urls.BASE_RULES, *urls.OWN_RULES])
    )
    return f"""
with rules(i, h, p, v, listed) as (values
  {rules}),
u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
a as (
  select page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
best as (
  select page_id, arg_max(struct_pack(e := h || p, v := v, listed := listed),
      struct_pack(l := listed, n := length(h || p), m := length(h), b := v = 'block', f := -i)) as r
  from a join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, case when r.listed then r.e end as rule, coalesce(r.v, 'allow') as verdict
from a left join best using (page_id)
"""


OP6 = rf"""
with l as (
  select doc_id, i, string_split(coalesce(text, ''), chr(10)) as ls, ls[i] as line
  from documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as u(i)),
k as (select doc_id, i, line, {_lower(rf"regexp_replace(line, '^{WS}+|{WS}+$', '', 'g')")} as key from l),
f as (
  select key, max(doc_id) as last from k where length(key) >= {line_dedup.LEAST_CHARS}
  group by key having count(distinct doc_id) >= {line_dedup.LEAST_DOCS})
select doc_id, count(*) as n_lines, count(*) filter (last is not null and doc_id < last) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (last is null or doc_id >= last), '')) as kept_sha256
from k left join f using (key) group by doc_id
"""


def _op7() -> str:
    stops = ", ".join(_text(form) for w in quality.STOP_WORDS for form in (w, w.capitalize()))
    tests = []
    for r in quality.RULES:
        if r.least is not None:
            tests.append(f"{r.measure} >= {r.least}")
        if r.most is not None:
            tests.append(f"{r.measure} <= {r.most}")
    return f"""
with t as (select doc_id, coalesce(text, '') as x, {_words('text')} as w from documents),
w8 as (
  select doc_id, i, md5(array_to_string(w[i:i+7], ' ')) as h
  from t, unnest(range(1, len(w) - 6)) as u(i) where len(w) >= 8),
twice as (select doc_id, i from w8 qualify count(*) over (partition by doc_id, h) > 1),
cover as (select doc_id, count(distinct i + j) as n from twice, range(0, 8) as r(j) group by doc_id),
m as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(list_filter(w, lambda a: a in ({stops}))) as n_stops,
    list_filter(string_split(x, chr(10)), lambda a: regexp_replace(a, '{WS}', '', 'g') <> '') as ls,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from t left join cover using (doc_id)),
r as (
  select *, case when n_words > 0 then word_chars / n_words else 0 end as mean_word_chars,
    case when n_words > 0 then n_symbols / n_words else 0 end as symbol_ratio,
    case when n_words > 0 then n_stops / n_words else 0 end as stop_word_ratio,
    case when len(ls) > 0 then n_dup_lines / len(ls) else 0 end as dup_line_ratio,
    n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {' and '.join(tests)} as kept from r
"""


def _op8() -> str:
    dims = mixing.DIMENSIONS
    parts = [
        f"""d as materialized (
  select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang, len({_words('text')})::bigint as n_tokens,
    case when contains(x, ' | ') then 'table' when contains(x, 'icense') then 'notice' when length(x) < 600 then 'short'
      when length(x) < 3000 then 'medium' else 'long' end as topic
  from (select *, coalesce(text, '') as x from documents))""",
        "c as materialized (select source, lang, topic, sum(n_tokens)::double as tokens from d group by all)",
        "s as materialized (select sum(tokens) as total from c)",
    ]
    for dim in dims:
        parts.append(
            f"t_{dim} as materialized (select {dim}, p / sum(p) over () as share from "
            f"(select {dim}, pow(sum(tokens), {mixing.FLATTENING}) as p from c group by {dim}))"
        )
    parts.append("r0 as materialized (select source, lang, topic, tokens, tokens / total as w from c, s)")
    step = 0
    for _ in range(24):
        for dim in dims:
            parts.append(
                f"r{step + 1} as materialized (select r.source, r.lang, r.topic, r.tokens, "
                f"case when sum(w) over (partition by r.{dim}) > 0 then w * share / sum(w) over (partition by r.{dim}) else 0 end as w "
                f"from r{step} r join t_{dim} using ({dim}))"
            )
            step += 1
    parts.append(
        f"f as (select source, lang, topic, w, case when tokens > 0 then w * total / tokens end as ratio from r{step}, s)"
    )
    parts.append("p as (select source, lang, topic, w, coalesce(ratio / max(ratio) over (), 0) as chance from f)")
    return (
        "with "
        + ",\n".join(parts)
        + """
select doc_id, source, lang, topic, n_tokens, round(w, 6) as weight,
  round(case when n_tokens > 0 then chance else 0 end, 6) as probability,
  n_tokens > 0 and ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 < chance as kept
from d left join p using (source, lang, topic)
"""
    )


OP9 = f"""
with recursive w as (select doc_id, {_words(_lower("coalesce(text, '')"))} as w from documents),
g as (
  select distinct doc_id, md5(array_to_string(w[i:i+{jaccard.WORDS - 1}], ' ')) as s
  from w, unnest(range(1, greatest(len(w) - {jaccard.WORDS - 1}, 1) + 1)) as u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from g group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
e as (
  select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * o >= {jaccard.PERCENT} * (x.n + y.n - o)),
reach as (select doc_id as a, doc_id as b from w union select reach.a, e.b from reach join e on e.a = reach.b)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, (select min(b) from reach where a = w.doc_id) as component_id
from w left join n using (doc_id)
"""


def _op10() -> str:
    uuid = lambda h: (
        f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' "
        f"|| substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"
    )
    text = f"regexp_replace(body, {_text(warc.HIDDEN)}, ' ', 'g')"
    text = rf"regexp_replace({text}, '[ \t\r\n]+', ' ', 'g')"
    text = f"regexp_replace({text}, {_text(warc.BREAKS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {_text(warc.TAGS)}, '', 'g')"
    for name, sign in warc.ENTITIES:
        text = f"replace({text}, {_text(name)}, {_text(sign)})"
    text = rf"regexp_replace(regexp_replace({text}, ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g')"
    return rf"""
with a as (
  select page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') as url, coalesce(html, '') as body, {uuid("md5(concat_ws('|', 'response', page_id::varchar, pages.url))")} as id,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) as http from pages),
b as (
  select *, 'sha256:' || sha256(body) as payload, {text} as plain,
    concat_ws(chr(10), 'WARC-Type: response', 'WARC-Record-ID: ' || id, 'WARC-Date: {warc.NO_DATE}', 'WARC-Target-URI: ' || url,
      'WARC-Payload-Digest: sha256:' || sha256(body), 'WARC-Block-Digest: sha256:' || sha256(http || body),
      'Content-Type: application/http; msgtype=response', 'Content-Length: ' || strlen(http || body),
      'HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(body)) as lines from a),
c as (
  select *, concat_ws(chr(13) || chr(10), 'source-content-type: text/html; charset=utf-8', 'source-payload-length: ' || strlen(body),
    'source-payload-digest: ' || payload, 'text-digest: sha256:' || sha256(plain), 'text-length: ' || length(plain)) as facts from b),
k as (
  select 'metadata' as kind, 'application/warc-fields' as content, facts as block, * from c
  union all select 'conversion', 'text/plain; charset=utf-8', plain, * from c)
select page_id, kind as record_type, {uuid("md5(kind || '|' || id)")} as record_id, id as refers_to, url as target_uri,
  '{warc.NO_DATE}' as date, content as content_type, lines as source_headers, payload as source_payload_digest,
  'sha256:' || sha256(block) as block_digest, strlen(block)::bigint as content_length, block from k
"""


def _op11(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    apart = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint"
    parts = [
        f"""v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
        f"""c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id) nulls last, v) - 1 as k, v as c
  from v qualify row_number() over (order by sha256('2:' || vec_id) nulls last, v) <= {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} as materialized (select row, any_value(vec_id) as vec_id, any_value(v) as v, min((d, k)) as m "
            f"from (select row, vec_id, v, k, {apart} as d from v, c{r}) group by row)"
        )
        if r < rounds:
            parts.append(
                f"s{r} as materialized (select k, i, sum(x)::hugeint as s, count(*)::hugeint as n from "
                f"(select m[2] as k, unnest(v) as x, unnest(range(1, {dim + 1})) as i from a{r}) group by k, i)"
            )
            parts.append(
                f"c{r + 1} as materialized (select k, coalesce(m, c) as c from c{r} left join (select k, "
                f"list(((s - ((s % n) + n) % n) // n)::bigint order by i) as m from s{r} group by k) using (k))"
            )
    return (
        "with "
        + ",\n".join(parts)
        + f"""
select vec_id, m[2]::int as cluster, m[1] as distance, (sum(m[1]) over (partition by m[2]))::bigint as cluster_inertia,
  (sum(m[1]) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} on k = m[2]
"""
    )


# CRC-32 of the decimal digits of c, bit by bit
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: unicode(x)::bigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

OP12 = f"""
with o as materialized (
  select c, role, text, length(text) as chars, sha256(length(role) || ':' || role || text) as h,
    row_number() over (partition by c order by turn nulls first, sha256(length(role) || ':' || role || text)) as i
  from (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
n as materialized (
  select c, c - c % 100 as donor, max(i) as n, {_CRC32} % 6 as h from o group by c),
b as materialized (
  select n.c, least(n.h, coalesce(d.n, 0)) as taken, n.h, n.donor, least(n.h, coalesce(d.n, 0)) + greatest(n.n - n.h, 0) as n
  from n left join n d on d.c = n.donor),
r as materialized (
  select b.c, i - b.h + taken as i, o.h, chars from b join o using (c) where i > b.h
  union all select b.c, i, o.h, chars from b join o on o.c = b.donor where i <= taken),
p as materialized (
  select c, i as d, chars, string_agg(h, ',') over (partition by c order by i rows unbounded preceding) as key from r
  union all select c, 0, 0, '' from b),
g as materialized (
  select d, key, min(c) as node, count(*) as n_convs, max(chars) as chars,
    coalesce(string_agg(c::varchar, ',' order by c) filter (d = n), '') as ends
  from p join b using (c) group by d, key),
w as materialized (select c, d, node from p join g using (d, key)),
t as materialized (
  select g.node, g.d, n_convs, chars, ends, w.node as parent from g left join w on w.c = g.node and w.d = g.d - 1),
k as materialized (select parent as node, d - 1 as d, count(*) as n from t where parent is not null group by all),
f as materialized (select t.*, coalesce(n, 0) as n_children from t left join k using (node, d)),
s as (
  select w.node, w.d, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * chars) as saved
  from f join w on w.c = f.node and w.d <= f.d group by all)
select node::bigint as conv_id, d::bigint as depth, parent::bigint as parent_conv_id, n_convs::bigint as n_convs,
  n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(ends) as ends_sha256
from f join s using (node, d)
"""


TWINS: dict[str, str] = {
    "op3_pii": OP3,
    "op4_exact_topk": OP4,
    "op5_url_filters": _op5(),
    "op6_line_dedup": OP6,
    "op7_quality_rules": _op7(),
    "op8_mixing": _op8(),
    "op9_ngram_jaccard_join": OP9,
    "op10_warc": _op10(),
    "op11_centroid_clustering": _op11(),
    "op12_prefix_trie": OP12,
}
