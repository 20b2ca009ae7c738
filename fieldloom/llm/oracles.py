"""SQL of those queries that SQL can express: exact similarities over all pairs, and rules by windows and groups."""

from __future__ import annotations

from .quality_rules import CLASSES, COMMON, SYMBOLS

#: White space between words, for regular expressions.
GAP = r"[ \t\n\x0B\f\r]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{GAP}'), lambda w: w <> '')"


def _reached(pairs: str, ids: str) -> str:
    """(id, component): the least id that links reach; ``pairs``: (a, b) both ways."""
    return f"reach as (select id, id as far from ({ids}) union select r.id, p.b from reach r join ({pairs}) p on p.a = r.far), comps as (select id, min(far) as component from reach group by 1)"


#: Vectors of one label and length, finite and not zero, by cosine in double precision.
EMBEDDINGS = f"""with recursive v as (select vec_id::bigint vec_id, label, embedding::double[] e from embeddings),
fine as (select * from v where label is not null and e is not null and len(list_filter(e, lambda c: c is null or isnan(c) or isinf(c))) = 0 and len(list_filter(e, lambda c: c <> 0)) > 0),
unit as (select vec_id, label, len(e) n, list_transform(e, lambda c: c / sqrt(list_dot_product(e, e))) u from fine),
links as (select x.vec_id a, y.vec_id b from unit x join unit y on x.label = y.label and x.n = y.n and x.vec_id <> y.vec_id where list_dot_product(x.u, y.u) >= 0.93),
{_reached("select * from links", "select vec_id id from v")}
select v.vec_id, coalesce(l.n, 0)::bigint n_links, c.component component_id, v.vec_id = c.component kept
from v join comps c on c.id = v.vec_id left join (select a, count(*) n from links group by 1) l on l.a = v.vec_id"""

#: Texts by the weighted Jaccard similarity of their five-word shingles.
NEAR_DUPLICATES = f"""with recursive d as (select doc_id::bigint doc_id, coalesce(text, '') t from documents),
one as (select t, min(doc_id) id from d group by 1),
w as (select id, {_words("t")} w from one),
g as (select id, unnest(case when len(w) <= 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end) g from w),
c as (select id, g, count(*) n from g group by 1, 2),
size as (select id, sum(n) m from c group by 1),
met as (select x.id a, y.id b, sum(least(x.n, y.n)) o from c x join c y on x.g = y.g and x.id < y.id group by 1, 2),
close as (select a, b from met join size s on s.id = a join size t on t.id = b where o >= 0.8 * (s.m + t.m - o)),
{_reached("select a, b from close union all select b, a from close", "select id from one")}
select d.doc_id, comps.component component_id, d.doc_id = comps.component kept from d join one on one.t = d.t join comps on comps.id = one.id"""


def _rules() -> str:
    """Base counts, and both distances of each text from its language."""
    classes = {name: f"(length(t) - length(translate(t, {_sql_chars(chars)}, '')))::double" for name, chars in CLASSES.items()}
    names = [*classes, "other"]
    js = lambda p, q: f"((case when {p} > 0 then {p} * log2({p} / (({p} + {q}) / 2)) else 0 end) / 2 + (case when {q} > 0 then {q} * log2({q} / (({p} + {q}) / 2)) else 0 end) / 2)"
    class_js = " + ".join(js(f"(b.{n} / b.chars)", f"r.{n}") for n in names)
    return f"""with d as (select doc_id::bigint doc_id, coalesce(lang, '') lang, coalesce(text, '') t from documents),
w as (select doc_id, {_words("t")} w from d),
g as (select doc_id, k, array_to_string(w[k:k + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) k from w where len(w) >= 5)),
twice as (select doc_id, k from (select doc_id, k, count(*) over (partition by doc_id, g) n from g) where n > 1),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest([k, k + 1, k + 2, k + 3, k + 4]) p from twice) group by 1),
lines as (select doc_id, count(*) - count(distinct x) n from (select doc_id, unnest(string_split(t, chr(10))) x from d) where regexp_replace(x, '{GAP}', '', 'g') <> '' group by 1),
b0 as (select d.doc_id, d.lang, d.t, len(w.w)::bigint n_words, length(t)::double chars, {', '.join(f'{e} as "{n}"' for n, e in classes.items())} from d join w using (doc_id)),
b as (select *, chars - ({' + '.join(classes)}) as other from b0),
r as (select lang, {', '.join(f'sum({n}) / sum(chars) as {n}' for n in classes)} from b group by 1),
r1 as (select *, 1 - ({' + '.join(classes)}) as other from r),
lw as (select doc_id, lang, unnest({_words("lower(t)")}) word from d),
counts as (select lang, word, count(*) n from lw group by 1, 2),
top as (select lang, word, n / total as q from (select *, sum(n) over (partition by lang) total, row_number() over (partition by lang order by n desc, word) k from counts) where k <= {COMMON}),
all_q as (select lang, sum(q) all_q from top group by 1),
cells as (select doc_id, lang, word, q, count(*)::double n from lw join top using (lang, word) group by 1, 2, 3, 4),
known as (select c.doc_id, sum({js('(c.n / b.n_words)', 'c.q')}) js, sum(c.q) seen, sum(c.n) common from cells c join b using (doc_id) group by 1),
dist as (select b.doc_id, sqrt(greatest(0, coalesce(js, 0) + (all_q - coalesce(seen, 0)) / 2 + {js('(1 - coalesce(common, 0) / b.n_words)', 'greatest(0, 1 - all_q)')})) word_distance from b join all_q using (lang) left join known using (doc_id) where b.n_words > 0),
judged as (select b.*, coalesce(covered.n, 0)::bigint n_repeat_words, coalesce(lines.n, 0)::bigint n_dup_lines, case when chars > 0 then sqrt(greatest(0, {class_js})) end class_distance, word_distance
from b join r1 r using (lang) left join covered using (doc_id) left join lines using (doc_id) left join dist using (doc_id))
select doc_id, n_words, (length(t) - "space")::bigint word_chars, (length(t) - length(translate(t, {_quoted(SYMBOLS)}, '')))::bigint n_symbols, n_dup_lines, n_repeat_words,
(n_words < 10 or 100 * n_repeat_words > 20 * n_words) base_failed,
not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not (chars >= 200 and class_distance > 0.3) and not (n_words >= 50 and word_distance > least(0.44, sqrt(0.33 * 0.33 + 6.0 / n_words))) kept,
round(class_distance, 9) class_distance, round(word_distance, 9) word_distance from judged"""


def _sql_chars(chars: str) -> str:
    """Characters as SQL: white space by number."""
    plain = "".join(c for c in chars if c.isprintable() and c != " ")
    return " || ".join([_quoted(plain)] * bool(plain) + [f"chr({ord(c)})" for c in chars if c not in plain])


QUALITY_RULES = _rules()


#: Rests of the 256 bytes in crc32 (reflected polynomial 0xEDB88320), and crc32 of a text's UTF-8 bytes; {0} is the text.
CRC_RESTS = "crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tab)"
CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen({0}) + 1), lambda k: ('0x' || substr(hex(encode({0})), (2 * k - 1)::int, 2))::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint)"

#: Gains of hashed words, Gumbel numbers from ids, and the ranks of the tenth with the highest scores.
IMPORTANCE = f"""with {CRC_RESTS},
d as (select row_number() over () r, doc_id::bigint doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
q as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
dw as (select r, unnest(w) w from d), qw as (select unnest(w) w from q),
word as (select w, {CRC.format('w')} % 10000 b from (select distinct w from (select w from dw union all select w from qw)), crc),
s as (select b, count(*) s from dw join word using (w) group by 1),
t as (select b, count(*) t from qw join word using (w) group by 1),
n as (select (select count(*) from dw)::double sn, (select count(*) from qw)::double tn),
gain as (select b, floor(1000 * ln((coalesce(t, 0) + 1) * (sn + 10000) / ((s + 1) * (tn + 10000)))) g from s left join t using (b), n),
weight as (select r, sum(g)::bigint weight from dw join word using (w) join gain using (b) group by 1),
scored as (select r, doc_id, len(w)::bigint n_features, coalesce(weight, 0)::bigint weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint score from d left join weight using (r)),
placed as (select r, row_number() over (order by score desc, doc_id nulls last) k, count(*) over () n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when k <= 10 * n // 100 then k end::bigint as rank from scored left join placed using (r)"""

#: Windows of 35 words that start twice or more, and the words that none of them covers.
SUBSTRINGS = f"""with d as (select row_number() over () r, doc_id::bigint doc_id, {_words("coalesce(text, '')")} w from documents),
g as (select r, k, array_to_string(w[k:k + 34], ' ') g from (select r, w, unnest(range(1, len(w) - 33)) k from d where len(w) >= 35)),
twice as (select r, k from (select r, k, count(*) over (partition by g) n from g) where n > 1),
gone as (select distinct r, k + unnest(range(35)) p from twice),
kept as (select r, array_to_string(list(w order by p), ' ') t, count(*) n from (select r, unnest(w) w, unnest(range(1, len(w) + 1)) p from d) anti join gone using (r, p) group by 1)
select doc_id, len(w)::bigint n_words, len(w) - coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (r)"""

#: Every distinct beginning of the rebuilt conversations; sums over its subtree by all pairs of node and ancestor.
PREFIX_TRIE = f"""with {CRC_RESTS},
t as (select conv_id::bigint c, coalesce(role, '') role, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) p from conversations where conv_id is not null),
conv as (select c, c - c % 100 b, {CRC.format('c::varchar')} % 6 h from (select distinct c from t), crc),
head as (select conv.c, p, role, x from conv join t on t.c = conv.b and p <= h),
nb as (select c, count(*) k from head group by 1),
r as (select * from head union all select t.c, p - h + coalesce(k, 0), role, x from t join conv using (c) left join nb using (c) where p > h),
path as (select c, p d, length(x) len, md5(string_agg(length(role) || ':' || role || length(x) || ':' || x, '') over (partition by c order by p)) k from r union all select c, 0, 0, '' from conv),
node as (select d, k, min(c) c, count(*) n, any_value(len) len from path group by 1, 2),
up as (select node.d, node.k, a.d ad, a.k ak from node join path a on a.c = node.c and a.d <= node.d),
parent as (select up.d, up.k, up.ak, node.c from up join node on node.d = up.ad and node.k = up.ak where up.ad = up.d - 1),
kids as (select d - 1 d, ak k, count(*) n from parent group by 1, 2),
sub as (select up.ad d, up.ak k, sum((node.n - 1) * node.len)::bigint saved, count(*) filter (where kids.n is null) leaves from up join node using (d, k) left join kids using (d, k) group by 1, 2),
ended as (select d, k, string_agg(c::varchar, ',' order by c) ids from (select c, max(d) d from path group by 1) join path using (c, d) group by 1, 2)
select node.c conv_id, node.d depth, parent.c parent_conv_id, node.n n_convs, coalesce(kids.n, 0) n_children, leaves n_leaves, saved saved_tokens, sha256(coalesce(ids, '')) ends_sha256
from node join sub using (d, k) left join kids using (d, k) left join parent using (d, k) left join ended using (d, k)"""
