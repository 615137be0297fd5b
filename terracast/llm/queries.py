"""Registered queries of the dealt operators."""
from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracast.llm import collocations, decontaminate, embedding_dedup, licenses, linededup, lm, minhash, packing, quality, records, secret_ledger, sharding, spelling
from terracast.llm.storage import reliable_cut, scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = shipped
    return shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most."""
    rows = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=24)
    return rows.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLES["op2_decontaminate"] = f"""
with d as (select row_number() over () u, doc_id, {_WORDS} w from documents),
i as (select cast(item_id as varchar) item_id, {_WORDS} w from benchmark where item_id is not null),
iw as (select distinct item_id, list_slice(w, s, s + least(13, len(w)) - 1) g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) s from i where len(w) > 0)),
sizes as (select distinct len(g) m from iw),
dw as (select u, s, m, list_slice(w, s, s + m - 1) g from (select u, w, m, unnest(range(1, len(w) - m + 2)) s from d, sizes where len(w) >= m)),
hit as (select u, s, m, item_id from dw join iw using (g)),
pos as (select u, count(distinct p) n_hit from (select distinct u, unnest(range(s, s + m)) p from hit) group by u),
own as (select u, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct u, item_id from hit) group by u)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join pos using (u) left join own using (u)"""


@query
def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document from the record files that hold its ids."""
    folder = scratch_path(spark, "records")
    written = reliable_cut(records.write_documents(table(spark, sf_dir, "documents"), folder), "record-files")
    return records.read_documents(written, folder, with_ids=False)


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under near-duplicate links of four-word shingles."""
    rows = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


_BLANK_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLES["op6_minhash"] = f"""
with recursive d as (select doc_id, {_BLANK_WORDS} w from documents),
sh as (select distinct doc_id, hash(list_slice(w, s, s + 3)) g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) s from d where len(w) > 0)),
n as (select doc_id, count(*) n from sh group by doc_id),
common as (select x.doc_id a, y.doc_id b, count(*) c from sh x join sh y using (g) where x.doc_id != y.doc_id group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join link l on r.b = l.a),
comp as (select a doc_id, min(b) component_id from reach group by a)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id = component_id kept from d left join n using (doc_id) join comp using (doc_id)"""


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = quality.scored(docs, model)
    return rows.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: its counts, and size and checksum of the text that stays."""
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_exact", "n_near", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


ORACLES["op9_lines"] = """
with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) i, unnest(string_split(text, chr(10))) line from documents where text is not null),
f as (select line, min((doc_id, i)) p, length(line) n from l where regexp_matches(line, '[^ \\t\\r]') group by line),
k as (select line, p, n, n b, false longer from f where n >= 20 union all select line, p, n, n - 1, true from f where n >= 20),
h as (select line, p, b, longer, 'l' || substr(line, 1, b // 2) g from k union all select line, p, b, longer, 'r' || right(line, b - b // 2) from k),
near as (select distinct greatest(x.p, y.p) p from h x join h y on x.g = y.g and x.b = y.b and not x.longer and (y.longer or x.p < y.p)
         where x.p != y.p and levenshtein(x.line, y.line) <= 1),
m as (select l.doc_id, l.i, l.line, f.p is not null and f.p != (l.doc_id, l.i) e, f.p is not null and f.p = (l.doc_id, l.i) and near.p is not null c,
             f.p is not null and (f.p != (l.doc_id, l.i) or near.p is not null) gone
      from l left join f using (line) left join near on f.p = near.p)
select doc_id, count(*) n_lines, count(*) filter (e) n_exact, count(*) filter (c) n_near,
       length(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) n_chars, md5(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) text_md5
from m group by doc_id union all select doc_id, 0, 0, 0, null, null from documents where text is null"""


@query
def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear log10 probability of every document."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = lm.score(table(spark, sf_dir, "documents"), ~held)
    return rows.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.95."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


ORACLES["op3_embeddings"] = """
with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0),
link as (select x.vec_id a, y.vec_id b from v x, v y where x.vec_id != y.vec_id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join link l on r.b = l.a),
comp as (select a vec_id, min(b) component_id from reach group by a), n as (select a vec_id, count(*) n from link group by a)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept from comp left join n using (vec_id)"""


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in every document."""
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), F.array_max("matches.dice").alias("best_dice"),
    )


_TEMPLATES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
_FIND = "regexp_extract_all(s, '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLES["op4_licenses"] = f"""
with d as (select row_number() over () u, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
pt as (select u, unnest(regexp_split_to_array(t, '\\n[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]*\\n')) s from d),
ln as (select u, unnest(string_split(t, chr(10))) s from d),
words as (select u, {_FIND} w from (select u, s from ln
          union all select u, s from pt where len(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]'))) > 1
          union all select d.u, t from d join (select u from pt where regexp_matches(s, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]') group by u having count(*) > 1) using (u)) where len(s) > 0),
seg as (select row_number() over () k, u, w from words where len(w) > 1),
bg as (select distinct k, w[i] || ' ' || w[i + 1] g from (select k, w, unnest(range(1, len(w))) i from seg)),
tw as (select i, name, {_FIND.replace("(s,", "(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),")} w from (values {_TEMPLATES}) v(i, name, x)),
tb as (select distinct i, w[j] || ' ' || w[j + 1] g from (select i, w, unnest(range(1, len(w))) j from tw)),
c as (select k, i, count(*) c from bg join tb using (g) group by k, i),
sc as (select k, i, 2 * c::double / (a.n + b.n) dice from c join (select k, count(*) n from bg group by k) a using (k) join (select i, count(*) n from tb group by i) b using (i)),
best as (select k, arg_min(i, (-dice, i)) i, max(dice) dice from sc where dice >= 0.85 group by k),
found as (select u, count(*) n, string_agg(distinct name, ',' order by name) names, max(dice) dice from best join seg using (k) join tw using (i) group by u)
select doc_id, coalesce(n, 0)::bigint n_matches, coalesce(names, '') licenses, dice best_dice from d left join found using (u)"""


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of seven letters or more that occur twice or more."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), drop_every=31)
    return spelling.variants(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


# crc32 by a table made from its rule; a letter of a word has one byte below 128, else two
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
_BYTES = "flatten(list_transform(string_split(s, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] end))"
ORACLES["op11_spelling"] = f"""
with recursive tab as materialized (select {_CRC_TABLE} t),
runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) w from documents),
own as (select w, coalesce(doc_id::varchar, '') || ':' || w s, count(*) n from runs group by 1, 2),
crc as (select w, n, xor(list_reduce(list_prepend(4294967295, {_BYTES}::bigint[]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) h from own, tab),
v as (select w, sum(n)::bigint n from (select case when h % 31 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end w, n from crc) where length(w) >= 7 group by w having sum(n) >= 2),
gap as (select w, n, p, left(w, p::int - 1) || substr(w, p::int + 1) g from (select w, n, unnest(range(1, length(w) + 1)) p from v)),
near as (select distinct a, b from (
  select x.w a, y.w b from gap x join gap y on x.g = y.g and x.p = y.p and x.w != y.w
  union all select x.w, v.w from gap x join v on x.g = v.w union all select v.w, x.w from gap x join v on x.g = v.w)),
best as (select a, count(*) n_near, arg_min(b, (-v.n, b)) b, max(v.n) bn from near join v on v.w = b group by a),
form as (select v.w, v.n, coalesce(n_near, 0)::bigint n_near, case when bn >= 10 * v.n then b end form, case when bn >= 10 * v.n then bn end form_n from v left join best on a = w),
path as (select w, w here, 0 k from v union all select path.w, form.form, k + 1 from path join form on form.w = path.here where form.form is not null)
select form.w word, form, root, n, n_near, form_n from form join (select w, arg_max(here, k) root from path group by w) using (w)"""


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by a ledger of blobs that starts empty."""
    ledger = secret_ledger.Ledger(spark, scratch_path(spark, "secret-ledger"))
    rows = secret_ledger.scan(table(spark, sf_dir, "documents"), ledger)
    base = secret_ledger.of_kinds([r.kind for r in secret_ledger.BASE])
    return rows.select(
        "doc_id", *[F.size(secret_ledger.of_kinds([r.kind])).cast("long").alias(f"n_{r.kind}") for r in secret_ledger.BASE],
        F.sha2(secret_ledger.listed(base), 256).alias("base_sha256"), secret_ledger.listed("spans").alias("spans"),
    )


def _spans_sql(place: int, rule: secret_ledger.Rule) -> str:
    """Matches of a rule with their places: marks around them, and the lengths of the pieces between the marks."""
    names, bracket, rest = rule.pattern.partition(")")
    if rule.any_case:  # the names; the rest knows both cases
        names = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", names)
    pattern = names + bracket + rest
    pattern = pattern.replace("'", "''")
    return f"""select u, {place} place, '{rule.kind}' kind, pos s, pos + length(m) e from (
select u, split_part(p[j], chr(57346), 1) m, list_sum(list_transform(p[:j - 1], lambda x: length(x))) - (j - 2) pos
from (select u, p, unnest(range(2, len(p) + 1)) j from (select u, string_split(regexp_replace(t, '{pattern}', chr(57345) || '\\0' || chr(57346), 'g'), chr(57345)) p from d)))
where length(regexp_extract(m, '{pattern}', {rule.group})) >= {rule.least}"""


ORACLES["op12_secrets"] = f"""
with d as (select row_number() over () u, doc_id, coalesce(text, '') t from documents),
f as ({" union all ".join(_spans_sql(i, r) for i, r in enumerate(secret_ledger.RULES))}),
o as (select u, count(*) filter (place = 0) n_assign, count(*) filter (place = 1) n_access, count(*) filter (place = 2) n_hex,
      string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, place) filter (place < 3) base, string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, place) spans from f group by u)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join o using (u)"""


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_phrases"] = """
with p as (select row_number() over () u, lang, piece from (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece from documents)),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from p),
f as materialized (select lang, m, g, count(*) n from (select lang, m, array_to_string(list_slice(w, s, s + m - 1), ' ') g from (select lang, w, m, unnest(range(1, len(w) - m + 2)) s from w, (values (1), (2), (3)) v(m) where len(w) >= m)) group by all),
total as (select lang, sum(n)::bigint n from f where m = 1 group by lang),
c as materialized (select lang, m, g, n, string_split(g, ' ') w from f where m >= 2 and n >= 10),
cut as (select lang, m, g, n a, k, array_to_string(list_slice(w, 1, k), ' ') g1, array_to_string(list_slice(w, k + 1, m), ' ') g2 from (select *, unnest(range(1, m)) k from c)),
score as (select cut.lang, cut.m, cut.g, a, k, x.n l, y.n r, (1000000::hugeint * a * a) // (x.n::hugeint * y.n) score
          from cut join f x on x.lang = cut.lang and x.g = g1 join f y on y.lang = cut.lang and y.g = g2),
best as (select lang, m, g, a, arg_min({'l': l, 'r': r, 'score': score}, (score, k)) b from score group by all),
longer as (select lang, g, max(n) n from (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) g, n from c where m = 3) group by all),
kept as (select best.lang, best.g phrase, a, b.l, b.r, b.score::bigint score from best left join longer on longer.lang = best.lang and longer.g = best.g and best.m = 2 where longer.n is null or 100 * longer.n < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000"""
