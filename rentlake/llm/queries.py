"""One query per operator, with production parameters over whole tables, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlake.llm import collocations, dialogue_repair, embedding_dedup, license_scan, lm_score, neighbour_graph, ngram_join, packing, quality_knn, quality_rules, sentencepieces, toxicity, url_filter
from rentlake.llm.labelled import crc_of_id
from rentlake.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, fold: int) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(crc_of_id() % folds == fold, F.lit(False))


NGRAM_SQL = """
with recursive w as (
 select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words
 from documents
), g as (
 select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
  else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as grams from w
), s as (select doc_id, unnest(grams) as gram from g),
links as (
 select a.doc_id as a, b.doc_id as b from s a join s b on a.gram = b.gram and a.doc_id <> b.doc_id
 join g x on x.doc_id = a.doc_id join g y on y.doc_id = b.doc_id
 group by a.doc_id, b.doc_id, len(x.grams), len(y.grams)
 having 100 * count(*) >= 75 * (len(x.grams) + len(y.grams) - count(*))
), reach as (
 select doc_id as a, doc_id as b from documents
 union
 select r.a, l.b from reach r join links l on r.b = l.a
)
select doc_id, cast(len(grams) as bigint) as n_shingles, (select min(b) from reach where a = doc_id) as component_id from g"""


@query("op1_ngram_join", NGRAM_SQL)
def _ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_sentencepiece")
def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


EMBEDDING_SQL = """
with recursive v as (
 select vec_id, label, cast(embedding as double[]) as e from embeddings
 where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
 select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
 where list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (
 select vec_id as a, vec_id as b from embeddings
 union
 select r.a, l.b from reach r join links l on r.b = l.a
), c as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id"""


@query("op3_embedding_dedup", EMBEDDING_SQL)
def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


@query("op4_lm_score")
def _lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good against all documents."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    # The labels grow with the corpus: one plan for all sizes, which never sends them to every task.
    return lm_score.score(docs, docs.join(good.hint("merge"), "doc_id", "left_semi"))


def _license_sql() -> str:
    """Phrases only: texts with identifier tags have labels that SQL can't work out."""
    every = {**license_scan.NOTICES, **license_scan.BASE_PHRASES}
    places = " || ".join(
        f"list_filter(range(1, len(words) - {p.count(' ')} + 1), lambda i: {' and '.join(f'''words[i + {k}] = '{w}' ''' for k, w in enumerate(p.split()))})"
        for p in license_scan.BASE_PHRASES
    )
    found = lambda phrases: "[" + ", ".join(f"case when contains(reduced, ' {p} ') then '{label}' end" for p, label in phrases.items()) + "]"
    burdens = "[" + ", ".join(f"case when contains(reduced, ' {p} ') then {license_scan.burden_of(label)} end" for p, label in every.items()) + ", 0.0]"
    labels = lambda phrases: f"array_to_string(list_sort(list_distinct(list_filter({found(phrases)}, lambda x: x is not null))), ',')"
    return f"""
with w as (
 select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
 from documents
), p as (
 select doc_id, len(words) as n_words, {places} as places, ' ' || array_to_string(words, ' ') || ' ' as reduced from w
)
select doc_id, cast(n_words as bigint) as n_words, cast(len(places) as bigint) as n_base, cast(list_min(places) - 1 as bigint) as first_word,
 cast(list_max(places) - 1 as bigint) as last_word, {labels(license_scan.BASE_PHRASES)} as base_labels,
 {labels(every)} as labels, cast(list_max({burdens}) as double) as score
from p"""


@query("op5_license_scan", _license_sql())
def _license(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("matches", lambda m: m.kind == "base")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    label = lambda m: m.label
    places = F.transform(base, lambda m: m.first_word)
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(F.transform(base, label)).alias("base_labels"),
        joined(F.concat(F.transform("matches", label), F.flatten(F.transform("expressions", lambda e: e.labels)))).alias("labels"),
        license_scan.burden().alias("score"),
    )


@query("op6_quality_rules")
def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, docs, table(spark, sf_dir, "labels"))


@query("op7_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)


# Every page is a capture at one time, and at another a report that lists, clears or allows
# its host, its domain or its first path segment, some of them for three days.
CAPTURES = "select page_id, url, cast('2024-01-01 00:00:00' as timestamp) + page_id * 7919 % 2592000 * interval '1' second as fetched_at from pages"
ENTRIES = """
select page_id as entry_id, case page_id % 3 when 0 then 'host' when 1 then 'domain' else 'path' end as kind,
 case page_id % 3 when 0 then h when 1 then concat(split_part(h, '.', -2), '.', split_part(h, '.', -1)) else concat(h, '/', split_part(url, '/', 4)) end as pattern,
 case page_id % 7 when 0 then 'remove' when 1 then 'remove' when 2 then 'allow' else 'block' end as action, listed_at,
 case when page_id % 5 = 0 then listed_at + interval '3' day end as expires_at
from (select page_id, url, split_part(url, '/', 3) as h, cast('2024-01-01 00:00:00' as timestamp) + page_id * 104729 % 2592000 * interval '1' second as listed_at from pages) p
where split_part(url, '/', 4) <> ''"""
URL_SQL = f"""
with c as ({CAPTURES}), e as ({ENTRIES}), h as (select *, split_part(url, '/', 3) as h, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') as s from c),
 k as (select page_id, url, fetched_at, 2 as rank, 'host' as kind, h as pattern from h
  union all select page_id, url, fetched_at, 1, 'domain', unnest(list_transform(range(1, len(string_split(h, '.'))), lambda i: array_to_string(string_split(h, '.')[i:], '.'))) from h
  union all select page_id, url, fetched_at, 3, 'path', unnest(list_transform(range(1, len(s) + 1), lambda i: h || '/' || array_to_string(s[:i], '/'))) from h),
 a as (select k.*, e.entry_id, e.action from k asof join e on k.kind = e.kind and k.pattern = e.pattern and k.fetched_at >= e.listed_at where e.action <> 'remove' and (e.expires_at is null or e.expires_at > k.fetched_at)),
 b as (select * from (select *, row_number() over (partition by page_id order by rank desc, length(pattern) desc) as n from a) where n = 1)
select c.page_id, c.url, c.fetched_at, coalesce(b.action, 'none') as verdict, b.kind, b.pattern, b.entry_id from c left join b on c.page_id = b.page_id"""


@query("op8_url_filter", URL_SQL)
def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures, entries = (spark.sql(sql.replace("from pages", "from {pages}"), pages=pages) for sql in (CAPTURES, ENTRIES))
    return url_filter.judge(captures, entries)


@query("op9_quality_knn")
def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_knn.classify(docs, docs, table(spark, sf_dir, "labels"), learn_where=~held_out(4, 2))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= quality_knn.GOOD_FROM).cast("int").alias("predicted"))


@query("op10_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.classify(docs, docs, table(spark, sf_dir, "labels"), learn_where=~held_out(5, 0))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"), "worst_word")


@query("op11_nn_descent")
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the crc32 of their place gives them."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query("op12_dialogue_repair")
def _dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repaired = dialogue_repair.repair(damaged(rows)).withColumnRenamed("conv_id", "conv")
    every = rows.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return every.select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in every.columns if c != "conv_id"])


COLLOCATION_SQL = """
with p as (
 select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
 from documents
), w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as words from p),
total as (select lang, cast(sum(len(words)) as bigint) as n from w group by lang),
u as (select lang, id, unnest(words) as a, generate_subscripts(words, 1) as i from (select lang, words, row_number() over () as id from w)),
q as (select lang, a, lead(a, 1) over x as b, lead(a, 2) over x as c, lead(a, 3) over x as d from u window x as (partition by id order by i)),
g as (
 select lang, 1 as k, a as phrase from q union all select lang, 2, a || ' ' || b from q where b is not null
 union all select lang, 3, a || ' ' || b || ' ' || c from q where c is not null union all select lang, 4, a || ' ' || b || ' ' || c || ' ' || d from q where d is not null
), f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 30),
c as (select lang, k, phrase, string_split(phrase, ' ') as words, f as a from f where k > 1),
parts as (
 select c.lang, c.a, array_to_string(c.words[s.s:s.s + s.m - 1], ' ') as phrase
 from c, (select s, m from (select unnest([1, 2, 3]) as s), (select unnest([2, 3]) as m)) s where s.m < c.k and s.s + s.m - 1 <= c.k
), gone as (select distinct c.lang, c.phrase from c join parts x on x.lang = c.lang and x.phrase = c.phrase where 100 * x.a >= 80 * c.a),
cuts as (
 select c.lang, c.phrase, c.a, j.j, l.f as l, r.f as r, cast((2000000::hugeint * c.a) // (l.f + r.f) as bigint) as score
 from c, (select unnest([1, 2, 3]) as j) j, f l, f r
 where j.j < c.k and l.lang = c.lang and l.phrase = array_to_string(c.words[:j.j], ' ') and r.lang = c.lang and r.phrase = array_to_string(c.words[j.j + 1:], ' ')
), best as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as x from cuts) where x = 1),
ranked as (
 select b.lang, row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) as rank, b.phrase, a, l, r, score
 from best b anti join gone on gone.lang = b.lang and gone.phrase = b.phrase
)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join total on total.lang = ranked.lang where rank <= 2000"""


@query("op13_collocations", COLLOCATION_SQL)
def _collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))
