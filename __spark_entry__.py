"""The engine's queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import plaudit as p
from plaudit.functions.scalars import CONTROL_CHARS
from plaudit.sources import tables
from plaudit.sources.shared import fresh_path

try:
    from plaudit.llm import queries as llm

    import corpus_pipeline
except ImportError:
    # Without the subpackage, or a library that only it needs, the other queries still work.
    llm = corpus_pipeline = None

Query = Callable[[SparkSession, str], DataFrame]

# The item of the single-item queries; present at every scale.
ITEM = "P7"
# The item that holds a third of the returns view is large at every scale, and hot where so many are.
HOT_LEAST = 1000


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: peer rank of every customer."""
    return queries()["peer_rank_agreement"](spark, "/root/testdata/sf0.001")


def _on(view: Query, analysis: Callable[[DataFrame], DataFrame], **options) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return analysis(view(spark, folder, **options))

    return run


def _rank(weight: str, **options) -> Callable[[DataFrame], DataFrame]:
    def run(reviews: DataFrame) -> DataFrame:
        ranked = p.peer_rank(reviews, weight, **options)
        return ranked.select("user_id", F.round("rank", 6).alias("rank"))

    return run


def _edges(**options) -> Callable[[DataFrame], DataFrame]:
    return lambda reviews: p.agreement_edges(reviews, **options)


def _suggest(*args, **options) -> Callable[[DataFrame], DataFrame]:
    return lambda reviews: p.suggest(reviews, *args, **options)


def _for_some(analysis: Callable[[DataFrame, DataFrame], DataFrame], view: Query, ending: str = "7") -> Query:
    """For the users whose number ends in 7, or otherwise."""

    def run(reviews: DataFrame) -> DataFrame:
        return analysis(reviews, reviews.filter(F.col("user_id").endswith(ending)).select("user_id").distinct())

    return _on(view, run)


def _text_file(stanzas: Query) -> Query:
    """Write the records as text files, read them back and type them. A review without
    votes shows -1 here, so that the column holds whole numbers only."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = fresh_path(spark, "stanzas")
        stanzas(spark, folder).write.option("lineSep", "\n\n").text(path)
        return p.load_reviews(spark, path).fillna(-1, ["helpful_pct"])

    return run


def _permissive(spark: SparkSession, folder: str) -> DataFrame:
    """Records with unreadable numbers, from text files; what could not be read shows -1."""
    path = fresh_path(spark, "stanzas")
    tables.damaged_stanzas(tables.customer_reviews(spark, folder)).write.option("lineSep", "\n\n").text(path)
    reviews = p.load_reviews(spark, path, mode="permissive")
    numbers = ["score", "review_time", "up_votes", "total_votes", "down_votes", "helpful_pct"]
    return reviews.select("item_id", "user_id", "helpfulness", *numbers).fillna(-1, numbers)


def _preview(spark: SparkSession, folder: str) -> DataFrame:
    return p.review_preview(p.to_reviews(p.parse_stanzas(tables.document_stanzas(spark, folder))))


def _read_scores(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.schema("item_id string, mean_score double").format(fmt).load(path)


def _written(write: Callable[[DataFrame, str], None], fmt: str = "csv") -> Query:
    """Write the item scores with ``write`` and read them back."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = fresh_path(spark, "scores")
        write(p.item_score(tables.customer_reviews(spark, folder)), path)
        return _read_scores(spark, path, fmt)

    return run


# Results of the named jobs, as their CSV files are read back.
JOBS = {
    "filmscore": "item_id string, mean_score double",
    "userscore": "user_id string, mean_score double",
    "userhelpfulness": "user_id string, help double",
    "filmdatescore": "item_id string, year string, mean_score double",
    "filmdatescore_aggregated": "item_id string, period string, mean_score double",
    "lengthhelpfulness": "length_class string, mean_help long",
    "pagerank_average": "user_id string, rank double",
    "pagerank_averageI": "user_id string, rank double",
    "pagerank_medium": "user_id string, rank double",
    "pagerank_naive": "user_id string, rank double",
    "pagerank_optimized": "user_id string, rank double",
    "usersuggestion_naive": "user_id string, item_id string, predicted double",
    "usersuggestion_improved": "user_id string, item_id string, predicted double",
    "usersuggestion_optimized": "user_id string, item_id string, predicted double",
}


def _records(name: str) -> Query:
    """The text records that a named job reads: with texts where their length matters."""
    if name == "lengthhelpfulness":
        return tables.document_stanzas
    view = tables.order_reviews if name.startswith("usersuggestion") else tables.customer_reviews
    return lambda spark, folder: tables.review_stanzas(view(spark, folder))


def _named_job(name: str, save: str) -> Query:
    """The job from text records to files, read back."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        source, out = fresh_path(spark, "stanzas"), fresh_path(spark, "result")
        _records(name)(spark, folder).write.options(lineSep="\n\n", compression="gzip").text(source)
        p.run_job(spark, source, name, save, out=out)
        result = spark.read.schema(JOBS[name]).csv(out)
        return result.withColumn("rank", F.round("rank", 6)) if "rank" in result.columns else result

    return run


def _saved_nowhere(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs that compute every row and keep none: how many rows each had."""
    source = fresh_path(spark, "reviews")
    tables.customer_reviews(spark, folder).write.parquet(source)
    names = ("filmscore", "userscore", "filmdatescore")
    rows = [(name, p.run_job(spark, source, name, "none", source="parquet")) for name in names]
    return spark.createDataFrame(rows, "analysis string, row_count long")


def _job(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job: reviews from a stored table, the analysis by name, files out."""
    source, out = fresh_path(spark, "reviews"), fresh_path(spark, "scores")
    tables.customer_reviews(spark, folder).write.parquet(source)
    p.run_job(spark, source, "filmscore", "distributed", out=out, source="parquet")
    return _read_scores(spark, out, "csv")


def queries() -> dict[str, Query]:
    return {**_review_queries(), **_llm_queries()}


def _llm_queries() -> dict[str, Query]:
    """The pipeline and the operators of the llm subpackage, where it is there."""
    return {} if llm is None else {"pipeline": corpus_pipeline.run, **llm.QUERIES}


def _llm_sql() -> dict[str, str]:
    whole = getattr(corpus_pipeline, "ORACLE_SQL", None)
    return {} if llm is None else {**({"pipeline": whole} if whole else {}), **llm.ORACLE_SQL}


def _review_queries() -> dict[str, Query]:
    customers, orders = tables.customer_reviews, tables.order_reviews
    return {
        "item_score": _on(customers, p.item_score),
        "user_score": _on(customers, p.user_score),
        "user_helpfulness": _on(customers, p.user_helpfulness),
        "length_helpfulness": _on(customers, p.length_helpfulness, length=True),
        "item_year_score": _on(customers, p.item_year_score),
        "item_year_score_one": _on(customers, lambda r: p.item_year_score(r, ITEM)),
        "item_period_score": _on(customers, p.item_period_score),
        "item_period_score_one": _on(customers, lambda r: p.item_period_score(r, ITEM)),
        "helpfulness_by_score": _on(customers, p.helpfulness_by_score),
        "helpfulness_by_score_one": _on(customers, lambda r: p.helpfulness_by_score(r, ITEM)),
        "consensus_lift_one": _on(customers, lambda r: p.consensus_lift(r, ITEM)),
        "consensus_rank": _on(customers, p.consensus_rank),
        "agreement_edges_similar": _on(customers, _edges(threshold=0.0)),
        "agreement_edges_help": _on(customers, _edges(with_helpfulness=True)),
        "agreement_edges_positive": _on(customers, _edges(with_helpfulness=True, positive_only=True)),
        "peer_rank_divergence": _on(customers, _rank("divergence")),
        "peer_rank_agreement": _on(customers, _rank("agreement")),
        "peer_rank_hot_item": _on(tables.returns_reviews, _rank("agreement", hot_least=HOT_LEAST)),
        "peer_rank_slots": _on(tables.returns_reviews, _rank("agreement", hot_least=HOT_LEAST, hot_count=0)),
        "consensus_rank_hot_item": _on(tables.returns_reviews, p.consensus_rank),
        "user_items": _on(customers, p.user_items),
        "suggest_all": _on(orders, _suggest()),
        "suggest_multi": _on(orders, _suggest("multi")),
        "suggest_overlap": _on(orders, _suggest("overlap")),
        "suggest_unseen": _on(orders, _suggest(exclude_seen=True)),
        "stanza_parse": _text_file(tables.document_stanzas),
        "stanza_parse_pages": _text_file(tables.page_stanzas),
        "stanza_permissive": _permissive,
        "review_preview": _preview,
        "sink_csv_roundtrip": _written(p.write_quoted_csv),
        "sink_parts_roundtrip": _written(p.write_parts),
        "sink_parquet_roundtrip": _written(lambda df, path: p.write_parts(df, path, "parquet"), "parquet"),
        "job_roundtrip": _job,
        "sink_none": _saved_nowhere,
        **{
            f"job_{name}": _named_job(name, save)
            for name, save in zip(JOBS, ("local", "distributed", "s3") * len(JOBS), strict=False)
        },
        "suggest_some_users": _for_some(lambda r, users: p.suggest(r, "overlap", users=users), orders),
        "agreement_edges_some_users": _for_some(
            lambda r, users: p.agreement_edges(r, with_helpfulness=True, users=users), customers
        ),
        # One hot item links nearly all users, so these are asked for some of them.
        "suggest_hot_item": _for_some(
            lambda r, users: p.suggest(r, "overlap", users=users, hot_least=HOT_LEAST), tables.returns_reviews, "777"
        ),
        "agreement_edges_hot_item": _for_some(
            lambda r, users: p.agreement_edges(r, 0.0, users=users, hot_least=HOT_LEAST), tables.returns_reviews, "777"
        ),
    }


# --- the same in SQL -------------------------------------------------------------------


def _view(item: str, user: str, tables_sql: str, columns: str = "") -> str:
    return f"""
r0 as (
  select {item} as item_id, {user} as user_id,
         cast(1 + (cast(l_quantity as bigint) - 1) % 5 as double) as score,
         cast(epoch(l_shipdate) as bigint) + (l_partkey % 12) * 31536000 as review_time,
         least((l_orderkey + l_linenumber) % 11, cast(round(l_discount * 100) as bigint)) as up,
         (l_orderkey + l_linenumber) % 11 as total{columns}
  from {tables_sql}),
r as (select *, case when total <> 0 then up * 100 // total end as pct from r0)"""


def _utf16(text: str) -> str:
    """UTF-16 units: one per character, and one more for each character above U+FFFF."""
    return f"length({text}) + length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"


CUSTOMERS = _view(
    "'P' || l_partkey", "'U' || o_custkey", "lineitem join orders on l_orderkey = o_orderkey"
)
CUSTOMER_LENGTHS = _view(
    "'P' || l_partkey",
    "'U' || o_custkey",
    f"""lineitem join orders on l_orderkey = o_orderkey left join
       (select doc_id, {_utf16("text")} as body_length from documents)
       on doc_id = (l_orderkey * 7 + l_linenumber) % (select count(*) from documents)""",
    ", body_length",
)
ORDERS = _view(
    "'P' || l_partkey || 'N' || s_nationkey",
    "'O' || l_orderkey",
    "lineitem join supplier on l_suppkey = s_suppkey",
)
# Numbers for users here: the pairs of the hot item are many.
RETURNS = _view("case when l_returnflag = 'R' then -1 else l_partkey end", "l_orderkey", "lineitem")

HELP = """
h as (select user_id, cast(cast(sum(coalesce(pct, 0)) as bigint) // count(*) as double) as help
      from r group by 1)"""
VOTED = """
g as (select item_id, score, cast(sum(pct) as bigint) // count(*) as mean_help
      from r where pct is not null group by 1, 2)"""
LATEST = """
latest as (select user_id, item_id, arg_max(score, (review_time, score)) as score, count(*) as n
           from r group by 1, 2)"""


def _pairs(who: str = "true") -> str:
    return f"""
pairs as (select a.user_id as user_1, b.user_id as user_2,
                 sum(abs(a.score - b.score)) / count(*) as degree,
                 cast(sum(b.n) as bigint) as overlap
          from (select * from r where {who}) a join latest b on a.item_id = b.item_id and a.user_id <> b.user_id
          group by 1, 2)"""


PAIRS = _pairs()
# Orders whose number ends in 777, and names for the numbers that the view of returns has.
FEW = _pairs("user_id % 1000 = 777")
ITEM_NAME = "case when item_id = -1 then 'RETURN' else 'P' || item_id end"


def _sql(*parts: str) -> str:
    return "with " + ",".join(parts[:-1]) + "\n" + parts[-1]


ITEM_SCORE = _sql(CUSTOMERS, "select item_id, avg(score) as mean_score from r group by 1")


USER_SCORE = _sql(CUSTOMERS, "select user_id, avg(score) as mean_score from r group by 1")
USER_HELP = _sql(CUSTOMERS, HELP, "select user_id, help from h")


def _year(where: str = "") -> str:
    return _sql(
        CUSTOMERS,
        f"""select item_id, strftime(make_timestamp(review_time * 1000000), '%Y') as year,
                   floor(avg(score) * 100 + 0.5) / 100 as mean_score
            from r {where} group by 1, 2""",
    )


def _period(where: str = "") -> str:
    return _sql(
        CUSTOMERS,
        f"""select item_id, case when review_time <= 1041379200 then '1997-2002'
                                 when review_time > 1199145600 then '2008-2012'
                                 else '2003-2007' end as period,
                   floor(avg(score) * 100 + 0.5) / 100 as mean_score
            from r {where} group by 1, 2""",
    )


def _edges_sql(condition: str) -> str:
    return _sql(
        CUSTOMERS,
        HELP,
        LATEST,
        PAIRS,
        f"""select user_1, user_2, degree, overlap, h1.help as help_1, h2.help - h1.help as help_diff
            from pairs join h h1 on h1.user_id = user_1 join h h2 on h2.user_id = user_2
            where degree <= 0.9 and {condition}""",
    )


def _rank_average_sql(digits: str = "", view: str = CUSTOMERS, user: str = "user_id") -> str:
    mean = "avg(case when help < mean_help then (help + mean_help) / 2 else help end)"
    return _sql(
        view,
        HELP,
        VOTED,
        f"""select {user} as user_id, {f"round({mean}, {digits})" if digits else mean} as rank
            from r join h using (user_id) join g using (item_id, score) group by 1""",
    )


def _rank_sql(view: str, weight: str, user: str = "h.user_id") -> str:
    return _sql(
        view,
        HELP,
        LATEST,
        """
mine as (select r.user_id, r.item_id, r.score, h.help from r join h on r.user_id = h.user_id),
seen as (select l.user_id, l.item_id, l.score, h.help from latest l join h on l.user_id = h.user_id),
pairs as (select a.user_id as user_1, b.user_id as user_2, any_value(b.help - a.help) as gain,
                 sum(abs(a.score - b.score)) / count(*) as degree
          from mine a join seen b on a.item_id = b.item_id and b.help > a.help group by 1, 2)""",
        f"""
gains as (select user_1, sum(({weight}) * gain) / count(*) as gain
          from pairs where degree <= 0.9 group by 1)""",
        f"""select {user} as user_id, round(h.help + coalesce(gain, 0), 6) as rank
            from h left join gains on h.user_id = user_1""",
    )


def _suggest_sql(weight: str = "1", givers: str = "", where: str = "") -> str:
    return _sql(
        ORDERS,
        LATEST,
        PAIRS,
        f"""select user_1 as user_id, r.item_id, sum({weight} * r.score) / sum({weight}) as predicted
            from pairs join r on r.user_id = user_2
            where degree <= 0 {givers} {where} group by 1, 2""",
    )


# What the parser trims, as an SQL string.
_TRIMMED = " || ".join(f"chr({ord(c)})" for c in CONTROL_CHARS if c != "\0")


def _parsed(text: str) -> str:
    """The parser's value of a field written as ``text``."""
    parts = f"string_split(replace({text}, chr(10), ' '), ':')"
    return f"array_to_string(list_transform({parts}, lambda part: trim(part, {_TRIMMED})), '')"


def _permissive_sql() -> str:
    """By the day of the review some fields are no numbers; -1 for what cannot be read."""
    return _sql(
        CUSTOMERS,
        """
d as (select *, review_time // 86400 as day from r),
t as (select *, case when day % 11 = 0 then up::varchar when day % 3 = 0 then 'many/' || total else up || '/' || total end as helpfulness,
             case when day % 11 = 0 or day % 3 <> 0 then up end as u, case when day % 11 <> 0 then total end as v from d)""",
        """select item_id, user_id, helpfulness, case when day % 5 = 0 then -1.0 else score end as score,
                   case when day % 7 = 0 then -1 else review_time end as review_time,
                   coalesce(u, -1) as up_votes, coalesce(v, -1) as total_votes, coalesce(v - u, -1) as down_votes,
                   coalesce(case when v <> 0 then u * 100 // v end, -1) as helpful_pct
            from t""",
    )


def _stanza_sql(table: str, item: str, number: str, title: str, text: str) -> str:
    return f"""
with t as (select {item} as item_id, {number} as k, {_parsed("'About: ' || " + title)} as summary,
                  {_parsed(text)} as body from {table})
select item_id, 'U' || k as user_id, '' as profile_name,
       (k % 7) || '/' || (k % 11) as helpfulness, cast(k % 5 + 1 as double) as score,
       1000000000 + k * 86400 as review_time, summary, body, k % 7 as up_votes,
       k % 11 as total_votes, k % 11 - k % 7 as down_votes,
       case when k % 11 <> 0 then (k % 7) * 100 // (k % 11) else -1 end as helpful_pct,
       {_utf16("body")} as body_length
from t"""


def oracle_sql() -> dict[str, str]:
    return {**_review_sql(), **_llm_sql()}


def _review_sql() -> dict[str, str]:
    documents = _stanza_sql("documents", "source", "doc_id", "lang", "text")
    only = f"where item_id = '{ITEM}'"
    seen = "and not exists (select 1 from r s where s.user_id = user_1 and s.item_id = r.item_id)"
    several = "and user_2 in (select user_id from r group by 1 having count(*) > 1)"
    return {
        "item_score": ITEM_SCORE,
        "user_score": USER_SCORE,
        "user_helpfulness": USER_HELP,
        "length_helpfulness": _sql(
            CUSTOMER_LENGTHS,
            """select '< ' || cast(bucket * 1024 as varchar) as length_class,
                       cast(sum(pct) as bigint) // count(*) as mean_help
                from (select body_length // 1024 as bucket, pct from r where pct is not null)
                group by bucket order by bucket""",
        ),
        "item_year_score": _year(),
        "item_year_score_one": _year(only),
        "item_period_score": _period(),
        "item_period_score_one": _period(only),
        "helpfulness_by_score": _sql(CUSTOMERS, VOTED, "select item_id, score, mean_help from g"),
        "helpfulness_by_score_one": _sql(CUSTOMERS, VOTED, f"select score, mean_help from g {only}"),
        "consensus_lift_one": _sql(
            CUSTOMERS,
            HELP,
            VOTED,
            f"""select user_id, case when help < mean_help then (help + mean_help) / 2 else help end
                       as lifted_help
                from r join h using (user_id) join g using (item_id, score) {only}""",
        ),
        "consensus_rank": _rank_average_sql(),
        "agreement_edges_similar": _sql(
            CUSTOMERS, LATEST, PAIRS, "select user_1, user_2, degree, overlap from pairs where degree <= 0"
        ),
        "agreement_edges_help": _edges_sql("true"),
        "agreement_edges_positive": _edges_sql("h2.help > h1.help"),
        "peer_rank_divergence": _rank_sql(CUSTOMERS, "degree"),
        "peer_rank_agreement": _rank_sql(CUSTOMERS, "1 - degree"),
        "peer_rank_hot_item": _rank_sql(RETURNS, "1 - degree", "'O' || h.user_id"),
        "peer_rank_slots": _rank_sql(RETURNS, "1 - degree", "'O' || h.user_id"),
        "consensus_rank_hot_item": _rank_average_sql(view=RETURNS, user="'O' || user_id"),
        "user_items": _sql(
            CUSTOMERS, "select user_id, item_id, score, count(*) as n from r group by 1, 2, 3"
        ),
        "suggest_all": _suggest_sql(),
        "suggest_multi": _suggest_sql(givers=several),
        "suggest_overlap": _suggest_sql("overlap"),
        "suggest_unseen": _suggest_sql(where=seen),
        "stanza_parse": documents,
        "stanza_parse_pages": _stanza_sql("pages", "'web'", "page_id", "url", "html"),
        "stanza_permissive": _permissive_sql(),
        "sink_none": f"""
            select 'filmscore' as analysis, count(*) as row_count from ({ITEM_SCORE})
            union all select 'userscore', count(*) from ({USER_SCORE})
            union all select 'filmdatescore', count(*) from ({_year()})""",
        "review_preview": f"""
            select item_id, user_id, score, helpfulness, summary, body[1:128] || '...' as preview
            from ({documents})""",
        "sink_csv_roundtrip": ITEM_SCORE,
        "sink_parts_roundtrip": ITEM_SCORE,
        "sink_parquet_roundtrip": ITEM_SCORE,
        "job_roundtrip": ITEM_SCORE,
        "job_filmscore": ITEM_SCORE,
        "job_userscore": USER_SCORE,
        "job_userhelpfulness": USER_HELP,
        "job_filmdatescore": _year(),
        "job_filmdatescore_aggregated": _period(),
        "job_lengthhelpfulness": f"""
            select '< ' || (body_length // 1024) * 1024 as length_class, cast(sum(helpful_pct) as bigint) // count(*) as mean_help
            from ({documents}) where helpful_pct >= 0 group by body_length // 1024""",
        "job_pagerank_average": _rank_average_sql("6"),
        "job_pagerank_averageI": _rank_average_sql("6"),
        "job_pagerank_medium": _rank_sql(CUSTOMERS, "degree"),
        "job_pagerank_naive": _rank_sql(CUSTOMERS, "degree"),
        "job_pagerank_optimized": _rank_sql(CUSTOMERS, "1 - degree"),
        "job_usersuggestion_naive": _suggest_sql(),
        "job_usersuggestion_improved": _suggest_sql(givers=several),
        "job_usersuggestion_optimized": _suggest_sql("overlap"),
        "suggest_some_users": _suggest_sql("overlap", where="and user_1 like '%7'"),
        "agreement_edges_some_users": _edges_sql("user_1 like '%7'"),
        "suggest_hot_item": _sql(
            RETURNS,
            LATEST,
            FEW,
            f"""select 'O' || user_1 as user_id, {ITEM_NAME} as item_id, sum(overlap * r.score) / sum(overlap) as predicted
                from pairs join r on r.user_id = user_2 where degree <= 0 group by 1, 2""",
        ),
        "agreement_edges_hot_item": _sql(
            RETURNS,
            LATEST,
            FEW,
            "select 'O' || user_1 as user_1, 'O' || user_2 as user_2, degree, overlap from pairs where degree <= 0",
        ),
    }
