"""The library's tables, derived from the whole test tables: once for Spark, once in SQL.

Keys grow with the data (pairs of documents share a url, jobs are user-days), so group
sizes stay as they are when the tables grow.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.constants import LINK_CLASS, ORG_CLASS
from newsloom.session import configure
from newsloom.sources.pages import page_path, with_path_fields

AS_OF = datetime(2001, 8, 1, 12, 0, 0)
RUN_AT = datetime(2024, 2, 1, 0, 0, 0)


# Stated, so that opening a table reads no file.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _trunc(unit: str, time: str) -> Column:
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def _key(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), column.cast("string"))



def _url() -> Column:
    """Every fifth document is a second version of the url four documents before it."""
    return _key("doc/", F.col("doc_id") - F.when(F.col("doc_id") % 5 == 4, 4).otherwise(0))


ARTICLES = """
select d.doc_id as seq,
       concat('doc/', cast(d.doc_id - case when d.doc_id % 5 = 4 then 4 else 0 end as varchar)) as url,
       concat('title ', cast(d.doc_id as varchar)) as title,
       case d.doc_id % 3 when 0 then '' when 1 then 'pending'
            else concat('html/', cast(d.doc_id as varchar)) end as file_path,
       date_trunc('hour', e.ts) as create_time,
       case when d.doc_id % 5 = 0 then 'pending' else d.text end as content,
       case when d.doc_id % 5 = 0 then 'pending' else d.lang end as summary,
       case when d.doc_id % 2 = 0 then '' else cast(cast(e.ts as date) as varchar) end as publish_date
from documents d join events e on e.event_id = d.doc_id
"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    waiting = F.col("doc_id") % 5 == 0
    return docs.join(events, "doc_id").select(
        F.col("doc_id").alias("seq"),
        _url().alias("url"),
        _key("title ", F.col("doc_id")).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "pending")
        .otherwise(_key("html/", F.col("doc_id"))).alias("file_path"),
        _trunc("hour", "ts").alias("create_time"),
        F.when(waiting, "pending").otherwise(F.col("text")).alias("content"),
        F.when(waiting, "pending").otherwise(F.col("lang")).alias("summary"),
        F.when(F.col("doc_id") % 2 == 0, "")
        .otherwise(F.col("ts").cast("date").cast("string")).alias("publish_date"),
    )


FRAGMENTS = """
select l.doc_id as seq, case when l.doc_id % 4 = 0 then null else d.source end as org,
       d.source as ticker, concat('doc/', cast(l.doc_id as varchar)) as url,
       date_trunc('day', e.ts) as time_created, d.lang as related_reason_simple,
       case when l.doc_id % 6 = 0 then null else concat('about ', d.lang) end as related_reason_short,
       case when l.quality = 1 then 'positive' else 'negative' end as polarity,
       concat('title ', cast(l.doc_id as varchar)) as title,
       case when l.toxic = 1 then 'down' else 'up' end as actual_trend,
       d.text as quote_frag
from labels l join documents d on d.doc_id = l.doc_id join events e on e.event_id = l.doc_id
"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    joined = (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents"), "doc_id")
        .join(events, "doc_id")
    )
    return joined.select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("org"),
        F.col("source").alias("ticker"),
        _key("doc/", F.col("doc_id")).alias("url"),
        _trunc("day", "ts").alias("time_created"),
        F.col("lang").alias("related_reason_simple"),
        F.when(F.col("doc_id") % 6 != 0, F.concat(F.lit("about "), "lang"))
        .alias("related_reason_short"),
        F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("polarity"),
        _key("title ", F.col("doc_id")).alias("title"),
        F.when(F.col("toxic") == 1, "down").otherwise("up").alias("actual_trend"),
        F.col("text").alias("quote_frag"),
    )


STATUS = """
select e.event_id as seq,
       concat(cast(e.user_id as varchar), '-', cast(cast(e.ts as date) as varchar)) as job_id,
       case e.event_type when 'error' then 'Job failed: x' when 'purchase' then 'news crops ready'
            when 'view' then 'sumaries ready'
            else concat('news ready ', cast(e.user_id as varchar), '-', cast(cast(e.ts as date) as varchar))
       end as status,
       date_trunc('hour', e.ts) as time
from events e
"""


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), job.alias("job_id"),
        F.when(kind == "error", "Job failed: x").when(kind == "purchase", "news crops ready")
        .when(kind == "view", "sumaries ready")
        .otherwise(F.concat(F.lit("news ready "), job)).alias("status"),
        _trunc("hour", "ts").alias("time"),
    )


SNAPSHOTS = """
select o_orderkey as seq, concat('T', cast(o_custkey as varchar)) as ticker, c_name as org,
       o_orderdate as time_created,
       case o_orderstatus when 'F' then [o_orderpriority]
            else [o_orderpriority, concat('doc/', cast(o_orderkey as varchar))] end as url_keys
from orders join customer on c_custkey = o_custkey
"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    one = F.col("o_orderpriority")
    return joined.select(
        F.col("o_orderkey").alias("seq"), _key("T", F.col("o_custkey")).alias("ticker"),
        F.col("c_name").alias("org"), F.col("o_orderdate").alias("time_created"),
        F.when(F.col("o_orderstatus") == "F", F.array(one))
        .otherwise(F.array(one, _key("doc/", F.col("o_orderkey")))).alias("url_keys"),
    )


# Seven documents make a job; labelled documents are asked for twice, every tenth url is unknown.
REQUESTS = """
select doc_id as seq, concat('r', cast(doc_id // 7 as varchar)) as job_id, 0 as pos,
       concat(case when doc_id % 10 = 9 then 'missing/' else 'doc/' end, cast(doc_id as varchar)) as url,
       source as ticker, case when doc_id % 3 = 0 then null else source end as org
from documents
union all
select d.doc_id, concat('r', cast(d.doc_id // 7 as varchar)), 1,
       concat(case when d.doc_id % 10 = 9 then 'missing/' else 'doc/' end, cast(d.doc_id as varchar)),
       d.source, case when d.doc_id % 3 = 0 then null else d.source end
from documents d join labels l on l.doc_id = d.doc_id
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per document, listing its url once or, if it is labelled, twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("twice"))
    prefix = F.when(F.col("doc_id") % 10 == 9, "missing/").otherwise("doc/")
    url = F.concat(prefix, F.col("doc_id").cast("string"))
    return docs.join(labelled, "doc_id", "left").select(
        F.col("doc_id").alias("seq"), _key("r", F.expr("doc_id div 7")).alias("job_id"),
        F.when(F.col("twice"), F.array(url, url)).otherwise(F.array(url)).alias("urls"),
        F.col("source").alias("ticker"),
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("org"),
    )


OUTPUTS = """
select doc_id, case doc_id % 4
         when 0 then concat('Summary: ', lang, ': x', chr(10), 'Date: 2024')
         when 1 then concat('DATE:  d ', chr(10), 'sUmmary:a: b', chr(10), 'summary: second')
         when 2 then text
         else concat(' Summary: blank first', chr(10), text) end as answer
from documents
"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(kind == 0, F.concat(F.lit("Summary: "), "lang", F.lit(": x\nDate: 2024")))
        .when(kind == 1, F.lit("DATE:  d \nsUmmary:a: b\nsummary: second"))
        .when(kind == 2, F.col("text"))
        .otherwise(F.concat(F.lit(" Summary: blank first\n"), "text")).alias("answer"),
    )


INSIGHTS = """
select doc_id, case doc_id % 9
         when 0 then '{"related_reason_simple":"no relation"}'
         when 1 then '{"polarity":"up"}'
         when 2 then concat('{"related_reason_simple":"', lang, '","polarity":null}')
         when 3 then '{"related_reason_simple":"cut'
         when 4 then '[1]'
         when 5 then '{}'
         when 6 then '{"related_reason_simple":"Earnings"} and more'
         when 7 then '{"related_reason_simple":null,"quote_frag":"q"}'
         else concat('{"related_reason_simple":"M&A","related_reason_short":"', source,
                     '","polarity":"negative","actual_trend":"down","quote_frag":"x"}') end as answer
from documents
"""


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 9
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(kind == 0, F.lit('{"related_reason_simple":"no relation"}'))
        .when(kind == 1, F.lit('{"polarity":"up"}'))
        .when(kind == 2, F.concat(
            F.lit('{"related_reason_simple":"'), "lang", F.lit('","polarity":null}')))
        .when(kind == 3, F.lit('{"related_reason_simple":"cut'))
        .when(kind == 4, F.lit("[1]"))
        .when(kind == 5, F.lit("{}"))
        .when(kind == 6, F.lit('{"related_reason_simple":"Earnings"} and more'))
        .when(kind == 7, F.lit('{"related_reason_simple":null,"quote_frag":"q"}'))
        .otherwise(F.concat(
            F.lit('{"related_reason_simple":"M&A","related_reason_short":"'), "source",
            F.lit('","polarity":"negative","actual_trend":"down","quote_frag":"x"}'),
        )).alias("answer"),
    )


# Landed pages, two to a ticker.
def news_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "url", "html", _key("html/", F.col("page_id")).alias("path"),
        _key("T", F.expr("page_id div 2")).alias("ticker"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(hours=F.col("page_id").cast("int"))).alias("downloaded_at"),
    )


PAGES = """
select url, html, page_id, concat('html/', cast(page_id as varchar)) as path,
       concat('T', cast(page_id // 2 as varchar)) as ticker,
       timestamp '2024-01-01 00:00:00' + page_id * interval 1 hour as downloaded_at
from pages
"""

PAGE_ARTICLES = """
select page_id as seq, url, concat('page ', cast(page_id as varchar)) as title,
       concat('html/', cast(page_id as varchar)) as file_path,
       timestamp '2024-01-01 00:00:00' as create_time,
       case when page_id % 4 = 3 then 'stored' else 'pending' end as content,
       case when page_id % 4 = 3 then 'stored' else 'pending' end as summary,
       '' as publish_date
from pages
"""


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article per landed page, three of four waiting for their summary."""
    mark = F.when(F.col("page_id") % 4 == 3, "stored").otherwise("pending")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), "url", _key("page ", F.col("page_id")).alias("title"),
        _key("html/", F.col("page_id")).alias("file_path"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("create_time"),
        mark.alias("content"), mark.alias("summary"), F.lit("").alias("publish_date"),
    )


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stage request per page."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), _key("p", F.col("page_id")).alias("job_id"),
        F.array("url").alias("urls"), _key("T", F.expr("page_id div 2")).alias("ticker"),
        F.lit(None).cast("string").alias("org"),
    )

# Articles and landed news pages whose urls look like the links on the test pages.
WORD_ARTICLES = """
select doc_id as seq, concat('/', split_part(text, ' ', 2)) as url from documents
"""


def _word(n: int) -> Column:
    """The ``n``-th word of the text as a path, without splitting the rest of the text."""
    return F.concat(F.lit("/"), F.regexp_extract("text", "^" + "[^ ]* " * (n - 1) + "([^ ]*)", 1))


def word_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        _word(2).alias("url"),
    )


WORD_PAGES = """
select concat('/', split_part(d.text, ' ', 3)) as url, d.source as ticker,
       concat('news/', cast(d.doc_id as varchar)) as path, e.ts as downloaded_at
from documents d join events e on e.event_id = d.doc_id
"""


def word_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    # The url is made before the join: where nobody wants the html, no text is shuffled.
    return table(spark, sf_dir, "documents").withColumn("url", _word(3)).join(events, "doc_id").select(
        "url", F.col("source").alias("ticker"), _key("news/", F.col("doc_id")).alias("path"),
        F.col("ts").alias("downloaded_at"), F.col("text").alias("html"),
    )


NEWS = "https://sg.finance.yahoo.com/news/"


def chart_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart page per document in the layout that jobs expect: an organisation on two of three,
    two anchors of the news class, one of another class, one to another site, one without title,
    and the first once more under another title."""
    word = F.concat(F.lit(NEWS), "source", F.lit("/"), F.col("doc_id").cast("string"))

    def anchor(link_class: str, href: Column, title: Column) -> Column:
        return F.concat(F.lit(f'<a class="{link_class}" href="'), href, F.lit('" title="'), title, F.lit('">x</a>'))

    name = F.concat(F.lit(f'<div class="{ORG_CLASS}" title="Org &amp; '), "lang", F.lit('">x</div>'))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.concat(
            F.lit("<html><body>"), F.when(F.col("doc_id") % 3 > 0, name).otherwise(F.lit("<div>none</div>")),
            anchor(LINK_CLASS, word, F.concat(F.lit("About "), "lang")),
            anchor(LINK_CLASS, F.concat(word, F.lit("/b")), F.lit("Second")),
            anchor("plain", F.concat(word, F.lit("/c")), F.lit("Plain")),
            anchor(LINK_CLASS, F.lit("https://other.example/news"), F.lit("Elsewhere")),
            anchor(LINK_CLASS, F.concat(word, F.lit("/d")), F.lit("")),
            anchor(LINK_CLASS, word, F.concat(F.lit("Again "), "source")),
            F.lit("</body></html>"),
        ).alias("html"),
    )


def main_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per document whose main element holds a script, a style and a comment between text."""
    line = F.concat("source", F.lit(" says "), "lang", F.lit(" "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.concat(
            F.lit("<html><head><title>No</title></head><body><p>Before</p><main id='m'><h1>"), line,
            F.lit("</h1><script>var a = '<p>no</p>';</script><style>p { x: y }</style>"),
            F.lit("<p>A first paragraph <!-- not this --> goes on</p><p>short</p>"),
            F.when(F.col("doc_id") % 2 == 0, F.lit("<div>Story continues</div><p>Left out of it</p>"))
            .otherwise(F.lit("<p>The last paragraph</p>")),
            F.lit("</main><p>After</p></body></html>"),
        ).alias("html"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as single files (the writer ends each with a line end): each has its usual name, every
    eleventh another one."""
    landed = news_pages(spark, sf_dir)
    kind = F.when(F.col("page_id") % 2 == 0, "chart").otherwise("news")
    usual = page_path(F.lit("/raw"), F.col("ticker"), kind, F.col("downloaded_at"))
    other = F.concat(F.lit("/raw/notes "), F.col("page_id").cast("string"))
    return landed.withColumn("page_id", F.substring_index("path", "/", -1).cast("bigint")).select(
        "page_id", "html", F.when(F.col("page_id") % 11 == 10, other).otherwise(usual).alias("page"))


NO_PAGE = "__HIVE_DEFAULT_PARTITION__"
FOLDERS = 4


def write_page_files(files: DataFrame, folder: str) -> None:
    """A file per row of (html, page), named after its page and ended by a line end.

    Hadoop's local file system starts a process for every file it creates, to set its mode, so
    where ``folder`` is a path of the machine the tasks write the files themselves. Elsewhere, and
    with a folder per page, Spark's writer does.
    """
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    at = store.makeQualified(path).toUri()
    # A file per page: writing them is work for all tasks, however few files hold the pages.
    spread = files.repartition(spark.sparkContext.defaultParallelism * 4, "page")
    if at.getScheme() != "file":
        spread.write.mode("append").partitionBy("page").option("maxRecordsPerFile", 1).text(folder)
        return
    top = at.getPath()

    def run(batches):
        import os
        from collections import Counter
        from urllib.parse import quote
        from zlib import crc32

        import pyarrow as pa
        from pyspark import TaskContext

        # A task's files in few folders, so that they are listed by few calls, but in so many
        # folders in all that executors list them. A repeated task writes its files again.
        part, copies = TaskContext.get().partitionId(), Counter()
        for i in range(FOLDERS):
            os.makedirs(f"{top}/{part}-{i}", exist_ok=True)
        for batch in batches:
            for html, page in zip(batch.column("html").to_pylist(), batch.column("page").to_pylist()):
                name = NO_PAGE if page is None else quote(page, safe="")
                with open(f"{top}/{part}-{crc32(name.encode()) % FOLDERS}/page={name}+{copies[page]}", "wb") as file:
                    file.write((html or b"") + b"\n")
                copies[page] += 1
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    spread.select(F.col("html").cast("binary").alias("html"), "page").mapInArrow(run, "files bigint").agg(
        F.sum("files")).collect()


def decoded_names(files: DataFrame) -> DataFrame:
    """The page's name, with its signs as numbers, is in the file's name, before a + and the number of
    its copy, or where Spark's writer wrote in a folder's name."""
    name = F.url_decode(F.regexp_extract("path", "/page=([^/+]*)", 1))
    # Two steps: once for the file's or folder's name and once for the path as a URL.
    return with_path_fields(files.withColumn("path", F.url_decode(name)))


# Two customers ask for one ticker.
CRAWLS = """
select c_custkey as seq, concat('job-', cast(c_custkey as varchar)) as job_id,
       concat('T', cast(c_custkey // 2 as varchar)) as ticker
from customer
"""


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), _key("job-", F.col("c_custkey")).alias("job_id"),
        _key("T", F.expr("c_custkey div 2")).alias("ticker"),
    )


FORMS = """
select c_custkey as seq, case when c_nationkey = 3 then '' else c_name end as user_id,
       case when c_nationkey = 5 then '' else lower(c_mktsegment) end as session_id,
       case when c_acctbal < 0 then '' else concat('t', cast(c_custkey as varchar), '.hk') end as ticker,
       substr(md5(c_name), 1, 8) as suffix
from customer
"""


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"),
        F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_name")).alias("user_id"),
        F.when(F.col("c_nationkey") == 5, "").otherwise(F.lower("c_mktsegment"))
        .alias("session_id"),
        F.when(F.col("c_acctbal") < 0, "")
        .otherwise(F.concat(F.lit("t"), F.col("c_custkey").cast("string"), F.lit(".hk")))
        .alias("ticker"),
        F.substring(F.md5("c_name"), 1, 8).alias("suffix"),
    )


UPDATES = """
select l.doc_id as seq,
       concat('doc/', cast(l.doc_id - case when l.doc_id % 5 = 4 then 4 else 0 end as varchar)) as url,
       case when l.quality = 1 then concat('new ', d.text) end as content, d.source as summary,
       case when l.toxic = 1 then 'today' end as publish_date
from labels l join documents d on d.doc_id = l.doc_id
"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("seq"), _url().alias("url"),
        F.when(F.col("quality") == 1, F.concat(F.lit("new "), "text")).alias("content"),
        F.col("source").alias("summary"), F.when(F.col("toxic") == 1, "today").alias("publish_date"),
    )


PROMPTS = """
select 'insight' as name, item_id as version, concat(chr(160), chr(10), text, ' ', chr(9)) as text
from benchmark
"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.lit("insight").alias("name"), F.col("item_id").alias("version"),
        F.concat(F.lit(" \n"), "text", F.lit(" \t")).alias("text"),
    )
