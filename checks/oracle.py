"""The queries of ``queries.py`` in SQL, over the views of ``views.py``."""

from __future__ import annotations

from checks import views

AS_OF = "timestamp '2001-08-01 12:00:00'"
RUN_AT = "timestamp '2024-02-01 00:00:00'"
STUCK_AT = "timestamp '2024-01-15 00:00:00'"
CHILD = 1 << 20

NAMED = {
    "articles": views.ARTICLES,
    "fragments": views.FRAGMENTS,
    "status": views.STATUS,
    "snapshots": views.SNAPSHOTS,
    "requests": views.REQUESTS,
    "outputs": views.OUTPUTS,
    "insights": views.INSIGHTS,
    "landed": views.PAGES,
    "page_articles": views.PAGE_ARTICLES,
    "word_articles": views.WORD_ARTICLES,
    "word_pages": views.WORD_PAGES,
    "crawls": views.CRAWLS,
    "forms": views.FORMS,
    "updates": views.UPDATES,
    "prompts": views.PROMPTS,
}


def _with(names: str, sql: str) -> str:
    """``sql`` after WITH clauses for the named views."""
    clauses = ", ".join(f"{name} as ({NAMED[name].strip()})" for name in names.split())
    return f"with {clauses}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}"


WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
URL_NO = "concat('doc/', cast(doc_id - case when doc_id % 5 = 4 then 4 else 0 end as varchar))"
JOB = "concat(cast(user_id as varchar), '-', cast(cast(ts as date) as varchar))"


def _unescaped(text: str) -> str:
    """The two entities of the test pages; at the end of a text node their ``;`` may be missing."""
    quotes = f"regexp_replace({text}, '&quot(;|$)', '\"', 'g')"
    return f"regexp_replace({quotes}, '&amp(;|$)', '&', 'g')"


def _reflowed(text: str) -> str:
    return f"""array_to_string(list_transform(string_split({text}, chr(10)),
        lambda l: concat(case when starts_with(l, ')') or length(l) < 10 then ' ' else chr(10) end, l)), '')"""


def _first_line(label: str, otherwise: str) -> str:
    found = f"list_filter(string_split(answer, chr(10)), lambda l: starts_with(lower(l), '{label}:'))"
    return f"""case when len({found}) > 0
        then trim(substr({found}[1], length('{label}:') + 1), {WHITE}) else {otherwise} end"""


# Text nodes of <article>, which on the test pages is closed and holds no comment or script.
PAGE_TEXT = f"""page_text as (
    select page_id, url, {_reflowed('''split_part(array_to_string(list_filter(list_transform(
        regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>'),
        lambda x: trim(''' + _unescaped('x') + f''', {WHITE})), lambda x: x <> ''), chr(10)),
        'Story continues', 1)''')} as content
    from pages)"""

PAGE_LINKS = """page_links as (
    select page_id, unnest(range(len(hrefs))) as pos, unnest(hrefs) as href, unnest(titles) as title
    from (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hrefs,
                 regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as titles from pages))"""

CAPPED = """capped as (
    select page_id, min(pos) as pos, href, arg_max(title, pos) as title
    from (select *, row_number() over (partition by page_id order by pos) as n from page_links
          where contains(href, '/') and href <> '' and title <> '')
    where n <= 5 group by page_id, href)"""

# The same without a limit, as the jobs take them.
EVERY_LINK = CAPPED.replace("where n <= 5 group", "group")

LATEST_SNAPSHOT = """newest as (
    select ticker, seq, org, time_created, url_keys from (
        select *, row_number() over (partition by ticker order by time_created desc, seq) as n
        from snapshots) where n = 1)"""

JOB_STATUS = """job_states as (
    select job_id, case when bool_or(status = 'news crops ready') then 'news crops ready'
                        else max(case when n = 1 then status end) end as status
    from (select *, row_number() over (partition by job_id order by time desc, seq) as n from status)
    group by job_id)"""


def _freshness(hours: int) -> str:
    return _with("snapshots", f"""+{LATEST_SNAPSHOT}, asked as (
        select concat('T', cast(c_custkey as varchar)) as ticker from customer
        union select concat('S', cast(s_suppkey as varchar)) from supplier)
        select ticker, time_created, org, seq,
               coalesce({AS_OF} - time_created > interval {hours} hours, true) as expired
        from asked left join newest using (ticker)""")


SUMMARISED = f"""{PAGE_TEXT}, asked as (
    select p.url, p.content, length(concat('Content: ', p.content, chr(10), chr(10),
        'Please provide a summary and infer the publication date.', chr(10))) as n
    from page_text p join page_articles a on a.url = p.url where a.content = 'pending'
), updates as (
    select url, content, case when n % 2 = 1 then concat('asked: ', cast(n as varchar))
                              else cast(n as varchar) end as summary,
           case when n % 2 = 1 then concat('day ', cast(n % 5 as varchar)) else '' end as publish_date
    from asked where n % 7 <> 0)"""

INSIGHT_ROWS = """pairs as (
    select url, ticker, min(seq * 1048576 + pos) as seq, arg_min(coalesce(org, ''), seq * 1048576 + pos) as org
    from requests r where not exists (
        select 1 from fragments f where f.url = r.url and f.ticker = r.ticker)
    group by url, ticker
), latest as (
    select * from (select *, row_number() over (partition by url order by create_time desc, seq) as n
                   from articles) where n = 1
), asked as (
    select p.seq, p.url, p.ticker, p.org, l.title,
        concat('Company: ', case when p.org = '' then 'Not specified' else p.org end,
               chr(10), 'Ticker: ', p.ticker, chr(10), 'Article Title: ', l.title,
               chr(10), 'Publication Date: ', case when l.publish_date = '' then 'Not specified' else l.publish_date end,
               chr(10), chr(10), 'News Content:', chr(10), l.content, chr(10)) as prompt
    from pairs p join latest l on l.url = p.url where l.content not in ('', 'pending')
), answered as (select *, length(prompt) as n from asked)"""

INGESTED = f"""{LATEST_SNAPSHOT}, {PAGE_LINKS}, {EVERY_LINK}, asked as (
    select ticker, min(seq) as seq from crawls group by ticker
), looked as (
    select a.ticker, a.seq, n.org, n.url_keys,
           coalesce({AS_OF} - n.time_created > interval 720 hours, true) as expired
    from asked a left join newest n on n.ticker = a.ticker
), charts as (
    select ticker, arg_max(page_id, downloaded_at) as page_id from landed group by ticker
), renewed as (
    select l.ticker, l.seq, c.page_id from looked l join charts c on c.ticker = l.ticker where l.expired
), renewed_links as (
    select r.ticker, r.seq, k.href, k.title, row_number() over (partition by r.ticker order by k.pos) - 1 as pos
    from renewed r join capped k on k.page_id = r.page_id)"""

INSIGHT_KEYS = ("related_reason_simple", "related_reason_short", "polarity", "actual_trend", "quote_frag")
DEFAULTS = {"polarity": "neutral", "actual_trend": "unknown"}


def _insight_field(key: str) -> str:
    return (f"case when list_contains(json_keys(object), '{key}') "
            f"then json_extract_string(object, '$.{key}') else '{DEFAULTS.get(key, '')}' end as {key}")


def _cards(source: str) -> str:
    return f"""select rn, concat('Insight ', cast(rn as varchar), ': ', coalesce(related_reason_simple, 'N/A')) as heading,
        coalesce(ticker, 'N/A') as ticker, coalesce(related_reason_simple, 'N/A') as event,
        coalesce(related_reason_short, 'N/A') as insight, coalesce(polarity, 'N/A') as polarity,
        coalesce(url, 'N/A') as source from ({source}) where rn <= 10"""


def _ranked(table: str) -> str:
    return f"""select *, cast(row_number() over (partition by ticker order by time_created desc, seq) as integer) as rn
            from {table}"""


INSIGHT_FRAGMENTS = f"""select seq, org, ticker, url, {RUN_AT} as time_created,
               case when n % 5 = 1 then '' else concat('reason ', cast(n % 3 as varchar)) end as related_reason_simple,
               case when n % 5 = 1 then null else 'Company: ' end as related_reason_short,
               case when n % 5 = 1 then 'neutral' when n % 2 = 1 then 'positive' else 'negative' end as polarity,
               title, case when n % 5 = 1 then 'unknown' else 'up' end as actual_trend,
               case when n % 5 = 1 then '' else concat('"', cast(n as varchar), '"', chr(10)) end as quote_frag
        from answered where n % 5 not in (0, 2)"""

SNAPSHOT = "seq, ticker, org, time_created, array_to_string(url_keys, '|') as urls"

ORACLE = {
    "top_fragments": _with("fragments", _cards(_ranked("fragments"))),
    "top_one_ticker": _with("fragments", """select seq, url, time_created from fragments
        where ticker = 'src3' order by time_created desc, seq limit 10"""),
    "snapshots_all": _with("snapshots", f"select {SNAPSHOT} from snapshots"),
    "snapshots_ticker": _with("snapshots", f"select {SNAPSHOT} from snapshots where ticker = 'T7'"),
    "append_snapshot": _with("snapshots crawls", f"""
        select {SNAPSHOT} from snapshots
        union all select seq, ticker, job_id, {AS_OF}, job_id from crawls"""),
    "append_article": _with("page_articles word_articles", f"""
        select seq, url, title, file_path, create_time, content, summary, publish_date from page_articles
        union all select seq, url, concat('to ', url), '', {RUN_AT}, 'pending', 'pending', '' from word_articles"""),
    "append_fragment": _with("fragments", f"""
        select * replace (md5(quote_frag) as quote_frag) from fragments
        union all
        select * replace (md5(quote_frag) as quote_frag,
            case when polarity = 'positive' then time_created else {RUN_AT} end as time_created)
        from fragments"""),
    "append_status": _with("status crawls", f"""
        select seq, job_id, status, time from status
        union all select seq, job_id, concat('news ready ', job_id), {RUN_AT} from crawls
        union all select seq, job_id, 'sumaries ready', {RUN_AT} from crawls
        union all select seq, job_id, concat('Job failed: ', ticker), {RUN_AT} from crawls"""),
    "upsert": _with("articles updates", """+last as (
        select url, arg_max(content, seq) filter (where content is not null) as content,
               arg_max(summary, seq) filter (where summary is not null) as summary,
               arg_max(publish_date, seq) filter (where publish_date is not null) as publish_date
        from updates group by url)
        select a.seq, a.url, md5(coalesce(l.content, a.content)) as content_md5,
               coalesce(l.summary, a.summary) as summary,
               coalesce(l.publish_date, a.publish_date) as publish_date
        from articles a left join last l on l.url = a.url"""),
    "upsert_found": _with("articles updates", """
        select url, url in (select url from articles) as found
        from (select url from updates union select url from pages)"""),
    "clear_jobs": _with("status", f"""select * from status where job_id not in (
        select {JOB} from events where event_type = 'signup')"""),
    "cleared_jobs": _with("status crawls", f"""
        select job_id, cast(job_id in (select job_id from status) as integer) as removed
        from (select {JOB} as job_id from events where event_type = 'signup'
              union select job_id from crawls)"""),
    "crawl_messages": _with("crawls", "select seq, job_id, ticker from crawls"),
    "stage_messages": _with("requests", """
        select seq, job_id, ticker, org, cast(pos as bigint) as pos, url from requests"""),
    "page_names": _with("word_pages", """
        select path as id, concat('/raw/', ticker, '/', ticker,
                   case when length(ticker) = 4 then '_TM_' else '_news_TM_' end,
                   strftime(downloaded_at, '%Y-%m-%d_T_%H-%M-%S'), '.html') as path,
               ticker, case when length(ticker) = 4 then 'chart' else 'news' end as kind,
               date_trunc('second', downloaded_at) as downloaded_at
        from word_pages"""),
    "prompt": _with("articles prompts", f"""+current_prompt as (
            select trim(text, {WHITE}) as system from prompts order by version desc limit 1)
        select seq, md5(concat((select system from current_prompt),
               'Company: ', summary, chr(10), 'Ticker: ', url, chr(10), 'Article Title: ', title, chr(10),
               'Publication Date: ', case when publish_date = '' then 'Not specified' else publish_date end,
               chr(10), chr(10), 'News Content:', chr(10), substr(content, 1, 8000), chr(10))) as insight_md5,
               md5(concat('Content: ', content, chr(10), chr(10),
               'Please provide a summary and infer the publication date.', chr(10))) as summary_md5
        from articles
        union all select -1, md5(system), '' from current_prompt"""),
    "freshness_day": _freshness(24),
    "freshness_month": _freshness(720),
    "cached_urls": _with("snapshots crawls", f"""+{LATEST_SNAPSHOT}
        select ticker, unnest(url_keys) as url from newest
        where ticker in (select ticker from crawls) and not ({AS_OF} - time_created > interval 720 hours)"""),
    "usable": _with("articles", """
        select seq, coalesce(file_path, '') not in ('', 'pending') as usable_file,
               coalesce(content, '') not in ('', 'pending') as usable_content from articles"""),
    "pending": _with("articles requests", """
        select url from (select url, content, row_number() over (partition by url order by seq) as n from articles)
        where n = 1 and content = 'pending' and url in (select url from requests)"""),
    "status_classes": _with("status", """+texts as (
            select seq, status from status
            union all select seq + 1000000000, upper(status) from status
            union all select seq + 2000000000, concat('news ready Error', status) from status)
        select seq, case when contains(lower(status), 'news crops ready') then 'done'
                         when contains(lower(status), 'fail') or contains(lower(status), 'error') then 'failed'
                         else 'running' end as state from texts"""),
    "request_forms": _with("forms", """
        select seq, concat(user_id, '@', session_id, '@', upper(ticker), '@', suffix) as job_id,
               upper(ticker) as ticker
        from forms where user_id <> '' and session_id <> '' and ticker <> ''"""),
    "detail_json": _with("fragments", """
        select * replace (md5(quote_frag) as quote_frag) from fragments"""),
    "first_article": _with("articles requests", """
        select r.url, a.seq, a.title from (select distinct url from requests) r
        left join (select *, row_number() over (partition by url order by seq) as n from articles) a
               on a.url = r.url and a.n = 1"""),
    "latest_article": _with("articles requests", """
        select r.job_id, cast(r.pos as bigint) as pos, r.url, a.seq as article_seq, a.title, md5(a.content) as content_md5
        from requests r
        join (select *, row_number() over (partition by url order by create_time desc, seq) as n from articles) a
          on a.url = r.url and a.n = 1"""),
    "fragment_exists": _with("requests fragments", """
        select seq, job_id, cast(pos as bigint) as pos, url, ticker, exists (
            select 1 from fragments f where f.url = r.url and f.ticker = r.ticker) as found
        from requests r"""),
    "stored_pairs": _with("requests fragments", """
        select seq, job_id, cast(pos as bigint) as pos, url, ticker from requests r where exists (
            select 1 from fragments f where f.url = r.url and f.ticker = r.ticker)"""),
    "new_pairs": _with("requests fragments", """
        select seq, job_id, cast(pos as bigint) as pos, url, ticker from requests r where not exists (
            select 1 from fragments f where f.url = r.url and f.ticker = r.ticker)"""),
    "new_links": _with("word_articles", f"""+{PAGE_LINKS}
        select distinct href as url from page_links where href not in (select url from word_articles)"""),
    "attach_pages": _with("word_pages", f"""+{PAGE_LINKS}
        select l.url, p.path as file_path from (select distinct href as url from page_links) l
        left join (select url, arg_max(path, downloaded_at) as path from word_pages group by url) p
               on p.url = l.url"""),
    "latest_snapshot": _with("snapshots", f"+{LATEST_SNAPSHOT} select ticker, seq, org, time_created from newest"),
    "latest_article_rows": _with("articles", """
        select url, seq, title from (
            select *, row_number() over (partition by url order by create_time desc, seq) as n from articles)
        where n = 1"""),
    "first_article_rows": _with("articles", """
        select url, seq, title from (
            select *, row_number() over (partition by url order by seq) as n from articles) where n = 1"""),
    "job_status": _with("status crawls", f"""+{JOB_STATUS}
        select job_id, coalesce(status, 'nothing') as status
        from (select job_id from status union select job_id from crawls) left join job_states using (job_id)"""),
    "all_job_status": _with("status", f"+{JOB_STATUS} select job_id, status from job_states"),
    "job_history": _with("status", "select * from status order by job_id, time desc, seq"),
    "job_ids": _with("status", "select distinct job_id from status"),
    "urls": _with("articles", "select distinct url from articles"),
    "queue_depth": _with("status", """+asked as (
            select job_id, case when starts_with(status, 'news ready') then 'summary'
                                when status = 'sumaries ready' then 'crop' else 'crawl' end as stage
            from status),
        waiting as (
            select stage from asked a where not exists (
                select 1 from status s where s.job_id = a.job_id and (
                    (a.stage = 'crawl' and starts_with(s.status, 'news ready'))
                    or (a.stage = 'summary' and s.status = 'sumaries ready')
                    or (a.stage = 'crop' and s.status = 'news crops ready'))))
        select s.stage, count(w.stage) as n
        from (values ('crawl'), ('summary'), ('crop')) s(stage) left join waiting w on w.stage = s.stage
        group by s.stage"""),
    "stuck_jobs": _with("status", f"""+{JOB_STATUS}, submitted as (
            select job_id, min(time) as submitted_at from status group by job_id)
        select job_id, submitted_at, status from submitted join job_states using (job_id)
        where {STUCK_AT} - submitted_at > interval 100 seconds
          and not contains(lower(status), 'news crops ready')
          and not contains(lower(status), 'fail') and not contains(lower(status), 'error')"""),
    "pair_counters": _with("requests fragments", """
        select job_id, count(*) as total,
               count(*) filter (where concat(url, ' ', ticker) not in (select concat(url, ' ', ticker) from fragments)) as "new"
        from requests group by job_id"""),
    "saved_counters": _with("requests fragments", """
        select job_id, count(*) as total,
               count(*) filter (where concat(url, ' ', ticker) in (select concat(url, ' ', ticker) from fragments)) as saved
        from requests group by job_id"""),
    "snapshot_sizes": _with("snapshots", "select seq, ticker, cast(len(url_keys) as integer) as n_links from snapshots"),
    "shown_counters": _with("fragments", """
        select ticker, least(count(*), 10) as shown from fragments group by ticker"""),
    "reason_profile": _with("fragments", """
        select related_reason_simple, polarity, actual_trend, count(*) as n, count(distinct ticker) as n_tickers
        from fragments group by 1, 2, 3"""),
    "time_texts": """
        select event_id, t, strftime(t, '%Y-%m-%d %H:%M:%S') as formatted
        from (select event_id, case when event_type <> 'error' then date_trunc('second', ts) end as t from events)""",
    "reflow": f"""
        with cut as (
            select doc_id, split_part(case when doc_id % 3 = 0
                then concat(text, chr(10), ')Story continues', source, 'Story continues', chr(10))
                else text end, 'Story continues', 1) as whole from documents),
        flowed as (select doc_id, {_reflowed('whole')} as f from cut)
        select doc_id, cast(length(f) as integer) as n, md5(f) as flowed_md5 from flowed""",
    "summary_fields": _with("outputs", f"""
        select doc_id, md5({_first_line('summary', 'answer')}) as summary_md5,
               {_first_line('date', "''")} as publish_date from outputs"""),
    "insight_fields": _with("insights", f"""+objects as (
            select doc_id, try_cast(answer as json) as object from insights where json_valid(answer)),
        kept as (select * from objects where json_type(object) = 'OBJECT' and len(json_keys(object)) > 0
                 and coalesce(json_extract_string(object, '$.related_reason_simple'), '') <> 'no relation')
        select doc_id, {', '.join(_insight_field(key) for key in INSIGHT_KEYS)} from kept"""),
    "links": f"""with {PAGE_LINKS} select page_id, pos, href, title from page_links
        where contains(href, '/t') and title <> ''""",
    "links_capped": f"with {PAGE_LINKS}, {CAPPED} select page_id, pos, href, title from capped",
    "article_text": f"""with {PAGE_TEXT}
        select page_id, cast(length(content) as integer) as n, md5(content) as text_md5 from page_text""",
    "summarise_updates": _with("page_articles", f"""+{SUMMARISED}
        select url, md5(content) as content_md5, summary, publish_date from updates"""),
    "summarise_articles": _with("page_articles", f"""+{SUMMARISED}
        select a.seq, a.url, a.title, md5(coalesce(u.content, a.content)) as content_md5,
               coalesce(u.summary, a.summary) as summary, coalesce(u.publish_date, a.publish_date) as publish_date
        from page_articles a left join updates u on u.url = a.url"""),
    "summarise_status": f"""select page_id * {CHILD} + 1 as seq, concat('p', cast(page_id as varchar)) as job_id,
        'sumaries ready' as status, {RUN_AT} as time from pages""",
    "insights_fragments": _with("requests articles fragments", f"+{INSIGHT_ROWS} {INSIGHT_FRAGMENTS}"),
    "newest_insights": _with("requests articles fragments", f"""+{INSIGHT_ROWS},
        everything as (select * from fragments union all by name {INSIGHT_FRAGMENTS})
        {_cards(_ranked("everything"))}"""),
    "insights_status": f"""select doc_id * {CHILD} + 2 as seq, concat('r', cast(doc_id // 7 as varchar)) as job_id,
        'news crops ready' as status, {RUN_AT} as time from documents""",
    "ingest_articles": _with("snapshots crawls landed word_articles word_pages", f"""+{INGESTED},
        found as (select href as url, min(seq * {CHILD} + pos) as seq, arg_min(title, seq * {CHILD} + pos) as title
                  from renewed_links group by href),
        files as (select url, arg_max(path, downloaded_at) as path from word_pages group by url)
        select f.seq, f.url, f.title, coalesce(p.path, '') as file_path, {AS_OF} as create_time,
               'pending' as content, 'pending' as summary, '' as publish_date
        from found f left join files p on p.url = f.url
        where f.url not in (select url from word_articles)"""),
    "ingest_snapshots": _with("snapshots crawls landed", f"""+{INGESTED}
        select r.seq * {CHILD} as seq, r.ticker, cast(null as varchar) as org, {AS_OF} as time_created, k.pos, k.href as url
        from renewed r left join renewed_links k on k.ticker = r.ticker"""),
    "ingest_requests": _with("snapshots crawls landed", f"""+{INGESTED},
        news as (select r.ticker, cast(null as varchar) as org, k.pos, k.href as url
                 from renewed r left join renewed_links k on k.ticker = r.ticker
                 union all
                 select ticker, org, unnest(range(len(url_keys))) as pos, unnest(url_keys) as url
                 from looked where not expired)
        select c.seq, c.job_id, c.ticker, n.org, n.pos, n.url from crawls c join news n on n.ticker = c.ticker"""),
    "ingest_status": _with("snapshots crawls landed", f"""+{INGESTED}
        select c.seq * {CHILD} as seq, c.job_id, concat('news ready ', c.job_id) as status, {AS_OF} as time
        from crawls c where c.ticker in (select ticker from renewed)
                         or c.ticker in (select ticker from looked where not expired)"""),
    "read_cards": _with("status fragments", f"""+{JOB_STATUS}, asked as (
            select distinct {JOB} as job_id, source as ticker from events join documents on doc_id = event_id),
        shown as ({_cards(_ranked("fragments"))})
        select a.job_id, s.* from asked a join job_states j on j.job_id = a.job_id join shown s on s.ticker = a.ticker
        where j.status = 'news crops ready'"""),
    "stream_job_status": _with("status", f"+{JOB_STATUS} select job_id, status from job_states"),
}
ORACLE["stream_requests"] = """
    select distinct concat(user_id, '-', strftime(ts, '%Y-%m-%d')) as job_id,
        concat('T', event_id % 5) as ticker from events"""
ORACLE["rejected_messages"] = """
    select event_id, case when event_id % 3 = 0 then concat('{', event_type) else concat('{"data":"', event_type, '"}')
        end as value, case when event_id % 3 = 0 then 'not JSON' else 'no job_id' end as reason
    from events where event_id % 3 < 2"""
ORACLE["stream_unique_jobs"] = ORACLE["job_ids"]
ORACLE["stream_ingest"] = ORACLE["ingest_articles"]
ORACLE["stream_summaries"] = ORACLE["summarise_updates"]
ORACLE["stream_insights"] = ORACLE["insights_fragments"]
ORACLE["answer_ledger"] = _with("requests articles fragments", f"""+{INSIGHT_ROWS}, jobs as (
        select r.job_id, min(r.seq) as seq, count(*) as wanted, count(f.url) as stored,
            count(*) filter (f.url is null and n is null) as no_content, count(n) as questions,
            count(*) filter (n % 5 in (1, 3, 4)) as answered, count(*) filter (n % 5 = 0) as no_relation,
            count(*) filter (n % 5 = 2) as failed
        from requests r left join (select distinct url, ticker from fragments) f using (url, ticker)
        left join answered a on a.url = r.url and a.ticker = r.ticker group by r.job_id)
    select cast(run as integer) as run, * exclude (run, questions),
        case run when 1 then questions when 2 then 0 else failed end as asked,
        case run when 1 then 0 when 2 then questions else questions - failed end as reused
    from jobs, range(1, 4) runs(run)""")
ORACLE["annotate_failures"] = """
    select doc_id, source, case when doc_id % 7 > 0 then concat('System ', lang, ' ', doc_id) end as answer
    from documents"""
ORACLE["annotate_broken_batches"] = ORACLE["annotate_failures"]
ORACLE["stream_rejects"] = f"select value, reason, {AS_OF} as time from ({ORACLE['rejected_messages']})"
ORACLE["landed_pages"] = _with("landed", """+named as (
        select *, page_id % 11 <> 10 as usual, case when page_id % 2 = 0 then 'chart' else 'news' end as sort
        from landed)
    select case when usual then concat('/raw/', ticker, '/', ticker, case when sort = 'news' then '_news' else '' end,
            '_TM_', strftime(downloaded_at, '%Y-%m-%d_T_%H-%M-%S'), '.html')
            else concat('/raw/notes ', page_id) end as path,
        case when usual then ticker end as ticker, case when usual then sort end as kind,
        case when usual then downloaded_at end as downloaded_at, md5(concat(html, chr(10))) as html_md5
    from named""")
ORACLE["chart_organisations"] = """
    select doc_id as page_id, case when doc_id % 3 > 0 then concat('Org & ', lang) end as org from documents"""
ORACLE["chart_news"] = f"""
    with orgs as ({ORACLE['chart_organisations']}), words as (
        select doc_id as page_id, concat('{views.NEWS}', source, '/', doc_id) as word, source from documents)
    select page_id, org, pos, href, title from orgs join (
        select page_id, 0::bigint as pos, word as href, concat('Again ', source) as title from words
        union all select page_id, 1, concat(word, '/b'), 'Second' from words) using (page_id)"""
ORACLE["main_text"] = f"""
    with whole as (
        select doc_id as page_id, concat(source, ' says ', lang, ' ', doc_id, chr(10), 'A first paragraph', chr(10),
            'goes on', chr(10), 'short', chr(10),
            case when doc_id % 2 = 0 then '' else 'The last paragraph' end) as text from documents),
    flowed as (select page_id, {_reflowed('text')} as f from whole)
    select page_id, cast(length(f) as integer) as n, md5(f) as text_md5 from flowed"""
ORACLE["stream_stuck_jobs"] = ORACLE["stuck_jobs"]
ORACLE["stream_profile"] = ORACLE["reason_profile"]
ORACLE["stream_counters"] = f"""
    with jobs as ({ORACLE['answer_ledger']}), sums as (
        select (select count(*) from documents) as requests, sum(wanted) as wanted, sum(stored) as stored,
            sum(asked) as asked, sum(answered) as answered, sum(no_relation) as no_relation,
            sum(failed) as failed, (select count(*) from ({ORACLE['insights_fragments']})) as saved
        from jobs where run = 1)
    select name, value::bigint as value from (unpivot (select columns(*)::bigint from sums) on columns(*)
        into name name value value)"""
