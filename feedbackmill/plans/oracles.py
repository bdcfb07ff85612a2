"""DuckDB counterparts of the named queries, used to check their results."""

from feedbackmill.functions.text import CHART_STOP_WORDS
from feedbackmill.operators.terms import CLOUD_STOP_WORDS

REVIEWS = """
with reviews as (
  select d.doc_id as id, d.source as business_url,
    'user_' || cast(e.user_id as varchar) as user_name,
    least(floor(e.value / 10) / 2, 5.5) as rating,
    strftime(o.o_orderdate, '%Y-%m-%d') as date,
    d.text as review_text,
    case when l.toxic = 1 then 'Negative' when l.quality = 1 then 'Positive'
         when l.quality = 0 then 'Neutral' end as sentiment
  from documents d
  left join events e on e.event_id = d.doc_id
  left join orders o on o.o_orderkey = d.doc_id
  left join labels l on l.doc_id = d.doc_id
),
rated as (
  select *, coalesce(sentiment, 'Neutral') as label,
    case when floor(coalesce(rating, 0) + 0.5) = 0 then 1
         else cast(floor(coalesce(rating, 0) + 0.5) as bigint) end as bucket
  from reviews
),
businesses as (select distinct business_url from reviews),
labels3(sentiment) as (values ('Positive'), ('Negative'), ('Neutral')),
buckets(bucket) as (select * from range(1, 6))
"""

PY_SPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
JS_SPACE = (
    r"\x09-\x0d\x20\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
LETTERS = f"regexp_replace(lower(review_text), '[^a-z{JS_SPACE}]', '', 'g')"
TOKENS = f"string_split_regex({LETTERS}, '[{JS_SPACE}]+')"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


ASPECTS = """,
wanted(word) as (values ('the'), ('heit'), ('tion'), ('ment'), ('ado')),
hits as (
  select business_url, id as review_id,
    upper(word[1]) || substr(word, 2) as aspect, sentiment as sentiment_score
  from reviews join wanted on contains(lower(review_text), word)
),
aspects as (
  select * from hits
  union all
  select business_url, id, 'Overall Experience', sentiment from reviews
  where id not in (select review_id from hits)
)
"""

CLOUD = rf""",
spread as (
  select business_url, sentiment, id,
    unnest(regexp_extract_all(lower(review_text), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']+')) as raw,
    generate_subscripts(
      regexp_extract_all(lower(review_text), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']+'), 1) as nth
  from reviews where sentiment in ('Positive', 'Negative')
),
words as (
  select business_url, sentiment, id, nth, regexp_replace(raw, '''s$', '') as term from spread
  where not regexp_matches(regexp_replace(raw, '''s$', ''), '^\p{{N}}+$')
),
counts as (
  select business_url, sentiment, term, count(*) as n from words
  where term not in {_in(CLOUD_STOP_WORDS)} group by all
)
"""

# Dates of the relative wording; the forms match those the query makes from each row.
DATES = """
with wording as (
  select doc_id, source, list_extract([' A month ago', n || ' Weeks ago', n || ' years ago',
    'yesterday' || chr(10), n || ' hours ago', '  ', '2024/05/' || n, 'UNKNOWN',
    'an hour in a day', n || ' year ' || n || ' months ago', repeat(n, 12) || ' days ago'],
    cast(n_chars % 11 as int) + 1) as raw
  from (select *, cast(doc_id % 40 as varchar) as n from documents)
),
parts as (
  select doc_id, source, s, regexp_replace(s, '[^0-9]', '', 'g') as digits,
    case when contains(s, 'year') then 365 when contains(s, 'month') then 30
         when contains(s, 'week') then 7 when contains(s, 'day') then 1 end as unit
  from (select doc_id, source, trim(replace(lower(raw), chr(10), ' ')) as s from wording)
),
backs as (
  select doc_id, source, s, unit * case
    when contains(s, 'a ') or contains(s, 'an ') or digits = '' then 1
    else try_cast(digits as hugeint) end as back
  from parts
),
dates as (
  select doc_id, source, case
    when s in ('', 'unknown') then 'Unknown'
    when contains(s, '-') or contains(s, '/') then s
    else strftime(date '2025-01-31' - cast(
      case when back <= date '2025-01-31' - date '0001-01-01' then back else 0 end as int),
      '%Y-%m-%d') end as date
  from backs
)
"""

UPLOADS = f""",
uploads as (
  select doc_id, 'upload ' || (doc_id // 500) as business_url, 'd' || doc_id as user_name,
    doc_id % 6 + 0.5::double as rating, case when date <> 'Unknown' then date else strftime(
      date '2025-01-31' - cast(row_number() over (
        partition by doc_id // 500 order by doc_id) - 1 as int), '%Y-%m-%d') end as date,
    review_text, case length(review_text) % 3 when 0 then 'Positive' when 1 then 'Negative'
      else 'Neutral' end as sentiment
  from (
    select doc_id, dates.date as date,
      trim(regexp_replace(text, '[{PY_SPACE}]+', ' ', 'g')) as review_text
    from documents join dates using (doc_id))
)
"""

TFIDF = rf""",
tokens as (
  select business_url, id,
    unnest(regexp_extract_all(lower(review_text), '[\p{{L}}\p{{N}}_]{{2,}}')) as term
  from reviews where review_text <> ''
),
tf as (
  select business_url, id, term, count(*) as tf from tokens
  where term not in {_in(CLOUD_STOP_WORDS)} group by all
),
ranked as (
  select *, row_number() over (partition by business_url order by total desc, term) as rn from (
    select business_url, term, cast(sum(tf) as bigint) as total, count(*) as df
    from tf group by all)
),
sizes as (select business_url, count(*) as docs from reviews where review_text <> '' group by all),
vocab as (
  select business_url, term, total, df, ln((1 + docs) / (1 + df)) + 1 as idf
  from ranked join sizes using (business_url) where rn <= 1000
)
"""

ORACLES: dict[str, str] = {
    "sentiment_breakdown": REVIEWS + """
select b.business_url, l.sentiment, count(r.id) as n
from businesses b cross join labels3 l
left join rated r on r.business_url = b.business_url and r.label = l.sentiment
group by all
""",
    "rating_distribution": REVIEWS + """
select b.business_url, k.bucket, k.bucket || case when k.bucket = 1 then ' Star' else ' Stars' end
  as label, count(r.id) as n
from businesses b cross join buckets k
left join rated r on r.business_url = b.business_url and r.bucket = k.bucket
group by all
""",
    "avg_rating_by_sentiment": REVIEWS + """
select b.business_url, l.sentiment, coalesce(avg(coalesce(r.rating, 0))
  filter (r.id is not null), 0) as avg_rating
from businesses b cross join labels3 l
left join rated r on r.business_url = b.business_url and r.label = l.sentiment
group by all
""",
    "avg_length_by_rating": REVIEWS + """
select b.business_url, k.bucket,
  coalesce(cast(floor(avg(length(r.review_text)) + 0.5) as bigint), 0) as avg_length
from businesses b cross join buckets k
left join rated r on r.business_url = b.business_url and r.bucket = k.bucket
group by all
""",
    "sentiment_by_rating": REVIEWS + """
select b.business_url, l.sentiment, k.bucket, count(r.id) as n
from businesses b cross join labels3 l cross join buckets k
left join rated r
  on r.business_url = b.business_url and r.label = l.sentiment and r.bucket = k.bucket
group by all
""",
    "monthly_volume_rating": REVIEWS + """
select business_url, substr(date, 1, 7) as period, count(*) as n,
  avg(coalesce(rating, 0)) as avg_rating
from reviews where date is not null group by all
""",
    "dataset_counts": REVIEWS + """
select business_url, count(*) as n, count(*) filter (sentiment = 'Positive') as pos,
  count(*) filter (sentiment = 'Negative') as neg
from reviews group by all
""",
    "overall_average": REVIEWS + """
select business_url, avg(rating) as avg_rating from reviews group by all
""",
    "top_words": REVIEWS + f""",
tokens as (
  select business_url, id, unnest({TOKENS}) as word, generate_subscripts({TOKENS}, 1) as nth
  from reviews
),
counts as (
  select business_url, word, count(*) as n, min((id, nth)) as seen from tokens
  where length(word) > 3 and word not in {_in(CHART_STOP_WORDS)} group by all
)
select * from (
  select business_url, word, n, cast(row_number() over (
    partition by business_url order by n desc, seen) as int) as rank from counts)
where rank <= 5
""",
    "term_frequencies": REVIEWS + CLOUD + """
select * from (
  select *, cast(row_number() over (
    partition by business_url, sentiment order by n desc, term) as int) as rank from counts)
where rank <= 100
""",
    "cloud_terms": REVIEWS + CLOUD + f""",
forms as (
  select c.*, coalesce(s.term, c.term) as standard
  from counts c left join counts s
    on s.business_url = c.business_url and s.sentiment = c.sentiment
    and c.term = s.term || 's' and not ends_with(c.term, 'ss')
),
uni as (
  select business_url, sentiment, standard as term, cast(sum(n) as bigint) as n
  from forms group by all
),
listed as (
  select *, lead(term) over (partition by id order by nth) as following from words
),
raw_pairs as (
  select business_url, sentiment, term || ' ' || following as pair, count(*) as n from listed
  where following is not null and term not in {_in(CLOUD_STOP_WORDS)}
    and following not in {_in(CLOUD_STOP_WORDS)}
  group by all
),
pairs as (
  select p.business_url, p.sentiment, coalesce(s.pair, p.pair) as pair,
    cast(sum(p.n) as bigint) as n
  from raw_pairs p left join raw_pairs s
    on s.business_url = p.business_url and s.sentiment = p.sentiment
    and p.pair = s.pair || 's' and not ends_with(p.pair, 'ss')
  group by all
),
known as (
  select f.business_url || '/' || f.sentiment || '/' || f.term as k, f.standard, u.n
  from forms f join uni u
    on f.business_url || '/' || f.sentiment || '/' || f.standard
     = u.business_url || '/' || u.sentiment || '/' || u.term
),
halves as (
  select *, business_url || '/' || sentiment || '/' || split_part(pair, ' ', 1) as k1,
    business_url || '/' || sentiment || '/' || split_part(pair, ' ', 2) as k2
  from pairs
),
joined as (
  select h.*, a.standard as w1, b.standard as w2, a.n as n1, b.n as n2, t.total
  from halves h join known a on a.k = h.k1 join known b on b.k = h.k2
  join (select business_url, sentiment, sum(n) as total from uni group by all) t
    on t.business_url = h.business_url and t.sentiment = h.sentiment
),
probs as (
  select *, greatest(least(n2 / total, 1 - 1e-10), 1e-10) as p,
    greatest(least(n / n1, 1 - 1e-10), 1e-10) as p1,
    greatest(least((n2 - n) / greatest(total - n1, 1), 1 - 1e-10), 1e-10) as p2
  from joined
),
kept as (
  select * from probs where -2 * (
      ln(p) * n + ln(1 - p) * (n1 - n) + ln(p) * (n2 - n) + ln(1 - p) * (total - n1 - (n2 - n))
    - ln(p1) * n - ln(1 - p1) * (n1 - n)
    - ln(p2) * (n2 - n) - ln(1 - p2) * (total - n1 - (n2 - n))) > 30
),
changed as (
  select * from uni
  union all select business_url, sentiment, pair, n from kept
  union all select business_url, sentiment, w1, -n from kept
  union all select business_url, sentiment, w2, -n from kept
),
final as (
  select business_url, sentiment, term, cast(sum(n) as bigint) as n from changed
  group by all having sum(n) > 0
)
select * from (
  select *, cast(row_number() over (
    partition by business_url, sentiment order by n desc, term) as int) as rank from final)
where rank <= 100
""",
    "aspect_mentions": REVIEWS + ASPECTS + "select * from aspects",
    "aspect_sentiment": REVIEWS + ASPECTS + """
select business_url, aspect, count(*) filter (sentiment_score = 'Positive') as positive,
  count(*) filter (sentiment_score = 'Negative') as negative,
  count(*) filter (sentiment_score = 'Neutral') as neutral
from aspects group by all
""",
    "overall_experience": REVIEWS + ASPECTS + """
select * from aspects where aspect = 'Overall Experience'
""",
    "aspects_of_dataset": REVIEWS + ASPECTS + """
select * from aspects where review_id in (select id from reviews where business_url = 'src7')
""",
    "sentiment_samples": REVIEWS + """
select business_url, sentiment, id, md5(review_text) as review_text, cast(rank as int) as rank
from (select *, row_number() over (partition by business_url, sentiment order by id) as rank
      from reviews where sentiment in ('Positive', 'Negative'))
where rank <= 5
""",
    "insight_context": REVIEWS + """,
ranked as (
  select *, row_number() over (partition by business_url, sentiment order by id) as rank
  from reviews
)
select business_url, count(*) as n, count(*) filter (sentiment = 'Positive') as pos,
  count(*) filter (sentiment = 'Negative') as neg,
  md5(coalesce(string_agg(review_text, '|' order by id)
    filter (sentiment = 'Positive' and rank <= 5), '')) as pos_samples,
  md5(coalesce(string_agg(review_text, '|' order by id)
    filter (sentiment = 'Negative' and rank <= 5), '')) as neg_samples
from ranked group by business_url
""",
    "clean_text_digest": f"""
select doc_id as id, md5(trim(regexp_replace(text, '[{PY_SPACE}]+', ' ', 'g'))) as digest
from documents
""",
    "chart_token_digest": REVIEWS + f"""
select id, md5(array_to_string(list_filter({TOKENS}, lambda w: w <> ''), ' ')) as digest
from reviews
""",
    "text_length": "select doc_id as id, length(text) as length from documents",
    "rating_buckets": REVIEWS + "select id, rating, bucket from rated",
    "parsed_ratings": """
select event_id, case event_type when 'view' then value when 'signup' then user_id / 10
  when 'purchase' then -cast(user_id as double) else 0.0 end as rating
from events
""",
    "default_names": """
select event_id, case when event_type in ('error', 'view') then 'Unknown'
  else 'user_' || user_id end as name
from events
""",
    "relative_dates": DATES + "select doc_id, date from dates",
    "synthetic_dates": DATES + """
select doc_id as id, case when date <> 'Unknown' then date else strftime(
  date '2025-01-31' - cast(row_number() over (partition by source order by doc_id) - 1 as int),
  '%Y-%m-%d') end as date
from dates
""",
    "title_labels": """
select doc_id, upper(lang[1]) || substr(lang, 2) || ', ' || upper(source[1]) || substr(source, 2)
  || ', Pizza Crust' as label
from documents
""",
    "row_index": REVIEWS + """
select id, business_url, row_number() over (partition by business_url order by id) - 1 as pos
from reviews
""",
    "capped_rows": REVIEWS + """
select * from (
  select id, business_url, row_number() over (partition by business_url order by id) - 1 as pos
  from reviews) where pos < 30
""",
    "capped_csv": """
select 'upload ' || (doc_id // 500) as business_url, doc_id % 500 as pos, 'd' || doc_id as user_name
from documents where doc_id % 500 < 30
""",
    "replaced_derived": REVIEWS + ASPECTS + """
select * from aspects where business_url not in ('src3', 'src4')
  or business_url = 'src3' and review_id % 2 = 0
""",
    "stored_dataset": REVIEWS + """
select id, business_url, user_name, rating, date, md5(review_text) as review_text, sentiment
from reviews where business_url = 'src7'
""",
    "appended_reviews": REVIEWS + """
select id, business_url, user_name, rating, date, md5(review_text) as review_text, sentiment
from reviews
""",
    "stored_status": """
with asked as (
  select distinct case when doc_id % 10 = 0 then 'nowhere' else source end as business_url
  from documents)
select business_url, case when business_url = 'nowhere' then 'not_found'
  when length(business_url) = 4 then 'completed' else 'pending' end as status
from asked
""",
    "advanced_bundle_clusters": REVIEWS + """
select business_url, id as review_id, cast(id % 3 as int) as cluster_id, 'Label' as cluster_label
from reviews where business_url = 'src7'
""",
    "reviews_of_dataset": REVIEWS + """
select id, business_url, user_name, rating, date, md5(review_text) as review_text, sentiment
from reviews where business_url = 'src7'
""",
    "label_join": """
select d.doc_id as id, d.source as business_url, case when l.toxic = 1 then 'Negative'
  when l.quality = 1 then 'Positive' else 'Neutral' end as sentiment
from documents d left join labels l using (doc_id)
""",
    "valid_labels": """
select event_id, case event_type when 'error' then 'Negative' when 'purchase' then 'Positive'
  else 'Neutral' end as sentiment
from events
""",
    "dataset_status": """
select 'user_' || c_custkey as business_url, coalesce(case arg_max(event_type, ts)
  when 'purchase' then 'completed' when 'error' then 'failed' else 'pending' end, 'not_found')
  as status
from customer join events on user_id = c_custkey group by all
union all
select 'user_' || c_custkey, 'not_found' from customer
where c_custkey not in (select user_id from events)
""",
    "duplicate_keys": """
select 'user_' || user_id as business_url, count(*) as n from events
group by all having count(*) > 1
""",
    "page_links": """
select page_id, url as business_url, cast(nth - 1 as int) as item_pos,
  case when trim(name) = '' then 'Unknown' else trim(name) end as user_name, 0.0::double as rating,
  'Unknown' as date, trim(text) as review_text
from (
  select page_id, url, generate_subscripts(items, 1) as nth,
    replace(regexp_extract(unnest(items), 'href="([^"]*)"', 1), '&amp;', '&') as name,
    replace(regexp_extract(unnest(items), '>([^<]*)</a>', 1), '&amp;', '&') as text
  from (select *, regexp_extract_all(html, '<li>.*?</li>') as items from pages))
""",
    "page_items_capped": """
select page_id, url as business_url, cast(nth - 1 as int) as item_pos, 'Unknown' as user_name,
  0.0::double as rating, 'Unknown' as date, trim(text) as review_text
from (
  select page_id, url, generate_subscripts(items, 1) as nth,
    replace(regexp_extract(unnest(items), '>([^<]*)</a>', 1), '&amp;', '&') as text
  from (select *, regexp_extract_all(html, '<li>.*?</li>') as items from pages))
where nth <= 3
""",
    "page_ads": """
select page_id, url as business_url, 0::int as item_pos, 'Unknown' as user_name,
  0.0::double as rating, 'Unknown' as date,
  trim(replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '&amp;', '&'))
  as review_text
from pages
""",
    "source_precedence": REVIEWS + """,
structured as (
  select business_url, id from reviews where sentiment = 'Negative' and length(review_text) > 4000
)
select business_url, id, 'structured' as origin from structured
union all
select business_url, id, 'page' from reviews
where business_url not in (select business_url from structured)
""",
    "structured_records": REVIEWS + """
select id, 0::int as item_pos, user_name, rating, date, md5(review_text) as review_text
from reviews where rating <> 0
""",
    "parsed_replies": """
select event_id, case event_type when 'error' then 'Neutral,Neutral'
  when 'view' then 'Neutral,Neutral' when 'click' then 'Negative,Neutral'
  else 'Positive,Neutral' end as labels
from events
""",
    "parsed_plans": """
select event_id, case when event_type = 'error' then '' else 'select ' || user_id end as sql,
  event_type <> 'error' as needs_graph, 'none' as chart_type
from events
""",
    "review_records": REVIEWS + """
select id, '{"id":' || id || ',"business_url":"' || business_url || '","sentiment":'
  || coalesce('"' || sentiment || '"', 'null') || '}' as record
from reviews
""",
    "scored_sentiment": """
select doc_id as id, case length(text) % 3 when 0 then 'Positive' when 1 then 'Negative'
  else 'Neutral' end as sentiment
from documents
""",
    "lexicon_sentiment": REVIEWS + f"""
select id, case when score > 0 then 'Positive' when score < 0 then 'Negative' else 'Neutral' end
  as sentiment
from (
  select id, len(list_filter({TOKENS}, lambda w: w in ('that', 'with', 'est')))
    - len(list_filter({TOKENS}, lambda w: w in ('this', 'from', 'une'))) as score
  from reviews)
""",
    "tfidf_terms": REVIEWS + TFIDF + """
select business_url, term, total, df, round(idf, 8) as idf from vocab
""",
    "tfidf_weights": REVIEWS + TFIDF + """,
raw as (
  select business_url, id, term, tf * idf as w from tf join vocab using (business_url, term)
)
select business_url, id, term,
  round(w / sqrt(sum(w * w) over (partition by business_url, id)), 8) as weight
from raw
""",
    "month_periods": """
select o_orderkey, case when o_custkey % 7 < 4 then strftime(o_orderdate, '%Y-%m')
  else 'Unknown' end as period
from orders
""",
    "dataset_key": """
select '/in/' || source || '.csv' as file_path, coalesce(
  arg_max(lang || ' shop ' || doc_id, doc_id) filter (n_chars > 9000), source || '.csv')
  as business_url
from documents group by source
""",
    "uploaded_csv": DATES + """
select 'upload ' || (doc_id // 500) as business_url,
  row_number() over (partition by doc_id // 500 order by doc_id) - 1 as pos,
  'd' || doc_id as user_name, doc_id % 6 + 0.5::double as rating,
  case when raw = '' then 'Unknown' else raw end as date, md5(text) as review_text
from documents join wording using (doc_id)
""",
    "ingested_csv": DATES + UPLOADS + """
select business_url, user_name, rating, date, md5(review_text) as review_text, sentiment
from uploads
""",
    "ingested_aspects": DATES + UPLOADS + """,
wanted(word) as (values ('the'), ('heit'), ('tion'), ('ment'), ('ado')),
hits as (
  select doc_id, business_url, upper(word[1]) || substr(word, 2) as aspect, sentiment
  from uploads join wanted on contains(lower(review_text), word)
),
found as (
  select business_url, aspect, sentiment from hits
  union all
  select business_url, 'Overall Experience', sentiment from uploads
  where doc_id not in (select doc_id from hits) and review_text <> ''
)
select business_url, aspect, count(*) filter (sentiment = 'Positive') as positive,
  count(*) filter (sentiment = 'Negative') as negative,
  count(*) filter (sentiment = 'Neutral') as neutral
from found group by all
""",
    "ingested_pages": f"""
with items as (
  select page_id, url, generate_subscripts(items, 1) as nth,
    replace(regexp_extract(unnest(items), 'href="([^"]*)"', 1), '&amp;', '&') as name,
    replace(regexp_extract(unnest(items), '>([^<]*)</a>', 1), '&amp;', '&') as text
  from (select *, regexp_extract_all(html, '<li>.*?</li>') as items from pages)
),
placed as (
  select *, row_number() over (partition by url order by page_id, nth) - 1 as pos,
    trim(regexp_replace(text, '[{PY_SPACE}]+', ' ', 'g')) as review_text
  from items
)
select url as business_url, trim(name) as user_name, 0.0::double as rating,
  strftime(date '2025-01-31' - cast(pos as int), '%Y-%m-%d') as date,
  md5(review_text) as review_text, case length(review_text) % 3 when 0 then 'Positive'
    when 1 then 'Negative' else 'Neutral' end as sentiment
from placed
""",
    "replaced_reviews": REVIEWS + """
select id, business_url, user_name, rating, date, md5(review_text) as review_text, sentiment
from reviews where business_url <> 'src3' or sentiment = 'Negative'
""",
    "exported_csv": REVIEWS + """
select '"' || id || '","' || business_url || '","'
  || regexp_replace(cast(rating as varchar), '[.]0$', '') || '","'
  || coalesce(sentiment, 'null') || '"' as value
from reviews
""",
    "adhoc_sql": REVIEWS + """
select sentiment, count(*) as n, avg(rating) as avg_rating from reviews group by sentiment
""",
    "scoped_sql": REVIEWS + ASPECTS + """
select a.aspect, r.sentiment, count(*) as n
from reviews r join aspects a on a.review_id = r.id and r.business_url = 'src7' group by all
""",
    "chart_axes": REVIEWS + """
select substr(date, 1, 4) as x, count(*) as y from reviews where business_url = 'src7' group by 1
""",
}

# Bundles give the rows of the operators they gather, cut to one business.
ORACLES["advanced_bundle_aspects"] = (
    f"select * from ({ORACLES['aspect_sentiment']}) where business_url = 'src7'"
)
ORACLES["dashboard_bundle_buckets"] = ORACLES["avg_length_by_rating"]

_UPLOADED = DATES + UPLOADS + ", reviews as (select doc_id as id, * from uploads)"
ORACLES["ingested_terms"] = ORACLES["cloud_terms"].replace(REVIEWS, _UPLOADED)
_SHAPE = """
select business_url, count(*) as reviews, true as ids_fit, true as one_label_each
from reviews where review_text <> '' group by business_url
"""
ORACLES["ingested_cluster_rules"] = _UPLOADED + _SHAPE
ORACLES["ingested_bundle_clusters"] = f"select * from ({_UPLOADED + _SHAPE}) where business_url = 'upload 0'"
ORACLES["cluster_rules"] = REVIEWS + _SHAPE.replace("from reviews", ", true as settled from reviews")

_WEIGHTS = TFIDF + """,
x as (
  select business_url, id, term, w / sqrt(sum(w * w) over (partition by business_url, id)) as w
  from (select business_url, id, term, tf * idf as w from tf join vocab using (business_url, term))
),
lengths as (
  select r.business_url, r.id, coalesce(sum(x.w * x.w), 0) as square
  from reviews r left join x using (business_url, id) where r.review_text <> '' group by all
),
given(cluster) as (values (0), (1), (2)),
near0 as (select business_url, id, cast(id % 3 as int) as cluster from lengths)
"""


def _step(n: int) -> str:
    """Centres from the clusters before, and the nearest of them of each review."""
    return f""",
sizes{n} as (select business_url, cluster, count(*) as n from near{n - 1} group by all),
centres{n} as (
  select business_url, cluster, term, sum(w) / any_value(n) as w
  from x join near{n - 1} using (business_url, id) join sizes{n} using (business_url, cluster) group by all
),
norms{n} as (select business_url, cluster, sum(w * w) as square from centres{n} group by all),
dots{n} as (
  select business_url, x.id, c.cluster, sum(x.w * c.w) as dot
  from x join centres{n} c using (business_url, term) group by all
),
near{n} as (
  select business_url, id, cluster, square from (
    select l.business_url, l.id, g.cluster,
      l.square + coalesce(c.square, 0) - 2 * coalesce(d.dot, 0) as square,
      row_number() over (partition by l.business_url, l.id
        order by l.square + coalesce(c.square, 0) - 2 * coalesce(d.dot, 0), g.cluster) as nth
    from lengths l cross join given g
    left join norms{n} c on c.business_url = l.business_url and c.cluster = g.cluster
    left join dots{n} d on d.business_url = l.business_url and d.id = l.id and d.cluster = g.cluster)
  where nth = 1
)
"""


ORACLES["kmeans_steps"] = REVIEWS + _WEIGHTS + _step(1) + _step(2) + _step(3) + """
select business_url, id as review_id, cluster as cluster_id, round(greatest(square, 0), 6) as square from near3
"""
ORACLES["centroid_terms"] = REVIEWS + _WEIGHTS + _step(1) + """
select business_url, cluster as cluster_id, string_agg(upper(term[1]) || substr(term, 2), ', ' order by nth) as cluster_label
from (
  select *, row_number() over (partition by business_url, cluster order by round(w, 12) desc, term) as nth from centres1)
where nth <= 3 group by all
"""
ORACLES["streamed_drop_folder"] = DATES + UPLOADS.replace(
    "from documents join dates using (doc_id)",
    "from documents join dates using (doc_id) where doc_id // 500 % 3 <> 0 or doc_id % 3 = 0",
) + """
select business_url, user_name, rating, date, md5(review_text) as review_text, sentiment from uploads
"""
ORACLES["vacuumed_store"] = REVIEWS + """
select id, business_url, user_name, rating, date, md5(review_text) as review_text, sentiment from reviews
where business_url not in ('src3', 'src4') or (business_url = 'src3' and sentiment = 'Negative')
  or (business_url = 'src4' and sentiment = 'Positive')
"""
ORACLES["page_items_sql"] = """
select page_id, cast(nth - 1 as int) as item_pos,
  replace(regexp_extract(item, 'href="([^"]*)"', 1), '&amp;', '&') as target,
  trim(replace(regexp_extract(item, '>([^<]*)</a>', 1), '&amp;', '&')) as label
from (
  select page_id, generate_subscripts(items, 1) as nth, unnest(items) as item
  from (select page_id, regexp_extract_all(html, '<li>.*?</li>') as items from pages))
"""
_CHANGED = REVIEWS.replace(
    "left join labels l on l.doc_id = d.doc_id\n)", "left join labels l on l.doc_id = d.doc_id\n  where d.source <> 'src3' or l.toxic = 1\n)"
)
ORACLES["kept_sentiment_by_rating"] = ORACLES["sentiment_by_rating"].replace(REVIEWS, _CHANGED)
ORACLES["kept_months"] = ORACLES["monthly_volume_rating"].replace(REVIEWS, _CHANGED)
