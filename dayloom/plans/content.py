"""Prompt, tag, bookmark, page, post, transaction and table-change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.functions import arrays, numbers, text
from dayloom.operators import analytics as A
from dayloom.operators import dml, validate
from dayloom.sources import tables as T
from dayloom.sources.tables import with_views

_NAMES = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), "|")


def prompt_tag_embed(spark, d):
    p = A.nested_tags(T.prompts(spark, d), T.prompt_tags(spark, d), T.tags(spark, d))
    return p.select("id", F.size("tags").cast("int").alias("n_tags"), _NAMES("tags").alias("tags"))


def tag_search(spark, d):
    p = A.nested_tags(T.prompts(spark, d), T.prompt_tags(spark, d), T.tags(spark, d))
    return p.filter(arrays.any_contains(F.transform("tags", lambda x: x["name"]), "BRAND#1")).select("id", "prompt_text")


def recent_prompts(spark, d):
    p = T.prompts(spark, d).orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()).limit(3)
    return p.select("id", "prompt_text", F.date_format("created_at", T.DAY).alias("day"))


def tag_get_or_create(spark, d):
    tags = T.tags(spark, d).withColumn("user_id", F.lit(1).cast("long"))
    old = tags.groupBy("name", "user_id").agg(F.min("id").alias("id")).filter("id % 2 = 0")
    asked = tags.select("name", "user_id").filter("name like 'Brand#1%' or name like 'Brand#2%'")
    return dml.get_or_create(old, asked).select("id", "name", "user_id")


def prompt_templates(spark, d):
    tags = T.tags(spark, d).select("id", "name", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).when(F.col("id") % 3 == 1, F.lit("")).otherwise(F.col("name")).alias("seed"))
    number = text.numeric_seed(F.col("seed"))
    clause = F.when(number.isNotNull(), F.concat(F.lit("Use the number "), F.col("seed"), F.lit("."))).when(F.col("seed") != "", F.concat(F.lit("Write about "), F.col("seed"), F.lit("."))).otherwise("")
    filled = text.initials_filled(("Topic: ", F.col("name")), ("Seed: ", F.col("seed")))
    return tags.select("id", filled.alias("prompt"), clause.alias("clause"), text.leading_int(F.concat(F.col("seed"), F.lit("abc"))).alias("number"))


def quarter_slots(spark, d):
    return T.quarters(spark)


def style_picks(spark, d):
    styles = F.array(*map(F.lit, ("plain", "formal", "playful")))
    return T.prompts(spark, d).select("id", arrays.random_pick(styles, F.lit("style"), F.col("id")).alias("style"))


def bookmark_enrich(spark, d):
    b = T.bookmarks(spark, d)
    authors = T.table(spark, d, "customer", "c_custkey", "c_name").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    media = T.table(spark, d, "part", "p_partkey").select(F.col("p_partkey").cast("string").alias("media_key"), F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("m/"), F.col("p_partkey").cast("string"))).alias("url"), F.concat(F.lit("preview/"), F.col("p_partkey").cast("string")).alias("preview_image_url"))
    e = A.enriched_bookmarks(b, authors, media)
    return e.select("id", "author_name", "media_url", F.array_join("urls", " ").alias("urls"), F.array_join("hashtags", " ").alias("hashtags"), "context_domain")


def top_hashtag(spark, d):
    tags = T.bookmarks(spark, d).select(F.explode("entities.hashtags.text").alias("hashtag"))
    return A.arg_max(tags.groupBy("hashtag").agg(F.count("*").alias("n")), "hashtag")


def hashtag_counts(spark, d):
    tags = T.bookmarks(spark, d).select(F.explode("entities.hashtags.text").alias("hashtag"))
    return tags.groupBy("hashtag").agg(F.count("*").alias("n"))


def domain_counts(spark, d):
    b = T.bookmarks(spark, d).select(F.get("context_annotations", F.lit(0))["domain"]["name"].alias("domain"))
    return b.filter("domain is not null").groupBy("domain").agg(F.count("*").alias("n"))


def month_counts(spark, d):
    return T.bookmarks(spark, d).groupBy(F.date_format("created_at", "MMMM yyyy").alias("month")).agg(F.count("*").alias("n"))


def bookmark_total(spark, d):
    return T.bookmarks(spark, d).agg(F.count("*").alias("n"))


def page_title(spark, d):
    p = T.table(spark, d, "pages", "page_id", "html")
    return p.select("page_id", text.page_title(F.col("html")).alias("title"), text.page_description(F.col("html")).alias("description"))


def page_text(spark, d):
    p = T.table(spark, d, "pages", "page_id", "html").select("page_id", text.page_text(F.col("html")).alias("body"))
    return p.select("page_id", "body", text.preview(F.col("body")).alias("preview"))


def page_host(spark, d):
    p = T.table(spark, d, "pages", "page_id", "url")
    return p.select("page_id", text.hostname(F.col("url")).alias("host"), text.is_web_url(F.col("url")).alias("is_web"), text.with_scheme(F.regexp_replace("url", "^https?://", "")).alias("with_scheme"))


def first_link(spark, d):
    p = T.table(spark, d, "pages", "page_id", "url")
    content = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("see "), "url", F.lit(" now")))
    return p.select("page_id", text.first_link(content, F.concat(F.lit("title www.example.com/"), F.col("page_id").cast("string"))).alias("link"))


def text_segments(spark, d):
    p = T.table(spark, d, "pages", "page_id", "url").withColumn("t", F.concat(F.lit("read "), "url", F.lit(" and "), "url"))
    s = p.select("page_id", F.posexplode(text.segments(F.col("t"))).alias("pos", "x"))
    return s.select("page_id", "pos", "x.kind", "x.value")


def slugify(spark, d):
    return T.posts(spark, d).select("id", text.slug(F.col("title")).alias("slug"))


def unique_slug(spark, d):
    p = T.posts(spark, d).select("id", F.concat(F.when(F.col("id") % 41 != 0, F.lit("")), F.array_join(F.slice("tags", 1, 1), ""), F.when(F.col("id") % 50 == 0, F.concat(F.lit("-"), F.pmod("id", F.lit(7)).cast("string"))).otherwise("")).alias("base"))
    return A.unique_slugs(p).select("id", "slug")


def string_forms(spark, d):
    n = T.table(spark, d, "part", "p_partkey", "p_type", "p_brand")
    t = F.col("p_type")
    return n.select(
        F.col("p_partkey").alias("id"), text.kebab(t).alias("kebab"), text.title_case(text.kebab(t)).alias("title"), text.first_underscore(F.regexp_replace(t, " ", "_")).alias("words"),
        text.initial(t).alias("initial"), text.two_digits(F.col("p_partkey") % 60).alias("two"), F.length(t).cast("int").alias("len"),
        text.sha256_url(t).alias("sha"), F.base64(t.cast("binary")).alias("b64"), F.contains(t, F.lit("STEEL")).alias("steel"), F.startswith(t, F.lit("STANDARD")).alias("standard"),
    )


def post_defaults(spark, d):
    p = T.posts(spark, d)
    blank = F.when(F.col("id") % 5 == 0, F.lit("")).when(F.col("id") % 7 != 0, F.col("excerpt"))
    return p.select("id", text.or_default(blank, "No excerpt available").alias("excerpt"), F.length("excerpt").cast("int").alias("n"), arrays.first_or(F.col("tags"), "Uncategorized").alias("tag"))


def post_rejects(spark, d):
    """Posts without one of the eight fields that they must have, and what they lack; those that pass are counted as such."""
    p = T.posts(spark, d).withColumn("slug", text.slug(F.col("title")))
    i = F.col("id")
    p = p.withColumns({
        "meta_description": F.when(i % 6 != 0, F.lit("m")), "published_at": F.when(i % 10 != 0, F.lit("2024-01-01")), "author_id": F.when(i % 14 == 0, F.lit("  ")).otherwise(F.lit("u")),
        "tags": F.when(i % 15 == 0, F.array().cast("array<string>")).when(i % 21 != 0, F.col("tags")), "featured_image": F.when(i % 22 == 0, F.lit("")).otherwise(F.lit("f")), "excerpt": F.lit("e"), "title": F.when(i % 26 != 0, F.lit("t")), "slug": F.lit("s"),
    })
    good, bad = validate.split_valid(p, validate.post_rules())
    return bad.select("id", F.array_join("violations", "; ").alias("violations")).unionByName(good.select("id", F.lit("").alias("violations")))


def signed_transactions(spark, d):
    t = T.transactions(spark, d)
    return t.select("id", "user_id", numbers.signed_amount(F.col("type"), F.col("amount")).alias("amount"), F.concat(F.when(F.col("type") == "credit", "+").otherwise("-"), F.lit("$"), F.format_string("%.2f", "amount")).alias("shown"))


def owner_balance(spark, d):
    t = T.transactions(spark, d)
    return t.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("type") == "credit", F.round(F.col("amount") * 100).cast("long")).otherwise(-F.round(F.col("amount") * 100).cast("long"))).alias("cents"))


def user_or_first(spark, d):
    c = T.table(spark, d, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return A.find_or_first(c, F.col("id") == 5).unionByName(A.find_or_first(c, F.col("id") == -1))


def _people(spark, d):
    return T.table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def upsert_rows(spark, d):
    p = _people(spark, d)
    rows = p.filter("id % 10 = 0").select("id", F.concat("name", F.lit("*")).alias("name"), "balance").unionByName(p.filter("id % 10 = 1").select((F.col("id") + 1000000).alias("id"), "name", "balance"))
    return dml.upsert(p, rows)


def update_rows(spark, d):
    p = _people(spark, d)
    rows = p.filter("id % 4 = 0").select("id", F.lower("name").alias("name"), (-F.col("balance")).alias("balance"))
    return dml.update_strict(p, rows)


def delete_rows(spark, d):
    p = _people(spark, d)
    return dml.delete(p, p.filter("id % 3 = 0"))


def insert_rows(spark, d):
    p = _people(spark, d)
    again = p.filter("id % 9 = 0").withColumn("balance", F.col("balance") + 1)  # a second new row of an id
    return dml.insert_absent(p.filter("id % 2 = 0"), p.filter("id % 3 = 0").unionByName(again), order="balance")


def insert_plain(spark, d):
    p = _people(spark, d)
    return dml.insert(p.filter("id % 2 = 0"), p.filter("id % 3 = 0"))


def delete_owned(spark, d):
    """Rows listed with another owner's id stay."""
    p = T.prompts(spark, d).select("id", "user_id")
    listed = p.filter("id % 3 = 0").select("id", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).otherwise(-1).alias("user_id"))
    return dml.delete(p, listed, on=("id", "user_id"))


def autosave_rows(spark, d):
    """Drafts saved once, half of them again with a newer text, in batches that come in the wrong order."""
    from dayloom.streaming import cdc

    first = _people(spark, d).withColumn("seq", F.lit(2).cast("long"))
    again = first.filter("id % 2 = 0").withColumns({"seq": F.lit(4).cast("long"), "name": F.concat("name", F.lit(" saved"))})
    made = lambda x: x.withColumn("op", F.lit("INSERT")).unionByName(x.withColumns({"op": F.lit("UPDATE"), "seq": F.col("seq") + 1}))
    return cdc.fold(cdc.apply(cdc.compact(made(again)), made(first))).drop("seq")


def toggle_done(spark, d):
    r = T.reminders(spark, d)
    return dml.toggle_done(r, r.filter("id % 4 = 0").select("id")).select("id", "is_done", "is_open")


_B = lambda sql: with_views(sql, "lines", "bookmarks")
_P = "WITH p AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer) "
_EMBED = """, n AS (SELECT prompt_id, list(name ORDER BY name, tag_id) AS names FROM prompt_tags JOIN tags ON tags.id = tag_id GROUP BY 1)"""
_LINK = r"(?:https?://|www\.)[^\s<>\"'']+"

QUERIES = {
    "prompt_tag_embed": (prompt_tag_embed, with_views(_EMBED + " SELECT id, coalesce(len(names), 0)::INTEGER AS n_tags, coalesce(array_to_string(names, '|'), '') AS tags FROM prompts LEFT JOIN n ON prompt_id = id", "prompts", "tags", "prompt_tags")),
    "tag_search": (tag_search, with_views("SELECT id, prompt_text FROM prompts WHERE id IN (SELECT prompt_id FROM prompt_tags JOIN tags ON tags.id = tag_id WHERE lower(name) LIKE '%brand#1%')", "prompts", "tags", "prompt_tags")),
    "recent_prompts": (recent_prompts, with_views("SELECT id, prompt_text, strftime(created_at, '%Y-%m-%d') AS day FROM prompts ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 3", "prompts")),
    "tag_get_or_create": (tag_get_or_create, with_views("""
        , old AS (SELECT min(id) AS id, name, 1::BIGINT AS user_id FROM tags GROUP BY name HAVING min(id) % 2 = 0),
        new AS (SELECT DISTINCT name FROM tags WHERE (name LIKE 'Brand#1%' OR name LIKE 'Brand#2%') AND name NOT IN (SELECT name FROM old))
        SELECT * FROM old UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY md5(name || chr(31) || '1'), name) AS id, name, 1::BIGINT AS user_id FROM new""", "tags")),
    "prompt_templates": (prompt_templates, with_views("""
        , s AS (SELECT id, name, CASE id % 3 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN '' ELSE name END AS seed FROM tags)
        SELECT id, trim('Topic: ' || name || ' ' || CASE WHEN seed <> '' THEN 'Seed: ' || seed || ' ' ELSE '' END) AS prompt,
          CASE id % 3 WHEN 0 THEN 'Use the number ' || seed || '.' WHEN 2 THEN 'Write about ' || seed || '.' ELSE '' END AS clause,
          CASE id % 3 WHEN 0 THEN id END AS number FROM s""", "tags")),
    "quarter_slots": (quarter_slots, "SELECT (i // 4)::INTEGER AS hour, (i % 4 * 15)::INTEGER AS minute, printf('%02d:%02d', i // 4, i % 4 * 15) AS label FROM range(96) t(i)"),
    "style_picks": (style_picks, with_views("SELECT id, ['plain', 'formal', 'playful'][('0x' || substr(md5('style:' || id), 1, 8))::BIGINT % 3 + 1] AS style FROM prompts", "prompts")),
    "insert_plain": (insert_plain, _P + "SELECT * FROM p WHERE id % 2 = 0 UNION ALL SELECT * FROM p WHERE id % 3 = 0"),
    "delete_owned": (delete_owned, with_views("SELECT id, user_id FROM prompts WHERE NOT (id % 3 = 0 AND user_id % 2 = 0)", "prompts")),
    "autosave_rows": (autosave_rows, _P + "SELECT id, name || CASE WHEN id % 2 = 0 THEN ' saved' ELSE '' END AS name, balance FROM p"),
    "bookmark_enrich": (bookmark_enrich, _B("""
        SELECT id, coalesce(c_name, 'Unknown') AS author_name, CASE WHEN p_partkey % 2 = 0 THEN 'preview/' || p_partkey ELSE 'm/' || p_partkey END AS media_url,
          coalesce(array_to_string(urls, ' '), '') AS urls, coalesce(array_to_string(hashtags, ' '), '') AS hashtags, domain AS context_domain
        FROM bookmarks LEFT JOIN customer ON c_custkey = author_id AND c_custkey % 5 <> 0 LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = media_keys[1]""")),
    "top_hashtag": (top_hashtag, _B("SELECT hashtag, count(*) AS n FROM (SELECT unnest(hashtags) AS hashtag FROM bookmarks) GROUP BY 1 ORDER BY n DESC, hashtag LIMIT 1")),
    "hashtag_counts": (hashtag_counts, _B("SELECT hashtag, count(*) AS n FROM (SELECT unnest(hashtags) AS hashtag FROM bookmarks) GROUP BY 1")),
    "domain_counts": (domain_counts, _B("SELECT domain, count(*) AS n FROM bookmarks WHERE domain IS NOT NULL GROUP BY 1")),
    "month_counts": (month_counts, _B("SELECT strftime(created_at, '%B %Y') AS month, count(*) AS n FROM bookmarks GROUP BY 1")),
    "bookmark_total": (bookmark_total, _B("SELECT count(*) AS n FROM bookmarks")),
    "page_title": (page_title, r"""
        SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*property=["'']og:title["''][^>]*content=["'']([^"'']*)["'']', 1), ''), nullif(regexp_extract(html, '(?i)<title>(.*?)</title>', 1), ''), 'Untitled') AS title,
          coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*property=["'']og:description["''][^>]*content=["'']([^"'']*)["'']', 1), ''),
            nullif(regexp_extract(html, '(?i)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)["'']', 1), ''), '') AS description FROM pages"""),
    "page_text": (page_text, r"""
        SELECT page_id, body, substr(body, 1, 1000) AS preview FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1),
          '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x{00A0}\x{FEFF}\x0B]+', ' ', 'g')) AS body FROM pages)"""),
    "page_host": (page_host, r"""
        SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ''), url) AS host, coalesce(regexp_matches(url, '^https?://'), false) AS is_web,
          'https://' || regexp_replace(url, '^https?://', '') AS with_scheme FROM pages"""),
    "first_link": (first_link, "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url ELSE 'www.example.com/' || page_id END AS link FROM pages"),
    "text_segments": (text_segments, """
        SELECT page_id, pos::INTEGER AS pos, kind, value FROM (SELECT page_id, 0 AS pos, 'text' AS kind, 'read ' AS value FROM pages UNION ALL SELECT page_id, 1, 'url', url FROM pages
          UNION ALL SELECT page_id, 2, 'text', ' and ' FROM pages UNION ALL SELECT page_id, 3, 'url', url FROM pages)"""),
    "slugify": (slugify, with_views("SELECT id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM posts", "posts")),
    "unique_slug": (unique_slug, r"""
        WITH p AS (SELECT doc_id AS id, CASE WHEN doc_id % 41 <> 0 THEN lang || CASE WHEN doc_id % 50 = 0 THEN '-' || (doc_id % 7) ELSE '' END END AS base FROM documents),
        n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS nth FROM p),
        nat AS (SELECT DISTINCT regexp_extract(base, '^(.*)-(\d+)$', 1) AS stem, CAST(regexp_extract(base, '^(.*)-(\d+)$', 2) AS INTEGER) AS k FROM p WHERE regexp_matches(base, '^.*-[1-9]\d*$')),
        bases AS (SELECT base, max(nth) AS top FROM n GROUP BY 1),
        free AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) AS nth FROM (SELECT base, unnest(range(1, top + 20)) AS k FROM bases) f
                 WHERE NOT EXISTS (SELECT 1 FROM nat WHERE nat.stem = f.base AND nat.k = f.k))
        SELECT n.id, CASE WHEN n.nth = 0 THEN n.base ELSE n.base || '-' || f.k END AS slug FROM n LEFT JOIN free f ON f.base = n.base AND f.nth = n.nth"""),
    "string_forms": (string_forms, r"""
        SELECT p_partkey AS id, regexp_replace(lower(p_type), '\s+', '-', 'g') AS kebab,
          array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(lower(p_type), ' ')], ' ') AS title,
          regexp_replace(replace(p_type, ' ', '_'), '^([^_]*)_', '\1 ') AS words, upper(p_type[1]) AS initial, lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') AS two, length(p_type)::INTEGER AS len,
          translate(rtrim(base64(unhex(sha256(p_type))), '='), '+/', '-_') AS sha, base64(p_type::BLOB) AS b64, contains(p_type, 'STEEL') AS steel, starts_with(p_type, 'STANDARD') AS standard FROM part"""),
    "post_defaults": (post_defaults, with_views("""
        SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 OR excerpt = '' OR excerpt IS NULL THEN 'No excerpt available' ELSE excerpt END AS excerpt, length(excerpt)::INTEGER AS n, coalesce(tags[1], 'Uncategorized') AS tag FROM posts""", "posts")),
    "post_rejects": (post_rejects, """
        SELECT doc_id AS id, concat_ws('; ', CASE WHEN doc_id % 26 = 0 THEN 'title is required' END, CASE WHEN doc_id % 6 = 0 THEN 'meta_description is required' END, CASE WHEN doc_id % 10 = 0 THEN 'published_at is required' END,
          CASE WHEN doc_id % 14 = 0 THEN 'author_id is required' END, CASE WHEN doc_id % 15 = 0 OR doc_id % 21 = 0 THEN 'at least one tag is required' END, CASE WHEN doc_id % 22 = 0 THEN 'featured_image is required' END) AS violations FROM documents"""),
    "signed_transactions": (signed_transactions, with_views("SELECT id, user_id, CASE WHEN type = 'credit' THEN amount ELSE -amount END AS amount, CASE WHEN type = 'credit' THEN '+' ELSE '-' END || '$' || printf('%.2f', amount) AS shown FROM transactions", "transactions")),
    "owner_balance": (owner_balance, with_views("SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN type = 'credit' THEN CAST(round(amount * 100) AS BIGINT) ELSE -CAST(round(amount * 100) AS BIGINT) END) AS BIGINT) AS cents FROM transactions GROUP BY 1", "transactions")),
    "user_or_first": (user_or_first, "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 5 UNION ALL (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1)"),
    "upsert_rows": (upsert_rows, _P + "SELECT id, CASE WHEN id % 10 = 0 THEN name || '*' ELSE name END AS name, balance FROM p UNION ALL SELECT id + 1000000, name, balance FROM p WHERE id % 10 = 1"),
    "update_rows": (update_rows, _P + "SELECT id, CASE WHEN id % 4 = 0 THEN lower(name) ELSE name END AS name, CASE WHEN id % 4 = 0 THEN -balance ELSE balance END AS balance FROM p"),
    "delete_rows": (delete_rows, _P + "SELECT * FROM p WHERE id % 3 <> 0"),
    "insert_rows": (insert_rows, _P + "SELECT * FROM p WHERE id % 2 = 0 OR id % 3 = 0"),
    "toggle_done": (toggle_done, with_views("SELECT id, CASE WHEN id % 4 = 0 THEN NOT is_done ELSE is_done END AS is_done, CASE WHEN id % 4 = 0 THEN is_done ELSE is_open END AS is_open FROM reminders", "reminders")),
}
