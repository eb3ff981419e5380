"""Further queries: predicates, lookups, roll-ups, samples, layouts and ranking formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as T
from ..functions import vec
from ..operators import codegraph, graph, layout, order, samples, vectors
from ..sources.readers import spread, table
from .catalogue import SQL_TERMS, SQL_WORDSET, epoch, query, r6

# Predicates and projections


@query("SELECT doc_id, source || ' ' || coalesce(lang, '') AS categories, coalesce(nullif(trim(lang), ''), source) AS primary_category, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) = '' AS blank FROM documents")
def row_normalise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws(" ", "source", F.coalesce("lang", F.lit(""))).alias("categories"), F.coalesce(F.nullif(F.trim("lang"), F.lit("")), "source").alias("primary_category"), (T.collapse(F.col("text")) == "").alias("blank"))


@query("""SELECT doc_id, lic FROM (SELECT doc_id, CASE WHEN contains(text, 'MIT License') THEN 'mit' WHEN contains(text, 'Apache License') THEN 'apache' WHEN contains(text, 'GNU General') THEN 'gpl' END AS lic FROM documents) WHERE lic IN ('mit', 'apache') OR (lic IS NULL AND doc_id % 2 = 0)""")
def license_allow_deny(spark, sf_dir):
    """Allowed licences must be known; for even ids only known ones that are denied go."""
    text = F.col("text")
    lic = F.when(text.contains("MIT License"), "mit").when(text.contains("Apache License"), "apache").when(text.contains("GNU General"), "gpl")
    docs = table(spark, sf_dir, "documents").select("doc_id", lic.alias("lic"))
    return docs.where(F.col("lic").isin("mit", "apache") | (F.col("lic").isNull() & (F.col("doc_id") % 2 == 0)))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 500 AND 5000 AND lang IN ('en', 'fr') AND NOT contains(source, '1')")
def length_bounds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.length("text").between(500, 5000) & F.col("lang").isin("en", "fr") & ~F.col("source").contains("1")).select("doc_id", "n_chars")


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path, lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)) AS host FROM pages) SELECT page_id, host, path, NOT (contains(path, 'site-packages') OR contains(path, '.venv') OR contains(path, '__pycache__') OR contains(path, 'node_modules') OR contains(path, 'dist-packages')) AS clean, regexp_extract(path, '^/([a-z]{2})/', 1) AS section FROM p""")
def path_parts(spark, sf_dir):
    path, host = F.regexp_replace("url", "^[a-z]+://[^/]*", ""), F.lower(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), C.clean_path(path).alias("clean"), F.regexp_extract(path, "^/([a-z]{2})/", 1).alias("section"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND (event_id % 13 = 0 OR strftime(ts, '%Y%m%d')::BIGINT >= 20240105) AND contains(lower(props), 'k')")
def scoped_episodes(spark, sf_dir):
    """Types, a scope as a substring, and a time range that an unreadable time passes."""
    day = F.when(F.col("event_id") % 13 != 0, F.date_format("ts", "yyyyMMdd")).try_cast("bigint")
    events = table(spark, sf_dir, "events")
    return events.where(F.col("event_type").isin("click", "view") & (day.isNull() | (day >= 20240105)) & F.lower("props").contains("k")).select("event_id")


@query("""SELECT doc_id, CASE WHEN a <> '' THEN 'raw_pdf_preextracted' WHEN b <> '' THEN 'raw_pdf_preferred' WHEN c <> '' THEN 'combined_structured_tokens' END AS text_source, length(CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END)::INTEGER AS n_chars
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN split_part(text, chr(10), 1) ELSE '' END AS a, CASE WHEN doc_id % 2 = 0 THEN split_part(text, chr(10), 2) ELSE '' END AS b, text AS c FROM documents) WHERE a <> '' OR b <> '' OR c <> ''""")
def source_cascade(spark, sf_dir):
    """The first candidate text that isn't blank, with the name of its source."""
    lines = T.lines(F.col("text"))
    pick = [
        ("raw_pdf_preextracted", F.when(F.col("doc_id") % 3 == 0, F.get(lines, F.lit(0)))),
        ("raw_pdf_preferred", F.when(F.col("doc_id") % 2 == 0, F.get(lines, F.lit(1)))),
        ("combined_structured_tokens", F.col("text")),
    ]
    made = F.coalesce(*[F.when(F.coalesce(t, F.lit("")) != "", F.struct(F.lit(n).alias("s"), t.alias("t"))) for n, t in pick])
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("m")).where("m is not null").select("doc_id", F.col("m.s").alias("text_source"), F.length("m.t").alias("n_chars"))


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_name >= 'C' GROUP BY 1, 2 ORDER BY n_name LIMIT 10")
def list_clamped(spark, sf_dir):
    """A listing with a limit that is held between 1 and 500."""
    wanted = max(1, min(10, 500))
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    j = n.where("n_name >= 'C'").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("n_suppliers")).orderBy("n_name").limit(wanted)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 7 OR p_partkey IN (11, 13)")
def point_lookup(spark, sf_dir):
    """Point and list filters, which reach the parquet scan."""
    return table(spark, sf_dir, "part").where((F.col("p_partkey") == 7) | F.col("p_partkey").isin(11, 13)).select("p_partkey", "p_name")


# Joins


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def required_metadata(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", "quality"), "doc_id")


@query("""WITH a AS (SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice ASC, o_orderkey DESC) = 1) SELECT c_custkey, c_mktsegment, o_custkey IS NOT NULL AS has_annotation, o_orderpriority, round(o_totalprice, 6) AS confidence FROM customer LEFT JOIN a ON o_custkey = c_custkey""")
def annotated_items(spark, sf_dir):
    """Items with the last of their annotations in order of confidence, or nulls."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"), "o_orderpriority")).alias("a"))
    c = table(spark, sf_dir, "customer")
    return c.join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_mktsegment", F.col("o_custkey").isNotNull().alias("has_annotation"), "a.o_orderpriority", r6("a.o_totalprice").alias("confidence"))


@query("SELECT d.doc_id, round(coalesce(e.embedding[1]::DOUBLE, 0), 6) AS first, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS mask FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id * 2")
def teacher_lookup(spark, sf_dir):
    """Vectors by key, zeros and a mask of 0 where there is none."""
    d, e = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings")
    j = d.join(e, F.col("vec_id") == F.col("doc_id") * 2, "left")
    v = F.coalesce(vec.double(F.col("embedding")), F.array_repeat(F.lit(0.0), 64))
    return j.select("doc_id", r6(F.get(v, F.lit(0))).alias("first"), F.when(F.col("vec_id").isNull(), 0).otherwise(1).alias("mask"))


@query("SELECT a.id AS src, b.id AS dst, n, round(n / max(n) OVER (PARTITION BY a.id), 6) AS score FROM (SELECT s1.l_suppkey AS x, s2.l_suppkey AS y, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey % 20 = 0) s1 JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey % 20 = 0) s2 ON s1.l_partkey = s2.l_partkey AND s1.l_suppkey <> s2.l_suppkey GROUP BY 1, 2) t JOIN (SELECT s_suppkey AS id FROM supplier) a ON a.id = x JOIN (SELECT s_suppkey AS id FROM supplier) b ON b.id = y QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY n DESC, b.id) <= 8".replace(" WHERE l_partkey % 20 = 0", ""))
def shared_neighbours(spark, sf_dir):
    """For each supplier the eight that share most parts, by the share of the largest count."""
    one = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    a, b = one.select(F.col("l_suppkey").alias("src"), "l_partkey"), one.select(F.col("l_suppkey").alias("dst"), "l_partkey")
    n = a.join(b, "l_partkey").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    top = order.top_per_key(n, ["src"], 8, F.desc("n"), F.col("dst").asc())
    return top.select("src", "dst", "n", r6(F.col("n") / F.max("n").over(Window.partitionBy("src"))).alias("score"))


@query("WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([0-9]+)[^0-9]*$', 1) AS tail FROM pages) SELECT page_id, doc_id FROM p JOIN documents ON doc_id::VARCHAR = tail")
def basename_join(spark, sf_dir):
    """Pages and documents that meet on the last number of the path."""
    tail = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([0-9]+)[^0-9]*$", 1)
    p = table(spark, sf_dir, "pages").select("page_id", tail.alias("tail"))
    return p.join(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("tail")), "tail").select("page_id", "doc_id")


# Aggregations


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1")
def year_layer(spark, sf_dir):
    """Counts, means and spans by year; unknown years are left out."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.when(F.col("o_orderkey") % 11 != 0, F.year("o_orderdate"))).where("year is not null")
    day = "yyyy-MM-dd"
    return o.groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.date_format(F.min("o_orderdate"), day).alias("first_day"), F.date_format(F.max("o_orderdate"), day).alias("last_day"))


@query(f"WITH t AS (SELECT source, unnest({SQL_TERMS.format('text')}) AS term FROM documents), c AS (SELECT source, term, count(*) AS n FROM t GROUP BY 1, 2), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, term) <= 10) SELECT source, sum(n)::BIGINT AS total, string_agg(term, ' ' ORDER BY n DESC, term) AS terms FROM k GROUP BY source")
def material_rollup(spark, sf_dir):
    """The ten most frequent terms of each source, in order."""
    t = spread(table(spark, sf_dir, "documents")).select("source", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    top = order.top_per_key(t, ["source"], 10, F.desc("n"), F.col("term").asc())
    return top.groupBy("source").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " ").alias("terms"))


@query("SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS summary_md5, min(turn) || '-' || max(turn) AS span FROM conversations GROUP BY conv_id")
def concat_summary(spark, sf_dir):
    """Turns joined in order, with counts, sorted kinds and the span."""
    t = table(spark, sf_dir, "conversations")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n")
    return t.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_distinct("role").alias("n_roles"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.md5(joined).alias("summary_md5"), F.concat_ws("-", F.min("turn"), F.max("turn")).alias("span"))


@query("WITH i AS (SELECT l_partkey AS node, count(*) AS n_in, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1), o AS (SELECT p_partkey AS node, p_size FROM part WHERE p_size > 10) SELECT coalesce(i.node, o.node) AS node, coalesce(n_in, 0) AS n_in, coalesce(suppliers, 0) AS suppliers, coalesce(p_size, 0) AS size FROM i FULL JOIN o ON i.node = o.node")
def degree_features(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("n_in"), F.count_distinct("l_suppkey").alias("suppliers"))
    o = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("size"))
    return i.join(o, "node", "full_outer").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_in", "suppliers", "size")])


@query("SELECT o_orderpriority, strftime(max(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate ELSE o_orderdate - INTERVAL 30 DAY END), '%Y-%m-%d') AS latest FROM orders GROUP BY 1")
def latest_with_fallback(spark, sf_dir):
    """The latest date, an older one standing in where the first is missing."""
    day = F.coalesce(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")), F.col("o_orderdate") - F.expr("interval 30 days"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.date_format(F.max(day), "yyyy-MM-dd").alias("latest"))


@query("""WITH s AS (SELECT user_id, event_type, avg(abs(value)) AS c, count(*) AS f FROM events GROUP BY 1, 2), e AS (SELECT *, 0.7 * f / max(f) OVER (PARTITION BY event_type) + 0.3 * least(1, f / 10.0::DOUBLE) AS x FROM s), m AS (SELECT event_type, user_id, 0.6 * (c / (1 + c)) + 0.4 * x AS score FROM e) SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY round(score, 9) DESC, user_id)::INTEGER AS rank, round(score, 6) AS score FROM m QUALIFY rank <= 3""")
def expert_scores(spark, sf_dir):
    """The three users who are most expert in each type of event."""
    s = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg(F.abs("value")).alias("c"), F.count("*").alias("f"))
    x = 0.7 * F.col("f") / F.max("f").over(Window.partitionBy("event_type")) + 0.3 * F.least(F.lit(1), F.col("f") / 10)
    scored = s.withColumn("score", 0.6 * (F.col("c") / (1 + F.col("c"))) + 0.4 * x)
    return order.top_per_key(scored, ["event_type"], 3, F.round("score", 9).desc(), F.col("user_id").asc()).select("event_type", "user_id", "rank", r6("score").alias("score"))


# Windows, sorts and samples


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS position FROM documents")
def global_ordinal(spark, sf_dir):
    """Dense positions in a hash order, without a task that sees all rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    return order.with_position(docs, "h", "doc_id").select("doc_id", "position")


@query("SELECT source, doc_id AS src, nxt AS dst FROM (SELECT source, doc_id, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS nxt FROM documents) WHERE nxt IS NOT NULL")
def adjacent_pairs(spark, sf_dir):
    """Neighbours by id within a source and language."""
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("src"), F.lead("doc_id").over(w).alias("dst")).where("dst is not null")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), b AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) SELECT doc_id, count(*) AS n_lines, sum(strlen(line))::BIGINT AS n_bytes FROM b WHERE before < 2000 GROUP BY doc_id")
def running_budget(spark, sf_dir):
    """Lines of a document until 2,000 bytes are used, the line that goes over included."""
    lines = layout.numbered_lines(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return layout.byte_budget(lines, "doc_id", 2000).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"))


@query("SELECT conv_id, turn, conv_id || ':' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS episode_id FROM conversations")
def entity_counter(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", n).alias("episode_id"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a, len(string_split(text, chr(10))) AS n FROM documents), p AS (SELECT doc_id, a, n, unnest(range(4)) AS page FROM l) SELECT doc_id, page::INTEGER AS page, (round_even((page + 1) * n / 4.0::DOUBLE, 0) - round_even(page * n / 4.0::DOUBLE, 0))::INTEGER AS n_lines FROM p")
def near_equal_pages(spark, sf_dir):
    """A document's lines on four pages of near equal length."""
    pages = layout.near_equal_pages(T.lines(F.col("text")), 4)
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(pages).alias("page", "lines")).select("doc_id", "page", F.size("lines").alias("n_lines"))


@query()
def paragraph_cut(spark, sf_dir):
    """Paragraphs of documents, cut at blanks, headings and 1,200 characters."""
    return layout.paragraphs(spread(table(spark, sf_dir, "documents")), "doc_id", "text").select(F.col("id").alias("doc_id"), "paragraph", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY generic, n DESC, term)::INTEGER AS rank, n FROM (SELECT source, lang AS term, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS generic, count(*) AS n FROM documents GROUP BY 1, 2) QUALIFY rank <= 2")
def non_generic_first(spark, sf_dir):
    """The two most frequent values of each source, generic ones only as a fallback."""
    n = table(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("term")).agg(F.count("*").alias("n"))
    return order.top_per_key(n, ["source"], 2, F.when(F.col("term") == "en", 1).otherwise(0), F.desc("n"), F.col("term").asc())


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '-7'), doc_id LIMIT 100")
def reservoir_sample(spark, sf_dir):
    """100 documents of least seeded hash: a sample that reruns repeat."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id").limit(100)


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), w AS (SELECT source, n, CASE WHEN source = 'src0' THEN 0.5 WHEN source = 'src1' THEN 2.5 ELSE 1.0 END::DOUBLE AS w FROM n), r AS (SELECT doc_id, d.source, least(floor(w.n * w), 3 * w.n) AS target, w.n, row_number() OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn FROM documents d JOIN w ON w.source = d.source) SELECT doc_id, source, (floor(target / n) + CASE WHEN rn <= target - n * floor(target / n) THEN 1 ELSE 0 END)::INTEGER AS copies FROM r WHERE floor(target / n) + CASE WHEN rn <= target - n * floor(target / n) THEN 1 ELSE 0 END > 0")
def corpus_reweighting(spark, sf_dir):
    """Sources at a weight: below one the rows of least hash, above one copies, three at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    weight = F.when(F.col("source") == "src0", 0.5).when(F.col("source") == "src1", 2.5).otherwise(1.0)
    w = Window.partitionBy("source")
    n = docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("target", F.least(F.floor(F.col("n") * weight), 3 * F.col("n")))
    r = docs.withColumn("rn", F.row_number().over(w.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))).join(n, "source")
    whole = F.floor(F.col("target") / F.col("n"))
    copies = (whole + (F.col("rn") <= F.col("target") - F.col("n") * whole).cast("int")).cast("int")
    return r.select("doc_id", "source", copies.alias("copies")).where("copies > 0")


@query("WITH e AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey), p AS (SELECT max(p_partkey) + 1 AS m FROM part) SELECT c_custkey AS src, ((c_custkey * 7919 + k * 104729) % m)::BIGINT AS dst FROM customer, p, (SELECT unnest(range(3)) AS k) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = c_custkey AND e.dst = (c_custkey * 7919 + k * 104729) % m)")
def random_negatives(spark, sf_dir):
    """Hash-drawn pairs of customers and parts that no order joins."""
    m = (table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0) + 1
    e = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))
    drawn = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("src", ((F.col("src") * 7919 + F.col("k") * 104729) % m).alias("dst"))
    return drawn.join(e, ["src", "dst"], "left_anti")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha1(doc_id::VARCHAR), 1, 16))::UBIGINT % 100 < 5 THEN 'eval' ELSE 'train' END AS split FROM documents")
def train_eval_split(spark, sf_dir):
    part = T.sha1_bucket(F.col("doc_id").cast("string"), 100)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(part < 5, "eval").otherwise("train").alias("split"))


@query("SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return o.subtract(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


# Scalar functions


@query("""WITH t AS (SELECT doc_id, replace(text, '. ', '.' || chr(12)) AS t FROM documents), f AS (SELECT doc_id, length(t) - length(replace(t, chr(12), '')) + 1 AS n_pages, trim(regexp_replace(regexp_replace(replace(t, chr(12), chr(10) || chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS x FROM t) SELECT doc_id, n_pages::INTEGER AS n_pages, len(list_filter(string_split(x, chr(10)), lambda s: trim(s) <> ''))::INTEGER AS n_lines, md5(x) AS text_md5 FROM f""")
def page_text(spark, sf_dir):
    """Page breaks become blank lines, runs of blank lines one."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", layout.collapse_pages(F.replace("text", F.lit(". "), F.lit(".\f"))).alias("p"))
    return docs.select("doc_id", "p.n_pages", "p.n_lines", F.md5("p.text").alias("text_md5"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, 'th([a-z])', 'th-' || chr(10) || '\\1', 'g'), chr(10)), lambda l: trim(regexp_replace(l, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), lambda l: l <> ''), chr(10)), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), '\\n', ' ', 'g')) AS text_md5 FROM documents""")
def hyphen_repair(spark, sf_dir):
    """Lines joined again, words broken at line ends mended."""
    broken = F.regexp_replace("text", "th([a-z])", "th-\n$1")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(C.repair_lines(T.lines(broken))).alias("text_md5"))


@query("""SELECT part_id, y, strftime(d, '%Y-%m-%d') AS d, slug FROM (SELECT p_partkey AS part_id, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 100 >= 90 THEN 1900 ELSE 2000 END + p_partkey % 100 ELSE 2000 + p_partkey % 25 END::INTEGER AS y, DATE '2007-04-01' + (p_partkey % 28)::INTEGER AS d, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part)""")
def ids_and_dates(spark, sf_dir):
    """Years out of identifiers, dates out of mail headers, slugs out of names."""
    k = F.col("p_partkey")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    paper = F.when(k % 2 == 0, F.concat(F.lit("math/"), two(k % 100), F.lit("01001"))).otherwise(F.concat(two(k % 25), F.lit("01.00001")))
    header = F.concat(F.lit("Mon, "), (k % 28 + 1).cast("string"), F.lit(" Apr 2007 19:18:42 GMT"))
    return table(spark, sf_dir, "part").select(k.alias("part_id"), C.id_year(paper).cast("int").alias("y"), F.date_format(C.rfc_date(header), "yyyy-MM-dd").alias("d"), T.slug(F.col("p_name")).alias("slug"))


@query(f"SELECT i.item_id, d.doc_id, round(len(list_intersect(i.w, d.w)) / greatest(1, len(list_distinct(i.w || d.w)))::DOUBLE, 6) AS score FROM (SELECT item_id, {SQL_WORDSET.format('text')} AS w FROM benchmark) i JOIN (SELECT doc_id, {SQL_WORDSET.format('text')} AS w FROM documents) d ON d.doc_id = i.item_id")
def token_relevance(spark, sf_dir):
    """Jaccard overlap of the word sets of pairs."""
    w = F.array_distinct(T.words(F.col("text")))
    i, d = table(spark, sf_dir, "benchmark").select("item_id", w.alias("a")), table(spark, sf_dir, "documents").select("doc_id", w.alias("b"))
    return i.join(d, F.col("doc_id") == F.col("item_id")).select("item_id", "doc_id", r6(T.jaccard(F.col("a"), F.col("b"))).alias("score"))


@query("""SELECT p_partkey, o_partkey, round(score, 6) AS score, rank FROM (SELECT a.p_partkey, b.p_partkey AS o_partkey, len(list_intersect(a.c, b.c)) / len(list_distinct(a.c || b.c))::DOUBLE AS score, row_number() OVER (PARTITION BY a.p_partkey ORDER BY round(len(list_intersect(a.c, b.c)) / len(list_distinct(a.c || b.c))::DOUBLE, 9) DESC, b.p_partkey)::INTEGER AS rank FROM (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(lower(p_type), '')) AS c FROM part) a JOIN (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(lower(p_type), '')) AS c FROM part) b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey) WHERE rank <= 3""")
def character_ranking(spark, sf_dir):
    """Candidates of the same brand and size by the overlap of their letters.

    Parts of one brand, size and set of letters are a class, and classes are compared instead of parts. A class needs
    its candidates of the first four keys, three rows of each: without a part's own key the first three rows remain.
    """
    cls = ["p_brand", "p_size", "letters"]
    letters = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("p_type"), ""))), "")
    p = spread(table(spark, sf_dir, "part").where("p_partkey is not null and p_brand is not null and p_size is not null")).select("p_partkey", "p_brand", "p_size", letters.alias("letters"))
    few = order.top_per_key(p.groupBy(*cls, "p_partkey").agg(F.count("*").alias("n")), cls, 4, "p_partkey")
    a = few.groupBy(*cls).agg(F.collect_list(F.struct("p_partkey", F.least("n", F.lit(3)).cast("int").alias("n"))).alias("few"))
    b = a.select("p_brand", "p_size", F.col("letters").alias("o_letters"), "few")
    s = F.when(F.col("letters").isNotNull() & F.col("o_letters").isNotNull(), T.jaccard(F.split("letters", ""), F.split("o_letters", "")))
    pairs = a.drop("few").join(b, ["p_brand", "p_size"]).select(*cls, s.alias("s"), F.explode("few").alias("o"))
    rows = pairs.select(*cls, "s", F.col("o.p_partkey").alias("o_partkey"), F.explode(F.array_repeat(F.lit(0), F.col("o.n")))).drop("col")
    best = order.top_per_key(rows, [*cls, "o_partkey"], 3, F.desc("s"), name="copy").withColumn("best", F.max("s").over(Window.partitionBy(*cls, "o_partkey")))
    by_best = Window.partitionBy(*cls).orderBy(F.round("best", 9).desc(), "o_partkey")
    top = best.withColumn("place", F.dense_rank().over(by_best)).where("place <= 4").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("letters").alias("o"), "o_partkey", "s")
    same = (F.col("p_brand") == F.col("brand")) & (F.col("p_size") == F.col("size")) & F.col("letters").eqNullSafe(F.col("o"))
    j = p.join(top, same).where("p_partkey <> o_partkey").select("p_partkey", "o_partkey", "s")
    return order.top_per_key(j, ["p_partkey"], 3, F.round("s", 9).desc(), F.col("o_partkey").asc()).select("p_partkey", "o_partkey", r6("s").alias("score"), "rank")


@query("""WITH t AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: length(x) >= 4) AS w FROM documents)), c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS p FROM t GROUP BY 1, 2) SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p)::INTEGER AS rank FROM c QUALIFY rank <= 8""")
def keyword_frequency(spark, sf_dir):
    """The eight most frequent words of four letters or more, first seen first on ties."""
    w = F.filter(T.words(F.col("text")), lambda x: F.length(x) >= 4)
    t = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(w).alias("pos", "term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return order.top_per_key(t, ["doc_id"], 8, F.desc("n"), F.col("p").asc()).select("doc_id", "term", "n", "rank")


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'and') THEN 'cs.LG' WHEN contains(lower(text), 'le ') THEN 'cs.CL' WHEN contains(lower(text), 'der') THEN 'math.OC' ELSE 'cs.AI' END AS category, array_to_string(list_transform(list_slice(list_filter(string_split(text, chr(10)), lambda s: s <> ''), 1, 3), lambda s, i: 'step_' || i || ': ' || substr(s, 1, 20)), '; ') AS steps FROM documents""")
def rule_labels(spark, sf_dir):
    """A category by ordered rules, and the first lines as numbered steps."""
    low = F.lower("text")
    label = F.when(low.contains("the") & low.contains("and"), "cs.LG").when(low.contains("le "), "cs.CL").when(low.contains("der"), "math.OC").otherwise("cs.AI")
    steps = F.transform(F.slice(F.filter(T.lines(F.col("text")), lambda s: s != ""), 1, 3), lambda s, i: F.concat(F.lit("step_"), (i + 1).cast("string"), F.lit(": "), F.substring(s, 1, 20)))
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("category"), F.array_join(steps, "; ").alias("steps"))


@query("""WITH q AS (SELECT conv_id, turn, (['de','en','es','fr'])[(conv_id + turn) % 4 + 1] AS lang, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: length(x) >= 5) AS w FROM conversations), c AS (SELECT doc_id, lang, lower(text) AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents), k AS (SELECT lang, list(t ORDER BY rn) AS ts, list(doc_id ORDER BY rn) AS ids FROM c WHERE rn <= 5 GROUP BY lang)
SELECT conv_id, turn, lang, coalesce(list_filter(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN len(list_filter(w, lambda x: contains(ts[i], x))) > 0 THEN ids[i] END), lambda v: v IS NOT NULL)[1], ids[1]) AS doc_id FROM q JOIN k USING (lang)""")
def first_containing(spark, sf_dir):
    """For every turn, dealt to a language, the first of five candidate documents that contains one of its long words, else the first."""
    words = F.filter(T.words(F.col("text")), lambda x: F.length(x) >= 5)
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(F.array(*map(F.lit, ("de", "en", "es", "fr"))), ((F.col("conv_id") + F.col("turn")) % 4).cast("int")).alias("lang"), words.alias("w"))
    c = order.top_per_key(table(spark, sf_dir, "documents").select("lang", "doc_id", F.lower("text").alias("t")), ["lang"], 5, "doc_id")
    k = c.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "t"))).alias("c"))
    hit = F.get(F.filter("c", lambda d: F.exists("w", lambda x: d["t"].contains(x))), F.lit(0))["doc_id"]
    return q.join(k, "lang").select("conv_id", "turn", "lang", F.coalesce(hit, F.get("c", F.lit(0))["doc_id"]).alias("doc_id"))


# Graph layers


@query("SELECT 'has_source' AS type, doc_id AS src, source AS dst FROM documents UNION ALL SELECT 'has_lang', doc_id, lang FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'has_label', doc_id, quality::VARCHAR FROM labels")
def layer_edges(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    edge = lambda df, kind, dst: df.select(F.lit(kind).alias("type"), F.col("doc_id").alias("src"), F.col(dst).cast("string").alias("dst"))
    return edge(docs, "has_source", "source").unionByName(edge(docs.where("lang is not null"), "has_lang", "lang")).unionByName(edge(labels, "has_label", "quality"))


@query("WITH t AS (SELECT DISTINCT p_name AS n FROM part UNION SELECT DISTINCT regexp_replace(p_name, ' [^ ]*$', '') FROM part WHERE p_partkey % 3 = 0 UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part) SELECT c.n AS child, p.n AS parent FROM t c JOIN t p ON p.n = regexp_replace(c.n, ' [^ ]*$', '') AND p.n <> c.n")
def taxonomy_edges(spark, sf_dir):
    """Names and the name without their last word, where that is a name too."""
    part, up = table(spark, sf_dir, "part"), F.regexp_replace("p_name", " [^ ]*$", "")
    names = part.select("p_name").union(part.where("p_partkey % 3 = 0").select(up)).union(part.select(F.get(F.split("p_name", " "), F.lit(0)))).toDF("child").distinct()
    named = names.withColumn("parent", F.regexp_replace("child", " [^ ]*$", "")).where("parent <> child")
    return named.join(names.select(F.col("child").alias("parent")), "parent").select("child", "parent")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT 'c' || src AS node FROM d WHERE dst = (SELECT min(s_suppkey) FROM supplier) UNION SELECT 's' || (SELECT min(s_suppkey) FROM supplier)""")
def dependants(spark, sf_dir):
    """Everything that needs the first supplier, over the edges from customers to suppliers."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = j.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    first = table(spark, sf_dir, "supplier").agg(F.concat(F.lit("s"), F.min("s_suppkey")).alias("node"))
    return codegraph.dependants(e, first)


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT doc_id, line_no::INTEGER AS line_no, line FROM l WHERE regexp_matches(line, '[Ll]icen[sc]ed? (under|the)|reserved')")
def reference_search(spark, sf_dir):
    """Lines that match a pattern, with their numbers."""
    lines = layout.numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.where(F.col("line").rlike("[Ll]icen[sc]ed? (under|the)|reserved")).select("doc_id", (F.col("line_no") + 1).alias("line_no"), "line")


@query()
def code_graph(spark, sf_dir):
    """Entities and calls of small Python files made from the parts table."""
    k = F.col("p_partkey").cast("string")
    nxt = (F.col("p_partkey") + 1).cast("string")
    src = F.concat(F.lit("import os\nfrom lib.m"), nxt, F.lit(" import f"), nxt, F.lit("\n\n\ndef f"), k, F.lit("(x):\n    return f"), nxt, F.lit("(x)\n\n\nclass C"), k, F.lit(":\n    def go(self):\n        return f"), k, F.lit("(1)\n"))
    parsed = order.written(codegraph.parse(table(spark, sf_dir, "part").select(F.concat(F.lit("lib/m"), k, F.lit(".py")).alias("path"), src.alias("text"))), "parsed")
    return codegraph.who_calls(parsed)


@query("SELECT label, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(sqrt(list_inner_product(v, v)) / (1 + sqrt(list_inner_product(v, v))), 6) AS bounded FROM (SELECT label, list(value ORDER BY dim) AS v FROM (SELECT label, dim, avg(x) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2) GROUP BY label)")
def bounded_norms(spark, sf_dir):
    """Norms of centroids, and norms held under one."""
    c = vectors.assemble(vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding"), "label")
    n = vec.norm(F.col("vector"))
    return c.select("label", r6(n).alias("norm"), r6(n / (1 + n)).alias("bounded"))


@query()
def smoothed_sample(spark, sf_dir):
    """A stratified sample of documents and the neighbours of its members by id."""
    s = order.written(samples.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 100).select(F.col("doc_id").alias("node")), "sample")
    edges = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    return graph.hops(edges, s, 1).select("node", "hop")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, max(floor(epoch(ts))::BIGINT) - min(floor(epoch(ts))::BIGINT) AS span FROM events GROUP BY user_id")
def entity_spans(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), (F.max(epoch("ts")) - F.min(epoch("ts"))).alias("span"))
