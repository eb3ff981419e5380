"""Queries on lookups by key and address, search over concepts, resumed work, and small text and code facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as T
from ..operators import bags, order
from ..sources.readers import spread, table
from .catalogue import SQL_TERMS, query, r6

SQL_COLLAPSED = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"

# Search


@query(f"""WITH b AS (SELECT item_id AS id, term, count(*) AS tf FROM (SELECT item_id, unnest({SQL_TERMS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
n AS (SELECT count(*)::DOUBLE AS n FROM benchmark), l AS (SELECT id, sum(tf)::DOUBLE AS dl FROM b GROUP BY id), a AS (SELECT sum(dl) / (SELECT n FROM n) AS av FROM l),
i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM b, n GROUP BY term, n), m AS (SELECT avg(raw) AS mean FROM i),
w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM i, m),
s AS (SELECT q.id AS query, d.id, sum(q.tf * w.idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score FROM b q JOIN w USING (term) JOIN b d USING (term) JOIN l ON l.id = d.id, a WHERE q.id <> d.id GROUP BY 1, 2),
z AS (SELECT q.item_id AS query, d.item_id AS id, coalesce(score, 0.0) AS score FROM benchmark q JOIN benchmark d ON q.item_id <> d.item_id LEFT JOIN s ON s.query = q.item_id AND s.id = d.item_id)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)::INTEGER AS rank, round(score, 6) AS score FROM z QUALIFY rank <= 5""")
def bm25_search(spark, sf_dir):
    """Each item's five best others by BM25 (k1 1.5, b 0.75, negative idf a quarter of the mean), filled up with items of score zero."""
    items = table(spark, sf_dir, "benchmark")
    bag = order.written(bags.bags(items, "item_id", "text"), "bm25")
    n = items.count()
    weights = bag.groupBy("term").agg((F.log(n - F.count("*") + 0.5) - F.log(F.count("*") + 0.5)).alias("raw"))
    mean = weights.agg(F.avg("raw")).first()[0] or 0.0
    weights = weights.select("term", F.when(F.col("raw") < 0, 0.25 * mean).otherwise(F.col("raw")).alias("idf"))
    lengths = bag.groupBy("id").agg(F.sum("tf").cast("double").alias("dl"))
    mean_length = (bag.agg(F.sum("tf")).first()[0] or 0) / max(n, 1)
    d = bag.join(lengths, "id").withColumnRenamed("tf", "dtf")
    part = F.col("tf") * F.col("idf") * F.col("dtf") * 2.5 / (F.col("dtf") + 1.5 * (0.25 + 0.75 * F.col("dl") / mean_length))
    scores = bag.withColumnRenamed("id", "query").join(weights, "term").join(d, "term").where("query <> id").groupBy("query", "id").agg(F.sum(part).alias("score"))
    # A query with fewer than five hits takes others in order of id; among the first ten enough are left.
    first = [r[0] for r in items.select("item_id").orderBy("item_id").limit(11).collect()]
    fill = items.select(F.col("item_id").alias("query"), F.explode(F.array(*map(F.lit, first))).alias("id")).where("query <> id").withColumn("score", F.lit(0.0))
    best = scores.unionByName(fill).groupBy("query", "id").agg(F.sum("score").alias("score"))
    return bags.ranked(best, 5).select("query", "id", "rank", r6("score").alias("score"))


@query("""WITH c AS (SELECT vec_id, list_distinct(string_split(p_name, ' ')) AS w, embedding::DOUBLE[] AS e FROM embeddings JOIN part ON vec_id = p_partkey), q AS (SELECT e, w FROM c WHERE vec_id = 0)
SELECT vec_id, round(0.4 * len(list_intersect(c.w, q.w)) / len(list_distinct(list_concat(c.w, q.w))) + 0.6 * list_cosine_similarity(c.e, q.e), 6) AS score FROM c, q ORDER BY score DESC, vec_id LIMIT 8""")
def concept_search(spark, sf_dir):
    """The eight concepts nearest to one: names by Jaccard, 0.4, and vectors by cosine, 0.6."""
    c = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "part"), F.col("vec_id") == F.col("p_partkey")).select("vec_id", F.array_distinct(F.split("p_name", " ")).alias("w"), F.col("embedding").cast("array<double>").alias("e"))
    q = c.where("vec_id = 0").select(F.col("e").alias("qe"), F.col("w").alias("qw"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(F.col("e"), F.col("qe")) / F.sqrt(dot(F.col("e"), F.col("e"))) / F.sqrt(dot(F.col("qe"), F.col("qe")))
    score = 0.4 * F.size(F.array_intersect("w", "qw")) / F.size(F.array_union("w", "qw")) + 0.6 * cosine
    return c.join(F.broadcast(q.limit(1)), F.lit(True)).select("vec_id", r6(score).alias("score")).orderBy(F.desc("score"), "vec_id").limit(8)


@query("""SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'widget') AND (lower(p_type) = 'economy' OR lower(p_brand) = 'economy') AND (contains(lower(p_name), 'cold') OR contains(lower(p_brand), 'cold') OR contains(lower(p_type), 'cold')) ORDER BY p_partkey LIMIT 200""")
def algorithm_search(spark, sf_dir):
    """Members of a problem and of a topic, by any case, that hold a string in any field; 200 at most."""
    p = table(spark, sf_dir, "part")
    topic = (F.lower("p_type") == "economy") | (F.lower("p_brand") == "economy")
    any_field = F.lower("p_name").contains("cold") | F.lower("p_brand").contains("cold") | F.lower("p_type").contains("cold")
    return p.where(F.array_contains(F.split("p_name", " "), "widget") & topic & any_field).select("p_partkey", "p_name").orderBy("p_partkey").limit(200)


@query("""WITH h AS (SELECT p_partkey FROM part WHERE contains(lower(p_name), 'cold')), e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN h ON l_partkey = p_partkey) SELECT l_partkey, l_suppkey FROM e QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) <= 8""")
def neighbour_search(spark, sf_dir):
    """Nodes whose name holds a string, with eight neighbours at most."""
    h = table(spark, sf_dir, "part").where(F.lower("p_name").contains("cold")).select(F.col("p_partkey").alias("l_partkey"))
    e = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(h, "l_partkey").distinct()
    return e.withColumn("i", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_suppkey"))).where("i <= 8").drop("i")


@query("""WITH d AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS domain, p_size FROM part) SELECT a.domain AS left_domain, b.domain AS right_domain, count(*) AS shared FROM d a JOIN d b USING (p_size) WHERE a.domain < b.domain GROUP BY 1, 2""")
def domain_links(spark, sf_dir):
    """Domains, named by keywords, that share concepts. Pairs go by the distinct (domain, concept), few for each concept: one a keyword."""
    d = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("domain"), "p_size").distinct()
    b = d.withColumnRenamed("domain", "right_domain")
    return d.withColumnRenamed("domain", "left_domain").join(b, "p_size").where("left_domain < right_domain").groupBy("left_domain", "right_domain").agg(F.count("*").alias("shared"))


@query("""WITH u AS (SELECT c_nationkey AS id, 'customer' AS kind, c_mktsegment AS topic FROM customer UNION ALL SELECT s_nationkey, 'supplier', NULL FROM supplier UNION ALL SELECT n_nationkey, 'nation', n_name FROM nation)
SELECT id, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM u GROUP BY id""")
def merged_concepts(spark, sf_dir):
    """Concepts of three sources merged by id, with their kinds and topics."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("topic"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.lit("supplier").alias("kind"), F.lit(None).cast("string").alias("topic"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("topic"))
    listed = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit(""))
    return c.unionByName(s).unionByName(n).groupBy("id").agg(F.count("*").alias("n"), listed("kind").alias("kinds"), listed("topic").alias("topics"))


# Lookups by key and address


@query("""WITH u AS (SELECT doc_id, 'doc://' || doc_id || '#L' || (1 + doc_id % 5) || '-L' || (3 + doc_id % 5) AS uri FROM labels), p AS (SELECT uri, regexp_extract(uri, 'doc://([0-9]+)', 1)::BIGINT AS doc_id, regexp_extract(uri, '#L([0-9]+)', 1)::INTEGER AS s, regexp_extract(uri, '-L([0-9]+)', 1)::INTEGER AS e FROM u),
l AS (SELECT uri, s, e, string_split(text, chr(10)) AS lines FROM p JOIN documents USING (doc_id)) SELECT uri, greatest(1, s - 1)::INTEGER AS first_line, least(len(lines), e + 1)::INTEGER AS last_line, array_to_string(list_slice(lines, greatest(1, s - 1), least(len(lines), e + 1)), chr(10)) AS snippet FROM l WHERE s <= len(lines)""")
def source_spans(spark, sf_dir):
    """Addresses of lines resolved to their text with a line of context on both sides; addresses past the end fall out."""
    place = F.col("doc_id") % 5
    u = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc://"), "doc_id", F.lit("#L"), 1 + place, F.lit("-L"), 3 + place).alias("uri"))
    at = lambda pattern, kind: F.regexp_extract("uri", pattern, 1).cast(kind)
    p = u.select("uri", at("doc://([0-9]+)", "long").alias("doc_id"), at("#L([0-9]+)", "int").alias("s"), at("-L([0-9]+)", "int").alias("e"))
    j = p.join(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines")), "doc_id").where(F.col("s") <= F.size("lines"))
    first, last = F.greatest(F.lit(1), F.col("s") - 1), F.least(F.size("lines"), F.col("e") + 1)
    return j.select("uri", first.alias("first_line"), last.alias("last_line"), F.array_join(F.slice("lines", first, last - first + 1), "\n").alias("snippet"))


@query("""WITH r AS (SELECT s_nationkey AS nation, min(s_suppkey) AS adapter FROM supplier WHERE s_acctbal > 0 GROUP BY 1), p AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS skill FROM customer) SELECT p.nation, skill, coalesce(adapter, -1) AS adapter FROM p LEFT JOIN r ON p.nation = r.nation""")
def registry_lookup(spark, sf_dir):
    """The registered adapter of every planned pair of place and skill, -1 where none is."""
    r = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_suppkey").alias("adapter"))
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("skill")).distinct()
    return p.join(r, "nation", "left").select("nation", "skill", F.coalesce("adapter", F.lit(-1)).alias("adapter"))


@query("""SELECT n_nationkey, sha256(n_name || '|' || '' || '|' || coalesce(l, '')) AS context_key FROM nation LEFT JOIN (SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS l FROM customer GROUP BY 1) ON n_nationkey = c_nationkey""")
def context_keys(spark, sf_dir):
    """A key of name, branch and sorted languages."""
    langs = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("l"))
    return table(spark, sf_dir, "nation").join(langs, "n_nationkey", "left").select("n_nationkey", F.sha2(F.concat_ws("|", "n_name", F.lit(""), F.coalesce("l", F.lit(""))), 256).alias("context_key"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND starts_with(lower(o_orderpriority), '1-u'))")
def missing_marker(spark, sf_dir):
    """Holders without a file whose name starts in a given way, by any case."""
    have = table(spark, sf_dir, "orders").where(F.lower("o_orderpriority").startswith("1-u")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(have, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'SMALL') OR (p_type = 'PROMO' AND p_size > 20 AND trim(p_name) <> '') ORDER BY p_partkey LIMIT 500")
def indexable_entities(spark, sf_dir):
    """Entities of given kinds, or of another kind with a known label and a name; the first 500."""
    p = table(spark, sf_dir, "part")
    named = (F.col("p_type") == "PROMO") & (F.col("p_size") > 20) & (F.trim("p_name") != "")
    return p.where(F.col("p_type").isin("ECONOMY", "STANDARD", "SMALL") | named).select("p_partkey", "p_type").orderBy("p_partkey").limit(500)


# Sets, seeds and inputs


@query("SELECT p_partkey, string_agg(w, ' ' ORDER BY pos) AS words FROM (SELECT p_partkey, w, min(pos) AS pos FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || lower(p_type) || ' ' || p_name, ' ')) AS w, generate_subscripts(string_split(p_name || ' ' || lower(p_type) || ' ' || p_name, ' '), 1) AS pos FROM part) GROUP BY 1, 2) GROUP BY p_partkey")
def ordered_union(spark, sf_dir):
    """Lists put one after another, each value at its first place."""
    words = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")), F.split("p_name", " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(words), " ").alias("words"))


@query("SELECT lower(p_name) AS key, min(p_partkey) AS first_id, count(*) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS topics FROM part GROUP BY 1")
def seed_upsert(spark, sf_dir):
    """Entries merged under one key: the first makes the row, later ones add topics that it lacks."""
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("key")).agg(F.min("p_partkey").alias("first_id"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("topics"))


@query("SELECT 'part-' || l_suppkey AS path, min(l_orderkey * 10 + l_linenumber)::BIGINT AS place FROM lineitem GROUP BY 1")
def input_expansion(spark, sf_dir):
    """Paths from several lists, each once, at its first place."""
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("part-"), "l_suppkey").alias("path")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))


@query("SELECT sha1(text) AS example_id, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def corpus_split(spark, sf_dir):
    """A split's texts under ids of their content, each once."""
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha1("text").alias("example_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


# Resumed work


@query("WITH l AS (SELECT user_id, max(ts)::DATE AS latest, max(ts) FILTER (WHERE event_type = 'purchase')::DATE AS saved FROM events GROUP BY 1) SELECT user_id, strftime(coalesce(saved, latest - INTERVAL 3 DAY), '%Y-%m-%d') AS from_date FROM l")
def rewind_dates(spark, sf_dir):
    """Where a harvest starts: at the saved date, else three days before the latest record."""
    saved = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).cast("date")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_format(F.coalesce(saved, F.date_sub(F.max("ts").cast("date"), 3)), "yyyy-MM-dd").alias("from_date"))


@query("WITH m AS (SELECT date_trunc('month', o_orderdate) AS page, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT page, n, sum(n) OVER (ORDER BY page) AS running FROM m) SELECT strftime(page, '%Y-%m') AS page, n, running::BIGINT AS running FROM r WHERE running - n < 500")
def paged_harvest(spark, sf_dir):
    """Pages of records in order until 500 are read. The window runs over one row a page."""
    m = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("page")).agg(F.count("*").alias("n"))
    return m.withColumn("running", F.sum("n").over(Window.orderBy("page"))).where("running - n < 500")


@query("WITH s AS (SELECT user_id // 3 AS shard, count(*) AS n FROM events WHERE user_id <> 21 AND user_id <> 22 AND user_id <> 23 GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY shard) - 1 AS i FROM s) SELECT shard, n FROM i WHERE shard = i")
def committed_shards(spark, sf_dir):
    """Committed shards before the first gap, from which a build goes on. The window runs over one row a shard."""
    s = table(spark, sf_dir, "events").where(~F.col("user_id").isin(21, 22, 23)).groupBy(F.floor(F.col("user_id") / 3).alias("shard")).agg(F.count("*").alias("n"))
    return s.withColumn("i", F.row_number().over(Window.orderBy("shard")) - 1).where("shard = i").drop("i")


@query("SELECT count(*) AS records, count(DISTINCT user_id) AS workers, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 2) AS total FROM events")
def run_metrics(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("records"), F.count_distinct("user_id").alias("workers"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 2).alias("total"))


# Text and code


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lower({SQL_COLLAPSED.format('text')}) HAVING count(*) > 1")
def exact_matches(spark, sf_dir):
    """Texts that are equal in lower case with white space collapsed."""
    key = F.sha2(F.lower(T.collapse(F.col("text"))), 256)
    return spread(table(spark, sf_dir, "documents")).where("text is not null").groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").drop("key")


@query("""SELECT event_id, regexp_replace('{"run": ' || props || ', "paths": ["/exports/a/' || user_id || '", "/other/b"], "at": "/exports/c"}', '"/exports/', '"', 'g') AS meta FROM events""")
def nested_paths(spark, sf_dir):
    """Paths under the export root made relative, at any depth."""
    meta = F.concat(F.lit('{"run": '), "props", F.lit(', "paths": ["/exports/a/'), "user_id", F.lit('", "/other/b"], "at": "/exports/c"}'))
    return table(spark, sf_dir, "events").select("event_id", F.regexp_replace(meta, '"/exports/', '"').alias("meta"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {SQL_COLLAPSED.format('x')}), lambda x: x <> '') AS s FROM documents), p AS (SELECT doc_id, coalesce(list_filter(s, lambda x: contains(lower(x), 'the') OR contains(lower(x), 'der'))[1], s[1], '') AS s FROM l)
SELECT doc_id, array_to_string(list_slice(string_split(s, ' '), 1, 34), ' ') AS picked FROM p""")
def cue_sentences(spark, sf_dir):
    """The first line that holds a cue, else the first one, 34 words of it."""
    lines = F.filter(F.transform(F.split(F.col("text"), "\n", -1), T.collapse), lambda x: x != "")
    cued = F.filter("s", lambda x: F.lower(x).contains("the") | F.lower(x).contains("der"))
    picked = F.coalesce(F.get(cued, F.lit(0)), F.get("s", F.lit(0)), F.lit(""))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", lines.alias("s")).select("doc_id", F.array_join(F.slice(F.split(picked, " ", -1), 1, 34), " ").alias("picked"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {SQL_COLLAPSED.format('x')}), lambda x: length(x) >= 40) AS s FROM documents) SELECT doc_id, left(array_to_string(list_slice(s, 1, 2), ' '), 360) AS summary FROM l WHERE len(s) > 0""")
def readme_summary(spark, sf_dir):
    """The first two long lines, 360 characters of them."""
    lines = F.filter(F.transform(F.split(F.col("text"), "\n", -1), T.collapse), lambda x: F.length(x) >= 40)
    return spread(table(spark, sf_dir, "documents")).select("doc_id", lines.alias("s")).where(F.size("s") > 0).select("doc_id", F.substring(F.array_join(F.slice("s", 1, 2), " "), 1, 360).alias("summary"))


@query("SELECT conv_id, turn // 2 AS page, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2")
def paged_text(spark, sf_dir):
    """Pages of two blocks with their text and counts."""
    t = table(spark, sf_dir, "conversations").withColumn("page", F.floor(F.col("turn") / 2))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return t.groupBy("conv_id", "page").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"), joined.alias("text"))


@query("SELECT conv_id, CASE WHEN length(t) > 80 THEN rtrim(left(t, 77)) || '...' ELSE t END AS answer FROM (SELECT conv_id, " + SQL_COLLAPSED.format("text") + " AS t FROM conversations WHERE turn = 0)")
def short_answers(spark, sf_dir):
    """First turns, shortened to 80 characters."""
    t = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", T.collapse(F.col("text")).alias("t"))
    return t.select("conv_id", F.when(F.length("t") > 80, F.concat(F.rtrim(F.substring("t", 1, 77)), F.lit("..."))).otherwise(F.col("t")).alias("answer"))


@query("SELECT c_nationkey, CASE WHEN avg(c_acctbal) > 5000 THEN 'formal' WHEN count(*) > 10 THEN 'broad' ELSE 'plain' END AS style, count(DISTINCT c_mktsegment) AS kinds FROM customer GROUP BY 1")
def persona_style(spark, sf_dir):
    style = F.when(F.avg("c_acctbal") > 5000, "formal").when(F.count("*") > 10, "broad").otherwise("plain")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(style.alias("style"), F.count_distinct("c_mktsegment").alias("kinds"))


SQL_CODE = "'import ' || replace(p_name, ' ', chr(10) || 'from ') || ' import x' || chr(10) || 'def ' || replace(p_name, ' ', '_') || '(a, b):' || chr(10) || '    return a' || chr(10) || 'class _Hidden:' || chr(10) || 'class ' || p_type || ':' || chr(10)"


@query(f"""WITH c AS (SELECT p_partkey, {SQL_CODE} AS code FROM part) SELECT p_partkey, array_to_string(regexp_extract_all(code, '(?m)^\\s*(?:from|import)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ',') AS roots,
array_to_string(list_filter(regexp_extract_all(code, '(?m)^\\s*(?:def|class)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), lambda s: NOT starts_with(s, '_')), ',') AS symbols, array_to_string(list_slice(regexp_extract_all(code, '(?m)^\\s*((?:def|class)\\s+[^\\n:]*)', 1), 1, 5), chr(10)) AS summary, 'pseudo_code' AS kind FROM c""")
def code_facts(spark, sf_dir):
    """Imported modules, public symbols, signatures and kind of a piece of code."""
    name = F.col("p_name")
    code = F.concat(F.lit("import "), F.replace(name, F.lit(" "), F.lit("\nfrom ")), F.lit(" import x\ndef "), F.replace(name, F.lit(" "), F.lit("_")), F.lit("(a, b):\n    return a\nclass _Hidden:\nclass "), "p_type", F.lit(":\n"))
    kind = C.block_type(F.concat(code, F.lit("for x in y: return")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.import_roots(code), ",").alias("roots"), F.array_join(C.symbols(code), ",").alias("symbols"), C.code_summary(code).alias("summary"), kind.alias("kind"))
