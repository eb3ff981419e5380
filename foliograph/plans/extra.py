"""Queries on samples for training, composed graph views, memory ranking and the state of incremental work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as T
from ..operators import graph, order, records, samples
from ..sources.readers import spread, table
from .catalogue import SQL_TERMS, SQL_WORDSET, epoch, query, r6

# Samples for training


@query("""SELECT DISTINCT 'doc:' || sha1(t) AS example_id, t AS text FROM (SELECT regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<EMAIL>', 'g') AS t FROM documents)""")
def corpus_examples(spark, sf_dir):
    """Scrubbed texts under ids made from their content, each once."""
    pattern, mark = T.PII[0]
    docs = spread(table(spark, sf_dir, "documents")).select(F.regexp_replace("text", pattern, mark).alias("text"))
    return docs.dropDuplicates(["text"]).select(F.concat(F.lit("doc:"), F.sha1("text")).alias("example_id"), "text")


@query("SELECT conv_id, turn, role, 'Q: ' || trim(text) || chr(10) || 'A: ' || trim(nxt) AS prompt, 1 AS label FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL UNION ALL SELECT conv_id, turn, role, 'Q: ' || trim(text) || chr(10) || 'A: ' || trim(text), 0 FROM conversations WHERE turn = 0")
def prompt_pairs(spark, sf_dir):
    """Turns and their answers as prompts, first turns with themselves as negatives."""
    t = table(spark, sf_dir, "conversations")
    nxt = t.withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    prompt = lambda a, b: F.concat(F.lit("Q: "), F.trim(a), F.lit("\nA: "), F.trim(b)).alias("prompt")
    pos = nxt.where("nxt is not null").select("conv_id", "turn", "role", prompt("text", "nxt"), F.lit(1).alias("label"))
    return pos.unionByName(t.where("turn = 0").select("conv_id", "turn", "role", prompt("text", "text"), F.lit(0).alias("label")))


@query(f"""WITH t AS (SELECT item_id, unnest({SQL_TERMS.format('text')}) AS term FROM benchmark), h AS (SELECT item_id, (('0x' || substr(sha1(term), 1, 16))::UBIGINT % 64)::INTEGER AS dim, CASE WHEN ('0x' || substr(sha1('s' || term), 1, 16))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END AS s FROM t), v AS (SELECT item_id, dim, sum(s)::DOUBLE AS x FROM h GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1) SELECT item_id, dim, round(x / n, 6) AS value FROM v JOIN n USING (item_id) WHERE n > 0""")
def feature_hashing(spark, sf_dir):
    """Signed hashed term vectors of 64 dimensions and length one, the components that were hit."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.terms(F.col("text"))).alias("term"))
    h = t.select("item_id", T.sha1_bucket(F.col("term"), 64).alias("dim"), (1 - 2 * T.sha1_bucket(F.concat(F.lit("s"), "term"), 2)).alias("s"))
    v = h.groupBy("item_id", "dim").agg(F.sum("s").cast("double").alias("x"))
    n = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item_id")))
    return v.withColumn("n", n).where("n > 0").select("item_id", "dim", r6(F.col("x") / F.col("n")).alias("value"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), m AS (SELECT max(p_partkey) + 1 AS m FROM part), n AS (SELECT src, dst, (dst + 1 + src % 5) % m AS neg FROM e, m) SELECT src, dst, 1 AS label FROM e UNION ALL SELECT DISTINCT n.src, n.neg, 0 FROM n LEFT JOIN e ON e.src = n.src AND e.dst = n.neg WHERE e.src IS NULL""")
def link_samples(spark, sf_dir):
    """Edges as positives, shifted ones that aren't edges as negatives."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    m = (table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0) + 1
    neg = e.select("src", ((F.col("dst") + 1 + F.col("src") % 5) % m).alias("dst")).distinct().join(e, ["src", "dst"], "left_anti")
    return e.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


@query("""SELECT page_id, round(least(1.25, greatest(0.05, CASE WHEN contains(url, 'm.') THEN 0.8 ELSE 1 END * CASE WHEN contains(url, '.html') THEN 1.1 ELSE 1 END * CASE WHEN length(html) < 1500 THEN 0.5 ELSE 1 END * CASE WHEN contains(url, 'casino') OR contains(url, 'pills') THEN 0.05 ELSE 1 END)), 6) AS quality, array_to_string(list_filter([CASE WHEN contains(url, 'm.') THEN 'mobile' END, CASE WHEN length(html) < 1500 THEN 'short' END, CASE WHEN contains(url, 'casino') OR contains(url, 'pills') THEN 'spam' END], lambda x: x IS NOT NULL), ',') AS flags FROM pages""")
def quality_factors(spark, sf_dir):
    """A product of path and size factors, held between 0.05 and 1.25, and what lowered it."""
    url, small = F.col("url"), F.length("html") < 1500
    spam = url.contains("casino") | url.contains("pills")
    factor = lambda cond, x: F.when(cond, x).otherwise(1.0)
    q = factor(url.contains("m."), 0.8) * factor(url.contains(".html"), 1.1) * factor(small, 0.5) * factor(spam, 0.05)
    flags = F.array_compact(F.array(F.when(url.contains("m."), "mobile"), F.when(small, "short"), F.when(spam, "spam")))
    return table(spark, sf_dir, "pages").select("page_id", r6(F.least(F.lit(1.25), F.greatest(F.lit(0.05), q))).alias("quality"), F.array_join(flags, ",").alias("flags"))


@query("SELECT p_partkey, 'test_' || p_partkey || '[' || i || ']' AS test_id FROM (SELECT p_partkey, unnest(range((p_size % 3 + 1) * (p_partkey % 2 + 1))) AS i FROM part)")
def test_ids(spark, sf_dir):
    """One id a combination of parameters."""
    n = (F.col("p_size") % 3 + 1) * (F.col("p_partkey") % 2 + 1)
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i"))
    return p.select("p_partkey", F.concat(F.lit("test_"), "p_partkey", F.lit("["), "i", F.lit("]")).alias("test_id"))


@query("SELECT o_orderkey, v, 'store/' || CASE WHEN o_orderkey % 2 = 0 THEN 'old/' || o_orderkey ELSE strftime(o_orderdate, '%y%m') || '/' || o_orderkey END || 'v' || v || '.pdf' AS url FROM (SELECT o_orderkey, o_orderdate, unnest(list_reverse_sort(range(1, (o_orderkey % 3 + 2)::BIGINT))) AS v FROM orders)")
def url_candidates(spark, sf_dir):
    """Addresses of all versions, the latest first; old identifiers have a folder of their own."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.explode(F.reverse(F.sequence(F.lit(1).cast("bigint"), F.col("o_orderkey") % 3 + 1))).alias("v"))
    folder = F.when(F.col("o_orderkey") % 2 == 0, "old").otherwise(F.date_format("o_orderdate", "yyMM"))
    return o.select("o_orderkey", "v", F.concat(F.lit("store/"), folder, F.lit("/"), "o_orderkey", F.lit("v"), "v", F.lit(".pdf")).alias("url"))


# Memory ranking


@query(f"""WITH q AS (SELECT item_id, {SQL_WORDSET.format('text')} AS w FROM benchmark), s AS (SELECT conv_id, turn, role, {SQL_WORDSET.format('text')} AS w FROM conversations WHERE turn = 0), j AS (SELECT item_id, conv_id, 0.6 * CASE WHEN conv_id % 5 = item_id % 5 THEN 1 ELSE 0 END + 0.3 * CASE WHEN list_contains(q.w, list_min(s.w)) THEN 1 ELSE 0 END + 0.1 * len(list_intersect(q.w, s.w)) / greatest(1, len(list_distinct(q.w || s.w)))::DOUBLE AS score FROM q JOIN s ON q.item_id % 7 = s.conv_id % 7) SELECT item_id, conv_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, conv_id)::INTEGER AS rank FROM j QUALIFY rank <= 5""")
def context_rank(spark, sf_dir):
    """Summaries of a task's scope, ranked by scope, key word and overlap of words."""
    w = F.array_distinct(T.words(F.col("text")))
    q = table(spark, sf_dir, "benchmark").select("item_id", w.alias("a"), (F.col("item_id") % 7).alias("scope"))
    s = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", w.alias("b"), (F.col("conv_id") % 7).alias("scope"))
    score = 0.6 * (F.col("conv_id") % 5 == F.col("item_id") % 5).cast("int") + 0.3 * F.coalesce(F.array_contains("a", F.array_min("b")), F.lit(False)).cast("int") + 0.1 * T.jaccard(F.col("a"), F.col("b"))
    j = q.join(s, "scope").select("item_id", "conv_id", score.alias("s"))
    return order.top_per_key(j, ["item_id"], 5, F.round("s", 9).desc(), F.col("conv_id").asc()).select("item_id", "conv_id", r6("s").alias("score"), "rank")


@query("""WITH a AS (SELECT DISTINCT event_type AS action, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN 0.2 ELSE 0.3 END AS score, CASE WHEN event_type IN ('error', 'purchase') THEN 'high' ELSE 'low' END AS risk FROM events), n AS (SELECT event_type AS action, min(event_id) AS first_seen, count(DISTINCT user_id) AS evidence FROM events GROUP BY 1) SELECT action, round(score, 6) AS score, risk, evidence, row_number() OVER (ORDER BY score DESC, first_seen) AS position FROM a JOIN n USING (action)""")
def plan_synthesis(spark, sf_dir):
    """Distinct actions with a score and a risk by their cue, the evidence for each, best first."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("action")).agg(F.min("event_id").alias("first_seen"), F.count_distinct("user_id").alias("evidence"))
    score = F.when(F.col("action") == "purchase", 1.0).when(F.col("action") == "error", 0.2).otherwise(0.3)
    risk = F.when(F.col("action").isin("error", "purchase"), "high").otherwise("low")
    w = Window.orderBy(F.desc("score"), "first_seen")  # a row a type of event
    return e.select("action", score.alias("score"), risk.alias("risk"), "evidence", "first_seen").withColumn("position", F.row_number().over(w).cast("long")).drop("first_seen")


# Composed graph views


@query("""WITH k AS (SELECT b.doc_id AS node, 'same_source' AS type, 0.45 AS weight FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id <> b.doc_id WHERE a.doc_id = (SELECT min(doc_id) FROM documents)), t AS (SELECT node, type, weight FROM k ORDER BY node LIMIT 12) SELECT node::VARCHAR AS node, type, round(weight::DOUBLE, 6) AS weight FROM t UNION ALL SELECT lang, 'has_lang', 1.0 FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents) UNION ALL SELECT 'line' || i, 'has_section', 1.0 FROM (SELECT unnest(range(least(10, len(string_split(text, chr(10)))))) AS i FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents))""")
def neighbourhood(spark, sf_dir):
    """What surrounds the first document: twelve of its source, its language, up to ten sections."""
    docs = table(spark, sf_dir, "documents")
    one = docs.orderBy("doc_id").limit(1)
    near = docs.select("doc_id", "source").join(one.select("source", F.col("doc_id").alias("own")), "source").where("doc_id <> own").orderBy("doc_id").limit(12)
    edge = lambda df, node, kind, weight: df.select(node.cast("string").alias("node"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))
    sections = one.select(F.explode(F.sequence(F.lit(0), F.least(F.lit(10), F.size(T.lines(F.col("text")))) - 1)).alias("i"))
    return edge(near, F.col("doc_id"), "same_source", 0.45).unionByName(edge(one, F.col("lang"), "has_lang", 1.0)).unionByName(edge(sections, F.concat(F.lit("line"), "i"), "has_section", 1.0))


@query("SELECT 'nation' AS kind, 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, round(sum(coalesce(s_acctbal, 0)), 4) AS weight FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2, 3 UNION ALL SELECT 'region', 'r' || r_regionkey, NULL, count(n_nationkey)::DOUBLE FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2 UNION ALL SELECT 'segment', 's' || c_mktsegment, 'n' || c_nationkey, count(*)::DOUBLE FROM customer GROUP BY 1, 2, 3")
def typed_universe(spark, sf_dir):
    """Nodes of three kinds with their parents and weights."""
    n, s, r, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "region", "customer"))
    nations = n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg(F.round(F.sum(F.coalesce("s_acctbal", F.lit(0.0))), 4).alias("weight"))
    regions = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_regionkey").agg(F.count("n_nationkey").cast("double").alias("weight"))
    segments = c.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").cast("double").alias("weight"))
    node = lambda df, kind, id_, parent: df.select(F.lit(kind).alias("kind"), id_.alias("id"), parent.alias("parent"), "weight")
    named = lambda p, k: F.concat(F.lit(p), k)
    return node(nations, "nation", named("n", "n_nationkey"), named("r", "n_regionkey")).unionByName(node(regions, "region", named("r", "r_regionkey"), F.lit(None).cast("string"))).unionByName(node(segments, "segment", named("s", "c_mktsegment"), named("n", "c_nationkey")))


@query()
def detail_levels(spark, sf_dir):
    """Stratified samples of documents at three sizes, with the edges between neighbours that both ends survive."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    w = Window.partitionBy("source").orderBy("doc_id")
    edges = order.written(docs.select(F.col("doc_id").alias("src"), F.lead("doc_id").over(w).alias("dst")).where("dst is not null"), "edges")
    out = None
    for size in (50, 100, 200):
        kept = order.written(samples.stratified(docs, "source", "doc_id", size).select(F.col("doc_id").alias("node")), "level")
        level = graph.induced(edges, kept).select(F.lit(size).alias("level"), "src", "dst").unionByName(kept.select(F.lit(size).alias("level"), F.col("node").alias("src"), F.lit(None).cast("bigint").alias("dst")))
        out = level if out is None else out.unionByName(level)
    return out


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS module, l_partkey AS name FROM lineitem), i AS (SELECT s_suppkey AS module, (s_suppkey + 3) % 10 + (SELECT min(s_suppkey) FROM supplier) AS imported FROM supplier) SELECT i.module, x.name FROM i JOIN x ON x.module = i.imported WHERE i.module <> i.imported AND x.name % 3 <> 0 EXCEPT SELECT module, name FROM x""")
def star_imports(spark, sf_dir):
    """Public names that a module gets from the one it imports whole, without its own."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("name")).distinct()
    s = table(spark, sf_dir, "supplier")
    low = s.agg(F.min("s_suppkey")).first()[0] or 0
    i = s.select(F.col("s_suppkey").alias("module"), ((F.col("s_suppkey") + 3) % 10 + low).alias("imported")).where("module <> imported")
    got = i.join(x.where("name % 3 <> 0").withColumnRenamed("module", "imported"), "imported").select("module", "name").distinct()
    return got.join(x, ["module", "name"], "left_anti")


# The state of incremental work


@query("""WITH r AS (SELECT event_id, user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), s AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 'submitted' WHEN nxt IS NULL THEN 'leased' WHEN nxt > ts + INTERVAL 1 HOUR THEN 'requeued' ELSE 'renewed' END AS state FROM r) SELECT user_id, count(*) FILTER (WHERE state = 'submitted') AS submitted, count(*) FILTER (WHERE state = 'leased') AS leased, count(*) FILTER (WHERE state = 'requeued') AS requeued, count(*) FILTER (WHERE state = 'renewed') AS renewed FROM s GROUP BY user_id""")
def lease_states(spark, sf_dir):
    """Events as leases: submitted, renewed within the hour, run out and queued again, or still held."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = table(spark, sf_dir, "events").withColumn("nxt", F.lead("ts").over(w))
    state = F.when(F.col("event_type").isin("purchase", "signup"), "submitted").when(F.col("nxt").isNull(), "leased").when(F.col("nxt") > F.col("ts") + F.expr("interval 1 hour"), "requeued").otherwise("renewed")
    s = r.select("user_id", state.alias("state"))
    return s.groupBy("user_id").agg(*[F.count_if(F.col("state") == k).alias(k) for k in ("submitted", "leased", "requeued", "renewed")])


@query("SELECT source, min(CASE WHEN l.doc_id IS NULL THEN d.doc_id END) AS pending_from, max(d.doc_id) + 1 AS next_offset, coalesce(min(CASE WHEN l.doc_id IS NULL THEN d.doc_id END), max(d.doc_id) + 1) AS resume_at, least(100, count(*) FILTER (WHERE l.doc_id IS NULL)) AS remaining FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def resume_offsets(spark, sf_dir):
    """Where work on each source resumes: at the first document that isn't done, else after the last; 100 at most remain."""
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("done"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(done, "doc_id", "left")
    first = F.min(F.when(F.col("done").isNull(), F.col("doc_id")))
    after = F.max("doc_id") + 1
    return d.groupBy("source").agg(first.alias("pending_from"), after.alias("next_offset"), F.coalesce(first, after).alias("resume_at"), F.least(F.lit(100), F.count_if(F.col("done").isNull())).alias("remaining"))


@query("""WITH b AS (SELECT o_custkey AS id, max(o_orderdate) AS built FROM orders GROUP BY 1), s AS (SELECT c_custkey AS id, TIMESTAMP '1996-01-01' AS changed FROM customer) SELECT s.id, CASE WHEN b.id IS NULL THEN 'missing' WHEN b.built < s.changed THEN 'stale' ELSE 'up_to_date' END AS status FROM s LEFT JOIN b ON b.id = s.id""")
def build_status(spark, sf_dir):
    """Whether what was built for each key is missing, older than its source, or up to date."""
    built = records.last_write(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderdate")
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(built, F.col("o_custkey") == F.col("id"), "left")
    status = F.when(F.col("o_custkey").isNull(), "missing").when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "stale").otherwise("up_to_date")
    return s.select("id", status.alias("status"))


@query("""SELECT name, n, CASE WHEN n < 1000 THEN 'n<1K' WHEN n < 10000 THEN '1K<n<10K' WHEN n < 100000 THEN '10K<n<100K' WHEN n < 1000000 THEN '100K<n<1M' ELSE 'n>1M' END AS size FROM (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'pages', count(*) FROM pages)""")
def size_categories(spark, sf_dir):
    """Row counts of tables and their size class."""
    out = None
    for name in ("documents", "events", "lineitem", "pages"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    size = F.lit("n>1M")
    for most, label in ((1_000_000, "100K<n<1M"), (100_000, "10K<n<100K"), (10_000, "1K<n<10K"), (1_000, "n<1K")):
        size = F.when(F.col("n") < most, label).otherwise(size)
    return out.withColumn("size", size)


@query("SELECT event_type, user_id, sum(n) OVER (PARTITION BY user_id ORDER BY day, event_type)::BIGINT AS running, day FROM (SELECT event_type, user_id, (floor(epoch(ts))::BIGINT // 86400) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3)")
def running_counts(spark, sf_dir):
    """Each user's count of events so far, by day and type."""
    e = table(spark, sf_dir, "events").groupBy("event_type", "user_id", F.floor(epoch("ts") / 86400).alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day", "event_type").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.select("event_type", "user_id", F.sum("n").over(w).alias("running"), "day")


@query("SELECT l_partkey, 'lang:' || CASE l_linenumber % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'go' END AS language, count(*) AS n FROM lineitem GROUP BY 1, 2")
def language_counts(spark, sf_dir):
    """Files by the language of their suffix."""
    path = F.concat(F.lit("src/f"), "l_partkey", F.get(F.array(F.lit(".py"), F.lit(".rs"), F.lit(".go")), (F.col("l_linenumber") % 3).cast("int")))
    return table(spark, sf_dir, "lineitem").select("l_partkey", C.language(path).alias("language")).groupBy("l_partkey", "language").agg(F.count("*").alias("n"))
