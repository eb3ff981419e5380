"""All queries of the library by name, with the SQL that must agree with them.

A query takes (spark, sf_dir) and returns a DataFrame over whole tables. Numbers in floating point
are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

from ..operators import bags, graph, order, records, samples, vectors
from ..sources.readers import spread, table, union_buckets
from ..sources.sinks import compact_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def epoch(ts: str):
    """Seconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def quoted(words) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


SQL_TERMS = f"""list_filter(flatten(list_transform(regexp_extract_all(regexp_replace(coalesce({{}},''),'([a-z0-9])([A-Z])','\\1 \\2','g'),'[A-Za-z][A-Za-z0-9_./+-]{{{{2,}}}}'), lambda w: string_split_regex(lower(w),'[._/+-]+'))), lambda p: length(p) >= 3 and not regexp_full_match(p,'[0-9]+') and not list_contains({quoted(T.STOPWORDS)}, p))"""


def sql_bag(name: str, source: str, id_col: str, text: str, most: int = 0) -> str:
    found = SQL_TERMS.format(text)
    if most:
        found = f"list_slice({found},1,{most})"
    return f"{name} AS (SELECT id, term, count(*) AS tf FROM (SELECT {id_col} AS id, unnest({found}) AS term FROM {source}) GROUP BY id, term)"


def sql_idf(name: str, bag: str, n: str) -> str:
    return f"{name} AS (SELECT term, count(*) AS df, ln((1.0 + ({n})) / (1.0 + count(*))) + 1.0 AS idf FROM {bag} GROUP BY term)"


def sql_overlap(name: str, q: str, d: str, idf: str, lexical: float = 0.65, precision: float = 0.25, bonus: float = 0.02, most: float = 0.10) -> str:
    return f"""{name}_qw AS (SELECT q.id AS query, q.term, q.tf * coalesce(w.idf, 1.0) AS w FROM {q} q LEFT JOIN {idf} w USING (term)),
{name}_qt AS (SELECT query, sum(w) AS t FROM {name}_qw GROUP BY query),
{name}_dt AS (SELECT d.id, sum(d.tf * coalesce(w.idf, 1.0)) AS t FROM {d} d LEFT JOIN {idf} w USING (term) GROUP BY d.id),
{name}_h AS (SELECT query, d.id, sum(w) AS o, count(*) AS shared FROM {name}_qw JOIN {d} d USING (term) GROUP BY query, d.id),
{name} AS (SELECT h.query, h.id, {lexical} * h.o / qt.t + {precision} * h.o / dt.t + least({most}, {bonus} * h.shared) AS score, h.shared FROM {name}_h h JOIN {name}_qt qt ON qt.query = h.query JOIN {name}_dt dt ON dt.id = h.id)"""


# Records


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versions of papers in two buckets: neighbours by id are versions of one paper."""
    docs = table(spark, sf_dir, "documents")
    row = docs.select(
        (F.col("doc_id") - F.col("doc_id") % 2).cast("string").alias("canonical_id"), F.col("doc_id").cast("string").alias("paper_id"), "doc_id",
        F.when(F.col("doc_id") % 7 == 0, True).when(F.col("doc_id") % 7 < 5, False).alias("partial"),
        F.get(F.array(*[F.lit(s) for s in records.SOURCE_RANK]), (F.col("doc_id") % 5).cast("int")).alias("text_source"),
        F.concat(F.lit("v"), F.col("doc_id") % 3 + 1).alias("version"), "n_chars", F.floor(F.col("n_chars") / 1800).alias("n_pages"), "lang",
    )
    base = F.col("doc_id") % 3 == 0
    return union_buckets({"base": row.where(base), "backfill": row.where(~base)})


SQL_WINNERS = """v AS (SELECT (doc_id - doc_id % 2)::VARCHAR AS canonical_id, doc_id::VARCHAR AS paper_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 7 < 5 THEN false END AS partial,
 CASE doc_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS priority, doc_id % 3 + 1 AS version, n_chars, floor(n_chars / 1800) AS n_pages, lang, CASE WHEN doc_id % 3 = 0 THEN 'base' ELSE 'backfill' END AS bucket FROM documents),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY coalesce(partial, false) ASC, priority DESC, version DESC, coalesce(n_chars, 0) DESC, coalesce(n_pages, 0) DESC, paper_id DESC, bucket ASC) = 1)"""


@query(f"WITH {SQL_WINNERS} SELECT w.canonical_id, w.paper_id, w.bucket, w.priority::INTEGER AS priority, w.n_chars, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, l.doc_id IS NOT NULL AS metadata_found FROM w LEFT JOIN labels l USING (doc_id)")
def dedup_winner(spark, sf_dir):
    won = records.winners(versions(spark, sf_dir)).alias("w")
    labels = table(spark, sf_dir, "labels").alias("l")
    joined = won.join(labels, F.col("w.doc_id") == F.col("l.doc_id"), "left")
    return joined.select("canonical_id", "paper_id", "bucket", records.source_priority(F.col("text_source")).alias("priority"), "n_chars", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.col("l.doc_id").isNotNull().alias("metadata_found"))


@query("SELECT sha1(text) AS content_sha1, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_exact_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha1("text").alias("content_sha1")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source, lang, md5(substr(text, 1, 256)) AS head_md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2, 3")
def dedup_prefix_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", "lang", F.md5(F.substring("text", 1, 256)).alias("head_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT c_custkey, c_name, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_date, round(o_totalprice, 6) AS o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("o"))
    joined = table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("c_custkey", "c_name", "o.o_orderkey", F.date_format("o.o_orderdate", "yyyy-MM-dd").alias("o_date"), r6("o.o_totalprice").alias("o_totalprice"))


@query(f"WITH {SQL_WINNERS} SELECT row_number() OVER (ORDER BY CASE WHEN bucket = 'base' THEN 0 ELSE 1 END, paper_id, canonical_id) AS position, canonical_id, paper_id, bucket FROM w QUALIFY position <= 100")
def target_cap_order(spark, sf_dir):
    keys = [F.when(F.col("bucket") == "base", 0).otherwise(1), F.col("paper_id"), F.col("canonical_id")]
    from pyspark.sql import Window

    capped = records.winners(versions(spark, sf_dir)).orderBy(*keys).limit(100)
    return capped.select(F.row_number().over(Window.orderBy(*keys)).cast("long").alias("position"), "canonical_id", "paper_id", "bucket")


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_covered(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT 'order' AS relation, l_orderkey AS missing_key, count(*) AS n_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 2
UNION ALL SELECT 'part', l_partkey, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY 2
UNION ALL SELECT 'supplier', l_suppkey, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 2
UNION ALL SELECT 'customer', o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 2""")
def fk_violations(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    checks = [
        (items, "l_orderkey", orders.where("o_orderstatus <> 'P'"), "o_orderkey", "order"),
        (items, "l_partkey", table(spark, sf_dir, "part").where("p_size <= 45"), "p_partkey", "part"),
        (items, "l_suppkey", table(spark, sf_dir, "supplier").where("s_acctbal >= 0"), "s_suppkey", "supplier"),
        (orders, "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal >= 0"), "c_custkey", "customer"),
    ]
    first, *rest = (records.missing_references(*c) for c in checks)
    for one in rest:
        first = first.unionByName(one)
    return first


@query("""WITH u AS (SELECT user_id, value, event_type = 'error' AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT coalesce(c.c_custkey, u.user_id) AS id, round(CASE WHEN u.user_id IS NULL THEN c.c_acctbal WHEN NOT u.deleted THEN u.value END, 6) AS value,
CASE WHEN u.user_id IS NULL THEN 'kept' WHEN u.deleted THEN 'dropped' WHEN c.c_custkey IS NULL THEN 'appended' ELSE 'updated' END AS status
FROM customer c FULL JOIN u ON c.c_custkey = u.user_id WHERE NOT (c.c_custkey IS NULL AND u.deleted)""")
def upsert_tombstone(spark, sf_dir):
    last = records.last_write(table(spark, sf_dir, "events"), "user_id", "event_id", "value", "event_type")
    changes = last.select(F.col("user_id").alias("id"), "value", (F.col("event_type") == "error").alias("deleted"))
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return records.upsert(base, changes, "id", "value").withColumn("value", r6("value"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS s FROM orders WHERE o_orderkey % 10 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS s FROM orders WHERE o_orderkey % 10 <> 1)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.s <> n.s""")
def change_detect(spark, sf_dir):
    """Two states of the orders: a tenth is new, a tenth is gone, a tenth has another price."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    old = orders.where("id % 10 <> 0")
    new = orders.where("id % 10 <> 1").withColumn("price", F.when(F.col("id") % 10 == 2, F.col("price") + 1).otherwise(F.col("price")))
    return records.changes(old, new, "id", "price")


@query("""SELECT d.doc_id, coalesce(nullif(trim(CASE l.quality WHEN 1 THEN ' good ' WHEN 0 THEN '  ' END), ''), d.source) AS category, trim(regexp_replace(split_part(d.text, chr(10), 1), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS title, coalesce(l.toxic, -1) AS toxic, l.doc_id IS NOT NULL AS metadata_found FROM documents d LEFT JOIN labels l USING (doc_id)""")
def meta_enrich_overlay(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").alias("l")
    name = F.when(F.col("l.quality") == 1, " good ").when(F.col("l.quality") == 0, "  ")
    joined = docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    title = T.collapse(F.get(T.lines(F.col("d.text")), F.lit(0)))
    return joined.select("d.doc_id", records.overlay(F.col("d.source"), name).alias("category"), title.alias("title"), F.coalesce("l.toxic", F.lit(-1)).alias("toxic"), F.col("l.doc_id").isNotNull().alias("metadata_found"))


# Vectors

SQL_CENTROIDS = "c AS (SELECT label, dim, count(*) AS n, avg(x) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY label, dim)"


@query(f"WITH {SQL_CENTROIDS} SELECT label, dim::INTEGER AS dim, n, round(value, 6) AS value FROM c")
def category_centroid_counts(spark, sf_dir):
    return vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "dim", "n", r6("value").alias("value"))


@query(f"WITH {SQL_CENTROIDS}, v AS (SELECT label, list(value ORDER BY dim) AS v FROM c GROUP BY label) SELECT a.label AS src, b.label AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.label <> b.label QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.label) <= 3")
def category_knn(spark, sf_dir):
    cents = vectors.assemble(vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding"), "label")
    found = vectors.exact_neighbours(cents.withColumn("id", F.col("label").cast("long")), "id", "vector", F.lit(True), 3, 4)
    return found.select(F.col("query").cast("int").alias("src"), F.col("id").cast("int").alias("dst"), r6("score").alias("score"))


@query("SELECT a.vec_id AS query, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id)::INTEGER AS rank, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10")
def vector_knn_exact(spark, sf_dir):
    """Each fiftieth vector against all, in blocks."""
    found = vectors.exact_neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 10)
    return found.select("query", "id", "rank", r6("score").alias("score"))


@query("WITH u AS (SELECT label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT label, dim::INTEGER AS dim, count(*) AS n, round(avg(x / nrm), 6) AS value FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim, n AS nrm FROM u) GROUP BY label, dim")
def mean_pool_vectors(spark, sf_dir):
    return vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding", unit=True).select("label", "dim", "n", r6("value").alias("value"))


@query()
def pca_projection(spark, sf_dir):
    out = vectors.principal_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", *[r6(f"pc{i}").alias(f"pc{i}") for i in (1, 2, 3)])


# Terms and retrieval

SQL_DOCS = sql_bag("d", "documents", "doc_id", "text")
SQL_DOC_IDF = sql_idf("w", "d", "SELECT count(*) FROM documents")
SQL_BENCH = sql_bag("q", "benchmark", "item_id", "text", 96)


def document_bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bags of whole documents and their idf, written once for all joins on them."""
    docs = table(spark, sf_dir, "documents")
    bag = order.written(bags.bags(docs, "doc_id", "text"), "bags")
    return bag, order.written(bags.idf(bag, docs.count()), "idf")


def benchmark_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.bags(table(spark, sf_dir, "benchmark"), "item_id", "text", 96)


@query(f"WITH {SQL_DOCS}, {SQL_DOC_IDF} SELECT term, df, round(idf, 6) AS idf FROM w")
def term_df_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bags.idf(bags.bags(docs, "doc_id", "text"), docs.count()).select("term", "df", r6("idf").alias("idf"))


@query(f"WITH {SQL_DOCS}, {SQL_DOC_IDF}, {SQL_BENCH}, {sql_overlap('s', 'q', 'd', 'w')} SELECT query AS item_id, id AS doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)::INTEGER AS rank, round(score, 6) AS score, shared FROM s QUALIFY rank <= 5")
def bag_overlap_search(spark, sf_dir):
    bag, weights = document_bags(spark, sf_dir)
    top = bags.ranked(bags.overlap_scores(benchmark_bags(spark, sf_dir), bag, weights), 5)
    return top.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "rank", r6("score").alias("score"), "shared")


@query(f"WITH {SQL_DOCS}, {SQL_DOC_IDF}, {SQL_BENCH}, s AS (SELECT q.id AS query, d.id, sum(d.tf * w.idf) AS score FROM (SELECT DISTINCT id, term FROM q) q JOIN w USING (term) JOIN d USING (term) GROUP BY q.id, d.id) SELECT query AS item_id, id AS doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)::INTEGER AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 5")
def tfidf_search(spark, sf_dir):
    bag, weights = document_bags(spark, sf_dir)
    top = bags.ranked(bags.tfidf_scores(benchmark_bags(spark, sf_dir), bag, weights), 5)
    return top.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "rank", r6("score").alias("score"))


@query(f"WITH {SQL_DOCS}, {SQL_DOC_IDF}, {SQL_BENCH}, s AS (SELECT q.id AS query, d.id, sum(q.tf * w.idf) AS score, count(*) AS shared FROM q JOIN w USING (term) JOIN d USING (term) WHERE w.df <= 50 GROUP BY q.id, d.id HAVING count(*) >= 2) SELECT query AS item_id, id AS doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)::INTEGER AS rank, round(score, 6) AS score, shared FROM s QUALIFY rank <= 10")
def inverted_candidates(spark, sf_dir):
    bag, weights = document_bags(spark, sf_dir)
    top = bags.ranked(bags.candidates(benchmark_bags(spark, sf_dir), bag, weights, 50, 2), 10)
    return top.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "rank", r6("score").alias("score"), "shared")


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text a conversation, its turns in order."""
    turns = table(spark, sf_dir, "conversations")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n")
    return turns.groupBy("conv_id").agg(joined.alias("text"))


#: In SQL a part's number is its document's number times this, plus its place; no text is as long.
PART_BASE = 1 << 32

SQL_FUSION = f"""WITH {SQL_DOCS}, {SQL_DOC_IDF}, {SQL_BENCH}, conv AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), n AS (SELECT count(*) AS n FROM conv),
{sql_bag('r', 'conv', 'conv_id', 'text')}, {sql_idf('rw', 'r', 'SELECT n FROM n')}, {sql_overlap('rs', 'q', 'r', 'rw')}, {sql_overlap('ds', 'q', 'd', 'w')},
rt AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) <= 10),
dt AS (SELECT query, id, id % (SELECT n FROM n) AS repo, score FROM ds QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) <= 10),
repos AS (SELECT query, id AS repo FROM rt UNION SELECT query, repo FROM dt),
p AS (SELECT doc_id * {PART_BASE} + i AS id, part FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE doc_id IN (SELECT id FROM dt)),
{sql_bag('pb', 'p', 'id', 'part')}, {sql_overlap('ps', 'q', 'pb', 'w')},
pt AS (SELECT ps.query, ps.id, dt.repo, 0.75 * ps.score + 0.25 * dt.score AS score FROM ps JOIN dt ON dt.query = ps.query AND dt.id = ps.id // {PART_BASE} QUALIFY row_number() OVER (PARTITION BY ps.query ORDER BY round(0.75 * ps.score + 0.25 * dt.score, 9) DESC, ps.id) <= 12),
f AS (SELECT query, repo, sum(s) AS score, count(*) AS hits FROM (SELECT query, id AS repo, score AS s FROM rt UNION ALL SELECT query, repo, 0.9 * score FROM dt UNION ALL SELECT query, repo, 0.6 * score FROM pt) GROUP BY query, repo)
SELECT query AS item_id, repo AS conv_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, repo)::INTEGER AS rank, round(score, 6) AS score, hits FROM f QUALIFY rank <= 5"""


def part_of(doc, at):
    """The id of a document's part: both numbers, so that no length of text runs into the next document; null for a null doc."""
    return F.when(F.col(doc).isNotNull(), F.struct(F.col(doc).alias("doc"), F.col(at).cast("long").alias("at")))


@query(SQL_FUSION)
def three_lane_fusion(spark, sf_dir):
    """Conversations, documents and their paragraphs as three lanes; documents belong to conversations by id."""
    ask = order.written(benchmark_bags(spark, sf_dir), "queries")
    convs = conversation_texts(spark, sf_dir)
    n = convs.count()
    conv_bag = order.written(bags.bags(convs, "conv_id", "text"), "conv-bags")
    bag, weights = document_bags(spark, sf_dir)
    repos = bags.ranked(bags.overlap_scores(ask, conv_bag, bags.idf(conv_bag, n)), 10).select("query", F.col("id").alias("repo"), "score")
    papers = order.written(bags.ranked(bags.overlap_scores(ask, bag, weights), 10).select("query", "id", (F.col("id") % n).alias("repo"), "score"), "papers")
    parts = table(spark, sf_dir, "documents").join(papers.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "part"))
    spans = bags.bags(parts.select(part_of("doc_id", "i").alias("id"), "part"), "id", "part")
    found = bags.overlap_scores(ask, spans, weights).withColumn("paper", F.col("id.doc"))
    hint = papers.select("query", F.col("id").alias("paper"), "repo", F.col("score").alias("hint"))
    bridged = found.join(hint, ["query", "paper"]).select("query", "id", "repo", (0.75 * F.col("score") + 0.25 * F.col("hint")).alias("score"))
    bridge = bags.ranked(bridged, 12).select("query", "repo", (0.6 * F.col("score")).alias("score"))
    lanes = repos.unionByName(papers.select("query", "repo", (0.9 * F.col("score")).alias("score"))).unionByName(bridge)
    fused = lanes.groupBy("query", F.col("repo").alias("id")).agg(F.sum("score").alias("score"), F.count("*").alias("hits"))
    return bags.ranked(fused, 5).select(F.col("query").alias("item_id"), F.col("id").alias("conv_id"), "rank", r6("score").alias("score"), "hits")


@query("""WITH m AS (SELECT min(floor(epoch(ts))::BIGINT) AS a, max(floor(epoch(ts))::BIGINT) AS b FROM events), s AS (SELECT user_id, event_id,
(0.6 * (abs(value) / (1 + abs(value))) + 0.3 * (CASE WHEN event_type IN ('purchase', 'view') THEN 0.5 ELSE 0 END) + 0.1 * coalesce((floor(epoch(ts))::BIGINT - m.a) / nullif(m.b - m.a, 0)::DOUBLE, 0)) * (CASE WHEN event_type = 'purchase' THEN 1.2 WHEN event_type = 'error' THEN 1.05 ELSE 1.0 END) AS score FROM events, m)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, event_id)::INTEGER AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 5""")
def hybrid_episodic(spark, sf_dir):
    """Each user's events by bounded norm, overlap of their type with two query words, and recency, times a weight of the type."""
    events = table(spark, sf_dir, "events").withColumn("t", epoch("ts"))
    a, b = events.agg(F.min("t"), F.max("t")).first()
    e = events.select("*", F.lit(a).alias("a"), F.lit(b).alias("b"))
    overlap = T.jaccard(F.array("event_type"), F.array(F.lit("purchase"), F.lit("view")))
    recency = F.coalesce(F.try_divide(F.col("t") - F.col("a"), (F.col("b") - F.col("a")).cast("double")), F.lit(0.0))
    weight = F.when(F.col("event_type") == "purchase", 1.2).when(F.col("event_type") == "error", 1.05).otherwise(1.0)
    size = F.abs("value")
    scored = e.select(F.col("user_id").alias("query"), F.col("event_id").alias("id"), ((0.6 * size / (1 + size) + 0.3 * overlap + 0.1 * recency) * weight).alias("score"))
    return bags.ranked(scored, 5).select(F.col("query").alias("user_id"), F.col("id").alias("event_id"), "rank", r6("score").alias("score"))


@query("""WITH m AS (SELECT user_id, min(floor(epoch(ts))::BIGINT) AS a, max(floor(epoch(ts))::BIGINT) AS b FROM events GROUP BY user_id) SELECT event_id, round(coalesce((floor(epoch(ts))::BIGINT - a) / nullif(b - a, 0)::DOUBLE, 0), 6) AS recency FROM events JOIN m USING (user_id)""")
def recency_score(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", epoch("ts").alias("t"))
    span = events.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    recency = F.coalesce(F.try_divide(F.col("t") - F.col("a"), (F.col("b") - F.col("a")).cast("double")), F.lit(0.0))
    return events.join(span, "user_id").select("event_id", r6(recency).alias("recency"))


def topic_words(text):
    found = F.transform(F.regexp_extract_all(T.empty(text), F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), F.lower)
    return F.filter(found, lambda w: ~w.isin(*T.TOPIC_STOPWORDS))


def pairs(words):
    """Neighbouring words, joined by a blank."""
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))).otherwise(F.array().cast("array<string>"))


SQL_TOPIC = f"list_filter(list_transform(regexp_extract_all({{}},'[A-Za-z][A-Za-z0-9_-]{{{{2,}}}}'), lambda w: lower(w)), lambda w: not list_contains({quoted(T.TOPIC_STOPWORDS)}, w))"


@query(f"""WITH t AS (SELECT doc_id, {SQL_TOPIC.format("split_part(text, chr(10), 1)")} AS a, {SQL_TOPIC.format("text")} AS b FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(a)) AS term, CASE WHEN true THEN 3 END AS w, 'a' AS k FROM t UNION ALL SELECT doc_id, unnest(list_distinct(list_slice(b,1,128))), 1, 'b' FROM t),
u AS (SELECT doc_id, term, CASE WHEN bool_or(k = 'b') THEN 1 ELSE 0 END + CASE WHEN bool_or(k = 'a') THEN 3 ELSE 0 END AS w FROM s GROUP BY doc_id, term),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i+1])) AS term, 4 AS w FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(list_slice(b,1,64))), lambda i: b[i] || ' ' || b[i+1])), 1 FROM t),
c AS (SELECT doc_id, term, sum(w) AS score FROM (SELECT * FROM u UNION ALL SELECT * FROM g) GROUP BY doc_id, term)
SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(term) DESC, term)::INTEGER AS rank, score::BIGINT AS score FROM c QUALIFY rank <= 5""")
def topic_terms(spark, sf_dir):
    """Five topics a document: words of the first line weigh 3, of the text's first 128 one, word pairs 4 and 1."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", topic_words(F.get(T.lines(F.col("text")), F.lit(0))).alias("a"), topic_words(F.col("text")).alias("b"))

    def part(words, weight):
        return docs.select("doc_id", F.explode(words).alias("term"), F.lit(weight).alias("w"))

    every = part(F.array_distinct("a"), 3).unionByName(part(F.array_distinct(F.slice("b", 1, 128)), 1)).unionByName(part(pairs(F.col("a")), 4)).unionByName(part(pairs(F.slice("b", 1, 64)), 1))
    scored = every.groupBy("doc_id", "term").agg(F.sum("w").alias("score"))
    return order.top_per_key(scored, ["doc_id"], 5, F.desc("score"), F.length("term").desc(), F.col("term").asc())


@query()
def keyword_diverse(spark, sf_dir):
    """Up to 8 keywords a document, the best first, none sharing a word with one before."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.filter(topic_words(F.col("text")), lambda w: F.length(w) >= 4).alias("b"))
    one = docs.select("doc_id", F.explode("b").alias("term"), F.lit(1.0).alias("w"))
    two = docs.select("doc_id", F.explode(pairs(F.col("b"))).alias("term"), F.lit(1.35).alias("w")).where("split(term, ' ')[0] <> split(term, ' ')[1]")
    best = order.top_per_key(one.unionByName(two).groupBy("doc_id", "term").agg(F.sum("w").alias("score")), ["doc_id"], 32, F.round("score", 9).desc(), F.col("term").asc())
    listed = best.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("terms"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"))

    def step(state, term):
        parts = F.split(term, " ")
        skip = F.arrays_overlap(state["seen"], parts) | (F.size(state["kept"]) >= 8)
        return F.when(skip, state).otherwise(F.struct(F.concat(state["kept"], F.array(term)).alias("kept"), F.concat(state["seen"], parts).alias("seen")))

    return listed.select("doc_id", F.array_join(F.aggregate("terms", start, step)["kept"], ", ").alias("keywords"))


# Chunks, pairs and lines

SQL_CHUNKS = "c AS (SELECT doc_id, o AS start, substr(text, o + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS o FROM documents WHERE length(text) > 0))"


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(T.chunks(F.col("text"), 1000, 200)).alias("c")).select("doc_id", F.col("c.offset").alias("start"), F.col("c.chunk").alias("chunk"))


@query(f"WITH {SQL_CHUNKS} SELECT doc_id, start::INTEGER AS start, length(chunk)::INTEGER AS n_chars, md5(chunk) AS chunk_md5 FROM c")
def chunk_text(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("doc_id", "start", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query(f"WITH {SQL_CHUNKS}, n AS (SELECT doc_id, start, md5(chunk) AS chunk_md5, lead(md5(chunk)) OVER (PARTITION BY doc_id ORDER BY start) AS next_md5 FROM c) SELECT doc_id, start::INTEGER AS start, chunk_md5, next_md5 FROM n WHERE next_md5 IS NOT NULL")
def next_chunk_pairs(spark, sf_dir):
    """A chunk and the one after it; pairs are made inside each row, so nothing is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.chunks(F.col("text"), 1000, 200).alias("c"))
    made = docs.where(F.size("c") > 1).select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get("c", i - 1).alias("a"), F.get("c", i).alias("b")))).alias("p"))
    return made.select("doc_id", F.col("p.a.offset").alias("start"), F.md5("p.a.chunk").alias("chunk_md5"), F.md5("p.b.chunk").alias("next_md5"))


@query("""WITH o AS (SELECT doc_id, md5(text) AS h, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT a.doc_id, CASE WHEN b.h <> a.h THEN b.doc_id ELSE c.doc_id END AS negative_id FROM o a JOIN o b ON b.i = (a.i + 1) % a.n JOIN o c ON c.i = (a.i + 2) % a.n""")
def circular_negatives(spark, sf_dir):
    """The next document in a circle as a negative, the one after it where the next has the same text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    placed = order.written(order.with_position(docs, "doc_id", name="i"), "placed")
    n = max(placed.count(), 1)
    a, b, c = (placed.select(F.col("doc_id").alias(f"{x}_id"), F.col("h").alias(f"{x}_h"), F.pmod(F.col("i") - k, F.lit(n)).alias("i")) for x, k in (("a", 0), ("b", 1), ("c", 2)))
    return a.join(b, "i").join(c, "i").select(F.col("a_id").alias("doc_id"), F.when(F.col("b_h") != F.col("a_h"), F.col("b_id")).otherwise(F.col("c_id")).alias("negative_id"))


@query("""WITH o AS (SELECT doc_id, md5(text) AS h, lag(doc_id) OVER (ORDER BY doc_id) AS p, lag(md5(text)) OVER (ORDER BY doc_id) AS ph FROM documents WHERE length(text) >= 200) SELECT doc_id, p AS negative_id FROM o WHERE p IS NOT NULL AND ph <> h""")
def previous_negatives(spark, sf_dir):
    """The accepted document before as a negative, if its text differs."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 200).select("doc_id", F.md5("text").alias("h"))
    placed = order.with_position(docs, "doc_id", name="i")
    placed = order.written(placed, "placed")
    prior = placed.select((F.col("i") + 1).alias("i"), F.col("doc_id").alias("negative_id"), F.col("h").alias("ph"))
    return placed.join(prior, "i").where("h <> ph").select("doc_id", "negative_id")


SQL_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({}, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
SQL_WORDSET = "list_distinct(list_filter(string_split_regex(lower({}), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''))"


@query(f"""WITH a AS (SELECT conv_id, turn, {SQL_SENTENCES.format('text')} AS s FROM conversations),
q AS (SELECT conv_id, turn, i, q, {SQL_WORDSET.format('q')} AS w FROM (SELECT conv_id, turn, unnest(list_slice(s,1,3)) AS q, generate_subscripts(list_slice(s,1,3),1) - 1 AS i FROM a)),
b AS (SELECT conv_id, turn, i, b, {SQL_WORDSET.format('b')} AS w FROM (SELECT conv_id, turn, unnest(list_slice(s,1,16)) AS b, generate_subscripts(list_slice(s,1,16),1) - 1 AS i FROM a)),
j AS (SELECT q.conv_id, q.turn, q.i AS q_no, b.i AS b_no, len(list_intersect(q.w, b.w)) / greatest(1, least(len(q.w), len(b.w)))::DOUBLE AS score, abs(length(q.q) - length(b.b)) AS gap FROM q JOIN b ON b.conv_id = q.conv_id AND b.turn = q.turn + 1)
SELECT conv_id, turn, q_no::INTEGER AS q_no, b_no::INTEGER AS b_no, round(score, 6) AS score FROM j QUALIFY row_number() OVER (PARTITION BY conv_id, turn, q_no ORDER BY round(score, 9) DESC, gap, b_no) = 1""")
def sentence_best_match(spark, sf_dir):
    """For up to three sentences of a turn the sentence of the next turn that shares most words."""
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", T.sentences(F.col("text")).alias("s"))

    def side(first, k, shift):
        out = turns.select("conv_id", (F.col("turn") - shift).alias("turn"), F.posexplode(F.slice("s", 1, k)).alias(f"{first}_no", first))
        return out.withColumn(f"{first}w", F.array_distinct(T.words(F.col(first))))

    j = side("q", 3, 0).join(side("b", 16, 1), ["conv_id", "turn"])
    score = F.size(F.array_intersect("qw", "bw")) / F.greatest(F.lit(1), F.least(F.size("qw"), F.size("bw")))
    j = j.select("conv_id", "turn", "q_no", "b_no", score.alias("score"), F.abs(F.length("q") - F.length("b")).alias("gap"))
    best = j.groupBy("conv_id", "turn", "q_no").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "gap", "b_no", "score")).alias("m"))
    return best.select("conv_id", "turn", "q_no", F.col("m.b_no").alias("b_no"), r6("m.score").alias("score"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def consecutive_dedup(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("p", F.lag("event_type").over(w)).where("p is null or p <> event_type").select("event_id", "user_id", "event_type")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
s AS (SELECT *, trim(regexp_replace(line, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM l),
c AS (SELECT *, length(t) - length(regexp_replace(t, '\\p{L}', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g')) AS upper FROM s),
h AS (SELECT *, CASE WHEN NOT (length(t) > 120 OR letters < 3 OR regexp_matches(t, '[-=]{2,}|\\\\|/|[∑∫√≤≥≠≈±]') OR regexp_matches(t, '\\b[A-Za-z]\\s*[=<>]\\s*[-+0-9A-Za-z]') OR length(t) - length(replace(t, '-', '')) >= 3)
 AND (list_contains(['abstract','introduction','references','acknowledgements','acknowledgments','appendix','conclusion','conclusions','discussion','results','method','methods','related work','experiments'], rtrim(lower(t), '.:')) OR regexp_matches(t, '^[0-9]+(\\.[0-9]+)*\\s+[A-Z]') OR regexp_matches(t, '^(Appendix|Section)\\b') OR (upper > 0.72 * letters AND len(string_split(t, ' ')) <= 8)) THEN 1 ELSE 0 END AS head FROM c),
g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM h)
SELECT doc_id, block::BIGINT AS block, count(*) AS n_lines, sum(length(t))::BIGINT AS n_chars, max(head)::INTEGER AS headed FROM g GROUP BY doc_id, block""")
def sessionised_blocks(spark, sf_dir):
    """Lines in blocks that each heading starts."""
    from pyspark.sql import Window

    lines = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "line"))
    marked = lines.select("doc_id", "i", F.length(T.collapse(F.col("line"))).alias("n"), T.heading(F.col("line")).cast("int").alias("head"))
    block = F.sum("head").over(Window.partitionBy("doc_id").orderBy("i"))
    return marked.withColumn("block", block).groupBy("doc_id", "block").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_chars"), F.max("head").alias("headed"))


@query("""WITH o AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT *, CASE WHEN n <= 10 THEN n ELSE n // least(4, n // 10) END AS size FROM o)
SELECT user_id, ((rn - 1) // size)::BIGINT AS window_no, count(*) AS n, min(t) AS t_min, max(t) AS t_max FROM s GROUP BY 1, 2""")
def count_windows(spark, sf_dir):
    """Each user's events in up to four windows of equal count, ten at least; a remainder is a window more."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", epoch("ts").alias("t"), F.row_number().over(w.orderBy("ts", "event_id")).alias("rn"), F.count("*").over(w).alias("n"))
    size = F.when(F.col("n") <= 10, F.col("n")).otherwise(F.floor(F.col("n") / F.least(F.lit(4), F.floor(F.col("n") / 10))))
    return e.groupBy("user_id", F.floor((F.col("rn") - 1) / size).alias("window_no")).agg(F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


# Text cleaning and predicates


@query("""WITH s AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '\\b\\d{4}[- ]?\\d{4}[- ]?\\d{4}[- ]?\\d{4}\\b', '<CARD>', 'g'), '\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b', '<IP>', 'g') AS t FROM documents) SELECT doc_id, t <> text AS changed, md5(t) AS text_md5 FROM s""")
def pii_scrub(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", T.scrub_pii(F.col("text")).alias("t"))
    return docs.select("doc_id", (F.col("t") != F.col("text")).alias("changed"), F.md5("t").alias("text_md5"))


def sql_domains() -> str:
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{k}{chr(39)})' for k in ks)} THEN '{d}' END" for d, ks in T.DOMAINS.items())
    return f"SELECT doc_id, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS domains FROM (SELECT doc_id, lower(text) AS t FROM documents)"


@query(sql_domains())
def domain_tags(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.array_join(T.domains(F.col("text")), ",").alias("domains"))


@query("""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM pages) SELECT page_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM t""")
def markup_clean(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages")).select("page_id", T.markup_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


@query("""WITH o AS (SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate) END AS y FROM orders) SELECT status, count(*) AS n, count(*) FILTER (WHERE y IS NULL OR y BETWEEN 1994 AND 1996) AS lenient, count(*) FILTER (WHERE y BETWEEN 1994 AND 1996) AS strict FROM o GROUP BY status""")
def year_filter_variants(spark, sf_dir):
    """A window of years that unknown years pass, and one that they don't."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 11 != 0, F.year("o_orderdate")).alias("y"))
    return o.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("y").isNull() | F.col("y").between(1994, 1996)).alias("lenient"), F.count_if(F.col("y").between(1994, 1996)).alias("strict"))


@query("""SELECT p_brand, count(*) FILTER (WHERE len(list_filter(string_split(p_type, ' '), lambda t: starts_with(t, 'ST') OR starts_with(t, 'BR'))) > 0) AS by_token, count(*) FILTER (WHERE contains(p_type, 'ST') OR contains(p_type, 'BR')) AS by_substring FROM part GROUP BY p_brand""")
def prefix_predicate(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    token = F.exists(F.split("p_type", " "), lambda t: t.startswith("ST") | t.startswith("BR"))
    loose = F.col("p_type").contains("ST") | F.col("p_type").contains("BR")
    return part.groupBy("p_brand").agg(F.count_if(token).alias("by_token"), F.count_if(loose).alias("by_substring"))


@query("""SELECT doc_id, source, row_number() OVER (ORDER BY doc_id)::INTEGER AS position FROM documents WHERE contains(lower(source || ' ' || text), 'license') OR contains(lower(source || ' ' || text), 'copyright') QUALIFY position <= 50""")
def keyword_search(spark, sf_dir):
    """The first 50 documents in order that hold a keyword in any of two fields."""
    from pyspark.sql import Window

    low = F.lower(F.concat_ws(" ", "source", "text"))
    hits = table(spark, sf_dir, "documents").where(low.contains("license") | low.contains("copyright")).select("doc_id", "source").orderBy("doc_id").limit(50)
    return hits.withColumn("position", F.row_number().over(Window.orderBy("doc_id")))


# Graphs


@query("""WITH c AS (SELECT c_nationkey AS id, list_sort(list(DISTINCT c_mktsegment)) AS segs FROM customer GROUP BY c_nationkey),
n AS (SELECT n_nationkey AS id, n_regionkey AS root, list_distinct(string_split(lower(n_name), '')) AS tok, coalesce(segs, []) AS segs FROM nation LEFT JOIN c ON c.id = n_nationkey),
p AS (SELECT a.id AS src, b.id AS dst, 0.68 * coalesce(len(list_intersect(a.segs, b.segs)) / nullif(len(list_distinct(a.segs || b.segs)), 0)::DOUBLE, 0) + 0.16 * coalesce(len(list_intersect(a.tok, b.tok)) / nullif(len(list_distinct(a.tok || b.tok)), 0)::DOUBLE, 0) + 0.16 * CASE WHEN a.root = b.root THEN 1 ELSE 0 END AS score FROM n a JOIN n b ON a.id < b.id)
SELECT src, dst, round(score, 6) AS weight FROM p WHERE round(score, 9) >= 0.34""")
def similarity_edges(spark, sf_dir):
    """Pairs of nations by shared customer segments, letters and region. Candidates meet on a shared item, not in a cross join."""
    segs = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.collect_set("c_mktsegment").alias("segs"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("root"), F.array_distinct(F.split(F.lower("n_name"), "")).alias("tok"))
    n = order.written(nations.join(segs, "id", "left").withColumn("segs", F.coalesce("segs", F.array().cast("array<string>"))), "nations")
    item = n.select("id", F.explode(F.concat(F.transform("segs", lambda s: F.concat(F.lit("s"), s)), F.transform("tok", lambda t: F.concat(F.lit("t"), t)), F.array(F.concat(F.lit("r"), "root")))).alias("item"))
    met = item.select(F.col("id").alias("src"), "item").join(item.select(F.col("id").alias("dst"), "item"), "item").where("src < dst").select("src", "dst").distinct()
    a, b = (n.select(F.col("id").alias(k), F.col("root").alias(f"{k}_root"), F.col("tok").alias(f"{k}_tok"), F.col("segs").alias(f"{k}_segs")) for k in ("src", "dst"))
    j = met.join(a, "src").join(b, "dst")
    score = 0.68 * T.jaccard(F.col("src_segs"), F.col("dst_segs")) + 0.16 * T.jaccard(F.col("src_tok"), F.col("dst_tok")) + 0.16 * (F.col("src_root") == F.col("dst_root")).cast("int")
    return j.select("src", "dst", score.alias("s")).where(F.round("s", 9) >= 0.34).select("src", "dst", r6("s").alias("weight"))


@query("SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2")
def cooccurrence_edges(spark, sf_dir):
    """Parts that stand in one order; an order has at most seven."""
    return graph.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


SQL_BIP = "e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), h0 AS (SELECT min(dst) AS node FROM e), h1 AS (SELECT dst AS node, min(src) AS via FROM u WHERE src IN (SELECT node FROM h0) GROUP BY dst), h2 AS (SELECT u.dst AS node, min(h1.node) AS via FROM u JOIN h1 ON u.src = h1.node WHERE u.dst NOT IN (SELECT node FROM h0) GROUP BY u.dst)"


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


@query(f"WITH {SQL_BIP} SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def khop_subgraph(spark, sf_dir):
    """Nodes within two hops of the first part, in the graph of orders and parts."""
    edges = order_parts(spark, sf_dir)
    return graph.hops(edges, edges.agg(F.min("dst").alias("node")), 2).select("node", "hop")


@query(f"WITH {SQL_BIP} SELECT node, (SELECT node FROM h0) || '>' || node AS path, 1 AS hop FROM h1 UNION ALL SELECT node, (SELECT node FROM h0) || '>' || via || '>' || node, 2 FROM h2")
def shortest_path(spark, sf_dir):
    """The first shortest path from the first part to every node within two hops."""
    edges = order_parts(spark, sf_dir)
    return graph.hops(edges, edges.agg(F.min("dst").alias("node")), 2).where("hop > 0").select("node", F.array_join("path", ">").alias("path"), "hop")


@query("""WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
b AS (SELECT 's' || s_suppkey AS node, s_acctbal AS v FROM supplier UNION ALL SELECT 'p' || p_partkey, p_retailprice FROM part),
m1 AS (SELECT u.src AS node, avg(b.v) AS m FROM u JOIN b ON u.dst = b.node GROUP BY u.src), x1 AS (SELECT b.node, 0.15 * b.v + 0.85 * coalesce(m, 0) AS v FROM b LEFT JOIN m1 USING (node)),
m2 AS (SELECT u.src AS node, avg(x1.v) AS m FROM u JOIN x1 ON u.dst = x1.node GROUP BY u.src)
SELECT b.node, round(0.15 * b.v + 0.85 * coalesce(m, 0), 4) AS value FROM b LEFT JOIN m2 USING (node)""")
def damped_smoothing(spark, sf_dir):
    """Balances and prices of suppliers and parts, smoothed twice over the lines that join them."""
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    base = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_acctbal").alias("value"))
    base = base.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_retailprice").alias("value")))
    return graph.smoothed(edges, base).select("node", F.round("value", 4).alias("value"))


@query("""WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem), s AS (SELECT src, dst FROM e ORDER BY src, dst LIMIT 400), n AS (SELECT node FROM (SELECT src AS node FROM s UNION SELECT dst FROM s) ORDER BY node LIMIT 300) SELECT src, dst FROM s WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""")
def bounded_graph_view(spark, sf_dir):
    """The first 400 edges, closed over the first 300 of their nodes."""
    return graph.bounded_view(order_parts(spark, sf_dir), 400, 300)


@query("""SELECT o_orderkey, count(l_orderkey) AS n_lines, count(*) FILTER (WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY) AS covered, round(count(*) FILTER (WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY) / count(*)::DOUBLE, 6) AS coverage FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def range_join_coverage(spark, sf_dir):
    """The share of an order's lines that ship within its 60 days; joined by key, the range is a condition on the pair."""
    j = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    inside = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("interval 60 days"))
    return j.groupBy("o_orderkey").agg(F.count("*").alias("n_lines"), F.count_if(inside).alias("covered"), r6(F.count_if(inside) / F.count("*")).alias("coverage"))


@query(f"""WITH {SQL_BENCH}, k AS (SELECT doc_id * {PART_BASE} + o AS id, substr(text, o + 1, 1200) AS part FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS o FROM documents WHERE length(text) > 0)),
{sql_bag('d', 'k', 'id', 'part')}, {sql_idf('w', 'd', 'SELECT count(*) FROM k')}, {sql_overlap('s', 'q', 'd', 'w', 0.55, 0.23, 0.02, 0.12)},
t AS (SELECT query, id, score, shared, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM s WHERE shared >= 2 QUALIFY rank <= 3)
SELECT query AS item_id, id // {PART_BASE} AS doc_id, (id % {PART_BASE})::BIGINT AS start, CASE WHEN rank = 1 THEN 1 ELSE 0 END AS label, round(score, 6) AS score, shared FROM t WHERE query IN (SELECT query FROM t WHERE rank = 1 AND round(score, 9) >= 0.14)""")
def span_alignment(spark, sf_dir):
    """Each benchmark item's best chunk if it scores 0.14 or more, and its next two as hard negatives."""
    chunked = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunks(F.col("text"), 1200, 200)).alias("c")).select(part_of("doc_id", "c.offset").alias("id"), F.col("c.chunk").alias("part"))
    bag = order.written(bags.bags(chunked, "id", "part"), "spans")
    scores = bags.overlap_scores(benchmark_bags(spark, sf_dir), bag, bags.idf(bag, chunked.count()), 0.55, 0.23, 0.02, 0.12).where("shared >= 2")
    top = order.written(bags.ranked(scores, 3), "aligned")
    good = top.where((F.col("rank") == 1) & (F.round("score", 9) >= 0.14)).select("query")
    return top.join(good, "query", "left_semi").select(F.col("query").alias("item_id"), F.col("id.doc").alias("doc_id"), F.col("id.at").alias("start"), (F.col("rank") == 1).cast("int").alias("label"), r6("score").alias("score"), "shared")


@query("""WITH a AS (SELECT doc_id, source, coalesce(lang, '') AS lang, n_chars, row_number() OVER (PARTITION BY source, coalesce(lang, '') ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM a WHERE k <= 3)
SELECT doc_id, source, lang, n_chars FROM b WHERE r <= 8""")
def greedy_quota(spark, sf_dir):
    """Documents by length within each source, up to 3 a language and 8 a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")
    return samples.greedy_quota(docs, [("n_chars", False), ("doc_id", True)], "lang", 3, "source", 8)


# Samples and hashes


@query("""WITH c AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY source),
x AS (SELECT *, 200.0::DOUBLE * n / total AS exact FROM c), f AS (SELECT *, least(n, greatest(1, floor(exact))) AS fl FROM x), l AS (SELECT *, 200 - sum(fl) OVER () AS lft FROM f),
q AS (SELECT source, fl + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, source) <= lft AND fl < n THEN 1 ELSE 0 END AS quota FROM l)
SELECT doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id)::INTEGER AS rank FROM documents d JOIN q ON q.source = d.source QUALIFY row_number() OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id) <= quota""")
def stratified_sample(spark, sf_dir):
    return samples.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 200)


@query("SELECT doc_id, (('0x' || substr(sha1(doc_id::VARCHAR), 1, 16))::UBIGINT % 8)::INTEGER AS part FROM documents")
def hash_partition(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sha1_bucket(F.col("doc_id").cast("string"), 8).alias("part"))


@query("SELECT doc_id, round(('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::UBIGINT / 281474976710655.0::DOUBLE, 6) AS u, round(cos(2 * pi() * ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::UBIGINT / 281474976710655.0::DOUBLE) * log10(10 + n_chars), 5) AS x FROM documents")
def stable_hash_unit(spark, sf_dir):
    """A stable number a document, and a place on a circle made from it."""
    u = T.unit_interval(F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", r6(u).alias("u"), F.round(F.cos(2 * F.pi() * u) * F.log10(10 + F.col("n_chars")), 5).alias("x"))


@query("""SELECT event_type, '{"k":' || sum(json_extract(props, '$.k')::BIGINT)::VARCHAR || ',"n":' || count(*)::VARCHAR || '}' AS counts FROM events GROUP BY event_type""")
def token_type_json(spark, sf_dir):
    """Sums of the events' property maps, as JSON with sorted keys."""
    props = F.from_json("props", "map<string,bigint>")
    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.map_concat(props, F.create_map(F.lit("n"), F.lit(1).cast("bigint")))).alias("k", "v"))
    sums = e.groupBy("event_type", "k").agg(F.sum("v").alias("v"))
    return sums.groupBy("event_type").agg(compact_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("counts"))


@query("SELECT lang, toxic, count(*) AS n, sum(quality)::BIGINT AS hits, round(avg(quality), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang, toxic")
def accuracy_by_condition(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("quality").alias("hits"), r6(F.avg("quality")).alias("accuracy"))


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE n_chars < 500) AS short, count(*) FILTER (WHERE lang = 'en') AS english, count(DISTINCT lang) AS languages, count(*) FILTER (WHERE lang <> 'en' AND n_chars >= 500) AS other FROM documents GROUP BY source")
def conditional_counters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") < 500).alias("short"), F.count_if(F.col("lang") == "en").alias("english"), F.count_distinct("lang").alias("languages"), F.count_if((F.col("lang") != "en") & (F.col("n_chars") >= 500)).alias("other"))


# Streams, as an extension: the same functions run on a stream


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from ..streaming.incremental import windowed

    return windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, no""")
def event_sessions(spark, sf_dir):
    from ..streaming.incremental import sessions

    return sessions(table(spark, sf_dir, "events"))
