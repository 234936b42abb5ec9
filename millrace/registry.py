"""Every operator as a query over the driver's tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fields as fl
from millrace.functions import producers, recipes
from millrace.functions import text as T
from millrace.model import population, ranked, union
from millrace.operators import decontaminate as dc
from millrace.operators import dedupe as dd
from millrace.operators import mixing as mx
from millrace.operators import packing as pk
from millrace.operators import profiles as pf
from millrace.operators import sampling as sm
from millrace.operators import similarity as si
from millrace.operators import tokens as tk
from millrace.plans import query as q
from millrace.scratch import Scratch
from millrace.sources import readers, sinks
from millrace.sources.prepared import prepare
from millrace.sources.snapshots import Catalog, changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The population in SQL: documents with labels; lines and word n-grams with byte ranges; benchmark units with witnesses.
D = """d AS (SELECT d.doc_id, source AS corpus_id, CAST(d.doc_id AS VARCHAR) AS source_key, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS content,
  CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
B = "b AS (SELECT item_id AS doc_id, coalesce(text, '') AS text FROM benchmark)"


def _lines(name: str, of: str) -> str:
    return f"""{name}0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {of}),
{name} AS (SELECT doc_id, unit, CAST(e - strlen(unit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (SELECT *, sum(strlen(unit) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e FROM {name}0) WHERE unit <> '')"""


def _grams(name: str, of: str, n: int = 13) -> str:
    return f"""{name}0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+\\s*|\\s+')) AS seg, generate_subscripts(regexp_extract_all(text, '\\S+\\s*|\\s+'), 1) AS i FROM {of}),
{name}1 AS (SELECT doc_id, i, regexp_replace(seg, '\\s+$', '') AS w, sum(strlen(seg)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(seg) AS s FROM {name}0),
{name} AS (SELECT doc_id, array_to_string(ws, ' ') AS unit, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (SELECT doc_id, s, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS ws,
  lead(s + strlen(w), {n - 1}) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM {name}1 WHERE w <> '') WHERE len(ws) = {n})"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "labels")
    return population(read(spark, sf, "documents"), fields=("lang",)).join(labels, "doc_id", "left")


def bench(spark: SparkSession, sf: str) -> DataFrame:
    return population(read(spark, sf, "benchmark"), doc_id="item_id", corpus=F.lit("benchmark"))


QUALITY, TOXIC, LANG = fl.Field("quality", "integer"), fl.Field("toxic", "integer"), fl.Field("lang", "text")
CLASSES = ("north", "east", "south", "west")


def _where(spark, sf, *predicates: fl.Predicate) -> DataFrame:
    return q.Query(docs(spark, sf), tuple(map(q.where, predicates))).rows()


# Filters


@query(f"WITH {D} SELECT doc_id, n_bytes FROM d WHERE n_bytes >= 2000")
def where_bytes(spark, sf):
    return _where(spark, sf, fl.BYTES >= 2000).select("doc_id", "n_bytes")


@query(f"WITH {D} SELECT doc_id, n_chars FROM d WHERE n_chars < 500")
def where_characters(spark, sf):
    return _where(spark, sf, fl.CHARACTERS < 500).select("doc_id", "n_chars")


@query(f"WITH {D} SELECT doc_id, source_key FROM d WHERE source_key >= '5'")
def where_uri(spark, sf):
    return _where(spark, sf, fl.URI >= "5").select("doc_id", "source_key")


@query(f"WITH {D} SELECT doc_id FROM d WHERE lang = 'de'")
def where_label_eq(spark, sf):
    return _where(spark, sf, LANG == "de").select("doc_id")


@query(f"WITH {D} SELECT doc_id FROM d WHERE quality <> 1")
def where_label_ne_null(spark, sf):
    return _where(spark, sf, QUALITY != 1).select("doc_id")


@query(f"WITH {D} SELECT doc_id FROM d WHERE quality > 0.5")
def where_integer_against_float(spark, sf):
    return _where(spark, sf, QUALITY > 0.5).select("doc_id")


@query(f"WITH {D} SELECT doc_id FROM d WHERE quality IS NULL")
def where_is_null(spark, sf):
    return _where(spark, sf, QUALITY.is_null()).select("doc_id")


@query(f"WITH {D} SELECT doc_id FROM d WHERE quality IS NOT NULL")
def where_is_not_null(spark, sf):
    return _where(spark, sf, QUALITY.is_null() == False).select("doc_id")  # noqa: E712


@query("SELECT vec_id FROM embeddings WHERE CAST(embedding[4] AS DOUBLE) > 0.1")
def where_vector_component(spark, sf):
    return read(spark, sf, "embeddings").where((fl.VectorField("embedding", 64).component(3) > 0.1).column).select("vec_id")


def _logits(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 8).alias("topic"))


_EXP = "e AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) * 8 FOR i IN [1, 2, 3, 4]] AS v FROM embeddings), p AS (SELECT vec_id, v, [exp((x - list_max(v)) / 2) FOR x IN v] AS x FROM e)"
TOPIC = fl.ClassField("topic", CLASSES, temperature=2.0)


@query(f"WITH {_EXP} SELECT vec_id, round(x[2] / list_sum(x), 6) AS p FROM p WHERE x[2] / list_sum(x) >= 0.4")
def where_class_probability(spark, sf):
    p = TOPIC["east"]
    return _logits(spark, sf).where((p >= 0.4).column).select("vec_id", F.round(p.column, 6).alias("p"))


@query(f"WITH {_EXP} SELECT vec_id FROM p WHERE list_position(v, list_max(v)) = 3")
def where_top_class(spark, sf):
    return _logits(spark, sf).where((TOPIC.label == "south").column).select("vec_id")


@query(f"WITH {D} SELECT doc_id FROM d WHERE doc_id IN (1, 5, 8, 13, 150, -4)")
def where_document_ids(spark, sf):
    return _where(spark, sf, fl.DOCUMENT.is_in([13, 1, 5, 8, 5, 150, -4])).select("doc_id")


_STEPS = "s AS (SELECT *, CASE WHEN n_chars < 100 THEN 0 WHEN NOT coalesce(quality = 1, false) THEN 1 WHEN lang = 'en' THEN 2 END AS step FROM d)"


def _stepped(spark, sf) -> q.Query:
    return q.Query(docs(spark, sf), (q.where(fl.CHARACTERS >= 100), q.where(QUALITY == 1), q.where(LANG != "en")))


@query(f"WITH {D}, {_STEPS}, k AS (SELECT unnest([0, 1, 2]) AS step) SELECT CAST(k.step AS INTEGER) AS step, count(*) FILTER (coalesce(s.step, 9) >= k.step) AS before, count(*) FILTER (coalesce(s.step, 9) > k.step) AS after FROM s, k GROUP BY k.step")
def where_conjunction_steps(spark, sf):
    return _stepped(spark, sf).profile()


@query(f"WITH {D}, {_STEPS} SELECT doc_id, CASE WHEN step IS NULL THEN 'retained' ELSE 'filtered' END AS kind, CAST(step AS INTEGER) AS step, CAST(NULL AS BIGINT) AS kept FROM s")
def provenance_decisions(spark, sf):
    return _stepped(spark, sf).lineage()


# Snapshots


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'all' ELSE 'all,labelled' END AS origins FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def snapshot_union(spark, sf):
    p = population(read(spark, sf, "documents"))
    labelled = p.join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return union({"all": p, "labelled": labelled}).select("doc_id", F.array_join("origins", ",").alias("origins"))


@query("SELECT 'c' AS corpus, count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations UNION ALL SELECT 'd', count(*), CAST(sum(strlen(text)) AS BIGINT) FROM documents")
def snapshot_union_corpora(spark, sf):
    key = F.concat_ws("/", F.lit("c"), "conv_id", "turn")
    c = population(read(spark, sf, "conversations"), doc_id=key, corpus=F.lit("c"))
    d = population(read(spark, sf, "documents"), doc_id=F.concat_ws("/", F.lit("d"), "doc_id"), corpus=F.lit("d"))
    return pf.counts(union({"c": c, "d": d}), "corpus_id").select(F.col("corpus_id").alias("corpus"), "documents", "bytes")


_NEW, _OLD = "SELECT doc_id, text FROM documents WHERE lang <> 'es'", "SELECT doc_id, CASE WHEN lang = 'fr' THEN upper(text) ELSE text END AS text FROM documents WHERE lang <> 'de'"


@query(f"WITH n AS ({_NEW}), o AS ({_OLD}) SELECT count(*) FILTER (o.doc_id IS NULL) AS added, count(*) FILTER (n.text <> o.text) AS changed, count(*) FILTER (n.doc_id IS NULL) AS removed, count(*) FILTER (n.text = o.text) AS unchanged FROM n FULL JOIN o ON n.doc_id = o.doc_id")
def snapshot_diff(spark, sf):
    d = read(spark, sf, "documents")
    old = d.where("lang <> 'de'").withColumn("text", F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text")))
    return changes(population(d.where("lang <> 'es'")), population(old))


@query(f"WITH {D} SELECT count(*) AS documents, CAST(sum(n_bytes) AS BIGINT) AS bytes, CAST(sum(n_chars) AS BIGINT) AS characters, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS newlines FROM d")
def snapshot_profile(spark, sf):
    return pf.text_profile(docs(spark, sf))


@query(f"WITH {D} SELECT doc_id, text[1:80] AS text, n_chars > 80 AS truncated FROM d WHERE n_chars >= 100 ORDER BY doc_id LIMIT 20 OFFSET 5")
def preview_documents(spark, sf):
    return q.Query(docs(spark, sf), (q.where(fl.CHARACTERS >= 100),)).preview(20, 5, 80)


# Dedup

_LINEAGE = "SELECT doc_id, CASE WHEN kept = doc_id THEN 'retained' ELSE '{kind}' END AS kind, CASE WHEN kept <> doc_id THEN 0 END AS step, CASE WHEN kept <> doc_id THEN kept END AS kept FROM w"


@query(f"WITH {D}, w AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM d) " + _LINEAGE.format(kind="duplicate"))
def dedupe_exact(spark, sf):
    return q.Query(docs(spark, sf), (q.Dedupe(),)).lineage()


@query(f"WITH {D}, w AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY quality DESC NULLS LAST, lang DESC NULLS LAST, doc_id) AS kept FROM d) " + _LINEAGE.format(kind="duplicate"))
def dedupe_exact_ordered_nulls_last(spark, sf):
    return q.Query(docs(spark, sf), (q.Dedupe(order_by=(QUALITY.desc(), LANG.desc())),)).lineage()


@query(f"WITH {D}, w AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM d) " + _LINEAGE.format(kind="duplicate"))
def dedupe_indexed_exact(spark, sf):
    hashed = docs(spark, sf).withColumn("exact_hash", F.sha2("text", 256))
    return q.Query(hashed, (q.Dedupe(indexed="exact_hash"),)).lineage()


_LOST = f"""{D}, {_lines("l", "d")}, u AS (SELECT doc_id, unit, min((s, e)) AS pos FROM l GROUP BY doc_id, unit), f AS (SELECT unit, min((doc_id, pos)) AS w FROM u GROUP BY unit),
x AS (SELECT doc_id, min((w[1], pos, w[2])) AS x FROM u JOIN f USING (unit) WHERE w[1] < doc_id GROUP BY doc_id)"""


@query(f"WITH {_LOST} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM x)")
def dedupe_line(spark, sf):
    return q.Query(docs(spark, sf), (q.Dedupe("line"),)).rows().select("doc_id")


@query(f"WITH {_LOST} SELECT doc_id, x[1] AS kept, x[3][1] AS kept_start, x[3][2] AS kept_end, doc_id AS matched, x[2][1] AS matched_start, x[2][2] AS matched_end FROM x")
def dedupe_line_witness(spark, sf):
    return dd.unit_losers(docs(spark, sf), "line")


@query(f"""WITH {D}, g AS (SELECT doc_id, text, (lang, corpus_id) AS g, min(doc_id) OVER (PARTITION BY lang, corpus_id) AS best FROM d), f AS (SELECT text, min(best) AS w FROM g GROUP BY text)
SELECT doc_id FROM g WHERE g NOT IN (SELECT g FROM g JOIN f USING (text) WHERE w < best)""")
def dedupe_source_group(spark, sf):
    p = population(read(spark, sf, "documents"), corpus="lang", key=F.concat_ws("/", "source", "doc_id"))
    return q.Query(p, (q.Dedupe(separator="/"),)).rows().select("doc_id")


@query(f"WITH {D}, {_lines('l', 'd')}, c AS (SELECT unit, count(*) AS places, count(DISTINCT doc_id) AS documents FROM l GROUP BY unit) SELECT places, documents, count(*) AS classes FROM c GROUP BY places, documents")
def evidence_line_groups(spark, sf):
    return dd.evidence_groups(docs(spark, sf), "line").groupBy("places", "documents").agg(F.count("*").alias("classes"))


_JACCARD = f"""{D}, w AS (SELECT doc_id, content, regexp_extract_all(text, '\\S+') AS w FROM d),
s AS (SELECT doc_id, content, CASE WHEN len(w) < 5 THEN [] ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS g FROM w),
k AS (SELECT doc_id, g, CASE WHEN len(g) = 0 THEN content ELSE sha256(array_to_string(g, chr(10))) END AS k FROM s), c AS (SELECT k, min(doc_id) AS rep, any_value(g) AS g FROM k GROUP BY k),
x AS (SELECT rep, len(g) AS n, unnest(g) AS gram FROM c), e AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.gram = b.gram AND a.rep < b.rep GROUP BY a.rep, b.rep)"""


@query(f"WITH {_JACCARD} SELECT a, b, round(i / (na + nb - i), 6) AS similarity FROM e WHERE i / (na + nb - i) >= 0.5")
def dedupe_jaccard_edges(spark, sf):
    edges, _ = si.jaccard_edges(docs(spark, sf), 0.5)
    return edges.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_JACCARD}, m AS (SELECT a AS rep FROM e WHERE i / (na + nb - i) >= 0.5 UNION ALL SELECT b FROM e WHERE i / (na + nb - i) >= 0.5), n AS (SELECT rep, count(*) AS links FROM m GROUP BY rep) SELECT k.doc_id, c.rep, coalesce(links, 0) AS links FROM k JOIN c USING (k) LEFT JOIN n ON n.rep = c.rep")
def dedupe_jaccard_classes(spark, sf):
    """Each document with its class and the class's number of links to other classes."""
    edges, classes = si.jaccard_edges(docs(spark, sf), 0.5)
    links = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return classes.join(links, "rep", "left").select("doc_id", "rep", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query()
def dedupe_jaccard(spark, sf):
    return q.Query(docs(spark, sf), (q.Similar(0.5),)).lineage()


def _vectors(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


_COS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / (a.n * b.n) AS s FROM u a JOIN u b ON a.vec_id < b.vec_id)"


@query(f"WITH {_COS} SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.4")
def dedupe_cosine_edges(spark, sf):
    edges, _ = si.cosine_edges(_vectors(spark, sf), 0.4)
    return edges.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def dedupe_cosine(spark, sf):
    return si.similarity_losers(_vectors(spark, sf), 0.4, vector="embedding")


@query()
def dedupe_minhash_lsh(spark, sf):
    return q.Query(docs(spark, sf), (q.Similar(0.5, method="minhash"),)).lineage()


@query()
def index_minhash_evidence(spark, sf):
    return si.evidence(docs(spark, sf))


# Decontamination

_DG = f"{D}, {B}, {_grams('g', 'd')}, {_grams('h', 'b')}, r AS (SELECT unit, min((doc_id, s, e)) AS w FROM h GROUP BY unit), m AS (SELECT DISTINCT g.doc_id, s, e, w FROM g JOIN r USING (unit))"
_DL = f"{D}, {B}, {_lines('g', 'd')}, {_lines('h', 'b')}, r AS (SELECT unit, min((doc_id, s, e)) AS w FROM h GROUP BY unit), m AS (SELECT DISTINCT g.doc_id, s, e, w FROM g JOIN r USING (unit))"
_SPANS = """i AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM m), j AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS k FROM i),
c AS (SELECT doc_id, k, min(s) AS s, max(e) AS e FROM j GROUP BY doc_id, k), z AS (SELECT doc_id, count(*) AS removed_spans, CAST(sum(e - s) AS BIGINT) AS removed_bytes FROM c GROUP BY doc_id)"""


def _decon(spark, sf, *steps, **options) -> q.Query:
    return q.Query(docs(spark, sf), steps, q.Decontaminate((bench(spark, sf),), **options))


@query(f"WITH {_DG} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM m)")
def decon_ngram(spark, sf):
    return _decon(spark, sf).rows().select("doc_id")


@query(f"WITH {_DL} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM m)")
def decon_line(spark, sf):
    return _decon(spark, sf, algorithm="line").rows().select("doc_id")


@query(f"WITH {D}, {B} SELECT doc_id FROM d WHERE text NOT IN (SELECT text FROM b)")
def decon_document(spark, sf):
    return _decon(spark, sf, algorithm="document").rows().select("doc_id")


@query(f"WITH {_DG} SELECT doc_id, s AS \"start\", e AS \"end\", w[1] AS ref_id, w[2] AS ref_start, w[3] AS ref_end FROM m")
def decon_ngram_witness(spark, sf):
    return dc.matches(docs(spark, sf), bench(spark, sf))


@query(f"WITH {_DL} SELECT doc_id, s AS \"start\", e AS \"end\", w[1] AS ref_id, w[2] AS ref_start, w[3] AS ref_end FROM m")
def reference_matches(spark, sf):
    return dc.matches(docs(spark, sf), bench(spark, sf), "line")


def _cuts(spark, sf, algorithm):
    return dc.cut_spans(docs(spark, sf), bench(spark, sf), algorithm).select("doc_id", F.octet_length("retained_text").cast("long").alias("n_bytes"), "removed_spans", "removed_bytes")


@query(f"WITH {_DG}, {_SPANS} SELECT doc_id, n_bytes - removed_bytes AS n_bytes, removed_spans, removed_bytes FROM z JOIN d USING (doc_id)")
def decon_span_ngram(spark, sf):
    return _cuts(spark, sf, "ngram")


@query(f"WITH {_DL}, {_SPANS} SELECT doc_id, n_bytes - removed_bytes AS n_bytes, removed_spans, removed_bytes FROM z JOIN d USING (doc_id)")
def decon_span_line(spark, sf):
    return _cuts(spark, sf, "line")


@query(f"WITH {_DG}, {_SPANS} SELECT count(*) AS matched_documents, count(*) AS removed_documents, CAST(sum(removed_spans) AS BIGINT) AS removed_spans, CAST(sum(removed_bytes) AS BIGINT) AS removed_bytes FROM z")
def decon_stats(spark, sf):
    return dc.statistics(docs(spark, sf), bench(spark, sf))


# Sampling


def _alloc(parts: str, budget: str) -> str:
    """Largest remainders in SQL. parts: stratum, w (an integer weight)."""
    return f"""a0 AS (SELECT stratum, w, CAST(w AS HUGEINT) * {budget} AS x, sum(CAST(w AS HUGEINT)) OVER () AS t FROM ({parts})), a1 AS (SELECT stratum, x // t AS n, x % t AS r FROM a0),
al AS (SELECT stratum, CAST(n + CASE WHEN row_number() OVER (ORDER BY r DESC, stratum) <= {budget} - sum(n) OVER () THEN 1 ELSE 0 END AS BIGINT) AS target FROM a1)"""


def _sampled(stratum: str, size: str, budget: str, parts: str | None = None) -> str:
    parts = parts or f"SELECT {stratum} AS stratum, sum({size}) AS w FROM d GROUP BY 1"
    return f"""{D}, {_alloc(parts, budget)}, o AS (SELECT doc_id, {stratum} AS stratum, CAST({size} AS BIGINT) AS size, sum({size}) OVER (PARTITION BY {stratum} ORDER BY sha256('sample/7/' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - {size} AS before FROM d),
t AS (SELECT doc_id, stratum, size FROM o JOIN al USING (stratum) WHERE before < target)"""


def _sample(spark, sf, unit, amount, stratum=None, **more):
    return sm.sample(docs(spark, sf), unit, amount, 7, stratum, **more)[0].select("doc_id", "stratum", "size")


_T = "SELECT doc_id, stratum, size FROM t"


@query(f"WITH {_sampled(chr(39) + '[]' + chr(39), '1', '50')} {_T}")
def sample_documents(spark, sf):
    return _sample(spark, sf, "documents", 50)


@query(f"WITH {_sampled(chr(39) + '[]' + chr(39), '1', '(SELECT CAST(floor(count(*) * 0.25) AS BIGINT) FROM documents)')} {_T}")
def sample_fraction(spark, sf):
    return _sample(spark, sf, "fraction", 0.25)


@query(f"WITH {_sampled(chr(39) + '[]' + chr(39), 'n_bytes', '100000')} {_T}")
def sample_bytes(spark, sf):
    return _sample(spark, sf, "bytes", 100_000)


@query(f"WITH {_sampled('lang', 'n_chars', '90001')} {_T}")
def sample_characters(spark, sf):
    return _sample(spark, sf, "characters", 90_001, F.col("lang"))


@query(f"WITH {_sampled(chr(39) + '[]' + chr(39), 'n_bytes', '70000')} {_T}")
def sample_tokens(spark, sf):
    return _sample(spark, sf, "tokens", 70_000)


_KEY = "CASE WHEN quality IS NULL THEN '[\"' || lang || '\",null]' ELSE '[\"' || lang || '\",' || quality || ']' END"


@query(f"WITH {_sampled(_KEY, 'n_bytes', '120000')} {_T}")
def sample_stratified(spark, sf):
    return _sample(spark, sf, "bytes", 120_000, T.stratum([(F.col("lang"), True), (F.col("quality"), False)]))


@query(f"WITH {_sampled('lang', '1', '40', 'SELECT unnest([chr(100)||chr(101), chr(101)||chr(110), chr(101)||chr(115), chr(102)||chr(114)]) AS stratum, unnest([1, 4, 2, 1]) AS w')} {_T}")
def sample_weighted(spark, sf):
    return _sample(spark, sf, "documents", 40, F.col("lang"), weights={"de": 0.125, "en": 0.5, "es": 0.25, "fr": 0.125})


@query(f"""WITH {D}, {_alloc("SELECT lang AS stratum, count(*) AS w FROM d GROUP BY 1", "300")}, o AS (SELECT doc_id, lang AS stratum, row_number() OVER (PARTITION BY lang ORDER BY sha256('sample/7/' || doc_id), doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d),
k AS (SELECT stratum, unnest(range(target)) AS draw FROM al) SELECT o.doc_id, o.stratum, count(*) AS occurrences FROM k JOIN o ON o.stratum = k.stratum AND o.place = CAST('0x' || sha256('sample-replacement/7/' || k.stratum || '/' || draw)[1:15] AS BIGINT) % o.n GROUP BY 1, 2""")
def sample_replacement(spark, sf):
    out, _ = sm.sample(docs(spark, sf), "documents", 300, 7, F.col("lang"), replacement=True)
    return out.groupBy("doc_id", "stratum").agg(F.count("*").alias("occurrences"))


@query(f"WITH {_sampled('lang', 'n_bytes', '150000')} SELECT stratum, any_value(target) AS requested, CAST(sum(size) AS BIGINT) AS realized, count(*) AS documents FROM t JOIN al USING (stratum) GROUP BY stratum")
def sample_stats(spark, sf):
    out, s = sm.sample(docs(spark, sf), "bytes", 150_000, 7, F.col("lang"))
    goal = spark.createDataFrame(sorted(s["requested_domains"].items()), "stratum string, requested long")
    return out.groupBy("stratum").agg(F.sum("size").alias("realized"), F.count("*").alias("documents")).join(F.broadcast(goal), "stratum")


@query(f"WITH {D}, {_alloc('SELECT lang AS stratum, sum(n_bytes) AS w FROM d GROUP BY 1', '99991')} SELECT stratum, target FROM al")
def allocations(spark, sf):
    held = mx.inventory_map(docs(spark, sf), F.col("lang"), F.col("n_bytes"))
    return spark.createDataFrame(sorted(sm.allocations(held, 99_991).items()), "stratum string, target long")


# Mixtures


@query(f"WITH {D} SELECT lang AS label, count(*) AS documents, CAST(sum(n_bytes) AS BIGINT) AS tokens FROM d GROUP BY lang")
def mix_inventory(spark, sf):
    return mx.inventory(docs(spark, sf), F.col("lang"), F.col("n_bytes"))


def _draw_sql(parts: str, budget: str) -> str:
    return f"""{D}, {_alloc(parts, budget)}, h AS (SELECT lang AS label, sum(n_bytes) AS held FROM d GROUP BY 1), ep AS (SELECT label, target, unnest(range(CAST(ceil(target / held) AS BIGINT))) AS epoch FROM h JOIN al ON stratum = label),
o AS (SELECT doc_id, label, epoch, n_bytes AS size, target, sum(n_bytes) OVER (PARTITION BY label ORDER BY epoch, sha256('mixture-epoch/3/' || label || '/' || epoch || '/' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - n_bytes AS before FROM d JOIN ep ON lang = label WHERE n_bytes > 0),
t AS (SELECT doc_id, label, epoch, CAST(least(size, target - before) AS BIGINT) AS take, sha256('mixture-order/3/' || label || '/' || epoch || '/' || doc_id) AS key FROM o WHERE before < target)"""


_QUARTERS = "SELECT unnest(['de', 'en', 'es', 'fr']) AS stratum, unnest([1, 1, 1, 1]) AS w"
_EVEN = {"de": 0.25, "en": 0.25, "es": 0.25, "fr": 0.25}


def _mixture(spark, sf, **more) -> mx.Mixture:
    return mx.Mixture(docs(spark, sf), F.col("lang"), F.col("n_bytes"), seed=3, **more)


@query(f"WITH {_draw_sql(_QUARTERS, '100003')} SELECT doc_id, label, epoch, take FROM t")
def mix_fixed_draw(spark, sf):
    return _mixture(spark, sf, budget=100_003, weights=_EVEN, replacement=True).pieces().select("doc_id", "label", "epoch", "take")


_HALF = "(SELECT 2 * CAST(sum(strlen(text)) AS BIGINT) + 11 FROM documents)"


@query(f"WITH {_draw_sql(_QUARTERS, _HALF)} SELECT label, epoch, count(*) AS documents, CAST(sum(take) AS BIGINT) AS tokens FROM t GROUP BY label, epoch")
def mix_epochs_draw(spark, sf):
    m = _mixture(spark, sf)
    total = sum(mx.inventory_map(m.docs, m.label, m.tokens).values())
    pieces = _mixture(spark, sf, budget=2 * total + 11, weights=_EVEN, replacement=True).pieces()
    return pieces.groupBy("label", "epoch").agg(F.count("*").alias("documents"), F.sum("take").alias("tokens"))


@query(f"WITH {_draw_sql('SELECT lang AS stratum, sum(n_bytes) AS w FROM d GROUP BY 1', '200000')} SELECT doc_id, label, epoch, take FROM t")
def mix_natural(spark, sf):
    docs_ = docs(spark, sf)
    held = mx.inventory_map(docs_, F.col("lang"), F.col("n_bytes"))
    return mx.draw(docs_, F.col("lang"), F.col("n_bytes"), sm.allocations(held, 200_000), 3).select("doc_id", "label", "epoch", "take")


@query(f"WITH {_draw_sql(_QUARTERS, '100003')}, s AS (SELECT *, sum(take + 1) OVER (ORDER BY key, doc_id, epoch ROWS UNBOUNDED PRECEDING) - take - 1 AS start FROM t), n AS (SELECT (sum(take + 1) // 1000) * 1000 AS out FROM t) SELECT label, CAST(sum(greatest(0, least(take, out - start))) AS BIGINT) AS tokens FROM s, n GROUP BY label")
def mix_exposure(spark, sf):
    pieces = _mixture(spark, sf, budget=100_003, weights=_EVEN, replacement=True).pieces()
    scratch = Scratch(spark, "exposure")
    pieces = scratch.keep(pieces, "pieces")
    t = pk.totals(pieces, pk.Concat(1000, 256), "take").first()
    return mx.exposure(pieces, t["output"], True, scratch)


@query()
def mix_regmix(spark, sf):
    found = _mixture(spark, sf, budget=100_000, weights=mx.RegMix(seed=5), n_candidates=4, replacement=True).candidates()
    rows = [(k, label, round(w[label], 9), n[label]) for k, (w, n) in enumerate(found) for label in w]
    return spark.createDataFrame(rows, "candidate int, label string, weight double, tokens long")


@query()
def mix_bounds(spark, sf):
    bounds = mx.Bounds(lower={"en": 0.3}, upper={"en": 0.6}, max_epochs=2.0)
    found = _mixture(spark, sf, budget=100_000, weights=mx.RegMix(seed=5), bounds=bounds, n_candidates=3, replacement=True).candidates()
    return spark.createDataFrame([(k, label, round(w[label], 9)) for k, (w, _) in enumerate(found) for label in w], "candidate int, label string, weight double")


_SPLIT = "x AS (SELECT doc_id, n_bytes, CAST('0x' || sha256('split/0/' || content)[1:15] AS BIGINT) AS x FROM d), y AS (SELECT doc_id, n_bytes, CASE WHEN x < CAST(0.8 * 1152921504606846976 AS BIGINT) THEN 'train' WHEN x < CAST(0.9 * 1152921504606846976 AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM x)"


@query(f"WITH {D}, {_SPLIT} SELECT doc_id, split FROM y")
def splits_content(spark, sf):
    return docs(spark, sf).select("doc_id", mx.Splits().of(F.col("content")).alias("split"))


@query(f"WITH {D}, {_SPLIT} SELECT split, count(*) AS documents, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM y GROUP BY split")
def splits_profile(spark, sf):
    return docs(spark, sf).groupBy(mx.Splits().of(F.col("content")).alias("split")).agg(F.count("*").alias("documents"), F.sum("n_bytes").alias("bytes"))


# Tokens and packing


@query(f"WITH {D} SELECT doc_id, n_bytes AS n_tokens FROM d")
def tokens_byte_lengths(spark, sf):
    return tk.ByteTokenizer().encode(docs(spark, sf).select("doc_id", "text")).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


_OCC = f"{D}, o AS (SELECT doc_id, n_bytes AS size, sum(n_bytes + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_bytes - 1 AS start FROM d), t AS (SELECT CAST(sum(size) AS BIGINT) AS content, count(*) AS occurrences, CAST(sum(size + 1) AS BIGINT) AS total FROM o)"


def _occurrences(spark, sf) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.col("n_bytes").alias("size"))


@query(f"WITH {_OCC} SELECT content, occurrences AS separators, CAST(0 AS BIGINT) AS padding, total // 512 AS sequences, total // 512 * 512 AS output, occurrences FROM t")
def pack_totals_drop(spark, sf):
    return pk.totals(_occurrences(spark, sf), pk.Concat(512, 256))


@query(f"WITH {_OCC} SELECT content, occurrences AS separators, (total + 511) // 512 * 512 - total AS padding, (total + 511) // 512 AS sequences, (total + 511) // 512 * 512 AS output, occurrences FROM t")
def pack_totals_pad(spark, sf):
    return pk.totals(_occurrences(spark, sf), pk.Concat(512, 256, 257))


def _placed(spark, sf, plan):
    return pk.placed(_occurrences(spark, sf), [F.col("doc_id")], plan, Scratch(spark, "packing"))


@query(f"WITH {_OCC}, n AS (SELECT total // 512 * 512 AS out FROM t), e AS (SELECT doc_id, start, least(start + size + 1, out) AS e FROM o, n), q AS (SELECT doc_id, unnest(range(CAST(start // 512 AS BIGINT), CAST((e - 1) // 512 + 1 AS BIGINT))) AS q FROM e WHERE e > start), c AS (SELECT q, count(DISTINCT doc_id) AS documents FROM q GROUP BY q) SELECT documents, count(*) AS sequences FROM c GROUP BY documents")
def pack_geometry(spark, sf):
    plan = pk.Concat(512, 256)
    kept, t = _placed(spark, sf, plan)
    return pk.geometry(kept, plan, t["output"])


@query(f"WITH {_OCC}, n AS (SELECT total // 512 * 512 AS out FROM t) SELECT CAST(sum(size - greatest(0, least(size, out - start))) AS BIGINT) AS dropped_content, CAST(sum(CASE WHEN start + size < out THEN 0 ELSE 1 END) AS BIGINT) AS dropped_separators FROM o, n")
def pack_dropped(spark, sf):
    _, t = _placed(spark, sf, pk.Concat(512, 256))
    return spark.createDataFrame([(t["dropped_content"], t["dropped_separators"])], "dropped_content long, dropped_separators long")


def _packed(spark, sf, plan) -> DataFrame:
    kept, t = _placed(spark, sf, plan)
    return pk.sequences(kept, tk.ByteTokenizer().encode(docs(spark, sf).select("doc_id", "text")).select("doc_id", "tokens"), plan, t["output"])


@query(f"WITH {_OCC}, n AS (SELECT (total + 511) // 512 AS k FROM t), s AS (SELECT unnest(range((SELECT k FROM n))) AS sequence) SELECT sequence, CAST(512 AS BIGINT) AS n_tokens, CAST(least(512, (SELECT total FROM t) - sequence * 512) AS BIGINT) AS learned FROM s")
def pack_sequences(spark, sf):
    packed = _packed(spark, sf, pk.Concat(512, 256, 257))
    return packed.select("sequence", F.size("tokens").cast("long").alias("n_tokens"), F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("learned"))


@query(f"WITH {_OCC}, n AS (SELECT total // 512 * 512 AS out FROM t), e AS (SELECT doc_id, start, least(start + size, out) AS e FROM o, n), q AS (SELECT doc_id, start, e, unnest(range(CAST(start // 512 AS BIGINT), CAST((e - 1) // 512 + 1 AS BIGINT))) AS sequence FROM e WHERE e > start) SELECT sequence, doc_id, CAST(greatest(start, sequence * 512) - sequence * 512 AS BIGINT) AS \"start\", CAST(least(e, (sequence + 1) * 512) - sequence * 512 AS BIGINT) AS \"end\", CAST(greatest(start, sequence * 512) - start AS BIGINT) AS \"offset\" FROM q")
def pack_regions(spark, sf):
    regions = _packed(spark, sf, pk.Concat(512, 256)).select("sequence", F.explode("regions").alias("r")).where("r.kind = 'content'")
    return regions.select("sequence", "r.doc_id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"), "r.offset")


@query(f"WITH {_OCC}, s AS (SELECT unnest(range((SELECT total // 512 FROM t))) AS sequence) SELECT sequence FROM s WHERE sequence % 6 = 3 AND sequence >= 10")
def reader_partition(spark, sf):
    """Reader 1 of 2, worker 1 of 3... of each, from a checkpoint at sequence 10."""
    return pk.reader(_packed(spark, sf, pk.Concat(512, 256)), rank=1, world=2, worker=0, workers=3, start=10).select("sequence")


@query()
def pack_batches(spark, sf):
    return pk.batches(_packed(spark, sf, pk.Concat(512, 256, 257)))


# Profiles

_NUM = "SELECT '{c}' AS field, count({c}) AS documents, count(*) - count({c}) AS missing, CAST(sum({c}) AS DOUBLE) AS total, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS deviation, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM d"


@query(f"WITH {D} " + " UNION ALL ".join(_NUM.format(c=c) for c in ("n_bytes", "n_chars", "quality")))
def profile_numeric(spark, sf):
    out = pf.numeric(docs(spark, sf), ["n_bytes", "n_chars", "quality"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query(f"WITH {D}, v AS (SELECT n_chars AS value, count(*) AS n FROM d GROUP BY 1), p AS (SELECT value, n, sum(n) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total FROM v) SELECT min(value) AS lower, max(value) AS upper, CAST(sum(n) AS BIGINT) AS count FROM p GROUP BY CAST(floor(before * 64 / total) AS BIGINT)")
def profile_histogram(spark, sf):
    return pf.histogram(docs(spark, sf), "n_chars")


@query(f"WITH {D} SELECT lang AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM d WHERE lang IS NOT NULL GROUP BY lang")
def profile_categories(spark, sf):
    return pf.categories(docs(spark, sf), F.col("lang")).withColumn("fraction", F.round("fraction", 6))


_POINTS = (0.0, 0.1, 0.5, 0.9, 1.0)


@query(f"WITH {D}, s AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) AS k, count(*) OVER () AS n FROM d), p AS (SELECT unnest([0.0, 0.1, 0.5, 0.9, 1.0]) AS point) SELECT CAST(point AS DOUBLE) AS point, CAST(v AS DOUBLE) AS value FROM s, p WHERE k = greatest(1, CAST(ceil(point * n) AS BIGINT))")
def profile_quantiles(spark, sf):
    return pf.quantiles(docs(spark, sf), "n_chars", _POINTS)


@query(f"WITH {_EXP}, k AS (SELECT unnest(['north', 'east', 'south', 'west']) AS class, unnest([1, 2, 3, 4]) AS k) SELECT class, count(*) FILTER (list_position(v, list_max(v)) = k.k) AS top, round(avg(x[k.k] / list_sum(x)), 6) AS mean, round(max(x[k.k] / list_sum(x)), 6) AS max FROM p, k GROUP BY class")
def profile_classifier(spark, sf):
    return pf.classifier(_logits(spark, sf), TOPIC).withColumns({c: F.round(c, 6) for c in ("mean", "max")})


@query(f"WITH {D} SELECT corpus_id, count(*) AS documents, CAST(sum(n_bytes) AS BIGINT) AS bytes, CAST(sum(n_chars) AS BIGINT) AS characters FROM d WHERE n_chars >= 100 GROUP BY corpus_id")
def profile_sources(spark, sf):
    return q.Query(docs(spark, sf), (q.where(fl.CHARACTERS >= 100),)).origins()


@query(f"WITH {D}, {_STEPS}, k AS (SELECT unnest([0, 1, 2]) AS step) SELECT CAST(k.step AS INTEGER) AS step, count(*) FILTER (coalesce(s.step, 9) >= k.step) AS before, count(*) FILTER (coalesce(s.step, 9) > k.step) AS after FROM s, k GROUP BY k.step")
def profile_steps(spark, sf):
    return _stepped(spark, sf).profile()


@query(f"""WITH {D}, o AS (SELECT *, row_number() OVER (ORDER BY sha256('sample/7/' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n FROM d), k AS (SELECT unnest(range((SELECT 2 * count(*) FROM d))) AS draw),
t AS (SELECT o.n_bytes, o.n_chars FROM k JOIN o ON o.place = CAST('0x' || sha256('sample-replacement/7/[]/' || draw)[1:15] AS BIGINT) % o.n) """ + " UNION ALL ".join(_NUM.format(c=c).replace("FROM d", "FROM t") for c in ("n_bytes", "n_chars")))
def profile_occurrences(spark, sf):
    """Moments weighted by how often a sample with replacement holds each document."""
    d = docs(spark, sf)
    out, _ = sm.sample(d, "fraction", 2.0, 7, replacement=True)
    times = out.groupBy("doc_id").agg(F.count("*").alias("times"))
    return pf.numeric(d.join(times, "doc_id"), ["n_bytes", "n_chars"], weight="times").withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query()
def estimate_bounds(spark, sf):
    """Bounds from histograms alone beside the true number."""
    d = docs(spark, sf)
    scratch = Scratch(spark, "estimate")
    d = scratch.keep(d.select("doc_id", "n_bytes", "n_chars", "quality"), "d")
    held = {c: [tuple(r) for r in pf.histogram(d, c).collect()] for c in ("n_chars", "quality")}  # at most 64 rows each
    tests = [("n_chars", ">=", 500), ("n_chars", "<", 3000), ("quality", "=", 1)]
    e = pf.estimate(d.count(), held, tests)
    truth = d.where("n_chars >= 500 and n_chars < 3000 and quality = 1").count()
    return spark.createDataFrame([(e.lower, e.upper, truth)], "lower long, upper long, truth long")


# Fields and recipes


@query(f"""WITH {D} SELECT doc_id, n_chars AS "length", round((n_chars - length(regexp_replace(text, '\\s', '', 'g'))) / n_chars, 6) AS white_space_ratio, round((n_chars - length(regexp_replace(text, '\\p{{Nd}}', '', 'g'))) / n_chars, 6) AS digit_ratio,
round((n_chars - length(regexp_replace(text, '\\p{{Lu}}', '', 'g'))) / n_chars, 6) AS uppercase_ratio, round((n_chars - length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) / n_chars, 6) AS non_alpha_digit_ratio FROM d""")
def field_doc_stats(spark, sf):
    s = docs(spark, sf).select("doc_id", *[c.alias(k) for k, c in producers.document_statistics(F.col("text")).items()])
    return s.select("doc_id", "length", *[F.round(c, 6).alias(c) for c in ("white_space_ratio", "digit_ratio", "uppercase_ratio", "non_alpha_digit_ratio")])


@query(f"""WITH {D}, w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM d) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(list_sum([length(x) FOR x IN w]) / len(w), 6) AS avg_word_length, round(len([x FOR x IN w IF length(x) <= 3]) / len(w), 6) AS short_word_ratio_3,
round(len([x FOR x IN w IF length(x) >= 7]) / len(w), 6) AS long_word_ratio_7, round(len(list_distinct(w)) / len(w), 6) AS type_token_ratio FROM w""")
def field_word_stats(spark, sf):
    s = producers.with_statistics(docs(spark, sf).select("doc_id", "text"))
    return s.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("avg_word_length", "short_word_ratio_3", "long_word_ratio_7", "type_token_ratio")])


@query(f"""WITH {D}, w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w, string_split(text, chr(10)) AS l FROM d),
m AS (SELECT doc_id, len(w) AS n, list_sum([length(x) FOR x IN w]) / len(w) AS size, (len([x FOR x IN w IF contains(x, '#')]) + len([x FOR x IN w IF contains(x, '...') OR contains(x, '…')])) / len(w) AS symbols,
  len([x FOR x IN l IF regexp_matches(ltrim(x), '^[•-]')]) / len(l) AS bullets, len([x FOR x IN l IF regexp_matches(rtrim(x), '(\\.\\.\\.|…)$')]) / len(l) AS ellipses, len([x FOR x IN w IF regexp_matches(x, '\\p{{L}}')]) / len(w) AS alpha,
  len(list_intersect(list_distinct(w), ['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'])) AS plain FROM w)
SELECT doc_id FROM m WHERE n BETWEEN 50 AND 100000 AND size BETWEEN 3 AND 10 AND symbols <= 0.1 AND bullets <= 0.9 AND ellipses <= 0.3 AND alpha >= 0.8 AND plain >= 2""")
def recipe_gopher_quality(spark, sf):
    return recipes.gopher_quality(docs(spark, sf)).select("doc_id")


def _repetition() -> str:
    """Per n: the grams of each document with their numbers; of n up to 4 the most frequent counts, else all repeats."""
    grams = [f"SELECT doc_id, {n} AS n, unnest([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})]) AS g FROM w WHERE len(w) >= {n}" for n in range(2, 11)]
    limit = "CASE n " + " ".join(f"WHEN {n} THEN {x}" for n, x in (recipes.TOP | recipes.REPEATED).items()) + " END"
    part = lambda p: f"list_max([(len({p}) - len(list_distinct({p}))) / greatest(len({p}), 1) / {recipes.LINES}, (list_sum([length(x) FOR x IN {p}]) - list_sum([length(x) FOR x IN list_distinct({p})])) / greatest(n, 1) / {recipes.LINE_CHARS}])"
    return f"""WITH {D}, w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM d), g AS ({" UNION ALL ".join(grams)}),
t AS (SELECT doc_id, n, g, count(*) AS k, length(g) AS size FROM g GROUP BY doc_id, n, g),
s AS (SELECT t.doc_id, t.n, CASE WHEN t.n <= 4 THEN coalesce(max(CASE WHEN k > 1 THEN {{'k': k, 'size': size}} END).k * max(CASE WHEN k > 1 THEN {{'k': k, 'size': size}} END).size, 0) ELSE sum((k - 1) * size) END AS amount FROM t GROUP BY t.doc_id, t.n),
r AS (SELECT s.doc_id, max(amount / greatest(n_chars, 1) / {limit}) AS worst FROM s JOIN d ON s.doc_id = d.doc_id GROUP BY s.doc_id),
p AS (SELECT doc_id, n_chars AS n, [x FOR x IN regexp_split_to_array(trim(text), '\\n+') IF x <> ''] AS lines, [x FOR x IN regexp_split_to_array(trim(text), '\\n{{2,}}') IF x <> ''] AS paragraphs FROM d)
SELECT p.doc_id, round(greatest({part("lines")}, {part("paragraphs")}, coalesce(worst, 0)), 6) AS worst FROM p LEFT JOIN r ON p.doc_id = r.doc_id"""


@query(_repetition())
def recipe_gopher_repetition(spark, sf):
    return recipes.repetition_shares(docs(spark, sf)).select("doc_id", F.round("worst", 6).alias("worst"))


@query(f"""WITH {D}, l AS (SELECT doc_id, text, [trim(x) FOR x IN string_split(text, chr(10)) IF regexp_matches(rtrim(x), '[.?!"\'\']$') AND NOT regexp_matches(rtrim(x), '\\.\\.\\.$') AND len(regexp_extract_all(x, '\\S+')) >= 5 AND NOT contains(lower(x), 'javascript')] AS kept FROM d),
c AS (SELECT doc_id, text, array_to_string(kept, chr(10)) AS clean FROM l)
SELECT doc_id, CAST(length(clean) AS INTEGER) AS n_chars FROM c WHERE len(regexp_extract_all(clean, '[.!?]+["\'\')\\]]*(\\s|$)')) >= 3 AND NOT contains(lower(text), 'lorem ipsum') AND NOT contains(text, '{{')""")
def recipe_c4_lines(spark, sf):
    return recipes.c4_lines(docs(spark, sf)).select("doc_id", F.length("text").alias("n_chars"))


@query(f"WITH {D} SELECT doc_id FROM d WHERE CAST(CAST('0x' || sha256('0' || chr(0) || source_key)[1:13] AS BIGINT) AS DOUBLE) / 4503599627370496.0 < pow(2.0 - coalesce(quality, 0.5), -9)")
def recipe_pareto_resample(spark, sf):
    return recipes.pareto(docs(spark, sf), F.coalesce(F.col("quality").cast("double"), F.lit(0.5))).select("doc_id")


@query(f"WITH {D}, f AS (SELECT * FROM d WHERE lang = 'en'), w AS (SELECT doc_id, n_bytes, corpus_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM f) SELECT corpus_id AS label, count(*) AS documents, CAST(sum(n_bytes) AS BIGINT) AS tokens FROM w WHERE kept = doc_id GROUP BY corpus_id")
def recipe_english_dedupe_mix(spark, sf):
    kept = q.Query(docs(spark, sf), (q.where(LANG == "en"), q.Dedupe())).rows()
    return mx.inventory(kept, F.col("corpus_id"), F.col("n_bytes"))


_FLAG = f"""WITH {D}, f AS (SELECT * FROM d WHERE n_chars >= 100), u AS (SELECT * FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS kept FROM f) WHERE kept = doc_id), {B}, {_grams("g", "u")}, {_grams("h", "b")}
SELECT corpus_id, count(*) AS documents, CAST(sum(n_bytes) AS BIGINT) AS bytes, CAST(sum(n_chars) AS BIGINT) AS characters FROM u WHERE doc_id NOT IN (SELECT g.doc_id FROM g JOIN h USING (unit)) GROUP BY corpus_id"""


@query(_FLAG)
def flagship(spark, sf):
    """Long enough, exact duplicates out, benchmark 13-grams out; counts by corpus."""
    return _decon(spark, sf, q.where(fl.CHARACTERS >= 100), q.Dedupe()).origins()


_prepared: dict[tuple[str, str], DataFrame] = {}


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """The population's columns without texts, prepared once a session and clustered by length."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _prepared:
        _prepared[key] = prepare(docs(spark, sf), Scratch(spark, "prepared").at("columns"), cluster_by=["n_chars"])
    return _prepared[key]


def _filtered(spark, sf, *tests) -> DataFrame:
    kept = q.Query(prepared(spark, sf), tuple(map(q.where, tests))).rows()
    out = pf.numeric(kept, ["n_bytes", "n_chars", "quality", "toxic"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


_PROFILED = " UNION ALL ".join(_NUM.format(c=c) for c in ("n_bytes", "n_chars", "quality", "toxic"))


@query(f"WITH {D.replace('d AS (', 'd0 AS (', 1)}, d AS (SELECT * FROM d0 WHERE n_chars >= 500 AND n_chars < 520) {_PROFILED}")
def profile_filtered_narrow(spark, sf):
    return _filtered(spark, sf, fl.CHARACTERS >= 500, fl.CHARACTERS < 520)


@query(f"WITH {D.replace('d AS (', 'd0 AS (', 1)}, d AS (SELECT * FROM d0 WHERE n_chars >= 1500) {_PROFILED}")
def profile_filtered_half(spark, sf):
    return _filtered(spark, sf, fl.CHARACTERS >= 1500)


@query(f"WITH {D.replace('d AS (', 'd0 AS (', 1)}, d AS (SELECT * FROM d0 WHERE n_chars >= 100) {_PROFILED}")
def profile_filtered_broad(spark, sf):
    return _filtered(spark, sf, fl.CHARACTERS >= 100)


@query(f"WITH {D.replace('d AS (', 'd0 AS (', 1)}, d AS (SELECT * FROM d0 WHERE n_chars >= 500 AND n_chars < 700) {_PROFILED}")
def profile_filtered_medium(spark, sf):
    return _filtered(spark, sf, fl.CHARACTERS >= 500, fl.CHARACTERS < 700)


@query(f"WITH {D} SELECT doc_id, corpus_id, source_key, n_bytes, n_chars, CAST(0 AS BIGINT) AS occurrence, lang, quality FROM d WHERE n_chars >= 1000")
def query_projection(spark, sf):
    """Fields that no filter uses come along."""
    return q.Query(docs(spark, sf), (q.where(fl.CHARACTERS >= 1000),), fields=("lang", "quality")).projected()


@query(f"WITH {D} SELECT 0 AS candidate, corpus_id AS label, round(sum(n_bytes) / (SELECT sum(n_bytes) FROM d), 6) AS weight, CAST(sum(n_bytes) AS BIGINT) AS tokens FROM d GROUP BY corpus_id")
def mix_profile(spark, sf):
    """A mixture without weights or budget passes everything through."""
    return mx.Mixture(docs(spark, sf), F.col("corpus_id"), F.col("n_bytes")).profile().withColumn("weight", F.round("weight", 6))


# Sources, catalog and sinks: written to scratch tables and read back


def _pairs(spark, sf) -> DataFrame:
    return docs(spark, sf).select("source_key", "text")


@query(f"WITH {D} SELECT 'in/' || source_key AS source_key, content FROM d")
def source_jsonl(spark, sf):
    """Documents as JSON lines in gzip, read back with their own keys."""
    at = Scratch(spark, "jsonl-source").at("lines")
    _pairs(spark, sf).write.option("compression", "gzip").json(at)
    return readers.from_jsonl(spark, at, key_column="source_key", prefix="in/").select("source_key", F.sha2("text", 256).alias("content"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS source_key, n_name || chr(10) AS text FROM nation")
def source_files(spark, sf):
    """A directory of text files, a document a file; the key is the path."""
    at = Scratch(spark, "files-source").at("nation")
    read(spark, sf, "nation").select(F.col("n_name").alias("value"), "n_nationkey").repartition(1).write.partitionBy("n_nationkey").text(at)
    return readers.from_files(spark, at, "*.txt").select(F.regexp_extract("source_key", r"^n_nationkey=(\d+)/", 1).alias("source_key"), "text")


@query("SELECT 'hf://corpus/default/train/' || vec_id AS source_key, CAST(vec_id AS VARCHAR) AS text FROM embeddings")
def source_table(spark, sf):
    """Rows of another reader with keys by a template."""
    rows = read(spark, sf, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("text"))
    return readers.from_table(rows, "vec_id", template="hf://corpus/default/train/{}")


@query("SELECT '13:conversations:' || conv_id || '/' || turn AS source_key, sha256(text) AS content FROM conversations")
def source_namespace(spark, sf):
    rows = read(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    return readers.from_namespace(rows, "conversations").select("source_key", F.sha2("text", 256).alias("content"))


@query(f"WITH {D} SELECT source_key, content FROM d ORDER BY source_key LIMIT 100")
def source_first(spark, sf):
    """A capture's limit: the first hundred by key."""
    return readers.first(_pairs(spark, sf), 100).select("source_key", F.sha2("text", 256).alias("content"))


@query(f"WITH {D} SELECT 'corpus' AS corpus_id, source_key, content, n_bytes, n_chars, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_lines FROM d")
def snapshot_reopen(spark, sf):
    """What a capture stored, opened by its name."""
    catalog = Catalog(spark, Scratch(spark, "catalog").at("root"))
    return catalog.open("corpus", catalog.capture("corpus", _pairs(spark, sf))).drop("doc_id", "text")


@query("""WITH p AS (SELECT 'conversations' AS corpus, text FROM conversations UNION ALL SELECT 'documents', coalesce(text, '') FROM documents) SELECT corpus, count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS added FROM p GROUP BY corpus""")
def catalog_listing(spark, sf):
    """Captured corpora with their counts."""
    catalog = Catalog(spark, Scratch(spark, "catalog").at("root"))
    catalog.capture("documents", _pairs(spark, sf))
    catalog.capture("conversations", readers.from_table(read(spark, sf, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn")), "key"))
    rows = [(m["corpus"], m["documents"], m["bytes"], m["added"]) for m in catalog.listing("corpora")]
    return spark.createDataFrame(rows, "corpus string, documents long, bytes long, added long")


_SHARDS = f"WITH {D}, k AS (SELECT * FROM d WHERE n_chars >= 100), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, sum(n_bytes) OVER (ORDER BY doc_id) - n_bytes AS before, text, n_chars FROM k)"


def _stored(spark, sf) -> str:
    at = Scratch(spark, "selection-sink").at("selection")
    sinks.write_selection(q.Query(docs(spark, sf), (q.where(fl.CHARACTERS >= 100),)).rows(), at, 100_000)
    return at


@query(_SHARDS + " SELECT doc_id, ordinal, CAST(before // 100000 AS BIGINT) AS shard FROM o")
def sink_selection(spark, sf):
    """A selection in shards of 100,000 bytes, read back."""
    return sinks.read_selection(spark, _stored(spark, sf)).select("doc_id", "ordinal", "shard")


@query(_SHARDS + " SELECT ordinal, doc_id, CAST(before // 100000 AS BIGINT) AS shard, text[1:1000] AS text, n_chars > 1000 AS truncated FROM o WHERE ordinal < 1000")
def sink_selection_preview(spark, sf):
    return sinks.read_preview(spark, _stored(spark, sf))


@query(f"WITH {D}, w AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM d) " + _LINEAGE.format(kind="duplicate"))
def sink_lineage(spark, sf):
    """Every decision as JSON lines, read back."""
    at, made = Scratch(spark, "lineage-sink").at("lineage"), q.Query(docs(spark, sf), (q.Dedupe(),)).lineage()
    sinks.write_lineage(made, at)
    return spark.read.schema(made.schema).json(at)


@query(f"WITH {_OCC}, s AS (SELECT unnest(range((SELECT total // 512 FROM t))) AS sequence) SELECT sequence, CAST(2048 AS BIGINT) AS data_bytes, CAST(512 AS BIGINT) AS mask_bytes, true AS intact FROM s")
def sink_token_shards(spark, sf):
    """Sequences as 32-bit words and masks; every digest is that of its bytes."""
    at = Scratch(spark, "shards-sink").at("shards")
    sinks.write_shards(_packed(spark, sf, pk.Concat(512, 256)), at)
    s = spark.read.parquet(at)
    return s.select("sequence", F.octet_length("data").cast("long").alias("data_bytes"), F.octet_length("mask").cast("long").alias("mask_bytes"), (F.sha2(F.concat("data", "mask"), 256) == F.col("digest")).alias("intact"))


# Orders, joins and cohorts


@query(f"WITH {D} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM d WHERE lang = 'en'")
def query_ordinals(spark, sf):
    """Final order and ordinals of what is retained."""
    return q.Query(docs(spark, sf), (q.where(LANG == "en"),)).numbered().select("doc_id", "ordinal")


@query(f"WITH {D} SELECT d.doc_id, l.quality AS q, l.toxic AS t FROM d LEFT JOIN labels l USING (doc_id)")
def field_coverage(spark, sf):
    """Values computed elsewhere; documents without any stay, with nulls."""
    values = read(spark, sf, "labels").select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t"))
    return producers.joined(docs(spark, sf).select("doc_id"), values, ("q", "t"))


@query(f"WITH {D}, c AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS cohort FROM d) SELECT doc_id, cohort, n_chars - max(n_chars) OVER (PARTITION BY cohort) AS below FROM c")
def field_cohorts(spark, sf):
    """A producer whose values depend on the 64 documents of its batch."""
    below = lambda rows: rows.assign(below=rows["n_chars"] - rows["n_chars"].max())[["doc_id", "cohort", "below"]]
    return producers.in_cohorts(docs(spark, sf).select("doc_id", "n_chars"), "doc_id", below, "doc_id long, cohort long, below long")


@query("WITH e AS (SELECT vec_id, [least(greatest(CAST(embedding[i] AS DOUBLE) * 8, 0), 1) FOR i IN [1, 2, 3, 4]] AS v FROM embeddings) SELECT vec_id, ['north', 'east', 'south', 'west'][list_position(v, list_max(v))] AS label FROM e")
def field_language_label(spark, sf):
    """Scores cut to 0 to 1; of equal ones the first."""
    return _logits(spark, sf).select("vec_id", producers.language_label(F.col("topic"), CLASSES).alias("label"))


@query("SELECT conv_id, round(sum(length(text) * (turn % 3)) / nullif(sum(turn % 3), 0), 6) AS mean FROM conversations GROUP BY conv_id")
def field_windowed_mean(spark, sf):
    """Scores of a document's windows, by weight; null where all weights are 0."""
    window = F.struct(F.length("text").cast("double").alias("score"), (F.col("turn") % 3).cast("double").alias("weight"))
    windows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(window)).alias("w"))
    return windows.select("conv_id", F.round(producers.windowed_mean(F.col("w")), 6).alias("mean"))


@query(f"WITH {D} SELECT doc_id, stratum, size FROM (SELECT doc_id, '[]' AS stratum, CAST(1 AS BIGINT) AS size FROM d)")
def sample_everything(spark, sf):
    """A fraction of one keeps every document once."""
    return _sample(spark, sf, "fraction", 1.0)


# More of mixtures


@query(f"WITH {D} SELECT CASE WHEN quality IS NULL THEN 'unlabelled' ELSE 'labelled' END AS label, count(*) AS documents, CAST(sum(n_bytes) AS BIGINT) AS tokens FROM d GROUP BY 1")
def mix_explicit_domains(spark, sf):
    """Domains from a table that names every document once."""
    d = docs(spark, sf)
    named = d.select("doc_id", F.when(F.col("quality").isNull(), "unlabelled").otherwise("labelled").alias("label"))
    return mx.inventory(mx.assigned(d, named), F.col("label"), F.col("n_bytes"))


@query(f"WITH {D}, {_SPLIT} SELECT doc_id, label, epoch, take FROM (SELECT d.doc_id, lang AS label, CAST(0 AS BIGINT) AS epoch, d.n_bytes AS take FROM d JOIN y ON y.doc_id = d.doc_id WHERE split = 'validation')")
def mix_held_out(spark, sf):
    """Validation documents once each, whatever the candidate."""
    return _mixture(spark, sf, splits=mx.Splits()).held_out("validation").select("doc_id", "label", "epoch", "take")


@query(f"WITH {D}, {_SPLIT} SELECT 0 AS candidate, lang AS label, round(sum(d.n_bytes) / (SELECT sum(n_bytes) FROM y WHERE split = 'train'), 6) AS weight, CAST(sum(d.n_bytes) AS BIGINT) AS tokens FROM d JOIN y ON y.doc_id = d.doc_id WHERE split = 'train' GROUP BY lang")
def mix_train_weights(spark, sf):
    """Natural weights and tokens of the training split alone."""
    return _mixture(spark, sf, splits=mx.Splits()).profile().withColumn("weight", F.round("weight", 6))


@query(f"WITH {_draw_sql(_QUARTERS, '100003')} SELECT label, CAST(0.25 AS DOUBLE) AS weight, any_value(target) AS requested, CAST(sum(take) AS BIGINT) AS realized, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM t JOIN al ON stratum = label GROUP BY label")
def mix_candidate_view(spark, sf):
    return _mixture(spark, sf, budget=100_003, weights=_EVEN, replacement=True)[0].profile()


# More of tokens and packing

_WORDS = '{"version": "1.0", "pre_tokenizer": {"type": "WhitespaceSplit"}, "model": {"type": "WordLevel", "vocab": {"?": 0}, "unk_token": "?"}}'


@query(f"WITH {D}, w AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+\\s*|\\s+') AS w FROM d) SELECT doc_id, CAST(len([x FOR x IN w IF regexp_matches(x, '\\S')]) AS BIGINT) AS n_tokens, CAST(list_sum([strlen(regexp_replace(x, '\\s+$', '')) FOR x IN w]) AS BIGINT) AS covered FROM w WHERE len(w) > 0")
def tokens_json_ranges(spark, sf):
    """A tokenizer.json of words: tokens, and the bytes that their source ranges cover."""
    encoded = tk.JsonTokenizer(_WORDS, 1 << 30).encode(docs(spark, sf).where("n_bytes > 0").select("doc_id", "text"), ranges=True)
    return encoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("covered"))


@query(f"WITH {_DL}, {_SPANS}, cuts AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS gone, CAST(sum(e * (e - 1) // 2 - s * (s - 1) // 2) AS BIGINT) AS places FROM c GROUP BY doc_id) SELECT d.doc_id, n_bytes - gone AS n_tokens, n_bytes * (n_bytes - 1) // 2 - places AS places FROM cuts JOIN d ON d.doc_id = cuts.doc_id")
def tokens_through_cuts(spark, sf):
    """Byte tokens of texts with spans removed, and the sum of their places in the source."""
    cut = dc.cut_spans(docs(spark, sf), bench(spark, sf), "line")
    encoded = tk.ByteTokenizer().encode(cut.select("doc_id", F.col("retained_text").alias("text"), F.col("ranges").alias("kept")), ranges=True)
    places = F.aggregate(F.flatten("sources"), F.lit(0).cast("long"), lambda a, r: a + r["start"])
    return tk.sourced(encoded).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), places.alias("places"))


@query(f"WITH {D} SELECT doc_id, n_bytes AS n_tokens FROM d WHERE lang = 'fr'")
def tokens_cached(spark, sf):
    """Tokens of a selection, encoded once and read from the cache the second time."""
    run, root = q.Query(docs(spark, sf), (q.where(LANG == "fr"),)), Scratch(spark, "token-cache").at("root")
    tk.cached(run.rows(), tk.ByteTokenizer(), root, run.identity)
    return tk.cached(run.rows(), tk.ByteTokenizer(), root, run.identity).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@query(f"WITH {_OCC}, n AS (SELECT total // 512 * 512 AS out FROM t), e AS (SELECT doc_id, start, least(start + size + 1, out) AS e FROM o, n), q AS (SELECT doc_id, unnest(range(CAST(start // 512 AS BIGINT), CAST((e - 1) // 512 + 1 AS BIGINT))) AS q FROM e WHERE e > start), c AS (SELECT q FROM q GROUP BY q HAVING count(DISTINCT doc_id) > 1) SELECT count(*) AS crossing FROM c")
def pack_crossings(spark, sf):
    """Sequences that hold a boundary between documents."""
    plan = pk.Concat(512, 256)
    kept, t = _placed(spark, sf, plan)
    return pk.crossings(kept, plan, t["output"])


@query(f"WITH {_OCC}, n AS (SELECT total // 512 * 512 AS out FROM t) SELECT corpus_id, CAST(sum(greatest(0, least(size, out - start))) AS BIGINT) AS tokens FROM o JOIN d ON d.doc_id = o.doc_id, n GROUP BY corpus_id")
def pack_source_tokens(spark, sf):
    """Emitted content tokens by corpus."""
    kept, _ = _placed(spark, sf, pk.Concat(512, 256))
    return pk.source_tokens(kept, docs(spark, sf))


@query(f"WITH {_OCC}, s AS (SELECT unnest(range(least(8, (SELECT total // 512 FROM t)))) AS sequence) SELECT sequence, CAST(256 AS BIGINT) AS n_tokens, true AS truncated FROM s")
def pack_preview(spark, sf):
    """The first 256 tokens of the first eight sequences; only their documents are encoded."""
    plan = pk.Concat(512, 256)
    kept, t = _placed(spark, sf, plan)
    out = pk.preview(kept, docs(spark, sf), tk.ByteTokenizer(), plan, t["output"], 8)
    return out.select("sequence", F.size("tokens").cast("long").alias("n_tokens"), "truncated")


@query(f"WITH {_OCC}, s AS (SELECT unnest(range((SELECT total // 512 FROM t))) AS sequence) SELECT sequence - 20 AS sequence FROM s WHERE sequence >= 20 AND sequence < 90")
def pack_window(spark, sf):
    """A split's window of sequences, numbered anew."""
    return pk.window(_packed(spark, sf, pk.Concat(512, 256)), 20, 90).select("sequence")


@query(f"WITH {_OCC}, s AS (SELECT unnest(range((SELECT total // 512 FROM t))) AS sequence) SELECT sequence, row_number() OVER (ORDER BY sha256('permute/5/' || sequence), sequence) - 1 AS place FROM s")
def pack_permuted(spark, sf):
    """A seeded order of the sequences."""
    mixed = pk.permuted(_packed(spark, sf, pk.Concat(512, 256)).select("sequence"), 5)
    return ranked(mixed, [F.col("order_key"), F.col("sequence")], Scratch(spark, "permuted"), "place").select("sequence", "place")


@query(f"WITH {_OCC}, n AS (SELECT total // 512 AS a, (total + 1023) // 1024 AS b FROM t) SELECT sequence, CASE WHEN sequence < a THEN 512 ELSE 1024 END AS n_tokens FROM (SELECT a, unnest(range(CAST(a + b AS BIGINT))) AS sequence FROM n)")
def pack_concatenated(spark, sf):
    """Two packings one after another; no sequence crosses from one to the other."""
    parts = []
    for plan in (pk.Concat(512, 256), pk.Concat(1024, 256, 257)):
        kept, t = _placed(spark, sf, plan)
        tokens = tk.ByteTokenizer().encode(docs(spark, sf).select("doc_id", "text")).select("doc_id", "tokens")
        parts.append((pk.sequences(kept, tokens, plan, t["output"]), t["sequences"]))
    return pk.concatenated(parts).select("sequence", F.size("tokens").alias("n_tokens"))


@query(f"WITH {_OCC}, s AS (SELECT unnest(range((SELECT total // 512 FROM t))) AS sequence) SELECT sequence FROM s WHERE sequence % 4 = 2 AND sequence > 10")
def reader_checkpoint(spark, sf):
    """What a reader still has to read after sequence 10, from its checkpoint document."""
    note = pk.Checkpoint("bytes-512", rank=1, world=2, workers=2).after(10).to_json()
    return pk.Checkpoint.from_json(note, "bytes-512").rest(_packed(spark, sf, pk.Concat(512, 256))).select("sequence")
