"""Access decisions: row policies and grants re-aimed as DataFrame jobs
(A1, X1-X4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ordering import DEFAULT_CHUNK

TABLES = ("perfil", "pipeline", "pipeline_historico")
ALLOWED, NO_ROWS, DENIED = "allowed", "no_rows", "denied"

# Grants + policies of the studied schema. Signed-in actors may
# read the three tables; only an editor's update of the pipeline reaches a
# row (anyone else's update matches no row); everything else has no grant.
# Anonymous actors have no grant at all; the service key bypasses policies.
RULES = [
    ("authenticated", "perfil", "select", "all"),
    ("authenticated", "pipeline", "select", "all"),
    ("authenticated", "pipeline_historico", "select", "all"),
    ("authenticated", "pipeline", "update", "editor"),
]


def rules_frame(spark: SparkSession) -> DataFrame:
    # Four fixed rows: broadcasting them is bounded by construction.
    return F.broadcast(spark.createDataFrame(RULES, "actor_class string, tbl string, verb string, row_rule string"))


def actor_class(actor_col="actor", service_col=None):
    """service (key holder, checked first) / anon (no session) / authenticated."""
    anon = F.when(F.col(actor_col).isNull(), F.lit("anon")).otherwise(F.lit("authenticated"))
    if service_col is None:
        return anon
    return F.when(F.coalesce(F.col(service_col), F.lit(False)), F.lit("service")).otherwise(anon)


def access_outcomes(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Request (request_id, actor, verb, tbl[, service]) -> outcome:
    'allowed', 'no_rows' (policy filters every row: 0 rows, no error) or
    'denied' (no grant). The role is the actor's profile role (J3)."""
    spark = requests.sparkSession
    service = "service" if "service" in requests.columns else None
    r = requests.withColumn("actor_class", actor_class("actor", service))
    p = profiles.select(F.col("id").alias("_pid"), F.col("papel").alias("role"))
    r = r.join(p, r["actor"] == p["_pid"], "left").drop("_pid")
    r = r.join(rules_frame(spark), ["actor_class", "tbl", "verb"], "left")
    outcome = (F.when(F.col("actor_class") == "service", F.lit(ALLOWED))
               .when(F.col("row_rule").isNull(), F.lit(DENIED))
               .when(F.col("row_rule") == "all", F.lit(ALLOWED))
               .when(F.col("role") == "editor", F.lit(ALLOWED))
               .otherwise(F.lit(NO_ROWS)))
    return r.withColumn("outcome", outcome).drop("row_rule")


def table_sizes(profiles: DataFrame, current: DataFrame, history: DataFrame) -> DataFrame:
    """Row count per table (three partial counts, unioned: 3 rows)."""
    def n(df, name):
        return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).withColumn("tbl", F.lit(name))
    return n(profiles, "perfil").unionByName(n(current, "pipeline")).unionByName(n(history, "pipeline_historico"))


def _grid(sizes: DataFrame, spark: SparkSession) -> DataFrame:
    """(actor_class, tbl, visible_rows): 3 tables x 2 classes = 6 rows."""
    t = spark.createDataFrame([(x,) for x in TABLES], "tbl string")
    anon = t.select(F.lit("anon").alias("actor_class"), "tbl", F.lit(0).cast("bigint").alias("visible_rows"))
    auth = sizes.select(F.lit("authenticated").alias("actor_class"), "tbl", F.col("rows").alias("visible_rows"))
    return F.broadcast(anon.unionByName(auth))


def row_counts(sizes: DataFrame, kinds: DataFrame) -> DataFrame:
    """A1: ``count(*)`` of each table as seen by each kind of actor
    (kinds: actor_kind, actor_class). Signed-in kinds see every row (the
    select policies are ``using (true)``), anonymous ones none."""
    g = _grid(sizes, kinds.sparkSession)
    return kinds.join(g, "actor_class", "inner").select("actor_kind", "tbl", F.col("visible_rows").alias("n"))


#: Labels of the report's count lines (fixed values).
COUNT_LABELS = {"perfil": "perfil    -> ", "pipeline": "pipeline  -> ", "pipeline_historico": "historico -> "}


def count_lines(counts: DataFrame) -> DataFrame:
    """The lines ``table -> n linhas`` of each kind of actor, from A1."""
    label = F.create_map(*[F.lit(x) for pair in COUNT_LABELS.items() for x in pair])
    return counts.select("actor_kind", "tbl", F.concat(F.try_element_at(label, F.col("tbl")), F.col("n").cast("string"), F.lit(" linhas")).alias("line"))


def document_lines(current: DataFrame, history: DataFrame) -> DataFrame:
    """Per document the lines of what a reader and an editor read, of the
    state after a write, of the history's size and of the result."""
    kept = history.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_h"))
    j = current.join(kept, "doc_id", "left")
    version = F.concat(F.lit("versao "), F.col("version").cast("string"))
    author = F.concat(F.lit(", autor "), F.coalesce("updated_by", F.lit("?")))
    deals = F.concat(F.lit(", negocios "), F.col("n_deals").cast("string"))
    lines = [("editor_reads", F.concat(F.lit("le o pipeline -> "), version, deals)),
             ("after_write", F.concat(F.lit("depois de gravar -> "), version, author, deals)),
             ("history_kept", F.concat(F.lit("historico guardou -> "), F.coalesce("_h", F.lit(0)).cast("string"), F.lit(" versao(oes)"))),
             ("result", F.concat(F.lit("resultado -> "), version, author)),
             ("reader_reads", F.concat(F.lit("le o pipeline -> "), version))]
    return j.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("step"), x.alias("line")) for k, x in lines])).alias("_l")) \
            .select("doc_id", "_l.step", "_l.line")


def visible_rows(actors: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each actor and table, how many rows the actor can read.

    Equi-join on the actor class with the 6-row grid, so the output is 3 rows
    per actor, never rows x actors."""
    g = _grid(sizes, actors.sparkSession)
    a = actors.select("actor").distinct().withColumn("actor_class", actor_class("actor"))
    return a.join(g, "actor_class", "inner").select("actor", "tbl", "visible_rows")


def history_immutability(outcomes: DataFrame) -> DataFrame:
    """insert/delete requests on the history table and how many were
    allowed (expected: none)."""
    h = outcomes.where((F.col("tbl") == "pipeline_historico") & F.col("verb").isin("insert", "delete"))
    return h.groupBy("verb").agg(F.count(F.lit(1)).alias("requests"),
                                 F.count_if(F.col("outcome") == ALLOWED).alias("allowed"))


def scenario_report(steps: DataFrame, profiles: DataFrame, base: DataFrame, chunk_width: int = DEFAULT_CHUNK) -> DataFrame:
    """A scripted sequence of requests against the document table.

    ``steps``: step (order), doc_id, actor (NULL = anonymous), verb, tbl,
    expected_version (NULL = no version predicate), claimed_version,
    claimed_author, n_deals (size of the document an update sends).
    Every step goes through the grants/policies (X2); pipeline updates that
    pass go through V4 -> V5 -> stamping. Each step reports its outcome and
    the document as the actor would read it afterwards: version, author,
    deals, and the history rows so far (NULL where the actor is denied).
    """
    from quire.operators.ordering import ordered_last
    from quire.operators.versions import (APPLIED, author_name, ignore_claimed_fields,
                                          resolve_conflicts)

    req = steps.withColumnRenamed("step", "request_id")
    acc = access_outcomes(req, profiles)
    upd = acc.where((F.col("tbl") == "pipeline") & (F.col("verb") == "update") & (F.col("outcome") == ALLOWED))
    w = ignore_claimed_fields(upd.select("doc_id", F.col("request_id").alias("seq"), "actor", "expected_version",
                                         "n_deals", F.lit(True).alias("eligible")))
    res = author_name(resolve_conflicts(w, base, chunk_width), profiles) \
        .select("seq", F.col("outcome").alias("_wo"), F.col("version").alias("_wv"), F.col("author").alias("_wa"))
    j = acc.join(res, acc["request_id"] == res["seq"], "left").drop("seq")
    j = j.withColumn("outcome", F.coalesce(F.col("_wo"), F.col("outcome"))) \
         .withColumn("_applied", F.coalesce(F.col("_wo") == APPLIED, F.lit(False)))
    s = ordered_last(j, "doc_id", "request_id", ["_wv", "_wa", "n_deals"], "_applied", "cur_", chunk_width)
    b = base.select("doc_id", F.col("version").alias("_bv"), F.col("updated_by").alias("_ba"),
                    F.col("n_deals").alias("_bd"))
    s = s.join(b, "doc_id", "left")
    seen = F.col("actor_class") != "anon"
    return s.select(
        F.col("request_id").alias("step"), "actor", "verb", "tbl", "outcome",
        F.when(seen, F.coalesce("cur__wv", "_bv")).alias("version"),
        F.when(seen, F.coalesce("cur__wa", "_ba")).alias("author"),
        F.when(seen, F.coalesce("cur_n_deals", "_bd")).alias("deals"),
        F.when(seen, F.col("cur_count")).alias("history"))
