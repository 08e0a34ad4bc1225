"""Map the driver's tables onto the roles the operators work on.

Each function derives a role table (people, profiles, write log, requests,
commands) from the given tables with plain DataFrame expressions, so the work
grows with the data. The same rules are restated in SQL by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import LOAD_LABEL
from quire.operators.ordering import DEFAULT_CHUNK, ordered_last, ordered_rank
from quire.sources.tables import Tables

# Fixed values of the derivation (restated in the oracle SQL).
READER_SEGMENT = "FURNITURE"     # customers of this segment are readers
NO_EMAIL_NATION = 0              # users of this nation have no e-mail
BACKFILL_SEGMENT = "BUILDING"    # their profiles predate the e-mail column
WRITES_PER_VERSION = 4           # clients re-read the version every 4 writes
FORGED_KIND = "error"            # these writes claim version 999 / an author
RELOAD_KIND = "purchase"         # some of these reload their document
FORGED_VERSION = 999
FORGED_AUTHOR = "forjado"
EMPTY_DOCUMENT = '{"partners":[],"customers":[],"deals":[]}'


def user_email(c: DataFrame, n: DataFrame):
    """lower(segment) . lower(nation) - key @example.com; NULL for one nation."""
    local = F.concat(F.lower(c["c_mktsegment"]), F.lit("."), F.lower(n["n_name"]),
                     F.lit("-"), c["c_custkey"].cast("string"))
    return F.when(c["c_nationkey"] == NO_EMAIL_NATION, F.lit(None).cast("string")) \
        .otherwise(F.concat(local, F.lit("@example.com")))


def _customer_nation(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_name")
    # nation is a fixed 25-row dimension; Spark's size statistics broadcast it.
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(
        c["*"], n["n_name"], user_email(c, n).alias("email"))


def users(t: Tables) -> DataFrame:
    """auth users: id, email, raw_user_meta_data (JSON text), sign-in times."""
    cn = _customer_nation(t)
    name = F.col("c_name")
    seg = F.col("c_mktsegment")
    meta = (F.when(seg == "AUTOMOBILE", F.concat(F.lit('{"nome": "  '), name, F.lit('  ", "papel": " Leitor "}')))
            .when(seg == "BUILDING", F.concat(F.lit('{"name": "'), name, F.lit('", "role": "editor"}')))
            .when(seg == "FURNITURE", F.concat(F.lit('{"nome": "", "name": "'), name, F.lit('", "papel": "leitor"}')))
            .when(seg == "HOUSEHOLD", F.lit("{}"))
            .when(seg == "MACHINERY", F.lit('{"nome": null, "papel": "admin"}')))
    act = t.events.groupBy(F.col("user_id").alias("id")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_sign_in_at"))
    u = cn.select(F.col("c_custkey").alias("id"), "email", meta.alias("raw_user_meta_data"), seg.alias("segment"))
    u = u.join(act, "id", "left")
    return u.select(
        "id", "email", "raw_user_meta_data", "last_sign_in_at", "created_at",
        F.when(F.col("segment").isin("AUTOMOBILE", "BUILDING"), F.col("created_at")).alias("email_confirmed_at"),
        F.when(F.col("segment") == "HOUSEHOLD", F.col("last_sign_in_at")).alias("confirmed_at"))


def profiles(t: Tables) -> DataFrame:
    """Profiles as stored: customers in debit have none yet."""
    cn = _customer_nation(t).where(F.col("c_acctbal") >= 0)
    return cn.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("nome"),
        F.when(F.col("c_mktsegment") == READER_SEGMENT, F.lit("leitor")).otherwise(F.lit("editor")).alias("papel"),
        F.when(F.col("c_mktsegment") == BACKFILL_SEGMENT, F.lit(None).cast("string")).otherwise(F.col("email")).alias("email"),
        F.lit(False).alias("senha_provisoria"))


def document_payload(kind):
    """The document a write sends: one deal per character of its kind."""
    deals = F.transform(F.sequence(F.lit(1), F.length(kind)),
                        lambda i: F.struct(F.concat(kind, F.lit("-"), i.cast("string")).alias("id")))
    empty = F.array().cast("array<struct<id:string>>")
    return F.to_json(F.struct(empty.alias("partners"), empty.alias("customers"), deals.alias("deals")))


def writes(t: Tables, chunk_width: int = DEFAULT_CHUNK) -> DataFrame:
    """Write log: every event is an update of document ``props.k``.

    seq = event_id (unique, same order as ts); the expected version a client
    sends is 1 + (n-1) div 4 for the doc's n-th write; error events also claim
    version 999 and an author (both must be ignored).
    """
    e = t.events.select(
        F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"),
        F.col("event_id").alias("seq"), F.col("user_id").alias("actor"),
        F.col("ts"), F.col("event_type").alias("kind"))
    e = ordered_rank(e, "doc_id", "seq", "rn", chunk_width)
    return e.select(
        "doc_id", "seq", "actor", "ts", "kind",
        (F.lit(1) + F.floor((F.col("rn") - 1) / WRITES_PER_VERSION)).cast("int").alias("expected_version"),
        F.when(F.col("kind") == FORGED_KIND, F.lit(FORGED_VERSION)).cast("int").alias("claimed_version"),
        F.when(F.col("kind") == FORGED_KIND, F.lit(FORGED_AUTHOR)).alias("claimed_author"),
        F.length("kind").cast("bigint").alias("n_deals"),
        document_payload(F.col("kind")).alias("doc"))


def mixed_log(t: Tables, chunk_width: int = DEFAULT_CHUNK) -> DataFrame:
    """The write log with reloads in it: every fourth purchase (by event_id) loads
    its document anew. Clients count from the last load: the n-th write after it
    expects version 1 + (n-1) div 4; sign-ups send no expected version."""
    w = writes(t, chunk_width).drop("expected_version")
    w = w.withColumn("load", (F.col("kind") == RELOAD_KIND) & (F.col("seq") % 4 == 0))
    w = ordered_rank(w, "doc_id", "seq", "_rn", chunk_width)
    w = ordered_last(w, "doc_id", "seq", ["_rn"], "load", "_last", chunk_width)
    n = F.col("_rn") - F.coalesce("_last_rn", F.lit(0))
    expected = F.when(~F.col("load") & (F.col("kind") != "signup"), F.lit(1) + F.floor((n - 1) / WRITES_PER_VERSION))
    return w.withColumn("expected_version", expected.cast("int")).drop("_rn", "_last_rn", "_lastcount")


def operations(applied: DataFrame) -> DataFrame:
    """What applied writes (doc_id, seq, version, kind) do when they carry operations
    instead of documents: views and errors patch deals, sign-ups and clicks append,
    purchases patch customers or set all deals, some errors replace the document."""
    n, kind = F.col("seq"), F.col("kind")
    text = n.cast("string")

    def say(*parts):
        return F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    deal, customer = (n % 9).cast("string"), (n % 13).cast("string")
    sets, replaces = (kind == "purchase") & (n % 4 == 0), (kind == "error") & (n % 6 == 0)
    op = F.when(sets, "set").when(replaces, "replace").when(kind.isin("signup", "click"), "append").otherwise("patch")
    field = F.when(kind.isin("click", "purchase") & ~sets, "customers").when(~replaces, "deals")
    payload = F.when(sets, say('[{"x":', text, ',"id":"d1"},{"id":"d2"},', text, ']')) \
        .when(replaces, say('{"flag":', text, ',"deals":[]}')) \
        .when(kind == "signup", say('{"id":"d', deal, '","n":', text, "}")) \
        .when(kind == "click", say('{"s":"s', text, '","id":"c', customer, '"}')) \
        .when(kind == "purchase", say('{"id":"c', customer, '","z":null}')) \
        .otherwise(say('{"id":"d', deal, '","k', (n % 4).cast("string"), '":', text, ',"last":"', kind, '"}'))
    return applied.select("doc_id", "seq", "version", op.alias("op"), field.alias("field"), payload.alias("payload"))


def three_versions(applied: DataFrame) -> DataFrame:
    """Of each document the versions a third, two thirds and all of its writes on."""
    top = applied.groupBy("doc_id").agg(F.max("version").alias("top"))
    thirds = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: (F.floor((F.col("top") - 1) * i / 3) + 1).cast("int"))
    return top.select("doc_id", F.explode(thirds).alias("version")).distinct()


def given_base(w: DataFrame) -> DataFrame:
    """Current rows that a stream takes over: documents at versions 1 to 3."""
    b = base_documents(w)
    return b.withColumn("version", (F.lit(1) + F.col("doc_id") % 3).cast("int")) \
            .withColumn("epoch", (F.col("doc_id") % 2).cast("bigint"))


def base_documents(w: DataFrame) -> DataFrame:
    """Current rows before the log: every written key holds the empty default
    document at version 1, stamped by the initial load."""
    keys = w.select("doc_id").distinct()
    return keys.select("doc_id", F.lit(1).alias("version"), F.lit(EMPTY_DOCUMENT).alias("doc"),
                       F.lit(0).cast("bigint").alias("n_deals"),
                       F.lit(None).cast("timestamp_ntz").alias("updated_at"),
                       F.lit(LOAD_LABEL).alias("updated_by"))


def requests(t: Tables) -> DataFrame:
    """Access requests: (actor, verb, table). Error events come without a
    session (anonymous); the target table follows the event's key range."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    verb = (F.when(F.col("event_type") == "view", "select")
            .when(F.col("event_type") == "click", "update")
            .when(F.col("event_type") == "signup", "insert")
            .when(F.col("event_type") == "purchase", "delete")
            .otherwise("select"))
    tbl = F.when(k < 34, "perfil").when(k < 67, "pipeline").otherwise("pipeline_historico")
    return t.events.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("actor"),
        verb.alias("verb"), tbl.alias("tbl"))


def create_commands(t: Tables) -> DataFrame:
    """People commands: a document asks to create a person for every address
    (token holding '@') of its whole text; one without any asks with ''."""
    d = t.documents.select("doc_id", "lang", "source",
                           F.regexp_extract_all("text", F.lit(r"\S+@\S+"), 0).alias("found"))
    d = d.withColumn("email", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.lit("")))))
    return d.select(
        F.col("doc_id").alias("id"), "email",
        F.when(F.col("lang") == "en", F.concat(F.lit("  "), F.col("source"), F.lit(" ")))
         .otherwise(F.lit("   ")).alias("nome"),
        F.when(F.col("lang") == "en", "editor").when(F.col("lang") == "fr", "leitor")
         .when(F.col("lang") == "de", "Leitor").alias("papel"))


def profile_changes(t: Tables) -> DataFrame:
    """Partial profile updates from labels: good docs rename, toxic ones
    demote to reader; a toxic low-quality row lost its id."""
    l = t.labels.select("doc_id", "quality", "toxic")
    return l.select(
        F.col("doc_id").alias("cmd_id"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit(None).cast("bigint"))
         .otherwise(F.col("doc_id")).alias("id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("  Pessoa "), F.col("doc_id").cast("string"), F.lit(" ")))
         .otherwise(F.lit(" ")).alias("nome"),
        F.when(F.col("toxic") == 1, "leitor").otherwise("gestor").alias("papel"))


#: People that the commands of repeated targets are about.
FEW_PEOPLE = 40


def repeated_changes(t: Tables) -> DataFrame:
    """Several partial updates per person: label n is about person n mod 40. Good
    rows set the name, toxic ones the role, the others send what is not valid."""
    l = t.labels.select("doc_id", "quality", "toxic")
    return l.select(
        F.col("doc_id").alias("cmd_id"), (F.col("doc_id") % FEW_PEOPLE).alias("id"),
        F.when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), F.concat(F.lit(" Pessoa "), F.col("doc_id").cast("string")))
         .otherwise(F.lit(" ")).alias("nome"),
        F.when(F.col("toxic") == 1, "leitor").when(F.col("doc_id") % 7 == 0, "editor").otherwise("gestor").alias("papel"))


def people_log(t: Tables) -> DataFrame:
    """Commands that create, update and remove the same few people again and again,
    some without an id, with a bad address, on themselves or of no known kind."""
    n = F.col("doc_id")
    l = repeated_changes(t).withColumnRenamed("cmd_id", "doc_id").join(t.labels.select("doc_id", "quality"), "doc_id")
    kind = F.element_at(F.array(*[F.lit(a) for a in ("criar", "perfil", "perfil", "senha", "remover")]),
                        (F.expr("(doc_id div 40 + doc_id) % 5") + 1).cast("int"))
    return l.select(
        n.alias("cmd_id"), F.when(n % 47 == 0, "outra").otherwise(kind).alias("acao"),
        F.when(n % 23 != 1, F.col("id")).alias("id"), F.when(F.col("quality") == 0, F.col("id")).alias("actor"), "nome", "papel",
        F.when(n % 11 == 0, "sem endereco").otherwise(F.concat(F.lit(" p"), n.cast("string"), F.lit("@example.com"))).alias("email"))


def repeated_removals(t: Tables) -> DataFrame:
    """Removal requests that name the same people again and again, some their own."""
    l = t.labels.select("doc_id", "quality")
    return l.select(F.col("doc_id").alias("request_id"), (F.col("doc_id") % FEW_PEOPLE).alias("target"),
                    F.when(F.col("quality") == 0, F.col("doc_id") % FEW_PEOPLE).otherwise(F.lit(-1)).cast("bigint").alias("actor"))


def name_commands(t: Tables) -> DataFrame:
    """Commands by name whose renames chain: label n renames the bearer of
    customer n's name to that of customer n + 3 (good rows), or sets a role."""
    l = t.labels.select("doc_id", "quality", "toxic")

    def name(k):
        return F.concat(F.lit("Customer#"), F.lpad((k).cast("string"), 9, "0"))
    return l.select(
        F.col("doc_id").alias("seq"), name(F.col("doc_id")).alias("nome"),
        F.when(F.col("toxic") == 1, "leitor").when(F.col("doc_id") % 5 == 0, "editor").alias("papel"),
        F.when(F.col("quality") == 1, name(F.col("doc_id") + 3)).alias("novo_nome"))


def history_log(t: Tables) -> DataFrame:
    """Version history of conversation documents: turn n is version n+1,
    authored by the turn's role; the whole text is the document."""
    c = t.conversations.select("conv_id", "turn", "role", "text")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("version"),
                    F.col("role").alias("updated_by"), F.col("text").alias("doc"))


def flag_events(t: Tables) -> DataFrame:
    """Provisional-flag events: sign-up = created by the admin (true), error =
    password set by the admin (true), view = the person changed it (false)."""
    e = t.events.select("event_id", "ts", "user_id", "event_type")
    flag = (F.when(F.col("event_type").isin("signup", "error"), F.lit(True))
            .when(F.col("event_type") == "view", F.lit(False)))
    return e.select("event_id", "ts", "user_id", flag.alias("flag")).where(F.col("flag").isNotNull())


def removal_requests(t: Tables) -> DataFrame:
    """Removal requests from toxic labels: the admin (actor -1) removes the
    labelled person; low-quality rows were filed by the person themself."""
    l = t.labels.where(F.col("toxic") == 1).select("doc_id", "quality")
    return l.select(F.col("doc_id").alias("request_id"), F.col("doc_id").alias("target"),
                    F.when(F.col("quality") == 0, F.col("doc_id")).otherwise(F.lit(-1)).cast("bigint").alias("actor"))


def first_order_per_customer(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.min("o_orderkey").alias("first_order"))


def label_patches(t: Tables) -> DataFrame:
    """Per labelled document: the deal id its change script targets. Good
    labels bring a new deal; the others re-send the document's first order
    (which exists, so the guarded append must skip it)."""
    l = t.labels.select("doc_id", "quality", "toxic")
    j = l.join(first_order_per_customer(t), "doc_id", "left")
    new_id = F.when((F.col("quality") == 1) | F.col("first_order").isNull(),
                    F.concat(F.lit("N-L"), F.col("doc_id").cast("string"))) \
              .otherwise(F.concat(F.lit("N-"), F.col("first_order").cast("string")))
    return j.select("doc_id", "quality", "toxic", "first_order", new_id.alias("deal_id"))


def scenario_steps(t: Tables, w: DataFrame) -> DataFrame:
    """Every request as a scripted step on document ``props.k``: pipeline
    updates carry the write log's expected version and claims."""
    r = requests(t)
    ww = w.select(F.col("seq").alias("request_id"), "doc_id", "expected_version", "claimed_version",
                  "claimed_author", "n_deals")
    j = r.join(ww, "request_id", "inner")
    upd = F.col("verb") == "update"
    return j.select(F.col("request_id").alias("step"), "doc_id", "actor", "verb", "tbl",
                    F.when(upd, F.col("expected_version")).alias("expected_version"),
                    F.when(upd, F.col("claimed_version")).alias("claimed_version"),
                    F.when(upd, F.col("claimed_author")).alias("claimed_author"),
                    F.when(upd, F.col("n_deals")).alias("n_deals"))
