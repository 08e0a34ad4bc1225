"""Oracle SQL (DuckDB dialect) restating every registered query.

The role derivations of ``quire.sources.roles`` are restated once as CTEs and
composed into each query, so a mismatch points at the operator, not at the
fixture.
"""

from __future__ import annotations

# ------------------------------------------------------------------ role CTEs
CN = """cn AS (
  SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, n.n_name,
         CASE WHEN c.c_nationkey = 0 THEN NULL
              ELSE lower(c.c_mktsegment) || '.' || lower(n.n_name) || '-' || CAST(c.c_custkey AS VARCHAR) || '@example.com'
         END AS email
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

PROFILES_ONLY = """profiles AS (
  SELECT c_custkey AS id, c_name AS nome,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN 'leitor' ELSE 'editor' END AS papel,
         CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE email END AS email,
         false AS senha_provisoria
  FROM cn WHERE c_acctbal >= 0)"""
PROFILES = CN + ",\n" + PROFILES_ONLY

USERS = CN + """,
act AS (SELECT user_id AS id, min(ts) AS created_at, max(ts) AS last_sign_in_at FROM events GROUP BY user_id),
users AS (
  SELECT cn.c_custkey AS id, cn.email,
         CASE cn.c_mktsegment
           WHEN 'AUTOMOBILE' THEN '{"nome": "  ' || cn.c_name || '  ", "papel": " Leitor "}'
           WHEN 'BUILDING' THEN '{"name": "' || cn.c_name || '", "role": "editor"}'
           WHEN 'FURNITURE' THEN '{"nome": "", "name": "' || cn.c_name || '", "papel": "leitor"}'
           WHEN 'HOUSEHOLD' THEN '{}'
           WHEN 'MACHINERY' THEN '{"nome": null, "papel": "admin"}'
         END AS raw_user_meta_data,
         act.last_sign_in_at, act.created_at,
         CASE WHEN cn.c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN act.created_at END AS email_confirmed_at,
         CASE WHEN cn.c_mktsegment = 'HOUSEHOLD' THEN act.last_sign_in_at END AS confirmed_at
  FROM cn LEFT JOIN act ON cn.c_custkey = act.id)"""

WRITES = """w0 AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id, event_id AS seq,
         user_id AS actor, ts, event_type AS kind
  FROM events),
writes AS (
  SELECT doc_id, seq, actor, ts, kind,
         CAST(1 + (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) // 4 AS INTEGER) AS expected_version,
         CASE WHEN kind = 'error' THEN 999 END AS claimed_version,
         CASE WHEN kind = 'error' THEN 'forjado' END AS claimed_author,
         CAST(length(kind) AS BIGINT) AS n_deals
  FROM w0)"""

GATED = PROFILES + ",\n" + WRITES + """,
gated AS (
  SELECT w.*, coalesce(p.nome, 'desconhecido') AS author,
         coalesce(p.papel = 'editor', false) AS eligible
  FROM writes w LEFT JOIN profiles p ON w.actor = p.id)"""

# V5 as the literal per-document fold (recursive CTE over the log order).
RESOLVED = GATED + """,
seqd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM gated),
fold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS rn, 1 AS ver, CAST(NULL AS VARCHAR) AS outcome,
         CAST(NULL AS INTEGER) AS version
  FROM (SELECT DISTINCT doc_id FROM gated)
  UNION ALL
  SELECT s.doc_id, s.rn,
         CASE WHEN s.eligible AND coalesce(s.expected_version = f.ver, true) THEN f.ver + 1 ELSE f.ver END,
         CASE WHEN NOT s.eligible THEN 'forbidden'
              WHEN coalesce(s.expected_version = f.ver, true) THEN 'applied' ELSE 'conflict' END,
         CASE WHEN s.eligible AND coalesce(s.expected_version = f.ver, true) THEN f.ver + 1 END
  FROM fold f JOIN seqd s ON s.doc_id = f.doc_id AND s.rn = f.rn + 1),
resolved AS (
  SELECT s.doc_id, s.seq, s.actor, s.ts, s.kind, s.expected_version, s.n_deals, s.author,
         s.eligible, f.outcome, f.version
  FROM seqd s JOIN fold f ON s.doc_id = f.doc_id AND s.rn = f.rn),
stamped AS (
  SELECT doc_id, seq, version, n_deals, ts AS updated_at, author AS updated_by, kind
  FROM resolved WHERE outcome = 'applied'),
history AS (
  SELECT seq AS hist_id, doc_id,
         CASE WHEN rk = 1 THEN 1 ELSE pv END AS version,
         CASE WHEN rk = 1 THEN CAST(0 AS BIGINT) ELSE pn END AS n_deals,
         CASE WHEN rk = 1 THEN NULL ELSE pa END AS updated_at,
         CASE WHEN rk = 1 THEN 'carga inicial' ELSE pb END AS updated_by,
         CASE WHEN rk = 1 THEN NULL ELSE pk END AS kind
  FROM (SELECT *, row_number() OVER w AS rk, lag(version) OVER w AS pv, lag(n_deals) OVER w AS pn,
               lag(updated_at) OVER w AS pa, lag(updated_by) OVER w AS pb, lag(kind) OVER w AS pk
        FROM stamped WINDOW w AS (PARTITION BY doc_id ORDER BY seq)))"""


def with_ctes(ctes: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + "\n" + body


ORACLE: dict[str, str] = {}

ORACLE["e1_history_listing"] = with_ctes(RESOLVED, """
SELECT doc_id, version, updated_at, updated_by, n_deals AS deals FROM history""", recursive=True)

ORACLE["v5_resolve_conflicts"] = with_ctes(RESOLVED, """
SELECT doc_id, seq, actor, expected_version, eligible, outcome, version FROM resolved""", recursive=True)

# Current rows after the log: last applied write per document, else base.
CURRENT = """,
docs0 AS (SELECT DISTINCT doc_id FROM writes),
cur AS (
  SELECT d.doc_id,
         coalesce(s.version, 1) AS version,
         coalesce(s.n_deals, CAST(0 AS BIGINT)) AS n_deals,
         s.updated_at,
         coalesce(s.updated_by, 'carga inicial') AS updated_by
  FROM docs0 d LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rk FROM stamped) WHERE rk = 1
  ) s ON d.doc_id = s.doc_id)"""

# The document a write sends, as text, from the kind of its event.
DOC_TEXT = """CASE WHEN kind IS NULL THEN '{"partners":[],"customers":[],"deals":[]}'
       ELSE '{"partners":[],"customers":[],"deals":[' || array_to_string(list_transform(range(1, length(kind) + 1),
            lambda i: '{"id":"' || kind || '-' || CAST(i AS VARCHAR) || '"}'), ',') || ']}' END"""

ORACLE["v2_before_images"] = with_ctes(RESOLVED, """
SELECT hist_id, doc_id, version, """ + DOC_TEXT + """ AS doc, n_deals AS deals, updated_at, updated_by FROM history""",
                                       recursive=True)
ORACLE["v2_before_images_chunked"] = ORACLE["v2_before_images"]
ORACLE["v5_resolve_conflicts_chunked"] = ORACLE["v5_resolve_conflicts"]

ORACLE["v3_stamp_author_time"] = with_ctes(RESOLVED, """
SELECT doc_id, seq, version, updated_at, updated_by FROM stamped""", recursive=True)

ORACLE["v7_current_snapshot"] = with_ctes(RESOLVED + CURRENT, """
SELECT doc_id, version, n_deals AS deals, updated_at, updated_by FROM cur""", recursive=True)

ORACLE["v8_noop_write_report"] = with_ctes(RESOLVED, """
SELECT s.doc_id, s.version, coalesce(s.kind = h.kind, false) AS unchanged
FROM stamped s JOIN history h ON h.hist_id = s.seq""", recursive=True)

ORACLE["v4_claims_overridden"] = with_ctes(RESOLVED, """
SELECT w.doc_id, w.seq, w.claimed_version, w.claimed_author,
       s.version AS stamped_version, s.updated_by AS stamped_author
FROM writes w JOIN stamped s ON w.seq = s.seq
WHERE w.claimed_version <> s.version OR w.claimed_author <> s.updated_by""", recursive=True)

ORACLE["v1_stamp_versions"] = with_ctes(GATED, """
SELECT doc_id, seq, CAST(1 + row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INTEGER) AS version
FROM gated WHERE eligible""")

ORACLE["v1_stamp_versions_chunked"] = ORACLE["v1_stamp_versions"]

ORACLE["j2_author_name"] = with_ctes(GATED, """
SELECT doc_id, seq, actor, author FROM gated""")

ORACLE["j3_write_gate"] = with_ctes(GATED, """
SELECT doc_id, seq, actor, eligible FROM gated""")

ORACLE["p8_status_lines"] = with_ctes(RESOLVED + CURRENT, """
SELECT doc_id, 'versao ' || CAST(version AS VARCHAR) || ', autor ' || coalesce(updated_by, '?')
       || ', negocios ' || CAST(n_deals AS VARCHAR) AS line
FROM cur""", recursive=True)

ORACLE["p8_document_lines"] = with_ctes(RESOLVED + CURRENT, """,
h AS (SELECT doc_id, count(*) AS n FROM history GROUP BY doc_id),
x AS (
  SELECT cur.doc_id, 'versao ' || CAST(version AS VARCHAR) AS v, ', autor ' || coalesce(updated_by, '?') AS a,
         ', negocios ' || CAST(n_deals AS VARCHAR) AS d, CAST(coalesce(h.n, 0) AS VARCHAR) AS n
  FROM cur LEFT JOIN h ON cur.doc_id = h.doc_id)
SELECT doc_id, 'editor_reads' AS step, 'le o pipeline -> ' || v || d AS line FROM x
UNION ALL SELECT doc_id, 'after_write', 'depois de gravar -> ' || v || a || d FROM x
UNION ALL SELECT doc_id, 'history_kept', 'historico guardou -> ' || n || ' versao(oes)' FROM x
UNION ALL SELECT doc_id, 'result', 'resultado -> ' || v || a FROM x
UNION ALL SELECT doc_id, 'reader_reads', 'le o pipeline -> ' || v FROM x""", recursive=True)

ORACLE["l1_sort_by_version"] = """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS version, role AS updated_by,
       CAST(length(text) AS BIGINT) AS chars
FROM conversations"""

ORACLE["v7_conversation_snapshot"] = """
SELECT doc_id, version, updated_by, chars FROM (
  SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS version, role AS updated_by,
         CAST(length(text) AS BIGINT) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk
  FROM conversations) WHERE rk = 1"""

ORACLE["v9_provisional_flag"] = with_ctes(PROFILES, """,
fe AS (
  SELECT user_id, CASE WHEN event_type IN ('signup', 'error') THEN true ELSE false END AS flag,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk
  FROM events WHERE event_type IN ('signup', 'error', 'view'))
SELECT p.id, coalesce(fe.flag, p.senha_provisoria, false) AS provisional
FROM profiles p LEFT JOIN fe ON p.id = fe.user_id AND fe.rk = 1""")

ORACLE["a4_last_wins_by_key"] = """
SELECT user_id, event_id, event_type FROM (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rk
  FROM events) WHERE rk = 1"""

# ------------------------------------------------------------------ reloads
# The log with reloads, folded literally: a load sets version 1 and a new epoch.
RELOADED = PROFILES + """,
m0 AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id, event_id AS seq, user_id AS actor, ts, event_type AS kind,
         event_type = 'purchase' AND event_id % 4 = 0 AS load
  FROM events),
m1 AS (SELECT *, sum(CAST(load AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY seq) AS part,
              row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM m0),
mixed AS (
  SELECT m.*, CASE WHEN NOT load AND kind <> 'signup'
                   THEN CAST(1 + (row_number() OVER (PARTITION BY doc_id, part ORDER BY seq) - 1
                                  - CASE WHEN part > 0 THEN 1 ELSE 0 END) // 4 AS INTEGER) END AS expected_version,
         coalesce(p.nome, 'desconhecido') AS author, coalesce(p.papel = 'editor', false) AS eligible,
         CAST(length(kind) AS BIGINT) AS n_deals
  FROM m1 m LEFT JOIN profiles p ON m.actor = p.id),
mfold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS rn, CAST(1 + doc_id % 3 AS INTEGER) AS ver, doc_id % 2 AS epoch,
         CAST(NULL AS VARCHAR) AS outcome
  FROM (SELECT DISTINCT doc_id FROM mixed)
  UNION ALL
  SELECT s.doc_id, s.rn,
         CASE WHEN s.load THEN 1 WHEN s.eligible AND coalesce(s.expected_version = f.ver, true) THEN f.ver + 1 ELSE f.ver END,
         f.epoch + CAST(s.load AS INTEGER),
         CASE WHEN s.load THEN 'loaded' WHEN NOT s.eligible THEN 'forbidden'
              WHEN coalesce(s.expected_version = f.ver, true) THEN 'applied' ELSE 'conflict' END
  FROM mfold f JOIN mixed s ON s.doc_id = f.doc_id AND s.rn = f.rn + 1),
mresolved AS (
  SELECT s.doc_id, s.seq, s.expected_version, s.load, f.outcome, CASE WHEN f.outcome IN ('applied', 'loaded') THEN f.ver END AS version,
         f.epoch, s.n_deals, s.kind, s.ts AS updated_at, CASE WHEN s.load THEN 'carga inicial' ELSE s.author END AS updated_by
  FROM mixed s JOIN mfold f ON s.doc_id = f.doc_id AND s.rn = f.rn),
mimages AS (
  SELECT * FROM mresolved WHERE outcome IN ('applied', 'loaded')
  UNION ALL
  SELECT doc_id, -1, NULL, true, 'base', CAST(1 + doc_id % 3 AS INTEGER), doc_id % 2, 0, NULL, NULL, 'carga inicial'
  FROM (SELECT DISTINCT doc_id FROM mixed)),
mhistory AS (
  SELECT * FROM (
    SELECT doc_id, seq, load, lag(epoch) OVER w AS epoch, lag(version) OVER w AS version, lag(updated_at) OVER w AS updated_at,
           lag(updated_by) OVER w AS updated_by, lag(n_deals) OVER w AS n_deals, lag(kind) OVER w AS kind
    FROM mimages WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) WHERE NOT load),
mcurrent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rk FROM mimages) WHERE rk = 1)"""

ORACLE["s2_reload_outcomes"] = with_ctes(RELOADED, """
SELECT doc_id, seq, expected_version, load, outcome, version FROM mresolved""", recursive=True)
ORACLE["s2_reload_outcomes_chunked"] = ORACLE["s2_reload_outcomes"]

ORACLE["s2_reload_history"] = with_ctes(RELOADED, """
SELECT doc_id, epoch, version, updated_at, updated_by, n_deals AS deals, """ + DOC_TEXT + """ AS doc FROM mhistory""", recursive=True)
ORACLE["s2_reload_history_chunked"] = ORACLE["s2_reload_history"]

ORACLE["t1_stream_trigger"] = with_ctes(RELOADED, """
SELECT 'write' AS kind, doc_id, seq, outcome, CAST(NULL AS BIGINT) AS epoch, version, CAST(NULL AS TIMESTAMP) AS updated_at,
       CAST(NULL AS VARCHAR) AS updated_by, CAST(NULL AS VARCHAR) AS doc FROM mresolved
UNION ALL
SELECT 'before', doc_id, seq, NULL, epoch, version, updated_at, updated_by, """ + DOC_TEXT + """ FROM mhistory
UNION ALL
SELECT 'now', doc_id, NULL, NULL, epoch, version, updated_at, updated_by, """ + DOC_TEXT + """ FROM mcurrent""", recursive=True)

ORACLE["s2_reload_current"] = with_ctes(RELOADED, """
SELECT doc_id, epoch, version, n_deals AS deals, updated_at, updated_by, """ + DOC_TEXT + """ AS doc FROM mcurrent""", recursive=True)

# ------------------------------------------------------------------ documents
DOC_DEALS = """sup AS (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey),
deals AS (
  SELECT o.o_custkey AS doc_id, o.o_orderkey AS pk, 'N-' || CAST(o.o_orderkey AS VARCHAR) AS id,
         o.o_orderpriority AS frente,
         CASE o.o_orderstatus WHEN 'F' THEN '9' WHEN 'O' THEN '2' ELSE 'perdido' END AS etapa,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN ''
              ELSE CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS VARCHAR) END AS valor,
         'C-' || CAST(o.o_custkey AS VARCHAR) AS cliente_id,
         'P-' || CAST(sup.s AS VARCHAR) AS parceiro_id,
         substr(o.o_orderpriority, 3) AS responsavel,
         strftime(o.o_orderdate, '%Y-%m-%d') AS prazo,
         CASE WHEN o.o_orderstatus = 'F' THEN strftime(o.o_orderdate, '%Y-%m-%d') END AS fechado_em
  FROM orders o LEFT JOIN sup ON o.o_orderkey = sup.l_orderkey),
items AS (
  SELECT o.o_custkey AS doc_id, 'N-' || CAST(l.l_orderkey AS VARCHAR) AS deal_id,
         CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
              l.l_shipdate, l.l_returnflag, l.l_linestatus) - 1 AS BIGINT) AS pos,
         CAST(l.l_linenumber AS VARCHAR) AS id, 'part ' || CAST(l.l_partkey AS VARCHAR) AS texto,
         'supplier-' || CAST(l.l_suppkey AS VARCHAR) AS responsavel,
         strftime(l.l_shipdate, '%Y-%m-%d') AS prazo,
         l.l_returnflag = 'R' AS bloqueante, l.l_linestatus = 'F' AS resolvida
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
who AS (
  SELECT l_orderkey, first('supplier-' || CAST(l_suppkey AS VARCHAR) ORDER BY l_shipdate, l_suppkey, l_linestatus) AS who
  FROM lineitem GROUP BY l_orderkey),
item_counts AS (
  SELECT doc_id, deal_id, count(*) AS items, CAST(count_if(bloqueante) AS BIGINT) AS blocking FROM items GROUP BY doc_id, deal_id),
partner_counts AS (
  SELECT o.o_custkey AS doc_id, count(DISTINCT l.l_suppkey) AS partners
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  GROUP BY o.o_custkey),
deal_counts AS (SELECT o_custkey AS doc_id, count(*) AS deals FROM orders GROUP BY o_custkey)"""

KNOWN = "doc_id IN (SELECT c_custkey FROM customer)"

ORACLE["p1_flatten_deals"] = with_ctes(DOC_DEALS, f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pk) - 1 AS BIGINT) AS pos, id, etapa, valor,
       cliente_id, parceiro_id, prazo, fechado_em
FROM deals WHERE {KNOWN}""")

ORACLE["p1_flatten_items"] = with_ctes(DOC_DEALS, f"""
SELECT doc_id, deal_id, pos, id, texto, responsavel, prazo, bloqueante, resolvida FROM items WHERE {KNOWN}""")

ORACLE["p2_element_lookup"] = with_ctes(DOC_DEALS, """
SELECT doc_id, id, etapa, valor, frente FROM deals WHERE frente = '1-URGENT'""")

ORACLE["p3_documents_with"] = """
SELECT c_custkey AS doc_id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS has_lost_deal
FROM customer"""

ORACLE["p3_documents_without"] = """
SELECT c_custkey AS doc_id FROM customer
WHERE c_custkey NOT IN (SELECT o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                        WHERE l.l_returnflag = 'R')"""

ORACLE["p6_blank_label"] = with_ctes(DOC_DEALS, """
SELECT doc_id, id, coalesce(nullif(valor, ''), '(vazio)') AS valor FROM deals""")

ORACLE["p7_first_transition_author"] = with_ctes(DOC_DEALS, f"""
SELECT d.doc_id, d.id AS deal_id, who.who FROM deals d LEFT JOIN who ON d.pk = who.l_orderkey WHERE {KNOWN}""")

ENTITY_COUNTS = """
SELECT c.c_custkey AS doc_id, coalesce(pc.partners, 0) AS partners, CAST(1 AS BIGINT) AS customers,
       coalesce(dc.deals, 0) AS deals, 1 AS version, 'carga inicial' AS updated_by
FROM customer c LEFT JOIN partner_counts pc ON c.c_custkey = pc.doc_id
     LEFT JOIN deal_counts dc ON c.c_custkey = dc.doc_id"""

ORACLE["a2_entity_counts"] = with_ctes(DOC_DEALS, ENTITY_COUNTS)
ORACLE["a2_entity_counts_nested"] = ORACLE["a2_entity_counts"]

ORACLE["a3_blocking_items"] = with_ctes(DOC_DEALS, """
SELECT d.doc_id, d.id AS deal_id, coalesce(ic.items, 0) AS items, coalesce(ic.blocking, 0) AS blocking
FROM deals d LEFT JOIN item_counts ic ON d.doc_id = ic.doc_id AND d.id = ic.deal_id""")

ORACLE["a3_blocking_items_nested"] = with_ctes(DOC_DEALS, f"""
SELECT d.doc_id, d.id AS deal_id, coalesce(ic.items, 0) AS items, coalesce(ic.blocking, 0) AS blocking
FROM deals d LEFT JOIN item_counts ic ON d.doc_id = ic.doc_id AND d.id = ic.deal_id WHERE d.{KNOWN}""")

ORACLE["j4_deal_customers"] = with_ctes(DOC_DEALS, """
SELECT d.doc_id, 'C-' || CAST(c.c_custkey AS VARCHAR) AS cliente_id, c.c_name AS cliente, c.c_mktsegment AS setor,
       d.id AS negocio_id, d.frente, d.etapa, CAST(NULL AS VARCHAR) AS publico, d.responsavel,
       coalesce(nullif(d.valor, ''), '(vazio)') AS valor,
       coalesce(ic.items, 0) AS pendencias, coalesce(ic.blocking, 0) AS bloqueantes, who.who AS criado_por
FROM deals d JOIN customer c ON d.doc_id = c.c_custkey
     LEFT JOIN item_counts ic ON d.doc_id = ic.doc_id AND d.id = ic.deal_id
     LEFT JOIN who ON d.pk = who.l_orderkey""")

LABEL_PATCHES = """fo AS (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey),
lp AS (
  SELECT l.doc_id, l.quality, l.toxic, fo.first_order,
         (l.quality = 1 OR fo.first_order IS NULL) AS appended
  FROM labels l LEFT JOIN fo ON l.doc_id = fo.o_custkey)"""

M1 = with_ctes(DOC_DEALS + ",\n" + LABEL_PATCHES, """
SELECT lp.doc_id, lp.appended, CAST(1 + CAST(lp.appended AS INTEGER) AS BIGINT) AS customers,
       CAST(coalesce(dc.deals, 0) + CAST(lp.appended AS INTEGER) AS BIGINT) AS deals
FROM lp JOIN customer c ON lp.doc_id = c.c_custkey LEFT JOIN deal_counts dc ON lp.doc_id = dc.doc_id""")
ORACLE["m1_append_if_absent"] = M1
ORACLE["m1_append_if_absent_nested"] = M1

ORACLE["m2_patch_elements"] = with_ctes(DOC_DEALS + ",\n" + LABEL_PATCHES, """
SELECT d.doc_id, d.id,
       CASE WHEN d.pk = lp.first_order THEN (CASE WHEN lp.toxic = 1 THEN 'revisar'
                                                  ELSE 'owner-' || CAST(lp.doc_id AS VARCHAR) END)
            ELSE d.responsavel END AS responsavel,
       CASE WHEN d.pk = lp.first_order AND lp.toxic = 1 THEN NULL ELSE '' END AS notas
FROM deals d LEFT JOIN lp ON d.doc_id = lp.doc_id AND lp.first_order IS NOT NULL""")

ORACLE["m2_patch_open"] = with_ctes(DOC_DEALS + ",\n" + LABEL_PATCHES, f"""
SELECT d.doc_id, CAST(row_number() OVER (PARTITION BY d.doc_id ORDER BY d.pk) - 1 AS BIGINT) AS pos, d.id,
       CASE WHEN NOT hit THEN d.responsavel WHEN lp.toxic = 1 THEN 'revisar' ELSE 'owner-' || CAST(d.doc_id AS VARCHAR) END AS responsavel,
       CASE WHEN hit AND lp.toxic = 1 THEN NULL ELSE '' END AS notas, CASE WHEN hit THEN '00-' || CAST(d.doc_id AS VARCHAR) END AS cnpj,
       CASE WHEN hit THEN d.doc_id END AS score, CASE WHEN hit THEN 'BIGINT' END AS score_type,
       CASE WHEN hit THEN '["a",1]' END AS tags,
       CAST(13 + CASE WHEN hit THEN 3 ELSE 0 END - CASE WHEN d.fechado_em IS NULL THEN 1 ELSE 0 END
            - CASE WHEN d.parceiro_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_keys
FROM (SELECT d.*, coalesce(d.pk = lp.first_order, false) AS hit FROM deals d LEFT JOIN lp ON d.doc_id = lp.doc_id) d
LEFT JOIN lp ON d.doc_id = lp.doc_id WHERE d.{KNOWN}""")

ORACLE["m3_set_at_path"] = with_ctes(DOC_DEALS, """
SELECT c.c_custkey AS doc_id, CASE WHEN l.toxic = 1 THEN 'null_value' END AS reason,
       CASE WHEN l.toxic = 0 AND g.n > 0 THEN c.c_custkey END AS first_n, 'N-' || CAST(g.a AS VARCHAR) AS first_id,
       CASE WHEN l.toxic = 0 AND g.n > 0 THEN 'label' END AS last_by, 'N-' || CAST(g.b AS VARCHAR) AS last_id,
       CASE WHEN l.toxic = 0 THEN '{"by":"label","n":' || CAST(c.c_custkey AS VARCHAR) || '}' END AS review, true AS absent,
       CAST(coalesce(g.n, 0) AS BIGINT) AS deals
FROM customer c LEFT JOIN labels l ON c.c_custkey = l.doc_id
     LEFT JOIN (SELECT doc_id, min(pk) AS a, max(pk) AS b, count(*) AS n FROM deals GROUP BY doc_id) g ON c.c_custkey = g.doc_id""")

ORACLE["e3_change_script"] = with_ctes(DOC_DEALS + ",\n" + LABEL_PATCHES, """,
after AS (
  SELECT d.doc_id, d.id, d.frente, d.etapa, CAST(NULL AS VARCHAR) AS publico,
         CASE WHEN d.pk = lp.first_order THEN (CASE WHEN lp.toxic = 1 THEN 'revisar' ELSE 'owner-' || CAST(lp.doc_id AS VARCHAR) END)
              ELSE d.responsavel END AS responsavel,
         d.valor, coalesce(ic.items, 0) AS items, coalesce(ic.blocking, 0) AS blocking, who.who
  FROM deals d LEFT JOIN lp ON d.doc_id = lp.doc_id
       LEFT JOIN item_counts ic ON d.doc_id = ic.doc_id AND d.id = ic.deal_id LEFT JOIN who ON d.pk = who.l_orderkey
  UNION ALL
  SELECT lp.doc_id, 'N-L' || CAST(lp.doc_id AS VARCHAR), '3-MEDIUM', '2', 'B2B', 'owner', '', 0, 0, NULL
  FROM lp JOIN customer c ON lp.doc_id = c.c_custkey WHERE lp.appended),
people AS (
  SELECT c_custkey AS doc_id, 'C-' || CAST(c_custkey AS VARCHAR) AS id, c_name AS nome, c_mktsegment AS setor FROM customer
  UNION ALL SELECT lp.doc_id, 'C-L' || CAST(lp.doc_id AS VARCHAR), 'Client L' || CAST(lp.doc_id AS VARCHAR), 'SERVICES'
  FROM lp JOIN customer c ON lp.doc_id = c.c_custkey WHERE lp.appended),
pairs AS (
  SELECT doc_id, CASE WHEN appended THEN 'N-L' || CAST(doc_id AS VARCHAR) ELSE 'N-' || CAST(first_order AS VARCHAR) END AS deal_id,
         'C-L' || CAST(doc_id AS VARCHAR) AS customer_id FROM lp
  UNION
  SELECT doc_id, 'N-' || CAST(first_order AS VARCHAR), 'C-' || CAST(doc_id AS VARCHAR) FROM lp WHERE first_order IS NOT NULL
  UNION
  SELECT doc_id, 'N-' || CAST(first_order AS VARCHAR), 'C-L' || CAST(doc_id AS VARCHAR) FROM lp WHERE first_order IS NOT NULL)
SELECT p.doc_id, c.id AS cliente_id, c.nome AS cliente, c.setor, e.id AS negocio_id, e.frente, e.etapa, e.publico, e.responsavel,
       coalesce(nullif(e.valor, ''), '(vazio)') AS valor, CAST(e.items AS BIGINT) AS pendencias, CAST(e.blocking AS BIGINT) AS bloqueantes,
       e.who AS criado_por, coalesce(pc.partners, 0) AS partners, CAST(1 + CAST(lp.appended AS INTEGER) AS BIGINT) AS customers,
       CAST(coalesce(dc.deals, 0) + CAST(lp.appended AS INTEGER) AS BIGINT) AS deals
FROM pairs p JOIN after e ON p.doc_id = e.doc_id AND p.deal_id = e.id JOIN people c ON p.doc_id = c.doc_id AND p.customer_id = c.id
     JOIN lp ON p.doc_id = lp.doc_id LEFT JOIN partner_counts pc ON p.doc_id = pc.doc_id LEFT JOIN deal_counts dc ON p.doc_id = dc.doc_id""")

LISTED = """coalesce(string_agg(d.id || ':' || d.etapa || ':' || d.valor || ':' || d.cliente_id, ',' ORDER BY d.pk), '')"""

ORACLE["m3_set_path"] = with_ctes(DOC_DEALS, """
SELECT c.c_custkey AS doc_id, CAST(count(d.pk) AS BIGINT) AS deals, """ + LISTED + """ AS listed
FROM customer c LEFT JOIN deals d ON d.doc_id = c.c_custkey AND d.etapa <> 'perdido'
GROUP BY c.c_custkey""")

ORACLE["m4_rebuild_arrays"] = with_ctes(DOC_DEALS, """
SELECT d.doc_id, CAST(count(*) AS BIGINT) AS n, 'N-' || CAST(min(d.pk) AS VARCHAR) AS first_id,
       'N-' || CAST(max(d.pk) AS VARCHAR) AS last_id, """ + LISTED + """ AS listed
FROM deals d GROUP BY d.doc_id""")

ORACLE["m5_full_replace"] = with_ctes(RESOLVED + CURRENT + ",\n" + DOC_DEALS, """
SELECT c.c_custkey AS doc_id, 'kept' AS source, coalesce(dc.deals, 0) AS deals
FROM customer c LEFT JOIN deal_counts dc ON c.c_custkey = dc.doc_id
WHERE c.c_custkey NOT IN (SELECT doc_id FROM cur)
UNION ALL
SELECT doc_id, 'incoming' AS source, n_deals AS deals FROM cur""", recursive=True)

ORACLE["q2_expected_counts"] = with_ctes(DOC_DEALS, """,
ec AS (""" + ENTITY_COUNTS + """)
SELECT doc_id, kind, actual, expected, actual = expected AS match FROM (
  SELECT doc_id, 'partners' AS kind, CAST(partners AS BIGINT) AS actual, CAST(partners AS BIGINT) AS expected FROM ec
  UNION ALL SELECT doc_id, 'customers', customers, customers FROM ec
  UNION ALL SELECT ec.doc_id, 'deals', CAST(ec.deals AS BIGINT), CAST(coalesce(l.n, 0) AS BIGINT)
            FROM ec LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey) l
                 ON ec.doc_id = l.o_custkey)""")
ORACLE["p7_first_transition_author_nested"] = ORACLE["p7_first_transition_author"]

ORACLE["q3_reference_check"] = with_ctes(DOC_DEALS, """
SELECT d.doc_id, 'customer' AS ref_kind, count(*) AS refs,
       CAST(count_if(d.doc_id NOT IN (SELECT c_custkey FROM customer)) AS BIGINT) AS missing
FROM deals d GROUP BY d.doc_id
UNION ALL
SELECT d.doc_id, 'partner', count(*),
       CAST(count_if(sup.s NOT IN (SELECT s_suppkey FROM supplier)) AS BIGINT)
FROM deals d JOIN sup ON d.pk = sup.l_orderkey GROUP BY d.doc_id""")

# ------------------------------------------------------------------ sources / sinks
ORACLE["s1_load_documents"] = with_ctes(DOC_DEALS, """
SELECT 'export' AS source, c.c_custkey AS id, CAST(NULL AS VARCHAR) AS reason, coalesce(dc.deals, 0) AS deals
FROM customer c LEFT JOIN deal_counts dc ON c.c_custkey = dc.doc_id
UNION ALL
SELECT 'documents', doc_id,
       CASE WHEN NOT json_valid(text) THEN 'not_json'
            WHEN json_type(CAST(text AS JSON)) <> 'OBJECT' THEN 'not_object' END,
       CAST(NULL AS BIGINT)
FROM documents""")

ORACLE["s2_replace_load"] = with_ctes(RESOLVED + CURRENT + ",\n" + DOC_DEALS, """
SELECT doc_id, version, updated_by, n_deals AS deals FROM cur
WHERE doc_id NOT IN (SELECT l.doc_id FROM labels l JOIN customer c ON l.doc_id = c.c_custkey WHERE l.quality = 1)
UNION ALL
SELECT c.c_custkey, 1, 'carga inicial', coalesce(dc.deals, 0)
FROM customer c JOIN labels l ON l.doc_id = c.c_custkey LEFT JOIN deal_counts dc ON c.c_custkey = dc.doc_id
WHERE l.quality = 1""", recursive=True)

ORACLE["s3_ensure_documents"] = with_ctes(RESOLVED + CURRENT, """
SELECT doc_id, version, n_deals AS deals, updated_by FROM cur
UNION ALL
SELECT c_custkey, 1, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM customer
WHERE c_custkey NOT IN (SELECT doc_id FROM cur)""", recursive=True)

ORACLE["s4_export_roundtrip"] = with_ctes(DOC_DEALS, """,
ec AS (""" + ENTITY_COUNTS + """)
SELECT ec.doc_id, version, updated_by, CAST(partners AS BIGINT) AS partners, customers, CAST(deals AS BIGINT) AS deals,
       coalesce(l.listed, '') AS listed
FROM ec LEFT JOIN (SELECT d.doc_id, """ + LISTED + """ AS listed FROM deals d GROUP BY d.doc_id) l ON ec.doc_id = l.doc_id""")

ORACLE["s5_read_envelope"] = with_ctes(USERS, """
SELECT CAST(floor(id / 200) AS BIGINT) AS page, CASE WHEN email IS NULL THEN 'object' ELSE 'array' END AS form,
       CAST(id AS VARCHAR) AS id, email
FROM users""")

ORACLE["s6_scan_columns"] = with_ctes(PROFILES, """
SELECT id, nome, papel, email, senha_provisoria FROM profiles""")

# ------------------------------------------------------------------ people
JS_SPACE = r"[\s\p{Z}\x{FEFF}]"
EMAIL_RE = r"^[^@\s\p{Z}\x{FEFF}]+@[^@\s\p{Z}\x{FEFF}.]+\.[^@\s\p{Z}\x{FEFF}]+$"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{JS_SPACE}+|{JS_SPACE}+$', '', 'g')"


def email_ok(x: str) -> str:
    return f"coalesce(regexp_matches({js_trim(x)}, '{EMAIL_RE}'), false)"


def pg_initcap(x: str) -> str:
    return (r"array_to_string(list_transform(regexp_extract_all(lower(" + x +
            r"), '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)', 1), lambda p: upper(p[1]) || p[2:]), '')")


def meta(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(raw_user_meta_data, '$.{k}')" for k in keys) + ")"


DERIVED = USERS + """,
derived AS (
  SELECT id,
         coalesce(nullif(trim(coalesce(""" + meta("nome", "name") + """, '')), ''),
                  """ + pg_initcap("split_part(coalesce(email, 'pessoa'), '@', 1)") + """) AS nome,
         CASE WHEN lower(trim(coalesce(""" + meta("papel", "role") + """, ''))) = 'leitor' THEN 'leitor'
              ELSE 'editor' END AS papel,
         email, true AS senha_provisoria
  FROM users)"""

ORACLE["u1_derive_profiles"] = with_ctes(DERIVED, """
SELECT id, nome, papel, email, senha_provisoria FROM derived""")

ORACLE["j6_insert_if_absent"] = with_ctes(DERIVED + ",\n" + PROFILES_ONLY, """
SELECT id, nome, papel, email, senha_provisoria FROM profiles
UNION ALL
SELECT id, nome, papel, email, senha_provisoria FROM derived WHERE id NOT IN (SELECT id FROM profiles)""")

USERS_PROFILES = USERS + ",\n" + PROFILES_ONLY

ORACLE["j1_backfill_email"] = with_ctes(USERS_PROFILES, """
SELECT p.id, p.nome, p.papel,
       CASE WHEN u.id IS NOT NULL AND p.email IS DISTINCT FROM u.email THEN u.email ELSE p.email END AS email,
       p.senha_provisoria,
       (u.id IS NOT NULL AND p.email IS DISTINCT FROM u.email) AS changed
FROM profiles p LEFT JOIN users u ON p.id = u.id""")

LISTING = """
SELECT u.id, u.email, coalesce(nullif(p.nome, ''), '') AS name, coalesce(nullif(p.papel, ''), '') AS role,
       coalesce(p.senha_provisoria, false) AS provisional, p.id IS NULL AS no_profile,
       u.last_sign_in_at AS last_seen, u.created_at AS created,
       (u.email_confirmed_at IS NOT NULL OR u.confirmed_at IS NOT NULL) AS confirmed
FROM users u LEFT JOIN profiles p ON u.id = p.id"""

ORACLE["j5_people_listing"] = with_ctes(USERS_PROFILES, LISTING)
ORACLE["l2_locale_sort"] = ORACLE["j5_people_listing"]
ORACLE["l3_first_page"] = with_ctes(USERS_PROFILES, LISTING + """
WHERE u.id IN (SELECT id FROM users ORDER BY id LIMIT 200)""")

CREATE_REQ = """,
req AS (
  SELECT id, email, json_extract_string(raw_user_meta_data, '$.nome') AS nome,
         json_extract_string(raw_user_meta_data, '$.papel') AS papel
  FROM users WHERE """ + email_ok("email") + """)"""

ORACLE["j7_repair_missing_profiles"] = with_ctes(USERS_PROFILES + CREATE_REQ, """
SELECT id, nome, papel, email, CASE WHEN id IN (SELECT id FROM req) THEN true ELSE senha_provisoria END AS senha_provisoria
FROM profiles
UNION ALL
SELECT id, coalesce(nullif(""" + js_trim("coalesce(nome, '')") + """, ''), split_part(email, '@', 1)),
       CASE WHEN papel IN ('editor', 'leitor') THEN papel ELSE 'editor' END, email, true
FROM req WHERE id NOT IN (SELECT id FROM profiles)""")

ORACLE["j8_insert_from_users"] = with_ctes(USERS_PROFILES, """
SELECT id, nome, papel, email, senha_provisoria FROM profiles
UNION ALL
SELECT u.id, c.c_name, 'editor', u.email, false
FROM customer c JOIN users u ON c.c_custkey = u.id
WHERE c.c_acctbal < 0 AND u.email IS NOT NULL AND u.id NOT IN (SELECT id FROM profiles)""")

REMOVALS = """,
rr AS (
  SELECT doc_id AS request_id, doc_id AS target,
         CAST(CASE WHEN quality = 0 THEN doc_id ELSE -1 END AS BIGINT) AS actor
  FROM labels WHERE toxic = 1),
ro AS (
  SELECT request_id, target, actor,
         CASE WHEN target IS NULL THEN 'sem-id' WHEN target = actor THEN 'nao-remove-a-si'
              WHEN target NOT IN (SELECT id FROM users) THEN 'remover-falhou' ELSE 'removido' END AS outcome
  FROM rr)"""

ORACLE["j9_remove_people"] = with_ctes(USERS + REMOVALS, """
SELECT request_id, target, actor, outcome FROM ro""")

ORACLE["j10_orphan_profiles"] = with_ctes(USERS_PROFILES + REMOVALS, """
SELECT id, nome FROM profiles WHERE id IN (SELECT target FROM ro WHERE outcome = 'removido')""")

ORACLE["q1_constraint_report"] = with_ctes(USERS_PROFILES + REMOVALS, """
SELECT 'perfil' AS tbl, rule, violations FROM (
  SELECT 'id_not_null' AS rule, CAST(count_if(id IS NULL) AS BIGINT) AS violations FROM profiles
  UNION ALL SELECT 'nome_not_null', CAST(count_if(nome IS NULL) AS BIGINT) FROM profiles
  UNION ALL SELECT 'papel_not_null', CAST(count_if(papel IS NULL) AS BIGINT) FROM profiles
  UNION ALL SELECT 'papel_in_list', CAST(count_if(papel NOT IN ('editor', 'leitor')) AS BIGINT) FROM profiles
  UNION ALL SELECT 'senha_not_null', CAST(count_if(senha_provisoria IS NULL) AS BIGINT) FROM profiles
  UNION ALL SELECT 'id_unique', CAST(count(*) - count(DISTINCT id) AS BIGINT) FROM profiles
  UNION ALL SELECT 'id_in_users', count(*) FROM profiles
            WHERE id IN (SELECT target FROM ro WHERE outcome = 'removido'))""")

ORACLE["u2_validate_people_commands"] = """
WITH c AS (
  SELECT doc_id AS id, unnest(CASE WHEN len(regexp_extract_all(text, '\\S+@\\S+')) > 0
                              THEN regexp_extract_all(text, '\\S+@\\S+') ELSE [''] END) AS email,
         CASE WHEN lang = 'en' THEN '  ' || source || ' ' ELSE '   ' END AS nome,
         CASE lang WHEN 'en' THEN 'editor' WHEN 'fr' THEN 'leitor' WHEN 'de' THEN 'Leitor' END AS papel
  FROM documents)
SELECT id, """ + js_trim("email") + """ AS email, """ + js_trim("coalesce(nome, '')") + """ AS nome,
       CASE WHEN papel IN ('editor', 'leitor') THEN papel ELSE 'editor' END AS papel,
       CASE WHEN NOT """ + email_ok("email") + """ THEN 'email-invalido' END AS reason,
       CASE WHEN NOT """ + email_ok("email") + """ THEN 400 ELSE 200 END AS status
FROM c"""

CHANGES = """,
ch AS (
  SELECT doc_id AS cmd_id, CASE WHEN quality = 0 AND toxic = 1 THEN NULL ELSE doc_id END AS id,
         CASE WHEN quality = 1 THEN 'Pessoa ' || CAST(doc_id AS VARCHAR) END AS new_nome,
         CASE WHEN toxic = 1 THEN 'leitor' END AS new_papel
  FROM labels),
cho AS (
  SELECT cmd_id, id,
         CASE WHEN id IS NULL THEN 'sem-id' WHEN new_nome IS NULL AND new_papel IS NULL THEN 'nada-para-salvar' END AS reason,
         new_nome, new_papel
  FROM ch)"""

ORACLE["u3_partial_profile_update"] = with_ctes(PROFILES + CHANGES, """
SELECT p.id, coalesce(c.new_nome, p.nome) AS nome, coalesce(c.new_papel, p.papel) AS papel, p.email, p.senha_provisoria
FROM profiles p LEFT JOIN (SELECT * FROM cho WHERE reason IS NULL) c ON p.id = c.id""")

ORACLE["u3_update_outcomes"] = with_ctes(PROFILES + CHANGES, """
SELECT cmd_id, id, reason, CASE WHEN reason IS NULL THEN 200 ELSE 400 END AS status FROM cho""")

ORACLE["u4_update_by_name"] = with_ctes(DERIVED, """,
cmd AS (
  SELECT d.nome, l.doc_id AS seq, CASE WHEN l.toxic = 1 THEN 'leitor' ELSE 'editor' END AS papel
  FROM labels l JOIN derived d ON l.doc_id = d.id),
lastcmd AS (
  SELECT nome, papel FROM (SELECT *, row_number() OVER (PARTITION BY nome ORDER BY seq DESC) AS rk FROM cmd) WHERE rk = 1)
SELECT d.id, d.nome, coalesce(c.papel, d.papel) AS papel
FROM derived d LEFT JOIN lastcmd c ON d.nome IS NOT DISTINCT FROM c.nome""")

# Commands by name replayed one by one over all profiles.
REPLAY = """,
numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM cmd),
turn AS (
  SELECT id, nome, papel, CAST(0 AS BIGINT) AS k FROM people
  UNION ALL
  SELECT t.id, CASE WHEN coalesce(t.nome = c.nome, false) THEN coalesce(c.novo, t.nome) ELSE t.nome END,
         CASE WHEN coalesce(t.nome = c.nome, false) THEN coalesce(c.papel, t.papel) ELSE t.papel END, t.k + 1
  FROM turn t JOIN numbered c ON c.k = t.k + 1)
SELECT id, nome, papel FROM turn WHERE k = (SELECT count(*) FROM numbered)"""

ORACLE["u4_rename_by_name"] = with_ctes(DERIVED, """,
cmd AS (
  SELECT d.nome, l.doc_id AS seq, CASE WHEN l.toxic = 1 THEN 'leitor' END AS papel,
         CASE WHEN l.quality = 1 THEN 'Nome ' || CAST(l.doc_id AS VARCHAR) END AS novo
  FROM labels l JOIN derived d ON l.doc_id = d.id),
people AS (SELECT id, nome, papel FROM derived)""" + REPLAY, recursive=True)

ORACLE["u4_update_in_order"] = with_ctes(PROFILES, """,
cmd AS (
  SELECT doc_id AS seq, 'Customer#' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS nome,
         CASE WHEN toxic = 1 THEN 'leitor' WHEN doc_id % 5 = 0 THEN 'editor' END AS papel,
         CASE WHEN quality = 1 THEN 'Customer#' || lpad(CAST(doc_id + 3 AS VARCHAR), 9, '0') END AS novo
  FROM labels),
people AS (SELECT id, nome, papel FROM profiles)""" + REPLAY, recursive=True)

ORACLE["u3_update_in_order"] = with_ctes(PROFILES, """,
c AS (
  SELECT doc_id AS cmd_id, doc_id % 40 AS id,
         CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'Pessoa ' || CAST(doc_id AS VARCHAR) END AS nome,
         CASE WHEN toxic = 1 THEN 'leitor' WHEN doc_id % 7 = 0 THEN 'editor' END AS papel
  FROM labels),
f AS (SELECT id, max_by(nome, cmd_id) FILTER (nome IS NOT NULL) AS nome, max_by(papel, cmd_id) FILTER (papel IS NOT NULL) AS papel
      FROM c GROUP BY id)
SELECT p.id, coalesce(f.nome, p.nome) AS nome, coalesce(f.papel, p.papel) AS papel, p.email, p.senha_provisoria
FROM profiles p LEFT JOIN f ON p.id = f.id""")

ORACLE["j9_remove_in_order"] = """
WITH rq AS (
  SELECT doc_id AS request_id, doc_id % 40 AS target, CASE WHEN quality = 0 THEN doc_id % 40 ELSE -1 END AS actor FROM labels),
o AS (
  SELECT *, target <> actor AND target IN (SELECT c_custkey FROM customer) AS may FROM rq)
SELECT request_id, target, CAST(actor AS BIGINT) AS actor,
       CASE WHEN target = actor THEN 'nao-remove-a-si'
            WHEN may AND sum(CAST(may AS INTEGER)) OVER (PARTITION BY target ORDER BY request_id) = 1 THEN 'removido'
            ELSE 'remover-falhou' END AS outcome
FROM o"""

COMMAND_LOG = PROFILES + """,
cl AS (
  SELECT doc_id AS cmd_id,
         CASE WHEN doc_id % 47 = 0 THEN 'outra'
              ELSE (['criar', 'perfil', 'perfil', 'senha', 'remover'])[((doc_id // 40 + doc_id) % 5) + 1] END AS acao,
         CASE WHEN doc_id % 23 <> 1 THEN doc_id % 40 END AS id,
         CASE WHEN quality = 0 THEN doc_id % 40 END AS actor,
         CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'Pessoa ' || CAST(doc_id AS VARCHAR) END AS nome,
         CASE WHEN toxic = 1 THEN 'leitor' WHEN doc_id % 7 = 0 THEN 'editor' END AS papel,
         CASE WHEN doc_id % 11 <> 0 THEN 'p' || CAST(doc_id AS VARCHAR) || '@example.com' END AS email
  FROM labels),
cv AS (
  SELECT *, CASE WHEN acao = 'outra' THEN 'acao-desconhecida'
                 WHEN acao = 'criar' AND email IS NULL THEN 'email-invalido'
                 WHEN acao = 'criar' AND id IS NULL THEN 'criar-falhou'
                 WHEN id IS NULL THEN 'sem-id'
                 WHEN acao = 'perfil' AND nome IS NULL AND papel IS NULL THEN 'nada-para-salvar'
                 WHEN acao = 'remover' AND id = actor THEN 'nao-remove-a-si' END AS early
  FROM cl),
ch AS (
  SELECT *, coalesce(last_value(CASE acao WHEN 'criar' THEN true WHEN 'remover' THEN false END IGNORE NULLS) OVER (
                       PARTITION BY id ORDER BY cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     id IN (SELECT id FROM profiles)) AS had
  FROM cv WHERE early IS NULL),
co AS (
  SELECT *, CASE WHEN acao = 'criar' AND had THEN 'criar-falhou' WHEN acao = 'senha' AND NOT had THEN 'senha-falhou'
                 WHEN acao = 'remover' AND NOT had THEN 'remover-falhou' END AS late,
         (acao = 'criar') <> had AS applied
  FROM ch)"""

ORACLE["u2_command_log_outcomes"] = with_ctes(COMMAND_LOG, """,
o AS (
  SELECT cmd_id, acao, id, late AS reason, applied FROM co
  UNION ALL SELECT cmd_id, acao, id, early, false FROM cv WHERE early IS NOT NULL)
SELECT cmd_id, acao, id, reason, applied,
       CASE WHEN reason IS NULL THEN 200 WHEN reason LIKE '%-falhou' THEN 502 ELSE 400 END AS status
FROM o""")

ORACLE["u2_command_log_people"] = with_ctes(COMMAND_LOG, """,
f AS (
  SELECT id, max_by(acao = 'criar', cmd_id) FILTER (acao IN ('criar', 'remover')) AS there,
         max_by(coalesce(nome, split_part(email, '@', 1)), cmd_id) FILTER (acao = 'criar' OR acao = 'perfil' AND nome IS NOT NULL) AS nome,
         max_by(coalesce(papel, 'editor'), cmd_id) FILTER (acao = 'criar' OR acao = 'perfil' AND papel IS NOT NULL) AS papel,
         max_by(email, cmd_id) FILTER (acao = 'criar') AS email, bool_or(acao IN ('criar', 'senha')) AS flag
  FROM co WHERE applied GROUP BY id)
SELECT coalesce(f.id, p.id) AS id, coalesce(f.nome, p.nome) AS nome, coalesce(f.papel, p.papel) AS papel,
       coalesce(f.email, p.email) AS email, coalesce(nullif(f.flag, false), p.senha_provisoria) AS senha_provisoria
FROM profiles p FULL JOIN f ON p.id = f.id
WHERE coalesce(f.there, p.id IS NOT NULL)""")

ORACLE["u5_normalise_email"] = with_ctes(USERS, """
SELECT id, lower(""" + js_trim("email") + """) AS email FROM users""")

ORACLE["p4_changed_rows"] = with_ctes(DERIVED + ",\n" + PROFILES_ONLY, """
SELECT o.id, o.nome AS old_nome, o.papel AS old_papel, n.nome AS new_nome, n.papel AS new_papel
FROM profiles o JOIN derived n ON o.id = n.id
WHERE o.nome IS DISTINCT FROM n.nome OR o.papel IS DISTINCT FROM n.papel""")

ORACLE["p5_role_check"] = with_ctes(USERS, """
SELECT id, """ + meta("papel", "role") + """ AS role,
       coalesce(""" + meta("papel", "role") + """ IN ('editor', 'leitor'), false) AS valid
FROM users""")

# ------------------------------------------------------------------ access
REQUESTS = """,
rq AS (
  SELECT event_id AS request_id,
         CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS actor,
         CASE event_type WHEN 'view' THEN 'select' WHEN 'click' THEN 'update' WHEN 'signup' THEN 'insert'
                         WHEN 'purchase' THEN 'delete' ELSE 'select' END AS verb,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 34 THEN 'perfil'
              WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 67 THEN 'pipeline'
              ELSE 'pipeline_historico' END AS tbl
  FROM events),
ao AS (
  SELECT rq.*,
         CASE WHEN rq.actor IS NULL THEN 'denied'
              WHEN rq.verb = 'select' THEN 'allowed'
              WHEN rq.verb = 'update' AND rq.tbl = 'pipeline' THEN
                   CASE WHEN p.papel = 'editor' THEN 'allowed' ELSE 'no_rows' END
              ELSE 'denied' END AS outcome
  FROM rq LEFT JOIN profiles p ON rq.actor = p.id)"""

ORACLE["x2_access_outcomes"] = with_ctes(PROFILES + REQUESTS, """
SELECT request_id, actor, verb, tbl, outcome FROM ao""")

ORACLE["x4_history_immutability"] = with_ctes(PROFILES + REQUESTS, """
SELECT verb, count(*) AS requests, CAST(count_if(outcome = 'allowed') AS BIGINT) AS allowed
FROM ao WHERE tbl = 'pipeline_historico' AND verb IN ('insert', 'delete') GROUP BY verb""")

SIZES = """,
sizes AS (
  SELECT 'perfil' AS tbl, CAST((SELECT count(*) FROM profiles) AS BIGINT) AS n
  UNION ALL SELECT 'pipeline', (SELECT count(*) FROM cur)
  UNION ALL SELECT 'pipeline_historico', (SELECT count(*) FROM history))"""

ORACLE["x1_visible_rows"] = with_ctes(RESOLVED + CURRENT + SIZES + REQUESTS, """
SELECT a.actor, s.tbl, CASE WHEN a.actor IS NULL THEN CAST(0 AS BIGINT) ELSE s.n END AS visible_rows
FROM (SELECT DISTINCT actor FROM rq) a, sizes s""", recursive=True)

ORACLE["a1_row_counts"] = with_ctes(RESOLVED + CURRENT + SIZES + REQUESTS, """,
kinds AS (
  SELECT DISTINCT CASE WHEN rq.actor IS NULL THEN 'anon' WHEN p.papel IS NULL THEN 'sem_perfil' ELSE p.papel END AS actor_kind
  FROM rq LEFT JOIN profiles p ON rq.actor = p.id)
SELECT k.actor_kind, s.tbl, CASE WHEN k.actor_kind = 'anon' THEN CAST(0 AS BIGINT) ELSE s.n END AS n
FROM kinds k, sizes s""", recursive=True)

ORACLE["p8_count_lines"] = "SELECT actor_kind, tbl, CASE tbl WHEN 'perfil' THEN 'perfil    -> ' WHEN 'pipeline' THEN 'pipeline  -> ' " \
    "ELSE 'historico -> ' END || CAST(n AS VARCHAR) || ' linhas' AS line FROM (" + ORACLE["a1_row_counts"] + ")"

# Streaming forms must equal their batch twins.
ORACLE["t1_stream_versioned_writes"] = ORACLE["v5_resolve_conflicts"]
ORACLE["t2_stream_profiles"] = ORACLE["j6_insert_if_absent"]
ORACLE["t3_stream_provisional_flag"] = ORACLE["v9_provisional_flag"]

# Writes that carry operations: the applied writes in order, and their fold by scopes.
OPERATIONS = RESOLVED + """,
docs0 AS (SELECT DISTINCT doc_id FROM writes),
ops AS (
  SELECT doc_id, seq, version, kind, CAST(seq AS VARCHAR) AS t, 'd' || (seq % 9) AS deal, 'c' || (seq % 13) AS cust,
         CASE WHEN kind = 'purchase' AND seq % 4 = 0 THEN 'set' WHEN kind = 'error' AND seq % 6 = 0 THEN 'replace'
              WHEN kind IN ('signup', 'click') THEN 'append' ELSE 'patch' END AS op
  FROM stamped
  UNION ALL SELECT doc_id, -4611686018427387904, 1, NULL, NULL, NULL, NULL, 'base' FROM docs0),
f AS (
  SELECT *, CASE WHEN op IN ('base', 'replace') THEN NULL
                 WHEN op <> 'set' AND kind IN ('click', 'purchase') THEN 'customers' ELSE 'deals' END AS field,
         max(CASE WHEN op IN ('base', 'replace') THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq) AS rep
  FROM ops),
s AS (
  SELECT *, CASE WHEN field = 'deals' THEN deal ELSE cust END AS id,
         greatest(rep, coalesce(max(CASE WHEN op = 'set' THEN seq END) OVER (PARTITION BY doc_id, field ORDER BY seq), rep)) AS scope
  FROM f),
tops AS (
  SELECT doc_id, unnest(['partners', 'customers', 'deals']) AS field, seq, 'array' AS kind, '[]' AS json FROM s WHERE op = 'base'
  UNION ALL SELECT doc_id, 'deals', seq, 'array', '[]' FROM s WHERE op = 'replace'
  UNION ALL SELECT doc_id, 'flag', seq, 'value', t FROM s WHERE op = 'replace'
  UNION ALL SELECT doc_id, 'deals', seq, 'array', '[{"id":"d1","x":' || t || '},{"id":"d2"},' || t || ']' FROM s WHERE op = 'set'),
items AS (
  SELECT doc_id, 'deals' AS field, seq AS scope, seq, CAST(0 AS BIGINT) AS pos, 'd1' AS id, t FROM s WHERE op = 'set'
  UNION ALL SELECT doc_id, 'deals', seq, seq, 1, 'd2', NULL FROM s WHERE op = 'set'
  UNION ALL SELECT doc_id, 'deals', seq, seq, 2, NULL, t FROM s WHERE op = 'set'
  UNION ALL SELECT doc_id, field, scope, seq, 0, id, t FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, field, scope, id ORDER BY seq) AS rk FROM s WHERE op = 'append') a
  WHERE rk = 1 AND NOT (scope > rep AND field = 'deals' AND id IN ('d1', 'd2'))),
cells AS (
  SELECT e.doc_id, e.field, e.scope, e.seq AS born, e.pos, e.seq, x.key, x.v
  FROM items e, unnest([
    {'key': 'id', 'v': '"' || e.id || '"'},
    {'key': CASE WHEN e.field = 'customers' THEN 's' WHEN e.seq = e.scope THEN 'x' ELSE 'n' END,
     'v': CASE WHEN e.field = 'customers' THEN '"s' || e.t || '"' ELSE e.t END}]) AS u(x)
  WHERE e.id IS NOT NULL AND x.v IS NOT NULL
  UNION ALL
  SELECT e.doc_id, e.field, e.scope, e.seq, e.pos, p.seq, x.key, x.v
  FROM items e JOIN s p ON p.op = 'patch' AND p.doc_id = e.doc_id AND p.field = e.field AND p.scope = e.scope
                       AND p.id = e.id AND p.seq > e.seq,
       unnest(CASE WHEN p.field = 'customers' THEN [{'key': 'z', 'v': 'null'}]
              ELSE [{'key': 'k' || (p.seq % 4), 'v': p.t}, {'key': 'last', 'v': '"' || p.kind || '"'}] END) AS u(x)),
ask AS (
  SELECT DISTINCT doc_id, CAST(floor((top - 1) * i / 3) + 1 AS INTEGER) AS version
  FROM (SELECT doc_id, max(version) AS top FROM stamped GROUP BY doc_id), (SELECT unnest([1, 2, 3]) AS i)),
targets AS (SELECT s.doc_id, s.version, s.seq AS upto, s.rep FROM s JOIN ask USING (doc_id, version)),
fields AS (
  SELECT t.doc_id, t.version, t.upto, x.field, greatest(t.rep, coalesce(max(s.seq), t.rep)) AS scope
  FROM targets t CROSS JOIN (SELECT unnest(['partners', 'customers', 'deals', 'flag']) AS field) x
  LEFT JOIN s ON s.doc_id = t.doc_id AND s.op = 'set' AND s.field = x.field AND s.seq <= t.upto
  GROUP BY t.doc_id, t.version, t.upto, t.rep, x.field),
latest AS (
  SELECT f.doc_id, f.version, f.field, c.born, c.pos, c.key, max_by(c.v, c.seq) AS v
  FROM fields f JOIN cells c ON c.doc_id = f.doc_id AND c.field = f.field AND c.scope = f.scope AND c.seq <= f.upto
  GROUP BY ALL),
objects AS (
  SELECT doc_id, version, field, born, pos, '{' || string_agg('"' || key || '":' || v, ',' ORDER BY key) || '}' AS json
  FROM latest GROUP BY ALL),
flat AS (
  SELECT f.doc_id, f.version, f.field, t.kind, t.seq AS born, CAST(-1 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS id, t.json
  FROM fields f JOIN tops t ON t.doc_id = f.doc_id AND t.field = f.field AND t.seq = f.scope
  UNION ALL
  SELECT f.doc_id, f.version, f.field, 'element', e.seq, e.pos, e.id, coalesce(o.json, e.t)
  FROM fields f JOIN items e ON e.doc_id = f.doc_id AND e.field = f.field AND e.scope = f.scope AND e.seq <= f.upto
  LEFT JOIN objects o ON o.doc_id = f.doc_id AND o.version = f.version AND o.field = f.field AND o.born = e.seq AND o.pos = e.pos)"""

ORACLE["m5_operation_elements"] = with_ctes(OPERATIONS, """
SELECT doc_id, version, field, kind, born, pos, id, json FROM flat""", recursive=True)

ORACLE["m5_operation_documents"] = with_ctes(OPERATIONS, """,
parts AS (
  SELECT doc_id, version, field, coalesce(max(CASE WHEN kind = 'value' THEN json END),
         '[' || coalesce(string_agg(json, ',' ORDER BY born, pos) FILTER (WHERE kind = 'element'), '') || ']') AS json
  FROM flat GROUP BY doc_id, version, field)
SELECT doc_id, version, '{' || string_agg('"' || field || '":' || json, ',' ORDER BY field) || '}' AS doc
FROM parts GROUP BY doc_id, version""", recursive=True)

ORACLE["x3_scenario_report"] = with_ctes(PROFILES + ",\n" + WRITES + REQUESTS, """,
steps AS (
  SELECT ao.request_id AS step, w.doc_id, ao.actor, ao.verb, ao.tbl, ao.outcome AS access,
         CASE WHEN ao.verb = 'update' THEN w.expected_version END AS expected_version,
         CASE WHEN ao.verb = 'update' THEN w.n_deals END AS n_deals
  FROM ao JOIN writes w ON w.seq = ao.request_id),
upd AS (
  SELECT s.*, coalesce(p.nome, 'desconhecido') AS author,
         row_number() OVER (PARTITION BY s.doc_id ORDER BY s.step) AS rn
  FROM steps s LEFT JOIN profiles p ON s.actor = p.id
  WHERE s.tbl = 'pipeline' AND s.verb = 'update' AND s.access = 'allowed'),
fold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS rn, 1 AS ver, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS INTEGER) AS version
  FROM (SELECT DISTINCT doc_id FROM writes)
  UNION ALL
  SELECT u.doc_id, u.rn,
         CASE WHEN coalesce(u.expected_version = f.ver, true) THEN f.ver + 1 ELSE f.ver END,
         CASE WHEN coalesce(u.expected_version = f.ver, true) THEN 'applied' ELSE 'conflict' END,
         CASE WHEN coalesce(u.expected_version = f.ver, true) THEN f.ver + 1 END
  FROM fold f JOIN upd u ON u.doc_id = f.doc_id AND u.rn = f.rn + 1),
res AS (SELECT u.step, f.outcome, f.version, u.author, u.n_deals FROM upd u JOIN fold f ON u.doc_id = f.doc_id AND u.rn = f.rn),
joined AS (
  SELECT s.step, s.doc_id, s.actor, s.verb, s.tbl, coalesce(r.outcome, s.access) AS outcome,
         CASE WHEN r.outcome = 'applied' THEN r.version END AS av,
         CASE WHEN r.outcome = 'applied' THEN r.author END AS aa,
         CASE WHEN r.outcome = 'applied' THEN r.n_deals END AS ad,
         coalesce(r.outcome = 'applied', false) AS is_applied
  FROM steps s LEFT JOIN res r ON s.step = r.step)
SELECT step, actor, verb, tbl, outcome,
       CASE WHEN actor IS NOT NULL THEN coalesce(last_value(av IGNORE NULLS) OVER w, 1) END AS version,
       CASE WHEN actor IS NOT NULL THEN coalesce(last_value(aa IGNORE NULLS) OVER w, 'carga inicial') END AS author,
       CASE WHEN actor IS NOT NULL THEN coalesce(last_value(ad IGNORE NULLS) OVER w, CAST(0 AS BIGINT)) END AS deals,
       CASE WHEN actor IS NOT NULL THEN CAST(count_if(is_applied) OVER w AS BIGINT) END AS history
FROM joined
WINDOW w AS (PARTITION BY doc_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", recursive=True)

ORACLE["m2_patch_elements_nested"] = ORACLE["m2_patch_elements"] + " WHERE d.doc_id IN (SELECT c_custkey FROM customer)"

ORACLE["p1_flatten_loaded_deals"] = ORACLE["p1_flatten_deals"]

ORACLE["x3_scenario_report_chunked"] = ORACLE["x3_scenario_report"]

ORACLE["e2_people_listing"] = with_ctes(USERS_PROFILES, LISTING.replace("SELECT u.id,", "SELECT CAST(u.id AS VARCHAR) AS id,", 1) + """
WHERE u.id IN (SELECT id FROM users ORDER BY CAST(id AS VARCHAR) LIMIT 200)""")

ORACLE["q1_document_constraints"] = with_ctes(RESOLVED + CURRENT, """,
twice AS (
  SELECT doc_id, version, true AS has_doc FROM cur
  UNION ALL SELECT cur.doc_id, cur.version, l.quality = 1 FROM cur JOIN labels l ON cur.doc_id = l.doc_id WHERE l.toxic = 1)
SELECT 'pipeline' AS tbl, rule, violations FROM (
  SELECT 'id_not_null' AS rule, CAST(count_if(doc_id IS NULL) AS BIGINT) AS violations FROM twice
  UNION ALL SELECT 'dados_not_null', CAST(count_if(NOT has_doc) AS BIGINT) FROM twice
  UNION ALL SELECT 'versao_not_null', CAST(count_if(version IS NULL) AS BIGINT) FROM twice
  UNION ALL SELECT 'versao_positive', CAST(count_if(version < 1) AS BIGINT) FROM twice
  UNION ALL SELECT 'id_unique', CAST(count(*) - count(DISTINCT doc_id) AS BIGINT) FROM twice)
UNION ALL
SELECT 'pipeline_historico', rule, violations FROM (
  SELECT 'id_not_null' AS rule, CAST(count_if(hist_id IS NULL) AS BIGINT) AS violations FROM history
  UNION ALL SELECT 'dados_not_null', CAST(0 AS BIGINT)
  UNION ALL SELECT 'versao_not_null', CAST(count_if(version IS NULL) AS BIGINT) FROM history
  UNION ALL SELECT 'versao_positive', CAST(count_if(version < 1) AS BIGINT) FROM history
  UNION ALL SELECT 'id_unique', CAST(count(*) - count(DISTINCT hist_id) AS BIGINT) FROM history)""", recursive=True)
