"""Queries of the dashboard, the listings and the state transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hiresift.functions import scores
from hiresift.operators import dashboard, listings, transitions

from .recruiting import AS_OF, access_logs, candidates, job_offers, matches, scan, users
from .registry import Registry

registry = Registry()
query = registry.query

PIPELINE_SQL = """
    SELECT o.id, o.titre, o.status,
           count(m.id) AS n_matches,
           count(*) FILTER (WHERE m.score_pct > 0) AS n_scored,
           count(*) FILTER (WHERE m.score_pct >= 65) AS excellent,
           count(*) FILTER (WHERE m.score_pct >= 35 AND m.score_pct < 65) AS moyen,
           count(*) FILTER (WHERE m.score_pct > 0 AND m.score_pct < 35) AS faible,
           max(CASE WHEN m.score_pct > 0 THEN m.score_pct END) AS best,
           CAST(sum(CASE WHEN m.score_pct > 0 THEN m.score_pct END) AS DOUBLE)
             / NULLIF(count(*) FILTER (WHERE m.score_pct > 0), 0) AS mean
    FROM job_offers o LEFT JOIN matches m ON m.offer_id = o.id GROUP BY o.id, o.titre, o.status"""


@query(PIPELINE_SQL)
def offer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.offer_pipeline(job_offers(spark, d), matches(spark, d))


@query("""SELECT (SELECT count(*) FROM candidates) AS n_candidates, (SELECT count(*) FROM job_offers) AS n_offers,
    (SELECT count(*) FROM job_offers WHERE status = 'active') AS n_active, (SELECT count(*) FROM matches) AS n_matches,
    (SELECT count(*) FROM matches WHERE score_pct > 0) AS n_scored, (SELECT count(*) FROM users) AS n_users""")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.totals(job_offers(spark, d), candidates(spark, d), matches(spark, d), users(spark, d))


@query("""SELECT s.candidature_status, count(c.id) AS n FROM (VALUES ('en_attente'), ('accepte'), ('refuse'), ('archive')) s(candidature_status)
    LEFT JOIN candidates c ON c.candidature_status = s.candidature_status GROUP BY s.candidature_status""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.status_counts(candidates(spark, d), "candidature_status", ("en_attente", "accepte", "refuse", "archive"))


@query("""SELECT s.role, count(u.id) AS n FROM (VALUES ('candidat'), ('recruteur'), ('admin')) s(role)
    LEFT JOIN users u ON u.role = s.role GROUP BY s.role""")
def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.status_counts(users(spark, d), "role", ("candidat", "recruteur", "admin"))


@query("""SELECT accepted, refused, CAST(floor(accepted * 100.0 / (accepted + refused) + 0.5) AS BIGINT) AS rate FROM (
    SELECT count(*) FILTER (WHERE candidature_status = 'accepte') AS accepted,
           count(*) FILTER (WHERE candidature_status = 'refuse') AS refused FROM candidates)""")
def acceptance_rate(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.decided(candidates(spark, d))


@query("""SELECT CASE WHEN score_pct >= 65 THEN 'excellent' WHEN score_pct >= 35 THEN 'moyen' ELSE 'faible' END AS band, count(*) AS n
    FROM matches WHERE score_pct > 0 GROUP BY 1""")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.score_distribution(matches(spark, d))


@query(f"""SELECT kind, offer_id, n FROM (
    SELECT CASE WHEN n_matches = 0 THEN 'no_match' WHEN n_scored = 0 THEN 'unscored' WHEN best < 35 THEN 'weak_best' END AS kind,
           id AS offer_id, n_matches AS n FROM ({PIPELINE_SQL}) p WHERE status = 'active') a WHERE kind IS NOT NULL
    UNION ALL SELECT 'unmatched_candidates', NULL, n FROM (SELECT count(*) AS n FROM candidates
        WHERE NOT EXISTS (SELECT 1 FROM matches WHERE candidate_id = candidates.id)) WHERE n > 0
    UNION ALL SELECT 'pending_candidates', NULL, n FROM (SELECT count(*) AS n FROM candidates WHERE candidature_status = 'en_attente') WHERE n > 0""")
def alerts(spark: SparkSession, d: str) -> DataFrame:
    found = matches(spark, d)
    return dashboard.alerts(dashboard.offer_pipeline(job_offers(spark, d), found), candidates(spark, d), found)


@query("""SELECT action, count(*) AS n FROM access_logs
    WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00' AND created_at <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY action""")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.recent(access_logs(spark, d), AS_OF).groupBy("action").agg(F.count("*").alias("n"))


@query("""SELECT m.id, c.nom, o.titre, m.score_pct FROM (SELECT * FROM matches WHERE score_pct > 0 ORDER BY score_pct DESC, id LIMIT 8) m
    JOIN job_offers o ON o.id = m.offer_id JOIN candidates c ON c.id = m.candidate_id""")
def top_matches_global(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.top_matches(job_offers(spark, d), candidates(spark, d), matches(spark, d))


@query("""SELECT c.id, CASE WHEN r.candidate_id IS NULL THEN c.candidature_status WHEN r.acc THEN 'accepte' WHEN r.rej THEN 'refuse' ELSE 'en_attente' END AS status
    FROM candidates c LEFT JOIN (SELECT candidate_id, bool_or(status = 'accepted') AS acc, bool_or(status = 'rejected') AS rej FROM matches
    GROUP BY candidate_id) r ON r.candidate_id = c.id""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.status_rollup(candidates(spark, d), matches(spark, d))


@query("""SELECT candidate_id, string_agg(titre, '|' ORDER BY first_at, first_id, titre) AS titles, count(*) AS n_titles FROM (
    SELECT candidate_id, titre, created_at AS first_at, id AS first_id FROM (
      SELECT m.candidate_id, o.titre, m.created_at, m.id,
             row_number() OVER (PARTITION BY m.candidate_id, o.titre ORDER BY m.created_at, m.id) AS rn
      FROM matches m JOIN job_offers o ON o.id = m.offer_id) x WHERE rn = 1) y GROUP BY candidate_id""")
def distinct_titles(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.first_seen_titles(job_offers(spark, d), matches(spark, d))


@query("""SELECT offer_id, dimension, CAST(sum(value) AS DOUBLE) / count(value) AS mean FROM (
    SELECT offer_id, unnest(['half', 'score_pct']) AS dimension, unnest([score_pct // 2, score_pct]) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY score_pct DESC, id) AS rn FROM matches) r WHERE rn <= 5) u GROUP BY 1, 2""")
def radar(spark: SparkSession, d: str) -> DataFrame:
    rows = matches(spark, d).withColumn("half", F.expr("score_pct div 2"))
    return dashboard.radar(rows, ("half", "score_pct"))


@query("""SELECT m.id, m.offer_id, row_number() OVER w AS rank, row_number() OVER w <= o.nb_postes AS retained
    FROM matches m JOIN job_offers o ON o.id = m.offer_id
    WINDOW w AS (PARTITION BY m.offer_id ORDER BY m.score_pct DESC, m.created_at DESC, m.id)""")
def report_ranks(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.report_rows(job_offers(spark, d), matches(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT count(*) FILTER (WHERE y >= 0.65) AS high, count(*) FILTER (WHERE y < 0.35) AS low,
    count(*) FILTER (WHERE y >= 0.35 AND y < 0.65) AS middle FROM (SELECT score_pct / 100.0 AS y FROM matches)""")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.class_balance(matches(spark, d), F.col("score_pct") / 100.0)


@query("""SELECT agree, n, CAST(agree AS DOUBLE) / n AS rate FROM (SELECT count(*) FILTER (WHERE abs(l_discount * 10 - l_tax * 12) < 0.3) AS agree, count(*) AS n FROM lineitem)""")
def agreement_rate(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.agreement_rate(scan(spark, d, "lineitem"), F.col("l_discount") * 10, F.col("l_tax") * 12)


@query("""SELECT lower(trim(p_name)) AS term, count(*) AS n FROM part WHERE length(trim(p_name)) >= 9 AND lower(trim(p_name)) NOT IN ('red widget') GROUP BY 1""")
def discovered_terms(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.term_frequencies(scan(spark, d, "part"), "p_name", 9, ("red widget",))


@query("""SELECT user_id, count(*) FILTER (WHERE id % 3 <> 0) AS n_unread, count(*) AS n_listed FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM access_logs) x WHERE rn <= 50 GROUP BY user_id""")
def unread_latest50(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.unread_of_newest(access_logs(spark, d).withColumn("is_read", F.col("id") % 3 == 0), "user_id")


@query("""SELECT action, count(*) AS n, count(DISTINCT user_id) AS n_users, min(created_at) AS first_at, max(created_at) AS last_at FROM access_logs GROUP BY action""")
def audit_by_action(spark: SparkSession, d: str) -> DataFrame:
    return access_logs(spark, d).groupBy("action").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )


# Filters and projections.


@query("""SELECT id, nom, segment FROM candidates WHERE (contains(lower(nom), '00001') OR contains(lower(segment), 'auto')) AND candidature_status = 'accepte'""")
def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = listings.search(candidates(spark, d), "AUTO", ("nom", "segment"), {"candidature_status": "accepte", "nationkey": None})
    return listings.search(candidates(spark, d), "00001", ("nom",), {"candidature_status": "accepte"}).unionByName(found).distinct().select("id", "nom", "segment")


@query("""SELECT id, titre FROM job_offers WHERE contains(lower(concat_ws(' ', titre, entreprise, type_contrat)), 'ring brand#2') AND status = 'active'""")
def concatenated_search(spark: SparkSession, d: str) -> DataFrame:
    return listings.concatenated_search(job_offers(spark, d).where("status = 'active'"), "Ring Brand#2", ("titre", "entreprise", "type_contrat")).select("id", "titre")


@query("""SELECT id, action FROM access_logs ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50""")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    return listings.page(access_logs(spark, d), [F.col("created_at").desc(), F.col("id").desc()], 50, 25).select("id", "action")


@query("""SELECT id, date_limite FROM job_offers WHERE date_limite IS NOT NULL AND date_limite < DATE '2024-01-31'""")
def past_deadline(spark: SparkSession, d: str) -> DataFrame:
    return listings.past_deadline(job_offers(spark, d), AS_OF).select("id", "date_limite")


@query("""SELECT id FROM candidates WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.candidate_id = candidates.id AND m.status = 'accepted' AND m.score_pct > 80)""")
def unmatched_candidates(spark: SparkSession, d: str) -> DataFrame:
    return listings.unmatched(candidates(spark, d), matches(spark, d).where("status = 'accepted' and score_pct > 80")).select("id")


@query("""SELECT id, titre FROM job_offers WHERE recruiter_id = 7 OR id IN (SELECT ps.l_partkey FROM lineitem ps WHERE ps.l_suppkey = 7)""")
def role_scope(spark: SparkSession, d: str) -> DataFrame:
    bridge = scan(spark, d, "lineitem").select(F.col("l_partkey").alias("offer_id"), F.col("l_suppkey").alias("user_id"))
    return listings.visible(job_offers(spark, d), "recruteur", 7, bridge).select("id", "titre")


@query("""SELECT id, COALESCE(titre, '—') AS titre, COALESCE(entreprise, '—') AS entreprise, COALESCE(nb_postes, 1) AS nb_postes,
    strftime(date_limite, '%Y-%m-%d') AS date_limite, COALESCE(status, 'active') AS status FROM job_offers""")
def api_items(spark: SparkSession, d: str) -> DataFrame:
    return listings.api_item(job_offers(spark, d))


@query("""SELECT id, CASE WHEN score_pct <> 0 THEN floor(score_pct / 100.0 * 1000 + 0.5) / 10 END AS pct FROM matches""")
def score_percent(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).select("id", scores.percent(F.col("score_pct") / 100.0).alias("pct"))


@query("""SELECT doc_id, substring(text, 1, 300) AS preview, length(text) AS n FROM documents""")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "documents").select("doc_id", F.substring("text", 1, 300).alias("preview"), F.char_length("text").cast("long").alias("n"))


@query("""SELECT id, type_contrat, nb_postes, CASE WHEN type_contrat NOT IN ('CDI', 'CDD', 'Stage') THEN 'contract' END AS reason FROM job_offers""")
def offer_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = job_offers(spark, d).withColumn("competences_requises", F.split("titre", " "))
    fine, rejected = listings.valid_offers(rows, contracts=("CDI", "CDD", "Stage"))
    return fine.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected).select("id", "type_contrat", "nb_postes", "reason")


# Joins.


@query("""SELECT m.id AS match_id, o.titre, o.entreprise, c.nom, m.score_pct FROM matches m JOIN job_offers o ON o.id = m.offer_id
    JOIN candidates c ON c.id = m.candidate_id WHERE o.status = 'active' AND m.score_pct >= 90""")
def applications(spark: SparkSession, d: str) -> DataFrame:
    strong = matches(spark, d).where("score_pct >= 90")
    return listings.applications(strong, job_offers(spark, d), candidates(spark, d)).where("offer_status = 'active'").select(
        "match_id", "titre", "entreprise", "nom", "score_pct"
    )


@query("""SELECT o.id, o.titre, o.nb_postes, (SELECT count(*) FROM matches m WHERE m.offer_id = o.id) AS candidate_count FROM job_offers o""")
def counted_offers(spark: SparkSession, d: str) -> DataFrame:
    return listings.counted_offers(job_offers(spark, d), matches(spark, d)).select("id", "titre", "nb_postes", "candidate_count")


@query("""SELECT o.id, COALESCE(string_agg(CAST(m.id AS VARCHAR), ',' ORDER BY m.score_pct DESC, m.created_at, m.id), '') AS match_ids
    FROM job_offers o LEFT JOIN matches m ON m.offer_id = o.id GROUP BY o.id""")
def nested_matches(spark: SparkSession, d: str) -> DataFrame:
    nested = listings.nested_matches(job_offers(spark, d), matches(spark, d))
    ids = F.array_join(F.transform("matches", lambda m: m["match_id"].cast("string")), ",")
    return nested.select("id", F.coalesce(ids, F.lit("")).alias("match_ids"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id""")
def turns_grouped(spark: SparkSession, d: str) -> DataFrame:
    turns = scan(spark, d, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count("*").alias("n"), F.sum(F.char_length("text")).alias("n_chars")
    )
    return turns.select("conv_id", F.array_join("t.role", ",").alias("roles"), "n", F.col("n_chars").cast("long"))


@query("""SELECT n.n_nationkey AS nationkey, r.r_regionkey AS regionkey FROM nation n CROSS JOIN region r
    WHERE NOT EXISTS (SELECT 1 FROM nation e WHERE e.n_nationkey = n.n_nationkey AND e.n_regionkey = r.r_regionkey)""")
def missing_pairs(spark: SparkSession, d: str) -> DataFrame:
    nation = scan(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey"))
    region = scan(spark, d, "region").select(F.col("r_regionkey").alias("regionkey"))
    return transitions.missing_links(nation, region, nation, "nationkey", "regionkey")


@query("""SELECT candidate_id, offer_id, overlap, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY overlap DESC, offer_id) AS rank FROM (
    SELECT c.id AS candidate_id, o.id AS offer_id, o.titre,
           len(list_intersect(o.skills, c.skills))::DOUBLE / len(list_distinct(o.skills)) AS overlap
    FROM (SELECT id, [segment, CAST(nationkey % 5 AS VARCHAR)] AS skills FROM candidates WHERE candidature_status = 'refuse') c
    CROSS JOIN (SELECT id, titre, ['MACHINERY', CAST(id % 5 AS VARCHAR)] AS skills FROM job_offers WHERE status = 'active') o) p
  WHERE overlap >= 0.45 AND NOT EXISTS (SELECT 1 FROM matches m JOIN job_offers x ON x.id = m.offer_id WHERE m.candidate_id = p.candidate_id AND x.titre = p.titre)) q
  WHERE rank <= 12""")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    people = candidates(spark, d).withColumn("skills", F.array("segment", (F.col("nationkey") % 5).cast("string")))
    wanted = job_offers(spark, d).withColumn("skills", F.array(F.lit("MACHINERY"), (F.col("id") % 5).cast("string")))
    return listings.recommendations(people, wanted, matches(spark, d)).withColumn("rank", F.col("rank").cast("long"))


# Ranking and first rows.


@query("""SELECT id, offer_id, rank FROM (SELECT id, offer_id, row_number() OVER (PARTITION BY offer_id ORDER BY score_pct DESC, created_at DESC, id) AS rank FROM matches) r WHERE rank <= 5""")
def topk_per_offer(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("score_pct").desc(), F.col("created_at").desc(), "id"]
    return listings.top_per_group(matches(spark, d), "offer_id", order, 5).select("id", "offer_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT id, email FROM (SELECT id, email, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, id) AS rn FROM candidates) x WHERE rn = 1""")
def first_per_email(spark: SparkSession, d: str) -> DataFrame:
    return listings.first_per_key(candidates(spark, d), "email", [F.col("created_at").desc(), "id"]).select("id", "email")


@query("""SELECT user_id, CAST(sum(new_span) AS BIGINT) AS n_spans FROM (SELECT user_id,
    CASE WHEN prev IS NULL OR created_at > prev + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS new_span FROM (
      SELECT user_id, created_at, lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id) AS prev FROM access_logs) a) b GROUP BY user_id""")
def activity_spans(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("created_at", "id")
    before = F.lag("created_at").over(order)
    starts = F.when(before.isNull() | (F.col("created_at") > before + F.expr("INTERVAL 2 HOURS")), 1).otherwise(0)
    return access_logs(spark, d).select("user_id", starts.alias("s")).groupBy("user_id").agg(F.sum("s").cast("long").alias("n_spans"))


# Transitions.


@query("""SELECT id, CASE WHEN status = 'active' AND date_limite IS NOT NULL AND date_limite < DATE '2024-01-31' THEN 'closed' ELSE status END AS status FROM job_offers""")
def auto_close(spark: SparkSession, d: str) -> DataFrame:
    return transitions.auto_close(job_offers(spark, d), AS_OF).select("id", "status")


@query("""SELECT id, 'Anonyme' AS nom, 'anonyme_' || substring(CAST(id AS VARCHAR), 1, 8) || '@anonyme.com' AS email, CAST(NULL AS VARCHAR) AS segment, true AS anonymized FROM candidates""")
def anonymise(spark: SparkSession, d: str) -> DataFrame:
    return transitions.anonymise(candidates(spark, d), cleared=("segment",)).select("id", "nom", "email", "segment", "anonymized")


_SELECTED = "SELECT DISTINCT offer_id, candidate_id FROM matches WHERE id % 211 = 0"
_SELECTION = f"""sel AS ({_SELECTED}), sizes AS (SELECT offer_id, count(*) AS n FROM sel GROUP BY offer_id),
    fine AS (SELECT s.offer_id FROM sizes s JOIN job_offers o ON o.id = s.offer_id WHERE s.n <= o.nb_postes)"""


@query(f"""SELECT id, CASE WHEN x THEN 'accepted' WHEN t THEN 'rejected' ELSE status END AS status FROM (
    SELECT m.id, m.status, EXISTS (SELECT 1 FROM ({_SELECTED}) s WHERE s.offer_id = m.offer_id AND s.candidate_id = m.candidate_id) AND f.offer_id IS NOT NULL AS x,
           f.offer_id IS NOT NULL AS t FROM matches m LEFT JOIN (SELECT s.offer_id FROM (SELECT offer_id, count(*) AS n FROM ({_SELECTED}) GROUP BY offer_id) s
    JOIN job_offers o ON o.id = s.offer_id WHERE s.n <= o.nb_postes) f ON f.offer_id = m.offer_id) y""")
def select_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = matches(spark, d)
    chosen = rows.where("id % 211 = 0").select("offer_id", "candidate_id")
    return transitions.select_candidates(rows, job_offers(spark, d), chosen)[0].select("id", "status")


@query(f"""SELECT o.id, CASE WHEN f.offer_id IS NOT NULL AND f.n >= o.nb_postes THEN 'closed' ELSE o.status END AS status FROM job_offers o LEFT JOIN (
    SELECT s.offer_id, s.n FROM (SELECT offer_id, count(*) AS n FROM ({_SELECTED}) GROUP BY offer_id) s JOIN job_offers p ON p.id = s.offer_id WHERE s.n <= p.nb_postes) f
    ON f.offer_id = o.id""")
def close_filled(spark: SparkSession, d: str) -> DataFrame:
    rows = matches(spark, d)
    chosen = rows.where("id % 211 = 0").select("offer_id", "candidate_id")
    return transitions.select_candidates(rows, job_offers(spark, d), chosen)[1].select("id", "status")


@query("""SELECT id FROM matches WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.id = matches.candidate_id AND c.candidature_status = 'refuse')""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = candidates(spark, d).where("candidature_status = 'refuse'").select(F.col("id").alias("candidate_id"))
    return transitions.delete(matches(spark, d), gone, "candidate_id").select("id")


@query("""SELECT id, (id % 3 = 0 OR action = 'click') AS is_read FROM access_logs""")
def mark_read(spark: SparkSession, d: str) -> DataFrame:
    rows = access_logs(spark, d).withColumn("is_read", F.col("id") % 3 == 0)
    return transitions.mark_read(rows, F.col("action") == "click").select("id", "is_read")


@query("""SELECT o.id, COALESCE(CASE WHEN o.id % 4 = 0 THEN upper(o.titre) END, o.titre) AS titre,
    CASE WHEN o.id % 4 = 0 THEN NULL ELSE o.date_limite END AS date_limite FROM job_offers o""")
def update_offers(spark: SparkSession, d: str) -> DataFrame:
    rows = job_offers(spark, d)
    changes = rows.where("id % 4 = 0").select(
        "id", F.upper("titre").alias("titre"), F.lit(None).cast("date").alias("date_limite"), F.array(F.lit("date_limite")).alias("was_set")
    )
    return transitions.update_offers(rows, changes, ("date_limite",)).select("id", "titre", "date_limite")


@query("""SELECT COALESCE(n.id, a.id) AS id, COALESCE(n.v, a.v) AS relevance FROM (SELECT id, score_pct % 3 AS v FROM matches WHERE id % 5 = 0) a
    FULL JOIN (SELECT id, score_pct % 4 AS v FROM matches WHERE id % 3 = 0 AND score_pct % 4 IN (0, 1, 2)) n ON n.id = a.id""")
def annotation_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = matches(spark, d)
    old = rows.where("id % 5 = 0").select("id", (F.col("score_pct") % 3).alias("relevance"))
    new = rows.where("id % 3 = 0").select("id", (F.col("score_pct") % 4).alias("relevance"))
    return transitions.upsert(old, new, ["id"], "relevance", (0, 1, 2))


@query("""SELECT offer_id, user_id FROM (SELECT DISTINCT l_partkey AS offer_id, l_suppkey AS user_id FROM lineitem) b WHERE offer_id % 10 <> 0
    UNION ALL SELECT id, recruiter_id FROM job_offers WHERE id % 10 = 0""")
def replace_recruiters(spark: SparkSession, d: str) -> DataFrame:
    bridge = scan(spark, d, "lineitem").select(F.col("l_partkey").alias("offer_id"), F.col("l_suppkey").alias("user_id")).distinct()
    assigned = job_offers(spark, d).where("id % 10 = 0").select(F.col("id").alias("offer_id"), F.col("recruiter_id").alias("user_id"))
    return transitions.replace_recruiters(bridge, assigned)


@query("""SELECT id, id % 2 = 0 AND is_active AS is_active FROM users""")
def deactivate_users(spark: SparkSession, d: str) -> DataFrame:
    rows = users(spark, d)
    return transitions.set_active(rows, rows.where("id % 2 = 1"), False).select("id", "is_active")
