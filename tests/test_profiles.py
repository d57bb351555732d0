"""Text functions, skills, similarities, profiles, sources and streams on small rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from hiresift.functions import scores, similarity, skills, text
from hiresift.operators import dashboard, evaluation, listings, matching, profiles, scoring, transitions
from hiresift.sources import documents, tables
from hiresift.streaming import audit


def one(spark, expression, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(expression.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "want"),
    [("3 ans minimum", 3.0), ("2,5 years", 2.5), ("5+ ans", 5.0), ("rien", None), ("", None)],
)
def test_required_years(spark, raw, want):
    assert one(spark, text.required_years(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("bac + 4", 4), ("Master", 5), ("Ingénieur d'état", 5), ("licence", 3), ("BTS", 2), ("aucun", None)])
def test_required_education(spark, raw, want):
    assert one(spark, text.required_education(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("mars 2020", "2020-03"), ("03/2021", "2021-03"), ("2019-11", "2019-11"), ("2018", "2018-01"), ("Sept. 2017", "2017-09"), ("13/2020", None), ("hier", None)],
)
def test_date_token(spark, raw, want):
    assert one(spark, text.date_token(F.col("t")), t=raw) == want


def test_months_do_not_count_the_last(spark):
    value = one(spark, text.months_between(F.col("a"), F.col("b"), F.lit("2024-01")), a="2020-01", b="2022-12")
    assert value == 35
    assert one(spark, text.months_between(F.col("a"), F.col("b"), F.lit("2021-01")), a="2020-01", b="2030-12") == 12


def test_contacts(spark):
    raw = "Mail : Jean.Dupont @ gmail . com, JEAN.DUPONT@gmail.com\nTel +216 20 123 456 ; 2019-2022 ; 0000-0002-1825-0097\nlinkedin.com/in/jean-dupont github.com/jdupont"
    docs = spark.createDataFrame([(1, raw), (2, None), (3, "")], "id int, raw_text string")
    got = {r.id: r for r in profiles.contacts(docs).collect()}
    assert got[1].emails == ["jean.dupont@gmail.com"] and got[1].linkedin == "https://linkedin.com/in/jean-dupont"
    assert got[1].github == "https://github.com/jdupont" and "21620123456" in got[1].phones
    assert not any(p.startswith(("0000", "2019")) for p in got[1].phones)
    assert got[2].email is None and got[3].phone is None


def test_clean_and_normalise(spark):
    assert one(spark, text.clean_extracted(F.col("t")), t="inter-\r\nnational  ﬁn\n\n\n\nx ") == "international fin\n\nx"
    assert one(spark, text.normalise_offer(F.col("t")), t="PythonJava backend/frontend CI/CD") == "Python Java backend / frontend CI/CD"
    assert one(spark, text.strip_accents(F.col("t")), t="Éàç") == "Eac"


def test_similarities():
    assert similarity.ratio("abcd", "abcd") == 100 and similarity.ratio("", "") == 100
    assert similarity.ratio("abcd", "bcde") == 75.0
    assert similarity.token_set_ratio("spring boot", "boot spring java") == 100
    assert similarity.token_set_ratio("python", "java") < 50
    assert similarity.weighted_ratio("pyhton", "python") >= 82
    assert similarity.common_length("ABCBDAB", "BDCABA") == 4


def test_offer_skills(spark):
    row = spark.createDataFrame([(["Python Java Spring Boot et SQL", "react, React ; de", None],), (None,)], "r array<string>")
    got = [r.s for r in row.select(skills.offer_skills(F.col("r")).alias("s")).collect()]
    assert got == [["Python", "Java", "Spring Boot", "SQL", "react"], []]
    assert one(spark, skills.canonical(F.col("t")), t=" React.JS ") == "react"


def test_heuristic_score(spark):
    pairs = spark.createDataFrame(
        [("Dev", "3 ans, master", "Tunis", ["Python", "Docker"], None, [("py",)], "vit à tunis", 6.0, 5), ("Dev", "", None, [], None, [], None, 0.0, 0)],
        "titre string, description string, localisation string, competences_requises array<string>, experience_requise int, competences array<struct<name:string>>, raw_text string, years double, level int",
    )
    a, b = scoring.heuristic(pairs).collect()
    assert a.score_experience == 1 and a.score_education == 1 and a.score_location == 1 and 0.5 <= a.score_skills < 1
    assert b.score_skills == 0.5 and b.score_experience == 0.5 and b.score_education == 0.5 and b.score_location == 1
    assert b.score == pytest.approx(0.45 * 0.5 + 0.25 * 0.5 + 0.2 * 0.5 + 0.1)


CV = """Jean Dupont
jean.dupont@example.com
Expériences professionnelles
Janvier 2020 – Décembre 2022
Développeur Python chez Acme
- Conception de services web
Depuis 2023
Lead Developer
Formation
Master 2 Informatique, Université de Tunis, 2019
Master Informatique, Université de Tunis, 2019
Licence Informatique 2017
Compétences
Python (5 ans), Java, C
Langues
Français : courant
Anglais 3/5
"""
DICTIONARY = [("python", "Python", "langages"), ("java", "Java", "langages"), ("javascript", "JavaScript", "langages"), ("c", "C", "langages"), ("r", "R", "langages")]


def test_parse_profile(spark):
    docs = spark.createDataFrame([(1, CV), (2, "C'est court."), (3, None)], "id int, raw_text string")
    terms = spark.createDataFrame(DICTIONARY, "term string, name string, category string")
    got = {r.id: r for r in profiles.parse(docs, terms, "2024-01-31").collect()}
    jean = got[1]
    assert jean.name == "Jean Dupont" and jean.email == "jean.dupont@example.com" and jean.error is None
    assert {s.name: s.years for s in jean.skills} == {"Python": 5, "Java": None, "C": None}
    assert [f.diploma for f in jean.formations] == ["Master 2", "Licence"] and jean.level == 5
    assert [(e.title, e.company, e.start, e.months) for e in jean.experiences] == [
        ("Développeur Python", "Acme", "2020-01", 35), ("Lead Developer", None, "2023-01", 12)
    ]
    assert {(x.language, x.level) for x in jean.languages} == {("Français", "Courant"), ("Anglais", "Intermédiaire")}
    assert got[2].error == "text_too_short" and got[3].error == "text_too_short" and not got[2].skills


def test_texts_are_read_once_and_meet_nothing_by_a_join(spark):
    raw = "a" * 50 + "\nLicence 2010\nLicence 2010\nMaster 2012\nMaster 1 2012\nMaster 2013\nC, 3 ans de python, java : 12 years\njean (at) x (dot) org\n"
    docs = spark.createDataFrame([(1, raw), (2, raw.replace("ans", "jours").replace("years", "mois"))], "id int, raw_text string")
    terms = spark.createDataFrame([*DICTIONARY, ("java", "Java", "ile")], "term string, name string, category string")
    parsed = profiles.parse(docs, terms, "2024-01-31")
    got = {r.id: r for r in parsed.collect()}
    assert {(s.name, s.category, s.years) for s in got[1].skills} == {("Python", "langages", 3), ("Java", "langages", 12), ("Java", "ile", 12)}
    assert {(s.name, s.years) for s in got[2].skills} == {("Python", None), ("Java", None)} and got[2].email == "jean@x.org"
    assert [(f.at, f.diploma, f.year) for f in got[1].formations] == [(1, "Licence", 2010), (4, "Master 1", 2012), (5, "Master", 2013)]
    plan = profiles.skills(profiles.lines(docs), terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
    assert profiles.formations(profiles.lines(docs))._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_table_of_contents_opens_nothing(spark):
    docs = spark.createDataFrame([(1, "Expériences\nFormation\nLangues\nExpérience\n2020 - 2021\nIngénieur\n")], "id int, raw_text string")
    rows = profiles.lines(docs)
    assert {(r.line, r.section) for r in rows.collect()} == {("2020 - 2021", "experience"), ("Ingénieur", "experience")}
    assert profiles.experiences(rows, "2024-01-31").count() == 1


def test_layout_of_two_columns(spark):
    left = [(1, 600.0, 50.0, y, 200.0, f"L{i}") for i, y in enumerate((10.0, 22.0, 60.0))]
    right = [(1, 600.0, 350.0, y, 500.0, f"Right text {i} of words") for i, y in enumerate((11.0, 23.0))]
    dates = [(2, 600.0, 50.0, 10.0, 200.0, "a"), (2, 600.0, 50.0, 20.0, 200.0, "b"), (2, 600.0, 400.0, 10.0, 450.0, "2020"), (2, 600.0, 400.0, 20.0, 450.0, "2021")]
    rows = spark.createDataFrame(left + right + dates, "page_id int, page_width double, x0 double, y0 double, x1 double, text string")
    got = {r.page_id: r.text for r in profiles.layout_text(rows).collect()}
    assert got[1].startswith("L0\nL1\n\nL2\n\nRight text 0") and got[2] == "a\n2020\nb\n2021"


def test_spans(spark):
    tokens = spark.createDataFrame([(1, "PER", 0, 4), (1, "PER", 5, 9), (1, "PER", 20, 25), (1, "LOC", 26, 30)], "id int, label string, begin int, end int")
    assert {(r.label, r.begin, r.end) for r in profiles.merged_spans(tokens).collect()} == {("PER", 0, 9), ("PER", 20, 25), ("LOC", 26, 30)}


def docx(*paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("Un", "Deux"))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"x")
    found = documents.files(spark, str(tmp_path))
    fine, rejected = documents.validated(found)
    assert rejected.count() == 1
    got = {r.path[-6:]: r for r in documents.extracted(fine).collect()}
    assert got["a.docx"].text == "Un\nDeux" and not got["b.docx"].success and got["b.docx"].error
    cache = documents.extracted(fine.where("path like '%a.docx'")).select("sha256", "text")
    assert documents.cached(fine, cache, documents.extracted).count() == 2


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", "x", "y", 0.5, 1.0, "t")], tables.PAIR_LABELS)
    for _ in range(2):
        tables.append_csv(rows, f"{tmp_path}/pairs")
    assert tables.read_csv(spark, f"{tmp_path}/pairs", tables.PAIR_LABELS).count() == 2
    (tmp_path / "d.json").write_text('{"python": ["py", "python3"]}')
    assert tables.read_dictionary(spark, f"{tmp_path}/d.json").count() == 2
    assert tables.read_dictionary(spark, f"{tmp_path}/none.json").count() == 0
    assert tables.load_pipeline(f"{tmp_path}/none")[0] is None


def test_dashboard_edges(spark):
    offers = spark.createDataFrame([(1, "a", "active"), (2, "b", "active"), (3, "c", "active")], "id long, titre string, status string")
    found = spark.createDataFrame([(1, 2, 0), (2, 3, 35), (3, 3, 65)], "id long, offer_id long, score_pct long")
    got = {r.id: r for r in dashboard.offer_pipeline(offers, found).collect()}
    assert (got[1].n_matches, got[1].best, got[1].mean) == (0, None, None)
    assert (got[2].n_matches, got[2].n_scored) == (1, 0)
    assert (got[3].excellent, got[3].moyen, got[3].faible, got[3].mean) == (1, 1, 0, 50.0)


def test_first_per_key_treats_nulls_as_one(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id int, email string")
    assert {r.id for r in listings.first_per_key(rows, "email", ["id"]).collect()} == {1, 3}


def test_transitions(spark):
    people = spark.createDataFrame([(1, "N", "e", "t")], "id long, nom string, email string, telephone string")
    once = transitions.anonymise(people)
    assert transitions.anonymise(once).collect() == once.collect()
    left = spark.createDataFrame([(1,), (2,)], "candidate_id int")
    right = spark.createDataFrame([(7,), (8,)], "offer_id int")
    old = spark.createDataFrame([(1, 7)], "candidate_id int, offer_id int")
    new = transitions.missing_links(left, right, old, "candidate_id", "offer_id")
    assert {tuple(r) for r in new.collect()} == {(1, 8), (2, 7), (2, 8)}
    assert transitions.missing_links(left, right, old.unionByName(new), "candidate_id", "offer_id").count() == 0


def test_negation(spark):
    row = spark.createDataFrame([("je ne connais pas python", "python"), ("python oui, pas de python", "python"), ("java", "python")], "t string, s string")
    assert [r.v for r in row.select(scoring.negated(F.col("t"), F.col("s"), ("pas", "sans", "aucun")).alias("v")).collect()] == [True, False, False]


def test_inversions_and_augmentation(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.95)], "grp int, id int, score double")
    critical = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "grp int, better int, worse int")
    assert [tuple(r) for r in evaluation.inversions(scored, critical, "grp").collect()] == [(1, 2, 3)]
    rows = spark.createDataFrame([(1, 0.5, 0.5)], "id int, f double, label double")
    assert evaluation.augmented(rows, ["f"], 5, 0.1).where("f between 0 and 1").count() == 5


def test_pair_labels_keep_their_bounds(spark):
    row = spark.createDataFrame([(0.0, 0.0, 0.0, 4), (1.0, 1.0, 1.0, 0)], "s double, e double, u double, g int")
    low, high = [r.v for r in row.select(scores.pair_label_a(F.col("s"), F.col("e"), F.col("u"), F.col("g")).alias("v")).collect()]
    assert (low, high) == (0.02, 0.95)


def test_symmetric_and_enriched(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "x string, y string")
    assert {tuple(r) for r in matching.symmetric(edges, "x", "y").collect()} == {("a", "b"), ("b", "a")}


def test_streams(spark, tmp_path):
    schema = "cv_id string, candidate_id int, action string, created_at timestamp"
    rows = [("a", 1, "upload", "2024-01-01 10:00:00"), ("a", 1, "upload", "2024-01-01 10:05:00"), ("b", 2, "view", "2024-01-02 10:00:00")]
    frame = spark.createDataFrame(rows, "cv_id string, candidate_id int, action string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    frame.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for name, plan, mode in (("counts", audit.counts_by_action(stream()), "complete"), ("uploads", audit.first_uploads(stream()), "append")):
        plan.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.action, r.n) for r in spark.table("counts").collect()} == {("upload", 2), ("view", 1)}
    assert spark.table("uploads").count() == 2
