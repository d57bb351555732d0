"""Companies, contacts and names on small texts."""

from pyspark.sql import functions as F

from hiresift.functions import text
from hiresift.operators import companies, profiles


def test_best_company_of_a_block(spark):
    blocks = [
        (1, ["Développeur web chez Acme SARL, Paris", "2019 - 2021", "- Refonte du site | Docker"]),
        (2, ["Ingénieur data | Globex | Lyon"]),
        (3, ["Chef de projet", "Initech, Tunis"]),
        (4, ["Stagiaire 2020", "missions diverses"]),
        (5, []),
        (6, ["Développeur - Python"]),
    ]
    known = spark.createDataFrame([("Initech", 2), ("globex", 9)], "name string, times int")
    spans = spark.createDataFrame([(4, "Umbrella Corp")], "id int, name string")
    got = companies.best_companies(
        spark.createDataFrame(blocks, "id int, lines array<string>"), known, r"d[ée]veloppeur|ing[ée]nieur|chef de projet|stagiaire", ["missions"], ["python", "docker"], spans
    ).collect()
    assert {r.id: (r.company, r.score) for r in got} == {1: ("Acme SARL", 5), 2: ("Globex", 10), 3: ("Initech", 9), 4: ("Umbrella Corp", 8)}


def test_clean_names(spark):
    rows = [("Acme (Paris) janvier 2020", "Acme"), ("12/2020", ""), (None, ""), ("Société Générale - 2019", "Société Générale")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "n string").select(text.clean_company(F.col("n"), ["stage"])).collect()]
    assert got == [b for _, b in rows]
    people = [("JEAN DUPONT ● Paris", "Jean Dupont"), ("Anna-Maria Li anna@x.org CV", "Anna-Maria Li"), ("YoussefGara Tunis", "Youssef Gara"), (None, "")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in people], "n string").select(text.clean_person(F.col("n"), ["cv", "paris", "tunis"])).collect()]
    assert got == [b for _, b in people]


def test_contacts(spark):
    body = "Jean Dupont\nLyon, France\nhttps://github.com/jd www.jean.dev, https://linkedin.com/in/jd\nTél : 06 12 34 56 78"
    rows = spark.createDataFrame([(body,), ("Adresse : 3 rue X, Nice\nLyon",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(text.website(F.col("t")), text.address(F.col("t"), ["Lyon", "Nice"]), text.labelled_phones(F.col("t"))).collect()]
    assert got == [("www.jean.dev", "Lyon, France", ["0612345678"]), (None, "3 rue X, Nice", []), (None, None, [])]


def test_diplomas(spark):
    lines = {
        "Ph.D. in Physics": ("Doctorat", 8), "Thèse de doctorat": ("Doctorat", 8), "Master 2 data": ("Master 2", 5), "M.Sc. Computer Science": ("Master", 5),
        "Maîtrise de droit": ("Maîtrise", 4), "Diplôme d'ingénieur": ("Diplôme d'Ingénieur", 5), "Ingénieur chez Acme": (None, None), "ingenieur 2012": ("Diplôme d'Ingénieur", 5),
        "Licence professionnelle": ("Licence Professionnelle", 3), "B.Sc": ("Bachelor", 3), "Bac + 2": ("Bac+2", 2), "Bac scientifique": ("Baccalauréat", 0), "Classes préparatoires": ("Cycle Préparatoire", 2),
        "DES de cardiologie": ("DES (Spécialité médicale)", 6), "cours des écoles": (None, None), "Diplôme d'État d'infirmier": ("Diplôme d'État", 3), "BEP vente": ("BEP", 1), "A-Levels": ("High School Diploma", 0),
    }
    rows = spark.createDataFrame([(k,) for k in lines], "line string")
    label, level = profiles._diploma(F.col("line"))
    assert {r.line: (r.a, r.b) for r in rows.select("line", label.alias("a"), level.alias("b")).collect()} == lines
